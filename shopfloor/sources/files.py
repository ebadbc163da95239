"""File sources and sinks: CSV tables, manual text folders, image folders, the JSON
decision log and tracked-run metric files. Every reader takes an explicit schema."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TELEMETRY_CSV_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("machine_id", T.StringType()),
    T.StructField("k1", T.LongType()), T.StructField("k2", T.IntegerType()), T.StructField("k3", T.LongType()),
    T.StructField("temperature", T.DoubleType()), T.StructField("vibration", T.DoubleType()),
    T.StructField("pressure", T.DoubleType()), T.StructField("rpm", T.DoubleType()),
    T.StructField("voltage", T.DoubleType()), T.StructField("is_failure", T.IntegerType()),
    T.StructField("failure_type", T.StringType())])

PRODUCTION_CSV_SCHEMA = T.StructType([
    T.StructField("batch_id", T.StringType()), T.StructField("line_id", T.StringType()),
    T.StructField("machine_id", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("units_produced", T.IntegerType()), T.StructField("defect_count", T.IntegerType()),
    T.StructField("quality_score", T.DoubleType()), T.StructField("defect_type", T.StringType())])

MAINTENANCE_CSV_SCHEMA = T.StructType([
    T.StructField("log_id", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("machine_id", T.StringType()), T.StructField("incident_text", T.StringType()),
    T.StructField("urgency_level", T.StringType()), T.StructField("action_taken", T.StringType()),
    T.StructField("downtime_hours", T.DoubleType())])

DECISION_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("event_id", T.StringType()),
    T.StructField("ai_recommendation", T.StringType()), T.StructField("decision_type", T.StringType()),
    T.StructField("supervisor_id", T.StringType()), T.StructField("notes", T.StringType()),
    T.StructField("status", T.StringType())])

#: Text timestamps: whole seconds, or up to six digits after a point.
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
TS_READ_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
TS_FRACTION_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str) -> None:
    """Header, no index; missing values written as the text 'None'."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "None") \
        .option("quote", '"').option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, ts_col: str | None = "timestamp",
             corrupt_col: str | None = None) -> DataFrame:
    """Typed columns of ``schema``, found by the file's header, 'None' read as NULL, text timestamps
    parsed once. A column that the file lacks is NULL; other columns of the file are left out.
    ``corrupt_col``: adds the raw line of rows that do not fit the header."""
    options = {"header": True, "nullValue": "None", "quote": '"', "escape": '"'}
    names = spark.read.options(**options).csv(path).columns
    raw = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_bad", T.StringType())])
    df = spark.read.options(**options, columnNameOfCorruptRecord="_bad", enforceSchema=False).schema(raw).csv(path)
    cols = [(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields]
    df = df.select(*cols, *([F.col("_bad").alias(corrupt_col)] if corrupt_col else []))
    if ts_col:
        df = df.withColumn(ts_col, F.try_to_timestamp(F.col(ts_col), F.lit(TS_READ_FORMAT)))
    return df


def with_text_ts(df: DataFrame, col: str = "ts", out: str = "timestamp") -> DataFrame:
    """Time as text; the fraction of a second is written where there is one."""
    whole = F.date_trunc("second", col) == F.col(col)
    return df.withColumn(out, F.when(whole, F.date_format(col, TS_FORMAT)).otherwise(F.date_format(col, TS_FRACTION_FORMAT))) \
        .drop(col)


def write_manuals(docs: DataFrame, path: str) -> None:
    """Manuals as JSON lines (source, text): many manuals a file, so the file count follows the
    data size."""
    docs.select(F.col("doc_id").cast("string").alias("source"), "text").write.mode("overwrite").json(path)


def read_manual_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of manuals written by ``write_manuals``."""
    return spark.read.schema("source string, text string").option("mode", "FAILFAST").json(path)


def read_manuals(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of a plain folder of text files: one row per file, the file name as source,
    the whole file as text; undecodable bytes dropped."""
    t = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return t.select(F.col("_metadata.file_name").alias("source"), F.regexp_replace("value", "\ufffd", "").alias("text"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Spark image source: BGR bytes in ``image.data``; label from the parent folder; status is
    'ok' or 'invalid' for files that cannot be decoded (kept, with no pixels)."""
    im = spark.read.format("image").option("recursiveFileLookup", True).load(path)
    return im.withColumn("label_dir", F.regexp_extract("image.origin", r"/(normal|defect)/", 1)) \
        .withColumn("status", F.when(F.col("image.height") > 0, "ok").otherwise("invalid"))


def read_decision_log(spark: SparkSession, path: str) -> DataFrame:
    """The decision log: one JSON array (indented or not) or JSON lines, by its first character.
    Only a path that does not exist reads as an empty log; unreadable content is an error."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], DECISION_SCHEMA)
        raise
    first = lines.where(F.trim("value") != "").limit(1).collect()
    array = bool(first) and first[0][0].lstrip().startswith("[")
    return spark.read.schema(DECISION_SCHEMA).option("mode", "FAILFAST").option("multiLine", array).json(path)


def append_decisions(df: DataFrame, path: str) -> None:
    df.select(*[F.col(f.name).cast(f.dataType) for f in DECISION_SCHEMA.fields]).write.mode("append").json(path)


def write_run_files(long: DataFrame, path: str, epoch_ms: int) -> None:
    """Tracked runs from (run_name, key, value[, kind]): a folder per kind (metrics, params) and key with
    lines 'run epoch_ms value step' for metrics and 'run value' for params, so the file count
    stays bounded when runs are many."""
    kind = F.col("kind") if "kind" in long.columns else F.lit("metrics")
    value = F.col("value").cast("string")
    metric = F.format_string("%s %d %s 0", F.col("run_name"), F.lit(epoch_ms), value)
    long.select(kind.alias("kind"), "key", F.when(kind == "metrics", metric).otherwise(
        F.concat_ws(" ", "run_name", value)).alias("line")).write.mode("overwrite").partitionBy("kind", "key").text(path)


def read_run_files(spark: SparkSession, path: str) -> DataFrame:
    """(run_name, kind, key, epoch_ms, value, step, text) of tracked runs, in either layout: a folder
    per run with ``metrics/<key>`` ('epoch_ms value step' lines) and ``params/<key>`` files, or the
    bundled one of ``write_run_files``. Other files of a run are not read; value is NULL for params
    that are no numbers."""
    t = spark.read.option("recursiveFileLookup", True).text(path)
    fp = F.col("_metadata.file_path")
    bundled = fp.contains("/kind=")
    kind = F.regexp_extract(fp, r"/(?:kind=)?(metrics|params)/", 1)
    key = F.when(bundled, F.regexp_extract(fp, r"/key=([^/]+)/", 1)).otherwise(F.regexp_extract(fp, r"/(?:metrics|params)/(.+)$", 1))
    run = F.when(bundled, F.substring_index("value", " ", 1)).otherwise(F.regexp_extract(fp, r"/([^/]+)/(?:metrics|params)/", 1))
    rest = F.when(bundled, F.expr("substring(value, length(substring_index(value, ' ', 1)) + 2)")).otherwise(F.col("value"))
    rows = t.select(run.alias("run_name"), kind.alias("kind"), F.url_decode(key).alias("key"), rest.alias("rest")).where("kind <> ''")
    part = F.split("rest", " ")
    is_metric = F.col("kind") == "metrics"
    return rows.select(
        "run_name", "kind", "key", F.when(is_metric, F.get(part, F.lit(0)).try_cast("long")).alias("epoch_ms"),
        F.when(is_metric, F.get(part, F.lit(1))).otherwise(F.col("rest")).try_cast("double").alias("value"),
        F.when(is_metric, F.get(part, F.lit(2)).try_cast("long")).alias("step"),
        F.when(~is_metric, F.col("rest")).alias("text"))


def png_bytes(width: int, height: int, rgb: bytes) -> bytes:
    """Minimal 8-bit RGB PNG encoder (no filter), for writing pixel tiles as files."""
    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)

    raw = b"".join(b"\x00" + rgb[y * width * 3:(y + 1) * width * 3] for y in range(height))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def write_tiles_as_png(pixels: DataFrame, path: str) -> None:
    """Each image's pixels -> one PNG under <path>/<normal|defect>/<id>.png, written by the
    task holding the image (pixels grouped by image; an image is bounded) through the file
    system that ``path`` names, which all executors share. A repeated task writes the same file."""
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        pdf = pdf.sort_values(["y", "x"])
        w, h = int(pdf["x"].max()) + 1, int(pdf["y"].max()) + 1
        rgb = pdf[["r", "g", "b"]].to_numpy(dtype="uint8").tobytes()
        folder = f"{root}/{pdf['label_dir'].iloc[0]}"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{int(pdf['image_id'].iloc[0])}.png") as f:
            f.write(png_bytes(w, h, rgb))
        return pd.DataFrame({"image_id": [int(pdf["image_id"].iloc[0])]})

    pixels.groupBy("image_id").applyInPandas(write, "image_id long").write.format("noop").mode("overwrite").save()
