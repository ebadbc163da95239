"""Token ids as directly addressable codes.

Format of a segment: every id is cut into chunks of ``CHUNK_BITS`` bits, lowest first. Level 0
holds the first chunk of every id, with a bitmap that says which ids continue; level 1 holds the
second chunk of exactly those, and so on. A rank directory (set bits before every block of
512) turns "position in level l" into "position in level l + 1" with one lookup and one
partial popcount, so any id is read without decoding a block before it.

    magic "DAC1" | u32 ids | u8 levels | per level: u32 n, n chunk bytes, and unless it is
    the last: ceil(n / 8) bitmap bytes (lowest bit first), u32 ranks, one per 512 positions

Segments are rows of a Parquet table in the shared folder (payload binary, plus the document
ids and token ends of the segment), written by Spark's committer: any store, and a lost
executor only repeats its tasks. Pages are neither compressed nor dictionary-encoded, so a segment lies in
its file byte for byte: ``TokenStore.token_at`` finds the segment of a position, and reads the file's footer once
and then a few bytes per level. Documents are range-partitioned and sorted by id; a
segment closes after ``segment_tokens`` ids, a document is never cut.

Encoding works on the bytes of a batch of texts at once. ASCII pieces (runs without white space) are cut
where the tokenizer cuts them: runs of letters, single digits, runs of other marks. A piece with any
other byte, an apostrophe or ``<`` is kept whole, since its cuts depend on more. The distinct cuts of a batch are
found by Arrow, looked up in a bounded table per worker, unknown ones are encoded by the tokenizer (words
many at a time: each ends in an end-of-word token), and the ids are gathered by position. The
table has two generations: what is used moves to the young one, the old one is dropped when that is full.

Defined results: null text is the empty text, so only the end id. Rows that repeat an id are
written one after another, ordered by a hash of their text; a null id comes first. An empty
table writes no segments and gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.session import checkpoint_dir, small_batches

MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_BLOCK = 512
END_ID = 2
SEGMENT_TOKENS = 1 << 20
TABLE_TOKENS = 200_000
KEPT_LENGTH = 64
BATCH_BYTES = 2 << 20
LETTERS_MARKS = re.compile(r"""^(([^\W\d_]+)([,.;:!?*#$%&|"()]*))$""", re.MULTILINE)


def encode_segment(ids: np.ndarray) -> bytes:
    """The ids (unsigned 32-bit) as one directly addressable segment."""
    out, rest, levels = [], np.asarray(ids, np.uint32), []
    while True:
        more = rest >> CHUNK_BITS
        levels.append((rest.astype(np.uint8), more != 0))
        rest = more[more != 0]
        if not len(rest):
            break
    for depth, (chunks, go_on) in enumerate(levels):
        out += [np.uint32(len(chunks)).tobytes(), chunks.tobytes()]
        if depth + 1 < len(levels):
            bitmap = np.packbits(go_on, bitorder="little")
            set_bits = np.add.reduceat(np.bitwise_count(bitmap), np.arange(0, len(bitmap), RANK_BLOCK // 8), dtype=np.int64)
            out += [bitmap.tobytes(), (np.cumsum(set_bits) - set_bits).astype("<u4").tobytes()]
    return MAGIC + np.uint32(len(ids)).tobytes() + bytes([len(levels)]) + b"".join(out)


class Segment:
    """Random access to an encoded segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.n, depth, at = int(np.frombuffer(data, "<u4", 1, 4)[0]), data[8], 9
        self.levels = []
        for level in range(depth):
            n = int(np.frombuffer(data, "<u4", 1, at)[0])
            chunks = np.frombuffer(data, np.uint8, n, at + 4)
            at += 4 + n
            bitmap = ranks = None
            if level + 1 < depth:
                bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at)
                ranks = np.frombuffer(data, "<u4", -(-n // RANK_BLOCK), at + len(bitmap))
                at += len(bitmap) + 4 * len(ranks)
            self.levels.append((chunks, bitmap, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        value = 0
        for level, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * level)
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(bitmap, ranks, i)
        return value

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before position i."""
        block = i // RANK_BLOCK
        part = bitmap[block * RANK_BLOCK // 8:i >> 3]
        tail = int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(ranks[block]) + int(np.bitwise_count(part).sum()) + tail.bit_count()

    def slice(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop], reading only their chunks."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where = np.arange(len(out))
        for level, (chunks, bitmap, ranks) in enumerate(self.levels):
            if not len(where):
                break
            out[where] |= chunks[start:start + len(where)].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            if bitmap is None:
                break
            first = start >> 3
            bits = np.unpackbits(bitmap[first:-(-(start + len(where)) // 8)], bitorder="little")
            go_on = bits[start - 8 * first:][:len(where)].astype(bool)
            start = self._rank(bitmap, ranks, start)
            where = where[go_on]
        return out


SPACE, LETTER, DIGIT, MARK, WHOLE = range(5)


def _kind(b: int) -> int:
    """Class of a byte; WHOLE: the piece around it is not cut here."""
    if b in b" \t\n\x0b\x0c\r":
        return SPACE
    if b >= 127 or b < 32 or b in b"'<":
        return WHOLE
    return LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK


KINDS = np.array([_kind(b) for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def cut(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens, their offsets, the place of each in ``data``). ``data``: texts one after another,
    ``starts``: where each begins; nothing reaches over a start."""
    kind = KINDS[data]
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    first = first[:-1]
    black = kind != SPACE
    apart = first.copy()
    apart[1:] |= kind[1:] != kind[:-1]
    begin = black & (apart | (kind == DIGIT))
    low = LOWER[data]
    if (kind == WHOLE).any():
        piece = black.copy()
        piece[1:] &= ~black[:-1] | first[1:]
        at = np.flatnonzero(piece)
        whole = np.add.reduceat(kind == WHOLE, at, dtype=np.int64) > 0
        inside = np.zeros(len(data), bool)
        inside[at[0]:] = np.repeat(whole, np.diff(np.append(at, len(data))))
        begin = np.where(inside, piece, begin)
        low = np.where(inside, data, low)
    return low[black], np.append(np.flatnonzero(begin[black]), int(black.sum())), np.flatnonzero(begin)


class Table:
    """bytes -> slot, with the ids of slot s at ids[offset[s]:offset[s + 1]]."""

    def __init__(self):
        self.slot: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.offset = np.zeros(1 << 14, np.int64)
        self.n = 0

    def add(self, tokens: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        end = int(self.offset[self.n])
        ends = end + np.cumsum(lengths)
        while end + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.n + len(tokens) + 1 > len(self.offset):
            self.offset = np.concatenate((self.offset, np.zeros_like(self.offset)))
        self.ids[end:end + len(ids)] = ids
        self.offset[self.n + 1:self.n + 1 + len(tokens)] = ends
        self.slot.update(zip(tokens, range(self.n, self.n + len(tokens))))
        self.n += len(tokens)

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the slots one after another, where each begins and the last ends)."""
        lengths = self.offset[slots + 1] - self.offset[slots]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return self.ids[np.repeat(self.offset[slots] - ends[:-1], lengths) + np.arange(ends[-1])], ends


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own, by a bounded table of tokens."""

    def __init__(self, tokenizer_json: str, table_tokens: int = TABLE_TOKENS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.tok = Tokenizer.from_str(tokenizer_json)
        # For words that are normalised already: the same model and byte table, split at spaces only.
        self.plain_words = Tokenizer(self.tok.model)
        self.plain_words.pre_tokenizer = Sequence([Split(" ", "removed"), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.young, self.old, self.table_tokens = Table(), Table(), table_tokens
        ends = np.zeros(self.tok.get_vocab_size(), bool)
        for word, i in self.tok.get_vocab().items():
            ends[i] = word.endswith("</w>")
        self.ends = ends

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*found, np.zeros(0, np.uint32)]), np.array([len(x) for x in found], np.int64)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only, in the form the tokenizer brings them to: a thousand in one string."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), 1000):
            some = words[a:a + 1000]
            got = np.array(self.plain_words.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[got]) + 1
            size = np.diff(cuts, prepend=0)
            if len(cuts) != len(some) or (len(got) and cuts[-1] != len(got)):
                got, size = self._each([w.decode() for w in some])
            ids.append(got)
            lengths.append(size)
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, tokens: list[bytes]) -> None:
        """Add the ids of unknown tokens. Whole pieces of letters + marks are taken apart, since the
        tokenizer always breaks there, so that a word is encoded once for all its marks."""
        known = self.young.slot
        plain = [t for t in tokens if t.isalpha()]  # of bytes: ASCII letters only
        if plain:
            self.young.add(plain, *self._words(plain))
        rest = [t.decode() for t in tokens if not t.isalpha()]
        if not rest:
            return
        lines = "\n".join(rest)
        normal = unicodedata.is_normalized("NFC", lines)
        apart = {p: (low, marks) for p, core, marks in LETTERS_MARKS.findall(lines)
                 if "\u03a3" not in core  # str.lower makes a word-final one another letter than the tokenizer does
                 and (low := core.lower()).isalpha() and len(low) == len(core) and len(core) <= KEPT_LENGTH
                 and (normal or unicodedata.is_normalized("NFC", core))}
        words = sorted({low.encode() for low, _ in apart.values()}.difference(known))
        if words:
            self.young.add(words, *self._words(words))
        others = sorted({*(p for p in rest if p not in apart and p.encode() not in known),
                         *(m for _, m in apart.values() if m and m.encode() not in known)})
        if others:
            self.young.add([p.encode() for p in others], *self._each(others))
        new = [p for p in apart if p.encode() not in known]
        if new:
            pairs = np.array([(known[apart[p][0].encode()], known[apart[p][1].encode()] if apart[p][1] else -1) for p in new])
            both = pairs.ravel()
            ids, ends = self.young.gather(both[both >= 0])
            sizes = np.zeros(len(both), np.int64)
            sizes[both >= 0] = np.diff(ends)
            self.young.add([p.encode() for p in new], ids, sizes.reshape(-1, 2).sum(axis=1))

    def _slots(self, tokens: list[bytes]) -> np.ndarray:
        if self.young.n > self.table_tokens:
            self.old, self.young = self.young, Table()
        unknown = [t for t in tokens if t not in self.young.slot]
        if unknown:
            kept = [t for t in unknown if t in self.old.slot]
            if kept:
                ids, ends = self.old.gather(np.fromiter(map(self.old.slot.__getitem__, kept), np.int64, len(kept)))
                self.young.add(kept, ids, np.diff(ends))
            new = [t for t in unknown if t not in self.young.slot] if kept else unknown
            if new:
                self._learn(new)
        return np.fromiter(map(self.young.slot.__getitem__, tokens), np.int64, len(tokens))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the last end), without end ids."""
        flat = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
        if offsets[-1] == offsets[0]:
            return np.zeros(0, np.uint32), np.zeros(len(flat) + 1, np.int64)
        data = np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        body, at, places = cut(data, offsets[:-1])
        if not len(places):
            return np.zeros(0, np.uint32), np.zeros(len(flat) + 1, np.int64)
        tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), [
            None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)]).dictionary_encode()
        del body, at
        names = tokens.dictionary.to_pylist()
        slots = self._slots(names)
        ids, ends = self.young.gather(slots[tokens.indices.to_numpy()])
        for name in names:
            if len(name) > KEPT_LENGTH:  # rare by nature: its ids stay until the generation goes, its name does not
                del self.young.slot[name]
        return ids, ends[np.searchsorted(places, offsets)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text, without end ids."""
        ids, ends = self.encode(pa.array(texts, pa.large_string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:])]


def worker_encoder(tokenizer_json: str) -> Encoder:
    """One encoder per Python worker, kept from task to task."""
    kept = sys.modules.setdefault("_shopfloor_token_worker", types.ModuleType("_shopfloor_token_worker"))
    key = zlib.crc32(tokenizer_json.encode())
    if getattr(kept, "key", None) != key:
        kept.key, kept.encoder = key, Encoder(tokenizer_json)
    return kept.encoder


SEGMENT_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_token", pa.int64()),
                            ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                            ("doc_ends", pa.list_(pa.int64())), ("payload", pa.binary())])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``BATCH_BYTES`` of text, one row at least."""
    upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + BATCH_BYTES, "right")) - 1)
        yield a, b
        a = b


def _write_segments(tokenizer_json, segment_tokens: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, written, size = TaskContext.get().partitionId(), 0, 0, 0
        encoder = worker_encoder(tokenizer_json.value)
        names, ends, parts = [], [], []

        def close():
            nonlocal seq, written, size
            row = pa.RecordBatch.from_arrays([
                *[pa.array([v], t) for v, t in zip((part, seq, written, size), SEGMENT_SCHEMA.types)],
                *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                  for x in (pa.concat_arrays(names), pa.array(np.concatenate(ends), pa.int64()))],
                pa.array([encode_segment(np.concatenate(parts))], pa.binary())], schema=SEGMENT_SCHEMA)
            seq, written, size = seq + 1, written + size, 0
            names.clear(), ends.clear(), parts.clear()
            return row

        for b in batches:
            for first, last in _slices(b.column(1)):
                ids, upto = encoder.encode(b.column(1).slice(first, last - first))
                ids = np.insert(ids, upto[1:], end_id).astype(np.uint32)
                upto = upto[1:] + np.arange(1, len(upto))  # with the end ids
                at, base = 0, 0
                while at < len(upto):  # one turn per segment that these rows close, and one for the rest
                    stop = int(np.searchsorted(upto, base + segment_tokens - size)) + 1
                    full, stop = stop <= len(upto), min(stop, len(upto))
                    parts.append(ids[base:upto[stop - 1]])
                    ends.append(upto[at:stop] - base + size)
                    names.append(b.column(0).take(pa.array(range(first + at, first + stop))))  # a slice keeps the batch's texts
                    size += int(upto[stop - 1]) - base
                    at, base = stop, int(upto[stop - 1])
                    if full:
                        yield close()
        if names:
            yield close()
    return run


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 segment_tokens: int = SEGMENT_TOKENS, end_id: int = END_ID) -> None:
    """Write the ids of every text, documents in ascending id order, as segments under ``path``."""
    with open(tokenizer_path, encoding="utf-8") as f:  # a vocabulary file of a few MB, shipped once per executor
        tokenizer_json = df.sparkSession.sparkContext.broadcast(f.read())
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    tie = F.xxhash64("t")
    ordered = docs.repartitionByRange("id", tie).sortWithinPartitions("id", tie)
    segments = ordered.mapInArrow(_write_segments(tokenizer_json, segment_tokens, end_id),
                                  "part int, seq int, first_token bigint, n_tokens bigint, doc_ids array<bigint>, "
                                  "doc_ends array<bigint>, payload binary")
    with small_batches(df.sparkSession):
        segments.write.options(**{"compression": "none", "parquet.enable.dictionary": "false"}).parquet(path)


def _read_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):  # one segment at a time as Python objects
            row = b.slice(i, 1).to_pylist()[0]
            seg, start, out = Segment(row["payload"]), 0, []
            ids = seg.slice(0, len(seg)).astype("<u4")
            for doc, end in zip(row["doc_ids"], row["doc_ends"]):
                out.append((doc, row["part"], row["first_token"] + start, end - start, zlib.crc32(ids[start:end])))
                start = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["id", "part", "start", "n_tokens", "ids_crc32"])


def read_documents(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: ``id_col``, start (ids before it), n_tokens, ids_crc32."""
    table = spark.read.parquet(path)
    docs = table.select("part", "first_token", "doc_ids", "doc_ends", "payload").mapInArrow(
        _read_segments, "id bigint, part int, start bigint, n_tokens bigint, ids_crc32 bigint")
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per partition written
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return docs.join(offsets, F.col("part") == F.col("_part")).select(
        F.col("id").alias(id_col), (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


class TokenStore:
    """Random access to written token files: single tokens by their position in the whole output."""

    def __init__(self, spark, path: str):
        table = spark.read.parquet(path).select("part", "seq", "first_token", "n_tokens", F.col("_metadata.file_path").alias("file"))
        parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        place = F.row_number().over(Window.partitionBy("file").orderBy("seq")) - 1
        self.segments = table.join(offsets, "part").select("file", (F.col("offset") + F.col("first_token")).alias("start"),
                                                          "n_tokens", place.alias("place"))
        self.spark, self.files, self.bytes_read = spark, {}, 0

    def _reader(self, file: str):
        """read(position, length) on a file of any store that Spark reaches."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        stream = fs.open(where)

        def read(at: int, n: int) -> bytes:
            stream.seek(at)
            self.bytes_read += n
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        return read, fs.getFileStatus(where).getLen()

    def _payloads(self, file: str):
        """(read, places): where each segment of a file begins, from its footer and the bytes before each value."""
        if file not in self.files:
            read, size = self._reader(file)
            length = int.from_bytes(read(size - 8, 4), "little")
            meta = pq.read_metadata(pa.BufferReader(b"PAR1" + read(size - 8 - length, length + 8)))
            places = []
            for group in map(meta.row_group, range(meta.num_row_groups)):
                columns = map(group.column, range(group.num_columns))
                at = next(c.data_page_offset for c in columns if c.path_in_schema == "payload")
                for _ in range(group.num_rows):  # a value is its length, then itself; a page header may stand before
                    head = read(at, min(256, size - at))
                    skip = head.index(MAGIC, 4)
                    places.append(at + skip)
                    at += skip + int.from_bytes(head[skip - 4:skip], "little")
            self.files[file] = read, places
        return self.files[file]

    def token_at(self, position: int) -> int:
        """The token id at ``position`` (0-based, over all documents in id order)."""
        row = self.segments.where((F.col("start") <= position) & (F.col("start") + F.col("n_tokens") > position)).first()
        if row is None:
            raise IndexError(position)
        read, places = self._payloads(row["file"])
        return read_token(read, places[row["place"]], position - row["start"])


def read_token(read, at: int, i: int) -> int:
    """One id of the segment that begins at byte ``at``, by a few reads per level."""
    if read(at, 4) != MAGIC:
        raise ValueError("not a token segment")
    depth, value = read(at + 8, 1)[0], 0
    at += 9
    for level in range(depth):
        n = int.from_bytes(read(at, 4), "little")
        value |= read(at + 4 + i, 1)[0] << (CHUNK_BITS * level)
        if level + 1 == depth:
            break
        bitmap = at + 4 + n
        block = i // RANK_BLOCK
        bits = np.frombuffer(read(bitmap + block * RANK_BLOCK // 8, (i >> 3) - block * RANK_BLOCK // 8 + 1), np.uint8)
        if not bits[-1] >> (i & 7) & 1:
            break
        ranks = bitmap + -(-n // 8)
        i = int.from_bytes(read(ranks + 4 * block, 4), "little") + int(np.bitwise_count(bits[:-1]).sum()) \
            + (int(bits[-1]) & ((1 << (i & 7)) - 1)).bit_count()
        at = ranks + 4 * -(-n // RANK_BLOCK)
    return value


def token_output(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None, **options) -> DataFrame:
    """Write the token files (under ``path``, or a fresh shared folder) and report every
    document as read back from them."""
    path = path or checkpoint_dir(df.sparkSession, "tokens")
    write_tokens(df, path, tokenizer_path, id_col, text_col, **options)
    return read_documents(df.sparkSession, path, id_col)
