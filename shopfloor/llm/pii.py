"""Personal data: seed entities, then bootstrapped contextual extraction.

Seeds are the matches of four fixed patterns (email, ip, card, phone) in the whole text.
Bootstrapping: every seed and every other identifier-like token (a run of non-spaces with a
digit or an at sign) is a *mention*. So is every
run of digit groups with spaces (``RUN``) of 7 to 19 digits; the tokens inside it do not count a second time as
mentions, and are reported only if the run is not.
A mention induces up to five lexical patterns from its neighbours: the two words before it, the word before it, the two
words after it, the word after it, and the words on both sides. Words are lower-cased, without marks at their ends, digits
shown as 0; the start and end of the text and another mention count as words of their own in the two-word
patterns. A word is compared by its ``context_chars`` characters nearest to the mention. All but the
first kind are general and need ``min_variety`` different words beyond them around seeds, or they are not used.
Mentions form a bipartite graph pattern - instance, which is scored in rounds until no pattern becomes
trusted and no score moves by more than ``tolerance`` (``rounds`` is a guard: reaching it is a warning):

    score(pattern, kind)  = sum of confidence(instance, kind) over its mentions / (mentions + 1)
    confidence(instance, kind) = 1 for seeds, else 1 - prod(1 - score) over its trusted patterns

A pattern is trusted with a score of ``min_score`` and ``min_support`` distinct confident
instances. After the last round, mentions in trusted patterns whose instance reaches
``min_confidence`` and whose shape fits the kind are added as spans of that kind.
All of it is grouped counts and joins on pre-aggregated (pattern, instance) edges; hot
patterns shrink to one row per distinct instance before they meet.

Matching is native: ``regexp_extract_all`` gives the matches, the pieces between them
(``split`` by the same regex) their positions. Quantifiers are possessive and runs are entered
only at their start, so long digit or letter runs cost linear time and no stack.

Defined results: null and empty text have no spans. Positions are code points, end
exclusive. Rows that repeat an id are judged one by one; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import functools
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.llm.text import ascii_lower, let, prefix_sums
from shopfloor.session import materialize

KINDS = ("email", "ip", "card", "phone")

# Each regex finds what its plain form in the comment finds, leftmost and non-overlapping.
# A run can only be entered at its start or where the previous match ended (\G).
REGEX = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 13 to 19 digits: a maximal run, so its length can be asked for here
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": "@", "phone": "+"}
MENTION = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"

# Digit groups joined by single spaces, dots, hyphens, slashes and parentheses; a group ends at no letter.
RUN = (r"(?<![\p{L}0-9_@])(?:\((?=\+?[0-9]++\)))?+\+?+[0-9]++(?![\p{L}_@])"
       r"(?:(?:\)[\x20./-]?+\(?+|[\x20./-]\(?+|\()[0-9]++(?![\p{L}_@]))++")
RUN_DIGITS = (7, 19)


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 50
    tolerance: float = 1e-3
    context_chars: int = 80
    min_score: float = 0.6
    min_support: int = 3
    min_variety: int = 3
    min_confidence: float = 0.6


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True when a string of digits passes the Luhn check."""
    d = F.reverse(F.transform(F.split(digits, ""), lambda c: c.cast("int")))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a base match passes the check of its kind."""
    d = _digits(value)
    if kind == "card":
        return F.length(d).between(13, 19) & luhn(d)
    if kind == "phone":
        return F.length(d).between(9, 15)
    if kind == "email":
        return F.lit(True)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def raw_matches(df: DataFrame, id_col: str, text_col: str, p: Bootstrap) -> DataFrame:
    """(id, row, and for each kind, for mentions and for spaced digit runs: values, and the length, last and
    first words of every piece between them), from one pass over the texts. Only texts that can match pay for a regex."""
    def words(part: Column) -> Column:
        bare = F.transform(F.split(ascii_lower(part), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(
            F.regexp_replace(w, r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}]++$", ""), "[0-9]", "0"))
        return F.filter(bare, lambda w: w != "")

    def tail(piece: Column) -> Column:
        return let(words(F.right(piece, F.lit(p.context_chars))), lambda w: F.slice(w, F.greatest(F.size(w) - 2, F.lit(0)) + 1, 2))

    def head(piece: Column) -> Column:
        return F.slice(words(F.left(piece, F.lit(p.context_chars))), 1, 2)

    out = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    cols = []
    for name, rx in {**REGEX, "mention": MENTION, "run": RUN}.items():
        maybe = F.col("t").contains(HINT[name]) if name in HINT else F.col("t").rlike("[0-9@]")
        values = F.when(maybe, F.regexp_extract_all("t", F.lit(rx), 0))
        pieces = F.when(maybe, F.split("t", rx, -1))
        cols += [values.alias(f"{name}_v"), F.transform(pieces, lambda x: F.struct(
            F.length(x).alias("len"), tail(x).alias("tail"), head(x).alias("head"))).alias(f"{name}_p")]
    return out.select("id", "row", *cols)


def _span(k: int, n: Column, z: Column, i: Column) -> Column:
    """Match i of n with its position and neighbours."""
    left = F.concat(F.array(F.when(i == 0, "^").otherwise("#")), z["p"]["tail"])
    right = F.concat(z["q"]["head"], F.array(F.when(i == n - 1, "$").otherwise("#")))
    return F.struct(F.lit(k).alias("k"), z["s"].alias("start"), (z["s"] + F.length(z["v"])).alias("end"), z["v"].alias("value"),
                    F.slice(left, F.greatest(F.size(left) - 1, F.lit(1)), 2).alias("left"), F.slice(right, 1, 2).alias("right"))


def induced(left: Column, right: Column) -> Column:
    """Array of (ctx, beyond): the patterns of a mention, and for general ones the word beyond them."""
    def word(x: Column) -> Column:
        return F.when(~x.isin("^", "$", "#"), x)

    before, far = F.element_at(left, -1), F.when(F.size(left) == 2, F.get(left, 0))
    after, beyond = F.get(right, 0), F.get(right, 1)
    patterns = [("l2", F.concat_ws(" ", far, before), F.lit("")), ("l1", word(before), far), ("r2", F.concat_ws(" ", after, beyond), before),
                ("r1", word(after), before), ("b", F.concat(word(before), F.lit(" _ "), word(after)), far)]
    both = {"l2": F.size(left) == 2, "r2": F.size(right) == 2}
    made = F.array(*[F.when(text.isNotNull() & both.get(kind, F.lit(True)), F.struct(
        F.concat(F.lit(f"{kind} "), text).alias("ctx"), F.coalesce(other, F.lit("")).alias("beyond"))) for kind, text, other in patterns])
    return F.filter(made, lambda x: x.isNotNull())


def located(matches: DataFrame) -> DataFrame:
    """(id, row, spans): spans = array of (kind no, start, end, value, left, right) of all base
    matches that pass their check, and mentions as kind no 4, spaced digit runs as kind no 5. left and right: the two
    words on either side, ^ and $ for the ends of the text, # for the match before or after."""
    df = matches
    names = [*KINDS, "mention", "run"]
    for name in names:  # piece and match lengths alternate: p0 m0 p1 m1 ... p_n
        lens = F.flatten(F.transform(f"{name}_p", lambda x, i: F.array(
            x["len"].cast("long"), F.coalesce(F.length(F.get(F.col(f"{name}_v"), i)), F.lit(0)).cast("long"))))
        df = df.withColumn(f"{name}_l", lens)
    df = df.select("id", "row", *[f"{n}_{c}" for n in names for c in "vpl"])
    spans = []
    for k, name in enumerate(names):
        at = prefix_sums(F.col(f"{name}_l"))
        found = F.transform(F.arrays_zip(
            F.col(f"{name}_v").alias("v"), F.slice(f"{name}_p", 1, F.size(f"{name}_v")).alias("p"),
            F.slice(f"{name}_p", 2, F.size(f"{name}_v")).alias("q"), F.filter(at, lambda _, i: i % 2 == 1).alias("s")),
            functools.partial(_span, k, F.size(f"{name}_v")))
        found = F.filter(found, lambda s: s["value"].isNotNull())
        if name in KINDS:
            check = functools.partial(valid, name)
            found = F.filter(found, lambda s: check(s["value"]))
        if name == "run":
            found = F.filter(found, lambda s: s["value"].contains(" ") & F.length(_digits(s["value"])).between(*RUN_DIGITS))
        spans.append(F.coalesce(found, F.array().cast(
            "array<struct<k:int,start:bigint,end:bigint,value:string,left:array<string>,right:array<string>>>")))
    return df.select("id", "row", F.concat(*spans[:-2]).alias("base"), F.concat(*spans[-2:]).alias("mentions"))


def free_mentions(found: DataFrame) -> DataFrame:
    """(row, m, home): mentions and runs that overlap no base span of their text; home = start of the run
    that a mention overlaps, or of the run itself. Where a text has base spans or runs, one sweep over the starts
    compares each mention with the furthest end before it and the nearest start after it."""
    run_k = len(KINDS) + 1
    no_home = F.lit(None).cast("long").alias("home")
    plain = (F.size("base") == 0) & ~F.exists("mentions", lambda m: m["k"] == run_k)
    alone = found.where(plain).select("row", F.explode("mentions").alias("m")).select("row", "m", no_home)
    both = found.where(~plain & (F.size("mentions") > 0)) \
        .select("row", F.explode(F.concat("base", "mentions")).alias("m")) \
        .withColumn("is_base", F.col("m.k") < len(KINDS))

    def forth_of(first):
        return Window.partitionBy("row").orderBy("m.start", "m.end", first).rowsBetween(Window.unboundedPreceding, 0)

    def back_of(first):
        return Window.partitionBy("row").orderBy(F.desc("m.start"), F.desc("m.end"), first).rowsBetween(Window.unboundedPreceding, 0)

    forth, back = forth_of(F.desc("is_base")), back_of(F.desc("is_base"))
    swept = both.select("row", "m", "is_base", F.max(F.when(F.col("is_base"), F.col("m.end"))).over(forth).alias("behind"),
                        F.min(F.when(F.col("is_base"), F.col("m.start"))).over(back).alias("ahead"))
    clear = (F.coalesce("behind", F.lit(0)) <= F.col("m.start")) & (
        F.col("ahead").isNull() | (F.col("ahead") >= F.col("m.end")))
    free = swept.where(~F.col("is_base") & clear).select("row", "m", (F.col("m.k") == run_k).alias("is_run"))
    run = F.when(F.col("is_run"), F.struct("m.start", "m.end"))  # runs do not overlap each other
    homes = free.select("row", "m", "is_run", F.max(run).over(forth_of(F.desc("is_run"))).alias("before"),
                        F.min(run).over(back_of(F.desc("is_run"))).alias("next"))
    home = F.when(F.col("is_run"), F.col("m.start")).when(F.col("before.end") > F.col("m.start"), F.col("before.start")) \
        .when(F.col("next.start") < F.col("m.end"), F.col("next.start"))
    return alone.unionByName(homes.select("row", "m", home.alias("home")))


def bootstrap(mentions: DataFrame, p: Bootstrap) -> DataFrame:
    """Score the pattern-instance graph. mentions: (ctx, beyond, inst, kind no or null for unknown, weight).
    Returns (ctx, kind, inst, confidence) of the trusted pattern edges."""
    usable = mentions.where(F.col("kind").isNotNull()).select("ctx", "beyond").distinct().groupBy("ctx") \
        .agg(F.count(F.lit(1)).alias("variety")) \
        .where(F.col("ctx").startswith("l2 ") | (F.col("variety") >= p.min_variety)).select("ctx")
    counted = materialize(mentions.groupBy("ctx", "inst", "kind").agg(F.sum("weight").alias("n")), "pii-mentions")
    reached = counted.where(F.col("ctx").startswith("l2 ")).unionByName(
        counted.where(~F.col("ctx").startswith("l2 ")).join(materialize(usable, "pii-general"), "ctx", "left_semi"))
    edges = materialize(reached, "pii-edges")
    total = edges.groupBy("ctx").agg(F.sum("n").alias("total"))
    seeds = edges.where(F.col("kind").isNotNull()).select("inst", "kind").distinct() \
        .withColumn("confidence", F.lit(1.0))
    conf = seeds
    trusted = None
    for _ in range(p.rounds):
        before = trusted
        known = edges.select("ctx", "inst", "n").join(conf, "inst")
        score = known.groupBy("ctx", "kind").agg(F.sum(F.col("n") * F.col("confidence")).alias("mass"),
                                                 F.count(F.lit(1)).alias("support"))
        trusted = score.join(total, "ctx").select(
            "ctx", "kind", "support", (F.col("mass") / (F.col("total") + 1)).alias("score")) \
            .where((F.col("score") >= p.min_score) & (F.col("support") >= p.min_support)).checkpoint()
        unseen = edges.where(F.col("kind").isNull()).select("ctx", "inst").join(trusted, "ctx")
        found = unseen.groupBy("inst", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999)))))).alias("confidence"))
        conf = seeds.unionByName(found.join(seeds.select("inst", "kind"), ["inst", "kind"], "left_anti")).checkpoint()
        if before is None:
            moved = trusted.limit(1)
        else:  # scores only grow, so no pattern is lost
            old = before.select("ctx", "kind", F.col("score").alias("old"))
            moved = trusted.join(old, ["ctx", "kind"], "left") \
                .where(F.col("old").isNull() | (F.col("score") - F.col("old") > p.tolerance))
        if moved.isEmpty():
            break
    else:
        warnings.warn(f"pii: pattern scores still move after {p.rounds} rounds", RuntimeWarning, stacklevel=2)
    return trusted.select("ctx", "kind", "score").join(edges.where(F.col("kind").isNull()).select("ctx", "inst"), "ctx") \
        .join(conf, ["inst", "kind"]).where(F.col("confidence") >= p.min_confidence)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             params: Bootstrap = Bootstrap()) -> DataFrame:
    """One row per input row: ``id_col``, base and extra: arrays of (k, start, end, value),
    k = position of the kind in ``KINDS``; base sorted by kind and start."""
    matches = materialize(raw_matches(df, id_col, text_col, params), "pii-matches")
    found = materialize(located(matches), "pii-spans")
    is_run = F.col("m.k") == len(KINDS) + 1
    behind = F.regexp_replace("m.value", r"^[^\p{L}\p{N}+]++", "")
    core = F.when(is_run, F.col("m.value")).otherwise(F.regexp_replace(behind, r"[^\p{L}\p{N}]++$", ""))
    lead = F.when(is_run, 0).otherwise(F.length("m.value") - F.length(behind))
    loose = free_mentions(found).select(
        "row", (F.col("m.start") + lead).alias("start"), core.alias("value"),
        F.explode(induced(F.col("m.left"), F.col("m.right"))).alias("_p"), "home", is_run.alias("is_run")) \
        .withColumns({"ctx": F.col("_p.ctx"), "beyond": F.col("_p.beyond")}).drop("_p") \
        .where(F.col("value").rlike("[0-9@]"))
    seeds = found.select(F.explode("base").alias("m")).select(
        F.explode(induced(F.col("m.left"), F.col("m.right"))).alias("_p"), "m").select("_p.ctx", "_p.beyond", ascii_lower(F.col("m.value")).alias("inst"), F.col("m.k").alias("kind"),
        F.lit(1).alias("weight"))
    loose = loose.withColumn("inst", ascii_lower(F.col("value")))
    mentions = seeds.unionByName(loose.select("ctx", "beyond", "inst", F.lit(None).cast("int").alias("kind"),
                                                   F.when(F.col("is_run") | F.col("home").isNull(), 1).otherwise(0).alias("weight")))
    accepted = bootstrap(mentions, params)
    digits, kind = _digits(F.col("value")), F.col("kind")
    fits = F.when(kind == KINDS.index("email"), (F.length("value") >= 5) & (
        F.col("value").contains("@") | (F.length(digits) >= 2))) \
        .when(kind == KINDS.index("ip"), F.col("value").rlike(r"^[0-9a-fA-F.:]{7,}$")) \
        .when(kind == KINDS.index("card"), F.length(digits).between(12, 19)) \
        .otherwise(F.length(digits).between(7, 15))
    new = loose.join(accepted.select("ctx", "inst", "kind", "confidence"), ["ctx", "inst"]).where(fits & (~F.col("is_run") | kind.isin(KINDS.index("card"), KINDS.index("phone")))) \
        .groupBy("row", "start", "value", "home", "is_run").agg(F.max_by("kind", F.struct("confidence", -kind)).alias("k"))
    covered = F.max("is_run").over(Window.partitionBy("row", F.coalesce("home", -F.col("start") - 1)))
    new = new.withColumn("covered", covered).where(F.col("is_run") | ~F.col("covered"))
    extra = new.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "k", "start", (F.col("start") + F.length("value")).alias("end"), "value"))).alias("extra"))
    return found.join(extra, "row", "left").select(
        F.col("id").alias(id_col), "row",
        F.sort_array(F.transform("base", lambda s: F.struct(s["k"], s["start"], s["end"], s["value"]))).alias("base"),
        F.coalesce("extra", F.array().cast("array<struct<k:int,start:bigint,end:bigint,value:string>>")).alias("extra"))


def span_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == KINDS.index(kind))).cast("long")
