"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text may use ``lower`` (same result, faster);
    other text keeps its non-ASCII letters as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it (also
    inside lambdas, where a plain expression would be computed for every element)."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def prefix_sums(lengths: Column, block: int = 64) -> Column:
    """Exclusive running sums of an array of longs: totals of blocks of 64, then the offset
    inside the block, so long arrays stay near linear."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def blocks(all_: Column) -> Column:
        last = F.greatest(F.ceil(F.size(all_) / F.lit(block)).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(all_, b * block + 1, block)))

    def place(all_: Column, before: Column) -> Column:
        return F.transform(all_, lambda _, i: F.get(before, F.floor(i / block).cast("int"))
                           + total(F.slice(all_, F.floor(i / block).cast("int") * block + 1, i % block)))

    return let(lengths, lambda all_: let(blocks(all_), lambda sums: let(
        F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))), lambda before: place(all_, before))))
