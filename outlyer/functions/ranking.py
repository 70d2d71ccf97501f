"""Order over a whole table without one task that sees it all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlyer.functions.tables import written

#: Rows that one task numbers or sums.
BLOCK = 200_000
_PRIME = 2147483647


def _order(by: list[str]) -> list[Column]:
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c) for c in by]


def _dealt(df: DataFrame, by: list[str], block: int) -> DataFrame:
    """``df`` with ``__part``, that rises with the order of ``by``, and ``__at``, the 0-based place in its part.

    A part is a range of the whole order, and where rows are equal in it of their places in the table, so
    it holds about ``block`` rows whatever the values and their types. Tables of up to one block are one part.
    """
    n = df.count()
    if n <= block:
        one = Window.partitionBy("__part").orderBy(*_order(by))
        return df.withColumn("__part", F.lit(0).cast("long")).withColumn("__at", F.row_number().over(one).cast("long") - 1)
    order = [*_order(by), F.col("__tie")]
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n // block + 1, *order).sortWithinPartitions(*order).drop("__tie")
    # kept, as the next reading could cut the ranges elsewhere; the upper bits of this number are the task's, the lower 33 count its rows
    ranged = written(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranged")
    return ranged.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))


def row_numbers(df: DataFrame, by: list[str], out: str = "pos", block: int = BLOCK) -> DataFrame:
    """``df`` with its 0-based position in the order of ``by`` (``-name`` descends), which should end in a unique column."""
    cut = _dealt(df, by, block)
    along = Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__first"))  # a row a part
    return cut.join(F.broadcast(first), "__part").withColumn(out, F.col("__first") + F.col("__at")).drop("__part", "__at", "__first")


def running_sums(df: DataFrame, by: list[str], sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """``df`` with running sums over the whole table in the order of ``by``; ``sums`` maps names to what is summed."""
    cut = reduce(lambda d, kv: d.withColumn(f"__v_{kv[0]}", kv[1]), sums.items(), _dealt(df, by, block))
    along = Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("__part").agg(*(F.sum(f"__v_{k}").alias(f"__s_{k}") for k in sums))
    before = before.select("__part", *(F.coalesce(F.sum(f"__s_{k}").over(along), F.lit(0)).alias(f"__b_{k}") for k in sums))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(F.broadcast(before), "__part")
    for k in sums:
        out = out.withColumn(k, F.col(f"__b_{k}") + F.sum(f"__v_{k}").over(inside))
    return out.select(*df.columns, *sums)


def arithmetic_order(id_col: str, seed: int = 42) -> Column:
    """A repeatable pseudo-random key from an integer id, the same in every SQL engine."""
    return scrambled(F.col(id_col), seed)


def scrambled(n: Column, shift: int | Column = 0) -> Column:
    """(``n`` * 2654435761 + ``shift``) modulo 2147483647, factors reduced first so that no product passes 64 bits."""
    return F.pmod(F.pmod(n, F.lit(_PRIME)) * F.lit(2654435761 % _PRIME) + shift, F.lit(_PRIME))


def scrambled_pair(a: Column, b: Column, shift: int | Column = 0) -> Column:
    """:func:`scrambled` of ``a`` * 1000003 + ``b``."""
    return scrambled(F.pmod(a, F.lit(_PRIME)) * 1000003 + F.pmod(b, F.lit(_PRIME)), shift)
