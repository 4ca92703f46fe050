"""Running values along a sort order, for keys of any size.

``laid_out``   the rows in sort order, in parts of bounded size, staged
``laid_by_key``  the same where keys are many, and left in place unless a key is longer than a part
``running``    running sums and maxima per key along that order
``previous``   values of the row before, per key
``positions``  the gapless number of each row in the whole order

A key with a third of all rows spreads over many parts: values run inside a part, and what a part takes over from those before it
is added from a table with one row a part. A key that ends inside its part needs nothing of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packaudit.session import stage

#: Rows of a part, about.
PART_ROWS = 200_000
#: Rows of the longest key that stays in one task.
KEY_ROWS = 50_000


def laid_out(df: DataFrame, keys: list[str], order: list[str], rows: int = PART_ROWS, settled: bool = False) -> DataFrame:
    """``df`` sorted by keys and order, staged, with ``_at`` (ascending along the sort) and ``_part``.

    Rows that agree in all of keys and order may come in any order and share a part, so ``order`` should tell rows apart. The sort reads its
    input three times (number, cut points, rows), so it is staged first unless it is ``settled``, that is, cheap to read again.
    """
    staged = df if settled else stage(df, "unsorted")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), staged.count() // rows + 1)
    by = [*keys, *order]
    return stage(staged.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("*", F.monotonically_increasing_id().alias("_at"))
                 .withColumn("_part", F.shiftright("_at", 33).cast("int")), "sorted")


def laid_by_key(df: DataFrame, keys: list[str], order: list[str], rows: int = KEY_ROWS) -> DataFrame:
    """``laid_out`` for ``running`` and ``previous`` where keys are many: only if one has more than ``rows`` rows is all of it sorted by range.

    Otherwise a key is its own part and nothing is written or dealt out anew: ``df`` stays where it lies if it is dealt out by some of the keys,
    and ``_at`` is the order itself, so nothing is carried from part to part.
    """
    if df.groupBy(*keys).count().where(F.col("count") > rows).limit(1).count():
        return laid_out(df, keys, order)
    return df.select("*", F.struct(*order).alias("_at"), F.lit(0).alias("_part"))


def whole(laid: DataFrame) -> bool:
    """Each key lies in one part."""
    return isinstance(laid.schema["_at"].dataType, T.StructType)


def by_part(laid: DataFrame, keys: list[str]) -> list[str]:
    """What the rows of a key in one part agree in; a key that is its own part needs no part beside it, and rows dealt out by some of the keys stay."""
    return keys if whole(laid) else ["_part", *keys]


def _carried(laid: DataFrame, keys: list[str], totals: dict[str, Column], taken: dict[str, Column]) -> DataFrame:
    """``taken`` over the ``totals`` of a key's earlier parts, for every (key, part) but a key's first.

    In sort order at most one key reaches into a part from those before it, so there is a row a part at most.
    """
    order = W.partitionBy(*keys).orderBy("_part")
    each = laid.groupBy(*keys, "_part").agg(*[c.alias(n) for n, c in totals.items()]).withColumn("_i", F.row_number().over(order))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return each.select(*keys, "_part", "_i", *[c.over(before).alias(f"_c_{n}") for n, c in taken.items()]).where("_i > 1").drop("_i")


def running(laid: DataFrame, keys: list[str], sums: dict[str, Column] | None = None, highs: dict[str, Column] | None = None,
            strict: bool = False) -> DataFrame:
    """Add the running sums and maxima, the row itself included, or left out if ``strict``. Keys and summed columns must not be null.

    Before a key's first row a strict sum is 0 and a strict maximum null.
    """
    sums, highs = sums or {}, highs or {}
    folds = {**{n: (F.sum, c) for n, c in sums.items()}, **{n: (F.max, c) for n, c in highs.items()}}
    here = W.partitionBy(*by_part(laid, keys)).orderBy("_at").rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    local = laid.select("*", *[f(c).over(here).alias(n) for n, (f, c) in folds.items()])
    if whole(laid):
        return local.select(*laid.columns, *[F.coalesce(n, F.lit(0)).alias(n) if n in sums else F.col(n) for n in folds])
    carried = _carried(laid, keys, {n: f(c) for n, (f, c) in folds.items()}, {n: f(n) for n, (f, _) in folds.items()})
    out = local.join(F.broadcast(carried), [*keys, "_part"], "left")
    taken = ({n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
             | {n: F.greatest(n, f"_c_{n}") for n in highs})
    return out.select(*laid.columns, *[c.alias(n) for n, c in taken.items()])


def previous(laid: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Add the values of the row before; null at a key's first row. The values must not be null."""
    here = W.partitionBy(*by_part(laid, keys)).orderBy("_at")
    local = laid.select("*", *[F.lag(c).over(here).alias(n) for n, c in values.items()])
    if whole(laid):
        return local
    carried = _carried(laid, keys, {n: F.max_by(c, "_at") for n, c in values.items()}, {n: F.last(n) for n in values})
    out = local.join(F.broadcast(carried), [*keys, "_part"], "left")
    return out.select(*laid.columns, *[F.coalesce(n, f"_c_{n}").alias(n) for n in values])


def positions(laid: DataFrame, name: str) -> DataFrame:
    """Add the number of each row in the whole order, from 0."""
    counts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # One row a part.
    begin = counts.select("_part", "_first", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_begin"))
    return (laid.join(F.broadcast(begin), "_part").withColumn(name, F.col("_begin") + F.col("_at") - F.col("_first"))
            .select(*laid.columns, name))
