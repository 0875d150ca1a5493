"""Joins that no hot key can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.runtime import materialize

#: A key with more than this share of the rows is hot, so fewer than PARTS keys are.
PARTS = 512
#: A key with fewer rows than this is never hot.
LEAST = 1000


def weighed(df: DataFrame, weight: str, name: str) -> tuple[DataFrame, tuple[int, int]]:
    """df as a written table, and the sum and maximum of a column, observed while it is written."""
    seen = Observation()
    table = materialize(df.observe(seen, F.sum(weight).alias("total"), F.max(weight).alias("most")), name)
    got = seen.get
    return table, (int(got["total"] or 0), int(got["most"] or 0))


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner", known: tuple[int, int] | None = None) -> DataFrame:
    """left joined with right (one row for each key), where right's column `weight` counts left's rows of a key; the column goes.

    Rows of hot keys stay where they are and meet the fewer than PARTS rows of right
    in a broadcast; all others meet in a shuffle on the keys, at every size, so that
    plans don't change as tables grow.  Both sides may be read twice, so they should
    be written tables.  `known` is the sum and the maximum of the weights (`weighed`),
    which spares a job.  Null keys match nothing; `how` is inner, left or left_semi.
    """
    spark = left.sparkSession
    if known is None:
        known = tuple(x or 0 for x in right.agg(F.sum(weight), F.max(weight)).first())
    total, most = known
    least = max(LEAST, total // PARTS)
    hot = right.where(F.col(weight) > least).collect() if most > least else []  # fewer than PARTS rows
    if not hot:
        return left.join(right.drop(weight).hint("merge"), keys, how)
    cold = right.where(F.col(weight) <= least).drop(weight).hint("merge")
    table = spark.createDataFrame(hot, right.schema).drop(weight)
    here = left.join(F.broadcast(table), keys, "left_semi" if how == "left_semi" else "inner")
    there = left.join(F.broadcast(table.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return here.unionByName(there)
