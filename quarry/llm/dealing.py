"""Groups too large for one task, dealt as pairs of blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Tables

LEAST, TIMES, SHARES = 128, 4, 8


def dealt(rows: DataFrame, key: str, large: DataFrame, many: int) -> DataFrame:
    """rows with unit, side and same: groups in ``large`` (key, blocks) as pairs of blocks, each a unit, the others whole.

    Members of one block (same) are compared with each other, those of two blocks with the other side only.
    """
    kept = [c for c in rows.columns if c != key]
    if not many:
        return rows.select(key, F.xxhash64(key).alias("unit"), F.lit(0).alias("side"), F.lit(True).alias("same"), *kept)
    rows = rows.join(F.broadcast(large) if many <= 10_000 else large, key, "left")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.xxhash64(key, F.least(own, j), F.greatest(own, j)).alias("unit"), (own > j).cast("int").alias("side"), (own == j).alias("same")),
    )
    alone = F.array(F.struct(F.xxhash64(key).alias("unit"), F.lit(0).alias("side"), F.lit(True).alias("same")))
    return rows.select(key, F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(pairs)).alias("u"), *kept).select(key, "u.*", *kept)


def large_groups(tables: Tables, rows: DataFrame, key: str, block: int, name: str) -> tuple[DataFrame, int]:
    """The groups (key, blocks) of several blocks, and how many there are.

    Groups of over ``LEAST`` rows that are also over ``TIMES`` the mean have up to ``SHARES`` blocks, so that no task gets
    far more than others; larger groups as many as ``block`` rows in each make.
    """
    counts = tables.keep(rows.groupBy(key).agg(F.count(F.lit(1)).alias("k")), f"{name}-counts")
    mean = counts.agg(F.avg("k")).first()[0] or 0
    most = min(block, max(LEAST, math.ceil(TIMES * mean)))
    k = F.col("k")
    blocks = F.greatest(F.ceil(k / block), F.least(F.lit(SHARES), F.ceil(k / most)))
    large = tables.keep(counts.where(k > most).select(key, blocks.cast("int").alias("blocks")), name)
    return large, large.count()
