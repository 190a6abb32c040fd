"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to `bits` bits each by approximate quantiles over all rows
(a string counts by the rank of its whole value among all distinct ones), the cells are numbered
along a Hilbert curve, rows are sorted by that number and the order is cut into runs of equal count.
Rows of a shard are then close in every dimension at once, so that file statistics prune by any of
them.

Within a cell rows go by the given ties (for documents: a hash of the text, so that equal texts lie
side by side, then size and id): a cell or a group of copies that holds a third of all rows is spread
over as many tasks and shards as its size takes. Nulls share the lowest cell of their dimension.
Repeated rows each get a place; an empty table gives no rows. Columns beside the dimensions and ties
are carried as they are; those named curve, shard, slot or
rank are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, hot_keys, lookup, quoted, ranked, save


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each column of `cells` (dimensions x points)."""
    x = cells.astype(np.int64).copy()
    top = 1 << bits - 1
    q = top
    while q > 1:  # undo the excess rotations
        low = q - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            out = out << 1 | row >> b & 1
    return out


def with_curve(df: DataFrame, dimensions: list[str], bits: int = 4, accuracy: int = 10_000) -> DataFrame:
    """df with `curve`, its cell's position along the Hilbert curve of the quantised dimensions."""
    df = df.drop("curve") if "curve" not in dimensions else df
    row, numbers = fresh(df, "row"), [fresh(df, f"number{i}") for i in range(len(dimensions))]
    rows = df.select(F.struct("*").alias(row), *(
        (quoted(d) if df.schema[d].dataType.simpleString() == "string" else quoted(d).cast("double")).alias(n) for d, n in zip(dimensions, numbers)))
    for n in numbers:
        if rows.schema[n].dataType.simpleString() == "string":
            ranks = ranked(rows.select(n).where(F.col(n).isNotNull()).distinct(), n)
            rows = lookup(rows, ranks, n, hot_keys(rows, n)).drop(n).withColumnRenamed("rank", n).withColumn(n, F.col(n).cast("double"))
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = rows.agg(*(F.percentile_approx(n, steps, accuracy).alias(n) for n in numbers)).first()
    cells = [F.coalesce(sum((F.col(n) >= F.lit(float(cut))).cast("int") for cut in sorted({*(cuts[n] or [0.0])})), F.lit(0)) for n in numbers]

    @F.pandas_udf("long")
    def position(*columns: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.stack([c.to_numpy() for c in columns]), bits))

    return rows.select(f"{row}.*", position(*cells).alias("curve"))


def shard(df: DataFrame, dimensions: list[str], n_shards: int, *ties: str, bits: int = 4) -> DataFrame:
    """df with curve, shard (0 to n_shards - 1) and slot (gapless from 0): counts at most one apart."""
    df = save(df.drop("shard", "slot", "rank"), "unsharded")
    rows = ranked(save(with_curve(df, dimensions, bits), "curve"), "curve", *ties)
    total = max(1, rows.count())
    first = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return (rows.withColumn("shard", F.expr(f"int(rank * {n_shards} div {total})")).withColumn("slot", F.col("rank") - first).drop("rank"))


def write(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in the order of their slots."""
    (sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
