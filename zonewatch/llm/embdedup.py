"""Embedding near-dedup: PCA-ordered tiled comparison, exact.

Equal vectors are one class first, so that copies cost nothing below. Classes are sorted by their unit
vectors' part along the first principal axis; blocks of at least `block` rows of that order (and at
most MAX_BLOCKS blocks, whatever the input) meet in tiles, and two blocks whose ranges on that axis
are too far apart for the threshold never meet. A tile gets vectors as they came (floats stay floats)
and turns them to the principal axes itself. The products of the leading dimensions come first. What
the rest can add is at most the product of the two suffix norms; a pair that can't reach the threshold
any more is out, and only the others go on to the next dimensions. What is left is decided by the
cosine of the original vectors in double precision. A tile returns a row a vector: its links there,
and the smallest id of its component there. Pairs are never written out.

A vector that is null, zero, holds a null or non-finite component, or has a null id links with nothing
and is kept. Only vectors of one length are compared. Rows that repeat an id and its vector are one vector
and link with what it links with, not with each other; an id with several vectors names several
vectors, each with links and a component of its own. An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, hot_keys, lookup, ranked, save
from .vectors import by_length, stack, valid


#: Blocks at most, so a bounded table of them is broadcast and a vector is sent to a bounded number of tiles.
MAX_BLOCKS = 20_000


def _rows(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(batches):
    import pyarrow as pa

    total = None
    for b in batches:
        if b.num_rows:
            u = _units(_rows(b.column("v")))
            total = u.T @ u if total is None else total + u.T @ u
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])


def _along(shared):
    def along(batches):
        import pyarrow as pa

        axis = shared.value[:, 0]
        for b in batches:
            if b.num_rows:
                x = _rows(b.column("v"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("number"), b.column("weight"), pa.array(_units(x) @ axis), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["number", "weight", "first", "x"])
    return along


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component under the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


class _Side:
    """Vectors of one side of a tile: the originals, unit vectors on the principal axes, suffix norms."""

    def __init__(self, x: np.ndarray, axes: np.ndarray, steps: list[int]):
        self.x = _units(x)
        self.y = self.x @ axes
        self.lead = self.y[:, :steps[0]].astype(np.float32)
        self.tails = [np.sqrt((self.y[:, k:] ** 2).sum(axis=1)) for k in steps]


def _linked(a: _Side, ai: np.ndarray, b: _Side, bi: np.ndarray, threshold: float, steps: list[int]):
    """Places in ai and bi of the pairs of rows whose cosine reaches the threshold."""
    rough, slack = 1e-5, 1e-9  # of single and of double precision
    sums = a.lead[ai] @ b.lead[bi].T
    r, c = np.nonzero(sums + np.outer(a.tails[0][ai], b.tails[0][bi]).astype(np.float32) >= threshold - rough)
    if len(r) > sums.size // 8:  # most remain: the whole product is cheaper
        whole = a.y[ai] @ b.y[bi].T
        r, c = np.nonzero(whole >= threshold - slack)
        sure = whole[r, c] > threshold + slack
    else:
        s = np.zeros(len(r))
        for i, (low, high) in enumerate(zip([0, *steps[:-1]], steps)):
            s = s + np.einsum("ij,ij->i", a.y[ai[r], low:high], b.y[bi[c], low:high])
            keep = s + a.tails[i][ai[r]] * b.tails[i][bi[c]] >= threshold - slack
            r, c, s = r[keep], c[keep], s[keep]
        sure = np.zeros(len(r), bool)
    check = np.flatnonzero(~sure)
    sure[check] = np.einsum("ij,ij->i", a.x[ai[r[check]]], b.x[bi[c[check]]]) >= threshold
    return r[sure], c[sure]


def _tile(threshold: float, shared, kind, size: int = 1024):
    def tile(p: pd.DataFrame) -> pd.DataFrame:
        axes = shared.value
        p = p.sort_values(["rep", "side"]).reset_index(drop=True)
        same = p["i"].iloc[0] == p["j"].iloc[0]
        side, weight, n, d = p["side"].to_numpy(), p["weight"].to_numpy(), len(p), len(axes)
        steps = sorted({min(d, max(4, d // 4)), min(d, max(4, d // 2))})
        rows = _Side(stack(p["x"], kind), axes, steps)
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        links, ea, eb = np.zeros(n, np.int64), [], []
        for u in range(0, len(left), size):
            for v in range(u if same else 0, len(right), size):
                x, z = left[u:u + size], right[v:v + size]
                r, c = _linked(rows, x, rows, z, threshold, steps)
                r, c = x[r], z[c]
                if same and u == v:
                    apart = r != c
                    r, c = r[apart], c[apart]
                    links += np.bincount(r, weights=weight[c], minlength=n).astype(np.int64)
                else:
                    links += np.bincount(r, weights=weight[c], minlength=n).astype(np.int64)
                    links += np.bincount(c, weights=weight[r], minlength=n).astype(np.int64)
                if len(r):
                    label = local_labels(n, r, c)
                    moved = np.flatnonzero(label != np.arange(n))
                    ea.append(moved)
                    eb.append(label[moved])
        label = local_labels(n, np.concatenate(ea), np.concatenate(eb)) if ea else np.arange(n)
        out = pd.DataFrame({"id": p["rep"], "links": links, "label": p["rep"].to_numpy()[label]})
        return out[links > 0]
    return tile


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding",
                    block: int = 8192) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: links are cosines of at least `threshold`."""
    usable = valid(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("given")), "id", "given")
    rows = save(usable.where(F.exists("v", lambda x: x != 0)).distinct(), "vectors")
    found = None
    for part in by_length(rows):
        links = _links(part, threshold, block)
        found = links if found is None or links is None else found.unionByName(links)
    given = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast(rows.schema["v"].dataType).alias("v"))
    if found is None:
        out = given.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    else:
        out = (given.join(found, ["id", "v"], "left")
               .select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _links(rows: DataFrame, threshold: float, block: int) -> DataFrame | None:
    """(id, v, links, component) of distinct (id, v), all of one length. Inside, a class of equal vectors
    goes by a number and by its rank on the first axis, so that an id with several vectors is several classes."""
    spark = rows.sparkSession
    classes = save(rows.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("weight")).withColumn("number", F.monotonically_increasing_id()), "classes")
    moments = classes.select("v").mapInArrow(_moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    if not len(moments):
        return None
    d = int(moments["i"].max()) + 1
    matrix = np.zeros((d, d))
    matrix[moments["i"], moments["j"]] = moments["s"]  # length x length numbers
    axes = spark.sparkContext.broadcast(np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1].copy())
    turned = classes.select("v", "number", "weight").mapInArrow(_along(axes), "number long, weight long, first double, x binary")
    block = max(block, -(-classes.count() // MAX_BLOCKS))
    blocked = save(ranked(turned, "first", "number").withColumnRenamed("rank", "rep").withColumn("i", F.expr(f"int(rep div {block})")), "turned")
    # a block's rows lie between two angles on the first axis; further than arccos(threshold) apart nothing links
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("first"))))
    spans = sorted((r["i"], r["low"], r["high"]) for r in blocked.groupBy("i").agg(F.min(angle).alias("low"), F.max(angle).alias("high")).collect())
    names, low, high = (np.array(x) for x in zip(*spans))
    # angles fall as the rank grows, so block i meets the blocks i .. last, and is met by since .. i
    last = np.maximum.accumulate(np.searchsorted(-high, -(low - float(np.arccos(threshold)) - 1e-6), "right") - 1)
    last = np.maximum(last, np.arange(len(names)))
    since = np.minimum(np.searchsorted(last, np.arange(len(names))), np.arange(len(names)))
    reach = spark.createDataFrame([(int(i), int(x), int(y)) for i, x, y in zip(names, last, since)], "i int, last int, since int")
    spread = blocked.select("i", "rep", "weight", "x").join(F.broadcast(reach), "i")  # a row a block
    left = spread.select(F.col("i"), F.explode(F.expr("sequence(i, last)")).alias("j"), F.lit(0).alias("side"), "rep", "weight", "x")
    right = spread.where("since < i").select(F.explode(F.expr("sequence(since, i - 1)")).alias("i"), F.col("i").alias("j"),
                                             F.lit(1).alias("side"), "rep", "weight", "x")
    dtype = "<f4" if classes.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    found = save(left.unionByName(right).groupBy("i", "j").applyInPandas(_tile(threshold, axes, dtype), "id long, links long, label long"), "links")
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(found.where("id <> label"), "id", "label").withColumnRenamed("node", "rep")
    per_class = save(blocked.select("rep", "number", "weight").join(links, "rep", "left").join(groups, "rep", "left")
                     .join(classes.select("number", "least"), "number").select(
        "number", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("group")), "groups")
    smallest = per_class.groupBy("group").agg(F.min("least").alias("component"))
    named = lookup(per_class.drop("least"), smallest, "group", hot_keys(per_class, "group"))
    return rows.join(classes.select("v", "number"), "v").join(named, "number").select("id", "v", "links", "component")
