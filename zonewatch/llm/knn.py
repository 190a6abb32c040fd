"""Exact top-k search by inner product as a Voronoi join.

A bounded sample of the vectors are the pivots, as many as the root of the rows (64 at least, MAX_PIVOTS
at most); every vector belongs to the cell of its nearest one. Inside a cell the members lie in order of
their distance from the pivot, cut into rings of `block` rows. A cell's summary has the distances of its
k + 1 nearest members, a ring's its outer radius (MAX_RINGS rings at most and one a pivot, whatever the input). For a
query q and a member x of the cell of pivot p, q.x lies within |q| * |x - p| of q.p: the summaries' lower
bounds give each query a score that its k-th neighbour reaches at least, and only rings whose upper bound
reaches it are needed. Queries are replicated to just those rings, rings without queries drop out, and
a ring with many queries meets them in chunks, so that a cell with a third of all vectors is spread over
many tasks. Each tile keeps k rows a query; the k best of these are the result.

Components are floor(scale * x); scores are exact integers. Vectors that are null or hold a null
or non-finite component take no part. Only vectors of one length are compared. Each row is a vector of its
own: rows that repeat an id are each a candidate for the other ones, and each a query if the id is one.
Ties go to the smaller id. A query has fewer than k rows if fewer others exist; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, save
from .vectors import by_length, stack, valid

MAX_PIVOTS, MAX_RINGS = 1024, 20_000


def _assign(shared):
    def assign(batches):
        pivots = shared.value
        norms = (pivots ** 2).sum(axis=1)
        for p in batches:
            if not len(p):
                continue
            ints = np.array(p["v"].tolist(), np.int64)
            x = ints.astype(float)
            d2 = (x ** 2).sum(axis=1)[:, None] + norms - 2 * x @ pivots.T
            cell = d2.argmin(axis=1)
            away = np.linalg.norm(x - pivots[cell], axis=1)
            yield pd.DataFrame({"row": p["row"], "id": p["id"], "cell": cell, "away": away, "top": np.abs(ints).max(axis=1),
                                "v": [r.tobytes() for r in ints]})
    return assign


def _route(shared):
    def route(batches):
        pivots, near, owner, rings, radius = shared.value
        longest = np.linalg.norm(pivots, axis=1).max(initial=0) + radius.max(initial=0)
        for p in batches:
            if not len(p):
                continue
            q = stack(p["v"], np.int64).astype(float)
            norm, at = np.linalg.norm(q, axis=1)[:, None], q @ pivots.T
            low = np.full((len(q), near.shape[1]), -np.inf)  # the best of what some others reach at least
            for column in range(len(pivots)):
                known = np.where(np.isfinite(near[column]), at[:, column, None] - norm * np.where(np.isfinite(near[column]), near[column], 0), -np.inf)
                low = np.sort(np.concatenate([low, known], axis=1), axis=1)[:, -near.shape[1]:]
            reach = low[:, :1] - 1e-9 * (1 + norm * longest)  # k others at least score this much
            rows, cols = np.nonzero(at[:, owner] + norm * radius >= reach)
            yield pd.DataFrame({"row": p["row"].to_numpy()[rows], "id": p["id"].to_numpy()[rows], "ring": rings[cols], "v": p["v"].to_numpy()[rows]})
    return route


def _solve(k: int, exact_float: bool):
    def solve(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(members) and len(queries):
            members = members.sort_values(["id", "row"])
            ids, places, kind = members["id"].to_numpy(), members["row"].to_numpy(), float if exact_float else np.int64
            scores = stack(queries["v"], np.int64).astype(kind) @ stack(members["v"], np.int64).astype(kind).T
            for query, own, row in zip(queries["id"].to_numpy(), queries["row"].to_numpy(), scores):
                others = np.flatnonzero(places != own)
                row = row[others]
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    above = np.flatnonzero(row > least)
                    at = np.concatenate([above, np.flatnonzero(row == least)[:k - len(above)]])
                    row, others = row[at], others[at]
                out += [(own, query, places[i], ids[i], int(s)) for i, s in zip(others, row)]
        return pd.DataFrame(out, columns=["asks", "query_id", "row", "id", "score"])
    return solve


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 256, n_pivots: int | None = None, block: int = 4096, chunk: int = 2048) -> DataFrame:
    """(query_id, rank, id, score): `is_query` is a condition on the id, named `id`."""
    kind = df.schema[id_col].dataType.simpleString()
    ints = save(valid(df, id_col, vec_col).select(
        F.monotonically_increasing_id().alias("row"), "id", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v")), "vectors")
    out = df.sparkSession.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score long")
    for part in by_length(ints):
        found = _search(part, is_query, k, kind, n_pivots, block, chunk)
        out = out if found is None else out.unionByName(found)
    return out


def _search(ints: DataFrame, is_query: Column, k: int, kind: str, n_pivots: int | None, block: int, chunk: int) -> DataFrame | None:
    spark, n = ints.sparkSession, ints.count()
    if n_pivots is None:
        n_pivots = min(MAX_PIVOTS, max(64, int(n ** 0.5)))
    sample = ints.orderBy(F.xxhash64(F.lit("pivot"), "id"), "id", "row").limit(n_pivots).select("v").distinct().collect()
    if not sample:
        return None
    pivots = np.array([r["v"] for r in sample], float)
    dealt = ints.mapInPandas(_assign(spark.sparkContext.broadcast(pivots)), f"row long, id {kind}, cell int, away double, top long, v binary")
    rows = ranked(dealt, "cell", "away", "row")
    cells = {r["cell"]: r for r in rows.groupBy("cell").agg(F.min("rank").alias("first"), F.max("top").alias("top")).collect()}  # a row a pivot
    block = max(block, -(-n // MAX_RINGS))
    start = spark.createDataFrame([(c, r["first"]) for c, r in cells.items()], "cell int, first long")
    rows = save(rows.join(F.broadcast(start), "cell").withColumn("place", F.col("rank") - F.col("first"))
                .withColumn("ring", F.struct("cell", F.expr(f"int(place div {block})").alias("n"))), "cells")
    nearest = rows.where(F.col("place") <= k).select("cell", "away", "place").collect()  # k + 1 rows a cell
    rings = rows.groupBy("ring").agg(F.max("away").alias("radius")).collect()  # a row a ring
    order = {c: i for i, c in enumerate(sorted(cells))}
    near = np.full((len(order), k + 1), np.inf)
    for r in nearest:
        near[order[r["cell"]], r["place"]] = r["away"]
    names = spark.createDataFrame([(i, r["ring"]["cell"], r["ring"]["n"]) for i, r in enumerate(rings)], "ring int, cell int, n int")
    summary = (pivots[sorted(cells)], near, np.array([order[r["ring"]["cell"]] for r in rings]), np.arange(len(rings)), np.array([r["radius"] for r in rings]))
    routed = save(rows.where(is_query).select("row", "id", "v").mapInPandas(
        _route(spark.sparkContext.broadcast(summary)), f"row long, id {kind}, ring int, v binary"), "queries")
    chunks = routed.groupBy("ring").agg(F.expr(f"int(ceil(count(*) / {chunk}))").alias("chunks"))  # a row a ring
    members = (rows.select("row", "id", "v", "cell", F.col("ring.n").alias("n")).join(F.broadcast(names), ["cell", "n"]).join(F.broadcast(chunks), "ring")
               .select("row", "id", "v", "ring", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk")))
    queries = (routed.join(F.broadcast(chunks), "ring")
               .select("row", "id", "v", "ring", F.expr("int(pmod(xxhash64(row), chunks))").alias("chunk")))
    top = max(r["top"] for r in cells.values())
    found = members.groupBy("ring", "chunk").cogroup(queries.groupBy("ring", "chunk")).applyInPandas(
        _solve(k, top * top * pivots.shape[1] < 2 ** 53), f"asks long, query_id {kind}, row long, id {kind}, score long")
    best = F.row_number().over(Window.partitionBy("asks").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
