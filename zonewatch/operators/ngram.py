"""A character n-gram model of each TLD, trained on the names themselves.

Counts are (tld, ngram, cnt); statistics are (tld, order, total_ngrams, vocab_size, sample_count,
mean_log_prob, std_log_prob). Labels are scored in one pass over them where the counts are known to be few
(n-grams of up to three code points, packed into integers and looked up by arrays); else by a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import label_of
from .diff import REMOVED

PAD = "^"
CALIBRATION = 50_000
#: Counts of at most so many n-grams are broadcast, where the caller knows how many there are.
BROADCAST_NGRAMS = 500_000


def ngrams(label: Column, order: int = 3) -> Column:
    """All n-grams of the padded label; none for the empty label at order 1."""
    edge = F.lit(PAD * (order - 1))
    padded, n = F.concat(edge, label, edge), F.length(label) + F.lit(order - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(padded, i, F.lit(order)))).otherwise(
        F.array().cast("array<string>"))


def count(labels: DataFrame, order: int = 3) -> DataFrame:
    """Counts of (label, tld). Partial aggregation before the shuffle takes the weight off common n-grams."""
    return tally(labels, order).where("ngram IS NOT NULL")


def tally(labels: DataFrame, order: int = 3) -> DataFrame:
    """Counts, and beside them, under a null n-gram, how many labels each TLD has: one pass for both."""
    marked = F.array_append(ngrams(F.col("label"), order), F.lit(None).cast("string"))
    return labels.select("tld", F.explode(marked).alias("ngram")).groupBy("tld", "ngram").agg(F.count("*").alias("cnt"))


def sizes_of(tallied: DataFrame, order: int = 3) -> DataFrame:
    """The statistics of a tally, but for its calibration. A TLD without an n-gram has none."""
    gram = F.col("ngram").isNotNull()
    return (tallied.groupBy("tld").agg(F.sum(F.when(gram, F.col("cnt"))).alias("total_ngrams"), F.count_if(gram).alias("vocab_size"),
                                       F.sum(F.when(~gram, F.col("cnt"))).alias("sample_count"))
            .where("vocab_size > 0").select("tld", F.lit(order).alias("order"), "total_ngrams", "vocab_size", "sample_count"))


def apply_events(tallied: DataFrame, events: DataFrame, order: int = 3) -> DataFrame:
    """A tally after events (name, tld, event_type): names that came in add their n-grams, those removed take
    theirs back. Only the events' names are read, not the zone."""
    sign = F.when(F.col("event_type") == REMOVED, -1).otherwise(1)
    marked = F.array_append(ngrams(label_of(F.col("name")), order), F.lit(None).cast("string"))
    change = (events.select("tld", sign.alias("sign"), F.explode(marked).alias("ngram")).groupBy("tld", "ngram").agg(F.sum("sign").cast("long").alias("cnt")))
    return tallied.unionByName(change).groupBy("tld", "ngram").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def merge(*parts: DataFrame) -> DataFrame:
    """Counts of several batches as one."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("tld", "ngram").agg(F.sum("cnt").alias("cnt"))


def vocabulary(sizes: DataFrame) -> int:
    """How many n-grams the counts of these statistics (a row a TLD) have."""
    return sizes.agg(F.sum("vocab_size")).first()[0] or 0


def _packed(counts: DataFrame, sizes: DataFrame, order: int) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """Of each TLD its n-grams as sorted integers, their log-probabilities, and that of an unknown one."""
    mass = {r["tld"]: r["total_ngrams"] + r["vocab_size"] for r in sizes.select("tld", "total_ngrams", "vocab_size").collect()}
    rows, out = counts.select("tld", "ngram", "cnt").toPandas(), {}
    for tld, part in rows.groupby("tld"):
        if tld in mass:
            keys = _pack(np.frombuffer("".join(part["ngram"]).encode("utf-32-le"), "<u4").reshape(-1, order))
            by = np.argsort(keys)
            out[tld] = keys[by], np.log((part["cnt"].to_numpy()[by] + 1) / mass[tld]), -math.log(mass[tld])
    return out


def _pack(codes: np.ndarray) -> np.ndarray:
    """Rows of up to three code points as one integer each."""
    key = np.zeros(len(codes), np.int64)
    for column in codes.T:
        key = key << 21 | column.astype(np.int64)
    return key


def _means(labels: list[str], table: tuple[np.ndarray, np.ndarray, float], order: int) -> np.ndarray:
    """The mean log-probability of each label's n-grams, nan where it has none."""
    keys, known, unknown = table
    edge = PAD * (order - 1)
    sizes = np.array([len(x) + order - 1 for x in labels])
    codes = np.frombuffer("".join(f"{edge}{x}{edge}" for x in labels).encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.cumsum(sizes + order - 1) - sizes - (order - 1)
    at = np.repeat(begins, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = _pack(codes[at[:, None] + np.arange(order)])
    place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    logs = np.where(keys[place] == grams, known[place], unknown)
    owner = np.repeat(np.arange(len(labels)), sizes)
    with np.errstate(invalid="ignore"):
        return np.bincount(owner, weights=logs, minlength=len(labels)) / sizes


def scorer(counts: DataFrame, sizes: DataFrame, order: int = 3, vocab: int | None = None) -> Callable[[Column, Column], Column] | None:
    """(label, tld) to the mean log-probability as a column: one pass in Arrow batches, no explode and no
    shuffle; null without a model of the TLD. None if there are more n-grams than BROADCAST_NGRAMS, or if
    they are longer than three, for then they aren't integers."""
    vocab = vocabulary(sizes) if vocab is None else vocab
    if vocab > BROADCAST_NGRAMS or order > 3:
        return None
    shared = counts.sparkSession.sparkContext.broadcast(_packed(counts, sizes, order))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tables = shared.value
        for labels, tlds in batches:
            out, known = np.full(len(labels), np.nan), labels.notna().to_numpy()
            for tld, places in labels.groupby(tlds).indices.items():
                places = places[known[places]]
                if tld in tables and len(places):
                    out[places] = _means(labels.iloc[places].tolist(), tables[tld], order)
            yield pd.Series(out).astype(object).where(~np.isnan(out), None)

    return score


def avg_log_prob(labels: DataFrame, counts: DataFrame, sizes: DataFrame, order: int = 3, by: tuple[str, ...] = ("label", "tld"),
                 vocab: int | None = None) -> DataFrame:
    """`by`, which holds label and tld and names each row, and avg_log_prob, with add-one smoothing; null
    without a model of the TLD."""
    score = scorer(counts, sizes, order, vocab)
    if score is not None:
        return labels.select(*by, score(F.col("label"), F.col("tld")).alias("avg_log_prob"))
    rows = (labels.select(*by, F.explode_outer(ngrams(F.col("label"), order)).alias("ngram"))
            .join(counts.select("tld", "ngram", "cnt"), ["tld", "ngram"], "left")
            .join(F.broadcast(sizes.select("tld", (F.col("total_ngrams") + F.col("vocab_size")).alias("mass"))), "tld", "left"))  # a row a TLD
    log_prob = F.when(F.col("ngram").isNotNull(), F.log((F.coalesce("cnt", F.lit(0)) + 1) / F.col("mass")))
    return rows.groupBy(*by).agg(F.avg(log_prob).alias("avg_log_prob"))


def first_by_md5(labels: DataFrame, sizes: DataFrame, sample: int) -> DataFrame:
    """(label, tld, times): of each TLD the first `sample` labels in order of md5, all of a smaller one.

    Only labels whose md5 begins below a share of its range that holds enough of them are put in order;
    should a share hold too few, as with labels that repeat, it is doubled for that TLD."""
    place = F.conv(F.substring(F.md5("label"), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    spark = labels.sparkSession
    wanted = {r["tld"]: (min(sample, r["sample_count"]), r["sample_count"]) for r in sizes.select("tld", "sample_count").collect()}  # a row a TLD
    share = {tld: 1.0 if n <= sample else (want + 6 * want ** 0.5 + 10) / n for tld, (want, n) in wanted.items()}
    while True:
        limits = spark.createDataFrame([(tld, float(x)) for tld, x in share.items()], "tld string, share double")
        chosen = labels.select("label", "tld").join(F.broadcast(limits), "tld").where((place < F.col("share")) | (F.col("share") >= 1.0))
        found = {r["tld"]: r["n"] for r in chosen.groupBy("tld").agg(F.count("*").alias("n")).collect()}
        few = [tld for tld, (want, _) in wanted.items() if found.get(tld, 0) < want and share[tld] < 1]
        if not few:
            break
        share |= {tld: min(1.0, 2 * share[tld]) for tld in few}
    repeated = chosen.groupBy("label", "tld").agg(F.count("*").alias("times"))
    before = F.sum("times").over(Window.partitionBy("tld").orderBy(F.md5("label"), "label").rowsBetween(Window.unboundedPreceding, -1))
    times = F.least(F.col("times"), F.lit(sample) - F.coalesce("before", F.lit(0)))
    return repeated.withColumn("before", before).withColumn("times", times).where("times > 0").select("label", "tld", "times")


def calibrate(counts: DataFrame, sizes: DataFrame, labels: DataFrame, order: int = 3, sample: int = CALIBRATION, vocab: int | None = None) -> DataFrame:
    """sizes with mean and population deviation of the log-probability over a sample: all labels of a
    TLD with at most `sample`, else the first so many in order of md5. A deviation of exactly 0 counts
    as 1. Mean and deviation come from one pass of sums, about the log-probability of even n-grams."""
    chosen = first_by_md5(labels, sizes, sample)
    scored = avg_log_prob(chosen, counts, sizes, order, ("label", "tld", "times"), vocab).where("avg_log_prob IS NOT NULL")
    scored = scored.join(F.broadcast(sizes.select("tld", (-F.log("vocab_size")).alias("even"))), "tld")  # a row a TLD
    n, x = F.sum("times"), F.col("avg_log_prob") - F.col("even")
    mean = F.sum(x * F.col("times")) / n
    fit = scored.groupBy("tld").agg((mean + F.first("even")).alias("mean_log_prob"), F.sqrt(F.greatest(
        F.lit(0.0), F.sum(x * x * F.col("times")) / n - mean * mean)).alias("std"))
    return sizes.join(F.broadcast(fit), "tld", "left").select(
        *sizes.columns, F.coalesce("mean_log_prob", F.lit(0.0)).alias("mean_log_prob"),
        F.when(F.coalesce("std", F.lit(0.0)) == 0, 1.0).otherwise(F.col("std")).alias("std_log_prob"))


def build(labels: DataFrame, order: int = 3) -> tuple[DataFrame, DataFrame]:
    """(counts, statistics) of (label, tld)."""
    tallied = tally(labels, order)
    counts = tallied.where("ngram IS NOT NULL")
    return counts, calibrate(counts, sizes_of(tallied, order), labels, order)


def sigmoid(z: Column) -> Column:
    return F.when(z.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z)))))


def likelihood(labels: DataFrame, counts: DataFrame, stats: DataFrame, order: int = 3, vocab: int | None = None) -> DataFrame:
    """(label, tld, likelihood) of distinct (label, tld); 0.5 where the TLD has no model."""
    rows = labels.select("label", "tld").distinct()
    return _calibrated(avg_log_prob(rows, counts, stats, order, vocab=vocab), stats).select(
        "label", "tld", F.coalesce("likelihood", F.lit(0.5)).alias("likelihood"))


def _calibrated(scored: DataFrame, stats: DataFrame) -> DataFrame:
    """rows (tld, avg_log_prob, ...) with likelihood in place of it: null without a model of the TLD, 0.5
    for a label without an n-gram."""
    fit = stats.select("tld", F.col("mean_log_prob").alias("__mean"), F.col("std_log_prob").alias("__std"))
    z = (F.col("avg_log_prob") - F.col("__mean")) / F.greatest(F.col("__std"), F.lit(1e-9))
    likelihood = F.when(F.col("__std").isNotNull(), F.coalesce(sigmoid(z), F.lit(0.5)))
    return (scored.join(F.broadcast(fit), "tld", "left").withColumn("likelihood", likelihood)  # a row a TLD
            .drop("avg_log_prob", "__mean", "__std"))


def with_likelihood(rows: DataFrame, label: Column, counts: DataFrame, stats: DataFrame, order: int = 3) -> DataFrame:
    """rows (tld, ...) with the likelihood of their labels, null where the TLD has no model."""
    score = scorer(counts, stats, order)
    if score is not None:
        scored = rows.withColumn("avg_log_prob", score(label, F.col("tld")))
    else:
        named = rows.withColumn("__label", label)
        means = avg_log_prob(named.select(F.col("__label").alias("label"), "tld").distinct(), counts, stats, order, vocab=BROADCAST_NGRAMS + 1)
        scored = named.join(means.withColumnRenamed("label", "__label"), ["__label", "tld"], "left").drop("__label")
    return _calibrated(scored, stats).select(*rows.columns, "likelihood")
