"""Snapshots before they are believed: normalise, deduplicate, count, validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalise, normalise_ascii, plausible


def stage(raw: DataFrame, idn: bool = True) -> DataFrame:
    """(name, tld) of (raw_name, tld): normalised, plausible, each name once.

    The TLD is the source's. A name that several sources hold goes to the first in order: the
    smallest `source_order`, or without that column the smallest TLD.
    """
    form = normalise if idn else normalise_ascii
    rows = raw.withColumn("name", form(F.col("raw_name"))).where(plausible(F.col("name")))
    order = F.col("source_order") if "source_order" in raw.columns else F.col("tld")
    return rows.groupBy("name").agg(F.min_by("tld", order).alias("tld"))


def rejected(raw: DataFrame, idn: bool = True) -> DataFrame:
    """(tld, malformed): rows whose name isn't empty but not plausible either."""
    form = normalise if idn else normalise_ascii
    name = form(F.col("raw_name"))
    return raw.groupBy("tld").agg(F.count_if((name != "") & ~plausible(name)).alias("malformed"))


def counts(staged: DataFrame) -> DataFrame:
    return staged.groupBy("tld").agg(F.count("*").alias("name_count"))


def validate(staged: DataFrame, expected: DataFrame, stats: DataFrame, min_ratio: float = 0.5) -> DataFrame:
    """A verdict for each expected (tld, complete): name_count, previous_count, ratio, accepted, reason."""
    rows = (expected.join(counts(staged), "tld", "left")
            .join(stats.select("tld", F.col("name_count").alias("previous_count")), "tld", "left")
            .withColumn("name_count", F.coalesce("name_count", F.lit(0)).cast("long")))
    ratio = F.when(F.col("previous_count") > 0, F.col("name_count") / F.col("previous_count")).otherwise(F.lit(1.0))
    reason = (F.when(~F.col("complete"), "incomplete").when(F.col("name_count") == 0, "empty")
              .when(F.col("ratio") < min_ratio, "shrunk").otherwise("ok"))
    return (rows.withColumn("ratio", ratio).withColumn("reason", reason)
            .select("tld", "name_count", "previous_count", "ratio", (F.col("reason") == "ok").alias("accepted"), "reason"))


def all_accepted(verdicts: DataFrame) -> bool:
    """One failing TLD fails the run."""
    return verdicts.where("NOT accepted").limit(1).count() == 0


def record_stats(stats: DataFrame, new: DataFrame) -> DataFrame:
    """Both with a row a TLD: the later transfer's."""
    both = stats.unionByName(new)
    rest = [c for c in stats.columns if c != "tld"]
    latest = F.max_by(F.struct(*rest), F.struct("transferred_at", "name_count")).alias("latest")
    return both.groupBy("tld").agg(latest).select("tld", "latest.*")


def due(expected: DataFrame, stats: DataFrame, now: Column, hours: float = 24.0) -> DataFrame:
    """The expected TLDs whose last transfer is at least so many hours old, or unknown."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("transferred_at")) / 3600.0
    return (expected.join(stats.select("tld", "transferred_at"), "tld", "left")
            .where(F.col("transferred_at").isNull() | (age >= hours)).select(*expected.columns))
