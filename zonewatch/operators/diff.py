"""The snapshot diff: one full outer join on the name gives every transition.

State is (name, tld, first_seen_at, last_seen_at, currently_in_zone, created_at, updated_at), one row
a name; events are (name, tld, event_type, detected_at, run_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED, REMOVED, RETURNED = "ADDED_TO_ZONE", "REMOVED_FROM_ZONE", "RETURNED_TO_ZONE"
EVENT_TYPES = (ADDED, REMOVED, RETURNED)
#: Accepted in rules, never produced by a diff.
RESERVED_TYPES = ("AVAILABLE", "REGISTERED_NOT_DELEGATED", "UNKNOWN")

STATE = ("name string, tld string, first_seen_at timestamp, last_seen_at timestamp, currently_in_zone boolean, "
         "created_at timestamp, updated_at timestamp")


def is_baseline(state: DataFrame) -> bool:
    """Nothing is known yet."""
    return state.isEmpty()


def baseline(staged: DataFrame, now: Column) -> DataFrame:
    """The first state. It has no events."""
    return staged.select("name", "tld", now.alias("first_seen_at"), now.alias("last_seen_at"), F.lit(True).alias("currently_in_zone"),
                         now.alias("created_at"), now.alias("updated_at"))


def classify(state: DataFrame, staged: DataFrame, tlds: list[str], baseline_per_tld: bool = False) -> DataFrame:
    """Known and staged names side by side, with `transition` (null: none) and `seen`.

    Only names of the transferred TLDs can be removed; added is tested against all known names. With
    `baseline_per_tld` the names of a TLD of which none is known come in without an event.
    """
    s = staged.select("name", F.col("tld").alias("staged_tld"), F.lit(True).alias("seen"))
    rows = state.withColumn("known", F.lit(True)).join(s, "name", "full_outer")
    known, seen = F.col("known").isNotNull(), F.col("seen").isNotNull()
    inside = F.coalesce("currently_in_zone", F.lit(False))
    transition = (F.when(~known, ADDED)
                  .when(seen & ~inside, RETURNED)
                  .when(~seen & inside & F.col("tld").isin(*tlds), REMOVED))
    if baseline_per_tld:
        known_tlds = state.select(F.col("tld").alias("staged_tld"), F.lit(True).alias("tld_known")).distinct()  # a row a TLD
        rows = rows.join(F.broadcast(known_tlds), "staged_tld", "left")
        transition = F.when(known | F.col("tld_known").isNotNull(), transition)
    rows = rows.withColumn("transition", transition).withColumn("seen", seen).withColumn("tld", F.coalesce("tld", "staged_tld"))
    return rows.drop("tld_known")


def new_state(classified: DataFrame, now: Column, *more: str) -> DataFrame:
    """Removed names keep last_seen_at, returned ones first_seen_at; what was seen is touched. With the
    `transition` as a further column the state, written once, gives the events too."""
    removed = F.coalesce(F.col("transition") == REMOVED, F.lit(False))
    return classified.select(
        "name", "tld", F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(F.col("seen"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(removed, False).when(F.col("seen"), True).otherwise(F.col("currently_in_zone")).alias("currently_in_zone"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(F.col("seen") | removed, now).otherwise(F.col("updated_at")).alias("updated_at"), *more)


def events(classified: DataFrame, now: Column, run_id: int) -> DataFrame:
    """The events of rows (name, tld, transition)."""
    return classified.where("transition IS NOT NULL").select(
        "name", "tld", F.col("transition").alias("event_type"), now.alias("detected_at"), F.lit(run_id).cast("long").alias("run_id"))


def diff_counts(found: DataFrame) -> DataFrame:
    """One row: added, removed, returned, total."""
    return found.agg(*(F.count_if(F.col("event_type") == t).alias(n) for t, n in ((ADDED, "added"), (REMOVED, "removed"), (RETURNED, "returned"))),
                     F.count("*").alias("total"))


def history(log: DataFrame) -> DataFrame:
    """(name, events): each name's events in order."""
    return log.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("detected_at", "run_id", "event_type"))).alias("events"))


def state_from_log(log: DataFrame, state: DataFrame) -> DataFrame:
    """(name, tld, in_zone, agrees): the latest event decides; a name without one came with the baseline."""
    last = log.groupBy("name").agg(F.max_by("event_type", F.struct("detected_at", "run_id")).alias("last"))
    inside = F.coalesce(F.col("last") != REMOVED, F.lit(True))
    return state.join(last, "name", "left").select(
        "name", "tld", inside.alias("in_zone"), (inside == F.col("currently_in_zone")).alias("agrees"))
