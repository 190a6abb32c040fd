"""Reports over matches, events, state and runs."""

from __future__ import annotations

import datetime as dt
import functools
import zoneinfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexical
from ..functions.names import display, label_of
from ..sources.scratch import new_folder
from .diff import REMOVED


def by_rule(matches: DataFrame) -> DataFrame:
    return matches.groupBy("rule_name").agg(F.min("rule_description").alias("rule_description"), F.min("rule_pattern").alias("rule_pattern"),
                                            F.count("*").alias("n_matches"))


def brand_names(matches: DataFrame, idn: bool = True) -> DataFrame:
    """(brand, name): the names that squat on each brand, each once."""
    name = display(F.col("name")) if idn else F.col("name")
    return matches.where("brand IS NOT NULL").select("brand", name.alias("name")).distinct()


def by_brand(matches: DataFrame, idn: bool = True, shown: int = 100) -> DataFrame:
    """Brands by number of matches, with how many distinct names, the first `shown` of them, and the methods.
    brand_names has all names, a row each; a brand's row holds a list for reading only."""
    squats = matches.where("brand IS NOT NULL")
    names = brand_names(matches, idn)
    place = F.row_number().over(Window.partitionBy("brand").orderBy("name"))  # Spark keeps the first ones of each task
    first = names.withColumn("place", place).where(F.col("place") <= shown).groupBy("brand").agg(F.sort_array(F.collect_list("name")).alias("domains"))
    counts = squats.groupBy("brand").agg(F.count("*").alias("n_matches"), F.sort_array(F.collect_set("method")).alias("methods"))
    return (counts.join(names.groupBy("brand").agg(F.count("*").alias("n_domains")), "brand").join(first, "brand")
            .select("brand", "n_matches", "n_domains", "domains", "methods").orderBy(F.desc("n_matches"), "brand"))


def ranked(matches: DataFrame, top: int | None = None) -> DataFrame:
    """Matches with their place inside the rule: highest score first, then by name. The first `top` of each
    rule, of which Spark keeps no more in any task; or all, sorted over all tasks, so that a rule that
    matches most of a zone isn't gathered in one."""
    score = F.desc(F.coalesce("score", F.lit(0.0)))
    if top is not None:
        place = F.row_number().over(Window.partitionBy("rule_name").orderBy(score, "name", "method", "brand"))
        return matches.withColumn("place", place).where(F.col("place") <= top)
    order = ["rule_name", score, "name", "method", "brand"]
    path = new_folder(matches.sparkSession, "ranked")
    (matches.repartitionByRange(*order).sortWithinPartitions(*order)
     .withColumn("__task", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path))
    rows = matches.sparkSession.read.parquet(path)
    # of each rule where its rows begin in each task: a row a rule and task
    parts = rows.groupBy("rule_name", "__task").agg(F.count("*").alias("n"), F.min("__at").alias("begin"))
    before = F.sum("n").over(Window.partitionBy("rule_name").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("rule_name").alias("__rule"), F.col("__task").alias("__of"), (F.coalesce(before, F.lit(0)) - F.col("begin") + 1).alias("__shift"))
    return (rows.join(F.broadcast(parts), F.col("rule_name").eqNullSafe(F.col("__rule")) & (F.col("__task") == F.col("__of")))
            .select(*matches.columns, (F.col("__at") + F.col("__shift")).cast("int").alias("place")))


def digest(matches: DataFrame, idn: bool = True) -> DataFrame:
    """(run_id, subject): one line a run."""
    name = display(F.min("name")) if idn else F.min("name")
    rows = matches.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("rule_name").alias("rules"), F.min("rule_name").alias("rule"),
                                         F.min(F.coalesce("event_type", F.lit("MATCH"))).alias("event"), name.alias("name"))
    subject = (F.when(F.col("n") == 1, F.format_string("zone watch: %s %s", "name", "event"))
               .when(F.col("rules") == 1, F.format_string("zone watch: rule %s matched %d times", "rule", "n"))
               .otherwise(F.format_string("zone watch: %d rules matched %d times", "rules", "n")))
    return rows.select("run_id", F.col("n").alias("n_matches"), subject.alias("subject"))


@functools.cache
def _changes(zone: str) -> list[tuple[int, str]]:
    """When a time zone's abbreviation changes, in seconds, from 1970 to 2100, and to what."""
    info, utc, out = zoneinfo.ZoneInfo(zone), dt.timezone.utc, []

    def name(at: int) -> tuple:
        t = dt.datetime.fromtimestamp(at, utc).astimezone(info)
        return t.tzname(), t.utcoffset()

    day, end = 0, 4_102_444_800
    out.append((-(1 << 62), name(0)[0]))
    while day < end:
        low, high = day, day + 86_400
        if name(low) != name(high):
            before = name(low)
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if name(middle) == before else (low, middle)
            out.append((high, name(high)[0]))
        day += 86_400
    return out


def local_time(at: Column, zone: str) -> Column:
    """`2026-08-11 12:00 CEST`; an unknown zone name means UTC. The session's time zone is UTC."""
    try:
        zoneinfo.ZoneInfo(zone)
    except Exception:
        zone = "UTC"
    changes = [(0, "UTC")] if zone == "UTC" else _changes(zone)
    seconds = F.array(*(F.lit(t).cast("long") for t, _ in changes))
    names = F.array(*(F.lit(n) for _, n in changes))
    now = F.unix_timestamp(at)
    name = F.get(names, F.greatest(F.lit(0), F.size(F.filter(seconds, lambda t: t <= now)) - 1))
    return F.concat(F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH:mm"), F.lit(" "), name)


def lines(matches: DataFrame, zone: str = "UTC") -> DataFrame:
    """What a reader sees of each match: display name, event or CURRENT (backfill), local time, method and brand."""
    return matches.select("run_id", "rule_name", display(F.col("name")).alias("display_name"),
                          F.coalesce("event_type", F.lit("CURRENT (backfill)")).alias("event"),
                          local_time(F.col("detected_at"), zone).alias("seen"), "method", "brand", "score")


def feature_export(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Every event with its name's features and whether, how and how strongly any rule matched it."""
    found = matches.groupBy("run_id", "name").agg(
        F.array_join(F.sort_array(F.collect_set("method")), ";").alias("methods"), F.max("score").alias("max_score"),
        F.bool_or(F.col("brand").isNotNull()).alias("brand_fired"), F.lit(True).alias("hit"))
    label = label_of(F.col("name"))
    return events.join(found, ["run_id", "name"], "left").select(
        F.col("name").alias("domain"), "tld", "event_type", F.lower(label).alias("label"), *lexical.rounded(label),
        F.coalesce("hit", F.lit(False)).alias("watchlist_fired"), F.coalesce("brand_fired", F.lit(False)).alias("brand_fired"),
        F.coalesce("methods", F.lit("")).alias("methods"), "max_score")


def status(state: DataFrame, log: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of totals."""
    none = F.lit(None).cast("boolean")
    rows = (state.select(F.lit("state").alias("of"), F.col("currently_in_zone").alias("inside"))
            .unionByName(log.select(F.lit("log").alias("of"), none.alias("inside")))
            .unionByName(matches.select(F.lit("match").alias("of"), none.alias("inside"))))
    of = lambda x: F.col("of") == x
    return rows.agg(F.count_if(of("state")).alias("known"), F.count_if(of("state") & F.col("inside")).alias("in_zone"),
                    F.count_if(of("state") & ~F.col("inside")).alias("out_of_zone"), F.count_if(of("log")).alias("events"),
                    F.count_if(of("match")).alias("matches"))


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def availability_candidates(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Removed names that some rule matched in the same run."""
    return events.where(F.col("event_type") == REMOVED).join(matches.select("run_id", "name"), ["run_id", "name"], "left_semi").select("run_id", "name", "tld")
