"""Tables on storage. A run becomes visible with its row in `runs`, which is written last.

Layout under a base path: events, matches (folders by run_id and attempt), stats and domains (a
version for each attempt that changes them), ngram_counts and ngram_stats (versions, named in models), backfills (the rules of
each), runs. Every
attempt at a run writes folders of its own, which its row in `runs` names; readers take what the last
successful attempt of each run names, so a rerun replaces the run as a whole or not at all, and can
read what it replaces.

A run's row names the version of the known names that it started from. A run whose start isn't what the
runs before it lead to any more, because one of them was repeated since, is stale: its events, matches and
versions aren't read until it is repeated too. So log and state always agree.

Versions of the known names are bucketed by name, one file a bucket: the diff shuffles the snapshot
only. The number of buckets is in the version's name, and any session can read it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff
from .scratch import new_folder

STATS = "tld string, name_count long, transferred_at timestamp, duration_seconds double"
RUNS = ("run_id long, status string, started_at timestamp, finished_at timestamp, added long, removed long, returned long, "
        "matched long, zone_counts map<string,long>, error string, attempt string, domains_version string, stats_version string, base_version string")
BACKFILLS = "run_id long, attempt string, rule_name string, fingerprint string"
EVENTS = "name string, tld string, event_type string, detected_at timestamp, run_id long"
STATISTICS = "tld string, order int, total_ngrams long, vocab_size long, sample_count long, mean_log_prob double, std_log_prob double"
MATCHES = ("name string, tld string, event_type string, detected_at timestamp, run_id long, rule_name string, rule_description string, "
           "rule_pattern string, matched_value string, method string, brand string, score double, signals string")


class Store:
    def __init__(self, spark: SparkSession, base: str, buckets: int | None = None):
        self.spark, self.base = spark, base.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _path(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        hadoop, files = self._path(path)
        return files.exists(hadoop)

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.base}/{name}"
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        """A row a run: its last successful attempt, else its last one, and whether it is stale."""
        rows = self._read("runs", RUNS)
        rest = F.struct(*(c for c in rows.columns if c != "run_id"))
        last = (rows.groupBy("run_id").agg(F.max_by(rest, F.struct(F.col("status") == "SUCCESS", "finished_at", "attempt")).alias("last"))
                .select("run_id", "last.*"))
        return last.withColumn("stale", F.coalesce(F.col("run_id").isin(self._stale(last)), F.lit(False)))

    def _stale(self, runs: DataFrame) -> list[int]:
        """The runs that don't start where the ones before them end (a row a run reaches the driver). Rows
        from before starts were written count as they are."""
        now, stale = "", []
        for r in runs.where("status = 'SUCCESS'").select("run_id", "domains_version", "base_version").orderBy("run_id").collect():
            if r["base_version"] is not None and r["base_version"] != now:
                stale.append(r["run_id"])
            elif r["domains_version"]:
                now = r["domains_version"]
        return stale

    def stale(self) -> list[int]:
        """The runs to repeat, in order."""
        return [r["run_id"] for r in self.runs().where("stale").select("run_id").orderBy("run_id").collect()]

    def succeeded(self) -> DataFrame:
        """(run_id, attempt) of what counts: a row a run."""
        return self.runs().where("status = 'SUCCESS' AND NOT stale").select("run_id", "attempt")

    def last_run(self) -> int | None:
        return self.succeeded().agg(F.max("run_id")).first()[0]

    def version(self, name: str, before: int | None = None) -> str:
        """The name of a table's version: that of the last run which wrote one, of those before a run if one
        is given; empty if none did."""
        runs = self.runs().where("status = 'SUCCESS' AND NOT stale").where(F.col(f"{name}_version").isNotNull())
        runs = runs if before is None else runs.where(F.col("run_id") < before)
        return runs.agg(F.max_by(f"{name}_version", "run_id")).first()[0] or ""

    def _version(self, name: str, schema: str, before: int | None) -> DataFrame:
        version = self.version(name, before)
        return self.read_version(name, version).select(*self._names(schema)) if version else self.spark.createDataFrame([], schema)

    def read_version(self, name: str, version: str) -> DataFrame:
        path, bucketed = f"{self.base}/{name}/version={version}", re.fullmatch(r"(.*)-(\d+)", version)
        if not bucketed:
            return self.spark.read.parquet(path)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
        table = f"zonewatch_{name}_{bucketed[1]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
                       f"CLUSTERED BY (name) INTO {bucketed[2]} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)

    def domains(self, before: int | None = None) -> DataFrame:
        """The known names; for a run's attempt, first or repeated, those `before` it."""
        return self._version("domains", diff.STATE, before)

    def stats(self, before: int | None = None) -> DataFrame:
        return self._version("stats", STATS, before)

    def _of_runs(self, name: str, schema: str) -> DataFrame:
        rows = self._read(name, f"{schema}, attempt string")
        return rows.join(F.broadcast(self.succeeded()), ["run_id", "attempt"], "left_semi").select(*self._names(schema))  # one row a run

    def _names(self, schema: str) -> list[str]:
        return [c.split()[0] for c in schema.split(", ")]

    def events(self) -> DataFrame:
        return self._of_runs("events", EVENTS)

    def matches(self) -> DataFrame:
        return self._of_runs("matches", MATCHES)

    def append(self, name: str, df: DataFrame, run_id: int, attempt: str) -> str:
        """Write a run's rows into a folder of this attempt."""
        folder = f"{name}/run_id={run_id}/attempt={attempt}"
        df.drop("run_id").write.parquet(f"{self.base}/{folder}")
        return folder

    def write_version(self, name: str, df: DataFrame, version: str) -> str:
        """Write a version; its name, with the number of buckets if it has any."""
        if name != "domains":
            df.write.parquet(f"{self.base}/{name}/version={version}")
            return version
        full = f"{version}-{self.buckets}"
        (df.write.bucketBy(self.buckets, "name").sortBy("name").option("path", f"{self.base}/{name}/version={full}")
         .saveAsTable(f"zonewatch_{name}_{version}"))
        return full

    def forget(self, name: str, version: str) -> None:
        """Take a version's entry out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS zonewatch_{name}_{version.rpartition('-')[0]}")

    def commit(self, run: DataFrame) -> None:
        run.coalesce(1).write.mode("append").parquet(f"{self.base}/runs")

    def commits(self) -> DataFrame:
        """The rows of `runs` as a stream, each as it is committed."""
        hadoop, files = self._path(f"{self.base}/runs")
        files.mkdirs(hadoop)
        return self.spark.readStream.schema(RUNS).parquet(f"{self.base}/runs")

    def events_of(self, attempts: list[tuple[int, str]]) -> DataFrame:
        """The events of these attempts at runs, (run_id, attempt), and of no others: their folders only."""
        rows = self._read("events", f"{EVENTS}, attempt string")
        named = F.array(*(F.lit(f"{run}/{attempt}") for run, attempt in attempts))
        return (rows.where(F.col("run_id").isin([run for run, _ in attempts]) & F.col("attempt").isin([a for _, a in attempts]))
                .where(F.array_contains(named, F.concat("run_id", F.lit("/"), "attempt"))).select(*self._names(EVENTS)))

    def save_rules(self, run_id: int, attempt: str, fingerprints: dict[str, str]) -> None:
        """Note the rules that an attempt at a backfill applied to the whole zone."""
        rows = [(run_id, attempt, name, value) for name, value in fingerprints.items()]
        self.spark.createDataFrame(rows, BACKFILLS).coalesce(1).write.mode("append").parquet(f"{self.base}/backfills")

    def last_backfill(self, before: int) -> tuple[int, dict[str, str]] | None:
        """(run, fingerprints by rule name) of the last backfill of all rules before a run that counts."""
        rows = self._read("backfills", BACKFILLS).where(F.col("run_id") < before).join(F.broadcast(self.succeeded()), ["run_id", "attempt"], "left_semi")
        found = rows.collect()  # a row a rule and backfill
        last = max((r["run_id"] for r in found), default=None)
        return None if last is None else (last, {r["rule_name"]: r["fingerprint"] for r in found if r["run_id"] == last})

    def save_model(self, counts: DataFrame, stats: DataFrame) -> None:
        """Replace the models of the TLDs at hand, counts and statistics together; others stay. Both go to a
        folder of their own, which counts once its row in `models` is written."""
        version = uuid.uuid4().hex
        for name, df in (("ngram_counts", counts), ("ngram_stats", stats)):
            df.write.parquet(f"{self.base}/{name}/version={version}")
        tlds = self.spark.read.parquet(f"{self.base}/ngram_stats/version={version}").select("tld")
        tlds.select("tld", F.lit(version).alias("version"), F.current_timestamp().alias("saved_at")).coalesce(1).write.mode("append").parquet(f"{self.base}/models")

    def load_model(self) -> tuple[DataFrame, DataFrame] | None:
        """(counts, statistics), each TLD's last saved ones."""
        if not self._exists(f"{self.base}/models"):
            return None
        models = self._read("models", "tld string, version string, saved_at timestamp")
        last = models.groupBy("tld").agg(F.max_by("version", "saved_at").alias("version"))
        kinds = {"ngram_counts": "tld string, ngram string, cnt long", "ngram_stats": STATISTICS}
        counts, stats = (self._read(name, f"{schema}, version string").join(F.broadcast(last), ["tld", "version"], "left_semi")  # a row a TLD
                         .drop("version") for name, schema in kinds.items())
        return counts, stats


class Attempt:
    """One attempt at a run: every table it makes is written once, where it stays if the run is committed."""

    def __init__(self, store: Store, run_id: int):
        self.store, self.run_id, self.id = store, run_id, uuid.uuid4().hex
        self.base = store.version("domains", run_id)
        self.versions: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table and read it back: events and matches into the run's folders, domains and stats as
        versions, others to scratch."""
        if name in ("events", "matches"):
            schema = EVENTS if name == "events" else MATCHES
            # matches are few rows of a whole zone's scan: Spark sizes the files after the matching, not before
            folder = self.store.append(name, df.hint("rebalance") if name == "matches" else df, self.run_id, self.id)
            rows = self.store._read(folder, ", ".join(c for c in schema.split(", ") if c != "run_id long"))
            return rows.withColumn("run_id", F.lit(self.run_id).cast("long")).select(*self.store._names(schema))
        if name in ("domains", "stats"):
            self.versions[name] = self.store.write_version(name, df, self.id)
            return self.store.read_version(name, self.versions[name])
        path = new_folder(self.store.spark, name)
        df.write.parquet(path)
        return self.store.spark.read.schema(df.schema).parquet(path)


def write_features(export: DataFrame, path: str) -> None:
    export.write.mode("overwrite").option("header", True).csv(path)
