"""Line deduplication against levelled sorted runs of line hashes. DataFrame and SQL functions only.

A line's key is the line with white space stripped at both ends and A-Z lower-cased; keys of at
least `min_length` code points count. A run is a table of (two 64-bit hashes of a key, owner),
bucketed and sorted by the hashes; all runs are disjoint. A new batch of documents aggregates its
keys, merge-anti-joins them with each run (the run's side isn't shuffled), and adds what is new as
a run of level 0, owned by the smallest doc_id that holds it. `fanout` runs of a level are merged
into one of the next. A line is dropped where its key's owner is another document.

Keys that make up more than a thousandth of a batch's lines (fewer than 1000 of them, whatever the
input) are broadcast, so that a line found in a third of all documents isn't gathered anywhere.

Null and empty texts are one empty line. Documents with a null doc_id keep all their lines and own
none. Rows that repeat a doc_id are one document: lines they share stay. An empty table gives no
rows. Whole rows are carried by `drop_lines` in a struct, so their names clash with nothing. The id may
be of any type that Spark orders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\n")


def lower_ascii(c: Column) -> Column:
    """A-Z to lower case; an all-ASCII text takes the fast way."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def keyed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 10) -> DataFrame:
    """(id, version, pos, h1, h2) of every line whose key counts; version tells texts of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), F.posexplode(lines_of(lower_ascii(text))).alias("pos", "line"))
    key = F.btrim("line", F.lit(" \t\n\x0b\x0c\r"))
    return (rows.select("id", "version", "pos", key.alias("key")).where(F.length("key") >= min_length)
            .select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")))


class LineRuns:
    """The runs of one corpus, tables in the cluster's shared warehouse until `drop`."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.levels = spark, fanout, {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @property
    def runs(self) -> list[str]:
        return [name for level in sorted(self.levels) for name in self.levels[level]]

    def _write(self, keys: DataFrame, level: int) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (keys.select("h1", "h2", "owner").repartition(self.buckets, "h1", "h2")
         .write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .saveAsTable(name))
        self.levels.setdefault(level, []).append(name)
        return name

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of keyed lines, written beforehand; (id, version, pos) of those to drop."""
        keys = lines.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.count("*").alias("n"))
        fresh = keys
        for run in self.runs:
            fresh = fresh.join(self.spark.table(run).hint("merge"), ["h1", "h2"], "left_anti")
        self._write(fresh, 0)
        often = keys.where(F.col("n") > lines.count() / 1000).select("h1", "h2")  # fewer than 1000 rows
        known = [self.spark.table(run) for run in self.runs]
        hot = [run.join(F.broadcast(often), ["h1", "h2"]) for run in known]
        rare = lines.join(F.broadcast(often), ["h1", "h2"], "left_anti")
        found = [lines.join(F.broadcast(h), ["h1", "h2"]) for h in hot] + [rare.join(run.hint("merge"), ["h1", "h2"]) for run in known]
        drops = None
        for part in found:
            part = part.where("id <> owner").select("id", "version", "pos")
            drops = part if drops is None else drops.unionByName(part)
        drops = save(drops, "line-drops")
        self._compact()
        return drops

    def _compact(self) -> None:
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            old = self.levels.pop(level)
            merged = self.spark.table(old[0])
            for name in old[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self._write(merged, level + 1)
            for name in old:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1


    def drop(self) -> None:
        for name in self.runs:
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = {}


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 10,
               batches: int = 4, fanout: int = 3) -> DataFrame:
    """(row, kept_text, n_lines, n_dropped): row is the whole row of docs. Batches are taken in the order
    of the ids, so that a line stays in the smallest id that holds it."""
    spark = docs.sparkSession
    lines = save(keyed_lines(docs, id_col, text_col, min_length), "lines")
    # any ids can part the batches; these are about evenly spread
    some = sorted(r[0] for r in lines.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(1000).collect())
    cuts = [some[len(some) * i // batches] for i in range(1, batches)] if some else []
    low, runs, drops = None, LineRuns(spark, fanout), None
    for high in [*sorted(set(cuts)), None]:
        batch = lines if low is None else lines.where(F.col("id") > low)
        part = runs.add(batch if high is None else batch.where(F.col("id") <= high))
        drops, low = part if drops is None else drops.unionByName(part), high
    runs.drop()  # what is to be dropped is written
    gone = drops.groupBy("id", "version").agg(F.sort_array(F.collect_list("pos")).alias("gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("version"))
    rows = rows.join(gone, ["id", "version"], "left").withColumn("lines", lines_of(F.col("text")))
    # one byte a line, 0 where it goes: a lookup that costs the same for the last line as for the first
    mask = """encode(array_join(transform(gone, (p, k) ->
        concat(repeat('1', p - if(k = 0, 0, get(gone, k - 1) + 1)), '0')), ''), 'UTF-8')"""
    return (rows.withColumn("mask", F.expr(f"CASE WHEN gone IS NOT NULL THEN {mask} END"))
            .select("row",
                    F.expr("""CASE WHEN gone IS NULL THEN text ELSE array_join(
                        filter(lines, (x, i) -> substring(mask, i + 1, 1) <> X'30'), '\n') END""").alias("kept_text"),
                    F.size("lines").cast("long").alias("n_lines"),
                    F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped")))
