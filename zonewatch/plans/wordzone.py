"""Zones made of the words of `documents`: what the registered queries run on.

Feeds play the part of days: the known names are the words of all sources but src9, those in the
zone the ones of all but src8 and src9, and today's snapshot has the words of all but src0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalise
from ..sources.scratch import new_folder

#: Words of the documents that serve as brands.
BRANDS = ("thanedble", "orantion", "thintion", "onbleea", "thshing", "teteber", "hetition", "thatin", "ononst", "coop")

#: Squats of those brands, each a name of the zone: look-alikes, bit flips, key slips, combinations, other TLDs.
SQUATS = (
    "thaned8le", "0rantion", "th1ntion", "onb1eea", "th5hing", "te7eber", "he7ition", "th4tin", "on0nst", "c00p",
    "tianedble", "orantinn", "thintinn", "onjleea", "thsling", "tetebgr", "letition", "thauin", "onons4", "coo0",
    "thanedvle", "orantiom", "thimtion", "onbleeq", "thdhing", "teteberr", "hetitoin", "thatim", "oninst", "cooop",
    "thanedble-login", "verifyorantion", "thintion-account", "secure-onbleea", "thshing-sso", "tetebersecure", "hetition-shop",
    "my-thatin", "ononst-banking", "coop-login", "coop-shop", "tha-nedble", "co-op", "th-at-in", "ornation")


#: Squats in other scripts, in the whole zone beside the others.
IDN_SQUATS = ("thаnedble", "оrantion", "thintiоn", "onblееa", "thshíng", "tétéber", "hetitioñ", "ｔhatin", "ononѕt", "cоор", "straße-coop")


#: Which snapshots a label is in, as bits.
KNOWN, IN_ZONE, STAGED = 1, 2, 4


class Whole(str):
    """A folder of tables whose zone has A-labels, and squats in other scripts.

    On a plain path the same words and pairs are labels as they are written."""


class Prepared(str):
    """A folder of tables whose labels were written beforehand, so that only what is done with them is timed."""

    written: str

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Prepared:
        if isinstance(sf_dir, Prepared):
            return sf_dir
        out = PreparedWhole(sf_dir) if isinstance(sf_dir, Whole) else Prepared(sf_dir)
        out.written = new_folder(spark, "labels")
        labels(spark, sf_dir).write.parquet(out.written)
        return out


class PreparedWhole(Prepared, Whole):
    """The same of a whole zone."""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, w): of each document all words of 3 to 63 letters and digits, in any script."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", F.coalesce("source", F.lit("")).alias("source"))
    return docs.select("source", F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w).between(3, 63)).alias("w"))


def _with_pairs(w: Column) -> Column:
    pairs = F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(1), F.size(w) - 1),
                                               lambda i: F.concat(F.get(w, i - 1), F.lit("-"), F.get(w, i))))
    return F.concat(w, F.coalesce(pairs, F.array().cast("array<string>")))


def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, source): all words, without pairs."""
    return _words(spark, sf_dir).select("source", F.explode("w").alias("word"))


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, source): all words and all hyphenated pairs."""
    return _words(spark, sf_dir).select("source", F.explode(_with_pairs(F.col("w"))).alias("label"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, tld, known, in_zone, staged), a row a label, with the squats: all in today's snapshot, the hyphenated known."""
    if isinstance(sf_dir, Prepared):
        return spark.read.parquet(sf_dir.written)
    # one number says what a document's words are: plans that ask for one of the snapshots and for another share the shuffle
    source = F.col("source")
    days = F.when(source != "src9", KNOWN).otherwise(0) + F.when(~source.isin("src8", "src9"), IN_ZONE).otherwise(0) + F.when(source != "src0", STAGED).otherwise(0)
    found = _words(spark, sf_dir).select(days.alias("days"), F.explode(_with_pairs(F.col("w"))).alias("label"))
    squats, hyphen = SQUATS, F.contains(F.regexp_replace("label", "^xn--.*", ""), F.lit("-"))
    if isinstance(sf_dir, Whole):  # each label is coded once
        found, squats = found.groupBy("label").agg(F.bit_or("days").alias("days")).withColumn("label", normalise(F.col("label"))), SQUATS + IDN_SQUATS
    # not createDataFrame, whose rows no two plans share
    more = spark.range(1).select(F.explode(F.array(*map(F.lit, squats))).alias("label")).withColumn("label", normalise(F.col("label"))).select(
        "label", F.when(hyphen, KNOWN + IN_ZONE + STAGED).otherwise(STAGED).alias("days"))
    has = lambda bit: F.col("days").bitwiseAND(F.lit(bit)) != 0
    return (found.unionByName(more).groupBy("label").agg(F.bit_or("days").alias("days"))
            .select("label", has(KNOWN).alias("known"), has(IN_ZONE).alias("in_zone"), has(STAGED).alias("staged"),
                    F.when(F.length("label") % 10 == 0, "li").otherwise("ch").alias("tld")))


def zone(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(state, staged): yesterday's known names and today's snapshot."""
    rows = labels(spark, sf_dir).withColumn("name", F.concat("label", F.lit("."), "tld"))
    day = F.lit("2026-01-01 00:00:00").cast("timestamp")
    state = rows.where("known").select("name", "tld", day.alias("first_seen_at"), day.alias("last_seen_at"), F.col("in_zone").alias("currently_in_zone"),
                                       day.alias("created_at"), day.alias("updated_at"))
    return state, rows.where("staged").select("name", "tld")
