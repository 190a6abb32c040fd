"""Scores of watchlist hits. Lexical randomness ranks and explains them; alone it never fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical
from ..sources.scratch import written_once
from . import watchlist

#: Weight of each method, of any other, and of the randomness score.
METHOD_WEIGHTS = {
    "homoglyph": 1.0, "bitsquat": 0.9, "tld_variant": 0.9, "combosquat": 0.8, "keyboard": 0.7, "omission": 0.6,
    "insertion": 0.6, "transposition": 0.6, "repetition": 0.6, "replacement": 0.6, "hyphenation": 0.5,
}
DEFAULT_WEIGHT = 0.5
LEXICAL_WEIGHT = 0.1


def weight(method: Column) -> Column:
    table = F.create_map(*(x for k, v in METHOD_WEIGHTS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.element_at(table, method), F.lit(DEFAULT_WEIGHT))


def lexical_detail(label: Column, found: dict[str, Column] | None = None) -> Column:
    f = found or lexical.extract(label)
    return F.format_string("%.2f bits a character, %d consonants in a row, %.2f vowels", f["entropy"], f["max_consonant_run"], f["vowel_ratio"])


def scored(found: DataFrame) -> DataFrame:
    """Hits with weight, randomness and each one's own score. They may have a likelihood."""
    likelihood = F.col("likelihood") if "likelihood" in found.columns else None
    found = found.withColumn("weight", F.when(F.col("method").isNotNull(), weight(F.col("method"))))
    found = found.withColumn("randomness", lexical.randomness(F.col("label"), likelihood))
    return found.withColumn("score", F.bround(F.col("weight") + LEXICAL_WEIGHT * F.col("randomness"), 4))


def hits(labels: DataFrame, w: watchlist.Watchlist) -> DataFrame:
    """watchlist.check with weight, randomness and each hit's own score."""
    return scored(watchlist.check(labels, w))


SIGNALS = "array<struct<name:string,category:string,weight:double,reason:string,detail:string,brand:string,distance:int>>"


def analyse(labels: DataFrame, lists: dict[str, watchlist.Watchlist]) -> DataFrame:
    """Every distinct (label, tld) with every named watchlist: (label, tld, rule, lexical features, likelihood,
    n_watchlist, randomness, score, fires, signals). `labels` may have a likelihood. The labels are read
    once, and written, as lookup and features both go over them; what all lists found joins a label's own narrow row, then its features are computed once, and
    then the row is repeated for each list."""
    likelihood = F.max("likelihood") if "likelihood" in labels.columns else F.lit(None).cast("double")
    rows = written_once(labels.groupBy("label", "tld").agg(likelihood.alias("likelihood")), "analysed")
    found = scored(watchlist.check_all(rows, dict(enumerate(lists.values())))).groupBy("label", "tld", "list").agg(
        F.count("*").alias("n"), F.sum("weight").alias("weights"),
        F.sort_array(F.collect_list(F.struct(
            F.col("method").alias("name"), F.lit("watchlist").alias("category"), "weight",
            F.concat(F.lit("squats on '"), "brand", F.lit("' ("), "method", F.lit(")")).alias("reason"), "detail", "brand", "distance"))).alias("found"))
    found = found.groupBy("label", "tld").agg(F.map_from_entries(F.collect_list(F.struct("list", F.struct("n", "weights", "found")))).alias("by_list"))
    rows = rows.join(found, ["label", "tld"], "left")
    rows = rows.select("*", *(v.alias(f"__{k}") for k, v in lexical.extract(F.col("label")).items()))
    features = {k: F.col(f"__{k}") for k in lexical.FEATURES}
    rows = rows.withColumn("randomness", lexical.randomness(F.col("label"), F.col("likelihood"), features))
    rows = rows.withColumn("list", F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(n).alias("rule")) for i, n in enumerate(lists)))))
    hit = F.element_at("by_list", F.col("list.id"))
    rows = rows.select("*", F.col("list.rule").alias("rule"), *(hit[c].alias(c) for c in ("n", "weights", "found")))
    own = F.array(F.struct(F.lit("randomness").alias("name"), F.lit("lexical").alias("category"), F.col("randomness").alias("weight"),
                           F.format_string("looks random: %.2f", F.col("randomness")).alias("reason"),
                           lexical_detail(F.col("label"), features).alias("detail"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("int").alias("distance")))
    empty = F.array().cast(SIGNALS)
    return rows.select(
        "label", "tld", "rule", *lexical.rounded(F.col("label"), features), "likelihood", F.coalesce("n", F.lit(0)).alias("n_watchlist"), "randomness",
        F.bround(F.coalesce("weights", F.lit(0.0)) + LEXICAL_WEIGHT * F.col("randomness"), 4).alias("score"),
        (F.coalesce("n", F.lit(0)) > 0).alias("fires"),
        F.concat(F.coalesce(F.col("found").cast(SIGNALS), empty), F.when(F.col("randomness") > 0, own.cast(SIGNALS)).otherwise(empty)).alias("signals"))


def assess(labels: DataFrame, w: watchlist.Watchlist) -> DataFrame:
    """(label, tld, n_watchlist, randomness, score, fires, signals) for every distinct label."""
    return analyse(labels, {"": w}).select("label", "tld", "n_watchlist", "randomness", "score", "fires", "signals")
