"""The registered queries: every job of the library on zones made of the documents' words."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import wraps
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import confusables, lexical, names
from ..operators import diff, ngram, reports, rules, scoring, staging, watchlist
from ..sources import zonefile
from ..sources.scratch import new_folder
from . import jobs, wordzone

NOW = "2026-01-02 06:00:00"
LATER = "2026-01-03 06:00:00"
TLDS = ["ch", "li"]


def _three(c: str):
    """A score of four places to three, exactly: engines differ in the last place of a sum of doubles."""
    return F.round(F.col(c).cast("decimal(9,4)"), 3).cast("double").alias(c)


def _at(text: str = NOW):
    return F.lit(text).cast("timestamp")


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def _whole(sf_dir: str) -> bool:
    return isinstance(sf_dir, wordzone.Whole)


def _labels_once(query):
    """The query on labels that are written first: more than one of its jobs reads them, or parts of one job
    that ask for different labels, before which Spark would cut the documents anew."""
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, wordzone.Prepared.of(spark, sf_dir))
    return run


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, staged = wordzone.zone(spark, sf_dir)
    return diff.events(diff.classify(state, staged, TLDS), _at(), 1)


def zone_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_counts(_events(spark, sf_dir))


def zone_diff_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("name", "tld", "event_type", _day("detected_at"), "run_id")


def zone_new_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, staged = wordzone.zone(spark, sf_dir)
    return diff.new_state(diff.classify(state, staged, TLDS), _at()).select(
        "name", "tld", _day("first_seen_at"), _day("last_seen_at"), "currently_in_zone", _day("updated_at"))


def zone_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, staged = wordzone.zone(spark, sf_dir)
    stats = staging.counts(state.where("currently_in_zone"))
    expected = state.groupBy("tld").agg(F.lit(True).alias("complete"))
    return staging.validate(staged, expected, stats, 0.5).withColumn("ratio", F.round("ratio", 6))


def zone_stage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in capitals with a dot behind, and again between blanks, are one name each."""
    _, staged = wordzone.zone(spark, sf_dir)
    if _whole(sf_dir):
        staged = staged.withColumn("name", names.display(F.col("name")))
    # some letters have capitals that aren't theirs alone; reversed, as Spark reads lower(upper(x)) as lower(x)
    capitals = F.when(F.lower(F.reverse(F.upper("name"))) == F.reverse("name"), F.upper("name")).otherwise(F.col("name"))
    raw = staged.select(F.explode(F.array(F.concat(capitals, F.lit(".")), F.concat(F.lit(" \t"), "name", F.lit("  ")))).alias("raw_name"), "tld")
    return staging.stage(raw, idn=_whole(sf_dir))


def _zone_text(spark: SparkSession, lines: DataFrame, head=lambda tld: []) -> DataFrame:
    """(raw_name, tld) read back from zone text of (line, tld), a file tree a TLD, each begun by some lines."""
    path = new_folder(spark, "zone")
    lines.select("line", "tld").write.partitionBy("tld").text(path)
    out = None
    for tld in TLDS:
        if head(tld):
            spark.createDataFrame([(x,) for x in head(tld)], "line string").coalesce(1).write.mode("append").text(f"{path}/tld={tld}")
        part = zonefile.names(zonefile.read_lines(spark, f"{path}/tld={tld}"), tld)
        out = part if out is None else out.unionByName(part)
    return out


def zone_text_ns_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone text written and read back: two NS lines an owner, the second a continuation, and address records."""
    _, staged = wordzone.zone(spark, sf_dir)
    line = F.concat("name", F.lit(".\t3600\tIN\tNS\tns1.example.net.\n\t\t3600\tIN\tNS\tns2.example.net. ; second\nglue."), "name",
                    F.lit(".\t3600\tIN\tA\t192.0.2.1"))
    return _zone_text(spark, staged.select(line.alias("line"), "tld")).groupBy(F.col("raw_name").alias("name"), "tld").agg(F.count("*").alias("n_lines"))


def zone_text_awkward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare names, continuations behind other records, relative owners in lower case, records that delegate
    nothing; before them comments, a directive, blank lines and the apex's own records."""
    _, staged = wordzone.zone(spark, sf_dir)
    label = names.label_of(F.col("name"))
    line = (F.when(F.length(label) % 4 == 0, F.concat(F.lit(" "), "name", F.lit(". ; bare")))
            .when(F.length(label) % 4 == 1, F.concat("name", F.lit(".\t3600\tIN\tDS\t1 2 3\n\t3600\tIN\tNS\tns1.example.net.")))
            .when(F.length(label) % 4 == 2, F.concat(label, F.lit("  3600 in ns ns1.example.net.\n# a note")))
            .otherwise(F.concat("name", F.lit(".\t3600\tIN\tRRSIG\tNS 8 2 3600"))))
    found = _zone_text(spark, staged.select(line.alias("line"), "tld"), lambda tld: [
        "; a zone", f"$ORIGIN {tld}.", "", "@\t3600\tIN\tSOA\tns. root. 1 2 3 4 5", "@\t3600\tIN\tNS\ta.nic.example.", f"{tld}.\t3600\tIN\tNS\tb.nic.example."])
    return found.groupBy(names.normalise_ascii(F.col("raw_name")).alias("name"), "tld").agg(F.count("*").alias("n_lines"))


def _raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, raw_name, tld): today's names with a dot, between blanks, with a word behind, and too long."""
    _, staged = wordzone.zone(spark, sf_dir)
    forms = {"dot": F.concat(F.translate("name", ascii_lowercase, ascii_uppercase), F.lit(".")), "blank": F.concat(F.lit(" \t"), "name", F.lit("  ")),
             "space": F.concat("name", F.lit(" x")), "long": F.concat("name", F.lit("." + "x" * 250))}
    return staged.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("raw_name")) for k, v in forms.items()))).alias("r"), "tld").select("r.*", "tld")


def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, last label, the rest, and whether it can be a name."""
    name = F.col("name")
    return _raw_names(spark, sf_dir).select("kind", names.normalise_ascii(F.col("raw_name")).alias("name")).select(
        "kind", "name", names.tld_of(name).alias("last"), names.label_of(name).alias("label"), names.plausible(name).alias("plausible"))


def zone_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.rejected(_raw_names(spark, sf_dir), idn=_whole(sf_dir))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics after today's transfer of one TLD."""
    state, staged = wordzone.zone(spark, sf_dir)
    old = staging.counts(state.where("currently_in_zone")).withColumn("transferred_at", _at("2026-01-01 00:00:00"))
    return staging.record_stats(old, staging.counts(staged.where("tld = 'ch'")).withColumn("transferred_at", _at()))


@_labels_once
def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("tld", "name_count", _day("transferred_at"))


@_labels_once
def due_tlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The TLDs to transfer six hours after today's transfer of one."""
    _, staged = wordzone.zone(spark, sf_dir)
    return staging.due(staged.select("tld").distinct(), _stats(spark, sf_dir), _at("2026-01-02 12:00:00"))


def zone_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's snapshot as the first one, and whether it is the first for no state and for yesterday's."""
    state, staged = wordzone.zone(spark, sf_dir)
    first = [F.lit(diff.is_baseline(x)).alias(n) for x, n in ((state.where("false"), "first_of_none"), (state, "first_of_state"))]
    return diff.baseline(staged, _at()).select("name", "tld", _day("first_seen_at"), _day("last_seen_at"), "currently_in_zone", *first)


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(log, state) after today's snapshot and, the day after, yesterday's again."""
    state, staged = wordzone.zone(spark, sf_dir)
    first = diff.classify(state, staged, TLDS)
    again = state.where("currently_in_zone").select("name", "tld")
    second = diff.classify(diff.new_state(first, _at()), again, TLDS)
    log = diff.events(first, _at(), 1).unionByName(diff.events(second, _at(LATER), 2))
    return log, diff.new_state(second, _at(LATER))


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = _two_runs(spark, sf_dir)
    return diff.history(log).select("name", F.array_join(F.transform("events", lambda e: F.concat(e["run_id"].cast("string"), F.lit(":"), e["event_type"])), ",").alias("events"))


def state_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.state_from_log(*_two_runs(spark, sf_dir))


def lexical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.extract(F.col("label"))
    return wordzone.labels(spark, sf_dir).select("label", *(
        (F.round(v, 6) if k == "entropy" or k.endswith("ratio") else v).alias(k) for k, v in found.items()))


def _zone_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordzone.labels(spark, sf_dir).where("known AND in_zone").select("label", "tld")


def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.count(_zone_labels(spark, sf_dir))


def lexical_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features as they are exported."""
    return wordzone.labels(spark, sf_dir).select("label", *lexical.rounded(F.col("label")))


@_labels_once
def ngram_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two batches of labels as one."""
    rows = _zone_labels(spark, sf_dir)
    return ngram.merge(*(ngram.count(rows.where(F.length("label") % 2 == i)) for i in (0, 1)))


def _ngram_stats(stats: DataFrame) -> DataFrame:
    return stats.select("tld", "order", "total_ngrams", "vocab_size", "sample_count", F.round("mean_log_prob", 6).alias("mean_log_prob"),
                        F.round("std_log_prob", 6).alias("std_log_prob"))


def ngram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngram_stats(jobs.model_of(_zone_labels(spark, sf_dir))[1])


def ngram_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of any labels, those not in the zone too."""
    return _ngram_stats(jobs.model_of(wordzone.labels(spark, sf_dir).select("label", "tld"))[1])


@_labels_once
def ngram_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday's model after today's events, without counting the zone again."""
    state, staged = wordzone.zone(spark, sf_dir)
    classified = jobs.write_once(diff.classify(state, staged, TLDS), "classified")
    model = jobs.build_models(state)
    return _ngram_stats(jobs.update_models(model, diff.events(classified, _at(), 1), diff.new_state(classified, _at()))[1])


def _likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, stats, vocab = jobs.model_of(_zone_labels(spark, sf_dir))
    return ngram.likelihood(wordzone.labels(spark, sf_dir), counts, stats, vocab=vocab)


@_labels_once
def ngram_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _likelihoods(spark, sf_dir).withColumn("likelihood", F.round("likelihood", 6))


@_labels_once
def randomness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _likelihoods(spark, sf_dir).select("label", "tld", F.round(lexical.randomness(F.col("label"), F.col("likelihood")), 6).alias("randomness"))


def skeleton_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordzone.labels(spark, sf_dir).select("label", confusables.skeleton(F.col("label"), decode=_whole(sf_dir)).alias("skeleton"))


def word_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons of the documents' words in all scripts, and which hold a letter beyond ASCII."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("label")).where("label <> ''").distinct()
    return words.select("label", confusables.skeleton(F.col("label"), decode=False).alias("skeleton"), confusables.is_homograph(F.col("label")).alias("is_homograph"))


def _watchlist(methods=watchlist.METHODS, **more) -> watchlist.Watchlist:
    return watchlist.Watchlist.of(wordzone.BRANDS, methods=tuple(methods), home_tlds={b: "li" for b in wordzone.BRANDS}, **more)


def _distance():
    """The edit distance, -1 for methods that have none."""
    return F.coalesce("distance", F.lit(-1)).alias("distance")


def _squat(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = watchlist.check(wordzone.labels(spark, sf_dir).select("label", "tld"), _watchlist([method]))
        return found.select("label", "tld", "method", "brand", _distance())
    return query


def squat_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watchlist.check(wordzone.labels(spark, sf_dir).select("label", "tld"), _watchlist()).select("label", "tld", "method", "brand", _distance())


def squat_typo_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels within two edits of a brand."""
    found = watchlist.check(wordzone.labels(spark, sf_dir).select("label", "tld"), _watchlist(["typo"], max_distance=2))
    return found.select("label", "tld", "method", "brand", _distance())


def common_words(spark: SparkSession, sf_dir: str, n: int = 1000) -> list[str]:
    """The words of a-z that the documents hold most often: a long watchlist, as a rule file would have one."""
    words = wordzone.word_rows(spark, sf_dir).where("word rlike '^[a-z]{6,63}$'")
    return [r["word"] for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(n).collect()]


def squat_many_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels within two edits of a thousand brands."""
    w = watchlist.Watchlist.of(common_words(spark, sf_dir), methods=("typo",), max_distance=2)
    found = watchlist.check(wordzone.labels(spark, sf_dir).select("label", "tld"), w)
    return found.select("label", "tld", "method", "brand", _distance())


@_labels_once
def analyse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label with every watchlist, scored with its likelihood."""
    found = scoring.analyse(_likelihoods(spark, sf_dir), {"all": _watchlist(), "near": _watchlist(["typo"])})
    return found.select("label", "tld", "rule", "length", "hyphen_count", "max_consonant_run", "is_idn", F.round("likelihood", 6).alias("likelihood"),
                        "n_watchlist", F.round("randomness", 6).alias("randomness"), _three("score"), "fires", F.size("signals").alias("n_signals"))


def assess_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal of every label, a row each."""
    found = scoring.assess(wordzone.labels(spark, sf_dir).select("label", "tld"), _watchlist())
    return found.select("label", "tld", F.explode("signals").alias("s")).select(
        "label", "tld", F.col("s.name").alias("signal"), F.col("s.category").alias("category"), F.round("s.weight", 6).alias("weight"),
        F.coalesce("s.brand", F.lit("")).alias("brand"), F.coalesce("s.distance", F.lit(-1)).alias("distance"))


def assess_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.assess(wordzone.labels(spark, sf_dir).select("label", "tld"), _watchlist()).select(
        "label", "tld", "n_watchlist", F.round("randomness", 6).alias("randomness"), _three("score"), "fires",
        F.size("signals").alias("n_signals"))


def signal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every signal of every label says."""
    found = scoring.assess(wordzone.labels(spark, sf_dir).select("label", "tld"), _watchlist())
    return found.select("label", "tld", F.explode("signals").alias("s")).select(
        "label", "tld", F.col("s.name").alias("signal"), "s.brand", "s.reason", "s.detail")


ALL = diff.EVENT_TYPES
SHORT = rules.RegexRule("short", "Three to seven letters", r"^[a-z]{3,7}\.ch$", (diff.ADDED, diff.REMOVED))
TEXT = rules.RegexRule("text", "A brand's text anywhere", r"(thanedble|orantion|coop)", ALL)
OFF = rules.RegexRule("off", "Disabled", r"a", ALL, enabled=False)


def _typo_rule() -> rules.TypoRule:
    return rules.TypoRule("watch", "Squats of our brands", _watchlist(), (diff.ADDED, diff.RETURNED))


def _rules() -> list[rules.Rule]:
    return [SHORT, TEXT, OFF, _typo_rule()]


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(_events(spark, sf_dir), _rules())


def rule_regex_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(_events(spark, sf_dir), [SHORT, TEXT, OFF]).select("name", "event_type", "rule_name", "rule_pattern", "matched_value")


def rule_typo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(_events(spark, sf_dir), [_typo_rule()]).select(
        "name", "event_type", "rule_name", "matched_value", "method", "brand", _three("score"))


def match_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals that matches carry as JSON, read back."""
    schema = ("method string, brand string, distance int, detail string, "
              "lexical struct<label: string, length: int, entropy: double, hyphen_count: int, is_idn: boolean>, "
              "lexical_signals array<struct<name: string, weight: double, detail: string>>")
    found = rules.evaluate(_events(spark, sf_dir), [_typo_rule()]).select("name", F.from_json("signals", schema).alias("j"))
    own = F.get("j.lexical_signals", F.lit(0))
    return found.select("name", "j.method", "j.brand", "j.distance", "j.detail", "j.lexical.*",
                        F.round(own["weight"], 6).alias("randomness"), own["detail"].alias("sentence"))


def rule_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _ = wordzone.zone(spark, sf_dir)
    return rules.backfill(state, _rules(), _at(), 7).select("name", "event_type", "rule_name", "matched_value", "method", "brand")


def rule_many_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole zone against five hundred patterns: a common word between hyphens or at an edge."""
    state, _ = wordzone.zone(spark, sf_dir)
    many = [rules.RegexRule(w, "A word of the label", rf"(^|-){w}(-|\.)", ALL) for w in common_words(spark, sf_dir, 500)]
    return rules.backfill(state, many, _at(), 7).select("name", "rule_name", "matched_value")


@_labels_once
def backfill_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday's backfill brought up to today: one rule as it was, one altered, one new and one gone."""
    state, staged = wordzone.zone(spark, sf_dir)
    classified = jobs.write_once(diff.classify(state, staged, TLDS), "classified")
    before = [SHORT, replace(TEXT, regex="orantion"), rules.RegexRule("gone", "No longer", "a", ALL)]
    previous = jobs.write_once(rules.backfill(state, before, _at("2026-01-01 06:00:00"), 1), "matches")
    known, changed = {r.name: rules.fingerprint(r) for r in before}, diff.events(classified, _at(), 2).select("name")
    return rules.backfill_again(diff.new_state(classified, _at()), previous, known, changed, _rules(), _at(), 7).select(
        "name", "event_type", _day("detected_at"), "run_id", "rule_name", "matched_value", "method", "brand")


def backfill_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole zone against one rule of several."""
    state, _ = wordzone.zone(spark, sf_dir)
    return rules.backfill(state, _rules(), _at(), 7, only="text").select("name", "rule_name", "matched_value")


def rule_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule that matched looks for, in words."""
    return _matches(spark, sf_dir).groupBy("rule_name", "rule_pattern").agg(F.count("*").alias("n_matches"))


def match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as a reader in Zürich sees them, in winter and in summer."""
    at = F.when(F.col("tld") == "li", _at("2026-07-02 06:00:00")).otherwise(F.col("detected_at"))
    return reports.lines(_matches(spark, sf_dir).withColumn("detected_at", at), "Europe/Zurich").select(
        "rule_name", "display_name", "event", "seen", "method", "brand")


def match_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_rule(_matches(spark, sf_dir)).select("rule_name", "rule_description", "n_matches")


def match_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_brand(_matches(spark, sf_dir), idn=_whole(sf_dir)).select(
        "brand", "n_matches", "n_domains", F.array_join("domains", ",").alias("domains"), F.array_join("methods", ",").alias("methods"))


def match_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ranked(_matches(spark, sf_dir).withColumn("score", _three("score")), 20).select("rule_name", "place", "name", "method", "brand")


def run_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.digest(_matches(spark, sf_dir), idn=_whole(sf_dir))


def feature_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return reports.feature_export(events, rules.evaluate(events, _rules())).select(
        "domain", "tld", "event_type", "length", "hyphen_count", "max_consonant_run", "watchlist_fired", "brand_fired", "methods",
        _three("max_score"))


def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _ = wordzone.zone(spark, sf_dir)
    return reports.status(state, _events(spark, sf_dir), _matches(spark, sf_dir))


def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each feed, in the feeds' order; the five latest."""
    rows = wordzone.label_rows(spark, sf_dir).where("source <> ''").withColumn("tld", F.when(F.length("label") % 10 == 0, "li").otherwise("ch"))
    counts = rows.groupBy("source", "tld").agg(F.count_distinct("label").alias("n"))
    runs = counts.groupBy("source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tld", "n")))).alias("zone_counts"))
    number = F.regexp_replace("source", "[^0-9]", "").cast("long")
    runs = runs.select(number.alias("run_id"), F.timestamp_seconds(number * 86400).alias("started_at"), "zone_counts")
    return reports.recent_runs(runs, 5).select("run_id", F.date_format("started_at", "yyyy-MM-dd").alias("started"),
                                               F.element_at("zone_counts", "ch").alias("ch"), F.element_at("zone_counts", "li").alias("li"))


def availability_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.availability_candidates(_events(spark, sf_dir), _matches(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        zone_diff_counts, zone_diff_events, zone_new_state, zone_validation, zone_stage_dedup, zone_text_ns_owners, event_history,
        state_from_log, lexical_features, randomness_score, ngram_counts, ngram_stats, ngram_likelihood, skeleton_fold, squat_all,
        assess_scores, rule_regex_events, rule_typo_events, rule_backfill, match_by_rule, match_by_brand, match_ranked, run_digest,
        feature_export, status_totals, recent_runs, availability_candidates)
} | {f"squat_{m}": _squat(m) for m in (*watchlist.METHODS, *watchlist.OPTIONAL_METHODS)}


#: Further operators, each with SQL too.
QUERIES |= {f.__name__: f for f in (
    zone_text_awkward, name_parts, zone_rejected, snapshot_stats, due_tlds, zone_baseline, lexical_rounded, ngram_merged, ngram_from_labels, ngram_updated,
    word_skeletons, signal_texts, match_signals, squat_typo_two, squat_many_two, analyse_names, assess_signals, backfill_one, backfill_updated, rule_many_patterns, rule_patterns, match_lines)}


def _of_whole(query):
    return lambda spark, sf_dir: query(spark, wordzone.Whole(sf_dir))


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's names as people read them."""
    _, staged = wordzone.zone(spark, wordzone.Whole(sf_dir))
    return staged.select("name", names.display(F.col("name")).alias("display"), confusables.is_homograph(F.col("name")).alias("is_homograph"))


#: The same on names as A-labels, and those decoded.
WHOLE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "whole_display_names": display_names, **{f"whole_{k}": _of_whole(q) for k, q in QUERIES.items()}}
