"""Jobs: a monitor run, a backfill, a model build. Each computes frames; commit writes them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import label_of
from ..operators import diff, ngram, rules, staging
from ..sources.scratch import written_once as write_once
from ..sources.state import RUNS, Attempt, Store


@dataclass
class Outcome:
    status: str
    run_id: int
    started_at: dt.datetime
    error: str | None = None
    verdicts: DataFrame | None = None
    state: DataFrame | None = None
    events: DataFrame | None = None
    matches: DataFrame | None = None
    stats: DataFrame | None = None


def with_likelihood(rows: DataFrame, model: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """rows (name, tld, ...) with `likelihood`, null where the TLD has no model."""
    if model is None:
        return rows
    return ngram.with_likelihood(rows, label_of(F.col("name")), *model)


def monitor(raw: DataFrame, complete: DataFrame, state: DataFrame, stats: DataFrame, rule_list: list[rules.Rule], now: dt.datetime,
            run_id: int, model=None, min_ratio: float = 0.5, hours: float = 24.0, baseline_per_tld: bool = False,
            keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> Outcome:
    """One run over (raw_name, tld) snapshots. `complete` is (tld, complete) of the expected TLDs; those
    with a fresh transfer are skipped, and one that fails validation fails the run with nothing changed.

    `keep` gets each table under its name as it is made and returns what to go on with. A `keep` that writes
    and reads back, as a store's attempt does, has the snapshot read once, joined with the state once,
    and the events and rules read from what was written."""
    at = F.lit(now)
    todo = staging.due(complete, stats, at, hours)
    tlds = [r["tld"] for r in todo.select("tld").collect()]  # a row a TLD
    if not tlds:
        return Outcome("SKIPPED", run_id, now)
    staged = keep("staged", staging.stage(raw.where(F.col("tld").isin(*tlds))))
    verdicts = keep("verdicts", staging.validate(staged, todo, stats, min_ratio))
    if not staging.all_accepted(verdicts):
        failed = ", ".join(f".{r['tld']}: {r['reason']}" for r in verdicts.where("NOT accepted").orderBy("tld").collect())
        return Outcome("FAILED", run_id, now, failed, verdicts)
    new_stats = keep("stats", staging.record_stats(stats, verdicts.select("tld", "name_count", at.alias("transferred_at"), F.lit(None).cast("double").alias("duration_seconds"))))
    if diff.is_baseline(state):
        next_state = diff.baseline(staged, at).withColumn("transition", F.lit(None).cast("string"))
    else:
        next_state = diff.new_state(diff.classify(state, staged, tlds, baseline_per_tld), at, "transition")
    next_state = keep("domains", next_state)
    found = keep("events", diff.events(next_state, at, run_id))
    matches = keep("matches", rules.evaluate(with_likelihood(found, model), rule_list))
    return Outcome("SUCCESS", run_id, now, None, verdicts, next_state.drop("transition"), found, matches, new_stats)


def backfill(state: DataFrame, rule_list: list[rules.Rule], now: dt.datetime, run_id: int, only: str | None = None, model=None) -> Outcome:
    """Rules against what is in the zone. Likelihoods are looked up for the names that hit, not for the zone."""
    at = F.lit(now)
    plain = rules.backfill(state, rule_list, at, run_id, only)
    if model is not None:
        hit = plain.where("brand IS NOT NULL").select("name").distinct()
        named = with_likelihood(state.join(hit, "name", "left_semi"), model)
        typo = [r for r in rule_list if isinstance(r, rules.TypoRule)]
        plain = plain.where("brand IS NULL").unionByName(rules.backfill(named, typo, at, run_id, only))
    return Outcome("SUCCESS", run_id, now, matches=plain)


def model_of(labels: DataFrame, order: int = 3) -> tuple[DataFrame, DataFrame, int]:
    """(counts, statistics, number of n-grams) of (label, tld), which are read once and counted once."""
    labels = write_once(labels.select("label", "tld"), "labels")
    return _calibrated_model(write_once(ngram.tally(labels, order), "ngrams"), labels, order)


def _calibrated_model(tallied: DataFrame, labels: DataFrame, order: int) -> tuple[DataFrame, DataFrame, int]:
    counts, sizes = tallied.where("ngram IS NOT NULL"), ngram.sizes_of(tallied, order)
    vocab = ngram.vocabulary(sizes)
    return counts, ngram.calibrate(counts, sizes, labels, order, vocab=vocab), vocab


def in_zone_labels(state: DataFrame, tlds: list[str] | None = None) -> DataFrame:
    rows = state.where("currently_in_zone")
    rows = rows if tlds is None else rows.where(F.col("tld").isin(*tlds))
    return rows.select(label_of(F.col("name")).alias("label"), "tld")


def build_models(state: DataFrame, tlds: list[str] | None = None, order: int = 3) -> tuple[DataFrame, DataFrame]:
    """(counts, statistics) of the names in the zone, all TLDs in one job."""
    return model_of(in_zone_labels(state, tlds), order)[:2]


def update_models(model: tuple[DataFrame, DataFrame], events: DataFrame, state: DataFrame, order: int = 3) -> tuple[DataFrame, DataFrame]:
    """(counts, statistics) after a run's events, equal to those built anew from the state that they led to.
    The events' names change the counts; of the state only the labels that calibrate are scored. TLDs
    that have no model get one if their names all came with the events."""
    counts, stats = model
    labels = stats.select("tld", F.lit(None).cast("string").alias("ngram"), F.col("sample_count").alias("cnt"))
    tallied = write_once(ngram.apply_events(counts.select("tld", "ngram", "cnt").unionByName(labels), events, order), "ngrams")
    return _calibrated_model(tallied, in_zone_labels(state), order)[:2]


def commit(store: Store, outcome: Outcome, dry_run: bool = False, attempt: Attempt | None = None) -> None:
    """Make a run visible: state, events and matches together, with the run's own row. The tables of an
    `attempt` are written already, those of another outcome now. A table that the run doesn't change isn't written."""
    if dry_run:
        return
    if attempt is None:
        attempt = Attempt(store, outcome.run_id)
        tables = {"domains": outcome.state, "events": outcome.events, "matches": outcome.matches, "stats": outcome.stats}
        kept = {k: attempt.keep(k, df) for k, df in tables.items() if df is not None and outcome.status == "SUCCESS"}
        outcome = replace(outcome, state=kept.get("domains"), events=kept.get("events"), matches=kept.get("matches"), stats=kept.get("stats"))
    counts, matched, zones = {"added": 0, "removed": 0, "returned": 0}, 0, None
    if outcome.status == "SUCCESS":
        if outcome.events is not None:
            counts = diff.diff_counts(outcome.events).first().asDict()
        if outcome.matches is not None:
            matched = outcome.matches.count()
        if outcome.verdicts is not None:
            zones = {r["tld"]: r["name_count"] for r in outcome.verdicts.collect()}  # a row a TLD
    row = (outcome.run_id, outcome.status, outcome.started_at, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), counts["added"], counts["removed"],
           counts["returned"], matched, zones, outcome.error, attempt.id, attempt.versions.get("domains"), attempt.versions.get("stats"), attempt.base)
    store.commit(store.spark.createDataFrame([row], RUNS))


def run_monitor(store: Store, raw: DataFrame, complete: DataFrame, rule_list: list[rules.Rule], now: dt.datetime, run_id: int, **more) -> Outcome:
    """A monitor run on a store, committed. It starts from what was known before this run, so that a
    repeated run finds the same changes and replaces its first attempt. Later runs are stale then, until
    they are repeated too (`Store.stale`)."""
    attempt = Attempt(store, run_id)
    outcome = monitor(raw, complete, store.domains(run_id), store.stats(run_id), rule_list, now, run_id, keep=attempt.keep, **more)
    commit(store, outcome, attempt=attempt)
    return outcome


def run_backfill(store: Store, rule_list: list[rules.Rule], now: dt.datetime, run_id: int, only: str | None = None, model=None, anew: bool = False) -> Outcome:
    """A backfill on a store, committed. Names and statistics stay as they are.

    After an earlier backfill of all rules only what is new is evaluated: new rules on the zone, the others
    on names with events since. `anew` evaluates everything; so do runs with a likelihood model, whose
    scores may change for any name, and runs of one rule."""
    attempt = Attempt(store, run_id)
    last = None if anew or only is not None or model is not None else store.last_backfill(run_id)
    if last is None:
        outcome = backfill(store.domains(run_id), rule_list, now, run_id, only, model)
    else:
        since, known = last
        changed = store.events().where((F.col("run_id") > since) & (F.col("run_id") < run_id)).select("name").distinct()
        outcome = Outcome("SUCCESS", run_id, now, matches=rules.backfill_again(
            store.domains(run_id), store.matches().where(F.col("run_id") == since), known, write_once(changed, "changed"), rule_list, F.lit(now), run_id))
    outcome = replace(outcome, matches=attempt.keep("matches", outcome.matches))
    if only is None and model is None:
        store.save_rules(run_id, attempt.id, {r.name: rules.fingerprint(r) for r in rule_list if r.enabled})
    commit(store, outcome, attempt=attempt)
    return outcome
