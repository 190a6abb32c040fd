"""Rules over events, or over all names in the zone: regular expressions and brand watchlists."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexical
from ..functions.multipattern import holding, required
from ..functions.names import label_of
from . import scoring, watchlist
from .watchlist import Watchlist

_PROBE = "struct<kind:string,key:string,value:string>"
MATCHES = ("name", "tld", "event_type", "detected_at", "run_id", "rule_name", "rule_description", "rule_pattern",
           "matched_value", "method", "brand", "score", "signals")


#: Beyond so many patterns, those that need some fixed text are tried only where one automaton finds it.
INLINE_PATTERNS = 16


@dataclass(frozen=True)
class RegexRule:
    name: str
    description: str
    regex: str
    events: tuple[str, ...]
    enabled: bool = True

    @property
    def pattern(self) -> str:
        return self.regex


@dataclass(frozen=True)
class TypoRule:
    name: str
    description: str
    watchlist: Watchlist
    events: tuple[str, ...]
    enabled: bool = True

    @property
    def pattern(self) -> str:
        w = self.watchlist
        return f"watchlist of {len(w.brands)} brands within distance {w.max_distance} by {', '.join(sorted(w.methods))}"


Rule = RegexRule | TypoRule


def evaluate(rows: DataFrame, rules: list[Rule], scoped: bool = True) -> DataFrame:
    """Matches of (name, tld, event_type, detected_at, run_id[, likelihood]) with every enabled rule
    that covers the event's type (`scoped`).

    One pass over the rows, however many rules there are: each row's hits by patterns and its probes
    for all watchlists are one array, exploded and joined once with the index of all rules. A few
    patterns are tried on every name; of many, only those whose required texts the name holds.
    """
    spark, live = rows.sparkSession, {i: r for i, r in enumerate(rules) if r.enabled}
    patterns = {i: r for i, r in live.items() if isinstance(r, RegexRule)}
    lists = {i: r.watchlist for i, r in live.items() if isinstance(r, TypoRule)}
    if scoped:
        rows = rows.where(F.col("event_type").isin(sorted({e for r in live.values() for e in r.events})))
    needs = {i: required(r.regex) for i, r in patterns.items()} if len(patterns) > INLINE_PATTERNS else {}
    needs = {i: texts for i, texts in needs.items() if texts}
    found = F.array_compact(F.array(F.lit(None).cast(_PROBE), *(
        F.when(F.col("name").rlike(r.regex), F.struct(F.lit("regex").alias("kind"), F.lit(str(i)).alias("key"), F.regexp_extract("name", r.regex, 0).alias("value")))
        for i, r in patterns.items() if i not in needs)))
    if needs:
        meaning: dict[str, list[str]] = {}
        for i, texts in needs.items():
            for text in texts:
                meaning.setdefault(text, []).append(str(i))
        found = F.concat(found, F.transform(holding(F.lower("name"), meaning), lambda i: F.struct(
            F.lit("regex").alias("kind"), i.alias("key"), F.lit(None).cast("string").alias("value"))))
    own = spark.createDataFrame([(i, "regex", str(i), r.regex if i in needs else None) for i, r in patterns.items()],
                                "list int, kind string, key string, pattern string")
    hits = scoring.scored(watchlist.check_all(rows.withColumn("label", label_of(F.col("name"))), lists, found, own))
    if scoped:  # a row a rule and event type
        covered = spark.createDataFrame([(i, e) for i, r in live.items() for e in r.events], "list int, event_type string")
        hits = hits.join(F.broadcast(covered.distinct()), ["list", "event_type"])
    names = spark.createDataFrame([(i, r.name, r.description, r.pattern) for i, r in live.items()],
                                  "list int, rule_name string, rule_description string, rule_pattern string")
    hits = hits.join(F.broadcast(names), "list")
    squats = F.col("method").isNotNull()
    lexic = F.struct(F.col("label").alias("label"), *lexical.rounded(F.col("label")))
    signal = F.struct(F.lit("randomness").alias("name"), F.col("randomness").alias("weight"), scoring.lexical_detail(F.col("label")).alias("detail"))
    signals = F.to_json(F.struct("method", "brand", "distance", "detail", lexic.alias("lexical"),
                                 F.filter(F.array(signal), lambda x: x["weight"] > 0).alias("lexical_signals")), {"ignoreNullFields": "false"})
    return hits.select(
        "name", "tld", "event_type", "detected_at", "run_id", "rule_name", "rule_description", "rule_pattern",
        F.substring(F.when(squats, F.col("label")).otherwise(F.col("value")), 1, 255).alias("matched_value"),  # cut as stored
        "method", "brand", F.when(squats, F.col("score")).alias("score"), F.when(squats, signals).alias("signals"))


def backfill(state: DataFrame, rules: list[Rule], detected_at, run_id: int, only: str | None = None) -> DataFrame:
    """All names in the zone against the rules, or the one named; matches have no event."""
    rows = state.where("currently_in_zone").select(
        "name", "tld", F.lit(None).cast("string").alias("event_type"), detected_at.alias("detected_at"), F.lit(run_id).cast("long").alias("run_id"),
        *(["likelihood"] if "likelihood" in state.columns else []))
    return evaluate(rows, [r for r in rules if only is None or r.name == only], scoped=False)


def fingerprint(rule: Rule) -> str:
    """Changes with anything that the rule's matches depend on."""
    return hashlib.sha256(repr(rule).encode()).hexdigest()


def backfill_again(state: DataFrame, previous: DataFrame, known: dict[str, str], changed: DataFrame, rules: list[Rule], detected_at, run_id: int) -> DataFrame:
    """What `backfill` of all rules gives, from the matches of an earlier one: `known` has the fingerprints
    of its rules by name, `changed` the names (each once) that had an event since.

    New and altered rules are evaluated on the whole zone, the others on changed names only; their earlier
    matches stay for all other names, dated anew. Matches of rules that are gone or disabled go."""
    same = [r for r in rules if r.enabled and known.get(r.name) == fingerprint(r)]
    other = [r for r in rules if r.enabled and known.get(r.name) != fingerprint(r)]
    stamped = {"detected_at": detected_at, "run_id": F.lit(run_id).cast("long")}
    out = (previous.where(F.col("rule_name").isin([r.name for r in same])).join(changed.select("name"), "name", "left_anti")
           .withColumns(stamped).select(*MATCHES))
    if same:
        out = out.unionByName(backfill(state.join(changed.select("name"), "name", "left_semi"), same, detected_at, run_id))
    return out.unionByName(backfill(state, other, detected_at, run_id)) if other else out
