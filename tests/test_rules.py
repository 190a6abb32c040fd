import datetime as dt
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from zonewatch.functions.multipattern import required
from zonewatch.operators import diff, reports, rules, watchlist
from zonewatch.operators.watchlist import Watchlist
from zonewatch.plans import jobs
from zonewatch.sources import ruleconfig
from zonewatch.sources.state import EVENTS, RUNS, Attempt, Store, write_features
from zonewatch.streaming import rules as streaming

YAML = """
rules:
  - name: text
    description: The brand's text
    regex: "(?P<brand>example)"
    events: [ADDED_TO_ZONE, REMOVED_FROM_ZONE]
  - name: squat
    description: Squats
    type: typosquat
    brands: example
    events: ADDED_TO_ZONE
  - {name: disabled, description: Disabled, regex: a, events: ADDED_TO_ZONE, enabled: false}
"""
DAY = [dt.datetime(2026, 1, d) for d in range(1, 5)]


def test_loading(spark):
    a, b, c = ruleconfig.load_rules(YAML, spark)
    assert a.regex == "(?<brand>example)" and b.watchlist.brands == ("example",) and not c.enabled
    assert b.pattern.startswith("watchlist of 1 brands within distance 1")


@pytest.mark.parametrize("text", [
    "rules: []", "other: 1", ":", "rules: [{name: x, regex: a, events: ADDED_TO_ZONE}]", "rules: [{name: x, description: d, regex: '(', events: ADDED_TO_ZONE}]",
    "rules: [{name: x, description: d, regex: a}]", "rules: [{name: x, description: d, regex: a, events: NOPE}]",
    "rules: [{name: x, description: d, type: other, events: ADDED_TO_ZONE}]", "rules: [{name: x, description: d, type: typosquat, events: ADDED_TO_ZONE}]",
    "rules: [{name: x, description: d, type: typosquat, brands: a, max_distance: 0, events: ADDED_TO_ZONE}]",
    "rules: [{name: x, description: d, type: typosquat, brands: a, methods: [nope], events: ADDED_TO_ZONE}]",
    "rules: [{name: x, description: d, regex: a, events: ADDED_TO_ZONE}, {name: x, description: d, regex: b, events: ADDED_TO_ZONE}]"])
def test_bad_rules(text):
    with pytest.raises(ruleconfig.ConfigError):
        ruleconfig.load_rules(text)


def events(spark, rows):
    return spark.createDataFrame([(n, "ch", t, DAY[1], 2) for n, t in rows], "name string, tld string, event_type string, detected_at timestamp, run_id long")


def test_scope_and_attribution(spark):
    found = rules.evaluate(events(spark, [("examp1e.ch", diff.ADDED), ("myexample.ch", diff.REMOVED), ("exampl.ch", diff.REMOVED)]), ruleconfig.load_rules(YAML, spark))
    rows = sorted((r.name, r.rule_name, r.matched_value, r.method or "") for r in found.collect())
    assert rows == [("examp1e.ch", "squat", "examp1e", "homoglyph"), ("examp1e.ch", "squat", "examp1e", "replacement"), ("myexample.ch", "text", "example", "")]
    signal = json.loads(found.where("method = 'homoglyph'").first().signals)
    assert signal["brand"] == "example" and signal["lexical"]["length"] == 7 and signal["lexical_signals"][0]["name"] == "randomness"
    assert rules.evaluate(events(spark, []), []).count() == 0


def test_empty_match_counts(spark):
    rule = rules.RegexRule("any", "Anything", "x*", (diff.ADDED,))
    assert [r.matched_value for r in rules.evaluate(events(spark, [("a.ch", diff.ADDED)]), [rule]).collect()] == [""]


def test_reports(spark):
    rows = [("a.ch", "squat", "homoglyph", "example", 1.05), ("b.ch", "squat", "omission", "example", 0.64), ("a.ch", "squat", "replacement", "example", 0.65), ("c.ch", "text", None, None, None)]
    m = spark.createDataFrame([(n, "ch", diff.ADDED, DAY[0], 1, r, "d", "p", n, me, b, s, None) for n, r, me, b, s in rows],
                              "name string, tld string, event_type string, detected_at timestamp, run_id long, rule_name string, rule_description string, "
                              "rule_pattern string, matched_value string, method string, brand string, score double, signals string")
    assert {r.rule_name: r.n_matches for r in reports.by_rule(m).collect()} == {"squat": 3, "text": 1}
    brand = reports.by_brand(m).first()
    assert (brand.n_matches, brand.n_domains, brand.domains) == (3, 2, ["a.ch", "b.ch"])
    top, all_ = ({(r.rule_name, r.name, r.method): r.place for r in reports.ranked(m, n).collect()} for n in (9, None))
    assert top == all_ and all_["squat", "a.ch", "homoglyph"] == 1 and all_["text", "c.ch", None] == 1
    assert reports.by_brand(m, shown=1).first().domains == ["a.ch"] and reports.brand_names(m).count() == 2
    assert [r.name for r in reports.ranked(m, 2).where("rule_name = 'squat'").orderBy("place").collect()] == ["a.ch", "a.ch"]
    assert reports.digest(m).first().subject == "zone watch: 2 rules matched 4 times"
    assert reports.digest(m.where("rule_name = 'text'")).first().subject == f"zone watch: c.ch {diff.ADDED}"
    assert reports.digest(m.where("rule_name = 'squat'")).first().subject == "zone watch: rule squat matched 3 times"
    assert reports.lines(m, "Europe/Zurich").first().seen == "2026-01-01 01:00 CET"
    seen = {d: spark.createDataFrame([(d,)], "at timestamp").select(reports.local_time(F.col("at"), "Europe/Zurich")).first()[0] for d in (
        dt.datetime(2026, 3, 29, 0, 59, 59), dt.datetime(2026, 3, 29, 1), dt.datetime(1975, 7, 1), dt.datetime(1985, 7, 1))}
    assert list(seen.values()) == ["2026-03-29 01:59 CET", "2026-03-29 03:00 CEST", "1975-07-01 01:00 CET", "1985-07-01 02:00 CEST"]
    assert reports.lines(m, "No/Where").first().seen == "2026-01-01 00:00 UTC"


def raw(spark, **zones):
    return spark.createDataFrame([(n, t) for t, names in zones.items() for n in names], "raw_name string, tld string")


def test_monitor_runs(spark, tmp_path):
    store, rule_list = Store(spark, str(tmp_path / "store")), ruleconfig.load_rules(YAML, spark)
    complete = spark.createDataFrame([("ch", True), ("li", True)], "tld string, complete boolean")

    def run(number, day, **zones):
        return jobs.run_monitor(store, raw(spark, **zones), complete, rule_list, DAY[day], number)

    first = run(1, 0, ch=["a.ch", "b.ch"], li=["a.li"])
    assert first.status == "SUCCESS" and first.events.count() == 0 and store.domains().count() == 3
    assert run(2, 0, ch=["a.ch"], li=["a.li"]).status == "SKIPPED"
    failed = run(3, 1, ch=["a.ch", "b.ch"], li=[])
    assert failed.status == "FAILED" and ".li: empty" in failed.error
    assert store.domains().where("currently_in_zone").count() == 3
    run(4, 2, ch=["a.ch", "examp1e.ch"], li=["a.li"])
    assert sorted((r.name, r.event_type) for r in store.events().collect()) == [("b.ch", diff.REMOVED), ("examp1e.ch", diff.ADDED)]
    assert store.matches().count() == 2
    row = store.runs().where("run_id = 4").first()
    assert (row.added, row.removed, row.matched, row.zone_counts) == (1, 1, 2, {"ch": 2, "li": 1})
    versions = sorted(p.name for p in (tmp_path / "store" / "domains").iterdir())
    jobs.run_backfill(store, rule_list, DAY[3], 5, model=jobs.build_models(store.domains()))
    assert sorted(p.name for p in (tmp_path / "store" / "domains").iterdir()) == versions and store.domains().count() == 4
    found = store.matches().where("run_id = 5")
    assert found.count() == 2 and found.where("event_type IS NULL").count() == 2
    assert jobs.backfill(store.domains(), rule_list, DAY[3], 6, only="text").matches.count() == 0
    export = reports.feature_export(store.events(), store.matches())
    write_features(export, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert reports.status(store.domains(), store.events(), store.matches()).first().asDict() == {"known": 4, "in_zone": 3, "out_of_zone": 1, "events": 2, "matches": 4}
    assert [r.run_id for r in reports.recent_runs(store.runs(), 2).collect()] == [5, 4]
    assert reports.availability_candidates(store.events(), store.matches()).count() == 0


def test_reruns_replace_a_run(spark, tmp_path):
    store, rule_list = Store(spark, str(tmp_path / "store")), ruleconfig.load_rules(YAML, spark)
    complete = spark.createDataFrame([("ch", True)], "tld string, complete boolean")

    def run(number, day, names):
        return jobs.run_monitor(store, raw(spark, ch=names), complete, rule_list, DAY[day], number)

    def seen():
        return (sorted((r.name, r.event_type, r.run_id) for r in store.events().collect()),
                sorted((r.name, r.currently_in_zone) for r in store.domains().collect()), sorted((r.run_id, r.added) for r in store.runs().collect()))

    run(1, 0, ["a.ch", "b.ch"])
    run(2, 1, ["a.ch", "b.ch", "examp1e.ch"])
    first = seen()
    assert first[0] == [("examp1e.ch", diff.ADDED, 2)] and store.matches().count() == 2
    run(2, 1, ["a.ch", "b.ch", "examp1e.ch"])  # the same again
    assert seen() == first and store.matches().count() == 2
    run(2, 1, ["a.ch", "b.ch"])  # again, and now nothing has changed
    assert seen() == ([], [("a.ch", True), ("b.ch", True)], [(1, 0), (2, 0)]) and store.matches().count() == 0
    assert run(2, 1, []).status == "FAILED"  # a failed attempt changes nothing
    assert seen()[1] == [("a.ch", True), ("b.ch", True)] and store.runs().where("status = 'SUCCESS'").count() == 2
    jobs.run_backfill(store, rule_list, DAY[2], 3)
    run(4, 3, ["a.ch"])
    assert [r.name for r in store.events().collect()] == ["b.ch"] and all(
        r.agrees for r in diff.state_from_log(store.events(), store.domains()).collect())


def test_one_pass_for_all_rules(spark):
    many = [rules.RegexRule(f"r{i}", "d", f"x{i}", (diff.ADDED,)) for i in range(20)]
    many += [rules.TypoRule(f"w{i}", "d", Watchlist.of([f"brand{i}x"], max_distance=1 + i % 2), (diff.ADDED, diff.REMOVED)) for i in range(5)]
    rows = events(spark, [("brand1x1.ch", diff.ADDED), ("brand2x.ch", diff.ADDED), ("brand3xyz.ch", diff.REMOVED), ("x7.ch", diff.REMOVED)])
    path = rows.withColumn("name", F.concat("name"))
    found = rules.evaluate(path, many)
    apart = sorted((r.name, r.rule_name, r.method or "", r.matched_value) for rule in many for r in rules.evaluate(path, [rule]).collect())
    assert sorted((r.name, r.rule_name, r.method or "", r.matched_value) for r in found.collect()) == apart and apart
    spark.range(5).selectExpr("concat('n', id, '.ch') AS name", "'ch' AS tld", f"'{diff.ADDED}' AS event_type", "current_timestamp() AS detected_at", "1L AS run_id")
    plan = rules.evaluate(spark.range(100).selectExpr("concat('n', id, '.ch') AS name", "'ch' AS tld", f"'{diff.ADDED}' AS event_type",
                                                      "timestamp_seconds(0) AS detected_at", "1L AS run_id"), many)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 100") == 1


def test_decoded_labels(spark):
    labels = spark.createDataFrame([("xn--zrch-0ra", "ch"), ("xn--zrich-kva", "ch"), ("zurich", "ch")], "label string, tld string")
    for form, want in (("stored", 0), ("unicode", 1)):
        w = Watchlist.of(["zürich"], methods=("typo",), match_form=form)
        found = [(r.label, r.method) for r in watchlist.check(labels, w).collect()]
        assert len([x for x in found if x[0].startswith("xn--")]) == want, found


def test_models_by_tld(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.load_model() is None
    state = diff.baseline(raw(spark, ch=["bank.ch", "hotel.ch"], li=["bank.li"]).withColumnRenamed("raw_name", "name"), F.lit(DAY[0]))
    store.save_model(*jobs.build_models(state))
    store.save_model(*jobs.build_models(state, ["li"]))
    assert sorted(r.tld for r in store.load_model()[1].collect()) == ["ch", "li"]


def test_models_are_replaced_together(spark, tmp_path):
    """Counts and statistics of a version that was never named aren't read."""
    store = Store(spark, str(tmp_path / "store"))
    one, two = (diff.baseline(raw(spark, ch=names).withColumnRenamed("raw_name", "name"), F.lit(DAY[0])) for names in (["bank.ch"], ["hotel.ch", "bahn.ch"]))
    store.save_model(*jobs.build_models(one))
    jobs.build_models(two)[0].write.parquet(f"{store.base}/ngram_counts/version=unnamed")
    counts, stats = store.load_model()
    assert stats.first().sample_count == 1 and counts.agg(F.sum("cnt")).first()[0] == stats.first().total_ngrams
    store.save_model(*jobs.build_models(two))
    counts, stats = store.load_model()
    assert stats.count() == 1 and stats.first().sample_count == 2 and counts.agg(F.sum("cnt")).first()[0] == stats.first().total_ngrams


@pytest.fixture
def runner(spark, tmp_path):
    store, rule_list = Store(spark, str(tmp_path / "store"), buckets=3), ruleconfig.load_rules(YAML, spark)
    complete = spark.createDataFrame([("ch", True)], "tld string, complete boolean")
    return store, rule_list, lambda number, names: jobs.run_monitor(store, raw(spark, ch=names), complete, rule_list, DAY[0] + dt.timedelta(number - 1), number)


def log_of(store):
    return sorted((r.run_id, r.name, r.event_type) for r in store.events().collect())


def test_rerun_of_an_older_run(runner):
    """Run 2 repeated after run 3: run 3 is stale until it is repeated; log and state agree all along."""
    store, rule_list, run = runner
    agree = lambda: all(r.agrees for r in diff.state_from_log(store.events(), store.domains()).collect())
    run(1, ["a.ch", "b.ch"])
    run(2, ["a.ch", "b.ch", "c.ch"])
    run(3, ["a.ch", "c.ch"])
    jobs.run_backfill(store, rule_list, DAY[3], 4)
    assert store.stale() == [] and agree()
    run(2, ["a.ch", "b.ch", "examp1e.ch"])
    assert store.stale() == [3, 4] and store.last_run() == 2
    assert log_of(store) == [(2, "examp1e.ch", diff.ADDED)] and agree()
    assert sorted(r.name for r in store.domains().where("currently_in_zone").collect()) == ["a.ch", "b.ch", "examp1e.ch"]
    run(3, ["a.ch", "c.ch"])
    assert store.stale() == [4] and agree()
    assert log_of(store) == [(2, "examp1e.ch", diff.ADDED), (3, "b.ch", diff.REMOVED), (3, "c.ch", diff.ADDED), (3, "examp1e.ch", diff.REMOVED)]
    jobs.run_backfill(store, rule_list, DAY[3], 4)
    assert store.stale() == []


def test_backfill_of_what_is_new(spark, runner):
    """Names that came, went and came back, a rule altered, added, disabled: equal to a backfill of everything."""
    store, rule_list, run = runner
    text, squat, _ = rule_list
    as_rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    run(1, ["example.ch", "examp1e.ch", "gone.ch", "back-example.ch"])
    jobs.run_backfill(store, [text, squat], DAY[0], 2)
    run(3, ["example.ch", "examp1e.ch", "exampl.ch"])
    run(4, ["example.ch", "exampl.ch", "back-example.ch", "new.ch"])
    for number, rules_now in ((5, [text, squat]), (6, [replace(text, regex="^new"), squat, rules.RegexRule("more", "d", "ex", diff.EVENT_TYPES)]), (7, [replace(squat, enabled=False)])):
        assert store.last_backfill(number)[0] == {5: 2, 6: 5, 7: 6}[number]
        jobs.run_backfill(store, rules_now, DAY[3], number)
        found = store.matches().where(F.col("run_id") == number)
        assert as_rows(found) == as_rows(jobs.backfill(store.domains(), rules_now, DAY[3], number).matches)
        assert found.isEmpty() == (number == 7)
    run(3, ["example.ch", "exampl.ch"])  # what stood on it is stale, so everything is evaluated again
    assert store.last_backfill(8)[0] == 2
    jobs.run_backfill(store, [text, squat], DAY[3], 8)
    assert as_rows(store.matches().where("run_id = 8")) == as_rows(jobs.backfill(store.domains(), [text, squat], DAY[3], 8).matches)


def test_rows_from_before_lineage(spark, runner):
    """Runs whose rows don't name their start count as they are."""
    store, _, run = runner
    run(1, ["a.ch"])
    run(2, ["a.ch", "b.ch"])
    old = store._read("runs", RUNS).withColumn("base_version", F.lit(None).cast("string")).collect()
    other = Store(spark, store.base + "-old")
    other.commit(spark.createDataFrame(old, RUNS))
    assert other.stale() == [] and other.last_run() == 2


def test_snapshot_is_read_once(spark, tmp_path):
    """A run reads its raw rows once and joins the state once, bucketed and not shuffled; all outputs are of that reading."""
    store, rule_list = Store(spark, str(tmp_path / "store"), buckets=3), ruleconfig.load_rules(YAML, spark)
    complete, read = spark.createDataFrame([("ch", True)], "tld string, complete boolean"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    for number, names in enumerate((["a.ch", "b.ch", "c.ch"], ["a.ch", "examp1e.ch", "d.ch", "e.ch"]), 1):
        read.value = 0
        rows = raw(spark, ch=names)
        outcome = jobs.run_monitor(store, rows.mapInArrow(counted, rows.schema), complete, rule_list, DAY[number - 1], number)
        assert outcome.status == "SUCCESS" and read.value == len(names)
    assert len(log_of(store)) == 5 and store.matches().count() == 2
    classified = diff.classify(store.domains(), spark.createDataFrame([("a.ch", "ch")], "name string, tld string"), ["ch"])
    plan = classified._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FullOuter") == 1
    plain = diff.classify(spark.createDataFrame(store.domains().collect(), diff.STATE), spark.createDataFrame([("a.ch", "ch")], "name string, tld string"), ["ch"])
    assert sorted(map(str, classified.collect())) == sorted(map(str, plain.collect()))
    again = Store(spark.newSession(), store.base)  # a session that has never seen the table
    again.forget("domains", again.version("domains"))
    assert again.domains().count() == 6


def test_stream_of_commits(spark, tmp_path, runner):
    """Replaced, failed, unfinished and stale attempts give no match, over restarts of the stream too."""
    store, rule_list, run = runner
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def stream():
        query = streaming.matches_to(store, rule_list, out, checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted((r.run_id, r.name, r.method or "") for r in streaming.read_matches(store, out).collect())

    def matches():
        return sorted((r.run_id, r.name, r.method or "") for r in store.matches().collect())

    run(1, ["a.ch", "b.ch"])
    assert stream() == []
    run(2, ["a.ch", "b.ch", "examplle.ch"])
    run(2, ["a.ch", "b.ch", "examp1e.ch"])  # replaces the attempt before the stream sees either
    assert stream() == matches() == [(2, "examp1e.ch", "homoglyph"), (2, "examp1e.ch", "replacement")]
    attempt = Attempt(store, 3)  # writes its events and breaks off
    attempt.keep("events", spark.createDataFrame([("examplee.ch", "ch", diff.ADDED, DAY[2], 3)], EVENTS))
    assert run(3, []).status == "FAILED"
    assert stream() == matches() and len(matches()) == 2
    run(3, ["a.ch", "b.ch", "examp1e.ch", "exampl.ch"])
    assert stream() == matches() and {m[0] for m in matches()} == {2, 3}
    run(2, ["a.ch", "b.ch", "exampke.ch"])  # run 3 is stale
    assert stream() == matches() and {m[:2] for m in matches()} == {(2, "exampke.ch")}
    run(3, ["a.ch", "b.ch", "exampl.ch"])
    assert stream() == matches() and {m[:2] for m in matches()} == {(2, "exampke.ch"), (3, "exampl.ch")}


def test_required_texts():
    """Texts that every match holds, lower-cased; None where that can't be told."""
    known = {
        "example": {"example"}, "(?P<x>a)" : None, "(?<brand>example|coop)-?shop": {"shop"}, "(example|coop)-": {"example", "coop"}, "ab?cde": {"cde"}, "abc+d": {"abc"}, "^foo.*barbar$": {"barbar"},
        r"\.ch$": {".ch"}, "(abc)?de": {"de"}, "(abc)*": None, "abc|d": None, "abc|def": {"abc", "def"}, "[a-z]{3,7}": None, "x{2}yz": {"yz"}, "(?i)LogIn": {"login"},
        "(?=foo)bar": None, r"\Qa.b\E": None, "a{0,3}bcd": {"bcd"}, "[[a-z]&&[^bc]]foo": None, "[^]a]bcd": None, r"[\]x]login\d+": {"login"}, "é+login": {"login"},
        "(ab(cd|ef)gh)+xyz": {"xyz"}, r"\p{L}shop": {"shop"}, "ab??cd": {"cd"}, "*a": None, "a(b": None, "": None, "pay(?:pal|ment)s": {"pay"}}
    for regex, want in known.items():
        assert required(regex) == (frozenset(want) if want else None), regex


def test_required_texts_of_random_patterns():
    import random
    import re

    rng = random.Random(4)

    def pattern(depth=0):
        parts = []
        for _ in range(rng.randint(1, 4)):
            atom = rng.choice(["a", "b", "ab", "aba", r"\.", "[ab]", ".", f"({pattern(depth + 1)})" if depth < 2 else "b", f"(?:{pattern(depth + 1)}|{pattern(depth + 1)})" if depth < 2 else "a"])
            parts.append(atom + rng.choice(["", "", "", "?", "*", "+", "{2}", "{0,1}", "+?"]))
        return "".join(parts)

    told = 0
    for _ in range(1500):
        regex = pattern()
        texts = required(regex)
        told += texts is not None
        for _ in range(10):
            name = "".join(rng.choice("ab.") for _ in range(rng.randint(0, 9)))
            if texts and re.search(regex, name):
                assert any(t in name for t in texts), (regex, texts, name)
    assert told > 300


def test_hundreds_of_patterns(spark):
    """Equal matches from the automaton and from trying every pattern on every name; patterns without a
    required text, of upper case and of several alternatives are among them."""
    rows = spark.range(3000).select(F.concat(F.lit("shop"), F.lower(F.conv(F.col("id"), 10, 36)), F.lit("-pay"), F.col("id") % 7, F.lit(".ch")).alias("name"), F.lit("ch").alias("tld"),
                                    F.lit(diff.ADDED).alias("event_type"), F.lit(DAY[0]).alias("detected_at"), F.lit(1).cast("long").alias("run_id"))
    patterns = [rf"shop{i}[a-z]+-pay" for i in range(80)] + [f"(?i)PAY{i}" for i in range(9)] + ["^[a-z]{5}[0-9]", "(ab|cd|ef)x?-pay", "pay1|pay2", "nothing", r"\d-pay6\.ch$"]
    many = [rules.RegexRule(f"r{i}", "d", p, diff.EVENT_TYPES) for i, p in enumerate(patterns)]
    as_set = lambda found: {(r.name, r.rule_name, r.matched_value) for r in found.collect()}
    found = rules.evaluate(rows, many)
    got = as_set(found)
    assert found.count() == len(got)
    plain = set()
    for k in range(0, len(many), rules.INLINE_PATTERNS):
        plain |= as_set(rules.evaluate(rows, many[k:k + rules.INLINE_PATTERNS]))
    assert got == plain and len({r for _, r, _ in got}) > 25
    both = rules.evaluate(rows, [*many, rules.TypoRule("t", "d", Watchlist.of(["shop1-pay"], methods=("typo",)), diff.EVENT_TYPES)])
    assert as_set(both) > got
