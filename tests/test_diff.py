import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonewatch.operators import diff, staging

DAY = [dt.datetime(2026, 1, d) for d in range(1, 6)]


def staged(spark, names, tld="ch"):
    return spark.createDataFrame([(n, tld) for n in names], "name string, tld string")


def step(spark, state, names, day, run, tlds=("ch",)):
    found = diff.classify(state, staged(spark, names), list(tlds))
    return diff.new_state(found, F.lit(DAY[day])), diff.events(found, F.lit(DAY[day]), run)


def test_three_days(spark):
    state = diff.baseline(staged(spark, ["a.ch", "b.ch"]), F.lit(DAY[0]))
    state, e1 = step(spark, state, ["a.ch"], 1, 1)
    state, e2 = step(spark, state, ["a.ch", "b.ch", "c.ch"], 2, 2)
    assert [(r.name, r.event_type) for r in e1.collect()] == [("b.ch", diff.REMOVED)]
    assert sorted((r.name, r.event_type) for r in e2.collect()) == [("b.ch", diff.RETURNED), ("c.ch", diff.ADDED)]
    rows = {r.name: r for r in state.collect()}
    assert rows["b.ch"].first_seen_at == DAY[0] and rows["b.ch"].last_seen_at == DAY[2] and rows["b.ch"].currently_in_zone
    assert rows["c.ch"].created_at == DAY[2]
    assert diff.diff_counts(e2).first().asDict() == {"added": 1, "removed": 0, "returned": 1, "total": 2}
    history = {r.name: [e.event_type for e in r.events] for r in diff.history(e1.unionByName(e2)).collect()}
    assert history["b.ch"] == [diff.REMOVED, diff.RETURNED]
    assert all(r.agrees for r in diff.state_from_log(e1.unionByName(e2), state).collect())


def test_removed_keeps_last_seen_and_other_tlds(spark):
    both = staged(spark, ["a.ch"]).unionByName(staged(spark, ["a.li"], "li"))
    state = diff.baseline(both, F.lit(DAY[0]))
    state, events = step(spark, state, ["z.ch"], 1, 1)
    assert sorted((r.name, r.event_type) for r in events.collect()) == [("a.ch", diff.REMOVED), ("z.ch", diff.ADDED)]
    row = state.where("name = 'a.ch'").first()
    assert row.last_seen_at == DAY[0] and row.updated_at == DAY[1] and not row.currently_in_zone
    assert state.where("name = 'a.li'").first().currently_in_zone


def test_baseline(spark):
    empty = spark.createDataFrame([], diff.STATE)
    assert diff.is_baseline(empty) and not diff.is_baseline(diff.baseline(staged(spark, ["a.ch"]), F.lit(DAY[0])))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.sampled_from("abcdefgh"), max_size=6), min_size=2, max_size=3))
def test_state_follows_the_snapshot(spark, days):
    state = diff.baseline(staged(spark, sorted(days[0])), F.lit(DAY[0]))
    inside = set(days[0])
    for i, names in enumerate(days[1:], 1):
        state, events = step(spark, state, sorted(names), i, i)
        kinds = [r.event_type for r in events.collect()]
        assert kinds.count(diff.REMOVED) == len(inside - names)
        assert len(kinds) == len(inside ^ names)
        inside = set(names)
    assert {r.name for r in state.where("currently_in_zone").collect()} == inside
    _, again = step(spark, state, sorted(inside), 4, 9)
    assert again.count() == 0


def test_baseline_per_tld(spark):
    state = diff.baseline(staged(spark, ["a.ch"]), F.lit(DAY[0]))
    both = staged(spark, ["a.ch", "b.ch"]).unionByName(staged(spark, ["a.li"], "li"))
    for per_tld, want in ((False, ["a.li", "b.ch"]), (True, ["b.ch"])):
        found = diff.classify(state, both, ["ch", "li"], per_tld)
        assert sorted(r.name for r in diff.events(found, F.lit(DAY[1]), 1).collect()) == want
        assert sorted(r.name for r in diff.new_state(found, F.lit(DAY[1])).where("currently_in_zone").collect()) == ["a.ch", "a.li", "b.ch"]


def test_stage(spark):
    raw = spark.createDataFrame([("A.ch.", "ch"), ("a.ch", "ch"), (" a.ch", "li"), ("", "ch"), ("b c.ch", "ch"), ("x" * 300, "ch"), (None, "ch")],
                                "raw_name string, tld string")
    assert [(r.name, r.tld) for r in staging.stage(raw).collect()] == [("a.ch", "ch")]
    assert {r.tld: r.malformed for r in staging.rejected(raw).collect()} == {"ch": 2, "li": 0}


def test_validation(spark):
    expected = spark.createDataFrame([("ch", True), ("li", True), ("se", False), ("no", True)], "tld string, complete boolean")
    stats = spark.createDataFrame([("ch", 4), ("li", 3), ("se", 1)], "tld string, name_count long")
    rows = staged(spark, ["a.ch", "b.ch"]).unionByName(staged(spark, ["a.li"], "li")).unionByName(staged(spark, ["a.se"], "se"))
    found = {r.tld: (r.accepted, r.reason) for r in staging.validate(rows, expected, stats).collect()}
    assert found == {"ch": (True, "ok"), "li": (False, "shrunk"), "se": (False, "incomplete"), "no": (False, "empty")}
    assert not staging.all_accepted(staging.validate(rows, expected, stats))


def test_due_and_stats(spark):
    stats = spark.createDataFrame([("ch", 5, DAY[1]), ("li", 5, DAY[0])], "tld string, name_count long, transferred_at timestamp")
    expected = spark.createDataFrame([("ch",), ("li",), ("se",)], "tld string")
    assert sorted(r.tld for r in staging.due(expected, stats, F.lit(DAY[1])).collect()) == ["li", "se"]
    new = spark.createDataFrame([("ch", 9, DAY[2]), ("se", 1, DAY[2])], "tld string, name_count long, transferred_at timestamp")
    assert {r.tld: r.name_count for r in staging.record_stats(stats, new).collect()} == {"ch": 9, "li": 5, "se": 1}
