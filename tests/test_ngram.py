import math
from collections import Counter

import pytest

from pyspark.sql import functions as F

from zonewatch.operators import diff, ngram
from zonewatch.plans import jobs

WORDS = ["bank", "hotel", "garage", "schule", "restaurant", "blumen", "praxis"]


def labels(spark, words, tld="ch"):
    return spark.createDataFrame([(w, tld) for w in words], "label string, tld string")


def test_counts_and_stats(spark):
    counts, stats = ngram.build(labels(spark, WORDS * 3))
    want = Counter(g for w in WORDS * 3 for p in [f"^^{w}^^"] for g in [p[i:i + 3] for i in range(len(p) - 2)])
    assert {r.ngram: r.cnt for r in counts.collect()} == dict(want)
    row = stats.first()
    total, vocab = sum(want.values()), len(want)
    assert (row.total_ngrams, row.vocab_size, row.sample_count) == (total, vocab, 21)
    avg = [sum(math.log((want[p[i:i + 3]] + 1) / (total + vocab)) for i in range(len(p) - 2)) / (len(p) - 2) for w in WORDS for p in [f"^^{w}^^"]]
    mean = sum(avg) / len(avg)
    assert row.mean_log_prob == pytest.approx(mean)
    assert row.std_log_prob == pytest.approx(math.sqrt(sum((a - mean) ** 2 for a in avg) / len(avg)))


def test_likelihood(spark):
    counts, stats = ngram.build(labels(spark, WORDS * 3))
    rows = {(r.label, r.tld): r.likelihood for r in ngram.likelihood(labels(spark, ["bank", "xqzkw"]).unionByName(labels(spark, ["bank"], "se")), counts, stats).collect()}
    assert rows["bank", "ch"] > rows["xqzkw", "ch"] and rows["bank", "se"] == 0.5


def test_batches_add_up(spark):
    a, b = labels(spark, WORDS[:3]), labels(spark, WORDS[3:])
    both = {(r.ngram, r.cnt) for r in ngram.merge(ngram.count(a), ngram.count(b)).collect()}
    assert both == {(r.ngram, r.cnt) for r in ngram.count(a.unionByName(b)).collect()}


def test_degenerate_and_empty(spark):
    _, stats = ngram.build(labels(spark, ["same"] * 4))
    assert stats.first().std_log_prob in (1.0, pytest.approx(0, abs=1e-6))
    assert ngram.build(labels(spark, []))[1].count() == 0
    assert ngram.count(labels(spark, [""]), order=1).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_one_pass_equals_the_join(spark, order, monkeypatch):
    """Packed n-grams and joined ones score alike: letters of all planes, empty labels, TLDs without a model."""
    words = labels(spark, [*WORDS, "", "zürich", "x", "\U0001F600\U00020000", "^a^", "straße"]).unionByName(labels(spark, ["bank", "bank", "berg"], "li"))
    counts, stats = ngram.build(words, order)
    asked = words.unionByName(labels(spark, ["xqz", "", "hotelbank"])).unionByName(labels(spark, ["bank", ""], "se")).distinct()
    rows = lambda: {(r.label, r.tld): r.avg_log_prob for r in ngram.avg_log_prob(asked, counts, stats, order).collect()}
    fast, (total, vocab) = rows(), stats.where("tld = 'ch'").select("total_ngrams", "vocab_size").first()
    assert (ngram.scorer(counts, stats, order) is None) == (order > 3)
    monkeypatch.setattr(ngram, "BROADCAST_NGRAMS", 0)
    joined = rows()
    assert fast.keys() == joined.keys() and len(fast) == asked.count()
    for key, value in fast.items():
        assert value == (None if joined[key] is None else pytest.approx(joined[key])), key
    want = Counter(g for w in [*WORDS, "", "zürich", "x", "\U0001F600\U00020000", "^a^", "straße"] for p in ["^" * (order - 1) + w + "^" * (order - 1)]
                   for g in [p[i:i + order] for i in range(len(w) + order - 1)])
    assert (total, vocab) == (sum(want.values()), len(want))


def test_likelihood_without_shuffle(spark, monkeypatch):
    """Rows keep their columns and number, whichever way they are scored."""
    counts, stats = (spark.createDataFrame(df.collect(), df.schema) for df in ngram.build(labels(spark, WORDS * 3)))
    rows = spark.createDataFrame([(w, t, i) for i, (w, t) in enumerate([("bank", "ch"), ("bank", "ch"), ("xqzkw", "ch"), ("bank", "se"), (None, "ch"), ("bank", None)])],
                                 "label string, tld string, n int")
    fast = ngram.with_likelihood(rows, F.col("label"), counts, stats)
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange hashpartitioning" not in plan
    found = {r.n: r.likelihood for r in fast.collect()}
    monkeypatch.setattr(ngram, "BROADCAST_NGRAMS", 0)
    joined = {r.n: r.likelihood for r in ngram.with_likelihood(rows, F.col("label"), counts, stats).collect()}
    assert found[0] == found[1] > found[2] and found[3] is None and found[4] == 0.5 and found[5] is None
    assert {k: v and round(v, 9) for k, v in found.items()} == {k: v and round(v, 9) for k, v in joined.items()}


@pytest.mark.parametrize("words,sample", [([f"w{i}" for i in range(3000)], 500), ([f"w{i}" for i in range(30)] + ["same"] * 2000, 100),
                                          (["same"] * 300, 100), (["a", "b", "b"], 5), (["b"] * 40 + [f"w{i}" for i in range(400)], 200)])
def test_sample_is_the_first_by_md5(spark, words, sample):
    """Exactly the first labels in order of md5, those that repeat as often as they fit."""
    import hashlib

    rows = labels(spark, words).unionByName(labels(spark, words[:3], "li"))
    found = ngram.first_by_md5(rows, ngram.sizes_of(ngram.tally(rows)), sample).collect()
    for tld, own in (("ch", words), ("li", words[:3])):
        first = Counter(sorted(own, key=lambda w: (hashlib.md5(w.encode()).hexdigest(), w))[:sample])
        assert {r.label: r.times for r in found if r.tld == tld} == dict(first)


def test_model_follows_events(spark):
    """Three runs of added, removed and returned names: the updated model is the one built anew."""
    days = [["bank.ch", "hotel.ch", "a.li"], ["bank.ch", "garage.ch", "a.li", "b.li"], ["hotel.ch", "garage.ch", "b.li", "zürich.ch"], ["bank.ch", "hotel.ch", "neu.se"]]
    rows = lambda names: spark.createDataFrame([(n, n.split(".")[1]) for n in names], "name string, tld string")
    state = diff.baseline(rows(days[0]), F.lit("2026-01-01").cast("timestamp"))
    model = jobs.build_models(state)
    for n, names in enumerate(days[1:], 2):
        at = F.lit(f"2026-01-0{n}").cast("timestamp")
        classified = jobs.write_once(diff.classify(state, rows(names), ["ch", "li", "se"]), "classified")
        state = diff.new_state(classified, at)
        model = jobs.update_models(model, diff.events(classified, at, n), state)
        for updated, anew in zip(model, jobs.build_models(state)):
            assert sorted(map(str, updated.select(sorted(updated.columns)).collect())) == sorted(map(str, anew.select(sorted(anew.columns)).collect()))
