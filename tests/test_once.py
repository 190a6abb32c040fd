"""What is read, coded or looked up once, where it was more often."""

import idna
import pytest
from pyspark.sql import functions as F

from zonewatch.functions import lexical, names
from zonewatch.operators import scoring, watchlist
from zonewatch.plans import queries, wordzone


def plan(df) -> str:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_assess_reads_its_labels_once(spark, tmp_path):
    path = f"file://{tmp_path}/labels"
    spark.createDataFrame([("thatim", "ch"), ("zzz", "li")], "label string, tld string").write.parquet(path)
    found = scoring.assess(spark.read.parquet(path), watchlist.Watchlist.of(["thatin"]))
    assert f"{tmp_path}/labels" not in plan(found)  # they were read before, and written
    assert {r["label"]: r["n_watchlist"] > 0 for r in found.collect()} == {"thatim": True, "zzz": False}


def test_analyse_keeps_what_each_list_found(spark):
    rows = spark.createDataFrame([("thatim", "ch"), ("c00p", "ch"), ("zzz", "ch")], "label string, tld string")
    lists = {"a": watchlist.Watchlist.of(["thatin"]), "b": watchlist.Watchlist.of(["coop"]), "none": watchlist.Watchlist.of([])}
    fires = {(r["label"], r["rule"]) for r in scoring.analyse(rows, lists).collect() if r["fires"]}
    assert fires == {("thatim", "a"), ("c00p", "b")} and scoring.analyse(rows, lists).count() == 9


def test_entropy_in_batches(spark):
    rows = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("aé中\U0001F600",), (None,)], "c string")
    assert [r[0] for r in rows.select(lexical.entropy(F.col("c"))).collect()] == [0.0, 0.0, 1.0, 2.0, None]
    assert "ArrowEvalPython" in plan(rows.select(lexical.entropy(F.col("c"))))


@pytest.mark.parametrize("kind", ["typo", "keyboard", "bitsquat", "hyphenation"])
def test_labels_longer_than_any_brand_have_no_probe(spark, kind):
    for most in (1, 2):
        w = watchlist.Watchlist.of(["thatin", "orantion"], methods=(kind,), max_distance=most)
        rows = spark.createDataFrame([("a" * 11 + "-" + "b" * 11,), ("thatin",)], "label string")
        n = [r[0] for r in rows.select(F.size(watchlist._probes([w], F.col("label"), None))).collect()]
        assert n[0] == 0 and (n[1] > 0 or kind == "hyphenation")


def test_plain_names_are_coded_as_by_the_library():
    words = ["größe", "straße-coop", "élève", "a-ñ9", "ÿ", "a" * 60 + "é", "ab.élève.ch", "é" * 70, "a--é", "-é", "é-", "É", "cооp", "é"]
    for x in words:
        plain = names._plain_ascii(x)
        if plain is not None:
            assert plain == idna.encode(x, uts46=True).decode("ascii")
            assert names._plain_unicode(plain) == idna.decode(plain)
    assert [names._plain_ascii(x) is not None for x in words] == [True] * 5 + [False, True] + [False] * 7
    assert all(names.punycode(x) == x.encode("punycode").decode("ascii") for x in words + ["中文", "\U0001F600b\U0001F600"])
    for x in ("xn--a", "xn--abc-", "xn--gre-6ka8i", "xn--GRE-6ka8i"):
        try:
            there = idna.decode(x)
        except (idna.IDNAError, UnicodeError):
            there = None
        assert names._plain_unicode(x) in (None, there)


@pytest.mark.parametrize("name", ["zone_diff_counts", "due_tlds", "status_totals", "ngram_merged", "snapshot_stats", "match_by_brand"])
@pytest.mark.parametrize("whole", [False, True])
def test_documents_are_read_once(spark, sf_dir, name, whole):
    query = queries.WHOLE[f"whole_{name}"] if whole else queries.QUERIES[name]
    text = plan(query(spark, sf_dir))
    assert text.count("documents.parquet") <= 1


def test_written_labels_of_a_whole_zone(spark, sf_dir):
    once = wordzone.Prepared.of(spark, wordzone.Whole(sf_dir))
    assert isinstance(once, wordzone.Whole) and wordzone.Prepared.of(spark, once) is once
    assert wordzone.labels(spark, once).count() == wordzone.labels(spark, wordzone.Whole(sf_dir)).count()


def test_pairs_that_cannot_be_within_the_distance_are_dropped_natively(spark):
    import random
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 7)))
    pairs = [(word(), word()) for _ in range(4000)]
    for most in (2, 3):
        near = spark.createDataFrame(pairs, "a string, b string").select("a", "b", watchlist.maybe_within(F.col("a"), F.col("b"), most).alias("near")).collect()
        within = [watchlist.osa(r["a"], r["b"], most) is not None for r in near]
        assert all(r["near"] for r, x in zip(near, within) if x)
        assert sum(r["near"] for r in near) < 1.5 * sum(within)
