"""Queries on the whole zone, words in all scripts, against plain versions."""

import re

import idna
import pytest

import __spark_entry__
from zonewatch.functions import confusables
from zonewatch.plans import wordzone

TEXTS = [("Der Fluß im Grünen, schön wie Zürich; über naïve Brücken", "src0"), ("thаnedble cоop coop ŝipo москва thintion ½ab", "src1"),
         ("Élan vital: thé, thé glacé; house of straße", "src8"), ("εллада ｆullwidth words, plain words", "src9"), (None, "src1"), ("ab", None), ("xyz", None)]


def a_label(x):
    if x.isascii():
        return x
    try:
        return idna.encode(x, uts46=True).decode("ascii")
    except idna.IDNAError:
        return x


def shown(x):
    try:
        return idna.decode(x) if "xn--" in x else x
    except (idna.IDNAError, UnicodeError):
        return x


def skeleton(x):
    x = shown(x).lower()
    for seq, letter in confusables.SEQUENCES.items():
        x = x.replace(seq, letter)
    single = {**confusables.ASCII_LOOKALIKES, **confusables.LOOKALIKES}
    return "".join(single.get(c, c) for c in x).replace("ß", "ss")


def labels():
    """{label: sources}, None for the squats' source."""
    found = {}
    for text, source in TEXTS:
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if 3 <= len(x) <= 63]
        for x in w + [f"{a}-{b}" for a, b in zip(w, w[1:])]:
            found.setdefault(a_label(x), set()).add(source or "")
    for x in wordzone.SQUATS + wordzone.IDN_SQUATS:
        found.setdefault(a_label(x), set()).add(None)
    return found


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zone"))
    spark.createDataFrame(TEXTS, "text string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def run(spark, name, folder):
    return __spark_entry__.queries()[name](spark, folder).collect()


def test_labels_and_skeletons(spark, folder):
    got = {r.label: r.skeleton for r in run(spark, "whole_skeleton_fold", folder)}
    assert got == {x: skeleton(x) for x in labels()}
    assert "xn--zrich-kva" in got and got["xn--zrich-kva"] == "zurich"


def test_staged_and_displayed(spark, folder):
    want = {f"{x}.{'li' if len(x) % 10 == 0 else 'ch'}" for x, s in labels().items() if s != {"src0"}}
    assert sorted(r.name for r in run(spark, "whole_zone_stage_dedup", folder)) == sorted(want)
    got = {(r.name, r.display, r.is_homograph) for r in run(spark, "whole_display_names", folder)}
    assert got == {(x, shown(x), not shown(x).isascii()) for x in want}


def test_homoglyphs(spark, folder):
    got = {(r.label, r.brand) for r in run(spark, "whole_squat_homoglyph", folder)}
    want = {(x, b) for x in labels() for b in wordzone.BRANDS if x != b and skeleton(x) == skeleton(b)}
    assert got == want and sum(x.startswith("xn--") for x, _ in got) > 8
    domains = {x for r in run(spark, "whole_match_by_brand", folder) for x in r.domains.split(",")}
    assert "cоор.ch" in domains and not any(x.startswith("xn--") for x in domains)


def test_every_query_has_a_whole_zone(spark, folder):
    names = __spark_entry__.queries()
    assert all(f"whole_{x}" in names for x in __spark_entry__.plans.QUERIES)
