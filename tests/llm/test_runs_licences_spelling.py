"""Periodic runs, licence scans and spelling variants against plain versions."""

import random

import pytest

from zonewatch.llm import entries, licenses, periodic, spelling

from .texts import documents, empty


def runs_by_hand(w, min_length=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            start = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i > start and i - start + q >= max(min_length, exponent * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_texts():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            letters = "abcde"[:rng.randint(1, 4)]
            w = [rng.choice(letters) for _ in range(rng.randint(0, 50))]
            for _ in range(rng.randint(0, 3)):
                cycle = [rng.choice(letters) for _ in range(rng.randint(1, 9))] * rng.randint(2, 7)
                at = rng.randint(0, len(w))
                w[at:at] = cycle[:rng.randint(1, len(cycle))]
            texts.append(w)
        for exponent, least in ((4, 6), (3, 4), (5, 12)):
            assert periodic.runs_of(texts, least, exponent) == [runs_by_hand(w, least, exponent) for w in texts]


def test_long_texts_stay_near_linear():
    """Texts of 100,000 words with one long run, with one near each word, and with the gram of every place repeated."""
    assert periodic.runs_of([["a"] * 100_000]) == [[(0, 100_000, 1)]]
    assert periodic.runs_of(["x A B C D E".split() * 20_000]) == [[(0, 120_000, 6)]]
    many = [c for i in range(15_000) for c in (f"x{i}", *"AAAAAA")]
    assert periodic.runs_of([many]) == [[(7 * i + 1, 6, 1) for i in range(15_000)]]


def test_runs_as_columns(spark):
    rows = [(1, None), (2, ""), (3, "one\x0btwo\x1cthree\xa0x"), (4, "so " + "ha ha ho " * 5 + "end"), (4, "no no no no no no"), (None, "b " * 6)]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, runs string")
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.found], r.collapsed) for r in
             periodic.find(df.withColumnRenamed("runs", "own"), ["doc_id"]).withColumnRenamed("runs", "found").collect()]
    want = [(i, len((t or "").encode().split()), runs_by_hand((t or "").encode().split()),
             b" ".join(periodic.collapse((t or "").encode().split(), runs_by_hand((t or "").encode().split()))).decode()) for i, t in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert (4, 17, [(1, 15, 3)], "so ha ha ho end") in found
    assert periodic.find(empty(spark), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        periodic.find(df, ["doc_id"], exponent=2)


def hits(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.kept.doc_id: (r.n_words, [(h.label, h.exact, h.start) for h in r.hits], r.below) for r in licenses.scan(df, ["doc_id"], **more).collect()}


def test_licence_notices(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    found = hits(spark, [None, "", "Licensed under CC BY-NC 4.0.", "cc by cc by CC-BY", grant, grant.replace("free of charge", "wholly free of any charge"),
                         "Permission is granted.", "İ all rights reserved. ALL RIGHTS RESERVED", "the GNU General Public License, version 3", "allrights reserved"])
    assert found[0] == found[1] == (0, [], 0.0)
    assert found[2][:2] == (7, [("cc-by", True, 2), ("cc-by-nc-4.0", False, 0)])
    assert [h for h in found[3][1] if h[1]] == [("cc-by", True, 0), ("cc-by", True, 2), ("cc-by", True, 4)]
    assert found[4][1] == [("mit", False, 0)]
    assert [h[0] for h in found[5][1]] == ["mit"]  # two words more in the middle: two diagonals, one notice
    assert found[6][1] == [] and found[6][2] > 0
    assert found[7][1] == [("reserved", True, 1), ("reserved", True, 4)]
    assert [h[0] for h in found[8][1] if h[1]] == ["gpl"]
    assert found[9][1] == []


def test_licence_templates(spark):
    with pytest.raises(ValueError):
        licenses.grams((("one", "x"),))
    found = hits(spark, ["a b c d", "a b x c d", "b c"], phrases=(("b c", "bc"),), notices=(("a b c d", "abcd"),), threshold=0.6)
    assert found[0][1] == [("abcd", False, 0), ("bc", True, 1)]
    assert found[1][1] == [("abcd", False, 0)]
    assert found[2][1] == [("bc", True, 0)]


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def forms_by_hand(counts, ratio=2):
    links = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {w: min(links[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: v if v is not None and counts[v] >= ratio * counts[w] else None for w, v in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, n, len(links[w]), form[w], counts.get(form[w]), root(w)) for w, n in counts.items()}


@pytest.mark.parametrize("block", [8, 60, spelling.BLOCK])
def test_forms_by_hand(spark, block):
    """One beginning for all words, so small blocks make many tiles; chains of forms; ties; letters beyond ASCII."""
    rng = random.Random(block)
    words = {"hatte" + "".join(rng.choice("aé") for _ in range(rng.randint(0, 6))) for _ in range(80)}
    words |= {"".join(rng.choice("abç") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"longer" + "x" * 3000, "longer" + "x" * 3001}
    counts = {w: rng.choice([3, 4, 7, 15, 31, 64]) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = [tuple(r) for r in spelling.forms(df, block=block).collect()]
    assert len(found) == len(counts) and set(found) == forms_by_hand(counts)


def test_pairs_once(spark):
    words = sorted({a + b + c for a in "abc" for b in ("", "a", "b") for c in ("xyz", "xya")})
    found = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), block=12).collect()]
    assert sorted(found) == sorted((a, b) for a in words for b in words if a < b and near(a, b))


def test_vocabulary_of_awkward_texts(spark):
    df = documents(spark)
    runs = spelling.letter_runs(df)
    assert all(r.run and not any("A" <= c <= "Z" for c in r.run) for r in runs.collect())
    assert spelling.forms(spelling.vocabulary(runs.withColumnRenamed("run", "word"))).count() > 10
    nothing = spelling.vocabulary(spelling.letter_runs(empty(spark)).withColumnRenamed("run", "word"))
    assert spelling.forms(nothing).count() == 0


def test_registered_with_sql():
    for name in ("op11_periodic_runs", "op12_license_scan", "op13_spelling_variants"):
        assert name in entries.QUERIES and name in entries.ORACLE_SQL
