"""Toxicity against plain versions of its features, its lexicon and its calibration."""

import math
import random
import re

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from zonewatch.llm import toxicity
from zonewatch.llm.common import hash_fraction

LETTERS, ODD = re.compile(r"[^\W\d_]+"), re.compile(r"[^\W\d_]+[0-9@$!*|]+[^\W\d_]+")


def terms(word):
    return [word] + [word[:n] + "*" for n in (4, 5) if len(word) > n]


def plain_features(text, lexicon):
    """One text at once, character by character and word by word."""
    if not text:
        return [0.0] * len(toxicity.FEATURES)
    letter = [c.isalpha() for c in text]
    words = [w for w in LETTERS.findall(text.lower())]
    odd = ODD.findall(text)
    words += [w.lower().translate(toxicity._FOLD) for w in odd]
    hits = []
    for place, w in enumerate(words):
        found = [(lexicon[t], 2 if t.endswith("*") else 1) for t in terms(w) if t in lexicon]
        if found:
            hits.append((place, w, *max(found)))
    you = [place for place, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    shouting = sum(len(r.group()) > 2 and all(c.isupper() for c in r.group()) for r in re.finditer(r"[^\W\d_]+", text))
    repeats = sum(letter[i] and text[i] == text[i - 1] == text[i - 2] for i in range(2, len(text)))
    n = max(1, len(words))
    return [len(hits), 100 * len(hits) / n, len({w for _, w, _, _ in hits}), sum(k == 1 for *_, k in hits), sum(k == 2 for *_, k in hits),
            max((x for _, _, x, _ in hits), default=0), sum(x for _, _, x, _ in hits), sum(any(abs(p - y) <= 5 for y in you) for p, *_ in hits),
            100 * len(you) / n, 100 * sum(c.isupper() and c.isalpha() for c in text) / len(text), 100 * shouting / n, 100 * text.count("!") / len(text),
            100 * sum(not (c.isalnum() or c.isspace()) for c in text) / len(text), 100 * len(odd) / n, 100 * repeats / n, math.log1p(n)]


def random_text(rng):
    words = ["zorgoff", "Quazzle", "blargy", "you", "Dich", "the", "GREEN", "z0rgoff", "b!argy", "sooo", "1d!ot", "état", "12", "x_y", "HA", "HAA!!", "st*p", "ÉTÉ"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", ", ", "! ", "-", ""]) for _ in range(rng.randint(0, 60)))


def test_features(spark):
    rng, lexicon = random.Random(1), {"zorgoff": 3.0, "quaz*": 2.5, "blarg*": 2.0, "blargy": 1.5, "stop": 1.0, "idiot": 4.0}
    texts = [random_text(rng) for _ in range(300)] + ["", None, "you " * 9 + "zorgoff", "zorgoff " * 3000 + "you"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: list(r.features) for r in toxicity.features(df, lexicon).collect()}
    for i, text in enumerate(texts):
        assert found[i] == pytest.approx(plain_features(text, lexicon)), (i, text)


def plain_isotonic(points):
    """Pools of neighbours that violate the order, as (from, to, mean)."""
    pools, at = [], {}
    for x, y in points:  # equal margins are one point
        at.setdefault(x, []).append(y)
    for x in sorted(at):
        pools.append([x, x, sum(at[x]), len(at[x])])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, high, total, n = pools.pop()
            pools[-1] = [pools[-1][0], high, pools[-1][2] + total, pools[-1][3] + n]
    return [(low, high, total / n) for low, high, total, n in pools]


def test_lexicon_and_calibration(spark):
    rng = random.Random(3)
    filler = [a + b + c for a in "bdfg" for b in "aeiou" for c in ("lor", "nim", "sta", "rek")]
    rows, labels = [], []
    for i in range(700):
        words = [rng.choice(filler) for _ in range(40)]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else int(rng.random() < 0.1)):
            words[rng.randrange(40)] = rng.choice(["zorgoff", "quazzlex", "quazzley", "blarg"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic != (rng.random() < 0.05))))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, F.col("doc_id") % 4 != 2)
    sample = [(r.text, r.toxic, r.apart) for r in docs.join(marks, "doc_id").where("doc_id % 4 != 2").select(
        "text", "toxic", (hash_fraction("calibrate", F.col("text")) >= 0.8).alias("apart")).collect()]
    counts, sums = {}, [0, 0]
    for text, toxic, apart in sample:
        if not apart:
            sums[toxic] += 1
            for term in {t for w in set(LETTERS.findall(text.lower())) for t in terms(w)}:
                counts.setdefault(term, [0, 0])[toxic] += 1
    weights = {t: math.log((b + 0.5) / (sums[1] + 1)) - math.log((a + 0.5) / (sums[0] + 1)) for t, (a, b) in counts.items() if b >= max(3.0, 0.01 * sums[1])}
    plain = {t: w for t, w in weights.items() if w >= math.log(6.0)}
    assert model.lexicon.keys() == plain.keys() and model.lexicon == pytest.approx(plain) and "quaz*" in plain

    apart = [(t, y) for t, y, a in sample if a]
    vectors = spark.createDataFrame([([float(x) for x in plain_features(t, plain)], float(y)) for t, y in apart], "f array<double>, label double").select("label", array_to_vector("f").alias("features"))
    margins = [(r.p, r.label) for r in model.trees.transform(vectors).select("label", vector_to_array("probability")[1].alias("p")).collect()]
    pools = plain_isotonic(margins)
    answers = model.calibration.transform(spark.createDataFrame([(p,) for p, _ in margins], "p double")).collect()
    for r in answers:
        assert r.prediction == pytest.approx(next(mean for low, high, mean in pools if low - 1e-12 <= r.p <= high + 1e-12), abs=1e-9)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    of_text = {t: (0.99 * r.prediction + 0.01 * p) for (t, _), r, (p, _) in zip(apart, answers, margins)}
    for i, text in rows:
        if text in of_text:
            assert scores[i] == pytest.approx(of_text[text])
