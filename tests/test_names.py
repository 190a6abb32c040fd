import pytest
from pyspark.sql import functions as F

from zonewatch.functions import confusables, lexical, names


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("c"))).collect()]


def test_normalise(spark):
    raw = ["  Example.CH. ", "\tfoo.ch..", "Zürich.ch", "xn--zrich-kva.ch", "www.ch", "", "_x.münchen.ch", None]
    assert values(spark, raw, names.normalise) == [
        "example.ch", "foo.ch", "xn--zrich-kva.ch", "xn--zrich-kva.ch", "www.ch", "", "_x.xn--mnchen-3ya.ch", None]


def test_display(spark):
    assert values(spark, ["xn--zrich-kva.ch", "plain.ch", "xn--.ch", None], names.display) == ["zürich.ch", "plain.ch", "xn--.ch", None]


def test_parts(spark):
    assert values(spark, ["a.b.ch", "ch", ""], names.tld_of) == ["ch", "", ""]
    assert values(spark, ["a.b.ch", "ch", ""], names.label_of) == ["a.b", "ch", ""]
    assert values(spark, ["a.ch", "", "a b.ch", "x" * 254], names.plausible) == [True, False, False, False]


@pytest.mark.parametrize("a,b", [("examp1e", "example"), ("rnodern", "modem"), ("vvow", "wow"), ("click", "dick"), ("ехаmple", "example"),
                                 ("ｅxample", "example"), ("café", "cafe"), ("straße", "strasse"), ("xn--caf-dma.ch", "cafe")])
def test_equal_skeletons(spark, a, b):
    x, y = values(spark, [a, b], confusables.skeleton)
    assert x == y


def test_skeleton_is_left_to_right(spark):
    assert values(spark, ["c1ark", "rnrn", "vvv"], confusables.skeleton) == ["clark", "mm", "wv"]
    assert values(spark, ["examp1e", "ехаmple", "xn--caf-dma"], confusables.is_homograph) == [False, True, True]


def test_lexical(spark):
    def feature(name, *texts):
        return values(spark, texts, lambda c: lexical.extract(c)[name])

    assert feature("entropy", "aaaa", "ab", "") == pytest.approx([0, 1, 0])
    assert feature("entropy", "banana") == pytest.approx([1.459148], abs=1e-6)
    assert feature("vowel_ratio", "coop", "") == [0.5, 0]
    assert feature("unique_char_ratio", "aaaa1111", "") == [0.25, 0]
    assert feature("max_consonant_run", "strengths", "aeiou", "", "a-bc-d") == [5, 0, 0, 2]
    assert feature("digit_ratio", "a1b2") == [0.5]
    assert feature("hyphen_count", "a-b-c", "abc") == [2, 0]
    assert feature("is_idn", "xn--abc", "é", "abc") == [True, True, False]


def test_randomness(spark):
    low, high, none = values(spark, ["banana", "xkqzvbnwrt", ""], lexical.randomness)
    assert 0 < low < high <= 1 and none == 0
    known = values(spark, ["xkqzvbnwrt"], lambda c: lexical.randomness(c, F.lit(0.0)))[0]
    assert known == pytest.approx(0.30 * min(1, 3.321928 / 4.8) + 0.2 + 0.15 + 0.35, abs=1e-5)
