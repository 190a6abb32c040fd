"""Lexical features of a label as column expressions; the entropy goes through Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ceilings and weights of the randomness score (fixed values).
ENTROPY_CEILING, RUN_CEILING, VOWEL_FLOOR = 4.8, 5.0, 0.35
WEIGHTS = {"entropy": 0.30, "run": 0.20, "vowels": 0.15, "ngram": 0.35}

FEATURES = ("length", "entropy", "digit_ratio", "vowel_ratio", "consonant_ratio", "hyphen_count",
            "max_consonant_run", "unique_char_ratio", "is_idn")


def _kinds(c: Column) -> Column:
    return F.array_distinct(F.split(c, ""))


def _share(c: Column, outside: str) -> Column:
    """The share of characters that aren't in the negated class."""
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, outside, "")) / F.length(c)).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def entropy(texts: pd.Series) -> pd.Series:
    """Shannon entropy in bits a character. In Arrow batches: all texts' characters are sorted at once, which
    takes a tenth of the time of counting each text's by higher-order functions."""
    known = texts.dropna()
    sizes = known.str.len().to_numpy(np.int64)
    codes = np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    kinds, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) << 21 | codes, return_counts=True)
    share = times / sizes[kinds >> 21]
    return pd.Series(np.bincount(kinds >> 21, weights=-share * np.log2(share), minlength=len(sizes)), known.index).reindex(texts.index)


def extract(label: Column) -> dict[str, Column]:
    """Every feature by name; the empty label has zeros."""
    c = F.lower(label)
    n = F.length(c)
    return {
        "length": n,
        "entropy": entropy(c),
        "digit_ratio": _share(c, "[^0-9]"),
        "vowel_ratio": _share(c, "[^aeiou]"),
        "consonant_ratio": _share(c, "[^bcdfghjklmnpqrstvwxyz]"),
        "hyphen_count": n - F.length(F.replace(c, F.lit("-"), F.lit(""))),
        "max_consonant_run": F.array_max(F.transform(F.split(c, "[^bcdfghjklmnpqrstvwxyz]+"), F.length)),
        "unique_char_ratio": F.when(n > 0, F.size(_kinds(c)) / n).otherwise(0.0),
        "is_idn": F.startswith(c, F.lit("xn--")) | c.rlike(r"[^\x00-\x7F]"),
    }


def rounded(label: Column, found: dict[str, Column] | None = None) -> list[Column]:
    """The features as exported: fractions to four places, half to even. `found` has them where they are at hand."""
    found = found or extract(label)
    return [(F.bround(v, 4) if k == "entropy" or k.endswith("ratio") else v).alias(k) for k, v in found.items()]


def randomness(label: Column, likelihood: Column | None = None, found: dict[str, Column] | None = None) -> Column:
    """How unlike a word, 0 to 1. Without a likelihood (or where it is null, no model being trained)
    the other three parts share its weight. `found` has the features where they are at hand."""
    f = found or extract(label)
    parts = {
        "entropy": F.least(F.lit(1.0), f["entropy"] / ENTROPY_CEILING),
        "run": F.least(F.lit(1.0), f["max_consonant_run"] / RUN_CEILING),
        "vowels": F.greatest(F.lit(0.0), VOWEL_FLOOR - f["vowel_ratio"]) / VOWEL_FLOOR,
    }
    three = sum(WEIGHTS[k] for k in parts)
    alone = sum((F.lit(WEIGHTS[k] / three) * v for k, v in parts.items()), F.lit(0.0))
    score = alone
    if likelihood is not None:
        together = sum((F.lit(WEIGHTS[k]) * v for k, v in parts.items()), F.lit(0.0)) + WEIGHTS["ngram"] * (1 - likelihood)
        score = F.when(likelihood.isNull(), alone).otherwise(together)
    return F.when(f["length"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
