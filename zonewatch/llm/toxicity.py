"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

`fit` learns from a bounded sample of labelled rows (about `max_rows` ids, by a 64-bit hash; of
several texts of one id the smallest counts, and equal texts count once). A fifth of its texts is set
apart for calibration before anything is learned. From the others comes the lexicon: words, and word
beginnings of four and five letters (a family of insults often shares one), that toxic texts hold far
more often than others; at most `max_terms` stay. Then the features of each text: lexicon densities,
hits near a second-person word, capitals, punctuation and obfuscation rates. Trees are grown on the
same texts, and isotonic regression is fitted to their answers on those set apart.

Scoring is one pass over the texts for the features (the lexicon, at most `max_terms` strings, is
broadcast) and then Spark's own model transform. Null and empty texts have all features 0 and get
the score of such a text. If the sample lacks one of the classes, every score is the share of toxic
rows in it (0 without any). Several labels of one id: the highest counts; null ids and labels teach
nothing. Repeated rows are scored each by itself; an empty table gives no rows; other columns are
ignored, whatever their names. Very long texts are read a piece at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate, hash_fraction, lean, pieces, save

#: Second-person words in the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself ur u du dich dir dein deine deinen euch ihr ihre tu te toi ton ta tes "
    "vous votre vos ti tus usted ustedes vosotros vuestro".split())

FEATURES = ("hit_words", "hit_rate", "hit_kinds", "word_hits", "prefix_hits", "max_weight", "sum_weight", "near_you",
            "you_rate", "capitals", "shouting", "exclaims", "punctuation", "obfuscated", "repeats", "log_words")

#: One letter, look-alikes between letters ("1d!ot", "st*pid"), or letters spaced out ("i d i o t").
_WORD = r"[^\W\d_]+"
#: Tried only where a run of letters begins, and nothing is given back: a long run costs its length once.
_ODD = r"(?<![^\W\d_])[^\W\d_]++[0-9@$!*|]++[^\W\d_]++"
_FOLD = str.maketrans("0134578@$!|", "oleastbasil")


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: object = None
    calibration: object = None
    base: float = 0.0
    params: dict = field(default_factory=dict)


def _terms(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]


def _term_counts():
    def count(batches):
        import re

        find, seen = re.compile(_WORD).findall, {}
        for p in batches:
            for text, toxic in zip(p["text"], p["toxic"]):
                for term in {t for w in set(find(text.lower())) for t in _terms(w)}:
                    pair = seen.setdefault(term, [0, 0])
                    pair[int(toxic)] += 1
        yield pd.DataFrame([(t, *c) for t, c in seen.items()], columns=["term", "clean", "toxic"])
    return count


class _Words(dict):
    """What each word met so far says: None, or (weight, whole word 1 / beginning 2 / neither 0, second person)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str):
        weight, kind = max(((self.lexicon[t], 2 if t[-1] == "*" else 1) for t in _terms(word) if t in self.lexicon), default=(0.0, 0))
        you = word in SECOND_PERSON
        if len(self) > 300_000:
            self.clear()
        self[word] = found = (weight, kind, you) if kind or you else None
        return found


def _classes() -> np.ndarray:
    """Of each code point: letter 1, upper case 2, neither letter, digit nor space 4, look-alike symbol 8.
    Those beyond the table are as its last."""
    out = np.zeros(0x40000, np.uint8)
    for i in range(len(out)):
        c = chr(i)
        out[i] = c.isalpha() | c.isupper() << 1 | (not (c.isalnum() or c.isspace())) << 2 | (c in "0123456789@$!*|") << 3
    return out


def _features(shared):
    def start():
        import re

        import pyarrow as pa

        words_of, odd, of, memo = re.compile(_WORD).findall, re.compile(_ODD).findall, _classes(), _Words(shared.value)

        def row(text: str) -> tuple:
            n = whole = beginnings = capitals = shouting = punctuation = odd_words = repeats = 0
            weights, kinds_hit, hit_at, you_at = [], set(), [], []
            for part in pieces(text):  # pieces end at blanks, so no word or run of letters is cut
                if not part:
                    continue
                codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
                kinds = of[np.minimum(codes, len(of) - 1)]
                letter = (kinds & 1).astype(bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], kinds & 1, [0]]).astype(np.int8)))
                upper = np.concatenate([[0], np.cumsum(kinds >> 1 & 1)])
                runs = edge[1::2] - edge[::2]
                shouting += int(((runs > 2) & (upper[edge[1::2]] - upper[edge[::2]] == runs)).sum())
                repeats += int((letter[2:] & (codes[2:] == codes[1:-1]) & (codes[2:] == codes[:-2])).sum())
                capitals += int(upper[-1])
                punctuation += int((kinds >> 2 & 1).sum())
                words = words_of(part.lower())
                odds = odd(part) if ((kinds[1:] & 8).astype(bool) & letter[:-1]).any() else []
                odd_words += len(odds)
                words += [w.lower().translate(_FOLD) for w in odds]
                for j, x in enumerate([memo[w] for w in words], n):
                    if x:
                        weight, kind, you = x
                        if kind:
                            weights.append(weight)
                            hit_at.append(j)
                            kinds_hit.add(words[j - n])
                            whole, beginnings = whole + (kind == 1), beginnings + (kind == 2)
                        if you:
                            you_at.append(j)
                n += len(words)
            n = max(1, n)
            near = 0
            if you_at and hit_at:
                you, hits = np.array(you_at), np.array(hit_at)
                after = np.searchsorted(you, hits)
                gap = np.minimum(np.abs(you[np.minimum(after, len(you) - 1)] - hits), np.abs(hits - you[np.maximum(after - 1, 0)]))
                near = int((gap <= 5).sum())
            return (len(weights), 100 * len(weights) / n, len(kinds_hit), whole, beginnings, max(weights, default=0), sum(weights), near,
                    100 * len(you_at) / n, 100 * capitals / len(text), 100 * shouting / n, 100 * text.count("!") / len(text),
                    100 * punctuation / len(text), 100 * odd_words / n, 100 * repeats / n, np.log1p(n))

        def features(texts):
            rows = np.array([row(t) if t else (0.0,) * len(FEATURES) for t in texts], float)
            return [pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES), pa.array(rows.ravel()))]
        return features
    return start


def features(docs: DataFrame, lexicon: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features): one dense array for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    return annotate(docs, [id_col], text_col, _features(shared), "features array<double>")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_rows: int = 16_000, max_terms: int = 2_000, min_share: float = 0.01,
        min_ratio: float = 6.0, trees: int = 16, depth: int = 3) -> Model:
    """Learn from labelled rows where `learn`, a condition on the id, holds."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(learn)
             .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")))
    n = known.count()
    chosen = known.where(hash_fraction("toxicity", F.col("id")) * n < max_rows)  # about max_rows ids
    # the smallest text of an id, then the smallest id of a text: about max_rows texts, whatever repeats
    sample = save(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
                  .join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
                  .groupBy("text").agg(F.max("toxic").alias("toxic"))
                  .withColumn("apart", hash_fraction("calibrate", F.col("text")) >= 0.8), "toxic-sample")
    sums = {(r["apart"], int(r["toxic"])): r["count"] for r in sample.groupBy("apart", "toxic").count().collect()}
    clean, toxic = sums.get((False, 0), 0), sums.get((False, 1), 0)
    base = sum(v for (_, t), v in sums.items() if t) / max(1, sum(sums.values()))
    if not clean or not toxic:
        return Model({}, base=base)
    least = max(3.0, min_share * toxic)
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    terms = (sample.where("NOT apart").select("text", "toxic").mapInPandas(lean(_term_counts()), "term string, clean long, toxic long")
             .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
             .where((F.col("toxic") >= least) & (weight >= np.log(min_ratio)))
             .select("term", weight.alias("weight")).orderBy(F.desc("weight"), "term").limit(max_terms))
    model = Model({r["term"]: r["weight"] for r in terms.collect()}, base=base)
    marks = F.struct("apart", F.col("toxic").cast("double").alias("label"))
    rows = save(features(sample.select("text", marks.alias("marks")), model.lexicon, "marks")
                .select("marks.*", array_to_vector("features").alias("features")), "toxic-features")
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, minInstancesPerNode=3)
    model.trees = gbt.fit(rows.where("NOT apart").coalesce(4))
    margin = model.trees.transform(rows.where("apart")).select("label", vector_to_array("probability")[1].alias("p"))
    if margin.limit(1).count():
        model.calibration = IsotonicRegression(featuresCol="p", labelCol="label").fit(margin.coalesce(1))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) for every row, from its whole text alone. The id may be any column, a
    struct of a whole row too."""
    if model.trees is None:
        return docs.select(id_col, F.lit(model.base).alias("score"), F.lit(int(model.base >= threshold)).alias("predicted"))
    rows = features(docs, model.lexicon, id_col, text_col)
    # the models' own columns could have the id's name, so that travels under one that they don't use
    rows = rows.select(F.col(id_col).alias("kept"), array_to_vector("features").alias("features"))
    out = model.trees.transform(rows).select("kept", vector_to_array("probability")[1].alias("p"))
    if model.calibration is not None:
        # between steps the calibrated value can be flat; a hundredth of the margin keeps the order
        out = model.calibration.transform(out).withColumn("p", 0.99 * F.col("prediction") + 0.01 * F.col("p"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))
    return out.select(F.col("kept").alias(id_col), value.alias("score"), (value >= threshold).cast("int").alias("predicted"))
