"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and everything but letters becomes one space; its n-grams of 1 to
`max_n` code points are hashed into `n_buckets` buckets. The model is one matrix of smoothed
log-probabilities (buckets x languages), broadcast to the tasks, which score whole batches by
gathering the rows of the buckets present and summing them per text.

`fit` learns from a bounded sample: about `per_lang` rows of each language, chosen by a 64-bit hash
of id and text; equal texts of a language count once. A text's counts are divided by the square root
of their number, so that one very long odd text doesn't make up a language. Counting is a Spark aggregation; a
language's counts reach the driver as one array of floats. The matrix has at most `max_model_bytes`: of
more languages than it can hold, those with most rows are learned (ties: first in order), so a column
with junk in it costs the rarest values, not the job. The number of buckets never depends on the data.

A null text, or one without a letter, is `und` with score 0. With nothing to learn from (an empty
table, no language given), every text is `und`. The score is the prediction's posterior with the
evidence scaled to `evidence` n-grams, so that long texts don't all score 1. Ties go to the language
that sorts first. Repeated rows are scored each by itself; an empty table gives no rows; other
columns are ignored, whatever their names. Very long texts are read a piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate, hash_fraction, lean, small


#: Added to the count of every bucket.
SMOOTHING = 0.01


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (n_buckets, n_langs) log-probabilities, float32
    max_n: int
    evidence: int


def _letters() -> np.ndarray:
    """Which code points are letters; those beyond the table aren't, as its last."""
    return np.fromiter((chr(i).isalpha() for i in range(0x40000)), bool, 0x40000)


def _buckets(text: str, letters: np.ndarray, n_buckets: int, max_n: int, size: int = 1 << 18) -> Iterator[np.ndarray]:
    """The buckets of the text's n-grams, `size` code points at a time; nothing without a letter."""
    text = text.lower()
    space = np.array([32], np.uint64)
    seen, fresh, found = np.empty(0, np.uint64), space, False  # the text's stream begins with a space
    for at in range(0, len(text), size):
        codes = np.frombuffer(text[at:at + size + 1].encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = letters[np.minimum(codes, len(letters) - 1)]
        keep = is_letter.copy()
        keep[:-1] |= is_letter[1:]  # of a run of others, the last before a letter stays as a space
        kept = np.where(is_letter, codes, 32)[:size][keep[:size]].astype(np.uint64)
        fresh, found = np.concatenate([fresh, kept]), found or len(kept) > 0
        last = at + size >= len(text)
        if found:
            joined = np.concatenate([seen, fresh, space] if last else [seen, fresh])
            rolling, out = np.zeros(len(joined), np.uint64), []
            for n in range(1, max_n + 1):
                rolling = rolling[:max(0, len(joined) - n + 1)] * np.uint64(0x100000001B3) + joined[n - 1:]
                mixed = (rolling[max(0, len(seen) - n + 1):] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                out.append((mixed >> np.uint64(40)) % np.uint64(n_buckets))
            yield np.concatenate(out).astype(np.int64)
            seen, fresh = joined[len(joined) - min(len(joined), max_n - 1):], np.empty(0, np.uint64)


def _count(n_buckets: int, max_n: int):
    def count(batches):
        letters, sums = _letters(), {}
        for p in batches:
            for lang, text in zip(p["lang"], p["text"]):
                own = np.zeros(n_buckets)
                for found in _buckets(text, letters, n_buckets, max_n):
                    own += np.bincount(found, minlength=n_buckets)
                sums[lang] = sums.get(lang, 0) + own / max(1.0, own.sum()) ** 0.5
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})
    return count


def _column(n_buckets: int):
    def column(p: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros(n_buckets)
        whole[p["bucket"]] = p["n"]
        return pd.DataFrame({"lang": p["lang"].iloc[:1], "n": [whole.tobytes()]})
    return column


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_lang: int = 3000, n_buckets: int = 1 << 15, max_n: int = 3, evidence: int = 60,
        max_model_bytes: int = 256 << 20) -> Model:
    """Learn from the rows where `learn` holds and text and language are given."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    most = max_model_bytes // (4 * n_buckets)
    chosen = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()  # as many as the model can hold
    langs = sorted(r["lang"] for r in chosen)
    if not langs:
        return Model([], np.zeros((n_buckets, 0), np.float32), max_n, evidence)
    sizes = small(docs.sparkSession, [(r["lang"], r["count"]) for r in chosen], "lang string, count long")
    sample = (rows.join(F.broadcast(sizes), "lang")
              .where(hash_fraction("langid", F.col("id"), F.col("text")) * F.col("count") < per_lang)
              .select("lang", "text").distinct())
    counts = (sample.mapInPandas(lean(_count(n_buckets, max_n)), "lang string, bucket int, n double")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
              .groupBy("lang").applyInPandas(_column(n_buckets), "lang string, n binary"))  # a row a bucket at most
    matrix, at = np.zeros((n_buckets, len(langs))), {x: i for i, x in enumerate(langs)}
    for r in counts.toLocalIterator():
        matrix[:, at[r["lang"]]] = np.frombuffer(r["n"], np.float64)
    matrix += SMOOTHING
    return Model(langs, np.log(matrix / matrix.sum(axis=0)).astype(np.float32), max_n, evidence)


def _score(shared):
    def start():
        import pyarrow as pa

        model, letters = shared.value, _letters()

        def score(texts):
            sums, sizes, part, held = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts)), [], 0

            def flush():
                if part:
                    starts = np.cumsum([0] + [len(b) for _, b in part[:-1]])
                    rows = model.weights[np.concatenate([b for _, b in part])]
                    np.add.at(sums, [i for i, _ in part], np.add.reduceat(rows, starts, axis=0, dtype=np.float64))
                    np.add.at(sizes, [i for i, _ in part], [len(b) for _, b in part])
                    part.clear()

            for i, text in enumerate(texts):
                for b in _buckets(text, letters, len(model.weights), model.max_n) if text and model.langs else ():
                    part.append((i, b))
                    held += len(b)
                    if held > 1_000_000:
                        flush()
                        held = 0
            flush()
            pred, scores = ["und"] * len(texts), np.zeros(len(texts))
            for i in np.flatnonzero(sizes):
                best = int(np.argmax(sums[i]))
                pred[i] = model.langs[best]
                scores[i] = 1 / np.exp((sums[i] - sums[i, best]) / max(1.0, sizes[i] / model.evidence)).sum()
            return pa.array(pred, pa.string()), pa.array(scores, pa.float64())
        return score
    return start


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row, from its whole text alone. The id may be any column,
    a struct of a whole row too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, [id_col], text_col, _score(shared), "lang_pred string, score double")
