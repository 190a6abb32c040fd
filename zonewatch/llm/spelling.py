"""Words that differ by one letter, grouped below their commonest spelling.

Two words differ by exactly one inserted, deleted or replaced code point where their common prefix and
suffix together reach the longer length less one. Then, of words with longer length m, one shares either
the first ceil(m / 2) code points or the last floor(m / 2): so every word goes into groups by beginning
and by end, for its own length and the next one. A group is cut into blocks of about `block` code points and
its pairs of blocks are tiles, each a task's work of its own: padded code-point matrices, aligned left
for prefixes and right for suffixes, are compared row by row for every distance of two rows. No pair is
written but those that differ by one edit; none is lost, however large a group.

Null words are left out. A word stands once in the vocabulary; counts must not be null. An empty table
gives no rows. Words of any code points and any length are right; very long ones have blocks of few words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, lookup, save
from .linedup import lower_ascii

LETTERS = "[A-Za-zÀ-ÿ]+"
#: Code points a block, and rows that a task compares at once.
BLOCK, ROWS_AT_ONCE = 1 << 15, 1 << 15


def letter_runs(docs: DataFrame, *keep: Column, text_col: str = "text") -> DataFrame:
    """(keep..., run): the maximal runs of letters of every text, A-Z lower-cased. Null texts have none."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(LETTERS), F.lit(0))
    return docs.select(*keep, F.explode(runs).alias("run")).withColumn("run", lower_ascii(F.col("run")))


def vocabulary(words: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of a column `word`; common words are counted before the shuffle."""
    return (words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


def tiles(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tile, m, kind, own, other, word, n): every word in all tiles where it is compared. Rows of block
    `own` meet rows of block `other`; a tile of one block has both alike."""
    def groups(m: Column) -> list[Column]:
        half = (m / 2).cast("int")
        return [F.struct(m.alias("m"), F.lit(kind).alias("kind"), part.alias("part")) for kind, part in
                ((0, F.left("word", m - half)), (1, F.right("word", half)))]

    n = F.length("word")
    rows = words.where(n > 0).select("word", "n", F.explode(F.array(*groups(n), *groups(n + 1))).alias("g")).select("word", "n", "g.*")
    sizes = rows.groupBy("m", "kind", "part").agg(F.ceil(F.count("*") * F.col("m") / block).cast("int").alias("blocks")).where("blocks > 1")
    rows = rows.join(sizes, ["m", "kind", "part"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.xxhash64("m", "kind", "part", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(tile.alias("tile"), "m", "kind", "own", (F.col("own") == F.col("other")).alias("alone"), "word", "n")


def _single_edits(words: np.ndarray, sizes: np.ndarray, tile, m, kind, own, alone) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the rows that differ by one edit, of rows in order of their tiles."""
    width = max(1, int(sizes.max()))
    prefixes = words.astype(f"U{width}").view(np.uint32).reshape(len(words), width)
    at = np.arange(width) - (width - sizes)[:, None]
    suffixes = np.where(at >= 0, np.take_along_axis(prefixes, np.maximum(at, 0), 1), 0)[:, ::-1]
    prefixes, suffixes = (np.ascontiguousarray(x) for x in (prefixes, suffixes))

    def common(matrix: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
        other = matrix[a] != matrix[b]
        return np.where(other.any(1), np.minimum(other.argmax(1), least), least)

    found, i, shift = [], np.arange(len(words)), 0
    while len(i):
        shift += 1
        i = i[i + shift < len(words)]
        i = i[tile[i] == tile[i + shift]]  # a tile's rows lie together, so what ends here ends for good
        a, b = i, i + shift
        want = (m[a] == m[b]) & (kind[a] == kind[b]) & (np.maximum(sizes[a], sizes[b]) == m[a])
        want &= (own[a] != own[b]) | (alone[a] & alone[b])
        a, b = a[want], b[want]
        shorter = np.minimum(sizes[a], sizes[b])
        prefix, longest, by_end = common(prefixes, a, b, shorter), m[a], kind[a] == 1
        near = (prefix >= longest - longest // 2) != by_end  # pairs of one beginning are found there, not by their end
        a, b, prefix, longest, shorter = a[near], b[near], prefix[near], longest[near], shorter[near]
        near = prefix + common(suffixes, a, b, shorter) >= longest - 1
        found.append((a[near], b[near]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, n_a, b, n_b) of all words (word, n) that differ by one edit, each pair once."""
    def run(batches):
        import pyarrow as pa

        def compared(rows):
            word = rows.column("word")
            plain = [rows.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "m", "kind", "own", "alone")]
            sizes = pa.compute.utf8_length(word).to_numpy(zero_copy_only=False)
            i, j = _single_edits(np.array(word.to_pylist(), dtype=object), sizes, *plain)
            n = rows.column("n")
            return pa.RecordBatch.from_arrays([word.take(i), n.take(i), word.take(j), n.take(j)], names=["a", "n_a", "b", "n_b"])

        def parts(table):
            """Whole tiles, about so many rows or code points at once."""
            tile = table.column("tile").to_numpy(zero_copy_only=False)
            ends = np.append(np.flatnonzero(tile[1:] != tile[:-1]) + 1, len(tile))
            sizes = pa.compute.utf8_length(table.column("word")).to_numpy(zero_copy_only=False)
            start = before = most = 0
            for end in ends:
                longest = int(sizes[before:end].max())
                if before > start and ((end - start) > ROWS_AT_ONCE or (end - start) * max(most, longest) > 32 * ROWS_AT_ONCE):
                    yield start, before
                    start, most = before, 0
                before, most = end, max(most, longest)
            yield start, len(tile)

        import pyarrow.compute  # noqa: F401

        kept = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            if sum(b.num_rows for b in kept) < ROWS_AT_ONCE or kept[0].column("tile")[0] == batch.column("tile")[-1]:
                continue
            rows = pa.concat_batches(kept)
            tile = rows.column("tile").to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(tile != tile[-1])[-1]) + 1  # the last tile may go on
            for start, end in parts(rows.slice(0, last)):
                yield compared(rows.slice(start, end - start))
            kept = [rows.slice(last)]
        if kept:
            rows = pa.concat_batches(kept)
            for start, end in parts(rows):
                yield compared(rows.slice(start, end - start))

    dealt = tiles(words, block).repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(run, "a string, n_a long, b string, n_b long")


def forms(words: DataFrame, ratio: int = 2, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n), one row a word. A word's form is
    its near word of largest count, ties the smallest, if that is `ratio` times its own or more; its root
    is where forms lead. Counts grow along forms, so they end; each round doubles the steps taken."""
    words = save(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words, block)
    both = pairs.select(F.explode(F.array(*(F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(f"n_{b}").alias("near_n"))
                                            for a, b in ("ab", "ba")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = save(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    steps = found.where("form IS NOT NULL").select("word", F.col("form").alias("up"))
    while True:
        next_ = steps.select(F.col("word").alias("up"), F.col("up").alias("next"))
        steps = save(lookup(steps, next_, "up", hot_keys(steps, "up")).select(
            "word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "roots")
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    return found.join(steps.select("word", F.col("up").alias("root")), "word", "left").withColumn("root", F.coalesce("root", "word"))
