import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from zonewatch.llm import bytebpe, hilbert, langid, linedup, lshforest, packing, toxicity
from zonewatch.llm.common import components, ranked

from .texts import documents, empty

BYTES = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(x):
    return tuple((v is not None, v) for v in x)


# byte-level BPE

@pytest.mark.parametrize("chunk,overlap", [(32768, 512), (64, 16), (30, 8)])
def test_bytes_round_trip(docs, chunk, overlap):
    enc = bytebpe.load_encoding(BYTES, P.PATTERN)
    out = bytebpe.decode(bytebpe.encode(docs, BYTES, P.PATTERN, chunk=chunk, overlap=overlap), BYTES, P.PATTERN).collect()
    got = sorted(((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist(), bytes(r.decoded)) for r in out), key=key)
    assert got == sorted(((i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in pairs(docs)), key=key)


@pytest.mark.parametrize("most", [500_000, 0])
def test_bytes_only_chunks_that_do_not_meet_are_written_again(spark, monkeypatch, most):
    written, save = [], bytebpe.save

    def counted(df, label, *sort):
        out = save(df, label, *sort)
        if label == "chunks":
            written.append(out.count())
        return out

    monkeypatch.setattr(bytebpe, "save", counted)
    monkeypatch.setattr(bytebpe, "BROADCAST_CHUNKS", most, raising=False)
    texts = [" ".join(f"word{i * j}" for j in range(60)) for i in range(20)]
    texts.append("a few words before " * 6 + "x" * 150 + " and some after" * 9)
    enc = bytebpe.load_encoding(BYTES, P.PATTERN)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = bytebpe.encode(rows, BYTES, P.PATTERN, chunk=64, overlap=16).collect()
    assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in out} == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}
    assert len(written) > 1 and written[0] > 100 and sum(written[1:]) < 10


def test_bytes_empty(spark):
    assert bytebpe.encode(empty(spark), BYTES, P.PATTERN).count() == 0


# packing

def test_word_tokenizer_equals_the_library(docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORDS)
    texts = [t or "" for _, t in pairs(docs)] + ["Don't  STOP now ÄÖ é", "a" * 300, "ﬁ ½ 42 x1y2", "\x85next"]
    fast = packing.WordTokenizer(WORDS, memo=50)
    assert fast.fast is not None
    assert own.encode("<|endoftext|>", add_special_tokens=False).ids == [49407]
    for size in (1 << 18, 1 << 18, 7):
        assert [np.frombuffer(b, "<u4").tolist() for b in fast.encode(texts, size)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def first_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= n), None)
        if at is None:
            rooms.append(capacity - n)
        else:
            rooms[at] -= n
    return len(rooms)


def test_packing(docs):
    cut = packing.pieces(docs, WORDS, capacity=64)
    rows = packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "doc_id", "piece", capacity=64).collect()
    assert len(rows) == cut.count()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= first_fit([r.length for r in rows], 64)
    null = [r for r in rows if r.doc_id == 104]
    assert [(r.piece, r.length, r.ids_crc32) for r in null] == [(0, 1, zlib.crc32(np.zeros(1, "<u4").tobytes()))]
    assert sum(r.doc_id == 109 for r in rows) == 2


def test_fullest_is_optimal():
    import itertools
    import random
    from collections import Counter

    rng = random.Random(0)
    for _ in range(200):
        items = [rng.randint(1, 12) for _ in range(rng.randint(0, 7))]
        room = rng.randint(0, 30)
        best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room)
        chosen = packing.fullest(Counter(items), room)
        assert sum(chosen) == best and not Counter(chosen) - Counter(items)


def test_packing_empty_and_bad(spark):
    assert packing.pack(packing.pieces(empty(spark), WORDS), "doc_id", "piece").count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 99)], "doc_id long, piece int, length long"), "doc_id", capacity=10)


# line dedup

def lines_by_hand(rows, least=10):
    upper = str.maketrans(linedup.UPPER, linedup.LOWER)
    held = defaultdict(set)
    clean = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(upper)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(clean(line)) >= least:
                held[clean(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held[clean(x)]) < 2 or i == min(held[clean(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=key)


@pytest.mark.parametrize("batches,fanout", [(1, 3), (4, 2), (7, 2)])
def test_lines(docs, batches, fanout):
    out = linedup.drop_lines(docs, batches=batches, fanout=fanout)
    assert out.select("row.*").columns == docs.columns
    assert not [t for t in docs.sparkSession.catalog.listTables() if t.name.startswith("line_run_")]
    got = sorted(((r.row.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in out.collect()), key=key)
    assert got == lines_by_hand(pairs(docs))


def test_lines_of_one_hot_key(spark):
    rows = [(i, f"shared header line\nown line number {i}\nSHARED HEADER LINE ") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.row.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in linedup.drop_lines(df).collect()), key=key)
    assert got == lines_by_hand(rows)
    text_ids = df.withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    assert {(int(r.row.doc_id[1:]), r.kept_text) for r in linedup.drop_lines(text_ids).collect()} == {x[:2] for x in got}
    plan = linedup.keyed_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert linedup.drop_lines(df.limit(0)).count() == 0


# near-duplicates

def components_by_hand(rows):
    word, lower = re.compile("[^\x20\x09-\x0D]+"), str.maketrans(linedup.UPPER, linedup.LOWER)
    sets = []
    for i, t in rows:
        w = word.findall((t or "").translate(lower))
        sets.append((i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    least = {}
    for (i, _), v in zip(sets, label):
        if i is not None:
            least[v] = min(i, least.get(v, i))
    return sorted(((i, len(s), i if not s else least.get(v, i)) for (i, s), v in zip(sets, label)), key=key)


def near(df, **more):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in lshforest.near_duplicates(df, **more).collect()), key=key)


def test_near_copies(docs):
    assert near(docs) == components_by_hand(pairs(docs))


def test_crowded_regions(spark):
    import random

    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(150):  # copies with edits of their own: close to the base, further from one another
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**9)}"
        rows.append((i, " ".join(words)))
    rows += [(2000 + i, " ".join(f"y{rng.randint(0, 10**9)}" for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df, whole=8) == components_by_hand(rows)


def copies_of_copies(rng, n, edits=3, tag="x"):
    """Texts of 120 words, each a random earlier one with a few words replaced, at similarity 0.75 or more."""
    def grams(w):
        return {tuple(w[k:k + 5]) for k in range(116)}

    texts = [[f"w{rng.randint(0, 10**9)}" for _ in range(120)]]
    while len(texts) < n:
        old = rng.choice(texts)
        words = list(old)
        for _ in range(rng.randint(1, edits)):
            words[rng.randrange(120)] = f"{tag}{rng.randint(0, 10**9)}"
        x, y = grams(old), grams(words)
        if 100 * len(x & y) >= 75 * len(x | y):
            texts.append(words)
    return [" ".join(w) for w in texts]


def test_copies_of_copies_by_the_thousand(spark):
    import random

    rows = list(enumerate(copies_of_copies(random.Random(8), 4000)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert {r.component_id for r in lshforest.near_duplicates(df).collect()} == {0}


def test_crowded_regions_of_many_components(spark):
    import random

    rng = random.Random(9)
    texts = copies_of_copies(rng, 400)
    rows = list(enumerate(texts[::2]))  # every other text's link is gone
    base = texts[0].split()
    for i in range(200):  # much in common with one another, too little for a link
        at = rng.randrange(90)
        rows.append((1000 + i, " ".join(base[:at] + [f"z{rng.randint(0, 10**9)}" for _ in range(26)] + base[at + 26:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert near(df) == components_by_hand(rows)
    assert near(df, whole=2) == components_by_hand(rows)


def test_near_copies_empty(spark):
    assert near(empty(spark)) == []


def test_shingle_hashes_tell_words_apart():
    a = lshforest.shingles("ab c d e f")
    assert len(a) == 1 and (a == lshforest.shingles("AB\tc\nd  e f")).all()
    assert not (a == lshforest.shingles("a bc d e f")).any()
    assert len(lshforest.shingles("a b")) == 1 and lshforest.shingles("a b") != lshforest.shingles("b a")
    assert len(lshforest.shingles("É")) == 1 and lshforest.shingles("É") != lshforest.shingles("é")


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (41, 50), (7, 7), (40, 41)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(21)}, 40: 40, 41: 40, 50: 40}
    assert components(edges.limit(0)).count() == 0


# language and toxicity

def bayes_by_hand(learned, texts, n_buckets=1 << 15, max_n=3, evidence=60):
    """(language, score) of each text by naive Bayes over the n-grams of the (language, text) pairs."""
    import math

    mask = (1 << 64) - 1

    def grams(text):
        low, out = text.lower(), []
        if not any(c.isalpha() for c in low):
            return []
        for c, after in zip(low, low[1:] + " "):
            if c.isalpha():
                out.append(ord(c))
            elif after.isalpha():
                out.append(32)
        out = [32, *out, 32]
        found = []
        for n in range(1, max_n + 1):
            for i in range(len(out) - n + 1):
                h = 0
                for c in out[i:i + n]:
                    h = (h * 0x100000001B3 + c) & mask
                found.append((((h + n) * 0x9E3779B97F4A7C15 & mask) >> 40) % n_buckets)
        return found

    langs = sorted({a for a, _ in learned})
    counts = {a: defaultdict(float) for a in langs}
    for a, t in set(learned):
        found = grams(t)
        for g in found:
            counts[a][g] += len(found) ** -0.5
    mass = {a: sum(c.values()) + 0.01 * n_buckets for a, c in counts.items()}
    out = []
    for t in texts:
        g = grams(t or "")
        if not g or not langs:
            out.append(("und", 0.0))
            continue
        s = [sum(math.log((counts[a].get(x, 0) + 0.01) / mass[a]) for x in g) for a in langs]
        best = max(s)
        out.append((langs[s.index(best)], 1 / sum(math.exp((x - best) / max(1.0, len(g) / evidence)) for x in s)))
    return out


def test_language_equals_plain_bayes(docs):
    model = langid.fit(docs, F.col("doc_id") % 3 != 1, per_lang=10**6)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    learned = [(a, t) for i, t, a in rows if i is not None and i % 3 != 1 and t is not None and a is not None]
    want = dict(zip([(i, t) for i, t, _ in rows], bayes_by_hand(learned, [t for _, t, _ in rows])))
    found = langid.predict(docs.select(F.struct("*").alias("row"), "text"), model, "row").collect()
    assert len(found) == len(rows)
    for r in found:
        lang, score = want[r.row.doc_id, r.row.text]
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4) and r.row.extra == "e"
    known = [r.lang_pred == r.row.lang for r in found if r.row.doc_id is not None and r.row.doc_id < 60]
    assert sum(known) / len(known) > 0.9
    assert {r.lang_pred for r in found if r.row.doc_id in (104, 105, 106, 107)} == {"und"}


def test_long_texts_are_read_in_pieces():
    letters = langid._letters()
    texts = ["one Two, three--four  five", "12 !", "ab" * 50, " a", "a ", "..a..b..", "\U00020000x 9 ÄÖ"]
    for text in texts:
        whole = sorted(np.concatenate([*langid._buckets(text, letters, 1 << 15, 3), np.empty(0, np.int64)]))
        for size in (1, 2, 3, 5, 8):
            assert sorted(np.concatenate([*langid._buckets(text, letters, 1 << 15, 3, size), np.empty(0, np.int64)])) == whole
    from zonewatch.llm.common import pieces
    text = " ".join(texts) * 3
    for size in (1, 7, 50):
        assert "".join(pieces(text, size)) == text
        assert (lshforest.shingles(text, size=size) == lshforest.shingles(text)).all()
    assert list(pieces("", 5)) == [""]


def test_language_without_rows(spark, docs):
    model = langid.fit(docs, F.lit(False))
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


def test_model_size_is_bounded(spark, docs):
    """A column with thousands of values costs the rarest ones, not the job."""
    junk = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some text here").alias("text"), F.concat(F.lit("zz"), "id").alias("lang"))
    both = docs.select("doc_id", "text", "lang").unionByName(junk)
    model = langid.fit(both, F.lit(True), n_buckets=1 << 12, max_model_bytes=3 * 4 << 12)
    assert len(model.langs) == 3 and {"de", "en"} < set(model.langs) and model.weights.shape == (1 << 12, 3)
    assert langid.fit(docs, F.lit(True), max_model_bytes=8192).langs == []


def test_odd_words_beside_long_runs():
    """A run of 200,000 letters before an odd word, and what odd words are."""
    import random
    import time

    start, odd = time.time(), re.compile(toxicity._ODD)
    assert odd.findall("z" * 200_000 + " a1b") == ["a1b"] and odd.findall("z" * 200_000 + "1" * 200_000) == []
    assert time.time() - start < 2
    plain = re.compile(r"[^\W\d_]+[0-9@$!*|]+[^\W\d_]+")
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("aé1@ _²") for _ in range(rng.randint(0, 14)))
        assert odd.findall(text) == plain.findall(text)


def test_toxicity(spark):
    import random

    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice('aeiou')}" for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["zorgoff", "you quazzle", f"blarg{rng.choice('xyz')}{rng.randint(0, 9)}".replace("1", "q")])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (902, "!!! ??? 123"), (903, "Z0RGOFF zorgoff you zorgoff zorgoff")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(0, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks, F.col("doc_id") % 4 != 2)
    assert "zorgoff" in model.lexicon and "blar*" in model.lexicon
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(found) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    right = [found[i].predicted == t for i, _, t in labels if i % 4 == 2]
    assert sum(right) / len(right) > 0.95
    assert found[903].predicted == 1 and found[900].predicted == found[901].predicted == 0


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, none, F.lit(True))).collect()
    assert len(rows) == docs.count() and {r.score for r in rows} == {0.0}


# Hilbert shards

@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_is_a_walk(dims, bits):
    cells = np.indices([1 << bits] * dims).reshape(dims, -1)
    at = hilbert.curve_index(cells, bits)
    assert sorted(at) == list(range(len(at)))
    path = cells[:, np.argsort(at)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def test_shards(docs, tmp_path):
    rows = docs.select("doc_id", "lang", "source", F.length("text").alias("size"), F.xxhash64("text").alias("h"))
    out = hilbert.shard(rows, ["lang", "source", "size", "doc_id"], 7, "h", "doc_id").cache()
    found = defaultdict(list)
    for r in out.collect():
        found[r.shard].append(r.slot)
    sizes = [len(v) for v in found.values()]
    assert sum(sizes) == rows.count() and set(found) == set(range(7)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in found.values())
    hilbert.write(out, str(tmp_path / "shards"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "shards")).count() == rows.count()


def test_shards_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, lang string")
    assert hilbert.shard(few, ["lang", "doc_id"], 40, "doc_id").count() == 2
    assert hilbert.shard(few.limit(0), ["lang", "doc_id"], 40, "doc_id").count() == 0


def test_ranks(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(100)], "a int, b int")
    rows = sorted((r.rank, r.a, r.b) for r in ranked(df, "a", "b").collect())
    assert [r[0] for r in rows] == list(range(100)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def test_digest_is_of_whole_text(docs):
    rows = linedup.drop_lines(docs.where("doc_id = 111")).select(F.sha2(F.col("kept_text").cast("binary"), 256).alias("h")).first()
    assert rows.h == hashlib.sha256(("x" * 5000 + " " + "word " * 9000).encode()).hexdigest()


def test_letters_beyond_two_planes():
    letters = langid._letters()
    assert list(langid._buckets("\U00020000\U0002A6D6\U00031350", letters, 1 << 16, 3))
    assert not list(langid._buckets("\U0003FFFF\U000F0000\U0010FFFF \U0001F600", letters, 1 << 16, 3))
    assert toxicity._classes()[[0x20000, 0x31350, 0x3FFFF]].tolist() == [1, 1, 4]


# memory of workers that live on

def test_workers_give_their_memory_back():
    import re
    from pathlib import Path

    from zonewatch.llm.common import lean

    def mb():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    kept = []

    def run(batches):
        for n in batches:
            held = [bytes(1000) for _ in range(n)]
            kept.append(bytes(1000))  # above the others, so that the heap doesn't shrink by itself
            yield mb()
            del held

    before, peak = mb(), max(lean(run)([200_000]))
    assert peak > before + 150
    assert mb() < before + 50


def test_small_tables_start_no_workers(spark):
    from zonewatch.llm.common import ranked, small

    rows = [(2**40, "ä", None), (None, "", 1.5)]
    out = small(spark, rows, "a long, b string, c double")
    assert out.collect() == rows and out.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")]
    assert small(spark, [], "a long, b string").collect() == []
    assert "ExistingRDD" not in ranked(spark.range(50), "id")._jdf.queryExecution().toString()
