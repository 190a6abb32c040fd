"""Every query and every stage on tables with nulls, empty and long texts, ties, repeated rows, clashing
columns, and on empty ones."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from zonewatch.llm import entries, langid, lshforest, packing, toxicity
from zonewatch.llm.common import save

from .test_text_operators import components_by_hand, key, lines_by_hand
from .texts import documents

#: Names that operators use for what they find, or might use inside.
CLASHES = ("predicted score lang_pred kept_id kept_text n_lines n_dropped row row_number number key kept component_id curve shard slot rank "
           "features prediction probability k0 h node label piece start length ids sequence_id offset held_out version pos gone mask").split()

TABLES = {
    "labels": ([(i, i % 2, int(i % 7 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (0, 1, 1)], "doc_id long, quality int, toxic int"),
    "embeddings": ([(i, [float(i % 3), 1.0, i / 9], i % 2) for i in range(60)] + [(100, None, 0), (150, [None, 1.0, 2.0], 0), (200, [float("nan")] * 3, 0),
                   (None, [1.0, 1.0, 1.0], 0), (250, [0.0] * 3, 0), (50, [5.0, 1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int"),
    "conversations": ([(i // 4, i % 4, ["system", "user", "assistant", None][i % 4], [None, "", "hi", "x " * 3000][i % 4]) for i in range(24)]
                      + [(None, None, "user", "no id"), (3, 1, "user", "")], "conv_id long, turn long, role string, text string"),
}


def with_clashes(df):
    taken = {c.lower() for c in df.columns}
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES if c not in taken))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = documents(spark).drop("extra", "id", "rank")
    more = spark.createDataFrame([(None, "no id here at all, really", "en", "s2", 25), (None, None, None, None, None), (2000, "word " * 60_000 + "end", "en", "s1", 300_003),
                                  (2001, "z" * 200_000, "de", None, 200_000)], rows.schema)
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    with_clashes(rows.unionByName(more)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def folders(spark, docs, tmp_path_factory):
    full, empty = (str(tmp_path_factory.mktemp(x)) for x in ("full", "empty"))
    docs.write.parquet(f"{full}/documents.parquet")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    for name, (rows, schema) in TABLES.items():
        df = spark.createDataFrame(rows, schema)
        df = df.select("*", *(F.lit("own").alias(c) for c in ("id", "rep", "v", "i", "cell", "packed", "prefix", "section", "window") if c not in df.columns))
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_queries(spark, docs, folders, name):
    full, empty = folders
    n, rows = name.split("_")[0], entries.QUERIES[name](spark, full).collect()
    left = {r.conv_id for r in entries.QUERIES[name](spark, empty).collect()} if n == "op7" else set(entries.QUERIES[name](spark, empty).collect())
    assert left == ({-7} if n == "op7" else set())
    if n in ("op1", "op2", "op3", "op4", "op5", "op9"):
        assert len(rows) == docs.count()
    if n == "op3":
        by_id = {}
        for r in docs.select("doc_id", "text").collect():
            by_id.setdefault(r.doc_id, set()).add((len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())))
        assert all((r.size, r.text_crc32) in by_id[r.doc_id] and r.law == "rows" and r.grown_shard is None for r in rows)
        shards = [[r.slot for r in rows if r.shard == s] for s in range(40)]
        assert all(sorted(x) == list(range(len(x))) for x in shards) and max(map(len, shards)) - min(map(len, shards)) <= 1
    if n == "op7":
        assert len(rows) == 8 and {r.conv_id for r in rows} == {None, -7, *range(6)}
    if n == "op8":
        assert len(rows) == len(TABLES["embeddings"][0])


def own_kept(after, docs):
    assert after.columns == docs.columns
    row = after.first()
    return row is None or all(row[c] == f"own {c}" for c in CLASHES if c not in ("doc_id", "text"))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, folders, name, stage):
    full, empty = folders
    none = stage(spark, docs.limit(0), empty)
    assert none.count() == 0
    after = save(stage(spark, docs, full), name)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    if name == "packing":
        assert sorted(r.doc_id or -1 for r in after.where("piece = 0").collect()) == sorted(i or -1 for i, _ in rows)
        return
    assert own_kept(after, docs)
    found = sorted(((r.doc_id, r.text) for r in after.select("doc_id", "text").collect()), key=key)
    if name == "lines":
        assert found == sorted(((i, t) for i, t, _, _ in lines_by_hand(rows)), key=key)
        assert all(r.n_chars == len(r.text) for r in after.select("text", "n_chars").collect())
    elif name == "near_copies":
        numbered = list(enumerate(sorted(rows, key=key)))  # ids first, so each row is told apart and nulls come last
        last = sum(i is None for i, _ in rows)
        numbered = [(n + (10**9 if n < last else 0), x) for n, x in numbered]
        groups = {n: c for n, _, c in components_by_hand([(n, t) for n, (_, t) in numbered])}
        assert found == sorted((x for n, x in numbered if groups[n] == n), key=key)
    elif name == "language":
        model = langid.fit(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 != 1)
        keep = {(r.key.doc_id, r.key.text) for r in langid.predict(docs.select(F.struct("doc_id", "text").alias("key"), "text"), model, "key")
                .where("lang_pred <> 'und' AND score >= 0.4").collect()}
        assert found == sorted((x for x in rows if x in keep), key=key) and not any(t is None for _, t in found)
    else:
        assert {i for i, t in rows if not t} <= {i for i, _ in found}


def test_nulls_between_ids(spark):
    """Chains through rows without an id take the smallest id reachable; rows without any have no name."""
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[i:i + 50]) for i in range(0, 10, 2)]
    alone = [" ".join(f"v{i}" for i in range(30))] * 2
    rows = [(None, chain[0]), (7, chain[1]), (None, chain[2]), (5, chain[3]), (None, chain[4]), (None, alone[0]), (None, alone[1]), (9, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in lshforest.near_duplicates(df).collect()), key=lambda x: key(x[:3]))
    want = components_by_hand(rows)
    assert [x[:3] for x in found] == want
    assert {c for _, n, c in want if n == 46} == {5}
    assert all(k == (i == c if c is not None else True) for i, _, c, k in found)


def test_scores_carry_any_id(spark, docs):
    model = toxicity.Model({}, base=0.25)
    assert toxicity.score(docs, model, "doc_id").columns == ["doc_id", "score", "predicted"]
    cut = packing.pieces(docs.select(F.struct("doc_id", "length").alias("key"), "text"), _words(), "key")
    sizes = {r.key.doc_id: r.n for r in cut.groupBy("key").agg(F.sum("length").alias("n")).where("key.doc_id = 2000").collect()}
    assert sizes[2000] == 60_000 + 1 + 1
    ids = b"".join(bytes(r.ids) for r in cut.where("key.doc_id = 2000").orderBy("piece").collect())
    assert np.frombuffer(ids, "<u4")[-1] == 0


def _words():
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")
