import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonewatch.llm import bytebpe, chat, embdedup, entries, knn

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string"


def vectors(spark, seed=0, n=150, d=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[20:40] = x[20] + 0.05 * rng.normal(size=(20, d))
    x[40:60] = x[40]
    x[60:64] = x[60] * np.array([1, 2, 0.5, 3])[:, None]
    rows = [(i, [float(np.float32(v)) for v in r], 0, 5, "v") for i, r in enumerate(x)]
    bad = [(200, None, 0, 5, "v"), (250, [None] * d, 0, 5, "v"), (300, [float("nan")] * d, 0, 5, "v"), (350, [float("inf")] + [0.0] * (d - 1), 0, 5, "v"),
           (400, [0.0] * d, 0, 5, "v"), (450, [1.0, 2.0], 0, 5, "v"), (500, [], 0, 5, "v")]
    return spark.createDataFrame(rows + bad, SCHEMA), rows + [bad[4]], rows


@pytest.mark.parametrize("pivots,block,chunk", [(64, 4096, 2048), (5, 16, 2), (1, 7, 1)])
def test_top_k(spark, pivots, block, chunk):
    df, usable, _ = vectors(spark)
    ids, x = np.array([r[0] for r in usable]), np.array([np.floor(256 * np.array(r[1], float)) for r in usable]).astype(np.int64)
    want = []
    for i, q in zip(ids, x):
        if i % 50 == 0:
            s = x @ q
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:5]
            want += [(i, n + 1, ids[j], s[j]) for n, j in enumerate(order)]
    got = knn.top_k(df, F.col("id") % 50 == 0, 5, n_pivots=pivots, block=block, chunk=chunk).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == want


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.id) for r in knn.top_k(df, F.col("id") == 0).collect()) == [(0, 1, 1), (0, 2, 1)]
    assert knn.top_k(df.limit(0), F.col("id") == 0).count() == 0


@pytest.mark.parametrize("block", [4096, 16])
def test_links(spark, block):
    df, _, usable = vectors(spark)
    ids, x = np.array([r[0] for r in usable]), np.array([r[1] for r in usable], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    label = embdedup.local_labels(len(ids), *np.nonzero(linked))
    want = {i: (int(n), int(ids[c])) for i, n, c in zip(ids, linked.sum(axis=1), label)}
    rows = embdedup.near_duplicates(df, 0.9, block=block).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r.n_links, r.component_id) == want.get(r.id, (0, r.id)) and r.kept == (r.id == r.component_id)


def test_links_of_none(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.id or 0, r.n_links, r.kept) for r in embdedup.near_duplicates(df).collect()) == [(0, 0, True), (1, 0, True), (2, 0, True)]
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


@given(st.text(alphabet="ab\\#</turn>\n ###é"), st.text(alphabet="user\\#< \n"))
def test_escaping(text, role):
    assert chat.unescape(chat.escape(text)) == text
    piece, a, b = chat.render(role, text)
    assert chat.parse(piece * 2) == [(role, text, True)] * 2 and chat.unescape(piece[a:b]) == text


def digests_by_hand(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(role or "", text or "") for _, _, role, text in sorted((r for r in rows if r[0] == conv), key=order)]
        whole, loss = "".join(f"{a}\n{b}\n" for a, b in turns), "".join(b for a, b in turns if a == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("section", [64, 2])
def test_windows(spark, section, monkeypatch):
    monkeypatch.setattr(chat, "SECTION", section)
    hard = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "be brief"), *((1, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (i % 11)) for i in range(1, 60))]
    rows += [(2, 0, "user", hard), (2, 1, "assistant", hard), (3, 0, None, None), (4, 1, "assistant", "long " * 500), (4, 0, "user", ""),
             (5, 0, "assistant", "b"), (5, 0, "assistant", "a"), (5, None, "user", "first"), (None, 0, "user", "no id"), (None, 1, "system", "later"),
             (6, 0, "system", "very long rules <#> " * 200), *((6, i, "assistant", "\\#< é\U0001F600" * (i % 60)) for i in range(1, 80)),
             ((1 << 60) + 1, 0, "user", "twice"), ((1 << 60) + 1, 0, "user", "twice"), ((1 << 60) + 1, 1, "assistant", "\U0001F600" * 300)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, window string, prefix int").repartition(3)
    path = P.path("byte_bpe_50k.tiktoken")
    enc = bytebpe.load_encoding(path, P.PATTERN)
    out = chat.windows(df, path, P.PATTERN, budget=120, history=40).cache()
    for w in out.collect():
        turns = chat.parse(w.text)
        assert len(turns) == w.n_turns and w.n_tokens <= 120 and w.n_turns > w.n_context
        assert w.n_tokens == sum(len(enc.encode_ordinary(chat.render(a, b, "turn" if c else "part")[0])) for a, b, c in turns)
        if w.conv_id == 1 and w.window:
            assert turns[0][:2] == ("system", "be brief") and w.n_context >= 1
        if w.conv_id == 6 and turns[0][0] == "system" and w.n_context:
            assert turns[0][1] and not turns[0][2] and len(enc.encode_ordinary(chat.render(*turns[0][:2], "part")[0])) <= 30
    assert out.where("conv_id = 1").count() > 3 and out.where("conv_id = 4").count() > 3
    assert out.where("conv_id = 6 AND n_context > 1").count() > 3
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(out).collect()}
    assert found == digests_by_hand(rows)
    assert chat.windows(df.limit(0), path, P.PATTERN).count() == 0


def test_registered_windows(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    hard = "\\### Assistant: </turn> ok"
    rows = [tuple(r) for r in turns] + [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in entries.op7_chat_windows(spark, sf_dir).collect()}
    assert found == digests_by_hand(rows)


@given(st.text(alphabet="ab \\#</turn>\né\U0001F600"), st.integers(15, 40))
def test_parts_join_up(text, limit):
    enc = bytebpe.load_encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN) if not ENC else ENC[0]
    ENC[:] = [enc]
    parts = chat.cut("user", text, limit, lambda t: len(enc.encode_ordinary(t)))
    assert all(n <= limit for *_, n in parts)
    assert "".join(chat.unescape(p[a:b]) for p, a, b, _ in parts) == text
    assert [x[2] for p, *_ in parts for x in chat.parse(p)] == [False] * (len(parts) - 1) + [True]


ENC = []


def awkward_vectors(seed):
    """Ids that repeat with the same and with other vectors, and vectors of three lengths."""
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(0, 60)), [float(np.float32(v)) for v in rng.integers(-2, 3, d)]) for d in [3] * 80 + [5] * 30 + [2] * 6]
    return rows + rows[:20] + [(1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (100, None), (50, [0.0] * 3)]


@pytest.mark.parametrize("seed,pivots,block", [(1, 64, 4096), (2, 3, 7)])
def test_top_k_of_repeated_ids(spark, seed, pivots, block):
    rows = awkward_vectors(seed)
    want = []
    for n, (i, q) in enumerate(rows):
        if i % 50 == 0 and q:
            others = [(-sum(int(256 * a) * int(256 * b) for a, b in zip(q, x)), j) for m, (j, x) in enumerate(rows) if m != n and x and len(x) == len(q)]
            want.append((i, [(j, -s) for s, j in sorted(others)[:5]]))
    got = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = knn.top_k(df, F.col("id") % 50 == 0, 5, n_pivots=pivots, block=block, chunk=2).collect()
    for r in found:
        got.setdefault((r.query_id, r["rank"]), []).append((r.id, r.score))
    plain = {}
    for i, best in want:
        for k, x in enumerate(best):
            plain.setdefault((i, k + 1), []).append(x)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in plain.items()}


@pytest.mark.parametrize("seed,block", [(1, 8192), (2, 16)])
def test_links_of_repeated_ids(spark, seed, block):
    rows = awkward_vectors(seed)
    nodes = sorted({(i, tuple(v)) for i, v in rows if v and any(v)})
    near = lambda a, b: len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    links = {a: [b for b in nodes if a != b and near(a[1], b[1])] for a in nodes}
    want = {}
    for a in nodes:
        seen, todo = {a}, [a]
        while todo:
            todo = [b for b in {b for x in todo for b in links[x]} if b not in seen]
            seen |= set(todo)
        want[a] = (a[0], len(links[a]), min(seen)[0])
    plain = sorted(want[i, tuple(v)] if v and any(v) else (i, 0, i) for i, v in rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted((r.id, r.n_links, r.component_id) for r in embdedup.near_duplicates(df, 0.9, block=block).collect()) == plain
    assert (1, 2, 1) not in [(r.id, r.n_links, r.component_id) for r in embdedup.near_duplicates(
        spark.createDataFrame([(1, [1.0]), (1, [1.0]), (2, [1.0])], "vec_id long, embedding array<double>")).collect()]
