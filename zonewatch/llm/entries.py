"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, chat, embdedup, hilbert, knn, langid, licenses, linedup, lshforest, packing, periodic, spelling, toxicity
from .common import prepare, table, text_crc


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of the rows."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = text_crc(F.col("doc_id")) % 3 == 1
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from three quarters of the labels."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = text_crc(F.col("doc_id")) % 4 == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards, counts at most one apart."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", "source",
                       (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
                       text_crc(F.col("text")).alias("text_crc32"))
    return hilbert.shard(rows, ["lang", "source", "size", "doc_id"], 40, "text_crc32", "size", "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and near-duplicate component."""
    prepare(spark)
    return lshforest.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of both."""
    import public_tokenizers as P

    prepare(spark)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ids = bytebpe.encode(table(spark, sf_dir, "documents"), path, P.PATTERN)
    return bytebpe.decode(ids, path, P.PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth one."""
    prepare(spark)
    found = knn.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in windows, read back."""
    import public_tokenizers as P

    prepare(spark)
    hard = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.windows(turns, P.path("byte_bpe_50k.tiktoken"), P.PATTERN))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine 0.9 and its component."""
    prepare(spark)
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9).withColumnRenamed("id", "vec_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one holds."""
    return linedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    import public_tokenizers as P

    prepare(spark)
    cut = packing.pieces(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
    cut = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(cut, "doc_id", "piece").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document's words; those of every tenth hash are made periodic from some word on."""
    prepare(spark)
    h, words = text_crc(F.col("doc_id")), F.col("words")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(
        h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("words"))
    docs = docs.withColumn("a", F.when(F.size("words") > 0, F.col("g") % F.size("words")))
    docs = docs.withColumn("p", 1 + F.floor((F.size("words") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    cyclic = F.array_join(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, place(i))), " ")
    docs = docs.select("doc_id", F.when(F.col("a").isNotNull(), cyclic).otherwise(F.col("text")).alias("text"))
    first = F.expr("""get(array_sort(runs, (a, b) -> CASE
        WHEN a.length * b.period <> b.length * a.period THEN if(a.length * b.period > b.length * a.period, -1, 1)
        WHEN a.start <> b.start THEN if(a.start < b.start, -1, 1) ELSE sign(a.period - b.period)::int END), 0)""")
    found = periodic.find(docs, ["doc_id"]).withColumn("first", first)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "first.start", "first.length", "first.period",
        F.expr("1000 * first.length DIV first.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document. The score is the best similarity found."""
    found = licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("hits", lambda x: x["exact"])
    starts = F.transform(base, lambda x: x["start"])
    names = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda x: x["label"]))), ",")
    return found.select(
        "kept.doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("hits")).alias("labels"),
        F.greatest("below", F.coalesce(F.array_max(F.transform("hits", lambda x: x["similarity"])), F.lit(0.0))).alias("score"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents below their commonest spelling; of every 97th hash one letter is gone."""
    prepare(spark)
    runs = spelling.letter_runs(table(spark, sf_dir, "documents"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"))
    h, run = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")), F.col("run")
    cut = (h % F.length(run)).cast("int")
    word = F.when(h % 97 == 0, F.concat(F.substring(run, F.lit(1), cut), F.substring(run, cut + 2, F.length(run)))).otherwise(run)
    return spelling.forms(spelling.vocabulary(runs.select(word.alias("word"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_minhash_forest": op4_minhash_forest,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_voronoi_knn": op6_voronoi_knn,
    "op7_chat_windows": op7_chat_windows,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_license_scan": op12_license_scan,
    "op13_spelling_variants": op13_spelling_variants,
}

#: Smallest id that each linked id reaches, of links (a, b) in both directions.
_REACH = """
reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"""


def _crc_table() -> list[int]:
    """The table of crc32 for one byte at a time, from its polynomial (reflected)."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _crc_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, unsigned."""
    b = f"hex(encode({text}))"
    return (f"xor(list_reduce(list_transform(range(0, length({b}) // 2), lambda i: ('0x' || substr({b}, 2 * i + 1, 2))::BIGINT), "
            f"lambda c, x: xor(c >> 8, {_crc_table()}[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _licence_templates() -> str:
    """The templates' 2-grams and labels as relations g and t."""
    templates = (*licenses.PHRASES, *licenses.NOTICES)
    pairs = ", ".join(f"({n}, {at}, '{a}', '{b}')" for n, at, a, b in licenses.grams(templates))
    named = ", ".join(f"({i}, '{label}', {i < len(licenses.PHRASES)}, {len(words.split()) - 1})" for i, (words, label) in enumerate(templates))
    return f"g(template, place, a, b) AS (VALUES {pairs}),\nt(template, label, exact, n_grams) AS (VALUES {named})"


def _hilbert_sql(dims: int = 4, bits: int = 4) -> str:
    """Relations h0 to the last that turn the cells x0, x1, ... of h0 step by step into `curve`."""
    def step(n: int, new: dict[str, str]) -> str:
        columns = ", ".join(f"({new[c]})::BIGINT AS {c}" if c in new else c for c in (*(f"x{i}" for i in range(dims)), "t"))
        return f"h{n + 1} AS (SELECT doc_id, size, text_crc32, {columns} FROM h{n})"

    steps, n = [], 0
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):
            if i:
                swap = f"CASE WHEN x{i} & {q} <> 0 THEN 0 ELSE xor(x0, x{i}) & {q - 1} END"
                new = {"x0": f"xor(CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {q - 1}) ELSE x0 END, {swap})", "x" + str(i): f"xor(x{i}, {swap})"}
            else:
                new = {"x0": f"CASE WHEN x0 & {q} <> 0 THEN xor(x0, {q - 1}) ELSE x0 END"}
            steps.append(step(n, new))
            n += 1
    for i in range(1, dims):
        steps.append(step(n, {f"x{i}": f"xor(x{i}, x{i - 1})"}))
        n += 1
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        steps.append(step(n, {"t": f"CASE WHEN x{dims - 1} & {q} <> 0 THEN xor(t, {q - 1}) ELSE t END"}))
        n += 1
    curve = " + ".join(f"(((xor(x{i}, t) >> {b}) & 1) << {b * dims + dims - 1 - i})" for b in range(bits) for i in range(dims))
    steps.append(f"h AS (SELECT doc_id, size, text_crc32, {curve} AS curve FROM h{n})")
    return ",\n".join(steps)


ORACLE_SQL: dict[str, str] = {
    "op3_hilbert_shards": f"""
WITH RECURSIVE bytes AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, source, hex(encode(coalesce(text, ''))) AS b FROM documents),
crc AS (
  SELECT r, doc_id, lang, source, length(b) // 2 + 16 AS size,
         xor(list_reduce(list_transform(range(0, length(b) // 2), lambda i: ('0x' || substr(b, 2 * i + 1, 2))::BIGINT),
             lambda c, x: xor(c >> 8, {_crc_table()}[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM bytes),
d AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY lang) AS l, dense_rank() OVER (ORDER BY source) AS s FROM crc),
q AS (
  SELECT list(l ORDER BY l) FILTER (lang IS NOT NULL) AS l, list(s ORDER BY s) FILTER (source IS NOT NULL) AS s, list(size ORDER BY size) AS z,
         list(doc_id ORDER BY doc_id) FILTER (doc_id IS NOT NULL) AS i FROM d),
k AS (
  SELECT {", ".join(f"list_distinct(list_transform(range(1, 16), lambda n: {c}[ceil(len({c}) * n / 16.0)::BIGINT])) AS {c}" for c in "lszi")} FROM q),
h0 AS (
  SELECT d.doc_id, d.size, d.text_crc32, 0::BIGINT AS t,
         CASE WHEN lang IS NULL THEN 0 ELSE len(list_filter(k.l, lambda c: d.l >= c)) END AS x0,
         CASE WHEN source IS NULL THEN 0 ELSE len(list_filter(k.s, lambda c: d.s >= c)) END AS x1,
         len(list_filter(k.z, lambda c: d.size >= c)) AS x2,
         CASE WHEN d.doc_id IS NULL THEN 0 ELSE len(list_filter(k.i, lambda c: d.doc_id >= c)) END AS x3
  FROM d, k),
{_hilbert_sql()},
o AS (
  SELECT *, row_number() OVER (ORDER BY curve, text_crc32, size, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM h),
p AS (SELECT *, place * 40 // total AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, place - (shard * total + 39) // 40 AS slot,
       NULL::INTEGER AS grown_shard, curve FROM p""",
    "op4_minhash_forest": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, len(w) - 3)),
                   lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM members p JOIN members q USING (x) WHERE p.doc_id <> q.doc_id
  GROUP BY p.doc_id, q.doc_id HAVING 100 * count(*) >= 75 * (any_value(p.n) + any_value(q.n) - count(*))),""" + _REACH + """
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(c, doc_id)) AS kept
FROM sets LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = doc_id""",
    "op6_voronoi_knn": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.r AS asks, q.vec_id AS query_id, c.r, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e))
SELECT query_id, row_number() OVER (PARTITION BY asks ORDER BY score DESC, vec_id, r)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 5""",
    "op8_embedding_dedup": """
WITH RECURSIVE g AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, e) AS r, vec_id, e FROM (SELECT DISTINCT vec_id, e FROM g)),
links AS (
  SELECT p.r AS a, q.r AS b FROM v p JOIN v q ON p.r <> q.r AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.9),""" + _REACH + """,
found AS (
  SELECT v.vec_id, e, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(c, v.vec_id)) AS component_id
  FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = v.r
  LEFT JOIN (SELECT a, min(o.vec_id) AS c FROM reach JOIN v o ON o.r = b GROUP BY a) m ON m.a = v.r)
SELECT t.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, t.vec_id) AS component_id, t.vec_id = coalesce(component_id, t.vec_id) AS kept
FROM embeddings t LEFT JOIN found ON found.vec_id = t.vec_id AND found.e = t.embedding::DOUBLE[]""",
    "op9_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (
  SELECT doc_id, line, pos, owner IS NOT NULL AND doc_id <> owner AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op11_periodic_runs": f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         {_crc_sql("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 % len(w) END AS a FROM w),
p AS (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM a),
t AS (
  SELECT r, n, pos, w[1 + CASE WHEN a IS NULL OR pos < a THEN pos ELSE a + (pos - a) % p END] AS word
  FROM (SELECT *, unnest(range(0, n)) AS pos FROM p)),
same AS (
  SELECT x.r, y.pos - x.pos AS q, x.pos FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND y.pos > x.pos AND 4 * (y.pos - x.pos) <= x.n),
island AS (SELECT *, pos - row_number() OVER (PARTITION BY r, q ORDER BY pos) AS i FROM same),
stretch AS (SELECT r, q, min(pos) AS start, count(*) + q AS length FROM island GROUP BY r, q, i HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretch GROUP BY r, start, length),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY r),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1),
left_over AS (
  SELECT r, string_agg(word, ' ' ORDER BY pos) AS s FROM t
  WHERE NOT EXISTS (SELECT 1 FROM runs u WHERE u.r = t.r AND t.pos >= u.start + u.period AND t.pos < u.start + u.length) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(listed.s, '')) AS runs_sha256, sha256(coalesce(left_over.s, '')) AS collapsed_sha256
FROM p LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN left_over USING (r)""",
    "op12_license_scan": f"""
WITH {_licence_templates()},
w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
v AS (
  SELECT r, template, pos - 1 - place AS start, place
  FROM (SELECT r, pos, w[pos] AS a, w[pos + 1] AS b FROM (SELECT r, w, unnest(range(1, len(w))) AS pos FROM w)) JOIN g USING (a, b)),
d AS (SELECT r, template, start, count(*) AS own FROM v GROUP BY r, template, start),
m AS (
  SELECT d.r, d.template, d.start, d.own, count(DISTINCT v.place) AS covered
  FROM d JOIN v ON v.r = d.r AND v.template = d.template AND abs(v.start - d.start) <= 2 GROUP BY d.r, d.template, d.start, d.own),
s AS (
  SELECT m.*, label, exact, (CASE WHEN exact THEN own ELSE covered END)::DOUBLE / n_grams AS similarity,
         NOT EXISTS (SELECT 1 FROM m o WHERE o.r = m.r AND o.template = m.template AND abs(o.start - m.start) <= 2
                     AND (o.covered, o.own, -o.start) > (m.covered, m.own, -m.start)) AS best
  FROM m JOIN t USING (template)),
h AS (SELECT *, CASE WHEN exact THEN similarity = 1 ELSE similarity >= 0.75 AND best END AS hit FROM s),
o AS (
  SELECT r, count(*) FILTER (hit AND exact) AS n_base, min(start) FILTER (hit AND exact) AS first_word, max(start) FILTER (hit AND exact) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (hit AND exact) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (hit) AS labels, max(similarity) FILTER (hit OR NOT exact) AS score
  FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN o USING (r)""",
    "op13_spelling_variants": f"""
WITH RECURSIVE x AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, {_LOWER.format("run")} AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY 1, 2),
h AS (SELECT run, n, {_crc_sql("doc || ':' || run")} AS h FROM x),
c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gone AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT x.word, y.word AS near FROM gone x JOIN gone y ON x.d = y.d AND x.i = y.i AND x.word <> y.word
  UNION SELECT word, d FROM gone WHERE d IN (SELECT word FROM words)
  UNION SELECT d, word FROM gone WHERE d IN (SELECT word FROM words)),
ranked AS (
  SELECT near.word, near, w.n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near) AS place
  FROM near JOIN words w ON w.word = near.near),
f AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN ranked.n >= 2 * words.n THEN near END AS form,
         CASE WHEN ranked.n >= 2 * words.n THEN ranked.n END AS form_n
  FROM words LEFT JOIN ranked ON ranked.word = words.word AND place = 1),
up(word, root) AS (
  SELECT word, word FROM f WHERE form IS NULL
  UNION ALL SELECT f.word, up.root FROM up JOIN f ON f.form = up.word)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN up USING (word)""",
}
