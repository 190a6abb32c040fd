"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text longer than `chunk` code points is cut into chunks that overlap by `overlap`. Every chunk
is pre-tokenised by itself, in parallel. Where two neighbours' pre-token boundaries meet inside
the overlap they stay together from there on, so that place is a boundary of the whole text. Each
chunk then encodes the piece between its two meeting places; the pieces' ids, in order, are the
ids of the whole text. Where no boundary meets (an unbroken run longer than the overlap), the two
chunks become one and are pre-tokenised again, until it meets the next one behind the run: exact,
and only as much is joined as the run is long. Only the boundaries are put in order and compared; a
chunk's text is shuffled and written once, and again only when it is joined.

Null and empty texts give no ids. Repeated rows are encoded each by itself: rows are told apart
by a row number, never by their id, which may be any column. An empty table gives no rows; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import annotate, save

CHUNK = 32_768
OVERLAP = 512

#: So many chunks' places are broadcast to their texts.
BROADCAST_CHUNKS = 500_000


def load_encoding(path: str, pattern: str):
    """A tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _cut(chunk: int, overlap: int):
    def start():
        import pyarrow as pa

        def cut(texts):
            found = [(i, k, at, t[at:at + chunk + overlap]) for i, t in enumerate(texts) for k, at in enumerate(range(0, len(t), chunk))]
            return [pa.array([x[c] for x in found], kind) for c, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string()))]
        return cut
    return start


def _boundaries(pattern: str, overlap: int):
    """Pre-token ends in the first (head) and the last (tail) `overlap` code points of a chunk."""
    def start():
        import pyarrow as pa
        import regex

        find = regex.compile(pattern).finditer

        def scan(texts):
            heads, tails = [], []
            for text in texts:
                # a match that touches the end of the chunk may go on in the text
                ends = [m.end() for m in find(text) if m.end() < len(text)]
                heads.append([e for e in ends if e < overlap])
                tails.append([e for e in ends if e >= len(text) - overlap])
            return pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))
        return scan
    return start


def _ids(path: str, pattern: str):
    def start():
        import numpy as np
        import pyarrow as pa

        enc = load_encoding(path, pattern)
        return lambda texts: [pa.array([np.array(enc.encode_ordinary(t), dtype="<u4").tobytes() if t else b"" for t in texts], pa.binary())]
    return start


def _beside(chunks: DataFrame, of: DataFrame) -> DataFrame:
    """The chunks that `of` names by (row, chunk, round), with its columns. As many rows as BROADCAST_CHUNKS
    are broadcast, so that the chunks' texts aren't shuffled; more are joined by a shuffle."""
    few = of.limit(BROADCAST_CHUNKS + 1).count() <= BROADCAST_CHUNKS
    return chunks.join(F.broadcast(of) if few else of, ["row", "chunk", "round"])


def _met(cut: DataFrame, pattern: str, overlap: int) -> tuple[DataFrame, DataFrame]:
    """The chunks (id, row, chunk, round, start, body), and (row, chunk, round, start, begin) of those that
    count: where each takes over from the one before. Chunks that don't meet are joined until all do, as
    chunks of another round; the others' texts stay where they were written."""
    keep = ["id", "row", "chunk", "start", "body"]

    def scan(df: DataFrame, number: int) -> DataFrame:
        found = annotate(df, keep, "body", _boundaries(pattern, overlap), "head array<bigint>, tail array<bigint>")
        return save(found.withColumn("round", F.lit(number)), "chunks")

    inside = Window.partitionBy("row").orderBy("chunk")
    whole = F.expr("transform(tail, e -> e + start)")
    first = F.array_min(F.array_intersect(F.expr("transform(head, e -> e + start)"), F.lag(whole).over(inside)))
    ends, number = ["row", "chunk", "round", "start", "head", "tail"], 0
    chunks = scan(cut, number)
    current = chunks.select(*ends)
    while True:
        met = save(current.withColumn("begin", F.when(F.row_number().over(inside) == 1, F.lit(0).cast("long")).otherwise(first)), "met")
        if not met.where("begin IS NULL").limit(1).count():
            return chunks, met.select("row", "chunk", "round", "start", "begin")
        part = met.withColumn("part", F.count("begin").over(inside)).withColumn("next", F.lead("start").over(inside))
        part = save(part.withColumn("alone", F.count("*").over(Window.partitionBy("row", "part")) == 1), "parts")
        # all but the last of those joined without what they share with the next
        of = F.array_sort(F.collect_list(F.struct("chunk", "start", "next", "body")))
        text = F.expr("array_join(transform(l, (x, i) -> if(i = size(l) - 1, x.body, substring(x.body, 1, int(x.next - x.start)))), '')")
        apart = _beside(chunks, part.where("NOT alone").select("row", "chunk", "round", "part", "next"))
        joined = apart.groupBy("row", "part").agg(F.first("id").alias("id"), of.alias("l")).select(
            "id", "row", F.expr("l[0].chunk").alias("chunk"), F.expr("l[0].start").alias("start"), text.alias("body"))
        number += 1
        more = scan(joined, number)
        chunks = chunks.unionByName(more)
        current = part.where("alone").select(*ends).unionByName(more.select(*ends))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids): the ids of each whole text as little-endian unsigned 32-bit integers in a binary."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    short = annotate(rows.where(F.length("text") <= chunk), ["id"], "text", _ids(path, pattern), "ids binary")

    long = rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    cut = annotate(long, ["id", "row"], "text", _cut(chunk, overlap), "chunk int, start bigint, body string", many=True)
    chunks, met = _met(cut.repartition(F.col("row"), F.col("chunk")), pattern, overlap)
    until = F.lead("begin").over(Window.partitionBy("row").orderBy("chunk"))
    pieces = _beside(chunks.select("id", "row", "chunk", "round", "body"), met.withColumn("until", until)).select("id", "row", "chunk", F.expr(
        "substring(body, int(begin - start) + 1, int(coalesce(until - begin, length(body))))").alias("text"))
    whole = (annotate(pieces, ["id", "row", "chunk"], "text", _ids(path, pattern), "ids binary")
             .groupBy("row").agg(F.first("id").alias("id"), F.expr("listagg(ids) WITHIN GROUP (ORDER BY chunk)").alias("ids")).select("id", "ids"))
    return short.unionByName(whole).withColumnRenamed("id", id_col)


def _decode(path: str, pattern: str):
    def decode(batches):
        import numpy as np
        import pyarrow as pa

        enc, most = load_encoding(path, pattern), 1 << 20
        for b in batches:
            out = []
            for found in b.column("ids"):
                ids = np.frombuffer(found.as_py(), "<u4")
                out.append(b"".join(enc.decode_bytes(ids[at:at + most].tolist()) for at in range(0, len(ids), most)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])
    return decode


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded): the tokens' raw bytes one after another; null ids count as none."""
    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce("ids", F.lit(b"")).alias("ids"))
    schema = rows.withColumn("decoded", F.lit(b"")).schema
    return rows.mapInArrow(_decode(path, pattern), schema).withColumnRenamed("id", id_col)
