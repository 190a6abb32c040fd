"""Helpers shared by the operators: reading tables, shared scratch tables, columns found in texts, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes per Arrow batch that reach Python at once, and bytes of text worked on at once there.
ROWS_PER_BATCH, BYTES_PER_BATCH, BYTES_AT_ONCE = 512, 4 << 20, 4 << 20

#: A key is hot with more than one in so many of the rows; so there are fewer than this many hot keys.
HOT = 1000

_BLANK = re.compile("[\x20\x09-\x0D]")


def prepare(spark: SparkSession) -> None:
    """Session settings for long texts: small Arrow batches. The operators are right without them;
    inside tasks they take texts by bytes in any case."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset a new local folder
    serves a local session, as in tests; a cluster has to name one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        known = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def save(df: DataFrame, label: str, *sort: str) -> DataFrame:
    """Write df to a new folder of the shared directory and read it back: this cuts the lineage,
    and a lost executor costs no recomputation of what is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/zonewatch-{label}-{uuid.uuid4().hex}"
    if sort:
        df = df.sortWithinPartitions(*sort)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table. They go as an Arrow table: as a list they would start Python workers of another
    kind on the executors, which stay beside those that work."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds))


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_crc(c: Column) -> Column:
    """crc32 of the value as text; null counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def hash_fraction(seed: str, *columns: Column) -> Column:
    """A number from 0 to 1, of 64 bits, that depends only on the values and the seed."""
    return F.xxhash64(F.lit(seed), *columns) / F.lit(2.0 ** 64) + F.lit(0.5)


def pieces(text: str, size: int = 1 << 18) -> Iterator[str]:
    """The text in pieces of about `size` code points that end before an ASCII blank; a word that is
    longer isn't cut."""
    at = 0
    while len(text) - at > size:
        blank = _BLANK.search(text, at + size)
        if not blank:
            break
        yield text[at:blank.start()]
        at = blank.start()
    yield text[at:] if at else text


def slices(batch, column: str, most: int = BYTES_AT_ONCE) -> Iterator:
    """The rows of an Arrow batch in parts of at most so many bytes of text (a longer text alone)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def release() -> None:
    """Give back what finished work left unused: Arrow's pool and, where the C library can, the heap."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """run, a function on batches, that gives its memory back when a task ends: Python workers live on, and
    what they keep is missing beside every later stage."""
    def to_the_end(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return to_the_end


def annotate(df: DataFrame, keep: list[str], text_col: str, compute: Callable, schema: str, many: bool = False) -> DataFrame:
    """The kept columns with what `compute` finds in each row's text (`schema`).

    compute() is called once a task; what it returns gets a list of texts and gives one Arrow array a
    column, with `many` after an array of the text's place for each row found. Kept columns stay in
    Arrow, so they may be of any type, null, or named like anything.
    """
    names = [f"k{i}" for i in range(len(keep))]
    frame = df.select(*(quoted(c).alias(n) for c, n in zip(keep, names)), quoted(text_col).alias("text"))
    found = T.StructType.fromDDL(schema)
    out = [*names, *found.fieldNames()]

    def run(batches):
        import pyarrow as pa

        of = compute()
        for batch in batches:
            for part in slices(batch, "text"):
                arrays = of(part.column(len(names)).to_pylist())
                if many:
                    part, arrays = part.take(arrays[0]), arrays[1:]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names=out)

    rows = frame.mapInArrow(lean(run), T.StructType(frame.schema.fields[:-1] + found.fields))
    return rows.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), *found.fieldNames())


def hot_keys(rows: DataFrame, key: str, total: int | None = None) -> list:
    """The keys that hold more than a thousandth of the rows: fewer than a thousand of them."""
    total = rows.count() if total is None else total
    found = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * HOT > total)
    return [r[0] for r in found.select(key).collect()]


def lookup(rows: DataFrame, of: DataFrame, key: str, hot: list) -> DataFrame:
    """rows left-joined with `of`, which has one row a key. The hot keys' rows (fewer than a thousand)
    are broadcast, so that a key with a third of all rows is nowhere gathered; the others are shuffled."""
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    rest = rows.where(~is_hot).join(of, key, "left")
    if not hot:
        return rest
    return rows.where(is_hot).join(F.broadcast(of.where(is_hot)), key, "left").unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), component the smallest node.

    Each round hooks every node to the smallest label among its neighbours and then jumps to the
    label's label, until a round changes nothing. Tables between rounds are written to the shared
    directory; the driver sees a count and fewer than a thousand hot labels a round. Nodes without an
    edge aren't returned.
    """
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = save(one.union(one.select("b", "a")).distinct(), "edges")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                  .select("node", F.least("node", "m").alias("label")), "labels")
    hubs, nodes = hot_keys(both, "b"), labels.count()
    while True:
        near = (lookup(both, labels.withColumnRenamed("node", "b"), "b", hubs)
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m")))
        hooked = save(labels.join(near, "node")
                      .select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "hooked")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = save(lookup(hooked, jump, "label", hot_keys(hooked, "label", nodes))
                   .select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with `rank`, the gapless position from 0 in the total order of the given columns.

    Rows are dealt by ranges of all order columns, so that ties in the first ones split over tasks;
    each partition numbers its own rows, and one small row count a partition turns that into ranks.
    The numbered rows are written once, so the ranks can't change between two readings.
    """
    part = F.shiftright("__at", 33)
    rows = save(df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("__at", F.monotonically_increasing_id()), "ranked")
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for number, n in sizes:
        offsets.append((number, before))
        before += n
    table_of = small(df.sparkSession, offsets, "__part long, __before long")  # one row a partition
    return (rows.withColumn("__part", part).join(F.broadcast(table_of), "__part")
            .withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("__at", "__part", "__before"))
