"""Zone text to names: bare lists and presentation-format resource records, told apart line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import strip
from .scratch import new_folder

#: What a row of a split is: its owner known, or carried over from an earlier split; or the split's last owner.
KNOWN, OPEN, LAST = range(3)

#: Record types whose data follows; a line that shows one before NS delegates nothing.
STOP_TYPES = ("SOA A AAAA DS RRSIG NSEC NSEC3 NSEC3PARAM TXT MX CNAME PTR CAA TLSA SRV NAPTR").split()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): block is where a file's split begins, at the order inside it."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")


def _carry(batches):
    """Rows as they stand in their splits, each owner carried on: (kind, name, owner, file, block) of what
    delegates (KNOWN, or OPEN before a split's first owner) and of each split's last owner (LAST)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    split, last = None, None  # the split that is being read, and its last owner so far
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.table(batch)
        file, block, own = (rows[c].combine_chunks() for c in ("file", "block", "own"))
        places = np.arange(len(rows))
        new = np.append(True, pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False))
        begins = np.maximum.accumulate(np.where(new, places, 0))
        at = np.maximum.accumulate(np.where(own.is_valid().to_numpy(zero_copy_only=False), places, -1))
        owner = own.take(pa.array(np.where(at >= begins, at, 0), mask=at < begins))
        goes_on = split == (file[0].as_py(), block[0].as_py())
        if split and not goes_on and last is not None:
            yield pa.RecordBatch.from_pydict({"kind": [LAST], "name": [None], "owner": [last], "file": [split[0]], "block": [split[1]]}, schema=_carried())
        if goes_on and last is not None:  # the first split's rows before its next owner
            owner = pc.if_else(pa.array((begins == 0) & (at < begins)), pa.scalar(last), owner)
        name, delegates = rows["name"].combine_chunks(), rows["delegates"].combine_chunks()
        use = pc.or_(delegates, name.is_valid())
        kind = pc.if_else(pc.and_(delegates, owner.is_null()), OPEN, KNOWN).cast(pa.int32())
        ends = np.append(new[1:], False) & owner.is_valid().to_numpy(zero_copy_only=False)  # splits that end inside this batch
        ended = pa.array(np.flatnonzero(ends))
        nothing = pa.nulls(len(ended), pa.string())
        yield pa.RecordBatch.from_arrays([c.filter(use) for c in (kind, name, owner, file, block)], schema=_carried())
        yield pa.RecordBatch.from_arrays([pa.array([LAST] * len(ended), pa.int32()), nothing, owner.take(ended), file.take(ended), block.take(ended)], schema=_carried())
        split, last = (file[-1].as_py(), block[-1].as_py()), owner[-1].as_py()
    if split and last is not None:
        yield pa.RecordBatch.from_pydict({"kind": [LAST], "name": [None], "owner": [last], "file": [split[0]], "block": [split[1]]}, schema=_carried())


def _carried():
    import pyarrow as pa

    return pa.schema([("kind", pa.int32()), ("name", pa.string()), ("owner", pa.string()), ("file", pa.string()), ("block", pa.int64())])


def _with_owner(rows: DataFrame) -> DataFrame:
    """(name, owner, delegates): a continuation line takes the last owner above it. Inside a split owners are
    carried on in one pass, and what comes of it is written once, narrow; only lines before a split's first
    owner look at the splits before theirs, of which there is one row each. No line is shuffled but those."""
    spark = rows.sparkSession
    path = new_folder(spark, "owners")
    schema = "kind int, name string, owner string, file string, block long"
    rows.select("file", "block", "name", "own", "delegates").mapInArrow(_carry, schema).write.parquet(path)
    found = spark.read.schema(schema).parquet(path)
    open_ = found.where(F.col("kind") == OPEN)
    splits = (found.where(F.col("kind") != KNOWN).groupBy("file", "block").agg(F.max(F.when(F.col("kind") == LAST, F.col("owner"))).alias("last")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    carried = splits.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    late = open_.join(carried, ["file", "block"], "left").select(F.lit(None).cast("string").alias("name"), F.col("carried").alias("owner"), F.lit(True).alias("delegates"))
    return found.where(F.col("kind") == KNOWN).select("name", "owner", F.col("name").isNull().alias("delegates")).unionByName(late)


def names(lines: DataFrame, tld: str, continuations: bool = True) -> DataFrame:
    """(raw_name, tld) of read_lines(): bare names, and owners that a line with NS delegates.

    Lines that continue an owner need the lines in order, as read_lines() gives them; rows may be left out
    before, but not dealt out anew. The text is read once. A caller that knows a file to have no such lines
    says so by `continuations`, and nothing is written in between.
    """
    text = F.split("value", ";")[0]
    rows = (lines.withColumn("body", F.regexp_replace(text, r"[\r\n]+$", ""))
            .withColumn("bare", strip(F.col("body")))
            .where((F.col("bare") != "") & ~F.col("bare").rlike("^[#$]"))
            .withColumn("fields", F.split("bare", r"(?U)\s+"))
            .withColumn("continued", F.col("body").rlike(r"(?U)^\s")))
    rest = F.when(F.col("continued"), F.col("fields")).otherwise(F.slice("fields", 2, 1_000_000))
    types = F.filter(F.transform(rest, F.upper), lambda t: t.isin("NS", *STOP_TYPES))
    single = F.size("fields") == 1
    place = ["file", "block", "at"] if continuations else []
    rows = rows.select(*place, F.when(single, F.col("bare")).alias("name"), F.when(~single & ~F.col("continued"), F.col("fields")[0]).alias("own"),
                       (~single & F.coalesce(F.get(types, 0) == "NS", F.lit(False))).alias("delegates"))
    if continuations:
        rows = _with_owner(rows.where("name IS NOT NULL OR own IS NOT NULL OR delegates"))
    else:
        rows = rows.withColumnRenamed("own", "owner")
    apex = F.lower("owner").isin("@", tld, f"{tld}.")
    absolute = F.endswith(F.col("owner"), F.lit("."))
    owner = F.when(absolute, F.expr("substring(owner, 1, length(owner) - 1)")).otherwise(F.concat("owner", F.lit(f".{tld}")))
    delegated = F.col("delegates") & F.col("owner").isNotNull() & ~apex
    return rows.select(F.coalesce("name", F.when(delegated, owner)).alias("raw_name"), F.lit(tld).alias("tld")).where("raw_name IS NOT NULL")


def unclassified(lines: DataFrame) -> DataFrame:
    """How many record lines show neither NS nor a stop type."""
    fields = F.split(strip(F.split("value", ";")[0]), r"(?U)\s+")
    return lines.where((F.size(fields) > 1) & ~F.exists(F.transform(fields, F.upper), lambda t: t.isin("NS", *STOP_TYPES))).agg(
        F.count("*").alias("unclassified"))
