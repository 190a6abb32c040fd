from zonewatch.sources import zonefile

TEXT = """; a zone
$ORIGIN ch.
@\t3600\tIN\tSOA\tns. root. 1 2 3 4 5
@\t3600\tIN\tNS\ta.nic.ch.
ch.\t3600\tIN\tNS\tb.nic.ch.
alpha.ch.\t3600\tIN\tNS\tns1.example.
\t\t3600\tIN\tNS\tns2.example. ; twice
beta\t3600\tin\tns\tns1.example.
beta\t3600\tIN\tDS\t1 2 3 NS
gamma.ch.\t3600\tIN\tRRSIG\tNS 8 2
glue.alpha.ch.\t3600\tIN\tA\t192.0.2.1
# note

bare-name.ch
"""


def test_owners(spark, tmp_path):
    (tmp_path / "zone.txt").write_text(TEXT)
    found = zonefile.names(zonefile.read_lines(spark, str(tmp_path)), "ch").collect()
    assert sorted(r["raw_name"] for r in found) == ["alpha.ch", "alpha.ch", "bare-name.ch", "beta.ch"]


def test_continuation_across_splits(spark, tmp_path):
    lines = []
    for i in range(400):
        lines += [f"n{i:04d}.ch.\t3600\tIN\tDS\t1 2", *["\t\t3600\tIN\tTXT\tfiller"] * (i % 7), "\t\t3600\tIN\tNS\tns.example."]
    (tmp_path / "zone.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        read = zonefile.read_lines(spark, str(tmp_path))
        assert read.select("block").distinct().count() > 20
        found = sorted(r["raw_name"] for r in zonefile.names(read, "ch").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == [f"n{i:04d}.ch" for i in range(400)]


def test_owners_over_batches_and_files(spark, tmp_path):
    """Small batches, small splits, several files, records at a file's head that have no owner: as read line by line."""
    import random

    rng, want = random.Random(1), []
    for f in range(4):
        lines, owner = [], None
        for i in range(300):
            kind = rng.randrange(6)
            if kind == 0:
                owner = f"f{f}n{i}.ch"
                lines.append(f"{owner}.\t3600\tIN\tDS\t1 2")
            elif kind == 1:
                owner = f"f{f}m{i}.ch"
                want.append(owner)
                lines.append(f"{owner}.\tIN\tNS\tns.example.")
            elif kind == 2:
                want.append(f"bare{i}.ch")
                lines.append(f"bare{i}.ch")
            elif kind == 3:
                lines.append("\t3600\tIN\tTXT\tNS filler")
            else:
                lines.append("\t3600\tIN\tNS\tns2.example.")
                want += [owner] if owner else []
        (tmp_path / f"{f}.zone").write_text("\n".join(lines) + "\n")
    for most, batch in (("1200", "7"), ("100000", "64"), ("300", "10000")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            assert sorted(r["raw_name"] for r in zonefile.names(zonefile.read_lines(spark, str(tmp_path)), "ch").collect()) == sorted(want)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
