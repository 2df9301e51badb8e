import hashlib

from pyspark.sql import functions as F

from tessera.llm.warc import audit, damaged, hashed, placed, records, roots


def leaf(spark, rows):
    return spark.createDataFrame(rows, "segment BIGINT, offset BIGINT, length BIGINT, hash STRING").withColumn("node", F.lit("clash"))


def test_audit_locates_every_difference(spark):
    rows = [(s, o * 1000, 1000, f"h{s}-{o}") for s in range(5) for o in range(700)]
    other = {(s, o): (n, h) for s, o, n, h in rows}
    other[1, 5000] = (1000, "bad")
    other[1, 699_000] = (999, "h1-699")  # same hash, other length
    del other[3, 0], other[4, 350_000]
    other[2, 700_000] = (7, "new")
    other[9, 0] = (7, "segment")
    got = {(r.segment, r.offset): r for r in audit(leaf(spark, rows), leaf(spark, [(*k, *v) for k, v in other.items()])).collect()}
    assert {k: r.status for k, r in got.items()} == {(1, 5000): "changed", (1, 699_000): "changed", (3, 0): "missing",
                                                    (4, 350_000): "missing", (2, 700_000): "extra", (9, 0): "extra"}
    assert all(r.range_start <= r.offset < r.range_end == r.range_start + (1 << 16) for r in got.values())
    a, b = ({r.segment: r.hash for r in roots(leaf(spark, x)).collect()} for x in (rows, [(*k, *v) for k, v in other.items()]))
    assert {s for s in a.keys() | b.keys() if a.get(s) != b.get(s)} == {1, 2, 3, 4, 9}


def test_equal_and_empty_archives(spark):
    rows = [(0, i, 1, str(i)) for i in range(50)]
    assert audit(leaf(spark, rows), leaf(spark, rows)).collect() == []
    assert audit(leaf(spark, []), leaf(spark, [])).collect() == []
    assert {r.status for r in audit(leaf(spark, rows), leaf(spark, [])).collect()} == {"missing"}


def test_records_and_places(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (1, "http://a/", "<p>é</p>"), (None, None, None), (2, "", ""), (3, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id BIGINT, url STRING, html STRING, record STRING")
    recs = records(pages)
    for r in recs.collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and block.endswith(b"\r\n\r\n")
        assert f"Content-Length: {len(block) - 4}".encode() in head
        assert hashlib.sha256(block[:-4]).hexdigest().encode() in head
    index = placed(hashed(recs), 2).collect()
    assert sorted(r.copies for r in index) == [1, 1, 1, 2]
    for s in (0, 1):
        at = 0
        for r in sorted((r for r in index if r.segment == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    assert placed(hashed(records(pages.limit(0))), 1).collect() == []


def test_damage_is_found_in_full(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"),
                                    F.repeat(F.concat(F.lit("text "), "id"), 20).alias("html"))
    recs = records(pages)
    index = placed(hashed(recs), 3)
    bad = hashed(damaged(recs, 10))
    replica = index.select("record_id", "segment", "offset").join(bad.select("record_id", "length", "hash"), "record_id")
    got = {(r.segment, r.offset) for r in audit(index, replica).collect()}
    old, new = {r.record_id: r for r in index.collect()}, {r.record_id: r.hash for r in bad.collect()}
    assert got == {(r.segment, r.offset) for k, r in old.items() if new.get(k) != r.hash} and len(got) > 15
