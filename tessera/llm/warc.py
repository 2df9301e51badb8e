"""WARC: records of web pages, and a Merkle fixity audit of their replicas.

An archive keeps records at consecutive offsets of its segments; its leaves are
(segment, offset, length, hash of the record's bytes). A tree is built over each
segment: its lowest nodes cover offset ranges of ``span`` bytes, each level above covers
``FANOUT`` times more, up to one root a segment; a node is the hash of what lies in it,
with place and length, ordered by offset. Two replicas are compared root by root; only
below roots that differ the next level is compared, and so on down to the records of
differing ranges. Record bytes are hashed where they are read and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: children of a node
FANOUT = 16
#: bytes that a lowest node covers, and records (about) of a segment
SPAN, SEGMENT_RECORDS = 1 << 16, 1024


def records(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, ...)`` as WARC/1.1 response records: (record_id, page_id,
    record). The record id is the SHA-256 of the three columns; a null is an id of its
    own, and an empty string in the record. Equal rows give equal records."""
    same = F.sha2(F.concat_ws("\n", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
                                      for c in ("page_id", "url", "html")]), 256)
    block = F.coalesce("html", F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:sha256:"), F.col("record_id"),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(block, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.length(block).cast("string"), F.lit("\r\n\r\n"))
    return (pages.select("page_id", "url", "html", same.alias("record_id"))
            .select("record_id", "page_id", F.concat(head.cast("binary"), block, F.lit("\r\n\r\n").cast("binary")).alias("record")))


def hashed(rows: DataFrame) -> DataFrame:
    """(record_id, page_id, length, hash) of records."""
    return rows.select("record_id", "page_id", F.length("record").cast("long").alias("length"),
                       F.sha2("record", 256).alias("hash"))


def _number(hexadecimal, start: int):
    return F.conv(F.substring(hexadecimal, start, 8), 16, 10).cast("long")


def placed(rows: DataFrame, segments: int) -> DataFrame:
    """Hashed records as an archive's index: (record_id, page_id, copies, segment, offset,
    length, hash). Equal records are kept once, with their number, so no segment grows
    with repetition; the segment follows from the record id, the order in it as well."""
    one = rows.groupBy("record_id").agg(F.min("page_id").alias("page_id"), F.min("length").alias("length"),
                                        F.min("hash").alias("hash"), F.count("*").alias("copies"))
    one = one.withColumn("segment", F.pmod(_number("record_id", 1), F.lit(segments)))
    before = Window.partitionBy("segment").orderBy("record_id").rowsBetween(Window.unboundedPreceding, -1)
    return one.select("record_id", "page_id", "copies", "segment",
                      F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "hash")


def segment_count(pages: DataFrame) -> int:
    return max(1, -(-pages.count() // SEGMENT_RECORDS))


def _folded(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes of the next level: what lies in ranges of ``width``, by place."""
    order = F.sort_array(F.collect_list(F.struct("at", "label")))
    return nodes.groupBy("segment", F.floor(F.col("at") / width).alias("node")).agg(
        F.sha2(F.concat_ws("|", F.transform(order, lambda x: x["label"])), 256).alias("hash"))


def tree(leaf: DataFrame, levels: int, span: int = SPAN) -> list[DataFrame]:
    """Levels of the trees from the lowest: (segment, node, hash). A node's children are
    the FANOUT nodes under it, a lowest node's the records that begin in its range."""
    out = [_folded(leaf.select("segment", F.col("offset").alias("at"),
                               F.concat_ws(":", "offset", "length", "hash").alias("label")), span)]
    for _ in range(levels):
        out.append(_folded(out[-1].select("segment", F.col("node").alias("at"),
                                          F.concat_ws(":", "node", "hash").alias("label")), FANOUT))
    return out


def _differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hash differs or that only one side has."""
    a, b = left.withColumnRenamed("hash", "ha"), right.withColumnRenamed("hash", "hb")
    return a.join(b, keys, "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb")))


def levels_above(top: int, span: int) -> int:
    levels = 0
    while top // span >= FANOUT ** levels:
        levels += 1
    return levels


def audit(primary: DataFrame, replica: DataFrame, span: int = SPAN) -> DataFrame:
    """Records in which two archives differ, from their leaves ``(segment, offset, length,
    hash, ...)``: (segment, offset, status, range_start, range_end, primary_length,
    replica_length, primary_hash, replica_hash).

    ``status`` is ``changed``, ``missing`` (not in the replica) or ``extra`` (only there);
    the range is that of the lowest node that the descent reached. Equal archives, two
    empty ones included, give no row. An archive holds a (segment, offset) once; other
    columns are ignored."""
    left, right = (x.select("segment", "offset", "length", "hash") for x in (primary, replica))
    top = left.select("offset").union(right.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels = levels_above(top, span)
    lt, rt = tree(left, levels, span), tree(right, levels, span)
    bad = _differing(lt[-1], rt[-1], ["segment", "node"]).select("segment", "node")
    for a, b in zip(reversed(lt[:-1]), reversed(rt[:-1])):
        # children of differing nodes only
        under = [x.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(
            bad.withColumnRenamed("node", "parent"), ["segment", "parent"], "left_semi").drop("parent") for x in (a, b)]
        bad = _differing(*under, ["segment", "node"]).select("segment", "node")
    place = F.floor(F.col("offset") / span)
    a, b = (x.withColumn("node", place).join(bad, ["segment", "node"], "left_semi") for x in (left, right))
    full = F.concat_ws(":", "length", "hash")
    a = a.select("segment", "offset", F.col("length").alias("primary_length"), F.col("hash").alias("primary_hash"), full.alias("hash"))
    b = b.select("segment", "offset", F.col("length").alias("replica_length"), F.col("hash").alias("replica_hash"), full.alias("hash"))
    status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("changed")
    return _differing(a, b, ["segment", "offset"]).select(
        "segment", "offset", status.alias("status"), (place * span).alias("range_start"), ((place + 1) * span).alias("range_end"),
        "primary_length", "replica_length", "primary_hash", "replica_hash")


def roots(leaf: DataFrame, span: int = SPAN) -> DataFrame:
    """One root a segment: (segment, hash)."""
    top = leaf.agg(F.max("offset")).first()[0] or 0
    return tree(leaf, levels_above(top, span), span)[-1].select("segment", "hash")


def damaged(rows: DataFrame, every: int) -> DataFrame:
    """Records as a failing store would give them back, for audits to find: of ``every``
    records (by record id) one is lost, has a byte changed or is cut in half."""
    draw = F.pmod(_number("record_id", 9), F.lit(3 * every))
    r = F.col("record")
    half = F.floor(F.length(r) / 2).cast("int")
    cut = F.substring(r, F.lit(1), half)
    flipped = F.concat(cut, F.lit(b"\x00"), F.substring(r, half + 2, F.length(r)))
    return rows.where(draw != 0).withColumn("record", F.when(draw == 1, flipped).when(draw == 2, cut).otherwise(r))
