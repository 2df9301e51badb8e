"""N-gram Jaccard join: blocked sparse matrix product of document by n-gram incidence.

Documents are rows and word n-grams are columns of a sparse 0/1 matrix A; two
documents link when ``denominator * |x & y| >= numerator * |x | y|``. The product
A A' is built in blocks and never in full:

1. Documents with equal n-gram sets form one class; a class is one matrix row (copies
   are combined within a batch, and again within a block).
2. A row keeps only its lowest n-grams in hash order, as many as a partner must
   hit ``c`` times (prefix bound: n - ceil(threshold * n) + c), and some slack.
3. The rows' entries are dealt into blocks of n-grams, as packed arrays, a part of the
   blocks a round. A block multiplies its columns: it emits (pair, count), without pairs
   whose sizes or positions already rule a link out.
4. Counts are accumulated per pair in blocks of documents. A pair below its
   size-derived count ``c`` is discarded.
5. Survivors pass a bound from 2048-bit parity sketches (each element of the
   symmetric difference flips at most one bit), then the exact overlap decides.

A hot n-gram, one in ``HOT`` classes or more, is never multiplied out. Rows that
reach ``need`` cold n-grams within what they emit don't depend on hot ones: in
the order "cold before hot" their prefix is cold. The few other rows (members of
large groups of near copies, texts made of common lines) meet through the hot
n-grams: each links to one representative per n-gram and size band; what is
joined by that needs no further pair, and pairs across different components are
compared by an equi-join on n-gram and size band that Spark can split.
All bounds are exact: no link is lost, whatever the order or the constants.

Steps leave no shuffle files, and tables that later steps don't read are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textops as X
from tessera.llm.tables import components, partitions, type_of, written
from tessera.session import checkpoint, remove_path, scratch_path, written_at

#: an n-gram in so many classes is hot: its column is not multiplied out
HOT = 32
#: bytes of packed entries that a block of the product holds
BLOCK_BYTES = 8 << 20
#: blocks are dealt and multiplied in up to so many rounds, each of so many bytes or more, of which one is on disk at a time
ROUNDS = 4
ROUND_BYTES = 64 << 20
#: so many counted document ids are broadcast (16 MB); more are joined by a shuffle
BROADCAST_IDS = 1_000_000
SKETCH = 32
_SK = [f"s{i}" for i in range(SKETCH)]
ENTRY = np.dtype([("g", "<u8"), ("k", "<i8"), ("n", "<i4"), ("r", "<i4")])
PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("c", "<i4"), ("need", "<i4")])


def least_overlap(n, num: int, den: int):
    """Fewest common n-grams of a row of size n with any partner."""
    return -(-num * n // den)


def hits(n):
    """How many common n-grams a pair's prefixes must share: one, and one more per 64."""
    return 1 + n // 64


def emitted(n, num: int, den: int):
    """N-grams a row emits: its prefix for ``hits`` and an eighth of slack for hot ones."""
    need = n - least_overlap(n, num, den) + hits(n)
    return np.minimum(n, need + need // 8 + 2)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word n-gram hashes of every row; a row with fewer
    words has its whole sequence as one, a row without words none."""
    s, e, row = X.words(data, offsets)
    h = X.span_hashes(data, s, e)
    g, at = X.ngram_hashes(h, row, k)
    rows = np.arange(len(offsets))
    of = np.searchsorted(row[at], rows)
    wd = np.searchsorted(row, rows)
    for i in range(len(offsets) - 1):
        if of[i + 1] > of[i]:
            yield np.unique(g[of[i]:of[i + 1]])
        elif wd[i + 1] > wd[i]:
            few = h[wd[i]:wd[i + 1]]
            yield X.mix(np.array([xxhash.xxh64_intdigest(few.tobytes(), len(few))], np.uint64))
        else:
            yield g[:0]


def _lower(data: np.ndarray) -> np.ndarray:
    return X.LOWER[data]


def _rows_fn(k, num, den):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in X.text_slices(batch):
                m = b - a
                n, key = np.zeros(m, np.int32), np.zeros(m, np.int64)
                sk, grams = np.zeros((m, SKETCH), np.uint64), []
                for i, g in enumerate(shingles(_lower(data), offsets, k)):
                    n[i] = len(g)
                    key[i] = np.uint64(xxhash.xxh64_intdigest(g.tobytes())).astype(np.int64)
                    bits = np.bincount(((g >> np.uint64(20)) & np.uint64(64 * SKETCH - 1)).astype(np.int64),
                                       minlength=64 * SKETCH) & 1
                    sk[i] = np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")
                    grams.append(g[:emitted(len(g), num, den)].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, m), pa.array(n), pa.array(key),
                     *(pa.array(sk[:, i].astype(np.int64)) for i in range(SKETCH)), pa.array(grams, pa.binary())],
                    ["doc_id", "n", "key", *_SK, "grams"])
    return run


def matrix_rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """One row per document: size, set key, parity sketch and emitted n-grams."""
    src = docs.select("doc_id", "text")
    schema = f"doc_id {type_of(docs, 'doc_id')}, n INT, key BIGINT, {', '.join(f'{s} BIGINT' for s in _SK)}, grams BINARY"
    return src.mapInArrow(_rows_fn(k, num, den), schema)


def _dealt(entries: np.ndarray, bucket: np.ndarray, kind: int):
    """(bucket, kind, payload) of entries dealt by bucket."""
    order = np.argsort(bucket, kind="stable")
    b, entries = bucket[order], entries[order]
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    end = np.r_[at[1:], len(b)]
    return [(int(b[i]), kind, entries[i:j].tobytes()) for i, j in zip(at, end)]


def _packed(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "payload"])


def _run_lengths(g: np.ndarray):
    at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    return at, np.diff(np.r_[at, len(g)])


def _entries_fn(blocks: int, most: int, rounds: int = 1, part: int = 0):
    """Deals the rows' entries into the blocks of n-grams of round ``part``. Of an n-gram that is hot
    within the batch the block gets ``most`` entries, enough to see it; the rest goes by itself."""
    def run(batches):
        for batch in batches:
            key, first = np.unique(batch.column("key").to_numpy(zero_copy_only=False), return_index=True)
            n = batch.column("n").to_numpy(zero_copy_only=False)[first]
            grams = [np.frombuffer(x, "<u8") for x in batch.column("grams").take(pa.array(first)).to_pylist()]
            size = np.array([len(x) for x in grams], np.int64)
            for a, b in X.slices(np.r_[0, np.cumsum(size)], 1 << 18):
                m = size[a:b]
                g = np.concatenate(grams[a:b])
                here = np.flatnonzero(g % np.uint64(blocks) % np.uint64(rounds) == part)
                of = np.repeat(np.arange(a, b), m)[here]
                e = np.empty(len(here), ENTRY)
                e["g"], e["k"], e["n"] = g[here], key[of], n[of]
                e["r"] = here - (np.cumsum(m) - m)[of - a]
                e = e[np.argsort(e["g"], kind="stable")]
                at, ln = _run_lengths(e["g"])
                over = np.arange(len(e)) - np.repeat(at, ln) >= most
                out = _dealt(e[~over], (e["g"][~over] % np.uint64(blocks)).astype(np.int32), 0)
                if over.any():
                    out += _dealt(e[over], (e["k"][over] % blocks).astype(np.int32), 1)
                yield _packed(out)
    return run


def _product_fn(num: int, den: int, buckets: int, top: int):
    """Multiplies the columns of one block: pairs with counts (kind 0, once by either
    document), entries of hot n-grams (kind 1)."""
    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        payload = t.column("payload").to_pylist()
        e = np.frombuffer(b"".join(p for p, k in zip(payload, kind) if k == 0), ENTRY)
        hot = [p for p, k in zip(payload, kind) if k == 1]
        e = e[np.lexsort((e["k"], e["n"], e["g"]))]
        if len(e):
            e = e[np.r_[True, (e["g"][1:] != e["g"][:-1]) | (e["k"][1:] != e["k"][:-1])]]
        at, ln = _run_lengths(e["g"])
        many = np.repeat(ln >= top, ln)
        if many.any():
            hot.append(e[many].tobytes())
        out = [(0, 1, h) for h in hot]
        found = []
        for size in np.unique(ln[(ln > 1) & (ln < top)]):
            i, j = np.triu_indices(size, 1)
            starts = at[ln == size]
            for lo in range(0, len(starts), max(1, (1 << 19) // len(i))):
                base = starts[lo:lo + max(1, (1 << 19) // len(i)), None]
                x, y = e[(base + i).ravel()], e[(base + j).ravel()]  # x is not larger
                nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
                ok = den * nx >= num * ny
                x, y, nx, ny = x[ok], y[ok], nx[ok], ny[ok]
                most = np.minimum(x["r"], y["r"]) + 1 + np.minimum(nx - x["r"], ny - y["r"]) - 1
                ok = (den + num) * most >= num * (nx + ny)
                p = np.empty(int(ok.sum()), PAIR)
                p["a"], p["b"], p["c"] = x["k"][ok], y["k"][ok], 1
                p["need"] = hits(np.minimum(nx, ny)[ok])
                found.append(p)
        p = _summed(np.concatenate(found) if found else np.empty(0, PAIR))
        back = p.copy()
        back["a"], back["b"] = p["b"], p["a"]
        p = np.concatenate([p, back])
        out += _dealt(p, (p["a"] % buckets).astype(np.int32), 0)
        return pa.Table.from_batches([_packed(out)])
    return run


def _summed(p: np.ndarray) -> np.ndarray:
    if not len(p):
        return p
    p = p[np.lexsort((p["b"], p["a"]))]
    at = np.flatnonzero(np.r_[True, (p["a"][1:] != p["a"][:-1]) | (p["b"][1:] != p["b"][:-1])])
    out = p[at].copy()
    out["c"] = np.add.reduceat(p["c"], at)
    return out


def _accumulate_fn(pairs: pa.Table, dependent: pa.Table) -> pa.Table:
    """Adds the counts of each pair of a block of documents and discards the pairs
    below their bound; pairs of a row that depends on hot n-grams need one hit."""
    p = _summed(np.frombuffer(b"".join(pairs.column("payload").to_pylist()), PAIR))
    dep = dependent.column("key").to_numpy() if dependent.num_rows else np.zeros(0, np.int64)
    p = p[((p["c"] >= p["need"]) & (p["a"] < p["b"])) | np.isin(p["a"], dep)]
    return pa.table({"a": np.minimum(p["a"], p["b"]), "b": np.maximum(p["a"], p["b"])})


def _unpack_fn(batches):
    for batch in batches:
        for p in batch.column("payload").to_pylist():
            e = np.frombuffer(p, ENTRY)
            yield pa.RecordBatch.from_arrays([pa.array(e["g"].astype(np.int64)), pa.array(e["k"]), pa.array(e["n"]),
                                              pa.array(e["r"])], ["g", "key", "n", "r"])


def _sets_fn(k: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in X.text_slices(batch):
                sets = list(shingles(_lower(data), offsets, k))
                key = [np.uint64(xxhash.xxh64_intdigest(g.tobytes())).astype(np.int64) for g in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array([g.astype(np.int64) for g in sets], pa.list_(pa.int64()))],
                    ["key", "grams"])
    return run


def _with(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(F.col("key").alias(side), F.col("n").alias(f"n{side}"),
                          *[F.col(s).alias(f"{s}{side}") for s in _SK])


def _may_link(num: int, den: int):
    """n_a + n_b - 2 * fewest overlap bounds the symmetric difference, and so the bits that differ."""
    bits = sum(F.bit_count(F.col(f"{s}a").bitwiseXOR(F.col(f"{s}b"))) for s in _SK)
    return (bits * (num + den) <= (F.col("na") + F.col("nb")) * (den - num)) & \
           (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of class keys that link, checkpointed: sketch bound, then exact overlap."""
    spark = docs.sparkSession
    paths = [scratch_path(spark, name) for name in ("pairs", "sets")]
    kept = written_at(pairs.distinct().join(_with(classes, "a"), "a").join(_with(classes, "b"), "b")
                      .where(_may_link(num, den)).select("a", "b"), paths[0])
    ends = kept.select(F.col("a").alias("key")).union(kept.select(F.col("b").alias("key"))).distinct()
    reps = classes.join(ends, "key", "left_semi")
    ids = checkpoint(reps.select("rep").distinct())
    how = "broadcast" if ids.count() <= BROADCAST_IDS else "shuffle_hash"
    texts = docs.select("doc_id", "text").join(
        ids.hint(how), F.col("doc_id").eqNullSafe(F.col("rep"))).select("text")
    sets = (texts.mapInArrow(_sets_fn(k), "key BIGINT, grams ARRAY<BIGINT>")
            .join(ends, "key", "left_semi").dropDuplicates(["key"]))
    sets = written_at(sets, paths[1])
    one = kept.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a")
    two = one.join(sets.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    links = checkpoint(two.select("a", "b", both.alias("both"), (F.size("ga") + F.size("gb")).alias("all"))
                       .where(F.col("both") * (num + den) >= F.col("all") * num).select("a", "b"))
    for path in paths:
        remove_path(spark, path)
    return links


def _free(name: str, columns: list[str]) -> str:
    """``name``, lengthened until it is none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def _key_fn(k: int, name: str):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in X.text_slices(batch):
                sets = list(shingles(_lower(data), offsets, k))
                key = [np.uint64(xxhash.xxh64_intdigest(g.tobytes())).astype(np.int64) if len(g) else None for g in sets]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key, pa.int64())], [*part.schema.names, name])
    return run


def one_of_each(docs: DataFrame, k: int = 5, numerator: int = 8, denominator: int = 10, hot: int = HOT) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one in each near-duplicate
    component stays: the one with the lowest doc_id (of equal ids, one). Documents without
    n-grams all stay. Rows that share an id with others, and those without one, are
    looked at by id and n-gram set; the rest, by id alone."""
    named = checkpoint(_named(docs, k, numerator, denominator, hot))
    drop = named.where((F.col("n") > 0) & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    again = checkpoint(named.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"))
    go = checkpoint(drop.select("doc_id").union(again).distinct())
    out = _against(docs, go, ["doc_id"], "left_anti")
    if again.isEmpty():
        return out
    some = _against(docs, again, ["doc_id"], "left_semi")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    name = _free("_key", docs.columns)
    keyed = some.mapInArrow(_key_fn(k, name), f"{types}, {name} BIGINT")
    gone = drop.select("doc_id", F.col("key").alias(name)).distinct()
    # several sets of one id can lie in its own component: the lowest stays
    own = (named.where("n > 0").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "component")
           .agg(F.min("key").alias("least"), F.collect_set("key").alias("all")))
    more = own.select("doc_id", F.explode("all").alias(name), "least").where(F.col(name) != F.col("least")).select("doc_id", name)
    kept = _against(keyed, gone.union(more), ["doc_id", name], "left_anti")
    full = kept.where(F.col(name).isNotNull()).dropDuplicates(["doc_id", name])
    return out.unionAll(full.drop(name)).unionAll(kept.where(F.col(name).isNull()).drop(name))


def _against(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join by null-safe keys, broadcast if their counted number is small."""
    hint = "broadcast" if keys.count() <= BROADCAST_IDS else "shuffle_hash"
    names = [_free(f"_k{i}", rows.columns) for i in range(len(on))]
    other = keys.select(*[F.col(c).alias(x) for c, x in zip(on, names)]).hint(hint)
    cond = None
    for c, x in zip(on, names):
        eq = F.col(c).eqNullSafe(F.col(x))
        cond = eq if cond is None else cond & eq
    return rows.join(other, cond, how)


def jaccard_components(docs: DataFrame, k: int = 5, numerator: int = 8, denominator: int = 10, hot: int = HOT) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text, ...)`` by word n-gram Jaccard.

    Returns (doc_id, n_shingles, component_id): the size of the n-gram set and the
    smallest doc_id reachable by links, the document's own included. A null text,
    an empty one or one without words has no n-grams and links with nothing.
    Repeated rows give repeated result rows; a null doc_id is kept, and is a
    component's id only if no member has one. Other columns are ignored.
    """
    return _named(docs, k, numerator, denominator, hot).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def _named(docs: DataFrame, k: int, numerator: int, denominator: int, top: int) -> DataFrame:
    """(doc_id, n, key, component, component_id) of every document."""
    spark, num, den = docs.sparkSession, numerator, denominator
    at_rows = scratch_path(spark, "rows")
    whole = written_at(matrix_rows(docs, k, num, den), at_rows)
    some = whole.where("n > 0")
    rows = written(whole.select("doc_id", "n", "key"), "sizes")
    classes = written(some.groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), *[F.first(s).alias(s) for s in _SK]), "classes")
    total = some.agg(F.sum(F.length("grams"))).first()[0] or 0
    blocks = max(4 * partitions(spark), total // 8 * ENTRY.itemsize // BLOCK_BYTES)
    # steps 3 and 4
    schema = "bucket INT, kind INT, payload BINARY"
    rounds = max(1, min(ROUNDS, -(-total // 8 * ENTRY.itemsize // ROUND_BYTES)))
    at_product = [scratch_path(spark, "product") for _ in range(rounds)]
    product = reduce(DataFrame.union, [
        written_at(some.select("key", "n", "grams").mapInArrow(_entries_fn(blocks, top, rounds, part), schema)
                   .groupBy("bucket").applyInArrow(_product_fn(num, den, blocks, top), schema), path)
        for part, path in enumerate(at_product)])
    remove_path(spark, at_rows)
    hot = checkpoint(product.where("kind = 1").mapInArrow(_unpack_fn, "g BIGINT, key BIGINT, n INT, r INT")
                     .dropDuplicates(["g", "key"]))
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    need = prefix + F.floor(F.col("n") / 64)
    length = F.least("n", need + F.floor(need / 8) + 2)
    # a row that emits too few cold n-grams depends on hot ones
    dependent = checkpoint(hot.groupBy("key", "n").agg(F.count("*").alias("h")).where(length - F.col("h") < need)
                           .select("key", (length - F.col("h")).alias("cold")))
    dep = dependent.select(F.pmod("key", F.lit(blocks)).cast("int").alias("bucket"), "key")
    pairs = (product.where("kind = 0").select("bucket", "payload").groupBy("bucket")
             .cogroup(dep.groupBy("bucket")).applyInArrow(_accumulate_fn, "a BIGINT, b BIGINT"))
    # representatives of hot n-grams, per size band
    # a little wider than the ratio of linked sizes, so that they lie at most one band apart
    band = F.floor(F.log(F.col("n")) / float(np.log(den / num) * 1.000001))
    reach = checkpoint(hot.where(F.col("r") < prefix).join(dependent, "key", "left")
                       .select("g", "key", band.cast("int").alias("band"), "cold"))
    # the row with the fewest n-grams of its own is nearest to what the others are copies of
    lead = (reach.where("cold IS NOT NULL").groupBy("g", "band")
            .agg(F.min(F.struct("cold", "key")).alias("lead")).select("g", "band", F.col("lead.key").alias("lead")))
    near = lead.select("g", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "lead")
    meets = checkpoint(reach.join(near, ["g", "band"])
                       .select("lead", "key", "band", F.col("cold").isNotNull().alias("dep")).distinct())
    star = meets.where("key <> lead").select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b"))
    links = verified(pairs.union(star), classes, docs, k, num, den)
    for path in at_product:
        remove_path(spark, path)
    found = checkpoint(components(links))
    # rows that share a hot n-gram share the representative that one of them gave it; what still
    # lies in different components is compared among those
    at = (meets.join(found.withColumnRenamed("node", "key"), "key", "left")
          .select("lead", "key", "band", "dep", F.coalesce("root", "key").alias("root")))
    split = at.groupBy("lead").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("lead")
    at = at.join(split, "lead", "left_semi").join(classes.select("key", "n", *_SK), "key")
    # of the two sides the one with fewer rows has one a band
    x = at.where("dep").select("lead", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"),
                               *[F.col(c).alias(f"{c}a") for c in ("key", "root", "n", *_SK)])
    y = at.select("lead", "band", *[F.col(c).alias(f"{c}b") for c in ("key", "root", "n", *_SK)])
    rest = checkpoint(x.join(y, ["lead", "band"]).where((F.col("roota") != F.col("rootb")) & _may_link(num, den))
                      .select(F.least("keya", "keyb").alias("a"), F.greatest("keya", "keyb").alias("b")).distinct())
    if not rest.isEmpty():
        links = checkpoint(links.union(verified(rest, classes, docs, k, num, den)))
        found = checkpoint(components(links))
    return _labelled(rows, classes, found)


def _labelled(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    member = classes.select("key", "rep").join(found.withColumnRenamed("node", "key"), "key", "left")
    member = checkpoint(member.select("key", "rep", F.coalesce("root", "key").alias("root")))
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = member.join(least, "root").select("key", F.col("root").alias("component"), "component_id")
    return (rows.select("doc_id", "n", "key").join(named, "key", "left")
            .select("doc_id", "n", "key", "component",
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
