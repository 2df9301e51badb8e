"""The registered queries: one per operator of the inventory, each with the
DuckDB SQL that must give the same rows.

Each query reads whole test tables (``sf_dir``) and returns a DataFrame
with scalar, aliased columns; arrays are split into ``x0..x{d-1}``,
doubles are rounded (``rnd``) so that both engines print the same digits.
Queries without an exact SQL form have no oracle entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import assign as A
from tessera.operators import grid as G
from tessera.operators import refine as W
from tessera.operators import sample as SM
from tessera.operators import search as SR
from tessera.plans import run as PL
from tessera.plans.fixtures import (CUSTOMER, EMBED, EVENTS, PART, centers_sql, first_k_centers,
                                    rnd, sql_dist)
from tessera.session import checkpoint, scratch_path
from tessera.sources import points as SP
from tessera.sources.points import explode_coords

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


K = 5  # centers of the fixed-center queries: the K lowest part keys


def _part_and_centers(spark: SparkSession, sf_dir: str):
    pts = PART.load(spark, sf_dir)
    return pts, first_k_centers(pts, K)


_NEAREST_SQL = f"""
WITH pts AS ({PART.sql()}), ctr AS ({centers_sql(PART, K)}),
pc AS (SELECT p.point_id, c.center_id, {sql_dist(2, 'x', 'c', 'p.', 'c.')} AS dist
       FROM pts p, ctr c)
"""

# ---------------------------------------------------------------- sources


@register("read_points_table", f"SELECT point_id, x0, x1, weight FROM ({PART.sql()})")
def q_read_points_table(spark, sf_dir):
    return explode_coords(PART.load(spark, sf_dir), 2)


# ---------------------------------------------------------------- assignment


@register("assign_nearest", _NEAREST_SQL + """
SELECT point_id, center_id, round(dist, 6) + 0.0 AS distance FROM pc
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, center_id) = 1
""")
def q_assign_nearest(spark, sf_dir):
    pts, ctr = _part_and_centers(spark, sf_dir)
    out = A.assign_nearest(pts, ctr)
    return out.select("point_id", "center_id", rnd(F.col("distance"), 6).alias("distance"))


@register("clustering_cost", _NEAREST_SQL + """
, best AS (SELECT min(dist) AS dist FROM pc GROUP BY point_id)
SELECT round(sum(dist), 4) + 0.0 AS cost, count(*) AS n FROM best
""")
def q_clustering_cost(spark, sf_dir):
    pts, ctr = _part_and_centers(spark, sf_dir)
    cl = A.centers_list(ctr)
    m = A.nearest("coords", cl)
    return pts.agg(rnd(F.sum(m["distance"]), 4).alias("cost"), F.count("*").alias("n"))


@register("vec_distance", _NEAREST_SQL + """
SELECT point_id, """ + ", ".join(
    f"round(max(CASE WHEN center_id = {j} THEN dist END), 6) + 0.0 AS d{j}" for j in range(K))
    + " FROM pc GROUP BY point_id")
def q_vec_distance(spark, sf_dir):
    pts, ctr = _part_and_centers(spark, sf_dir)
    return pts.select("point_id", *[rnd(V.distance("coords", c), 6).alias(f"d{j}")
                                    for j, c in ctr])


_EMB_K = 4
_EMB_NEAREST_SQL = f"""
WITH pts AS ({EMBED.sql()}), ctr AS ({centers_sql(EMBED, _EMB_K)}),
pc AS (SELECT p.point_id, c.center_id, {sql_dist(64, 'x', 'c', 'p.', 'c.')} AS dist
       FROM pts p, ctr c)
"""


@register("vec_distance_hd", _EMB_NEAREST_SQL + """
SELECT point_id, center_id, round(dist, 6) + 0.0 AS distance FROM pc
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, center_id) = 1
""")
def q_vec_distance_hd(spark, sf_dir):
    """64-d embeddings: the higher-order (zip_with/aggregate) distance form."""
    pts = EMBED.load(spark, sf_dir)
    ctr = first_k_centers(pts, _EMB_K)
    dist = [F.struct(V.distance("coords", F.array(*[F.lit(v) for v in c]), None).alias("distance"),
                     F.lit(j).alias("center_id")) for j, c in ctr]
    m = F.least(*dist)
    return pts.select("point_id", m["center_id"].cast("int").alias("center_id"),
                      rnd(m["distance"], 6).alias("distance"))


# ---------------------------------------------------------------- gridding


TAU = 20        # points per cell of the grid queries (part, sf0.01: 2,000 points)
LEVELS = 16     # levels unrolled by the oracle; a point over tau beyond them would be missing there


def _grid_sql(ps, tau: int, levels: int) -> str:
    """DuckDB CTEs ``pts, bb, spec, g, lv, cnt, leafp`` for a 2-d point set."""
    d = ps.d
    mins = ", ".join(f"min(x{i}) AS min{i}, max(x{i}) AS max{i}" for i in range(d))
    vol = " * ".join(f"(max{i} - min{i})" for i in range(d))
    parts = ", ".join(f"CAST(greatest(1, ceil((max{i} - min{i}) / side)) AS BIGINT) AS P{i}"
                      for i in range(d))
    cidx = ", ".join(f"least(CAST(floor((x{i} - min{i}) / side) AS BIGINT), P{i} - 1) AS c{i}"
                     for i in range(d))
    strides = []
    for i in range(d):
        s = " * ".join(f"P{j}" for j in range(i + 1, d)) or "1"
        strides.append(f"c{i} * {s}")
    cell = " + ".join(strides)
    us = ", ".join(f"(x{i} - min{i}) / side - c{i} AS u{i}" for i in range(d))
    xs = ", ".join(f"x{i}" for i in range(d))
    cs = ", ".join(f"c{i}" for i in range(d))
    avs = ", ".join(f"least(CAST(floor(u{i} * pow(2, level)) AS BIGINT), "
                    f"CAST(pow(2, level) AS BIGINT) - 1) AS a{i}" for i in range(d))
    akeys = ", ".join(f"a{i}" for i in range(d))
    same = " AND ".join(f"min(x{i}) = max(x{i})" for i in range(d))
    return f"""
WITH pts AS ({ps.sql()}),
bb AS (SELECT count(*) AS n, {mins} FROM pts),
sp0 AS (SELECT *, pow(1.0 * {vol} * {tau} / n, 1.0 / {d}) AS side FROM bb),
spec AS (SELECT *, {parts} FROM sp0),
g0 AS (SELECT p.point_id, {xs}, {cidx}, spec.* FROM pts p, spec),
g AS (SELECT *, {cell} AS cell, {us} FROM g0),
lv AS (SELECT g.*, lvl.level, {avs} FROM g, (SELECT range AS level FROM range(0, {levels + 1})) lvl),
cnt AS (SELECT cell, level, {akeys}, count(*) AS cell_n, ({same}) AS same FROM lv
        GROUP BY cell, level, {akeys}),
settled AS (SELECT lv.*, cnt.cell_n, cnt.same FROM lv JOIN cnt USING (cell, level, {akeys})
            WHERE cnt.cell_n <= {tau} OR cnt.same),
leafp AS (SELECT * FROM settled QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY level) = 1)
"""


def _key_sql(d: int) -> str:
    """DuckDB label ``cell.child...`` of a leaf row with ``level`` and ``a{i}``."""
    child = " + ".join(f"((a{i} >> (level - t.j)) & 1) * {2 ** (d - 1 - i)}" for i in range(d))
    return (f"CASE WHEN level = 0 THEN CAST(cell AS VARCHAR) ELSE CAST(cell AS VARCHAR) || '.' || "
            f"(SELECT string_agg(CAST({child} AS VARCHAR), '.' ORDER BY t.j) "
            f"FROM range(1, level + 1) t(j)) END")


_PART_GRID = _grid_sql(PART, TAU, LEVELS)


def _part_grid(spark, sf_dir):
    pts = PART.load(spark, sf_dir)
    return pts, G.grid_spec(pts, TAU, PART.d)


@register("bounding_box", f"""
WITH pts AS ({PART.sql()})
SELECT count(*) AS n, min(x0) AS min_x0, max(x0) AS max_x0, min(x1) AS min_x1, max(x1) AS max_x1
FROM pts""")
def q_bounding_box(spark, sf_dir):
    return G.bounding_box(PART.load(spark, sf_dir), 2)


@register("cell_side", _PART_GRID + """
SELECT round(side, 9) + 0.0 AS side, P0, P1, P0 * P1 AS n_uniform FROM spec""")
def q_cell_side(spark, sf_dir):
    _, spec = _part_grid(spark, sf_dir)
    row = [(round(spec.side, 9) + 0.0, spec.parts[0], spec.parts[1], spec.n_uniform)]
    return spark.createDataFrame(row, "side DOUBLE, P0 BIGINT, P1 BIGINT, n_uniform BIGINT")


@register("uniform_cells", _PART_GRID + """
, ids AS (SELECT range AS cell FROM range(0, (SELECT P0 * P1 FROM spec)))
, cc AS (SELECT cell, CAST(cell // P1 AS BIGINT) % P0 AS c0, cell % P1 AS c1, spec.* FROM ids, spec)
SELECT cell, c0, c1, round(min0 + c0 * side, 6) + 0.0 AS lo0, round(min0 + c0 * side + side, 6) + 0.0 AS hi0,
       round(min1 + c1 * side, 6) + 0.0 AS lo1, round(min1 + c1 * side + side, 6) + 0.0 AS hi1
FROM cc""")
def q_uniform_cells(spark, sf_dir):
    _, spec = _part_grid(spark, sf_dir)
    cells = G.uniform_cells(spark, spec)
    return cells.select("cell", "c0", "c1", *[rnd(F.col(c), 6).alias(c)
                                              for c in ("lo0", "hi0", "lo1", "hi1")])


@register("uniform_grid_assign", _PART_GRID + "SELECT point_id, cell, c0, c1 FROM g")
def q_uniform_grid_assign(spark, sf_dir):
    pts, spec = _part_grid(spark, sf_dir)
    g = G.uniform_grid_assign(pts, spec)
    return g.select("point_id", "cell", F.col("c")[0].alias("c0"), F.col("c")[1].alias("c1"))


@register("cell_counts", _PART_GRID + "SELECT cell, count(*) AS n FROM g GROUP BY cell")
def q_cell_counts(spark, sf_dir):
    pts, spec = _part_grid(spark, sf_dir)
    return G.cell_counts(G.uniform_grid_assign(pts, spec))


def _part_adaptive(spark, sf_dir):
    pts, spec = _part_grid(spark, sf_dir)
    return G.adaptive_grid(pts, TAU, PART.d, spec=spec)


@register("adaptive_grid_assign", _PART_GRID + f"""
SELECT point_id, {_key_sql(2)} AS cell_key, CAST(level AS INTEGER) AS depth, cell_n FROM leafp""")
def q_adaptive_grid_assign(spark, sf_dir):
    grid = _part_adaptive(spark, sf_dir)
    return G.leaf_counts(grid).select("point_id", "cell_key", F.col("depth").cast("int").alias("depth"),
                                      "cell_n")


@register("adaptive_cells", _PART_GRID + f"""
, sc AS (SELECT cell, level, a0, a1 FROM cnt WHERE cell_n > {TAU} AND NOT same)
, al AS (SELECT range AS cell, CAST(0 AS BIGINT) AS level, CAST(0 AS BIGINT) AS a0, CAST(0 AS BIGINT) AS a1
         FROM range(0, (SELECT P0 * P1 FROM spec))
         UNION ALL SELECT cell, level + 1, a0 * 2 + (r >> 1), a1 * 2 + (r & 1) FROM sc, (SELECT range AS r FROM range(4)))
, lc AS (SELECT al.cell, al.level, al.a0, al.a1, coalesce(cnt.cell_n, 0) AS n, CAST(al.cell // P1 AS BIGINT) AS c0,
                al.cell % P1 AS c1, min0, min1, side
         FROM al ANTI JOIN sc USING (cell, level, a0, a1) LEFT JOIN cnt USING (cell, level, a0, a1), spec)
SELECT {_key_sql(2)} AS cell_key, CAST(level AS INTEGER) AS depth,
       round(min0 + (c0 + a0 / pow(2, level)) * side, 6) + 0.0 AS lo0,
       round(min1 + (c1 + a1 / pow(2, level)) * side, 6) + 0.0 AS lo1,
       round(min0 + (c0 + a0 / pow(2, level)) * side + side / pow(2, level), 6) + 0.0 AS hi0,
       round(min1 + (c1 + a1 / pow(2, level)) * side + side / pow(2, level), 6) + 0.0 AS hi1, n FROM lc""")
def q_adaptive_cells(spark, sf_dir):
    """All leaves with bounds and counts, empty children of splits included."""
    cells = G.adaptive_cells(_part_adaptive(spark, sf_dir), empty=True)
    return cells.select("cell_key", "depth",
                        *[rnd(F.col(b)[i], 6).alias(f"{b}{i}") for b in ("lo", "hi") for i in range(2)],
                        "n")


@register("grid_stats", _PART_GRID + f"""
, sp AS (SELECT count(*) AS n_splits FROM cnt WHERE cell_n > {TAU} AND NOT same)
SELECT n, P0 * P1 AS n_uniform, n_splits, P0 * P1 + 3 * n_splits AS n_cells,
       round(n / (P0 * P1 + 3 * n_splits), 9) + 0.0 AS avg_per_cell
FROM spec, sp""")
def q_grid_stats(spark, sf_dir):
    grid = _part_adaptive(spark, sf_dir)
    row = [(grid.spec.n, grid.spec.n_uniform, grid.n_splits, grid.n_cells,
            round(grid.avg_per_cell, 9) + 0.0)]
    return spark.createDataFrame(
        row, "n BIGINT, n_uniform BIGINT, n_splits BIGINT, n_cells BIGINT, avg_per_cell DOUBLE")


@register("cell_members", _PART_GRID + f"SELECT {_key_sql(2)} AS cell_key, point_id FROM leafp")
def q_cell_members(spark, sf_dir):
    """Every member of every leaf cell."""
    return G.cell_members(_part_adaptive(spark, sf_dir))


# ---------------------------------------------------------------- sample


_RANK_SQL = ("(((point_id % 2147483648) + 2147483648) % 2147483648 * 2654435761 + {seed}) "
             "% 4294967296")
SEED = 0

_PART_SAMPLE = _PART_GRID + f"""
, lk AS (SELECT {_key_sql(2)} AS cell_key, point_id, x0, x1, cell_n FROM leafp)
, st AS (SELECT n, P0 * P1 + 3 * (SELECT count(*) FROM cnt WHERE cell_n > {TAU} AND NOT same) AS n_cells FROM spec)
, av AS (SELECT n / n_cells AS avg FROM st)
, mg AS (SELECT cell_key, x0, x1, count(*) AS n, min(point_id) AS point_id, any_value(cell_n) AS cell_n
         FROM lk GROUP BY cell_key, x0, x1)
, mr AS (SELECT *, {_RANK_SQL.format(seed=SEED)} AS rank FROM mg)
, q AS (SELECT cell_key, any_value(cell_n) AS cell_n, count(*) AS n_distinct,
               least(CAST(ceil(any_value(cell_n) / any_value(avg)) AS BIGINT), count(*)) AS k
        FROM mr, av GROUP BY cell_key)
"""


def _part_merged(spark, sf_dir):
    grid = _part_adaptive(spark, sf_dir)
    return grid, SM.merged_cells(grid, SEED)


@register("cell_quota", _PART_SAMPLE + "SELECT cell_key, cell_n, n_distinct, k FROM q")
def q_cell_quota(spark, sf_dir):
    grid, merged = _part_merged(spark, sf_dir)
    return SM.cell_quota(merged, grid.avg_per_cell)


@register("initial_medoids", _PART_SAMPLE + """
, ordered AS (SELECT mr.cell_key, mr.point_id, q.k,
              CAST(row_number() OVER (PARTITION BY mr.cell_key ORDER BY rank, point_id) - 1 AS INTEGER) AS slot
              FROM mr JOIN q USING (cell_key))
SELECT cell_key, slot, point_id FROM ordered WHERE slot < k""")
def q_initial_medoids(spark, sf_dir):
    grid, merged = _part_merged(spark, sf_dir)
    quota = SM.cell_quota(merged, grid.avg_per_cell)
    return SM.initial_medoids(merged, quota).select("cell_key", "slot", "point_id")


@register("sample_cost", _PART_SAMPLE + """
, ordered AS (SELECT mr.*, q.k,
              row_number() OVER (PARTITION BY mr.cell_key ORDER BY rank, point_id) - 1 AS slot
              FROM mr JOIN q USING (cell_key))
, med AS (SELECT cell_key, x0 AS c0, x1 AS c1 FROM ordered WHERE slot < k)
, pd AS (SELECT o.cell_key, o.point_id, o.n,
                min(sqrt((o.x0 - m.c0) * (o.x0 - m.c0) + (o.x1 - m.c1) * (o.x1 - m.c1))) AS dist
         FROM ordered o JOIN med m USING (cell_key) GROUP BY ALL)
SELECT cell_key, round(sum(n * dist), 4) + 0.0 AS cost FROM pd GROUP BY cell_key""")
def q_sample_cost(spark, sf_dir):
    """Cost of each cell's initial medoid set (A4): sum of n * nearest distance."""
    grid, merged = _part_merged(spark, sf_dir)
    quota = SM.cell_quota(merged, grid.avg_per_cell)
    med = SM.initial_medoids(merged, quota).select("cell_key", F.col("coords").alias("m"))
    pairs = merged.join(med, "cell_key")   # each point meets its own cell's k_c medoids
    per_point = pairs.groupBy("cell_key", "point_id").agg(
        F.first("n").alias("n"), F.min(V.distance("coords", "m", 2)).alias("dist"))
    return per_point.groupBy("cell_key").agg(rnd(F.sum(F.col("n") * F.col("dist")), 4).alias("cost"))


@register("cell_medoid", _PART_SAMPLE + """
, pc AS (SELECT a.cell_key, a.point_id, a.rank,
                sum(b.n * sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1))) AS cost
         FROM mr a JOIN mr b USING (cell_key) GROUP BY ALL)
SELECT cell_key, point_id, round(cost, 4) + 0.0 AS cell_cost
FROM pc JOIN (SELECT cell_key, min(cost) AS low FROM pc GROUP BY cell_key) l USING (cell_key)
WHERE cost <= low + {tol} * abs(low)
QUALIFY row_number() OVER (PARTITION BY cell_key ORDER BY rank, point_id) = 1""".format(tol=SM.TIE_RTOL))
def q_cell_medoid(spark, sf_dir):
    """Per-cell PAM with one medoid per cell (A3 at k_c = 1)."""
    grid, merged = _part_merged(spark, sf_dir)
    res = SM.cell_pam(merged, 2, grid.avg_per_cell, quota_one=True)
    return res.select("cell_key", "point_id", rnd(F.col("cell_cost"), 4).alias("cell_cost"))


def _cell_pam_ctes() -> str:
    """Recursive CTE: per-cell slot sweeps until stable, all cells at once.

    State per cell: its medoid ids as a list, the slot to visit, whether the
    sweep swapped, whether the cell stopped. A LATERAL subquery scores the
    cell's candidates for the slot with copy counts as weights.
    """
    tol = SM.TIE_RTOL

    def d(a, b):
        return f"sqrt(({a}.x0 - {b}.x0) * ({a}.x0 - {b}.x0) + ({a}.x1 - {b}.x1) * ({a}.x1 - {b}.x1))"

    return _PART_SAMPLE.replace("WITH pts AS", "WITH RECURSIVE pts AS", 1) + f"""
, mem AS (SELECT cell_key, point_id, x0, x1, n, rank FROM mr)
, init AS (SELECT cell_key, any_value(q.k) AS k, list(point_id ORDER BY rank, point_id) AS ordered
           FROM mr JOIN q USING (cell_key) GROUP BY cell_key)
, s(step, cell_key, k, slot, meds, changed, stop) AS (
  SELECT 0, cell_key, k, 0, ordered[1:k], false, false FROM init
  UNION ALL
  SELECT s.step + 1, s.cell_key, s.k, (s.slot + 1) % s.k,
         CASE WHEN coalesce(b.swap, false)
              THEN list_concat(s.meds[1:s.slot], [b.best], s.meds[s.slot + 2:])
              ELSE s.meds END,
         CASE WHEN s.slot = 0 THEN coalesce(b.swap, false) ELSE s.changed OR coalesce(b.swap, false) END,
         s.slot = s.k - 1 AND NOT (s.changed OR coalesce(b.swap, false))
  FROM s LEFT JOIN LATERAL (
    WITH md AS (SELECT r.idx, m.x0, m.x1 FROM (SELECT unnest(range(len(s.meds))) AS idx) r
                JOIN mem m ON m.cell_key = s.cell_key AND m.point_id = s.meds[r.idx + 1]),
    pr AS (SELECT p.point_id, p.x0, p.x1, p.n,
                  coalesce(min(CASE WHEN md.idx <> s.slot THEN {d('p', 'md')} END), CAST('inf' AS DOUBLE)) AS rest
           FROM mem p, md WHERE p.cell_key = s.cell_key GROUP BY p.point_id, p.x0, p.x1, p.n),
    cand AS (SELECT c.point_id, c.rank, sum(pr.n * least(pr.rest, {d('pr', 'c')})) AS cost
             FROM mem c, pr WHERE c.cell_key = s.cell_key GROUP BY c.point_id, c.rank),
    cur AS (SELECT cost FROM cand WHERE point_id = s.meds[s.slot + 1]),
    oth AS (SELECT * FROM cand WHERE NOT list_contains(s.meds, point_id)),
    bst AS (SELECT point_id, cost FROM oth WHERE cost <= (SELECT min(cost) FROM oth) * (1 + {tol})
            ORDER BY rank, point_id LIMIT 1)
    SELECT bst.point_id AS best, bst.cost < cur.cost * (1 - {tol}) AS swap FROM bst, cur) b ON true
  WHERE NOT s.stop)
, fin AS (SELECT cell_key, meds FROM s WHERE stop)
, fm AS (SELECT cell_key, CAST(i - 1 AS INTEGER) AS slot, meds[i] AS point_id
         FROM fin, (SELECT unnest(range(1, len(meds) + 1)) AS i))
, fmc AS (SELECT fm.cell_key, m.x0, m.x1 FROM fm JOIN mem m USING (cell_key, point_id))
, fc AS (SELECT cell_key, sum(n * dmin) AS cost
         FROM (SELECT p.cell_key, p.point_id, any_value(p.n) AS n, min({d('p', 'c')}) AS dmin
               FROM mem p JOIN fmc c USING (cell_key) GROUP BY p.cell_key, p.point_id) GROUP BY cell_key)
, smp AS (SELECT fm.point_id, m.x0, m.x1, m.rank FROM fm JOIN mem m USING (cell_key, point_id))
"""


def _cell_pam_sql() -> str:
    return _cell_pam_ctes() + """
SELECT cell_key, slot, point_id, round(cost, 4) + 0.0 AS cell_cost FROM fm JOIN fc USING (cell_key)"""


@register("cell_pam", _cell_pam_sql())
def q_cell_pam(spark, sf_dir):
    """Per-cell PAM with the density quota (A3); the oracle replays the
    sweeps of every cell in a recursive CTE."""
    grid, merged = _part_merged(spark, sf_dir)
    res = SM.cell_pam(merged, 2, grid.avg_per_cell)
    return res.select("cell_key", "slot", "point_id", rnd(F.col("cell_cost"), 4).alias("cell_cost"))


@register("cell_sample", _cell_pam_ctes() + """
SELECT fm.point_id, m.x0, m.x1, m.rank, fm.cell_key, fm.slot FROM fm JOIN mem m USING (cell_key, point_id)""")
def q_cell_sample(spark, sf_dir):
    """The sample (A5): one medoid row per slot of every cell; the oracle
    replays the sweeps of every cell."""
    sample = SM.grid_sample(_part_adaptive(spark, sf_dir), SEED)
    return explode_coords(sample, 2).select("point_id", "x0", "x1", "rank", "cell_key", "slot")


# 64 dimensions: most cells are empty, their numbers may exceed 63 bits, a split has 2^64 children
_EMB_GRID = f"""
WITH e AS (SELECT vec_id AS point_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
dims AS (SELECT i, min(x[i]) AS lo, max(x[i]) AS hi FROM e, (SELECT range AS i FROM range(1, {EMBED.d + 1})) GROUP BY i),
bb AS (SELECT list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi, (SELECT count(*) FROM e) AS n FROM dims),
sp AS (SELECT *, pow(list_reduce(list_transform(range(1, {EMBED.d + 1}), lambda i: hi[i] - lo[i]), lambda a, b: a * b) * {TAU} / n,
       1.0 / {EMBED.d}) AS side FROM bb),
spec AS (SELECT *, list_transform(range(1, {EMBED.d + 1}), lambda i: CAST(greatest(1, ceil((hi[i] - lo[i]) / side)) AS HUGEINT)) AS p FROM sp),
g0 AS (SELECT point_id, x, list_transform(range(1, {EMBED.d + 1}), lambda i: least(CAST(floor((x[i] - lo[i]) / side) AS HUGEINT), p[i] - 1)) AS c,
       lo, side, p FROM e, spec),
g AS (SELECT point_id, x, list_transform(range(1, {EMBED.d + 1}), lambda i: (x[i] - lo[i]) / side - c[i]) AS u,
      CASE WHEN list_reduce(list_transform(p, lambda v: log2(v)), lambda a, b: a + b) < 63
           THEN CAST(list_reduce(list_transform(range(1, {EMBED.d + 1}), lambda i: [c[i], p[i]]),
                                 lambda a, b: [a[1] * b[2] + b[1], b[2]])[1] AS VARCHAR)
           ELSE array_to_string(c, '-') END AS cell FROM g0)
"""


@register("uniform_grid_assign_embeddings", _EMB_GRID + "SELECT point_id, cell FROM g")
def q_uniform_grid_assign_embeddings(spark, sf_dir):
    """Cells of 64-d points, by number or beyond 63 bits by indices."""
    pts = EMBED.load(spark, sf_dir)
    return G.uniform_grid_assign(pts, G.grid_spec(pts, TAU, EMBED.d)).select("point_id", F.col("cell").cast("string").alias("cell"))


@register("cell_quota_embeddings", _EMB_GRID + f"""
, lv AS (SELECT point_id, x, cell, level, list_transform(u, lambda v: least(CAST(floor(v * pow(2, level)) AS BIGINT),
         CAST(pow(2, level) AS BIGINT) - 1)) AS a FROM g, (SELECT range AS level FROM range(0, 12)))
, cnt AS (SELECT cell, level, a, count(*) AS n, count(DISTINCT x) AS nd FROM lv GROUP BY ALL)
, leaf AS (SELECT lv.*, cnt.n, cnt.nd FROM lv JOIN cnt USING (cell, level, a) WHERE n <= {TAU} OR nd = 1
           QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY level) = 1)
, k AS (SELECT cell || coalesce((SELECT string_agg('.' || array_to_string(list_transform(a, lambda v: (v >> (level - t.j)) & 1), ''), ''
          ORDER BY t.j) FROM range(1, level + 1) t(j)), '') AS cell_key, n AS cell_n, nd AS n_distinct FROM leaf)
, q AS (SELECT cell_key, any_value(cell_n) AS cell_n, any_value(n_distinct) AS n_distinct FROM k GROUP BY cell_key)
SELECT cell_key, cell_n, n_distinct,
       least(CAST(ceil(cell_n / ((SELECT count(*) FROM e) / (SELECT count(*) FROM q))) AS BIGINT), n_distinct) AS k FROM q""")
def q_cell_quota_embeddings(spark, sf_dir):
    """Quota on the average of occupied cells (A1): 64-d points, mostly empty grid."""
    grid = G.adaptive_grid(EMBED.load(spark, sf_dir), TAU, EMBED.d)
    return SM.cell_quota(SM.merged_cells(grid, SEED), grid.average("occupied"))


# ---------------------------------------------------------------- phase-1 search


_D2 = "sqrt(({a}.x0 - {b}.x0) * ({a}.x0 - {b}.x0) + ({a}.x1 - {b}.x1) * ({a}.x1 - {b}.x1))"

_RANKED_SQL = f"""
WITH pts AS (SELECT point_id, x0, x1, {_RANK_SQL.format(seed=SEED)} AS rank FROM ({PART.sql()})),
med AS (SELECT point_id AS mid, x0, x1,
               CAST(row_number() OVER (ORDER BY rank, point_id) - 1 AS INTEGER) AS slot
        FROM pts ORDER BY rank, point_id LIMIT {K})
"""


def _ranked_part(spark, sf_dir):
    pts = PART.load(spark, sf_dir).withColumn("rank", SM.seeded_rank("point_id", SEED))
    return pts


@register("pairwise_distance", f"""
WITH pts AS ({PART.sql()})
SELECT a.point_id, round(sum({_D2.format(a='a', b='b')}), 4) + 0.0 AS dist_sum,
       round(min(CASE WHEN a.point_id <> b.point_id THEN {_D2.format(a='a', b='b')} END), 6) + 0.0 AS dist_min
FROM pts a, pts b GROUP BY a.point_id""")
def q_pairwise_distance(spark, sf_dir):
    """Row sums and nearest-other distance of the all-pairs distance matrix."""
    pts = PART.load(spark, sf_dir)
    st = SR.row_distance_stats(pts, 2)
    return st.select("point_id", rnd(F.col("dist_sum"), 4).alias("dist_sum"),
                     rnd(F.col("dist_min"), 6).alias("dist_min"))


_REST_SQL = _RANKED_SQL + f"""
, slots AS (SELECT DISTINCT slot FROM med)
, rest AS (SELECT p.point_id, s.slot, min({_D2.format(a='p', b='m')}) AS rest
           FROM pts p, slots s, med m WHERE m.slot <> s.slot GROUP BY p.point_id, s.slot)
, costs AS (SELECT r.slot, c.point_id, c.rank,
                   sum(least(r.rest, {_D2.format(a='p', b='c')})) AS cost
            FROM rest r JOIN pts p USING (point_id), pts c GROUP BY r.slot, c.point_id, c.rank)
"""


@register("swap_cost", _REST_SQL + """
SELECT point_id, round(cost, 4) + 0.0 AS cost FROM costs
WHERE slot = 0 AND point_id NOT IN (SELECT mid FROM med)""")
def q_swap_cost(spark, sf_dir):
    """Cost of swapping slot 0's medoid for each candidate."""
    pts = _ranked_part(spark, sf_dir)
    med = SR.initial_global(pts, K)
    costs = SR.swap_costs(SR.block_pairs(pts, 2), SR.medoid_coords(pts, med), [0])
    return (costs.where(~F.col("point_id").isin(med))
            .select("point_id", rnd(F.col("cost_0"), 4).alias("cost")))


@register("best_swap", _REST_SQL + """
, cur AS (SELECT c.slot, c.cost AS current_cost FROM costs c JOIN med m ON c.slot = m.slot AND c.point_id = m.mid)
, cand AS (SELECT * FROM costs WHERE point_id NOT IN (SELECT mid FROM med))
, low AS (SELECT slot, min(cost) AS low FROM cand GROUP BY slot)
, best AS (SELECT slot, point_id, cost FROM cand JOIN low USING (slot) WHERE cost <= low + {tol} * abs(low)
           QUALIFY row_number() OVER (PARTITION BY slot ORDER BY rank, point_id) = 1)
SELECT slot, point_id, round(cost, 4) + 0.0 AS cost, round(current_cost, 4) + 0.0 AS current_cost
FROM best JOIN cur USING (slot)""".format(tol=SM.TIE_RTOL))
def q_best_swap(spark, sf_dir):
    """Cheapest swap of every slot and the current cost."""
    pts = _ranked_part(spark, sf_dir)
    med = SR.initial_global(pts, K)
    table = SR.best_swaps(SR.block_pairs(pts, 2), SR.medoid_coords(pts, med), med, list(range(K)))
    rows = [(i, table[i][1][0], round(table[i][1][1], 4) + 0.0, round(table[i][0], 4) + 0.0)
            for i in range(K)]
    return spark.createDataFrame(rows, "slot INT, point_id BIGINT, cost DOUBLE, current_cost DOUBLE")


@register("slot_sweep", f"""
WITH pts AS (SELECT point_id, x0, x1, {_RANK_SQL.format(seed=SEED)} AS rank FROM ({PART.sql()})),
m0 AS (SELECT * FROM pts ORDER BY rank, point_id LIMIT 1),
m1 AS (SELECT * FROM pts ORDER BY rank, point_id LIMIT 1 OFFSET 1),
c0 AS (SELECT c.point_id, c.rank, sum(least({_D2.format(a='p', b='m1')}, {_D2.format(a='p', b='c')})) AS cost
       FROM pts p, m1, pts c GROUP BY c.point_id, c.rank),
cur0 AS (SELECT cost FROM c0 WHERE point_id = (SELECT point_id FROM m0)),
o0 AS (SELECT * FROM c0 WHERE point_id NOT IN (SELECT point_id FROM m0 UNION ALL SELECT point_id FROM m1)),
b0 AS (SELECT * FROM o0 WHERE cost <= (SELECT min(cost) FROM o0) * (1 + {SM.TIE_RTOL})
       ORDER BY rank, point_id LIMIT 1),
n0 AS (SELECT CASE WHEN b0.cost < cur0.cost * (1 - {SM.TIE_RTOL}) THEN b0.point_id ELSE (SELECT point_id FROM m0) END AS point_id
       FROM b0, cur0),
nm0 AS (SELECT pts.* FROM pts JOIN n0 USING (point_id)),
c1 AS (SELECT c.point_id, c.rank, sum(least({_D2.format(a='p', b='nm0')}, {_D2.format(a='p', b='c')})) AS cost
       FROM pts p, nm0, pts c GROUP BY c.point_id, c.rank),
cur1 AS (SELECT cost FROM c1 WHERE point_id = (SELECT point_id FROM m1)),
o1 AS (SELECT * FROM c1 WHERE point_id NOT IN (SELECT point_id FROM nm0 UNION ALL SELECT point_id FROM m1)),
b1 AS (SELECT * FROM o1 WHERE cost <= (SELECT min(cost) FROM o1) * (1 + {SM.TIE_RTOL})
       ORDER BY rank, point_id LIMIT 1),
n1 AS (SELECT CASE WHEN b1.cost < cur1.cost * (1 - {SM.TIE_RTOL}) THEN b1.point_id ELSE (SELECT point_id FROM m1) END AS point_id
       FROM b1, cur1)
SELECT CAST(0 AS INTEGER) AS slot, point_id FROM n0 UNION ALL SELECT CAST(1 AS INTEGER), point_id FROM n1""")
def q_slot_sweep(spark, sf_dir):
    """One slot sweep with k = 2 from the first two points in rank order."""
    pts = _ranked_part(spark, sf_dir)
    res = SR.sample_medoids(pts, 2, 2, max_sweeps=1)
    return spark.createDataFrame([(i, m) for i, m in enumerate(res.medoid_ids)],
                                 "slot INT, point_id BIGINT")


@register("medoid_lookup", _RANKED_SQL + "SELECT slot, mid AS point_id, x0, x1 FROM med")
def q_medoid_lookup(spark, sf_dir):
    """Coordinates of medoids by id (A12): broadcast join with the k ids."""
    pts = _ranked_part(spark, sf_dir)
    med = SR.initial_global(pts, K)
    return explode_coords(SR.medoid_lookup(pts, med), 2)


def _sweep_ctes(src: str, k: int, p: str) -> str:
    """CTEs replaying slot sweeps until a sweep changes nothing, over the
    points of CTE ``src`` (``point_id, x0, x1, rank``).

    State per step: the ``k`` medoid ids, the slot to visit, whether the
    current sweep swapped, and whether the run stopped. Each step scores
    every candidate for the slot (a LATERAL subquery over all point pairs).
    Defines ``{p}s`` (steps), ``{p}fin``, ``{p}med(slot, point_id, x0, x1)``
    and ``{p}cost(cost)`` (cost of the final set over ``src``).
    """
    def d(a, b):
        return f"sqrt(({a}.x0 - {b}.x0) * ({a}.x0 - {b}.x0) + ({a}.x1 - {b}.x1) * ({a}.x1 - {b}.x1))"

    def least(xs):
        return xs[0] if len(xs) == 1 else f"least({', '.join(xs)})"

    tol = SM.TIE_RTOL
    ms = [f"m{i}" for i in range(k)]
    dcols = ", ".join(f"{d('p', f'q{j}')} AS d{j}" for j in range(k))
    qjoins = " ".join(f"JOIN {src} q{j} ON q{j}.point_id = s.m{j}" for j in range(k))
    rest = "CASE s.slot " + " ".join(
        f"WHEN {i} THEN {least([f'd{j}' for j in range(k) if j != i])}" for i in range(k)) + " END"
    cur_med = "CASE s.slot " + " ".join(f"WHEN {i} THEN s.m{i}" for i in range(k)) + " END"
    dmin = least([d("p", f"f{j}") for j in range(k)])
    fjoins = " ".join(f"JOIN {src} f{j} ON f{j}.point_id = fin.m{j}" for j in range(k))
    slots = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS slot, m{i} AS point_id FROM {p}fin"
                               for i in range(k))
    return f"""
, {p}start AS (SELECT list(point_id ORDER BY rank, point_id)[1:{k}] AS m FROM {src})
, {p}s(step, slot, {', '.join(ms)}, changed, stop) AS (
  SELECT 0, 0, {', '.join(f'm[{i + 1}]' for i in range(k))}, false, false FROM {p}start
  UNION ALL
  SELECT s.step + 1, (s.slot + 1) % {k},
         {', '.join(f"CASE WHEN s.slot = {i} AND b.swap THEN b.best ELSE s.m{i} END" for i in range(k))},
         CASE WHEN s.slot = 0 THEN b.swap ELSE s.changed OR b.swap END,
         s.slot = {k - 1} AND NOT (s.changed OR b.swap)
  FROM {p}s s, LATERAL (
    WITH pr AS (SELECT p.point_id, {rest} AS rest FROM (SELECT p.*, {dcols} FROM {src} p, (SELECT 1) one {qjoins}) p),
    cand AS (SELECT c.point_id, c.rank, sum(least(pr.rest, {d('pp', 'c')})) AS cost
             FROM {src} c, pr JOIN {src} pp USING (point_id) GROUP BY c.point_id, c.rank),
    cur AS (SELECT cost FROM cand WHERE point_id = {cur_med}),
    oth AS (SELECT * FROM cand WHERE point_id NOT IN ({', '.join('s.' + m for m in ms)})),
    bst AS (SELECT point_id, cost FROM oth WHERE cost <= (SELECT min(cost) FROM oth) * (1 + {tol})
            ORDER BY rank, point_id LIMIT 1)
    SELECT bst.point_id AS best, bst.cost < cur.cost * (1 - {tol}) AS swap FROM bst, cur) b
  WHERE NOT s.stop)
, {p}fin AS (SELECT * FROM {p}s WHERE stop)
, {p}cost AS (SELECT sum({dmin}) AS cost FROM {src} p, {p}fin fin {fjoins})
, {p}med AS (SELECT x.slot, x.point_id, q.x0, q.x1 FROM ({slots}) x JOIN {src} q USING (point_id))
"""


def _sweep_sql(ps, k: int) -> str:
    """Sweeps until stable over all points of ``ps``."""
    return (f"WITH RECURSIVE pts AS (SELECT point_id, x0, x1, {_RANK_SQL.format(seed=SEED)} AS rank "
            f"FROM ({ps.sql()}))" + _sweep_ctes("pts", k, "w_") + f"""
SELECT slot, point_id, CAST((SELECT step FROM w_fin) / {k} AS INTEGER) AS sweeps,
       round((SELECT cost FROM w_cost), 4) + 0.0 AS cost
FROM w_med""")


def _phase1_ctes() -> str:
    """Grid sample (cell PAM) then sweeps until stable over it with k = K."""
    return _cell_pam_ctes() + _sweep_ctes("smp", K, "p1_")


@register("sample_medoids", _phase1_ctes() + """
SELECT slot, point_id, round((SELECT cost FROM p1_cost), 4) + 0.0 AS sample_cost FROM p1_med""")
def q_sample_medoids(spark, sf_dir):
    """k = 5 medoids of the grid sample (tau 20) by sweeps until stable."""
    grid, merged = _part_merged(spark, sf_dir)
    sample = checkpoint(SM.cell_pam(merged, 2, grid.avg_per_cell))
    res = SR.sample_medoids(sample, K, 2)
    return spark.createDataFrame([(i, m, round(res.cost, 4) + 0.0) for i, m in enumerate(res.medoid_ids)],
                                 "slot INT, point_id BIGINT, sample_cost DOUBLE")


# ---------------------------------------------------------------- refinement


_BASE_SQL = f"WITH RECURSIVE pts AS ({PART.sql()}), ctr AS ({centers_sql(PART, K)})"


def _assign_sql(p: str, ctr: str) -> str:
    """CTE ``{p}_ap``: part points with the id of their nearest center in ``ctr``."""
    return f"""
, {p}_pc AS (SELECT q.point_id, q.x0, q.x1, q.weight, c.center_id,
                    {_D2.format(a='q', b='c').replace('c.x', 'c.c')} AS dist FROM pts q, {ctr} c)
, {p}_ap AS (SELECT point_id, x0, x1, weight, center_id, dist FROM {p}_pc
             QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, center_id) = 1)
"""


def _sums_sql(it: str, ap: str, where: str) -> str:
    """Per center of ``it``: centered pull R, den, w_at at the estimate (x0, x1)."""
    return f"""
SELECT center_id, pass, x0, x1,
       coalesce(sum(CASE WHEN NOT at_x AND dist > 0 THEN weight * (ax0 - x0) / dist END), 0) AS r0,
       coalesce(sum(CASE WHEN NOT at_x AND dist > 0 THEN weight * (ax1 - x1) / dist END), 0) AS r1,
       coalesce(sum(CASE WHEN NOT at_x AND dist > 0 THEN weight / dist END), 0) AS den,
       coalesce(sum(CASE WHEN at_x THEN weight END), 0) AS w_at
FROM (SELECT it.center_id, it.pass, it.x0, it.x1, a.weight, a.x0 AS ax0, a.x1 AS ax1,
             (a.x0 = it.x0 AND a.x1 = it.x1) AS at_x,
             sqrt((a.x0 - it.x0) * (a.x0 - it.x0) + (a.x1 - it.x1) * (a.x1 - it.x1)) AS dist
      FROM {it} it JOIN {ap} a USING (center_id) WHERE {where}) j
GROUP BY center_id, pass, x0, x1"""


def _update_sql(sums: str) -> str:
    """Next estimate from the sums (T off the data, S or stay on a data point)."""
    def nx(i):
        return (f"CASE WHEN w_at = 0 AND den = 0 THEN x{i} WHEN w_at = 0 THEN x{i} + r{i} / den "
                f"WHEN rn <= w_at OR den = 0 THEN x{i} ELSE x{i} + (rn - w_at) / den * r{i} / rn END")
    return f"""
SELECT center_id, pass, x0, x1, {nx(0)} AS nx0, {nx(1)} AS nx1, rn, den, w_at, r0, r1
FROM (SELECT *, sqrt(r0 * r0 + r1 * r1) AS rn FROM ({sums}) s) t"""


def _median_sql(p: str, ctr: str, eps: float, max_passes: int | None) -> str:
    """CTEs ``{p}_ap`` (assignment), ``{p}_it`` (passes), ``{p}_out`` (centers)."""
    cap = f" AND it.pass < {max_passes}" if max_passes is not None else ""
    upd = _update_sql(_sums_sql(f"{p}_it", f"{p}_ap", f"it.step > {eps}{cap}"))
    return _assign_sql(p, ctr) + f"""
, {p}_it AS (
    SELECT center_id, 0 AS pass, c0 AS x0, c1 AS x1, CAST('inf' AS DOUBLE) AS step FROM {ctr}
    WHERE center_id IN (SELECT center_id FROM {p}_ap)
    UNION ALL
    SELECT center_id, pass + 1, nx0, nx1, sqrt((nx0 - x0) * (nx0 - x0) + (nx1 - x1) * (nx1 - x1))
    FROM ({upd}) u)
, {p}_out AS (
    SELECT center_id, x0 AS c0, x1 AS c1, pass AS passes FROM {p}_it
    QUALIFY row_number() OVER (PARTITION BY center_id ORDER BY pass DESC) = 1
    UNION ALL
    SELECT center_id, c0, c1, 0 FROM {ctr} WHERE center_id NOT IN (SELECT center_id FROM {p}_ap))
"""


def _cost_sql(ctr: str) -> str:
    return (f"(SELECT sum(dist) FROM (SELECT min({_D2.format(a='q', b='c').replace('c.x', 'c.c')}) AS dist "
            f"FROM pts q, {ctr} c GROUP BY q.point_id))")


def _part_centers(spark, sf_dir):
    pts = PART.load(spark, sf_dir)
    return pts, first_k_centers(pts, K)


@register("cluster_sizes", _BASE_SQL + _assign_sql("r", "ctr") + """
SELECT center_id, count(*) AS n, sum(weight) AS weight FROM r_ap GROUP BY center_id""")
def q_cluster_sizes(spark, sf_dir):
    pts, ctr = _part_centers(spark, sf_dir)
    return A.cluster_sizes(pts, ctr)


@register("merge_duplicates", _BASE_SQL + _assign_sql("r", "ctr") + """
SELECT center_id, x0, x1, count(*) AS n, sum(weight) AS weight FROM r_ap GROUP BY center_id, x0, x1""")
def q_merge_duplicates(spark, sf_dir):
    pts, ctr = _part_centers(spark, sf_dir)
    merged = W.merge_duplicates(pts)
    return explode_coords(W.assign_to(merged, ctr).select("center_id", "coords", "n", "weight"), 2)


@register("median_objective", _BASE_SQL + _assign_sql("r", "ctr") + """
SELECT center_id, round(sum(weight * dist), 4) + 0.0 AS objective, count(*) AS n FROM r_ap GROUP BY center_id""")
def q_median_objective(spark, sf_dir):
    pts, ctr = _part_centers(spark, sf_dir)
    return A.median_objective(pts, ctr).select("center_id", rnd(F.col("objective"), 4).alias("objective"), "n")


_OFF = 0.25  # W3 evaluates T at center + 0.25 in every coordinate: never a data point of part


@register("weiszfeld_step", _BASE_SQL + _assign_sql("r", "ctr") + f"""
, it AS (SELECT center_id, 0 AS pass, c0 + {_OFF} AS x0, c1 + {_OFF} AS x1 FROM ctr)
, s AS ({_sums_sql("it", "r_ap", "TRUE")})
SELECT center_id, round(x0 + r0 / den, 6) + 0.0 AS t0, round(x1 + r1 / den, 6) + 0.0 AS t1 FROM s""")
def q_weiszfeld_step(spark, sf_dir):
    """Operator T at a point off the data."""
    pts, ctr = _part_centers(spark, sf_dir)
    assigned = W.assign_to(pts, ctr)
    xs = {j: [v + _OFF for v in c] for j, c in ctr}
    st = W.pass_stats(assigned, xs, 2)
    st = st.join(F.broadcast(W.estimates(spark, xs)), "center_id")
    return st.select("center_id", *[rnd(F.col("_x")[i] + F.col(f"r_{i}") / F.col("den"), 6).alias(f"t{i}")
                                    for i in range(2)])


@register("weiszfeld_pull", _BASE_SQL + _assign_sql("r", "ctr") + f"""
, it AS (SELECT center_id, 0 AS pass, c0 AS x0, c1 AS x1 FROM ctr)
, s AS ({_sums_sql("it", "r_ap", "TRUE")})
SELECT center_id, round(r0, 6) + 0.0 AS r0, round(r1, 6) + 0.0 AS r1, round(den, 9) + 0.0 AS l,
       w_at FROM s""")
def q_weiszfeld_pull(spark, sf_dir):
    """R and L at the center, a data point of its cluster."""
    pts, ctr = _part_centers(spark, sf_dir)
    st = W.pass_stats(W.assign_to(pts, ctr), {j: c for j, c in ctr}, 2)
    return st.select("center_id", rnd(F.col("r_0"), 6).alias("r0"), rnd(F.col("r_1"), 6).alias("r1"),
                     rnd(F.col("den"), 9).alias("l"), F.coalesce(F.col("w_at"), F.lit(0.0)).alias("w_at"))


@register("weiszfeld_anchor_step", _BASE_SQL + _assign_sql("r", "ctr") + f"""
, it AS (SELECT center_id, 0 AS pass, c0 AS x0, c1 AS x1 FROM ctr)
, u AS ({_update_sql(_sums_sql("it", "r_ap", "TRUE"))})
SELECT center_id, round(nx0, 6) + 0.0 AS x0, round(nx1, 6) + 0.0 AS x1 FROM u""")
def q_weiszfeld_anchor_step(spark, sf_dir):
    """Operator S from the center, stepping along +R."""
    pts, ctr = _part_centers(spark, sf_dir)
    st = W.pass_stats(W.assign_to(pts, ctr), {j: c for j, c in ctr}, 2).collect()
    cmap = dict(ctr)
    rows = []
    for r in st:
        j = int(r["center_id"])
        new, _ = W.weiszfeld_update(cmap[j], [r["r_0"] or 0.0, r["r_1"] or 0.0], r["den"] or 0.0,
                                    r["w_at"] or 0.0)
        rows.append((j, round(new[0], 6) + 0.0, round(new[1], 6) + 0.0))
    return spark.createDataFrame(rows, "center_id INT, x0 DOUBLE, x1 DOUBLE")


@register("geometric_median", _BASE_SQL + _median_sql("g", "ctr", 0.0, 3) + """
SELECT center_id, round(c0, 4) + 0.0 AS x0, round(c1, 4) + 0.0 AS x1, CAST(passes AS INTEGER) AS passes
FROM g_out""")
def q_geometric_median(spark, sf_dir):
    """Three Weiszfeld passes per cluster, epsilon 0."""
    pts, ctr = _part_centers(spark, sf_dir)
    res = W.geometric_medians(W.assign_to(pts, ctr), {j: c for j, c in ctr}, 2, 0.0, 3)
    rows = [(j, round(x[0], 4) + 0.0, round(x[1], 4) + 0.0, res.passes[j]) for j, x in res.centers.items()]
    return spark.createDataFrame(rows, "center_id INT, x0 DOUBLE, x1 DOUBLE, passes INT")


@register("refine_once", _BASE_SQL + _median_sql("g", "ctr", W.EPSILON, None) + """
SELECT center_id, round(c0, 4) + 0.0 AS x0, round(c1, 4) + 0.0 AS x1, CAST(passes AS INTEGER) AS passes
FROM g_out""")
def q_refine_once(spark, sf_dir):
    """One refinement to epsilon 0.01 on merged points (W2 + W8)."""
    pts, ctr = _part_centers(spark, sf_dir)
    merged = W.merge_duplicates(pts)
    new, res = W.refine_once(merged, ctr, 2, method="weiszfeld")
    rows = [(j, round(x[0], 4) + 0.0, round(x[1], 4) + 0.0, res.passes[j]) for j, x in new]
    return spark.createDataFrame(rows, "center_id INT, x0 DOUBLE, x1 DOUBLE, passes INT")


@register("cost_trace", _BASE_SQL + _median_sql("g", "ctr", W.EPSILON, None)
          + _median_sql("h", "g_out", W.EPSILON, None) + f"""
SELECT 'start' AS phase, CAST(0 AS INTEGER) AS iteration, round({_cost_sql('ctr')}, 4) + 0.0 AS cost
UNION ALL SELECT 'phase2', 0, round({_cost_sql('g_out')}, 4) + 0.0
UNION ALL SELECT 'phase2', 1, round({_cost_sql('h_out')}, 4) + 0.0""")
def q_cost_trace(spark, sf_dir):
    """Cost at the start centers and after each of two refinements."""
    pts, ctr = _part_centers(spark, sf_dir)
    tr = PL.cost_trace(pts, ctr, 2, method="weiszfeld")
    return tr.select("phase", "iteration", rnd(F.col("cost"), 4).alias("cost"))


# ---------------------------------------------------------------- vector functions, sources


def _emb_with_label(spark, sf_dir):
    src = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return src.select(F.col("vec_id").alias("point_id"),
                      F.transform("embedding", lambda v: v.cast("double")).alias("coords"), "label")


@register("vec_norm", f"""
WITH pts AS ({EMBED.sql()})
SELECT point_id, round({' + '.join(f'x{i} * x{i}' for i in range(64))}, 9) + 0.0 AS norm2,
       round(sqrt({' + '.join(f'x{i} * x{i}' for i in range(64))}), 9) + 0.0 AS norm FROM pts""")
def q_vec_norm(spark, sf_dir):
    """Squared norm and norm of 64-d embeddings (V2, higher-order form)."""
    pts = EMBED.load(spark, sf_dir)
    return pts.select("point_id", rnd(V.squared_norm("coords"), 9).alias("norm2"),
                      rnd(V.norm("coords"), 9).alias("norm"))


@register("vec_sum_by_label", """
SELECT label, count(*) AS n, """ + ", ".join(
    f"round(sum(CAST(embedding[{i + 1}] AS DOUBLE)), 6) + 0.0 AS s{i}" for i in range(64))
    + " FROM embeddings GROUP BY label")
def q_vec_sum_by_label(spark, sf_dir):
    """Per-label coordinate sums of the embeddings (V3 as an accumulator)."""
    pts = _emb_with_label(spark, sf_dir)
    g = pts.groupBy("label").agg(F.count("*").alias("n"), *V.sum_vectors("coords", 64))
    return g.select("label", "n", *[rnd(F.col(f"s{i}"), 6).alias(f"s{i}") for i in range(64)])


@register("vec_subtract", _NEAREST_SQL.split(", pc AS")[0] + """
SELECT p.point_id, round(p.x0 - c.c0, 6) + 0.0 AS x0, round(p.x1 - c.c1, 6) + 0.0 AS x1
FROM pts p, ctr c WHERE c.center_id = 0""")
def q_vec_subtract(spark, sf_dir):
    """Each part point minus the first center (V4)."""
    pts, ctr = _part_and_centers(spark, sf_dir)
    diff = pts.select("point_id", V.subtract("coords", ctr[0][1]).alias("coords"))
    return diff.select("point_id", *[rnd(F.col("coords")[i], 6).alias(f"x{i}") for i in range(2)])


@register("vec_scale", f"""
SELECT point_id, round(x0 * 0.5, 6) + 0.0 AS x0, round(x1 * 0.5, 6) + 0.0 AS x1 FROM ({PART.sql()})""")
def q_vec_scale(spark, sf_dir):
    """Each part point scaled by 0.5 (V5)."""
    pts = PART.load(spark, sf_dir).select("point_id", V.scale("coords", 0.5).alias("coords"))
    return pts.select("point_id", *[rnd(F.col("coords")[i], 6).alias(f"x{i}") for i in range(2)])


@register("vec_equal", _NEAREST_SQL.split(", pc AS")[0] + """
SELECT p.point_id, bool_or(p.x0 = c.c0 AND p.x1 = c.c1) AS eq FROM pts p, ctr c GROUP BY p.point_id""")
def q_vec_equal(spark, sf_dir):
    """Whether each part point equals one of the centers in every coordinate (V6)."""
    pts, ctr = _part_and_centers(spark, sf_dir)
    eq = None
    for _, c in ctr:
        e = V.equal("coords", c)
        eq = e if eq is None else (eq | e)
    return pts.select("point_id", eq.alias("eq"))


@register("vec_order", f"""
SELECT point_id, row_number() OVER (ORDER BY x0, x1, point_id) - 1 AS ord FROM ({PART.sql()})""")
def q_vec_order(spark, sf_dir):
    """Position of each part point in lexicographic coordinate order (V7, V9)."""
    pts = PART.load(spark, sf_dir).select("point_id", "coords")
    return V.lexicographic_index(pts).select("point_id", "ord")


@register("vec_to_string", f"""
SELECT point_id, CAST(x0 AS VARCHAR) || ',' || CAST(x1 AS VARCHAR) AS text FROM ({PART.sql()})""")
def q_vec_to_string(spark, sf_dir):
    """Points printed as ``a,b`` (V8)."""
    pts = PART.load(spark, sf_dir)
    return pts.select("point_id", V.to_text("coords").alias("text"))


@register("read_points_text", f"SELECT x0, x1, weight FROM ({PART.sql()})")
def q_read_points_text(spark, sf_dir):
    """Write the part points as tab-separated text in the shared folder, read
    them back with the text reader (S1, S4)."""
    path = scratch_path(spark, "part-tsv")
    SP.write_points_text(PART.load(spark, sf_dir), path)
    pts = SP.read_points_text(spark, path)
    return explode_coords(pts, 2).drop("point_id")


@register("point_index", """
SELECT count(*) AS n, CAST(0 AS BIGINT) AS min_id, count(*) - 1 AS max_id, count(*) AS n_distinct
FROM lineitem""")
def q_point_index(spark, sf_dir):
    """Contiguous ids 0..n-1 for a keyless table (S3): lineitem."""
    src = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pts = SP.read_points_table(src, ["l_quantity", "l_extendedprice"])
    return pts.agg(F.count("*").alias("n"), F.min("point_id").alias("min_id"),
                   F.max("point_id").alias("max_id"), F.countDistinct("point_id").alias("n_distinct"))


# ---------------------------------------------------------------- whole run

RUN_K, RUN_TAU, RUN_ITER = 5, 20, 2


def _run(spark, sf_dir, iterations=RUN_ITER):
    return PL.cluster(PART.load(spark, sf_dir), RUN_K, RUN_TAU, iterations, seed=SEED, method="weiszfeld")


def _run_ctes() -> str:
    """The whole run: grid sample, sweeps (k = K), two refinements."""
    assert RUN_K == K and RUN_TAU == TAU and RUN_ITER == 2
    return (_phase1_ctes()
            + ", ctr0 AS (SELECT slot AS center_id, x0 AS c0, x1 AS c1 FROM p1_med)"
            + _median_sql("g", "ctr0", W.EPSILON, None) + _median_sql("h", "g_out", W.EPSILON, None))


@register("cluster_run", _run_ctes() + """
SELECT CAST(center_id AS INTEGER) AS center_id, round(c0, 4) + 0.0 AS x0, round(c1, 4) + 0.0 AS x1,
       'median' AS kind FROM h_out""")
def q_cluster_run(spark, sf_dir):
    """The whole run on part (k 5, tau 20, 2 refinements): final centers (M1)."""
    res = _run(spark, sf_dir)
    return res.centers.select("center_id", *[rnd(F.col("coords")[i], 4).alias(f"x{i}") for i in range(2)],
                              "kind")


@register("run_metrics", _run_ctes() + f"""
, vals(phase, iteration, metric, value) AS (
  SELECT 'grid', 0, 'n', CAST(n AS DOUBLE) FROM spec
  UNION ALL SELECT 'grid', 0, 'k', {RUN_K}.0
  UNION ALL SELECT 'grid', 0, 'tau', {RUN_TAU}.0
  UNION ALL SELECT 'grid', 0, 'uniform_cells', CAST(P0 * P1 AS DOUBLE) FROM spec
  UNION ALL SELECT 'grid', 0, 'uniform_avg_per_cell', n / (P0 * P1) FROM spec
  UNION ALL SELECT 'grid', 0, 'adaptive_cells', CAST(n_cells AS DOUBLE) FROM st
  UNION ALL SELECT 'grid', 0, 'levels', CAST(max(level) + 1 AS DOUBLE) FROM leafp
  UNION ALL SELECT 'sample', 0, 'sample_size', CAST(count(*) AS DOUBLE) FROM fm
  UNION ALL SELECT 'phase1', 0, 'sample_cost', cost FROM p1_cost
  UNION ALL SELECT 'phase1', 0, 'sweeps', CAST(step / {K} AS DOUBLE) FROM p1_fin
  UNION ALL SELECT 'phase1', 0, 'cost', {_cost_sql('ctr0')}
  UNION ALL SELECT 'phase2', 0, 'passes', CAST(max(passes) AS DOUBLE) FROM g_out
  UNION ALL SELECT 'phase2', 0, 'cost', {_cost_sql('g_out')}
  UNION ALL SELECT 'phase2', 1, 'passes', CAST(max(passes) AS DOUBLE) FROM h_out
  UNION ALL SELECT 'phase2', 1, 'cost', {_cost_sql('h_out')})
SELECT phase, CAST(iteration AS INTEGER) AS iteration, metric, round(value, 4) + 0.0 AS value FROM vals""")
def q_run_metrics(spark, sf_dir):
    """The run report as rows."""
    m = _run(spark, sf_dir).metrics
    return m.select("phase", "iteration", "metric", rnd(F.col("value"), 4).alias("value"))


@register("write_result", _run_ctes() + _assign_sql("w", "h_out") + """
SELECT CAST(h.center_id AS INTEGER) AS center_id, round(c0, 4) + 0.0 AS x0, round(c1, 4) + 0.0 AS x1, 'median' AS kind,
       coalesce(a.n, 0) AS n, round(coalesce(a.cost, 0), 3) + 0.0 AS cost, 15 AS n_metrics
FROM h_out h LEFT JOIN (SELECT center_id, count(*) AS n, sum(dist) AS cost FROM w_ap GROUP BY center_id) a USING (center_id)""")
def q_write_result(spark, sf_dir):
    """The whole run's result written to the shared folder and read back (S6):
    centers, their assigned points, and the rows of the report."""
    path = scratch_path(spark, "result")
    PL.write_cluster_result(_run(spark, sf_dir), path)
    centers, points, metrics = (spark.read.parquet(f"{path}/{t}") for t in ("centers", "assignments", "run_metrics"))
    per = points.groupBy("center_id").agg(F.count("*").alias("n"), F.sum("distance").alias("cost"))
    return (centers.join(per, "center_id", "left")
            .select("center_id", *[rnd(F.col("coords")[i], 4).alias(f"x{i}") for i in range(2)], "kind",
                    F.coalesce("n", F.lit(0)).alias("n"), rnd(F.coalesce("cost", F.lit(0.0)), 3).alias("cost"),
                    F.lit(metrics.count()).cast("int").alias("n_metrics")))


@register("refine_trace", _run_ctes() + f"""
SELECT CAST(0 AS INTEGER) AS iteration, round({_cost_sql('g_out')}, 4) + 0.0 AS cost
UNION ALL SELECT 1, round({_cost_sql('h_out')}, 4) + 0.0""")
def q_refine_trace(spark, sf_dir):
    """Phase-2 cost after each refinement of the whole run."""
    m = _run(spark, sf_dir).metrics
    return m.where((F.col("phase") == "phase2") & (F.col("metric") == "cost")).select(
        "iteration", rnd(F.col("value"), 4).alias("cost"))


def flagship(spark, sf_dir):
    """Flagship: the whole run's centers with their cluster sizes."""
    pts = PART.load(spark, sf_dir)
    res = PL.cluster(pts, RUN_K, RUN_TAU, RUN_ITER, seed=SEED, method="weiszfeld")
    sizes = res.assignments.groupBy("center_id").agg(F.count("*").alias("n"),
                                                     F.sum("distance").alias("cost"))
    cen = res.centers.select("center_id", *[F.col("coords")[i].alias(f"x{i}") for i in range(2)], "kind")
    return cen.join(sizes, "center_id", "left").orderBy("center_id")


# ---------------------------------------------------------------- other point sets


_EVENTS_GRID = _grid_sql(EVENTS, TAU, LEVELS)


@register("adaptive_grid_events", _EVENTS_GRID + f"""
SELECT point_id, {_key_sql(2)} AS cell_key, CAST(level AS INTEGER) AS depth FROM leafp""")
def q_adaptive_grid_events(spark, sf_dir):
    """Adaptive leaves of events(value, user_id): skewed density, deep splits."""
    pts = EVENTS.load(spark, sf_dir)
    grid = G.adaptive_grid(pts, TAU, 2)
    return grid.points.select("point_id", "cell_key", F.col("depth").cast("int").alias("depth"))


@register("grid_stats_events", _EVENTS_GRID + f"""
, sp AS (SELECT count(*) AS n_splits FROM cnt WHERE cell_n > {TAU} AND NOT same)
SELECT n, P0 * P1 AS n_uniform, n_splits, P0 * P1 + 3 * n_splits AS n_cells FROM spec, sp""")
def q_grid_stats_events(spark, sf_dir):
    """Cell counts of the events grid, empty cells included."""
    pts = EVENTS.load(spark, sf_dir)
    grid = G.adaptive_grid(pts, TAU, 2)
    row = [(grid.spec.n, grid.spec.n_uniform, grid.n_splits, grid.n_cells)]
    return spark.createDataFrame(row, "n BIGINT, n_uniform BIGINT, n_splits BIGINT, n_cells BIGINT")


_LI3 = ("l_quantity", "l_discount", "l_tax")


@register("merge_duplicates_lineitem", """
SELECT CAST(l_quantity AS DOUBLE) AS x0, CAST(l_discount AS DOUBLE) AS x1, CAST(l_tax AS DOUBLE) AS x2,
       count(*) AS n, sum(CAST(1.0 AS DOUBLE)) AS weight
FROM lineitem GROUP BY ALL""")
def q_merge_duplicates_lineitem(spark, sf_dir):
    """Distinct points of lineitem(l_quantity, l_discount, l_tax) with copies counted."""
    src = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pts = SP.read_points_table(src, list(_LI3))
    return explode_coords(W.merge_duplicates(pts).select("coords", "n", "weight"), 3)


@register("clustering_cost_lineitem", _NEAREST_SQL.split(", pc AS")[0] + """
, li AS (SELECT CAST(l_quantity AS DOUBLE) AS x0, l_extendedprice AS x1 FROM lineitem)
, best AS (SELECT min(sqrt((l.x0 - c.c0) * (l.x0 - c.c0) + (l.x1 - c.c1) * (l.x1 - c.c1))) AS dist
           FROM (SELECT row_number() OVER () AS rid, * FROM li) l, ctr c GROUP BY l.rid)
SELECT round(sum(dist), 2) + 0.0 AS cost, count(*) AS n FROM best""")
def q_clustering_cost_lineitem(spark, sf_dir):
    """Cost of lineitem(l_quantity, l_extendedprice) against five part points."""
    _, ctr = _part_and_centers(spark, sf_dir)
    src = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pts = SP.read_points_table(src, ["l_quantity", "l_extendedprice"])
    m = A.nearest("coords", A.centers_list(ctr))
    return pts.agg(rnd(F.sum(m["distance"]), 2).alias("cost"), F.count("*").alias("n"))


_CUST_K = 3


@register("assign_nearest_customer", f"""
WITH pts AS ({CUSTOMER.sql()}), ctr AS ({centers_sql(CUSTOMER, _CUST_K)}),
pc AS (SELECT p.point_id, c.center_id, abs(p.x0 - c.c0) AS dist FROM pts p, ctr c)
SELECT point_id, center_id, round(dist, 6) + 0.0 AS distance FROM pc
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, center_id) = 1""")
def q_assign_nearest_customer(spark, sf_dir):
    """Nearest of three centers in one dimension with negative values."""
    pts = CUSTOMER.load(spark, sf_dir)
    out = A.assign_nearest(pts, first_k_centers(pts, _CUST_K))
    return out.select("point_id", "center_id", rnd(F.col("distance"), 6).alias("distance"))


_EMB_BIG_K = 10   # 10 centers x 64 dims = 640 terms: the higher-order path of E2


@register("assign_nearest_hd", f"""
WITH pts AS ({EMBED.sql()}), ctr AS ({centers_sql(EMBED, _EMB_BIG_K)}),
pc AS (SELECT p.point_id, c.center_id, {sql_dist(64, 'x', 'c', 'p.', 'c.')} AS dist FROM pts p, ctr c)
SELECT point_id, center_id, round(dist, 6) + 0.0 AS distance FROM pc
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, center_id) = 1""")
def q_assign_nearest_hd(spark, sf_dir):
    """Nearest of ten 64-d centers: k*d above the unroll limit (E2, aggregate form)."""
    pts = EMBED.load(spark, sf_dir)
    out = A.assign_nearest(pts, first_k_centers(pts, _EMB_BIG_K))
    return out.select("point_id", "center_id", rnd(F.col("distance"), 6).alias("distance"))


_MANY_K = 1000    # centers for which the index of E2 measures a few groups each


@register("assign_nearest_many", f"""
WITH pts AS ({EVENTS.sql()}), ctr AS ({centers_sql(EVENTS, _MANY_K)}),
pc AS (SELECT p.point_id, c.center_id, {sql_dist(2, 'x', 'c', 'p.', 'c.')} AS dist FROM pts p, ctr c)
SELECT point_id, center_id, round(dist, 6) + 0.0 AS distance FROM pc
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, center_id) = 1""")
def q_assign_nearest_many(spark, sf_dir):
    """Nearest of a thousand centers (E2 by triangle-inequality bounds)."""
    pts = EVENTS.load(spark, sf_dir)
    out = A.assign_nearest(pts, first_k_centers(pts, _MANY_K))
    return out.select("point_id", "center_id", rnd(F.col("distance"), 6).alias("distance"))


# ---------------------------------------------------------------- sweeps until stable


_SWEEP_K = 3


@register("sweep_until_stable", _sweep_sql(PART, _SWEEP_K))
def q_sweep_until_stable(spark, sf_dir):
    """k = 3 medoids of all part points by slot sweeps until a sweep changes
    nothing (A9-A11), through the distributed scoring path."""
    pts = _ranked_part(spark, sf_dir)
    res = SR.sample_medoids(pts, _SWEEP_K, 2)
    cost = A.clustering_cost_value(pts, [(j, list(map(float, c))) for j, c in enumerate(res.medoids)])
    rows = [(i, m, res.sweeps, round(cost, 4) + 0.0) for i, m in enumerate(res.medoid_ids)]
    return spark.createDataFrame(rows, "slot INT, point_id BIGINT, sweeps INT, cost DOUBLE")
