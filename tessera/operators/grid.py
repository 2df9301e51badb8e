"""Uniform and adaptive gridding.

A uniform grid of cubes of side ``side`` covers the bounding box, sized so
a cell holds about ``tau`` points. A cell with more than ``tau`` points is
halved in every dimension, recursively, until each leaf holds at most
``tau`` points (or only copies of one point, or ``max_depth`` is reached).

Spark plan: one aggregate for the bounds (G1); cell numbers are arithmetic
on the coordinates (G4, no lookup table). The adaptive split never rewrites the points. It
builds a directory, the keys of the cells that split at each level, and a point's leaf is a
narrow projection: the first level at which its cell, a prefix of its finest index,
is not in the directory (one broadcast hash join a level, by counted bytes; rows that have
settled carry a null key). Counts come level by level, several levels from one scan: the
unsettled points are counted per cell of the finest level of a stage (0, then 1-2, then
3-6, ...; partial aggregation, so a hot cell costs one row per task in the shuffle), and the
coarser levels are added up from these counts. A cell that splits has only ancestors that
split, so all levels of a stage are decided at once. The scans grow with the logarithm of the
levels, and what is written are counts of cells.

Cell labels: the uniform cell's row-major number (dimension 0 outermost; the
indices themselves, joined by ``-``, when the numbers exceed 63 bits), then one ``.child`` per split, ``child = sum(b_i * 2^(d-1-i))`` with
``b_i`` = 1 when the point lies in the upper half of dimension ``i``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint

MAX_DEPTH = 60  # doubles separate after at most ~53 halvings
# split-cell keys of at most this many bytes are broadcast to route the points
BROADCAST_BYTES = 64 * 1024 ** 2
# levels whose joins one plan holds; what is unsettled after so many (few rows) is checkpointed
LEVELS_AT_ONCE = 8
# up to this many dimensions the level index is one expression a dimension
UNROLL_DIMS = 8


@dataclass
class GridSpec:
    """Bounds and uniform grid of a point table (G1, G2, G3 sizes)."""
    d: int
    n: int
    tau: int
    mins: list[float]
    maxs: list[float]
    side: float
    parts: list[int]          # cells per dimension, P_i
    active: list[bool]        # False for a constant dimension (D7)

    @property
    def d_eff(self) -> int:
        return sum(self.active)

    @property
    def strides(self) -> list[int]:
        out, s = [0] * self.d, 1
        for i in reversed(range(self.d)):
            out[i] = s
            s *= self.parts[i]
        return out

    @property
    def n_uniform(self) -> int:
        return math.prod(self.parts)

    @property
    def numbered(self) -> bool:
        """Whether the row-major cell numbers fit 63 bits."""
        return self.n_uniform < 2 ** 63


def bounding_box(points: DataFrame, d: int) -> DataFrame:
    """One row: ``n`` and ``min_x{i}``, ``max_x{i}`` per dimension, in one job (G1)."""
    aggs = [F.count("*").alias("n")]
    for i in range(d):
        aggs += [F.min(F.col("coords")[i]).alias(f"min_x{i}"),
                 F.max(F.col("coords")[i]).alias(f"max_x{i}")]
    return points.agg(*aggs)


def cell_side(mins, maxs, n: int, tau: int) -> tuple[float, list[bool]]:
    """Cube side ``(prod(range_i) * tau / n) ** (1 / d_eff)`` over the
    non-constant dimensions (G2, D7)."""
    active = [hi > lo for lo, hi in zip(mins, maxs)]
    d_eff = sum(active)
    if d_eff == 0 or n == 0:
        return 1.0, active
    volume = 1.0
    for lo, hi, a in zip(mins, maxs, active):
        if a:
            volume *= (hi - lo)
    cell_volume = volume * tau / n
    return math.pow(cell_volume, 1.0 / d_eff), active


def grid_spec(points: DataFrame, tau: int, d: int) -> GridSpec:
    """Bounds (one job) and uniform grid sizes ``P_i = ceil(range_i / side)``."""
    row = bounding_box(points, d).first()
    n = int(row["n"])
    if n == 0:
        raise ValueError("empty point table")
    mins = [float(row[f"min_x{i}"]) for i in range(d)]
    maxs = [float(row[f"max_x{i}"]) for i in range(d)]
    side, active = cell_side(mins, maxs, n, tau)
    parts = [max(1, math.ceil((hi - lo) / side)) if a else 1
             for lo, hi, a in zip(mins, maxs, active)]
    return GridSpec(d, n, tau, mins, maxs, side, parts, active)


def uniform_index(spec: GridSpec, x: Column | str = "coords") -> list[Column]:
    """Per-dimension uniform cell index, clamped to ``P_i - 1``."""
    x = F.col(x) if isinstance(x, str) else x
    out = []
    for i in range(spec.d):
        if not spec.active[i]:
            out.append(F.lit(0).cast("bigint"))
            continue
        raw = F.floor((x[i] - F.lit(spec.mins[i])) / F.lit(spec.side))
        out.append(F.least(raw, F.lit(spec.parts[i] - 1).cast("bigint")))
    return out


def uniform_grid_assign(points: DataFrame, spec: GridSpec) -> DataFrame:
    """Add ``c`` (per-dimension indices), ``cell`` (row-major number, or the
    joined indices beyond 63 bits) and ``u`` (position inside the cell, each
    coordinate in [0, 1]) (G4, G5)."""
    idx = uniform_index(spec)
    if spec.numbered:
        number = F.lit(0).cast("bigint")
        for i, st in enumerate(spec.strides):
            if spec.parts[i] > 1:
                number = number + idx[i] * F.lit(st)
    else:
        number = F.concat_ws("-", *[x.cast("string") for x in idx])
    c = F.array(*idx)
    us = []
    for i in range(spec.d):
        if spec.active[i]:
            pos = (F.col("coords")[i] - F.lit(spec.mins[i])) / F.lit(spec.side)
            us.append(pos - idx[i])
        else:
            us.append(F.lit(0.0))
    return points.select("*", c.alias("c"), number.alias("cell"), F.array(*us).alias("u"))


def uniform_cells(spark, spec: GridSpec) -> DataFrame:
    """Every uniform cell with bounds, empty ones included.

    Built on request from ``spark.range`` over the row-major numbers (no
    per-dimension cross product); its size is ``prod(P_i)``, which grows
    exponentially with the dimension (D9), so callers should check
    ``spec.n_uniform`` first.
    """
    if not spec.numbered:
        raise ValueError(f"{spec.n_uniform} uniform cells cannot be listed")
    cols = [F.col("id").alias("cell")]
    for i, st in enumerate(spec.strides):
        ci = (F.col("id") / F.lit(st)).cast("bigint") % F.lit(spec.parts[i])
        if spec.active[i]:
            lo = F.lit(spec.mins[i]) + ci * F.lit(spec.side)
            hi = lo + F.lit(spec.side)
        else:
            lo = hi = F.lit(spec.mins[i])
        cols += [ci.alias(f"c{i}"), lo.alias(f"lo{i}"), hi.alias(f"hi{i}")]
    return spark.range(spec.n_uniform).select(*cols)


def cell_counts(gridded: DataFrame) -> DataFrame:
    """``(cell, n)`` for occupied uniform cells."""
    return gridded.groupBy("cell").agg(F.count("*").alias("n"))


def _cell_index(spec: GridSpec, i: int) -> Column:
    """Index of a cell in dimension ``i``, from ``cell``."""
    if spec.numbered:
        return F.expr(f"cell div {spec.strides[i]}L") % F.lit(spec.parts[i])
    return F.split("cell", "-")[i].cast("bigint")


def _level_index(level: int, d: int) -> Column:
    """Sub-cell index per dimension at ``level``: ``min(floor(u * 2^l), 2^l - 1)``."""
    scale = float(2 ** level)
    top = F.lit((2 ** level) - 1).cast("bigint")

    def at(v):
        return F.least(F.floor(v * F.lit(scale)), top)
    if d <= UNROLL_DIMS:
        return F.array(*[at(F.col("u")[i]) for i in range(d)])
    return F.transform(F.col("u"), at)


def _child_label(spec: GridSpec, level: int) -> Column:
    """``cell.child1.child2...`` for leaves at ``level`` (G5 for splits)."""
    return F.concat_ws(".", F.col("cell").cast("string"), *[_child(spec, lambda x: F.shiftright(x, level - j)) for j in range(1, level + 1)])


def _child(spec: GridSpec, shifted) -> Column:
    """Text of the child that ``a``, shifted right to a level, takes there."""
    act = [i for i in range(spec.d) if spec.active[i]]
    bits = [shifted(F.col("a")[i]).bitwiseAND(F.lit(1)) for i in act]
    if len(act) > 62:
        return F.concat(*[b.cast("string") for b in bits])
    child = F.lit(0).cast("bigint")
    for pos, bit in enumerate(bits):
        child = child + bit * F.lit(2 ** (len(act) - 1 - pos))
    return child.cast("string")


def _leaf_label(spec: GridSpec) -> Column:
    """The label by the row's own ``depth``."""
    children = F.transform(F.sequence(F.lit(1), F.col("depth")),
                           lambda j: _child(spec, lambda x: F.call_function("shiftright", x, F.col("depth") - j)))
    cell = F.col("cell").cast("string")
    return F.when(F.col("depth") == 0, cell).otherwise(F.concat_ws(".", cell, children))


def _leaf_index(d: int) -> Column:
    """Sub-cell index per dimension at the row's own ``depth``."""
    cells = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("depth"))

    def at(v):
        return F.least(F.floor(v * cells.cast("double")), cells - 1)
    if d <= UNROLL_DIMS:
        return F.array(*[at(F.col("u")[i]) for i in range(d)])
    return F.transform(F.col("u"), at)


@dataclass
class AdaptiveGrid:
    """Result of the adaptive split."""
    spec: GridSpec
    points: DataFrame            # point rows + c, cell, u, depth, a, cell_key (a projection of the input)
    cells: DataFrame             # occupied leaves: cell, a, depth, cell_key, n (from checkpointed counts)
    splits: list[int] = field(default_factory=list)   # over-full cells split at each level
    split_keys: list = field(default_factory=list)    # their (cell, a), a table a level (checkpointed)
    levels: int = 0

    @property
    def n_splits(self) -> int:
        return sum(self.splits)

    @property
    def n_cells(self) -> int:
        """Cells including empty ones: uniform cells plus ``2^d - 1`` per split."""
        return self.spec.n_uniform + (2 ** self.spec.d_eff - 1) * self.n_splits

    @property
    def avg_per_cell(self) -> float:
        return self.spec.n / self.n_cells

    def average(self, basis: str = "all") -> float:
        """Points per cell (G9): over all cells, empty ones included, or over the
        ``occupied`` ones, which keeps its meaning where most cells are empty."""
        if basis == "all":
            return self.avg_per_cell
        if basis == "occupied":
            return self.spec.n / self.cells.count()
        raise ValueError("basis must be 'all' or 'occupied'")


def _level_counts(unsettled: DataFrame, spec: GridSpec, tau: int, low: int, high: int, max_depth: int) -> DataFrame:
    """``level, cell, a, n, _split`` of the unsettled points' cells at levels ``low`` to ``high``, from one scan."""
    ends = [f(F.col("coords")[i]).alias(f"{name}{i}") for i in range(spec.d) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    fine = unsettled.withColumn("a", _level_index(high, spec.d)).groupBy("cell", "a").agg(F.count("*").alias("n"), *ends)
    rows = fine.withColumn("level", F.lit(high))
    if low < high:
        # a lost executor re-reads the finest counts instead of the points
        up = F.transform("a", lambda x: F.call_function("shiftright", x, F.lit(high) - F.col("level")))
        rows = checkpoint(fine).withColumn("level", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("a", up)
        ends = [f(f"{name}{i}").alias(f"{name}{i}") for i in range(spec.d) for f, name in ((F.min, "lo"), (F.max, "hi"))]
        rows = rows.groupBy("level", "cell", "a").agg(F.sum("n").alias("n"), *ends)
    same = F.lit(True)
    for i in range(spec.d):
        same = same & (F.col(f"lo{i}") == F.col(f"hi{i}"))
    over = (F.col("n") > F.lit(tau)) & ~same & (F.col("level") < max_depth)
    return checkpoint(rows.select("level", "cell", "a", "n", over.alias("_split")))


def adaptive_grid(points: DataFrame, tau: int, d: int | None = None,
                  spec: GridSpec | None = None, max_depth: int = MAX_DEPTH,
                  broadcast_bytes: int = BROADCAST_BYTES) -> AdaptiveGrid:
    """Assign every point to its adaptive leaf cell (G7, G8 labels, G9 counts).

    A leaf is the first level at which the point's cell holds at most
    ``tau`` points, or holds copies of one point only (D4), or sits at
    ``max_depth``.

    ``points`` are scanned once per stage of levels and by each use of the result. A level's
    keys are broadcast while the directory's counted bytes stay within ``broadcast_bytes``;
    beyond that its join shuffles, AQE splits skewed partitions, and the rows are
    checkpointed with the depth they have reached. So are the rows that are unsettled after
    ``LEVELS_AT_ONCE`` levels, that plans stay small.
    """
    if d is None:
        from tessera.sources.points import point_dimension
        d = point_dimension(points)
    if spec is None:
        spec = grid_spec(points, tau, d)
    cur = uniform_grid_assign(points, spec).select("*", F.lit(True).alias("_on"), F.lit(0).alias("depth"))
    columns = cur.columns
    settled: list[DataFrame] = []
    joins = 0
    cells, split_keys = [], []
    splits: list[int] = []
    key_bytes = (16 if spec.numbered else 8 + 2 * spec.d) + 24 + 8 * spec.d
    level = 0
    while not splits or splits[-1]:
        low, high = level, min(2 * level, max_depth)
        stats = _level_counts(cur.where("_on"), spec, tau, low, high, max_depth)
        tally = {r["level"]: r["count"] for r in stats.where("_split").groupBy("level").count().collect()}
        for level in range(low, high + 1):
            at_level = stats.where(F.col("level") == level)
            split = at_level.where("_split").select("cell", "a")
            leaf = at_level.where(~F.col("_split"))
            if level > low:
                above = split_keys[-1].select("cell", F.col("a").alias("_above"))
                up = F.transform("a", lambda x: F.shiftright(x, 1))
                leaf = leaf.withColumn("_above", up).join(above, ["cell", "_above"], "left_semi")
            cells.append(leaf.select("cell", "a", F.col("level").alias("depth"), _child_label(spec, level).alias("cell_key"), "n"))
            splits.append(tally.get(level, 0))
            split_keys.append(split)
            if not splits[-1]:
                break
            key = F.when(F.col("_on"), _level_index(level, spec.d))
            marked = split.select("cell", F.col("a").alias("_a"), F.lit(True).alias("_hit"))
            few = sum(splits) * key_bytes <= broadcast_bytes
            on = F.col("_hit").isNotNull()
            cur = (cur.withColumn("_a", key).join(F.broadcast(marked) if few else marked, ["cell", "_a"], "left")
                   .withColumn("depth", F.when(on, F.lit(level + 1)).otherwise(F.col("depth"))).withColumn("_on", on).select(*columns))
            joins += 1
            if not few or joins == LEVELS_AT_ONCE:
                rows = cur if few else checkpoint(cur.select(*points.columns, "_on", "depth"))
                done, open_ = rows.where(~F.col("_on")), rows.where("_on").select(*points.columns, "_on", "depth")
                settled.append(done if few else uniform_grid_assign(done, spec).select(*columns))
                cur = uniform_grid_assign(checkpoint(open_) if few else open_, spec).select(*columns)
                joins = 0
        level += 1
    for part in settled:
        cur = cur.unionByName(part)
    out = cur.drop("_on").withColumn("a", _leaf_index(spec.d)).withColumn("cell_key", _leaf_label(spec))
    table = cells[0]
    for cl in cells[1:]:
        table = table.unionByName(cl)
    return AdaptiveGrid(spec, out, table, splits, split_keys, len(splits))


def leaf_counts(grid: AdaptiveGrid) -> DataFrame:
    """``point_id, cell_key, depth, cell_n``: every point with its leaf's size,
    from the counts of the split (the points are not counted again)."""
    n = grid.cells.select("cell_key", F.col("n").alias("cell_n"))
    return grid.points.select("point_id", "cell_key", "depth").join(n, "cell_key")


# a split has 2^d children; listing the empty ones stops making sense beyond this
LIST_DIMS = 20


def _empty_and_occupied(grid: AdaptiveGrid, spark) -> DataFrame:
    """All leaves: uniform cells and children of split cells that don't split."""
    spec = grid.spec
    if spec.d_eff > LIST_DIMS:
        raise ValueError(f"2^{spec.d_eff} children per split cannot be listed")
    act = [i for i in range(spec.d) if spec.active[i]]
    out = None
    for level, split in enumerate(grid.split_keys):
        if level == 0:
            zero = F.array(*[F.lit(0).cast("bigint") for _ in range(spec.d)])
            found = spark.range(spec.n_uniform).select(F.col("id").alias("cell"), zero.alias("a"))
        else:
            child = grid.split_keys[level - 1].select("cell", "a", F.explode(F.sequence(
                F.lit(0), F.lit(2 ** len(act) - 1))).alias("_child"))
            a = [F.col("a")[i] * 2 + (F.shiftright("_child", len(act) - 1 - act.index(i)).bitwiseAND(F.lit(1))
                                      if i in act else F.lit(0)) for i in range(spec.d)]
            found = child.select("cell", F.array(*[x.cast("bigint") for x in a]).alias("a"))
        leaf = found.join(split, ["cell", "a"], "left_anti").select(
            "cell", "a", F.lit(level).alias("depth"), _child_label(spec, level).alias("cell_key"))
        out = leaf if out is None else out.unionByName(leaf)
    n = grid.cells.select("cell_key", F.col("n").alias("_n"))
    return out.join(n, "cell_key", "left").withColumn("n", F.coalesce("_n", F.lit(0).cast("bigint"))).drop("_n")


def adaptive_cells(grid: AdaptiveGrid, empty: bool = False) -> DataFrame:
    """Leaf cells with bounds and counts (G8, S7): ``cell_key, depth, lo
    ARRAY<DOUBLE>, hi ARRAY<DOUBLE>, n``. With ``empty`` also those without a
    point: the uniform cells and all ``2^d`` children of every split cell."""
    spec = grid.spec
    g = _empty_and_occupied(grid, grid.points.sparkSession) if empty else grid.cells
    los, his = [], []
    for i in range(spec.d):
        if spec.active[i]:
            width = F.lit(spec.side) / F.pow(F.lit(2.0), F.col("depth"))
            lo = F.lit(spec.mins[i]) + (_cell_index(spec, i) + F.col("a")[i] / F.pow(F.lit(2.0), F.col("depth"))) * F.lit(spec.side)
            los.append(lo)
            his.append(lo + width)
        else:
            los.append(F.lit(spec.mins[i]))
            his.append(F.lit(spec.maxs[i]))
    return g.select("cell_key", F.col("depth").cast("int").alias("depth"),
                    F.array(*los).alias("lo"), F.array(*his).alias("hi"), "n")


def cell_members(grid: AdaptiveGrid) -> DataFrame:
    """The members of every leaf cell as rows ``cell_key, point_id``.

    Rows, not lists: a leaf of copies of one point may hold any share of the
    data.
    """
    return grid.points.select("cell_key", "point_id")
