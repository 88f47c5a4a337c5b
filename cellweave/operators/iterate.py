"""Operators that iterate to a fixpoint: costs, components, flow, automata.

A round is a join with neighbours and an aggregation; its table is written to the shared folder, so lineage stays
short. A round also runs several relaxations inside blocks of cells (tiles) where that pays, so the number of rounds
follows the number of tiles a path crosses, not its cells.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.grid import KEY, Grid, align
from ..plans.registry import operator
from ..plans.scratch import discard, written
from .focal import class_runs, focal, moving, square
from .nearness import squared_distances
from .zonal import top_rank

EIGHT = [o for o in square(3) if o != (0, 0)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]
#: Codes of the eight flow directions, clockwise from the east.
FLOW_CODES = {(0, 1): 1, (1, 1): 2, (1, 0): 4, (1, -1): 8, (0, -1): 16, (-1, -1): 32, (-1, 0): 64, (-1, 1): 128}


def _steps(grid: Grid, offsets=EIGHT) -> list[tuple[int, int, float]]:
    dx, dy = grid.cell
    return [(a, b, math.hypot(a * dy, b * dx)) for a, b in offsets]


def _relax_tile(table: pa.Table, size: int, steps: list[tuple[int, int, float]], limit: float, power: float, leaving: bool) -> pa.Table:
    """Least costs inside a tile and its one-cell rim: whole images are relaxed along each step until nothing falls.

    Rim cells give what they have and take what they get. Leaving: a step costs the friction of the cell it comes from. Where a cell has a direction, its friction is raised to the
    signed power of the cosine between that and the move.
    """
    row, col, friction, cost, source, way = (table.column(c).to_numpy(zero_copy_only=False) for c in ("row", "col", "friction", "cost", "source", "way"))
    r0, c0 = row.min() - 1, col.min() - 1
    shape, at = (row.max() - r0 + 2, col.max() - c0 + 2), (row - r0, col - c0)

    def image(values, empty: float) -> np.ndarray:
        out = np.full(shape, empty)
        out[at] = values
        return out

    drag, best, src, turn = image(friction, -1.0), image(cost, np.inf), image(source, np.inf), image(way, -1.0)
    core = (slice(1, -1), slice(1, -1))
    moves = []
    for dr, dc, length in steps:
        own = drag[core]
        if (way >= 0).any():
            c = np.cos(math.atan2(dc, -dr) - np.radians(turn[core]))
            with np.errstate(divide="ignore", invalid="ignore"):
                bent = np.where(np.abs(c) > 1e-12, own ** np.copysign(np.abs(c) ** power, c), 1.0)
            own = np.where(turn[core] < 0, own, bent)
        back = (slice(1 - dr, shape[0] - 1 - dr), slice(1 - dc, shape[1] - 1 - dc))
        moves.append((back, np.where(drag[back] > 0, drag[back] * length, np.inf) if leaving else np.where(drag[core] > 0, own * length, np.inf)))
    while True:
        fell = False
        for back, toll in moves:
            new, from_ = best[back] + toll, src[back]
            less = (new <= limit) & np.isfinite(new) & ((new < best[core]) | ((new == best[core]) & (from_ < src[core])))
            if less.any():
                best[core][less], src[core][less], fell = new[less], from_[less], True
        if not fell:
            break
    tr, tc = table.column("tr")[0].as_py(), table.column("tc")[0].as_py()
    own = (row // size == tr) & (col // size == tc)
    best, src = best[at][own], src[at][own]
    return pa.table({"row": pa.array(row[own], pa.int32()), "col": pa.array(col[own], pa.int32()), "friction": friction[own], "cost": best, "source": src, "way": way[own], "changed": (best < cost[own]) | (src < source[own])})


def cost_surface(seeds: DataFrame, friction: Grid, limit: float = 0.0, tile: int = 128, direction: Grid | None = None, power: float = 1.0, leaving: bool = False) -> DataFrame:
    """row, col, friction, cost, source: accumulated cost from seeds (row, col, source) to every cell, with the seed it comes from.

    A move to a cell costs its friction times the step; friction without data or not positive is a barrier, but a
    seed may stand on one. Leaving: a move costs the friction of the cell it leaves, as seen from a path's end. Unreachable cells have an infinite cost. Ties go to the lesser source. Each round solves
    tiles of `tile` x `tile` cells with a rim, of those only whose rim changed in the round before; the others pass.
    """
    top = limit if limit > 0 else float("inf")
    steps = _steps(friction)
    inf = float("inf")
    state = friction.df.select(*KEY, F.coalesce("v", F.lit(-1.0)).alias("friction")).join(seeds.select(*KEY, F.col("source").cast("double").alias("s")), KEY, "left")
    state = state.select(*KEY, "friction", F.when(F.col("s").isNotNull(), 0.0).otherwise(inf).alias("cost"), F.coalesce("s", F.lit(inf)).alias("source"))
    way = direction.df.select(*KEY, F.coalesce("v", F.lit(-1.0)).alias("way")) if direction else None
    state = state.join(way, KEY, "left").na.fill(-1.0, ["way"]) if direction else state.withColumn("way", F.lit(-1.0))
    state, first = written(state.withColumn("changed", F.col("cost") == 0)), True
    place = [F.floor(F.col(c) / tile).cast("int").alias(t) for c, t in (("row", "tr"), ("col", "tc"))]
    spread = F.explode(F.array_distinct(F.array(*(F.struct(F.floor((F.col("row") + a) / tile).cast("int").alias("tr"), F.floor((F.col("col") + b) / tile).cast("int").alias("tc")) for a, b in square(3)))))
    kept = [*KEY, "friction", "cost", "source", "way"]
    schema = "row int, col int, friction double, cost double, source double, way double, changed boolean"
    while state.where("changed").head(1):
        touched = state.where("changed").select(F.floor(F.col("row") / tile).alias("r"), F.floor(F.col("col") / tile).alias("c"), spread.alias("t"))
        # A tile that was solved has nothing to learn from its own cells.
        touched = touched if first else touched.where("r <> t.tr or c <> t.tc")
        active = written(touched.select("t.*").distinct())
        dealt = state.select(*kept, spread.alias("t")).select(*kept, "t.*").join(active, ["tr", "tc"], "left_semi")
        solved = dealt.groupBy("tr", "tc").applyInArrow(lambda table: _relax_tile(table, tile, steps, top, power, leaving), schema)
        passed = state.select(*kept, *place).join(active, ["tr", "tc"], "left_anti").select(*kept, F.lit(False).alias("changed"))
        new = written(solved.unionByName(passed))
        discard(state, active)
        state, first = new, False
    return state.drop("changed", "way")


def _seeds(grid: Grid) -> DataFrame:
    return grid.valid().where("v <> 0").select(*KEY, F.col("v").alias("source"))


@operator("COST", "gis", "features friction")
def cost(features: Grid, friction: Grid):
    return friction.with_cells(cost_surface(_seeds(features), friction).select(*KEY, F.when(F.col("cost") < float("inf"), F.col("cost")).otherwise(-1.0).alias("v")))


@operator("ALLOCATE", "gis", "source friction")
def allocate(source: Grid, friction: Grid):
    """Cost v (-1 if unreachable) and the source cell's value (0 if none)."""
    reached = F.col("cost") < float("inf")
    return friction.with_cells(cost_surface(_seeds(source), friction).select(*KEY, F.when(reached, F.col("cost")).otherwise(-1.0).alias("v"), F.when(reached, F.col("source")).otherwise(0.0).alias("allocation")))


@operator("VARCOST", "gis", "source friction direction", k_coefficient=1.0)
def anisotropic_cost(source: Grid, friction: Grid, direction: Grid, k_coefficient):
    """Cost where friction depends on the angle between the move and a direction raster; negative directions don't matter."""
    t = cost_surface(_seeds(source), friction, direction=direction, power=k_coefficient)
    return friction.with_cells(t.select(*KEY, F.when(F.col("cost") < float("inf"), F.col("cost")).otherwise(-1.0).alias("v")))


@operator("COSTGROW", "gis", "seeds cost", max_cost=0.0)
def cost_grow(seeds: Grid, friction: Grid, max_cost):
    t = cost_surface(_seeds(seeds), friction, max_cost)
    return friction.with_cells(t.select(*KEY, F.when(F.col("cost") < float("inf"), F.col("source")).otherwise(0.0).alias("v")))


def _unit(grid: Grid, step: tuple[float, float] | None = None) -> Grid:
    t = grid.transform
    return grid.with_cells(grid.df.select(*KEY, F.lit(1.0).alias("v")), transform=t if step is None else (t[0], t[1], step[0], step[1], 0.0, 0.0))


@operator("DISTANCE", "gis", "input")
def distance(grid: Grid):
    """Eight-neighbour distance to the nearest non-zero cell: a cost surface of friction 1."""
    return cost(grid, _unit(grid))


@operator("HINTERLAND", "gis", "input", max_distance=0.0)
def hinterland(grid: Grid, max_distance):
    """Zero cells take the nearest non-zero id, by steps of 1 and the square root of 2, up to a distance in cells."""
    return cost_grow(grid, _unit(grid, (1.0, -1.0)), max_distance)


@operator("SPDIST", "gis", "cost", source_row=0, source_col=0, dest_row=0, dest_col=0, source_x=None, source_y=None, dest_x=None, dest_y=None)
def shortest_path(friction: Grid, source_row, source_col, dest_row, dest_col, source_x, source_y, dest_x, dest_y):
    """Between two cells, or map coordinates if given: 1 on a least-cost path: cells where the cost from the source and the cost on to the destination add up to the least total. Ties keep all such paths; 0 everywhere if there is none."""
    (source_row, source_col), (dest_row, dest_col) = friction.cell_of(source_row, source_col, source_x, source_y), friction.cell_of(dest_row, dest_col, dest_x, dest_y)
    spark = friction.df.sparkSession
    ends = [spark.createDataFrame([(r, c, 1.0)], "row int, col int, source double") for r, c in ((source_row, source_col), (dest_row, dest_col))]
    there, on = cost_surface(ends[0], friction), cost_surface(ends[1], friction, leaving=True)
    t = there.select(*KEY, F.col("cost").alias("a")).join(on.select(*KEY, F.col("cost").alias("b")), KEY)
    total = t.agg(F.max(F.when((F.col("row") == dest_row) & (F.col("col") == dest_col), F.col("a"))).alias("total"))
    hit = (F.col("total") < float("inf")) & (F.abs(F.col("a") + F.col("b") - F.col("total")) <= 1e-9 * (1 + F.col("total")))
    return friction.with_cells(t.crossJoin(F.broadcast(total)).select(*KEY, F.coalesce(hit, F.lit(False)).cast("double").alias("v")))


@operator("DISPERSE", "gis", "source friction", num_steps=10, decay_rate=0.1)
def disperse(source: Grid, friction: Grid, num_steps, decay_rate):
    """Wavefronts: what arrives is the strongest neighbour's intensity times exp(-decay step / size) over friction; the maximum stays."""
    dx = friction.cell[0]
    state = align([source, friction]).select(*KEY, F.coalesce("v0", F.lit(0.0)).alias("best"), F.coalesce("v0", F.lit(0.0)).alias("front"), F.col("v1").alias("f"))
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(math.exp(-decay_rate * d / dx)).alias("k")) for a, b, d in _steps(friction))))
    for _ in range(num_steps):
        sent = state.where("front > 0").select(*KEY, "front", steps.alias("t")).select((F.col("row") + F.col("t.dr")).alias("row"), (F.col("col") + F.col("t.dc")).alias("col"), (F.col("front") * F.col("t.k")).alias("x")).groupBy(*KEY).agg(F.max("x").alias("x"))
        got = F.when(F.col("f") > 0, F.col("x") / F.col("f"))
        state = written(state.join(sent, KEY, "left").select(*KEY, F.greatest("best", F.coalesce(got, F.lit(0.0))).alias("best"), F.when(got > F.col("best"), got).otherwise(0.0).alias("front"), "f"))
    return friction.with_cells(state.select(*KEY, F.when(F.col("f").isNull(), -1.0).otherwise(F.col("best")).alias("v")))


# Components


def components(cells: DataFrame, offsets, cols: int) -> DataFrame:
    """row, col, v, label: connected cells of equal v; a label is the least cell number."""
    own = cells.select(*KEY, "v", (F.col("row").cast("long") * cols + F.col("col")).alias("id"))
    to = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets)))
    sent = own.select("v", "id", "row", "col", to.alias("t")).select((F.col("row") + F.col("t.dr")).alias("row"), (F.col("col") + F.col("t.dc")).alias("col"), F.col("v"), F.col("id").alias("near"))
    return own.join(linked(own.select("id"), own.join(sent, ["row", "col", "v"]).select("id", "near")), "id").select(*KEY, "v", "label")


def linked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: the least id that each node reaches over edges (id, near)."""
    found = connected_components(edges.select(F.col("id").alias("src"), F.col("near").alias("dst")))
    return nodes.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


@operator("GROUP", "gis", "input", connectivity=("4-connected", "8-connected"))
def group(grid: Grid, connectivity):
    """Components of non-zero cells, whatever their value, numbered from 1 in the order of their first cells; other cells 0."""
    from .zonal import by_key, running_count

    cells = grid.valid().where("v <> 0").select(*KEY, F.lit(1.0).alias("v"))
    t = written(components(cells, FOUR if connectivity[0] == "4" else EIGHT, grid.cols))
    sizes = t.groupBy("label").agg(F.count("*").alias("n"))
    number = running_count(sizes, F.col("label")).select(F.col("key").alias("label"), (F.col("before") + 1).cast("double").alias("no"))
    named = by_key(t.select(*KEY, "label"), written(sizes.join(number, "label")), "label").select(*KEY, "no")
    return grid.with_cells(grid.df.join(named, KEY, "left").select(*KEY, F.when(F.col("v").isNotNull(), F.coalesce("no", F.lit(0.0))).alias("v")))


@operator("AREAFILTER", "gis", "input", threshold=10, connectivity=("8-connected", "4-connected"))
def area_filter(grid: Grid, threshold, connectivity):
    """Components of fewer cells take the most frequent value of their neighbours (ties: the smallest)."""
    offsets = FOUR if connectivity[0] == "4" else EIGHT
    t = written(components(grid.valid(), offsets, grid.cols))
    small = t.groupBy("label").count().where(F.col("count") < threshold).select("label")
    inside = t.join(small, "label")
    to = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets)))
    sent = inside.select("label", "row", "col", to.alias("t")).select("label", (F.col("row") + F.col("t.dr")).alias("row"), (F.col("col") + F.col("t.dc")).alias("col"))
    seen = sent.join(t.select(*KEY, "v", F.col("label").alias("other")), KEY).where("label <> other").groupBy("label", "v").agg(F.count("*").alias("n"))
    best = seen.groupBy("label").agg(F.max(F.struct("n", (-F.col("v")).alias("m"))).alias("t")).select("label", (-F.col("t.m")).alias("new"))
    new = t.join(best, "label", "left").select(*KEY, F.coalesce("new", "v").alias("x"))
    return grid.with_cells(grid.df.join(new, KEY, "left").select(*KEY, F.col("x").alias("v")))


# Flow


@operator("FLOW", "gis", "dem")
def flow(dem: Grid):
    """Direction codes of the steepest drop v (0 in pits and flats, -1 without data) and the accumulation, each cell counting itself."""
    directions = flow_direction(dem)
    acc = flow_accumulation(directions)
    return dem.with_cells(directions.df.join(acc.select(*KEY, "acc"), KEY, "left").select(*KEY, "v", F.coalesce("acc", F.lit(-1.0)).alias("accumulation")))


def flow_direction(dem: Grid) -> Grid:
    order = list(FLOW_CODES.items())
    steps = {(a, b): d for a, b, d in _steps(dem)}
    to = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(k).alias("k"), F.lit(steps[(a, b)]).alias("d")) for k, ((a, b), _) in enumerate(order))))
    sent = dem.valid().select(*KEY, "v", to.alias("t")).select((F.col("row") - F.col("t.dr")).alias("row"), (F.col("col") - F.col("t.dc")).alias("col"), F.col("v").alias("z"), "t.k", "t.d")
    drops = dem.valid().join(sent, KEY).select(*KEY, ((F.col("v") - F.col("z")) / F.col("d")).alias("drop"), "k").groupBy(*KEY).agg(F.max(F.struct("drop", (-F.col("k")).alias("k"))).alias("t"))
    codes = F.array(*(F.lit(float(c)) for _, c in order))
    return dem.with_cells(dem.df.join(drops, KEY, "left").select(*KEY, F.when(F.col("v").isNull(), -1.0).when(F.col("t.drop") > 0, F.element_at(codes, (1 - F.col("t.k")).cast("int"))).otherwise(0.0).alias("v")))


def _downstream(directions: Grid) -> DataFrame:
    """id and the id of the cell that it flows to, where it flows."""
    to = F.when(F.lit(False), F.struct(F.lit(0).alias("dr"), F.lit(0).alias("dc")))
    for (a, b), c in FLOW_CODES.items():
        to = to.when(F.col("v") == c, F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")))
    t = directions.df.where("v > 0").withColumn("t", to)
    return t.select(directions.cell_id().alias("id"), ((F.col("row") + F.col("t.dr")).cast("long") * directions.cols + F.col("col") + F.col("t.dc")).alias("next"))


def flow_accumulation(directions: Grid) -> DataFrame:
    """row, col, acc. Sums double their reach each round: acc and next of a cell are joined to those of its next (path doubling)."""
    ids = directions.df.where("v >= 0").select(*KEY, directions.cell_id().alias("id"))
    # reach: from each cell, the cell 2**k steps down; acc: cells within less than 2**k steps upstream.
    reach, acc = written(_downstream(directions)), written(ids.select("id", F.lit(1.0).alias("acc")))
    while True:
        sent = acc.join(reach, "id").groupBy(F.col("next").alias("id")).agg(F.sum("acc").alias("more"))
        acc = written(acc.join(sent, "id", "left").select("id", (F.col("acc") + F.coalesce("more", F.lit(0.0))).alias("acc")))
        reach = written(reach.join(reach.select(F.col("id").alias("next"), F.col("next").alias("then")), "next").select("id", F.col("then").alias("next")))
        if not reach.head(1):
            return ids.join(acc, "id").select(*KEY, "acc")


@operator("WATERSHED", "gis", "directions pours")
def watershed(directions: Grid, pours: Grid):
    """Each cell's first pour point downstream (its value), by pointer doubling; 0 where there is none."""
    ends = pours.valid().where("v <> 0").select(pours.cell_id().alias("id"), F.col("v").alias("pour"))
    ids = directions.df.where("v >= 0").select(*KEY, directions.cell_id().alias("id"))
    t = ids.join(_downstream(directions), "id", "left").join(ends, "id", "left")
    t = written(t.select(*KEY, "id", F.when(F.col("pour").isNull(), F.col("next")).alias("next"), "pour"))
    while t.where("next is not null").head(1):
        down = t.select(F.col("id").alias("next"), F.col("next").alias("n2"), F.col("pour").alias("p2"))
        t = written(t.join(down, "next", "left").select(*KEY, "id", F.col("n2").alias("next"), F.coalesce("pour", "p2").alias("pour")))
    return directions.with_cells(t.select(*KEY, F.coalesce("pour", F.lit(0.0)).alias("v")))


@operator("SLOPELENGTH", "gis", "dem")
def slope_length(dem: Grid):
    """LS factor of each cell from its upstream cells and Horn's slope; 0 on the border."""
    from .focal import Z, _gradient, _interior, neighbours

    east, south = _gradient(*dem.cell)
    tilt = F.sin(F.atan(F.sqrt(east * east + south * south)))
    t = neighbours(dem, Z).join(flow_accumulation(flow_direction(dem)), KEY, "left")
    value = F.pow(F.col("acc") * (dem.cell[0] / 22.13), F.lit(0.4)) * F.pow(tilt / 0.0896, F.lit(1.3))
    return dem.with_cells(t.select(*KEY, F.when(_interior(dem), F.coalesce(value, F.lit(0.0))).otherwise(0.0).alias("v")))


@operator("PITREMOVAL", "gis", "dem")
def pit_removal(dem: Grid):
    """Cells below all of their neighbours rise to the least of them.

    One pass is all: pits have no pits beside them, and a risen pit equals its least neighbour, so neither it nor a cell
    beside it lies below all of its neighbours any more.
    """
    low = moving(dem, EIGHT).groupBy(*KEY).agg(F.min("x").alias("low"))
    return dem.with_cells(dem.df.join(low, KEY, "left").select(*KEY, F.greatest("v", F.when(F.col("v").isNotNull(), F.col("low"))).alias("v")))


# Automata


@operator("CELLATOM", "gis", "state rules", iterations=10)
def automaton(state: Grid, rules: Grid, iterations):
    """Majority of 3 x 3 cells, the centre included, where the rules aren't zero; ties to the smallest class."""
    cells = state.df.join(rules.df.select(*KEY, F.coalesce(F.col("v").cast("int") != 0, F.lit(False)).alias("may")), KEY).select(*KEY, "v", "may")

    def majority(w, n, centre):
        runs = class_runs(np.trunc(w), n)
        return {"new": np.trunc(np.take_along_axis(w, runs.argmax(axis=1)[:, None], axis=1)[:, 0])}

    for _ in range(iterations):
        top = focal(cells.select(*KEY, "v"), 3, majority, ["new"]).select(*KEY, "new")
        cells = written(cells.join(top, KEY, "left").select(*KEY, F.when(F.col("may") & F.col("v").isNotNull(), F.col("new")).otherwise(F.col("v")).alias("v"), "may"))
    return state.with_cells(cells.select(*KEY, "v"))


@operator("CELLULAR_AUTOMATA", "lcm", "base suitability", matrix=(), iterations=10)
def cellular_automata(base: Grid, suitability: dict[int, Grid], matrix, iterations):
    """matrix: (from, to, p) over the classes that it names. Each round moves classes' areas a step towards those that the matrix gives.

    A class that is short takes the cells of other classes with the largest suitability times p, above 0 (ties by cell number);
    where several classes take a cell, the last of them has it. Then changed cells with fewer than two others of their new
    class in 5 x 5 go back. Classes without a map are suited alike everywhere.
    """
    classes = sorted({c for a, b, _ in matrix for c in (a, b)})
    initial = {int(r["v"]): r["count"] for r in base.valid().groupBy(F.col("v").cast("int").alias("v")).count().collect()}
    half_up = lambda x: math.floor(x + 0.5)
    want = {c: half_up(sum(initial.get(a, 0) * p for a, b, p in matrix if b == c)) for c in classes}
    start = cells = written(base.df.select(*KEY, "v"))
    for k in range(1, iterations + 1):
        now = {int(r["v"]): r["count"] for r in cells.where("v is not null").groupBy(F.col("v").cast("int").alias("v")).count().collect()}
        new, used = cells.withColumn("new", F.col("v")), []
        for c in classes:
            short = half_up(initial.get(c, 0) + (want[c] - initial.get(c, 0)) * k / iterations) - now.get(c, 0)
            if short <= 0:
                continue
            chance = F.lit(None).cast("double")
            for a, b, p in matrix:
                if b == c and a != c and p > 0:
                    chance = F.when(F.col("v").cast("int") == a, float(p)).otherwise(chance)
            t = cells if c not in suitability else cells.join(suitability[c].df.select(*KEY, F.col("v").alias("s")), KEY)
            score = t.select(*KEY, ((F.col("s") if c in suitability else F.lit(1.0)) * chance).alias("v")).where("v > 0")
            hit = top_rank(base.with_cells(score), "Number of cells", short, 5.0).df.where("v = 1").select(*KEY, F.lit(float(c)).alias("take"))
            new = new.join(hit, KEY, "left").select(*KEY, "v", F.coalesce("take", "new").alias("new"))
        new = written(new)
        same = focal(new.select(*KEY, F.col("new").alias("v")), 5, lambda w, n, centre: {"same": (np.trunc(w) == np.trunc(centre)[:, None]).sum(axis=1) - 1.0}, ["same"]).select(*KEY, "same")
        after = written(new.join(same, KEY).select(*KEY, F.when((F.col("new") != F.col("v")) & (F.col("same") < 2), F.col("v")).otherwise(F.col("new")).alias("v")))
        discard(new, *([cells] if cells is not start else []))
        cells = after
    return base.with_cells(cells)


@operator("MOLA", "gis", "objectives", areas=(), max_rounds=200)
def multi_objective(objectives: list[Grid], areas, max_rounds):
    """Cells to the objective in which they rank best, each up to its area; cutoffs rise by what conflicts took. After max_rounds it warns and returns what it has."""
    from .zonal import rank

    ranks = [rank(g, False).df.select(*KEY, F.col("v").alias(f"r{k}")) for k, g in enumerate(objectives)]
    t = ranks[0]
    for r in ranks[1:]:
        t = t.join(r, KEY)
    t, cut = written(t), [float(a) for a in areas]
    claim = lambda: F.array_min(F.array(*(F.when(F.col(f"r{k}") <= c, F.struct(F.col(f"r{k}").alias("r"), F.lit(k + 1).alias("o"))) for k, c in enumerate(cut))))["o"]
    total = objectives[0].rows * objectives[0].cols
    for _ in range(max_rounds):
        got = {r["o"]: r["count"] for r in t.select(claim().alias("o")).where("o is not null").groupBy("o").count().collect()}
        lack = [max(0, a - got.get(k + 1, 0)) for k, a in enumerate(areas)]
        if not any(lack) or all(c >= total for c, x in zip(cut, lack) if x):
            break
        cut = [min(float(total), c + x) for c, x in zip(cut, lack)]
    else:
        warnings.warn(f"MOLA stopped after {max_rounds} rounds; areas aren't met", stacklevel=2)
    return objectives[0].with_cells(t.select(*KEY, F.coalesce(claim(), F.lit(0)).cast("double").alias("v")))


def _gram(series: DataFrame, n: int) -> np.ndarray:
    """The sum of v v' / |v|^2 over cells' series (row, col, a), n x n: a task's share by Arrow, the shares by Spark's sums. Series of no variance don't count."""

    def run(batches):
        total = np.zeros((n, n))
        for b in batches:
            v = _matrix(b.column("a"), n)
            size = (v * v).sum(axis=1)
            v, size = v[size >= FLAT], size[size >= FLAT]
            total += (v / size[:, None]).T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), n), pa.int32()), pa.array(np.tile(np.arange(n), n), pa.int32()), pa.array(total.ravel())], ["i", "j", "g"])

    out = np.zeros((n, n))
    for r in series.select("a").mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        out[r["i"], r["j"]] = r["g"]
    return out


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n)


#: Sums of squares below this are no variance.
FLAT = 1e-15


@operator("EOT", "etm", "series", num_modes=5, output=("maps", "bases"))
def teleconnections(series: DataFrame, num_modes, output):
    """Empirical orthogonal teleconnections: base cells whose series explain most of all others, each regressed out before the next.

    maps: mode, row, col, pattern (slope on the base's series), r2, of cells with data at all steps; others take no part.
    bases: mode, row, col of the base, total_r2 (the sum of r2 over cells) and series (of the base, less its mean).

    Every cell is a candidate: with G the sum of v v' / |v|^2 over cells, b'Gb / b'b is the sum of r2 that base b
    explains, so one aggregation of steps x steps numbers and one projection score all cells against all. Equal
    scores (to ten places): the first cell in row order. Modes end early when no variance is left.
    """
    spark = series.sparkSession
    steps = [r.t for r in series.select("t").distinct().orderBy("t").collect()]
    n = len(steps)
    if n < 3:
        raise ValueError("at least 3 steps are needed")
    lines = series.where("v is not null").groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("a")).where(F.size("a") == n)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    state = written(lines.withColumn("m", mean(F.col("a"))).select(*KEY, F.transform("a", lambda x: x - F.col("m")).alias("a")))
    cells, maps, bases = state.count(), [], []
    for mode in range(1, min(num_modes, n, cells) + 1):
        gram = _gram(state, n)

        def scored(batches, gram=gram):
            for b in batches:
                v = _matrix(b.column("a"), n)
                size = (v * v).sum(axis=1)
                score = np.where(size >= FLAT, np.einsum("ri,ij,rj->r", v, gram, v, optimize=True) / np.maximum(size, FLAT), -1.0)
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("col"), pa.array(np.round(score, 10))], ["row", "col", "s"])

        best = state.mapInArrow(scored, "row int, col int, s double").where("s >= 0").agg(F.max(F.struct("s", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("m")).head().m
        if best is None:
            break
        base = np.array(state.where((F.col("row") == -best.r) & (F.col("col") == -best.c)).head()["a"])
        bases.append((mode, -best.r, -best.c, float(best.s), base.tolist()))

        def fitted(batches, base=base):
            for b in batches:
                v = _matrix(b.column("a"), n)
                cross, own, size = v @ base, base @ base, (v * v).sum(axis=1)
                slope, r2 = cross / own, np.where(size > FLAT, cross * cross / (own * np.maximum(size, FLAT)), 0.0)
                rest = v - slope[:, None] * base
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * n, pa.int32()), pa.array(rest.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("col"), pa.array(slope), pa.array(r2), arrays], ["row", "col", "pattern", "r2", "a"])

        both = written(state.mapInArrow(fitted, "row int, col int, pattern double, r2 double, a array<double>"))
        maps.append(written(both.select(F.lit(mode).alias("mode"), *KEY, "pattern", "r2")))
        discard(state)
        state = both
    discard(state)
    if output == "bases":
        discard(*maps)
        return spark.createDataFrame(bases, "mode int, row int, col int, total_r2 double, series array<double>")
    return reduce(DataFrame.unionByName, maps, spark.createDataFrame([], "mode int, row int, col int, pattern double, r2 double"))


@operator("GEOMOD", "gis", "time1 time2", quantity=100)
def geomod(a: Grid, b: Grid, quantity):
    """The `quantity` unchanged cells nearest to change (straight distance in cells; ties by cell number) take the most common class that changed cells went to (ties: the smallest).

    Cells of time 2 without data at time 1 count as unchanged. Without any change it raises.
    """
    changed = align([a, b]).where("cast(v0 as int) <> cast(v1 as int)").select(*KEY, F.col("v1").cast("int").alias("to"))
    top = changed.groupBy("to").count().agg(F.max(F.struct("count", (-F.col("to")).alias("m"))).alias("t")).head().t
    if top is None:
        raise ValueError("GEOMOD: no change between the two times")
    near = squared_distances(b.with_cells(b.valid().join(changed, KEY, "left_anti")), changed, step=(1.0, 1.0))
    score = near.select(*KEY, (-F.col("d")).alias("v"))
    hit = top_rank(b.with_cells(score), "Number of cells", quantity, 5.0).df.where("v = 1").select(*KEY, F.lit(float(-top.m)).alias("to"))
    return b.with_cells(b.df.join(hit, KEY, "left").select(*KEY, F.coalesce("to", "v").alias("v")))


def _scan_lag(grid: Grid) -> DataFrame:
    """row, col, v, before: the previous valid cell in row order. Rows are windows of their own; only row ends meet."""
    inside = grid.valid().withColumn("in", F.lag("v").over(Window.partitionBy("row").orderBy("col")))
    ends = inside.groupBy("row").agg(F.max_by("v", "col").alias("last"), F.min("col").alias("first"))
    ends = ends.withColumn("carry", F.lag("last").over(Window.orderBy("row"))).select("row", "first", "carry")  # one row per grid row
    return inside.join(ends, "row").select(*KEY, "v", F.when(F.col("col") == F.col("first"), F.col("carry")).otherwise(F.col("in")).alias("before"))


@operator("DURBINWATSON", "gis", "residuals")
def durbin_watson(grid: Grid):
    t = _scan_lag(grid).agg(F.sum(F.pow(F.col("v") - F.col("before"), 2)).alias("d"), F.sum(F.col("v") * F.col("v")).alias("e"), F.count("*").alias("n"))
    return t.select((F.col("d") / F.col("e")).alias("dw"), (1 - F.col("d") / F.col("e") / 2).alias("rho"), "n")


@operator("COCHRANORCUTT", "gis", "dependent independent", max_iterations=10, output=("coefficients", "residuals"))
def cochrane_orcutt(y: Grid, x: Grid, max_iterations, output):
    """Regression with first-order autocorrelated errors in row order, of at least four pairs.

    coefficients: rho, intercept, slope and rounds. A round takes rho from the residuals so far (those of plain least squares at
    first), fits y - rho * (y before) on x - rho * (x before), and ends when rho moves by less than a millionth.
    residuals: a grid of y less the last fit.
    """
    both = align([y, x]).where("v0 is not null and v1 is not null")
    pair = [_scan_lag(y.with_cells(both.select(*KEY, F.col(c).alias("v")))).select(*KEY, F.col("v").alias(n), F.col("before").alias(f"{n}0")) for c, n in (("v0", "y"), ("v1", "x"))]
    t = written(pair[0].join(pair[1], KEY))

    def ols(yy, xx, rows: DataFrame) -> tuple[float, float]:
        """Slope and intercept; no slope on an x that doesn't vary."""
        m = rows.agg(F.avg(yy).alias("y"), F.avg(xx).alias("x"), F.covar_pop(yy, xx).alias("xy"), F.var_pop(xx).alias("xx"), F.count("*").alias("n")).head()
        slope = m["xy"] / m["xx"] if m["xx"] * m.n >= 1e-15 else 0.0
        return slope, m.y - slope * m.x

    if t.count() < 4:
        raise ValueError("COCHRANORCUTT needs four pairs")
    after, (slope, intercept) = t.where("y0 is not null"), ols(F.col("y"), F.col("x"), t)
    rho, old, k = 0.0, 0.0, 0
    for k in range(1, max_iterations + 1):
        e, e0 = F.col("y") - intercept - slope * F.col("x"), F.col("y0") - intercept - slope * F.col("x0")
        m = after.agg(F.sum(e * e0).alias("num"), F.sum(e0 * e0).alias("den")).head()
        rho = m.num / m.den if m.den > 0 else 0.0
        slope, moved = ols(F.col("y") - rho * F.col("y0"), F.col("x") - rho * F.col("x0"), after)
        intercept = moved / (1 - rho) if abs(1 - rho) > 1e-15 else moved
        if k > 1 and abs(rho - old) < 1e-6:
            break
        old = rho
    if output == "residuals":
        return y.with_cells(y.df.select(*KEY).join(t.select(*KEY, (F.col("y") - intercept - slope * F.col("x")).alias("v")), KEY, "left"))
    return t.sparkSession.createDataFrame([(float(rho), float(intercept), float(slope), k)], "rho double, intercept double, slope double, rounds int")


@operator("GENERALIZE", "gis", "points", min_distance=1.0)
def generalize(points: DataFrame, min_distance):
    """Greedy thinning by id: a point stays unless one that stays, with a lesser id, is nearer than min_distance.

    Points of one place are one, under the least id. The others lie in bins whose diagonal is shorter than min_distance,
    so one of a bin stays at most. In a round the least undecided of each bin stays if no lesser undecided one is near,
    and what is near to those that stay goes. Points meet the 25 least ones of the bins around them, never each other, so
    work is linear in points however dense they are. Rounds follow the longest chain of falling ids among neighbours.
    Points without a place (null, NaN, infinite) are near nothing and stay; those without an id go.
    """
    placed = F.coalesce(F.col("x") * 0 + F.col("y") * 0 == 0, F.lit(False))
    if min_distance <= 0:
        return points.where("id is not null")
    bins = [F.floor(F.col(c) / (0.7 * min_distance)).alias(f"b{c}") for c in "xy"]
    places = points.where(placed & F.col("id").isNotNull()).groupBy("x", "y").agg(F.min("id").alias("id"))
    state = written(places.select("id", "x", "y", *bins, F.lit(False).alias("keep")))
    ring = F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in square(5))))
    near = lambda o: F.pow(F.col("x") - o["x"], 2) + F.pow(F.col("y") - o["y"], 2) < min_distance**2

    def around(some: DataFrame) -> DataFrame:
        """By bin: the points of `some`, of which a bin holds few, in the 25 bins around it."""
        there = some.select(F.struct("id", "x", "y").alias("o"), "bx", "by", ring.alias("r"))
        return there.groupBy((F.col("bx") + F.col("r.i")).alias("bx"), (F.col("by") + F.col("r.j")).alias("by")).agg(F.collect_list("o").alias("others"))

    while state.where("not keep").head(1):
        open_ = state.where("not keep")
        least = written(open_.groupBy("bx", "by").agg(F.min(F.struct("id", "x", "y")).alias("o")).select("o.*", "bx", "by"))
        later = F.filter("others", lambda o: near(o) & (F.col("id") < o["id"]))
        wait = open_.join(around(least), ["bx", "by"]).select(F.explode(later).alias("o")).select("o.*").distinct()
        firm = written(least.join(wait, ["id", "x", "y"], "left_anti"))
        met = state.join(around(firm), ["bx", "by"], "left")
        lost = F.exists("others", lambda o: near(o) & (o["id"] < F.col("id")))
        same = F.exists("others", lambda o: (o["x"] == F.col("x")) & (o["y"] == F.col("y")))
        new = written(met.where(F.col("keep") | ~F.coalesce(lost, F.lit(False))).select("id", "x", "y", "bx", "by", (F.col("keep") | F.coalesce(same, F.lit(False))).alias("keep")))
        discard(state, least, firm)
        state = new
    stay = points.where(placed).join(state.select("id", "x", "y"), ["id", "x", "y"], "left_semi")
    return stay.unionByName(points.where(~placed & F.col("id").isNotNull())).select(points.columns)
