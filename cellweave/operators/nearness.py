"""Exact nearness: a Euclidean distance transform of cells, and the k nearest points of cells by an adaptive partition.

The transform goes along rows first and then columns: what is shuffled is the rows' distances once, whatever the reach, and a
group is one row or one column of the grid. Points are dealt to leaves of a quadtree, of a bounded number each, however
they cluster; blocks of cells meet only leaves that may hold one of the k nearest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grid import KEY, Grid
from ..plans.scratch import written


def lowest(at: np.ndarray, height: np.ndarray, places: np.ndarray) -> np.ndarray:
    """min over k of (places - at[k])^2 + height[k], for ascending at and places.

    The k that is best grows with the place, so halves are searched between their neighbours' bests: a lower envelope
    of parabolas, all places of a level at once.
    """
    n, best, arg = len(places), np.zeros(len(places)), np.zeros(len(places), np.int64)
    if not n or not len(at):
        return np.full(n, np.inf)
    todo = np.array([[0, n - 1, 0, len(at) - 1]])
    while len(todo):
        low, high, first, last = todo.T
        mid, size = (low + high) // 2, last - first + 1
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        owner = np.repeat(np.arange(len(todo)), size)
        k = np.arange(size.sum()) - start[owner] + first[owner]
        cost = (places[mid][owner] - at[k]) ** 2 + height[k]
        least = np.minimum.reduceat(cost, start)
        hits = np.flatnonzero(cost == least[owner])
        arg[mid] = k[hits[np.searchsorted(owner[hits], np.arange(len(todo)))]]
        best[mid] = least
        left = np.stack([low, mid - 1, first, arg[mid]], 1)[low <= mid - 1]
        right = np.stack([mid + 1, high, arg[mid], last], 1)[mid + 1 <= high]
        todo = np.concatenate([left, right])
    return best


def squared_distances(grid: Grid, features: DataFrame, reach: float = float("inf"), step: tuple[float, float] | None = None) -> DataFrame:
    """row, col, d: squared distance of the grid's cells to the nearest of features (row, col), of those within reach; cell centres in the grid's units, or in steps."""
    dx, dy = step or grid.cell
    cols, limit = grid.cols, reach * reach * (1 + 1e-12)

    def along(table: pa.Table) -> pa.Table:
        own = np.unique(table.column("col").to_numpy())
        at = np.arange(cols)
        k = np.searchsorted(own, at)
        near = np.minimum(np.abs(own[np.minimum(k, len(own) - 1)] - at), np.abs(own[np.maximum(k - 1, 0)] - at)) * dx
        at, near = at[near <= reach], near[near <= reach]
        return pa.table({"row": np.full(len(at), table.column("row")[0].as_py(), np.int32), "col": at.astype(np.int32), "g": near * near})

    def down(table: pa.Table) -> pa.Table:
        row, g = table.column("row").to_numpy(), table.column("g").to_numpy(zero_copy_only=False)
        there, want = ~np.isnan(g), np.unique(row[np.isnan(g)])
        order = np.argsort(row[there])
        d = lowest(row[there][order] * dy, g[there][order], want * dy)
        want, d = want[d <= limit], d[d <= limit]
        return pa.table({"row": want.astype(np.int32), "col": np.full(len(want), table.column("col")[0].as_py(), np.int32), "d": d})

    rows = features.select(*KEY).groupBy("row").applyInArrow(along, "row int, col int, g double")
    cells = grid.df.selectExpr("row", "col", "cast(null as double) as g")
    return rows.unionByName(cells).groupBy("col").applyInArrow(down, "row int, col int, d double").where("d < double('infinity')")


#: The quadtree: levels go down by three at a time, to cells of a 2^24th of the points' extent.
STEP, DEPTH = 3, 24


def _leaves(points: DataFrame, bound: int) -> list[tuple[int, int, int, int]]:
    """(level, bx, by, points) of the leaves over points (fx, fy: 0 to 2^DEPTH): at most `bound` points each, but for leaves of the last level.

    In a round only points of nodes with more than `bound` points are counted again, and there are n / bound of these at most, so
    what is broadcast and what comes back follows n / bound.
    """
    spark, out, full = points.sparkSession, [], None
    for level in range(0, DEPTH + 1, STEP):
        at = lambda lv: [F.shiftright("fx", DEPTH - lv).alias("bx"), F.shiftright("fy", DEPTH - lv).alias("by")]  # noqa: B023,E731
        t = points.select("fx", "fy")
        if full is not None:
            over = spark.createDataFrame(full, "bx long, by long")
            t = t.select("fx", "fy", *at(level - STEP)).join(F.broadcast(over), ["bx", "by"], "left_semi")
        nodes = t.groupBy(*at(level)).count().collect()
        out += [(level, r.bx, r.by, r["count"]) for r in nodes if r["count"] <= bound or level == DEPTH]
        full = [(r.bx, r.by) for r in nodes if r["count"] > bound]
        if not full:
            break
    return out


def _gaps(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Along one axis: least and largest distances of points in low..high to places in a..b."""
    return np.maximum(0.0, np.maximum(low - b, a - high)), np.maximum(np.abs(high - a), np.abs(b - low))


def _candidates(box: tuple[float, float, float, float], boxes: np.ndarray, counts: np.ndarray, k: int, radius: float) -> np.ndarray:
    """Leaves that may hold one of the k nearest points of a place in box: those nearer at least than k points are at most."""
    (x0, x1), (y0, y1) = _gaps(boxes[0], boxes[1], box[0], box[1]), _gaps(boxes[2], boxes[3], box[2], box[3])
    near, far = np.hypot(x0, y0), np.hypot(x1, y1)
    order = np.argsort(far)
    held = np.cumsum(counts[order])
    reach = far[order[min(np.searchsorted(held, k), len(order) - 1)]] if held[-1] >= k else np.inf
    return np.flatnonzero(near <= min(reach, radius or np.inf) * (1 + 1e-9))


def _best(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, point, distance) of each place's k nearest points; of equally near ones the first."""
    out = []
    step = max(1, (2 << 20) // max(1, len(px)))
    for at in range(0, len(x), step):
        d = np.sqrt((x[at : at + step, None] - px) ** 2 + (y[at : at + step, None] - py) ** 2)
        limit = np.partition(d, k - 1, axis=1)[:, k - 1] if len(px) > k else np.full(len(d), np.inf)
        if radius:
            limit = np.minimum(limit, radius)
        place, point = np.nonzero(d <= limit[:, None])
        far = d[place, point]
        order = np.lexsort((point, far, place))
        place, point, far = place[order], point[order], far[order]
        nth = np.arange(len(place)) - np.searchsorted(place, place)
        out.append((place[nth < k] + at, point[nth < k], far[nth < k]))
    return tuple(np.concatenate(c) for c in zip(*out))


def leaf_boxes(points: DataFrame, bound: int) -> tuple[DataFrame, np.ndarray | None, np.ndarray]:
    """(points (x, y, ...) with their leaf; boxes of leaves: least and largest x, least and largest y; points in each) of a quadtree whose leaves
    hold `bound` points at most, or a 16,384th of all if that is more: some ten thousand leaves, which are broadcast."""
    lim = points.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).head()
    if not lim.n:
        return points.withColumn("leaf", F.lit(0)), None, np.zeros(0, np.int64)
    size = max(lim.x1 - lim.x0, lim.y1 - lim.y0) or 1.0
    unit = size / (1 << DEPTH)
    whole = lambda c, low: F.least(F.lit((1 << DEPTH) - 1), F.floor((F.col(c) - low) / unit)).cast("long")
    placed = written(points.withColumns({"fx": whole("x", lim.x0), "fy": whole("y", lim.y0)}))
    leaves = np.array(_leaves(placed, max(bound, lim.n >> 14)), np.int64)
    side, slack = size / (1 << leaves[:, 0]).astype(float), size * 1e-12
    boxes = np.stack([lim.x0 + leaves[:, 1] * side - slack, lim.x0 + (leaves[:, 1] + 1) * side + slack, lim.y0 + leaves[:, 2] * side - slack, lim.y0 + (leaves[:, 2] + 1) * side + slack])
    table = points.sparkSession.createDataFrame([(*map(int, r[:3]), n) for n, r in enumerate(leaves)], "level int, bx long, by long, leaf int")
    levels = F.explode(F.array(*(F.lit(int(v)) for v in np.unique(leaves[:, 0]))))
    own = placed.withColumn("level", levels).withColumns({c: F.expr(f"shiftright(f{c[1]}, {DEPTH} - level)") for c in ("bx", "by")})
    return own.join(F.broadcast(table), ["level", "bx", "by"]).drop("level", "bx", "by", "fx", "fy"), boxes, leaves[:, 3]


def nearest_points(grid: Grid, points: DataFrame, k: int, radius: float = 0.0, bound: int = 2048, block: int = 32) -> DataFrame:
    """row, col, d, id, value: the k nearest of points (id, x, y, value) to each of the grid's cells, of those within a radius if given; ties go to the least id.

    Of points in one place the k least ids stay (found by a limited rank, partial before the shuffle). The others make
    quadtree leaves of at most `bound` points, or a 16,384th of all if that is more, so that there are some ten thousand
    leaves at most, and these are broadcast. A block of cells is split until the leaves that may matter to it hold four
    times `bound` points at most, or it is one cell; then it meets these leaves' points, one task a block. Points without a place or id are left out.
    """
    kept = points.where("x is not null and y is not null and id is not null and not isnan(x) and not isnan(y)").selectExpr("id", "cast(x as double) as x", "cast(y as double) as y", "value")
    rank = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    kept = kept.withColumn("__n", rank).where(F.col("__n") <= k).drop("__n")
    kind = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("d", T.DoubleType()), kept.schema["id"], kept.schema["value"]])
    own, boxes, counts = leaf_boxes(kept, bound)
    spark = grid.df.sparkSession
    if boxes is None:
        return spark.createDataFrame([], kind)
    (ox, oy, pw, ph, rx, ry), model = grid.transform, spark.sparkContext.broadcast((boxes, counts))

    def place(row, col):
        return ox + col * pw + row * rx, oy + col * ry + row * ph

    def split(batches):
        boxes, counts = model.value
        for batch in batches:
            out = []
            todo = [(r, c, block, np.arange(len(counts))) for r, c in zip(batch.column("br").to_pylist(), batch.column("bc").to_pylist())]
            while todo:
                r, c, n, some = todo.pop()
                x, y = place(np.array([r, r, r + n - 1, r + n - 1]), np.array([c, c + n - 1, c, c + n - 1]))
                some = some[_candidates((x.min(), x.max(), y.min(), y.max()), boxes[:, some], counts[some], k, radius)]
                if n > 1 and counts[some].sum() > 4 * max(bound, counts.sum() >> 14):
                    todo += [(r + a, c + b, n // 2, some) for a in (0, n // 2) for b in (0, n // 2)]
                else:
                    out += [(r, c, n, int(i)) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in (zip(*out) if out else ([],) * 4)], ["r", "c", "n", "leaf"])

    def match(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        r, c, n = (t.column(v)[0].as_py() for v in "rcn")
        rows, cols = (v.ravel() for v in np.mgrid[r : r + n, c : c + n])
        x, y = place(rows, cols)
        cell, point, d = _best(x.astype(float), y.astype(float), t.column("x").to_numpy(), t.column("y").to_numpy(), k, radius)
        return pa.table([pa.array(rows[cell], pa.int32()), pa.array(cols[cell], pa.int32()), pa.array(d), t.column("id").take(pa.array(point)), t.column("value").take(pa.array(point))], kind.names)

    blocks = grid.df.select((F.floor(F.col("row") / block) * block).cast("int").alias("br"), (F.floor(F.col("col") / block) * block).cast("int").alias("bc")).distinct()
    pairs = blocks.mapInArrow(split, "r int, c int, n int, leaf int")
    found = pairs.join(own, "leaf").groupBy("r", "c", "n").applyInArrow(match, kind)
    return found.join(grid.df.select(*KEY), KEY, "left_semi")


BEST = "array<struct<d:double,row:int,col:int,v:double>>"


class Splits:
    """A balanced k-d tree of halvings, from a sample of vectors: 2^depth cells of about as many vectors each."""

    def __init__(self, x: np.ndarray, depth: int):
        self.depth, self.axis, self.value = depth, np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        parts = {1: x}
        for node in range(1, 1 << depth):
            own = parts.pop(node)
            if len(own):
                self.axis[node] = int(np.argmax(np.ptp(own, axis=0)))
                self.value[node] = np.median(own[:, self.axis[node]])
            up = own[:, self.axis[node]] > self.value[node]
            parts[2 * node], parts[2 * node + 1] = own[~up], own[up]

    def cell(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] > self.value[node])
        return node - (1 << self.depth)


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def nearest_rows(queries: DataFrame, samples: DataFrame, k: int, bound: int = 2048, group: int = 50_000, squares: bool = False) -> DataFrame:
    """row, col, best of queries (row, col, a): the k nearest of samples (row, col, a, v) by distance of their arrays a (or its square), then by cell.

    Of samples with equal arrays the k first stay. The others are dealt to cells of a k-d tree (halvings of a sample by hash,
    sixteen for each cell; cells of `bound` samples or a 16,384th of all), and only the cells' boxes are broadcast. A query meets its
    own cell first, and then those cells alone whose box is nearer than its kth sample so far. Cells that many
    queries meet are copied to as many groups as hold `group` queries each, so no group grows with the queries.
    """
    rank = F.row_number().over(Window.partitionBy("a").orderBy(*KEY))
    kept = written(samples.withColumn("__n", rank).where(F.col("__n") <= k).select(*KEY, "a", F.col("v").cast("double").alias("v")))
    total = kept.count()
    depth = min(14, max(0, (-(-total // bound) - 1).bit_length()))
    draw = kept.orderBy(F.xxhash64(*KEY), *KEY).limit(16 << depth).select("a").toArrow()
    spark = queries.sparkSession
    tree = spark.sparkContext.broadcast(Splits(_vectors(draw.column("a")), depth))

    def dealt(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.value.cell(_vectors(b.column("a"))), pa.int32())], [*b.schema.names, "cell"])

    own = written(kept.mapInArrow(dealt, "row int, col int, a array<double>, v double, cell int"))
    n = len(draw.column("a")[0])
    sides = [f(F.col("a")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(n)]
    rows = own.groupBy("cell").agg(*sides).collect()
    model = spark.sparkContext.broadcast((np.array([r.cell for r in rows]), np.array([[r[f"low{i}"] for i in range(n)] for r in rows]), np.array([[r[f"high{i}"] for i in range(n)] for r in rows])))

    def gap(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Distances of vectors to boxes."""
        d = np.maximum(0.0, np.maximum(low - x[:, None], x[:, None] - high))
        return np.sqrt((d * d).sum(axis=2))

    def home(batches):
        cells, low, high = model.value
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column("a"))
                cell = tree.value.cell(x)
                lost = np.flatnonzero(~np.isin(cell, cells))
                for at in range(0, len(lost), 256):
                    cell[lost[at : at + 256]] = cells[gap(x[lost[at : at + 256]], low, high).argmin(axis=1)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], [*b.schema.names, "cell"])

    def beyond(batches):
        """Other cells that may hold a nearer sample: those near to the box of queries of one cell first, then query by query."""
        cells, low, high = model.value
        for b in batches:
            if not b.num_rows:
                continue
            x, mine, far = _vectors(b.column("a")), b.column("cell").to_numpy(), b.column("far").to_numpy(zero_copy_only=False)
            query, cell = [], []
            for c in np.unique(mine):
                q = np.flatnonzero(mine == c)
                box = np.maximum(0.0, np.maximum(low - x[q].max(axis=0), x[q].min(axis=0) - high))
                some = np.flatnonzero((np.sqrt((box * box).sum(axis=1)) <= far[q].max()) & (cells != c))
                for at in range(0, len(q), 256):
                    i, j = np.nonzero(gap(x[q[at : at + 256]], low[some], high[some]) <= far[q[at : at + 256], None])
                    query.append(q[at : at + 256][i])
                    cell.append(cells[some[j]])
            query, cell = np.concatenate(query), np.concatenate(cell)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(query)) for c in ("row", "col", "a")] + [pa.array(cell, pa.int32())], ["row", "col", "a", "cell"])

    def match(key, q: pa.Table, s: pa.Table) -> pa.Table:
        s = s.sort_by([("row", "ascending"), ("col", "ascending")])
        x, y, best, far = _vectors(q.column("a")) if len(q) else np.zeros((0, n)), _vectors(s.column("a")) if len(s) else np.zeros((0, n)), [], []
        row, col, v = (s.column(c).to_numpy() for c in ("row", "col", "v"))
        step = max(1, (1 << 20) // max(1, len(y)))
        for at in range(0, len(x), step):
            d = ((x[at : at + step, None] - y[None]) ** 2).sum(axis=2)
            d = d if squares else np.sqrt(d)
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            dist = np.take_along_axis(d, near, axis=1)
            best += [[{"d": e, "row": r, "col": c, "v": w} for e, r, c, w in zip(*z)] for z in zip(dist.tolist(), row[near].tolist(), col[near].tolist(), v[near].tolist())]
            far.append((np.sqrt(dist[:, k - 1]) if squares else dist[:, k - 1]) * (1 + 1e-12) if dist.shape[1] >= k else np.full(len(dist), np.inf))
        kind = pa.list_(pa.struct([("d", pa.float64()), ("row", pa.int32()), ("col", pa.int32()), ("v", pa.float64())]))
        return pa.table([q.column("row"), q.column("col"), q.column("a"), q.column("cell"), pa.array(np.concatenate(far) if far else np.zeros(0)), pa.array(best, kind)], ["row", "col", "a", "cell", "far", "best"])

    def meet(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs)
        salts = F.broadcast(pairs.groupBy("cell").agg(F.ceil(F.count("*") / group).cast("int").alias("salts")))
        q = pairs.join(salts, "cell").withColumn("salt", F.pmod(F.xxhash64(*KEY), F.col("salts")).cast("int")).drop("salts")
        s = own.join(salts, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        return q.groupBy("cell", "salt").cogroup(s.groupBy("cell", "salt")).applyInArrow(match, f"row int, col int, a array<double>, cell int, far double, best {BEST}")

    first = written(meet(queries.select(*KEY, "a").mapInArrow(home, "row int, col int, a array<double>, cell int")))
    others = meet(first.select(*KEY, "a", "cell", "far").mapInArrow(beyond, "row int, col int, a array<double>, cell int"))
    both = first.select(*KEY, "best").unionByName(others.select(*KEY, "best"))
    return both.groupBy(*KEY).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
