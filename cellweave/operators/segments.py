"""Segments, co-occurrence texture and fuzzy signatures."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.grid import KEY, Grid
from ..plans.registry import operator
from ..plans.scratch import written
from .focal import class_runs, focal, square
from .iterate import FOUR, linked
from .learn import training, width
from .zonal import by_key


def _merged(px: DataFrame, labels: DataFrame, cols: int, least_size: int) -> DataFrame:
    """row, col, v: segments; each too small one goes with its neighbour of the nearest mean, in one round over all."""
    n = width(px)
    t = written(px.withColumn("id", F.col("row").cast("long") * cols + F.col("col")).join(labels, "id"))
    seg = written(t.groupBy("label").agg(F.count("*").alias("n"), F.array(*(F.avg(F.col("a")[k]) for k in range(n))).alias("m")))
    to = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in FOUR)))
    sent = t.select(F.col("label").alias("other"), "row", "col", to.alias("k")).select("other", (F.col("row") + F.col("k.dr")).alias("row"), (F.col("col") + F.col("k.dc")).alias("col"))
    touch = t.select(*KEY, "label").join(sent, KEY).where("label <> other").select("label", "other").distinct()
    pair = touch.join(seg.where(F.col("n") < least_size).select("label", F.col("m").alias("m1")), "label").join(seg.select(F.col("label").alias("other"), F.col("m").alias("m2")), "other")
    d = F.aggregate(F.zip_with("m1", "m2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    best = pair.groupBy("label").agg(F.min(F.struct(d.alias("d"), F.col("other").alias("o"))).alias("b")).select("label", F.col("b.o").alias("o"))
    edges = best.select(F.col("label").alias("id"), F.col("o").alias("near"))
    group = linked(seg.select(F.col("label").alias("id")), edges.union(edges.select("near", "id")))
    named = written(group.select(F.col("id").alias("label"), F.col("label").alias("g")).join(seg.select("label", "n"), "label"))
    return by_key(t.select(*KEY, "label"), named, "label").select(*KEY, F.col("g").cast("double").alias("v"))


def _close(px: DataFrame, cols: int, limit: float) -> DataFrame:
    """Edges (id, near) between 4-neighbours whose arrays differ by at most the limit."""
    own = px.select(*KEY, "a", (F.col("row").cast("long") * cols + F.col("col")).alias("id"))
    to = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in FOUR)))
    sent = own.select(F.col("a").alias("b"), F.col("id").alias("near"), "row", "col", to.alias("k")).select("b", "near", (F.col("row") + F.col("k.dr")).alias("row"), (F.col("col") + F.col("k.dc")).alias("col"))
    d = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return own.join(sent, KEY).where(d <= limit**2).select("id", "near")


@operator("SEGMENT", "imgproc", "pixels", cols=0, similarity_threshold=10.0, min_segment_size=25)
def segment(px: DataFrame, cols, similarity_threshold, min_segment_size):
    """Regions of cells joined where neighbours differ by at most the threshold, small ones merged.

    Growing from seeds in scan order depends on that order; here similarity is between neighbours, so regions may
    drift where values change slowly.
    """
    nodes = px.select((F.col("row").cast("long") * cols + F.col("col")).alias("id"))
    return _merged(px, linked(nodes, _close(px, cols, similarity_threshold)), cols, min_segment_size)


@operator("SEGMENTATION", "imgproc", "pixels", cols=0, spatial_bandwidth=7.0, spectral_bandwidth=15.0, min_region_size=20)
def mean_shift(px: DataFrame, cols, spatial_bandwidth, spectral_bandwidth, min_region_size, tile=64):
    """Mean-shift modes of each pixel in tiles with a halo of three bandwidths, joined where neighbours' modes are near."""
    halo, n = math.ceil(3 * spatial_bandwidth), width(px)
    reach = F.explode(F.array_distinct(F.array(*(F.struct(F.floor((F.col("row") + a * halo) / tile).alias("tr"), F.floor((F.col("col") + b * halo) / tile).alias("tc")) for a, b in square(3)))))

    def run(table: pa.Table) -> pa.Table:
        tr, tc = table.column("tr")[0].as_py(), table.column("tc")[0].as_py()
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        x = np.array(table.column("a").to_pylist(), float).reshape(len(row), n)
        r0, c0 = row.min(), col.min()
        image = np.full((row.max() - r0 + 1, col.max() - c0 + 1, n), np.nan)
        image[row - r0, col - c0] = x
        own = np.flatnonzero((row // tile == tr) & (col // tile == tc))
        h, out = math.ceil(spatial_bandwidth), []
        for k in own:
            p, v = np.array([row[k] - r0, col[k] - c0], float), x[k].copy()
            for _ in range(20):
                i, j = max(0, int(p[0]) - h), max(0, int(p[1]) - h)
                part = image[i : int(p[0]) + h + 1, j : int(p[1]) + h + 1]
                ri, ci = np.indices(part.shape[:2])
                near = ((ri + i - p[0]) ** 2 + (ci + j - p[1]) ** 2 <= spatial_bandwidth**2) & (((part - v) ** 2).sum(axis=2) <= spectral_bandwidth**2)
                if not near.any():
                    break
                q, w = np.array([(ri[near] + i).mean(), (ci[near] + j).mean()]), part[near].mean(axis=0)
                moved = ((q - p) ** 2).sum() + ((w - v) ** 2).sum()
                p, v = q, w
                if moved < 0.5:
                    break
            out.append(v.tolist())
        return pa.table({"row": pa.array(row[own], pa.int32()), "col": pa.array(col[own], pa.int32()), "a": pa.array(out, pa.list_(pa.float64()))})

    dealt = px.select(*KEY, "a", reach.alias("t")).select(*KEY, "a", "t.*")
    modes = written(dealt.groupBy("tr", "tc").applyInArrow(run, "row int, col int, a array<double>"))
    nodes = modes.select((F.col("row").cast("long") * cols + F.col("col")).alias("id"))
    return _merged(modes, linked(nodes, _close(modes, cols, 0.5 * spectral_bandwidth)), cols, min_region_size)


@operator("TEXTURE_GLCM", "imgproc", "input", measure=("Contrast", "Dissimilarity", "Homogeneity", "Energy", "Entropy", "Correlation"), window_size=7, direction=("0", "45", "90", "135"), num_levels=16)
def cooccurrence(grid: Grid, measure, window_size, direction, num_levels):
    """Measures of the symmetric co-occurrence of grey levels at one step within a window.

    A pair counts in the windows that hold its first cell. All measures but energy and entropy are means over pairs.
    """
    dr, dc = {"0": (0, 1), "45": (-1, 1), "90": (-1, 0), "135": (-1, -1)}[direction]
    s = grid.valid().agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = F.col("hi") - F.col("lo")
    q = grid.valid().crossJoin(F.broadcast(s)).select(*KEY, F.when(span > 0, F.least(F.lit(num_levels - 1), F.floor((F.col("v") - F.col("lo")) / span * num_levels))).otherwise(0).cast("int").alias("q"))
    mate = q.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("q").alias("p"))
    code = (F.least("q", "p") * num_levels + F.greatest("q", "p")).cast("double").alias("x")
    cells = grid.df.join(q.join(mate, KEY).select(*KEY, code), KEY, "left").select(*KEY, "v", "x")

    def of(w, n, centre):
        i, j = np.floor(w / num_levels), w % num_levels
        d, whole = np.abs(i - j), np.maximum(n, 1)
        if measure in ("Energy", "Entropy"):
            runs = class_runs(w, n).astype(float)
            both = i != j
            if measure == "Energy":  # whole numbers until the last division
                return {"x": (runs * runs * np.where(both, 2, 4)).sum(axis=1) / (4.0 * whole * whole)}
            p = runs / whole[:, None] / np.where(both, 2, 1)
            return {"x": (-p * np.log(np.where(p > 0, p, 1.0)) * np.where(both, 2, 1)).sum(axis=1)}
        if measure == "Correlation":
            ij, m, s = (np.nansum(x, axis=1) / whole for x in (i * j, (i + j) / 2, (i * i + j * j) / 2))
            var = s - m * m
            return {"x": np.where(var > 1e-12, (ij - m * m) / np.where(var > 1e-12, var, 1.0), 0.0)}
        return {"x": np.nansum({"Contrast": d * d, "Dissimilarity": d, "Homogeneity": 1 / (1 + d * d)}[measure], axis=1) / whole}

    t = focal(cells, window_size, of, ["x"])
    return grid.with_cells(t.select(*KEY, F.when(F.col("v").isNotNull(), F.coalesce("x", F.lit(0.0))).alias("v")))


@operator("FUZSIG", "imgproc", "pixels labels", bins=256)
def fuzzy_signatures(px: DataFrame, labels: DataFrame, bins):
    """label, mean and cov weighted by how common a cell's values are in its class: the product over bands of its bin's count over the fullest bin's."""
    n = width(px)
    t = written(training(px, labels))
    lim = t.groupBy("label").agg(F.array(*(F.min(F.col("a")[k]) for k in range(n))).alias("lo"), F.array(*(F.max(F.col("a")[k]) for k in range(n))).alias("hi"))
    slot = F.transform("a", lambda x, i: F.when(F.col("hi")[i] - F.col("lo")[i] > 1e-12, ((x - F.col("lo")[i]) / (F.col("hi")[i] - F.col("lo")[i]) * (bins - 1)).cast("int")).otherwise(0))
    long = t.join(lim, "label").select(*KEY, "label", F.posexplode(slot).alias("band", "bin"))
    counts = long.groupBy("label", "band", "bin").agg(F.count("*").alias("n"))
    share = counts.join(counts.groupBy("label", "band").agg(F.max("n").alias("top")), ["label", "band"]).select("label", "band", "bin", F.log(F.col("n") / F.col("top")).alias("s"))
    w = long.join(share, ["label", "band", "bin"]).groupBy(*KEY, "label").agg(F.exp(F.sum("s")).alias("w"))
    x = t.join(w, [*KEY, "label"])
    c = [F.col("a")[k] for k in range(n)]
    sums = x.groupBy("label").agg(F.sum("w").alias("w"), *(F.sum(F.col("w") * c[i]).alias(f"m{i}") for i in range(n)), *(F.sum(F.col("w") * c[i] * c[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)))
    mean = [F.col(f"m{i}") / F.col("w") for i in range(n)]
    cov = [F.col(f"c{min(i, j)}_{max(i, j)}") / F.col("w") - mean[i] * mean[j] for i in range(n) for j in range(n)]
    return sums.select("label", F.array(*mean).alias("mean"), F.array(*cov).alias("cov"))
