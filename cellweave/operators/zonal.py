"""Grouped, whole-grid and rank operators.

Grouped ones aggregate by class, partially before the shuffle. Whole-grid statistics are one row and are joined to
cells by a broadcast of that row. Ranks need no global window: cells are counted by value first, and the running
count of values is summed over ranges, so that only the ends of ranges meet in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.grid import KEY, Grid, align
from ..plans.registry import operator
from ..plans.scratch import written


def class_of() -> Column:
    """A cell's class: truncated, as classes are in the tables."""
    return F.col("v").cast("int")


def one_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Every row with the single row of stats."""
    return df.crossJoin(F.broadcast(stats))


def running_count(df: DataFrame, by: Column) -> DataFrame:
    """key, n and before (rows with lesser keys) for each distinct key of df.

    Distinct keys are dealt to ranges by order and written with the number of their range, so that what is read of it
    twice is the same; counts run inside ranges, and the totals of the (few) ranges are added.
    """
    counts = df.groupBy(by.alias("key")).agg(F.count("*").alias("n")).repartitionByRange("key")
    counts = written(counts.withColumn("part", F.spark_partition_id()))
    inside = counts.withColumn("in", F.sum("n").over(Window.partitionBy("part").orderBy("key")) - F.col("n"))
    sums = counts.groupBy("part").agg(F.sum("n").alias("all"))
    offset = sums.withColumn("offset", F.sum("all").over(Window.orderBy("part")) - F.col("all")).select("part", "offset")
    return inside.join(F.broadcast(offset), "part").select("key", "n", (F.col("in") + F.col("offset")).alias("before"))


def by_key(df: DataFrame, table: DataFrame, key: str, parts: int = 200) -> DataFrame:
    """df left-joined to table (key, n: the rows of df that have it, ...), spread evenly whatever the keys.

    Keys of a 200th of all rows or more, 200 at most, are broadcast; their rows go by a salt instead of the key.
    """
    names = [c for c in table.columns if c != key]
    heavy = one_row(table, table.agg(F.sum("n").alias("__all"))).where(F.col("n") * parts >= F.col("__all"))
    heavy = heavy.select(key, F.lit(True).alias("__hot"), *(F.col(c).alias(f"__{c}") for c in names))
    salt = F.when(F.col("__hot"), 1 + F.monotonically_increasing_id() % 4096).otherwise(0)
    met = df.join(F.broadcast(heavy), key, "left").withColumn("__salt", salt)
    met = met.join(table.withColumn("__salt", F.lit(0).cast("long")), [key, "__salt"], "left")
    return met.select(*df.columns, *(F.coalesce(f"__{c}", c).alias(c) for c in names))


# Grouped


@operator("AREA", "gis", "input")
def area(grid: Grid):
    """class, cells and area; see area_grid for the painted grid."""
    dx, dy = grid.cell
    return grid.valid().groupBy(class_of().alias("class")).agg(F.count("*").alias("cells")).withColumn("area", F.col("cells") * (dx * dy))


def area_grid(grid: Grid) -> Grid:
    table = area(grid).select("class", "area")
    return grid.with_cells(grid.df.withColumn("class", class_of()).join(table, "class", "left").select(*KEY, F.col("area").alias("v")))


@operator("COUNT", "gis", "input")
def count(grid: Grid):
    out = grid.valid().groupBy(F.round("v").cast("int").alias("class")).agg(F.count("*").alias("cells"))
    return one_row(out, out.agg(F.sum("cells").alias("all"))).select("class", "cells", (F.col("cells") / F.col("all")).alias("share"))


@operator("CENTER", "gis", "input")
def center(grid: Grid):
    """Mean upper-left corner of each class's cells."""
    return grid.valid().groupBy(F.round("v").cast("int").alias("class")).agg(F.avg(grid.x()).alias("x"), F.avg(grid.y()).alias("y"), F.count("*").alias("cells"))


@operator("EXTRACT", "gis", "feature value", statistic=("mean", "sum", "min", "max", "count"))
def extract(zones: Grid, values: Grid, statistic):
    agg = {"mean": F.avg("v1"), "sum": F.sum("v1"), "min": F.min("v1"), "max": F.max("v1"), "count": F.count("v1").cast("double")}[statistic]
    return align([zones, values]).where("v0 is not null and v1 is not null").groupBy(F.col("v0").cast("int").alias("zone")).agg(agg.alias("stat"))


def _pairs(a: Grid, b: Grid) -> DataFrame:
    return align([a, b]).where("v0 is not null and v1 is not null").groupBy(F.col("v0").cast("int").alias("c1"), F.col("v1").cast("int").alias("c2")).agg(F.count("*").alias("n"))


@operator("CROSSTAB", "gis", "input1 input2")
def crosstab(a: Grid, b: Grid):
    """c1, c2, n and the 1-based id of each combination, in order; the table is as small as the product of classes."""
    return _pairs(a, b).withColumn("id", F.row_number().over(Window.orderBy("c1", "c2")))


@operator("CROSSTAB_STATS", "gis", "input1 input2")
def crosstab_stats(a: Grid, b: Grid):
    """Chi-square and Cramer's V of a contingency table."""
    t = _pairs(a, b)
    r, c = t.groupBy("c1").agg(F.sum("n").alias("r")), t.groupBy("c2").agg(F.sum("n").alias("c"))
    size = t.agg(F.sum("n").alias("all"), F.count_distinct("c1").alias("nr"), F.count_distinct("c2").alias("nc"))
    # Sum of (o - e)^2 / e over all pairs is all * (sum of o^2 / (r c) - 1); pairs that never occur add nothing.
    x = one_row(t.join(r, "c1").join(c, "c2"), size).groupBy("all", "nr", "nc").agg((F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))) - 1).alias("phi2"))
    k = F.least("nr", "nc") - 1
    return x.select((F.col("phi2") * F.col("all")).alias("chi_square"), F.when(k > 0, F.sqrt(F.col("phi2") / k)).otherwise(0.0).alias("cramers_v"))


@operator("ERRMAT", "gis", "classified reference")
def error_matrix(classified: Grid, reference: Grid):
    """overall accuracy and kappa; reference class 0 is background."""
    t = _pairs(classified, reference).where("c2 <> 0")
    row, col = t.groupBy(F.col("c1").alias("k")).agg(F.sum("n").alias("r")), t.groupBy(F.col("c2").alias("k")).agg(F.sum("n").alias("c"))
    chance = row.join(col, "k").agg(F.coalesce(F.sum(F.col("r").cast("double") * F.col("c")), F.lit(0.0)).alias("rc"))
    hit = t.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("c1") == F.col("c2"), F.col("n"))), F.lit(0)).alias("hits"))
    x = one_row(hit, chance).withColumns({"po": F.col("hits") / F.col("n"), "pe": F.col("rc") / F.col("n") / F.col("n")})
    return x.select(F.col("n").alias("cells"), F.col("po").alias("overall"), F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).otherwise(1.0).alias("kappa"))


@operator("ERRMAT_CLASSES", "gis", "classified reference")
def error_classes(classified: Grid, reference: Grid):
    """Producer's and user's accuracy of each class."""
    t = _pairs(classified, reference).where("c2 <> 0")
    hit = t.where("c1 = c2").select(F.col("c1").alias("class"), F.col("n").alias("hits"))
    made, true = t.groupBy(F.col("c1").alias("class")).agg(F.sum("n").alias("mapped")), t.groupBy(F.col("c2").alias("class")).agg(F.sum("n").alias("truth"))
    x = made.join(true, "class", "full").join(hit, "class", "left").na.fill(0)
    return x.select("class", "mapped", "truth", F.when(F.col("truth") > 0, F.col("hits") / F.col("truth")).otherwise(0.0).alias("producer"), F.when(F.col("mapped") > 0, F.col("hits") / F.col("mapped")).otherwise(0.0).alias("user"))


@operator("CHANGE_ANALYSIS", "lcm", "earlier later")
def change_analysis(a: Grid, b: Grid):
    """Gain, loss, net change and persistence of each class, in cells."""
    t = _pairs(a, b)
    flows = t.select(F.inline(F.array(F.struct(F.col("c1").alias("class"), F.col("n").alias("before"), F.lit(0).cast("long").alias("after"), F.when(F.col("c1") == F.col("c2"), F.col("n")).otherwise(0).alias("kept")), F.struct(F.col("c2").alias("class"), F.lit(0).cast("long").alias("before"), F.col("n").alias("after"), F.lit(0).cast("long").alias("kept")))))
    s = flows.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("before", "after", "kept")))
    return s.select("class", "before", "after", (F.col("after") - F.col("kept")).alias("gain"), (F.col("before") - F.col("kept")).alias("loss"), (F.col("after") - F.col("before")).alias("net"), F.col("kept").alias("persistence"))


def transition_codes(a: Grid, b: Grid) -> Grid:
    return a.with_cells(align([a, b]).select(*KEY, (F.col("v0").cast("int") * 100 + F.col("v1").cast("int")).cast("double").alias("v")))


@operator("MARKOV_CHAIN", "lcm", "earlier later", prediction_date=10)
def markov_chain(a: Grid, b: Grid, prediction_date):
    """from, to, p of the row-normalised transition matrix to a power; classes are few, so that matrix is on the driver."""
    import numpy as np

    t = _pairs(a, b).collect()
    names = sorted({x for r in t for x in (r.c1, r.c2)})
    at = {c: k for k, c in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in t:
        m[at[r.c1], at[r.c2]] = r.n
    rows = m.sum(axis=1, keepdims=True)
    m = np.divide(m, rows, out=np.zeros_like(m), where=rows > 0)
    p = np.linalg.matrix_power(m, max(1, prediction_date))
    cells = [(i, j, float(p[at[i], at[j]])) for i in names for j in names]
    return a.df.sparkSession.createDataFrame(cells, "from int, to int, p double")


@operator("MARKOV2", "lcm", "time1 time2", projection_steps=1)
def markov_probabilities(a: Grid, b: Grid, projection_steps):
    """row, col, to, p: each cell's probability of each class after some steps."""
    m = markov_chain(a, b, projection_steps)
    return b.valid().withColumn("from", class_of()).join(m, "from").select(*KEY, "to", "p")


@operator("PERIM", "gis", "input")
def perimeter(grid: Grid):
    """Area and edge length of each class: 4-neighbour edges to another class or off the grid, times the mean cell size."""
    from .focal import neighbours

    dx, dy = grid.cell
    n = neighbours(grid, {"e": (0, 1), "w": (0, -1), "s": (1, 0), "n": (-1, 0)}).where("v is not null")
    edges = sum((F.coalesce((F.col(k).cast("int") != class_of()).cast("int"), F.lit(1)) for k in "ewsn"), F.lit(0))
    return n.groupBy(class_of().alias("class")).agg((F.count("*") * (dx * dy)).alias("area"), (F.sum(edges) * ((dx + dy) / 2)).alias("perimeter"))


@operator("QUADRAT", "gis", "input", quadrat_size=10)
def quadrat(grid: Grid, quadrat_size):
    """Mean, sample variance and their ratio of counts of non-zero cells per quadrat."""
    q = [F.floor(F.col(c) / quadrat_size).alias(f"q{c}") for c in KEY]
    hits = grid.valid().where("v <> 0").groupBy(*q).agg(F.count("*").alias("n"))
    total = math.ceil(grid.rows / quadrat_size) * math.ceil(grid.cols / quadrat_size)
    s = hits.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("s"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("double").alias("s2"))
    mean, var = F.col("s") / total, (F.col("s2") - F.col("s") * F.col("s") / total) / (total - 1)
    return s.select(F.lit(total).cast("long").alias("quadrats"), mean.alias("mean"), var.alias("variance"), F.when(mean > 0, var / mean).otherwise(0.0).alias("vmr"))


@operator("MAKESIG", "imgproc", "bands training")
def make_signatures(bands: list[Grid], training: Grid):
    """class, n, means and population covariances (row by row) of the bands over training cells."""
    t = align([training, *bands]).where(" and ".join(f"v{k} is not null" for k in range(len(bands) + 1))).where("v0 <> 0")
    names = [f"v{k + 1}" for k in range(len(bands))]
    return t.groupBy(F.col("v0").cast("int").alias("class")).agg(F.count("*").alias("n"), F.array(*(F.avg(c) for c in names)).alias("mean"), F.array(*(F.covar_pop(a, b) for a in names for b in names)).alias("cov"))


@operator("HYPERSIG", "imgproc", "bands training")
def spectral_profiles(bands: list[Grid], training: Grid):
    t = align([training, *bands]).where("v0 is not null and v0 <> 0")
    long = t.select(F.col("v0").cast("int").alias("class"), F.posexplode(F.array(*(F.col(f"v{k + 1}") for k in range(len(bands)))))).where("col is not null")
    return long.groupBy("class", F.col("pos").alias("band")).agg(F.avg("col").alias("mean"), F.coalesce(F.stddev_samp("col"), F.lit(0.0)).alias("sd"), F.min("col").alias("low"), F.max("col").alias("high"))


operator("SEGTRAIN", "imgproc", "bands segments")(lambda bands, segments: spectral_profiles(bands, segments).select("class", "band", "mean", "sd"))


@operator("SEGCLASS", "imgproc", "segments training")
def segment_class(segments: Grid, training: Grid):
    """Each segment's most frequent training class (ties: the smallest), painted back."""
    votes = align([segments, training]).where("v0 is not null and v1 is not null and v1 <> 0").groupBy("v0", "v1").agg(F.count("*").alias("n"))
    best = votes.groupBy(F.col("v0").alias("v")).agg(F.max(F.struct("n", (-F.col("v1")).alias("c"))).alias("top")).select("v", (-F.col("top.c")).alias("class"))
    return segments.with_cells(segments.df.join(best, "v", "left").select(*KEY, F.when(F.col("v").isNotNull(), F.coalesce("class", F.lit(0.0))).alias("v")))


# Whole grid


@operator("STATS", "core", "input")
def statistics(grid: Grid):
    v = F.when(~F.isnan("v"), F.col("v"))
    return grid.df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.count(v).alias("n"))


def _with_stats(grid: Grid) -> DataFrame:
    return one_row(grid.df, statistics(grid))


@operator("NORMALIZE", "gis", "input")
def normalize(grid: Grid):
    span = F.col("max") - F.col("min")
    return grid.with_cells(_with_stats(grid).select(*KEY, ((F.col("v") - F.col("min")) / F.when(span == 0, 1.0).otherwise(span)).alias("v")))


@operator("STANDARD", "gis", "input")
def standardize(grid: Grid):
    return grid.with_cells(_with_stats(grid).select(*KEY, ((F.col("v") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).alias("v")))


@operator("STRETCH", "imgproc", "input", method=("Linear", "Saturated", "Histogram equalization"), saturation_percent=2.0)
def stretch(grid: Grid, method, saturation_percent):
    """To 0..255. Saturated runs over mean +- saturation_percent standard deviations; equalization uses mid-ranks."""
    if method == "Histogram equalization":
        ranks = running_count(grid.valid(), F.col("v"))
        t = one_row(grid.df.join(ranks.withColumnRenamed("key", "v"), "v", "left"), grid.valid().agg(F.count("*").alias("all")))
        return grid.with_cells(t.select(*KEY, ((2 * F.col("before") + F.col("n")) / (2 * F.col("all")) * 255).alias("v")))
    t = _with_stats(grid)
    lo, hi = (F.col("min"), F.col("max")) if method == "Linear" else (F.col("mean") - F.col("sd") * saturation_percent, F.col("mean") + F.col("sd") * saturation_percent)
    v = F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("v") - lo) / (hi - lo) * 255))).otherwise(127.0)
    return grid.with_cells(t.select(*KEY, F.when(F.col("v").isNotNull(), v).alias("v")))


def at_ranks(df: DataFrame, value: Column, **places: Column) -> DataFrame:
    """One row: by name, the value at a place (from 0) in order of value, where a place is an expression over all (rows). Ranks run over counts of equal values."""
    counts = running_count(df, value)
    both = one_row(counts, counts.agg(F.sum("n").alias("all")))
    return both.agg(*(F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("key"))).alias(name) for name, place in places.items()))


@operator("DISPLAY", "gis", "input", mode=("Grayscale", "Pseudo-color", "RGB Composite"), red_band=1, green_band=2, blue_band=3, stretch_min_pct=2.0, stretch_max_pct=98.0)
def display(bands, mode, red_band, green_band, blue_band, stretch_min_pct, stretch_max_pct):
    """Whole numbers 0..255 between the values at two shares of the cells in order of value; cells without data are 0.

    A grid, or a list of grids (bands, from 1). Grayscale and pseudo-colour stretch the first (colours are the screen's), RGB
    three of them: v, green and blue. Band numbers beyond the last are the last.
    """
    grids = bands if isinstance(bands, (list, tuple)) else [bands]
    numbers = [red_band, green_band, blue_band] if mode.startswith("RGB") else [1]
    out = []
    for number in numbers:
        g = grids[min(max(number, 1), len(grids)) - 1]
        place = lambda share: F.least(F.floor(F.col("all") * (share / 100)), F.col("all") - 1)
        q = at_ranks(g.valid(), F.col("v"), lo=place(stretch_min_pct), hi=place(stretch_max_pct))
        span = F.when(F.col("hi") - F.col("lo") < 1e-10, 1.0).otherwise(F.col("hi") - F.col("lo"))
        v = F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("v") - F.col("lo")) / span * 255)))
        out.append(g.with_cells(one_row(g.df, q).select(*KEY, F.coalesce(v, F.lit(0.0)).alias("v"))))
    if len(out) == 1:
        return out[0]
    return grids[0].with_cells(align(out).select(*KEY, F.col("v0").alias("v"), F.col("v1").alias("green"), F.col("v2").alias("blue")))


@operator("COMPOSITE", "imgproc", "red green blue")
def composite(*bands: Grid):
    scaled = [stretch(b, "Linear", 2.0) for b in bands]
    return bands[0].with_cells(align(scaled).select(*KEY, F.col("v0").alias("v"), F.col("v1").alias("green"), F.col("v2").alias("blue")))


@operator("HISTO", "gis", "input", num_bins=256)
def histogram(grid: Grid, num_bins):
    """bin, center, cells and percent for every bin, empty ones too."""
    s = statistics(grid).select("min", "max", "n")
    w = (F.col("max") - F.col("min")) / num_bins
    slot = F.when(w > 0, F.least(F.lit(num_bins - 1), F.floor((F.col("v") - F.col("min")) / w))).otherwise(0).cast("int")
    counts = one_row(grid.valid(), s).groupBy(slot.alias("bin")).agg(F.count("*").alias("cells"))
    bins = one_row(grid.df.sparkSession.range(num_bins).select(F.col("id").cast("int").alias("bin")), s)
    return bins.join(counts, "bin", "left").select("bin", (F.col("min") + (F.col("bin") + 0.5) * w).alias("center"), F.coalesce("cells", F.lit(0)).alias("cells"), (F.coalesce("cells", F.lit(0)) * 100.0 / F.col("n")).alias("percent"))


@operator("RECLASS", "gis", "input rules", method=("Equal Interval", "User Defined"), num_classes=5)
def reclass(grid: Grid, rules, method, num_classes):
    """rules: (low, high, new) in order; the first range that holds the value, ends included, names the class."""
    if method == "User Defined":
        out = F.when(F.lit(False), F.lit(0.0))
        for lo, hi, new in rules:
            out = out.when(F.col("v").between(float(lo), float(hi)), float(new))
        return grid.with_cells(grid.df.select(*KEY, out.alias("v")))
    w = (F.col("max") - F.col("min")) / num_classes
    k = F.when(w > 0, F.least(F.lit(float(num_classes)), F.floor((F.col("v") - F.col("min")) / w) + 1)).otherwise(1.0)
    return grid.with_cells(_with_stats(grid).select(*KEY, F.when(F.col("v").isNotNull(), k).cast("double").alias("v")))


def _both(a: Grid, b: Grid) -> DataFrame:
    return align([a, b]).where("v0 is not null and v1 is not null")


@operator("CORRELATE", "gis", "input1 input2")
def correlate(a: Grid, b: Grid):
    """n, r, r squared, t, and the fit of the second on the first."""
    r = F.col("r")
    out = _both(a, b).agg(F.count("*").alias("n"), F.corr("v0", "v1").alias("r"), F.regr_slope("v1", "v0").alias("slope"), F.regr_intercept("v1", "v0").alias("intercept"))
    return out.select("n", "r", (r * r).alias("r2"), (r * F.sqrt((F.col("n") - 2) / (1 - r * r))).alias("t"), "slope", "intercept")


@operator("REGRESS", "gis", "dependent independent")
def regress(y: Grid, x: Grid):
    t = _both(y, x).agg(F.count("*").alias("n"), F.regr_slope("v0", "v1").alias("slope"), F.regr_intercept("v0", "v1").alias("intercept"), F.regr_r2("v0", "v1").alias("r2"), F.regr_syy("v0", "v1").alias("syy"), F.regr_sxx("v0", "v1").alias("sxx"))
    se = F.sqrt(F.col("syy") * (1 - F.col("r2")) / (F.col("n") - 2))
    return t.select("n", "slope", "intercept", "r2", se.alias("std_error"), (F.col("slope") / (se / F.sqrt("sxx"))).alias("t_slope"))


def regress_grids(y: Grid, x: Grid) -> Grid:
    """Predicted values v and residuals."""
    fit = one_row(align([y, x]), regress(y, x).select("slope", "intercept"))
    return y.with_cells(fit.select(*KEY, (F.col("v1") * F.col("slope") + F.col("intercept")).alias("v"), (F.col("v0") - F.col("v1") * F.col("slope") - F.col("intercept")).alias("residual")))


@operator("VALIDATE", "gis", "predicted observed")
def validate(p: Grid, o: Grid):
    e = F.col("v0") - F.col("v1")
    t = _both(p, o).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.pow(F.corr("v0", "v1"), 2).alias("r2"), F.avg(e).alias("bias"), F.sum(e * e).alias("sse"), (F.var_pop("v1") * F.count("*")).alias("sst"))
    return t.select("rmse", "mae", "r2", "bias", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(0.0).alias("nse"))


@operator("JACCARD", "hbm", "input1 input2")
def jaccard_index(a: Grid, b: Grid):
    t = _both(a, b).agg(F.count_if((F.col("v0") != 0) & (F.col("v1") != 0)).alias("both"), F.count_if((F.col("v0") != 0) | (F.col("v1") != 0)).alias("either"))
    return t.withColumn("jaccard", F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(0.0))


@operator("SIM_WEIGHT", "hbm", "inputs reference")
def similarity_weighted(inputs: list[Grid], reference: Grid):
    """Mean of the inputs, weighted by their positive correlations with the reference; equal weights if there is none."""
    t, n = align([reference, *inputs]), len(inputs)
    full = t.where(" and ".join(f"v{k} is not null" for k in range(n + 1)))
    w = full.agg(*(F.greatest(F.lit(0.0), F.coalesce(F.corr("v0", f"v{k + 1}"), F.lit(0.0))).alias(f"w{k + 1}") for k in range(n)))
    s = sum((F.col(f"w{k + 1}") for k in range(n)), F.lit(0.0))
    plain = sum((F.col(f"v{k + 1}") for k in range(n)), F.lit(0.0)) / n
    return reference.with_cells(one_row(t, w).select(*KEY, F.when(s > 0, sum((F.col(f"v{k + 1}") * F.col(f"w{k + 1}") for k in range(n)), F.lit(0.0)) / s).otherwise(plain).alias("v")))


@operator("ATMOSC", "imgproc", "input", method=("DOS1", "COST"), sun_elevation=45.0)
def dark_object(grid: Grid, method, sun_elevation):
    v = F.greatest(F.lit(0.0), F.col("v") - F.col("min"))
    z = math.cos(math.radians(90 - sun_elevation))
    return grid.with_cells(_with_stats(grid).select(*KEY, F.when(F.col("v").isNotNull(), v if method == "DOS1" else v / z).alias("v")))


@operator("SEDIMENT_DELIVERY", "esm", "rusle accumulation", beta=1.0)
def sediment_delivery(rusle: Grid, acc: Grid, beta):
    t = one_row(align([rusle, acc]), acc.valid().agg(F.max("v").alias("top")))
    return rusle.with_cells(t.select(*KEY, (F.col("v0") * F.exp(-beta * (1 - F.col("v1") / F.col("top")))).alias("v")))


@operator("CLIMATE_ADAPTATION", "ccam", "exposure sensitivity capacity", ac_weight=0.5)
def climate_vulnerability(e: Grid, s: Grid, c: Grid, ac_weight):
    t = align([normalize(e), normalize(s), normalize(c)])
    v = (F.col("v0") + F.col("v1")) / 2 - F.col("v2") * ac_weight
    return e.with_cells(t.select(*KEY, F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))).alias("v")))


@operator("CRATIO", "gis", "input")
def concentration(grid: Grid):
    """Gini coefficient of the cells' values; ranks run over counts of equal values. 0 if they sum to 0, null for fewer than two cells; negative values raise."""
    r = running_count(grid.valid(), F.col("v")).agg(F.min("key").alias("least"), F.sum("n").alias("n"), F.sum(F.col("key") * F.col("n")).alias("s"), F.sum(F.col("key") * (F.col("before") * F.col("n") + F.col("n") * (F.col("n") + 1) / 2)).alias("rs"))
    gini = F.when(F.col("s") > 0, 2 * F.col("rs") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0)
    return r.select(F.when(F.col("least") < 0, F.raise_error(F.lit("CRATIO needs values of 0 or more"))).when(F.col("n") > 1, gini).alias("gini"))


@operator("SENSITIVITY", "gis", "inputs", weights=(), variation_pct=10.0)
def sensitivity(inputs: list[Grid], weights, variation_pct):
    """factor, way, mean and change of the weighted mean when one weight moves, the weights summing to one again."""
    t = align(inputs)
    m = t.where(" and ".join(f"v{k} is not null" for k in range(len(inputs)))).agg(*(F.avg(f"v{k}").alias(f"m{k}") for k in range(len(inputs))))

    def mean(w):
        return sum((F.col(f"m{k}") * (x / sum(w)) for k, x in enumerate(w)), F.lit(0.0))

    rows = [F.struct(F.lit(k).alias("factor"), F.lit(s).alias("way"), mean([x * (1 + s * variation_pct / 100) if i == k else x for i, x in enumerate(weights)]).alias("mean"), mean(list(weights)).alias("base")) for k in range(len(inputs)) for s in (-1, 1)]
    return m.select(F.inline(F.array(*rows))).withColumn("change", F.col("mean") - F.col("base"))


@operator("ROC", "gis", "prediction reference", num_thresholds=100)
def roc(p: Grid, ref: Grid, num_thresholds):
    """threshold, tpr, fpr at equal steps from the least to the largest prediction; a cell counts from its threshold down."""
    t = _both(p, ref).select(F.col("v0").alias("p"), (F.col("v1") != 0).alias("hit"))
    s = t.agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    slot = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("p") - F.col("lo")) / (F.col("hi") - F.col("lo")) * num_thresholds)).otherwise(0).cast("int")
    counts = one_row(t, s).groupBy(slot.alias("step")).agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"))
    steps = one_row(t.sparkSession.range(num_thresholds + 1).select(F.col("id").cast("int").alias("step")), s)
    down = Window.orderBy(F.col("step").desc())  # over the thresholds only
    x = steps.join(counts, "step", "left").na.fill(0, ["tp", "fp"])
    return x.select("step", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / num_thresholds).alias("threshold"), (F.sum("tp").over(down) / F.col("pos")).alias("tpr"), (F.sum("fp").over(down) / F.col("neg")).alias("fpr"))


# Ranks


@operator("RANK", "gis", "input", ascending=False)
def rank(grid: Grid, ascending):
    """Competition ranks of all valid cells, from 1."""
    ranks = running_count(grid.valid(), F.col("v") if ascending else -F.col("v")).select((F.col("key") if ascending else -F.col("key")).alias("v"), "n", (F.col("before") + 1).cast("double").alias("r"))
    return grid.with_cells(by_key(grid.df, ranks, "v").select(*KEY, F.col("r").alias("v")))


@operator("TOPRANK", "gis", "input", mode=("Number of cells", "Percentage"), num_cells=100, percentage=5.0)
def top_rank(grid: Grid, mode, num_cells, percentage):
    """1 for the largest cells, ties by cell number, else 0. Only cells of the tied value are ordered."""
    ranks = running_count(grid.valid(), -F.col("v")).select((-F.col("key")).alias("v"), "before", "n")
    want = F.lit(num_cells) if mode == "Number of cells" else F.floor(F.col("all") * (percentage / 100))
    t = one_row(by_key(grid.valid(), ranks, "v"), grid.valid().agg(F.count("*").alias("all"))).withColumn("want", want)
    edge = t.where("before < want and before + n > want")
    slot = running_count(edge, grid.cell_id()).select(F.col("key").alias("id"), F.col("before").alias("nth"))
    t = t.withColumn("id", grid.cell_id()).join(slot, "id", "left")
    picked = (F.col("before") + F.coalesce("nth", F.lit(0)) < F.col("want")) & (F.col("nth").isNotNull() | (F.col("before") + F.col("n") <= F.col("want")))
    hits = t.where(picked).select(*KEY, F.lit(1.0).alias("hit"))
    return grid.with_cells(grid.df.join(hits, KEY, "left").select(*KEY, F.when(F.col("v").isNotNull(), F.coalesce("hit", F.lit(0.0))).alias("v")))


@operator("SCATTER", "gis", "input1 input2", max_points=10000)
def scatter(a: Grid, b: Grid, max_points):
    """A seeded sample of valid pairs."""
    return _both(a, b).orderBy(F.xxhash64("row", "col", F.lit(42)), *KEY).limit(max_points).select(*KEY, F.col("v0").alias("x"), F.col("v1").alias("y"))


@operator("SAMPLE", "gis", "reference strata", method=("Random", "Systematic", "Stratified Random"), num_points=100, seed=42)
def sample(grid: Grid, strata, method, num_points, seed):
    """row, col and id of sampled valid cells; random ones by a seeded hash."""
    key = F.xxhash64("row", "col", F.lit(seed))
    if method == "Systematic":
        step = max(1, round(math.sqrt(grid.rows * grid.cols / num_points)))
        picked = grid.valid().where((F.col("row") % step == step // 2) & (F.col("col") % step == step // 2)).select(*KEY)
    elif method == "Random":
        picked = grid.valid().orderBy(key, *KEY).limit(num_points).select(*KEY)
    else:
        t = align([grid, strata]).where("v0 is not null and v1 is not null")
        size = t.groupBy("v1").agg(F.count("*").alias("n"))
        share = one_row(size, size.agg(F.sum("n").alias("all"))).withColumn("want", F.round(F.col("n") / F.col("all") * num_points))
        # A threshold on the hash first, so that a stratum's window holds some times its points, not all its cells.
        near = t.join(share, "v1").where(F.pmod(key, F.lit(1 << 20)) <= F.least(F.lit(1.0), 4 * (F.col("want") + 4) / F.col("n")) * float(1 << 20))
        picked = near.withColumn("k", F.row_number().over(Window.partitionBy("v1").orderBy(key, *KEY))).where("k <= want").select(*KEY)
    return picked.withColumn("id", F.row_number().over(Window.orderBy(*KEY)))  # num_points rows or so




@operator("CHGALLOC", "lcm", "base potentials demand")
def change_allocation(base: Grid, potentials: dict, demand):
    """demand: (from, to, cells) in order; each takes the cells of `from` with the largest potential that haven't changed yet."""
    state = base.df.select(*KEY, "v", F.lit(False).alias("done"))
    for start, to, n in demand:
        open_ = base.with_cells(state.where((~F.col("done")) & (F.col("v").cast("int") == start)).join(potentials[(start, to)].df.select(*KEY, F.col("v").alias("p")), KEY).select(*KEY, F.col("p").alias("v")))
        hit = top_rank(open_, "Number of cells", n, 5.0).df.where("v = 1").select(*KEY, F.lit(True).alias("hit"))
        state = state.join(hit, KEY, "left").select(*KEY, F.when(F.col("hit"), float(to)).otherwise(F.col("v")).alias("v"), (F.col("done") | F.coalesce("hit", F.lit(False))).alias("done"))
    return base.with_cells(state.select(*KEY, "v"))
