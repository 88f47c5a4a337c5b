"""Per-cell time series: a table (row, col, t, v), or the same as an array per cell. Series are short, cells are many.

What windows over a cell's times can say is said with windows; small least-squares fits with a fixed design are dot
products with its pseudo-inverse, inside the JVM.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.grid import KEY
from ..plans.registry import operator


def timed():
    """A cell's rows in order of time."""
    return Window.partitionBy(*KEY).orderBy("t")


def to_arrays(series: DataFrame) -> DataFrame:
    """row, col, a: values in order of time."""
    return series.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("a"))


def dot(a: Column, weights) -> Column:
    """Sum of a[i] * weights[i]."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    return F.aggregate(F.zip_with(a, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@operator("TIMESERIES_STATS", "etm", "series", statistic=("Mean", "Min", "Max", "StdDev", "Sum", "Count"))
def series_stats(s: DataFrame, statistic):
    agg = {"Mean": F.avg("v"), "Min": F.min("v"), "Max": F.max("v"), "StdDev": F.coalesce(F.stddev_samp("v"), F.lit(0.0)), "Sum": F.sum("v"), "Count": F.count("v").cast("double")}[statistic]
    return s.where("v is not null").groupBy(*KEY).agg(agg.alias("v"))


@operator("TDIFF", "etm", "series")
def difference(s: DataFrame):
    """Value less the one before, from the second time on."""
    return s.select(*KEY, "t", (F.col("v") - F.lag("v").over(timed())).alias("v"), F.row_number().over(timed()).alias("k")).where("k > 1").drop("k")


@operator("TAGGREGATE", "etm", "series", group_size=12, method=("mean", "sum", "max", "min"))
def aggregate_steps(s: DataFrame, group_size, method):
    """Blocks of group_size steps; values without data are left out and a trailing part is dropped."""
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[method]("v")
    length = s.groupBy().agg((F.max("t") + 1).alias("n"))
    t = s.groupBy(*KEY, F.floor(F.col("t") / group_size).alias("block")).agg(agg.alias("v")).crossJoin(F.broadcast(length))
    return t.where((F.col("block") + 1) * group_size <= F.col("n")).select(*KEY, F.col("block").alias("t"), "v")


@operator("DESEASON", "etm", "series", period=12)
def deseason(s: DataFrame, period):
    return s.select(*KEY, "t", (F.col("v") - F.avg("v").over(Window.partitionBy(*KEY, F.col("t") % period))).alias("v"))


@operator("SEASONAL_DECOMP", "etm", "series", frequency=12)
def decompose(s: DataFrame, frequency):
    """Classical additive parts: trend (centred mean, half weights at the ends if the frequency is even), seasonal, residual."""
    h = frequency // 2
    wide, narrow = timed().rowsBetween(-h, h), timed().rowsBetween(-h + 1, h - 1)
    whole = F.count("v").over(wide) == 2 * h + 1
    trend = F.avg("v").over(wide) if frequency % 2 else (F.sum("v").over(wide) + F.sum("v").over(narrow)) / (2 * frequency) if h > 1 else F.sum("v").over(wide) / 4 + F.col("v") / 4
    t = s.withColumn("trend", F.when(whole, trend)).withColumn("phase", F.col("t") % frequency)
    t = t.withColumn("raw", F.avg(F.col("v") - F.col("trend")).over(Window.partitionBy(*KEY, "phase")))
    mean = t.groupBy(*KEY, "phase").agg(F.first("raw").alias("r")).groupBy(*KEY).agg(F.avg("r").alias("m"))
    t = t.join(mean, KEY).withColumn("seasonal", F.col("raw") - F.col("m"))
    return t.select(*KEY, "t", "v", "trend", "seasonal", (F.col("v") - F.col("trend") - F.col("seasonal")).alias("residual"))


@operator("TCOR", "etm", "series1 series2")
def correlation(a: DataFrame, b: DataFrame):
    t = a.join(b.select(*KEY, "t", F.col("v").alias("w")), [*KEY, "t"]).where("v is not null and w is not null")
    return t.groupBy(*KEY).agg(F.corr("v", "w").alias("r"), F.count("*").alias("n"))


@operator("TREND_ANALYSIS", "etm", "series")
def trend(s: DataFrame):
    """Slope of each cell on time, and its t value."""
    g = s.where("v is not null").groupBy(*KEY).agg(F.count("*").alias("n"), F.regr_slope("v", "t").alias("slope"), F.regr_r2("v", "t").alias("r2"))
    return g.select(*KEY, "slope", F.when((F.col("r2") < 1) & (F.col("n") > 2), F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2")))).alias("t_value"), "n")


@operator("KENDALLTAU", "gis", "series1 series2")
def kendall_cells(a: DataFrame, b: DataFrame):
    """Tau-b of two series per cell, over arrays."""
    t = a.join(b.select(*KEY, "t", F.col("v").alias("w")), [*KEY, "t"]).where("v is not null and w is not null").groupBy(*KEY).agg(F.collect_list(F.struct("v", "w")).alias("a"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def pair(p, q):
        dx, dy = F.signum(p["v"] - q["v"]), F.signum(p["w"] - q["w"])
        return F.struct((dx * dy).alias("s"), (dx * dx).alias("x"), (dy * dy).alias("y"))

    def plus(m, n):
        return F.struct((m["s"] + n["s"]).alias("s"), (m["x"] + n["x"]).alias("x"), (m["y"] + n["y"]).alias("y"))

    sums = F.aggregate(F.flatten(F.transform("a", lambda p: F.transform(F.col("a"), lambda q: pair(p, q)))), zero, plus)
    return t.select(*KEY, sums.alias("k")).select(*KEY, F.when((F.col("k.x") > 0) & (F.col("k.y") > 0), F.col("k.s") / F.sqrt(F.col("k.x") * F.col("k.y"))).otherwise(0.0).alias("tau"))


def _harmonics(n: int, count: int) -> np.ndarray:
    t = 2 * math.pi * np.arange(n) / n
    return np.column_stack([np.ones(n), *(f(k * t) for k in range(1, count + 1) for f in (np.cos, np.sin))])


@operator("HARMONICREG", "etm", "arrays", length=12, num_harmonics=2)
def harmonic_regression(a: DataFrame, length, num_harmonics):
    """arrays (row, col, a) of `length` values: intercept, amplitude and phase of each harmonic, and the fitted series."""
    x = _harmonics(length, num_harmonics)
    inverse = np.linalg.pinv(x)
    out = {"intercept": dot(F.col("a"), inverse[0])}
    for k in range(num_harmonics):
        c, s = dot(F.col("a"), inverse[1 + 2 * k]), dot(F.col("a"), inverse[2 + 2 * k])
        out |= {f"amplitude{k + 1}": F.sqrt(c * c + s * s), f"phase{k + 1}": F.atan2(s, c)}
    return a.select(*KEY, *(c.alias(n) for n, c in out.items()), F.array(*(dot(F.col("a"), row) for row in x @ inverse)).alias("fitted"))


@operator("TFA", "imgproc", "arrays", length=12, num_harmonics=3)
def fourier_series(a: DataFrame, length, num_harmonics):
    """Mean, and amplitude and phase of discrete Fourier terms."""
    t = 2 * math.pi * np.arange(length) / length
    out = {"mean": dot(F.col("a"), np.full(length, 1 / length))}
    for k in range(1, num_harmonics + 1):
        c, s = (dot(F.col("a"), 2 / length * f(k * t)) for f in (np.cos, np.sin))
        out |= {f"amplitude{k}": F.sqrt(c * c + s * s), f"phase{k}": F.atan2(s, c)}
    return a.select(*KEY, *(c.alias(n) for n, c in out.items()))


@operator("STA", "etm", "arrays", length=24, period=12)
def seasonal_trend(a: DataFrame, length, period):
    """Slope, and mean amplitude and phase of the season, of a regression on 1, t, cos, sin, t cos and t sin of the period; null where a step is missing."""
    if length < period:
        raise ValueError(f"at least {period} steps are needed")
    t = np.arange(length)
    w = 2 * math.pi * t / period
    inverse = np.linalg.pinv(np.column_stack([np.ones(length), t, np.cos(w), np.sin(w), t * np.cos(w), t * np.sin(w)]))
    c, s = dot(F.col("a"), inverse[2]), dot(F.col("a"), inverse[3])
    return a.select(*KEY, dot(F.col("a"), inverse[1]).alias("trend"), F.sqrt(c * c + s * s).alias("amplitude"), F.atan2(s, c).alias("phase"))


@operator("MODWT", "etm", "arrays", num_levels=3, wavelet_type=("haar", "db4"))
def wavelet(a: DataFrame, num_levels, wavelet_type):
    """A-trous details d1.. and smooth: filters widen by a power of two per level, with periodic ends."""
    root = math.sqrt(3)
    low = [0.5, 0.5] if wavelet_type == "haar" else [(1 + root) / 8, (3 + root) / 8, (3 - root) / 8, (1 - root) / 8]
    high = [(-1) ** k * x for k, x in enumerate(reversed(low))]
    t = a.withColumn("s", F.col("a"))
    for j in range(num_levels):
        gap = 2**j

        def run(taps, gap=gap):
            n = F.size("s")
            return F.transform("s", lambda x, i: sum((F.get(F.col("s"), F.pmod(i - k * gap, n)) * c for k, c in enumerate(taps)), F.lit(0.0)))

        t = t.withColumn(f"d{j + 1}", run(high)).withColumn("s", run(low))
    return t.select(*KEY, *(f"d{j + 1}" for j in range(num_levels)), F.col("s").alias("smooth"))


@operator("BIOCLIMVARS", "etm", "temperature precipitation")
def bioclim(temp: DataFrame, rain: DataFrame):
    """BIO1..BIO19 from arrays of 12 months; quarters are circular, and the daily range is taken as the annual one."""
    t, p = F.col("a"), F.col("p")

    def mean(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    def quarter(a):
        return F.array(*(a[k] + a[(k + 1) % 12] + a[(k + 2) % 12] for k in range(12)))

    def sd(a):
        m = mean(a)
        return F.sqrt(mean(F.transform(a, lambda x: (x - m) * (x - m))))

    tq, pq = F.transform(quarter(t), lambda x: x / 3), quarter(p)
    q = {"wet": F.array_position(pq, F.array_max(pq)), "dry": F.array_position(pq, F.array_min(pq)), "warm": F.array_position(tq, F.array_max(tq)), "cold": F.array_position(tq, F.array_min(tq))}
    at = lambda a, k: F.element_at(a, q[k].cast("int"))
    span, total = F.array_max(t) - F.array_min(t), mean(p) * 12
    values = [
        mean(t), span, F.when(span != 0, F.lit(100.0)).otherwise(0.0), sd(t) * 100, F.array_max(t), F.array_min(t), span, at(tq, "wet"), at(tq, "dry"), at(tq, "warm"), at(tq, "cold"),
        total, F.array_max(p), F.array_min(p), F.when(total > 0, sd(p) / mean(p) * 100).otherwise(0.0), at(pq, "wet"), at(pq, "dry"), at(pq, "warm"), at(pq, "cold"),
    ]
    return temp.join(rain.select(*KEY, F.col("a").alias("p")), KEY).select(*KEY, *(v.alias(f"bio{k + 1}") for k, v in enumerate(values)))


def _per_cell(df: DataFrame, columns: list[str], fn, schema: str) -> DataFrame:
    """fn over cells' arrays, in Arrow batches: arrays of equal length are one matrix (cells by steps) per column; fn gives a list per value."""
    import pyarrow as pa

    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches):
        for b in batches:
            data = [b.column(c).to_pylist() for c in columns]
            out, groups = [None] * b.num_rows, {}
            for r, arrays in enumerate(zip(*data)):
                groups.setdefault(tuple(map(len, arrays)), []).append(r)
            for rows in groups.values():
                found = fn(*(np.array([own[r] for r in rows], float) for own in data))
                for r, values in zip(rows, zip(*found)):
                    out[r] = values
            if out:
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("col"), *(pa.array(list(x), pa.list_(pa.float64()) if k.endswith("array<double>") else pa.float64()) for x, k in zip(zip(*out), schema.split(", ")))], ["row", "col", *names])

    return df.select(*KEY, *columns).mapInArrow(run, f"row int, col int, {schema}")


def _fit(y: np.ndarray, x: np.ndarray) -> tuple[list, list, list]:
    """Least squares of each row of y on its own design (rows, steps, terms): coefficients, R squared and residuals."""
    beta = np.einsum("rkt,rt->rk", np.linalg.pinv(x), y)
    rest = y - np.einsum("rtk,rk->rt", x, beta)
    spread = ((y - y.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    r2 = np.where(spread > 0, 1 - (rest**2).sum(axis=1) / np.where(spread > 0, spread, 1.0), 0.0)
    return beta.tolist(), r2.tolist(), rest.tolist()


@operator("MULTI_REG", "etm", "dependent independent")
def multiple_regression(y: DataFrame, xs: list[DataFrame]):
    """Coefficients (intercept first), R squared and residuals of each cell's series on others."""
    t = y
    for k, x in enumerate(xs):
        t = t.join(x.select(*KEY, F.col("a").alias(f"x{k}")), KEY)
    return _per_cell(t, ["a", *(f"x{k}" for k in range(len(xs)))], lambda y, *x: _fit(y, np.stack([np.ones(y.shape), *x], axis=2)), "coefficients array<double>, r2 double, residuals array<double>")


@operator("MLR", "etm", "response predictors")
def regression_on_time(y: DataFrame, xs: list[DataFrame]):
    """As MULTI_REG, with time as the first predictor."""
    t = y
    for k, x in enumerate(xs):
        t = t.join(x.select(*KEY, F.col("a").alias(f"x{k}")), KEY)
    time = lambda y: np.broadcast_to(np.arange(y.shape[1], dtype=float), y.shape)
    return _per_cell(t, ["a", *(f"x{k}" for k in range(len(xs)))], lambda y, *x: _fit(y, np.stack([np.ones(y.shape), time(y), *x], axis=2))[:2], "coefficients array<double>, r2 double")


@operator("HANTS", "etm", "arrays", num_harmonics=3, fit_error_tolerance=0.05)
def hants(a: DataFrame, num_harmonics, fit_error_tolerance):
    """Harmonic fit that leaves out values farther from it than the tolerance times the series' range, at most ten times; smooth series, amplitudes and phases.

    A cell that lacks a step has none of them. A cell's fit ends where fewer values than terms would stay, for then they wouldn't determine it.
    """

    def fit(y):
        x, use = _harmonics(y.shape[1], num_harmonics), np.isfinite(y)
        limit = fit_error_tolerance * (y.max(axis=1) - y.min(axis=1))
        beta, open_ = np.full((len(y), x.shape[1]), np.nan), np.flatnonzero(use.all(axis=1))
        for _ in range(10):
            if not len(open_):
                break
            # A value that is left out is a row of zeros.
            own = use[open_]
            beta[open_] = np.einsum("rkt,rt->rk", np.linalg.pinv(x[None] * own[:, :, None]), np.where(own, y[open_], 0.0))
            bad = own & (np.abs(y[open_] - beta[open_] @ x.T) > limit[open_, None])
            go = bad.any(axis=1) & (own.sum(axis=1) - bad.sum(axis=1) >= x.shape[1])
            use[open_[go]] &= ~bad[go]
            open_ = open_[go]
        c, s = beta[:, 1::2], beta[:, 2::2]
        known = ~np.isnan(beta[:, 0])
        return tuple([v if k else None for v, k in zip(found.tolist(), known)] for found in (beta @ x.T, np.hypot(c, s), np.arctan2(s, c)))

    return _per_cell(a, ["a"], fit, "smooth array<double>, amplitudes array<double>, phases array<double>")


@operator("MSSA", "etm", "arrays", window_length=12, num_components=5)
def singular_spectrum(a: DataFrame, window_length, num_components):
    """Reconstruction of each series from its leading lag-covariance components, by diagonal averages."""

    def run(y):
        n, m = y.shape[1], min(window_length, y.shape[1])
        mean = y.mean(axis=1, keepdims=True)
        lagged = np.lib.stride_tricks.sliding_window_view(y - mean, m, axis=1)
        _, vectors = np.linalg.eigh(lagged.transpose(0, 2, 1) @ lagged / lagged.shape[1])
        e = vectors[:, :, ::-1][:, :, :num_components]
        part = lagged @ e @ e.transpose(0, 2, 1)
        total, hits = np.zeros(y.shape), np.zeros(n)
        for j in range(m):
            total[:, j : j + part.shape[1]] += part[:, :, j]
            hits[j : j + part.shape[1]] += 1
        return ((total / hits + mean).tolist(),)

    return _per_cell(a, ["a"], run, "reconstruction array<double>")
