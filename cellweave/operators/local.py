"""Per-cell operators over one grid or several aligned ones: one join at most, everything else in projections."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.grid import KEY, Grid, align
from ..plans.registry import operator


def local(name: str, group: str, inputs: str, **params) -> Callable:
    """Register fn(*columns, **params), whose Column (or dict of Columns) becomes the cells of the result.

    inputs ending in * takes any number of grids, and fn a list. A cell without data in any input has none, unless
    fn says otherwise by itself.
    """

    def keep(fn: Callable) -> Callable:
        def run(*grids: Grid, **args) -> Grid:
            own = list(grids[0]) if inputs.endswith("*") else list(grids)
            cols = [F.col(f"v{k}") for k in range(len(own))]
            out = fn(cols, **args) if inputs.endswith("*") else fn(*cols, **args)
            out = out if isinstance(out, dict) else {"v": out}
            return own[0].with_cells(align(own).select(*KEY, *(c.cast("double").alias(k) for k, c in out.items())))

        operator(name, group, inputs.rstrip("*"), **params)(run)
        return fn

    return keep


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def flag(test: Column) -> Column:
    """1 or 0; null where the test is null."""
    return test.cast("double")


def all_valid(cols: list[Column], value: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, (c.isNotNull() for c in cols)), value)


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def product(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, cols)


# Arithmetic


@local("SCALAR", "gis", "input", operation=("Add", "Subtract", "Multiply", "Divide", "Power", "Log", "Exp", "Sqrt", "Abs"), scalar=1.0)
def scalar_op(v, operation, scalar):
    base = scalar if scalar > 0 and scalar != 1 else math.e
    return {
        "Add": lambda: v + scalar, "Subtract": lambda: v - scalar, "Multiply": lambda: v * scalar, "Divide": lambda: v / scalar if scalar else F.lit(None),
        "Power": lambda: F.pow(v, F.lit(scalar)), "Log": lambda: F.when(v > 0, F.log(v) / math.log(base)), "Exp": lambda: F.exp(v * scalar),
        "Sqrt": lambda: F.when(v >= 0, F.sqrt(v)), "Abs": lambda: F.abs(v),
    }[operation]()


@local("OVERLAY", "gis", "input1 input2", operation=("Add", "Subtract", "Multiply", "Divide", "Maximum", "Minimum", "Average", "Cover"))
def overlay(a, b, operation):
    """COVER takes the second grid's cell where that isn't zero, else the first's: what its description intends."""
    return {
        "Add": lambda: a + b, "Subtract": lambda: a - b, "Multiply": lambda: a * b, "Divide": lambda: F.when(b != 0, a / b),
        "Maximum": lambda: all_valid([a, b], F.greatest(a, b)), "Minimum": lambda: all_valid([a, b], F.least(a, b)), "Average": lambda: (a + b) / 2,
        "Cover": lambda: F.coalesce(F.when(b != 0, b), a),
    }[operation]()


@local("IMAGEDIFF", "gis", "input1 input2", threshold=0.0)
def image_difference(a, b, threshold):
    return flag(F.abs(b - a) > threshold) if threshold > 0 else b - a


@local("IMAGERATIO", "gis", "input1 input2")
def image_ratio(a, b):
    return F.when(F.abs(b) >= 1e-15, a / b)


# Logic


@local("LOGIC", "gis", "input1 input2", operation=("AND", "OR", "XOR", "NOT"))
def fuzzy_logic(a, b, operation):
    return {"AND": all_valid([a, b], F.least(a, b)), "OR": all_valid([a, b], F.greatest(a, b)), "XOR": a + b - 2 * F.least(a, b), "NOT": 1 - a}[operation]


local("LOGICAND", "gis", "input1 input2")(lambda a, b: flag((a != 0) & (b != 0)))
local("LOGICOR", "gis", "input1 input2")(lambda a, b: flag((a != 0) | (b != 0)))
local("LOGICXOR", "gis", "input1 input2")(lambda a, b: flag((a != 0) != (b != 0)))
local("LOGICNOT", "gis", "input")(lambda v: flag(v == 0))
local("HIGHLIGHT", "gis", "input", min_val=0.0, max_val=1.0)(lambda v, min_val, max_val: F.coalesce(flag(v.between(min_val, max_val)), F.lit(0.0)))


# Fuzzy membership, evidence, decisions


@local("FUZZY", "gis", "input", function=("sigmoidal-inc", "sigmoidal-dec", "j-shaped-inc", "j-shaped-dec", "linear-inc", "linear-dec"), control_a=0.0, control_b=1.0)
def fuzzy(v, function, control_a, control_b):
    shape, way = function.rsplit("-", 1)
    t = (v - control_a) / (control_b - control_a)
    if shape == "j-shaped":  # one beyond the far point, half at the near one
        far = t - 1 if way == "inc" else t
        return F.when(v >= control_b if way == "inc" else v <= control_a, 1.0).otherwise(1 / (1 + far * far))
    inside = F.pow(F.sin(t * (math.pi / 2)), 2) if shape == "sigmoidal" else t
    rising = F.when(v <= control_a, 0.0).when(v >= control_b, 1.0).otherwise(inside)
    return rising if way == "inc" else 1 - rising


local("BAYES", "gis", "prior likelihood evidence")(lambda p, lk, e: F.when(e != 0, p * lk / e))


@local("PCORBINARY", "gis", "input_probability", prior_proportion=0.5, sample_prevalence=0.5)
def prior_corrected(p, prior_proportion, sample_prevalence):
    yes = clamp(p, 0, 1) * (prior_proportion / sample_prevalence)
    both = yes + (1 - clamp(p, 0, 1)) * ((1 - prior_proportion) / (1 - sample_prevalence))
    return F.when(p.isNotNull() & (both > 0), clamp(yes / both, 0, 1))


@local("BELIEF", "gis", "pairs*")
def dempster(cols):
    """belief, plausibility and interval from grids in the order belief, plausibility, belief, plausibility, ..."""
    first = F.struct(cols[0].alias("b"), cols[1].alias("p"))
    rest = F.array(*(F.struct(b.alias("b"), p.alias("p")) for b, p in zip(cols[2::2], cols[3::2])))

    def join(one, two):
        clash = one["b"] * (1 - two["p"]) + (1 - one["p"]) * two["b"]
        # Belief and plausibility multiply like intervals once conflict is taken out.
        b = (one["b"] * two["p"] + one["p"] * two["b"] - one["b"] * two["b"]) / (1 - clash)
        return F.when(clash < 1, F.struct(b.alias("b"), (one["p"] * two["p"] / (1 - clash)).alias("p")))

    done = F.aggregate(rest, first, join) if len(cols) > 2 else first
    return {"v": done["b"], "plausibility": done["p"], "interval": done["p"] - done["b"]}


@local("BELCALC", "imgproc", "inputs*")
def simple_support(cols):
    """Combined support of one hypothesis by independent sources."""
    return all_valid(cols, 1 - product([1 - clamp(c, 0, 1) for c in cols]))


@local("MCE", "gis", "factors*", weights=(), constraints=0, method="WLC", order_weights=())
def multi_criteria(cols, weights, constraints, method, order_weights):
    """The last `constraints` grids mask the others: Boolean product, weighted sum, or ordered weighted average."""
    factors, masks = cols[: len(cols) - constraints], cols[len(cols) - constraints :]
    mask = product([F.lit(1.0), *masks])
    if method == "Boolean":
        return mask * product(factors)
    if len(weights) != len(factors) or abs(sum(weights) - 1) > 0.001:
        raise ValueError("weights must match the factors and sum to 1")
    weighted = [c * w for c, w in zip(factors, weights)]
    if method == "WLC":
        return total(weighted) * mask
    if len(order_weights) != len(factors) or abs(sum(order_weights) - 1) > 0.001:
        raise ValueError("order weights must match the factors and sum to 1")
    ranked = F.array_sort(F.array(*weighted))
    return all_valid(factors, total([ranked[k] * w for k, w in enumerate(order_weights)])) * len(factors) * mask


@local("MDCHOICE", "gis", "suitability_maps*", weights=())
def best_choice(cols, weights):
    score = F.array(*(c * w for c, w in zip(cols, weights)))
    top = F.array_max(score)
    return {"v": all_valid(cols, F.array_position(score, top)), "score": all_valid(cols, top)}


@local("CONSENSUS", "gis", "inputs*", method=("unanimous", "majority", "plurality"))
def consensus(cols, method):
    """Votes of classified grids; ties go to the smallest class."""
    votes = F.array(*cols)
    counts = F.transform(votes, lambda x: F.struct(F.size(F.filter(votes, lambda y: y == x)).alias("n"), (-x).alias("c")))
    top = F.array_max(counts)
    need = {"unanimous": len(cols), "majority": len(cols) // 2 + 1, "plurality": 1}[method]
    return all_valid(cols, F.when(top["n"] >= need, -top["c"]))


@local("HARDEN", "imgproc", "input_rasters*", threshold=0.0)
def harden(cols, threshold):
    a = F.array(*cols)
    return all_valid(cols, F.when(F.array_max(a) >= threshold if threshold > 0 else F.lit(True), F.array_position(a, F.array_max(a))).otherwise(0))


@local("MAXSET", "imgproc", "inputs*")
def max_set(cols):
    a = F.array(*cols)
    return {"v": all_valid(cols, F.array_position(a, F.array_max(a))), "maxval": all_valid(cols, F.array_max(a))}


local("OVERLAP_USE", "hbm", "inputs*")(lambda cols: total([F.coalesce((c != 0).cast("double"), F.lit(0.0)) for c in cols]))
local("NDVICOMP", "imgproc", "inputs*")(lambda cols: F.array_max(F.array(*cols)))


@local("HABITAT_ASSESSMENT", "hbm", "input_rasters*", weights=(), threshold=0.0)
def habitat_assessment(cols, weights, threshold):
    s = total([clamp(c, 0, 1) * w for c, w in zip(cols, weights)])
    return all_valid(cols, F.when(s >= threshold, s).otherwise(0.0) if threshold > 0 else s)


@local("PREDICTION", "lcm", "transition_potentials*", column_means=(), prediction_type=("Hard", "Soft"))
def prediction(cols, column_means, prediction_type):
    if prediction_type == "Soft":
        return all_valid(cols, F.array_max(F.array(*cols)))
    a = F.array(*(c * m for c, m in zip(cols, column_means)))
    return all_valid(cols, F.array_position(a, F.array_max(a)))


# Vectors, change, hydrology


def _degrees(y: Column, x: Column) -> Column:
    d = F.degrees(F.atan2(y, x))
    return F.when(d < 0, d + 360).otherwise(d)


@local("DECOMP", "gis", "input1 input2", mode=("Decompose", "Recompose"))
def decompose(a, b, mode):
    if mode == "Decompose":
        return {"v": a * F.cos(F.radians(b)), "y": a * F.sin(F.radians(b))}
    return {"v": F.sqrt(a * a + b * b), "direction": _degrees(b, a)}


@local("RESULTANT", "gis", "mag1 dir1 mag2 dir2")
def resultant(m1, d1, m2, d2):
    """Sum of two vectors given by azimuth."""
    x = m1 * F.sin(F.radians(d1)) + m2 * F.sin(F.radians(d2))
    y = m1 * F.cos(F.radians(d1)) + m2 * F.cos(F.radians(d2))
    return {"v": F.sqrt(x * x + y * y), "direction": _degrees(x, y)}


@local("CVA", "gis", "bands*")
def change_vector(cols):
    """bands: all of the first date, then all of the second."""
    n = len(cols) // 2
    d = [b - a for a, b in zip(cols[:n], cols[n:])]
    way = F.when(d[0] >= 0, 0.0).otherwise(180.0) if n == 1 else _degrees(d[1], d[0])
    return {"v": F.sqrt(total([x * x for x in d])), "direction": way}


@local("RUNOFF", "gis", "precipitation curve_number")
def runoff(p, cn):
    s = (1000 / cn - 10) * 25.4
    return F.when((cn > 0) & p.isNotNull(), F.when(p > 0.2 * s, F.pow(p - 0.2 * s, 2) / (p + 0.8 * s)).otherwise(0.0))


local("RUSLE", "gis", "r k ls c p")(lambda *c: product(list(c)))
local("COASTAL_VULNERABILITY", "esm", "factors*")(lambda cols: F.when(product(cols) >= 0, F.sqrt(product(cols) / 6)))
local("WAVE_ENERGY", "esm", "wave_height wave_period", water_density=1025.0)(lambda h, t, water_density: h * h * t * (water_density * 9.81**2 / (64 * math.pi)))


# Band arithmetic


def _index(a: Column, b: Column, small) -> Column:
    return F.when(F.abs(a + b) >= 1e-10, (a - b) / (a + b)).when((a + b).isNotNull(), small)


local("NDVI", "imgproc", "nir red")(lambda n, r: F.when(F.abs(n + r) >= 1e-10, clamp((n - r) / (n + r), -1, 1)))
local("SNOWINDEX", "imgproc", "green swir")(lambda g, s: F.when((g + s).isNotNull(), clamp(_index(g, s, F.lit(0.0)), -1, 1)))
local("WATERINDEX", "gis", "green nir")(lambda g, n: _index(g, n, F.lit(0.0)))
local("SOILSALINITY", "imgproc", "red nir")(lambda r, n: F.when(r * n >= 0, F.sqrt(r * n)).when((r * n).isNotNull(), 0.0))


@local("SOIL_SALINITY", "esm", "band1 band2", index_type=("ndsi", "si1", "si2"))
def soil_salinity(a, b, index_type):
    """si2 is the same index as ndsi."""
    if index_type == "si1":
        return F.when(a * b >= 0, F.sqrt(a * b)).when((a * b).isNotNull(), 0.0)
    return _index(a, b, F.lit(0.0))


@local("VEGINDEX", "imgproc", "nir red blue green", index_type=("SAVI", "EVI", "MSAVI", "GNDVI", "NDWI"), savi_l=0.5)
def vegetation_index(n, r, b, g, index_type, savi_l):
    def ratio(top, bottom):
        return F.when(F.abs(bottom) >= 1e-10, top / bottom).when(bottom.isNotNull(), 0.0)

    return {
        "SAVI": ratio((n - r) * (1 + savi_l), n + r + savi_l), "EVI": ratio(2.5 * (n - r), n + 6 * r - 7.5 * b + 1),
        "MSAVI": (2 * n + 1 - F.sqrt(F.greatest(F.lit(0.0), F.pow(2 * n + 1, F.lit(2)) - 8 * (n - r)))) / 2, "GNDVI": ratio(n - g, n + g), "NDWI": ratio(g - n, g + n),
    }[index_type]


local("THERMAL", "imgproc", "thermal", gain=0.0, offset=0.0, k1=0.0, k2=0.0)(lambda v, gain, offset, k1, k2: F.when(v * gain + offset > 0, k2 / F.log(k1 / (v * gain + offset) + 1)))
local("RADIANCE", "imgproc", "input", gain=1.0, offset=0.0)(lambda v, gain, offset: v * gain + offset)
local("MODISQC", "io", "input", start_bit=0, num_bits=2)(lambda v, start_bit, num_bits: F.shiftright(v.cast("long"), start_bit).bitwiseAND((1 << num_bits) - 1))


@local("PRIORCORRECT", "imgproc", "posteriors*", priors=(), normalize=True, min_prior=0.001)
def prior_correct(cols, priors, normalize, min_prior):
    n = len(cols)
    w = [c * (max(p, min_prior) * n) for c, p in zip(cols, priors)]
    s = total(w)
    out = [F.when(s > 0, x / s).otherwise(x) if normalize else x for x in w]
    return {"v": out[0]} | {f"class{k + 1}": x for k, x in enumerate(out)}


@local("COLSPACE", "imgproc", "b1 b2 b3", direction=("RGB_to_HSI", "HSI_to_RGB", "RGB_to_HSV", "HSV_to_RGB"))
def colour_space(a, b, c, direction):
    """Three bands to three bands v, v2, v3; hue in degrees."""
    if direction == "RGB_to_HSI":
        i = (a + b + c) / 3
        den = F.sqrt((a - b) * (a - b) + (a - c) * (b - c))
        turn = F.degrees(F.acos(clamp((2 * a - b - c) / 2 / den, -1, 1)))
        hue = F.when(den < 1e-10, 0.0).when(c <= b, turn).otherwise(360 - turn)
        return {"v": hue, "v2": F.when(i > 1e-10, 1 - F.least(a, b, c) / i).otherwise(0.0), "v3": i}
    if direction == "HSI_to_RGB":
        sector = F.when(a < 120, 0).when(a < 240, 1).otherwise(2)
        h = F.radians(a - sector * 120)
        low = c * (1 - b)
        high = c * (1 + b * F.cos(h) / F.cos(math.pi / 3 - h))
        rest = 3 * c - low - high
        pick = [(high, low, rest), (rest, high, low), (low, rest, high)]
        return {n: F.when(sector == 0, x).when(sector == 1, y).otherwise(z) for n, (x, y, z) in zip(("v", "v2", "v3"), pick)}
    if direction == "RGB_to_HSV":
        top, span = F.greatest(a, b, c), F.greatest(a, b, c) - F.least(a, b, c)
        hue = F.when(top == a, ((b - c) / span + 6) % 6).when(top == b, (c - a) / span + 2).otherwise((a - b) / span + 4) * 60
        return {"v": F.when(span > 1e-10, hue).otherwise(0.0), "v2": F.when(top > 1e-10, span / top).otherwise(0.0), "v3": top}
    chroma = b * c
    other = chroma * (1 - F.abs((a / 60) % 2 - 1))

    def channel(shift):
        at = F.floor(a / 60 + shift) % 6
        return F.when(at.isin(0, 5), chroma).when(at.isin(1, 4), other).otherwise(0.0) + c - chroma

    return {"v": channel(0), "v2": channel(4), "v3": channel(2)}


#: Tasseled Cap coefficients (brightness, greenness, wetness by six bands).
TASSELED_CAP = {
    "TM": ((0.3037, 0.2793, 0.4743, 0.5585, 0.5082, 0.1863), (-0.2848, -0.2435, -0.5436, 0.7243, 0.0840, -0.1800), (0.1509, 0.1973, 0.3279, 0.3406, -0.7112, -0.4572)),
    "ETM+": ((0.3561, 0.3972, 0.3904, 0.6966, 0.2286, 0.1596), (-0.3344, -0.3544, -0.4556, 0.6966, -0.0242, -0.2630), (0.2626, 0.2141, 0.0926, 0.0656, -0.7629, -0.5388)),
    "OLI": ((0.3029, 0.2786, 0.4733, 0.5599, 0.5080, 0.1872), (-0.2941, -0.2430, -0.5424, 0.7276, 0.0713, -0.1608), (0.1511, 0.1973, 0.3283, 0.3407, -0.7117, -0.4559)),
}


@local("TASSCAP", "imgproc", "bands*", sensor=("TM", "ETM+", "OLI"))
def tasseled_cap(cols, sensor):
    return {n: total([c * k for c, k in zip(cols, row)]) for n, row in zip(("v", "greenness", "wetness"), TASSELED_CAP[sensor])}


# Casts, masks, updates

RANGES = {"Byte": (0, 255), "Int16": (-32768, 32767), "Int32": (-2147483648, 2147483647)}


@local("CONVERT", "gis", "input", data_type="Float32")
def convert(v, data_type):
    """Integers: clamped and rounded half away from zero."""
    if data_type in RANGES:
        return F.round(clamp(v, *RANGES[data_type]))
    return v.cast("float") if data_type == "Float32" else v


local("IDRISICONV", "io", "input", data_type=("Float32", "Int16", "Int32"))(lambda v, data_type: convert(v, data_type))
local("NANFIX", "files", "input", replace_value=0.0)(lambda v, replace_value: F.when(F.isnan(v) | (F.abs(v) == float("inf")), replace_value).otherwise(v))
local("LINTOPNT", "files", "input")(lambda v: F.when(v.isNotNull(), v))
local("SCENGEN", "ccam", "baseline delta", method=("additive", "multiplicative"))(lambda v, d, method: v + d if method == "additive" else v * d)


@local("ECOCROP", "ccam", "temperature precipitation", crop=(10.0, 18.0, 28.0, 38.0, 300.0, 600.0, 1200.0, 2000.0))
def ecocrop(t, p, crop):
    """crop: lowest, optimum from, optimum to and highest temperature; the same for precipitation."""

    def ramp(x, a, b, c, d):
        return F.when((x <= a) | (x >= d), 0.0).when(x < b, (x - a) / (b - a)).when(x <= c, 1.0).otherwise((d - x) / (d - c))

    return all_valid([t, p], F.least(ramp(t, *crop[:4]), ramp(p, *crop[4:])))


@operator("EDIT", "files", "input", row=0, col=0, new_value=0.0)
def edit(grid: Grid, row, col, new_value):
    if not (0 <= row < grid.rows and 0 <= col < grid.cols):
        raise ValueError("cell out of bounds")
    return grid.with_cells(grid.df.withColumn("v", F.when((F.col("row") == row) & (F.col("col") == col), float(new_value)).otherwise(F.col("v"))))


@operator("UPDATE", "files", "input update condition", update_value=0.0)
def update(grid: Grid, new: Grid | None, condition: Grid | None, update_value):
    """Where the condition isn't zero (everywhere without one), the update grid's value or the constant replaces the cell."""
    df = grid.df
    value, test = F.lit(float(update_value)), F.lit(True)
    if new is not None:
        df, value = df.join(new.df.select(*KEY, F.col("v").alias("u")), KEY, "left"), F.col("u")
    if condition is not None:
        df, test = df.join(condition.df.select(*KEY, F.col("v").alias("c")), KEY, "left"), F.coalesce(F.col("c") != 0, F.lit(False))
    return grid.with_cells(df.select(*KEY, F.when(test, value).otherwise(F.col("v")).alias("v")))


@operator("INITIAL", "files", "", rows=100, cols=100, value=0.0, data_type="Float32")
def initial(spark, rows, cols, value, data_type):
    base = Grid(spark.range(0).select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(0.0).alias("v")), rows, cols)
    return base.with_cells(base.every_cell().withColumn("v", F.lit(float(value))))


@operator("PIXELLOCATION", "gis", "input", coordinate=("X", "Y"))
def pixel_location(grid: Grid, coordinate):
    return grid.with_cells(grid.df.select(*KEY, (grid.x() if coordinate == "X" else grid.y()).alias("v")))


@operator("RANDOM", "gis", "reference", distribution=("Uniform", "Normal"), min_value=0.0, max_value=1.0, mean=0.0, stddev=1.0, seed=42)
def random_grid(grid: Grid, distribution, min_value, max_value, mean, stddev, seed):
    """A seeded hash of the cell, so the same whatever the partitions."""
    u = [(F.pmod(F.xxhash64("row", "col", F.lit(seed + k)), F.lit(1 << 52)) + 0.5) / float(1 << 52) for k in range(2)]
    v = u[0] * (max_value - min_value) + min_value if distribution == "Uniform" else F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1]) * stddev + mean
    return grid.with_cells(grid.df.select(*KEY, F.when(F.col("v").isNotNull(), v).alias("v")))


@operator("STCHOICE", "gis", "landcover potential", matrix=(), num_classes=5, seed=42)
def stochastic_choice(land: Grid, potential: Grid, matrix, num_classes, seed):
    """matrix: (from, to, probability), of classes 0 to num_classes - 1; others are left out, and rows must sum to 1 within 0.05. Off-diagonal probabilities are scaled by the potential and drawn with a seeded hash of the cell."""
    u = (F.pmod(F.xxhash64("row", "col", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    out, matrix = F.col("v0"), [m for m in matrix if 0 <= m[0] < num_classes and 0 <= m[1] < num_classes]
    for start in sorted({m[0] for m in matrix}, reverse=True):
        total = sum(m[2] for m in matrix if m[0] == start)
        if total > 0 and abs(total - 1) > 0.05:
            raise ValueError(f"probabilities of class {start} sum to {total}")
        below, pick = F.lit(0.0), F.when(F.lit(False), F.lit(0.0))
        for _, to, p in sorted(m for m in matrix if m[0] == start and m[1] != start):
            below = below + F.col("v1") * p
            pick = pick.when(u < below, float(to))
        out = F.when(F.col("v0").cast("int") == start, F.coalesce(pick, F.col("v0"))).otherwise(out)
    return land.with_cells(align([land, potential]).select(*KEY, out.alias("v")))


# Lookups in tables, which are joined, so their size doesn't matter


def _lookup(grid: Grid, table, key: str, value: str, scale: float = 1.0) -> Grid:
    lut = table.select(F.col(key).cast("double").alias("__k"), F.col(value).cast("double").alias("__x"))
    hit = grid.df.join(lut, F.round("v") == F.col("__k"), "left")
    return grid.with_cells(hit.select(*KEY, F.when(F.col("v").isNotNull(), F.coalesce("__x", F.lit(0.0)) * scale).alias("v")))


operator("ASSIGN", "gis", "input table")(lambda grid, table: _lookup(grid, table, "id", "value"))


def _hectares(grid: Grid, pixel_area_ha: float) -> float:
    """Of a cell: given, or from its size in metres, or in degrees where that is below one."""
    dx, dy = grid.cell
    metres = (dx * 111320 * dy * 110540) if dx < 1 and dy < 1 else dx * dy
    return pixel_area_ha if pixel_area_ha > 0 else metres / 10000


operator("CARBON_STOCK", "esm", "landcover table", pixel_area_ha=0.0)(lambda g, t, pixel_area_ha: _lookup(g, t, "class_id", "carbon_tons_per_ha", _hectares(g, pixel_area_ha)))
operator("ECOSYSTEM_SERVICES", "esm", "land_cover table", pixel_area_ha=0.0)(lambda g, t, pixel_area_ha: _lookup(g, t, "class_id", "value_per_ha", _hectares(g, pixel_area_ha)))
