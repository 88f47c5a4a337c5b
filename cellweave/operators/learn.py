"""Classification, clustering and linear algebra over bands.

Pixels are a table (row, col, a): an array of band values. Moments come from one aggregation; matrices of the number of
bands or classes are solved on the driver; models go back as literals. Training sets are tables as large as they like
for what is fitted by moments, and are sampled to a stated bound where an algorithm needs them in one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.grid import KEY, Grid, align
from ..plans.registry import operator
from ..plans.scratch import discard, written
from .nearness import nearest_rows
from .zonal import running_count

#: Default of training_rows, the most labelled pixels that go into a classifier which is fitted in one place (SOM, RBFNN, both ARTMAPs); part of their results.
TRAINING_ROWS = 20000


def pixels(bands: list[Grid]) -> DataFrame:
    """row, col, a of cells with data in all bands."""
    t = align(bands)
    return t.where(" and ".join(f"v{k} is not null" for k in range(len(bands)))).select(*KEY, F.array(*(F.col(f"v{k}") for k in range(len(bands)))).alias("a"))


def training(px: DataFrame, labels: DataFrame) -> DataFrame:
    """row, col, a, label of pixels whose training value isn't zero."""
    return px.join(labels.select(*KEY, F.col("v").cast("int").alias("label")), KEY).where("label is not null and label <> 0")


def width(px: DataFrame) -> int:
    first = px.select(F.size("a").alias("n")).head()
    return first.n if first else 0


def moments(px: DataFrame, n: int, sample: bool = True) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of the arrays, by one aggregation of shifted sums."""
    f = F.covar_samp if sample else F.covar_pop
    cols = [F.col("a")[k] for k in range(n)]
    r = px.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{k}") for k, c in enumerate(cols)), *(f(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n))).head()
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    return r.n, np.array([r[f"m{k}"] or 0.0 for k in range(n)]), cov


def class_moments(t: DataFrame, n: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(label, count, mean, population covariance) of each class."""
    cols = [F.col("a")[k] for k in range(n)]
    rows = t.groupBy("label").agg(F.count("*").alias("n"), F.array(*(F.avg(c) for c in cols)).alias("m"), F.array(*(F.covar_pop(x, y) for x in cols for y in cols)).alias("c")).orderBy("label").collect()
    return [(r.label, r.n, np.array(r.m), np.array(r.c).reshape(n, n)) for r in rows]


def lit_array(x) -> Column:
    return F.array(*(F.lit(float(v)) for v in x))


def dot(a: Column, w) -> Column:
    return F.aggregate(F.zip_with(a, lit_array(w), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def square_distance(a: Column, center) -> Column:
    return F.aggregate(F.zip_with(a, lit_array(center), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def scaled(a, shift, size) -> Column:
    """(a[i] - shift[i]) / size[i]."""
    moved = F.zip_with(a, lit_array(shift), lambda x, y: x - y)
    return F.zip_with(moved, lit_array(size), lambda x, y: x / y)


def least(scores: list[tuple[int, Column]], name: str = "v") -> Column:
    """struct(d, label) of the least score; ties go to the first label given."""
    return F.array_min(F.array(*(F.struct(s.alias("d"), F.lit(k).alias("o"), F.lit(label).alias("label")) for k, (label, s) in enumerate(scores))))


def by_batch(px: DataFrame, fn: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """fn over a matrix of pixels (rows by bands), in Arrow batches."""
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches):
        for b in batches:
            if b.num_rows:
                out = fn(b.column("a").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("col"), *(pa.array(list(out[n])) for n in names)], ["row", "col", *names])

    return px.select(*KEY, "a").mapInArrow(run, f"row int, col int, {schema}")


# Components


@operator("PCA", "imgproc", "pixels", num_components=3, standardize=True)
def principal_components(px: DataFrame, num_components, standardize):
    """row, col and c1.. of centred (and scaled) bands along the leading eigenvectors, signs so that the largest loading is positive."""
    n = width(px)
    _, mean, cov = moments(px, n)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300)) if standardize else np.ones(n)
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    v = vectors[:, np.argsort(values)[::-1][:num_components]]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
    return px.select(*KEY, *((dot(F.col("a"), v[:, k] / sd) - float((v[:, k] / sd) @ mean)).alias(f"c{k + 1}") for k in range(v.shape[1])))


@operator("CANCOMP", "imgproc", "pixels labels", num_components=3)
def canonical_components(px: DataFrame, labels: DataFrame, num_components):
    n = width(px)
    stats = class_moments(training(px, labels), n)
    total = sum(c for _, c, _, _ in stats)
    mean = sum(c * m for _, c, m, _ in stats) / total
    within = sum(c * s for _, c, _, s in stats)
    between = sum(c * np.outer(m - mean, m - mean) for _, c, m, _ in stats)
    values, vectors = np.linalg.eig(np.linalg.pinv(within) @ between)
    v = np.real(vectors[:, np.argsort(-np.real(values))[:num_components]])
    return px.select(*KEY, *((dot(F.col("a"), v[:, k]) - float(v[:, k] @ mean)).alias(f"c{k + 1}") for k in range(v.shape[1])))


def _canonical(px: DataFrame, na: int, nb: int, count: int):
    _, mean, cov = moments(px, na + nb)
    a, b, ab = cov[:na, :na], cov[na:, na:], cov[:na, na:]
    ra, rb = (np.linalg.pinv(np.linalg.cholesky(m + 1e-10 * np.eye(len(m)))) for m in (a, b))
    u, s, vt = np.linalg.svd(ra @ ab @ rb.T)
    return mean, (ra.T @ u)[:, :count], (rb.T @ vt.T)[:, :count], s[:count]


@operator("CANCOR", "imgproc", "group1 group2", num_variates=3)
def canonical_correlation(g1: list[Grid], g2: list[Grid], num_variates):
    """row, col, u1.. and v1.. of the two groups' canonical variates."""
    px, na, nb = pixels([*g1, *g2]), len(g1), len(g2)
    mean, wa, wb, _ = _canonical(px, na, nb, num_variates)
    a, b = F.slice("a", 1, na), F.slice("a", na + 1, nb)
    us = [(dot(a, wa[:, k]) - float(wa[:, k] @ mean[:na])).alias(f"u{k + 1}") for k in range(wa.shape[1])]
    return px.select(*KEY, *us, *((dot(b, wb[:, k]) - float(wb[:, k] @ mean[na:])).alias(f"v{k + 1}") for k in range(wb.shape[1])))


operator("CCA", "etm", "set1 set2", num_components=3)(lambda a, b, num_components: canonical_correlation(a, b, num_components))


@operator("MNF", "imgproc", "pixels", num_components=3)
def minimum_noise(px: DataFrame, num_components):
    """Noise from differences to the eastern neighbour; components of the noise-whitened bands."""
    n = width(px)
    east = px.select("row", (F.col("col") - 1).alias("col"), F.col("a").alias("b"))
    _, _, noise = moments(px.join(east, KEY).select(F.zip_with("a", "b", lambda x, y: x - y).alias("a")), n)
    sd = np.sqrt(np.maximum(np.diag(noise) / 2, 1e-12))
    _, mean, cov = moments(px, n)
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    v = vectors[:, np.argsort(values)[::-1][:num_components]] / sd[:, None]
    return px.select(*KEY, *((dot(F.col("a"), v[:, k]) - float(v[:, k] @ mean)).alias(f"c{k + 1}") for k in range(v.shape[1])))


# Signatures: [(class, mean, covariance, prior), ...]


@operator("MINDIST", "imgproc", "pixels signatures", distance_type=("Euclidean", "Standardized"), max_distance=0.0)
def minimum_distance(px: DataFrame, signatures, distance_type, max_distance):
    """Class of the nearest mean; 0 beyond max_distance."""
    scores = []
    for label, mean, cov, *_ in signatures:
        sd = np.sqrt(np.maximum(np.diag(np.array(cov)), 1e-12)) if distance_type == "Standardized" else np.ones(len(mean))
        scores.append((label, F.sqrt(square_distance(scaled("a", np.zeros(len(sd)), sd), np.array(mean) / sd))))
    best = least(scores)
    return px.select(*KEY, F.when(F.lit(max_distance <= 0) | (best["d"] <= max_distance), best["label"]).otherwise(0).cast("double").alias("v"))


def _quadratic(signatures):
    return [(s[0], np.array(s[1], float), np.linalg.pinv(np.array(s[2], float)), np.linalg.slogdet(np.array(s[2], float) + 1e-12 * np.eye(len(s[1])))[1]) for s in signatures]


@operator("MAHALCLASS", "imgproc", "pixels signatures")
def mahalanobis_class(px: DataFrame, signatures):
    model, labels = _quadratic(signatures), np.array([float(s[0]) for s in signatures])

    def run(x):
        d = np.stack([np.einsum("ij,jk,ik->i", x - m, inv, x - m) for _, m, inv, _ in model], axis=1)
        return {"v": labels[d.argmin(axis=1)]}

    return by_batch(px, run, "v double")


def _log_likelihood(signatures, priors):
    model = _quadratic(signatures)
    return lambda x: np.stack([np.log(p) - 0.5 * logdet - 0.5 * np.einsum("ij,jk,ik->i", x - m, inv, x - m) for (_, m, inv, logdet), p in zip(model, priors)], axis=1)


def _priors(signatures, from_file: bool):
    return [s[3] if from_file and len(s) > 3 else 1 / len(signatures) for s in signatures]


@operator("MAXLIKE", "imgproc", "pixels signatures", prior_probabilities=("Equal", "From signature file"))
def maximum_likelihood(px: DataFrame, signatures, prior_probabilities):
    score, labels = _log_likelihood(signatures, _priors(signatures, prior_probabilities != "Equal")), np.array([float(s[0]) for s in signatures])
    return by_batch(px, lambda x: {"v": labels[score(x).argmax(axis=1)]}, "v double")


@operator("BAYCLASS", "imgproc", "pixels signatures")
def bayes_class(px: DataFrame, signatures):
    """posterior (an array by class) and uncertainty 1 - (max - 1/n) / (1 - 1/n)."""
    score, n = _log_likelihood(signatures, _priors(signatures, True)), len(signatures)

    def run(x):
        s = score(x)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return {"posterior": p.tolist(), "uncertainty": 1 - (p.max(axis=1) - 1 / n) / (1 - 1 / n) if n > 1 else np.zeros(len(p))}

    return by_batch(px, run, "posterior array<double>, uncertainty double")


@operator("BELCLASS", "imgproc", "pixels signatures")
def belief_class(px: DataFrame, signatures):
    """belief and plausibility by class, and ignorance: likelihoods committed as far as their entropy is low."""
    score, n = _log_likelihood(signatures, _priors(signatures, False)), len(signatures)

    def run(x):
        s = score(x)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        h = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1) / math.log(max(n, 2))
        b = p * (1 - h)[:, None]
        return {"belief": b.tolist(), "plausibility": (b + h[:, None]).tolist(), "ignorance": h}

    return by_batch(px, run, "belief array<double>, plausibility array<double>, ignorance double")


@operator("FUZCLASS", "imgproc", "pixels signatures")
def fuzzy_class(px: DataFrame, signatures):
    """membership by class: 1 - z / 1.96 of the root mean squared z-score, normalised; and what is left uncertain."""

    def run(x):
        z = np.stack([np.sqrt(np.mean(((x - np.array(m)) / np.sqrt(np.maximum(np.diag(np.array(c)), 1e-12))) ** 2, axis=1)) for _, m, c, *_ in signatures], axis=1)
        raw = np.maximum(0, 1 - z / 1.96)
        s = raw.sum(axis=1, keepdims=True)
        return {"membership": np.divide(raw, s, out=np.zeros_like(raw), where=s > 0).tolist(), "uncertainty": 1 - raw.max(axis=1)}

    return by_batch(px, run, "membership array<double>, uncertainty double")


@operator("FISHER", "imgproc", "pixels signatures")
def fisher(px: DataFrame, signatures):
    """Nearest class mean along the discriminant axes of pooled signatures."""
    means, within = np.array([s[1] for s in signatures], float), sum(np.array(s[2], float) for s in signatures) / len(signatures)
    centre = means.mean(axis=0)
    between = sum(np.outer(m - centre, m - centre) for m in means)
    values, vectors = np.linalg.eig(np.linalg.pinv(within + 1e-9 * np.eye(len(within))) @ between)
    axes = np.real(vectors[:, np.argsort(-np.real(values))[: max(1, min(len(means) - 1, means.shape[1]))]])
    labels, spots = np.array([float(s[0]) for s in signatures]), means @ axes
    return by_batch(px, lambda x: {"v": labels[((x @ axes)[:, None, :] - spots[None]).__pow__(2).sum(axis=2).argmin(axis=1)]}, "v double")


@operator("PIPED", "imgproc", "pixels boxes", overlap_mode=("Unclassified", "Nearest centroid"))
def parallelepiped(px: DataFrame, boxes, overlap_mode):
    """boxes: (class, lows, highs); several boxes: 0, or the one with the nearest centre."""
    inside = [F.forall(F.zip_with("a", F.arrays_zip(lit_array(lo).alias("lo"), lit_array(hi).alias("hi")), lambda x, b: (x >= b["lo"]) & (x <= b["hi"])), lambda ok: ok) for _, lo, hi in boxes]
    hits = sum((i.cast("int") for i in inside), F.lit(0))
    best = least([(c, F.when(i, square_distance(F.col("a"), (np.array(lo) + np.array(hi)) / 2)).otherwise(float("inf"))) for i, (c, lo, hi) in zip(inside, boxes)])
    one = F.when(hits == 0, 0).when((hits == 1) | F.lit(overlap_mode == "Nearest centroid"), best["label"]).otherwise(0)
    return px.select(*KEY, one.cast("double").alias("v"))


@operator("SEPSIG", "imgproc", "signatures")
def separability(signatures):
    """(class, class, Bhattacharyya, Jeffries-Matusita) of all pairs of signatures, as a list."""
    out = []
    for i, (a, m1, c1, *_) in enumerate(signatures):
        for b, m2, c2, *_ in signatures[i + 1 :]:
            c1, c2, d = np.array(c1, float), np.array(c2, float), np.array(m1, float) - np.array(m2, float)
            mid = (c1 + c2) / 2
            bh = float(d @ np.linalg.pinv(mid) @ d / 8 + 0.5 * (np.linalg.slogdet(mid)[1] - 0.5 * (np.linalg.slogdet(c1)[1] + np.linalg.slogdet(c2)[1])))
            out.append((a, b, bh, 2 * (1 - math.exp(-bh))))
    return out


@operator("SIGCOMP", "imgproc", "signatures1 signatures2")
def compare_signatures(s1, s2):
    """(class, class, Euclidean distance, divergence, transformed divergence) between two sets, as a list."""
    out = []
    for a, m1, c1, *_ in s1:
        for b, m2, c2, *_ in s2:
            c1, c2, d = np.array(c1, float), np.array(c2, float), np.array(m1, float) - np.array(m2, float)
            i1, i2 = np.linalg.pinv(c1), np.linalg.pinv(c2)
            div = float(0.5 * np.trace((c1 - c2) @ (i2 - i1)) + 0.5 * np.trace((i1 + i2) @ np.outer(d, d)))
            out.append((a, b, float(np.linalg.norm(d)), div, 2000 * (1 - math.exp(-div / 8))))
    return out


# Spectra against endmembers: [(number, values), ...]


@operator("HYPERMIN", "imgproc", "pixels endmembers")
def nearest_endmember(px: DataFrame, endmembers):
    best = least([(k, square_distance(F.col("a"), e)) for k, e in endmembers])
    return px.select(*KEY, best["label"].cast("double").alias("v"), F.sqrt(best["d"]).alias("distance"))


def _angle(e) -> Column:
    norm = math.sqrt(float(np.dot(e, e)))
    size = F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(F.col("a"), e) / (size * norm))))).otherwise(math.pi / 2)


@operator("HYPERSAM", "imgproc", "pixels endmembers", threshold_angle=0.1)
def spectral_angle(px: DataFrame, endmembers, threshold_angle):
    """Number of the endmember of the least angle, 0 above the threshold."""
    best = least([(k, _angle(e)) for k, e in endmembers])
    return px.select(*KEY, F.when(best["d"] <= threshold_angle, best["label"]).otherwise(0).cast("double").alias("v"), best["d"].alias("angle"))


@operator("ENDSIG", "imgproc", "endmembers")
def endmember_pairs(endmembers):
    """(i, j, spectral angle, spectral information divergence) of all pairs, as a list."""
    out = []
    for i, (a, x) in enumerate(endmembers):
        for b, y in endmembers[i + 1 :]:
            x_, y_ = np.array(x, float), np.array(y, float)
            p, q = (np.maximum(v, 1e-10) / np.maximum(v, 1e-10).sum() for v in (x_, y_))
            cos = float(x_ @ y_ / np.sqrt((x_ @ x_) * (y_ @ y_)))
            out.append((a, b, math.acos(max(-1.0, min(1.0, cos))), float((p * np.log(p / q)).sum() + (q * np.log(q / p)).sum())))
    return out


@operator("UNMIX", "imgproc", "pixels endmembers")
def unmix(px: DataFrame, endmembers):
    """fractions (least squares, negatives to zero, sum one) and the residual root mean square."""
    e = np.array([v for _, v in endmembers], float).T
    inverse = np.linalg.pinv(e)
    raw = F.array(*(F.greatest(F.lit(0.0), dot(F.col("a"), row)) for row in inverse))
    s = F.aggregate("f", F.lit(0.0), lambda t, x: t + x)
    t = px.withColumn("f", raw).withColumn("f", F.when(s > 0, F.transform("f", lambda x: x / s)).otherwise(F.col("f")))
    fit = F.array(*(dot(F.col("f"), row) for row in e))
    return t.select(*KEY, F.col("f").alias("fractions"), F.sqrt(F.aggregate(F.zip_with("a", fit, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda u, x: u + x) / len(e)).alias("residual"))


@operator("HYPERUNMIX", "imgproc", "pixels endmembers")
def unmix_constrained(px: DataFrame, endmembers):
    """Fractions that are not negative and sum to one: least squares on what stays positive, again until all are."""
    e = np.array([v for _, v in endmembers], float).T

    def run(x):
        out = np.zeros((len(x), e.shape[1]))
        for r, y in enumerate(x):
            use = np.ones(e.shape[1], bool)
            while use.any():
                f, g = np.linalg.lstsq(e[:, use], y, rcond=None)[0], np.linalg.pinv(e[:, use].T @ e[:, use]).sum(axis=1)
                f = f + g * (1 - f.sum()) / g.sum()
                if (f >= 0).all():
                    out[r, use] = f
                    break
                keep = np.flatnonzero(use)
                use[keep[f < 0]] = False
        return {"fractions": out.tolist(), "residual": np.sqrt(((x - out @ e.T) ** 2).mean(axis=1))}

    return by_batch(px, run, "fractions array<double>, residual double")


@operator("HYPERUSP", "imgproc", "pixels target")
def matched_filter(px: DataFrame, target):
    n = width(px)
    _, mean, cov = moments(px, n)
    d = np.array(target, float) - mean
    w = np.linalg.pinv(cov) @ d
    w = w / (d @ w)
    return px.select(*KEY, (dot(F.col("a"), w) - float(w @ mean)).alias("v"))


@operator("HYPEROSP", "imgproc", "pixels target background")
def orthogonal_subspace(px: DataFrame, target, background):
    u = np.array([v for _, v in background], float).T
    q = (np.eye(len(u)) - u @ np.linalg.pinv(u)) @ np.array(target, float)
    return px.select(*KEY, dot(F.col("a"), q).alias("v"))


@operator("HYPERABSORB", "imgproc", "pixels wavelengths", absorption_center=2.2)
def absorption(px: DataFrame, wavelengths, absorption_center):
    """depth at the band nearest the centre below the upper hull, and the full width at half depth."""
    w = np.array(wavelengths, float)
    at = int(np.abs(w - absorption_center).argmin())

    def one(y):
        hull = [0]
        while hull[-1] < len(w) - 1:
            k = hull[-1]
            hull.append(k + 1 + int(((y[k + 1 :] - y[k]) / (w[k + 1 :] - w[k])).argmax()))
        top = np.interp(w, w[hull], y[hull])
        rel = np.where(np.abs(top) > 1e-15, 1 - y / np.where(np.abs(top) > 1e-15, top, 1.0), 0.0)
        depth, half, ends = max(0.0, float(rel[at])), float(rel[at]) / 2, []
        for step in (-1, 1):
            k = at
            while 0 <= k + step < len(w) and rel[k + step] > half:
                k += step
            j = k + step
            ends.append(w[k] + (w[j] - w[k]) * (rel[k] - half) / (rel[k] - rel[j]) if 0 <= j < len(w) and rel[k] != rel[j] else w[k])
        return depth, float(ends[1] - ends[0]) if depth > 0 else 0.0

    def run(x):
        rows = [one(y) for y in x]
        return {"depth": [r[0] for r in rows], "width": [r[1] for r in rows]}

    return by_batch(px, run, "depth double, width double")


@operator("HYPERAUTOSIG", "imgproc", "pixels", num_endmembers=5, projections=500, candidates=0, seed=42)
def auto_endmembers(px: DataFrame, num_endmembers, projections, candidates, seed):
    """Endmembers [(number, values)]: pixels that are extreme in most random projections, then those that span the largest volume.

    Extremes of all projections come from one pass; of these, the `candidates` (by default 20 for each
    endmember) that are extreme most often are tried.
    """
    n = width(px)
    rng = np.random.default_rng(seed)
    axes = rng.normal(size=(projections, n))
    axes /= np.linalg.norm(axes, axis=1, keepdims=True)

    def run(batches):
        best = [[(np.inf, None)] * projections, [(-np.inf, None)] * projections]
        for b in batches:
            x = np.array(b.column("a").to_pylist(), float).reshape(-1, n)
            if len(x):
                p = x @ axes.T
                for way, pick in ((0, p.argmin(axis=0)), (1, p.argmax(axis=0))):
                    for k, r in enumerate(pick):
                        v = p[r, k]
                        if (v < best[0][k][0]) if way == 0 else (v > best[1][k][0]):
                            best[way][k] = (v, x[r].tolist())
        rows = [(k, way, float(v), a) for way in (0, 1) for k, (v, a) in enumerate(best[way]) if a is not None]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in map(list, zip(*rows))], ["k", "way", "v", "a"])

    ends = px.select("a").mapInArrow(run, "k long, way long, v double, a array<double>")
    top = ends.groupBy("k", "way").agg(F.when(F.col("way") == 0, F.min_by("a", "v")).otherwise(F.max_by("a", "v")).alias("a"))
    votes = top.groupBy("a").count().orderBy(F.desc("count"), "a").limit(candidates or 20 * num_endmembers).collect()
    c = np.array([r.a for r in votes], float)
    if not len(c):
        return []
    centre = c - c.mean(axis=0)
    low = centre @ np.linalg.svd(centre, full_matrices=False)[2][: max(1, num_endmembers - 1)].T
    chosen = list(range(min(num_endmembers, len(c))))
    volume = lambda ids: abs(np.linalg.det(np.vstack([np.ones(len(ids)), low[ids].T[: len(ids) - 1]])))
    better = True
    while better:
        better = False
        for slot in range(len(chosen)):
            for k in range(len(c)):
                trial = chosen[:slot] + [k] + chosen[slot + 1 :]
                if len(set(trial)) == len(trial) and volume(trial) > volume(chosen) * (1 + 1e-9):
                    chosen, better = trial, True
    return [(k + 1, c[i].tolist()) for k, i in enumerate(chosen)]


# Clusters


def nearest(centers: np.ndarray) -> Column:
    """The number of the nearest centre, the first of ties: plain arithmetic over the bands, so that it is compiled."""
    scores = [sum(((F.col("a")[i] - float(x)) * (F.col("a")[i] - float(x)) for i, x in enumerate(c)), F.lit(0.0)) for c in centers]
    return F.array_min(F.array(*(F.struct(s.alias("d"), F.lit(k).alias("k")) for k, s in enumerate(scores))))["k"]


def center_sums(px: DataFrame, centers: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(center, count, sums, sums of squares) of the pixels nearest to each, by one aggregation."""
    bands = [F.col("a")[i] for i in range(centers.shape[1])]
    sums = [F.count("*").alias("n"), *(F.sum(b).alias(f"s{i}") for i, b in enumerate(bands)), *(F.sum(b * b).alias(f"q{i}") for i, b in enumerate(bands))]
    rows = px.select(nearest(centers).alias("k"), "a").groupBy("k").agg(*sums).orderBy("k").collect()
    return [(r["k"], r["n"], *(np.array([r[f"{c}{i}"] for i in range(len(bands))]) for c in "sq")) for r in rows]


def lloyd(px: DataFrame, centers: np.ndarray, rounds: int) -> np.ndarray:
    """K-means from given centres; centres without pixels stay."""
    px = written(px.select("a"))
    for _ in range(rounds):
        new = centers.copy()
        for k, n, s, _ in center_sums(px, centers):
            new[k] = s / n
        if np.allclose(new, centers, atol=1e-9):
            break
        centers = new
    return centers


def assign(px: DataFrame, centers: np.ndarray) -> DataFrame:
    return px.select(*KEY, (nearest(centers) + 1).cast("double").alias("v"))


@operator("CLUSTER", "imgproc", "pixels", num_clusters=10, max_iterations=50, method=("K-Means", "ISODATA"))
def cluster(px: DataFrame, num_clusters, max_iterations, method):
    """K-means whose first centres lie evenly between the bands' least and largest values; either method name runs it."""
    n = width(px)
    r = px.agg(F.array(*(F.min(F.col("a")[k]) for k in range(n))).alias("lo"), F.array(*(F.max(F.col("a")[k]) for k in range(n))).alias("hi")).head()
    part = (np.arange(num_clusters) + 0.5)[:, None] / num_clusters
    return assign(px, lloyd(px, np.array(r.lo) + part * (np.array(r.hi) - np.array(r.lo)), max_iterations))


@operator("KMEANS", "imgproc", "pixels", num_classes=10, max_iterations=50, seed=42)
def kmeans(px: DataFrame, num_classes, max_iterations, seed):
    """K-means from distinct pixels of the least seeded hashes."""
    first = px.groupBy("a").agg(F.min(F.xxhash64("row", "col", F.lit(seed))).alias("h")).orderBy("h", "a").limit(num_classes).collect()
    return assign(px, lloyd(px, np.array([r.a for r in first], float), max_iterations))


def _isodata(px, k, rounds, merge_distance, split_sd, least_members):
    n, px = width(px), written(px)
    first = px.groupBy("a").agg(F.min(F.xxhash64("row", "col")).alias("h")).orderBy("h", "a").limit(k).collect()
    centers = np.array([r.a for r in first], float)
    for _ in range(rounds):
        rows = [(n, s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))) for _, n, s, q in center_sums(px, centers)]
        kept = [r for r in rows if r[0] >= least_members] or rows[:1]
        while len(kept) > 1:  # merge the closest pair while it is close
            d, i, j = min((float(np.linalg.norm(a[1] - b[1])), i, j) for i, a in enumerate(kept) for j, b in enumerate(kept) if i < j)
            if d >= merge_distance:
                break
            (na, ma, sa), (nb, mb, sb) = kept[i], kept[j]
            kept = [x for q, x in enumerate(kept) if q not in (i, j)] + [(na + nb, (na * ma + nb * mb) / (na + nb), np.maximum(sa, sb))]
        out = []
        for c, m, s in kept:
            wide = np.flatnonzero(s > split_sd)
            if len(wide) and c >= 2 * least_members:
                step = np.zeros(n)
                step[wide[0]] = 0.5 * s[wide[0]]
                out += [m - step, m + step]
            else:
                out.append(m)
        new = np.array(out)
        if new.shape == centers.shape and np.allclose(new, centers, atol=1e-9):
            break
        centers = new
    return assign(px, centers)


@operator("ISODATA", "imgproc", "pixels", initial_classes=10, max_iterations=20, min_samples=10, max_merge_distance=5.0, max_stddev=10.0)
def isodata(px, initial_classes, max_iterations, min_samples, max_merge_distance, max_stddev):
    return _isodata(px, initial_classes, max_iterations, max_merge_distance, max_stddev, min_samples)


@operator("ISOCLUST", "imgproc", "pixels", num_classes=10, max_iterations=20, merge_distance=5.0, split_stddev=10.0, min_members=10)
def isoclust(px, num_classes, max_iterations, merge_distance, split_stddev, min_members):
    return _isodata(px, num_classes, max_iterations, merge_distance, split_stddev, min_members)


@operator("CHAINCLUSTER", "imgproc", "pixels", distance_threshold=10.0, max_clusters=50)
def leader_clusters(px: DataFrame, distance_threshold, max_clusters):
    """Leaders, then the nearest: centres come from leaders of each partition's leaders, in cell order within them."""

    def lead(batches):
        heads: list[np.ndarray] = []
        for b in batches:
            for a in b.column("a").to_pylist():
                x = np.array(a, float)
                if len(heads) < max_clusters and all(np.linalg.norm(x - h) > distance_threshold for h in heads):
                    heads.append(x)
        if heads:
            yield pa.RecordBatch.from_arrays([pa.array([h.tolist() for h in heads])], ["a"])

    found = px.select("a").sortWithinPartitions("a").mapInArrow(lead, "a array<double>").distinct().orderBy("a").coalesce(1).mapInArrow(lead, "a array<double>").collect()
    return assign(px, np.array([r.a for r in found], float)) if found else px.select(*KEY, F.lit(-1.0).alias("v"))


# Supervised


def _sampled(t: DataFrame, most: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` training pixels, those of the least seeded hashes, in order of their cells."""
    rows = t.orderBy(F.xxhash64("row", "col", F.lit(seed)), *KEY).limit(most).select(*KEY, "a", "label").collect()
    rows.sort(key=lambda r: (r.row, r.col))
    return np.array([r.a for r in rows], float), np.array([r.label for r in rows], int)


@operator("KNN", "imgproc", "pixels labels", k=5)
def knn(px: DataFrame, labels: DataFrame, k):
    """Majority of the k nearest of all labelled pixels (equally near ones by cell); ties to the class of the nearest of them."""
    px = written(px)
    t = written(training(px, labels).select(*KEY, "a", F.col("label").alias("v")))
    if not t.head(1):
        return px.select(*KEY, F.lit(None).cast("double").alias("v"))
    votes = F.transform("best", lambda b, i: F.struct(F.size(F.filter("best", lambda c: c["v"] == b["v"])).alias("n"), (-i).alias("first"), b["v"].alias("label")))
    return nearest_rows(px, t, k, squares=True).select(*KEY, F.array_max(votes)["label"].alias("v"))


@operator("KNNREGRESS", "gis", "dependent independent samples", k=5)
def knn_regression(y: Grid, xs: list[Grid], samples: Grid, k):
    """Inverse-distance mean of the k nearest sample cells; an exact match gives its value; ties go by cell. Every sample cell counts; see nearness.nearest_rows."""
    px = written(pixels(xs))
    t = written(px.join(y.valid(), KEY).join(samples.valid().where("v <> 0").select(*KEY), KEY).select(*KEY, "a", "v"))
    if not t.head(1):
        return px.select(*KEY, F.lit(None).cast("double").alias("v"))
    weight = F.aggregate("best", F.lit(0.0), lambda s, x: s + 1 / F.greatest(x["d"], F.lit(1e-12)))
    value = F.aggregate("best", F.lit(0.0), lambda s, x: s + x["v"] / F.greatest(x["d"], F.lit(1e-12)))
    return nearest_rows(px, t, k).select(*KEY, F.when(F.col("best")[0]["d"] < 1e-10, F.col("best")[0]["v"]).otherwise(value / weight).alias("v"))


def _ml_frame(px: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return px.withColumn("features", array_to_vector("a"))


def _ml_class(px: DataFrame, labels: DataFrame, estimator) -> DataFrame:
    px = written(px)
    t = training(px, labels)
    names = [r.label for r in t.select("label").distinct().orderBy("label").collect()]
    index = F.create_map(*(F.lit(x) for k, c in enumerate(names) for x in (c, float(k))))
    fitted = written(t.select("a", F.element_at(index, F.col("label")).alias("label")))
    model = estimator(len(names)).fit(_ml_frame(fitted).select("features", "label"))
    back = F.array(*(F.lit(float(c)) for c in names))
    return model.transform(_ml_frame(px)).select(*KEY, F.element_at(back, (F.col("prediction") + 1).cast("int")).alias("v"))


@operator("CTA", "imgproc", "pixels labels", max_depth=10, min_samples=5)
def tree(px, labels, max_depth, min_samples):
    from pyspark.ml.classification import DecisionTreeClassifier

    return _ml_class(px, labels, lambda n: DecisionTreeClassifier(impurity="gini", maxDepth=max_depth, minInstancesPerNode=max(1, min_samples // 2), maxBins=256, seed=42))


@operator("DECISIONFOREST", "imgproc", "pixels labels", num_trees=50, max_depth=10)
def forest(px, labels, num_trees, max_depth):
    from pyspark.ml.classification import RandomForestClassifier

    return _ml_class(px, labels, lambda n: RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, featureSubsetStrategy="sqrt", seed=42))


@operator("SVM", "imgproc", "pixels labels", C_param=1.0, max_iterations=100)
def svm(px, labels, C_param, max_iterations):
    from pyspark.ml.classification import LinearSVC, OneVsRest

    return _ml_class(px, labels, lambda n: OneVsRest(classifier=LinearSVC(regParam=1 / (C_param * 1000), maxIter=max_iterations, standardization=True)))


@operator("MULTILOGISTICREG", "imgproc", "pixels labels", max_iterations=50)
def multinomial_logistic(px, labels, max_iterations):
    from pyspark.ml.classification import LogisticRegression, OneVsRest

    return _ml_class(px, labels, lambda n: OneVsRest(classifier=LogisticRegression(regParam=1e-6, maxIter=max_iterations)))


@operator("MLP", "imgproc", "pixels labels", hidden_nodes=20, max_epochs=500, learning_rate=0.03, solver=("l-bfgs", "gd"))
def perceptron(px, labels, hidden_nodes, max_epochs, learning_rate, solver):
    """One hidden layer over bands scaled to 0..1. The learning rate is that of gradient descent; l-bfgs finds its own steps."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    n = width(px)
    r = px.agg(F.array(*(F.min(F.col("a")[k]) for k in range(n))).alias("lo"), F.array(*(F.max(F.col("a")[k]) for k in range(n))).alias("hi")).head()
    lo, span = np.array(r.lo), np.maximum(np.array(r.hi) - np.array(r.lo), 1e-12)
    unit = px.withColumn("a", scaled("a", lo, span))
    return _ml_class(unit, labels, lambda c: MultilayerPerceptronClassifier(layers=[n, hidden_nodes, max(c, 2)], maxIter=max_epochs, stepSize=learning_rate, solver=solver, seed=42))


@operator("RBFNN", "imgproc", "pixels labels", num_centers=50, training_rows=TRAINING_ROWS)
def radial_basis(px, labels, num_centers, training_rows):
    """K-means centres of training pixels, Gaussian units as wide as the distance to the next centre, ridge least squares."""
    t = training(px, labels)
    first = t.groupBy("a").agg(F.min(F.xxhash64("row", "col")).alias("h")).orderBy("h", "a").limit(num_centers).collect()
    centers = lloyd(t, np.array([r.a for r in first], float), 20)
    d = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2)) + np.diag(np.full(len(centers), np.inf))
    sigma = np.where(np.isfinite(d.min(axis=1)), np.maximum(d.min(axis=1), 1e-6), 1.0)
    unit = lambda x: np.exp(-((x[:, None] - centers[None]) ** 2).sum(axis=2) / (2 * sigma**2))
    x, y = _sampled(t, training_rows)
    names = np.unique(y)
    h = unit(x)
    w = np.linalg.solve(h.T @ h + 1e-6 * np.eye(h.shape[1]), h.T @ (y[:, None] == names).astype(float))
    return by_batch(px, lambda q: {"v": names[(unit(q) @ w).argmax(axis=1)].astype(float)}, "v double")


@operator("SOM", "imgproc", "pixels labels", grid_width=10, grid_height=10, max_epochs=100, seed=42, training_rows=TRAINING_ROWS)
def self_organizing(px, labels, grid_width, grid_height, max_epochs, seed, training_rows):
    """A self-organising map over a bounded sample; neurons take their majority label, pixels their best neuron's."""
    x, y = _sampled(training(px, labels), training_rows, seed)
    rng = np.random.default_rng(seed)
    place = np.array([(i, j) for i in range(grid_height) for j in range(grid_width)], float)
    w = rng.uniform(x.min(axis=0), x.max(axis=0), (len(place), x.shape[1]))
    start = max(grid_width, grid_height) / 2
    for e in range(max_epochs):
        rate, radius = 0.5 * math.exp(-e / max_epochs), max(0.5, start * math.exp(-e / max(1.0, max_epochs / math.log(max(start, 1.1)))))
        for k in rng.permutation(len(x)):
            best = ((w - x[k]) ** 2).sum(axis=1).argmin()
            g = ((place - place[best]) ** 2).sum(axis=1)
            near = g <= 4 * radius**2
            w[near] += rate * np.exp(-g[near] / (2 * radius**2))[:, None] * (x[k] - w[near])
    hit = np.array([((w - v) ** 2).sum(axis=1).argmin() for v in x])
    label = np.full(len(w), -1)
    for k in range(len(w)):
        if (hit == k).any():
            label[k] = np.bincount(y[hit == k]).argmax()
    named = np.flatnonzero(label >= 0)
    for k in np.flatnonzero(label < 0):
        label[k] = label[named[((w[named] - w[k]) ** 2).sum(axis=1).argmin()]]
    return by_batch(px, lambda q: {"v": label[((q[:, None] - w[None]) ** 2).sum(axis=2).argmin(axis=1)].astype(float)}, "v double")


def _art(x: np.ndarray, y: np.ndarray, vigilance: float, rate: float, epochs: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Fuzzy ARTMAP nodes (weights, classes) from complement-coded samples."""
    w, c = np.empty((0, x.shape[1])), np.empty(0, int)
    for _ in range(epochs):
        for k in rng.permutation(len(x)) if epochs > 1 else range(len(x)):
            done = False
            if len(w):
                both = np.minimum(w, x[k]).sum(axis=1)
                for j in np.argsort(-both / (0.001 + w.sum(axis=1)), kind="stable"):
                    if c[j] == y[k] and both[j] / x[k].sum() >= vigilance:
                        w[j] = rate * np.minimum(w[j], x[k]) + (1 - rate) * w[j]
                        done = True
                        break
            if not done:
                w, c = np.vstack([w, x[k]]), np.append(c, y[k])
    return w, c


def _coded(px: DataFrame):
    n = width(px)
    r = px.agg(F.array(*(F.min(F.col("a")[k]) for k in range(n))).alias("lo"), F.array(*(F.max(F.col("a")[k]) for k in range(n))).alias("hi")).head()
    lo, span = np.array(r.lo), np.maximum(np.array(r.hi) - np.array(r.lo), 1e-12)
    return lambda x: np.hstack([np.clip((x - lo) / span, 0, 1), 1 - np.clip((x - lo) / span, 0, 1)])


@operator("FUZZYARTMAP", "imgproc", "pixels labels", vigilance=0.75, learning_rate=1.0, training_rows=TRAINING_ROWS)
def fuzzy_artmap(px, labels, vigilance, learning_rate, training_rows):
    code = _coded(px)
    x, y = _sampled(training(px, labels), training_rows)
    w, c = _art(code(x), y, vigilance, learning_rate, 1, np.random.default_rng(42))
    return by_batch(px, lambda q: {"v": c[np.stack([np.minimum(w, v).sum(axis=1) / (0.001 + w.sum(axis=1)) for v in code(q)]).argmax(axis=1)].astype(float)}, "v double")


@operator("FUZZY_ARTMAP2", "lcm", "pixels change", vigilance=0.75, training_rows=TRAINING_ROWS)
def artmap_potential(px, change, vigilance, training_rows):
    """Share of activation of change nodes above half the vigilance; labels are 1 (change) and 2 (none) of the change table's v."""
    code = _coded(px)
    x, y = _sampled(px.join(change.select(*KEY, F.when(F.col("v") != 0, 1).otherwise(2).alias("label")), KEY), training_rows)
    w, c = _art(code(x), y, vigilance, 1.0, 5, np.random.default_rng(42))

    def run(q):
        match = np.stack([np.minimum(w, v).sum(axis=1) / v.sum() for v in code(q)])
        match = np.where(match >= vigilance * 0.5, match, 0)
        total = match.sum(axis=1)
        return {"v": np.divide(match[:, c == 1].sum(axis=1), total, out=np.zeros(len(q)), where=total > 0)}

    return by_batch(px, run, "v double")


def logistic(t: DataFrame, n: int, rounds: int, ridge: float = 1e-6) -> np.ndarray:
    """Coefficients (intercept first) of label 0/1 on the array, by reweighted least squares: one aggregation a round."""
    t = written(t.select("a", "label"))
    beta, cols = np.zeros(n + 1), [F.lit(1.0), *(F.col("a")[k] for k in range(n))]
    for _ in range(rounds):
        eta = sum((c * float(b) for c, b in zip(cols, beta)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), eta))))
        s = t.withColumns({"p": p}).withColumn("w", F.col("p") * (1 - F.col("p")))
        r = s.agg(*(F.sum(F.col("w") * x * y).alias(f"h{i}_{j}") for i, x in enumerate(cols) for j, y in enumerate(cols) if j >= i), *(F.sum((F.col("label") - F.col("p")) * x).alias(f"g{i}") for i, x in enumerate(cols))).head()
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n + 1)] for i in range(n + 1)]) + ridge * np.eye(n + 1)
        step = np.linalg.solve(h, np.array([r[f"g{i}"] or 0.0 for i in range(n + 1)]))
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


@operator("LOGISTIC_REG", "lcm", "change drivers", max_iterations=20)
def logistic_potential(change: Grid, drivers: list[Grid], max_iterations):
    """Probability of change from standardised drivers."""
    px, n = pixels(drivers), len(drivers)
    _, mean, cov = moments(px, n)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    z = px.withColumn("a", scaled("a", mean, sd))
    beta = logistic(z.join(change.valid().select(*KEY, (F.col("v") != 0).cast("double").alias("label")), KEY), n, max_iterations)
    eta = dot(F.col("a"), beta[1:]) + float(beta[0])
    return change.with_cells(z.select(*KEY, (1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), eta))))).alias("v")))


@operator("TRANSITION_POTENTIAL", "lcm", "transitions drivers", method=("Logistic Regression", "Kernel similarity"), kernel_cells=200)
def transition_potential(transitions: list[Grid], drivers: list[Grid], method, kernel_cells):
    """The largest potential over transitions, each by logistic regression or by similarity to up to kernel_cells changed cells, those of the least hashes."""
    if method == "Logistic Regression":
        parts = [logistic_potential(t, drivers, 20) for t in transitions]
    else:
        px, parts = pixels(drivers), []
        for t in transitions:
            rows = px.join(t.valid().where("v <> 0").select(*KEY), KEY).orderBy(F.xxhash64("row", "col"), *KEY).limit(kernel_cells).collect()
            x = np.array([r.a for r in rows], float).reshape(-1, len(drivers))
            sim = by_batch(px, lambda q, x=x: {"v": np.exp(-0.001 * ((q[:, None] - x[None]) ** 2).sum(axis=2)).mean(axis=1) if len(x) else np.zeros(len(q))}, "v double")
            parts.append(t.with_cells(sim))
    t = align(parts)
    return parts[0].with_cells(t.select(*KEY, F.greatest(*(F.col(f"v{k}") for k in range(len(parts))), F.lit(0.0)).alias("v")))


@operator("PURIFY", "imgproc", "pixels labels", std_threshold=2.0, max_iterations=5, min_retain=0.5)
def purify(px: DataFrame, labels: DataFrame, std_threshold, max_iterations, min_retain):
    """row, col, v of training cells left after rounds that drop those beyond std_threshold sample deviations of their class in any band.

    In a round a class loses its outliers in row order, as long as min_retain of the cells that it began with stay; a
    class of fewer than three cells loses none, and a band without spread has no outliers.
    """
    n, t = width(px), written(training(px, labels))
    start = dict(t.groupBy("label").count().collect())
    for _ in range(max_iterations):
        s = t.groupBy("label").agg(F.count("*").alias("n"), F.array(*(F.avg(F.col("a")[k]) for k in range(n))).alias("m"), F.array(*(F.stddev_samp(F.col("a")[k]) for k in range(n))).alias("s"))
        far = F.exists(F.arrays_zip("a", "m", "s"), lambda x: (x["s"] >= 1e-10) & (F.abs(x["a"] - x["m"]) > x["s"] * std_threshold))
        marked = written(t.join(F.broadcast(s), "label").withColumn("far", far & (F.col("n") >= 3)).drop("m", "s"))
        counts = marked.groupBy("label").agg(F.count_if("far").alias("f"), F.count("*").alias("n")).where("f > 0").collect()
        # The j-th to go (from 0) leaves n - j - 1 of the class.
        may = {r["label"]: sum((r["n"] - j - 1) / start[r["label"]] >= min_retain for j in range(r["f"])) for r in counts}
        gone = None
        for r in counts:
            own = marked.where("far").where(F.col("label") == r["label"]).select(*KEY)
            if may[r["label"]] < r["f"]:
                own = _first_cells(own, may[r["label"]])
            gone = own if gone is None else gone.unionByName(own)
        if gone is None or not any(may.values()):
            break
        new = written(t.join(gone, KEY, "left_anti"))
        discard(t, marked)
        t = new
    return t.select(*KEY, F.col("label").cast("double").alias("v"))


def _first_cells(cells: DataFrame, n: int) -> DataFrame:
    """The first n cells in row order: whole rows by running counts, and the last one's by column."""
    rows = running_count(cells, F.col("row")).select(F.col("key").alias("row"), "before", F.col("n").alias("own")).where(F.col("before") < n)
    t = cells.join(F.broadcast(rows.where(F.col("before") + F.col("own") <= n).select("row")), "row", "left_semi")
    cut = rows.where(F.col("before") + F.col("own") > n).head()
    if cut is None:
        return t
    return t.unionByName(cells.where(F.col("row") == cut["row"]).orderBy("col").limit(n - cut["before"]))


@operator("SCREEN", "imgproc", "pixels", snr_threshold=10.0, correlation_threshold=0.5)
def screen(px: DataFrame, snr_threshold, correlation_threshold):
    """band, snr, correlation with its neighbours (the least) and ok."""
    n = width(px)
    _, mean, cov = moments(px, n)
    sd, out = np.sqrt(np.maximum(np.diag(cov), 0)), []
    for k in range(n):
        near = [cov[k, j] / (sd[k] * sd[j]) if sd[k] * sd[j] > 0 else 0.0 for j in (k - 1, k + 1) if 0 <= j < n]
        snr, c = (mean[k] / sd[k] if sd[k] > 0 else 0.0), min(near, default=1.0)
        out.append((k, float(snr), float(c), bool(abs(snr) >= snr_threshold and c >= correlation_threshold)))
    return px.sparkSession.createDataFrame(out, "band int, snr double, correlation double, ok boolean")


@operator("WEIGHT", "gis", "matrix")
def pairwise_weights(matrix):
    """Weights, largest eigenvalue and consistency ratio of a matrix of pairwise comparisons (fractions such as 1/3 may be text)."""
    from fractions import Fraction

    #: Random consistency indices for 1 to 15 criteria.
    ri = (0.0, 0.0, 0.58, 0.90, 1.12, 1.24, 1.32, 1.41, 1.45, 1.49, 1.51, 1.48, 1.56, 1.57, 1.59)
    m = np.array([[float(Fraction(str(x))) for x in row] for row in matrix])
    values, vectors = np.linalg.eig(m)
    k = int(np.real(values).argmax())
    w = np.abs(np.real(vectors[:, k]))
    n, top = len(m), float(np.real(values[k]))
    ci = (top - n) / (n - 1) if n > 1 else 0.0
    base = ri[min(n, len(ri)) - 1]
    return {"weights": (w / w.sum()).tolist(), "lambda_max": top, "ci": ci, "cr": ci / base if base > 0 else 0.0}


# Frequency domain; see spectral for transforms.


@operator("FILTFREQ", "imgproc", "magnitude", filter_type=("low_pass", "high_pass", "band_pass"), cutoff_frequency=30.0, order=2)
def filter_magnitude(grid: Grid, filter_type, cutoff_frequency, order):
    """A centred magnitude image times a Butterworth response."""
    d = F.sqrt(F.pow(F.col("row") - grid.rows / 2, 2) + F.pow(F.col("col") - grid.cols / 2, 2))
    low = 1 / (1 + F.pow(d / cutoff_frequency, F.lit(2.0 * order)))
    h = {"low_pass": low, "high_pass": 1 - low, "band_pass": 4 * low * (1 - low)}[filter_type]
    return grid.with_cells(grid.df.select(*KEY, (F.col("v") * h).alias("v")))


@operator("DRAWFILT", "imgproc", "reference", shape=("circle", "ring", "rectangle", "wedge"), center_x=0.5, center_y=0.5, radius1=0.25, radius2=0.5, pass_type=("pass", "reject"))
def draw_filter(grid: Grid, shape, center_x, center_y, radius1, radius2, pass_type):
    x, y = F.col("col") / grid.cols - center_x, F.col("row") / grid.rows - center_y
    d = F.sqrt(x * x + y * y)
    inside = {"circle": d <= radius1, "ring": (d >= radius1) & (d <= radius2), "rectangle": (F.abs(x) <= radius1) & (F.abs(y) <= radius2), "wedge": F.abs(F.atan2(y, x)) <= radius1 * math.pi}[shape]
    return grid.with_cells(grid.every_cell().select(*KEY, (inside if pass_type == "pass" else ~inside).cast("double").alias("v")))


@operator("FREQDIST", "imgproc", "magnitude1 magnitude2")
def frequency_distance(a: Grid, b: Grid):
    return align([a, b]).where("v0 is not null and v1 is not null").agg(F.sqrt(F.avg(F.pow(F.col("v0") - F.col("v1"), 2))).alias("rms"), F.corr("v0", "v1").alias("correlation"))


@operator("DESTRIPE", "imgproc", "input", direction=("horizontal", "vertical"))
def destripe(grid: Grid, direction):
    """Each line's mean and deviation become the whole grid's."""
    line = "row" if direction == "horizontal" else "col"
    s = grid.valid().groupBy(line).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    g = grid.valid().agg(F.avg("v").alias("gm"), F.stddev_pop("v").alias("gs"))
    t = grid.df.join(s, line, "left").crossJoin(F.broadcast(g))
    return grid.with_cells(t.select(*KEY, F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s") * F.col("gs") + F.col("gm")).when(F.col("v").isNotNull(), F.col("gm")).alias("v")))


@operator("CALIBRATE", "imgproc", "cells table")
def calibrate(cells: DataFrame, table: DataFrame):
    """row, col, band, v: offset + gain * v by band (table: band, offset, gain)."""
    return cells.join(table, "band").select(*KEY, "band", (F.col("offset") + F.col("gain") * F.col("v")).alias("v"))
