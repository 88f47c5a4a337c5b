"""The catalogue's cases: one block per family of operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import iterate, learn, regrid, series, zonal
from ..plans.grid import KEY, Grid
from ..plans.registry import create
from ..sources import files
from . import oracles
from .catalogue import SIZE, add, case, grid, local_case, with_grids

STATS = ", st AS (SELECT MIN(v) AS lo, MAX(v) AS hi, AVG(v) AS m, STDDEV_POP(v) AS sd, COUNT(v) AS n FROM {g})"


def R(e: str, name: str = "v") -> str:
    return f"ROUND(CAST({e} AS DOUBLE) + 0.0, 6) AS {name}"


def register() -> None:
    _flagship()
    _local()
    _zonal()
    _focal()
    _regrid()
    _series()
    _iterate()
    _learn()
    _files()
    oracles.register()


def _flagship() -> None:
    def run(spark, sf_dir):
        a, b, c = (grid(spark, sf_dir, g) for g in "abc")
        classes = create("RECLASS")(create("OVERLAY")(a, b, operation="Divide"), None, num_classes=4)
        return create("EXTRACT")(classes, c)

    sql = """, r AS (SELECT row, col, CASE WHEN b.v <> 0 THEN a.v / b.v END AS v FROM a JOIN b USING (row, col)), st AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM r),
    k AS (SELECT row, col, LEAST(4, FLOOR((v - lo) / ((hi - lo) / 4)) + 1) AS z FROM r, st WHERE v IS NOT NULL)
    SELECT CAST(z AS INT) AS zone, ROUND(AVG(c.v), 6) AS stat FROM k JOIN c USING (row, col) GROUP BY 1"""
    add("flagship_overlay_reclass_extract", run, with_grids("abc", sql))


def _local() -> None:
    L = local_case
    for op, e in (("Add", "av + 2.5"), ("Subtract", "av - 2.5"), ("Multiply", "av * 2.5"), ("Divide", "av / 2.5"), ("Power", "POWER(av, 2.5)"), ("Log", "CASE WHEN av > 0 THEN LN(av) / LN(2.5) END"), ("Sqrt", "SQRT(av)"), ("Abs", "ABS(av)")):
        L("SCALAR", "a", e, op.lower(), operation=op, scalar=2.5)
    L("SCALAR", "p", "EXP(pv * 2.5)", "exp", operation="Exp", scalar=2.5)
    both = "CASE WHEN av IS NOT NULL AND bv IS NOT NULL THEN {} END"
    for op, e in (("Add", "av + bv"), ("Subtract", "av - bv"), ("Multiply", "av * bv"), ("Divide", "CASE WHEN bv <> 0 THEN av / bv END"), ("Maximum", both.format("GREATEST(av, bv)")), ("Minimum", both.format("LEAST(av, bv)")), ("Average", "(av + bv) / 2"), ("Cover", "COALESCE(CASE WHEN bv <> 0 THEN bv END, av)")):
        L("OVERLAY", "ab", e, op.lower(), operation=op)
    L("IMAGEDIFF", "ab", "bv - av")
    L("IMAGEDIFF", "ab", "CASE WHEN bv - av IS NOT NULL THEN CASE WHEN ABS(bv - av) > 600 THEN 1 ELSE 0 END END", "flag", threshold=600.0)
    L("IMAGERATIO", "ab", "CASE WHEN ABS(bv) >= 1e-15 THEN av / bv END")
    for op, e in (("AND", "LEAST(pv, qv)"), ("OR", "GREATEST(pv, qv)"), ("XOR", "pv + qv - 2 * LEAST(pv, qv)"), ("NOT", "1 - pv")):
        L("LOGIC", "pq", e, op.lower(), operation=op)
    L("LOGICAND", "sc", "CASE WHEN sv <> 0 AND cv <> 0 THEN 1 ELSE 0 END")
    L("LOGICOR", "sf", "CASE WHEN sv <> 0 OR fv <> 0 THEN 1 ELSE 0 END")
    L("LOGICXOR", "sf", "CASE WHEN (sv <> 0) <> (fv <> 0) THEN 1 ELSE 0 END")
    L("LOGICNOT", "s", "CASE WHEN sv = 0 THEN 1 ELSE 0 END")
    L("HIGHLIGHT", "b", "CASE WHEN bv BETWEEN 100 AND 300 THEN 1 ELSE 0 END", min_val=100.0, max_val=300.0)
    t = "((pv - 0.2) / 0.6)"
    ramp = f"CASE WHEN pv <= 0.2 THEN 0 WHEN pv >= 0.8 THEN 1 ELSE {{}} END"
    for way, one in (("inc", "{}"), ("dec", "1 - ({})")):
        L("FUZZY", "p", one.format(ramp.format(f"POWER(SIN({t} * PI() / 2), 2)")), f"sigmoidal_{way}", function=f"sigmoidal-{way}", control_a=0.2, control_b=0.8)
        L("FUZZY", "p", one.format(ramp.format(t)), f"linear_{way}", function=f"linear-{way}", control_a=0.2, control_b=0.8)
    L("FUZZY", "p", f"CASE WHEN pv >= 0.8 THEN 1 ELSE 1 / (1 + ({t} - 1) * ({t} - 1)) END", "jshaped_inc", function="j-shaped-inc", control_a=0.2, control_b=0.8)
    L("FUZZY", "p", f"CASE WHEN pv <= 0.2 THEN 1 ELSE 1 / (1 + {t} * {t}) END", "jshaped_dec", function="j-shaped-dec", control_a=0.2, control_b=0.8)
    L("BAYES", "pqc", "CASE WHEN cv <> 0 THEN pv * qv / cv END")
    L("PCORBINARY", "p", "pv * 0.3 / 0.6 / (pv * 0.3 / 0.6 + (1 - pv) * 0.7 / 0.4)", prior_proportion=0.3, sample_prevalence=0.6)
    low, high = "LEAST(pv, qv)", "GREATEST(pv, qv)"
    norm = f"(1 - 2 * ({low}) * (1 - ({high})))"

    def belief(spark, sf_dir):
        p, q = grid(spark, sf_dir, "p"), grid(spark, sf_dir, "q")
        t = p.df.join(q.df.withColumnRenamed("v", "w"), KEY)
        lo, hi = (p.with_cells(t.select(*KEY, f("v", "w").alias("v"))) for f in (F.least, F.greatest))
        return create("BELIEF")([lo, hi, lo, hi])

    b = f"((2 * {low} * {high} - {low} * {low}) / {norm})"
    pl = f"({high} * {high} / {norm})"
    ok = f"CASE WHEN {norm} > 0 THEN {{}} END"
    add("belief", belief, with_grids("pq", f", x AS (SELECT row, col, p.v AS pv, q.v AS qv FROM p JOIN q USING (row, col)) SELECT row, col, {R(ok.format(b))}, {R(ok.format(pl), 'plausibility')}, {R(ok.format(f'{pl} - {b}'), 'interval')} FROM x"))
    L("BELCALC", "pq", "1 - (1 - pv) * (1 - qv)", as_list=True)
    L("MCE", "pqs", "(pv * 0.7 + qv * 0.3) * sv", "wlc", as_list=True, weights=(0.7, 0.3), constraints=1)
    L("MCE", "pqs", "pv * qv * sv", "boolean", as_list=True, constraints=1, method="Boolean")
    L("MCE", "pq", "2 * (LEAST(pv * 0.7, qv * 0.3) * 0.6 + GREATEST(pv * 0.7, qv * 0.3) * 0.4)", "owa", as_list=True, weights=(0.7, 0.3), order_weights=(0.6, 0.4), method="OWA")
    L("MDCHOICE", "pq", {"v": "CASE WHEN pv * 0.6 >= qv * 0.4 THEN 1 ELSE 2 END", "score": "GREATEST(pv * 0.6, qv * 0.4)"}, as_list=True, weights=(0.6, 0.4))
    L("CONSENSUS", "cdf", "CASE WHEN cv = dv AND dv = fv THEN cv END", "unanimous", as_list=True)
    L("CONSENSUS", "cdf", "CASE WHEN cv = dv OR cv = fv THEN cv WHEN dv = fv THEN dv END", "majority", as_list=True, method="majority")
    L("CONSENSUS", "cdf", "CASE WHEN cv = dv OR cv = fv THEN cv WHEN dv = fv THEN dv ELSE LEAST(cv, dv, fv) END", "plurality", as_list=True, method="plurality")
    L("HARDEN", "pq", "CASE WHEN GREATEST(pv, qv) < 0.5 THEN 0 WHEN pv >= qv THEN 1 ELSE 2 END", as_list=True, threshold=0.5)
    L("MAXSET", "pq", {"v": "CASE WHEN pv >= qv THEN 1 ELSE 2 END", "maxval": "GREATEST(pv, qv)"}, as_list=True)
    L("OVERLAP_USE", "sbf", "(CASE WHEN sv <> 0 THEN 1 ELSE 0 END) + (CASE WHEN bv <> 0 THEN 1 ELSE 0 END) + (CASE WHEN fv <> 0 THEN 1 ELSE 0 END)", as_list=True)
    L("NDVICOMP", "bp", "CASE WHEN bv IS NULL THEN pv ELSE GREATEST(bv, pv) END", as_list=True)
    L("HABITAT_ASSESSMENT", "pq", "CASE WHEN pv * 0.4 + qv * 0.6 >= 0.3 THEN pv * 0.4 + qv * 0.6 ELSE 0 END", as_list=True, weights=(0.4, 0.6), threshold=0.3)
    L("PREDICTION", "pq", "CASE WHEN pv * 0.2 >= qv * 0.9 THEN 1 ELSE 2 END", as_list=True, column_means=(0.2, 0.9))
    L("PREDICTION", "pq", "GREATEST(pv, qv)", "soft", as_list=True, prediction_type="Soft")
    L("DECOMP", "ac", {"v": "av * COS(RADIANS(cv))", "y": "av * SIN(RADIANS(cv))"})
    turn = "(CASE WHEN DEGREES(ATAN2({0}, {1})) < 0 THEN DEGREES(ATAN2({0}, {1})) + 360 ELSE DEGREES(ATAN2({0}, {1})) END)"
    L("DECOMP", "ac", {"v": "SQRT(av * av + cv * cv)", "direction": turn.format("cv", "av")}, "recompose", mode="Recompose")
    x, y = "(pv * SIN(RADIANS(av)) + qv * SIN(RADIANS(cv)))", "(pv * COS(RADIANS(av)) + qv * COS(RADIANS(cv)))"
    L("RESULTANT", "paqc", {"v": f"SQRT({x} * {x} + {y} * {y})", "direction": f"CASE WHEN ABS({x}) + ABS({y}) = 0 THEN 0 ELSE {turn.format(x, y)} END"})
    L("CVA", "apbq", {"v": "SQRT((bv - av) * (bv - av) + (qv - pv) * (qv - pv))", "direction": turn.format("(qv - pv)", "(bv - av)")}, as_list=True)
    s = "((1000 / (cv * 15) - 10) * 25.4)"

    def runoff(spark, sf_dir):
        a, c = grid(spark, sf_dir, "a"), grid(spark, sf_dir, "c")
        return create("RUNOFF")(a, c.with_cells(c.df.withColumn("v", F.col("v") * 15)))

    add("runoff", runoff, with_grids("ac", f", x AS (SELECT row, col, a.v AS av, c.v AS cv FROM a JOIN c USING (row, col)) SELECT row, col, {R(f'CASE WHEN av > 0.2 * {s} THEN POWER(av - 0.2 * {s}, 2) / (av + 0.8 * {s}) ELSE 0 END')} FROM x"))
    L("RUSLE", "abcpq", "av * bv * cv * pv * qv")
    L("COASTAL_VULNERABILITY", "acdfpq", "SQRT(av * cv * dv * fv * pv * qv / 6)", as_list=True)
    L("WAVE_ENERGY", "pc", "1025 * 9.81 * 9.81 / (64 * PI()) * pv * pv * cv")
    L("NDVI", "ab", "(av - bv) / (av + bv)")
    L("SNOWINDEX", "ab", "(av - bv) / (av + bv)")
    L("WATERINDEX", "pq", "CASE WHEN ABS(pv + qv) >= 1e-10 THEN (pv - qv) / (pv + qv) ELSE 0 END")
    L("SOILSALINITY", "ab", "SQRT(av * bv)")
    L("SOIL_SALINITY", "pq", "CASE WHEN ABS(pv + qv) >= 1e-10 THEN (pv - qv) / (pv + qv) ELSE 0 END", "ndsi")
    L("SOIL_SALINITY", "pq", "SQRT(pv * qv)", "si1", index_type="si1")
    for n, e in (("SAVI", "(pv - qv) / (pv + qv + 0.5) * 1.5"), ("EVI", "CASE WHEN ABS(pv + 6 * qv - 7.5 * cv + 1) < 1e-10 THEN 0 ELSE 2.5 * (pv - qv) / (pv + 6 * qv - 7.5 * cv + 1) END"), ("MSAVI", "(2 * pv + 1 - SQRT(GREATEST(0, POWER(2 * pv + 1, 2) - 8 * (pv - qv)))) / 2"), ("GNDVI", "(pv - dv) / (pv + dv)"), ("NDWI", "(dv - pv) / (pv + dv)")):
        L("VEGINDEX", "pqcd", e, n.lower(), index_type=n)
    L("THERMAL", "a", "1260.56 / LN(607.76 / (av * 0.05 + 1.2) + 1)", gain=0.05, offset=1.2, k1=607.76, k2=1260.56)
    L("RADIANCE", "a", "av * 0.7 + 3", gain=0.7, offset=3.0)
    L("MODISQC", "a", "(CAST(av AS BIGINT) >> 2) & 3", start_bit=2, num_bits=2)
    w = "pv * 0.4 + qv * 1.6"
    norm = f"CASE WHEN {w} > 0 THEN {{}} / ({w}) ELSE {{}} END"
    L("PRIORCORRECT", "pq", {"v": norm.format("pv * 0.4", "pv * 0.4"), "class1": norm.format("pv * 0.4", "pv * 0.4"), "class2": norm.format("qv * 1.6", "qv * 1.6")}, as_list=True, priors=(0.2, 0.8))
    L("COLSPACE", "pqc", {"v": "CASE WHEN GREATEST(pv, qv, cv) - LEAST(pv, qv, cv) <= 1e-10 THEN 0 WHEN GREATEST(pv, qv, cv) = pv THEN 60 * FMOD((qv - cv) / (GREATEST(pv, qv, cv) - LEAST(pv, qv, cv)) + 6, 6) WHEN GREATEST(pv, qv, cv) = qv THEN 60 * ((cv - pv) / (GREATEST(pv, qv, cv) - LEAST(pv, qv, cv)) + 2) ELSE 60 * ((pv - qv) / (GREATEST(pv, qv, cv) - LEAST(pv, qv, cv)) + 4) END", "v2": "(GREATEST(pv, qv, cv) - LEAST(pv, qv, cv)) / GREATEST(pv, qv, cv)", "v3": "GREATEST(pv, qv, cv)"}, "rgb_to_hsv", direction="RGB_to_HSV")
    den = "SQRT((pv - qv) * (pv - qv) + (pv - cv) * (qv - cv))"
    th = f"DEGREES(ACOS(GREATEST(-1, LEAST(1, (2 * pv - qv - cv) / 2 / {den}))))"
    L("COLSPACE", "pqc", {"v": f"CASE WHEN {den} < 1e-10 THEN 0 WHEN cv <= qv THEN {th} ELSE 360 - {th} END", "v2": "1 - LEAST(pv, qv, cv) / ((pv + qv + cv) / 3)", "v3": "(pv + qv + cv) / 3"}, "rgb_to_hsi")
    L("TASSCAP", "abcdpq", {"v": "av * 0.3037 + bv * 0.2793 + cv * 0.4743 + dv * 0.5585 + pv * 0.5082 + qv * 0.1863", "greenness": "av * -0.2848 + bv * -0.2435 + cv * -0.5436 + dv * 0.7243 + pv * 0.0840 + qv * -0.1800", "wetness": "av * 0.1509 + bv * 0.1973 + cv * 0.3279 + dv * 0.3406 + pv * -0.7112 + qv * -0.4572"}, as_list=True)
    L("CONVERT", "a", "LEAST(255, GREATEST(0, ROUND(av)))", "byte", data_type="Byte")
    L("IDRISICONV", "p", "ROUND(pv)", data_type="Int16")
    L("NANFIX", "p", "pv")
    L("LINTOPNT", "s", "sv")
    L("SCENGEN", "ap", "av + pv", "additive")
    L("SCENGEN", "ap", "av * pv", "multiplicative", method="multiplicative")
    trap = lambda c, a, b, x, z: f"CASE WHEN {c} <= {a} OR {c} >= {z} THEN 0 WHEN {c} < {b} THEN ({c} - {a}) / ({b} - {a}) WHEN {c} <= {x} THEN 1 ELSE ({z} - {c}) / ({z} - {x}) END"
    L("ECOCROP", "ca", f"LEAST({trap('cv', 1.0, 2.5, 3.5, 5.0)}, {trap('av', 300.0, 500.0, 700.0, 900.0)})", crop=(1.0, 2.5, 3.5, 5.0, 300.0, 500.0, 700.0, 900.0))
    L("EDIT", "a", "CASE WHEN row = 3 AND col = 4 THEN 77 ELSE av END", row=3, col=4, new_value=77.0)
    case("update", "UPDATE", "aps", ", x AS (SELECT row, col, a.v AS av, p.v AS pv, s.v AS sv FROM a JOIN p USING (row, col) JOIN s USING (row, col)) SELECT row, col, CASE WHEN sv <> 0 THEN pv ELSE av END AS v FROM x")
    L("PIXELLOCATION", "a", "1000 + col * 10", "x")
    L("PIXELLOCATION", "a", "5000 - row * 10", "y", coordinate="Y")
    add("initial", lambda spark, d: create("INITIAL")(spark, rows=7, cols=9, value=1.5), "SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(1.5 AS DOUBLE) AS v FROM range(7) t(r), range(9) u(c)")
    case("random", "RANDOM", "b", None)
    case("stchoice", "STCHOICE", "cp", None, matrix=((1, 1, 0.5), (1, 2, 0.3), (1, 3, 0.2)))
    for op, col in (("ASSIGN", "id, value"), ("CARBON_STOCK", "class_id, carbon_tons_per_ha"), ("ECOSYSTEM_SERVICES", "class_id, value_per_ha")):
        k = 1 if op == "ASSIGN" else 0.01
        case(op.lower(), op, "c", f" SELECT row, col, {R(f'CASE WHEN v = 1 THEN 10 WHEN v = 2 THEN 25 WHEN v = 4 THEN 40 ELSE 0 END * {k}')} FROM c", lambda f, own, names=col: f(own[0], own[0].df.sparkSession.createDataFrame([(1, 10.0), (2, 25.0), (4, 40.0)], names.split(", "))))


def _zonal() -> None:
    pair = ", t AS (SELECT CAST(TRUNC(c.v) AS INT) AS c1, CAST(TRUNC(d.v) AS INT) AS c2, COUNT(*) AS n FROM c JOIN d USING (row, col) GROUP BY 1, 2)"
    case("area", "AREA", "c", " SELECT CAST(v AS INT) AS class, COUNT(*) AS cells, CAST(COUNT(*) * 100 AS DOUBLE) AS area FROM c GROUP BY 1")
    case("area_grid", "AREA", "c", " SELECT row, col, CAST(COUNT(*) OVER (PARTITION BY v) * 100 AS DOUBLE) AS v FROM c", lambda f, own: zonal.area_grid(own[0]))
    case("count", "COUNT", "c", f" SELECT CAST(v AS INT) AS class, COUNT(*) AS cells, {R('COUNT(*) / (SELECT COUNT(*) FROM c)', 'share')} FROM c GROUP BY 1")
    case("center", "CENTER", "c", f" SELECT CAST(v AS INT) AS class, {R('AVG(1000 + col * 10)', 'x')}, {R('AVG(5000 - row * 10)', 'y')}, COUNT(*) AS cells FROM c GROUP BY 1")
    for s, e in (("mean", "AVG(b.v)"), ("sum", "SUM(b.v)"), ("min", "MIN(b.v)"), ("max", "MAX(b.v)"), ("count", "COUNT(b.v)")):
        case(f"extract_{s}", "EXTRACT", "cb", f" SELECT CAST(c.v AS INT) AS zone, {R(e, 'stat')} FROM c JOIN b USING (row, col) WHERE b.v IS NOT NULL GROUP BY 1", statistic=s)
    case("crosstab", "CROSSTAB", "cd", pair + " SELECT c1, c2, n, CAST(ROW_NUMBER() OVER (ORDER BY c1, c2) AS INT) AS id FROM t")
    case("crosstab_stats", "CROSSTAB_STATS", "cd", pair + ", m AS (SELECT *, SUM(n) OVER (PARTITION BY c1) AS r, SUM(n) OVER (PARTITION BY c2) AS c, SUM(n) OVER () AS a FROM t), x AS (SELECT MAX(a) * (SUM(n * n / (r * c)) - 1) AS chi, MAX(a) AS a, LEAST(COUNT(DISTINCT c1), COUNT(DISTINCT c2)) - 1 AS k FROM m)" + f" SELECT {R('chi', 'chi_square')}, {R('SQRT(chi / a / k)', 'cramers_v')} FROM x")
    case("errmat", "ERRMAT", "cd", pair + f", n AS (SELECT CAST(SUM(n) AS BIGINT) AS n, SUM(CASE WHEN c1 = c2 THEN n ELSE 0 END) / SUM(n) AS po FROM t), e AS (SELECT SUM(r.n * k.n) AS rc FROM (SELECT c1 AS g, SUM(n) AS n FROM t GROUP BY 1) r JOIN (SELECT c2 AS g, SUM(n) AS n FROM t GROUP BY 1) k USING (g)) SELECT n AS cells, {R('po', 'overall')}, {R('(po - rc / n / n) / (1 - rc / n / n)', 'kappa')} FROM n, e")
    case("errmat_classes", "ERRMAT_CLASSES", "cd", pair + f" SELECT class, mapped, truth, {R('hits / truth', 'producer')}, {R('hits / mapped', 'user')} FROM (SELECT c1 AS class, CAST(SUM(n) AS BIGINT) AS mapped, SUM(CASE WHEN c1 = c2 THEN n ELSE 0 END) AS hits FROM t GROUP BY 1) JOIN (SELECT c2 AS class, CAST(SUM(n) AS BIGINT) AS truth FROM t GROUP BY 1) USING (class)")
    case("change_analysis", "CHANGE_ANALYSIS", "cd", pair + ", x AS (SELECT c1 AS class, n AS b, 0 AS a, CASE WHEN c1 = c2 THEN n ELSE 0 END AS k FROM t UNION ALL SELECT c2, 0, n, 0 FROM t), y AS (SELECT class, CAST(SUM(b) AS BIGINT) AS before, CAST(SUM(a) AS BIGINT) AS after, CAST(SUM(k) AS BIGINT) AS k FROM x GROUP BY 1) SELECT class, before, after, after - k AS gain, before - k AS loss, after - before AS net, k AS persistence FROM y")
    case("transition_codes", "CHANGE_ANALYSIS", "cd", " SELECT row, col, c.v * 100 + d.v AS v FROM c JOIN d USING (row, col)", lambda f, own: zonal.transition_codes(*own))
    p1 = pair + ", pr AS (SELECT a.g AS \"from\", b.g AS \"to\", COALESCE(t.n, 0) / (SELECT SUM(n) FROM t x WHERE x.c1 = a.g) AS p FROM (SELECT DISTINCT c1 AS g FROM t) a CROSS JOIN (SELECT DISTINCT c2 AS g FROM t) b LEFT JOIN t ON t.c1 = a.g AND t.c2 = b.g)"
    case("markov_chain", "MARKOV_CHAIN", "cd", p1 + f" SELECT x.\"from\", y.\"to\", {R('SUM(x.p * y.p)', 'p')} FROM pr x JOIN pr y ON x.\"to\" = y.\"from\" GROUP BY 1, 2", prediction_date=2)
    case("markov2", "MARKOV2", "cd", p1 + f" SELECT d.row, d.col, pr.\"to\", {R('pr.p', 'p')} FROM d JOIN pr ON pr.\"from\" = CAST(d.v AS INT)")
    n4 = ", e AS (SELECT a.row, a.col, a.v, (CASE WHEN b.v IS NULL OR b.v <> a.v THEN 1 ELSE 0 END) AS x FROM c a CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc) LEFT JOIN c b ON b.row = a.row + dr AND b.col = a.col + dc)"
    case("perim", "PERIM", "c", n4 + " SELECT CAST(v AS INT) AS class, CAST(COUNT(*) / 4 * 100 AS DOUBLE) AS area, CAST(SUM(x) * 10 AS DOUBLE) AS perimeter FROM e GROUP BY 1")
    case("quadrat", "QUADRAT", "s", f", h AS (SELECT q.r, q.c, COUNT(s.v) AS n FROM (SELECT r, c FROM range(5) t(r), range(5) u(c)) q LEFT JOIN s ON s.row // 10 = q.r AND s.col // 10 = q.c AND s.v <> 0 GROUP BY 1, 2) SELECT COUNT(*) AS quadrats, {R('AVG(n)', 'mean')}, {R('VAR_SAMP(n)', 'variance')}, {R('VAR_SAMP(n) / AVG(n)', 'vmr')} FROM h")
    case("makesig", "MAKESIG", "abc", f" SELECT CAST(c.v AS INT) AS class, COUNT(*) AS n, {R('AVG(a.v)', 'm0')}, {R('AVG(b.v)', 'm1')}, {R('VAR_POP(a.v)', 'c00')}, {R('COVAR_POP(a.v, b.v)', 'c01')}, {R('VAR_POP(b.v)', 'c11')} FROM a JOIN b USING (row, col) JOIN c USING (row, col) WHERE b.v IS NOT NULL GROUP BY 1", lambda f, own: f(own[:2], own[2]).select("class", "n", F.col("mean")[0].alias("m0"), F.col("mean")[1].alias("m1"), F.col("cov")[0].alias("c00"), F.col("cov")[1].alias("c01"), F.col("cov")[3].alias("c11")))
    prof = f", l AS (SELECT CAST(c.v AS INT) AS class, 0 AS band, a.v FROM a JOIN c USING (row, col) UNION ALL SELECT CAST(c.v AS INT), 1, b.v FROM b JOIN c USING (row, col) WHERE b.v IS NOT NULL) SELECT class, CAST(band AS INT) AS band, {R('AVG(v)', 'mean')}, {R('STDDEV_SAMP(v)', 'sd')}"
    case("hypersig", "HYPERSIG", "abc", prof + ", MIN(v) AS low, MAX(v) AS high FROM l GROUP BY 1, 2", lambda f, own: f(own[:2], own[2]))
    case("segtrain", "SEGTRAIN", "abc", prof + " FROM l GROUP BY 1, 2", lambda f, own: f(own[:2], own[2]))
    case("segclass", "SEGCLASS", "cd", ", n AS (SELECT c.v AS s, d.v AS k, COUNT(*) AS n FROM c JOIN d USING (row, col) GROUP BY 1, 2), m AS (SELECT s, k, ROW_NUMBER() OVER (PARTITION BY s ORDER BY n DESC, k) AS r FROM n) SELECT row, col, k AS v FROM c JOIN m ON m.s = c.v AND r = 1")
    case("stats", "STATS", "b", f" SELECT MIN(v) AS min, MAX(v) AS max, {R('AVG(v)', 'mean')}, {R('STDDEV_POP(v)', 'sd')}, COUNT(v) AS n FROM b")
    st = STATS.format(g="b")
    cells = " SELECT row, col, {} FROM b, st"
    case("normalize", "NORMALIZE", "b", st + cells.format(R("(v - lo) / (hi - lo)")))
    case("standard", "STANDARD", "b", st + cells.format(R("(v - m) / sd")))
    case("stretch_linear", "STRETCH", "b", st + cells.format(R("(v - lo) / (hi - lo) * 255")))
    case("stretch_saturated", "STRETCH", "b", st + cells.format(R("CASE WHEN v IS NOT NULL THEN GREATEST(0, LEAST(255, (v - m + 2 * sd) / (4 * sd) * 255)) END")), method="Saturated")
    case("stretch_equalized", "STRETCH", "b", f" SELECT x.row, x.col, CASE WHEN x.v IS NOT NULL THEN ROUND((r - 1 + (r + k - 1)) / (2 * n) * 255, 6) END AS v FROM (SELECT *, RANK() OVER (ORDER BY v NULLS LAST) AS r, COUNT(*) OVER (PARTITION BY v) AS k FROM b) x, (SELECT COUNT(v) AS n FROM b)", method="Histogram equalization")
    shown = lambda g: f", o{g} AS (SELECT v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS r, COUNT(*) OVER () AS n FROM {g} WHERE v IS NOT NULL), q{g} AS (SELECT MAX(CASE WHEN r = LEAST(CAST(FLOOR(n * 0.02) AS INT), n - 1) THEN v END) AS lo, MAX(CASE WHEN r = LEAST(CAST(FLOOR(n * 0.98) AS INT), n - 1) THEN v END) AS hi FROM o{g}), s{g} AS (SELECT row, col, COALESCE(ROUND(GREATEST(0, LEAST(255, (v - lo) / (hi - lo) * 255))), 0) AS v FROM {g}, q{g})"
    case("display", "DISPLAY", "b", shown("b") + " SELECT row, col, v FROM sb")
    rgb = ("b", "p", "a")
    case("display_rgb", "DISPLAY", "abp", "".join(map(shown, rgb)) + " SELECT row, col, sb.v AS v, sp.v AS green, sa.v AS blue FROM sb JOIN sp USING (row, col) JOIN sa USING (row, col)", lambda f, own: f(own), mode="RGB Composite", red_band=2, green_band=3, blue_band=1)
    case("composite", "COMPOSITE", "apq", f", m AS (SELECT MIN(a.v) AS a0, MAX(a.v) AS a1, MIN(p.v) AS p0, MAX(p.v) AS p1, MIN(q.v) AS q0, MAX(q.v) AS q1 FROM a JOIN p USING (row, col) JOIN q USING (row, col)) SELECT row, col, {R('(a.v - a0) / (a1 - a0) * 255')}, {R('(p.v - p0) / (p1 - p0) * 255', 'green')}, {R('(q.v - q0) / (q1 - q0) * 255', 'blue')} FROM a JOIN p USING (row, col) JOIN q USING (row, col), m")
    case("histo", "HISTO", "b", st + f", k AS (SELECT LEAST(31, FLOOR((v - lo) / ((hi - lo) / 32))) AS bin, COUNT(*) AS cells FROM b, st WHERE v IS NOT NULL GROUP BY 1) SELECT CAST(g AS INT) AS bin, {R('lo + (g + 0.5) * ((hi - lo) / 32)', 'center')}, COALESCE(cells, 0) AS cells, {R('COALESCE(cells, 0) * 100.0 / n', 'percent')} FROM range(32) t(g) CROSS JOIN st LEFT JOIN k ON k.bin = g", num_bins=32)
    case("reclass_equal", "RECLASS", "b", st + cells.format("CASE WHEN v IS NOT NULL THEN LEAST(5, FLOOR((v - lo) / ((hi - lo) / 5)) + 1) END AS v"), lambda f, own: f(own[0], None))
    case("reclass_rules", "RECLASS", "c", " SELECT row, col, CAST(CASE WHEN v BETWEEN 1 AND 2 THEN 10 WHEN v BETWEEN 2 AND 4 THEN 20 END AS DOUBLE) AS v FROM c", lambda f, own: f(own[0], [(1, 2, 10), (2, 4, 20)], method="User Defined"))
    ab = ", j AS (SELECT a.v AS x, b.v AS y FROM a JOIN b USING (row, col) WHERE b.v IS NOT NULL)"
    case("correlate", "CORRELATE", "ab", ab + f" SELECT COUNT(*) AS n, {R('CORR(x, y)', 'r')}, {R('CORR(x, y) * CORR(x, y)', 'r2')}, {R('CORR(x, y) * SQRT((COUNT(*) - 2) / (1 - CORR(x, y) * CORR(x, y)))', 't')}, {R('REGR_SLOPE(y, x)', 'slope')}, {R('REGR_INTERCEPT(y, x)', 'intercept')} FROM j")
    se = "SQRT(REGR_SYY(x, y) * (1 - REGR_R2(x, y)) / (COUNT(*) - 2))"
    case("regress", "REGRESS", "ab", ab + f" SELECT COUNT(*) AS n, {R('REGR_SLOPE(x, y)', 'slope')}, {R('REGR_INTERCEPT(x, y)', 'intercept')}, {R('REGR_R2(x, y)', 'r2')}, {R(se, 'std_error')}, {R(f'REGR_SLOPE(x, y) / ({se} / SQRT(REGR_SXX(x, y)))', 't_slope')} FROM j")
    case("regress_grids", "REGRESS", "ab", ab + f", k AS (SELECT REGR_SLOPE(x, y) AS s, REGR_INTERCEPT(x, y) AS i FROM j) SELECT row, col, {R('b.v * s + i')}, {R('a.v - b.v * s - i', 'residual')} FROM a JOIN b USING (row, col), k", lambda f, own: zonal.regress_grids(*own))
    case("validate", "VALIDATE", "ab", ab + f" SELECT {R('SQRT(AVG((x - y) * (x - y)))', 'rmse')}, {R('AVG(ABS(x - y))', 'mae')}, {R('CORR(x, y) * CORR(x, y)', 'r2')}, {R('AVG(x - y)', 'bias')}, {R('1 - SUM((x - y) * (x - y)) / (VAR_POP(y) * COUNT(*))', 'nse')} FROM j")
    case("jaccard", "JACCARD", "sf", f" SELECT COUNT(*) FILTER (s.v <> 0 AND f.v <> 0) AS \"both\", COUNT(*) FILTER (s.v <> 0 OR f.v <> 0) AS either, {R('COUNT(*) FILTER (s.v <> 0 AND f.v <> 0) / COUNT(*) FILTER (s.v <> 0 OR f.v <> 0)', 'jaccard')} FROM s JOIN f USING (row, col)")
    case("sim_weight", "SIM_WEIGHT", "apq", f", w AS (SELECT GREATEST(0, CORR(a.v, p.v)) AS w1, GREATEST(0, CORR(a.v, q.v)) AS w2 FROM a JOIN p USING (row, col) JOIN q USING (row, col)) SELECT row, col, {R('CASE WHEN w1 + w2 > 0 THEN (p.v * w1 + q.v * w2) / (w1 + w2) ELSE (p.v + q.v) / 2 END')} FROM a JOIN p USING (row, col) JOIN q USING (row, col), w", lambda f, own: f(own[1:], own[0]))
    case("atmosc", "ATMOSC", "b", st + cells.format(R("v - lo")))
    case("sediment_delivery", "SEDIMENT_DELIVERY", "pa", f" SELECT row, col, {R('p.v * EXP(-(1 - a.v / (SELECT MAX(v) FROM a)))')} FROM p JOIN a USING (row, col)")
    mm = "({0}.v - (SELECT MIN(v) FROM {0})) / ((SELECT MAX(v) FROM {0}) - (SELECT MIN(v) FROM {0}))"
    case("climate_adaptation", "CLIMATE_ADAPTATION", "apq", f" SELECT row, col, {R('GREATEST(0, LEAST(1, (' + mm.format('a') + ' + ' + mm.format('p') + ') / 2 - 0.5 * ' + mm.format('q') + '))')} FROM a JOIN p USING (row, col) JOIN q USING (row, col)")
    case("cratio", "CRATIO", "a", f" SELECT {R('CASE WHEN SUM(v) > 0 THEN 2 * SUM(r * v) / (COUNT(*) * SUM(v)) - (COUNT(*) + 1) / COUNT(*) ELSE 0 END', 'gini')} FROM (SELECT v, ROW_NUMBER() OVER (ORDER BY v) AS r FROM a)")
    case("sensitivity", "SENSITIVITY", "pq", f", m AS (SELECT AVG(p.v) AS a, AVG(q.v) AS b FROM p JOIN q USING (row, col)), w AS (SELECT * FROM (VALUES (0, -1, 0.54, 0.4), (0, 1, 0.66, 0.4), (1, -1, 0.6, 0.36), (1, 1, 0.6, 0.44)) t(f, w, x, y)) SELECT f AS factor, w AS way, {R('(a * x + b * y) / (x + y)', 'mean')}, {R('a * 0.6 + b * 0.4', 'base')}, {R('(a * x + b * y) / (x + y) - a * 0.6 - b * 0.4', 'change')} FROM m, w", lambda f, own: f(own), weights=(0.6, 0.4))
    case("roc", "ROC", "ps", f", t AS (SELECT p.v AS x, s.v <> 0 AS h FROM p JOIN s USING (row, col)), l AS (SELECT MIN(x) AS lo, MAX(x) AS hi, COUNT(*) FILTER (h) AS np, COUNT(*) FILTER (NOT h) AS nn FROM t), c AS (SELECT FLOOR((x - lo) / (hi - lo) * 20) AS k, COUNT(*) FILTER (h) AS tp, COUNT(*) FILTER (NOT h) AS fp FROM t, l GROUP BY 1) SELECT CAST(g AS INT) AS step, {R('ANY_VALUE(lo + (hi - lo) * g / 20)', 'threshold')}, {R('SUM(CASE WHEN k >= g THEN tp ELSE 0 END) / ANY_VALUE(np)', 'tpr')}, {R('SUM(CASE WHEN k >= g THEN fp ELSE 0 END) / ANY_VALUE(nn)', 'fpr')} FROM range(21) r(g), c, l GROUP BY g", num_thresholds=20)
    case("rank", "RANK", "b", " SELECT row, col, CASE WHEN v IS NOT NULL THEN CAST(RANK() OVER (ORDER BY v DESC NULLS LAST) AS DOUBLE) END AS v FROM b")
    case("rank_ascending", "RANK", "b", " SELECT row, col, CASE WHEN v IS NOT NULL THEN CAST(RANK() OVER (ORDER BY v NULLS LAST) AS DOUBLE) END AS v FROM b", ascending=True)
    top = f" SELECT row, col, CASE WHEN v IS NOT NULL THEN CASE WHEN ROW_NUMBER() OVER (ORDER BY v DESC NULLS LAST, row * {SIZE} + col) <= {{}} THEN 1.0 ELSE 0.0 END END AS v FROM c"
    case("toprank", "TOPRANK", "c", top.format(100).replace("1.0", "CAST(1 AS DOUBLE)").replace("0.0", "CAST(0 AS DOUBLE)"))
    case("toprank_percent", "TOPRANK", "c", top.format("FLOOR((SELECT COUNT(v) FROM c) * 0.1)").replace("1.0", "CAST(1 AS DOUBLE)").replace("0.0", "CAST(0 AS DOUBLE)"), mode="Percentage", percentage=10.0)
    case("scatter", "SCATTER", "ab", None, max_points=500)
    case("sample_systematic", "SAMPLE", "b", " SELECT row, col, CAST(ROW_NUMBER() OVER (ORDER BY row, col) AS INT) AS id FROM b WHERE v IS NOT NULL AND row % 5 = 2 AND col % 5 = 2", lambda f, own: f(own[0], None, method="Systematic"))
    case("sample_random", "SAMPLE", "b", None, lambda f, own: f(own[0], None))
    case("sample_stratified", "SAMPLE", "bc", None, method="Stratified Random")
    case("chgalloc", "CHGALLOC", "cpq", f", w AS (SELECT row, col, ROW_NUMBER() OVER (ORDER BY p.v DESC, row * {SIZE} + col) AS r FROM c JOIN p USING (row, col) WHERE c.v = 1), y AS (SELECT row, col, ROW_NUMBER() OVER (ORDER BY q.v DESC, row * {SIZE} + col) AS r FROM c JOIN q USING (row, col) WHERE c.v = 2) SELECT c.row, c.col, CAST(CASE WHEN w.r <= 50 THEN 2 WHEN y.r <= 30 THEN 3 ELSE c.v END AS DOUBLE) AS v FROM c LEFT JOIN w USING (row, col) LEFT JOIN y USING (row, col)", lambda f, own: f(own[0], {(1, 2): own[1], (2, 3): own[2]}, [(1, 2, 50), (2, 3, 30)]))


def _stencil(g: str) -> str:
    """CTE z: 3 x 3 values z1..z9 by cell; null off the grid."""
    at = ", ".join(f"MAX(CASE WHEN dr = {k // 3 - 1} AND dc = {k % 3 - 1} THEN b.v END) AS z{k + 1}" for k in range(9))
    return f", o AS (SELECT dr, dc FROM (VALUES (-1), (0), (1)) t(dr), (VALUES (-1), (0), (1)) u(dc)), z AS (SELECT a.row, a.col, ANY_VALUE(a.v) AS v, {at} FROM {g} a CROSS JOIN o LEFT JOIN {g} b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY a.row, a.col)"


def _clamped(g: str) -> str:
    """CTE z, with the edge repeated and the centre where there is no data."""
    at = ", ".join(f"COALESCE(MAX(CASE WHEN dr = {k // 3 - 1} AND dc = {k % 3 - 1} THEN b.v END), ANY_VALUE(a.v)) AS z{k + 1}" for k in range(9))
    edge = SIZE - 1
    return f", o AS (SELECT dr, dc FROM (VALUES (-1), (0), (1)) t(dr), (VALUES (-1), (0), (1)) u(dc)), z AS (SELECT a.row, a.col, ANY_VALUE(a.v) AS v, {at} FROM {g} a CROSS JOIN o LEFT JOIN {g} b ON b.row = GREATEST(0, LEAST({edge}, a.row + dr)) AND b.col = GREATEST(0, LEAST({edge}, a.col + dc)) GROUP BY a.row, a.col)"


def _focal() -> None:
    gx, gy = "((z3 + 2 * z6 + z9 - z1 - 2 * z4 - z7) / 80)", "((z7 + 2 * z8 + z9 - z1 - 2 * z2 - z3) / 80)"
    inside = f"row BETWEEN 1 AND {SIZE - 2} AND col BETWEEN 1 AND {SIZE - 2}"
    cells = " SELECT row, col, {} FROM z"
    way = f"DEGREES(ATAN2({gy}, -{gx}))"
    az = f"(90 - {way})"
    case("aspect", "ASPECT", "b", _clamped("b") + cells.format(R(f"CASE WHEN v IS NULL OR (ABS({gx}) < 1e-10 AND ABS({gy}) < 1e-10) THEN -1 WHEN {az} < 0 THEN {az} + 360 WHEN {az} >= 360 THEN {az} - 360 ELSE {az} END")))
    D, E, H, G, Fx = "(((z4 + z6) / 2 - v) / 100)", "(((z2 + z8) / 2 - v) / 100)", "((z2 - z8) / 20)", "((z6 - z4) / 20)", "((z3 + z7 - z1 - z9) / 400)"
    P = f"({G} * {G} + {H} * {H})"
    prof = f"(CASE WHEN {P} < 1e-15 THEN 0 ELSE -2 * ({D} * {G} * {G} + {E} * {H} * {H} + {Fx} * {G} * {H}) / ({P} * SQRT(1 + {P})) END)"
    plan = f"(CASE WHEN {P} < 1e-15 THEN 0 ELSE -2 * ({D} * {H} * {H} + {E} * {G} * {G} - {Fx} * {G} * {H}) / POWER({P}, 1.5) END)"
    for n, e in (("Total", f"-2 * ({D} + {E})"), ("Profile", prof), ("Plan", plan)):
        case(f"curvature_{n.lower()}", "CURVATURE", "b", _clamped("b") + cells.format(R(f"CASE WHEN v IS NOT NULL THEN {e} END")), type=n)
    s = lambda e: f"(CASE WHEN ABS({e}) < 0.0001 THEN 0 ELSE SIGN({e}) END)"
    form = f"CASE WHEN v IS NULL THEN 0 WHEN SQRT({P}) < 0.001 THEN CASE WHEN {s(prof)} > 0 AND {s(plan)} > 0 THEN 1 WHEN {s(prof)} < 0 AND {s(plan)} < 0 THEN 7 WHEN {s(prof)} * {s(plan)} < 0 THEN 3 ELSE 4 END WHEN {s(prof)} > 0 AND {s(plan)} > 0 THEN 2 WHEN {s(prof)} < 0 AND {s(plan)} < 0 THEN 6 WHEN {s(prof)} * {s(plan)} < 0 THEN 5 WHEN {s(prof)} > 0 AND {s(plan)} = 0 THEN 8 WHEN {s(prof)} < 0 AND {s(plan)} = 0 THEN 9 ELSE 10 END"
    case("toposhape", "TOPOSHAPE", "b", _clamped("b") + cells.format(R(form)))
    slope = f"SQRT({gx} * {gx} + {gy} * {gy})"
    shade = f"255 * (COS({{z}}) * COS(ATAN({slope})) + SIN({{z}}) * SIN(ATAN({slope})) * COS(RADIANS(315) - ATAN2({gy}, -{gx})))"
    for n, m, e in (("degrees", "Slope (degrees)", f"DEGREES(ATAN({slope}))"), ("percent", "Slope (percent)", f"{slope} * 100"), ("aspect", "Aspect (degrees)", f"CASE WHEN {way} < 0 THEN {way} + 360 ELSE {way} END"), ("hillshade", "Hillshade", f"GREATEST(0, LEAST(255, {shade.format(z='RADIANS(45)')}))")):
        guard = f"CASE WHEN {inside} AND {gx} IS NOT NULL AND {gy} IS NOT NULL THEN {e} ELSE 0 END"
        case(f"surface_{n}", "SURFACE", "b", _stencil("b") + cells.format(R(guard)), mode=m)
    xx, yy, xy, pp = "((z6 - 2 * v + z4) / 100)", "((z2 - 2 * v + z8) / 100)", "((z3 - z1 - z9 + z7) / 400)", f"({gx} * {gx} + {gy} * {gy})"
    for n, e in (("profile", f"-({gx} * {gx} * {xx} + 2 * {gx} * {gy} * {xy} + {gy} * {gy} * {yy}) / ({pp} * POWER(1 + {pp}, 1.5))"), ("plan", f"({gy} * {gy} * {xx} - 2 * {gx} * {gy} * {xy} + {gx} * {gx} * {yy}) / ({pp} * SQRT(1 + {pp}))")):
        case(f"surface_{n}", "SURFACE", "b", _stencil("b") + cells.format(R(f"CASE WHEN {inside} THEN COALESCE(CASE WHEN {pp} < 1e-10 THEN 0 ELSE {e} END, 0) ELSE 0 END")), mode=f"{n.capitalize()} Curvature")
    whole = f"CASE WHEN {inside} AND v IS NOT NULL AND {gx} IS NOT NULL AND {gy} IS NOT NULL THEN {{}} END"
    case("hillshade", "HILLSHADE", "b", _stencil("b") + cells.format(R(whole.format(f"GREATEST(0, LEAST(255, {shade.format(z='RADIANS(45)')}))"))))
    turn = f"(CASE WHEN {way} < 0 THEN {way} + 360 ELSE {way} END)"
    case("facet", "FACET", "b", _stencil("b") + cells.format(f"CAST(COALESCE({whole.format(f'CASE WHEN DEGREES(ATAN({slope})) < 5 THEN 1 ELSE 2 + FLOOR(({turn} + 22.5) / 45) % 8 END')}, 0) AS DOUBLE) AS v"))
    light = f"CASE WHEN {inside} THEN COS(RADIANS(45)) * COS(ATAN({slope})) + SIN(RADIANS(45)) * SIN(ATAN({slope})) * COS(RADIANS(180) - ATAN2({gy}, -{gx})) ELSE COS(RADIANS(45)) END"
    case("illuminate", "ILLUMINATE", "pa", _stencil("a") + f" SELECT row, col, {R(f'CASE WHEN {light} > 0 THEN p.v * SQRT(COS(RADIANS(45)) / ({light})) END')} FROM p JOIN z USING (row, col)")
    case("sedimentation", "SEDIMENTATION", "bc", _clamped("b") + f" SELECT row, col, {R(f'CASE WHEN z.v IS NOT NULL THEN 0.03 * POWER(c.v * 10, 1.6) * POWER({slope}, 1.3) END')} FROM z JOIN c USING (row, col)")
    near = ", m AS (SELECT a.row, a.col, ANY_VALUE(a.v) AS v, {} FROM b a CROSS JOIN (SELECT dr, dc FROM range(-{h}, {h} + 1) t(dr), range(-{h}, {h} + 1) u(dc)) o JOIN b ON b.row = a.row + dr AND b.col = a.col + dc WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY a.row, a.col) SELECT b.row, b.col, {} FROM b LEFT JOIN m USING (row, col)"

    def window_sql(agg, out="x", h=1):
        return near.replace("{h}", str(h)).format(f"{agg} AS x", R(out))

    for n, e in (("Mean", "AVG(b.v)"), ("Median", "QUANTILE_CONT(b.v, 0.5)"), ("Min", "MIN(b.v)"), ("Max", "MAX(b.v)")):
        case(f"filter_{n.lower()}", "FILTER", "b", window_sql(e), filter_type=n)
    case("filter_laplacian", "FILTER", "b", near.replace("{h}", "1").format("SUM(b.v) - COUNT(*) * ANY_VALUE(a.v) AS x", R("x")), filter_type="Laplacian")
    mode = f", n AS (SELECT a.row, a.col, b.v AS k, COUNT(*) AS n FROM c a CROSS JOIN (SELECT dr, dc FROM range(-1, 2) t(dr), range(-1, 2) u(dc)) o JOIN c b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY 1, 2, 3), m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row, col ORDER BY n DESC, k) AS r FROM n) SELECT row, col, {R('k')} FROM m WHERE r = 1"
    case("filter_mode", "FILTER", "c", mode, filter_type="Mode")
    for n, e in (("mean", "AVG(b.v)"), ("median", "QUANTILE_CONT(b.v, 0.5)"), ("min", "MIN(b.v)"), ("max", "MAX(b.v)"), ("range", "MAX(b.v) - MIN(b.v)"), ("std", "STDDEV_POP(b.v)"), ("sum", "SUM(b.v)"), ("variety", "COUNT(DISTINCT b.v)")):
        case(f"window_{n}", "WINDOW", "b", window_sql(e, h=2), statistic=n, window_size=5)
    div = f", n AS (SELECT a.row, a.col, b.v AS k, COUNT(*) AS n FROM c a CROSS JOIN (SELECT dr, dc FROM range(-1, 2) t(dr), range(-1, 2) u(dc)) o JOIN c b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY 1, 2, 3), s AS (SELECT *, SUM(n) OVER (PARTITION BY row, col) AS t FROM n) SELECT row, col, {{}} FROM s GROUP BY row, col"
    H1 = "-SUM(n / t * LN(n / t))"
    for op, metric, e in (("PATTERN", "Entropy", H1), ("PATTERN", "Dominance", f"LN(COUNT(*)) - ({H1})"), ("PATTERN", "Diversity", "COUNT(*)"), ("BIODIVERSITY_METRICS", "Shannon", H1), ("BIODIVERSITY_METRICS", "Simpson", "1 - SUM(n / t * (n / t))"), ("BIODIVERSITY_METRICS", "Richness", "COUNT(*)")):
        case(f"{op.lower()}_{metric.lower()}", op, "c", div.format(R(e)), metric=metric)
    for n, m, e in (("variance", "Variance", "VAR_POP(b.v)"), ("cv", "Coefficient of Variation", "CASE WHEN ABS(AVG(b.v)) > 1e-10 THEN STDDEV_POP(b.v) / AVG(b.v) ELSE 0 END"), ("range", "Range", "MAX(b.v) - MIN(b.v)"), ("contrast", "Contrast", "COALESCE(2 * VAR_SAMP(b.v), 0)")):
        case(f"texture_{n}", "TEXTURE", "b", window_sql(e), metric=m)
    case("texture_asm", "TEXTURE", "c", div.format(R("SUM(n / t * (n / t))")), metric="Angular Second Moment")
    lee = near.replace("{h}", "2").format("AVG(b.v) AS x, COALESCE(VAR_SAMP(b.v), 0) AS s", "@").split(" SELECT b.row, b.col, @")[0]
    case("denoise", "DENOISE", "b", lee + f", k AS (SELECT AVG(s) AS k FROM m) SELECT b.row, b.col, {R('x + s / (s + k) * (b.v - x)')} FROM b LEFT JOIN m USING (row, col) CROSS JOIN k")
    hit = ", h AS (SELECT DISTINCT a.row, a.col FROM s a CROSS JOIN (SELECT dr, dc FROM range(-2, 3) t(dr), range(-2, 3) u(dc) WHERE dr * dr + dc * dc <= 4) o JOIN s b ON b.row = a.row + dr AND b.col = a.col + dc WHERE b.v <> 0)"
    case("expand", "EXPAND", "s", hit + " SELECT s.row, s.col, CAST(CASE WHEN s.v <> 0 THEN s.v WHEN h.row IS NOT NULL THEN 1 ELSE 0 END AS DOUBLE) AS v FROM s LEFT JOIN h USING (row, col)", radius=2)
    case("buffer", "BUFFER", "s", hit + " SELECT s.row, s.col, CAST(CASE WHEN h.row IS NOT NULL THEN 1 ELSE 0 END AS DOUBLE) AS v FROM s LEFT JOIN h USING (row, col)", buffer_distance=20.0)
    case("contract", "CONTRACT", "f", f", h AS (SELECT a.row, a.col, COUNT(b.v) FILTER (b.v <> 0) AS n FROM f a CROSS JOIN (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc) LEFT JOIN f b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY 1, 2) SELECT row, col, CAST(CASE WHEN n < 5 OR NOT ({inside}) THEN 0 ELSE v END AS DOUBLE) AS v FROM f JOIN h USING (row, col)")
    case("contour", "CONTOUR", "b", _stencil("b") + cells.format("CAST(CASE WHEN v IS NULL THEN NULL WHEN FLOOR(z6 / 50) <> FLOOR(v / 50) OR FLOOR(z8 / 50) <> FLOOR(v / 50) THEN 1 ELSE 0 END AS DOUBLE) AS v"), contour_interval=50.0)
    case("poly2line", "POLY2LINE", "c", _stencil("c") + cells.format("CAST(CASE WHEN z2 = v AND z4 = v AND z6 = v AND z8 = v THEN 0 ELSE 1 END AS DOUBLE) AS v"))
    case("autocorr", "AUTOCORR", "b", f", t AS (SELECT AVG(v) AS m, VAR_POP(v) AS s, COUNT(v) AS n FROM b), w AS (SELECT SUM((a.v - m) * (b.v - m)) AS x, COUNT(*) AS k FROM b a CROSS JOIN t CROSS JOIN (SELECT dr, dc FROM range(-1, 2) t(dr), range(-1, 2) u(dc) WHERE dr <> 0 OR dc <> 0) o JOIN b ON b.row = a.row + dr AND b.col = a.col + dc WHERE a.v IS NOT NULL AND b.v IS NOT NULL) SELECT {R('x / k / s', 'moran_i')}, {R('-1 / (n - 1)', 'expected')}, k AS pairs, n FROM w, t")
    case("intercon", "INTERCON", "s", None)
    case("habitat_quality", "HABITAT_QUALITY", "cs", None, lambda f, own: f(own[0], [(own[1], 3.0, 1.0, "linear")], habitat=((1, 1.0), (2, 0.5), (3, 0.8)), sensitivity=((1, (0.7,)), (2, (0.4,)), (3, (0.9,)))))


def _points(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), (1000 + F.col("c_custkey") * 37 % 480 + 0.5).alias("x"), (5000 - F.col("c_custkey") * 53 % 480 - 0.25).alias("y"), F.col("c_acctbal").alias("value"))


POINTS = ", pt AS (SELECT c_custkey AS id, 1000 + c_custkey * 37 % 480 + 0.5 AS x, 5000 - c_custkey * 53 % 480 - 0.25 AS y, c_acctbal AS value FROM customer), pc AS (SELECT *, CAST(TRUNC((x - 1000) / 10) AS INT) AS col, CAST(TRUNC((y - 5000) / -10) AS INT) AS row FROM pt)"


def _regrid() -> None:
    e = SIZE - 1
    for d, r, c in (("horizontal", "row", f"{e} - col"), ("vertical", f"{e} - row", "col"), ("both", f"{e} - row", f"{e} - col")):
        case(f"flip_{d}", "FLIP", "b", f" SELECT {r} AS row, {c} AS col, v FROM b", direction=d)
    case("concat", "CONCAT", "ab", " SELECT row, col, 0 AS band, v FROM a UNION ALL SELECT row, col, 1, v FROM b", lambda f, own: f(own))
    case("separate", "CONCAT", "ab", " SELECT row, col, v FROM b", lambda f, own: regrid.separate(f(own), 1))
    case("breakout", "BREAKOUT", "c", " SELECT row, col, k AS category, CAST(CASE WHEN v = k THEN 1 ELSE 0 END AS DOUBLE) AS v FROM c, (SELECT DISTINCT CAST(v AS INT) AS k FROM c)")
    case("split", "SPLIT", "c", " SELECT row, col, k AS category, CAST(CASE WHEN v = k THEN 1 ELSE 0 END AS DOUBLE) AS v FROM c, (SELECT DISTINCT CAST(v AS INT) AS k FROM c)")
    case("subsample", "SUBSAMPLE", "b", " SELECT row // 3 AS row, col // 3 AS col, v FROM b WHERE row % 3 = 0 AND col % 3 = 0", factor=3)
    case("pyramid", "PYRAMID", "b", f", l AS (SELECT row // 2 AS row, col // 2 AS col, AVG(v) AS v FROM b GROUP BY 1, 2) SELECT row // 2 AS row, col // 2 AS col, {R('AVG(v)')} FROM l GROUP BY 1, 2", lambda f, own: f(own[0], num_levels=2)[1])
    case("zeropad", "ZEROPAD", "b", " SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, CASE WHEN b.row IS NULL THEN 0 ELSE v END AS v FROM range(64) t(r) CROSS JOIN range(64) u(c) LEFT JOIN b ON b.row = r - 8 AND b.col = c - 8")
    case("relocate", "RELOCATE", "a", " SELECT 1000 + col * 10 + 5.0 AS x, 5000 - row * 10 - 3.0 AS y, v AS value FROM a", lambda f, own: create("RASTERTOPOINT")(f(own[0], shift_x=5.0, shift_y=-3.0)))
    case("metaupdate", "METAUPDATE", "a", " SELECT 1000 + col * 20.0 AS x, 5000 - row * 20.0 AS y, v AS value FROM a", lambda f, own: create("RASTERTOPOINT")(f(own[0], cell_size=20.0)))
    # A target's place in the source, by cell centres: (k + 0.5) * ratio - 0.5; all cells that it is made of must have data.
    spot = lambda n, ratio: f", x AS (SELECT CAST(i AS INT) AS k, FLOOR((i + 0.5) * {ratio} - 0.5) AS b, (i + 0.5) * {ratio} - 0.5 - FLOOR((i + 0.5) * {ratio} - 0.5) AS f FROM range({n}) t(i))"
    met = lambda taps: f", w AS (SELECT k, b + j AS s, CASE {{}} END AS w FROM x, (SELECT UNNEST([{taps}]) AS j)), m AS (SELECT r.k AS row, c.k AS col, SUM(r.w * c.w * b.v) AS v, COUNT(b.v) AS n FROM w r, w c JOIN b ON b.row = r.s AND b.col = c.s GROUP BY 1, 2) SELECT row, col, ROUND(v, 6) + 0.0 AS v FROM m"
    case("resample_nearest", "RESAMPLE", "b", " SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, v FROM range(32) t(r), range(32) u(c) JOIN b ON b.row = FLOOR((r + 0.5) * 1.5) AND b.col = FLOOR((c + 0.5) * 1.5) WHERE v IS NOT NULL", cell_size=15.0)
    case("resample_bilinear", "RESAMPLE", "b", spot(96, 0.5) + met("0, 1").format("WHEN j = 1 THEN f ELSE 1 - f") + " WHERE n = 4", cell_size=5.0, method="bilinear")
    cubic = "WHEN j = -1 THEN -0.5 * f * f * f + f * f - 0.5 * f WHEN j = 0 THEN 1.5 * f * f * f - 2.5 * f * f + 1 WHEN j = 1 THEN -1.5 * f * f * f + 2 * f * f + 0.5 * f ELSE 0.5 * f * f * f - 0.5 * f * f"
    case("resample_cubic", "RESAMPLE", "b", spot(69, 0.7) + met("-1, 0, 1, 2").format(cubic) + " WHERE n = 16", cell_size=7.0, method="cubic")
    case("transform", "TRANSFORM", "a", None, rotation_degrees=30.0)
    case("landsat_upsample", "LANDSAT_UPSAMPLE", "ab", None, lambda f, own: f(create("PYRAMID")(own[0], num_levels=1)[0], own[1]))
    case("disaggregate", "DISAGGREGATE", "ab", f", k AS (SELECT row // 2 AS row, col // 2 AS col, AVG(v) AS v FROM a GROUP BY 1, 2), w AS (SELECT row // 2 AS r, col // 2 AS c, SUM(v) AS w, COUNT(v) AS n FROM b GROUP BY 1, 2) SELECT b.row, b.col, {R('CASE WHEN w > 0 THEN k.v * b.v / w ELSE CASE WHEN b.v IS NOT NULL THEN k.v / n END END')} FROM b LEFT JOIN w ON w.r = b.row // 2 AND w.c = b.col // 2 LEFT JOIN k ON k.row = b.row // 2 AND k.col = b.col // 2", lambda f, own: f(create("PYRAMID")(own[0], num_levels=1)[0], own[1]))
    shifted = lambda g: Grid(g.df, g.rows, g.cols, (1000.0 + 20 * 10, 5000.0 - 5 * 10, 10.0, -10.0, 0.0, 0.0))
    m = ", u AS (SELECT row, col, v, 0 AS k FROM b WHERE v IS NOT NULL UNION ALL SELECT row + 5, col + 20, v, 1 FROM a)"
    for n, x in (("first", "ARG_MIN(v, k)"), ("last", "ARG_MAX(v, k)"), ("average", "AVG(v)"), ("max", "MAX(v)")):
        case(f"mosaic_{n}", "MOSAIC", "ba", m + f" SELECT row, col, {R(x)} FROM u GROUP BY 1, 2", lambda f, own: f([own[0], shifted(own[1])]), method=n)
    case("ortho", "ORTHO", "ab", None, sensor_height=7000.0)
    case("pansharpen", "PANSHARPEN", "apqc", f", t AS (SELECT row, col, a.v AS x, p.v AS y, q.v AS z, c.v - (a.v + p.v + q.v) / 3 AS k FROM a JOIN p USING (row, col) JOIN q USING (row, col) JOIN c USING (row, col)) SELECT row, col, {R('x + k')}, {R('y + k', 'green')}, {R('z + k', 'blue')} FROM t")
    for n, x in (("Mean", "AVG(value)"), ("Sum", "SUM(value)"), ("Max", "MAX(value)"), ("Min", "MIN(value)"), ("Count", "COUNT(*)")):
        add(f"pointtoraster_{n.lower()}", lambda s, d, n=n: create("POINTTORASTER")(_points(s, d), grid(s, d, "a"), method=n), with_grids("a", POINTS + f" SELECT row, col, {R(x)} FROM pc WHERE row BETWEEN 0 AND {e} AND col BETWEEN 0 AND {e} GROUP BY 1, 2"))
    case("rastertopoint", "RASTERTOPOINT", "b", " SELECT 1000 + col * 10.0 AS x, 5000 - row * 10.0 AS y, v AS value FROM b WHERE v IS NOT NULL")
    add("query", lambda s, d: create("QUERY")(grid(s, d, "b"), _points(s, d)), with_grids("b", POINTS + f" SELECT id, x, y, v AS value, CASE WHEN NOT (pc.row BETWEEN 0 AND {e} AND pc.col BETWEEN 0 AND {e}) THEN 'OutOfBounds' WHEN v IS NULL THEN 'NoData' ELSE 'ok' END AS status FROM pc LEFT JOIN b ON b.row = pc.row AND b.col = pc.col").replace("+ 0.5 AS x", "+ CAST(0.5 AS DOUBLE) AS x").replace("- 0.25 AS y", "- CAST(0.25 AS DOUBLE) AS y"))
    case("profile", "PROFILE", "b", f", s AS (SELECT i AS id, i * 10.0 AS distance, CAST(TRUNC(i * 10.0 / 500 * 30) AS INT) AS col, CAST(TRUNC(i * 10.0 / 500 * 40) AS INT) AS row FROM range(51) t(i)) SELECT id, CAST(distance AS DOUBLE) AS distance, v AS value, CASE WHEN v IS NULL THEN 'NoData' ELSE 'ok' END AS status FROM s LEFT JOIN b USING (row, col)", start_x=1000.0, start_y=5000.0, end_x=1300.0, end_y=4600.0)
    near = POINTS + f", n AS (SELECT row, col, id, value, SQRT(POWER(x - 1000 - a.col * 10, 2) + POWER(y - 5000 + a.row * 10, 2)) AS d FROM a, pt), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row, col ORDER BY d, id) AS k FROM n)"
    add("thiessen", lambda s, d: create("THIESSEN")(_points(s, d), grid(s, d, "a")), with_grids("a", near + " SELECT row, col, CAST(id AS DOUBLE) AS v FROM r WHERE k = 1"))
    add("interpol", lambda s, d: create("INTERPOL")(_points(s, d), grid(s, d, "a")), with_grids("a", near + f" SELECT row, col, {R('COALESCE(MAX(CASE WHEN d < 1e-10 THEN value END), SUM(value / (d * d)) / SUM(1 / (d * d)))')} FROM r WHERE k <= 12 GROUP BY 1, 2"))
    add("interpol_radius", lambda s, d: create("INTERPOL")(_points(s, d), grid(s, d, "a"), search_radius=60.0), with_grids("a", near + f", w AS (SELECT row, col, {R('SUM(value / (d * d)) / SUM(1 / (d * d))')} FROM r WHERE k <= 12 AND d <= 60 GROUP BY 1, 2) SELECT row, col, w.v FROM a LEFT JOIN w USING (row, col)"))
    add("trend", lambda s, d: create("TREND")(_points(s, d), grid(s, d, "a"), order=1), None)
    add("species_distribution", lambda s, d: create("SPECIES_DISTRIBUTION")(_points(s, d), [grid(s, d, "a"), grid(s, d, "p")]), None)


def _series_df(spark, sf_dir, salt: int = 0):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.groupBy((F.col("user_id") % 8).cast("int").alias("row"), (F.col("event_id") % 5).cast("int").alias("col"), ((F.col("event_id") + salt) % 24).cast("int").alias("t")).agg(F.round(F.sum(F.col("value") * (1 + salt)), 4).alias("v"))


def _series_sql(salt: int = 0) -> str:
    return f"SELECT CAST(user_id % 8 AS INT) AS row, CAST(event_id % 5 AS INT) AS col, CAST((event_id + {salt}) % 24 AS INT) AS t, ROUND(SUM(value * {1 + salt}), 4) AS v FROM events GROUP BY 1, 2, 3"


def _series() -> None:
    S = "WITH s AS (" + _series_sql() + ")"

    def one(name, op, sql, **params):
        add(name, lambda sp, d: create(op)(_series_df(sp, d), **params), S + sql if sql else None)

    for n, x in (("Mean", "AVG(v)"), ("Min", "MIN(v)"), ("Max", "MAX(v)"), ("StdDev", "COALESCE(STDDEV_SAMP(v), 0)"), ("Sum", "SUM(v)"), ("Count", "COUNT(v)")):
        one(f"timeseries_{n.lower()}", "TIMESERIES_STATS", f" SELECT row, col, {R(x)} FROM s GROUP BY 1, 2", statistic=n)
    one("tdiff", "TDIFF", f" SELECT row, col, t, {R('v - w')} FROM (SELECT *, LAG(v) OVER (PARTITION BY row, col ORDER BY t) AS w, ROW_NUMBER() OVER (PARTITION BY row, col ORDER BY t) AS k FROM s) WHERE k > 1")
    for n, x in (("mean", "AVG(v)"), ("sum", "SUM(v)"), ("max", "MAX(v)"), ("min", "MIN(v)")):
        one(f"taggregate_{n}", "TAGGREGATE", f" SELECT row, col, CAST(t // 5 AS BIGINT) AS t, {R(x)} FROM s WHERE (t // 5 + 1) * 5 <= (SELECT MAX(t) + 1 FROM s) GROUP BY 1, 2, 3", group_size=5, method=n)
    one("deseason", "DESEASON", f" SELECT row, col, t, {R('v - AVG(v) OVER (PARTITION BY row, col, t % 6)')} FROM s", period=6)
    dec = ", w AS (SELECT *, SUM(v) OVER (PARTITION BY row, col ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a, SUM(v) OVER (PARTITION BY row, col ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS b, COUNT(v) OVER (PARTITION BY row, col ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM s), x AS (SELECT *, CASE WHEN n = 5 THEN (a + b) / 8 END AS trend FROM w), y AS (SELECT *, AVG(v - trend) OVER (PARTITION BY row, col, t % 4) AS raw FROM x), m AS (SELECT row, col, AVG(r) AS m FROM (SELECT row, col, t % 4 AS p, ANY_VALUE(raw) AS r FROM y GROUP BY 1, 2, 3) GROUP BY 1, 2)"
    one("seasonal_decomp", "SEASONAL_DECOMP", dec + f" SELECT row, col, t, v, {R('trend', 'trend')}, {R('raw - m', 'seasonal')}, {R('v - trend - raw + m', 'residual')} FROM y JOIN m USING (row, col)", frequency=4)
    two = "WITH s AS (" + _series_sql() + "), u AS (" + _series_sql(3) + "), j AS (SELECT row, col, s.v AS v, u.v AS w FROM s JOIN u USING (row, col, t))"
    add("tcor", lambda sp, d: create("TCOR")(_series_df(sp, d), _series_df(sp, d, 3)), two + f" SELECT row, col, {R('CORR(v, w)', 'r')}, COUNT(*) AS n FROM j GROUP BY 1, 2")
    add("kendalltau", lambda sp, d: create("KENDALLTAU")(_series_df(sp, d), _series_df(sp, d, 3)), two + f" SELECT x.row, x.col, {R('SUM(SIGN(x.v - y.v) * SIGN(x.w - y.w)) / SQRT(SUM(ABS(SIGN(x.v - y.v))) * SUM(ABS(SIGN(x.w - y.w))))', 'tau')} FROM j x JOIN j y ON x.row = y.row AND x.col = y.col GROUP BY 1, 2")
    r2 = "REGR_R2(v, t)"
    one("trend_analysis", "TREND_ANALYSIS", f" SELECT row, col, {R('REGR_SLOPE(v, t)', 'slope')}, {R(f'CASE WHEN {r2} < 1 THEN SIGN(REGR_SLOPE(v, t)) * SQRT({r2} * (COUNT(*) - 2) / (1 - {r2})) END', 't_value')}, COUNT(*) AS n FROM s GROUP BY 1, 2")

    def arrays(sp, d, salt=0, n=24):
        s = _series_df(sp, d, salt)
        full = s.select(*KEY).distinct().crossJoin(sp.range(n).select(F.col("id").cast("int").alias("t")))
        return series.to_arrays(full.join(s, [*KEY, "t"], "left").na.fill(0.0, ["v"]))

    full = ", g AS (SELECT row, col, CAST(i AS INT) AS t FROM (SELECT DISTINCT row, col FROM s), range(24) r(i)), f AS (SELECT row, col, t, COALESCE(v, 0) AS v FROM g LEFT JOIN s USING (row, col, t))"
    four = ", ".join(x for k in (1, 2, 3) for x in (R(f"SQRT(POWER(SUM(v * COS(2 * PI() * {k} * t / 24)) / 12, 2) + POWER(SUM(v * SIN(2 * PI() * {k} * t / 24)) / 12, 2))", f"amplitude{k}"), R(f"ATAN2(SUM(v * SIN(2 * PI() * {k} * t / 24)) / 12, SUM(v * COS(2 * PI() * {k} * t / 24)) / 12)", f"phase{k}")))
    add("tfa", lambda sp, d: create("TFA")(arrays(sp, d), length=24), S + full + f" SELECT row, col, {R('AVG(v)', 'mean')}, {four} FROM f GROUP BY 1, 2")
    two = four.split(", ROUND(CAST(SQRT(POWER(SUM(v * COS(2 * PI() * 3")[0]
    add("harmonicreg", lambda sp, d: create("HARMONICREG")(arrays(sp, d), length=24).drop("fitted"), S + full + f" SELECT row, col, {R('AVG(v)', 'intercept')}, {two} FROM f GROUP BY 1, 2")
    add("sta", lambda sp, d: create("STA")(arrays(sp, d)))
    for w in ("haar", "db4"):
        add(f"modwt_{w}", lambda sp, d, w=w: create("MODWT")(arrays(sp, d), wavelet_type=w).select(*KEY, *(F.posexplode(F.arrays_zip("d1", "d2", "d3", "smooth")).alias("t", "x"),)).select(*KEY, "t", "x.*"), None if w == "db4" else S + full + ", a AS (SELECT *, LIST(v) OVER (PARTITION BY row, col ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM f), b AS (SELECT row, col, t, l, (v + l[(t + 23) % 24 + 1]) / 2 AS s1, (v - l[(t + 23) % 24 + 1]) / 2 AS d1 FROM a), c AS (SELECT *, LIST(s1) OVER (PARTITION BY row, col ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS m FROM b), e AS (SELECT *, (s1 + m[(t + 22) % 24 + 1]) / 2 AS s2, (s1 - m[(t + 22) % 24 + 1]) / 2 AS d2 FROM c), h AS (SELECT *, LIST(s2) OVER (PARTITION BY row, col ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM e)" + f" SELECT row, col, t, {R('d1', 'd1')}, {R('d2', 'd2')}, {R('(s2 - n[(t + 20) % 24 + 1]) / 2', 'd3')}, {R('(s2 + n[(t + 20) % 24 + 1]) / 2', 'smooth')} FROM h")
    add("bioclimvars", lambda sp, d: create("BIOCLIMVARS")(arrays(sp, d, 0, 12), arrays(sp, d, 3, 12)))
    add("multi_reg", lambda sp, d: create("MULTI_REG")(arrays(sp, d), [arrays(sp, d, 3)]).select(*KEY, "r2"))
    add("mlr", lambda sp, d: create("MLR")(arrays(sp, d), [arrays(sp, d, 3)]).select(*KEY, "r2"))
    add("hants", lambda sp, d: create("HANTS")(arrays(sp, d), num_harmonics=1, fit_error_tolerance=0.4).select(*KEY, F.col("amplitudes")[0].alias("amplitude"), F.col("phases")[0].alias("phase"), F.col("smooth")[5].alias("v5")))
    add("hants_3", lambda sp, d: create("HANTS")(arrays(sp, d)).select(*KEY, F.size("smooth").alias("n")))
    add("mssa", lambda sp, d: create("MSSA")(arrays(sp, d)).select(*KEY, F.size("reconstruction").alias("n")))
    add("eot", lambda sp, d: create("EOT")(_series_df(sp, d), num_modes=3))
    add("eot_bases", lambda sp, d: create("EOT")(_series_df(sp, d), num_modes=3, output="bases").select("mode", *KEY, "total_r2", F.posexplode("series").alias("t", "v")))


def _iterate() -> None:
    for n, g in (("cost", "sf"), ("allocate", "sf"), ("costgrow", "sf")):
        case(n, n.upper(), g, None)
    case("distance", "DISTANCE", "s", None)
    case("hinterland", "HINTERLAND", "s", None)
    case("spdist", "SPDIST", "f", None, dest_row=30, dest_col=40)
    case("disperse", "DISPERSE", "sf", None, num_steps=4)
    case("group_4", "GROUP", "s", None)
    case("group_8", "GROUP", "s", None, connectivity="8-connected")
    case("areafilter", "AREAFILTER", "c", None, threshold=4)
    case("flow_direction", "FLOW", "a", f", o AS (SELECT * FROM (VALUES (0, 1, 1, 10.0, 0), (1, 1, 2, SQRT(200.0), 1), (1, 0, 4, 10.0, 2), (1, -1, 8, SQRT(200.0), 3), (0, -1, 16, 10.0, 4), (-1, -1, 32, SQRT(200.0), 5), (-1, 0, 64, 10.0, 6), (-1, 1, 128, SQRT(200.0), 7)) t(dr, dc, code, d, k)), x AS (SELECT a.row, a.col, code, (a.v - b.v) / d AS drop_, ROW_NUMBER() OVER (PARTITION BY a.row, a.col ORDER BY (a.v - b.v) / d DESC, k) AS r FROM a CROSS JOIN o JOIN a b ON b.row = a.row + dr AND b.col = a.col + dc) SELECT row, col, CAST(CASE WHEN drop_ > 0 THEN code ELSE 0 END AS DOUBLE) AS v FROM x WHERE r = 1", lambda f, own: iterate.flow_direction(own[0]))
    case("flow", "FLOW", "a", None)
    case("watershed", "WATERSHED", "as", None, lambda f, own: f(iterate.flow_direction(own[0]), own[1]))
    case("slopelength", "SLOPELENGTH", "a", None)
    case("pitremoval", "PITREMOVAL", "a", None)
    maj = ", n{k} AS (SELECT a.row, a.col, b.v AS x, COUNT(*) AS n FROM {g} a CROSS JOIN (SELECT dr, dc FROM range(-1, 2) t(dr), range(-1, 2) u(dc)) o JOIN {g} b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY 1, 2, 3), m{k} AS (SELECT row, col, x, ROW_NUMBER() OVER (PARTITION BY row, col ORDER BY n DESC, x) AS r FROM n{k}), g{k} AS (SELECT q.row, q.col, CASE WHEN f.v <> 0 THEN m{k}.x ELSE q.v END AS v FROM {g} q JOIN f USING (row, col) JOIN m{k} ON m{k}.row = q.row AND m{k}.col = q.col AND m{k}.r = 1)"
    case("cellatom", "CELLATOM", "cf", maj.format(k=1, g="c") + maj.format(k=2, g="g1") + " SELECT row, col, v FROM g2", iterations=2)
    case("cellular_automata", "CELLULAR_AUTOMATA", "cpq", None, lambda f, own: f(own[0], {1: own[1], 2: own[2]}), matrix=((1, 1, 1.0), (2, 2, 0.9), (2, 1, 0.1), (3, 3, 0.8), (3, 1, 0.2), (4, 2, 0.3), (4, 4, 0.7), (5, 5, 1.0)), iterations=2)
    case("mola", "MOLA", "pq", None, lambda f, own: f(own), areas=(200, 300))
    # Time 2: the classes of c, the next one where s has features.
    case("geomod", "GEOMOD", "cs", None, lambda f, own: f(own[0], own[0].with_cells(own[0].df.join(own[1].df.select(*KEY, F.col("v").alias("s")), KEY).select(*KEY, F.when(F.col("s") != 0, F.col("v") % 5 + 1).otherwise(F.col("v")).alias("v")))), quantity=150)
    case("varcost", "VARCOST", "sfa", None)
    case("viewshed", "VIEWSHED", "a", None, observer_x=1200.0, observer_y=4800.0)
    case("spdist_places", "SPDIST", "f", None, dest_x=1405.0, dest_y=4695.0)
    case("pathway_place", "PATHWAY", "a", None, lambda f, own: f(own[0], iterate.flow_direction(own[0])), target_x=1205.0, target_y=4795.0)
    case("pathway", "PATHWAY", "a", None, lambda f, own: f(own[0], iterate.flow_direction(own[0]), row=20, col=20))
    case("fractal", "FRACTAL", "a", None)
    case("fractal_gaps", "FRACTAL", "b", None, max_window=6)
    case("pclass", "PCLASS", "ac", None, threshold=650.0)
    case("kendall", "KENDALL", "pq", f", j AS (SELECT p.v AS x, q.v AS y FROM p JOIN q USING (row, col)), t AS (SELECT SUM(SIGN(a.x - b.x) * SIGN(a.y - b.y)) / SQRT(SUM(ABS(SIGN(a.x - b.x))) * SUM(ABS(SIGN(a.y - b.y)))) AS tau FROM j a, j b), n AS (SELECT COUNT(*) AS n FROM j) SELECT n, {R('tau', 'tau')}, {R('tau / SQRT(2 * (2 * n + 5) / (9.0 * n * (n - 1)))', 'z')} FROM t, n", lambda f, own: f(*own).drop("p"))
    case("pollination", "POLLINATION", "c", None, nesting=((1, 0.5), (2, 0.9)), floral=((1, 0.3), (3, 0.8)), foraging_distance=3.0)
    case("segment", "SEGMENT", "a", None, lambda f, own: f(learn.pixels(own[:1]), cols=SIZE, similarity_threshold=30.0))
    case("segmentation", "SEGMENTATION", "a", None, lambda f, own: f(learn.pixels(own[:1]), cols=SIZE, spatial_bandwidth=2.0, spectral_bandwidth=60.0))
    pairs = ", s AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM a), k AS (SELECT row, col, LEAST(15, FLOOR((v - lo) / (hi - lo) * 16)) AS k FROM a, s), w AS (SELECT x.row + dr AS row, x.col + dc AS col, x.k AS i, y.k AS j FROM k x JOIN k y ON y.row = x.row AND y.col = x.col + 1, range(-3, 4) t(dr), range(-3, 4) u(dc))"
    for n, e in (("Contrast", "AVG((i - j) * (i - j))"), ("Dissimilarity", "AVG(ABS(i - j))"), ("Homogeneity", "AVG(1 / (1 + (i - j) * (i - j)))")):
        case(f"texture_glcm_{n.lower()}", "TEXTURE_GLCM", "a", pairs + f", m AS (SELECT row, col, {e} AS x FROM w GROUP BY 1, 2) SELECT row, col, {R('COALESCE(x, 0)')} FROM a LEFT JOIN m USING (row, col)", measure=n)
    case("texture_glcm_energy", "TEXTURE_GLCM", "a", pairs + f", z AS (SELECT row, col, i, j, COUNT(*) AS n FROM (SELECT row, col, i, j FROM w UNION ALL SELECT row, col, j, i FROM w) GROUP BY 1, 2, 3, 4), m AS (SELECT row, col, SUM(n * n) / POWER(SUM(n), 2) AS x FROM z GROUP BY 1, 2) SELECT row, col, {R('COALESCE(x, 0)')} FROM a LEFT JOIN m USING (row, col)", measure="Energy")
    add("tin", lambda s, d: create("TIN")(_points(s, d)))
    add("tinsurf", lambda s, d: create("TINSURF")(create("TIN")(_points(s, d)), grid(s, d, "a")))
    add("project", lambda s, d: create("PROJECT")(grid(s, d, "a")))
    case("rastervector_round_trip", "RASTERVECTOR", "s", f" SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(CASE WHEN v <> 0 THEN 1 ELSE 0 END AS DOUBLE) AS v FROM range({SIZE}) t(r) CROSS JOIN range({SIZE}) u(c) LEFT JOIN s ON s.row = r AND s.col = c", lambda f, own: create("VECTORRASTER")(f(own[0]).where("value <> 0"), own[0]))
    case("durbinwatson", "DURBINWATSON", "b", f", l AS (SELECT v, LAG(v) OVER (ORDER BY row, col) AS w FROM b WHERE v IS NOT NULL) SELECT {R('SUM((v - w) * (v - w)) / SUM(v * v)', 'dw')}, {R('1 - SUM((v - w) * (v - w)) / SUM(v * v) / 2', 'rho')}, COUNT(*) AS n FROM l")
    case("cochranorcutt", "COCHRANORCUTT", "ab", None)
    case("cochranorcutt_residuals", "COCHRANORCUTT", "ab", None, output="residuals")
    add("generalize", lambda s, d: create("GENERALIZE")(_points(s, d), min_distance=40.0))


def _learn() -> None:
    def px(s, d):
        return learn.pixels([grid(s, d, g) for g in "apq"])

    def labels(s, d):
        g = grid(s, d, "c")
        return g.df.where((F.col("row") + F.col("col")) % 3 == 0)

    def sig(s, d):
        return [(c, m, v + 1e-3, n) for c, n, m, v in ((c, n / 1000, m, v) for c, n, m, v in learn.class_moments(learn.training(px(s, d), labels(s, d)), 3))]

    ends = [(1, [600.0, 0.2, 0.8]), (2, [650.0, 0.8, 0.2]), (3, [700.0, 0.5, 0.5])]
    P = ", x AS (SELECT row, col, a.v AS av, p.v AS pv, q.v AS qv FROM a JOIN p USING (row, col) JOIN q USING (row, col))"
    dist = ", e AS (SELECT * FROM (VALUES (1, 600.0, 0.2, 0.8), (2, 650.0, 0.8, 0.2), (3, 700.0, 0.5, 0.5)) t(k, a, b, c)), y AS (SELECT row, col, k, SQRT(POWER(av - a, 2) + POWER(pv - b, 2) + POWER(qv - c, 2)) AS d, ROW_NUMBER() OVER (PARTITION BY row, col ORDER BY POWER(av - a, 2) + POWER(pv - b, 2) + POWER(qv - c, 2), k) AS r, ACOS(LEAST(1, (av * a + pv * b + qv * c) / SQRT((av * av + pv * pv + qv * qv) * (a * a + b * b + c * c)))) AS g FROM x, e)"
    add("hypermin", lambda s, d: create("HYPERMIN")(px(s, d), ends), with_grids("apq", P + dist + f" SELECT row, col, CAST(k AS DOUBLE) AS v, {R('d', 'distance')} FROM y WHERE r = 1"))
    add("mindist", lambda s, d: create("MINDIST")(px(s, d), [(k, e, [[1, 0, 0], [0, 1, 0], [0, 0, 1]]) for k, e in ends], max_distance=100.0), with_grids("apq", P + dist + " SELECT row, col, CAST(CASE WHEN d <= 100 THEN k ELSE 0 END AS DOUBLE) AS v FROM y WHERE r = 1"))
    add("hypersam", lambda s, d: create("HYPERSAM")(px(s, d), ends, threshold_angle=0.001))
    add("piped", lambda s, d: create("PIPED")(px(s, d), [(1, [500, 0.0, 0.0], [700, 0.5, 1.0]), (2, [650, 0.4, 0.0], [900, 1.0, 1.0])]), with_grids("apq", P + ", y AS (SELECT *, av BETWEEN 500 AND 700 AND pv <= 0.5 AS h, av BETWEEN 650 AND 900 AND pv BETWEEN 0.4 AND 1 AS i FROM x) SELECT row, col, CAST(CASE WHEN h AND i THEN 0 WHEN h THEN 1 WHEN i THEN 2 ELSE 0 END AS DOUBLE) AS v FROM y"))
    for n in ("PCA", "MNF", "CLUSTER", "KMEANS", "ISODATA", "ISOCLUST", "CHAINCLUSTER"):
        add(n.lower(), lambda s, d, n=n: create(n)(px(s, d)))
    for n in ("CANCOMP", "KNN", "CTA", "DECISIONFOREST", "SVM", "MULTILOGISTICREG", "MLP", "RBFNN", "SOM", "FUZZYARTMAP", "FUZZY_ARTMAP2", "PURIFY", "FUZSIG"):
        add(n.lower(), lambda s, d, n=n: create(n)(px(s, d), labels(s, d)))
    for n in ("MAHALCLASS", "MAXLIKE", "FISHER"):
        add(n.lower(), lambda s, d, n=n: create(n)(px(s, d), sig(s, d)))
    for n, array, rest in (("BAYCLASS", "posterior", "uncertainty"), ("BELCLASS", "belief", "ignorance"), ("FUZCLASS", "membership", "uncertainty")):
        first = {"BAYCLASS": "p", "BELCLASS": "b", "FUZCLASS": "m"}[n]
        add(n.lower(), lambda s, d, n=n, array=array, rest=rest, first=first: create(n)(px(s, d), sig(s, d)).select(*KEY, *(F.col(array)[k].alias(f"{first}{k + 1}") for k in range(5)), rest))
    for n in ("UNMIX", "HYPERUNMIX"):
        add(n.lower(), lambda s, d, n=n: create(n)(px(s, d), ends[:2]).select(*KEY, *(F.col("fractions")[k].alias(f"f{k + 1}") for k in range(2)), "residual"))
    add("hyperusp", lambda s, d: create("HYPERUSP")(px(s, d), ends[0][1]))
    add("hyperosp", lambda s, d: create("HYPEROSP")(px(s, d), ends[0][1], ends[1:2]))
    add("hyperabsorb", lambda s, d: create("HYPERABSORB")(px(s, d), [1.0, 2.0, 3.0], absorption_center=2.0))
    add("hyperautosig", lambda s, d: s.createDataFrame(create("HYPERAUTOSIG")(px(s, d), num_endmembers=3, projections=100), "number int, a array<double>"))
    add("screen", lambda s, d: create("SCREEN")(px(s, d)))
    add("cancor", lambda s, d: create("CANCOR")([grid(s, d, g) for g in "ac"], [grid(s, d, g) for g in "pq"], num_variates=2))
    add("sepsig", lambda s, d: s.createDataFrame(create("SEPSIG")(sig(s, d)), "a int, b int, bhattacharyya double, jm double"))
    add("sigcomp", lambda s, d: s.createDataFrame(create("SIGCOMP")(sig(s, d), sig(s, d)), "a int, b int, euclid double, divergence double, transformed double"))
    add("endsig", lambda s, d: s.createDataFrame(create("ENDSIG")(ends), "a int, b int, angle double, sid double"))
    case("knnregress", "KNNREGRESS", "apqs", None, lambda f, own: f(own[0], own[1:3], own[3]))
    add("purify_floor", lambda s, d: create("PURIFY")(px(s, d), labels(s, d), std_threshold=1.2, max_iterations=2, min_retain=0.85))
    case("logistic_reg", "LOGISTIC_REG", "spq", None, lambda f, own: f(own[0], own[1:]))
    case("transition_potential", "TRANSITION_POTENTIAL", "spq", None, lambda f, own: f([own[0]], own[1:]))
    case("transition_kernel", "TRANSITION_POTENTIAL", "spq", None, lambda f, own: f([own[0]], own[1:]), method="Kernel similarity")
    # A phase of minus pi is that of pi.
    case("fourier", "FOURIER", "a", None, lambda f, own: f(own[0]).withColumn("phase", F.when(F.col("phase") < -3.14159, math.pi).otherwise(F.col("phase"))))
    case("fourier_inverse", "FOURIER", "a", f" SELECT row, col, ROUND(v, 5) + 0.0 AS v FROM a", lambda f, own: f(f(own[0], direction="forward")).join(own[0].df.select(*KEY), KEY, "left_semi").select(*KEY, (F.round("v", 5) + F.lit(0.0)).alias("v")), direction="inverse")
    case("fourier_long_lines", "FOURIER", "a", None, lambda f, own: f(own[0]).withColumn("phase", F.when(F.col("phase") < -3.14159, math.pi).otherwise(F.col("phase"))), line_bound=16)
    case("filtfq", "FILTFQ", "b", None)
    case("filtfq_high", "FILTFQ", "b", None, filter_type="High-pass", cutoff_frequency=10.0, order=1)
    case("filtfq_band", "FILTFQ", "b", None, filter_type="Band-pass", cutoff_frequency=12.0, bandwidth=6.0)
    case("filtfreq", "FILTFREQ", "a", f" SELECT row, col, {R(f'v / (1 + POWER(SQRT(POWER(row - {SIZE / 2}, 2) + POWER(col - {SIZE / 2}, 2)) / 10, 4))')} FROM a", cutoff_frequency=10.0)
    case("drawfilt", "DRAWFILT", "a", f" SELECT row, col, CAST(CASE WHEN SQRT(POWER(col / {SIZE} - 0.5, 2) + POWER(row / {SIZE} - 0.5, 2)) <= 0.25 THEN 1 ELSE 0 END AS DOUBLE) AS v FROM (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM range({SIZE}) t(r), range({SIZE}) u(c))")
    case("freqdist", "FREQDIST", "ab", f" SELECT {R('SQRT(AVG(POWER(a.v - b.v, 2)))', 'rms')}, {R('CORR(a.v, b.v)', 'correlation')} FROM a JOIN b USING (row, col) WHERE b.v IS NOT NULL")
    for n, k in (("horizontal", "row"), ("vertical", "col")):
        case(f"destripe_{n}", "DESTRIPE", "b", f", s AS (SELECT {k}, AVG(v) AS m, STDDEV_POP(v) AS s FROM b GROUP BY 1), g AS (SELECT AVG(v) AS gm, STDDEV_POP(v) AS gs FROM b) SELECT row, col, {R('(v - m) / s * gs + gm')} FROM b JOIN s USING ({k}), g", direction=n)
    case("calibrate", "CALIBRATE", "ab", f", l AS (SELECT row, col, 0 AS band, v FROM a UNION ALL SELECT row, col, 1, v FROM b) SELECT row, col, band, {R('CASE WHEN band = 0 THEN 1.5 + 2 * v ELSE 0.5 + 3 * v END')} FROM l", lambda f, own: f(create("CONCAT")(own), own[0].df.sparkSession.createDataFrame([(0, 1.5, 2.0), (1, 0.5, 3.0)], "band int, offset double, gain double")))


def _files() -> None:
    case("xyz_round_trip", "XYZIDRIS", "b", " SELECT row, col, v FROM b WHERE v IS NOT NULL", lambda f, own: f(create("RASTERTOPOINT")(own[0]), rows=SIZE, cols=SIZE, cell=10.0))
    case("ascii_grid_round_trip", "ARCRASTER", "b", f" SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, v FROM range({SIZE}) t(r) CROSS JOIN range({SIZE}) u(c) LEFT JOIN b ON b.row = r AND b.col = c", lambda f, own: f(create("ASCII_GRID")(own[0])))
    text = lambda s, d: s.read.parquet(f"{d}/nation.parquet").select(F.concat_ws("  ", "n_nationkey", "n_regionkey").alias("value"))
    add("avl2csv", lambda s, d: create("AVL2CSV")(text(s, d)), "SELECT CAST(n_nationkey AS VARCHAR) AS ID, CAST(n_regionkey AS VARCHAR) AS Value FROM nation")
    add("csv2avl", lambda s, d: create("CSV2AVL")(s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name")), "SELECT CONCAT(n_nationkey, ' ', n_name) AS value FROM nation")
    lines = lambda s, d: s.read.parquet(f"{d}/nation.parquet").coalesce(1).select(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    add("csv2avl_lines", lambda s, d: create("CSV2AVL")(lines(s, d), value_column=2, has_header=False), "SELECT CONCAT(n_nationkey, ' ', n_regionkey) AS value FROM nation")
    add("crlf", lambda s, d: create("CRLF")(s.read.parquet(f"{d}/benchmark.parquet").select(F.concat("text", F.lit("\n")).alias("value"))), "SELECT REPLACE(REPLACE(text || chr(10), chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10)) AS value FROM benchmark")
    add("var2fix", lambda s, d: create("VAR2FIX")(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("value")), record_length=6), "SELECT RPAD(n_name, 6, ' ') AS value FROM nation")
    add("create_tsf", lambda s, d: create("CREATE_TSF")(s, start_date="2001-01-01", num_images=3), "SELECT * FROM (VALUES ('start_date: 2001-01-01'), ('interval: 1.0'), ('num_images: 3')) t(value)")
    add("collection", lambda s, d: create("COLLECTION_EDITOR")(s, ["a", "b"]), "SELECT * FROM (VALUES ('collection'), ('entries: 2'), ('a'), ('b')) t(value)")
    add("utmref", lambda s, d: s.createDataFrame([tuple(create("UTMREF")(min_lon=5.0, max_lon=9.0, min_lat=40.0, max_lat=44.0).values())], "zone int, hemisphere string, central_meridian int"), "SELECT 32 AS zone, 'N' AS hemisphere, 9 AS central_meridian")
    for name, op in (("tiff_round_trip", "GEOTIFF"), ("srfidris_round_trip", "SRFIDRIS")):

        def trip(s, d, op=op):
            g = grid(s, d, "b")
            return create(op)(create(op)(g, direction="export")).drop("path").join(g.df.select(*KEY), KEY, "left_semi")

        add(name, trip, with_grids("b", " SELECT row, col, 0 AS band, v FROM b"))
