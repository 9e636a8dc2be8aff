"""Models and tests on tables.

Sums over the data are aggregates; what is left for the driver has the size of a
coefficient table.
"""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def _beta_cf(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def t_p(t: float | None, df: float) -> float:
    """Two-sided p-value of a t statistic; NaN without one."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if t is not None and df > 0 and not math.isnan(t) else math.nan


def f_p(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def _coefficients(spark, names, estimates, errors, stats, ps) -> DataFrame:
    rows = [(n, float(e), float(s), float(t), float(p)) for n, e, s, t, p in zip(names, estimates, errors, stats, ps)]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, statistic double, p_value double")


def _terms(df: DataFrame) -> list[str]:
    """Names of a formula's columns in their vector's order."""
    attrs = df.schema["features"].metadata["ml_attr"]["attrs"]
    return [a["name"] for _, a in sorted((a["idx"], a) for kind in attrs.values() for a in kind)]


def linear_model(df: DataFrame, formula: str) -> tuple[DataFrame, object]:
    """(coefficients, model) by least squares; the intercept is the term ``(Intercept)``."""
    data = RFormula(formula=formula).fit(df).transform(df)
    model = LinearRegression(solver="normal").fit(data)
    s = model.summary
    names = [*_terms(data), "(Intercept)"]
    return _coefficients(df.sparkSession, names, [*model.coefficients, model.intercept], s.coefficientStandardErrors, s.tValues, s.pValues), model


def poisson_model(df: DataFrame, formula: str, exposure: str | None = None, quasi: bool = False, family: str = "poisson") -> tuple[DataFrame, float, object]:
    """(coefficients, dispersion, model) of a log-linear count model with log(exposure) as offset.

    The dispersion is deviance by residual degrees of freedom; a quasi model has
    its standard errors scaled by its root and t tests.
    """
    d = df.withColumn("_offset", F.log(exposure)) if exposure else df
    data = RFormula(formula=formula).fit(d).transform(d)
    g = GeneralizedLinearRegression(family=family, link="log", solver="irls", maxIter=100)
    if exposure:
        g = g.setOffsetCol("_offset")
    model = g.fit(data)
    s = model.summary
    dispersion = s.deviance / s.residualDegreeOfFreedom
    names, est, err = [*_terms(data), "(Intercept)"], [*model.coefficients, model.intercept], list(s.coefficientStandardErrors)
    scale = math.sqrt(dispersion) if quasi else 1.0
    stat = [e / (x * scale) for e, x in zip(est, err)]
    p = [t_p(t, s.residualDegreeOfFreedom) for t in stat] if quasi else list(s.pValues)
    return _coefficients(df.sparkSession, names, est, [x * scale for x in err], stat, p), dispersion, model


def spline_by_group(df: DataFrame, group: list[str], x: str, y: str, k: int = 3, ridge: float = 1e-8, pooled: bool = False) -> DataFrame:
    """(group, term, estimate, std_error, statistic, p_value): an own intercept and cubic regression spline of ``k`` knots for each group.

    Groups are fitted apart; each has its own residual scale, or, ``pooled``, all have the one of
    their residuals together, as the groups of one model have.  Smoothness is
    fixed by the knots (quantiles of x), not selected jointly, so standard errors
    are those of least squares on the spline's basis.
    """
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.dropna(subset=[x, y])
        keys = [pdf[g].iloc[0] for g in group]
        u = d[x].to_numpy(float)
        knots = np.unique(np.quantile(u, np.linspace(0, 1, k))) if len(u) else np.zeros(0)
        if len(knots) < 2:
            basis, names = np.ones((len(u), 1)), ["(Intercept)"]
        else:
            cube = lambda v: np.maximum(v, 0) ** 3
            part = lambda j: (cube(u - knots[j]) - cube(u - knots[-1])) / (knots[-1] - knots[j])
            cols = [np.ones_like(u), u - u.mean()] + [part(j) - part(len(knots) - 2) for j in range(len(knots) - 2)]
            basis, names = np.stack(cols, axis=1), ["(Intercept)", *(f"s({x}).{j}" for j in range(1, len(cols)))]
        inv = np.linalg.inv(basis.T @ basis + ridge * np.eye(basis.shape[1]))
        beta = inv @ basis.T @ d[y].to_numpy(float)
        free = len(u) - len(beta)
        rss = float(((d[y].to_numpy(float) - basis @ beta) ** 2).sum())
        return pd.DataFrame({**{g: v for g, v in zip(group, keys)}, "term": names, "estimate": beta, "_unit": np.diag(inv), "_rss": rss, "_free": max(0, free)})

    @F.pandas_udf("double")
    def two_sided(t: pd.Series, free: pd.Series) -> pd.Series:
        return pd.Series([t_p(float(a), float(b)) for a, b in zip(t, free)])

    kinds = dict(df.dtypes)
    fits = df.groupBy(*group).applyInPandas(run, ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", term string, estimate double, _unit double, _rss double, _free long")
    if pooled:  # one row
        one = fits.where("term = '(Intercept)'").agg(F.sum("_rss").alias("_rss"), F.sum("_free").alias("_free"))
        fits = fits.drop("_rss", "_free").crossJoin(one)
    err = F.sqrt(F.col("_unit") * F.try_divide(F.col("_rss"), F.col("_free")))
    out = fits.withColumn("std_error", F.coalesce(err, F.lit(math.nan))).withColumn("statistic", F.when(F.col("std_error") > 0, F.try_divide(F.col("estimate"), F.col("std_error"))).otherwise(F.lit(math.nan)))
    return out.withColumn("p_value", two_sided("statistic", "_free")).select(*group, "term", "estimate", "std_error", "statistic", "p_value")


def random_intercept(df: DataFrame, group: list[str], subject: str, y: str) -> DataFrame:
    """(group, mean, subject_var, residual_var, n_subjects, std_error): y ~ 1 + (1 | subject) in each group, by moments.

    For subjects with equally many rows this is the REML estimate (a negative
    between-subject variance counts as 0).
    """
    v = F.col(y)
    per = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*group, subject).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("s2"))
    g = per.groupBy(*group).agg(
        F.count("*").alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum((F.col("n") - 1) * F.col("s2")).alias("ssw"),
        F.sum(F.col("n") * F.col("m")).alias("sm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("smm"),
    )
    msw = F.try_divide(F.col("ssw"), F.col("N") - F.col("k"))
    msb = F.try_divide(F.col("smm") - F.col("sm") * F.col("sm") / F.col("N"), F.col("k") - 1)
    n0 = F.try_divide(F.col("N") - F.col("n2") / F.col("N"), F.col("k") - 1)
    between = F.greatest(F.lit(0.0), F.try_divide(msb - msw, n0))
    mean = F.col("sm") / F.col("N")
    return g.select(*group, mean.alias("mean"), between.alias("subject_var"), msw.alias("residual_var"), F.col("k").alias("n_subjects"), F.sqrt(between / F.col("k") + msw / F.col("N")).alias("std_error"))


def mixed_model(df: DataFrame, subject: str, y: str, x: list[str]) -> DataFrame:
    """(term, estimate, std_error, statistic, subject_var, residual_var): y ~ 1 + x + (1 | subject) for numeric columns x (a group is its 0/1 columns).

    Variances by moments (the within-subject residual; the excess of the pooled one, at least 0), then generalised least
    squares.  One aggregate by subject makes all sums of products, and a second one adds
    them up; the driver solves systems of the size of the coefficients.  Rows with a missing value are left out.
    """
    import numpy as np

    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in x), F.col(y).cast("double")]
    p, m = len(x) + 1, len(cols)
    full = F.lit(True)
    for c in cols[1:]:
        full = full & c.isNotNull() & ~F.isnan(c)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    per = df.where(full).groupBy(subject).agg(*(F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i, j in pairs))
    mean = lambda i, j: F.col(f"s0_{i}") * F.col(f"s0_{j}")  # noqa: E731  sums of a subject's columns

    def matrix(of) -> tuple[np.ndarray, int]:
        row = per.agg(*(F.sum(of(i, j)).alias(f"m{i}_{j}") for i, j in pairs), F.count("*").alias("k")).first()
        a = np.zeros((m, m))
        for i, j in pairs:
            a[i, j] = a[j, i] = row[f"m{i}_{j}"] or 0.0
        return a, row["k"]

    total, k = matrix(lambda i, j: F.col(f"s{i}_{j}"))
    within, _ = matrix(lambda i, j: F.col(f"s{i}_{j}") - mean(i, j) / F.col("s0_0"))
    squares, _ = matrix(mean)
    n, varying = total[0, 0], [i for i in range(1, p) if within[i, i] > 1e-9 * max(1.0, total[i, i])]
    wx, wy = within[np.ix_(varying, varying)], within[varying, -1]
    rank = int(np.linalg.matrix_rank(wx)) if varying else 0
    residual = (within[-1, -1] - (wy @ np.linalg.pinv(wx) @ wy if varying else 0.0)) / max(1.0, n - k - rank)
    inv = np.linalg.pinv(total[:p, :p])
    rss = total[-1, -1] - total[:p, -1] @ inv @ total[:p, -1]
    between = max(0.0, (rss - (n - p) * residual) / max(1e-12, n - np.trace(inv @ squares[:p, :p])))
    shrink = F.lit(between) / (F.lit(residual) + F.col("s0_0") * F.lit(between)) if residual + between > 0 else F.lit(0.0)
    gls, _ = matrix(lambda i, j: F.col(f"s{i}_{j}") - shrink * mean(i, j))
    inv = np.linalg.pinv(gls[:p, :p])
    beta, err = inv @ gls[:p, -1], np.sqrt(np.maximum(np.diag(inv), 0) * residual)
    rows = [(t, float(b), float(e), float(b / e) if e > 0 else math.nan, float(between), float(residual)) for t, b, e in zip(["(Intercept)", *x], beta, err)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, statistic double, subject_var double, residual_var double")


def nested_anova(small, large) -> tuple[float, float, float]:
    """(F, p, extra terms) of two nested linear models on the same rows."""
    a, b = small.summary, large.summary
    rss = [s.meanSquaredError * s.numInstances for s in (a, b)]
    extra = a.degreesOfFreedom - b.degreesOfFreedom
    f = (rss[0] - rss[1]) / extra / (rss[1] / b.degreesOfFreedom)
    return f, f_p(f, extra, b.degreesOfFreedom), extra


def residuals(model, df: DataFrame, formula: str, y: str) -> DataFrame:
    """The rows with ``prediction`` and ``residual``."""
    data = RFormula(formula=formula).fit(df).transform(df)
    return model.transform(data).withColumn("residual", F.col(y) - F.col("prediction"))


def paired(df: DataFrame, subject: str, condition: str, value: str, conditions: list) -> DataFrame:
    """(a, b, n, mean_diff, sd_diff, t): every pair of conditions on the subjects that have a value in both; one pivot, one aggregate."""
    wide = df.groupBy(subject).pivot(condition, conditions).agg(F.avg(F.when(~F.isnan(value), F.col(value))))
    aggs = []
    for i, (a, b) in enumerate(combinations(conditions, 2)):
        d = F.col(f"`{a}`") - F.col(f"`{b}`")
        aggs += [F.count(d).alias(f"n{i}"), F.avg(d).alias(f"m{i}"), F.stddev_samp(d).alias(f"s{i}")]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean_diff"), F.col(f"s{i}").alias("sd_diff")) for i, (a, b) in enumerate(combinations(conditions, 2))]
    out = wide.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return out.withColumn("t", F.try_divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt(F.col("n").cast("double"))))


def paired_p(tests: DataFrame) -> DataFrame:
    """Paired tests with their two-sided p-values; a row a pair of conditions."""
    rows = [(r.a, r.b, t_p(r.t, r.n - 1)) for r in tests.collect()]
    kind = dict(tests.dtypes)["a"]
    return tests.join(tests.sparkSession.createDataFrame(rows, f"a {kind}, b {kind}, p double"), ["a", "b"])


def holm(tests: DataFrame, p: str = "p", order: list[str] = ["a", "b"], family: list[str] = []) -> DataFrame:  # noqa: B006
    """``p_holm``: p-values corrected step by step for the number of tests of their family.

    A family is one window partition; without family columns all tests are one, as a table of comparisons is.
    """
    by = Window.partitionBy(*(family or [F.lit(0)]))
    w = by.orderBy(p, *order)
    raw = F.least(F.lit(1.0), F.col(p) * (F.count(p).over(by) - F.row_number().over(w) + 1))
    return tests.where(F.col(p).isNotNull()).withColumn("_q", raw).withColumn("p_holm", F.max("_q").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_q")


def rm_anova(df: DataFrame, subject: str, condition: str, value: str) -> DataFrame:
    """(f, df_condition, df_error): repeated-measures ANOVA of one factor on subjects that have every condition."""
    cell = df.groupBy(subject, condition).agg(F.avg(value).alias("v"))
    k = cell.agg(F.count_distinct(condition).alias("k"))
    of_subject = Window.partitionBy(subject)
    whole = cell.withColumn("_c", F.count("v").over(of_subject)).withColumn("_s", F.avg("v").over(of_subject)).crossJoin(k).where("_c = k")
    means = whole.groupBy(condition).agg(F.avg("v").alias("_m"))
    grand = means.agg(F.avg("_m").alias("_g"))  # every subject has every condition
    x = whole.join(means, condition).crossJoin(grand)
    s = x.agg(F.sum(F.pow(F.col("_m") - F.col("_g"), 2)).alias("ssc"), F.sum(F.pow(F.col("v") - F.col("_s") - F.col("_m") + F.col("_g"), 2)).alias("sse"), F.count_distinct(subject).alias("n"), F.max("k").alias("k"))
    d1, d2 = F.col("k") - 1, (F.col("k") - 1) * (F.col("n") - 1)
    return s.select(F.try_divide(F.try_divide(F.col("ssc"), d1), F.try_divide(F.col("sse"), d2)).alias("f"), d1.alias("df_condition"), d2.alias("df_error"))
