"""Fits from sufficient statistics (M3-M5, M7-M10, M12, M15, M18, M20). Linear fits: one aggregation makes the Gram matrix, whose size is that of the
features, and only it is collected. Likelihood fits: Newton steps whose sums are taken where the rows are."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import placed
from .resampling import multinomial


@dataclass
class Ols:
    coef: np.ndarray
    std_err: np.ndarray
    t: np.ndarray
    p: np.ndarray
    r2: float
    df: int


@dataclass
class Gram:
    """Sums of products of (1, x - centre, y - centre), whole and for each value of ``by``. The centre is the mean of all rows, so large means don't
    cancel."""

    centre: np.ndarray
    parts: dict

    @property
    def total(self) -> np.ndarray:
        return sum(self.parts.values())


def gram(df: DataFrame, x: list[str], y: str, by: Column | None = None) -> Gram | None:
    """Rows with a null are left out; None without rows."""
    rows = df.dropna(subset=[*x, y])
    means = rows.agg(*(F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate([*x, y]))).first()
    if means[0] is None:
        return None
    centre = np.array(means, float)
    cols = [F.lit(1.0), *(F.col(c).cast("double") - F.lit(float(m)) for c, m in zip([*x, y], centre))]
    n = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]
    found = rows.groupBy((by if by is not None else F.lit(0)).alias("_by")).agg(*sums).collect()
    parts = {}
    for r in found:
        g = np.zeros((n, n))
        for i in range(n):
            for j in range(i, n):
                g[i, j] = g[j, i] = r[f"s{i}_{j}"] or 0.0
        parts[r["_by"]] = g
    return Gram(centre, parts)


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        k = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + k * d, 1e-300) if 1 + k * d > 0 else 1 / min(1 + k * d, -1e-300)
        c = 1 + k / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: int) -> float:
    return beta_fraction(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def solve(g: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Minimum-norm coefficients of the uncentred design (intercept first), its pseudo-inverse, rank and squared error, for designs that may be
    collinear. g: sums of the centred design."""
    xx, xy, p = g[:-1, :-1], g[:-1, -1], len(g) - 1
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1))
    values, vectors = np.linalg.eigh(xx / np.outer(scale, scale))
    kept = values > 1e-9 * max(values.max(initial=0), 1)
    inner = (vectors[:, kept] / values[kept]) @ vectors[:, kept].T / np.outer(scale, scale)
    b = inner @ xy
    sse = max(g[-1, -1] - xy @ b, 0.0)
    # Back to the uncentred design: the intercept moves by the means; what the design can't tell apart is taken out.
    back = np.eye(p)
    back[0, 1:] = -centre[:-1]
    null = back @ (vectors[:, ~kept] / scale[:, None])
    own = np.eye(p) - null @ np.linalg.pinv(null) if null.size else np.eye(p)
    coef = back @ b
    coef[0] += centre[-1]
    return own @ coef, own @ back @ inner @ back.T @ own, int(kept.sum()), float(sse)


def ols(df: DataFrame, x: list[str], y: str) -> Ols:
    """M3."""
    found = gram(df, x, y)
    if found is None:
        raise ValueError("no rows to fit")
    g = found.total
    coef, inverse, rank, sse = solve(g, found.centre)
    n = g[0, 0]
    sst = g[-1, -1] - g[0, -1] ** 2 / n
    free = int(n - rank)
    err = np.sqrt(np.maximum(np.diag(inverse) * sse / max(free, 1), 0))
    t = np.divide(coef, err, out=np.zeros_like(coef), where=err > 0)
    return Ols(coef, err, t, np.array([t_two_sided(v, free) for v in t]), 1 - sse / sst if sst > 0 else float("nan"), free)


def t_quantile(p: float, df: int) -> float:
    """Two-sided critical value of Student's t: P(|T| > t) = p, by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > p else (lo, mid)
    return (lo + hi) / 2


def ols_table(df: DataFrame, x: list[str], y: str, alpha: float = 0.05) -> list[tuple[str, float, float, float, float, float, float]]:
    """M3: (term, coefficient, standard error, t, p, confidence bounds), the intercept first."""
    fit = ols(df, x, y)
    wide = t_quantile(alpha, fit.df) * fit.std_err
    return [(n, *(float(v) for v in row)) for n, row in zip(["intercept", *x], np.column_stack([fit.coef, fit.std_err, fit.t, fit.p, fit.coef - wide, fit.coef + wide]))]


def _predict(x: list[str], coef: np.ndarray) -> Column:
    out = F.lit(float(coef[0]))
    for c, w in zip(x, coef[1:]):
        out = out + F.lit(float(w)) * F.col(c)
    return out


def kfold_predictions(df: DataFrame, x: list[str], y: str, fold: Column, k: int) -> DataFrame:
    """M4: each row predicted by the model of the other folds, whose sums are the total less its fold's: the data are read twice for the fit, whatever
    the number of folds."""
    found = gram(df, x, y, fold)
    out = F.lit(None).cast("double")
    for f, g in found.parts.items() if found else []:
        rest = found.total - g
        if rest[0, 0] > 0.5:
            out = F.when(fold == f, _predict(x, solve(rest, found.centre)[0])).otherwise(out)
    return df.withColumn("prediction", out)


def _descend(xx: np.ndarray, xy: np.ndarray, alpha: float, w: np.ndarray, rounds: int = 500) -> np.ndarray:
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            r = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            w[j] = math.copysign(max(abs(r) - alpha, 0), r) / xx[j, j] if xx[j, j] > 0 else 0.0
        if np.abs(w - before).max(initial=0) < 1e-10 * (1 + np.abs(w).max(initial=0)):
            break
    return w


def _centered(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    n = g[0, 0]
    m = g[0, 1:] / n
    c = g[1:, 1:] / n - np.outer(m, m)
    return c[:-1, :-1], c[:-1, -1], m, n


def lasso(df: DataFrame, x: list[str], y: str, n_alphas: int = 50, folds: int = 5) -> list[tuple[float, int, float]]:
    """M5: coordinate descent on the Gram matrix over a grid of penalties: (alpha, kept features, cross-validated RMSE), largest penalty first."""
    found = gram(df, x, y, F.pmod(F.xxhash64(*x, y), F.lit(folds)))
    if found is None:
        return []
    parts, total = found.parts, found.total
    xx, xy, _, _ = _centered(total)
    top = float(np.abs(xy).max())
    out, w = [], np.zeros(len(x))
    state = {f: np.zeros(len(x)) for f in parts}
    for alpha in np.geomspace(top, top * 1e-3, n_alphas) if top > 0 else []:
        w = _descend(xx, xy, alpha, w)
        sse = 0.0
        for f, g in parts.items():
            a, b, m, _ = _centered(total - g) if len(parts) > 1 else _centered(total)
            v = state[f] = _descend(a, b, alpha, state[f])
            full = np.concatenate([[m[-1] - m[:-1] @ v], v])
            sse += g[-1, -1] - 2 * full @ g[:-1, -1] + full @ g[:-1, :-1] @ full
        out.append((float(alpha), int((np.abs(w) > 1e-10).sum()), float(math.sqrt(max(sse, 0) / total[0, 0]))))
    return out


def balanced_logit(df: DataFrame, x: list[str], y: str, l1: bool = False, c: float = 1.0) -> DataFrame:
    """Multinomial logit with class weights n / (K n_c) and penalty 1 / (C n); adds ``prediction``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = {r[0]: r[1] for r in df.groupBy(y).count().collect()}
    n = sum(counts.values())
    weight = F.lit(None).cast("double")
    for v, k in counts.items():
        weight = F.when(F.col(y) == v, n / (len(counts) * k)).otherwise(weight)
    data = VectorAssembler(inputCols=x, outputCol="_x").transform(df.dropna(subset=[*x, y])).withColumn("_w", weight).withColumn("_y", F.col(y).cast("double"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", family="multinomial", regParam=1 / (c * n), elasticNetParam=1.0 if l1 else 0.0, standardization=False, maxIter=100).fit(data)
    return model.transform(data).drop("_x", "_w", "_y", "rawPrediction", "probability")


#: Cumulative probabilities of Poisson(1).
POISSON_CUTS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10)]


#: A prime below 2**31, so that squares fit into 64 bits.
_PRIME = (1 << 31) - 1


def _draws(keys: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """Poisson(1) weights (rows x rounds) by a hash of key and round that any engine with whole numbers can work out."""
    h, b = keys[:, None], rounds[None, :]
    x = (h * 48271 + b * 16807 + 1) % _PRIME
    for add in (b + 7, h, b * 31 + 3):
        x = (x * x + add) % _PRIME
    return np.searchsorted(POISSON_CUTS, x / _PRIME, side="right").astype(float)


def bootstrap_means(df: DataFrame, key: str, group: str, value: str, rounds: int) -> DataFrame:
    """Intervals of group means by resampling: each row has a Poisson(1) weight in each round, drawn by hash of its whole-number key and the round. Each
    batch of rows gives one sum for each group and round, so rounds copy no rows. Returns the group's mean over rounds and its 95 % interval. Rows
    without a value are left out; a round that draws no row of a group doesn't count for it."""
    kind, each_round = df.schema[group].dataType.simpleString(), np.arange(rounds, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(0).dictionary_encode(null_encoding="encode")
            inside = np.zeros((len(groups.dictionary), batch.num_rows))
            inside[groups.indices.to_numpy(), np.arange(batch.num_rows)] = 1
            w, v = _draws(batch.column(1).to_numpy(), each_round), batch.column(2).to_numpy()
            columns = [groups.dictionary.take(pa.array(np.repeat(np.arange(len(inside)), rounds))), *(pa.array(c) for c in (np.tile(each_round, len(inside)), (inside @ w).ravel(), (inside @ (w * v[:, None])).ravel()))]
            yield pa.RecordBatch.from_arrays(columns, [group, "_b", "_w", "_s"])

    rows = df.where(F.col(value).isNotNull()).select(group, F.pmod(F.col(key).cast("long"), F.lit(_PRIME)).alias("_h"), F.col(value).cast("double").alias("_v"))
    sums = rows.mapInArrow(run, f"`{group}` {kind}, _b long, _w double, _s double").groupBy(group, "_b").agg((F.sum("_s") / F.nullif(F.sum("_w"), F.lit(0.0))).alias("m"))
    return sums.where("m IS NOT NULL").groupBy(group).agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"))


def _log_cdf(z: np.ndarray) -> np.ndarray:
    """Logarithm of the normal distribution function, by its asymptotic series where the function itself underflows."""
    low = z < -30
    near = np.log(0.5 * np.frompyfunc(math.erfc, 1, 1)(-np.where(low, 0, z) / math.sqrt(2)).astype(float))
    v = np.where(low, z, -30.0)
    square = np.minimum(v * v, 1e150)
    return np.where(low, -0.5 * v * v - np.log(-v) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / square + 3 / square**2), near)


def _interval(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log P of lo < normal <= hi, and the densities at lo and at hi over P. Edges may be infinite."""
    flip = lo > 0
    # In the upper half the mirrored interval, whose logarithms are exact.
    a, b = np.where(flip, -lo, hi), np.where(flip, -hi, lo)
    top, bottom = (np.where(np.isposinf(v), 0.0, np.where(np.isneginf(v), -np.inf, _log_cdf(np.clip(v, -1e150, 1e150)))) for v in (a, b))
    log_p = top + np.log1p(-np.exp(np.minimum(bottom - top, -1e-300)))
    at = [np.exp(np.where(np.isinf(v), -np.inf, -0.5 * np.where(np.isinf(v), 0, v) ** 2 - 0.5 * math.log(2 * math.pi)) - log_p) for v in (lo, hi)]
    return log_p, at[0], at[1]


def _probit_sums(k: np.ndarray, z: np.ndarray, w: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Log-likelihood, gradient and Hessian by (weights, thresholds) of rows of classes k, as one vector."""
    eta, edges, n = z @ w, np.concatenate([[-np.inf], tau, [np.inf]]), len(w) + len(tau)
    hi, lo = edges[k + 1] - eta, edges[k] - eta
    log_p, r_lo, r_hi = _interval(lo, hi)
    wide = np.zeros((len(k), len(tau) + 2))
    above, below = np.hstack([-z, wide]), np.hstack([-z, wide])
    rows = np.arange(len(k))
    above[rows, len(w) + 1 + k], below[rows, len(w) + k] = 1, 1
    # The outermost edges are no parameters.
    cut = [*range(len(w)), *range(len(w) + 1, len(w) + 1 + len(tau))]
    above, below = above[:, cut], below[:, cut]
    h_hi = -np.where(np.isinf(hi), 0, hi) * r_hi - r_hi**2
    h_lo = np.where(np.isinf(lo), 0, lo) * r_lo - r_lo**2
    mixed = (above * (r_hi * r_lo)[:, None]).T @ below
    hessian = (above * h_hi[:, None]).T @ above + (below * h_lo[:, None]).T @ below + mixed + mixed.T
    return np.concatenate([[log_p.sum()], r_hi @ above - r_lo @ below, hessian.reshape(n * n)])


def _summed(rows: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows (arrays of doubles) of what the kernel gives for a batch of them; tasks send one vector each, which meet by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = kernel(np.array(batch.column(0).flatten()).reshape(batch.num_rows, -1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["i", "v"])

    found = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r.v for r in found])


@dataclass
class OrderedProbit:
    """weights are of standardised features."""

    x: list[str]
    classes: list
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    log_likelihood: float


def fit_ordered_probit(df: DataFrame, x: list[str], y: str, steps: int = 100) -> OrderedProbit | None:
    """M8: maximum likelihood on the values by Newton steps, whose sums are taken where the rows are; the driver holds what has the size of the
    Hessian. Rows with a null are left out. None for fewer than two classes; raises if it does not converge (as for classes that can be separated)."""
    from statistics import NormalDist

    rows = df.dropna(subset=[*x, y])
    counts = sorted((r["_y"], r["_n"]) for r in rows.groupBy(F.col(y).alias("_y")).agg(F.count("*").alias("_n")).collect())
    if len(counts) < 2:
        return None
    classes, n = [c for c, _ in counts], np.array([k for _, k in counts], float)
    m = rows.agg(*(F.avg(c) for c in x), *(F.stddev_pop(c) for c in x)).first()
    mean, scale = np.array(m[: len(x)], float), np.array([v or 1.0 for v in m[len(x) :]], float)
    place = F.lit(None).cast("double")
    for i, c in enumerate(classes):
        place = F.when(F.col(y) == F.lit(c), float(i)).otherwise(place)
    data = rows.select(F.array(place, *((F.col(c).cast("double") - F.lit(float(mean[i]))) / F.lit(float(scale[i])) for i, c in enumerate(x))).alias("_r")).persist()
    try:
        at = np.concatenate([np.zeros(len(x)), [NormalDist().inv_cdf(v) for v in np.cumsum(n)[:-1] / n.sum()]])
        step, best, p = np.zeros(len(at)), -np.inf, len(at)
        for _ in range(steps):
            trial = at + step
            w, tau = trial[: len(x)], trial[len(x) :]
            # Thresholds out of order have no likelihood.
            sums = _summed(data, lambda r, w=w, tau=tau: _probit_sums(r[:, 0].astype(int), r[:, 1:], w, tau)) if (np.diff(tau) > 0).all() else np.array([-np.inf])
            if not np.isfinite(sums).all() or sums[0] < best - 1e-9 * (1 + abs(best)):
                step = step / 2
                if not step.any():
                    break
                continue
            at, best, g, h = trial, sums[0], sums[1 : p + 1], sums[p + 1 :].reshape(p, p)
            step = np.linalg.pinv(-h, rcond=1e-12, hermitian=True) @ g
            if g @ step < 1e-16 * n.sum() + 1e-18 or np.abs(step).max() < 1e-9:
                return OrderedProbit(x, classes, mean, scale, at[: len(x)], at[len(x) :], float(best))
    finally:
        data.unpersist()
    raise RuntimeError(f"ordered probit did not converge in {steps} steps")


def ordered_probit(df: DataFrame, x: list[str], y: str, steps: int = 100) -> list[tuple[str, float]]:
    """M8's coefficients: weights of the standardised features and thresholds, named by the class below."""
    fit = fit_ordered_probit(df, x, y, steps)
    return [] if fit is None else [(f"weight_{c}", v) for c, v in zip(x, fit.weights)] + [(f"threshold_{c}", v) for c, v in zip(fit.classes, fit.thresholds)]


def _standardised(fit: OrderedProbit) -> list[Column]:
    return [(F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(fit.x, fit.mean, fit.scale)]


def _linear(fit: OrderedProbit) -> Column:
    """x beta of a row."""
    return sum((F.lit(float(w)) * z for w, z in zip(fit.weights, _standardised(fit))), F.lit(0.0))


def predict_ordered(df: DataFrame, fit: OrderedProbit) -> DataFrame:
    """M8: the most likely class of each row (ties: the lower), as ``prediction``; null where a feature is null.

    With normal errors the likeliest class changes at one point between two neighbouring classes as x beta rises, unless a class is never the
    likeliest; the points are found on the driver, so rows need comparisons only."""
    edges = np.concatenate([[-np.inf], fit.thresholds, [np.inf]])
    log_p = lambda eta: np.array([_interval(edges[k : k + 1] - eta, edges[k + 1 : k + 2] - eta)[0][0] for k in range(len(edges) - 1)])
    best = lambda eta: int(np.argmax(log_p(eta)))
    span = float(np.abs(fit.thresholds).max(initial=0)) + 10
    grid = np.linspace(-span, span, 4001)
    found = [best(e) for e in grid]
    steps = []
    for i in np.flatnonzero(np.diff(found)):
        lo, hi = grid[i], grid[i + 1]
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if best(mid) == found[i] else (lo, mid)
        steps.append((hi, found[i + 1]))
    eta, out = _linear(fit), F.lit(fit.classes[found[0]])
    for cut, k in steps:
        out = F.when(F.col("_eta") >= float(cut), F.lit(fit.classes[k])).otherwise(out)
    return df.withColumn("_eta", eta).withColumn("prediction", F.when(F.col("_eta").isNotNull(), out)).drop("_eta")


def marginal_effects(df: DataFrame, fit: OrderedProbit) -> DataFrame:
    """M9: class, feature, effect: the mean over rows of (density at the class's lower edge less that at its upper edge) times the feature's weight, on
    standardised features. Rows with a null feature are left out. One aggregation of as many sums as there are classes."""
    edges = [None, *fit.thresholds.tolist(), None]
    density = lambda e: F.lit(0.0) if e is None else F.exp(-(F.lit(float(e)) - F.col("_eta")) * (F.lit(float(e)) - F.col("_eta")) / 2) / math.sqrt(2 * math.pi)
    rows = df.dropna(subset=fit.x).select(_linear(fit).alias("_eta"))
    means = rows.agg(*(F.avg(density(edges[k]) - density(edges[k + 1])).alias(f"m{k}") for k in range(len(fit.classes))))
    each = [F.struct(F.lit(c).alias("class"), F.lit(x).alias("feature"), (F.col(f"m{k}") * float(w)).alias("effect")) for k, c in enumerate(fit.classes) for x, w in zip(fit.x, fit.weights)]
    return means.select(F.inline(F.array(*each)))


def l1_path(df: DataFrame, x: list[str], y: str, cs: list[float] = (0.01, 0.1, 1.0, 10.0, 100.0)) -> list[tuple[float, float, float, int]]:
    """For each C an L1-penalised multinomial logit on standardised features: (C, accuracy, adjacent accuracy of ordinal classes, features with a
    weight other than 0 in some class)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from .features import standardize

    rows = standardize(df.dropna(subset=[*x, y]), x)
    data = VectorAssembler(inputCols=x, outputCol="_x").transform(rows).select("_x", F.col(y).cast("double").alias("_y")).persist()
    n, out = data.count(), []
    try:
        for c in cs if n else []:
            model = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", regParam=1 / (c * n), elasticNetParam=1.0, standardization=False, maxIter=200, tol=1e-9).fit(data)
            d = F.abs(F.col("_y") - F.col("prediction"))
            r = model.transform(data).agg(F.avg((d == 0).cast("double")), F.avg((d <= 1).cast("double"))).first()
            out.append((float(c), r[0], r[1], int((np.abs(model.coefficientMatrix.toArray()) > 1e-5).any(0).sum())))
    finally:
        data.unpersist()
    return out


#: Rounds whose sums one task holds at once.
ROUNDS = 64


def _softmax(z: np.ndarray, theta: np.ndarray) -> np.ndarray:
    s = z @ theta.T
    s -= s.max(1, keepdims=True)
    e = np.exp(s)
    return e / e.sum(1, keepdims=True)


def _logit_sums(k: np.ndarray, places: np.ndarray, z: np.ndarray, sizes: list[int], rounds: np.ndarray, thetas: np.ndarray, balance: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the weighted loss for each round. thetas: rounds x classes x (1 + features); balance: rounds x classes."""
    w, (r, c, p) = multinomial(k, places, sizes, rounds), thetas.shape
    out = []
    for b in range(r):
        s = w[:, b] * balance[b][k]
        prob = _softmax(z, thetas[b])
        miss = prob.copy()
        miss[np.arange(len(k)), k] -= 1
        grad = (miss * s[:, None]).T @ z
        hess = np.zeros((c, p, c, p))
        for i in range(c):
            for j in range(i, c):
                v = s * prob[:, i] * ((i == j) - prob[:, j])
                hess[i, :, j, :] = hess[j, :, i, :] = (z * v[:, None]).T @ z
        out += [grad.ravel(), hess.ravel()]
    return np.concatenate(out)


@dataclass
class Bootstrap:
    """classes and their rows, features; thetas: rounds x classes x (1 + standardised features), intercept first, the plain fit before them; the mean and
    scale; steps that did not settle, by round (-1: the plain fit)."""

    x: list[str]
    classes: list
    sizes: list[int]
    mean: np.ndarray
    scale: np.ndarray
    plain: np.ndarray
    thetas: np.ndarray
    open_rounds: list[int]


def _rows(df: DataFrame, key: str, x: list[str], y: str, classes: list, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """_key and _r: class, place among the rows of the class (by a hash of the key), 1, standardised features."""
    place = F.lit(None).cast("double")
    for i, c in enumerate(classes):
        place = F.when(F.col(y) == F.lit(c), float(i)).otherwise(place)
    z = [(F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(x, mean, scale)]
    own = df.select(F.col(key).alias("_key"), F.array(place, F.lit(1.0), *z).alias("_z"))
    own = placed(own.withColumn("_class", F.col("_z")[0]), [F.xxhash64("_key"), F.col("_key"), F.col("_z")], "_at", ["_class"])
    return own.select("_key", F.concat(F.slice("_z", 1, 1), F.array(F.col("_at").cast("double")), F.slice("_z", 2, len(x) + 1)).alias("_r"))


def bootstrap_logit(df: DataFrame, key: str, x: list[str], y: str, rounds: int, c: float = 1.0, steps: int = 50, tolerance: float = 1e-8) -> Bootstrap | None:
    """Balanced multinomial logits (penalty as in M7) on resampled rows, all rounds at once. Each round draws from every class as many rows as it has,
    with replacement; a row's count is found where the row is (``resampling.multinomial``), so rounds need no copies of the data. Each Newton step of
    ``ROUNDS`` rounds reads the data once and sends the driver one gradient and Hessian for each round.

    Features are standardised over all rows. Rows with a null are left out; keys tell rows apart. None for fewer than two classes. Rounds that do not
    converge in ``steps`` keep their last weights and are listed in ``open_rounds``."""
    rows = df.dropna(subset=[*x, y])
    counted = sorted(tuple(r) for r in rows.groupBy(y).agg(F.count("*")).collect())
    classes, sizes = [c for c, _ in counted], [n for _, n in counted]
    if len(classes) < 2:
        return None
    m = rows.agg(*(F.avg(v) for v in x), *(F.stddev_pop(v) for v in x)).first()
    mean, scale = np.array(m[: len(x)], float), np.array([v or 1.0 for v in m[len(x) :]], float)
    data, k, p, found = _rows(rows, key, x, y, classes, mean, scale).select("_r").persist(), len(classes), len(x) + 1, []
    # Each class keeps its own size in every round, so its balanced weight is the same: n over classes times its rows.
    one, settled_not = np.array([sum(sizes) / (k * n) for n in sizes]), []
    try:
        for lo in range(-1, rounds, ROUNDS):
            block = np.arange(lo, min(lo + ROUNDS, rounds))
            balance = np.tile(one, (len(block), 1))
            thetas, open_ = np.zeros((len(block), k, p)), np.arange(len(block))
            penalty = np.tile(np.append(0.0, np.ones(p - 1) / c), k)
            for _ in range(steps):
                sums = _summed(data, lambda r, at=open_, t=thetas, block=block, balance=balance: _logit_sums(r[:, 0].astype(int), r[:, 1], r[:, 2:], sizes, block[at], t[at], balance[at]))
                sums = sums.reshape(len(open_), k * p + (k * p) ** 2)
                left = []
                for b, row in zip(open_, sums):
                    grad = row[: k * p] + penalty * thetas[b].ravel()
                    hess = row[k * p :].reshape(k * p, k * p) + np.diag(penalty)
                    move = np.linalg.pinv(hess, rcond=1e-12, hermitian=True) @ grad
                    # A long step is cut, as far from the optimum the quadratic is no guide.
                    longest = np.abs(move).max()
                    thetas[b] -= (move * min(1.0, 4.0 / longest if longest > 0 else 1.0)).reshape(k, p)
                    if longest > tolerance:
                        left.append(b)
                open_ = np.array(left, int)
                if not len(open_):
                    break
            settled_not += [int(b) for b in block[open_]]
            found.append(thetas)
    finally:
        data.unpersist()
    all_ = np.concatenate(found)
    return Bootstrap(x, classes, sizes, mean, scale, all_[0], all_[1:], settled_not)


def bootstrap_intervals(fit: Bootstrap, alpha: float = 0.05) -> list[tuple[str, object, float, float, float]]:
    """(feature, class, coefficient of the plain fit, bounds over the rounds), and for each pair of neighbouring classes the bounds of the difference
    under the class name 'lower->higher'."""
    out = []
    for f, name in enumerate(fit.x, 1):
        each = fit.thetas[:, :, f]
        for i, c in enumerate(fit.classes):
            out.append((name, str(c), float(fit.plain[i, f]), *(float(v) for v in np.nanpercentile(each[:, i], [100 * alpha / 2, 100 * (1 - alpha / 2)]))))
        for i, (a, b) in enumerate(zip(fit.classes, fit.classes[1:])):
            d = each[:, i + 1] - each[:, i]
            out.append((name, f"{a}->{b}", float(fit.plain[i + 1, f] - fit.plain[i, f]), *(float(v) for v in np.nanpercentile(d, [100 * alpha / 2, 100 * (1 - alpha / 2)]))))
    return out


def out_of_bag(df: DataFrame, fit: Bootstrap, key: str, y: str) -> DataFrame:
    """Key, actual, vote (index of the class that most rounds which left the row out predict; ties: the one predicted first), n_votes. Rows
    that no round left out are not returned. A map over the rows: no round copies them."""
    rows = _rows(df.dropna(subset=[*fit.x, y]), key, fit.x, y, fit.classes, fit.mean, fit.scale)
    kind, thetas, sizes = df.schema[key].dataType.simpleString(), fit.thetas, fit.sizes
    rounds, classes = np.arange(len(thetas)), len(fit.classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            left = multinomial(r[:, 0].astype(int), r[:, 1], sizes, rounds) == 0
            votes, first = np.zeros((len(r), classes)), np.full((len(r), classes), len(rounds) + 1.0)
            for b in rounds:
                s = r[:, 2:] @ thetas[b].T
                at = np.flatnonzero(left[:, b])
                said = s[at].argmax(1)
                votes[at, said] += 1
                first[at, said] = np.minimum(first[at, said], b)
            best = (votes - first / (len(rounds) + 2)).argmax(1)
            some = pa.array(np.flatnonzero(left.any(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), *(pa.array(v.astype(np.int64)).take(some) for v in (r[:, 0], best, left.sum(1)))], [key, "actual", "vote", "n_votes"])

    return rows.mapInArrow(run, f"`{key}` {kind}, actual long, vote long, n_votes long")


def compare_models(designs: dict[str, tuple[DataFrame, list[str]]], y: str) -> list[tuple[str, int, int, float, float]]:
    """For each named design (rows, features) a least-squares fit: (name, rows, features, R2, RMSE), in the order given."""
    out = []
    for name, (df, x) in designs.items():
        found = gram(df, x, y)
        if found is None:
            out.append((name, 0, len(x), float("nan"), float("nan")))
            continue
        g = found.total
        _, _, _, sse = solve(g, found.centre)
        sst = g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
        out.append((name, int(round(g[0, 0])), len(x), 1 - sse / sst if sst > 0 else float("nan"), math.sqrt(sse / g[0, 0])))
    return out


def merge_topics(vectors: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    """Topics merged into k clusters by k-means of their vectors: key, cluster. Clusters are numbered by falling size, ties by smallest key."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from .skills import ranked

    data = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_x")).persist()
    try:
        model = KMeans(featuresCol="_x", predictionCol="_c", k=k, seed=seed).fit(data)
    finally:
        data.unpersist()
    placed = model.transform(data).select(key, "_c")
    sizes = placed.groupBy("_c").agg(F.count("*").alias("n"), F.min(key).alias("least"))
    return placed.join(F.broadcast(ranked(sizes, [F.desc("n"), F.col("least")], "cluster").select("_c", "cluster")), "_c").select(key, "cluster")


@dataclass
class IntervalFit:
    """intercept and weights of the features as they are, deviation of the errors, log-likelihood."""

    x: list[str]
    intercept: float
    weights: np.ndarray
    sigma: float
    log_likelihood: float


def _interval_sums(r: np.ndarray, p: int, at: np.ndarray) -> np.ndarray:
    """Log-likelihood, gradient and Hessian by (weights over sigma, 1 / sigma) of rows (low, high, 1, features); infinite bounds are open."""
    lo, hi, z, gamma, theta = r[:, 0], r[:, 1], r[:, 2:], at[:p], at[p]
    eta = z @ gamma
    point = lo == hi
    out, grad, hess = 0.0, np.zeros(p + 1), np.zeros((p + 1, p + 1))
    if point.any():
        y, x = lo[point], z[point]
        e = theta * y - eta[point]
        own = np.column_stack([-x, y])
        out += (math.log(theta) - 0.5 * math.log(2 * math.pi)) * len(y) - 0.5 * (e @ e)
        grad -= e @ own
        grad[p] += len(y) / theta
        hess -= own.T @ own
        hess[p, p] -= len(y) / theta**2
    if (~point).any():
        a, b, x, eta = lo[~point], hi[~point], z[~point], eta[~point]
        low, high = theta * a - eta, theta * b - eta
        log_p, r_lo, r_hi = _interval(low, high)
        # An open end has no density, so whatever stands for it has no weight.
        below, above = (np.column_stack([-x, np.where(np.isinf(v), 0, v)]) for v in (a, b))
        out += log_p.sum()
        grad += r_hi @ above - r_lo @ below
        h_hi = -np.where(np.isinf(high), 0, high) * r_hi - r_hi**2
        h_lo = np.where(np.isinf(low), 0, low) * r_lo - r_lo**2
        mixed = (above * (r_hi * r_lo)[:, None]).T @ below
        hess += (above * h_hi[:, None]).T @ above + (below * h_lo[:, None]).T @ below + mixed + mixed.T
    return np.concatenate([[out], grad, hess.ravel()])


def interval_regression(df: DataFrame, x: list[str], low: str, high: str, steps: int = 100) -> IntervalFit | None:
    """Normal regression of a value known by bounds only: between both, above the one, below the other, or exactly where they are equal. Maximum
    likelihood by Newton steps in (weights / sigma, 1 / sigma), where the likelihood has one maximum; each step's sums are taken where the rows are.

    Rows without a bound, with bounds the wrong way round or with a null feature are left out. None without rows; raises if it does not converge (as
    where no row has an upper bound)."""
    usable = df.dropna(subset=x).where(F.coalesce(low, high).isNotNull() & (F.coalesce(F.col(low) <= F.col(high), F.lit(True))))
    middle = F.coalesce((F.col(low) + F.col(high)) / 2, low, high).cast("double")
    m = usable.agg(F.avg(middle), F.stddev_pop(middle), F.count("*"), *(F.avg(c) for c in x), *(F.stddev_pop(c) for c in x)).first()
    if not m[2]:
        return None
    centre, spread, p = float(m[0]), float(m[1] or 1.0), len(x) + 1
    mean, scale = np.array(m[3 : 3 + len(x)], float), np.array([v or 1.0 for v in m[3 + len(x) :]], float)
    bound = lambda c, none: F.coalesce((F.col(c).cast("double") - F.lit(centre)) / F.lit(spread), F.lit(none))
    z = [(F.col(c).cast("double") - F.lit(float(a))) / F.lit(float(s)) for c, a, s in zip(x, mean, scale)]
    data = usable.select(F.array(bound(low, -math.inf), bound(high, math.inf), F.lit(1.0), *z).alias("_r")).persist()
    try:
        at, step, best = np.append(np.zeros(p), 1.0), np.zeros(p + 1), -np.inf
        for _ in range(steps):
            trial = at + step
            sums = _summed(data, lambda r, trial=trial: _interval_sums(r, p, trial)) if trial[p] > 0 else np.array([-np.inf])
            if not np.isfinite(sums).all() or sums[0] < best - 1e-9 * (1 + abs(best)):
                step = step / 2
                if not step.any():
                    break
                continue
            at, best, g, h = trial, sums[0], sums[1 : p + 2], sums[p + 2 :].reshape(p + 1, p + 1)
            step = np.linalg.pinv(-h, rcond=1e-12, hermitian=True) @ g
            if np.abs(step).max() < 1e-9:
                sigma = 1 / at[p]
                weights = at[1:p] * sigma * spread / scale
                return IntervalFit(x, float(centre + at[0] * sigma * spread - weights @ mean), weights, float(sigma * spread), float(best))
    finally:
        data.unpersist()
    raise RuntimeError(f"interval regression did not converge in {steps} steps")
