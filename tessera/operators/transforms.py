"""Element-wise operators: each adds a step to a layer and touches no cell."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import cached_property

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators.frame import Matrix
from tessera.operators.layers import Layer, clip, make, maker


#: Bytes of the distinct sums of rows (three numbers each) up to which they are broadcast.
BROADCAST_BYTES = 32 << 20


@maker("normalize")
def _normalize():
    return lambda v: v / F.col("_factor")


@maker("log1p")
def _log1p():
    return F.log1p


@maker("scale")
def _scale(low: float | None, high: float | None):
    return lambda v: clip((v - F.col("_mean")) / F.col("_std"), low, high)


@maker("pearson")
def _pearson(total: float, theta: float, bound: float):
    return lambda v: _residual(v, F.lit(total), theta, F.lit(float(bound)))


@maker("regress")
def _regress(k: int):
    return lambda v: v - sum((F.col(f"_c{i}") * F.col(f"_b{i}") for i in range(1, k)), F.col("_c0") * F.col("_b0"))


def _residual(v: Column, total: Column, theta: float, bound: Column) -> Column:
    mu = F.col("_row") * F.col("_column") / total
    deviation = F.sqrt(mu + mu * mu / theta)
    return clip((v - mu) / F.when(deviation == 0, 1.0).otherwise(deviation), -bound, bound)


def norm_factors(m: Matrix, target_sum: float | None = None, exclude_highly_expressed: bool = False, max_fraction: float = 0.05) -> DataFrame:
    """obs_id, total, factor: a row's sum over the target, by default the median of the sums above 0.

    With ``exclude_highly_expressed`` sums leave out variables that hold more than ``max_fraction`` of
    any row's sum. Rows without counts have factor 1.
    """
    totals = stats.axis_sum(m, 1)
    if exclude_highly_expressed:
        cells = m.X.values()
        high = cells.join(totals, "obs_id").where(F.col("value") > max_fraction * F.col("total")).select("var_id").distinct()
        rest = cells.join(high, "var_id", "left_anti").groupBy("obs_id").agg(F.sum("value").alias("total"))
        totals = m.obs.select("obs_id").join(rest, "obs_id", "left").na.fill(0, ["total"])
    if target_sum is None:
        target_sum = totals.where("total > 0").agg(F.percentile("total", F.lit(0.5))).first()[0] or 1.0
    factor = F.col("total") / F.lit(float(target_sum))
    return totals.select("obs_id", "total", F.when((factor == 0) | F.isnan(factor) | (F.abs(factor) == float("inf")), 1.0).otherwise(factor).alias("factor"))


def normalize_total(m: Matrix, target_sum: float | None = None, exclude_highly_expressed: bool = False, max_fraction: float = 0.05) -> Matrix:
    """Divides every row by its factor; the counts stay as layer "counts", the factors as obs._norm_factor.

    Statistics of the counts that residuals need are noted in ``uns``, to be worked out when they are first asked for.
    """
    factors = norm_factors(m, target_sum, exclude_highly_expressed, max_fraction)
    x = m.X.then(make("normalize"), rows=factors.select("obs_id", F.col("factor").alias("_factor")))
    out = m.with_layer("counts", m.X).with_layer("X", x).with_obs(factors.select("obs_id", F.col("factor").alias("_norm_factor")))
    return replace(out, uns=out.uns | {PRECOMPUTED: pearson_precompute(m)})


def log1p(m: Matrix) -> Matrix:
    """ln(1 + x) of the main layer; of a layer that is logged already nothing."""
    return m if m.X.logged else m.with_layer("X", m.X.then(make("log1p")))


def scale(m: Matrix, clip_low: float | None = -10.0, clip_high: float | None = 10.0, name: str = "scaled") -> Matrix:
    """z-scores by variable as a dense layer; deviation 0 counts as 1. Scaling a scaled X is an error."""
    if "scale" in m.X.chain:
        raise RuntimeError("the main layer is scaled already")
    found = stats.mean_var(m)
    deviation = F.sqrt("variance")
    columns = found.select("var_id", F.col("mean").alias("_mean"), F.when(deviation == 0, 1.0).otherwise(deviation).alias("_std"))
    layer = m.X.then(make("scale", low=clip_low, high=clip_high), columns=columns, dense=True)
    return m.with_layer(name, layer)


def centered(base: Layer, params: DataFrame, clip_high: float | None = 10.0) -> Layer:
    """(x - mean) / std for given (var_id, mean, std), clipped from above only; std of 0 or less counts as 1."""
    if base.dense:
        raise TypeError("a sparse layer is needed")
    columns = params.select("var_id", F.col("mean").alias("_mean"), F.when(F.col("std") <= 0, 1.0).otherwise(F.col("std")).alias("_std"))
    return base.then(make("scale", low=None, high=clip_high), columns=columns, dense=True)


def scaled_sums(m: Matrix, layer: str = "scaled") -> DataFrame:
    """var_id, s, q: the sum and the sum of squares of a scaled layer by variable, in closed form for its zeros."""
    x = m.layer(layer)
    stored = x.values().groupBy("var_id").agg(F.sum("value").alias("_s"), F.sum(F.col("value") ** 2).alias("_q"), F.count("*").alias("_n"))
    zero = m.var.select("var_id").join(x.columns, "var_id").select("var_id", x.at_zero().alias("_zero"))
    rest = F.lit(m.n_obs) - F.coalesce("_n", F.lit(0))
    found = zero.join(stored, "var_id", "left").na.fill(0, ["_s", "_q"])
    return found.select("var_id", (F.col("_s") + rest * F.col("_zero")).alias("s"), (F.col("_q") + rest * F.col("_zero") ** 2).alias("q"))


#: Where ``uns`` notes the statistics.
PRECOMPUTED = "_pearson_precompute"


class PearsonStats:
    """Sums of a layer by row and by column, kept for the operators on residuals; they hold for that layer alone."""

    def __init__(self, m: Matrix, layer: str | None = None):
        self.layer, self._matrix, self._name = m.layer(layer), m, layer

    @cached_property
    def rows(self) -> DataFrame:
        return stats.axis_sum(self._matrix, 1, self._name).select("obs_id", F.col("total").alias("_row")).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def columns(self) -> DataFrame:
        return stats.axis_sum(self._matrix, 0, self._name).select("var_id", F.col("total").alias("_column")).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def total(self) -> float:
        return float(self.rows.agg(F.sum("_row")).first()[0] or 0.0) or 1.0

    @property
    def n_obs(self) -> int:
        return self._matrix.n_obs

    def fit(self, m: Matrix, layer: str | None = None) -> bool:
        """Whether they are those of a layer: the same relation and steps, over the same axes."""
        x = m.layer(layer)
        return x.base is self.layer.base and x.steps == self.layer.steps and x.rows is self.layer.rows and x.columns is self.layer.columns

    def unpersist(self) -> None:
        for name in ("rows", "columns"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()


def pearson_precompute(m: Matrix, layer: str | None = None) -> PearsonStats:
    return PearsonStats(m, layer)


def _statistics(m: Matrix, layer: str | None, precomputed: PearsonStats | str | None) -> PearsonStats:
    """Those given, which must fit; with "auto" those noted in ``uns`` if they fit, or else new ones."""
    if isinstance(precomputed, PearsonStats):
        if not precomputed.fit(m, layer):
            raise ValueError("Stale precomputed statistics: they belong to another layer or selection")
        return precomputed
    noted = m.uns.get(PRECOMPUTED) if precomputed == "auto" else None
    return noted if isinstance(noted, PearsonStats) and noted.fit(m, layer) else PearsonStats(m, layer)


def pearson_residuals(m: Matrix, theta: float = 100.0, clip_at: float | None = None, layer: str | None = None, name: str = "X", precomputed: PearsonStats | str | None = "auto") -> Matrix:
    """Analytic residuals of counts as a dense layer: (x - mu) / sqrt(mu + mu^2 / theta), clipped at sqrt(n_obs)."""
    found = _statistics(m, layer, precomputed)
    bound = float(np.sqrt(m.n_obs)) if clip_at is None else float(clip_at)
    x = m.layer(layer).then(make("pearson", total=found.total, theta=float(theta), bound=bound), rows=found.rows, columns=found.columns, dense=True)
    return m.with_layer(name, x)


def pearson_residual_variance(m: Matrix, theta: float = 100.0, clip_at: float | None = None, layer: str | None = None, by: str | None = None, precomputed: PearsonStats | str | None = "auto") -> DataFrame:
    """var_id, residual_variance, mean, variance (ddof 0) over all cells; with ``by``, a column of obs, for each of its values, too.

    The zeros' part depends on a row and on a column by their sums alone, so it is summed over the distinct sums of either, with
    multiplicities; the stored cells add their differences to it. All groups of ``by`` are found in the same passes.
    """
    if clip_at is not None and clip_at < 0:
        raise ValueError("the clip must not be negative")
    cells = m.layer(layer).values()
    if by is None:
        key: list[str] = []
        found = _statistics(m, layer, precomputed)
        rows, columns = found.rows, found.columns
        group = lambda frame: frame.withColumns({"_total": F.lit(found.total), "_n": F.lit(float(m.n_obs))})
    else:
        key = [by]
        owner = m.obs.where(F.col(by).isNotNull()).select("obs_id", by)
        cells = cells.join(owner, "obs_id")
        rows = owner.join(cells.groupBy("obs_id").agg(F.sum("value").alias("_row")), "obs_id", "left").na.fill(0, ["_row"])
        sums = cells.groupBy(by, "var_id").agg(F.sum("value").alias("_column"))
        totals = rows.groupBy(by).agg(F.sum("_row").alias("_t"), F.count("*").cast("double").alias("_n")).select(by, F.when(F.col("_t") == 0, 1.0).otherwise(F.col("_t")).alias("_total"), "_n")
        columns = m.var.select("var_id").crossJoin(totals.select(by)).join(sums, [by, "var_id"], "left").na.fill(0, ["_column"])  # a few groups
        group = lambda frame: frame.join(totals, by)
    bound = F.sqrt("_n") if clip_at is None else F.lit(float(clip_at))
    z = _residual(F.lit(0.0), F.col("_total"), theta, bound)

    distinct = rows.groupBy(*key, "_row").agg(F.count("*").alias("_times"))
    if m.n_obs * 24 <= BROADCAST_BYTES:
        distinct = F.broadcast(distinct)
    kinds = group(columns.select(*key, "_column").distinct())
    pairs = kinds.join(distinct, key) if key else kinds.crossJoin(distinct)
    zeros = pairs.select(*key, "_column", "_times", z.alias("z")).groupBy(*key, "_column").agg(F.sum(F.col("_times") * F.col("z")).alias("s0"), F.sum(F.col("_times") * F.col("z") ** 2).alias("q0"))
    zeros = group(columns.join(zeros, [*key, "_column"]))
    held = group(cells.join(rows.select("obs_id", "_row"), "obs_id").join(columns, [*key, "var_id"]))
    held = held.select(*key, "var_id", "value", _residual(F.col("value"), F.col("_total"), theta, bound).alias("r"), z.alias("z"))
    stored = held.groupBy(*key, "var_id").agg(
        F.sum(F.col("r") - F.col("z")).alias("s1"), F.sum(F.col("r") ** 2 - F.col("z") ** 2).alias("q1"), F.avg("value").alias("c"), F.var_pop("value").alias("v"), F.count("*").alias("k")
    )
    found = zeros.join(stored, [*key, "var_id"], "left").na.fill(0, ["s1", "q1", "c", "v", "k"])
    n, k, c = F.col("_n"), F.col("k"), F.col("c")
    mean = (F.col("s0") + F.col("s1")) / n
    return found.select(
        *key,
        "var_id",
        ((F.col("q0") + F.col("q1")) / n - mean * mean).alias("residual_variance"),
        (c * k / n).alias("mean"),
        ((k * F.col("v") + c * c * k * (n - k) / n) / n).alias("variance"),
    )


def _covariates(m: Matrix, keys: Sequence[str]) -> DataFrame:
    return m.obs.select("obs_id", F.lit(1.0).alias("c0"), *[F.col(k).cast("double").alias(f"c{i + 1}") for i, k in enumerate(keys)])


def normal_equations(m: Matrix, keys: Sequence[str], layer: str | None = None) -> tuple[np.ndarray, DataFrame]:
    """The k by k matrix of covariate products, and by variable the sums of covariate times value (x0, x1, ...)."""
    c, k = _covariates(m, keys), len(keys) + 1
    products = c.agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(k)]).first()
    sums = m.layer(layer).values().join(c, "obs_id").groupBy("var_id").agg(*[F.sum(F.col(f"c{i}") * F.col("value")).alias(f"x{i}") for i in range(k)])
    return np.array(products, dtype=float).reshape(k, k), m.var.select("var_id").join(sums, "var_id", "left").na.fill(0.0)


def regress_betas(m: Matrix, keys: Sequence[str], layer: str | None = None) -> DataFrame:
    """var_id, b0 (intercept), b1, ...: least squares of each variable on covariates of obs."""
    products, sums = normal_equations(m, keys, layer)
    inverse, k = np.linalg.pinv(products), len(keys) + 1
    beta = [sum((F.lit(float(inverse[i, j])) * F.col(f"x{j}") for j in range(1, k)), F.lit(float(inverse[i, 0])) * F.col("x0")).alias(f"b{i}") for i in range(k)]
    return sums.select("var_id", *beta)


def regress(m: Matrix, keys: Sequence[str], layer: str | None = None, name: str = "regressed") -> Matrix:
    """What covariates leave, as a dense layer: x - C beta."""
    k = len(keys) + 1
    rows = _covariates(m, keys).select("obs_id", *[F.col(f"c{i}").alias(f"_c{i}") for i in range(k)])
    betas = regress_betas(m, keys, layer).select("var_id", *[F.col(f"b{i}").alias(f"_b{i}") for i in range(k)])
    return m.with_layer(name, m.layer(layer).then(make("regress", k=k), rows=rows, columns=betas, dense=True))


def materialise(layer: Layer) -> Layer:
    """A sparse layer's values as a new base."""
    if layer.dense:
        raise ValueError("a dense layer has no sparse form")
    return Layer(layer.values().where("value <> 0"), history=layer.chain)
