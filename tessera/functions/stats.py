"""Reductions over the axes of a matrix; rows and columns without stored cells count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.frame import Matrix

_KEYS = {0: "var_id", 1: "obs_id"}


def _axis(m: Matrix, axis: int) -> tuple[str, DataFrame, int]:
    """Key, ids and number of cells across for axis 0 (by variable) or 1 (by observation)."""
    if axis not in _KEYS:
        raise ValueError("axis is 0 or 1")
    return _KEYS[axis], (m.var if axis == 0 else m.obs).select(_KEYS[axis]), m.n_obs if axis == 0 else m.n_vars


def _reduce(m: Matrix, axis: int, layer: str | None, **aggregates: Column) -> DataFrame:
    key, ids, _ = _axis(m, axis)
    x = m.layer(layer)
    if x.dense:
        raise ValueError("a dense layer is reduced by its own functions")
    found = x.values().groupBy(key).agg(*[a.alias(k) for k, a in aggregates.items()])
    return ids.join(found, key, "left").na.fill(0, list(aggregates))


def axis_sum(m: Matrix, axis: int, layer: str | None = None) -> DataFrame:
    return _reduce(m, axis, layer, total=F.sum("value"))


def axis_nnz(m: Matrix, axis: int, layer: str | None = None) -> DataFrame:
    return _reduce(m, axis, layer, nnz=F.count_if(F.col("value") != 0))


def nnz(m: Matrix, layer: str | None = None) -> int:
    """Cells of a layer that are not 0; of a dense one all cells count but those that its zeros leave at 0."""
    x = m.layer(layer)
    stored = x.values().agg(F.count_if(F.col("value") != 0), F.count("*")).first()
    if not x.dense:
        return stored[0]
    if x.steps[-1].name != "scale":
        return m.filled(layer).where("value <> 0").count()
    zero = m.var.select("var_id").join(x.columns, "var_id").select("var_id", (x.at_zero() != 0).cast("int").alias("z"))
    held = x.base.groupBy("var_id").agg(F.count("*").alias("k"))
    rest = zero.join(held, "var_id", "left").agg(F.sum(F.col("z") * (F.lit(m.n_obs) - F.coalesce("k", F.lit(0))))).first()[0]
    return stored[0] + (rest or 0)


def axis_mean(m: Matrix, axis: int, layer: str | None = None) -> DataFrame:
    key, _, n = _axis(m, axis)
    return axis_sum(m, axis, layer).select(key, (F.col("total") / max(n, 1)).alias("mean"))


def axis_var(m: Matrix, axis: int, ddof: int = 0, layer: str | None = None) -> DataFrame:
    """mean and variance in two passes: stored deviations and those of the implied zeros."""
    key, ids, n = _axis(m, axis)
    values = m.layer(layer).values()
    mean = axis_mean(m, axis, layer)
    apart = values.join(mean, key).groupBy(key).agg(F.sum((F.col("value") - F.col("mean")) ** 2).alias("squares"), F.count("*").alias("stored"))
    found = ids.join(mean, key).join(apart, key, "left").na.fill(0, ["squares", "stored"])
    return found.select(key, "mean", ((F.col("squares") + (n - F.col("stored")) * F.col("mean") ** 2) / max(n - ddof, 1)).alias("variance"))


def mean_var(m: Matrix, layer: str | None = None, expm1: bool = False, ddof: int = 1) -> DataFrame:
    """var_id, mean, variance by variable in one pass.

    Squares about the mean of the stored cells are merged part by part, as ``var_pop`` does, and then with
    those of the implied zeros, so large values don't cancel.
    """
    value = F.expm1("value") if expm1 else F.col("value")
    n = m.n_obs
    sums = _reduce(m, 0, layer, c=F.avg(value), v=F.var_pop(value), k=F.count("*"))
    squares = F.col("k") * F.col("v") + F.col("c") * F.col("c") * F.col("k") * (n - F.col("k")) / max(n, 1)
    return sums.select("var_id", (F.col("c") * F.col("k") / max(n, 1)).alias("mean"), F.greatest(F.lit(0.0), squares / max(n - ddof, 1)).alias("variance"))


def qc_metrics(m: Matrix, layer: str | None = None) -> Matrix:
    """obs.nUMIs, obs.detected_genes and var.n_cells."""
    obs = _reduce(m, 1, layer, nUMIs=F.sum("value"), detected_genes=F.count("*"))
    return m.with_obs(obs).with_var(_reduce(m, 0, layer, n_cells=F.count("*")))


def group_fraction(m: Matrix, group: Column, layer: str | None = None) -> DataFrame:
    """obs_id, fraction: the share of the variables of a group in each row's sum; 0 for a row of zeros."""
    inside = m.var.where(group).select("var_id", F.lit(1).alias("_in"))
    cells = m.layer(layer).values().join(inside, "var_id", "left")
    sums = cells.groupBy("obs_id").agg(F.sum(F.when(F.col("_in") == 1, F.col("value")).otherwise(0.0)).alias("part"), F.sum("value").alias("total"))
    return m.obs.select("obs_id").join(sums, "obs_id", "left").select("obs_id", F.coalesce(F.col("part") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total")), F.lit(0.0)).alias("fraction"))


def gene_set_mean(m: Matrix, group: Column, layer: str | None = None) -> DataFrame:
    """obs_id, score: the mean of a group's variables in each row, zeros included."""
    genes = m.var.where(group).select("var_id")
    n = max(genes.count(), 1)
    sums = m.layer(layer).kept(None, genes).values().groupBy("obs_id").agg(F.sum("value").alias("s"))
    return m.obs.select("obs_id").join(sums, "obs_id", "left").select("obs_id", (F.coalesce("s", F.lit(0.0)) / n).alias("score"))


def filter_cells(m: Matrix, min_counts: float | None = None, min_genes: int | None = None, max_counts: float | None = None, max_genes: int | None = None) -> Matrix:
    return m.subset(_within(_reduce(m, 1, None, s=F.sum("value"), k=F.count_if(F.col("value") != 0)), min_counts, min_genes, max_counts, max_genes))


def filter_genes(m: Matrix, min_counts: float | None = None, min_cells: int | None = None, max_counts: float | None = None, max_cells: int | None = None) -> Matrix:
    return m.subset(None, _within(_reduce(m, 0, None, s=F.sum("value"), k=F.count_if(F.col("value") != 0)), min_counts, min_cells, max_counts, max_cells))


def _within(sums: DataFrame, low_s, low_k, high_s, high_k) -> DataFrame:
    for column, low, high in (("s", low_s, high_s), ("k", low_k, high_k)):
        if low is not None:
            sums = sums.where(F.col(column) >= low)
        if high is not None:
            sums = sums.where(F.col(column) <= high)
    return sums


def robust_genes(m: Matrix, percent_cells: float = 0.05) -> Matrix:
    """Without variables of zeros only; var gets n_cells, percent_cells, robust and highly_variable_features."""
    n = max(m.n_obs, 1)
    cells = _reduce(m, 0, None, n_cells=F.count("*")).where("n_cells > 0")
    percent = F.col("n_cells") / n * 100
    marked = cells.select("var_id", "n_cells", percent.alias("percent_cells"), (percent >= percent_cells).alias("robust"), (percent >= percent_cells).alias("highly_variable_features"))
    return m.subset(None, cells).with_var(marked)
