"""Selection of variable features by residuals, dispersion or local regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators.frame import Matrix
from tessera.operators.transforms import pearson_residual_variance


def pearson_hvg(m: Matrix, n_top: int = 2000, theta: float = 100.0, clip_at: float | None = None, batch_key: str | None = None, layer: str | None = None, digits: int = 9) -> DataFrame:
    """Features by variance of analytic residuals: means, variances, residual_variances, highly_variable_rank, ...

    Without batches ranks are by falling residual variance, ties averaged. With ``batch_key`` each batch is ranked on
    its own; features rank by the number of batches that have them among their n_top, then by the median of these
    ranks. Values are compared to ``digits`` decimals and ties go by var_id, so ranks don't depend on the order of sums.
    """
    whole = pearson_residual_variance(m, theta, clip_at, layer)
    out = whole.select("var_id", F.col("mean").alias("means"), F.col("variance").alias("variances"), F.col("residual_variance").alias("residual_variances"))
    if batch_key is None:
        v = F.round("residual_variances", digits)
        order = W.orderBy(F.col("_v").desc())
        rank = F.rank().over(order) + (F.count("*").over(W.partitionBy("_v")) - 1) / 2
        ranked = out.withColumn("_v", v).withColumn("highly_variable_rank", rank.cast("double")).drop("_v")
        chosen = F.col("highly_variable_rank") <= n_top
        return ranked.select("*", chosen.alias("highly_variable"), F.lit(1).alias("highly_variable_nbatches"), chosen.alias("highly_variable_intersection"))
    names = m.categories("obs", batch_key)
    part = pearson_residual_variance(m, theta, clip_at, layer, by=batch_key)
    place = F.row_number().over(W.partitionBy(batch_key).orderBy(F.round("residual_variance", digits).desc(), "var_id")) - 1
    ranks = part.select("var_id", place.alias("_r")).where(F.col("_r") < n_top)
    summed = ranks.groupBy("var_id").agg(F.count("*").alias("highly_variable_nbatches"), F.median("_r").alias("highly_variable_rank"))
    found = out.join(summed, "var_id", "left").na.fill(0, ["highly_variable_nbatches"])
    order = W.orderBy(F.col("highly_variable_nbatches").desc(), F.col("highly_variable_rank").asc_nulls_last(), "var_id")
    return found.withColumns(
        {"highly_variable": F.row_number().over(order) <= n_top, "highly_variable_intersection": F.col("highly_variable_nbatches") == len(names)}
    )


def dispersions(m: Matrix, flavor: str = "seurat", n_bins: int = 20, layer: str | None = None, digits: int = 9) -> DataFrame:
    """var_id, means, dispersions, dispersions_norm by bins of the mean; null where there is none.

    Fixed values, which the method defines: 20 bins, percentiles 10 to 100 by 5, 1.4826 (deviations by the median absolute one), 1e-12.

    Bins of cell_ranger compare means and percentiles on ``digits`` digits, so that means equal but for rounding share a bin.
    """
    if flavor not in ("seurat", "cell_ranger"):
        raise ValueError(f"unknown flavor {flavor!r}")
    found = stats.mean_var(m, layer, expm1=flavor == "seurat")
    mean = F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean"))
    found = found.select("var_id", mean.alias("means"), (F.col("variance") / mean).alias("dispersions"))
    everything = W.partitionBy()
    if flavor == "seurat":
        found = found.select("var_id", F.log1p("means").alias("means"), F.log(F.when(F.col("dispersions") != 0, F.col("dispersions"))).alias("dispersions"))
        low, high = F.min("means").over(everything), F.max("means").over(everything)
        place = F.ceil(F.try_divide(F.col("means") - low, high - low) * n_bins) - 1
        binned = found.withColumn("_bin", F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), F.coalesce(place, F.lit(0)))))
        within = W.partitionBy("_bin")
        centre, spread = F.avg("dispersions").over(within), F.stddev_samp("dispersions").over(within)
        # A feature alone in its bin has no spread: its own mean stands for it, and the centre is 0.
        binned = binned.withColumns({"_c": F.when(spread.isNull(), 0.0).otherwise(centre), "_s": F.coalesce(spread, centre)})
    else:
        edges = found.agg(F.percentile("means", F.array(*[F.lit(p / 100) for p in range(10, 101, 5)])).alias("e")).select(F.explode("e").alias("e")).select(F.round("e", digits)).distinct().collect()
        place = sum((F.when(F.round("means", digits) > e[0], 1).otherwise(0) for e in edges), F.lit(0))
        binned = found.withColumn("_bin", place)
        by_bin = binned.groupBy("_bin").agg(F.percentile("dispersions", F.lit(0.5)).alias("_c"))
        apart = binned.join(by_bin, "_bin").withColumn("_a", F.abs(F.col("dispersions") - F.col("_c")))
        spread = apart.groupBy("_bin").agg((1.4826 * F.percentile("_a", F.lit(0.5))).alias("_s"))
        binned = apart.join(spread, "_bin").withColumn("_s", F.when(F.col("_s") != 0, F.col("_s")))
    return binned.select("var_id", "means", "dispersions", F.try_divide(F.col("dispersions") - F.col("_c"), F.col("_s")).alias("dispersions_norm"))


def dispersion_hvg(m: Matrix, flavor: str = "seurat", n_top: int | None = None, n_bins: int = 20, min_mean: float = 0.0125, max_mean: float = 3.0, min_disp: float = 0.5, max_disp: float = float("inf"), layer: str | None = None, digits: int = 9) -> DataFrame:
    """``dispersions`` with highly_variable: the n_top greatest (and their rank), or those within the cut-offs.

    Ranks compare to ``digits`` decimals; the bins keep their own.
    """
    found = dispersions(m, flavor, n_bins, layer)
    if n_top is None:
        inside = (F.col("means") > min_mean) & (F.col("means") < max_mean) & (F.col("dispersions_norm") > min_disp) & (F.col("dispersions_norm") < max_disp)
        return found.withColumn("highly_variable", F.coalesce(inside, F.lit(False)))
    place = F.row_number().over(W.orderBy(F.round("dispersions_norm", digits).desc_nulls_last(), "var_id"))
    return found.withColumn("_p", place).select("*", (F.col("_p") <= n_top).alias("highly_variable"), F.when(F.col("_p") <= n_top, F.col("_p").cast("double")).alias("highly_variable_rank")).drop("_p")


def loess(x: np.ndarray, y: np.ndarray, span: float) -> np.ndarray:
    """Fitted values of a local regression of degree 2 with tricube weights; ValueError if a neighbourhood is too thin."""
    n = len(x)
    k = int(np.ceil(span * n))
    if k < 4:
        raise ValueError("the span is too small")
    order = np.argsort(x)
    xs, ys, out = x[order], y[order], np.empty(n)
    low = 0
    for i, c in enumerate(xs):
        while low + k < n and xs[low + k] - c < c - xs[low]:
            low += 1
        near = slice(low, low + k)
        d = np.abs(xs[near] - c)
        far = d.max()
        if far == 0 or len(np.unique(xs[near])) < 3:
            raise ValueError("the span is too small")
        w = np.sqrt((1 - np.minimum(d / far, 1) ** 3) ** 3)
        a = np.vander((xs[near] - c) / far, 3)
        out[i] = np.linalg.lstsq(a * w[:, None], ys[near] * w, rcond=None)[0][2]
    fitted = np.empty(n)
    fitted[order] = out
    return fitted


def pegasus_hvf(m: Matrix, n_top: int = 2000, span: float = 0.02, layer: str | None = None, digits: int = 7) -> DataFrame:
    """Features by distance and ratio to a local regression of variance on mean, over var.robust, both compared to ``digits`` decimals.

    Moments are distributed; the regression sees one point a robust variable, on the driver.
    """
    if "robust" not in m.var.columns:
        raise KeyError("robust")
    moments = stats.mean_var(m, layer)
    points = m.var.where("robust").select("var_id").join(moments, "var_id").orderBy("var_id").toPandas()
    x, y = points["mean"].to_numpy(), points["variance"].to_numpy()
    while len(points):
        try:
            fit = loess(x, y, span)
            break
        except ValueError:
            span += 0.01
            if span > 1.5:
                fit = np.full(len(x), y.mean())
                break
    else:
        fit = x
    delta, fold = y - fit, np.divide(y, fit, out=np.zeros_like(y), where=fit != 0)
    falling = lambda v: np.argsort(np.argsort(-np.round(v, digits), kind="stable"), kind="stable")
    place = np.argsort(np.argsort(falling(delta) + falling(fold), kind="stable"), kind="stable")
    rows = [(int(i), float(f), int(p), bool(p < n_top)) for i, f, p in zip(points["var_id"], fit, place, strict=True)]
    chosen = m.obs.sparkSession.createDataFrame(rows, "var_id long, hvf_loess double, hvf_rank int, highly_variable_features boolean")
    found = m.var.select("var_id").join(moments, "var_id").join(chosen, "var_id", "left").na.fill({"hvf_rank": -1}).na.fill(False, ["highly_variable_features"])
    return found.withColumn("highly_variable", F.col("highly_variable_features"))


def scrublet_counts(m: Matrix, **options) -> DataFrame:
    """The block of raw counts that doublet detection works on: obs_id, var_id, value of the rows and features of :func:`scrublet_prepare`."""
    return scrublet_prepare(m, **options)[0].X.values()


def scrublet_prepare(m: Matrix, min_cells: int = 3, min_genes: int = 3, n_top: int = 2000, flavor: str = "seurat") -> tuple[Matrix, DataFrame, int]:
    """The counts of passing rows and variable features, (var_id, selected) and the number of features selected.

    Features must occur in ``min_cells`` rows and be variable among all rows; rows must have ``min_genes``.
    """
    from tessera.operators.transforms import log1p, normalize_total

    cells = stats.axis_nnz(m, 0).where(F.col("nnz") >= min_cells).select("var_id", F.lit(True).alias("enough"))
    variable = dispersion_hvg(log1p(normalize_total(m)), flavor, n_top).select("var_id", "highly_variable")
    mask = variable.join(cells, "var_id", "left").select("var_id", (F.col("highly_variable") & F.coalesce("enough", F.lit(False))).alias("selected"))
    rows = stats.axis_nnz(m, 1).where(F.col("nnz") >= min_genes)
    chosen = mask.where("selected")
    return m.subset(rows, chosen), mask, chosen.count()
