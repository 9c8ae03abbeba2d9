"""The query catalogue: every operator of the engine on matrices carved from the star schema, with its SQL.

M1 suppliers by parts (quantities), M2 orders by brands, M3 users by event types, M4 embeddings by
position. Results that are not whole numbers are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import guard, stats
from tessera.operators import hvg, linalg, transforms
from tessera.operators.frame import Matrix
from tessera.operators.layers import Layer
from tessera.sources import store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def counts(spark: SparkSession, d: str) -> Matrix:
    """M1."""
    obs = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("obs_id"), F.col("s_name").alias("obs_name"), (F.col("s_nationkey") % 3).cast("string").alias("batch"), F.col("s_acctbal").alias("acctbal"))
    var = _table(spark, d, "part").select(F.col("p_partkey").alias("var_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("var_name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    cells = _table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("obs_id"), F.col("l_partkey").alias("var_id")).agg(F.sum("l_quantity").alias("value"))
    return Matrix.of(obs, var, cells)


def baskets(spark: SparkSession, d: str) -> Matrix:
    """M2: most rows are short, and some have no cell at all."""
    obs = _table(spark, d, "orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_orderkey").cast("string").alias("obs_name"))
    part = _table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("var_name"))
    code = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")
    var = part.select("var_name").distinct().select(code("var_name").alias("var_id"), "var_name")
    cells = _table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("obs_id"), code("var_name").alias("var_id")).agg(F.sum("l_quantity").alias("value"))
    return Matrix.of(obs, var, cells)


def vectors(spark: SparkSession, d: str) -> Matrix:
    """M4."""
    rows = _table(spark, d, "embeddings")
    cells = rows.select(F.col("vec_id").alias("obs_id"), F.posexplode("embedding").alias("var_id", "value")).select("obs_id", F.col("var_id").cast("long").alias("var_id"), "value")
    obs = rows.select(F.col("vec_id").alias("obs_id"), F.col("vec_id").cast("string").alias("obs_name"), F.col("label").cast("string").alias("batch"))
    var = cells.select("var_id").distinct().select("var_id", F.col("var_id").cast("string").alias("var_name"))
    return Matrix.of(obs, var, cells)


_M1 = """obs AS (SELECT s_suppkey AS obs_id, s_name AS obs_name, CAST(s_nationkey % 3 AS VARCHAR) AS batch, s_acctbal AS acctbal FROM supplier),
var AS (SELECT p_partkey AS var_id, 'P' || p_partkey AS var_name, p_brand AS brand, p_size AS size FROM part),
x AS (SELECT l_suppkey AS obs_id, l_partkey AS var_id, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0),
n AS (SELECT CAST((SELECT count(*) FROM obs) AS DOUBLE) AS n_obs, CAST((SELECT count(*) FROM var) AS DOUBLE) AS n_vars),
rs AS (SELECT obs_id, coalesce(sum(value), 0.0) AS total, count(value) AS k FROM obs LEFT JOIN x USING (obs_id) GROUP BY 1),
cs AS (SELECT var_id, coalesce(sum(value), 0.0) AS total, count(value) AS k, coalesce(sum(value * value), 0.0) AS q FROM var LEFT JOIN x USING (var_id) GROUP BY 1)"""
_M2 = """obs AS (SELECT o_orderkey AS obs_id FROM orders),
var AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS var_id, p_brand AS var_name FROM part),
x AS (SELECT l_orderkey AS obs_id, var_id, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN var ON p_brand = var_name GROUP BY 1, 2 HAVING sum(l_quantity) <> 0),
rs AS (SELECT obs_id, coalesce(sum(value), 0.0) AS total FROM obs LEFT JOIN x USING (obs_id) GROUP BY 1)"""
_M4 = """e AS (SELECT vec_id AS obs_id, CAST(label AS VARCHAR) AS batch, CAST(unnest(embedding) AS DOUBLE) AS value, CAST(unnest(range(len(embedding))) AS BIGINT) AS var_id FROM embeddings),
x AS (SELECT * FROM e WHERE value <> 0), n AS (SELECT CAST(count(DISTINCT obs_id) AS DOUBLE) AS n_obs FROM e)"""
_NORM = """t AS (SELECT median(total) AS target FROM rs WHERE total > 0),
f AS (SELECT obs_id, total, CASE WHEN total = 0 THEN 1.0 ELSE total / target END AS factor FROM rs, t),
y AS (SELECT x.obs_id, x.var_id, ln(1 + x.value / f.factor) AS value FROM x JOIN f USING (obs_id))"""
_MOMENTS = """mv AS (SELECT var_id, coalesce(s, 0.0) / n_obs AS mean, greatest(0.0, (coalesce(q, 0.0) - n_obs * (coalesce(s, 0.0) / n_obs) * (coalesce(s, 0.0) / n_obs)) / (n_obs - 1)) AS variance
  FROM var LEFT JOIN (SELECT var_id, sum(value) AS s, sum(value * value) AS q FROM y GROUP BY 1) USING (var_id), n)"""
_SCALE = "p AS (SELECT var_id, mean, CASE WHEN sqrt(variance) = 0 THEN 1.0 ELSE sqrt(variance) END AS std FROM mv)"


def r(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def r_fast(x: Column | str) -> Column:
    """``r`` to six decimals by doubles alone, as DuckDB rounds; for results of very many rows, where decimals take most of the time."""
    x = F.col(x) if isinstance(x, str) else x
    near = F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6
    return F.when(F.abs(x) < 1e9, near).otherwise(F.round(x, 6)) + F.lit(0.0)


def query(sql: str | None = None, base: str = _M1) -> Callable[[Query], Query]:
    """Registers a query by its function's name; ``sql`` goes on after the common tables of ``base``."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = f"WITH {base}{sql}" if sql.startswith(",") else f"WITH {base} {sql}"
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def normalised(spark: SparkSession, d: str) -> Matrix:
    return transforms.log1p(transforms.normalize_total(counts(spark, d).persisted()))


# Reductions

@query("SELECT obs_id, total FROM rs")
def axis_sum_obs(spark, d):
    return stats.axis_sum(counts(spark, d), 1)


@query("SELECT var_id, total FROM cs")
def axis_sum_var(spark, d):
    return stats.axis_sum(counts(spark, d), 0)


@query("SELECT obs_id, k AS nnz FROM rs")
def axis_nnz_obs(spark, d):
    return stats.axis_nnz(counts(spark, d), 1)


@query("SELECT var_id, k AS nnz FROM cs")
def axis_nnz_var(spark, d):
    return stats.axis_nnz(counts(spark, d), 0)


@query("SELECT var_id, round(total / n_obs, 6) + 0.0 AS mean FROM cs, n")
def axis_mean_var(spark, d):
    return _rounded(stats.axis_mean(counts(spark, d), 0), "mean")


@query("SELECT obs_id, round(total / n_vars, 6) + 0.0 AS mean FROM rs, n")
def axis_mean_obs(spark, d):
    return _rounded(stats.axis_mean(counts(spark, d), 1), "mean")


@query(""", g AS (SELECT obs_id, var_id, coalesce(value, 0.0) AS value FROM obs CROSS JOIN var LEFT JOIN x USING (obs_id, var_id))
SELECT obs_id, round(var_pop(value), 6) + 0.0 AS variance FROM g GROUP BY 1""")
def axis_var_obs_ddof0(spark, d):
    return _rounded(stats.axis_var(counts(spark, d).persisted(), 1).select("obs_id", "variance"), "variance")


@query(""", g AS (SELECT obs_id, var_id, coalesce(value, 0.0) AS value FROM obs CROSS JOIN var LEFT JOIN x USING (obs_id, var_id))
SELECT var_id, round(var_pop(value), 6) + 0.0 AS variance FROM g GROUP BY 1""")
def axis_var_var_ddof0(spark, d):
    return _rounded(stats.axis_var(counts(spark, d).persisted(), 0).select("var_id", "variance"), "variance")


@query("SELECT obs_id, obs_name, total AS \"nUMIs\", k AS detected_genes FROM rs JOIN obs USING (obs_id)")
def qc_obs(spark, d):
    return stats.qc_metrics(counts(spark, d).persisted()).obs.select("obs_id", "obs_name", "nUMIs", "detected_genes")


@query("SELECT var_id, var_name, k AS n_cells FROM cs JOIN var USING (var_id)")
def qc_var(spark, d):
    return stats.qc_metrics(counts(spark, d).persisted()).var.select("var_id", "var_name", "n_cells")


@query("""SELECT obs_id, round(CASE WHEN coalesce(sum(value), 0) = 0 THEN 0.0 ELSE sum(CASE WHEN brand LIKE '%1' THEN value ELSE 0.0 END) / sum(value) END, 6) + 0.0 AS fraction
FROM obs LEFT JOIN x USING (obs_id) LEFT JOIN var USING (var_id) GROUP BY 1""")
def gene_group_pct(spark, d):
    return _rounded(stats.group_fraction(counts(spark, d), F.col("brand").like("%1")), "fraction")


@query("SELECT obs_id, round(sum(CASE WHEN size <= 5 THEN coalesce(value, 0.0) ELSE 0.0 END) / (SELECT count(*) FROM var WHERE size <= 5), 6) + 0.0 AS score FROM obs LEFT JOIN x USING (obs_id) LEFT JOIN var USING (var_id) GROUP BY 1")
def gene_set_mean(spark, d):
    return _rounded(stats.gene_set_mean(counts(spark, d), F.col("size") <= 5), "score")


# Selection and access

@query("SELECT obs_id, var_id, value FROM x WHERE obs_id IN (SELECT obs_id FROM obs WHERE batch = '1') AND var_id IN (SELECT var_id FROM var WHERE size < 10)")
def subset_mask(spark, d):
    return counts(spark, d)[F.col("batch") == "1", F.col("size") < 10].X.values()


@query("SELECT obs_id, var_id, value FROM x WHERE obs_id IN (SELECT obs_id FROM obs ORDER BY obs_id LIMIT 5) AND var_id IN (3, 5, 8)")
def subset_names(spark, d):
    m = counts(spark, d)
    names = [x[0] for x in m.obs.orderBy("obs_id").limit(5).select("obs_name").collect()]
    return m[names, ["P3", "P5", "P8"]].X.values()


@query("SELECT obs_id, var_id, value FROM x WHERE obs_id < 40 AND obs_id % 2 = 0 AND var_id >= 100 AND var_id < 300")
def nested_subset(spark, d):
    return counts(spark, d)[:40, 100:][F.col("obs_id") % 2 == 0][:, :300].X.values()


@query("SELECT obs_id, obs_name FROM rs JOIN obs USING (obs_id) WHERE total >= 15300 AND k >= 100")
def filter_cells(spark, d):
    return stats.filter_cells(counts(spark, d), min_counts=15300, min_genes=100).obs.select("obs_id", "obs_name")


@query("SELECT var_id, var_name FROM cs JOIN var USING (var_id) WHERE total >= 500 AND k >= 20 AND k <= 40")
def filter_genes(spark, d):
    return stats.filter_genes(counts(spark, d), min_counts=500, min_cells=20, max_cells=40).var.select("var_id", "var_name")


@query("SELECT obs.obs_id, coalesce(value, 0.0) AS value FROM obs LEFT JOIN x ON x.obs_id = obs.obs_id AND x.var_id = 7")
def obs_vector(spark, d):
    return counts(spark, d).obs_vector("P7")


@query("SELECT obs_id, batch AS value FROM obs")
def obs_vector_column(spark, d):
    return counts(spark, d).obs_vector("batch")


@query("SELECT var.var_id, coalesce(value, 0.0) AS value FROM var LEFT JOIN x ON x.var_id = var.var_id AND x.obs_id = (SELECT min(obs_id) FROM obs)")
def var_vector(spark, d):
    m = counts(spark, d)
    return m.var_vector(m.obs.orderBy("obs_id").first()["obs_name"])


@query("""SELECT obs_id, coalesce(max(value) FILTER (WHERE var_id = 1), 0.0) AS "P1", coalesce(max(value) FILTER (WHERE var_id = 2), 0.0) AS "P2", coalesce(max(value) FILTER (WHERE var_id = 3), 0.0) AS "P3"
FROM obs LEFT JOIN x USING (obs_id) GROUP BY 1""")
def to_df_window(spark, d):
    return counts(spark, d)[:, ["P1", "P2", "P3"]].to_df()


@query("SELECT pos, obs_id, var_id, value FROM (VALUES (CAST(0 AS BIGINT), 9), (1, 3), (2, 9), (3, 4)) AS a(pos, id) JOIN x ON obs_id = id")
def row_indices_ordered(spark, d):
    return counts(spark, d).row_indices([9, 3, 9, 4])


@query("SELECT obs_id, var_id, value FROM x WHERE obs_id >= 10 AND obs_id < 20")
def row_range(spark, d):
    return counts(spark, d).rows(10, 20)


@query("SELECT obs_id, count(*) AS n, sum(value) AS total FROM x GROUP BY 1")
def chunked_blocks(spark, d):
    cells = counts(spark, d).blocked(25)
    return cells.groupBy("start", "obs_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).drop("start")


@query(""", k AS (SELECT var_id, brand, row_number() OVER (PARTITION BY brand ORDER BY var_id) - 1 AS k FROM var)
SELECT var_id, CASE WHEN k > 0 THEN brand || '-' || k ELSE brand END AS var_name FROM k""")
def unique_names(spark, d):
    m = counts(spark, d)
    return Matrix(m.obs, m.var.withColumn("var_name", F.col("brand")), m.layers).unique_names("var").var.select("var_id", "var_name")


@query("SELECT obs_id, CASE batch WHEN '0' THEN 'zero' WHEN '1' THEN 'one' ELSE batch END AS batch FROM obs")
def renamed_categories(spark, d):
    return counts(spark, d).rename_categories("obs", "batch", {"0": "zero", "1": "one"}).obs.select("obs_id", "batch")


@query("SELECT var_id AS obs_id, obs_id AS var_id, value FROM x")
def transposed(spark, d):
    return counts(spark, d).transposed().X.values()


@query("SELECT obs_id, var_id, value FROM x WHERE NOT (obs_id < 5 AND var_id < 10) UNION ALL SELECT obs_id, var_id, 2.5 FROM obs CROSS JOIN var WHERE obs_id < 5 AND var_id < 10")
def assigned_rectangle(spark, d):
    return counts(spark, d).assign(slice(0, 5), slice(0, 10), 2.5).X.values()


# Normalisation, scaling

@query(f", {_NORM} SELECT obs_id, total, round(factor, 6) + 0.0 AS factor FROM f")
def norm_factors_median(spark, d):
    return _rounded(transforms.norm_factors(counts(spark, d).persisted()), "factor")


@query("SELECT obs_id, total, round(CASE WHEN total = 0 THEN 1.0 ELSE total / 7777 END, 6) + 0.0 AS factor FROM rs")
def norm_factors_target(spark, d):
    return _rounded(transforms.norm_factors(counts(spark, d).persisted(), target_sum=7777), "factor")


@query(""", high AS (SELECT DISTINCT var_id FROM x JOIN rs USING (obs_id) WHERE value > 0.3 * total),
r2 AS (SELECT obs_id, coalesce(sum(CASE WHEN var_id NOT IN (SELECT var_id FROM high) THEN value END), 0.0) AS total FROM obs LEFT JOIN x USING (obs_id) GROUP BY 1),
t AS (SELECT median(total) AS target FROM r2 WHERE total > 0)
SELECT obs_id, total, round(CASE WHEN total = 0 THEN 1.0 ELSE total / target END, 6) + 0.0 AS factor FROM r2, t""", base=_M2)
def norm_exclude_high(spark, d):
    return _rounded(transforms.norm_factors(baskets(spark, d).persisted(), exclude_highly_expressed=True, max_fraction=0.3), "factor")


@query(f", {_NORM} SELECT obs_id, total, round(factor, 6) + 0.0 AS factor FROM f", base=_M2)
def norm_zero_rows(spark, d):
    return _rounded(transforms.norm_factors(baskets(spark, d).persisted()), "factor")


@query(f", {_NORM} SELECT obs_id, var_id, round(value, 6) + 0.0 AS value FROM y")
def log1p_values(spark, d):
    return _rounded(normalised(spark, d).X.values(), "value")


@query(f", {_NORM}, {_MOMENTS} SELECT var_id, round(mean, 6) + 0.0 AS mean, round(variance, 6) + 0.0 AS variance FROM mv")
def mean_var_log1p(spark, d):
    return _rounded(stats.mean_var(normalised(spark, d)), "mean", "variance")


@query(f", {_NORM.replace('ln(1 + x.value / f.factor)', '(exp(ln(1 + x.value / f.factor)) - 1)')}, {_MOMENTS} SELECT var_id, round(mean, 6) + 0.0 AS mean, round(variance, 5) + 0.0 AS variance FROM mv")
def mean_var_expm1(spark, d):
    return _rounded(_rounded(stats.mean_var(normalised(spark, d), expm1=True), "mean"), "variance", digits=5)


@query(f", {_NORM}, {_MOMENTS}, {_SCALE} SELECT var_id, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std FROM p")
def scale_params(spark, d):
    columns = transforms.scale(normalised(spark, d)).layers["scaled"].columns
    return columns.select("var_id", r("_mean").alias("mean"), r("_std").alias("std"))


@query(f", {_NORM}, {_MOMENTS}, {_SCALE} SELECT obs.obs_id, round(greatest(-10, least(10, (coalesce(y.value, 0.0) - mean) / std)), 6) + 0.0 AS value FROM obs CROSS JOIN p LEFT JOIN y ON y.obs_id = obs.obs_id AND y.var_id = p.var_id WHERE p.var_id = 11")
def scale_column_dense(spark, d):
    return _rounded(transforms.scale(normalised(spark, d)).obs_vector("P11", "scaled"), "value")


@query(f", {_NORM}, {_MOMENTS}, {_SCALE} SELECT p.var_id, round(greatest(-10, least(10, (coalesce(y.value, 0.0) - mean) / std)), 6) + 0.0 AS value FROM p LEFT JOIN y ON y.obs_id = (SELECT min(obs_id) FROM obs) AND y.var_id = p.var_id")
def scale_row_dense(spark, d):
    m = transforms.scale(normalised(spark, d))
    return _rounded(m.var_vector(m.obs.orderBy("obs_id").first()["obs_name"], "scaled"), "value")


@query(f", {_NORM}, {_MOMENTS}, {_SCALE}, z AS (SELECT p.var_id, greatest(-10, least(10, (coalesce(y.value, 0.0) - mean) / std)) AS z FROM obs CROSS JOIN p LEFT JOIN y ON y.obs_id = obs.obs_id AND y.var_id = p.var_id) SELECT var_id, round(sum(z * z), 5) + 0.0 AS q FROM z GROUP BY 1")
def scale_sumsq(spark, d):
    return transforms.scaled_sums(transforms.scale(normalised(spark, d))).select("var_id", r("q", 5).alias("q"))


@query(", y AS (SELECT * FROM x), " + _MOMENTS + ", " + _SCALE + " SELECT obs.obs_id, p.var_id, round(least(0.5, (coalesce(y.value, 0.0) - mean) / std), 6) + 0.0 AS value FROM obs CROSS JOIN p LEFT JOIN y ON y.obs_id = obs.obs_id AND y.var_id = p.var_id")
def centered_upper_clip(spark, d):
    m = counts(spark, d).persisted()
    params = stats.mean_var(m).select("var_id", "mean", F.sqrt("variance").alias("std"))
    return m.with_layer("c", transforms.centered(m.X, params, clip_high=0.5)).filled("c").withColumn("value", r_fast("value"))


# Feature selection

@query("SELECT var_id, k AS n_cells, round(k / n_obs * 100, 6) + 0.0 AS percent_cells, k / n_obs * 100 >= 26.0 AS robust FROM cs, n WHERE k > 0")
def robust_genes(spark, d):
    return _rounded(stats.robust_genes(counts(spark, d), 26.0).var.select("var_id", "n_cells", "percent_cells", "robust"), "percent_cells")


_SEURAT = f""", {_NORM.replace('ln(1 + x.value / f.factor)', '(exp(ln(1 + x.value / f.factor)) - 1)')}, {_MOMENTS},
a AS (SELECT var_id, ln(1 + CASE WHEN mean = 0 THEN 1e-12 ELSE mean END) AS means, CASE WHEN variance > 0 THEN ln(variance / CASE WHEN mean = 0 THEN 1e-12 ELSE mean END) END AS disp FROM mv),
b AS (SELECT *, greatest(0, least(19, coalesce(ceil((means - min(means) OVER ()) / nullif(max(means) OVER () - min(means) OVER (), 0) * 20) - 1, 0))) AS bin FROM a),
c AS (SELECT *, avg(disp) OVER (PARTITION BY bin) AS m, stddev_samp(disp) OVER (PARTITION BY bin) AS s FROM b),
h AS (SELECT var_id, means, disp, (disp - CASE WHEN s IS NULL THEN 0.0 ELSE m END) / nullif(coalesce(s, m), 0) AS dn FROM c)"""


@query(_SEURAT + " SELECT var_id, rank FROM (SELECT var_id, CAST(row_number() OVER (ORDER BY round(dn, 9) DESC NULLS LAST, var_id) AS DOUBLE) AS rank FROM h) WHERE rank <= 200")
def hvg_seurat_top(spark, d):
    found = hvg.dispersion_hvg(normalised(spark, d), n_top=200)
    return found.where("highly_variable").select("var_id", F.col("highly_variable_rank").alias("rank"))


@query(_SEURAT + " SELECT var_id, round(means, 6) + 0.0 AS means, round(disp, 6) + 0.0 AS dispersions, round(dn, 5) + 0.0 AS dispersions_norm, coalesce(means > 0.0125 AND means < 3.2 AND dn > 0.5, false) AS highly_variable FROM h")
def hvg_seurat_cutoff(spark, d):
    found = hvg.dispersion_hvg(normalised(spark, d), max_mean=3.2)
    return _rounded(_rounded(found, "means", "dispersions"), "dispersions_norm", digits=5)


@query(f""", {_NORM}, {_MOMENTS},
a AS (SELECT var_id, CASE WHEN mean = 0 THEN 1e-12 ELSE mean END AS means, variance / CASE WHEN mean = 0 THEN 1e-12 ELSE mean END AS disp FROM mv),
e AS (SELECT DISTINCT round(unnest(quantile_cont(means, [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0])), 9) AS edge FROM a),
b AS (SELECT var_id, means, disp, (SELECT count(*) FROM e WHERE round(means, 9) > edge) AS bin FROM a),
c AS (SELECT *, median(disp) OVER (PARTITION BY bin) AS m FROM b),
s AS (SELECT *, 1.4826 * median(abs(disp - m)) OVER (PARTITION BY bin) AS s FROM c)
SELECT var_id, round(means, 6) + 0.0 AS means, round((disp - m) / nullif(s, 0), 4) + 0.0 AS dispersions_norm FROM s""")
def hvg_cell_ranger(spark, d):
    found = hvg.dispersions(normalised(spark, d), "cell_ranger")
    return found.select("var_id", r("means").alias("means"), r("dispersions_norm", 4).alias("dispersions_norm"))


_CELL_RANGER = f""", {_NORM}, {_MOMENTS},
a AS (SELECT var_id, CASE WHEN mean = 0 THEN 1e-12 ELSE mean END AS means, variance / CASE WHEN mean = 0 THEN 1e-12 ELSE mean END AS disp FROM mv),
e AS (SELECT DISTINCT round(unnest(quantile_cont(means, [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0])), 9) AS edge FROM a),
b AS (SELECT var_id, means, disp, (SELECT count(*) FROM e WHERE round(means, 9) > edge) AS bin FROM a),
c AS (SELECT *, median(disp) OVER (PARTITION BY bin) AS m FROM b),
s AS (SELECT *, 1.4826 * median(abs(disp - m)) OVER (PARTITION BY bin) AS s FROM c)"""


@query(_CELL_RANGER + """, rk AS (SELECT var_id, row_number() OVER (ORDER BY round((disp - m) / nullif(s, 0), 6) DESC NULLS LAST, var_id) AS p FROM s)
SELECT var_id, CAST(p AS DOUBLE) AS rank FROM rk WHERE p <= 200""")
def hvg_cell_ranger_top(spark, d):
    found = hvg.dispersion_hvg(normalised(spark, d), "cell_ranger", n_top=200, digits=6)
    return found.where("highly_variable").select("var_id", F.col("highly_variable_rank").alias("rank"))


def _pearson_sql(cells: str, rows: str) -> str:
    return f"""g AS (SELECT o.obs_id, v.var_id, coalesce(c.value, 0.0) AS value, o.total AS s, v.total AS t FROM (SELECT obs_id, total FROM {rows}) o CROSS JOIN (SELECT var_id, coalesce(sum(value), 0.0) AS total FROM var LEFT JOIN {cells} USING (var_id) GROUP BY 1) v LEFT JOIN {cells} c ON c.obs_id = o.obs_id AND c.var_id = v.var_id),
tt AS (SELECT sum(total) AS total, sqrt(CAST(count(*) AS DOUBLE)) AS bound FROM {rows}),
mu AS (SELECT g.*, s * t / total AS mu, bound FROM g, tt),
z AS (SELECT obs_id, var_id, value, greatest(-bound, least(bound, (value - mu) / CASE WHEN mu = 0 THEN 1.0 ELSE sqrt(mu + mu * mu / 100.0) END)) AS z FROM mu)"""


@query(f", {_pearson_sql('x', 'rs')} SELECT obs_id, round(z, 6) + 0.0 AS value FROM z WHERE var_id = 13")
def pearson_resid_column(spark, d):
    m = transforms.pearson_residuals(counts(spark, d).persisted(), name="pearson")
    return _rounded(m.obs_vector("P13", "pearson"), "value")


@query(f", {_pearson_sql('x', 'rs')} SELECT var_id, round(var_pop(z), 6) + 0.0 AS residual_variance, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 5) + 0.0 AS variance FROM z GROUP BY 1")
def pearson_resid_var(spark, d):
    found = transforms.pearson_residual_variance(counts(spark, d).persisted())
    return _rounded(_rounded(found, "residual_variance", "mean"), "variance", digits=5)


@query(f""", {_pearson_sql('x', 'rs')}, w AS (SELECT var_id, var_pop(z) AS v FROM z GROUP BY 1)
SELECT var_id, round(v, 6) + 0.0 AS residual_variances, rank() OVER (ORDER BY round(v, 9) DESC) + (count(*) OVER (PARTITION BY round(v, 9)) - 1) / 2.0 AS highly_variable_rank,
rank() OVER (ORDER BY round(v, 9) DESC) + (count(*) OVER (PARTITION BY round(v, 9)) - 1) / 2.0 <= 300 AS highly_variable FROM w""")
def hvg_pearson(spark, d):
    found = hvg.pearson_hvg(counts(spark, d).persisted(), n_top=300)
    return _rounded(found.select("var_id", "residual_variances", "highly_variable_rank", "highly_variable"), "residual_variances")


def _batch_sql() -> str:
    out = []
    for b in range(3):
        body = _pearson_sql(f"x{b}", f"rs{b}")
        for name in ("g", "tt", "mu", "z"):
            body = body.replace(f"{name} AS (", f"{name}{b} AS (", 1)
        body = body.replace("FROM g, tt", f"FROM g{b} g, tt{b}").replace("FROM mu)", f"FROM mu{b})")
        out.append(f"""x{b} AS (SELECT x.* FROM x JOIN obs USING (obs_id) WHERE batch = '{b}'), rs{b} AS (SELECT rs.* FROM rs JOIN obs USING (obs_id) WHERE batch = '{b}'), {body},
w{b} AS (SELECT var_id, row_number() OVER (ORDER BY round(var_pop(z), 9) DESC, var_id) - 1 AS r FROM z{b} GROUP BY 1)""")
    return ", ".join(out)


@query(f""", {_batch_sql()}, w AS (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2),
k AS (SELECT var_id, count(*) FILTER (WHERE r < 300) AS nb, median(CASE WHEN r < 300 THEN r END) AS md FROM w GROUP BY 1)
SELECT var_id, nb AS highly_variable_nbatches, CAST(md AS DOUBLE) AS highly_variable_rank, row_number() OVER (ORDER BY nb DESC, md ASC NULLS LAST, var_id) <= 300 AS highly_variable, nb = 3 AS highly_variable_intersection FROM k""")
def hvg_pearson_batch(spark, d):
    found = hvg.pearson_hvg(counts(spark, d).persisted(), n_top=300, batch_key="batch")
    return found.select("var_id", "highly_variable_nbatches", F.col("highly_variable_rank").cast("double").alias("highly_variable_rank"), "highly_variable", "highly_variable_intersection")


@query(f""", {_NORM}, {_MOMENTS}, pt AS (SELECT var_id, mean AS x, variance AS y FROM mv JOIN cs USING (var_id), n WHERE k / n_obs * 100 >= 20.0),
near AS (SELECT p.var_id, p.y AS y0, q.x - p.x AS u, q.y, row_number() OVER (PARTITION BY p.var_id ORDER BY abs(q.x - p.x)) AS r, CAST(ceil(0.02 * count(*) OVER (PARTITION BY p.var_id)) AS BIGINT) AS k FROM pt p CROSS JOIN pt q),
far AS (SELECT *, max(abs(u)) OVER (PARTITION BY var_id) AS far FROM near WHERE r <= k),
w AS (SELECT var_id, y0, y, u / far AS u, pow(1 - pow(least(abs(u) / far, 1.0), 3), 3) AS w FROM far),
q AS (SELECT var_id, any_value(y0) AS y0, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4, sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * u * u * y) AS t2 FROM w GROUP BY 1),
fit AS (SELECT var_id, y0, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)) AS fit FROM q),
ranks AS (SELECT var_id, row_number() OVER (ORDER BY round(y0 - fit, 7) DESC, var_id) + row_number() OVER (ORDER BY round(CASE WHEN fit = 0 THEN 0.0 ELSE y0 / fit END, 7) DESC, var_id) AS s FROM fit),
final AS (SELECT var_id, row_number() OVER (ORDER BY s, var_id) - 1 AS p FROM ranks)
SELECT var_id, CAST(coalesce(p, -1) AS INTEGER) AS hvf_rank, coalesce(p < 200, false) AS highly_variable_features FROM cs LEFT JOIN final USING (var_id) WHERE k > 0""")
def hvf_pegasus(spark, d):
    """The SQL holds where the first span will do, from some 200 robust features on; with fewer the operator widens it."""
    return hvg.pegasus_hvf(stats.robust_genes(normalised(spark, d), 20.0), n_top=200).select("var_id", "hvf_rank", "highly_variable_features")


@query(_SEURAT + """, top AS (SELECT var_id, row_number() OVER (ORDER BY round(dn, 9) DESC NULLS LAST, var_id) <= 200 AS hv FROM h)
SELECT var_id, hv AND k >= 27 AS selected FROM top JOIN cs USING (var_id)""")
def scrublet_mask(spark, d):
    return hvg.scrublet_prepare(counts(spark, d).persisted(), min_cells=27, n_top=200)[1]


@query(_SEURAT + """, top AS (SELECT var_id, row_number() OVER (ORDER BY round(dn, 9) DESC NULLS LAST, var_id) <= 200 AS hv FROM h)
SELECT obs_id, var_id, value FROM x WHERE var_id IN (SELECT var_id FROM top JOIN cs USING (var_id) WHERE hv AND k >= 27) AND obs_id IN (SELECT obs_id FROM rs WHERE k >= 3)""")
def scrublet_block(spark, d):
    return hvg.scrublet_counts(counts(spark, d).persisted(), min_cells=27, n_top=200)


# Regression and products

@query("SELECT var_id, round(total, 4) + 0.0 AS x0, round(coalesce(sum(value * acctbal), 0.0), 2) + 0.0 AS x1 FROM cs LEFT JOIN x USING (var_id) LEFT JOIN obs USING (obs_id) GROUP BY var_id, total")
def regress_xtx(spark, d):
    sums = transforms.normal_equations(counts(spark, d).persisted(), ["acctbal"])[1]
    return sums.select("var_id", r("x0", 4).alias("x0"), r("x1", 2).alias("x1"))


_REGRESSION = ", g AS (SELECT o.obs_id, var.var_id, coalesce(x.value, 0.0) AS value, o.acctbal FROM obs o CROSS JOIN var LEFT JOIN x ON x.obs_id = o.obs_id AND x.var_id = var.var_id), be AS (SELECT var_id, regr_intercept(value, acctbal) AS b0, regr_slope(value, acctbal) AS b1 FROM g GROUP BY 1)"


@query(_REGRESSION + " SELECT var_id, round(b0, 5) + 0.0 AS b0, round(b1, 7) + 0.0 AS b1 FROM be")
def regress_betas(spark, d):
    return transforms.regress_betas(counts(spark, d).persisted(), ["acctbal"]).select("var_id", r("b0", 5).alias("b0"), r("b1", 7).alias("b1"))


@query(_REGRESSION + " SELECT obs_id, round(value - b0 - b1 * acctbal, 5) + 0.0 AS value FROM g JOIN be USING (var_id) WHERE var_id = 17")
def regress_residual_column(spark, d):
    return _rounded(transforms.regress(counts(spark, d).persisted(), ["acctbal"]).obs_vector("P17", "regressed"), "value", digits=5)


def _weights(frame: DataFrame, key: str) -> DataFrame:
    """Two made-up columns of weights."""
    rows = frame.select(key)
    return rows.select(key, F.lit(0).alias("k"), (F.col(key) % 7 - 3).cast("double").alias("w")).unionByName(rows.select(key, F.lit(1).alias("k"), (F.col(key) % 5 / F.lit(4.0)).alias("w")))


_WEIGHTS = "w AS (SELECT {0}_id, 0 AS k, CAST({0}_id % 7 - 3 AS DOUBLE) AS w FROM {0} UNION ALL SELECT {0}_id, 1, {0}_id % 5 / 4.0::DOUBLE FROM {0})"


@query(f", {_NORM}, {_MOMENTS}, {_SCALE}, {_WEIGHTS.format('var')}, z AS (SELECT obs.obs_id, p.var_id, (coalesce(y.value, 0.0) - mean) / std AS z FROM obs CROSS JOIN p LEFT JOIN y ON y.obs_id = obs.obs_id AND y.var_id = p.var_id) SELECT obs_id, k, round(sum(z * w), 4) + 0.0 AS value FROM z JOIN w USING (var_id) GROUP BY 1, 2")
def matmul(spark, d):
    m = transforms.scale(normalised(spark, d))
    return _rounded(linalg.matmul(m, _weights(m.var, "var_id")), "value", digits=4)


@query(f", {_NORM}, {_MOMENTS}, {_SCALE}, {_WEIGHTS.format('obs')}, z AS (SELECT obs.obs_id, p.var_id, (coalesce(y.value, 0.0) - mean) / std AS z FROM obs CROSS JOIN p LEFT JOIN y ON y.obs_id = obs.obs_id AND y.var_id = p.var_id) SELECT k, var_id, round(sum(z * w), 4) + 0.0 AS value FROM z JOIN w USING (obs_id) GROUP BY 1, 2")
def rmatmul(spark, d):
    m = transforms.scale(normalised(spark, d))
    return _rounded(linalg.rmatmul(m, _weights(m.obs, "obs_id")), "value", digits=4)


@query("SELECT a.var_id AS i, b.var_id AS j, sum(a.value * b.value) AS value FROM x a JOIN x b USING (obs_id) WHERE a.var_id <= b.var_id GROUP BY 1, 2", base=_M2)
def gram(spark, d):
    return linalg.gram(baskets(spark, d).persisted())


@query("SELECT a.var_id AS i, b.var_id AS j, round(sum(a.value * b.value), 5) + 0.0 AS value FROM x a JOIN x b USING (obs_id) WHERE a.var_id <= b.var_id GROUP BY 1, 2", base=_M4)
def gram_vectors(spark, d):
    return _rounded(linalg.gram(vectors(spark, d)), "value", digits=5)


@query()
def pca_embedding(spark, d):
    n = normalised(spark, d)
    m = transforms.scale(n)
    chosen = hvg.dispersion_hvg(n, n_top=300).select("var_id", "highly_variable")
    return linalg.pca(m.with_var(chosen), n_comps=10).embedding.select("obs_id", *[r(F.col("vec")[k], 4).alias(f"pc{k + 1}") for k in range(10)])


@query()
def pca_variance(spark, d):
    m = vectors(spark, d).persisted()
    found = linalg.pca(transforms.scale(m), n_comps=10)
    rows = [(k, round(float(a), 6), round(float(b), 6)) for k, (a, b) in enumerate(zip(found.variance_ratio, found.explained_variance_ratio, strict=True))]
    return spark.createDataFrame(rows, "component int, variance_ratio double, explained_variance_ratio double")


_Z = f"""{_M4}, obs AS (SELECT DISTINCT obs_id FROM e), var AS (SELECT DISTINCT var_id FROM e), y AS (SELECT obs_id, var_id, value FROM x), {_MOMENTS}, {_SCALE},
z AS (SELECT obs.obs_id, p.var_id, greatest(-10, least(10, (coalesce(y.value, 0.0) - mean) / std)) AS z FROM obs CROSS JOIN p LEFT JOIN y ON y.obs_id = obs.obs_id AND y.var_id = p.var_id)"""


def _whole_rotation(spark: SparkSession, d: str) -> linalg.Pca:
    return linalg.pca(transforms.scale(vectors(spark, d).persisted()), n_comps=4096)


@query("SELECT obs_id, round(sum(z * z), 4) + 0.0 AS energy FROM z GROUP BY 1", base=_Z)
def pca_row_energy(spark, d):
    """All components turn a row and keep its length."""
    return _whole_rotation(spark, d).embedding.select("obs_id", r(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v), 4).alias("energy"))


@query(", k AS (SELECT CAST(unnest(range((SELECT count(*) FROM var))) AS INTEGER) AS component) SELECT component, true AS uncorrelated, true AS falling, true AS eigenvector FROM k", base=_Z)
def pca_components_hold(spark, d):
    """Whether each component is uncorrelated with the others, has no more variance than the one before, and is turned by the Gram matrix into a multiple of itself."""
    found = _whole_rotation(spark, d)
    n = len(found.var_ids)
    scores = found.embedding.select("obs_id", F.posexplode("vec").alias("k", "v"))
    rows = scores.select("obs_id", F.col("k").cast("long").alias("var_id"), F.col("v").alias("value"))
    products = linalg.gram(Matrix(found.embedding.select("obs_id"), spark.range(n).select(F.col("id").alias("var_id")), {"X": Layer(rows)}))
    top = float(products.agg(F.max("value")).first()[0] or 1.0)
    apart = products.where("i <> j").select(F.col("i").alias("k"), F.abs("value").alias("c")).unionByName(products.where("i <> j").select(F.col("j").alias("k"), F.abs("value").alias("c")))
    worst = apart.groupBy("k").agg((F.max("c") < 1e-6 * top).alias("uncorrelated"))
    own = products.where("i = j").select(F.col("i").alias("k"), F.col("value").alias("own"))
    ratio = spark.createDataFrame([(k, float(v)) for k, v in enumerate(found.explained_variance_ratio)], "k long, ratio double")
    whole = own.agg(F.sum("own")).first()[0] or 1.0
    before = F.lag("own").over(W.orderBy("k"))  # a row for each component
    held = own.join(ratio, "k").select("k", F.coalesce(F.col("own") <= before + 1e-6 * top, F.lit(True)).alias("falling"), (F.abs(F.col("own") / whole - F.col("ratio")) < 1e-6).alias("eigenvector"))
    return held.join(worst, "k", "left").select(F.col("k").cast("int").alias("component"), F.coalesce("uncorrelated", F.lit(True)).alias("uncorrelated"), "falling", "eigenvector")


@query(f", {_NORM}, {_MOMENTS}, {_SCALE}, {_WEIGHTS.format('obs')}, z AS (SELECT obs.obs_id, p.var_id, (coalesce(y.value, 0.0) - mean) / std AS z FROM obs CROSS JOIN p LEFT JOIN y ON y.obs_id = obs.obs_id AND y.var_id = p.var_id) SELECT var_id, k, round(sum(z * w), 4) + 0.0 AS value FROM z JOIN w USING (obs_id) GROUP BY 1, 2")
def tmatmul(spark, d):
    m = transforms.scale(normalised(spark, d))
    return _rounded(linalg.tmatmul(m, _weights(m.obs, "obs_id")), "value", digits=4)


@query(" SELECT obs_id, var_id, round(z, 6) + 0.0 AS value FROM z", base=_Z)
def pca_block(spark, d):
    """The dense rows that the components are found from."""
    rows = linalg.materialise_for_pca(transforms.scale(vectors(spark, d).persisted()))
    return rows.select("obs_id", F.posexplode("vec").alias("var_id", "value")).select("obs_id", F.col("var_id").cast("long").alias("var_id"), r("value").alias("value"))


@query("SELECT count(*) AS stored, (SELECT CAST(n_obs * n_vars AS BIGINT) FROM n) AS cells FROM x")
def nnz_total(spark, d):
    m = counts(spark, d).persisted()
    return spark.createDataFrame([(stats.nnz(m), m.n_obs * m.n_vars)], "stored long, cells long")


@query(f", {_pearson_sql('x', 'rs')} SELECT var_id, round(var_pop(z), 6) + 0.0 AS residual_variance FROM z GROUP BY 1")
def pearson_resid_var_noted(spark, d):
    """By the statistics that normalisation noted."""
    return _rounded(transforms.pearson_residual_variance(normalised(spark, d), layer="counts").select("var_id", "residual_variance"), "residual_variance")


@query(""", bt AS (SELECT batch, CAST(count(*) AS DOUBLE) AS rows FROM obs GROUP BY 1), bx AS (SELECT batch, var_id, sum(value) AS total FROM x JOIN obs USING (obs_id) GROUP BY 1, 2)
SELECT batch, var_id, round(coalesce(total, 0.0) / rows, 6) + 0.0 AS mean FROM bt CROSS JOIN var LEFT JOIN bx USING (batch, var_id)""")
def batch_means(spark, d):
    return _rounded(transforms.pearson_residual_variance(counts(spark, d).persisted(), by="batch").select("batch", "var_id", "mean"), "mean")


# Sources, sinks and the rest

def _halves(spark: SparkSession, d: str) -> list[Matrix]:
    m = counts(spark, d)
    return [m[:40, :120], m[F.col("obs_id") >= 40, F.col("var_id") >= 60]]


_CONCAT = """, o AS (SELECT *, CASE WHEN obs_id < 40 THEN 0 ELSE 1 END AS part FROM obs), v AS (SELECT var_id, var_name, row_number() OVER (ORDER BY var_name) - 1 AS new FROM var WHERE {}),
i AS (SELECT obs_id, part, row_number() OVER (ORDER BY part, obs_id) - 1 AS new FROM o)
SELECT CAST(i.new AS BIGINT) AS obs_id, CAST(v.new AS BIGINT) AS var_id, value FROM x JOIN i USING (obs_id) JOIN v USING (var_id) WHERE (part = 0 AND var_id < 120) OR (part = 1 AND var_id >= 60)"""


@query(_CONCAT.format("var_id >= 60 AND var_id < 120"))
def concat_inner(spark, d):
    return store.concat(_halves(spark, d)).X.values()


@query(_CONCAT.format("true"))
def concat_outer(spark, d):
    return store.concat(_halves(spark, d), join="outer").X.values()


@query("SELECT obs_id, var_id, value FROM x")
def raw_after_hvg(spark, d):
    return counts(spark, d).with_raw()[:, F.col("size") > 40].raw.X.values()


@query(f", {_NORM} SELECT obs_id, var_id, round(value, 6) + 0.0 AS value FROM y")
def layer_roundtrip(spark, d):
    path = store.scratch(spark, "matrix")
    store.write_store(normalised(spark, d), path)
    return _rounded(store.read_store(spark, path).X.values(), "value")


@query("SELECT obs.obs_id, 2 * sum(coalesce(value, 0.0)) AS doubled FROM obs LEFT JOIN x ON x.obs_id = obs.obs_id GROUP BY obs.obs_id")
def guard_copy_back(spark, d):
    @guard.in_memory(obs=["*"], rows="doubled double")
    def double(values, obs, var):
        obs["doubled"] = 2 * values.sum(axis=1).to_numpy()

    return double(counts(spark, d)).obs.select("obs_id", "doubled")


@query(f", {_NORM}, {_MOMENTS}, {_SCALE} SELECT obs.obs_id, round(greatest(-10, least(10, (coalesce(y.value, 0.0) - mean) / std)), 6) + 0.0 AS value FROM obs CROSS JOIN p LEFT JOIN y ON y.obs_id = obs.obs_id AND y.var_id = p.var_id WHERE p.var_id = 23")
def dense_layer_roundtrip(spark, d):
    """A scaled layer written by its step and read again."""
    path = store.scratch(spark, "matrix")
    store.write_store(transforms.scale(normalised(spark, d)), path)
    return _rounded(store.read_store(spark, path).obs_vector("P23", "scaled"), "value")


@query(_CONCAT.format("var_id >= 60 AND var_id < 120"))
def dataset_of_stores(spark, d):
    paths = [store.scratch(spark, "matrix") for _ in range(2)]
    for m, path in zip(_halves(spark, d), paths, strict=True):
        store.write_store(m, path)
    return store.dataset(spark, paths).X.values()


@query("SELECT obs_id, var_id, value FROM x WHERE NOT (obs_id < 5 AND var_id < 10) UNION ALL SELECT obs_id, var_id, CAST(obs_id + var_id AS DOUBLE) FROM obs CROSS JOIN var WHERE obs_id < 5 AND var_id < 10 AND (obs_id + var_id) % 2 = 1")
def assigned_relation(spark, d):
    """Cells of a rectangle set to those of a relation; the cells that it lacks become 0."""
    m = counts(spark, d)
    cells = m.obs.select("obs_id").crossJoin(m.var.where("var_id < 20").select("var_id")).where("(obs_id + var_id) % 2 = 1").withColumn("value", (F.col("obs_id") + F.col("var_id")).cast("double"))
    return m.assign(slice(0, 5), slice(0, 10), cells).X.values()


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) + 0.0 AS total FROM embeddings WHERE label IS NOT NULL AND CAST(label AS VARCHAR) = (SELECT min(CAST(label AS VARCHAR)) FROM embeddings)", base="unused AS (SELECT 1)")
def axis_arrays_follow(spark, d):
    """Arrays by observation follow a selection of rows."""
    m = vectors(spark, d)
    m = Matrix(m.obs, m.var, m.layers, obsm={"e": _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))})
    first = m.categories("obs", "batch")[0]
    kept = m[F.col("batch") == first].obsm["e"]
    return kept.select("id", r(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v)).alias("total"))
