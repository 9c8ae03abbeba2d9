"""The catalogue against its SQL in DuckDB, where the driver's tables are at hand."""

import os

import pytest

from tessera.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "supplier part orders lineitem embeddings".split()
SOME = ["tmatmul", "pca_block", "nnz_total", "pearson_resid_var_noted", "batch_means", "dense_layer_roundtrip", "dataset_of_stores", "assigned_relation", "axis_arrays_follow", "hvg_cell_ranger", "hvg_cell_ranger_top", "scrublet_block", "pca_row_energy", "pca_components_hold", "hvg_pearson_batch", "transposed", "chunked_blocks", "raw_after_hvg", "gram_vectors", "row_indices_ordered", "assigned_rectangle", "qc_obs", "axis_var_var_ddof0", "gene_group_pct", "subset_mask", "to_df_window", "norm_zero_rows", "scale_sumsq", "centered_upper_clip", "hvg_seurat_cutoff", "hvg_pearson", "regress_betas", "matmul", "gram", "concat_outer", "layer_roundtrip", "guard_copy_back"]

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(rows):
    return sorted((tuple(float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x for x in r) for r in rows), key=repr)


@needs_data
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = catalogue.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert plain(map(tuple, found.select(columns).collect())) == plain(want)


@needs_data
def test_whole_centered_clip_by_brute_force(spark):
    import numpy as np

    m = catalogue.counts(spark, DATA)
    obs, var = (sorted(r[0] for r in f.collect()) for f in (m.obs.select("obs_id"), m.var.select("var_id")))
    dense = np.zeros((len(obs), len(var)))
    for r in m.X.values().collect():
        dense[obs.index(r.obs_id), var.index(r.var_id)] = r.value
    std = dense.std(axis=0, ddof=1)
    want = np.minimum(0.5, (dense - dense.mean(axis=0)) / np.where(std == 0, 1, std))
    found = catalogue.queries()["centered_upper_clip"](spark, DATA).collect()
    assert len(found) == want.size
    assert all(abs(r.value - want[obs.index(r.obs_id), var.index(r.var_id)]) < 2e-6 for r in found)


@needs_data
def test_cell_ranger_returns_every_variable(spark):
    found = catalogue.queries()["hvg_cell_ranger"](spark, DATA)
    assert found.count() == catalogue.counts(spark, DATA).var.count()


@needs_data
def test_cell_ranger_ties_share_a_bin(spark, monkeypatch):
    from tessera.functions import stats
    from tessera.operators import hvg

    rows = [(i, 0.3 + (1e-16 if i % 2 else 0.0), float(i + 1)) for i in range(20)] + [(20 + i, 1.0 + i, 3.0) for i in range(4)]
    monkeypatch.setattr(stats, "mean_var", lambda *a, **b: spark.createDataFrame(rows, "var_id long, mean double, variance double"))
    found = {r.var_id: r.dispersions_norm for r in hvg.dispersions(None, "cell_ranger").collect()}
    steps = [found[i + 1] - found[i] for i in range(19)]
    assert len(found) == 24 and min(steps) > 0 and max(steps) - min(steps) < 1e-9


def test_entry_lists_the_catalogue():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.counts(spark, DATA)[:10].X.values()._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_tax" not in plan
