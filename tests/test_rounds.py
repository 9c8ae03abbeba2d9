"""What reviews of larger tables found."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import guard, stats
from tessera.operators import hvg, linalg, transforms
from tessera.operators.frame import Matrix


def test_digits_of_ranks_leave_the_bins_alone(spark, monkeypatch):
    rows = [(i, 0.01 + i * 2e-8, 0.01 * (1 + (i * 7 % 40) / 40)) for i in range(200)]
    monkeypatch.setattr(stats, "mean_var", lambda *a, **b: spark.createDataFrame(rows, "var_id long, mean double, variance double"))
    want = {r.var_id: r.dispersions_norm for r in hvg.dispersions(None, "cell_ranger").collect()}
    found = {r.var_id: r.dispersions_norm for r in hvg.dispersion_hvg(None, "cell_ranger", n_top=20, digits=6).collect()}
    assert found == want


def _tiles(n, i_tile=0, j_tile=0):
    """What a task is sent of n rows with 64 cells in each tile, and the dense rows."""
    import pyarrow as pa

    values = np.random.default_rng(3).normal(size=(n, 128)).round(3)
    tiles = sorted({i_tile, j_tile})
    rows = [(k, t, values[k, 64 * p : 64 * p + 64]) for p, t in enumerate(tiles) for k in range(n)]
    cells = [[{"var_id": t * linalg.TILE + j, "value": v} for j, v in enumerate(x)] for _, t, x in rows]
    column = pa.array(cells, pa.list_(pa.struct([("var_id", pa.int64()), ("value", pa.float64())])))
    ids = [pa.array([x] * len(rows), pa.int64()) for x in (i_tile, j_tile)]
    return pa.table({"i_tile": ids[0], "j_tile": ids[1], "obs_id": pa.array([r[0] for r in rows]), "tile": pa.array([r[1] for r in rows]), "cells": column}), values


@pytest.mark.parametrize("j_tile", [0, 2])
def test_tile_product_by_parts_of_its_rows(j_tile):
    table, x = _tiles(2500, 0, j_tile)
    found = linalg._tile_product(table).to_pydict()
    want = x[:, :64].T @ (x[:, 64:] if j_tile else x[:, :64])
    cells = dict(zip(zip(found["i"], found["j"], strict=True), found["value"], strict=True))
    assert len(cells) == (64 * 64 if j_tile else 64 * 65 // 2)
    assert all(abs(v - want[i, j - j_tile * linalg.TILE]) < 1e-6 for (i, j), v in cells.items())


def test_tile_product_holds_few_dense_rows():
    import tracemalloc

    table, _ = _tiles(8000)
    tracemalloc.start()
    linalg._tile_product(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def _matrix(spark, x, first=0):
    obs = spark.createDataFrame([(first + i, f"o{i}") for i in range(x.shape[0])], "obs_id long, obs_name string")
    var = spark.createDataFrame([(j, f"v{j}") for j in range(x.shape[1])], "var_id long, var_name string")
    return Matrix.of(obs, var, spark.createDataFrame([(first + int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "obs_id long, var_id long, value double"))


def test_all_blocks_are_one_plan(spark):
    x = np.arange(1.0, 161.0).reshape(40, 4)
    m = _matrix(spark, x, first=3)
    plan = m.blocked(7)
    found = sorted(map(tuple, plan.collect()))
    assert found == sorted((a, b, *r) for a, b, cells in m.chunked(7) for r in map(tuple, cells.collect()))
    assert "Union" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert m.subset(F.lit(False)).blocked(7).count() == 0


def test_chunked_blocks_needs_no_union(spark, tmp_path):
    from tessera.plans import catalogue

    spark.createDataFrame([(k, f"S{k}", k % 5, 1.0) for k in range(1, 101)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, "Brand#1", 1)], "p_partkey long, p_brand string, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, 1, float(k)) for k in range(1, 101)], "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalogue.queries()["chunked_blocks"](spark, str(tmp_path))
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.obs_id, r.n, r.total) for r in found.collect()) == [(k, 1, float(k)) for k in range(1, 101)]


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_filled_shuffles_no_zeros(spark, monkeypatch, limit):
    from tessera.operators import frame

    monkeypatch.setattr(frame, "FILLED_BYTES", limit)
    monkeypatch.setattr(frame, "FILLED_COLUMNS", 5)
    monkeypatch.setattr(frame, "FILLED_CELLS", 100)
    x = np.random.default_rng(5).integers(0, 3, size=(30, 17)).astype(float)
    x[4], x[:, 6] = 0, 0
    m = transforms.normalize_total(_matrix(spark, x))
    m = m.with_layer("c", transforms.centered(m.X, stats.mean_var(m).select("var_id", "mean", F.sqrt("variance").alias("std")), clip_high=0.5))
    y = x / np.where(x.sum(1) == 0, 1, x.sum(1) / np.median(x.sum(1)[x.sum(1) > 0]))[:, None]
    std = y.std(axis=0, ddof=1)
    for part, want in ((m, np.minimum(0.5, (y - y.mean(0)) / np.where(std == 0, 1, std))), (m[F.col("obs_id") > 3, F.col("var_id") < 9], None)):
        found = part.filled("c")
        got = {(r.obs_id, r.var_id): r.value for r in found.collect()}
        whole = want if want is not None else whole
        assert len(got) == found.count() == part.n_obs * part.n_vars
        assert all(abs(v - whole[i, j]) < 1e-9 for (i, j), v in got.items())
    plan = m.filled("c")._jdf.queryExecution().optimizedPlan().toString()
    assert ("_held" in plan) == (limit > 0)


def test_guard_by_rows_leaves_the_cells_in_tasks(spark, monkeypatch):
    x = np.random.default_rng(6).integers(0, 3, size=(30, 17)).astype(float)
    x[4] = 0
    m = _matrix(spark, x)
    scaled = transforms.scale(m)
    monkeypatch.setattr(guard, "to_memory", lambda *a: pytest.fail("all cells went to the driver"))
    monkeypatch.setattr(guard, "ROWS_CELLS", 40)

    def run(m, layer=None):
        @guard.in_memory(obs=["s", "n"], rows="s double, n string, left long", layer=layer)
        def work(values, obs, var):
            assert values.shape == (len(obs), 17) and list(values.columns) == list(var["var_name"])
            obs["s"], obs["n"], obs["left"] = values.to_numpy() @ np.arange(17), obs["obs_name"] + "!", 1

        return work(m).obs

    found = run(m)
    assert found.columns == ["obs_id", "obs_name", "s", "n"]
    got = {r.obs_id: r for r in found.collect()}
    assert len(got) == 30 and all(r.s == x[k] @ np.arange(17) and r.n == f"o{k}!" for k, r in got.items())
    z = np.clip((x - x.mean(0)) / np.where(x.std(0, ddof=1) == 0, 1, x.std(0, ddof=1)), -10, 10)
    assert all(abs(r.s - z[r.obs_id] @ np.arange(17)) < 1e-9 for r in run(scaled, "scaled").collect())
    assert run(m[F.lit(False)]).count() == 0
    with pytest.raises(ValueError):
        guard.in_memory(var=["s"], rows="s double")(lambda values, obs, var: None)
