"""Single operators against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import guard, stats
from tessera.operators import hvg, linalg, transforms
from tessera.operators.frame import Matrix
from tessera.operators.layers import Layer
from tessera.sources import store


def dense(n=60, k=25, seed=0, whole=True):
    rng = np.random.default_rng(seed)
    x = rng.poisson(0.7, (n, k)).astype(float) * rng.integers(1, 9, k) if whole else rng.random((n, k)) * (rng.random((n, k)) < 0.2)
    x[3], x[:, 7] = 0, 0
    return x


def matrix(spark, x):
    i, j = np.nonzero(x)
    cells = spark.createDataFrame([(int(a), int(b), float(x[a, b])) for a, b in zip(i, j, strict=True)] + [(0, 7, 0.0)], "obs_id long, var_id long, value double")
    obs = spark.createDataFrame([(k, f"c{k}", "AB"[k % 2], float(k % 7)) for k in range(x.shape[0])], "obs_id long, obs_name string, batch string, depth double")
    var = spark.createDataFrame([(k, f"g{k}", k % 3 == 0) for k in range(x.shape[1])], "var_id long, var_name string, mito boolean")
    return Matrix.of(obs, var, cells)


def array(df, key="obs_id", value="value"):
    return np.array([r[1] for r in sorted((r[key], r[value]) for r in df.collect())], dtype=float)


def full(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.obs_id, r.var_id] = r.value
    return out


@pytest.fixture(scope="module")
def x():
    return dense()


@pytest.fixture(scope="module")
def m(spark, x):
    return matrix(spark, x)


def test_reductions(m, x):
    assert m.shape == x.shape
    for axis, key in ((0, "var_id"), (1, "obs_id")):
        assert np.allclose(array(stats.axis_sum(m, axis), key, "total"), x.sum(axis))
        assert np.allclose(array(stats.axis_nnz(m, axis), key, "nnz"), (x != 0).sum(axis))
        assert np.allclose(array(stats.axis_mean(m, axis), key, "mean"), x.mean(axis))
        assert np.allclose(array(stats.axis_var(m, axis, 1), key, "variance"), x.var(axis, ddof=1))
    assert np.allclose(array(stats.mean_var(m), "var_id", "variance"), x.var(0, ddof=1))
    with pytest.raises(ValueError):
        stats.axis_sum(m, 2)


def test_selection(m, x):
    s = m[:20][F.col("batch") == "A", ["g1", "g4", "g7"]]
    assert s.shape == (10, 3)
    assert np.allclose(array(s.obs_vector("g4")), x[:20:2, 4])
    assert m[-5:].shape[0] == 5 and m[::2].shape[0] == 30 and m[5:1:-2].obs.count() == 2
    assert array(m.obs_vector("depth")).sum() == sum(k % 7 for k in range(60))
    assert np.allclose(array(m.var_vector("c9"), "var_id"), x[9])
    for bad in (lambda: m["nope"], lambda: m[:, ["g1", "nope"]], lambda: m.obs_vector("nope"), lambda: m[[999]]):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(IndexError):
        m[1, 2, 3]
    asked = m.row_indices([5, 2, 5])
    assert {r.pos for r in asked.collect()} == {0, 1, 2}
    assert sum(b.count() for _, _, b in m.chunked(17)) == (x != 0).sum()
    assert m.sample_rows(7, 1).obs.count() == 7


def test_normalise_and_log(m, x):
    t = x.sum(1)
    f = np.where(t == 0, 1, t / np.median(t[t > 0]))
    n = transforms.normalize_total(m)
    assert np.allclose(full(n.filled(), x.shape), x / f[:, None])
    logged = transforms.log1p(transforms.log1p(n))
    assert np.allclose(full(logged.filled(), x.shape), np.log1p(x / f[:, None]))
    assert np.allclose(array(n.obs.select("obs_id", "_norm_factor"), "obs_id", "_norm_factor"), f)
    high = (x > 0.3 * t[:, None]).any(0)
    t2 = x[:, ~high].sum(1)
    f2 = np.where(t2 == 0, 1, t2 / np.median(t2[t2 > 0]))
    assert np.allclose(array(transforms.norm_factors(m, None, True, 0.3), "obs_id", "factor"), f2)


def test_scale(m, x):
    sd = x.std(0, ddof=1)
    z = np.clip((x - x.mean(0)) / np.where(sd == 0, 1, sd), -1.5, 1.5)
    s = transforms.scale(m, -1.5, 1.5)
    assert np.allclose(full(s.filled("scaled"), x.shape), z)
    sums = transforms.scaled_sums(s)
    assert np.allclose(array(sums, "var_id", "s"), z.sum(0)) and np.allclose(array(sums, "var_id", "q"), (z**2).sum(0))
    with pytest.raises(RuntimeError):
        transforms.scale(s.with_layer("X", s.layers["scaled"]))
    with pytest.raises(ValueError):
        transforms.log1p(s.with_layer("X", s.layers["scaled"]))
    with pytest.raises(TypeError):
        transforms.centered(s.layers["scaled"], stats.mean_var(m).withColumn("std", F.lit(1.0)))


def test_products(m, spark, x):
    sd = x.std(0, ddof=1)
    z = (x - x.mean(0)) / np.where(sd == 0, 1, sd)
    s = transforms.scale(m)
    rng = np.random.default_rng(3)
    w, y = rng.normal(size=(x.shape[1], 2)), rng.normal(size=(2, x.shape[0]))
    right = spark.createDataFrame([(j, k, float(w[j, k])) for j in range(x.shape[1]) for k in range(2)], "var_id long, k int, w double")
    left = spark.createDataFrame([(i, k, float(y[k, i])) for i in range(x.shape[0]) for k in range(2)], "obs_id long, k int, w double")
    got = linalg.matmul(s, right)
    for k in range(2):
        assert np.allclose(array(got.where(F.col("k") == k)), (z @ w)[:, k])
        assert np.allclose(array(linalg.rmatmul(s, left).where(F.col("k") == k), "var_id"), (y @ z)[k])


def test_pearson(m, x):
    mu = x.sum(1)[:, None] * x.sum(0) / x.sum()
    bound = np.sqrt(len(x))
    z = np.clip((x - mu) / np.where(mu == 0, 1, np.sqrt(mu + mu**2 / 100)), -bound, bound)
    assert np.allclose(full(transforms.pearson_residuals(m).filled(), x.shape), z)
    assert np.allclose(array(transforms.pearson_residual_variance(m), "var_id", "residual_variance"), z.var(0), atol=1e-10)
    found = hvg.pearson_hvg(m, n_top=5)
    assert found.where("highly_variable").count() == 5
    batch = hvg.pearson_hvg(m, n_top=5, batch_key="batch")
    assert batch.where("highly_variable").count() == 5 and batch.agg(F.max("highly_variable_nbatches")).first()[0] <= 2
    with pytest.raises(ValueError):
        hvg.dispersions(m, "other")


def test_regress(m, x):
    c = np.stack([np.ones(60), np.arange(60) % 7.0], 1)
    beta = np.linalg.lstsq(c, x, rcond=None)[0]
    assert np.allclose(full(transforms.regress(m, ["depth"]).filled("regressed"), x.shape), x - c @ beta)


def test_pca(m, x):
    s = transforms.scale(m, -2, 2)
    sd = x.std(0, ddof=1)
    z = np.clip((x - x.mean(0)) / np.where(sd == 0, 1, sd), -2, 2)
    found = linalg.pca(s, n_comps=4)
    u, d, v = np.linalg.svd(z, full_matrices=False)
    assert (np.abs(np.sum(found.components * v[:4], 1)) > 0.999).all()
    got = np.array([r.vec for r in sorted(found.embedding.collect(), key=lambda r: r.obs_id)])
    assert np.allclose(np.abs(got), np.abs(u[:, :4] * d[:4])) and len(got) == 60
    assert np.allclose(found.explained_variance_ratio, (d**2 / (d**2).sum())[:4])
    marked = s.with_var(s.var.select("var_id", (F.col("var_id") < 9).alias("highly_variable")))
    assert linalg.pca(marked, n_comps=3).components.shape == (3, 9)


def test_pca_of_many_columns_by_subspace_iteration(m, x, monkeypatch):
    s = transforms.scale(m, -2, 2)
    exact = linalg.pca(s, n_comps=4)
    monkeypatch.setattr(linalg, "MAX_COLUMNS", 10)
    found = linalg.pca(s, n_comps=4, n_oversamples=10, iterations=12)
    assert (np.abs(np.sum(found.components * exact.components, 1)) > 0.999).all()
    assert np.allclose(found.explained_variance_ratio, exact.explained_variance_ratio, rtol=1e-3)
    a, b = (np.array([r.vec for r in sorted(f.embedding.collect(), key=lambda r: r.obs_id)]) for f in (exact, found))
    assert np.allclose(a, b, atol=0.05 * np.abs(a).max())
    z = np.array([r.vec for r in sorted(linalg.materialise_for_pca(s).collect(), key=lambda r: r.obs_id)])
    sd = x.std(0, ddof=1)
    assert np.allclose(z, np.clip((x - x.mean(0)) / np.where(sd == 0, 1, sd), -2, 2))


def test_gram_by_tiles(m, x, monkeypatch):
    monkeypatch.setattr(linalg, "GRAM_ROWS", 9)
    found = {(r.i, r.j): r.value for r in linalg.gram(m).collect()}
    want = x.T @ x
    assert found == {(i, j): pytest.approx(want[i, j]) for i in range(25) for j in range(i, 25) if ((x[:, i] != 0) & (x[:, j] != 0)).any()}


def test_large_values_do_not_cancel(spark):
    x = np.array([[1e8 + 1, 0], [1e8 + 2, 3], [1e8 + 3, 0], [1e8 + 4, 1e9]])
    found = stats.mean_var(matrix(spark, np.pad(x, ((0, 0), (0, 8)))))
    assert np.allclose(array(found, "var_id", "variance")[:2], x.var(0, ddof=1), rtol=1e-9) and np.allclose(array(found, "var_id", "mean")[:2], x.mean(0))


def test_statistics_are_noted_and_rejected_when_stale(m, x):
    n = transforms.normalize_total(m)
    noted = n.uns[transforms.PRECOMPUTED]
    assert noted.fit(n, "counts") and not noted.fit(n) and noted.total == x.sum()
    assert np.allclose(array(noted.rows, "obs_id", "_row"), x.sum(1)) and np.allclose(array(noted.columns, "var_id", "_column"), x.sum(0))
    want = array(transforms.pearson_residual_variance(m, precomputed=None), "var_id", "residual_variance")
    for given in ("auto", noted):
        assert np.allclose(array(transforms.pearson_residual_variance(n, layer="counts", precomputed=given), "var_id", "residual_variance"), want)
    part = n[:30]
    with pytest.raises(ValueError, match="Stale"):
        transforms.pearson_residual_variance(part, layer="counts", precomputed=noted)
    fresh = transforms.pearson_residual_variance(m[:30], precomputed=None)
    assert np.allclose(array(transforms.pearson_residual_variance(part, layer="counts"), "var_id", "residual_variance"), array(fresh, "var_id", "residual_variance"))
    n.close()


def test_residual_variance_by_batch(m, x):
    found = transforms.pearson_residual_variance(m, by="batch")
    for b, rows in (("A", x[::2]), ("B", x[1::2])):
        one = found.where(F.col("batch") == b)
        part = transforms.pearson_residual_variance(m.subset(F.col("batch") == b))
        for column in ("residual_variance", "mean", "variance"):
            assert np.allclose(array(one, "var_id", column), array(part, "var_id", column), atol=1e-12)
        assert np.allclose(array(one, "var_id", "variance"), rows.var(0))


def test_dense_layers_are_stored_by_their_step(m, x, tmp_path, spark):
    made = {
        "pearson": transforms.pearson_residuals(m),
        "scaled": transforms.scale(transforms.log1p(transforms.normalize_total(m)), -1.5, 1.5),
        "regressed": transforms.regress(m, ["depth"]),
    }
    for k, one in made.items():
        store.write_store(one, str(tmp_path / k), compression="zstd")
        back = store.read_store(spark, str(tmp_path / k))
        name = "X" if k == "pearson" else k
        assert back.layer(name).dense and np.allclose(full(back.filled(name), x.shape), full(one.filled(name), x.shape))
        assert set(back.layers) == set(one.layers)
    assert back.uns == {} and store.read_store(spark, str(tmp_path / "scaled")).X.logged
    own = m.with_layer("own", m.X.then("own", lambda v: v + 1, dense=True))
    with pytest.raises(ValueError, match="own"):
        store.write_store(own, str(tmp_path / "own"))


def test_assignment_of_arrays_and_relations(m, x, spark):
    block = np.arange(6.0).reshape(2, 3)
    want = x.copy()
    want[4:6, 2:5] = block
    assert np.allclose(full(m.assign(slice(4, 6), slice(2, 5), block).filled(), x.shape), want)
    cells = spark.createDataFrame([(4, 2, 9.0), (5, 3, 0.0), (50, 3, 1.0)], "obs_id long, var_id long, value double")
    want[4:6, 2:5] = [[9, 0, 0], [0, 0, 0]]
    assert np.allclose(full(m.assign(slice(4, 6), slice(2, 5), cells).filled(), x.shape), want)
    with pytest.raises(ValueError, match="shape"):
        m.assign(slice(4, 6), slice(2, 5), block.T)


def test_transposed_layers_and_products(m, x, spark):
    s = transforms.scale(m, -1.5, 1.5)
    assert np.allclose(full(s.transposed().filled("scaled"), x.T.shape), full(s.filled("scaled"), x.shape).T)
    assert s.layers["scaled"].has_clip and not m.X.has_clip
    sd = x.std(0, ddof=1)
    z = (x - x.mean(0)) / np.where(sd == 0, 1, sd)
    y = np.random.default_rng(3).normal(size=(x.shape[0], 2))
    right = spark.createDataFrame([(i, k, float(y[i, k])) for i in range(x.shape[0]) for k in range(2)], "obs_id long, k int, w double")
    got = linalg.tmatmul(transforms.scale(m), right)
    for k in range(2):
        assert np.allclose(array(got.where(F.col("k") == k), "var_id"), (z.T @ y)[:, k])
    assert stats.nnz(m) == (x != 0).sum() and stats.nnz(s, "scaled") == (np.abs(full(s.filled("scaled"), x.shape)) > 0).sum()


def test_caches_and_description(m, x):
    with m.persisted().cache(layer="X") as kept:
        assert kept.X.base.is_cached and kept.X.values().count() == (x != 0).sum()
    assert not kept.X.base.is_cached
    assert "25 variables" in m._repr_html_() and m.sample_density(10)["rows"] == 10 and m.sample_density(100)["density"] == pytest.approx((x != 0).mean())


def test_numbers_along_an_order(spark, monkeypatch):
    from tessera.operators import order

    rows = [(k * 7919 % 1000, str(k % 13)) for k in range(1000)] + [(None, "x")]
    for key in ("a", "b"):
        found = order.numbered(spark.createDataFrame(rows, "a long, b string").repartition(5), key).collect()
        found.sort(key=lambda r: r._place)
        assert [r._place for r in found] == list(range(1001))
        keys = [r[key] for r in found]
        assert keys == sorted(keys, key=lambda v: (v is not None, v if v is not None else 0))


def test_matrix_market_kinds(spark, tmp_path):
    def read(text):
        (tmp_path / "k.mtx").write_text(text)
        found = store.read_mtx(spark, str(tmp_path / "k.mtx"))
        out = np.zeros(found.shape)
        for r in found.X.values().collect():
            out[r.obs_id, r.var_id] = r.value
        return out.tolist()

    assert read("%%MatrixMarket matrix array real general\n2 3\n1\n2\n3\n0\n5\n6\n") == [[1, 3, 5], [2, 0, 6]]
    assert read("%%MatrixMarket matrix array real symmetric\n3 3\n1\n2\n3\n4\n5\n6\n") == [[1, 2, 3], [2, 4, 5], [3, 5, 6]]
    assert read("%%MatrixMarket matrix array real skew-symmetric\n3 3\n1\n2\n3\n") == [[0, -1, -2], [1, 0, -3], [2, 3, 0]]
    assert read("%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 4\n") == [[0, -4], [4, 0]]
    assert read("%%MatrixMarket matrix coordinate pattern symmetric\n2 2 2\n2 1\n1 1\n") == [[1, 1], [1, 0]]
    with pytest.raises(ValueError):
        read("%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 2 3\n")


def test_guard_companions(m, x):
    @guard.in_memory(uns=["u"], obsm=["*"], varp=["p"], layer="twice")
    def run(values, obs, var):
        table = values.to_numpy()
        return {"uns": {"u": 3, "left": 4}, "obsm": {"e": table[:, :2]}, "varp": {"p": table.T @ table}, "varm": {"left": 1}}

    done = run(m.with_layer("twice", m.X.then("twice", lambda v: 2 * v)))
    assert done.uns["u"] == 3 and "left" not in done.uns and not done.varm
    assert np.allclose([r.vec for r in sorted(done.obsm["e"].collect(), key=lambda r: r.id)], 2 * x[:, :2])
    got = np.zeros((25, 25))
    for r in done.varp["p"].collect():
        got[r.a, r.b] = r.w
    assert np.allclose(got, 4 * x.T @ x)


def test_store_concat_raw(m, x, tmp_path, spark):
    n = transforms.log1p(transforms.normalize_total(m.with_raw()))
    store.write_store(n, str(tmp_path / "s"))
    back = store.read_store(spark, str(tmp_path / "s"))
    assert np.allclose(np.nan_to_num(full(back.filled(), x.shape)), full(n.filled(), x.shape))
    assert back.raw.n_obs == 60 and set(back.layers) == {"X", "counts"}
    both = store.concat([m[:10, :5], m[F.col("obs_id") >= 50, F.col("var_id") >= 2]])
    assert both.shape == (20, 3) and both.categories("obs", "batch") == ["0", "1"]
    assert store.concat([m[:10, :5], m[:, 2:]], "outer").shape == (70, 25)
    part = n[:7, :3]
    assert part.raw.shape == (7, 25) and np.allclose(full(part.raw.filled(), (7, 25)), x[:7])
    with pytest.raises(ValueError):
        store.concat([m], "cross")


def test_mtx(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% made up\n3 4 2\n1 1 2.5\n3 4 -1\n")
    m = store.read_mtx(spark, str(tmp_path / "a.mtx"))
    assert m.shape == (3, 4) and sorted(map(tuple, m.X.values().collect())) == [(0, 0, 2.5), (2, 3, -1.0)]


def test_names_transpose_guard(m, x, spark):
    named = Matrix(m.obs.withColumn("obs_name", F.lit("a")), m.var, m.layers)
    assert named.unique_names().obs.where("obs_name = 'a-59'").count() == 1
    clash = Matrix(spark.createDataFrame([(0, "a"), (1, "a"), (2, "a-1")], "obs_id long, obs_name string"), m.var, m.layers)
    with pytest.raises(ValueError):
        clash.unique_names()
    assert m.transposed().shape == (25, 60)
    assert np.allclose(full(m.assign(slice(0, 2), None, 5).filled(), x.shape), np.concatenate((np.full((2, 25), 5.0), x[2:])))

    @guard.in_memory(var=["s"])
    def total(values, obs, var):
        var["s"] = values.sum(axis=0).to_numpy()
        obs["ignored"] = 1

    done = total(m)
    assert "ignored" not in done.obs.columns and np.allclose(array(done.var.select("var_id", "s"), "var_id", "s"), x.sum(0))
    with pytest.raises(TypeError):
        guard.in_memory(materialize=False, suggest="Use x.")(lambda values: None)(m)
    assert guard.is_matrix(m) and not guard.is_matrix(x)


def test_robust_scrublet_pegasus(m, x):
    r = stats.robust_genes(m, 50.0)
    assert r.n_vars == (x != 0).any(0).sum()
    block, mask, n = hvg.scrublet_prepare(m, n_top=6)
    assert block.n_vars == n <= 6 and mask.count() == 25
    found = hvg.pegasus_hvf(r, n_top=4, span=0.5)
    assert found.where("highly_variable_features").count() == min(4, r.var.where("robust").count())
    with pytest.raises(KeyError):
        hvg.pegasus_hvf(m)


def test_loess_fits_a_parabola():
    t = np.linspace(0, 4, 60)
    assert np.allclose(hvg.loess(t, t**2 - t, 0.2), t**2 - t)
    with pytest.raises(ValueError):
        hvg.loess(t, t, 0.01)


def test_description_views_and_memory(m, spark, x):
    n = transforms.scale(transforms.log1p(transforms.normalize_total(m)))
    assert [s["step"] for s in n.describe_chain("scaled")] == ["base", "normalize", "log1p", "scale"] and "log1p" in repr(n)
    m.register("t_")
    assert spark.sql("SELECT sum(value) FROM t_X").first()[0] == x.sum()
    assert np.allclose(store.to_memory(m[:4]).to_numpy(), x[:4])
    assert isinstance(m.X, Layer)


def test_empty_matrix(spark, m):
    e = m[[0]][F.lit(False)]
    assert e.n_obs == 0 and stats.axis_sum(e, 0).agg(F.sum("total")).first()[0] == 0
    assert transforms.log1p(transforms.normalize_total(e)).X.values().count() == 0


def test_a_selection_needs_no_window(m):
    plan = m[:5].X.values()._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
