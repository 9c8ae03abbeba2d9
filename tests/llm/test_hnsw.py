import numpy as np

from tessera.llm import hnsw


def brute(rows, least):
    def fit(v):
        return v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)

    out, n = [], len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for i, (a, v, k) in enumerate(rows):
        for j, (b, w, m) in enumerate(rows):
            if i != j and None not in (a, b, k) and k == m and fit(v) and fit(w) and len(v) == len(w):
                v1, w1 = np.array(v, float), np.array(w, float)
                if v1 @ w1 / np.sqrt((v1 @ v1) * (w1 @ w1)) >= least:
                    links[i] += 1
                    root[find(i)] = find(j)
    low = {}
    for i, (a, _, _) in enumerate(rows):
        if a is not None:
            low[find(i)] = min(a, low.get(find(i), a))
    for i, (a, _, _) in enumerate(rows):
        c = low.get(find(i)) if a is not None else None
        out.append((a, links[i], c, a == c))
    return sorted(out, key=str)


def data():
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1, 2):
        centres = rng.normal(size=(40, 16))
        for c in centres:
            for _ in range(rng.integers(1, 12)):
                rows.append((len(rows), (c + rng.normal(size=16) * rng.choice([0.02, 0.08, 0.2])).tolist(), label))
    v = rows[3][1]
    odd = [v, None, [], [0.0] * 16, [None, *v[1:]], [float("nan"), *v[1:]], [float("inf"), *v[1:]], v[:8], [2 * x for x in v], v]
    rows += [(len(rows) + k, x, 0) for k, x in enumerate(odd)]
    return [*rows, (len(rows), v, None), (None, v, 0)]


def test_equals_brute_force(spark, monkeypatch):
    rows = data()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n_links int").repartition(3)
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 60)
    found = hnsw.near_copies(frame, 0.98).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, 0.98)
    twice = hnsw.near_copies(frame.union(frame), 0.98).collect()
    assert sorted(map(tuple, twice), key=str) == brute(rows, 0.98)


def test_graphs_are_searched_across_shards(spark, monkeypatch):
    """Several shards of some hundreds of vectors, whose links are mostly to other shards."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(900, 24))
    rows = [(k, (centres[k // 2] + rng.normal(size=24) * 0.03).tolist(), "a") for k in range(1800)] + [(2000 + k, centres[k].tolist(), "b") for k in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(4)
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 250)
    monkeypatch.setattr(hnsw, "FAN", 2)
    found = {r.vec_id: r for r in hnsw.near_copies(frame, 0.98).collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x = hnsw.unit(x)
    true = (x @ x.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    true[:1800, 1800:] = true[1800:, :1800] = False
    assert len(found) == len(rows) and true.sum() > 1500
    got = np.array([found[r[0]].n_links for r in rows])
    assert (got <= true.sum(1)).all() and got.sum() >= 0.99 * true.sum()
    audits = hnsw.audits(frame, 0.98).collect()
    assert len(audits) == 9 and all(r.led_back >= 0.99 * r.probes and r.refound >= 0.99 * r.audited for r in audits)


def test_empty_table(spark):
    assert hnsw.near_copies(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_recall_of_the_graph():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(300, 32)), 10, axis=0)
    x = hnsw.unit(x + rng.normal(size=x.shape) * 0.05)
    x32 = x.astype(np.float32)
    graph = hnsw.Graph.load(hnsw.Graph.build(x32).dump(), x32)
    assert graph.led_back(0.98, 32)[1] >= 0.99 * graph.led_back(0.98, 32)[0]
    true = x @ x.T >= 0.98
    got = np.zeros_like(true)
    for q, c in graph.within(x.astype(np.float32), 0.98, 16):
        got[q, c] = True
    assert (got & true).sum() >= 0.99 * true.sum()
