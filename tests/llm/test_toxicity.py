import random
import zlib

from tessera.llm import toxicity


def corpus(n=900, seed=1):
    rnd = random.Random(seed)
    stem = "Vilenk"
    rows, labels = [], []
    for d in range(n):
        words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(rnd.randint(5, 120))]
        bad = rnd.random() < 0.2
        if bad:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["scoundrel", stem + rnd.choice(["heit", "ung", "ich", "t"])]) + rnd.choice(["", "!", "."]))
        rows.append((d, " ".join(words)))
        if rnd.random() < 0.7:
            labels.append((d, int(bad)))
    return rows, labels, {d for d, t in rows if "scoundrel" in t or stem in t}


def test_held_out_accuracy_and_edge_cases(spark):
    rows, labels, bad = corpus()
    rows += [(2000, None), (2001, ""), (2002, "?!"), (5, rows[5][1]), (None, "scoundrel scoundrel")]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(3)
    marks = spark.createDataFrame([(d, 1, t) for d, t in labels] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    found = toxicity.classify(docs, marks).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in found if r.held_out and r.doc_id < 900]
    assert sum((r.doc_id in bad) == bool(r.predicted) for r in held) >= 0.97 * len(held)
    assert len({r.score for r in found if r.doc_id in (2000, 2001, 2002)}) == 1
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if not r.predicted}


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.classify(docs, none).collect()] == [0.5]
    assert toxicity.classify(docs.limit(0), none).collect() == []


def test_the_classifier_equals_brute_force(spark):
    """FTRL-proximal with dictionaries, feature by feature, over the same rows in the same order."""
    import math

    import numpy as np
    import pyarrow as pa

    rows, labels, _ = corpus(120, 3)
    weights = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int"), epochs=2)
    learnt = [(d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 5]
    ranks = {r.doc_id: r.k for r in spark.createDataFrame(learnt, "doc_id long, toxic int").selectExpr("doc_id", "xxhash64(doc_id, 17) AS k").collect()}
    texts, bias = dict(rows), 1 << toxicity.BITS
    z, n = {}, {}

    def weight(k):
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= 2.5 else (math.copysign(2.5, v) - v) / ((1 + math.sqrt(n.get(k, 0.0))) / 2 + 1)

    for _ in range(2):
        for d, y in sorted(learnt, key=lambda x: ranks[x[0]]):
            at = [*next(toxicity.features(pa.array([texts[d]]), toxicity.BITS)).tolist(), bias]
            w = {k: weight(k) for k in at}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - y
            for k in at:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / 2 * w[k]
                n[k] = old + g * g
    want = np.zeros(bias + 1)
    for k in z:
        want[k] = weight(k)
    assert np.allclose(weights, want) and np.count_nonzero(want) > 10


def test_features_and_shingles_hold_little(monkeypatch):
    """Chunks of 1 MB took 27 to 46 MB of each worker, which the pipeline's executors lacked."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tessera.llm import _text

    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 100_000, 700)) for _ in range(400)])
    for make, most in ((lambda c: toxicity.features(c, 20), 16), (lambda c: _text.shingle_sets(c, 5), 12)):
        monkeypatch.setattr(_text, "_powers", [np.ones(1, np.uint64)] * 2)
        tracemalloc.start()
        found = sum(1 for _ in make(texts))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == 400 and peak < most << 20, peak
