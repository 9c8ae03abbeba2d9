import random

import pytest

from tessera.llm import mixing
from tessera.llm.mixing import mix, sample, water_fill


def fill(sizes, weights, most):
    """Targets by clamping one round after another."""
    capped, total = set(), sum(sizes)
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        rest = total - sum(most * sizes[k] for k in capped)
        share = {k: rest * weights[k] / sum(weights[j] for j in free) for k in free}
        over = {k for k in free if share[k] > most * sizes[k]}
        if not over:
            return [most * sizes[k] if k in capped else share[k] for k in range(len(sizes))]
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_water_filling(spark, seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([0, 5, 40, 1000, 30_000]) + rnd.randint(1, 9) for _ in range(12)]
    weights = [float(k % 3 + 1) for k in range(12)]
    rows = spark.createDataFrame([(f"s{k:02}", s, w) for k, (s, w) in enumerate(zip(sizes, weights, strict=True))], "source string, source_size long, weight double")
    found = [r.target for r in water_fill(rows).orderBy("source").collect()]
    assert found == pytest.approx(fill(sizes, weights, 3))


def test_mix(spark):
    rnd = random.Random(8)
    rows = [(d, " ".join(["w"] * rnd.randint(0, 30)) + rnd.choice(["", " \n\t"]), rnd.choice(["b", "ä", "a", "Z", None, ""] + ["hot"] * 6), 7) for d in range(3000)]
    rows += [(5000, None, "a", 1), (5001, "x y", "tiny", 1), (5001, "x y", "tiny", 1), (None, "z", "b", 1), (5002, "", "blank", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    found = mix(frame).collect()
    assert len(found) == len(rows) and found[0].asDict().keys() == {"doc_id", "text", "source", "size", "source_size", "target", "repeats"}
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = dict(zip(order, fill([sizes[s] for s in order], [k % 3 + 1 for k in range(len(order))], 3), strict=True))
    taken = dict.fromkeys(order, 0)
    for r in found:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source] and 0 <= r.repeats <= 3
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.size * r.repeats
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)
    again = mix(frame.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert sample(frame).count() == sum(r.repeats for r in found)


def test_empty_and_blank_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mix(spark.createDataFrame([], schema)).collect() == []
    assert [(r.target, r.repeats) for r in mix(spark.createDataFrame([(1, " ", None)], schema)).collect()] == [(0.0, 0)]


def test_only_native_operators(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, source string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
