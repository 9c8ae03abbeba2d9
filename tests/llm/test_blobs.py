import numpy as np
import pyarrow as pa

from tessera.llm import _blobs


def records(batches, dtypes):
    out = []
    for b in batches:
        for part, block in zip(b.column("part").to_pylist(), b.column("block"), strict=True):
            out += [(part, *r) for r in zip(*(c.tolist() for c in _blobs.decode(block.as_py(), dtypes)), strict=True)]
    return sorted(out)


def test_two_levels_deal_as_one_does():
    rng = np.random.default_rng(1)
    for parts in (7, _blobs.WIDE, 9 * _blobs.WIDE + 5):
        part, a, b = rng.integers(0, parts, 5000).astype(np.int32), rng.integers(0, 1 << 60, 5000), rng.random(5000)
        packer = _blobs.Packer(parts, 700)
        found = [x for k in range(0, 5000, 100) for x in packer.add(part[k : k + 100], a[k : k + 100], b[k : k + 100])] + list(packer.flush())
        if parts > _blobs.WIDE:
            assert max(x for f in found for x in f.column("part").to_pylist()) < _blobs.WIDE
            found = list(_blobs._deal_on(parts, ("i8", "f8"))(iter(found)))
        assert records(found, ("i8", "f8")) == sorted(zip(part.tolist(), a.tolist(), b.tolist(), strict=True))


def test_kinds_are_dealt_apart():
    parts = 5 * _blobs.WIDE
    batches = []
    for kind, dtype in ((0, np.int64), (1, np.uint8)):
        packer = _blobs.Packer(parts)
        for x in [*packer.add(np.array([3, parts - 1], np.int32), np.array([1, 2], dtype)), *packer.flush()]:
            batches.append(pa.record_batch([x.column("part"), pa.array([kind] * len(x), pa.int32()), x.column("block")], names=["part", "kind", "block"]))
    found = list(_blobs._deal_on(parts, {0: ("i8",), 1: ("u1",)})(iter(batches)))
    for kind, dtype in ((0, "i8"), (1, "u1")):
        some = [x.filter(pa.array([k == kind for k in x.column("kind").to_pylist()])) for x in found]
        assert records(some, (dtype,)) == [(3, 1), (parts - 1, 2)]


def test_operators_over_very_many_parts(spark, monkeypatch):
    """The whole way through two levels, which workers take by the number of parts alone."""
    from tessera.llm import suffix

    text = "the same passage of more than a hundred bytes, which stands in both of the texts and so goes from the second one"
    rows = [(1, "a " + text), (2, text + " b"), (3, "short")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    real = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2100")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "8")
    try:
        found = {r.doc_id: r.n_removed for r in suffix.repeated_bytes(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", real)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    assert found == {1: 0, 2: len(text), 3: 0}
