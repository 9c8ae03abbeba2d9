"""Streams of cells against the same cells at rest."""

import pytest

from tessera.streaming import cells


def test_sums_of_arriving_cells(spark, tmp_path):
    come, kept, mark = (str(tmp_path / k) for k in ("come", "kept", "mark"))
    first = [(1, 1, 2.0), (1, 2, 3.0), (2, 1, 0.0)]
    second = [(1, 1, 4.0), (3, 2, 5.0)]
    put = lambda rows: spark.createDataFrame(rows, cells.SCHEMA).coalesce(1).write.mode("append").parquet(come)
    put(first)
    for rows in (None, second):
        if rows:
            put(rows)
        query = cells.keep_sums(cells.arriving(spark, come), 1, kept, mark)
        assert query.awaitTermination(120)
    assert sorted(map(tuple, cells.kept_sums(spark, 1, kept).collect())) == [(1, 9.0, 3), (3, 5.0, 1)]
    obs = spark.createDataFrame([(k, str(k)) for k in (1, 2, 3)], "obs_id long, obs_name string")
    var = spark.createDataFrame([(k, str(k)) for k in (1, 2)], "var_id long, var_name string")
    found = cells.matrix_so_far(spark, obs, var, come).X.values().collect()
    assert sorted(map(tuple, found)) == [(1, 1, 6.0), (1, 2, 3.0), (3, 2, 5.0)]


def test_running_sums(spark, tmp_path):
    spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0), (2, 2, 0.0)], cells.SCHEMA).write.parquet(str(tmp_path / "c"))
    stream = cells.running_sums(cells.arriving(spark, str(tmp_path / "c")), 0)
    assert stream.isStreaming
    query = stream.writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.table("sums").collect() == [(1, 5.0, 2)]
    with pytest.raises(ValueError):
        cells.running_sums(stream, 2)
