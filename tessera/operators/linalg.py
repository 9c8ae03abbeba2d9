"""Products of a scaled layer by implicit centring, Gram matrices and principal components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.frame import Matrix
from tessera.operators.layers import Layer


def _params(layer: Layer) -> DataFrame:
    if layer.columns is None or not {"_mean", "_std"} <= set(layer.columns.columns):
        raise TypeError("a scaled layer is needed")
    return layer.columns.select("var_id", "_mean", "_std")


def _before(layer: Layer) -> DataFrame:
    """Stored cells of a scaled layer before it was scaled."""
    return replace(layer.before(), columns=None).values()


def matmul(m: Matrix, weights: DataFrame, layer: str = "scaled") -> DataFrame:
    """scaled @ W without clipping: (var_id, k, w) to (obs_id, k, value); only stored cells are multiplied."""
    x = m.layer(layer)
    scaled = weights.join(_params(x), "var_id")
    offset = scaled.groupBy("k").agg(F.sum(F.col("_mean") / F.col("_std") * F.col("w")).alias("_o"))
    product = _before(x).join(scaled, "var_id").groupBy("obs_id", "k").agg(F.sum(F.col("value") / F.col("_std") * F.col("w")).alias("_p"))
    every = m.obs.select("obs_id").crossJoin(offset)  # k columns, a parameter's number
    return every.join(product, ["obs_id", "k"], "left").select("obs_id", "k", (F.coalesce("_p", F.lit(0.0)) - F.col("_o")).alias("value"))


def rmatmul(m: Matrix, weights: DataFrame, layer: str = "scaled") -> DataFrame:
    """Y @ scaled without clipping: (k, obs_id, w) to (k, var_id, value)."""
    x = m.layer(layer)
    sums = weights.groupBy("k").agg(F.sum("w").alias("_y"))
    product = _before(x).join(weights, "obs_id").groupBy("k", "var_id").agg(F.sum(F.col("value") * F.col("w")).alias("_p"))
    every = _params(x).join(m.var.select("var_id"), "var_id").crossJoin(sums)
    return every.join(product, ["k", "var_id"], "left").select("k", "var_id", ((F.coalesce("_p", F.lit(0.0)) - F.col("_y") * F.col("_mean")) / F.col("_std")).alias("value"))


def tmatmul(m: Matrix, weights: DataFrame, layer: str = "scaled") -> DataFrame:
    """scaled.T @ Y without clipping: (obs_id, k, w) to (var_id, k, value)."""
    return rmatmul(m, weights, layer).select("var_id", "k", "value")


#: Columns of a tile of a product, rows that a task is sent at once, about, and rows that it lays out densely.
TILE = 512
GRAM_ROWS = 4096
_DENSE_ROWS = 1024


def _tile_product(table: pa.Table) -> pa.Table:
    """Products of the columns of two tiles over some rows, where some row has both; dense are a few rows at a time, as wide as their cells reach."""
    i_tile, j_tile = table.column("i_tile")[0].as_py(), table.column("j_tile")[0].as_py()
    row = np.unique(np.asarray(table.column("obs_id")), return_inverse=True)[1]
    tile = np.asarray(table.column("tile"))
    sides = []
    for t in (i_tile, j_tile) if i_tile != j_tile else (i_tile,):
        cells = table.column("cells").filter(pa.array(tile == t)).combine_chunks()
        owner = np.repeat(row[tile == t], np.asarray(cells.value_lengths()))
        flat = cells.flatten()
        order = np.argsort(owner, kind="stable")
        at, value = np.asarray(flat.field("var_id"))[order] - t * TILE, np.asarray(flat.field("value"))[order]
        sides.append((owner[order], at, value, at.max(initial=-1) + 1))
    product, both = (np.zeros((sides[0][3], sides[-1][3]), kind) for kind in (np.float64, np.float32))
    for low in range(0, row.max(initial=-1) + 1, _DENSE_ROWS):
        blocks = []
        for owner, at, value, width in sides:
            some = slice(*np.searchsorted(owner, (low, low + _DENSE_ROWS)))
            block = np.zeros((_DENSE_ROWS, width))
            block[owner[some] - low, at[some]] = value[some]
            blocks.append(block)
        product += blocks[0].T @ blocks[-1]
        both += (blocks[0] != 0).astype(np.float32).T @ (blocks[-1] != 0).astype(np.float32)
    if i_tile == j_tile:
        both = np.triu(both)
    i, j = np.nonzero(both)
    return pa.table({"i": pa.array(i + i_tile * TILE, pa.int64()), "j": pa.array(j + j_tile * TILE, pa.int64()), "value": product[i, j]})


def gram(m: Matrix, layer: str | None = None) -> DataFrame:
    """Sums of products of two columns of a sparse layer, i <= j, where not all products are zero.

    By blocks: the columns are cut into tiles, and a task multiplies two tiles over a share of the rows, so a long row costs its
    tiles, not its pairs of cells.
    """
    x = m.layer(layer)
    if x.dense:
        raise ValueError("use pca for dense layers")
    tile = F.floor(F.col("var_id") / TILE).cast("long")
    tiles = [r[0] for r in m.var.select(tile.alias("t")).distinct().orderBy("t").collect()]
    shares = max(1, -(-m.n_obs // GRAM_ROWS))
    rows = x.values().where("value <> 0").groupBy("obs_id", tile.alias("tile")).agg(F.collect_list(F.struct("var_id", "value")).alias("cells"))
    pairs = rows.withColumn("_other", F.explode(F.array(*[F.lit(t).cast("long") for t in tiles])))
    pairs = pairs.select(F.least("tile", "_other").alias("i_tile"), F.greatest("tile", "_other").alias("j_tile"), F.pmod(F.xxhash64("obs_id"), F.lit(shares)).alias("share"), "obs_id", "tile", "cells")
    found = pairs.groupBy("i_tile", "j_tile", "share").applyInArrow(_tile_product, "i long, j long, value double")
    return found.groupBy("i", "j").agg(F.sum("value").alias("value"))


@dataclass(frozen=True)
class Pca:
    """The result of :func:`pca`; ``close`` lets go of the rows that the embedding is projected from."""

    embedding: DataFrame
    components: np.ndarray
    var_ids: np.ndarray
    variance_ratio: np.ndarray
    explained_variance_ratio: np.ndarray
    close: Callable[[], None] = lambda: None


def hvg_mask(m: Matrix, use: bool = True) -> DataFrame | None:
    """The variables marked variable, or None if there is no mark or it marks none or all."""
    key = _mark(m) if use else None
    if key is None:
        return None
    chosen = m.var.where(F.coalesce(F.col(key), F.lit(False)))
    return chosen if 0 < chosen.count() < m.n_vars else None


def _mark(m: Matrix) -> str | None:
    return next((k for k in ("highly_variable_features", "highly_variable") if k in m.var.columns), None)


#: Columns up to which the whole Gram matrix is summed, a task holding its square as doubles; more go by subspace iteration.
MAX_COLUMNS = 4096
#: Doubles of a dense block of rows at most.
_BLOCK = 1 << 21


def _packed(m: Matrix, layer: Layer) -> DataFrame:
    """A row for each observation with the places and values of its stored cells; rows without any stay."""
    cells = layer.values().join(m.var.select("var_id", "_place"), "var_id")
    rows = cells.groupBy("obs_id").agg(F.collect_list(F.struct("_place", "value")).alias("cells"))
    return m.obs.select("obs_id").join(rows, "obs_id", "left").select("obs_id", F.col("cells._place").alias("at"), F.col("cells.value").alias("values"))


def _blocks(batches: Iterator[pa.RecordBatch], zero: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    step = max(1, min(512, _BLOCK // max(1, len(zero))))
    for whole in batches:
        for a in range(0, len(whole), step):
            batch = whole.slice(a, step)
            block = np.tile(zero, (len(batch), 1))
            at, values = batch.column("at").fill_null([]), batch.column("values").fill_null([])
            owner = np.repeat(np.arange(len(batch)), np.asarray(at.value_lengths()))
            block[owner, np.asarray(at.flatten(), dtype=np.int64)] = np.asarray(values.flatten())
            yield batch.column("obs_id"), block


def _sum_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b.as_py()) for b in table.column("block"))
    return pa.table({"tile": table.column("tile")[:1], "block": pa.array([total.tobytes()], pa.binary())})


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the matrices that tasks emit in tiles of rows (tile, block), added up in two levels; the result is one matrix."""
    first = parts.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("tile", "share").applyInArrow(_sum_blocks, "tile long, block binary")
    found = first.groupBy("tile").applyInArrow(_sum_blocks, "tile long, block binary").toArrow()
    out = np.zeros(shape)
    for tile, block in zip(found.column("tile").to_pylist(), found.column("block"), strict=True):
        rows = np.frombuffer(block.as_py()).reshape(-1, shape[1])
        out[tile * TILE : tile * TILE + len(rows)] = rows
    return out


def _emit(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(total), TILE):
        yield pa.record_batch([pa.array([k // TILE], pa.int64()), pa.array([np.ascontiguousarray(total[k : k + TILE]).tobytes()], pa.binary())], names=["tile", "block"])


class _Rows:
    """The rows of the selected variables as dense blocks, zeros and clipping included."""

    def __init__(self, m: Matrix, layer: str, use_highly_variable: bool):
        x = m.layer(layer) if layer in m.layers else m.X
        if x.dense and x.steps[-1].name != "scale":
            raise ValueError("only scaled or sparse layers")
        spark = m.obs.sparkSession
        # What has a row for each variable is worked out once, here; passes over the cells join it as it is.
        key = _mark(m) if use_highly_variable else None
        marks = m.var.select("var_id", (F.coalesce(F.col(key), F.lit(False)) if key else F.lit(True)).alias("marked")).orderBy("var_id").collect()
        chosen = [r.var_id for r in marks if r.marked]
        self.ids = chosen or [r.var_id for r in marks]
        self.n = len(self.ids)
        places = spark.createDataFrame(list(zip(self.ids, range(self.n), strict=True)), "var_id long, _place long")
        if self.n < len(marks):
            m, x = m.subset(None, places), x.kept(None, places)
        self.matrix, self.zero = m, np.zeros(self.n)
        if x.columns is not None:
            held = x.columns.join(F.broadcast(places.select("var_id")), "var_id", "left_semi")
            columns = spark.createDataFrame(held.collect(), held.schema)
            x = replace(x, columns=columns)
            if x.dense:
                for k, v in columns.join(places, "var_id").select("_place", x.at_zero()).collect():
                    self.zero[k] = v
        self.rows = _packed(m.with_var(places), x).persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        self.rows.unpersist()

    def gram(self) -> np.ndarray:
        zero, n = self.zero, self.n

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n, n))
            for _, block in _blocks(batches, zero):
                total += block.T @ block
            yield from _emit(total)

        return _summed(self.rows.mapInArrow(products, "tile long, block binary"), (n, n))

    def gram_times(self, basis: np.ndarray) -> tuple[np.ndarray, float]:
        """A.T @ (A @ basis) and the sum of the squares of A, in one pass."""
        zero, n = self.zero, self.n
        shipped = self.matrix.obs.sparkSession.sparkContext.broadcast(basis)

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n + 1, basis.shape[1]))
            for _, block in _blocks(batches, zero):
                total[:n] += block.T @ (block @ shipped.value)
                total[n, 0] += np.einsum("ij,ij->", block, block)
            yield from _emit(total)

        found = _summed(self.rows.mapInArrow(products, "tile long, block binary"), (n + 1, basis.shape[1]))
        return found[:n], float(found[n, 0])

    def project(self, vectors: np.ndarray | None) -> DataFrame:
        """obs_id and vec, the row in a basis, or as it is."""
        zero = self.zero
        shipped = None if vectors is None else self.matrix.obs.sparkSession.sparkContext.broadcast(vectors)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for obs, block in _blocks(batches, zero):
                out = block if shipped is None else block @ shipped.value
                yield pa.record_batch([obs, pa.array(list(out), pa.list_(pa.float64()))], names=["obs_id", "vec"])

        return self.rows.mapInArrow(run, "obs_id long, vec array<double>")


def materialise_for_pca(m: Matrix, layer: str = "scaled", use_highly_variable: bool = True) -> DataFrame:
    """obs_id and vec: the dense rows that :func:`pca` works on, in the order of var_id; the main layer stands in for a missing one."""
    return _Rows(m, layer, use_highly_variable).project(None)


def pca(m: Matrix, layer: str = "scaled", n_comps: int = 50, n_oversamples: int = 10, use_highly_variable: bool = True, iterations: int = 6, seed: int = 0) -> Pca:
    """Principal components of the selected variables.

    Tasks build dense blocks of a few hundred rows, zeros and clipping included. Up to ``MAX_COLUMNS`` variables they add up the
    Gram matrix, which the driver decomposes: exact. Beyond, ``iterations`` passes turn a random subspace of
    n_comps + n_oversamples dimensions towards the leading one (A.T @ (A @ basis), orthonormalised), and the
    components are the best within it; a task and the driver hold a matrix of variables by dimensions. Not re-centred after clipping.
    ``variance_ratio`` is over the n_comps + n_oversamples components kept, ``explained_variance_ratio`` over
    all. Signs make the largest loading of a component positive.
    """
    rows = _Rows(m, layer, use_highly_variable)
    n = rows.n
    kept = min(n_comps + n_oversamples, rows.rows.count(), n)
    if n <= MAX_COLUMNS:
        values, vectors = np.linalg.eigh(rows.gram())
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        whole = values.sum()
    else:
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, kept)))[0]
        for _ in range(iterations):
            basis = np.linalg.qr(rows.gram_times(basis)[0])[0]
        product, whole = rows.gram_times(basis)
        inner = basis.T @ product
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, vectors = np.maximum(values[::-1], 0), basis @ turn[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1) if n else vectors
    k = min(n_comps, kept)
    top = values[:kept].sum()
    return Pca(rows.project(np.ascontiguousarray(vectors[:, :k])), vectors[:, :k].T, np.array(rows.ids), values[:k] / (top or 1), values[:k] / (whole or 1), rows.close)
