"""Embedding near-copies by hierarchical navigable small-world graphs.

Vectors of one label are dealt by hash to shards of bounded size, and a graph is built for each. Every
vector queries its own shard's graph where that is built, and those of all later shards of its label: a task holds one graph and
streams the blocks of a few shards past it. A beam that is full of linked vectors may have missed more, so it is widened
for that vector. Each graph is audited: vectors turned away from known nodes to just within the threshold must lead back to these,
and links found by brute force for a sample of its nodes must be found; its beams are widened until both recalls pass. Links are verified in
double precision, counted, and reduced to a spanning forest in the task, so no pairs leave it; components
are then united across tasks. Searching and building are numpy over many queries at a time.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._blobs import trim
from tessera.llm._graph import checkpoint, components
from tessera.llm._text import mix

#: Vectors in a shard at most on average, shards whose vectors one task streams past a graph, neighbours of a node.
SHARD_ROWS = 16_384
FAN = 4
NEIGHBOURS = 16
BUILD_BEAM = 48
#: Recall that both audits of a graph must reach, the nodes turned away from, and those whose links are found by brute force.
RECALL = 0.99
PROBES = 256
AUDITED = 48
#: Bytes of a row for each label up to which they are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 16 << 20
_GATHER = 1 << 16


def search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first beam search of all queries: ids by falling similarity (-1 where fewer) and similarities."""
    rows, expand = len(queries), max(1, min(beam // 8, 16))
    seen = np.zeros((rows, len(vectors) + 1), dtype=bool)
    ids = np.full((rows, beam), -1)
    sims = np.full((rows, beam), -np.inf, np.float32)
    open_ = np.zeros((rows, beam), dtype=bool)
    line = np.arange(rows)
    ids[:, 0], sims[:, 0], open_[:, 0] = entry, np.einsum("ij,ij->i", vectors[entry], queries), True
    seen[line, entry] = True
    active = line
    while len(active):
        rank = np.where(open_[active], sims[active], -np.inf)
        best = np.argpartition(-rank, expand - 1, axis=1)[:, :expand] if expand < beam else np.tile(np.arange(beam), (len(active), 1))
        valid = np.take_along_axis(rank, best, 1) > -np.inf
        some = valid.any(1)
        active, best, valid = active[some], best[some], valid[some]
        if not len(active):
            break
        chosen = np.where(valid, ids[active[:, None], best], -1)
        open_[active[:, None], best] = False
        near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(active), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        found = np.full(near.shape, -np.inf, np.float32)
        r, c = np.nonzero(fresh)
        found[r, c] = np.einsum("ij,ij->i", vectors[near[r, c]], queries[active[r]])
        all_ids = np.concatenate((ids[active], near), axis=1)
        all_sims = np.concatenate((sims[active], found), axis=1)
        all_open = np.concatenate((open_[active], fresh), axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active], sims[active], open_[active] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_open))
    order = np.argsort(-sims, axis=1)
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    ids[sims == -np.inf] = -1
    return ids, sims


def diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of candidates by falling similarity up to ``keep``, first those nearer to the node than to any chosen one."""
    rows, width = ids.shape
    points = vectors[ids]
    between = np.einsum("rik,rjk->rij", points, points)
    chosen = np.zeros((rows, width), dtype=bool)
    nearest = np.full((rows, width), -np.inf, np.float32)
    for c in range(width):
        take = (ids[:, c] >= 0) & (sims[:, c] > nearest[:, c]) & (chosen.sum(1) < keep)
        chosen[:, c] = take
        nearest = np.where(take[:, None], np.maximum(nearest, between[:, :, c]), nearest)
    order = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)) * width + np.arange(width), axis=1, kind="stable")[:, :keep]
    out = np.full((rows, keep), -1)
    out[:, : order.shape[1]] = np.take_along_axis(ids, order, 1)
    return out


class Graph:
    """Layers of one index; layer 0 has all nodes, each higher one a random NEIGHBOURS-th of them."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        n = len(vectors)
        lot = (mix(np.arange(n, dtype=np.uint64) + np.uint64(11)) >> np.uint64(11)).astype(float) / (1 << 53)
        level = np.minimum(8, np.floor(-np.log(np.maximum(lot, 1e-18)) / np.log(NEIGHBOURS))).astype(int)
        graph = cls(vectors, [])
        for layer in range(level.max(initial=0), -1, -1):
            nodes = np.flatnonzero(level >= layer)
            links = np.full((n + 1, 2 * NEIGHBOURS), -1, np.int32)
            order = nodes[np.argsort(-level[nodes], kind="stable")]
            done = 0
            while done < len(order):
                batch = order[done : done + max(64, min(512, done))]
                graph._insert(links, batch, order[:done])
                done += len(batch)
            graph.layers.insert(0, links)
        graph.entry = int(np.argmax(level)) if n else 0
        return graph

    entry = 0

    def _descend(self, queries: np.ndarray) -> np.ndarray:
        entry = np.full(len(queries), self.entry)
        for links in reversed(self.layers[1:]):
            entry = search(self.vectors, links, queries, entry, 4)[0][:, 0]
        return entry

    def _insert(self, links: np.ndarray, batch: np.ndarray, before: np.ndarray) -> None:
        queries = self.vectors[batch]
        inner = queries @ queries.T
        np.fill_diagonal(inner, -np.inf)
        width = min(BUILD_BEAM // 2, len(batch) - 1)
        near = np.argsort(-inner, axis=1)[:, :width]
        ids, sims = batch[near], np.take_along_axis(inner, near, 1)
        if len(before):
            entry = np.full(len(batch), before[0])
            for upper in reversed(self.layers):
                entry = search(self.vectors, upper, queries, entry, 4)[0][:, 0]
            old, old_sims = search(self.vectors, links, queries, entry, BUILD_BEAM)
            ids, sims = np.concatenate((old, ids), axis=1), np.concatenate((old_sims, sims), axis=1)
        if not ids.shape[1]:
            return
        order = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        chosen = diverse(self.vectors, ids, sims, NEIGHBOURS)
        links[batch, :NEIGHBOURS] = chosen
        self._back(links, np.repeat(batch, NEIGHBOURS), chosen.ravel())

    def _back(self, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        """Adds the links from each target to its source, keeping diverse ones where there are too many."""
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for a in range(0, len(nodes), 512):
            some, begin, n = nodes[a : a + 512], first[a : a + 512], count[a : a + 512]
            # Of many new ones in a batch the first suffice for a node; the beam reaches the rest through them.
            wide = min(int(n.max()), 3 * NEIGHBOURS)
            at = begin[:, None] + np.arange(wide)
            new = np.where(np.arange(wide) < n[:, None], source[np.minimum(at, len(source) - 1)], -1)
            ids = np.concatenate((links[some], new), axis=1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids >= 0, np.einsum("rik,rk->ri", self.vectors[ids], self.vectors[some]), -np.inf)
            order = np.argsort(-sims, axis=1)
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            links[some] = diverse(self.vectors, ids, sims, 2 * NEIGHBOURS)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, entry=self.entry, **{f"l{k}": x for k, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes, vectors: np.ndarray) -> Graph:
        x = np.load(io.BytesIO(raw))
        graph = cls(vectors, [x[f"l{k}"] for k in range(len(x.files) - 1)])
        graph.entry = int(x["entry"])
        return graph

    def within(self, queries: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs of similarity ``least`` or more that beams find, widened where they are full of them."""
        left = np.arange(len(queries))
        while len(left):
            beam = min(beam, len(self.vectors))
            full = []
            for some in np.array_split(left, -(-len(left) * beam // (1 << 14)) or 1):
                if not len(some):
                    continue
                ids, sims = search(self.vectors, self.layers[0], queries[some], self._descend(queries[some]), beam)
                again = (sims[:, -1] >= least) & (ids[:, -1] >= 0) & (beam < len(self.vectors))
                full.append(some[again])
                r, c = np.nonzero((sims >= least) & (ids >= 0) & ~again[:, None])
                yield some[r], ids[r, c]
            left = np.concatenate(full) if full else left[:0]
            beam *= 4

    def led_back(self, least: float, beam: int) -> tuple[int, int]:
        """Nodes turned away from, by a random angle up to the threshold's, and how many of them a search finds from there."""
        rng = np.random.default_rng(5)
        nodes = np.unique(rng.integers(0, len(self.vectors), min(PROBES, len(self.vectors))))
        base = self.vectors[nodes].astype(float)
        aside = rng.normal(size=base.shape)
        aside -= np.einsum("ij,ij->i", aside, base)[:, None] * base
        size = np.linalg.norm(aside, axis=1, keepdims=True)
        cosine = rng.uniform(least, 1, (len(nodes), 1))
        turned = np.where(size > 1e-9, cosine * base + np.sqrt(1 - cosine**2) * aside / np.maximum(size, 1e-9), base)
        found = np.zeros(len(nodes), bool)
        for q, c in self.within(turned.astype(np.float32), least - 1e-5, beam):
            found[q[c == nodes[q]]] = True
        return len(nodes), int(found.sum())


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _flat(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    flat = np.concatenate([np.asarray(c.flatten(), dtype=kind) for c in column.chunks]) if column.num_chunks else np.zeros(0, kind)
    return flat.reshape(len(column), -1)


def _unite(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        parent[np.maximum(a, b)] = np.minimum(a, b)
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]


class _Links:
    """Links among the nodes of one graph and those that query it: how many each has, and a forest of them."""

    def __init__(self, *ids: np.ndarray):
        self.ids = np.unique(np.concatenate(ids))
        self.count, self.parent = np.zeros(len(self.ids), np.int64), np.arange(len(self.ids))

    def add(self, x: np.ndarray, y: np.ndarray, weight_x: np.ndarray, weight_y: np.ndarray, both: bool) -> None:
        x, y = np.searchsorted(self.ids, x), np.searchsorted(self.ids, y)
        np.add.at(self.count, x, weight_y)
        if both:
            np.add.at(self.count, y, weight_x)
        self.parent = _unite(self.parent, x, y)

    def rows(self) -> dict[str, list]:
        some, child = np.flatnonzero(self.count), np.flatnonzero(self.parent != np.arange(len(self.ids)))
        return {"linked": self.ids[some], "links": self.count[some], "child": self.ids[child], "parent": self.ids[self.parent[child]]}


def _near(graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) that a search finds, verified in double precision."""
    for q, c in graph.within(queries.astype(np.float32), least - 1e-5, beam):
        for a in range(0, len(q), _GATHER):
            x, y = q[a : a + _GATHER], c[a : a + _GATHER]
            good = np.einsum("ij,ij->i", queries[x], exact[y]) >= least
            yield x[good], y[good]


_RESULT = "linked array<long>, links array<long>, child array<long>, parent array<long>"
_INDEX = f"key string, shard long, shards long, ids binary, weights binary, raw binary, graph binary, beam int, probes int, led_back int, audited long, refound long, {_RESULT}"


def _build(least: float, kind: str) -> Callable:
    """The graph of a shard, audited, and the links within it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(np.asarray(table.column("id")))))
        ids, weights = np.asarray(table.column("id")), np.asarray(table.column("weight"))
        raw = _flat(table.column("embedding"), kind)
        exact = unit(raw.astype(float))
        graph = Graph.build(exact.astype(np.float32))
        sample = np.unique(np.linspace(0, len(ids) - 1, AUDITED).astype(int))
        truth = exact[sample] @ exact.T >= least
        truth[np.arange(len(sample)), sample] = False
        beam = 32
        while True:
            links, seen, probes = _Links(ids), 0, graph.led_back(least, beam)
            if probes[1] >= RECALL * probes[0] or beam >= len(ids):
                for x, y in _near(graph, exact, exact, least, beam):
                    x, y = x[x != y], y[x != y]
                    links.add(ids[x], ids[y], weights[x], weights[y], False)
                    seen += int(np.isin(x, sample).sum())
                if seen >= RECALL * truth.sum() or beam >= len(ids):
                    break
            beam *= 2
        many = table.column("shards")[0].as_py() > 1
        row = {"key": table.column("key")[0].as_py(), "shard": table.column("shard")[0].as_py(), "shards": table.column("shards")[0].as_py()}
        row |= {"ids": ids.tobytes(), "weights": weights.tobytes(), "raw": raw.tobytes(), "graph": graph.dump()} if many else dict.fromkeys(("ids", "weights", "raw", "graph"))
        row |= {"beam": beam, "probes": probes[0], "led_back": probes[1], "audited": int(truth.sum()), "refound": seen}
        trim()
        return _rows([row | links.rows()], _INDEX)

    return run


def _rows(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([r[n] for r in rows], kinds[t]) for n, t in names})


def _across(least: float, kind: str) -> Callable:
    """Links between the nodes of a graph and the vectors of some earlier shards."""

    def run(key: tuple, graphs: pa.Table, blocks: pa.Table) -> pa.Table:
        if not len(graphs) or not len(blocks):
            return _rows([], _RESULT)
        get = lambda row, name, kind: np.frombuffer(row[name], kind)
        node = graphs.slice(0, 1).to_pylist()[0]
        ids, weights = get(node, "ids", np.int64), get(node, "weights", np.int64)
        exact = unit(get(node, "raw", kind).reshape(len(ids), -1).astype(float))
        graph = Graph.load(node["graph"], exact.astype(np.float32))
        out = []
        for k in range(len(blocks)):
            block = blocks.slice(k, 1).to_pylist()[0]
            own, mine = get(block, "ids", np.int64), get(block, "weights", np.int64)
            queries = unit(get(block, "raw", kind).reshape(len(own), -1).astype(float))
            links = _Links(own, ids)
            for x, y in _near(graph, exact, queries, least, node["beam"]):
                links.add(own[x], ids[y], mine[x], weights[y], True)
            out.append(links.rows())
        trim()
        return _rows(out, _RESULT)

    return run


def _index(vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """Distinct rows and whether they are fit, the classes of equal vectors, the audited graphs, and the type of components."""
    e = F.col("embedding")
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    fit &= F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), e.cast("array<float>" if kind == "f4" else "array<double>").alias("embedding"))
    # Vectors with one content are one node; 128 bits of hash name it, so only its smallest id carries the content.
    names = [F.xxhash64(F.lit(k), "label", "embedding").alias(f"h{k}") for k in range(2)]
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False))).select("*", *names)
    narrow = checkpoint(rows.select("vec_id", "fit", "h0", "h1").distinct())
    key = F.concat_ws(":", F.size(F.min("embedding")).cast("string"), F.min("label"))
    weights = narrow.where("fit").groupBy("h0", "h1").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    content = rows.where("fit").groupBy("h0", "h1").agg(key.alias("key"), F.min("embedding").alias("embedding"))
    classes = checkpoint(content.join(weights, ["h0", "h1"]))
    shards = checkpoint(classes.groupBy("key").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("shards")))
    few = (shards.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    dealt = classes.join(F.broadcast(shards) if few else shards, "key").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))
    index = checkpoint(dealt.select("key", "shard", "shards", "id", "weight", "embedding").groupBy("key", "shard").applyInArrow(_build(least, kind), _INDEX))
    return narrow, classes, index, kind


def audits(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """What the audits of :func:`near_copies` found, by shard: key, shard, beam, probes, led_back, audited (links by brute force), refound."""
    return _index(vectors, least)[2].select("key", "shard", "beam", "probes", "led_back", "audited", "refound")


def near_copies(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """Links and components of ``vectors`` (vec_id, embedding, label, any further columns).

    Vectors of equal, not null labels and equal lengths link when their cosine is ``least`` or more. Returns a row for
    each distinct vec_id, label and embedding: vec_id, n_links (other vectors linked directly), component_id (the
    smallest vec_id reachable) and kept (it is its own component). Vectors that are null, empty, zero or hold null, NaN or
    infinite components link with nothing, nor do rows whose vec_id is null (then their component is null and
    they are kept). A row that repeats another is the same vector. Vectors may be of any length; an empty table gives an empty result.
    """
    narrow, classes, index, kind = _index(vectors, least)
    result = ["linked", "links", "child", "parent"]
    found = index.select(*result)
    many = index.where("shards > 1")
    if many.take(1):
        graphs = many.where("shard > 0").withColumn("share", F.explode(F.expr(f"sequence(0L, (shard - 1) div {FAN})"))).select("key", "shard", "share", "ids", "weights", "raw", "graph", "beam")
        blocks = many.where("shard < shards - 1").withColumn("to", F.explode(F.expr("sequence(shard + 1, shards - 1)")))
        blocks = blocks.select("key", F.col("to").alias("shard"), F.expr(f"shard div {FAN}").alias("share"), "ids", "weights", "raw")
        by = ["key", "shard", "share"]
        found = checkpoint(found.unionByName(graphs.groupBy(*by).cogroup(blocks.groupBy(*by)).applyInArrow(_across(least, kind), _RESULT)))
    pair = lambda a, b: found.select(F.explode(F.arrays_zip(a, b)).alias("x")).select(f"x.{a}", f"x.{b}")
    counts = pair("linked", "links").groupBy(F.col("linked").alias("id")).agg(F.sum("links").alias("links"))
    reach = components(pair("child", "parent").select(F.col("child").alias("a"), F.col("parent").alias("b")))
    members = narrow.where("fit").select("vec_id", "h0", "h1").join(classes.select("h0", "h1", "id", "weight"), ["h0", "h1"]).drop("h0", "h1")
    linked = members.join(counts, "id", "left").join(reach.withColumnRenamed("node", "id"), "id", "left")
    linked = linked.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    lone = narrow.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
