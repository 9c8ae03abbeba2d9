"""Exact Jaccard self-join on word shingles by universe partition and pigeonhole.

Tokens (shingle hashes) are dealt to segments of the hash universe, by band of set size. Two sets that link
differ in at most ``H`` tokens, so of segments whose budgets sum to more than ``H`` one lies within its budget:
a budget of one asks for equal segments, whose subset is indexed; a budget of two allows a segment to differ in a token, so its
one-deletion neighbourhood is indexed too. The allocation of segments and budgets minimises, band by band,
an estimate of index entries, chance collisions and sets that the allocation fails.

Segments that are empty say nothing and have no entry. A set whose other segments still have budgets of more
than ``H`` will meet any partner by them; the rest is its *spare*. An index entry that joins many groups of sets
(a common passage makes such) is left out by every set that can spare it. The few sets that can't,
and those of too many empty segments, are partitioned once more to the finest, a token a segment, and each gives its
budget to the ``H + 1`` tokens that the fewest of these sets have. So no set is dropped, and none is compared with all others.

Sets with one content are one class. The classes of an entry are first compared with one of them, that which
shares most entries with others; entries that then still span several components are joined across
components (all but the largest of an entry against all, salted), under a bound from parity sketches. An
exact lower bound of the difference, from bitmaps sized with the set, precedes verification of the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._blobs import SCHEMA, Packer, gather, spread, trim
from tessera.llm._graph import checkpoint, components, unused
from tessera.llm._text import distinct_sorted, mix, shingle_sets

#: An entry that spans more components than this is hot.
HOT = 16
#: Bytes of rows of three numbers (and a class's bands) up to which a list of texts to fetch is broadcast; a longer one is joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Share of a set's size that the allocation sets aside for hot entries.
SPARED = 0.02
#: Bits of the sketches that the join across components compares, at most.
SKETCH_BITS = 4096
#: Rows of an entry that one task of that join holds, about.
SALT_ROWS = 512


@dataclass(frozen=True)
class Band:
    """Sets whose larger partner has low..high-1 tokens: ``segments``, of which the first ``wide`` have budget two."""

    low: int
    high: int
    segments: int
    wide: int


def most_apart(n: int, band: Band, percent: int) -> int:
    """``H``: the most tokens in which a set of n tokens differs from a partner in the band."""
    return (n + min(band.high - 1, 100 * n // percent)) * (100 - percent) // (100 + percent)


def _fails(n: int, band: Band, percent: int) -> float:
    """About the share of sets of n tokens whose budgets, but for empty segments, don't exceed ``H`` by what hot entries need."""
    load = n / band.segments
    none, one = np.exp(-load), load * np.exp(-load)
    plain, plain_var = 1 - none, none * (1 - none)
    broad, broad_var = 2 * (1 - none) - one, 4 * (1 - none) - 3 * one - (2 * (1 - none) - one) ** 2
    m, w = band.segments - band.wide, band.wide
    # Segments share the tokens, so fewer are empty together than if they were filled apart.
    spread = max(1e-3, sqrt(max(0.0, (m * plain_var + w * broad_var) - n * (none * m + (none + one) * w) ** 2 / band.segments**2)))
    wanted = most_apart(n, band, percent) + 0.5 + SPARED * n
    return 0.5 * (1 + erf((wanted - m * plain - w * broad) / spread / sqrt(2)))


def allocate(low: int, high: int, percent: int) -> Band:
    """The cheapest allocation for pairs whose larger set has low..high-1 tokens."""
    need = most_apart(high - 1, Band(low, high, 1, 0), percent) + 1
    sizes = sorted({max(1, low * percent // 100), low, (low + high) // 2, high - 1})
    best = None
    for wide in range(0, need // 2 + 1 if need <= 16 else 1):
        for extra in sorted({need * k // 16 for k in range(17)} | {1, 2}):
            band = Band(low, high, need - wide + extra, wide)
            cost = 0.0
            for n in sizes:
                load = n / band.segments
                shared = (band.segments - wide) * 0.3**load + wide * load * 0.3 ** max(0.0, load - 1)
                cost += band.segments + wide * load + 64 * shared + 3 * n * _fails(n, band, percent)
            if best is None or cost < best[0]:
                best = cost, band
    return best[1]


@lru_cache(maxsize=8)
def bands(percent: int, largest: int = 1 << 31) -> tuple[Band, ...]:
    out, low = [], 1
    while low <= largest:
        high = max(low + 1, low * 5 // 4)
        out.append(allocate(low, high, percent))
        low = high
    return tuple(out)


def bands_of(size: int, percent: int) -> list[int]:
    """The bands in which a set of this size can have a partner, itself being the smaller or the larger."""
    table = bands(percent)
    lows = [b.low for b in table]
    own = int(np.searchsorted(lows, size, side="right")) - 1
    out = [own]
    while out[-1] + 1 < len(table) and 100 * size >= percent * table[out[-1] + 1].low:
        out.append(out[-1] + 1)
    return out


@lru_cache(maxsize=256)
def _layout(number: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Where segments 1, 2, ... begin in the hash universe, and a code for each segment of a band."""
    edges = np.array([(k << 64) // segments for k in range(1, segments)], dtype=np.uint64)
    return edges, mix(np.arange(segments, dtype=np.uint64) + np.uint64(number << 32))


def entries(tokens: np.ndarray, number: int, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A set's index entries in a band, the budget that goes with each, and what the set can spare (less than 0: it fails)."""
    band = bands(percent)[number]
    edges, place = _layout(number, band.segments)
    bounds = np.concatenate(([0], np.searchsorted(tokens, edges), [len(tokens)]))
    mixed = mix(tokens + np.uint64(0x632BE59BD9B4E019))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
    whole = sums[bounds[1:]] - sums[bounds[:-1]]
    sizes = np.diff(bounds)
    budget = np.minimum(sizes, 1)
    budget[: band.wide] = np.minimum(sizes[: band.wide], 2)
    filled = sizes > 0
    out, loss = mix(whole + place)[filled], budget[filled]
    if band.wide:
        at = np.arange(bounds[band.wide])
        within = np.searchsorted(bounds, at, side="right") - 1
        at, within = at[sizes[within] > 1], within[sizes[within] > 1]
        out = np.concatenate((out, mix(whole[within] - mixed[at] + place[within])))
        loss = np.concatenate((loss, budget[within]))
    out, first = np.unique(out, return_index=True)
    return out, loss[first], int(budget.sum()) - most_apart(len(tokens), band, percent) - 1


def class_of(tokens: np.ndarray) -> int:
    """A set's name, the same for equal sets only (64 bits): signed."""
    total = np.add.reduce(mix(tokens)) + np.uint64(len(tokens))
    return int(mix(np.array([total]))[0].astype(np.int64))


def parity(tokens: np.ndarray) -> bytes:
    """Four to eight bits a token, which each token toggles: two bitmaps differ in no more bits than the sets in tokens, and in few less."""
    bits = max(64, 4 << (len(tokens) - 1).bit_length())
    flags = (np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(flags, bitorder="little").tobytes()


def fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of so many words that the same set has."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, words), axis=0) if len(bitmap) > words else bitmap


def _features(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, bitmaps = [], [], []
            for tokens in shingle_sets(batch.column("text"), width):
                sizes.append(len(tokens))
                names.append(class_of(tokens) if len(tokens) else None)
                bitmaps.append(parity(tokens) if len(tokens) else None)
            yield pa.record_batch([batch.column("doc_id"), batch.column("id"), batch.column("same"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(bitmaps, pa.binary())], names=["doc_id", "id", "same", "n", "cls", "bitmap"])
        trim()

    return run


#: entry, class, band (and _FAILS), budget, spare.
_ENTRY = ("u8", "i8", "u1", "u1", "u2")
_FAILS = 128


def _part(entry: np.ndarray, parts: int) -> np.ndarray:
    return ((entry >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _index(width: int, percent: int, parts: int) -> Callable:
    """Entries by segments; a set that fails in a band is marked by a record of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(parts), set()
        for batch in batches:
            for tokens in shingle_sets(batch.column("text"), width):
                if not len(tokens) or (name := class_of(tokens)) in seen:
                    continue
                seen.add(name)
                for number in bands_of(len(tokens), percent):
                    found, loss, spare = entries(tokens, number, percent)
                    code = np.full(len(found), number, np.uint8)
                    if spare < 0:
                        found, loss, code = np.append(found, np.uint64(name & (1 << 64) - 1)), np.append(loss, 0), np.append(code, np.uint8(number | _FAILS))
                    n = len(found)
                    yield from packer.add(_part(found, parts), found, np.full(n, name, np.int64), code, loss.astype(np.uint8), np.full(n, min(max(spare, 0), 65535), np.uint16))
        yield from packer.flush()
        trim()

    return run


def _finest(width: int, percent: int, parts: int) -> Callable:
    """Entries of the finest partition: every token, in each band that ``bands`` of the row names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for batch in batches:
            for tokens, numbers in zip(shingle_sets(batch.column("text"), width), batch.column("bands").to_pylist(), strict=True):
                name, n = class_of(tokens), len(tokens)
                for number in numbers:
                    found = mix(tokens + mix(np.array([number + 1000], np.uint64)))
                    yield from packer.add(_part(found, parts), found, np.full(n, name, np.int64), np.full(n, number, np.uint8), np.zeros(n, np.uint8), np.zeros(n, np.uint16))
        yield from packer.flush()
        trim()

    return run


_SHARED = "entry long, cls long, band int, loss int, spare int, classes long"


def _shared(table: pa.Table) -> pa.Table:
    """Entries of a part that several classes have, with their number of classes; marks have none."""
    entry, name, number, loss, spare = gather(table, _ENTRY)
    order = np.lexsort((number, name, entry))
    entry, name, number = entry[order], name[order], number[order]
    if len(entry):
        new = np.concatenate(([True], (entry[1:] != entry[:-1]) | (name[1:] != name[:-1]) | (number[1:] != number[:-1])))
        entry, name, number, order = entry[new], name[new], number[new], order[new]
    mark = number >= _FAILS
    first = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1]))[: len(entry)])
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(entry))))
    count = np.bincount(group, ~mark)[group].astype(np.int64) if len(entry) else np.zeros(0, np.int64)
    count[mark] = 0
    pick = mark | (count > 1)
    order = order[pick]
    out = pa.table([pa.array(entry[pick].view(np.int64)), pa.array(name[pick]), pa.array((number[pick] & (_FAILS - 1)).astype(np.int32)), pa.array(loss[order].astype(np.int32)), pa.array(spare[order].astype(np.int32)), pa.array(count[pick])], names=["entry", "cls", "band", "loss", "spare", "classes"])
    trim()
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _verify(width: int, percent: int) -> Callable:
    """Rows come in runs of one ``a``, whose text is hashed once a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.asarray(batch.column("a"))
            new = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))[: len(a)])
            firsts = shingle_sets(batch.column("text_a").take(pa.array(new, pa.int64())), width)
            keep, starts = [], set(new.tolist())
            for k, tokens in enumerate(shingle_sets(batch.column("text_b"), width)):
                if k in starts:
                    first = next(firsts)
                if linked(first, tokens, percent):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        trim()

    return run


def _close(percent: int) -> Callable:
    """Pairs whose sizes and bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            n_a, n_b = batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()
            for k, (x, y) in enumerate(zip(batch.column("bitmap_a"), batch.column("bitmap_b"), strict=True)):
                if 100 * min(n_a[k], n_b[k]) < percent * max(n_a[k], n_b[k]):
                    continue
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                words = min(len(x), len(y))
                if int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum()) * (100 + percent) <= (n_a[k] + n_b[k]) * (100 - percent):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _sketch(percent: int) -> Callable:
    """Bitmaps folded to the length that sketches have in a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bands(percent)
        for batch in batches:
            out = []
            for number, raw in zip(batch.column("band").to_pylist(), batch.column("bitmap"), strict=True):
                smallest = max(1, table[number].low * percent // 100)
                bits = min(SKETCH_BITS, max(64, 4 << (smallest - 1).bit_length()))
                out.append(fold(np.frombuffer(raw.as_py(), np.uint64), bits // 64).view(np.int64))
            yield pa.record_batch([batch.column("cls"), batch.column("band"), batch.column("n"), pa.array(out, pa.list_(pa.int64()))], names=["cls", "band", "n", "sketch"])

    return run


def _may_link(percent: int) -> Column:
    """Whether the sizes and sketches of x and y allow a link, as a condition of a join."""
    apart = F.aggregate(F.zip_with("x.sketch", "y.sketch", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, p: total + p)
    sizes = F.lit(100) * F.least("x.n", "y.n") >= F.lit(percent) * F.greatest("x.n", "y.n")
    return sizes & (apart * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent))


class _Join:
    """The classes of a corpus, the links found so far, and the components they make."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int):
        self.docs, self.classes, self.width, self.percent = docs, classes, width, percent
        self.links, self.found = None, None

    def texts(self, names: DataFrame) -> DataFrame:
        """Texts of the classes named, one each; further columns of ``names`` stay."""
        more = [F.first(c).alias(c) for c in names.columns if c != "cls"]
        wanted = checkpoint(names.join(self.classes.select("cls", "at.id", "at.same"), "cls"))
        few = wanted.count() * (64 if more else 24) <= BROADCAST_BYTES  # three numbers a row, and a few bands
        return self.docs.select("id", "same", "text").join(F.broadcast(wanted) if few else wanted, ["id", "same"]).groupBy("cls").agg(F.min("text").alias("text"), *more)

    def close(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sizes and bitmaps allow a link."""
        side = {s: self.classes.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("bitmap").alias(f"bitmap_{s}")) for s in "ab"}
        return checkpoint(pairs.join(side["a"], "a").join(side["b"], "b").mapInArrow(_close(self.percent), "a long, b long"))

    def verify(self, close: DataFrame) -> None:
        """Adds those of the pairs that link, by their whole texts, and unites their components."""
        if not close.take(1):
            return
        texts = self.texts(close.select(F.col("a").alias("cls")).union(close.select("b")).distinct())
        pairs = close.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
        pairs = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
        links = checkpoint(pairs.mapInArrow(_verify(self.width, self.percent), "a long, b long"))
        if not links.take(1):
            return
        if self.found is not None:  # an edge from each class to its component says what the links so far say
            links = links.unionByName(self.found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.found = checkpoint(components(links))

    def place(self, rows: DataFrame, name: str = "cls") -> DataFrame:
        """``rows`` with the component of the class in column ``name``."""
        if self.found is None:
            return rows.withColumn("component", F.col(name))
        return rows.join(self.found.withColumnRenamed("node", name), name, "left").withColumn("component", F.coalesce("component", name))

    def open(self, kept: DataFrame) -> DataFrame:
        """The rows of entries that still span several components, with these."""
        placed = self.place(kept)
        placed = checkpoint(placed.select("entry", "cls", "band", "component"))
        split = placed.groupBy("entry").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("entry")
        return checkpoint(placed.join(split, "entry"))

    def settle(self, kept: DataFrame) -> None:
        """Compares classes with one of each entry that they share, that with most company: the middle of a group of near copies has most."""
        company = kept.groupBy("cls").agg(F.sum("classes").alias("company"))
        middle = kept.join(company, "cls").groupBy("entry").agg(F.max_by("cls", F.struct("company", "cls")).alias("a"))
        self.verify(self.close(kept.join(middle, "entry").where("cls <> a").select("a", F.col("cls").alias("b")).distinct()))

    def across(self, rows: DataFrame) -> None:
        """Compares the classes of each entry that are not of its largest component with all of it in other components.

        Of entries that the same classes have (those of one passage) one is enough; 128 bits of hash name a set of classes.
        """
        held = rows.groupBy("entry").agg(F.bit_xor(F.xxhash64("cls")).alias("s0"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("s1"), F.count("*").alias("c"))
        rows = checkpoint(rows.join(held.groupBy("s0", "s1", "c").agg(F.min("entry").alias("entry")).select("entry"), "entry"))
        size = rows.groupBy("entry", "component").agg(F.count("*").alias("c"))
        whole = size.groupBy("entry").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.ceil(F.sum("c") / SALT_ROWS).alias("salts"))
        sketches = checkpoint(rows.select("cls", "band").distinct().join(self.classes.select("cls", "n", "bitmap"), "cls").mapInArrow(_sketch(self.percent), "cls long, band int, n long, sketch array<long>"))
        full = rows.select("entry", "cls", "band", "component").join(whole, "entry").join(sketches, ["cls", "band"])
        x = full.where("component <> main").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")))
        y = full.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        apart = (F.col("x.entry") == F.col("y.entry")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.component") != F.col("y.component"))
        apart &= (F.col("y.component") == F.col("y.main")) | (F.col("x.cls") < F.col("y.cls"))
        pairs = x.alias("x").join(y.alias("y"), apart & _may_link(self.percent)).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
        self.verify(self.close(pairs))


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows of ``docs`` (doc_id, id, same, text): doc_id, id, same, n, cls and component, the latter null without words."""
    spark = docs.sparkSession
    features = checkpoint(docs.mapInArrow(_features(width), "doc_id long, id long, same long, n long, cls long, bitmap binary"))
    classes = checkpoint(features.where("cls is not null").groupBy("cls").agg(F.min(F.struct("id", "same")).alias("at"), F.min("n").alias("n"), F.min("bitmap").alias("bitmap")))
    join = _Join(docs, classes, width, percent)
    parts_of = lambda records: max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), int(records) // 1_500_000)
    parts = parts_of((features.agg(F.sum("n")).first()[0] or 0) * 5 * (100 - percent) / (100 + percent))
    index = docs.select("text").mapInArrow(_index(width, percent, parts), SCHEMA)
    shared = checkpoint(spread(index, parts, _ENTRY).groupBy("part").applyInArrow(_shared, _SHARED))
    kept = shared.where("classes > 1")
    join.settle(kept)
    placed = join.place(kept.select("entry", "cls", "band", "loss", "spare"))
    spans = placed.select("entry", "component").distinct().groupBy("entry").agg(F.count("*").alias("spans")).where("spans > 1")
    open_ = checkpoint(placed.join(spans, "entry"))
    fails = shared.where("classes = 0").select("cls", "band")
    poor = open_.where(F.col("spans") > HOT).groupBy("cls", "band").agg(F.sum("loss").alias("loss"), F.min("spare").alias("spare")).where("loss > spare").select("cls", "band")
    members = checkpoint(fails.unionByName(poor).distinct())
    rest = open_.where(F.col("spans") <= HOT).select("entry", "cls", "band", "component")
    if members.take(1):
        names = members.groupBy("cls").agg(F.collect_set("band").alias("bands"))
        parts = parts_of(members.join(classes, "cls").agg(F.sum("n")).first()[0] or 0)
        fine = join.texts(names).select("text", "bands").mapInArrow(_finest(width, percent, parts), SCHEMA)
        fine = checkpoint(spread(fine, parts, _ENTRY).groupBy("part").applyInArrow(_shared, _SHARED)).select("entry", "cls", "band", "classes")
        # A token that no other member has takes a place among the rarest, too.
        high = F.element_at(F.array(*[F.lit(b.high - 1).cast("long") for b in bands(percent)]), F.col("band") + 1)
        most = F.floor((F.col("n") + F.least(high, F.floor(100 * F.col("n") / percent))) * (100 - percent) / (100 + percent))
        by = W.partitionBy("cls", "band")
        ranked = fine.withColumns({"rank": F.row_number().over(by.orderBy("classes", "entry")), "all": F.count("*").over(by)})
        rare = ranked.join(classes.select("cls", "n"), "cls").where(F.col("rank") <= most + 1 - (F.col("n") - F.col("all"))).select("entry", "cls", "band")
        rest = rest.unionByName(join.open(rare))
    join.across(rest)
    return join.place(features.drop("bitmap"))


def _plain(docs: DataFrame) -> DataFrame:
    """A text is found again by its id and a hash, so ids that are null or stand for several texts do no harm."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("same"), "text")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Similarity classes of ``docs`` (doc_id, text, any further columns).

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct
    shingles of ``width`` words, lower-cased in A-Z; a text of fewer words has its whole sequence
    as its one shingle. Returns one row per input row: doc_id, n_shingles, component_id, the
    smallest doc_id reachable by links. A null, empty or blank text has no shingles and links
    with nothing, so its component is its own doc_id. Rows that repeat a doc_id are each
    returned; a null doc_id is kept, and its component is the smallest other one or null. An empty
    table gives an empty result. Texts may be of any length: memory goes with the longest alone.
    """
    rows = _grouped(_plain(docs), width, percent)
    smallest = rows.where("cls is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = rows.join(smallest, "component", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest doc_id, a null one counting as the largest.

    Of rows alike in doc_id and text one stays, of several texts of that doc_id the one of the smallest hash. Texts
    without words, null ones too, all stay: they are in no group.
    """
    rows = checkpoint(_grouped(_plain(docs), width, percent).where("cls is not null"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "same")
    first = rows.groupBy("component").agg(F.min(order).alias("f"))
    judged = rows.join(first, "component").select("id", "same", (F.col("same").eqNullSafe(F.col("f.same")) & F.col("doc_id").eqNullSafe(F.col("f.doc_id"))).alias("stays"))
    judged = checkpoint(judged.groupBy("id", "same").agg(F.first("stays").alias("stays"), F.count("*").alias("rows")))
    id_, same = unused(docs, "id"), unused(docs, "same")
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), same: F.xxhash64(F.col("text").cast("string"))})
    on = lambda frame: frame.select(F.col("id").alias(id_), F.col("same").alias(same))
    repeated = on(judged.where("stays and rows > 1"))
    out = keyed.join(on(judged.where("not stays or rows > 1")), [id_, same], "left_anti")
    if repeated.take(1):
        rank = unused(docs, "rank")
        again = keyed.join(repeated, [id_, same]).withColumn(rank, F.row_number().over(W.partitionBy(id_, same).orderBy(F.lit(0))))
        out = out.unionByName(again.where(F.col(rank) == 1).drop(rank))
    return out.select(docs.columns)
