"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel distance.

An item of m characters (lower case, runs of white space as one blank) may differ by
``k = m * percent // 100`` edits from a passage of a document. Of its k + 1 pieces one is then
unharmed; rolling hashes of a text, one for each length of a piece, find every such place. Where
it stands, the window's 6-grams bound the distance from below, and what passes is decided
by the bit-parallel edit distance of the whole item against the window.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._blobs import trim
from tessera.llm._graph import unused
from tessera.llm._text import mix, powers

#: Characters of benchmark items that one pass looks for, a few bytes each in a task; more are looked for in several passes.
BLOCK_CHARS = 20_000_000
#: At a budget of a tenth each edit may destroy so many grams, and four tenths of them remain.
GRAM = 6
SCHEMA = "doc_id long, item_id long, start long, stop long, distance long"


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def place(text: str, at: int) -> int:
    """Where the character ``at`` of ``normalise(text)`` stands in the text."""
    for word in re.finditer(r"\S+", text):
        size = len(word[0].lower())
        if at < size:
            return word.start() + min(at, word.end() - word.start() - 1)
        if at == size:
            return word.end()
        at -= size + 1
    return len(text)


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal lengths, with their offsets."""
    edges = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def nearest(item: str, text: str, budget: int, anchored: bool = False) -> tuple[int, int] | None:
    """Least edit distance of the item to any substring of text, if within budget, and where that ends first.

    ``anchored``: to a prefix of text.
    """
    m, equal = len(item), {}
    for k, c in enumerate(item):
        equal[c] = equal.get(c, 0) | (1 << k)
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = equal.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ((ph << 1) | anchored) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score <= budget and (best is None or score < best[0]):
            best = score, j + 1
    return best


def _codes(text: str) -> np.ndarray:
    """16-bit codes of the ``GRAM`` characters from each place of a text."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(0, len(x) - GRAM + 1)
    out = np.zeros(n, np.uint32)
    for k in range(GRAM):
        out = (out ^ x[k : k + n]) * np.uint32(0x9E3779B1)
        out ^= out >> np.uint32(15)
    return out >> np.uint32(16)


def _hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over a text's characters, and the factors that make spans comparable, modulo 2**64."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    up, down = powers(len(x) + 1)
    prefix = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(mix(x.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return prefix, down


def _spans(prefix: np.ndarray, down: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all spans of ``size`` characters."""
    n = len(prefix) - size
    x = (prefix[size:] - prefix[:n]) * down[:n]
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


class _Pieces:
    """All pieces of one length: sorted hashes with item and offset, behind a bitmap that most places of a text fail."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray, offsets: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.items, self.offsets = hashes[order], items[order], offsets[order]
        bits = min(27, max(16, int(len(hashes)).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.some = np.zeros(1 << bits, dtype=bool)
        self.some[hashes >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, where it would start) of every hit."""
        at = np.flatnonzero(self.some[hashes >> self.shift])
        low, high = np.searchsorted(self.hashes, hashes[at], "left"), np.searchsorted(self.hashes, hashes[at], "right")
        count = high - low
        which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return self.items[which], np.repeat(at, count) - self.offsets[which]


class Finder:
    """Finds passages within the budget of any item of a block. A piece takes 16 bytes and some bits of a bitmap."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        self.items = [(i, t, len(t) * percent // 100) for i, t in items if t]
        found: dict[int, list[tuple]] = {}
        for k, (_, text, budget) in enumerate(self.items):
            prefix, down = _hashes(text)
            edges = np.array([a for a, _ in pieces(text, budget)] + [len(text)])
            sizes = np.diff(edges)
            for size in np.unique(sizes[sizes > 0]):
                some = edges[:-1][sizes == size]
                found.setdefault(int(size), []).append((_spans(prefix, down, size)[some], np.full(len(some), k, np.int32), some.astype(np.int32)))
        self.pieces = {size: _Pieces(*(np.concatenate(c) for c in zip(*x, strict=True))) for size, x in sorted(found.items())}
        #: Distinct grams of the items looked at, no more than they have characters, and one mask that all use in turn.
        self.grams: dict[int, tuple[np.ndarray, int]] = {}
        self.mask = np.zeros(1 << 16, dtype=bool)

    def _may(self, k: int, codes: np.ndarray, a: int, b: int) -> bool:
        """An edit destroys ``GRAM`` grams at most."""
        if k not in self.grams:
            _, text, budget = self.items[k]
            own = np.unique(_codes(text))
            self.grams[k] = own, len(own) - GRAM * budget
        own, least = self.grams[k]
        if least <= 0:
            return True
        self.mask[own] = True
        found = int(np.count_nonzero(self.mask[codes[a : max(a, b - GRAM + 1)]]))
        self.mask[own] = False
        return found >= least

    def holds(self, text: str) -> bool:
        return next(self.find(text), None) is not None

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, start, stop, distance) of the best passage for each item, in the text as it was."""
        plain = normalise(text)
        if not plain or not self.pieces:
            return
        prefix, down = _hashes(plain)
        hits = [p.find(_spans(prefix, down, size)) for size, p in self.pieces.items() if size < len(prefix)]
        item, start = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, int), np.zeros(0, int))
        if not len(item):
            return
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        budgets = np.array([x[2] for x in self.items])[item] if len(item) > 64 else np.array([self.items[k][2] for k in item])
        new = np.concatenate(([True], (item[1:] != item[:-1]) | (start[1:] > start[:-1] + 2 * budgets[1:] + 1)))
        first = np.flatnonzero(new)
        codes, best, last = _codes(plain), None, -1
        for a, b in zip(first, np.append(first[1:], len(item)) - 1, strict=True):
            k, low, high = int(item[a]), int(start[a]), int(start[b])
            if k != last:
                if best:
                    yield self._told(text, last, best)
                best, last = None, k
            _, wanted, budget = self.items[k]
            low, high = max(0, low - budget), min(len(plain), high + len(wanted) + budget)
            if self._may(k, codes, low, high) and (hit := nearest(wanted, plain[low:high], budget if best is None else best[0] - 1)):
                distance, stop = hit
                head = nearest(wanted[::-1], plain[low : low + stop][::-1], distance, anchored=True)
                best = distance, low + stop - head[1], low + stop
        if best:
            yield self._told(text, last, best)

    def _told(self, text: str, k: int, best: tuple[int, int, int]) -> tuple[int, int, int, int]:
        return self.items[k][0], place(text, best[1]), place(text, best[2] - 1) + 1, best[0]


def _scan(items: list[tuple[int, str]], percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items, percent)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                if text.is_valid:
                    rows += [(doc_id.as_py(), *hit) for hit in finder.find(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "stop", "distance"])
        trim()

    return run


def _without(items: list[tuple[int, str]], percent: int, column: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items, percent)
        for batch in batches:
            keep = [not (text.is_valid and finder.holds(text.as_py())) for text in batch.column(column)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        trim()

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Distinct items in blocks of ``BLOCK_CHARS`` or so, or one item if that is longer."""
    texts = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    volume = texts.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-volume // BLOCK_CHARS))
    for k in range(blocks):
        block = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else texts
        yield [(r.item_id, normalise(r.text)) for r in block.orderBy("item_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = 10) -> DataFrame:
    """Pairs of documents and benchmark items that they hold: doc_id, item_id, start, stop, distance.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text, either any further columns, which are not read. One row
    for each pair, its best passage (least distance, then first), as characters of the text. Null,
    empty or blank texts and items match nothing; repeated rows match each; a null id stays null. Texts of any
    length are searched whole. The documents are scanned once for each ``BLOCK_CHARS`` characters of the benchmark.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark):
        found = docs.mapInArrow(_scan(items, percent), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; each row is judged by its own text, in the scan of it.

    Rows of null doc_id are judged like the others, and rows that share an id with a dirty one stay if they are clean.
    """
    text = next(c for c in docs.columns if c.lower() == "text")
    out = docs
    if docs.schema[text].dataType.simpleString() != "string":
        out, text = docs.withColumn(unused(docs, "plain"), F.col(text).cast("string")), unused(docs, "plain")
    for items in _blocks(benchmark):
        out = out.mapInArrow(_without(items, percent, text), out.schema)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
