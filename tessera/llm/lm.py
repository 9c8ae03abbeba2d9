"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation.

Counts of all training words come first, exact and distributed. Words seen ``LEAST`` times or more, among the
``head`` most frequent ones (which grows with the square root of the training bytes), are outputs and contexts of
their own; one class of all other words and the end are outputs too, and other words share hashed context symbols,
a quarter as many. A context of two words predicts a vector, the sum of a matrix times the vector of each word. Outputs
are dealt to classes by rank, small ones of frequent words and large ones of rare words: an output's probability is that of its class times that within the class, and
either comes from scores that are the vector's products with vectors of classes or outputs, plus a bias. Texts are dealt
by hash to shards of bounded size, and a replica is trained on all tokens of each, contrasting them with noise samples of classes and of the
members of their class; the rows a replica has touched are averaged by the tokens that touched them, so the model doesn't depend on the table's partitions.
A task trains the replicas of a group of shards in turn and averages them before it sends their rows, so all groups' rows are about as many bytes as the training text at most. Scores are normalised for each batch of contexts
that occur, over the classes and over the members of the target's class. A word of the class
of others has the class's probability times its share by smoothed counts.

Counts of words beyond the head are looked up by shuffling compressed blocks of those words alone.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._blobs import ARROW, SCHEMA, Packer, decode, encode, gather, spread, trim
from tessera.llm._graph import checkpoint
from tessera.llm._text import CHUNK_BYTES, chunks, mix, utf8, word_hashes

#: Least number of words whose counts are shipped, and of outputs; symbols before the hashed ones at least; vector length.
HEAD = 1 << 16
TARGETS = 4096
CONTEXTS = 256
LEAST = 3
DIM = 24
NOISE = 64
#: Members of a class drawn as noise for so many tokens of it, which share them.
NEAR = 8
GROUP = 32
BATCH = 8192
#: Tokens whose probabilities are normalised at once.
BLOCK = 512
RATE = 0.1
RARE = 0.05
_OTHER, _END = TARGETS, TARGETS + 1
_NONE, _START = CONTEXTS - 2, CONTEXTS - 1
_BEYOND = 1 << 40


def head(volume: int) -> int:
    """How many words' counts are shipped, for so many training bytes."""
    return max(HEAD, 4 * math.isqrt(volume))


def is_held_out() -> F.Column:
    """Rows that nothing is learnt from: crc32(doc_id as text) mod 5 is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
    return keys[first], np.add.reduceat(values, first) if len(keys) else values


def _count(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for batch in batches:
            held: list[np.ndarray] = [word_hashes(data, offsets)[0] for _, data, offsets in chunks(batch.column("text"))]
            words, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield from packer.add(_part(words, parts), words, n.astype(np.int64))
        yield from packer.flush()

    return run


def _merge_counts(shown: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        words, n = _sum_by(*gather(table, ("u8", "i8")))
        top = np.argsort(-n, kind="stable")[:shown]
        return pa.table({"part": table.column("part")[:1], "block": pa.array([encode([words, n])], pa.binary()), "tokens": [int(n.sum())], "words": [len(words)], "top": pa.array([[{"word": int(w), "n": int(c)} for w, c in zip(words[top].astype(np.int64), n[top], strict=True)]], pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())])))})

    return run



class Vocabulary:
    """The most frequent words by falling count, and the counts that smoothing needs."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, ends: int):
        self.words, self.counts, self.slots = words, counts, _slots(words)
        self.tokens, self.distinct, self.ends = tokens + ends, distinct + (ends > 0), ends
        likely = int(np.count_nonzero(counts >= LEAST))
        self.outputs, self.contexts = max(TARGETS, likely), max(_NONE, likely)
        self.hashed = max(CONTEXTS, self.contexts // 4)
        shown = np.zeros(self.outputs, np.int64)
        shown[: len(counts)] = counts[: self.outputs]
        self.other_tokens, self.other_words = tokens - int(shown.sum()), distinct - min(self.outputs, len(counts))
        mass = np.concatenate((shown[:TARGETS], [self.other_tokens, ends], shown[TARGETS:])).astype(float) + 0.5
        self.unigram = mass / mass.sum()

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_BEYOND if beyond) and count (-1 if beyond) of each word."""
        rank, count = np.full(len(hashes), _BEYOND), np.full(len(hashes), -1)
        if not len(self.words):
            return rank, count
        mask = np.uint64(len(self.slots) - 1)
        left, asked = np.arange(len(hashes)), hashes
        place = asked & mask
        while len(left):
            found = self.slots[place]
            same = (found >= 0) & (self.words[found] == asked)
            rank[left[same]] = found[same]
            count[left[same]] = self.counts[found[same]]
            on = (found >= 0) & ~same
            left, asked, place = left[on], asked[on], (place[on] + np.uint64(1)) & mask
        return rank, count


def _slots(words: np.ndarray) -> np.ndarray:
    """A table, at most half full, of the places of different hashes: each in the first free slot from that of its low bits on."""
    out = np.full(1 << (2 * len(words)).bit_length(), -1, np.int32)
    mask = np.uint64(len(out) - 1)
    left, place = np.arange(len(words)), words & mask
    while len(left):
        free = np.flatnonzero(out[place] < 0)
        taken, first = np.unique(place[free], return_index=True)
        out[taken] = left[free[first]]
        on = np.ones(len(left), bool)
        on[free[first]] = False
        left, place = left[on], (place[on] + np.uint64(1)) & mask
    return out


def class_starts(unigram: np.ndarray) -> np.ndarray:
    """Where classes of outputs begin, and the end. A class about the output r has 1 / sqrt(p(r)) members or so.

    That makes the classes and the members of a target's class, which a probability is normalised over, fewest on
    average; as many of either, and in all two thirds of what classes of one size take where words follow Zipf's law.
    """
    number = np.floor(np.cumsum(np.sqrt(unigram)) - 1e-9).astype(np.int64)
    return np.append(_runs(number), len(unigram))


def _classes(unigram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of the classes, the class of each output, and the probability of each class."""
    starts = class_starts(unigram)
    return starts, np.repeat(np.arange(len(starts) - 1), np.diff(starts)), np.add.reduceat(unigram, starts[:-1])


def initial(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Vectors of contexts, classes and outputs (the last of the latter two is the bias)."""
    rng = np.random.default_rng(7)
    _, kind, mass = _classes(vocabulary.unigram)
    within = vocabulary.unigram / mass[kind]
    first, rest = rng.normal(0, 0.3, (CONTEXTS, DIM)), rng.normal(0, RARE, (vocabulary.contexts + 2 + vocabulary.hashed - CONTEXTS, DIM))
    out = {
        "E": np.concatenate((first, rest)),
        "C1": np.eye(DIM) * 0.5,
        "C2": np.eye(DIM) * 0.5,
        "S": np.column_stack((rng.normal(0, 0.05, (len(mass), DIM)), np.log(mass))),
        "R": np.column_stack((rng.normal(0, 0.05, (len(within), DIM)), np.log(within))),
    }
    return {k: v.astype(np.float32) for k, v in out.items()}


def sequences(hashes: np.ndarray, first: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a chunk, an end after each text: targets, both context symbols, hashes, counts, text of each."""
    texts = len(first) - 1
    at = np.arange(len(hashes)) + np.repeat(np.arange(texts), np.diff(first))
    n = len(hashes) + texts
    text = np.repeat(np.arange(texts), np.diff(first) + 1)
    rank, count = vocabulary.find(hashes)
    target, shown, counts, words = np.full(n, _END), np.full(n, _START), np.full(n, vocabulary.ends), np.zeros(n, np.uint64)
    target[at], counts[at], words[at] = np.where(rank < vocabulary.outputs, rank + 2 * (rank >= TARGETS), _OTHER), count, hashes
    shown[at] = np.where(rank < vocabulary.contexts, rank + 2 * (rank >= _NONE), vocabulary.contexts + 2 + (hashes % np.uint64(vocabulary.hashed)).astype(np.int64))
    before = np.full((2, n), _START)
    before[0, 1:], before[1, 2:] = shown[:-1], shown[:-2]
    before[1, 1:][before[0, 1:] == _START] = _START
    return target, before[0], before[1], words, counts, text


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]


class Trainer:
    """Adagrad on the noise-contrastive losses of classes and of the members of a class; vectors have one rate each."""

    def __init__(self, parameters: dict[str, np.ndarray], unigram: np.ndarray, seed: int):
        self.p = {k: v.copy() for k, v in parameters.items()}
        self.squares = {k: np.full(len(v) if k in ("E", "R") else v.shape, 1.0, np.float32) for k, v in parameters.items()}
        self.times = {k: np.zeros(len(parameters[k]), np.int64) for k in ("E", "R")}
        self.starts, self.kind, mass = _classes(unigram)
        self.cumulative, self.bounds = np.cumsum(mass), np.concatenate(([0.0], np.cumsum(unigram)))
        self.log_noise = np.log(NOISE * mass).astype(np.float32)
        self.log_near = np.log(NEAR * unigram / mass[self.kind]).astype(np.float32)
        self.rng, self.seen = np.random.default_rng(seed), 0

    def _move(self, k: str, g: np.ndarray) -> None:
        self.squares[k] += g * g
        self.p[k] += RATE * g / np.sqrt(self.squares[k])

    def _move_rows(self, k: str, index: np.ndarray, values: np.ndarray) -> None:
        """``values`` has a column for each place; sums run along columns."""
        order = np.argsort(index)
        index = index[order]
        first = _runs(index)
        rows = index[first]
        self.times[k][rows] += np.diff(np.append(first, len(index)))
        g = np.ascontiguousarray(np.add.reduceat(np.take(values, order, axis=1), first, axis=1).T)
        squares = self.squares[k][rows] + np.einsum("ij,ij->i", g, g) / g.shape[1]
        self.squares[k][rows] = squares
        self.p[k][rows] += (RATE / np.sqrt(squares))[:, None] * g

    def _groups(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens by groups of one class, the number of tokens where a group has no more, and the classes."""
        n, first = len(kind), _runs(kind)
        sizes = np.diff(np.append(first, n))
        groups = -(-sizes // GROUP)
        run = np.repeat(np.arange(len(first)), groups)
        start = first[run] + (np.arange(len(run)) - np.repeat(np.cumsum(groups) - groups, groups)) * GROUP
        at = start[:, None] + np.arange(GROUP)
        return np.where(at < (first + sizes)[run][:, None], at, n), kind[first][run]

    def learn(self, target: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
        p, n = self.p, len(target)
        order = np.argsort(target)
        target, h1, h2 = target[order], h1[order], h2[order]
        e1, e2 = p["E"][h1], p["E"][h2]
        q = np.zeros((n + 1, DIM + 1), np.float32)  # the last row stands for no token
        q[:n, :DIM] = e1 @ p["C1"] + e2 @ p["C2"]
        q[:n, DIM] = 1
        kind = self.kind[target]
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), len(self.cumulative) - 1)
        at, kinds = self._groups(kind)
        low, high = self.starts[kinds], self.starts[kinds + 1]
        mass = self.bounds[low][:, None] + self.rng.random((len(kinds), NEAR)) * (self.bounds[high] - self.bounds[low])[:, None]
        near = np.clip(np.searchsorted(self.bounds, mass.ravel(), side="right").reshape(mass.shape) - 1, low[:, None], high[:, None] - 1)
        c, cn, r, rn = p["S"][kind], p["S"][noise], p["R"][target], p["R"][near]
        own, several = q[:n], q[at]
        up = _chance(np.einsum("ij,ij->i", own, c) - self.log_noise[kind])
        down = _chance(self.log_noise[noise] - own @ cn.T)
        up_near = _chance(np.einsum("ij,ij->i", own, r) - self.log_near[target])
        down_near = _chance(self.log_near[near][:, None, :] - several @ rn.transpose(0, 2, 1))
        dq = up[:, None] * c - down @ cn + up_near[:, None] * r
        pulled = np.empty((n + 1, DIM + 1), np.float32)
        pulled[at] = down_near @ rn
        dq = (dq - pulled[:n])[:, :DIM]
        columns = np.ascontiguousarray(own.T)
        g = np.zeros_like(p["S"])
        first = _runs(kind)
        g[kind[first]] = np.add.reduceat(up * columns, first, axis=1).T
        np.subtract.at(g, noise, down.T @ own)
        pushed = (down_near.transpose(0, 2, 1) @ several).reshape(-1, DIM + 1)
        back = np.concatenate((p["C1"] @ dq.T, p["C2"] @ dq.T), axis=1)
        self._move("S", g)
        self._move_rows("R", np.concatenate((target, near.ravel())), np.concatenate((up_near * columns, -pushed.T), axis=1))
        self._move("C1", e1.T @ dq)
        self._move("C2", e2.T @ dq)
        self._move_rows("E", np.concatenate((h1, h2)), back)
        self.seen += n


def _chance(x: np.ndarray) -> np.ndarray:
    """The logistic function of ``-x``, in place."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


_ORDER = ("E", "C1", "C2", "S", "R")
#: row, group of shards, tokens that touched it, values
_ROW = ("i8", "i4", "f8", *["f4"] * (DIM + 1))
_ROW_BYTES = sum(np.dtype(x).itemsize for x in _ROW)
#: Bytes of rows that one task averages, about.
PART_BYTES = 32 << 20
#: Bytes of training text that one replica learns from, about.
SHARD_BYTES = 16 << 20


def _deal_texts(shards: int) -> Callable:
    """Texts by shards of their key, in compressed blocks; a row that comes very often in a batch goes to several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("key")).view(np.uint64)
            order = np.argsort(keys, kind="stable")
            first = _runs(keys[order])
            again = np.empty(len(keys), np.uint64)
            again[order] = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
            part = _part(mix(keys + mix(again >> np.uint64(6))), shards)
            data, offsets = utf8(batch.column("text"))
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                head = encode([keys[rows], np.diff(offsets)[rows]])
                body = zstandard.compress(b"".join(data[offsets[r] : offsets[r + 1]].tobytes() for r in rows), 1)
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([len(head).to_bytes(8, "little") + head + body], pa.binary())], schema=ARROW)
        trim()

    return run


def _shard_texts(blocks: Iterable[pa.BinaryScalar]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of a shard's texts in the order of their keys: bytes and offsets."""
    keys, sizes, bodies = [], [], []
    for block in blocks:
        raw = block.as_py()
        n = int.from_bytes(raw[:8], "little")
        k, z = decode(raw[8 : 8 + n], ("u8", "i8"))
        keys.append(k)
        sizes.append(z)
        bodies.append(np.frombuffer(zstandard.decompress(raw[8 + n :]), np.uint8))
    keys, sizes, data = np.concatenate(keys), np.concatenate(sizes), np.concatenate(bodies)
    stops = np.cumsum(sizes)
    order = np.lexsort((sizes, keys))
    bounds = np.concatenate(([0], np.cumsum(sizes[order])))
    a = 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + CHUNK_BYTES, side="right")) - 1)
        some = order[a:b]
        yield np.concatenate([data[stops[r] - sizes[r] : stops[r]] for r in some]), bounds[a : b + 1] - bounds[a]
        a = b


class Mean:
    """Rows of several replicas averaged by the tokens that touched them, and those tokens."""

    def __init__(self, first: Trainer):
        self.p, self.times = first.p, self._times(first)

    @staticmethod
    def _times(trainer: Trainer) -> dict[str, np.ndarray]:
        return {k: trainer.times.get(k, np.full(len(v), trainer.seen)) for k, v in trainer.p.items()}

    def add(self, trainer: Trainer) -> None:
        for k, times in self._times(trainer).items():
            self.times[k] += times
            for some in _lots(np.flatnonzero(times)):
                share = (times[some] / self.times[k][some]).astype(np.float32)
                self.p[k][some] += (trainer.p[k][some] - self.p[k][some]) * share[:, None]


def _lots(rows: np.ndarray) -> list[np.ndarray]:
    return np.array_split(rows, len(rows) // (1 << 16) + 1)


def groups_of(shards: int, rows: int, volume: int) -> int:
    """In how many groups shards are trained: as many as send no more bytes than ``volume``, if each sends all ``rows``."""
    return max(1, min(shards, volume // (rows * _ROW_BYTES)))


def _train(shipped, shards: int, groups: int, step: int) -> Callable:
    """The rows that the replicas of a group have touched, averaged. They depend on the texts of its shards alone, not on files or tasks.

    Blocks come in the order of their shards; ``step`` rows make a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shipped.value
        blocks = ((part.as_py(), block) for batch in batches for part, block in zip(batch.column("part"), batch.column("block"), strict=True))
        for group, several in itertools.groupby(blocks, lambda x: x[0] * groups // shards):
            mean = None
            for shard, own in itertools.groupby(several, lambda x: x[0]):
                trainer = Trainer(initial(vocabulary), vocabulary.unigram, shard)
                for data, offsets in _shard_texts(block for _, block in own):
                    target, h1, h2, *_ = sequences(*word_hashes(data, offsets), vocabulary)
                    for a in range(0, len(target), BATCH):
                        trainer.learn(target[a : a + BATCH], h1[a : a + BATCH], h2[a : a + BATCH])
                if mean is None:
                    mean = Mean(trainer)
                else:
                    mean.add(trainer)
                del trainer
                trim()
            packer, at = Packer(-(-sum(map(len, mean.p.values())) // step), 1 << 16, last=True), 0
            for k in _ORDER:
                values, times = mean.p[k], mean.times[k]
                for some in _lots(np.flatnonzero(times)):
                    padded = np.pad(values[some], ((0, 0), (0, DIM + 1 - values.shape[1])))
                    yield from packer.add(((some + at) // step).astype(np.int32), some + at, np.full(len(some), group, np.int32), times[some].astype(float), *padded.T)
                at += len(values)
            yield from packer.flush()
        trim()

    return run


def _average(table: pa.Table) -> pa.Table:
    row, group, times, *columns = gather(table, _ROW)
    order = np.lexsort((group, row))
    row, times = row[order], times[order]
    first = _runs(row)
    total = np.add.reduceat(times, first) if len(row) else times
    mean = [(np.add.reduceat(times * x[order], first) / total).astype(np.float32) if len(row) else x for x in columns]
    return pa.Table.from_batches([pa.record_batch([table.column("part")[:1].combine_chunks(), pa.array([encode([row[first], total, *mean])], pa.binary())], schema=ARROW)])


def train(docs: DataFrame, vocabulary: Vocabulary, volume: int) -> dict[str, np.ndarray]:
    """Parameters averaged over the replicas of all shards, each row by the tokens that touched it; a row that none touched is as at first.

    ``docs`` has key and text. Shards and their groups follow from the keys and the ``volume`` of text, so the model doesn't depend on how the
    table is partitioned (but where a row comes more than 64 times).
    """
    out = initial(vocabulary)
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    shards, rows = volume // SHARD_BYTES + 1, sum(map(len, out.values()))
    groups = groups_of(shards, rows, volume)
    step = max(1, min(-(-rows // 8), PART_BYTES // (_ROW_BYTES * groups)))
    dealt = docs.mapInArrow(_deal_texts(shards), SCHEMA).repartitionById(groups, F.expr(f"int(part * {groups}L div {shards}L)"))
    found = dealt.sortWithinPartitions("part").mapInArrow(_train(shipped, shards, groups, step), SCHEMA)
    mean = found.groupBy("part").applyInArrow(_average, SCHEMA).toArrow()  # the rows of one model
    row, _, *columns = gather(mean, ("i8", "f8", *["f4"] * (DIM + 1)))
    table, at = np.column_stack(columns), 0
    for k in _ORDER:
        some = (row >= at) & (row < at + len(out[k]))
        out[k][row[some] - at] = table[some][:, : out[k].shape[1]]
        at += len(out[k])
    return out


def _log_sum(q: np.ndarray, table: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Log of the sums of the exponentials of products of each row of ``q`` with those of ``table``, worked out in ``room``."""
    s = room[: len(q) * len(table)].reshape(len(q), len(table))
    np.matmul(q, table.T, out=s)
    with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
        np.exp(s, out=s)
        out = np.log(s @ np.ones(len(table), s.dtype))
    far = ~np.isfinite(out)
    if far.any():
        s = q[far] @ table.T
        top = s.max(axis=1)
        out[far] = np.log(np.exp(s - top[:, None]).sum(axis=1)) + top
    return out


class Model:
    """A trained model made ready for scoring."""

    def __init__(self, vocabulary: Vocabulary, p: dict[str, np.ndarray]):
        self.vocabulary, self.p = vocabulary, p
        self.starts, self.kind, _ = _classes(vocabulary.unigram)

    def log10(self, target: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of outputs after their contexts."""
        p, starts, out = self.p, self.starts, np.zeros(len(target))
        order = np.argsort(target)
        room = np.empty(BLOCK * max(len(p["S"]), int(np.diff(starts).max())), np.float32)
        for a in range(0, len(target), BLOCK):
            at = order[a : a + BLOCK]
            q = np.ones((len(at), DIM + 1), np.float32)
            q[:, :DIM] = p["E"][h1[at]] @ p["C1"] + p["E"][h2[at]] @ p["C2"]
            t = target[at]
            kind = self.kind[t]
            found = np.einsum("ij,ij->i", q, p["S"][kind] + p["R"][t]) - _log_sum(q, p["S"], room)
            first = _runs(kind)
            for b, e in zip(first, np.append(first[1:], len(kind)), strict=True):
                found[b:e] -= _log_sum(q[b:e], p["R"][starts[kind[b]] : starts[kind[b] + 1]], room)
            out[at] = found
        return out / np.log(10)


def smoothed(count: np.ndarray, tokens: int, words: int) -> np.ndarray:
    return np.log10((count + 0.5) / (tokens + 0.5 * (words + 1)))


#: key, doc_id, whether it is null, held out, tokens, known tokens, base score, model score.
_DOC = ("u8", "i8", "u1", "u1", "i8", "i8", "f8", "f8")
#: word, key, times.
_WORD = ("u8", "u8", "i4")
_SUM = ("u8", "i8", "f8", "f8")


def _score(shipped, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        v = model.vocabulary
        docs, words, number = Packer(parts, 1 << 17), Packer(parts), TaskContext.get().partitionId() << 40

        def kind(found: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
            for x in found:
                yield x.append_column("kind", pa.array(np.full(len(x), k, np.int32)))

        for batch in batches:
            ids = batch.column("doc_id")
            for row, data, offsets in chunks(batch.column("text")):
                hashes, first = word_hashes(data, offsets)
                target, h1, h2, seen, count, text = sequences(hashes, first, v)
                n = len(first) - 1
                keys = mix(np.arange(number, number + n, dtype=np.uint64))
                number += n
                score = model.log10(target, h1, h2)
                base = np.zeros(len(target))
                near = count >= 0
                base[near] = smoothed(count[near], v.tokens, v.distinct)
                rare = near & (target == _OTHER)
                score[rare] += smoothed(count[rare], v.other_tokens, v.other_words)
                some = ids.slice(row, n)
                total = lambda x: np.bincount(text, x, n)  # noqa: E731, B023
                yield from kind(docs.add(_part(keys, parts), keys, np.asarray(some.fill_null(0)), np.asarray(some.is_null()).astype(np.uint8), np.asarray(batch.column("held_out").slice(row, n)).astype(np.uint8), np.bincount(text, minlength=n), total((count > 0).astype(float)).astype(np.int64), total(base), total(score)), 0)
                far = ~near
                if far.any():
                    pairs = np.lexsort((seen[far], text[far]))
                    w, t = seen[far][pairs], text[far][pairs]
                    new = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (t[1:] != t[:-1]))))
                    yield from kind(words.add(_part(w[new], parts), w[new], keys[t[new]], np.diff(np.append(new, len(w))).astype(np.int32)), 1)
        yield from kind(docs.flush(), 0)
        yield from kind(words.flush(), 1)
        trim()

    return run


def _look_up(tokens: int, words: int, other_tokens: int, other_words: int, parts: int) -> Callable:
    """Counts of the words beyond the head, summed by text."""

    def run(key: tuple, asked: pa.Table, counts: pa.Table) -> pa.Table:
        word, owner, times = gather(asked, _WORD)
        have, n = gather(counts, ("u8", "i8"))
        at = np.minimum(np.searchsorted(have, word), max(0, len(have) - 1))
        count = np.where(have[at] == word, n[at], 0) if len(have) else np.zeros(len(word), np.int64)
        sums = [(count > 0) * times, times * smoothed(count, tokens, words), times * smoothed(count, other_tokens, other_words)]
        owners, inverse = np.unique(owner, return_inverse=True)
        known, base, score = (np.bincount(inverse, x, len(owners)) for x in sums)
        packer = Packer(parts, 1 << 62)
        list(packer.add(_part(owners, parts), owners, known.astype(np.int64), base, score))
        return pa.Table.from_batches(list(packer.flush()), ARROW)

    return run


def _finish(tokens: int) -> Callable:
    def run(key: tuple, docs: pa.Table, sums: pa.Table) -> pa.Table:
        owner, doc_id, null, held, n, known, base, score = gather(docs, _DOC)
        order = np.argsort(owner)
        more, more_known, more_base, more_score = gather(sums, _SUM)
        at = order[np.searchsorted(owner, more, sorter=order)] if len(more) else np.zeros(0, int)
        known, base, score = known.copy(), base.copy(), score.copy()
        np.add.at(known, at, more_known)
        np.add.at(base, at, more_base)
        np.add.at(score, at, more_score)
        return pa.table({"doc_id": pa.array(doc_id, pa.int64(), mask=null.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), tokens), "base_score": base, "score": score})

    return run


def score(docs: DataFrame) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text, any others) by a model of those not held out.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens that occur in training), train_tokens,
    base_score (smoothed unigrams, log10) and score (the model's log10 probability of the text). A
    null text is empty and has the end alone; rows that repeat are scored, and learnt from, each. An
    empty table gives an empty result; without training texts all words are unknown. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), is_held_out().alias("held_out"))
    training = docs.where("not held_out").select("text", F.xxhash64("doc_id", "text").alias("key"))
    texts, volume = training.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), (volume or 0) // (24 << 20))
    shown = head(volume or 0)
    counts = checkpoint(spread(training.select("text").mapInArrow(_count(parts), SCHEMA), parts, ("u8", "i8")).groupBy("part").applyInArrow(_merge_counts(shown), f"{SCHEMA}, tokens long, words long, top array<struct<word: long, n: long>>"))
    tokens, distinct = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    top = counts.select(F.explode("top").alias("x")).select("x.*").orderBy(F.desc("n"), "word").limit(shown).toArrow()
    vocabulary = Vocabulary(np.asarray(top.column("word")).astype(np.int64).view(np.uint64), np.asarray(top.column("n")).astype(np.int64), tokens, distinct, texts)
    model = Model(vocabulary, train(training, vocabulary, volume or 0))
    shipped = spark.sparkContext.broadcast(model)
    found = docs.mapInArrow(_score(shipped, parts), f"{SCHEMA}, kind int").select("part", "kind", "block")
    found = checkpoint(spread(found, parts, {0: _DOC, 1: _WORD}))
    asked = found.where("kind = 1").select("part", "block")
    v = vocabulary
    sums = asked.groupBy("part").cogroup(counts.select("part", "block").groupBy("part")).applyInArrow(_look_up(v.tokens, v.distinct, v.other_tokens, v.other_words, parts), SCHEMA)
    sums = spread(sums, parts, _SUM)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return found.where("kind = 0").select("part", "block").groupBy("part").cogroup(sums.groupBy("part")).applyInArrow(_finish(v.tokens), schema)
