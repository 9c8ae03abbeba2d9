"""Repeated substrings by suffix arrays: two-stage sorting, bucket induction, common prefixes.

A byte is removed when it lies in a ``length``-byte string that also starts earlier. To find
these strings without sorting all suffixes of the corpus in one place, each window of ``length``
bytes is filed under its least k-gram hash, a function of the window alone, so equal windows
always meet. Runs of windows with one least hash are one context. Contexts that are equal
throughout, by fingerprints modulo two primes, hash and length, need no sorting: only the first stays, picked in the task that
reads them and then by content, so no content is hot. The different contexts of a hash, and contexts that may repeat
within themselves, are concatenated and their suffix
array is built: only suffixes smaller than their successors are sorted directly, the rest
are induced from them by one scan of the buckets, and adjacent common prefixes of ``length`` bytes
or more mark the windows that start earlier elsewhere. A hash of very many different contexts (the rims of
a passage that many texts have) is split: each of its windows goes where its own fingerprint says, to a suffix array there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._blobs import SCHEMA, Packer, decode, encode, gather, spread, trim
from tessera.llm._graph import checkpoint
from tessera.llm._text import chunks, mix, prefix_hash, prefix_marks, span_hash, span_marks, utf8

GRAM = 20
#: Bytes of contexts that one suffix array holds; a hash with more is split by its windows.
SORT_BYTES = 1 << 20
#: Bytes of several hashes' contexts that are sorted together; larger pieces take more memory and, beyond the caches, more time a byte.
_PIECE = 1 << 18
_DEPTH = 8


def _eights(text: np.ndarray, beyond: int) -> np.ndarray:
    """At each place the eight bytes from there as a big-endian number; beyond the end zeros."""
    padded = np.concatenate((text, np.zeros(beyond + 2 * _DEPTH, np.uint8)))
    return np.ndarray(len(padded) - _DEPTH + 1, ">u8", padded, strides=(1,))


def _sort_direct(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first ``length`` bytes or more; only ties are looked at again."""
    if not len(at):
        return at
    eights = _eights(text, length)
    key = eights[at].astype(np.uint64)
    order = np.argsort(key)
    at, key = at[order], key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    tied = np.arange(len(at))
    for depth in range(_DEPTH, length, _DEPTH):
        single = new & np.append(new[1:], True)
        tied = tied[~single]
        new = new[~single]
        if not len(tied):
            break
        group = np.cumsum(new) - 1
        key = eights[at[tied] + depth].astype(np.uint64)
        apart = np.zeros(group[-1] + 1, dtype=bool)
        apart[group[1:][(key[1:] != key[:-1]) & ~new[1:]]] = True
        look = np.flatnonzero(apart[group])  # in the other groups all are still equal
        if len(look):
            order = look[np.lexsort((key[look], group[look]))]
            at[tied[look]], key[look] = at[tied[order]], key[order]
            new[1:] |= key[1:] != key[:-1]
    return at


def suffix_array(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``length`` bytes at least, the end like a NUL.

    Two stages: a suffix is small if it is less than its successor. The small ones are sorted
    directly. Those not small that begin with c follow, in the order of their successors, which
    stand in buckets below c or earlier in that of c; so one scan over the buckets places them.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # Of a run of equal bytes all are of the type of its last; the last suffix is not small.
    change = np.flatnonzero(np.concatenate((text[1:] != text[:-1], [True])))
    rises = np.concatenate((text[change[:-1] + 1] > text[change[:-1]], [False]))
    small = np.repeat(rises, np.diff(np.concatenate(([-1], change))))
    direct = _sort_direct(text, np.flatnonzero(small), length)
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not small[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    done = []
    for c in range(256):
        placed = waiting[c]
        front = np.concatenate(placed) if placed else np.zeros(0, np.int64)
        while len(front):  # successors in the same bucket
            done.append(front)
            prior = front[front > 0] - 1
            same = prior[text[prior] == c]
            _file(text, prior[text[prior] > c], waiting)
            front = same
        here = direct[bounds[c] : bounds[c + 1]]
        done.append(here)
        prior = here[here > 0] - 1
        _file(text, prior[text[prior] > c], waiting)
    return np.concatenate(done)


def _file(text: np.ndarray, at: np.ndarray, waiting: list[list[np.ndarray]]) -> None:
    if len(at):
        first = text[at]
        order = np.argsort(first, kind="stable")
        at, first = at[order], first[order]
        starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        for a, b in zip(starts, np.append(starts[1:], len(at)), strict=True):
            waiting[first[a]].append(at[a:b])


def common_prefix_at_least(text: np.ndarray, suffixes: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares ``length`` bytes with the one before it; all must have as many."""
    left = np.arange(1, len(suffixes))
    eights = _eights(text, 0)
    for k in range(0, length - _DEPTH + 1, _DEPTH):
        left = left[eights[suffixes[left] + k] == eights[suffixes[left - 1] + k]]
    for k in range(length // _DEPTH * _DEPTH, length):
        left = left[text[suffixes[left] + k] == text[suffixes[left - 1] + k]]
    out = np.zeros(len(suffixes), dtype=bool)
    out[left] = True
    return out


def _least_grams(data: np.ndarray, prefix: np.ndarray, length: int) -> np.ndarray:
    """For each window the least hash of its k-grams, k at most the window."""
    k = min(GRAM, length)
    at = np.arange(len(data) - k + 1)
    grams = span_hash(prefix, at, at + k)
    width, have = length - k + 1, 1
    while have < width:
        step = min(have, width - have)
        grams = np.minimum(grams[:-step], grams[step:])
        have += step
    return grams


#: Contexts of one hash in a task beyond which all of its contexts are compared window by window.
HOT = 64
#: Contexts that a task holds before it deals them out.
_HELD = 1 << 17
#: least hash, fingerprint, doc_id, sub, first window, windows, whether windows may repeat within it.
_CONTEXT = ("u8", "u8", "i8", "i8", "i8", "i4", "u1")
#: least hash, doc_id, sub, first window, windows, whether windows may repeat within it (1) or the hash is hot (2).
_DISTINCT = ("u8", "i8", "i8", "i8", "i4", "u1")
#: doc_id, sub, kind, hash, first window, windows.
_SPAN = ("i8", "i8", "u1", "u8", "i8", "i4")
_REMOVE, _COMPARE, _BY_WINDOW = 0, 1, 2
_TEXT = ("u8", "i8", "i8", "i8", "i4")
#: Rows of blocks: the part, whether the block holds spans (0) or what is next compared (1).
_BLOCKS = "part int, kind int, block binary"


def _doc_part(ids: np.ndarray, subs: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) ^ mix(subs.view(np.uint64))) % np.uint64(parts)).astype(np.int32)


def _hash_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(hashes) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _place(doc: np.ndarray, sub: np.ndarray) -> np.ndarray:
    """Numbers that order documents as doc_id and, among texts of one, sub do."""
    if not sub.any():
        return doc
    order = np.lexsort((sub, doc))
    new = np.concatenate(([0], (doc[order][1:] != doc[order][:-1]) | (sub[order][1:] != sub[order][:-1])))
    out = np.empty(len(doc), np.int64)
    out[order] = np.cumsum(new)
    return out


def _kind(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
    for x in batches:
        yield pa.record_batch([x.column("part"), pa.array(np.full(len(x), kind, np.int32)), x.column("block")], names=["part", "kind", "block"])


def _deal(part: np.ndarray, parts: int, kind: int, *columns: np.ndarray, last: bool = False) -> list[pa.RecordBatch]:
    packer = Packer(parts, 1 << 62, last)
    return [*_kind(packer.add(part, *columns), kind), *_kind(packer.flush(), kind)]


def _spans_of(parts: int, kind: int, doc: np.ndarray, sub: np.ndarray, begin: np.ndarray, count: np.ndarray, least: np.ndarray | None = None, last: bool = False) -> list[pa.RecordBatch]:
    n = len(doc)
    return _deal(_doc_part(doc, sub, parts), parts, 0, doc, sub, np.full(n, kind, np.uint8), np.zeros(n, np.uint64) if least is None else least, begin, count, last=last)


def _table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches, pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())]))


def _on(passed: pa.Table, parts: int, last: bool = False) -> list[pa.RecordBatch]:
    """The spans that came with a part, which stay in it."""
    columns = gather(passed, _SPAN)
    return _deal(_doc_part(columns[0], columns[1], parts), parts, 0, *columns, last=last) if len(passed) else []


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Blocks of spans, and of what the part compares."""
    next_ = np.asarray(table.column("kind")) == 1
    return table.filter(pa.array(~next_)), table.filter(pa.array(next_))


def _first_of_equal(least: np.ndarray, whole: np.ndarray, doc: np.ndarray, sub: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts are the first of those that are equal, and which come after them; rows alike are one."""
    key = mix(whole ^ mix(least)) + count.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))[: len(key)]
    single = new & np.append(new[1:], True)[: len(key)]
    many = order[~single]
    group = (np.cumsum(new) - 1)[~single]
    place = _place(doc[many], sub[many])
    inner = np.lexsort((begin[many], place, group))
    many, group, place = many[inner], group[inner], place[inner]
    first = np.concatenate(([True], group[1:] != group[:-1]))[: len(many)]
    alike = np.concatenate(([False], (group[1:] == group[:-1]) & (place[1:] == place[:-1]) & (begin[many][1:] == begin[many][:-1])))[: len(many)]
    return np.concatenate((order[single], many[first])), many[~first & ~alike]


def _contexts(length: int, parts: int) -> Callable:
    """Contexts by their content; of equal ones that a task holds the first alone, the others are to be removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                held.clear()
                first, rest = _first_of_equal(*columns[:6])
                yield from _deal(_hash_part(columns[1][first], parts), parts, 1, *(c[first] for c in columns))
                yield from _spans_of(parts, _REMOVE, *(c[rest] for c in columns[2:6]))

        for batch in batches:
            ids, subs = np.asarray(batch.column("doc_id")), np.asarray(batch.column("sub"))
            for row, data, offsets in chunks(batch.column("text"), 1 << 17):
                if len(data) < length:
                    continue
                prefix = prefix_hash(data, False)
                least = _least_grams(data, prefix, length)
                start = np.arange(len(least))
                doc = np.searchsorted(offsets, start, side="right") - 1
                inside = start + length <= offsets[doc + 1]
                start, least, doc = start[inside], least[inside], doc[inside]
                if not len(start):
                    continue
                new = np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(start)))
                begin, doc, least = start[first], doc[first], least[first]
                whole = span_marks(prefix_marks(data), begin, begin + count + length - 1)
                # A k-gram is the least of at most so many windows in a row, unless it comes again.
                k = min(GRAM, length)
                at = np.arange(len(data) - k + 1)
                grams = span_hash(prefix, at, at + k)
                again = np.zeros(len(first), np.uint8)
                run_of = np.repeat(np.arange(len(first)), count + length - k)
                places = np.arange(len(run_of)) - np.repeat(np.cumsum(count + length - k) - (count + length - k), count + length - k) + begin[run_of]
                hits = np.bincount(run_of[grams[places] == least[run_of]], minlength=len(first))
                again[hits > 1] = 1
                held.append((least, whole, ids[row + doc], subs[row + doc], (begin - offsets[doc]).astype(np.int64), count.astype(np.int32), again))
                if sum(len(x[0]) for x in held) >= _HELD:
                    yield from flush()
        yield from flush()
        trim()

    return run


def _merge_equal(parts: int, most: int) -> Callable:
    """Of equal contexts all but the first are removed. Those left go by their hash; a hash of many is marked as hot."""

    def run(table: pa.Table) -> pa.Table:
        passed, mine = _split(table)
        least, whole, doc, sub, begin, count, again = gather(mine, _CONTEXT)
        first, rest = _first_of_equal(least, whole, doc, sub, begin, count)
        out = _spans_of(parts, _REMOVE, doc[rest], sub[rest], begin[rest], count[rest])
        first = first[np.argsort(least[first], kind="stable")]
        least, doc, sub, begin, count, again = (x[first] for x in (least, doc, sub, begin, count, again))
        begins = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1]))[: len(least)])
        sizes = np.diff(np.append(begins, len(least)))
        hot = np.repeat(sizes > most, sizes)
        out += _spans_of(parts, _BY_WINDOW, doc[hot], sub[hot], begin[hot], count[hot])
        lead = begins[sizes > most]  # one of each hot hash says that it is
        again[lead] |= 2
        keep = ~hot
        keep[lead] = True
        out += _deal(_hash_part(least[keep], parts), parts, 1, *(x[keep] for x in (least, doc, sub, begin, count, again)))
        return _table(out + _on(passed, parts))

    return run


def _compare(length: int, parts: int, most_bytes: int) -> Callable:
    """Different contexts of one hash are compared, all at once or, where they are many, window by window."""

    def run(table: pa.Table) -> pa.Table:
        passed, mine = _split(table)
        least, doc, sub, begin, count, again = gather(mine, _DISTINCT)
        order = np.argsort(least, kind="stable")
        least, doc, sub, begin, count, again = (x[order] for x in (least, doc, sub, begin, count, again))
        begins = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1]))[: len(least)])
        sizes = np.diff(np.append(begins, len(least)))
        group = np.repeat(np.arange(len(begins)), sizes)
        volume = np.bincount(group, count + length - 1.0) if len(group) else np.zeros(0)
        hot = np.bincount(group, again > 1) > 0 if len(group) else np.zeros(0, bool)
        hot = (hot | (volume > most_bytes))[group]
        # One that marks its hash as hot is on its way already.
        by_window, several = hot & (again < 2), ~hot & ((sizes[group] > 1) | (again > 0))
        out = _spans_of(parts, _BY_WINDOW, doc[by_window], sub[by_window], begin[by_window], count[by_window])
        out += _spans_of(parts, _COMPARE, doc[several], sub[several], begin[several], count[several], least[several])
        return _table(out + _on(passed, parts))

    return run


def _pack_texts(parts: int, columns: tuple[str, ...]) -> Callable:
    """Texts as compressed blocks by part of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _doc_part(np.asarray(batch.column("doc_id")), np.asarray(batch.column("sub")), parts)
            for p in np.unique(part):
                some = batch.select(list(columns)).take(pa.array(np.flatnonzero(part == p)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema) as writer:
                    writer.write_batch(some)
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([zstandard.compress(sink.getvalue().to_pybytes(), 1)], pa.binary())], names=["part", "block"])
        trim()

    return run


def _texts(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for block in table.column("block"):
        with pa.ipc.open_stream(zstandard.decompress(block.as_py())) as reader:
            yield from reader


def _keys(doc: np.ndarray, sub: np.ndarray) -> np.ndarray:
    """Documents as numbers, by a hash where an id has several texts."""
    return doc.view(np.uint64) ^ np.where(sub == 0, np.uint64(0), mix(sub.view(np.uint64)))


def _fetch(length: int, parts: int) -> Callable:
    """The texts of the contexts to compare, by part of their hash, and those of single windows by part of their fingerprint.

    Of equal windows that the part holds at a time the first alone goes, the others are to be removed.
    """

    def run(key: tuple, texts: pa.Table, spans: pa.Table) -> pa.Table:
        doc, sub, kind, least, begin, count = gather(spans, _SPAN)
        pick = np.flatnonzero(kind != _REMOVE)
        names = _keys(doc, sub)
        pick = pick[np.argsort(names[pick], kind="stable")]
        doc, sub, kind, least, begin, count, names = (x[pick] for x in (doc, sub, kind, least, begin, count, names))
        wanted, first = np.unique(names, return_index=True)
        stops = np.append(first[1:], len(doc))
        done = np.zeros(len(wanted), dtype=bool)
        found: list[tuple[int, np.ndarray]] = []
        windows: list[tuple[np.ndarray, ...]] = []
        out: list[pa.RecordBatch] = []

        def deal_windows() -> None:
            if not windows:
                return
            mark, doc, sub, at, body = (np.concatenate(c) for c in zip(*windows, strict=True))
            windows.clear()
            one = np.ones(len(mark), np.int32)
            keep, rest = _first_of_equal(mark, mark, doc, sub, at, one)
            out.extend(_spans_of(parts, _REMOVE, doc[rest], sub[rest], at[rest], one[rest], last=True))
            part = _hash_part(mark[keep], parts)
            order = np.argsort(part, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                k = keep[some]
                out.append(_text_block(int(part[some[0]]), [x[k] for x in (mark, doc, sub, at, one)], list(body[k])))

        held = 0
        for batch in _texts(texts):
            data, offsets = utf8(batch.column("text"))
            own = _keys(np.asarray(batch.column("doc_id")), np.asarray(batch.column("sub")))
            where = np.minimum(np.searchsorted(wanted, own), max(0, len(wanted) - 1))
            for row in np.flatnonzero(wanted[where] == own) if len(wanted) else ():
                if done[where[row]]:
                    continue
                done[where[row]] = True
                text, marks = data[offsets[row] : offsets[row + 1]], None
                for k in range(first[where[row]], stops[where[row]]):
                    if kind[k] == _COMPARE:
                        found.append((k, text[begin[k] : begin[k] + count[k] + length - 1].copy()))
                        continue
                    marks = marks or prefix_marks(text)
                    at = np.arange(begin[k], begin[k] + count[k])
                    n = len(at)
                    windows.append((span_marks(marks, at, at + length), np.full(n, doc[k]), np.full(n, sub[k]), at, np.lib.stride_tricks.sliding_window_view(text, length)[at]))
                    held += n
                    if held >= _HELD:
                        deal_windows()
                        held = 0
        deal_windows()
        ks = np.array([k for k, _ in found], dtype=np.int64)
        part = _hash_part(least[ks], parts)
        for p in np.unique(part):
            some = np.flatnonzero(part == p)
            out.append(_text_block(p, [x[ks[some]] for x in (least, doc, sub, begin, count)], [found[j][1] for j in some]))
        trim()
        return _table(out)

    return run


def _text_block(part: int, head: list[np.ndarray], body: list[np.ndarray]) -> pa.RecordBatch:
    packed = encode(head)
    block = len(packed).to_bytes(8, "little") + packed + zstandard.compress(b"".join(x.tobytes() for x in body), 1)
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([1], pa.int32()), pa.array([block], pa.binary())], names=["part", "kind", "block"])


def windows_seen_before(text: np.ndarray, starts: np.ndarray, ranks: np.ndarray, length: int) -> np.ndarray:
    """Positions of windows of which an equal one has a lesser rank.

    ``text`` is texts end to end, the k-th from ``starts[k]`` to ``starts[k + 1]``; ``ranks`` orders
    their positions as the corpus does.
    """
    suffixes = suffix_array(text, length)
    # Those that run beyond their own text are no windows, and could stand between equal ones.
    suffixes = suffixes[starts[np.searchsorted(starts, suffixes, side="right")] - suffixes >= length]
    joined = common_prefix_at_least(text, suffixes, length)
    group = np.cumsum(~joined) - 1
    least = np.full(len(suffixes), np.iinfo(np.int64).max)
    np.minimum.at(least, group, ranks[suffixes])
    return suffixes[ranks[suffixes] > least[group]]


def _sort_contexts(length: int, parts: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        passed, mine = _split(table)
        if not len(mine):
            return _table(_on(passed, parts, last=True))
        heads, bodies = [], []
        for block in mine.column("block"):
            raw = block.as_py()
            n = int.from_bytes(raw[:8], "little")
            heads.append(decode(raw[8 : 8 + n], _TEXT))
            bodies.append(np.frombuffer(zstandard.decompress(raw[8 + n :]), np.uint8))
        least, doc, sub, begin, count = (np.concatenate(x) for x in zip(*heads, strict=True))
        sizes = count.astype(np.int64) + length - 1
        text, at = np.concatenate(bodies), np.concatenate(([0], np.cumsum(sizes)))[:-1]
        del heads, bodies
        place = _place(doc, sub)
        order = np.lexsort((begin, place, least))
        least, place, begin, sizes, at = (x[order] for x in (least, place, begin, sizes, at))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        a, total = 0, np.cumsum(sizes)
        new = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1], [True])))
        while a < len(least):
            # Whole hashes up to _PIECE, or one, which has not much over SORT_BYTES.
            limit = (total[a - 1] if a else 0) + _PIECE
            b = new[max(np.searchsorted(new, a, side="right"), np.searchsorted(new, np.searchsorted(total, limit, side="right"), side="right") - 1)]
            s = sizes[a:b]
            starts = np.concatenate(([0], np.cumsum(s)))
            inner = np.arange(starts[-1]) - np.repeat(starts[:-1], s)
            piece = text[np.repeat(at[a:b], s) + inner]
            # Contexts are sorted by document and place within a hash, and windows are compared within one only.
            of = np.repeat(np.arange(a, b), s)
            rank = np.empty(len(of), np.int64)
            rank[np.lexsort((begin[of] + inner, place[of]))] = np.arange(len(of))
            found = windows_seen_before(piece, starts, rank, length)
            out.append((order[of[found]], begin[of[found]] + inner[found]))
            a = b
        which, at = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((at, _place(doc, sub)[which]))
        doc, sub, at = doc[which][order], sub[which][order], at[order]
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (at[1:] != at[:-1] + 1))))[: len(doc)]
        trim()
        out = _spans_of(parts, _REMOVE, doc[first], sub[first], at[first], np.diff(np.append(first, len(doc))).astype(np.int32), last=True)
        return _table(out + _on(passed, parts, last=True))

    return run


def _merge(length: int, make: Callable) -> Callable:
    """Cuts the found windows out of each text; ``make`` turns texts and spans into the rows returned."""

    def run(key: tuple, texts: pa.Table, spans: pa.Table) -> pa.Table:
        doc, sub, kind, _, begin, count = gather(spans, _SPAN)
        pick = kind == _REMOVE
        name, begin, stop = _keys(doc, sub)[pick], begin[pick], begin[pick] + count[pick] + length - 1
        order = np.lexsort((begin, name))
        name, begin, stop = name[order], begin[order], stop[order]
        wanted, first = np.unique(name, return_index=True)
        ends = np.append(first[1:], len(name))
        rows = []
        for batch in _texts(texts):
            own = _keys(np.asarray(batch.column("doc_id")), np.asarray(batch.column("sub")))
            data, offsets = utf8(batch.column("text"))
            where = np.searchsorted(wanted, own)
            cuts = []
            for row, w in enumerate(where):
                if w < len(wanted) and wanted[w] == own[row]:
                    a, b = begin[first[w] : ends[w]], np.maximum.accumulate(stop[first[w] : ends[w]])
                    new = np.concatenate(([True], a[1:] > b[:-1]))
                    cuts.append((a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]))
                else:
                    cuts.append(None)
            rows.append(make(batch, data, offsets, cuts))
        trim()
        return pa.concat_tables(rows)

    return run


def _kept(data: np.ndarray, cut: tuple[np.ndarray, np.ndarray] | None) -> bytes:
    if cut is None:
        return data.tobytes()
    edges = np.concatenate(([0], np.stack(cut, axis=1).ravel(), [len(data)]))
    return b"".join(data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))


def _spans(docs: DataFrame, length: int) -> tuple[DataFrame, int]:
    """Blocks of windows to remove, and the number of parts."""
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), volume // (8 << 20))
    narrow = docs.select("doc_id", "sub", "text")
    found = spread(narrow.mapInArrow(_contexts(length, parts), _BLOCKS), parts, {0: _SPAN, 1: _CONTEXT})
    found = spread(found.groupBy("part").applyInArrow(_merge_equal(parts, HOT), _BLOCKS), parts, {0: _SPAN, 1: _DISTINCT})
    found = spread(found.groupBy("part").applyInArrow(_compare(length, parts, SORT_BYTES), _BLOCKS), parts, {0: _SPAN})
    found = checkpoint(found).select("part", "block")
    texts = narrow.mapInArrow(_pack_texts(parts, ("doc_id", "sub", "text")), SCHEMA)
    compared = texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_fetch(length, parts), _BLOCKS)
    sorted_ = checkpoint(compared.groupBy("part").applyInArrow(_sort_contexts(length, parts), _BLOCKS)).select("part", "block")
    return found.unionByName(sorted_), parts


def _keyed(frame: DataFrame) -> DataFrame:
    """``frame`` (doc_id, text, others) with ``sub``, which orders the texts of an id: 0 where it has one, or else from their hash.

    A null id becomes the least one, and its texts stand before those of that id.
    """
    null = F.col("doc_id").isNull()
    frame = frame.withColumns({"doc_id": F.coalesce("doc_id", F.lit(-(1 << 63))), "hash": F.shiftrightunsigned(F.xxhash64("text"), 1) + F.when(null, F.lit(-(1 << 63))).otherwise(F.lit(0))})
    several = frame.groupBy("doc_id").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("several"))
    several = checkpoint(several)
    if not several.take(1):
        return frame.withColumn("sub", F.lit(0).cast("long")).drop("hash")
    # A row for each such id, so a hot id meets one row.
    return frame.join(several, "doc_id", "left").withColumn("sub", F.when(F.col("several"), F.col("hash")).otherwise(0)).drop("hash", "several")


def repeated_bytes(docs: DataFrame, length: int = 100) -> DataFrame:
    """What is left of each document without the bytes of ``length``-byte strings that also start earlier.

    Earlier is in a smaller doc_id, or before in the same document; strings are judged on the
    input and don't cross documents. Returns a row per row of ``docs`` (doc_id, text, any others):
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes), kept_sha256 and
    spans (starts and stops). A null text is empty; an empty table gives an empty result; texts may be of any
    length. doc_id is the key: a null one counts as less than the others, rows alike in id and text are one document and
    returned each, and different texts of one id are documents in an order of their own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = _keyed(docs)
    spans, parts = _spans(docs, length)

    def make(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, cuts: list) -> pa.Table:
        kept = [_kept(data[offsets[k] : offsets[k + 1]], cut) for k, cut in enumerate(cuts)]
        size = np.diff(offsets)
        edges = [[] if c is None else np.stack(c, axis=1).tolist() for c in cuts]
        return pa.table(
            {
                "doc_id": batch.column("id"),
                "n_bytes": pa.array(size, pa.int64()),
                "n_removed": pa.array(size - np.array([len(x) for x in kept], dtype=np.int64), pa.int64()),
                "n_spans": pa.array([len(x) for x in edges], pa.int64()),
                "kept": pa.array(kept, pa.binary()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                "spans": pa.array(edges, pa.list_(pa.list_(pa.int64()))),
            }
        )

    texts = docs.mapInArrow(_pack_texts(parts, ("id", "doc_id", "sub", "text")), SCHEMA)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<array<long>>"
    return texts.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_merge(length, make), schema)


def _whole_characters(data: np.ndarray, cut: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spans shrunk to whole characters of UTF-8; those without any go."""
    start, stop = cut[0].copy(), cut[1].copy()
    padded = np.append(data, np.uint8(0))
    for _ in range(3):
        start += (padded[start] & 0xC0) == 0x80
        stop -= (padded[stop] & 0xC0) == 0x80
    real = start < stop
    return start[real], stop[real]


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``, and ``n_chars``, if there is one, counted anew.

    Cuts as :func:`repeated_bytes` finds them, shrunk to whole characters, so the rest is text. All
    rows and columns stay; a text that is a repeat throughout becomes empty, and a null stays null.
    """
    columns = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    row = _keyed(row)
    spans, parts = _spans(row, length)

    def make(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, cuts: list) -> pa.Table:
        texts = []
        for k, cut in enumerate(cuts):
            own = data[offsets[k] : offsets[k + 1]]
            texts.append(_kept(own, cut and _whole_characters(own, cut)).decode("utf-8", "replace") if batch.column("text")[k].is_valid else None)
        out = dict(zip(columns, batch.column("row").flatten(), strict=True))
        out["text"] = pa.array(texts, pa.string())
        if "n_chars" in out:
            changed = [len(t) if c is not None and t is not None else n.as_py() for t, c, n in zip(texts, cuts, out["n_chars"], strict=True)]
            out["n_chars"] = pa.array(changed, out["n_chars"].type)
        return pa.table(out)

    packed = row.mapInArrow(_pack_texts(parts, ("row", "doc_id", "sub", "text")), SCHEMA)
    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    return packed.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_merge(length, make), schema)
