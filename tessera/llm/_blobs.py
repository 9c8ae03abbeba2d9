"""Shuffling numeric columns as compressed blocks.

Millions of 20-byte records cost far more as rows than as bytes. A task deals its records to
numbered parts itself and emits one compressed block for each part; the shuffle then moves a
few blocks, and a part is read back as numpy columns.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = "part int, block binary"
ARROW = pa.schema([("part", pa.int32()), ("block", pa.binary())])


def encode(columns: Sequence[np.ndarray]) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def decode(block: bytes, dtypes: Sequence[str]) -> list[np.ndarray]:
    raw = zstandard.decompress(block)
    kinds = [np.dtype(d) for d in dtypes]
    n, at, out = len(raw) // sum(k.itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(raw, dtype=k, count=n, offset=at))
        at += n * k.itemsize
    return out


#: Parts that a task deals to at once. Of more it deals to this many groups of parts, which :func:`spread` deals on.
WIDE = 2048
#: Records that a packer holds at most.
_MOST_HELD = 1 << 20


class Packer:
    """Holds records up to ``limit`` rows, by default some hundreds a part, then deals them out as blocks by part.

    With more than ``WIDE`` parts blocks are of groups of parts, the part of each record their first column, and
    must go through :func:`spread`; unless this is the ``last`` deal.
    """

    def __init__(self, parts: int, limit: int = 0, last: bool = False):
        self.fan = 1 if last else -(-parts // WIDE)
        self.parts, self.limit, self.held, self.rows = -(-parts // self.fan), limit or min(max(1 << 18, parts << 9), _MOST_HELD), [], 0

    def add(self, part: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((part // self.fan, part.astype(np.int32), *columns) if self.fan > 1 else (part, *columns))
        self.rows += len(part)
        if self.rows >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            part, *columns = (np.concatenate(c) for c in zip(*self.held, strict=True))
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            bounds = np.append(first, len(part))
            columns = [c[order] for c in columns]
            for some in np.array_split(np.arange(len(first)), max(1, len(first) // 64)):
                blocks = [encode([c[bounds[k] : bounds[k + 1]] for c in columns]) for k in some]
                yield pa.record_batch([pa.array(part[first[some]].astype(np.int32)), pa.array(blocks, pa.binary())], schema=ARROW)
        self.held, self.rows = [], 0


def spread(frame: DataFrame, parts: int, dtypes: Sequence[str] | dict[int, Sequence[str]]) -> DataFrame:
    """Blocks (part, block) of ``parts`` parts, as packers made them; ``dtypes`` by kind where rows have one (part, kind, block).

    Beyond ``WIDE`` parts each group's blocks come to one task, which deals them to the parts of the group, as a stream.
    """
    if parts <= WIDE:
        return frame
    return frame.repartition("part").mapInArrow(_deal_on(parts, dtypes), frame.schema)


def _deal_on(parts: int, dtypes: Sequence[str] | dict[int, Sequence[str]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_kind = isinstance(dtypes, dict)
        packers = {k: Packer(parts, last=True) for k in (dtypes if by_kind else (0,))}

        def named(found: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
            for x in found:
                yield pa.record_batch([x.column("part"), pa.array(np.full(len(x), kind, np.int32)), x.column("block")], names=["part", "kind", "block"]) if by_kind else x

        for batch in batches:
            kinds = batch.column("kind").to_pylist() if by_kind else [0] * len(batch)
            for kind, block in zip(kinds, batch.column("block"), strict=True):
                yield from named(packers[kind].add(*decode(block.as_py(), ("i4", *(dtypes[kind] if by_kind else dtypes)))), kind)
        for kind, packer in packers.items():
            yield from named(packer.flush(), kind)
        trim()

    return run


def gather(table: pa.Table, dtypes: Sequence[str], column: str = "block") -> list[np.ndarray]:
    """All records of a part, column by column."""
    parts = [decode(b.as_py(), dtypes) for b in table.column(column) if b.is_valid]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=d) for d in dtypes]


_C = ctypes.CDLL(None) if sys.platform.startswith("linux") else None


def trim() -> None:
    """Gives freed memory back, which a Python worker would hold while it waits for its next task."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)
