"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole, so that its count is what a model sees. The tokens of a
byte-level vocabulary have known lengths, so running sums give each token's span; sections or fields
are spans of the same text, and an interval join by binary search lays one over the
other. Tokens that cross a boundary go where a stated rule says.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._blobs import trim

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: "first": the section of the token's first byte; "last": of its last; "most": the one with most
#: of its bytes, the first of several; "split": every section by its share of the bytes.
RULES = ("first", "last", "most", "split")


@lru_cache(maxsize=2)
def _encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    sizes = np.zeros(max(table.values()) + 1, np.int64)
    for piece, rank in table.items():
        sizes[rank] = len(piece)
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), sizes


#: Runs of blanks as the pattern sees them (Unicode's White_Space), too long for its look-ahead, which goes back by single characters.
_LONG_RUN = re.compile("(?<![{0}])[{0}]{{1000,}}".format("\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"))


def encode(text: str, encoder) -> list[int]:
    """The tokens of a text, long runs of blanks apart: all of a run but its last blank, or all at the end of the text, is one piece to the pattern, too."""
    found, at = [], 0
    for run in _LONG_RUN.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        found += encoder.encode_ordinary(text[at : run.start()])
        found += encoder._encode_single_piece(text[run.start() : stop])
        at = stop
    return found + encoder.encode_ordinary(text[at:] if at else text)


def token_spans(text: str, encoder, sizes: np.ndarray) -> np.ndarray:
    """Edges of the tokens of a text in its UTF-8 bytes: token k is from edge k to edge k + 1."""
    found = np.asarray(encode(text, encoder), dtype=np.int64)
    return np.concatenate(([0], np.cumsum(sizes[found])))


def attribute(edges: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens lie in no single section.

    ``starts`` and ``stops`` are the sections' bytes in order, without overlap; between them there
    may be gaps, whose bytes belong to none. Empty sections get nothing.
    """
    out = np.zeros(len(starts), float if rule == "split" else np.int64)
    a, b = edges[:-1], edges[1:]
    real = np.flatnonzero(stops > starts)
    if not len(a) or not len(real):
        return out, len(a)
    s, e = starts[real], stops[real]
    low = np.searchsorted(e, a, side="right")  # the first section that ends beyond the token's first byte
    high = np.searchsorted(s, b, side="left") - 1  # the last one that begins before its end
    last = len(real) - 1
    inside = (low <= last) & (s[np.minimum(low, last)] <= a) & (e[np.minimum(low, last)] >= b)
    crossing = int((~inside).sum())
    if rule == "first":
        held = (low <= last) & (s[np.minimum(low, last)] <= a)
        owner = low[held]
    elif rule == "last":
        held = (high >= 0) & (e[np.maximum(high, 0)] >= b)
        owner = high[held]
    elif rule in ("most", "split"):
        np.add.at(out, real[low[inside]], 1)
        for k in np.flatnonzero(~inside & (low <= high)):
            near = np.arange(low[k], high[k] + 1)
            share = np.minimum(e[near], b[k]) - np.maximum(s[near], a[k])
            if rule == "most":
                out[real[near[np.argmax(share)]]] += 1
            else:
                out[real[near]] += share / (b[k] - a[k])
        return out, crossing
    else:
        raise ValueError(f"rule must be one of {RULES}")
    np.add.at(out, real[owner], 1)
    return out, crossing


def _lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines as sections; a line feed belongs to the line that it ends."""
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.concatenate(([0], breaks[breaks < len(data)])) if len(data) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(data)) if len(data) else starts


def _count(ranks: bytes, columns: list[str], rule: str, separator: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = _encoder(ranks)
        gap = len(separator.encode())
        for batch in batches:
            fields = [batch.column(c).to_pylist() for c in columns]
            rows = []
            for values in zip(*fields, strict=True):
                texts = [v or "" for v in values]
                whole = separator.join(texts)
                edges = token_spans(whole, encoder, sizes)
                if len(columns) == 1:
                    starts, stops = _lines(np.frombuffer(whole.encode(), np.uint8))
                else:
                    stops = np.cumsum([len(t.encode()) + gap for t in texts]) - gap
                    starts = stops - [len(t.encode()) for t in texts]
                counts, crossing = attribute(edges, starts, stops, rule)
                rows.append((len(edges) - 1, len(starts), crossing, counts.astype(float).tolist()))
            n, sections, crossing, counts = zip(*rows, strict=True) if rows else ((), (), (), ())
            kept = [c for c in batch.schema.names if c not in columns]
            yield pa.record_batch(
                [*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(sections, pa.int64()), pa.array(crossing, pa.int64()), pa.array(counts, pa.list_(pa.float64()))],
                names=[*kept, "n_tokens", "n_sections", "n_crossing", "section_tokens"],
            )
        trim()

    return run


def token_counts(rows: DataFrame, keys: list[str], columns: list[str], rule: str = "first", separator: str = "\n", vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each row of ``rows`` and of its sections.

    One column: the sections are its lines. Several: they are the fields of a text that joins them by
    ``separator``, whose bytes belong to none. Returns ``keys`` and n_tokens, n_sections, n_crossing (tokens not wholly in one
    section) and section_tokens, in order. With the rule "first" and lines all tokens are
    given out; where shares of a token tie ("most") the first section has it. A null text is empty: no tokens, and no
    lines or an empty field. Repeated rows are each counted, texts of any length encoded whole. A key that has the name
    of a result is returned as ``key_<name>``. ``vocabulary`` is a file that the driver reads and ships whole, of
    ranks by line (some hundreds of kilobytes); an empty table gives an empty result.
    """
    with open(vocabulary, "rb") as file:
        ranks = file.read()
    results = ("n_tokens", "n_sections", "n_crossing", "section_tokens")
    key = rows.select(*[F.col(f"`{k}`").alias(f"key_{k}" if k.lower() in results else k) for k in keys])
    names = []
    for c in columns:
        name = f"text_{len(names)}"
        while name.lower() in {k.lower() for k in key.columns}:
            name += "_"
        names.append(name)
    narrow = rows.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, key.columns, strict=True)], *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(columns, names, strict=True)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key.schema)
    return narrow.mapInArrow(_count(ranks, names, rule, separator), f"{schema}, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>")
