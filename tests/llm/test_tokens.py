import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


def brute(edges, sections, rule):
    out = [0.0] * len(sections)
    for a, b in zip(edges, edges[1:], strict=False):
        share = [sum(s <= x < e for x in range(a, b)) for s, e in sections]
        if rule == "first":
            pick = [k for k, (s, e) in enumerate(sections) if s <= a < e]
        elif rule == "last":
            pick = [k for k, (s, e) in enumerate(sections) if s <= b - 1 < e]
        elif rule == "most":
            pick = [share.index(max(share))] if share and max(share) else []
        else:
            out = [o + x / (b - a) for o, x in zip(out, share, strict=True)]
            continue
        for k in pick:
            out[k] += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=12), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 7)), max_size=8), st.sampled_from(tokens.RULES))
def test_attribution_equals_brute_force(sizes, spans, rule):
    edges = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64))))
    sections, at = [], 0
    for gap, size in spans:
        sections.append((at + gap, at + gap + size))
        at += gap + size
    starts, stops = (np.array([x[k] for x in sections], dtype=np.int64) for k in (0, 1))
    found, _ = tokens.attribute(edges, starts, stops, rule)
    assert np.allclose(found, brute(edges.tolist(), sections, rule))


@needs_vocabulary
def test_counts(spark):
    rows = [(1, "One line\nsecond é line\n\n", 5), (1, "One line\nsecond é line\n\n", 5), (2, None, 1), (3, "", 1), (4, "x" * 30_000, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = sorted(tokens.token_counts(frame, ["doc_id"], ["text"]).collect(), key=lambda r: r.doc_id)
    for r in found:
        assert sum(r.section_tokens) == r.n_tokens and len(r.section_tokens) == r.n_sections
    assert [r.n_sections for r in found] == [3, 3, 0, 0, 1] and found[2].n_tokens == 0
    fields = tokens.token_counts(frame.selectExpr("doc_id", "text", "'user' AS role"), ["doc_id"], ["role", "text"], rule="most").collect()
    assert all(r.n_sections == 2 and r.section_tokens[0] >= 1 for r in fields)
    assert tokens.token_counts(frame.limit(0), ["doc_id"], ["text"]).collect() == []


@needs_vocabulary
def test_spans_give_the_text_back():
    with open(tokens.VOCABULARY, "rb") as file:
        encoder, sizes = tokens._encoder(file.read())
    text = "Héllo, wörld 123 \U0001f600\n"
    edges = tokens.token_spans(text, encoder, sizes)
    raw = text.encode()
    assert edges[-1] == len(raw) and [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)] == [encoder.decode_single_token_bytes(t) for t in encoder.encode_ordinary(text)]
