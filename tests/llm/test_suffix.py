import pytest
import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import suffix


def brute(rows, length):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=120).map(lambda b: bytes(1 + x % 4 for x in b)), st.sampled_from([4, 8, 100]))
def test_suffix_array_orders_all_suffixes(b, length):
    order = suffix.suffix_array(np.frombuffer(b, np.uint8), length)
    assert sorted(order.tolist()) == list(range(len(b)))
    assert all(b[x:][:length] <= b[y:][:length] for x, y in zip(order, order[1:], strict=False))


def corpus(seed, alphabet="abcdé \n"):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choices(alphabet, k=rnd.choice([30, 90, 99, 100, 101, 130, 300]))) for _ in range(12)]
    rows = []
    for d in range(80):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.5 else "".join(rnd.choices(alphabet, k=rnd.randint(0, 150))))
        rows.append((d, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "=" * 450), (103, "ab" * 200), (104, rows[3][1]), (105, "x" * 99), (106, "\x00" * 210), (107, "=" * 120)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_bytes int").repartition(5)
    for length in (100, 24):
        found = suffix.repeated_bytes(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted(map(tuple, found.collect())) == brute(rows, length)


@pytest.mark.parametrize(("hot", "most"), [(1, 1 << 20), (1 << 20, 500), (3, 2000)])
def test_hot_hashes_are_split_by_windows(spark, monkeypatch, hot, most):
    """One line in every text, between others of its own."""
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SORT_BYTES", most)
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    line = " ".join(word() for _ in range(20))
    rows = [(d, " ".join([*(word() for _ in range(rnd.randint(0, 30))), line, *(word() for _ in range(rnd.randint(0, 30)))])) for d in range(120)] + corpus(4)[:0]
    rows += [(500 + d, line[rnd.randint(0, 30) :] + word()) for d in range(40)] + [(900, None), (901, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = suffix.repeated_bytes(docs, 100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, found.collect())) == brute(rows, 100)


def test_ids_at_the_ends_of_their_range(spark):
    rnd = random.Random(6)
    a, b = ("".join(rnd.choices("abcdefgh", k=150)) for _ in range(2))
    least, most = -(1 << 63), (1 << 63) - 1
    rows = [(None, a), (least, a), (least, b), (-5, b), (most, a + "x"), (most, "x" + b), (most, a + "x")]
    found = suffix.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in found), key=str) == sorted([(None, 150, 0), (least, 150, 150), (least, 150, 0), (-5, 150, 150), (most, 151, 150), (most, 151, 150), (most, 151, 150)], key=str)


def test_equal_contexts_are_told_by_fingerprints_without_structure():
    from tessera.llm._text import prefix_marks, span_marks

    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((word + word.translate(str.maketrans("ab", "ba")) + word).encode(), np.uint8)
    n = len(word)
    a, b, c = span_marks(prefix_marks(data), np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert a != b and a == c


def test_empty_table(spark):
    assert suffix.repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows_and_ids(spark):
    rnd = random.Random(5)
    a, b, c = ("".join(rnd.choices("abcdefgh", k=150)) for _ in range(3))
    rows = [(1, a), (1, a), (2, b), (2, c + a), (None, c), (3, a + c)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.repeated_bytes(frame).collect()), key=str)
    assert found == sorted([(1, 150, 0), (1, 150, 0), (2, 150, 0), (2, 300, 300), (None, 150, 0), (3, 300, 300)], key=str)


def test_remove_repeats_cuts_whole_characters(spark):
    passage = "".join(f"é{k}" for k in range(40)) + "é"
    size = len(passage) + 2
    rows = [(1, "x" + passage + "y", "a", size), (2, "q" + passage + "z", "b", size), (3, None, "c", 0), (4, "short", None, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    found = sorted(map(tuple, suffix.remove_repeats(frame, 100).collect()))
    assert found == [rows[0], (2, "qz", "b", 2), rows[2], rows[3]]
    assert suffix.remove_repeats(frame.limit(0), 100).collect() == []


def test_a_task_holds_little_beside_its_texts(monkeypatch):
    """The pipeline went over an executor's memory by tables of powers for texts of 1 MB and more, and by sorting 1 MB at once."""
    import tracemalloc

    from tessera.llm import _text

    monkeypatch.setattr(_text, "_powers", [np.ones(1, np.uint64)] * 2)
    monkeypatch.setattr(_text, "_mark_powers", [np.ones(1, np.uint64)] * 2)
    rng = np.random.default_rng(7)
    data = rng.integers(97, 101, 1 << 17).astype(np.uint8)
    prefix, marks = _text.prefix_hash(data, False), _text.prefix_marks(data)
    a, b = np.array([0]), np.array([len(data)])
    whole = _text.span_hash(prefix, a, b), _text.span_marks(marks, a, b)
    assert sum(x.nbytes for x in [*_text._powers, *_text._mark_powers]) < 8 << 20
    data = np.concatenate((data, data, data))  # tables grow, and hashes stay
    prefix, marks = _text.prefix_hash(data, False), _text.prefix_marks(data)
    a, b = (x[0] + np.array([0, 1 << 17, 2 << 17]) for x in (a, b))
    assert set(_text.span_hash(prefix, a, b)) == set(whole[0]) and set(_text.span_marks(marks, a, b)) == set(whole[1])

    # 20,000 contexts of 80 windows, two by two of one hash: every second has the last 130 bytes of the one before, from its fifth byte on.
    n, size = 20_000, 179
    text = rng.integers(97, 123, (n, size)).astype(np.uint8)
    text[1::2, 5:135] = text[::2, -130:]
    text[1::2, 4] = 65
    head = [np.repeat(np.arange(n // 2, dtype=np.uint64), 2), np.arange(n), np.zeros(n, np.int64), np.full(n, 7), np.full(n, size - 99, np.int32)]
    table = suffix._table([suffix._text_block(0, head, list(text))])
    sort = suffix._sort_contexts(100, 8)
    tracemalloc.start()
    out = sort(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * text.size
    found = sorted(zip(*(c.tolist() for c in suffix.gather(out, suffix._SPAN)), strict=True))
    assert found == [(d, 0, suffix._REMOVE, 0, 7 + 5, 31) for d in range(1, n, 2)]
