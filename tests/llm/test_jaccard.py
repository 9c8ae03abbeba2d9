import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import jaccard
from tessera.llm._text import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(fold)


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, percent):
    """doc_id -> (size, smallest reachable doc_id) by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=150):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    passage = rnd.choices(vocabulary, k=40)
    rows = []
    for d in range(n):
        kind = rnd.random()
        if kind < 0.5 and rows:
            base = words(rnd.choice(rows)[1]) or ["x"]
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                base[rnd.randrange(len(base))] = rnd.choice(vocabulary)
            rows.append((d, " ".join(base)))
        else:
            text = rnd.choices(vocabulary, k=rnd.choice([1, 2, 3, 5, 8, 12, 20, 60, 150, 400]))
            rows.append((d, "\n".join([" ".join(passage)] * (rnd.random() < 0.3) + [" ".join(text)])))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One"), (n + 4, "oNE"), (n + 5, rows[7][1]), (n + 6, "Ä ß ä")]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, width, percent):
    rows = corpus(width)
    docs = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, source string, component_id int")
    found = jaccard.jaccard_components(docs, width, percent)
    assert sorted(map(tuple, found.collect())) == brute(rows, width, percent)


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert jaccard.jaccard_components(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c"), (1, "a b c"), (2, "A B C"), (3, None)]
    found = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, schema)).collect()))
    assert found == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]
    long = [f"w{k}" for k in range(60)]
    odd = [(None, " ".join(long)), (5, " ".join(long[1:])), (5, "q r s"), (6, "q r s t u v"), (4, "q r s")]
    found = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(odd, schema), 3, 90).collect()), key=str)
    assert found == sorted([(None, 58, 5), (5, 57, 5), (5, 1, 4), (4, 1, 4), (6, 4, 6)], key=str)
    assert sorted(r.doc_id for r in jaccard.keep_one(spark.createDataFrame(rows, schema)).collect()) == [1, 3]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 120), st.data(), st.sampled_from([80, 90]))
def test_linked_sets_share_an_entry(size, data, percent):
    """The pigeonhole guarantee for any pair that links, unless both fail by empty segments and go to the finest partition."""
    import numpy as np

    rnd = np.random.default_rng(data.draw(st.integers(0, 1 << 30)))
    a = np.unique(rnd.integers(0, 1 << 64, size, dtype=np.uint64))
    drop, grow = data.draw(st.integers(0, 12)), data.draw(st.integers(0, 12))
    b = np.unique(np.concatenate((a[min(drop, len(a) - 1) :], rnd.integers(0, 1 << 64, grow, dtype=np.uint64))))
    if jaccard.linked(a, b, percent):
        seen = [{(k, int(e)) for k in jaccard.bands_of(len(x), percent) for e in jaccard.entries(x, k, percent)[0]} for x in (a, b)]
        number = max(map(len, (a, b)))
        able = [jaccard.entries(x, jaccard.bands_of(number, percent)[0], percent)[2] >= 0 for x in (a, b)]
        assert seen[0] & seen[1] or not any(able)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 3000), st.sampled_from([80, 90]), st.integers(0, 1 << 30))
def test_unrelated_sets_share_nothing(size, percent, seed):
    """No entry, that of an empty segment neither, is common to sets without a common token; bitmaps tell them apart."""
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(seed)
    a, b = (np.unique(rnd.integers(0, 1 << 64, size, dtype=np.uint64)) for _ in "ab")
    for k in jaccard.bands_of(size, percent):
        assert not set(jaccard.entries(a, k, percent)[0].tolist()) & set(jaccard.entries(b, k, percent)[0].tolist())
    if size > 20:
        pair = pa.record_batch([pa.array([1]), pa.array([2]), pa.array([len(a)]), pa.array([len(b)]), pa.array([jaccard.parity(a)]), pa.array([jaccard.parity(b)])], names=["a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b"])
        assert len(next(jaccard._close(percent)(iter([pair])))) == 0


def test_hot_passages_take_the_finest_partition(spark, monkeypatch):
    """Many texts of one long passage and a few words each: hot entries beyond what sets can spare."""
    monkeypatch.setattr(jaccard, "HOT", 2)
    monkeypatch.setattr(jaccard, "SALT_ROWS", 7)
    rnd = random.Random(3)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for d in range(90):
        own = [f"x{rnd.randrange(10**6)}" for _ in range(rnd.randint(4, 30))]
        rows.append((d, " ".join(passage + own)))
        if d % 3 == 0:
            rows.append((1000 + d, " ".join(["new", *passage, *own])))
    rows += [(2000 + k, f"t{k % 7} u{k % 5} v{k % 3} w") for k in range(40)]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert sorted(map(tuple, found.collect())) == brute(rows, 3, 90)


def test_words_of_one_polynomial_differ(spark):
    """Thue-Morse words, which collide under any polynomial modulo 2**64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1), (2, 1, 2)]


def test_keep_one_by_row(spark):
    schema = "doc_id long, text string, Id int, same string"
    rows = [(7, "a b c d e f g", 1, "x"), (7, "a b c d e f g", 2, "y"), (None, "a b c d e f g", 3, None), (9, "A b c d e f g", 4, None), (None, "q r", 5, None), (None, "q r", 6, None), (3, "", 7, None), (3, "", 8, None), (None, None, 9, None)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "Id", "same"]
    found = kept.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in found) == sorted([(7, "a b c d e f g"), (0, "q r"), (3, ""), (3, ""), (0, "")])
    assert jaccard.keep_one(spark.createDataFrame([], schema)).collect() == []


def test_shingle_sets_match_words():
    import pyarrow as pa

    texts = [t for _, t in corpus(9, 40)]
    for text, found in zip(texts, shingle_sets(pa.array(texts, pa.string()), 3), strict=True):
        assert len(found) == len(shingles(text, 3))
