"""Rows that every operator and stage must take: nulls, empty and very long texts, ties, repeats, clashing names, empty tables."""

import datetime

import pytest

import corpus_pipeline
from tessera.llm import decontaminate, hnsw, html, jaccard, lm, mixing, suffix, tokens, toxicity, warc

LONG = " ".join(f"w{k % 9973}x{k % 7}" for k in range(700_000))  # some 5 MB
BLANKS = " " * 300_000
TEXTS = [None, "", " \t\n", BLANKS, LONG, "one two three four five six", "one two three four five six", "x", "Ä ß " * 30, "a" * 100_000, "toxic " * 9, "fine " * 9]
#: Names that clash, in other cases, with those the operators use or return.
MORE = "Score double, SIZE int, source_size long, target int, repeats int, Copy int, whole int, cut int, _bucket int, id int, same string, cls long, n long, bitmap binary, component int, _id int, _t int, row int, at date, held_out boolean, plain string, rank int, n_chars int"


@pytest.fixture(scope="module")
def docs(spark):
    extra = (1.0, 2, 3, 4, 5, 6, 7, 8, 9, 10, "s", 11, 12, b"b", 13, 14, 15, 16, datetime.date(2020, 1, 1), True, "p", 17, 18)
    rows = [(d, t, None if d == 3 else f"s{d % 3}", *extra) for d, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "s2", *extra), (5, "another text of that id", None, *extra), (None, TEXTS[5], "s1", *extra), (None, None, None, *([None] * 23)), ((1 << 63) - 1, "x", "s", *extra), (-(1 << 63), "x y", "s", *extra)]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {MORE}").repartition(3).cache()


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(d, int(d == 10), "x") for d in range(12)] + [(None, 1, None), (3, None, None), (77, 1, "")], "doc_id long, toxic int, text string")
    bench = spark.createDataFrame([(1, "one two three four", 1), (2, None, 2), (None, "fine fine fine", 3), (3, "", 4), (1, "one two three four", 5), (4, LONG[:3000], 6)], "item_id long, text string, doc_id int")
    return labels, bench


def same_rows(found, docs):
    assert found.columns == docs.columns
    assert found.schema.simpleString() == docs.schema.simpleString()
    return found.collect()


def key(rows):
    return sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in rows))


def test_mixing(docs):
    found = mixing.mix(docs)
    assert found.columns[-4:] == ["size", "source_size", "target", "repeats"]
    rows = found.collect()
    assert key(rows) == key(docs.collect()) and all(r["whole"] in (7, None) for r in rows)
    assert mixing.sample(docs).columns[-1] == "copy"
    assert mixing.mix(docs.limit(0)).collect() == []


def test_jaccard(docs):
    found = jaccard.jaccard_components(docs).collect()
    assert len(found) == docs.count()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in found}
    assert by[6, 2] == by[5, 2] == 5 and by[None, 2] == 5 and by[0, 0] == 0 and by[3, 0] == 3
    kept = same_rows(jaccard.keep_one(docs), docs)
    assert [r.doc_id for r in kept if r.text == TEXTS[5]] == [5]
    assert len([r for r in kept if r.text is None]) == 2 and len([r for r in kept if r.text == "x"]) == 1
    assert jaccard.keep_one(docs.limit(0)).collect() == []


def test_suffix(docs):
    found = suffix.repeated_bytes(docs).collect()
    assert sorted(r.n_bytes for r in found) == sorted(len((r.text or "").encode()) for r in docs.collect())
    kept = same_rows(suffix.remove_repeats(docs), docs)
    assert len(kept) == docs.count() and sum(r.text is None for r in kept) == 2
    assert suffix.remove_repeats(docs.limit(0)).collect() == []


def test_decontamination(docs, tables):
    found = decontaminate.matches(docs, tables[1])
    assert {(r.doc_id, r.item_id) for r in found.collect()} >= {(5, 1), (6, 1), (None, 1), (11, None), (4, 4)}
    kept = same_rows(decontaminate.keep_clean(docs, tables[1]), docs)
    assert sorted(r.text for r in kept if r.doc_id == 5) == ["another text of that id"] and not [r for r in kept if r.text == TEXTS[5]]
    assert len(decontaminate.keep_clean(docs, tables[1].limit(0)).collect()) == docs.count()


def test_toxicity(docs, tables):
    found = toxicity.classify(docs, tables[0])
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == docs.count()
    same_rows(toxicity.keep_clean(docs, tables[0]), docs)
    for none in (tables[0].limit(0), tables[0].where("toxic = 1"), tables[0].where("toxic is null")):
        assert key(toxicity.keep_clean(docs, none).collect()) == key(docs.collect())
    assert toxicity.classify(docs.limit(0), tables[0]).collect() == []


def test_language_model(docs):
    found = lm.score(docs).collect()
    assert len(found) == docs.count() and all(r.score < 0 and r.base_score < 0 and r.n_tokens >= 1 for r in found)
    assert lm.score(docs.limit(0)).collect() == []


def test_tokens(docs):
    import os

    if not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no vocabulary file")
    found = tokens.token_counts(docs.withColumnRenamed("n", "n_tokens"), ["doc_id", "n_tokens"], ["text"])
    assert found.columns[:2] == ["doc_id", "key_n_tokens"]
    for r in found.collect():
        assert sum(r.section_tokens) == r.n_tokens


def test_html(spark):
    pages = spark.createDataFrame([(1, LONG, "t"), (2, BLANKS, None), (3, None, ""), (None, "<p>a", "b"), (4, "<p>" * 200_000 + "x", "y")], "page_id long, html string, Title string")
    found = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert found == {1: LONG, 2: "", 3: "", None: "a", 4: "x"}


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u", LONG, "x"), (2, None, LONG, "y"), (3, "v", None, None), (None, "w", BLANKS, "z"), (4, "u", "", "")], "page_id long, url string, html string, digest string")
    found = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(pages).collect()}
    assert found == {1: (len(LONG), "response", None), 2: (len(LONG), "revisit", 1), 3: (0, "response", None), 4: (0, "revisit", 3), None: (len(BLANKS), "response", None)}


def test_embeddings(spark):
    wide = [float(k % 17 - 8) for k in range(20_000)]
    rows = [(1, wide, "a", 0), (2, [2 * x for x in wide], "a", 0), (2, [2 * x for x in wide], "a", 1), (3, wide, "b", 0), (4, wide, None, 0), (5, None, "a", 0), (6, [], "a", 0), (7, [0.0], "a", 0), (8, [float("nan")], "a", 0), (None, wide, "a", 0), (9, [None, 1.0], "a", 0), (10, [1.0], "a", 0)]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, n_links int")).collect()}
    assert found[1] == (1, 1, True) and found[2] == (1, 1, False) and found[None] == (0, None, True)
    assert all(found[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10))


def test_stages(spark, docs, tables, tmp_path):
    tables[0].write.parquet(f"{tmp_path}/labels.parquet")
    tables[1].write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
        stage(spark, left, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mixing":
            assert left.columns == docs.columns
