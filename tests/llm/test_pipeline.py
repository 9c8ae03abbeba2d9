import os
import random

import pytest

import corpus_pipeline
from tessera.llm import queries
from tessera.llm._graph import components


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "suffix_dedup", "decontamination", "mixing"]


def tables(spark, folder):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefghijk", k=rnd.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage = text(35), text(60)
    docs = {d: text(rnd.randint(40, 90)) for d in range(150)}
    plants = {200: docs[3], 201: docs[4] + " tail", 202: text(20) + "\n" + passage, 203: text(25) + "\n" + passage, 204: text(30) + " " + item.upper() + " " + text(10), 205: text(40) + " scoundrel villain scoundrel"}
    labels = [(d, 0) for d in range(100)]
    for d in range(300, 420):
        docs[d] = text(30) + " scoundrel villain"
        labels.append((d, 1))
    rows = [(d, t, "en", f"s{d % 4}", len(t)) for d, t in (docs | plants).items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, t) for d, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs | plants, passage


def test_every_stage_decides_on_what_is_left(spark, tmp_path):
    texts, passage = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda f: {r.doc_id for r in f.select("doc_id").collect()}
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(ids(docs))
        if name != "mixing":
            assert docs.columns == columns
        if name == "suffix_dedup":
            left = {r.doc_id: r.text for r in docs.collect()}
    clean = set(range(150)) | set(range(200, 205))
    assert seen[0] == clean
    assert seen[1] == clean - {200, 201}
    assert seen[2] == seen[1] and passage in left[202] and passage[:50] not in left[203] and left[7] == texts[7]
    assert seen[3] == seen[1] - {204}
    assert seen[4] <= seen[3] and docs.where("copy > 3").count() == 0
    total = sum(len(t.split()) for d, t in left.items() if d in seen[3])
    assert abs(sum(len(r.text.split()) for r in docs.collect()) - total) < 0.1 * total
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_components(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, x) for x in range(1001, 1100)] + [(rnd.randint(2000, 2100), rnd.randint(2000, 2100)) for _ in range(80)] + [(7, 7), (3, 2), (2, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == want and len(found) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_all_ten_are_registered():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)} and set(queries.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = queries.queries()[name](spark, folder)
    want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
