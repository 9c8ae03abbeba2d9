import random

from tessera.llm import decontaminate as d


def brute(item, text, budget):
    """Least edit distance of item to any substring, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row) if min(row) <= budget else None


def edited(rnd, text, n):
    text = list(text)
    for _ in range(n):
        k = rnd.randrange(len(text))
        text[k : k + 1] = rnd.choice([[], ["q"], [text[k], "z"]])
    return "".join(text)


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 6)))
    items = [(k, " ".join(word() for _ in range(rnd.choice([2, 8, 30])))) for k in range(15)] + [(20, ""), (21, None), (22, "  \n"), (23, "Ab Cd")]
    docs = []
    for k in range(60):
        body = [word() for _ in range(40)]
        item = rnd.choice(items[:15])[1]
        body.insert(rnd.randrange(40), edited(rnd, item, rnd.randint(0, 1 + len(item) // 8)).upper().replace(" ", " \n"))
        docs.append((k, " ".join(body)))
    docs += [(90, None), (91, ""), (92, items[5][1]), (92, items[5][1])]
    found = d.matches(spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, distance int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for i, t in docs:
        for k, item in items:
            item = d.normalise(item or "")
            best = brute(item, d.normalise(t or ""), len(item) // 10) if item and t else None
            if best is not None:
                want.append((i, k, best))
    assert sorted((r.doc_id, r.item_id, r.distance) for r in found) == sorted(want)
    texts, by_id = dict(docs), dict(items)
    for r in found:  # a blank at either end of the passage may get lost here
        assert brute(d.normalise(by_id[r.item_id]), d.normalise(texts[r.doc_id][r.start : r.stop]), r.distance + 2) is not None


def test_blocks_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three"), (2, "four five six"), (3, "seven")], "item_id long, text string")
    monkeypatch.setattr(d, "BLOCK_CHARS", 10)
    assert sorted((r.doc_id, r.item_id) for r in d.matches(docs, items).collect()) == [(1, 1), (2, 2)]
    assert d.matches(docs, items.limit(0)).collect() == []
    assert d.matches(docs.limit(0), items).collect() == []
    assert d.keep_clean(docs, items.where("item_id = 1")).collect() == [(2, "four five six")]
