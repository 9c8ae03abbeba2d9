import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import lm
from tessera.llm._text import word_hashes, utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(fold), None]


def test_scores(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(400)]
    rows = [(d, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60)))) for d in range(60)]
    rows += [(100, None), (101, ""), (102, "\tÉ A a\n"), (7, rows[7][1]), (None, "w1 w1")]
    frame = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    found = lm.score(frame).collect()
    count = collections.Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), held(d), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(r.score < 0 for r in found)


def test_probabilities_of_all_words_sum_to_one():
    counts = np.array(sorted((int(5000 / k) for k in range(1, 5001)), reverse=True))
    words = np.arange(10, 5010, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    vocabulary = lm.Vocabulary(words, counts, int(counts.sum()), len(counts), 100)
    p = lm.initial(vocabulary)
    trainer = lm.Trainer(p, vocabulary.unigram, 1)
    rng = np.random.default_rng(0)
    for _ in range(5):
        trainer.learn(rng.integers(0, lm.TARGETS + 2, 500), rng.integers(0, lm.CONTEXTS, 500), rng.integers(0, lm.CONTEXTS, 500))
    model = lm.Model(vocabulary, trainer.p)
    every = np.arange(lm.TARGETS + 2)
    for h1, h2 in ((0, 3), (lm._START, lm._START), (lm._NONE, 17)):
        p = 10 ** model.log10(every, np.full(len(every), h1), np.full(len(every), h2))
        assert abs(p.sum() - 1) < 1e-4
        rare = 10 ** lm.smoothed(counts[lm.TARGETS :], vocabulary.other_tokens, vocabulary.other_words)
        unseen = 10 ** lm.smoothed(np.array([0]), vocabulary.other_tokens, vocabulary.other_words)
        assert abs(rare.sum() + unseen.sum() - 1) < 1e-9


def test_contexts_do_not_cross_texts():
    words = np.array([1, 2, 3], dtype=np.uint64)
    vocabulary = lm.Vocabulary(words, np.array([9, 5, 2]), 16, 3, 2)
    target, h1, h2, *_, text = lm.sequences(np.array([1, 2, 3], dtype=np.uint64), np.array([0, 2, 2, 3]), vocabulary)
    assert target.tolist() == [0, 1, lm._END, lm._END, 2, lm._END]
    assert h1.tolist() == [lm._START, 0, 1, lm._START, lm._START, 2]
    assert h2.tolist() == [lm._START, lm._START, 0, lm._START, lm._START, lm._START]
    assert text.tolist() == [0, 0, 0, 1, 2, 2]


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_word_hashes_fold_case():
    a, _ = word_hashes(*utf8(pa.array(["The cat", "THE  CAT"])))
    assert a[0] == a[2] and a[1] == a[3] and a[0] != a[1]


def test_vocabularies_grow_with_the_training_counts():
    n = 9000
    hashes = np.arange(1, n + 1, dtype=np.uint64)
    vocabulary = lm.Vocabulary(hashes, np.full(n, 5), 5 * n, n, 3)
    target, h1, *_ = lm.sequences(hashes, np.array([0, n]), vocabulary)
    assert len(set(target.tolist())) == n + 1 and lm._OTHER not in target
    assert len(set(h1.tolist())) == n + 1 and lm._NONE not in h1
    trainer = lm.Trainer(lm.initial(vocabulary), vocabulary.unigram, 1)
    trainer.learn(target, h1, h1)
    model = lm.Model(vocabulary, trainer.p)
    every = np.arange(n + 2)
    for c in (3, 5000):
        assert abs((10 ** model.log10(every, np.full(n + 2, c), np.full(n + 2, 7000))).sum() - 1) < 1e-4


def test_rare_words_share_hashed_contexts():
    vocabulary = lm.Vocabulary(np.array([1], dtype=np.uint64), np.array([9]), 9, 1, 1)
    h1 = lm.sequences(np.array([50, 51], dtype=np.uint64), np.array([0, 2]), vocabulary)[1]
    assert lm._NONE not in h1 and len(set(h1.tolist())) == 3
    assert lm.head(1 << 40) > lm.head(1 << 30) >= lm.HEAD


def markov(n, seed=4):
    """Texts in which a word mostly tells the next one."""
    rnd = random.Random(seed)
    after = {k: [rnd.randrange(300) for _ in range(3)] for k in range(300)}
    rows = []
    for d in range(n):
        word, text = rnd.randrange(300), []
        for _ in range(rnd.randint(100, 300)):
            text.append(f"w{word}")
            word = rnd.choice(after[word]) if rnd.random() < 0.95 else rnd.randrange(300)
        rows.append((d, " ".join(text)))
    return rows


def test_the_model_beats_the_base_on_held_out_texts_whatever_the_partitions(spark):
    frame = spark.createDataFrame(markov(1500), "doc_id long, text string")
    found = {r.doc_id: r for r in lm.score(frame.repartition(1)).collect()}
    held = [r for r in found.values() if r.held_out]
    assert len(held) > 200 and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.8 * len(held)
    for r in lm.score(frame.repartition(6)).collect():
        assert abs(r.score - found[r.doc_id].score) < 1e-2 and r.base_score == found[r.doc_id].base_score


def test_replicas_of_a_group_are_averaged_before_their_rows_are_sent(spark, monkeypatch, tmp_path):
    average = lm._average

    def noted(table):
        part = table.column("part")[0].as_py()
        (tmp_path / f"{part}").write_text(str(sum(len(lm.decode(b.as_py(), lm._ROW)[0]) for b in table.column("block"))))
        return average(table)

    monkeypatch.setattr(lm, "SHARD_BYTES", 1 << 16)
    monkeypatch.setattr(lm, "_average", noted)
    texts = [t for _, t in markov(8000)]
    volume = sum(map(len, texts))
    count = collections.Counter(w for t in texts for w in t.split())
    hashes = {w: int(word_hashes(*utf8(pa.array([w])))[0][0]) for w in count}
    common = sorted(count, key=lambda w: (-count[w], w))
    vocabulary = lm.Vocabulary(np.array([hashes[w] for w in common], np.uint64), np.array([count[w] for w in common]), sum(count.values()), len(count), len(texts))
    keys = np.arange(len(texts), dtype=np.int64) * 0x1E3779B97F4A7C15
    frame = spark.createDataFrame([(t, int(k)) for t, k in zip(texts, keys, strict=True)], "text string, key long").repartition(3)
    found = lm.train(frame, vocabulary, volume)
    records = sum(int(f.read_text()) for f in tmp_path.iterdir())
    assert records * 4 * (lm.DIM + 1) <= volume

    shards = volume // lm.SHARD_BYTES + 1
    assert shards > 10
    first = lm.initial(vocabulary)
    total, times = {k: np.zeros(v.shape) for k, v in first.items()}, {k: np.zeros(len(v)) for k, v in first.items()}
    for block in lm._deal_texts(shards)([pa.record_batch({"text": pa.array(texts), "key": pa.array(keys)})]):
        trainer = lm.Trainer(first, vocabulary.unigram, block.column("part")[0].as_py())
        for data, offsets in lm._shard_texts(block.column("block")):
            target, h1, h2, *_ = lm.sequences(*word_hashes(data, offsets), vocabulary)
            for a in range(0, len(target), lm.BATCH):
                trainer.learn(target[a : a + lm.BATCH], h1[a : a + lm.BATCH], h2[a : a + lm.BATCH])
        for k, v in trainer.p.items():
            n = trainer.times.get(k, np.full(len(v), trainer.seen))
            total[k] += n[:, None] * v
            times[k] += n
    for k, v in first.items():
        want = np.where(times[k][:, None] > 0, total[k] / np.maximum(times[k], 1)[:, None], v)
        assert np.abs(found[k] - want).max() < 1e-4
