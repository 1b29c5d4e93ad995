import random

import numpy as np
import pytest

import burstgraph.llm.decontamination as D


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (D.MATCH if a[i] == b[j] else D.OTHER), h[i, j + 1] + D.GAP, h[i + 1, j] + D.GAP)
    return int(h.max())


def test_alignment_against_the_full_table():
    rng = np.random.default_rng(4)
    for _ in range(100):
        item = rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64)
        passages = rng.integers(0, 5, (4, rng.integers(1, 25))).astype(np.uint64)
        scores, first, last = D.align(item, passages)
        for k in range(4):
            assert scores[k] == smith_waterman(item, passages[k])
            if scores[k]:
                assert smith_waterman(item, passages[k, first[k] : last[k] + 1]) == scores[k]


def test_copies_and_edits_are_found(spark, documents, words):
    rng = random.Random(3)
    items = [(k, " ".join(words(rng, 30))) for k in range(20)] + [(90, "too short"), (91, None), (None, "an item without a name here")]
    benchmark = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    rows, want = [], set()
    for k in range(20):
        item = items[k][1].split()
        edited = [w for n, w in enumerate(item) if n % 10 != 4]  # words missing
        edited[7] = "other"
        for text in (item, [w.upper() for w in item], edited, edited[:15] + ["put", "in"] + edited[15:]):
            rows.append((len(rows), " ".join([*words(rng, 50), *text, *words(rng, 50)])))
            want.add((rows[-1][0], k))
        rows.append((len(rows), " ".join(words(rng, 100))))
        rows.append((len(rows), " ".join(words(rng, 40) + item[:8] + words(rng, 40))))  # eight words of thirty are no copy
    rows += [(900, None), (901, ""), (902, "too short"), (None, items[0][1]), (5000, items[1][1]), (5000, items[1][1])]
    want |= {(None, 0), (5000, 1)}
    found = D.benchmark_matches(documents(rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert sum(r.doc_id == 5000 for r in found) == 2
    verbatim = [r for r in found if r.doc_id == 0]
    assert [(r.score, r.first_word, r.last_word) for r in verbatim] == [(1.0, 50, 79)]


def test_an_item_in_most_documents_keeps_seeds(spark, documents, words):
    rng = random.Random(8)
    item = " ".join(words(rng, 25))
    benchmark = spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING")
    rows = [(k, " ".join(words(rng, 5)) + " " + item) for k in range(40)]
    assert D.benchmark_matches(documents(rows), benchmark).count() == 40


def test_blocks_and_empty_tables(spark, documents, monkeypatch):
    items = [(k, f"alpha{k} beta{k} gamma{k} delta{k}") for k in range(6)]
    benchmark = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    docs = documents([(k, t) for k, t in items])
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)
    assert sorted((r.doc_id, r.item_id) for r in D.benchmark_matches(docs, benchmark).collect()) == [(k, k) for k in range(6)]
    assert D.benchmark_matches(documents([]), benchmark).collect() == []
    assert D.benchmark_matches(docs, benchmark.limit(0)).collect() == []


@pytest.mark.parametrize("common", [32, 0])
def test_hot_edited_copies_against_full_alignment(spark, documents, words, monkeypatch, common):
    monkeypatch.setattr(D, "COMMON", common)
    rng = random.Random(12)
    items = [(k, " ".join(words(rng, n, 300))) for k, n in enumerate((3, 10, 10, 12, 15, 15, 20, 30, 40))]
    benchmark = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    texts = ["a b", "a"]
    for _, text in items:
        item = text.split()
        variants = [[f"x{n}" if n % every == every - 1 else w for n, w in enumerate(item)] for every in (3, 4)]  # words replaced
        variants += [[w for n, w in enumerate(item) if n % every != 1] for every in (3, 4)]  # words missing
        variants += [[x for n, w in enumerate(item) for x in ((w, f"y{n}") if n % every == 0 else (w,))] for every in (1, 2)]  # words put in
        for _ in range(10):
            gone = rng.sample(range(len(item)), len(item) // 3)
            variants.append([f"z{n}" if n in gone else w for n, w in enumerate(item)])
        for v in variants:
            texts.append(" ".join([*words(rng, 20, 300), *v, *words(rng, 20, 300)]))
    rows = [(k, t) for k, t in enumerate(texts * 3)]  # every edited copy stands in several documents
    want = set()
    for k, t in rows:
        for i, text in items:
            (item, doc) = (D.words_of([x.encode()])[2] for x in (text, t))
            score = int(D.align(item, doc[None])[0][0])
            if score >= len(item):
                want.add((k, i, score / (2 * len(item))))
    found = D.benchmark_matches(documents(rows), benchmark).collect()
    assert len(want) > 300 and {(r.doc_id, r.item_id, r.score) for r in found} == want and len(found) == len(want)
