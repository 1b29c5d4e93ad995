import random
import zlib

import numpy as np

import burstgraph.llm.language_id as L
from burstgraph.llm.vocabulary import SPACE, load


def all_segmentations(word, p, table):
    ways = [1.0] + [0.0] * len(word)
    index = {table.pieces[i]: i for i in table.ids.tolist()}
    for j in range(1, len(word) + 1):
        ways[j] = ways[j - 1] * p[table.bytes_at[word[j - 1]]]
        for i in range(j):
            if word[i:j] in index:
                ways[j] += ways[i] * p[index[word[i:j]]]
    return ways[-1]


def test_sums_over_all_segmentations():
    table = load()
    rng = np.random.default_rng(3)
    p = rng.random((len(table.pieces), 2))
    p /= p.sum(axis=0)
    words = [SPACE + w.encode() for w in ("the", "hello", "ünïcode", "漢字")]
    found = L._log_sums(words, table, p)
    for w, row in zip(words, found, strict=True):
        assert np.allclose(row, [np.log(all_segmentations(w, p[:, k], table)) for k in range(2)])


def test_learning_raises_the_likelihood():
    table = load()
    counts = {SPACE + w.encode(): n for w, n in (("the", 9), ("then", 4), ("other", 3), ("hand", 2))}
    likelihood = []
    for rounds in (1, 2, 4):
        p = L.learn(counts, table, rounds)
        assert np.isclose(p.sum(), 1)
        likelihood.append(sum(n * np.log(all_segmentations(w, p, table)) for w, n in counts.items()))
    assert likelihood == sorted(likelihood)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert L.told_apart(docs, 0.5).count() == docs.count()


def test_odd_rows(documents):
    rng = random.Random(2)
    text = {"aa": "sun moon star light", "bb": "soleil lune étoile lumière"}
    rows = [(k, " ".join(rng.choices(text["aa" if k % 2 else "bb"].split(), k=12))) for k in range(40)]
    langs = {k: "aa" if k % 2 else "bb" for k in range(40)} | {200: None, 103: None}
    rows += [(100, None), (101, ""), (102, "123 !?"), (None, "soleil lune"), (200, "moon star"), (1, rows[1][1]), (103, "sun " * 40000)]
    docs = documents(rows, langs)
    found = {r.doc_id: r for r in L.language_id(docs).collect()}
    assert {found[k].lang_pred for k in (100, 101, 102)} == {"und"} and found[100].score == 0
    assert (found[None].lang_pred, found[None].held_out) == ("bb", False)
    assert found[200].lang_pred == found[103].lang_pred == "aa"
    assert all(found[k].lang_pred == langs[k] for k in range(40))
    kept = L.told_apart(docs, 0.5)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert L.language_id(documents([])).collect() == []
    nothing = L.language_id(docs.where("doc_id = 200")).collect()
    assert [r.lang_pred for r in nothing] == ["und"]  # nothing to learn from


def test_numbers_that_look_like_letters_are_none(documents):
    rows = [(k, "sun moon star") for k in range(10)] + [(50, "½ ²"), (51, "Ⅳ ⑤ ㊙"), (52, "1_2 ٣"), (53, "½ sun"), (54, "漢")]
    found = {r.doc_id: r for r in L.language_id(documents(rows)).collect()}
    assert [found[k].lang_pred for k in (50, 51, 52)] == ["und"] * 3 and found[50].score == 0
    assert found[53].lang_pred == found[54].lang_pred == "en"
