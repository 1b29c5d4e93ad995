"""Windows of words against brute force over the whole texts."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstgraph.llm.queries import QUERIES
from burstgraph.llm.window_dedup import blocks, cut_windows, intervals, rolling, word_hashes

SCHEMA = "doc_id BIGINT, text STRING"


def brute(rows, size=13):
    """One (doc_id, n_words, n_removed, kept) per row."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - size + 1) if i is not None else ():
            key = tuple(words[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - size + 1) if i is not None else ():
            if first[tuple(words[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
        out.append((i, len(words), len(gone), kept))
    return sorted(out, key=str)


def found(spark, rows, schema=SCHEMA, **kw):
    result = cut_windows(spark.createDataFrame(rows, schema), **kw)
    return sorted(map(tuple, result.drop("spans").collect()), key=str)


@pytest.mark.parametrize("least", [1, 40, 1_000_000])
def test_random_texts_with_shared_passages(spark, least):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    passages = [" ".join(rng.choice(words, n)) for n in (13, 14, 30, 60)]
    rows = []
    for i in range(80):
        parts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(3)]
        if i % 3:
            parts.insert(1, passages[rng.integers(len(passages))])
        rows.append((int(rng.permutation(1000)[0]) - 500, rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    rows += rows[:5] + [(7, rows[3][1]), (7, rows[4][1])]
    assert found(spark, rows, least=least, cell=1) == brute(rows)


def test_small_windows_and_overlaps(spark):
    rows = [(1, "a b a b a b a"), (2, "x a b a b y b a b"), (3, "a b a"), (0, "b a b"), (5, "a b a b a b a")]
    assert found(spark, rows, size=3, least=4, cell=1) == brute(rows, 3)


def test_nulls_repeats_and_short_texts(spark):
    long = " ".join(map(str, range(40)))
    rows = [(None, long), (4, long), (2, long), (2, long), (2, long + " x"), (9, None), (8, ""), (3, "a b"), (5, "a b"), (None, None), (6, " \n")]
    assert found(spark, rows) == brute(rows)
    assert dict((i, n) for i, _, n, _ in found(spark, rows) if i == 4) == {4: 40}


def test_other_spaces_are_parts_of_words(spark):
    text = " ".join(f"a {k}" for k in range(20)) + " end"
    rows = [(1, text), (2, text.replace(" ", "\r\n"))]
    assert found(spark, rows) == brute(rows)


def test_clashing_columns_and_empty_tables(spark):
    rows = [(1, "a b c d", 1, b"", 2, 3), (2, "x a b c y", 4, b"", 5, 6)]
    docs = spark.createDataFrame(rows, SCHEMA + ", text_key INT, windows BINARY, id INT, n_words INT")
    assert [tuple(r) for r in cut_windows(docs, size=3).orderBy("doc_id").select("doc_id", "n_removed", "kept").collect()] == [(1, 0, "a b c d"), (2, 3, "x y")]
    empty = cut_windows(docs.where("doc_id < 0"))
    assert empty.columns == ["doc_id", "n_words", "n_removed", "spans", "kept"] and empty.isEmpty()


def test_long_text_is_hashed_in_blocks():
    text = b" ".join(b"%d" % (k % 997) for k in range(50_000))
    assert b"".join(blocks(text, 1000)) == text and len(list(blocks(text, 1000))) > 100
    one = np.concatenate([word_hashes(b) for b in blocks(text, 1000)])
    assert (one == word_hashes(text)).all()
    hashes = rolling(one, 13)
    assert len(hashes) == 50_000 - 12 and len(np.unique(hashes)) == 997
    assert not len(rolling(one[:12], 13))


def test_intervals_are_maximal():
    assert intervals(np.array([0, 2, 6, 20]), 4, 30) == [(0, 9), (20, 23)]
    assert intervals(np.array([3, 7]), 4, 30) == [(3, 10)]
    assert intervals(np.array([], dtype=int), 4, 30) == []


def test_hot_passage_sends_one_entry_per_flush(spark):
    """A passage that stands in all texts: entries travel once per flush, and all words of it but the first go."""
    from burstgraph.llm.window_dedup import meet, send

    passage = " ".join(f"p{k}" for k in range(13))
    docs = spark.range(0, 4000, 1, 4).selectExpr("id AS doc_id", f"concat(id, ' ', '{passage}', ' z', id) AS text", "id AS text_key")
    cells = send(docs, 1, 10**9, 13).where("kind = 0")
    assert cells.count() == 4
    removed = cut_windows(docs.select("doc_id", "text")).agg(F.sum("n_removed")).first()[0]
    assert removed == 13 * 3999


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op11_window_dedup"](spark, sf_dir).collect()}
    assert got == want and any(gone for _, gone, _ in want.values())
