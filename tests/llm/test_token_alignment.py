"""Alignment against the two libraries on whole texts, pair by pair."""

import hashlib
import random
from collections import Counter

import pytest

from burstgraph.llm.queries import QUERIES
from burstgraph.llm.token_alignment import MODEL_A, MODEL_B, Tokenizers, align, aligned_groups, pair_counts, token_alignment

SCHEMA = "doc_id BIGINT, text STRING"


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(MODEL_A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=MODEL_B)


@pytest.fixture(scope="module")
def both():
    with open(MODEL_A, "rb") as a, open(MODEL_B, "rb") as b:
        return Tokenizers(a.read(), b.read())


def groups_of(text, libraries, both):
    """[(A ids, B ids)] of a text by the libraries; none where the bytes differ."""
    if not text:
        return []
    a, b = libraries
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    out, i, j = [], 0, 0
    bytes_a, bytes_b = [both.bytes_a[k] for k in ids_a], [both.bytes_b[k] for k in ids_b]
    if not b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
        return []
    while i < len(ids_a):
        m, n = i + 1, j + 1
        x, y = len(bytes_a[i]), len(bytes_b[j])
        while x != y:
            if x < y:
                x += len(bytes_a[m])
                m += 1
            else:
                y += len(bytes_b[n])
                n += 1
        out.append((ids_a[i:m], ids_b[j:n]))
        i, j = m, n
    return out


def brute(rows, libraries, both):
    found = {t: groups_of(t, libraries, both) for _, t in rows}
    counts = Counter()
    for _, t in rows:
        counts.update({(a, b) for g in found[t] for a in g[0] for b in g[1]})
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for i, t in rows:
        groups = found[t]
        links = [(a, b) for g in groups for a in g[0] for b in g[1]]
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(line.encode()).hexdigest() if groups else ""
        sums = [sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links)]
        out.append((i, *sums, sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=str), counts, best


TRICKY = [
    "plain words here", " leading", "trailing ", "  two  spaces   three", "tab\tand\nnew\r\n lines \n\n  x", "\n", " ", "   ", "a\x0b\x0c b\x1c c\x85d e f\xa0 g",
    "<|endoftext|> inside <s> and </s> <unk> <0x41>", "it's we'll I'd don't 'S", "123 4567 ½ ² Ⅳ", "日本語のテキスト これ は", "🙂🙃 é ‍﻿", "x" * 500 + " " + "ab" * 300,
    "under▁score ▁", "ﬁ ① ™ Å", "\0nul \x00", "a" * 3000, "!?" * 200 + "\xa0", "end \xa0", "end\xa0", "end \n", "mixed…—“quotes”", "Ünïcödé straße ÉTION",
]


@pytest.mark.parametrize("words", [1, 30, 10_000])
def test_tricky_texts(spark, libraries, both, words):
    rows = list(enumerate([*TRICKY, *TRICKY[:4], None, "", None]))
    rows += [(3, "plain words here"), (None, "plain words here"), (None, None)]
    want, _, _ = brute(rows, libraries, both)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, token_alignment(docs, flush_words=words).collect()), key=str) == want
    assert next(r for r in want if r[0] == TRICKY.index("under▁score ▁"))[1:] == (0, 0, 0, 0, 0, 0, "")


def test_units_are_encoded_as_in_the_whole_text(libraries, both):
    """Random texts of awkward characters: every group of every text, by unit, is the libraries' own."""
    from burstgraph.llm.token_alignment import _UNIT

    rng = random.Random(11)
    chars = list("abcdeABCéß.,!?'\"-0123日本🙂²") + [" "] * 14 + list("\n\t\r\x0b\x1c\x85\xa0 　") + ["the ", "'s", " and", "  ", "ing"]
    for _ in range(1500):
        text = "".join(rng.choice(chars) for _ in range(rng.randrange(1, 40)))
        units = _UNIT.findall(" " + text)
        assert "".join(units) == " " + text
        found = align(units, both)
        if found.good.all():
            line = ";".join(found.groups)
            assert line == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups_of(text, libraries, both)), repr(text)
        else:
            assert groups_of(text, libraries, both) == [], repr(text)


def test_pair_counts_and_groups(spark, libraries, both):
    rng = random.Random(2)
    words = ["strange", "words", "encyclopaedia", "été", "naïveté", "xylophonic", "2024", "foo_bar"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for k in range(60)] + [(100 + k, "the same text") for k in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want, counts, best = brute(rows, libraries, both)
    assert sorted(map(tuple, token_alignment(docs, flush_words=40).collect()), key=str) == want
    assert {(r.a, r.b): (r.documents, r.best) for r in pair_counts(docs, flush_words=40).collect()} == {x: (n, n == best[x[0]]) for x, n in counts.items()}
    found = {r.doc_id: r.groups for r in aligned_groups(docs, flush_words=40).collect()}
    assert all(hashlib.sha256(found[r[0]].encode()).hexdigest() == r[-1] for r in want)


def test_large_groups_are_counted_by_distinct_ids(both, monkeypatch):
    from burstgraph.llm import token_alignment as module

    units = [" wonderfully", " 日本語🙂", " encyclopaedia été"]
    plain = align(units, both)
    monkeypatch.setattr(module, "BIG_GROUP", 1)
    by_ids = align(units, both)
    assert (plain.pair == by_ids.pair).all() and (plain.links == by_ids.links).all() and (plain.unit == by_ids.unit).all()


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", b"k", 3, "g")], SCHEMA + ", text_key BINARY, n_a INT, groups STRING")
    assert token_alignment(docs).first().n_a == 2
    assert token_alignment(docs.where("doc_id < 0")).isEmpty() and pair_counts(docs.where("doc_id < 0")).isEmpty()


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT 2L, 'fine'")
    found = {r.doc_id: r.n_a for r in token_alignment(docs).collect()}
    assert found == {1: 0, 2: 1}


def test_whole_table(spark, libraries, both):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_token_alignment"](spark, folder).collect()), key=str) == brute(rows, libraries, both)[0]
