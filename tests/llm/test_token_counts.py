import random

import pytest

import burstgraph.llm.token_counts as T


@pytest.fixture(scope="module")
def counter():
    with open(T.VOCABULARY, "rb") as file:
        return T.Counter(file.read())


def test_edits_against_encoding_anew(counter):
    rng, letters = random.Random(3), "ab '  \n1.,é's\tt漢"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        tree = T.TokenTree(text, counter)
        assert tree.tokens == len(counter.encoding.encode_ordinary(text))
        for _ in range(6):
            start = rng.randint(0, len(text))
            stop = rng.randint(start, min(len(text), start + 8))
            new = "".join(rng.choice(letters) for _ in range(rng.randint(0, 5)))
            tree.edit(start, stop, new)
            text = text[:start] + new + text[stop:]
            assert tree.text() == text
            assert tree.tokens == len(counter.encoding.encode_ordinary(text))


def test_an_edit_encodes_little_of_a_long_text(counter):
    text = "some words of a long text " * 4000
    tree = T.TokenTree(text, counter)
    tree.edit(50_000, 50_003, "NEW")
    assert tree.encoded < 200
    assert tree.tokens == len(counter.encoding.encode_ordinary(text[:50_000] + "NEW" + text[50_003:]))


def test_documents(documents, counter):
    rows = [(1, "write to a.b@example.org or 10.0.0.1 now"), (2, "call +1 (555) 123-45678"), (3, None), (4, ""), (None, "x@y.zz"), (1, "plain"), (5, "a" * 50_000), (6, "<|endoftext|>")]
    found = T.edited_counts(documents(rows)).collect()
    by_text = {r.doc_id: r for r in found if r.edited}
    assert by_text[1].edited == "write to [EMAIL] or [IP] now" and by_text[1].n_edits == 2
    assert by_text[2].edited == "call [NUMBER]" and by_text[None].edited == "[EMAIL]"
    for r in found:
        if r.edited is not None:
            assert r.n_tokens_edited == len(counter.encoding.encode_ordinary(r.edited))
    whole = {(r.doc_id, r.n_tokens) for r in found}
    assert {(i, len(counter.encoding.encode_ordinary(t or ""))) for i, t in rows} == whole
    assert T.edited_counts(documents([])).collect() == []


def test_the_table(spark, counter):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in T.edited_counts(docs).collect():
        text = texts[r.doc_id]
        assert r.n_tokens == len(counter.encoding.encode_ordinary(text))
        for start, stop, new in T.redactions(text):
            text = text[:start] + new + text[stop:]
        assert r.n_tokens_edited == len(counter.encoding.encode_ordinary(text))


def test_stored_trees_are_edited_again(documents, counter):
    """A tree comes back from its leaves without cutting or encoding, and an edited one is edited again."""
    from pyspark.sql import functions as F

    text = "first words, then a.b@example.org, then the last words é漢"
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "no edit here")]
    trees = T.token_trees(documents(rows), rules=()).drop("edits")
    one = F.expr("CASE WHEN doc_id = 1 THEN array(named_struct('start', 6L, 'stop', 11L, 'new', 'things')) WHEN doc_id = 3 THEN array(named_struct('start', 0L, 'stop', 0L, 'new', 'new text')) END")
    first = T.edit_trees(trees.withColumn("edits", one))
    again = first.select("doc_id", F.col("n_tokens_edited").alias("n_tokens"), "leaves", F.col("edited").alias("text"))
    two = F.expr("CASE WHEN doc_id = 1 THEN array(named_struct('start', 0L, 'stop', 5L, 'new', 'No')) END")
    found = {r.doc_id: r for r in T.edit_trees(again.withColumn("edits", two)).collect()}
    assert found[1].edited == text.replace("first words", "No things") and found[3].edited is None
    assert found[1].n_tokens_edited == len(counter.encoding.encode_ordinary(found[1].edited))
    assert 0 < found[1].n_chars_encoded < 40
    assert found[3].n_tokens == len(counter.encoding.encode_ordinary("new text")) and found[2].n_tokens_edited == 0
    tree = T.TokenTree(found[1].edited, counter, bytes(found[1].leaves))
    assert tree.text() == found[1].edited and tree.tokens == found[1].n_tokens_edited


def test_an_edit_reads_a_bounded_number_of_leaves(counter):
    class Watched(list):
        read = 0

        def __getitem__(self, key):
            Watched.read += len(range(*key.indices(len(self)))) if isinstance(key, slice) else 1
            return list.__getitem__(self, key)

    tree = T.TokenTree("some words of a long text " * 20_000, counter)
    tree.leaves = Watched(tree.leaves)
    for at in (100, 250_000, 500_000):
        tree.edit(at, at + 3, "NEW")
    assert Watched.read < 300
