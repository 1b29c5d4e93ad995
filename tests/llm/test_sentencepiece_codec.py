import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

import burstgraph.llm.sentencepiece_codec as C
from burstgraph.llm.common import text_chunks
from burstgraph.llm.queries import QUERIES
from burstgraph.llm.vocabulary import SPACE, load

TEXTS = ["", " ", "  two  spaces ", "Hello, world!", "naïve ÜBER 漢字 😀\n\ttabs\r\n", "a" * 500, "x\0y", "=" * 64, "the the the"]


def best_score(word, table, scores):
    pieces = {p: scores[i] for i, p in enumerate(table.pieces) if p and i in set(table.ids.tolist())}
    best = [0.0] + [-np.inf] * len(word)
    for j in range(1, len(word) + 1):
        best[j] = best[j - 1] + scores[table.bytes_at[word[j - 1]]]
        for i in range(max(0, j - table.longest), j):
            if word[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[word[i:j]])
    return best[-1]


def test_paths_are_the_best_of_all():
    table = load()
    scores = C.path_scores(table)
    words = ["▁the".encode(), "▁untoward".encode(), "▁ß漢x".encode(), b"\xff\xfe", SPACE * 3 + b"abc"]
    for word, ids in zip(words, C.encode_words(words, table, scores), strict=True):
        assert b"".join(table.pieces[i] for i in ids) == word
        assert np.isclose(sum(scores[i] for i in ids), best_score(word, table, scores))


def test_round_trip():
    table = load()
    rng = random.Random(6)
    texts = TEXTS + ["".join(chr(rng.choice([32, 97, 98, 233, 10, 0x4E00 + rng.randrange(99)])) for _ in range(rng.randrange(80))) for _ in range(100)]
    encode = C.Encoder(table)
    for text, ids in zip(texts, encode([t.encode() for t in texts]), strict=True):
        assert C.decode(ids, table) == text.encode()


def test_cache_bound_changes_nothing(monkeypatch):
    texts = [t.encode() for t in TEXTS]
    whole = C.Encoder(load())(texts)
    monkeypatch.setattr(C, "CACHE_WORDS", 2)
    small = C.Encoder(load())
    assert [small([t])[0] for t in texts] == whole


def test_documents_there_and_back(documents):
    rows = list(enumerate(TEXTS)) + [(50, None), (None, "no id"), (3, "twice"), (51, "the mark ▁ itself")]
    encoded = C.encode_documents(documents(rows))
    found = {(r.doc_id, r.n_pieces): r for r in encoded.collect()}
    assert all(r.round_trip == (r.doc_id != 51) and r.n_pieces == len(r.piece_ids) for r in found.values())
    back = sorted((tuple(r) for r in C.decode_documents(encoded).collect()), key=str)
    assert back == sorted(((i, (t or "").replace("▁", " ")) for i, t in rows), key=str)
    assert C.encode_documents(documents([])).collect() == []


def test_the_table(spark):
    found = C.encode_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert found and all(r.round_trip for r in found)


def test_the_query_returns_ids_that_give_the_texts_back(spark):
    folder = "/root/testdata/sf0.001"
    encoded = QUERIES["op5_sentencepiece"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "coalesce(text, '') AS text")
    assert all(r.n_pieces == len(r.piece_ids) for r in encoded.collect())
    assert sorted(map(tuple, C.decode_documents(encoded).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_words_repeat_in_a_chunk_and_texts_end_in_marks(monkeypatch):
    table, seen = load(), []
    paths = C.best_paths
    monkeypatch.setattr(C, "best_paths", lambda words, *a: seen.extend(words) or paths(words, *a))
    texts = ["a b ", " a b", "", "  ", " ", "b  ", "▁a", "a b a b", "%%% x%%%"]
    encode, texts = C.Encoder(table), [t.encode() for t in texts]
    ids, at = encode.encoded(texts)
    assert ids.dtype == np.int32 and len(seen) == len(set(seen))
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        words = re.findall("(?:▁)*[^▁]+|▁+", "▁" + text.decode().replace(" ", "▁")) if text else []
        assert set(w.encode() for w in words) <= set(seen)
        assert ids[a:b].tolist() == [i for i in paths([w.encode() for w in words], table, encode.scores)[0]]
    assert encode.round_trips(texts, ids, at) == [b"\xe2" not in t for t in texts]
    wrong = ids.copy()
    wrong[0] = table.ids[7]
    assert encode.round_trips(texts, wrong, at)[0] is False


def test_words_of_one_hash_are_told_apart(monkeypatch):
    texts = [t.encode() for t in ("one two one", "owe two", "a bb a")]
    whole = C.Encoder(load())(texts)
    monkeypatch.setattr(C, "span_hashes", lambda sums, starts, ends: np.ones(len(starts), np.uint64))
    assert C.Encoder(load())(texts) == whole


def test_chunks_take_little_memory(words):
    texts = [" ".join(words(random.Random(k), 2000)) for k in range(500)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    encode, back = C.Encoder(load()), []
    tracemalloc.start()
    for _, chunk in text_chunks(iter([batch]), chunk=C.ENCODE_CHUNK):
        back += encode.round_trips(chunk, *encode.encoded(chunk))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(back) == len(texts) and all(back) and peak < 120e6
