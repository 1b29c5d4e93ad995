import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import burstgraph.llm.suffix_dedup as S
from burstgraph.llm import common


def brute(rows):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - S.WINDOW + 1):
            if i is not None:
                w = b[k : k + S.WINDOW]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, b in texts:
        cut = bytearray(len(b))
        for k in range(len(b) - S.WINDOW + 1):
            if i is not None and first[b[k : k + S.WINDOW]] < i:
                cut[k : k + S.WINDOW] = b"\1" * S.WINDOW
        kept = bytes(c for c, f in zip(b, cut, strict=True) if not f)
        spans = sum(1 for k in range(len(cut)) if cut[k] and (k == 0 or not cut[k - 1]))
        out.append((i, len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng, rows = random.Random(5), []

    def text(n):
        return "".join(rng.choice("abcé ñü\n") for _ in range(n))

    passage, other = text(70), text(55)
    for k in range(12):
        rows.append((k, text(rng.randrange(0, 90)) + passage + text(rng.randrange(0, 60)) + (other if k % 3 else "") + text(20)))
    rows += [(20, "x" * 400), (21, "x" * 130 + "y"), (22, "ab" * 90), (23, "ba" * 40), (24, passage[:50]), (25, passage.encode()[1:51].decode(errors="ignore"))]
    rows += [(30, None), (31, ""), (32, "short"), (33, rows[2][1]), (2, rows[2][1]), (34, "short"), (None, rows[3][1]), (None, None)]
    rows += [(4, "again " + rows[5][1]), (35, rows[6][1] + rows[7][1]), (-3, rows[8][1][10:])]
    return rows


@pytest.mark.parametrize("hot", [100_000, 1])
def test_against_all_windows(documents, hot, monkeypatch):
    monkeypatch.setattr(S, "HOT_ROWS", hot)
    rows = corpus()
    found = S.suffix_dedup(documents(rows)).drop("node", "kept").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_cut_documents(documents):
    rows = corpus()
    docs = documents(rows).drop("node")
    found = S.cut_documents(docs)
    assert found.columns == docs.columns
    want = {(i, n, c): h for i, n, c, _, h in brute(rows)}
    kept = [r for r in found.collect() if r.doc_id is not None and r.text is not None]
    by_id = {}
    for (i, n, c), h in want.items():
        by_id.setdefault(i, set()).add(h)
    for r in kept:
        broken = hashlib.sha256(r.text.encode()).hexdigest() not in by_id[r.doc_id]
        assert not broken or r.doc_id == 25 or "é" in r.text or "ñ" in r.text or "ü" in r.text  # bytes that were no UTF-8 any more
        assert r.n_chars == len(r.text)
    assert {33, 24} & {r.doc_id for r in kept} == set()  # nothing left of copies


def test_empty(documents):
    assert S.suffix_dedup(documents([])).collect() == []


def test_refine_numbers_equal_windows():
    texts = [b"a" * 60, b"a" * 55 + b"b" * 6, bytes(range(70)), b"a" * 50]
    whose, number = S.refine(texts)
    windows = [t[k : k + S.WINDOW] for t in texts for k in range(len(t) - S.WINDOW + 1)]
    assert len(number) == len(windows) and len(set(number.tolist())) == len(set(windows))
    assert all((windows[a] == windows[b]) == (number[a] == number[b]) for a in range(len(windows)) for b in range(a))


def test_token_ranges_are_of_one_size(documents, words, monkeypatch):
    rng, sent, whole = random.Random(8), [], S.repeated
    monkeypatch.setattr(S, "repeated", lambda forward: sent.append(forward) or whole(forward))
    rows = [(k, " ".join(words(rng, 400))) for k in range(60)]
    assert len(S._keys(documents([*rows, (60, rows[0][1] + "!")]), 32).collect()) == 2
    sizes = [r[0] for r in sent[0].where("kind = 0").groupBy("part").agg(F.sum(F.length("data"))).select(F.col("sum(length(data))")).collect()]
    assert len(sizes) == 32 and max(sizes) < 2 * sum(sizes) / 32


def test_window_keys_take_little_memory():
    data = np.random.default_rng(2).integers(0, 256, common.CHUNK, dtype=np.uint8)
    common.powers(len(data) + 1)
    tracemalloc.start()
    found = S.window_keys(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(data)
    some = data[:300]
    at = np.arange(len(some) - S.KEY + 1)
    grams = common.span_hashes(common.prefix_sums(some), at, at + S.KEY)
    lowest = np.lib.stride_tricks.sliding_window_view(grams, S.WINDOW - S.KEY + 1).min(axis=1)
    assert (S.window_keys(some) == common.mix(lowest)).all()
    assert (found[: len(lowest)] == common.mix(lowest)).all() and len(found) == len(data) - S.WINDOW + 1
    assert all(len(common.fixed_hashes(common.prefix_sums(data[:n]), 24)) == max(0, n - 23) for n in (0, 1, 23, 24, 25))
