import collections
import math
import random
import re
import time
import zlib

import numpy as np

import burstgraph.llm.lm_scoring as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [*WORD.findall((text or "").translate(low)), None]


def check(rows, found):
    counts = collections.Counter()
    for i, text in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text in rows:
        t = tokens(text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(counts[w] > 0 for w in t), n, round(base, 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in found)


def test_counts_and_base_score(documents, words):
    rng = random.Random(1)
    rows = [(k, " ".join(words(rng, rng.randrange(0, 60), 40))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "The the THE\tthé"), (None, "the of"), (3, rows[3][1]), (3, "again the"), (103, "x" * 30000)]
    check(rows, L.lm_scores(documents(rows)).collect())


def test_held_out_text_is_told_better_than_by_the_base(spark):
    found = L.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_weights_by_expectation_maximisation():
    cells = np.array([[3, 0, -160, 900], [3, 1, -160, 100], [0, 1, -80, 10]])
    w = L.mixture_weights(cells, 1000)
    assert np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.8 and w[0, 0] == 0 and w[0, 1] > 0.9


def test_empty_and_nothing_to_learn(documents):
    assert L.lm_scores(documents([])).collect() == []
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    rows = [(held, "a b"), (None, None)]
    check(rows, L.lm_scores(documents(rows)).collect())


def test_every_training_document_gives_held_out_events(documents, words):
    rng = random.Random(7)
    rows = [(k, " ".join(words(rng, rng.randrange(1, 40), 30))) for k in range(12)]
    train = {i: tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2}
    ones, twos, befores = collections.Counter(), collections.Counter(), collections.Counter()
    of = lambda t: list(zip(["", *t[:-1]], t, strict=True))
    for t in train.values():
        ones.update(t)
        twos.update(of(t))
        befores.update(["", *t[:-1]])
    n, v = sum(ones.values()), len(ones)
    bucket = lambda c: c.bit_length()
    grid = lambda p: round(L.GRID * math.log2(p)) if p > 0 else 1
    cells = collections.Counter()
    for t in train.values():
        own, own_one, own_two = collections.Counter(["", *t[:-1]]), collections.Counter(t), collections.Counter(of(t))
        for u, w in of(t):
            c = befores[u] - own[u]
            cells[bucket(c), grid((twos[u, w] - own_two[u, w]) / c if c else 0), grid((ones[w] - own_one[w]) / (n - len(t)))] += 1
    weights = L.mixture_weights(np.array([(*k, x) for k, x in cells.items()]), v)
    for r in L.lm_scores(documents(rows)).collect():
        want = 0.0
        for u, w in of(tokens(dict(rows)[r.doc_id])):
            a, b, c = weights[bucket(befores[u])]
            want += math.log10(min(1.0, a * (twos[u, w] / befores[u] if befores[u] else 0) + b * ones[w] / n + c / (v + 1)))
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_bigrams_have_whole_hashes(documents):
    blobs = [bytes(r.data) for r in L.homes(documents([(k, f"some words of text {k}") for k in range(50)]), 1).collect()]
    assert L.Home(blobs).bigrams.max() >= 2**63


def test_cells_are_counted_as_numbers():
    rng = np.random.default_rng(3)
    columns = rng.integers(0, 65, 300_000), rng.integers(-64 * L.GRID, 2, 300_000), rng.integers(-64 * L.GRID, 2, 300_000)
    columns = [np.concatenate([c, c[:1000], [low, high]]) for c, low, high in zip(columns, (0, -64 * L.GRID, -64 * L.GRID), (64, 1, 1), strict=True)]
    clock = [time.process_time()]
    found = L.count_cells(*columns)
    clock.append(time.process_time())
    cells, n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    clock.append(time.process_time())
    assert all((x == y).all() for x, y in zip(found, (*cells.T, n), strict=True))
    assert 2 * (clock[1] - clock[0]) < clock[2] - clock[1]  # rows as such are sorted many times slower
    assert [len(x) for x in L.count_cells(*[np.zeros(0, np.int64)] * 3)] == [0] * 4


def test_contexts_are_the_tokens_before(documents):
    texts = ["a b a", "", "b b", "c"]
    home = L.Home([bytes(r.data) for r in L.homes(documents(list(enumerate(texts))), 1).collect()])
    before = np.concatenate([[L.START], home.words[home.word][:-1]])
    before[home.begins] = L.START
    assert (home.words[home.context] == before).all() and len(home.words) == 5 and home.counts()[0][home.words == L.START] == home.train.sum()
    assert len(L.Home([]).words) == 0
