"""The token exchange: sizes and round trips."""

import random

import numpy as np
import pyarrow as pa

from burstgraph.llm import exchange as X
from burstgraph.llm.common import digest64, text_chunks


def test_blobs_stay_in_proportion_to_the_tokens():
    blobs = {}
    for tokens in (10**8, 10**9, 10**10, 10**11, 10**12, 10**13):
        parts = X.ranges_for(tokens)
        flush = X.flush_size(parts)
        blobs[tokens] = parts * (tokens / flush)
        assert flush / parts >= X.CELL * 0.99 and flush <= 4 * 10**7
    assert all(blobs[n] <= 1.01 * n / X.CELL for n in blobs)


def test_a_range_is_small_beside_a_worker():
    for tokens in (10**6, 10**7, 56 * 10**6, 5 * 10**8):
        assert tokens / X.ranges_for(tokens) <= 250_000


def test_packing_round_trips():
    rng = np.random.default_rng(1)
    for width in (1, 2**8, 2**33, 2**63):
        values = rng.integers(0, width, 1000, dtype=np.uint64, endpoint=True)
        assert (X.unpack(X.pack(values))[0] == values).all()
        assert (X.unpack_sorted(X.pack_sorted(np.sort(values)))[0] == np.sort(values)).all()
    assert len(X.unpack(X.pack(values[:0]))[0]) == 0


def test_repeated_tokens_come_back(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(400)) for _ in range(20)) for _ in range(50)]

    def tokens_of(batches):
        for _, found in text_chunks(batches):
            for t in found:
                yield digest64(t), len(t), np.unique(np.array([int(w) << 40 for w in t.split()], dtype=np.uint64))

    docs = spark.createDataFrame([(t,) for t in texts], "text STRING").repartition(4)
    rows = X.repeated(X.send(docs, 16, tokens_of)).collect()
    held = {}
    for row in rows:
        held.setdefault(row.flush, []).append((row.kind, bytes(row.data)))
    found = {}
    for flush in held.values():
        group = pa.table({"kind": [k for k, _ in flush], "data": pa.array([d for _, d in flush], pa.binary())})
        for key, _, tokens, counts in X.gather(group):
            found[key] = {int(t) >> 24: int(n) for t, n in zip(tokens, counts, strict=True)}
    sets = {digest64(t.encode()): {int(w) for w in t.split()} for t in texts}
    for key, mine in sets.items():
        want = {w: sum(w in s for s in sets.values()) for w in mine}
        assert found.get(key, {}) == {w: n for w, n in want.items() if n > 1}
