"""Substring dedup by Rabin-Karp windows: remove the words that a window of ``WINDOW`` words shares with an earlier document.

A document is earlier than another if its doc_id is smaller. Every window of every document gets a rolling polynomial hash:
64 bits that place it and 16 more, of a second polynomial, that must agree too.

1. A task works in flushes of some million windows. Inside a flush equal windows meet at once: all but those of the smallest
   doc_id are settled there, and one entry of each window travels on, so a passage that stands in a third of all documents
   sends one entry per flush.
2. Spark deals the entries over hash ranges. A range finds the smallest doc_id of each window and returns the windows of larger
   ones to their flush.
3. Spark groups the answers by flush, gives each document its repeated windows and joins them to its text. There the windows
   merge into maximal removal intervals.

Sizes: flushes and ranges hold ``LEAST`` windows, or the square root of ``CELL`` times all windows if that is more, so that a
flush has at least ``CELL`` windows for a range on average, and the number of cells stays in proportion to the input.

Edge cases: null and empty texts have no words; with fewer than ``WINDOW`` words nothing is removed. Windows are judged on the
input, not on what is left. Rows with a null doc_id neither remove words nor lose any. Rows that repeat a doc_id are judged one by
one and do not remove each other's words. Equal rows give equal results. A long text is hashed a block at a time; its word hashes are
held at once. Empty tables give empty results; other columns are ignored, whatever their names.
"""

import re
import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstgraph.llm.common import CHUNK, SEPARATORS, mix, powers, prefix_sums, span_hashes, text_chunks
from burstgraph.llm.exchange import pack, pack_sorted, unpack, unpack_sorted
from burstgraph.llm.id_marks import divide
from burstgraph.session import cut_lineage

WINDOW, LEAST, CELL = 13, 1_000_000, 100
_SECOND = np.uint64(0xA0761D6478BD642F)
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_BLOBS = "part BIGINT, flush BIGINT, kind INT, data BINARY"
_ARROW = pa.schema([("part", pa.int64()), ("flush", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
_ANSWERS = "id BIGINT, text_key BIGINT, windows BINARY"
_RESULT = "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, spans ARRAY<STRUCT<first: BIGINT, last: BIGINT>>, kept STRING"


def blocks(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """``text`` cut between words, about ``size`` bytes a block."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of every word of ``text``."""
    found = []
    for block in blocks(text):
        data = np.frombuffer(block + b" ", np.uint8)
        edges = np.flatnonzero(np.diff(SEPARATORS[data], prepend=True))
        found.append(span_hashes(prefix_sums(data), edges[0::2], edges[1::2]))
    return np.concatenate(found)


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every ``size`` consecutive words."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:count])


def windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, number of the text) of every window of every text."""
    words = word_hashes(b" ".join(texts)) if len(texts) > 1 else word_hashes(texts[0])
    counts = np.array([len(words)] if len(texts) == 1 else [len(t.split()) for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    first, second = rolling(words, size), rolling(mix(words ^ _SECOND), size)
    inside = owner[: len(first)] == owner[len(owner) - len(first) :]
    return first[inside], (second[inside] >> np.uint64(48)).astype(np.uint16), owner[: len(first)][inside]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], schema=_ARROW)


def _pairs(windows: np.ndarray, slots: np.ndarray) -> bytes:
    order = np.argsort(windows, kind="stable")
    return pack_sorted(windows[order]) + pack(slots[order])


def _unpairs(data: bytes, at: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    windows, at = unpack_sorted(data, at)
    slots, at = unpack(data, at)
    return windows, slots, at


def _flush(name: int, docs: list[tuple[int, int, np.ndarray, np.ndarray]], starts: np.ndarray) -> pa.RecordBatch:
    """One flush's cells, and its table: ids and text keys by slot, what is settled already, and entries of the id that travels."""
    docs = sorted(docs, key=lambda d: d[:2])
    ids, keys = (np.array([d[k] for d in docs], dtype=np.int64) for k in (0, 1))
    slots = np.repeat(np.arange(len(docs)), [len(d[2]) for d in docs])
    hashes, checks = (np.concatenate([d[k] for d in docs]) for k in (2, 3))
    order = np.lexsort((checks, hashes))
    hashes, checks, slots = hashes[order], checks[order], slots[order]
    same = (hashes[1:] == hashes[:-1]) & (checks[1:] == checks[:-1])
    head = np.append(True, ~same)
    repeat = np.append(False, same & (slots[1:] == slots[:-1]))
    least = ids[slots[head]][np.cumsum(head) - 1]
    settled, alike = (ids[slots] > least) & ~repeat, (ids[slots] == least) & ~head & ~repeat
    table = struct.pack("<I", len(ids)) + ids.tobytes() + keys.tobytes()
    table += _pairs(hashes[settled], slots[settled]) + _pairs(hashes[alike], slots[alike])
    hashes, checks, slots = hashes[head], checks[head], slots[head]
    cuts = np.append(np.searchsorted(hashes, starts), len(hashes))
    rows = [(name % len(starts), name, 1, table)]
    for part in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[part], cuts[part + 1]
        held, at = np.unique(slots[a:b], return_inverse=True)
        lowest = int(ids[held[0]])
        cell = struct.pack("<q", lowest) + pack_sorted(hashes[a:b]) + checks[a:b].tobytes() + pack(at)
        cell += pack_sorted(held) + pack_sorted(ids[held].view(np.uint64) - np.uint64(lowest % 2**64))
        rows.append((part, name, 0, cell))
    return _rows(rows)


def send(docs: DataFrame, parts: int, flush: int, size: int) -> DataFrame:
    """Cells and tables of the flushes of (doc_id, text, text_key)."""
    starts = np.array([-(-(p << 64) // parts) for p in range(parts)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, int], tuple] = {}
        count = 0
        for rows, texts in text_chunks(batches):
            hashes, checks, owner = windows(texts, size)
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            names = zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True)
            for name, a, b in zip(names, ends[:-1], ends[1:], strict=True):
                if a < b and name not in held:
                    held[name] = (*name, hashes[a:b], checks[a:b])
                    count += b - a
            if count >= flush:
                yield _flush((task << 24) + number, list(held.values()), starts)
                held, count, number = {}, 0, number + 1
        if held:
            yield _flush((task << 24) + number, list(held.values()), starts)

    return docs.select("doc_id", "text", "text_key").mapInArrow(run, _BLOBS)


def meet(cells: DataFrame) -> DataFrame:
    """For each flush the windows that a smaller doc_id has too, with their slots; tables are passed on."""

    def run(group: pa.Table) -> pa.Table:
        out, names, held = [], [], []
        for name, kind, data in zip(*(group.column(c).to_pylist() for c in ("flush", "kind", "data")), strict=True):
            if kind:
                out.append((0, name, 1, data))
                continue
            hashes, at = unpack_sorted(data, 8)
            checks = np.frombuffer(data, np.uint16, len(hashes), at)
            index, at = unpack(data, at + 2 * len(hashes))
            slots, at = unpack_sorted(data, at)
            ids, _ = unpack_sorted(data, at)
            ids = (ids + np.uint64(struct.unpack_from("<q", data)[0] % 2**64)).view(np.int64)
            index = index.astype(np.int64)
            held.append((hashes, checks, ids[index], slots[index], np.full(len(hashes), len(names))))
            names.append(name)
        if held:
            hashes, checks, ids, slots, whose = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, checks, hashes))
            same = (hashes[order][1:] == hashes[order][:-1]) & (checks[order][1:] == checks[order][:-1])
            head = np.append(True, ~same)
            late = order[ids[order] > ids[order][head][np.cumsum(head) - 1]]
            late = late[np.argsort(whose[late], kind="stable")]
            cuts = np.searchsorted(whose[late], np.arange(len(names) + 1))
            for name, a, b in zip(names, cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    out.append((0, name, 0, _pairs(hashes[late[a:b]], slots[late[a:b]])))
        return pa.Table.from_batches([_rows(out)], schema=_ARROW)

    return cells.groupBy("part").applyInArrow(run, _BLOBS).drop("part")


def settle(answers: DataFrame) -> DataFrame:
    """(id, text_key, windows) of the documents that lose words: their repeated windows, packed."""

    def run(group: pa.Table) -> pa.Table:
        found, answered, alike = [], [], []
        for kind, data in zip(group.column("kind").to_pylist(), group.column("data").to_pylist(), strict=True):
            if kind:
                (count,) = struct.unpack_from("<I", data)
                ids, keys = (np.frombuffer(data, np.int64, count, 4 + 8 * count * k) for k in (0, 1))
                hashes, slots, at = _unpairs(data, 4 + 16 * count)
                found.append((hashes, slots))
                alike = _unpairs(data, at)
            else:
                hashes, slots, _ = _unpairs(data)
                answered.append(hashes)
                found.append((hashes, slots))
        if answered and len(alike[0]):
            late = np.isin(alike[0], np.concatenate(answered))
            found.append((alike[0][late], alike[1][late]))
        hashes, slots = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((hashes, slots))
        hashes, slots = hashes[order], slots[order].astype(np.int64)
        held, first = np.unique(slots, return_index=True)
        packed = [pack_sorted(hashes[a:b]) for a, b in zip(first, np.append(first, len(slots))[1:], strict=True)]
        return pa.table({"id": ids[held], "text_key": keys[held], "windows": pa.array(packed, pa.binary())})

    return answers.groupBy("flush").applyInArrow(run, _ANSWERS)


def intervals(covered: np.ndarray, size: int, n: int) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of words under windows of ``size`` words that start at the ascending ``covered``."""
    if not len(covered):
        return []
    breaks = np.flatnonzero(np.diff(covered) > size)
    firsts, lasts = np.append(covered[0], covered[breaks + 1]), np.append(covered[breaks], covered[-1]) + size - 1
    return list(zip(firsts.tolist(), np.minimum(lasts, n - 1).tolist(), strict=True))


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            out = []
            for text, packed in zip(texts, rows.column(2).to_pylist(), strict=True):
                words, spans = text.split(), []
                if packed:
                    repeated, _ = unpack_sorted(packed)
                    hashes = rolling(word_hashes(text), size)
                    at = np.minimum(np.searchsorted(repeated, hashes), len(repeated) - 1)
                    spans = intervals(np.flatnonzero(repeated[at] == hashes), size, len(words))
                kept = words
                if spans:
                    stays = np.ones(len(words), dtype=bool)
                    for first, last in spans:
                        stays[first : last + 1] = False
                    kept = list(compress(words, stays.tolist()))
                named = [{"first": first, "last": last} for first, last in spans]
                out.append((len(words), len(words) - len(kept), named, b" ".join(kept).decode(errors="replace")))
            counts, removed, spans, kept = zip(*out, strict=True)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            columns = [rows.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return run


def cut_windows(docs: DataFrame, size: int = WINDOW, least: int = LEAST, cell: int = CELL) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) per row of ``docs``; spans are word positions, kept the words left, joined by a space."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    # no more windows than every second byte
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    flush = max(least, int((cell * total / 2) ** 0.5))
    parts = max(32, -(-total // (6 * flush)))
    answers = settle(meet(send(docs.where("doc_id IS NOT NULL"), parts, flush, size)))
    late = cut_lineage(answers)
    whole, open_rows = divide(docs, late.select(F.col("id").alias("doc_id")), "doc_id")
    merged = late.groupBy("id", "text_key").agg(F.max("windows").alias("windows"))  # equal rows have equal answers in every flush
    met = open_rows.alias("d").join(
        merged.alias("w"), F.expr("d.doc_id = w.id AND d.text_key = w.text_key"), "left"
    ).selectExpr("d.doc_id", "d.text", "w.windows")
    rows = whole.selectExpr("doc_id", "text", "CAST(NULL AS BINARY) AS windows").union(met)
    return rows.mapInArrow(_cut(size), _RESULT)
