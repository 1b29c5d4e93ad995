"""Benchmark decontamination: word-pair seeds, a lossless count, then Smith-Waterman alignment.

1. Item and passage are aligned word by word (match +2, other word -1, gap -1). The score is divided by that of a verbatim
   copy; at ``LEAST`` or more the document holds the item. The answer is that of the alignment with the whole document.
2. Seeds are an item's pairs of words one or two apart, sought one or two apart in the documents. Let M words match with E edits
   between them, 2 M - E >= T. Of the M - 1 steps between matches, one without edit (neighbours in both) counts 2, one with one
   edit 1, others 0: 2 (M - 1) - E >= T - 2 altogether, over a span of M + E <= 3 M - T words. So only passages whose seeds
   count T - 2 within 3 size - T words are aligned, whatever the edits and however often an edited copy stands in the corpus.
3. Seeds of more than ``COMMON`` items are left out, most common first, as far as what they could count is at most half of what
   their item needs; it then needs that much less. So nothing is lost by it either.

The items are a stated query set, taken in blocks of about ``BLOCK_BYTES`` that travel with the tasks; documents are read
where they lie and nothing of them is shuffled, so common words or many leaks make no task larger than its input.

Edge cases: null and empty texts hold nothing; items of fewer than ``SHORTEST`` words, or null, are never found. Words are
lower-cased (A-Z) and compared by hash. Repeated rows are judged row by row; a null id is carried along. Empty tables give
empty results; other columns are ignored.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstgraph.llm.common import mix, text_chunks, words_of

SHORTEST, COMMON, LEAST, BLOCK_BYTES, CELLS = 3, 32, 0.5, 8 << 20, 1 << 16
MATCH, OTHER, GAP = 2, -1, -1
_FOUND = "doc_id BIGINT, item_id BIGINT, score DOUBLE, first_word BIGINT, last_word BIGINT"
_START_BITS = 32


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, first word, last word) of the best local alignment of ``item`` with each row of ``passages``.

    A cell holds score and start of its alignment in one number, so that one maximum carries both.
    """
    unit = np.int64(1) << _START_BITS
    rows, width = passages.shape
    places = np.arange(width, dtype=np.int64)
    best = np.full(rows, 0, dtype=np.int64)
    last = np.zeros(rows, dtype=np.int64)
    fresh = np.broadcast_to(places, (rows, width))  # score 0, starting here
    above = np.concatenate([fresh, np.full((rows, 1), width)], axis=1)
    slope = np.arange(width + 1, dtype=np.int64) * (-GAP * unit)
    for word in item:
        step = np.where(passages == word, MATCH * unit, OTHER * unit)
        here = above + GAP * unit
        here[:, 1:] = np.maximum(here[:, 1:], above[:, :-1] + step)
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        # a cell without a positive score starts afresh behind its column
        here = np.where(here >= unit, here, np.arange(width + 1, dtype=np.int64))
        top = here.argmax(axis=1)
        value = here[np.arange(rows), top]
        better = (value >> _START_BITS) > (best >> _START_BITS)
        best, last = np.where(better, value, best), np.where(better, top - 1, last)
        above = here
    return best >> _START_BITS, best & (unit - 1), last


def _items(block: DataFrame) -> tuple[list[int], list[np.ndarray]]:
    rows = block.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text").collect()
    words = [words_of([r["text"].encode()])[2] for r in rows]
    keep = [k for k, w in enumerate(words) if len(w) >= SHORTEST]
    return [rows[k]["item_id"] for k in keep], [words[k] for k in keep]


def _pairs(words: np.ndarray, apart: int) -> np.ndarray:
    """Hash of each word with the one ``apart`` words later."""
    return mix(words[:-apart] * np.uint64(0xD6E8FEB86659FD93) + words[apart:])


def _seed_table(items: list[np.ndarray], need: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ascending seeds, first entry of each, item and whether neighbours there by entry, what the items' seeds must count)."""
    pairs = [(_pairs(w, 1), _pairs(w, 2)) for w in items]
    keys = [np.unique(np.concatenate(p)) for p in pairs]
    known, owners = np.unique(np.concatenate(keys), return_counts=True)
    need, kept, near = need.copy(), [], []
    for k, (one, two) in enumerate(pairs):
        shared = owners[np.searchsorted(known, keys[k])]
        lost, out = np.zeros(len(one), dtype=np.int64), []  # by place in the item: what a step from there could count
        for key in keys[k][np.argsort(-shared, kind="stable")][: (shared > COMMON).sum()]:
            more = np.maximum(lost, 2 * (one == key))
            more[:-1] = np.maximum(more[:-1], two == key)
            if more.sum() <= need[k] // 2:
                lost = more
                out.append(key)
        need[k] -= lost.sum()
        kept.append(np.setdiff1d(keys[k], np.array(out, dtype=np.uint64)))
        near.append(np.isin(kept[-1], one))
    owner, seed = np.repeat(np.arange(len(items)), [len(x) for x in kept]), np.concatenate(kept)
    order = np.argsort(seed, kind="stable")
    seeds, first = np.unique(seed[order], return_index=True)
    return seeds, np.append(first, len(seed)), owner[order], np.concatenate(near)[order], need


def _block_matches(docs: DataFrame, ids: list[int], items: list[np.ndarray], least: float) -> DataFrame:
    sizes = np.array([len(w) for w in items], dtype=np.int64)
    wanted = np.ceil(least * MATCH * sizes - 1e-9).astype(np.int64)
    spans = 3 * sizes - wanted
    seeds, first, owner, near, need = _seed_table(items, np.maximum(1, wanted - 2)) if items else (np.zeros(0, np.uint64),) * 5

    def passages(words: np.ndarray, at: np.ndarray, maybe: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, text number, first word, end) of what is to be aligned."""
        item, place, count = [], [], []
        for apart in (1, 2):
            grams = _pairs(words, apart)
            here = np.flatnonzero(maybe[grams >> np.uint64(44)])
            number = np.minimum(np.searchsorted(seeds, grams[here]), len(seeds) - 1)
            inside = (seeds[number] == grams[here]) & (here + apart < at[np.searchsorted(at, here, side="right")])
            here, number = here[inside], number[inside]
            reps = first[number + 1] - first[number]
            entry = np.repeat(first[number] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            item.append(owner[entry])
            place.append(np.repeat(here, reps))
            count.append(1 + near[entry] if apart == 1 else np.ones(len(entry), dtype=np.int64))
        item, place, count = (np.concatenate(x) for x in (item, place, count))
        if not len(item):
            return
        step = len(words) + 1
        key = item * step + place
        order = np.lexsort((-count, key))  # a place counts once for an item, by its best pair
        key, count = key[order], count[order]
        best = np.diff(key, prepend=-1) > 0
        key, count = key[best], count[best]
        item, place = key // step, key % step
        text = np.searchsorted(at, place, side="right") - 1
        end = np.minimum(place + spans[item], at[text + 1])
        total = np.append(0, np.cumsum(count))
        dense = total[np.searchsorted(key, item * step + end)] - total[:-1] >= need[item]
        item, place, text, end = item[dense], place[dense], text[dense], end[dense]
        if not len(item):
            return
        begin = np.maximum(place - spans[item], at[text])  # seeds left out may stand before
        new = (np.diff(item, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0) | (begin >= np.append(0, end[:-1]))
        yield from zip(item[new].tolist(), text[new].tolist(), begin[new].tolist(), end[np.append(new[1:], True)].tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[seeds >> np.uint64(44)] = True
        for rows, texts in text_chunks(batches):
            doc_ids, tasks = rows.column(0).cast(pa.int64()).to_pylist(), {}
            _, _, words, at, _ = words_of(texts)
            for item, k, begin, end in passages(words, at, maybe) if len(seeds) and len(words) > 1 else ():
                tasks.setdefault(item, []).append((end - begin, k, begin))
            out = {}
            for item, found in tasks.items():
                found.sort()
                while found:
                    width = found[-1][0]  # the widest left, with others as far as the cells go
                    count = max(1, CELLS // width)
                    some, found = found[-count:], found[:-count]
                    cut = np.zeros((len(some), width), dtype=np.uint64)
                    for r, (n, _, begin) in enumerate(some):
                        cut[r, :n] = words[begin : begin + n]
                    scores, starts, stops = align(items[item], cut)
                    for r in np.flatnonzero(scores >= wanted[item]):
                        _, k, begin = some[r]
                        name, begin = (k, ids[item]), begin - at[k]
                        out[name] = max(out.get(name, (0.0, 0, 0)), (scores[r] / (MATCH * sizes[item]), int(begin + starts[r]), int(begin + stops[r])))
            found = [(doc_ids[k], item, *best) for (k, item), best in out.items()]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "score", "first_word", "last_word"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): the best alignment of every item that a document holds."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    found = []
    for k in range(blocks):
        block = benchmark.where(F.expr(f"pmod(xxhash64(item_id), {blocks}L) = {k}"))
        found.append(_block_matches(docs, *_items(block), least))
    return reduce(DataFrame.union, found)
