"""Which tokens of a document also occur in another document?

Documents send their token hashes to token ranges as packed blobs and only the repeated ones come back. A task works in
flushes of about ``FLUSH`` tokens: each flush has a table of its documents' keys, its tokens travel as (delta, slot) byte
planes, some six bytes a token. A range holds ``RANGE_TOKENS`` tokens on average, as a task holds a range whole. Beyond 6 * 10^8
tokens ranges, and beyond 10^10 flushes too, grow with the square root of the input, so that a flush keeps ``CELL`` tokens for a
range: the number of blobs, and of steps of the loop over ranges, is in proportion to the input (some 30 million tokens a flush at
10^13 tokens). A token enters a range once per document, and copies within a task are skipped by key, so a group of copies adds at
most one entry per flush.
"""

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from burstgraph.llm.common import release, tidy

RANGE_TOKENS, FLUSH, CELL = 250_000, 1_000_000, 100
TOKEN_BITS = 48
_SHIFT = np.uint64(64 - TOKEN_BITS)
_ROWS = "part BIGINT, flush BIGINT, kind INT, data BINARY"
_ARROW = pa.schema([("part", pa.int64()), ("flush", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def ranges_for(tokens: int) -> int:
    """Number of token ranges for so many tokens."""
    return max(16, -(-tokens // max(RANGE_TOKENS, math.isqrt(CELL * tokens))))


def flush_size(parts: int) -> int:
    """Tokens of a flush that is cut over so many ranges: ``CELL`` for each at least."""
    return max(FLUSH, CELL * parts)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, no wider than the largest needs."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return struct.pack("<IB", len(values), width) + planes.tobytes()


def unpack(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """Values packed at ``at``, and the position behind them."""
    n, width = struct.unpack_from("<IB", data, at)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 5).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64) if n else np.zeros(0, np.uint64), at + 5 + n * width


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers as packed differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    values, at = unpack(data, at)
    return np.cumsum(values, dtype=np.uint64), at


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], schema=_ARROW)


def send(docs: DataFrame, parts: int, tokens_of: Callable) -> DataFrame:
    """Forward rows. ``tokens_of(batches)`` yields (key, size, distinct 64-bit tokens) per document; each (part, flush)
    becomes one row, and one part of each flush also gets the table of its documents."""

    starts, full = part_starts(parts), flush_size(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        seen, keys, sizes, held, count = set(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = (task << 24) + number
            slots = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
            tokens = np.concatenate(held)
            held.clear()
            tokens >>= _SHIFT
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            slots = slots[order]
            del order
            cuts = np.searchsorted(tokens, starts)
            rows = [
                (p, name, 0, pack_sorted(tokens[a:b]) + pack(slots[a:b]))
                for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(tokens)], strict=True))
                if b > a
            ]
            table = np.array(keys, dtype="<i8").tobytes() + np.array(sizes, dtype="<i8").tobytes()
            return _rows([*rows, (name % parts, name, 1, table)])

        for key, size, tokens in tokens_of(batches):
            if key in seen:
                continue
            seen.add(key)
            keys.append(key)
            sizes.append(size)
            held.append(tokens)
            count += len(tokens)
            if count >= full:
                yield flush()
                keys, sizes, held, count, number = [], [], [], 0, number + 1
        if count:
            yield flush()

    return docs.mapInArrow(tidy(run), _ROWS)


def part_starts(parts: int) -> np.ndarray:
    """First token of each range."""
    return np.array([-(-(p << TOKEN_BITS) // parts) for p in range(parts)], dtype=np.uint64)


def repeated(forward: DataFrame) -> DataFrame:
    """(flush, kind, data): for each flush the tokens that another document has too, with the number of documents
    (255 stands for that many or more), and its table of documents."""

    def meet(group: pa.Table) -> pa.Table:
        release()
        passed, tokens, owners, names = [], [], [], []
        for name, kind, data in zip(*(group.column(c).to_pylist() for c in ("flush", "kind", "data")), strict=True):
            if kind:
                passed.append((0, name, 1, data))
            else:
                values, at = unpack_sorted(data)
                slots, _ = unpack(data, at)
                tokens.append(values)
                owners.append(slots | np.uint64(len(names) << 32))
                names.append(name)
        if tokens:
            tokens, owners = np.concatenate(tokens), np.concatenate(owners)
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], owners[order]
            _, first, counts = np.unique(tokens, return_index=True, return_counts=True)
            counts = np.repeat(counts, counts)
            keep = counts > 1
            tokens, owners, counts = tokens[keep], owners[keep], np.minimum(counts[keep], 255).astype(np.uint64)
            order = np.argsort(owners, kind="stable")  # by flush, then document; tokens stay ascending
            tokens, owners, counts = tokens[order], owners[order], counts[order]
            whose = (owners >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(whose, np.arange(len(names) + 1))
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    slots = owners[a:b] & np.uint64(0xFFFFFFFF)
                    passed.append((0, names[k], 0, pack_sorted(slots) + pack(tokens[a:b]) + pack(counts[a:b])))
        return pa.Table.from_batches([_rows(passed)], schema=_ARROW)

    return forward.groupBy("part").applyInArrow(meet, _ROWS).drop("part")


def gather(group: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(key, size, its repeated tokens ascending, their document counts) of each document of one flush."""
    keys, parts = None, []
    for kind, data in zip(group.column("kind").to_pylist(), group.column("data").to_pylist(), strict=True):
        if kind:
            both = np.frombuffer(data, dtype="<i8")
            keys, sizes = both[: len(both) // 2], both[len(both) // 2 :]
        else:
            slots, at = unpack_sorted(data)
            tokens, at = unpack(data, at)
            parts.append((slots, tokens, unpack(data, at)[0]))
    if not parts:
        return
    slots, tokens, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((tokens, slots))
    slots, tokens, counts = slots[order], tokens[order], counts[order]
    owners, first = np.unique(slots, return_index=True)
    for slot, a, b in zip(owners, first, [*first[1:], len(slots)], strict=True):
        yield int(keys[int(slot)]), int(sizes[int(slot)]), tokens[a:b], counts[a:b]
