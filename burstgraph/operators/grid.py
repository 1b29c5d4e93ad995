"""A vertex cut of the links: both series of a link meet in its cell of a grid.

Parallel links are collapsed to (src, dst, copies). A link lies in the cell (hash of src, hash of dst) of a grid of side p; a series
is sent once to each cell that holds one of its vertex's links, hence to at most 2p cells however many links the vertex
has, and at most once per link. A cell with more links than ``limit`` (the row of a vertex that holds a third of all links) is cut
further by a hash of the link. In a cell the links and the series are arrays: every link's shorter series is matched with the
other by (series, hour), a part of the links at a time, and a kernel sums up the matches of each link.

What is sent to a cell are blobs, not rows: the series that a task has for one cell lie in one blob, column by column and byte by
byte (the first bytes of all values, then the second ones), compressed without loss.
"""

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from burstgraph.operators.skew import hot_keys
from burstgraph.session import store

CELL_SAMPLES = 4_000_000  # samples of the series of one cell, on average at most
CELL_LINKS = 250_000  # links of one cell, however short the series
_EXPANDED = 1_000_000  # samples matched at a time
_FLUSH = 4_000_000  # samples, counted once per cell they go to, that a task gathers before it hands on its blobs
_BLOBS = "_cell BIGINT, _part BIGINT, series BIGINT, samples BIGINT, data BINARY"

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# kernel(number of links, link of each match, x, y) -> weight of each link; the matches come by link, then by hour
Kernel = Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def pack_series(signal: DataFrame) -> DataFrame:
    """(id, hours, values) with the samples in order of the hour; (id, hour) is unique, so a row holds at most the axis."""
    samples = F.sort_array(F.collect_list(F.struct("hour", "value")))
    return signal.groupBy("id").agg(samples.alias("s")).select("id", F.col("s.hour").alias("hours"), F.col("s.value").alias("values"))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... of each run of sizes[k]."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _by_byte(column: np.ndarray) -> bytes:
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), column.itemsize).T.tobytes()


def _blobs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row per cell that the series of (id, hours, values, cells) go to."""
    rows = pa.Table.from_batches(held).combine_chunks()
    ids, cells = rows.column("id").to_numpy(), pa.compute.list_flatten(rows.column("cells")).combine_chunks()
    cell, part = (pa.compute.struct_field(cells, k).to_numpy(zero_copy_only=False) for k in (0, 1))
    hours, values = _flat(rows.column("hours")), _flat(rows.column("values"))
    sizes = pa.compute.list_value_length(rows.column("hours")).to_numpy().astype(np.int32)
    order = np.lexsort((part, cell))
    row = np.repeat(np.arange(len(ids)), pa.compute.list_value_length(rows.column("cells")).to_numpy())[order]
    cell, part, ids, starts, sizes = cell[order], part[order], ids[row], (np.cumsum(sizes) - sizes)[row], sizes[row]
    at = _spread(starts, sizes)
    hours, values = hours[at], values[at]
    first = np.flatnonzero(np.append(True, (np.diff(cell) != 0) | (np.diff(part) != 0)))
    ends = np.append(0, np.cumsum(sizes))
    codec, data, samples = pa.Codec("zstd", 1), [], []
    for a, b in zip(first, np.append(first[1:], len(row)), strict=True):
        low, high = ends[a], ends[b]
        columns = np.diff(ids[a:b], prepend=0), sizes[a:b], np.diff(hours[low:high], prepend=hours.dtype.type(0)), values[low:high]
        data.append(codec.compress(b"".join(_by_byte(c) for c in columns), asbytes=True))
        samples.append(high - low)
    columns = [pa.array(c) for c in (cell[first], part[first], np.diff(np.append(first, len(row))), np.array(samples, np.int64), data)]
    return pa.RecordBatch.from_arrays(columns, names=["_cell", "_part", "series", "samples", "data"])


def to_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs of (id, hours, values, cells), ``_FLUSH`` samples at a time."""
    held, size = [], 0
    for batch in batches:
        lengths = [pa.compute.list_value_length(batch.column(c)).to_numpy().astype(np.int64) for c in ("hours", "cells")]
        ends, first = np.append(0, np.cumsum(lengths[0] * lengths[1])), 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + _FLUSH - size, "right")) - 1)
            held.append(batch.slice(first, last - first))
            size += ends[last] - ends[first]
            if last < batch.num_rows or size >= _FLUSH:
                yield _blobs(held)
                held, size = [], 0
            first = last
    if held:
        yield _blobs(held)


def _read_blobs(blobs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, hours, values) of all series of one cell, in order of the id."""
    codec, read = pa.Codec("zstd"), [[], [], [], []]
    kinds = [np.dtype(t) for t in (np.int64, np.int32, np.int32, np.float64)]
    for n, m, data in zip(*(blobs.column(c).to_pylist() for c in ("series", "samples", "data")), strict=True):
        counts = n, n, m, m
        raw, place = codec.decompress(data, sum(k.itemsize * c for k, c in zip(kinds, counts, strict=True))), 0
        for column, (kind, count) in enumerate(zip(kinds, counts, strict=True)):
            plain = np.frombuffer(raw, np.uint8, kind.itemsize * count, place).reshape(kind.itemsize, count).T
            plain = np.ascontiguousarray(plain).view(kind).reshape(-1)
            read[column].append(np.cumsum(plain, dtype=kind) if column in (0, 2) else plain)
            place += kind.itemsize * count
    ids, sizes, hours, values = (np.concatenate([np.empty(0, kind), *c]) for kind, c in zip(kinds, read, strict=True))
    order = np.argsort(ids, kind="stable")
    starts = np.cumsum(sizes) - sizes
    ids, sizes, at = ids[order], sizes[order], _spread(starts[order], sizes[order])
    return ids, np.append(0, np.cumsum(sizes, dtype=np.int64)), hours[at], values[at]


def _matches(src: np.ndarray, dst: np.ndarray, ids: np.ndarray, starts: np.ndarray, hours: np.ndarray, values: np.ndarray, kernel: Kernel, normalise: bool) -> np.ndarray:
    """Weight of every link; one with an end that has no series weighs 0."""
    weights = np.zeros(len(src))
    if not len(ids):
        return weights
    a, b = (np.minimum(np.searchsorted(ids, end), len(ids) - 1) for end in (src, dst))
    both = np.flatnonzero((ids[a] == src) & (ids[b] == dst))
    sizes = np.diff(starts)
    a, b = a[both], b[both]
    swap = sizes[a] > sizes[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    low = int(hours.min()) if len(hours) else 0
    stride = int(hours.max()) - low + 1 if len(hours) else 1
    keys = np.repeat(np.arange(len(ids)), sizes) * stride + (hours - low)
    scale = sizes.astype(np.float64) if normalise else np.ones(len(ids))
    total = np.cumsum(sizes[a])
    edges = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1] + 1 if len(total) else 1, _EXPANDED)), len(a)))
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        n = sizes[a[first:last]]
        link = np.repeat(np.arange(last - first), n)
        at = _spread(starts[a[first:last]], n)
        wanted = b[first:last][link] * stride + (hours[at] - low)
        there = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[there] == wanted
        link, at, there = link[hit], at[hit], there[hit]
        x, y = values[at] / scale[a[first:last]][link], values[there] / scale[b[first:last]][link]
        weights[both[first:last]] = kernel(int(last - first), link, x, y)
    return weights


def grid_weights(edges: DataFrame, packed: DataFrame, kernel: Kernel, normalise: bool, keep_all: bool, samples_per_cell: int = CELL_SAMPLES) -> DataFrame:
    """(src, dst, copies, weight) of the distinct links of ``edges``, from ``packed`` (id, hours, values).

    With ``keep_all`` links without a match weigh 0, else links of weight 0 may be missing. ``normalise`` divides the values by their series'
    number of samples.
    """
    distinct, seen = Observation(), Observation()
    links = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("copies"))
    links = store(links.observe(distinct, F.count(F.lit(1)).alias("links")), "links")
    packed = store(packed.observe(seen, F.avg(F.size("hours")).alias("samples")), "series")
    count, shape = distinct.get["links"], seen.get["samples"] or 1.0
    limit = max(1, min(CELL_LINKS, int(samples_per_cell / (2 * shape))))  # a link needs at most two series
    least = 2 * edges.sparkSession.sparkContext.defaultParallelism
    side = math.isqrt(max(least - 1, count // limit)) + 1
    place = F.pmod(F.xxhash64("src"), F.lit(side)) * side + F.pmod(F.xxhash64("dst", F.lit(1)), F.lit(side))
    placed = links.withColumn("cell", place)
    large = hot_keys(placed, "cell", limit) if count > limit else None
    if large is None:
        placed = placed.withColumn("part", F.lit(0).cast("long"))
    else:
        part = F.pmod(F.xxhash64("src", "dst", F.lit(2)), F.coalesce("_splits", F.lit(1)))
        placed = placed.join(large, "cell", "left").withColumn("part", part).drop("_splits")
    routes = placed.select("cell", "part", F.explode(F.array("src", "dst")).alias("id")).repartition("id").distinct()
    # An id is in at most 2 * side cells and their parts, so its list is bounded by the number of cells.
    wanted = routes.groupBy("id").agg(F.collect_list(F.struct("cell", "part")).alias("cells"))
    plain = [F.col("hours").cast("array<int>"), F.col("values").cast("array<double>")]
    sent = wanted.join(packed, "id").select("id", *plain, "cells").mapInArrow(to_blobs, _BLOBS)

    def weigh(mine: pa.Table, blobs: pa.Table) -> pa.Table:
        src, dst = mine.column("src").to_numpy(), mine.column("dst").to_numpy()
        ids, starts, hours, values = _read_blobs(blobs)
        weights = _matches(src, dst, ids, starts, hours, values, kernel, normalise)
        found = pa.table({"src": src, "dst": dst, "copies": mine.column("copies"), "weight": weights})
        pa.default_memory_pool().release_unused()
        return found if keep_all else found.filter(pa.array(weights != 0))

    return placed.groupBy("cell", "part").cogroup(sent.groupBy("_cell", "_part")).applyInArrow(weigh, "src BIGINT, dst BIGINT, copies BIGINT, weight DOUBLE")


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return pa.compute.list_flatten(column).to_numpy()


def ratio_sum(lam: float) -> Kernel:
    """Sum of the ratios (smaller over larger value) above ``lam``."""

    def kernel(n: int, link: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ratio = np.minimum(x, y) / np.maximum(x, y)
        return np.bincount(link, np.where(ratio > lam, ratio, 0.0), minlength=n)

    return kernel


def signed_sum(n: int, link: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ratios above one half minus the others."""
    ratio = np.minimum(x, y) / np.maximum(x, y)
    return np.bincount(link, np.where(ratio > 0.5, ratio, -ratio), minlength=n)


def chunked_correlation(size: int) -> Kernel:
    """Sum of the correlations of chunks of ``size`` common samples, with all common samples in their denominators.

    A chunk whose denominator is zero adds nothing.
    """

    def kernel(n: int, link: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not len(link):
            return np.zeros(n)
        common = np.bincount(link, minlength=n)
        rank = np.arange(len(link)) - np.repeat(np.cumsum(common) - common, common)
        first = np.flatnonzero(rank % size == 0)
        sx, sy, sxx, syy, sxy = (np.add.reduceat(v, first) for v in (x, y, x * x, y * y, x * y))
        whole = common[link[first]]
        spread = np.maximum(sxx - sx * sx / whole, 0.0) * np.maximum(syy - sy * sy / whole, 0.0)
        bottom = np.sqrt(spread)
        term = np.divide(sxy - sx * sy / whole, bottom, out=np.zeros(len(first)), where=bottom > 0)
        return np.bincount(link[first], term, minlength=n)

    return kernel
