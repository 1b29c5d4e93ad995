"""Suffix-array dedup by bucket-pointer refinement: cut bytes that stand in a string of ``WINDOW`` bytes of an earlier document.

A document sorted before another is one with a smaller doc_id. A full suffix array is not needed to find common strings of a
fixed length; the buckets that can hold one are:

1. Each window of ``WINDOW`` bytes has a smallest ``KEY``-gram hash, which depends on its bytes alone. The token exchange tells
   which of these keys occur in several documents; windows of other keys are done.
2. Documents with shared keys are read again. Their remaining windows fall into buckets by smallest ``GRAM``-gram hash, fewer
   and larger than those of the keys; a run of windows of one bucket is sent to the part of the bucket as its bytes.
3. Refinement: positions of a bucket's runs get the bucket numbers of their 8-byte grams; sorting on (own number, number
   ``k`` bytes later) gives those of 16, 32 and ``WINDOW`` bytes, each step reusing the numbers of the one before. Two
   windows have equal numbers exactly if they have equal bytes; the smallest doc_id of each number decides. Runs begin where
   their bytes say, so copies of a passage give equal runs, and equal runs are refined once.
4. A bucket with more than ``HOT_ROWS`` runs is not gathered: its windows are grouped by a 128-bit hash, with minima combined
   before the shuffle.

Copies of a text are one node: all but the one with the smallest doc_id go whole.

Edge cases: null text is empty; texts shorter than ``WINDOW`` bytes keep all. Rows with a null doc_id neither cut nor are cut.
Rows repeating a doc_id are judged one by one and do not cut each other. Empty tables give empty results; other columns
are ignored. A cut may fall inside a multi-byte character: ``cut_documents`` drops the bytes that are no UTF-8 then.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from burstgraph.llm.common import bound_batches, digest64, fixed_hashes, mix, park, pieces, prefix_sums, release, text_chunks, tidy
from burstgraph.llm.exchange import TOKEN_BITS, gather, pack, ranges_for, repeated, send, unpack
from burstgraph.llm.id_filter import free_name, probably_in, split_rows

WINDOW, KEY, GRAM = 50, 36, 24
HOT_ROWS, FLUSH_ROWS, PART_ROWS, SLICE_ROWS = 100_000, 200_000, 100_000, 20_000
_FACTS = "doc_id BIGINT, n_bytes BIGINT, sha STRING, node BIGINT"


def document_facts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, sha, node) per row; node identifies the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows.column(0).cast(pa.int64()),
                    "n_bytes": pa.array(map(len, texts), pa.int64()),
                    "sha": pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                    "node": pa.array(map(digest64, texts), pa.int64()),
                }
            )

    return bound_batches(docs).select("doc_id", "text").mapInArrow(tidy(run), _FACTS)


def window_buckets(data: np.ndarray, gram: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Smallest hash of a ``gram``-gram in the window that starts at each byte; ``sums`` are the prefix sums of ``data``."""
    sums = prefix_sums(data) if sums is None else sums
    low, span = fixed_hashes(sums, gram), 1
    wanted = WINDOW - gram + 1
    while 2 * span <= wanted:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    return np.minimum(low[: len(low) - (wanted - span)], low[wanted - span :])


def window_keys(data: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A key of the window that starts at each byte. Smallest hashes are small: mixed once more, keys fill all ranges alike."""
    return mix(window_buckets(data, KEY, sums))


def _keys(docs: DataFrame, parts: int) -> DataFrame:
    """(node, keys): for each text its window keys that another text has too."""

    def tokens_of(batches):
        for _, texts in text_chunks(batches):
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            if len(data) < WINDOW:
                continue
            keys, begin = window_keys(data), 0
            for text in texts:
                if len(text) >= WINDOW:
                    yield digest64(text), len(text), np.unique(keys[begin : begin + len(text) - WINDOW + 1])
                begin += len(text)

    def home(group: pa.Table) -> pa.Table:
        release()
        rows = [(node, np.unique(tokens).astype("<u8").tobytes()) for node, _, tokens, _ in gather(group)]
        return pa.table({"node": pa.array([r[0] for r in rows], pa.int64()), "keys": pa.array([r[1] for r in rows], pa.binary())})

    found = repeated(send(docs.where("doc_id IS NOT NULL").select("text"), parts, tokens_of))
    return found.groupBy("flush").applyInArrow(home, "node BIGINT, keys BINARY").dropDuplicates(["node"])


def cut_runs(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs in pieces of at most ``WINDOW`` windows, counted from each run's start, so that copies are cut alike."""
    count = -(-(stop - start) // WINDOW)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(start, count) + WINDOW * within
    return first, np.minimum(first + WINDOW, np.repeat(stop, count))


def _contexts(texts: DataFrame) -> DataFrame:
    """(bucket, doc_id, node, at, context): runs of windows with shared keys; ``texts`` has doc_id, text, node and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, nodes, keys = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "node", "keys"))
            texts = texts.cast(pa.binary())
            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                if digest64(text) != nodes[i].as_py():  # another row with this doc_id
                    continue
                data = np.frombuffer(text, dtype=np.uint8)
                sums = prefix_sums(data)
                own = window_keys(data, sums) >> np.uint64(64 - TOKEN_BITS)
                known = np.frombuffer(keys[i].as_py(), dtype="<u8")
                shared = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
                bucket = window_buckets(data, GRAM, sums)
                new = np.ones(len(own), dtype=bool)
                new[1:] = (bucket[1:] != bucket[:-1]) | (shared[1:] != shared[:-1])
                edge = np.flatnonzero(new)
                stop = np.append(edge[1:], len(own))
                keep = shared[edge]
                edge, stop = cut_runs(edge[keep], stop[keep])
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(bucket[edge].view(np.int64)),
                        "doc_id": pa.array(np.full(len(edge), ids[i].as_py(), dtype=np.int64)),
                        "node": pa.array(np.full(len(edge), nodes[i].as_py(), dtype=np.int64)),
                        "at": pa.array(edge.astype(np.int64)),
                        "context": pa.array([text[a : b + WINDOW - 1] for a, b in zip(edge.tolist(), stop.tolist(), strict=True)], pa.binary()),
                    }
                )

    return texts.mapInArrow(tidy(run), "bucket BIGINT, doc_id BIGINT, node BIGINT, at BIGINT, context BINARY")


def refine(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context number, bucket number) of every window: numbers are equal exactly if the bytes are."""
    data = np.frombuffer(b"".join(contexts) + bytes(8), dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begins = np.cumsum(sizes) - sizes

    def starts(length: int) -> np.ndarray:
        counts = sizes - length + 1
        return np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())

    eights = np.lib.stride_tricks.sliding_window_view(data, 8)
    number, length = np.zeros(len(data), dtype=np.int64), 8
    at = starts(8)
    number[at] = np.unique(np.ascontiguousarray(eights[at]).view("<u8").reshape(-1), return_inverse=True)[1]
    while length < WINDOW:
        step = min(length, WINDOW - length)
        at = starts(length + step)
        pairs = number[at] * len(data) + number[at + step]
        number[at] = np.unique(pairs, return_inverse=True)[1]
        length += step
    counts = sizes - WINDOW + 1
    return np.repeat(np.arange(len(contexts)), counts), number[at]


def _packed(contexts: DataFrame, parts: int) -> DataFrame:
    """(part, data): runs of the buckets of a part, many in one blob."""

    def blob(table: pa.Table, buckets: np.ndarray) -> bytes:
        nodes, first, slots = np.unique(table.column("node").to_numpy(), return_index=True, return_inverse=True)
        ids = table.column("doc_id").to_numpy()[first]
        texts = table.column("context").to_pylist()
        sizes = np.array([len(t) for t in texts])
        columns = (pack(buckets), pack(ids.view(np.uint64)), pack(nodes.view(np.uint64)), pack(slots), pack(table.column("at").to_numpy()), pack(sizes))
        return zlib.compress(b"".join([*columns, *texts]), 1)

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        buckets = table.column("bucket").to_numpy().view(np.uint64)
        part = ((buckets * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        table, buckets, part = table.take(pa.array(order)), buckets[order], part[order]
        names, cuts = np.unique(part, return_index=True)
        blobs = [blob(table.slice(a, b - a), buckets[a:b]) for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], names=["part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= FLUSH_ROWS:
                yield flush(held)
                held = []
        if sum(b.num_rows for b in held):
            yield flush(held)

    return contexts.mapInArrow(tidy(run), "part BIGINT, data BINARY")


def _cut(packed: DataFrame) -> DataFrame:
    """(doc_id, node, start, stop): bytes whose window occurs in a document of smaller id."""

    def run(group: pa.Table) -> pa.Table:
        release()
        columns, texts = ([], [], [], []), []
        for data in group.column("data").to_pylist():
            data, at, read = zlib.decompress(data), 0, []
            for _ in range(6):
                values, at = unpack(data, at)
                read.append(values)
            buckets, ids, nodes, slots, begins, sizes = read
            slots = slots.astype(np.int64)
            for held, x in zip(columns, (buckets, ids[slots], nodes[slots], begins), strict=True):
                held.append(x)
            ends = np.cumsum(sizes).astype(np.int64) + at
            texts += [data[a:b] for a, b in zip((ends - sizes.astype(np.int64)).tolist(), ends.tolist(), strict=True)]
        buckets, ids, nodes, begins = (np.concatenate(c) for c in columns)
        ids, nodes, begins = ids.view(np.int64), nodes.view(np.int64), begins.astype(np.int64)
        order = np.argsort(buckets, kind="stable")
        edges = np.flatnonzero(np.diff(buckets[order])) + 1  # slices end between buckets
        out, first = [], 0
        while first < len(order):
            last = np.searchsorted(edges, first + SLICE_ROWS)
            stop = int(edges[last]) if last < len(edges) else len(order)
            some = order[first:stop]
            forms: dict[bytes, int] = {}  # equal runs are refined once
            form = np.array([forms.setdefault(texts[k], len(forms)) for k in some.tolist()])
            lowest = np.full(len(forms), np.iinfo(np.int64).max)
            np.minimum.at(lowest, form, ids[some])
            owner, number = refine(list(forms))
            low = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, number, lowest[owner])
            low = low[number]  # by window of a form
            windows = np.bincount(owner, minlength=len(forms))
            begin, count = (np.cumsum(windows) - windows)[form], windows[form]
            whose = np.repeat(np.arange(len(some)), count)
            place = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count)
            late = low[begin[whose] + place] < ids[some][whose]
            new = np.ones(len(whose), dtype=bool)
            new[1:] = (whose[1:] != whose[:-1]) | (late[1:] != late[:-1])
            edge = np.flatnonzero(new)
            size = np.diff(np.append(edge, len(whose)))
            edge, size = edge[late[edge]], size[late[edge]]
            owner = some[whose[edge]]
            start = begins[owner] + place[edge]
            out.append((ids[owner], nodes[owner], start, start + size + WINDOW - 1))
            first = stop
        found = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table(dict(zip(("doc_id", "node", "start", "stop"), found, strict=True)))

    return packed.groupBy("part").applyInArrow(run, "doc_id BIGINT, node BIGINT, start BIGINT, stop BIGINT")


def _single_windows(contexts: DataFrame) -> DataFrame:
    """(w1, w2, doc_id, node, at): every window of the contexts by a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[tuple[int, ...]] = []
            for doc, node, at, context in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "node", "at", "context")), strict=True):
                for k in range(len(context) - WINDOW + 1):
                    name = hashlib.blake2b(context[k : k + WINDOW], digest_size=16).digest()
                    out.append((int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True), doc, node, at + k))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["w1", "w2", "doc_id", "node", "at"])

    return contexts.mapInArrow(tidy(run), "w1 BIGINT, w2 BIGINT, doc_id BIGINT, node BIGINT, at BIGINT")


def removed_spans(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, node, spans): byte spans (start, stop) to cut from the first document of each text."""
    total = facts.where("doc_id IS NOT NULL").agg(F.sum("n_bytes")).first()[0] or 0
    parts = ranges_for(2 * total // (WINDOW - KEY + 2))
    firsts = facts.where("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = park(_keys(docs, parts).join(firsts, "node"), "suffix-keys")
    texts = probably_in(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), wanted, "doc_id")
    contexts = park(_contexts(texts.join(wanted, "doc_id")), "suffix-contexts", "zstd")

    per_bucket = contexts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    hot = park(per_bucket.where(F.col("n") > HOT_ROWS).select("bucket"), "suffix-hot")
    rows, none_hot = contexts.count(), hot.isEmpty()
    cold = contexts if none_hot else contexts.join(hot, "bucket", "left_anti")
    cut = _cut(_packed(cold, max(16, -(-rows // PART_ROWS))))
    if not none_hot:
        windows = _single_windows(contexts.join(hot, "bucket", "left_semi"))
        first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"))
        late = windows.join(first, ["w1", "w2"]).where("first < doc_id")
        cut = cut.union(late.selectExpr("doc_id", "node", "at AS start", f"at + {WINDOW} AS stop"))
    return cut.groupBy("doc_id", "node").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def _kept(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """(what is left, number of maximal spans, bytes cut)."""
    left, end, count = [], 0, 0
    for span in spans:
        if span["start"] > end or not count:
            left.append(text[end : span["start"]])
            count += 1
        end = max(end, span["stop"])
    left.append(text[end:])
    kept = b"".join(left)
    return kept, count, len(text) - len(kept)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, node, kept): kept is the text left where bytes were cut from
    between others, else null: all of the text is left where n_removed is 0, and none where it is n_bytes."""
    facts = park(document_facts(docs), "suffix-facts")
    spans = park(removed_spans(docs, facts), "suffix-spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for row in batch.to_pylist():
                text = row["text"].encode()
                if digest64(text) == row["node"]:
                    kept, count, cut = _kept(text, row["spans"])
                    rows.append((row["doc_id"], row["node"], cut, count, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "node", "cut", "spans", "left", "kept"])

    texts = probably_in(docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), spans, "doc_id")
    partly = texts.join(spans, "doc_id").mapInArrow(tidy(run), "doc_id BIGINT, node BIGINT, cut BIGINT, spans BIGINT, left STRING, kept STRING")
    partly = partly.dropDuplicates(["doc_id", "node"])
    firsts = facts.where("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    joined = facts.join(firsts, "node", "left").join(partly, ["doc_id", "node"], "left")
    whole = f"(doc_id > first AND n_bytes >= {WINDOW})"
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.selectExpr(
        "doc_id",
        "n_bytes",
        f"CASE WHEN {whole} THEN n_bytes ELSE coalesce(cut, 0L) END AS n_removed",
        f"CASE WHEN {whole} THEN 1L ELSE coalesce(spans, 0L) END AS n_spans",
        f"CASE WHEN {whole} THEN '{nothing}' ELSE coalesce(left, sha) END AS kept_sha256",
        "node",
        "kept",
    )


def cut_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the bytes cut from ``text`` (and n_chars, where there is such a column, counted anew); documents that
    lose all their text go, others keep their other columns. Rows with a null doc_id stay as they are."""
    changed = suffix_dedup(docs).where("n_removed > 0").select("doc_id", "node", F.coalesce("kept", F.lit("")).alias("kept"))
    changed = park(changed.dropDuplicates(["doc_id", "node"]), "suffix-changed")
    same, open_rows = split_rows(docs, changed, "doc_id")
    node, there, other, kept = (free_name(docs.columns, name) for name in ("_node", "_there", "_id", "_kept"))
    schema = StructType([*docs.schema.fields, StructField(node, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            yield batch.append_column(node, pa.array([digest64(t or b"") for t in texts], pa.int64()))

    new = changed.select(F.col("doc_id").alias(other), F.col("node").alias(there), F.col("kept").alias(kept))
    joined = open_rows.mapInArrow(tidy(run), schema).join(new, (F.col("doc_id").cast("bigint") == F.col(other)) & (F.col(node) == F.col(there)), "left")
    joined = joined.where(F.col(kept).isNull() | (F.col(kept) != "")).withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return same.union(joined.select(*(F.col(f"`{c}`") for c in docs.columns)))
