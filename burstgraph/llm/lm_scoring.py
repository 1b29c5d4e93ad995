"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

p(w | u) = a c(uw)/c(u) + b c(w)/N + (1 - a - b)/(V + 1), with a and b by bucket of the context's frequency c(u), counted in the
training documents. The weights are learned by expectation-maximisation on held-out counts: every home scores its own training
documents with each document's counts taken away.

How counts reach the texts without a table of all words anywhere: documents are laid out by home (a hash of doc_id, about
``HOME_BYTES`` of text each, packed and compressed). A home sends its distinct words and bigrams, sorted, to hash
ranges; a range adds up the counts and sends each home back just the numbers, in the order of its request. The home then reads its
texts again and fills them in. A word that all documents share enters a range once per home. Requests grow with the corpus;
nothing is capped. Words and bigrams have 64-bit hashes.

Edge cases: null and empty texts are one end token. Rows with a null doc_id are scored but not learned from. Rows repeating a
doc_id are learned from and scored one by one. With no training documents, base_score uses c = N = V = 0 and so does score. Other columns
are ignored. Empty tables give empty results.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstgraph.llm.common import mix, park, text_chunks, words_of
from burstgraph.llm.exchange import pack, pack_sorted, unpack, unpack_sorted

HOME_BYTES, ROUNDS, GRID = 8 << 20, 30, 16
FOLDS, HELD_OUT = 7, 2
START, END = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x5A5A5A5A5A5A5A5B)
_REQUEST = "kind INT, part BIGINT, home BIGINT, data BINARY"
_ANSWER = "home BIGINT, kind INT, part BIGINT, data BINARY, types BIGINT, tokens BIGINT"
_SCORES = "doc_id BIGINT, n_tokens BIGINT, n_known BIGINT, base_score DOUBLE, score DOUBLE"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def homes(docs: DataFrame, count: int) -> DataFrame:
    """(home, data): documents of a home as compressed blobs of ids and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = batch.column(2).to_numpy()
            order = np.argsort(home, kind="stable")
            table = pa.table({"doc_id": batch.column(0).cast(pa.int64()), "text": batch.column(1)}).take(pa.array(order))
            names, cuts = np.unique(home[order], return_index=True)
            out = []
            for a, b in zip(cuts, np.append(cuts, len(home))[1:], strict=True):
                sink = pa.BufferOutputStream()
                part = table.slice(a, b - a).combine_chunks()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(part)
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=["home", "data"])

    placed = docs.select("doc_id", "text", F.expr(f"pmod(xxhash64(doc_id, length(text)), {count}L)").alias("home"))
    return placed.mapInArrow(run, "home BIGINT, data BINARY")


class Home:
    """Tokens of one home: ``ids`` of its documents; per token its document, word and context number, bigram number."""

    def __init__(self, blobs: list[bytes]):
        self.ids: list[int | None] = []
        tokens, sizes = [], []
        for blob in sorted(blobs):  # the same order whenever the home is read
            table = pa.ipc.open_stream(blob).read_all()
            self.ids += table.column("doc_id").to_pylist()
            for _, texts in text_chunks(table.select(["text"]).to_batches()):
                _, _, words, at, _ = words_of(texts)
                tokens += [x for a, b in zip(at[:-1], at[1:], strict=True) for x in (words[a:b], END.reshape(1))]
                sizes.append(np.diff(at) + 1)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        words = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        context = np.concatenate([np.full(1, START), words[:-1]]) if len(words) else words
        context[self.begins] = START
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train = np.array([i is not None and not held_out(i) for i in self.ids], dtype=bool)
        bigrams = mix(context * np.uint64(0xD6E8FEB86659FD93) + words)
        self.words, number = np.unique(np.concatenate([words, START.reshape(1)]) if len(words) else words, return_inverse=True)
        self.word = number[: len(words)]
        self.context = np.roll(self.word, 1)  # a context is the token before; START before a document
        self.context[self.begins] = number[-1:]
        self.bigrams, self.bigram = np.unique(bigrams, return_inverse=True)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the home's words and bigrams; START counts documents."""
        weight = self.train[self.doc].astype(np.int64) if len(self.doc) else np.zeros(0, np.int64)
        words = np.bincount(self.word, weight, len(self.words)).astype(np.int64)
        words[self.words == START] = self.train.sum()
        return words, np.bincount(self.bigram, weight, len(self.bigrams)).astype(np.int64)


def _starts(parts: int) -> np.ndarray:
    return np.array([-(-(p << 64) // parts) for p in range(parts)], dtype=np.uint64)


def _requests(placed: DataFrame, parts: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        name, home = group.column("home")[0].as_py(), Home(group.column("data").to_pylist())
        rows = []
        for kind, (types, counts) in enumerate(zip((home.words, home.bigrams), home.counts(), strict=True)):
            cuts = np.append(np.searchsorted(types, _starts(parts)), len(types))
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    rows.append((kind, p, name, zlib.compress(pack_sorted(types[a:b]) + pack(counts[a:b]), 1)))
        columns = zip(*rows, strict=True)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "part", "home", "data"), columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)})

    return placed.groupBy("home").applyInArrow(run, _REQUEST)


def _answers(requests: DataFrame) -> DataFrame:
    """Total counts in the order of each request; types and tokens of the range on the rows of home -1."""

    def run(group: pa.Table) -> pa.Table:
        kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
        types, counts, sizes = [], [], []
        for blob in group.column("data").to_pylist():
            data = zlib.decompress(blob)
            t, at = unpack_sorted(data)
            types.append(t)
            counts.append(unpack(data, at)[0].astype(np.int64))
            sizes.append(len(t))
        kinds, number = np.unique(np.concatenate(types), return_inverse=True)
        total = np.bincount(number, np.concatenate(counts), len(kinds)).astype(np.int64)
        back = np.split(total[number], np.cumsum(sizes)[:-1])
        real = total[kinds != START] if kind == 0 else total[:0]
        names = group.column("home").to_pylist()
        return pa.table(
            {
                "home": pa.array([-1, *names], pa.int64()),
                "kind": pa.array([kind] * (len(names) + 1), pa.int32()),
                "part": pa.array([part] * (len(names) + 1), pa.int64()),
                "data": pa.array([b"", *(zlib.compress(pack(b), 1) for b in back)], pa.binary()),
                "types": pa.array([int((real > 0).sum())] + [0] * len(names), pa.int64()),
                "tokens": pa.array([int(real.sum())] + [0] * len(names), pa.int64()),
            }
        )

    return requests.groupBy("kind", "part").applyInArrow(run, _ANSWER)


def _filled(texts: pa.Table, answers: pa.Table) -> tuple[Home, np.ndarray, np.ndarray]:
    """A home with the corpus counts of its words and bigrams."""
    home, found = Home(texts.column("data").to_pylist()), ([], [])
    rows = sorted(zip(answers.column("kind").to_pylist(), answers.column("part").to_pylist(), answers.column("data").to_pylist(), strict=True))
    for kind, _, data in rows:
        found[kind].append(unpack(zlib.decompress(data))[0].astype(np.int64))
    return home, np.concatenate(found[0]), np.concatenate(found[1])


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the whole part of its binary logarithm."""
    return np.where(count > 0, np.frexp(np.maximum(count, 1).astype(float))[1], 0)


def count_cells(bucket: np.ndarray, q2: np.ndarray, q1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (bucket, q2, q1) in ascending order, and how often each occurs. One number stands for the three: buckets are
    below 65, and the logarithms of estimates between 2**-64 and 1 within 64 * ``GRID`` of 0."""
    wide = np.int64(128 * GRID)
    half = wide // 2
    codes, n = np.unique((bucket.astype(np.int64) * wide + q2 + half) * wide + q1 + half, return_counts=True)
    left, q1 = np.divmod(codes, wide)
    bucket, q2 = np.divmod(left, wide)
    return bucket, q2 - half, q1 - half, n


def _cells(placed: DataFrame, answers: DataFrame, types: int, tokens: int) -> DataFrame:
    """(bucket, q2, q1, n): held-out events by context bucket and by bigram and unigram estimate on a logarithmic grid;
    a null is an estimate of 0. The grid bounds the rows, whatever the corpus."""

    def grid(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.round(GRID * np.log2(np.where(p > 0, p, 1.0))), 1).astype(np.int64)  # 1 stands for 0

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        home, words, bigrams = _filled(texts, own)
        live = home.train[home.doc]

        def deleted(number: np.ndarray, totals: np.ndarray) -> np.ndarray:
            pair = home.doc * len(totals) + number
            _, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
            return totals[number] - times[inverse]

        word, bigram = deleted(home.word, words), deleted(home.bigram, bigrams)
        context = deleted(home.context, words)
        left = tokens - home.sizes[home.doc]
        p2 = np.where(context > 0, bigram / np.maximum(context, 1), 0.0)
        p1 = np.where(left > 0, word / np.maximum(left, 1), 0.0)
        columns = count_cells(_bucket(context)[live], grid(p2[live]), grid(p1[live]))
        return pa.table(dict(zip(("bucket", "q2", "q1", "n"), columns, strict=True)))

    pairs = placed.groupBy("home").cogroup(answers.groupBy("home"))
    cells = pairs.applyInArrow(run, "bucket BIGINT, q2 BIGINT, q1 BIGINT, n BIGINT")
    return cells.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n"))


def mixture_weights(cells: np.ndarray, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of every bucket, of largest likelihood for the held-out cells."""
    weights = np.full((65, 3), 1 / 3)
    weights[0] = 0.0, 0.5, 0.5
    if not len(cells):
        return weights
    bucket, q2, q1, n = cells.T
    p = np.stack([np.where(q > 0, 0.0, 2.0 ** (np.minimum(q, 0) / GRID)) for q in (q2, q1)] + [np.full(len(n), 1 / (types + 1))], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        total = np.full((65, 3), 1e-3)  # no weight becomes 0, so that every word stays possible
        np.add.at(total, bucket, share)
        total[0, 0] = 0.0
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(16, -(-size // HOME_BYTES))
    placed = homes(docs, count)
    answers = park(_answers(_requests(placed, count)), "lm-answers")
    types, tokens = (x or 0 for x in answers.where("home = -1").agg(F.sum("types"), F.sum("tokens")).first())
    answers = answers.where("home >= 0").select("home", "kind", "part", "data")
    cells = _cells(placed, answers, types, tokens).collect()  # bounded by the grid
    weights = mixture_weights(np.array([tuple(c) for c in cells], dtype=np.int64).reshape(-1, 4), types)

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        home, words, bigrams = _filled(texts, own)
        word, bigram, context = words[home.word], bigrams[home.bigram], words[home.context]
        w = weights[_bucket(context)]
        p = w[:, 0] * np.where(context > 0, bigram / np.maximum(context, 1), 0.0) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (types + 1)
        docs = len(home.ids)
        return pa.table(
            {
                "doc_id": pa.array(home.ids, pa.int64()),
                "n_tokens": home.sizes,
                "n_known": np.bincount(home.doc, word > 0, docs).astype(np.int64),
                "base_score": np.bincount(home.doc, np.log10((word + 1) / (tokens + types + 1)), docs),
                "score": np.bincount(home.doc, np.log10(np.minimum(p, 1.0)), docs),
            }
        )

    scored = placed.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(run, _SCORES)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
