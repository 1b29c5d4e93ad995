"""Cross-tokenizer alignment of exact-text groups: two public tokenizers' tokens of the same bytes, grouped and counted.

Tokenizer A is a byte-level BPE, B a SentencePiece BPE; both see a space and the text. Where tokens of both end at the same byte, the
text is cut into groups; every A token of a group is linked to every B token of it.

1. Spark shuffles by full text, so each distinct text is encoded and aligned once, and its number of documents is its weight.
2. A task works in flushes of texts. Texts are cut before a space that follows a character that is no white space: no token of either
   tokenizer crosses such a place, so each distinct unit of a flush is encoded and aligned once, all units in numpy at a time. Units whose
   bytes do not come back are not trusted: their texts are encoded whole.
3. A flush sums the documents of its distinct id pairs; Spark adds these up over all flushes and finds each A id's highest count.
   The answers go back to the flushes by a join on the pair, and are grouped by flush.
4. Each flush weighs its units' links with the answers; sums over a text's units are the text's measures, which are joined to
   the documents by a 128-bit key of the text.

What a flush keeps (a unit's pairs, a text's units) is stored once, packed; a pair that stands in all texts has one row per flush.

Edge cases: null and empty texts have no tokens and zeros. So have texts whose joined tokens of either tokenizer differ from the
text (a literal U+2581, bytes that are no UTF-8). Strings of special tokens are ordinary text. Ties for an A id's highest count are all
best. Rows are joined by text, so repeated rows and ids have equal measures. A very long text is a flush of its own; a unit
without spaces is encoded whole. Empty tables give empty results; other columns are ignored, whatever their names.
"""

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstgraph.llm.common import park
from burstgraph.llm.exchange import pack, pack_sorted, unpack, unpack_sorted

MODEL_A, MODEL_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
# fixed value: how texts are cut before merging in tokenizer A
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FLUSH_WORDS, UNIT_ROWS, EXPAND, BIG_GROUP = 1_000_000, 25_000, 1_000_000, 4096
_UNIT = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+")
_STORED = "kind INT, flush BIGINT, text_key BINARY, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT, groups STRING, data BINARY"
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Tokenizers:
    """Both vocabularies: encoders, and the bytes of every id."""

    def __init__(self, vocabulary_a: bytes, model_b: bytes):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        own = [b for b in range(256) if chr(b).isprintable() and b != 32]
        alphabet = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
        model = json.loads(vocabulary_a)["model"]
        self.bytes_a = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in model["vocab"].items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else b""
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of vocabulary A do not follow its merges")
        ranks = {self.bytes_a[i]: i for i in {*merged, *(model["vocab"][c] for c in alphabet)}}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_proto=model_b)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that start with a space, by both."""
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return list(map(self.a.encode_ordinary, texts)), [ids if len(t) > 1 else [self.space] for t, ids in zip(texts, b, strict=True)]

    def whole(self, text: str, a: list[int], b: list[int]) -> bool:
        """Do the tokens of both give the text's bytes?"""
        data = text.encode(errors="replace")
        return b"".join([self.bytes_a[i] for i in a]) == data == b"".join([self.bytes_b[i] for i in b])


@dataclass
class Aligned:
    """Units: whether their bytes come back, tokens, groups and links of each, their groups as text, and their pairs with links."""

    good: np.ndarray
    sums: np.ndarray  # n_a, n_b, n_groups, n_links by unit
    groups: list[str]
    unit: np.ndarray
    pair: np.ndarray  # A id times the size of vocabulary B, plus B id
    links: np.ndarray


def _summed(unit: np.ndarray, pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((pair, unit))
    unit, pair, links = unit[order], pair[order], links[order]
    first = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (pair[1:] != pair[:-1]))) if len(unit) else np.zeros(0, int)
    return unit[first], pair[first], np.add.reduceat(links, first) if len(first) else links


def align(units: list[str], both: Tokenizers) -> Aligned:
    """Encode and align ``units``, each of which starts with a space; units that do not come back have no tokens."""
    ids_a, ids_b = both.encode(units)
    data = "".join(units).encode(errors="replace")
    good = np.ones(len(units), dtype=bool)
    flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
    if not data == b"".join(map(both.bytes_a.__getitem__, flat_a.tolist())) == b"".join(map(both.bytes_b.__getitem__, flat_b.tolist())):
        good = np.array([both.whole(u, a, b) for u, a, b in zip(units, ids_a, ids_b, strict=True)])
        ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, good, strict=True)] for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
    count_a, count_b = (np.array([len(x) for x in ids]) for ids in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(both.lengths_a[flat_a]), np.cumsum(both.lengths_b[flat_b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    in_a, in_b = (np.bincount(np.searchsorted(cuts, ends), minlength=len(cuts)) for ends in (ends_a, ends_b))
    from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    owner = np.repeat(np.arange(len(units)), count_a)[from_a] if len(cuts) else np.zeros(0, np.int64)
    links = in_a * in_b
    sums = np.stack([count_a, count_b, np.bincount(owner, minlength=len(units)), np.bincount(owner, links, minlength=len(units)).astype(np.int64)])
    small = np.flatnonzero(links <= BIG_GROUP)
    group = np.repeat(small, links[small])
    nth = np.arange(len(group)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
    size = len(both.bytes_b)
    pair = flat_a[from_a[group] + nth // in_b[group]] * size + flat_b[from_b[group] + nth % in_b[group]]
    parts = [(owner[group], pair, np.ones(len(group), np.int64))]
    for g in np.flatnonzero(links > BIG_GROUP):  # by distinct ids
        a, n = np.unique(flat_a[from_a[g] : from_a[g] + in_a[g]], return_counts=True)
        b, m = np.unique(flat_b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
        parts.append((np.full(len(a) * len(b), owner[g]), (a[:, None] * size + b).reshape(-1), (n[:, None] * m).reshape(-1)))
    named_a, named_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
    texts = [
        f"{named_a[i]}|{named_b[j]}" if n == m == 1 else f"{','.join(named_a[i : i + n])}|{','.join(named_b[j : j + m])}"
        for i, n, j, m in zip(from_a.tolist(), in_a.tolist(), from_b.tolist(), in_b.tolist(), strict=True)
    ]
    ends = np.cumsum(sums[2])
    groups = [";".join(texts[i:j]) for i, j in zip((ends - sums[2]).tolist(), ends.tolist(), strict=True)]
    return Aligned(good, sums, groups, *_summed(*(np.concatenate(x) for x in zip(*parts, strict=True))))


class _Index(dict):
    def __missing__(self, key: str) -> int:
        self[key] = place = len(self)
        return place


class Flush:
    """Distinct texts with their numbers of documents, aligned by unit."""

    def __init__(self, both: Tokenizers):
        self.both, self.index, self.keys, self.weights, self.units, self.words = both, _Index(), [], [], [], 0

    def add(self, key: bytes, data: bytes, weight: int) -> None:
        text = data.decode(errors="replace")
        cut = _UNIT.findall(" " + text) if text.encode() == data else []
        self.keys.append(key)
        self.weights.append(weight)
        self.units.append(np.fromiter(map(self.index.__getitem__, cut), np.int64, len(cut)))
        self.words += len(cut)

    def _align(self) -> tuple[np.ndarray, list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Sums and groups of every unit, and (unit, pair, links) by unit; texts with a unit not to be trusted become one unit."""
        names = list(self.index)
        found = [align(names[k : k + UNIT_ROWS], self.both) for k in range(0, max(1, len(names)), UNIT_ROWS)]
        good = np.concatenate([x.good for x in found])
        if not good.all():
            start = len(names)
            for slot, units in enumerate(self.units):
                if not good[units].all():
                    self.units[slot] = np.array([len(names)])
                    names.append("".join(names[k] for k in units.tolist()))
            found += [align([name], self.both) for name in names[start:]]
        sums, groups = np.concatenate([x.sums for x in found], axis=1), list(chain.from_iterable(x.groups for x in found))
        at = np.cumsum([0, *(x.sums.shape[1] for x in found)])
        unit = np.concatenate([x.unit + k for x, k in zip(found, at[:-1], strict=True)])
        return sums, groups, (unit, np.concatenate([x.pair for x in found]), np.concatenate([x.links for x in found]))

    def rows(self, name: int, keep_groups: bool) -> Iterator[tuple]:
        """The rows to store: measures of every text, what the last step needs, and the documents of each pair."""
        sums, groups, (unit, pair, links) = self._align()
        sizes = np.array([len(u) for u in self.units])
        text, units = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(self.units)
        totals = np.stack([np.bincount(text, row[units], minlength=len(sizes)).astype(np.int64) for row in sums], axis=1).tolist()
        for key, own, n in zip(self.keys, self.units, totals, strict=True):
            whole = ";".join([groups[k] for k in own.tolist()])
            yield (0, name, key, *n, whole if keep_groups else hashlib.sha256(whole.encode()).hexdigest() if n[0] else "", None)
        pairs, local = np.unique(pair, return_inverse=True)
        held, times = np.unique(text * sums.shape[1] + units, return_counts=True)
        text, units = held // sums.shape[1], held % sums.shape[1]
        first = np.searchsorted(unit, np.arange(sums.shape[1] + 1))
        count = np.diff(first)
        # documents of each pair: distinct (text, pair), a part of the texts at a time
        documents, weights = np.zeros(len(pairs), np.int64), np.array(self.weights)
        cost = np.cumsum(count[units])
        edges = np.searchsorted(cost, np.arange(0, cost[-1] + EXPAND, EXPAND)) if len(cost) else np.zeros(1, int)
        edges = np.unique(np.append(np.searchsorted(text, text[edges[edges < len(text)]]), len(text)))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            n = count[units[a:b]]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[units[a:b]], n)
            seen = np.unique(np.repeat(text[a:b], n) * len(pairs) + local[at])
            documents += np.bincount(seen % max(1, len(pairs)), weights[seen // max(1, len(pairs))], minlength=len(pairs)).astype(np.int64)
        order = np.argsort(-np.bincount(units, minlength=sums.shape[1]), kind="stable")  # frequent units first: small numbers
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        n = count[order]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[order], n)
        by = np.lexsort((rank[units], text))
        step = np.diff(rank[units][by], prepend=0)
        heads = np.append(True, text[1:] != text[:-1]) if len(text) else np.zeros(0, bool)
        step[heads] = rank[units][by][heads]
        kept = [n, local[at], links[at], np.bincount(text, minlength=len(sizes)), step, times[by]]
        yield (1, name, None, len(self.keys), *[None] * 4, b"".join(self.keys) + squeeze([x.astype(np.uint64) for x in kept]))
        yield (2, name, None, *[None] * 5, pack_sorted(pairs.astype(np.uint64)) + pack(documents.astype(np.uint64)))


def squeeze(columns: list[np.ndarray]) -> bytes:
    """Columns of unsigned integers, each as compressed byte planes."""
    out = []
    for column in columns:
        data = zlib.compress(pack(column), 1)
        out.append(struct.pack("<I", len(data)) + data)
    return b"".join(out)


def unsqueeze(data: bytes, at: int = 0) -> list[np.ndarray]:
    out = []
    while at < len(data):
        (size,) = struct.unpack_from("<I", data, at)
        out.append(unpack(zlib.decompress(data[at + 4 : at + 4 + size]))[0].astype(np.int64))
        at += 4 + size
    return out


def weigh(columns: list[np.ndarray], values: np.ndarray) -> list[np.ndarray]:
    """For each row of ``values`` (by the flush's pair), its sum over the links of every text."""
    count, local, links, sizes, step, times = columns
    unit = np.repeat(np.arange(len(count)), count)
    text = np.repeat(np.arange(len(sizes)), sizes)
    running = np.cumsum(step)
    units = running - np.repeat(np.append(0, running)[np.cumsum(sizes) - sizes], sizes)
    out = []
    for row in values:
        by_unit, by_text = np.zeros(len(count), np.int64), np.zeros(len(sizes), np.int64)
        np.add.at(by_unit, unit, row[local] * links)
        np.add.at(by_text, text, by_unit[units] * times)
        out.append(by_text)
    return out


def text_key(text: str = "text"):
    """128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 32))


def _models(path_a: str, path_b: str) -> tuple[bytes, bytes]:
    with open(path_a, "rb") as a, open(path_b, "rb") as b:
        return a.read(), b.read()


def _stored(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool, flush_words: int) -> DataFrame:
    """Every distinct text encoded and aligned once."""
    models = _models(path_a, path_b)
    types = [pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.string(), pa.binary()]
    names = [part.split()[0] for part in _STORED.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, name = None, TaskContext.get().partitionId() << 24
        flush = None
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                rows = whole.slice(first, 256)
                both = both or Tokenizers(*models)
                for key, data, weight in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()).to_pylist(), rows.column(2).to_pylist(), strict=True):
                    flush = flush or Flush(both)
                    flush.add(key, data, weight)
                    if flush.words >= flush_words:
                        yield batch(list(flush.rows(name, keep_groups)))
                        flush, name = None, name + 1
        if flush:
            yield batch(list(flush.rows(name, keep_groups)))

    texts = docs.select("text").where("text IS NOT NULL AND text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("weight"))
    return park(texts.select(text_key().alias("text_key"), "text", "weight").mapInArrow(run, _STORED), "alignments", "zstd")


def _flush_pairs(stored: DataFrame) -> DataFrame:
    """(flush, at, pair, documents) of every flush's distinct pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                pairs, at = unpack_sorted(data)
                documents, _ = unpack(data, at)
                n = len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, name)), pa.array(np.arange(n)), pa.array(pairs.astype(np.int64)), pa.array(documents.astype(np.int64))],
                    names=["flush", "at", "pair", "documents"],
                )

    return stored.where("kind = 2").select("flush", "data").mapInArrow(run, "flush BIGINT, at BIGINT, pair BIGINT, documents BIGINT")


def _pair_counts(pairs: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, documents, best) corpus-wide; an A id has at most as many pairs as vocabulary B has pieces."""
    counts = pairs.groupBy("pair").agg(F.sum("documents").alias("documents")).withColumn("a", F.expr(f"pair div {size_b}"))
    return counts.selectExpr("pair", "a", "documents", "documents = max(documents) OVER (PARTITION BY a) AS best")


def _size_b(path_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path_b).get_piece_size()


def pair_counts(docs: DataFrame, path_a: str = MODEL_A, path_b: str = MODEL_B, flush_words: int = FLUSH_WORDS) -> DataFrame:
    """(a, b, documents, best): in how many documents each id pair is linked, and whether that is the most for its A id."""
    size = _size_b(path_b)
    counts = _pair_counts(_flush_pairs(_stored(docs, path_a, path_b, False, flush_words)), size)
    return counts.selectExpr("a", f"pair % {size} AS b", "documents", "best")


def aligned_groups(docs: DataFrame, path_a: str = MODEL_A, path_b: str = MODEL_B, flush_words: int = FLUSH_WORDS) -> DataFrame:
    """(doc_id, groups): every document's groups as text, ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    stored = _stored(docs, path_a, path_b, True, flush_words).where("kind = 0").select("text_key", F.col("groups").alias("found"))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"))
    return keyed.join(stored, "text_key", "left").select("doc_id", F.coalesce("found", F.lit("")).alias("groups"))


def token_alignment(docs: DataFrame, path_a: str = MODEL_A, path_b: str = MODEL_B, flush_words: int = FLUSH_WORDS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``docs``."""
    stored = _stored(docs, path_a, path_b, False, flush_words)
    pairs = _flush_pairs(stored)
    answered = pairs.drop("documents").join(_pair_counts(pairs, _size_b(path_b)).drop("a"), "pair")

    def gather(group: pa.Table) -> pa.Table:
        at = group.column("at").to_numpy()
        order = np.argsort(at)
        documents, best = group.column("documents").to_numpy()[order], group.column("best").to_numpy()[order]
        data = pack(documents.astype(np.uint64)) + pack(best.astype(np.uint64))
        return pa.table({"flush": group.column("flush")[:1], "answers": pa.array([data], pa.binary())})

    answers = answered.select("flush", "at", "documents", "best").groupBy("flush").applyInArrow(gather, "flush BIGINT, answers BINARY")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                data, found = rows.column(0)[k].as_py(), rows.column(1)[k].as_py()
                documents, at = unpack(found) if found else (np.zeros(0), 0)
                best = unpack(found, at)[0] if found else documents
                keys = rows.column(2)[k].as_py()
                columns = unsqueeze(data, 16 * keys)
                n_best, count_sum = weigh(columns, np.stack([best, documents]).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([data[16 * j : 16 * j + 16] for j in range(keys)], pa.binary()), pa.array(n_best), pa.array(count_sum)],
                    names=["text_key", "n_best", "count_sum"],
                )

    blobs = stored.where("kind = 1").select("flush", "data", F.col("n_a").alias("texts"))
    weights = blobs.join(answers, "flush", "left").select("data", "answers", "texts").mapInArrow(run, "text_key BINARY, n_best BIGINT, count_sum BIGINT")
    measures = stored.where("kind = 0").drop("kind", "flush", "data").join(weights, "text_key")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"))
    return keyed.join(measures, "text_key", "left").select(
        "doc_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in MEASURES), F.coalesce("groups", F.lit("")).alias("groups_sha256")
    )
