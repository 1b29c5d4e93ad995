"""SentencePiece encoding and decoding by a batched numpy Viterbi.

A text gets a leading space, spaces become the space mark, and each word (with the marks before it) is split into the pieces
of largest total score. Words of equal length advance together: for every end position the substrings that end there are
probed by hash among the sorted piece keys, and vectorised maxima store the backpointers. A character in no piece is spelled
in byte pieces. Each distinct word of a chunk is encoded once; a bounded cache keeps words between chunks. A chunk's words
are told apart by hash and compared with their bytes; its pieces are gathered from those of its words, and its bytes from
those of its pieces, as arrays.

Scores: a unigram model's scores are used as they are. A BPE model stores merge ranks instead, which are no log
probabilities; there a piece of rank r gets -log(r + ``RANK_OFFSET``), Zipf's law for ranked pieces. Such a segmentation is the best path
under these scores; it differs from the merge order of the BPE library on some words (README has the figures).

Edge cases: null and empty texts have no pieces and decode to the empty text. A text that contains the space mark itself
decodes with a space instead, as in the library: ``round_trip`` is false there. Rows are independent; ties go to the longer
last piece. Empty tables give empty results; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from burstgraph.llm.common import bound_batches, prefix_sums, span_hashes, text_chunks, tidy
from burstgraph.llm.vocabulary import MODEL, SPACE, Lattice, Pieces, by_length, load

RANK_OFFSET, CACHE_WORDS, ENCODE_CHUNK = 100.0, 300_000, 1 << 20  # a chunk takes some 60 times its bytes
_MARK = np.frombuffer(SPACE, np.uint8)


def path_scores(table: Pieces) -> np.ndarray:
    """A score per piece; byte pieces cost more than any other."""
    scores = table.scores.astype(np.float64).copy()
    ranked = scores[table.ids]
    if len(ranked) and (ranked == np.round(ranked)).all():  # merge ranks
        scores = -np.log(np.maximum(0.0, -scores) + RANK_OFFSET)
    scores[table.bytes_at] = scores[table.ids].min() - 10.0
    return scores


def best_paths(words: list[bytes], table: Pieces, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the best paths of all words one after another, number of pieces of each word)."""
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]  # from the last piece of each word to its first
    for numbers, matrix in by_length(words):
        lattice, rows = Lattice(table, matrix), np.arange(len(matrix))
        n = lattice.n
        best = np.full((n + 1, len(matrix)), -np.inf)
        best[0] = 0.0
        back, piece = np.zeros((n + 1, len(matrix)), dtype=np.int32), np.zeros((n + 1, len(matrix)), dtype=np.int32)
        for j in range(1, n + 1):
            single = table.bytes_at[matrix[:, j - 1]]
            best[j], back[j], piece[j] = best[j - 1] + scores[single], j - 1, single
            highest, where, which = best[j], back[j], piece[j]
            for i in lattice.spans(j):
                live, ids = lattice.at(i, j)
                if live.size:
                    total = best[i].take(live) + scores.take(ids)
                    better = total > highest.take(live)
                    live = live[better]
                    highest[live], where[live], which[live] = total[better], i, ids[better]
        at = np.full(len(matrix), n)
        while (live := rows[at > 0]).size:
            owners.append(numbers[live])
            found.append(piece[at[live], live])
            at[live] = back[at[live], live]
    owner = np.concatenate(owners)[::-1]
    return np.concatenate(found)[::-1][np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def encode_words(words: list[bytes], table: Pieces, scores: np.ndarray) -> list[list[int]]:
    """Ids of the best path of every word."""
    ids, sizes = best_paths(words, table, scores)
    ends = np.cumsum(sizes)
    return [ids[a:b].tolist() for a, b in zip(ends - sizes, ends, strict=True)]


def word_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the words of the marked texts ``data`` start: where a text begins, and at marks that do not follow a mark."""
    size, last = len(_MARK), len(data) - len(_MARK) + 1
    marks = np.zeros(len(data) + size, dtype=bool)  # place k tells of the byte k - size
    marks[size : size + last] = np.logical_and.reduce([data[k : k + last] == _MARK[k] for k in range(size)])
    new = marks[size:] & ~marks[:-size]
    new[begins[begins < len(data)]] = True
    return np.flatnonzero(new)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... (counts[k] of them) of every k, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(counts.sum())


class Speller:
    """The bytes of pieces."""

    def __init__(self, table: Pieces):
        self.data = np.frombuffer(b"".join(table.pieces), np.uint8)
        self.sizes = np.array([len(p) for p in table.pieces])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: np.ndarray) -> bytes:
        return self.data[spread(self.starts[ids], self.sizes[ids])].tobytes()


def plain(marked: bytes) -> bytes:
    """A text without marks and without the space put before it."""
    text = marked.replace(SPACE, b" ")
    return text[1:] if text.startswith(b" ") else text


def decode(ids: list[int], table: Pieces) -> bytes:
    """The text of ``ids``."""
    return plain(b"".join(map(table.pieces.__getitem__, ids)))


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


class Encoder:
    """Encodes texts; remembers words within a bound."""

    def __init__(self, table: Pieces):
        self.table, self.scores, self.spell = table, path_scores(table), Speller(table)
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.sizes = _Numbers(), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Pieces of the words numbered since the last call."""
        new = list(self.known)[len(self.sizes) :]
        if new:
            ids, sizes = best_paths(new, self.table, self.scores)
            self.ids, self.sizes = np.append(self.ids, ids), np.append(self.sizes, sizes)

    def encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin and the last's end)."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        marked = [SPACE + t.replace(b" ", SPACE) if t else b"" for t in texts]
        joined = b"".join(marked)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        begins = np.cumsum([0, *map(len, marked)])
        number, at = self._numbered(joined, begins)
        counts = self.sizes[number]
        ids = self.ids[spread((np.cumsum(self.sizes) - self.sizes)[number], counts)]
        return ids, np.append(0, np.cumsum(counts))[np.searchsorted(at, begins)]

    def _numbered(self, joined: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of every word of the marked texts, its start), with their pieces learned."""
        data = np.frombuffer(joined, np.uint8)
        at = word_starts(data, begins)
        ends = np.append(at[1:], len(data))
        sizes = ends - at
        _, first, form = np.unique(span_hashes(prefix_sums(data), at, ends), return_index=True, return_inverse=True)
        if (sizes != sizes[first][form]).any() or (data != data[spread(at[first][form], sizes)]).any():  # two words of one hash
            first = form = np.arange(len(at))
        words = map(joined.__getitem__, map(slice, at[first].tolist(), ends[first].tolist()))
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(first))[form]
        self._learn()
        return number, at

    def __call__(self, texts: list[bytes]) -> list[list[int]]:
        ids, at = self.encoded(texts)
        return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]

    def round_trips(self, texts: list[bytes], ids: np.ndarray, at: np.ndarray) -> list[bool]:
        """Whether decoding the pieces of each text gives it back."""
        spelled = self.spell(ids)
        ends = np.append(0, np.cumsum(self.spell.sizes[ids]))[at].tolist()
        return [plain(spelled[a:b]) == t for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)]


def encode_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, piece_ids, round_trip) per row; round_trip: decoding gives the text back byte for byte."""
    table = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(table)
        for rows, texts in text_chunks(batches, chunk=ENCODE_CHUNK):
            ids, at = encode.encoded(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows.column(0).cast(pa.int64()),
                    "n_pieces": pa.array(np.diff(at), pa.int64()),
                    "piece_ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())),
                    "round_trip": pa.array(encode.round_trips(texts, ids, at), pa.bool_()),
                }
            )

    return bound_batches(docs).select("doc_id", "text").mapInArrow(tidy(run), "doc_id BIGINT, n_pieces BIGINT, piece_ids ARRAY<INT>, round_trip BOOLEAN")


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, piece_ids); null ids decode to the empty text, bytes that are no UTF-8 are dropped."""
    table = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(i or [], table).decode(errors="ignore") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "piece_ids").mapInArrow(run, "doc_id BIGINT, text STRING")
