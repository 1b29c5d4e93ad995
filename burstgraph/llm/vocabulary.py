"""A fixed public piece vocabulary and the lattice of its pieces over words.

The vocabulary file is read on the driver; its tables (a few hundred kilobytes, fixed by the file) travel with the functions
that use them. Words are UTF-8 bytes; words of equal length stand in one matrix and advance together. A substring is found by
its hash among the sorted hashes of the pieces.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from burstgraph.llm.common import BYTE_CODES, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁".encode()
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


_TOP = 20  # bits of a hash that the first test looks at


@dataclass(frozen=True)
class Pieces:
    """Pieces as bytes; hashes of the usable ones in ascending order with their ids; the place of the first key of each
    leading hash bits, or -1, and the most keys that share them; the ids of the 256 single bytes."""

    pieces: tuple[bytes, ...]
    scores: np.ndarray
    keys: np.ndarray
    ids: np.ndarray
    tops: np.ndarray
    deepest: int
    bytes_at: np.ndarray
    longest: int

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes that are pieces, ids of those pieces)."""
        at = self.tops.take(hashes >> np.uint64(64 - _TOP))
        maybe = np.flatnonzero(at >= 0)
        wanted, at = hashes.take(maybe), at.take(maybe)
        for _ in range(self.deepest - 1):  # few keys share their leading bits
            at += (self.keys.take(at) < wanted) & (at < len(self.keys) - 1)
        hit = self.keys.take(at) == wanted
        return maybe[hit], self.ids.take(at[hit])


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> Pieces:
    """Read a SentencePiece model with byte fallback."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    raw, usable, bytes_at = [], [], np.full(256, -1)
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw.append(bytes([int(piece[3:-1], 16)]))
            bytes_at[raw[-1][0]] = i
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            raw.append(piece.encode())
            usable.append(i)
    if (bytes_at < 0).any():
        raise ValueError("the vocabulary has no byte fallback")
    scores = np.array([model.get_score(i) for i in range(size)])
    usable = np.array(usable)
    hashes = np.array([_whole_hash(raw[i]) for i in usable], dtype=np.uint64)
    order = np.argsort(hashes)
    leading, first, shared = np.unique(hashes[order] >> np.uint64(64 - _TOP), return_index=True, return_counts=True)
    tops = np.full(1 << _TOP, -1, dtype=np.int32)
    tops[leading] = first
    return Pieces(tuple(raw), scores, hashes[order], usable[order], tops, int(shared.max()), bytes_at, max(len(raw[i]) for i in usable))


def _column_sums(matrix: np.ndarray) -> np.ndarray:
    """Row j holds, for every word of ``matrix``, the weighted sum of its first j bytes."""
    up, _ = powers(matrix.shape[1] + 1)
    sums = np.zeros((matrix.shape[1] + 1, matrix.shape[0]), dtype=np.uint64)
    np.cumsum(BYTE_CODES[matrix.T] * up[: matrix.shape[1], None], axis=0, out=sums[1:])
    return sums


def _gram_hashes(sums: np.ndarray, length: int) -> np.ndarray:
    """Row i holds the hash of bytes i..i+length-1 of every word."""
    _, down = powers(len(sums))
    x = (sums[length:] - sums[:-length]) * down[: len(sums) - length, None]
    return (x ^ (x >> np.uint64(32))) * _SPREAD


def _whole_hash(piece: bytes) -> int:
    return int(_gram_hashes(_column_sums(np.frombuffer(piece, np.uint8)[None]), len(piece))[0, 0])


def by_length(words: list[bytes], cells: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, byte matrix) of words of equal length, about ``cells`` bytes at a time."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
        n = int(sizes[group[0]])
        if n:
            step = max(1, cells // n)
            for first in range(0, len(group), step):
                part = group[first : first + step]
                yield part, np.frombuffer(b"".join(words[k] for k in part), np.uint8).reshape(len(part), n)


class Lattice:
    """Pieces over the words of one matrix: row i of ``ids[k]`` holds the piece that bytes i..i+k-1 of every word are, or -1."""

    def __init__(self, table: Pieces, matrix: np.ndarray):
        self.n = matrix.shape[1]
        self.longest = min(self.n, table.longest)
        sums = _column_sums(matrix)
        self.ids: list[np.ndarray | None] = [None]
        for length in range(1, self.longest + 1):
            hashes = _gram_hashes(sums, length)
            found = np.full(hashes.size, -1, dtype=np.int32)
            at, ids = table.find(hashes.reshape(-1))
            found[at] = ids
            self.ids.append(found.reshape(hashes.shape))

    def at(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(words whose bytes i..j-1 are a piece, its id)."""
        row = self.ids[j - i][i]
        words = np.flatnonzero(row >= 0)
        return words, row[words]

    def spans(self, j: int) -> range:
        """Starts of the pieces that may end at j."""
        return range(max(0, j - self.longest), j)
