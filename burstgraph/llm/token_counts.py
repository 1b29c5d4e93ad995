"""Token counts that follow edits without encoding a text again.

A document is kept as its pre-tokens (the pieces that the tokenizer's pattern cuts before it merges) under a segment tree with
character and token sums. An edit replaces a span of characters: the tree finds the leaf of its first character; matching starts
two leaves earlier and goes on until a new pre-token ends where an old one began, for the pattern only looks ahead, so
everything behind is cut as before. Only the leaves in between are encoded; their sums are updated up to the root. An edit
looks at the leaves near it and at the path to the root, whatever the size of the document.

Every document gets a tree, and its count is the sum at the root. Trees are stored: a row holds the sizes and tokens of its
leaves, from which ``edit_trees`` has the tree again without cutting or encoding the text, and returns the tree as edited,
ready to be stored and edited again.

The corpus query redacts personal data: every e-mail address, IPv4 address and long digit group is an edit.

Edge cases: null and empty texts have 0 tokens and no edits. Edits may insert, delete or replace, also at the ends; they are
given by position in the text as it is then. Rows are independent, also where they repeat an id; a null id is carried along;
other columns are ignored. Of edits that overlap the first to start counts, of those that start together the shortest. A very
long text is one row and one tree; a very long pre-token is one leaf. Empty tables give empty results. Special tokens are
ordinary text.
"""

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from burstgraph.llm.common import park
from burstgraph.llm.common import pieces as row_pieces
from burstgraph.llm.exchange import pack, unpack

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how this public vocabulary's text is cut before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REDACT = (
    (r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}{2,}", "[EMAIL]"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "[IP]"),
    (r"\+?\d(?:[ ().-]{0,2}\d){8,}", "[NUMBER]"),
)
CACHE_PIECES = 300_000
_TREES = "doc_id BIGINT, n_tokens BIGINT, leaves BINARY, edits ARRAY<STRUCT<start: BIGINT, stop: BIGINT, new: STRING>>, text STRING"
_EDITED = "doc_id BIGINT, n_tokens BIGINT, n_edits BIGINT, n_tokens_edited BIGINT, n_chars_encoded BIGINT, leaves BINARY, edited STRING"


class Counter:
    """Tokens of a pre-token, remembered within a bound."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def split(self, text: str) -> tuple[list[str], np.ndarray]:
        """(pre-tokens, tokens of each) of a whole text; no token crosses a pre-token's end."""
        pieces = self.cut(text)
        tokens = self.encoding.encode_ordinary(text)
        ends = np.cumsum(self.lengths[tokens]) if tokens else np.zeros(0, np.int64)
        sizes = map(len, pieces) if text.isascii() else (len(p.encode()) for p in pieces)
        stops = np.cumsum(np.fromiter(sizes, dtype=np.int64, count=len(pieces)))
        return pieces, np.diff(np.searchsorted(ends, stops, side="right"), prepend=0)

    def tokens(self, pieces: list[str]) -> list[int]:
        known = self.known
        new = set(pieces) - known.keys()
        if len(known) + len(new) > CACHE_PIECES:
            known.clear()
            new = set(pieces)
        for piece in new:
            known[piece] = len(self.encoding.encode_ordinary(piece))
        return list(map(known.__getitem__, pieces))


class TokenTree:
    """Pre-tokens of a text with sums of characters and tokens over a complete binary tree."""

    def __init__(self, text: str, counter: Counter, stored: bytes | None = None):
        """The tree of ``text``; from ``stored`` leaves, where they are given, nothing is cut or encoded."""
        if stored is None:
            leaves, counts = counter.split(text)
        else:
            sizes, at = unpack(stored)
            stops = [0, *np.cumsum(sizes.astype(np.int64)).tolist()]
            leaves, counts = [text[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)], unpack(stored, at)[0]
        self.counter = counter
        self.leaves, self.used = leaves, len(leaves)
        self.encoded = 0  # characters encoded by edits
        self.size = 1 << max(1, len(leaves) - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.size), dtype=np.int64)
        self.sums[0, self.size : self.size + self.used] = list(map(len, leaves))
        self.sums[1, self.size : self.size + self.used] = counts
        if not leaves:
            self.leaves, self.used = [""], 1
        width = self.size
        while width > 1:
            level = self.sums[:, width : 2 * width]
            self.sums[:, width // 2 : width] = level[:, 0::2] + level[:, 1::2]
            width //= 2

    def stored(self) -> bytes:
        """Sizes and tokens of the leaves that hold text."""
        sizes, tokens = self.sums[:, self.size : self.size + self.used]
        return pack(sizes[sizes > 0]) + pack(tokens[sizes > 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, characters before it) of the character at ``at``, or of the last one when ``at`` is the end."""
        node, before = 1, 0
        at = min(at, int(self.sums[0, 1]) - 1)
        while node < self.size:
            left = int(self.sums[0, 2 * node])
            node *= 2
            if at - before >= left:
                before, node = before + left, node + 1
        return node - self.size, before

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = leaf + self.size
        change = np.array([len(text), tokens]) - self.sums[:, node]
        while node:
            self.sums[:, node] += change
            node //= 2

    def _before(self, leaf: int, count: int) -> int:
        """The leaf with text that is ``count`` such leaves earlier, or the first."""
        while leaf and count:
            leaf -= 1
            count -= self.leaves[leaf] != ""
        return leaf

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters start..stop-1 by ``new``."""
        if not int(self.sums[0, 1]):
            first = last = begin = 0
        else:
            first, begin = self.find(start)
            last = self.find(max(start, stop - 1))[0]
            back = self._before(first, 2)
            begin -= sum(map(len, self.leaves[back:first]))
            first = back
        held = "".join(self.leaves[first : last + 1])
        region = held[: start - begin] + new + held[stop - begin :]
        fixed, ahead = start - begin + len(new), 4  # matches that end before ``fixed`` cannot be old ones
        while True:
            tail = list(islice(((k, self.leaves[k]) for k in range(last + 1, self.used) if self.leaves[k]), ahead + 1))
            whole = len(tail) <= ahead
            text = region + "".join(t for _, t in tail[:ahead])
            starts, at = {len(region): last + 1}, len(region)
            for k, t in tail[:ahead]:
                starts[at] = k
                at += len(t)
            pieces, end, met = [], 0, None
            for piece in self.counter.cut(text):
                if end >= fixed and end in starts and end >= len(region):
                    met = starts[end]
                    break
                if not whole and end + len(piece) + 3 > len(text):  # may look further than the text goes
                    break
                pieces.append(piece)
                end += len(piece)
            else:
                if whole:
                    met = self.used
            if met is not None:
                break
            ahead *= 2
        self.encoded += sum(map(len, pieces))
        self._put(first, "".join(pieces), sum(self.counter.tokens(pieces)))
        for leaf in range(first + 1, met):
            if self.leaves[leaf]:
                self._put(leaf, "", 0)


def redactions(text: str, rules=REDACT) -> list[tuple[int, int, str]]:
    """Edits (start, stop, new) that do not overlap, from the last to the first, so that earlier positions stay valid."""
    found, taken = [], []
    for pattern, new in rules:
        for m in regex.finditer(pattern, text):
            found.append((m.start(), m.end(), new))
    for start, stop, new in sorted(found):
        if not taken or start >= taken[-1][1]:
            taken.append((start, stop, new))
    return taken[::-1]


def token_trees(docs: DataFrame, vocabulary: str = VOCABULARY, rules=REDACT) -> DataFrame:
    """(doc_id, n_tokens, leaves, edits, text) per row: the tree of the text, its count at the root, and the edits that
    ``rules`` ask for; text is kept where there are edits, else null. Without rules, text is always kept."""
    with open(vocabulary, "rb") as file:
        ranks = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks)
        for rows in row_pieces(batches):
            out = []
            for text in rows.column(1).to_pylist():
                leaves, counts = counter.split(text) if text else ([], np.zeros(0, np.int64))
                sizes = np.fromiter(map(len, leaves), dtype=np.int64, count=len(leaves))
                edits = [{"start": a, "stop": b, "new": new} for a, b, new in redactions(text, rules)] if text else []
                out.append((int(counts.sum()), pack(sizes) + pack(counts), edits, text if edits or not rules else None))
            tokens, leaves, edits, texts = zip(*out, strict=True)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("new", pa.string())]))
            columns = [rows.column(0).cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array(leaves, pa.binary()), pa.array(edits, kind), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "leaves", "edits", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, _TREES)


def edit_trees(trees: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_encoded, leaves, edited) per row of ``trees`` (doc_id, n_tokens,
    leaves, edits, text): its edits are made in turn on the stored tree. leaves is the tree and edited the text after them; edited
    is null where there are none; n_chars_encoded is what the edits had to encode."""
    with open(vocabulary, "rb") as file:
        ranks = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks)
        for rows in row_pieces(batches):
            out = []
            for tokens, stored, edits, text in zip(*(rows.column(k).to_pylist() for k in range(1, 5)), strict=True):
                if not edits:
                    out.append((0, tokens, 0, stored, None))
                    continue
                tree = TokenTree(text or "", counter, stored)
                for edit in edits:
                    tree.edit(edit["start"], edit["stop"], edit["new"])
                out.append((len(edits), tree.tokens, tree.encoded, tree.stored(), tree.text()))
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *made], names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded", "leaves", "edited"])

    return trees.select("doc_id", "n_tokens", "leaves", "edits", "text").mapInArrow(run, _EDITED)


def edited_counts(docs: DataFrame, vocabulary: str = VOCABULARY, rules=REDACT) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_encoded, edited) per row, from the stored trees of ``docs``."""
    trees = park(token_trees(docs, vocabulary, rules), "token-trees", "zstd")
    return edit_trees(trees, vocabulary).drop("leaves")
