"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Two documents link when the Jaccard similarity of their word-shingle sets reaches the threshold; documents with equal sets
are one node. How the pairs are found:

1. Shingles that no other document has cannot be shared. The token exchange returns each document's repeated shingles
   with their document counts; a document with fewer than threshold x size of them links with nothing.
2. A document enters the tiles of the rarest shingles of its set, as many as must contain a shared one (size minus least
   overlap plus 1), minus those nobody else has. A tile is a shingle and a band of set sizes; a band spans one factor of the threshold, so
   partners are in the same or the next band.
3. Members first meet only centres drawn from their tile, turn by turn, so a tile of near copies costs its members, not its
   pairs. Tiles whose members then form one component hold nothing new. When turns no longer help, or few pairs remain, all
   members of different components meet in the tiles left, if sizes and places in the common order allow the least overlap.
4. A pair is tested by signatures: bits that one side has alone bound the overlap from above. What passes is intersected
   exactly on the sorted shingle arrays.

Edge cases: null, empty and blank texts have an empty set and link with nothing. Fewer than ``words`` words make one shingle.
Rows with a null id are sized but neither link nor get a component. Rows repeating an id are judged row by row. Empty tables
give empty results; other columns are ignored. Sets hold 64-bit hashes, of which 48 bits are compared.
"""

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstgraph.llm.common import bound_batches, digest64, forget, park, pieces, release, shingle_sets, text_chunks, tidy
from burstgraph.llm.exchange import gather, ranges_for, repeated, send
from burstgraph.operators.components import component_labels

WORDS, PERCENT, SIGNATURE_BYTES = 5, 75, 128
CENTRES = 4  # drawn per tile and turn after the first
PAIRS_PER_ROW, STALLED = 2, 0.9  # compare the remaining pairs when they are so few per row, or when a turn leaves so many
_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("text_key", pa.int64())])
_MEMBERS = "node BIGINT, size BIGINT, tokens BINARY, counts BINARY, signature BINARY"


def least_overlap(a, b, percent: int):
    """Smallest overlap of sets of a and b elements that reaches the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def set_sizes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, node, text_key) per row; node identifies the set and is null for an empty one; text_key is the
    xxhash64 of the text, to tell rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            sets = shingle_sets(texts, words)
            nodes = [digest64(s.tobytes()) if len(s) else None for s in sets]
            columns = [rows.column(0).cast(pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.int64()), rows.column(2)]
            yield pa.RecordBatch.from_arrays(columns, schema=_SETS)

    rows = bound_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(tidy(run), "doc_id BIGINT, n_shingles BIGINT, node BIGINT, text_key BIGINT")


def _members(docs: DataFrame, parts: int, words: int, percent: int) -> DataFrame:
    """Sets that can link: (node, size, repeated tokens in order, their counts, signature)."""

    def tokens_of(batches):
        for _, texts in text_chunks(batches):
            for s in shingle_sets(texts, words):
                if len(s):
                    yield digest64(s.tobytes()), len(s), s

    def home(group: pa.Table) -> pa.Table:
        release()
        out = []
        for node, size, tokens, counts in gather(group):
            if 100 * len(tokens) >= percent * size:
                out.append((node, size, tokens.astype("<u8").tobytes(), counts.astype(np.uint8).tobytes(), signature(tokens)))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("node", "size", "tokens", "counts", "signature"), columns, kinds, strict=True)})

    found = repeated(send(docs.where("doc_id IS NOT NULL").select("text"), parts, tokens_of))
    # copies of a set came from several tasks; their returned tokens are the same
    return found.groupBy("flush").applyInArrow(home, _MEMBERS).dropDuplicates(["node"])


def signature(tokens: np.ndarray) -> bytes:
    """Bitmap with one bit per token, at a hashed place."""
    bits = np.zeros(SIGNATURE_BYTES * 8, dtype=np.uint8)
    bits[(tokens * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (SIGNATURE_BYTES * 8 - 1).bit_length())] = 1
    return np.packbits(bits).tobytes()


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """(token, band, node, size, place): each member under the rarest tokens of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = -log(percent / 100)
        for batch in batches:
            out = {k: [] for k in ("token", "band", "node", "size", "place")}
            for node, size, tokens, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                tokens, counts = np.frombuffer(tokens, "<u8"), np.frombuffer(counts, np.uint8)
                alone = size - len(tokens)
                wanted = size - -(-percent * size // 100) + 1 - alone
                first = np.lexsort((tokens, counts))[:wanted]
                out["token"].append(tokens[first].astype(np.int64))
                out["place"].append(np.arange(alone, alone + len(first)))
                for k, v in (("node", node), ("size", size), ("band", int(log(size) / step))):
                    out[k].append(np.full(len(first), v, dtype=np.int64))
            yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(v) if v else [], pa.int64()) for k, v in out.items()})

    schema = "token BIGINT, band BIGINT, node BIGINT, size BIGINT, place BIGINT"
    return members.select("node", "size", "tokens", "counts").mapInArrow(tidy(run), schema)


def _verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose sets reach the threshold: signatures first, then the sorted arrays."""

    def side(columns: tuple[str, ...], name: str) -> DataFrame:
        return members.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    def by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = dict(zip(batch.schema.names, batch.columns, strict=True))
            if not batch.num_rows:
                continue
            size, rep = ({s: c[f"{k}_{s}"].to_numpy() for s in "ab"} for k in ("size", "held"))
            bits = {s: np.frombuffer(b"".join(c[f"signature_{s}"].to_pylist()), np.uint64).reshape(batch.num_rows, -1) for s in "ab"}
            bound = np.minimum(*(rep[s] - np.bitwise_count(bits[s] & ~bits[t]).sum(axis=1, dtype=np.int64) for s, t in ("ab", "ba")))
            keep = bound >= least_overlap(size["a"], size["b"], percent)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    def by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep = []
            for size_a, ta, size_b, tb in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("size_a", "tokens_a", "size_b", "tokens_b")), strict=True):
                both = np.intersect1d(np.frombuffer(ta, "<u8"), np.frombuffer(tb, "<u8"), assume_unique=True)
                keep.append(len(both) >= least_overlap(size_a, size_b, percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    light = members.withColumn("held", F.expr("length(tokens) div 8"))
    bits = [light.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("size", "held", "signature"))) for s in "ab"]
    near = pairs.join(bits[0], "a").join(bits[1], "b").mapInArrow(tidy(by_bits), "a BIGINT, b BIGINT")
    return near.join(side(("size", "tokens"), "a"), "a").join(side(("size", "tokens"), "b"), "b").mapInArrow(tidy(by_sets), "a BIGINT, b BIGINT")


def similar_sets(docs: DataFrame, sizes: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, component) of every set that links with a different set; component is one of its nodes."""
    total = sizes.where("node IS NOT NULL AND doc_id IS NOT NULL").agg(F.sum("n_shingles")).first()[0] or 0
    members = park(_members(docs, ranges_for(total), words, percent), "jaccard-members")
    tiles = park(_tiles(members, percent), "jaccard-tiles")

    links, labels, open_tiles, before, turn = None, None, None, None, 0
    while True:
        last = open_tiles
        if labels is None:
            open_tiles = tiles.withColumn("component", F.col("node"))
        else:
            open_tiles = tiles.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # pairs of a tile that are in different components: all pairs minus those inside each component
        apart = (
            open_tiles.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("token").agg(((F.pow(F.sum("n"), 2) - F.sum(F.pow("n", 2))) / F.sum("n")).alias("pairs"), F.count(F.lit(1)).alias("components"))
            .where("components > 1").select("token", "pairs")
        )
        open_tiles = park(open_tiles.join(apart, "token"), "jaccard-open")
        forget(last)
        # each of a tile's n rows brings its share of the tile's pairs
        rows, pairs = open_tiles.agg(F.count(F.lit(1)), F.coalesce(F.sum("pairs"), F.lit(0.0))).first()
        if turn and (pairs <= PAIRS_PER_ROW * rows or before is not None and pairs > STALLED * before):
            break
        before, turn = (pairs if turn else None), turn + 1
        found = park(_verified(_centre_pairs(open_tiles, turn, percent), members, percent), "jaccard-links")
        # the labels so far stand for all earlier links
        links = found if labels is None else labels.selectExpr("node AS a", "component AS b").union(found)
        last = labels
        labels = park(component_labels(links.selectExpr("a AS src", "b AS dst")).withColumnRenamed("id", "node"), "jaccard-labels")
        forget(last)
        forget(found)

    other = open_tiles.selectExpr("token", "explode(array(band, band + 1)) AS band", "node AS node2", "size AS size2", "place AS place2", "component AS component2")
    fits = (
        f"component <> component2 AND (size2 < size OR size2 = size AND node2 < node) AND 100 * size2 >= {percent} * size"
        f" AND least(size - place, size2 - place2) * {100 + percent} >= {percent} * (size + size2)"
    )
    rest = open_tiles.join(other, ["token", "band"]).where(fits).selectExpr("least(node, node2) AS a", "greatest(node, node2) AS b").distinct()
    links = labels.selectExpr("node AS a", "component AS b").union(_verified(rest, members, percent))
    return component_labels(links.selectExpr("a AS src", "b AS dst")).withColumnRenamed("id", "node")


def _centre_pairs(tiles: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): each member of a tile with the tile's centres, where they are of different components and fit in size.

    Centres are the members of smallest hash, which tiles of the same documents agree on; each turn draws others.
    """
    draws = [F.min(F.struct(F.xxhash64("node", F.lit(turn), F.lit(k)).alias("h"), F.col("node").alias("centre"), "size", "component")) for k in range(1 if turn == 1 else CENTRES)]
    centres = tiles.groupBy("token").agg(F.array_distinct(F.array(*draws)).alias("c")).selectExpr("token", "explode(c) AS c")
    close = f"100 * least(size, c.size) >= {percent} * greatest(size, c.size)"
    met = tiles.join(centres, "token").where(f"component <> c.component AND {close}")
    return met.selectExpr("least(node, c.centre) AS a", "greatest(node, c.centre) AS b").distinct()


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``: component_id is the smallest doc_id reachable by links."""
    return components_by_text(docs, words, percent).drop("text_key")


def components_by_text(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``jaccard_components`` with text_key, the xxhash64 of the row's text: it tells rows that repeat an id apart."""
    sizes = park(set_sizes(docs, words), "jaccard-sizes")
    found = park(similar_sets(docs, sizes, words, percent), "jaccard-components")
    named = sizes.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = named.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    answers = placed.join(least, "component").select("node", "component_id")
    return sizes.join(answers, "node", "left").selectExpr(
        "doc_id", "n_shingles", "CASE WHEN doc_id IS NOT NULL THEN coalesce(component_id, doc_id) END AS component_id", "text_key"
    )
