"""Language ID by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word is the sum over all its
segmentations of the product of piece probabilities, by the forward algorithm; a text's is the product over its words (runs
of letters, lower-cased, with the vocabulary's word mark). The language of largest probability wins.

Learning: for each language at most ``DOCS_PER_LANGUAGE`` documents, those of smallest id hash among the allowed ones, give
their word counts; ``ROUNDS`` rounds of expectation-maximisation (forward-backward, starting from equal weights) give the
piece probabilities, smoothed by ``SMOOTHING`` per piece. This bound is a parameter; prediction reads all of every text. Languages
learn in parallel, one task each.

Scores are posteriors under equal priors, sharpened no further than one piece of evidence per ``TEMPER`` words so that they stay
comparable between short and long texts.

Edge cases: null texts and texts without a letter are ``und`` with score 0. Ties go to the alphabetically first language. With
nothing to learn from, every text is ``und``. Rows with a null doc_id count as not held out and are not learned from.
Rows are independent; other columns are ignored. Empty tables give empty results.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstgraph.llm.common import bound_batches, tidy
from burstgraph.llm.common import pieces as row_pieces
from burstgraph.llm.vocabulary import MODEL, SPACE, Lattice, Pieces, by_length, load

DOCS_PER_LANGUAGE, ROUNDS, SMOOTHING, TEMPER, FOLDS = 300, 3, 0.01, 20.0, 5
CACHE_WORDS = 300_000
_LETTERS = regex.compile(r"\p{L}+")


def words_in(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall(text.lower())


def _log_sums(words: list[bytes], table: Pieces, probabilities: np.ndarray) -> np.ndarray:
    """Log probability of every word (rows) in every language (columns), over all segmentations."""
    out = np.zeros((len(words), probabilities.shape[1]))
    for numbers, matrix in by_length(words):
        lattice, languages = Lattice(table, matrix), probabilities.shape[1]
        # scaled by word and position, so that long words do not vanish
        alpha, scale = np.zeros((lattice.n + 1, len(matrix), languages)), np.zeros((lattice.n + 1, len(matrix), languages))
        alpha[0] = 1.0
        for j in range(1, lattice.n + 1):
            scale[j] = scale[j - 1]
            alpha[j] = alpha[j - 1] * probabilities[table.bytes_at[matrix[:, j - 1]]]
            for i in lattice.spans(j):
                at, found = lattice.at(i, j)
                if len(at):
                    alpha[j, at] += alpha[i, at] * np.exp(scale[i, at] - scale[j, at]) * probabilities[found]
            top = alpha[j]
            scale[j] += np.log(top)
            alpha[j] = 1.0
        out[numbers] = scale[lattice.n]
    return out


def learn(words: dict[bytes, int], table: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of largest likelihood for these word counts, by expectation-maximisation."""
    size = len(table.pieces)
    names, times = list(words), np.array(list(words.values()), dtype=np.float64)
    usable = np.concatenate([table.ids, table.bytes_at])
    p = np.zeros(size)
    p[usable] = 1.0 / len(usable)
    groups = [(times[numbers], matrix) for numbers, matrix in by_length(names)]
    for _ in range(rounds):
        counts = np.zeros(size)
        for weight, matrix in groups:
            lattice, n = Lattice(table, matrix), matrix.shape[1]
            arcs = {}
            alpha = np.zeros((n + 1, len(matrix)))
            alpha[0] = 1.0
            for j in range(1, n + 1):
                single = table.bytes_at[matrix[:, j - 1]]
                alpha[j] = alpha[j - 1] * p[single]
                for i in lattice.spans(j):
                    arcs[i, j] = at, found = lattice.at(i, j)
                    alpha[j, at] += alpha[i, at] * p[found]
            beta = np.zeros_like(alpha)
            beta[n] = weight / np.maximum(alpha[n], 1e-300)
            for j in range(n, 0, -1):
                single = table.bytes_at[matrix[:, j - 1]]
                beta[j - 1] += beta[j] * p[single]
                np.add.at(counts, single, alpha[j - 1] * p[single] * beta[j])
                for i in lattice.spans(j):
                    at, found = arcs[i, j]
                    share = p[found] * beta[j, at]
                    beta[i, at] += share
                    np.add.at(counts, found, alpha[i, at] * share)
        p = np.zeros(size)
        p[usable] = counts[usable] + SMOOTHING
        p /= p.sum()
    return p


def piece_models(docs: DataFrame, path: str = MODEL, per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages in order, piece probabilities with a column per language)."""
    table = load(path)
    allowed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = allowed.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("doc_id", "lang").distinct()
    sample = allowed.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])  # per_language rows a language

    def fit(group: pa.Table) -> pa.Table:
        counts: Counter[str] = Counter()
        for text in group.column("text").to_pylist():
            counts.update(words_in(text))
        p = learn({SPACE + w.encode(): n for w, n in counts.items()}, table)
        return pa.table({"lang": pa.array([group.column("lang")[0].as_py()], pa.string()), "p": pa.array([p.astype("<f8").tobytes()], pa.binary())})

    rows = sorted(sample.groupBy("lang").applyInArrow(fit, "lang STRING, p BINARY").collect())
    return [r["lang"] for r in rows], np.array([np.frombuffer(r["p"], "<f8") for r in rows]).T


class Predictor:
    """Languages and scores of texts; remembers words within a bound."""

    def __init__(self, languages: list[str], probabilities: np.ndarray, table: Pieces):
        self.languages, self.probabilities, self.table = languages, probabilities, table
        self.known: dict[str, int] = {}
        self.values = np.zeros((0, len(languages)))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [words_in(t or "") if self.languages else [] for t in texts]
        new = list({w for t in words for w in t} - self.known.keys())
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.values, new = {}, self.values[:0], list({w for t in words for w in t})
        self.known.update(zip(new, range(len(self.values), len(self.values) + len(new)), strict=True))
        if new:
            self.values = np.concatenate([self.values, _log_sums([SPACE + w.encode() for w in new], self.table, self.probabilities)])
        names, scores = [], []
        for own in words:
            if not own:
                names.append("und")
                scores.append(0.0)
                continue
            total = self.values[list(map(self.known.__getitem__, own))].sum(axis=0)
            odds = np.exp((total - total.max()) / max(1.0, len(own) / TEMPER))
            names.append(self.languages[int(np.argmax(total))])
            scores.append(float(odds.max() / odds.sum()))
        return names, scores


def predict_languages(docs: DataFrame, languages: list[str], probabilities: np.ndarray, path: str = MODEL) -> DataFrame:
    """(doc_id, lang_pred, score) of the rows of ``docs`` (doc_id, text)."""
    table = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(languages, probabilities, table)
        for rows in row_pieces(batches, 1000):
            names, scores = predict(rows.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id BIGINT, lang_pred STRING, score DOUBLE")


def told_apart(docs: DataFrame, least: float, path: str = MODEL) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a letter and a language with a score of at least ``least``."""
    languages, probabilities = piece_models(docs, path)
    table = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(languages, probabilities, table)
        for rows in row_pieces(batches, 1000):
            names, scores = predict(rows.column(rows.schema.get_field_index("text")).to_pylist())
            yield rows.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return bound_batches(docs).mapInArrow(tidy(run), docs.schema)


def language_id(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row."""
    predicted = predict_languages(docs, *piece_models(docs, path), path)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
