"""Quality classifier with hierarchical empirical Bayes.

1. A logistic regression on surface features of the whole text (case, symbols, digits, repetition, word length and number) gives
   each document its own probability of being good. It is fitted on at most ``FIT_ROWS`` labelled documents, those of
   smallest id hash; the bound is a parameter, everything below covers all rows.
2. Grouped aggregates per host and per (host, path) hold how many documents and how much quality they have: the label where there is
   one, else the document's probability. A path's share is shrunk toward its host's, a host's toward the global one; the
   strengths come from the spread between groups by the method of moments, so sparse sites stay near their prior.
3. score: the document's log odds plus how far its path's log odds are from the global ones. A document's own evidence is
   taken out of its site's sums first. ``keep`` is score >= ``LEAST``.

Edge cases: null and empty texts have all features 0 except the constant. A null host or path counts as the empty name. Labels
that are null are ignored, several for a document count with their mean. Without labels of both kinds every document has the
global share (1 without labels). Rows repeating a doc_id are judged row by row. Null ids never have a label. Other columns
are ignored. Empty tables give empty results.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstgraph.llm.common import park, text_chunks, words_of

FIT_ROWS, STEPS, RIDGE, LEAST = 50_000, 15, 0.01, 0.5
FEATURES = ("one", "upper", "symbols", "digits", "stutter", "repetition", "word_length", "words", "gaps")
_CLASSES = np.zeros((4, 256), dtype=bool)
_CLASSES[0, 65:91] = True
_CLASSES[1, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_CLASSES[1, [ord(c) for c in ".,;:'\"-()?"]] = False
_CLASSES[2, 48:58] = True
_CLASSES[3, [9, 10, 11, 12, 13, 32]] = True


def features(texts: list[bytes]) -> np.ndarray:
    """A row of ``FEATURES`` per text, each about 0 to 1."""
    _, _, words, at, joined = words_of(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    size = np.maximum(1, np.diff(begins) - 1)
    per = [np.diff(np.concatenate([[0], np.cumsum(c[data])])[begins]) for c in _CLASSES]
    per[3] = per[3] - 1  # the blank between texts
    count = np.diff(at)
    doc = np.repeat(np.arange(len(texts)), count)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    stutter = np.bincount(doc, again, len(texts))
    order = np.lexsort((words, doc))
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], new, len(texts))
    many = np.maximum(1, count)
    return np.stack(
        [
            np.ones(len(texts)), per[0] / size, per[1] / size, per[2] / size, stutter / many,
            (1 - distinct / many) * (count > 0), np.minimum(1, (size - per[3]) / many / 20) * (count > 0), np.log1p(count) / 10, per[3] / size,
        ],
        axis=1,
    )


def _featured(docs: DataFrame, host: str, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            f = pa.array(features(texts).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), f], names=["doc_id", "host", "path", "f"])

    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((host, "host"), (path, "path"))]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *names)
    return rows.mapInArrow(run, "doc_id BIGINT, host STRING, path STRING, f ARRAY<DOUBLE>")


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (y - p) - RIDGE * w)
    return w


def strength(groups: DataFrame, share: float) -> float:
    """Pseudo-counts of the prior over groups (n, good): large when groups hardly differ beyond chance."""
    row = groups.agg(
        F.sum("n"), F.sum(F.expr("CAST(n AS DOUBLE) * n")), F.count(F.lit(1)), F.sum(F.expr(f"n * pow(good / n - {share}, 2)"))
    ).first()
    total, squares, count, spread = (float(v or 0) for v in row)
    noise = share * (1 - share)
    free = total - squares / total if total else 0.0
    between = max(0.0, (spread - (count - 1) * noise) / free) if free > 0 else 0.0
    part = min(0.99, max(1e-4, between / noise)) if noise > 0 else 1e-4
    return (1 - part) / part


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = LEAST) -> DataFrame:
    """(doc_id, doc_score, site_score, score, keep) per row of ``docs``."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("label"))
    rows = park(_featured(docs, host, path).join(known, "doc_id", "left"), "quality-features")
    some = rows.where("label IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select("f", "label").collect()
    y = np.array([r["label"] for r in some])
    share = float(y.mean()) if len(y) else 1.0
    if 0 < share < 1:
        w = fit(np.array([r["f"] for r in some]), y)
        odds = " + ".join(f"f[{k}] * {float(v)!r}D" for k, v in enumerate(w))
        p = F.expr(f"1 / (1 + exp(-least(30D, greatest(-30D, {odds}))))")
    else:
        p = F.lit(share)
    rows = rows.select("doc_id", "host", "path", p.alias("p"), F.coalesce("label", p).alias("good"))
    paths = park(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("good") / F.sum("n")).first()[0]
    total = min(1 - 1e-6, max(1e-6, share if total is None else total))
    a, b = strength(hosts, total), strength(paths, total)
    sites = paths.join(hosts.selectExpr("host", "n AS host_n", "good AS host_good"), "host").withColumnsRenamed({"n": "path_n", "good": "path_good"})
    above = f"({a} * {total} + host_good - good) / ({a} + host_n - 1)"
    site = f"({b} * {above} + path_good - good) / ({b} + path_n - 1)"
    logit = "ln({0}) - ln(1 - {0})"
    bound = "least(0.999999D, greatest(0.000001D, {}))"
    scored = (
        rows.join(sites, ["host", "path"])
        .withColumn("site_score", F.expr(bound.format(site)))
        .withColumn("doc_score", F.expr(bound.format("p")))
        .withColumn("odds", F.expr(f"{logit.format('doc_score')} + {logit.format('site_score')} - ({logit.format(f'{total}D')})"))
        .withColumn("score", F.expr("1 / (1 + exp(-odds))"))
    )
    return scored.select("doc_id", "doc_score", "site_score", "score", (F.col("score") >= least).alias("keep"))
