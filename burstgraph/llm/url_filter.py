"""URL filter: rules first, then segmented tokens under multinomial naive Bayes.

* ``url_parts``: host and path of a url; ``rule_for``: the longest rule that fits.
* Host names and path parts are cut into words by a unigram Viterbi search: a word's cost is the negative logarithm of its
  share of the words of the pages' own texts; a character outside any word costs more than any word. Only strings that occur
  in urls are looked up: their substrings are joined to the word counts, nothing is broadcast.
* Naive Bayes with add-one smoothing learns from the pages that a rule judges (tokens of allowed and of blocked urls) and
  judges the rest. Its token weights are joined to the urls' tokens; frequent tokens are counted per (host, path) first.

Edge cases: words and names may be of any length. Of segmentations of equal cost the one whose last word is longest wins. A null url, or one without ``://``, has an empty host and path, no rule, and gets the method's verdict from the
priors alone. With no judged page of one class, the other class is the verdict; with none at all it is allow. Rows repeating a
page_id are judged row by row. Null html counts as no words. Other columns are ignored. Empty tables give empty results.
"""

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstgraph.llm.common import park

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 24  # longer words are found by their first letters


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host follows the first ``://``, A-Z lower-cased; path starts behind it and ends before ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; nulls when none does."""
    rule = verdict = None
    for text, decision in sorted(rules, key=lambda r: -len(r[0])):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def word_costs(pages: DataFrame) -> DataFrame:
    """(word, cost) of the lower-cased words of the pages' visible text."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    counts = words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = park(counts, "url-words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.selectExpr("word", f"ln({total}) - ln(n) AS cost")


def segment(text: str, costs: dict[str, float], unknown: float) -> list[str]:
    """Words of least total cost; a character in no word costs ``unknown``, neighbours of that kind stay together."""
    best: list[tuple[float, int, bool]] = [(0.0, 0, True)]
    lengths = {len(word) for word in costs}
    for end in range(1, len(text) + 1):
        choices = [(best[end - 1][0] + unknown, end - 1, False)]
        for begin in (end - n for n in lengths if n <= end):
            cost = costs.get(text[begin:end])
            if cost is not None:
                choices.append((best[begin][0] + cost, begin, True))
        best.append(min(choices, key=lambda c: (c[0], c[1])))
    words, end, loose = [], len(text), False
    while end:
        _, begin, known = best[end]
        piece = text[begin:end]
        if not known and loose:
            words[-1] = piece + words[-1]
        else:
            words.append(piece)
        loose, end = not known, begin
    return words[::-1]


def segmented(names: DataFrame, costs: DataFrame) -> DataFrame:
    """(name, words) of every distinct ``name``.

    Substrings of up to ``PREFIX`` letters are all looked up. A longer word is tried where its first ``PREFIX`` letters stand,
    in the lengths that words with these letters have, so a name's work follows the words there are and no length is left out.
    """
    names = names.select("name").where("name <> ''").distinct()
    parts = names.selectExpr("name", "explode(sequence(1, length(name))) AS at", "length(name) AS size")
    short = parts.selectExpr("name", "at", f"explode(sequence(1, least({PREFIX}, size - at + 1))) AS n")
    heads = costs.where(f"length(word) > {PREFIX}").groupBy(F.substring("word", 1, PREFIX).alias("head")).agg(F.collect_set(F.length("word")).alias("lengths"))
    long = parts.where(f"size - at + 1 > {PREFIX}").withColumn("head", F.expr(f"substring(name, at, {PREFIX})")).join(heads, "head")
    long = long.selectExpr("name", "at", "explode(filter(lengths, n -> n <= size - at + 1)) AS n")
    found = short.union(long).selectExpr("name", "substring(name, at, n) AS word").distinct().join(costs, "word")
    known = found.groupBy("name").agg(F.collect_list(F.struct("word", "cost")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                table = {k["word"]: k["cost"] for k in r["known"] or []}
                out.append(segment(r["name"], table, 2 * max([10.0, *table.values()])))
            yield pa.RecordBatch.from_arrays([pa.array([r["name"] for r in rows], pa.string()), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    return names.join(known, "name", "left").mapInArrow(run, "name STRING, words ARRAY<STRING>")


def _tokens(urls: DataFrame, costs: DataFrame) -> DataFrame:
    """(host, path, token, times): host words as ``h:word``, path words as ``p:word``, digits as their number."""
    pieces = urls.selectExpr(
        "host", "path",
        r"inline(concat(transform(split(host, '[^\\p{L}\\p{N}]+'), x -> struct('h:' AS kind, x AS name)),"
        r" transform(split(path, '[^\\p{L}\\p{N}]+'), x -> struct('p:' AS kind, lower(x) AS name))))",
    ).where("name <> ''")
    digits = r"name RLIKE '\\A\\p{N}+\\z'"
    words = segmented(pieces.where(f"NOT {digits}"), costs)
    letters = pieces.where(f"NOT {digits}").join(words, "name").selectExpr("host", "path", "kind", "explode(words) AS word")
    numbers = pieces.where(digits).selectExpr("host", "path", "kind", "concat('#', length(name)) AS word")
    return letters.union(numbers).groupBy("host", "path", F.concat("kind", "word").alias("token")).agg(F.count(F.lit(1)).alias("times"))


def url_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row; score is the log odds of block, null where a rule decides."""
    host, path = url_parts(F.col("url"))
    rows = park(pages.select("page_id", host.alias("host"), path.alias("path")), "url-parts")
    rule, decision = rule_for(F.col("host"), F.col("path"), rules)
    urls = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows")).withColumns({"rule": rule, "decision": decision})
    urls = park(urls, "url-distinct")
    tokens = park(_tokens(urls, word_costs(pages)), "url-tokens")

    judged = tokens.join(urls.where("rule IS NOT NULL").select("host", "path", "rows", "decision"), ["host", "path"])
    counts = judged.groupBy("token").agg(
        F.sum(F.expr("IF(decision = 'block', times * rows, 0)")).alias("block"), F.sum(F.expr("IF(decision = 'allow', times * rows, 0)")).alias("allow")
    )
    counts = park(counts, "url-counts")
    total = counts.agg(F.sum("block"), F.sum("allow"), F.count(F.lit(1))).first()
    block, allow, kinds = (x or 0 for x in total)
    seen = {r["decision"]: r["rows"] for r in urls.where("rule IS NOT NULL").groupBy("decision").agg(F.sum("rows").alias("rows")).collect()}
    blocked, allowed = seen.get("block", 0), seen.get("allow", 0)
    if blocked and allowed:
        prior = log(blocked) - log(allowed)
    else:
        prior = 1.0 if blocked else -1.0
    learned = bool(blocked and allowed)
    weights = counts.selectExpr(
        "token", f"ln((block + 1D) / {block + kinds + 1}) - ln((allow + 1D) / {allow + kinds + 1}) AS weight"
    )
    open_urls = urls.where("rule IS NULL").select("host", "path")
    evidence = tokens.join(open_urls, ["host", "path"]).join(weights, "token").groupBy("host", "path").agg(F.sum(F.expr("times * weight")).alias("evidence"))
    scored = urls.join(evidence, ["host", "path"], "left").withColumn(
        "score", F.when(F.col("rule").isNull(), F.lit(prior) + (F.coalesce("evidence", F.lit(0.0)) if learned else F.lit(0.0)))
    )
    answers = scored.selectExpr("host", "path", "rule", "coalesce(decision, IF(score > 0, 'block', 'allow')) AS verdict", "score")
    return rows.join(answers, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "score")
