import random
import re

import pytest

import burstgraph.llm.jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent=75):
    sets = []
    for i, text in rows:
        w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for g, (i, _) in zip(group, sets, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, len(s), None if i is None else least[g]) for g, (i, s) in zip(group, sets, strict=True)), key=str)


def corpus(words):
    rng, rows = random.Random(7), []
    for base in range(6):
        text = words(rng, rng.choice([8, 40, 120]))
        rows.append((len(rows), " ".join(text)))
        for _ in range(5):  # chains of edits, from near to far
            text = [w if rng.random() > 0.02 else "edit" + str(rng.random()) for w in text]
            rows.append((len(rows), " ".join(text)))
    passage = words(rng, 30)
    rows += [(len(rows) + k, " ".join(passage + words(rng, rng.choice([5, 60])))) for k in range(12)]
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "One two"), (n + 4, "one  TWO"), (n + 5, "a b c d e"), (n + 6, "É È é"), (n + 7, "é È é")]
    rows += [(None, rows[0][1]), (None, None), (3, rows[3][1]), (n + 8, rows[1][1].upper()), (0, "another text of the first id here")]
    return rows


@pytest.mark.parametrize("centres", ["turns", "rest"])
def test_against_all_pairs(documents, words, centres, monkeypatch):
    if centres == "turns":  # go on drawing centres while that helps
        monkeypatch.setattr(J, "PAIRS_PER_ROW", 0)
    else:
        monkeypatch.setattr(J, "PAIRS_PER_ROW", 1e9)
    rows = corpus(words)
    found = J.jaccard_components(documents(rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_empty(documents):
    assert J.jaccard_components(documents([])).collect() == []
    assert [tuple(r) for r in J.jaccard_components(documents([(1, None)])).collect()] == [(1, 0, 1)]
