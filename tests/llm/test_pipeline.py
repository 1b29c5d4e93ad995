import random

import corpus_pipeline as P


def test_stages_on_odd_rows(spark, tmp_path, words):
    rng = random.Random(9)
    item = " ".join(words(rng, 30))
    spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = {k: " ".join(words(rng, 80)) for k in range(60)}
    passage = " ".join(words(rng, 60))
    text[40] += " " + passage
    text[41] += " " + passage
    text[50] += " " + item
    text[57] = text[3].replace("w0", "w1", 1)
    rows = [(k, t, "en") for k, t in text.items()] + [(58, text[5], "en"), (5, text[5], "en"), (70, None, "en"), (71, "123", "en"), (None, text[6] + " tail", "en")]
    rows = [(*r, "s", len(r[1] or ""), "extra") for r in rows]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, node STRING")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        columns = docs.columns
        docs = P.park(stage(spark, docs, str(tmp_path)), "test-stage")
        seen[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {n: sorted((r.doc_id for r in rows), key=str) for n, rows in seen.items()}
    told, joined, cut, clean, encoded = (ids[n] for n, _ in P.STAGES)
    assert 70 not in told and 71 not in told and told.count(5) == 2 and None in told
    assert told.count(58) == 2 and joined.count(58) == 1  # two rows of one id: only the copy of 5 goes
    assert text[58] in {r.text for r in seen["n-gram Jaccard join"]}
    assert 57 not in joined and joined.count(5) == 1 and None in joined and set(range(57)) <= set(joined)
    assert set(cut) == set(joined)
    left = {r.doc_id: r for r in seen["suffix-array dedup"]}
    assert passage in left[40].text and passage not in left[41].text and left[41].n_chars == len(left[41].text)
    assert set(joined) - set(clean) == {50} and clean == encoded
    assert all(r.round_trip for r in seen["SentencePiece encoding"])
    assert sorted((r.doc_id for r in P.run(spark, str(tmp_path)).collect()), key=str) == encoded


def test_the_table(spark):
    found = P.run(spark, "/root/testdata/sf0.001").collect()
    assert found and all(r.round_trip and r.n_pieces for r in found)


def test_columns_named_like_the_helpers(spark, tmp_path, words):
    """Columns that helpers use themselves pass through both filtering helpers."""
    from burstgraph.llm.id_filter import without
    from burstgraph.llm.suffix_dedup import cut_documents

    rng = random.Random(4)
    passage = " ".join(words(rng, 60))
    names = ("_dropped", "_place", "_node", "_id", "_kept", "_there", "_KEPT_")
    rows = [(k, f"{k} " + (passage if k < 3 else " ".join(words(rng, 20))), *range(len(names))) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, " + ", ".join(f"`{n}` INT" for n in names))
    gone = spark.createDataFrame([(5,)], "doc_id BIGINT")
    left = without(docs, gone, "doc_id")
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7]
    cut = cut_documents(docs)
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert passage in texts[0] and passage not in texts[1] and passage not in texts[2]
    assert {tuple(r)[2:] for r in cut.collect()} == {tuple(range(len(names)))}


def test_rows_of_one_id_are_judged_by_text(spark, words):
    """Only the row that is a copy goes, and its other row keeps standing for its own group."""
    rng = random.Random(12)
    x, y, z = (" ".join(words(rng, 40)) for _ in range(3))
    rows = [(5, x), (7, x), (7, y), (9, y), (7, None), (11, z), (11, z)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id INT, text STRING, _copy INT")
    kept = P.join_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, x), (7, y), (7, None), (11, z)], key=str)
