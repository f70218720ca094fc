"""What one talk's text tells is told from its row: no groups, no kept paragraphs."""

from collections import Counter

from conftest import SMALL
from pyspark.sql import functions as F

from tidemark.operators import index, reuse, tokens, vectors
from tidemark.plans import store
from tidemark.sources import corpus as C


def test_passages_are_no_groups(spark):
    plan = vectors.passages(spark, SMALL)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert [[p[0] for p in g] for g in vectors.merged([(0, "a", 5), (2, "b", 3), (3, "c", 4), (5, "d", 2)], 7)] == [[0, 2, 3, 5]]  # the tail has six words
    assert [[p[0] for p in g] for g in vectors.merged([(0, "a", 9), (2, "b", 8)], 7)] == [[0], [2]] and vectors.merged([(1, "a", 2)], 7) == [[(1, "a", 2)]]


def test_vectors_count_the_words_of_all_rows_of_a_key(spark):
    df = spark.createDataFrame([(1, "one two two"), (1, "two"), (2, ""), (3, None), (4, "4th")], "k long, text string")
    at = {r.w: r.h for r in spark.createDataFrame([("one",), ("two",)], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(64)).alias("h")).collect()}
    found = {r.k: Counter({i: x for i, x in enumerate(r.v) if x}) for r in vectors.hashed(df, "k").collect()}
    assert found == {1: Counter({at["one"]: 1.0}) + Counter({at["two"]: 3.0})}


def test_phrases_runs_and_clean_text_keep_no_paragraphs(spark):
    store.forget()
    for df in (index.phrase_history(spark, SMALL, "of the"), reuse.QUERIES["q_shingles"](spark, SMALL), tokens.QUERIES["tok_clean"](spark, SMALL), vectors.QUERIES["t_cache"](spark, SMALL)):
        assert df.count()
    assert not {name for _, _, name in store._KEPT} & {"clean", "shingles", "normalised"}
    assert not index.phrase_history(spark, SMALL, "nobody says this").count()


def test_overlapping_phrases_stay_in_their_sentence(spark, tmp_path):
    text = "la la la. La " + "word " * 160 + "\nla la"
    path = str(tmp_path)
    spark.createDataFrame([(0, text, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "nothing")], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    assert [tuple(r) for r in index.phrase_history(spark, path, "la la").collect()] == [(1, 3, 1, 1)]
    assert C.talks(spark, path).count() == 1


def test_triples_leave_python_by_arrow(spark):
    """No pandas frame of lists between a paragraph and its tokens."""
    found = tokens.QUERIES["tok_triples"](spark, SMALL)
    assert "MapInPandas" not in found._jdf.queryExecution().toString()
    text = "“No,” he said. Mr. B. ran! \"so\" it’s"
    assert tokens.triples(text) == [("no", True, True), ("he", False, False), ("said", False, False), ("mr", False, True), ("b", False, False), ("ran", False, False), ("so", True, True), ("it's", False, False)]
    assert tokens.triples(None) == tokens.triples("...") == []
