"""Texts come back from files as they were, and words are written as the SQL does."""

import duckdb
from pyspark.sql import functions as F

from tidemark.operators import index, ingest, report
from tidemark.sources import corpus as C


def test_csv_keeps_empty_texts_and_line_ends(spark, tmp_path):
    texts = [None, "", "a\rb", "\r\n", 'say "so", then', "\\", "\n", " x ", "#", "\x00", '""', " "]
    rows = [(k, t, "en", texts[-k], 0) for k, t in enumerate(texts)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    found = ingest.QUERIES["sink_csv"](spark, path)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, C.talks(spark, path).select(*found.columns).collect()))


def test_millions_of_words_are_written_as_in_sql(spark, monkeypatch):
    counts = [0, 7, 999, 1000, 123456, 999999, 1000000, 1234567, 12345678]
    stats = spark.createDataFrame(list(enumerate(counts, 1)), "ord int, words long")
    monkeypatch.setattr(index, "ord_stats", lambda s, d: stats)
    ours = {r["ord"]: (r["name"], r["words"]) for r in report.QUERIES["r_format"](spark, "").collect()}
    con = duckdb.connect()
    body = report.ORACLES["r_format"][len("WITH ") + len(index.SQL_INDEX) :]
    con.execute("CREATE TABLE ord_stats AS SELECT * FROM (VALUES " + ", ".join(f"({k}, {n}::BIGINT)" for k, n in enumerate(counts, 1)) + ") v(ord, words)")
    assert ours == {o: (name, words) for o, name, words in con.execute(body).fetchall()}
    assert stats.select(F.max("words")).first()[0] == 12345678
