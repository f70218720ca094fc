"""Reuse in numbers: no table of runs is kept, any cut into batches gives the same passages, a canon that can't be sent too."""

from conftest import SMALL

from tidemark.operators import index as I
from tidemark.operators import reuse
from tidemark.plans import store


def _rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_no_table_of_runs_is_kept(spark):
    store.forget()
    for name in ("q_users", "q_store", "q_origin", "q_shared_pairs", "q_leaderboard"):
        reuse.QUERIES[name](spark, SMALL).count()
    assert not {name for _, _, name in store._KEPT} & {"shingles", "clean"}


def test_passages_do_not_depend_on_batches(spark):
    whole, key = _rows(reuse.segments(spark, SMALL)), "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "3")
    try:
        assert whole and _rows(reuse.segments(spark, SMALL)) == whole
    finally:
        spark.conf.unset(key)


def test_a_canon_beyond_what_can_be_sent(spark, monkeypatch):
    names = ("q_users", "q_origin", "q_shared_pairs", "q_store")
    sent = [_rows(reuse.QUERIES[n](spark, SMALL)) for n in names]
    try:
        store.forget()
        monkeypatch.setattr(I, "MOST_SENT", 10)
        assert [_rows(reuse.QUERIES[n](spark, SMALL)) for n in names] == sent
    finally:
        store.forget()
