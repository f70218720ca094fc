"""Pages are parsed few at a time; paragraphs with canon runs are told without the others."""

import pyarrow as pa
from conftest import SMALL

from tidemark.functions import kernels as K
from tidemark.functions import packed as P
from tidemark.operators import citations
from tidemark.plans import store
from tidemark.sources import pages as S


def test_pages_are_parsed_few_at_a_time(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.range(0, 450, 1, 1).selectExpr("id AS page_id", "concat('http://a/', id) AS url", "concat('<html lang=\"en\"><title>t', id, '</title><p>x<p>y</html>') AS html")
    found = S.parsed(rows)
    try:
        assert 0 < int(spark.conf.get(key)) <= S.PAGES
        got = {r.page_id: (r.title, r.lang, r.paragraphs, r.links) for r in found.collect()}
        assert got == {k: (f"t{k}", "en", ["x", "y"], []) for k in range(450)}
    finally:
        spark.conf.unset(key)


def test_marked_paragraphs_are_those_of_the_rules():
    known = frozenset({"a b c d e f", "b c d e f g"})
    texts = ["x y. z", "a b c. d e f g h\n\nq a b c d e f", None, "a b c d e\nf"]
    batch = pa.record_batch([pa.array(range(4), pa.int64()), pa.array([1] * 4, pa.int32()), pa.array(texts)], ["talk_id", "ord", "text"])
    found = [(r["talk_id"], r["pos"], r["norm"], r["mask"]) for b in P.marked([batch], 1, P.Known(known, 6)) for r in b.to_pylist()]
    told = []
    for k, text in enumerate(texts):
        for pos, own in K.paragraphs(text, 1):
            words = [w for s in own for w in s]
            if gone := K.mask(words, known, 6):
                told.append((k, pos, words, gone))
    assert found == told and len(found) == 2


def test_quotations_keep_no_other_paragraphs(spark):
    store.forget()
    assert citations.QUERIES["c_volumes"](spark, SMALL).count()
    assert not {name for _, _, name in store._KEPT} & {"clean", "normalised"}
