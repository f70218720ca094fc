"""A small corpus in which each class has a term by construction, and the as-of rule on it."""

import random

import pytest

from tidemark.operators import index as I
from tidemark.operators import signals as S

WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeio" for c in "lmnrt"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """40 buckets of 12 talks by 12 speakers."""
    rng, rows = random.Random(3), []
    for o in range(1, 41):
        for k in range(12):
            words = [rng.choice(WORDS) for _ in range(240)]
            place = lambda w, n: [words.insert(rng.randrange(len(words)), w) for _ in range(n)]  # noqa: B023, E731
            if o == 40 and k < 4:
                place("newling", 2)
            if (o == 25 and k < 4) or (o == 40 and k in (5, 6, 7, 8)):
                place("revivum", 1)
            if o in (38, 39, 40) and k < 5:
                place("contina", 2)
            if (30 <= o < 40 and k == 0) or (o == 40 and k < 8):
                place("risewell", 1 if o < 40 else 3)
            if o == 38 and k < 8:
                place("fadeout", 3)
            if 1 <= o < 40 and k < 6:
                place("absentia", 1)
            if o == 40 and k in (10, 11):
                place("singleton", 5)
            if o == 40 and k < 3:
                words += "bab one two sharedling three four five bib".split()
            rows.append(((o - 1) * 12 + k, " ".join(words) + ".", "en", "solo" if o == 40 and k >= 10 else f"s{k}", 0))
    path = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "nothing here is shared")], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize(("term", "cls"), [("newling", "new"), ("revivum", "revived"), ("contina", "continuing"), ("risewell", "rising"), ("fadeout", "fading"), ("absentia", "absent"), ("singleton", "single")])
def test_class(spark, folder, term, cls):
    assert cls in {r.cls for r in S.ranked(spark, folder).where(f"term = '{term}'").collect()}


def test_reported(spark, folder):
    found = {r.term: r.cls for r in S.lexical_signals(spark, folder).collect()}
    assert found.get("newling") == "new" and found.get("absentia") == "absent"


def test_the_future_is_hidden(spark, folder):
    """Classes at bucket 38 are the same when the talks after it don't exist."""
    late = S.classified(spark, folder, 38).where("new OR rising OR continuing").select("term", "count", "new", "rising").collect()
    cut = folder + "-cut"
    spark.read.parquet(f"{folder}/benchmark.parquet").write.mode("overwrite").parquet(f"{cut}/benchmark.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 38 * 12").write.mode("overwrite").parquet(f"{cut}/documents.parquet")
    import tidemark.sources.corpus as C

    kept = C.BUCKETS
    try:
        C.BUCKETS = 38
        early = S.classified(spark, cut, 38).where("new OR rising OR continuing").select("term", "count", "new", "rising").collect()
    finally:
        C.BUCKETS = kept
    hapax = lambda rows: {r.term: tuple(r) for r in rows if " " not in r.term}
    both = hapax(late).keys() & hapax(early).keys()
    assert both and all(hapax(late)[t] == hapax(early)[t] for t in both)


def test_history(spark, folder):
    rows = {r["ord"]: r["count"] for r in I.phrase_history(spark, folder, "revivum").collect()}
    assert rows == {25: 4, 40: 4}


@pytest.mark.parametrize("name", ["cls_new", "cls_revived", "cls_continuing", "cls_rising", "cls_fading", "cls_absent", "cls_burst", "cls_narrow", "lexical_signals_full", "guard_shared_rows"])
def test_classes_agree_with_sql(spark, folder, name):
    """Both engines find the planted terms: no class is empty here."""
    import duckdb
    from oracle import plain

    if name == "guard_shared_rows":
        # all four new users say "newling" in one passage: it is no new term then
        kept = {r.term for r in S.reported(spark, folder, absent=False).where("cls = 'new'").collect()}
        assert "newling" in kept and not {t for t in kept if t.startswith("shared")}
        return
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = con.execute(S.ORACLES[name])
    names = sorted(d[0] for d in found.description)
    theirs = sorted(repr([plain(v) for _, v in sorted(zip([d[0] for d in found.description], r, strict=True))]) for r in found.fetchall())
    df = S.QUERIES[name](spark, folder)
    assert names == sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    assert ours == theirs and ours


def test_spoken_and_marks(spark, folder):
    """An absent term whose stem or a near spelling is said is not reported; struck-out terms go."""
    asked = spark.createDataFrame([("newlings",), ("newlin",), ("absentia",), ("contina risewell",)], "term string")
    assert {r.term for r in S.spoken(spark, folder, 40, asked).collect()} == {"newlings", "newlin"}
    marks = spark.createDataFrame([("newling",)], "term string")
    assert "newling" not in {r.term for r in S.lexical_signals(spark, folder, marks=marks, full=True).collect()}
