"""Facts about the text rules, each on literal rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import ingest, report, reuse, signals, tokens, vectors


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "words"),
    [("Room 12b holds 40 chairs, or 50", "room holds chairs or"), ("The Smiths’ dog’s tail 'wags'", "the smiths dog's tail wags"), ("x1 1x 1-x", "x x"), ("", "")],
)
def test_words(spark, text, words):
    from tidemark.functions import kernels as K

    assert one(spark, T.words("t"), t=text) == words.split() == K.words(text)


def test_triples():
    found = tokens.triples("She asked: \"Is it late?\" Nobody knew! At 9 p.m. Dr. Green spoke, “go home” to all.")
    assert [w for w, _, _ in found] == "she asked is it late nobody knew at p m dr green spoke go home to all".split()
    assert [w for w, q, _ in found if q] == ["is", "it", "late", "go", "home"]
    assert [w for w, _, s in found if s] == ["she", "nobody", "at"]
    assert tokens.triples("") == tokens.triples(None) == tokens.triples("... !") == []
    assert [s for _, _, s in tokens.triples(". one. two")] == [True, True]
    assert [q for _, q, _ in tokens.triples("“a \"b\" c” d \"e")] == [True, False, True, False, True]


def test_said_once():
    words = lambda text: [w for w, _, _ in tokens.triples(text, True)]
    assert words("we we went out to the to the shop") == "we went out to the shop".split()
    assert words("one two three one two three four four four") == "one two three four".split()
    assert words("a b c d a b c d") == "a b c d a b c d".split()
    assert len(tokens.triples("we we went")) == 3


@pytest.mark.parametrize(("gram", "ok"), [("harvest moon", True), ("the moon", False), ("moon over harvest", True), ("over the moon", False), ("moon", True), ("and", False), ("harvest of the", False)])
def test_meaningful(spark, gram, ok):
    assert one(spark, T.meaningful("g"), g=gram) is ok


def test_overlapping(spark):
    assert one(spark, T.overlapping(F.split("t", " "), "tick tock tick"), t="tick tock tick tock tick tock") == 2
    assert one(spark, T.overlapping(F.split("t", " "), "tock"), t="tick tocks") == 0


def test_windows_of_short_lists(spark):
    assert one(spark, T.windows(F.split("t", " "), 3), t="a b") == []


@pytest.mark.parametrize(("ord_", "name"), [(2, "October 1971"), (31, "April 1986"), (-1, "April 1970"), (-20, "October 1960")])
def test_period_names(spark, ord_, name):
    assert one(spark, T.period_name("o"), o=ord_) == name


def test_sentences_and_masks(spark):
    from tidemark.functions import kernels as K

    assert one(spark, T.sentences("t"), t="Mr. Case met J. Doe. He left! No. 3 stays") == [["mr", "case", "met", "j", "doe"], ["he", "left"], ["no", "stays"]]
    assert K.clean([["a", "b", "c", "d"]], [1, 2]) == [["a"], ["d"]]
    assert K.clean([["a"], ["b", "c"]], [0]) == [["b", "c"]] and K.clean([["a"], ["b"]], []) == [["a"], ["b"]]
    assert K.mask("a b c d e a b c".split(), frozenset({"a b c", "b c d"}), 3) == [0, 1, 2, 3, 5, 6, 7]


def test_fragments_and_dedupe(spark):
    weights = spark.createDataFrame([("old oak", 12.0), ("old oak tree", 9.0), ("oak tree", 20.0), ("lantern", 5.0)], "term string, weight double")
    assert [r.term for r in signals.fragments(weights).collect()] == ["old oak"]
    data = [("oak tree", 10), ("old oak tree", 9), ("tree", 30), ("lantern", 3), ("oak", 6), ("oak", 10), ("lantern light", 1)]
    rows = [("new", t, s, k + 1) for k, (t, s) in enumerate(data)] + [("rising", "old oak", 9, 1), ("rising", "oak", 9, 2)]
    found = signals.dedupe(spark.createDataFrame(rows, "cls string, term string, speakers long, rank int")).collect()

    def plain(own):
        """Rank by rank: against what stays, one holds the other and the smaller number is 60 % of the larger."""
        stay = []
        for term, speakers, rank in own:
            alike = [min(speakers, n) >= 0.6 * max(speakers, n) for t, n, _ in stay if f" {t} " in f" {term} " or f" {term} " in f" {t} "]
            if not any(alike):
                stay.append((term, speakers, rank))
        return [r for *_, r in stay]

    for cls in ("new", "rising"):
        assert sorted(r["rank"] for r in found if r.cls == cls) == plain([r[1:] for r in rows if r[0] == cls])


def test_passages_grow_from_the_most_used_window():
    import numpy as np

    uses = [{1}, {1, 2}, {1, 2, 3, 4}, {3, 4}, {4, 5, 6}, {9}, {7, 8}, {7, 8}]
    windows = np.array([[t in u for t in range(10)] for u in uses])
    assert reuse.passages_of(windows, 2, 40) == [(1, 3), (4, 4), (6, 7)]
    assert reuse.passages_of(windows, 3, 40) == [(1, 3), (4, 4)]
    assert reuse.passages_of(np.ones((60, 2), bool), 2, 10) == [(3 * k + k, min(3 * k + k + 3, 59)) for k in range(15)]


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("electrical", "electr"), ("adjustment", "adjust"), ("controlling", "control"), ("sky", "sky"), ("rate", "rate")],
)
def test_stems(word, stem):
    from tidemark.functions.stem import stem as stemmed

    assert stemmed(word) == stem


def test_links_names_groups(spark):
    ref = lambda h: one(spark, ingest.parse_ref(F.col("h")), h=h)
    found = ref("https://www.example.org/study/scriptures/nt/acts/9?lang=eng&amp;id=p3%2Cp7-p9#p3")
    assert (found["kind"], found["volume"], found["book"], found["chapter"], found["verses"]) == ("scripture", "nt", "acts", "9", "3,7-9")
    assert ref("/general-conference/1999/10/a-talk/")["path"] == "/general-conference/1999/10/a-talk"
    assert ref("/general-conference/1999/10/sunday-session") is None and ref("mailto:x@y.z") is None
    name = lambda n: one(spark, ingest.clean_name(F.col("n")), n=n)
    key = lambda n: one(spark, ingest.name_key(F.col("n")), n=n)
    assert name(" Given by Presiding Bishop Dr. Ann B.  Case ,") == "Ann B. Case" and name("Presented by By Elder Sam Roe, Jr") == "Sam Roe Jr."
    assert key("Elder Renée Ño-Ünal") == "renee no unal"
    group = lambda r: one(spark, ingest.group_of(F.col("r")), r=r)
    assert [group(r) for r in ("First Counselor in the First Presidency", "Acting President of the Quorum of the Twelve Apostles", "Assistant to the Twelve", "", "Relief Society")] == ["First Presidency", "Twelve", "Other", "Other", "Other"]


def test_display_helpers(spark):
    assert one(spark, tokens.unstutter(F.col("t")), t="we saw, we saw the the hill and the hill") == "we saw the hill and the hill"
    assert one(spark, tokens.tidy(F.col("t")), t="of rain. The river rose twice that week. And") == "The river rose twice that week."
    assert one(spark, tokens.tidy(F.col("t")), t="while the river rose") == "… while the river rose …"
    assert tokens.display("A “Slow, red” boat’s sail", 1, 4) == "Slow, red” boat’s"
    words = [one(spark, report.change_words(F.lit(x), F.lit(1.0)), t=1) for x in (0.4, 0.41, 0.6, 0.85, 0.86, 1.15, 4.0)]
    assert words == [
        "about a third of the usual amount or less", "about half the usual amount", "about half the usual amount", "somewhat less than usual", "about the usual amount", "somewhat more than usual", "several times the usual amount",
    ]
    honest = lambda a, b, r: one(spark, report.honest_change(F.lit(a), F.lit(b), F.lit(r)), t=1)
    assert honest(0.2, 0.1, 1.0) == "at least the usual amount" and honest(0.2, 0.1, 2.0) == "about double the usual amount" and honest(0.05, 0.1, 0.9) == "about the usual amount"


def test_one_edit_pairs(spark):
    words = ["stone", "stones", "tone", "store", "shore", "stonee", "st", "t", "s", "stone"]
    a = spark.createDataFrame([(w,) for w in words], "word string")
    found = {(r.word, r.other) for r in tokens.one_edit(a, a.select(F.col("word").alias("other"))).collect()}

    def close(x, y):
        cuts = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
        return x != y and (y in cuts(x) or x in cuts(y) or (len(x) == len(y) and sum(p != q for p, q in zip(x, y, strict=True)) == 1))

    assert found == {(x, y) for x in words for y in words if close(x, y)}


def test_nearest_and_quantile(spark, monkeypatch):
    import numpy as np

    from tidemark.plans import quantile as Q
    from tidemark.plans.nearest import nearest

    rng = np.random.default_rng(4)
    known = [(f"s{rng.integers(0, 3)}", int(x), f"v{x}") for x in rng.choice(200, 40, False)]
    asked = [(f"s{rng.integers(0, 4)}", int(x)) for x in rng.choice(200, 60, False)]
    found = nearest(spark.createDataFrame(asked, "speaker string, at long"), spark.createDataFrame(known, "speaker string, at long, v string"), "speaker", "at", "v").collect()
    best = {(s, a): min((abs(a - b), b) for t, b, _ in known if t == s)[1] for s, a in asked if any(t == s for t, *_ in known)}
    assert {(r.speaker, r["at"]): r.other for r in found} == best and all(r.v == f"v{r.other}" for r in found)
    monkeypatch.setattr(Q, "FEW", 10)
    values = [*rng.normal(size=400).tolist(), *[0.25] * 200]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    for share in (0.0, 0.1, 0.6, 1.0):
        assert abs(Q.quantile(rows, "x", share) - np.quantile(values, share)) < 1e-12
    assert Q.quantile(rows.where("false"), "x", 0.5) is None


def test_tidy_reads_the_whole_text(spark, tmp_path):
    long = "They need love. " * 40 + "It is so."
    assert one(spark, tokens.tidy(F.col("t")), t="one\ntwo. " + long) == long
    spark.createDataFrame([(1, long, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.shown for r in tokens.QUERIES["txt_tidy"](spark, str(tmp_path)).collect()] == [long]
    assert one(spark, tokens.tidy(F.col("t")), t="and so they went on") == "… and so they went on …"


def test_density_covers_all_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([c + 0.25 * rng.normal(size=(25, 6)) for c in 3 * np.eye(6)[:3]] + [rng.normal(size=(15, 6))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = 1 - unit @ unit.T <= 0.1
    core, root = near.sum(1) >= 5, np.full(len(x), -1)
    for i in np.flatnonzero(core):
        todo = [i] if root[i] < 0 else []
        while todo:
            j = todo.pop()
            root[j] = i
            todo += np.flatnonzero(near[j] & core & (root < 0)).tolist()
    for i in np.flatnonzero(~core):
        root[i] = min((root[j] for j in np.flatnonzero(near[i] & core)), default=-1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    for block in (1000, 13):
        assert {r.vec_id: r.cluster for r in vectors.chained(rows, 0.1, 5, block).collect()} == dict(enumerate(root.tolist()))
    assert len(set(root.tolist())) > 3


def test_boards_collapse_by_users(spark):
    rows = [(1, 0, 0, 9, 3, 3, [10, 11, 12], "a"), (1, 5, 0, 9, 3, 3, [10, 11, 13], "b"), (1, 9, 0, 9, 2, 2, [20, 21], "c"), (2, 0, 0, 9, 4, 2, [30, 31, 32, 33], "d")]
    df = spark.createDataFrame(rows, "talk_id long, pos int, first int, words int, talks int, speakers int, users array<long>, text string")
    found = [(r.order, r.text, r.pieces) for r in reuse.ranked(df).orderBy("order").collect()]
    assert found == [(1, "a", ["a", "b"]), (2, "d", ["d"]), (3, "c", ["c"])]


def test_recent_board_is_cut_by_origin_first(spark, monkeypatch):
    old = [(k, 0, 0, 9, 9, 1, [1000 * k + u for u in range(3)], "old") for k in range(400)]
    rows = [(*r, "s") for r in [*old, (999, 0, 0, 9, 2, 40, [7, 8], "late")]]
    df = spark.createDataFrame(rows, "talk_id long, pos int, first int, words int, talks int, ord int, users array<long>, text string, speaker string")
    talks = spark.createDataFrame([(u, f"s{u}") for r in rows for u in r[6]], "talk_id long, speaker string")
    monkeypatch.setattr(reuse, "quotes", lambda s, d: df)
    monkeypatch.setattr(reuse.C, "talks", lambda s, d: talks)
    assert [r.text for r in reuse.record(spark, "").where("board = 'recent'").collect()] == ["late"]
    assert reuse.leaderboard(spark, "", None).count() == 401


def test_append_keeps_the_old(spark):
    old = spark.createDataFrame([("a", 1)], "href string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 3)], "href string, v int")
    assert sorted(map(tuple, ingest.append_new(old, new).collect())) == [("a", 1), ("b", 3)]


def test_pages():
    from tidemark.sources.pages import parse

    p = parse("<html lang=en><head><title>A</title><script>var t='</p>';</script></head><body><h1>Head</h1><p><b>one<br>two<p>three <sup>1</sup>four</body>")
    assert (p.title, p.lang, p.headings, p.paragraphs) == ("A", "en", ["Head"], ["one two", "three four"])


def test_note_markers_are_no_text():
    from tidemark.sources.pages import parse

    p = parse('<p>say<a class="note-ref" href="#n1">1</a> so, <a class="x" href="/y">and</a> on<sup>2</sup></p>')
    assert p.paragraphs == ["say so, and on"] and p.links == ["#n1", "/y"]


def test_headings_above_links(spark):
    from tidemark.sources.pages import parsed

    html = '<a href="/0">x</a><h1>Friday</h1><a href="/1">x</a><p><a href="/0">x</a></p><h2>Late <b>Friday</b></h2><ul><li><a href="/2">x</a></ul>'
    pages = parsed(spark.createDataFrame([(1, "u", html), (2, "v", None)], "page_id long, url string, html string"))
    found = [(r.i, r.link, r.session) for r in ingest.sessions(pages).orderBy("i").collect()]
    assert found == [(0, "/0", ""), (1, "/1", "Friday"), (2, "/2", "Late Friday")]


def test_cache_of_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "<p>x</p>"), (2, "b", ""), (3, "c", None)], "page_id long, url string, html string")
    ingest.write_cache(pages, f"{tmp_path}/cache")
    assert [tuple(r) for r in ingest.read_cache(spark, f"{tmp_path}/cache").collect()] == [(1, "a", "<p>x</p>")]
    urls = spark.createDataFrame([("a",), ("b",), ("z",)], "url string")
    assert [r.url for r in ingest.to_fetch(urls, spark, f"{tmp_path}/cache").collect()] == ["z"]


def test_components(spark):
    from tidemark.plans.graph import components

    links = spark.createDataFrame([(5, 4), (4, 9), (2, 7), *[(100, 100 + k) for k in range(1, 300)]], "a long, b long")
    found = {r.node: r.root for r in components(links, "links").collect()}
    assert [found[n] for n in (4, 5, 9, 2, 7, 250)] == [4, 4, 4, 2, 2, 100]
