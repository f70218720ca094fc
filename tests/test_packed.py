"""The index in numbers: against plain counting, without a table of grams by talk, and where the canon can't be sent."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import SMALL

from tidemark.functions import kernels as K
from tidemark.functions import packed as P
from tidemark.functions.lexicon import STOPWORDS
from tidemark.functions.text import QUIET_STOP
from tidemark.operators import groups, report, signals
from tidemark.operators import index as I
from tidemark.plans import store


def plain(text, known, n):
    """Uses of each gram, word by word."""
    found = Counter()
    for _, own in K.paragraphs(text, 1):
        for seg in K.clean(own, K.mask([w for s in own for w in s], known, n)):
            for size in range(1, 6):
                found.update(" ".join(seg[i : i + size]) for i in range(len(seg) - size + 1) if seg[i] not in STOPWORDS and seg[i + size - 1] not in STOPWORDS)
    return found


def texts(rng, many):
    parts = ["the", "river", "Mr.", "st.", "a.", "don't", "rock'n'roll", "4th", "abc4de", "abc4'de", "''x''", "café", "’tis", ".", "...", "?!", "\n", "\n \n", "of", "stone", "İx", "one two three four five six", "e.g.", "-"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randrange(60))) for _ in range(many)] + [None, ""]


def test_numbers_are_packed_and_come_back():
    for arrays in ([np.arange(5), np.array([2**40, 0])], [np.zeros(0, np.int64), np.array([2**64 - 1, 3], np.uint64)]):
        assert [a.tolist() for a in P.unpack(P.pack(*arrays))] == [a.tolist() for a in arrays]


def test_quiet_stops():
    rng, stop = random.Random(5), re.compile(QUIET_STOP)
    for _ in range(20_000):
        x = "".join(rng.choice(["a", "b", ".", ".", " ", "\n", "dr", "mr", "4", "'", "’", "st"]) for _ in range(rng.randrange(12)))
        assert P.quiet(x) == stop.sub(r"\1\2 ", x)


def test_counts_are_those_of_plain_counting():
    known, rows = frozenset({"one two three four five six", "the river stone of the river"}), texts(random.Random(2), 300)
    k = len(rows)
    batch = pa.record_batch([pa.array(range(k), pa.int64()), pa.array([i % 3 + 1 for i in range(k)], pa.int32()), pa.array([None if i % 7 == 0 else f"s{i % 5}" for i in range(k)]), pa.array(["g"] * k), pa.array([i % 4 for i in range(k)], pa.int32()), pa.array(rows)], ["talk_id", "ord", "speaker", "grp", "chunk", "text"])
    told = [plain(t, known, 6) for t in rows]
    runs = P.Known(known, 6)
    used = {(r["talk_id"], r["term"]): r["c"] for b in P.used([batch], 1, runs, 5) for r in b.to_pylist()}
    assert used == {(i, t): c for i, own in enumerate(told) for t, c in own.items()}
    asked = pa.Table.from_batches(P.merged(P.counted([batch], 3, 1, runs, 5), 2))
    found = {}
    for chunk in range(4):
        own = asked.filter(pa.array([c == chunk for c in asked["chunk"].to_pylist()]))
        docs = pa.table({"text": [t for i, t in enumerate(rows) if i % 4 == chunk]})
        found |= {r["term"]: r for r in P.named(docs, own, 1, runs, 5).to_pylist()}
    wide = {t for own in told for t in own if sum(t in o for o in told) > 1}
    assert set(found) == wide
    for term in wide:
        for o, count, talks, speakers in zip(*(found[term][c] for c in ("ords", "counts", "talks", "speakers")), strict=True):
            own = [i for i in range(k) if i % 3 + 1 == o and term in told[i]]
            assert (count, talks, speakers) == (sum(told[i][term] for i in own), len(own), len({i % 5 for i in own if i % 7}))
        assert sum(found[term]["talks"]) == found[term]["total_talks"] and min(found[term]["ords"]) == found[term]["first_ord"]


def test_no_table_of_grams_by_talk_is_kept(spark):
    store.forget()
    for df in (I.terms(spark, SMALL), I.QUERIES["txt_ngrams"](spark, SMALL), groups.talk_counts(spark, SMALL), groups.group_scores(spark, SMALL), signals.classified(spark, SMALL), report.history(spark, SMALL)):
        df.count()
    assert not {name for _, _, name in store._KEPT} & {"gram_talks", "clean"}


def test_a_canon_beyond_what_can_be_sent(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, I.term_ord(spark, SMALL).collect()))
    sent = rows()
    try:
        store.forget()
        monkeypatch.setattr(I, "MOST_SENT", 10)
        assert rows() == sent
    finally:
        store.forget()


def test_narrow_terms_are_demoted_and_broad_ones_go(spark, tmp_path):
    """One talk makes most uses of a new term: it is narrow. Three speakers share a strong one evenly: it is not."""
    rng, rows = random.Random(4), []
    for o in range(1, 41):
        for k in range(8):
            words = [f"w{a}x" .replace("0", "o").replace("1", "i") for a in (rng.choice(["a", "b", "c", "d"]) * rng.randrange(1, 9) for _ in range(200))]
            if o == 40:
                words += ["demoted"] * (8 if k == 0 else 1 if k == 1 else 0) + ["lonely"] * (3 if k in (6, 7) else 0)
            if k == 0 and o in (33, 34):
                words += ["shared"]
            words += ["shared"] * (3 if o == 40 and k < 3 else 0)
            rows.append(((o - 1) * 8 + k, " ".join(words) + ".", "en", "solo" if o == 40 and k > 5 else f"s{k}", 0))
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "nothing here is shared")], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    cls = {(r.cls, r.term) for r in signals.ranked(spark, path).collect()}
    assert ("new", "demoted") in cls and ("single", "demoted") not in cls
    found = {r.term: (r["count"], r.speakers) for r in signals.QUERIES["cls_narrow"](spark, path).collect()}
    assert found["demoted"] == (9, 2) and found["lonely"] == (6, 1)
    assert ("single", "shared") not in cls or "shared" not in found
