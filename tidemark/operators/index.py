"""The n-gram index: normalised paragraphs, canon masks, terms per bucket, bucket totals and vocabulary."""

from __future__ import annotations

import math

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import packed as P
from ..functions import text as T
from ..functions.lexicon import STOPWORDS, sql_list
from ..plans.store import fact, kept
from ..sources import corpus as C

LEAST_TALKS, MOST_WORDS = 2, 5
#: Letters of text whose grams meet in one range of hashes (about half as many entries), or are named together.
LETTERS_A_RANGE, LETTERS_A_CHUNK = 10_000_000, 3_000_000
#: Canon runs (about 150 bytes each) up to which they are sent to every executor; beyond it they are joined.
MOST_SENT = 400_000
#: Hashes of terms (8 bytes each) up to which they are sent.
MOST_TERMS_SENT = 4_000_000


def sent(shingles: DataFrame) -> frozenset[str] | None:
    """The runs in ``shingles`` if they are few enough to be sent."""
    found = shingles.limit(MOST_SENT + 1).collect()
    return frozenset(r["shingle"] for r in found) if len(found) <= MOST_SENT else None


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """talk_id, ord, speaker, grp, pos, norm, segs of every paragraph of an address."""
    return K.normalised(C.talks(spark, sf_dir), C.ADDRESS_WORDS, None, 6).drop("mask", "clean")


def masked_positions(paras: DataFrame, shingles: DataFrame, n: int = 6) -> DataFrame:
    """talk_id, pos, mask: sorted places of the tokens inside a run of n words that the canon has too."""
    known = sent(shingles)
    if known is not None:
        return K.masked(paras, known, n)
    runs = paras.select("talk_id", "pos", F.posexplode(T.windows("norm", n)).alias("i", "shingle"))
    hits = runs.join(shingles, "shingle", "left_semi")
    spread = hits.select("talk_id", "pos", F.explode(F.sequence("i", F.col("i") + (n - 1))).alias("at"))
    return spread.groupBy("talk_id", "pos").agg(F.sort_array(F.collect_set("at")).alias("mask"))


def clean_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """talk_id, ord, speaker, grp, pos, norm, mask and the clean segments that counting uses."""

    def make():
        canon = C.canon_shingles(spark, sf_dir)
        known = sent(canon)
        if known is not None:
            return K.normalised(C.talks(spark, sf_dir), C.ADDRESS_WORDS, known, 6).drop("segs")
        paras = kept(spark, sf_dir, "normalised", lambda: K.normalised(C.talks(spark, sf_dir), C.ADDRESS_WORDS, None, 6))
        mask = masked_positions(paras, canon)
        return K.recleaned(paras.drop("mask").join(mask, ["talk_id", "pos"], "left").select(paras.columns)).drop("segs")

    return kept(spark, sf_dir, "clean", make)


def _counting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, P.Known | None]:
    """Talks with what is counted in them: their text, how many words an address has, and the canon runs; beyond what can be
    sent, their clean segments, in which all counts."""
    known = sent(C.canon_shingles(spark, sf_dir))
    if known is not None:
        # so many words have as many letters and blanks between them
        return C.talks(spark, sf_dir).where(F.length("text") >= 2 * C.ADDRESS_WORDS - 1), C.ADDRESS_WORDS, P.Known(known, 6)
    return clean_paragraphs(spark, sf_dir).groupBy("talk_id", "ord", "speaker", "grp").agg(F.flatten(F.collect_list("clean")).alias("clean")), 0, None


def counting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, int, Broadcast]:
    """``_counting``, found once an application, with the name of the column that is counted."""
    rows, least, known = fact(spark, sf_dir, "counting", lambda: (lambda r, n, k: (r, n, spark.sparkContext.broadcast(k)))(*_counting(spark, sf_dir)))
    return rows, "clean" if "clean" in rows.columns else "text", least, known


def canon_sent(spark: SparkSession, sf_dir: str) -> Broadcast:
    """The canon's runs of six words; none if they are too many to be sent."""
    _, column, _, known = counting(spark, sf_dir)
    return known if column == "text" else spark.sparkContext.broadcast(None)


def letters(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Letters of all talks, and in how many chunks talks are dealt by their ids."""
    many = fact(spark, sf_dir, "letters", lambda: C.talks(spark, sf_dir).agg(F.sum(F.length("text"))).first()[0] or 0)
    return many, max(spark.sparkContext.defaultParallelism, math.ceil(many / LETTERS_A_CHUNK))


def gram_talks(spark: SparkSession, sf_dir: str, since: int = 1, until: int = C.BUCKETS) -> DataFrame:
    """term, talk_id, ord, speaker, grp, c: uses of every meaningful 1- to 5-gram by talk, in the buckets asked for."""
    rows, column, least, known = counting(spark, sf_dir)
    made = lambda batches: P.used(batches, least, known.value, MOST_WORDS)
    return rows.where(F.col("ord").between(since, until)).select("talk_id", "ord", "speaker", "grp", column).mapInArrow(made, "term string, talk_id long, ord int, speaker string, grp string, c long")


def uses_of(spark: SparkSession, sf_dir: str, terms: DataFrame, since: int = 1, until: int = C.BUCKETS) -> DataFrame:
    """term, talk_id, ord, c of the ``terms`` (term) in the buckets asked for; hashes of up to ``MOST_TERMS_SENT`` terms are
    sent, so that nothing else leaves a task."""
    terms = terms.select("term").distinct()
    if terms.count() > MOST_TERMS_SENT:
        return gram_talks(spark, sf_dir, since, until).join(terms, "term", "left_semi").select("term", "talk_id", "ord", "c")
    rows, column, least, known = counting(spark, sf_dir)
    asked = spark.sparkContext.broadcast(P.told(terms))
    made = lambda batches: P.used(batches, least, known.value, MOST_WORDS, asked.value)
    found = rows.where(F.col("ord").between(since, until)).select("talk_id", "ord", "speaker", "grp", column).mapInArrow(made, "term string, talk_id long, ord int, speaker string, grp string, c long")
    return found.select("term", "talk_id", "ord", "c")


def term_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each term that two talks use: term, first_ord, total_count, total_talks, and by bucket the lists ords,
    counts, talks, speakers. Counting moves numbers only (``functions/packed.py``); words come from the talks at the end."""

    def make():
        rows, column, least, known = counting(spark, sf_dir)
        many, chunks = letters(spark, sf_dir)
        ranges = max(spark.sparkContext.defaultParallelism, math.ceil(many / LETTERS_A_RANGE))
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("talk_id"), F.lit(chunks)).cast("int"))
        counted = rows.select("ord", "speaker", "chunk", column).mapInArrow(lambda batches: P.counted(batches, ranges, least, known.value, MOST_WORDS), "part int, blob binary")
        asked = counted.repartition(ranges, "part").mapInArrow(lambda batches: P.merged(batches, LEAST_TALKS), "chunk int, blob binary")
        talks = rows.select("chunk", column)
        return talks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(lambda t, a: P.named(t, a, least, known.value, MOST_WORDS), P.HISTORY)

    return kept(spark, sf_dir, "term_rows", make)


def by_bucket(rows: DataFrame) -> DataFrame:
    """term, ord, count, talks, speakers: a row for each bucket of ``term_rows``."""
    spread = rows.select("term", F.explode(F.arrays_zip("ords", "counts", "talks", "speakers")).alias("e"))
    return spread.select("term", F.col("e.ords").alias("ord"), F.col("e.counts").alias("count"), F.col("e.talks").alias("talks"), F.col("e.speakers").alias("speakers"))


def term_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, ord, count, talks, speakers of the terms that two talks use."""
    return by_bucket(term_rows(spark, sf_dir))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_rows(spark, sf_dir).select("term", "first_ord", "total_count", "total_talks", F.size(F.split("term", " ")).alias("n"))


def totals_until(spark: SparkSession, sf_dir: str, c: int) -> DataFrame:
    """term, total: uses up to bucket c."""
    until = F.zip_with("ords", "counts", lambda o, k: F.when(o <= c, k).otherwise(0))
    return term_rows(spark, sf_dir).where(F.col("first_ord") <= c).select("term", F.aggregate(until, F.lit(0).cast("long"), lambda a, k: a + k).alias("total"))


def talk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """talk_id, ord, speaker, grp, words (outside of canon runs) of the addresses."""

    def make():
        rows, column, least, known = counting(spark, sf_dir)
        return rows.select("talk_id", "ord", "speaker", "grp", column).mapInArrow(lambda batches: P.sized(batches, least, known.value), "talk_id long, ord int, speaker string, grp string, words long")

    return kept(spark, sf_dir, "talk_sizes", make)


def ord_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, words, talks, speakers; words outside of canon runs."""

    def make():
        return talk_sizes(spark, sf_dir).groupBy("ord").agg(F.sum("words").alias("words"), F.countDistinct("talk_id").alias("talks"), F.countDistinct("speaker").alias("speakers"))

    return kept(spark, sf_dir, "ord_stats", make)


def phrase_history(spark: SparkSession, sf_dir: str, phrase: str) -> DataFrame:
    """ord, count (overlapping), talks, speakers of any phrase in the clean text."""
    rows, column, least, known = counting(spark, sf_dir)
    counted = rows.select("talk_id", "ord", "speaker", column).mapInArrow(lambda batches: P.phrase_uses(batches, least, known.value, phrase), "talk_id long, ord int, speaker string, k long")
    return counted.groupBy("ord").agg(F.sum("k").alias("count"), F.countDistinct("talk_id").alias("talks"), F.countDistinct("speaker").alias("speakers"))


def marked_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """talk_id, ord, pos, norm, mask of the paragraphs that hold a run of the canon."""

    def make():
        rows, column, least, known = counting(spark, sf_dir)
        if column != "text":
            return clean_paragraphs(spark, sf_dir).where("mask IS NOT NULL").select("talk_id", "ord", "pos", "norm", "mask")
        return rows.select("talk_id", "ord", "text").mapInArrow(lambda batches: P.marked(batches, least, known.value), "talk_id long, ord int, pos int, norm array<string>, mask array<int>")

    return kept(spark, sf_dir, "marked", make)


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """talk_id, pos, clean: each paragraph's clean segments, between bars."""
    _, column, least, known = counting(spark, sf_dir)
    if column == "text":
        return K.clean_text(C.talks(spark, sf_dir).where(F.length("text") >= 2 * least - 1), least, known, 6)
    return clean_paragraphs(spark, sf_dir).select("talk_id", "pos", F.array_join(F.transform("clean", lambda g: F.array_join(g, " ")), " | ").alias("clean"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, total, first_ord, cap_mid, lower_mid: capitals and small letters after a small letter, comma or semicolon."""
    paras = C.paragraphs(C.addresses(spark, sf_dir))
    words = paras.select("ord", F.explode(T.words("para")).alias("word")).groupBy("word").agg(F.count("*").alias("total"), F.min("ord").alias("first_ord"))
    mid = paras.select(F.explode(F.regexp_extract_all("para", F.lit(r"(?<=[a-z,;] )[A-Za-z]+"), F.lit(0))).alias("w"))
    caps = mid.groupBy(F.lower("w").alias("word")).agg(F.count_if(F.col("w").rlike("^[A-Z]")).alias("cap"), F.count_if(F.col("w").rlike("^[a-z]")).alias("low"))
    return words.join(caps, "word", "left").select("word", "total", "first_ord", F.coalesce("cap", F.lit(0)).alias("cap_mid"), F.coalesce("low", F.lit(0)).alias("lower_mid"))


PHRASE = "of the"

_QUIET = T.QUIET_STOP.replace("'", "''")
SQL_NORM = f"""{C.SQL_TALKS}, {C.SQL_ADDRESS}, {C.SQL_PARAS},
norm AS (SELECT *, flatten(segs) AS norm FROM (SELECT talk_id, ord, speaker, grp, pos, para, list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(para), '{_QUIET}', '\\1\\2 ', 'g'), '[.!?]+'), lambda s: {C.sql_words('s')}), lambda s: len(s) > 0) AS segs FROM para))"""


def _sql_mask(n: int) -> str:
    return f"""{C.SQL_CANON}, shingle AS (SELECT DISTINCT unnest({C.sql_windows('toks', n)}) AS shingle FROM canon),
run AS (SELECT talk_id, pos, unnest(range(0, greatest(len(norm) - {n - 1}, 0))) AS i, unnest({C.sql_windows('norm', n)}) AS shingle FROM norm),
mask AS (SELECT talk_id, pos, list_sort(list(DISTINCT place)) AS mask FROM (SELECT talk_id, pos, unnest(range(i, i + {n})) AS place FROM run SEMI JOIN shingle USING (shingle)) GROUP BY 1, 2)"""


SQL_CLEAN = f"""{SQL_NORM}, {_sql_mask(6)},
clean AS (SELECT n.*, mask, CASE WHEN mask IS NULL THEN segs ELSE
  list_filter(list_transform(flatten(list_transform(segs, lambda s, k: string_split(array_to_string(list_transform(s, lambda w, j: CASE WHEN list_contains(mask, list_sum(list_transform(segs[1:k - 1], lambda x: len(x))::BIGINT[] || [0::BIGINT]) + j - 1) THEN '|' ELSE w END), ' '), '|'))),
    lambda t: list_filter(string_split(trim(t, ' '), ' '), lambda w: w <> '')), lambda s: len(s) > 0) END AS clean FROM norm n LEFT JOIN mask USING (talk_id, pos))"""
_STOPS = sql_list(STOPWORDS)
_GRAMS = "list_concat(" + ", ".join(C.sql_windows("seg", n) for n in (1, 2)) + ")"
for _n in (3, 4, 5):
    _GRAMS = f"list_concat({_GRAMS}, {C.sql_windows('seg', _n)})"
SQL_INDEX = f"""{SQL_CLEAN},
seg AS (SELECT talk_id, ord, speaker, grp, pos, unnest(clean) AS seg FROM clean),
gram AS (SELECT talk_id, ord, speaker, grp, unnest({_GRAMS}) AS term FROM seg),
uses AS (SELECT term, talk_id, ord, speaker, grp, count(*) AS c FROM gram WHERE string_split(term, ' ')[1] NOT IN ({_STOPS}) AND string_split(term, ' ')[-1] NOT IN ({_STOPS}) GROUP BY 1, 2, 3, 4, 5),
per AS (SELECT term, ord, sum(c)::BIGINT AS count, count(*) AS talks, count(DISTINCT speaker) AS speakers FROM uses GROUP BY 1, 2),
term_ord AS (SELECT * FROM per SEMI JOIN (SELECT term FROM per GROUP BY 1 HAVING sum(talks) >= {LEAST_TALKS}) USING (term)),
terms AS (SELECT term, min(ord) AS first_ord, sum(count)::BIGINT AS total_count, sum(talks)::BIGINT AS total_talks, len(string_split(term, ' '))::INT AS n FROM term_ord GROUP BY 1),
ord_stats AS (SELECT ord, sum(list_sum(list_transform(clean, lambda s: len(s))))::BIGINT AS words, count(DISTINCT talk_id) AS talks, count(DISTINCT speaker) AS speakers FROM clean GROUP BY 1)"""

QUERIES = {
    "txt_ngrams": lambda s, d: gram_talks(s, d).select("talk_id", "term", "c"),
    "idx_terms": terms,
    "idx_term_conf": term_ord,
    "idx_conf_stats": ord_stats,
    "phrase_history": lambda s, d: phrase_history(s, d, PHRASE),
    "txt_vocab_caps": vocabulary,
}
ORACLES = {
    "txt_ngrams": f"WITH {SQL_INDEX} SELECT talk_id, term, c FROM uses",
    "idx_terms": f"WITH {SQL_INDEX} SELECT * FROM terms",
    "idx_term_conf": f"WITH {SQL_INDEX} SELECT * FROM term_ord",
    "idx_conf_stats": f"WITH {SQL_INDEX} SELECT * FROM ord_stats",
    "phrase_history": f"""WITH {SQL_INDEX}, k AS (SELECT talk_id, ord, speaker, len(list_filter({C.sql_windows('seg', len(PHRASE.split()))}, lambda g: g = '{PHRASE}')) AS k FROM seg)
      SELECT ord, sum(k)::BIGINT AS count, count(DISTINCT talk_id) AS talks, count(DISTINCT speaker) AS speakers FROM k WHERE k > 0 GROUP BY 1""",
    "txt_vocab_caps": f"""WITH {C.SQL_TALKS}, {C.SQL_ADDRESS}, {C.SQL_PARAS}, w AS (SELECT word, count(*) AS total, min(ord) AS first_ord FROM (SELECT ord, unnest({C.sql_words('para')}) AS word FROM para) GROUP BY 1),
      m AS (SELECT unnest(list_transform(list_filter(range(1, len(p) + 1), lambda i: regexp_matches(p[i], '^[A-Za-z]') AND i > 1 AND regexp_matches(p[i - 1], '[a-z,;]$')), lambda i: regexp_extract(p[i], '^[A-Za-z]+'))) AS w FROM (SELECT string_split(para, ' ') AS p FROM para)),
      c AS (SELECT lower(w) AS word, count(*) FILTER (regexp_matches(w, '^[A-Z]')) AS cap, count(*) FILTER (regexp_matches(w, '^[a-z]')) AS low FROM m GROUP BY 1)
      SELECT word, total, first_ord, coalesce(cap, 0) AS cap_mid, coalesce(low, 0) AS lower_mid FROM w LEFT JOIN c USING (word)""",
}
