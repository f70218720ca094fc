"""Quotations of the canon and links between pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.store import kept
from ..sources import corpus as C
from . import index as I

LEAST_RUN, SHARE, STOCK_TALKS = 8, 0.6, 150


def verse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shingle, book, chapter, verse: every six-word run of the canon and where it stands."""
    return C.canon(spark, sf_dir).select("book", "chapter", "verse", F.explode(T.windows("toks", 6)).alias("shingle")).distinct()


def parallel(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    """Verse pairs of different books that share runs; runs of more than five verses are no evidence."""
    idx = verse_index(spark, sf_dir)
    few = idx.groupBy("shingle").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 5").select("shingle")
    one = idx.join(few, "shingle", "left_semi")
    two = one.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("book", "chapter", "verse")))
    return one.join(two, "shingle").where("book < book_b").groupBy("book", "chapter", "verse", "book_b", "chapter_b", "verse_b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def formulas(spark: SparkSession, sf_dir: str, talks: int = STOCK_TALKS) -> DataFrame:
    """Canon runs that more than so many talks use: stock phrases."""
    return _talk_hits(spark, sf_dir).groupBy("shingle").agg(F.countDistinct("talk_id").alias("talks")).where(F.col("talks") > talks)


def _talk_hits(spark, sf_dir):
    paras = I.marked_paragraphs(spark, sf_dir).select("talk_id", "ord", "pos", F.posexplode(T.windows("norm", 6)).alias("i", "shingle"))
    return paras.join(C.canon_shingles(spark, sf_dir), "shingle", "left_semi")


def quoted(spark: SparkSession, sf_dir: str, least: int = LEAST_RUN) -> DataFrame:
    """talk_id, ord, pos, start, words, book, chapter, verse, votes: masked runs and the verses they most agree with.

    A run is masked tokens in a row; the verses that its six-word runs vote for stay if they have at least two votes
    and 60 % of the leader's, all of one book (the first among the leaders)."""

    def make():
        marked = I.marked_paragraphs(spark, sf_dir).select("talk_id", "ord", "pos", F.posexplode("mask").alias("k", "at"))
        runs = marked.groupBy("talk_id", "ord", "pos", (F.col("at") - F.col("k")).alias("island")).agg(F.min("at").alias("start"), F.count("*").alias("words")).where(F.col("words") >= least)
        hits = _talk_hits(spark, sf_dir).join(runs, ["talk_id", "ord", "pos"]).where((F.col("i") >= F.col("start")) & (F.col("i") + 6 <= F.col("start") + F.col("words")))
        votes = hits.join(verse_index(spark, sf_dir), "shingle").groupBy("talk_id", "ord", "pos", "start", "words", "book", "chapter", "verse").agg(F.count("*").alias("votes"))
        run = Window.partitionBy("talk_id", "pos", "start")
        top = votes.withColumn("top", F.max("votes").over(run)).where(F.col("votes") >= F.greatest(F.lit(2.0), SHARE * F.col("top")))
        return top.withColumn("lead", F.min(F.struct(-F.col("votes"), "book")).over(run)["book"]).where("book = lead").drop("top", "lead")

    return kept(spark, sf_dir, "quoted", make)


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each verse and paragraph with the longest run."""
    return quoted(spark, sf_dir).groupBy("talk_id", "ord", "pos", "book", "chapter", "verse").agg(F.max("words").alias("words"))


def chapter_signals(spark: SparkSession, sf_dir: str, c: int = C.BUCKETS, prior: float = 10.0) -> DataFrame:
    """book, chapter, now, before, z: talks that quote a chapter at c against the ten buckets before."""
    uses = built(spark, sf_dir).where(F.col("ord").between(c - 10, c))
    now, before = F.col("ord") == c, F.col("ord") < c
    per = uses.groupBy("book", "chapter").agg(F.countDistinct(F.when(now, F.col("talk_id"))).alias("now"), F.countDistinct(F.when(before, F.col("talk_id"))).alias("before"))
    stats = I.ord_stats(spark, sf_dir).where(F.col("ord").between(c - 10, c)).agg(F.sum(F.when(now, F.col("talks"))).alias("n_i"), F.sum(F.when(before, F.col("talks"))).alias("n_j"))
    joined = per.crossJoin(F.broadcast(stats))  # one row
    share = (F.col("now") + F.col("before")) / (F.col("n_i") + F.col("n_j"))
    return joined.select("book", "chapter", "now", "before", F.round(T.log_odds(F.col("now"), F.col("n_i"), F.col("before"), F.col("n_j"), prior * share, prior), 5).alias("z"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, href of every link."""
    pages = C.table(spark, sf_dir, "pages")
    found = pages.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))
    return found.where("href <> ''")


def top_cited(spark: SparkSession, sf_dir: str, limit: int = 20) -> DataFrame:
    """Targets by distinct citing hosts, then name."""
    return links(spark, sf_dir).groupBy("href").agg(F.countDistinct("host").alias("hosts"), F.count("*").alias("n")).orderBy(F.col("hosts").desc(), "href").limit(limit)


_SQL_Q = f"""{I.SQL_CLEAN}, vidx AS (SELECT DISTINCT book, chapter, verse, unnest({C.sql_windows('toks', 6)}) AS shingle FROM canon),
hit AS (SELECT talk_id, pos, i, shingle FROM run SEMI JOIN shingle USING (shingle)),
isl AS (SELECT talk_id, pos, min(p) AS start, count(*) AS words FROM (SELECT talk_id, pos, unnest(mask) AS p, unnest(range(0, len(mask))) AS k FROM mask) GROUP BY talk_id, pos, p - k HAVING count(*) >= {LEAST_RUN}),
votes AS (SELECT talk_id, pos, start, words, book, chapter, verse, count(*) AS votes FROM hit JOIN isl USING (talk_id, pos) JOIN vidx USING (shingle) WHERE i >= start AND i + 6 <= start + words GROUP BY ALL),
q0 AS (SELECT *, max(votes) OVER w AS top, (first_value(book) OVER (PARTITION BY talk_id, pos, start ORDER BY votes DESC, book)) AS lead FROM votes WINDOW w AS (PARTITION BY talk_id, pos, start)),
quoted AS (SELECT q0.*, ord FROM q0 JOIN (SELECT DISTINCT talk_id, ord FROM clean) USING (talk_id) WHERE votes >= greatest(2, {SHARE} * top) AND book = lead),
built AS (SELECT talk_id, ord, pos, book, chapter, verse, max(words) AS words FROM quoted GROUP BY ALL)"""
_LINKS = """l AS (SELECT page_id, host, href FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) WHERE href <> '')"""

QUERIES = {
    "s_verse_index": verse_index,
    "s_parallel": lambda s, d: parallel(s, d, 1),
    "s_formulas": lambda s, d: formulas(s, d, 2),
    "s_quoted": lambda s, d: quoted(s, d).select("talk_id", "pos", "start", "words", "book", "chapter", "verse", "votes"),
    "s_build": built,
    "s_signals": chapter_signals,
    "c_top_cited": top_cited,
    "c_signals": lambda s, d: links(s, d).groupBy("href").agg(F.countDistinct(F.when(F.col("page_id") % 10 == 0, F.col("page_id"))).alias("now"), F.countDistinct(F.when(F.col("page_id") % 10 != 0, F.col("page_id"))).alias("before")),
    "c_legacy": lambda s, d: links(s, d).where("page_id % 2 = 0").groupBy("href").count().orderBy(F.col("count").desc(), "href").limit(20).select("href").intersect(links(s, d).where("page_id % 2 = 1").groupBy("href").count().orderBy(F.col("count").desc(), "href").limit(20).select("href")),
    "c_uri": lambda s, d: C.table(s, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/?#]+(/[^?#]*)", 1).alias("uri")),
    "c_volumes": lambda s, d: built(s, d).join(s.createDataFrame([(0, "first"), (1, "second")], "book int, name string"), "book", "left").select("talk_id", "pos", "verse", F.coalesce("name", F.lit("other")).alias("volume")),
    "c_booknames": lambda s, d: C.canon(s, d).select("book", "chapter").distinct().select("book", "chapter", F.coalesce(F.try_element_at(F.create_map(F.lit(0), F.lit("Genesis")), F.col("book")), F.concat(F.lit("Book "), F.col("book").cast("string"))).alias("name")),
}
ORACLES = {
    "s_verse_index": f"WITH {C.SQL_CANON} SELECT DISTINCT book, chapter, verse, unnest({C.sql_windows('toks', 6)}) AS shingle FROM canon",
    "s_parallel": f"""WITH {C.SQL_CANON}, v AS (SELECT DISTINCT book, chapter, verse, unnest({C.sql_windows('toks', 6)}) AS shingle FROM canon), f AS (SELECT shingle FROM v GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5)
      SELECT a.book, a.chapter, a.verse, b.book AS book_b, b.chapter AS chapter_b, b.verse AS verse_b, count(*) AS n FROM v a JOIN v b USING (shingle) SEMI JOIN f USING (shingle) WHERE a.book < b.book GROUP BY ALL""",
    "s_formulas": f"WITH {_SQL_Q} SELECT shingle, count(DISTINCT talk_id) AS talks FROM hit GROUP BY 1 HAVING count(DISTINCT talk_id) > 2",
    "s_quoted": f"WITH {_SQL_Q} SELECT talk_id, pos::INT AS pos, start::INT AS start, words, book, chapter, verse, votes FROM quoted",
    "s_build": f"WITH {_SQL_Q} SELECT talk_id, ord, pos::INT AS pos, book, chapter, verse, words FROM built",
    "s_signals": f"""WITH {_SQL_Q}, p AS (SELECT book, chapter, count(DISTINCT talk_id) FILTER (ord = {C.BUCKETS}) AS now, count(DISTINCT talk_id) FILTER (ord < {C.BUCKETS}) AS before FROM built WHERE ord BETWEEN {C.BUCKETS - 10} AND {C.BUCKETS} GROUP BY 1, 2),
      n AS (SELECT count(DISTINCT talk_id) FILTER (ord = {C.BUCKETS})::DOUBLE AS ni, count(DISTINCT talk_id) FILTER (ord < {C.BUCKETS})::DOUBLE AS nj FROM clean WHERE ord BETWEEN {C.BUCKETS - 10} AND {C.BUCKETS}),
      q AS (SELECT *, 10 * (now + before) / (ni + nj) AS al FROM p, n)
      SELECT book, chapter, now, before, round((ln((now + al) / (ni + 10 - now - al)) - ln((before + al) / (nj + 10 - before - al))) / sqrt(1 / (now + al) + 1 / (before + al)), 5) AS z FROM q""",
    "c_top_cited": f"WITH {_LINKS} SELECT href, count(DISTINCT host) AS hosts, count(*) AS n FROM l GROUP BY 1 ORDER BY hosts DESC, href LIMIT 20",
    "c_signals": f"WITH {_LINKS} SELECT href, count(DISTINCT page_id) FILTER (page_id % 10 = 0) AS now, count(DISTINCT page_id) FILTER (page_id % 10 <> 0) AS before FROM l GROUP BY 1",
    "c_legacy": f"WITH {_LINKS} (SELECT href FROM (SELECT href, count(*) AS n FROM l WHERE page_id % 2 = 0 GROUP BY 1 ORDER BY n DESC, href LIMIT 20)) INTERSECT (SELECT href FROM (SELECT href, count(*) AS n FROM l WHERE page_id % 2 = 1 GROUP BY 1 ORDER BY n DESC, href LIMIT 20))",
    "c_uri": "SELECT page_id, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS uri FROM pages",
    "c_volumes": f"WITH {_SQL_Q} SELECT talk_id, pos::INT AS pos, verse, CASE book WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'other' END AS volume FROM built",
    "c_booknames": f"WITH {C.SQL_CANON} SELECT DISTINCT book, chapter, CASE WHEN book = 0 THEN 'Genesis' ELSE 'Book ' || book END AS name FROM canon",
}
