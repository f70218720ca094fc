"""The corpus model over the given tables: talks in time buckets, paragraphs, canon, links and vectors.

A document is a talk; its source is the speaker, its language the group; 40 ranges of equal length of doc_id, from the
smallest to the largest, are the buckets (``ord`` 1 to 40, two a year from April 1971), and a document without an id has
no place in time and is left out; the lines of the text are paragraphs; a talk of 150 words and more
is an address; the benchmark passages are the canon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.store import fact, kept

BUCKETS = 40
ADDRESS_WORDS = 150


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """The documents and their smallest and largest id, which are looked up once an application.

    A table of fewer partitions than there are cores is written anew in as many: it is small by that measure."""

    def seen() -> tuple[bool, int, int]:
        docs = table(spark, sf_dir, "documents")
        low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        few = docs._jdf.queryExecution().toRdd().getNumPartitions() < spark.sparkContext.defaultParallelism
        return few, 0 if low is None else low, 0 if high is None else high

    few, low, high = fact(spark, sf_dir, "documents", seen)
    docs = table(spark, sf_dir, "documents")
    if few:
        docs = kept(spark, sf_dir, "documents", lambda: docs.repartition(spark.sparkContext.defaultParallelism))
    return docs, low, high


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """talk_id, ord, year, decade, speaker, grp, title, text."""
    docs, low, high = _documents(spark, sf_dir)
    ord_ = (F.floor((F.col("doc_id") - low) * BUCKETS / F.lit(high - low + 1)) + 1).cast("int")
    year = (1971 + F.floor((F.col("ord") - 1) / 2)).cast("int")
    return docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").alias("talk_id"), ord_.alias("ord"), F.col("source").alias("speaker"), F.col("lang").alias("grp"), F.substring("text", 1, 60).alias("title"), "text"
    ).withColumn("year", year).withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).where(F.size(T.words("text")) >= ADDRESS_WORDS)


def paragraphs(of: DataFrame) -> DataFrame:
    """talk_id, ord, speaker, grp, pos, para: the lines of each talk that aren't blank."""
    lines = of.select("talk_id", "ord", "speaker", "grp", F.posexplode(F.split("text", "\n")).alias("pos", "para"))
    return lines.where(F.trim("para") != "")


def spine(spark: SparkSession, first: int = 1, last: int = BUCKETS) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("ord"))


def canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, chapter, verse, toks: the benchmark passages by line."""
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("verse", "line"))
    return lines.select((F.floor(F.col("item_id") / 10)).cast("int").alias("book"), (F.col("item_id") % 10).cast("int").alias("chapter"), (F.col("verse") + 1).alias("verse"), T.words("line").alias("toks"))


def canon_shingles(spark: SparkSession, sf_dir: str, n: int = 6) -> DataFrame:
    return canon(spark, sf_dir).select(F.explode(T.windows("toks", n)).alias("shingle")).distinct()


#: DuckDB counterparts of the above, as common table expressions.
SQL_TALKS = f"""
span AS (SELECT min(doc_id) AS low, max(doc_id) AS high FROM documents),
talk0 AS (SELECT doc_id AS talk_id, (((doc_id - low) * {BUCKETS}) // (high - low + 1) + 1)::INT AS ord, source AS speaker, lang AS grp, substr(text, 1, 60) AS title, text FROM documents, span WHERE doc_id IS NOT NULL),
talk AS (SELECT *, (1971 + (ord - 1) // 2)::INT AS year, (((1971 + (ord - 1) // 2) // 10) * 10)::INT AS decade FROM talk0)"""


def sql_words(text: str) -> str:
    return f"list_transform(regexp_extract_all(regexp_replace(lower({text}), '[0-9][0-9a-z]*', ' ', 'g'), '[a-z]+(?:[''’][a-z]+)*'), lambda w: replace(w, '’', ''''))"


def sql_runs(text: str, least: int = 1) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[\\pL\\pN\\pM_]+'), lambda x: regexp_full_match(x, '[a-z]{{{least},}}'))"


def sql_windows(tokens: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({tokens}) - {n} + 2, 1)), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"


SQL_ADDRESS = f"address AS (SELECT * FROM talk WHERE len({sql_words('text')}) >= {ADDRESS_WORDS})"
SQL_PARAS = "para AS (SELECT * FROM (SELECT talk_id, ord, speaker, grp, unnest(string_split(text, chr(10))) AS para, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM address) WHERE trim(para, ' ') <> '')"
SQL_CANON = f"""
line0 AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS verse FROM benchmark),
canon AS (SELECT (item_id // 10)::INT AS book, (item_id % 10)::INT AS chapter, verse::INT AS verse, {sql_words('line')} AS toks FROM line0)"""
