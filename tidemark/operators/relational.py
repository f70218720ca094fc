"""The relational shapes that the other operators are made of, over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as T
from ..plans.nearest import nearest
from ..sources import corpus as C
from . import index as I

_t = C.table


def join_inner_using(s, d) -> DataFrame:
    return _t(s, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey").join(_t(s, d, "nation"), "n_nationkey").withColumnRenamed("n_regionkey", "r_regionkey").join(_t(s, d, "region"), "r_regionkey").groupBy("r_name", "n_name").agg(F.count("*").alias("n"))


def join_left(s, d) -> DataFrame:
    o = _t(s, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return _t(s, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


def join_semi(s, d) -> DataFrame:
    big = _t(s, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(s, d, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


def join_anti(s, d) -> DataFrame:
    return _t(s, d, "customer").join(_t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


def join_self_edge(s, d) -> DataFrame:
    """Edges order -> part, met in another order: pairs of orders that share a part and a supplier."""
    e = _t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    other = e.withColumnRenamed("l_orderkey", "other")
    return e.join(other, ["l_partkey", "l_suppkey"]).where("l_orderkey < other").select("l_orderkey", "other").distinct()


def join_range(s, d) -> DataFrame:
    """For every bucket the talks of the ten before it: a range, so each talk is spread over the buckets it counts for."""
    talks = C.talks(s, d).select("talk_id", F.explode(F.sequence(F.col("ord") + 1, F.col("ord") + 10)).alias("ord"))
    return talks.where(F.col("ord") <= C.BUCKETS).groupBy("ord").agg(F.count("*").alias("talks"))


def join_theta_contains(s, d) -> DataFrame:
    """Canon lines that a talk holds word for word, found by their first shingle and then proved on the texts of those."""
    canon = C.canon(s, d).where(F.size("toks") >= 6).select("book", "chapter", "verse", F.array_join("toks", " ").alias("line"), F.array_join(F.slice("toks", 1, 6), " ").alias("run"))
    talks, known = C.talks(s, d).select("talk_id", "text"), I.sent(canon.select(F.col("run").alias("shingle")).distinct())
    if known is None:
        words = T.pinned(talks, "w", T.words("text"))
        found = words.select("talk_id", F.explode(F.array_distinct(T.windows("w", 6))).alias("run")).join(canon.select("run").distinct(), "run", "left_semi")
    else:
        found = K.hits(talks, known, 6)
    norm = F.concat(F.lit(" "), F.array_join(T.words("text"), " "), F.lit(" "))
    texts = talks.join(found.select("talk_id").distinct(), "talk_id", "left_semi").select("talk_id", norm.alias("norm"))
    return found.join(canon, "run").join(texts, "talk_id").where(F.col("norm").contains(F.concat(F.lit(" "), "line", F.lit(" ")))).select("talk_id", "book", "chapter", "verse").distinct()


def join_nearest(s, d) -> DataFrame:
    """Every German talk with the English talk of the same speaker whose id is nearest, ties to the lower id."""
    talks = C.talks(s, d)
    found = nearest(talks.where("grp = 'de'"), talks.where("grp = 'en'"), "speaker", "talk_id", "grp")
    return found.select("talk_id", "other")


def subq_scalar_corr(s, d) -> DataFrame:
    per = _t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_suppkey").alias("suppliers"))
    return _t(s, d, "orders").join(per, "o_orderkey", "left").select("o_orderkey", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def subq_exists(s, d) -> DataFrame:
    late = _t(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(s, d, "orders").join(late, "o_orderkey", "left_anti").agg(F.count("*").alias("n"))


def agg_case(s, d) -> DataFrame:
    li = _t(s, d, "lineitem")
    return li.groupBy("l_linestatus").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("discounted"))


def agg_distinct(s, d) -> DataFrame:
    return _t(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"))


def agg_having(s, d) -> DataFrame:
    return _t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


def agg_group_ordinal(s, d) -> DataFrame:
    return s.sql("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM {lines} GROUP BY 1, 2", lines=_t(s, d, "lineitem"))


def sort_topk(s, d) -> DataFrame:
    return _t(s, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def distinct(s, d) -> DataFrame:
    return _t(s, d, "part").select("p_brand", "p_size").distinct()


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows, a key's new row in place of its old one; of several new rows of one key the first by its columns."""
    tagged = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.col("_age").desc(), *[F.col(c) for c in old.columns if c != key])
    return tagged.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_age", "_k")


def _upserted(s, d):
    old = _t(s, d, "nation").select("n_nationkey", "n_name")
    new = s.createDataFrame([(3, "renamed"), (99, "added")], "n_nationkey int, n_name string")
    return upsert(old, new, "n_nationkey")


QUERIES = {f.__name__: f for f in (
    join_inner_using, join_left, join_semi, join_anti, join_self_edge, join_range, join_theta_contains, join_nearest, subq_scalar_corr, subq_exists, agg_case, agg_distinct, agg_having, agg_group_ordinal, sort_topk, distinct,
)} | {"upsert": _upserted}
ORACLES = {
    "join_inner_using": "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1",
    "join_semi": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)",
    "join_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "join_self_edge": "SELECT DISTINCT a.l_orderkey, b.l_orderkey AS other FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey",
    "join_range": f"WITH {C.SQL_TALKS} SELECT o::INT AS ord, count(*) AS talks FROM range(1, {C.BUCKETS + 1}) r(o) JOIN talk ON ord BETWEEN o - 10 AND o - 1 GROUP BY 1",
    "join_theta_contains": f"WITH {C.SQL_TALKS}, {C.SQL_CANON}, w AS (SELECT talk_id, ' ' || array_to_string({C.sql_words('text')}, ' ') || ' ' AS norm FROM talk) SELECT DISTINCT talk_id, book, chapter, verse FROM w JOIN canon ON len(toks) >= 6 AND contains(norm, ' ' || array_to_string(toks, ' ') || ' ')",
    "join_nearest": f"WITH {C.SQL_TALKS} SELECT a.talk_id, b.talk_id AS other FROM talk a JOIN talk b ON a.speaker = b.speaker AND a.grp = 'de' AND b.grp = 'en' QUALIFY row_number() OVER (PARTITION BY a.talk_id ORDER BY abs(a.talk_id - b.talk_id), b.talk_id) = 1",
    "subq_scalar_corr": "SELECT o_orderkey, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS suppliers FROM orders",
    "subq_exists": "SELECT count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "agg_case": "SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R') AS returned, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS discounted FROM lineitem GROUP BY 1",
    "agg_distinct": "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15",
    "agg_group_ordinal": "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "sort_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "upsert": "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'renamed' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 99, 'added'",
}
