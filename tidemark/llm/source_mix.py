"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document has an exponential key ``-ln(u) / quality`` (u from a hash of its id and text, so reruns agree). A source
whose target is e whole epochs and a rest takes every document e times and, in key order, those whose prefix sum of
words stays within the rest; then the one untaken document whose size is nearest to the gap that is left, if it makes
the gap smaller. Prefix sums come from sums over ``BUCKETS`` ranges of the keys, then over as many ranges of the one that
the rest cuts; only the range of that which is cut is sorted, so no source, however large, is gathered into one task.

Null texts and texts without words have size 0; a null source is one source of its own, last in order; a null id
hashes as the empty string; rows repeated share key and fate up to the cut, where equal rows are interchangeable. Very
long texts count like others. An empty table gives no rows. Extra columns are ignored by ``mix`` and kept, whatever
their names, by ``mixed_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, split_join

WORD = r"[^\x20\x09-\x0D]+"
SHARES = (5, 2, 1)
MOST_EPOCHS = 3
BUCKETS = 1024
#: Sources up to which their table (about 60 bytes a row) is sent to every executor; beyond it a plain join is used.
MOST_SENT = 100_000
#: Rows of id, hash of text and number (24 bytes) up to which they are sent; beyond it the texts are shuffled once.
MOST_IDS_SENT = 4_000_000


def quality(text: Column, size: Column) -> Column:
    """A weight from the text's shape: prose of 50 words and more counts double, scraps under 10 words half."""
    mean = F.length(text) / size
    return F.when(size < 10, 0.5).when((size >= 50) & mean.between(3, 12), 2.0).otherwise(1.0)


def targets(sources: DataFrame, shares: tuple = SHARES, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> target: shares of the total by weight, held at ``most`` sizes, the excess reshared.

    Sources sorted by limit per weight: the first ones are held as long as the level that is left for the rest is
    above their limit; the level at the first that isn't held, the highest of those after, applies to all others.
    """
    # one row a source in these windows
    order = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    weighed = sources.withColumn("w", F.element_at(F.array(*map(F.lit, shares)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(shares))) + 1).cast("int")))
    ranked = (
        weighed.withColumn("top", most * F.col("source_size"))
        .withColumn("ratio", F.col("top") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("held", F.coalesce(F.sum("top").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_w", F.sum("w").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("held")) / F.col("open_w"))
    )
    free = F.when(F.col("ratio") > F.col("level"), F.col("level"))
    return ranked.withColumn("at", F.max(free).over(whole)).select(
        *sources.columns, F.when(free.isNull(), F.col("top").cast("double")).otherwise(F.col("at") * F.col("w")).alias("target")
    )


def _with_source(rows: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """``rows`` with the columns of ``other``, one row a source; ``sk`` names the source in both."""
    if other.count() <= MOST_SENT:
        return rows.join(F.broadcast(other), "sk")
    return split_join(rows, other, "sk", name)


def _cut(sums: DataFrame, aims: DataFrame, by: str) -> DataFrame:
    """sk, cut, before: the last range ``by`` that begins within the rest, and the words before it (-1 where there's no
    rest). ``sums``: sk, by, words; ``aims``: sk, rest, base (words before all ranges)."""
    so_far = Window.partitionBy("sk").orderBy(by)
    before = sums.withColumn("ahead", F.sum("words").over(so_far) - F.col("words")).join(aims, "sk").withColumn("before", F.col("base") + F.col("ahead"))
    found = before.groupBy("sk").agg(F.max(F.when(F.col("before") < F.col("rest"), F.struct(by, "before"))).alias("x"))
    return found.select("sk", F.coalesce(f"x.{by}", F.lit(-1)).alias("cut"), F.coalesce("x.before", F.lit(0)).alias("before"))


def _mixed(docs: DataFrame, shares: tuple, most: int, buckets: int) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, copies of every row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    seed = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "text").cast("binary"))
    hashed = F.conv(F.substring(seed, 1, 13), 16, 10).cast("long")
    named = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    keyed = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_key"), size.alias("size"), named.alias("sk"))
    keyed = keyed.select("doc_id", "text_key", "source", "sk", "size", (-F.log((hashed + 1) / F.lit(2.0**52 + 1)) / quality(F.col("text"), F.col("size"))).alias("key"))
    fine = F.least(F.lit(buckets * buckets - 1), F.floor(buckets * buckets * (1 - F.exp(-F.col("key"))))).cast("long")
    keyed = durable(keyed.withColumn("fine", fine).withColumn("bucket", F.floor(F.col("fine") / buckets).cast("int")), "mix_keys")
    sums = durable(keyed.groupBy("sk", "source", "bucket").agg(F.sum("size").alias("words")), "mix_sums")
    aims = (
        targets(sums.groupBy("source", "sk").agg(F.sum("words").alias("source_size")), shares, most)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    aims = durable(aims.select("sk", "source_size", "target", "epochs", "rest"), "mix_aims")
    coarse = durable(_cut(sums, aims.select("sk", "rest", F.lit(0).alias("base")), "bucket"), "mix_cuts")
    inside = _with_source(keyed.select("sk", "bucket", "fine", "size"), coarse, "mix_hot_cuts").where("bucket = cut")
    within = durable(inside.groupBy("sk", "fine").agg(F.sum("size").alias("words")), "mix_within")
    deep = _cut(within, aims.join(coarse, "sk").select("sk", "rest", F.col("before").alias("base")), "fine")
    aims = durable(aims.join(deep, "sk", "left").withColumns({"cut": F.coalesce("cut", F.lit(-1)), "before": F.coalesce("before", F.lit(0))}), "mix_deep")

    placed = _with_source(keyed.drop("bucket"), aims, "mix_hot_rows")
    row = Window.partitionBy("sk").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where("fine = cut").withColumn("upto", F.col("before") + F.sum("size").over(row))
    edge = durable(edge.withColumn("extra", (F.col("upto") <= F.col("rest")).cast("int")), "mix_edge")
    got = edge.where("extra = 1").groupBy("sk").agg(F.max("upto").alias("got"))
    gaps = durable(aims.join(got, "sk", "left").select("sk", (F.col("rest") - F.coalesce("got", "before")).alias("gap")), "mix_gaps")
    rows = placed.where("fine <> cut").withColumn("extra", (F.col("fine") < F.col("cut")).cast("int")).unionByName(edge.drop("upto"))
    left = F.abs(F.col("size") - F.col("gap"))
    asked = _with_source(rows.where("extra = 0 AND size > 0"), gaps, "mix_hot_gaps").where((F.col("gap") > 0) & (left < F.col("gap")))
    last = asked.groupBy("sk").agg(F.min(F.struct(left.alias("off"), "key", "doc_id", "size", "text_key")).alias("last"))
    last = durable(last.select("sk", "last.key", "last.doc_id", "last.size", "last.text_key"), "mix_last").select("sk", F.struct("key", "doc_id", "size", "text_key").alias("last"))
    rows = _with_source(rows, aims.select("sk").join(last, "sk", "left"), "mix_hot_last")
    chosen = F.coalesce((F.col("extra") == 0) & F.struct("key", "doc_id", "size", "text_key").eqNullSafe(F.col("last")), F.lit(False))
    # of equal rows one is the last
    one = rows.where(chosen).withColumn("extra", (F.row_number().over(Window.partitionBy("sk").orderBy("key")) == 1).cast("int"))
    return rows.where(~chosen).unionByName(one).withColumn("copies", F.col("epochs") + F.col("extra"))


def mix(docs: DataFrame, shares: tuple = SHARES, most: int = MOST_EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source of every row of ``docs`` (doc_id, text, source)."""
    found = _mixed(docs, shares, most, buckets)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mixed_rows(docs: DataFrame, shares: tuple = SHARES, most: int = MOST_EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """All columns of ``docs``, each row as often as the mix takes it; rows of one id and text share their number."""
    id_, key, times, copy = (fresh(n, docs.columns) for n in ("taken_id", "taken_key", "times", "mix_copy"))
    taken = _mixed(docs, shares, most, buckets).groupBy("doc_id", "text_key").agg(F.max("copies").alias(times)).where(F.col(times) > 0)
    taken = durable(taken, "mix_taken").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), times)
    if taken.count() <= MOST_IDS_SENT:
        taken = F.broadcast(taken)
    rows = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)))
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).select(docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, length(text) AS chars,
         ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, text)), 1, 13))::BIGINT AS h
  FROM documents),
k AS (
  SELECT doc_id, source, size, -ln((h + 1) / (4503599627370496.0::DOUBLE + 1)) /
         CASE WHEN size < 10 THEN 0.5 WHEN size >= 50 AND chars / size BETWEEN 3 AND 12 THEN 2.0 ELSE 1.0 END AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY 1),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
r AS (SELECT *, 3 * source_size AS top, 3 * source_size / w AS ratio, sum(source_size) OVER () AS total FROM w),
l AS (
  SELECT *, (total - coalesce(sum(top) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (
  SELECT source, source_size, CASE WHEN ratio > level THEN max(CASE WHEN ratio > level THEN level END) OVER () * w ELSE top::DOUBLE END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::INT AS epochs FROM t),
c AS (
  SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
p AS (SELECT *, rest > 0 AND upto <= rest AS within, rest - coalesce(max(CASE WHEN rest > 0 AND upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM c),
q AS (SELECT *, NOT within AND size > 0 AND abs(size - gap) < gap AS asked FROM p),
n AS (SELECT *, asked AND row_number() OVER (PARTITION BY source, asked ORDER BY abs(size - gap), key, doc_id NULLS FIRST, size) = 1 AS last FROM q)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN within OR last THEN 1 ELSE 0 END))::BIGINT AS taken,
       (epochs + CASE WHEN within OR last THEN 1 ELSE 0 END)::INT AS copies, source
FROM n
"""
