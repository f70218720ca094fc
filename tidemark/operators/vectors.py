"""Vector search, clusters and topics over embeddings."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as T
from ..functions.lexicon import STOPWORDS, sql_list
from ..plans.graph import components
from ..plans.quantile import quantile
from ..plans.store import kept, written
from ..sources import corpus as C
from . import index as I


#: Length of a text's vector of word counts; letters of text that passages are made of at once.
SIZE, ROOM = 64, 4_000_000


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, ord, v: vectors dealt over the buckets by id."""
    e = C.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", (F.col("vec_id") % C.BUCKETS + 1).cast("int").alias("ord"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _query(spark, sf_dir, vec_id: int) -> list[float]:
    """The vector of an id; none gives an empty query, which nothing is near."""
    found = vectors(spark, sf_dir).where(F.col("vec_id") == vec_id).first()
    return list(found["v"]) if found else []


def search(rows: DataFrame, query: list[float], top: int = 10) -> DataFrame:
    """The rows nearest to one vector by cosine; filters on ``rows`` come before the cut."""
    q = F.array(*[F.lit(x) for x in query]).cast("array<double>")
    return rows.where(F.lit(bool(query))).withColumn("sim", F.round(T.cosine("v", q), 6)).orderBy(F.col("sim").desc(), "vec_id").limit(top).select("vec_id", "label", "sim")


def similar(spark: SparkSession, sf_dir: str, vec_id: int, top: int = 10, other_label: bool = False) -> DataFrame:
    rows = vectors(spark, sf_dir)
    own = rows.where(F.col("vec_id") == vec_id).first()
    rest = rows.where(F.col("vec_id") != vec_id)
    if own is None:
        return search(rest, [], top)
    return search(rest.where(F.col("label") != own["label"]) if other_label else rest, list(own["v"]), top)


def shift(spark: SparkSession, sf_dir: str, query: list[float], top: int = 3) -> DataFrame:
    """The nearest rows of each bucket."""
    q = F.array(*[F.lit(x) for x in query]).cast("array<double>")
    rows = vectors(spark, sf_dir).where(F.lit(bool(query))).withColumn("sim", F.round(T.cosine("v", q), 6))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("ord").orderBy(F.col("sim").desc(), "vec_id"))).where(F.col("k") <= top).select("ord", "k", "vec_id", "sim")


def kmeans(spark: SparkSession, sf_dir: str, k: int = 10, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors(spark, sf_dir).select("vec_id", array_to_vector("v").alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two principal components; their signs are arbitrary."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors(spark, sf_dir).select("vec_id", "label", array_to_vector("v").alias("features"))
    p = vector_to_array(F.col("p"))
    return PCA(k=2, inputCol="features", outputCol="p").fit(rows).transform(rows).select("vec_id", "label", p[0].alias("x"), p[1].alias("y"))


def _coded(texts: DataFrame, key: str, size: int) -> DataFrame:
    """key, ks: the hashes of each text's words, below ``size``."""
    return texts.select(key, F.transform(T.words("text"), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("short")).alias("ks")).where(F.size("ks") > 0)


def _counts(coded: DataFrame, key: str, size: int) -> DataFrame:
    """key, v: how often each hash occurs in all rows of a key."""
    rows = coded.groupBy(key).agg(F.flatten(F.collect_list("ks")).alias("ks"))

    def made(batches):
        for batch in batches:
            many = batch.column("ks").value_lengths().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(batch.num_rows), many) * size + batch.column("ks").flatten().to_numpy(zero_copy_only=False)
            v = pa.array(np.bincount(at, minlength=batch.num_rows * size).astype(float))
            yield pa.record_batch([batch.column(key), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * size, pa.int32()), v)], [key, "v"])

    return rows.mapInArrow(made, f"{key} {dict(rows.dtypes)[key]}, v array<double>")


def hashed(texts: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """A vector of a text without a language model: counts of its words by hash; ``texts`` has the key and text."""
    return _counts(_coded(texts, key, size), key, size)


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, centroid (unit length), size: means by label. As many rows as topics."""

    def make():
        long = vectors(spark, sf_dir).select("label", F.posexplode("v").alias("k", "x"))
        mean = long.groupBy("label", "k").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
        one = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("c"), F.max("n").alias("size"))
        return one.select(F.col("label").alias("topic"), F.transform("c", lambda x: x / F.sqrt(T.dot("c", "c"))).alias("centroid"), "size")

    return kept(spark, sf_dir, "centroids", make)


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, ord, topic, sim: the centroid with the largest inner product. Centroids are model-sized and are sent."""
    unit = vectors(spark, sf_dir).select("vec_id", "ord", "label", F.transform("v", lambda x: x / F.sqrt(T.dot("v", "v"))).alias("u"))
    all_ = unit.crossJoin(F.broadcast(centroids(spark, sf_dir).select("topic", "centroid"))).withColumn("sim", T.dot("u", "centroid"))
    return all_.groupBy("vec_id", "ord").agg(F.max(F.struct("sim", (-F.col("topic")).alias("t"))).alias("b")).select("vec_id", "ord", (-F.col("b.t")).alias("topic"), F.col("b.sim").alias("sim"))


def assigned(spark: SparkSession, sf_dir: str, share: float = 0.1) -> DataFrame:
    """Topic -1 below the quantile of similarities."""

    def make():
        near = kept(spark, sf_dir, "nearest_topic", lambda: nearest(spark, sf_dir))
        cut = quantile(near, "sim", share)
        low = F.col("sim") < F.lit(cut if cut is not None else 0.0)
        return near.select("vec_id", "ord", F.when(low, -1).otherwise(F.col("topic")).alias("topic"), F.round("sim", 6).alias("sim"))

    return kept(spark, sf_dir, "assigned", make)


def cluster_summary(spark: SparkSession, sf_dir: str, top: int = 3) -> DataFrame:
    """label, size, and its most central members."""
    rows = vectors(spark, sf_dir).join(F.broadcast(centroids(spark, sf_dir)), F.col("label") == F.col("topic")).withColumn("sim", F.round(T.cosine("v", "centroid"), 6))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.col("sim").desc(), "vec_id"))).where(F.col("k") <= top).select("label", "size", "k", "vec_id", "sim")


def ctfidf(spark: SparkSession, sf_dir: str, top: int = 15, features: int = 60_000) -> DataFrame:
    """group, term, score, rank: share of the group's n-grams times ln(1 + mean size / uses), stop words out first."""
    kept_words = F.filter(T.words("text"), lambda w: ~w.isin(STOPWORDS))
    toks = T.pinned(C.talks(spark, sf_dir).select("grp", "text"), "toks", kept_words)
    grams = toks.select("grp", F.explode(F.concat("toks", T.windows("toks", 2))).alias("term"))
    tf = grams.groupBy("grp", "term").agg(F.count("*").alias("f"))
    total = tf.groupBy("term").agg(F.sum("f").alias("all")).orderBy(F.col("all").desc(), "term").limit(features)
    tf = tf.join(total, "term")
    size = tf.groupBy("grp").agg(F.sum("f").alias("size"))
    mean = size.agg(F.avg("size").alias("mean"))
    score = F.round(F.col("f") / F.col("size") * F.log(1 + F.col("mean") / F.col("all")), 9)
    rows = tf.join(F.broadcast(size), "grp").crossJoin(F.broadcast(mean)).withColumn("score", score)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("score").desc(), "term"))).where(F.col("rank") <= top).select("grp", "term", "score", "rank")


def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).groupBy("topic", "ord").agg(F.count("*").alias("passages"))


def topic_signals(spark: SparkSession, sf_dir: str, c: int = C.BUCKETS, z_least: float = 2.0) -> DataFrame:
    """topic, passages, share, base_share, older_share, z, cls and history at c.

    A topic's passages by bucket are one array, gaps 0; the totals by bucket are at most c numbers."""
    per = topic_counts(spark, sf_dir).where(F.col("ord") <= c)
    totals = {r["ord"]: r["n"] for r in per.groupBy("ord").agg(F.sum("passages").alias("n")).collect()}
    n = [float(totals.get(o, 0)) for o in range(1, c + 1)]
    by = per.where("topic >= 0").groupBy("topic").agg(F.map_from_entries(F.collect_list(F.struct("ord", "passages"))).alias("m"))
    rows = by.select("topic", F.transform(F.sequence(F.lit(1), F.lit(c)), lambda o: F.coalesce(F.try_element_at("m", o), F.lit(0)).cast("double")).alias("p"))
    part = lambda a, b: F.aggregate(F.slice("p", a + 1, b - a), F.lit(0.0), lambda s, x: s + x) if b > a else F.lit(0.0)
    base, older = (max(0, c - 11), c - 1), (max(0, c - 31), max(0, c - 11))
    n_c, n_b, n_o = n[c - 1], sum(n[base[0] : base[1]]), sum(n[older[0] : older[1]])
    rows = rows.select("topic", "p", F.element_at("p", c).alias("y"), part(*base).alias("yb"), part(*older).alias("yo"), part(0, c).alias("all"))
    z = T.log_odds(F.col("y"), F.lit(n_c), F.col("yb"), F.lit(n_b), 50.0 * F.col("all") / sum(n), 50.0)
    rows = rows.withColumns({"share": F.col("y") / max(n_c, 1.0), "base_share": F.col("yb") / max(n_b, 1.0), "older_share": F.col("yo") / max(n_o, 1.0), "z": z})
    cls = F.when((F.col("y") == 0) & (F.col("base_share") * n_c >= 3), "absent").when((F.col("z") >= z_least) & (F.col("y") >= 3), "rising").when(F.col("z") <= -z_least, "fading")
    cls = cls.when((F.col("share") >= 1.5 * F.col("older_share")) & (F.col("base_share") >= 1.5 * F.col("older_share")) & (F.col("y") >= 3), "continuing").otherwise("steady")
    counts = F.array(*[F.lit(max(x, 1.0)) for x in n])
    return rows.select(
        "topic", F.col("y").cast("long").alias("passages"), F.round("share", 5).alias("share"), F.round("base_share", 5).alias("base_share"), F.round("older_share", 5).alias("older_share"), F.round("z", 4).alias("z"), cls.alias("cls"),
        F.array_join(F.zip_with("p", counts, lambda x, m: F.round(x / m, 5)), ",").alias("history"),
    )


def topic_words(spark: SparkSession, sf_dir: str, top: int = 5) -> DataFrame:
    """topic, word: the words that mark the talks of a topic most (as ``ctfidf``, single words); a vector is its talk's."""
    of = assigned(spark, sf_dir).where("topic >= 0").select(F.col("vec_id").alias("talk_id"), "topic")
    toks = C.talks(spark, sf_dir).join(of, "talk_id").select("topic", F.explode(T.words("text")).alias("word")).where(~F.col("word").isin(STOPWORDS))
    tf = kept(spark, sf_dir, "topic_words", lambda: toks.groupBy("topic", "word").agg(F.count("*").alias("f")))
    sizes = {r["topic"]: r["n"] for r in tf.groupBy("topic").agg(F.sum("f").alias("n")).collect()}  # as many as topics
    mean = sum(sizes.values()) / max(len(sizes), 1)
    size = F.try_element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, float(n))]), F.col("topic")) if sizes else F.lit(1.0)
    both = tf.join(tf.groupBy("word").agg(F.sum("f").alias("all")), "word")
    score = F.round(F.col("f") / size * F.log(1 + mean / F.col("all")), 9)
    order = Window.partitionBy("topic").orderBy(score.desc(), "word")
    return both.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).select("topic", "word")


def word_ratio(spark: SparkSession, sf_dir: str, c: int = C.BUCKETS) -> DataFrame:
    """topic, word_ratio: rate of the topic's leading words in c over their rate in the ten buckets before, else 1."""
    span = F.col("ord").between(c - 10, c)
    now, before = F.col("ord") == c, F.col("ord") < c
    total = I.ord_stats(spark, sf_dir).where(span).agg(F.sum(F.when(now, F.col("words"))), F.sum(F.when(before, F.col("words")))).first()
    uses = I.term_ord(spark, sf_dir).where(span).select(F.col("term").alias("word"), "ord", "count")
    sums = topic_words(spark, sf_dir).join(uses, "word", "left").groupBy("topic").agg(F.sum(F.when(now, F.col("count"))).alias("a"), F.sum(F.when(before, F.col("count"))).alias("b"))
    ratio = (F.coalesce("a", F.lit(0)) / float(total[0] or 1)) / (F.col("b") / float(total[1] or 1))
    return sums.select("topic", F.when(F.col("b") > 0, F.round(ratio, 2)).otherwise(1.0).alias("word_ratio"))


def merged(lines: list[tuple[int, str, int]], least: int) -> list[list[tuple[int, str, int]]]:
    """(place, text, words) in groups of ``least`` words and more; a short tail joins the group before it."""
    out, held, size = [], [], 0
    for line in lines:
        held.append(line)
        size += line[2]
        if size >= least:
            out.append(held)
            held, size = [], 0
    if held:
        out[-1:] = [out[-1] + held] if out else [held]
    return out


def passages(spark: SparkSession, sf_dir: str, least: int = 60) -> DataFrame:
    """talk_id, seq, first_pos, last_pos, words, sha, text: paragraphs merged until ``least`` words; a short tail joins
    the passage before it. One fold over a talk's own text, which is one row."""
    schema = pa.schema([("talk_id", pa.int64()), ("seq", pa.int32()), ("first_pos", pa.int32()), ("last_pos", pa.int32()), ("words", pa.int64()), ("text", pa.string()), ("sha", pa.string())])

    def made(batches):
        for batch in batches:
            rows, size = [], 0
            for talk, text in zip(batch.column("talk_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                lines = [(k, line, len(K.words(line))) for k, line in enumerate(text.split("\n")) if line.strip(" ")]
                if sum(n for _, _, n in lines) < C.ADDRESS_WORDS:
                    continue
                for seq, p in enumerate(merged(lines, least)):
                    whole = " ".join(t for _, t, _ in p)
                    rows.append((talk, seq, p[0][0], p[-1][0], sum(n for _, _, n in p), whole, hashlib.sha1(whole.encode()).hexdigest()))
                size += len(text)
                if size > ROOM:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    talks = C.talks(spark, sf_dir).where(F.length("text") >= 2 * C.ADDRESS_WORDS - 1).select("talk_id", "text")
    return talks.mapInArrow(made, "talk_id long, seq int, first_pos int, last_pos int, words long, text string, sha string")


def _shas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """talk_id, sha of the passages; read twice where some are cached and some not."""
    return kept(spark, sf_dir, "passage_shas", lambda: passages(spark, sf_dir).select("talk_id", "sha"))


def _uncached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha of the passages of which no talk of even id has one like it."""
    return missing(_shas(spark, sf_dir), _shas(spark, sf_dir).where("talk_id % 2 = 0"))


def missing(passage: DataFrame, cache: DataFrame) -> DataFrame:
    """sha of the passages that the cache of vectors lacks."""
    return passage.select("sha").distinct().join(cache.select("sha"), "sha", "left_anti")


def _met(left: DataFrame, right: DataFrame, block: int, meet, schema: str, once: bool = False) -> DataFrame:
    """``meet(ids, x, roots, ids, x, roots)`` of every block of ``left`` with every block of ``right`` (vec_id, v, root)."""

    def packed(rows: DataFrame, side: str) -> DataFrame:
        def fold(pdf):
            x = np.stack(pdf["v"].to_list())
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            return pd.DataFrame({f"b_{side}": [pdf["part"][0]], f"i_{side}": [pdf["vec_id"].to_numpy(np.int64).tobytes()], f"x_{side}": [x.tobytes()], f"r_{side}": [pdf["root"].to_numpy(np.int64).tobytes()]})

        import pandas as pd

        blocks = max(1, -(-rows.count() // block))
        return rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("part").applyInPandas(fold, f"b_{side} long, i_{side} binary, x_{side} binary, r_{side} binary")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ids = [np.frombuffer(b, np.int64) for b in (r.i_l, r.i_r, r.r_l, r.r_r)]
                x = [np.frombuffer(b, np.float64).reshape(len(i), -1) for b, i in ((r.x_l, ids[0]), (r.x_r, ids[1]))]
                yield meet(ids[0], x[0], ids[1], x[1], ids[3])

    pairs = written(packed(left, "l"), "blocks_l").crossJoin(written(packed(right, "r"), "blocks_r"))
    return (pairs.where("b_l <= b_r") if once else pairs).mapInPandas(run, schema)


def chained(rows: DataFrame, eps: float = 0.5, least: int = 5, block: int = 1024) -> DataFrame:
    """vec_id, cluster of ``rows`` (vec_id, v): density clusters, named by their smallest dense id; -1 is noise.

    Blocks meet pair by pair. A pair of blocks gives counts of neighbours, then the links of a spanning forest of its
    dense points, not all links; a border point goes to the smallest cluster within ``eps``."""
    import pandas as pd

    rows = written(rows.where("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v", F.col("vec_id").alias("root")), "density_rows")

    def counts(i, x, j, y, _):
        return pd.DataFrame({"vec_id": i, "n": (1 - x @ y.T <= eps).sum(1)})

    near = _met(rows, rows, block, counts, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    marked = written(rows.join(near, "vec_id"), "density_near")
    core = marked.where(F.col("n") >= least).select("vec_id", "v", "root")

    def forest(i, x, j, y, _):
        close, links = 1 - x @ y.T <= eps, []
        sides, ids, new = (close, close.T), (i, j), [np.ones(len(i), bool), np.ones(len(j), bool)]
        for k in range(len(i)):
            todo = [(0, k)] if new[0][k] else []
            new[0][k] = False
            while todo:
                side, at = todo.pop()
                reach = np.flatnonzero(sides[side][at] & new[1 - side])
                new[1 - side][reach] = False
                links += [(int(ids[side][at]), int(ids[1 - side][m])) for m in reach]
                todo += [(1 - side, m) for m in reach.tolist()]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    links = written(_met(core, core, block, forest, "a long, b long", True).where("a <> b"), "density_links")
    to = components(links, "density").select(F.col("node").alias("vec_id"), F.col("root").alias("to"))
    core = written(core.join(to, "vec_id", "left").select("vec_id", "v", F.coalesce("to", "vec_id").alias("root")), "density_core")

    def border(i, x, j, y, roots):
        found = np.where(1 - x @ y.T <= eps, roots[None, :], np.iinfo(np.int64).max).min(1)
        hit = found < np.iinfo(np.int64).max
        return pd.DataFrame({"vec_id": i[hit], "root": found[hit]})

    edge = _met(marked.where(F.col("n") < least).select("vec_id", "v", "root"), core, block, border, "vec_id long, root long").groupBy("vec_id").agg(F.min("root").alias("root"))
    every = core.select("vec_id", "root").unionByName(edge)
    return rows.select("vec_id").join(every, "vec_id", "left").select("vec_id", F.coalesce("root", F.lit(-1)).cast("long").alias("cluster"))


def density(spark: SparkSession, sf_dir: str, eps: float = 0.5, least: int = 5) -> DataFrame:
    """vec_id, label, cluster of all vectors: dense points within ``eps`` of each other (cosine distance) are chained."""
    rows = vectors(spark, sf_dir)
    return rows.select("vec_id", "label").join(chained(rows, eps, least), "vec_id")


def new_topics(spark: SparkSession, sf_dir: str, c: int = C.BUCKETS, cut: float = 0.35, least: int = 3) -> DataFrame:
    """vec_id, cluster among a bucket's vectors without a topic: average linkage by cosine distance under ``cut``."""
    def link(pdf):
        x = np.stack(pdf["v"].to_list())
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        groups = [[i] for i in range(len(x))]
        dist = 1 - x @ x.T
        while len(groups) > 1:
            pairs = [(dist[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i])]
            low, i, j = min(pairs)
            if low >= cut:
                break
            groups[j] += groups.pop(i)
        name = {m: k for k, g in enumerate(groups) for m in g if len(g) >= least}
        return pdf[["vec_id", "ord"]].assign(cluster=[name.get(i, -1) for i in range(len(x))])

    loose = assigned(spark, sf_dir).where((F.col("topic") == -1) & (F.col("ord") == c)).select("vec_id")
    return vectors(spark, sf_dir).join(loose, "vec_id", "left_semi").groupBy("ord").applyInPandas(link, "vec_id long, ord int, cluster int")


_V = f"v AS (SELECT vec_id, label, (vec_id % {C.BUCKETS} + 1)::INT AS ord, embedding::DOUBLE[] AS v FROM embeddings)"
_SIM = "round(list_cosine_similarity(v, (SELECT v FROM v WHERE vec_id = 7)), 6)"
_TOPIC = f"""{_V}, m AS (SELECT label, k, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(v) AS x, unnest(range(0, len(v))) AS k FROM v) GROUP BY 1, 2),
cen AS (SELECT label AS topic, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS centroid, size FROM (SELECT label, list(x ORDER BY k) AS c, max(n) AS size FROM m GROUP BY 1)),
near AS (SELECT vec_id, ord, topic, sim FROM (SELECT vec_id, ord, topic, list_cosine_similarity(v, centroid) AS sim FROM v, cen) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic) = 1),
asg AS (SELECT vec_id, ord, CASE WHEN sim < (SELECT quantile_cont(sim, 0.1) FROM near) THEN -1 ELSE topic END AS topic, round(sim, 6) AS sim FROM near),
cnt AS (SELECT topic, ord, count(*) AS passages FROM asg GROUP BY 1, 2)"""
_c = C.BUCKETS

QUERIES = {
    "e_generate": lambda s, d: hashed(C.talks(s, d).select("talk_id", F.concat_ws(" ", "title", F.substring("text", 1, 1000)).alias("text")), "talk_id"),
    "e_search": lambda s, d: search(vectors(s, d).where("ord BETWEEN 5 AND 30"), _query(s, d, 7)),
    "e_similar": lambda s, d: similar(s, d, 7, 10, True),
    "e_cluster": kmeans,
    "e_cluster_density": density,
    "e_cluster_summary": cluster_summary,
    "e_project2d": project,
    "e_shift": lambda s, d: shift(s, d, _query(s, d, 7)),
    "t_passages": lambda s, d: passages(s, d).select("talk_id", "seq", "first_pos", "last_pos", "words"),
    "t_chunks": lambda s, d: passages(s, d).select("talk_id", "seq", "sha"),
    "t_cache": _uncached,
    "t_embed": lambda s, d: _counts(_coded(passages(s, d), "sha", SIZE).join(_uncached(s, d), "sha", "left_semi"), "sha", SIZE),
    "t_load": lambda s, d: centroids(s, d).select("topic", "size", F.size("centroid").alias("dim"), F.concat(F.lit("topic "), F.col("topic").cast("string")).alias("label"), (F.col("topic") < 0).alias("junk")),
    "t_matrix": lambda s, d: assigned(s, d).join(vectors(s, d).select("vec_id", "v"), "vec_id").where("topic >= 0").select("vec_id", "topic", F.round(T.dot("v", "v"), 5).alias("norm")),
    "t_cluster": lambda s, d: kmeans(s, d, 20),
    "t_centroids": lambda s, d: centroids(s, d).select("topic", "size", F.posexplode("centroid").alias("k", "x")).select("topic", "size", "k", F.round("x", 6).alias("x")),
    "t_nearest": lambda s, d: nearest(s, d).select("vec_id", "ord", "topic", F.round("sim", 6).alias("sim")),
    "t_threshold": lambda s, d: s.createDataFrame([(quantile(kept(s, d, "nearest_topic", lambda: nearest(s, d)), "sim", 0.1),)], "cut double").select(F.round("cut", 6).alias("cut")),
    "t_assign": assigned,
    "t_ctfidf": ctfidf,
    "t_fit": lambda s, d: centroids(s, d).select("topic", "size"),
    "t_label": lambda s, d: ctfidf(s, d, 3).groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda e: e["term"]), ", ").alias("label")),
    "t_counts": topic_counts,
    "t_signals": lambda s, d: topic_signals(s, d).drop("history"),
    "t_new": new_topics,
}
_CT = f"""{C.SQL_TALKS}, k AS (SELECT grp, list_filter({C.sql_words('text')}, lambda w: NOT list_contains([{sql_list(STOPWORDS)}], w)) AS toks FROM talk),
g AS (SELECT grp, unnest(list_concat(toks, {C.sql_windows('toks', 2)})) AS term FROM k), tf0 AS (SELECT grp, term, count(*) AS f FROM g GROUP BY 1, 2),
top AS (SELECT term, sum(f) AS total FROM tf0 GROUP BY 1 ORDER BY total DESC, term LIMIT 60000), tf AS (SELECT * FROM tf0 JOIN top USING (term)), z AS (SELECT grp, sum(f) AS size FROM tf GROUP BY 1),
r AS (SELECT grp, term, round(f::DOUBLE / size * ln(1 + (SELECT avg(size) FROM z) / total), 9) AS score FROM tf JOIN z USING (grp)), rk AS (SELECT *, (row_number() OVER (PARTITION BY grp ORDER BY score DESC, term))::INT AS rank FROM r)"""
SQL_RATIO = f"""tw AS (SELECT topic, unnest(list_filter({C.sql_words('text')}, lambda w: NOT list_contains([{sql_list(STOPWORDS)}], w))) AS word FROM talk JOIN asg ON vec_id = talk_id WHERE topic >= 0),
ttf AS (SELECT topic, word, count(*) AS f FROM tw GROUP BY 1, 2), tz AS (SELECT topic, sum(f)::DOUBLE AS size FROM ttf GROUP BY 1), ta AS (SELECT word, sum(f)::DOUBLE AS total FROM ttf GROUP BY 1),
tr AS (SELECT topic, word FROM ttf JOIN tz USING (topic) JOIN ta USING (word) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY round(f / size * ln(1 + (SELECT avg(size) FROM tz) / total), 9) DESC, word) <= 5),
tn AS (SELECT sum(words) FILTER (ord = {_c})::DOUBLE AS wn, sum(words) FILTER (ord BETWEEN {_c - 10} AND {_c - 1})::DOUBLE AS wb FROM ord_stats),
tu AS (SELECT topic, coalesce(sum(count) FILTER (ord = {_c}), 0)::DOUBLE AS a, coalesce(sum(count) FILTER (ord BETWEEN {_c - 10} AND {_c - 1}), 0)::DOUBLE AS b FROM tr LEFT JOIN term_ord ON term = word GROUP BY 1),
ratio AS (SELECT topic, CASE WHEN b > 0 THEN round((a / wn) / (b / wb), 2) ELSE 1 END::DOUBLE AS word_ratio FROM tu, tn)"""
QUERIES["t_word_ratio"] = word_ratio
ORACLES = {
    "t_word_ratio": f"WITH {I.SQL_INDEX}, {_TOPIC}, {SQL_RATIO} SELECT * FROM ratio",
    "e_search": f"WITH {_V} SELECT vec_id, label, {_SIM} AS sim FROM v WHERE ord BETWEEN 5 AND 30 ORDER BY sim DESC, vec_id LIMIT 10",
    "e_similar": f"WITH {_V} SELECT vec_id, label, {_SIM} AS sim FROM v WHERE vec_id <> 7 AND label <> (SELECT label FROM v WHERE vec_id = 7) ORDER BY sim DESC, vec_id LIMIT 10",
    "e_cluster_summary": f"WITH {_TOPIC}, r AS (SELECT label, size, vec_id, round(list_cosine_similarity(v, centroid), 6) AS sim FROM v JOIN cen ON label = topic) SELECT label, size, (row_number() OVER w)::INT AS k, vec_id, sim FROM r WINDOW w AS (PARTITION BY label ORDER BY sim DESC, vec_id) QUALIFY row_number() OVER w <= 3",
    "e_shift": f"WITH {_V}, r AS (SELECT ord, vec_id, {_SIM} AS sim FROM v) SELECT ord, (row_number() OVER w)::INT AS k, vec_id, sim FROM r WINDOW w AS (PARTITION BY ord ORDER BY sim DESC, vec_id) QUALIFY row_number() OVER w <= 3",
    "t_matrix": f"WITH {_TOPIC} SELECT vec_id, topic, round(list_inner_product(v, v), 5) AS norm FROM asg JOIN v USING (vec_id) WHERE topic >= 0",
    "t_centroids": f"WITH {_TOPIC} SELECT topic, size, unnest(range(0, len(centroid)))::INT AS k, round(unnest(centroid), 6) AS x FROM cen",
    "t_nearest": f"WITH {_TOPIC} SELECT vec_id, ord, topic, round(sim, 6) AS sim FROM near",
    "t_threshold": f"WITH {_TOPIC} SELECT round(quantile_cont(sim, 0.1), 6) AS cut FROM near",
    "t_assign": f"WITH {_TOPIC} SELECT * FROM asg",
    "t_ctfidf": f"WITH {_CT} SELECT * FROM rk WHERE rank <= 15",
    "t_load": f"WITH {_TOPIC} SELECT topic, size, len(centroid)::INT AS dim, 'topic ' || topic AS label, topic < 0 AS junk FROM cen",
    "t_fit": f"WITH {_TOPIC} SELECT topic, size FROM cen",
    "t_label": f"WITH {_CT} SELECT grp, string_agg(term, ', ' ORDER BY rank) AS label FROM rk WHERE rank <= 3 GROUP BY 1",
    "t_counts": f"WITH {_TOPIC} SELECT * FROM cnt",
    "t_signals": f"""WITH {_TOPIC}, n AS (SELECT sum(passages) FILTER (ord = {_c})::DOUBLE AS nc, sum(passages) FILTER (ord BETWEEN {_c - 10} AND {_c - 1})::DOUBLE AS nb, coalesce(sum(passages) FILTER (ord BETWEEN {_c - 30} AND {_c - 11}), 0)::DOUBLE AS no, sum(passages)::DOUBLE AS na FROM cnt),
      y AS (SELECT topic, coalesce(sum(passages) FILTER (ord = {_c}), 0)::DOUBLE AS y, coalesce(sum(passages) FILTER (ord BETWEEN {_c - 10} AND {_c - 1}), 0)::DOUBLE AS yb, coalesce(sum(passages) FILTER (ord BETWEEN {_c - 30} AND {_c - 11}), 0)::DOUBLE AS yo, sum(passages)::DOUBLE AS total FROM cnt WHERE topic >= 0 GROUP BY 1),
      f AS (SELECT *, y / greatest(nc, 1) AS share, yb / greatest(nb, 1) AS base_share, yo / greatest(no, 1) AS older_share, 50 * total / na AS al FROM y, n),
      g AS (SELECT *, (ln((y + al) / (nc + 50 - y - al)) - ln((yb + al) / (nb + 50 - yb - al))) / sqrt(1 / (y + al) + 1 / (yb + al)) AS z FROM f)
      SELECT topic, y::BIGINT AS passages, round(share, 5) AS share, round(base_share, 5) AS base_share, round(older_share, 5) AS older_share, round(z, 4) AS z,
        CASE WHEN y = 0 AND base_share * nc >= 3 THEN 'absent' WHEN z >= 2 AND y >= 3 THEN 'rising' WHEN z <= -2 THEN 'fading' WHEN share >= 1.5 * older_share AND base_share >= 1.5 * older_share AND y >= 3 THEN 'continuing' ELSE 'steady' END AS cls FROM g""",
}
