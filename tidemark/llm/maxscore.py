"""Exact top-k inner products by MaxScore over integer vectors.

A dimension is a term with one posting list a shard: the entries of the shard's rows, in blocks of similar rows, each
with its highest and lowest entry. A query's weight times these bounds what the term can add to a row of the block (its
most) and what it adds at least; the difference is its range. For each block the terms are ordered by range, the widest
first, and split for each query by its own threshold: the longest tail of terms whose ranges, on top of the least of
all terms, can't reach the threshold is non-essential. The essential terms' postings are traversed; the others are
probed, a few terms at a time, for the rows alone whose score so far plus the most of what is left still reaches the
threshold. A block whose bounds can't reach it at all is passed over. Thresholds are the k-th best scores so far: they
rise from block to block, blocks with the best bounds first; they begin at the k-th scores in a first shard, and a
shard that no query of a block of queries can gain from is not sent to that block. Shards' best are merged at the end.

Scores are exact: in float64 while all sums stay below 2**53, else in 64-bit integers; beyond those it is an error.

Vectors that are null, empty or hold a null or non-finite component take no part; vectors of another length than the
query have no score with it. Equal scores rank by the smaller id. Repeated ids are candidates each, other than for a
query of the same id; query rows of one id share one list of k. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

K = 5
#: Rows to a shard and to a block of its postings; queries to a block of queries; terms probed at a time.
SHARD, ROWS, BLOCK, STEP = 8192, 1024, 1024, 8
#: Bytes of the shards' bounds up to which they are sent to every executor; beyond it no shard is left out.
MOST_SENT = 64 << 20
LOWEST = -(2**62)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id, v array<long>: floor(scale * x) of each component as double."""
    x = F.col(vector)
    whole = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.where(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


class Postings:
    """A shard's posting lists: ``lists`` has one row a term; ``high`` and ``low`` bound it in each block of rows."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, rows: int = ROWS):
        # rows of one strongest term side by side: their blocks' bounds are narrow
        top = np.abs(matrix).argmax(1)
        order = np.lexsort((ids, matrix[np.arange(len(ids)), top], top))
        self.ids, self.lists = ids[order], np.ascontiguousarray(matrix[order].T)
        self.begin = np.arange(0, len(ids), rows)
        self.high, self.low = (f.reduceat(self.lists, self.begin, axis=1) for f in (np.maximum, np.minimum))

    def block(self, n: int) -> slice:
        return slice(self.begin[n], self.begin[n + 1] if n + 1 < len(self.begin) else len(self.ids))


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each term (column) adds to each query (row) at most and at least."""
    x, y = q * high, q * low
    return np.maximum(x, y), np.minimum(x, y)


class Best:
    """The k best (query row, id, score) so far, and the thresholds."""

    def __init__(self, floor_: np.ndarray, k: int):
        self.k, self.floor = k, floor_.copy()
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, floor_.dtype)

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        row, ids, score = np.concatenate([self.row, row]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.row, self.id, self.score = row[keep], ids[keep], score[keep]
        last = keep & (place == self.k - 1)
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last])


def score_shard(qid: np.ndarray, q: np.ndarray, shard: Postings, floor_: np.ndarray, k: int, told: dict | None = None) -> tuple[np.ndarray, ...]:
    """Up to k best (query row, id, score) of each query among the rows with score >= floor_; exact.

    ``told`` counts blocks passed over, essential terms and all terms of the others, pairs traversed and pairs probed."""
    most = int(np.abs(q).max(initial=0)) * int(max(abs(int(shard.high.max(initial=0))), abs(int(shard.low.min(initial=0))))) * q.shape[1]
    if most >= 2**62:
        raise OverflowError("scores beyond 64 bits")
    kind = np.float64 if most < 2**53 else np.int64
    q, lists = q.astype(kind), shard.lists.astype(kind)
    best = Best(np.maximum(floor_, LOWEST).astype(kind), k)
    ceilings = np.stack([_bounds(q, shard.high[:, n].astype(kind), shard.low[:, n].astype(kind))[0].sum(1) for n in range(len(shard.begin))], 1) if len(q) else np.zeros((0, 0))
    for n in np.argsort(-ceilings.mean(0), kind="stable").tolist() if len(q) else ():
        rows = shard.block(n)
        asked = np.flatnonzero(ceilings[:, n] >= best.floor)
        if told is not None:
            told["passed"] = told.get("passed", 0) + len(q) - len(asked)
        if not len(asked):
            continue
        ids, own = shard.ids[rows], q[asked]
        high, low = _bounds(own, shard.high[:, n].astype(kind), shard.low[:, n].astype(kind))
        order = np.argsort(-(high - low).mean(0), kind="stable")
        own, high, low = own[:, order], high[:, order], low[:, order]
        part = lists[order][:, rows]
        # gain[:, j]: all that the terms from the j-th on can add to the least of every term; left: their most
        gain = np.concatenate([np.cumsum((high - low)[:, ::-1], 1)[:, ::-1], np.zeros((len(own), 1), kind)], 1)
        left = np.concatenate([np.cumsum(high[:, ::-1], 1)[:, ::-1], np.zeros((len(own), 1), kind)], 1)
        split = (low.sum(1)[:, None] + gain >= best.floor[asked][:, None]).sum(1)  # essential: the terms before it
        split = np.minimum(-(-split // STEP) * STEP, q.shape[1])
        for lead in np.unique(split).tolist():
            at = np.flatnonzero(split == lead)
            partial = own[at, :lead] @ part[:lead]
            floor_at = best.floor[asked[at]]
            i, j = np.nonzero((partial + left[at, lead][:, None] >= floor_at[:, None]) & (qid[asked[at]][:, None] != ids[None, :]))
            score = partial[i, j]
            if told is not None:
                for name, value in (("essential", lead * len(at)), ("terms", q.shape[1] * len(at)), ("traversed", partial.size), ("probed", len(i) if lead < q.shape[1] else 0)):
                    told[name] = told.get(name, 0) + value
            for a in range(lead, q.shape[1], STEP):
                b = min(a + STEP, q.shape[1])
                score = score + np.einsum("ij,ji->i", own[at[i], a:b], part[a:b][:, j])
                keep = score + left[at[i], b] >= floor_at[i]
                i, j, score = i[keep], j[keep], score[keep]
            best.add(asked[at[i]], ids[j], score)
    return best.row, best.id, best.score.astype(np.int64)


def _rows_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by id, ids and matrix of a group with id and v."""
    ids = group.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return order, ids[order], group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """One row per (dim, key): ids, entries and floors of its vectors, and the entries' bounds by dimension, as bytes."""
    raw = lambda x: [x.astype("<i8").tobytes()]

    def fold(group: pa.Table) -> pa.Table:
        order, ids, m = _rows_of(group)
        floors = group.column("floor").to_numpy()[order]
        return pa.table({"dim": group.column("dim").slice(0, 1), key: group.column(key).slice(0, 1), "ids": raw(ids), "m": raw(m), "floors": raw(floors), "high": raw(m.max(0)), "low": raw(m.min(0))})

    return rows.withColumn("dim", F.size("v")).groupBy("dim", key).applyInArrow(fold, f"dim int, {key} long, ids binary, m binary, floors binary, high binary, low binary")


def _read(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<i8")


def _needed(shards: DataFrame, blocks: DataFrame) -> DataFrame:
    """dim, shard, block: the shards that some query of the block may find a score above its threshold in."""
    every = shards.select("dim", "shard")
    size = shards.agg(F.coalesce(F.sum(F.length("high")), F.lit(0)).alias("n")).first().n
    if 2 * size > MOST_SENT:
        return every.join(blocks.select("dim", "block"), "dim")
    sent = shards.sparkSession.sparkContext.broadcast([(r.dim, r.shard, bytes(r.high), bytes(r.low)) for r in shards.select("dim", "shard", "high", "low").collect()])

    def chosen(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q, floors, found = _read(r["m"]).reshape(-1, r["dim"]).astype(float), _read(r["floors"]), []
                for dim, shard, high, low in sent.value:
                    # a float may round a sum down by a little: 1 + 2**-40 makes up for it
                    if dim == r["dim"]:
                        most, _ = _bounds(q, _read(high).astype(float), _read(low).astype(float))
                        slack = np.abs(most).sum(1) * 2**-40 + 1
                        if (most.sum(1) + slack >= floors).any():
                            found.append(shard)
                yield pa.record_batch([pa.array([r["dim"]] * len(found), pa.int32()), pa.array(found, pa.int64()), pa.array([r["block"]] * len(found), pa.int64())], ["dim", "shard", "block"])

    return blocks.select("dim", "block", "m", "floors").mapInArrow(chosen, "dim int, shard long, block long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs are (id, v). Every query meets every row but its own, shard by shard."""
    vectors = durable(vectors.withColumn("floor", F.lit(LOWEST).cast("long")), "vectors")
    shards = max(1, -(-vectors.count() // shard))
    queries = durable(queries.withColumn("floor", F.lit(LOWEST).cast("long")), "queries")
    blocks = max(1, -(-queries.count() // block))
    # dealt evenly by a hash of id, so no range of ids lands in one shard; repeated ids by their entries as well
    part = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n))
    packed_c = durable(_packed(vectors.withColumn("shard", part(shards)), "shard"), "shards")
    packed_q = durable(_packed(queries.withColumn("block", part(blocks)), "block"), "blocks")

    def scores(cands: DataFrame, asked: DataFrame) -> DataFrame:
        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
            qid, ids, floors = (_read(t.column(c)[0].as_py()) for t, c in ((right, "ids"), (left, "ids"), (right, "floors")))
            q, c = _read(right.column("m")[0].as_py()).reshape(len(qid), -1), _read(left.column("m")[0].as_py()).reshape(len(ids), -1)
            row, found, score = score_shard(qid, q, Postings(ids, c, rows), floors, k)
            return pa.table({"query_id": qid[row], "vec_id": found, "score": score})

        pairs = durable(_needed(cands, asked), "shard_pairs")
        keys = ["dim", "shard", "block"]
        one = cands.select("dim", "shard", "ids", "m").join(pairs, ["dim", "shard"])
        two = asked.select("dim", "block", "ids", "m", "floors").join(pairs, ["dim", "block"])
        return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    if shards > 1:
        seed = best(scores(packed_c.where("shard = 0"), packed_q)).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
        seed = durable(seed.where(F.col("n") >= k).select("query_id", "low"), "floors")
        known = queries.join(seed, queries.id == seed.query_id, "left").select("id", "v", F.coalesce("low", "floor").alias("floor"))
        packed_q = durable(_packed(known.withColumn("block", part(blocks)), "block"), "blocks_floor")
    return best(scores(packed_c, packed_q)).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
