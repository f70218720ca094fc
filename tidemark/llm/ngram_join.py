"""Exact n-gram Jaccard self-join by vertical partitioning, and the groups its links form.

A document's set is its distinct 5-word shingles (64-bit hashes). Two sets link at Jaccard 0.75 or more.

1. Equal sets are one class, known by a digest of the set; everything after works on classes.
2. The shingle order is cut into fragments by hash range. Each task counts, per class, the shingles in its fragments that
   another class has too. A class that shares less than 75 % of its shingles with all others together can't link with
   any, so only the rest, the survivors, go on. A class with less than half of that share in a task is not told of; what
   the tasks that don't tell hold of it counts as shared by half of that share, which is more than there is: some more
   survive, none is dropped. Counts travel packed, one record a task and range of class keys. A shingle that several
   classes of one slice of texts have is counted there at once and goes on as a single entry, however many have it. (A
   class that stands in several slices may be counted more than once; that too only lets a few more survive.)
3. Among survivors the order is by frequency, rarest first; a link must share a shingle of either side's prefix (the
   first n - ceil(0.75 n) + 1 in that order). Classes that share a prefix shingle are candidates.
4. Candidates are verified fragment by fragment: a pair goes to the fragments that its second class has shingles in,
   each counts the pair's partial overlap over its own shingles, and the partial overlaps are summed per pair.
5. Groups aren't expanded into all pairs. In a few rounds every bucket has a leader (its smallest doc_id, which is often
   the original; later the first in a hash order), every class is compared with the leader that leads most of its
   buckets, and linked groups are merged: large groups of near copies fall together. Then the pairs of a bucket that
   aren't in one group yet are candidates, if the places of the shared shingle in both orders leave room for the overlap
   that a link needs, and all of those are verified: no link between groups is missed.

Exact up to collisions of 64-bit hashes. Words are lower-cased in A-Z only. A null, empty or blank text has an empty
set and is alone in its group. Rows that repeat are copies; a row is known by its id and a hash of its text, so rows of
one id with different texts are judged each for itself. Null ids link like others but have no id to name a group by: a
group of null ids alone has a null component_id. Very long texts are shingled whole, one at a time. An empty table gives
no rows. Extra columns are ignored by ``near_duplicates`` and kept, whatever their names, by ``keep_one``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import components
from .common import durable, fresh, id_column, int_ids, release, shingle_sets, slices, small_batches, split_join, trimmed

WIDTH = 5
PERCENT = 75
#: Shingles to a fragment, about: 16 MB of hashes and as much again to sort them.
FRAGMENT = 2_000_000
#: Parts of a fragment while all classes' shingles are counted: small groups fill the tasks evenly.
PARTS = 4
#: Fragments at least; rounds of leaders before the remaining pairs.
LEAST_FRAGMENTS = 12
ROUNDS = 3
#: Classes to a range of keys, about, whose counts one task sums; ranges at least; entries that a task holds unsummed.
RANGE = 250_000
LEAST_RANGES = 8
HELD = 1_000_000
#: Survivor ids up to which they are sent to every executor (8 bytes each); beyond it a join shuffles the texts once.
MOST_SENT = 4_000_000


def _class_key(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_key: what a row is known by, and the text."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key, n_shingles, class_id of every row; class_id is null for an empty set."""

    def made(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                sizes, keys = [len(s) for s in sets], [_class_key(s) if len(s) else None for s in sets]
                yield pa.record_batch(
                    [id_column(int_ids(part.column("doc_id"))), part.column("text_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())],
                    ["doc_id", "text_key", "n_shingles", "class_id"],
                )

    return _keyed(docs).mapInArrow(trimmed(made), "doc_id long, text_key long, n_shingles long, class_id long")


def _fragments(pairs, count: int, combine: bool = False):
    """Rows (fragment, keys, sizes, hashes) of (class key, sorted hashes) pairs, packed for one shuffle record each.

    ``combine``: a hash that two classes or more have here is one entry of the owner ``MANY``; how many such hashes each
    class has goes into one more row of keys and sizes without hashes, to a fragment number below 0."""
    found = {}
    for key, shingles in pairs:
        found.setdefault(key, shingles)
    if not found:
        return None
    keys = np.fromiter(found, np.int64, len(found))
    sets = list(found.values())
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, owner = np.concatenate(sets), np.repeat(keys, sizes)
    told = None
    if combine:
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        begin = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        size = np.diff(np.append(begin, len(flat)))
        many = np.repeat(size > 1, size)
        told = np.unique(owner[many], return_counts=True)
        owner = np.where(many, MANY, owner)
        one = np.zeros(len(flat), bool)
        one[begin] = True
        flat, owner = flat[one | ~many], owner[one | ~many]
        order = np.argsort(owner, kind="stable")
        flat, owner = flat[order], owner[order]
    fragment = (flat >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
    order = np.argsort(fragment.astype(np.uint16) if count <= 65536 else fragment, kind="stable")
    fragment, flat, owner = fragment[order], flat[order], owner[order]
    cut = np.flatnonzero(np.append(True, fragment[1:] != fragment[:-1])).tolist() + [len(flat)]
    rows = [[], [], [], []]
    for a, b in zip(cut, cut[1:], strict=False):
        own = owner[a:b]
        runs = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        rows[0].append(int(fragment[a]))
        rows[1].append(own[runs].tobytes())
        rows[2].append(np.diff(np.append(runs, b - a)).astype(np.int32).tobytes())
        rows[3].append(flat[a:b].tobytes())
    if told is not None and len(told[0]):
        for column, value in zip(rows, (-1 - int(told[0][0]) % count, told[0].tobytes(), told[1].astype(np.int32).tobytes(), b""), strict=True):
            column.append(value)
    return pa.record_batch([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["fragment", "keys", "sizes", "hashes"])


#: The owner of an entry that stands for several classes.
MANY = -(2**63)
_PACKED = "fragment int, keys binary, sizes binary, hashes binary"


def _unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Class key and hash of every entry of a fragment."""
    keys, sizes, hashes = ([np.frombuffer(x, kind) for x in group.column(c).to_pylist()] for c, kind in (("keys", np.int64), ("sizes", np.int32), ("hashes", np.uint64)))
    return np.repeat(np.concatenate(keys), np.concatenate(sizes)), np.concatenate(hashes)


def _shared(owner: np.ndarray, hashes: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, owners of that hash) of the distinct entries whose hash has two entries, and ``least`` owners or more."""
    order = np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    begin = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(hashes)))
    many = np.repeat(size > 1, size)
    hashes, owner = hashes[many], owner[many]
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])) if len(hashes) else np.zeros(0, bool)
    hashes, owner = hashes[new], owner[new]
    begin = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(hashes)))
    size = np.repeat(size, size)
    return owner[size >= least], hashes[size >= least], size[size >= least]


def _summed(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """One part (keys, shared, seen): the sums by key."""
    keys, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, place = np.unique(keys, return_inverse=True)
    return [(keys, *(np.bincount(place, c, len(keys)).astype(np.int64) for c in counts))]


def _count_shared(group: pa.Table) -> pa.Table:
    """class_id, shared, seen of a fragment: distinct shingles that another class has too, and all of them."""
    if group.column("fragment")[0].as_py() < 0:
        owner, counts = (np.concatenate([np.frombuffer(x, kind) for x in group.column(c).to_pylist()]) for c, kind in (("keys", np.int64), ("sizes", np.int32)))
        ((keys, shared, seen),) = _summed([(owner, counts, counts)])
    else:
        owner, sizes, hashes = (np.concatenate([np.frombuffer(x, kind) for x in group.column(c).to_pylist()]) for c, kind in (("keys", np.int64), ("sizes", np.int32), ("hashes", np.uint64)))
        keys, place = np.unique(owner, return_inverse=True)
        place = np.repeat(place, sizes)
        order = np.argsort(hashes)
        hashes, place = hashes[order], place[order]
        size = np.diff(np.append(np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])), len(hashes)))
        many = np.repeat(size > 1, size)
        both, alone = _shared(place[many], hashes[many], 1), place[~many]
        seen = np.bincount(alone, minlength=len(keys)) + np.bincount(both[0], minlength=len(keys))
        shared = np.bincount(both[0][both[2] > 1], minlength=len(keys))
        own = keys != MANY
        keys, shared, seen = keys[own], shared[own], seen[own]
    return pa.table({"class_id": keys, "shared": shared.astype(np.int64), "seen": seen.astype(np.int64)})


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def _counted(ranges: int, percent: int):
    """Packed counts (part, keys, shared, seen) of a task's fragments, which come sorted; what is shared by less than half
    of ``percent`` stays out. One record a range of class keys, more where many entries were held."""

    def told(held: list) -> pa.RecordBatch:
        ((keys, shared, seen),) = _summed(held)
        enough = shared * 200 >= seen * percent
        keys, shared, seen = keys[enough], shared[enough], seen[enough]
        part = _range_of(keys, ranges)
        order = np.argsort(part, kind="stable")
        part, columns = part[order], (keys[order], shared[order].astype(np.int32), seen[order].astype(np.int32))
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() + [len(part)] if len(part) else []
        blobs = [pa.array([c[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for c in columns]
        return pa.record_batch([pa.array(part[cut[:-1]], pa.int32()), *blobs], ["part", "keys", "shared", "seen"])

    def run(batches):
        rows, fragment, held, size = [], None, [], 0

        def count():
            found = _count_shared(pa.Table.from_batches(rows))
            held.append(tuple(found.column(c).to_numpy() for c in ("class_id", "shared", "seen")))
            return len(held[-1][0])

        for batch in batches:
            named = batch.column("fragment").to_numpy()
            cut = np.flatnonzero(np.append(True, named[1:] != named[:-1])).tolist() + [len(named)] if len(named) else []
            for a, b in zip(cut, cut[1:], strict=False):
                if rows and named[a] != fragment:
                    size += count()
                    rows = []
                    if size > HELD:
                        held = _summed(held)
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield told(held)
                            held, size = [], 0
                        release()
                rows.append(batch.slice(a, b - a))
                fragment = named[a]
        if rows:
            count()
        if held:
            yield told(held)

    return run


def _sums(batches):
    """class_id, shared, seen: the packed counts of a task's ranges, summed by class."""
    held, size = [], 0
    for batch in batches:
        columns = [(batch.column(c).to_pylist(), kind) for c, kind in (("keys", np.int64), ("shared", np.int32), ("seen", np.int32))]
        held.append(tuple(np.concatenate([np.frombuffer(x, kind) for x in blobs] or [np.zeros(0, kind)]) for blobs, kind in columns))
        size += len(held[-1][0])
        if size > HELD:
            held = _summed(held)
            size = len(held[0][0])
    if held:
        ((keys, shared, seen),) = _summed(held)
        yield pa.record_batch([pa.array(keys), pa.array(shared), pa.array(seen)], ["class_id", "shared", "seen"])


def survivors(docs: DataFrame, known: DataFrame, fragments: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """class_id of the classes that share enough of their shingles with others to link at all."""

    def packed(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = _fragments(((_class_key(s), s) for s in shingle_sets(part.column("text"), width) if len(s)), fragments, True)
                if rows is not None:
                    yield rows

    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key"))
    sizes = known.where("class_id IS NOT NULL").groupBy("class_id").agg(F.max("n_shingles").alias("n"), first.alias("r"))
    ranges = max(LEAST_RANGES, -(-sizes.count() // RANGE))
    # tasks in proportion to the fragments, so that no task's input grows with the table
    spread = docs.select("text").mapInArrow(trimmed(packed), _PACKED).repartition(-(-fragments // PARTS), "fragment").sortWithinPartitions("fragment")
    told = spread.mapInArrow(trimmed(_counted(ranges, percent)), "part int, keys binary, shared binary, seen binary")
    shared = told.repartition(ranges, "part").mapInArrow(trimmed(_sums), "class_id long, shared long, seen long")
    # at most: what was told of, and half of the percentage of the rest
    enough = sizes.join(shared, "class_id").where(F.col("shared") * 200 + F.greatest(F.col("n") - F.col("seen"), F.lit(0)) * percent >= F.col("n") * 2 * percent)
    return enough.select("class_id", "n", F.col("r.doc_id").alias("rep"), F.col("r.text_key").alias("rep_text"))


def _sets_of(docs: DataFrame, alive: DataFrame, sent: bool, fragments: int, width: int) -> DataFrame:
    """Packed fragments of the survivors' shingles: texts are filtered to the classes' representatives first."""
    wanted = alive.select("rep", "rep_text").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_key") == F.col("rep_text"))
    own = _keyed(docs).join(F.broadcast(wanted) if sent else wanted, same, "left_semi")

    def packed(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = _fragments(((_class_key(s), s) for s in shingle_sets(part.column("text"), width) if len(s)), fragments)
                if rows is not None:
                    yield rows

    return own.select("text").mapInArrow(trimmed(packed), _PACKED)


def _homes(sets: DataFrame) -> DataFrame:
    """b, fragments: the fragments that each class has shingles in."""

    def listed(batches):
        for batch in batches:
            for fragment, keys in zip(batch.column("fragment").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                own = np.frombuffer(keys, np.int64)
                yield pa.record_batch([pa.array(own), pa.array(np.full(len(own), fragment, np.int32))], ["b", "fragment"])

    return sets.select("fragment", "keys").mapInArrow(trimmed(listed), "b long, fragment int").groupBy("b").agg(F.collect_set("fragment").alias("fragments"))


def _postings(sets: DataFrame, alive: DataFrame, fragments: int, percent: int) -> DataFrame:
    """hash, class_id, n, place of every prefix entry that another class has too; place counts from 0 in the order."""

    def frequent(group: pa.Table) -> pa.Table:
        owner, hashes, df = _shared(*_unpacked(group))
        order = np.argsort(owner, kind="stable")
        owner, hashes, df = owner[order], hashes[order], df[order]
        cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(owner)) if len(owner) else cut
        blobs = [np.stack([df[a:b].astype(np.uint64), hashes[a:b]]).tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
        return pa.table({"class_id": owner[cut], "entries": pa.array(blobs, pa.binary())})

    def prefix(batches):
        for batch in batches:
            keys, sizes, lists = batch.column("class_id").to_pylist(), batch.column("n").to_pylist(), batch.column("lists").to_pylist()
            out = [[], [], [], []]
            for key, n, blobs in zip(keys, sizes, lists, strict=True):
                df, hashes = np.concatenate([np.frombuffer(b, np.uint64).reshape(2, -1) for b in blobs], 1)
                length = n - -(-percent * n // 100) + 1 - (n - len(hashes))
                if length > 0:
                    first = hashes[np.lexsort((hashes, df))[:length]]
                    out[0].append(first.view(np.int64))
                    out[1].append(np.full(len(first), key))
                    out[2].append(np.full(len(first), n))
                    out[3].append(np.arange(len(first)) + n - len(hashes))
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], ["hash", "class_id", "n", "place"])

    entries = sets.repartition(fragments, "fragment").groupBy("fragment").applyInArrow(frequent, "class_id long, entries binary")
    return entries.groupBy("class_id").agg(F.collect_list("entries").alias("lists")).join(alive.select("class_id", "n"), "class_id").mapInArrow(trimmed(prefix), "hash long, class_id long, n long, place long")


def _overlaps(pairs: DataFrame, sets: DataFrame, homes: DataFrame, fragments: int) -> DataFrame:
    """a, b, overlap of each pair: partial overlaps by fragment, summed. A pair is sent to the fragments of its class b."""

    def partial(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "overlap": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        owner, hashes = _unpacked(right)
        names, owner = np.unique(owner, return_inverse=True)
        values, rank = np.unique(hashes, return_inverse=True)
        entry = np.unique(owner.astype(np.int64) * len(values) + rank)
        owner, rank = entry // len(values), entry % len(values)
        begin = np.searchsorted(owner, np.arange(len(names) + 1))
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        at_a, at_b = np.minimum(np.searchsorted(names, a), len(names) - 1), np.minimum(np.searchsorted(names, b), len(names) - 1)
        both = (names[at_a] == a) & (names[at_b] == b)
        a, b, at_a, at_b = a[both], b[both], at_a[both], at_b[both]
        sizes = begin[at_a + 1] - begin[at_a]
        counts, row = np.zeros(len(a), np.int64), 0
        while row < len(a):
            end = max(row + 1, int(np.searchsorted(np.cumsum(sizes[row:]), 2_000_000)) + row)
            own = sizes[row:end]
            pair = np.repeat(np.arange(end - row), own)
            shingle = rank[np.repeat(begin[at_a[row:end]] - np.cumsum(own) + own, own) + np.arange(own.sum())]
            key = at_b[row:end][pair] * len(values) + shingle
            place = np.minimum(np.searchsorted(entry, key), len(entry) - 1)
            counts[row:end] = np.bincount(pair[entry[place] == key], minlength=end - row)
            row = end
        some = counts > 0
        del owner, rank, entry, hashes, values
        release()
        return pa.table({"a": a[some], "b": b[some], "overlap": counts[some]})

    spread = pairs.select("a", "b").join(homes, "b").select("a", "b", F.explode("fragments").alias("fragment"))
    dealt = [df.repartition(fragments, "fragment").groupBy("fragment") for df in (spread, sets)]
    found = dealt[0].cogroup(dealt[1]).applyInArrow(partial, "a long, b long, overlap long")
    return found.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))


def _verified(pairs: DataFrame, sets: DataFrame, homes: DataFrame, fragments: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b, n_a, n_b, any more columns) whose sets reach the threshold."""
    pairs = durable(pairs, f"{name}_pairs")
    found = pairs.join(_overlaps(pairs, sets, homes, fragments), ["a", "b"])
    union = F.col("n_a") + F.col("n_b") - F.col("overlap")
    return durable(found.where(F.col("overlap") * 100 >= union * percent), f"{name}_links")


def _groups(docs: DataFrame, alive: DataFrame, width: int, percent: int) -> DataFrame | None:
    """class_id -> root of the surviving classes that have links."""
    count = alive.agg(F.count("*").alias("c"), F.sum("n").alias("s")).first()
    if not count.c:
        return None
    fragments = max(LEAST_FRAGMENTS, -(-count.s // FRAGMENT))
    sets = durable(_sets_of(docs, alive, count.c <= MOST_SENT, fragments, width), "join_sets")
    homes = durable(_homes(sets), "join_homes")
    postings = durable(_postings(sets, alive, fragments, percent), "join_postings")
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent

    own = durable(postings.join(alive.select("class_id", "rep"), "class_id").withColumn("root", F.col("class_id")), "join_own")
    for step in range(1, ROUNDS + 1):
        order = F.struct((F.col("rep") if step == 1 else F.xxhash64("class_id", F.lit(step))).alias("h"), "class_id", "n", "root")
        lead = own.groupBy("hash").agg(F.min(order).alias("lead"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("hash", "lead")
        met = own.join(lead, "hash").where(F.col("root") != F.col("lead.root")).select("class_id", F.col("n").alias("n_b"), F.col("root").alias("root_b"), "lead", F.col("lead.n").alias("n_a")).where(near)
        led = met.groupBy("class_id", "lead").agg(F.count("*").alias("c"), F.first("n_b").alias("n_b"), F.first("root_b").alias("root_b"))
        first = led.groupBy("class_id").agg(F.max(F.struct("c", "lead")).alias("x"), F.first("n_b").alias("n_b"), F.first("root_b").alias("root_b")).withColumn("lead", F.col("x.lead"))
        first = first.select(F.col("lead.class_id").alias("a"), F.col("class_id").alias("b"), F.col("lead.n").alias("n_a"), "n_b", F.col("lead.root").alias("root_a"), "root_b")
        new = _verified(first, sets, homes, fragments, percent, f"join_step_{step}").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        own = _merged(own, new, f"join_merge_{step}")

    mixed = own.groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("hash")
    live = own.join(mixed, "hash", "left_semi")
    # of a pair's sides the smaller one needs 2 * percent / (100 + percent) of its own shingles, so its place comes early
    small = live.where((F.col("n") - F.col("place")) * (100 + percent) >= F.col("n") * 2 * percent)
    small = small.select("hash", F.col("class_id").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("at_a"), F.col("root").alias("root_a"))
    large = live.select("hash", F.col("class_id").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("at_b"), F.col("root").alias("root_b"))
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    once = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    rest = small.join(large, "hash").where((F.col("root_a") != F.col("root_b")) & once & near & room).groupBy("a", "b").agg(*(F.first(c).alias(c) for c in ("n_a", "n_b", "root_a", "root_b")))
    new = _verified(rest, sets, homes, fragments, percent, "join_rest").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    return _merged(own, new, "join_merge_last").select("class_id", "root").distinct()


def _merged(own: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``own`` with the roots that ``links`` between roots (a, b) join replaced by one of them."""
    if links.isEmpty():
        return own
    to = components(links, name).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return durable(split_join(own, to, "root", f"{name}_hot", "left").withColumn("root", F.coalesce("to", "root")).drop("to").select(own.columns), f"{name}_own")


def _decided(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, class_id, root, component of every row; the last two are null for an empty set."""
    small_batches(docs.sparkSession)
    known = durable(classes(docs, width), "join_classes")
    total = known.agg(F.sum("n_shingles").alias("s")).first().s or 0
    alive = durable(survivors(docs, known, PARTS * max(LEAST_FRAGMENTS, -(-total // FRAGMENT)), width, percent), "join_alive")
    roots = _groups(docs, alive, width, percent)
    own = known.groupBy("class_id").agg(F.min("doc_id").alias("least")).where("class_id IS NOT NULL")
    if roots is not None:
        own = own.join(roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
        own = durable(own, "join_least")
        own = split_join(own, own.groupBy("root").agg(F.min("least").alias("component")), "root", "join_hot_roots").select("class_id", "root", "component")
    else:
        own = own.select("class_id", F.col("class_id").alias("root"), F.col("least").alias("component"))
    return split_join(known, own, "class_id", "join_hot_classes", "left")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every row."""
    found = _decided(docs, width, percent)
    return found.select("doc_id", "n_shingles", F.coalesce("component", F.when(F.col("root").isNull(), F.col("doc_id"))).alias("component_id"), "class_id")


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """All columns of one row of each group: the one with the smallest doc_id (null ids last), then text hash.

    Rows with an empty set all stay. Of rows that share id and text the first by a hash of all their columns stays."""
    found = _decided(docs, width, percent).where("root IS NOT NULL")
    rows = durable(found.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("copies")), "join_rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("r")
    stays = durable(rows.groupBy("root").agg(first).select("root", F.col("r.doc_id").alias("doc_id"), F.col("r.text_key").alias("text_key")), "join_stays")
    id_, key = fresh("gone_id", docs.columns), fresh("gone_key", docs.columns)
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key))
    named = lambda df: df.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key))
    match = (rows["root"] == stays["root"]) & rows["doc_id"].eqNullSafe(stays["doc_id"]) & (rows["text_key"] == stays["text_key"])
    gone = durable(named(rows.join(stays, match, "left_anti")), "join_gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= MOST_SENT else gone, same, "left_anti")
    twice = durable(named(rows.where("copies > 1").join(stays, match, "left_semi")), "join_twice")
    if twice.isEmpty():
        return kept
    if twice.count() <= MOST_SENT:
        twice = F.broadcast(twice)
    plain = [f.name for f in docs.schema if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    whole, order = fresh("row", docs.columns), F.xxhash64(*plain)
    again = kept.join(twice, same, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(F.struct(*docs.columns), order).alias(whole))
    return kept.join(twice, same, "left_anti").unionByName(again.select(f"{whole}.*"))
