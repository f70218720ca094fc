"""Content-defined payload chunking: media stored as ordered lists of deduplicated chunks.

A payload (a text's UTF-8 bytes, then bytes 255 up to a positive multiple of ``UNIT``) is cut where a rolling gear hash
of the last 32 bytes has its top bits zero, within ``LEAST`` and ``MOST`` bytes a chunk. Equal payloads have equal chunk
lists (one ``pid``); among the distinct lists every chunk digest gets one owner by an aggregate and a join, and only the
owner's copy is written. The chunk store is a table in the shared folder: one row per payload that owns chunks, with
their compressed bytes. Reading back, payloads that own all of their chunks are rebuilt from their own row, others by
joining their list to the store; the rebuilt bytes must have the digest that the payload had, or the job fails.

A payload's stored form is its recipe (``TMCH``, length and chunk count, then digest and size of each chunk in order) as
the store holds it, followed by the stored bytes of the chunks that it names; ``media_*`` are taken over these bytes as
they are read back. Null texts are empty (one unit of padding); null ids are kept: a row is known by a hash of id and
text. Repeated rows and texts are copies. A very long text is one payload of many chunks, cut and read back in one task.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, mix64, slices, small_batches, split_join, text_buffer

UNIT = 576
BITS = 11
LEAST, MOST = 512, 8192
LEVEL = 9
#: Rows of the table of copies and sharers (each worth ten places) up to which it is sent to every executor, about 80
#: bytes a row; digests up to which their table is.
MOST_SENT = 300_000
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum over k < 32 of GEAR[data[i - k]] << k, modulo 2**32, by doubling the window five times."""
    h = GEAR[data]
    for span in (1, 2, 4, 8, 16):
        older = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += older
    return h


def payloads(column: pa.Array) -> list[bytes]:
    data, at = text_buffer(column)
    raw, cut = data.tobytes(), at.tolist()
    return [raw[a:b] + b"\xff" * (-(b - a) % UNIT if b > a else UNIT) for a, b in zip(cut, cut[1:], strict=False)]


def cuts(payload: bytes) -> list[int]:
    """Ends of the payload's chunks."""
    size = len(payload)
    if size <= LEAST:
        return [size]
    marks = np.flatnonzero(gear_hash(np.frombuffer(payload, np.uint8)) >> np.uint32(32 - BITS) == 0) + 1
    ends, last = [], 0
    while size - last > LEAST:
        k = int(np.searchsorted(marks, last + LEAST))
        end = min(int(marks[k]) if k < len(marks) else size, last + MOST, size)
        ends.append(end)
        last = end
    if last < size:
        ends.append(size)
    return ends


def chunks(payload: bytes) -> tuple[list[bytes], list[bytes]]:
    """Digests and bytes of the payload's chunks."""
    ends = cuts(payload)
    parts = [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return [hashlib.blake2b(p, digest_size=16).digest() for p in parts], parts


HEAD, ENTRY = 20, 20


def recipe(payload: bytes) -> tuple[bytes, list[bytes]]:
    """The recipe of a payload (``TMCH``, its length, its chunks' count, then digest and size of each) and its chunks."""
    digests, parts = chunks(payload)
    head = b"TMCH" + len(payload).to_bytes(8, "little") + len(parts).to_bytes(8, "little")
    return head + b"".join(d + len(p).to_bytes(4, "little") for d, p in zip(digests, parts, strict=True)), parts


def digests_in(stored: bytes) -> list[bytes]:
    return [stored[at : at + 16] for at in range(HEAD, len(stored), ENTRY)]


def _pid(stored: bytes) -> bytes:
    return hashlib.blake2b(stored, digest_size=16).digest()


def _keyed(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, text: rows that agree in id and text have one key."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "text")


def manifests(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, pid, n_bytes, payload_bytes, sha256 of the payload and its recipe, for every row."""

    def made(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                _, at = text_buffer(part.column("text"))
                own = payloads(part.column("text"))
                recipes = [recipe(p)[0] for p in own]
                yield pa.record_batch(
                    [
                        part.column("row_key"), part.column("doc_id").cast(pa.int64()), pa.array([_pid(r) for r in recipes], pa.binary()), pa.array(np.diff(at)), pa.array([len(p) for p in own], pa.int64()),
                        pa.array([hashlib.sha256(p).digest() for p in own], pa.binary()), pa.array(recipes, pa.binary()),
                    ],
                    ["row_key", "doc_id", "pid", "n_bytes", "payload_bytes", "sha", "recipe"],
                )

    return _keyed(docs).mapInArrow(made, "row_key long, doc_id long, pid binary, n_bytes long, payload_bytes long, sha binary, recipe binary")


def write_store(docs: DataFrame, partial: DataFrame, sent: bool) -> DataFrame:
    """The store: pid, recipe, and digests and compressed bytes of the chunks that the payload owns, one row per payload.

    ``partial``: row_key, pid, places: the rows that don't write all of their payload's chunks; null places: nothing."""

    def packed(batches):
        squeeze = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=True).compress
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [[], [], [], []]
                for payload, known, held in zip(payloads(part.column("text")), part.column("pid").to_pylist(), part.column("places").to_pylist(), strict=True):
                    stored, parts = recipe(payload)
                    pid, digests = _pid(stored), digests_in(stored)
                    if known == pid and held is None:
                        continue
                    own = {digests[k]: parts[k] for k in (held if known == pid else range(len(parts)))}
                    for column, value in zip(rows, (pid, stored, list(own), [squeeze(x) for x in own.values()]), strict=True):
                        column.append(value)
                kinds = (pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()))
                yield pa.record_batch([pa.array(r, kind) for r, kind in zip(rows, kinds, strict=True)], ["pid", "recipe", "own", "z"])

    keyed = _keyed(docs).join(F.broadcast(partial) if sent else partial, "row_key", "left")
    return keyed.select("text", "pid", "places").mapInArrow(packed, "pid binary, recipe binary, own array<binary>, z array<binary>")


_READ = "pid binary, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(pid: bytes, stored: bytes, held: dict[bytes, bytes], expand) -> tuple:
    """What is read back: the payload rebuilt from its chunks' stored bytes in the recipe's order.

    The stored form is the recipe and, in the order in which it first names them, the chunks' compressed bytes."""
    digests = digests_in(stored)
    parts = {d: expand(held[d]) for d in dict.fromkeys(digests)}
    payload = b"".join([parts[d] for d in digests])
    media = stored + b"".join([held[d] for d in parts])
    seen = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = seen[seen > 0] / len(payload)
    mean = float(seen @ np.arange(256)) / len(payload)
    feature = f"chunks={len(digests)};mean={mean:.3f};distinct={len(share)};entropy={float(-(share * np.log2(share)).sum()) + 0.0:.4f}"
    return pid, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["pid", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read_whole(store: DataFrame) -> DataFrame:
    """Features of the payloads whose own row holds all of their chunks."""

    def read(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                pid, stored, own, z = (batch.column(c)[row].as_py() for c in ("pid", "recipe", "own", "z"))
                held = dict(zip(own, z, strict=True))
                if all(d in held for d in digests_in(stored)):
                    rows.append(_features(pid, stored, held, expand))
            yield _read_batch(rows)

    return store.mapInArrow(read, _READ)


def read_joined(gathered: DataFrame) -> DataFrame:
    """Features of payloads given as pid, recipe and gathered [(digest, z)]."""

    def read(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                pid, stored, found = (batch.column(c)[row].as_py() for c in ("pid", "recipe", "found"))
                rows.append(_features(pid, stored, {f["digest"]: f["z"] for f in found}, expand))
            yield _read_batch(rows)

    return gathered.select("pid", "recipe", "found").mapInArrow(read, _READ)


def _digests(column: str = "recipe"):
    """The recipe's digests in order, as a column."""
    count = ((F.length(column) - HEAD) / ENTRY).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(F.col(column), k * ENTRY + HEAD + 1, F.lit(16)))


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row."""
    small_batches(docs.sparkSession)
    listed = durable(manifests(docs), "media_lists")
    distinct = listed.groupBy("pid").agg(F.min("row_key").alias("writer"), F.first("recipe").alias("recipe"), F.first("sha").alias("sha"))
    distinct = durable(distinct, "media_distinct")
    refs = distinct.select("pid", F.posexplode(_digests()).alias("place", "digest"))
    owner = refs.groupBy("digest").agg(F.min(F.struct("pid", "place")).alias("first"))
    mine = split_join(refs, owner, "digest", "media_hot_chunks").withColumn("mine", (F.col("first.pid") == F.col("pid")) & (F.col("first.place") == F.col("place")))
    held = durable(
        mine.groupBy("pid").agg(
            F.sort_array(F.collect_list(F.when(F.col("mine"), F.col("place")))).alias("places"), F.count("*").alias("all"), F.count_if(F.col("first.pid") != F.col("pid")).alias("foreign")
        ),
        "media_held",
    )
    own = split_join(listed.select("row_key", "pid"), distinct.select("pid", "writer").join(held, "pid"), "pid", "media_hot_rows")
    writes = F.col("row_key") == F.col("writer")
    part = own.where(~writes | (F.size("places") < F.col("all"))).select("row_key", "pid", F.when(writes, F.col("places")).alias("places"))
    # rows of one key are of one payload, but for collisions of the key: those rows then write all they have
    part = durable(part.groupBy("row_key").agg(F.min(F.struct("pid", "places")).alias("p")).select("row_key", "p.pid", "p.places"), "media_partial")
    rows, entries = part.agg(F.count("*"), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    store = durable(write_store(docs, part, 10 * rows + entries <= 10 * MOST_SENT), "media_store")

    sharers = durable(held.where("foreign > 0").select("pid").join(distinct, "pid").select("pid", "recipe"), "media_sharers")
    asked = durable(sharers.select("pid", F.explode(F.array_distinct(_digests())).alias("digest")), "media_asked")
    needed = durable(asked.select("digest").distinct(), "media_needed")
    if needed.count() <= MOST_SENT:
        needed = F.broadcast(needed)
    bytes_of = store.select(F.explode(F.arrays_zip("own", "z")).alias("c")).select(F.col("c.own").alias("digest"), F.col("c.z").alias("z")).join(needed, "digest", "left_semi").dropDuplicates(["digest"])
    gathered = split_join(asked, durable(bytes_of, "media_bytes"), "digest", "media_hot_asked").groupBy("pid").agg(F.collect_list(F.struct("digest", "z")).alias("found")).join(sharers, "pid")
    features = read_whole(store).unionByName(read_joined(gathered)).dropDuplicates(["pid"])
    proven = durable(features, "media_features").join(distinct.select("pid", "sha"), "pid")
    exact = F.when(F.lower(F.hex("sha")) == F.col("payload_sha256"), F.col("payload_sha256")).otherwise(F.raise_error(F.lit("a payload read back differs from the one stored")))
    proven = durable(proven.select("pid", exact.alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature"), "media_proven")
    return split_join(listed.select("doc_id", "pid", "n_bytes", "payload_bytes"), proven, "pid", "media_hot_copies").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
