"""Token-id files in directly addressable codes.

A file holds the ids of a run of documents. Ids are split into 8-bit levels, lowest first: level k stores byte k of
every id that has one, with a bitmap that tells which of its entries go on to level k + 1, and a rank directory (set
bits before every 512th entry). The i-th id needs one byte and one rank a level, so any token is read without decoding
its neighbours; the entries of a run of ids lie side by side in every level, so a document needs its own bytes and two
ranks a level.

File layout (little-endian): magic ``TMDC``, counts of documents and levels (int64 each), document ids (int64, null as
the smallest), document offsets (int64, one more than documents), then per level: entries (int64), bytes, bitmap padded
to whole bytes, directory (int64 for every 512 entries). An image is complete in itself; images are kept as the rows of
a Parquet table in the shared folder, which every executor can read wherever it lies.

Documents are dealt to partitions by ranges of (doc_id, hash of the text) and sorted there; each partition is cut into
files as it streams by, so memory is bounded by one file and an id that very many rows share is split like any other.

Null texts are empty; an empty text is the end id alone. Null ids come first; rows of one id are in the order of a hash
of their texts. A very long text is one document of a file of its own. An empty table gives no file and no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, id_column, int_ids, slices, small_batches, trimmed
from .units import REST, encoder

MAGIC = b"TMDC"
STEP = 512
END = 2
#: A file ends with the document that brings it to so many documents or ids.
FILE_DOCS = 2048
FILE_IDS = 4 << 20
#: Rows to a sorted partition, about, where the session's number of partitions makes them larger.
PART_DOCS = 32_768


def encode_file(doc_ids: np.ndarray, at: np.ndarray, ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while rest.size:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(more, dtype=np.int64)])[: rest.size : STEP]
        levels.append((np.int64(rest.size).tobytes(), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<i8").tobytes()))
        rest = rest[more] >> 8
    head = np.array([len(doc_ids), len(levels)], "<i8").tobytes()
    return b"".join([MAGIC, head, doc_ids.astype("<i8").tobytes(), at.astype("<i8").tobytes(), *(x for level in levels for x in level)])


class CodeFile:
    """Reads one file image; ``tokens`` returns the ids at any positions, ``run`` those from one position to another."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token-code file")
        docs, levels = np.frombuffer(image, "<i8", 2, 4)
        at = 20
        self.doc_ids = np.frombuffer(image, "<i8", docs, at)
        self.at = np.frombuffer(image, "<i8", docs + 1, at := at + 8 * int(docs))
        at += 8 * (int(docs) + 1)
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(image, "<i8", 1, at)[0])
            codes = np.frombuffer(image, np.uint8, n, at + 8)
            bits = image[at + 8 + n : at + 8 + n + -(-n // 8)]
            ranks = np.frombuffer(image, "<i8", -(-n // STEP), at := at + 8 + n + -(-n // 8))
            at += 8 * -(-n // STEP)
            self.levels.append((codes, bits, ranks))

    def _rank(self, level: int, place: int) -> int:
        """Set bits before ``place``: the directory's entry, and those of the bits between."""
        _, bits, ranks = self.levels[level]
        block = min(place // STEP, len(ranks) - 1)
        begin = block * (STEP // 8)
        between = int.from_bytes(bits[begin : (place + 7) >> 3], "little") & ((1 << (place - block * STEP)) - 1)
        return int(ranks[block]) + between.bit_count()

    def tokens(self, positions: np.ndarray) -> np.ndarray:
        """Ids at ``positions``: level by level, the rank of a set bit is the entry's place in the next level."""
        out = np.zeros(len(positions), np.uint32)
        for n, place in enumerate(np.asarray(positions).tolist()):
            for k, (codes, bits, _) in enumerate(self.levels):
                out[n] |= np.uint32(codes[place]) << np.uint32(8 * k)
                if not bits[place >> 3] >> (place & 7) & 1:
                    break
                place = self._rank(k, place)
        return out

    def run(self, a: int, b: int) -> np.ndarray:
        """Ids from position ``a`` to before ``b``: what goes on from a run is a run of the next level."""
        a, b = int(a), int(b)
        out, live = np.zeros(b - a, np.uint32), None
        for k, (codes, bits, _) in enumerate(self.levels):
            part = codes[a:b].astype(np.uint32)
            if live is None:
                out[:] = part
            else:
                out[live] |= part << np.uint32(8 * k)
            raw = np.frombuffer(bits[a >> 3 : (b + 7) >> 3], np.uint8)
            on = np.flatnonzero(np.unpackbits(raw, bitorder="little")[a & 7 : (a & 7) + b - a])
            if not len(on):
                break
            live = on if live is None else live[on]
            a = self._rank(k, a)
            b = a + len(on)
        return out

    def document(self, row: int) -> np.ndarray:
        return self.run(self.at[row], self.at[row + 1])


def write_files(docs: DataFrame, path: str, end: int = END, blank: bool = False, file_docs: int = FILE_DOCS, file_ids: int = FILE_IDS) -> DataFrame:
    """(part int, seq int, tokens long, image binary): files of all documents; (part, seq) ascend with doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // PART_DOCS)
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_key").asc()]
    sorted_ = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def image(keys: list, ids: list, sizes: list) -> bytes:
        return encode_file(np.concatenate(keys), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(ids))

    def built(batches):
        coder, part, seq = encoder(path, blank), 0, 0
        keys, ids, sizes, docs_, total = [], [], [], 0, 0

        def out():
            raw = image(keys, ids, sizes)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([total]), pa.array([raw], pa.binary())], ["part", "seq", "tokens", "image"])

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for piece in slices(batch, "text", 2 << 20):
                made, at = coder.documents([x or "" for x in piece.column("text").to_pylist()], end)
                own, length, row = int_ids(piece.column("doc_id")), np.diff(at), 0
                while row < len(own):
                    # as many documents as the file still takes: the last one may pass the bound
                    fit = int(np.searchsorted(at, at[row] + max(1, file_ids - total), "left"))
                    stop = min(len(own), max(row + 1, fit), row + file_docs - docs_)
                    keys.append(own[row:stop])
                    ids.append(made[at[row] : at[stop]])
                    sizes.append(length[row:stop])
                    docs_, total, row = docs_ + stop - row, total + int(at[stop] - at[row]), stop
                    if docs_ >= file_docs or total >= file_ids:
                        yield out()
                        keys, ids, sizes, docs_, total, seq = [], [], [], 0, 0, seq + 1
        if docs_:
            yield out()
        coder.shrink(REST)

    return sorted_.withColumn("part", F.spark_partition_id()).select("part", "doc_id", "text").mapInArrow(trimmed(built), "part int, seq int, tokens long, image binary")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, part, seq, place (ids before it in its file), n_tokens, ids_crc32 of every document in the files.

    Each document is read by itself, through the rank directories."""

    def read(batches):
        for batch in batches:
            for part, seq, image in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "image")), strict=True):
                f = CodeFile(image)
                crc = [zlib.crc32(f.document(row).astype("<u4").tobytes()) for row in range(len(f.doc_ids))]
                same = lambda x: pa.array(np.full(len(crc), x, np.int32))  # noqa: B023, E731
                yield pa.record_batch(
                    [id_column(f.doc_ids), same(part), same(seq), pa.array(f.at[:-1]), pa.array(np.diff(f.at)), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "seq", "place", "n_tokens", "ids_crc32"],
                )

    return files.select("part", "seq", "image").mapInArrow(trimmed(read), "doc_id long, part int, seq int, place long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, path: str, end: int = END, blank: bool = False) -> DataFrame:
    """Write the files to the shared folder, read them back and add each document's global start."""
    files = durable(write_files(docs, path, end, blank), "token_files")
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a sorted partition, so this window is over their number only
    parts = files.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", before(Window.orderBy("part")).alias("ahead"))
    within = files.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("first"))
    starts = within.join(parts, "part").select("part", "seq", (F.col("ahead") + F.col("first")).alias("first"))
    return read_files(files).join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")
