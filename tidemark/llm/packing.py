"""Sum-of-squares packing of token sequences.

A document's ids (with the end id) of at most ``size`` are one piece; a longer one is cut into pieces of ``size``, the
first piece taking what is left over. Whole pieces fill a sequence each. Every other piece goes where the sum over all
residual gaps of (open bins with that gap) squared becomes smallest: only the counts per gap matter, so one placement
is a vector operation over ``size`` gaps. Pieces are placed from the longest down, in groups by a hash of id, place and
content, so groups run on any number of executors, an id that very many rows share is spread over all of them, and only a
few bins a group stay open.

Null texts are empty (the end id alone); null ids are kept; a very long text is encoded whole and makes many pieces;
repeated rows are packed as often as they occur, pieces of equal length in the order of id, piece and content. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_column, int_ids, slices, small_batches, trimmed
from .units import REST, encoder

SIZE = 1024
END = 2
GROUP_DOCS = 8192


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = length % size if length > size else length
    return ([(0, first)] if first else []) + [(at, size) for at in range(first, length, size)]


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)

    def made(batches):
        coder = encoder(path, True)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, at = coder.documents([x or "" for x in part.column("text").to_pylist()], end)
                raw, bounds = ids.astype("<u4").tobytes(), at.tolist()
                keys, rows = int_ids(part.column("doc_id")), []
                for row, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows += [(row, k, s, n, zlib.crc32(raw[4 * (a + s) : 4 * (a + s + n)])) for k, (s, n) in enumerate(cut(b - a, size))]
                row, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                yield pa.record_batch([id_column(keys[row]), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        coder.shrink(REST)

    return docs.select("doc_id", "text").mapInArrow(trimmed(made), "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the given order, by the sum-of-squares rule.

    Moving a piece of length n from gap g to gap g - n changes the sum by 2 * (N[g - n] - N[g]) + 2;
    closing a bin (g = n) by 1 - 2 * N[n]. Ties go to the smallest gap. A new bin is opened only where no open one has
    room: with pieces from the longest down this ends within a bin or two of the total length's bound.
    """
    count = np.zeros(size + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.iinfo(np.int64).max
    for i, n in enumerate(lengths.tolist()):
        held = count[n:size]
        cost = np.where(held > 0, 2 * (count[: size - n] - held) + 2, far)
        if n < size and held[0]:
            cost[0] = 1 - 2 * held[0]
        best = int(cost.argmin()) if n < size else 0
        if n < size and cost[best] < far:
            gap = best + n
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, made = size, made, made + 1
        bins[i], offsets[i] = b, size - gap
        if gap > n:
            count[gap - n] += 1
            open_bins[gap - n].append(b)
    return bins, offsets


def pack(parts: DataFrame, groups: int, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece and length."""

    def packed(group: pa.Table) -> pa.Table:
        number = group.column("pack_group")[0].as_py()
        length, piece, keys, crc = (group.column(c).to_numpy() for c in ("length", "piece", "doc_key", "ids_crc32"))
        order = np.lexsort((crc, piece, keys, -length))
        bins, offsets = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        bins[order], offsets[order] = place(length[order], size)
        keep = group.drop_columns(["pack_group", "doc_key"])
        return keep.append_column("sequence_id", pa.array(bins + (np.int64(number) << 32))).append_column("offset", pa.array(offsets))

    kept = parts.select("doc_id", "piece", "start", "length", "ids_crc32")
    keyed = kept.withColumn("doc_key", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("pack_group", F.pmod(F.xxhash64("doc_key", "start", "ids_crc32"), F.lit(groups)))
    return keyed.groupBy("pack_group").applyInArrow(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end: int = END, group_docs: int = GROUP_DOCS) -> DataFrame:
    groups = max(1, -(-docs.count() // group_docs))
    return pack(pieces(docs, path, size, end), groups, size)
