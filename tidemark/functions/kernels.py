"""The token rules over whole texts, by Arrow batch.

Lambdas over arrays are interpreted row by row in the JVM; what needs several passes over a paragraph's tokens (sentences,
masks, runs of words) is done here in one, with the same rules as the column expressions in ``text``, and hands flat rows
back to Spark, which does all grouping and joining.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .stem import stem
from .text import QUIET_STOP, WORD

_WORD, _QUIET, _STOP = re.compile(WORD), re.compile(QUIET_STOP), re.compile("[.!?]+")
#: Tokens that are worked on at once.
ROOM = 200_000


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("’", "'"))


def sentences(para: str) -> list[list[str]]:
    """Word lists of a paragraph's sentences; a stop after an initial or an abbreviation ends none. Empty ones go."""
    found = (words(s) for s in _STOP.split(_QUIET.sub(r"\1\2 ", para.lower())))
    return [s for s in found if s]


def runs(tokens: list[str], n: int) -> Iterator[str]:
    """All runs of n tokens, joined by blanks."""
    joined, ends = " ".join(tokens), np.cumsum([len(t) + 1 for t in tokens]).tolist()
    begin = [0, *ends]
    return (joined[begin[i] : ends[i + n - 1] - 1] for i in range(len(tokens) - n + 1))


def mask(tokens: list[str], known: frozenset[str], n: int) -> list[int]:
    """Places of the tokens inside a run of n words that ``known`` has."""
    places, past = [], 0
    for i, run in enumerate(runs(tokens, n)):
        if run in known:
            places += range(max(i, past), i + n)
            past = i + n
    return places


def clean(segs: list[list[str]], masked: list[int]) -> list[list[str]]:
    """Sentences cut at masked tokens; what is left of each, without empty parts."""
    if not masked:
        return segs
    out, held, at, gone = [], [], 0, set(masked)
    for sentence in segs:
        for word in sentence:
            if at in gone:
                out.append(held)
                held = []
            else:
                held.append(word)
            at += 1
        out.append(held)
        held = []
    return [part for part in out if part]


def paragraphs(text: str, least_words: int) -> list[tuple[int, list[list[str]]]]:
    """(place, sentences) of the lines that aren't blank; none where the text has fewer words."""
    found = [(k, sentences(line)) for k, line in enumerate((text or "").split("\n")) if line.strip(" ")]
    return found if sum(len(s) for _, segs in found for s in segs) >= least_words else []


_KEPT = "talk_id long, ord int, speaker string, grp string"
_KEYS = ("talk_id", "ord", "speaker", "grp")


def _repeated(batch: pa.RecordBatch, rows: list[int]) -> list[pa.Array]:
    return [batch.column(c).take(pa.array(rows, pa.int64())) for c in _KEYS]


def normalised(talks: DataFrame, least_words: int, known: frozenset[str] | None, n: int) -> DataFrame:
    """talk_id, ord, speaker, grp, pos, norm, segs, mask, clean of the paragraphs of talks of ``least_words`` and more.

    ``mask`` (null where empty) and ``clean`` are by the runs of n words in ``known``; without it they are null and the
    sentences."""
    sent = talks.sparkSession.sparkContext.broadcast(known)

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pos, norm, segs, masks, cleans, size = [], [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                lists = pa.list_(pa.list_(pa.string()))
                columns = [pa.array(pos, pa.int32()), pa.array(norm, pa.list_(pa.string())), pa.array(segs, lists), pa.array(masks, pa.list_(pa.int32())), pa.array(cleans, lists)]
                return pa.record_batch([*_repeated(batch, rows), *columns], [*_KEYS, "pos", "norm", "segs", "mask", "clean"])  # noqa: B023

            for row, text in enumerate(batch.column("text")):
                for k, own in paragraphs(text.as_py(), least_words):
                    flat = [w for s in own for w in s]
                    gone = mask(flat, sent.value, n) if sent.value else []
                    rows.append(row)
                    pos.append(k)
                    norm.append(flat)
                    segs.append(own)
                    masks.append(gone or None)
                    cleans.append(clean(own, gone))
                    size += len(flat)
                if size > ROOM:
                    yield out()
                    rows, pos, norm, segs, masks, cleans, size = [], [], [], [], [], [], 0
            yield out()

    schema = f"{_KEPT}, pos int, norm array<string>, segs array<array<string>>, mask array<int>, clean array<array<string>>"
    return talks.select(*_KEYS, "text").mapInArrow(made, schema)


def clean_text(talks: DataFrame, least_words: int, known: Broadcast, n: int) -> DataFrame:
    """talk_id, pos, clean of the paragraphs of talks of ``least_words`` and more: the segments outside of ``known`` runs."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pos, found, size = [], [], [], 0

            def out() -> pa.RecordBatch:
                return pa.record_batch([batch.column("talk_id").take(pa.array(rows, pa.int64())), pa.array(pos, pa.int32()), pa.array(found, pa.string())], ["talk_id", "pos", "clean"])  # noqa: B023

            for row, text in enumerate(batch.column("text")):
                for k, own in paragraphs(text.as_py(), least_words):
                    gone = mask([w for s in own for w in s], known.value.runs, n) if known.value.runs else []
                    rows.append(row)
                    pos.append(k)
                    found.append(" | ".join(map(" ".join, clean(own, gone))))
                    size += len(found[-1])
                if size > 5 * ROOM:
                    yield out()
                    rows, pos, found, size = [], [], [], 0
            yield out()

    return talks.select("talk_id", "text").mapInArrow(made, "talk_id long, pos int, clean string")


def masked(paras: DataFrame, known: frozenset[str], n: int) -> DataFrame:
    """talk_id, pos, mask of the paragraphs (talk_id, pos, norm) that hold a known run."""
    sent = paras.sparkSession.sparkContext.broadcast(known)

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, m) for k, tokens in enumerate(batch.column("norm")) if (m := mask(tokens.as_py(), sent.value, n))]
            rows = pa.array([k for k, _ in found], pa.int64())
            yield pa.record_batch([batch.column("talk_id").take(rows), batch.column("pos").take(rows), pa.array([m for _, m in found], pa.list_(pa.int32()))], ["talk_id", "pos", "mask"])

    return paras.select("talk_id", "pos", "norm").mapInArrow(made, "talk_id long, pos int, mask array<int>")


def recleaned(paras: DataFrame) -> DataFrame:
    """``paras`` with ``clean`` anew from ``segs`` and ``mask``."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [clean(s, m or []) for s, m in zip(batch.column("segs").to_pylist(), batch.column("mask").to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("clean"), "clean", pa.array(found, pa.list_(pa.list_(pa.string()))))

    return paras.mapInArrow(made, paras.schema)


def shingles(paras: DataFrame, k: int) -> DataFrame:
    """talk_id, ord, speaker, grp, pos, i, shingle: the runs of k words of ``norm`` that hold no masked token."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, found = [], [], []
            for row, (tokens, gone) in enumerate(zip(batch.column("norm"), batch.column("mask"), strict=True)):
                bad = set(gone.as_py() or ())
                tokens = tokens.as_py()
                free = [True] * max(len(tokens) - k + 1, 0)
                for m in bad:
                    for i in range(max(0, m - k + 1), min(m + 1, len(free))):
                        free[i] = False
                for i, run in enumerate(runs(tokens, k)):
                    if free[i]:
                        rows.append(row)
                        at.append(i)
                        found.append(run)
                if len(found) > ROOM:
                    yield pa.record_batch([*_repeated(batch, rows), batch.column("pos").take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(found, pa.string())], [*_KEYS, "pos", "i", "shingle"])
                    rows, at, found = [], [], []
            yield pa.record_batch([*_repeated(batch, rows), batch.column("pos").take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(found, pa.string())], [*_KEYS, "pos", "i", "shingle"])

    return paras.select(*_KEYS, "pos", "norm", "mask").mapInArrow(made, f"{_KEPT}, pos int, i int, shingle string")


def stem_runs(paras: DataFrame, most: int = 5) -> DataFrame:
    """run: every run of 1 to ``most`` stems in ``norm``, once a batch."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            found: set[str] = set()
            for tokens in batch.column("norm"):
                own = [known.setdefault(w, stem(w)) for w in tokens.as_py()]
                for n in range(1, most + 1):
                    found.update(runs(own, n))
            yield pa.record_batch([pa.array(sorted(found), pa.string())], ["run"])

    return paras.select("norm").mapInArrow(made, "run string")


def hits(talks: DataFrame, known: frozenset[str], n: int) -> DataFrame:
    """talk_id, run: the known runs of n words that each talk (talk_id, text) holds."""
    sent = talks.sparkSession.sparkContext.broadcast(known)

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, run) for k, text in enumerate(batch.column("text")) for run in sent.value.intersection(runs(words(text.as_py() or ""), n))]
            rows = pa.array([k for k, _ in found], pa.int64())
            yield pa.record_batch([batch.column("talk_id").take(rows), pa.array([r for _, r in found], pa.string())], ["talk_id", "run"])

    return talks.select("talk_id", "text").mapInArrow(made, "talk_id long, run string")
