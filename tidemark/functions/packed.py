"""The n-gram index in numbers: grams are 64-bit hashes, and texts are looked up once, at the end.

A task counts blocks of talks and sends, for each range of hashes, one compressed record of (hash, bucket and speaker,
uses, talks, a chunk of talks that holds the gram). Whoever gets a range keeps the grams of two talks and more and asks the
chunks for their words. So a gram of one talk, as most are, costs some eight bytes on the way, and none of its text moves.
"""

from __future__ import annotations

import functools
import hashlib
import re
import string
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .lexicon import ABBREVIATIONS, STOPWORDS
from .text import WORD

_WORD = re.compile(WORD.encode())
#: Bytes of lower-case text: letters, digits and apostrophes stay, marks are ends of sentences and lines, the rest is blank.
_PLAIN = bytes(b if chr(b) in string.ascii_lowercase + string.digits + "'" else ord(".") if b in b".!?" else ord("|") if b == 10 else 32 for b in range(256))
#: What QUIET_STOP has before a stop: alone, at the end of other text, and its length with the sign before it.
_SHORT = frozenset([*string.ascii_lowercase, *ABBREVIATIONS])
_SHORT_END = re.compile(rf"[^a-z0-9'’](?:[a-z]|{'|'.join(ABBREVIATIONS)})\Z")
_LONGEST = max(map(len, _SHORT)) + 1
_STOPS = frozenset(STOPWORDS)
#: Tokens of a block, and different words that a task remembers.
ROOM, MOST_WORDS = 400_000, 500_000
SEED = np.uint64(0x51ED270B35A5)
_CODEC = pa.Codec("zstd", compression_level=1)
_KINDS = (np.uint8, np.uint16, np.uint32, np.uint64)


def hash_of(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = (h ^ more) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, each in the narrowest type and by byte plane, compressed together."""
    head, parts = [len(arrays)], []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = next(k for k, t in enumerate(_KINDS) if top <= np.iinfo(t).max)
        a = np.ascontiguousarray(a.astype(_KINDS[kind]))
        head += [kind, len(a)]
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    raw = struct.pack(f"<{len(head)}I", *head) + b"".join(parts)
    return struct.pack("<Q", len(raw)) + _CODEC.compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(_CODEC.decompress(memoryview(blob)[8:], struct.unpack_from("<Q", blob)[0]), np.uint8)
    many = int(raw[:4].view(np.uint32)[0])
    head, at, found = raw[4 : 4 + 8 * many].view(np.uint32).tolist(), 4 + 8 * many, []
    for kind, n in zip(head[::2], head[1::2], strict=True):
        wide = 1 << kind
        found.append(np.ascontiguousarray(raw[at : at + n * wide].reshape(wide, n).T).view(_KINDS[kind]).reshape(n))
        at += n * wide
    return found


class Coder(dict):
    """piece (letters a-z, digits and apostrophes, or a mark) -> code of its word; below 0 are ends of sentences (-1) and
    lines (-2), a piece without a word (-3) and, from -10 on, those of several words. ``words`` and the arrays are by code."""

    def __init__(self):
        super().__init__({b".": -1, b"|": -2})
        self.words: list[str] = []
        self.several: list[list[int]] = []
        self.hashes, self.stop = np.zeros(0, np.uint64), np.zeros(0, bool)

    def __missing__(self, piece: bytes) -> int:
        if piece.isalpha() or (found := _WORD.findall(piece)) == [piece]:
            self[piece] = code = len(self.words)
            self.words.append(piece.decode())
            return code
        codes = [self[w] for w in found]
        if len(codes) > 1:
            self.several.append(codes)
        self[piece] = code = -9 - len(self.several) if len(codes) > 1 else codes[0] if codes else -3
        return code

    def spread(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The codes in ``pieces``, and of which piece each is."""
        codes = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        new = self.words[len(self.hashes) :]
        self.hashes = np.append(self.hashes, np.array([hash_of(w) for w in new], np.uint64))
        self.stop = np.append(self.stop, np.array([w in _STOPS for w in new], bool))
        owner = np.arange(len(codes))
        if (many := codes <= -10).any():
            lists = [self.several[-10 - c] for c in codes[many].tolist()]
            size = np.ones(len(codes), np.int64)
            size[many] = [len(x) for x in lists]
            owner = np.repeat(owner, size)
            codes = codes[owner]
            codes[np.repeat(many, size)] = np.concatenate(lists)
        kept = codes != -3
        return codes[kept], owner[kept]


@functools.cache
def _coder() -> Coder:
    """The words that this process has seen: its tasks go on with them."""
    return Coder()


class Known:
    """Runs of n words, and their hashes in order."""

    def __init__(self, runs: Iterable[str], n: int):
        self.runs, self.n = frozenset(runs), n
        self.hashes = np.zeros(0, np.uint64)
        if self.runs:
            words = {w: hash_of(w) for run in self.runs for w in run.split(" ")}
            table = np.array([[words[w] for w in run.split(" ")] for run in self.runs], np.uint64)
            h = np.full(len(table), SEED, np.uint64)
            for column in table.T:
                h = mixed(h, column)
            self.hashes = np.unique(h)


def among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Place of each hash in ``ordered``, or -1."""
    if not len(ordered):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
    return np.where(ordered[at] == h, at, -1)


def quiet(text: str) -> str:
    """``re.sub(QUIET_STOP, r"\\1\\2 ", text)`` for a lower-case text, which looks at the stops only."""
    parts = text.split(".")
    if len(parts) == 1:
        return text
    out, taken = [], True
    for k, part in enumerate(parts[:-1]):
        end = part[-_LONGEST:]
        # a stop that went with an abbreviation can't stand before the next one
        taken = (k == 0 or not taken) if part in _SHORT else _SHORT_END.search(end) is not None
        out += (part, " " if taken else ".")
    return "".join([*out, parts[-1]])


def pieces_of_text(text: str | None) -> list[bytes]:
    """Words and marks, by the rules of ``kernels.sentences``."""
    plain = quiet((text or "").lower()).replace("’", "'").encode("utf-8", "replace").translate(_PLAIN)
    return plain.replace(b".", b" . ").replace(b"|", b" | ").split()


def pieces_of_lists(segments: list[list[str]] | None) -> list[bytes]:
    return [t for s in segments or () for t in (*map(str.encode, s), b".")]


class Block:
    """Words of some talks outside of known runs: ``code``, ``row`` (of which talk) and ``seg`` (of which segment)."""

    def __init__(self, coder: Coder, talks: list[list[bytes]], least_words: int, known: Known | None):
        codes, owner = coder.spread([t for talk in talks for t in (*talk, b"|")])
        self.words, self.hashes, self.stop = coder.words, coder.hashes, coder.stop
        all_rows = np.repeat(np.arange(len(talks)), [len(t) + 1 for t in talks])[owner]
        word = codes >= 0
        self.address = np.bincount(all_rows[word], minlength=len(talks)) >= least_words
        at = np.flatnonzero(word & self.address[all_rows])
        sentence, line = (np.cumsum(ends)[at] for ends in (codes < 0, codes == -2))
        code, row = codes[at], all_rows[at]
        gone = np.zeros(len(at), bool)
        if known is not None and len(known.hashes) and len(at) >= known.n:
            n, h = known.n, np.full(len(at), SEED, np.uint64)
            for k in range(n):
                h = mixed(h[: len(at) - k], self.hashes[code[k:]])
            for i in np.flatnonzero((line[: len(at) - n + 1] == line[n - 1 :]) & (among(h, known.hashes) >= 0)).tolist():
                if " ".join(self.words[k] for k in code[i : i + n].tolist()) in known.runs:
                    gone[i : i + n] = True
        # all words, with their lines: counted from the talk's first, empty ones too
        lines = np.bincount(all_rows[codes == -2], minlength=len(talks))
        self.full = code, row, line - (np.cumsum(lines) - lines)[row], gone
        left = ~gone
        self.seg, self.code, self.row = (sentence + np.cumsum(gone))[left], code[left], row[left]
        self._text = None

    def grams(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, hashes) of the 1- to ``most``-grams that neither begin nor end with a stop word."""
        stop, h, many = self.stop[self.code], np.full(len(self.code), SEED, np.uint64), len(self.code)
        for n in range(1, min(most, many) + 1):
            h = mixed(h[: many - n + 1], self.hashes[self.code[n - 1 :]])
            at = np.flatnonzero((self.seg[: many - n + 1] == self.seg[n - 1 :]) & ~stop[: many - n + 1] & ~stop[n - 1 :])
            yield n, at, mixed(h[at], np.uint64(n))

    def texts(self, at: np.ndarray, n: int) -> pa.Array:
        """The words of the grams of ``n`` words at ``at``."""
        if self._text is None:
            self._text = Joined(self.words, self.code)
        return self._text.cut(at, n)

    def places(self) -> np.ndarray:
        """Of each of all words its place in its line."""
        _, row, pos, _ = self.full
        begins = firsts(row, pos)
        return np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(where in all words, hash) of the runs of ``width`` words in one line, none of them in a known run."""
        code, row, pos, gone = self.full
        many = max(len(code) - width + 1, 0)
        h = np.full(len(code), SEED, np.uint64)
        for k in range(min(width, len(code))):
            h = mixed(h[: len(code) - k], self.hashes[code[k:]])
        lost = np.append(0, np.cumsum(gone))
        at = np.flatnonzero((row[:many] == row[width - 1 :]) & (pos[:many] == pos[width - 1 :]) & (lost[width:] == lost[:-width])) if many else np.zeros(0, np.int64)
        return at, h[at]


class Joined:
    """Words by code, joined by blanks; they are ASCII, so a letter is a byte."""

    def __init__(self, words: list[str], code: np.ndarray):
        own = [words[k] for k in code.tolist()]
        self.edge = np.append(0, np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1))
        self.text = np.frombuffer(" ".join(own).encode(), np.uint8)

    def cut(self, at: np.ndarray, n: int) -> pa.Array:
        """``n`` words from each place on."""
        size = self.edge[at + n] - 1 - self.edge[at]
        ends = np.append(0, np.cumsum(size))
        place = np.repeat((self.edge[at] - ends[:-1]).astype(np.int32), size) + np.arange(ends[-1], dtype=np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(self.text[place]))


def blocks(batch: pa.RecordBatch, order: np.ndarray, coder: Coder, least_words: int, known: Known | None) -> Iterator[tuple[np.ndarray, Block]]:
    """Blocks of the batch's talks in ``order``, with the rows of each; texts are tokenised, lists of segments are as they are."""
    lists = "clean" in batch.schema.names
    column, made = batch.column("clean" if lists else "text"), pieces_of_lists if lists else pieces_of_text
    rows, talks, size = [], [], 0

    def block() -> tuple[np.ndarray, Block]:
        if len(coder) > MOST_WORDS:
            coder.clear()
            coder.__init__()
        return np.array(rows, np.int64), Block(coder, talks, least_words, known)

    for row in order.tolist():
        found = made(column[row].as_py())
        rows.append(row)
        talks.append(found)
        size += len(found)
        if size >= ROOM:
            yield block()
            rows, talks, size = [], [], 0
    if rows:
        yield block()


def firsts(*sorted_: np.ndarray) -> np.ndarray:
    """Where rows of columns sorted together begin to differ from the row before."""
    n = len(sorted_[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for a in sorted_:
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def summed(a: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(a, begins) if len(begins) else a[:0]


def counted(batches: Iterable[pa.RecordBatch], ranges: int, least_words: int, known: Known | None, most: int) -> Iterator[pa.RecordBatch]:
    """part, blob: for each range of hashes what the talks (ord, speaker, chunk, and text or clean) count."""
    coder = _coder()
    for batch in batches:
        names = batch.column("speaker").dictionary_encode()
        # 0 is no speaker
        keys = np.array([*(hash_of(n) or 1 for n in names.dictionary.to_pylist()), 0], np.uint64)
        speaker = names.indices.fill_null(len(keys) - 1).to_numpy(zero_copy_only=False)
        ord_, chunk = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "chunk"))
        pairs, pair = np.unique(ord_.astype(np.int64) * len(keys) + speaker, return_inverse=True)
        for rows, block in blocks(batch, np.argsort(pair, kind="stable"), coder, least_words, known):
            found = [(h, block.row[at]) for _, at, h in block.grams(most)]
            if not found:
                continue
            h, row = (np.concatenate(x) for x in zip(*found, strict=True))
            # the talks of a block stand by bucket and speaker: a stable sort keeps them so
            order = np.argsort(h, kind="stable")
            h, row = h[order], row[order]
            own = firsts(h, row)
            uses = np.diff(np.append(own, len(h)))
            h, row = h[own], rows[row[own]]
            who, place = pair[row], chunk[row]
            begins = firsts(h, who)
            talks, uses = np.diff(np.append(begins, len(h))), summed(uses, begins)
            h, who, place = h[begins], who[begins], place[begins]
            part = range_of(h, ranges)
            cuts = np.searchsorted(part, np.arange(ranges + 1))
            parts, blobs = [], []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[p], cuts[p + 1]
                used, code = np.unique(who[a:b], return_inverse=True)
                gaps = np.diff(h[a:b], prepend=np.uint64(0))
                parts.append(p)
                blobs.append(pack(gaps, code, uses[a:b] - 1, talks[a:b] - 1, place[a:b], pairs[used] // len(keys), keys[pairs[used] % len(keys)]))
            yield pa.record_batch([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def merged(batches: Iterable[pa.RecordBatch], least_talks: int) -> Iterator[pa.RecordBatch]:
    """chunk, blob: the grams of ``least_talks`` talks and more in the ranges of one task, for the chunks that have their words."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            held.setdefault(part, []).append(blob)
    for part in sorted(held):
        yield _merged(held.pop(part), least_talks)


def _merged(blobs: list[bytes], least_talks: int) -> pa.RecordBatch:
    columns = [unpack(b) for b in blobs]
    blobs.clear()
    sizes = [len(c[5]) for c in columns]
    ord_, key = np.concatenate([c[5] for c in columns]), np.concatenate([c[6].astype(np.uint64) for c in columns])
    # one code for each bucket and speaker over all records, in order of the buckets
    by = np.lexsort((key, ord_))
    new = firsts(ord_[by], key[by])
    code = np.empty(len(by), np.int32)
    code[by] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(by))))
    ord_, known = ord_[by][new], key[by][new] != 0
    who = np.concatenate([code[a : a + n][c[1]] for c, a, n in zip(columns, np.cumsum([0, *sizes[:-1]]).tolist(), sizes, strict=True)])
    h = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in columns])
    uses, talks, place = (np.concatenate([c[k] for c in columns]) for k in (2, 3, 4))
    del columns
    order = np.argsort(h, kind="stable")
    h = h[order]
    begins = firsts(h)
    enough = summed(talks[order].astype(np.int64) + 1, begins) >= least_talks
    sel = np.repeat(enough, np.diff(np.append(begins, len(h))))
    order, h = order[sel], h[sel]
    who, uses, talks, place = who[order], uses[order].astype(np.int64) + 1, talks[order].astype(np.int64) + 1, place[order]
    order = np.lexsort((who, h))
    h, who, uses, talks, place = h[order], who[order], uses[order], talks[order], place[order]
    one = firsts(h, who)
    speakers = np.zeros(len(h), np.int64)
    speakers[one] = known[who[one]]
    when = ord_[who]
    begins = firsts(h, when)
    uses, talks, speakers, when = summed(uses, begins), summed(talks, begins), summed(speakers, begins), when[begins]
    terms = firsts(h)
    place = np.minimum.reduceat(place, terms) if len(terms) else place[:0]
    many = np.diff(np.searchsorted(begins, np.append(terms, len(h))))
    h = h[terms]
    # grams by chunk, each with its buckets
    order = np.argsort(place, kind="stable")
    at = np.repeat((np.cumsum(many) - many)[order], many[order])
    inner = np.arange(len(at)) - np.repeat(np.cumsum(many[order]) - many[order], many[order])
    uses, talks, speakers, when = (a[at + inner] for a in (uses, talks, speakers, when))
    h, many, place = h[order], many[order], place[order]
    cuts, ends = np.append(firsts(place), len(place)), np.append(0, np.cumsum(many))
    chunks, out = [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        x, y = ends[a], ends[b]
        chunks.append(int(place[a]))
        out.append(pack(np.diff(h[a:b], prepend=np.uint64(0)), many[a:b], when[x:y], uses[x:y], talks[x:y], speakers[x:y]))
    return pa.record_batch([pa.array(chunks, pa.int32()), pa.array(out, pa.binary())], ["chunk", "blob"])


#: A term with its buckets; the lists go together.
HISTORY = "term string, first_ord int, total_count long, total_talks long, ords array<int>, counts array<long>, talks array<long>, speakers array<long>"


def named(talks: pa.Table, asked: pa.Table, least_words: int, known: Known | None, most: int) -> pa.Table:
    """The asked grams of one chunk of talks, with their words."""
    columns = [unpack(b) for b in asked.column("blob").to_pylist()]
    if columns:
        h = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in columns])
        many, when, uses, used, speakers = (np.concatenate([c[k].astype(np.int64) for c in columns]) for k in range(1, 6))
    else:
        h, (many, when, uses, used, speakers) = np.zeros(0, np.uint64), (np.zeros(0, np.int64) for _ in range(5))
    order = np.argsort(h)
    ordered, texts, places, open_, coder = h[order], [pa.array([], pa.string())], [np.zeros(0, np.int64)], np.ones(len(h), bool), _coder()
    for batch in talks.to_batches() if len(h) else ():
        for _, block in blocks(batch, np.arange(batch.num_rows), coder, least_words, known):
            for n, at, found in block.grams(most):
                place = among(found, ordered)
                hit = np.flatnonzero(place >= 0)
                hit = hit[open_[place[hit]]]
                place, first = np.unique(place[hit], return_index=True)
                texts.append(block.texts(at[hit[first]], n))
                places.append(order[place])
                open_[place] = False
    if open_.any():
        raise RuntimeError(f"{int(open_.sum())} terms have no words in their chunk")
    words = pa.concat_arrays(texts).take(pa.array(np.argsort(np.concatenate(places))))
    begins = (np.cumsum(many) - many).astype(np.int64)
    offsets = pa.array(np.append(begins, len(when)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(a, kind)) for a, kind in ((when, pa.int32()), (uses, pa.int64()), (used, pa.int64()), (speakers, pa.int64()))]
    first = np.minimum.reduceat(when, begins) if len(begins) else when
    made = [words, pa.array(first, pa.int32()), pa.array(summed(uses, begins), pa.int64()), pa.array(summed(used, begins), pa.int64()), *lists]
    return pa.table(made, [f.split(" ")[0] for f in HISTORY.split(", ")])


def sized(batches: Iterable[pa.RecordBatch], least_words: int, known: Known | None) -> Iterator[pa.RecordBatch]:
    """talk_id, ord, speaker, grp, words outside of known runs, of the addresses."""
    coder = _coder()
    for batch in batches:
        for rows, block in blocks(batch, np.arange(batch.num_rows), coder, least_words, known):
            words = np.bincount(block.row, minlength=len(rows))[block.address]
            at = pa.array(rows[block.address])
            yield pa.record_batch([*(batch.column(c).take(at) for c in ("talk_id", "ord", "speaker", "grp")), pa.array(words, pa.int64())], ["talk_id", "ord", "speaker", "grp", "words"])


def told(terms: DataFrame) -> np.ndarray:
    """The hashes of ``terms`` (term), in order; only they come to the driver."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([pack(hashes_of(batch.column("term").to_pylist()))], pa.binary())], ["blob"])

    found = [unpack(r["blob"])[0] for r in terms.select("term").mapInArrow(made, "blob binary").collect()]
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(f.astype(np.uint64) for f in found)]))


def hashed(terms: DataFrame) -> DataFrame:
    """term, h."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("term"), pa.array(hashes_of(batch.column("term").to_pylist()).view(np.int64))], ["term", "h"])

    return terms.select("term").mapInArrow(made, "term string, h long")


def hashes_of(terms: list[str]) -> np.ndarray:
    """As ``Block.grams`` has them."""
    seen: dict[str, int] = {}
    lists = [[seen[w] if w in seen else seen.setdefault(w, hash_of(w)) for w in term.split(" ")] for term in terms]
    size = np.array([len(x) for x in lists], np.int64)
    out = np.zeros(len(lists), np.uint64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        h = np.full(len(at), SEED, np.uint64)
        for column in np.array([lists[k] for k in at.tolist()], np.uint64).T:
            h = mixed(h, column)
        out[at] = mixed(h, np.uint64(n))
    return out


def used(batches: Iterable[pa.RecordBatch], least_words: int, known: Known | None, most: int, asked: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """term, talk_id, ord, speaker, grp, c: uses of every gram by talk, or of those whose hashes are ``asked``."""
    coder, keys = _coder(), ("talk_id", "ord", "speaker", "grp")
    for batch in batches:
        for rows, block in blocks(batch, np.arange(batch.num_rows), coder, least_words, known):
            for n, at, h in block.grams(most):
                if asked is not None:
                    some = among(h, asked) >= 0
                    at, h = at[some], h[some]
                key = mixed(h, block.row[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
                order = np.argsort(key, kind="stable")
                begins = firsts(key[order])
                uses, first = np.diff(np.append(begins, len(key))), order[begins]
                # in the order of the talks
                by = np.argsort(first)
                uses, first = uses[by], first[by]
                owner = pa.array(rows[block.row[at[first]]])
                yield pa.record_batch([block.texts(at[first], n), *(batch.column(c).take(owner) for c in keys), pa.array(uses, pa.int64())], ["term", *keys, "c"])


def passages(batches: Iterable[pa.RecordBatch], least_words: int, known: Known | None, most: int, asked: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """talk, talk_id, h, run: for each talk and asked gram the runs of ``width`` words around its uses, and once no run. ``talk``
    is null but in that row."""
    coder = _coder()
    for batch in batches:
        for rows, block in blocks(batch, np.arange(batch.num_rows), coder, least_words, known):
            run, many = np.full(len(block.code), SEED, np.uint64), len(block.code)
            for k in range(min(width, many + 1)):
                run = mixed(run[: many - k], block.hashes[block.code[k:]])
            whole = block.seg[: max(many - width + 1, 0)] == block.seg[width - 1 :]
            for n, at, h in block.grams(most):
                some = among(h, asked) >= 0
                at, h = at[some], h[some]
                row = block.row[at]
                by = np.lexsort((row, h))
                own = by[firsts(h[by], row[by])]
                found = [(row[own], h[own], np.zeros(len(own), np.uint64), np.ones(len(own), bool))]
                for k in range(width - n + 1):
                    begin = at - k
                    fits = np.flatnonzero((begin >= 0) & (begin < len(whole)))
                    fits = fits[whole[begin[fits]]]
                    found.append((row[fits], h[fits], run[begin[fits]], np.zeros(len(fits), bool)))
                row, h, around, use = (np.concatenate(x) for x in zip(*found, strict=True))
                by = np.lexsort((use, around, h, row))
                by = by[firsts(row[by], h[by], around[by], use[by])]
                talk = batch.column("talk_id").take(pa.array(rows[row[by]]))
                none = pa.array(use[by])
                yield pa.record_batch([pa.compute.if_else(none, talk, None), talk, pa.array(h[by].view(np.int64)), pa.compute.if_else(none, None, pa.array(around[by].view(np.int64)))], ["talk", "talk_id", "h", "run"])


def run_counts(batches: Iterable[pa.RecordBatch], least_words: int, known: Known | None, width: int) -> Iterator[pa.RecordBatch]:
    """talk_id, n, different: how many runs of ``width`` words outside of known runs a talk has, where there are any."""
    for batch in batches:
        for rows, block in blocks(batch, np.arange(batch.num_rows), _coder(), least_words, known):
            at, h = block.runs(width)
            row = block.full[1][at]
            many = np.bincount(row, minlength=len(rows))
            order = np.lexsort((h, row))
            different = np.bincount(row[order][firsts(row[order], h[order])], minlength=len(rows))
            some = many > 0
            yield pa.record_batch([batch.column("talk_id").take(pa.array(rows[some])), pa.array(many[some], pa.int64()), pa.array(different[some], pa.int64())], ["talk_id", "n", "different"])


def phrase_uses(batches: Iterable[pa.RecordBatch], least_words: int, known: Known | None, phrase: str) -> Iterator[pa.RecordBatch]:
    """talk_id, ord, speaker, k: uses of the phrase (overlapping) in the clean segments of the talks that have any."""
    words = phrase.split(" ")
    for batch in batches:
        coder = _coder()
        for rows, block in blocks(batch, np.arange(batch.num_rows), coder, least_words, known):
            code = [coder.get(w.encode(), -9) for w in words]
            many = max(len(block.code) - len(code) + 1, 0)
            holds = block.seg[:many] == block.seg[len(code) - 1 :] if many else np.zeros(0, bool)
            for k, c in enumerate(code):
                holds = holds & (block.code[k : k + many] == c)
            uses = np.bincount(block.row[:many][holds], minlength=len(rows))
            at = pa.array(rows[uses > 0])
            yield pa.record_batch([*(batch.column(c).take(at) for c in ("talk_id", "ord", "speaker")), pa.array(uses[uses > 0], pa.int64())], ["talk_id", "ord", "speaker", "k"])


def marked(batches: Iterable[pa.RecordBatch], least_words: int, known: Known | None) -> Iterator[pa.RecordBatch]:
    """talk_id, ord, pos, norm, mask of the paragraphs that hold a known run: their words, and the places of those in a run."""
    for batch in batches:
        for rows, block in blocks(batch, np.arange(batch.num_rows), _coder(), least_words, known):
            code, row, pos, gone = block.full
            begins = firsts(row, pos)
            size = np.diff(np.append(begins, len(code)))
            some = summed(gone.astype(np.int64), begins) > 0
            sel = np.repeat(some, size)
            norm = pa.array([block.words[c] for c in code[sel].tolist()], pa.string())
            places = block.places()[sel & gone]
            ends = np.append(0, np.cumsum(size[some])), np.append(0, np.cumsum(summed(gone.astype(np.int64), begins)[some]))
            lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), a) for e, a in zip(ends, (norm, pa.array(places, pa.int32())), strict=True)]
            at = pa.array(rows[row[begins[some]]])
            yield pa.record_batch([*(batch.column(c).take(at) for c in ("talk_id", "ord")), pa.array(pos[begins[some]], pa.int32()), *lists], ["talk_id", "ord", "pos", "norm", "mask"])
