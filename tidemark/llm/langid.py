"""Language of every document from a linear-chain conditional random field over its words.

A word (a run of letters) has one score per language: the sum of weights of its hashed byte n-grams, where n-grams that
reach over the word's edge are its affixes, and of its own lexicon entry. Learned transitions tie neighbouring words, so
code-switched runs are found; forward-backward gives each word's language probabilities, and the document gets the
language with the largest sum. Training maximises the likelihood of word sequences that are spliced from documents of
the languages, so the transitions see switches.

Forward-backward runs over all words of a batch at once: the word sequence, with restarts where a document begins, is
folded into lanes; each lane's transfer matrix links it to the next, which is exact for documents of any length. Very
long sequences go in segments, each entered with the state that the one before leaves, so memory stays bounded.

The model is fitted on at most ``PER_LANG`` documents of every language, chosen by a hash of id and text; texts over
``LONGEST_FIT`` characters give pieces from all over. All languages are learned, a language costs 1 MB of weights. Null
text and text without a letter give ``und`` and score 0; with nothing to learn from every document is ``und``. Null
languages and languages without any word are not learned from. A null id is not held out. Repeated rows are labelled
alike and learned from once, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_LETTERS, id_column, int_ids, slices, small_batches, text_buffer, whole_or_pieces, word_hashes, word_spans

BITS = 16
PER_LANG = 400
#: Characters of a text that are learned from.
LONGEST_FIT = 100_000
#: Words of a sequence that are worked on at once; bytes of text at once, divided by the number of languages.
SEGMENT = 1 << 18
ROOM = 8 << 20
#: Languages up to which their counts (about 30 bytes each) are sent to every executor.
MOST_SENT = 100_000
STEPS = 160
SPAN = 64
_FOLD = np.where(NOT_LETTERS, 0, np.arange(256)).astype(np.uint32)
_FOLD[65:91] += 32


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram buckets by byte as 3 columns, word starts, word ends, first word of each row), lexicon as a 4th array."""
    data, at = text_buffer(texts)
    starts, ends = word_spans(data, at, NOT_LETTERS)
    first = np.searchsorted(starts, at)
    code = np.zeros(len(data) + 3, np.uint32)
    code[1:-2] = _FOLD[data]
    return code, starts, ends, first, (word_hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)


def _grams(code: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram whose first byte stands before byte i; separators are one symbol, so edges show."""
    size = len(code) - 3
    key = np.zeros(size, np.uint32)
    for k in range(n):
        key = (key * np.uint32(257) + code[k : k + size] + np.uint32(1)) * np.uint32(2654435761)
    return ((key ^ np.uint32(n * 0x9E37)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def _normed(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


class _Lanes:
    """A sequence of words folded into lanes of equal length."""

    def __init__(self, score: np.ndarray, restart: np.ndarray, trans: np.ndarray, begin: np.ndarray):
        self.total, self.n = score.shape
        self.lanes = max(1, int(self.total**0.5))
        self.length = -(-self.total // self.lanes)
        pad = self.lanes * self.length - self.total
        emit = np.exp(np.maximum(score - score.max(1, keepdims=True), -50))
        # what pads the last lane says nothing and leaves the state as it is
        self.emit = np.concatenate([emit, np.ones((pad, self.n))]).reshape(self.lanes, self.length, self.n)
        self.cut = np.concatenate([restart, np.zeros(pad, bool)]).reshape(self.lanes, self.length)
        self.idle = np.concatenate([np.zeros(self.total, bool), np.ones(pad, bool)]).reshape(self.lanes, self.length)
        self.trans, self.begin = trans, begin
        self.through: list[np.ndarray | None] = [None, None]

    def _forward(self, state: np.ndarray, keep: np.ndarray | None) -> np.ndarray:
        for t in range(self.length):
            shape = (-1, *[1] * (state.ndim - 1))
            moved = np.where(self.cut[:, t].reshape(shape), self.begin, state @ self.trans)
            state = np.where(self.idle[:, t].reshape(shape), state, moved)
            state = state * (self.emit[:, t] if state.ndim == 2 else self.emit[:, t, None])
            state = state / (state.sum((1, 2), keepdims=True) if state.ndim == 3 else state.sum(1, keepdims=True))
            if keep is not None:
                keep[:, t] = state
        return state

    def _backward(self, state: np.ndarray, keep: np.ndarray | None) -> np.ndarray:
        for t in range(self.length - 1, -1, -1):
            if keep is not None:
                keep[:, t] = state
            shape = (-1, *[1] * (state.ndim - 1))
            told = state * (self.emit[:, t] if state.ndim == 2 else self.emit[:, t, None])
            moved = np.where(self.cut[:, t].reshape(shape), (told @ self.begin)[..., None], told @ self.trans.T)
            state = np.where(self.idle[:, t].reshape(shape), state, moved)
            state = state / (state.sum((1, 2), keepdims=True) if state.ndim == 3 else state.sum(1, keepdims=True))
        return state

    def _transfers(self, way: int) -> np.ndarray:
        if self.through[way] is None:
            unit = np.broadcast_to(np.eye(self.n), (self.lanes, self.n, self.n))
            self.through[way] = (self._forward, self._backward)[way](unit, None)
        return self.through[way]

    def ahead(self, state: np.ndarray) -> np.ndarray:
        """The state before each lane, and after the last one."""
        out = [state]
        for one in self._transfers(0):
            out.append(_normed(out[-1] @ one))
        return np.array(out)

    def behind(self, state: np.ndarray) -> np.ndarray:
        """What comes after says of the state before each lane, and after the last one."""
        out = [state]
        for one in self._transfers(1)[::-1]:
            out.append(_normed(out[-1] @ one))
        return np.array(out[::-1])

    def posteriors(self, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
        alpha, beta = (np.empty((self.lanes, self.length, self.n)) for _ in range(2))
        self._forward(self.ahead(enter)[:-1], alpha)
        self._backward(self.behind(leave)[1:], beta)
        return _normed(alpha * beta).reshape(-1, self.n)[: self.total]


class Chain:
    def __init__(self, langs: list[str]):
        n = len(langs)
        self.langs = langs
        self.grams = np.zeros((3, 1 << BITS, n), np.float32)
        self.lexicon = np.zeros((1 << BITS, n), np.float32)
        self.step, self.start = np.eye(n), np.zeros(n)

    def emissions(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        code, starts, ends, first, own = word_features(texts)
        score, size = self.lexicon[own].astype(np.float64), len(code) - 3
        row, room = 0, max(1 << 14, ROOM // max(len(self.langs), 1))
        while row < len(starts):
            stop = max(row + 1, int(np.searchsorted(ends, starts[row] + room, "right")))
            low = int(starts[row])
            part = code[low : min(int(ends[stop - 1]) + 2, size) + 3]
            a, b = starts[row:stop], ends[row:stop]
            for k, n in enumerate((2, 3, 4)):
                total = np.zeros((len(part) - 2, len(self.langs)))
                np.cumsum(self.grams[k][_grams(part, n)], axis=0, out=total[1:], dtype=np.float64)
                # the n-gram at byte i covers bytes i - 1 to i + n - 2: from the first affix to the one over the end
                score[row:stop] += total[np.maximum(np.minimum(b + 3 - n, size), a + 1) - low] - total[a - low]
            row = stop
        return score, first

    def posteriors(self, score: np.ndarray, restart: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        """Probabilities of each word's language; ``restart`` marks first words of documents."""
        total, n = score.shape
        if not total:
            return score
        trans, begin = np.exp(self.step - self.step.max()), np.exp(self.start - self.start.max())
        begin = begin / begin.sum()
        cut = [slice(a, min(a + segment, total)) for a in range(0, total, segment)]
        lanes = lambda at: _Lanes(score[at], restart[at], trans, begin)
        enter = [begin]
        for at in cut[:-1]:
            enter.append(lanes(at).ahead(enter[-1])[-1])
        out, leave = np.empty_like(score), np.ones(n)
        for at, state in zip(cut[::-1], enter[::-1], strict=True):
            own = lanes(at)
            out[at] = own.posteriors(state, leave)
            leave = own.behind(leave)[0]
        return out

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of every word, and each row's first word."""
        score, first = self.emissions(texts)
        restart = np.zeros(len(score), bool)
        restart[first[:-1][np.diff(first) > 0]] = True
        return self.posteriors(score, restart), first

    def label(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        post, first = self.words(texts)
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(post, 0)])
        share = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None]
        best = share.argmax(1)
        data, at = text_buffer(texts)
        plain = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
        none = plain[at[1:]] == plain[at[:-1]]
        for row in np.flatnonzero(none):
            none[row] = not any(c.isalpha() for c in texts[row].as_py() or "")
        return ["und" if e else self.langs[b] for e, b in zip(none, best, strict=True)], np.where(none, 0.0, np.clip(share.max(1), 0, 1))


def fit(texts: list[str], langs: list[str], seed: int = 11) -> Chain:
    """AdaGrad on the log-likelihood of spliced word sequences."""
    code, starts, ends, first, own = word_features(pa.array(texts, pa.large_string()))
    worded = [(i, lang) for i, lang in enumerate(langs) if first[i + 1] > first[i]]
    names = sorted({lang for _, lang in worded})
    model = Chain(names)
    if len(names) < 2:
        return model
    n, rng = len(names), np.random.default_rng(seed)
    grams = [_grams(code, k).astype(np.int64) for k in (2, 3, 4)]
    by = [[i for i, lang in worded if lang == name] for name in names]
    squares = [np.full_like(model.grams[0], 1e-8) for _ in range(3)] + [np.full_like(model.lexicon, 1e-8), np.full((n, n), 1e-8)]
    lanes = 48
    for step in range(STEPS):
        picked, gold = [], []
        while len(picked) < lanes * SPAN:
            k = int(rng.integers(n))
            doc = by[k][int(rng.integers(len(by[k])))]
            run = min(int(rng.geometric(1 / 30)), first[doc + 1] - first[doc])
            at = int(rng.integers(first[doc], first[doc + 1] - run + 1))
            picked += range(at, at + run)
            gold += [k] * run
        w, y = np.array(picked[: lanes * SPAN]), np.array(gold[: lanes * SPAN])
        spans = [(starts[w], np.maximum(np.minimum(ends[w] + 3 - k, len(code) - 3), starts[w] + 1)) for k in (2, 3, 4)]
        flats = []
        score = model.lexicon[own[w]].astype(np.float64)
        for k, (a, b) in enumerate(spans):
            size = b - a
            row = np.repeat(np.arange(len(w)), size)
            bucket = grams[k][np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())]
            flats.append((row, bucket))
            for c in range(n):
                score[:, c] += np.bincount(row, model.grams[k][bucket, c], len(w))
        score, y2 = score.reshape(lanes, SPAN, n), y.reshape(lanes, SPAN)
        emit, trans = np.exp(np.maximum(score - score.max(2, keepdims=True), -50)), np.exp(model.step - model.step.max())
        alpha, beta = np.empty_like(emit), np.ones_like(emit)
        state = np.full((lanes, n), 1 / n)
        for t in range(SPAN):
            state = (state @ trans if t else state) * emit[:, t]
            state /= state.sum(1, keepdims=True)
            alpha[:, t] = state
        for t in range(SPAN - 1, 0, -1):
            back = (beta[:, t] * emit[:, t]) @ trans.T
            beta[:, t - 1] = back / back.sum(1, keepdims=True)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        pair = alpha[:, :-1, :, None] * trans * (emit * beta)[:, 1:, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        moved = np.zeros((n, n))
        np.add.at(moved, (y2[:, :-1].ravel(), y2[:, 1:].ravel()), 1)
        error = (np.eye(n)[y] - post.reshape(-1, n)) / lanes
        updates = [(row, bucket, model.grams[k], squares[k]) for k, (row, bucket) in enumerate(flats)] + [(np.arange(len(w)), own[w], model.lexicon, squares[3])]
        for row, bucket, weights, square in updates:
            seen, place = np.unique(bucket, return_inverse=True)
            g = np.stack([np.bincount(place, error[row, c], len(seen)) for c in range(n)], 1) - 1e-3 * weights[seen]
            square[seen] += g * g
            weights[seen] += 0.2 * g / np.sqrt(square[seen])
        g = (moved - pair.sum((0, 1))) / lanes
        squares[4] += g * g
        model.step += 0.1 * g / np.sqrt(squares[4])
    return model


def remainder(doc_id, parts: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def train(docs: DataFrame, fold: int = 2, parts: int = 4, per_lang: int = PER_LANG) -> Chain:
    """Fit on documents outside the fold that hold a word. Counts per language cover all rows; texts come from a hash sample."""
    text = whole_or_pieces("text", LONGEST_FIT)
    learnt = F.coalesce(remainder(F.col("doc_id"), parts) != fold, F.lit(True)) & F.col("lang").isNotNull()
    key = F.xxhash64(F.lit("langid"), "doc_id", "text")
    known = docs.where(learnt).select("lang", key.alias("h"), text.alias("text")).where(F.col("text").rlike(r"[A-Za-z\x{80}-\x{10FFFF}]"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    chance = counts.select("lang", F.least(F.lit(1.0), 1.5 * per_lang / F.col("n")).alias("chance"))
    if chance.count() <= MOST_SENT:
        chance = F.broadcast(chance)
    drawn = known.join(chance, "lang").where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < F.col("chance"))
    # equal rows count once; the draw leaves about 1.5 * per_lang rows a language to be ranked
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    once = drawn.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = once.withColumn("k", rank).where(F.col("k") <= per_lang).orderBy("lang", "k").collect()
    return fit([r.text for r in rows], [r.lang for r in rows])


def predict(docs: DataFrame, model: Chain, fold: int = 2, parts: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    room = max(1 << 16, ROOM // max(4, len(model.langs)))

    def labelled(batches):
        for batch in batches:
            for part in slices(batch, "text", room):
                names, share = sent.value.label(part.column("text"))
                yield pa.record_batch([id_column(int_ids(part.column("doc_id"))), pa.array(names, pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    made = docs.select("doc_id", "text").mapInArrow(labelled, "doc_id long, lang_pred string, score double")
    return made.select("doc_id", F.coalesce(remainder(F.col("doc_id"), parts) == fold, F.lit(False)).alias("held_out"), "lang_pred", "score")
