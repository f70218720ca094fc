"""Toxicity scores from a convolutional text classifier in numpy.

Words (runs of letters, A-Z lower-cased) are hashed into ``BUCKETS`` buckets; the ``MOST_ROWS`` buckets that tell the
classes apart best in the fitted sample have embeddings of their own, all others share the zero vector. Filters of widths 1, 2 and 3 slide over
a document's words, each filter's maximum over the document is one feature, and a linear layer turns the features into
a logit. At scoring time embedding and filter collapse into one table per filter position, so a document costs a few
table look-ups a word. The logit is shifted by a threshold calibrated per language, where the language is guessed from
function words in the text itself; the score is the logistic of what is left, so 0.5 is the calibrated cut.

The model is fitted on at most ``MOST_FIT`` labelled documents of each class, taken in the order of a hash of doc_id
(texts over ``LONGEST_FIT`` characters give pieces from all over; an id that repeats gives one text). The thresholds come from all labelled documents outside the
held-out fold: their logits are counted by language, class and bin, and those that were not fitted on stand, class by
class, for as many as the tables hold. Scoring covers every document and its whole text.

Null texts count as empty; texts without letters have zero features and get the bias' score. Rows with null or unknown
label are not learned from; of several labels for one id the highest counts; with labels of one class only, all scores
are the smoothed rate of that class. A null id is not held out and has no label. Repeated rows are scored alike, very
long texts are scored whole, extra columns are ignored by ``score`` and kept by ``keep_clean``, an empty table gives no
rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_LETTERS, id_column, int_ids, release, slices, small_batches, text_buffer, trimmed, whole_or_pieces, word_hashes, word_spans

BUCKETS = 1 << 20
MOST_ROWS = 1 << 13
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
MOST_FIT = 1500
#: Characters of a text that are learned from.
LONGEST_FIT = 100_000
STEPS = 700
#: Logits are counted in bins of this width, up to so far from 0.
BIN = 1 / 64
FARTHEST = 40
#: Labelled ids up to which they are sent to every executor (8 bytes each); beyond it every document is scored.
MOST_SENT = 4_000_000
#: Function words of the languages whose thresholds are told apart.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht von den ein eine zu mit sich auf für",
    "en": "the of and to in is that was for on with as it are this",
    "es": "el los las del que una por con para es su se al como más",
    "fr": "le les des du est une dans que pour qui sur pas au avec par",
}


def _word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each row's first word."""
    data, at = text_buffer(texts)
    starts, ends = word_spans(data, at, NOT_LETTERS)
    return word_hashes(data, starts, ends), np.searchsorted(starts, at)


_LANGS = sorted(FUNCTION_WORDS)
_KNOWN, _OWNER = None, None


def languages(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of the language with most function words in each row; rows without any get the number of languages."""
    global _KNOWN, _OWNER
    if _KNOWN is None:
        keys = [(int(_word_ids(pa.array([w]))[0][0]), k) for k, lang in enumerate(_LANGS) for w in FUNCTION_WORDS[lang].split()]
        order = np.argsort(np.array([h for h, _ in keys], np.uint64))
        _KNOWN, _OWNER = np.array([h for h, _ in keys], np.uint64)[order], np.array([k for _, k in keys])[order]
    place = np.minimum(np.searchsorted(_KNOWN, words), len(_KNOWN) - 1)
    hit = np.flatnonzero(_KNOWN[place] == words)
    row = np.searchsorted(first, hit, "right") - 1
    counts = np.bincount(row * len(_LANGS) + _OWNER[place[hit]], minlength=(len(first) - 1) * len(_LANGS)).reshape(-1, len(_LANGS))
    return np.where(counts.sum(1) > 0, counts.argmax(1), len(_LANGS))


class Classifier:
    """Embeddings, filters and output layer; ``tables`` for scoring."""

    def __init__(self, rate: float):
        self.bias, self.out = float(np.log(rate / (1 - rate))), np.zeros(len(WIDTHS) * FILTERS)
        self.slots = np.zeros(BUCKETS, np.int32)  # row of the embeddings; row 0 is the zero vector
        self.embed, self.filters, self.shift = np.zeros((1, SIZE)), [np.zeros((w, SIZE, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS]
        self.thresholds = np.zeros(len(_LANGS) + 1)
        self.collapse()

    def collapse(self) -> None:
        self.tables = [[np.ascontiguousarray(self.embed @ f[k], np.float32) for k in range(len(f))] for f in self.filters]

    def features(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        rows, n = len(first) - 1, np.diff(first)
        pad = max(WIDTHS) - 1
        stream = np.zeros(len(words) + rows * pad, np.int64)
        begin = first[:-1] + np.arange(rows) * pad
        stream[np.arange(len(words)) + np.repeat(np.arange(rows) * pad, n)] = self.slots[words % np.uint64(BUCKETS)]
        out, full = np.zeros((rows, len(WIDTHS) * FILTERS), np.float32), np.flatnonzero(n)
        if full.size:
            cuts = np.stack([begin[full], begin[full] + n[full]], 1).ravel()
            for i, tables in enumerate(self.tables):
                conv = tables[0][stream]
                for k in range(1, len(tables)):
                    conv[:-k] += tables[k][stream[k:]]
                top = np.maximum.reduceat(conv, cuts, axis=0)[::2]  # padding follows the last document as well
                out[full, i * FILTERS : (i + 1) * FILTERS] = np.maximum(top + self.shift[i].astype(np.float32), 0)
        return out

    def logits(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.features(words, first) @ self.out + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        words, first = _word_ids(texts)
        z = self.logits(words, first) - self.thresholds[languages(words, first)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(params: list[np.ndarray]):
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    def step(grads: list[np.ndarray], t: int, rate: float) -> None:
        for p, g, (m, v) in zip(params, grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    return step


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Classifier:
    """Train on texts with 0/1 labels; the first column of the embeddings starts as each bucket's log-odds z."""
    labels = np.asarray(labels, float)
    model = Classifier((labels.sum() + 1) / (len(labels) + 2))
    if not len(labels) or labels.min() == labels.max():
        return model
    rng = np.random.default_rng(seed)
    words, first = _word_ids(pa.array(texts, pa.large_string()))
    ids = (words % np.uint64(BUCKETS)).astype(np.int64)
    docs = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    held = np.arange(len(docs)) % 5 == 4
    train = np.flatnonzero(~held)
    if labels[train].min() == labels[train].max():
        train = np.arange(len(docs))
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i in train:
        seen = np.unique(docs[i])
        (pos if labels[i] else neg)[seen] += 1
    n_pos, n_neg = labels[train].sum(), (1 - labels[train]).sum()
    z = (np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    told = np.argsort(-np.where(pos + neg >= 2, np.abs(z), 0), kind="stable")[:MOST_ROWS]
    told = told[(pos[told] + neg[told] >= 2) & (np.abs(z[told]) > 1.5)]
    model.slots[told] = np.arange(1, len(told) + 1)
    docs = [model.slots[d].astype(np.int64) for d in docs]
    embed = model.embed = np.concatenate([np.zeros((1, SIZE)), rng.normal(0, 0.05, (len(told), SIZE))])
    embed[1:, 0] = np.where(np.abs(z[told]) > 2, np.clip(z[told], -6, 6) / 3, 0)
    for i, w in enumerate(WIDTHS):
        model.filters[i] = rng.normal(0, 0.15, (w, SIZE, FILTERS))
        model.filters[i][0, 0] = np.abs(model.filters[i][0, 0]) + 0.5
    model.out = np.full(len(WIDTHS) * FILTERS, 0.2) + rng.normal(0, 0.05, len(WIDTHS) * FILTERS)
    bias = np.array([model.bias - 0.5])
    params = [embed, *model.filters, *model.shift, model.out, bias]
    step = _adam(params)
    weight = np.where(labels > 0, len(train) / (2 * n_pos), len(train) / (2 * n_neg)) ** 0.5
    batch = 24
    for t in range(1, STEPS + 1):
        rows = rng.choice(train, min(batch, len(train)), replace=False)
        grads = [np.zeros_like(p) for p in params]
        for i in rows:
            own = docs[i]
            if not len(own):
                continue
            padded = np.append(own, [0] * (max(WIDTHS) - 1))
            x = embed[padded]
            peaks, feats = [], []
            for k, w in enumerate(WIDTHS):
                conv = sum(x[j : j + len(own)] @ model.filters[k][j] for j in range(w))
                peak = conv.argmax(0)
                peaks.append(peak)
                feats.append(conv[peak, np.arange(FILTERS)] + model.shift[k])
            h = np.concatenate(feats)
            relu = np.maximum(h, 0)
            drop = (rng.random(len(h)) > 0.2) / 0.8
            error = (1 / (1 + np.exp(-(relu * drop @ model.out + bias[0]))) - labels[i]) * weight[i] / len(rows)
            grads[-2] += error * relu * drop
            grads[-1] += error
            back = error * model.out * drop * (h > 0)
            for k, w in enumerate(WIDTHS):
                g = back[k * FILTERS : (k + 1) * FILTERS]
                grads[1 + len(WIDTHS) + k] += g
                for j in range(w):
                    at = padded[peaks[k] + j]
                    np.add.at(grads[0], at, g[:, None] * model.filters[k][j].T)
                    grads[1 + k][j] += embed[at].T * g
        for p, g in zip(params[1:-1], grads[1:-1], strict=True):
            g += 1e-3 * p
        grads[0][0] = 0
        step(grads, t, 0.01 if t < STEPS * 0.7 else 0.003)
    model.bias = float(bias[0])
    model.collapse()
    _calibrate(model, words, first, labels, held)
    return model


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The midpoint between neighbouring different logits with the best F1; never below all of them."""
    order = np.argsort(-z)
    z, y = z[order], y[order]
    ends = np.flatnonzero(z[:-1] > z[1:])
    if not len(ends):
        return float(z[0]) + 1
    f1 = 2 * np.cumsum(y)[ends] / (ends + 1 + y.sum())
    best = ends[int(f1.argmax())]
    return float((z[best] + z[best + 1]) / 2)


def _calibrate(model: Classifier, words: np.ndarray, first: np.ndarray, labels: np.ndarray, held: np.ndarray, least: int = 25) -> None:
    """One cut per language from the documents kept from fitting; languages with few toxic ones take the common cut.

    Where the documents kept hold few toxic ones at all, the cut comes from all, and above a text without evidence."""
    z, lang = model.logits(words, first), languages(words, first)
    few = labels[held].sum() < least
    rows = np.ones(len(labels), bool) if few else held
    cut = _best_cut(z[rows], labels[rows])
    if few:
        plain = float(np.concatenate([np.maximum(s, 0) for s in model.shift]) @ model.out + model.bias)
        cut = max(cut, plain + 0.1, model.bias + 0.1)
    model.thresholds[:] = cut
    for k in range(len(_LANGS)):
        own = rows & (lang == k)
        if labels[own].sum() >= least and labels[own].sum() < own.sum():
            model.thresholds[k] = _best_cut(z[own], labels[own])


def _best_bin(counts: np.ndarray) -> float:
    """As ``_best_cut`` over (2, bins) weights of clean and toxic documents; the lowest bin is the first."""
    used = np.flatnonzero(counts.sum(0) > 0)[::-1]
    clean, toxic = counts[:, used]
    middle = (used + 0.5) * BIN - FARTHEST
    if len(used) < 2:
        return float(middle[0]) + 1
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(clean + toxic) + toxic.sum())
    best = int(f1[:-1].argmax())
    return float((middle[best] + middle[best + 1]) / 2)


def recalibrate(model: Classifier, counts: np.ndarray, least: int = 25) -> None:
    """Cuts from logit counts by (language, class, fitted on or not, bin) of all labelled documents.

    Documents not fitted on are weighted to the class counts of all. Where they hold under ``least`` toxic ones, all
    documents count, and the cut is above a text without evidence."""
    every = counts.sum(2).astype(float)
    total, fresh = every.sum(2), counts[:, :, 0].astype(float)
    if not total.sum(0).all():
        return
    few = fresh[:, 1].sum() < least or not fresh[:, 0].any()
    used = every if few else fresh
    cut = _best_bin(used.sum(0) * (total.sum(0) / used.sum((0, 2)))[:, None])
    if few:
        plain = float(np.concatenate([np.maximum(s, 0) for s in model.shift]) @ model.out + model.bias)
        cut = max(cut, plain + 0.1, model.bias + 0.1)
    model.thresholds[:] = cut
    for k in range(len(_LANGS)):
        own = used[k].sum(1)
        if own[1] >= least and own[0]:
            model.thresholds[k] = _best_bin(used[k] * (total[k] / own)[:, None])


def logit_counts(docs: DataFrame, known: DataFrame, model: Classifier, fitted: np.ndarray) -> np.ndarray:
    """How many documents with a label each (language, class, fitted on or not, bin) has; ``known`` has doc_id, toxic."""
    small_batches(docs.sparkSession)
    if known.count() <= MOST_SENT:
        docs = docs.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    sent = docs.sparkSession.sparkContext.broadcast((model.slots, model.tables, model.shift, model.out, model.bias, np.sort(fitted)))
    bins = int(2 * FARTHEST / BIN)

    def binned(batches):
        own = Classifier.__new__(Classifier)
        own.slots, own.tables, own.shift, own.out, own.bias, learned = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                words, first = _word_ids(part.column("text"))
                z = np.clip((own.logits(words, first) + FARTHEST) / BIN, 0, bins - 1)
                ids = id_column(int_ids(part.column("doc_id")))
                learnt = pa.compute.is_in(ids, value_set=pa.array(learned, pa.int64()))
                yield pa.record_batch([ids, pa.array(languages(words, first).astype(np.int32)), learnt, pa.array(z.astype(np.int32))], ["doc_id", "lang", "fitted", "bin"])

    made = docs.select("doc_id", "text").mapInArrow(trimmed(binned), "doc_id long, lang int, fitted boolean, bin int")
    out = np.zeros((len(_LANGS) + 1, 2, 2, bins), np.int64)
    for r in made.join(known, "doc_id").groupBy("lang", "toxic", "fitted", "bin").count().collect():
        out[r["lang"], int(r["toxic"]), int(r["fitted"]), r["bin"]] = r["count"]
    return out


def remainder(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def labelled(labels: DataFrame, parts: int = 5) -> DataFrame:
    """doc_id, toxic of the labelled ids outside the held-out fold."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.where(remainder(F.col("doc_id"), parts) != 0)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_FIT, parts: int = 5) -> DataFrame:
    """doc_id, text, toxic of at most ``most`` documents of each class outside the held-out fold."""
    known = labelled(labels, parts)
    chosen = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in (0, 1)]
    # at most 2 * most rows of two numbers
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    found = docs.select("doc_id", whole_or_pieces("text", LONGEST_FIT).alias("text")).join(ids, "doc_id")
    # of the rows of a repeated id the one whose text's hash is the smallest
    return found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_FIT, parts: int = 5) -> Classifier:
    rows = labelled_sample(docs, labels, most, parts).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text or ""))
    classes = np.array([r.toxic for r in rows])
    model = fit([r.text or "" for r in rows], classes)
    # those that fit keeps from fitting are every fifth
    fitted = np.array([r.doc_id for k, r in enumerate(rows) if k % 5 != 4], np.int64)
    del rows
    release()
    if len(set(classes.tolist())) == 2:
        recalibrate(model, logit_counts(docs, labelled(labels, parts), model, fitted))
    return model


def score(docs: DataFrame, model: Classifier, parts: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model.slots, model.tables, model.shift, model.out, model.bias, model.thresholds))

    def scored(batches):
        own = Classifier.__new__(Classifier)
        own.slots, own.tables, own.shift, own.out, own.bias, own.thresholds = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([id_column(int_ids(part.column("doc_id"))), pa.array(own.scores(part.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(scored), "doc_id long, score double").select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), parts) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, model: Classifier) -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores under 0.5."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model.slots, model.tables, model.shift, model.out, model.bias, model.thresholds))

    def kept(batches):
        own = Classifier.__new__(Classifier)
        own.slots, own.tables, own.shift, own.out, own.bias, own.thresholds = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(own.scores(part.column("text")) < 0.5))

    return docs.mapInArrow(trimmed(kept), docs.schema)
