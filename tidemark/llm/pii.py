"""Personal data by exact patterns and a skip-chain conditional random field.

The base patterns give spans of kind email, ip, card and phone. Other digit runs, the numbers inside them, spelt-out
addresses and words equal to the local part of an address are candidates. All mentions of a document form one graph:
neighbours in the text are chained; mentions of one key (digits, or local part), however far apart and however many, are
joined by skip edges to a node that stands for the entity, which a base span among them fixes; entities with similar
keys (one digit changed, or the same last seven) are joined as well. Loopy sum-product messages over all edges of a
batch make the labels of repeated entities agree; a candidate whose strongest label is a kind becomes a further span,
the longest, then the surest one where they overlap. Base spans always stay.

Weights of shape features, of neighbouring labels and of both sorts of skip edges are fitted together: gradient ascent
on the pseudo-likelihood, each mention given the labels of the others, and given its shape alone. Labels are those of the base patterns; a
candidate with the key of a base span has that one's kind, others none; numbers inside a longer run that no base span
repeats are unknown and not learned from.

The model is fitted on at most ``MOST_FIT`` different texts with digits, chosen by a hash of the text, of which texts
over ``LONGEST_FIT`` characters give pieces from all over; every document is searched over its whole text, in time
linear in its length. Null and empty texts have no spans. Repeated rows get equal results; null ids are kept; extra
columns are ignored by ``find`` and kept, whatever their names, by ``redact``. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, trimmed, whole_or_pieces

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = len(KINDS) + 1
MOST_FIT = 3000
#: Characters of a text that are learned from.
LONGEST_FIT = 100_000
NEAR = 40
ROUNDS = 40
#: Log weight of a label that is given, whatever others say; of agreement with the entity, and with a similar entity, before any evidence.
GIVEN, SAME, SIMILAR = 1e6, 8.0, 2.0
PULL = 1e-3
STEPS = 300

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
# a match can't begin inside a run of digits, and no part can give back digits, so possessive runs find the same spans
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# digits with up to two separators between them; no part can give back, so a search is linear
_RUN = re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){4,}+")
_PART = re.compile(r"[0-9]+")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_AT = re.compile(r"[\[(](?:at|AT)[\])]")
_HOST = re.compile(r" ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++")
_WORD = re.compile(r"[A-Za-z0-9._%+-]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d if (d := 2 * int(c)) < 10 else d - 9 for c in digits[-2::-2])) % 10 == 0


def _emails(text: str):
    at, past = text.find("@"), 0
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            past = found.end()
        at = text.find("@", max(at + 1, past))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    spans = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            spans.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


def _spelt(text: str):
    """(start, end, local part) of addresses like ``name (at) host [dot] com``: from each bracket backwards and forwards."""
    past = 0
    for m in _AT.finditer(text):
        end = m.start() - (text[m.start() - 1 : m.start()] == " ")
        start = end
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, m.end()) if start < end else None
        if host:
            yield start, host.end(), text[start:end].lower()
        past = host.end() if host else m.end()


def _digits_key(piece: str) -> tuple:
    if _QUAD.fullmatch(piece):
        return ("i", ".".join(x.lstrip("0") or "0" for x in piece.split(".")))
    digits = re.sub(r"[^0-9]", "", piece)
    return ("d", digits[-10:] if 10 <= len(digits) <= 15 else digits)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, tuple, bool]]:
    """(start, end, kind, key, inner) in order of place; ``inner`` marks a number inside a longer run.

    A candidate that overlaps a base span is left out."""
    found = [(a, b, k, ("a", text[a:b].split("@")[0].lower()) if k == 0 else _digits_key(text[a:b]), False) for k, a, b in base]
    more = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        more.append((a, b, OTHER, _digits_key(m[0]), False))
        parts = [(x + a, y + a) for x, y in (p.span() for p in _PART.finditer(m[0]))]
        more += [(x, y, OTHER, _digits_key(text[x:y]), True) for x, y in parts if y - x >= 7 and y - x < b - a]
        if len(parts) > 4:
            four = [y - x == 4 for x, y in parts]
            more += [(parts[i][0], parts[i + 3][1], OTHER, _digits_key(text[parts[i][0] : parts[i + 3][1]]), True) for i in range(len(parts) - 3) if all(four[i : i + 4])]
    more += [(a, b, OTHER, ("a", local), False) for a, b, local in _spelt(text)]
    locals_ = {key[1] for _, _, k, key, _ in found if k == 0 and len(key[1]) >= 5}
    if locals_:
        for m in _WORD.finditer(text):
            word = m[0].rstrip(".%+-_")
            if word.lower() in locals_:
                more.append((m.start(), m.start() + len(word), OTHER, ("a", word.lower()), False))
    if more and found:
        edges = sorted((a, b) for a, b, *_ in found)
        starts, last = np.array([a for a, _ in edges]), np.maximum.accumulate([b for _, b in edges])
        more = [x for x in more if (k := int(np.searchsorted(starts, x[1]))) == 0 or last[k - 1] <= x[0]]
    return sorted(found + more)


FEATURES = 24


def _shape(text: str, a: int, b: int) -> list[int]:
    piece = text[a:b]
    plain = re.sub(r"[^0-9]", "", piece)
    digits, quad = len(plain), piece.count(".") == 3
    flags = [digits == 0, 0 < digits < 7, 7 <= digits < 10, 10 <= digits < 12, 12 <= digits < 16, 16 <= digits < 20, digits >= 20]
    flags += ["@" in piece, piece[:1] == "+", piece[:1] == "(", ")" in piece, "-" in piece, " " in piece, quad, 0 < piece.count(".") < 3]
    flags += [len(piece) > 2 * digits, len(piece) == digits, "(" in piece[1:], piece[:1] == "0", 16 <= digits < 20 and luhn(plain)]
    flags += [quad and bool(_QUAD.fullmatch(piece)) and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in piece.split("."))]
    flags += [text[a - 1 : a].isalnum() if a else False, text[b : b + 1].isalnum()]
    return [k for k, on in enumerate(flags) if on]


def _similar(keys: list[tuple], fixed: set[int]) -> list[tuple[int, int]]:
    """Pairs of places in ``keys`` of numbers that differ in one digit or end in the same seven.

    Keys that share a shortened form meet in a bucket, where each is paired with the first one, a ``fixed`` one if any."""
    buckets: dict[tuple, list[int]] = {}
    for n, (sort, key) in enumerate(keys):
        if sort == "d" and len(key) >= 7:
            buckets.setdefault(("end", key[-7:]), []).append(n)
            if 12 <= len(key) <= 40:
                for i in range(len(key)):
                    buckets.setdefault((i, len(key), key[:i] + key[i + 1 :]), []).append(n)
    found = set()
    for own in buckets.values():
        if len(own) > 1:
            head = next((n for n in own if n in fixed), own[0])
            found |= {(min(head, n), max(head, n)) for n in own if n != head}
    return sorted(found)


class Graph:
    """Mentions of many documents, the entities they name, and the edges between them.

    ``every``: also the mentions of documents without candidates, which only training needs. Entities with one mention
    and no similar entity are left out. ``skip`` joins mention and entity, ``like`` two entities."""

    def __init__(self, texts: list[str], every: bool = False):
        self.doc, self.kind, self.start, self.end, self.shape, self.inner = [], [], [], [], [], []
        self.base: list[list[tuple[int, int, int]]] = []
        chain, skip, like, given = [], [], [], []
        for row, text in enumerate(texts):
            own = base_spans(text) if text else []
            self.base.append(own)
            met = mentions(text, own) if text else []
            if not met or not (every or len(met) > len(own)):
                continue
            first, by_key = len(self.doc), {}
            for n, (a, b, k, key, inner) in enumerate(met):
                self.doc.append(row)
                self.kind.append(k)
                self.start.append(a)
                self.end.append(b)
                self.shape.append(_shape(text, a, b))
                self.inner.append(inner)
                by_key.setdefault(key, []).append(first + n)
                if n and met[n - 1][1] <= a <= met[n - 1][1] + NEAR:
                    chain.append((first + n - 1, first + n))
            keys = list(by_key)
            kinds = [[self.kind[m] for m in by_key[key] if self.kind[m] < OTHER] for key in keys]
            alike = _similar(keys, {n for n, k in enumerate(kinds) if k})
            entity: dict[int, int] = {}
            for n in sorted({n for n, key in enumerate(keys) if len(by_key[key]) > 1} | {n for pair in alike for n in pair}):
                entity[n] = len(given)
                given.append(max(sorted(set(kinds[n])), key=kinds[n].count) if kinds[n] else OTHER)
                skip += [(m, entity[n]) for m in by_key[keys[n]]]
            like += [(entity[x], entity[y]) for x, y in alike]
        pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
        self.kind, self.inner, self.given = np.array(self.kind, np.int64), np.array(self.inner, bool), np.array(given, np.int64)
        self.chain, self.skip, self.like = pairs(chain), pairs(skip), pairs(like)

    def features(self) -> np.ndarray:
        x = np.zeros((len(self.doc), FEATURES))
        for row, on in enumerate(self.shape):
            x[row, on] = 1
        x[:, -1] = 1
        return x


def sum_product(local: np.ndarray, edges: np.ndarray, pots: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals of every node from log weights ``local`` and log potentials ``pots`` of ``edges`` (first end by rows).

    Messages go along all edges in both directions at once, damped by half; exact where the edges form a forest."""
    labels, logs = local.shape[1], local - local.max(1, keepdims=True)
    if not len(edges):
        return np.exp(logs) / np.exp(logs).sum(1, keepdims=True)
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pots = np.exp(np.concatenate([pots, pots.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message, total = np.full((len(source), labels), 1 / labels), np.empty_like(logs)

    def gathered() -> np.ndarray:
        told = np.log(message)
        for c in range(labels):
            total[:, c] = np.bincount(target, told[:, c], len(local))
        total[:] += logs
        return told

    for _ in range(rounds):
        out = -gathered()[back] + total[source]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.einsum("ea,eab->eb", out, pots)
        new = 0.5 * message + 0.5 * new / new.sum(1, keepdims=True)
        moved, message = np.abs(new - message).max(), np.maximum(new, 1e-300)
        if moved < 1e-9:
            break
    gathered()
    belief = np.exp(total - total.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True)


class Field:
    """Weights of features (``node``), of neighbours (``chain``: left by right), of an entity and its mention (``skip``)
    and of similar entities (``like``)."""

    def __init__(self):
        self.node = np.zeros((FEATURES, LABELS))
        self.node[-1, OTHER] = 2.0
        self.chain, self.skip, self.like = np.zeros((LABELS, LABELS)), SAME * np.eye(LABELS), SIMILAR * np.eye(LABELS)

    def system(self, graph: Graph) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log weights of mentions and entities, edges between them, and the edges' log potentials."""
        mention, entity = graph.features() @ self.node, np.zeros((len(graph.given), LABELS))
        for rows, kinds in ((mention, graph.kind), (entity, graph.given)):
            fixed = kinds < OTHER
            rows[fixed] = np.eye(LABELS)[kinds[fixed]] * GIVEN
        n, own = len(mention), np.array([[0, 1]])
        edges = np.concatenate([graph.chain, graph.skip + n * own, graph.like + n])
        parts = zip((self.chain, self.skip, self.like), map(len, (graph.chain, graph.skip, graph.like)), strict=True)
        return np.concatenate([mention, entity]), edges, np.concatenate([np.broadcast_to(w, (k, LABELS, LABELS)) for w, k in parts])

    def beliefs(self, graph: Graph) -> np.ndarray:
        return sum_product(*self.system(graph))[: len(graph.doc)]

    def spans(self, texts: list[str]) -> tuple[list[list], list[list]]:
        """Base spans and all spans of each text, each by kind and start."""
        graph = Graph(texts)
        added: dict[int, list] = {}
        if len(graph.doc):
            belief = self.beliefs(graph)
            best = belief.argmax(1)
            for i in np.flatnonzero((graph.kind == OTHER) & (best < OTHER)).tolist():
                added.setdefault(graph.doc[i], []).append((graph.start[i] - graph.end[i], -belief[i, best[i]].round(6), graph.start[i], graph.end[i], int(best[i])))
        every = []
        for row, base in enumerate(graph.base):
            taken: list[tuple[int, int, int]] = []
            held = np.zeros(0, np.int64)
            for _, _, a, b, k in sorted(added.get(row, ())):
                at = int(np.searchsorted(held, a, "right"))
                if at % 2 == 0 and (at == len(held) or held[at] >= b):
                    held = np.insert(held, at, (a, b))
                    taken.append((k, a, b))
            every.append(sorted(base + taken))
        return graph.base, every


def fit(texts: list[str], steps: int = STEPS) -> Field:
    """Gradient ascent (AdaGrad) on the pseudo-likelihood of the distantly labelled mentions of ``texts``."""
    field, graph = Field(), Graph(texts, True)
    n = len(graph.doc)
    if not n:
        return field
    # the kind that base spans of the entity, or of a similar one, give a mention: -1 where none does. That nobody gives
    # a kind is no evidence, for it isn't known when a document is searched: there the shape has to tell.
    hub, near, gold = np.full(n, -1), np.full(n, -1), graph.kind.copy()
    counts = np.zeros((len(graph.given), LABELS), np.int64)
    for m, e in graph.skip.tolist():
        counts[e, graph.kind[m]] += 1
    alike = np.full(len(graph.given), -1)
    for x, y in graph.like.tolist():
        for e, other in ((x, y), (y, x)):
            if graph.given[other] < OTHER:
                alike[e] = graph.given[other]
    for m, e in graph.skip.tolist():
        rest = counts[e].copy()
        rest[graph.kind[m]] -= 1
        if rest[:OTHER].any():
            hub[m] = rest[:OTHER].argmax()
        if graph.kind[m] == OTHER and graph.given[e] < OTHER:
            gold[m] = graph.given[e]
        near[m] = alike[e]
    told = ~(graph.inner & (gold == OTHER))
    left, right = np.full(n, -1), np.full(n, -1)
    left[graph.chain[:, 1]], right[graph.chain[:, 0]] = gold[graph.chain[:, 0]], gold[graph.chain[:, 1]]
    unit = np.concatenate([np.eye(LABELS), np.zeros((1, LABELS))])  # row -1: nothing is said
    x, y, weight = graph.features(), np.eye(LABELS)[gold], told[:, None] / max(told.sum(), 1)
    weights = (field.node, field.chain, field.skip, field.like)
    begun = [np.zeros_like(field.node), np.zeros_like(field.chain), field.skip.copy(), field.like.copy()]
    squares = [np.full_like(w, 1e-8) for w in weights]
    alone = np.full(n, -1)
    for t in range(steps):
        # in turn with and without the labels of the others: shapes must tell on their own as well
        seen = (left, right, hub, near) if t % 2 else (alone, alone, alone, alone)
        z = x @ field.node + sum(unit[k] @ w for k, w in zip(seen, (field.chain, field.chain.T, field.skip, field.like), strict=True))
        p = np.exp(z - z.max(1, keepdims=True))
        error = (y - p / p.sum(1, keepdims=True)) * weight
        own = [unit[k].T @ error for k in seen]
        gains = (x.T @ error, own[0] + own[1].T, own[2], own[3])
        for w, gain, start, square in zip(weights, gains, begun, squares, strict=True):
            step = gain - PULL * (w - start)
            square += step * step
            w += 0.5 * step / np.sqrt(square)
    field.like = (field.like + field.like.T) / 2
    return field


def train(docs: DataFrame, most: int = MOST_FIT) -> Field:
    """Fit on the first ``most`` different texts with four digits in a row, in the order of a hash of the text."""
    key = F.xxhash64(F.lit("pii"), "text")
    rows = docs.where(F.col("text").rlike("[0-9]{4}")).select(key.alias("h"), whole_or_pieces("text", LONGEST_FIT).alias("text"))
    chosen = F.broadcast(rows.select("h").distinct().orderBy("h").limit(most))
    found = rows.join(chosen, "h", "left_semi").groupBy("h").agg(F.min("text").alias("text")).collect()
    return fit([r.text for r in sorted(found, key=lambda r: r.h)])


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans of every row.

    Counts by kind are of base spans, n_added of what the field adds, n_spans of all."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def searched(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                base, every = sent.value.spans(part.column("text").to_pylist())
                counts = [[sum(s[0] == k for s in b) for b in base] for k in range(len(KINDS))]
                yield pa.record_batch(
                    [
                        part.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts),
                        pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]), pa.array([_joined(e) for e in every], pa.string()),
                        pa.array([len(e) - len(b) for e, b in zip(every, base, strict=True)], pa.int64()), pa.array([len(e) for e in every], pa.int64()),
                    ],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(trimmed(searched), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def masked(text: str, spans: list) -> str:
    """The text with every span (overlapping ones as one) replaced by its kind in brackets."""
    out, past = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= past:
            out += [text[past:a], f"[{KINDS[k].upper()}]"]
        past = max(past, b)
    return "".join([*out, text[past:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """All rows and columns of ``docs`` with personal data masked in ``text``; ``n_chars``, if there, follows."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def replaced(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                _, every = sent.value.spans([t or "" for t in texts])
                texts = [masked(t, s) if s else t for t, s in zip(texts, every, strict=True)]
                yield part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(texts, part.schema.field("text").type))

    out = docs.mapInArrow(trimmed(replaced), docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out
