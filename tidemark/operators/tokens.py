"""Tokens, canon masks, dictionary look-ups and small text helpers."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import ABBREVIATIONS, INFLECTIONS, STOPWORDS, sql_list
from ..sources import corpus as C
from . import index as I

_PIECE = re.compile(r"[“”\".!?]|(?<![0-9a-z])[a-z]+(?:['’][a-z]+)*")

_ABBREVIATED = frozenset(ABBREVIATIONS)


def triples(text: str, collapse: bool = False) -> list[tuple[str, bool, bool]]:
    """(token, inside quotation marks, starts a sentence) for a paragraph.

    A token is inside when the last curly mark before it opens and an even number of straight ones followed, or the
    other way round. It starts a sentence when it is the first, or when the last stop since the token before it is ! or ?,
    or a full stop after no initial or abbreviation. ``collapse`` drops a word or phrase of up to three words that is said
    twice in a row."""
    made, inside, stop, quiet = [], False, "", False
    for piece in _PIECE.findall((text or "").lower()):
        if piece[0].isalpha():
            starts = not made or stop in ("!", "?") or stop == "." and not quiet
            made.append((piece.replace("’", "'"), inside, starts))
            stop, quiet = "", len(piece) == 1 or piece in _ABBREVIATED
        elif piece in (".", "!", "?"):
            stop = piece
        elif piece in "“”":
            inside = piece == "“"
        elif piece == '"':
            inside = not inside
    return [made[k] for k in said_once([w for w, _, _ in made])] if collapse else made


def said_once(words: list[str], longest: int = 3) -> list[int]:
    """Places of the words that are left when a phrase right after itself goes, the shortest first."""
    held: list[int] = []
    for k in range(len(words)):
        held.append(k)
        tail = [words[i] for i in held[-2 * longest :]]
        sizes = [n for n in range(1, longest + 1) if 2 * n <= len(tail) and tail[-n:] == tail[len(tail) - 2 * n : len(tail) - n]]
        if sizes:
            del held[-sizes[0] :]
    return held


def token_triples(paras: DataFrame, collapse: bool = False) -> DataFrame:
    """talk_id, pos, toks, quoted, starts for rows with talk_id, pos and para."""

    def made(batches):
        for batch in batches:
            flat, size = [], [0]
            for text in batch.column("para"):
                flat += triples(text.as_py(), collapse)
                size.append(len(flat))
            columns = zip(*flat, strict=True) if flat else ((), (), ())
            lists = [pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(list(c), t)) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.bool_()), strict=True)]
            yield pa.record_batch([batch.column("talk_id"), batch.column("pos"), *lists], ["talk_id", "pos", "toks", "quoted", "starts"])

    return paras.select("talk_id", "pos", "para").mapInArrow(made, "talk_id long, pos int, toks array<string>, quoted array<boolean>, starts array<boolean>")


def display(text: str, start: int, end: int, most: int = 40) -> str:
    """The original characters of tokens ``start`` to ``end``, at most ``most`` words."""
    spans = [m.span() for m in _PIECE.finditer(text.lower()) if m[0][0].isalpha()]
    own = spans[start : min(end, start + most)]
    return text[own[0][0] : own[-1][1]] if own else ""


def coverage(paras: DataFrame, shingles: DataFrame, n: int = 4) -> DataFrame:
    """talk_id, tokens, covered: tokens inside some run of n words of the canon."""
    mask = I.masked_positions(paras, shingles, n)
    return paras.join(mask, ["talk_id", "pos"], "left").groupBy("talk_id").agg(F.sum(F.size("norm")).alias("tokens"), F.sum(F.when(F.col("mask").isNull(), 0).otherwise(F.size("mask"))).alias("covered"))


def stem_candidates(word: Column) -> Column:
    """The word without 's and every form that an inflection rule gives it."""
    base = F.regexp_replace(word, "'s", "")
    forms = [F.when(base.endswith(s), F.concat(F.substring(base, F.lit(1), F.length(base) - len(s)), F.lit(r))) for s, r in INFLECTIONS]
    return F.array_distinct(F.filter(F.array(base, *forms), lambda x: x.isNotNull()))


def in_dictionary(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows of ``words`` (word) that the dictionary (word) has, as they are or inflected."""
    forms = words.select("word", F.explode(stem_candidates(F.col("word"))).alias("form"))
    return forms.join(dictionary.select(F.col("word").alias("form")), "form", "left_semi").select("word").distinct()


def unstutter(text: Column) -> Column:
    """A word or short phrase right after itself goes."""
    return F.regexp_replace(text, r"\b([a-z']+(?: [a-z']+){0,2}),? \1\b", "$1")


def tidy(text: Column) -> Column:
    """The whole sentences of a passage where they are most of it; open ends are marked with …."""
    lead = F.regexp_extract(text, r"(?s)^(.*?[.!?]”?\s+)(?=[A-Z“])", 1)
    cut = text.rlike(r"^\p{Ll}") & (lead != "") & (F.length(lead) <= 0.45 * F.length(text))
    begun = F.when(cut, F.substring(text, F.length(lead) + 1, F.length(text))).otherwise(text)
    whole = F.regexp_extract(begun, r"(?s)^(.*[.!?])", 1)
    quoted = F.regexp_extract(begun, r"(?s)^(.*)”", 1)
    ended = F.when((whole != "") & (F.length(whole) >= 0.5 * F.length(begun)), whole).when(
        F.substring(begun, -20, 20).contains("”"), F.regexp_replace(quoted, "[ ,]+$", "")
    ).otherwise(begun)
    return F.concat(F.when(ended.rlike(r"^\p{Ll}"), "… ").otherwise(""), ended, F.when(ended.rlike(r"[.!?]\z"), "").otherwise(" …"))


def _canon_words(s: SparkSession, d: str) -> DataFrame:
    return C.canon(s, d).select(F.explode("toks").alias("word")).distinct()


def one_edit(words: DataFrame, others: DataFrame) -> DataFrame:
    """word, other of the pairs (word), (other) that one letter more, less or changed sets apart.

    Such words share a form with one letter left out, or one is such a form of the other: they meet by these forms."""

    def forms(name: str) -> Column:
        w = F.col(name)
        cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return F.explode(F.array_distinct(F.concat(F.array(w), F.when(F.length(w) > 0, cut).otherwise(F.array().cast("array<string>"))))).alias("form")

    met = words.select("word", forms("word")).join(others.select("other", forms("other")), "form")
    return met.where(F.levenshtein("word", "other") == 1).select("word", "other").distinct()


def _pairs(s, d):
    """Words of the canon of five letters and more that one edit sets apart, each pair once."""
    words = _canon_words(s, d).where("length(word) >= 5")
    return one_edit(words, words.select(F.col("word").alias("other"))).where("word < other")


_NORM = f"WITH {I.SQL_NORM}"
_FORMS = "list_distinct(list_filter([b, " + ", ".join(f"CASE WHEN ends_with(b, '{s}') THEN substr(b, 1, length(b) - {len(s)}) || '{r}' END" for s, r in INFLECTIONS) + "], lambda x: x IS NOT NULL))"

QUERIES = {
    "tok_words": lambda s, d: C.talks(s, d).select("talk_id", F.posexplode(T.words("text")).alias("i", "word")),
    "tok_simple": lambda s, d: C.talks(s, d).select("talk_id", F.explode(T.letter_runs("text", 3)).alias("word")).groupBy("talk_id", "word").agg(F.count("*").alias("c")),
    "tok_triples": lambda s, d: token_triples(C.paragraphs(C.addresses(s, d))),
    "tok_mask": lambda s, d: I.masked_positions(I.normalised(s, d), C.canon_shingles(s, d)).select("talk_id", "pos", F.explode("mask").alias("at")),
    "tok_clean": I.clean_text,
    "tok_coverage": lambda s, d: coverage(I.normalised(s, d), C.canon_shingles(s, d, 4)),
    "tok_para_norm": lambda s, d: I.normalised(s, d).join(I.normalised(s, d).where("pos = 0").select("talk_id", "pos"), ["talk_id", "pos"], "left_anti").select("talk_id", "pos", F.array_join("norm", " ").alias("norm")),
    "txt_meaningful": lambda s, d: C.canon(s, d).select(F.explode(F.flatten(F.array(*[T.windows("toks", n) for n in range(1, 6)]))).alias("gram")).distinct().select("gram", T.meaningful("gram").alias("ok")),
    "txt_count_overlap": lambda s, d: C.talks(s, d).select("talk_id", T.overlapping(T.words("text"), "of the").alias("n")),
    "txt_one_edit": _pairs,
    "txt_dictionary": lambda s, d: in_dictionary(I.vocabulary(s, d).select("word"), _canon_words(s, d)),
    "txt_stopwords": lambda s, d: I.vocabulary(s, d).where(F.col("word").isin(STOPWORDS)).select("word", "total"),
    "txt_ordname": lambda s, d: s.range(-60, 120).select(F.col("id").cast("int").alias("ord"), T.period_name(F.col("id")).alias("name")),
    "txt_unstutter": lambda s, d: C.talks(s, d).select("talk_id", unstutter(F.lower("text")).alias("shown")),
    "txt_tidy": lambda s, d: C.talks(s, d).select("talk_id", tidy(F.col("text")).alias("shown")),
    "txt_showterm": lambda s, d: I.vocabulary(s, d).select("word", F.when((F.col("cap_mid") >= 2) & (F.col("cap_mid") >= 9 * F.col("lower_mid")), F.initcap("word")).otherwise(F.col("word")).alias("shown")),
}


def _displayed(s, d):
    def made(batches):
        for pdf in batches:
            yield pdf[["talk_id", "pos"]].assign(shown=[display(t, 0, 12) for t in pdf["para"]])

    return C.paragraphs(C.addresses(s, d)).select("talk_id", "pos", "para").mapInPandas(made, "talk_id long, pos int, shown string")


QUERIES["txt_display"] = _displayed

ORACLES = {
    "tok_words": f"WITH {C.SQL_TALKS} SELECT talk_id, unnest(range(0, len(w)))::INT AS i, unnest(w) AS word FROM (SELECT talk_id, {C.sql_words('text')} AS w FROM talk)",
    "tok_simple": f"WITH {C.SQL_TALKS} SELECT talk_id, word, count(*) AS c FROM (SELECT talk_id, unnest({C.sql_runs('text', 3)}) AS word FROM talk) GROUP BY 1, 2",
    "tok_mask": f"WITH {I.SQL_CLEAN} SELECT talk_id, pos::INT AS pos, unnest(mask)::INT AS at FROM mask",
    "tok_clean": f"WITH {I.SQL_CLEAN} SELECT talk_id, pos::INT AS pos, array_to_string(list_transform(clean, lambda g: array_to_string(g, ' ')), ' | ') AS clean FROM clean",
    "tok_coverage": f"WITH {I.SQL_NORM}, {I._sql_mask(4)} SELECT talk_id, sum(len(norm))::BIGINT AS tokens, sum(coalesce(len(mask), 0))::BIGINT AS covered FROM norm LEFT JOIN mask USING (talk_id, pos) GROUP BY 1",
    "tok_para_norm": f"{_NORM} SELECT talk_id, pos::INT AS pos, array_to_string(norm, ' ') AS norm FROM norm WHERE pos <> 0",
    "txt_meaningful": f"""WITH {C.SQL_CANON}, g AS (SELECT DISTINCT gram FROM ({" UNION ALL ".join(f"SELECT unnest({C.sql_windows('toks', n)}) AS gram FROM canon" for n in range(1, 6))}))
      SELECT gram, string_split(gram, ' ')[1] NOT IN ({sql_list(STOPWORDS)}) AND string_split(gram, ' ')[-1] NOT IN ({sql_list(STOPWORDS)}) AS ok FROM g""",
    "txt_count_overlap": f"WITH {C.SQL_TALKS}, w AS (SELECT talk_id, {C.sql_words('text')} AS w FROM talk) SELECT talk_id, len(list_filter({C.sql_windows('w', 2)}, lambda g: g = 'of the'))::INT AS n FROM w",
    "txt_one_edit": f"WITH {C.SQL_CANON}, w AS (SELECT DISTINCT word FROM (SELECT unnest(toks) AS word FROM canon) WHERE length(word) >= 5) SELECT a.word, b.word AS other FROM w a JOIN w b ON a.word < b.word AND abs(length(a.word) - length(b.word)) <= 1 AND levenshtein(a.word, b.word) = 1",
    "txt_dictionary": f"WITH voc AS ({I.ORACLES['txt_vocab_caps']}), {C.SQL_CANON}, dict AS (SELECT DISTINCT unnest(toks) AS form FROM canon), f AS (SELECT word, unnest({_FORMS}) AS form FROM (SELECT word, replace(word, '''s', '') AS b FROM voc)) SELECT DISTINCT word FROM f SEMI JOIN dict USING (form)",
    "txt_stopwords": f"WITH voc AS ({I.ORACLES['txt_vocab_caps']}) SELECT word, total FROM voc WHERE word IN ({sql_list(STOPWORDS)})",
    "txt_ordname": "SELECT id::INT AS ord, CASE WHEN ((id - 1) % 2 + 2) % 2 = 0 THEN 'April ' ELSE 'October ' END || (1971 + floor((id - 1) / 2.0))::INT AS name FROM range(-60, 120) r(id)",
    "txt_showterm": f"WITH voc AS ({I.ORACLES['txt_vocab_caps']}) SELECT word, CASE WHEN cap_mid >= 2 AND cap_mid >= 9 * lower_mid THEN upper(substr(word, 1, 1)) || substr(word, 2) ELSE word END AS shown FROM voc",
}
