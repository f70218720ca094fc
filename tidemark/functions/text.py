"""Column expressions for tokens, segments, n-grams and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import ABBREVIATIONS, STOPWORDS

WORD = r"(?<![0-9a-z])[a-z]+(?:'[a-z]+)*"
QUIET_STOP = rf"(^|[^a-z0-9'’])([a-z]|{'|'.join(ABBREVIATIONS)})\."


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """Lower-case words with inner apostrophes; runs that hold a digit are no words."""
    return F.regexp_extract_all(F.translate(F.lower(col(text)), "’", "'"), F.lit(WORD), F.lit(0))


def letter_runs(text, least: int = 1) -> Column:
    """Runs of a-z that stand between word boundaries."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(rf"\b[a-z]{{{least},}}\b"), F.lit(0))


def blank_words(text) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(col(text), r"\s+"), lambda w: w != ""))


def sentences(text) -> Column:
    """Word lists of a paragraph's sentences; a stop after an initial or an abbreviation ends none. Empty ones go."""
    quiet = F.regexp_replace(F.lower(col(text)), QUIET_STOP, "$1$2 ")
    return F.filter(F.transform(F.split(quiet, "[.!?]+"), words), lambda s: F.size(s) > 0)


def windows(tokens, n: int) -> Column:
    """All runs of n tokens, joined by blanks; none where there are fewer tokens.

    The list is zipped with its own shifts: slicing it once for every run would copy it every time."""
    t = col(tokens)
    many = F.greatest(F.size(t) - (n - 1), F.lit(0))
    runs = F.slice(t, F.lit(1), many)
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(t, F.lit(k + 1), many), lambda a, b: F.concat(a, F.lit(" "), b))
    return runs


def stop(word: Column) -> Column:
    return word.isin(STOPWORDS)


def meaningful(gram) -> Column:
    """Two words: no stop word; otherwise neither the first nor the last is one."""
    t = F.split(col(gram), " ")
    ends = ~stop(F.element_at(t, 1)) & ~stop(F.element_at(t, -1))
    return ends  # for two words both are ends


def grams(tokens, most: int = 5) -> Column:
    """All meaningful 1- to ``most``-grams of a token list."""
    t = col(tokens)
    made = F.flatten(F.array(*[windows(t, n) for n in range(1, most + 1)]))
    return F.filter(made, lambda g: ~stop(F.element_at(F.split(g, " "), 1)) & ~stop(F.element_at(F.split(g, " "), -1)))


def overlapping(tokens, needle: str) -> Column:
    """How often the phrase occurs in a token list, overlaps counted: a look-ahead takes no characters."""
    return F.regexp_count(F.concat(F.lit(" "), F.array_join(col(tokens), " "), F.lit(" ")), F.lit(rf"(?= \Q{needle}\E )"))


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: lambdas over it see a value, not the expression again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def period_name(ord_) -> Column:
    """'April 1971' for 1, 'October 1971' for 2, and so on, below 1 backwards."""
    k = col(ord_) - 1
    return F.concat(F.when(F.pmod(k, F.lit(2)) == 0, "April ").otherwise("October "), (1971 + F.floor(k / 2)).cast("string"))


def log_odds(y_i, n_i, y_j, n_j, alpha, prior, floor=None) -> Column:
    """z of the log-odds of y_i in n_i against y_j in n_j with an informative prior."""
    left, right = n_i + prior - y_i - alpha, n_j + prior - y_j - alpha
    if floor is not None:
        left, right = F.greatest(left, F.lit(floor)), F.greatest(right, F.lit(floor))
    delta = F.log((y_i + alpha) / left) - F.log((y_j + alpha) / right)
    return delta / F.sqrt(1 / (y_i + alpha) + 1 / (y_j + alpha))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
