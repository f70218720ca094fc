"""Word and phrase frequencies over time, and comparisons of two periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import PHRASE_WORDS_LEFT_OUT, STOPWORDS, TOP_WORDS_LEFT_OUT, sql_list
from ..sources import corpus as C


def _word_count(word: str) -> Column:
    return F.regexp_count(F.lower("text"), F.lit(rf"\b{word}\b")).cast("long")


def _phrase_count(phrase: str) -> Column:
    text = F.lower("text")
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def _frequency(talks: DataFrame, items: list[str], by: str, count, per: float, name: str) -> DataFrame:
    """One pass over the texts: every item's count is a column of one aggregate, then unpivoted."""
    sums = [F.sum(count(x)).alias(f"c{k}") for k, x in enumerate(items)]
    one = talks.groupBy(by).agg(F.sum(T.blank_words("text")).alias("total"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias(name), F.coalesce(F.col(f"c{k}"), F.lit(0)).alias("count")) for k, x in enumerate(items)])).alias("r")
    return one.select(F.col(by).alias("period"), "total", rows).select("period", f"r.{name}", "r.count", F.coalesce(F.round(F.try_divide(F.col("r.count") * per, "total"), 6), F.lit(0.0)).alias("frequency"))


def word_frequency_over_time(talks: DataFrame, words: list[str], by: str = "decade") -> DataFrame:
    return _frequency(talks, words, by, _word_count, 1000.0, "word")


def phrase_frequency_over_time(talks: DataFrame, phrases: list[str], by: str = "decade") -> DataFrame:
    return _frequency(talks, phrases, by, _phrase_count, 1000.0, "phrase")


def top_words_by_period(talks: DataFrame, by: str = "decade", top: int = 20, least_length: int = 4, left_out=(*STOPWORDS, *TOP_WORDS_LEFT_OUT)) -> DataFrame:
    words = talks.select(F.col(by).alias("period"), F.explode(T.letter_runs("text", least_length)).alias("word")).where(~F.col("word").isin(*left_out))
    counted = words.groupBy("period", "word").agg(F.count("*").alias("count"))
    order = Window.partitionBy("period").orderBy(F.col("count").desc(), "word")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def compare_periods(talks: DataFrame, one: int, two: int, by: str = "decade", top: int = 50) -> DataFrame:
    """word, kind: 'first', 'second' or 'both' of the two periods' top words."""
    words = top_words_by_period(talks.where(F.col(by).isin(one, two)), by, top)
    sides = words.groupBy("word").agg(F.bool_or(F.col("period") == one).alias("a"), F.bool_or(F.col("period") == two).alias("b"))
    return sides.select("word", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").otherwise("second").alias("kind"))


def speaker_evolution(talks: DataFrame, speaker: str, words: list[str], by: str = "decade") -> DataFrame:
    return word_frequency_over_time(talks.where(F.col("speaker") == speaker), words, by)


def compare_time_periods(talks: DataFrame, early: tuple[int, int], late: tuple[int, int], top: int = 50, least: int = 10, left_out=tuple(STOPWORDS), items=None) -> DataFrame:
    """Early and late frequency per 10,000 kept tokens of every word used ``least`` times, the largest changes first."""
    side = F.when(F.col("year").between(*early), 0).when(F.col("year").between(*late), 1)
    if items is None:
        items = talks.select(side.alias("side"), F.explode(T.letter_runs("text", 3)).alias("word")).where(F.col("side").isNotNull() & ~F.col("word").isin(*left_out))
    counts = items.groupBy("word").agg(F.count_if(F.col("side") == 0).alias("early_count"), F.count_if(F.col("side") == 1).alias("late_count"))
    # every word is in the sums, so they come from the counts themselves: a single row
    totals = counts.agg(F.sum("early_count").alias("e"), F.sum("late_count").alias("l"))
    freq = lambda c, t: F.try_divide(F.col(c) * 10000.0, F.col(t))
    out = counts.where(F.col("early_count") + F.col("late_count") >= least).crossJoin(F.broadcast(totals))
    out = out.withColumn("early_freq", freq("early_count", "e")).withColumn("late_freq", freq("late_count", "l")).withColumn("change", F.round(F.col("late_freq") - F.col("early_freq"), 6))
    pct = F.when(F.col("early_count") == 0, F.lit(float("inf"))).otherwise(F.round((F.col("late_freq") - F.col("early_freq")) / F.col("early_freq") * 100, 4))
    out = out.select("word", F.round("early_freq", 6).alias("early_freq"), F.round("late_freq", 6).alias("late_freq"), "change", pct.alias("pct_change"), "early_count", "late_count")
    return out.orderBy(F.abs("change").desc(), "word").limit(top)


def find_increasing_words(talks: DataFrame, early, late, top: int = 25, least: int = 10) -> DataFrame:
    """Upward changes among the 2 * top largest ones, so there may be fewer than ``top``."""
    return compare_time_periods(talks, early, late, 2 * top, least).where("change > 0").orderBy(F.col("change").desc(), "word").limit(top)


def find_decreasing_words(talks: DataFrame, early, late, top: int = 25, least: int = 10) -> DataFrame:
    return compare_time_periods(talks, early, late, 2 * top, least).where("change < 0").orderBy("change", "word").limit(top)


def visualize_word_changes(talks: DataFrame, early, late, top: int = 15, least: int = 10) -> DataFrame:
    up, down = find_increasing_words(talks, early, late, top, least), find_decreasing_words(talks, early, late, top, least)
    return up.withColumn("direction", F.lit("up")).unionByName(down.withColumn("direction", F.lit("down"))).select("word", "change", "direction")


def compare_phrases(talks: DataFrame, early, late, sizes=(2, 3), top: int = 25, least: int = 5, features: int = 5000) -> DataFrame:
    """As compare_time_periods for n-grams over the words of three letters and more; the most frequent ones only."""
    side = F.when(F.col("year").between(*early), 0).when(F.col("year").between(*late), 1)
    toks = T.pinned(talks.select(side.alias("side"), "text").where("side IS NOT NULL"), "toks", T.letter_runs("text", 3))
    grams = toks.select("side", F.explode(F.flatten(F.array(*[T.windows("toks", n) for n in range(sizes[0], sizes[1] + 1)]))).alias("word"))
    counts = grams.groupBy("word").agg(F.count_if(F.col("side") == 0).alias("early_count"), F.count_if(F.col("side") == 1).alias("late_count"))
    vocabulary = counts.orderBy((F.col("early_count") + F.col("late_count")).desc(), "word").limit(features)
    totals = vocabulary.agg(F.sum("early_count").alias("e"), F.sum("late_count").alias("l"))
    parts = F.split("word", " ")
    stops = [*STOPWORDS, *PHRASE_WORDS_LEFT_OUT]
    ends = ~F.element_at(parts, 1).isin(stops) & ~F.element_at(parts, -1).isin(stops)
    freq = lambda c, t: F.try_divide(F.col(c) * 10000.0, F.col(t))
    out = vocabulary.where(ends & (F.col("early_count") + F.col("late_count") >= least)).crossJoin(F.broadcast(totals))
    change = F.round(freq("late_count", "l") - freq("early_count", "e"), 6)
    return out.select(F.col("word").alias("phrase"), change.alias("change"), "early_count", "late_count").orderBy(F.abs("change").desc(), "phrase").limit(top)


def concept_over_time(talks: DataFrame, concepts: dict[str, list[str]], by: str = "decade") -> DataFrame:
    """Summed counts of each concept's words per period, per 10,000 words."""
    total = lambda ws: sum((_word_count(w) for w in ws[1:]), _word_count(ws[0]))
    return _frequency(talks, list(concepts), by, lambda c: total(concepts[c]), 10000.0, "concept")


def hypothesis(talks: DataFrame, words: list[str], early, late) -> DataFrame:
    side = lambda p: F.col("year").between(*p)
    aggs = [F.sum(F.when(side(p), T.blank_words("text"))).alias(n) for n, p in (("e", early), ("l", late))]
    aggs += [F.sum(F.when(side(p), _word_count(w))).alias(f"{n}{k}") for k, w in enumerate(words) for n, p in (("e", early), ("l", late))]
    rows = F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.coalesce(f"e{k}", F.lit(0)).alias("early_count"), F.coalesce(f"l{k}", F.lit(0)).alias("late_count")) for k, w in enumerate(words)])).alias("r")
    one = talks.agg(*aggs).select("e", "l", rows).select("e", "l", "r.*")
    ef, lf = F.try_divide(F.col("early_count") * 10000.0, "e"), F.try_divide(F.col("late_count") * 10000.0, "l")
    pct = F.when(F.col("early_count") == 0, F.lit(float("inf"))).otherwise(F.round((lf - ef) / ef * 100, 4))
    return one.select("word", "early_count", "late_count", F.round(ef, 6).alias("early_freq"), F.round(lf, 6).alias("late_freq"), F.round(lf - ef, 6).alias("change"), pct.alias("pct_change"))


WORDS, PHRASES = ["and", "the", "of", "der", "que"], ["of the", "de la", "in the"]
EARLY, LATE = (1971, 1979), (1981, 1990)
CONCEPTS = {"articles": ["the", "der", "la"], "joining": ["and", "und"]}


def _count_sql(word: str) -> str:
    return f"len(list_filter(runs, lambda x: x = '{word}'))"


def _frequency_sql(where: str, items: list[str], by: str, count, per: float, name: str) -> str:
    parts = " UNION ALL ".join(f"SELECT period, '{x}' AS {name}, sum({count(x)})::BIGINT AS count, round(sum({count(x)}) * {per:.1f} / sum(total), 6) AS frequency FROM w GROUP BY period" for x in items)
    return f"""WITH {C.SQL_TALKS}, w AS (SELECT {by} AS period, lower(text) AS low, list_filter(regexp_extract_all(lower(text), '[\\pL\\pN\\pM_]+'), lambda x: true) AS runs,
      len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS total FROM talk WHERE {where}) {parts}"""


_TOP_SQL = f"""WITH {C.SQL_TALKS}, w AS (SELECT decade AS period, unnest({C.sql_runs('text', 4)}) AS word FROM talk),
c AS (SELECT period, word, count(*) AS count FROM w WHERE word NOT IN ({sql_list([*STOPWORDS, *TOP_WORDS_LEFT_OUT])}) GROUP BY 1, 2),
top AS (SELECT *, (row_number() OVER (PARTITION BY period ORDER BY count DESC, word))::INT AS rank FROM c)"""

_SIDE = f"CASE WHEN year BETWEEN {EARLY[0]} AND {EARLY[1]} THEN 0 WHEN year BETWEEN {LATE[0]} AND {LATE[1]} THEN 1 END"
_PCT = "CASE WHEN early_count = 0 THEN 'inf'::DOUBLE ELSE round((late_freq - early_freq) / early_freq * 100, 4) END"
_COMPARE = f"""{C.SQL_TALKS}, i AS (SELECT side, word FROM (SELECT {_SIDE} AS side, unnest({C.sql_runs('text', 3)}) AS word FROM talk) WHERE side IS NOT NULL AND word NOT IN ({sql_list(STOPWORDS)})),
c AS (SELECT word, count(*) FILTER (side = 0) AS early_count, count(*) FILTER (side = 1) AS late_count FROM i GROUP BY 1),
f AS (SELECT *, early_count * 10000.0::DOUBLE / (SELECT sum(early_count) FROM c) AS early_freq, late_count * 10000.0::DOUBLE / (SELECT sum(late_count) FROM c) AS late_freq FROM c WHERE early_count + late_count >= 10),
g AS (SELECT word, round(early_freq, 6) AS early_freq, round(late_freq, 6) AS late_freq, round(late_freq - early_freq, 6) AS change, {_PCT} AS pct_change, early_count, late_count FROM f)"""


def _cut(n: int) -> str:
    return f"(SELECT * FROM g ORDER BY abs(change) DESC, word LIMIT {n})"


def _concept_sql(names: list[str]) -> str:
    count = lambda c: "(" + " + ".join(_count_sql(w) for w in CONCEPTS[c]) + ")"
    return _frequency_sql("true", names, "decade", count, 10000, "concept")


def _talks(spark, sf):
    return C.talks(spark, sf)


QUERIES = {
    "word_frequency_over_time": lambda s, d: word_frequency_over_time(_talks(s, d), WORDS),
    "phrase_frequency_over_time": lambda s, d: phrase_frequency_over_time(_talks(s, d), PHRASES, "ord"),
    "top_words_by_period": lambda s, d: top_words_by_period(_talks(s, d)),
    "compare_periods": lambda s, d: compare_periods(_talks(s, d), 1970, 1980),
    "speaker_evolution": lambda s, d: speaker_evolution(_talks(s, d), "src3", WORDS),
    "wordcloud_by_period": lambda s, d: top_words_by_period(_talks(s, d).where("decade = 1980"), "decade", 200).select("word", "count"),
    "plot_word_trends": lambda s, d: word_frequency_over_time(_talks(s, d), WORDS, "year").orderBy("word", "period"),
    "plot_phrase_trends": lambda s, d: phrase_frequency_over_time(_talks(s, d), PHRASES, "year").orderBy("phrase", "period"),
    "compare_time_periods": lambda s, d: compare_time_periods(_talks(s, d), EARLY, LATE),
    "find_increasing_words": lambda s, d: find_increasing_words(_talks(s, d), EARLY, LATE),
    "find_decreasing_words": lambda s, d: find_decreasing_words(_talks(s, d), EARLY, LATE),
    "compare_phrases": lambda s, d: compare_phrases(_talks(s, d), EARLY, LATE),
    "test_hypothesis": lambda s, d: hypothesis(_talks(s, d), WORDS, EARLY, LATE),
    "visualize_word_changes": lambda s, d: visualize_word_changes(_talks(s, d), EARLY, LATE),
    "concept_over_time": lambda s, d: concept_over_time(_talks(s, d), {"articles": CONCEPTS["articles"]}),
    "comparative_concept": lambda s, d: concept_over_time(_talks(s, d), CONCEPTS),
}

_phrase = lambda p: f"((length(low) - length(replace(low, '{p}', ''))) // {len(p)})"

ORACLES = {
    "word_frequency_over_time": _frequency_sql("true", WORDS, "decade", _count_sql, 1000, "word"),
    "phrase_frequency_over_time": _frequency_sql("true", PHRASES, "ord", _phrase, 1000, "phrase"),
    "top_words_by_period": _TOP_SQL + " SELECT * FROM top WHERE rank <= 20",
    "compare_periods": _TOP_SQL + """, a AS (SELECT word FROM top WHERE period = 1970 AND rank <= 50), b AS (SELECT word FROM top WHERE period = 1980 AND rank <= 50)
      SELECT word, 'both' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT word, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT word, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "speaker_evolution": _frequency_sql("speaker = 'src3'", WORDS, "decade", _count_sql, 1000, "word"),
    "wordcloud_by_period": _TOP_SQL + " SELECT word, count FROM top WHERE period = 1980 AND rank <= 200",
    "plot_word_trends": _frequency_sql("true", WORDS, "year", _count_sql, 1000, "word"),
    "plot_phrase_trends": _frequency_sql("true", PHRASES, "year", _phrase, 1000, "phrase"),
    "compare_time_periods": f"WITH {_COMPARE} SELECT * FROM {_cut(50)}",
    "find_increasing_words": f"WITH {_COMPARE} SELECT * FROM {_cut(50)} WHERE change > 0 ORDER BY change DESC, word LIMIT 25",
    "find_decreasing_words": f"WITH {_COMPARE} SELECT * FROM {_cut(50)} WHERE change < 0 ORDER BY change, word LIMIT 25",
    "compare_phrases": f"""WITH {C.SQL_TALKS}, t AS (SELECT side, toks FROM (SELECT {_SIDE} AS side, {C.sql_runs('text', 3)} AS toks FROM talk) WHERE side IS NOT NULL),
      i AS (SELECT side, unnest(list_concat({C.sql_windows('toks', 2)}, {C.sql_windows('toks', 3)})) AS word FROM t),
      c AS (SELECT word, count(*) FILTER (side = 0) AS early_count, count(*) FILTER (side = 1) AS late_count FROM i GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 5000)
      SELECT * FROM (SELECT word AS phrase, round(late_count * 10000.0::DOUBLE / (SELECT sum(late_count) FROM c) - early_count * 10000.0::DOUBLE / (SELECT sum(early_count) FROM c), 6) AS change, early_count, late_count FROM c
      WHERE early_count + late_count >= 5 AND string_split(word, ' ')[1] NOT IN ({sql_list([*STOPWORDS, *PHRASE_WORDS_LEFT_OUT])}) AND string_split(word, ' ')[-1] NOT IN ({sql_list([*STOPWORDS, *PHRASE_WORDS_LEFT_OUT])})
      ) ORDER BY abs(change) DESC, phrase LIMIT 25""",
    "test_hypothesis": f"""WITH {C.SQL_TALKS}, w AS (SELECT {_SIDE} AS side, regexp_extract_all(lower(text), '[\\pL\\pN\\pM_]+') AS runs, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS total FROM talk),
      c AS ({" UNION ALL ".join(f"SELECT '{w}' AS word, sum({_count_sql(w)}) FILTER (side = 0)::BIGINT AS early_count, sum({_count_sql(w)}) FILTER (side = 1)::BIGINT AS late_count FROM w" for w in WORDS)}),
      f AS (SELECT *, early_count * 10000.0::DOUBLE / (SELECT sum(total) FILTER (side = 0) FROM w) AS early_freq, late_count * 10000.0::DOUBLE / (SELECT sum(total) FILTER (side = 1) FROM w) AS late_freq FROM c)
      SELECT word, early_count, late_count, round(early_freq, 6) AS early_freq, round(late_freq, 6) AS late_freq, round(late_freq - early_freq, 6) AS change, {_PCT} AS pct_change FROM f""",
    "visualize_word_changes": f"""WITH {_COMPARE}, u AS (SELECT * FROM (SELECT * FROM g ORDER BY abs(change) DESC, word LIMIT 30))
      SELECT * FROM (SELECT word, change, 'up' AS direction FROM u WHERE change > 0 ORDER BY change DESC, word LIMIT 15) UNION ALL SELECT * FROM (SELECT word, change, 'down' AS direction FROM u WHERE change < 0 ORDER BY change, word LIMIT 15)""",
    "concept_over_time": _concept_sql(["articles"]),
    "comparative_concept": _concept_sql(list(CONCEPTS)),
}
