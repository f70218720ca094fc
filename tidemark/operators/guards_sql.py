"""DuckDB counterparts of the guards, as common table expressions after those of the classes."""

from __future__ import annotations

from ..functions.lexicon import HONORIFICS, PROPER_ALLOWED, PROPER_ALLOWED_START, TITLES, sql_list
from ..sources import corpus as C
from . import index as I
from . import tokens


def names(asked: str) -> str:
    """told: word, who, name of the words that the query ``asked`` gives; it may read the vocabulary, ``voc``."""
    return f"""voc AS (SELECT * FROM ({I.ORACLES["txt_vocab_caps"]})),
ask AS MATERIALIZED ({asked}),
dictw AS (SELECT DISTINCT unnest({C.sql_words("line")}) AS form FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark)),
kn AS MATERIALIZED (SELECT DISTINCT word FROM (SELECT word, unnest({tokens._FORMS}) AS form FROM (SELECT word, replace(word, '''s', '') AS b FROM ask)) SEMI JOIN dictw USING (form)),
who AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(trim(regexp_replace(regexp_replace(lower(source), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')), ' ')) AS w FROM documents) WHERE length(w) > 1),
flags AS MATERIALIZED (SELECT ask.word, coalesce(cap_mid >= 2 AND cap_mid >= 9 * lower_mid, false) AS cap, ask.word IN (SELECT word FROM kn) AS known,
  ask.word IN (SELECT form FROM dictw) AS canonical, ask.word IN (SELECT word FROM who) AS who FROM ask LEFT JOIN voc USING (word)),
told AS (SELECT word, who, CASE WHEN who THEN cap OR NOT known
  ELSE NOT (starts_with(word, '{PROPER_ALLOWED_START}') OR word IN ({sql_list(PROPER_ALLOWED)})) AND cap AND NOT known AND NOT canonical END AS name FROM flags)"""


VOCABULARY_WORDS = "SELECT DISTINCT regexp_replace(word, '''s$', '') AS word FROM voc"

def rejected(terms: str) -> str:
    """rejected: term, of the terms that the query ``terms`` gives."""
    own = f"SELECT term, unnest(string_split(term, ' ')) AS t FROM ({terms}) AS asked"
    return f"""tk AS (SELECT term, t, regexp_replace(t, '''s$', '') AS word FROM ({own}) AS toks),
{names("SELECT DISTINCT word FROM tk")},
rejected AS (SELECT term FROM tk JOIN told USING (word) GROUP BY 1
  HAVING bool_or(length(t) = 1 OR t IN ({sql_list(HONORIFICS)}) OR name) OR (bool_or(t IN ({sql_list(TITLES)})) AND bool_or(who)))"""


#: After the classes.
REJECTED = rejected("SELECT DISTINCT term FROM ranked")


def _fragments(weight: str) -> str:
    sub = "unnest([array_to_string(string_split(term, ' ')[:-2], ' '), array_to_string(string_split(term, ' ')[2:], ' ')])"
    best = f"SELECT term, max(w) AS best FROM (SELECT {weight} AS w, {sub} AS term FROM cls WHERE {weight} > 0 AND contains(term, ' ')) GROUP BY 1"
    return f"SELECT term FROM ({best}) JOIN cls USING (term) WHERE {weight} > 0 AND best >= 0.7 * {weight}"


_PARTS = "list_concat(" * 4 + C.sql_windows("string_split(run, ' ')", 1) + "".join(f", {C.sql_windows(chr(40) + 'string_split(run, chr(32))' + chr(41), n)})" for n in range(2, 6))

#: reported: cls, term, key, count, speakers, share; after ``REJECTED``.
REPORTED = f"""cand AS (SELECT r.cls, r.term, r.key, r.count, r.speakers, k.peak_ord FROM ranked r JOIN cls k ON k.term = r.term
  WHERE r.cls <> 'absent' AND r.term NOT IN (SELECT term FROM rejected)
  AND CASE WHEN r.cls = 'fading' THEN r.term NOT IN ({_fragments("base")}) ELSE r.term NOT IN ({_fragments("y")}) END),
share AS (SELECT term, ord, max(c) / sum(c) AS share FROM uses GROUP BY 1, 2),
s1 AS (SELECT cand.*, coalesce(n.share, 0) AS share FROM cand LEFT JOIN share n ON n.term = cand.term AND n.ord = {C.BUCKETS}
  LEFT JOIN share p ON p.term = cand.term AND p.ord = cand.peak_ord WHERE NOT (cand.cls = 'fading' AND coalesce(p.share, 0) > 0.6)),
run7 AS (SELECT DISTINCT talk_id, unnest({C.sql_windows("seg", 7)}) AS run FROM seg WHERE ord = {C.BUCKETS}),
piece AS (SELECT DISTINCT talk_id, run, unnest({_PARTS}) AS term FROM run7),
passage AS (SELECT DISTINCT term FROM (SELECT term, run, count(DISTINCT talk_id) AS k FROM piece SEMI JOIN (SELECT term FROM s1 WHERE cls IN ('new', 'revived')) USING (term) GROUP BY 1, 2)
  JOIN (SELECT term, count(*) AS talks FROM uses WHERE ord = {C.BUCKETS} GROUP BY 1) USING (term) WHERE k = talks),
s2 AS (SELECT *, CASE WHEN cls IN ('new', 'revived', 'continuing', 'rising') AND share > 0.6 THEN 'single' ELSE cls END AS own FROM s1
  WHERE NOT (cls IN ('new', 'revived') AND term IN (SELECT term FROM passage))),
reported AS (SELECT DISTINCT own AS cls, term, CASE WHEN own = 'single' THEN count::DOUBLE ELSE key END AS key, count, speakers, round(share, 6) AS share FROM s2
  WHERE NOT (own = 'single' AND speakers >= 3 AND share < 0.5))"""
