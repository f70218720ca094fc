"""Loading the corpus: calendar, links, speakers, incremental and replacing loads, and checks against other counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.nearest import nearest
from ..plans.store import shared_dir
from ..sources import corpus as C
from ..sources.pages import parsed

# Titles of items that are not addresses; what may stand before a speaker's name, as often as it does.
BUSINESS = r"(?i)sustaining of|audit|statistical report|officers sustained|solemn assembly|^report of the|church finance committee|video presentation|^video:"
BEFORE_NAMES = "by|presented by|read by|given by|president|elder|sister|bishop|brother|presiding bishop|patriarch|dr\\.?"
NAME_TITLES = rf"(?i)^(?:(?:{BEFORE_NAMES})\s+)+"
ACCENTS = ("áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """conf_id of every April and October that begins within the dates."""
    months = F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("m")
    return spark.range(1).select(months).where((F.month("m").isin(4, 10)) & (F.col("m") >= F.lit(start).cast("date"))).select(F.date_format("m", "yyyy-MM").alias("conf_id"), "m")


def parse_ref(href: Column) -> Column:
    """(kind, path, volume, book, chapter, verses) of a link to a canon passage or a talk; null for any other."""
    clean = F.replace(href, F.lit("&amp;"), F.lit("&"))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(clean, r"^(?:https?://[^/?#]*)?(/[^?#]*)", 1), "^/study", ""), "/+$", "")
    ids = F.url_decode(F.regexp_extract(clean, r"[?&]id=([^&#]*)", 1))
    canon, talk = r"^/scriptures/([^/]+)/([^/]+)(?:/([0-9]+))?$", r"^/general-conference/[0-9]{4}/[0-9]{2}/([^/]+)$"
    part = lambda k: F.nullif(F.regexp_extract(path, canon, k), F.lit(""))
    verses = F.when(ids.rlike(r"^[p0-9,\-]*$"), F.regexp_replace(ids, r"p([0-9]+)", "$1")).otherwise("")
    none = F.lit(None).cast("string")
    found = lambda kind, *rest: F.struct(F.lit(kind).alias("kind"), path.alias("path"), *[v.alias(n) for n, v in zip(("volume", "book", "chapter", "verses"), rest, strict=True)])
    return F.when(path.rlike(canon), found("scripture", part(1), part(2), part(3), verses)).when(
        path.rlike(talk) & ~path.endswith("-session"), found("talk", none, none, none, none)
    )


def compatible(text: Column) -> Column:
    """Full-width forms, ligatures and no-break blanks as plain ones: the part of compatibility forms that names meet."""
    wide = "".join(chr(0xFF01 + k) for k in range(94))
    plain = F.translate(text, wide + "\u00a0\u2007\u202f\u3000", "".join(chr(0x21 + k) for k in range(94)) + "    ")
    for lig, by in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("…", "...")):
        plain = F.replace(plain, F.lit(lig), F.lit(by))
    return plain


def clean_name(raw: Column) -> Column:
    """The name without blanks, commas and colons around it and without titles, as often as one stands before it."""
    name = F.regexp_replace(compatible(F.coalesce(raw, F.lit(""))), r"\s+", " ")
    name = F.regexp_replace(name, r"^[ ,:]+|[ ,:]+$", "")
    return F.regexp_replace(F.trim(F.regexp_replace(name, NAME_TITLES, "")), r",?\s+(Jr|Sr)\.?$", " $1.")


def name_key(raw: Column) -> Column:
    plain = F.translate(F.lower(clean_name(raw)), *ACCENTS)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z ]", " "), " +", " "))


def group_of(role: Column) -> Column:
    r = F.lower(F.coalesce(role, F.lit("")))
    return F.when(r.contains("first presidency") | r.contains("president of the church"), "First Presidency").when(r.contains("twelve") & ~r.contains("assistant"), "Twelve").otherwise("Other")


def kind_of(title: Column, speaker: Column, words: Column) -> Column:
    return F.when(title.rlike(r"(?i)session$"), "session").when(title.rlike(BUSINESS), "business").when(speaker.isNull() | (words < C.ADDRESS_WORDS), "other").otherwise("address")


def append_new(old: DataFrame, new: DataFrame, key: str = "href") -> DataFrame:
    """The old rows and those of the new whose key isn't there yet, each key once."""
    fresh = new.join(old.select(key), key, "left_anti").dropDuplicates([key])
    return old.unionByName(fresh)


def fill_groups(talks: DataFrame) -> DataFrame:
    """talk_id, grp: a blank group takes that of the same speaker's talk with the nearest id, ties to the lower."""
    found = nearest(talks.where("grp = ''"), talks.where("grp <> ''").select("talk_id", "speaker", F.col("grp").alias("found")), "speaker", "talk_id", "found")
    filled = F.when(F.col("grp") == "", F.coalesce("found", F.lit(""))).otherwise(F.col("grp"))
    return talks.join(found.select("talk_id", "found"), "talk_id", "left").select("talk_id", filled.alias("grp"))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, and the old ones of other keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def reconcile(ours: DataFrame, theirs: DataFrame, near: int = 3) -> DataFrame:
    """ord, ours, theirs, status of counts by bucket on either side."""
    joined = ours.groupBy("ord").agg(F.count("*").alias("ours")).join(theirs.groupBy("ord").agg(F.count("*").alias("theirs")), "ord", "full_outer")
    a, b = F.coalesce("ours", F.lit(0)), F.coalesce("theirs", F.lit(0))
    return joined.select("ord", a.alias("ours"), b.alias("theirs"), F.when(a == 0, "missing").when(b == 0, "extra").when(F.abs(a - b) <= near, "ok").otherwise("differs").alias("status"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional talks: conversations whose paragraphs are turns; marks and notices among them go."""
    t = C.table(spark, sf_dir, "conversations")
    return t.where(~F.col("text").rlike("^[#©]")).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda e: e["text"]), "\n").alias("text"), F.count("*").alias("turns"))


# Samples for the link, name and role rules.
LINKS = [
    "/study/scriptures/bofm/2-ne/2?lang=eng&amp;id=p25#p25", "/study/scriptures/ot/ps/16?lang=eng&amp;id=p8%2Cp11#p8", "/study/general-conference/2022/04/47nelson?lang=eng", "/study/general-conference/2022/04/saturday-morning-session?lang=eng",
    "https://example.com/x", "/scriptures/nt/john", "/scriptures/nt/john/3?id=p16-p17",
]
NAMES = ["By President Ann B. Case", "Elder Ann B. Case", "Ann B. Case", "Read by Sister Ann B. Case:", "René Fouché", "Bishop Rene Fouche", "John Doe, Jr", "Given by Elder John Doe Jr.", "Sister  Mary  Roe ,", "Presiding Bishop Ｌee Ｐark"]
ROLES = [
    "President of the Church", "Second Counselor in the First Presidency", "Of the Quorum of the Twelve Apostles", "Acting President of the Quorum of the Twelve Apostles", "Assistant to the Council of the Twelve",
    "Of the Seventy", "",
]


def _rows(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def _half(s, d, odd: bool):
    return C.talks(s, d).where((F.col("talk_id") % 3 != 0) if odd else (F.col("talk_id") % 2 == 0)).select(F.col("talk_id").alias("href"), "speaker")


_CSV = {"lineSep": "\n", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _csv(s, d):
    path = f"{shared_dir(s)}/tidemark-{uuid.uuid4().hex}/talks-csv"
    C.talks(s, d).select("talk_id", "ord", "speaker", "title").write.options(**_CSV).csv(path)
    # nothing between two commas is null, a pair of quotes an empty text: they stay apart where null has a name that no text has
    return s.read.schema("talk_id long, ord int, speaker string, title string").option("multiLine", True).option("nullValue", uuid.uuid4().hex).options(**_CSV).csv(path)


def _json(s, d):
    from . import signals

    path = f"{shared_dir(s)}/tidemark-{uuid.uuid4().hex}/signals-json"
    rows = signals.ranked(s, d).where("rank <= 40")
    rows.write.json(path)
    return s.read.schema(rows.schema).json(path)


def _links(s, d):
    """href: the samples and the different links of the pages."""
    found = C.table(s, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))
    return _rows(s, LINKS, "href").unionByName(found).distinct()


def _pages(s, d):
    return parsed(C.table(s, d, "pages"))


def _parse_talk(s, d):
    p = _pages(s, d)
    words = F.size(T.words(F.array_join("paragraphs", " ")))
    return p.select("page_id", "title", kind_of(F.col("title"), F.col("url"), words).alias("kind"), F.size("paragraphs").alias("paragraphs"), F.size("links").alias("links"))


def sessions(pages: DataFrame) -> DataFrame:
    """page_id, i, link, session: every different link of a page in the order of its first place, and the heading above it."""
    met = pages.select("page_id", F.posexplode(F.arrays_zip("links", "above")).alias("at", "l"))
    first = met.groupBy("page_id", F.col("l.links").alias("link")).agg(F.min(F.struct("at", F.col("l.above").alias("session"))).alias("f"))
    order = Window.partitionBy("page_id").orderBy("f.at")
    return first.select("page_id", (F.row_number().over(order) - 1).alias("i"), "link", F.col("f.session").alias("session"))


def write_cache(pages: DataFrame, path: str) -> None:
    """A cache of fetched pages: one JSON record each with url, status and body; an empty page is a tombstone (404)."""
    gone = F.coalesce(F.col("html"), F.lit("")) == ""
    pages.select("page_id", "url", F.when(gone, 404).otherwise(200).alias("status"), F.when(~gone, F.col("html")).alias("body")).write.json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, body of the pages that the cache holds; tombstones and broken records are left out."""
    cached = spark.read.schema("page_id long, url string, status int, body string").option("mode", "DROPMALFORMED").json(path)
    return cached.where("status = 200 AND url IS NOT NULL").select("page_id", "url", "body")


def to_fetch(urls: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """url of those that the cache has no record of, tombstones included."""
    cached = spark.read.schema("url string").json(path).select("url")
    return urls.select("url").distinct().join(cached, "url", "left_anti")


def _cached(s, d):
    path = f"{shared_dir(s)}/tidemark-{uuid.uuid4().hex}/cache"
    write_cache(C.table(s, d, "pages"), path)
    return read_cache(s, path).select("page_id", "url", F.length("body").alias("size"))


QUERIES = {
    "src_csv_cache": _csv,
    "src_calendar": lambda s, d: calendar(s, "1971-01-15", "1990-12-31").select("conf_id"),
    "src_talk_meta": lambda s, d: _pages(s, d).select("page_id", "title", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), "lang"),
    "src_talk_text": lambda s, d: _pages(s, d).select("page_id", F.array_join("paragraphs", "\n\n").alias("text")),
    "src_scrape_conf": lambda s, d: C.table(s, d, "pages").where(F.col("html").isNotNull() & (F.col("html") != "")).select("page_id", "url"),
    "src_incremental": lambda s, d: append_new(_half(s, d, False), _half(s, d, True)),
    "src_html_clean": lambda s, d: _pages(s, d).select("page_id", F.explode("paragraphs").alias("para")),
    "src_parse_ref": lambda s, d: _links(s, d).select("href", parse_ref(F.col("href")).alias("r")).select("href", "r.*"),
    "src_sessions": lambda s, d: _pages(s, d).select("page_id", F.posexplode(F.arrays_zip("links", "above")).alias("i", "l")).select("page_id", "i", F.col("l.links").alias("link"), F.col("l.above").alias("session")),
    "src_api_fetch": _cached,
    "src_parse_talk": _parse_talk,
    "src_talk_kind": lambda s, d: C.talks(s, d).select("talk_id", kind_of(F.col("title"), F.col("speaker"), F.size(T.words("text"))).alias("kind")),
    "src_load_rows": lambda s, d: replace_rows(C.talks(s, d).select("talk_id", "ord", "speaker"), C.talks(s, d).where("ord = 40").select("talk_id", "ord", F.upper("speaker").alias("speaker")), ["ord"]),
    "src_fill_group": lambda s, d: fill_groups(C.talks(s, d).select("talk_id", "speaker", F.when(F.col("talk_id") % 7 == 0, "").otherwise(F.col("grp")).alias("grp"))),
    "src_build": lambda s, d: C.talks(s, d).select("speaker").distinct().join(C.talks(s, d).where("talk_id % 20 < 15").select("speaker"), "speaker", "left_anti"),
    "src_speaker": lambda s, d: _rows(s, NAMES, "raw").select(clean_name(F.col("raw")).alias("name"), name_key(F.col("raw")).alias("key"), "raw").groupBy("key").agg(F.min("name").alias("name"), F.count("*").alias("aliases")),
    "src_group": lambda s, d: _rows(s, ROLES, "role").select("role", group_of(F.col("role")).alias("grp")),
    "src_scribe": turns,
    "src_historical": lambda s, d: sessions(_pages(s, d)),
    "src_reconcile": lambda s, d: reconcile(C.talks(s, d).where("ord <> 7 AND talk_id % 3 <> 0"), C.talks(s, d).where("ord <> 9 AND talk_id % 2 = 0")),
    "src_conf_dim": lambda s, d: C.talks(s, d).select("ord", "year", F.when(F.col("ord") % 2 == 1, 4).otherwise(10).alias("month")).distinct().select(F.format_string("%d-%02d", "year", "month").alias("conf_id"), "ord", "year", "month"),
    "src_talk_scan": lambda s, d: C.paragraphs(C.addresses(s, d)).groupBy("talk_id").agg(F.count("*").alias("paras"), F.min("ord").alias("ord")),
    "sink_csv": _csv,
    "sink_signals_json": _json,
}

_REF = "regexp_replace(regexp_replace(regexp_extract(replace(href, '&amp;', '&'), '^(?:https?://[^/?#]*)?(/[^?#]*)', 1), '^/study', ''), '/+$', '')"
_values = lambda vs: ", ".join("('" + v.replace("'", "''") + "')" for v in vs)
_CANON, _TALK = "^/scriptures/([^/]+)/([^/]+)(?:/([0-9]+))?$", "^/general-conference/[0-9]{4}/[0-9]{2}/([^/]+)$"
ORACLES = {
    "src_calendar": "SELECT strftime(m, '%Y-%m') AS conf_id FROM range(DATE '1971-01-01', DATE '1991-01-01', INTERVAL 1 MONTH) r(m) WHERE month(m) IN (4, 10) AND m >= DATE '1971-01-15' AND m <= DATE '1990-12-31'",
    "src_api_fetch": "SELECT page_id, url, length(html)::INT AS size FROM pages WHERE coalesce(html, '') <> '' AND url IS NOT NULL",
    "src_scrape_conf": "SELECT page_id, url FROM pages WHERE html IS NOT NULL AND html <> ''",
    "src_incremental": f"WITH {C.SQL_TALKS} SELECT talk_id AS href, speaker FROM talk WHERE talk_id % 2 = 0 OR talk_id % 3 <> 0",
    "src_parse_ref": f"""WITH l(href) AS (SELECT * FROM (VALUES {_values(LINKS)}) UNION SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages), p AS (SELECT href, {_REF} AS path, url_decode(regexp_extract(replace(href, '&amp;', '&'), '[?&]id=([^&#]*)', 1)) AS ids FROM l),
      c AS (SELECT *, regexp_matches(path, '{_CANON}') AS s, regexp_matches(path, '{_TALK}') AND NOT ends_with(path, '-session') AS t FROM p)
      SELECT href, CASE WHEN s THEN 'scripture' WHEN t THEN 'talk' END AS kind, CASE WHEN s OR t THEN path END AS path, CASE WHEN s THEN regexp_extract(path, '{_CANON}', 1) END AS volume, CASE WHEN s THEN regexp_extract(path, '{_CANON}', 2) END AS book,
        CASE WHEN s THEN nullif(regexp_extract(path, '{_CANON}', 3), '') END AS chapter, CASE WHEN s THEN CASE WHEN regexp_full_match(ids, '[p0-9,\\-]*') THEN regexp_replace(ids, 'p([0-9]+)', '\\1', 'g') ELSE '' END END AS verses FROM c""",
    "src_talk_kind": f"WITH {C.SQL_TALKS} SELECT talk_id, CASE WHEN regexp_matches(title, '(?i)session$') THEN 'session' WHEN regexp_matches(title, '{BUSINESS}') THEN 'business' WHEN speaker IS NULL OR len({C.sql_words('text')}) < {C.ADDRESS_WORDS} THEN 'other' ELSE 'address' END AS kind FROM talk",
    "src_load_rows": f"WITH {C.SQL_TALKS} SELECT talk_id, ord, CASE WHEN ord = 40 THEN upper(speaker) ELSE speaker END AS speaker FROM talk",
    "src_fill_group": f"""WITH {C.SQL_TALKS}, t AS (SELECT talk_id, speaker, CASE WHEN talk_id % 7 = 0 THEN '' ELSE grp END AS grp FROM talk)
      SELECT talk_id, CASE WHEN grp <> '' THEN grp ELSE coalesce((SELECT o.grp FROM t o WHERE o.speaker = t.speaker AND o.grp <> '' ORDER BY abs(o.talk_id - t.talk_id), o.talk_id LIMIT 1), '') END AS grp FROM t""",
    "src_build": f"WITH {C.SQL_TALKS} SELECT DISTINCT speaker FROM talk WHERE speaker NOT IN (SELECT speaker FROM talk WHERE talk_id % 20 < 15)",
    "src_speaker": f"""WITH n(raw) AS (VALUES {_values(NAMES)}), w AS (SELECT raw, trim(regexp_replace(translate(raw, 'ＬＰ', 'LP'), '\\s+', ' ', 'g'), ' ,:') AS w FROM n),
      c AS (SELECT regexp_replace(trim(regexp_replace(w, '(?i)^((by|presented by|read by|given by|president|elder|sister|bishop|brother|presiding bishop|patriarch|dr\\.?) +)+', '')), ',? +(Jr|Sr)\\.?$', ' \\1.') AS name FROM w)
      SELECT trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')) AS key, min(name) AS name, count(*) AS aliases FROM c GROUP BY 1""",
    "src_group": f"WITH r(role) AS (VALUES {_values(ROLES)}) SELECT role, CASE WHEN contains(lower(role), 'first presidency') OR contains(lower(role), 'president of the church') THEN 'First Presidency' WHEN contains(lower(role), 'twelve') AND NOT contains(lower(role), 'assistant') THEN 'Twelve' ELSE 'Other' END AS grp FROM r",
    "src_scribe": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text, count(*) AS turns FROM conversations WHERE NOT regexp_matches(text, '^[#©]') GROUP BY 1",
    "src_reconcile": f"""WITH {C.SQL_TALKS}, a AS (SELECT ord, count(*) AS ours FROM talk WHERE ord <> 7 AND talk_id % 3 <> 0 GROUP BY 1), b AS (SELECT ord, count(*) AS theirs FROM talk WHERE ord <> 9 AND talk_id % 2 = 0 GROUP BY 1)
      SELECT ord, coalesce(ours, 0) AS ours, coalesce(theirs, 0) AS theirs, CASE WHEN ours IS NULL THEN 'missing' WHEN theirs IS NULL THEN 'extra' WHEN abs(ours - theirs) <= 3 THEN 'ok' ELSE 'differs' END AS status FROM a FULL JOIN b USING (ord)""",
    "src_conf_dim": f"WITH {C.SQL_TALKS} SELECT DISTINCT printf('%d-%02d', year, CASE WHEN ord % 2 = 1 THEN 4 ELSE 10 END) AS conf_id, ord, year, (CASE WHEN ord % 2 = 1 THEN 4 ELSE 10 END)::INT AS month FROM talk",
    "src_talk_scan": f"WITH {C.SQL_TALKS}, {C.SQL_ADDRESS}, {C.SQL_PARAS} SELECT talk_id, count(*) AS paras, min(ord) AS ord FROM para GROUP BY 1",
    "sink_csv": f"WITH {C.SQL_TALKS} SELECT talk_id, ord, speaker, title FROM talk",
}
ORACLES["src_csv_cache"] = ORACLES["sink_csv"]
