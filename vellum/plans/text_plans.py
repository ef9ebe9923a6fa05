"""Queries over single texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import fixtures as fx
from .fixture_sql import RESPONSES, TEXTS, cnt, squeeze, strip

KEY = ("page_id", "region_id")


def _texts(**cols):
    return lambda spark, d: fx.texts(spark, d).select(*KEY, *[make(F.col("text")).alias(name) for name, make in cols.items()])


QUERIES = {
    "classify_text": _texts(text_class=T.classify),
    "script_counts": _texts(hangul_wide=lambda c: T.count(c, T.HANGUL_WIDE), hangul=lambda c: T.count(c, T.HANGUL), kana=lambda c: T.count(c, T.KANA), han=lambda c: T.count(c, T.HAN)),
    "detect_language": _texts(language=T.detect_language),
    "usable_text": _texts(usable=T.usable),
    "strong_dialogue": _texts(strong=T.strong_dialogue),
    "sfx_fragment": _texts(fragment=T.fragment, sound=T.sound_fragment),
    "placeholder_text": _texts(en_text=T.placeholder),
    "renderable_text": lambda spark, d: fx.responses(spark, d).select(*KEY, "provider", T.renderable(F.col("en_text")).alias("renderable")),
    "clean_answer": lambda spark, d: fx.responses(spark, d).select(*KEY, "provider", T.clean_answer(F.concat(F.lit("```json \"Translation:  "), "en_text", F.lit("\"```"))).alias("answer"), T.clean_answer(F.concat(F.lit(" Translation: "), "en_text")).alias("labelled")),
    "clean_markup": lambda spark, d: fx.table(spark, d, "pages").select("page_id", F.md5(T.clean_markup(F.col("html")).cast("binary")).alias("text_md5"), F.length(T.clean_markup(F.col("html"))).alias("n_chars")),
    "valid_translation": lambda spark, d: fx.responses(spark, d).join(fx.texts(spark, d), [*KEY]).select(*KEY, "provider", T.valid_answer(F.col("text"), F.col("en_text")).alias("valid")),
    "fast_hash": lambda spark, d: fx.table(spark, d, "pages").select("page_id", T.fnv_hash(F.col("url")).alias("url_hash")),
    "cache_id": lambda spark, d: fx.table(spark, d, "pages").select("page_id", F.concat_ws(":", F.lit("v1"), F.lit("ja"), T.fnv_hash(F.col("url")), T.fnv_hash(F.coalesce("html", F.lit("")))).alias("cache_id")),
    "language_hint": lambda spark, d: fx.table(spark, d, "documents").select("doc_id", T.language_hint(F.element_at(F.array(*map(F.lit, (" KO ", "chinese", "tw", "ja", "", "korean", "en"))), (F.col("doc_id") % 7 + 1).cast("int"))).alias("language")),
}

_S = f"regexp_replace(c, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
CLASSIFY = f"""classified AS (SELECT page_id, region_id, CASE
  WHEN c = '' THEN 'noise' WHEN letters > 0 AND latin / letters > 0.20 THEN 'english'
  WHEN n = 0 OR regexp_full_match(s, '\\p{{Nd}}+') OR kata + hira + kanji + hangul = 0 THEN 'noise'
  WHEN hangul >= 3 OR (hangul >= 2 AND n >= 3) THEN 'dialogue' WHEN hangul > 0 AND n <= 2 THEN 'sfx'
  WHEN kanji >= 2 AND hira + kata = 0 THEN 'dialogue' WHEN kanji = 1 AND hira + kata = 0 THEN 'sfx'
  WHEN kata / (kata + hira + kanji + hangul) >= 0.65 AND n <= 10 THEN 'sfx' WHEN n <= 4 AND kanji = 0 THEN 'sfx'
  WHEN hira = kata + hira + kanji + hangul AND n <= 5 THEN 'sfx'
  WHEN kanji >= 1 OR hira >= 3 OR (hira >= 2 AND kata >= 1) THEN 'dialogue' ELSE 'noise' END AS text_class
FROM (SELECT *, length(s) AS n, {cnt("c", "\\p{L}")} AS letters, {cnt("c", "A-Za-z")} AS latin, {cnt("s", T.KATAKANA)} AS kata, {cnt("s", T.HIRAGANA)} AS hira, {cnt("s", T.KANJI)} AS kanji, {cnt("s", T.HANGUL_WIDE)} AS hangul
  FROM (SELECT *, {_S} AS s FROM (SELECT page_id, region_id, {strip("text")} AS c FROM fx_texts))))"""

USABLE = f"CASE WHEN {strip('text')} = '' THEN false WHEN regexp_full_match({strip('text')}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+') THEN length({strip('text')}) <= 6 AND regexp_matches({strip('text')}, '[！?？…．.ー—]') WHEN regexp_matches(text, '[{T.CJK}]') THEN true ELSE regexp_matches(text, '[A-Za-z0-9]') AND length({strip('text')}) <= 24 END"
STRONG = f"({cnt('text', T.CJK)} >= 4 AND ({cnt('text', T.KANA)} >= 3 OR {cnt('text', T.HANGUL)} >= 3 OR ({cnt('text', T.HAN)} >= 2 AND {cnt('text', T.CJK)} >= 5) OR ({cnt('text', '\\p{L}\\p{N}')} >= 6 AND regexp_matches(text, '[。！？!?…]'))))"
FRAGMENT = f"regexp_replace({strip('text')}, '[^\\p{{L}}\\p{{N}}{T.CJK}]', '', 'g')"
SOUND = f"(length({FRAGMENT}) <= 1 OR len(list_distinct(string_split({FRAGMENT}, ''))) <= 1 OR {FRAGMENT} IN ({', '.join(repr(x) for x in T.SOUND_TOKENS)}) OR {' OR '.join(f'starts_with({FRAGMENT}, {x!r})' for x in T.SOUND_PREFIXES)})"


def _clean(col: str) -> str:
    """clean_answer for texts without entities."""
    fenced = f"regexp_replace({col}, '```(?:json)?', '', 'gi')"
    bare = f"""regexp_replace({squeeze(fenced)}, '^["''` ]+|["''` ]+$', '', 'g')"""
    return f"left(CASE WHEN starts_with(lower({bare}), 'translation:') THEN {strip(f'substr({bare}, 13)')} ELSE {bare} END, 360)"


VALID = f"""CASE WHEN a = '' OR starts_with(a, '[TL:') OR length(a) > 360 THEN false
  WHEN len(own) > 0 AND len(list_intersect(own, got)) / greatest(1, len(own)) > 0.35 THEN false
  WHEN len(own) > 0 AND NOT regexp_matches(a, '[A-Za-z0-9]') THEN {cnt("text", T.CJK)} <= 2 AND length(a) <= 8 ELSE true END"""
VALIDATED = f"""validated AS (SELECT *, {VALID} AS valid FROM (SELECT *, list_distinct(regexp_extract_all(text, '[{T.CJK}]')) AS own, list_distinct(regexp_extract_all(a, '[{T.CJK}]')) AS got
  FROM (SELECT r.*, t.text, {_clean("r.en_text")} AS a FROM fx_responses r JOIN fx_texts t USING (page_id, region_id))))"""

_CHARS = "list_transform(range(0, length({c}), greatest(1, length({c}) // 2000)), lambda i: CAST(unicode(substr({c}, i + 1, 1)) AS BIGINT))"


def hash_sql(c: str) -> str:
    chars = _CHARS.format(c=c)
    fold = f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {chars}), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"
    last = f"((xor({fold}, CAST(length({c}) AS BIGINT)) * 16777619) & 4294967295)"
    signed = f"(CASE WHEN {last} >= 2147483648 THEN {last} - 4294967296 ELSE {last} END)"
    return f"CASE WHEN length({c}) = 0 THEN '' ELSE concat(CASE WHEN {signed} < 0 THEN '-' ELSE '' END, lower(to_base(abs({signed}), 36))) END"


def _with(views: str, select: str) -> str:
    return f"WITH {views} SELECT {select}"


_HTML = "regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')"
_MARKUP = f"regexp_replace({strip(_HTML)}, '^[ ・]+|[ ・]+$', '', 'g')"

SQL = {
    "classify_text": f"WITH {TEXTS}, {CLASSIFY} SELECT * FROM classified",
    "script_counts": _with(TEXTS, f"page_id, region_id, CAST({cnt('text', T.HANGUL_WIDE)} AS INT) AS hangul_wide, CAST({cnt('text', T.HANGUL)} AS INT) AS hangul, CAST({cnt('text', T.KANA)} AS INT) AS kana, CAST({cnt('text', T.HAN)} AS INT) AS han FROM fx_texts"),
    "detect_language": _with(TEXTS, f"page_id, region_id, CASE WHEN regexp_matches(text, '[{T.HANGUL}]') THEN 'kor_Hang' WHEN regexp_matches(text, '[{T.KANA}]') THEN 'jpn_Jpan' WHEN regexp_matches(text, '[{T.KANJI}]') THEN 'zho_Hant' ELSE 'jpn_Jpan' END AS language FROM fx_texts"),
    "usable_text": _with(TEXTS, f"page_id, region_id, {USABLE} AS usable FROM fx_texts"),
    "strong_dialogue": _with(TEXTS, f"page_id, region_id, {STRONG} AS strong FROM fx_texts"),
    "sfx_fragment": _with(TEXTS, f"page_id, region_id, {FRAGMENT} AS fragment, {SOUND} AS sound FROM fx_texts"),
    "placeholder_text": _with(TEXTS, f"page_id, region_id, CASE WHEN {strip('text')} = '' THEN '' ELSE concat('[TL: ', left(text, 20), '...]') END AS en_text FROM fx_texts"),
    "renderable_text": _with(RESPONSES, f"page_id, region_id, provider, {strip('en_text')} <> '' AND NOT starts_with({strip('en_text')}, '[TL:') AND regexp_matches(en_text, '[\\p{{L}}\\p{{N}}]') AS renderable FROM fx_responses"),
    "clean_answer": _with(RESPONSES, f"""page_id, region_id, provider, {_clean("concat('```json \"Translation:  ', en_text, '\"```')")} AS answer, {_clean("concat(' Translation: ', en_text)")} AS labelled FROM fx_responses"""),
    "clean_markup": f"SELECT page_id, md5({_MARKUP}) AS text_md5, CAST(length({_MARKUP}) AS INT) AS n_chars FROM pages",
    "valid_translation": f"WITH {RESPONSES}, {VALIDATED} SELECT page_id, region_id, provider, valid FROM validated",
    "fast_hash": f"SELECT page_id, {hash_sql('url')} AS url_hash FROM pages",
    "cache_id": f"SELECT page_id, concat_ws(':', 'v1', 'ja', {hash_sql('url')}, {hash_sql("coalesce(html, '')")}) AS cache_id FROM pages",
    "language_hint": "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'ko' WHEN 5 THEN 'ko' WHEN 1 THEN 'zh' WHEN 2 THEN 'zh' ELSE 'ja' END AS language FROM documents",
}
