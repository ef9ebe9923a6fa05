"""Text rules as Column expressions: scripts, classes, predicates, cleaning."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character ranges. The wide and narrow Hangul ranges belong to different stages.
HANGUL_WIDE = "ᄀ-ᇿ㄰-㆏가-힯"
HANGUL = "가-힯"
KANA = "぀-ヿ"
KATAKANA = "゠-ヿ"
HIRAGANA = "぀-ゟ"
HAN = "㐀-鿿"
KANJI = "一-鿿"
CJK = KANA + HAN + HANGUL
#: Word lists and markers.
PUNCTUATION_MARKS = ("！", "?", "？", "…", "．", ".", "ー", "—")
SOUND_PREFIXES = ("ちゅぱ", "ちゅ", "ぴゅ", "びゅ", "にゅ", "はぁ")
SOUND_TOKENS = ("ぱ", "ず", "ぐ", "ご", "ど", "あっ", "んっ")
DIALOGUE_STEMS = ("あった", "あつ", "さむ", "いた", "やだ", "だめ", "いや", "いい", "ねえ", "ほら", "まって", "ちょっと", "あの", "すか", "これ", "それ", "なん", "すご", "こわ", "きも", "うそ")
CREDIT_MARKERS = ("原作", "作画", "漫画", "監修", "キャラクターデザイン")


def strip(c: Column) -> Column:
    """Without white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: a Column that is used n times is otherwise computed n times, at each depth."""
    return F.get(F.transform(F.array(value), body), 0)


def count(c: Column, ranges: str) -> Column:
    """Characters in the ranges; linear in the text, as one copy without them is made and not a match for each."""
    return let(c, lambda x: F.length(x) - F.length(F.regexp_replace(x, f"[{ranges}]", "")))


def alnum(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def classify(c: Column) -> Column:
    """dialogue, sfx, english or noise, by the scripts in the text."""
    clean = lambda x: F.struct(x.alias("clean"), alnum(x).alias("s"))
    numbers = lambda t: F.struct(
        F.length(t["clean"]).alias("size"), F.length(t["s"]).alias("n"), count(t["clean"], r"\p{L}").alias("letters"), count(t["clean"], "A-Za-z").alias("latin"), t["s"].rlike(r"^\p{Nd}+$").alias("digits"),
        *[count(t["s"], r).alias(name) for name, r in (("kata", KATAKANA), ("hira", HIRAGANA), ("kanji", KANJI), ("hangul", HANGUL_WIDE))],
    )
    return let(let(let(strip(c), clean), numbers), _class_of)


def _class_of(m: Column) -> Column:
    """The class of a text by its numbers."""
    n, kata, hira, kanji, hangul = (m[x] for x in ("n", "kata", "hira", "kanji", "hangul"))
    total = kata + hira + kanji + hangul
    rules = [
        (m["size"] == 0, "noise"),
        ((m["letters"] > 0) & (m["latin"] / m["letters"] > 0.20), "english"),
        ((n == 0) | m["digits"] | (total == 0), "noise"),
        ((hangul >= 3) | ((hangul >= 2) & (n >= 3)), "dialogue"),
        ((hangul > 0) & (n <= 2), "sfx"),
        ((kanji >= 2) & (hira + kata == 0), "dialogue"),
        ((kanji == 1) & (hira + kata == 0), "sfx"),
        ((kata / total >= 0.65) & (n <= 10), "sfx"),
        ((n <= 4) & (kanji == 0), "sfx"),
        ((hira == total) & (n <= 5), "sfx"),
        ((kanji >= 1) | (hira >= 3) | ((hira >= 2) & (kata >= 1)), "dialogue"),
    ]
    return first_rule(rules, "noise")


def first_rule(rules: list[tuple[Column, str]], otherwise: str | None) -> Column:
    """The outcome of the first condition that holds."""
    out = F
    for condition, outcome in rules:
        out = out.when(condition, F.lit(outcome))
    return out.otherwise(F.lit(otherwise))


def detect_language(c: Column) -> Column:
    return first_rule([(c.rlike(f"[{HANGUL}]"), "kor_Hang"), (c.rlike(f"[{KANA}]"), "jpn_Jpan"), (c.rlike(f"[{KANJI}]"), "zho_Hant")], "jpn_Jpan")


def language_hint(c: Column) -> Column:
    """A language name or code, normalised; Japanese by default."""
    low = F.lower(strip(c))
    return first_rule([(low.isin("ko", "kor", "korean", "kr"), "ko"), (low.isin("zh", "ch", "chi", "chinese", "cn", "tw"), "zh")], "ja")


def usable(c: Column) -> Column:
    """Whether a text is worth a translation."""
    def of(clean: Column) -> Column:
        marks = clean.rlike(r"(?U)^[\W_]+$")
        return F.when(clean == "", False).when(marks, (F.length(clean) <= 6) & any_of(clean, PUNCTUATION_MARKS)).when(clean.rlike(f"[{CJK}]"), True).otherwise(clean.rlike("[A-Za-z0-9]") & (F.length(clean) <= 24))

    return let(strip(c), of)


def strong_dialogue(c: Column) -> Column:
    measure = lambda x: F.struct(x.alias("clean"), *[count(x, r).alias(name) for name, r in (("hangul", HANGUL), ("kana", KANA), ("han", HAN))])

    def of(m: Column) -> Column:
        hangul, kana, han = (m[x] for x in ("hangul", "kana", "han"))
        cjk = hangul + kana + han
        return (cjk >= 4) & ((kana >= 3) | (hangul >= 3) | ((han >= 2) & (cjk >= 5)) | ((F.length(alnum(m["clean"])) >= 6) & m["clean"].rlike("[。！？!?…]")))

    return let(let(strip(c), measure), of)


def fragment(c: Column) -> Column:
    """Only letters, digits and CJK ranges."""
    return F.regexp_replace(strip(c), rf"[^\p{{L}}\p{{N}}{CJK}]", "")


def sound_fragment(c: Column) -> Column:
    """Obvious sound effects: short, of one character, or of a known sound."""
    return let(fragment(c), _sound)


def _sound(s: Column) -> Column:
    one = F.size(F.array_distinct(F.split(s, ""))) <= 1
    return (F.length(s) <= 1) | one | s.isin(*SOUND_TOKENS) | reduce(lambda a, b: a | b, [s.startswith(p) for p in SOUND_PREFIXES])


def erase_only(c: Column, width: Column, height: Column, pale: Column, dark: Column) -> Column:
    """Short kana beside dialogue that is only erased."""
    short = let(fragment(c), lambda s: ~_sound(s) & (F.length(s) <= 4))
    return short & (count(c, HAN) + count(c, HANGUL) == 0) & (count(c, KANA) >= 2) & (width <= F.greatest(F.lit(42), (height * 0.74).cast("int"))) & ((pale >= 0.34) | (dark >= 0.16))


def unescape_entities(c: Column) -> Column:
    """The five predefined entities and the no-break space, in one pass order; others stay."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_markup(c: Column) -> Column:
    """Entities resolved, tags dropped, white space squeezed."""
    return F.regexp_replace(squeeze(F.regexp_replace(unescape_entities(F.coalesce(c, F.lit(""))), r"<[^>]+>", "")), "^[ ・]+|[ ・]+$", "")


def clean_answer(c: Column) -> Column:
    """A provider's answer without fences, quotes and a leading label; at most 360 characters."""
    s = squeeze(F.regexp_replace(unescape_entities(F.coalesce(c, F.lit(""))), r"(?i)```(?:json)?", ""))
    s = F.regexp_replace(s, "^[\"'` ]+|[\"'` ]+$", "")
    return let(s, lambda x: F.left(F.when(F.lower(x).startswith("translation:"), strip(F.substring(x, len("translation:") + 1, 1 << 30))).otherwise(x), F.lit(360)))


def distinct_cjk(c: Column) -> Column:
    """The CJK characters of a text, each once, in the order of their first places."""
    return F.array_remove(F.array_distinct(F.split(F.regexp_replace(c, f"[^{CJK}]", ""), "")), "")


def valid_answer(source: Column, answer: Column) -> Column:
    """Whether a cleaned answer is a translation: not empty, a placeholder, too long or an echo of the source."""
    known = let(clean_answer(answer), lambda text: F.struct(text.alias("text"), F.length(text).alias("n"), distinct_cjk(source).alias("own"), distinct_cjk(text).alias("out")))

    def of(a: Column) -> Column:
        some = F.size(a["own"]) > 0
        echo = some & (F.size(F.array_intersect(a["own"], a["out"])) / F.greatest(F.lit(1), F.size(a["own"])) > 0.35)
        bare = some & ~a["text"].rlike("[A-Za-z0-9]")
        return F.when((a["n"] == 0) | a["text"].startswith("[TL:") | (a["n"] > 360), False).when(echo, False).when(bare, (count(source, CJK) <= 2) & (a["n"] <= 8)).otherwise(True)

    return let(known, of)


def placeholder(c: Column) -> Column:
    """What stands for a missing translation."""
    return F.when(strip(c) == "", F.lit("")).otherwise(F.concat(F.lit("[TL: "), F.left(c, F.lit(20)), F.lit("...]")))


def renderable(c: Column) -> Column:
    return let(strip(c), lambda s: (s != "") & ~s.startswith("[TL:") & s.rlike(r"[\p{L}\p{N}]"))


def budget(width: Column, height: Column) -> Column:
    """Characters that fit a box; 110 for none."""
    size = F.greatest((width * height / 70).cast("int"), (F.greatest(width, height) * 0.95).cast("int"))
    return F.when((F.coalesce(width, F.lit(0)) <= 0) | (F.coalesce(height, F.lit(0)) <= 0), 110).otherwise(F.greatest(F.lit(16), F.least(F.lit(120), size)))


#: Texts that are hashed side by side.
_SIDE = 512


def _fnv(texts: list[str]) -> list[str]:
    """fnv_hash of many texts: one step for the k-th characters of all of them."""
    taken = [np.frombuffer(t[:: max(1, len(t) // 2000)].encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(taken[i]))
    size = np.array([len(taken[i]) for i in order])
    chars = np.zeros((int(size[0]), len(order)), np.uint32)
    for k, i in enumerate(order):
        chars[: size[k], k] = taken[i]
    h = np.full(len(order), 2166136261, np.uint32)
    many = np.searchsorted(-size, -np.arange(len(chars)), side="left")  # texts that have a k-th character
    for row, n in zip(chars, many.tolist(), strict=True):
        h[:n] = (h[:n] ^ row[:n]) * np.uint32(16777619)
    h = ((h ^ np.array([len(texts[i]) for i in order], np.uint32)) * np.uint32(16777619)).view(np.int32)
    out = [""] * len(texts)
    for i, v in zip(order, h.tolist(), strict=True):
        out[i] = (("-" if v < 0 else "") + np.base_repr(abs(v), 36).lower()) if texts[i] else ""
    return out


def fnv_hash(c: Column) -> Column:
    """32-bit FNV-1a over code points taken with stride max(1, n // 2000), closed with the length; base 36, signed. Each step needs the one before, so
    texts are hashed side by side in Arrow batches."""

    def hashed(texts: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(texts), _SIDE):
            part = texts.slice(i, _SIDE).to_pylist()
            known = iter(_fnv([t for t in part if t is not None] or [""]))
            out += [None if t is None else next(known) for t in part]
        return pa.array(out, pa.string())

    hashed.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(hashed, "string")(c)


def scrubbed(c: Column) -> Column:
    """A message without bearer tokens and keys; at most 1000 characters."""
    s = F.regexp_replace(c, r"Bearer\s+[A-Za-z0-9_.\-]+", "Bearer [REDACTED]")
    return F.left(F.regexp_replace(s, r"key=([^&\s]+)", "key=[REDACTED]"), F.lit(1000))


def health_url(c: Column, otherwise: str = "http://127.0.0.1:8766/v1/health") -> Column:
    """The health address of a service address, without query and fragment; prefixes before /v1/ stay for the image and
    snapshot calls."""
    path = F.regexp_extract(c, r"^https?://[^/?#]+([^?#]*)", 1)
    own = F.when(path.rlike(r"/v1/translate-(image|snapshot)$"), F.regexp_replace(path, r"/v1/translate-(image|snapshot)$", "/v1/health")).when(path.rlike(r"/translate-(image|snapshot)$"), path).otherwise("/v1/health")
    return F.when(c.rlike(r"^https?://[^/?#]+"), F.concat(F.regexp_extract(c, r"^(https?://[^/?#]+)", 1), own)).otherwise(otherwise)
