"""Choice, repair and parsing of provider answers; prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Rewrites that shorten, in their order, and words that go.
SHORTER = (
    (r"\bThere are lots of\b", "Many"), (r"\beveryone knows but doesn't know the name of\b", "everyone knows, not by name"), (r"\bdoes not know\b", "doesn't know"), (r"\bdo not know\b", "don't know"),
    (r"\bdo not\b", "don't"), (r"\bdoes not\b", "doesn't"), (r"\bI am\b", "I'm"), (r"\byou are\b", "you're"), (r"\bwe are\b", "we're"), (r"\bthey are\b", "they're"), (r"\bthat is\b", "that's"), (r"\bIt is\b", "It's"),
    (r"\bused to\b", "for"), (r"\bat the harbor\b", "at harbor"), (r"\bmushroom-shaped things\b", "mushroom things"), (r"\biron mushroom-shaped things\b", "iron mushrooms"), (r"\bkind of\b", "kinda"), (r"\bsort of\b", "sorta"),
)
FILLERS = "just|really|actually|basically|probably|maybe|perhaps|those|these"
STOP_WORDS = ("a", "an", "the", "of", "to", "that")
#: Provider names and aliases.
PROVIDERS = ("mistral", "github", "gemini", "openrouter", "groq", "nvidia")
ALIASES = {"google": "gemini", "google-gemini": "gemini", "gh": "github", "github-models": "github", "open-router": "openrouter", "nvidia-nim": "nvidia", "nim": "nvidia"}
COMMANDS = "(してこい|してこ|してきな|してきて)"


def provider_order(preferred: Column, explicit: Column) -> Column:
    """The preferred provider, then the comma-separated ones, then the defaults; aliases resolved, first places kept."""
    names = F.concat(F.array(F.lower(F.trim(preferred))), F.transform(F.split(explicit, ","), lambda x: F.lower(F.trim(x))), F.array(*map(F.lit, PROVIDERS)))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.coalesce(F.try_element_at(alias, x), x)), lambda x: x != ""))


def first_accepted(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Of each item's valid answers (HTTP 200) the one of the first provider, cleaned."""
    met = answers.where("http_status = 200").join(sources.select("page_id", "region_id", "text"), ["page_id", "region_id"]).where(T.valid_answer(F.col("text"), F.col("en_text")))
    first = F.row_number().over(W.partitionBy("page_id", "region_id").orderBy("provider_rank"))
    return met.withColumn("__n", first).where("__n = 1").select("page_id", "region_id", "provider", T.clean_answer(F.col("en_text")).alias("en_text"))


def translations(sources: DataFrame, accepted: DataFrame) -> DataFrame:
    """All items with their translation and where it comes from; a placeholder where no provider answered."""
    met = sources.select("page_id", "region_id", "text").join(accepted, ["page_id", "region_id"], "left")
    return met.select("page_id", "region_id", F.coalesce("en_text", T.placeholder(F.col("text"))).alias("en_text"), F.coalesce("provider", F.lit("fallback")).alias("translation_source"))


def stand_ins(answers: DataFrame) -> DataFrame:
    """(page_id, region_id, stand_in): whether translations() of the items has a placeholder, from all answers to an item, each with its text. An item's answers meet
    as flags, no text moves."""
    open_ = lambda c: F.trim(c).startswith("[TL:")
    valid = (F.col("http_status") == 200) & T.valid_answer(F.col("text"), F.col("en_text"))
    first = F.min(F.when(valid, F.struct("provider_rank", open_(T.clean_answer(F.col("en_text"))).alias("stand_in"))))
    return answers.groupBy("page_id", "region_id").agg(F.coalesce(first["stand_in"], F.bool_or(open_(T.placeholder(F.col("text"))))).alias("stand_in"))


def prompts(items: DataFrame) -> DataFrame:
    """The JSON array of a page's texts that are not blank, by id."""
    row = F.struct(F.col("region_id").alias("id"), F.trim("text").alias("source_text"))
    return items.where(F.trim("text") != "").groupBy("page_id").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("items"))


def parsed(bodies: DataFrame) -> DataFrame:
    """(page_id, provider, region_id, en_text) from answer bodies: plain or in a chat envelope, fenced or not; malformed
    bodies give nothing, the last answer for an id wins."""
    entry = "array<struct<id:string,en_text:string,translation:string,text:string>>"
    chat = F.coalesce(F.get_json_object("body", "$.choices[0].message.content"), F.get_json_object("body", "$.candidates[0].content.parts[0].text"))
    body = F.when(F.trim("body").startswith("{"), chat).otherwise(F.col("body"))
    body = T.strip(F.regexp_replace(F.regexp_replace(T.strip(body), r"(?i)^```(?:json)?", ""), r"```$", ""))
    whole = F.from_json(body, entry)
    inner = F.from_json(F.regexp_extract(body, r"(\[[\s\S]*\])", 1), entry)
    rows = bodies.select("page_id", "provider", F.posexplode(F.coalesce(F.when(body.startswith("["), whole), inner)).alias("at", "e"))
    pick = lambda c: F.nullif(c, F.lit(""))
    said = T.clean_answer(F.coalesce(pick(F.col("e.en_text")), pick(F.col("e.translation")), pick(F.col("e.text"))))
    rows = rows.select("page_id", "provider", "at", F.expr("try_cast(e.id AS int)").alias("region_id"), said.alias("en_text")).where("region_id is not null and en_text <> ''")
    return rows.groupBy("page_id", "provider", "region_id").agg(F.max_by("en_text", "at").alias("en_text"))


def shortened(df: DataFrame, text: str, budget: str) -> DataFrame:
    """short: the text within its budget of characters, by rewrites that stop as soon as it fits."""
    fits = lambda c: F.length(c) <= F.col(budget)
    rules = F.array(*[F.struct(F.lit("(?i)" + a).alias("a"), F.lit(b).alias("b")) for a, b in SHORTER])
    df = df.withColumn("__a", F.aggregate(rules, T.clean_answer(F.col(text)), lambda acc, r: F.when(fits(acc), acc).otherwise(T.squeeze(F.regexp_replace(acc, r["a"], r["b"])))))
    df = df.withColumn("__b", T.squeeze(F.regexp_replace(F.regexp_replace("__a", r"\([^)]*\)", ""), rf"(?i)\b({FILLERS})\b", "")))
    df = df.withColumn("__s", T.strip(F.element_at(F.split("__b", r"(?<=[.!?])\s+", 2), 1))).withColumn("__w", F.split("__b", " "))
    kept = F.filter("__w", lambda x: ~F.regexp_replace(F.lower(x), "^[.,!?;:]+|[.,!?;:]+$", "").isin(*STOP_WORDS))
    df = df.withColumn("__c", F.when(F.size("__w") > 3, F.array_join(kept, " ")).otherwise(F.lit("")))
    df = df.withColumn("__d", F.when(F.col("__c") != "", F.col("__c")).otherwise(F.col("__b")))
    clip = F.left(F.col("__d"), F.greatest(F.lit(12), F.col(budget)))
    clip = F.when(F.contains(clip, F.lit(" ")), T.strip(F.regexp_extract(clip, r"^([\s\S]*) [^ ]*$", 1))).otherwise(clip)
    short = F.when(fits(F.col("__a")), F.col("__a")).when(fits(F.col("__b")), F.col("__b")).when((F.length("__s") >= 8) & fits(F.col("__s")), F.col("__s")).when(fits(F.col("__d")), F.col("__d")).otherwise(F.when(clip != "", clip).otherwise(T.strip(F.left(F.col("__d"), F.col(budget)))))
    return df.withColumn("short", short).drop("__a", "__b", "__s", "__w", "__c", "__d")


def perspective(source: Column, answer: Column) -> Column:
    """Commands to another: the first 'I should go ...' becomes 'Go ...', with your for my."""
    text = T.clean_answer(answer)
    said = r"(?i)\b(?:I\s+should|I\s+need\s+to|I\s+have\s+to|I'll|I\s+will)\s+go\s+([^.!?]+)"
    found = F.regexp_extract(text, said, 0)
    deed = F.regexp_replace(T.strip(F.regexp_extract(text, said, 1)), r"(?i)\bmy\b", "your")
    at = F.position(found, text)
    fixed = F.concat(F.left(text, at - 1), F.lit("Go "), deed, F.substring(text, at + F.length(found), F.length(text)))
    out = F.when(found != "", fixed).otherwise(text)
    return F.when(source.rlike(COMMANDS), F.regexp_replace(out, r"(?i)\bbrush\s+my\s+teeth\b", "brush your teeth")).otherwise(text)
