"""Views that shape the driver's tables like page regions, texts, bubbles and provider answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.page_masks import Pages

IMG_W, IMG_H = 800, 1200
#: The five script profiles that letters a-z are written in.
PROFILES = ("あいうえおかきくけこさしすせそたちつてとなにぬねのは", "アイウエオカキクケコサシスセソタチツテトナニヌネノハ", "日本人大小中国学生先私何時今行来見言話食飲出入立休止", "가나다라마바사아자차카타파하거너더러머버서어저처커터", "あ日イ本う人エ大お小カき中ク国け学コ生さ先シ私す何セ時")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    own = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    left, top = (F.col("l_partkey") * 37) % 700, (F.col("l_suppkey") * 53 + F.col("l_linenumber") * 40) % 1000
    return li.select(
        F.col("l_orderkey").cast("long").alias("page_id"), (F.row_number().over(own) - 1).cast("int").alias("region_id"), left.cast("int").alias("x1"), top.cast("int").alias("y1"),
        F.least(F.lit(IMG_W), left + 12 + (F.col("l_partkey") * 11) % 240).cast("int").alias("x2"), F.least(F.lit(IMG_H), top + 10 + (F.col("l_partkey") * 17 + F.col("l_suppkey")) % 420).cast("int").alias("y2"),
        F.round(F.col("l_discount") * 10, 2).alias("score"), F.col("l_quantity").cast("int").alias("txt_len"), F.lit(IMG_W).alias("img_w"), F.lit(IMG_H).alias("img_h"),
    )


def texts(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Whole documents cut into items: each stretch of 512 characters is one item of 2 to 30 and one of the rest. An empty text is
    one empty item. `dealt`: documents with a number, dealt out by it, so that few large files make many tasks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = (docs.where("doc_id IS NOT NULL").repartition("doc_id") if dealt else docs).withColumn("n", F.coalesce(F.length("text"), F.lit(0)))
    docs = docs.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("n") / 512).cast("int")) * 2 - 1)))
    first = (F.lit(2) + (F.col("doc_id") + F.floor(F.col("k") / 2) * 7) % 29).cast("int")
    docs = docs.select("doc_id", "text", "n", "k", F.when(F.col("k") % 2 == 0, first).otherwise(512 - first).alias("size"), (1 + F.floor(F.col("k") / 2) * 512 + F.when(F.col("k") % 2 == 0, 0).otherwise(first)).cast("int").alias("at"))
    part = F.substring(F.col("text"), F.col("at"), F.col("size"))
    return docs.where("k = 0 or at <= n").select(F.col("doc_id").alias("page_id"), F.col("k").cast("int").alias("region_id"), F.when(F.col("doc_id") % 6 == 5, part).otherwise(_written(F.lower(part))).alias("text"))


def placed(boxes: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with a box of its page: item k has the box k modulo their number, and its own number as region_id. Boxes of a page are
    numbered from 0. The boxes of a page are one array, so items meet them by page only and move once."""
    own = [c for c in boxes.columns if c not in ("page_id", "region_id")]
    pages = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("region_id", *own))).alias("__boxes"))
    met = items.join(pages, "page_id").withColumn("__box", F.get("__boxes", (F.col("region_id") % F.size("__boxes")).cast("int")))
    return met.select("page_id", *[c for c in items.columns if c != "page_id"], *[F.col("__box")[c].alias(c) for c in own])


def _written(low):
    """Letters of a lower-case text in the script profile of its document."""
    out = F
    for i, p in enumerate(PROFILES[:4]):
        out = out.when(F.col("doc_id") % 6 == i, F.translate(low, "abcdefghijklmnopqrstuvwxyz", p))
    return out.otherwise(F.translate(low, "abcdefghijklmnopqrstuvwxyz", PROFILES[4]))


def bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(1))))
    x, y = (F.col("o_custkey") * 29 + F.col("b") * 350) % 600, (F.col("o_custkey") * 13 + F.col("b") * 500) % 800
    return o.select(
        F.col("o_orderkey").alias("page_id"), F.col("b").cast("int").alias("bubble_id"), x.cast("int").alias("x1"), y.cast("int").alias("y1"),
        F.least(F.lit(IMG_W), x + 120 + F.col("o_custkey") % 180).cast("int").alias("x2"), F.least(F.lit(IMG_H), y + 200 + F.col("o_custkey") % 200).cast("int").alias("y2"),
    )


def responses(spark: SparkSession, sf_dir: str, *also: str, dealt: bool = False) -> DataFrame:
    """Answers of two providers to each text; `also`: columns of the texts that stay."""
    t = texts(spark, sf_dir, dealt).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(1))))
    kind = (F.col("page_id") + F.col("region_id") * 3 + F.col("p") * 2) % 5
    said = F.when(kind == 0, "").when(kind == 1, F.regexp_replace("text", r'["\s]', " ")).when(kind == 2, "[TL: missing...]").otherwise(F.concat(F.lit("Line "), F.col("page_id").cast("string"), F.lit(" "), F.col("region_id").cast("string")))
    return t.select("page_id", "region_id", F.col("p").cast("int").alias("provider_rank"), F.concat(F.lit("p"), F.col("p").cast("string")).alias("provider"), F.when((F.col("page_id") + F.col("region_id") + F.col("p")) % 7 == 0, 401).otherwise(200).alias("http_status"), said.alias("en_text"), *also)


#: A page's markup is also a raster: rows of so many characters.
ROW = 96


def _stretches(spark: SparkSession, sf_dir: str, boundary: str) -> DataFrame:
    """(page_id, p0, p1, piece): the markup of each page cut at a zero-width pattern; places are counted in characters."""
    cut = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(F.coalesce("html", F.lit("")), boundary)).alias("k", "piece"))
    end = F.sum(F.length("piece")).over(W.partitionBy("page_id").orderBy("k")).cast("int")
    return cut.select("page_id", (end - F.length("piece")).alias("p0"), end.alias("p1"), "piece")


def _rows(stretches: DataFrame, *keys: str) -> DataFrame:
    """Stretches as runs of the raster."""
    of = lambda p: F.floor(p / ROW).cast("int")
    y = F.explode(F.sequence(of(F.col("p0")), of(F.col("p1") - 1))).alias("y")
    return stretches.where("p1 > p0").select(*keys, "p0", "p1", y).select(*keys, "y", F.greatest(F.lit(0), F.col("p0") - F.col("y") * ROW).alias("x_start"), F.least(F.lit(ROW), F.col("p1") - F.col("y") * ROW).alias("x_end"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.lit(ROW).alias("w"), F.ceil(F.length(F.coalesce("html", F.lit(""))) / ROW).cast("int").alias("h"))


def ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ASCII letters and digits."""
    found = _stretches(spark, sf_dir, r"(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])").where(F.col("piece").rlike("^[A-Za-z0-9]"))
    return _rows(found, "page_id")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bubbles (page_id, bubble_id, runs): stretches of 12 characters and more outside tags, and the same a row lower, so that neighbours overlap."""
    found = _stretches(spark, sf_dir, "(?=<)|(?<=>)").where(~F.col("piece").startswith("<") & (F.length("piece") >= 12))
    numbered = found.withColumn("bubble_id", (F.row_number().over(W.partitionBy("page_id").orderBy("p0")) - 1).cast("int"))
    rows = _rows(numbered, "page_id", "bubble_id")
    twice = rows.unionByName(rows.withColumn("y", F.col("y") + 1)).join(sizes(spark, sf_dir).select("page_id", "h"), "page_id").where("y < h").drop("h")
    return twice


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text boxes over the raster that overlap: 40 characters wide and 8 rows high, one begins every third row."""
    at = sizes(spark, sf_dir).where("h > 0").select("page_id", "h", F.explode(F.sequence(F.lit(0), F.floor((F.col("h") - 1) / 3).cast("int"))).alias("box_id"))
    x = ((F.col("box_id") * 17) % 56).cast("int")
    return at.select("page_id", "box_id", x.alias("x1"), (F.col("box_id") * 3).alias("y1"), (x + 40).alias("x2"), F.least("h", F.col("box_id") * 3 + 8).alias("y2"))


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html): pages dealt out by their id, so that few large files make many tasks."""
    return table(spark, sf_dir, "pages").where("page_id IS NOT NULL").select("page_id", F.coalesce("html", F.lit("")).alias("html")).repartition("page_id")


def raster(markup: list[str]) -> Pages:
    """sizes(), ink(), contents() and windows() of pages, from their markup."""
    n = np.array([len(x) for x in markup], np.int64)
    chars = np.frombuffer("".join(markup).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = -(-n // ROW)
    page, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    at = np.arange(len(chars)) - start[page]
    row, x = at // ROW, at % ROW
    low = chars | 32
    letter = ((low >= 97) & (low <= 122) & (chars < 128)) | ((chars >= 48) & (chars <= 57))
    new, last = x == 0, (x == ROW - 1) | (at == n[page] - 1)
    begin = np.flatnonzero(letter & (new | ~np.append(False, letter[:-1])))
    end = np.flatnonzero(letter & (last | ~np.append(letter[1:], False)))
    ink = np.stack([page[begin], row[begin], x[begin], x[end] + 1], axis=1)
    cuts = np.flatnonzero((at == 0) | (chars == 60) | np.append(False, (chars == 62)[:-1]))
    long = (chars[cuts] != 60) & (np.append(cuts[1:], len(chars)) - cuts >= 12)
    own, p0, p1 = page[cuts[long]], at[cuts[long]], (np.append(cuts[1:], len(chars)) - cuts)[long]
    p1 = p0 + p1
    number = np.arange(len(own)) - np.searchsorted(own, own)
    k = np.repeat(np.arange(len(own)), (p1 - 1) // ROW - p0 // ROW + 1)
    y = np.arange(len(k)) - np.searchsorted(k, k) + p0[k] // ROW
    runs = np.stack([k, y, np.maximum(0, p0[k] - y * ROW), np.minimum(ROW, p1[k] - y * ROW)], axis=1)
    runs = np.concatenate([runs, runs + [0, 1, 0, 0]])
    count = -(-h // 3)
    of = np.repeat(np.arange(len(n)), count)
    box = np.arange(len(of)) - np.searchsorted(of, of)
    left = box * 17 % 56
    return Pages(np.full(len(n), ROW), h, ink, runs[runs[:, 1] < h[own[runs[:, 0]]]], own, number, of, box, np.stack([left, box * 3, left + 40, np.minimum(h[of], box * 3 + 8)], axis=1))
