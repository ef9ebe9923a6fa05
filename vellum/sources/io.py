"""Images, data URLs, stage files and page markup as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Attributes that lazy pages keep an image's address in, in their order.
LAZY = ("data-src", "data-lazy-src", "data-original", "data-lazy", "data-url")


def read_images(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg,webp}", language: str = "ja") -> DataFrame:
    """Encoded images of a folder as pages (page_id, language, path, content)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return found.select(page_key(F.lit(language), F.col("content")).alias("page_id"), F.lit(language).alias("language"), "path", "content")


def page_key(language: Column, content: Column) -> Column:
    """A page's id: its language and the start of its content's SHA-1."""
    return F.concat(F.lit("runtime_"), language, F.lit("_"), F.left(F.sha1(content), F.lit(14)))


def ingested(pages: DataFrame, content: str = "content") -> DataFrame:
    """One row for each page_id; equal content is one page."""
    return pages.withColumn("page_id", page_key(F.col("language"), F.col(content))).dropDuplicates(["page_id"])


def decode_data_url(url: Column) -> Column:
    """The bytes of a data URL or of bare base64; null if there are none."""
    comma = F.instr(url, ",")
    coded = F.when(F.startswith(url, F.lit("data:")) & (comma > 0), F.substring(url, comma + 1, F.length(url))).otherwise(url)
    return F.unbase64(F.nullif(coded, F.lit("")))


def data_url(content: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_stage(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stage's JSON arrays, or an empty table where the stage has not run."""
    if not _there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_stage(df: DataFrame, path: str, kind: str = "parquet", buckets: int = 256) -> None:
    """A stage's rows in one folder and file for each bucket of pages, whatever the number of pages; pages of a new run replace the
    same pages only, and buckets without any stay untouched. All runs of a stage take the same number of buckets; the column
    `bucket` is the stage's own."""
    own = F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int")
    placed = df.withColumn("bucket", own)
    if _there(df.sparkSession, path):
        before = df.sparkSession.read.schema(placed.schema).format(kind).load(path)
        old = before.join(placed.select("bucket").distinct(), "bucket", "left_semi").join(df.select("page_id").distinct(), "page_id", "left_anti")
        placed = placed.unionByName(old)
    placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").format(kind).save(path)


def manifest(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols))


def artifacts(paths: Column) -> Column:
    """The entries of a map of paths that exist (are not null)."""
    return F.map_filter(paths, lambda k, v: v.isNotNull())


def image_candidates(pages: DataFrame, html: str = "html") -> DataFrame:
    """(…, place, src): the images of a page's markup with the first address they have: lazy attributes, then src."""
    tags = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?i)(<img\b[^>]*>)"), F.lit(1))).alias("place", "tag"))
    attr = lambda name: F.nullif(F.regexp_extract("tag", rf'(?i)\s{name}="([^"]*)"', 1), F.lit(""))
    lazy = [F.when(attr(a).rlike("^(http|data:image/|file:)"), attr(a)) for a in LAZY]
    return tags.select("page_id", "place", F.coalesce(*lazy, attr("src")).alias("src")).where("src is not null")


def large_enough(natural_w: str, natural_h: str, width: str, height: str, least: int = 200) -> Column:
    """Whether an image's own size, or where that is unknown (0) its set one, is that of a page."""
    side = lambda own, other: F.coalesce(F.nullif(F.col(own), F.lit(0)), F.col(other), F.lit(0)) >= least
    return side(natural_w, width) & side(natural_h, height)


def wanted() -> Column:
    """Whether an image of a page is to be translated now. Columns: src; flags enabled, forced, paused, translated, processing, known (in
    the translated set), pending, inline (data address), replaced (keeps an original address), standalone; natural_w, natural_h,
    width, height; shown_w, shown_h, at least 100 unless the image is a page of its own. Null flags are false, null sizes 0."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    busy = flag("paused") | flag("translated") | flag("processing") | flag("known") | flag("pending") | (flag("inline") & flag("replaced"))
    shown = flag("standalone") | ((F.coalesce("shown_w", F.lit(0)) >= 100) & (F.coalesce("shown_h", F.lit(0)) >= 100))
    there = F.coalesce(F.col("src") != "", F.lit(False))
    return (flag("enabled") | flag("forced")) & there & ~busy & large_enough("natural_w", "natural_h", "width", "height") & shown
