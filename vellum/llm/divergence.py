r"""Divergence of the sources of a corpus, term by term, from wide term vectors; DataFrame functions only.

Terms are the matches of `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` (letters, and all beyond ASCII) with A-Z lower-cased. A language
keeps the V terms that at least `least_docs` of its documents hold. A group (language, source), or a whole language, with N occurrences
of kept terms gives a term that it holds `count` times the share p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)).

One pass over the texts counts (language, source, term), pre-aggregated before the shuffle. Each kept term then becomes one wide
row: an array over the sources of its language, in their order, with the shares. Higher-order functions on that array emit the
contribution |p_a - p_b| of each pair of sources a < b, partial sums meet it in the same stage, and one row a pair and task is
shuffled. So traffic is terms times sources once, and then pairs; a frequent term or a large source is one array or one
place in each, not a group. Wide rows meet the arrays of their language in a salted equi-join, so a language with most terms is spread.

All numbers are longs, products with 10**9 are divided in three steps of 10**3: exact while 1000 * (N + 5 * V) is below 2**63.

Cases: null text, lang and source are ''; empty texts make their group but no term; very long texts are one row; repeated rows are
documents of their own; equal values rank by item in UTF-8 order; an empty table gives an empty result; a language that keeps no term
gives all its pairs the value 0; a language with one source has no pair. Other columns, whatever they are called, are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Fixed value: what stands between terms.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE_STEP, STEPS, SMOOTH = 1000, 3, 5


def lowered(text: Column) -> Column:
    """A-Z lower-cased, and no other letter; lower() does that to texts of ASCII alone, much faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group. Texts are split, as Spark's split() is linear in a
    text; the empty strings at their ends, and of texts without a term, stay as the term '', so each group has a row."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    terms = docs.select(read(lang).alias("lang"), read(source).alias("source"), F.sort_array(F.split(lowered(read(text)), GAP)).alias("terms"))
    # in a sorted array a term is new where it differs from the one before it; zipped, as compiled code runs through both, and the longer array ends with no term
    before = F.concat(F.array(F.lit(None).cast("string")), "terms")
    each = terms.select("lang", "source", F.inline(F.arrays_zip(F.col("terms").alias("term"), before.alias("before")))).toDF("lang", "source", "term", "before").where("term is not null")
    return each.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("term") == F.col("before"), 0).otherwise(1)).alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * count / total) of longs, count <= total, in steps that stay in longs."""
    left, out = count, F.lit(0).cast("long")
    for _ in range(STEPS):
        left = left * F.lit(SCALE_STEP).cast("long")
        out = out * SCALE_STEP + F.call_function("div", left, total)
        left = left % total
    return out + 1


def audit(docs: DataFrame, least_docs: int = 30, top_terms: int = 50, salts: int = 32, **columns: str) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has the distance to each other source of the language, part `term` the
    terms that a source has more of than its language, with the difference of shares, up to rank `top_terms`."""
    counts = written(term_counts(docs, **columns), "counts")
    wide = written(
        counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("own")).where(F.col("docs") >= least_docs).drop("docs"),
        "wide",
    )
    kept = wide.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    sums = wide.select("lang", F.explode("own").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    size = lambda n: n + SMOOTH * F.col("v")
    info = groups.join(kept, "lang", "left").select("lang", F.col("g.source").alias("sources"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"), F.col("g.n").alias("ns"))
    info = written(info.select("lang", "sources", F.transform("ns", size).alias("sizes"), size(F.col("n_lang")).alias("size")), "info")

    salted = info.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = wide.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(salted, ["lang", "salt"])
    smoothed = lambda n: n + F.lit(SMOOTH).cast("long")
    had = F.transform("sources", lambda s: F.coalesce(F.try_element_at("own", s), F.lit(0).cast("long")))
    counted = met.select("lang", "term", "sources", "sizes", share(smoothed(F.col("total")), F.col("size")).alias("q"), had.alias("had"))
    vectors = written(counted.select("lang", "term", "q", "had", "sources", F.zip_with("had", "sizes", lambda n, d: share(smoothed(n), d)).alias("p")), "vectors")

    n = F.size("p")
    apart = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, n), lambda y, j: F.struct(i.alias("a"), (i + 1 + j).alias("b"), F.abs(x - y).alias("f")))))
    far = vectors.select("lang", F.explode(apart).alias("x")).groupBy("lang", "x.a", "x.b").agg(F.sum("x.f").alias("f"))
    both = far.select("lang", F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b"), "f"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "f"))).alias("x")).select("lang", "x.*")
    at = info.select("lang", F.posexplode("sources").alias("a", "source"), "sources")
    others = at.select("lang", "a", "source", F.posexplode("sources").alias("b", "item")).where("a <> b")
    pairs = others.join(both, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0)).alias("value"))
    more = F.filter(F.transform("p", lambda x, i: F.struct(F.get(F.col("sources"), i).alias("source"), F.get(F.col("had"), i).alias("n"), (x - F.col("q")).alias("f"))), lambda x: (x["n"] > 0) & (x["f"] > 0))
    terms = vectors.select("lang", "term", F.explode(more).alias("x")).select("lang", "x.source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("x.f").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top_terms))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))
