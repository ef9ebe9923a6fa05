"""Roll-ups of a page's run, and its safety."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_report(decisions: DataFrame, translations: DataFrame) -> DataFrame:
    """Counts for each page with items and translations, in one join on the item and one roll-up by page; only accepted items
    count as translations, those without a placeholder as rendered. Translations have en_text or the flag stand_in."""
    d = decisions.select("page_id", "region_id", F.col("reason").isNull().alias("accepted"))
    t = translations.select("page_id", "region_id", F.col("stand_in") if "stand_in" in translations.columns else F.trim("en_text").startswith("[TL:").alias("stand_in"))
    both = d.join(t, ["page_id", "region_id"], "full")
    inside = F.coalesce("accepted", F.lit(False)) & F.col("stand_in").isNotNull()
    out = both.groupBy("page_id").agg(
        F.count_if(F.coalesce("accepted", F.lit(False))).alias("layout_constraints"), F.count_if(~F.coalesce("accepted", F.lit(True))).alias("rejected_layout_items"), F.count("stand_in").alias("raw_translations"),
        F.count_if(inside).alias("translations"), F.count_if(inside & F.col("stand_in")).alias("placeholder_translations"), F.count_if(inside & ~F.col("stand_in")).alias("rendered_regions"),
    ).where("layout_constraints + rejected_layout_items > 0 and raw_translations > 0")
    review = (F.col("translations") < F.col("layout_constraints")) | (F.col("rendered_regions") < F.col("translations"))
    return out.withColumn("output_safety", F.when(review, "review").otherwise("pass"))


def warnings(report: DataFrame) -> DataFrame:
    """What a reader should look at, and what makes a page's output unusable."""
    said = lambda name, a, b: F.when(F.col(a) < F.col(b), F.concat(F.lit(name + "="), F.col(a).cast("string"), F.lit("/"), F.col(b).cast("string")))
    w = F.concat_ws(";", said("translations_below_layout_constraints", "translations", "layout_constraints"), said("rendered_regions_below_translations", "rendered_regions", "translations"))
    e = F.concat_ws(";", F.when(F.col("placeholder_translations") > 0, F.concat(F.lit("placeholder_translations="), F.col("placeholder_translations").cast("string"))), F.when(F.col("rendered_regions") == 0, "no_rendered_regions"))
    return report.select("page_id", w.alias("warnings"), e.alias("errors"))


def status_warnings(statuses: DataFrame, review: tuple[str, ...] = ("fallback_clipped", "emergency", "clipped", "missing", "empty")) -> DataFrame:
    """The distinct typeset statuses of a page that need review, sorted."""
    return statuses.where(F.col("status").isin(*review)).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"))


def cache_misses(requests: DataFrame, results: DataFrame, version: str) -> DataFrame:
    """Requests (key, language) without a complete passed result of this version."""
    usable = results.where((F.col("cache_version") == version) & (F.col("status") == "pass") & (F.col("n_artifacts") == 5)).select("key", "language")
    return requests.join(usable, ["key", "language"], "left_anti")
