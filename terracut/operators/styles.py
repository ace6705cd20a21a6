"""Line styles from ink profiles: runs of ink and gap, their signature, and the best style template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Gray level below which a sample is ink.
INK = 185
#: Least score of a style.
ACCEPT = 1.2
# The style templates: signature, ink share, transitions for each sample, gray of the ink.
TEMPLATES = [
    ("existing_contour", "dashed", 0.25, 0.78, 0.12, 0.55, 200.0),
    ("proposed_contour", "solid", 0.72, 1.0, 0.0, 0.12, 170.0),
    ("property_line", "dash_dot_dot", 0.35, 0.82, 0.10, 0.45, 160.0),
]
TEMPLATE = "name string, dash_signature string, ink_lo double, ink_hi double, tr_lo double, tr_hi double, gray_max double"


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], f"place int, {TEMPLATE}")


def refined(base: DataFrame, profiles: DataFrame) -> DataFrame:
    """Templates widened to what legend swatches look like. profiles: name, pattern, ink_ratio, trans_rate, mean_gray."""
    p = profiles.select("name", *[F.col(c).alias(f"__{c}") for c in ("pattern", "ink_ratio", "trans_rate", "mean_gray")])
    seen = F.col("__ink_ratio").isNotNull()
    pick = lambda old, new: F.when(seen, new).otherwise(F.col(old)).alias(old)
    return base.join(p, "name", "left").select(
        "place", "name", F.when(seen, F.coalesce("__pattern", "dash_signature")).otherwise(F.col("dash_signature")).alias("dash_signature"),
        pick("ink_lo", F.greatest(F.lit(0.05), F.least(F.col("ink_lo"), F.col("__ink_ratio") - 0.2))),
        pick("ink_hi", F.least(F.lit(1.0), F.greatest(F.col("ink_hi"), F.col("__ink_ratio") + 0.2))),
        pick("tr_lo", F.greatest(F.lit(0.0), F.least(F.col("tr_lo"), F.col("__trans_rate") - 0.1))),
        pick("tr_hi", F.least(F.lit(0.8), F.greatest(F.col("tr_hi"), F.col("__trans_rate") + 0.15))),
        pick("gray_max", F.greatest(F.col("gray_max"), F.col("__mean_gray") + 35.0)),
    )


def ink_runs(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, run, ink, size: maximal runs of equal ink flags along each stroke. samples: keys, pos, ink."""
    w = W.partitionBy(*keys).orderBy("pos")
    change = F.when(F.col("ink") == F.lag("ink").over(w), 0).otherwise(1)
    return samples.withColumn("run", F.sum(change).over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(*keys, "run", "ink").agg(F.count(F.lit(1)).alias("size"))


def run_signatures(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, transitions, pattern (solid, dashed or dash_dot_dot). Runs of one sample are noise to the pattern."""
    wide = runs.withColumn("long_ink", F.when(F.col("ink") & (F.col("size") >= 2), F.col("size")))
    t = wide.groupBy(*keys).agg(
        (F.count(F.lit(1)) - 1).alias("transitions"),
        F.count("long_ink").alias("inks"),
        F.count_if(~F.col("ink") & (F.col("size") >= 2)).alias("gaps"),
        F.median("long_ink").alias("med"),
        F.collect_list("long_ink").alias("sizes"),
    )
    longs = F.size(F.filter("sizes", lambda s: s / F.col("med") >= 1.6))
    shorts = F.size(F.filter("sizes", lambda s: s / F.col("med") <= 0.75))
    pattern = F.when((F.col("inks") <= 1) | ((F.col("inks") == 2) & (F.col("gaps") <= 2)), "solid").when((longs >= 1) & (shorts >= 2) & (F.col("inks") >= 3), "dash_dot_dot").otherwise("dashed")
    return t.select(*keys, "transitions", pattern.alias("pattern"))


def profiles(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, ink_ratio, trans_rate, mean_gray (of the ink, or of all samples without ink), pattern. samples: keys, pos, gray."""
    inked = samples.withColumn("ink", F.col("gray") < INK)
    base = inked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ink").cast("double")).alias("ink_ratio"), F.coalesce(F.avg(F.when(F.col("ink"), F.col("gray"))), F.avg("gray")).alias("mean_gray"))
    runs = run_signatures(ink_runs(inked, keys), keys)
    return base.join(runs, keys).select(*keys, "n", "ink_ratio", (F.col("transitions") / F.greatest(F.col("n") - 1, F.lit(1))).alias("trans_rate"), "mean_gray", "pattern")


def dashed_kind(transitions: Column, ink_ratio: Column, n_points: Column) -> Column:
    """existing for strokes that look dashed, else proposed."""
    return F.when((n_points >= 6) & (transitions >= 5) & (ink_ratio > 0.2) & (ink_ratio < 0.88), "existing").otherwise("proposed")


def outside(v: Column, lo: Column, hi: Column) -> Column:
    """How far v is from the range lo .. hi."""
    return F.greatest(lo - v, v - hi, F.lit(0.0))


def styles(strokes: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """keys, style, score of each stroke (ink_ratio, trans_rate, mean_gray, pattern, straightness, length_px, mean_abs_turn).

    Every stroke meets every template, a table of a few rows with a fixed size. Ties go to the first template.
    """
    c = F.col
    ink, change = outside(c("ink_ratio"), c("ink_lo"), c("ink_hi")), outside(c("trans_rate"), c("tr_lo"), c("tr_hi"))
    score = F.when(ink == 0, 1.5).otherwise(-3.0 * ink) + F.when(change == 0, 1.5).otherwise(-4.0 * change) + F.when(c("mean_gray") <= c("gray_max"), 0.5).otherwise(-0.5)
    same = c("dash_signature") == c("pattern")
    score += F.when(same & (c("pattern") == "dash_dot_dot"), 2.0).when(same, 1.2).when((c("dash_signature") == "dash_dot_dot") & (c("pattern") == "dashed"), 0.3).otherwise(0.0)
    boundary = c("name") == "property_line"
    score += F.when(boundary & (c("straightness") > 0.92) & (c("length_px") > 80), 0.8).otherwise(0.0) - F.when(boundary & (c("mean_abs_turn") > 0.14), 1.0).otherwise(0.0)
    score += F.when(~boundary & ((c("mean_abs_turn") >= 0.06) | (c("straightness") < 0.98)), 0.4).otherwise(0.0)
    scored = strokes.crossJoin(F.broadcast(base)).withColumn("score", F.round(score, 9))
    best = scored.groupBy(*keys).agg(F.max(F.struct("score", -c("place"), "name")).alias("b"))
    return best.select(*keys, F.when(c("b.score") < ACCEPT, "other").otherwise(c("b.name")).alias("style"), c("b.score").alias("score"))


def styled_kind(style: Column, kind: Column, role: Column) -> Column:
    """The kind after styling; null for property lines, which are no contours."""
    return F.when(style == "property_line", None).when(role == "existing", "existing").when(style == "existing_contour", "existing").when(style == "proposed_contour", "proposed").when(kind.isin("existing", "proposed"), kind).otherwise("proposed")


def contour_kind(kind: Column, role: Column) -> Column:
    """The kind after the last cleanup; null for structure, property and building strokes."""
    return F.when(kind.isin("structure", "property", "building"), None).when(kind.isin("existing", "proposed"), kind).otherwise(F.when(role == "existing", "existing").otherwise("proposed"))
