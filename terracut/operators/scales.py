"""Drawing scales from text: single spans, spans put together from neighbours, the whole sheet, and a default, in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracut.functions import text as T
from terracut.operators.spatial import range_join
from terracut.params import DEFAULTS, Params
from terracut.sources.scratch import kept

#: Parts of a scale note: the word, a colon, 1, the inch sign, an equals sign, the number and its unit.
SCALE_PARTS = 7


def detect_scales(spans: DataFrame, sheets: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """sheet_id, ft_per_inch, source, confidence of every sheet. spans: sheet_id, seq, text, x, y.

    Only sheets where no span holds a scale by itself look at neighbours, and only those without such either at all spans in a row.
    """
    spans = spans.select("sheet_id", "seq", "text", "x", "y")
    first = lambda t: t.where("s IS NOT NULL").groupBy("sheet_id").agg(F.min_by(F.struct("source", "s"), "seq").alias("b"))
    alone = kept(first(spans.select("sheet_id", "seq", F.lit("pdf_span").alias("source"), T.scale(F.col("text"), params).alias("s"))), "single-spans")
    open_ = spans.join(alone, "sheet_id", "left_anti")
    # The L1 neighbours of a hint stand within a square, so the square join finds them all.
    near = range_join(open_.where(T.may_hold_scale(F.col("text"))), open_.select("sheet_id", F.col("seq").alias("near_seq"), F.col("text").alias("near_text"), "x", "y"), ["sheet_id"], params.scale_reach)
    away = F.when(F.col("seq") == F.col("near_seq"), F.lit(0.0)).otherwise((F.abs(F.col("x") - F.col("rx")) + F.abs(F.col("y") - F.col("ry"))).cast("double"))
    near = near.withColumn("away", away).withColumn("other", (F.col("seq") != F.col("near_seq")).cast("int")).where(f"other = 0 OR away < {params.scale_reach}")
    near = near.withColumn("k", F.row_number().over(W.partitionBy("sheet_id", "seq").orderBy("away", "other", "near_seq"))).where(F.col("k") <= params.scale_merge)
    merged = near.groupBy("sheet_id", "seq").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("k", "near_text"))), lambda p: p["near_text"])).alias("text"))
    merged = merged.select("sheet_id", "seq", F.lit("pdf_nearby").alias("source"), T.scale(F.col("text"), params).alias("s"))
    found = kept(alone.unionByName(first(merged)), "scales")
    best = found.unionByName(over_spans(spans.join(found, "sheet_id", "left_anti"), params))
    return sheets.select("sheet_id").distinct().join(best, "sheet_id", "left").select(
        "sheet_id",
        F.coalesce("b.s.ft_per_inch", F.lit(params.default_scale)).alias("ft_per_inch"),
        F.coalesce("b.source", F.lit("default")).alias("source"),
        F.coalesce("b.s.confidence", F.lit(0.2)).alias("confidence"),
    )


def over_spans(spans: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """sheet_id, b (source, s): the scale that all texts of a sheet give when they are read one after another.

    A note runs over SCALE_PARTS spans at most, as it has so many parts and spaces are all that may stand between them; so
    each span is read with those that follow it, and of what the pattern finds the first one on the sheet counts.
    """
    ahead = W.partitionBy("sheet_id").orderBy("seq").rowsBetween(0, SCALE_PARTS - 1)
    read = spans.where(F.length(T.stripped(F.col("text"))) > 0).withColumn("run", F.concat_ws(" ", F.collect_list("text").over(ahead)))
    number = lambda pattern: F.when(F.col("run").rlike(pattern), F.regexp_extract("run", pattern, 1).try_cast("double"))
    named, bare = number(T.NAMED_SCALE), number(T.BARE_SCALE)
    first = lambda v: F.min_by(v, F.when(v.isNotNull(), F.col("seq")))
    t = read.groupBy("sheet_id").agg(first(named).alias("named"), first(bare).alias("bare"), F.bool_or(F.contains(F.lower("text"), F.lit("scale"))).alias("sure"))
    fits = lambda c: F.when(F.col(c).between(*params.scale_range), F.col(c))
    t = t.withColumn("v", F.coalesce(fits("named"), fits("bare"))).where("v IS NOT NULL")
    return t.select("sheet_id", F.struct(F.lit("pdf_blob").alias("source"), F.struct(F.col("v").alias("ft_per_inch"), F.when(F.col("sure"), 0.95).otherwise(0.85).alias("confidence")).alias("s")).alias("b"))
