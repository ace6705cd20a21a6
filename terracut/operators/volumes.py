"""Cut and fill volumes between two surfaces on one grid, and their score against reported volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracut.params import DEFAULTS

NO_GRID = "No surface grid available for cut/fill."
NO_CELLS = "Surface grid contained no finite cells."
DONE = "Deterministic grid cut/fill (proposed - existing)."


def finite(v: Column) -> Column:
    """v, or null where it is NaN or infinite."""
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def cut_fill(grid: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cut_cy, fill_cy, net_cy, ok, message, cell_count from keys, existing, proposed (null or NaN: no data), cell_ft.

    One pass: conditional sums per key, combined before the exchange. A cell with equal surfaces counts as a cell and as
    neither cut nor fill. Volumes are cubic yards; net is fill less cut.
    """
    g = grid.withColumn("existing", finite(F.col("existing"))).withColumn("proposed", finite(F.col("proposed"))).withColumn("delta", F.col("proposed") - F.col("existing"))
    area = F.max(F.col("cell_ft") * F.col("cell_ft"))
    t = g.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("delta") < 0, -F.col("delta"))), F.lit(0.0)).alias("cut"),
        F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("delta"))), F.lit(0.0)).alias("fill"),
        area.alias("area"),
        F.count("delta").alias("cell_count"),
        F.count("existing").alias("n_existing"),
        F.count("proposed").alias("n_proposed"),
    )
    ok = F.col("cell_count") > 0
    cut, fill = (F.when(ok, F.col(c) * F.col("area") / 27.0).otherwise(0.0) for c in ("cut", "fill"))
    message = F.when((F.col("n_existing") == 0) | (F.col("n_proposed") == 0), NO_GRID).when(~ok, NO_CELLS).otherwise(DONE)
    return t.select(*keys, cut.alias("cut_cy"), fill.alias("fill_cy"), (fill - cut).alias("net_cy"), ok.alias("ok"), message.alias("message"), "cell_count")


def evaluate(volumes: DataFrame, truth: DataFrame, keys: list[str], tolerance_pct: float = DEFAULTS.tolerance_pct) -> DataFrame:
    """Errors of volumes (keys, cut_cy, fill_cy) against truth of the same columns. Keys without truth have null errors.

    A percentage is null where the truth is 0; within_tolerance asks for at least one percentage and all within it.
    """
    t = truth.select(*keys, F.col("cut_cy").alias("truth_cut_cy"), F.col("fill_cy").alias("truth_fill_cy"))
    v = volumes.select(*keys, F.col("cut_cy").alias("pred_cut_cy"), F.col("fill_cy").alias("pred_fill_cy")).join(t, keys, "left")
    error = lambda what: F.abs(F.col(f"pred_{what}_cy") - F.col(f"truth_{what}_cy"))
    share = lambda what: F.when(F.col(f"truth_{what}_cy") != 0, error(what) / F.col(f"truth_{what}_cy") * 100.0)
    shares = F.array_compact(F.array(share("cut"), share("fill")))
    net = F.abs((F.col("pred_fill_cy") - F.col("pred_cut_cy")) - (F.col("truth_fill_cy") - F.col("truth_cut_cy")))
    return v.select(
        "*", error("cut").alias("cut_abs_error"), error("fill").alias("fill_abs_error"), share("cut").alias("cut_pct_error"), share("fill").alias("fill_pct_error"), net.alias("net_abs_error"),
        F.when(F.col("truth_cut_cy").isNotNull(), (F.size(shares) > 0) & F.forall(shares, lambda p: p <= tolerance_pct)).alias("within_tolerance"),
    )


def region_totals(truth: DataFrame) -> DataFrame:
    """Headline and summed region volumes of truth reports (job, cut_cy, fill_cy, regions: map to cut_cy and fill_cy)."""
    one = truth.select("job", "cut_cy", "fill_cy", F.explode_outer("regions").alias("region", "v"))
    return one.groupBy("job", "cut_cy", "fill_cy").agg(F.sum("v.cut_cy").alias("regions_cut_cy"), F.sum("v.fill_cy").alias("regions_fill_cy"), F.count("region").alias("regions"))


def score_table(scored: DataFrame) -> DataFrame:
    """The score as text for a report; a dash where there is no percentage."""
    whole = lambda c: F.concat(F.format_number(c, 0), F.lit(" CY"))
    pct = lambda c: F.when(F.col(c).isNull(), "—").otherwise(F.concat(F.format_number(c, 1), F.lit("%")))
    rest = [c for c in scored.columns if not c.endswith(("_cy", "_error", "_tolerance"))]
    return scored.select(*rest, whole("pred_cut_cy").alias("cut"), whole("pred_fill_cy").alias("fill"), pct("cut_pct_error").alias("cut_error"), pct("fill_pct_error").alias("fill_error"))
