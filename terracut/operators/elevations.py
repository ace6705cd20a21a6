"""Elevation callouts of text spans: reading, cleaning and collapsing them, for any number of sheets at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from terracut.functions import text as T
from terracut.functions.geometry import in_any_bbox, in_bbox
from terracut.operators.spatial import around, bucket, found_within
from terracut.params import DEFAULTS, Params
from terracut.sources.scratch import kept

CALLOUT = "sheet_id string, seq long, text string, value_ft double, x double, y double, source string, confidence double, kind string"


#: Callouts of a cell that one task reads at most; pairs of callouts and spans, and bytes of texts, that it looks at in one piece.
CALLOUTS, PAIRS, TEXTS = 4096, 1 << 22, 1 << 27


def contexts(rows: DataFrame, spans: DataFrame, radius: float) -> DataFrame:
    """rows (sheet_id, x, y and others) with context: the texts of the spans around each, in order.

    Spans go to the cells within radius, as in range_join(), and meet the rows there inside tasks, so pairs are no rows and only
    contexts leave. Equal rows are one, which has each text around as often as they are.
    """
    names, cell, place = rows.columns, max(3 * float(radius), 1e-9), ["sheet_id", "__bx", "__by"]
    at = {c: F.col(c).cast("double").alias(f"__{c}") for c in ("x", "y")}
    known = (F.abs("__x") < np.inf) & (F.abs("__y") < np.inf) & F.col("sheet_id").isNotNull()
    r = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__times")).select("sheet_id", *at.values(), F.struct(*names).alias("__row"), "__times").where(known)
    s = spans.select("sheet_id", *at.values(), F.col("seq").alias("__seq"), F.col("text").alias("__text")).where(known)
    r = r.withColumns({f"__b{c}": bucket(F.col(f"__{c}"), cell) for c in ("x", "y")})
    for c in ("x", "y"):
        s = s.withColumn(f"__b{c}", around(F.col(f"__{c}") - radius, F.col(f"__{c}") + radius, cell))
    # The rows of a crowded cell are dealt to several tasks, each of which gets the cell's spans.
    is_row, w = F.col("__row").isNotNull(), W.partitionBy(*place)
    part = lambda n: F.floor((n - 1) / CALLOUTS)
    both = r.unionByName(s, allowMissingColumns=True).withColumn("__n", F.count("__row").over(w)).where("__n > 0")
    both = both.withColumn("__part", F.row_number().over(w.orderBy(F.when(is_row, 0).otherwise(1), "__y", "__x")))
    both = both.withColumn("__part", F.explode(F.when(is_row, F.array(part(F.col("__part")))).otherwise(F.sequence(F.lit(0).cast("long"), part(F.col("__n"))))))
    dealt = both.select(F.struct(*place, "__part").alias("__deal"), "__row", "__times", "__x", "__y", "__seq", "__text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        calls = table.filter(pc.is_valid(table["__row"]))
        near = table.filter(pc.is_null(table["__row"]))
        if not len(calls) or not len(near):
            return
        near = near.take(pc.sort_indices(near, [("__seq", "ascending"), ("__text", "ascending")], null_placement="at_start"))
        texts = near["__text"].cast(pa.large_string()).combine_chunks()
        said = pc.is_valid(texts).to_numpy(zero_copy_only=False)
        row, times = calls["__row"].combine_chunks(), calls["__times"].to_numpy()
        x, y, nx, ny = (t[c].to_numpy() for t in (calls, near) for c in ("__x", "__y"))
        size = (pc.sum(pc.binary_length(texts)).as_py() or 0) + len(near)
        step = max(1, min(PAIRS // len(near), TEXTS // (size * int(times.max()))))
        for i in range(0, len(x), step):
            here = slice(i, i + step)
            hit = (np.abs(x[here, None] - nx) <= radius) & (np.abs(y[here, None] - ny) <= radius)
            met = hit.any(axis=1)
            which, found = np.nonzero(hit & said)
            n = np.bincount(which, minlength=len(met)) * times[here]
            found = np.repeat(found, times[here][which])
            lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]), texts.take(pa.array(found)))
            out = pa.RecordBatch.from_arrays([row[here], pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())], names=["__row", "context"])
            yield out.filter(pa.array(met))

    schema = StructType([r.schema["__row"], StructField("context", StringType(), False)])
    return dealt.groupBy("__deal").applyInArrow(read, schema).select("__row.*", "context")


def with_context(spans: DataFrame, wanted: Column, radius: float) -> DataFrame:
    """The wanted spans (sheet_id, seq, text, x, y and others) with context: the texts around each, its own included, in order."""
    return contexts(spans.where(wanted), spans, radius)


def with_words(spans: DataFrame, wanted: Column, radius: float) -> DataFrame:
    """The wanted spans, each once, with __speaks and __match: whether its context speaks of elevations, and of matching existing ones.

    Words are looked for text by text, so no context is put together. Only "top of curb" may run over several texts: where
    no other word is near, but texts are that may begin and end it, these spans' contexts are read in order.
    """
    words = {"__speaks": T.ELEVATION_CONTEXT, "__match": T.MATCH_EXISTING, "__begins": T.CURB_BEGINS, "__ends": T.CURB_ENDS}
    said = spans.select("sheet_id", "x", "y", *[F.coalesce(F.col("text").rlike(p), F.lit(False)).alias(n) for n, p in words.items()]).where(" OR ".join(words))
    rows = spans.where(wanted).distinct()
    place = ["sheet_id", "x", "y"]
    found = rows.join(found_within(rows.select(*place).distinct(), said, ["sheet_id"], radius, list(words)), place)
    split = ~F.col("__speaks") & F.col("__begins") & F.col("__ends")
    read = contexts(found.where(split), spans, radius).withColumn("__speaks", F.col("context").rlike(T.ELEVATION_CONTEXT)).drop("context")
    return found.where(~split).unionByName(read).drop("__begins", "__ends")


def read_elevations(spans: DataFrame, role: Column, params: Params = DEFAULTS, viewport: Column | None = None, excluded: Column | None = None, source: str = "pdf_text") -> DataFrame:
    """CALLOUT rows of the spans (sheet_id, seq, text, x, y) that read as elevations inside viewport and outside excluded boxes.

    Spans that no pattern can match are dropped first, so only candidates look for words around them. Weak readings stay on
    existing sheets alone.
    """
    clean = F.regexp_replace(T.stripped(F.col("text")), ",", "")
    wanted = clean.rlike(T.DECIMAL_ELEVATION) | clean.rlike(T.WHOLE_ELEVATION)
    if viewport is not None:
        wanted &= in_bbox(F.col("x"), F.col("y"), viewport)
    if excluded is not None:
        wanted &= ~in_any_bbox(F.col("x"), F.col("y"), excluded)
    read = with_words(spans, wanted, params.context_radius).withColumn("e", T.elevation_beside(F.col("text"), F.col("__speaks"), F.col("__match"), role, params))
    read = read.where(F.col("e").isNotNull() & ((role == "existing") | (F.col("e.kind") != "weak")))
    return read.select("sheet_id", F.col("seq").cast("long").alias("seq"), "text", "e.value_ft", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(source).alias("source"), "e.confidence", "e.kind")


def ocr_elevations(spans: DataFrame, role: Column, params: Params = DEFAULTS) -> DataFrame:
    """CALLOUT rows of recognised texts (sheet_id, seq, text, x, y, score): a text is its own context, weak readings stay."""
    read = spans.withColumn("e", T.elevation(F.col("text"), F.col("text"), role, params)).where("e IS NOT NULL")
    return read.select("sheet_id", F.col("seq").cast("long").alias("seq"), "text", "e.value_ft", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit("ocr").alias("source"), F.least(F.col("score").cast("double"), F.col("e.confidence")).alias("confidence"), "e.kind")


#: Callouts of one piece that a task decides one after the other; larger pieces are decided in rounds over cells.
PIECE = 1000


def pieces_of(callouts: DataFrame, params: Params) -> DataFrame:
    """callouts with piece (a number within the sheet) and size: those of different pieces cannot conflict.

    Conflicts only reach `same_place` in x and y and `same_value_ft` in value, so a sheet's callouts are cut where
    neighbours in value, then in x, then in y, then in x again stand farther apart.
    """
    pieces, keys = callouts, ["sheet_id"]
    for k, (name, reach) in enumerate((("value_ft", params.same_value_ft), ("x", params.same_place), ("y", params.same_place), ("x", params.same_place))):
        order = W.partitionBy(*keys).orderBy(name, "seq")
        gap = F.when(F.col(name) - F.lag(name).over(order) < reach, 0).otherwise(1)
        pieces = pieces.withColumn(f"__cut{k}", F.sum(gap).over(order.rowsBetween(W.unboundedPreceding, 0)))
        keys.append(f"__cut{k}")
    sized = pieces.withColumn("__size", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    return sized.select(*callouts.columns, F.struct(*keys).alias("__piece"), "__size")


def decided_locally(pieces: DataFrame, columns: list[str], schema: StructType, params: Params) -> DataFrame:
    """The kept callouts of small pieces; many pieces share a task."""

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["confidence", "seq"], ascending=[False, True], kind="stable")
        x, y, v = (rows[c].to_numpy() for c in ("x", "y", "value_ft"))
        kept_rows: list[int] = []
        for at in rows.groupby("__piece_no", sort=False).indices.values():
            mine: list[int] = []
            for i in at:
                k = np.array(mine, int)
                if not ((np.abs(x[k] - x[i]) < params.same_place) & (np.abs(y[k] - y[i]) < params.same_place) & (np.abs(v[k] - v[i]) < params.same_value_ft)).any():
                    mine.append(i)
            kept_rows += mine
        return rows.iloc[kept_rows][columns]

    number = F.xxhash64("__piece")  # pieces that share one are only compared in vain
    return pieces.select(*columns, number.alias("__piece_no"), F.pmod(number, F.lit(1024)).alias("__task")).groupBy("__task").applyInPandas(decide, schema)


def cell_round(left: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """What one round keeps of undecided callouts, and what it leaves open.

    Callouts of one cell, as wide as conflicts reach, conflict with each other. So only the surest of a cell can be kept
    now; it is if no surer one of the cells around conflicts with it. All that conflict with a kept one are dropped. Every
    callout meets the one candidate of each cell around it, so the work is linear however many share a place.
    """
    reach = {"x": params.same_place, "y": params.same_place, "value_ft": params.same_value_ft}
    cells = left.select("*", *[F.floor(F.col(c) / r).alias(f"__{c}") for c, r in reach.items()], F.struct(-F.col("confidence"), "seq").alias("__order"))
    key = ["sheet_id", *(f"__{c}" for c in reach)]
    best = cells.groupBy(*key).agg(F.min(F.struct(F.col("__order").alias("order"), *reach)).alias("best"))
    offers = best
    for c in reach:
        offers = offers.withColumn(f"__{c}", F.explode(F.sequence(F.col(f"__{c}") - 1, F.col(f"__{c}") + 1)))

    def conflicts(rows: DataFrame, offered: DataFrame) -> DataFrame:
        near = [F.abs(F.col(c) - F.col(f"best.{c}")) < r for c, r in reach.items()]
        return rows.join(offered, key).where(near[0] & near[1] & near[2])

    beaten = conflicts(cells, offers).where(F.col("__order") < F.col("best.order")).select("sheet_id", F.col("best.order").alias("__order")).distinct()
    first = kept(best.select("sheet_id", F.col("best.order").alias("__order")).join(beaten, ["sheet_id", "__order"], "left_anti"), "kept-callouts")
    out = cells.join(first, ["sheet_id", "__order"], "left_semi")
    taken = offers.withColumn("__kept", F.col("best.order")).join(first.withColumnRenamed("__order", "__kept"), ["sheet_id", "__kept"], "left_semi")
    gone = conflicts(cells, taken.drop("__kept")).select("sheet_id", "__order").distinct()
    return out.select(*left.columns), cells.join(gone, ["sheet_id", "__order"], "left_anti").select(*left.columns)


def dedupe(callouts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Of callouts at nearly one place with nearly one value, the surest (then first) stays; decided greedily in that order.

    A callout is dropped only by one that stays, so the order of decisions matters and is kept. Callouts that can conflict
    with no other pass. Small pieces are decided by themselves, many to a task. A piece of more than PIECE callouts is
    decided by rounds over cells, all its tasks at once, and cut anew after each; rounds end when all pieces are small.
    """
    columns = callouts.columns
    pieces, out = kept(pieces_of(callouts, params), "pieces"), None
    while True:
        parts = [pieces.where("__size = 1").select(*columns), decided_locally(pieces.where(F.col("__size").between(2, PIECE)), columns, callouts.schema, params)]
        dense = pieces.where(F.col("__size") > PIECE).select(*columns)
        more = not dense.isEmpty()
        if more:
            found, left = cell_round(dense, params)
            parts.append(found)
            pieces = kept(pieces_of(left, params), "pieces")
        for part in parts:
            out = part if out is None else out.unionAll(part)
        if not more:
            return out


def collapse_pad_levels(callouts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """A value (to 0.01) that a sheet has `pad_level_count` times or more is a floor level: the callout nearest to the centre of
    all of them stands for it, as kind ffe with confidence 0.7 at most. Others stay as they are."""
    same = W.partitionBy("sheet_id", "level")
    all_same = callouts.withColumn("level", F.bround("value_ft", 2)).withColumn("n", F.count(F.lit(1)).over(same)).withColumn("cx", F.avg("x").over(same)).withColumn("cy", F.avg("y").over(same))
    nearest = F.row_number().over(same.orderBy((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2, "seq"))
    many = F.col("n") >= params.pad_level_count
    kept = all_same.withColumn("rank", nearest).where(~many | (F.col("rank") == 1))
    return kept.withColumn("confidence", F.when(many, F.least("confidence", F.lit(0.7))).otherwise(F.col("confidence"))).withColumn("kind", F.when(many, "ffe").otherwise(F.col("kind"))).select(*callouts.columns)


def drop_outliers(callouts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Without callouts farther than `outlier_ft` from their sheet's median; sheets with few callouts stay whole."""
    stats = callouts.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("__n"), F.median("value_ft").alias("__m"))
    return callouts.join(stats, "sheet_id").where((F.col("__n") < params.outlier_least) | (F.abs(F.col("value_ft") - F.col("__m")) <= params.outlier_ft)).select(*callouts.columns)


def elevations(spans: DataFrame, sheets: DataFrame, params: Params = DEFAULTS, recognised: DataFrame | None = None) -> DataFrame:
    """Clean callouts of all sheets (sheet_id, role, drawing_bbox, chrome_bboxes): read, deduped, collapsed, without outliers.

    recognised: texts read from pixels (sheet_id, seq, text, x, y, score). Those in the drawing join in on sheets whose spans
    give fewer than ocr_below callouts. Their seq must differ from the spans'.
    """
    placed = spans.join(sheets.select("sheet_id", "role", "drawing_bbox", "chrome_bboxes"), "sheet_id")
    read = read_elevations(placed, F.col("role"), params, F.col("drawing_bbox"), F.col("chrome_bboxes"))
    if recognised is not None:
        rich = read.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= params.ocr_below).select("sheet_id")
        seen = recognised.join(sheets.select("sheet_id", "role", "drawing_bbox"), "sheet_id").where(in_bbox(F.col("x"), F.col("y"), F.col("drawing_bbox"))).join(rich, "sheet_id", "left_anti")
        read = read.unionByName(ocr_elevations(seen, F.col("role"), params))
    one = dedupe(read, params)
    roles = sheets.select("sheet_id", "role")
    existing = one.join(roles.where("role = 'existing'"), "sheet_id", "left_semi")
    others = collapse_pad_levels(one.join(roles.where("role = 'existing'"), "sheet_id", "left_anti"), params)
    return drop_outliers(existing.unionByName(others), params)
