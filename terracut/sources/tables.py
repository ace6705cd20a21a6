"""Reading and writing plan-sheet tables and truth reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<x: double, y: double>"
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
SCHEMAS = {
    "sheets": "sheet_id string, site_id string, role string, dpi int, width_px int, height_px int, page_width_in double, page_height_in double, pdf_path string, page_index int",
    "text_spans": f"sheet_id string, seq int, text string, bbox_pdf {BOX}, bbox_px {BOX}, source string",
    "vector_items": f"sheet_id string, seq int, color array<double>, width double, op string, p1 {POINT}, p2 {POINT}",
    "polylines": "sheet_id string, seq int, points array<struct<x: float, y: float>>, length_px double, source string, kind string, straightness double, mean_abs_turn double",
    "elevations": f"sheet_id string, seq int, text string, value_ft double, x double, y double, bbox {BOX}, source string, confidence double, kind string",
    "samples": "site_id string, surface string, seq long, x_ft double, y_ft double, z double",
    "gray_rows": "sheet_id string, y int, gray binary",
}
VOLUMES = "struct<cut_cy: double, fill_cy: double>"
TRUTH_FIELDS = [
    "job string", "basis string", "unit string", "source_file string", "plan_sheet string", "notes string", "cut_cy double", "fill_cy double", "net_export_import_cy double",
    "plan_files struct<grading: string, existing: string, primary_for_volumes: string>", f"regions map<string, {VOLUMES}>", "excluded_from_headline struct<stripping_cy: double, sectional_cy: double>",
]
TRUTH = ", ".join(TRUTH_FIELDS)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A plan table in Parquet, JSON lines or ORC (by the path's ending; Parquet without one), in its fixed schema."""
    reader = spark.read.schema(SCHEMAS[name])
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    return reader.json(path) if kind in ("json", "jsonl") else reader.orc(path) if kind == "orc" else reader.parquet(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Reported volumes, one JSON document for each file."""
    return spark.read.schema(TRUTH).option("multiLine", True).json(path)


def parse_truth(text: Column) -> Column:
    """A report's JSON text as a TRUTH struct; fields that it lacks are null."""
    return F.from_json(text, f"struct<{', '.join(f'{name}: {kind}' for name, kind in (part.strip().split(' ', 1) for part in TRUTH_FIELDS))}>")


def write_by_sheet(table: DataFrame, path: str) -> None:
    """Parquet partitioned by sheet, so that queries of some sheets read those alone."""
    table.repartition("sheet_id").write.mode("overwrite").partitionBy("sheet_id").parquet(path)


def saved(table: DataFrame, path: str) -> DataFrame:
    """Written as Parquet and read back: what is used many times is computed once, and later plans start from the file."""
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def polyline_points(polylines: DataFrame) -> DataFrame:
    """sheet_id, poly_seq, pos, x, y of polylines' points."""
    return polylines.select("sheet_id", F.col("seq").alias("poly_seq"), F.posexplode("points").alias("pos", "p")).select("sheet_id", "poly_seq", "pos", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
