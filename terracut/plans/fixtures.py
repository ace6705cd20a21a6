"""Plan-sheet tables derived from the driver's star-schema tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "spans": """SELECT p_brand AS sheet_id, p_partkey AS seq,
 CASE CAST(p_partkey % 6 AS INT)
   WHEN 0 THEN CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING)
   WHEN 1 THEN concat('EL. ', CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING))
   WHEN 2 THEN CAST(CAST(floor(p_retailprice) AS INT) AS STRING)
   WHEN 3 THEN concat('SCALE: 1" = ', CAST(p_size AS STRING), ' ft')
   WHEN 4 THEN 'TC' ELSE upper(p_name) END AS text,
 CAST((p_partkey*389+17)%997 AS DOUBLE) AS x,
 CAST((p_partkey*p_partkey*71+p_partkey*211)%991 AS DOUBLE) AS y
FROM {part}""",
    "samples": """SELECT p_brand AS site_id,
 CASE WHEN p_partkey%2=0 THEN 'existing' ELSE 'proposed' END AS surface, p_partkey AS seq,
 CAST((p_partkey*389+17)%997 AS DOUBLE) AS x_ft,
 CAST((p_partkey*p_partkey*71+p_partkey*211)%991 AS DOUBLE) AS y_ft, p_retailprice AS z
FROM {part}""",
    "points": """SELECT concat('Brand#', CAST(1 + l_orderkey % 25 AS STRING)) AS sheet_id, l_orderkey AS poly_seq,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,
      l_quantity,l_extendedprice,l_shipdate)-1 AS INT) AS pos,
 CAST((l_partkey*389+17)%997 AS DOUBLE) AS x,
 CAST((l_suppkey*53+l_linenumber*131+l_partkey*7)%991 AS DOUBLE) AS y
FROM {lineitem}""",
    "kinds": """SELECT concat('Brand#', CAST(1 + o_orderkey % 25 AS STRING)) AS sheet_id, o_orderkey AS poly_seq,
 CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 'existing' WHEN 1 THEN 'topo' WHEN 2 THEN 'structure' ELSE 'proposed' END AS kind,
 CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 900.0 + o_custkey % 40 END AS z
FROM {orders}""",
    "ink": """SELECT user_id AS stroke_id,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id)-1 AS INT) AS pos,
 CAST(floor(value) % 256 AS INT) AS gray, (floor(value) % 256) < 185 AS ink
FROM {events}""",
    "segments": """SELECT o_custkey % 25 AS sheet_id, o_orderkey AS seq,
 CAST((o_orderkey*389+17)%997 AS DOUBLE) AS x1, CAST((o_custkey*211+5)%991 AS DOUBLE) AS y1,
 CAST((o_orderkey*389+17)%997 + (o_custkey%91) - 45 AS DOUBLE) AS x2,
 CAST((o_custkey*211+5)%991 + (o_orderkey%61) - 30 AS DOUBLE) AS y2,
 CAST((o_orderkey%20)/10.0 AS DOUBLE) AS w, CAST((o_custkey%10)/10.0 AS DOUBLE) AS color0
FROM {orders}""",
    "dashes": """SELECT sheet_id, seq, CAST(CASE WHEN line % 4 >= 2 THEN 60 + 30 * line ELSE a END AS DOUBLE) AS x1, CAST(CASE WHEN line % 4 >= 2 THEN a ELSE 60 + 30 * line END AS DOUBLE) AS y1,
 CAST(CASE WHEN line % 4 >= 2 THEN 60 + 30 * line ELSE b END AS DOUBLE) AS x2, CAST(CASE WHEN line % 4 >= 2 THEN b ELSE 60 + 30 * line END AS DOUBLE) AS y2,
 CAST(CASE WHEN line % 2 = 1 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS w, CAST(0.0 AS DOUBLE) AS color0
FROM (SELECT *, 40 + piece * (20 + line % 5) AS a, 40 + piece * (20 + line % 5) + CASE WHEN line % 2 = 1 THEN 16 + line % 5 WHEN piece % 3 = 0 THEN 18 ELSE 5 END AS b
 FROM (SELECT sheet_id, seq, CAST(floor(r / 12) AS INT) AS line, r % 12 AS piece, n FROM (SELECT concat('S', p_partkey % 5) AS sheet_id, p_partkey AS seq,
  row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) - 1 AS r, count(*) OVER (PARTITION BY p_partkey % 5) AS n FROM {part}) t) u WHERE (line + 1) * 12 <= n) v""",
    "pixels": """SELECT concat('G', user_id % 5) AS sheet_id, CAST(floor(user_id / 5) AS INT) AS y, x, v
FROM (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS x, CAST(floor(value) % 256 AS INT) AS v, count(*) OVER (PARTITION BY user_id) AS n FROM {events}) t WHERE n >= 40 AND x < 40""",
    "titles": """SELECT p_brand AS sheet_id, p_partkey AS seq, CAST((p_partkey*389+17)%997 AS DOUBLE) AS x0, CAST((p_partkey*p_partkey*71+p_partkey*211)%991 AS DOUBLE) AS y0,
 CAST((p_partkey*389+17)%997 + 80 AS DOUBLE) AS x1, CAST((p_partkey*p_partkey*71+p_partkey*211)%991 + 12 AS DOUBLE) AS y1,
 CASE CAST(p_partkey % 19 AS INT) WHEN 0 THEN 'MAP LEGEND' WHEN 1 THEN 'General Notes' WHEN 2 THEN 'SHEET TITLE' WHEN 3 THEN 'SCALE: 20' WHEN 4 THEN 'EXISTING' WHEN 5 THEN 'CONTOUR' WHEN 6 THEN 'PROPERTY LINE'
   WHEN 7 THEN 'CURB' WHEN 8 THEN 'CUT' WHEN 9 THEN 'TREE' WHEN 10 THEN 'RIP RAP' WHEN 11 THEN 'CURB CUT' WHEN 12 THEN ' : silt fence - ' WHEN 13 THEN '12.5' WHEN 14 THEN 'CONCRETE SIDEWALK'
   WHEN 15 THEN 'HEAVY  DUTY CONCRETE' WHEN 16 THEN 'LEGEND' ELSE upper(p_name) END AS text
FROM {part}""",
    "notes": """SELECT concat('N', CAST(sheet AS STRING)) AS sheet_id, seq,
 CASE WHEN sheet % 7 = 0 AND k = 5 THEN concat('SCALE: 1" = ', CAST(n AS STRING), '.5 ft')
   WHEN sheet % 7 = 1 AND k = 3 THEN concat('1"=', CAST(n AS STRING), chr(39))
   WHEN sheet % 7 = 2 AND k = 4 THEN 'SCALE:' WHEN sheet % 7 = 2 AND k = 9 THEN '1" =' WHEN sheet % 7 = 2 AND k = 12 THEN concat(CAST(n AS STRING), ' feet')
   WHEN sheet % 7 = 3 AND k = 6 THEN 'scale' WHEN sheet % 7 = 3 AND k = 7 THEN ': 1"' WHEN sheet % 7 = 3 AND k = 8 THEN concat('= ', CAST(n AS STRING)) WHEN sheet % 7 = 3 AND k = 9 THEN 'FT'
   WHEN sheet % 7 = 4 AND k = 2 THEN 'SCALE: 1" = 500 ft' WHEN sheet % 7 = 4 AND k = 7 THEN 'SCALE 1"=0.5 ft'
   WHEN sheet % 7 = 5 AND k = 2 THEN 'Scale - 1=900ft' WHEN sheet % 7 = 5 AND k = 6 THEN concat('1” = ', CAST(n AS STRING), ' ’ SCALE: 1" = 500 feet')
   ELSE upper(p_name) END AS text,
 CAST(CASE WHEN sheet % 7 = 2 AND k IN (4, 9, 12) THEN 100 + k WHEN sheet % 7 = 3 AND k BETWEEN 6 AND 9 THEN (k - 6) * 250 ELSE 400 + (seq*389+17)%500 END AS DOUBLE) AS x,
 CAST(CASE WHEN sheet % 7 = 2 AND k IN (4, 9, 12) THEN 100 + k WHEN sheet % 7 = 3 AND k BETWEEN 6 AND 9 THEN 50 ELSE 300 + (seq*seq*71+seq*211)%600 END AS DOUBLE) AS y
FROM (SELECT CAST(floor(p_partkey / 16) AS INT) AS sheet, p_partkey AS seq, p_partkey % 16 AS k, p_size AS n, p_name FROM {part}) t""",
    "crossed": """SELECT sheet_id, seq, CASE WHEN down THEN c + s ELSE a END AS x1, CASE WHEN down THEN a ELSE c + s END AS y1, CASE WHEN down THEN c - s ELSE b END AS x2, CASE WHEN down THEN b ELSE c - s END AS y2,
 CAST(1.3 AS DOUBLE) AS w, CAST(0.0 AS DOUBLE) AS color0
FROM (SELECT CAST(floor(p_partkey / 60) AS INT) AS sheet_id, p_partkey AS seq, p_partkey % 2 = 1 AS down, CAST(100 + 30 * floor((p_partkey % 6) / 4) + 3 * floor((p_partkey % 6) / 2) + (p_partkey * 7) % 3 AS DOUBLE) AS c,
  CAST((p_partkey * 5) % 4 * 0.25 - 0.375 AS DOUBLE) AS s, CAST(40 + floor((p_partkey % 60) / 6) * (22 + p_size % 4) AS DOUBLE) AS a, CAST(40 + floor((p_partkey % 60) / 6) * (22 + p_size % 4) + 10 + p_size % 17 AS DOUBLE) AS b FROM {part}) t""",
    "sheets": """SELECT DISTINCT p_brand AS sheet_id, CASE WHEN p_brand LIKE '%1' THEN 'existing' ELSE 'proposed' END AS role FROM {part}""",
    "truth": """SELECT p_brand AS site_id, CAST(sum(p_size) * 40.0 AS DOUBLE) AS cut_cy, CAST(CASE WHEN min(p_size) > 1 THEN 0 ELSE max(p_partkey) END AS DOUBLE) AS fill_cy FROM {part} GROUP BY p_brand""",
    "frames": """SELECT p_brand AS site_id, CAST(500 + max(p_size) AS DOUBLE) AS pw, CAST(400 + min(p_size) AS DOUBLE) AS ph, CAST(450 + min(p_size) AS DOUBLE) AS ew, CAST(max(p_size) AS DOUBLE) AS eh FROM {part} GROUP BY p_brand""",
}
TABLES = {"notes": "part", "crossed": "part", "dashes": "part", "pixels": "events", "titles": "part", "spans": "part", "samples": "part", "points": "lineitem", "kinds": "orders", "ink": "events", "segments": "orders", "sheets": "part", "truth": "part", "frames": "part"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = TABLES[name]
    return spark.sql(VIEWS[name], **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def with_views(*names: str) -> str:
    """WITH clause of the views for DuckDB, over the driver's tables."""
    return "WITH " + ", ".join(f"fx_{n} AS ({VIEWS[n].format(**{TABLES[n]: TABLES[n]})})" for n in names)
