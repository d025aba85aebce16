"""Vehicle tracks derived from the star-schema test tables, in SQL that Spark and DuckDB read alike.

Ten rows a second for each vehicle; vehicles enter at different frames, some have a gap, some drive in the other
direction, some change lanes. A recording holds eight vehicles; recordings alternate between two data sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed text: the definition of the fixture. {lineitem} stands for the table.
CTE = """ranked AS (
  SELECT CAST(floor(l_suppkey / 3) AS BIGINT) AS id, l_quantity AS q, l_discount AS d, l_tax AS t,
         row_number() OVER (PARTITION BY CAST(floor(l_suppkey / 3) AS BIGINT)
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS p
  FROM {lineitem}),
shaped AS (
  SELECT id, q, d, t, CASE WHEN id % 4 = 3 THEN -1 ELSE 1 END AS dir,
         p + (id % 3) * 10 + CASE WHEN id % 7 = 3 AND p >= 250 THEN 3 ELSE 0 END AS frame,
         CAST(25 AS DOUBLE) + (id % 5) * CAST(0.2 AS DOUBLE) AS base, (id * 37) % 120 AS off,
         id % 3 + CASE WHEN id % 5 = 0 AND p >= 300 THEN 1 ELSE 0 END AS lane
  FROM ranked),
tracks AS (
  SELECT CASE WHEN CAST(floor(id / 8) AS BIGINT) % 2 = 0 THEN 'corridor_a' ELSE 'corridor_b' END AS dataset_name,
         concat('rec_', CAST(CAST(floor(id / 8) AS BIGINT) AS STRING)) AS source_file, id,
         CAST(frame AS BIGINT) AS frame,
         dir * (base * frame / CAST(10 AS DOUBLE) + off) + (q - 25) / CAST(500 AS DOUBLE) AS x,
         dir * (lane * CAST(3.5 AS DOUBLE) + (d - CAST(0.05 AS DOUBLE)) * 2) AS y,
         dir * base + (t - CAST(0.04 AS DOUBLE)) AS xVelocity,
         d - CAST(0.05 AS DOUBLE) AS yVelocity, CAST(lane AS BIGINT) AS laneId,
         CAST(1118846979700 AS BIGINT) + CAST(frame AS BIGINT) * 100 AS global_time_ms
  FROM shaped)"""


def track_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql("WITH " + CTE + " SELECT * FROM tracks", lineitem=lineitem)
