"""Queries for what devices write and read: chart XML, compressed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import adapters
from tessella.adapters import CHART_WIDTH, sql, table
from tessella.registry import query
from tessella.sources import charts, codec

TAG = "PACKED1\n"

ENTRIES = """, n AS (SELECT project_id, CAST(substr(split_part(thread_id, '+', 1), 2) AS INTEGER) AS n FROM cells WHERE thread_id NOT IN ('__skip__', '__empty__') GROUP BY ALL),
    own AS (SELECT project_id, 't' || n AS id, CASE WHEN n % 4 = 0 OR n = 2 THEN 10 - n END AS place, n * 30 AS r, 255 - n * 20 AS g, n * 11 AS b FROM n WHERE n % 2 = 0),
    used AS (SELECT project_id, idx, x, y, split_part(thread_id, '+', 1) AS id FROM cells WHERE thread_id NOT IN ('__skip__', '__empty__')),
    num AS (SELECT u.project_id, u.id, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, row_number() OVER (PARTITION BY u.project_id ORDER BY place NULLS LAST, first) AS number FROM (SELECT project_id, id, min(idx) AS first FROM used GROUP BY ALL) u LEFT JOIN own USING (project_id, id)),
    size AS (SELECT project_id, max(y) + 1 AS h FROM cells GROUP BY 1)"""


@query(sql("cells", ENTRIES + """
    SELECT project_id AS chart, section, CAST(place AS BIGINT) AS place, line FROM (
        SELECT project_id, 0 AS section, 0 AS place, '<?xml version="1.0" encoding="UTF-8"?>' AS line FROM size
        UNION ALL SELECT project_id, 0, 1, '<chart width="20" height="' || h || '">' FROM size
        UNION ALL SELECT project_id, 0, 2, '  <format><chartwidth>20</chartwidth><chartheight>' || h || '</chartheight></format>' FROM size
        UNION ALL SELECT project_id, 1, 3, '  <palette>' FROM size
        UNION ALL SELECT project_id, 2, number, '    <color index="' || number || '" number="' || id || '" name="' || id || '" red="' || r || '" green="' || g || '" blue="' || b || '"/>' FROM num
        UNION ALL SELECT project_id, 3, 4, '  </palette>' FROM size
        UNION ALL SELECT project_id, 3, 5, '  <fullstitches>' FROM size
        UNION ALL SELECT u.project_id, 4, idx, '    <stitch x="' || x || '" y="' || y || '" palindex="' || number || '"/>' FROM used u JOIN num USING (project_id, id)
        UNION ALL SELECT project_id, 5, 6, '  </fullstitches>' FROM size
        UNION ALL SELECT project_id, 5, 7, '</chart>' FROM size)"""))
def chart_xml_lines(spark, d):
    cells = adapters.cells(spark, d).withColumnRenamed("project_id", "chart")
    n = F.substring("id", 2, 9).cast("int")
    own = charts.used_threads(cells).select("chart", "id").distinct().select("chart", "id", n.alias("n")).where("n % 2 = 0")
    palette = own.select("chart", "id", F.when((F.col("n") % 4 == 0) | (F.col("n") == 2), 10 - F.col("n")).alias("place"), (F.col("n") * 30).alias("r"), (255 - F.col("n") * 20).alias("g"), (F.col("n") * 11).alias("b"))
    sizes = cells.groupBy("chart").agg(F.lit(CHART_WIDTH).alias("w"), (F.max("y") + 1).alias("h"))
    return charts.chart_lines(cells, palette, sizes)


@query("SELECT o_custkey AS device, o_orderkey AS id, o_orderstatus AS state, o_orderpriority AS tag, o_orderkey % 2 = 0 AS compressed FROM orders")
def device_documents_read_back(spark, d):
    """Orders as documents of their customers, every second one compressed under a tag and every other one plain, and read back."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("device"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("tag"), (F.col("o_orderkey") % 2 == 0).alias("compressed"))
    documents = codec.device_documents(o.withColumn("half", F.struct("device", "compressed")), "half", "id", "state", "tag")
    stored = documents.select("half", F.when(F.col("half.compressed"), codec.tagged(F.col("document"), TAG)).otherwise(F.col("document")).alias("stored"))
    rows = F.explode(F.from_json(codec.untagged(F.col("stored"), TAG), "array<struct<id:bigint,state:string,tag:string>>"))
    return stored.select("half.device", rows.alias("row"), "half.compressed").select("device", "row.*", "compressed")
