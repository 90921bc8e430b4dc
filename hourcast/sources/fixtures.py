"""Star-schema test tables -> project-hours rows and tree predictions.

The driver's test data (TPC-H-like ``orders``/``lineitem``/``customer`` ...)
holds no engineering projects, so every registered query starts from the
mappings below.  The SQL text is shared verbatim with the DuckDB oracles
(``plans.oracle``); on the Spark side the ``{name}`` placeholders are bound to
DataFrames through ``spark.sql(text, name=df)``, so no global views are used.

Scale notes: the few columns of ``lineitem`` that are read are shuffled once, by
``l_orderkey`` (the aggregate's output stays partitioned on the key, so the
orders join only shuffles ``orders``); ``customer`` joins the narrow orders
first, on its own key, broadcast or sort-merge as AQE decides from runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourcast.config import OPERATIONS, SALES_BUCKETS, SALES_BUCKET_MAP, TARGETS
from hourcast.sources.tables import read_table

_HOURS_SUMS = ",\n         ".join(
    f"sum(CASE WHEN l_partkey % 12 = {i} THEN l_quantity END) AS h{i}" for i in range(12)
)
_HOURS_COLS = ",\n  ".join(f"h{i} AS {t}" for i, t in enumerate(TARGETS))

_LINES_SQL = f"""
  SELECT l_orderkey,
         count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_supp, count(DISTINCT l_partkey) AS n_part,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret,
         max(l_linenumber) AS max_ln, sum(l_quantity) AS qty, max(l_quantity) AS max_qty, min(l_quantity) AS min_qty,
         {_HOURS_SUMS}
  FROM {{lineitem}} GROUP BY l_orderkey"""

# One raw project row per order; messy text on purpose (see FIXTURES.md).
_ROWS_SQL = f"""
SELECT
  CASE WHEN o_orderkey % 50 = 7 THEN NULL
       ELSE concat('P', cast(cast((2*o_orderkey - (2*o_orderkey) % 3) / 3 AS bigint) AS string)) END AS project_id,
  2 - o_orderkey % 3 AS upload_seq, o_orderkey AS row_idx,
  CASE o_orderkey % 10 WHEN 0 THEN 'no' WHEN 1 THEN ' YES ' WHEN 2 THEN 'True' WHEN 3 THEN '1'
       WHEN 4 THEN NULL WHEN 5 THEN '1.0' ELSE 'yes' END AS include_in_training,
  CASE o_orderstatus WHEN 'P' THEN 'Actuals ' WHEN 'F' THEN 'actuals' ELSE 'quote' END AS dataset_role,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS industry_segment,
  o_orderpriority AS system_category,
  CASE o_custkey % 3 WHEN 0 THEN 'Semi-Automatic' WHEN 1 THEN 'Robotic' ELSE 'Hard Automation' END AS automation_level,
  concat('PLC-', cast(o_custkey % 5 AS string)) AS plc_family,
  concat('HMI-', cast(o_custkey % 4 AS string)) AS hmi_family,
  CASE WHEN o_custkey % 6 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN '2D' ELSE 'None' END AS vision_type,
  CASE WHEN o_orderkey % 23 = 0 THEN 'n/a' ELSE cast(n_lines AS string) END AS stations_count,
  ' ' || cast(n_supp AS string) || ' ' AS robot_count,
  cast(n_part AS string) AS fixture_sets, cast(n_ret AS string) AS part_types,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE cast(max_ln AS string) END AS servo_axes,
  cast(n_ret + n_lines AS string) AS pneumatic_devices, cast(o_orderkey % 4 AS string) AS safety_doors,
  qty AS weldment_perimeter_ft, max_qty AS fence_length_ft, min_qty AS conveyor_length_ft,
  cast(1 + o_custkey % 5 AS double) AS product_familiarity_score, cast(1 + o_orderkey % 5 AS double) AS product_rigidity,
  CASE o_orderkey % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN 'y' ELSE NULL END AS is_product_deformable,
  CASE WHEN o_custkey % 4 = 0 THEN '1' ELSE '0' END AS is_bulk_product,
  cast(1 + o_custkey % 4 AS double) AS bulk_rigidity_score,
  CASE WHEN o_orderkey % 9 = 0 THEN 'yes' ELSE 'no' END AS has_tricky_packaging,
  cast(1 + (o_orderkey + o_custkey) % 5 AS double) AS process_uncertainty_score,
  cast(5 * (o_orderkey % 7) AS double) AS changeover_time_min, cast(o_custkey % 8 AS string) AS safety_devices_count,
  cast(o_orderkey % 101 AS double) AS custom_pct,
  CASE WHEN o_orderkey % 8 = 0 THEN 'Yes' ELSE 'No' END AS duplicate,
  CASE o_orderkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN '1' WHEN 4 THEN '1.0' ELSE NULL END AS has_controls,
  CASE WHEN n_supp > 2 THEN 'yes' ELSE 'no' END AS has_robotics,
  CASE WHEN o_custkey % 7 = 0 THEN 'true' ELSE 'false' END AS Retrofit,
  cast(1 + n_lines % 5 AS double) AS complexity_score_1_5, cast(o_orderkey % 3 AS string) AS vision_systems_count,
  cast(o_custkey % 3 AS double) AS panel_count, cast(n_lines AS double) AS drive_count,
  cast(25 * n_lines AS string) AS i_o_points_est,
  CASE WHEN o_orderkey % 29 = 0 THEN 'TBD'
       ELSE concat('$', cast(cast((cast(floor(o_totalprice) AS bigint) - cast(floor(o_totalprice) AS bigint) % 1000) / 1000 AS bigint) AS string),
                   ',', lpad(cast(cast(floor(o_totalprice) AS bigint) % 1000 AS string), 3, '0')) END AS quoted_materials_cost{{extra}},
  {_HOURS_COLS}
"""
PROJECTS_SQL = f"""
WITH li AS ({_LINES_SQL}){_ROWS_SQL}FROM {{orders}} LEFT JOIN li ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey
"""

# Spark's way to the same rows: its plan of two distinct counts makes three wide
# rows of each line item, so here the places of an order's suppliers and parts are
# counted in two sorts behind one shuffle of the few columns that are read.
_COUNTED = {
    f"count(DISTINCT {c})": f"max({c}_place) - max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in ("l_suppkey", "l_partkey")
}
_LINE_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")

# A given log-cost column: all null in upload 0 (so it is derived there) and
# partly null in uploads 1 and 2 (so it is kept, nulls included).
LOG_COST_GIVEN = (
    ",\n  CASE WHEN o_orderkey % 3 = 2 OR o_orderkey % 4 = 0 THEN CAST(NULL AS double)"
    " ELSE cast(o_orderkey % 13 AS double) + 0.5 END AS log_quoted_materials_cost"
)

_OP_CASE = " ".join(f"WHEN {i} THEN '{op}'" for i, op in enumerate(OPERATIONS))

# lineitem read as long-form per-tree predictions: quote = supplier,
# operation = part key mod 12, one "tree" value per line item.
TREES_SQL = f"""
SELECT l_suppkey AS quote_id,
       CASE l_partkey % 12 {_OP_CASE} END AS operation,
       l_quantity + 60 * (l_suppkey % 3) AS tree_value
FROM {{lineitem}}
"""

_BUCKET_CASE = " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(SALES_BUCKETS))
_BUCKET_SIZE_CASE = " ".join(
    f"WHEN '{b}' THEN {sum(1 for v in SALES_BUCKET_MAP.values() if v == b)}" for b in SALES_BUCKETS
)
_BUCKET_ARRAY = ", ".join(f"'{b}'" for b in SALES_BUCKETS)

# Quoted hours per (supplier, bucket); every 5th (quote + ord) is missing.
QUOTED_SQL = f"""
WITH qb AS (
  SELECT s_suppkey AS quote_id, __BUCKETS__ AS bucket FROM {{supplier}}),
qo AS (
  SELECT quote_id, bucket, CASE bucket {_BUCKET_CASE} END AS ord, CASE bucket {_BUCKET_SIZE_CASE} END AS k FROM qb)
SELECT quote_id, bucket,
       CASE WHEN (quote_id + ord) % 5 = 0 THEN CAST(NULL AS double)
            ELSE CAST(k * (25 + 60 * (quote_id % 3)) + (quote_id * 7 + ord * 13) % 61 - 30 AS double) END AS quoted_hours
FROM qo
"""


def projects_sql(with_log_cost: bool = False) -> str:
    return PROJECTS_SQL.replace("{extra}", LOG_COST_GIVEN if with_log_cost else "")


def project_rows(spark: SparkSession, sf_dir: str, with_log_cost: bool = False) -> DataFrame:
    """Raw project-hours rows (all uploads) derived from orders/lineitem/customer."""
    orders = spark.sql(
        "SELECT * FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
        orders=read_table(spark, sf_dir, "orders"),
        customer=read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"),
    )
    text = _ROWS_SQL.replace("{extra}", LOG_COST_GIVEN if with_log_cost else "")
    return spark.sql(
        text + "FROM {orders} LEFT JOIN {lines} ON l_orderkey = o_orderkey",
        orders=orders,
        lines=order_lines(spark, read_table(spark, sf_dir, "lineitem")),
    )


def order_lines(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    """The ``li`` part of the SQL: one row per order that has line items; lines without an order join none and are left out."""
    lines = lineitem.select(*_LINE_COLS).filter("l_orderkey IS NOT NULL").repartition("l_orderkey")
    for c in ("l_suppkey", "l_partkey"):
        lines = lines.withColumn(f"{c}_place", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy(c)))
    text = _LINES_SQL
    for distinct, counted in _COUNTED.items():
        text = text.replace(distinct, f"cast({counted} AS bigint)")
    return spark.sql(text, lineitem=lines)


def tree_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form per-tree predictions ``(quote_id, operation, tree_value)``."""
    return spark.sql(TREES_SQL, lineitem=read_table(spark, sf_dir, "lineitem"))


def quoted_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted hours per (quote, bucket) derived from ``supplier``."""
    return spark.sql(spark_quoted_sql(), supplier=read_table(spark, sf_dir, "supplier"))


def spark_quoted_sql() -> str:
    return QUOTED_SQL.replace("__BUCKETS__", f"explode(array({_BUCKET_ARRAY}))")


def duckdb_quoted_sql() -> str:
    return QUOTED_SQL.replace("__BUCKETS__", f"unnest([{_BUCKET_ARRAY}])")
