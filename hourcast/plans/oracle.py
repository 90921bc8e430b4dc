"""DuckDB oracle SQL for the registered queries (independent re-statement).

The driver registers the test tables as DuckDB views and runs these next to
``plans.catalog``.  The SQL is generated from the same fixed configuration
lists (targets, buckets, features) but re-states each operator in plain SQL:
windows and CASE where the Spark side uses partial aggregates and maps.
Fixture text carries only blank padding, so plain ``trim`` stands in for the
Unicode-aware strip; trap strings are unit-tested on the Spark side only.
"""

from __future__ import annotations

from hourcast.config import (
    BOOL_COLS,
    INDEX_TERMS,
    MODEL_VERSION,
    PLAIN_NUM_FEATURES,
    QUOTE_CAT_FEATURES,
    QUOTE_DEFAULTS,
    QUOTE_NUM_FEATURES,
    SALES_BUCKET_MAP,
    SALES_BUCKETS,
    TARGETS,
    TOP_DRIVERS,
    operation_of,
)
from hourcast.sources.fixtures import TREES_SQL, duckdb_quoted_sql, projects_sql

TABLES = {"lineitem": "lineitem", "orders": "orders", "customer": "customer", "supplier": "supplier"}
R = 6


def _tok(c: str) -> str:
    return f"lower(trim(CAST({c} AS VARCHAR)))"


def _flag(c: str) -> str:
    return f"CASE WHEN {_tok(c)} IN ('yes', 'true', '1') THEN 1 ELSE 0 END"


def _num(c: str) -> str:
    return f"TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE)"


def _money(c: str) -> str:
    return f"coalesce(TRY_CAST(regexp_replace(CAST({c} AS VARCHAR), '[$,]', '', 'g') AS DOUBLE), 0)"


def _index_exprs() -> list[str]:
    out = []
    for name, terms in INDEX_TERMS.items():
        parts = []
        for c, div in terms:
            t = f"coalesce({c}, 0)"
            parts.append(f"{t} / {div}" if div != 1.0 else t)
        out.append(f"({' + '.join(parts)}) AS {name}")
    return out


def _round_idx() -> str:
    return ", ".join(f"round({n}, {R}) AS {n}" for n in INDEX_TERMS)


RAW = projects_sql().format(**TABLES)
RAW_LOG = projects_sql(with_log_cost=True).format(**TABLES)
NUM_COLS = PLAIN_NUM_FEATURES + ["i_o_points_est"]

# C11: F1/F2, flags, numbers, hours, then indices and the derived log cost.
ENG = f"""
eng0 AS (
  SELECT * REPLACE (
    {_tok('include_in_training')} AS include_in_training,
    {_tok('dataset_role')} AS dataset_role,
    {', '.join(f'{_flag(c)} AS {c}' for c in BOOL_COLS)},
    {', '.join(f'{_num(c)} AS {c}' for c in NUM_COLS)},
    {', '.join(f'CAST({t} AS DOUBLE) AS {t}' for t in TARGETS)})
  FROM raw
  WHERE {_tok('include_in_training')} IN ('yes', '1', 'true') AND {_tok('dataset_role')} = 'actuals'),
eng AS (
  SELECT *, {', '.join(_index_exprs())},
         ln(1 + {_money('quoted_materials_cost')}) AS log_quoted_materials_cost
  FROM eng0)"""

_ANY_HOURS = "greatest(" + ", ".join(f"coalesce({t}, 0)" for t in TARGETS) + ") > 0"

TRAIN = f"""
tr AS (SELECT * FROM eng WHERE {_ANY_HOURS})"""

MASTER = """
master AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY upload_seq DESC, row_idx DESC) AS rn FROM tr)
  WHERE rn = 1)"""

MASTER_ROUNDED = f"SELECT * REPLACE ({_round_idx()}, round(log_quoted_materials_cost, {R}) AS log_quoted_materials_cost)"


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


RAW_CTE = f"raw AS ({RAW})"
MASTER_CTES = _with(RAW_CTE, ENG, TRAIN, MASTER)

# --- tree intervals, rollup, sales -------------------------------------------

_OPS = f"""
trees AS ({TREES_SQL.format(**TABLES)}),
ivl AS (
  SELECT quote_id, operation, avg(tree_value) AS p50,
         quantile_cont(tree_value, 0.1) AS p10, quantile_cont(tree_value, 0.9) AS p90,
         stddev_pop(tree_value) AS std
  FROM trees GROUP BY quote_id, operation),
ops AS (
  SELECT *, (p90 - p10) / greatest(abs(p50), 1e-6) AS rel_width FROM ivl),
opsc AS (
  SELECT *, CASE WHEN rel_width < 0.3 THEN 'high' WHEN rel_width < 0.6 THEN 'medium' ELSE 'low' END AS confidence
  FROM ops)"""

_BMAP = ", ".join(f"('{k}', '{v}')" for k, v in SALES_BUCKET_MAP.items())
_BORD = ", ".join(f"('{b}', {i})" for i, b in enumerate(SALES_BUCKETS))

_BUCKETS = f"""
bmap(operation, bucket) AS (VALUES {_BMAP}),
bord(bucket, ord) AS (VALUES {_BORD}),
bsum AS (
  SELECT quote_id, bucket, sum(p10) AS p10, sum(p50) AS p50, sum(p90) AS p90
  FROM opsc JOIN bmap USING (operation) GROUP BY quote_id, bucket),
qids AS (SELECT DISTINCT quote_id FROM opsc),
b0 AS (
  SELECT q.quote_id, o.bucket, CAST(o.ord AS INTEGER) AS ord,
         coalesce(s.p10, 0.0) AS p10, coalesce(s.p50, 0.0) AS p50, coalesce(s.p90, 0.0) AS p90
  FROM qids q CROSS JOIN bord o LEFT JOIN bsum s ON s.quote_id = q.quote_id AND s.bucket = o.bucket),
b1 AS (SELECT *, (p90 - p10) / greatest(abs(p50), 1e-6) AS rel_width FROM b0),
buckets AS (
  SELECT *, CASE WHEN rel_width < 0.3 THEN 'high' WHEN rel_width < 0.6 THEN 'medium' ELSE 'low' END AS confidence
  FROM b1)"""

_QUOTED = f"""
quoted AS ({duckdb_quoted_sql().format(**TABLES)})"""

_SUMMARY = """
summ AS (
  SELECT b.quote_id, b.ord, b.bucket AS role, b.p50 AS p50_hours,
         printf('%.1f', b.p10) || '–' || printf('%.1f', b.p90) AS range_p10_p90,
         upper(substr(b.confidence, 1, 1)) || substr(b.confidence, 2) AS confidence_label,
         q.quoted_hours, q.quoted_hours - b.p50 AS delta,
         CASE WHEN q.quoted_hours IS NULL THEN NULL
              WHEN abs(q.quoted_hours - b.p50) <= greatest(0.1 * abs(b.p50), 5) THEN 'Close'
              WHEN q.quoted_hours - b.p50 > 0 THEN 'Over model' ELSE 'Under model' END AS status
  FROM buckets b LEFT JOIN quoted q ON q.quote_id = b.quote_id AND q.bucket = b.bucket),
ranked AS (
  SELECT * EXCLUDE (ord),
         CAST(row_number() OVER (PARTITION BY quote_id ORDER BY round(p50_hours, 6) DESC, ord) AS INTEGER) AS pos
  FROM summ),
total AS (
  SELECT quote_id, 'TOTAL' AS role, sum(p50_hours) AS p50_hours, '-' AS range_p10_p90, '-' AS confidence_label,
         sum(quoted_hours) AS quoted_hours, sum(delta) AS delta, '-' AS status, CAST(count(*) + 1 AS INTEGER) AS pos
  FROM summ WHERE quote_id IN (SELECT quote_id FROM quoted) GROUP BY quote_id),
ssum AS (SELECT * FROM ranked UNION ALL BY NAME SELECT * FROM total)"""

SALES_CTES = _with(_OPS, _BUCKETS, _QUOTED, _SUMMARY)


ORACLES: dict[str, str] = {}

ORACLES["clean_flags"] = f"""
{_with(RAW_CTE)}
SELECT row_idx, {_tok('include_in_training')} AS include_in_training, {_tok('dataset_role')} AS dataset_role,
       {', '.join(f'{_flag(c)} AS {c}' for c in BOOL_COLS)}
FROM raw"""

ORACLES["clean_numbers"] = f"""
{_with(RAW_CTE)}
SELECT row_idx, {', '.join(f'round({_num(c)}, {R}) AS {c}' for c in NUM_COLS)},
       round({_money('quoted_materials_cost')}, {R}) AS materials_cost
FROM raw"""

ORACLES["cost_log_derived"] = f"""
{_with(RAW_CTE)}
SELECT row_idx, upload_seq, round(ln(1 + {_money('quoted_materials_cost')}), {R}) AS log_quoted_materials_cost
FROM raw"""

ORACLES["cost_log_kept"] = f"""
WITH raw AS ({RAW_LOG}),
f AS (SELECT upload_seq, count(log_quoted_materials_cost) = 0 AS all_null FROM raw GROUP BY upload_seq)
SELECT row_idx, upload_seq,
       round(CASE WHEN f.all_null THEN ln(1 + {_money('quoted_materials_cost')})
                  ELSE log_quoted_materials_cost END, {R}) AS log_quoted_materials_cost
FROM raw JOIN f USING (upload_seq)"""

ORACLES["complexity_indices"] = f"""
{_with(RAW_CTE)},
n AS (SELECT row_idx, {', '.join(f'{_num(c)} AS {c}' for c in NUM_COLS)} FROM raw),
i AS (SELECT row_idx, {', '.join(_index_exprs())} FROM n)
SELECT row_idx, {_round_idx()} FROM i"""

ORACLES["engineer_training"] = f"""
{_with(RAW_CTE, ENG)}
{MASTER_ROUNDED} FROM eng"""

_PREP = f"""
p0 AS (
  SELECT * REPLACE (
    {', '.join(f'{_flag(c)} AS {c}' for c in BOOL_COLS)},
    {', '.join(f'{_num(c)} AS {c}' for c in NUM_COLS)})
  FROM raw WHERE {_tok('dataset_role')} = 'quote'),
p1 AS (
  SELECT *, {', '.join(_index_exprs())}, ln(1 + {_money('quoted_materials_cost')}) AS log_quoted_materials_cost FROM p0)"""

ORACLES["prepare_quotes"] = f"""
{_with(RAW_CTE, _PREP)}
{MASTER_ROUNDED} FROM p1"""


# A quote record: six texts that must be there, numbers (text that parses is
# taken), flags as words or whole numbers; absent fields take the record's defaults.
def _record_num(c: str) -> str:
    default = float(QUOTE_DEFAULTS.get(c, 0.0))
    if c in BOOL_COLS:
        return f"CASE {_tok(c)} WHEN 'yes' THEN 1 WHEN 'true' THEN 1 WHEN 'no' THEN 0 WHEN 'false' THEN 0 ELSE CASE WHEN coalesce({_num(c)}, {default}) = 1 THEN 1 ELSE 0 END END AS {c}"
    if c in INDEX_TERMS or c == "log_quoted_materials_cost":
        return f"CAST({default} AS DOUBLE) AS {c}"
    return f"coalesce({_num(c)}, {default}) AS {c}"


def _faults() -> str:
    out = [f"CASE WHEN {c} IS NULL THEN '{c} is missing' END" for c in QUOTE_CAT_FEATURES]
    for c in _REC_BASE:
        wrong = f"{c} IS NOT NULL AND {_num(c)} IS NULL"
        if c in BOOL_COLS:
            word = f"coalesce({_tok(c)} IN ('yes', 'no', 'true', 'false'), false)"
            out.append(f"CASE WHEN ({wrong} OR {_num(c)} <> floor({_num(c)})) AND NOT {word} THEN '{c} is no flag' END")
        elif c != "log_quoted_materials_cost":
            out.append(f"CASE WHEN {wrong} THEN '{c} is no number' END")
    return f"nullif(concat_ws('; ', {', '.join(out)}), '')"


_REC_BASE = [c for c in QUOTE_NUM_FEATURES if c not in INDEX_TERMS]
_JUDGED = f"""
{_with(RAW_CTE)},
judged AS (SELECT *, row_idx AS quote_id, {_faults()} AS reason FROM raw WHERE {_tok('dataset_role')} = 'quote')"""
ORACLES["quote_records"] = f"""
{_JUDGED},
r0 AS (
  SELECT quote_id, {', '.join(QUOTE_CAT_FEATURES)},
         {', '.join(_record_num(c) for c in _REC_BASE)}, 0.0 AS i_o_points_est
  FROM judged WHERE reason IS NULL),
r1 AS (SELECT *, {', '.join(_index_exprs())} FROM r0)
SELECT * REPLACE ({_round_idx()}) FROM r1"""
ORACLES["quote_rejects"] = f"""
{_JUDGED}
SELECT quote_id, reason FROM judged WHERE reason IS NOT NULL"""

ORACLES["record_costs"] = f"""
{_JUDGED}
SELECT quote_id, round(ln(1 + {_money('quoted_materials_cost')}), {R}) AS log_quoted_materials_cost FROM judged WHERE reason IS NULL"""

_GIVEN = f"""
given AS (
  SELECT operation || '_actual_hours' AS target, '{MODEL_VERSION}' AS version, count(*) AS rows,
         round(sum(abs(tree_value - 60)) / count(*), 3) AS mae,
         round(1 - sum((tree_value - 60) * (tree_value - 60)) / (sum((tree_value - 50) * (tree_value - 50)) + 1), 3) AS r2,
         'a, "quoted" path' AS model_path
  FROM ({TREES_SQL.format(**TABLES)}) GROUP BY operation)"""
ORACLES["metrics_csv"] = f"{_with(_GIVEN)} SELECT * FROM given"
ORACLES["overview_given"] = f"{_with(_GIVEN)} SELECT count(DISTINCT target) AS operations_with_models, round(avg(mae), {R}) AS avg_mae FROM given"
ORACLES["model_quality"] = f"""
{_with(_GIVEN)}
SELECT 'mae' AS chart, replace(target, '_actual_hours', '') AS operation, mae AS value FROM given
UNION ALL SELECT 'r2', replace(target, '_actual_hours', ''), r2 FROM given"""

ORACLES["quotes_csv"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS quote_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'say "' || o_orderpriority || '", twice'
                           WHEN 1 THEN o_orderpriority || chr(10) || 'second, line' || chr(10)
                           WHEN 2 THEN '  ' || o_orderpriority || ' ' WHEN 3 THEN '""' END AS note,
       'x' || o_custkey AS last
FROM orders"""

ORACLES["trainable_rows"] = f"""
{_with(RAW_CTE, ENG, TRAIN)}
SELECT row_idx, upload_seq, project_id FROM tr"""

ORACLES["merge_master"] = f"""
{MASTER_CTES}
{MASTER_ROUNDED} FROM master"""

ORACLES["merge_uploads"] = f"""
{_with(RAW_CTE, ENG, TRAIN)},
uni AS (
  SELECT * REPLACE (CASE WHEN upload_seq = 0 THEN NULL ELSE drive_count END AS drive_count,
                    CASE WHEN upload_seq > 0 THEN NULL ELSE panel_count END AS panel_count) FROM tr),
master AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY upload_seq DESC, row_idx DESC) AS rn FROM uni)
  WHERE rn = 1)
{MASTER_ROUNDED} FROM master"""

_COUNTS = f"""
{_with(RAW_CTE, ENG, TRAIN)},
nr AS (SELECT upload_seq, count(*) AS rows_raw FROM raw GROUP BY upload_seq),
nt AS (SELECT upload_seq, count(*) AS rows_train FROM tr GROUP BY upload_seq),
fp AS (SELECT project_id, min(upload_seq) AS upload_seq FROM tr GROUP BY project_id),
np AS (SELECT upload_seq, count(*) AS new_projects FROM fp GROUP BY upload_seq),
counts AS (
  SELECT CAST(nr.upload_seq AS BIGINT) AS upload_seq, CAST(rows_raw AS BIGINT) AS rows_raw,
         CAST(coalesce(rows_train, 0) AS BIGINT) AS rows_train,
         CAST(sum(coalesce(new_projects, 0)) OVER (ORDER BY nr.upload_seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS rows_master_total
  FROM nr LEFT JOIN nt USING (upload_seq) LEFT JOIN np USING (upload_seq))"""

ORACLES["upload_counts"] = f"{_COUNTS}\nSELECT * FROM counts"
ORACLES["upload_log_tail"] = f"{_COUNTS}\nSELECT * FROM counts ORDER BY upload_seq DESC LIMIT 10"

ORACLES["tree_intervals"] = f"""
{_with(_OPS)}
SELECT quote_id, operation, round(p50, {R}) AS p50, round(p10, {R}) AS p10, round(p90, {R}) AS p90,
       round(std, {R}) AS std
FROM ivl"""

ORACLES["confidence"] = f"""
{_with(_OPS)}
SELECT quote_id, operation, round(p50, {R}) AS p50, round(p10, {R}) AS p10, round(p90, {R}) AS p90,
       round(std, {R}) AS std, round(rel_width, {R}) AS rel_width, confidence
FROM opsc"""

ORACLES["bucket_rollup"] = f"""
{_with(_OPS, _BUCKETS)}
SELECT quote_id, bucket, ord, round(p10, {R}) AS p10, round(p50, {R}) AS p50, round(p90, {R}) AS p90,
       round(rel_width, {R}) AS rel_width, confidence
FROM buckets"""

ORACLES["quote_totals"] = f"""
{_with(_OPS)}
SELECT quote_id, round(sum(p50), {R}) AS total_p50, round(sum(p10), {R}) AS total_p10,
       round(sum(p90), {R}) AS total_p90
FROM opsc GROUP BY quote_id"""

ORACLES["quoted_vs_model"] = f"""
{SALES_CTES}
SELECT quote_id, ord, role, round(p50_hours, {R}) AS p50_hours, range_p10_p90, confidence_label,
       round(quoted_hours, {R}) AS quoted_hours, round(delta, {R}) AS delta, status
FROM summ"""

ORACLES["project_status"] = f"""
{_with(_OPS, _QUOTED)},
tot AS (SELECT quote_id, sum(p50) AS total_p50 FROM opsc GROUP BY quote_id),
qt AS (SELECT quote_id, coalesce(sum(quoted_hours), 0.0) AS quoted_total FROM quoted GROUP BY quote_id)
SELECT t.quote_id, round(t.total_p50, {R}) AS model_total, round(qt.quoted_total, {R}) AS quoted_total,
       round(qt.quoted_total - t.total_p50, {R}) AS total_delta,
       CASE WHEN qt.quoted_total IS NULL THEN NULL
            WHEN abs(qt.quoted_total - t.total_p50) <= greatest(0.1 * abs(t.total_p50), 10) THEN 'Overall close to model'
            WHEN qt.quoted_total - t.total_p50 > 0 THEN 'Quoted hours above model'
            ELSE 'Quoted hours below model' END AS project_status
FROM tot t LEFT JOIN qt USING (quote_id)"""

ORACLES["project_totals_text"] = f"""
WITH st AS ({ORACLES["project_status"]})
SELECT quote_id, printf('%.1f h', model_total) AS model_total_text, printf('%.1f h', quoted_total) AS quoted_total_text,
       printf('%.1f h', total_delta) AS delta_text, project_status
FROM st"""

ORACLES["sales_summary_total"] = f"""
{SALES_CTES}
SELECT quote_id, role, round(p50_hours, {R}) AS p50_hours, range_p10_p90, confidence_label,
       round(quoted_hours, {R}) AS quoted_hours, round(delta, {R}) AS delta, status, pos
FROM ssum"""

ORACLES["melt_hours"] = f"""
{SALES_CTES}
SELECT quote_id, role, 'Recommended hours (P50)' AS source, round(p50_hours, {R}) AS hours
FROM ssum WHERE role <> 'TOTAL' AND quote_id IN (SELECT quote_id FROM total)
UNION ALL
SELECT quote_id, role, 'Quoted hours' AS source, round(quoted_hours, {R}) AS hours
FROM ssum WHERE role <> 'TOTAL' AND quote_id IN (SELECT quote_id FROM total)"""

ORACLES["explorer_filter"] = f"""
{MASTER_CTES}
{MASTER_ROUNDED} FROM master
WHERE industry_segment IS NOT NULL AND system_category IS NOT NULL
ORDER BY upload_seq, row_idx LIMIT 50"""

ORACLES["explorer_count"] = f"""
{MASTER_CTES}
SELECT count(*) AS projects FROM master WHERE industry_segment IS NOT NULL AND system_category IS NOT NULL"""

ORACLES["similar_projects"] = f"""
{MASTER_CTES}
SELECT project_id, industry_segment, system_category, robot_count, stations_count, me10_actual_hours,
       upload_seq, row_idx
FROM master WHERE industry_segment = 'BUILDING' AND robot_count BETWEEN 1 AND 3
ORDER BY upload_seq, row_idx LIMIT 50"""

ORACLES["similar_count"] = f"""
{MASTER_CTES}
SELECT count(*) AS projects FROM master WHERE industry_segment = 'BUILDING' AND robot_count BETWEEN 1 AND 3"""

# the explorer's charts: the filtered projects, each operation that can be chosen
_FILTERED = f"""
{MASTER_CTES},
filtered AS (
  SELECT * FROM master
  WHERE (industry_segment IS NOT NULL OR NOT EXISTS (SELECT 1 FROM master WHERE industry_segment IS NOT NULL))
    AND (system_category IS NOT NULL OR NOT EXISTS (SELECT 1 FROM master WHERE system_category IS NOT NULL)))"""


def _chart(c: str) -> str:
    parts = [f"SELECT '{t}' AS target, {c}, {t} AS hours FROM filtered WHERE {c} IS NOT NULL AND {t} IS NOT NULL" for t in TARGETS]
    return _FILTERED + "\n" + "\nUNION ALL\n".join(parts)


ORACLES["hours_by_project"] = _chart("project_id")
ORACLES["robots_vs_hours"] = _chart("robot_count")

ORACLES["category_values"] = f"""
{MASTER_CTES},
v AS (
  SELECT DISTINCT 'industry_segment' AS category, industry_segment AS value FROM master WHERE industry_segment IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'system_category' AS category, system_category AS value FROM master WHERE system_category IS NOT NULL)
SELECT category, value, CAST(row_number() OVER (PARTITION BY category ORDER BY value) AS INTEGER) AS pos FROM v"""

ORACLES["overview_counts"] = f"""
{MASTER_CTES}
SELECT count(*) AS projects FROM master"""


# --- training frame -------------------------------------------------------------

_FEATS = QUOTE_NUM_FEATURES + QUOTE_CAT_FEATURES
_LONG = f"""
lg0 AS (
  SELECT * FROM (
    UNPIVOT (SELECT project_id, upload_seq, row_idx, {', '.join(_FEATS)}, {', '.join(TARGETS)} FROM master)
    ON {', '.join(TARGETS)} INTO NAME target VALUE hours)
  WHERE hours > 0),
lg AS (SELECT * FROM lg0 WHERE target IN (SELECT target FROM lg0 GROUP BY target HAVING count(*) >= 5)),
sp AS (
  SELECT *,
         row_number() OVER (PARTITION BY target
                            ORDER BY md5(target || '|' || coalesce(CAST(project_id AS VARCHAR), '<null>') || '|42'), row_idx)
           <= ceil(0.25 * count(*) OVER (PARTITION BY target)) AS is_test
  FROM lg)"""
TRAIN_CTES = MASTER_CTES + "," + _LONG

ORACLES["training_long"] = f"""
{TRAIN_CTES}
SELECT project_id, upload_seq, row_idx, target, hours FROM lg"""

ORACLES["feature_coverage"] = f"""
{TRAIN_CTES},
fl(feature) AS (VALUES {', '.join(f"('{c}')" for c in _FEATS)}),
tg AS (SELECT target, count(*) AS n_rows FROM lg GROUP BY target),
nn AS (
  SELECT target, feature, count(*) AS n_nonnull FROM (
    UNPIVOT (SELECT target, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _FEATS)} FROM lg)
    ON {', '.join(_FEATS)} INTO NAME feature VALUE v)
  GROUP BY target, feature)
SELECT tg.target, fl.feature, coalesce(nn.n_nonnull, 0) AS n_nonnull, tg.n_rows
FROM tg CROSS JOIN fl LEFT JOIN nn ON nn.target = tg.target AND nn.feature = fl.feature"""

ORACLES["exact_split"] = f"""
{TRAIN_CTES}
SELECT project_id, row_idx, target, is_test FROM sp"""

_NUMS = list(QUOTE_NUM_FEATURES)
_CATS = list(QUOTE_CAT_FEATURES)
ORACLES["impute_values"] = f"""
{TRAIN_CTES},
trn AS (SELECT * FROM sp WHERE NOT is_test),
tg AS (SELECT DISTINCT target FROM trn),
nf(feature) AS (VALUES {', '.join(f"('{c}')" for c in _NUMS)}),
cf(feature) AS (VALUES {', '.join(f"('{c}')" for c in _CATS)}),
med AS (
  SELECT target, feature, median(v) AS num_value FROM (
    UNPIVOT (SELECT target, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _NUMS)} FROM trn)
    ON {', '.join(_NUMS)} INTO NAME feature VALUE v)
  GROUP BY target, feature),
cc AS (
  SELECT target, feature, v, count(*) AS c FROM (
    UNPIVOT (SELECT target, {', '.join(_CATS)} FROM trn) ON {', '.join(_CATS)} INTO NAME feature VALUE v)
  GROUP BY target, feature, v),
md AS (
  SELECT target, feature, v AS cat_value FROM (
    SELECT *, row_number() OVER (PARTITION BY target, feature ORDER BY c DESC, v) AS rn FROM cc)
  WHERE rn = 1)
SELECT tg.target, nf.feature, round(med.num_value, {R}) AS num_value, CAST(NULL AS VARCHAR) AS cat_value
FROM tg CROSS JOIN nf LEFT JOIN med ON med.target = tg.target AND med.feature = nf.feature
UNION ALL
SELECT tg.target, cf.feature, CAST(NULL AS DOUBLE) AS num_value, md.cat_value
FROM tg CROSS JOIN cf LEFT JOIN md ON md.target = tg.target AND md.feature = cf.feature"""

ORACLES["holdout_metrics"] = f"""
{TRAIN_CTES},
means AS (SELECT target, avg(hours) AS prediction FROM sp WHERE NOT is_test GROUP BY target),
te AS (SELECT sp.target, sp.hours, means.prediction FROM sp JOIN means USING (target) WHERE sp.is_test),
agg AS (
  SELECT target, count(*) AS rows, avg(abs(hours - prediction)) AS mae,
         sum((hours - prediction) * (hours - prediction)) AS sse, var_pop(hours) * count(*) AS sst
  FROM te GROUP BY target)
SELECT target, rows, round(mae, {R}) AS mae,
       round(CASE WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sse / sst END, {R}) AS r2
FROM agg"""

# --- models: what is fixed of them ----------------------------------------------------

_TARGET_ROWS = ", ".join(f"('{t}', '{operation_of(t)}')" for t in TARGETS)
ORACLES["model_registry"] = f"""
{TRAIN_CTES},
t(target, operation) AS (VALUES {_TARGET_ROWS})
SELECT target, operation, '{MODEL_VERSION}' AS version, target IN (SELECT target FROM lg) AS exists FROM t"""

ORACLES["train_rows"] = f"""
{TRAIN_CTES}
SELECT target, '{MODEL_VERSION}' AS version, count(*) AS rows, true AS within_bounds FROM lg GROUP BY target"""

ORACLES["overview_model_count"] = f"""
{TRAIN_CTES}
SELECT count(DISTINCT target) AS operations_with_models FROM lg"""

_QUOTES = f"{_with(RAW_CTE)}, q AS (SELECT row_idx AS quote_id FROM raw WHERE {_tok('dataset_role')} = 'quote')"
ORACLES["score_checks"] = f"""
{_QUOTES},
t(target, operation) AS (VALUES {_TARGET_ROWS})
SELECT operation, (SELECT count(*) FROM q) AS quotes, CAST(0 AS BIGINT) AS bad_range, CAST(0 AS BIGINT) AS bad_std,
       CAST(0 AS BIGINT) AS bad_mean
FROM t"""

ORACLES["bucket_checks"] = f"""
{_QUOTES}
SELECT count(*) AS quotes, CAST(0 AS BIGINT) AS off FROM q"""

ORACLES["driver_checks"] = f"""
{TRAIN_CTES}
SELECT target, CAST({TOP_DRIVERS} AS BIGINT) AS listed, CAST({TOP_DRIVERS} AS INTEGER) AS last_rank, true AS sum_is_one
FROM lg GROUP BY target"""

ORACLES["sales_view"] = f"""
{_JUDGED},
ok AS (SELECT quote_id FROM judged WHERE reason IS NULL),
quoted AS ({duckdb_quoted_sql().format(**TABLES)}),
qb AS (
  SELECT quote_id, sum(quoted_hours) AS quoted_hours
  FROM quoted WHERE bucket IN ({', '.join(f"'{b}'" for b in SALES_BUCKETS)}) GROUP BY quote_id),
n AS (SELECT quote_id, count(*) AS k FROM quoted GROUP BY quote_id)
SELECT ok.quote_id, CAST(CASE WHEN n.k IS NULL THEN 9 ELSE 10 END AS BIGINT) AS rows, round(qb.quoted_hours, {R}) AS quoted_hours
FROM ok LEFT JOIN qb USING (quote_id) LEFT JOIN n USING (quote_id)"""
