"""DuckDB oracle SQL, written independently of the Spark operators.

Each entry computes the same result as ``tracefold.catalog.QUERIES[name]``
directly from the raw tables (views ``events``, ``lineitem``, ... are
registered by the checker). Column names match the Spark side; doubles
are rounded to 6 decimals and counts cast to BIGINT on both sides.
"""

from __future__ import annotations

# ------------------------------------------------------------------ logs as CTE bodies
DAY = """SELECT CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y-%m-%d') AS case_id,
       event_type AS activity, ts, event_id AS tie,
       json_extract_string(props, '$.k') AS resource, value AS num, user_id
FROM events"""

USER = """SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, ts,
       event_id AS tie, json_extract_string(props, '$.k') AS resource, value AS num, user_id
FROM events"""

IVL = """SELECT *, ts - to_microseconds(CAST(floor(num * 60) AS BIGINT) * 1000000) AS start_ts
FROM (""" + DAY + ")"

ORD = """SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag || l_linestatus AS activity,
       l_shipdate AS ts, CAST(l_linenumber AS BIGINT) AS tie, l_partkey AS tie2, l_suppkey AS tie3,
       CAST(l_suppkey AS VARCHAR) AS resource, l_quantity AS num
FROM lineitem"""

CONV = """SELECT CAST(conv_id AS VARCHAR) AS case_id, role AS activity, turn FROM conversations"""

ORDER = {"day": "ts, tie", "user": "ts, tie", "ivl": "ts, tie", "ord": "ts, tie, tie2, tie3",
         "conv": "turn"}
LOGS = {"day": DAY, "user": USER, "ivl": IVL, "ord": ORD, "conv": CONV}


def with_log(log: str, body: str, name: str = "log") -> str:
    return f"WITH {name} AS ({LOGS[log]})\n{body}"


def variants_cte(log: str) -> str:
    o = ORDER[log]
    return (f"WITH log AS ({LOGS[log]}),\n"
            f"cv AS (SELECT case_id, string_agg(activity, ',' ORDER BY {o}) AS variant, "
            f"count(*) AS variant_len FROM log GROUP BY case_id),\n"
            f"vc AS (SELECT variant, CAST(count(*) AS BIGINT) AS n_cases FROM cv GROUP BY variant)\n")


SQL: dict[str, str] = {}


def std_sql(x: str) -> str:
    """Sample std in seconds of whole microseconds, centred on a whole number near the mean."""
    n, s1 = "CAST(count(*) AS HUGEINT)", f"sum(CAST({x} AS HUGEINT))"
    q = f"CAST(CAST(floor(CAST({s1} AS DOUBLE) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS HUGEINT)"
    off = f"({s1} - {n} * {q})"
    around = f"CAST(sum(CAST({x} AS HUGEINT) * CAST({x} AS HUGEINT)) - {q} * ({s1} + {off}) AS DOUBLE)"
    return (f"CASE WHEN count(*) > 1 THEN round(sqrt(greatest(0, ({around} - CAST({off} AS DOUBLE) * CAST({off} AS DOUBLE)"
            f" / count(*)) / (count(*) - 1))) / 1000000.0, 6) END")

# ------------------------------------------------------------------ E1-E3
SQL["variant_stats"] = variants_cte("day") + "SELECT variant, n_cases FROM vc"

_PARETO = """, pr AS (
  SELECT variant, n_cases,
         CAST(row_number() OVER (ORDER BY n_cases DESC, variant ASC) - 1 AS BIGINT) AS rank0,
         sum(n_cases) OVER (ORDER BY n_cases DESC, variant ASC ROWS UNBOUNDED PRECEDING) AS cum,
         sum(n_cases) OVER () AS total
  FROM vc)
"""
SQL["variant_pareto"] = variants_cte("day") + _PARETO + """
SELECT variant, n_cases, rank0, round(log2(n_cases), 6) AS frequency,
       round(n_cases * 100.0 / total, 6) AS percentage,
       round(cum * 100.0 / total, 6) AS cum_percentage
FROM pr"""
SQL["variant_pareto_ord"] = variants_cte("ord") + _PARETO + """
SELECT variant, n_cases, rank0, round(log2(n_cases), 6) AS frequency,
       round(n_cases * 100.0 / total, 6) AS percentage,
       round(cum * 100.0 / total, 6) AS cum_percentage
FROM pr"""
SQL["pareto_check"] = variants_cte("ord") + _PARETO + """
SELECT CAST((SELECT count(*) FROM vc) AS BIGINT) AS n_variants, rank0 AS pareto_rank,
       round(cum * 100.0 / total, 6) AS cum_percentage,
       round(cum * 100.0 / total, 6) > 80 AS is_pareto
FROM pr WHERE rank0 = CAST(floor((SELECT count(*) FROM vc) * 0.2) AS BIGINT)"""


# ------------------------------------------------------------------ filters (C, D2, D3)
def _desc(log: str) -> str:
    return ", ".join(f"{c.strip()} DESC" for c in ORDER[log].split(","))


def ct_cte(log: str) -> str:
    """Case table: size, start, end, first and last activity (window form)."""
    o = ORDER[log]
    return f"""ct AS (
  SELECT case_id, count(*) AS case_size, min(ts) AS case_start, max(ts) AS case_end,
         min(fa) AS first_activity, min(la) AS last_activity
  FROM (SELECT *, first_value(activity) OVER (PARTITION BY case_id ORDER BY {o}) AS fa,
                  first_value(activity) OVER (PARTITION BY case_id ORDER BY {_desc(log)}) AS la
        FROM log) GROUP BY case_id)
"""


def keep_where(log: str, cond: str, extra: str = "") -> str:
    return (f"WITH log AS ({LOGS[log]}),\n{ct_cte(log)}{extra}\n"
            f"SELECT * FROM log WHERE case_id IN (SELECT case_id FROM ct WHERE {cond})")


_D1, _D2 = "TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '2024-01-20 12:00:00'"
SQL["flt_time_contained"] = keep_where("day", f"case_start >= {_D1} AND case_end <= {_D2}")
SQL["flt_time_intersecting"] = keep_where("day", f"case_start <= {_D2} AND case_end >= {_D1}")
SQL["flt_time_events"] = with_log("day", f"SELECT * FROM log WHERE ts BETWEEN {_D1} AND {_D2}")
SQL["flt_case_performance"] = keep_where(
    "day", "epoch_us(case_end) - epoch_us(case_start) BETWEEN 3600000000 AND 21600000000")
SQL["flt_start_activity"] = keep_where("day", "first_activity IN ('signup', 'view')")
SQL["flt_start_frequent"] = keep_where("day", "first_activity IN (SELECT activity FROM sf WHERE fails = 0)", """,
sa AS (SELECT first_activity AS activity, count(*) AS n FROM ct GROUP BY 1),
sr AS (SELECT activity, n, lag(n) OVER (ORDER BY n DESC, activity) AS pn FROM sa),
sf AS (SELECT activity, sum(CASE WHEN pn IS NOT NULL AND n < 0.97 * pn THEN 1 ELSE 0 END)
              OVER (ORDER BY n DESC, activity ROWS UNBOUNDED PRECEDING) AS fails FROM sr)""")
SQL["flt_end_activity"] = keep_where("day", "last_activity = 'purchase'")
SQL["flt_endpoint_keywords"] = keep_where(
    "day", "(lower(first_activity) LIKE '%sign%' OR lower(first_activity) LIKE '%view%') "
           "AND (lower(last_activity) LIKE '%purch%' OR lower(last_activity) LIKE '%err%')")

_VLIST = "('view', 'click', 'error,view')"
SQL["flt_variants_in"] = variants_cte("day") + (
    f"SELECT * FROM log WHERE case_id IN (SELECT case_id FROM cv WHERE variant IN {_VLIST})")
SQL["anti_variants"] = variants_cte("day") + (
    f"SELECT * FROM log WHERE case_id NOT IN (SELECT case_id FROM cv WHERE variant IN {_VLIST})")


def _variant_keep(log: str, cond: str) -> str:
    return variants_cte(log) + _PARETO + (
        f"SELECT * FROM log WHERE case_id IN (SELECT case_id FROM cv WHERE variant IN "
        f"(SELECT variant FROM pr WHERE {cond}))")


SQL["flt_variants_percentage"] = _variant_keep("ord", "rank0 = 0 OR cum <= 0.3 * total")
SQL["flt_variants_top_k"] = _variant_keep("ord", "rank0 < 10")
SQL["flt_variants_coverage"] = _variant_keep("day", "n_cases >= 0.01 * total")
SQL["flt_variant_text"] = _variant_keep("day", "rank0 = 0")
SQL["flt_variant_substring"] = variants_cte("ord") + _PARETO + """
SELECT * FROM log WHERE case_id IN (
  SELECT case_id FROM log WHERE contains((SELECT variant FROM pr WHERE rank0 = 2), activity))"""

SQL["flt_attr_cases"] = with_log("day", "SELECT * FROM log WHERE case_id IN "
                                 "(SELECT case_id FROM log WHERE resource IN ('7', '42'))")
SQL["flt_attr_events"] = with_log("day", "SELECT * FROM log WHERE resource IN ('7', '42')")
SQL["flt_numeric_cases"] = with_log("day", "SELECT * FROM log WHERE case_id IN "
                                    "(SELECT case_id FROM log WHERE num BETWEEN 40 AND 51)")
SQL["flt_numeric_events"] = with_log("day", "SELECT * FROM log WHERE num BETWEEN 40 AND 51")

SQL["flt_between"] = (f"WITH log AS ({USER}),\n" + """
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, tie) - 1 AS pos,
             coalesce(sum(CASE WHEN activity = 'purchase' THEN 1 ELSE 0 END)
               OVER (PARTITION BY case_id ORDER BY ts, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
      FROM log),
pc AS (SELECT case_id, k, min(CASE WHEN activity = 'view' THEN pos END) AS p1,
              max(CASE WHEN activity = 'purchase' THEN pos END) AS p2
       FROM r GROUP BY case_id, k)
SELECT r.case_id || '#' || CAST(r.k AS VARCHAR) AS case_id, activity, ts, tie, resource, num, user_id
FROM r JOIN pc ON r.case_id = pc.case_id AND r.k = pc.k
WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND pos BETWEEN p1 AND p2""")

SQL["flt_between_same"] = f"WITH log AS ({USER}),\n" + """
r AS (SELECT *, sum(is_c) OVER (PARTITION BY case_id ORDER BY ts, tie ROWS UNBOUNDED PRECEDING) AS c,
             sum(is_c) OVER (PARTITION BY case_id) AS tot
      FROM (SELECT *, CASE WHEN activity = 'click' THEN 1 ELSE 0 END AS is_c FROM log))
SELECT case_id || '#' || CAST(c - 1 AS VARCHAR) AS case_id, activity, ts, tie, resource, num, user_id
FROM r WHERE is_c = 1 AND c >= 2
UNION ALL
SELECT case_id || '#' || CAST(c AS VARCHAR), activity, ts, tie, resource, num, user_id
FROM r WHERE is_c = 1 AND c < tot
UNION ALL
SELECT case_id || '#' || CAST(c AS VARCHAR), activity, ts, tie, resource, num, user_id
FROM r WHERE is_c = 0 AND c >= 1 AND c < tot"""

SQL["flt_case_size"] = keep_where("day", "case_size BETWEEN 3 AND 5")
SQL["flt_rework"] = with_log("day", """SELECT * FROM log WHERE case_id IN (
  SELECT case_id FROM log GROUP BY case_id HAVING sum(CASE WHEN activity = 'click' THEN 1 ELSE 0 END) >= 2)""")
SQL["flt_paths_performance"] = with_log("day", """SELECT * FROM log WHERE case_id IN (
  SELECT case_id FROM (
    SELECT case_id, activity, ts,
           lead(activity) OVER (PARTITION BY case_id ORDER BY ts, tie) AS na,
           lead(ts) OVER (PARTITION BY case_id ORDER BY ts, tie) AS nt FROM log)
  WHERE activity = 'click' AND na = 'error'
    AND epoch_us(nt) - epoch_us(ts) BETWEEN 0 AND 3600000000)""")
SQL["flt_case_predicate"] = keep_where("user", "case_size > 70")
SQL["flt_event_predicate"] = with_log("day", "SELECT * FROM log WHERE length(activity) % 2 = 0")

_FIRST_XY = """fx AS (SELECT case_id, activity AS first_xy FROM (
  SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY ts, tie) AS rn
  FROM log WHERE activity IN ('click', 'purchase')) WHERE rn = 1)"""
SQL["flt_first_of"] = f"WITH log AS ({DAY}),\n{_FIRST_XY}\n" + \
    "SELECT * FROM log WHERE case_id IN (SELECT case_id FROM fx WHERE first_xy = 'purchase')"
SQL["flt_balanced"] = with_log("day", """SELECT * FROM log WHERE case_id IN (
  SELECT case_id FROM log GROUP BY case_id
  HAVING sum(CASE WHEN activity = 'click' THEN 1 ELSE 0 END) = sum(CASE WHEN activity = 'purchase' THEN 1 ELSE 0 END))""")
SQL["flt_has_activity"] = with_log("day", "SELECT * FROM log WHERE case_id IN "
                                   "(SELECT case_id FROM log WHERE activity = 'view')")

_CAT_LOG = f"""SELECT *, CASE user_id % 4 WHEN 0 THEN '2-way match' WHEN 1 THEN 'Consignment'
  WHEN 2 THEN '3-way match, invoice after GR' ELSE '3-way match, invoice before GR' END AS category
FROM ({DAY})"""
SQL["flt_category_compliant"] = f"WITH log AS ({_CAT_LOG}),\n{_FIRST_XY},\n" + """
f AS (SELECT case_id, min(user_id) % 4 AS cat,
             sum(CASE WHEN activity = 'click' THEN 1 ELSE 0 END)
               - sum(CASE WHEN activity = 'purchase' THEN 1 ELSE 0 END) AS bal,
             bool_or(activity = 'click') AS hi, bool_or(activity = 'purchase') AS hg,
             bool_or(activity = 'view') AS hc
      FROM log GROUP BY case_id)
SELECT * FROM log WHERE case_id IN (
  SELECT f.case_id FROM f LEFT JOIN fx ON f.case_id = fx.case_id
  WHERE CASE cat WHEN 2 THEN bal = 0 AND hi AND hg AND hc AND first_xy = 'purchase'
                 WHEN 3 THEN bal = 0 AND hi AND hg AND hc AND first_xy = 'click'
                 WHEN 0 THEN hi AND hc
                 ELSE hg END)"""

_AREA_LOG = f"""SELECT *, CASE WHEN resource = '7' THEN '' WHEN resource = '13' THEN NULL
  ELSE resource END AS area FROM ({DAY})"""
SQL["flt_empty_attr"] = f"WITH log AS ({_AREA_LOG})\n" + (
    "SELECT * FROM log WHERE case_id NOT IN (SELECT case_id FROM log WHERE area IS NULL OR area = '')")
SQL["flt_duplicates_none"] = f"WITH log AS (SELECT *, tie % 9973 AS dup_id FROM ({DAY}))\n" + (
    "SELECT * FROM log WHERE dup_id IN (SELECT dup_id FROM log GROUP BY dup_id HAVING count(*) = 1)")
SQL["flt_single_case"] = with_log("ord", "SELECT * FROM log WHERE case_id = '1'")
SQL["flt_frequent_activity"] = with_log("ord", """SELECT activity, n_events, round(n_events / total, 6) AS share
FROM (SELECT activity, count(*) AS n_events, sum(count(*)) OVER () AS total FROM log GROUP BY activity)
WHERE n_events / total > 0.05""")
SQL["semi_case_ids"] = with_log("day", """SELECT * FROM log WHERE case_id IN (
  SELECT case_id FROM log WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""")


# ------------------------------------------------------------------ aggregates, windows, top-k, charts
def _cv(log: str, sep: str, name: str) -> str:
    return (f"SELECT case_id, string_agg(activity, '{sep}' ORDER BY {ORDER[log]}) AS {name} "
            f"FROM log GROUP BY case_id")


_PROFILE = f"""prof AS (
  SELECT a.case_id, n_events, activity_list, n_resources, duration_s FROM (
    SELECT case_id, count(*) AS n_events, count(DISTINCT resource) AS n_resources,
           (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS duration_s
    FROM log GROUP BY case_id) a
  JOIN ({_cv('day', ', ', 'activity_list')}) b ON a.case_id = b.case_id)
"""
SQL["case_profile"] = f"WITH log AS ({DAY}),\n{_PROFILE}SELECT * FROM prof"
SQL["variant_profile"] = f"WITH log AS ({DAY}),\n{_PROFILE}" + """
SELECT activity_list, avg(n_events) AS avg_events, count(*) AS cases,
       avg(n_resources) AS avg_resource,
       CAST(sum(us) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 1000000.0 AS avg_duration,
       min(us) / 1000000.0 AS min_duration,
       """ + std_sql("us") + """ AS std_duration,
       sum(us) / 1000000.0 AS sum_duration
FROM (SELECT *, CAST(round(duration_s * 1000000) AS BIGINT) AS us FROM prof) GROUP BY activity_list"""
SQL["attribute_values"] = with_log("day", "SELECT resource AS value, count(*) AS n_events FROM log GROUP BY 1")
SQL["start_activities"] = f"WITH log AS ({DAY}),\n{ct_cte('day')}" + \
    "SELECT first_activity AS activity, count(*) AS n_cases FROM ct GROUP BY 1"
SQL["end_activities"] = f"WITH log AS ({DAY}),\n{ct_cte('day')}" + \
    "SELECT last_activity AS activity, count(*) AS n_cases FROM ct GROUP BY 1"
SQL["activity_counts"] = with_log("ord", "SELECT activity, count(*) AS n_events FROM log GROUP BY 1")

_TOPICS = """tp AS (SELECT event_type AS topic, count(*) AS occurrences, round(sum(value), 6) AS sum_value,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS duration_s
FROM events GROUP BY event_type)"""
SQL["topic_dimensions"] = f"WITH {_TOPICS} SELECT * FROM tp"
SQL["topic_counts"] = "SELECT role AS topic, count(*) AS n_rows FROM conversations GROUP BY role"
SQL["region_totals"] = """SELECT r_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_o_totalprice,
       CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS sum_c_acctbal
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
SQL["distinct_per_column"] = """SELECT * FROM (SELECT count(DISTINCT event_id) AS event_id, count(DISTINCT ts) AS ts,
  count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type,
  count(DISTINCT value) AS value, count(DISTINCT props) AS props FROM events)
UNPIVOT (n_distinct FOR "column" IN (event_id, ts, user_id, event_type, value, props))"""
SQL["nulls_per_column"] = f"WITH log AS ({_AREA_LOG})\n" + """SELECT * FROM (SELECT
  count(*) FILTER (WHERE case_id IS NULL) AS case_id, count(*) FILTER (WHERE activity IS NULL) AS activity,
  count(*) FILTER (WHERE ts IS NULL) AS ts, count(*) FILTER (WHERE tie IS NULL) AS tie,
  count(*) FILTER (WHERE resource IS NULL) AS resource, count(*) FILTER (WHERE num IS NULL) AS num,
  count(*) FILTER (WHERE user_id IS NULL) AS user_id, count(*) FILTER (WHERE area IS NULL) AS area FROM log)
UNPIVOT (n_null FOR "column" IN (case_id, activity, ts, tie, resource, num, user_id, area))"""
SQL["value_counts_all"] = """WITH long AS (
  SELECT 'event_type' AS "column", event_type AS value FROM events
  UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events
  UNION ALL SELECT 'props', props FROM events
  UNION ALL SELECT 'value', CAST(value AS VARCHAR) FROM events),
vc AS (SELECT "column", value, count(*) AS n FROM long GROUP BY 1, 2)
SELECT * FROM vc"""
SQL["crosstab_case_activity"] = with_log("day", """SELECT case_id,
  count(*) FILTER (WHERE activity = 'click') AS click, count(*) FILTER (WHERE activity = 'error') AS error,
  count(*) FILTER (WHERE activity = 'purchase') AS purchase, count(*) FILTER (WHERE activity = 'signup') AS signup,
  count(*) FILTER (WHERE activity = 'view') AS view
FROM log GROUP BY case_id""")
SQL["pivot_start_end"] = with_log("day", "SELECT case_id, min(ts) AS start_ts, max(ts) AS end_ts FROM log GROUP BY 1")
SQL["events_per_case_by_category"] = f"WITH log AS ({_CAT_LOG})\n" + """SELECT category, count(*) AS n_events,
  count(DISTINCT case_id) AS n_cases, round(count(*) / count(DISTINCT case_id), 2) AS events_per_case
FROM log GROUP BY category"""
SQL["filter_effect"] = f"WITH log AS (SELECT *, tie % 9973 AS dup_id FROM ({_AREA_LOG})),\n" + """
d AS (SELECT dup_id, count(*) AS dn FROM log GROUP BY 1),
per AS (SELECT case_id, bool_and(area IS NOT NULL AND area <> '') AS ok_area,
          count(*) FILTER (WHERE dn = 1) AS n_left,
          min(ts) FILTER (WHERE dn = 1) AS t0, max(ts) FILTER (WHERE dn = 1) AS t1
        FROM log LEFT JOIN d USING (dup_id) GROUP BY case_id),
c AS (SELECT count(*) AS c0, count(*) FILTER (WHERE ok_area) AS c1,
        count(*) FILTER (WHERE ok_area AND n_left > 0) AS c2,
        count(*) FILTER (WHERE ok_area AND n_left > 0 AND t0 >= TIMESTAMP '2024-01-05 00:00:00'
                         AND t1 <= TIMESTAMP '2024-01-20 12:00:00') AS c3 FROM per),
s AS (SELECT 1 AS step, 'empty_area' AS filter, c0 AS before, c1 AS after FROM c
      UNION ALL SELECT 2, 'duplicate_ids', c1, c2 FROM c
      UNION ALL SELECT 3, 'date_contained', c2, c3 FROM c)
SELECT step, filter, before, after, round((1 - after / before) * 100, 6) AS lost_pct FROM s"""
SQL["cumulative_percentage"] = with_log("ord", """SELECT activity, n_events,
  CAST(row_number() OVER (ORDER BY n_events DESC, activity) - 1 AS BIGINT) AS rank0,
  round(n_events * 100.0 / sum(n_events) OVER (), 6) AS percentage,
  round(sum(n_events) OVER (ORDER BY n_events DESC, activity ROWS UNBOUNDED PRECEDING) * 100.0
        / sum(n_events) OVER (), 6) AS cum_percentage
FROM (SELECT activity, count(*) AS n_events FROM log GROUP BY 1)""")
SQL["rank_index"] = with_log("day", """SELECT case_id, n_events,
  CAST(row_number() OVER (ORDER BY n_events DESC, case_id) - 1 AS BIGINT) AS rank0
FROM (SELECT case_id, count(*) AS n_events FROM log GROUP BY 1)""")
SQL["next_event"] = with_log("day", """SELECT case_id, activity, ts, tie,
  CAST(row_number() OVER w - 1 AS BIGINT) AS pos, lead(activity) OVER w AS next_activity, lead(ts) OVER w AS next_ts
FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, tie)""")
SQL["zscore_columns"] = f"WITH {_TOPICS}\n" + """SELECT topic,
  round((occurrences - avg(occurrences) OVER ()) / stddev_samp(occurrences) OVER (), 6) AS z_occurrences,
  round((sum_value - avg(sum_value) OVER ()) / stddev_samp(sum_value) OVER (), 6) AS z_sum_value,
  round((sum_k - avg(sum_k) OVER ()) / stddev_samp(sum_k) OVER (), 6) AS z_sum_k,
  round((duration_s - avg(duration_s) OVER ()) / stddev_samp(duration_s) OVER (), 6) AS z_duration_s
FROM tp"""
SQL["top_topics"] = SQL["zscore_columns"] + " ORDER BY z_duration_s DESC, topic LIMIT 5"
_DUR = f"""WITH log AS ({DAY}),
dur AS (SELECT case_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS duration_s FROM log GROUP BY 1),
mm AS (SELECT min(duration_s) AS lo, max(duration_s) AS hi, (max(duration_s) - min(duration_s)) / 50 AS w FROM dur),
b AS (SELECT CASE WHEN w = 0 THEN 0 ELSE least(CAST(floor((duration_s - lo) / w) AS INTEGER), 49) END AS bin, count(*) AS n
      FROM dur, mm GROUP BY 1),
h AS (SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * w, 6) AS lo, round(lo + (g.bin + 1) * w, 6) AS hi,
             coalesce(b.n, 0) AS n
      FROM (SELECT range AS bin FROM range(50)) g CROSS JOIN mm LEFT JOIN b ON b.bin = g.bin)
"""
SQL["histogram_bins"] = _DUR + "SELECT * FROM h"
SQL["empirical_cdf"] = _DUR + """SELECT bin, hi, n, round(n / sum(n) OVER (), 6) AS pdf,
  round(sum(n) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cdf FROM h"""
SQL["sort_cases"] = with_log("day", """SELECT case_id, n_events, duration_s,
  CAST(row_number() OVER (ORDER BY n_events DESC, duration_s DESC, case_id) - 1 AS BIGINT) AS rank0
FROM (SELECT case_id, count(*) AS n_events, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS duration_s
      FROM log GROUP BY 1)""")
SQL["top_n_frame"] = variants_cte("ord") + "SELECT variant, n_cases FROM vc ORDER BY n_cases DESC, variant LIMIT 100"
SQL["pie_others"] = with_log("day", """, sz AS (SELECT case_size, count(*) AS n_cases FROM
  (SELECT case_id, count(*) AS case_size FROM log GROUP BY 1) GROUP BY 1),
t AS (SELECT sum(n_cases) AS total FROM sz)
SELECT CAST(case_size AS VARCHAR) AS label, n_cases AS value FROM sz, t WHERE n_cases >= 0.05 * total
UNION ALL
SELECT 'others', CAST(coalesce(sum(n_cases) FILTER (WHERE n_cases < 0.05 * total), 0) AS BIGINT) FROM sz, t""")
SQL["category_ratio"] = f"WITH log AS ({_CAT_LOG})\n" + """SELECT category, count(*) AS n_cases,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage
FROM (SELECT case_id, min(category) AS category FROM log GROUP BY 1) GROUP BY category"""
SQL["set_all_categories"] = SQL["flt_category_compliant"]


# ------------------------------------------------------------------ preparation (B), joins (D), time (H)
SQL["log_rename"] = "SELECT event_id, ts, user_id AS case_id, event_type AS activity, value, props FROM events"
SQL["log_drop_columns"] = "SELECT event_id, ts, user_id, event_type FROM events"
SQL["log_sorted"] = with_log("day", "SELECT * FROM log ORDER BY case_id, ts, tie")
SQL["log_event_index"] = with_log("day", """SELECT case_id, activity, ts, tie,
  CAST(row_number() OVER (ORDER BY ts, tie, case_id) - 1 AS BIGINT) AS "index",
  CAST(row_number() OVER (PARTITION BY case_id ORDER BY ts, tie) - 1 AS BIGINT) AS index_in_trace FROM log""")
SQL["log_to_cases"] = with_log("ord", """SELECT case_id, count(*) AS n_events,
  list(activity ORDER BY ts, tie, tie2, tie3) AS activities, min(ts) AS first_ts FROM log GROUP BY case_id""")
SQL["cases_to_log"] = with_log("ord", """SELECT case_id,
  CAST(row_number() OVER (PARTITION BY case_id ORDER BY ts, tie, tie2, tie3) - 1 AS BIGINT) AS pos, activity, ts FROM log""")
SQL["case_attributes"] = with_log("day", "SELECT case_id, min(user_id) AS user_id, min(CAST(ts AS DATE)) AS day FROM log GROUP BY 1")
_REL = """rel AS (SELECT case_id, activity, ts, tie, min(ts) OVER (PARTITION BY case_id) AS case_start,
  max(ts) OVER (PARTITION BY case_id) AS case_end,
  (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY case_id))) / 1000000.0 AS rel_s,
  CAST(floor((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY case_id))) / 86400000000) AS BIGINT) AS rel_days
FROM log)"""
SQL["case_relative_time"] = f"WITH log AS ({DAY}),\n{_REL}\nSELECT * FROM rel"
SQL["log_classifier"] = with_log("day", "SELECT case_id, tie, concat_ws('+', activity, resource) AS classifier FROM log")
SQL["log_artificial_ends"] = with_log("day", """SELECT case_id, activity, ts,
  CAST(row_number() OVER (PARTITION BY case_id ORDER BY ts, tie) - 1 AS BIGINT) AS pos FROM log
UNION ALL SELECT case_id, '▶', min(ts), -1 FROM log GROUP BY case_id
UNION ALL SELECT case_id, '■', max(ts), count(*) FROM log GROUP BY case_id""")
SQL["case_number"] = with_log("day", """SELECT DISTINCT case_id,
  TRY_CAST(regexp_extract(case_id, '(\\d+)', 1) AS BIGINT) AS case_number FROM log""")
_ACTS = ["click", "error", "purchase", "signup", "view"]
SQL["trace_features"] = with_log("day", ", s AS (SELECT *, lead(activity) OVER (PARTITION BY case_id ORDER BY ts, tie) AS na,"
    " row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, tie DESC) AS rl FROM log)\nSELECT case_id, " + ", ".join(
    [f"count(*) FILTER (WHERE activity = '{a}') AS act_{a}" for a in _ACTS]
    + [f"count(*) FILTER (WHERE activity = '{a}' AND na = '{b}') AS succ_{a}_{b}" for a in _ACTS for b in _ACTS]
    + ["max(num) FILTER (WHERE rl = 1) AS last_num"]) + " FROM s GROUP BY case_id")
_RV = """rv AS (
  SELECT r_name, sold, round(unit_price, 6) AS unit_price, round(sold * unit_price, 6) AS value FROM
  (SELECT n_regionkey, count(*) AS sold FROM orders JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) s
  JOIN (SELECT n_regionkey, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS unit_price
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) p USING (n_regionkey)
  JOIN region ON n_regionkey = r_regionkey)"""
SQL["value_per_region"] = f"WITH {_RV} SELECT * FROM rv"
_TV = """tv AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS f_finished,
  CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS f_priority,
  CAST(o_totalprice > 150000 AS INTEGER) AS f_large, CAST(month(o_orderdate) IN (11, 12) AS INTEGER) AS f_year_end
  FROM orders),
tv2 AS (SELECT *, f_finished + f_priority + f_large + f_year_end AS n_flags,
  CASE WHEN f_finished + f_priority + f_large + f_year_end < 3 THEN 100 ELSE 120 END AS price FROM tv)"""
SQL["tiered_value"] = f"WITH {_TV} SELECT * FROM tv2"
SQL["compare_as_is_to_be"] = f"WITH {_RV}, {_TV}" + """,
tb AS (SELECT r_name, CAST(sum(price) AS BIGINT) AS to_be_value FROM tv2 JOIN orders USING (o_orderkey)
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT coalesce(rv.r_name, tb.r_name) AS r_name, value AS as_is_value, to_be_value
FROM rv FULL OUTER JOIN tb ON rv.r_name = tb.r_name"""
SQL["join_case_stats"] = with_log("day", """SELECT log.*, case_size, case_duration_s FROM log JOIN (
  SELECT case_id, count(*) AS case_size, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS case_duration_s
  FROM log GROUP BY 1) c USING (case_id)""")
_PAIRS = """p AS (SELECT i.activity AS a, j.activity AS b, CAST(epoch_us(j.ts) - epoch_us(i.ts) AS HUGEINT) AS d
  FROM log i JOIN log j ON i.case_id = j.case_id AND (i.ts < j.ts OR (i.ts = j.ts AND i.tie < j.tie)))"""
SQL["eventually_follows"] = f"WITH log AS ({DAY}),\n{_PAIRS}\nSELECT a, b, count(*) AS n_pairs FROM p GROUP BY a, b"
SQL["temporal_profile"] = f"WITH log AS ({USER}),\n{_PAIRS}\n" + """SELECT a, b, count(*) AS n_pairs,
  CAST(sum(d) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 1000000.0 AS mean_s,
  """ + std_sql("d") + """ AS std_s
FROM p GROUP BY a, b"""
_DURS = "SELECT case_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM log GROUP BY 1"
SQL["case_durations"] = with_log("day", f"SELECT case_id, us / 1000000.0 AS duration_s FROM ({_DURS})")
SQL["median_case_duration"] = with_log("day", f"SELECT quantile_cont(us, 0.5) / 1000000.0 AS median_s FROM ({_DURS})")
SQL["case_arrival_avg"] = with_log("day", """SELECT coalesce(CAST(epoch_us(max(t)) - epoch_us(min(t)) AS DOUBLE)
  / CAST(nullif(count(*) - 1, 0) AS DOUBLE), 0) / 1000000.0 AS case_arrival_avg_s
FROM (SELECT case_id, min(ts) AS t FROM log GROUP BY 1)""")
SQL["case_dispersion_avg"] = with_log("day", """SELECT coalesce(CAST(epoch_us(max(t)) - epoch_us(min(t)) AS DOUBLE)
  / CAST(nullif(count(*) - 1, 0) AS DOUBLE), 0) / 1000000.0 AS case_dispersion_avg_s
FROM (SELECT case_id, max(ts) AS t FROM log GROUP BY 1)""")

IVL_USER = f"""SELECT *, ts - to_microseconds(CAST(floor(num * 60) AS BIGINT) * 1000000) AS start_ts FROM ({USER})"""


def _bus_us(a: str, b: str, weekends: str = "6, 7") -> str:
    """Working microseconds in [a, b]: one clipped 8-16 h window per calendar day."""
    return f"""(SELECT coalesce(sum(greatest(0, epoch_us(least({b}, g.d + INTERVAL 16 HOUR))
                  - epoch_us(greatest({a}, g.d + INTERVAL 8 HOUR)))), 0)
  FROM (SELECT unnest(generate_series(date_trunc('day', {a}), date_trunc('day', {b}), INTERVAL 1 DAY)) AS d) g
  WHERE isodow(g.d) NOT IN ({weekends}))"""


SQL["business_hours"] = f"WITH log AS ({IVL_USER})\n" + f"""SELECT case_id, tie,
  (epoch_us(ts) - epoch_us(start_ts)) / 1000000.0 AS plain_s,
  round(CASE WHEN ts > start_ts THEN {_bus_us('start_ts', 'ts', '5, 6, 7')} ELSE 0 END / 1000000.0, 6) AS business_s
FROM log"""


def _lead_cycle(business: bool) -> str:
    if business:
        w = f"CASE WHEN ts > fr THEN {_bus_us('fr', 'ts')} ELSE 0 END"
        i = f"CASE WHEN m IS NOT NULL AND start_ts > m THEN {_bus_us('m', 'start_ts')} ELSE 0 END"
    else:
        w = "CASE WHEN ts > fr THEN epoch_us(ts) - epoch_us(fr) ELSE 0 END"
        i = "CASE WHEN m IS NOT NULL AND start_ts > m THEN epoch_us(start_ts) - epoch_us(m) ELSE 0 END"
    return f"WITH log AS ({IVL_USER}),\n" + f"""
mm AS (SELECT *, max(ts) OVER (PARTITION BY case_id ORDER BY start_ts, tie
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM log),
wi AS (SELECT *, {w} AS w, {i} AS i
       FROM (SELECT *, CASE WHEN m IS NULL THEN start_ts ELSE greatest(start_ts, m) END AS fr FROM mm)),
rs AS (SELECT *, sum(w) OVER (PARTITION BY case_id ORDER BY start_ts, tie ROWS UNBOUNDED PRECEDING) AS cyc,
              sum(w + i) OVER (PARTITION BY case_id ORDER BY start_ts, tie ROWS UNBOUNDED PRECEDING) AS lead
       FROM wi)
SELECT case_id, activity, tie, start_ts, ts, round(cyc / 1000000.0, 6) AS partial_cycle_s,
  round(lead / 1000000.0, 6) AS partial_lead_s, round((lead - cyc) / 1000000.0, 6) AS overall_waste_s,
  round(i / 1000000.0, 6) AS this_waste_s,
  round(CASE WHEN lead = 0 THEN 1.0 ELSE CAST(cyc AS DOUBLE) / CAST(lead AS DOUBLE) END, 6) AS ratio_cycle_lead
FROM rs"""


SQL["lead_cycle_time"] = _lead_cycle(False)
SQL["lead_cycle_business"] = _lead_cycle(True)
SQL["case_profile_times"] = "WITH lc AS (" + _lead_cycle(False) + f"""),
log AS ({IVL_USER}),
prof AS (SELECT case_id, count(*) AS n_events, string_agg(activity, ', ' ORDER BY ts, tie) AS activity_list,
           count(DISTINCT activity) AS n_activities, count(DISTINCT resource) AS n_resources,
           (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS duration_s FROM log GROUP BY case_id),
ends AS (SELECT case_id, max(partial_cycle_s) AS cycle_s, max(partial_lead_s) AS lead_s FROM lc GROUP BY case_id)
SELECT prof.*, cycle_s, lead_s, round(lead_s - cycle_s, 6) AS waste_s FROM prof JOIN ends USING (case_id)"""
SQL["sojourn_time"] = with_log("ivl", """SELECT activity,
  CAST(sum(epoch_us(ts) - epoch_us(start_ts)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 1000000.0 AS sojourn_s,
  count(*) AS n_events FROM log GROUP BY activity""")
SQL["performance_spectrum"] = with_log("user", """SELECT case_id, activity AS from_activity, na AS to_activity,
  ts AS start_ts, nt AS end_ts, (epoch_us(nt) - epoch_us(ts)) / 1000000.0 AS duration_s FROM (
  SELECT *, lead(activity) OVER w AS na, lead(ts) OVER w AS nt FROM log
  WHERE activity IN ('signup', 'view', 'click', 'purchase') WINDOW w AS (PARTITION BY case_id ORDER BY ts, tie))
WHERE (activity = 'signup' AND na = 'view') OR (activity = 'view' AND na = 'click') OR (activity = 'click' AND na = 'purchase')""")
SQL["scatter_case_time"] = f"WITH log AS ({DAY}),\n{_REL}\n" + """SELECT
  TRY_CAST(regexp_extract(case_id, '(\\d+)', 1) AS BIGINT) AS case_number, rel_s, activity, case_id, tie FROM rel"""


# ------------------------------------------------------------------ discovery (I)
def steps_cte(log: str) -> str:
    o = ORDER[log]
    return f"""steps AS (SELECT *, lead(activity) OVER w AS na, lead(ts) OVER w AS nt, lag(activity) OVER w AS pa,
  lead(activity, 2) OVER w AS nna FROM log WINDOW w AS (PARTITION BY case_id ORDER BY {o}))"""


def _disc(log: str, body: str, src: str | None = None) -> str:
    return f"WITH log AS ({src or LOGS[log]}),\n{steps_cte(log)},\n" + \
        "dfg AS (SELECT activity AS a, na AS b, count(*) AS n FROM steps WHERE na IS NOT NULL GROUP BY 1, 2)" + body


SQL["dfg_frequency"] = _disc("day", "\nSELECT * FROM dfg")
SQL["dfg_frequency_ord"] = _disc("ord", "\nSELECT * FROM dfg")
SQL["dfg_performance"] = _disc("day", """
SELECT activity AS a, na AS b, count(*) AS n,
  CAST(sum(epoch_us(nt) - epoch_us(ts)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 1000000.0 AS mean_s,
  min(epoch_us(nt) - epoch_us(ts)) / 1000000.0 AS min_s,
  max(epoch_us(nt) - epoch_us(ts)) / 1000000.0 AS max_s,
  """ + std_sql("(epoch_us(nt) - epoch_us(ts))") + """ AS std_s,
  quantile_cont(epoch_us(nt) - epoch_us(ts), 0.5) / 1000000.0 AS median_s
FROM steps WHERE na IS NOT NULL GROUP BY 1, 2""")
SQL["dfg_triples"] = _disc("day", "\nSELECT activity AS a, na AS b, nna AS c, count(*) AS n FROM steps WHERE nna IS NOT NULL GROUP BY 1, 2, 3")
SQL["dfg_case_attributes"] = _disc("day", "\nSELECT category, activity AS a, na AS b, count(*) AS n FROM steps WHERE na IS NOT NULL GROUP BY 1, 2, 3", _CAT_LOG)
SQL["dfg_with_ends"] = _disc("day", """
SELECT a, b, count(*) AS n FROM (
  SELECT coalesce(pa, '▶') AS a, activity AS b FROM steps
  UNION ALL SELECT activity, '■' FROM steps WHERE na IS NULL) GROUP BY a, b""")
SQL["dfg_clean_noise"] = _disc("ord", """,
node AS (SELECT x, max(n) AS mx FROM (SELECT a AS x, n FROM dfg UNION ALL SELECT b, n FROM dfg) GROUP BY x)
SELECT dfg.a, dfg.b, dfg.n FROM dfg JOIN node na_ ON na_.x = dfg.a JOIN node nb_ ON nb_.x = dfg.b
WHERE dfg.n >= 0.05 * least(na_.mx, nb_.mx)""")
_FP = """,
acts AS (SELECT DISTINCT activity AS x FROM log),
fp AS (SELECT p.a, p.b, CASE WHEN coalesce(f.n, 0) > 0 AND coalesce(r.n, 0) > 0 THEN '||'
                            WHEN coalesce(f.n, 0) > 0 THEN '->' WHEN coalesce(r.n, 0) > 0 THEN '<-' ELSE '#' END AS relation
  FROM (SELECT a1.x AS a, a2.x AS b FROM acts a1, acts a2) p
  LEFT JOIN dfg f ON f.a = p.a AND f.b = p.b LEFT JOIN dfg r ON r.a = p.b AND r.b = p.a)"""
SQL["footprint"] = _disc("day", _FP + "\nSELECT * FROM fp")
SQL["alpha_plus_relations"] = _disc("day", _FP + """,
l2 AS (SELECT DISTINCT a, b FROM (SELECT activity AS a, na AS b FROM steps WHERE nna = activity AND na <> activity
       UNION ALL SELECT na, activity FROM steps WHERE nna = activity AND na <> activity)),
l1 AS (SELECT DISTINCT a FROM dfg WHERE a = b)
SELECT fp.a, fp.b, CASE WHEN relation = '||' AND l2.a IS NOT NULL THEN '<->' ELSE relation END AS relation,
  l1.a IS NOT NULL AS a_loop1, l2.a IS NOT NULL AS loop2
FROM fp LEFT JOIN l2 ON l2.a = fp.a AND l2.b = fp.b LEFT JOIN l1 ON l1.a = fp.a""")


def _dep(dep: float, min_act: int, min_edge: int, loop2: float) -> str:
    return f""",
cnt AS (SELECT activity AS x, count(*) AS c FROM log GROUP BY 1),
tri AS (SELECT activity AS a, na AS b, count(*) AS n FROM steps WHERE nna = activity AND na <> activity GROUP BY 1, 2),
dd AS (SELECT d.a, d.b, d.n, coalesce(r.n, 0) AS nba, coalesce(t1.n, 0) + coalesce(t2.n, 0) AS l2n, ca.c AS ca, cb.c AS cb
  FROM dfg d LEFT JOIN dfg r ON r.a = d.b AND r.b = d.a LEFT JOIN tri t1 ON t1.a = d.a AND t1.b = d.b
  LEFT JOIN tri t2 ON t2.a = d.b AND t2.b = d.a JOIN cnt ca ON ca.x = d.a JOIN cnt cb ON cb.x = d.b),
dg AS (SELECT *, CASE WHEN a = b THEN n / (n + 1) ELSE (n - nba) / (n + nba + 1) END AS dep,
  l2n / (l2n + 1) AS dep2 FROM dd),
kept AS (SELECT a, b, n, round(dep, 6) AS dependency, round(dep2, 6) AS loop2_dependency,
  (l2n > 0 AND dep2 >= {loop2}) AS loop2 FROM dg
  WHERE n >= {min_edge} AND ca >= {min_act} AND cb >= {min_act} AND (dep >= {dep} OR (l2n > 0 AND dep2 >= {loop2})))"""


SQL["dependency_graph"] = _disc("day", _dep(0.05, 100, 50, 0.9) + "\nSELECT * FROM kept")
SQL["and_splits"] = _disc("day", _dep(-1.0, 1, 1, 2.0) + """
SELECT x.a, x.b, y.b AS c,
  round((coalesce(bc.n, 0) + coalesce(cb.n, 0)) / (x.n + y.n + 1), 6) AS and_measure,
  CASE WHEN (coalesce(bc.n, 0) + coalesce(cb.n, 0)) / (x.n + y.n + 1) >= 0.65 THEN 'AND' ELSE 'XOR' END AS kind
FROM kept x JOIN kept y ON x.a = y.a AND x.b < y.b
LEFT JOIN dfg bc ON bc.a = x.b AND bc.b = y.b LEFT JOIN dfg cb ON cb.a = y.b AND cb.b = x.b""")
SQL["parameter_sweep"] = _disc("day", _dep(-1.0, 0, 0, 2.0) + """,
g AS (SELECT * FROM (VALUES (0.6, 3, 3), (0.9, 30, 30), (0.9, 300, 300), (0.99, 3000, 3000)) t(dep_t, act_t, edge_t)),
x AS (SELECT g.*, dg.* FROM g JOIN dg ON dg.dep >= g.dep_t AND dg.n >= g.edge_t AND dg.ca >= g.act_t AND dg.cb >= g.act_t),
v AS (SELECT g.dep_t, g.act_t, (SELECT count(*) FROM x WHERE x.dep_t = g.dep_t AND x.act_t = g.act_t) AS n_edges, g.edge_t,
  (SELECT count(DISTINCT e) FROM (SELECT a AS e FROM x WHERE x.dep_t = g.dep_t AND x.act_t = g.act_t
     UNION ALL SELECT b FROM x WHERE x.dep_t = g.dep_t AND x.act_t = g.act_t)) AS n_activities,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM x WHERE x.dep_t = g.dep_t AND x.act_t = g.act_t) AS covered_steps,
  (SELECT CAST(sum(n) AS BIGINT) FROM dfg) AS steps FROM g),
m AS (SELECT *, CAST(covered_steps AS DOUBLE) / steps AS fit,
  1 / (1 + greatest(0, CASE WHEN n_activities = 0 THEN 0 ELSE 2.0 * n_edges / CAST(n_activities AS DOUBLE) END - 2)) AS simple FROM v)
SELECT CAST(dep_t AS DOUBLE) AS dep_t, act_t, edge_t, n_edges, n_activities, covered_steps,
  round(fit, 6) AS fitness, round(simple, 6) AS simplicity, round(fit + simple, 6) AS score FROM m""")
SQL["sweep_bounds"] = variants_cte("ord") + """SELECT min(n_cases) AS min_count, max(n_cases) AS max_count,
  (SELECT n_cases FROM (SELECT n_cases, row_number() OVER (ORDER BY n_cases DESC, variant) - 1 AS r FROM vc)
   WHERE r = floor((SELECT count(*) FROM vc) * 0.1)) AS count_at_10pct FROM vc"""
SQL["model_decoration"] = _disc("day", _dep(0.05, 100, 50, 0.9) + """
SELECT k.a, k.b, coalesce(p.n, 0) AS freq, p.mean_s, c.c AS act_freq FROM kept k
LEFT JOIN (SELECT activity AS a, na AS b, count(*) AS n,
  CAST(sum(epoch_us(nt) - epoch_us(ts)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 1000000.0 AS mean_s
  FROM steps WHERE na IS NOT NULL GROUP BY 1, 2) p ON p.a = k.a AND p.b = k.b
LEFT JOIN cnt c ON c.x = k.a""")


# ------------------------------------------------------------------ conformance (J, D6) and evaluation (K)
from .operators.conformance import (FIXED_EDGES, FIXED_NET_ARCS, FIXED_NET_PLACES,  # noqa: E402
                                    REFERENCE_TRACE, SEQUENTIAL_NET_ARCS, SEQUENTIAL_NET_PLACES)


def _values(rows, cols: str) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({cols}))"


def replay_ctes(places=FIXED_NET_PLACES, arcs=FIXED_NET_ARCS) -> str:
    return f"""WITH log AS ({DAY}),
arcs AS {_values(arcs, 'activity, place, phase, delta')},
places AS {_values(places, 'place, m0, mf')},
span AS (SELECT case_id, min(ts) AS t0, max(ts) AS t1 FROM log GROUP BY 1),
rws AS (SELECT l.case_id, l.activity, a.place, a.phase, a.delta, 1 AS o, l.ts, l.tie FROM log l JOIN arcs a ON a.activity = l.activity
  UNION ALL SELECT s.case_id, NULL, p.place, 1, p.m0, 0, s.t0, NULL FROM span s CROSS JOIN places p WHERE p.m0 > 0
  UNION ALL SELECT s.case_id, NULL, p.place, 0, -p.mf, 2, s.t1, NULL FROM span s CROSS JOIN places p WHERE p.mf > 0),
bal AS (SELECT *, sum(delta) OVER (PARTITION BY case_id, place ORDER BY ts, o, tie, phase ROWS UNBOUNDED PRECEDING) AS b,
               FROM rws),
bal2 AS (SELECT *, min(b) OVER (PARTITION BY case_id, place ORDER BY ts, o, tie, phase
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_low FROM bal),
cp AS (SELECT case_id, place, sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS p,
              sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END) AS c, greatest(0, -min(b)) AS m FROM bal GROUP BY 1, 2),
cs AS (SELECT case_id, CAST(sum(p) AS BIGINT) AS produced, CAST(sum(c) AS BIGINT) AS consumed,
              CAST(sum(m) AS BIGINT) AS missing, CAST(sum(p + m - c) AS BIGINT) AS remaining FROM cp GROUP BY 1),
skp AS (SELECT case_id, count(*) AS skipped FROM log WHERE activity NOT IN (SELECT activity FROM arcs) GROUP BY 1),
tr AS (SELECT cs.*, 0.5 * (1 - remaining / produced) + 0.5 * (1 - missing / consumed) AS fit_raw,
              missing = 0 AND remaining = 0 AS is_fit, CAST(coalesce(skipped, 0) AS BIGINT) AS skipped
       FROM cs LEFT JOIN skp USING (case_id)),
probs AS (SELECT case_id, coalesce(activity, '(final marking)') AS transition, place, ts, tie,
                 CAST(least(coalesce(prev_low, 0), 0) - b AS BIGINT) AS missing_tokens
          FROM bal2 WHERE delta < 0 AND b < least(coalesce(prev_low, 0), 0))
"""


SQL["token_replay"] = replay_ctes() + """SELECT case_id, produced, consumed, missing, remaining,
  round(fit_raw, 6) AS fitness, is_fit, skipped FROM tr"""
SQL["replay_problems"] = replay_ctes() + "SELECT * FROM probs"
SQL["anomalous_cases"] = replay_ctes() + """,
tags AS (SELECT case_id, 'missing:' || transition || '@' || place AS tag FROM probs
         UNION SELECT case_id, 'remaining:' || place FROM cp WHERE p + m - c > 0),
sig AS (SELECT case_id, string_agg(DISTINCT tag, ';' ORDER BY tag) AS signature FROM tags GROUP BY 1)
SELECT coalesce(signature, '') AS signature, count(*) AS n_cases, CAST(sum(missing) AS BIGINT) AS missing_tokens,
  CAST(sum(remaining) AS BIGINT) AS remaining_tokens, min(tr.case_id) AS example_case,
  round(count(*) * 100.0 / (SELECT count(*) FROM tr), 6) AS pct_cases
FROM tr LEFT JOIN sig USING (case_id) WHERE NOT is_fit GROUP BY 1"""
SQL["replay_diagnostics_places"] = replay_ctes() + """SELECT place, count(*) FILTER (WHERE m > 0) AS underfed_cases,
  count(*) FILTER (WHERE p + m - c > 0) AS overfed_cases, CAST(sum(m) AS BIGINT) AS missing_tokens,
  CAST(sum(p + m - c) AS BIGINT) AS remaining_tokens FROM cp GROUP BY place"""
SQL["replay_diagnostics"] = replay_ctes() + """,
x AS (SELECT DISTINCT l.case_id, l.activity AS transition, is_fit, epoch_us(s.t1) - epoch_us(s.t0) AS us
      FROM log l JOIN tr USING (case_id) JOIN span s USING (case_id))
SELECT transition, count(*) FILTER (WHERE is_fit) AS fit_cases, count(*) FILTER (WHERE NOT is_fit) AS unfit_cases,
  quantile_cont(us, 0.5) FILTER (WHERE is_fit) / 1000000.0 AS median_fit_s,
  quantile_cont(us, 0.5) FILTER (WHERE NOT is_fit) / 1000000.0 AS median_unfit_s
FROM x GROUP BY transition"""
SQL["edge_conformance"] = f"WITH log AS ({DAY}),\n{steps_cte('day')},\nedges AS {_values(FIXED_EDGES, 'a, b')}" + """,
st AS (SELECT case_id, coalesce(pa, '▶') AS a, activity AS b FROM steps
       UNION ALL SELECT case_id, activity, '■' FROM steps WHERE na IS NULL)
SELECT case_id, count(*) AS n_steps, count(e.a) AS n_allowed, count(*) - count(e.a) AS n_deviations,
  round(count(e.a) / count(*), 6) AS fitness
FROM st LEFT JOIN edges e USING (a, b) GROUP BY case_id"""

_REF = _values([(i, a) for i, a in enumerate(REFERENCE_TRACE)], "pos, model_act")
_MOVES = f"""WITH log AS ({DAY}),
ref AS {_REF},
ev AS (SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY ts, tie) - 1 AS BIGINT) AS pos,
              activity AS log_act FROM log),
mdl AS (SELECT c.case_id, CAST(r.pos AS BIGINT) AS pos, r.model_act FROM (SELECT DISTINCT case_id FROM log) c CROSS JOIN ref r),
j AS (SELECT coalesce(ev.case_id, mdl.case_id) AS case_id, coalesce(ev.pos, mdl.pos) AS pos, log_act, model_act
      FROM ev FULL OUTER JOIN mdl ON ev.case_id = mdl.case_id AND ev.pos = mdl.pos),
moves AS (SELECT case_id, pos, log_act, model_act FROM j WHERE log_act = model_act
          UNION ALL SELECT case_id, pos, log_act, NULL FROM j WHERE log_act IS NOT NULL AND log_act IS DISTINCT FROM model_act
          UNION ALL SELECT case_id, pos, NULL, model_act FROM j WHERE model_act IS NOT NULL AND log_act IS DISTINCT FROM model_act),
costs AS (SELECT case_id, count(*) FILTER (WHERE log_act IS NULL OR model_act IS NULL) AS cost,
                 count(log_act) AS log_len, count(model_act) AS model_len FROM moves GROUP BY 1),
costs2 AS (SELECT *, round(1 - cost / (log_len + model_len), 6) AS fitness FROM costs)
"""
SQL["alignment_summary"] = _MOVES + """SELECT cost = 0 AS is_fit, count(*) AS n_cases, round(avg(cost), 6) AS mean_cost,
  min(cost) AS min_cost, max(cost) AS max_cost, min(fitness) AS min_fitness, arg_min(case_id, (fitness, case_id)) AS min_fitness_case,
  max(fitness) AS max_fitness, arg_max(case_id, (fitness, case_id)) AS max_fitness_case,
  round(count(*) / (SELECT count(*) FROM costs2), 6) AS share
FROM costs2 GROUP BY 1"""
SQL["anomaly_odds"] = _MOVES + """SELECT count(*) FILTER (WHERE cost > 0) AS n_unfit, count(*) FILTER (WHERE cost = 0) AS n_fit,
  round(count(*) FILTER (WHERE cost > 0) / count(*), 6) AS unfit_share,
  round(count(*) FILTER (WHERE cost > 0) / nullif(count(*) FILTER (WHERE cost = 0), 0), 6) AS odds_unfit_fit FROM costs2"""
SQL["model_move_pairs"] = _MOVES + """SELECT l.case_id, l.log_act AS activity, l.pos AS log_pos, m.pos AS model_pos
FROM (SELECT * FROM moves WHERE model_act IS NULL) l JOIN (SELECT * FROM moves WHERE log_act IS NULL) m
ON l.case_id = m.case_id AND l.log_act = m.model_act"""
SQL["anomaly_classes"] = _MOVES + """, lm AS (SELECT case_id, log_act AS activity, pos FROM moves WHERE model_act IS NULL),
mm AS (SELECT case_id, model_act AS activity, pos FROM moves WHERE log_act IS NULL)
SELECT DISTINCT * FROM (
  SELECT lm.case_id, lm.activity, CASE WHEN mm.pos < lm.pos THEN 'Late' ELSE 'Early' END AS class
  FROM lm JOIN mm ON lm.case_id = mm.case_id AND lm.activity = mm.activity
  UNION ALL SELECT case_id, activity, 'Skip' FROM mm WHERE NOT EXISTS
    (SELECT 1 FROM lm WHERE lm.case_id = mm.case_id AND lm.activity = mm.activity)
  UNION ALL SELECT case_id, activity, 'Insert' FROM lm WHERE NOT EXISTS
    (SELECT 1 FROM mm WHERE lm.case_id = mm.case_id AND lm.activity = mm.activity))"""
SQL["consensus_sequence"] = replay_ctes() + """,
g AS (SELECT case_id, CASE WHEN is_fit THEN 'regular' ELSE 'irregular' END AS grp FROM tr),
ps AS (SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY ts, tie) - 1 AS BIGINT) AS pos, activity FROM log),
c AS (SELECT grp, pos, activity, count(*) AS n FROM ps JOIN g USING (case_id) GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY grp, pos ORDER BY n DESC, activity) AS r FROM c)
SELECT t.grp, pos, activity AS mode, n AS count, round(n / nt, 6) AS share
FROM t JOIN (SELECT grp, count(*) AS nt FROM g GROUP BY 1) USING (grp) WHERE r = 1"""

_K1 = """SELECT round(count(*) FILTER (WHERE is_fit) * 100.0 / count(*), 6) AS perc_fit_traces,
  round(avg(fit_raw), 6) AS average_trace_fitness,
  round(0.5 * (1 - sum(remaining) / sum(produced)) + 0.5 * (1 - sum(missing) / sum(consumed)), 6) AS log_fitness FROM tr"""
SQL["replay_fitness"] = replay_ctes() + _K1


def _etc(places, arcs) -> str:
    P = [(p, m0) for p, m0, _ in places]
    T = sorted({a for a, _, _, _ in arcs})
    inputs = {t: sorted({p for a, p, ph, d in arcs if a == t and d < 0}) for t in T}
    marks = []
    for p, m0 in P:
        cases = " ".join(f"WHEN activity = '{a}' THEN {d}" for a, pl, ph, d in arcs if pl == p)
        delta = f"(CASE {cases} ELSE 0 END)" if cases else "0"
        marks.append(f"coalesce(sum({delta}) OVER (PARTITION BY case_id ORDER BY ts, tie ROWS BETWEEN UNBOUNDED PRECEDING "
                     f"AND 1 PRECEDING), 0) + {m0} AS \"m_{p}\"")
    en = {t: " AND ".join(f"\"m_{p}\" >= 1" for p in inputs[t]) or "TRUE" for t in T}
    ok = " OR ".join(f"(activity = '{t}' AND {en[t]})" for t in T)
    en_cols = ", ".join(f"({en[t]}) AS \"en_{t}\"" for t in T)
    esc = " + ".join(f"CAST(bool_or(\"en_{t}\") AND NOT bool_or(activity = '{t}') AS INTEGER)" for t in T)
    n_en = " + ".join(f"CAST(bool_or(\"en_{t}\") AS INTEGER)" for t in T)
    return f"""WITH log AS ({DAY}),
mk AS (SELECT case_id, activity, ts, tie, row_number() OVER (PARTITION BY case_id ORDER BY ts, tie) - 1 AS pos,
  coalesce(string_agg(activity, ',') OVER (PARTITION BY case_id ORDER BY ts, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prefix,
  {', '.join(marks)} FROM log),
ev AS (SELECT *, CAST(({ok}) AS INTEGER) AS ok, {en_cols} FROM mk),
fp AS (SELECT *, min(ok) OVER (PARTITION BY case_id ORDER BY ts, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fit_before FROM ev),
g AS (SELECT pos, prefix, count(*) AS w, {esc} AS esc, {n_en} AS n_en FROM fp
      WHERE fit_before IS NULL OR fit_before = 1 GROUP BY pos, prefix)
"""


SQL["etc_precision"] = _etc(FIXED_NET_PLACES, FIXED_NET_ARCS) + \
    "SELECT round(1 - sum(w * esc) / sum(w * n_en), 6) AS precision FROM g"


def _gen(arcs) -> str:
    return f"""(SELECT round(1 - avg(CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE 1 / sqrt(n) END), 6) AS generalization
FROM (SELECT DISTINCT activity FROM {_values(arcs, 'activity, place, phase, delta')}) t
LEFT JOIN (SELECT event_type AS activity, count(*) AS n FROM events GROUP BY 1) c USING (activity))"""


def _simp(places, arcs) -> str:
    n_nodes = len({p for p, _, _ in places}) + len({a for a, _, _, _ in arcs})
    return f"(SELECT round(1 / (1 + greatest(0, 2.0 * {len(arcs)} / {n_nodes} - 2)), 6) AS simplicity)"


SQL["generalization"] = "SELECT * FROM " + _gen(FIXED_NET_ARCS)
SQL["simplicity"] = _disc("day", _dep(0.05, 100, 50, 0.9) + """
SELECT CASE WHEN count(*) = 0 THEN 1.0::DOUBLE
  ELSE round(1 / (1 + greatest(0, 2.0 * (SELECT count(*) FROM kept) / count(DISTINCT x) - 2)), 6) END AS simplicity
FROM (SELECT a AS x FROM kept UNION ALL SELECT b FROM kept)""")
SQL["edge_precision"] = f"WITH log AS ({DAY}),\n{steps_cte('day')},\nedges AS {_values(FIXED_EDGES, 'a, b')}" + """,
dfg AS (SELECT activity AS a, na AS b, count(*) AS n FROM steps WHERE na IS NOT NULL GROUP BY 1, 2),
seen AS (SELECT e.a, count(*) AS n_allowed, count(d.n) AS n_seen FROM edges e LEFT JOIN dfg d USING (a, b) GROUP BY 1),
w AS (SELECT a, sum(n) AS w FROM dfg GROUP BY 1)
SELECT round(sum(w * n_seen / n_allowed) / sum(w), 6) AS edge_precision FROM seen JOIN w USING (a)"""


def _score(name: str, places, arcs) -> str:
    k1 = replay_ctes(places, arcs) + _K1
    k2 = _etc(places, arcs) + "SELECT round(1 - sum(w * esc) / sum(w * n_en), 6) AS precision FROM g"
    return f"""(SELECT '{name}' AS model, f.*, p.precision, g.generalization, s.simplicity,
  round((perc_fit_traces / 100 + average_trace_fitness + log_fitness + perc_fit_traces / 100) / 4
        + precision + generalization + simplicity, 6) AS score,
  round(((CASE WHEN perc_fit_traces < 1 THEN perc_fit_traces ELSE perc_fit_traces / 100 END) * 2
         + (CASE WHEN average_trace_fitness < 1 THEN average_trace_fitness ELSE average_trace_fitness / 100 END)
         + (CASE WHEN log_fitness < 1 THEN log_fitness ELSE log_fitness / 100 END)) / 4
        + precision + generalization + simplicity, 6) AS score_compat
FROM ({k1}) f, ({k2}) p, {_gen(arcs)} g, {_simp(places, arcs)} s)"""


SQL["model_score"] = "SELECT * FROM " + _score("fixed_net", FIXED_NET_PLACES, FIXED_NET_ARCS)
_RT = f"""SELECT *, CAST(row_number() OVER (ORDER BY score DESC, model) AS BIGINT) AS rank FROM (
  SELECT * FROM {_score('fixed_net', FIXED_NET_PLACES, FIXED_NET_ARCS)}
  UNION ALL SELECT * FROM {_score('sequential_net', SEQUENTIAL_NET_PLACES, SEQUENTIAL_NET_ARCS)})"""
SQL["rating_table"] = _RT
SQL["rank_models"] = f"SELECT rank, model, score, score_compat FROM ({_RT})"


# ------------------------------------------------------------------ sources and sinks: the source table is the oracle
SQL["src_csv_log"] = with_log("day", "SELECT * FROM log")
SQL["src_csv_semicolon"] = with_log("day", "SELECT * FROM log")
SQL["src_parse_timestamps"] = with_log("day", "SELECT case_id, activity, ts, tie FROM log")
SQL["src_cached_table"] = with_log("day", "SELECT * FROM log")
SQL["sink_table"] = SQL["case_profile"]
SQL["sink_by_category"] = f"WITH log AS ({_CAT_LOG}) SELECT * FROM log"
SQL["sink_report"] = SQL["rank_models"]
SQL["src_xes"] = with_log("day", "SELECT case_id, activity, ts, resource FROM log")
SQL["unfit_case_ids"] = replay_ctes() + """,
tags AS (SELECT case_id, 'missing:' || transition || '@' || place AS tag FROM probs
         UNION SELECT case_id, 'remaining:' || place FROM cp WHERE p + m - c > 0),
sig AS (SELECT case_id, string_agg(DISTINCT tag, ';' ORDER BY tag) AS signature FROM tags GROUP BY 1)
SELECT tr.case_id, coalesce(signature, '') AS signature, missing, remaining
FROM tr LEFT JOIN sig USING (case_id) WHERE NOT is_fit"""

SQL["flt_category_flags"] = f"""WITH log AS (SELECT *, tie % 2 = 0 AS verified, tie % 3 <> 0 AS received FROM ({_CAT_LOG}))
SELECT * FROM log WHERE (category, verified, received) IN (('3-way match, invoice after GR', true, true),
  ('3-way match, invoice before GR', false, true), ('2-way match', false, false), ('Consignment', false, true))"""
SQL["flt_attr_events_not"] = f"""WITH log AS (SELECT * REPLACE (CASE WHEN tie % 4 <> 0 THEN resource END AS resource) FROM ({DAY}))
SELECT * FROM log WHERE resource IS NULL OR resource NOT IN ('1', '2', '3')"""
SQL["replay_outside"] = with_log("day", """SELECT activity, count(*) AS n_events, count(DISTINCT case_id) AS n_cases
FROM log WHERE activity = 'error' GROUP BY activity""")


def _model_subsequences() -> str:
    """Every subsequence of the short model traces as a LIKE pattern over '<a><b>' texts."""
    from itertools import combinations

    from .operators.conformance import FIXED_NET_TRACES
    rows = []
    for m in FIXED_NET_TRACES:
        for k in range(len(m) + 1):
            for part in sorted(set(combinations(m, k))):
                rows.append((",".join(m), len(m), "%" + "%".join(f"<{a}>" for a in part) + "%", k))
    return _values(rows, "model_trace, k, pat, m")


# the longest common subsequence is the longest subsequence of the model trace that the variant holds
SQL["nearest_trace_alignment"] = variants_cte("day").rstrip() + f""",
w AS (SELECT variant, n_cases, len(string_split(variant, ',')) AS n, '<' || replace(variant, ',', '><') || '>' AS t FROM vc),
lcs AS (SELECT variant, n_cases, n, model_trace, k, max(m) AS lcs FROM w JOIN {_model_subsequences()} s ON w.t LIKE s.pat
        GROUP BY variant, n_cases, n, model_trace, k),
r AS (SELECT *, n + k - 2 * lcs AS cost,
        row_number() OVER (PARTITION BY variant ORDER BY n + k - 2 * lcs, model_trace) AS pick FROM lcs)
SELECT variant, n_cases, cost, model_trace, round(1 - cost / (n + 2), 6) AS fitness FROM r WHERE pick = 1"""


# the language of the fixed net is finite: of the cheapest model traces the one with the fewest log moves
SQL["net_alignment"] = SQL["nearest_trace_alignment"].rsplit(",\nr AS", 1)[0] + """,
r AS (SELECT *, n + k - 2 * lcs AS cost,
        row_number() OVER (PARTITION BY variant ORDER BY n + k - 2 * lcs, n - lcs) AS pick FROM lcs)
SELECT variant, n_cases, cost, n - lcs AS log_moves, k - lcs AS model_moves, lcs AS sync_moves,
  round(1 - cost / (n + 2), 6) AS fitness FROM r WHERE pick = 1"""


def _cut(log: str) -> str:
    """CTEs of the inductive cut ``cut(activity, cut, grp, grp_order)``; closures are recursive."""
    def closure(name: str, edges: str) -> str:
        return (f"{name}(a, b) AS (SELECT x, x FROM nodes UNION SELECT c.a, e.b FROM {name} c "
                f"JOIN {edges} e ON c.b = e.a)")

    def groups(name: str, closed: str) -> str:
        return f"{name} AS (SELECT a AS x, min(b) AS grp FROM {closed} GROUP BY a)"
    both = "SELECT a, b FROM {0} UNION SELECT b, a FROM {0}"
    return "WITH RECURSIVE " + _disc(log, f""",
nodes AS (SELECT DISTINCT activity AS x FROM log),
starts AS (SELECT DISTINCT activity AS x FROM steps WHERE pa IS NULL),
ends AS (SELECT DISTINCT activity AS x FROM steps WHERE na IS NULL),
pairs AS (SELECT p.x AS a, q.x AS b FROM nodes p JOIN nodes q ON p.x < q.x),
und AS (SELECT a, b FROM dfg WHERE a <> b UNION SELECT b, a FROM dfg WHERE a <> b),
{closure('c1', 'und')}, {groups('xg', 'c1')},
reach(a, b) AS (SELECT a, b FROM dfg UNION SELECT r.a, d.b FROM reach r JOIN dfg d ON r.b = d.a),
dir AS (SELECT p.a, p.b, f.a IS NOT NULL AS f, r.a IS NOT NULL AS r FROM pairs p
        LEFT JOIN reach f ON f.a = p.a AND f.b = p.b LEFT JOIN reach r ON r.a = p.b AND r.b = p.a),
same0 AS (SELECT a, b FROM dir WHERE f = r), same AS ({both.format('same0')}),
{closure('c2', 'same')}, {groups('sg', 'c2')},
across AS (SELECT ga.grp AS ga, gb.grp AS gb, f, r FROM dir JOIN sg ga ON ga.x = dir.a JOIN sg gb ON gb.x = dir.b
           WHERE ga.grp <> gb.grp),
behind AS (SELECT DISTINCT CASE WHEN f THEN ga ELSE gb END AS g0, CASE WHEN f THEN gb ELSE ga END AS grp FROM across),
so AS (SELECT g.grp, count(b.g0) AS o FROM (SELECT DISTINCT grp FROM sg) g LEFT JOIN behind b ON b.grp = g.grp GROUP BY g.grp),
apart0 AS (SELECT p.a, p.b FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM dfg WHERE dfg.a = p.a AND dfg.b = p.b)
           OR NOT EXISTS (SELECT 1 FROM dfg WHERE dfg.a = p.b AND dfg.b = p.a)), apart AS ({both.format('apart0')}),
{closure('c3', 'apart')}, {groups('pg', 'c3')},
rest AS (SELECT x FROM nodes WHERE x NOT IN (SELECT x FROM starts UNION SELECT x FROM ends)),
rest_e AS (SELECT a, b FROM und WHERE a IN (SELECT x FROM rest) AND b IN (SELECT x FROM rest)),
{closure('c4', 'rest_e')}, lg AS (SELECT a AS x, min(b) AS grp FROM c4 WHERE a IN (SELECT x FROM rest) GROUP BY a),
e2 AS (SELECT d.a, d.b, ga.grp AS ga, gb.grp AS gb FROM dfg d LEFT JOIN lg ga ON ga.x = d.a LEFT JOIN lg gb ON gb.x = d.b),
bad AS (SELECT gb AS grp FROM e2 WHERE gb IS NOT NULL AND ga IS DISTINCT FROM gb AND a NOT IN (SELECT x FROM ends)
        UNION SELECT ga FROM e2 WHERE ga IS NOT NULL AND ga IS DISTINCT FROM gb AND b NOT IN (SELECT x FROM starts)),
redo AS (SELECT x FROM lg WHERE grp NOT IN (SELECT grp FROM bad)),
kind AS (SELECT CASE
  WHEN (SELECT count(DISTINCT grp) FROM xg) > 1 THEN 'xor'
  WHEN (SELECT count(DISTINCT grp) FROM sg) > 1 AND NOT EXISTS (SELECT 1 FROM across WHERE f = r) THEN 'sequence'
  WHEN (SELECT count(DISTINCT grp) FROM pg) > 1 AND NOT EXISTS (SELECT grp FROM pg GROUP BY grp
       HAVING NOT bool_or(x IN (SELECT x FROM starts)) OR NOT bool_or(x IN (SELECT x FROM ends))) THEN 'parallel'
  WHEN (SELECT count(*) FROM redo) > 0 THEN 'loop'
  WHEN (SELECT count(*) FROM nodes) = 1 THEN 'activity' ELSE 'none' END AS k),
named AS (SELECT x, grp, dense_rank() OVER (ORDER BY grp) - 1 AS o, 'xor' AS k FROM xg
  UNION ALL SELECT sg.x, sg.grp, so.o, 'sequence' FROM sg JOIN so USING (grp)
  UNION ALL SELECT x, grp, dense_rank() OVER (ORDER BY grp) - 1, 'parallel' FROM pg
  UNION ALL SELECT x, CASE WHEN x IN (SELECT x FROM redo) THEN 'redo' ELSE 'do' END,
                   CASE WHEN x IN (SELECT x FROM redo) THEN 1 ELSE 0 END, 'loop' FROM nodes
  UNION ALL SELECT x, x, 0, 'activity' FROM nodes
  UNION ALL SELECT x, 'all', 0, 'none' FROM nodes),
cut AS (SELECT x AS activity, k AS cut, grp, CAST(o AS INTEGER) AS grp_order FROM named WHERE k = (SELECT k FROM kind))
""").removeprefix("WITH ")


SQL["activity_cut"] = _cut("day") + "SELECT * FROM cut"
SQL["log_split_by_cut"] = _cut("day") + """,
ev AS (SELECT log.*, c.cut, c.grp FROM log JOIN cut c USING (activity)),
most AS (SELECT case_id, grp, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, grp) AS r FROM ev GROUP BY 1, 2),
turn AS (SELECT *, CASE WHEN grp IS DISTINCT FROM lag(grp) OVER (PARTITION BY case_id ORDER BY ts, tie) THEN 1 ELSE 0 END AS t FROM ev),
piece AS (SELECT *, sum(t) OVER (PARTITION BY case_id ORDER BY ts, tie ROWS UNBOUNDED PRECEDING) AS p FROM turn)
SELECT p.case_id, p.activity, p.ts, p.tie, p.resource, p.num, p.user_id, p.cut, p.grp,
  p.case_id || '#' || CASE WHEN p.cut = 'loop' THEN CAST(CAST(p.p AS BIGINT) AS VARCHAR) ELSE p.grp END AS sub_case
FROM piece p LEFT JOIN most m ON m.case_id = p.case_id AND m.r = 1 WHERE p.cut <> 'xor' OR p.grp = m.grp"""


def _prefix_subsequences() -> str:
    """Every subsequence of every prefix of the short model traces as a LIKE pattern."""
    from itertools import combinations

    from .operators.conformance import FIXED_NET_TRACES
    rows = []
    for m in FIXED_NET_TRACES:
        for j in range(len(m) + 1):
            for k in range(j + 1):
                for part in sorted(set(combinations(m[:j], k))):
                    rows.append((",".join(m), j, "%" + "%".join(f"<{a}>" for a in part) + "%", k))
    return _values(rows, "model_trace, j, pat, k")


# the table of longest common subsequences from LIKE, walked back by recursion: synchronous, log, model move
SQL["alignment_moves"] = "WITH RECURSIVE " + SQL["nearest_trace_alignment"].rsplit("\nSELECT", 1)[0].removeprefix("WITH ") + f""",
t AS (SELECT variant, n_cases, model_trace, string_split(variant, ',') AS v, string_split(model_trace, ',') AS m FROM r WHERE pick = 1),
pre AS (SELECT variant, model_trace, i, CASE WHEN i = 0 THEN '' ELSE '<' || array_to_string(v[1:i], '><') || '>' END AS x
        FROM (SELECT *, unnest(range(len(v) + 1)) AS i FROM t)),
cells AS (SELECT variant, i, j, max(k) AS l FROM pre JOIN {_prefix_subsequences()} s
          ON s.model_trace = pre.model_trace AND pre.x LIKE s.pat GROUP BY variant, i, j),
walk(variant, n_cases, v, m, i, j, step, log_act, model_act) AS (
  SELECT variant, n_cases, v, m, CAST(len(v) AS BIGINT), CAST(len(m) AS BIGINT), 0, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM t
  UNION ALL
  SELECT variant, n_cases, v, m, i - (mv <> 'm')::int, j - (mv <> 'l')::int, step + 1,
    CASE WHEN mv <> 'm' THEN v[i] END, CASE WHEN mv <> 'l' THEN m[j] END
  FROM (SELECT w.*, CASE WHEN w.i > 0 AND w.j > 0 AND w.v[w.i] = w.m[w.j] THEN 's'
                         WHEN w.i > 0 AND up.l = here.l THEN 'l' ELSE 'm' END AS mv
        FROM walk w JOIN cells here ON here.variant = w.variant AND here.i = w.i AND here.j = w.j
        LEFT JOIN cells up ON up.variant = w.variant AND up.i = w.i - 1 AND up.j = w.j WHERE w.i + w.j > 0))
SELECT variant, n_cases, CAST(max(step) OVER (PARTITION BY variant) - step AS BIGINT) AS pos, log_act, model_act
FROM walk QUALIFY step > 0"""

# all sets of activities as bit masks: the valid pairs, of which the maximal ones
SQL["alpha_places"] = with_log("conv", """, steps AS (SELECT *, lead(activity) OVER w AS na, lag(activity) OVER w AS pa
  FROM log WINDOW w AS (PARTITION BY case_id ORDER BY turn)),
dfg AS (SELECT activity AS a, na AS b, count(*) AS n FROM steps WHERE na IS NOT NULL GROUP BY 1, 2)""" + _FP + """,
ids AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS i FROM (SELECT DISTINCT a FROM fp)),
masks AS (SELECT unnest(range(1, (1 << (SELECT count(*) FROM ids))::bigint)) AS m),
has AS (SELECT m, a FROM masks JOIN ids ON (m >> i) & 1 = 1),
free AS (SELECT m FROM masks WHERE m NOT IN (SELECT p.m FROM has p JOIN has q ON p.m = q.m
         JOIN fp ON fp.a = p.a AND fp.b = q.a WHERE relation <> '#')),
valid AS (SELECT p.m AS ma, q.m AS mb FROM free p CROSS JOIN free q WHERE NOT EXISTS (
          SELECT 1 FROM has x JOIN has y ON x.m = p.m AND y.m = q.m JOIN fp ON fp.a = x.a AND fp.b = y.a WHERE relation <> '->')),
top AS (SELECT ma, mb FROM valid v WHERE NOT EXISTS (SELECT 1 FROM valid w WHERE (w.ma, w.mb) <> (v.ma, v.mb)
        AND w.ma & v.ma = v.ma AND w.mb & v.mb = v.mb)),
names AS (SELECT m, string_agg(a, ',' ORDER BY a) AS t FROM has GROUP BY m),
ends AS (SELECT (SELECT coalesce(string_agg(DISTINCT activity, ',' ORDER BY activity), '') FROM steps WHERE pa IS NULL) AS s,
                (SELECT coalesce(string_agg(DISTINCT activity, ',' ORDER BY activity), '') FROM steps WHERE na IS NULL) AS e),
sets AS (SELECT x.t AS inputs, y.t AS outputs FROM top JOIN names x ON x.m = ma JOIN names y ON y.m = mb
         UNION ALL SELECT '', s FROM ends UNION ALL SELECT e, '' FROM ends)
SELECT 'p(' || inputs || '|' || outputs || ')' AS place, inputs, outputs FROM sets""")


# the alpha net of the log beside the fixed net, every figure row by row and model by model
SQL["rate_discovered"] = with_log("conv", f""", ap AS (SELECT * FROM ({SQL["alpha_places"]})),
places AS (SELECT 'alpha_net' AS model, place, CAST(inputs = '' AS INTEGER) AS m0, CAST(outputs = '' AS INTEGER) AS mf FROM ap
  UNION ALL SELECT 'fixed_net', place, m0, mf FROM {_values(FIXED_NET_PLACES, 'place, m0, mf')}),
arcs AS (SELECT 'alpha_net' AS model, unnest(string_split(inputs, ',')) AS activity, place, 1 AS phase, 1 AS delta
    FROM ap WHERE inputs <> ''
  UNION ALL SELECT 'alpha_net', unnest(string_split(outputs, ',')), place, 0, -1 FROM ap WHERE outputs <> ''
  UNION ALL SELECT 'fixed_net', activity, place, phase, delta FROM {_values(FIXED_NET_ARCS, 'activity, place, phase, delta')}),
models AS (SELECT DISTINCT model FROM places),
ev AS (SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY turn) AS i FROM log),
ends AS (SELECT case_id, max(i) AS n FROM ev GROUP BY 1),
rws AS (SELECT e.case_id, a.model, a.place, e.i, a.phase, a.delta FROM ev e JOIN arcs a USING (activity)
  UNION ALL SELECT case_id, model, place, 0, 1, m0 FROM ends CROSS JOIN places
  UNION ALL SELECT case_id, model, place, n + 1, 0, -mf FROM ends CROSS JOIN places),
bal AS (SELECT *, sum(delta) OVER (PARTITION BY case_id, model, place ORDER BY i, phase ROWS UNBOUNDED PRECEDING) AS b FROM rws),
cp AS (SELECT case_id, model, place, sum(greatest(delta, 0)) AS p, sum(greatest(-delta, 0)) AS c, greatest(0, -min(b)) AS m
  FROM bal GROUP BY 1, 2, 3),
cs AS (SELECT case_id, model, sum(p) AS p, sum(c) AS c, sum(m) AS m, sum(p + m - c) AS r FROM cp GROUP BY 1, 2),
fit AS (SELECT model, round(count(*) FILTER (WHERE m = 0 AND r = 0) * 100.0 / count(*), 6) AS perc_fit_traces,
  round(avg(0.5 * (1 - r / p) + 0.5 * (1 - m / c)), 6) AS average_trace_fitness,
  round(0.5 * (1 - sum(r) / sum(p)) + 0.5 * (1 - sum(m) / sum(c)), 6) AS log_fitness FROM cs GROUP BY 1),
marks AS (SELECT e.case_id, e.i, r.model, r.place, sum(r.delta) AS tok FROM ev e
  JOIN rws r ON r.case_id = e.case_id AND r.i < e.i GROUP BY 1, 2, 3, 4),
trans AS (SELECT DISTINCT model, activity FROM arcs),
needs AS (SELECT DISTINCT model, activity, place FROM arcs WHERE delta < 0),
en AS (SELECT e.case_id, e.i, t.model, t.activity FROM ev e CROSS JOIN trans t
  LEFT JOIN needs n ON n.model = t.model AND n.activity = t.activity
  LEFT JOIN marks k ON k.case_id = e.case_id AND k.i = e.i AND k.model = n.model AND k.place = n.place
  GROUP BY 1, 2, 3, 4 HAVING count(n.place) FILTER (WHERE coalesce(k.tok, 0) < 1) = 0),
ok AS (SELECT e.case_id, e.i, x.model, en.activity IS NOT NULL AS ok FROM ev e CROSS JOIN models x
  LEFT JOIN en ON en.case_id = e.case_id AND en.i = e.i AND en.model = x.model AND en.activity = e.activity),
pre AS (SELECT case_id, i, model, coalesce(bool_and(ok) OVER (PARTITION BY case_id, model ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS fits FROM ok),
px AS (SELECT case_id, i, activity, coalesce(string_agg(activity, ',') OVER (PARTITION BY case_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prefix FROM ev),
weights AS (SELECT model, prefix, count(*) AS w FROM px JOIN pre USING (case_id, i) WHERE fits GROUP BY 1, 2),
allowed AS (SELECT DISTINCT en.model, prefix, en.activity FROM px JOIN pre USING (case_id, i)
  JOIN en ON en.case_id = px.case_id AND en.i = px.i AND en.model = pre.model WHERE fits),
seen AS (SELECT DISTINCT prefix, activity FROM px),
open AS (SELECT w.model, w.prefix, w.w, count(a.activity) AS n_en,
    count(a.activity) FILTER (WHERE s.activity IS NULL) AS esc FROM weights w
  LEFT JOIN allowed a ON a.model = w.model AND a.prefix = w.prefix
  LEFT JOIN seen s ON s.prefix = a.prefix AND s.activity = a.activity GROUP BY 1, 2, 3),
prec AS (SELECT model, round(1 - sum(w * esc) / sum(w * n_en), 6) AS precision FROM open GROUP BY 1),
gen AS (SELECT model, round(1 - avg(CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE 1 / sqrt(n) END), 6) AS generalization
  FROM trans LEFT JOIN (SELECT activity, count(*) AS n FROM log GROUP BY 1) USING (activity) GROUP BY 1),
simp AS (SELECT model, round(1 / (1 + greatest(0, 2.0 * a.n / (p.n + t.n) - 2)), 6) AS simplicity
  FROM (SELECT model, count(*) AS n FROM arcs GROUP BY 1) a JOIN (SELECT model, count(*) AS n FROM places GROUP BY 1) p USING (model)
  JOIN (SELECT model, count(*) AS n FROM trans GROUP BY 1) t USING (model)),
rated AS (SELECT *, CASE WHEN perc_fit_traces < 1 THEN perc_fit_traces ELSE perc_fit_traces / 100 END AS pf,
    CASE WHEN average_trace_fitness < 1 THEN average_trace_fitness ELSE average_trace_fitness / 100 END AS af,
    CASE WHEN log_fitness < 1 THEN log_fitness ELSE log_fitness / 100 END AS lf
  FROM fit JOIN prec USING (model) JOIN gen USING (model) JOIN simp USING (model)),
scored AS (SELECT model, perc_fit_traces, average_trace_fitness, log_fitness, precision, generalization, simplicity,
    round((perc_fit_traces / 50 + average_trace_fitness + log_fitness) / 4 + precision + generalization + simplicity, 6) AS score,
    round((2 * pf + af + lf) / 4 + precision + generalization + simplicity, 6) AS score_compat FROM rated)
SELECT *, CAST(row_number() OVER (ORDER BY score DESC, model) AS BIGINT) AS rank FROM scored""")
