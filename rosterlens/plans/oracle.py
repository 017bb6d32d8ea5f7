"""DuckDB SQL twin of every registered analysis (the correctness oracle).

Each statement starts from the raw ``orders`` / ``customer`` / ``nation``
views, derives the same panel with window functions, and computes the
analysis in plain SQL: an independent formulation of the same result.
Types are cast to match the Spark side (``year`` INTEGER, sums BIGINT).
"""

from __future__ import annotations

from rosterlens import constants as K

# --- fixed values: the Q5 / Q6 reports as the studied analysis words them; written out here, not taken from the
# Spark side: (key, kind, column, quantile of the long side, quantile of the short side)
_REPORTS = {
    "terminated": ("q5_term_service", [
        ("q5_1_age_summary", "summary", "age", 0.9, 0.1),
        ("q5_2_gender", "share", "gender_short", 0.9, 0.1),
        ("q5_3_mean_gender", "mean", "gender_short", None, None),
        ("q5_4_bu", "share", "BUSINESS_UNIT", 0.9, 0.1),
        ("q5_5_mean_bu", "mean", "BUSINESS_UNIT", None, None),
        ("q5_6_city", "share", "city_name", 0.99, 0.01),
        ("q5_7_mean_city", "extreme", "city_name", 0.9, 0.1),
        ("q5_8_job", "share", "job_title", 0.99, 0.01),
        ("q5_9_mean_job", "extreme", "job_title", 0.9, 0.1),
        ("q5_10_dept", "share", "department_name", 0.99, 0.01),
        ("q5_11_mean_dept", "extreme", "department_name", 0.9, 0.1),
        ("q5_12_store", "share", "store_name", 0.99, 0.01),
        ("q5_13_mean_store", "extreme", "store_name", 0.9, 0.1),
        ("q5_14_reason", "share", "termreason_desc", 0.9, 0.1),
        ("q5_15_mean_reason", "mean", "termreason_desc", None, None),
        ("q5_16_agegroup", "share", "agegroup", 0.9, 0.1),
        ("q5_17_mean_agegroup", "mean", "agegroup", None, None),
        ("q5_18_under20", "under20", "agegroup", None, None),
    ]),
    "active": ("q6_active_service", [
        ("q6_1_age_summary", "summary", "age", 0.9, 0.1),
        ("q6_2_gender", "share", "gender_short", 0.9, 0.1),
        ("q6_3_mean_gender", "mean", "gender_short", None, None),
        ("q6_4_bu", "share", "BUSINESS_UNIT", 0.9, 0.1),
        ("q6_5_mean_bu", "mean", "BUSINESS_UNIT", None, None),
        ("q6_6_city", "share", "city_name", 0.99, 0.01),
        ("q6_7_mean_city", "extreme", "city_name", 0.9, 0.1),
        ("q6_8_job", "share", "job_title", 0.99, 0.01),
        ("q6_9_mean_job", "extreme", "job_title", 0.9, 0.1),
        ("q6_10_dept", "share", "department_name", 0.99, 0.01),
        ("q6_11_mean_dept", "extreme", "department_name", 0.9, 0.1),
        ("q6_12_store", "share", "store_name", 0.99, 0.01),
        ("q6_13_mean_store", "extreme", "store_name", 0.9, 0.1),
        ("q6_14_mean_reason", "mean", "termreason_desc", None, None),
        ("q6_15_agegroup", "share", "agegroup", 0.9, 0.1),
        ("q6_16_mean_agegroup", "mean", "agegroup", None, None),
    ]),
}
# -------------------------------------------------------------------------------------------------------------

_PANEL = """
_o AS (
  SELECT o_orderkey, o_custkey, o_orderdate, CAST(o_orderdate AS DATE) AS rec
  FROM orders
),
_j AS (
  SELECT _o.*, c.c_mktsegment, n.n_name, n.n_regionkey,
         CAST(min(rec) OVER (PARTITION BY o_custkey) - CAST((o_custkey * 37) % 3000 AS INTEGER) AS DATE) AS hire,
         max(rec) OVER (PARTITION BY o_custkey) AS last_rec,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM _o JOIN customer c ON _o.o_custkey = c.c_custkey
          JOIN nation n ON c.c_nationkey = n.n_nationkey
),
_b AS (
  SELECT *, CAST(hire - CAST(4000 + (o_custkey * 7919) % 28000 AS INTEGER) AS DATE) AS birth FROM _j
),
_p AS (
  SELECT
    o_orderkey AS ok, o_custkey AS ck,
    o_orderkey AS snapshot_id,
    1318 + o_custkey + o_custkey // 6 AS EmployeeID,
    rec AS recorddate_key,
    birth AS birthdate_key,
    hire AS orighiredate_key,
    CASE WHEN o_custkey % 3 = 0 THEN last_rec ELSE DATE '1900-01-01' END AS terminationdate_key,
    CAST(floor(date_diff('day', birth, rec) / 365.25) AS INTEGER) AS age,
    CAST(year(rec) - year(hire) AS INTEGER) AS length_of_service,
    n_name AS city_name,
    c_mktsegment || '-' || CAST(o_orderkey % 4 AS VARCHAR) AS department_name,
    'JOB_' || CAST(o_orderkey % 47 AS VARCHAR) AS job_title,
    CAST(o_orderkey % 46 AS INTEGER) AS store_name,
    CASE WHEN o_custkey % 43 = 7 THEN 'X' WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender_short,
    CASE WHEN o_custkey % 43 = 7 THEN 'Other' WHEN o_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender_full,
    CASE WHEN rn = 1 AND o_custkey % 9 = 0 THEN 'Layoff'
         WHEN rn = 1 AND o_custkey % 9 = 3 THEN 'Resignation'
         WHEN rn = 1 AND o_custkey % 9 = 6 THEN 'Retirement'
         ELSE 'Not Applicable' END AS termreason_desc,
    CASE WHEN rn = 1 AND o_custkey % 9 = 0 THEN 'Involuntary'
         WHEN rn = 1 AND o_custkey % 3 = 0 THEN 'Voluntary'
         ELSE 'Not Applicable' END AS termtype_desc,
    CAST(year(rec) AS INTEGER) AS STATUS_YEAR,
    CASE WHEN rn = 1 AND o_custkey % 3 = 0 THEN 'TERMINATED' ELSE 'ACTIVE' END AS STATUS,
    CASE WHEN n_regionkey = 0 THEN 'HEADOFFICE' ELSE 'STORES' END AS BUSINESS_UNIT
  FROM _b
),
panel AS (
  SELECT
    snapshot_id, EmployeeID, recorddate_key,
    CASE WHEN ck % 61 <> 4 THEN birthdate_key END AS birthdate_key,
    CASE WHEN ck % 97 <> 13 THEN orighiredate_key END AS orighiredate_key,
    CASE WHEN ck % 101 <> 17 THEN terminationdate_key END AS terminationdate_key,
    CASE WHEN ok % 59 <> 8 AND ck % 61 <> 4 THEN age END AS age,
    CASE WHEN ok % 71 <> 6 AND ck % 97 <> 13 THEN length_of_service END AS length_of_service,
    CASE WHEN ok % 107 <> 10 THEN city_name END AS city_name,
    CASE WHEN ok % 89 <> 3 THEN department_name END AS department_name,
    CASE WHEN ok % 83 <> 2 THEN job_title END AS job_title,
    CASE WHEN ok % 79 <> 1 THEN store_name END AS store_name,
    CASE WHEN ck % 41 <> 5 THEN gender_short END AS gender_short,
    CASE WHEN ck % 41 <> 5 THEN gender_full END AS gender_full,
    CASE WHEN ok % 97 <> 5 THEN termreason_desc END AS termreason_desc,
    CASE WHEN ok % 103 <> 9 THEN termtype_desc END AS termtype_desc,
    STATUS_YEAR, STATUS,
    CASE WHEN ck % 53 <> 11 THEN BUSINESS_UNIT END AS BUSINESS_UNIT
  FROM _p
),
latest AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY EmployeeID
        ORDER BY length_of_service DESC, recorddate_key ASC NULLS LAST, snapshot_id ASC NULLS LAST) AS _rn
    FROM panel WHERE length_of_service IS NOT NULL
  ) WHERE _rn = 1
),
terminated AS (
  SELECT * EXCLUDE (length_of_service), length_of_service AS service FROM latest WHERE STATUS = 'TERMINATED'
),
active AS (
  SELECT * EXCLUDE (length_of_service), length_of_service AS service FROM latest WHERE STATUS = 'ACTIVE'
),
hire_ages AS (
  SELECT DISTINCT CAST(year(orighiredate_key) AS INTEGER) AS year, BUSINESS_UNIT, EmployeeID,
         CAST(floor(abs(date_diff('day', birthdate_key, orighiredate_key)) / 365.25) AS INTEGER) AS age,
         'hired' AS action
  FROM panel
),
term_ages AS (
  SELECT DISTINCT CAST(year(terminationdate_key) AS INTEGER) AS year, BUSINESS_UNIT, EmployeeID,
         CAST(floor(abs(date_diff('day', birthdate_key, terminationdate_key)) / 365.25) AS INTEGER) AS age,
         'termed' AS action
  FROM panel WHERE year(terminationdate_key) <> 1900
),
events AS (SELECT * FROM hire_ages UNION ALL SELECT * FROM term_ages),
reasoned AS (SELECT * FROM panel WHERE termreason_desc <> 'Not Applicable')
"""

_BAND = """CASE WHEN {a} < 20 THEN '<20' WHEN {a} < 30 THEN '20-29' WHEN {a} < 40 THEN '30-39'
  WHEN {a} < 50 THEN '40-49' WHEN {a} < 60 THEN '50-59' WHEN {a} < 70 THEN '60-69'
  WHEN {a} < 80 THEN '70-79' WHEN {a} < 90 THEN '80-89' END"""


def _with(body: str, extra: str = "") -> str:
    ctes = _PANEL.strip() + (",\n" + extra.strip() if extra else "")
    return f"WITH {ctes}\n{body.strip()}"


def _label(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS VARCHAR), 'NA') || ' ' || coalesce(CAST({b} AS VARCHAR), 'NA')"


def _hires(dims: list[str], n: str = "n") -> str:
    d = "".join(f", {x}" for x in dims)
    return (f"SELECT CAST(year(orighiredate_key) AS INTEGER) AS year{d}, count(DISTINCT EmployeeID) AS {n} "
            f"FROM panel GROUP BY ALL")


def _terms(dims: list[str], n: str = "n") -> str:
    d = "".join(f", {x}" for x in dims)
    return (f"SELECT CAST(year(terminationdate_key) AS INTEGER) AS year{d}, count(DISTINCT EmployeeID) AS {n} "
            f"FROM panel WHERE year(terminationdate_key) <> 1900 GROUP BY ALL")


def _flow(dims: list[str]) -> str:
    keys = ["year", *dims]
    on = " AND ".join(f"h.{k} IS NOT DISTINCT FROM t.{k}" for k in keys)
    sel = ", ".join(f"coalesce(h.{k}, t.{k}) AS {k}" for k in keys)
    return (f"SELECT {sel}, coalesce(h.hired, 0) AS hired, coalesce(t.termed, 0) AS termed "
            f"FROM ({_hires(dims, 'hired')}) h FULL OUTER JOIN ({_terms(dims, 'termed')}) t ON {on}")


def _long(flow: str, ids: list[str], value: str = "amount") -> str:
    i = ", ".join(ids)
    return (f"SELECT {i}, 'hired' AS action, hired AS {value} FROM ({flow}) "
            f"UNION ALL SELECT {i}, 'termed' AS action, termed AS {value} FROM ({flow})")


def _net_flow() -> str:
    return (f"SELECT year, hired, termed, CAST(sum(hired - termed) OVER (ORDER BY year NULLS LAST "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM ({_flow([])})")


def _share(counts: str, value: str) -> str:
    return f"SELECT *, {value} / (SELECT sum({value}) FROM ({counts})) AS share FROM ({counts})"


def _box(rows: str, key: str, with_range: bool) -> str:
    rng = ", any_value(s_min) AS min, any_value(s_max) AS max" if with_range else ""
    for name, value in (("mean", "mean"), ("min", "s_min"), ("max", "s_max"))[: 3 if with_range else 1]:
        rng += f", round_even(CAST(any_value({value}) AS DOUBLE), 1) AS {name}_label"
    return f"""
    SELECT r.{key},
      round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
      round(least(any_value(q1), min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN CAST(v AS DOUBLE) END)), 6) AS lo,
      round(greatest(any_value(q3), max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN CAST(v AS DOUBLE) END)), 6) AS hi,
      CAST(sum(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_out,
      round(any_value(mean), 6) AS mean{rng}
    FROM ({rows}) r JOIN (
      SELECT {key}, CAST(quantile_cont(v, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont(v, 0.5) AS DOUBLE) AS median,
             CAST(quantile_cont(v, 0.75) AS DOUBLE) AS q3, avg(v) AS mean, min(v) AS s_min, max(v) AS s_max
      FROM ({rows}) WHERE v IS NOT NULL GROUP BY {key}
    ) s ON r.{key} IS NOT DISTINCT FROM s.{key}
    WHERE v IS NOT NULL
    GROUP BY r.{key}
    """


def _box_outliers(rows: str, key: str) -> str:
    return f"""
    SELECT r.{key}, CAST(v AS INTEGER) AS age, count(*) AS n
    FROM ({rows}) r JOIN (
      SELECT {key}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM ({rows}) WHERE v IS NOT NULL GROUP BY {key}
    ) s ON r.{key} IS NOT DISTINCT FROM s.{key}
    WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)
    GROUP BY r.{key}, v
    """


def _student_t(degrees: str) -> str:
    """(df, t): the 0.975 quantile of Student's t, by numeric integration and halving steps.

    With t = sqrt(df) * tan(a) the chance of |T| <= t is the integral of cos(u)^(df - 1) from 0 to a over that
    from 0 to pi/2, whose tail beyond 14 / sqrt(df) is nothing. Simpson's rule; a is found one binary digit at a time.
    """
    simpson = (
        "({x}) / 3000.0 * list_sum(list_transform(range(1001), lambda i: "
        "CASE WHEN i = 0 OR i = 1000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END * pow(cos(({x}) * i / 1000.0), df - 1)))"
    )
    return f"""
      SELECT df, CASE WHEN df >= 1 THEN sqrt(df) * tan(list_reduce(
               list_prepend(CAST(0 AS DOUBLE), list_transform(range(1, 50), lambda b: top / pow(2.0, b))),
               lambda a, h: CASE WHEN {simpson.format(x="a + h")} <= 0.95 * whole THEN a + h ELSE a END)) END AS t
      FROM (SELECT df, top, {simpson.format(x="top")} AS whole
            FROM (SELECT df, least(pi() / 2, 14 / sqrt(greatest(df, 1))) AS top FROM ({degrees})))
    """


def _extreme_member(dim: str, largest: bool) -> str:
    order = "n DESC" if largest else "n ASC"
    return f"""
    SELECT termreason_desc, {dim}, n FROM (
      SELECT *, row_number() OVER (PARTITION BY termreason_desc ORDER BY {order}, {dim} ASC NULLS LAST) AS _rn
      FROM (SELECT termreason_desc, {dim}, count(*) AS n FROM reasoned GROUP BY ALL)
    ) WHERE _rn = 1
    """


def _employees_by(dim: str) -> str:
    counts = f"SELECT {dim}, count(DISTINCT EmployeeID) AS n FROM panel WHERE length_of_service IS NOT NULL GROUP BY {dim}"
    return f"SELECT * FROM ({counts}) WHERE n >= (SELECT quantile_cont(n, 0.8) FROM ({counts}))"


def _growth() -> dict[str, str]:
    q: dict[str, str] = {}
    q["q1_1_hires_by_year"] = _with(_hires([]))
    q["q1_1_terms_by_year"] = _with(_terms([]))
    q["q1_1_flow"] = _with(_net_flow())
    q["q1_1_flow_long"] = _with(_long(_net_flow(), ["year", "total"]))
    q["q1_2_flow_by_bu"] = _with(_flow([K.BU]))
    bu_long = _long(_flow([K.BU]), ["year", K.BU])
    q["q1_2_flow_by_bu_long"] = _with(bu_long)
    q["q1_2_total_by_year"] = _with(
        f"SELECT year, CAST(sum(amount) AS BIGINT) AS amount FROM ({bu_long}) WHERE year IS NOT NULL GROUP BY year")
    q["q1_2_bu_action"] = _with(
        f"SELECT year, regexp_replace(BUSINESS_UNIT || '.' || action, '^([^.]*)\\.', '\\1' || chr(10)) AS BU_action, "
        f"amount FROM ({bu_long})")
    rename = lambda s: f"SELECT * RENAME (gender_short AS gender) FROM ({s})"
    q["q1_3_hires_by_gender"] = _with(rename(_hires([K.GENDER])))
    q["q1_3_terms_by_gender"] = _with(rename(_terms([K.GENDER])))
    g_flow = rename(_flow([K.GENDER]))
    q["q1_3_flow_by_gender"] = _with(g_flow)
    g_long = _long(g_flow, ["year", "gender"])
    q["q1_3_flow_by_gender_long"] = _with(g_long)
    totals = (f"SELECT {_label('gender', 'action')} AS gender_action, CAST(sum(amount) AS BIGINT) AS total "
              f"FROM ({g_long}) GROUP BY gender, action")
    q["q1_3_gender_action_total"] = _with(_share(totals, "total"))
    q["q1_4_reason_type_levels"] = _with(
        f"SELECT DISTINCT {_label('termreason_desc', 'termtype_desc')} AS label FROM panel")
    q["q1_4_reason_by_year"] = _with(
        "SELECT termreason_desc, STATUS_YEAR AS year, count(*) AS n FROM reasoned GROUP BY termreason_desc, STATUS_YEAR")
    d_flow = f"SELECT * RENAME (department_name AS dept) FROM ({_flow([K.DEPT])})"
    q["q1_5_flow_by_dept"] = _with(d_flow)
    q["q1_5_flow_by_dept_long"] = _with(_long(d_flow, ["year", "dept"], "number"))
    return q


def _ages() -> dict[str, str]:
    q: dict[str, str] = {}
    q["q2_1_hired_age"] = _with("SELECT * FROM hire_ages")
    q["q2_2_termed_age"] = _with("SELECT * FROM term_ages")
    q["q2_age_union"] = _with("SELECT * FROM events")
    q["q2_3_mean_age_trend"] = _with(
        f"SELECT action, BUSINESS_UNIT, year, avg(age) AS mean_age, {_label('action', 'BUSINESS_UNIT')} AS BU_action "
        f"FROM events GROUP BY action, BUSINESS_UNIT, year")
    fit_rows = f"SELECT {_label('action', 'BUSINESS_UNIT')} AS BU_action, year, age FROM events"
    # the engine's own regression aggregates; both sides are rounded (6 and 4 digits) before they are compared
    fit = f"""
      SELECT BU_action, CAST(regr_count(age, year) AS BIGINT) AS n, regr_slope(age, year) AS slope, regr_intercept(age, year) AS intercept,
        regr_r2(age, year) AS r2, regr_sxx(age, year) AS sxx, regr_syy(age, year) AS syy, regr_sxy(age, year) AS sxy,
        regr_avgx(age, year) AS avgx
      FROM ({fit_rows}) WHERE year IS NOT NULL AND age IS NOT NULL GROUP BY BU_action
    """
    defined = "n > 1 AND sxx > 0"
    q["q2_3_age_fit"] = _with(
        # "+ 0.0" turns a rounded -0.0 into 0.0, as Spark's round returns
        f"SELECT BU_action, CASE WHEN {defined} THEN round(slope, 6) + 0.0 END AS slope, "
        f"CASE WHEN {defined} THEN round(intercept, 4) + 0.0 END AS intercept, "
        f"CASE WHEN {defined} THEN round(CASE WHEN syy = 0 THEN 1.0 ELSE r2 END, 6) + 0.0 END AS r2, n FROM ({fit})")
    # the fitted value as a fraction of whole numbers: fit = mean age + slope * (year - mean year)
    whole = f"""
      SELECT BU_action, CAST(count(*) AS HUGEINT) AS k, CAST(sum(year) AS HUGEINT) AS sx, CAST(sum(age) AS HUGEINT) AS sy,
        CAST(sum(CAST(year AS HUGEINT) * year) AS HUGEINT) AS sqx, CAST(sum(CAST(year AS HUGEINT) * age) AS HUGEINT) AS pxy
      FROM ({fit_rows}) WHERE year IS NOT NULL AND age IS NOT NULL GROUP BY BU_action
    """
    q["q2_3_age_fit_grid"] = _with(f"""
      SELECT BU_action, year, round(fit, 4) + 0.0 AS fit, round(se, 4) + 0.0 AS se_fit,
        round(fit - t * se, 4) + 0.0 AS band_low, round(fit + t * se, 4) + 0.0 AS band_high, n
      FROM (
        SELECT f.BU_action, CAST(g.year AS INTEGER) AS year, n, t,
          CAST(sy * (k * sqx - sx * sx) + (k * pxy - sx * sy) * (k * g.year - sx) AS DOUBLE)
            / CAST(k * (k * sqx - sx * sx) AS DOUBLE) AS fit,
          CASE WHEN n > 2 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0.0) / (n - 2))
               * sqrt(1.0 / n + (g.year - avgx) * (g.year - avgx) / sxx) END AS se
        FROM ({fit}) f JOIN ({whole}) w ON f.BU_action IS NOT DISTINCT FROM w.BU_action
          JOIN ({_student_t(f"SELECT DISTINCT n - 2 AS df FROM ({fit})")}) s ON s.df = f.n - 2,
          (SELECT unnest(range((SELECT min(year) FROM events), (SELECT max(year) FROM events) + 1)) AS year) g
        WHERE {defined})
    """)
    q["q2_3_term_mean_age"] = _with(
        f"SELECT CAST(year(terminationdate_key) AS INTEGER) AS year, termreason_desc, "
        f"{_label('gender_short', 'BUSINESS_UNIT')} AS BU_gender, avg(age) AS mean_age "
        f"FROM reasoned GROUP BY ALL")
    q["q2_3_hire_mean_age"] = _with("""
      SELECT year, BUSINESS_UNIT, gender_full, avg(hired_age) AS mean_hired FROM (
        SELECT CAST(year(orighiredate_key) AS INTEGER) AS year, BUSINESS_UNIT, gender_full, EmployeeID,
               min(CAST(floor(abs(date_diff('day', birthdate_key, orighiredate_key)) / 365.25) AS INTEGER)) AS hired_age
        FROM panel GROUP BY ALL
      ) GROUP BY year, BUSINESS_UNIT, gender_full
    """)
    boxed = f"SELECT {_label('BUSINESS_UNIT', 'action')} AS BU_action, age AS v FROM events"
    q["q2_4_age_box"] = _with(_box(boxed, "BU_action", False))
    q["q2_4_age_outliers"] = _with(_box_outliers(boxed, "BU_action"))
    for key, table in (("q2_4_hired_agegroup", "hire_ages"), ("q2_4_termed_agegroup", "term_ages")):
        counts = f"SELECT {_BAND.format(a='age')} AS agegroup, count(*) AS n FROM {table} GROUP BY ALL"
        q[key] = _with(_share(counts, "n"))
    return q


def _reasons() -> dict[str, str]:
    q: dict[str, str] = {}
    counts = "SELECT termreason_desc, gender_short, count(*) AS n FROM reasoned GROUP BY ALL"
    q["q3_1_reason_gender"] = _with(
        f"SELECT *, coalesce(termreason_desc, 'NA') || ' (' || coalesce(gender_short, 'NA') || '): ' || CAST(n AS VARCHAR) "
        f"AS label FROM ({_share(counts, 'n')})")
    q["q3_2_reason_ages"] = _with("SELECT termreason_desc, age FROM reasoned")
    q["q3_2_reason_mean_age"] = _with("SELECT termreason_desc, avg(age) AS mean_age FROM reasoned GROUP BY ALL")
    q["q3_2_reason_age_box"] = _with(_box("SELECT termreason_desc, age AS v FROM reasoned", "termreason_desc", True))
    q["q3_2_reason_age_outliers"] = _with(_box_outliers("SELECT termreason_desc, age AS v FROM reasoned", "termreason_desc"))
    q["q3_3_reason_bu"] = _with("SELECT termreason_desc, BUSINESS_UNIT, count(*) AS n FROM reasoned GROUP BY ALL")
    for num, dim in (("4", K.DEPT), ("5", K.CITY), ("6", K.JOB)):
        short = {K.DEPT: "dept", K.CITY: "city", K.JOB: "job"}[dim]
        q[f"q3_{num}_top_{short}"] = _with(_extreme_member(dim, True))
        q[f"q3_{num}_least_{short}"] = _with(_extreme_member(dim, False))
    return q


def _hiring() -> dict[str, str]:
    q = {
        "q4_1_top20_job": _with(_employees_by(K.JOB)),
        "q4_2_top20_dept": _with(_employees_by(K.DEPT)),
        "q4_3_top20_city": _with(_employees_by(K.CITY)),
    }
    wide = """
      SELECT job_title AS job,
             count(*) FILTER (WHERE gender_short = 'F') AS Female,
             count(*) FILTER (WHERE gender_short = 'M') AS Male,
             count(*) FILTER (WHERE gender_short IS NULL OR gender_short NOT IN ('F', 'M')) AS Other,
             count(*) AS total
      FROM (
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY EmployeeID
              ORDER BY length_of_service ASC, recorddate_key ASC NULLS LAST, snapshot_id ASC NULLS LAST) AS _rn
          FROM panel WHERE length_of_service IS NOT NULL
        ) WHERE _rn = 1
      ) GROUP BY job_title
    """
    q["q4_4_top20_job_gender"] = _with(
        f"SELECT * FROM ({wide}) WHERE total >= (SELECT quantile_cont(total, 0.8) FROM ({wide}))")
    return q


def _service_sql(base: str, kind: str, dim: str, p: float | None, op: str) -> str:
    src = base if dim != "agegroup" else f"(SELECT *, {_BAND.format(a='age')} AS agegroup FROM {base})"
    if kind == "under20":
        return (f"SELECT EmployeeID, termreason_desc, city_name, job_title, terminationdate_key FROM {src} "
                f"WHERE agegroup = '<20'")
    means = (f"SELECT {dim}, avg(service) AS service FROM {src} "
             f"WHERE service IS NOT NULL AND {dim} IS NOT NULL GROUP BY {dim}")
    if kind == "mean":
        return means
    if kind == "extreme":
        return f"SELECT * FROM ({means}) WHERE service {op} (SELECT quantile_cont(service, {p}) FROM ({means}))"
    rows = f"SELECT * FROM {src} WHERE service {op} (SELECT quantile_cont(service, {p}) FROM {base})"
    if kind == "share":
        return f"SELECT {dim}, count(*) AS n FROM ({rows}) GROUP BY {dim}"
    return (f"SELECT min(age) AS age_min, round(CAST(quantile_cont(age, 0.25) AS DOUBLE), 6) AS age_q1, "
            f"round(CAST(quantile_cont(age, 0.5) AS DOUBLE), 6) AS age_median, avg(age) AS age_mean, "
            f"round(CAST(quantile_cont(age, 0.75) AS DOUBLE), 6) AS age_q3, max(age) AS age_max, "
            f"count(*) - count(age) AS age_nas FROM ({rows})")


def _service() -> dict[str, str]:
    q = {"q5_service_latest": _with("SELECT * FROM latest")}
    sides = {"summary": ("_long", "_short"), "share": ("_long", "_short"), "extreme": ("_best", "_worst")}
    for base, (listing, reports) in _REPORTS.items():
        q[listing] = _with(f"SELECT * FROM {base}")
        for key, kind, dim, long, short in reports:
            if kind not in sides:
                q[key] = _with(_service_sql(base, kind, dim, None, ""))
                continue
            for side, p, op in zip(sides[kind], (long, short), (">=", "<="), strict=True):
                q[key + side] = _with(_service_sql(base, kind, dim, p, op))
    return q


def _overview() -> dict[str, str]:
    gap = "max(EmployeeID) - min(EmployeeID) + 1 - count(DISTINCT EmployeeID)"
    years = "floor(date_diff('day', min(orighiredate_key), min(recorddate_key)) / 365.25)"
    return {
        "q0_id_gap": _with(f"SELECT CAST({gap} AS BIGINT) AS id_gap FROM panel"),
        "q0_unknown_period": _with(f"SELECT CAST({years} AS BIGINT) AS unknown_period FROM panel"),
        "q0_average_term": _with(
            f"SELECT CASE WHEN y <> 0 THEN g / y END AS average_term FROM "
            f"(SELECT CAST({gap} AS DOUBLE) AS g, CAST({years} AS DOUBLE) AS y FROM panel)"),
        "qx_bu_jobs": _with("SELECT DISTINCT BUSINESS_UNIT, job_title FROM panel"),
        "qx_bu_depts": _with("SELECT DISTINCT BUSINESS_UNIT, department_name FROM panel"),
        "qx_csv_panel": _with("SELECT * EXCLUDE (snapshot_id) FROM panel"),
        "qx_csv_latest": _with("SELECT * EXCLUDE (snapshot_id) FROM latest"),
    }


def oracle_statements() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in (_overview(), _growth(), _ages(), _reasons(), _hiring(), _service()):
        out.update(part)
    return out
