"""Employee snapshot panel derived from the order tables.

One panel row per order: a customer plays the employee, each of its orders
is one snapshot. The rules are the fixture definition shared with the SQL
oracle, so the constants below are fixed values.

Plan shape (checked with ``explain``; see PLANS.md):

* customers that own very many orders ("hot") are found from a 0.1%
  sample; there are at most 100,000 of them by construction;
* orders of all other customers are hash-partitioned by customer once and
  sorted once (customer, order date desc, order key desc). On that order a
  single window computes the per-customer helpers (first/last record date,
  latest order: the fixture's own definition), each window group being
  smaller than the hot threshold; the sort-merge join to the customer row
  reuses the same partitioning and order. This is the only shuffle of
  order rows; ``customer`` is shuffled once to meet it, and ``nation`` is
  broadcast only after a bounded row-count check;
* orders of hot customers never enter a shuffle. Their helpers come from
  an aggregate with a map-side partial step (one row per hot customer per
  map task), and their customer rows are few enough to broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens import constants as K
from rosterlens.session import checkpoint_root
from rosterlens.operators.joins import (
    HOT_MIN_ROWS,
    MAX_HOT_KEYS,
    SAMPLE_FRACTION,
    broadcast_if_small,
    sampled_hot_keys,
    split_by_keys,
)

# --- fixed values of the derived-panel definition ----------------------------
FIRST_EMPLOYEE_ID = 1318
ID_GAP_EVERY = 6                             # employee id 1318 + key + key div 6: a missing id after each six keys
HIRE_LEAD_MULTIPLIER, HIRE_LEAD_DAYS = 37, 3000   # hired (key * 37) % 3000 days before the first record
# missing values: column -> (key, modulus, remainder); c = customer key, o = order key
MISSING = {
    K.GENDER: ("c", 41, 5), K.GENDER_FULL: ("c", 41, 5), K.BU: ("c", 53, 11), K.BIRTH_DATE: ("c", 61, 4),
    K.HIRE_DATE: ("c", 97, 13), K.TERM_DATE: ("c", 101, 17), K.AGE: ("o", 59, 8), K.SERVICE_YEARS: ("o", 71, 6),
    K.STORE: ("o", 79, 1), K.JOB: ("o", 83, 2), K.DEPT: ("o", 89, 3), K.REASON: ("o", 97, 5), K.TERM_TYPE: ("o", 103, 9),
    K.CITY: ("o", 107, 10),
}
OTHER_GENDER_MODULUS, OTHER_GENDER_REMAINDER = 43, 7     # these keys have gender X / Other
TERMINATED_MODULUS = 3                       # key % 3 = 0 -> terminated at the last order
REASON_MODULUS = 9                           # key % 9: 0 Layoff, 3 Resignation, 6 Retirement
REASONS = [(0, "Layoff"), (3, "Resignation"), (6, "Retirement")]
INVOLUNTARY_REMAINDER = 0                    # key % 9 = 0 -> Involuntary, other terminated -> Voluntary
BIRTH_BASE_DAYS, BIRTH_MULTIPLIER, BIRTH_SPREAD_DAYS = 4000, 7919, 28000
DEPT_MODULUS, JOB_MODULUS, STORE_MODULUS = 4, 47, 46
HEAD_OFFICE_REGION = 0
NOT_TERMINATED_DATE = "1900-01-01"
# -----------------------------------------------------------------------------
MAX_BROADCAST_NATIONS = 10_000

PANEL_COLUMNS = [
    K.SNAPSHOT, K.ID, K.RECORD_DATE, K.BIRTH_DATE, K.HIRE_DATE, K.TERM_DATE, K.AGE,
    K.SERVICE_YEARS, K.CITY, K.DEPT, K.JOB, K.STORE, K.GENDER, K.GENDER_FULL,
    K.REASON, K.TERM_TYPE, K.STATUS_YEAR, K.STATUS, K.BU,
]


def _calendar_date(df: DataFrame, col: str) -> Column:
    """The stored calendar date of a timestamp column, whatever the session time zone.

    Parquet timestamps without a zone read as TIMESTAMP_NTZ and cast directly;
    if a session reads them as zoned timestamps, the UTC day is taken instead.
    """
    if isinstance(df.schema[col].dataType, T.TimestampType):
        return F.date_from_unix_date(F.floor(F.unix_micros(col) / F.lit(86_400_000_000)).cast("int"))
    return F.col(col).cast("date")


def _with_customer(customers: DataFrame, nations: DataFrame) -> DataFrame:
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey", "n_nationkey")


def _cold_route(orders: DataFrame, customers: DataFrame, nations: DataFrame) -> DataFrame:
    """Orders of ordinary customers: one shuffle by customer, helpers as one window."""
    newest_first = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    whole = newest_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    helpers = orders.repartition("o_custkey").select(
        "o_orderkey",
        "o_custkey",
        "o_orderdate",
        "rec",
        F.min("rec").over(whole).alias("hire"),
        F.max("rec").over(whole).alias("last"),
        (F.row_number().over(newest_first) == 1).alias("is_latest"),
    )
    return helpers.join(_with_customer(customers, nations), F.col("o_custkey") == F.col("c_custkey"))


def _hot_route(orders: DataFrame, customers: DataFrame, nations: DataFrame) -> DataFrame:
    """Orders of hot customers: partial aggregate, broadcast back; no shuffle of order rows."""
    # Latest order = first by (o_orderdate desc, o_orderkey desc) = max of the pair.
    helpers = orders.groupBy("o_custkey").agg(
        F.min("rec").alias("hire"),
        F.max("rec").alias("last"),
        F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("latest_key"),
    )
    per_customer = (
        _with_customer(customers, nations)
        .join(helpers.withColumnRenamed("o_custkey", "h_custkey"), F.col("c_custkey") == F.col("h_custkey"))
        .drop("h_custkey")
    )
    joined = orders.join(F.broadcast(per_customer), F.col("o_custkey") == F.col("c_custkey"))
    return joined.withColumn("is_latest", F.col("o_orderkey") == F.col("latest_key")).drop("latest_key")


def panel_from_frames(
    orders: DataFrame,
    customer: DataFrame,
    nation: DataFrame,
    hot_min_rows: int = HOT_MIN_ROWS,
    max_hot_keys: int = MAX_HOT_KEYS,
    sample_fraction: float = SAMPLE_FRACTION,
) -> DataFrame:
    """Build the snapshot panel from ``orders``, ``customer`` and ``nation``.

    ``hot_min_rows`` / ``max_hot_keys`` / ``sample_fraction`` tune the
    hot-customer route (see :mod:`rosterlens.operators.joins`); they change
    the plan, never the result.
    """
    ck = F.col("o_custkey")
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate", _calendar_date(orders, "o_orderdate").alias("rec"))
    nations = broadcast_if_small(nation.select("n_nationkey", "n_name", "n_regionkey"), MAX_BROADCAST_NATIONS)
    customers = customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    # The hot set routes every order either way, so it must be the same set in each
    # use: it is written once to the shared checkpoint folder (at most max_hot_keys rows).
    checkpoint_root(orders.sparkSession)
    hot = sampled_hot_keys(o, "o_custkey", sample_fraction, hot_min_rows, max_hot_keys).checkpoint(eager=True)
    o_hot, o_cold = split_by_keys(o, "o_custkey", hot)
    c_hot, c_cold = split_by_keys(customers, "c_custkey", hot)
    j = _hot_route(o_hot, c_hot, nations).unionByName(_cold_route(o_cold, c_cold, nations))

    latest = F.col("is_latest")
    terminated = latest & (ck % TERMINATED_MODULUS == 0)
    hire = F.date_sub(F.col("hire"), ((ck * HIRE_LEAD_MULTIPLIER) % HIRE_LEAD_DAYS).cast("int"))
    birth = F.date_sub(hire, (F.lit(BIRTH_BASE_DAYS) + (ck * BIRTH_MULTIPLIER) % BIRTH_SPREAD_DAYS).cast("int"))
    reason = None
    for remainder, label in REASONS:
        cond = latest & (ck % REASON_MODULUS == remainder)
        reason = F.when(cond, label) if reason is None else reason.when(cond, label)
    reason = reason.otherwise(K.NO_REASON)
    term_type = (
        F.when(latest & (ck % REASON_MODULUS == INVOLUNTARY_REMAINDER), "Involuntary")
        .when(terminated, "Voluntary")
        .otherwise(K.NO_REASON)
    )
    female = ck % 2 == 0
    other = ck % OTHER_GENDER_MODULUS == OTHER_GENDER_REMAINDER
    ok = F.col("o_orderkey")
    full = j.select(
        ck.alias("__c"),
        ok.alias(K.SNAPSHOT),
        (F.lit(FIRST_EMPLOYEE_ID) + ck + F.floor(ck / F.lit(ID_GAP_EVERY))).cast("long").alias(K.ID),
        F.col("rec").alias(K.RECORD_DATE),
        birth.alias(K.BIRTH_DATE),
        hire.alias(K.HIRE_DATE),
        F.when(ck % TERMINATED_MODULUS == 0, F.col("last"))
        .otherwise(F.lit(NOT_TERMINATED_DATE).cast("date"))
        .alias(K.TERM_DATE),
        F.floor(F.date_diff(F.col("rec"), birth) / F.lit(K.DAYS_PER_YEAR)).cast("int").alias(K.AGE),
        (F.year("rec") - F.year(hire)).cast("int").alias(K.SERVICE_YEARS),
        F.col("n_name").alias(K.CITY),
        F.concat(F.col("c_mktsegment"), F.lit("-"), (ok % DEPT_MODULUS).cast("string")).alias(K.DEPT),
        F.concat(F.lit("JOB_"), (ok % JOB_MODULUS).cast("string")).alias(K.JOB),
        (ok % STORE_MODULUS).cast("int").alias(K.STORE),
        F.when(other, "X").when(female, "F").otherwise("M").alias(K.GENDER),
        F.when(other, "Other").when(female, "Female").otherwise("Male").alias(K.GENDER_FULL),
        reason.alias(K.REASON),
        term_type.alias(K.TERM_TYPE),
        F.year("rec").cast("int").alias(K.STATUS_YEAR),
        F.when(terminated, K.STATUS_TERMINATED).otherwise(K.STATUS_ACTIVE).alias(K.STATUS),
        F.when(F.col("n_regionkey") == HEAD_OFFICE_REGION, "HEADOFFICE").otherwise("STORES").alias(K.BU),
    )
    keys = {"c": F.col("__c"), "o": F.col(K.SNAPSHOT)}
    missing = {c: keys[k] % modulus == remainder for c, (k, modulus, remainder) in MISSING.items()}
    missing[K.AGE] = missing[K.AGE] | missing[K.BIRTH_DATE]              # no age without a birth date,
    missing[K.SERVICE_YEARS] = missing[K.SERVICE_YEARS] | missing[K.HIRE_DATE]   # no service without a hire date
    return full.select(*[F.when(~missing[c], F.col(c)).alias(c) if c in missing else F.col(c) for c in PANEL_COLUMNS])


def panel_from_tables(spark: SparkSession, sf_dir: str, **split) -> DataFrame:
    """Read the three source tables under ``sf_dir`` and build the panel."""
    read = lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return panel_from_frames(read("orders"), read("customer"), read("nation"), **split)
