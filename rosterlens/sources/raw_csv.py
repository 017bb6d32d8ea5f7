"""Raw employee CSV source (header row, ``NA`` = missing, ``m/d/yyyy`` dates).

The file is read as text with a declared header (no inference pass over the
data). Integers are cast strictly: a cell that is neither missing nor an integer
fails the read, as does a row with another number of cells. An empty text cell
stays empty; ``NA`` is missing. Dates are parsed with a built-in expression, and
the result has the same columns as the derived panel, so every operator runs
on either.

Rows are numbered in the scan that reads them: a row's place is its file's
number of slots before it (one row per file, broadcast after a size check), the
slot its split starts in, and its row in the reading task. Raw rows are neither
read twice nor shuffled. ``import_panel_csv`` writes a panel from such files and
checks it in the same pass.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens import constants as K
from rosterlens.functions import parse_mdy_date
from rosterlens.operators.joins import broadcast_if_small
from rosterlens.sources.store import path_exists, read_panel, remove_panel, rename_panel, unsorted_partitions, write_panel

_DATES = [K.RECORD_DATE, K.BIRTH_DATE, K.HIRE_DATE, K.TERM_DATE]

RAW_SCHEMA = T.StructType(
    [
        T.StructField(K.ID, T.LongType()),
        T.StructField(K.RECORD_DATE, T.StringType()),
        T.StructField(K.BIRTH_DATE, T.StringType()),
        T.StructField(K.HIRE_DATE, T.StringType()),
        T.StructField(K.TERM_DATE, T.StringType()),
        T.StructField(K.AGE, T.IntegerType()),
        T.StructField(K.SERVICE_YEARS, T.IntegerType()),
        T.StructField(K.CITY, T.StringType()),
        T.StructField(K.DEPT, T.StringType()),
        T.StructField(K.JOB, T.StringType()),
        T.StructField(K.STORE, T.IntegerType()),
        T.StructField(K.GENDER, T.StringType()),
        T.StructField(K.GENDER_FULL, T.StringType()),
        T.StructField(K.REASON, T.StringType()),
        T.StructField(K.TERM_TYPE, T.StringType()),
        T.StructField(K.STATUS_YEAR, T.IntegerType()),
        T.StructField(K.STATUS, T.StringType()),
        T.StructField(K.BU, T.StringType()),
    ]
)


TEXT_SCHEMA = T.StructType([T.StructField(f.name, T.StringType()) for f in RAW_SCHEMA.fields])
READ_OPTIONS = {
    "header": True,
    "enforceSchema": False,      # check the header against the declared columns instead of trusting positions
    "mode": "FAILFAST",
}
FILE, SIZE, BLOCK, LENGTH = "_file", "_file_size", "_block", "_block_length"
# snapshot id = slot in which the file split starts * ROW_IDS + row in the reading task; 2^36 slots of that many rows
ROW_IDS = 1 << 27
# rows of a written file, which its task sorts in memory; while so many files are enough (see csv_files), fewer
SORTED_ROWS, FEW_ROWS = 500_000, 100_000
# a list of more files than this is joined, not broadcast
MAX_BROADCAST_FILES = 1 << 20


def positioned(raw: DataFrame) -> DataFrame:
    """Raw rows plus the file and split they come from."""
    m = F.col("_metadata")
    return raw.select(
        "*", m.file_path.alias(FILE), m.file_size.alias(SIZE), m.file_block_start.alias(BLOCK), m.file_block_length.alias(LENGTH)
    )


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """Name and size of every file of ``path``; their content is not read."""
    m = F.col("_metadata")
    return spark.read.format("binaryFile").load(path).select(m.file_path.alias(FILE), m.file_size.alias(SIZE))


def _bytes_of(spark: SparkSession, conf: str) -> int:
    """A size setting in bytes, whatever unit it is written in."""
    text = spark.conf.get(conf).strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1:], 0)
    return int(text[:-1] if unit else text) << unit


def slot_bytes(spark: SparkSession) -> int:
    """Spark cuts no file into splits shorter than this, but for its last one."""
    return max(1, min(_bytes_of(spark, f"spark.sql.files.{c}") for c in ("maxPartitionBytes", "openCostInBytes")))


def first_slots(files: DataFrame, slot: int) -> DataFrame:
    """Per file the slots of all files before it in name order (a window over one row per file)."""
    before = Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)
    taken = files.withColumn("_slots", F.floor(F.col(SIZE) / F.lit(slot)).cast("long") + 1)
    return taken.select(FILE, F.coalesce(F.sum("_slots").over(before), F.lit(0)).alias("_before"))


def _integer(name: str, kind: T.DataType) -> Column:
    c = F.col(name)
    bad = F.raise_error(F.concat(F.lit(f"{name} is not an integer: "), c)).cast(kind)
    missing = c.isNull() | (F.trim(c) == "") | (c == K.RAW_NULL_TEXT)
    return F.when(~missing, F.coalesce(c.try_cast(kind), bad)).alias(name)


def typed_panel(
    raw: DataFrame, files: DataFrame | None = None, row_ids: int = ROW_IDS, slots: int = (1 << 63) // ROW_IDS
) -> DataFrame:
    """Panel of positioned raw text rows; ``files`` lists their files (asked from the rows if not given).

    ``snapshot_id`` grows with (file path, place of the split in the file, row),
    so "first row wins" tie-breaks follow the files in name order, as in the
    studied analysis, however Spark packs them into tasks.
    """
    slot = slot_bytes(raw.sparkSession)
    files = raw.select(FILE, SIZE).distinct() if files is None else files
    before = broadcast_if_small(first_slots(files, slot), MAX_BROADCAST_FILES)
    rows = raw.withColumn("_row", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)))
    place = F.col("_before") + F.floor(F.col(BLOCK) / F.lit(slot)).cast("long")
    whole = (F.col(LENGTH) >= slot) | (F.col(BLOCK) + F.col(LENGTH) >= F.col(SIZE))
    fits = whole & (F.col("_row") < row_ids) & (place < F.lit(slots))
    number = F.when(fits, place * row_ids + F.col("_row")).otherwise(
        F.raise_error(F.lit("a split shorter than its slot, or more rows in a task or slots in the files than snapshot ids")).cast("long")
    )
    cols = []
    for f in RAW_SCHEMA.fields:
        c = F.col(f.name)
        if f.name in _DATES:
            cols.append(parse_mdy_date(c).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(F.when(c.isNull(), "").when(c != K.RAW_NULL_TEXT, c).alias(f.name))
        else:
            cols.append(_integer(f.name, f.dataType))
    return rows.join(before, FILE).select(number.alias(K.SNAPSHOT), *cols)


def check_employee_ids(df: DataFrame) -> None:
    """Fail if any row has no ``EmployeeID``.

    Distinct-employee counts skip a missing id where the studied analysis
    counted it as one more value; a panel is therefore rejected at the
    boundary instead. The check stops at the first such row.
    """
    if df.where(F.col(K.ID).isNull()).limit(1).count():
        raise ValueError(f"panel has rows without {K.ID}")


def read_panel_csv(spark: SparkSession, path: str, check_ids: bool = True) -> DataFrame:
    """Read the raw employee CSV (one file, a directory or a glob).

    ``check_ids`` runs :func:`check_employee_ids` on the result.
    """
    raw = spark.read.schema(TEXT_SCHEMA).options(**READ_OPTIONS).csv(path)
    panel = typed_panel(positioned(raw), listed_files(spark, path))
    if check_ids:
        check_employee_ids(panel)
    return panel


def csv_files(rows: int, unsorted: int) -> int:
    """Number of files for so many rows: a file's rows fit its task's memory, however many rows there are."""
    return max(1, min(unsorted, -(-rows // FEW_ROWS)), -(-rows // SORTED_ROWS))


def write_panel_csv(panel: DataFrame, path: str) -> None:
    """Write the panel in the raw form, its files and rows in ``snapshot_id`` order.

    The rows are counted first: partitions sized by bytes alone hold as many rows
    as their shuffle files hold compressed, and spill while they are sorted.
    Missing values become ``NA``, so a text that reads "NA" is missing when read back.
    """
    raw = [
        F.concat(F.date_format(f.name, K.RAW_DATE_FORMAT), F.lit(" 0:00")).alias(f.name) if f.name in _DATES else F.col(f.name)
        for f in RAW_SCHEMA.fields
    ]
    files = csv_files(panel.count(), unsorted_partitions(panel.sparkSession))
    ordered = panel.repartitionByRange(files, K.SNAPSHOT).sortWithinPartitions(K.SNAPSHOT)
    ordered.select(*raw).write.option("header", True).option("nullValue", K.RAW_NULL_TEXT).csv(path)


def import_panel_csv(spark: SparkSession, path: str, out: str) -> tuple[DataFrame, dict[str, int]]:
    """Write the raw CSV as a panel table at ``out``; (the table, what was counted on the way).

    The files are scanned once: numbers of rows, of rows without an id and of
    missing dates are observed while the table is written beside ``out``. Rows
    without an id (see :func:`check_employee_ids`) or a bad cell end the import
    before anything stands at ``out``; an ``out`` that exists is refused. A task
    that Spark repeats may be counted twice; what is zero stays zero.
    """
    if path_exists(spark, out):
        raise FileExistsError(out)
    counted = Observation(f"import-{uuid.uuid4().hex[:8]}")
    missing = [F.count_if(F.col(c).isNull()).alias(c) for c in (K.ID, *_DATES)]
    panel = read_panel_csv(spark, path, check_ids=False).observe(counted, F.count(F.lit(1)).alias("rows"), *missing)
    beside = f"{out.rstrip('/')}-import-{uuid.uuid4().hex[:8]}"
    try:
        write_panel(panel, beside)
        numbers = dict(counted.get)
        if numbers[K.ID]:
            raise ValueError(f"panel has {numbers[K.ID]} rows without {K.ID}")
        rename_panel(spark, beside, out)
    finally:
        remove_panel(spark, beside)
    return read_panel(spark, out), numbers


def check_panel_schema(df: DataFrame, expected: T.StructType | None = None) -> None:
    """Fail fast if ``df`` lacks a panel column or carries it with another type.

    The panel columns are the raw ones with the four dates parsed, plus
    ``snapshot_id``; extra columns are allowed.
    """
    want = expected or T.StructType(
        [T.StructField(K.SNAPSHOT, T.LongType())]
        + [T.StructField(f.name, T.DateType() if f.name in _DATES else f.dataType) for f in RAW_SCHEMA.fields]
    )
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = [
        f"{f.name}: missing" if f.name not in have else f"{f.name}: {have[f.name].simpleString()} != {f.dataType.simpleString()}"
        for f in want.fields
        if have.get(f.name) != f.dataType
    ]
    if problems:
        raise ValueError("not a snapshot panel: " + "; ".join(problems))
