"""The session-log source."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.enrich import add_state, unmapped_sites
from ..operators.quality import (
    DataValidationError,
    clean_data,
    log_quality,
    nan_to_null,
    observe_quality,
    validate_data,
    validation_report,
)

log = logging.getLogger(__name__)
LISTED_SITES = 100  # sites that a warning names at most

SESSION_TYPES = {
    "site_id": T.LongType(),
    "timestamp": T.TimestampNTZType(),
    "sessions": T.DoubleType(),
}
FILE_ORDER = ("_file", "_block", "_line")
UNREADABLE, LINE = "_unreadable", "_text"


def _found(read, path: str) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Data file not found: {path}") from error
        raise


def read_session_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a session CSV by header name, keeping the position of each row in its file.

    Values are read as text and converted here, so that one that cannot be read neither
    stops the job nor is lost: it becomes NULL, ``_unreadable`` names its column (``line`` if the
    row has too few or too many values), and ``_text`` has the row's text.
    """
    reader = spark.read.option("header", True)
    names = _found(reader.csv, path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, LINE)])
    rows = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE)
    rows = rows.option("columnPruning", False)  # else the values of a row are not counted
    # each file is checked against the header, so that columns in another order fail
    rows = _with_file_order(rows.option("enforceSchema", False).csv(path), F.monotonically_increasing_id())
    known = [n for n in names if n in SESSION_TYPES]
    values = {n: F.trim(n).try_cast(SESSION_TYPES[n]) for n in known}
    broken = [F.when(F.col(n).isNotNull() & values[n].isNull(), n) for n in known]
    broken.append(F.when(F.col(LINE).isNotNull(), "line"))
    text = F.coalesce(F.col(LINE), F.to_csv(F.struct(*names)))
    unreadable = F.array_compact(F.array(*broken))
    return rows.select(
        *[values.get(n, F.col(n)).alias(n) for n in names],
        *FILE_ORDER,
        unreadable.alias(UNREADABLE),
        F.when(F.size(unreadable) > 0, text).alias(LINE),
    )


def read_session_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read a session table stored as Parquet, keeping the position of each row in its file.

    The place in the file comes from the file itself, so filters on site and time reach the scan.
    """
    return _with_file_order(_found(spark.read.parquet, path), F.col("_metadata.row_index"))


def _with_file_order(rows: DataFrame, line: Column) -> DataFrame:
    # A block of a CSV file is always read by one task from start to end, so file, block and the
    # task-local row id together give the order of the rows in the input.
    file, block, place = FILE_ORDER
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias(file),
        F.col("_metadata.file_block_start").alias(block),
        line.alias(place),
    )


def unreadable_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a session CSV that ``load_sessions`` leaves out: ``file``, the ``columns`` that could not
    be read and the ``text`` of the row."""
    bad = read_session_csv(spark, path).filter(F.size(UNREADABLE) > 0)
    return bad.select(
        F.col(FILE_ORDER[0]).alias("file"), F.col(UNREADABLE).alias("columns"), F.col(LINE).alias("text")
    )


def _check_numbers(raw: DataFrame) -> None:
    """A column that has values but not one number is an error, as in a table of another type.

    Stops at the first number of a column; only a column without any is read to its end.
    """
    for name in ("site_id", "sessions"):
        if name not in raw.columns or not raw.filter(F.col(name).isNotNull()).isEmpty():
            continue
        if not raw.filter(F.array_contains(UNREADABLE, name)).isEmpty():
            raise DataValidationError(f"{name} must be numeric")


def prepare_sessions(
    raw: DataFrame,
    order_by: tuple[str, ...] = (),
    observation: Observation | None = None,
) -> DataFrame:
    """Validate, clean and enrich a raw session log.

    Null and negative counts are collected in the same pass when ``observation`` is given;
    without it no pass is spent on them. Rows that a reader marked as unreadable are left out.
    """
    validate_data(raw)
    rows, more = nan_to_null(raw, "sessions"), []
    if UNREADABLE in raw.columns:
        _check_numbers(raw)
        more = [F.count_if(F.size(UNREADABLE) > 0).alias("unreadable_rows")]
    if observation is not None:
        rows = observe_quality(rows, observation, *more)
    if UNREADABLE in raw.columns:
        rows = rows.filter(F.size(UNREADABLE) == 0).drop(UNREADABLE, LINE)
    return add_state(clean_data(rows, order_by=order_by))


def load_sessions(
    spark: SparkSession,
    path: str,
    file_format: str = "csv",
    observation: Observation | None = None,
    log_findings: bool = False,
) -> DataFrame:
    """Read a session log and return it validated, deduplicated, clipped and with ``state``.

    Rows of a CSV with a value that cannot be read are left out; ``unreadable_sessions`` returns them and
    ``observation`` counts them. ``log_findings`` spends a pass on the warnings: missing, negative and
    unreadable values, and sites without a state.
    """
    readers = {"csv": read_session_csv, "parquet": read_session_parquet}
    raw = readers[file_format](spark, path)
    if log_findings:
        warn_of_findings(raw)
    return prepare_sessions(raw, FILE_ORDER, observation).drop(*FILE_ORDER)


def warn_of_findings(raw: DataFrame) -> None:
    """Log what ``validation_report`` and ``unmapped_sites`` find in a raw log."""
    log_quality(validation_report(raw).first().asDict())
    if UNREADABLE in raw.columns:
        rows = raw.filter(F.size(UNREADABLE) > 0).count()
        if rows:
            log.warning("%d rows hold values that cannot be read", rows)
    sites = [r["site_id"] for r in unmapped_sites(raw).limit(LISTED_SITES + 1).collect()]
    if sites:
        more = " and more" if len(sites) > LISTED_SITES else ""
        log.warning("Sites without a state: %s%s", sorted(sites[:LISTED_SITES]), more)
