"""Prediction requests as JSON files, read at once or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("site_id", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("hour_of_day", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("is_weekend", T.IntegerType()),
        T.StructField("hour_sin", T.DoubleType()),
        T.StructField("hour_cos", T.DoubleType()),
        T.StructField("lag_1", T.DoubleType()),
        T.StructField("lag_24", T.DoubleType()),
        T.StructField("rmean_24", T.DoubleType()),
    ]
)


RAW, UNREADABLE = "raw", "unreadable"
_CORRUPT = "_corrupt"
_TEXTS = T.StructType([T.StructField(n, T.StringType()) for n in (*REQUEST_SCHEMA.names, _CORRUPT)])


def _value(text: Column, kind: T.DataType) -> Column:
    """The text as a number of its kind; whole numbers may be written with a zero fraction."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.DoubleType):
        return text.try_cast(kind)
    number = text.try_cast("decimal(38,9)")
    return F.coalesce(text.try_cast(kind), F.when(number == F.floor(number), number).try_cast(kind))


def parse_requests(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Typed requests from lines of JSON, with the line as ``raw`` and in ``unreadable`` the fields whose
    value has another type (``line`` if it is no JSON object). Blank lines are left out."""
    line = F.col(text_col)
    options = {"columnNameOfCorruptRecord": _CORRUPT}
    parsed = lines.filter(F.trim(line) != "").select(line.alias(RAW), F.from_json(line, _TEXTS, options).alias("_p"))
    texts = {f.name: F.col(f"_p.{f.name}") for f in REQUEST_SCHEMA}
    values = {f.name: _value(texts[f.name], f.dataType) for f in REQUEST_SCHEMA}
    broken = [F.when(texts[n].isNotNull() & values[n].isNull(), n) for n in REQUEST_SCHEMA.names]
    broken.append(F.when(F.col("_p").isNull() | F.col(f"_p.{_CORRUPT}").isNotNull(), "line"))
    return parsed.select(
        *[values[n].alias(n) for n in REQUEST_SCHEMA.names],
        RAW,
        F.array_compact(F.array(*broken)).alias(UNREADABLE),
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """All requests in a folder, a JSON object per line."""
    return parse_requests(spark.read.text(path))


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from files as they arrive in a folder."""
    return parse_requests(spark.readStream.text(path))
