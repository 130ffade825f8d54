"""Validation of prediction requests and their conversion to model inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import align_features

# Allowed ranges of the request fields (None = open).
REQUIRED_RANGES = {
    "site_id": (1, None),
    "hour_of_day": (0, 23),
    "day_of_week": (0, 6),
    "is_weekend": (0, 1),
    "hour_sin": (-1, 1),
    "hour_cos": (-1, 1),
}
OPTIONAL_RANGES = {"lag_1": (0, None), "lag_24": (0, None), "rmean_24": (0, None)}
# Fixed value: ISO 8601 date with optional time, fraction and offset.
ISO_TIMESTAMP = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(.([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d(\.\d{3}(\d{3})?)?)?)?"
    r"(Z|[+-]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{6})?)?)?)?$"
)


def _outside(name: str, low: float, high: float | None) -> Column:
    value = F.col(name)
    return (value < low) if high is None else ~value.between(low, high)


def is_iso_timestamp(text: Column) -> Column:
    """Whether the text is an ISO 8601 timestamp of an existing day."""
    day = F.substring(text, 1, 10).try_cast("date")
    return text.rlike(ISO_TIMESTAMP) & day.isNotNull() & (F.year(day) >= 1)


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``rejects``: the names of the fields that break a rule, empty for a valid request.

    A field that the reader found to be of another type (``unreadable``) breaks its rule too, also if
    it may be missing.
    """
    checks = [
        F.when(F.col(c).isNull() | _outside(c, *bounds), c) for c, bounds in REQUIRED_RANGES.items()
    ]
    checks.append(
        F.when(~F.coalesce(is_iso_timestamp(F.col("timestamp")), F.lit(False)), "timestamp")
    )
    checks += [F.when(_outside(c, *bounds), c) for c, bounds in OPTIONAL_RANGES.items()]
    rejects = F.array_compact(F.array(*checks))
    if "unreadable" in requests.columns:
        rejects = F.array_union(rejects, F.col("unreadable"))
    return requests.withColumn("rejects", rejects)


def _rules() -> dict[str, str]:
    whole = {"site_id", "hour_of_day", "day_of_week", "is_weekend"}
    found = {"timestamp": "required ISO 8601 date or time", "line": "one JSON object"}
    for need, ranges in (("required", REQUIRED_RANGES), ("optional", OPTIONAL_RANGES)):
        for name, (low, high) in ranges.items():
            kind = "whole number" if name in whole else "number"
            limits = f"from {low} to {high}" if high is not None else f"of at least {low}"
            found[name] = f"{need} {kind} {limits}"
    return found


def name_rules(rejected: DataFrame) -> DataFrame:
    """Add ``rules``: for every rejected field its name and the rule that it breaks."""
    texts = F.create_map(*[F.lit(f"{part}") for pair in _rules().items() for part in pair])
    rules = F.transform("rejects", lambda name: F.concat(name, F.lit(": "), texts[name]))
    return rejected.withColumn("rules", rules)


def valid_requests(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("rejects") == 0).drop("rejects")


def rejected_requests(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("rejects") > 0)


def request_features(
    requests: DataFrame, names: list[str], keep: tuple[str, ...] = ()
) -> DataFrame:
    """Model inputs of requests: missing lags are 0, and so is every feature not requested."""
    filled = {
        c: F.coalesce(F.col(c), F.lit(0.0)) if c in requests.columns else F.lit(0.0)
        for c in OPTIONAL_RANGES
    }
    return align_features(requests.withColumns(filled), names, keep)
