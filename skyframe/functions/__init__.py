"""Column-level functions (all built-in Spark expressions)."""

from .conditions import CONDITION_CLASSES, CONDITION_KEYWORDS, classify_description
from .scalars import (calendar_columns, celsius_to_kelvin, hour_from_hhmm, hour_text, kmph_to_mps,
                      month_ranges, nan_to_null, parse_timestamp, parse_timestamp_strict, to_double,
                      truncate_hour)

__all__ = [
    "CONDITION_CLASSES", "CONDITION_KEYWORDS", "classify_description", "calendar_columns",
    "celsius_to_kelvin", "hour_from_hhmm", "hour_text", "kmph_to_mps", "month_ranges",
    "nan_to_null", "parse_timestamp", "parse_timestamp_strict", "to_double", "truncate_hour",
]
