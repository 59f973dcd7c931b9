"""Free-text condition description → condition class (a Column expression, no UDF)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..config import UNKNOWN

# ---------------------------------------------------------------------------
# Condition classes and their keywords, checked in this order,
# first match wins; matching is a case-insensitive substring test.
# ---------------------------------------------------------------------------
CONDITION_KEYWORDS: list[tuple[str, list[str]]] = [
    ("thunderstorm", ["squall", "thunderstorm"]),
    ("rainy", ["drizzle", "rain", "rainy"]),
    ("snowy", ["sleet", "snow", "snowy"]),
    ("cloudy", ["cloud", "overcast", "cloudy", "clouds"]),
    ("foggy", ["fog", "mist", "haze", "smoke", "dust", "foggy"]),
    ("sunny", ["clear", "sun", "sunny"]),
]

CONDITION_CLASSES = [name for name, _ in CONDITION_KEYWORDS]


def classify_description(desc: Column | str) -> Column:
    """Map a description to its class; NULL or no keyword → ``unknown``.

    Idempotent: every class name contains one of its own keywords and none of an
    earlier class's, so classifying a class name returns it unchanged.

    One ``rlike`` per class (keywords joined by ``|``), so re-classifying a classified
    column stays a small expression after Catalyst inlines the inner one.
    """
    c = F.col(desc) if isinstance(desc, str) else desc
    low = F.lower(c)
    expr = None
    for name, keys in CONDITION_KEYWORDS:
        hit = low.rlike("|".join(re.escape(k) for k in keys))
        expr = F.when(hit, F.lit(name)) if expr is None else expr.when(hit, F.lit(name))
    return expr.otherwise(F.lit(UNKNOWN))
