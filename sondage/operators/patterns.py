"""Formats of string columns, and masking of personal ones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, long_form, union
from ..types import columns_of

#: name: (regular expression over the whole trimmed value, least share of values); fixed values. More can be added.
PATTERNS: dict[str, tuple[str, float]] = {
    "email": (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", 0.5),
    "phone_us": (r"^\+?1?[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}$", 0.5),
    "ssn": (r"^\d{3}-\d{2}-\d{4}$", 0.3),
    "uuid": (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", 0.5),
    "ipv4": (r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$", 0.5),
    "credit_card": (r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}$", 0.3),
    "url": (r"^https?://\S+$", 0.5),
    "date_string": (r"^\d{4}-\d{2}-\d{2}$", 0.5),
}
#: Patterns whose columns hold personal data.
PERSONAL = ("email", "ssn", "credit_card", "phone_us")
REDACTED = "[REDACTED]"


def detect(df: DataFrame, columns: list[str] | None = None, limit: int = 0, least: float = 0.1) -> DataFrame:
    """column_name, pattern, score (3 decimals) where enough values match. ``limit`` looks at the first rows only."""
    columns = columns_of(df.schema, "string") if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, pattern string, score double")
    rows = df.select(*[col(c) for c in columns]).limit(limit) if limit else df
    trimmed = lambda c: F.regexp_replace(col(c), r"^\s+|\s+$", "")
    metrics = {p: (lambda c, e=e: F.avg(trimmed(c).rlike(e).cast("double"))) for p, (e, _) in PATTERNS.items()}
    rates = long_form(rows, columns, metrics)
    flat = union([rates.select("column_name", F.lit(p).alias("pattern"), F.col(p).alias("rate"), F.lit(max(t, least)).alias("least")) for p, (_, t) in PATTERNS.items()])
    return flat.where(F.col("rate") >= F.col("least")).select("column_name", "pattern", F.round("rate", 3).alias("score"))


def masked(values: DataFrame, found: DataFrame, columns: Iterable[str] = ("value",)) -> DataFrame:
    """Rows with column_name, with the given columns redacted where the column has a personal pattern."""
    personal = found.where(F.col("pattern").isin(*PERSONAL)).select("column_name").distinct().withColumn("_personal", F.lit(True))
    out = values.join(F.broadcast(personal), "column_name", "left")  # one row for each column of a table
    return out.withColumns({c: F.when(F.col("_personal") & F.col(c).isNotNull(), REDACTED).otherwise(F.col(c)) for c in columns}).drop("_personal")
