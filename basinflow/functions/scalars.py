"""Column functions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def merge_qualifiers(*columns: Column) -> Column:
    """Non-null codes joined with |; all null gives the empty text; no column gives null."""
    return F.concat_ws("|", *columns) if columns else F.lit(None).cast("string")


def percent(part: Column, whole: Column) -> Column:
    return F.round(100 * F.try_divide(part, whole), 1)


def bar(count: Column, most: Column, width: int = 50) -> Column:
    """A text bar, its filled part rounded down; null over nothing."""
    filled = F.floor(F.try_divide(count, most) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def has_prefix(code: Column, prefix: str) -> Column:
    """Null has no prefix."""
    return F.coalesce(code, F.lit("")).startswith(prefix)


def truncated(time: Column, unit: str) -> Column:
    """Start of the unit, without a zone; days as dates."""
    return time.cast("date") if unit == "day" else F.date_trunc(unit, time).cast("timestamp_ntz")


def to_utc(text: Column, zone: str) -> Column:
    """Wall-clock time of a zone as UTC wall-clock time."""
    return F.to_utc_timestamp(text, zone).cast("timestamp_ntz")


def schema_fingerprint(schema: StructType) -> str:
    """12 hex digits that change with a column's name or type, not with column order."""
    columns = {f.name: f.dataType.simpleString() for f in schema.fields}
    return hashlib.sha256(json.dumps(columns, sort_keys=True).encode()).hexdigest()[:12]


def hashed_share(*key: Column) -> Column:
    """A number from 0 to 99 that only depends on the key: repeatable under any partitioning, and in SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key]).cast("binary")), 1, 7), 16, 10).cast("long") % 100
