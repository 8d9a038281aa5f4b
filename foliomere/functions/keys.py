"""Stable keys of statements and evidence rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def statement_key(fields: dict[str, Column]) -> Column:
    """``sk1:`` and the SHA-256 of the fields as JSON in the order of their names; nulls are kept."""
    ordered = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.concat(F.lit("sk1:"), F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256))


def occurrence_id(*parts: Column) -> Column:
    """A positive long from the first eight bytes of the SHA-256 of the parts, split by NUL."""
    digest = F.sha2(F.concat_ws("\0", *parts), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


def redacted(x: Column) -> Column:
    """The first 16 hex digits of a value's SHA-256, to stand for it in reports."""
    return F.substring(F.sha2(x, 256), 1, 16)


def is_iso_date(x: Column) -> Column:
    """Whether a text is a date as yyyy-MM-dd, to the letter."""
    return F.coalesce(F.date_format(F.try_to_date(x, "yyyy-MM-dd"), "yyyy-MM-dd") == x, F.lit(False))
