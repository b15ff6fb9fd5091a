"""Zone id expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_id(value: Column) -> Column:
    """Zone id as text: whole numbers lose leading zeros and a ".0" tail, other text is trimmed.

    The same rule runs on fact and zone ids, so "101", "0101" and "101.0" meet in a join.
    """
    text = F.trim(value.cast("string"))
    whole = F.regexp_replace(text, r"\.0+$", "").try_cast("bigint")
    return F.coalesce(whole.cast("string"), text)


def group_key(value: Column) -> Column:
    """Group id used in roll-ups: a zone without a parent belongs to the text group 'None'."""
    return F.coalesce(value.cast("string"), F.lit("None"))
