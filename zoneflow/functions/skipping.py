"""Ids as sortable numbers: a layout of trips by both of their ends, and the ranges of ids that a selection reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of an end in the layout, leading bytes of an id that order it, most ids that are turned into ranges, and most ranges.
END_BITS, CODE_BYTES, MOST_IDS, MOST_RANGES = 4, 6, 2_000, 12


def code(zone: Column) -> Column:
    """A number that sorts like the text, by its first bytes."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(zone, "UTF-8"), 1, CODE_BYTES)), 2 * CODE_BYTES, "0"), 16, 10).cast("bigint")


def splits(od: DataFrame, *ends: str) -> list[list[int]]:
    """For each end the codes that cut its trips into 2^END_BITS shares of about the same size, from one pass."""
    shares = [i / (1 << END_BITS) for i in range(1, 1 << END_BITS)]
    row = od.select(*[code(F.col(end)).alias(end) for end in ends]).agg(*[F.percentile_approx(end, shares).alias(end) for end in ends]).first()
    return [sorted(set(row[end] or [])) for end in ends]


def z_order(first: Column, second: Column, cuts: Sequence[Sequence[int]]) -> Column:
    """Interleaved numbers of the shares that two ids fall into, so that near rows are near in both."""
    z = F.lit(0)
    for zone, own, shift in ((first, cuts[0], 1), (second, cuts[1], 0)):
        share = sum(((code(zone) >= F.lit(cut)).cast("int") for cut in own), F.lit(0))
        for bit in range(END_BITS):
            z = z + F.shiftleft(F.shiftright(share, bit).bitwiseAND(F.lit(1)), 2 * bit + shift)
    return z


def ranges(ids: Sequence[str], most: int = MOST_RANGES) -> list[tuple[str, str]]:
    """At most `most` ranges of text that hold all ids, parted at the widest gaps between them."""
    ids = sorted(set(ids), key=lambda i: i.encode())
    codes = [int.from_bytes(i.encode()[:CODE_BYTES].ljust(CODE_BYTES, b"\0"), "big") for i in ids]
    gaps = sorted(range(1, len(ids)), key=lambda k: codes[k - 1] - codes[k])[: most - 1]
    starts = [0, *sorted(gaps), len(ids)]
    return [(ids[a], ids[b - 1]) for a, b in zip(starts, starts[1:]) if b > a]


def within(zone: Column, ids: Sequence[str]) -> Column:
    """Holds for every id, and for others between them; a scan skips what lies outside."""
    found = F.lit(False)
    for low, high in ranges(ids):
        found = found | (zone == low if low == high else (zone >= low) & (zone <= high))
    return found
