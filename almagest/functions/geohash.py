"""Geohash text of a position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the geohash alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _quantised(value: str, low: float, span: float, bits: int) -> str:
    cells = 1 << bits
    return f"least(greatest(floor((`{value}` - {low}D) / {span}D * {cells}D), 0L), {cells - 1}L)"


def _letters() -> tuple[str, ...]:
    """Letter for three bits of the leading axis followed by two bits of the other axis."""
    table = []
    for lead in range(8):
        for other in range(4):
            digit = 0
            for k in range(5):
                bits, width = (lead, 3) if k % 2 == 0 else (other, 2)
                digit = digit * 2 + (bits >> (width - 1 - k // 2) & 1)
            table.append(ALPHABET[digit])
    return tuple(table)


def with_geohash(
    df: DataFrame, length: int = 9, out: str = "geohash", x: str = "lon", y: str = "lat"
) -> DataFrame:
    """Add the base-32 geohash: bits of longitude and latitude taken in turn, five to a character.

    Characters alternate between three longitude bits with two of latitude and the reverse, so each
    one is a single lookup.
    """
    columns = [c for c in df.columns if c != out]
    left = {"__x": (5 * length + 1) // 2, "__y": 5 * length // 2}
    df = df.select(*columns).withColumns(
        {
            "__x": F.expr(_quantised(x, -180.0, 360.0, left["__x"])),
            "__y": F.expr(_quantised(y, -90.0, 180.0, left["__y"])),
        }
    )
    chars = []
    for n in range(length):
        lead, other = ("__x", "__y") if n % 2 == 0 else ("__y", "__x")
        left[lead] -= 3
        left[other] -= 2
        index = f"(shiftright({lead}, {left[lead]}) & 7) * 4 + (shiftright({other}, {left[other]}) & 3)"
        chars.append(f"get(array{_letters()}, int({index}))")
    # ``least`` and ``greatest`` pass over NULL, hence the explicit test.
    text = f"CASE WHEN `{x}` IS NOT NULL AND `{y}` IS NOT NULL THEN concat({', '.join(chars)}) END"
    return df.withColumn(out, F.expr(text)).select(*columns, out)
