"""Words of digits, letters and whatever is not ASCII, with A-Z in lower case."""

from __future__ import annotations

#: Bytes of words stay, A-Z in lower case; all others part words. No other byte of UTF-8 is below 128.
TABLE = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """All words of a UTF-8 text, in order; null has none."""
    return text.translate(TABLE).split() if text else []
