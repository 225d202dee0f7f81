"""Word splitting shared by operators on words of letters and digits."""

from __future__ import annotations

#: Words are runs of bytes outside [\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased: ASCII letters and digits,
#: and every character beyond ASCII (whose UTF-8 bytes are all 0x80 or more).
_TO_SPACE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in bytes(range(256)).lower())
_TABLE = bytes(ord(chr(b).lower()) if 0x41 <= b <= 0x5A else _TO_SPACE[b] for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8 (null: none)."""
    return text.encode().translate(_TABLE).split() if text else []
