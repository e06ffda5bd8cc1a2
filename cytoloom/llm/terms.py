"""Terms of texts, cut from their UTF-8 bytes."""

from __future__ import annotations


def folding(digits: bool) -> bytes:
    """A table for bytes.translate(): A-Z in lower case; letters, all bytes of characters beyond ASCII and, if asked for, digits stay; the rest
    becomes a space, so that split() gives the maximal runs of what stays."""

    def folded(b: int) -> int:
        if 0x41 <= b <= 0x5A:
            return b + 32
        return b if 0x61 <= b <= 0x7A or b >= 0x80 or digits and 0x30 <= b <= 0x39 else 0x20

    return bytes(folded(b) for b in range(256))


LETTERS, LETTERS_AND_DIGITS = folding(False), folding(True)


def terms_of(text: bytes | None, table: bytes) -> list[bytes]:
    """The terms of a text with repeats, in order; null has none."""
    return text.translate(table).split() if text else []
