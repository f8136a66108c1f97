"""Words of letters and digits, as bytes: A-Z lowered, every other ASCII character a delimiter, all others part of a word."""

from __future__ import annotations

from collections.abc import Iterator

#: Byte -> what stands for it: itself, its lower case, or a space for a delimiter. UTF-8 bytes from 0x80 on stay.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Bytes of one slice of a text: bounds what a task holds of a text besides the text itself.
SLICE = 1 << 20
#: Bytes of slices that are worked on together.
TOGETHER = 4 << 20


def normalised(text: str | None) -> bytes:
    """The text in lower case, each delimiter as a space; ``.split()`` gives its words."""
    return (text or "").encode().translate(_TABLE)


def slices(raw: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A normalised text in consecutive slices. They are cut at delimiters, so a word longer than a slice stays whole."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def together(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """The slices of the texts in order, a bounded number of bytes at a time, each with the number of its text."""
    rows: list[int] = []
    pieces: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in slices(normalised(text)):
            rows.append(i)
            pieces.append(piece)
            size += len(piece)
            if size >= TOGETHER:
                yield rows, pieces
                rows, pieces, size = [], [], 0
    if pieces:
        yield rows, pieces
