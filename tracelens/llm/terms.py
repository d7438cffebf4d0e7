"""Terms as runs of chosen characters, found over the bytes of UTF-8 texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

#: Bytes of a text that are words at once.
PIECE = 1 << 20


def letters(kept: str) -> bytes:
    """A table for ``bytes.translate``: A-Z in lower case, ``kept`` and all non-ASCII bytes as they are, the rest a space.

    Bytes of one non-ASCII character are all above 127, so what ``split`` leaves are the maximal runs of characters.
    """
    own = {ord(c) for c in kept}
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in own else 32 for b in range(256))


def words(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The words of a whole text, in lists; a long text is cut at spaces."""
    plain = text.translate(table)
    at, end = 0, len(plain)
    while end - at > PIECE:
        cut = plain.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield plain[at:cut].split()
        at = cut
    yield (plain[at:] if at else plain).split()


def tally(text: bytes, table: bytes) -> Counter:
    """How often each word is in a text."""
    out: Counter = Counter()
    for some in words(text, table):
        out.update(some)
    return out
