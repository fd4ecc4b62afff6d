"""Words of whole texts, block by block, so that a very long text needs bounded memory."""

from __future__ import annotations

import re
from collections.abc import Iterator

BLOCK_BYTES = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def byte_words(text: str | None, lower: bool = False) -> Iterator[list[bytes]]:
    """Lists of the words ``[^\\x20\\x09-\\x0D]+`` of a text, in order, as UTF-8.

    Blocks end between words; ``bytes.split`` cuts at exactly these six characters and
    ``bytes.lower`` changes exactly A-Z.  A null text has no block.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    if lower:
        data = data.lower()
    at = 0
    while at < len(data):
        end = at + BLOCK_BYTES
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        else:
            end = len(data)
        if words := data[at:end].split():
            yield words
        at = end


BLOCK_CHARS = 1 << 20
WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"[\W_]")


def plain_words(text: str | None) -> Iterator[list[str]]:
    """Lists of the lower-case runs of letters and digits of a text, in order."""
    text = (text or "").lower()
    at = 0
    while at < len(text):
        gap = _BREAK.search(text, at + BLOCK_CHARS)
        end = gap.start() if gap else len(text)
        if words := WORD.findall(text, at, end):
            yield words
        at = end
