"""Words as runs of bytes: A-Z lowered, every byte beyond ASCII a letter, all that is not asked for a gap."""

from __future__ import annotations

from collections.abc import Iterator

LOWER, DIGITS, BEYOND = b"abcdefghijklmnopqrstuvwxyz", b"0123456789", bytes(range(128, 256))
#: Bytes of text that are split at a time, up to the end of the word there.
PART_BYTES = 1 << 20


def folding(kept: bytes) -> bytes:
    """A table for bytes.translate(): kept bytes stay, A-Z become a-z, others a space. UTF-8 never splits within a character."""
    table = bytearray(b" " * 256)
    for b in kept:
        table[b] = b
    for b in LOWER:
        table[b - 32] = b
    return bytes(table)


def parts(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, some at a time, so that a long text is never one long list."""
    folded, at = text.translate(table), 0
    while at < len(folded):
        end = folded.find(b" ", at + PART_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end
