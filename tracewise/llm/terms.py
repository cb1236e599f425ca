"""Words of whole texts as bytes, cut at machine speed, for the operators that index words."""

from __future__ import annotations

from collections.abc import Iterator

#: Every byte but letters, digits and those of characters beyond ASCII parts two words; A-Z counts as a-z.
_PLAIN = bytes((c + 32) if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def plain_words(raw: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII, in UTF-8. Null has none."""
    return raw.translate(_PLAIN).split() if raw else []


def parts(batches, column: str, most: int) -> Iterator:
    """The batches' rows, cut so that a part has about `most` bytes in `column`, one row at least."""
    for batch in batches:
        at, size = 0, 0
        for k, raw in enumerate(batch.column(column)):
            size += len(raw.as_buffer() or b"") if raw.is_valid else 0
            if size >= most or k == batch.num_rows - 1:
                yield batch.slice(at, k + 1 - at)
                at, size = k + 1, 0
