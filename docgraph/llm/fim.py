"""Fill-in-the-middle: documents cut at two code points and put together anew, with marks between the parts.

Cuts are code points, texts are UTF-8 bytes. Only multibyte characters are
indexed: for each its position, in code points, and the bytes in excess of one
that come before it and with it. A cut's byte is the cut plus the excess of the
characters before it, found by ``searchsorted``; where a text has no such
character the two are equal.

Nulls and edge cases: a null text is an empty one, an empty text is plain; a
text that holds a mark is plain, as its parts couldn't be told again. A null
doc_id draws as an empty one. Rows are documents of their own, repeated rows get
equal output. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, frugal, in_pieces

#: The marks before prefix, suffix and middle, and the shares in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED, SPM = 90, 20

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Exceptions:
    """The multibyte characters of a buffer of many texts: ``at`` their bytes, ``excess`` the bytes above one, summed up."""

    def __init__(self, data: np.ndarray) -> None:
        self.at = np.flatnonzero(data >= 0xC0)  # first bytes; those that follow are below
        lead = data[self.at]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))])

    def of(self, start: int, stop: int) -> tuple[int, np.ndarray, np.ndarray]:
        """For the text at ``start`` to ``stop``: its code points, the positions of its multibyte characters, and the excess up to each."""
        a, b = np.searchsorted(self.at, (start, stop))
        excess = self.excess[a : b + 1] - self.excess[a]
        return int(stop - start - excess[-1]), self.at[a:b] - start - excess[:-1], excess


def to_byte(cut: int, positions: np.ndarray, excess: np.ndarray) -> int:
    """The byte at which code point ``cut`` begins."""
    return int(cut + excess[np.searchsorted(positions, cut)])


def draws(doc_id: Column) -> list[Column]:
    """h1 to h4 of a document."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def arranged(text: bytes, start: int, exceptions: Exceptions, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, prefix, middle, output) of a text that starts at byte ``start`` of the indexed buffer."""
    marks = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    n, positions, excess = exceptions.of(start, start + len(text))
    if not text or h[2] % 100 >= CHANGED or any(m in text for m in marks):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = to_byte(low, positions, excess), to_byte(high, positions, excess)
    prefix, middle, suffix = marks[0] + text[:a], marks[2] + text[a:b], marks[1] + text[b:]
    if h[3] % 100 < SPM:
        return n, "spm", low, high - low, suffix + prefix + middle
    return n, "psm", low, high - low, prefix + suffix + middle


def transform(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of documents (doc_id, text): plain, psm or spm by the draws of the id."""

    def run(batches: Batches) -> Batches:
        for piece in in_pieces(batches, 1):
            texts = piece.column(1).cast(pa.binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
            body = texts.buffers()[2]
            data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
            exceptions, first = Exceptions(data), int(offsets[0])
            hashes = zip(*(piece.column(c).to_pylist() for c in range(2, 6)), strict=True)
            rows = [arranged(t or b"", int(at) - first, exceptions, h) for t, at, h in zip(texts.to_pylist(), offsets[:-1], hashes, strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            n, form, prefix, middle, output = (pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds))
            yield pa.RecordBatch.from_arrays([piece.column(0), n, form, prefix, middle, output.cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *draws(F.col("doc_id"))).mapInArrow(frugal(run), OUT)


def restored(form: Column, output: Column) -> Column:
    """The text of an output: its parts in the order prefix, middle, suffix."""
    after = lambda mark: F.substring_index(output, mark, -1)
    before = lambda part, mark: F.substring_index(part, mark, 1)
    middle = after(MIDDLE)
    psm = F.concat(before(after(PREFIX), SUFFIX), middle, before(after(SUFFIX), MIDDLE))
    spm = F.concat(before(after(PREFIX), MIDDLE), middle, before(after(SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
