"""Fill-in-the-middle: texts cut at token boundaries and written prefix, suffix, middle, or suffix first.

A token is a run of letters A-Z and a-z, or any other code point. The work on a text is a few
operations on integers with one bit a code point: ``bytes.translate`` builds the mask of letters,
a shifted conjunction removes those followed by a letter, so what is left marks the tokens' ends;
``bit_count`` gives their number n, and the place of the k-th one is found by halving the integer and
counting the lower half (``ranked``), which costs a constant times the length.

Where a text is cut, and in which form it is written, follows from its id alone (``draws``), so
every run gives the same rows. ``restored`` rebuilds the text from the output and its form.

Cases: a null text is empty; an empty text, one that holds one of the three marks, and by the draw every tenth is
plain: the output is the text, and both lengths are null. A null id draws like an id of no digits. Rows with one
id count by themselves; very long texts are cut as a whole; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are rewritten, and percent of these with the suffix first.
REWRITTEN, SUFFIX_FIRST = 90, 20
#: Digits of an integer to the base two: 1 for a letter. A code point beyond one byte is no letter.
LETTERS = bytes(49 if chr(b).isascii() and chr(b).isalpha() else 48 for b in range(256))
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def token_ends(text: str) -> int:
    """An integer whose bit i says whether a token ends with code point i; text has one at least."""
    letters = int(text.encode("latin-1", "replace").translate(LETTERS)[::-1], 2)
    return ((1 << len(text)) - 1) ^ (letters & (letters >> 1))


def ranked(bits: int, width: int, k: int) -> int:
    """The place of the k-th set bit (from 1) among the lowest ``width``."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if k <= n:
            bits, width = low, half
        else:
            bits, width, k, at = bits >> half, width - half, k - n, at + half
    return at


def draws(doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits that follow from the id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4]) for k in (0, 4, 8, 12)]


def transformed(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output."""
    ends = token_ends(text) if text else 0
    n = ends.bit_count()
    h1, h2, h3, h4 = draws(doc_id)
    if not text or h3 % 100 >= REWRITTEN or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, last = (ranked(ends, len(text), k) + 1 if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of docs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column(0).to_pylist()
                made = [transformed(i, t) for i, t in zip(ids, part.column(1).to_pylist())]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array(v, k) for v, k in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], [c.split()[0] for c in MADE.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(each, MADE)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of; the marks occur once each."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
