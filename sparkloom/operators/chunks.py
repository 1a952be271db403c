"""Texts cut into chunks at their natural seams, and the names that each chunk mentions.

One Arrow pass over the files where they lie: nothing is shuffled, one text is in
memory at a time besides its batch, and a chunk's names are taken in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import in_batches
from ..functions import text as t
from ..functions.outline import SOFT, STRONG, outline

# fixed values: lines and characters of a chunk; a strong seam ends one from the first, a soft one from the second, nothing goes past the third
LINES = (8, 40, 60)
CHARS = (400, 1500, 2000)
# fixed values: a stub's lines and their length
STUB_LINES, STUB_CHARS = 12, 200

SCHEMA = pa.schema([("path", pa.string()), ("language", pa.string()), *((c, pa.int32()) for c in ("ordinal", "start_line", "end_line")), ("heading", pa.string()), ("text", pa.string()), ("status", pa.string())])
ROWS = "path string, language string, ordinal int, start_line int, end_line int, heading string, text string, status string"


def _parts(line: str) -> Iterator[str]:
    """A line of more characters than a chunk may have, parted after a blank of its second half where there is one."""
    while len(line) > CHARS[2]:
        at = line.rfind(" ", CHARS[2] // 2, CHARS[2]) + 1 or CHARS[2]
        yield line[:at]
        line = line[at:]
    if line:
        yield line


def seams(sizes: list[int], strengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of lines, each as long as the limits allow: a full one goes back to its last soft seam, if that keeps half of it."""
    before = [0]
    for size in sizes:
        before.append(before[-1] + size + 1)
    start, i, soft = 0, 0, None
    while i < len(sizes):
        n, chars, strength = i - start, before[i] - before[start], strengths[i]
        ripe = (strength >= STRONG and (n >= LINES[0] or chars >= CHARS[0])) or (strength >= SOFT and (n >= LINES[1] or chars >= CHARS[1]))
        full = n >= LINES[2] or before[i + 1] - before[start] > CHARS[2]
        if n and (ripe or full):
            if not ripe and soft is not None and soft - start >= max(1, n // 2):
                i = soft
            yield start, i
            start, soft = i, None
            continue
        if n and strength >= SOFT:
            soft = i
        i += 1
    if start < i:
        yield start, i


def chunked(text: str, language: str | None) -> Iterator[tuple[int, int, str, str]]:
    """First and last line (from 1), heading and text of each chunk; blank lines at its ends are left out."""
    lines = [line.rstrip() for line in text.split("\n")]
    strengths, headings = outline(language, lines)
    where, parts, strong = [], [], []
    for i, line in enumerate(lines):
        for k, part in enumerate([line] if len(line) <= CHARS[2] else _parts(line)):
            where.append(i)
            parts.append(part)
            strong.append(0 if k else strengths[i])
    for start, end in seams(list(map(len, parts)), strong):
        held = [k for k in range(start, end) if parts[k].strip()]
        if held:
            inner = range(held[0], held[-1] + 1)
            yield where[held[0]] + 1, where[held[-1]] + 1, next((headings[where[k]] for k in inner if headings[where[k]]), ""), "\n".join(parts[k] for k in inner)


def _stub(text: str) -> tuple[int, int, str, str] | None:
    lines = text.split("\n", STUB_LINES)[:STUB_LINES]
    head = "\n".join(line[:STUB_CHARS] for line in lines).strip()
    return (1, len(lines), "", head) if head else None


def file_chunks(files: DataFrame, stub_chars: int | None = None, stub_line: int | None = None) -> DataFrame:
    """path, language, ordinal, start_line, end_line, heading, text, status and names of each chunk of files (path, language, text).

    Secrets are masked before lines are measured.  A null or blank text has no
    chunk.  Whole texts are cut; only with ``stub_chars`` or ``stub_line`` does a
    text, or one with a line, of more characters give a stub of its first lines
    instead.  Repeated rows give repeated chunks; other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, language, text = (c[k].as_py() for c in batch.columns)
                if not text or not text.strip():
                    continue
                large = (stub_chars is not None and len(text) > stub_chars) or (stub_line is not None and any(len(x) > stub_line for x in text.split("\n")))
                found = [x for x in [_stub(text)] if x] if large else chunked(text, language)
                for n, chunk in enumerate(found):
                    yield path, language, n, *chunk, "stub" if large else "chunked"

    masked = files.select("path", "language", t.redact(F.col("text")).alias("text"))
    return masked.mapInArrow(lambda batches: in_batches(rows(batches), SCHEMA), ROWS).withColumn("names", t.names(F.col("text")))
