"""Fill-in-the-middle: texts cut at two ranks into prefix, middle and suffix, and put together in another order.

A text is a row of units, matches of a pattern from left to right (by default single code points; words or lines work as
well). An indexable skip list over the units finds a cut: lane 0 has a link for each unit, every lane above a link for about
one in ``FAN`` of those below, and each link carries its width in units and in code points. A search for a rank starts on the
top lane, runs right while the accumulated unit width stays within the rank, goes one lane down, and ends exactly at the
rank, with the code points before it as the sum of the other widths.

Cuts and form are functions of the id and the text alone, so they hold whatever the partitioning and after a lost executor.
Empty and null texts, texts that contain a sentinel, and the share ``plain`` of the others stay as they are. A null id
is hashed as the text ``null``; repeated rows and rows that share an id are treated one by one; other columns play no part.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
CODE_POINTS = r"(?s)."
#: Links of a lane for one of the lane above, on average.
FAN = 16
#: Characters of text whose results a worker holds before it hands them on.
HELD = 1 << 20
#: Of 100 texts with a middle, so many stay plain, and of the others so many put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


class SkipList:
    """Units in a row, found by rank. ``widths`` are their code points."""

    def __init__(self, widths: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.lanes = [(None, None, np.asarray(widths))]  # lane 0: every link is one unit, and none has a link below
        while len(self.lanes[-1][2]) > 2 * FAN:
            _, units, chars = self.lanes[-1]
            n = len(chars)
            tower = rng.random(n) < 1 / FAN
            tower[0] = True
            down = np.flatnonzero(tower)
            wide = np.diff(down, append=n) if units is None else np.add.reduceat(units, down)
            self.lanes.append((down, wide.astype(np.int64), np.add.reduceat(chars, down, dtype=np.int64)))

    def code_points(self, rank: int) -> int:
        """Code points in the first ``rank`` units."""
        link = units_before = chars_before = 0
        for k in range(len(self.lanes) - 1, -1, -1):
            down, units, chars = self.lanes[k]
            while link < len(chars) and units_before + (wide := 1 if units is None else int(units[link])) <= rank:
                units_before += wide
                chars_before += int(chars[link])
                link += 1
            if k:
                link = int(down[link]) if link < len(down) else len(self.lanes[k - 1][2])
        return chars_before


def _units(text: str, unit: str) -> np.ndarray:
    if unit == CODE_POINTS:
        return np.ones(len(text), np.uint8)
    ends = [m.end() for m in regex.finditer(unit, text)]
    if ends:
        ends[-1] = len(text)  # what follows the last match belongs to it
    return np.diff(np.array(ends, np.int64), prepend=0)


def draws(doc_id) -> list[int]:
    """Four numbers below 2**32 that belong to an id."""
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]


def transform(doc_id, text: str, unit: str = CODE_POINTS) -> tuple[int, str, str | None, str | None, str]:
    """(units, form, prefix, middle, output) of a text; no prefix and middle if it is left plain."""
    widths = _units(text, unit)
    n, (h1, h2, h3, h4) = len(widths), draws(doc_id)
    if not text or h3 % 100 >= 100 - PLAIN or any(s in text for s in SENTINELS):
        return n, "plain", None, None, text
    skips = SkipList(widths)
    low, high = (skips.code_points(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", prefix, middle, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", prefix, middle, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(form: str, output: str) -> str:
    """The text that ``transform`` made ``output`` of."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _mapped(docs: DataFrame, unit: str, id_col: str, text_col: str, last: str, shown) -> DataFrame:
    names = ["n", "form", "prefix_chars", "middle_chars", *[c.split()[0] for c in last.split(", ")]]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * (len(names) - 4)]

    def run(batches):
        for b in batches:
            ids, first, held, size = b.column("doc_id"), 0, [], 0
            for k, d in enumerate(ids.to_pylist()):
                text = b.column("text")[k].as_py() or ""
                n, form, prefix, middle, output = transform(d, text, unit)
                held.append((n, form, *[None if x is None else len(x) for x in (prefix, middle)], *shown(form, output)))
                size += len(text)
                if size >= HELD or k + 1 == len(ids):
                    columns = [pa.array(v, t) for v, t in zip(zip(*held, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(held)), *columns], names=["doc_id", *names])
                    first, held, size = k + 1, [], 0

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, {last}")


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row."""
    return _mapped(docs, unit, id_col, text_col, "output string", lambda form, output: (output,))


def digests(docs: DataFrame, unit: str = CODE_POINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``fill_in_middle``, with SHA-256 digests of the output and of the text rebuilt from it in place of the output."""
    def shown(form: str, output: str) -> list[str]:
        return [hashlib.sha256(x.encode()).hexdigest() for x in (output, restore(form, output))]

    return _mapped(docs, unit, id_col, text_col, "output_sha256 string, restored_sha256 string", shown)
