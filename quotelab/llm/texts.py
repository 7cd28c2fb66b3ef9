"""Words and row layout shared by the text operators."""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One byte per byte: A-Z become a-z; what is not a letter, a digit or part of a non-ASCII character becomes a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text: bytes | None) -> list[bytes]:
    """Lower-case runs of letters, digits and non-ASCII characters, as UTF-8. Null has none."""
    return text.translate(_TERMS).split() if text else []


def term_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of ``terms(text)``."""
    return [m.span() for m in _TERM.finditer(text)]


def tokens(text: bytes | None) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, as UTF-8. Null has none."""
    return text.split() if text else []


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (binary): other columns and their names do not matter to the operator."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))


def whole_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The row as one struct ``row`` beside its ``text`` (binary), so that no column name can clash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].cast("binary").alias("text"))


def with_text(rows: DataFrame, columns: list[str], text_col: str, new_text: str) -> DataFrame:
    """The columns of ``row`` again, with ``text_col`` taken from the column ``new_text``."""
    return rows.select(*[
        F.col(new_text).cast("string").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns
    ])


def batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    """A record batch from lists and their types."""
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))
