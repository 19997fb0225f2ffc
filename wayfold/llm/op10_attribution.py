"""Token counts by section: encode a document once, then map tokens to sections by offset.

A document is encoded whole, so a section's count is what it costs inside the
document, not what it would cost alone. Token byte lengths give each token's
character span; a merge over sorted bounds joins the spans to the sections.

Rules for a token that crosses a section bound:

* ``first``: it belongs to the section with its first character;
* ``most``: to the section with most of its characters, the earlier on a tie.

Defined cases: null or empty text has no tokens and no sections; a character
outside every section counts as outside; tokens inside one character (bytes of
it) belong to that character; repeated rows give repeated results; a very long
text is encoded piece by piece at safe boundaries, its spans are those of the whole;
other columns, whatever their names, are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wayfold.llm.common import bounded
from wayfold.llm.op05_bpe import RANKS, encode_text, encoding

RULES = ("first", "most")


@lru_cache(maxsize=2)
def _lengths(name: str) -> np.ndarray:
    enc = encoding(name)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)


def token_spans(text: str, name: str = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """First character and one past the last character of each token of ``text``."""
    ends = np.cumsum(_lengths(name)[encode_text(text, name)])
    if not len(ends):
        return ends, ends
    starts = np.concatenate([[0], ends[:-1]])
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Every line with its line break is a section."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    if not len(ends) or ends[-1] < len(points):
        ends = np.append(ends, len(points))
    return np.concatenate([[0], ends[:-1]]), ends


def allocate(start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int, int]:
    """Tokens in each of the sorted, disjoint sections; tokens outside; tokens that cross a bound."""
    counts = np.zeros(len(low), np.int64)
    if not len(start) or not len(low):
        return counts, len(start), 0
    at = np.searchsorted(low, start, "right") - 1
    last = np.searchsorted(low, end - 1, "right") - 1
    crossing = (at != last) | ((at >= 0) & (end > high[at]))
    if rule == "most":
        for i in np.flatnonzero(crossing):
            around = np.arange(max(at[i], 0), last[i] + 1)
            share = np.minimum(high[around], end[i]) - np.maximum(low[around], start[i])
            if len(share) and share.max() > 0:
                at[i] = around[np.argmax(share)]
    inside = (at >= 0) & ((start < high[at]) | ((rule == "most") & crossing & (low[at] < end) & (start < high[at])))
    np.add.at(counts, at[inside], 1)
    return counts, int((~inside).sum()), int(crossing.sum())


def attribute(df: DataFrame, doc_id: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "first", name: str = RANKS) -> DataFrame:
    """One row a document with its token counts by section.

    ``sections`` names an ``array<struct<start, end>>`` column of sorted,
    disjoint character ranges; without it the sections are the lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        for batch in bounded(batches, 1):
            out: list[list] = [[] for _ in range(5)]
            for k in range(batch.num_rows):
                value = batch.column(1)[k].as_py() or ""
                if sections is None:
                    low, high = line_sections(value) if value else (np.zeros(0, np.int64),) * 2
                else:
                    given = batch.column(2)[k].as_py() or []
                    low, high = (np.array([x[f] for x in given], np.int64) for f in ("start", "end"))
                start, end = token_spans(value, name)
                counts, outside, crossing = allocate(start, end, low, high, rule)
                for column, x in zip(out, (len(start), len(low), outside, crossing, counts.tolist()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.list_(pa.int64()))],
                names=[doc_id, "n_tokens", "n_sections", "n_outside", "n_crossing", "section_tokens"],
            )

    schema = T.StructType([T.StructField(doc_id, df.schema[doc_id].dataType), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_sections", "n_outside", "n_crossing")), T.StructField("section_tokens", T.ArrayType(T.LongType()))])
    return df.select(doc_id, text, *([sections] if sections else [])).mapInArrow(run, schema)
