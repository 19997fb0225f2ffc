"""Watch lists of many patterns: a literal index chooses candidates, the pattern decides.

A pattern's mandatory literals must stand in every text that it matches. The
runs of such a literal whose length is the largest of ``SIZES`` that fits are
its keys; at a word's edge a key is told apart from the same run within a word.
A pattern is indexed by the key that fewest patterns and fewest texts may have. The
texts' runs go through a filter of all keys' hashes once, whatever the number of
patterns, and what is left meets the index in one join by hash: Catalyst's choice for long
lists, a broadcast for up to ``LISTED`` patterns. Patterns whose literals are all there are
matched. Patterns without any literal are matched on every text, ``BLOCK`` of them in one
expression.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.sources import shared

GRAM = 3
#: Lengths of keys: all short ones, for numbers of any length tell patterns apart best by their whole.
SIZES = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32)
#: Patterns whose index is broadcast; that of longer lists is left to Catalyst.
LISTED = 100_000
#: Bits of the filter for each pattern, and its least and largest size (32 MB): over that it only lets more runs pass.
SPARE, LEAST_BITS, MOST_BITS = 32, 16, 28
#: Bytes of text that a task cuts at once.
CUT = 1 << 20
BLOCK = 64
_OPEN, _CLOSE = "([{", ")]}"
_LEFT, _RIGHT = 1, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mandatory(pattern: str | None, shortest: int = GRAM) -> list[str]:
    """Runs of ``shortest`` or more ASCII characters, in upper case, that stand in every match.

    Groups, classes and escapes of letters end a run, as does what may be
    missing or repeated; patterns with alternatives outside groups, quotation or comment mode have none.
    """
    if pattern is None or "\\Q" in pattern or "(?x" in pattern:
        return []
    runs, run, k = [], "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "|":
            return []
        if c in "([":
            runs.append(run)
            run, k = "", _closing(pattern, k) + 1
            if k <= 0:
                return []
            k = _quantified(pattern, k)
            continue
        escaped = c == "\\"
        if escaped:
            k += 1
            c = pattern[k : k + 1]
        plain = c.isascii() and (not c.isalnum() if escaped else c not in ".^$*+?{})") and c != ""
        after = pattern[k + 1 : k + 2]
        if escaped and not plain and c in "pPxukN":
            return []  # escapes with arguments
        if plain and after in ("?", "*", "{", "+"):
            least = after == "+" or (after == "{" and not pattern[k + 2 : k + 3].startswith("0"))
            runs.append(run + c if least else run)
            run = ""
        elif plain:
            run += c
        else:
            runs.append(run)
            run = ""
        k = _quantified(pattern, k + 1)
    return sorted({r.upper() for r in [*runs, run] if len(r) >= shortest})


def _closing(pattern: str, k: int) -> int:
    """Where the group or class that opens at ``k`` closes; -2 if it does not."""
    depth, inside = 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
            if not inside and not depth:
                return k
        elif c == "[":
            inside = True
            if pattern[k + 1 : k + 2] == "]" or pattern[k + 1 : k + 3] == "^]":
                k = pattern.index("]", k)
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return k
        k += 1
    return -2


def _quantified(pattern: str, k: int) -> int:
    """The place after a quantifier, if there is one."""
    if pattern[k : k + 1] == "{":
        k = pattern.find("}", k) + 1 or len(pattern)
    elif pattern[k : k + 1] in ("?", "*", "+"):
        k += 1
    return k + (pattern[k : k + 1] in ("?", "+"))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _runs(code: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` bytes, by doubling; the last ``size - 1`` places have none."""
    out, have, block, width = None, 0, code, 1
    while have < size:
        if size & width:
            n = len(code) - have - width + 1
            out, have = (block, width) if out is None else (_mix(out[: max(0, n)] * _ODD + block[have : have + max(0, n)]), have + width)
        block, width = _mix(block[: max(0, len(block) - width)] * _ODD + block[width:]), 2 * width
    return out


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True


def _keys(raw: np.ndarray, first: np.ndarray, last: np.ndarray, size: int):
    """Place and hash of each run of ``size`` bytes of a text, and once more for each combination of word edges that it has.

    ``first`` and ``last`` are the bounds of the text that each byte stands in.
    """
    code = _runs(_mix(raw.astype(np.uint64) + _ODD), size)
    at = np.flatnonzero(np.arange(len(code)) + size <= last[: len(code)])
    code = code[at]
    word = np.append(_WORD[raw], False)
    edges = ((at == first[at]) | ~word[at - 1]) * _LEFT + ((at + size == last[at]) | ~word[np.minimum(at + size, len(raw))]) * _RIGHT
    for edge in range(4):
        own = (edges & edge) == edge
        yield edge, at[own], _mix(code[own] ^ np.uint64(size * 4 + edge))


_EDGED = re.compile(r"(?:\\b|\\s\+?|\\W\+?)(?![?*+{])")


def _edges(pattern: str, literal: str) -> int:
    """Which ends of a literal are surely edges of words: it stands once, as it is, between escapes that say so."""
    k = pattern.upper().find(literal)
    if not pattern.isascii() or k < 0 or pattern.upper().find(literal, k + 1) >= 0 or "(?" in pattern.replace("(?:", ""):
        return 0
    left = literal[0].isalnum() and any(k == m.end() and (m.start() == 0 or pattern[m.start() - 1] != "\\") for m in _EDGED.finditer(pattern))
    return left * _LEFT + bool(literal[-1].isalnum() and _EDGED.match(pattern, k + len(literal))) * _RIGHT


def _indexed(patterns: list[str]) -> pd.DataFrame:
    """Of each pattern the literals, its possible keys, and how likely a text has each."""
    literals = [mandatory(p, 1) for p in patterns]
    of = np.repeat(np.arange(len(patterns)), [len(x) for x in literals])
    flat = [x for own in literals for x in own]
    raw = np.frombuffer("".join(flat).encode(), np.uint8)
    long = np.array([len(x) for x in flat], np.int64)
    start = np.cumsum(long) - long
    edges = np.array([_edges(patterns[k], x) for k, x in zip(of.tolist(), flat, strict=True)], np.int64)
    fits = np.array(SIZES)[np.searchsorted(SIZES, long, "right") - 1] if flat else long
    code, owner, keys, odds = _mix(raw.astype(np.uint64) + _ODD), [], [], []
    for size in np.unique(fits).tolist():
        mine = np.flatnonzero(fits == size)
        n = long[mine] - size + 1
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        one = np.repeat(mine, n)
        edge = edges[one] & np.where(at == 0, _LEFT, 0) | edges[one] & np.where(at + size == long[one], _RIGHT, 0)
        owner.append(of[one])
        keys.append(_mix(_runs(code, size)[start[one] + at] ^ (size * 4 + edge).astype(np.uint64)).view(np.int64))
        odds.append(8.0 ** -min(size, 6) * np.array([1, 0.25, 0.25, 0.0625])[edge])
    owner, keys, odds = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, keys, odds))
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(1, len(patterns)))
    return pd.DataFrame({"literals": literals, "keys": np.split(keys[order], cuts)[: len(patterns)], "odds": np.split(odds[order].astype(float), cuts)[: len(patterns)]})


def index(patterns: DataFrame) -> DataFrame:
    """``pattern_id, pattern, literals, gram``: ``gram`` is the hash of the key, null without one."""

    @F.pandas_udf("struct<literals:array<string>,keys:array<long>,odds:array<double>>")
    def parsed(p: pd.Series) -> pd.DataFrame:
        return _indexed(p.tolist())

    # a short file of many patterns would be read, and parsed, by one task
    rows = patterns.select("pattern_id", "pattern").where("pattern is not null").repartition("pattern_id", "pattern").withColumn("_p", parsed("pattern"))
    each = rows.select("pattern_id", "pattern", F.explode(F.array_distinct(F.arrays_zip("_p.keys", "_p.odds"))).alias("e")).select("pattern_id", "pattern", F.col("e.keys").alias("gram"), F.col("e.odds").alias("odds"))
    often = each.groupBy("gram").agg(F.count("*").alias("n"))
    first = each.join(often, "gram").groupBy("pattern_id", "pattern").agg(F.min(F.struct(F.col("n") * F.col("odds"), "gram")).alias("one"))
    return rows.select("pattern_id", "pattern", F.col("_p.literals").alias("literals")).join(first.select("pattern_id", "pattern", "one.gram"), ["pattern_id", "pattern"], "left")


def _filter(found: DataFrame, n: int) -> np.ndarray:
    """The bits of all keys' hashes, at most 2^MOST_BITS of them; each key sets three."""
    size = min(max((SPARE * n).bit_length(), LEAST_BITS), MOST_BITS)
    gram, mask = F.col("gram"), F.lit((1 << size) - 1)
    place = F.explode(F.array(*(F.shiftrightunsigned(gram, k).bitwiseAND(mask) + 1 for k in (0, 18, 36)))).alias("x")
    parts = found.where("gram is not null").select(place).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros((1 << size) // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _met(bits: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets pass."""
    mask, own = np.uint64(len(bits) * 8 - 1), np.arange(len(code))
    for k in (0, 18, 36):
        place = (code[own] >> np.uint64(k)) & mask
        own = own[(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return own


def hits(texts: DataFrame, patterns: DataFrame, key: str = "request_id", raw: str = "raw") -> DataFrame:
    """``key, pattern_id``: which patterns occur in each text, in any case. ``patterns``: pattern_id, pattern."""
    spark = texts.sparkSession
    path = shared.folder(spark, "patterns")
    index(patterns).write.parquet(path)
    found = spark.read.parquet(path)
    rows = texts.select(key, F.upper(raw).alias("_text"))
    n = found.where("gram is not null").count()
    out = None
    if n:
        bits = spark.sparkContext.broadcast(_filter(found, n))
        own = found.where("gram is not null").select("pattern_id", "gram", "literals", F.concat(F.lit("(?i)"), "pattern").alias("_pattern"))
        met = _cut(rows, key, bits).join(F.broadcast(own) if n <= LISTED else own, "gram").where(F.forall("literals", lambda x: F.contains(F.col("_text"), x)) & F.regexp_like("_text", F.col("_pattern")))
        out = met.select(key, "pattern_id")
    rest = found.where("gram is null").select("pattern_id", "pattern").toLocalIterator()
    block: list[tuple] = []
    for r in rest:
        block.append((r.pattern_id, r.pattern))
        if len(block) == BLOCK:
            out, block = _with(out, _scanned(rows, key, block)), []
    if block:
        out = _with(out, _scanned(rows, key, block))
    return out if out is not None else rows.join(patterns.select("pattern_id").limit(0), F.lit(False)).select(key, "pattern_id")


def _cut(rows: DataFrame, key: str, bits) -> DataFrame:
    """``key, _text, gram`` for each distinct run of a text that the filter lets pass."""

    def cut(batches):
        for batch in batches:
            part = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64)) // CUT
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for low, high in itertools.pairwise(cuts):
                if high > low:
                    yield from cut_one(batch.slice(low, high - low))

    def cut_one(batch):
        column = batch.column(1).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        owner = np.repeat(np.arange(len(column)), np.diff(offsets))
        owners, codes = [], []
        for size in SIZES:
            if size > len(raw):
                break
            for _, at, code in _keys(raw, offsets[owner], offsets[owner + 1], size):
                own = _met(bits.value, code)
                owners.append(owner[at[own]])
                codes.append(code[own])
        if not owners:
            return
        own, code = np.concatenate(owners), np.concatenate(codes)
        order = np.lexsort((code, own))
        own, code = own[order], code[order]
        new = np.append(True, (own[1:] != own[:-1]) | (code[1:] != code[:-1]))[: len(own)]
        own, code = own[new], code[new]
        for at in range(0, len(own), 1 << 14):
            take = pa.array(own[at : at + (1 << 14)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(code[at : at + (1 << 14)].view(np.int64))], names=[key, "_text", "gram"])

    return rows.mapInArrow(cut, rows.withColumn("gram", F.lit(0).cast("long")).schema)


def _with(out: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if out is None else out.unionByName(more)


def _scanned(rows: DataFrame, key: str, block: list[tuple]) -> DataFrame:
    """Matches of patterns that every text is tried with."""
    said = F.array(*(F.when(F.col("_text").rlike("(?i)" + p), F.lit(i)) for i, p in block))
    return rows.select(key, F.explode(F.array_compact(said)).alias("pattern_id"))


def watched(requests: DataFrame, patterns: DataFrame, key: str = "request_id", raw: str = "raw") -> DataFrame:
    """Append ``watch_hits``, the ids of the patterns found, and ``watched``, whether there are any."""
    by = hits(requests, patterns, key, raw).groupBy(key).agg(F.array_sort(F.collect_set("pattern_id")).alias("watch_hits"))
    return requests.join(by, key, "left").withColumn("watched", F.col("watch_hits").isNotNull())
