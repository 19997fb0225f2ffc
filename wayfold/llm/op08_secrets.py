"""Secret scans through a trigram inverted index.

Each rule's regular expression yields a Boolean trigram query. The index lists,
for every trigram that some query names, the documents that hold it; postings
are intersected and united by document to the rules whose query is met, and
only those documents are verified by the expression. Rules without mandatory
trigrams are verified on every document.

All of it is DataFrame and SQL functions. Postings are keyed by a hash of the
row, so null or repeated keys do no harm: a collision or a repeated row can
only add a candidate, which verification then discards. Only postings (a
number and a hash) and texts by that hash are shuffled; no group collects texts.

Spans are ``kind:start:end`` in code points, end exclusive, of the whole match;
matches of a kind are leftmost and do not overlap, and those whose checked part
is too short are dropped, together with the text they consumed. Places are sums
over blocks of ``BLOCK`` matches, so the work grows with the text, however many
matches it has.

Defined cases: null text is empty and stays null when masked; empty and very
long texts are scanned whole; rows that repeat give their own result rows; spans
of equal start go by the order of the rules; internal columns take names that
the frame does not use, and a column named like an output (``spans_<kind>``) is
replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import unused
from wayfold.llm.trigrams import query, trigrams

BLOCK = 256
CUT = 1024
WORD = 62
SPANS = "array<struct<start:int,end:int,n:int>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  # characters that the checked group must have
    group: int = 0
    any_case: bool = False
    base: bool = False
    only: str = ""  # an expression of the kept matches alone, where it finds the same ones

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + (self.only or self.pattern)


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, base=True, only="AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 24, base=True, only="[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
)


def _bind(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def row_key(*columns: str) -> Column:
    return F.xxhash64(*columns)


def postings(df: DataFrame, wanted: list[str], key: Column, text: str = "text") -> DataFrame:
    """The inverted index over ``wanted`` trigrams: ``trigram`` (its place in the list) and ``key``."""
    folded = F.lower(F.coalesce(F.col(text), F.lit("")))
    held = _bind(folded, lambda t: F.array_compact(F.array(*(F.when(F.contains(t, F.lit(g)), F.lit(k)) for k, g in enumerate(wanted)))))
    return df.select(key.alias("key"), F.explode(held).alias("trigram"))


def _holds(q, place: dict[str, int], found: Column) -> Column:
    if q is True:
        return F.lit(True)
    if isinstance(q, str):
        word, bit = divmod(place[q], WORD)
        return F.get(found, F.lit(word)).bitwiseAND(F.lit(1 << bit)) != 0
    parts = [_holds(x, place, found) for x in q[1]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if q[0] == "and" else (out | p)
    return out


def candidates(index: DataFrame, rules: list[Rule], wanted: list[str]) -> DataFrame:
    """Documents whose postings meet some rule's query: ``key`` and ``rules`` (places in the list)."""
    place = {g: k for k, g in enumerate(wanted)}
    words = range(-(-len(wanted) // WORD))
    bit = F.expr(f"shiftleft(1L, trigram % {WORD})")
    # a document's trigrams are a set of bits, as many words as the rules need
    bits = index.groupBy("key").agg(*(F.coalesce(F.bit_or(F.when(F.floor(F.col("trigram") / WORD) == w, bit)), F.lit(0).cast("long")).alias(f"w{w}") for w in words))
    met = bits.select("key", F.array(*(f"w{w}" for w in words)).alias("found"))
    rules_met = F.array_compact(F.array(*(F.when(_holds(query(r.pattern), place, F.col("found")), F.lit(k)) for k, r in enumerate(rules))))
    return met.select("key", rules_met.alias("rules")).where(F.size("rules") > 0)


def running(values: Column, join) -> Column:
    """``join`` of all values up to each one of a non-empty array, by blocks: each value is handled a bounded number of times."""

    def grown(of: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(join(F.element_at(acc, -1), x))))

        return F.aggregate(of, F.array().cast("array<int>"), step)

    def whole(inner: Column) -> Column:
        before = grown(F.transform(inner, lambda b: F.element_at(b, -1)))
        return _bind(before, lambda done: F.flatten(F.transform(inner, lambda b, i: F.when(i == 0, b).otherwise(_bind(F.get(done, i - 1), lambda up: F.transform(b, lambda x: join(up, x)))))))

    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    return _bind(F.transform(F.sequence(F.lit(0), last), lambda b: grown(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))), whole)


def spans(text: Column, rule: Rule) -> Column:
    """All kept matches of ``rule``: an array of (start, end, characters of the checked group)."""

    def place(pieces: Column, matches: Column, groups: Column) -> Column:
        steps = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
        return _bind(running(steps, lambda a, b: a + b), lambda ends: F.transform(matches, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), F.length(F.get(groups, i)).alias("n"))))

    def found(t: Column) -> Column:
        return _bind(F.regexp_extract_all(t, F.lit(rule.java), F.lit(0)), lambda matches: F.when(F.size(matches) == 0, F.lit(None)).otherwise(
            _bind(F.split(t, rule.java, -1), lambda pieces: _bind(F.regexp_extract_all(t, F.lit(rule.java), F.lit(rule.group)) if rule.group else matches, lambda groups: place(pieces, matches, groups)))
        ))

    all_spans = _bind(text, lambda t: F.when(F.rlike(t, F.lit(rule.java)), found(t)))
    kept = F.filter(all_spans, lambda s: s["n"] >= rule.least)
    return F.coalesce(kept, F.array().cast(SPANS))


def scan(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, key: tuple[str, ...] | None = None, prefix: str = "spans_") -> DataFrame:
    """Append one array of spans a rule, ``spans_<kind>``; other columns stay.

    ``key``: the columns that the index's row hash is taken of, by default all.
    """
    wanted = sorted(set().union(*(trigrams(query(r.pattern)) for r in rules)))
    indexed = [r for r in rules if query(r.pattern) is not True]
    row, met_rules = unused(df, "_row"), unused(df, "_rules")
    key_of = row_key(*(key or df.columns))
    keyed = df.withColumn(row, key_of)
    if indexed:
        met = candidates(postings(df, wanted, key_of, text), indexed, wanted)
        keyed = keyed.join(met.withColumnsRenamed({"key": row, "rules": met_rules}), row, "left")
    value, found = F.coalesce(F.col(text), F.lit("")), {}
    for r in rules:
        own = spans(value, r)
        if r in indexed:
            own = F.when(F.array_contains(met_rules, indexed.index(r)), own).otherwise(F.array().cast(SPANS))
        found[f"{prefix}{r.kind}"] = own
    return keyed.withColumns(found).drop(row, met_rules)


def listing(rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` of the scanned rules by start, then rule order, comma-joined."""
    def said(k: int, r: Rule) -> Column:
        return F.transform(f"spans_{r.kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), F.concat_ws(":", F.lit(r.kind), s["start"].cast("string"), s["end"].cast("string")).alias("said")))

    parts = [said(k, r) for k, r in enumerate(rules)]
    return F.array_join(F.transform(F.sort_array(F.concat(*parts)), lambda s: s["said"]), ",")


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` to ``end`` of a text in blocks of ``CUT`` characters."""
    one, two = F.floor(start / CUT).cast("int"), F.floor(end / CUT).cast("int")
    first = F.coalesce(F.get(blocks, one), F.lit(""))
    return F.when(one == two, F.substring(first, start % CUT + 1, end - start)).otherwise(
        F.concat(F.substring(first, start % CUT + 1, F.lit(CUT)), F.array_join(F.slice(blocks, one + 2, two - one - 1), ""), F.substring(F.coalesce(F.get(blocks, two), F.lit("")), F.lit(1), end % CUT))
    )


def redact(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``df`` with every span masked in ``text``; spans that overlap or touch become one mask."""
    names, prefix = df.columns, unused(df, "_spans_")
    out = scan(df, text, rules, prefix=prefix)
    every = F.sort_array(F.concat(*(F.transform(F.col(f"{prefix}{r.kind}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for r in rules)))

    def masked(given: Column) -> Column:
        ends = running(F.transform(given["spans"], lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        blocks = F.regexp_extract_all(given["text"], F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))

        def joined(parts: Column) -> Column:
            end, cut = parts["end"], parts["blocks"]

            def piece(s: Column, i: Column) -> Column:
                before = F.when(i == 0, F.lit(0)).otherwise(F.get(end, i - 1))
                return F.when((i > 0) & (s["start"] <= before), F.lit("")).otherwise(F.concat(_cut(cut, before, s["start"]), F.lit(mask)))

            return F.concat(F.array_join(F.transform(given["spans"], piece), ""), _cut(cut, F.element_at(end, -1), F.length(given["text"])))

        return _bind(F.struct(ends.alias("end"), blocks.alias("blocks")), joined)

    return out.withColumn(text, _bind(F.struct(F.col(text).alias("text"), every.alias("spans")), lambda given: F.when(F.size(given["spans"]) == 0, given["text"]).otherwise(masked(given)))).select(*names)
