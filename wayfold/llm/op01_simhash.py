"""SimHash near-duplicates: fingerprints linked by Hamming distance, compared in bit slices.

A fingerprint bit is the majority of that bit over the XXH64 hashes of a
text's word shingles. Two fingerprints within ``radius`` bits agree on at
least ``bands - radius`` of ``bands`` bit ranges, so every link shows up in a
bucket of equal values of some ``bands - radius`` ranges. The number of ranges
follows the number of distinct fingerprints and only sets the size of buckets:
each choice finds all links.

In a task, rows are sorted by bucket and turned into bit planes. A plane is
compared with itself shifted by d rows, or in large buckets with single rows,
64 rows to a machine word; differing bits are added by carry-save counters
plane by plane, and words of which all lanes exceed the radius are abandoned. Links found are
reduced to a spanning forest before they leave the task. Buckets of more than
``BLOCK`` rows are cut into parts by a hash, and every two parts meet in a task
of their own, so a task never holds more than two parts of a bucket.

Defined cases: null, empty and wordless texts have fingerprint zero, linked
like any other; very long texts are hashed whole, part by part; repeated rows and
ids fall into one class; equal fingerprints are one node; rows without an id keep
null and their class's smallest id; other columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import arrow_rows, bounded, bucketed, materialize, mix, unused
from wayfold.llm.graph import components

SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCK = 4096
PART = 1 << 16
#: Shingle hashes of a part's sets, and records of sets a batch to Python.
CODES, RECORDS = 1 << 21, 512
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_FOLD = bytes.maketrans(_UPPER, _LOWER)


def _shingles(text: str | None, k: int) -> tuple[bytes, list[int], list[int]]:
    """Folded text with single spaces, and where its shingles start and end."""
    raw = _SPACES.sub(b" ", (text or "").encode().translate(_FOLD)).strip(b" ")
    if not raw:
        return raw, [], []
    bounds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    start, end = np.concatenate([[0], bounds + 1]), np.concatenate([bounds, [len(raw)]])
    last = max(1, len(start) - k + 1)
    return raw, start[:last].tolist(), end[-last:].tolist()


def _majority(raw: bytes, low: list[int], high: list[int], digest, seeds: tuple[int, ...]) -> bytes:
    """The bits that over half of the shingles' digests have set; none without shingles."""
    parts = []
    for seed in seeds:
        ones, width = 0, len(digest(b"", seed))
        for at in range(0, len(low), PART):
            hashes = b"".join([digest(raw[a:b], seed) for a, b in zip(low[at : at + PART], high[at : at + PART], strict=True)])
            ones = ones + np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, width), axis=1).sum(axis=0, dtype=np.int64)
        parts.append(np.packbits(2 * ones > len(low)).tobytes() if low else bytes(width))
    return b"".join(parts)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    import xxhash

    return int.from_bytes(_majority(*_shingles(text, k), xxhash.xxh64_digest, (SEED,)), "big")


def sketch(text: str | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of a text, and a 256-bit fingerprint (four words): the majority of each bit over them."""
    import xxhash

    raw, low, high = _shingles(text, k)
    pairs = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b], SEED) for a, b in zip(low, high, strict=True)]), np.uint64).reshape(-1, 2)
    own, at = np.unique(pairs[:, 0], return_index=True)
    ones = np.zeros((4, 64), np.int64)
    for start in range(0, len(own), PART):
        one, two = own[start : start + PART], pairs[at[start : start + PART], 1]
        for word, hashes in enumerate((one, two, mix(one + np.uint64(SEED)), mix(two + np.uint64(SEED)))):
            ones[word] += np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return own, np.packbits(2 * ones > len(own), axis=1).view(np.int64)[:, 0]


def set_hash(own: np.ndarray) -> int:
    """One signed number for a set of shingles: texts of equal sets share it."""
    import xxhash

    value = xxhash.xxh64_intdigest(own.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in bounded(batches, 1):
            values = np.array([fingerprint(x.as_py(), k) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=[doc_id, "fp"])

    return df.select(doc_id, text).mapInArrow(run, T.StructType([T.StructField(doc_id, df.schema[doc_id].dataType), T.StructField("fp", T.LongType())]))


def scheme(n: int, radius: int = RADIUS, block: int = BLOCK) -> list[int]:
    """Masks of the bit ranges that must agree; enough bits that ``n`` random fingerprints make small buckets."""
    for agree in range(1, 64 - radius):
        bands = radius + agree
        cuts = [round(64 * i / bands) for i in range(bands + 1)]
        ranges = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
        masks = [sum(c) for c in itertools.combinations(ranges, agree)]
        if n / 2 ** min(bin(m).count("1") for m in masks) <= block / 4:
            return masks
    return masks


class Forest:
    """Union-find over the rows of a task."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            new = a != b
            if not new.any():
                return
            i, j, a, b = i[new], j[new], a[new], b[new]
            high, low = np.maximum(a, b), np.minimum(a, b)
            _, one = np.unique(high, return_index=True)  # each root is hung up once a round
            self.edges += zip(i[one].tolist(), j[one].tolist(), strict=True)
            self.root[high[one]] = low[one]
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints of one or more words (``words, rows``): one row of machine words a bit, a spare word at the end."""
    n = -(-fp.shape[1] // 64)
    out = []
    for word in fp:
        bits = np.unpackbits(np.concatenate([word, np.zeros(n * 64 - len(word), np.uint64)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64))
    return np.pad(np.concatenate(out), ((0, 0), (0, 1)))


def _shift(words: np.ndarray, at: np.ndarray, d: int) -> np.ndarray:
    """Bits d places on, at the given words; words past the end are zero."""
    w, s = divmod(d, 64)
    last = words.shape[-1] - 1
    low = words[np.minimum(at + w, last)]
    if not s:
        return low
    return low >> np.uint64(s) | words[np.minimum(at + w + 1, last)] << np.uint64(64 - s)


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, with the least bit first, is over ``radius``."""
    out, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            out |= equal & counters[k]
            equal &= ~counters[k]
    return out


def runs(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the runs, and the number of rows after each row in its run."""
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    sizes = np.diff(np.append(starts, len(run)))
    return starts, sizes, np.repeat(starts + sizes, sizes) - np.arange(len(run)) - 1


class Counters:
    """Carry-save counters of differing bits: lane by lane, 64 lanes a machine word, with the least bit first."""

    def __init__(self, live: np.ndarray, radius: int, *places: np.ndarray):
        self.live, self.radius, self.places = live, radius, list(places)
        self.over = np.zeros_like(live)
        self.count = [np.zeros_like(live) for _ in range(max(1, radius.bit_length()))]

    def run(self, bits: int, differs) -> bool:
        """Add ``differs(b, *places)`` for each bit; words of which every lane exceeds the radius are left. Whether any remain."""
        for b in range(bits):
            carry = differs(b, *self.places)
            for k, c in enumerate(self.count):
                self.count[k], carry = c ^ carry, c & carry
            self.over |= carry
            if b % 8 == 7:
                self.live = self.live & ~(self.over | _exceeds(self.count, self.radius))
                keep = self.live != 0
                if not keep.any():
                    return False
                if np.count_nonzero(keep) < 0.8 * len(keep):
                    self.live, self.over = self.live[keep], self.over[keep]
                    self.count, self.places = [c[keep] for c in self.count], [p[keep] for p in self.places]
        return True

    def lanes(self) -> tuple[np.ndarray, np.ndarray]:
        """Word and lane of what is within the radius."""
        return np.nonzero(np.unpackbits(np.ascontiguousarray(self.live).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def near(fp: np.ndarray, left: np.ndarray, radius: int):
    """Rows ``i, j`` of a run within ``radius``; ``left`` is the number of rows after each in its run, and the caller may set it to zero on the way.

    Rows of runs of up to 64 are compared with the next, the second next and so
    on, all runs at once; of larger runs 256 rows at a time meet all that follow.
    """
    plane, bits = planes(fp), 64 * len(fp)
    end = np.arange(len(left)) + left
    starts = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
    sizes = np.diff(np.append(starts, len(left)))
    small = np.repeat(sizes <= 64, sizes)
    d = 0
    while (valid := small & (left > d)).any():
        d += 1
        lanes = np.packbits(np.append(valid, np.zeros(-len(valid) % 64, bool)), bitorder="little").view(np.uint64)
        at = np.flatnonzero(lanes)
        counters = Counters(lanes[at], radius, at)
        if counters.run(bits, lambda b, at: plane[b][at] ^ _shift(plane[b], at, d)):  # noqa: B023  called at once
            word, bit = counters.lanes()
            i = counters.places[0][word] * 64 + bit
            yield i, i + d
    whole = np.uint64(0xFFFFFFFFFFFFFFFF)
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        for low in range(start, start + size - 1, 256):
            rows = np.arange(low, min(low + 256, start + size - 1))
            rows = rows[left[rows] > 0]
            if not len(rows):
                continue
            own = np.unpackbits(np.ascontiguousarray(fp[:, rows].T).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little").T.astype(bool)
            mask = np.where(own, whole, np.uint64(0))
            words = np.arange(low // 64, (start + size - 1) // 64 + 1)
            row, word = np.repeat(np.arange(len(rows)), len(words)), np.tile(words, len(rows))
            counters = Counters(np.full(len(row), whole), radius, row, word)
            if counters.run(bits, lambda b, row, word: plane[b][word] ^ mask[b][row]):  # noqa: B023  called at once
                at, bit = counters.lanes()
                i, j = rows[counters.places[0][at]], counters.places[1][at] * 64 + bit
                good = (j > i) & (j < start + size)
                if good.any():
                    yield i[good], j[good]


def linked(fp: np.ndarray, run: np.ndarray, radius: int) -> Forest:
    """Links within ``radius`` among rows of equal ``run`` (sorted); ``fp`` is of shape (rows) or (words, rows)."""
    fp = np.atleast_2d(fp)
    forest = Forest(len(run))
    if len(run) < 2:
        return forest
    starts, sizes, left = runs(run)
    for i, j in near(fp, left, radius):
        forest.link(i, j)
        _settle(forest, starts, sizes, left)
    return forest


def _settle(forest: Forest, starts: np.ndarray, sizes: np.ndarray, left: np.ndarray) -> None:
    """Connected runs are done."""
    whole = np.add.reduceat(forest.root == np.arange(len(left)), starts) == 1
    left[np.repeat(whole, sizes)] = 0


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints that connect all fingerprints within ``radius`` of each other.

    ``fps`` has one row a distinct ``fp``. The pairs are a forest in each
    bucket: their components are those of all links, but not every link is listed.
    """
    if not 0 <= radius <= 7:
        raise ValueError("radius must be from 0 to 7")
    masks = scheme(fps.count(), radius, block)
    own = F.array(*(F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("value")) for k, m in enumerate(masks)))
    keyed = fps.select("fp", F.explode(own).alias("k")).select("fp", F.col("fp").alias("word0"), F.xxhash64("k.table", "k.value").alias("bucket"))
    return _compared(keyed, 1, radius, block)


def _forest(rows: np.ndarray, radius: int):
    edges = linked(np.ascontiguousarray(rows[2:]).view(np.uint64), rows[0], radius).edges
    if edges:
        i, j = np.array(edges).T
        yield rows[1][i], rows[1][j]


def _runs(keyed: DataFrame, parts: DataFrame, *names: str) -> DataFrame:
    """``run, fp`` and the named columns: ``parts`` says into how many parts a large ``bucket`` is cut, and every two parts, also a part and itself, make a run."""
    keyed = keyed.join(parts, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int"))
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    met = keyed.select("fp", *names, "bucket", "part", F.explode(other).alias("other"))
    return met.select(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("run"), "fp", *names)


def _compared(keyed: DataFrame, words: int, radius: int, block: int, extra: tuple[str, ...] = (), find=_forest, out: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """What ``find`` makes of rows (``run``, ``fp``, the words of the fingerprint, ``extra``) of equal bucket, as columns ``out``."""
    parts = keyed.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    names = [*(f"word{k}" for k in range(words)), *extra]
    dealt = _runs(keyed, parts, *names).repartition("run").sortWithinPartitions("run", *names)

    def compare(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = np.stack([np.array(c) for c in batch.columns])
                held = now if held is None else np.concatenate([held, now], axis=1)
                if held.shape[1] < PART:
                    continue
                cut = int(np.searchsorted(held[0], held[0, -1]))  # the last run may go on
                if cut == 0:
                    continue
            elif held is None or not held.shape[1]:
                return
            else:
                cut = held.shape[1]
            rows, held = held[:, :cut], held[:, cut:]
            for columns in find(rows, radius):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*out])

    return dealt.mapInArrow(compare, ", ".join(f"{c} long" for c in out))


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Each row's ``doc_id``, ``fp`` and ``component_id``, the smallest ``doc_id`` that links reach from it."""
    prints = materialize(fingerprints(df, doc_id, text, k))
    least = materialize(prints.groupBy("fp").agg(F.min(doc_id).alias("least")))
    return _labelled(prints, least, components(links(least.select("fp"), radius, block)), doc_id)


def sampled_bits(n: int, share: float, bits: int, recall: float, block: int) -> list[np.ndarray]:
    """Bit places of each LSH table: as many bits as keep random buckets small, as many tables as give ``recall`` of pairs whose bits differ with probability ``share``."""
    width = 10
    while n / 2**width > block / 2 and width < 48:
        width += 2
    far = np.arange(bits + 1)
    weight = np.array([math.comb(bits, k) * share**k * (1 - share) ** (bits - k) for k in range(bits + 1)])
    tables = 1
    while (weight * (1 - (1 - (1 - far / bits) ** width) ** tables)).sum() < recall:
        tables += 1
    rng = np.random.default_rng(SEED)
    return [np.sort(rng.choice(bits, width, replace=False)) for _ in range(tables)]


def _share(similarity: float) -> float:
    """Share of bits in which fingerprints of sets of this Jaccard similarity differ: of sets of equal size (others differ less), with ties, which small sets have."""
    return 1.045 * float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def similar(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, recall: float = 0.99, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """Classes of texts linked by a Jaccard similarity of ``similarity`` or more of their distinct shingles: each row's ``doc_id``, ``fp`` and ``component_id``.

    256-bit fingerprints only propose pairs: those within the mean distance at
    ``similarity`` plus three deviations. A proposed pair is linked if the
    sets themselves are similar enough. Texts of equal sets are one
    node. As a group of near copies has many pairs, none is written: a bucket first names its texts
    that are in any proposed pair, and these texts' sets then meet in
    the bucket, where every pair is verified whose ends are not connected yet. A forest of the
    verified links leaves the task, so no link is lost and at most a row a text and bucket is made.

    Proposed pairs share sampled bits: a pair at the very ``similarity`` meets
    with probability ``recall``, closer pairs almost surely, equal sets always. ``row`` names a unique number by which
    ``df`` is bucketed; without one the rows are written so first.
    """
    names = [f"word{j}" for j in range(4)]
    if row is None:
        row = unused(df, "row")
        df = bucketed(df.select(doc_id, text), row)

    def run(batches):
        for batch in bounded(batches, 2):
            made = [sketch(x.as_py(), k) for x in batch.column(2)]
            words = np.array([w for _, w in made]).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([set_hash(own) for own, _ in made], pa.int64()), pa.array([len(own) for own, _ in made], pa.int64()), *(pa.array(np.ascontiguousarray(w)) for w in words)], names=["row", doc_id, "fp", "size", *names])

    fields = [T.StructField("row", T.LongType()), T.StructField(doc_id, df.schema[doc_id].dataType), *(T.StructField(c, T.LongType()) for c in ("fp", "size", *names))]
    texts = df.select(F.col(row).alias("row"), F.col(text).alias("text"))
    prints = materialize(df.select(row, doc_id, text).mapInArrow(run, T.StructType(fields)))
    least = materialize(prints.groupBy("fp", "size", *names).agg(F.min(F.struct(F.col(doc_id).alias("id"), "row")).alias("least")).select("fp", "size", *names, F.col("least.id").alias("least"), "least.row"))
    share = _share(similarity)
    tables = sampled_bits(least.count(), share, 256, recall, block)
    radius = int(256 * share + 3 * math.sqrt(256 * share * (1 - share)))
    dealt = _dealt(least.select("fp", *names, "size"), names, tables).withColumn("own", F.col("bucket"))
    met = materialize(_compared(dealt, 4, radius, block, ("size", "own"), _proposed(similarity), ("fp", "bucket", "size")).distinct())
    return _labelled(prints, least, components(_verified(met, texts, k, least, radius, similarity, block)), doc_id)


def _dealt(rows: DataFrame, names: list[str], tables: list[np.ndarray]) -> DataFrame:
    """A row for each table, with the bucket of its sampled bits."""
    columns = ["fp", *names, "size"]

    def deal(batches):
        for batch in batches:
            words = np.stack([np.array(batch.column(j)) for j in range(1, 5)], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), 32), axis=1, bitorder="little").astype(np.int64)
            for number, places in enumerate(tables):
                value = bits[:, places] @ (1 << np.arange(len(places), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((mix(value.astype(np.uint64)) ^ mix(np.uint64([number + 1]))).view(np.int64))], names=[*columns, "bucket"])

    return rows.select(*columns).mapInArrow(deal, ", ".join(f"{c} long" for c in (*columns, "bucket")))


def _alike(one: np.ndarray, two: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes may be similar enough."""
    return np.minimum(one, two) >= similarity * np.maximum(one, two) - 1e-9


def _proposed(similarity: float):
    """Rows of any pair within the radius whose sizes allow the similarity: fingerprint, bucket, size."""

    def find(rows, radius):
        run, size = rows[0], rows[6]
        if len(run) < 2:
            return
        starts, sizes, left = runs(run)
        met = np.zeros(len(run), bool)
        for i, j in near(np.ascontiguousarray(rows[2:6]).view(np.uint64), left, radius):
            good = _alike(size[i], size[j], similarity)
            met[i[good]] = met[j[good]] = True
            left[np.repeat(np.logical_and.reduceat(met, starts), sizes)] = 0
        if met.any():
            yield rows[1][met], rows[7][met], size[met]

    return find


class Sets:
    """Sets of sorted 32-bit hashes end to end, and the rows of a large run by hash."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, similarity: float):
        self.codes, self.bounds, self.similarity = codes, bounds, similarity
        self.size = np.diff(bounds)
        self.low = self.high = 0

    def _places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' hashes, and which of the rows each belongs to."""
        n = self.size[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.bounds[rows], n), owner

    def _enough(self, shared: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return shared >= self.similarity * (self.size[i] + self.size[j] - shared) - 1e-9

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs are similar enough."""
        one, two = (self._keys(x) for x in (i, j))
        at = np.minimum(np.searchsorted(two, one), max(0, len(two) - 1))
        hit = one[two[at] == one] if len(two) else one[:0]
        return self._enough(np.bincount((hit >> np.uint64(32)).astype(np.int64), minlength=len(i)), i, j)

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        place, owner = self._places(rows)
        return owner.astype(np.uint64) << np.uint64(32) | self.codes[place]

    def lay(self, low: int, high: int) -> None:
        """List the rows from ``low`` to ``high`` by hash."""
        if (self.low, self.high) == (low, high):
            return
        self.low, self.high = low, high
        codes = self.codes[self.bounds[low] : self.bounds[high]]
        order = np.argsort(codes, kind="stable")
        new = np.concatenate([[True], codes[order][1:] != codes[order][:-1]])[: len(codes)]
        self.first = np.append(np.flatnonzero(new), len(codes))
        self.number = np.empty(len(codes), np.int32)
        self.number[order] = np.cumsum(new) - 1
        self.holder = np.repeat(np.arange(high - low, dtype=np.int32), self.size[low:high])[order]

    def row(self, i: int, j: np.ndarray) -> np.ndarray:
        """Which rows of the run laid out last are similar enough to one of them."""
        own = self.number[self.bounds[i] - self.bounds[self.low] : self.bounds[i + 1] - self.bounds[self.low]]
        first, n = self.first[own], self.first[own + 1] - self.first[own]
        place = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        shared = np.bincount(self.holder[place], minlength=self.high - self.low)
        return self._enough(shared[j - self.low], np.full(len(j), i), j)


def similar_links(fp: np.ndarray, run: np.ndarray, sets: Sets, radius: int) -> Forest:
    """A forest of the pairs within ``radius`` whose sets are similar enough; pairs that are connected already are passed over."""
    forest = Forest(len(run))
    if len(run) < 2:
        return forest
    starts, sizes, left = runs(run)

    def apart(i, j):
        keep = forest.root[i] != forest.root[j]
        return i[keep], j[keep]

    for i, j in near(fp, left, radius):
        i, j = apart(i, j)
        good = _alike(sets.size[i], sets.size[j], sets.similarity)
        i, j = i[good], j[good]
        if not len(i):
            continue
        at = int(np.searchsorted(starts, i[0], "right")) - 1
        if sizes[at] <= 64:
            for low in range(0, len(i), RECORDS):
                a, b = apart(i[low : low + RECORDS], j[low : low + RECORDS])
                good = sets.pairs(a, b)
                forest.link(a[good], b[good])
        else:
            sets.lay(int(starts[at]), int(starts[at] + sizes[at]))
            order = np.argsort(i, kind="stable")
            rows, first = np.unique(i[order], return_index=True)
            for row, others in zip(rows.tolist(), np.split(j[order], first[1:]), strict=True):
                a, b = apart(np.full(len(others), row), others)
                if len(b):
                    good = sets.pairs(a, b) if len(b) < 16 else sets.row(row, b)
                    forest.link(a[good], b[good])
        _settle(forest, starts, sizes, left)
    return forest


def _verified(met: DataFrame, texts: DataFrame, k: int, least: DataFrame, radius: int, similarity: float, block: int) -> DataFrame:
    """Forests ``a, b`` of the verified links among the rows ``fp, bucket, size`` of each bucket; a text is read once, and its set goes to each of its buckets."""
    names = [f"word{j}" for j in range(4)]
    asked = met.select("fp").distinct().join(least.select("fp", "row"), "fp")

    def cut(batches):
        for batch in bounded(batches, 1):
            made = [sketch(x.as_py(), k) for x in batch.column(1)]
            words = np.array([w for _, w in made]).T
            own = [(x >> np.uint64(32)).astype(np.uint32).tobytes() for x, _ in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(w)) for w in words), pa.array(own, pa.binary())], names=["fp", *names, "own"])

    def check(batches):
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                if sum(b.num_rows for b in held) < PART and sum(b.nbytes for b in held) < 4 * CODES:
                    continue
            elif not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            run = rows.column("run").to_numpy()
            cut = len(run) if batch is None else int(np.searchsorted(run, run[-1]))  # the last run may go on
            held = rows.slice(cut).to_batches()
            if not cut:
                continue
            own = rows.column("own").chunk(0)
            bounds = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + cut + 1].astype(np.int64) // 4
            codes = np.frombuffer(own.buffers()[2] or b"", np.uint32)
            fp = np.stack([rows.column(c).to_numpy()[:cut] for c in names]).view(np.uint64)
            edges = similar_links(fp, run[:cut], Sets(codes[bounds[0] : bounds[-1]], bounds - bounds[0], similarity), radius).edges
            if edges:
                ids = rows.column("fp").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(side)]) for side in zip(*edges, strict=True)], names=["a", "b"])

    sets = texts.join(asked, "row").select("fp", "text").mapInArrow(cut, ", ".join(["fp long", *(f"{c} long" for c in names), "own binary"]))
    parts = met.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / CODES)).cast("int").alias("parts")).where("parts > 1")
    rows = _runs(met, parts).join(sets, "fp").select("run", "fp", *names, "own")
    with arrow_rows(met.sparkSession, RECORDS):
        return materialize(rows.repartition("run").sortWithinPartitions("run", "fp").mapInArrow(check, "a long, b long").distinct())


def _labelled(prints: DataFrame, least: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """Rows with the smallest ``doc_id`` of their fingerprint's component."""
    labelled = least.select("fp", "least").join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # written before the join, so that a component's rows may be split among tasks there
    labelled = materialize(labelled)
    heads = materialize(labelled.groupBy("component").agg(F.min("least").alias("component_id")))
    of_print = labelled.join(heads, "component").select("fp", "component_id")
    return prints.join(of_print, "fp").select(doc_id, "fp", "component_id")
