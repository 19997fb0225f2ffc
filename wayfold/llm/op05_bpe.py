"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Defined cases: a null or empty text has no tokens; special-token strings are
ordinary text; very long texts are encoded whole, piece by piece between safe
boundaries; extra columns pass through ``encode`` and ``decode`` untouched, but for
one that has the new column's name, which gives way; repeated rows and
repeated ids each give their own row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wayfold.llm.common import bounded

RANKS = "byte_bpe_50k.tiktoken"
#: Characters after which a long text is cut at the next safe boundary.
PIECE = 200_000
#: White space after anything else: no match of the pattern spans that place,
#: and no match looks back, so both sides encode as they would in one piece.
_SAFE = re.compile(r"(?<=\S)[ \n]")


@lru_cache(maxsize=2)
def encoding(name: str = RANKS):
    """The tiktoken encoding over a rank file; loaded once a worker."""
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut ``text`` at the first safe boundary after every ``size`` characters."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode_text(text: str | None, name: str = RANKS) -> list[int]:
    if not text:
        return []
    enc = encoding(name)
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text):
        ids += enc.encode_ordinary(piece)
    return ids


def _appended(df: DataFrame, source: str, out: str, kind: T.DataType, arrow: pa.DataType, work) -> DataFrame:
    """``df`` with ``out`` made of ``source``; a column of that name, in any case, gives way, as with ``withColumn``."""
    at = df.columns.index(source)
    is_text = isinstance(df.schema.fields[at].dataType, T.StringType)
    kept = [i for i, c in enumerate(df.columns) if c.lower() != out.lower()]

    def run(batches):
        for batch in bounded(batches, at) if is_text else batches:
            made = pa.array(work(batch.column(at)), arrow)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), made], names=[*(batch.schema.names[i] for i in kept), out])

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(out, kind)]))


def encode(df: DataFrame, text: str = "text", out: str = "token_ids", name: str = RANKS) -> DataFrame:
    """Append the token ids of ``text`` as an array column."""
    return _appended(df, text, out, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), lambda rows: [encode_text(x.as_py(), name) for x in rows])


def decode(df: DataFrame, ids: str = "token_ids", out: str = "decoded", name: str = RANKS) -> DataFrame:
    """Append the bytes that the ids stand for; null ids read as none."""
    return _appended(df, ids, out, T.BinaryType(), pa.binary(), lambda rows: [encoding(name).decode_bytes(x.as_py() or []) for x in rows])


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = RANKS) -> DataFrame:
    """Token count and digests of ids and round trip, without shipping the ids to the JVM."""
    id_type = df.schema[doc_id].dataType

    def run(batches):
        enc = encoding(name)
        said = [str(i) for i in range(enc.n_vocab)].__getitem__
        for batch in bounded(batches, 1):
            n, ids_sha, text_sha = [], [], []
            for x in batch.column(1):
                ids = encode_text(x.as_py(), name)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(said, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[doc_id, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField(doc_id, id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(doc_id, text).mapInArrow(run, schema)
