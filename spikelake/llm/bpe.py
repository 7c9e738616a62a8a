"""Byte-level BPE with tiktoken: encode texts to ids, decode ids to raw bytes.

A null text counts as empty and has no ids; repeated rows are encoded each by itself; ids keep the order of
the text; an empty table gives an empty table; columns besides those named are kept unless they clash, in whatever case,
with the new one, which replaces them. Very long texts are encoded in parts, in time that grows with their length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_small_batches, slices

RANKS = "byte_bpe_50k.tiktoken"
#: Characters that are handed to the tokenizer at a time.
PART = 65_536
#: Where each pattern of this kind of tokenizer ends a match: a non-space before an ASCII space.
SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85\xa0]) ")


@lru_cache(maxsize=4)
def encoding(ranks_path: str | None = None, pattern: str | None = None) -> tiktoken.Encoding:
    """The tokenizer of a local rank file, loaded once in each Python worker."""
    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of `size` characters or more, cut only where no match can go across.

    A match holds white space only at its start, or is white space alone: so one ends before each space that
    follows a non-space, and what stands behind it doesn't change the matches before. Without such a space
    the part goes on.
    """
    start = 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_text(text: str, tokenizer: tiktoken.Encoding) -> np.ndarray:
    """The ids as 32-bit integers, without a Python object for each."""
    return np.concatenate([tokenizer.encode_to_numpy(part, disallowed_special=()) for part in parts(text)]).astype(np.int32)


def _replaced(df: DataFrame, name: str, kind: T.DataType, using: str) -> tuple[DataFrame, T.StructType]:
    df = df.select(*[c for c in df.columns if c.lower() != name.lower() or c == using])
    return df, T.StructType([f for f in df.schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add the token ids of each text, special tokens being ordinary text."""
    docs, schema = _replaced(docs, ids, T.ArrayType(T.IntegerType()), text)
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(ranks_path, pattern)
        for batch in slices(batches, text):
            found = [encode_text(x.as_py() or "", tokenizer) for x in batch.column(text)]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, ids])

    return in_small_batches(docs).mapInArrow(run, schema)


def decode(docs: DataFrame, ids: str = "ids", data: str = "data", ranks_path: str | None = None) -> DataFrame:
    """Add the raw bytes that the ids stand for; null ids give no bytes, an unknown id fails."""
    docs, schema = _replaced(docs, data, T.BinaryType(), ids)
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(ranks_path)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found = [tokenizer.decode_bytes(x.as_py() or []) for x in part.column(ids)]  # one row's ids as a list at a time
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, pa.binary())], names=[*keep, data])

    return in_small_batches(docs).mapInArrow(run, schema)
