"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The ranks of a public byte-level tokenizer; any rank file of the same form will do. The environment may name another.
RANKS = os.environ.get("AXIOMILL_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the published pattern that splits a text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _counter(handle, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, handle.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t)) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["doc", "source", "tokens"])

    return run


def source_name(source: str) -> Column:
    """A source's name trimmed and in lower case, inner blanks as one; null where nothing is left."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(source, r"[\s]+", " "))), F.lit(""))


def token_counts(docs: DataFrame, doc: str, source: str, text: str, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``(doc, source, tokens)`` of every row with text; whole texts are encoded, with no shuffle.

    ``source`` is trimmed and lower-cased. Null and blank texts are left out. The rank file (a fixed vocabulary, under
    1 MB) goes to the workers from the driver, so only the driver needs the path.
    """
    with open(ranks, "rb") as f:
        handle = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc).cast("long").alias("doc"), source_name(source).alias("source"), F.col(text).alias("text"))
    rows = rows.where(F.col("text").rlike(r"\S"))
    return rows.mapInArrow(_counter(handle, pattern), "doc bigint, source string, tokens bigint")
