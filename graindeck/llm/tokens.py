"""Sizes of texts in tokens of a public tokenizer, counted in Arrow batches."""
from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[tuple[str, str]] = set()

#: Where the vocabulary lies unless the setting spark.graindeck.vocabulary names another file; executors that lack it get the driver's.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the vocabulary's publishers split a text before merging bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str):
    """The tokenizer of a ranks file; read once in a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def shipped(spark: SparkSession, path: str) -> str:
    """The name under which tasks find a file of the driver's, sent to the executors once per application."""
    context = spark.sparkContext
    if os.path.exists(path) and (context.applicationId, path) not in _SHIPPED:
        context.addFile(path)
        _SHIPPED.add((context.applicationId, path))
    return os.path.basename(path)


def at_worker(path: str, name: str) -> str:
    """The file itself where a worker has it, else the copy that was sent."""
    return path if os.path.exists(path) else SparkFiles.get(name)


def with_token_count(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The ``keep`` columns and n_tokens: tokens of the whole text, 0 for a null or empty one. Special tokens count as text."""
    schema = docs.select(*keep).schema
    vocabulary = vocabulary or docs.sparkSession.conf.get("spark.graindeck.vocabulary", VOCABULARY)
    name = shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(at_worker(vocabulary, name)).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in b.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], n], names=[*keep, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return docs.select(*keep, *([text] if text not in keep else [])).mapInArrow(run, f"{fields}, n_tokens bigint")
