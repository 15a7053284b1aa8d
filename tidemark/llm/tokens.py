"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import OWN

MADE = f"{OWN}made"
#: Where the public vocabularies lie on every executor.
TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"
#: Bytes of text encoded at once; a longer text is encoded alone and whole.
CHUNK = 1 << 21

_ENCODERS: dict = {}


def encoder(path: str):
    """The worker's encoder of a vocabulary, made once a process."""
    from tidemark.llm.bpe import Encoder

    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_array(path: str, texts: pa.Array, want_ids: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids, and the ids end to end, of an Arrow array of texts; null counts as empty."""
    enc = encoder(path)
    texts = texts.cast(pa.string()) if texts.type != pa.string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    _, places, body = texts.buffers()
    if n == 0 or body is None:
        return np.zeros(n, dtype=np.int64), np.zeros(0, dtype=np.int32)
    offsets = np.frombuffer(places, dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8)
    counts, ids, at = [], [], 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        c, i = enc.encode(data, offsets[at : to + 1], want_ids)
        counts.append(c)
        ids.append(i)
        at = to
    return np.concatenate(counts), np.concatenate(ids)


def _mapper(path: str, want_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids = encode_array(path, batch.column(batch.num_columns - 1), want_ids)
            if want_ids:
                offsets = np.zeros(len(counts) + 1, dtype=np.int32)
                np.cumsum(counts, out=offsets[1:])
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            else:
                made = pa.array(counts, type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], MADE])

    return run


def _encoded(df: DataFrame, text: str, keep: list[str], path: str | None, want_ids: bool, name: str) -> DataFrame:
    path = path or f"{TOKENIZERS}/{BYTE_BPE}"
    rows = df.select(*keep, F.col(text).cast("string").alias(f"{OWN}text"))
    kinds = {f.name: f for f in rows.schema.fields}
    made = T.ArrayType(T.IntegerType(), False) if want_ids else T.LongType()
    schema = T.StructType([*[kinds[k] for k in keep], T.StructField(MADE, made)])
    return rows.mapInArrow(_mapper(path, want_ids), schema).withColumnRenamed(MADE, name)


def encode_corpus(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, name: str = "ids") -> DataFrame:
    """The columns ``keep`` and the token ids of ``text``, without special tokens, one row per row.

    Exact for any text: strings of special tokens in it are ordinary text. An empty and a null text give an empty list;
    an empty table gives an empty table; repeated rows are encoded alike. Rows stay in their partitions: nothing is
    shuffled, only two columns are read, and a worker holds about ``CHUNK`` bytes of text at once (a longer text whole).
    """
    return _encoded(df, text, keep, path, True, name)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """As ``encode_corpus``, but only the number of ids: 0 for an empty and for a null text."""
    return _encoded(df, text, keep, path, False, name)
