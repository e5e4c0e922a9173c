"""Byte-level BPE encoding and decoding of whole texts (see ``ranks`` for the merging)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from galeframe.llm.ranks import encoder
from galeframe.llm.support import mapped, utf8


def encode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text, in one pass without a shuffle.

    Null and empty texts have no ids, repeated rows stay, other columns are not read;
    the strings of special tokens in a text become those tokens.
    """

    def step(batch: pa.RecordBatch) -> dict:
        ids, counts = encoder(vocabulary).encode(*utf8(batch.column(1)))
        ends = np.append(0, np.cumsum(counts)).astype(np.int32)
        return {id_column: batch.column(0), "ids": pa.ListArray.from_arrays(ends, pa.array(ids.view(np.int32)))}

    kind = docs.schema[id_column].dataType.simpleString()
    return mapped(docs.select(id_column, text_column), step, f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text): the texts of token ids; null ids give an empty text."""

    def step(batch: pa.RecordBatch) -> dict:
        texts = [encoder(vocabulary).decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
        return {id_column: batch.column(0), "text": pa.array(texts, pa.string())}

    kind = encoded.schema[id_column].dataType.simpleString()
    return mapped(encoded.select(id_column, ids_column), step, f"`{id_column}` {kind}, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and decoded.

    The ids stay in the task that made them; only digests leave it.  Null texts count
    as empty ones.
    """

    def step(batch: pa.RecordBatch) -> dict:
        coder = encoder(vocabulary)
        ids, counts = coder.encode(*utf8(batch.column(1)))
        ends = np.cumsum(counts)
        ids_hash, text_hash = [], []
        for a, b in zip((ends - counts).tolist(), ends.tolist()):
            ids_hash.append(hashlib.sha256(ids[a:b]).hexdigest())
            text_hash.append(hashlib.sha256(coder.decode(ids[a:b]).encode()).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": ids_hash, "decoded_sha256": text_hash}

    return mapped(
        docs.select(docs.doc_id.cast("long").alias("doc_id"), "text"),
        step,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
