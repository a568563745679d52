"""Embedders, and the one Arrow function that calls them."""

from __future__ import annotations

import hashlib
import ipaddress
import json
import socket
import urllib.request
from collections.abc import Iterator
from typing import Protocol
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DEFAULTS, Settings

#: The server's default address and path, and how long an answer may take.
SERVER, EMBED_PATH, TIMEOUT_SECONDS = "http://127.0.0.1:11434", "/api/embed", 300


class Embedder(Protocol):
    model: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic vectors of hashed words; needs no model."""

    def __init__(self, dimension: int = 64):
        self.model, self.dimension = f"hash-{dimension}", dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
        return out.tolist()


def stays_here(url: str) -> bool:
    """Whether every address of the URL's host is this machine's own, so that no text leaves it."""
    host = urlsplit(url).hostname
    try:
        found = {a[4][0] for a in socket.getaddrinfo(host, None)} if host else set()
    except OSError:
        return False
    return bool(found) and all(ipaddress.ip_address(a.split("%")[0]).is_loopback for a in found)


class LoopbackEmbedder:
    """A model server on each executor's own host."""

    def __init__(self, model: str, dimension: int, url: str = SERVER):
        if not stays_here(url):
            raise ValueError(f"texts may only be sent to this machine, and {url!r} is not on it")
        self.model, self.dimension, self.url = model, dimension, url.rstrip("/")

    def embed(self, texts: list[str]) -> list[list[float]]:
        asked = urllib.request.Request(self.url + EMBED_PATH, json.dumps({"model": self.model, "input": texts}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(asked, timeout=TIMEOUT_SECONDS) as answer:
            return json.load(answer)["embeddings"]


def as_matrix(vectors: list[list[float]], rows: int, dimension: int) -> np.ndarray:
    """What an embedder has answered, as a matrix; anything but ``dimension`` numbers for each of ``rows`` texts is refused."""
    try:
        matrix = np.asarray(vectors, np.float32).reshape(len(vectors), -1) if rows else np.empty((0, dimension), np.float32)
    except (TypeError, ValueError) as e:
        raise TypeError("the embedder's answer is no table of numbers") from e
    if matrix.shape != (rows, dimension):
        raise ValueError(f"the embedder gave {matrix.shape[0]} vectors of {matrix.shape[1]} numbers for {rows} texts, not of {dimension}")
    return matrix


def embedded(records: DataFrame, embedder: Embedder, s: Settings = DEFAULTS) -> DataFrame:
    """``records`` with embedding (array<float>), in batches of ``s.embed_batch`` prefixed texts."""
    names = records.columns
    prefix, size, dimension = s.document_prefix, s.embed_batch, embedder.dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                matrix = as_matrix(embedder.embed([prefix + (x or "") for x in batch.column("embed_input").to_pylist()]), batch.num_rows, dimension)
                ends = pa.array(np.arange(0, matrix.size + 1, dimension, dtype=np.int32)) if dimension else pa.array(np.zeros(batch.num_rows + 1, np.int32))
                vectors = pa.ListArray.from_arrays(ends, pa.array(matrix.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), vectors], names=[*names, "embedding"])

    return records.mapInArrow(run, T.StructType([*records.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def embedded_query(text: str, embedder: Embedder, s: Settings = DEFAULTS) -> list[float]:
    return as_matrix(embedder.embed([s.query_prefix + text]), 1, embedder.dimension)[0].tolist()


def check_dimension(df: DataFrame, dimension: int) -> DataFrame:
    """``df``, failing where a vector has another size."""
    return df.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector does not have {dimension} numbers")).cast("array<float>")))
