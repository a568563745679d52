"""Media columns: binary payloads stored as progressive JPEG, read back as payloads, coefficients and RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg
from .common import added, documents, slices, tidy


def padded(text: bytes) -> bytes:
    """``text`` with bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def with_media(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_bytes and media: the padded text as a progressive JPEG. A null text counts as empty."""

    def values(raw: pa.Array) -> list[pa.Array]:
        raws = raw.to_pylist()
        return [pa.array(list(map(len, raws)), pa.int64()), pa.array([jpeg.encode_payload(padded(x)) for x in raws], pa.binary())]

    return added(df, text, {"n_bytes": "long", "media": "binary"}, values)


def rgb_tensors(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with height, width and rgb (binary: height x width x 3 bytes) of each progressive JPEG; null or empty media give nulls."""

    def values(raw: pa.Array) -> list[pa.Array]:
        tensors = [jpeg.rgb(jpeg.decode(x)) if x else None for x in raw.to_pylist()]
        shape = [pa.array([None if t is None else t.shape[k] for t in tensors], pa.int32()) for k in (0, 1)]
        return [*shape, pa.array([None if t is None else t.tobytes() for t in tensors], pa.binary())]

    return added(df, media, {"height": "int", "width": "int", "rgb": "binary"}, values, 1_000_000)


def media_digests(df: DataFrame, media: str = "media") -> DataFrame:
    """doc_id, n_bytes and what is read back from ``media``: the payload's size and digests, the media's, and a feature:
    the tensor's shape and the mean of each colour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, media, 1_000_000):
            columns: list[list] = [[] for _ in range(6)]
            for raw in batch.column(media).to_pylist():
                frame = jpeg.decode(raw)
                payload = jpeg.payload_of(frame)
                tensor = jpeg.rgb(frame)
                mean = tensor.reshape(-1, 3).sum(axis=0, dtype="int64") / (tensor.size // 3)
                feature = f"{tensor.shape[0]}x{tensor.shape[1]}x3 rgb {mean[0]:.2f} {mean[1]:.2f} {mean[2]:.2f}"
                for column, x in zip(columns, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", *_DIGESTS])

    return df.select("doc_id", "n_bytes", media).mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


_DIGESTS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have a payload of 64 zero bytes; repeated rows and null ids give one row each."""
    return media_digests(with_media(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"))
