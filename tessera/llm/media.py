"""Media columns: progressive JPEG stored in a binary column, read back to full-resolution RGB tensors.

``store`` writes each text as a file; ``load`` accumulates the file's scans into coefficient arrays, inverts the
transform, brings chroma to full resolution, and gives the tensor, features and the stored bytes' content.
Both go row by row within a task, without a shuffle; equal texts give equal files and features.

Defined results: null and empty texts are 64 zero bytes; rows that repeat give equal rows; an empty table gives an empty
result; columns named like the results are replaced. Texts are stored whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import jpeg
from tessera.llm.common import read


def _columns(df: DataFrame, drop: tuple[str, ...]) -> tuple[list[str], str]:
    kept = [(c, t) for c, t in df.dtypes if c not in drop]
    return [c for c, _ in kept], "".join(f"`{c}` {t}, " for c, t in kept)


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row without its text, with ``n_bytes`` and ``media`` (the file)."""
    names, schema = _columns(docs, (text, "n_bytes", "media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, media = [], []
            for t in batch.column(text).to_pylist():
                raw = t.encode("utf-8", "surrogatepass") if t else b""
                size.append(len(raw))
                media.append(jpeg.encode(raw + bytes(-len(raw) % 64 or 64 * (not raw))))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(size, pa.int64()), pa.array(media, pa.binary())], [*names, "n_bytes", "media"])

    return docs.mapInArrow(run, schema + "n_bytes bigint, media binary")


def features(x: np.ndarray) -> str:
    """Size, and mean and standard deviation of each channel, from whole-number sums."""
    v = x.reshape(-1, 3)
    n = len(v)
    total = v.sum(axis=0, dtype=np.int64)
    square = np.array([int((c := np.bincount(v[:, i], minlength=256)) @ np.arange(256) ** 2) for i in range(3)])
    mean = total / n
    std = np.sqrt(np.maximum(0, square / n - mean * mean))
    return f"{x.shape[1]}x{x.shape[0]} mean " + ",".join(f"{m:.3f}" for m in mean) + " std " + ",".join(f"{s:.3f}" for s in std)


def load(stored: DataFrame, media: str = "media", tensor: bool = True) -> DataFrame:
    """Every row without its file, with width, height, ``rgb`` (height x width x 3 bytes; null unless ``tensor``),
    ``feature``, the payload's length, SHA-256 and the CRC-32 of its last 64 bytes, and the file's length and SHA-256."""
    new = ("width", "height", "rgb", "feature", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    names, schema = _columns(stored, (media, *new))
    types = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(media).to_pylist():
                im = jpeg.decode(data)
                x = jpeg.rgb(im)
                p = jpeg.payload(im)
                rows.append((im.width, im.height, x.tobytes() if tensor else None, features(x), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest()))
            cols = list(zip(*rows)) or [[]] * len(new)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(c, t) for c, t in zip(cols, types)], [*names, *new])

    return stored.mapInArrow(run, schema + "width int, height int, rgb binary, feature string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string")


def op9_media_columns(spark, sf_dir):
    """All documents stored and read back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return load(store(docs), tensor=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("feature"))
