"""Sample files: WAV files in and out, Parquet sample tables.

Files are read by Spark's ``binaryFile`` source, so any store that Spark
reads will do, and decoded on the executors.  Only mono PCM is accepted.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 512
_SAMPLES = "stream_id string, sample_rate int, width int, pos long, amp float"


def decode(content: bytes) -> tuple[np.ndarray, int, int]:
    """Samples in -1..1, rate and bytes a sample of a mono PCM file; raises ValueError otherwise."""
    with wave.open(io.BytesIO(content)) as f:
        if f.getnchannels() != 1:
            raise ValueError("only mono files are supported")
        width, rate, raw = f.getsampwidth(), f.getframerate(), f.readframes(f.getnframes())
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128, rate, width
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        return ((x ^ 1 << 23) - (1 << 23)).astype(np.float32) / (1 << 23), rate, width
    if width in (2, 4):
        return np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1), rate, width
    raise ValueError(f"samples of {width} bytes are not supported")


def encode(x: np.ndarray, rate: int, width: int) -> bytes:
    """A mono PCM file; samples beyond -1..1 are clipped."""
    top = 2 ** (8 * width - 1)
    v = np.clip(np.round(np.asarray(x, float) * top), -top, top - 1).astype(np.int64)
    if width == 1:
        raw = (v + 128).astype(np.uint8).tobytes()
    else:
        raw = v.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(raw)
    return out.getvalue()


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """``(stream_id, sample_rate, width, pos, amp)`` of all files under a path or glob."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                x, rate, width = decode(content)
                for at in range(0, len(x), 1 << 18):
                    part = x[at : at + (1 << 18)]
                    yield pd.DataFrame({"stream_id": name, "sample_rate": rate, "width": width, "pos": np.arange(at, at + len(part)), "amp": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _SAMPLES)


def blocks(samples: DataFrame, size: int = BLOCK) -> DataFrame:
    """Samples in the chunks that files are read in: ``(stream_id, chunk_no, samples)``."""
    chunk = samples.groupBy("stream_id", F.floor(F.col("pos") / size).alias("chunk_no"))
    return chunk.agg(F.array_sort(F.collect_list(F.struct("pos", "amp"))).alias("s")).select("stream_id", "chunk_no", F.col("s.amp").alias("samples"))


def wav_bytes(samples: DataFrame, value: str = "amp") -> DataFrame:
    """One row per stream, ``(stream_id, content)``: a file of the stream's rate and width."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return pd.DataFrame({"stream_id": [pdf["stream_id"].iloc[0]], "content": [encode(pdf["v"].to_numpy(), int(pdf["sample_rate"].iloc[0]), int(pdf["width"].iloc[0]))]})

    slim = samples.select("stream_id", "sample_rate", "width", "pos", F.col(value).alias("v"))
    return slim.groupBy("stream_id").applyInPandas(run, "stream_id string, content binary")


def write_wav(samples: DataFrame, folder: str, value: str = "amp") -> None:
    """A WAV file per stream in ``folder``, named as the last part of the stream's id.

    Executors write; ``folder`` is a URI of a store that Arrow knows or a path
    that all of them share.  A file is complete or absent: it is written beside
    its place and moved, so a task that runs again gives the same file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(root, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["stream_id"], pdf["content"], strict=True):
                base = name.rstrip("/").rsplit("/", 1)[-1]
                own = f"{root.rstrip('/')}/{base if base.endswith('.wav') else base + '.wav'}"
                beside = f"{own}.{uuid.uuid4().hex}.part"
                with where.open_output_stream(beside) as f:
                    f.write(content)
                where.move(beside, own)
            yield pd.DataFrame({"stream_id": pdf["stream_id"]})

    wav_bytes(samples, value).mapInPandas(run, "stream_id string").write.format("noop").mode("overwrite").save()


def write_samples(samples: DataFrame, path: str) -> None:
    """Parquet sample table, a directory per stream, so a reader of one stream prunes the others."""
    samples.repartition("stream_id").sortWithinPartitions("stream_id", "pos").write.mode("overwrite").partitionBy("stream_id").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
