"""The noise profile table: ``(profile_id, mode, block_count, available, profile)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "profile_id string, mode int, block_count int, available boolean, profile array<float>"


def profile_size(bins: int, fft: int, two_d: bool) -> int:
    """Length a profile has to have: 1D counts bins, 2D the whole transform."""
    return fft if two_d else bins


def put(store: DataFrame, profile_id: str, mode: int, values: list[float], block_count: int, size: int) -> DataFrame:
    """Set a mode's profile; a mode outside 1..4 or a wrong length raises ValueError."""
    if not 1 <= mode <= 4 or len(values) != size:
        raise ValueError("unknown mode or wrong profile length")
    row = store.sparkSession.createDataFrame([(profile_id, mode, block_count, True, [float(v) for v in values])], SCHEMA)
    return store.where(~((F.col("profile_id") == profile_id) & (F.col("mode") == mode))).unionByName(row)


def get(store: DataFrame, profile_id: str, mode: int) -> DataFrame:
    """The stored row, or none where the mode is not available."""
    return store.where((F.col("profile_id") == profile_id) & (F.col("mode") == mode) & F.col("mode").between(1, 4) & F.col("available"))


def reset(store: DataFrame, profile_id: str) -> DataFrame:
    """All modes of a profile unavailable, counts and values zero."""
    mine = F.col("profile_id") == profile_id
    return store.select(
        "profile_id",
        "mode",
        F.when(mine, F.lit(0)).otherwise(F.col("block_count")).alias("block_count"),
        F.when(mine, F.lit(False)).otherwise(F.col("available")).alias("available"),
        F.when(mine, F.transform("profile", lambda v: v * 0)).otherwise(F.col("profile")).alias("profile"),
    )


def from_learned(learned: DataFrame) -> DataFrame:
    """Long profiles of ``learn_profiles`` as rows of the store, one for each stream and mode."""
    modes = F.explode(F.array(*(F.struct(F.lit(i).alias("mode"), F.col(c).alias("v"), ok.alias("ok")) for i, c, ok in ((1, "mean", F.col("mean_available")), (2, "median", F.lit(True)), (3, "max", F.lit(True)), (4, "min", F.lit(True))))))
    long = learned.select("stream_id", "bin", "block_count", modes.alias("m"))
    rows = long.groupBy(F.col("stream_id").cast("string").alias("profile_id"), F.col("m.mode").alias("mode"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("bin", F.col("m.v").cast("float").alias("v")))), lambda x: x["v"])
    return rows.agg(F.max("block_count").cast("int").alias("block_count"), F.bool_or("m.ok").alias("available"), values.alias("profile"))
