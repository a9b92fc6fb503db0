"""Operators on long tables, one row per (stream_id, frame_no, bin): native SQL functions, but for ordered folds.

Partitions are always ``stream_id`` with a frame or a bin, so no window ever
spans a stream, let alone the table.  Constants (bands, windows) come in as
literals or as broadcast dimension tables of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as K



def by_frame():
    return Window.partitionBy("stream_id", "frame_no").orderBy("bin")


def by_bin():
    return Window.partitionBy("stream_id", "bin").orderBy("frame_no")


def lit(x: float) -> Column:
    return F.lit(float(x))


def log10_or(x: Column, low: float) -> Column:
    """log10 with a value for what has none."""
    return F.when(x > 0, F.log10(x)).otherwise(lit(low))


# Framing and overlap-add


def frames(signal: DataFrame, frame: int, hop: int) -> DataFrame:
    """Samples ``(stream_id, pos, amp)`` to frame members ``(stream_id, frame_no, k, amp)``.

    Frame n covers positions [(n+1) hop - frame, (n+1) hop) and exists only if
    the stream has that many samples; positions before 0 are not materialised.
    """
    length = F.max("pos").over(Window.partitionBy("stream_id")) + 1
    first = F.floor(F.col("pos") / hop)
    last = F.least(F.floor((F.col("pos") + frame) / hop) - 1, F.floor(F.col("length") / hop) - 1)
    exploded = signal.withColumn("length", length).where(last >= first).withColumn("frame_no", F.explode(F.sequence(first, last)))
    return exploded.select("stream_id", "frame_no", (F.col("pos") - (F.col("frame_no") + 1) * hop + frame).alias("k"), "amp")


def overlap_add(members: DataFrame, frame: int, hop: int) -> DataFrame:
    """Frame members ``(stream_id, frame_no, k, value)`` to delayed output ``(stream_id, pos, value)``."""
    pos = (F.col("frame_no") + 1) * hop + F.col("k")
    return members.groupBy("stream_id", pos.alias("pos")).agg(F.sum("value").alias("value"))


def window_value(kind: str, k: Column, n: int) -> Column:
    """Periodic window at index k of n."""
    p = 2 * math.pi / n * k
    if kind == "hann":
        return 0.5 - 0.5 * F.cos(p)
    if kind == "hamming":
        return 0.54 - 0.46 * F.cos(p)
    if kind == "blackman":
        return 0.42 - 0.5 * F.cos(p) + 0.08 * F.cos(2 * p)
    if kind == "vorbis":
        return F.sin(math.pi / 2 * F.pow(F.sin(p / 2), lit(2)))
    raise ValueError(f"unknown window {kind}")


def sanitize(x: Column) -> Column:
    """Zero for subnormal, infinite and undefined values."""
    return F.when(F.isnan(x) | (F.abs(x) < K.FLOAT_MIN) | (F.abs(x) == float("inf")), lit(0)).otherwise(x)


# Smoothing along bins, frames and bands


def smooth3(x: str, factor: float) -> Column:
    over = by_frame()
    before, after = F.lag(x).over(over), F.lead(x).over(over)
    n = 1 + before.isNotNull().cast("int") + after.isNotNull().cast("int")
    return (F.coalesce(before, lit(0)) + F.col(x) + F.coalesce(after, lit(0))) / n * factor + F.col(x) * (1 - factor)


def smooth_bands(x: str, over: Window) -> Column:
    before, after = F.lag(x).over(over), F.coalesce(F.lead(x).over(over), F.col(x))
    return F.when(before.isNull(), F.col(x)).otherwise(0.25 * before + 0.5 * F.col(x) + 0.25 * after)


def fill_gaps(df: DataFrame, x: str, threshold: float, bins: int, name: str = "filled") -> DataFrame:
    """Straight lines over runs below the threshold; bin 0 anchors, a trailing gap stays."""
    solid = (F.col(x) >= threshold) | (F.col("bin") == 0)
    left = F.last(F.when(solid, F.struct("bin", x)), ignorenulls=True).over(by_frame().rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(F.when(F.col(x) >= threshold, F.struct("bin", x)), ignorenulls=True).over(by_frame().rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_l", left).withColumn("_r", right)
    line = F.col(f"_l.{x}") + (F.col(f"_r.{x}") - F.col(f"_l.{x}")) * (F.col("bin") - F.col("_l.bin")) / (F.col("_r.bin") - F.col("_l.bin"))
    gap = (F.col(x) < threshold) & (F.col("bin") > 0) & (F.col("bin") < bins - 1) & F.col("_r").isNotNull()
    return df.withColumn(name, F.when(gap, line).otherwise(F.col(x))).drop("_l", "_r")


def delayed(x: str, frames_back: int) -> Column:
    """Delay line: the value of an earlier frame, 0 before the start."""
    return F.coalesce(F.lag(x, frames_back).over(by_bin()), lit(0))


def median_of(values: Column, n: int) -> Column:
    """Median of an array of n numbers."""
    s = F.array_sort(values)
    return F.element_at(s, n // 2 + 1) if n % 2 else (F.element_at(s, n // 2) + F.element_at(s, n // 2 + 1)) / 2


def rolling_median(x: str, n: int = K.MEDIAN_FRAMES) -> Column:
    """Median of the last n frames, those before the start counted as 0."""
    seen = F.collect_list(x).over(by_bin().rowsBetween(-(n - 1), 0))
    return median_of(F.concat(seen, F.array_repeat(lit(0), F.lit(n) - F.size(seen))), n)


def bin_median(profile: DataFrame, x: str, bins: int, name: str = "floor", n: int = K.TONAL_WINDOW) -> DataFrame:
    """Running median along bins, the ends repeated."""
    half = n // 2
    seen = F.collect_list(x).over(by_frame().rowsBetween(-half, half))
    first, last = (f(x).over(by_frame().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for f in (F.first, F.last))
    low = F.greatest(F.lit(half) - F.col("bin"), F.lit(0)).cast("int")
    high = F.greatest(F.col("bin") + half - (bins - 1), F.lit(0)).cast("int")
    return profile.withColumn(name, median_of(F.concat(F.array_repeat(first, low), seen, F.array_repeat(last, high)), n))


# Profiles


def learn_profiles(power: DataFrame) -> DataFrame:
    """All modes at once: ``(stream_id, bin, block_count, mean, median, max, min, mean_available)``.

    The mean leaves frame 0 out once there are others; the median is over the
    last 25 frames with zeros for missing ones; the minimum starts at 0.
    """
    later = F.when((F.col("frame_no") > 0) | (F.col("n") == 1), F.col("power"))
    recent = F.when(F.col("frame_no") >= F.col("n") - K.MEDIAN_FRAMES, F.col("power"))
    counted = power.withColumn("n", F.max("frame_no").over(Window.partitionBy("stream_id")) + 1)
    grouped = counted.groupBy("stream_id", "bin").agg(
        F.max("n").alias("block_count"), F.avg(later).alias("mean"), F.collect_list(recent).alias("recent"), F.greatest(lit(0), F.max("power")).alias("max"), F.least(lit(0), F.min("power")).alias("min")
    )
    padded = F.concat("recent", F.array_repeat(lit(0), F.lit(K.MEDIAN_FRAMES) - F.size("recent")))
    return grouped.select("stream_id", "bin", "block_count", "mean", median_of(padded, K.MEDIAN_FRAMES).alias("median"), "max", "min", (F.col("block_count") > K.MEAN_FRAMES_AVAILABLE).alias("mean_available"))


def morph(mean: Column, median: Column, top: Column, low: Column, a: float) -> Column:
    other, share = (median, -a) if a < 0 else (top, a)
    return F.greatest(mean * (1 - share) + other * share, low)


# Over-subtraction and gains


def ramp(db: Column, low: float, high: float, at_low: float, at_high: float) -> Column:
    """Straight line between two levels, flat beyond them."""
    return F.when(db <= low, lit(at_low)).when(db >= high, lit(at_high)).otherwise(at_low + (at_high - at_low) * (db - low) / (high - low))


def snr_db(x: Column, n: Column) -> Column:
    return 10 * log10_or(x / (n + K.EPSILON), -1e3)


def berouti(x: Column, n: Column, strength: float) -> Column:
    return ramp(snr_db(x, n), K.SNR_LOW_DB, K.SNR_HIGH_DB, 1 + (K.ALPHA_MAX - 1) * strength, 1)


def group_alpha(x: Column, n: Column, strength: float) -> Column:
    """From summed power: the strength at 0 dB and below, 1 at 20 dB and above."""
    return ramp(snr_db(x, n), 0, K.SNR_HIGH_DB, strength, 1)


def masking_alpha(nmr_db: Column, strength: float) -> Column:
    """Masked noise gets a tenth of the way to ``strength``; above the mask it rises from 1 to it."""
    return F.when(nmr_db <= 0, lit(1 + (strength - 1) * 0.1)).otherwise(ramp(nmr_db, 0, K.SNR_HIGH_DB, 1, strength))


def masking_beta(nmr_db: Column, beta: float = K.DEFAULT_BETA) -> Column:
    return ramp(nmr_db, 0, K.SNR_HIGH_DB, 0, beta)


def wiener(x: Column, n: Column, alpha: Column) -> Column:
    m = alpha * n
    return F.when(m <= K.FLOAT_MIN, lit(1)).when(x > m, (x - m) / x).otherwise(lit(0))


def gate(x: Column, n: Column, alpha: Column) -> Column:
    m = alpha * n
    return F.when((m <= K.FLOAT_MIN) | (x >= m), lit(1)).otherwise(lit(0))


def spectral_subtraction(x: Column, n: Column, alpha: Column, beta: Column) -> Column:
    r = F.pow(n / x, lit(2))
    loud = F.sqrt(F.greatest(1 - alpha * r, lit(0)))
    return F.when(x <= K.FLOAT_MIN, lit(1)).when(r * (alpha + beta) < 1, loud).otherwise(F.sqrt(F.greatest(beta * r, lit(0))))


def tonal_mask(x: Column, floor: Column) -> Column:
    tone = (x - floor >= K.PEAK_PROMINENCE) & (x > K.PEAK_RATIO * F.greatest(floor, lit(K.EPSILON)))
    return F.when(tone, (x - floor) / x).otherwise(lit(0))


def boost_tonal(alpha: Column, mask: Column, gain: float) -> Column:
    if gain >= 0.999:
        return alpha
    return F.when(mask > 0, F.greatest(alpha, 1 + mask * ((1 - gain) * (K.ALPHA_MAX_TONAL - 1)))).otherwise(alpha)


def whitening(df: DataFrame, x: str, factor: float, bins: int, name: str = "weight") -> DataFrame:
    """Weights towards the upper median of the smoothed profile."""
    df = df.withColumn("_s", smooth3(x, K.PROFILE_SMOOTHING))
    whole = Window.partitionBy("stream_id", "frame_no")
    anchor = F.greatest(F.element_at(F.array_sort(F.collect_list("_s").over(whole)), bins // 2 + 1), lit(K.EPSILON))
    weight = F.when((F.lit(factor) > 0) & (F.col("_s") > K.EPSILON), F.pow(anchor / F.col("_s"), lit(factor))).otherwise(lit(1))
    return df.withColumn(name, weight).drop("_s")


def noise_floor(gain: Column, mask: Column, weight: Column, reduction: float, tonal: float, factor: float) -> Column:
    if reduction >= 0.999 and tonal >= 0.999:
        return lit(1)
    m = F.pow(F.greatest(mask, lit(0)), lit(0.25))
    path = reduction * (1 - m) + tonal * m
    target = path + factor * (reduction - path)
    return F.greatest(F.least(target * (1 + (1 - target) * (weight - 1)), lit(1)), gain)


def mix(value: Column, gain: Column, residual: bool) -> Column:
    return value - value * gain if residual else value * gain


# Bands


def band_dimension(spark, ranges: list[tuple[int, int]]) -> DataFrame:
    """Bin to band, one row per bin: bands are joined by equality, not by range."""
    rows = [(b, j, lo, hi, lo + (hi - lo) / 2) for j, (lo, hi) in enumerate(ranges) for b in range(lo, hi)]
    return spark.createDataFrame(rows, "bin long, band long, lo long, hi long, center double")


def band_sums(power: DataFrame, dimension: DataFrame, x: str = "power") -> DataFrame:
    """Energy and flatness-based tonality of each band of each frame."""
    v = F.greatest(F.col(x), lit(K.EPSILON))
    joined = power.join(F.broadcast(dimension), "bin")
    agg = joined.groupBy("stream_id", "frame_no", "band").agg(F.sum(x).alias("energy"), F.avg(F.log10(v)).alias("_l"), F.avg(v).alias("_v"), F.count(F.lit(1)).alias("n_bins"))
    flat = 10 * (F.col("_l") - F.log10("_v"))
    tonal = F.when(F.col("n_bins") <= 1, lit(1)).otherwise(F.least(F.greatest(flat / K.FLATNESS_DB, lit(0)), lit(1)))
    return agg.select("stream_id", "frame_no", "band", "energy", tonal.alias("tonality"))


def spread(energies: DataFrame) -> DataFrame:
    """Every band's energy spread to all bands of its frame: at most 25 x 25 rows a frame, summed as they are made."""
    e, level = F.col("energy"), 10 * F.log10(F.col("energy") + K.EPSILON) + K.FULL_SCALE_SPL
    up = F.least(F.greatest(K.SLOPE_MAX - (level - K.SLOPE_REFERENCE) * K.SLOPE_FACTOR, lit(K.SLOPE_MIN)), lit(K.SLOPE_MAX))
    n = F.max("band").over(Window.partitionBy("stream_id", "frame_no"))
    to = energies.withColumn("_n", n).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
    y = F.col("to") - F.col("band") + 0.474
    db = 15.81 + (K.SLOPE_DOWN - up) / 2 * y - (K.SLOPE_DOWN + up) / 2 * F.sqrt(1 + y * y)
    part = F.pow(e * F.pow(lit(10), db / 10), lit(K.SPREAD_EXPONENT))
    summed = to.groupBy("stream_id", "frame_no", F.col("to").alias("band")).agg(F.sum(part).alias("s"))
    return summed.select("stream_id", "frame_no", "band", F.pow("s", lit(1 / K.SPREAD_EXPONENT)).alias("spread"))


def band_threshold(spreads: DataFrame, energies: DataFrame) -> DataFrame:
    """Simultaneous masking: spread energy less an offset between that of tones and that of noise."""
    t = F.col("tonality")
    offset = t * (K.TONE_OFFSET + F.least(F.col("band") + 1, F.lit(25))) + K.NOISE_OFFSET * (1 - t)
    joined = spreads.join(energies, ["stream_id", "frame_no", "band"])
    return joined.select("stream_id", "frame_no", "band", F.pow(lit(10), F.log10(F.col("spread") + K.EPSILON) - offset / 10).alias("threshold"))


def forward_masking(thresholds: DataFrame, hop_seconds: float) -> DataFrame:
    """Thresholds with what earlier frames still mask, added by a power law."""
    p = K.TIME_EXPONENT

    def step(state, x, band):
        w = np.minimum(band, 24) / 24
        held = (x**p + (state * np.exp(-hop_seconds / ((1 - w) * K.FORWARD_LOW_S + w * K.FORWARD_HIGH_S))) ** p) ** (1 / p)
        return held, held

    rows = thresholds.select("stream_id", F.col("band").alias("bin"), "frame_no", F.col("threshold").alias("power"))
    return fold(rows, 0.0, step).select("stream_id", "frame_no", F.col("bin").alias("band"), F.col("state").alias("threshold"))


def no_suppression() -> tuple[Column, Column]:
    """Over- and under-subtraction of the strategy that does nothing."""
    return lit(1), lit(0)


def interpolate_bands(frame_bands: DataFrame, ranges: list[tuple[int, int]], bins: int, x: str) -> DataFrame:
    """Values at band centers to bins, straight lines between, flat beyond the outer centers."""
    spark = frame_bands.sparkSession
    c = [lo + (hi - lo) / 2 for lo, hi in ranges]
    rows = []
    for b in range(bins):
        # Up to the first center that the bin does not lie beyond; of bands that share a center the first counts.
        k = next((i for i in range(1, len(c)) if c[i] >= b), len(c) - 1)
        j = k - 1 if len(c) > 1 and c[k] >= b else k
        t = min(max((b - c[j]) / (c[k] - c[j]), 0.0), 1.0) if c[k] > c[j] else 0.0
        rows += [(b, j, 1 - t), (b, k, t)]
    share = spark.createDataFrame(rows, "bin long, band long, share double")
    joined = frame_bands.join(F.broadcast(share), "band")
    return joined.groupBy("stream_id", "frame_no", "bin").agg(F.sum(F.col(x) * F.col("share")).alias(x))


# Ordered folds


def fold(power: DataFrame, start: float, step) -> DataFrame:
    """Recurrence over the frames of each (stream, bin): ``(stream_id, bin, frame_no, state)``.

    ``step(state, x, bin)`` takes arrays, an element for each history, and
    returns the next state and the output; ``start`` is every history's first
    state.  A history is gathered in order; all histories of a batch advance
    together, so the work is linear in frames and no loop runs over bins.
    """
    ordered = power.groupBy("stream_id", "bin").agg(F.array_sort(F.collect_list(F.struct("frame_no", F.col("power").cast("double").alias("power")))).alias("xs"))
    slim = ordered.select("stream_id", F.col("bin").cast("long").alias("bin"), F.col("xs.frame_no").cast("array<long>").alias("frames"), F.col("xs.power").alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, bins = batch.column(3), batch.column(1).to_numpy()
            if not batch.num_rows:
                continue
            x = lists.flatten().to_numpy(zero_copy_only=False)
            cut = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            order = np.argsort(cut[:-1] - cut[1:], kind="stable")  # the longest first
            begin, size, bins = cut[:-1][order], np.diff(cut)[order], bins[order]
            state, out = np.full(len(order), start, float), np.empty(len(x))
            for t in range(int(size[0])):
                n = int(np.searchsorted(-size, -t, side="left"))
                state = state[:n]
                state, out[begin[:n] + t] = step(state, x[begin[:n] + t], bins[:n])
            held = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], held], ["stream_id", "bin", "frames", "state"])

    walked = slim.mapInArrow(run, "stream_id long, bin long, frames array<long>, state array<double>")
    each = walked.select("stream_id", "bin", F.explode(F.arrays_zip("frames", "state")).alias("h"))
    return each.select("stream_id", "bin", F.col("h.frames").alias("frame_no"), F.col("h.state").alias("state"))


def similar_bins(ratio: DataFrame, h: float, past: int, future: int, freq: int, bins: int) -> DataFrame:
    """Small-scale similarity filter: a banded self-join over frames and bins, weighted by single-bin distance.

    A row meets ``(past + future + 1) * (2 * freq + 1)`` others, whatever the stream's length.
    """
    near = F.explode(F.sequence(F.lit(-past), F.lit(future)))
    wide = F.explode(F.sequence(F.lit(-freq), F.lit(freq)))
    keys = ratio.withColumn("dt", near).withColumn("df", wide)
    keys = keys.select("stream_id", "frame_no", "bin", F.col("power").alias("x"), (F.col("frame_no") + F.col("dt")).alias("f2"), F.least(F.greatest(F.col("bin") + F.col("df"), F.lit(0)), F.lit(bins - 1)).alias("b2"))
    other = ratio.select("stream_id", F.col("frame_no").alias("f2"), F.col("bin").alias("b2"), F.col("power").alias("y"))
    joined = keys.join(other, ["stream_id", "f2", "b2"])
    d = F.pow(F.col("x") - F.col("y"), lit(2)) / (h * h)
    w = F.when(d <= K.NLM_DISTANCE, F.exp(-d)).otherwise(lit(0))
    return joined.groupBy("stream_id", "frame_no", "bin").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("smoothed"))
