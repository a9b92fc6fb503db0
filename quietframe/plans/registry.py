"""Queries over the harness tables and the SQL that DuckDB checks them with.

``embeddings`` stand in for spectra (64 bins, power is the square of a
component, frames of a label in order of id), ``events`` for signals (samples
of a user in order of time).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import geometry as G
from ..functions import spectra as S
from ..functions.bands import bands
from ..functions.geometry import Parameters
from ..operators import longform as L

BINS = 64
FFT = 126
RATE = 44100
FRAME, HOP = 16, 4
KEYS = ["stream_id", "frame_no", "bin"]
BARK = bands(RATE, FFT, "bark")
OPUS = bands(RATE, FFT, "opus")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_no"), "embedding")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames_of(spark, sf_dir).select("stream_id", "frame_no", F.posexplode("embedding").alias("bin", "e"))
    return e.select("stream_id", "frame_no", F.col("bin").cast("long").alias("bin"), (F.col("e").cast("double") * F.col("e").cast("double")).alias("power"))


def with_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra with a noise column: each stream's mean over its first 10 frames."""
    s = spectra(spark, sf_dir)
    noise = s.where("frame_no < 10").groupBy("stream_id", "bin").agg(F.avg("power").alias("noise"))
    return s.join(noise, ["stream_id", "bin"])


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("value").alias("amp"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded late, so both engines agree on them."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_SPECTRA = """
  ranked AS MATERIALIZED (SELECT label::BIGINT AS stream_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no, embedding FROM embeddings),
  spectra AS (SELECT stream_id, frame_no, b AS bin, embedding[b + 1]::DOUBLE * embedding[b + 1]::DOUBLE AS power FROM ranked, range(64) r(b))"""
_NOISE = (
    _SPECTRA
    + """,
  profile AS (SELECT stream_id, bin, avg(power) AS noise FROM spectra WHERE frame_no < 10 GROUP BY ALL),
  noisy AS (SELECT s.*, p.noise FROM spectra s JOIN profile p USING (stream_id, bin))"""
)
_SIGNAL = """
  signal AS (SELECT user_id::BIGINT AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS amp FROM events),
  lengths AS (SELECT stream_id, count(*) AS n FROM signal GROUP BY ALL),
  members AS (SELECT stream_id, pos // 4 + i AS frame_no, pos - (pos // 4 + i + 1) * 4 + 16 AS k, amp
    FROM signal JOIN lengths USING (stream_id), range(4) r(i) WHERE pos // 4 + i <= n // 4 - 1)"""
_SNR = "10 * (CASE WHEN power > 0 THEN log10(power / (noise + 1e-12)) ELSE -1e3 END)"


def _ramp(db: str, low: float, high: float, a: float, b: float) -> str:
    return f"CASE WHEN {db} <= {low} THEN {a}::DOUBLE WHEN {db} >= {high} THEN {b}::DOUBLE ELSE {a} + ({b} - {a}) * ({db} - {low}) / ({high} - {low}) END"


def _bands_sql(ranges: list[tuple[int, int]]) -> str:
    return "bands(band, lo, hi) AS (VALUES " + ", ".join(f"({j}::BIGINT, {lo}::BIGINT, {hi}::BIGINT)" for j, (lo, hi) in enumerate(ranges)) + ")"


_Q: dict = {}
_S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = f
        if sql is not None:
            _S[name] = sql
        return f

    return add


# Framing, windows, transform


@query("q_framing", f"WITH {_SIGNAL} SELECT stream_id, frame_no, count(*) AS n_samples, round(sum(amp), 6) AS total FROM members GROUP BY ALL")
def q_framing(spark, d):
    m = L.frames(signal(spark, d), FRAME, HOP)
    return rounded(m.groupBy("stream_id", "frame_no").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("amp").alias("total")))


_HANN = "(0.5 - 0.5 * cos(2 * pi() / 16 * k))"


@query("q_ola_identity", f"WITH {_SIGNAL} SELECT stream_id, (frame_no + 1) * 4 + k AS pos, round(sum(amp * {_HANN} * {_HANN} / 1.5), 6) AS value FROM members GROUP BY ALL")
def q_ola_identity(spark, d):
    """Analysis and synthesis windows over the scale: a steady part comes back as it was."""
    w = L.window_value("hann", F.col("k"), FRAME)
    m = L.frames(signal(spark, d), FRAME, HOP).withColumn("value", F.col("amp") * w * w / 1.5)
    return rounded(L.overlap_add(m, FRAME, HOP))


@query(
    "q_windows",
    """SELECT kind, k, round(CASE kind WHEN 'hann' THEN 0.5 - 0.5 * cos(2 * pi() * k / 64) WHEN 'hamming' THEN 0.54 - 0.46 * cos(2 * pi() * k / 64)
       WHEN 'blackman' THEN 0.42 - 0.5 * cos(2 * pi() * k / 64) + 0.08 * cos(4 * pi() * k / 64) ELSE sin(pi() / 2 * pow(sin(pi() * k / 64), 2)) END, 6) + 0.0 AS weight
       FROM (VALUES ('hann'), ('hamming'), ('blackman'), ('vorbis')) v(kind), range(64) r(k)""",
)
def q_windows(spark, d):
    kinds = ["hann", "hamming", "blackman", "vorbis"]
    parts = [spark.range(64).select(F.lit(w).alias("kind"), F.col("id").alias("k"), (F.round(L.sanitize(L.window_value(w, F.col("id"), 64)), 6) + 0.0).alias("weight")) for w in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "q_window_scale",
    "WITH w AS (SELECT k, 0.5 - 0.5 * cos(2 * pi() * k / 882) AS w FROM range(882) r(k)) SELECT round(sum(w * w) / 220, 6) AS scale, round(sum(w * w) * 1682 / 220, 4) AS scale_unnormalised FROM w",
)
def q_window_scale(spark, d):
    """The scale of the library for a frame of 20 ms at 44.1 kHz; without the inverse transform's own, it is as many times larger as that has points."""

    def run(batches):
        g = G.geometry(44100, 20)
        w = S.window(G.Window.HANN, g.frame)
        scale = S.scale_factor(w, w, g)
        for pdf in batches:
            yield pd.DataFrame({"scale": round(scale, 6), "scale_unnormalised": round(scale * g.fft, 4)}, index=pdf.index)

    return spark.range(1).mapInPandas(run, "scale double, scale_unnormalised double")


@query(
    "q_dft_power",
    f"""WITH {_SIGNAL}, parts AS (SELECT stream_id, frame_no, b AS bin, sum(amp * {_HANN} * cos(2 * pi() * b * k / 16)) AS re, sum(-amp * {_HANN} * sin(2 * pi() * b * k / 16)) AS im
        FROM members, range(9) r(b) GROUP BY ALL)
      SELECT stream_id, frame_no, bin, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im, round(re * re + im * im, 3) AS power, round(sqrt(re * re + im * im), 5) AS magnitude,
        CASE WHEN bin IN (0, 8) OR re * re + im * im < 1 THEN 0.0 ELSE round(cos(atan2(im, re)), 4) + 0.0 END AS phase_cos,
        CASE WHEN bin IN (0, 8) OR re * re + im * im < 1 THEN 0.0 ELSE round(sin(atan2(im, re)), 4) + 0.0 END AS phase_sin FROM parts""",
)
def q_dft_power(spark, d):
    """Windowed frames to spectra in one Arrow pass; power, magnitude and phase of each bin."""
    @F.pandas_udf("struct<re:array<double>,im:array<double>>")
    def transform(frames: pd.Series) -> pd.DataFrame:
        z = np.fft.rfft(np.stack(frames.to_numpy()), axis=1) if len(frames) else np.zeros((0, FRAME // 2 + 1), complex)
        return pd.DataFrame({"re": list(z.real), "im": list(z.imag)})

    w = L.window_value("hann", F.col("k"), FRAME)
    m = L.frames(signal(spark, d), FRAME, HOP).withColumn("v", F.col("amp") * w)
    held = m.groupBy("stream_id", "frame_no").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("by_k"))
    samples = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(FRAME - 1).cast("long")), lambda k: F.coalesce(F.try_element_at("by_k", k), F.lit(0.0)))
    z = held.select("stream_id", "frame_no", transform(samples).alias("z"))
    long = z.select("stream_id", "frame_no", F.posexplode(F.arrays_zip("z.re", "z.im")).alias("bin", "c")).select("stream_id", "frame_no", F.col("bin").cast("long").alias("bin"), F.col("c.re").alias("re"), F.col("c.im").alias("im"))
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    phase = lambda f: F.when(F.col("bin").isin(0, FRAME // 2) | (power < 1), F.lit(0.0)).otherwise(F.round(f(F.atan2("im", "re")), 4) + 0.0)
    return long.select("stream_id", "frame_no", "bin", (F.round("re", 5) + 0.0).alias("re"), (F.round("im", 5) + 0.0).alias("im"), F.round(power, 3).alias("power"), F.round(F.hypot("re", "im"), 5).alias("magnitude"), phase(F.cos).alias("phase_cos"), phase(F.sin).alias("phase_sin"))


@query(
    "q_scalars",
    """SELECT x, x + x % 2 AS next_even, CASE WHEN x <= 1 THEN 1 ELSE pow(2, ceil(log2(x)))::BIGINT END AS next_pow2, round(pow(10, -x / 20.0), 8) AS gain, round(1 - exp(-3 * x / 100.0), 8) AS log_like,
       round(x * 44100 / 1682.0, 6) AS bin_hz, floor(x * 100 / (44100 / 1682.0) + 0.5)::BIGINT AS hz_bin FROM range(1, 101) r(x)""",
)
def q_scalars(spark, d):
    """The scalar functions of the library at 1 to 100."""

    def run(batches):
        for pdf in batches:
            x = pdf["id"].tolist()
            g = G.Geometry(44100, 882, 220, 1682)
            yield pd.DataFrame(
                {
                    "x": x,
                    "next_even": [G.next_even(v) for v in x],
                    "next_pow2": [G.next_power_of_two(v) for v in x],
                    "gain": [round(G.db_to_gain(-v), 8) for v in x],
                    "log_like": [round(G.log_like(v / 100), 8) for v in x],
                    "bin_hz": [round(g.bin_to_hz(v), 6) for v in x],
                    "hz_bin": [g.hz_to_bin(v * 100) for v in x],
                }
            )

    return spark.range(1, 101).mapInPandas(run, "x long, next_even long, next_pow2 long, gain double, log_like double, bin_hz double, hz_bin long")


# Aggregates and profiles


@query("q_frame_energy", f"WITH {_SPECTRA} SELECT stream_id, frame_no, round(avg(power), 6) AS energy, avg(power) < 1e-10 AS silent, round(max(power), 6) AS peak, bool_or(power > 0) AS any_positive, round(sum(power), 6) AS checksum FROM spectra GROUP BY ALL")
def q_frame_energy(spark, d):
    g = spectra(spark, d).groupBy("stream_id", "frame_no").agg(F.avg("power").alias("energy"), (F.avg("power") < K.SILENCE).alias("silent"), F.max("power").alias("peak"), F.bool_or(F.col("power") > 0).alias("any_positive"), F.sum("power").alias("checksum"))
    return rounded(g)


_LEARNED = (
    _SPECTRA
    + """,
  counted AS (SELECT *, max(frame_no) OVER (PARTITION BY stream_id) + 1 AS n FROM spectra),
  padded AS (SELECT stream_id, bin, power FROM counted WHERE frame_no >= n - 25
    UNION ALL SELECT DISTINCT stream_id, bin, 0.0 FROM counted, range(25) r(i) WHERE false
    UNION ALL SELECT stream_id, bin, 0.0 FROM (SELECT DISTINCT stream_id, bin, n FROM counted), range(25) r(i) WHERE i < 25 - n),
  medians AS (SELECT stream_id, bin, median(power) AS median FROM padded GROUP BY ALL),
  learned AS (SELECT stream_id, bin, max(n) AS block_count, avg(power) FILTER (WHERE frame_no > 0 OR n = 1) AS mean, greatest(0, max(power)) AS max, least(0, min(power)) AS min FROM counted GROUP BY ALL)"""
)


@query("q_profile_modes", f"WITH {_LEARNED} SELECT stream_id, bin, block_count, round(mean, 6) AS mean, round(median, 6) AS median, round(max, 6) AS max, round(min, 6) AS min, block_count > 5 AS mean_available FROM learned JOIN medians USING (stream_id, bin)")
def q_profile_modes(spark, d):
    return rounded(L.learn_profiles(spectra(spark, d)))


@query(
    "q_profile_store",
    f"""WITH {_LEARNED}, modes AS (SELECT *, unnest([1, 2, 3, 4]) AS mode FROM learned JOIN medians USING (stream_id, bin))
      SELECT stream_id::VARCHAR AS profile_id, mode::INTEGER AS mode, block_count::INTEGER AS block_count, mode <> 1 OR block_count > 5 AS available, bin::INTEGER AS bin,
        round((CASE mode WHEN 1 THEN mean WHEN 2 THEN median WHEN 3 THEN max ELSE min END)::FLOAT::DOUBLE, 4) AS value FROM modes""",
)
def q_profile_store(spark, d):
    """Learned profiles as rows of the store, one value a row."""
    from ..sources import profiles

    rows = profiles.from_learned(L.learn_profiles(spectra(spark, d)))
    long = rows.select("profile_id", "mode", "block_count", "available", F.posexplode("profile").alias("bin", "v"))
    return long.select("profile_id", "mode", "block_count", "available", "bin", F.round(F.col("v").cast("double"), 4).alias("value"))


@query(
    "q_morph",
    f"""WITH {_LEARNED} SELECT stream_id, bin, round(greatest(mean * 0.5 + max * 0.5, min), 6) AS towards_max, round(greatest(mean * 0.5 + median * 0.5, min), 6) AS towards_median
        FROM learned JOIN medians USING (stream_id, bin)""",
)
def q_morph(spark, d):
    p = L.learn_profiles(spectra(spark, d))
    at = lambda a: L.morph(F.col("mean"), F.col("median"), F.col("max"), F.col("min"), a)
    return rounded(p.select("stream_id", "bin", at(0.5).alias("towards_max"), at(-0.5).alias("towards_median")))


@query(
    "q_rolling_median25",
    f"""WITH {_SPECTRA}, padded AS (SELECT stream_id, bin, frame_no, power FROM spectra
        UNION ALL SELECT stream_id, bin, -1 - i, 0.0 FROM (SELECT DISTINCT stream_id, bin FROM spectra), range(24) r(i)),
      m AS (SELECT stream_id, frame_no, bin, median(power) OVER (PARTITION BY stream_id, bin ORDER BY frame_no ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS median FROM padded)
      SELECT stream_id, frame_no, bin, round(median, 6) AS median FROM m WHERE frame_no >= 0""",
)
def q_rolling_median25(spark, d):
    return rounded(spectra(spark, d).select(*KEYS, L.rolling_median("power").alias("median")))


# Smoothing


@query(
    "q_smooth3",
    f"""WITH {_SPECTRA}, n AS (SELECT *, lag(power) OVER w AS a, lead(power) OVER w AS b FROM spectra WINDOW w AS (PARTITION BY stream_id, frame_no ORDER BY bin))
      SELECT stream_id, frame_no, bin, round((coalesce(a, 0) + power + coalesce(b, 0)) / (1 + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT) * 0.5 + power * 0.5, 6) AS smooth FROM n""",
)
def q_smooth3(spark, d):
    return rounded(spectra(spark, d).select(*KEYS, L.smooth3("power", 0.5).alias("smooth")))


@query(
    "q_gapfill",
    f"""WITH {_SPECTRA}, n AS (SELECT *, last_value(CASE WHEN power >= 0.002 OR bin = 0 THEN bin END IGNORE NULLS) OVER w1 AS l, first_value(CASE WHEN power >= 0.002 THEN bin END IGNORE NULLS) OVER w2 AS r FROM spectra
        WINDOW w1 AS (PARTITION BY stream_id, frame_no ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY stream_id, frame_no ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      SELECT n.stream_id, n.frame_no, n.bin, round(CASE WHEN n.power < 0.002 AND n.bin > 0 AND n.bin < 63 AND r IS NOT NULL THEN a.power + (b.power - a.power) * (n.bin - l) / (r - l)::DOUBLE ELSE n.power END, 6) AS filled
      FROM n LEFT JOIN spectra a ON a.stream_id = n.stream_id AND a.frame_no = n.frame_no AND a.bin = l LEFT JOIN spectra b ON b.stream_id = n.stream_id AND b.frame_no = n.frame_no AND b.bin = r""",
)
def q_gapfill(spark, d):
    return rounded(L.fill_gaps(spectra(spark, d), "power", 0.002, BINS).select(*KEYS, "filled"))


@query("q_delay_line", f"WITH {_SPECTRA} SELECT stream_id, frame_no, bin, round(coalesce(lag(power, 4) OVER (PARTITION BY stream_id, bin ORDER BY frame_no), 0), 6) AS delayed FROM spectra")
def q_delay_line(spark, d):
    return rounded(spectra(spark, d).select(*KEYS, L.delayed("power", 4).alias("delayed")))


_MEDIAN51 = (
    _SPECTRA
    + """,
  window51 AS (SELECT s.stream_id, s.frame_no, s.bin, s.power, median(o.power) AS floor FROM spectra s, range(-25, 26) r(i)
    JOIN spectra o ON o.stream_id = s.stream_id AND o.frame_no = s.frame_no AND o.bin = least(greatest(s.bin + i, 0), 63) GROUP BY ALL)"""
)


@query("q_tonal_mask", f"WITH {_MEDIAN51} SELECT stream_id, frame_no, bin, round(floor, 6) AS floor, round(CASE WHEN power - floor >= 1e-7 AND power > 1.41 * greatest(floor, 1e-12) THEN (power - floor) / power ELSE 0 END, 6) AS mask FROM window51")
def q_tonal_mask(spark, d):
    s = L.bin_median(spectra(spark, d), "power", BINS)
    return rounded(s.select(*KEYS, "floor", L.tonal_mask(F.col("power"), F.col("floor")).alias("mask")))


# Bands

_ENERGIES = """energies AS (SELECT stream_id, frame_no, band, sum(power) AS energy, CASE WHEN count(*) <= 1 THEN 1.0
    ELSE least(greatest(10 * (avg(log10(greatest(power, 1e-12))) - log10(avg(greatest(power, 1e-12)))) / -60.0, 0), 1) END AS tonality
    FROM spectra JOIN bands ON bin >= lo AND bin < hi GROUP BY ALL)"""


def _band_query(name: str, ranges: list[tuple[int, int]]):
    @query(name, f"WITH {_SPECTRA}, {_bands_sql(ranges)}, {_ENERGIES} SELECT stream_id, frame_no, band, round(energy, 6) AS energy, round(tonality, 6) AS tonality FROM energies")
    def run(spark, d):
        return rounded(L.band_sums(spectra(spark, d), L.band_dimension(spark, ranges)))


_band_query("q_bands_bark", BARK)
_band_query("q_bands_opus", OPUS)


@query(
    "q_spreading",
    f"""WITH {_SPECTRA}, {_bands_sql(BARK)}, {_ENERGIES},
      leveled AS (SELECT *, least(greatest(15 - (10 * log10(energy + 1e-12) + 96 - 40) * 0.2, 5), 15) AS up FROM energies),
      parts AS (SELECT l.stream_id, l.frame_no, t.band, l.energy * pow(10, (15.81 + (25 - up) / 2 * (t.band - l.band + 0.474) - (25 + up) / 2 * sqrt(1 + pow(t.band - l.band + 0.474, 2))) / 10) AS p FROM leveled l, bands t WHERE t.hi > t.lo)
      SELECT stream_id, frame_no, band, round(pow(sum(pow(p, 0.4)), 2.5), 5) AS spread FROM parts GROUP BY ALL""",
)
def q_spreading(spark, d):
    e = L.band_sums(spectra(spark, d), L.band_dimension(spark, BARK))
    s = L.spread(e)
    held = [j for j, (lo, hi) in enumerate(BARK) if hi > lo]
    return rounded(s.where(F.col("band").isin(held)), 5)


_THRESHOLDS = f"""{_ENERGIES},
  leveled AS (SELECT *, least(greatest(15 - (10 * log10(energy + 1e-12) + 96 - 40) * 0.2, 5), 15) AS up FROM energies),
  parts AS (SELECT l.stream_id, l.frame_no, t.band, l.energy * pow(10, (15.81 + (25 - up) / 2 * (t.band - l.band + 0.474) - (25 + up) / 2 * sqrt(1 + pow(t.band - l.band + 0.474, 2))) / 10) AS p FROM leveled l, bands t WHERE t.hi > t.lo),
  spreads AS (SELECT stream_id, frame_no, band, pow(sum(pow(p, 0.4)), 2.5) AS spread FROM parts GROUP BY ALL),
  thresholds AS (SELECT stream_id, frame_no, band, pow(10, log10(spread + 1e-12) - (tonality * (14.5 + least(band + 1, 25)) + 6 * (1 - tonality)) / 10) AS threshold FROM spreads JOIN energies USING (stream_id, frame_no, band))"""


def _thresholds(spark, d):
    e = L.band_sums(spectra(spark, d), L.band_dimension(spark, BARK))
    return L.band_threshold(L.spread(e), e)


@query("q_band_threshold", f"WITH {_SPECTRA}, {_bands_sql(BARK)}, {_THRESHOLDS} SELECT stream_id, frame_no, band, round(threshold, 5) AS threshold FROM thresholds")
def q_band_threshold(spark, d):
    return rounded(_thresholds(spark, d), 5)


@query(
    "q_forward_masking",
    f"""WITH RECURSIVE {_SPECTRA}, {_bands_sql(BARK)}, {_THRESHOLDS},
      decays AS (SELECT band, exp(-{FFT / (4 * RATE)} / ((1 - least(band, 24) / 24.0) * 0.1 + least(band, 24) / 24.0 * 0.025)) AS decay FROM bands),
      walk AS (SELECT stream_id, band, frame_no, threshold AS t FROM thresholds WHERE frame_no = 0
        UNION ALL SELECT x.stream_id, x.band, x.frame_no, pow(pow(x.threshold, 0.6) + pow(w.t * decay, 0.6), 1 / 0.6) FROM walk w JOIN thresholds x ON x.stream_id = w.stream_id AND x.band = w.band AND x.frame_no = w.frame_no + 1 JOIN decays c ON c.band = x.band)
      SELECT stream_id, frame_no, band, round(t, 4) AS threshold FROM walk""",
)
def q_forward_masking(spark, d):
    return rounded(L.forward_masking(_thresholds(spark, d), FFT / (4 * RATE)), 4)


@query(
    "q_band_smooth",
    f"""WITH {_SPECTRA}, {_bands_sql(BARK)}, {_ENERGIES}, n AS (SELECT *, lag(energy) OVER w AS a, lead(energy) OVER w AS b FROM energies WINDOW w AS (PARTITION BY stream_id, frame_no ORDER BY band))
      SELECT stream_id, frame_no, band, round(CASE WHEN a IS NULL THEN energy ELSE 0.25 * a + 0.5 * energy + 0.25 * coalesce(b, energy) END, 6) AS smooth FROM n""",
)
def q_band_smooth(spark, d):
    e = L.band_sums(spectra(spark, d), L.band_dimension(spark, BARK))
    return rounded(e.select("stream_id", "frame_no", "band", L.smooth_bands("energy", Window.partitionBy("stream_id", "frame_no").orderBy("band")).alias("smooth")))


@query(
    "q_band_interpolation",
    f"""WITH {_SPECTRA}, {_bands_sql(OPUS)}, {_ENERGIES}, c AS (SELECT band, lo + (hi - lo) / 2.0 AS mid FROM bands), last AS (SELECT max(band) AS m FROM bands),
      seat AS (SELECT b AS bin, (SELECT min(band) FROM c WHERE band >= 1 AND mid >= b) AS nxt FROM range(64) r(b)),
      share AS (SELECT bin, x.band AS j, y.band AS k, CASE WHEN y.mid > x.mid THEN least(greatest((bin - x.mid) / (y.mid - x.mid), 0), 1) ELSE 0 END AS t
        FROM seat, last JOIN c x ON x.band = coalesce(nxt - 1, m) JOIN c y ON y.band = coalesce(nxt, m))
      SELECT x.stream_id, x.frame_no, bin, round(coalesce(a.energy, 0) * (1 - t) + coalesce(b.energy, 0) * t, 6) AS energy FROM (SELECT DISTINCT stream_id, frame_no FROM ranked) x, share
      LEFT JOIN energies a ON a.band = j AND a.stream_id = x.stream_id AND a.frame_no = x.frame_no LEFT JOIN energies b ON b.band = k AND b.stream_id = x.stream_id AND b.frame_no = x.frame_no""",
)
def q_band_interpolation(spark, d):
    e = L.band_sums(spectra(spark, d), L.band_dimension(spark, OPUS))
    return rounded(L.interpolate_bands(e.select("stream_id", "frame_no", "band", "energy"), OPUS, BINS, "energy"))


# Over-subtraction and gains

_ALPHA = _ramp(_SNR, -5.0, 20.0, 2.5, 1.0)


@query("q_berouti", f"WITH {_NOISE} SELECT stream_id, frame_no, bin, round({_ALPHA}, 6) AS alpha FROM noisy")
def q_berouti(spark, d):
    return rounded(with_noise(spark, d).select(*KEYS, L.berouti(F.col("power"), F.col("noise"), 0.5).alias("alpha")))


@query("q_global_snr", f"WITH {_NOISE}, s AS (SELECT stream_id, frame_no, sum(power) AS power, sum(noise) AS noise FROM noisy GROUP BY ALL) SELECT stream_id, frame_no, round({_ramp(_SNR, 0.0, 20.0, 4.0, 1.0)}, 6) AS alpha FROM s")
def q_global_snr(spark, d):
    s = with_noise(spark, d).groupBy("stream_id", "frame_no").agg(F.sum("power").alias("x"), F.sum("noise").alias("n"))
    return rounded(s.select("stream_id", "frame_no", L.group_alpha(F.col("x"), F.col("n"), 4.0).alias("alpha")))


@query("q_band_snr", f"WITH {_NOISE}, {_bands_sql(BARK)}, s AS (SELECT stream_id, frame_no, band, sum(power) AS power, sum(noise) AS noise FROM noisy JOIN bands ON bin >= lo AND bin < hi GROUP BY ALL) SELECT stream_id, frame_no, band, round({_ramp(_SNR, 0.0, 20.0, 4.0, 1.0)}, 6) AS alpha FROM s")
def q_band_snr(spark, d):
    s = with_noise(spark, d).join(F.broadcast(L.band_dimension(spark, BARK)), "bin").groupBy("stream_id", "frame_no", "band").agg(F.sum("power").alias("x"), F.sum("noise").alias("n"))
    return rounded(s.select("stream_id", "frame_no", "band", L.group_alpha(F.col("x"), F.col("n"), 4.0).alias("alpha")))


@query("q_masking_alpha", f"WITH {_NOISE} SELECT stream_id, frame_no, bin, round(CASE WHEN noise <= power THEN 1.3 ELSE {_ramp('(10 * log10((noise + 1e-12) / (power + 1e-12)))', 0.0, 20.0, 1.0, 4.0)} END, 6) AS alpha, round({_ramp('(10 * log10((noise + 1e-12) / (power + 1e-12)))', 0.0, 20.0, 0.0, 0.01)}, 8) AS beta FROM noisy")
def q_masking_alpha(spark, d):
    """Noise-to-mask ratio to over- and under-subtraction, power standing in for the mask."""
    s = with_noise(spark, d).withColumn("nmr", 10 * F.log10((F.col("noise") + K.EPSILON) / (F.col("power") + K.EPSILON)))
    return s.select(*KEYS, F.round(L.masking_alpha(F.col("nmr"), 4.0), 6).alias("alpha"), F.round(L.masking_beta(F.col("nmr")), 8).alias("beta"))


_GAINS = f"""alphas AS (SELECT *, {_ALPHA} AS alpha FROM noisy)"""
_WIENER = "CASE WHEN alpha * noise <= 1.17549435e-38 THEN 1.0 WHEN power > alpha * noise THEN (power - alpha * noise) / power ELSE 0.0 END"


def _alphas(spark, d):
    return with_noise(spark, d).withColumn("alpha", L.berouti(F.col("power"), F.col("noise"), 0.5))


@query(
    "q_gains",
    f"""WITH {_NOISE}, {_GAINS} SELECT stream_id, frame_no, bin, round({_WIENER}, 6) AS wiener, CASE WHEN alpha * noise <= 1.17549435e-38 OR power >= alpha * noise THEN 1.0 ELSE 0.0 END AS gate,
        round(CASE WHEN power <= 1.17549435e-38 THEN 1.0 WHEN pow(noise / power, 2) < 1 / (alpha + 0.01) THEN sqrt(greatest(1 - alpha * pow(noise / power, 2), 0)) ELSE sqrt(greatest(0.01 * pow(noise / power, 2), 0)) END, 5) AS subtraction FROM alphas""",
)
def q_gains(spark, d):
    x, n, a = F.col("power"), F.col("noise"), F.col("alpha")
    sub = F.when(x <= K.FLOAT_MIN, F.lit(1.0)).otherwise(L.spectral_subtraction(F.greatest(x, F.lit(K.FLOAT_MIN)), n, a, F.lit(0.01)))
    return _alphas(spark, d).select(*KEYS, F.round(L.wiener(x, n, a), 6).alias("wiener"), L.gate(x, n, a).alias("gate"), F.round(sub, 5).alias("subtraction"))


_WHITE = """smoothed AS (SELECT *, (coalesce(lag(noise) OVER w, 0) + noise + coalesce(lead(noise) OVER w, 0)) / (3 - (lag(noise) OVER w IS NULL)::INT - (lead(noise) OVER w IS NULL)::INT) * 0.5 + noise * 0.5 AS s FROM alphas
    WINDOW w AS (PARTITION BY stream_id, frame_no ORDER BY bin)),
  weighted AS (SELECT *, CASE WHEN s > 1e-12 THEN pow(greatest(list_sort(list(s) OVER (PARTITION BY stream_id, frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))[33], 1e-12) / s, 0.5) ELSE 1 END AS weight FROM smoothed)"""
_RELATIVE = "CASE WHEN noise - 0.015 >= 1e-7 AND noise > 1.41 * 0.015 THEN (noise - 0.015) / noise ELSE 0 END"


@query(
    "q_floor_mix",
    f"""WITH {_NOISE}, {_GAINS}, {_WHITE}, masked AS (SELECT *, {_RELATIVE} AS mask, {_WIENER} AS gain FROM weighted),
      target AS (SELECT *, (0.1 * (1 - pow(mask, 0.25)) + 0.05 * pow(mask, 0.25)) AS path FROM masked),
      floored AS (SELECT *, greatest(least((path + 0.5 * (0.1 - path)) * (1 + (1 - (path + 0.5 * (0.1 - path))) * (weight - 1)), 1), gain) AS g FROM target)
      SELECT stream_id, frame_no, bin, round(weight, 5) AS weight, round(CASE WHEN mask > 0 THEN greatest(alpha, 1 + mask * 0.95 * 9) ELSE alpha END, 5) AS boosted, round(g, 5) AS floored, round(power * g, 5) AS kept, round(power - power * g, 5) AS residual FROM floored""",
)
def q_floor_mix(spark, d):
    """Whitening weights, tonal boost, noise floor and both mixes, against a flat tonal background."""
    s = L.whitening(_alphas(spark, d), "noise", 0.5, BINS)
    s = s.withColumn("mask", L.tonal_mask(F.col("noise"), F.lit(0.015))).withColumn("gain", L.wiener(F.col("power"), F.col("noise"), F.col("alpha")))
    s = s.withColumn("g", L.noise_floor(F.col("gain"), F.col("mask"), F.col("weight"), 0.1, 0.05, 0.5))
    return s.select(*KEYS, F.round("weight", 5).alias("weight"), F.round(L.boost_tonal(F.col("alpha"), F.col("mask"), 0.05), 5).alias("boosted"), F.round("g", 5).alias("floored"), F.round(L.mix(F.col("power"), F.col("g"), False), 5).alias("kept"), F.round(L.mix(F.col("power"), F.col("g"), True), 5).alias("residual"))


@query("q_nlm_snr", f"WITH {_NOISE} SELECT stream_id, frame_no, bin, round(power / greatest(noise, 1e-9), 6) AS snr, round(power / greatest(noise, 1e-9) * greatest(noise, 1e-9), 6) AS reconstructed FROM noisy")
def q_nlm_snr(spark, d):
    n = F.greatest("noise", F.lit(K.NLM_FLOOR))
    return rounded(with_noise(spark, d).select(*KEYS, (F.col("power") / n).alias("snr"), (F.col("power") / n * n).alias("reconstructed")))


@query(
    "q_similar_bins",
    f"""WITH {_SPECTRA}, k AS (SELECT s.*, frame_no + dt AS f2, least(greatest(bin + df, 0), 63) AS b2 FROM spectra s, range(-2, 3) t(dt), range(-2, 3) f(df)),
      j AS (SELECT k.*, o.power AS y, pow(k.power - o.power, 2) / 0.0004 AS d FROM k JOIN spectra o ON o.stream_id = k.stream_id AND o.frame_no = f2 AND o.bin = b2)
      SELECT stream_id, frame_no, bin, round(sum(CASE WHEN d <= 4 THEN exp(-d) ELSE 0 END * y) / sum(CASE WHEN d <= 4 THEN exp(-d) ELSE 0 END), 6) AS smoothed FROM j GROUP BY ALL""",
)
def q_similar_bins(spark, d):
    return rounded(L.similar_bins(spectra(spark, d), 0.02, 2, 2, 2, BINS))


# Recurrences


def _recurrence(init: str, step: str, columns: str = "y") -> str:
    return f"""WITH RECURSIVE {_SPECTRA}, walk AS (
        SELECT stream_id, bin, frame_no, power, {init} FROM spectra WHERE frame_no = 0
        UNION ALL SELECT s.stream_id, s.bin, s.frame_no, s.power, {step} FROM walk w JOIN spectra s ON s.stream_id = w.stream_id AND s.bin = w.bin AND s.frame_no = w.frame_no + 1)
      SELECT stream_id, frame_no, bin, {columns} FROM walk"""


@query("q_ema", _recurrence("0.5 * power AS y", "0.5 * s.power + 0.5 * w.y", "round(y, 6) AS y"))
def q_ema(spark, d):
    f = L.fold(spectra(spark, d), 0.0, lambda m, x, _: (0.5 * x + 0.5 * m,) * 2)
    return f.select(*KEYS, F.round("state", 6).alias("y"))


@query("q_rise_smooth", _recurrence("CASE WHEN power > 0 THEN 0.3 * power ELSE power END AS y", "CASE WHEN s.power > w.y THEN 0.7 * w.y + 0.3 * s.power ELSE s.power END", "round(y, 6) AS y"))
def q_rise_smooth(spark, d):
    f = L.fold(spectra(spark, d), 0.0, lambda m, x, _: (np.where(x > m, 0.7 * m + 0.3 * x, x),) * 2)
    return f.select(*KEYS, F.round("state", 6).alias("y"))


@query(
    "q_transient",
    _recurrence(
        "power AS ema, least(greatest((power / (power + 1e-9) - 1) / 0.25, 0), 1) AS weight",
        """CASE WHEN s.power >= 1e-10 AND s.power / (w.ema2 + 1e-9) > 1 THEN 0.6 * s.power + 0.4 * w.ema2 ELSE 0.2 * s.power + 0.8 * w.ema2 END,
           CASE WHEN s.power < 1e-10 THEN 0.0 ELSE least(greatest((s.power / (w.ema2 + 1e-9) - 1) / 0.25, 0), 1) END""",
        "round(weight, 5) AS weight",
    ).replace("w.ema2", "w.ema"),
)
def q_transient(spark, d):
    """Onset weight of every bin against its slow average (bins standing in for bands)."""

    def step(ema, x, _):
        ema = np.where(np.isnan(ema), x, ema)
        weight = np.where(x < K.ONSET_ENERGY, 0.0, np.clip((x / (ema + 1e-9) - 1) / K.ONSET_SENSITIVITY, 0, 1))
        a = np.where(weight > 0, K.ONSET_SMOOTHING / 2, K.ONSET_SMOOTHING)
        return x * (1 - a) + ema * a, weight

    f = L.fold(spectra(spark, d), float("nan"), step)
    return f.select(*KEYS, F.round("state", 5).alias("weight"))


_XI = f"(1 / (1 + {1 + K.SPP_XI} * exp(-s.power / greatest(w.n, 1e-12) * {K.SPP_XI} / {1 + K.SPP_XI})))"


@query(
    "q_spp",
    _recurrence(
        "power AS n, 0.0::DOUBLE AS q",
        f"""0.8 * w.n + 0.2 * ((1 - CASE WHEN 0.9 * w.q + 0.1 * {_XI} > 0.99 THEN least({_XI}, 0.99) ELSE {_XI} END) * s.power + CASE WHEN 0.9 * w.q + 0.1 * {_XI} > 0.99 THEN least({_XI}, 0.99) ELSE {_XI} END * w.n),
            0.9 * w.q + 0.1 * {_XI}""",
        "round(n, 6) AS noise",
    ),
)
def q_spp(spark, d):
    """Speech-presence noise estimate, the estimator itself (no silent frames in these tables)."""
    from ..operators.estimators import SppMmse

    def run(x):
        e = SppMmse(x.shape[1])
        return np.stack([e.step(f) for f in x])

    return _by_stream(spark, d, run)


def _by_stream(spark, d, make, columns: str = "noise double"):
    """An ordered estimator per stream: frames as arrays, one Arrow task per stream."""
    name = columns.split()[0]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_no")
        x = np.stack(pdf["embedding"].to_numpy()).astype(float) ** 2
        y = make(x)
        return pd.DataFrame({"stream_id": np.repeat(pdf["stream_id"].to_numpy(), y.shape[1]), "frame_no": np.repeat(pdf["frame_no"].to_numpy(), y.shape[1]), "bin": np.tile(np.arange(y.shape[1]), len(y)), name: np.round(y.reshape(-1), 6)})

    return frames_of(spark, d).groupBy("stream_id").applyInPandas(run, f"stream_id long, frame_no long, bin long, {columns}")


@query(
    "q_martin",
    f"""WITH RECURSIVE {_SPECTRA}, walk AS (
        SELECT stream_id, bin, frame_no, power / 1.5 AS p FROM spectra WHERE frame_no = 0
        UNION ALL SELECT s.stream_id, s.bin, s.frame_no, 0.8 * w.p + 0.2 * s.power FROM walk w JOIN spectra s ON s.stream_id = w.stream_id AND s.bin = w.bin AND s.frame_no = w.frame_no + 1),
      low AS (SELECT w.*, (SELECT min(o.p) FROM walk o WHERE o.stream_id = w.stream_id AND o.bin = w.bin AND o.frame_no <= w.frame_no
        AND o.frame_no >= CASE WHEN w.frame_no < 96 THEN 0 ELSE 12 * (w.frame_no // 12 - 8) END) AS m FROM walk w)
      SELECT stream_id, frame_no, bin, round(CASE WHEN frame_no = 0 THEN p * 1.5 ELSE m * 1.5 END, 6) AS noise FROM low""",
)
def q_martin(spark, d):
    from ..operators.estimators import Martin

    def run(x):
        m = Martin(x.shape[1])
        return np.stack([m.step(f) for f in x])

    return _by_stream(spark, d, run)


@query("q_brandt")
def q_brandt(spark, d):
    from ..operators.estimators import Brandt

    def run(x):
        b = Brandt(x.shape[1], RATE, FFT, duration_ms=60)
        return np.stack([b.step(f) for f in x])

    return _by_stream(spark, d, run)


@query("q_adaptive")
def q_adaptive(spark, d):
    """All three methods behind one face: gap-filled and smoothed output, in one pass over the frames."""
    from ..operators.estimators import AdaptiveNoise

    def run(x):
        all_methods = [AdaptiveNoise(method, x.shape[1], RATE, FFT) for method in range(3)]
        return np.stack([np.stack([a.step(f) for a in all_methods]) for f in x]).reshape(len(x), -1)

    both = _by_stream(spark, d, run)
    return both.select("stream_id", "frame_no", (F.col("bin") % BINS).alias("bin"), "noise", F.floor(F.col("bin") / BINS).cast("int").alias("method"))


@query("q_masking")
def q_masking(spark, d):
    from ..operators.psycho import Masking

    def run(x):
        m = Masking(RATE, FFT)
        return np.stack([m.step(f) for f in x])

    return _by_stream(spark, d, run, "threshold double")


@query("q_veto")
def q_veto(spark, d):
    from ..operators.psycho import Veto

    def run(x):
        v, n = Veto(RATE, FFT), x[:10].mean(0)
        return np.stack([v.step(f, n, np.full(len(n), 4.0), 1.0) for f in x])

    return _by_stream(spark, d, run, "alpha double")


@query("q_transient_smoothing")
def q_transient_smoothing(spark, d):
    from ..operators.psycho import TimeSmoother

    def run(x):
        t = TimeSmoother(x.shape[1], BARK)
        return np.stack([t.step(f, 0.7) for f in x])

    return _by_stream(spark, d, run, "smooth double")


@query("q_nlm")
def q_nlm(spark, d):
    """Similarity filter over whole streams: frames before the ring is full pass unchanged."""
    from ..operators.nlm import Nlm

    def run(x):
        f, out = Nlm(x.shape[1], 0.05), []
        for frame in x:
            f.push(frame)
            smooth = f.process()
            out.append(frame if smooth is None else smooth)
        return np.stack(out)

    return _by_stream(spark, d, run, "smoothed double")


@query(
    "q_parameter_history",
    """WITH c AS (SELECT event_id, ts, event_type, value FROM events WHERE event_id % 97 = 0), e AS (SELECT event_id, ts, user_id FROM events)
      SELECT e.event_id, round(c.value, 6) AS reduction FROM e ASOF LEFT JOIN c ON e.ts >= c.ts""",
)
def q_parameter_history(spark, d):
    """Parameters as they stood at each event: the last control row at or before it.

    Controls and events meet by day, each day opened by the last control before
    it, so no window spans the table.
    """
    e = table(spark, d, "events").select("event_id", "ts", "value", F.to_date("ts").alias("day"))
    is_control = F.col("event_id") % 97 == 0
    rows = e.select("day", "ts", "event_id", F.when(is_control, F.col("value")).alias("control"))
    last = rows.where("control is not null").groupBy("day").agg(F.max_by("control", F.struct("ts", "event_id")).alias("closing"))
    days = rows.select("day").distinct().join(last, "day", "left")
    # One row per day of the table.
    carried = days.select("day", F.last("closing", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("opening"))
    within = Window.partitionBy("day").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(F.broadcast(carried), "day").select("event_id", F.round(F.coalesce(F.last("control", ignorenulls=True).over(within), "opening"), 6).alias("reduction"))


# Pipelines


def _denoise(spark, d, two_d: bool):
    from .denoise import denoise

    p = Parameters(reduction_amount=20, whitening_factor=50, masking_depth=0.5, suppression_strength=50, smoothing_factor=1.0 if two_d else 25, tonal_reduction=6)
    return rounded(denoise(signal(spark, d), 4000, 4.0, p, learn_samples=24, two_d=two_d))


@query("q_denoise_1d")
def q_denoise_1d(spark, d):
    return _denoise(spark, d, False)


@query("q_denoise_2d")
def q_denoise_2d(spark, d):
    return _denoise(spark, d, True)


def queries():
    return dict(_Q)


def oracle_sql():
    return dict(_S)


def flagship(spark, sf_dir):
    """The whole 1D chain over the signals."""
    return q_denoise_1d(spark, sf_dir)
