"""Noise reduction of WAV files: learn from the beginning, then reduce the rest.

    python -m quietframe.cli INPUT OUTPUT_DIR [-r DB] [-w %] [-s %] [-d DEPTH] [-l SHARE] [-a] [-m METHOD] [-f MS] [-n BLOCKS] [--two-d] [--strength %]

The first blocks are what the profile is learned from and are not written; each
output file has its input's name, rate and sample width.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.geometry import Parameters
from .plans.denoise import denoise
from .sources.wav import BLOCK, read_wav, write_wav


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quietframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("input", help="path or glob of mono WAV files of one sample rate")
    p.add_argument("output", help="folder for the WAV files")
    p.add_argument("-r", "--reduction", type=float, default=20.0, help="dB")
    p.add_argument("-w", "--whitening", type=float, default=50.0, help="percent")
    p.add_argument("-s", "--smoothing", type=float, default=0.0, help="percent; with --two-d the filter's h")
    p.add_argument("-d", "--masking-depth", type=float, default=0.5, help="0 to 1")
    p.add_argument("-l", "--steering-response", type=float, default=1.0, help="profile between mean (0) and maximum (1) or median (-1)")
    p.add_argument("-a", "--adaptive", action="store_true")
    p.add_argument("-m", "--noise-method", type=int, default=0, choices=(0, 1, 2))
    p.add_argument("-f", "--frame-size", type=float, default=50.0, help="ms")
    p.add_argument("-n", "--learn-frames", type=int, default=8, help=f"blocks of {BLOCK} samples to learn from")
    p.add_argument("--strength", type=float, default=0.0, help="suppression strength, percent")
    p.add_argument("--two-d", action="store_true")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("quietframe").getOrCreate()
    samples = read_wav(spark, a.input)
    parameters = Parameters(
        reduction_amount=a.reduction, whitening_factor=a.whitening, smoothing_factor=a.smoothing, masking_depth=a.masking_depth, aggressiveness=a.steering_response, adaptive_noise=int(a.adaptive),
        noise_estimation_method=a.noise_method, suppression_strength=a.strength,
    )
    # One rate per run: as many rows as there are different rates.
    rates = [r[0] for r in samples.select("sample_rate").distinct().limit(2).collect()]
    if len(rates) != 1:
        raise SystemExit("files of one sample rate at a time, please")
    if not a.adaptive and a.learn_frames < 1:
        raise SystemExit("without a profile or --adaptive there is nothing to reduce")
    learn = a.learn_frames * BLOCK
    out = denoise(samples, rates[0], a.frame_size, parameters, learn, a.two_d).where(F.col("pos") >= learn)
    meta = samples.groupBy("stream_id").agg(F.first("sample_rate").alias("sample_rate"), F.first("width").alias("width"))
    write_wav(out.join(meta, "stream_id"), a.output, "value")


if __name__ == "__main__":
    main()
