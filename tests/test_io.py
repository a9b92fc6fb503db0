"""Files, profile store, live streams."""

import numpy as np
import pandas as pd
import pytest

from quietframe.functions.geometry import Parameters, geometry
from quietframe.plans.denoise import process_signal
from quietframe.sources import profiles, wav
from quietframe.streaming.live import LiveStream, denoise_stream


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_round_trip(width):
    x = np.sin(np.arange(1000) / 7) * 0.9
    y, rate, w = wav.decode(wav.encode(x, 8000, width))
    assert (rate, w) == (8000, width) and np.abs(y - x).max() < 2 / 2 ** (8 * width - 1) + 1e-6


def test_wav_files(spark, tmp_path):
    x = np.sin(np.arange(2000) / 9)
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 8000, 2))
    s = wav.read_wav(spark, str(tmp_path))
    assert s.count() == 2000 and wav.blocks(s).count() == 4
    back = wav.wav_bytes(s).first()
    assert back["content"] == (tmp_path / "a.wav").read_bytes()


def test_profile_store(spark):
    store = spark.createDataFrame([], profiles.SCHEMA)
    store = profiles.put(store, "p", 1, [0.01] * 5, 10, 5)
    assert profiles.get(store, "p", 1).first()["block_count"] == 10
    with pytest.raises(ValueError):
        profiles.put(store, "p", 5, [0.0] * 5, 1, 5)
    store = profiles.reset(store, "p")
    assert profiles.get(store, "p", 1).count() == 0 and store.first()["profile"] == [0.0] * 5


@pytest.mark.parametrize("two_d", [False, True])
def test_live_equals_batch(two_d):
    g = geometry(4000, 8, two_d)
    rng = np.random.default_rng(3)
    x = rng.normal(size=900)
    p = Parameters(reduction_amount=12, masking_depth=0.5, suppression_strength=30, smoothing_factor=1)
    live = LiveStream(g, p, 200, two_d)
    got, at = [], 0
    while at < len(x):
        n = int(rng.integers(1, 60))
        got.append(live.process(x[at : at + n]))
        at += n
    assert np.allclose(np.concatenate(got), process_signal(x, g, p, 200, two_d))
    with pytest.raises(ValueError):
        live.process(np.zeros(0))


def test_stream(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=600)
    for i in range(3):
        part = pd.DataFrame({"stream_id": "s", "pos": np.arange(200 * i, 200 * i + 200), "amp": x[200 * i : 200 * i + 200]})
        part.to_parquet(tmp_path / f"{i}.parquet")
    source = spark.readStream.schema("stream_id string, pos long, amp double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    p = Parameters(reduction_amount=12)
    q = denoise_stream(source, 4000, 8, p, 100).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    out = spark.table("live").toPandas().sort_values("pos")
    assert np.allclose(out["value"], process_signal(x, geometry(4000, 8), p, 100))


def test_idle_streams_lose_their_state(spark, tmp_path):
    """After the idle time a stream begins anew; without it, it goes on."""
    import time

    x = np.random.default_rng(5).normal(size=400)
    p, got = Parameters(reduction_amount=12), {}
    for idle in (1, 3_600_000):
        where = tmp_path / str(idle)
        where.mkdir()
        source = spark.readStream.schema("stream_id string, pos long, amp double").parquet(str(where))
        out = denoise_stream(source, 4000, 8, p, 100, idle_ms=idle)
        q = out.writeStream.format("memory").queryName(f"idle{idle}").outputMode("append").trigger(processingTime="100 milliseconds").start()
        for i, at in enumerate((0, 200)):
            pd.DataFrame({"stream_id": "s", "pos": np.arange(at, at + 200), "amp": x[at : at + 200]}).to_parquet(tmp_path / f"{idle}-{i}.parquet")
            (tmp_path / f"{idle}-{i}.parquet").rename(where / f"{i}.parquet")
            until = time.time() + 60
            while spark.table(f"idle{idle}").count() < at + 200 and time.time() < until:
                time.sleep(0.2)
            time.sleep(1)  # runs without data let what has timed out go
        q.stop()
        got[idle] = spark.table(f"idle{idle}").toPandas().sort_values("pos")["value"].to_numpy()
    g = geometry(4000, 8)
    assert np.allclose(got[3_600_000], process_signal(x, g, p, 100))
    assert np.allclose(got[1], np.concatenate([process_signal(x[:200], g, p, 100), process_signal(x[200:], g, p, 100)]))


def test_command_line(spark, tmp_path):
    """Files in, files out: what is learned from is left out, the rest is the chain's."""
    from quietframe import cli

    rng = np.random.default_rng(6)
    (tmp_path / "in").mkdir()
    signals = {"a.wav": rng.normal(size=6000) * 0.2, "b.wav": np.sin(np.arange(5000) / 5) * 0.4 + rng.normal(size=5000) * 0.1}
    for name, x in signals.items():
        (tmp_path / "in" / name).write_bytes(wav.encode(x, 8000, 2))
    cli.main([f"{tmp_path}/in/*.wav", f"{tmp_path}/out", "-n", "3", "-r", "15", "-f", "20", "-l", "0.5", "-d", "0.2"])
    p = Parameters(reduction_amount=15, whitening_factor=50, masking_depth=0.2, aggressiveness=0.5)
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["a.wav", "b.wav"]
    for name, x in signals.items():
        y, rate, width = wav.decode((tmp_path / "out" / name).read_bytes())
        read, _, _ = wav.decode((tmp_path / "in" / name).read_bytes())
        assert (rate, width) == (8000, 2) and np.allclose(y, process_signal(read, geometry(8000, 20), p, 1536)[1536:], atol=1e-4)
    with pytest.raises(SystemExit):
        cli.main([f"{tmp_path}/in/*.wav", f"{tmp_path}/none", "-n", "0"])
