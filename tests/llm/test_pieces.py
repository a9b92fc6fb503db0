"""Encoding against the library, over texts that hold what both paths find hard."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietframe.llm import pieces

SIGNS = ["▁", "▁", " ", " ", "  ", "a", "price", "the ", "é", "日本", "\n", "\t", "\x00", "\x1f", "12", ".", "🙂", "word▁", "�"]


@pytest.fixture(scope="module")
def model():
    import public_tokenizers as P

    return pieces.PieceModel(P.path("piece_bpe_32k.model"))


def scanned(model, text, chunk):
    """The parallel scan without Spark."""
    whole = pieces.normal_form(text)
    cuts = [(b, min(b + chunk, len(whole))) for b in range(0, len(whole), chunk)]
    matrices = [model.transfer(whole, b, e, b == 0) for b, e in cuts]
    states = [("", 0), *pieces.path_states(matrices), None]
    out = []
    for i, (b, e) in enumerate(cuts):
        out += model.trace(whole, b, e, states[i], states[i + 1] or (None, 0))
    return out


def test_units_are_the_library(model):
    rng = random.Random(31)
    for _ in range(10_000):
        text = "".join(rng.choices(SIGNS, k=rng.randint(0, 14)))
        assert model.encode(text) == model.sp.encode(text), repr(text)


def test_scan_is_the_library(model):
    rng = random.Random(32)
    for _ in range(400):
        text = "".join(rng.choices(SIGNS, k=rng.randint(1, 14)))
        assert scanned(model, text, rng.choice((1, 3, 7, 20))) == model.sp.encode(text), repr(text)


def test_both_paths_and_rows(spark, model):
    """Nulls, repeated and null ids, clashing names; the size at which the scan begins changes nothing."""
    import public_tokenizers as P

    texts = ["price ▁ 12 and ▁▁ 5 rest", None, "", "x" * 300, "one two  three " * 20, "price ▁ 12 and ▁▁ 5 rest"]
    rows = [(i % 4, t, 1, "b") for i, t in enumerate(texts)] + [(None, "a ▁ b " * 30, 1, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int, row string")
    found = []
    for giant in (10**9, 5):
        out = pieces.encode_documents(docs, P.path("piece_bpe_32k.model"), giant=giant, chunk=16).collect()
        found.append(sorted(((r["id"] is None, r["id"] or 0, r["n_pieces"], bytes(r["ids"]), r["decoded_sha256"], r["round_trip"]) for r in out)))
        assert len(out) == len(rows)
        expected = sorted(np.array(model.sp.encode(t or ""), "<u4").tobytes() for _, t, _, _ in rows)
        assert sorted(bytes(r["ids"]) for r in out) == expected
    assert found[0] == found[1]
    assert pieces.encode_documents(docs.where(F.lit(False)), P.path("piece_bpe_32k.model")).count() == 0
