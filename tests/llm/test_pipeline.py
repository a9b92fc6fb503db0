"""The pipeline's stages on a table with every awkward case, each against brute force on its own input."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from quietframe.llm import langid, packing, quality
from quietframe.llm.queries import bpe_files

from .conftest import AWKWARD, prose
from .test_operators import brute_components, brute_repeats

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Documents with nulls, copies, near copies, shared passages, repeated ids, clashing columns, one long text; and labels."""
    rng = random.Random(77)
    texts = [prose(rng, rng.randint(40, 160)) for _ in range(80)]
    passage = prose(rng, 70)
    texts += texts[:6] + [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(6)]
    for t in texts[6:12]:
        w = t.split()
        w[len(w) // 2] = "altered"
        texts.append(" ".join(w))
    junk = [" ".join(w + "!!" for w in prose(rng, 60).upper().split()) for _ in range(30)]
    texts += junk + AWKWARD + [prose(rng, 9000), "£££ 123 ###" * 20]
    rows = [(i, t, "en" if t and i % 2 else ("fr" if i % 7 == 0 else None), "s", len(t or ""), "x", 0.5, "en", i % 3) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s", 1, "x", 0.5, "en", 1), (4, "another text of the same id with words", "en", "s", 1, "x", 0.5, "en", 1), (None, texts[20], "en", "s", 1, "x", 0.5, "en", 1)]
    where = tmp_path_factory.mktemp("sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long, bucket string, score double, lang_pred string, predicted int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{where}/documents.parquet")
    bad = {i for i, t in enumerate(texts) if t in junk}
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(len(texts)) if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


@pytest.fixture(scope="module")
def stages(spark, table):
    """What each stage was given and what it returned."""
    from quietframe.llm.common import staged

    docs, found = spark.read.parquet(f"{table}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, table))
        found.append((name, docs, out))
        docs = out
    return found


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["language_id", "quality", "near_dedup", "suffix_dedup", "packing"]
    assert all(out.columns == list(corpus_pipeline.COLUMNS) for _, _, out in stages[:-1])


def test_language_stage(stages):
    _, docs, out = stages[0]
    train = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = collections.Counter(rows_of(out))
    for row in train:
        if not any(c.isalpha() for c in row[1] or ""):
            assert row not in kept
    # Every prose document stays, as often as it occurs.
    assert all(kept[r] == n for r, n in collections.Counter(train).items() if len(r[1] or "") > 200 and "th" in r[1])


def test_quality_stage(spark, stages, table):
    _, docs, out = stages[1]
    labels = spark.read.parquet(f"{table}/labels.parquet")
    model = quality.train(docs.join(labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), "doc_id"))
    rows = rows_of(docs)
    import pyarrow as pa

    score = quality.score_slices(model, pa.array([t for _, t in rows], pa.string()))
    assert order(rows_of(out)) == order(r for r, s in zip(rows, score, strict=True) if s >= corpus_pipeline.QUALITY_THRESHOLD)
    assert not any("!!" in t and t.isupper() and len(t) > 200 for _, t in rows_of(out))


def test_near_duplicates_stage(stages):
    _, docs, out = stages[2]
    rows = rows_of(docs)
    # Rows of one id stand for one vertex with all their texts.
    assert len({i for i, _ in rows}) < len(rows)
    groups = brute_components([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)
    root = {k: c for k, (_, c) in groups.items()}
    merged = True
    while merged:  # rows of equal id or equal component
        merged = False
        least = {}
        for k, (i, _) in enumerate(rows):
            for key in [("c", root[k])] + ([("i", i)] if i is not None else []):
                least[key] = min(least.get(key, root[k]), root[k])
        for k, (i, _) in enumerate(rows):
            low = min(least["c", root[k]], least.get(("i", i), root[k]))
            merged |= low != root[k]
            root[k] = low
    head = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            head[root[k]] = min(head.get(root[k], i), i)
    assert order(rows_of(out)) == order((i, t) for k, (i, t) in enumerate(rows) if i is None or head[root[k]] == i)


def test_repeats_stage(stages):
    _, docs, out = stages[3]
    rows = [(-1 if i is None else i, t) for i, t in rows_of(docs)]
    once = collections.Counter(i for i, _ in rows)
    expected = {i: kept.decode("utf-8", "ignore") for i, (_, _, _, kept) in brute_repeats(rows).items()}
    found = [(-1 if i is None else i, t) for i, t in rows_of(out)]
    assert {(i, t) for i, t in found if once[i] == 1} == {(i, t) for i, t in expected.items() if t and once[i] == 1}
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_packing_stage(stages):
    _, docs, out = stages[4]
    encoder = packing.UnitTokenizer(**bpe_files())
    expected = collections.Counter((i, len(encoder.whole(t)) + 1) for i, t in rows_of(docs))
    parts = collections.defaultdict(list)
    for r in out.collect():
        parts[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
    for (i, n), times in expected.items():
        cuts = packing.piece_sizes(n, 2048, packing.MAX_LOSS_TOKENS, n // packing.PROMPT_PART)
        starts = [sum(cuts[:k]) for k in range(len(cuts))]
        assert sorted(parts[i, n]) == sorted(list(zip(starts, cuts, strict=True)) * times)
    assert len(parts) == len(expected)


def test_run_is_its_stages(spark, table, stages):
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    a, b = ([tuple(r[k] for k in keys) for r in df.collect()] for df in (corpus_pipeline.run(spark, table), stages[-1][2]))
    assert sorted(a, key=str) == sorted(b, key=str)


def test_empty_table(spark, table, tmp_path):
    spark.read.parquet(f"{table}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{table}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_filter_of_the_stage(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet").select("doc_id", "text", "lang")
    assert set(langid.train(docs).languages) == {"en", "fr"}
