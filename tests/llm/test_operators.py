"""Each operator against brute force, on copies, ties, nulls, empty and long texts, clashing columns and empty tables."""

import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quietframe.llm import chosenpath, ctw, embdedup, fingerprints, langid, packing, pieces, quality, sharding, suffix
from quietframe.llm.common import connected
from quietframe.llm.queries import bpe_files


def by_id(df, key="id"):
    return {r[key]: r for r in df.collect()}


# Sharding


def test_shards(docs, empty):
    rows = sorted(sharding.shard_by_bytes(docs, 4).collect(), key=lambda r: r["doc_id"])
    texts = by_id(docs, "doc_id")
    before, total = 0, sum(r["size"] for r in rows)
    seen = collections.Counter()
    for r in rows:
        t = texts[r["doc_id"]]["text"]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
        assert r["shard"] == (2 * before + r["size"]) * 4 // (2 * total) and r["slot"] == seen[r["shard"]]
        seen[r["shard"]] += 1
        before += r["size"]
    assert sharding.shard_by_bytes(empty, 4).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(docs, 0)


def test_shards_with_repeated_ids(docs):
    twice = sharding.shard_by_bytes(docs.union(docs), 3).collect()
    for s in range(3):
        slots = sorted(r["slot"] for r in twice if r["shard"] == s)
        assert slots == list(range(len(slots)))


# Language ID


def test_language(spark, empty):
    words = {"en": ["the", "water", "there", "with", "wheel"], "de": ["über", "größe", "schön", "nicht", "straße"], "es": ["niño", "señor", "mañana", "donde", "ciudad"]}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[g], 30)), g) for i, g in enumerate(["en", "de", "es"] * 20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "es"]
    probe = spark.createDataFrame([(1, "the wheel there", None), (2, "GRÖSSE schön", None), (3, "mañana señor", "en"), (4, None, None), (5, "", None), (6, "12 !?", None), (7, "the " * 5000, None)], "doc_id long, text string, lang string")
    out = by_id(langid.predict(probe, model), "doc_id")
    assert [out[i]["lang_pred"] for i in range(1, 8)] == ["en", "de", "es", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[4]["score"] == 0
    none = langid.train(empty)
    assert {r["lang_pred"] for r in langid.predict(probe, none).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.predict(probe.withColumn("score", F.lit(1)), model)


# Embeddings


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows, n = [], 0
    for b in base:
        for _ in range(int(rng.integers(1, 6))):
            rows.append((n, [float(x) for x in b + rng.normal(size=16) * rng.choice([0, 0.05, 0.12])], n % 2))
            n += 1
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] * 16, [1.0, 2.0]]
    rows += [(n + i, v, 0) for i, v in enumerate(bad)] + [(n + 50, rows[0][1], None)]
    out = by_id(embdedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    good = [(i, np.array(v), label) for i, v, label in rows if label is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: {j for j, w, m in good if j != i and label == m and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93} for i, v, label in good}
    for i, _, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (len(links.get(i, ())), min(reach), min(reach) == i)
    assert embdedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_large_vector_group(spark):
    """More near-equal vectors than a counting block."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=8)
    rows = [(i, [float(x) for x in v + rng.normal(size=8) * 0.01], 1) for i in range(embdedup.BLOCK + 300)]
    out = embdedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {(r["n_links"], r["component_id"]) for r in out.collect()} == {(len(rows) - 1, 0)}


def test_pairs_of_a_large_label(spark, monkeypatch):
    """Isolated pairs just above the threshold among many more vectors of a label than a window holds."""
    monkeypatch.setattr(embdedup, "WINDOW", 1)
    rng = np.random.default_rng(21)
    x = rng.normal(size=(20_000, 16))
    u = x[:600] / np.linalg.norm(x[:600], axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    x[600:1200] = 0.931 * u + np.sqrt(1 - 0.931**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    out = by_id(embdedup.near_vectors(spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")))
    missed = sum(out[i]["component_id"] != out[600 + i]["component_id"] for i in range(600))
    assert missed == 0


def test_windows_reach_over_tasks(spark):
    """Pairs whose ends are in different, mostly small, tasks."""
    rng = np.random.default_rng(22)
    v = rng.normal(size=(9, 12))
    small = embdedup.quantised(v / np.linalg.norm(v, axis=1, keepdims=True))
    rows = [(0, 1, 12, i, i, bytearray(small[i % 9])) for i in range(18)]
    dealt = spark.createDataFrame(rows, "pass int, label long, dim int, code long, id long, q binary").repartitionByRange(6, "code").sortWithinPartitions("code")
    links = embdedup._window_links(dealt, 0.95, 9).collect()
    assert {(r["a"], r["b"], r["sure"]) for r in links} == {(i, i + 9, True) for i in range(9)}


def test_pairs_that_rounding_leaves_open(spark):
    """Pairs closer to the threshold than a byte a component can tell, on both sides of it."""
    rng = np.random.default_rng(23)
    rows, expected = [], {}
    for k in range(400):
        u = rng.normal(size=24)
        u /= np.linalg.norm(u)
        w = rng.normal(size=24)
        w -= (w @ u) * u
        cosine = 0.93 + rng.choice((-1, 1)) * 10.0 ** rng.uniform(-9, -2)
        rows += [(2 * k, u, 1), (2 * k + 1, cosine * u + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w), 1)]
        expected[2 * k] = int(cosine >= 0.93)
    out = by_id(embdedup.near_vectors(spark.createDataFrame([(i, v.tolist(), y) for i, v, y in rows], "vec_id long, embedding array<double>, label int")))
    assert {i: out[i]["n_links"] for i in expected} == expected


# Packing


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    files = bpe_files()
    full = Tokenizer.from_file(files["json_path"])
    texts = by_id(docs, "doc_id")
    out = packing.pack(packing.pieces(docs, files, length=64), length=64, max_segments=8).collect()
    seqs, parts = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        ids = np.array([*full.encode(texts[r["id"]]["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["id"]].append((r["start"], r["length"], len(ids)))
    for s in seqs.values():
        at = 0
        assert len(s) <= 8
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    for p in parts.values():
        assert sum(length for _, length, _ in p) == p[0][2]
    assert len(parts) == docs.count() and packing.pack(packing.pieces(empty, files)).count() == 0


def test_packing_limits():
    demand = np.array([[5, 1, 5], [5, 1, 0], [5, 1, 5], [5, 1, 0]])
    bins, _ = packing.dot_product_pack(demand, np.array([10, 2, 5]))
    assert sorted(np.bincount(bins)) == [2, 2] and all(demand[bins == b, 2].sum() <= 5 for b in (0, 1))
    with pytest.raises(ValueError):
        packing.dot_product_pack(np.array([[11, 1, 1]]), np.array([10, 2, 5]))


def test_texts_reach_the_tokenizer_in_small_batches(spark):
    """What a task of ``pack`` is handed at once follows a slice of text, not the split that it reads."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    docs = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("word "), 1000).alias("t"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes]), *(pa.array([x]) for x in (0, 1, 0))], ["id", "row_key", "start", "length", "loss"])

    found = packing.pack(docs.mapInArrow(sizes, "id long, row_key long, start long, length long, loss long")).collect()
    assert sum(r["id"] for r in found) == 3000 and sum(r["row_key"] for r in found) > 15_000_000
    assert max(r["row_key"] for r in found) < 6_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_special_tokens_as_the_library():
    from tokenizers import Tokenizer

    files = bpe_files()
    t = packing.UnitTokenizer(**files)
    full = Tokenizer.from_file(files["json_path"])
    for x in ["a<|endoftext|> b", "  x  y\n z ", "it's  we'll\tdon't", " ", "a \n b", "1 22  333", "", "a\u00a0 b \u3000c \u2028 d", "é à è"]:
        assert t.encode(x).tolist() == full.encode(x, add_special_tokens=False).ids
    import random

    rng = random.Random(17)
    signs = ["a", "The", " ", " ", "  ", "'s", "é", "à", "\u00a0", "\u2009", "\u0085", "\u3000", "\u1680", "\n", "\t", "\x1f", "1", "_", "日", "\u0300", "<|endoftext|>", "😀", "\x7f", "."]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(5000)]
    raw = [x.encode() for x in texts]
    ids, cut = t.encode_slice(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    for i, x in enumerate(texts):
        assert ids[cut[i] : cut[i + 1]].tolist() == [*full.encode(x, add_special_tokens=False).ids, packing.END_ID]


# SentencePiece


def test_pieces(docs, empty):
    import public_tokenizers as P
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = by_id(docs, "doc_id")
    for giant in (10**9, 40):  # with 40 nearly all go through the scan
        out = by_id(pieces.encode_documents(docs, path, giant=giant, chunk=50))
        for i, r in texts.items():
            assert np.frombuffer(out[i]["ids"], "<u4").tolist() == sp.encode(r["text"] or "")
            assert out[i]["round_trip"]
    assert pieces.encode_documents(empty, path).count() == 0


# Fingerprints


def test_fingerprints(docs, empty):
    out = by_id(fingerprints.compare_with_edits(docs))
    texts = {i: r["text"] or "" for i, r in by_id(docs, "doc_id").items()}
    order = sorted(texts, reverse=True)
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        assert out[i]["edited_sha256"] == hashlib.sha256(fingerprints.edited(texts[i], texts[j]).encode()).hexdigest()
        assert out[i]["n_chars"] == len(texts[i]) and 0 <= out[i]["near_edited"] <= 1
    prints = collections.defaultdict(set)
    for i, t in texts.items():
        prints[t].add(out[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in out.values() if 200 < r["n_chars"] < 3000]
    assert np.mean([r["near_edited"] for r in long]) > 0.5 and np.mean([r["near_next"] for r in long]) < 0.2
    assert fingerprints.compare_with_edits(empty).count() == 0
    groups = by_id(fingerprints.near_copies(docs))
    by_text = collections.defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(groups[i]["component"])
    assert all(len(g) == 1 for g in by_text.values())


def test_near_copies_with_a_shared_template(spark):
    """Edited texts that share half of their characters, so that buckets hold many unlike ones."""
    import random

    from .conftest import prose

    rng = random.Random(41)
    template, rows = prose(rng, 50), []
    for family in range(40):
        own = prose(rng, 60)
        for k in range(5):
            w = own.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
            rows.append((5 * family + k, f"{template} {' '.join(w)}"))
    prints = fingerprints.fingerprint_texts([t for _, t in rows])
    near = np.stack([fingerprints.likeness(prints, p) >= 0.8 for p in prints])
    expected = np.arange(len(rows))
    while ((low := np.where(near, expected, len(rows)).min(1)) != expected).any():
        expected = low
    out = by_id(fingerprints.near_copies(spark.createDataFrame(rows, "doc_id long, text string")))
    assert 1 < len(set(expected.tolist())) < len(rows)
    assert {i: r["component"] for i, r in out.items()} == dict(enumerate(expected.tolist()))


def test_following_over_blocks(spark):
    rows = [(i, f"text {i} " * 5) for i in range(4000)]
    out = by_id(fingerprints.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)))
    for i, t in rows:
        assert out[i]["edited_sha256"] == hashlib.sha256(fingerprints.edited(t, rows[i - 1][1]).encode()).hexdigest()


# Repeated passages


def brute_repeats(rows):
    first = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for j in range(len(b) - suffix.LENGTH + 1):
            first.setdefault(b[j : j + suffix.LENGTH], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - suffix.LENGTH + 1):
            if first[b[j : j + suffix.LENGTH]] < i:
                gone[j : j + suffix.LENGTH] = True
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def test_repeats(docs, empty):
    out = by_id(suffix.remove_repeats(docs, carry=("lang",)))
    for i, (n, removed, spans, kept) in brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()]).items():
        assert (out[i]["n_bytes"], out[i]["n_removed"], out[i]["n_spans"], out[i]["kept"]) == (n, removed, spans, kept)
        assert out[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest() and out[i]["lang"]
    assert suffix.remove_repeats(empty).count() == 0


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.endswith(".data")}


def test_repeats_in_more_buckets_leave_no_anchors_on_disk(spark, docs, monkeypatch):
    """Buckets follow the text; anchors are neither staged nor left in shuffle files when the cut begins."""
    assert 6 * 2**30 / suffix.buckets_for(6 * 2**30, 256) <= suffix.BUCKET_BYTES and suffix.buckets_for(0, 256) == 256
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 100)
    monkeypatch.setattr(suffix, "_SLICE", 2000)
    written, staged = [], suffix.staged
    monkeypatch.setattr(suffix, "staged", lambda df: written.append(staged(df)) or written[-1])
    before = shuffle_files(spark)
    cut = suffix.remove_repeats(docs)
    # What counted the text is one file or none; four tasks of anchors would be four, twice.
    assert len(shuffle_files(spark) - before) < 4
    assert len(written) == 1 and written[0].where("kind = 0").count() == 0
    out = by_id(cut)
    for i, (n, removed, spans, kept) in brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()]).items():
        assert (out[i]["n_bytes"], out[i]["n_removed"], out[i]["n_spans"], out[i]["kept"]) == (n, removed, spans, kept)


def test_suffix_sort():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 2000).astype(np.uint8)
    at = rng.permutation(1900)[:500]
    group = np.sort(rng.integers(0, 5, 500))
    order = suffix.suffix_sort(suffix.PrefixHashes(data), at, group, 30)
    keys = [(group[i], data[at[i] : at[i] + 30].tobytes()) for i in order]
    assert keys == sorted(keys)


# Near-duplicates


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sorted(sets) if sets[i]]
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, empty, words):
    out = by_id(chosenpath.near_duplicates(docs, words))
    for i, (n, component) in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], words, 80).items():
        assert (out[i]["n_shingles"], out[i]["component_id"], out[i]["kept"]) == (n, component, i == component)
    assert chosenpath.near_duplicates(empty).count() == 0


def test_large_group_of_near_copies(spark, monkeypatch):
    """More near copies than a block and a node hold; two families, and a text that only one member links."""
    import random

    monkeypatch.setattr(chosenpath, "BLOCK", 40)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    out = by_id(chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80))
    expected = brute_components(rows, 1, 80)
    assert {i: r["component_id"] for i, r in out.items()} == {i: c for i, (_, c) in expected.items()}


def test_node_of_near_copies_ends(spark):
    """A large node of near copies makes fewer rows than it has and none for further branching; what hangs on one of its rows is linked."""
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    rng = np.random.default_rng(4)

    def changed(bits, n):
        out = bits.copy()
        out[rng.choice(180, n, replace=False)] ^= 1
        return out

    base = rng.integers(0, 2, 180).astype(np.uint8)
    rows = [changed(base, 15) for _ in range(2000)]
    rows.append(changed(rows[7], 36))  # near row 7
    rows += [rng.integers(0, 2, 180).astype(np.uint8) for _ in range(20)]
    mixed = [rng.integers(0, 2, 180).astype(np.uint8) for _ in range(100)]
    node = np.repeat([5, 9], [len(rows), len(mixed)])
    marks = [np.packbits(r).tobytes() for r in rows + mixed]
    table = pa.table({"node": pa.array(node), "id": pa.array(np.arange(len(node))), "marks": pa.array(marks, pa.binary()), "path": pa.array([b"p"] * len(node), pa.binary())})
    out = pa.Table.from_batches(chosenpath._node_step(38)(iter(table.to_batches(max_chunksize=300))))
    passed = out.filter(pa.compute.is_valid(out["id"]))
    assert passed["node"].to_pylist() == [9] * 100 and out.num_rows < 100 + len(rows)
    linked = {x for c in "ab" for x in out[c].to_pylist() if x is not None}
    assert linked >= set(range(2001)) and len(linked) == 2001


def test_documents_that_hang_on_a_group(spark):
    """Documents just above the threshold to 100 close copies; drawn so that each of the first ten trees parts them from these."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*base[:i], f"y{i}", *base[i + 1 :]])) for i in range(100)]
    for seed in (5, 177, 291):
        w = list(base)
        for k in np.random.default_rng(seed).choice(400, 42, replace=False):
            w[k] = f"x{k}"
        rows.append((1000 + seed, " ".join(w)))
    out = by_id(chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80))
    assert {i: r["component_id"] for i, r in out.items()} == {i: c for i, (_, c) in brute_components(rows, 1, 80).items()}
    assert {r["component_id"] for r in out.values()} == {0}


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000)]
    out = {r["v"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert out == {v: c for v, c in root.items() if v != 5000}


# Language model


def test_scores(docs, empty):
    held = F.pmod("doc_id", F.lit(4)) == 0
    out = by_id(ctw.score_texts(docs, held))
    rows = docs.collect()
    tokens = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b"\n"] for r in rows}
    c = collections.Counter(w for i, t in tokens.items() if i % 4 for w in t)
    n, v = sum(c.values()), len(c)
    by_text = collections.defaultdict(set)
    for r in rows:
        i, t = r["doc_id"], tokens[r["doc_id"]]
        o = out[i]
        assert (o["held_out"], o["n_tokens"], o["n_known"], o["train_tokens"]) == (i % 4 == 0, len(t), sum(c[w] > 0 for w in t), n)
        assert o["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), abs=1e-6)
        assert np.isfinite(o["score"]) and o["score"] < 0
        by_text[r["text"]].add(round(o["score"], 9))
    assert all(len(s) == 1 for s in by_text.values())
    assert ctw.score_texts(empty, held).count() == 0


def spelled_out(text):
    """(context, byte) of a text's stream, contexts with their last byte first."""
    words = (text or "").encode().lower().split()
    stream = b" ".join(words) + b"\n"
    padded = b"\n" * ctw.DEPTH + stream
    return [(padded[i : i + ctw.DEPTH][::-1], padded[i + ctw.DEPTH]) for i in range(len(stream))]


def brute_tree(rows):
    """Context-tree weighting as it is defined, node by node: log10 chance of a byte after a context."""
    import functools
    import math

    zero, one = collections.Counter(), collections.Counter()
    for text in rows:
        for context, byte in spelled_out(text):
            for level in range(8):
                decision = (1 << level) | (byte >> (8 - level))
                for d in range(ctw.DEPTH + 1):
                    (one if byte >> (7 - level) & 1 else zero)[context[:d], decision] += 1
    children = collections.defaultdict(set)
    for context, decision in {*zero, *one}:
        if context:
            children[context[:-1], decision].add(context)

    def own(node):
        a, b = zero[node], one[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.cache
    def mixed(node):
        if len(node[0]) == ctw.DEPTH:
            return own(node)
        under = sum(mixed((c, node[1])) for c in children[node])
        return np.logaddexp(own(node), under) - math.log(2)

    def chance(context, decision):
        done, rest, estimate = 0.0, 1.0, 0.5
        for d in range(ctw.DEPTH + 1):
            node = (context[:d], decision)
            if zero[node] + one[node] == 0:
                break
            weight = 1.0 if d == ctw.DEPTH else math.exp(own(node) - math.log(2) - mixed(node))
            estimate = (one[node] + 0.5) / (zero[node] + one[node] + 1)
            done, rest = done + rest * weight * estimate, rest * (1 - weight)
        return done + rest * estimate

    def log(context, byte):
        total = 0.0
        for level in range(8):
            p = chance(context, (1 << level) | (byte >> (8 - level)))
            total += math.log10(p if byte >> (7 - level) & 1 else 1 - p)
        return total

    return log


def test_scores_are_those_of_the_whole_tree(spark, texts):
    rows = [(i, t) for i, t in enumerate([*texts[:40], *texts[-26:], None, "one\n", "one"])]
    log = brute_tree([t for i, t in rows if i % 4])
    out = by_id(ctw.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.pmod("doc_id", F.lit(4)) == 0))
    for i, t in rows:
        if len(t or "") < 3000:
            assert out[i]["score"] == pytest.approx(sum(log(c, b) for c, b in spelled_out(t)), rel=1e-6, abs=1e-5)  # chances travel in steps of 3.4e-6


def test_long_text_over_slices(monkeypatch):
    """Transitions near the beginnings of texts and over slices are those of each text alone."""
    texts = ["a bc", "", "d", "x " * 40, "", "", "longer words here", "é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    stream = ctw.stream_of(data, offsets)
    expected = [int.from_bytes(c + bytes([b]), "big") for t in texts for c, b in spelled_out(t)]
    for size in (1 << 20, 1, 3, 7):
        monkeypatch.setattr(ctw, "_AT_ONCE", size)
        assert np.concatenate([k for _, k in ctw.transition_slices(stream, ctw.doc_starts(stream))]).tolist() == expected


def test_outcomes_sum_to_one(texts):
    """What may follow any context, the end among it, has a chance of 1 in all."""
    counts = collections.Counter(int.from_bytes(c + bytes([b]), "big") for t in texts[:50] for c, b in spelled_out(t))
    tree = ctw.compile_tree(np.array(list(counts), np.uint64), np.array(list(counts.values())))
    contexts = [k >> 8 for k in list(counts)[:12]] + [0x0A0A0A0A0A0A, 0x206565656565, 0x7A7A7A7A7A7A, 0]
    for context in contexts:
        every = np.array([(context << 8) | b for b in range(256)], np.uint64)
        assert (10 ** ctw.transition_logs(tree, every)).sum() == pytest.approx(1, abs=1e-5)
    after = np.array([(contexts[0] << 8) | b for b in (ctw.END, ctw.BLANK)], np.uint64)
    assert (10 ** ctw.transition_logs(tree, after) < 1).all()


def test_scoring_holds_a_slice_and_adds_up_exactly(monkeypatch):
    """Memory beside the stream is that of a slice; a text scores the same wherever slices cut it."""
    import tracemalloc

    monkeypatch.setattr(ctw, "_AT_ONCE", 1 << 16)
    rng = np.random.default_rng(6)
    text = rng.integers(97, 100, 100_000).astype(np.uint8)
    text[-1] = ctw.END
    stream = np.tile(text, 40)
    starts = ctw.doc_starts(stream)
    distinct = np.unique(np.concatenate([keys for _, keys in ctw.transition_slices(text, starts[:1])]))
    steps = rng.integers(0, 1 << 24, len(distinct)).astype(np.uint32)
    tracemalloc.start()
    scores = ctw.stream_scores(stream, starts, distinct, steps)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(starts) == 40 and len(set(scores)) == 1 and peak < 4 * len(stream)
    each = next(keys for _, keys in ctw.transition_slices(text[-1000:], starts[:1]))
    alone = ctw.stream_scores(text[-1000:], starts[:1], np.unique(each), np.arange(len(np.unique(each)), dtype=np.uint32))
    assert alone[0] == pytest.approx(-ctw._STEP * np.searchsorted(np.unique(each), each).sum())


def test_words_that_share_a_bucket(spark):
    """Many distinct words, few partitions: counts of all of them are exact."""
    words = [f"w{i}" for i in range(5000)]
    rows = [(i, " ".join(words[i:] + words[: i % 7])) for i in range(0, 5000, 500)]
    out = by_id(ctw.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 0))
    c = collections.Counter(w for i, t in rows if i for w in [*t.split(), None])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        assert out[i]["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*t.split(), None]), rel=1e-9)


def test_log_gamma():
    import math

    x = np.array([0.5, 1, 1.5, 7.25, 100, 1e6])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x])


# Quality


def test_quality(spark, docs, empty):
    import random

    from .conftest import prose

    rng = random.Random(6)
    rows = [(i, prose(rng, 80) if i % 2 else " ".join(w + "!!" for w in prose(rng, 80).upper().split()), i % 2) for i in range(120)]
    data = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(data.where("doc_id < 80"))
    out = by_id(quality.predict(data, model), "doc_id")
    assert np.mean([out[i]["predicted"] == y for i, _, y in rows if i >= 80]) > 0.9
    scored = quality.predict(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in scored)
    assert quality.predict(empty, model).count() == 0
    flat = quality.train(data.where("quality = 1"))
    assert not flat.logit.any()
