"""Null ids, repeated ids and rows, names that clash, one very long text, many labels: a defined result each time."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietframe.llm import chosenpath, ctw, embdedup, fingerprints, langid, packing, quality, sharding, suffix
from quietframe.llm.queries import bpe_files

LONG = "alpha beta gamma delta " * 20_000
ROWS = [(None, "one two three four five six"), (None, None), (None, "one two three four five six"), (5, "seven eight nine ten"), (5, "seven eight nine ten"), (5, "other words here"), (6, ""), (7, LONG), (8, LONG), (9, None), (9, "é à ü")]


@pytest.fixture(scope="module")
def odd(spark):
    """Columns that clash with those the operators make."""
    extra = ["id", "t", "h", "row_key", "node", "fp", "kept", "set", "size", "block", "key", "n", "a", "b", "part", "batch", "component", "sig", "marks", "e", "v"]
    rows = [(i, t, *([7] * len(extra))) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in extra)).repartition(3)


def test_rows_of_each_operator(odd):
    """A row for each row; equal rows have equal results."""
    held = F.pmod("doc_id", F.lit(2)) == 0
    made = {
        "shards": sharding.shard_by_bytes(odd, 3).select("doc_id", "size", "text_crc32"),
        "prints": fingerprints.compare_with_edits(odd).select("id", "n_chars", "fingerprint"),
        "copies": fingerprints.near_copies(odd),
        "repeats": suffix.remove_repeats(odd).select("id", "n_bytes", "n_removed", "kept_sha256"),
        "near": chosenpath.near_duplicates(odd, 2),
        "scores": ctw.score_texts(odd, held),
    }
    for name, df in made.items():
        rows = df.collect()
        assert len(rows) == len(ROWS), name
        ids = collections.Counter(r[0] for r in rows)
        assert ids == collections.Counter(i for i, _ in ROWS), name
    scores = collections.Counter((r["id"], round(r["score"], 6)) for r in made["scores"].collect())
    assert scores[5, next(s for i, s in scores if i == 5 and scores[i, s] == 2)] == 2
    near = {(r["id"], r["n_shingles"]): r for r in made["near"].collect()}
    assert near[8, 4]["component_id"] == 7 and near[7, 4]["kept"] and near[None, 5]["component_id"] is None and near[None, 5]["kept"]
    repeats = {(r["id"], r["n_bytes"]): r["n_removed"] for r in made["repeats"].collect()}
    assert repeats[8, len(LONG)] == len(LONG) and repeats[7, len(LONG)] == 0 and repeats[5, 20] == 0


def test_pieces_of_odd_rows(odd):
    out = packing.pack(packing.pieces(odd, bpe_files())).collect()
    tokens = collections.Counter()
    for r in out:
        tokens[r["id"]] += r["length"]
    encoder = packing.UnitTokenizer(**bpe_files())
    expected = collections.Counter()
    for i, t in ROWS:
        expected[i] += len(encoder.whole(t or "")) + 1
    assert tokens == expected and len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)


def test_pieces_hold_the_limits(spark):
    """Every token in one piece, in order; no piece beyond a limit; its loss-bearing tokens are those after the prompt."""
    words = ["a " * n for n in (0, 1, 30, 90, 100, 101, 400, 1000, 5001)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    for most in (None, 80, 60, 1):
        per = collections.defaultdict(list)
        for r in packing.pieces(docs, bpe_files(), length=100, max_loss=most).collect():
            per[r["id"], r["doc_tokens"]].append((r["start"], r["length"], r["loss"]))
        assert len(per) == len(words)
        for (_, n), found in per.items():
            at = 0
            for start, size, loss in sorted(found):
                assert start == at and 0 < size <= 100 and loss <= (most or 100)
                assert loss == sum(k >= n // 3 for k in range(start, start + size))
                at += size
            assert at == n


def test_loss_limit_costs_little_padding(spark):
    rows = [(i, "word " * (200 + 37 * (i % 300))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack(packing.pieces(docs, bpe_files(), max_loss=1792), max_loss=1792).toPandas()
    by = out.groupby("sequence_id")
    assert by["length"].sum().max() <= 2048 and by["loss"].sum().max() <= 1792 and by["loss"].sum().max() > 1700
    assert by["length"].sum().sum() / (2048 * len(by)) > 0.97


def test_each_limit_of_a_sequence():
    """Tokens, segments and loss-bearing tokens: each alone keeps a piece out; placing is that of the plain heuristic."""
    room = np.array([10, 3, 6])
    for demand, bins in (([[6, 1, 0], [5, 1, 0]], 2), ([[1, 1, 0]] * 4, 2), ([[4, 1, 4], [3, 1, 3]], 2), ([[5, 1, 3], [4, 1, 3], [1, 1, 0]], 1)):
        assert len(set(packing.dot_product_pack(np.array(demand), room)[0])) == bins
    rng = np.random.default_rng(6)
    for _ in range(30):
        demand = np.stack([rng.integers(1, 9, 40), np.ones(40, int), np.zeros(40, int)], 1)
        demand[:, 2] = np.minimum(rng.integers(0, 7, 40), demand[:, 0])
        bins, places = packing.dot_product_pack(demand, room)
        left, expected = set(range(40)), []
        while left:
            free, held = room.astype(float), []
            while True:
                # The first of equals in the order of demands, then of items.
                fits = sorted((tuple(demand[i]), i) for i in left if (demand[i] <= free).all())
                if not fits:
                    break
                value = {d: float(np.dot(np.array(d) / room, free / room)) for d, _ in fits}
                best = max(value.values())
                item = next(i for d, i in fits if value[d] == best)
                held.append(item)
                left.discard(item)
                free = free - demand[item]
            expected.append(held)
        mine = [[i for i in sorted(np.flatnonzero(bins == b), key=lambda i: places[i])] for b in range(bins.max() + 1)]
        assert [sorted(map(tuple, demand[x])) for x in mine] == [sorted(map(tuple, demand[x])) for x in expected]


def test_loss_bearing_column(spark):
    """With counts of their own, loss-bearing tokens bind."""
    rows = [(i, i, 0, 10, 1, 10, 10 if i % 2 else 0) for i in range(20)]
    cut = spark.createDataFrame(rows, "id long, row_key long, start long, length long, ids_crc32 long, doc_tokens long, answer long")
    out = packing.pack(cut, length=40, max_loss=10, loss_col="answer").collect()
    per = collections.Counter(r["sequence_id"] for r in out if r["id"] % 2)
    assert max(per.values()) == 1 and len(out) == 20


def test_classifiers_keep_rows(odd, spark):
    train = spark.createDataFrame([(i, "good plain words " * 5 if i % 2 else "!!! ### $$$ " * 5, i % 2, "en" if i % 2 else "xx") for i in range(40)], "doc_id long, text string, quality int, lang string")
    twice = train.union(train)
    by_quality = quality.predict(odd.select("doc_id", "text"), quality.train(twice)).collect()
    by_language = langid.predict(odd.select("doc_id", "text"), langid.train(twice.union(train.where("quality = 1")))).collect()
    for rows in (by_quality, by_language):
        assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, _ in ROWS)
        same = collections.defaultdict(set)
        for r in rows:
            same[r["text"]].add(r["score"])
        assert all(len(s) == 1 for s in same.values())
    with pytest.raises(ValueError):
        quality.predict(odd.withColumn("predicted", F.lit(1)), quality.train(train))
    # Rows in any order make the same model.
    a, b = quality.train(train.repartition(5)), quality.train(train.orderBy(F.desc("doc_id")))
    assert np.array_equal(a.logit, b.logit) and a.bias == b.bias


def test_many_languages(spark):
    """More languages than a mask has bits."""
    rng = np.random.default_rng(70)
    words = {f"l{k:02d}": ["".join(chr(0x4E00 + 20 * k + c) for c in rng.integers(0, 20, 5)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(w, 20)), name) for i, (name, w) in enumerate(list(words.items()) * 3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 70 and model.table.shape[0] == 2
    probe = spark.createDataFrame([(i, " ".join(w[:6]), name) for i, (name, w) in enumerate(words.items())], "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == r["lang"] for r in langid.predict(probe, model).collect())


def test_language_against_sets(spark):
    """The filter holds every n-gram it was given; what it passes by chance is what the correction takes off."""
    rng = np.random.default_rng(3)
    words = {k: ["".join(rng.choice(list(s), 4)) for _ in range(40)] for k, s in (("a", "abcdefgh"), ("b", "efghijkl"))}
    rows = [(i, " ".join(rng.choice(words[k], 40)), k) for i, k in enumerate("ab" * 30)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    grams = {k: collections.Counter() for k in "ab"}
    for _, t, k in rows:
        keys, _, _ = langid._trigrams([t])
        grams[k].update(keys.tolist())
    for j, k in enumerate("ab"):
        other = grams["ab"[1 - j]]
        contained = [g for g, n in grams[k].items() if n / grams[k].total() >= langid.CONTAINED_SHARE * other[g] / other.total()]
        a, b, c = langid._slots(np.array(contained, np.uint64))
        held = (model.table[0][a] & model.table[0][b] & model.table[0][c]) >> np.uint64(j) & np.uint64(1)
        assert held.all()
    # The decision is the larger corrected share, text by text.
    probe = [" ".join(rng.choice(words[k], 15)) for k in "abab"]
    best, score = langid.decide(model, probe)
    assert [model.languages[i] for i in best] == list("abab") and (score > 0).all()


def test_vectors_with_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v, 1, 1), (1, v, 1, 1), (1, v, 1, 1), (2, v, 1, 1), (3, None, 1, 1), (4, v, None, 1)]
    out = embdedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long, id int").withColumn("v", F.lit(1)).withColumn("component", F.lit(2))).collect()
    assert len(out) == len(rows)
    named = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert named[None] == (0, None, True) and named[3] == (0, 3, True) and named[4] == (0, 4, True)
    assert named[2] == (2, 1, False) and named[1][1:] == (1, True)


def test_walk_and_fingerprint_by_definition():
    """Steps, samples and bytes of a fingerprint, character by character."""
    texts = ["", "a", "abc", "the quick brown fox " * 4, "ünï ☃ code", "the quick brown fox " * 4]
    prints = fingerprints.fingerprint_texts(texts)
    hold, of = fingerprints._hold_table(), fingerprints._class_of()
    for t, p in zip(texts, prints, strict=True):
        if not t:
            assert not p.any()
            continue
        step, at = 0, []
        for c in t:
            at.append(step)
            step += int(hold[int(of[ord(c)]) * fingerprints.PERIOD + step % fingerprints.PERIOD])
        extent = at[-1] + 1
        for slot in range(0, fingerprints.N_SLOTS, 7):
            ranks = fingerprints.mix64(np.arange(extent, dtype=np.uint64) ^ np.uint64((fingerprints.SEED + slot) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            chosen = int(ranks.argmin())
            k = max(i for i, s in enumerate(at) if s <= chosen)
            value = np.array([slot], np.uint64)
            for j in range(fingerprints.READ):
                value = value * np.uint64(0x9E3779B97F4A7C15) + np.uint64(ord(t[k + j]) + 1 if k + j < len(t) else 0)
            assert p[slot] == int(fingerprints.mix64(value)[0] >> np.uint64(40)) & 255
    assert (prints[3] == prints[5]).all()


def test_gradient_descent_by_definition(monkeypatch):
    """Averaged vectors and softmax, document by document, against the steps in one piece."""
    monkeypatch.setattr(quality, "N_BUCKETS", 16)
    monkeypatch.setattr(quality, "LEAST_STEPS", 6)
    monkeypatch.setattr(quality, "EPOCHS", 2)
    monkeypatch.setattr(quality, "BATCH", 3)
    rng = np.random.default_rng(1)
    docs = []
    for _ in range(7):
        k = np.unique(rng.integers(0, 16, 5)).astype(np.int32)
        docs.append((k, rng.integers(1, 4, len(k)).astype(np.int32)))
    label = np.array([0, 1, 1, 0, 1, 1, 1])
    model = quality.fit([quality.packed(k, n) for k, n in docs], label)
    own = np.random.default_rng(quality.SEED)
    prior = np.log((label.sum() + 1) / (len(label) - label.sum() + 1))
    vectors = own.uniform(-1, 1, (16, quality.DIMENSIONS)) / quality.DIMENSIONS
    out, bias = own.normal(0, 0.1, (quality.DIMENSIONS, 2)), np.array([0, prior])
    weight, order, done = len(label) / (2 * np.bincount(label)), list(range(7)), 0
    for _ in range(2):
        own.shuffle(order)
        for at in range(0, 7, 3):
            rate = quality.RATE * (1 - done / 6)
            done += 1
            chosen, g_out, g_bias, g_vec = order[at : at + 3], np.zeros_like(out), np.zeros(2), np.zeros_like(vectors)
            for i in chosen:
                k, n = docs[i]
                share = n / n.sum()
                mean = sum(s * vectors[b] for b, s in zip(k, share, strict=True))
                logits = mean @ out + bias
                p = np.exp(logits - logits.max())
                p = p / p.sum()
                p[label[i]] -= 1
                p *= weight[label[i]]
                for b, s in zip(k, share, strict=True):
                    g_vec[b] += s * (out @ p)
                g_out += np.outer(mean, p)
                g_bias += p
            out, bias, vectors = out - rate / len(chosen) * g_out, bias - rate / len(chosen) * g_bias, vectors - rate * g_vec
    assert np.allclose(model.logit, vectors @ (out[:, 1] - out[:, 0]), atol=1e-4) and model.bias == pytest.approx(bias[1] - bias[0], abs=1e-4)
