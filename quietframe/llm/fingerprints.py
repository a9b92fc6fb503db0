"""Document fingerprints by randomised edit embedding.

All texts share one random walk rule: at output step ``j`` the walk stays on
the character it stands on or moves to the next one, decided by a random bit
of ``(j, character)``.  Copying out the character under the walk at each step
maps edit distance to Hamming distance: after an edit two walks drift back
together.  Here the walk is taken character by character: a table gives, for
a step and a class of characters, how many steps the character holds.

A fingerprint samples the embedding at ``N_SLOTS`` steps.  Each slot takes the
step of least random rank among those the walk reaches, so texts of different
length sample mostly the same steps, and keeps 8 bits of the characters read
from there.  Banding those bits finds candidates, comparing whole fingerprints
verifies them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected, mix64, partitions, staged

N_SLOTS = 128
#: Characters that a slot reads from its step on.
READ = 6
PERIOD = 4096
CLASSES = 256
SEED = 0x51C7A3
_MAX_RECORDS = 64
#: Share of pairs just alike enough that may share no band.
MISS = 1e-4
#: Fingerprints of a bucket that one task compares with as many others.
BLOCK = 512


def _hold_table() -> np.ndarray:
    """Steps that a character of a class holds when the walk comes to it at a step (modulo the period)."""
    moves = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD)).astype(bool)
    nearest = np.zeros((CLASSES, PERIOD), np.int32)
    upcoming = np.full(CLASSES, 0)
    for j in range(2 * PERIOD - 1, -1, -1):
        upcoming = np.where(moves[:, j % PERIOD], 1, upcoming + 1)
        if j < PERIOD:
            nearest[:, j] = upcoming
    return nearest.reshape(-1)


_HOLD: list[np.ndarray] = []
_CLASS: list[np.ndarray] = []
_RECORDS: dict[int, list[np.ndarray]] = {}


def _class_of() -> np.ndarray:
    if not _CLASS:
        _CLASS.append((mix64(np.arange(0x110000, dtype=np.uint64)) & np.uint64(CLASSES - 1)).astype(np.uint8))
    return _CLASS[0]


def _walks(classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Step at which each character is reached, for all texts side by side.

    ``classes`` is the concatenation of the texts.
    """
    if not _HOLD:
        _HOLD.append(_hold_table())
    hold = _HOLD[0]
    reached = np.zeros(len(classes), np.int32)
    order = np.argsort(-lengths, kind="stable")
    base, step = starts[order], np.zeros(len(order), np.int32)
    longest = lengths[order]
    alive = np.searchsorted(-longest, -np.arange(int(longest[0]) if len(longest) else 0), side="left")
    abreast = int(np.searchsorted(-alive, -_ALONE, side="left"))
    for i, n in enumerate(alive[:abreast]):  # texts longer than i come first
        at = base[:n] + i
        s = step[:n]
        reached[at] = s
        s += hold[classes[at].astype(np.int32) * PERIOD + (s & (PERIOD - 1))]
    # The few longest go on one by one, which is cheaper than a step of arrays for each character.
    for k in range(int(alive[abreast]) if abreast < len(alive) else 0):
        begin, end = int(base[k]) + abreast, int(base[k] + longest[k])
        reached[begin:end] = _walk_alone(classes[begin:end], int(step[k]))
    return reached


#: Texts that are walked one by one once no others are left.
_ALONE = 16
_HOLD_LIST: list[list[int]] = []


def _walk_alone(classes: np.ndarray, step: int) -> np.ndarray:
    if not _HOLD_LIST:
        _HOLD_LIST.append(_HOLD[0].tolist())
    hold, out = _HOLD_LIST[0], []
    for row in (classes.astype(np.int32) * PERIOD).tolist():
        out.append(step)
        step += hold[row + (step & (PERIOD - 1))]
    return np.array(out, np.int32)


def _sample_steps(limit: int) -> list[np.ndarray]:
    """For each slot, the steps that have the least rank of all steps so far (records), up to ``limit``."""
    have = _RECORDS.get(0)
    if have is None or _RECORDS[1][0] < limit:
        size = max(1 << 18, 1 << int(np.ceil(np.log2(max(limit, 2)))))
        steps = np.arange(size, dtype=np.uint64)
        have = []
        for slot in range(N_SLOTS):
            rank = mix64(steps ^ np.uint64((SEED + slot) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            best = np.minimum.accumulate(rank)
            have.append(np.flatnonzero(np.concatenate(([True], best[1:] < best[:-1]))))
        _RECORDS[0], _RECORDS[1] = have, [size]
    return have


def _read(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, reached: np.ndarray, text_no: np.ndarray) -> np.ndarray:
    """Fingerprint bytes of the texts, from the step of each of their characters."""
    n = len(starts)
    out = np.zeros((n, N_SLOTS), np.uint8)
    full = np.flatnonzero(lengths > 0)
    if not len(full):
        return out
    last = starts[full] + lengths[full] - 1
    extent = reached[last] + 1
    end = starts[full] + lengths[full]
    power = np.uint64(0x9E3779B97F4A7C15)
    # Texts follow each other; adding a text's offset makes (text, step) one increasing key.
    width = np.int64(reached.max() + 2)
    key = text_no * width + reached.astype(np.int64)
    for slot, records in enumerate(_sample_steps(int(extent.max()))):
        step = records[np.searchsorted(records, extent, side="left") - 1]
        at = np.searchsorted(key, full * width + step, side="right") - 1
        value = np.full(len(at), slot, np.uint64)
        for k in range(READ):  # what lies beyond the text's end reads as nothing
            value = value * power + np.where(at + k < end, codes[np.minimum(at + k, end - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        out[full, slot] = (mix64(value) >> np.uint64(40)).astype(np.uint8)
    return out


def fingerprint_texts(texts: list[str]) -> np.ndarray:
    """Fingerprints, one row of bytes for each text; an empty text has all zeros."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1].astype(np.int64)
    text_no = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    classes = _class_of()[codes]
    return _read(codes, starts, lengths, _walks(classes, starts, lengths), text_no)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots, less what chance makes equal; 0 to 1.  Equal fingerprints: exactly 1."""
    same = (a == b).mean(-1)
    return np.clip((same - 1 / 256) / (1 - 1 / 256), 0, 1)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def with_following(docs: DataFrame, id_col: str, text_col: str, name: str, run, schema: str, rows_per_block: int = 1500) -> DataFrame:
    """Apply ``run(ids, texts, following)`` to runs of rows in descending id.

    ``following`` is the text of the row after it; after the last comes the
    first.  Rows are dealt to blocks of adjacent ids; the first row of each
    block also goes to the block before it, so each block is complete by
    itself.  Ids are only ranked, never collected: block bounds are a sketch
    of the id's distribution, one number for each block.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    count = rows.count()
    # Never more bounds than fit one small array; blocks grow instead.
    n_blocks = min(max(1, count // rows_per_block), 100_000)
    bounds = sorted(set(rows.approxQuantile("id", [i / n_blocks for i in range(1, n_blocks)], 0.2 / n_blocks))) if n_blocks > 1 else []
    keyed = rows.withColumn("rank_id", F.coalesce(F.col("id"), F.lit(-(2**63))).cast("double"))
    if len(bounds) > 1:
        cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="rank_id", outputCol="block", handleInvalid="keep")
        keyed = cut.transform(keyed).withColumn("block", -F.col("block").cast("int"))
    else:
        keyed = keyed.withColumn("block", F.lit(0))
    # One row per block: its first id, the block before it (after the last, the first).
    order = Window.orderBy("block")
    heads = keyed.groupBy("block").agg(F.max(F.coalesce("id", F.lit(-(2**63)))).alias("head"))
    heads = heads.select("block", "head", F.coalesce(F.lag("block").over(order), F.max("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    keyed = keyed.join(F.broadcast(heads), "block")
    is_head = F.coalesce("id", F.lit(-(2**63))) == F.col("head")
    also = F.struct(F.col("before").alias("block"), F.lit(True).alias("halo"))
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("halo"))
    dealt = keyed.select("id", "t", F.explode(F.when(is_head, F.array(own, also)).otherwise(F.array(own))).alias("to")).select("id", "t", "to.block", "to.halo")
    dealt = dealt.repartition(partitions(spark), "block")
    dealt = dealt.sortWithinPartitions("block", "halo", F.col("id").desc_nulls_last(), "t")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        state = {"block": None, "head": None, "halo": False}

        def flush(after: str | None) -> Iterator[pa.RecordBatch]:
            if ids:
                yield from run(ids, texts, [*texts[1:], after if after is not None else texts[0]])
            ids.clear()
            texts.clear()

        held = 0
        for batch in batches:
            for key, text, block, halo in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if block != state["block"]:
                    yield from flush(None)
                    state |= {"block": block, "halo": False}
                    held = 0
                if halo:
                    if not state["halo"]:  # of repeated ids only the first row follows
                        yield from flush(text)
                        state["halo"] = True
                    continue
                if held > (1 << 21):  # a long block in runs: this row follows the run before it
                    yield from flush(text)
                    held = 0
                ids.append(key)
                texts.append(text)
                held += len(text)
        yield from flush(None)

    return dealt.select("id", "t", "block", "halo").mapInArrow(stream, schema)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited form (see :func:`edited`).

    Returns ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next)``.  Null texts count as empty; an empty text has a
    fingerprint of zeros and is like another empty one (1), unlike any other.
    Order is descending id, null ids last, repeated ids by text.  With a single
    row the row follows itself.  Equal texts have equal fingerprints.
    """

    def run(ids: list, texts: list[str], following: list[str]) -> Iterator[pa.RecordBatch]:
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        n = len(texts)
        prints = fingerprint_texts([*texts, following[-1], *changed])
        own, after, new = prints[:n], prints[1 : n + 1], prints[n + 1 :]
        # An empty text reads as nothing; zeros against zeros by chance must not look alike.
        void = np.array([not t for t in texts])
        void_next = np.array([not t for t in following])
        near_new = np.where(void == np.array([not t for t in changed]), likeness(own, new), 0.0)
        near_next = np.where(void == void_next, likeness(own, after), 0.0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array([r.tobytes().hex() for r in own]),
                pa.array([r.tobytes().hex() for r in new]),
                pa.array(near_new),
                pa.array(near_next),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_following(docs, id_col, text_col, "following", run, schema)


def band_for(least: float) -> int:
    """The longest band of which two texts ``least`` alike share one, but for ``MISS``: 5 slots at 0.8."""
    for slots in range(N_SLOTS, 1, -1):
        if (1 - least**slots) ** (N_SLOTS // slots) <= MISS:
            return slots
    return 1


def _tile(least: float):
    """All pairs of a block, or of two, of a bucket, as links that hold each group of alike ones together."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        prints = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint8).reshape(-1, N_SLOTS)
        a_out: list[int] = []
        b_out: list[int] = []
        waiting = np.arange(len(ids))
        while len(waiting):
            queue, waiting = [waiting[0]], waiting[1:]
            root = ids[queue[0]]
            while queue and len(waiting):
                near = likeness(prints[waiting], prints[queue.pop()]) >= least
                a_out += [root] * int(near.sum())
                b_out += ids[waiting[near]].tolist()
                queue += waiting[near].tolist()
                waiting = waiting[~near]
        return pa.Table.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, band_slots: int | None = None) -> DataFrame:
    """Group texts whose fingerprints are at least ``least`` alike: ``(id, component)``.

    Equal fingerprints are merged first, so a group of copies of any size
    costs one row.  The sampled bits are cut into bands of ``band_slots``
    slots (:func:`band_for`); fingerprints that agree on a band are candidates.
    All pairs of a bucket are compared, block against block, which is quadratic
    in a bucket; verified links are joined to components.  Empty texts form one
    group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prints = [r.tobytes() for r in fingerprint_texts(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["id", "fp"])

    band_slots = band_slots or band_for(least)
    prints = staged(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp binary"))
    reps = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(N_SLOTS // band_slots - 1)), lambda b: F.struct(b.alias("no"), F.substring(F.col("fp"), b * band_slots + 1, F.lit(band_slots)).alias("bits")))
    rows = reps.select("rep", "fp", F.explode(bands).alias("band")).select("rep", "fp", F.col("band.no").alias("no"), F.col("band.bits").alias("bits"))
    sizes = rows.groupBy("no", "bits").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = rows.join(sizes, ["no", "bits"]).select("no", "bits", "rep", "fp", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    tiles = placed.groupBy("no", "bits", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    links = tiles.applyInArrow(_tile(least), "a long, b long").distinct()
    found = connected(links).withColumnRenamed("v", "rep")
    named = prints.join(reps, "fp").join(found, "rep", "left")
    return named.select("id", F.coalesce("component", "rep").alias("component"))
