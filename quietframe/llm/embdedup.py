"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a string of sign bits of random projections,
vectors are put in lexicographic order of those strings, and each is compared
with its next ``WINDOW`` neighbours.  Vectors at a small angle share long
prefixes and so stand near each other in most passes.  The number of passes
follows from the counted size of the largest label.

What is shuffled for a pass is a byte a component, with the length of what the
rounding left out: that bounds each cosine from both sides.  Pairs that are
sure are links; pairs that are not are looked up in full.  Verified pairs of
all passes are united to components; within a component the links of each
vector are then counted exactly, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, partitions, staged, stars

#: The least number of passes.  See :func:`passes_for`.
PASSES = 6
#: Neighbours that each vector is compared with: a matrix product, cheaper than the shuffle of further passes.
WINDOW = 256
#: Share of pairs at the threshold that all passes together may miss, among vectors of a label in all directions alike.
MISS = 1e-5
BITS = 63
BLOCK = 1024
SEED = 7331


def passes_for(largest: int, threshold: float, window: int) -> int:
    """Passes that miss a pair at the threshold with probability ``MISS`` among the ``largest`` vectors of a label.

    Such a pair agrees on a sign with probability 1 - angle / pi, and stands
    within the window if it agrees on as many bits as leave ``window`` vectors
    to a prefix.  At 0.93 that is 0.88 a bit: 7 or 8 bits among 5,000 vectors
    with 32 neighbours, 4 or 5 with 256 (14 passes), 12 among a million (48), 17 among 40 million (101).
    """
    bits = max(0.0, np.log2(max(largest, 1) / window))
    agree = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return PASSES if agree >= 1 else max(PASSES, int(np.ceil(np.log(MISS) / np.log1p(-agree))))


def _planes(dim: int, passes: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim)).standard_normal((dim, passes * BITS))


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of each usable vector; null for what can link with nothing."""
    for batch in batches:
        out = []
        for values in batch.column(2).to_pylist():
            x = None
            if values and not any(v is None for v in values):
                x = np.array(values, np.float64)
                top = np.abs(x).max()
                # Scaled by a power of two, so that norms of very large or small vectors neither overflow nor vanish.
                x = None if not np.isfinite(x).all() or top == 0 else x * 2.0 ** -np.floor(np.log2(top))
            out.append(None if x is None else x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "label", "v"])


def quantised(x: np.ndarray) -> list[bytes]:
    """Rows of unit length as a byte a component, after their scale and the length of what rounding left out."""
    scale = np.abs(x).max(1, keepdims=True) / 127
    q = np.round(x / scale).astype(np.int8)
    left = np.linalg.norm(x - q * scale, axis=1, keepdims=True)
    # Rounded up, so that it stays a bound in single precision.
    head = np.concatenate((scale, left * (1 + 1e-6) + 1e-9), 1).astype("<f4")
    return [h.tobytes() + r.tobytes() for h, r in zip(head, q, strict=True)]


def _passes(passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column(2).to_pylist()]) // 8
            for dim in np.unique(lengths):
                rows = pa.array(lengths == dim)
                ids, label, raw = (c.filter(rows) for c in batch.columns[:3])
                x = _vectors(raw).reshape(-1, dim)
                if dim not in planes:
                    planes[int(dim)] = _planes(int(dim), passes)
                for at in range(0, len(x), 512):
                    part = x[at : at + 512]
                    signs = (part @ planes[int(dim)] > 0).reshape(len(part), passes, BITS)
                    code = (signs.astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(2)
                    small = pa.array(quantised(part / np.linalg.norm(part, axis=1, keepdims=True)), pa.binary())
                    for p in range(passes):
                        n = len(part)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), label.slice(at, n), pa.array(np.full(n, dim, np.int32)), pa.array(code[:, p]), ids.slice(at, n), small], _DEALT)

    return run


_DEALT = ["pass", "label", "dim", "code", "id", "q"]
_LINKS = "a long, b long, sure boolean"
_FOUND = f"{_LINKS}, task int, size long, pass int, label long, dim int, code long, id long, q binary"


def _near(batch: pa.RecordBatch, threshold: float, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links among rows in order, each compared with the next ``window`` ones: sure ones, one for each vector that has
    any, and pairs to look up between what these leave apart."""
    ids = batch.column(4).to_numpy()
    key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
    group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]).any(1))))
    sure: list[tuple[np.ndarray, np.ndarray]] = []
    open_: list[tuple[np.ndarray, np.ndarray]] = []
    for dim in np.unique(key[:, 2]):
        rows = np.flatnonzero(key[:, 2] == dim)
        raw = np.frombuffer(b"".join(batch.column(5).take(pa.array(rows)).to_pylist()), np.uint8).reshape(-1, 8 + dim)
        head = np.ascontiguousarray(raw[:, :8]).view("<f4").astype(np.float64)
        x = (raw[:, 8:].view(np.int8) * head[:, :1]).astype(np.float32)
        left = head[:, 1]
        block = max(window, 128)
        for at in range(0, len(rows) - 1, block):
            own, other = np.arange(at, min(at + block, len(rows))), np.arange(at, min(at + block + window, len(rows)))
            cosine = (x[own] @ x[other].T).astype(np.float64)
            lag = other - own[:, None]
            met = (lag > 0) & (lag <= window) & (group[rows[own]][:, None] == group[rows[other]])
            # Of rounded vectors: no further off than both rests, their product, and single precision.
            off = left[own][:, None] + left[other] * (1 + left[own][:, None]) + 1e-5
            for held, there in ((sure, met & (cosine - off >= threshold)), (open_, met & (np.abs(cosine - threshold) < off))):
                a, b = np.nonzero(there)
                held.append((rows[own[a]], rows[other[b]]))
    a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (zip(*sure, strict=True) if sure else ([], [])))
    root, member = stars(ids, a, b)
    named = dict(zip(member.tolist(), root.tolist(), strict=True))
    c, d = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (zip(*open_, strict=True) if open_ else ([], [])))
    apart = [named.get(i, i) != named.get(j, j) for i, j in zip(ids[c].tolist(), ids[d].tolist(), strict=True)]
    c, d = c[apart], d[apart]
    return np.concatenate((root, ids[c])), np.concatenate((member, ids[d])), np.arange(len(root) + len(c)) < len(root)


def _windows(threshold: float, window: int):
    """Links within a task; its size; and its first and last ``window`` rows, which its neighbours have to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        names = [c.split()[0] for c in _FOUND.split(", ")]
        held: pa.RecordBatch | None = None
        size = 0

        def border(rows: pa.RecordBatch) -> pa.RecordBatch:
            n = rows.num_rows
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(np.full(n, task, np.int32)), pa.nulls(n, pa.int64()), *rows.columns], names)

        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                if size < window:
                    yield border(batch.slice(0, window - size))
                size += batch.num_rows
                if held is not None:
                    batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = batch.slice(max(0, batch.num_rows - window))
                a, b, sure = _near(batch, threshold, window)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure), *(pa.nulls(len(a), t) for t in (pa.int32(), pa.int64(), *batch.schema.types))], names)
        if size > window:  # the last rows, less those that are among the first
            yield border(held.slice(max(0, held.num_rows - (size - window))))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.array([task], pa.int32()), pa.array([size]), *(pa.nulls(1, t) for t in held.schema.types)], names)

    return run


def _seam(threshold: float, window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.select(_DEALT).combine_chunks()
        table = table.sort_by([(c, "ascending") for c in _DEALT[:5]]).combine_chunks()
        return pa.Table.from_arrays([*map(pa.array, _near(table.to_batches()[0], threshold, window))], ["a", "b", "sure"])

    return run


def _window_links(dealt: DataFrame, threshold: float, window: int) -> DataFrame:
    """Links and pairs to look up, ``(a, b, sure)``, of rows that are dealt to tasks by range and sorted, over the borders of tasks too."""
    spark = dealt.sparkSession
    found = staged(dealt.select(*_DEALT).mapInArrow(_windows(threshold, window), _FOUND))
    links = found.where("a is not null").select("a", "b", "sure")
    # One pair of numbers a task.  Rows at a task's end meet the tasks after it until these have a window of rows.
    sizes = sorted((r["task"], r["size"]) for r in found.where("size is not null").select("task", "size").collect())
    seams = []
    for i in range(len(sizes) - 1):
        seams.append((sizes[i][0], i))
        after = 0
        for task, size in sizes[i + 1 :]:
            seams.append((task, i))
            after += size
            if after >= window:
                break
    if not seams:
        return links.distinct()
    borders = found.where("id is not null").join(F.broadcast(spark.createDataFrame(seams, "task int, seam int")), "task")
    over = borders.select("seam", *_DEALT).groupBy("seam").applyInArrow(_seam(threshold, window), _LINKS)
    return links.unionByName(over).distinct()


def _looked_up(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Those pairs ``(a, b)`` whose vectors are links in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                v, w = np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)
                keep.append(bool((v / np.linalg.norm(v)) @ (w / np.linalg.norm(w)) >= threshold))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(reps.select(F.col("rep").alias("a"), F.col("v").alias("x")), "a").join(reps.select(F.col("rep").alias("b"), F.col("v").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _count(threshold: float):
    """Links of the left vectors of a tile to its right ones, copies counted as often as they occur."""

    def run(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy(zero_copy_only=False)
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        lengths = np.array([len(v) for v in table.column("v").to_pylist()])
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(-1, lengths[0] // 8)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        links = np.zeros(int(left.sum()), np.int64)
        own, other = x[left], x[~left]
        for at in range(0, len(own), 256):
            links[at : at + 256] = ((own[at : at + 256] @ other.T >= threshold) * copies[~left]).sum(1)
        # A vector of both sides meets itself, which is no link.
        return pa.Table.from_arrays([pa.array(ids[left]), pa.array(links - np.where(np.isin(ids[left], ids[~left]), copies[left], 0))], ["id", "links"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Link vectors of equal label by cosine of at least ``threshold``.

    Returns ``(id, n_links, component_id, kept)``: the other vectors linked
    directly, the least id reachable over links, and whether it is the row's
    own.  Cosines are taken in double precision.  Rows whose label is null or
    whose vector is null, empty, zero, or holds a null or non-finite component
    link with nothing; vectors of different dimension neither.  Repeated ids
    with usable vectors are one vertex and get the sum over their rows.

    Equal vectors are merged first, so copies are never paired with each
    other.  A found pair always has the cosine asked for; a pair is missed
    only if no chain of found pairs joins its ends (see :func:`passes_for`).  Counting
    is exact within a component and splits it into blocks of ``BLOCK``, so no
    task holds more than two of them.
    """
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("e"))
    usable = staged(slim.where("id is not null and label is not null and e is not null").mapInArrow(_encode, "id long, label long, v binary").where("v is not null"))
    reps = staged(usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    n = partitions(vectors.sparkSession)
    largest = reps.groupBy("label", F.length("v").alias("bytes")).count().agg(F.max("count")).first()[0] or 0
    passes = passes_for(largest, threshold, WINDOW)
    dealt = reps.select(F.col("rep").alias("id"), "label", "v").mapInArrow(_passes(passes), "pass int, label long, dim int, code long, id long, q binary")
    dealt = dealt.repartitionByRange(n, "pass", "label", "dim", "code", "id").sortWithinPartitions("pass", "label", "dim", "code", "id")
    pairs = staged(_window_links(dealt, threshold, WINDOW))
    links = pairs.where("sure").select("a", "b")
    found = connected(links.unionByName(_looked_up(pairs.where("not sure").select("a", "b"), reps, threshold)))
    members = reps.join(found.withColumnRenamed("v", "rep"), "rep").select(F.col("rep").alias("id"), "v", "copies", "component")
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = staged(members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    as_left = placed.select("component", F.col("block").alias("i"), every.alias("j"), "id", "v", "copies", F.lit(True).alias("left"))
    as_right = placed.select("component", every.alias("i"), F.col("block").alias("j"), "id", "v", "copies", F.lit(False).alias("left"))
    counted = as_left.unionByName(as_right).groupBy("component", "i", "j").applyInArrow(_count(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    per_rep = reps.join(counted.withColumnRenamed("id", "rep"), "rep", "left").join(found.withColumnRenamed("v", "rep"), "rep", "left")
    per_rep = per_rep.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    per_id = usable.join(per_rep, ["label", "v"]).groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    component = F.coalesce("component_id", "id")
    return slim.select("id").join(per_id, "id", "left").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
