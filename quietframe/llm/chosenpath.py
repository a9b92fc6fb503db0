"""Near-duplicate detection by a chosen-path set similarity join.

Documents are sets of word shingles.  In each of some independent trees a node
chooses one or two minwise hashes, ``1 / threshold`` on average, and every
document in it branches by each to the node that its least shingle under that
hash names (two sets of Jaccard similarity s go on together by a hash with
probability s, so that a pair at the threshold is in one common branch of a
node on average).  Nodes with many documents branch again, small ones and those
that hold near copies of one text are compared exhaustively.  The paths of all trees come from one minwise signature:
two bytes a hash.  What moves through a tree is a document's id, its hashes of
that tree and one bit of each minwise hash, to compare by; never its text.
Nodes propose groups of documents that may be linked; every link is then
confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, give_back, lowered, mix64, partitions, run_hashes, staged, stars, text_slices, word_bounds

#: Share of pairs at the threshold that all trees together may miss, where nodes stay large down to the last level.
MISS = 1e-4
LEVELS = 6
#: The first branchings are taken at once: nearly all documents have company in a node of one token.
FIRST = 2
SMALL_NODE = 48
#: Nodes of more documents branch again without being gathered anywhere.
HOT_NODE = 4096
#: Of a large node of near copies one row in so many may be something else.
OTHERS = 8
#: Documents of a proposed group that one task compares on full sets.
BLOCK = 512
LANDMARKS = 16
#: Standard deviations that the bits of a pair at the threshold may fall short of their mean.
_SLACK = 5


#: Minwise hashes that a node may choose from.
CHOICES = 2


def second_branch(threshold: float) -> float:
    """Share of the nodes that choose two hashes, so that nodes choose ``1 / threshold`` on average (two at most)."""
    return float(np.clip(1 / threshold - 1, 0, 1))


def trees_for(threshold: float) -> int:
    """Trees of which at least one keeps a pair at the threshold together over all levels, but for ``MISS``: 15 at 0.8."""
    two, meets = second_branch(threshold), 1.0
    for _ in range(LEVELS):
        apart = 1 - threshold * meets
        meets = 1 - ((1 - two) * apart + two * apart**2)
    return 6 if meets >= 1 else max(6, int(np.ceil(np.log(MISS) / np.log1p(-meets))))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a slice, ascending, and where each text's begin."""
    data = lowered(data)
    starts, ends, rows = word_bounds(data, offsets)
    n = len(offsets) - 1
    h = run_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    per_row = np.bincount(rows, minlength=n)
    first = np.concatenate(([0], np.cumsum(per_row)))[:-1]
    value = np.zeros(len(h), np.uint64)
    left = np.repeat(first + per_row, per_row) - np.arange(len(h))  # words from here to the text's end
    size = np.minimum(np.repeat(per_row, per_row), words)
    for k in range(words):
        upto = max(len(h) - k, 0)
        value[:upto] = np.where(size[:upto] > k, value[:upto] * np.uint64(0x9E3779B97F4A7C15) + h[k:], value[:upto])
    whole = left >= size
    whole &= (np.repeat(per_row, per_row) >= words) | (np.arange(len(h)) == np.repeat(first, per_row))
    value, row = mix64(value[whole] + size[whole].astype(np.uint64)), rows[whole]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(n + 1))


def _multipliers(size: int) -> np.ndarray:
    return np.random.default_rng(90210).integers(1, 2**63, size).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(values: np.ndarray, cut: np.ndarray, size: int) -> np.ndarray:
    """``size`` minwise hashes of each set, 32 bits each; all ones for an empty set."""
    n = len(cut) - 1
    out = np.full((n, size), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(cut))
    if len(full):
        values = values ^ (values >> np.uint64(29))
        for j, m in enumerate(_multipliers(size)):
            out[full, j] = np.minimum.reduceat(((values * m) >> np.uint64(32)).astype(np.uint32), cut[full])
    return out


def _summaries(words: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), 1 << 20):
                values, cut = shingle_sets(data, offsets, words)
                sig = signatures(values, cut, trees * LEVELS * CHOICES)
                # 128 bits that stand for the whole set.
                zero = np.zeros(1, np.uint64)
                sums = (np.concatenate((zero, np.cumsum(mix64(values + np.uint64(k))))) for k in (11, 23))
                digest = [(x[cut[1:]] - x[cut[:-1]]).view(np.int64) for x in sums]
                path = sig.astype(">u2")
                marks = np.packbits((sig * np.uint32(0x9E3779B1)) >> np.uint32(31), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(cut).astype(np.int64)), *map(pa.array, digest), pa.array([r.tobytes() for r in path], pa.binary()), pa.array([r.tobytes() for r in marks], pa.binary())],
                    ["id", "n", "d1", "d2", "sig", "marks"],
                )

    return run


_STEP = "a long, b long, node long, id long, marks binary, path binary"


def _node_step(least: int):
    """Rows come node by node, ``HOT_NODE`` of one at most.  Small nodes: links between those of which at most ``least``
    bits differ, compared pair by pair, as one link for each that has any.  Larger ones whose rows are alike but for a few
    likewise, in one pass: they end here.  All others pass through."""
    names = [c.split()[0] for c in _STEP.split(", ")]

    def linked(root: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        n = len(root)
        return pa.RecordBatch.from_arrays([pa.array(root), pa.array(other), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)

    def links(node: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        a_all, b_all = [], []
        for lag in range(1, SMALL_NODE):
            at = np.flatnonzero(node[lag:] == node[:-lag])
            if not len(at):
                break
            near = at[np.bitwise_count(marks[at] ^ marks[at + lag]).sum(1, dtype=np.int64) <= least]
            a_all.append(near)
            b_all.append(near + lag)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_all, b_all))
        return linked(*stars(ids, a, b))

    def family(ids: np.ndarray, marks: np.ndarray) -> pa.RecordBatch | None:
        """Links of a large node nearly all of whose rows are alike; None for any other."""
        centre = np.packbits(2 * np.unpackbits(marks, axis=1).sum(0, dtype=np.int64) > len(ids))
        alike = np.bitwise_count(marks ^ centre).sum(1, dtype=np.int64) <= least
        others = np.flatnonzero(~alike)
        if len(others) > max(SMALL_NODE, len(ids) // OTHERS):
            return None
        # The alike are proposed together; each of the others is compared with all rows.
        inside = np.flatnonzero(alike)
        near = [np.flatnonzero(np.bitwise_count(marks ^ marks[i]).sum(1, dtype=np.int64) <= least) for i in others]
        a = np.concatenate([inside[:1].repeat(len(inside)), *(np.full(len(x), i) for i, x in zip(others, near, strict=True))])
        return linked(*stars(ids, a, np.concatenate([inside, *near])))

    def passed(rows: pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *rows.columns], names)

    def step(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Whole nodes."""
        node, ids = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        marks = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(first, len(node)))
        rest = size > SMALL_NODE
        for i in np.flatnonzero(rest):
            at = slice(first[i], first[i] + size[i])
            found = family(ids[at], marks[at])
            if found is not None:
                rest[i] = False
                yield found
        of = np.repeat(rest, size)
        if of.any():
            yield passed(rows.filter(pa.array(of)))
        some = np.repeat((size > 1) & (size <= SMALL_NODE), size)
        if some.any():
            yield links(node[some], ids[some], marks[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            node = batch.column(0).to_numpy()
            cut = int(np.searchsorted(node, node[-1]))  # the last node may go on
            if cut:
                yield from step(batch.slice(0, cut))
            held = batch.slice(cut)
        if held is not None and held.num_rows:
            yield from step(held)
        give_back()

    return run


def _propose(reps: DataFrame, threshold: float, trees: int) -> DataFrame:
    """Links ``(a, b)`` between documents that some small node holds and whose bits are alike, or that the last level leaves together."""
    n = partitions(reps.sparkSession)
    width = LEVELS * CHOICES
    bits, mean = trees * width, (1 + threshold) / 2
    least = int(bits * (1 - mean) + _SLACK * np.sqrt(bits * mean * (1 - mean)))

    def branched(rows: DataFrame, level: int) -> DataFrame:
        # Each hash belongs to one level of one tree; which nodes choose two follows from their name.
        by = [F.xxhash64("node", F.lit(c), F.substring("path", 2 * (CHOICES * level + c) + 1, 2)) for c in range(CHOICES)]
        both = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 20)) < int(second_branch(threshold) * (1 << 20))
        return rows.select(F.explode(F.when(both, F.array(*by)).otherwise(F.array(by[0]))).alias("node"), "id", "marks", "path")

    path = F.substring(F.col("sig"), F.col("tree") * (2 * width) + 1, F.lit(2 * width))
    at = reps.select("id", "marks", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select(F.xxhash64("tree").alias("node"), "id", "marks", path.alias("path"))
    for level in range(FIRST):
        at = branched(at, level)
    out = None
    for level in range(FIRST, LEVELS + 1):
        # Counts are combined before they are shuffled; the rows of a hot node never meet in one task.
        hot = staged(at.groupBy("node").count().where(F.col("count") > HOT_NODE).select("node", F.lit(True).alias("hot")))
        cold, large = at, None
        if not hot.isEmpty():
            marked = at.join(hot, "node", "left")
            cold, large = marked.where("hot is null").drop("hot"), marked.where("hot").drop("hot")
        done = staged(cold.repartition(n, "node").sortWithinPartitions("node").mapInArrow(_node_step(least), _STEP))
        links = done.where("a is not null").select("a", "b")
        out = links if out is None else out.unionByName(links)
        rest = done.where("id is not null").select("node", "id", "marks", "path")
        rest = rest if large is None else rest.unionByName(large)
        if level == LEVELS:
            # A node that is still large holds sets that agree again and again: all of it is proposed, with its least
            # member, so nobody's only link is left out and nothing is paired in full; links are confirmed later.
            lead = rest.groupBy("node").agg(F.min("id").alias("a"))
            links = rest.select("node", F.col("id").alias("b")).join(lead, "node").where("a <> b").select("a", "b")
            return out.unionByName(links).distinct()
        at = staged(branched(rest, level))
        if at.isEmpty():
            break
    return out.distinct()


def _compare(words: int, threshold_percent: int):
    """Exact links among the sets of a block, as links that hold each component together."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        lead = table.column("lead").to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, ~lead))
        ids, sets = ids[order], [sets[i] for i in order]
        size = np.array([len(x) for x in sets])
        flat, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.concatenate(([0], np.cumsum(size)))
        mark = np.zeros(len(flat), np.int32)
        a_out: list[int] = []
        b_out: list[int] = []
        waiting = np.arange(len(ids))
        while len(waiting):
            queue, waiting = [waiting[0]], waiting[1:]
            root = ids[queue[0]]
            held = None
            while queue and len(waiting):
                at = queue.pop()
                own = inverse[begin[at] : begin[at + 1]]
                mark[own] = 1
                if held is None or len(held[0]) != len(waiting):
                    held = (waiting, np.concatenate([inverse[begin[i] : begin[i + 1]] for i in waiting]), np.concatenate(([0], np.cumsum(size[waiting])))[:-1])
                common = np.add.reduceat(mark[held[1]], held[2])
                mark[own] = 0
                linked = 100 * common >= threshold_percent * (size[waiting] + size[at] - common)
                a_out += [root] * int(linked.sum())
                b_out += ids[waiting[linked]].tolist()
                queue += waiting[linked].tolist()
                if linked.any():
                    waiting = waiting[~linked]
        return pa.Table.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = 5, threshold_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by Jaccard similarity of word shingles.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased.  A
    document's set holds its distinct shingles of ``words`` words; with fewer
    words, the whole sequence as one; without words (null, empty, blank) it is
    empty and linked with nothing.  Documents whose intersection is at least
    ``threshold_percent`` of their union are linked.  Returns ``(id,
    n_shingles, component_id, kept)``: the least id that can be reached over
    links, and whether that is the row's own.  Repeated ids are one node of
    the graph but keep a row each.

    Equal sets are merged before anything else, so copies cost one row.  Sets
    are 64-bit hashes of shingles.  Links are never dropped for size: a
    proposed group beyond ``BLOCK`` documents is compared in blocks, each with
    the group's landmarks, and what does not link to a landmark is compared
    with every block.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    trees = trees_for(threshold_percent / 100)
    made = staged(slim.mapInArrow(_summaries(words, trees), "id long, n long, d1 long, d2 long, sig binary, marks binary"))
    # A null id cannot be reached or reach: it stays a component of its own.
    full = made.where("n > 0 and id is not null")
    reps = staged(full.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("marks").alias("marks")))
    proposed = connected(_propose(reps.select(F.col("rep").alias("id"), "sig", "marks"), threshold_percent / 100, trees))
    links = _confirm(slim, staged(proposed), words, threshold_percent)
    same = full.join(reps.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    found = connected(links.unionByName(same))
    out = made.select("id", "n").join(found.withColumnRenamed("v", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _confirm(slim: DataFrame, proposed: DataFrame, words: int, threshold_percent: int) -> DataFrame:
    """Exact links within the proposed groups ``(v, component)``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), 2 << 20):
                values, cut = shingle_sets(data, offsets, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([values[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], ["id", "component", "set"])

    chosen = slim.join(proposed.withColumnRenamed("v", "id"), "id").select("id", "t", "component")
    members = staged(chosen.mapInArrow(sets, "id long, component long, set binary").where("length(set) > 0"))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min_by("id", F.xxhash64("id")).alias("one"))
    sized = members.join(sizes, "component")
    block = F.when(F.col("size") <= BLOCK, F.lit(0)).otherwise(F.pmod(F.xxhash64("id", F.lit(5)), F.ceil(F.col("size") / BLOCK))).cast("int")
    sized = sized.select("component", "id", "set", "size", block.alias("block"))
    out = "a long, b long"
    small = sized.where(f"size <= {BLOCK}").select("component", "block", "id", "set", F.lit(False).alias("lead"))
    first = small.groupBy("component", "block").applyInArrow(_compare(words, threshold_percent), out)
    large = staged(sized.where(f"size > {BLOCK}"))
    if large.isEmpty():
        return first
    blocks = large.select("component", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")).distinct()
    # Landmarks: about LANDMARKS members of each large group, drawn by hash; copied to each of its blocks.
    drawn = F.pmod(F.xxhash64("id", F.lit(77)), F.greatest(F.lit(1), (F.col("size") / LANDMARKS).cast("int"))) == 0
    marks = staged(large.where(drawn).select("component", "id", "set"))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    copies = marks.join(blocks, "component").select("component", everywhere, "id", "set", F.lit(True).alias("lead"))
    rest = large.select("component", "block", "id", "set", F.lit(False).alias("lead")).join(marks.select("id"), "id", "left_anti").select("component", "block", "id", "set", "lead")
    second = staged(rest.unionByName(copies).groupBy("component", "block").applyInArrow(_compare(words, threshold_percent), out))
    # Whatever is not in its group's largest landmark component goes against every block.
    near = connected(second)
    home = large.select("component", "id").join(near.withColumnRenamed("v", "id").withColumnRenamed("component", "at"), "id", "left")
    main = home.groupBy("component", "at").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("at", F.struct("n", "at")).alias("main"))
    loose = home.join(main, "component").where("at is null or at <> main").select("component", "id")
    loose = staged(large.join(loose, ["component", "id"]).select("component", "id", "set"))
    if loose.isEmpty():
        return first.unionByName(second)
    # In runs of at most about BLOCK, so a task holds one run of loose sets and one block.
    runs = loose.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("runs"))
    dealt = loose.join(runs, "component").withColumn("run", F.pmod(F.xxhash64("id", F.lit(9)), F.col("runs")).cast("int"))
    against = dealt.join(blocks, "component").select("component", "run", everywhere, "id", "set", F.lit(True).alias("lead"))
    targets = large.join(runs, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), "block", "id", "set", F.lit(False).alias("lead"))
    tiles = against.unionByName(targets).groupBy("component", "run", "block").applyInArrow(_compare(words, threshold_percent), out)
    return first.unionByName(second).unionByName(tiles.where("a <> b"))
