"""Language-model scoring by context-tree weighting over bytes.

A text is read as one stream of bytes: its words, lower-cased, with one blank
between two and an end sign after the last (a text without words is the end
sign alone).  Before a text stand only end signs.  Every byte is eight binary
decisions; each decision is predicted by Krichevsky-Trofimov estimates in all
contexts from none to the ``DEPTH`` bytes before it, mixed by the weights that
context-tree weighting gets from the training counts.  Blank, end and all other
bytes share one tree of 256 outcomes, so a score is the log probability of the
whole stream.  The model is static: texts that are scored do not change it.

Everything is counted and looked up once per distinct transition (``DEPTH``
bytes and the byte after them) of a batch of documents:

1. batches of documents are staged as streams; their distinct transitions go
   to parts by the two bytes before the predicted one, their distinct words to
   buckets by word hash, both with training counts;
2. each part adds its transitions up and sends the nodes of depth ``SPLIT`` to
   the driver (at most 255 decisions in each of 2**16 contexts, whatever the
   corpus), which makes the tree above them;
3. each part compiles its subtrees and answers the transitions of every batch;
4. batches meet their answers and score their documents.

The tree keeps every transition of the training rows; it grows with the corpus
and stays dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lowered, mix64, partitions, run_hashes, staged, text_slices, word_bounds

DEPTH = 6
#: Nodes up to this depth are on the driver and broadcast; deeper ones stay in the part that their last bytes are dealt to.
SPLIT = 2
BATCH_BYTES = 8 << 20
#: Bytes of a stream whose transitions are sorted at once, and transitions that are held before they are added up.
_AT_ONCE = 1 << 19
_HELD = 1 << 19
END = 0x0A
BLANK = 0x20
_BYTE = np.uint64(255)
_LEAST = 1e-7


def _mask(depth: int) -> np.uint64:
    """Of a transition: the last ``depth`` bytes of the context, and the byte after it."""
    return np.uint64(sum(255 << (8 * (DEPTH + 1 - k)) for k in range(1, depth + 1)) | 255)


# Streams


def stream_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The streams of a slice of texts, one after the other; each ends with its only end sign."""
    data = lowered(data)
    starts, ends, rows = word_bounds(data, offsets)
    without = np.flatnonzero(np.bincount(rows, minlength=len(offsets) - 1) == 0)
    length = np.concatenate((ends - starts, np.zeros(len(without), np.int64)))
    doc = np.concatenate((rows, without))
    order = np.argsort(doc, kind="stable")
    length, doc = length[order], doc[order]
    stops = np.cumsum(length + 1) - 1
    out = np.empty(int(stops[-1]) + 1 if len(stops) else 0, np.uint8)
    spelled = np.ones(len(out), bool)
    spelled[stops] = False
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    out[stops] = np.where(last, END, BLANK)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    out[spelled] = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    return out


def doc_starts(stream: np.ndarray) -> np.ndarray:
    """Where each text's stream begins."""
    ends = np.flatnonzero(stream == END)
    return np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1)) if len(ends) else ends


def transition_slices(stream: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Transitions of all bytes of a stream, slice by slice: the byte, under it the context, its last byte on top."""
    padded = np.concatenate((np.full(DEPTH, END, np.uint8), stream))
    for at in range(0, len(stream), _AT_ONCE):
        part = padded[at : at + _AT_ONCE + DEPTH].astype(np.uint64)
        keys = part[DEPTH:].copy()
        for back in range(1, DEPTH + 1):
            keys |= part[DEPTH - back : len(part) - back] << np.uint64(8 * (DEPTH + 1 - back))
        # Near a text's beginning what lies further back is the text before: end signs stand for it.
        lo, hi = np.searchsorted(starts, (at - DEPTH, at + len(keys)))
        for into in range(DEPTH):
            near = starts[lo:hi] + into - at
            near = near[(near >= 0) & (near < len(keys))]
            # Where a text is shorter than this, the later text's own turn comes after and sets the same signs.
            own = _mask(into)
            keys[near] = np.where(_crosses(stream, near + at, into), keys[near], (keys[near] & own) | (_ENDS & ~own))
        yield at, keys


_ENDS = np.uint64(sum(END << (8 * k) for k in range(1, DEPTH + 1)))


def _crosses(stream: np.ndarray, at: np.ndarray, into: int) -> np.ndarray:
    """Whether an end sign stands among the ``into`` bytes before ``at``: another text has begun by then."""
    found = np.zeros(len(at), bool)
    for back in range(1, into + 1):
        found |= stream[at - back] == END
    return found


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Counter:
    """Adds up transitions; what waits to be merged is bounded."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > _HELD + len(self.parts[0][0]):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [_sums(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.held = len(self.parts[0][0]) if self.parts else 0
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


# The tree


_TABLES: list[np.ndarray] = []


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0: recurrence up to 9, then Stirling's series."""
    x = np.asarray(x, float).copy()
    low = np.zeros_like(x)
    for _ in range(9):
        small = x < 9
        low[small] -= np.log(x[small])
        x[small] += 1
    y = 1 / (x * x)
    return low + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    if not _TABLES:
        n = np.arange(1 << 12)
        _TABLES.extend((log_gamma(n + 0.5), log_gamma(n + 1.0)))

    def of(table: np.ndarray, n: np.ndarray, shift: float) -> np.ndarray:
        out = table[np.minimum(n, len(table) - 1)]
        large = np.flatnonzero(n >= len(table))
        out[large] = log_gamma(n[large] + shift)
        return out

    return of(_TABLES[0], zeros, 0.5) + of(_TABLES[0], ones, 0.5) - of(_TABLES[1], zeros + ones, 1.0) - np.log(np.pi)


@dataclass
class Ladder:
    """By depth, ascending: distinct transitions of contexts cut to it, their counts, and where each one is at the next smaller depth."""

    keys: list[np.ndarray]
    counts: list[np.ndarray]
    up: list[np.ndarray]


def ladder(keys: np.ndarray, counts: np.ndarray, depth: int, upto: int) -> Ladder:
    """From ascending transitions of contexts of ``depth`` bytes to those of ``upto``."""
    found = Ladder([keys], [counts], [])
    for d in range(depth - 1, upto - 1, -1):
        cut = found.keys[0] & _mask(d)
        order = np.argsort(cut)
        ordered = cut[order]
        new = np.append(True, ordered[1:] != ordered[:-1]) if len(cut) else np.zeros(0, bool)
        up = np.empty(len(cut), np.int32)
        up[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        found.keys.insert(0, ordered[first])
        found.up.insert(0, up)
        found.counts.insert(0, np.add.reduceat(found.counts[0][order], first) if len(first) else found.counts[0])
    return found


@dataclass
class Nodes:
    """One depth's nodes of one of a byte's eight decisions: ``first`` transition, ``of`` each transition its node."""

    first: np.ndarray
    of: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    parent: np.ndarray | None = None
    weight: np.ndarray | None = None


def _rise(steps: Ladder, level: int, mixed: np.ndarray | None) -> tuple[list[Nodes], np.ndarray]:
    """Nodes of all depths with their weights, and the log mixture of those of the smallest depth.

    ``mixed`` is that of the deepest nodes; without it they are leaves.
    """
    nodes: list[Nodes] = []
    for keys, counts in zip(steps.keys, steps.counts, strict=True):
        run = keys >> np.uint64(8 - level)
        new = np.append(True, run[1:] != run[:-1])
        first = np.flatnonzero(new)
        one = counts * ((keys >> np.uint64(7 - level)) & np.uint64(1)).astype(np.int64)
        ones = np.add.reduceat(one, first)
        of = np.cumsum(new, dtype=np.int32) - np.int32(1)
        nodes.append(Nodes(first.astype(np.int32), of, np.add.reduceat(counts, first) - ones, ones))
    for i in range(1, len(nodes)):
        nodes[i].parent = nodes[i - 1].of[steps.up[i - 1][nodes[i].first]]
    leaf = mixed is None
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        own = log_estimate(x.zeros, x.ones)
        if i < len(nodes) - 1:
            under = np.bincount(nodes[i + 1].parent, weights=mixed, minlength=len(own))
            mixed = np.logaddexp(own, under) - np.log(2)
        elif leaf:
            mixed = own
        x.weight = np.ones(len(own)) if leaf and i == len(nodes) - 1 else np.exp(own - np.log(2) - mixed)
    return nodes, mixed


def _fall(nodes: list[Nodes], done: np.ndarray | None, rest: np.ndarray | None):
    """By depth each node's mixed chance of a one, from the smallest depth on; and what the deepest ones hand down.

    With ``done`` and ``rest`` the first depth is only where the others hang.
    """
    chances = []
    for i, x in enumerate(nodes):
        estimate = (x.ones + 0.5) / (x.zeros + x.ones + 1)
        if x.parent is None and done is not None:
            continue
        if x.parent is None:
            done, rest = x.weight * estimate, 1 - x.weight
        else:
            done, rest = done[x.parent] + rest[x.parent] * x.weight * estimate, rest[x.parent] * (1 - x.weight)
        # Below the last context that was seen nothing is known: that context's own estimate stands for the rest.
        chances.append(np.clip(done + rest * estimate, _LEAST, 1 - _LEAST))
    return chances, done, rest


@dataclass
class Top:
    """The tree down to ``SPLIT`` bytes: transitions and chances by depth, and what the deepest nodes hand down, by decision."""

    keys: list[np.ndarray]
    chances: list[np.ndarray]
    done: np.ndarray
    rest: np.ndarray


@dataclass
class ContextTree:
    """``keys[d]``: transitions with contexts of d bytes; ``chances[d][l]``: chance of a one at decision l of each.

    ``logs``: log10 chance of each whole transition of the full depth.
    """

    keys: list[np.ndarray]
    chances: list[np.ndarray]
    logs: np.ndarray


def split_nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions at depth ``SPLIT``, their counts, and by decision the log mixture of the subtree below each."""
    steps = ladder(keys, counts, DEPTH, SPLIT)
    mixed = np.zeros((8, len(steps.keys[0])))
    for level in range(8 if len(keys) else 0):
        nodes, found = _rise(steps, level, None)
        mixed[level] = found[nodes[0].of]
    return steps.keys[0], steps.counts[0], mixed


def compile_top(keys: np.ndarray, counts: np.ndarray, mixed: np.ndarray) -> Top:
    """The tree above the nodes of all parts."""
    order = np.argsort(keys)
    steps = ladder(keys[order], counts[order], SPLIT, 0)
    chances = [np.zeros((8, len(k)), np.float32) for k in steps.keys]
    done, rest = np.zeros((8, len(keys))), np.zeros((8, len(keys)))
    for level in range(8 if len(keys) else 0):
        run = steps.keys[-1] >> np.uint64(8 - level)
        deepest = mixed[level][order][np.flatnonzero(np.append(True, run[1:] != run[:-1]))]
        nodes, _ = _rise(steps, level, deepest)
        found, d, r = _fall(nodes, None, None)
        for held, x, p in zip(chances, nodes, found, strict=True):
            held[level] = p[x.of]
        done[level], rest[level] = d[nodes[-1].of], r[nodes[-1].of]
    return Top(steps.keys, chances, done, rest)


def compile_part(keys: np.ndarray, counts: np.ndarray, top: Top) -> ContextTree:
    """The subtrees of a part's ascending transitions, under the whole of ``top``."""
    steps = ladder(keys, counts, DEPTH, SPLIT)
    at = np.searchsorted(top.keys[SPLIT], steps.keys[0])
    chances = [np.zeros((8, len(k)), np.float32) for k in steps.keys[1:]]
    logs = np.zeros(len(keys))
    for level in range(8 if len(keys) else 0):
        nodes, _ = _rise(steps, level, None)
        head = at[nodes[0].first]
        found, _, _ = _fall(nodes, top.done[level][head], top.rest[level][head])
        for held, x, p in zip(chances, nodes[1:], found, strict=True):
            held[level] = p[x.of]
        one = (keys >> np.uint64(7 - level)) & np.uint64(1) == 1
        p = found[-1][nodes[-1].of]
        logs += np.log10(np.where(one, p, 1 - p))
    return ContextTree([*top.keys, *steps.keys[1:]], [*top.chances, *chances], logs)


def compile_tree(keys: np.ndarray, counts: np.ndarray) -> ContextTree:
    """The whole tree of some transitions, in one piece."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    return compile_part(keys, counts, compile_top(*split_nodes(keys, counts)))


def transition_logs(tree: ContextTree, keys: np.ndarray) -> np.ndarray:
    """log10 chance of each of some ascending transitions."""
    known = tree.keys[DEPTH]
    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
    out = np.zeros(len(keys))
    out[hit] = tree.logs[at[hit]]
    out[~hit] = _new_logs(tree, keys[~hit])
    return out


def _new_logs(tree: ContextTree, keys: np.ndarray) -> np.ndarray:
    """log10 chance of transitions that were not seen, decision by decision, from the longest context known for it."""
    total = np.zeros(len(keys))
    for level in range(8):
        past = np.uint64(8 - level)
        chance = np.full(len(keys), 0.5)
        todo = np.arange(len(keys))
        for d in range(DEPTH, -1, -1):
            known = tree.keys[d]
            if not len(todo) or not len(known):
                continue
            node = ((keys[todo] & _mask(d)) >> past) << past
            at = np.minimum(np.searchsorted(known, node), len(known) - 1)
            hit = known[at] >> past == node >> past
            chance[todo[hit]] = tree.chances[d][level][at[hit]]
            todo = todo[~hit]
        one = (keys >> np.uint64(7 - level)) & np.uint64(1) == 1
        total += np.log10(np.where(one, chance, 1 - chance))
    return total


# Dealing out


def _groups_of(of: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that has any of the rows, and where they stand, in order."""
    order = np.argsort(of.astype(np.int16) if parts < 1 << 15 else of, kind="stable")
    cut = np.searchsorted(of[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        yield int(p), order[cut[p] : cut[p + 1]]


def _by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Contexts that end in the same ``SPLIT`` bytes are in one part, from whatever batch."""
    of = np.empty(len(keys), np.int32)
    for at in range(0, len(keys), _AT_ONCE):
        of[at : at + _AT_ONCE] = mix64(keys[at : at + _AT_ONCE] >> np.uint64(8 * (DEPTH + 1 - SPLIT))) % np.uint64(parts)
    yield from _groups_of(of, parts)


def _pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.compress(x if isinstance(x, bytes) else x.tobytes(), 3)


def _unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Differences of ascending numbers, byte place by byte place."""
    return _pack(np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T))


def _unpack_keys(blob: bytes) -> np.ndarray:
    planes = _unpack(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def words_of(stream: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of a stream: each one's place among the distinct words, these, and the text it stands in."""
    cuts = np.unique(starts[np.searchsorted(starts, np.arange(0, len(stream), _AT_ONCE), side="right") - 1])
    words, docs = [], []
    for lo, hi in zip(cuts, np.append(cuts[1:], len(stream)), strict=True):
        part = stream[lo:hi]
        end = part == END
        sign = end | (part == BLANK)
        stops = np.flatnonzero(sign)
        length = np.diff(stops, prepend=-1) - 1
        some = length > 0  # a text without words has an end sign alone
        doc = np.cumsum(end[stops]) - end[stops] + np.searchsorted(starts, lo)
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(length[some]))).astype(np.int32)
        spelled = pa.Array.from_buffers(pa.binary(), int(some.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(part[~sign])])
        words.append(spelled.dictionary_encode())
        docs.append(doc[some].astype(np.int32))
    if not words:
        return np.zeros(0, np.int32), pa.array([], pa.binary()), np.zeros(0, np.int32)
    chunks = pa.chunked_array(words).unify_dictionaries().chunks
    return np.concatenate([c.indices.to_numpy() for c in chunks]), chunks[-1].dictionary, np.concatenate(docs)


def _dealt_words(words: pa.Array, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Distinct words by bucket."""
    if not len(words):
        return
    data = np.frombuffer(words.buffers()[2], np.uint8)
    cut = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
    of = np.empty(len(words), np.int64)
    for at in range(0, len(words), 1 << 16):
        ends = cut[at : at + (1 << 16) + 1]
        of[at : at + (1 << 16)] = (run_hashes(data[ends[0] : ends[-1]], ends[:-1] - ends[0], ends[1:] - ends[0]) % np.uint64(buckets)).astype(np.int64)
    yield from _groups_of(of, buckets)


_SENT_NAMES = ["kind", "part", "batch", "a", "b", "c", "ids"]
_SENT = "kind int, part int, batch long, a binary, b binary, c binary, ids array<long>"


def _rows(kind: int, batch: int, part: list[int], a: list, b: list, c: list | None = None, ids: list | None = None) -> pa.RecordBatch:
    n = len(part)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(part, pa.int32()), pa.array(np.full(n, batch)), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.binary()) if c else pa.nulls(n, pa.binary()), pa.array(ids, pa.list_(pa.int64())) if ids else pa.nulls(n, pa.list_(pa.int64()))],
        _SENT_NAMES,
    )


def _forward(parts: int):
    """Per batch of documents: its streams (kind 0), its distinct words (1) and transitions (2) with training counts, dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            train = ~batch.column(2).to_numpy(zero_copy_only=False)
            size = batch.column(1).nbytes
            for lo, hi, _, _ in text_slices(batch.column(1), -(-size // max(1, -(-size // BATCH_BYTES)))):
                number += 1
                stream = np.concatenate([stream_of(d, o) for _, _, d, o in text_slices(batch.column(1).slice(lo, hi - lo), _AT_ONCE)])
                starts = doc_starts(stream)
                own = train[lo:hi]
                stops = np.append(starts[1:], len(stream))
                counter = Counter()
                for at, keys in transition_slices(stream, starts):
                    # One sort: the training flag is the lowest bit of what is sorted.
                    trained = own[np.searchsorted(stops, np.arange(at, at + len(keys)), side="right")]
                    both = np.sort((keys << np.uint64(1)) | trained.astype(np.uint64))
                    distinct = both >> np.uint64(1)
                    first = np.flatnonzero(np.append(True, distinct[1:] != distinct[:-1]))
                    counter.add(distinct[first], np.add.reduceat((both & np.uint64(1)).astype(np.int32), first))
                keys, counts = counter.total()
                yield _rows(0, number, [0], [_pack(stream)], [own.tobytes()], [_pack_keys(keys)], [batch.column(0).slice(lo, hi - lo).to_pylist()])
                dealt = list(_by_part(keys, parts))
                yield _rows(2, number, [p for p, _ in dealt], [_pack_keys(keys[at]) for _, at in dealt], [_pack(counts[at].astype(np.uint32)) for _, at in dealt])
                index, words, doc = words_of(stream, starts)
                n = np.bincount(index[own[doc]], minlength=len(words)).astype(np.uint32)
                dealt = list(_dealt_words(words, parts))
                yield _rows(1, number, [p for p, _ in dealt], [_pack(b"\n".join(words.take(pa.array(at)).to_pylist())) for _, at in dealt], [_pack(n[at]) for _, at in dealt])
                del dealt, index, words, doc, keys, counts, counter, stream
                give_back()

    return run


_VOCABULARY = "kind int, batch long, part int, n long, v long, told binary"


def _vocabulary(table: pa.Table) -> pa.Table:
    """A bucket's words: an answer with their training counts for each batch (kind 0), and the bucket's totals (1)."""
    words = [pa.array(zstandard.decompress(w).split(b"\n"), pa.binary()) for w in table.column("a").to_pylist()]
    index = pa.concat_arrays(words).dictionary_encode().indices.to_numpy()
    n = np.concatenate([_unpack(x, np.uint32) for x in table.column("b").to_pylist()])
    total = np.bincount(index, weights=n).astype(np.int64)
    cut = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    part = table.column("part")[0].as_py()
    rows = [(0, b, part, 0, 0, _pack(total[index[cut[i] : cut[i + 1]]])) for i, b in enumerate(table.column("batch").to_pylist())]
    rows.append((1, 0, part, int(total.sum()), int((total > 0).sum()), None))
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["kind", "batch", "part", "n", "v", "told"])


_MERGED = "part int, a binary, b binary, node binary, count binary, mixed binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come part by part: all training transitions of each, added up as they come, and its nodes at depth ``SPLIT``."""

    def close(part: int, counter: Counter) -> pa.RecordBatch:
        keys, counts = counter.total()
        node, count, mixed = split_nodes(keys, counts)
        blobs = [_pack_keys(keys), _pack(counts.astype(np.int64)), node.tobytes(), count.tobytes(), mixed.T.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], ["part", "a", "b", "node", "count", "mixed"])

    # Sums over all batches may be large: they are kept in 64 bits.
    part, counter = None, Counter()
    for batch in batches:
        for i in range(batch.num_rows):
            at, keys, counts = (batch.column(c)[i].as_py() for c in range(3))
            if at != part:
                if part is not None:
                    yield close(part, counter)
                    give_back()
                part, counter = at, Counter()
            n = _unpack(counts, np.uint32).astype(np.int64)
            counter.add(_unpack_keys(keys)[n > 0], n[n > 0])
    if part is not None:
        yield close(part, counter)
    counter = None
    give_back()


def _answer(top):
    """In each part the model comes first, then the batches that ask: log10 chances of what they ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for i in range(batch.num_rows):
                part, kind, number, a, b = (batch.column(c)[i].as_py() for c in range(5))
                if kind == 0:
                    tree = None
                    give_back()
                    tree = compile_part(_unpack_keys(a), _unpack(b, np.int64), top.value)
                else:
                    logs = _pack_logs(transition_logs(tree, _unpack_keys(a)))
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([1], pa.int32()), pa.array([part], pa.int32()), pa.array([logs], pa.binary())], ["batch", "kind", "part", "told"])

    return run


#: What a log10 chance is counted in between tasks: eight decisions of at least ``_LEAST`` fill 24 bits.
_STEP = 57 / (1 << 24)


def _pack_logs(logs: np.ndarray) -> bytes:
    """In steps of 3.4e-6, byte place by byte place."""
    steps = np.round(logs / -_STEP).astype("<u4")
    return _pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T[:3]))


def _unpack_steps(blob: bytes) -> np.ndarray:
    """How many steps below 0 each logarithm is."""
    planes = _unpack(blob, np.uint8).reshape(3, -1)
    steps = np.zeros((planes.shape[1], 4), np.uint8)
    steps[:, :3] = planes.T
    return steps.view("<u4").reshape(-1)


def stream_scores(stream: np.ndarray, starts: np.ndarray, distinct: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """log10 chance of each text of a stream, from the steps of its distinct transitions.

    Steps are whole numbers: sums are exact, wherever slices cut a text.
    """
    total = np.zeros(len(starts), np.int64)
    for at, keys in transition_slices(stream, starts):
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        found = steps[np.searchsorted(distinct, ordered[new])]
        each = np.empty(len(keys), np.int64)
        each[order] = found[np.cumsum(new) - 1]
        lo, hi = np.searchsorted(starts, at, side="right") - 1, np.searchsorted(starts, at + len(keys))
        total[lo:hi] += np.add.reduceat(each, np.maximum(starts[lo:hi] - at, 0))
    return total * -_STEP


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text by a model of the rows for which ``held_out`` is false.

    Returns ``(id, held_out, n_tokens, n_known, train_tokens, base_score,
    score)``: ``score`` is the log10 probability of the text's stream (words,
    the blanks between them, and the end) under context-tree weighting,
    ``base_score`` under smoothed word counts (``log10((c + 0.1) / (N + 0.1
    (V + 1)))`` per token, the end counted as a token), ``n_known`` the tokens
    that occur in training.  Null, empty and blank texts are an end alone.  A
    null ``held_out`` counts as held out.  Equal texts have equal scores;
    repeated and null ids keep a row each; other columns are not read.  Without
    training rows every bit has an even chance.  Word counts and the tree cover
    all training rows; both grow with the corpus and stay dealt over tasks.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.coalesce(held_out, F.lit(True)).alias("h"))
    sent = staged(slim.mapInArrow(_forward(parts), _SENT))
    found = staged(sent.where("kind = 1").select("part", "batch", "a", "b").groupBy("part").applyInArrow(_vocabulary, _VOCABULARY))
    ends = slim.agg(F.sum((~F.col("h")).cast("long"))).first()[0] or 0
    totals = found.where("kind = 1").agg(F.sum("n"), F.sum("v")).first()
    n_train, n_distinct = (totals[0] or 0) + ends, (totals[1] or 0) + (ends > 0)
    transitions = sent.where("kind = 2")
    merged = staged(transitions.select("part", "a", "b").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_merge, _MERGED))
    rows = merged.select("node", "count", "mixed").toArrow()
    node, count, mixed = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("node", np.uint64), ("count", np.int64), ("mixed", float)))
    top = spark.sparkContext.broadcast(compile_top(node, count, mixed.reshape(-1, 8).T))
    models = merged.select("part", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("batch"), "a", "b")
    asked = models.unionByName(transitions.select("part", F.lit(1).alias("kind"), "batch", "a", F.lit(None).cast("binary").alias("b")))
    told = asked.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_answer(top), "batch long, kind int, part int, told binary")
    base_of = np.log10(n_train + 0.1 * (n_distinct + 1))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                blobs = [batch.column(k)[i].as_py() for k in ("a", "b", "c")]
                stream, train, distinct = _unpack(blobs[0], np.uint8), np.frombuffer(blobs[1], bool), _unpack_keys(blobs[2])
                starts = doc_starts(stream)
                answers = {(x["kind"], x["part"]): x["told"] for x in batch.column("answers")[i].as_py()}
                steps = np.zeros(len(distinct), np.uint32)
                for p, at in _by_part(distinct, parts):
                    steps[at] = _unpack_steps(answers.pop((1, p)))
                score = stream_scores(stream, starts, distinct, steps)
                del blobs, distinct, steps
                give_back()
                index, words, doc = words_of(stream, starts)
                counts = np.zeros(len(words), np.int64)
                for p, at in _dealt_words(words, parts):
                    counts[at] = _unpack(answers[0, p], np.int64)
                n = len(train)
                base = np.bincount(doc, weights=np.log10(counts + 0.1)[index], minlength=n) + np.log10(ends + 0.1)
                known = np.bincount(doc, weights=(counts > 0)[index], minlength=n).astype(np.int64) + (ends > 0)
                tokens = np.bincount(doc, minlength=n) + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, pa.array(~train), pa.array(tokens), pa.array(known), pa.array(np.full(n, n_train, np.int64)), pa.array(base - tokens * base_of), pa.array(score)],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                del stream, starts, index, words, doc, counts, answers
                give_back()

    counts_of = found.where("kind = 0").select("batch", "kind", "part", "told")
    answers = counts_of.unionByName(told).groupBy("batch").agg(F.collect_list(F.struct("kind", "part", "told")).alias("answers"))
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return sent.where("kind = 0").select("batch", "a", "b", "c", "ids").join(answers, "batch").mapInArrow(final, schema)
