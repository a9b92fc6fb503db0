"""SentencePiece encoding and decoding, giant documents by a parallel scan.

A sequence of pieces is the encoding of a text exactly if each two neighbours
are the encoding of what they spell together, so encoding is a path search in
the max-plus semiring: a step from one piece to the next weighs 0 if the two
may stand together and minus infinity if not.  A giant document is cut into
chunks anywhere.  The state at a cut is the piece that covers the character
before it and how far it reaches over.  Each chunk yields, for all states it
may be entered in, the states it can be left in (the finite entries of its
transfer matrix); the matrices combine associatively to the states that lie on
the one full path, and with those each chunk is traced back by itself.

Other documents are encoded unit by unit, as no piece has a blank inside, and
whole by the library where the text itself holds the vocabulary's blank sign.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

GIANT_CHARS = 60_000
CHUNK_CHARS = 8_192
_BLANK = "▁"
_UNITS = re.compile(r"(?<=[^ ]) ")
_CACHE = 150_000

State = tuple[int, int]


class PieceModel:
    """A byte-fallback BPE model of SentencePiece with identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.sp.get_piece_size()
        normal = [i for i in range(size) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        self.id_of = {self.sp.id_to_piece(i): i for i in normal}
        if any(_BLANK in p.lstrip(_BLANK) for p in self.id_of):
            raise ValueError("pieces with a blank inside are not supported")
        self.text_of = {i: p for p, i in self.id_of.items()}
        self.score = {p: self.sp.get_score(i) for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        self.byte_of = {i: int(self.sp.id_to_piece(i)[3:5], 16) for i in range(size) if self.sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.raw = [b"" if i not in self.text_of and i not in self.byte_of else (bytes([self.byte_of[i]]) if i in self.byte_of else self.text_of[i].replace(_BLANK, " ").encode()) for i in range(size)]
        self.cache: dict[str, list[int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    # Whole texts

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if _BLANK in text:  # a written sign joins with blanks beside it
            return self.sp.encode(text)
        if len(self.cache) > _CACHE:
            self.cache.clear()
        out: list[int] = []
        for unit in _UNITS.split(text):
            ids = self.cache.get(unit)
            if ids is None:
                # A unit after the first stands for a blank and its text: the prefix that the library adds.
                ids = self.sp.encode(unit) if unit else [self.id_of[_BLANK]]
                if len(unit) < 64:
                    self.cache[unit] = ids
            out += ids
        return out

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """Bytes of a text from its ids; the blank put before the text is taken off."""
        raw = b"".join([self.raw[i] for i in ids])
        return raw[1:] if raw[:1] == b" " else raw

    # The path search

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging neighbours, the best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: str | None, b: str) -> bool:
        key = (a or "", b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merged((a or "") + b) == ([a, b] if a else [b])
        return known

    def steps(self, text: str, start: int, piece: str | None, stop: int) -> list[str | None]:
        """For every end up to ``stop``: the last piece of the encoding from ``start`` on, after ``piece``."""
        last: list[str | None] = [None] * (len(text) + 1)
        reached = [False] * (len(text) + 1)
        last[start], reached[start] = piece, True
        ids, longest = self.id_of, self.longest
        for p in range(start + 1, stop + 1):
            for n in range(1, min(longest, p - start) + 1):
                q = p - n
                if reached[q]:
                    t = text[q:p]
                    # A single character that is no piece stands for its bytes and joins with nothing.
                    if (n == 1 or t in ids) and self.may_follow(last[q], t):
                        last[p], reached[p] = t, True
                        break
        return last

    def entries(self, text: str, cut: int) -> list[tuple[str, int]]:
        """States in which a cut may be passed: pieces over the character before it, and their reach."""
        out = []
        for begin in range(max(0, cut - self.longest), cut):
            for end in range(cut, min(len(text), begin + self.longest) + 1):
                t = text[begin:end]
                if (end - begin == 1 or t in self.id_of) and self.merged(t) == [t]:
                    out.append((t, end - cut))
        return out

    def transfer(self, text: str, begin: int, end: int, whole_start: bool) -> dict[tuple[str, int], list[tuple[str, int]]]:
        """Finite entries of a chunk's matrix: entering states to the states it can be left in.

        ``text`` has margins of one piece's length around ``begin:end``.
        """
        stop = min(len(text), end + self.longest - 1)
        entering: list[tuple[str, int]] = [("", 0)] if whole_start else self.entries(text, begin)
        out: dict[tuple[str, int], list[tuple[str, int]]] = {}
        same: dict[tuple[str, int], list[tuple[str, int]]] = {}
        for piece, reach in entering:
            at = begin + reach
            if at >= end and piece:
                out[piece, reach] = [(piece, at - end)]
                continue
            # Paths that stand on the same piece at the same place go on alike: a short look ahead tells most apart.
            probe = min(stop, at + 4 * self.longest)
            ahead = self.steps(text, at, piece or None, probe)
            if not any(ahead[p] for p in range(max(at + 1, probe - self.longest), probe + 1)):
                out[piece, reach] = []
                continue
            tail = tuple((p, ahead[p]) for p in range(probe - self.longest, probe + 1)) if probe < stop else None
            if tail is not None and tail in same:
                out[piece, reach] = same[tail]
                continue
            last = self.steps(text, at, piece or None, stop)
            left = [(last[p], p - end) for p in range(end, stop + 1) if last[p] and p - len(last[p]) < end]
            out[piece, reach] = left
            if tail is not None:
                same[tail] = left
        return out

    def trace(self, text: str, begin: int, end: int, entry: tuple[str, int], leave: tuple[str, int]) -> list[int]:
        """Ids of the pieces that begin in a chunk, given the states it is entered and left in."""
        at, stop = begin + entry[1], end + leave[1]
        if at >= stop:
            return []
        last = self.steps(text, at, entry[0] or None, stop)
        found: list[str] = []
        p = stop
        while p > at:
            found.append(last[p])
            p -= len(last[p])
        out: list[int] = []
        for t in reversed(found):
            i = self.id_of.get(t)
            out += [i] if i is not None else [self.byte_id[b] for b in t.encode("utf-8", "surrogatepass")]
        return out


def normal_form(text: str) -> str:
    return _BLANK + text.replace(" ", _BLANK) if text else ""


def combine(a: dict, b: dict) -> dict:
    """Product of two transfer matrices: where a can be left in a state that b can be entered in."""
    return {s: sorted({u for t in ts for u in b.get(t, ())}) for s, ts in a.items()}


def path_states(matrices: list[dict], last: tuple[str, int] | None = None) -> list[tuple[str, int]]:
    """States at all cuts of the one path from the start to an end that nothing reaches over.

    Products of runs of chunks are built pairwise; going down again, each half
    gets the state between the two.
    """
    if len(matrices) == 1:
        return []
    levels = [matrices]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([combine(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    states = {0: ("", 0), len(matrices): next(t for t in levels[-1][0]["", 0] if t[1] == 0)}
    for depth in range(len(levels) - 2, -1, -1):
        row, width = levels[depth], 1 << depth
        for i in range(0, len(row) - 1, 2):
            begin, middle, end = i * width, (i + 1) * width, min((i + 2) * width, len(matrices))
            states[middle] = next(t for t in row[i][states[begin]] if states[end] in row[i + 1].get(t, ()))
    return [states[i] for i in range(1, len(matrices))]


_CHUNK = "id long, row long, no int, begin int, end int, part string, final boolean"


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT_CHARS, chunk: int = CHUNK_CHARS) -> DataFrame:
    """Encode and decode every whole text: ``(id, n_pieces, ids_crc32, ids, decoded_sha256, round_trip)``.

    ``ids`` are little-endian unsigned 32-bit numbers, equal to the library's
    ``encode``; ``decoded_sha256`` is of the bytes they decode to and
    ``round_trip`` whether these are the text.  Null and empty texts have no
    pieces.  Documents of at least ``giant`` characters go through the
    parallel scan.  Repeated rows keep a row each; other columns are not read.
    A text that holds the blank sign of the vocabulary itself decodes to a
    blank there, as in the library, and ``round_trip`` says so.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = "id long, n_pieces long, ids_crc32 long, ids binary, decoded_sha256 string, round_trip boolean"

    def finish(ids: list, encoded: list[np.ndarray], raw: list[bytes], originals: list[bytes]) -> pa.RecordBatch:
        blobs = [x.tobytes() for x in encoded]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(x) for x in encoded], pa.int64()), pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array(blobs, pa.binary()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array([r == o for r, o in zip(raw, originals, strict=True)], pa.bool_())],
            ["id", "n_pieces", "ids_crc32", "ids", "decoded_sha256", "round_trip"],
        )

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(1).to_pylist()
                encoded = [np.array(model.encode(t), "<u4") for t in texts]
                yield finish(batch.column(0).to_pylist(), encoded, [model.decode(e.tolist()) for e in encoded], [t.encode() for t in texts])

    small = rows.where(F.length("t") < giant).mapInArrow(plain, schema)
    big = rows.where(F.length("t") >= giant).withColumn("row", F.xxhash64("id", "t"))
    margin = 64

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk with its margins; a text is gone through once."""
        names = [c.split()[0] for c in _CHUNK.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
        for batch in batches:
            for key, row, t in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = normal_form(t.as_py())
                for first in range(0, len(text), 64 * chunk):
                    rows = []
                    for begin in range(first, min(first + 64 * chunk, len(text)), chunk):
                        low = max(0, begin - margin)
                        rows.append((key.as_py(), row.as_py(), begin // chunk, begin - low, min(len(text), begin + chunk) - low, text[low : begin + chunk + margin], len(text) <= begin + chunk))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)

    cut = big.dropDuplicates(["id", "row"]).select("id", "row", "t").mapInArrow(chunks, _CHUNK)
    cut = staged(cut.repartition("row", "no"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        model = PieceModel(model_path)
        for batch in batches:
            out = [pickle.dumps(model.transfer(r["part"], r["begin"], r["end"], r["no"] == 0)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["id", "row", "no", "m"])

    def states(table: pa.Table) -> pa.Table:
        import pickle

        found = sorted(zip(table.column("no").to_pylist(), table.column("m").to_pylist(), strict=True))
        between = path_states([pickle.loads(m) for _, m in found])
        at = [("", 0), *between, None]
        numbers = [n for n, _ in found]
        rows = [(table.column("id")[0].as_py(), table.column("row")[0].as_py(), n, *at[i], *(at[i + 1] or (None, 0))) for i, n in enumerate(numbers)]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "row", "no", "piece", "reach", "next_piece", "next_reach"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        for batch in batches:
            out = [np.array(model.trace(r["part"], r["begin"], r["end"], (r["piece"], r["reach"]), (r["next_piece"], r["next_reach"])), "<u4").tobytes() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["id", "row", "no", "ids"])

    on = cut.mapInArrow(matrices, "id long, row long, no int, m binary").groupBy("id", "row").applyInArrow(states, "id long, row long, no int, piece string, reach int, next_piece string, next_reach int")
    parts = cut.join(on.drop("id"), ["row", "no"]).select("id", "row", "no", "begin", "end", "part", "piece", "reach", "next_piece", "next_reach")
    parts = parts.mapInArrow(traced, "id long, row long, no int, ids binary").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in r["parts"]), "<u4")
                yield finish([r["id"]], [ids], [model.decode(ids.tolist())], [r["t"].encode()])

    return small.unionByName(big.join(parts, "row").select("id", "t", "parts").mapInArrow(joined, schema))
