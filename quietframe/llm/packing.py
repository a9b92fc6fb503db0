"""Vector bin packing of tokenized examples into sequences.

A sequence has room in three dimensions: tokens, segments and loss-bearing
tokens.  The first part of an example is its prompt, which bears no loss; the
rest does.  Every example longer than a sequence first gives off pieces that
fill one, or its room for loss-bearing tokens; these and what is left are
packed, block by block, by the dot-product heuristic: the open sequence takes
the piece whose demand, in units of the room, is most aligned with what room is
left.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, staged, text_slices

SEQUENCE_TOKENS = 2048
MAX_SEGMENTS = 128
#: Loss-bearing tokens of a sequence; the other tokens of it are prompts.
MAX_LOSS_TOKENS = 1792
#: One in so many tokens of an example, from its beginning, is prompt.
PROMPT_PART = 3
END_ID = 1
#: Tails that one task packs together: many enough for little padding, few enough for any executor.
BLOCK_TAILS = 4096
#: Distinct units that a task keeps at most.
_KEPT_UNITS = 400_000
_SLICE = 2 << 20
#: Bytes of text and keys that a task is handed at once, about two slices.
_BATCH_BYTES = 2 * _SLICE
#: The bytes with which a white-space character beyond ASCII begins, and its last two bytes.
_WIDE_SPACE_FIRST = (0xC2, 0xE1, 0xE2, 0xE3)
_WIDE_SPACE_END = ((0xC2, 0x80, 0x81, 0x9A), (0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF))


def _table(values) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(values)] = True
    return found


_PLAIN = _table([*range(0x21, 0x7F), *range(0x80, 0x100)])
_FIRST, _SECOND_LAST, _LAST = _table(_WIDE_SPACE_FIRST), _table(_WIDE_SPACE_END[0]), _table(_WIDE_SPACE_END[1])


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Blanks that stand alone between two characters that are no white space; where that is in doubt, none."""
    at = np.flatnonzero(data[1:-1] == 0x20) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    before, after = data[at - 1], data[at + 1]
    wide = _LAST[before] & _SECOND_LAST[data[np.maximum(at - 2, 0)]]
    return at[_PLAIN[before] & _PLAIN[after] & ~_FIRST[after] & ~wide]


class UnitTokenizer:
    """Byte-level BPE of whole texts by way of their distinct units.

    The split rule of such a vocabulary never joins what stands on both sides
    of a single blank between two characters that are no white space, so a
    text's ids are the ids of ``word``, `` word``, ...; each distinct unit of a
    slice of texts is encoded once, by ``tokenizers``.  A text that holds the
    vocabulary's special token is encoded whole, as the library cuts that
    out first.
    """

    def __init__(self, json_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json_path)
        self.special = [t.content.encode() for t in self.full.get_added_tokens_decoder().values()]
        # Every byte of a text is one character of the vocabulary's entries.
        self.bytes_of = np.zeros(self.full.get_vocab_size(), np.int64)
        for token, i in self.full.get_vocab().items():
            self.bytes_of[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.cut = pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, new: pa.Array) -> None:
        """Encode units that are not known, and keep them."""
        size = pc.binary_length(new).to_numpy()
        raw = b"".join(new.to_pylist())
        ends = np.cumsum(size)
        # Units that begin with a blank are encoded as one text; its ids are dealt out by the bytes they stand for.
        first = np.frombuffer(raw, np.uint8)[ends - size]
        breaks = np.flatnonzero((first != 0x20) | (np.arange(len(size)) % 500 == 0))
        at = np.append((ends - size)[breaks], len(raw))
        texts = [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        ids = [np.array(e.ids, np.uint32) for i in range(0, len(texts), 50) for e in self.full.encode_batch_fast(texts[i : i + 50], add_special_tokens=False)]
        flat = np.concatenate(ids)
        cut = np.searchsorted(np.cumsum(self.bytes_of[flat]), ends, side="right")
        self.cut = np.concatenate((self.cut, self.cut[-1] + cut))
        self.flat = np.concatenate((self.flat, flat))
        self.known = pa.concat_arrays([self.known, new])

    def units(self, units: pa.Array) -> np.ndarray:
        """Where each of some distinct units stands among the known ones."""
        at = pc.index_in(units, value_set=self.known)
        if at.null_count:
            if len(self.known) > _KEPT_UNITS:
                self._forget()
                at = pc.index_in(units, value_set=self.known)
            missing = pc.is_null(at)
            before = len(self.known)
            self._learn(units.filter(missing))
            missing = missing.to_numpy(zero_copy_only=False)
            at = np.where(missing, before + np.cumsum(missing) - 1, at.fill_null(0).to_numpy())
            return at
        return at.to_numpy().astype(np.int64)

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts, each followed by the end id, and where each text's begin."""
        n = len(offsets) - 1
        raw = data.tobytes()
        # Texts that begin where another does are empty; each text is at least the unit of its end.
        cuts = np.sort(np.concatenate((unit_starts(data), offsets[:-1][np.diff(offsets) > 0])))
        bounds = np.append(cuts, len(data)).astype(np.int32)
        spelled = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        known = self.units(spelled.dictionary)[spelled.indices.to_numpy()]
        begin, size = self.cut[known], self.cut[known + 1] - self.cut[known]
        # The end id of each text stands after its last unit.
        ends = np.searchsorted(cuts, offsets[1:])
        upto = np.concatenate(([0], np.cumsum(size)))
        per_text = upto[ends] + np.arange(1, n + 1)
        out = np.empty(int(per_text[-1]), np.uint32)
        inside = np.ones(len(out), bool)
        inside[per_text - 1] = False
        out[per_text - 1] = END_ID
        out[inside] = self.flat[np.repeat(begin - upto[:-1], size) + np.arange(int(upto[-1]))]
        per_text = np.append(0, per_text)
        special = [i for i in range(n) if any(x in raw[offsets[i] : offsets[i + 1]] for x in self.special)] if any(x in raw for x in self.special) else []
        if special:
            parts = [out[per_text[i] : per_text[i + 1]] for i in range(n)]
            for i in special:
                parts[i] = np.append(self.whole(raw[offsets[i] : offsets[i + 1]].decode()), np.uint32(END_ID))
            out, per_text = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return out, per_text

    def encode(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_slice(raw, np.array([0, len(raw)]))[0][:-1]


def piece_sizes(n: int, length: int, max_loss: int, prompt: int) -> list[int]:
    """Sizes of the pieces of an example of ``n`` tokens of which the first ``prompt`` bear no loss.

    One piece if it fits a sequence.  Else the loss-bearing part is cut at
    ``max_loss``, and the prompt into as many pieces of the room beside such a
    one as there are of them, and pieces of whole sequences.
    """
    if n <= length and n - prompt <= max_loss:
        return [n]
    bearing = [max_loss] * ((n - prompt) // max_loss) + [(n - prompt) % max_loss]
    beside = length - max_loss
    fillers = min(len(bearing) - 1, prompt // beside) if beside else 0
    rest = prompt - fillers * beside
    found = [length] * (rest // length) + [rest % length] + [beside] * fillers + bearing
    return [x for x in found if x]


def pieces(docs: DataFrame, tokenizer: dict[str, str], id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE_TOKENS, max_loss: int | None = None, prompt_part: int = PROMPT_PART) -> DataFrame:
    """Tokenize and cut: rows ``(id, row_key, start, length, ids_crc32, doc_tokens, loss)``.

    ``tokenizer`` holds the arguments of :class:`UnitTokenizer`.  Every text is
    followed by one end id; null and empty texts are that id alone.  The first
    ``1 / prompt_part`` of a text's tokens (rounded down) is its prompt; ``loss``
    counts a piece's other tokens, at most ``max_loss`` (by default ``length``).
    See :func:`piece_sizes` for the cuts.  ``row_key`` tells repeated ids apart.
    """
    most = max_loss or length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitTokenizer(**tokenizer)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), _SLICE):
                ids, cut = encoder.encode_slice(data, offsets)
                total = np.diff(cut)
                prompt = total // prompt_part
                n = np.ones(hi - lo, np.int64)
                long = np.flatnonzero((total > length) | (total - prompt > most))
                sizes = [piece_sizes(int(total[i]), length, most, int(prompt[i])) for i in long]
                n[long] = [len(x) for x in sizes]
                row = np.repeat(np.arange(hi - lo), n)
                size = total[row].copy()
                size[n[row] > 1] = [x for each in sizes if len(each) > 1 for x in each]
                ends = np.cumsum(size)
                start = ends - size - np.repeat(cut[:-1], n)
                loss = np.maximum(start + size - np.maximum(start, prompt[row]), 0)
                raw = memoryview(ids.astype("<u4").tobytes())
                begin = (cut[row] + start).tolist()
                sums = [zlib.crc32(raw[4 * b : 4 * (b + m)]) for b, m in zip(begin, size.tolist(), strict=True)]
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(start), pa.array(size), pa.array(sums, pa.int64()), pa.array(total[row]), pa.array(loss)], ["id", "row_key", "start", "length", "ids_crc32", "doc_tokens", "loss"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"))
    return slim.mapInArrow(run, "id long, row_key long, start long, length long, ids_crc32 long, doc_tokens long, loss long")


def dot_product_pack(demand: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item and its order in the bin.

    ``demand`` has a row per item and a column per dimension, ``room`` what a
    bin holds of each.  One bin is open at a time; it takes the fitting item
    with the largest dot product of demand and remaining room (both in units
    of ``room``), the first of equals, until none fits.  Items of the same
    demand are kept as one class, so a step costs the number of classes, not
    of items.  An item beyond ``room`` raises an error.
    """
    if (demand > room).any():
        raise ValueError("an item is larger than a bin")
    kinds, kind_of = np.unique(demand, axis=0, return_inverse=True)
    kind_of = kind_of.reshape(-1)
    order = np.argsort(kind_of, kind="stable")
    first = np.searchsorted(kind_of[order], np.arange(len(kinds)))
    left = np.bincount(kind_of, minlength=len(kinds))
    scaled = kinds / room
    bins, places = np.zeros(len(demand), np.int64), np.zeros(len(demand), np.int64)
    number, remaining, gone = -1, len(demand), 0
    while remaining:
        number += 1
        free, place = room.copy(), 0
        while True:
            # Kinds ascend in their first dimension: what fits there comes first.
            upto = int(np.searchsorted(kinds[:, 0], free[0], side="right"))
            fits = left[:upto] > 0
            for c in range(1, kinds.shape[1]):
                fits &= kinds[:upto, c] <= free[c]
            value = np.where(fits, scaled[:upto] @ (free / room), -1.0)
            k = int(value.argmax()) if upto else 0
            if not upto or not fits[k]:
                break
            item = order[first[k]]
            first[k] += 1
            left[k] -= 1
            gone += left[k] == 0
            remaining -= 1
            bins[item], places[item] = number, place
            place += 1
            free = free - kinds[k]
        if 2 * gone > len(kinds):  # kinds that are used up are left out from now on
            keep = left > 0
            kinds, scaled, first, left, gone = kinds[keep], scaled[keep], first[keep], left[keep], 0
    return bins, places


def pack(cut: DataFrame, length: int = SEQUENCE_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, loss_col: str = "loss") -> DataFrame:
    """Place pieces into sequences: adds ``sequence_id`` and ``offset``.

    ``cut`` has ``id, row_key, start, length, ...``.  Limits of a sequence:
    ``length`` tokens, ``max_segments`` pieces, ``max_loss`` loss-bearing
    tokens (by default as many as tokens), which ``loss_col`` counts.  Full
    pieces are sequences of their own.  Blocks of about ``BLOCK_TAILS`` pieces, dealt in the order of
    the staged rows, are packed independently, so a lost task is redone alone and
    gives the same result; each leaves at most its last few sequences unfilled.
    Sequence ids are unique, not dense.  An empty table gives no rows.
    """
    max_loss = max_loss or length
    with batches_of(cut.sparkSession, _BATCH_BYTES):
        cut = staged(cut.withColumn("_loss", F.col(loss_col)))
    blocks = max(1, -(-cut.where(F.col("length") < length).count() // BLOCK_TAILS))
    names = [c for c in cut.columns if c != "_loss"]
    full = (F.col("length") == length) & (F.col("_loss") <= max_loss)
    # A full piece needs an id of its own: a running number of the staged rows, below all block ids.
    whole = cut.where(full).select(*names).withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    room = np.array([length, max_segments, max_loss])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "row_key", "start"], kind="stable").reset_index(drop=True)
        demand = np.stack([pdf["length"].to_numpy(), np.ones(len(pdf), np.int64), pdf["_loss"].to_numpy()], 1)
        bins, places = dot_product_pack(demand, room)
        pdf["sequence_id"] = pdf["block"].to_numpy(np.int64) * (1 << 32) + bins
        pdf = pdf.iloc[np.lexsort((places, bins))]
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf[[*names, "sequence_id", "offset"]]

    schema = ", ".join(f"`{n}` {cut.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"
    # Dealt in turn, not by a hash: repeated rows spread like any others.
    block = F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")
    packed = cut.withColumn("block", block).where(~full).groupBy("block").applyInPandas(one, schema)
    return whole.unionByName(packed)
