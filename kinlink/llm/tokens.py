"""Operator 5: token ids in a Simple-8b word-aligned format.

Format (little-endian), one Parquet row per block of whole documents; Spark commits the rows,
so the files lie in any store and survive lost executors. ``payload`` is
    b"S8B2", uint32 n_docs, uint32 n_ids, uint32 n_words, uint32 n_escapes,
    uint32[n_docs + 1]  id offset of each document inside the block,
    uint32[n_segs + 1]  word offset of each segment of SEGMENT ids,
    uint32[n_escapes]   positions of ids of 60 bits or more, uint64[n_escapes] their values,
    uint64[n_words]     words: 4-bit selector on top, then 60 bits of data, first id lowest.
Selectors 0 and 1 stand for 240 and 120 zeros; selector s > 1 packs 60 // w ids of w bits. A segment
begins a word, and the last word of one is filled with zeros, so all segments of a block are coded and decoded
side by side, all words of one selector in one vectorised step.

Defined results: null text is empty; each document gets the end id; null doc_id comes first;
repeated rows are encoded each and are dealt apart, however many; equal doc_ids are ordered by a hash of the text; a text
of any length is encoded whole, in pieces cut where its ids cannot change; an empty table gives
no blocks; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freeing, row_key, stage

END_ID = 2
#: Ids of a block, and of a segment of it.
BLOCK_IDS = 1 << 19
SEGMENT = 512
#: Bytes of text that are encoded at a time, unless one text is longer.
SLICE_BYTES = 12 << 20
#: Pieces whose ids a task holds; beyond that it keeps those that its last texts repeat. Results don't depend on it.
HELD_PIECES = 400_000
#: Fixed values of Simple-8b: ids in a word and bits of an id, by selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_WIDTHS = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)


def _widths(v: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    out, high, base = np.zeros(len(v), np.uint8), v, 0
    while True:
        part = _WIDTHS[high & np.uint64(0xFFFF)]
        np.copyto(out, part + np.uint8(base), where=part > 0)
        high, base = high >> np.uint64(16), base + 16
        if not high.any():
            return out


def _rows(v: np.ndarray) -> np.ndarray:
    """A row for each segment, with room for the longest word behind it."""
    n = -(-len(v) // SEGMENT)
    out = np.zeros((n, SEGMENT + COUNTS[0]), v.dtype)
    whole = len(v) // SEGMENT
    out[:whole, :SEGMENT] = v[: whole * SEGMENT].reshape(whole, SEGMENT)
    out[whole:, : len(v) - whole * SEGMENT] = v[whole * SEGMENT :]
    return out


def _selectors(widths: np.ndarray) -> np.ndarray:
    """For each place the selector of the word that would start there: that of most ids which all fit."""
    most, held = widths[:, :SEGMENT], 1
    best = np.full(most.shape, len(COUNTS) - 1, np.uint8)
    wide, length = widths, widths.shape[1]
    for s in range(len(COUNTS) - 2, -1, -1):
        # The largest of COUNTS[s] neighbours, from that of the held ones; past the row's end nothing needs bits.
        while held < COUNTS[s]:
            step = min(held, COUNTS[s] - held)
            wide = np.maximum(wide[:, : length - held - step + 1], wide[:, step : length - held + 1])
            held += step
        best[wide[:, :SEGMENT] <= BITS[s]] = s
    return best


def simple8b_encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, word offsets of the segments, escape positions and escape values."""
    v = np.asarray(ids, dtype=np.uint64).copy()
    big = np.flatnonzero(v >> np.uint64(60))
    values = v[big].copy()
    v[big] = 0
    if not len(v):
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), big.astype(np.uint32), values
    rows = _rows(v)
    best = _selectors(_rows(_widths(v)))
    # All segments step from word to word together.
    row, at, count = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.array(COUNTS)
    end = np.full(len(rows), SEGMENT)
    end[-1] = len(v) - SEGMENT * (len(rows) - 1)
    steps = []
    while len(row):
        sel = best[row, at]
        steps.append((row, at, sel))
        after = at + count[sel]
        on = after < end
        row, at, end = row[on], after[on], end[on]
    row, at, sel = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(row, kind="stable")
    row, at, sel = row[order], at[order], sel[order].astype(np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    flat, place = rows.ravel(), row * rows.shape[1] + at
    for s in np.unique(sel).tolist():
        if BITS[s]:
            k = np.flatnonzero(sel == s)
            for j in range(COUNTS[s]):
                words[k] |= flat[place[k] + j] << np.uint64(j * BITS[s])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))]).astype(np.uint32)
    return words, offsets, big.astype(np.uint32), values


def simple8b_decode(words: np.ndarray, offsets: np.ndarray, n: int, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = np.array(COUNTS)[sel]
    before = np.cumsum(count) - count
    per = np.diff(offsets.astype(np.int64))
    row = np.repeat(np.arange(len(per)), per)
    width = SEGMENT + COUNTS[0]
    out = np.zeros(len(per) * width, np.uint64)
    place = row * width + before - np.repeat(before[offsets[:-1]] if len(per) else before[:0], per)
    for s in np.unique(sel).tolist():
        if BITS[s]:
            k = np.flatnonzero(sel == s)
            mask = np.uint64((1 << BITS[s]) - 1)
            for j in range(COUNTS[s]):
                out[place[k] + j] = (words[k] >> np.uint64(j * BITS[s])) & mask
    out = out.reshape(-1, width)[:, :SEGMENT].ravel()[:n]
    out[places] = values
    return out


def pack_block(docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs)
    words, segments, places, values = simple8b_encode(ids)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.uint32)
    head = np.array([len(docs), len(ids), len(words), len(places)], np.uint32)
    return b"S8B2" + head.tobytes() + offsets.tobytes() + segments.tobytes() + places.tobytes() + values.tobytes() + words.tobytes()


def unpack_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of a block."""
    if data[:4] != b"S8B2":
        raise ValueError("not a Simple-8b block")
    n_docs, n_ids, n_words, n_esc = np.frombuffer(data, np.uint32, 4, 4).tolist()
    at = 20

    def take(kind: type, n: int) -> np.ndarray:
        nonlocal at
        size = n * np.dtype(kind).itemsize
        at += size
        return np.frombuffer(data[at - size : at], kind)

    offsets, segments = take(np.uint32, n_docs + 1), take(np.uint32, -(-n_ids // SEGMENT) + 1)
    places, values = take(np.uint32, n_esc), take(np.uint64, n_esc)
    return offsets, simple8b_decode(take(np.uint64, n_words), segments, n_ids, places, values)


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each span, one span behind the other."""
    total = np.cumsum(size)
    return np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)


#: White space beside white space: such texts are not cut there.
_OTHER = r"\x09\x0B-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_ODD = rf" [{_OTHER}\n ]|[{_OTHER}\n] |[{_OTHER}]\n|\n[{_OTHER}]|\n\n\n|\n\n$|^[\n ]| $"
#: Words of these characters only, which are letters, digits and signs in all versions of Unicode, are split by _PARTS.
_PLAIN = r"^[\n ]?[\x21-\x7E\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]*$"
#: Fixed value: the pre-tokenizer's pattern, without white space before white space.
_PARTS = r"(?:'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s)"
_MARK = "\x01"


def _marked(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(texts, "\n", f"{_MARK}\n"), " ", f"{_MARK} ")


class Encoder:
    """Encodes whole texts with the tokenizers library, each different piece once.

    A byte-level pre-tokenizer never joins text across a space, or before a line end, that stands alone between two
    other characters, so a text is cut there, and plain words are cut further by the pre-tokenizer's
    pattern; the model's merges see one piece at a time. All else is given to the whole tokenizer, and so are
    texts that hold an added token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None or not isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) or self.tokenizer.pre_tokenizer.add_prefix_space:
            raise ValueError("a byte-level tokenizer without normalizer or prefix is needed")
        #: The model alone, over pieces that a byte parts which is in no merge.
        self.merges = Tokenizer(self.tokenizer.model)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.table = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)} | {1: 255}
        self.lone = re.compile(r"(?<=\S) (?=\S)")
        self.end = self.merges.token_to_id(chr(255))
        if any(chr(255) in t for t in self.merges.get_vocab() if len(t) > 1):
            raise ValueError("no byte is free to part pieces")
        self.whole = [_MARK, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has."""
        plain = pc.match_substring_regex(pieces, _PLAIN)
        text = pieces.filter(plain).to_pylist()
        joined = [_MARK.join([*text[i : i + 128], ""]).encode().decode("latin1").translate(self.table) for i in range(0, len(text), 128)]
        got = [np.array(e.ids, np.int32) for e in self.merges.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate([*got, np.zeros(0, np.int32)])
        size = np.diff(np.flatnonzero(ids == self.end), prepend=-1) - 1
        ids = ids[ids != self.end]
        if len(text) == len(pieces):
            return ids, size
        other = self._library(pieces.filter(pc.invert(plain)).to_pylist())
        ok = plain.to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(pieces), np.int64)
        sizes[ok], sizes[~ok] = size, [len(x) for x in other]
        out, own = np.zeros(sizes.sum(), np.int32), np.repeat(ok, sizes)
        out[own], out[~own] = ids, np.concatenate(other)
        return out, sizes


class _Pieces:
    """The ids of the pieces that a task has met, as flat arrays."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.held = pa.array([], pa.string())
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def of(self, found: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and lengths of different pieces' ids, and the ids. counts: how often each was met just now."""
        at = pc.index_in(found, value_set=self.held)
        new = pc.is_null(at)
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        missing, k = found.filter(new), len(self.held)
        at[new.to_numpy(zero_copy_only=False)] = np.arange(k, k + len(missing))
        ids, size = self.encoder.pieces(missing)
        begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        size, ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        if k + len(missing) <= HELD_PIECES:
            self.held, self.begin, self.size, self.ids = pa.concat_arrays([self.held, missing]), begin, size, ids
        else:
            keep = np.flatnonzero(counts > 1)[:HELD_PIECES]
            self.held, self.size = found.take(pa.array(keep)), size[at[keep]]
            self.begin, self.ids = np.cumsum(self.size) - self.size, ids[_spans(begin[at[keep]], self.size)]
        return begin[at], size[at], ids

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text."""
        odd = pc.match_substring_regex(texts, _ODD)
        if pc.any(odd).as_py():
            cut = pa.array([self.encoder.lone.sub(f"{_MARK} ", t) if o else None for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], pa.string())
            texts = pc.coalesce(cut, _marked(texts))
        else:
            texts = _marked(texts)
        split = pc.split_pattern(texts, _MARK)
        texts = odd = None
        ends = split.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        coded = split.flatten().dictionary_encode()
        split = None
        words, index = coded.dictionary, coded.indices.to_numpy()
        parts = pc.if_else(pc.match_substring_regex(words, _PLAIN), pc.utf8_rtrim(pc.replace_substring_regex(words, _PARTS, rf"\0{_MARK}"), _MARK), words)
        parts = pc.split_pattern(parts, _MARK)
        per = np.diff(parts.offsets.to_numpy())
        parts = parts.flatten().dictionary_encode()
        use = parts.indices.to_numpy()
        begin, size, ids = self.of(parts.dictionary, np.bincount(use, np.repeat(np.bincount(index, minlength=len(words)), per), len(parts.dictionary)))
        # The ids of each different word, then of each text.
        ids = ids[_spans(begin[use], size[use])]
        upto = np.concatenate([[0], np.cumsum(size[use])])[np.concatenate([[0], np.cumsum(per)])]
        begin, size = upto[:-1], np.diff(upto)
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            w = index[a:z]
            yield ids[_spans(begin[w], size[w])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The tokenizer of a path, loaded once by a worker; what a task learns of words goes with the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_texts(held: _Pieces, texts: pa.Array) -> Iterator[np.ndarray]:
    """Ids of each text, in order, SLICE_BYTES of text at a time."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        part = texts.slice(at, end - at)
        whole = np.zeros(len(part), bool)
        for token in held.encoder.whole:
            whole |= pc.match_substring(part, token).to_numpy(zero_copy_only=False)
        apart = iter(held.encoder._library(part.filter(pa.array(whole)).to_pylist()))
        for is_whole, ids in zip(whole.tolist(), held.encode(pc.if_else(pa.array(whole), "", part) if whole.any() else part), strict=True):
            yield next(apart) if is_whole else ids
        at = end


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, docs, size, seq, part = _Pieces(encoder(path)), [], [], 0, 0, None

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([pack_block(docs)], pa.binary())], ["part", "seq", "doc_ids", "n_ids", "payload"])

        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py()
            for d, got in zip(b.column("doc_id").to_pylist(), encode_texts(held, b.column("text").cast(pa.string())), strict=True):
                ids.append(d)
                docs.append(np.append(got, END_ID).astype(np.int32))
                size += len(docs[-1])
                if size >= BLOCK_IDS:
                    yield block()
                    ids, docs, size, seq = [], [], 0, seq + 1
        if docs:
            yield block()

    return freeing(run)


def write_tokens(docs: DataFrame, path: str, shards: int | None = None) -> DataFrame:
    """Blocks of ids in ascending doc_id order, written to the shared folder and read back."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), row_key("text").alias("_h"), F.monotonically_increasing_id().alias("_row"))
    d = d.repartitionByRange(n, "doc_id", "_h", "_row").sortWithinPartitions("doc_id", "_h").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    blocks = d.mapInArrow(_write(path), "part int, seq long, doc_ids array<bigint>, n_ids long, payload binary")
    return stage(blocks, "tokens")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, start, data in zip(b.column("doc_ids").to_pylist(), b.column("start").to_pylist(), b.column("payload"), strict=True):
            offsets, got = unpack_block(data.as_py())
            got = got.astype("<u4")
            crc = [zlib.crc32(got[a:z].tobytes()) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(offsets[:-1].astype(np.int64) + start), pa.array(np.diff(offsets.astype(np.int64))), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the blocks.

    The starts of the shards are a prefix sum over one row per shard; those of blocks one over a shard's blocks.
    """
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = sums.select("part", (F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    inside = blocks.select("part", "seq", "n_ids").withColumn("_in", F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    starts = stage(inside.join(before, "part").select("part", "seq", (F.col("_before") + F.col("_in")).alias("start")), "starts")
    return blocks.join(starts, ["part", "seq"]).select("doc_ids", "start", "payload").mapInArrow(freeing(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")
