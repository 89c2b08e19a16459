"""Encoding and decoding with a SentencePiece BPE model, with seeded merge-dropout.

Encoding is merge agenda processing: of all adjacent pairs whose join is a piece, the one with the
best score (then the leftmost) is merged, until none is left. With a dropout rate, each candidate
merge is skipped for good by a hash of the seed, the text's content, the word's place in its text,
and the candidate's place in the word. The segmentation is thus a function of text, seed and rate
alone: the same on every run, executor and retry, and drawn anew at every place of every text. Rate
0 gives the model's own encoding. Characters without a piece become byte pieces.

The agenda runs in numpy, one merge per word and round, over the distinct words of a slice without
dropout, and again over each occurrence for which a candidate merge met there is skipped; words
above ``LONG`` symbols use a heap. A word ends where no piece can cross: before white
space that follows other characters, and at characters without a piece.

Defined results: null and empty texts have no pieces and decode to the empty text; U+2581 in a text
is spelled in bytes, so that decoding never mistakes it for a space; repeated rows encode alike; an
empty table gives no rows; only the text (or ids) column is read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan
from .common import ship, unpack

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG = 96
#: bytes of text, and ids, that are worked on at a time
SLICE, IDS = 1 << 19, 1 << 18
NONE = np.int64(1) << 62


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model file; plain arrays that travel with a broadcast."""

    symbols: np.ndarray  # code point -> piece id, or -1
    byte_ids: np.ndarray
    space: int
    keys: np.ndarray  # open-addressing table of left << 20 | right
    merged: np.ndarray
    ranks: np.ndarray
    spelled: np.ndarray  # all pieces' bytes in a row
    spelled_at: np.ndarray


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ids = {pieces[i]: i for i in plain}
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("a piece crosses from other characters to white space")
    symbols = np.full(0x110000, -1, np.int32)
    for p, i in ids.items():
        if len(p) == 1:
            symbols[ord(p)] = i
    symbols[ord(" ")], symbols[ord(SPACE)] = ids[SPACE], -1
    order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
    pairs = {}
    for p, i in ids.items():
        for cut in range(1, len(p)):
            left, right = ids.get(p[:cut]), ids.get(p[cut:])
            if left is not None and right is not None:
                pairs[left << 20 | right] = (i, order[model.get_score(i)])
    keys, merged, ranks = _table(pairs)
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    spelled = [b""] * n
    for i in plain:
        spelled[i] = pieces[i].replace(SPACE, " ").encode()
    for b, i in enumerate(byte_ids.tolist()):
        spelled[i] = bytes([b])
    at = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])
    return Vocabulary(symbols, byte_ids, ids[SPACE], keys, merged, ranks, np.frombuffer(b"".join(spelled), np.uint8), at)


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (scan.mixed(keys.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _table(pairs: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = 1 << max(4, (2 * len(pairs)).bit_length())
    keys, merged, ranks = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int64)
    slots = _slot(np.fromiter(pairs, np.int64, len(pairs)), size).tolist()
    for (key, (piece, rank)), slot in zip(pairs.items(), slots, strict=True):
        while keys[slot] >= 0:
            slot = (slot + 1) % size
        keys[slot], merged[slot], ranks[slot] = key, piece, rank
    return keys, merged, ranks


def _find(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Table slot of each pair, or -1."""
    want = (left.astype(np.int64) << 20) | right
    slot = _slot(want, len(v.keys))
    out = np.full(len(want), -1, np.int64)
    open_ = np.arange(len(want))
    while len(open_):
        have = v.keys[slot[open_]]
        same = have == want[open_]
        out[open_[same]] = slot[open_[same]]
        open_ = open_[~same & (have >= 0)]
        slot[open_] = (slot[open_] + 1) & (len(v.keys) - 1)
    return out


def _merge_keys(seed: int, a, m, b) -> np.ndarray:
    """A hash of the candidate that joins symbols a..m and m..b of a word."""
    place = (np.asarray(a, np.uint64) << np.uint64(42)) ^ (np.asarray(m, np.uint64) << np.uint64(21)) ^ np.asarray(b, np.uint64)
    return scan.mixed(place + np.uint64(seed & scan.MASK))


def _skipped(rate: float, occurrence: np.ndarray, merge: np.ndarray) -> np.ndarray:
    """Whether a candidate is skipped at an occurrence of its word."""
    return (scan.mixed(occurrence ^ merge) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate


def _scored(v: Vocabulary, left, right, key, a, m, b, seed: int, rate: float, met: list | None = None) -> np.ndarray:
    """rank << 46 | joined piece of candidate pairs (symbols a..m and m..b of a word), NONE where they
    are no piece or skipped."""
    slot = _find(v, left, right)
    out = np.full(len(slot), NONE)
    ok = np.flatnonzero(slot >= 0)
    if rate > 0 and len(ok):
        ok = ok[~_skipped(rate, key[ok], _merge_keys(seed, a[ok], m[ok], b[ok]))]
    if met is not None:
        met.append((key[ok], _merge_keys(seed, a[ok], m[ok], b[ok])))
    out[ok] = (v.ranks[slot[ok]] << 46) | v.merged[slot[ok]]
    return out


def _agenda(v: Vocabulary, ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray, seed: int, rate: float, met: list | None = None):
    """(word, begin, id) of the final pieces of many words, one merge per word and round."""
    word, length, place = np.arange(len(sizes)), sizes.astype(np.int32), np.arange(len(ids), dtype=np.int64) << 16
    ids, begin = ids.astype(np.int32), _ramp(sizes).astype(np.int32)
    starts = np.cumsum(sizes) - sizes
    rank = np.full(len(ids), NONE)
    inner = np.ones(len(ids), bool)
    inner[starts + sizes - 1] = False
    at = np.flatnonzero(inner)
    rank[at] = _scored(v, ids[at], ids[at + 1], np.repeat(keys, sizes - 1), begin[at], begin[at] + 1, begin[at] + 2, seed, rate, met)
    done = []
    while len(ids):
        best = np.minimum.reduceat(rank + place[: len(ids)], starts)
        live = best < NONE
        if not live.all():
            stay = np.repeat(live, sizes)
            done.append((np.repeat(word[~live], sizes[~live]), begin[~stay], ids[~stay]))
            shift = np.cumsum(np.where(live, 0, sizes))[live]
            ids, begin, rank = ids[stay], begin[stay], rank[stay]
            word, length, sizes, best, keys = word[live], length[live], sizes[live], best[live], keys[live]
            if not len(ids):
                break
        else:
            shift = 0
        at = ((best >> 16) & ((1 << 30) - 1)) - shift
        ids[at] = best & 0xFFFF
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids, begin, rank = ids[keep], begin[keep], rank[keep]
        at = at - np.arange(len(at))  # one symbol went in each word before
        sizes = sizes - 1
        starts = np.cumsum(sizes) - sizes
        stop = starts + sizes
        rank[at] = NONE
        right = np.flatnonzero(at + 1 < stop)
        left = np.flatnonzero(at > starts)
        i, w = np.concatenate([at[right], at[left] - 1]), np.concatenate([right, left])
        end = np.where(i + 2 < stop[w], begin[np.minimum(i + 2, len(ids) - 1)], length[w])
        rank[i] = _scored(v, ids[i], ids[i + 1], keys[w], begin[i], begin[i + 1], end, seed, rate, met)
    return [np.concatenate(x) for x in zip(*done, strict=True)] if done else [np.zeros(0, np.int64)] * 3


def _heap_agenda(v: Vocabulary, ids: np.ndarray, key: np.uint64, seed: int, rate: float) -> tuple[list[int], list[int]]:
    """The same for one word with a heap: (begins, ids)."""
    ids, n = ids.tolist(), len(ids)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list = []
    word = np.array([key])

    def offer(many):
        many = [i for i in many if i >= 0 and after[i] < n]
        if not many:
            return
        left, right = np.array([ids[i] for i in many]), np.array([ids[after[i]] for i in many])
        slots = _find(v, left, right)
        skip = _skipped(rate, word, _merge_keys(seed, many, [end[i] for i in many], [end[after[i]] for i in many])) if rate > 0 else np.zeros(len(many), bool)
        for i, slot, drop in zip(many, slots.tolist(), skip.tolist(), strict=True):
            if slot >= 0 and not drop:
                heapq.heappush(heap, (int(v.ranks[slot]), i, end[i], end[after[i]], int(v.merged[slot])))

    offer(list(range(n)))
    while heap:
        _, i, mid, stop, piece = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if not alive[i] or j >= n or end[i] != mid or end[j] != stop:
            continue
        ids[i], end[i], alive[j], after[i] = piece, stop, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer([before[i], i])
    return [i for i in range(n) if alive[i]], [ids[i] for i in range(n) if alive[i]]


def encode_slice(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, seed: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts per text)."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = scan.code_points(data)[offsets]
    full = np.flatnonzero(np.diff(at))
    counts = np.zeros(len(offsets) - 1, np.int64)
    if not len(full):
        return np.zeros(0, np.int32), counts
    begin = at[:-1][full] + np.arange(len(full))
    known = v.symbols[points]
    symbols = np.insert(np.where(known >= 0, known, -1 - points.astype(np.int64)), at[:-1][full], v.space)
    gap = symbols == v.space
    cut = np.ones(len(symbols), bool)
    cut[1:] = (gap[1:] & ~gap[:-1]) | (symbols[1:] < 0) | (symbols[:-1] < 0)
    cut[begin] = True
    starts = np.flatnonzero(cut)
    ends = np.concatenate([starts[1:], [len(symbols)]])
    prefix = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(scan.mixed(symbols.astype(np.uint64)) * scan.powers(scan.BASE, len(symbols)), out=prefix[1:])
    hashes = scan.span_hashes(prefix, starts, ends)
    first = np.searchsorted(starts, begin)
    _, where, unit = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = ends - starts
    words, begins, pieces = [], [], []

    def segment(at: np.ndarray, keys: np.ndarray, base: int, rate: float, met: list | None = None):
        """Adds the pieces of the words at ``at`` as units from ``base`` on."""
        short = np.flatnonzero(lengths[at] <= LONG)
        size = lengths[at[short]]
        flat = np.repeat(starts[at[short]], size) + _ramp(size)
        w, b, p = _agenda(v, symbols[flat], size, keys[short], seed, rate, met)
        words.append(base + short[w]), begins.append(b), pieces.append(p)
        for i in np.flatnonzero(lengths[at] > LONG).tolist():
            b, p = _heap_agenda(v, symbols[starts[at[i]] : ends[at[i]]], keys[i], seed, rate)
            words.append(np.full(len(b), base + i)), begins.append(np.array(b)), pieces.append(np.array(p))

    if rate > 0:
        n_words = np.diff(np.append(first, len(starts)))
        text = scan.span_hashes(prefix, begin, np.append(begin[1:], len(symbols)))
        ordinal = (np.arange(len(starts)) - np.repeat(first, n_words)).astype(np.uint64)
        occurrence = scan.mixed(np.repeat(text, n_words) + ordinal * np.uint64(scan.BASE))
        # words that stand several times are segmented once for all occurrences that skip none of the candidates met
        shared = np.flatnonzero((np.bincount(unit) > 1) & (lengths[where] <= LONG))
        met: list = []
        segment(where[shared], np.arange(len(shared), dtype=np.uint64), 0, 0.0, met)
        of, merge = (np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.zeros(0, np.uint64),) * 2
        order = np.argsort(of, kind="stable")
        merge, n_met = merge[order], np.bincount(of.astype(np.int64), minlength=len(shared))
        number = np.full(len(where), -1)
        number[shared] = np.arange(len(shared))
        unit = number[unit]
        many = np.flatnonzero(unit >= 0)
        n = n_met[unit[many]]
        draws = np.repeat((np.cumsum(n_met) - n_met)[unit[many]], n) + _ramp(n)
        skip = _skipped(rate, np.repeat(occurrence[many], n), merge[draws])
        unit[np.repeat(many, n)[skip]] = -1
        own = np.flatnonzero(unit < 0)
        unit[own] = len(shared) + np.arange(len(own))
        segment(own, occurrence[own], len(shared), rate)
        n_units = len(shared) + len(own)
    else:
        segment(where, hashes[where], 0, 0.0)
        n_units = len(where)
    word, place, piece = (np.concatenate(x) for x in (words, begins, pieces))
    order = np.lexsort((place, word))
    word, piece = _spell_bytes(v, word[order], piece[order])
    size = np.bincount(word, minlength=n_units)
    base = np.concatenate([[0], np.cumsum(size)])[:-1]
    each = size[unit]
    ids = piece[np.repeat(base[unit], each) + _ramp(each)]
    done = np.concatenate([[0], np.cumsum(each)])
    counts[full] = done[np.concatenate([first[1:], [len(starts)]])] - done[first]
    return ids.astype(np.int32), counts


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for every size, in a row."""
    stop = np.cumsum(sizes)
    return np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - sizes, sizes)


def _spell_bytes(v: Vocabulary, word: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces characters without a piece (-1 - code point) by the pieces of their UTF-8 bytes."""
    odd = piece < 0
    if not odd.any():
        return word, piece
    point = np.where(odd, -1 - piece, 0)
    size = np.where(odd, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
    place = _ramp(size)
    word, piece, point, odd, size = (np.repeat(x, size) for x in (word, piece, point, odd, size))
    low = (point >> (6 * (size - 1 - place))) & 0x3F
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size] | (point >> (6 * (size - 1)))
    byte = np.where(size == 1, point & 0x7F, np.where(place == 0, lead, 0x80 | low))
    return word, np.where(odd, v.byte_ids[np.where(odd, byte, 0)], piece)


def decode_slice(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts; each loses the space that encoding put before it."""
    size = (v.spelled_at[1:] - v.spelled_at[:-1])[ids]
    body = v.spelled[np.repeat(v.spelled_at[ids], size) + _ramp(size)]
    done = np.concatenate([[0], np.cumsum(size)])
    stop = np.concatenate([[0], np.cumsum(counts)])
    offsets = done[stop]
    full = np.flatnonzero(np.diff(offsets))
    lead = offsets[:-1][full]
    lead_ok = body[lead] == 0x20
    gone = np.zeros(len(body), bool)
    gone[lead[lead_ok]] = True
    return body[~gone], offsets - np.concatenate([[0], np.cumsum(gone)])[offsets]


ENCODED = ("piece_ids", "n_pieces", "round_trip")


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", seed: int = 7, rate: float = 0.1) -> DataFrame:
    """The columns of ``docs`` (those named as in ``ENCODED`` give way) with the piece ids of each text,
    their number, and whether they decode to the text (null: the empty text). A task holds one input
    batch and the pieces of one slice of it at a time."""
    plain = [f for f in docs.schema.fields if f.name not in ENCODED]
    schema = T.StructType([*plain, T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    shared = ship(docs.sparkSession, vocabulary)

    def run(batches):
        own = unpack(shared)
        for batch in batches:
            for i, data, offsets in scan.texts(batch.column(text_col), SLICE):
                ids, counts = encode_slice(own, data, offsets, seed, rate)
                body, ends = decode_slice(own, ids, counts)
                same = np.diff(ends) == np.diff(offsets)
                if not (same.all() and np.array_equal(body, data)):
                    same &= [np.array_equal(body[a:b], data[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:], strict=True)]
                rows = batch.slice(i, len(counts))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                columns = [rows.column(f.name) for f in plain] + [lists, pa.array(counts), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            scan.release()

    return docs.select(*[f.name for f in plain]).mapInArrow(run, schema)


def encode_column(spark, vocabulary: Vocabulary, text: Column, seed: int = 7, rate: float = 0.1) -> Column:
    """array<int> of piece ids of a text."""
    shared = ship(spark, vocabulary)
    ready: list = []

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        if not ready:
            ready.append(unpack(shared))
        own_vocabulary = ready[0]
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for _, data, offsets in scan.texts(column, SLICE):
            own, n = encode_slice(own_vocabulary, data, offsets, seed, rate)
            ids.append(own), counts.append(n)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.array(np.concatenate(ids)))

    return encode.asNondeterministic()(text)


def decode_column(spark, vocabulary: Vocabulary, ids: Column) -> Column:
    """The text of an array of piece ids; null for null."""
    shared = ship(spark, vocabulary)
    ready: list = []

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        if not ready:
            ready.append(unpack(shared))
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        counts = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
        flat, stop = np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(counts)])
        parts, ends, i = [], [np.zeros(1, np.int64)], 0
        while i < len(counts):
            j = max(i + 1, int(np.searchsorted(stop, stop[i] + IDS, "right")) - 1)
            body, offsets = decode_slice(ready[0], flat[stop[i] : stop[j]], counts[i:j])
            parts.append(body.tobytes())
            ends.append(offsets[1:] + ends[-1][-1])
            i = j
        texts = pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(np.concatenate(ends)), pa.py_buffer(b"".join(parts))])
        return texts.cast(pa.string())

    return F.when(ids.isNotNull(), decode(ids))
