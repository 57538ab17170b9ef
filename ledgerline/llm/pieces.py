"""SentencePiece encoding and decoding as a max-plus scan.

The vocabulary file gives pieces in merge order; a piece of rank k weighs -log(k), in whole steps so that sums are exact
in any order; ties go by the places where pieces start. A text's ids are the segmentation of greatest weight; characters without a piece become their bytes.

No piece of a text part crosses the start of a unit (a run of spaces with the word that follows), so units are cut
independently: all distinct units of a batch together, an array operation for each piece length. A giant text is split
into chunks at any place. A chunk's transfer matrix holds the greatest weight from each entry state (how many of its
characters belong to a piece that began before it) to each exit state; matrices combine by max-plus products in any
grouping, which gives every chunk its own entry and exit, and then each chunk is backtraced by itself."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a U+2581 of the text itself, which goes as bytes; no valid text has this code point.
OWN_MARK = "\ud800"
STEP = 1024
#: A piece's weight counts TIE for each step, and below that a number for the place in its unit where it starts. So of
#: segmentations that weigh the same one is best, and it is the same one however a text is cut into chunks.
TIE, TIE_BITS = 1 << 20, 12
NONE = np.int64(-(1 << 60))
FORBIDDEN = np.int64(-(1 << 58))
#: Texts of more code points go through chunks of so many.
CHUNK_CHARS = 50_000
#: A task works on about so many characters at a time.
BATCH_CHARS = 400_000


class Vocabulary:
    """Pieces of a model file, with what the array operations need."""

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(k) for k in range(n)]
        self.byte_id = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if sp.is_byte(k)}
        plain = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
        if any(SPACE in self.pieces[k].lstrip(SPACE) for k in plain):
            raise ValueError("a piece has a space after another character")
        silent = [sp.is_control(k) or sp.is_unknown(k) for k in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(k) else b"" if silent[k] else p.replace(SPACE, " ").encode() for k, p in enumerate(self.pieces)]
        self.longest = max(len(self.pieces[k]) for k in plain)
        weight = {k: -round(STEP * math.log(2 + r)) for r, k in enumerate(plain)}
        self.unknown = min(weight.values()) - 10 * STEP
        # a trie over characters, one dense row of next states for each: characters get small codes, others code 0
        chars = sorted({c for k in plain for c in self.pieces[k]})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        edges: dict[tuple[int, int], int] = {}
        self.piece, self.weight = [-1], [int(NONE)]
        for k in plain:
            state = 0
            for c in self.pieces[k]:
                key = (state, int(self.code[ord(c)]))
                if key not in edges:
                    edges[key] = len(self.piece)
                    self.piece.append(-1)
                    self.weight.append(int(NONE))
                state = edges[key]
            self.piece[state], self.weight[state] = k, weight[k]
        self.piece, self.weight = np.array(self.piece, np.int32), np.array(self.weight, np.int64)
        # the edges as an open hash table: key state * 2^16 + code
        size = 1 << (len(edges) * 4).bit_length()
        self.mask, self.keys, self.next = size - 1, np.full(size, -1, np.int64), np.zeros(size, np.int32)
        self.probes = 1
        for (state, code), to in edges.items():
            key = state << 16 | code
            at, tries = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40 & self.mask, 1
            while self.keys[at] != -1:
                at, tries = at + 1 & self.mask, tries + 1
            self.keys[at], self.next[at] = key, to
            self.probes = max(self.probes, tries)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next states, 0 where there is none."""
        key = state.astype(np.int64) << 16 | code
        at = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & self.mask
        out = np.where(self.keys[at] == key, self.next[at], 0)
        miss = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1))
        for _ in range(self.probes):
            if not len(miss):
                break
            at[miss] = at[miss] + 1 & self.mask
            hit = self.keys[at[miss]] == key[miss]
            out[miss[hit]] = self.next[at[miss[hit]]]
            miss = miss[~hit & (self.keys[at[miss]] != -1)]
        return out

    def matches(self, code: np.ndarray, stop: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each piece length: the places (ascending) at which a piece of it starts, its id, its weight; a piece ends
        before the place's stop. Every place has a match of length 1, the unknown one with id -1 if there is no piece."""
        at, state, out = np.arange(len(code)), np.zeros(len(code), np.int32), []
        for n in range(1, self.longest + 1):
            if n > 1:
                some = at + n <= stop[at]
                at, state = at[some], state[some]
            state = self.step(state, code[at + n - 1])
            if n == 1:
                ids, weight = self.piece[state], np.where(self.piece[state] >= 0, self.weight[state], self.unknown)
                out.append((at, ids, weight))
            else:
                full = self.piece[state] >= 0
                out.append((at[full], self.piece[state[full]], self.weight[state[full]]))
            at, state = at[state > 0], state[state > 0]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def spaced(text: str) -> str:
    return text.replace(SPACE, OWN_MARK).replace(" ", SPACE)


def normal(text: str) -> str:
    """The text as pieces spell it: a space in front, spaces visible."""
    return SPACE + spaced(text) if text else ""


def place_number(place: np.ndarray) -> np.ndarray:
    """A number below 2^TIE_BITS for each place in a unit."""
    return (((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TIE_BITS)).astype(np.int64)


def unit_starts(points: np.ndarray) -> np.ndarray:
    """Whether a unit starts at each place but the first: a space after another character."""
    space = points == ord(SPACE)
    out = np.zeros(len(points), bool)
    out[1:] = space[1:] & ~space[:-1]
    return out


def _pad(values: np.ndarray, n: int, fill) -> np.ndarray:
    return values if len(values) >= n else np.concatenate([values, np.full(n - len(values), fill, values.dtype)])


def cut_units(v: Vocabulary, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places where the best pieces start, ascending; their ids; weight of each unit) for units points[offsets[k] :
    offsets[k + 1]]. All units advance together, a character a step."""
    sizes = np.diff(offsets)
    n, many, longest = len(points), len(sizes), int(sizes.max(initial=0))
    stop = np.repeat(offsets[1:], sizes)
    code = v.code[points]
    lengths = min(v.longest, longest)
    score, ids = np.full((lengths + 1, n), FORBIDDEN), np.full((lengths + 1, n), -1, np.int32)
    number = place_number(np.arange(n) - np.repeat(offsets[:-1], sizes))
    for length, (at, piece, weight) in enumerate(v.matches(code, stop)[:lengths], 1):
        score[length, at], ids[length, at] = weight * TIE + number[at], piece
    order = np.argsort(-sizes, kind="stable")
    begin, ordered = offsets[:-1][order], sizes[order]
    live = np.searchsorted(-ordered, -np.arange(1, longest + 1), side="right")
    best = np.full(n + many, NONE)  # one more place a unit: place i of unit k is at begin[k] + k + i
    shift = begin + order
    best[shift] = 0
    took = np.zeros(n + many, np.int8)
    for j in range(1, longest + 1):
        m = live[j - 1]
        top, arg = np.full(m, NONE), np.zeros(m, np.int8)
        for length in range(1, min(j, lengths) + 1):
            w = best[shift[:m] + j - length] + score[length, begin[:m] + j - length]
            better = w > top
            top[better], arg[better] = w[better], length
        best[shift[:m] + j], took[shift[:m] + j] = top, arg
    starts = np.zeros(n, np.int8)
    place = ordered.copy()
    todo = np.flatnonzero(place > 0)
    while len(todo):
        length = took[shift[todo] + place[todo]].astype(np.int64)
        place[todo] -= length
        starts[begin[todo] + place[todo]] = length
        todo = todo[place[todo] > 0]
    at = np.flatnonzero(starts)
    return at, ids[starts[at], at], best[offsets[1:] + np.arange(many)]


def ragged(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists values[offsets[k] : offsets[k + 1]] for k in pick, one after the other, and where each starts."""
    sizes = np.diff(offsets)[pick]
    ends = np.cumsum(sizes)
    return values[np.repeat(offsets[pick] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], np.concatenate([[0], ends])


def _spell(v: Vocabulary, at: np.ndarray, ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, id) with each unknown character replaced by the ids of its bytes."""
    unknown = np.flatnonzero(ids < 0)
    if not len(unknown):
        return at, ids
    spelled = [[v.byte_id[b] for b in (SPACE if chr(p) == OWN_MARK else chr(p)).encode()] for p in points[at[unknown]].tolist()]
    repeat = np.ones(len(ids), np.int64)
    repeat[unknown] = [len(s) for s in spelled]
    out = np.repeat(ids, repeat)
    out[out < 0] = [b for s in spelled for b in s]
    return np.repeat(at, repeat), out


def cut_texts(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the offsets of each: distinct units are cut once."""
    points = _points("".join(texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    new = unit_starts(points)
    new[np.concatenate([[0], ends[:-1]])[sizes > 0]] = True
    first = np.flatnonzero(new)
    unit_sizes = np.diff(np.append(first, len(points)))
    # name of a unit: a polynomial hash of its characters and its length; units that share a name are compared
    place = np.arange(len(points)) - np.repeat(first, unit_sizes)
    base = np.full(int(unit_sizes.max()), np.uint64(0x9E3779B97F4A7C15))
    base[0] = 1
    power = np.multiply.accumulate(base)[place]
    name = np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * power, first) ^ (unit_sizes.astype(np.uint64) << np.uint64(48))
    _, where, inverse = np.unique(name, return_index=True, return_inverse=True)
    # no unit may stand for another: those that differ from the first of their name are cut for themselves
    other = points != points[np.minimum(np.repeat(first[where[inverse]], unit_sizes) + np.arange(len(points)) - np.repeat(first, unit_sizes), len(points) - 1)]
    own = np.flatnonzero(np.logical_or.reduceat(other, first) | (unit_sizes != unit_sizes[where[inverse]]))
    inverse = inverse.copy()
    inverse[own] = len(where) + np.arange(len(own))
    where = np.concatenate([where, own])
    unit_points, unit_offsets = ragged(points, np.append(first, len(points)), where)
    at, ids, _ = cut_units(v, unit_points, unit_offsets)
    at, ids = _spell(v, at, ids, unit_points)
    piece_offsets = np.searchsorted(at, unit_offsets)
    all_ids, offsets = ragged(ids, piece_offsets, inverse)
    units_before = np.searchsorted(first, np.concatenate([[0], ends]))
    return all_ids, offsets[units_before]


def decode(v: Vocabulary, ids: list[int] | np.ndarray) -> str:
    """The text of ids; the space in front of the first word goes."""
    raw = b"".join(map(v.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
    return raw.decode("utf-8", "replace")[1:]


def _batches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for k, n in enumerate(sizes):
        if k > first and size + n > BATCH_CHARS:
            yield first, k
            first, size = k, 0
        size += n
    if sizes:
        yield first, len(sizes)


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def encode_small(docs: DataFrame, keys: list[str], model: str) -> DataFrame:
    """keys, ids, decoded for each row of docs (keys, text), text by text; decoded is the text that the ids give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            column = batch.column("text")
            for a, b in _batches(pc.utf8_length(column).to_pylist()):
                ids, offsets = cut_texts(v, [normal(t) for t in column.slice(a, b - a).to_pylist()])
                flat, ends = ids.tolist(), offsets.tolist()
                texts = [decode(v, flat[x:y]) for x, y in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in keys), _lists(ids, offsets), pa.array(texts, pa.string())], [*keys, "ids", "decoded"])

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}, ids array<int>, decoded string")


# --- giant texts -----------------------------------------------------------------------------------------------------


def _lanes(v: Vocabulary, points: np.ndarray, entries: int, exits: int, inner: int, lead: int = 0) -> tuple[np.ndarray, list]:
    """Greatest weights from entry i to inner + j, for a stretch without a unit start: (entries, exits) matrix, and per
    end the lists of (start, id, weight) for backtracing. lead: characters of its unit before the stretch."""
    n = len(points)
    number = place_number(np.arange(lead, lead + n))
    ends: list[list[tuple[int, int, int]]] = [[] for _ in range(n + 1)]
    for length, (at, ids, weight) in enumerate(v.matches(v.code[points], np.full(n, n)), 1):
        for a, i, w in zip(at.tolist(), ids.tolist(), (weight * TIE + number[at]).tolist(), strict=True):
            ends[a + length].append((a, i, w))
    best = np.full((n + 1, entries), NONE)
    for i in range(min(entries, n + 1)):
        best[i, i] = 0
    for e in range(1, n + 1):
        for a, _, w in ends[e]:
            np.maximum(best[e], best[a] + w, out=best[e])
    out = np.full((entries, exits), NONE)
    for j in range(min(exits, n - inner + 1)):
        out[:, j] = np.maximum(best[inner + j], NONE)
    return out, ends


def _trace(ends: list, entry: int, to: int) -> list[tuple[int, int]]:
    """(place, id) of the best pieces from entry to a place."""
    best: dict[int, tuple[int, int, int]] = {entry: (0, -1, -1)}
    for e in range(entry + 1, to + 1):
        for a, i, w in ends[e]:
            if a in best and (e not in best or best[a][0] + w > best[e][0]):
                best[e] = (best[a][0] + w, a, i)
    out = []
    while to > entry:
        _, a, i = best[to]
        out.append((a, i))
        to = a
    return out[::-1]


class Chunk:
    """A chunk of a normal text with the characters after it that its last piece may take (fewer at the text's end); lead:
    how many characters of its first unit lie before it."""

    def __init__(self, v: Vocabulary, text: str, size: int, lead: int = 0) -> None:
        self.v, self.points, self.size = v, _points(text), size
        starts = np.flatnonzero(unit_starts(self.points))
        starts = starts[starts < size]
        self.first, self.last = (int(starts[0]), int(starts[-1])) if len(starts) else (None, None)
        self.states = v.longest
        if self.first is not None:
            self.middle = cut_units(v, self.points[self.first : self.last], np.append(starts, starts[-1:])[: len(starts)] - self.first) if self.last > self.first else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
            self.head, self.head_ends = _lanes(v, self.points[: self.first], self.states, 1, self.first, lead)
            self.tail, self.tail_ends = _lanes(v, self.points[self.last :][: size - self.last + self._reach()], 1, self.states, size - self.last)
        else:
            self.all, self.all_ends = _lanes(v, self.points[: size + self._reach()], self.states, self.states, size, lead)

    def _reach(self) -> int:
        """How far beyond the chunk a piece may go: not over the start of a unit."""
        after = np.flatnonzero(unit_starts(self.points)[self.size :])
        return int(min(self.states - 1, after[0] if len(after) else self.states - 1, len(self.points) - self.size))

    def transfer(self) -> np.ndarray:
        if self.first is None:
            return self.all
        return np.maximum(self.head + int(self.middle[2].sum()) + self.tail, NONE)

    def ids(self, entry: int, leave: int) -> np.ndarray:
        if self.first is None:
            found = _trace(self.all_ends, entry, self.size + leave)
        else:
            head, tail = _trace(self.head_ends, entry, self.first), _trace(self.tail_ends, 0, self.size + leave - self.last)
            middle = zip((self.middle[0] + self.first).tolist(), self.middle[1].tolist(), strict=True)
            found = [*head, *middle, *((a + self.last, i) for a, i in tail)]
        at, ids = np.array([a for a, _ in found], np.int64), np.array([i for _, i in found], np.int32)
        return _spell(self.v, at, ids, self.points)[1]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative, as all weights are whole numbers."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NONE)


def plan(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """Entry and exit state of each chunk of a text, by a tree of products: halves combine upwards, and the best state at
    each middle is chosen downwards."""
    if not matrices:
        return []
    levels = [matrices]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([product(low[k], low[k + 1]) if k + 1 < len(low) else low[k] for k in range(0, len(low), 2)])
    spans = [(0, 0)]  # a text begins in state 0 and ends in state 0
    for low in reversed(levels[:-1]):
        out = []
        for k, (i, j) in enumerate(spans):
            if 2 * k + 1 < len(low):
                mid = int((low[2 * k][i] + low[2 * k + 1][:, j]).argmax())
                out += [(i, mid), (mid, j)]
            else:
                out.append((i, j))
        spans = out
    return spans


def encode_giant(docs: DataFrame, keys: list[str], model: str, chunk_chars: int) -> DataFrame:
    """keys, ids for each row of docs (keys, text): chunks, transfer matrices, entries and exits, backtraces. keys must
    tell the rows apart. A text fits a row, so it has at most 2^31 / chunk_chars matrices of 2 kB."""
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = vocabulary(model).longest - 1
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py()
                text = " " + text if text else ""
                units = np.flatnonzero(unit_starts(_points(spaced(text))))
                own = [batch.column(k).slice(row, 1) for k in keys]
                for nth, a in enumerate(range(0, len(text), chunk_chars)):
                    before = np.searchsorted(units, a, side="right")
                    lead = a - int(units[before - 1]) if before else a
                    numbers = [pa.array([x], pa.int64()) for x in (nth, min(chunk_chars, len(text) - a), lead)]
                    yield pa.RecordBatch.from_arrays([*own, *numbers, pa.array([text[a : a + chunk_chars + reach]])], [*keys, "nth", "size", "lead", "part"])

    parts = materialize(docs.select(*keys, "text").mapInArrow(split, f"{kinds}, nth long, size long, lead long, part string").repartition(*keys, "nth"), "parts")

    def matrix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for pdf in batches:
            out = [Chunk(v, spaced(p), int(n), int(lead)).transfer().tobytes() for p, n, lead in zip(pdf["part"], pdf["size"], pdf["lead"], strict=True)]
            yield pdf[[*keys, "nth"]].assign(matrix=out)

    matrices = parts.mapInPandas(matrix, f"{kinds}, nth long, matrix binary")

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        side = int(math.isqrt(len(pdf["matrix"].iloc[0]) // 8))
        spans = plan([np.frombuffer(m, np.int64).reshape(side, side) for m in pdf["matrix"]])
        return pdf[[*keys, "nth"]].assign(entry=[i for i, _ in spans], leave=[j for _, j in spans])

    spans = matrices.groupBy(*keys).applyInPandas(states, f"{kinds}, nth long, entry long, leave long")

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for pdf in batches:
            out = [Chunk(v, spaced(p), int(n), int(lead)).ids(int(i), int(j)) for p, n, lead, i, j in zip(*(pdf[c] for c in ("part", "size", "lead", "entry", "leave")), strict=True)]
            yield pdf[[*keys, "nth"]].assign(ids=out)

    pieces = parts.join(spans, [*keys, "nth"]).mapInPandas(trace, f"{kinds}, nth long, ids array<int>")
    return pieces.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("nth", "ids"))), lambda x: x["ids"])).alias("ids"))


def with_decoded(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded (.., ids) with decoded, the text of ids."""
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            texts = [decode(v, ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kinds}, decoded string")


def encode(docs: DataFrame, key: str = "doc_id", model: str = MODEL, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """key, ids, decoded for each row of docs (key, text); decoded is what the ids decode to. Null and empty texts have no
    ids; rows with an equal or null key each give a row; no rows give no rows."""
    rows = docs.select(F.col(key), text_of().alias("text"))
    small = encode_small(rows.filter(F.length("text") <= chunk_chars), [key], model)
    giant = rows.filter(F.length("text") > chunk_chars).withColumn("_row", F.xxhash64("text"))
    giant = giant.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.col(key).isNull().alias("_null"), "_row").agg(F.count("*").alias("_n"), F.first(key).alias(key), F.first("text").alias("text"))
    giant = materialize(giant, "giant")
    cut = with_decoded(encode_giant(giant, ["_key", "_null", "_row"], model, chunk_chars), model)
    same = giant.select("_key", "_null", "_row", key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i"))
    return small.unionByName(same.join(cut, ["_key", "_null", "_row"]).select(key, "ids", "decoded"))


def encode_and_decode(docs: DataFrame, key: str = "doc_id", model: str = MODEL, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """key, n_tokens, ids, decoded_sha256 (lower-case hex of the UTF-8 text that decoding gives back)."""
    return encode(docs, key, model, chunk_chars).select(key, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
