"""Removal of byte strings that occur twice or more, by sorting suffixes deep-shallow.

Only suffixes that can have an equal prefix of `width` bytes are sorted. Each string of that width (a suffix cut to its first width
bytes) takes as its anchor the GRAM bytes in it whose hash is least, so equal strings have the same anchor at the same place. Strings
of one anchor that start within STEP bytes of each other are a piece; they share a core, and a piece whose core occurs nowhere
else holds no repeat. Pieces with a shared core become fragments, the bytes of all their strings; equal fragments are counted, not
copied, before they are dealt out by the core's name.

A task sorts the suffixes of its fragments: multikey quicksort over words of 8 bytes, ternary and for all groups at once, down to
SHALLOW words, then a blind trie for each group that is still together. Suffixes that share a leaf agree in all width bytes. Names
and anchors only choose what is sorted; equality is decided on bytes."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of
from .textnum import U, mix

GRAM, STEP, SHALLOW = 16, 93, 3
#: Bytes of text that a task works on at a time; longer texts are taken in overlapping parts. Positions take 24 bits.
PART_BYTES = 2 << 20
#: Bytes of fragments that are sorted at a time.
SORT_BYTES = 1 << 20
#: A name with more different fragments is dealt out by whole strings.
HOT = 4096


def parts(texts: list[bytes], width: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text number, where its bytes start in the text, bytes) of about PART_BYTES. Parts of a long text overlap in width - 1
    bytes, so each string lies in one part."""
    out, size = [], 0
    for k, raw in enumerate(texts):
        for a in range(0, max(1, len(raw) - width + 1), PART_BYTES):
            part = raw[a : a + PART_BYTES + width - 1]
            if out and size + len(part) > PART_BYTES:
                yield out
                out, size = [], 0
            out.append((k, a, part))
            size += len(part)
    if out:
        yield out


_BASE = U(0x9E3779B97F4A7C15)
_TABLES: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            _TABLES[name] = np.full(n, base, U)
            _TABLES[name][:1] = 1
            np.multiply.accumulate(_TABLES[name], out=_TABLES[name])
    return _TABLES["up"], _TABLES["down"]


def pieces(raws: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(number of the text, first start, last start, name of the core) of each piece, in order, and the bytes that starts are places of."""
    buf = b"".join(raws) + bytes(8)
    n = len(buf) - 8
    ends = np.cumsum([len(r) for r in raws])
    grams = n - GRAM + 1
    if grams < 1 or n < width:
        return *[np.zeros(0, np.int64)] * 3, np.zeros(0, U), buf
    words = np.ndarray(n, "<u8", buf, strides=(1,)).astype(U)
    h = mix(words[:grams] * U(0xD6E8FEB86659FD93) + mix(words[8 : grams + 8]))
    least = (h & ~U(0xFFFFFF)) | np.arange(grams, dtype=U)
    span, want = 1, width - GRAM + 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    sizes = np.diff(np.concatenate([[0], ends]))
    count = np.maximum(sizes - width + 1, 0)
    doc = np.repeat(np.arange(len(raws)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends - sizes, count)
    if not len(start):
        return *[np.zeros(0, np.int64)] * 3, np.zeros(0, U), buf
    anchor = (least[start] & U(0xFFFFFF)).astype(np.int64)
    zone = (anchor - start) // STEP
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (zone[1:] != zone[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    doc, a, b, anchor, zone = doc[first], start[first], start[last], anchor[first], zone[first]
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum((np.frombuffer(buf, np.uint8, n).astype(U) + U(1)) * up[:n], out=total[1:])
    low, high = anchor - zone * STEP, anchor - np.minimum(zone * STEP + STEP - 1, want - 1) + width
    name = mix((total[high] - total[low]) * down[low] + (high - low).astype(U) * U(0x9FB21C651E98DF25) + zone.astype(U))
    return doc, a, b, name, buf


def _tell(docs: DataFrame, key: str, width: int) -> DataFrame:
    """key, n_bytes, sha, rid (its first 8 bytes) and names of cores. single: this text alone has them among those a task saw together;
    known: shared with another text or twice in this one, so wanted for certain; lead: the known ones that this row speaks for. A copy of
    a text that the task saw in the same part has no names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "n_bytes", "sha", "rid", "single", "known", "lead"]
        longs = pa.list_(pa.int64())
        for batch in batches:
            raws = [t.encode() for t in batch.column("text").to_pylist()]
            shas = [hashlib.sha256(r).digest() for r in raws]
            found: list = [([], [], []) for _ in raws]
            for part in parts(raws, width):
                seen: set = set()
                own = [(k, raw) for k, a, raw in part if a or shas[k] not in seen and not seen.add(shas[k])]
                doc, _, _, name, _ = pieces([raw for _, raw in own], width)
                order = np.lexsort((doc, name))
                name, doc = name[order].view(np.int64), doc[order]
                head = np.ones(len(name), bool)
                head[1:] = name[1:] != name[:-1]
                at = np.flatnonzero(head)
                many = np.repeat(np.diff(np.append(at, len(name))) > 1, np.diff(np.append(at, len(name))))
                for place, which in enumerate((~many, many, many & head)):
                    d, m = doc[which], name[which]
                    order = np.argsort(d, kind="stable")
                    d, m = d[order], m[order]
                    cuts = np.flatnonzero(np.diff(d, prepend=-1))
                    for i, piece in zip(d[cuts], np.split(m, cuts[1:]) if len(cuts) else [], strict=True):
                        found[own[i][0]][place].append(np.unique(piece))
            columns = [pa.array([np.concatenate(f[p]) if f[p] else [] for f in found], longs) for p in range(3)]
            rids = [int.from_bytes(x[:8], signed=True) for x in shas]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(r) for r in raws], pa.int64()), pa.array(shas, pa.binary()), pa.array(rids, pa.int64()), *columns], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_of().alias("text")).mapInArrow(run, f"`{key}` {kind}, n_bytes long, sha binary, rid long, single array<long>, known array<long>, lead array<long>")


def _fragments(found: DataFrame, width: int) -> DataFrame:
    """(name, fid, fragment, sha, copies, at) for found (sha, text, names, copies): each different fragment of a text and the places where it
    starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["name", "fid", "fragment", "sha", "copies", "at"]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            raws = [t.encode() for t in batch.column("text").to_pylist()]
            shas, wanted, copies = (batch.column(c).to_pylist() for c in ("sha", "names", "copies"))
            for part in parts(raws, width):
                doc, a, b, name, buf = pieces([raw for _, _, raw in part], width)
                name = name.view(np.int64)
                cuts = np.searchsorted(doc, np.arange(len(part) + 1))
                base, out = 0, []
                for i, (k, offset, raw) in enumerate(part):
                    own = slice(cuts[i], cuts[i + 1])
                    hit = np.flatnonzero(np.isin(name[own], np.asarray(wanted[k], np.int64))) + cuts[i]
                    at: dict = {}
                    for s, e, m in zip(a[hit].tolist(), b[hit].tolist(), name[hit].tolist(), strict=True):
                        at.setdefault((m, buf[s : e + width]), []).append(s - base + offset)
                    out += [(m, hashlib.blake2b(f, digest_size=16).digest(), f, shas[k], copies[k], places) for (m, f), places in at.items()]
                    base += len(raw)
                for z in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[z : z + 4096], strict=True), types, strict=True)], columns)

    return found.select("sha", "text", "names", "copies").mapInArrow(run, "name long, fid binary, fragment binary, sha binary, copies long, at array<long>")


def quicksort(words: np.ndarray, place: np.ndarray, groups: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes at place over depth words of 8 bytes; words[i] are those at byte i. Groups number runs of
    suffixes that are sorted apart. Gives the suffixes' order and where a suffix differs from the one before it within that depth.

    All runs are split at once: a pivot for each, then the less, the equal, which go on with the next word, and the greater."""
    order = np.arange(len(place))
    edge = np.ones(len(place) + 1, bool)
    edge[1:-1] = groups[1:] != groups[:-1]
    level = np.zeros(len(place), np.int64)
    while True:
        heads = np.flatnonzero(edge)
        sizes = np.diff(heads)
        live = (sizes > 1) & (level[heads[:-1]] < depth)
        if not live.any():
            return order, edge[:-1]
        heads, sizes = heads[:-1][live], sizes[live]
        run = np.repeat(np.arange(len(heads)), sizes)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(heads, sizes)
        own = order[inside]
        char = words[place[own] + 8 * level[inside]]
        begin = np.cumsum(sizes) - sizes
        a, b, c = char[begin], char[begin + sizes // 2], char[begin + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[run]
        less, more = char < pivot, char > pivot
        n_less, n_more = np.add.reduceat(less, begin, dtype=np.int64), np.add.reduceat(more, begin, dtype=np.int64)
        side = np.where(less, 0, np.where(more, 2, 1))
        to = np.empty(len(run), np.int64)
        for which, first in ((0, heads), (1, heads + n_less), (2, heads + sizes - n_more)):
            mine = side == which
            rank = np.cumsum(mine) - 1
            before = np.concatenate([[0], rank[begin[1:] - 1] + 1]) if len(begin) > 1 else np.zeros(1, np.int64)
            to[mine] = first[run[mine]] + (rank - before[run])[mine]
        order[to] = own
        depths = level[inside].copy()
        level[to] = depths + (side == 1)
        edge[heads + n_less] = True
        edge[heads + sizes - n_more] = True


class _Leaf:
    __slots__ = ("rows", "text")

    def __init__(self, text: bytes, row: int) -> None:
        self.text, self.rows = text, [row]


class _Node:
    """Branches at one byte; the bytes before it are not stored."""

    __slots__ = ("kids", "place")

    def __init__(self, place: int, kids: dict) -> None:
        self.place, self.kids = place, kids


def _agree(s: bytes, t: bytes) -> int:
    """Bytes at the front in which two different strings of equal length agree."""
    return len(s) - ((int.from_bytes(s) ^ int.from_bytes(t)).bit_length() + 7) // 8


def blind_trie(texts: list[bytes]) -> list[list[int]]:
    """Numbers of the texts, which are equally long, in order; equal texts together. A text goes down by the branching bytes alone, is
    compared once with the leaf it comes to, and enters where they part."""
    root: _Node | _Leaf = _Leaf(texts[0], 0)
    for row in range(1, len(texts)):
        s, node = texts[row], root
        while type(node) is _Node:
            node = node.kids.get(s[node.place]) or next(iter(node.kids.values()))
        t = node.text
        if s == t:
            node.rows.append(row)
            continue
        split, above, node = _agree(s, t), None, root
        while type(node) is _Node and node.place < split:
            above, node = node, node.kids[s[node.place]]
        if type(node) is _Node and node.place == split:
            node.kids[s[split]] = _Leaf(s, row)
            continue
        new = _Node(split, {t[split]: node, s[split]: _Leaf(s, row)})
        if above is None:
            root = new
        else:
            above.kids[s[above.place]] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is _Leaf:
            out.append(node.rows)
        else:
            stack += [node.kids[x] for x in sorted(node.kids, reverse=True)]
    return out


def repeated(fragments: list[bytes], times: list[int], groups: list[int], width: int) -> list[list[int]]:
    """For each fragment, from which to before which start its strings occur twice or more: [a, b, a, b, ...]. times: how often a fragment
    occurs; groups: numbers of runs of fragments that can share strings."""
    buf = b"".join(fragments) + bytes(8)
    sizes = np.array([len(f) for f in fragments])
    count = sizes - width + 1
    owner = np.repeat(np.arange(len(fragments)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    place = inside + np.repeat(np.cumsum(sizes) - sizes, count)
    words = np.ndarray(len(buf) - 7, ">u8", buf, strides=(1,)).astype(U)
    order, edge = quicksort(words, place, np.asarray(groups)[owner], min(SHALLOW, width // 8))
    hit = np.asarray(times)[owner] > 1
    heads = np.append(np.flatnonzero(edge), len(order))
    for a, b in zip(heads[:-1][np.diff(heads) > 1].tolist(), heads[1:][np.diff(heads) > 1].tolist(), strict=True):
        rows = order[a:b]
        at = place[rows].tolist()
        for same in blind_trie([buf[p : p + width] for p in at]):
            if len(same) > 1:
                hit[rows[same]] = True
    change = np.ones(len(owner) + 1, bool)
    change[1:-1] = (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])
    runs: list[list[int]] = [[] for _ in fragments]
    where = np.flatnonzero(change)
    for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True):
        if hit[a]:
            runs[owner[a]] += [int(inside[a]), int(inside[b - 1]) + 1]
    return runs


def _sorted(fragments: DataFrame, width: int) -> DataFrame:
    """(fid, runs) for fragments (name, fid, fragment, times), whole names in a task and in order."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        """A name's only fragment shares no string with another one: its strings repeat if it does itself."""
        alone = Counter(r[0] for r in rows)
        sure = [(r[1], [0, len(r[2]) - width + 1]) for r in rows if alone[r[0]] == 1 and r[3] > 1]
        rows = [r for r in rows if alone[r[0]] > 1]
        ids = {m: i for i, m in enumerate(dict.fromkeys(r[0] for r in rows))}
        runs = repeated([r[2] for r in rows], [r[3] for r in rows], [ids[r[0]] for r in rows], width) if rows else []
        sure += [(r[1], x) for r, x in zip(rows, runs, strict=True) if x]
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in sure], pa.binary()), pa.array([x for _, x in sure], pa.list_(pa.int32()))], ["fid", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("name", "fid", "fragment", "times")), strict=True):
                if size > SORT_BYTES and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield flush(rows)

    dealt = fragments.select("name", "fid", "fragment", "times").repartition("name").sortWithinPartitions("name")
    return dealt.mapInArrow(run, "fid binary, runs array<int>")


def _cut(found: DataFrame, width: int) -> DataFrame:
    """(sha, n_removed, n_spans, cut_sha256, kept) for found (sha, text, hits: places of pieces with the runs of starts to remove)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["sha", "n_removed", "n_spans", "cut_sha256", "kept"], [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            out = []
            for k, (sha, text) in enumerate(zip(batch.column("sha").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                raw = text.encode()
                edge = np.zeros(len(raw) + 1, np.int32)
                for hit in batch.column("hits")[k].as_py():
                    at, runs = np.asarray(hit["at"]), hit["runs"]
                    for a, b in zip(runs[::2], runs[1::2], strict=True):
                        np.add.at(edge, at + a, 1)
                        np.add.at(edge, at + b - 1 + width, -1)
                gone = np.cumsum(edge)[:-1] > 0
                spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((sha, int(gone.sum()), spans, hashlib.sha256(kept).digest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], names)

    return found.mapInArrow(run, "sha binary, n_removed long, n_spans long, cut_sha256 binary, kept binary")


def remove_repeated_bytes(docs: DataFrame, key: str = "doc_id", width: int = 200, with_bytes: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (key, text); with_bytes adds kept, the remaining bytes where
    some but not all were removed, else null.

    A byte goes if a string of width bytes that covers it occurs at another place too, in any row or its own; strings are judged on
    the input, and every occurrence goes. Null texts are empty; repeated rows are copies of each other and go whole if they have
    width bytes; keys are passed on as they are, null and repeated ones too; further columns are not looked at; no rows give no rows.

    Copies of a whole text are found by their digest and stand for one another in all later steps. Names of cores meet in one shuffle,
    to which a task sends a name once for each part of text it works on, however many texts there have it. Fragments with a name that
    has more than HOT different ones are dealt out by their strings instead."""
    if not GRAM + STEP <= width:
        raise ValueError(f"width must be {GRAM + STEP} at least")
    told = materialize(_tell(docs, key, width), "bytes")
    texts = told.groupBy("sha").agg(F.count("*").alias("copies"), F.min("rid").alias("rid"), F.min(key).alias("_key"), F.first("n_bytes").alias("n_bytes"))
    names = told.select("rid", F.explode("single").alias("name"), F.lit(False).alias("lead")).union(told.select("rid", F.explode("lead"), F.lit(True)))
    all_of = Window.partitionBy("name")
    names = names.withColumn("shared", (F.min("rid").over(all_of) < F.max("rid").over(all_of)) | F.max("lead").over(all_of))
    wanted = names.filter("shared AND NOT lead").groupBy("rid").agg(F.collect_set("name").alias("names"))
    wanted = wanted.union(told.filter(F.size("known") > 0).select("rid", "known")).groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_set("names"))).alias("names"))
    one = texts.filter(F.col("n_bytes") >= width).join(wanted, "rid").select("sha", "_key", "names", "copies")
    raw = docs.select(F.col(key).alias("_key"), text_of().alias("text")).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    found = raw.alias("r").join(one.alias("o"), (F.col("r.sha") == F.col("o.sha")) & F.col("r._key").eqNullSafe(F.col("o._key")))
    found = materialize(found.select("o.sha", "text", "names", "copies"), "found")
    cores = materialize(_fragments(found, width), "fragments")
    each = materialize(cores.groupBy("name", "fid", "fragment").agg(F.sum(F.size("at") * F.col("copies")).alias("times")), "distinct")
    hot = each.groupBy("name").count().filter(F.col("count") > HOT).select("name")
    runs = _sorted(each.join(hot, "name", "left_anti"), width).union(_hot(each.join(hot, "name", "left_semi"), width))
    partly = found.filter("copies = 1").select("sha", "text")
    hits = cores.select("sha", "fid", "at").join(runs, "fid").groupBy("sha").agg(F.collect_list(F.struct("at", "runs")).alias("hits"))
    cut = _cut(partly.join(hits, "sha"), width)
    cut = cut if with_bytes else cut.drop("kept")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    out = told.select(key, "n_bytes", "sha").join(texts.select("sha", "copies"), "sha").join(cut, "sha", "left")
    zero = F.lit(0).cast("long")
    digest = F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex(F.coalesce("cut_sha256", "sha"))))
    more = [F.when(~whole & (F.col("n_removed") < F.col("n_bytes")), F.col("kept")).alias("kept")] if with_bytes else []
    removed, spans = F.coalesce("n_removed", zero), F.coalesce("n_spans", zero)
    return out.select(key, "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(removed).alias("n_removed"), F.when(whole, F.lit(1).cast("long")).otherwise(spans).alias("n_spans"), digest.alias("kept_sha256"), *more)


def _hot(fragments: DataFrame, width: int) -> DataFrame:
    """(fid, runs) of fragments whose name has too many: each string is a fragment of its own, named by its digest, so equal ones meet
    already counted and a name has one string."""
    places = F.sequence(F.lit(0), F.length("fragment") - width)
    strings = fragments.select("fid", "times", F.posexplode(F.transform(places, lambda j: F.substring("fragment", j + 1, F.lit(width)))).alias("at", "string"))
    strings = strings.select("fid", "at", "times", F.substring(F.unhex(F.sha2("string", 256)), 1, 16).alias("sid"), "string")
    each = strings.groupBy("sid", "string").agg(F.sum("times").alias("times"))
    found = _sorted(each.select(F.xxhash64("sid").alias("name"), F.col("sid").alias("fid"), F.col("string").alias("fragment"), "times"), width)
    hits = strings.select("fid", "at", "sid").join(found.select(F.col("fid").alias("sid")), "sid")
    return hits.groupBy("fid").agg(F.flatten(F.transform(F.sort_array(F.collect_set("at")), lambda a: F.array(a, a + 1))).alias("runs"))
