"""Repair of damaged conversations by a dynamic program with square-root checkpoints.

A repaired conversation reads `(s?(ua)+)?` by the first characters of its roles. A state is what has been read: 0 nothing,
1 the system turn, 2 a user turn, 3 a whole pair. The cost of getting from a state to a good end is computed backwards;
only every sqrt(n)-th cost vector is stored, and the vectors of one block at a time are computed again while a walk from the
front takes, among the tight edits, the one whose initial is least.

Conversations are ranges of the rows sorted by conversation and turn. One that ends within a task is repaired there. A longer
one, or one that a range boundary cuts, is taken in blocks: each block's rows become a 4 x 4 matrix of least costs, a backward
scan over matrices gives the cost vector at each block's end (the checkpoints), each block walks from all four states, a
forward scan picks the walks that meet, and only the hash, which no one can compute in parts, reads a conversation's texts in
one stream."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A block holds so many rows, or so many characters of text and the row that goes beyond them.
BLOCK_ROWS, BLOCK_CHARS = 1024, 256 << 10
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 60
SPACE = " \t\n\x0b\x0c\r"
#: The state that a user or assistant turn leads to, and the role it then has.
TO = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
END = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with damage by crc32 of `conv_id:turn`, modulo 20; null values count as one space there and in
    role and text. Dropped rows stay, with gone, so that their conversation is known."""
    fault = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(fault == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(fault == 0))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(copies).alias("gone"))


def _flag(text: str, again: bool) -> str:
    bare = text.rstrip(SPACE)
    return "b" if not bare else "d" if again else "." if bare[-1] in ".!?" else "t"


def _insert(b: list[int]) -> list[int]:
    two, three = min(b[2], INSERT + b[3]), min(b[3], INSERT + b[2])
    return [min(b[0], INSERT + two), min(b[1], INSERT + two), two, three]


def _before(initial: str, flag: str, v: list[int]) -> list[int]:
    """Least costs before a row from those after it."""
    b = [DELETE + x for x in v]
    if flag not in "bd":
        extra = TRUNCATED if flag == "t" else 0
        for s in range(4):
            b[s] = min(b[s], extra + (KEEP if initial == ROLE[s][0] else REROLE) + v[TO[s]])
        if initial == "s":
            b[0] = min(b[0], extra + KEEP + v[1])
    return _insert(b)


def costs_back(initials: list[str], flags: str, v: list[int]) -> Iterator[tuple[int, list[int]]]:
    """(i, least costs before row i) from the last row to the first, given those after all."""
    for i in range(len(flags) - 1, -1, -1):
        v = _before(initials[i], flags[i], v)
        yield i, v


def walk(initials: list[str], flags: str, end: list[int], state: int) -> tuple[str, int]:
    """The least audit among the cheapest edits from state, and the state after all rows."""
    n = len(flags)
    step = max(1, int(n**0.5))
    marks = {n: end} | {i: v for i, v in costs_back(initials, flags, end) if i % step == 0}
    out = []
    for a in range(0, n, step):
        z = min(n, a + step)
        v = dict(costs_back(initials[a:z], flags[a:z], marks[z])) | {z - a: marks[z]}
        for i in range(a, z):
            here, after, initial, flag = v[i - a], v[i - a + 1], initials[i], flags[i]
            extra = TRUNCATED if flag == "t" else 0
            while True:
                if here[state] == DELETE + after[state]:
                    out.append("D")
                    break
                if here[state] == INSERT + here[TO[state]]:
                    out.append("I")
                    state = TO[state]
                    continue
                if flag not in "bd" and initial == "s" and state == 0 and here[0] == extra + after[1]:
                    out.append("K")
                    state = 1
                    break
                out.append("K" if initial == ROLE[state][0] and here[state] == extra + KEEP + after[TO[state]] else "R")
                state = TO[state]
                break
    return "".join(out), state


def tail(state: int) -> str:
    return "I" * (END[state] // INSERT)


def lines(audit: str, rows: list[tuple[str, str]], flags: str, state: int) -> tuple[list[str], int, int]:
    """(`role:text` of each repaired row, cost, state after them)."""
    out, cost, i = [], 0, 0
    for edit in audit:
        if edit == "D":
            cost += DELETE
            i += 1
            continue
        if edit == "I":
            out.append(ROLE[state] + ":")
            cost += INSERT
            state = TO[state]
            continue
        role, text = rows[i]
        cost += (REROLE if edit == "R" else KEEP) + (TRUNCATED if flags[i] == "t" else 0)
        out.append(f"{ROLE[state] if edit == 'R' else role}:{text}")
        state = 1 if edit == "K" and role[:1] == "s" and state == 0 else TO[state]
        i += 1
    return out, cost, state


def _faults(rows: list[tuple[str, str]], earlier: set[bytes]) -> str:
    seen, out = set(), []
    for role, text in rows:
        out.append(_flag(text, (role, text) in seen or bool(earlier) and _mark(role, text) in earlier))
        seen.add((role, text))
    return "".join(out)


def _mark(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


class _Gaps:
    """Turns in order: least, greatest and number of different ones."""

    def __init__(self) -> None:
        self.low = self.high = None
        self.n = 0

    def add(self, low: int | None, high: int | None, n: int) -> None:
        if n:
            self.n += n - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high

    def turns(self, turns: list[int | None]) -> _Gaps:
        for t in turns:
            if t is not None:
                self.add(t, t, 1)
        return self

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.n if self.n else 0


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def repair(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """The values of RESULT for one conversation whose rows are in order."""
    flags, initials = _faults(rows, set()), [r[:1] for r, _ in rows]
    audit, state = walk(initials, flags, list(END), 0)
    audit += tail(state)
    text, cost, _ = lines(audit, rows, flags, 0)
    sha = hashlib.sha256("\n".join(text).encode()).hexdigest()
    return (_Gaps().turns(turns).gaps(), flags.count("b"), flags.count("d"), flags.count("t"), _illegal(initials), cost, audit, sha)


def _ranges(kind: str) -> tuple[Callable, str]:
    """A pass over ranges of sorted rows: results of conversations that begin and end in the range, blocks of the others."""
    block = "id long, turns array<long>, roles array<string>, texts array<string>, marks array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, begun, cut, size = TaskContext.get().partitionId() << 32, 0, False, True, 0
        conv, rows, turns, out = None, [], [], []

        def flush(whole: bool) -> None:
            nonlocal seq, rows, turns, size
            if whole:
                out.append((conv, *repair(turns, rows), *[None] * 5))
            else:
                marks = list({_mark(r, t) for r, t in rows})
                out.append((conv, *[None] * len(NAMES), part + seq, turns, [r for r, _ in rows], [t for _, t in rows], marks))
                seq += 1
            rows, turns, size = [], [], 0

        def table() -> pa.RecordBatch:
            nonlocal out
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)] if out else [pa.array([], f.type) for f in fields]
            out = []
            return pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

        fields = None
        for batch in batches:
            if fields is None:
                strings, longs = pa.list_(pa.string()), pa.list_(pa.int64())
                types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64(), longs, strings, strings, pa.list_(pa.binary())]
                fields = [pa.field("conv_id", batch.schema.field("conv_id").type)] + [pa.field(n, t) for n, t in zip(NAMES + ["id", "turns", "roles", "texts", "marks"], types, strict=True)]
            for c, turn, role, text, gone in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "gone")), strict=True):
                if not begun or c != conv:
                    if begun:
                        flush(not cut)
                    conv, cut, begun = c, not begun, True
                if len(rows) >= BLOCK_ROWS or size > BLOCK_CHARS:
                    cut = True
                    flush(False)
                    if len(out) >= 64:
                        yield table()
                if not gone:
                    rows.append((role, text))
                    turns.append(turn)
                    size += len(text)
            if len(out) >= 64:
                yield table()
        if begun:
            flush(False)
            yield table()

    return run, f"conv_id {kind}, {RESULT}, {block}"


def _arrow(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    for k in range(batch.num_rows):
        yield tuple(batch.column(n)[k].as_py() for n in names)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: faults, least costs from each state to each, and what its neighbours and the counts need."""
    for batch in batches:
        out = []
        for ident, turns, roles, texts, earlier in _rows(batch, "id", "turns", "roles", "texts", "earlier"):
            flags, initials = _faults(list(zip(roles, texts, strict=True)), set(earlier or ())), [r[:1] for r in roles]
            to_each = []
            for x in range(4):
                v = [0 if s == x else FAR for s in range(4)]
                for _, v in costs_back(initials, flags, v):
                    pass
                to_each.append(v)
            g = _Gaps().turns(turns)
            out.append((ident, flags, initials, [to_each[x][e] for e in range(4) for x in range(4)], g.low, g.high, g.n, _illegal(initials)))
        yield _arrow(out, ["id", "flags", "initials", "matrix", "low", "high", "n", "illegal"], [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.int64()] * 4])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Backward scan: each block's cost vector at its end. Blocks come by conversation, last first."""
    last, v = (), list(END)
    for batch in batches:
        out = []
        for conv, ident, m in _rows(batch, "conv_id", "id", "matrix"):
            if last != (conv,):
                last, v = (conv,), list(END)
            out.append((ident, v))
            v = _insert([min(m[4 * e + x] + v[x] for x in range(4)) for e in range(4)])
        yield _arrow(out, ["id", "ends"], [pa.int64(), pa.list_(pa.int64())])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for ident, flags, initials, v in _rows(batch, "id", "flags", "initials", "ends"):
            walks = [walk(initials, flags, v, s) for s in range(4)]
            out.append((ident, [a for a, _ in walks], [s for _, s in walks]))
        yield _arrow(out, ["id", "audits", "exits"], [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forward scan: the state each block is entered in. Blocks come by conversation, first first."""
    last, state = (), 0
    for batch in batches:
        out = []
        for conv, ident, exits in _rows(batch, "conv_id", "id", "exits"):
            if last != (conv,):
                last, state = (conv,), 0
            out.append((ident, state))
            state = exits[state]
        yield _arrow(out, ["id", "entry"], [pa.int64(), pa.int32()])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for ident, roles, texts, flags, audits, entry in _rows(batch, "id", "roles", "texts", "flags", "audits", "entry"):
            text, cost, state = lines(audits[entry], list(zip(roles, texts, strict=True)), flags, entry)
            out.append((ident, "\n".join(text).encode(), len(text), cost, audits[entry], state))
        yield _arrow(out, ["id", "chunk", "n_lines", "cost", "audit", "exit"], [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int32()])


def _close(kind: str) -> tuple[Callable, str]:
    """The results of conversations from their blocks, in order; of the texts only one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}

        def result() -> tuple:
            state, more = now["exit"], tail(now["exit"])
            for _ in more:
                line(f"{ROLE[state]}:".encode())
                state = TO[state]
            return (now["conv"], now["gaps"].gaps(), *now["counts"], now["cost"] + INSERT * len(more), "".join(now["audit"]) + more, now["sha"].hexdigest())

        def line(chunk: bytes) -> None:
            if now["any"]:
                now["sha"].update(b"\n")
            now["sha"].update(chunk)
            now["any"] = True

        names, types = ["conv_id", *NAMES], None
        for batch in batches:
            types = types or [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            out = []
            for conv, flags, initials, low, high, n, illegal, chunk, n_lines, cost, audit, state in _rows(batch, "conv_id", "flags", "initials", "low", "high", "n", "illegal", "chunk", "n_lines", "cost", "audit", "exit"):
                if now.get("conv", ()) != conv:
                    if now:
                        out.append(result())
                    now = {"conv": conv, "gaps": _Gaps(), "counts": [0] * 4, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False, "last": None}
                now["gaps"].add(low, high, n)
                seam = bool(initials) and now["last"] is not None and now["last"] + initials[0] not in LEGAL
                now["counts"] = [a + b for a, b in zip(now["counts"], (flags.count("b"), flags.count("d"), flags.count("t"), illegal + seam), strict=True)]
                now["last"] = initials[-1] if initials else now["last"]
                now["cost"] += cost
                now["audit"].append(audit)
                now["exit"] = state
                if n_lines:
                    line(chunk)
            yield _arrow(out, names, types)
        if now:
            yield _arrow([result()], names, types)

    return run, f"conv_id {kind}, {RESULT}"


def _by_blocks(blocks: DataFrame, kind: str) -> DataFrame:
    """Results of conversations that are given in blocks; every step but the last deals blocks out by their number."""
    seen = blocks.select("id", "conv_id", F.explode("marks").alias("mark"))
    first = seen.groupBy("conv_id", "mark").agg(F.min("id").alias("first"), F.count("*").alias("times")).filter("times > 1").select(F.col("conv_id").alias("_c"), F.col("mark").alias("_m"), "first")
    again = seen.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("mark") == F.col("_m"))).filter("id > first")
    earlier = again.groupBy("id").agg(F.collect_list("mark").alias("earlier"))
    texts = blocks.select("id", "turns", "roles", "texts").join(earlier, "id", "left")
    told = texts.mapInArrow(_describe, "id long, flags string, initials array<string>, matrix array<long>, low long, high long, n long, illegal long")
    told = materialize(blocks.select("id", "conv_id").join(told, "id"), "blocks")
    ends = told.select("conv_id", "id", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("id")).mapInArrow(_ends, "id long, ends array<long>")
    walks = materialize(told.join(ends, "id").select("id", "flags", "initials", "ends").mapInArrow(_walks, "id long, audits array<string>, exits array<int>"), "walks")
    met = told.select("conv_id", "id").join(walks.select("id", "exits"), "id").repartition("conv_id").sortWithinPartitions("conv_id", "id").mapInArrow(_meet, "id long, entry int")
    built = blocks.select("id", "roles", "texts").join(told.select("id", "flags"), "id").join(walks.select("id", "audits"), "id").join(met, "id")
    built = built.mapInArrow(_build, "id long, chunk binary, n_lines long, cost long, audit string, exit int")
    run, schema = _close(kind)
    return told.drop("matrix").join(built, "id").repartition("conv_id").sortWithinPartitions("conv_id", "id").mapInArrow(run, schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id and the values of RESULT for each conversation of rows (conv_id, turn, role, text) after damage; further columns of
    rows are not looked at.

    Nulls: role and text count as one space; a null conv_id is a conversation of its own; null turns come first and count for no
    gap. Turns that tie go by role, then text (both by UTF-8 bytes); repeated rows are duplicates. Roles other than user, assistant
    and system, empty ones among them, can only be deleted or given a role, but only their first character is looked at. Empty
    and space-only texts are blank. A conversation without rows after damage has zeros, an empty audit and the hash of nothing;
    no rows give no rows. Texts of any length are taken whole."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", F.asc_nulls_first("turn"), "role"]
    sorted_rows = damaged(rows).repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    run, schema = _ranges(kind)
    done = materialize(sorted_rows.mapInArrow(run, schema), "conversations")
    whole = done.filter(F.col("id").isNull()).select("conv_id", *NAMES)
    cut = done.filter(F.col("id").isNotNull()).select("conv_id", "id", "turns", "roles", "texts", "marks")
    return whole.unionByName(_by_blocks(cut, kind))
