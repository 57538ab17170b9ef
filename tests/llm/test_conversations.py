"""op12 against a plain program that tries every edit."""

import hashlib
import random
import zlib

import pytest
from ledgerline.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, flags string"
SPACES = " \t\n\x0b\x0c\r"


def plain(rows):
    """conv_id -> the row that the operator must return."""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
        role = "user" if fault == 4 else role
        own += [(turn, role, text)] * (2 if fault == 3 else 1)
    return {k: plain_repair(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) for k, v in convs.items()}


def plain_repair(own):
    turns = {t for t, _, _ in own if t is not None}
    faults, seen = [], set()
    for _, role, text in own:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    cost, audit, text = solve(own, faults)
    initials = [r[:1] for _, r, _ in own]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())


def solve(own, faults):
    """Least (cost, audit) by Bellman-Ford rounds over (row, last initial): each round tries every edit everywhere."""
    states = ["", "s", "u", "a"]
    far = (1 << 40, "", ())
    value = {(i, x): far for i in range(len(own) + 1) for x in states}
    value[len(own), ""] = value[len(own), "a"] = (0, "", ())
    changed = True
    while changed:
        changed = False
        for (i, x), old in list(value.items()):
            follow = {"": "su", "s": "u", "u": "a", "a": "u"}[x]
            found = [old]
            for y in follow.replace("s", ""):
                cost, audit, text = value[i, y]
                found.append((cost + 5, "I" + audit, ({"u": "user:", "a": "assistant:"}[y], *text)))
            if i < len(own):
                cost, audit, text = value[i + 1, x]
                found.append((cost + 2, "D" + audit, text))
                if faults[i] not in ("blank", "duplicate"):
                    extra, (_, role, own_text) = 5 * (faults[i] == "truncated"), own[i]
                    for y in follow:
                        cost, audit, text = value[i + 1, y]
                        if role[:1] == y:
                            found.append((cost + extra, "K" + audit, (f"{role}:{own_text}", *text)))
                        if y != "s":
                            found.append((cost + extra + 1, "R" + audit, ({"u": "user:", "a": "assistant:"}[y] + own_text, *text)))
            least = min(found, key=lambda f: f[:2])
            if least[:2] != old[:2]:
                value[i, x], changed = least, True
    return value[0, ""]


def result(spark, rows):
    got = c.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r["conv_id"]: tuple(r[n] for n in c.NAMES) for r in got}


def some(random_, convs, most):
    rows = []
    for conv in convs:
        for turn in range(random_.randint(1, most)):
            role = random_.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sage"])
            text = random_.choice(["Hello.", "So?", "cut off", "", "  \n", None, "Déjà vu!", f"Number {turn}.", "ends with space. \t"])
            rows.append((conv, random_.choice([turn, turn, turn, None, turn + 3, -turn]), role, text, "clash"))
    return rows


def test_random_conversations(spark):
    rows = some(random.Random(5), [None, *range(150)], 9)
    assert result(spark, rows) == plain(rows)


@pytest.mark.parametrize("size", [3, 7])
def test_blocks(spark, monkeypatch, size):
    """Conversations in many blocks, over many tasks: the same results."""
    monkeypatch.setattr(c, "BLOCK_ROWS", size)
    r = random.Random(size)
    rows = some(r, [1], 400) + some(r, [0, 2, 3, None], 60) + some(r, range(10, 20), 12) + [(7, 5, "user", "Same.", "")] * 90
    assert result(spark, rows) == plain(rows)


def test_edges(spark):
    assert c.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    rows = [(gone, 0, "user", "Hi.", "x"), (5001, None, "user", "w" * 300_000, "x"), (5001, None, "assistant", "y" * 300_000 + ".", "x"), (5002, -(2**40), "system", "A.", "x"), (5002, 2**40, "user", "B.", "x")]
    got = result(spark, rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", empty) and got == plain(rows)


def test_ties_take_the_least_letter():
    """A lone assistant turn: I K costs 5, R I costs 6, D costs 2. Two users: D K I or K R, the cheaper first."""
    assert c.repair([1], [("assistant", "A.")])[5:7] == (2, "D")
    assert c.repair([1, 2], [("user", "A."), ("user", "B.")])[5:7] == (1, "KR")
    assert c.repair([1, 2, 3], [("user", "A."), ("assistant", "B."), ("assistant", "C.")])[5:7] == (2, "KDK")


def test_matrix_of_a_long_conversation():
    """Square-root checkpoints: a walk over 2,000 rows equals the one that keeps every vector."""
    r = random.Random(1)
    initials, flags = [r.choice("suat") for _ in range(2000)], "".join(r.choice("bdt...") for _ in range(2000))
    audit, state = c.walk(initials, flags, list(c.END), 0)
    vectors = dict(c.costs_back(initials, flags, list(c.END)))
    rows = [({"s": "system", "u": "user", "a": "assistant", "t": "tool"}[x], "") for x in initials]
    _, cost, end = c.lines(audit, rows, flags, 0)
    assert end == state and cost + 5 * len(c.tail(state)) == vectors[0][0]
