"""suggest_from over long names that share beginnings or ends: right against all pairs, with few strings."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import profile


def edited(rng, text, edits):
    for _ in range(edits):
        k, c = rng.randrange(len(text) + 1), rng.choice("ab01é")
        text = rng.choice((text[:k] + c + text[k:], text[:k] + c + text[k + 1 :], text[: max(0, k - 1)] + text[k:]))
    return text


@pytest.mark.parametrize("backwards", [False, True])
def test_halves_equal_all_pairs(spark, tmp_path, monkeypatch, backwards):
    monkeypatch.setattr(profile, "SHARED", 1)
    monkeypatch.setattr(profile, "HEADS", 1000)
    rng, turn = random.Random(7), (lambda s: s[::-1]) if backwards else (lambda s: s)
    names = [turn(rng.choice(("abbéab#", "ab", "baab_b")) + "".join(rng.choice("01") for _ in range(rng.randrange(4, 14)))) for _ in range(150)]
    asked = [edited(rng, rng.choice(names), rng.randrange(7)) for _ in range(250)] + ["", "ABBAAB#0101010", "0" * 14, names[0]]
    df = spark.createDataFrame([(c, k) for k, c in enumerate(names)], "name string, place int")
    long = df.filter("length(name) > 12")
    assert long.count() > 50 and profile._Halves(df, 3, lambda x, _: x).used
    inputs = spark.createDataFrame([(x,) for x in asked], "input string")
    near = inputs.distinct().join(df, F.levenshtein("input", "name") <= 3, "left").groupBy("input").agg(F.min(F.struct(F.levenshtein("input", "name").alias("d"), "place", "name")).alias("c"))
    want = {r["input"]: r["n"] or "" for r in near.select("input", F.col("c.name").alias("n")).collect()}
    got = dict(profile.suggest_from(inputs, df, str(tmp_path / "s")).collect())
    assert got == want and 20 < sum(x != "" for x in got.values()) < len(got)


def test_shared_halves_make_few_strings(spark, tmp_path, monkeypatch):
    """A name of 18 characters has 988 strings with up to three left out; of these names all but the first half's matter to none."""
    made = []
    kind = type(spark.range(1))
    explain = lambda df: made.append(df) if "Join [_s#" in df._jdf.queryExecution().executedPlan().toString() else None
    names = spark.range(400).select(F.format_string("Customer#%09d", "id").alias("name"), F.col("id").alias("place"))
    asked = names.select(F.expr("if(place % 2 = 0, upper(name), replace(replace(name, 'C', 'K'), 'm', 'n') || 'x')").alias("input"))
    write = kind.write.fget
    monkeypatch.setattr(kind, "write", property(lambda df: (explain(df), write(df))[1]))
    got = profile.suggest_from(asked, names, str(tmp_path / "s"))
    monkeypatch.undo()
    assert got.filter("suggestion <> ''").count() == 200
    assert len(made) == 3
    sides = [profile._Halves(names, 3, lambda x, _: x).strings(asked, d) for d in (1, 2, 3)]
    assert max(theirs.count() for _, theirs in sides) <= 400 * 10 and max(own.count() for own, _ in sides) <= 200 * 20
