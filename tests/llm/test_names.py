"""Names of words and units that tell apart what a polynomial hash does not; extreme ids; letters; tails; clashing columns."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import fingerprints, langid, mixing, neardup, pieces, quality, substrings, textnum, toxicity

SIZES = (1024, 2048, 4096)


def thue_morse(n):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_polynomials_have_names_of_their_own():
    for n in SIZES:
        for seed in (0, 1):
            h, _ = textnum.hash_words([" ".join(thue_morse(n)).encode()], seed=seed)
            assert len(set(h.tolist())) == 2
    tails = [b"abcdefgh", b"abcdefg", b"abcdefgh\x01", b"abcdefg\x01", b"a", b"a\x01", b"bcdefgha", b"abcdefghabcdefgh"]
    h, offsets = textnum.hash_words([b" ".join(tails), b"", b"  a\tabcdefg"])
    assert len(set(h[:8].tolist())) == 8 and offsets.tolist() == [0, 8, 8, 10] and h[8:].tolist() == [h[4], h[1]]
    assert textnum.hash_words([b"ABz"], lower=True)[0] == textnum.hash_words([b"abz"])[0]


@pytest.mark.parametrize("n", SIZES)
def test_such_words_are_no_repeats(spark, n):
    one, two = thue_morse(n)
    rows = [(1, " ".join([one] * 60)), (2, " ".join([two] * 60)), (3, " ".join([two] * 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(docs).collect()) == [(1, 0), (2, 0), (3, 50)]
    near = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, width=3, percent=85).collect()}
    assert near == {1: (1, True), 2: (2, True), 3: (2, False)}


def test_units_of_one_name_are_cut_apart():
    v = pieces.vocabulary(pieces.MODEL)
    for n in SIZES:
        one, two = thue_morse(n)
        texts = [one, two, f"{two} {one} {two}", one]
        ids, offsets = pieces.cut_texts(v, texts)
        alone = [pieces.cut_texts(v, [t])[0].tolist() for t in (one, two)]
        assert ids[offsets[0] : offsets[1]].tolist() == alone[0] and ids[offsets[1] : offsets[2]].tolist() == alone[1] and ids[offsets[3] : offsets[4]].tolist() == alone[0]


def test_round_trip_of_such_units(spark):
    texts = [t for n in SIZES for t in thue_morse(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r[0]: r["decoded"] for r in pieces.encode_small(docs, ["doc_id"], pieces.MODEL).collect()}
    assert got == dict(enumerate(texts))


def test_numbers_are_no_letters(spark):
    rows = [(k, "the cat and the dog of the house " * 5, "en", "s") for k in range(40)] + [(90, "½ ² ③ –", "en", "s"), (91, "x", "en", "s"), (92, "4", None, "s")]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (got[90], got[91], got[92]) == ("und", "en", "und")


def test_ids_at_both_ends(spark):
    ids = [-(2**63) + 1, 2**63 - 1, 0, 5, None, *range(1000, 1200)]
    docs = spark.createDataFrame([(i, f"text number {k} of many") for k, i in enumerate(ids)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_chars"] for r in fingerprints.fingerprints(docs).collect()}
    assert set(got) == set(ids)


def test_null_stratum_is_its_own(spark):
    """Good documents without a language have many symbols, those of a language called `(null)` none: only there is a cutoff."""
    text = lambda k, bad: " ".join(f"w{k}x{j}" + "#|" * 12 * bad for j in range(60))
    rows = [(k, text(k, k % 2 == 0), "(null)" if k % 4 < 2 else None) for k in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 2 or lang is None)) for k, _, lang in rows], "doc_id long, quality int")
    got = quality.quality_rules(docs, labels).join(docs.select("doc_id", "lang"), "doc_id")
    told = {(r["lang"], r["doc_id"] % 2): r["kept"] for r in got.collect()}
    assert told == {("(null)", 0): False, ("(null)", 1): True, (None, 0): True, (None, 1): True}
    assert {r["stratum"] for r in got.select("stratum").distinct().collect()} == {"(null)"}


def test_tail_of_many_draws(spark):
    def plain(n, k, p):
        terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
        top = max(terms)
        return top + math.log(math.fsum(math.exp(t - top) for t in terms))

    cases = [(1, 0), (20, 0), (20, 1), (20, 20), (21, 3), (500, 4), (500, 10), (500, 300), (40_000, 700), (100_000, 2100)]
    got = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.log_binomial_tail(F.col("n"), F.col("k"), 0.02).alias("t")).collect()
    for r in got:
        assert r["t"] == pytest.approx(plain(r["n"], r["k"], 0.02), abs=1e-7)
    big = spark.createDataFrame([(2_000_000_000, 39_950_000), (2_000_000_000, 40_000_000)], "n long, k long").select(quality.log_binomial_tail(F.col("n"), F.col("k"), 0.02).alias("t")).collect()
    assert big[0]["t"] < math.log(1e-14) and big[1]["t"] == pytest.approx(math.log(0.5), abs=1e-3)


def test_columns_named_like_a_stages_own(spark):
    names = ["_row", "_ROW", "_text", "_size", "_taken", "_cut", "_toxicity", "_k", "_doc", "a.b"]
    docs = spark.createDataFrame([(k, f"some words number {k} to go by here", "en", "s", 7, *range(10)) for k in range(6)], ["doc_id", "text", "lang", "source", "n_chars", *[f"c{k}" for k in range(10)]])
    docs = docs.toDF(*docs.columns[:5], *[n if n != "_ROW" else "_row_" for n in names])
    labels = spark.createDataFrame([(0, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for stage in (lambda d: neardup.one_of_each(d), lambda d: mixing.mixed_rows(d), lambda d: toxicity.without_toxic(d, labels)):
        out = stage(docs)
        assert out.columns == docs.columns
        assert {tuple(r)[5:] for r in out.collect()} == {tuple(range(10))}
