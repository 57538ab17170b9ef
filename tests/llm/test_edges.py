"""Keys of any size beside null ones, long headers, draws at scale, segmentations that do not depend on chunks."""

import collections
import hashlib
import random

import numpy as np

from ledgerline.llm import fingerprints as fp
from ledgerline.llm import langid, mixing, neardup, pieces, substrings, warc

BIG = 2**60 + 1


def test_large_keys_beside_null_ones(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(BIG, text, "en", "a"), (None, text, "en", None), (BIG + 2, text + " more", "en", "a"), (None, None, None, "a"), (BIG + 2, text + " more", "en", "a"), (4, "", None, None)], "doc_id long, text string, lang string, source string").coalesce(1)
    want = collections.Counter([BIG, None, BIG + 2, None, BIG + 2, 4])
    keys = lambda df, c="doc_id": collections.Counter(r[c] for r in df.collect())
    near = neardup.near_duplicates(docs, width=3, percent=85)
    assert keys(near) == want and {r["component_id"] for r in near.filter("n_shingles > 0").collect()} == {BIG}
    cut = substrings.remove_repeats(docs)
    assert keys(cut) == want and {(r["doc_id"], r["n_removed"]) for r in cut.collect()} == {(BIG, 0), (None, 0), (BIG + 2, 60), (4, 0)}
    assert keys(langid.language_id(docs)) == want and keys(langid.identify(docs, None, with_spans=True)) == want
    assert keys(mixing.mix(mixing.document_sizes(docs))) == want and keys(fp.fingerprints(docs)) == want and keys(pieces.encode(docs)) == want
    pages = spark.createDataFrame([(BIG, "u", text), (None, "u", text), (BIG + 2, "u", text), (None, None, None)], "page_id long, url string, html string").coalesce(1)
    got = collections.Counter((r["page_id"], r["refers_to"]) for r in warc.warc_round_trip(pages).collect())
    assert got == collections.Counter([(BIG, None), (None, BIG), (BIG + 2, BIG), (None, None)])


def test_long_headers_are_read(spark):
    rng = random.Random(3)
    urls = ["http://x/" + "a" * 100_000, "http://x/" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=2_000_000)), "http://x/" + "".join(rng.choices("abcdef", k=70_000)), "u"]
    html = ["z" * 3_000_000, "short", "", "".join(rng.choices("abcdefgh", k=400_000))]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string").coalesce(1)
    for split in (10_000, 1 << 22):
        got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.warc_round_trip(pages, split).collect()}
        assert got == {k: (len(h), hashlib.sha256(h.encode()).hexdigest()) for k, h in enumerate(html)}


def test_heavy_terms_are_sampled_by_weight(spark):
    """Half the terms weigh 1 and half 10: a text and one with only the heavy half at that weight share 10 / 11."""
    sizes, rows = (100, 2_000, 20_000), []
    for n in sizes:
        for m in range(6 if n > 10_000 else 40):
            heavy, light = [f"h{n}x{m}x{k}" for k in range(n // 2)], [f"l{n}x{m}x{k}" for k in range(n // 2)]
            rows += [(len(rows), " ".join(heavy * 10 + light)), (len(rows) + 1, " ".join(heavy * 10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(docs).select("doc_id", "fingerprint").collect()}
    part = lambda f: [f[8 * k : 8 * k + 8] for k in range(fp.SAMPLES)]
    at = 0
    for n in sizes:
        many = 6 if n > 10_000 else 40
        share = np.mean([np.mean([a == b for a, b in zip(part(found[at + 2 * m]), part(found[at + 2 * m + 1]), strict=True)]) for m in range(many)])
        at += 2 * many
        assert abs(share - 10 / 11) < 4 * np.sqrt(10 / 121 / (many * fp.SAMPLES)), (n, share)


def test_ids_do_not_depend_on_chunks(spark):
    v, rng = pieces.vocabulary(pieces.MODEL), random.Random(9)
    parts = ["a", "aa", "the", " ", "  ", "hello", "é", "日", "\n", "ing", "тест", "111", "-----", "xxxx", "▁", "a▁b"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(150)] + ["a" * 70, "-" * 90, "▁▁ ▁", "日本" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: (r["ids"], r["decoded"]) for r in pieces.encode(docs).collect()}
    assert all(whole[k][1] == t for k, t in enumerate(texts))
    for size in (5, 33):
        assert {r["doc_id"]: (r["ids"], r["decoded"]) for r in pieces.encode(docs, chunk_chars=size).collect()} == whole
    assert v.pieces


def test_repeated_digests_too_many_to_send(spark, monkeypatch):
    """Both ways to find a page's first copy give the same records; short and null pages have none in either."""
    html = ["a" * 200, "b" * 200, "a" * 200, "short", "short", None, "a" * 200, "c" * 99, "c" * 99, "d" * 100, "d" * 100]
    pages = spark.createDataFrame([*((k + 5, f"u{k}", h) for k, h in enumerate(html)), *((k, "hot", "h" * 300) for k in range(1000, 1300)), (None, None, "h" * 300)], "page_id long, url string, html string")
    got = []
    for few in (warc.FEW, 0):
        monkeypatch.setattr(warc, "FEW", few)
        got.append(collections.Counter(tuple(r) for r in warc.warc_round_trip(pages).collect()))
        assert ("BroadcastHashJoin" in warc.plan_records(pages)._jdf.queryExecution().executedPlan().toString() or few == 0)
    refers = {r[0]: r[4] for r in got[0] if r[4] is not None}
    assert got[0] == got[1] and refers == {7: 5, 11: 5, 15: 14, None: 1000} | dict.fromkeys(range(1001, 1300), 1000)
