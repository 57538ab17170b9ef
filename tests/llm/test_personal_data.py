"""Surrogates against a plain Python reading of the same texts: format, script, coreference, distinctness."""

import random

import regex
from pyspark.sql import functions as F

from ledgerline.llm import pii

ROWS = [
    (1, "Call +49 30 1234567 or +49301234567. Mr Jean-Luc Picard met Mr Picard and Dr O'Neil-Smith; Mr Smith's dog."),
    (2, "password=Hunter22, Password: Hunter22. pwd='Hunter22' secret=abcdef0123456789 token: ghp_abcdefghijABCDEFGHIJ1 and ghp_abcdefghijABCDEFGHIJ1"),
    (3, "Иван.п@mail.com; Herr Ωμέγας; госпожа Анна Петрова and Frau Σοφία Ωμέγας, Mr Էդուարդ Սիրունի"),
    (4, "999.999.999.999 is no address, 10.20.30.40 is; (415) 555-2671, 415-555-2671 and +1 415 555 2671 are one number"),
    (5, "Dr Wanda Stone, Ms Wanda Stone, Prof Kim Stone; Mrs Wanda Stone; 4041 8949 7460 8795 / 4041894974608795 / 4041-8949-7460-8795"),
    (6, "DEADBEEFdeadbeefDEADBEEFdeadbeef; deadbeefdeadbeefdeadbeefdeadbeef; A.B@C.org; a.b@c.org; 123-45-6789"),
]
SPELL = regex.compile(pii.PATTERN)


def pairs(spark, rows):
    """(spelling, replacement) of all entities, after a check that nothing else of the texts has changed."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.replace_entities(docs).collect()}
    found = []
    for i, text in rows:
        spans = [m.span() for m in SPELL.finditer(text)]
        assert out[i]["n_entities"] == len(spans)
        gaps, at = [], 0
        for a, b in spans:
            gaps.append(text[at:a])
            at = b
        gaps.append(text[at:])
        m = regex.fullmatch("(.+?)".join(map(regex.escape, gaps)) if spans else regex.escape(text), out[i]["text"], regex.S)
        assert m, (text, out[i]["text"])
        found += list(zip((text[a:b] for a, b in spans), m.groups(), strict=True))
    return found


def test_spellings_of_one_entity_stay_one(spark):
    got = dict(pairs(spark, ROWS))
    digits = lambda s: regex.sub(r"\D", "", s)
    assert digits(got["+49 30 1234567"]) == digits(got["+49301234567"]) and got["+49 30 1234567"].startswith("+49 ")
    assert digits(got["+1 415 555 2671"]) == "1" + digits(got["(415) 555-2671"]) == "1" + digits(got["415-555-2671"])
    secrets = {got[s][len(front) :] for s, front in (("password=Hunter22", "password="), ("Password: Hunter22", "Password: "), ("pwd='Hunter22", "pwd='"))}
    assert len(secrets) == 1 and regex.fullmatch(r"[A-Z][a-z]{5}\d\d", secrets.pop())
    assert got["token: ghp_abcdefghijABCDEFGHIJ1"] == "token: " + got["ghp_abcdefghijABCDEFGHIJ1"] and got["ghp_abcdefghijABCDEFGHIJ1"].startswith("ghp_")
    assert regex.fullmatch(r"secret=[0-9a-f]{16}", got["secret=abcdef0123456789"])
    picard = got["Mr Picard"].split()[-1]
    assert regex.fullmatch(rf"Mr \p{{Lu}}\p{{Ll}}+-\p{{Lu}}\p{{Ll}}+ {picard}", got["Mr Jean-Luc Picard"])
    smith = got["Mr Smith"].split()[-1]
    assert regex.fullmatch(rf"Dr O'\p{{Lu}}\p{{Ll}}+-{smith}", got["Dr O'Neil-Smith"])
    assert got["Dr Wanda Stone"][3:] == got["Ms Wanda Stone"][3:] == got["Mrs Wanda Stone"][4:] and got["Prof Kim Stone"].split()[-1] == got["Dr Wanda Stone"].split()[-1]
    cards = {digits(got[s]) for s in got if s.startswith("4041")}
    assert len(cards) == 1 and regex.fullmatch(r"4\d{3}-\d{4}-\d{4}-\d{4}", got["4041-8949-7460-8795"])
    assert got["DEADBEEFdeadbeefDEADBEEFdeadbeef"].lower() == got["deadbeef" * 4] and got["A.B@C.org"].lower() == got["a.b@c.org"]
    assert "999.999.999.999" not in got and "10.20.30.40" in got and len({v.split()[-1] for s, v in got.items() if s.endswith("Ωμέγας")}) == 1


def test_scripts_are_kept(spark):
    got = dict(pairs(spark, ROWS))
    assert regex.fullmatch(r"\p{IsCyrillic}+\.\p{IsCyrillic}@[a-z]{4}\.com", got["Иван.п@mail.com"])
    assert regex.fullmatch(r"Herr \p{IsGreek}+", got["Herr Ωμέγας"]) and regex.fullmatch(r"госпожа \p{IsCyrillic}+ \p{IsCyrillic}+", got["госпожа Анна Петрова"])
    assert regex.fullmatch(r"Mr \p{IsArmenian}+ \p{IsArmenian}+", got["Mr Էդուարդ Սիրունի"])


def test_different_entities_stay_different(spark):
    rng = random.Random(5)
    people = [f"Mr {a}{b} {c}{d}" for a in ("Jo", "Ka", "Lu", "Mi") for b in ("hn", "rl", "ke") for c in ("Sm", "Br", "Tr", "Kl") for d in ("ith", "own", "unk", "oss", "ein")]
    mails = [f"{a}@{b}.org" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdef"]
    ips = [f"10.0.{a}.{b}" for a in range(8) for b in range(30)]
    secrets = [f"pwd={k:06}" for k in range(0, 999_999, 2500)]
    rows = [(k, " , ".join(rng.sample(xs, len(xs)))) for k, xs in enumerate((people, mails, ips, secrets, people[:9]))]
    found = pairs(spark, rows)
    got = dict(found)
    assert len(set(got.values())) == len(got) == len(set(people + mails + ips + secrets)) and not set(got) & set(got.values())
    assert all(got[s] == v for s, v in found)  # the same in all documents
    assert len({(s.split()[1], v.split()[1]) for s, v in got.items() if s.startswith("Mr ")}) == 12 and len({(s.split()[2], v.split()[2]) for s, v in got.items() if s.startswith("Mr ")}) == 20


def test_whole_tables(spark):
    """All entities of a test table: one surrogate each, none of them an entity, nothing else changed."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = pairs(spark, [tuple(r) for r in docs.filter("text is not null").collect()])
    got = dict(found)
    assert got and all(got[s] == v for s, v in found) and not set(got) & set(got.values())


def test_awkward_rows(spark):
    rows = [(None, "a.b@c.org", 1, "x"), (None, "a.b@c.org", 1, "x"), (2**60 + 1, None, 2, None), (3, "", 3, ""), (4, "long " * 50_000 + "Mr Smith", 4, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_entities int, `put.kind` string").withColumnRenamed("put.kind", "put")
    got = pii.replace_entities(docs)
    assert got.columns == ["doc_id", "text", "put", "n_entities", "entity_kinds"]
    told = {(r["doc_id"], r["put"]): r for r in got.collect()}
    assert got.count() == 5 and told[2**60 + 1, None]["text"] is None and told[3, ""]["n_entities"] == 0 and told[4, "y"]["entity_kinds"] == "name"
    assert len({r["text"] for r in got.filter("doc_id is null").collect()}) == 1
    assert pii.without_personal_data(docs.withColumn("n_chars", F.length("text").cast("long"))).columns == [*docs.columns, "n_chars"]
    assert pii.replace_entities(docs.limit(0)).count() == 0


def test_mentions_of_detected_names(spark):
    """Words of a text's names stand for the name wherever they are capitalised in that text, and nowhere else."""
    rows = [
        (1, "Mr John Smith called. Smith said John is home; SMITH's smith, Smithson and Johnny stay. O'Smith-Jones came."),
        (2, "Smith and John are not named here, but Ms Clara Jones is: Jones, Clara! a.b@c.orgClara"),
        (3, "Smith, Jones"),
        (4, "Frau Σοφία Ωμέγας kam. Σοφία ging, ΩΜΈΓΑΣ nicht."),
    ]
    got = {r["doc_id"]: r["text"] for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    john, smith = regex.match(r"Mr (\p{Lu}\p{Ll}+) (\p{Lu}\p{Ll}+) called", got[1]).groups()
    assert got[1] == f"Mr {john} {smith} called. {smith} said {john} is home; {smith.upper()}'s smith, Smithson and Johnny stay. O'{smith}-Jones came." and smith != "Smith" and john != "John"
    clara, jones = regex.search(r"Ms (\w+) (\w+) is", got[2]).groups()
    assert got[2].startswith(f"Smith and John are not named here, but Ms {clara} {jones} is: {jones}, {clara}! ") and got[3] == rows[2][1]
    sofia, omega = regex.match(r"Frau (\w+) (\w+) kam", got[4]).groups()
    assert got[4] == f"Frau {sofia} {omega} kam. {sofia} ging, {omega.upper()} nicht."


def test_recall_of_planted_mentions(spark):
    """A name planted with its title once and without it in many places of a test table's texts: no word of it is left."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 200").select("doc_id", "text")
    planted = [(r["doc_id"], r["text"], f"Q{chr(97 + k % 26)}x{chr(97 + k // 26 % 26)}vor", f"Z{chr(97 + k % 26)}qu{chr(97 + k // 26 % 26)}lin") for k, r in enumerate(docs.orderBy("doc_id").collect())]
    rows = []
    for k, (i, text, a, b) in enumerate(planted):
        parts = text.split(" ")
        for j in range(3, len(parts), max(3, len(parts) // 10)):
            parts[j] += f" {(a, b, f'{a} {b}', b.upper())[j % 4]}"
        rows.append((i, f"Dr {a} {b} " + " ".join(parts)))
    out = {r["doc_id"]: r["text"] for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = sum(len(regex.findall(rf"(?i)\b(?:{a}|{b})\b", out[i])) for i, _, a, b in planted)
    total = sum(len(regex.findall(rf"(?i)\b(?:{a}|{b})\b", text)) for (_, text), (_, _, a, b) in zip(rows, planted, strict=True))
    assert total > 1000 and left == 0


def test_account_numbers_and_long_addresses(spark):
    accounts = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "FR1420041010050500013M02606"]
    addresses = ["2001:db8:0:1:1:1:1:1", "2001:DB8::42", "fe80::1ff:fe23:4567:890a"]
    plain = "at 12:30:45 std::vector Add::Bad AB12 CDEF GHIJ KLMN"
    got = dict(pairs(spark, [(1, "; ".join(accounts) + " PLEASE"), (2, ", ".join(addresses)), (3, plain)]))
    assert set(got) == {*accounts, *addresses}
    for s in accounts:
        value = got[s].replace(" ", "")
        assert len(got[s]) == len(s) and value[:2] == s[:2] and got[s] != s and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1
        assert all(a.isdigit() == b.isdigit() and (a == " ") == (b == " ") for a, b in zip(s, got[s], strict=True))
    assert got[accounts[0]] == got[accounts[1]].replace(" ", "") and all(regex.fullmatch("fd[0-9a-f]{2}(?::[0-9a-f]{4}){7}", got[a]) for a in addresses) and len({got[a] for a in addresses}) == 3
