"""Personal data and secrets: every detected entity gets a keyed surrogate of its own kind and format, the same one
wherever it occurs and however it is spelled, and a different one from all other entities. DataFrame operations only.

An entity as it stands in a text is a spelling. A spelling names one or more units: a phone number its digits, a secret its
value without the keyword, a person's name each of its words. Units get their surrogates once each, by rounds that check
for collisions over the whole corpus; a spelling is then laid out anew from the surrogates of its units, in its own case,
separators and title. So two spellings of one entity stay one, and "Mr X" and "Mr Y X" keep their common word. Where a
word of such a name stands alone in the same text, capitalised, it is a mention and gets that word's surrogate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Courtesy titles by gender, common given names by gender and script, syllables of invented surnames,
# endings of invented given names, letters of scripts, two-digit country codes of phone numbers.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Sr", "Señor", "господин", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Sra", "Señora", "госпожа", "Госпожа")
OTHER_TITLES = ("Dr", "Prof")
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul"),
    ("latin", "f"): ("Alma", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    ("cyrillic", "f"): ("Алла", "Берта", "Вера", "Галина", "Дарья", "Елена", "Инна", "Клара"),
    ("greek", "m"): ("Άγγελος", "Γιάννης", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
    ("greek", "f"): ("Άννα", "Γεωργία", "Δήμητρα", "Ελένη", "Κατερίνα", "Σοφία"),
}
SYLLABLES = {
    "latin": ("ba", "be", "bor", "da", "del", "dor", "fa", "fen", "gar", "gel", "ha", "hol", "ka", "kel", "la", "len", "lo", "ma", "mer", "na", "nor", "pa", "pel", "ra", "ros", "sa", "sel", "ta", "tor", "va", "ven", "wal"),
    "cyrillic": ("ба", "бор", "ва", "вел", "га", "гор", "да", "дел", "ка", "кол", "ла", "лен", "ма", "мер", "на", "нов"),
    "greek": ("βα", "γε", "δα", "ζο", "θε", "κα", "λα", "λε", "μα", "νι", "πα", "ρο", "σα", "τα", "φω", "χα"),
}
ENDINGS = {("latin", "m"): ("n", "r", "k", "s"), ("latin", "f"): ("a",), ("cyrillic", "m"): ("н", "р", "к", "с"), ("cyrillic", "f"): ("а",), ("greek", "m"): ("ς",), ("greek", "f"): ("α",)}
#: Script -> pattern of its letters, its letters in lower case. What no other pattern takes counts as the first.
SCRIPTS = {
    "latin": (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"), "cyrillic": (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"), "greek": (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    "armenian": (r"\p{IsArmenian}", "աբգդեզէթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ"), "hebrew": (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"), "arabic": (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    "devanagari": (r"\p{IsDevanagari}", "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह"), "kana": (r"\p{IsHiragana}|\p{IsKatakana}", "あいうえおかきくけこさしすせそたちつてとなにぬねの"), "hangul": (r"\p{IsHangul}", "가나다라마바사아자차카타파하"),
    "han": (r"\p{IsHan}", "一二三四五六七八九十百千万上下大小山川日月火水木金土"),
}
COUNTRY = r"^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

KEYWORDS = "password|passwd|pwd|secret|token|api_?key"
TITLES = "|".join((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES))
TITLE = rf"^(?:{TITLES})\.? "
#: A word of a name: apostrophes before a capital, and hyphens, are within it.
NAME = r"\p{Lu}(?:\p{Ll}++|['’]\p{Lu}\p{Ll}++)(?:['’]\p{Lu}\p{Ll}++|-\p{L}\p{Ll}++)*+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
KEY_FRONT = r"^(?:AKIA|gh[pousr]_|sk-|xox[abp]-)"
SECRET_FRONT = r"^\w+ ?[=:] ?[\"']?"
#: Kind, pattern of the whole entity. The first that fits at a place counts.
KINDS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("name", rf"(?<![\p{{L}}\p{{N}}])(?:{TITLES})\.? {NAME}(?: {NAME})?(?![\p{{L}}\p{{N}}])"),
    ("secret", rf"(?<![\p{{L}}\p{{N}}])(?:(?i:{KEYWORDS})) ?[=:] ?[\"']?[^\s\"']{{6,}}(?<![.,;:!?)])"),
    ("key", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abp]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])"),
    ("hex", r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}+(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:(?=[A-Z0-9]{0,4}\d{7})[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: (?=[A-Z]{0,3}\d)[A-Z0-9]{4}){2,6}(?: (?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    ("ipv6", r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f]{0,3}\d)[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?)(?![\p{L}\p{N}:])"),
    ("ip", rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"),
    ("phone", r"(?<![\d\p{L}])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d\p{L}])(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\d)"),
)
#: What may be a mention: a word in capitals or with a capital in front, hyphens and apostrophes apart.
WORD = r"(?<![\p{L}\p{N}])(?:\p{Lu}\p{Ll}++|\p{Lu}{2,}+)(?![\p{L}\p{N}])"
#: Parts into which the rows of one entity or word are dealt out where they meet its surrogate.
PARTS = 32
#: Every entity fits this too; most texts do not.
FAST = r"[0-9@]|(?i:" + KEYWORDS + rf")|(?:{TITLES})\.? \p{{Lu}}|AKIA|gh[pousr]_|sk-|xox[abp]-|[A-Fa-f]{{32}}"
PATTERN = "|".join("(?:" + p.replace(r"\1", "[ -]").replace("([ -])", "[ -]") + ")" for _, p in KINDS)
#: The space of surrogates grows with each attempt, except for kinds of fixed length, of which there are 10^9 and more.
MAX_ATTEMPTS = 64


def entities(text: Column) -> Column:
    """Array of the entities of a text in order."""
    return F.when(text.rlike(FAST), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def has_entity(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike(FAST), text.rlike(PATTERN)), F.lit(False))


def _cases(cases: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first case that holds."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), default)


def _letters(text: Column) -> Column:
    """Array of the characters."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _script(text: Column, names: tuple[str, ...] = tuple(SCRIPTS)) -> Column:
    return _cases([(text.rlike(SCRIPTS[s][0]), F.lit(s)) for s in names[1:]], F.lit(names[0]))


def _met(rows: DataFrame, values: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The rows with what values has for their keys. A key's rows are dealt out to PARTS parts by a hash of another column, so
    a key that most rows have is no task's alone; a value goes only to the parts that have its key."""
    rows = rows.withColumn("_pii_part", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    wanted = rows.select(*keys, "_pii_part").distinct().join(values, keys)
    return rows.join(wanted, [*keys, "_pii_part"]).drop("_pii_part")


def spellings(found: DataFrame) -> DataFrame:
    """entity, kind, front (what stays: a keyword or a title), core (the rest), units: (kind, norm) of each unit in order.
    found: (entity), repeated as it may be.

    A name's words are split at hyphens; the last word is a surname, another one a given name. A given name's gender is
    the title's, else the one it mostly has beside titles in the corpus, else that of the fixed lists, else its hash's."""
    each = found.groupBy("entity").agg(F.count("*").alias("n"))
    each = each.withColumn("kind", _cases([(F.col("entity").rlike(f"^(?:{p})$"), F.lit(k)) for k, p in KINDS[:-1]], F.lit(KINDS[-1][0])))
    each = each.withColumn("front", F.when(F.col("kind") == "name", F.regexp_extract("entity", TITLE, 0)).when(F.col("kind") == "secret", F.regexp_extract("entity", SECRET_FRONT, 0)).otherwise(""))
    each = each.withColumn("core", F.substr("entity", F.length("front") + 1)).withColumn("given", F.when((F.col("kind") == "name") & F.col("core").contains(" "), F.lower(F.regexp_extract("core", "^[^ -]+", 0))))
    title = F.regexp_replace("front", r"[. ]+$", "")
    each = materialize(each.withColumn("gender", F.when(F.col("given").isNotNull(), F.when(title.isin(*MALE_TITLES), "m").when(title.isin(*FEMALE_TITLES), "f"))), "spellings")
    votes = each.filter("gender is not null").groupBy("given").agg(F.sum(F.when(F.col("gender") == "m", F.col("n")).otherwise(-F.col("n"))).alias("_v")).select(F.col("given").alias("_g"), F.when(F.col("_v") >= 0, "m").otherwise("f").alias("_voted"))
    known = lambda g: F.col("given").isin(*[x.lower() for (_, sex), names in GIVEN.items() if sex == g for x in names])
    guess = F.when(known("m"), "m").when(known("f"), "f").otherwise(F.when(F.pmod(F.xxhash64("given"), F.lit(2)) == 0, "f").otherwise("m"))
    each = each.join(votes, F.coalesce("given", "entity") == F.col("_g"), "left").withColumn("gender", F.coalesce("gender", "_voted", guess))
    core, digits = F.col("core"), F.regexp_replace("core", r"\D", "")
    plain = F.when((F.col("kind") == "secret") & core.rlike(f"^(?:{KINDS[3][1]})$"), "key").when((F.col("kind") == "secret") & core.rlike(f"^(?:{KINDS[4][1]})$"), "hex").otherwise(F.col("kind"))
    each = each.withColumn("plain", plain)
    low = F.when(F.length(F.lower(core)) == F.length(core), F.lower(core)).otherwise(core)
    norm = F.when(F.col("plain").isin("email", "hex", "ipv6"), low).when(F.col("plain") == "iban", F.replace("core", F.lit(" "), F.lit(""))).when((F.col("plain") == "phone") & ~core.startswith("+"), F.concat(F.lit("1"), digits)).when(F.col("plain").isin("phone", "ssn", "card"), digits).otherwise(core)
    first = F.when(F.col("given").isNotNull(), F.size(F.split(F.substring_index("core", " ", 1), "-"))).otherwise(0)
    word = lambda p, i: F.struct(F.concat_ws(":", F.when(i < first, F.concat(F.lit("given:"), F.col("gender"))).otherwise("surname"), _script(p)).alias("kind"), F.lower(F.regexp_replace(p, r"^\p{Lu}['’]", "")).alias("norm"))
    units = F.when(F.col("kind") == "name", F.transform(F.split(core, "[ -]"), word)).otherwise(F.array(F.struct(F.col("plain").alias("kind"), norm.alias("norm"))))
    return materialize(each.select("entity", "kind", "plain", "front", "core", units.alias("units")), "spelled")


def surrogate(kind: Column, norm: Column, digest: Column, attempt: int) -> Column:
    """The surrogate of a unit from a digest (128 hex digits) of key, kind, norm and attempt. Digits for digits, letters of
    the same script for letters; card numbers with a right check digit; names of the same gender. Names get a
    syllable more with each attempt, secrets and addresses a letter from the third attempt on."""
    byte = lambda i: F.conv(F.substr(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    at = lambda i: byte(F.lit(i))
    pick = lambda values, v: F.get(F.array(*[F.lit(x) for x in values]), v % len(values))
    hexes = (kind == "hex") | ((kind == "secret") & norm.rlike("^[0-9a-fA-F]+$"))

    def letter(c: Column, v: Column) -> Column:
        script = lambda s: F.substr(F.lit(SCRIPTS[s][1]), v % len(SCRIPTS[s][1]) + 1, F.lit(1))
        return _cases([(hexes, F.substr(F.lit("abcdef"), v % 6 + 1, F.lit(1))), *[(c.rlike(SCRIPTS[s][0]), script(s)) for s in list(SCRIPTS)[1:]]], script("latin"))

    def changed(text: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            plain = letter(c, byte(i))
            return F.when(c.rlike(r"\p{Nd}"), (byte(i) % 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(plain)).when(c.rlike(r"\p{L}"), plain).otherwise(c)

        return F.array_join(F.transform(_letters(text), one), "")

    def invented(script: str, syllables: int, ends: tuple[str, ...]) -> Column:
        parts = [pick(SYLLABLES[script], at(k)) for k in range(syllables)] + ([pick(ends, at(63))] if ends else [])
        return F.concat(*parts)

    def kept(front: str) -> Column:
        start = F.regexp_extract(norm, front, 0)
        return F.concat(start, changed(F.substr(norm, F.length(start) + 1)))

    code = F.regexp_extract(norm, COUNTRY, 0)
    number = changed(F.substr(norm, F.length(code) + 1))
    phone = F.concat(code, (at(62) % 8 + 2).cast("string"), F.substr(number, F.lit(2)))
    # check digit: from the right, every second digit doubled, digits of the doubles added up
    card = F.concat(F.substr(norm, F.lit(1), F.lit(1)), changed(F.substr(norm, F.lit(2), F.length(norm) - 2)))
    doubles = F.transform(_letters(F.reverse(card)), lambda x, i: F.when(i % 2 == 0, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    card = F.concat(card, ((10 - F.aggregate(doubles, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string"))
    more = F.concat(*[F.substr(F.lit("abcdef"), at(50 - k) % 6 + 1, F.lit(1)) for k in range(attempt - 1)]) if attempt > 1 else F.lit("")
    tail = F.regexp_extract(norm, r"\.[A-Za-z]+$", 0)
    email = F.concat(more, changed(F.substr(norm, F.lit(1), F.length(norm) - F.length(tail))), tail)
    ip = F.concat_ws(".", *[(at(k) % 254 + 1).cast("string") for k in range(4)])
    # account numbers: the bank's letters and the number drawn anew, check digits by the remainder of 97, letters as 10 to 35
    account, land = changed(F.substr(norm, F.lit(5))), F.substr(norm, F.lit(1), F.lit(2))
    rest = F.aggregate(_letters(F.concat(account, land, F.lit("00"))), F.lit(0), lambda a, c: F.when(c.rlike(r"\d"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    iban = F.concat(land, F.lpad((98 - rest).cast("string"), 2, "0"), account)
    ipv6 = F.concat(F.lit("fd"), F.substr(digest, F.lit(1), F.lit(2)), *[F.concat(F.lit(":"), F.substr(digest, F.lit(4 * k + 3), F.lit(4))) for k in range(7)])
    cases = [(kind == "email", email), (kind == "secret", F.concat(changed(norm), more)), (kind == "key", kept(KEY_FRONT)), (kind == "ip", ip), (kind == "ipv6", ipv6), (kind == "iban", iban), (kind == "phone", phone), (kind == "card", card)]
    for script in SYLLABLES:
        cases.append((kind == f"surname:{script}", invented(script, 3 + attempt, ())))
        for sex in "mf":
            given = pick([x.lower() for x in GIVEN[script, sex]], at(0)) if attempt == 0 else invented(script, 1 + attempt, ENDINGS[script, sex])
            cases.append((kind == f"given:{sex}:{script}", given))
    return _cases(cases, F.concat(changed(norm), F.when(kind.rlike("^(?:given|surname):"), more).otherwise("")))


def assign(units: DataFrame, secret: str) -> DataFrame:
    """(kind, norm, value) for the distinct units (kind, norm).

    A round proposes a surrogate for each unit left. Of units with the same proposal one takes it, if no unit is spelled
    so and none before took it; the rest go on to the next round, with another digest and more space. All checks are
    joins on (kind, value), and each round is written out, so a later one reads tables and not the plans of all before."""
    rest, taken, out = units, units.select("kind", F.col("norm").alias("value")), None
    for attempt in range(MAX_ATTEMPTS):
        digest = F.sha2(F.concat_ws("|", F.lit(secret), "kind", F.lit(str(attempt)), "norm").cast("binary"), 512)
        tried = rest.withColumn("digest", digest).withColumn("value", surrogate(F.col("kind"), F.col("norm"), F.col("digest"), attempt)).drop("digest")
        won = tried.groupBy("kind", "value").agg(F.min("norm").alias("norm")).join(taken, ["kind", "value"], "left_anti")
        won = materialize(won.select("kind", "norm", "value"), "surrogates")
        out = won if out is None else out.unionByName(won)
        lost = materialize(rest.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"), "collided")
        if lost.isEmpty():
            return out
        taken, rest = taken.unionByName(won.select("kind", "value")), lost
    raise ValueError(f"{MAX_ATTEMPTS} attempts leave entities without a surrogate of their own")


def laid_out(spelled: DataFrame, values: DataFrame) -> DataFrame:
    """(entity, kind, put, known): each spelling with the surrogates of its units in its own case and separators; known has
    (norm, value) of each word of a name, and is null for other kinds."""
    each = spelled.select("entity", F.posexplode("units").alias("_at", "_u")).select("entity", "_at", F.col("_u.kind").alias("kind"), F.col("_u.norm").alias("norm"))
    found = _met(each, values, ["kind", "norm"], "entity").groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]).alias("v"))
    core, value = F.col("core"), F.get("v", F.lit(0))
    own = F.col("chars")
    cased = F.array_join(F.transform(_letters(value), lambda c, i: F.when(F.coalesce(F.get(own, i), F.lit("")).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    nth = lambda i: F.length(F.regexp_replace(F.substr(core, F.lit(1), i), r"\D", "")) + F.when((F.col("plain") == "phone") & ~core.startswith("+"), 1).otherwise(0)
    figures = F.array_join(F.transform(own, lambda c, i: F.when(c.rlike(r"\d"), F.substr(value, nth(i) + 1, F.lit(1))).otherwise(c)), "")
    filled = F.array_join(F.transform(own, lambda c, i: F.when(c == " ", c).otherwise(F.substr(value, F.length(F.replace(F.substr(core, F.lit(1), i), F.lit(" "), F.lit(""))) + 1, F.lit(1)))), "")
    capital = lambda v, p: F.concat(F.regexp_extract(p, r"^\p{Lu}['’](?=\p{Lu})", 0), F.when(p.rlike(r"^\p{Ll}"), v).otherwise(F.concat(F.upper(F.substr(v, F.lit(1), F.lit(1))), F.substr(v, F.lit(2)))))
    words = F.zip_with("v", F.split(core, "[ -]"), capital)
    gaps = F.concat(F.regexp_extract_all(core, F.lit("[ -]"), F.lit(0)), F.array(F.lit("")))
    name = F.array_join(F.zip_with(words, gaps, lambda w, g: F.concat(w, g)), "")
    body = F.when(F.col("plain") == "name", name).when(F.col("plain").isin("email", "hex"), cased).when(F.col("plain").isin("phone", "ssn", "card"), figures).when(F.col("plain") == "iban", filled).otherwise(value)
    known = F.when(F.col("plain") == "name", F.zip_with("units", "v", lambda u, v: F.struct(u["norm"].alias("norm"), v.alias("value"))))
    return spelled.join(found, "entity").withColumn("chars", _letters(core)).select("entity", "kind", F.concat("front", body).alias("put"), known.alias("known"))


def with_mentions(gap: Column, known: Column) -> Column:
    """What stands between a text's entities, with the surrogates of words of its names: known is (norm, value), of which the
    first with a norm counts. Capitals stay capitals."""
    norms, values = F.transform(known, lambda x: x["norm"]), F.transform(known, lambda x: x["value"])

    def put(word: Column) -> Column:
        value = F.get(values, F.array_position(norms, F.lower(word)).cast("int") - 1)
        cased = F.when(word.rlike(r"^\p{Lu}{2}"), F.upper(value)).otherwise(F.concat(F.upper(F.substr(value, F.lit(1), F.lit(1))), F.substr(value, F.lit(2))))
        return F.coalesce(cased, word)

    words = F.concat(F.transform(F.regexp_extract_all(gap, F.lit(WORD), F.lit(0)), put), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(gap, WORD), words, lambda g, w: F.concat(g, w)), "")


def replace_entities(docs: DataFrame, secret: str = "corpus", text: str = "text") -> DataFrame:
    """docs with the text's entities replaced, and n_entities and entity_kinds (distinct kinds, joined) after its columns.

    Equal entities get equal surrogates in all documents, different ones different surrogates, none of which is an entity
    of the corpus; see spellings() for what counts as equal. Words of a text's names are replaced wherever they stand
    capitalised in that text, titles or not, as the name's words are; a word that two names use in two ways goes by the first.
    Such mentions do not count in n_entities. Texts without an entity are not shuffled; those with
    one are written out once, and meet their surrogates as lists of one text each.

    A null text stays null with no entities; repeated rows are each replaced alike; an empty table gives no rows; columns
    of docs named n_entities or entity_kinds give way to the operator's."""
    names = [c for c in docs.columns if c not in ("n_entities", "entity_kinds")]
    own = [F.col(f"`{c}`") for c in names]
    has = has_entity(F.col(text))
    clean = docs.filter(~has).select(*own, F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entity_kinds"))
    hit = materialize(docs.filter(has).select(*own, entities(F.col(text)).alias("_pii_found"), F.monotonically_increasing_id().alias("_pii_row")), "personal")
    each = hit.select("_pii_row", F.posexplode("_pii_found").alias("_pii_at", "entity"))
    spelled = spellings(each.select("entity"))
    units = materialize(spelled.select(F.explode("units").alias("u")).select("u.kind", "u.norm").distinct(), "units")
    put = materialize(laid_out(spelled, assign(units, secret)), "put")
    found = _met(each, put, ["entity"], "_pii_row").groupBy("_pii_row").agg(F.array_sort(F.collect_list(F.struct("_pii_at", "put", "kind", "known"))).alias("_pii_put"))
    found = found.withColumn("_pii_known", F.array_distinct(F.flatten(F.filter(F.transform("_pii_put", lambda x: x["known"]), F.isnotnull))))
    gaps = F.split(F.col(text), PATTERN)
    gaps = F.when(F.size("_pii_known") > 0, F.transform(gaps, lambda g: with_mentions(g, F.col("_pii_known")))).otherwise(gaps)
    woven = F.array_join(F.zip_with(gaps, F.concat(F.transform("_pii_put", lambda x: x["put"]), F.array(F.lit(""))), lambda g, s: F.concat(g, s)), "")
    changed = hit.join(found, "_pii_row").select(
        *[woven.alias(text) if c == text else F.col(f"`{c}`") for c in names],
        F.size("_pii_put").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.transform("_pii_put", lambda x: x["kind"]))), ",").alias("entity_kinds"),
    )
    return clean.unionByName(changed)


def without_personal_data(docs: DataFrame, secret: str = "corpus") -> DataFrame:
    """docs with surrogates for entities and n_chars brought up to date; see replace_entities()."""
    out = replace_entities(docs.select([c for c in docs.columns if c not in ("n_entities", "entity_kinds")]), secret)
    changed = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(docs.columns) if "n_chars" in docs.columns else out.select(docs.columns)
