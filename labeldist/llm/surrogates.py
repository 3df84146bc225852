"""Surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern over the whole text.  Every distinct entity
(a normalised value of a type; a name is one entity per part) gets a keyed
replacement of the same type and shape: digits for digits, letters of the same
script for letters, a valid address for an address, a check digit where the
original has one, and for given names the ending of the same gender.  A
candidate that equals an entity of the corpus, or the candidate of another
entity, is drawn again, so that different entities stay different and the same
entity gets the same surrogate everywhere.  Each occurrence is written in its
own format (separators, capitals).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeldist.llm.common import column_or_null, row_ids, settled, stored

KEY = "surrogates-1"
MAX_ATTEMPTS = 60

# Titles by the gender they give, and the shape of each kind of entity.
MASCULINE = ("Mr", "Herr", "Señor", "Monsieur", "Sr", "господин")
FEMININE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Sra", "госпожа")
OPEN = ("Dr", "Prof")
TITLE = "(?:" + "|".join(sorted((*MASCULINE, *FEMININE, *OPEN), key=len, reverse=True)) + r")\.?"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+",
    "name": rf"(?<![\p{{L}}\p{{N}}]){TITLE} \p{{Lu}}[\p{{L}}'\-]*+(?: \p{{Lu}}[\p{{L}}'\-]*+){{0,2}}",
    "address": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d|\w)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3}[ .\-]\d{4}(?!\w)",
    "ssn": r"(?<!\w)\d{3}-\d{2}-\d{4}(?!\w)",
    "card": r"(?<!\w)(?:\d{4}[ \-]){3}\d{4}(?!\w)|(?<!\w)\d{13,19}(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?!\w)",
    "secret": r"(?<!\w)(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|ghp_\w{36}|sk-\w{20,}+)(?!\w)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Syllables of made-up names, by script; the endings are for masculine, feminine and open names.
SYLLABLES = {
    "latin": (("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "dr"), ("a", "e", "i", "o", "u", "ei", "ar", "el"),
              ("o", "a", "en")),
    "cyrillic": (("б", "в", "г", "д", "ж", "з", "к", "л", "м", "н", "п", "р", "с", "т", "ф", "х"), ("а", "е", "и", "о", "у", "ар", "ел", "ин"),
                 ("ий", "а", "ко")),
    "greek": (("β", "γ", "δ", "ζ", "θ", "κ", "λ", "μ", "ν", "ξ", "π", "ρ", "σ", "τ", "φ", "χ"), ("α", "ε", "ι", "ο", "υ", "αρ", "ελ", "ιν"),
              ("ος", "α", "ου")),
}


def _kind(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{p})$"), name).otherwise(out)
    return out


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").when(
        value.rlike(r"\p{IsLatin}"), "latin").otherwise("other")


def _noise(seed: Column, n: Column) -> Column:
    """At least ``2 n`` hexadecimal digits."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / 32).cast("int")),
                         lambda i: F.sha2(F.concat(seed, F.lit("/"), i.cast("string")).cast("binary"), 256))
    return F.array_join(blocks, "")


def _byte(noise: Column, i: Column) -> Column:
    return F.conv(F.substring(noise, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _same_shape(value: Column, noise: Column, hexadecimal: bool = False) -> Column:
    """A character of the same class for every letter and digit."""
    def one(c: Column, i: Column) -> Column:
        b = _byte(noise, i)
        if hexadecimal:
            return F.when(c.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), b % 16 + 1, F.lit(1))).otherwise(c)
        pick = lambda alphabet: F.substring(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))
        return (F.when(c.rlike("[0-9]"), pick("0123456789"))
                .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшыэюя"))
                .when(c.rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνξοπρστυφχψω"))
                .when(c.rlike(r"\p{IsHan}"), pick("山川田林森花水石金木土云雨雪风光明星"))
                .when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz")).otherwise(c))
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled (its digits added), modulo 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10


def _made_up(noise: Column, gender: Column, script: Column, more: Column) -> Column:
    """A name of syllables; later attempts have more of them."""
    def of(kind: str) -> Column:
        heads, tails, ends = SYLLABLES[kind]
        pick = lambda xs, b: F.element_at(F.array(*[F.lit(x) for x in xs]), b % len(xs) + 1)
        body = F.transform(F.sequence(F.lit(0), more + 1), lambda i: F.concat(
            pick(heads, _byte(noise, i * 2)), pick(tails, _byte(noise, i * 2 + 1))))
        end = F.when(gender == "m", ends[0]).when(gender == "f", ends[1]).otherwise(ends[2])
        return F.concat(F.array_join(body, ""), pick(heads, _byte(noise, F.lit(30))), end)
    return F.when(script == "cyrillic", of("cyrillic")).when(script == "greek", of("greek")).otherwise(of("latin"))


def candidate(kind: Column, value: Column, gender: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate (normalised) that an entity gets at an attempt."""
    noise = _noise(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")), F.length(value) + 32)
    shape = _same_shape(value, noise)
    tld = F.regexp_extract(value, r"\.(com|org|net)$", 1)
    host = F.substring_index(F.substring_index(value, "@", -1), ".", 1)
    email = F.concat(_same_shape(F.substring_index(value, "@", 1), noise), F.lit("@"),
                     _same_shape(host, F.reverse(noise)), F.lit(".example."), F.when(tld == "", "com").otherwise(tld))
    address = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(noise, i) % 254 + 1).cast("string")), ".")
    # a country code stays; the number begins with a digit from 2
    code = F.when(F.length(value) > 10, F.substring(value, F.lit(1), F.length(value) - 10)).otherwise("")
    number = F.substring(shape, F.length(code) + 2, F.length(value))
    phone = F.concat(code, (_byte(noise, F.lit(40)) % 8 + 2).cast("string"), number)
    body = F.substring(shape, F.lit(1), F.length(value) - 1)
    check = (F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10
    valid = F.concat(body, check.cast("string"))
    spoilt = F.concat(body, ((check + 1 + _byte(noise, F.lit(41)) % 9) % 10).cast("string"))
    card = F.when(_luhn(value) == 0, valid).otherwise(spoilt)
    hexadecimal = value.rlike("^[0-9a-f]+$")
    prefix = F.regexp_extract(value, "^(akia|ghp_|sk-|)", 1)
    rest = F.substring(value, F.length(prefix) + 1, F.length(value))
    secret = F.when(hexadecimal, _same_shape(value, noise, hexadecimal=True)).otherwise(F.concat(prefix, _same_shape(rest, noise)))
    iban = F.concat(F.substring(value, 1, 2), F.substring(shape, F.lit(3), F.length(value)))
    script = _script(value)
    name = F.when(script == "other", shape).otherwise(_made_up(noise, gender, script, F.floor(attempt / 3).cast("int")))
    return (F.when(kind == "email", email).when(kind == "address", address).when(kind == "phone", phone).when(kind == "card", card)
            .when(kind == "secret", secret).when(kind == "iban", iban).when(kind == "name", name).otherwise(shape))


def _written(kind: Column, original: Column, surrogate: Column) -> Column:
    """The surrogate in the format of an occurrence: its separators or its capitals."""
    between = F.split(original, r"\d", -1)
    digits = F.array_join(F.transform(between, lambda s, i: F.concat(s, F.substring(surrogate, i + 1, F.lit(1)))), "")
    upper = (original == F.upper(original)) & (original != F.lower(original))
    first = F.substring(original, 1, 1)
    capital = (first == F.upper(first)) & (first != F.lower(first)) & (kind == "name")
    cased = F.when(upper & ((F.length(original) > 1) | (kind != "name")), F.upper(surrogate)).when(
        capital, F.initcap(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "ssn"), digits).otherwise(cased)


def occurrences(rows: DataFrame) -> DataFrame:
    """One row per entity of a text: ``__rid, pos`` (match in the text), ``part``, ``kind, original, value, gender``."""
    found = rows.select("__rid", F.posexplode(F.regexp_extract_all("__text", F.lit(f"({ANY})"), 1)).alias("pos", "match"))
    found = found.withColumn("kind", _kind(F.col("match")))
    title = F.when(F.col("kind") == "name", F.substring_index("match", " ", 1))
    names = F.split("match", " ")
    bare = F.regexp_replace(title, r"\.$", "")
    gender = F.when(bare.isin(*MASCULINE), "m").when(bare.isin(*FEMININE), "f").otherwise("-")
    parts = F.when(F.col("kind") == "name", F.slice(names, F.lit(2), F.size(names))).otherwise(F.array("match"))
    each = found.select("__rid", "pos", "kind", title.alias("title"), gender.alias("titled"), F.size(parts).alias("many"),
                        F.posexplode(parts).alias("part", "original"))
    value = F.when(F.col("kind").isin("phone", "card", "ssn"), _digits(F.col("original"))).when(
        F.col("kind") == "address", F.col("original")).otherwise(F.lower("original"))
    # the first of several names is a given name and carries the gender
    given = (F.col("kind") == "name") & (F.col("part") == 0) & (F.col("many") > 1)
    return each.withColumn("value", value).withColumn("gender", F.when(given, F.col("titled")).otherwise("-"))


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, value, surrogate`` of distinct entities (``kind, value, gender``): no two alike, none an entity itself."""
    entities = stored(entities, "entities")
    pending, settled = entities, []
    for attempt in range(MAX_ATTEMPTS):
        drawn = pending.withColumn("surrogate", candidate(F.col("kind"), F.col("value"), F.col("gender"), F.lit(attempt), key))
        # of several with one candidate the first in key order gets it
        order = F.struct(F.sha2(F.concat(F.lit(key), F.col("value")).cast("binary"), 256).alias("h"), F.col("value").alias("value"))
        winner = drawn.groupBy("kind", "surrogate").agg(F.min(order).alias("w")).select("kind", "surrogate", F.col("w.value").alias("value"))
        taken = [entities.select("kind", F.col("value").alias("surrogate")), *[s.select("kind", "surrogate") for s in settled]]
        good = stored(winner.join(reduce(DataFrame.union, taken), ["kind", "surrogate"], "left_anti").select(
            "kind", "value", "surrogate"), "surrogates")
        settled.append(good)
        pending = stored(pending.join(good, ["kind", "value"], "left_anti"), "pending")
        if pending.isEmpty():
            return reduce(DataFrame.union, settled)
    raise RuntimeError(f"no free surrogate for some entities after {MAX_ATTEMPTS} attempts")


def pseudonymise(docs: DataFrame, key: str = KEY, from_table: bool = False) -> DataFrame:
    """``docs`` with its texts rewritten, plus ``__n_entities``.

    Null and empty texts stay as they are (no entities); rows and other columns
    are kept, also repeated ones.  ``key`` decides all surrogates.  Texts are whole, however long; an empty table gives
    an empty result.
    ``from_table``: the rows come straight from a table or files; any other frame is stored first.
    """
    docs = settled(docs, from_table)
    rows = row_ids(docs).withColumn("__text", column_or_null(docs, "text", "string"))
    each = stored(occurrences(rows.select("__rid", "__text")), "occurrences")
    genders = each.groupBy("kind", "value").agg(F.min("gender").alias("a"), F.max("gender").alias("b"))
    names = assign(genders.select("kind", "value", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("-").alias("gender")), key)
    written = each.join(names, ["kind", "value"]).withColumn("new", _written(F.col("kind"), F.col("original"), F.col("surrogate")))
    whole = written.groupBy("__rid", "pos").agg(
        F.array_sort(F.collect_list(F.struct("part", "new"))).alias("p"), F.max("title").alias("title")).select(
        "__rid", "pos", F.concat_ws(" ", "title", F.array_join(F.col("p.new"), " ")).alias("new"))
    by_text = whole.groupBy("__rid").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("__e"))
    joined = rows.join(by_text, "__rid", "left")
    between = F.split("__text", f"(?:{ANY})", -1)
    new = F.array_join(F.zip_with(between, F.col("__e.new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.col("__e").isNull(), F.col("__text")).otherwise(new)
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
                         F.coalesce(F.size("__e"), F.lit(0)).cast("long").alias("__n_entities"))


def op1(docs: DataFrame) -> DataFrame:
    return pseudonymise(docs, from_table=True).select("doc_id", F.col("__n_entities").alias("n_entities"), "text")
