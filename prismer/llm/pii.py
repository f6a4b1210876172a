"""Personal data replaced by keyed surrogates, by DataFrame functions alone."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismer.llm.common import dropped, let, saved, unused

#: A part of a host's name. Its loops and those over it never give back, so they need no stack however long a text is.
LABEL = r"[\p{L}\p{N}]++(?:-++[\p{L}\p{N}]++)*+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Titles that show gender, by script; what follows them in capitals is a name.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Г-жа", "Госпожа")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Г-н", "Господин")
NAME = r"(?:" + "|".join(sorted({*FEMALE, *MALE}, key=len, reverse=True)) + r")\.?(?: \p{Lu}[\p{L}'-]+){1,3}"
#: Kinds of personal data and their patterns; the first that matches at a place holds. Cards come after secrets (pattern()).
KINDS = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++@{LABEL}(?:\.{LABEL})++",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "ssn": r"(?<!\w)\d{3}-\d{2}-\d{4}(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "name": rf"(?<![\p{{L}}\p{{N}}]){NAME}",
}
BEFORE, AFTER = ("|".join(f"(?:{KINDS[k]})" for k in kinds) for kinds in (("email", "ip", "secret"), ("phone", "ssn", "iban", "name")))
#: Digits of a card number, the greatest first, and texts that may hold one.
CARD_DIGITS, MAYBE_CARD = range(19, 12, -1), r"(?<![\w+])\d(?:[ -]?\d){12}"
#: What a text with personal data of these kinds must hold.
HINT = r"[0-9@]|(?:" + "|".join(sorted({*FEMALE, *MALE})) + r")\.? \p{Lu}"
#: Syllables of surrogate names.
LATIN = [a + b for a in "bdfgklmnprstv" for b in "aeiou"]
CYRILLIC = [a + b for a in "бвгдзклмнпрст" for b in "аеиоу"]
#: Attempts at a free surrogate before the corpus is taken to have more entities of a kind than there are surrogates.
ATTEMPTS = 64


def _is_card(m: Column) -> Column:
    """Whether the check sum of a number is that of a card."""
    return _luhn(_digits(m)) % 10 == 0


def pattern(text: Column) -> Column:
    """The pattern of all personal data for one text: its card numbers are named one by one.

    A card number is a run of 13 to 19 digits, with single spaces or hyphens between them, whose
    Luhn sum ends in 0; of several that begin at a place the longest holds. Other runs are left to
    the kinds after cards, so a telephone number or a card next to further digits is still found.
    The work on a text follows its places times its distinct card numbers.
    """
    runs = F.concat(*[F.regexp_extract_all(text, F.lit(rf"(?<![\w+])(?=(\d(?:[ -]?\d){{{n - 1}}})(?!\w))"), F.lit(1)) for n in CARD_DIGITS])
    named = lambda cards: F.when(F.size(cards) > 0, F.concat(F.lit(rf"{BEFORE}|(?:(?<![\w+])(?:"), F.array_join(cards, "|"), F.lit(rf")(?!\w))|{AFTER}")))
    return F.coalesce(F.when(text.rlike(MAYBE_CARD), let(F.filter(F.array_distinct(runs), _is_card), named)), F.lit(f"{BEFORE}|{AFTER}"))


def found(text: Column, any_kind: Column) -> Column:
    """All personal data in a text, in order, by its pattern()."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, any_kind, F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(m: Column) -> Column:
    """The kind of one match."""
    digits = F.length(F.regexp_replace(m, r"\D", ""))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "ip")
        .when(m.rlike(rf"^{NAME}$"), "name")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^\d[\d -]*$") & (digits >= 13), "card")
        .when(m.rlike(r"^[\d+(][\d ().+-]*$") & (digits <= 15), "phone")
        .when(m.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$") & ~m.rlike("^(?:AKIA|ASIA)"), "iban")
        .otherwise("secret")
    )


def _norm(kind: Column, m: Column) -> Column:
    """What mentions of one entity share: its letters and digits without case, spaces or marks; an address as it is."""
    return F.when(kind.isin("ip", "email"), F.lower(m)).otherwise(F.lower(F.regexp_replace(m, r"[^\p{L}\p{N}]", "")))


def _gender(m: Column) -> Column:
    """f or m, by the title a name begins with."""
    return F.when(F.regexp_replace(F.substring_index(m, " ", 1), r"\.$", "").isin(*FEMALE), "f").otherwise("m")


def _part_norm(gender: Column, part: Column) -> Column:
    return F.concat(gender, F.lit(":"), _norm(F.lit("name"), part))


def _parts(m: Column) -> Column:
    """The names after the title."""
    words = F.split(m, " ")
    return F.slice(words, F.lit(2), F.size(words))


def entities_of(m: Column) -> Column:
    """(kind, norm, m) of each entity of a match: a name's parts are entities of their own, whatever title they stand with."""

    def entity(kind: Column, norm: Column, what: Column) -> Column:
        return F.struct(F.coalesce(kind, F.lit("")).alias("kind"), F.coalesce(norm, F.lit("")).alias("norm"), F.coalesce(what, F.lit("")).alias("m"))

    name = F.transform(_parts(m), lambda part: entity(F.lit("name"), _part_norm(_gender(m), part), part))
    return let(kind_of(m), lambda kind: F.when(kind == "name", name).otherwise(F.array(entity(kind, _norm(kind, m), m))))


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ y for x in raw)) for y in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """64 keyed pseudo-random bytes in hexadecimal, the same for every mention of an entity."""
    seed = F.concat_ws("\x1f", kind, norm, attempt.cast("string"))
    return F.concat(_hmac(key, F.concat(seed, F.lit("\x1f0"))), _hmac(key, F.concat(seed, F.lit("\x1f1"))))


def _number(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(options: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (i % len(options) + 1).cast("int"))


def _alike(m: Column, stream: Column, hexadecimal: Column) -> Column:
    """Each letter and digit replaced by another of its sort; what stands between them stays.

    The n-th letter or digit depends on n, not on the marks before it, so that an entity written
    in two formats gets one surrogate in both.
    """
    return let(F.split(m, ""), lambda chars: _alike_chars(chars, stream, hexadecimal))


def _alike_chars(chars: Column, stream: Column, hexadecimal: Column) -> Column:
    """The work follows the number of characters: each letter or digit is joined with the marks up to the next."""
    upper, lower = "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "абвгдежзиклмнопрстуфхцчшэюя"
    greek = "αβγδεζηθικλμνξοπρστυφχψω"

    def letter(c: Column, i: Column, n: Column) -> Column:
        opening = ~F.coalesce(F.get(chars, i - 1).rlike("[0-9]"), F.lit(False))
        hex_digit = F.lower(F.hex(n % 16))
        return (
            F.when(hexadecimal & c.rlike("[0-9a-f]"), hex_digit)
            .when(c.rlike("[0-9]"), F.when(opening, n % 9 + 1).otherwise(n % 10).cast("string"))
            .when(c.rlike(r"(?=\p{IsCyrillic})\p{Lu}"), _pick(list(upper), n))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(list(lower), n))
            .when(c.rlike(r"(?=\p{IsGreek})\p{Lu}"), F.upper(_pick(list(greek), n)))
            .when(c.rlike(r"\p{IsGreek}"), _pick(list(greek), n))
            .when(c.rlike(r"\p{Lu}"), F.char(n % 26 + 65))
            .when(c.rlike(r"\p{L}"), F.char(n % 26 + 97))
            .otherwise(c)
        )

    def marks(start: Column, stop: Column) -> Column:
        return F.array_join(F.slice(chars, start + 1, stop - start), "")

    def put(places: Column) -> Column:
        following = lambda k: F.coalesce(F.get(places, k), F.size(chars))
        one = lambda i, k: F.concat(letter(F.get(chars, i), i, _number(stream, k)), marks(i + 1, following(k + 1)))
        return F.concat(marks(F.lit(0), following(F.lit(0))), F.array_join(F.transform(places, one), ""))

    return let(F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: F.get(chars, i).rlike(r"[\p{L}\p{N}]")), put)


def _digits(m: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(m, r"\D", ""), ""), lambda c: c.cast("int"))


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _card(m: Column, stream: Column) -> Column:
    """A number of the same length, grouping, first digit and check-sum remainder."""
    digits = _digits(m)
    body = F.transform(F.slice(digits, F.lit(1), F.size(digits) - 1), lambda d, i: F.when(i == 0, d).otherwise(_number(stream, i) % 10))
    last = F.pmod(_luhn(digits) - _luhn(F.concat(body, F.array(F.lit(0)))), F.lit(10))
    chars = F.split(m, "")

    def put(new: Column) -> Column:
        place = lambda i: F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x.rlike(r"\d")))
        return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"\d"), F.get(new, place(i)).cast("string")).otherwise(c)), "")

    return let(F.concat(body, F.array(last)), put)


def _name(part: Column, stream: Column, female: Column) -> Column:
    """New syllables of a name's script and an ending of its title's gender."""
    parts = [_number(stream, F.lit(j)) for j in range(5)]
    latin = F.concat(*[_pick(LATIN, n) for n in parts[:4]], _pick(list("bdfgklmnprst"), parts[4]), F.when(female, "a").otherwise("o"))
    cyrillic = F.concat(*[_pick(CYRILLIC, n) for n in parts[:4]], F.when(female, "ва").otherwise("в"))
    return F.initcap(F.when(part.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(latin))


def surrogate(m: Column, key: str, attempt) -> Column:
    """The replacement of one match; mentions of an entity get equal ones up to format and case. attempt gives that of a kind and norm."""

    def name(part: Column) -> Column:
        gender = _gender(m)
        return let(_part_norm(gender, part), lambda norm: _name(part, _stream(key, F.lit("name"), norm, attempt(F.lit("name"), norm)), gender == "f"))

    def other(kind: Column, norm: Column) -> Column:
        return let(attempt(kind, norm), lambda a: let(_stream(key, kind, norm, a), lambda s: _surrogate(m, kind, s, a)))

    named = F.concat(F.substring_index(m, " ", 1), F.lit(" "), F.array_join(F.transform(_parts(m), name), " "))
    return let(kind_of(m), lambda kind: F.when(kind == "name", named).otherwise(let(_norm(kind, m), lambda norm: other(kind, norm))))


def _entity_surrogate(key: str, attempt: Column) -> Column:
    """The norm of the surrogate of a row kind, norm, m."""
    kind, norm, m = F.col("kind"), F.col("norm"), F.col("m")
    gender = F.substring(norm, 1, 1)
    name = let(_stream(key, kind, norm, attempt), lambda s: _part_norm(gender, _name(m, s, gender == "f")))
    other = let(_stream(key, kind, norm, attempt), lambda s: let(_surrogate(m, kind, s, attempt), lambda new: _norm(kind, new)))
    return F.when(kind == "name", name).otherwise(other)


def _surrogate(m: Column, kind: Column, s: Column, attempt: Column) -> Column:
    no = F.lit(False)
    host = F.regexp_replace(F.substring_index(m, "@", -1), r"\.[^.]*$", "")
    address = F.concat(_alike(F.substring_index(m, "@", 1), s, no), F.lit("@"), _alike(host, F.substring(F.concat(s, s), 41, 128), no), F.lit(".example"))
    # private addresses; where these are crowded, all others
    first = F.when(attempt < 8, "10").otherwise((_number(s, F.lit(5)) % 213 + 11).cast("string"))
    ip = F.concat_ws(".", first, *[(_number(s, F.lit(i)) % (254 if i == 2 else 256) + int(i == 2)).cast("string") for i in range(3)])
    prefix = F.regexp_extract(m, "^(?:AKIA|ASIA|gh[pousr]_|sk-|[A-Z]{2}(?=[0-9]{2}))", 0)
    country = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .-]|\()", 0)
    lead = F.when(kind == "phone", country).when(kind.isin("secret", "iban"), prefix).otherwise("")
    return (
        F.when(kind == "email", address)
        .when(kind == "ip", ip)
        .when(kind == "card", _card(m, s))
        .when((kind == "secret") & m.rlike("^[0-9A-F]+$"), F.upper(_alike(F.lower(m), s, F.lit(True))))
        .otherwise(F.concat(lead, _alike(F.substring(m, F.length(lead) + 1, F.length(m)), s, (kind == "secret") & m.rlike("^[0-9a-f]+$"))))
    )


def mentions(docs: DataFrame) -> DataFrame:
    """The text's hash, kind, norm and m (one way it is written) of every entity that a text mentions."""
    any_kind, found_ = unused(docs, "any", "found")
    rows = docs.select("text", pattern(F.col("text")).alias(any_kind)).select(F.xxhash64("text").alias("th"), F.explode(found(F.col("text"), F.col(any_kind))).alias(found_))
    rows = rows.select("th", F.explode(entities_of(F.col(found_))).alias("e")).select("th", "e.kind", "e.norm", "e.m")
    return rows.groupBy("th", "kind", "norm").agg(F.min("m").alias("m"))


def collisions(mentioned: DataFrame, key: str) -> DataFrame:
    """Entities (kind, norm) whose first surrogate is another's or is an entity itself, and the attempt that is free (1, 2, ...).

    The distinct entities are one table in the shared folder; each round compares surrogates by
    joins and partial aggregations and tries the next attempt for the losers, until none is left.
    """
    first = mentioned.groupBy("kind", "norm").agg(F.min("m").alias("m"))
    entities = saved(first.withColumn("attempt", F.lit(0)).withColumn("new", _entity_surrogate(key, F.lit(0))))
    for _ in range(ATTEMPTS):
        owners = entities.groupBy("kind", F.col("new").alias("norm")).agg(F.min("norm").alias("owner"), F.count("*").alias("n"))
        real = entities.select("kind", "norm")
        taken = owners.where("n > 1").unionByName(owners.join(real, ["kind", "norm"], "left_semi").withColumn("owner", F.lit(None).cast("string")))
        losers = entities.join(taken.select("kind", F.col("norm").alias("new"), "owner"), ["kind", "new"]).where("owner is null or norm != owner").select("kind", "norm").distinct()
        losers = saved(losers)
        if not losers.take(1):
            return entities.where("attempt > 0").select("kind", "norm", "attempt")
        tried = entities.join(losers.withColumn("lost", F.lit(1)), ["kind", "norm"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("lost", F.lit(0)))
        after = saved(tried.withColumn("new", F.when(F.col("lost") == 1, _entity_surrogate(key, F.col("attempt"))).otherwise(F.col("new"))).select("kind", "norm", "m", "attempt", "new"))
        dropped(losers)
        dropped(entities)
        entities = after
    raise ValueError(f"no free surrogates after {ATTEMPTS} attempts: more entities of a kind than surrogates")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """docs with personal data in text replaced, and n_entities, the number of mentions replaced.

    An entity has one surrogate in all documents, of its kind, format, script and gender; two
    entities never share one, and no surrogate is an entity of the corpus. A name's parts are
    entities: a surname keeps its surrogate beside any first name and any title of one gender.
    Letters of other scripts than Latin, Cyrillic and Greek become Latin ones. Null text stays null
    with 0 entities, an empty one empty; all rows stay, repeated ones alike; an empty table stays
    empty; other columns are kept whatever their names, one named n_entities is replaced. The
    entities that needed another attempt are joined to the texts that mention them, by the text's
    hash; Spark sends that table to all tasks if its stored size is small. key is secret; equal keys give
    equal surrogates.
    """
    docs = docs.drop("n_entities")
    mentioned = saved(mentions(docs))
    lost = collisions(mentioned, key)
    any_kind, found_, tries, th, text = unused(docs, "any", "found", "tries", "th", "new")
    name = lambda kind, norm: F.concat(kind, F.lit("\x1f"), norm)
    tried = mentioned.join(lost, ["kind", "norm"]).groupBy(F.col("th").alias(th))
    tried = saved(tried.agg(F.map_from_entries(F.collect_set(F.struct(name(F.col("kind"), F.col("norm")), "attempt"))).alias(tries)))
    rows = docs.join(tried, F.xxhash64(docs["text"]) == F.col(th), "left")
    rows = rows.withColumn(any_kind, pattern(F.col("text"))).withColumn(found_, found(F.col("text"), F.col(any_kind)))
    attempt = lambda kind, norm: F.coalesce(F.try_element_at(F.col(tries), name(kind, norm)), F.lit(0))

    def put(gaps: Column) -> Column:
        after = F.transform(F.col(found_), lambda m, i: F.concat(surrogate(m, key, attempt), F.get(gaps, i + 1)))
        return F.concat(F.get(gaps, F.lit(0)), F.array_join(after, ""))

    replaced = F.when(F.size(found_) > 0, let(F.split(F.col("text"), F.col(any_kind), -1), put)).otherwise(F.col("text"))
    rows = rows.withColumn(text, replaced).withColumn("n_entities", F.coalesce(F.size(found_), F.lit(0)))
    return rows.select(*[F.col(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], "n_entities")
