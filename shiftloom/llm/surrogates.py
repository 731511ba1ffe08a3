"""Surrogates for personal data, in DataFrame functions only.

Entities are found by patterns; each gets a replacement derived from a key and its normal form, so all
mentions of one entity get one replacement whatever their punctuation, and the mention keeps its own
format. Numbers, addresses, mailboxes and secrets are mapped by keyed permutations of all strings of
their format without fixed points, names to made-up ones. Replacements of one kind are checked against
each other and against every entity seen; an entity whose replacement is taken moves on to its next
attempt, until all are distinct. Where a format is too full for that, all its entities take the first
permutation: distinct by construction, though it may be another entity's original. Names that are still
taken become long ones.

Mentions that leave something open are told from others, of the same text first, then of all texts: a name
alone after a title is a given name where it stands before a surname elsewhere, the gender of a name after
a title without one is that of the name after other titles, and a phone number without a calling code is
the one with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored
from .decontamination import bounded

#: Titles before names: fixed values.
TITLE = r"(?:(?:Mrs?|Ms|Miss|Sra?|Mme|M|Dr|Prof|MRS?|MS|DR|PROF)\.|Mr|Mrs|Ms|Miss|Herr|Frau|Señora?|Monsieur|Madame|Mme|Господин|Госпожа|Κύριος|Κυρία)"
NAME = r"\p{Lu}[\p{L}\p{M}'’-]+"
GROUP = "[0-9A-Fa-f]{1,4}"
#: Kinds in the order in which they are tried at a place of a text.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "person": rf"(?<![\p{{L}}\p{{N}}]){TITLE}(?: {TITLE})* {NAME}(?: {NAME}){{0,2}}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "secret": r"\b(?:[0-9a-f]{32,128}|AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|sk[-_][0-9A-Za-z_-]{20,})\b",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f]{{0,3}}\d)(?!(?:[0-9A-Fa-f]{{0,4}}:){{8}})(?:(?:{GROUP}:){{7}}{GROUP}|[0-9A-Fa-f]{{3,4}}(?::{GROUP}){{0,5}}::(?:{GROUP}(?::{GROUP}){{0,5}})?)(?![\p{{L}}\p{{N}}:]|\.\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "card": r"(?<![\d-])\d{4}(?<card>[ -]?)\d{4}\k<card>\d{4}\k<card>\d{1,7}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\p{L}\d])(?:\+(?=(?:[ ().-]{0,2}\d){8,15}(?!\d))\d{1,3}(?:[ ().-]{0,2}\d+){1,6}|\(\d{2,5}\)[ .-]?\d{2,4}[ .-]?\d{2,5}(?!\d)|\d{3}(?<phone>[ .-])\d{3}\k<phone>\d{4}(?![\d-])|"
    r"(?<![.,:/-])(?=0(?:[ .-]?\d){8,10}(?![ .-]?\d))(?!\d\d[ .-]\d\d[ .-](?:19|20)\d\d)0[1-9]\d{0,3}(?<area>[ .-])\d{2,8}(?:\k<area>\d{2,4}){0,3}(?!\d))",
}
#: Found in every text with a mention, and cheap to look for; most texts lack it.
HINT = r"[@0-9]|[MHFSDPГΚ][\p{L}.]{0,9} \p{Lu}|[a-f]{32}|AKIA|gh[opsu]_|sk[-_]"
#: Titles that tell a gender, and endings of surnames that do: fixed values.
FEMALE = "Mrs|Ms|Miss|Sra|Mme|Frau|Señora|Madame|Госпожа|Κυρία|MRS|MS"
MALE = "Mr|Sr|M|Herr|Señor|Monsieur|Господин|Κύριος|MR"
SURNAME_END = "(?:ова|ева|ёва|ина|ына|ская|цкая|ов|ев|ёв|ин|ын|ский|цкий|οπούλου|όπουλος|ová|ova|eva|ska|ská|cka|cká|ski|ský|cki|cký)$"
#: Consonants and vowels of made-up names, by script.
SYLLABLES = {
    "latin": ("bdfgklmnprstvz", "aeiou", "a", "o"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", "а", "ий"),
    "greek": ("βγδζκλμνπρστφ", "αειου", "α", "ος"),
}
DIGIT_KINDS = ("card", "ssn")
NAMES = ("given_f", "given_m", "given_x", "surname")
#: Attempts of names: longer ones from the first, and so long that none is met twice from the second.
LONGER, LONGEST = 6, 12
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
DIGITS, HEX = "0123456789", "0123456789abcdef"
#: International calling codes of one and two digits; all others have three.
CALLING_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: First octets of addresses that are not plainly public.
SPECIAL = (10, 127, 169, 172, 192)


def whole_pattern() -> str:
    """One pattern for all kinds; its groups are named."""
    return "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind_of(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, p in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(rf"^(?:{p})$"), kind).otherwise(out)
    return out


def gender_of(mention: Column) -> Column:
    """f, m or x (unknown) by the titles of a person."""
    told = lambda titles: mention.rlike(rf"^(?:{TITLE} )*?(?:{titles})\.? ")
    return F.when(told(FEMALE), "f").when(told(MALE), "m").otherwise("x")


def parts_of(mention: Column, kind: Column) -> Column:
    """Array of (kind, norm, raw): one part, or for a person each title and each name. A name that stands
    alone after its titles is of kind ``alone_`` and its gender."""
    words, gender = F.split(mention, " "), gender_of(mention)
    titles = F.size(F.split(F.regexp_extract(mention, rf"^(?:{TITLE} )+", 0), " ")) - 1
    last = lambda i: i == F.size(words) - 1
    names = F.transform(
        words,
        lambda w, i: F.struct(
            F.when(i < titles, F.lit("title")).when(last(i) & (i == titles), F.concat(F.lit("alone_"), gender)).when(last(i), F.lit("surname")).otherwise(F.concat(F.lit("given_"), gender)).alias("kind"),
            F.lower(w).alias("norm"), w.alias("raw"),
        ),
    )
    norm = (
        F.when(kind.isin(*DIGIT_KINDS), F.regexp_replace(mention, r"\D", ""))
        .when(kind == "phone", F.regexp_replace(mention, r"[^\d+]", ""))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "email", F.lower(mention))
        .when(kind == "ip6", F.array_join(address_groups(F.lower(mention)), ":"))
        .otherwise(mention)
    )
    return F.when(kind == "person", names).otherwise(F.array(F.struct(kind.alias("kind"), norm.alias("norm"), mention.alias("raw"))))


def address_groups(address: Column) -> Column:
    """The eight groups of an IPv6 address, without leading zeros."""
    parts = F.split(address, ":", -1)
    hole = F.array_position(parts, F.lit("")).cast("int")
    told = F.filter(parts, lambda g: g != "")
    left = F.when(hole > 0, hole - 1).otherwise(F.size(told))
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(told))
    whole = F.concat(F.slice(told, F.lit(1), left), zeros, F.slice(told, left + 1, F.lit(8)))
    return F.transform(whole, lambda g: F.regexp_replace(g, "^0+(?=.)", ""))


def resolved(parts: DataFrame, row: str) -> DataFrame:
    """``parts`` with kinds and normal forms settled by other mentions: of the same text, then of all."""
    name, phone = F.col("kind").rlike("^(?:given|alone|surname)"), F.col("kind") == "phone"
    whole = phone & F.col("norm").startswith("+")
    rest = F.when(whole, F.regexp_replace("norm", CALLING_CODE, "")).otherwise(F.regexp_replace("norm", "^0", ""))
    open_ = parts.where(name | phone).withColumn("link", F.concat(F.when(phone, "p ").otherwise("n "), F.when(phone, rest).otherwise(F.col("norm"))))
    open_ = open_.withColumn("gender", F.when(F.col("kind").rlike("_[fm]$"), F.substring("kind", -1, 1))).withColumn("whole", F.when(whole, F.col("norm")))
    given, surname, alone = (F.col("kind").startswith(k) for k in ("given", "surname", "alone"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    kinds = {"given": count(given), "given_f": count(given & (F.col("gender") == "f")), "given_m": count(given & (F.col("gender") == "m")), "surname": count(surname)}
    corpus = stored(open_.groupBy("link").agg(*[n.alias(f"all_{k}") for k, n in kinds.items()], F.min("whole").alias("one"), F.max("whole").alias("other")).where("all_given > 0 or one is not null"))
    here = Window.partitionBy(row, "link")
    told = open_.join(bounded(corpus), "link", "left")
    for k in ("given", "surname"):
        told = told.withColumn(f"here_{k}", F.max(F.col("kind").startswith(k)).over(here))
    told = told.withColumn("here_f", F.max(F.col("gender") == "f").over(here)).withColumn("here_m", F.max(F.col("gender") == "m").over(here)).withColumn("here_whole", F.min("whole").over(here))
    every = {k: F.coalesce(F.col(f"all_{k}"), F.lit(0)) for k in kinds}
    gender = (
        F.when(F.col("gender").isNotNull(), F.col("gender")).when(F.col("here_f"), "f").when(F.col("here_m"), "m")
        .when(every["given_f"] > every["given_m"], "f").when(every["given_m"] > every["given_f"], "m").otherwise("x")
    )
    of_gender = F.when(F.col("gender") == "f", every["given_f"]).when(F.col("gender") == "m", every["given_m"]).otherwise(every["given"])
    is_given = given | (alone & (F.col("here_given") | (~F.col("here_surname") & (of_gender > every["surname"]))))
    kind = F.when(phone, F.col("kind")).when(is_given, F.concat(F.lit("given_"), gender)).otherwise("surname")
    same = F.when(F.col("one") == F.col("other"), F.col("one"))
    norm = F.when(phone & ~whole, F.coalesce("here_whole", same, "norm")).otherwise(F.col("norm"))
    done = told.select(*[kind.alias("kind") if c == "kind" else norm.alias("norm") if c == "norm" else F.col(c) for c in parts.columns])
    return done.unionByName(parts.where(~(name | phone)))


def byte(digest: Column, i: Column) -> Column:
    """The i-th byte (from 0, round and round) of a hexadecimal digest of 64 bytes."""
    return F.conv(F.substring(digest, 2 * (i % 64) + 1, F.lit(2)), 16, 10).cast("int")


def letters(digest: Column, first: int, last: int, *alphabets: Column) -> Column:
    """Letters for the bytes from ``first`` to ``last`` of a digest, from the alphabets in turn."""
    own = F.array(*alphabets)

    def letter(i: Column) -> Column:
        return let(F.element_at(own, i % len(alphabets) + 1), lambda a: F.substring(a, byte(digest, i) % F.length(a) + 1, F.lit(1)))

    return F.array_join(F.transform(F.sequence(F.lit(first), F.lit(last)), letter), "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def symbols(text: Column, hexadecimal: Column | None = None, number: Column | None = None, address: Column | None = None) -> Column:
    """Each character as its place v in an alphabet of r: digits (of a ``number`` the first is not zero),
    hexadecimal digits where asked for, letters of one script and case. Any other stands alone. Groups of
    an IPv6 ``address``, each after its colon, keep their width, and zero stays zero."""
    hexadecimal, number, address = (F.lit(False) if x is None else x for x in (hexadecimal, number, address))

    def alphabet(c: Column, i: Column) -> Column:
        first = number & (i == 0)
        opens = address & (F.substring(text, i, F.lit(1)) == ":")
        out = F.when((address & (c == ":")) | (opens & (c == "0")), c).when(opens, HEX[1:]).when(hexadecimal | address, HEX).when(first & (c == "0"), "0").when(first, DIGITS[1:]).when(F.lit(DIGITS).contains(c), DIGITS)
        for low in ALPHABETS:
            out = out.when(F.lit(low).contains(c), low).when(F.lit(low.upper()).contains(c), low.upper())
        return out.otherwise(c)

    place = lambda c, own: F.struct((F.call_function("locate", c, own) - 1).alias("v"), F.length(own).alias("r"), own.alias("alphabet"))
    return F.transform(chars(text), lambda c, i: let(alphabet(c, i), lambda own: place(c, own)))


def scrambled(line: Column, key: str, *tweak: Column) -> Column:
    """A keyed permutation of all lines of symbols with the same alphabets, without fixed points: rounds
    add to every other symbol a digest of those between, a step by one, and the rounds taken back."""

    def added(now: Column, k: int, sign: int) -> Column:
        others = F.transform(F.filter(now, lambda x, i: i % 2 != k % 2), lambda x: x["v"].cast("string"))
        digest = F.sha2(F.concat_ws("\x00", F.lit(key), *tweak, F.lit(str(k)), F.array_join(others, ",")), 512)
        put = lambda x, v: F.struct(v.alias("v"), x["r"].alias("r"), x["alphabet"].alias("alphabet"))
        return let(digest, lambda d: F.transform(now, lambda x, i: put(x, F.when(i % 2 == k % 2, F.pmod(x["v"] + sign * byte(d, i), x["r"])).otherwise(x["v"]))))

    def stepped(now: Column) -> Column:
        free = F.transform(now, lambda x: x["r"] > 1)
        step = lambda x, i, at: F.when(i + 1 == at, F.pmod(x["v"] + 1, x["r"])).otherwise(x["v"]).cast("int")
        return let(F.array_position(free, True), lambda at: F.transform(now, lambda x, i: F.struct(step(x, i, at).alias("v"), x["r"].alias("r"), x["alphabet"].alias("alphabet"))))

    def turned(k: int, sign: int):
        return lambda now: added(now, k, sign)  # one parameter: a second one would be taken for an index

    out = line
    for step in (*[turned(k, 1) for k in range(3)], stepped, *[turned(k, -1) for k in (2, 1, 0)]):
        out = let(out, step)
    return out


def spelled(line: Column) -> Column:
    return F.array_join(F.transform(line, lambda x: F.substring(x["alphabet"], x["v"] + 1, F.lit(1))), "")


def octet_lists(norm: Column) -> Column:
    """For each octet of an IPv4 address those that it may become: private ones keep their network, and no
    other one becomes private."""
    numbers = lambda a, b: F.sequence(F.lit(a), F.lit(b))
    first, second = (F.element_at(F.split(norm, r"\."), i).cast("int") for i in (1, 2))
    return F.array(
        F.when(is_public(first), F.array_except(numbers(1, 223), F.array(*map(F.lit, SPECIAL)))).otherwise(F.array(first)),
        F.when((first == 192) & (second == 168), F.array(second)).when(first == 192, F.array_remove(numbers(0, 255), 168)).otherwise(numbers(0, 255)), numbers(0, 255), numbers(0, 255),
    )


def is_public(first: Column) -> Column:
    return first.between(1, 223) & ~first.isin(*SPECIAL)


def luhn(digits: Column) -> Column:
    """Sum modulo 10 of the check of card numbers."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, 2 * d).otherwise(d)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def iban_rest(text: Column) -> Column:
    """Remainder by 97 of an account number's letters and digits, letters as 10 to 35."""

    def located(acc: Column, c: Column) -> Column:
        v = F.call_function("locate", c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1
        return (F.when(v > 9, acc * 100).otherwise(acc * 10) + v) % 97

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), located)


def made_name(norm: Column, digest: Column, kind: Column, attempt: Column) -> Column:
    """A made-up name in the script of the original, with the ending of its gender; a surname keeps an
    ending that tells one."""
    scripts = {k: F.array(*map(F.lit, v)) for k, v in SYLLABLES.items()}
    own = F.when(norm.rlike(r"\p{IsCyrillic}"), scripts["cyrillic"]).when(norm.rlike(r"\p{IsGreek}"), scripts["greek"]).otherwise(scripts["latin"])

    def spell(o: Column) -> Column:
        hard, soft = o[0], o[1]
        ending = F.when(kind == "given_f", o[2]).when(kind == "given_m", o[3]).when(kind == "surname", F.regexp_extract(norm, SURNAME_END, 0)).otherwise("")
        more = F.when(attempt >= LONGEST, letters(digest, 8, 63, hard, soft)).when(attempt >= LONGER, letters(digest, 8, 15, hard, soft)).otherwise("")
        return F.concat(more, letters(digest, 0, 6, hard, soft), ending)

    return let(own, spell)


def with_surrogate(df: DataFrame, attempt: Column, key: str, name: str = "new") -> DataFrame:
    """Adds the normal form of the replacement of (kind, norm)."""
    digest = F.sha2(F.concat_ws("\x00", F.lit(key), F.col("kind"), F.col("norm"), attempt.cast("string")), 512)
    host = F.sha2(F.concat_ws("\x00", F.lit(key), F.lit("host"), F.substring_index("norm", "@", -1)), 512)
    return df.withColumn(name, surrogate(F.col("kind"), F.col("norm"), digest, host, attempt, key))


def surrogate(kind: Column, norm: Column, digest: Column, host: Column, attempt: Column, key: str) -> Column:
    """The normal form of the replacement. Check digits that fit go on to fit, others stay as far off."""
    rest = lambda n: F.substring(norm, n, F.length(norm))
    number = kind.isin("card", "ssn", "phone")
    kept = (
        F.when(kind == "iban", F.substring(norm, 1, 2)).when(kind == "phone", F.regexp_extract(norm, CALLING_CODE, 0))
        .when(kind == "secret", F.regexp_extract(norm, r"^(?:AKIA|gh[opsu]_|sk[-_])", 0)).when(kind == "ip6", F.substring_index(norm, ":", 1)).otherwise("")
    )
    moved = (
        F.when(kind == "email", F.substring_index(norm, "@", 1)).when(kind == "card", F.substring(norm, F.lit(1), F.length(norm) - 1)).when(kind == "ssn", norm)
        .when(kind == "iban", rest(F.lit(5))).when(kind.isin("phone", "secret", "ip6"), rest(F.length(kept) + 1)).otherwise("")
    )
    tweak = F.when(kind == "email", F.substring_index(norm, "@", -1)).otherwise(kept)
    octet = lambda o, own: F.struct((F.array_position(own, o.cast("int")) - 1).cast("int").alias("v"), F.size(own).alias("r"), F.lit("").alias("alphabet"))
    line = F.when(kind == "ip", F.zip_with(F.split(norm, r"\."), octet_lists(norm), octet)).otherwise(symbols(moved, (kind == "secret") & moved.rlike("^[0-9a-f]+$"), number, kind == "ip6"))

    def told(new: Column) -> Column:
        spelt = spelled(new)
        top = F.when(norm.rlike(r"\.(?:com|net|org)$"), F.substring_index(norm, ".", -1)).otherwise("org")
        domain = let(host, lambda d: F.concat(letters(d, 0, 11, F.lit(ALPHABETS[0])), F.lit(".example."), top))
        due = lambda head: F.pmod(10 - luhn(F.concat(head, F.lit("0"))), F.lit(10))
        last = F.substring(norm, F.length(norm), F.lit(1)).cast("int")
        fit = lambda account: 98 - iban_rest(F.concat(account, kept, F.lit("00")))
        check = F.pmod(F.substring(norm, 3, 2).cast("int") - fit(moved) + fit(spelt) - 2, F.lit(97)) + 2
        return (
            F.when(kind == "ip", F.array_join(F.zip_with(new, octet_lists(norm), lambda x, own: F.element_at(own, x["v"] + 1).cast("string")), "."))
            .when(kind == "email", F.concat(spelt, F.lit("@"), domain)).when(kind == "card", F.concat(spelt, F.pmod(last - due(moved) + due(spelt), F.lit(10)).cast("string")))
            .when(kind == "iban", F.concat(kept, F.lpad(check.cast("string"), 2, "0"), spelt)).otherwise(F.concat(kept, spelt))
        )

    names = let(digest, lambda d: made_name(norm, d, kind, attempt))
    return F.when(kind == "title", norm).when(kind.isin(*NAMES), names).otherwise(let(scrambled(line, key, kind, attempt.cast("string"), tweak), told))


def dressed(kind: Column, raw: Column, new: Column) -> Column:
    """The replacement in the format of the mention."""
    # A phone number told without its calling code, as one that has it.
    within = F.concat(F.regexp_extract(raw, r"^\(?(0)", 1), F.regexp_replace(new, CALLING_CODE, ""))
    plain = F.when((kind == "phone") & new.startswith("+") & ~raw.startswith("+"), within).otherwise(F.regexp_replace(new, r"^\+", ""))

    def put(symbol: str) -> Column:
        step = lambda a, c: F.when(c.rlike(symbol), F.struct(F.concat(a["out"], F.substring(plain, a["k"] + 1, F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k")))
        return F.aggregate(chars(raw), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step)["out"]

    groups, written = F.split(new, ":"), F.split(raw, ":", -1)
    hole = F.array_position(written, F.lit(""))
    group = lambda w, i: F.element_at(groups, F.when((hole == 0) | (i + 1 < hole), i + 1).otherwise(9 - F.size(written) + i))
    address = F.array_join(F.transform(written, lambda w, i: F.when(w == "", "").otherwise(F.lpad(group(w, i), F.length(w), F.lit("0")))), ":")
    name = F.when(raw == F.upper(raw), F.upper(new)).otherwise(F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new))))
    return (
        F.when(kind.isin("card", "ssn", "phone"), put(r"\d")).when(kind == "iban", put("[A-Z0-9]"))
        .when(kind == "ip6", F.when(raw.rlike("[A-F]"), F.upper(address)).otherwise(address))
        .when(kind.isin(*NAMES), name).when(kind == "title", raw)
        .when((kind == "email") & (raw == F.upper(raw)), F.upper(new)).otherwise(new)
    )


def format_of(kind: Column, norm: Column) -> Column:
    """What entities share whose replacements can be the same: no replacement leaves its format."""
    octet = F.substring_index(norm, ".", 1)
    address = F.when(is_public(octet.try_cast("int")), "public").otherwise(octet)
    widths = F.regexp_replace(F.regexp_replace(norm, "(?<=[0-9a-f])[0-9a-f]", "x"), "[1-9a-f]", "n")
    address6 = F.concat_ws(":", F.substring_index(norm, ":", 1), widths)
    return F.when(kind == "email", F.substring_index(norm, "@", -1)).when(kind == "ip", address).when(kind == "ip6", address6).otherwise(F.length(norm).cast("string"))


def attempts(entities: DataFrame, key: str, most: int = 12) -> DataFrame:
    """``entities``: distinct (kind, norm), stored. (kind, norm, attempt) of those beyond attempt 0.

    In each round entities with a replacement that another one has too, or that is itself an entity,
    move on, but the least of those that share one. Only counts by replacement are shuffled; rounds end
    when no entity moves. After ``most`` rounds the formats of those that still move go back to attempt 0.
    """
    state = stored(with_surrogate(entities.withColumn("attempt", F.lit(0)), F.col("attempt"), key))
    for k in range(most + 1):
        shared = state.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "norm")).alias("first")).where("n > 1").select(F.col("kind").alias("k"), F.col("new").alias("s"), "first")
        taken = state.join(shared, (F.col("kind") == F.col("k")) & (F.col("new") == F.col("s"))).where(F.struct("attempt", "norm") != F.col("first")).select("kind", "norm")
        real = state.join(entities.select(F.col("kind").alias("k"), F.col("norm").alias("o")), (F.col("kind") == F.col("k")) & (F.col("new") == F.col("o")), "left_semi").select("kind", "norm")
        moving = stored(taken.unionByName(real).distinct())
        if not moving.limit(1).count():
            break
        if k == most:
            long_names = moving.where(F.col("kind").isin(*NAMES)).withColumn("attempt", F.lit(max(most, LONGEST)))
            full = moving.where(~F.col("kind").isin(*NAMES)).select("kind", format_of(F.col("kind"), F.col("norm")).alias("format")).distinct()
            rest = state.withColumn("format", format_of(F.col("kind"), F.col("norm"))).join(full, ["kind", "format"], "left_anti").where("attempt > 0").select("kind", "norm", "attempt")
            return rest.join(long_names, ["kind", "norm"], "left_anti").unionByName(long_names)
        moved = state.join(moving.withColumn("moves", F.lit(1)), ["kind", "norm"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("moves", F.lit(0)))
        state = stored(with_surrogate(moved.select("kind", "norm", "attempt"), F.col("attempt"), key))
    return state.where("attempt > 0").select("kind", "norm", "attempt")


def replace_personal(docs: DataFrame, key: str = "surrogate-key", text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced, and the number of mentions replaced.

    Kinds: e-mail addresses, persons after a title (gender and script of the made-up name match) and
    their names wherever they stand again in the same text, bank account numbers, secrets and keys, IPv4
    addresses (private ones stay in their network), IPv6 addresses (the first group and zeros stay), card
    numbers (check digits fit where they did), social security and phone numbers (the calling code is
    kept). Phones: with + and 8 to 15 digits, with an area code in brackets, 3-3-4 digits, or 9 to 11
    digits in groups from a 0 on. Persons in texts that never name them after a title stay. Texts without a mention pass
    unchanged, null texts stay null; repeated rows are replaced alike; empty tables give no row; all
    columns are kept, but a column named like ``count_col`` is replaced.
    """
    docs = docs.drop(count_col)
    row, found, at, part, news, names = fresh(docs, "row_", "found_", "at_", "part_", "news_", "names_")
    every = F.regexp_extract_all(F.col(text_col), F.lit(whole_pattern()), F.lit(0))
    seen = docs.withColumn(found, F.when(F.col(text_col).rlike(HINT), every))
    has = F.coalesce(F.size(found) > 0, F.lit(False))
    some = stored(seen.where(has).withColumn(row, F.monotonically_increasing_id()))
    mentions = some.select(row, F.posexplode(found).alias(at, "mention")).withColumn("kind", kind_of(F.col("mention")))
    parts = stored(mentions.select(row, at, F.posexplode(parts_of(F.col("mention"), F.col("kind"))).alias(part, "p")).select(row, at, part, "p.kind", "p.norm", "p.raw"))
    parts = stored(resolved(parts, row))
    entities = stored(parts.where("kind <> 'title'").select("kind", "norm").distinct())
    moved = stored(attempts(entities, key))
    told = parts.join(bounded(moved), ["kind", "norm"], "left")
    told = with_surrogate(told, F.coalesce("attempt", F.lit(0)), key)
    new = dressed(F.col("kind"), F.col("raw"), F.col("new"))
    made = told.select(row, F.struct(F.col(at), F.col(part), new.alias("new"), F.when(F.col("kind").isin(*NAMES), F.col("raw")).alias("name")).alias("n"))
    by_row = made.groupBy(row).agg(F.sort_array(F.collect_list("n")).alias(news))
    # Names of a person stand together again, a space between.
    joined = F.transform(found, lambda m, i: F.array_join(F.transform(F.filter(news, lambda n: n[at] == i), lambda n: n["new"]), " "))
    between = F.split(F.col(text_col), whole_pattern(), -1)
    text = F.array_join(F.zip_with(between, F.concat(joined, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    # A person's names may stand again without a title. No made-up name is a name of the corpus, so each is replaced once.
    pairs = F.transform(F.filter(news, lambda n: n["name"].isNotNull()), lambda n: F.struct(n["name"].alias("name"), n["new"].alias("new")))
    both = F.array_distinct(F.concat(pairs, F.transform(pairs, lambda p: F.struct(F.upper(p["name"]).alias("name"), F.upper(p["new"]).alias("new")))))
    bare = lambda p: F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}@._-])\Q"), p["name"], F.lit(r"\E(?![\p{L}\p{M}\p{N}@_])"))
    done = some.join(by_row, row).withColumn(names, both).withColumn(text_col, text)
    again = F.aggregate(names, F.lit(0), lambda n, p: n + F.regexp_count(F.col(text_col), bare(p)))
    done = done.withColumn(count_col, F.size(found) + again)
    replaced = done.withColumn(text_col, F.aggregate(names, F.col(text_col), lambda t, p: F.regexp_replace(t, bare(p), p["new"]))).select(*docs.columns, count_col)
    plain = seen.where(~has).withColumn(count_col, F.lit(0)).select(*docs.columns, count_col)
    return replaced.unionByName(plain)


def surrogates_query(docs: DataFrame) -> DataFrame:
    """``op5_surrogates``: every document with its text after replacement."""
    return replace_personal(docs.select("doc_id", "text"))
