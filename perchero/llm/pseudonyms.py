"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Candidates are found by one pattern, validated, and permuted within their format by a keyed Feistel
network whose round function is SHA-256. A network over the parts (left, right) of a value adds to one
part a keyed hash of the other, modulo the part's size, in ten alternating rounds: a bijection of the
format for every key. Equal values therefore get equal pseudonyms in all documents, and different
values different ones. Spelling (separators) and length stay.

| kind | validation | permuted |
|---|---|---|
| card | 13 to 19 digits in a spelling of cards, Luhn | all digits but the last, which is computed anew |
| phone | North American area and exchange codes | area, exchange and line |
| ssn | area, group and serial in use | all parts |
| ip | four octets | 32 bits |
| date | calendar day of 1900 to 2099 (Y-M-D, D/M/Y, D.M.Y; M/D/Y if the day tells) | the day |
| email | shape | letters and digits before the @, each within its class |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: The key of the registered query. Real use passes a secret one.
KEY = "perchero"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9])(?!\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iso": r"(?<![0-9A-Za-z-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day_first": r"(?<![0-9A-Za-z/.])[0-9]{2}([/.])[0-9]{2}\1(?:19|20)[0-9]{2}(?![0-9/])",
}
#: Sizes of the groups of digits in which cards are written, with one separator throughout.
GROUPS = [(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 1), (4, 4, 4, 2), (4, 4, 4, 3), (4, 3, 3, 3), (4, 4, 5), (6, 13), (8, 8)]
#: Spellings that begin like one of the others: a card before a check code is tried without it first.
LONGER = [(4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3)]
#: In a first pass over the text, anything that may hold a value.
HINT = "[0-9@]"
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 1900 to 2099 has 17 * 4297 days


def _pattern() -> str:
    return "|".join(f"(?:{p})" for p in PATTERNS.values())


def _cards(groups: list[tuple[int, ...]], unbroken: bool) -> str:
    """What stands at a place where a card may open, as group 1 of a match without length.

    The last group must not open a date or a number of another kind, and the first one not end one.
    """
    others = "|".join(f"(?:{PATTERNS[k]})" for k in ("phone", "ssn", "iso")) + r"|[0-9]{2}([/.])[0-9]{2}\2(?:19|20)[0-9]{2}"
    spelled = ["[0-9]{13,19}"] if unbroken else []
    for mark in " -":
        # in "212-555-2671 1234 ..." the four digits belong to the phone number
        apart = r"(?<![0-9]{3}[.-][0-9]{2,3}[.-])" if mark == " " else ""
        for sizes in groups:
            *first, last = [f"[0-9]{{{n}}}" for n in sizes]
            spelled.append(f"{apart}{mark.join(first)}{mark}(?!{others}){last}")
    return rf"(?<![0-9A-Za-z])(?=((?:{'|'.join(spelled)})(?![0-9])))"


def _hash(key: str, kind: str, number: Column, other: Column) -> Column:
    """A keyed round value of 60 bits."""
    text = F.concat(F.lit(f"{key}|{kind}|"), number.cast("string"), F.lit("|"), other.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str) -> Column:
    """Struct (l, r): the permuted pair of ``left < left_size`` and ``right < right_size``."""

    def turn(a: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (a["l"] + _hash(key, kind, i, a["r"]) % left_size) % left_size).otherwise(a["l"]).alias("l"),
            F.when(even, a["r"]).otherwise((a["r"] + _hash(key, kind, i, a["l"]) % right_size) % right_size).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def _refilled(token: Column, digits: Column) -> Column:
    """The token with its digits replaced in order."""
    def place(i: Column) -> Column:
        c = F.substring(token, i, F.lit(1))
        n = F.length(_digits(F.substring(token, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, n, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(token)), place), "")


def _padded(number: Column, width) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Sum with every second digit doubled, counted from the right."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == (0 if double_last else 1)
        return total + F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(token: Column, key: str) -> Column:
    def changed(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        half = F.floor(F.length(payload) / 2).cast("int")
        rest = F.length(payload) - half
        size = lambda n: F.pow(F.lit(10.0), n).cast("long")
        kind = "card"
        pair = feistel(
            F.substring(payload, F.lit(1), half), F.substring(payload, half + 1, rest), size(half), size(rest), key, kind)
        body = _let(pair, lambda p: F.concat(_padded(p["l"], half), _padded(p["r"], rest)))
        whole = _let(body, lambda b: F.concat(b, ((10 - _luhn_sum(b, True) % 10) % 10).cast("string")))
        return F.when(_luhn_sum(d, False) % 10 == 0, _refilled(token, whole))
    return _let(_digits(token), changed)


def _phone(token: Column, key: str) -> Column:
    def changed(d: Column) -> Column:
        n = F.substring(d, F.length(d) - 9, F.lit(10))
        area, exchange, line = (F.substring(n, a, b).cast("long") for a, b in ((1, 3), (4, 3), (7, 4)))
        index = ((area - 200) * 800 + (exchange - 200)) * 10_000 + line
        side = F.lit(80_000)
        pair = feistel(F.floor(index / side), index % side, side, side, key, "phone")

        def spelled(x: Column) -> Column:
            whole = F.concat(
                (F.floor(x / 8_000_000) + 200).cast("string"),
                (F.floor(x / 10_000) % 800 + 200).cast("string"), _padded(x % 10_000, 4))
            return _refilled(token, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), whole))

        valid = (area >= 200) & (exchange >= 200)
        return F.when(valid, _let(_let(pair, lambda p: p["l"] * 80_000 + p["r"]), spelled))
    return _let(_digits(token), changed)


def _ssn(token: Column, key: str) -> Column:
    area, group, serial = (F.substring(token, a, b).cast("long") for a, b in ((1, 3), (5, 2), (8, 4)))
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def spelled(p: Column) -> Column:
        a = F.floor(p["l"] / 99) + 1
        return F.concat_ws(
            "-", _padded(a + F.when(a >= 666, 1).otherwise(0), 3), _padded(p["l"] % 99 + 1, 2), _padded(p["r"] + 1, 4))

    valid = (area >= 1) & (area != 666) & (area < 900) & (group >= 1) & (serial >= 1)
    return F.when(valid, _let(pair, spelled))


def _ip(token: Column, key: str) -> Column:
    part = F.split(token, r"\.")
    octet = [F.element_at(part, i).cast("long") for i in range(1, 5)]
    pair = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536), key, "ip")
    return _let(pair, lambda p: F.concat_ws(
        ".", *[x.cast("string") for s in ("l", "r") for x in (F.floor(p[s] / 256), p[s] % 256)]))


def _day_number(day: Column) -> Column:
    return F.datediff(day, F.lit(FIRST_DAY).cast("date"))


def _moved_day(day: Column, key: str, kind: str) -> Column:
    """The permuted day of a day number."""
    pair = feistel(F.floor(day / DAYS[1]), day % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, kind)
    return _let(pair, lambda p: p["l"] * DAYS[1] + p["r"])


def _spelled_day(day: Column, form: str) -> Column:
    return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int")), form)


def _iso(token: Column, key: str) -> Column:
    day = F.try_to_date(token, "yyyy-MM-dd")
    return F.when(day.isNotNull(), _spelled_day(_moved_day(_day_number(day), key, "iso"), "yyyy-MM-dd"))


def _day_first(token: Column, key: str) -> Column:
    """Day first where that is a date; else month first, walking on until the day exceeds 12 again."""
    mark = F.substring(token, 3, 1)
    slashed = F.translate(token, ".", "/")
    day = F.try_to_date(slashed, "dd/MM/yyyy")
    month_first = F.try_to_date(slashed, "MM/dd/yyyy")

    def walk(x: Column, i: Column) -> Column:
        settled = (i > 0) & (F.substring(_spelled_day(x, "MM/dd/yyyy"), 4, 2) > "12")
        return F.when(settled, x).otherwise(_moved_day(x, key, "month_first"))

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(63)), _day_number(month_first).cast("long"), walk)
    moved = F.when(day.isNotNull(), _spelled_day(_moved_day(_day_number(day), key, "day_first"), "dd/MM/yyyy")).when(
        month_first.isNotNull(), _spelled_day(walked, "MM/dd/yyyy"))
    return F.regexp_replace(moved, F.lit("/"), mark)


def _shifted(text: Column, other: Column, number: Column, key: str) -> Column:
    """Letters and digits moved within their class by a keyed hash of the other half."""
    stream = F.sha2(F.concat(F.lit(f"{key}|email|"), number.cast("string"), F.lit("|"), other), 256)

    def move(c: Column, i: Column) -> Column:
        step = F.conv(F.substring(stream, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(c)
        moved = lambda first, size: F.chr((code - first + step) % size + first)
        return (
            F.when(c.rlike("[a-z]"), moved(97, 26)).when(c.rlike("[A-Z]"), moved(65, 26))
            .when(c.rlike("[0-9]"), moved(48, 10)).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), move), "")


def _email(token: Column, key: str) -> Column:
    local = F.substring_index(token, "@", 1)
    half = F.floor(F.length(local) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, F.length(local)).alias("r"))

    def turn(a: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, _shifted(a["l"], a["r"], i, key)).otherwise(a["l"]).alias("l"),
            F.when(even, a["r"]).otherwise(_shifted(a["r"], a["l"], i, key)).alias("r"))

    pair = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return _let(pair, lambda p: F.concat(p["l"], p["r"], F.lit("@"), F.substring_index(token, "@", -1)))


def pseudonym(token: Column, key: str) -> Column:
    """The pseudonym of one found token; null if it does not validate."""
    whole = lambda kind: token.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(token.contains("@"), _email(token, key))
        .when(whole("ip"), _ip(token, key))
        .when(whole("phone"), _phone(token, key))
        .when(whole("ssn"), _ssn(token, key))
        .when(whole("iso"), _iso(token, key))
        .when(whole("day_first"), _day_first(token, key)))


def _valid_cards(text: Column) -> Column:
    """The different cards of a text, those of the longer spellings last."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (_cards(GROUPS, True), _cards(LONGER, False))]
    return F.filter(F.array_distinct(F.concat(*found)), lambda t: _let(_digits(t), lambda d: _luhn_sum(d, False) % 10 == 0))


def _spelled_anew(gaps: Column, pairs: Column) -> Column:
    """Struct (text, n): the gaps (such structs) with the new values between them."""
    def text(x: Column) -> Column:
        def joined(gap: Column, i: Column) -> Column:
            pair = F.get(x["pairs"], i)
            return F.concat(gap["text"], F.coalesce(pair["new"], pair["found"], F.lit("")))
        return F.array_join(F.transform(x["gaps"], joined), "")

    def count(x: Column) -> Column:
        inner = F.aggregate(x["gaps"], F.lit(0).cast("long"), lambda n, gap: n + gap["n"])
        return inner + F.size(F.filter(x["pairs"], lambda p: p["new"].isNotNull()))

    return _let(F.struct(gaps.alias("gaps"), pairs.alias("pairs")), lambda x: F.struct(text(x).alias("text"), count(x).alias("n")))


def _changed(text: Column, pattern: Column, new, gap) -> Column:
    """Struct (text, n): ``new`` of each match, null to keep it, and ``gap`` of what lies between."""
    pairs = F.transform(
        F.regexp_extract_all(text, pattern, F.lit(0)), lambda t: F.struct(t.alias("found"), new(t).alias("new")))
    return _spelled_anew(F.transform(F.split(text, pattern), gap), pairs)


def _without_cards(text: Column, key: str) -> Column:
    return _changed(
        text, F.lit(_pattern()), lambda t: pseudonym(t, key),
        lambda gap: F.struct(gap.alias("text"), F.lit(0).cast("long").alias("n")))


def _all_changed(text: Column, key: str) -> Column:
    def with_cards(cards: Column) -> Column:
        # cards are digits, blanks and hyphens: nothing to escape
        these = F.concat(F.lit("(?<![0-9A-Za-z])(?:"), F.array_join(cards, "|"), F.lit(")(?![0-9])"))
        return F.when(
            F.size(cards) > 0, _changed(text, these, lambda t: _card(t, key), lambda gap: _without_cards(gap, key))
        ).otherwise(_without_cards(text, key))
    return _let(_valid_cards(text), with_cards)


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with ``text`` pseudonymised and ``n_replaced``, the number of values, added.

    Texts without a value, null and empty ones are unchanged with 0 values; candidates that do not
    validate stay, and what is inside them is searched. Rows are treated one by one, so repeated
    rows and empty tables need no rule; all other columns pass through, but for an ``n_replaced`` of the input,
    which gives way to the new one.
    """
    return _rewritten(docs, [c for c in docs.columns if c != "n_replaced"], ["n_replaced"], key)


def rewritten(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with ``text`` pseudonymised and every other column, of whatever name, as it was."""
    return _rewritten(docs, docs.columns, [], key)


def _rewritten(docs: DataFrame, names: list[str], counts: list[str], key: str) -> DataFrame:
    mine = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.toDF(*mine.values())
    text = F.col(mine["text"])
    inner = inner.withColumn("_new", F.when(text.rlike(HINT), _all_changed(text, key)))
    changed = F.coalesce(F.col("_new")["text"], text)
    return inner.select(
        *[(changed if c == "text" else F.col(mine[c])).alias(c) for c in names],
        *[F.coalesce(F.col("_new")["n"], F.lit(0)).cast("long").alias(c) for c in counts])
