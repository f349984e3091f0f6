"""Format-preserving pseudonyms for personal data in text.

Numbers and dates are found by one pattern, validated (Luhn, mod 97, octets, number plans, calendar), and permuted by a keyed
Feistel network within the values of their format: a card number becomes another valid card number with its separators
where they were, a date another date in the same notation.  The permutation depends on the key, the kind and the canonical
value only, so equal values - however they are written - stay linked across documents, and nothing is looked up or stored.

Only DataFrame functions are used, in one pass without a shuffle.  A value is a list of elements, each below its own radix;
a round adds keyed hashes of one half to the other half, element by element, modulo their radices.

A query's plan, which Spark shows in explain output and event logs, holds a subkey for each kind of data, not the key itself.
Who has a subkey can undo the pseudonyms of that kind, so keep plans and logs as secret as the data.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "iban", "date", "ip", "ssn", "phone", "card")
#: Dates from 1700 through 2099 are permuted: one Gregorian cycle of 146,097 = 189 * 773 days.
FIRST_DAY, CYCLE = "1700-01-01", (189, 773)

_MONTH, _DAY, _YEAR, _END = "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12][0-9]|3[01])", "(?:1[7-9]|20)[0-9]{2}", "(?!T(?![0-9])|[0-9A-SU-Za-z])"
#: What each kind looks like; whether it is valid is decided afterwards.  Digits, capitals or signs beside a find don't hide it.
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
    "date": rf"(?:{_YEAR}([-/.]){_MONTH}\1{_DAY}|(?:{_MONTH}([-/.]){_DAY}\2|{_DAY}([-/.]){_MONTH}\3){_YEAR}){_END}",
    "ip": r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z])",
    "phone": r"(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9A-Za-z])|\+[1-9][0-9]{0,2}(?:[ .-]?[0-9]){7,12}(?![0-9A-Za-z])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
}
#: Kinds that are looked for in what the finds of ``FIRST`` leave.
OTHERS = ("email", "date", "ip", "ssn", "phone")
ANY = r"(?<![A-Za-z0-9])(?:" + "|".join(SHAPES[k] for k in OTHERS) + ")"
#: Finds that come before all others.  Groups of capitals and digits after what may begin an IBAN, and digit groups with one space
#: or hyphen between them, go as a whole; IBANs and cards are found in them, wherever they begin and end.
FIRST = (
    r"(?<![A-Za-z0-9]|[0-9]\.)(?:" + SHAPES["email"] + r"|[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}(?![A-Za-z0-9])|(?:[ -][A-Z0-9]{1,34}+(?![A-Za-z0-9]))++)"
    r"|(?<!\+)(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ -][0-9]++(?![A-Za-z]))*+)"
)
#: Groups that may all be years.
YEARS = "(?:(?:1[0-9]|2[01])[0-9]{2}[ -]?){4}"
#: Digit groups of a card among other groups: how many, and what they look like.  Four groups that may be years are none.
GROUPINGS = (
    (1, r"^[0-9]{13,19}(?![0-9])"),
    (4, r"^(?!" + YEARS + r"(?![0-9]))[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    (3, r"^[0-9]{4}([ -])[0-9]{6}\1[0-9]{4,5}(?![0-9])"),
    (5, r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\1[0-9]{3}(?![0-9])"),
)
#: How long an IBAN of each country is.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_COUNTRIES = "^(?:" + "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}[A-Z0-9]{{{n - 4}}}" for n, names in IBAN_LENGTHS.items()) + ")$"
#: Stands for a find of ``FIRST`` until the rest is done; the sign that it begins with is doubled up in the text itself.
SIGN = "\x01"
PLACE, ESCAPED = SIGN + "\x03", SIGN + "\x02"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _long(x) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")


def subkey(key: str, kind: str) -> str:
    return hmac.new(key.encode(), kind.encode(), hashlib.sha256).hexdigest()


def permuted(elements: Column, radices: Column, key: str, kind: str) -> Column:
    """Keyed permutation of ``elements`` (array<long>, each below its radix), within the same radices."""

    def shifted(part: Column, other: Column, r: Column, own: Column) -> Column:
        said = F.concat_ws("|", F.lit(subkey(key, kind)), r, F.size(part), F.concat_ws(",", F.transform(other, lambda x: x.cast("string"))))
        moved = lambda said, x, i: F.pmod(x + F.conv(F.substring(F.sha2(F.concat_ws("|", said, i), 256), 1, 14), 16, 10).cast("long"), F.element_at(own, i + 1))
        return bound(said, lambda said: F.transform(part, lambda x, i: moved(said, x, i)))

    def halves(s: Column) -> Column:
        """Halves change places after each round; there is an even number of rounds, so they end where they were."""
        n = F.size(s["e"])
        half = F.greatest(F.lit(1), F.floor(n / 2).cast("int"))
        cut = lambda a: (F.slice(a, 1, half), F.slice(a, half + 1, n))
        names = ("l", "r", "rl", "rr")
        struct = lambda *parts: F.struct(*(x.alias(name) for x, name in zip(parts, names)))
        step = lambda a, r: struct(a["r"], shifted(a["l"], a["r"], r, a["rl"]), a["rr"], a["rl"])
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), struct(*cut(s["e"]), *cut(s["own"])), step, lambda a: F.concat(a["l"], a["r"]))

    return bound(F.struct(elements.alias("e"), radices.alias("own")), halves)


def _digits(s: Column) -> Column:
    """The digits of a string of digits as array<long>."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: c.cast("long"))


def _tens(a: Column) -> Column:
    return F.transform(a, lambda _: _long(10))


def _string(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), "")


def _luhn(digits: Column, check_follows: bool) -> Column:
    """Luhn sum modulo 10; ``check_follows``: of all but the last digit."""
    odd = 0 if check_follows else 1
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == odd, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, _long(0), lambda a, d: a + d) % 10


def _refilled(shape: Column, fill: Column) -> Column:
    """``shape`` with its letters and digits replaced by the characters of ``fill`` in turn."""

    def filled(fill: Column) -> Column:
        step = lambda a, c: F.struct((a["i"] + c.rlike("[A-Za-z0-9]").cast("int")).alias("i"), F.concat(a["out"], F.when(c.rlike("[A-Za-z0-9]"), F.substring(fill, a["i"] + 1, F.lit(1))).otherwise(c)).alias("out"))
        return F.aggregate(F.split(shape, ""), F.struct(F.lit(0).alias("i"), F.lit("").alias("out")), step, lambda a: a["out"])

    return bound(fill, filled)


def _bare(m: Column) -> Column:
    return F.regexp_replace(m, "[^A-Za-z0-9]", "")


def _card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = F.slice(d, 1, F.size(d) - 1)
        new = permuted(body, _tens(body), key, "card")
        whole = bound(new, lambda x: F.concat(_string(x), F.pmod(-_luhn(x, True), F.lit(10)).cast("string")))
        return F.when((_luhn(d, False) == 0) & F.exists(d, lambda x: x != 0), _refilled(m, whole))

    return bound(_digits(_bare(m)), made)


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    made = lambda o: F.when(F.forall(o, lambda x: x < 256), F.array_join(F.transform(permuted(o, F.transform(o, lambda _: _long(256)), key, "ip"), lambda x: x.cast("string")), "."))
    return bound(octets, made)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, numbers 0001-9999."""
    area, group, number = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (number > 0)
    elements = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, number - 1)
    new = permuted(elements, F.array(_long(898), _long(99), _long(9999)), key, "ssn")
    back = lambda x: F.concat_ws("-", F.lpad((x[0] + F.when(x[0] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((x[1] + 1).cast("string"), 2, "0"), F.lpad((x[2] + 1).cast("string"), 4, "0"))
    return F.when(valid, bound(new, back))


def _phone(m: Column, key: str) -> Column:
    """Ten-digit numbers keep what a code and an exchange may begin with; others keep their country code's digits in front."""

    def made(d: Column) -> Column:
        ten = F.slice(d, -10, 10)
        national = (F.size(d) == 10) | ((F.size(d) == 11) & (d[0] == 1))
        low = F.transform(ten, lambda _, i: F.when((i == 0) | (i == 3), _long(2)).otherwise(_long(0)))
        new = permuted(F.zip_with(ten, low, lambda x, y: x - y), F.transform(low, lambda x: 10 - x), key, "phone")
        own = F.concat(F.slice(d, 1, F.size(d) - 10), F.zip_with(new, low, lambda x, y: x + y))
        head, rest = F.slice(d, 1, 3), F.slice(d, 4, F.size(d))
        other = F.concat(head, permuted(rest, _tens(rest), key, "phone"))
        valid = F.when(national, (ten[0] > 1) & (ten[3] > 1)).otherwise(m.startswith("+") & (F.size(d) >= 8) & (F.size(d) <= 15))
        return F.when(valid, _refilled(m, _string(F.when(national, own).otherwise(other))))

    return bound(_digits(_bare(m)), made)


def _class(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), F.lit(_DIGITS)).when(c.rlike("[A-Z]"), F.lit(_UPPER)).otherwise(F.lit(_LOWER))


def _letters(s: Column, key: str, kind: str) -> Column:
    """A string of letters and digits permuted character by character within digits, small and capital letters."""

    def made(chars: Column) -> Column:
        elements = F.transform(chars, lambda c: (F.position(c, _class(c)) - 1).cast("long"))
        radices = F.transform(chars, lambda c: F.length(_class(c)).cast("long"))
        new = permuted(elements, radices, key, kind)
        return F.array_join(F.zip_with(new, chars, lambda x, c: F.substring(_class(c), (x + 1).cast("int"), F.lit(1))), "")

    return bound(F.filter(F.split(s, ""), lambda c: c != ""), made)


def _email(m: Column, key: str) -> Column:
    """The local part; equal addresses in other letter case are linked in their letters' order, the domain stays."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.when(_bare(local) != "", F.concat(_refilled(local, _letters(_bare(local), key, "email")), F.lit("@"), domain))


def _mod97(s: Column) -> Column:
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("string")).otherwise((F.ascii(c) - 55).cast("string"))
    number = F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), value), "")
    return F.aggregate(_digits(number), _long(0), lambda a, d: (a * 10 + d) % 97)


def _iban_valid(s: Column) -> Column:
    """Whether a string of capitals and digits has a country's code, its length and the right check digits."""
    return s.rlike(IBAN_COUNTRIES) & (_mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1)


def _iban(m: Column, key: str) -> Column:
    def made(s: Column) -> Column:
        country, body, valid = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s)), _iban_valid(s)
        new = lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)
        return F.when(valid, _refilled(m, bound(_letters(body, key, "iban"), new)))

    return bound(_bare(m), made)


def _date(m: Column, key: str) -> Column:
    """year-month-day, day.month.year, and day/month/year or month/day/year: the month comes first where both would do."""

    def made(p: Column) -> Column:
        year_first = F.length(p[0]) == 4
        day_first = (~year_first) & (F.contains(m, F.lit(".")) | (p[0].cast("int") > 12))
        year, month, day = F.when(year_first, p[0]).otherwise(p[2]), F.when(year_first, p[1]).when(day_first, p[1]).otherwise(p[0]), F.when(year_first, p[2]).when(day_first, p[0]).otherwise(p[1])
        number = F.date_diff(F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d"), F.lit(FIRST_DAY).cast("date")).cast("long")

        def back(new: Column) -> Column:
            wide = lambda v, old: F.when(F.length(old) == 2, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
            sign = F.substring(F.regexp_replace(m, "[0-9]", ""), 1, 1)
            y, mo, d = F.lpad(F.year(new).cast("string"), 4, "0"), F.month(new), F.day(new)
            return F.when(year_first, F.concat(y, sign, wide(mo, p[1]), sign, wide(d, p[2]))).when(day_first, F.concat(wide(d, p[0]), sign, wide(mo, p[1]), sign, y)).otherwise(F.concat(wide(mo, p[0]), sign, wide(d, p[1]), sign, y))

        def moved(number: Column) -> Column:
            elements = F.array(F.floor(number / CYCLE[1]).cast("long"), number % CYCLE[1])
            day = lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), (x[0] * CYCLE[1] + x[1]).cast("int"))
            new = bound(permuted(elements, F.array(_long(CYCLE[0]), _long(CYCLE[1])), key, "date"), day)
            return F.when((number >= 0) & (number < CYCLE[0] * CYCLE[1]), bound(new, back))

        return bound(number, moved)

    return bound(F.split(m, "[-/.]"), made)


_MADE = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(m: Column, key: str, kinds: tuple[str, ...]) -> Column:
    """struct(kind, text) for one find: its first valid kind and pseudonym; kind is null and the text as it was if none is valid."""
    def attempt(kind: str) -> Column:
        named = lambda new: F.when(new.isNotNull(), F.struct(F.lit(kind).alias("kind"), new.alias("text")))
        return F.when(m.rlike("^(?:" + SHAPES[kind] + ")$"), bound(_MADE[kind](m, key), named))

    tried = [attempt(kind) for kind in kinds]
    return F.coalesce(*tried, F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text")))


def _luhn_valid(m: Column) -> Column:
    return bound(_digits(_bare(m)), lambda d: (_luhn(d, False) == 0) & F.exists(d, lambda x: x != 0))


def _runs(m: Column, key: str) -> Column:
    """struct(rest, made): IBANs and cards made anew, from left to right, and the texts before, between and after them."""

    def taken(groups: Column) -> Column:
        joined = lambda i, n: F.array_join(F.slice(groups, i + 1, n), "")

        def iban(i: Column) -> Column:
            """The most groups from ``i`` on that are an IBAN."""
            def good(n: Column) -> Column:
                return bound(joined(i, n), lambda x: x.rlike("^" + SHAPES["iban"] + "[^A-Za-z0-9]*$") & bound(_bare(x), _iban_valid))

            sizes = F.filter(F.sequence(F.least(F.lit(9), F.size(groups) - i), F.lit(1), F.lit(-1)), good)
            return F.when(groups[i].rlike("^[A-Z]{2}[0-9]{2}"), F.try_element_at(sizes, F.lit(1)))

        def card(i: Column) -> Column:
            """The groups from ``i`` on that are a card: in one of GROUPINGS, or all that are left if nothing else is in them."""
            sizes = [bound(joined(i, F.lit(n)), lambda x: F.when(x.rlike(shape) & _luhn_valid(x), F.lit(n))) for n, shape in GROUPINGS]
            every = lambda x: x.rlike("^" + SHAPES["card"] + "[^A-Za-z0-9]*$") & ~x.rlike("|".join(SHAPES[k] for k in OTHERS)) & ~x.rlike(YEARS) & _luhn_valid(x)
            left = F.when(F.size(groups) - i <= 19, F.when(bound(joined(i, F.size(groups) - i), every), F.size(groups) - i))
            return F.when(groups[i].rlike("^[0-9]"), F.coalesce(*sizes, left))

        span = lambda i, n, is_iban: F.struct(i.alias("at"), n.alias("n"), F.lit(is_iban).alias("iban"))
        at = lambda i: F.coalesce(bound(iban(i), lambda n: F.when(n.isNotNull(), span(i, n, True))), span(i, F.coalesce(card(i), F.lit(0)), False))
        found = F.filter(F.transform(groups, lambda _, i: at(i)), lambda x: x["n"] > 0)
        step = lambda a, x: F.when(F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0)) <= x["at"], F.concat(a, F.array(F.struct(x["at"].alias("at"), (x["at"] + x["n"]).alias("end"), x["iban"].alias("iban"))))).otherwise(a)
        spans = F.aggregate(found, F.array().cast("array<struct<at:int,end:int,iban:boolean>>"), step)

        def pieces(spans: Column) -> Column:
            edge = lambda n: F.array(F.struct(n.alias("at"), n.alias("end"), F.lit(False).alias("iban")))
            rest = F.zip_with(F.concat(edge(F.lit(0)), spans), F.concat(spans, edge(F.size(groups))), lambda x, y: joined(x["end"], y["at"] - x["end"]))
            new = lambda x, text: F.struct(F.when(x["iban"], "iban").otherwise("card").alias("kind"), F.when(x["iban"], _iban(text, key)).otherwise(_card(text, key)).alias("text"))
            made = F.transform(spans, lambda x: bound(joined(x["at"], x["end"] - x["at"]), lambda text: new(x, text)))
            return F.struct(rest.alias("rest"), made.alias("made"))

        return bound(spans, pieces)

    return bound(F.regexp_extract_all(m, F.lit("[A-Za-z0-9]+[^A-Za-z0-9]*"), F.lit(0)), taken)


def _first(m: Column, key: str) -> Column:
    """struct(rest, made) of one find of ``FIRST``."""
    none = F.struct(F.array(m).alias("rest"), F.array().cast("array<struct<kind:string,text:string>>").alias("made"))
    whole = lambda x: F.when(x["kind"].isNotNull(), F.struct(F.array(F.lit(""), F.lit("")).alias("rest"), F.array(x).alias("made")))
    return F.when(m.contains("@"), F.coalesce(bound(pseudonym(m, key, ("email",)), whole), none)).otherwise(_runs(m, key))


def _filled(text: Column, pattern: str, finds: Column) -> Column:
    """``text`` with its finds of ``pattern`` replaced by the texts ``finds`` in turn."""
    return F.array_join(F.zip_with(F.split(text, pattern, -1), F.concat(finds, F.array(F.lit(""))), lambda gap, new: F.concat(gap, new)), "")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_email, n_iban, n_date, n_ip, n_ssn, n_phone, n_card) for each row of ``docs``: doc_id, text.

    Valid personal data in ``text`` is replaced by pseudonyms under ``key``; everything else, invalid numbers included, stays
    as it is.  A card in one piece, or in one of ``GROUPINGS`` with one separator, is found among other digit groups too; in
    any other grouping only where no digit group follows and no other kind of number is in it.  An IBAN is found among other
    groups of capitals and digits; only the countries in ``IBAN_LENGTHS`` have one.  A null text stays null.  Rows stay as they are otherwise, repeated
    ones and null ids too; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text, own = F.col("text"), F.replace(F.col("text"), F.lit(SIGN), F.lit(ESCAPED))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    finds = lambda column, pattern, use: F.when(column.rlike("[0-9@]"), F.transform(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), use))
    rows = docs.withColumn("first", finds(own, FIRST, lambda m: _first(m, key)))
    rows = rows.withColumn("made", F.coalesce(F.flatten(F.transform("first", lambda x: x["made"])), none))
    placed = F.when(F.size("made") > 0, _filled(own, FIRST, F.transform("first", lambda x: F.array_join(x["rest"], PLACE)))).otherwise(own)
    rows = rows.withColumn("placed", placed)
    rows = rows.withColumn("finds", F.coalesce(finds(F.col("placed"), ANY, lambda m: pseudonym(m, key, OTHERS)), none))
    others = F.when(F.size("finds") > 0, _filled(F.col("placed"), ANY, F.transform("finds", lambda x: x["text"]))).otherwise(F.col("placed"))
    filled = F.replace(_filled(others, PLACE, F.transform("made", lambda x: x["text"])), F.lit(ESCAPED), F.lit(SIGN))
    count = lambda kind: F.size(F.filter(F.concat("made", "finds"), lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return rows.select("doc_id", F.when(F.size(F.concat("made", "finds")) > 0, filled).otherwise(text).alias("text"), *counts)
