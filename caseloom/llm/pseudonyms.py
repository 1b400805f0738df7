"""Format-preserving pseudonyms for personal data (operator 2). Column expressions only.

A value is found by its form, validated, split into two numbers and sent through a
keyed Feistel network over exactly the numbers its format allows; the result is
written in the form of the original. The permutation is P^-1(P(x) + 1), so no value
stands for itself, different values stay different, and equal values stay equal in
all documents under one key.

Kinds: payment cards (Luhn), IBANs (mod 97), US social security and telephone
numbers, IPv4 addresses, calendar dates of 1900 to 2099. E-mail addresses and secrets
have no number format; they get a keyed digest of the same length and shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import inputs
from .quality_rules import let

ROUNDS = 10
#: Form of each kind, tried in this order at each place of a text.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?:(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))|(?:(?i:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9_/+.-]{8,}[\"']?)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z/.-])(?:(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[/.][0-9]{1,2}[/.](?:19|20)[0-9]{2})(?:(?=T[0-9])|(?![0-9A-Za-z/-]))",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9])",
}
#: Length of an IBAN by country (ISO 13616 registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Where a card may start and end: at groups of digits, also behind a hyphen between digits.
CARD_START, CARD_END = r"(?:(?<![0-9A-Za-z.-])|(?<=[0-9]-))", r"(?![0-9A-Za-z])"
#: At most 19 digits from each group on.
CARD_WINDOW = CARD_START + r"(?=([0-9](?:[ -]?[0-9]){12,18}" + CARD_END + "))"
#: Groups of a card inside a longer match: a single one, or four digits and more in all but the last.
CARD_GROUPS = r"^[0-9]{4,}(?:([ -])[0-9]{4,}(?:\1[0-9]{4,})*(?:\1[0-9]{1,3})?|[ -][0-9]{1,3})?$"
#: Lengths that the issuer's leading digits ask for.
CARD_ISSUED = r"^(?:4[0-9]{15}|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13})$"
#: A text without these characters holds none of the forms.
HINT = r"[0-9@]|(?i:password|passwd|pwd|token|secret|api[_-]?key)"
KINDS = tuple(FORMS)


def _long(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))


def _part(digits: Column, start, size) -> Column:
    return _long(F.substring(digits, F.lit(start) if isinstance(start, int) else start, F.lit(size) if isinstance(size, int) else size))


def _padded(value: Column, size) -> Column:
    return F.lpad(value.cast("string"), F.lit(size) if isinstance(size, int) else size, F.lit("0"))


def permute(left: Column, right: Column, a: Column, b: Column, key: str, kind: Column) -> Column:
    """struct(l, r): the keyed permutation of (left, right) among a * b pairs."""

    def add(seed: Column, i: Column, x: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), seed, i.cast("string"), x.cast("string")).cast("binary"), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def pair(l: Column, r: Column) -> Column:
        return F.struct(l.alias("l"), r.alias("r"))

    def step(s: Column, i: Column, sign: int) -> Column:
        even = pair(F.pmod(s["l"] + sign * F.pmod(add(kind, i, s["r"]), a), a), s["r"])
        odd = pair(s["l"], F.pmod(s["r"] + sign * F.pmod(add(kind, i, s["l"]), b), b))
        return F.when(i % 2 == 0, even).otherwise(odd)

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    there = F.aggregate(rounds, pair(left, right), lambda s, i: step(s, i, 1))
    moved = let(there, lambda s: pair(F.pmod(s["l"] + 1, a), s["r"]))
    return F.aggregate(F.reverse(rounds), moved, lambda s, i: step(s, i, -1))


def refilled(form: Column, filling: Column, places: str) -> Column:
    """``form`` with its characters that match ``places`` replaced in order by those of ``filling``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def put(acc: Column, c: Column) -> Column:
        return F.when(c.rlike(places), F.struct(F.concat(acc["s"], F.substring(filling, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))).otherwise(
            F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i")))

    return F.aggregate(F.split(form, ""), start, put)["s"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of the digits with the last one not doubled."""

    def add(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), add), F.lit(0), lambda a, x: a + x)


def mod97(compact: Column) -> Column:
    """Remainder by 97 of an IBAN with its first four characters behind the rest and letters as 10 to 35."""
    moved = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    """The first digit stays, so does the length; the last digit is the new check digit."""

    def change(d: Column) -> Column:
        n = F.length(d)
        half = F.floor((n - 2) / 2).cast("int")
        rest = n - 2 - half
        new = permute(_part(d, 2, half), _part(d, half + 2, rest), _power(half), _power(rest), key, F.concat(F.lit("card"), n.cast("string")))
        body = let(new, lambda p: F.concat(F.substring(d, 1, 1), _padded(p["l"], half), _padded(p["r"], rest)))
        full = let(body, lambda x: F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when((luhn_sum(d) % 10 == 0) & ~d.rlike("^(.)\\1*$"), refilled(m, full, "[0-9]"))

    return let(_digits(m), change)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _iban(m: Column, key: str) -> Column:
    """Country and letters stay; the digits of the account are permuted and the check digits follow."""

    def change(c: Column) -> Column:
        account = F.substring(c, F.lit(5), F.length(c))
        d = _digits(account)
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        rest = n - half
        new = permute(_part(d, 1, half), _part(d, half + 1, rest), _power(half), _power(rest), key, F.concat(F.lit("iban"), F.substring(c, 1, 2), n.cast("string")))
        filled = let(new, lambda p: refilled(account, F.concat(_padded(p["l"], half), _padded(p["r"], rest)), "[0-9]"))
        country = F.substring(c, 1, 2)
        full = let(filled, lambda x: F.concat(country, _padded(98 - mod97(F.concat(country, F.lit("00"), x)), 2), x))
        return F.when((mod97(c) == 1) & (n >= 4), refilled(m, full, "[A-Z0-9]"))

    return let(F.replace(m, F.lit(" "), F.lit("")), change)


def _ip(m: Column, key: str) -> Column:
    def change(o: Column) -> Column:
        at = lambda i: F.element_at(o, i).cast("long")
        size = F.lit(65536).cast("long")
        new = permute(at(1) * 256 + at(2), at(3) * 256 + at(4), size, size, key, F.lit("ip"))
        return let(new, lambda p: F.concat_ws(".", *[x.cast("string") for s in ("l", "r") for x in (F.floor(p[s] / 256), p[s] % 256)]))

    return let(F.split(m, "\\."), change)


def _date(m: Column, key: str) -> Column:
    """Days since 1900-01-01 are 17 * 4297 in number up to 2099-12-31. A date with slashes or dots is read
    month first if that is a date, else day first. A date with a one-digit part is written without leading zeros."""
    parts = F.split(m, "[/.-]")
    at = lambda i: F.lpad(F.get(parts, F.lit(i)), 2, "0")
    first, second, year = at(0), at(1), F.substring(m, -4, 4)
    iso = m.rlike("^[0-9]{4}-")
    read = lambda *ymd: F.try_to_timestamp(F.concat_ws("-", *ymd), F.lit("yyyy-MM-dd")).cast("date")
    month_first, day_first = read(year, first, second), read(year, second, first)
    day = F.when(iso, read(F.substring(m, 1, 4), at(1), at(2))).otherwise(F.coalesce(month_first, day_first))
    origin = F.lit("1900-01-01").cast("date")
    short = m.rlike("(?<![0-9])[0-9](?![0-9])")

    def change(n: Column) -> Column:
        new = permute(F.floor(n / 4297).cast("long"), (n % 4297).cast("long"), F.lit(17).cast("long"), F.lit(4297).cast("long"), key, F.lit("date"))
        moved = let(new, lambda p: F.date_add(origin, (p["l"] * 4297 + p["r"]).cast("int")))

        def write(d: Column) -> Column:
            month, of_month = (F.when(short, x.cast("string")).otherwise(_padded(x, 2)) for x in (F.month(d), F.dayofmonth(d)))
            mark = F.regexp_extract(m, "[/.-]", 0)
            both = F.when(iso | month_first.isNotNull(), F.concat(month, mark, of_month)).otherwise(F.concat(of_month, mark, month))
            whole = _padded(F.year(d), 4)
            return F.when(iso, F.concat(whole, mark, both)).otherwise(F.concat(both, F.substring(m, -5, 1), whole))

        return F.when(n.isNotNull(), let(moved, write))

    return let(F.date_diff(day, origin), change)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = _part(m, 1, 3), _part(m, 5, 2), _part(m, 8, 4)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    new = permute(place * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, F.lit("ssn"))

    def write(p: Column) -> Column:
        spot = F.floor(p["l"] / 99)
        return F.concat_ws("-", _padded(spot + 1 + F.when(spot >= 665, 1).otherwise(0), 3), _padded(p["l"] % 99 + 1, 2), _padded(p["r"] + 1, 4))

    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    return F.when(valid, let(new, write))


def _phone(m: Column, key: str) -> Column:
    """Area and exchange 200 to 999, line 0000 to 9999; a leading 1 stays. Numbers whose
    area or exchange is below 200 are permuted among themselves: 200 * 1000 + 800 * 200 pairs."""

    def change(d: Column) -> Column:
        ten = F.substring(d, -10, 10)
        area, exchange, line = _part(ten, 1, 3), _part(ten, 4, 3), _part(ten, 7, 4)
        low = (area < 200) | (exchange < 200)
        place = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
        left = F.when(low, place).otherwise(area - 200)
        right = F.when(low, line).otherwise((exchange - 200) * 10000 + line)
        size = lambda a, b: F.when(low, F.lit(a)).otherwise(F.lit(b)).cast("long")
        new = permute(left, right, size(360_000, 800), size(10_000, 8_000_000), key, F.when(low, "phone low").otherwise("phone"))

        def write(p: Column) -> Column:
            rest = p["l"] - 200_000
            pair = F.when(rest < 0, p["l"]).otherwise((F.floor(rest / 200) + 200) * 1000 + rest % 200)
            usual = F.concat((p["l"] + 200).cast("string"), (F.floor(p["r"] / 10000) + 200).cast("string"), _padded(p["r"] % 10000, 4))
            return F.when(low, F.concat(_padded(pair, 6), _padded(p["r"], 4))).otherwise(usual)

        return refilled(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), let(new, write)), "[0-9]")

    return let(_digits(m), change)


def _email(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)).cast("binary"), 256)
    return F.concat(F.lit("user."), F.substring(digest, 1, 12), F.lit("@example.org"))


def _secret(m: Column, key: str) -> Column:
    """The value is replaced by as many characters of a digest; its name and quotes stay."""
    value = F.regexp_extract(m, r"([A-Za-z0-9_/+.-]+)[\"']?$", 1)
    named = F.when(m.rlike("^(?:AKIA|ASIA)[A-Z0-9]{16}$"), F.substring(m, 5, 16)).otherwise(value)

    def change(v: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), v).cast("binary"), 256)
        long = F.substring(F.repeat(digest, F.ceil(F.length(v) / 64).cast("int")), F.lit(1), F.length(v))
        new = F.when(v.rlike("^[A-Z0-9]+$"), F.upper(long)).otherwise(long)
        at = F.length(m) - F.length(v) - F.when(m.rlike("[\"']$"), 1).otherwise(0)
        return F.concat(F.substring(m, F.lit(1), at), new, F.substring(m, at + F.length(v) + 1, F.length(m)))

    return let(named, change)


_CHANGE = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _ends(window: Column, close: str) -> Column:
    """The beginnings of ``window`` that end where a character of ``close`` or its end follows."""
    lengths = F.filter(F.sequence(F.lit(13), F.greatest(F.length(window), F.lit(13))), lambda n: F.substring(window, n + 1, F.lit(1)).rlike(f"^{close}?$"))
    return F.transform(lengths, lambda n: F.substring(window, F.lit(1), n))


def valid_cards(text: Column) -> Column:
    """The cards of a text as written: each match of the whole form, and from each group
    of digits on the likeliest beginning of 13 to 19 digits, where the check digit is
    right. One of no issuer's length in which a card of such a length starts is left out."""

    def valid(m: Column) -> Column:
        return let(_digits(m), lambda d: (luhn_sum(d) % 10 == 0) & ~d.rlike("^(.)\\1*$"))

    def issued(m: Column) -> Column:
        return _digits(m).rlike(CARD_ISSUED)

    def best(w: Column) -> Column:
        ends = F.filter(_ends(w, "[ -]"), lambda m: m.rlike(CARD_GROUPS) & F.length(_digits(m)).between(13, 19) & valid(m))
        return F.array_max(F.transform(ends, lambda m: F.struct(issued(m).alias("issued"), F.length(m).alias("n"), m.alias("m"))))["m"]

    whole = F.filter(F.regexp_extract_all(text, F.lit(FORMS["card"]), F.lit(0)), valid)
    inside = F.transform(F.regexp_extract_all(text, F.lit(CARD_WINDOW), F.lit(1)), best)
    every = F.array_distinct(F.concat(whole, F.array_compact(inside)))

    def clear(cards: Column) -> Column:
        sure = F.filter(cards, issued)

        def reached(c: Column, t: Column) -> Column:
            head, marked = F.substring(t, 1, 9), F.translate(c, "-", " ")
            return F.startswith(marked, F.concat(F.translate(t, "-", " "), F.lit(" "))) | F.contains(marked, F.concat(F.lit(" "), F.translate(head, "-", " ")))

        return F.filter(cards, lambda c: issued(c) | ~F.exists(sure, lambda t: reached(c, t)))

    return let(every, clear)


def valid_ibans(text: Column) -> Column:
    """The IBANs of a text as written: of each match the beginning of the country's
    length, else the longest beginning, that has the right check digits."""
    country = F.create_map(*[F.lit(x) for n, names in IBAN_LENGTHS.items() for c in names.split() for x in (c, n)])

    def compact(m: Column) -> Column:
        return F.replace(m, F.lit(" "), F.lit(""))

    def best(w: Column) -> Column:
        ends = F.filter(_ends(w, " "), lambda m: m.rlike(f"^(?:{FORMS['iban']})$") & (mod97(compact(m)) == 1) & (F.length(_digits(F.substring(m, F.lit(5), F.length(m)))) >= 4))
        asked = F.try_element_at(country, F.substring(w, 1, 2))
        return F.array_max(F.transform(ends, lambda m: F.struct(F.coalesce(F.length(compact(m)) == asked, F.lit(False)).alias("asked"), F.length(m).alias("n"), m.alias("m"))))["m"]

    start, form = FORMS["iban"][: len("(?<![A-Za-z0-9])")], FORMS["iban"][len("(?<![A-Za-z0-9])") :]
    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(f"{start}(?=({form}))"), F.lit(1)), best)))


def pattern(text: Column) -> Column:
    """The forms as one pattern, in which only the valid cards and IBANs of the text stand,
    so a form that runs on into what follows hides nothing."""

    def literal(values: Column, before: str, after: str) -> Column:
        # digits, capitals, spaces and hyphens only; longer ones first
        longest = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{before}(?:"), F.array_join(longest, "|"), F.lit(f"){after}"))).otherwise("(?!)")

    def write(cards: Column, ibans: Column) -> Column:
        head, tail = FORMS["phone"].rsplit("[0-9]{4}", 1)
        phone = F.concat(F.lit(f"{head}(?!"), cards, F.lit(f")[0-9]{{4}}{tail}"))
        forms = {k: F.lit(p) for k, p in FORMS.items()} | {"iban": ibans, "phone": phone, "card": cards}
        return F.concat_ws("|", *[F.concat(F.lit("(?:"), forms[k], F.lit(")")) for k in KINDS])

    none = F.array().cast("array<string>")
    cards = F.when(text.rlike("[0-9](?:[ -]?[0-9]){12}"), valid_cards(text)).otherwise(none)
    ibans = F.when(text.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), valid_ibans(text)).otherwise(none)
    return let(literal(cards, CARD_START, CARD_END), lambda c: let(literal(ibans, "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"), lambda i: write(c, i)))


def _change(m: Column, key: str) -> Column:
    """struct(kind, value): the first kind whose whole form and validation fit; kind is NULL for a value left as it is."""
    kept = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))

    def named(kind: str) -> Column:
        return let(_CHANGE[kind](m, key), lambda v: F.when(v.isNull(), kept).otherwise(F.struct(F.lit(kind).alias("kind"), v.alias("value"))))

    out = kept
    for kind in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{FORMS[kind]})$"), named(kind)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", into: str = "text", found: str | None = None) -> DataFrame:
    """Replace personal data in ``text``; ``into`` takes the new text and ``found``,
    if named, the list of kinds replaced.

    A NULL text stays NULL, and a text without personal data stays as it is, to the
    byte. All other columns pass through. Texts are split at the values found, so
    the work is one pass over each text and a few hashes per value.
    """
    body = F.col(text)
    hit = body.rlike(HINT)
    parts, new, forms = (inputs.free(docs, n) for n in ("_pii_parts", "_pii_new", "_pii_forms"))
    cut = docs.withColumn(forms, F.when(hit, pattern(body)))
    cut = cut.withColumn(parts, F.when(hit, F.split(body, F.col(forms), -1))).withColumn(new, F.when(hit, F.transform(F.regexp_extract_all(body, F.col(forms), F.lit(0)), lambda m: _change(m, key))))
    joined = F.array_join(F.transform(F.col(parts), lambda p, i: F.concat(p, F.coalesce(F.get(F.col(new), i)["value"], F.lit("")))), "")
    out = cut.withColumn(into, F.when(F.size(new) > 0, joined).otherwise(body))
    if found:
        kinds = F.filter(F.transform(new, lambda x: x["kind"]), lambda k: k.isNotNull())
        out = out.withColumn(found, F.coalesce(kinds, F.array().cast("array<string>")))
    return out.drop(parts, new, forms)


def private_texts(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, and the number of values replaced of each kind."""
    rows = pseudonymise(docs.select("doc_id", "text"), key, found="_kinds")

    def count(kind: str) -> Column:
        return F.size(F.filter("_kinds", lambda k: k == kind)).alias(f"n_{kind}")

    return rows.select("doc_id", "text", *map(count, KINDS))
