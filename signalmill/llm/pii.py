"""Personal data under format-preserving pseudonyms, with DataFrame functions only.

One pattern finds candidates; each is validated (Luhn sum, number ranges, calendar) and replaced by a
keyed permutation of its own format, so equal values have equal pseudonyms in every document and distinct
values stay distinct. Numbers and dates are permuted by a Feistel network over a pair of residues whose
moduli multiply to exactly the number of valid values; local parts of mail addresses and access keys by
one over character classes (a digit stays a digit, a letter keeps its case). Separators stay in place.

Whole texts are read; what fits no kind or fails its check stays as it is. A null text stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.llm.common import unused

ROUNDS = 8

# Formats and number ranges.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
KEY = r"(?<![A-Za-z0-9])A(?:KIA|SIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
SLASH_DATE = r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
CARD = r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"
NORTH_PHONE = r"(?<![\d+])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?!\d)"
PHONE = r"\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)"
#: Kinds in the order in which they are tried at a place.
KINDS = {
    "email": EMAIL, "key": KEY, "date": f"{ISO_DATE}|{SLASH_DATE}", "ssn": SSN, "ip": IP, "card": CARD,
    "phone": f"{NORTH_PHONE}|{PHONE}",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
FIRST_DAY, LAST_DAY, DATE_MODULI = "1700-01-01", "2099-12-31", (189, 773)  # 400 years have 189 * 773 days


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` names it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _draw(key: str, kind: str, i: Column, value: Column) -> Column:
    """60 keyed bits of a value."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a, b, key: str, kind: str) -> Column:
    """Struct (l, r): a keyed permutation of the pairs of residues modulo ``a`` and ``b``."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))

    def one(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        drawn = _draw(key, kind, i, F.when(even, s["r"]).otherwise(s["l"]))
        return F.struct(
            F.when(even, F.pmod(s["l"] + drawn, a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + drawn, b)).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _padded(number: Column, width) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in turn by ``digits``."""
    place = lambda i: F.length(_digits(F.substring(value, F.lit(1), i + 1)))

    def put(new: Column) -> Column:
        digit = lambda c, i: F.when(c.rlike("[0-9]"), F.substring(new, place(i), F.lit(1))).otherwise(c)
        return F.array_join(F.transform(F.split(value, ""), digit), "")

    return let(digits, put)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _number(digits: Column, key: str, kind: str) -> Column:
    """A permutation of the digit strings of the same length (of 18 digits at most)."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    left = F.substring(digits, F.lit(1), n - low)
    right = F.concat(F.lit("0"), F.substring(digits, n - low + 1, low))  # never empty

    def text(out: Column) -> Column:
        tail = F.when(low > 0, F.lpad(out["r"].cast("string"), low, "0")).otherwise("")
        return F.concat(F.lpad(out["l"].cast("string"), n - low, "0"), tail)

    return let(feistel(left, right, _power(n - low), _power(low), key, kind), text)


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right (but the last) doubled and reduced."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(value: Column, key: str) -> Column:
    """The first digit and the Luhn sum's remainder stay; the digits between are permuted."""

    def valid(digits: Column) -> Column:
        n = F.length(digits)
        body = F.concat(F.substring(digits, 1, 1), _number(F.substring(digits, F.lit(2), n - 2), key, "card"))
        checked = let(body, lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(_luhn(digits) % 10 == 0, _refill(value, checked))

    return let(_digits(value), valid)


def _date(value: Column, key: str) -> Column:
    slashed, as_month = value.contains("/"), F.try_to_date(value, "MM/dd/yyyy")
    day = F.when(slashed, F.coalesce(as_month, F.try_to_date(value, "dd/MM/yyyy"))).otherwise(F.try_to_date(value, "yyyy-MM-dd"))
    a, b = DATE_MODULI
    first, last = (F.lit(x).cast("date") for x in (FIRST_DAY, LAST_DAY))

    def text(moved: Column) -> Column:
        return (
            F.when(~slashed, F.date_format(moved, "yyyy-MM-dd"))
            .when(as_month.isNotNull(), F.date_format(moved, "MM/dd/yyyy"))
            .otherwise(F.date_format(moved, "dd/MM/yyyy"))
        )

    def valid(day: Column) -> Column:
        n = F.datediff(day, first)
        number = let(feistel(F.floor(n / b), n % b, a, b, key, "date"), lambda o: (o["l"] * b + o["r"]).cast("int"))
        return F.when(day.between(first, last), let(F.date_add(first, number), text))

    return let(day, valid)


def _ssn(value: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.split_part(value, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)

    def text(out: Column) -> Column:
        new = F.floor(out["l"] / 99)
        new_area = new + 1 + F.when(new >= 665, 1).otherwise(0)
        return F.concat_ws("-", _padded(new_area, 3), _padded(out["l"] % 99 + 1, 2), _padded(out["r"] + 1, 4))

    return F.when(valid, let(feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn"), text))


def _ip(value: Column, key: str) -> Column:
    part = lambda i: F.split_part(value, F.lit("."), F.lit(i)).cast("int")

    def text(out: Column) -> Column:
        halves = [x for h in ("l", "r") for x in (F.floor(out[h] / 256), out[h] % 256)]
        return F.concat_ws(".", *(h.cast("string") for h in halves))

    return let(feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), 65536, 65536, key, "ip"), text)


def _phone(value: Column, key: str) -> Column:
    """North American numbers keep valid area and exchange codes; others their first two digits."""

    def by_digits(digits: Column) -> Column:
        n = F.length(digits)
        own = F.substring(digits, n - 9, F.lit(10))
        area, exchange, line = (F.substring(own, *at).cast("int") for at in ((1, 3), (4, 3), (7, 4)))

        def north(out: Column) -> Column:
            return F.concat(
                F.substring(digits, F.lit(1), n - 10),
                _padded(F.floor(out["l"] / 800) + 200, 3), _padded(out["l"] % 800 + 200, 3), _padded(out["r"], 4),
            )

        mixed = let(feistel((area - 200) * 800 + exchange - 200, line, 640_000, 10_000, key, "phone"), north)
        other = F.concat(F.substring(digits, 1, 2), _number(F.substring(digits, F.lit(3), n - 2), key, "phone"))
        is_north = value.rlike(f"^(?:{NORTH_PHONE})$") & (area >= 200) & (exchange >= 200)
        return F.when(is_north, _refill(value, mixed)).when(n.between(7, 18), _refill(value, other))

    return let(_digits(value), by_digits)


def _shifted(text: Column, other: Column, i: Column, key: str, kind: str) -> Column:
    """Every letter and digit of ``text`` moved within its class by a stream drawn from ``other``."""

    # Each character draws two hex digits; one hash gives 32 pairs, which the 64 characters of a value need twice.
    drawn = lambda block: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.lit(block), other), 256)

    def put(stream: Column) -> Column:
        def one(c: Column, j: Column) -> Column:
            by = F.conv(F.substring(stream, 2 * j + 1, F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)
            return (
                F.when(c.rlike("[0-9]"), F.char((code - 48 + by) % 10 + 48))
                .when(c.rlike("[a-z]"), F.char((code - 97 + by) % 26 + 97))
                .when(c.rlike("[A-Z]"), F.char((code - 65 + by) % 26 + 65))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(text, ""), one), "")

    return let(F.concat(drawn("0"), F.when(F.length(text) > 32, drawn("1")).otherwise("")), put)


def _string(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings with the same classes of characters."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")

    # Halves are short: a local part has 64 characters at most.
    def one(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        own, other = F.when(even, s["l"]).otherwise(s["r"]), F.when(even, s["r"]).otherwise(s["l"])
        moved = F.when(own == "", own).otherwise(_shifted(own, other, i, key, kind))
        pair = lambda m: F.struct(
            F.when(even, m).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(m).alias("r")
        )
        return let(moved, pair)

    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, n).alias("r"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one)
    return let(out, lambda o: F.concat(o["l"], o["r"]))


def _email(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    return F.concat(_string(F.substring(value, F.lit(1), at - 1), key, "email"), F.substring(value, at, F.length(value)))


def _key(value: Column, key: str) -> Column:
    return F.concat(F.substring(value, 1, 4), _string(F.substring(value, 5, 16), key, "key"))


_PSEUDONYM = {"email": _email, "key": _key, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card, "phone": _phone}


def pseudonymize(docs: DataFrame, key: str, text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with every valid value in ``text`` replaced; with ``counts`` also ``n_<kind>`` and ``n_values``.

    ``key`` is the secret: the same key links values across tables, another one unlinks them. Columns of
    those names in ``docs`` are replaced.
    """
    names = [*(f"n_{kind}" for kind in KINDS), "n_values"] if counts else []
    docs = docs.drop(*(c for c in names if c in docs.columns))
    value = F.col(f"`{text}`")
    # Every kind has a digit or an @, but for keys, which may be letters only.
    may = value.rlike("[0-9@]") | value.contains("AKIA") | value.contains("ASIA")
    found = F.when(may, F.regexp_extract_all(value, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    held = unused(docs, "_found")
    rows = docs.withColumn(held, found)

    def kind_of(m: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind in reversed(KINDS):
            out = F.when(m.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
        return out

    def changed(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, fn in _PSEUDONYM.items():
            out = F.when(x["kind"] == kind, fn(x["value"], key)).otherwise(out)
        return F.struct(x["kind"].alias("kind"), x["value"].alias("value"), out.alias("new"))

    kinds = F.transform(held, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value")))
    rows = rows.withColumn(held, F.transform(kinds, changed))
    parts = F.split(value, ANY, -1)
    put = F.concat(F.array(F.lit("")), F.transform(held, lambda x: F.coalesce(x["new"], x["value"])))
    joined = F.array_join(F.zip_with(put, parts, lambda m, gap: F.concat(m, gap)), "")
    any_new = F.exists(held, lambda x: x["new"].isNotNull())
    put_in = F.when(value.isNotNull() & any_new, joined).otherwise(value)
    new_of = lambda kind: F.size(F.filter(held, lambda x: (x["kind"] == kind) & x["new"].isNotNull())).cast("long")
    extra = [new_of(kind).alias(f"n_{kind}") for kind in KINDS] if counts else []
    if counts:
        extra.append(F.size(F.filter(held, lambda x: x["new"].isNotNull())).cast("long").alias("n_values"))
    kept = [put_in.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*kept, *extra)
