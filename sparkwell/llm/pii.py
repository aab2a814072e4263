"""PII: format-preserving Feistel pseudonyms (native: DataFrame functions only).

Found values are validated and keyed-permuted inside their own format, so a value has the
same pseudonym in every document and different values of a format keep different ones:

- ``card``: 13 to 19 digits, with single spaces or dashes allowed between them, that pass the
  Luhn test: a whole run of digits, or where that is none any part of it that begins and ends with
  a digit group and has groups of three digits or more (a card beside an expiry date, a CVV or
  another card); longer parts go first, then those further left. All digits but the last are permuted as one number and the check digit is made
  anew, so the pseudonym is again Luhn-valid and keeps its separators.
- ``date``: yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy and mm/dd/yyyy that are dates of 1900..2099,
  permuted as a day number inside that range and written in the same layout.
  Dates with the month's name (English, German, French or Spanish), as 5 March 2024 or March 5, 2024,
  are permuted by the same numbers.
- ``ip``: dotted quads of 0..255, permuted as a 32-bit number; IPv6 addresses as 32 hex digits, written
  in full, so that every way to write an address has one pseudonym.
- ``phone``: international numbers (+ and 7 to 15 digits, grouped), split by the list of country codes,
  not by their layout; the digits after the country code are permuted and the layout kept. National
  ones of the forms (555) 123-4567 and 555-123-4567 are permuted like those after +1.
- ``ssn``: 3-2-4 digits with dashes or spaces, or nine digits behind "SSN"; the nine digits are permuted.
- ``iban``: two letters, two check digits and 11 to 30 letters or digits (blanks after every fourth
  allowed) that pass the test modulo 97; digits and letters are permuted, each among themselves, the
  check digits are made anew.
- ``email``: the letters and digits of the whole local part are permuted as one string; the domain,
  which names no person, stays.

The permutation is a balanced or near-balanced Feistel network over Z_a x Z_b with ROUNDS
rounds whose round function is SHA-256 of key, kind, width, round and half. Ranges that are
not a product are walked until the value is inside (cycle walking). It is a bijection on each
format, so no two values of a format share a pseudonym; as with any keyed permutation, a value
is its own pseudonym with a chance of one in the size of the format.

Cases: null text stays null, empty stays empty; text without PII is returned byte for byte;
null ids, repeated rows and extra columns of any name are kept; an empty table gives an empty result.
The key is a parameter (``spark.sparkwell.pii.key`` in the session). There is no built-in key: where
the session has none, a run draws a random one, so its values are linked within that run only.
"""

from __future__ import annotations

import math
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
KEY_CONF = "spark.sparkwell.pii.key"

# A local part begins where its run of characters begins and never backs up, so long runs without
# an @ cost one pass.
EMAIL = r"(?<![A-Za-z0-9._%+\-À-ɏ])[A-Za-z0-9._%+\-À-ɏ]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
DATE = (r"(?<!\d)(?:(?:19|20)\d\d-\d\d-\d\d|(?:19|20)\d\d/\d\d/\d\d|\d\d\.\d\d\.(?:19|20)\d\d|\d\d/\d\d/(?:19|20)\d\d)(?!\d)")
SSN = r"(?:(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])|(?<![\d\-] ?)\d{3} \d{2} \d{4}(?! ?[\d\-])|(?<=SSN[ :#]{1,3})\d{9}(?!\d))"
NATIONAL = r"(?:\(\d{3}\) ?|(?<![\d+\-.])\d{3}[\-.])\d{3}[\-.]\d{4}(?![\-.]?\d)"
IPV6 = (r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
        r"|(?=[A-Fa-f]*\d)[0-9A-Fa-f]{3,4}:(?:[0-9A-Fa-f]{1,4}:){0,5}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])")
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: The months in English, German, French and Spanish.
MONTHS = (
    "January February March April May June July August September October November December "
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre").split()
_MONTH = "(?:" + "|".join(dict.fromkeys(MONTHS)) + ")"
NAMED = rf"(?:(?<!\d)\d{{1,2}}\.? (?:de )?{_MONTH} (?:de )?(?:19|20)\d\d(?!\d)|(?<!\w){_MONTH} \d{{1,2}}, (?:19|20)\d\d(?!\d))"
#: The country codes of one and two digits; all others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
# All digits with single separators between, up to another value; possessive, so that long runs
# need no stack. Which of them are cards is looked at in card_parts().
CARD = rf"(?<![\d\-])\d(?:(?! (?:{EMAIL}|{IP}|{DATE}|{SSN}))[ \-]?\d){{12,}}+"
PHONE = r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)"
ANY = "|".join((EMAIL, IBAN, IPV6, IP, DATE, NAMED, SSN, PHONE, NATIONAL, CARD))
#: A text without any of these holds no PII of the kinds above.
HINT = r"[0-9@]"
_DIGIT = r"[^0-9]"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _round(key: str, kind: str, width: Column, r: Column, half: Column, modulus: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), width.cast("string"), r.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 20 digits to another of the same length. Halves are split as
    strings, so leading zeros count and no number exceeds 10 digits."""
    n = F.length(digits)
    left, right = F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int")
    start = F.struct(F.left(digits, left).cast("long").alias("l"), F.right(digits, right).cast("long").alias("r"))
    a, b = F.pow(F.lit(10), left).cast("long"), F.pow(F.lit(10), right).cast("long")

    def step(s: Column, r: Column) -> Column:
        even = F.struct(F.pmod(s.l + _round(key, kind, n, r, s.r, a), a).alias("l"), s.r.alias("r"))
        odd = F.struct(s.l.alias("l"), F.pmod(s.r + _round(key, kind, n, r, s.l, b), b).alias("r"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step,
        lambda s: F.concat(F.lpad(s.l.cast("string"), left, "0"), F.lpad(s.r.cast("string"), right, "0")),
    )


def permute_symbols(symbols: Column, alphabet: str, key: str, kind: str) -> Column:
    """A string over ``alphabet`` to another of its length: a Feistel network on its halves, whose
    round function adds a keyed symbol to each of a half, as many as it has. One symbol is split as
    a number instead, as an empty half would make every round the same shift."""
    n, size = F.length(symbols), len(alphabet)
    cut = F.floor(n / 2).cast("int")
    table = F.lit(alphabet)

    def added(part: Column, other: Column, r: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.length(part) - 1) / 16).cast("int"))
        stream = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws(
            ":", F.lit(key), F.lit(kind), n.cast("string"), r.cast("string"), b.cast("string"), other), 256)), "")

        def one(stream: Column) -> Column:
            def symbol(j: Column) -> Column:
                more = F.conv(F.substring(stream, 4 * j + 1, F.lit(4)), 16, 10).cast("int")
                at = F.pmod((F.position(F.substring(part, j + 1, F.lit(1)), table) - 1) + more, F.lit(size))
                return F.substring(table, at + 1, F.lit(1))

            return F.array_join(F.transform(F.sequence(F.lit(0), F.length(part) - 1), symbol), "")

        return _let(stream, one)

    def step(s: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(added(s.l, s.r, r).alias("l"), s.r.alias("r"))).otherwise(
            F.struct(s.l.alias("l"), added(s.r, s.l, r).alias("r")))

    halves = F.struct(F.left(symbols, cut).alias("l"), F.right(symbols, n - cut).alias("r"))
    many = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, step, lambda s: F.concat(s.l, s.r))
    side = math.isqrt(size - 1) + 1
    single = F.substring(table, _permute_number((F.position(symbols, table) - 1).cast("long"), side, side, size, key, kind).cast("int") + 1, F.lit(1))
    return F.when(n == 0, symbols).when(n == 1, single).otherwise(many)


def _permute_number(value: Column, a: int, b: int, size: int, key: str, kind: str) -> Column:
    """Permute 0 <= value < size <= a*b, walking the cycle until the value is inside."""

    def once(v: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
            F.struct(F.floor(v / b).cast("long").alias("l"), F.pmod(v, F.lit(b)).cast("long").alias("r")),
            lambda s, r: F.when(
                r % 2 == 0,
                F.struct(F.pmod(s.l + _round(key, kind, F.lit(a), r, s.r, F.lit(a)), F.lit(a)).alias("l"), s.r.alias("r")),
            ).otherwise(
                F.struct(s.l.alias("l"), F.pmod(s.r + _round(key, kind, F.lit(b), r, s.l, F.lit(b)), F.lit(b)).alias("r"))
            ),
            lambda s: s.l * b + s.r,
        )

    if size == a * b:
        return once(value)
    # A cycle leaves the range again and again only with chance (1 - size/(a*b)) each time;
    # 64 steps make that chance nil for the ranges used here (over 90 % inside).
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(64)), F.struct(value.cast("long").alias("v"), F.lit(False).alias("done")),
        lambda s, _: F.when(s.done, s).otherwise(
            _let(once(s.v), lambda x: F.struct(x.alias("v"), (x < size).alias("done")))),
        lambda s: s.v,
    )


def _fill(layout: Column, places: str, symbols: Column) -> Column:
    """Put ``symbols`` in the places of ``layout`` that match the pattern, one after another."""
    return F.aggregate(
        F.split(layout, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda s, c: F.when(
            c.rlike(f"^{places}$"),
            F.struct(F.concat(s.out, F.substring(symbols, s.k, F.lit(1))).alias("out"), (s.k + 1).alias("k")),
        ).otherwise(F.struct(F.concat(s.out, c).alias("out"), s.k.alias("k"))),
        lambda s: s.out,
    )


def _relay(layout: Column, digits: Column) -> Column:
    """Put ``digits`` into the digit places of ``layout``."""
    return _fill(layout, "[0-9]", digits)


def _luhn_check(payload: Column) -> Column:
    """The check digit of a digit string."""
    n = F.length(payload)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda s, i: s + _let(
            F.substring(payload, n - i + 1, F.lit(1)).cast("int"),
            lambda d: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)),
    )
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, _DIGIT, "")


def _is_card(v: Column) -> Column:
    def body(d: Column) -> Column:
        n = F.length(d)
        return n.between(13, 19) & (_luhn_check(F.left(d, n - 1)) == F.right(d, F.lit(1)))

    return _let(_digits(v), body)


def card_parts(run: Column) -> Column:
    """A run of digits as text, value, text, ...: the cards in it, or the whole run as one value."""

    def split(part: Column, n: Column) -> Column:
        # Every part of n digits from group to group, of groups of three digits or more.
        window = F.concat(F.lit(r"(?<!\d)(?=(\d(?:(?:(?<=\d{3})[ \-](?=\d{3}))?\d){"), (n - 1).cast("string"), F.lit(r"})(?!\d))"))
        cards = F.filter(F.regexp_extract_all(part, window, F.lit(1)), _is_card)

        def cut(cards: Column) -> Column:
            any_card = F.concat(F.lit(r"(?<!\d)(?:"), F.array_join(F.array_distinct(cards), "|"), F.lit(r")(?!\d)"))
            return F.when(F.size(cards) == 0, F.array(part)).otherwise(
                _alternate(F.split(part, any_card, -1), F.regexp_extract_all(part, any_card, F.lit(0))))

        return _let(cards, cut)

    def step(parts: Column, n: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p, i: F.when((i % 2 == 1) | (F.length(p) < n), F.array(p)).otherwise(split(p, n))))

    whole = F.array(F.lit(""), run, F.lit(""))
    pieces = F.aggregate(F.sequence(F.lit(19), F.lit(13), F.lit(-1)), F.array(run), step)
    return F.when(_is_card(run) | ~run.rlike("[ -]"), whole).otherwise(_let(pieces, lambda p: F.when(F.size(p) == 1, whole).otherwise(p)))


def _alternate(between: Column, values: Column) -> Column:
    """between[0], values[0], between[1], ..."""
    return F.flatten(F.zip_with(between, values, lambda b, v: F.when(v.isNull(), F.array(b)).otherwise(F.array(b, v))))


def pseudonym_card(v: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        payload = F.left(d, F.length(d) - 1)
        return _relay(v, _let(permute_digits(payload, key, "card"), lambda p: F.concat(p, _luhn_check(p))))

    return F.when(_is_card(v), _let(_digits(v), body)).otherwise(v)


def pseudonym_date(v: Column, key: str) -> Column:
    layouts = ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d\d\.", "dd.MM.yyyy"), (r"^\d\d/", "MM/dd/yyyy"))
    first, size = F.lit("1900-01-01").cast("date"), 73_049  # days of 1900..2099
    out = v
    for pattern, fmt in layouts:
        day = F.try_to_timestamp(v, F.lit(fmt)).cast("date")
        moved = _permute_number(F.datediff(day, first).cast("long"), 271, 270, size, key, "date")
        out = F.when(v.rlike(pattern), F.when(day.isNull(), v).otherwise(
            F.date_format(F.date_add(first, moved.cast("int")), fmt))).otherwise(out)
    return out


def pseudonym_named_date(v: Column, key: str) -> Column:
    table = F.array(*[F.lit(m) for m in MONTHS])
    name = F.regexp_extract(v, _MONTH, 0)
    year, day = F.regexp_extract(v, r"(?:19|20)\d\d$", 0), F.regexp_extract(v, r"(?<!\d)\d{1,2}(?!\d)", 0)

    def body(at: Column) -> Column:  # place of the month's name
        date = F.try_to_timestamp(F.concat_ws("-", year, (F.pmod(at - 1, F.lit(12)) + 1).cast("string"), day), F.lit("yyyy-M-d")).cast("date")
        first, size = F.lit("1900-01-01").cast("date"), 73_049
        moved = F.date_add(first, _permute_number(F.datediff(date, first).cast("long"), 271, 270, size, key, "date").cast("int"))

        def write(d: Column) -> Column:
            month = F.element_at(table, (F.floor((at - 1) / 12) * 12 + F.month(d)).cast("int"))
            out = F.regexp_replace(F.regexp_replace(v, r"(?:19|20)\d\d$", "\x00"), r"(?<!\d)\d{1,2}(?!\d)", "\x01")
            out = F.replace(F.replace(out, name, month), F.lit("\x01"), F.dayofmonth(d).cast("string"))
            return F.replace(out, F.lit("\x00"), F.year(d).cast("string"))

        return F.when(date.isNull(), v).otherwise(_let(moved, write))

    return _let(F.array_position(table, name), body)


def pseudonym_ipv6(v: Column, key: str) -> Column:
    """All eight groups of the pseudonym, without leading zeros."""
    sides = F.split(F.lower(v), "::")
    left, right = (F.array_remove(F.split(F.coalesce(F.get(sides, i), F.lit("")), ":"), "") for i in (0, 1))
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right)
    digits = F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), "")
    return _let(permute_symbols(digits, "0123456789abcdef", key, "ipv6"), lambda d: F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(d, 4 * i + 1, F.lit(4)), "^0{1,3}", "")), ":"))


def _mod97(code: Column) -> Column:
    """What the letters and digits of an account number leave modulo 97, the first four last."""
    turned = F.concat(F.substring(code, 5, 99), F.left(code, F.lit(4)))
    number = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(
        F.pmod(s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c), F.lit(97))))


def pseudonym_iban(v: Column, key: str) -> Column:
    def body(code: Column) -> Column:
        rest = F.substring(code, 5, 99)
        digits = permute_symbols(F.regexp_replace(rest, "[^0-9]", ""), "0123456789", key, "iban")
        letters = permute_symbols(F.regexp_replace(rest, "[^A-Z]", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", key, "iban")
        mixed = _let(F.struct(digits.alias("d"), letters.alias("l")), lambda x: _fill(_fill(rest, "[0-9]", x.d), "[A-Z]", x.l))

        def checked(rest: Column) -> Column:
            zero = F.concat(F.left(code, F.lit(2)), F.lit("00"), rest)
            check = F.lpad((98 - _mod97(zero)).cast("string"), 2, "0")
            return _fill(v, "[A-Z0-9]", F.concat(F.left(code, F.lit(2)), check, rest))

        return F.when(_mod97(code) == 1, _let(mixed, checked)).otherwise(v)

    return _let(F.replace(v, F.lit(" "), F.lit("")), body)


def pseudonym_ip(v: Column, key: str) -> Column:
    def body(p: Column) -> Column:
        number = sum((F.element_at(p, i + 1).cast("long") * 256 ** (3 - i) for i in range(1, 4)), F.element_at(p, 1).cast("long") * 256**3)
        return _let(
            _permute_number(number, 65536, 65536, 65536 * 65536, key, "ip"),
            lambda x: F.concat_ws(".", *[F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]),
        )

    return _let(F.split(v, r"\."), body)


def pseudonym_phone(v: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        country = F.when(v.startswith("+"), F.regexp_extract(d, COUNTRY, 0)).otherwise("")
        return _relay(v, F.concat(country, permute_digits(F.substring(d, F.length(country) + 1, F.length(d)), key, "phone")))

    return _let(_digits(v), body)


def pseudonym_ssn(v: Column, key: str) -> Column:
    return _relay(v, permute_digits(_digits(v), key, "ssn"))


def pseudonym_email(v: Column, key: str) -> Column:
    """Letters and digits of the local part go through one Feistel over the alphabet of both;
    separators and letters outside a-z0-9 keep their places, case is dropped."""
    local, domain = F.lower(F.regexp_extract(v, r"^([^@]*)@", 1)), F.regexp_extract(v, r"@.*$", 0)
    symbols = F.regexp_replace(local, r"[^a-z0-9]", "")
    return F.concat(_let(permute_symbols(symbols, "abcdefghijklmnopqrstuvwxyz0123456789", key, "email"), lambda x: _fill(local, "[a-z0-9]", x)), domain)


def kind_of(v: Column) -> Column:
    whole = lambda p: v.rlike(f"^(?:{p})$")
    return (
        F.when(v.contains("@"), "email").when(whole(IBAN), "iban").when(whole(IPV6), "ipv6").when(whole(IP), "ip")
        .when(whole(DATE), "date").when(v.rlike(_MONTH), "named_date").when(whole(SSN) | v.rlike(r"^\d{9}$"), "ssn")
        .when(v.startswith("+") | whole(NATIONAL), "phone").otherwise("card")
    )


def pseudonym(v: Column, key: str) -> Column:
    def body(kind: Column) -> Column:
        return (
            F.when(kind == "email", pseudonym_email(v, key)).when(kind == "iban", pseudonym_iban(v, key))
            .when(kind == "ipv6", pseudonym_ipv6(v, key)).when(kind == "ip", pseudonym_ip(v, key))
            .when(kind == "date", pseudonym_date(v, key)).when(kind == "named_date", pseudonym_named_date(v, key))
            .when(kind == "ssn", pseudonym_ssn(v, key)).when(kind == "phone", pseudonym_phone(v, key)).otherwise(pseudonym_card(v, key))
        )

    return _let(kind_of(v), body)


def find(text: Column) -> Column:
    """All candidate values of a text, in order; an empty array where no hint of one. A run of
    digits is one, whether or not cards are found in it."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0)))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "_found", given_col: str = "_given") -> DataFrame:
    """``docs`` with PII replaced, and columns ``found_col`` and ``given_col`` (values before and
    after, in text order; columns of these names are replaced). No shuffle; each text is split
    once at its values."""
    was, now = common.fresh([*docs.columns, found_col, given_col], "_was", "_is")
    found = F.coalesce(find(F.col(text_col)), F.array().cast("array<string>"))
    docs = docs.withColumn(was, F.transform(found, lambda v: F.when(kind_of(v) == "card", card_parts(v)).otherwise(F.array(F.lit(""), v, F.lit("")))))
    docs = docs.withColumn(now, F.transform(was, lambda p: F.transform(p, lambda x, i: F.when(i % 2 == 1, pseudonym(x, key)).otherwise(x))))

    def values(parts: str) -> Column:
        return F.flatten(F.transform(parts, lambda p: F.filter(p, lambda x, i: i % 2 == 1)))

    docs = docs.withColumns({found_col: values(was), given_col: values(now)})
    between = F.split(F.col(text_col), f"(?:{ANY})", -1)
    whole = F.array_join(F.zip_with(between, now, lambda a, b: F.concat(a, F.coalesce(F.array_join(b, ""), F.lit("")))), "")
    return docs.withColumn(text_col, F.when(F.size(found_col) == 0, F.col(text_col)).otherwise(whole)).drop(was, now)


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_CONF, None) or secrets.token_hex(32)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymize(docs, session_key(spark))
    changed = F.filter(F.arrays_zip("_found", "_given"), lambda p: p["_found"] != p["_given"])
    return out.select(
        "doc_id", "text", F.size("_found").cast("long").alias("n_found"), F.size(changed).cast("long").alias("n_replaced"),
        F.array_join(F.transform(changed, lambda p: kind_of(p["_found"])), ",").alias("kinds"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts go on with pseudonyms; n_chars follows the new text."""
    names = docs.columns
    found, given = common.fresh(names, "_found", "_given")
    out = pseudonymize(docs, session_key(spark), found_col=found, given_col=given)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in names])
