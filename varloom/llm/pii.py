"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Found are e-mail addresses, telephone numbers, IPv4 addresses, payment cards
(13 to 19 digits in one run or in the usual groups, Luhn), IBANs (in one run or in
groups of four, mod 97), social security numbers (of any digits), 40-digit hexadecimal
secrets and dates (year first, day first or, where that is no date, month first).  Of
groups the marks between them stay, and the number is the same as without.  A value that fails its check (Luhn, mod 97, octets
up to 255, a real date) is no personal data and stays.  Each value is permuted
among the values of its format: letters stay letters, digits digits, punctuation
and length stay, check digits are computed anew, dates stay dates.  The permutation
depends on the key alone, so equal values get equal pseudonyms in all documents,
and different values of one format never meet.

All of it is built-in expressions; there is no shuffle.  A null text stays null and
an empty one empty; rows are independent, so ties, repeated rows and other columns
have no influence (a column that bears the name of the counter is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Letters of Western languages beyond a-z; each has its capital at the same place.
LATIN_LOWER = "".join(chr(c) for c in range(0xE0, 0xFF) if c != 0xF7)
LATIN_UPPER = LATIN_LOWER.upper()
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

#: Dates are permuted within 400 Gregorian years, which have 146097 = 189 * 773 days.
FIRST_DAY, DAY_FACTORS = "1800-01-01", (189, 773)

_FREE = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,24}"
IPV4 = r"(?<![\p{L}\p{N}.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])"
SECRET = _FREE + r"[0-9A-Fa-f]{40}" + _END
IBAN = _FREE + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:[ -][A-Z0-9]{4}){2,7}(?:[ -][A-Z0-9]{1,3})?)" + _END
DATE = _FREE + r"(?:[0-9]{4}[-./][0-9]{2}[-./][0-9]{2}|[0-9]{2}[-./][0-9]{2}[-./][0-9]{4})" + _END
SSN = _FREE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END
PHONE = (
    r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}" + _END
    + "|" + _FREE + r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _END
)
CARD = _FREE + r"(?:[0-9]{4}([ -])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{6}\1[0-9]{4,5})|[0-9]{13,19})" + _END
#: In this order, as the first alternative that fits wins.
PRIVATE = "|".join((EMAIL, IPV4, SECRET, IBAN, DATE, SSN, CARD, PHONE))


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _turned(char: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """A character moved on within its alphabet; others stay."""
    out = char
    for letters in alphabets:
        at = F.instr(F.lit(letters), char)
        out = F.when((at > 0) & (char != ""), F.substring(F.lit(letters), (at - 1 + by) % len(letters) + 1, F.lit(1))).otherwise(out)
    return out


def permuted(value: Column, key: str, tweak: str | Column, alphabets: tuple[str, ...]) -> Column:
    """Feistel permutation of strings: each half is turned, place by place, by a keyed digest of the other.

    A place keeps its alphabet, so length and format stay; each round can be undone.
    """
    half = F.floor(F.length(value) / 2).cast("int")
    label = tweak if isinstance(tweak, Column) else F.lit(tweak)

    def turn(state: Column, nth: Column) -> Column:
        pad = F.sha2(F.concat_ws("\x1f", F.lit(key), label, nth.cast("string"), state["r"]).cast("binary"), 512)
        chars = F.split(state["l"], "")
        moved = F.transform(
            chars,
            lambda c, i: _turned(
                c, F.conv(F.substring(pad, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int"), alphabets
            ),
        )
        return F.struct(state["r"].alias("l"), F.array_join(moved, "").alias("r"))

    start = F.struct(
        F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r")
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"])
    )


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _luhn_digit(body: Column) -> Column:
    digits = F.array(*[F.lit(d) for d in DIGITS])
    return F.filter(digits, lambda d: luhn(F.concat(body, d)))[0]


def _refilled(template: Column, new: Column) -> Column:
    """``template`` with all but its spaces and hyphens replaced in order by ``new``."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        mark = c.isin(" ", "-")
        return F.struct(
            F.concat(s["out"], F.when(mark, c).otherwise(F.substring(new, s["at"], F.lit(1)))).alias("out"),
            (s["at"] + F.when(mark, 0).otherwise(1)).alias("at"),
        )

    return F.aggregate(F.split(template, ""), state, put, lambda s: s["out"])


def card_pseudonym(value: Column, key: str) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    body = permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", (DIGITS,))
    return F.when(luhn(digits), _refilled(value, F.concat(body, _luhn_digit(body)))).otherwise(value)


def _mod97(text: Column) -> Column:
    spelt = F.transform(F.split(text, ""), lambda c: (F.instr(F.lit(DIGITS + UPPER), c) - 1).cast("string"))
    return F.aggregate(F.split(F.array_join(spelt, ""), ""), F.lit(0), lambda acc, d: (acc * 10 + d.cast("int")) % 97)


def iban_pseudonym(value: Column, key: str) -> Column:
    plain = F.regexp_replace(value, "[ -]", "")
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    valid = _mod97(F.concat(body, F.substring(plain, 1, 4))) == 1
    new = permuted(body, key, F.concat(F.lit("iban"), country), (DIGITS, UPPER))
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, _refilled(value, F.concat(country, check, new))).otherwise(value)


def ip_pseudonym(value: Column, key: str) -> Column:
    octets = F.split(value, r"\.")
    valid = F.forall(octets, lambda o: o.cast("int") <= 255)
    spelt = F.array_join(F.transform(octets, lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0")), "")
    new = permuted(spelt, key, "ip", (HEX,))
    dotted = F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(new, i * 2 + 1, F.lit(2)), 16, 10)), "."
    )
    return F.when(valid, dotted).otherwise(value)


def date_pseudonym(value: Column, key: str) -> Column:
    parts = F.split(value, "[-./]")
    year_first = F.length(parts[0]) == 4

    def read(y: int, m: int, d: int) -> Column:
        return F.try_to_timestamp(F.concat_ws("-", parts[y], parts[m], parts[d]), F.lit("yyyy-MM-dd")).cast("date")

    day_first = F.when(~year_first, read(2, 1, 0))
    day = F.when(year_first, read(0, 1, 2)).otherwise(F.coalesce(day_first, read(2, 0, 1)))
    a, b = DAY_FACTORS
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    inside = day.isNotNull() & number.between(0, a * b - 1)

    def drawn(nth: Column, other: Column) -> Column:
        text = F.concat_ws("\x1f", F.lit(key), F.lit("date"), nth.cast("string"), other.cast("string"))
        return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 12), 16, 10).cast("bigint")

    def turn(s: Column, nth: Column) -> Column:
        odd = nth % 2 == 1
        return F.struct(
            F.when(odd, (s["l"] + drawn(nth, s["r"])) % a).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise((s["r"] + drawn(nth, s["l"])) % b).alias("r"),
        )

    start = F.struct((number / b).cast("bigint").alias("l"), (number % b).cast("bigint").alias("r"))
    new = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn,
        lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * b + s["r"]).cast("int")),
    )
    y, m, d = (F.date_format(new, x) for x in ("yyyy", "MM", "dd"))
    spelt = F.when(year_first, F.concat(y, F.substring(value, 5, 1), m, F.substring(value, 8, 1), d)).otherwise(
        F.concat(
            F.when(day_first.isNotNull(), d).otherwise(m), F.substring(value, 3, 1),
            F.when(day_first.isNotNull(), m).otherwise(d), F.substring(value, 6, 1), y,
        )
    )
    return F.when(inside, spelt).otherwise(value)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; what fails the check of its kind stays."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    letters = (DIGITS, LOWER, UPPER, LATIN_LOWER, LATIN_UPPER)
    return (
        F.when(value.contains("@"), F.concat(permuted(local, key, F.lower(domain), letters), F.lit("@"), domain))
        .when(value.rlike(_whole(IPV4)), ip_pseudonym(value, key))
        .when(value.rlike(_whole(SECRET)), permuted(value, key, "secret", (DIGITS, "abcdef", "ABCDEF")))
        .when(value.rlike(_whole(IBAN)), iban_pseudonym(value, key))
        .when(value.rlike(_whole(DATE)), date_pseudonym(value, key))
        .when(value.rlike(_whole(SSN)), permuted(value, key, "ssn", (DIGITS,)))
        .when(value.rlike(_whole(CARD)), card_pseudonym(value, key))
        .otherwise(
            F.concat(country, permuted(F.substring(value, F.length(country) + 1, F.length(value)), key, "phone", (DIGITS,)))
        )
    )


def pseudonymised(docs: DataFrame, key: str, text: str = "text", changed: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``changed`` names a column for the number of replaced values."""
    column = F.col(f"`{text}`")
    found = F.regexp_extract_all(column, F.lit(PRIVATE), 0)
    new = F.transform(found, lambda v: pseudonym(v, key))
    # most texts hold neither a digit nor an @
    possible = column.rlike("[0-9@]")
    pieces = F.split(column, PRIVATE, -1)
    both = F.when(possible, F.struct(found.alias("old"), new.alias("new"), pieces.alias("pieces")))
    names = [c for c in docs.columns if c != changed]
    marked = docs.select(*[F.col(f"`{c}`") for c in names], both.alias("__found"))
    joined = F.array_join(
        F.transform(
            F.col("__found.pieces"), lambda p, i: F.concat(p, F.coalesce(F.get(F.col("__found.new"), i), F.lit("")))
        ),
        "",
    )
    out = [
        F.when(F.col("__found").isNull(), column).otherwise(joined).alias(text) if c == text else F.col(f"`{c}`")
        for c in names
    ]
    if changed:
        differ = F.zip_with("__found.old", "__found.new", lambda a, b: a != b)
        out.append(F.coalesce(F.size(F.filter(differ, lambda x: x)), F.lit(0)).cast("bigint").alias(changed))
    return marked.select(*out)
