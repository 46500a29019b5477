"""Column functions on amounts, dates, labels and names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
# Categories of bank descriptions, the first that matches.
CATEGORIES = [
    (r"\b(payroll|salary|wages|direct dep)", "payroll"),
    (r"\b(transfer|xfer|to acct|from acct)", "transfer"),
    (r"\b(fee|charge|service chg)", "fee"),
    (r"\batm\b", "atm"),
    (r"\b(pos|debit card|visa|mastercard|amex|purchase)", "card"),
    (r"\bcheck\s*#?\d", "check"),
    (r"\b(deposit|credit)", "deposit"),
    (r"\b(interest)", "interest"),
]


def chosen(cases: list[tuple[Column, object]], other: object) -> Column:
    """The value of the first case that holds."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), other if isinstance(other, Column) else F.lit(other))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def amount(raw: Column, european: bool = False) -> Column:
    """Money as a number: brackets, a leading minus or DR are negative, CR is positive, the last separator is the decimal one."""

    def valued(bare: Column) -> Column:
        bracketed = bare.rlike(r"^\(.*\)$")
        inner = F.when(bracketed, F.regexp_replace(bare, r"^\(|\)$", "")).otherwise(bare)
        return bound(inner, lambda inner: signed(inner, bracketed))

    def signed(inner: Column, bracketed: Column) -> Column:
        debit, credit = inner.rlike(r"(?i)\b(DR|debit)\b"), inner.rlike(r"(?i)\b(CR|credit)\b")
        plain = F.trim(F.regexp_replace(inner, r"(?i)\b(DR|CR|debit|credit)\b", ""))
        return bound(plain, lambda plain: bound(number(plain), lambda value: F.when(plain.startswith("-") | (~credit & (bracketed | debit)), -F.abs(value)).otherwise(value)))

    def number(plain: Column) -> Column:
        return bound(F.regexp_replace(F.regexp_replace(plain, "^-", ""), r"[^\d,.\-]", ""), lambda signs: bound(pointed(signs), lambda n: F.when(n.rlike(r"\d"), n.try_cast("double"))))

    def pointed(signs: Column) -> Column:
        from_end = lambda sign: F.instr(F.reverse(signs), sign)  # noqa: E731  0: absent
        last = (from_end(",") > 0) & ((from_end(".") == 0) | (from_end(",") < from_end(".")))
        comma = F.lit(True) if european else last
        return F.when(comma, F.regexp_replace(F.regexp_replace(signs, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(signs, ",", ""))

    if european:
        return bound(F.trim(F.regexp_replace(F.trim(raw), r"[$€£¥]", "")), valued)
    usual = lambda t: t.rlike(r"^\$?(?:[0-9]+|[0-9,]*[0-9]\.[0-9]+)$")  # noqa: E731  digits and a point, as most amounts are: nothing to look for
    return bound(F.trim(raw), lambda t: F.when(usual(t), F.translate(t, "$,", "").try_cast("double")).otherwise(bound(F.trim(F.regexp_replace(t, r"[$€£¥]", "")), valued)))


def padded(n: Column, width: int) -> Column:
    """Zeros in front up to ``width``; longer numbers stay whole."""
    text = n.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def bates(n: Column, prefix: str = "", suffix: str = "", digits: int = 6) -> Column:
    return F.concat(F.lit(prefix), padded(n, digits), F.lit(suffix))


def letters(index: Column) -> Column:
    """0 to A, 25 to Z, 26 to AA, up to three letters."""
    letter = lambda k: F.char(F.lit(65) + k)
    two, three = index - 26, index - 702
    return chosen(
        [(index < 26, letter(index)), (index < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))],
        F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)),
    )


def roman(n: Column) -> Column:
    """Small Roman numerals below 4000, digit by digit."""
    digit = lambda k, one, five, ten: F.element_at(F.array(*map(F.lit, ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten])), (F.floor(n / k) % 10 + 1).cast("int"))
    return F.concat(digit(1000, "m", "", ""), digit(100, "c", "d", "m"), digit(10, "x", "l", "c"), digit(1, "i", "v", "x"))


def iso_date(raw: Column, european: bool, ref_year: int) -> Column:
    """YYYY-MM-DD or null, from ISO, numeric and month-name forms; a missing year is ``ref_year``."""
    full = lambda y: F.when(y >= 1000, y).when(y >= 70, y + 1900).otherwise(y + 2000)
    year = lambda y: F.when(F.length(F.coalesce(y, F.lit(""))) == 0, F.lit(ref_year)).otherwise(bound(y.try_cast("int"), full))
    month = lambda name: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))).cast("int")

    def built(y: Column, m: Column, d: Column) -> Column:
        good = m.between(1, 12) & d.between(1, 31)
        return F.when(good, F.concat(y.cast("string"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0")))

    iso, numeric = r"\b(\d{4})[-\/](\d{1,2})[-\/](\d{1,2})\b", r"\b(\d{1,2})[\/\-.](\d{1,2})[\/\-.](\d{2,4})\b"
    named = r"\b([A-Za-z]{3,9})\.?[\s\-\/.]+(\d{1,2})(?:[,\s\-\/.]+(\d{2,4}))?\b"
    day_first = r"\b(\d{1,2})[\s\-\/.]+([A-Za-z]{3,9})\.?(?:[,\s\-\/.]+(\d{2,4}))?\b"
    part = lambda parts, i: F.get(parts, F.lit(i))
    whole = lambda parts, i: part(parts, i).try_cast("int")

    def by_numbers(parts: Column) -> Column:
        a, b = (whole(parts, 1), whole(parts, 0)) if european else (whole(parts, 0), whole(parts, 1))
        swap = (a > 12) & (b <= 12)
        return built(year(part(parts, 2)), F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b))

    def by_signs(text: Column, pattern: str, use: Callable[[Column], Column], other: Callable[[Column], Column]) -> Column:
        """``use`` of the numbers of the first match, which single signs divide; ``other`` of the text where there is none."""
        return bound(F.regexp_extract(text, pattern, 0), lambda m: F.when(m != "", bound(F.split(F.translate(m, "/.", "--"), "-"), use)).otherwise(other(text)))

    def by_name(text: Column, pattern: str, name: int, day: int, other: Callable[[Column], Column]) -> Column:
        """The date of the first match, with a month's name and a day at these places; ``other`` of the text where the name is no month's."""
        dated = lambda p: F.when(month(part(p, name)) > 0, built(year(part(p, 2)), month(part(p, name)), whole(p, day))).otherwise(other(text))
        return bound(F.split(F.regexp_extract(text, pattern, 0), r"[,\s\-\/.]+"), dated)

    of_names = lambda t: by_name(t, named, 0, 1, lambda t: by_name(t, day_first, 1, 0, lambda _: F.lit(None).cast("string")))
    of_numbers = lambda t: by_signs(t, numeric, by_numbers, of_names)
    return bound(raw, lambda t: F.when(t.rlike(r"\d"), by_signs(t, iso, lambda p: built(whole(p, 0), whole(p, 1), whole(p, 2)), of_numbers)))


def masked(category: Column, text: Column, dot: str = "•") -> Column:
    """A value of personal data as it may be shown; names, dates and short addresses stay as they are."""
    at = F.instr(text, "@")
    address = F.concat(F.substring(text, 1, 1), F.repeat(F.lit(dot), F.greatest(F.lit(1), at - 2)), F.substring(text, at, F.length(text)))
    account = F.concat(F.substring(text, 1, 4), F.repeat(F.lit(dot), F.greatest(F.lit(0), F.length(text) - 8)), F.substring(text, F.greatest(F.lit(1), F.length(text) - 3), F.lit(4)))
    return chosen(
        [
            (category.isin("ssn", "phone"), F.regexp_replace(text, r"\d(?=\d{4})", dot)), (category == "creditCard", F.regexp_replace(text, r"\d(?=.*\d{4})", dot)),
            (category == "email", F.when(at <= 2, text).otherwise(address)), (category == "iban", account),
        ],
        text,
    )
