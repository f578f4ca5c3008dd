"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions.

Values are found by one pattern, validated by kind, and read as a list of limbs: digits, letters or small
numbers, each below its own modulus. A keyed Feistel network runs over the limbs: in each round one
half is shifted, limb by limb, by SHA-256 of (key, kind, round, place, other half), modulo
the limb. Every step can be undone, so the mapping is a permutation of the values of
a format: equal values get equal pseudonyms in every document, different ones different
pseudonyms, and no table of values is kept.

Kinds: payment card numbers (13 to 19 digits, Luhn; the check digit is made anew), US phone numbers (area and
exchange stay 2 to 9, or 0 and 1, at the front; 0 and 1 only where parentheses, +1, or equal dashes or dots mark the number), social security numbers (valid areas, groups and serials), IPv4
addresses (first octet stays 1 to 223), dates (YYYY-MM-DD that exist from 1900 to 2099), IBANs (mod 97; check
digits made anew), e-mail names, and secrets (access key ids, long hexadecimal
strings of one case). Numbers that fail the validation of every kind stay as they are.

Defined cases: a null text stays null, an empty one empty. A text without a value is returned as it is. A pseudonym may by
chance equal its value. Rows are handled one by one: repeated rows, null ids and extra columns
(also of clashing names) pass through. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
HEX_DIGITS = "0123456789abcdef"

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
# Parentheses, +1 and equal dashes or dots mark a number whatever its digits; other groups begin with 2 to 9.
MARKED = r"(?:\+?1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|\+1[ .-]?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
PLAIN = r"(?:1[ .-]?)?[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}"
ALIKE = r"(?<![0-9][.-])(?:1[.-])?(?:[0-9]{3}-[0-9]{3}-|[0-9]{3}\.[0-9]{3}\.)[0-9]{4}(?![.-][0-9])"
PHONE = rf"(?:{MARKED}|{PLAIN}|{ALIKE})(?![0-9])"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
KEY = r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
HEX = r"(?:(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,}|(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{16,})(?![A-Za-z0-9])"
# A value begins where no letter, digit or sign of a longer one stands before it.
VALUE = rf"(?<![A-Za-z0-9._%+@-]){EMAIL}|(?<![0-9.]){IPV4}|(?<![A-Za-z0-9]){KEY}|(?<![A-Za-z0-9]){IBAN}|(?<![A-Za-z0-9]){HEX}|(?<![0-9-])(?:{DATE}|{SSN})|(?<![A-Za-z0-9]){PHONE}|(?<![0-9]){CARD}"

#: Days from 1900-01-01 on; 73,048 = 184 x 397, so dates are two limbs.
DAYS = (184, 397)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _feistel(limbs: Column, moduli: Column, kind: str, key: str) -> Column:
    """Permute ``limbs`` (array<bigint>, each below its modulus); a lone limb is shifted by key and kind."""

    def run(x: Column) -> Column:
        half = F.ceil(F.size(x["limb"]) / 2).cast("int")

        def one_round(state: Column, r: Column) -> Column:
            first = r % 2 == 0
            rest = F.when(first, F.slice(state, half + 1, F.size(state) - half)).otherwise(F.slice(state, F.lit(1), half))

            def shifted(other: Column) -> Column:
                def one(limb: Column, i: Column) -> Column:
                    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), i.cast("string"), other), 256)
                    drawn = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
                    return F.when((i < half) == first, (limb + drawn) % F.get(x["modulus"], i)).otherwise(limb)

                return F.transform(state, one)

            return _let(F.array_join(rest.cast("array<string>"), ","), shifted)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x["limb"], one_round)

    return _let(F.struct(limbs.cast("array<bigint>").alias("limb"), moduli.cast("array<bigint>").alias("modulus")), run)


def _characters(value: Column, kind: str, key: str, fixed: Column | None = None, from_two: Column | None = None) -> Column:
    """Permute digits and letters (A to Z) within their class; other characters stay, as do the places in ``fixed``.

    Places in ``from_two`` keep digits from 2 to 9 apart from 0 and 1.
    """

    def of(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        free = F.lit(True) if fixed is None else ~F.array_contains(fixed, i)
        as_class = lambda base, n: F.struct(F.lit(base).alias("base"), (code - base).cast("bigint").alias("limb"), F.lit(n).cast("bigint").alias("modulus"))
        classes = F.when(free & code.between(97, 122), as_class(97, 26)).when(free & code.between(65, 90), as_class(65, 26))
        if from_two is not None:
            lead = free & F.array_contains(from_two, i)
            classes = classes.when(lead & (code < 50), as_class(48, 2)).when(lead, as_class(50, 8))
        classes = classes.when(free & code.between(48, 57), as_class(48, 10))
        return classes.otherwise(F.struct(code.alias("base"), F.lit(0).cast("bigint").alias("limb"), F.lit(1).cast("bigint").alias("modulus")))

    def run(x: Column) -> Column:
        # Only what moves takes part, so separators don't change the pseudonym.
        free = F.filter(x, lambda c: c["modulus"] > 1)
        place = lambda i: F.size(F.filter(F.slice(x, F.lit(1), i), lambda c: c["modulus"] > 1))
        text = lambda p: F.array_join(F.transform(x, lambda c, i: F.char(c["base"] + F.when(c["modulus"] > 1, F.get(p, place(i))).otherwise(0))), "")
        return _let(_feistel(F.transform(free, lambda c: c["limb"]), F.transform(free, lambda c: c["modulus"]), kind, key), text)

    return _let(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), of), run)


def _luhn(digits: Column) -> Column:
    """Luhn sum of a text's digits, counted from its end."""
    back = F.filter(F.split(F.reverse(F.regexp_replace(digits, "[^0-9]", "")), ""), lambda c: c != "")
    worth = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x)


def _card(v: Column, key: str) -> Column:
    def checked(body: Column) -> Column:
        return F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))

    body = F.substring(v, F.lit(1), F.length(v) - 1)
    return F.when((_luhn(v) % 10 == 0) & v.rlike("[1-9]"), _let(_characters(body, "card", key, fixed=F.array(F.lit(0))), checked))


def _phone(v: Column, key: str) -> Column:
    def run(x: Column) -> Column:
        area = F.when(x["number"].startswith("("), 1).otherwise(0)
        return F.concat(x["prefix"], _characters(x["number"], "phone", key, from_two=F.array(area, F.length(x["number"]) - 8)))

    number = F.regexp_extract(v, r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$", 0)
    return _let(F.struct(F.substring(v, F.lit(1), F.length(v) - F.length(number)).alias("prefix"), number.alias("number")), run)


def _numbers(v: Column, separator: str) -> Column:
    return F.split(v, separator).cast("array<bigint>")


def _ssn(v: Column, key: str) -> Column:
    def run(x: Column) -> Column:
        a, b, c = F.get(x, F.lit(0)), F.get(x, F.lit(1)), F.get(x, F.lit(2))
        valid = (a > 0) & (a != 666) & (a < 900) & (b > 0) & (c > 0)
        limbs = F.array(F.when(a < 666, a - 1).otherwise(a - 2), b - 1, c - 1)
        two = lambda p, k, n: F.lpad((F.get(p, F.lit(k)) + 1).cast("string"), n, "0")
        text = lambda p: F.concat_ws("-", F.lpad(F.when(F.get(p, F.lit(0)) < 665, F.get(p, F.lit(0)) + 1).otherwise(F.get(p, F.lit(0)) + 2).cast("string"), 3, "0"), two(p, 1, 2), two(p, 2, 4))
        return F.when(valid, _let(_feistel(limbs, F.array(*map(F.lit, (898, 99, 9999))), "ssn", key), text))

    return _let(_numbers(v, "-"), run)


def _ipv4(v: Column, key: str) -> Column:
    def run(x: Column) -> Column:
        valid = F.forall(x, lambda n: n <= 255) & F.get(x, F.lit(0)).between(1, 223)
        limbs = F.transform(x, lambda n, i: F.when(i == 0, n - 1).otherwise(n))
        text = lambda p: F.array_join(F.transform(p, lambda n, i: F.when(i == 0, n + 1).otherwise(n)).cast("array<string>"), ".")
        return F.when(valid, _let(_feistel(limbs, F.array(*map(F.lit, (223, 256, 256, 256))), "ipv4", key), text))

    return _let(_numbers(v, r"\."), run)


def _date(v: Column, key: str) -> Column:
    def run(n: Column) -> Column:
        limbs = F.array(F.floor(n / DAYS[1]).cast("bigint"), (n % DAYS[1]).cast("bigint"))
        text = lambda p: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (F.get(p, F.lit(0)) * DAYS[1] + F.get(p, F.lit(1))).cast("int")), "yyyy-MM-dd")
        return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), _let(_feistel(limbs, F.array(*map(F.lit, DAYS)), "date", key), text))

    return _let(F.datediff(v.try_cast("date"), F.lit("1900-01-01").cast("date")), run)


def _mod97(text: Column) -> Column:
    """An IBAN's number (rearranged by the caller) modulo 97; letters count from 10 on."""
    chars = F.filter(F.split(F.regexp_replace(text, " ", ""), ""), lambda c: c != "")
    step = lambda m, c: F.when(c.rlike("[0-9]"), (m * 10 + F.ascii(c) - 48) % 97).otherwise((m * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step)


def _iban(v: Column, key: str) -> Column:
    def checked(body: Column) -> Column:
        check = 98 - _mod97(F.concat(body, F.substring(v, 1, 2), F.lit("00")))
        return F.concat(F.substring(v, 1, 2), F.lpad(check.cast("string"), 2, "0"), body)

    body = F.substring(v, F.lit(5), F.length(v))
    # What only looks like an IBAN may hold hexadecimal secrets.
    part = lambda x: F.when(x.rlike(f"^{HEX}$"), _hex(x, key)).otherwise(x)
    secrets = F.when(v.rlike(f"(?:^| ){HEX}"), F.array_join(F.transform(F.split(v, " "), part), " "))
    return F.when(_mod97(F.concat(body, F.substring(v, 1, 4))) == 1, _let(_characters(body, "iban", key), checked)).otherwise(secrets)


def _hex(v: Column, key: str) -> Column:
    limbs = F.transform(F.filter(F.split(F.lower(v), ""), lambda c: c != ""), lambda c: (F.instr(F.lit(HEX_DIGITS), c) - 1).cast("bigint"))
    text = lambda p: F.array_join(F.transform(p, lambda n: F.substring(F.lit(HEX_DIGITS), (n + 1).cast("int"), F.lit(1))), "")
    new = _let(_feistel(limbs, F.transform(limbs, lambda _: F.lit(16)), "hex", key), text)
    return F.when(v.rlike("[A-F]"), F.upper(new)).otherwise(new)


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of a found value, or null where no kind accepts it."""
    full = lambda pattern: v.rlike(f"^(?:{pattern})$")
    return (
        F.when(v.contains("@"), F.concat(_characters(F.substring_index(v, "@", 1), "email", key), F.lit("@"), F.substring_index(v, "@", -1)))
        .when(full(IPV4), _ipv4(v, key))
        .when(full(DATE), _date(v, key))
        .when(full(SSN), _ssn(v, key))
        .when(full(KEY), F.concat(F.substring(v, 1, 4), _characters(F.substring(v, F.lit(5), F.length(v)), "key", key)))
        .when(full(IBAN), _iban(v, key))
        .when(full(PHONE), _phone(v, key))
        .when(full(CARD), _card(v, key))
        .when(full(HEX), _hex(v, key))
    )


def pseudonymise(documents: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``documents`` with the values in ``column`` replaced, plus ``n_values`` (bigint, replaces a column of that name)."""
    own = [c for c in documents.columns if c != "n_values"]
    has = F.col(column).rlike("[0-9@]")
    # Columns of their own, so that nothing is computed anew for each value.
    found = documents.select(*[F.col(f"`{c}`") for c in own], F.when(has, F.regexp_extract_all(column, F.lit(VALUE), F.lit(0))).alias("_values"))
    pairs = F.transform("_values", lambda v: F.struct(v.alias("value"), pseudonym(v, key).alias("pseudonym")))
    some = F.size("_values") > 0
    named = found.select("*", F.when(some, pairs).alias("_pairs"), F.when(some, F.split(column, VALUE, -1)).alias("_gaps"))
    tail = F.transform("_pairs", lambda p, i: F.concat(F.coalesce(p["pseudonym"], p["value"]), F.get(F.col("_gaps"), i + 1)))
    text = F.when(F.col("_pairs").isNull(), F.col(column)).otherwise(F.concat(F.get("_gaps", F.lit(0)), F.array_join(tail, "")))
    n = F.coalesce(F.size(F.filter("_pairs", lambda p: p["pseudonym"].isNotNull())), F.lit(0)).cast("bigint")
    return named.select(*[text.alias(c) if c == column else F.col(f"`{c}`") for c in own], n.alias("n_values"))
