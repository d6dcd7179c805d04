"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

A validated number or date is split into two halves, each a number below its
own modulus, and eight alternating rounds add a keyed hash of one half to the
other.  That is a permutation of the format for any pair of moduli: equal
values become equal pseudonyms in every document, different values different
ones, and ``decode`` runs the rounds backwards.

Validation by kind: card numbers (13 to 19 digits, or 4-4-4-4 and 4-6-5 groups)
must pass Luhn's check, and so does the pseudonym; digits that a word such as
"account" announces need no check, and keep their distance from Luhn's digit;
IBANs must pass their check modulo 97 and get new check digits; social security
numbers must have an area, group and serial that are issued, and are permuted
among those; dates must exist (1900 to 2099; 1990-12-31, 12/31/1990 or
31.12.1990); IPv4 addresses have four octets; telephone numbers keep their
country code or trunk 0; in e-mail addresses letters and digits of the local
part are permuted in their places.  Digits that fit no kind stay as they are.
Everything is column expressions: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import let, put_back, replace_spans

ROUNDS = 8
DATE_FROM, DATE_DAYS = "1900-01-01", (4297, 17)  # 4297 * 17 = 73,049 days, to 2099-12-31
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
SSN = r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"
DAY, MONTH, YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d{2}"
#: Date formats by their separator.
DATES = {"-": (f"{YEAR}-{MONTH}-{DAY}", "yyyy-MM-dd"), "/": (f"{MONTH}/{DAY}/{YEAR}", "MM/dd/yyyy"), ".": (rf"{DAY}\.{MONTH}\.{YEAR}", "dd.MM.yyyy")}
DATE = r"(?<![\d/.-])(?:" + "|".join(x for x, _ in DATES.values()) + r")(?![\d/]|[.-]\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: International (compact, or country code, area and groups), with the area in brackets, dashed or dotted, or with a trunk 0.
PHONE = r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\d{1,3}[ .-]\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|0\d{2,4} \d{3,4} \d{4})(?![\w-]|\.\d)"
NUMBER = r"(?<![A-Za-z0-9])(?:\d{13,19}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{6}-\d{5}|\d{4} \d{6} \d{5})(?![A-Za-z0-9])"
ACCOUNT = r"(?<![A-Za-z])(?i:account|acct|a/c|card|konto(?:nummer)?|compte|cuenta)(?i: ?(?:no|nr|number|num))?[.:# ]{1,4}\d(?:[ -]?\d){7,18}(?![A-Za-z0-9])"
KINDS = {"email": EMAIL, "ipv4": IPV4, "date": DATE, "ssn": SSN, "iban": IBAN, "account": ACCOUNT, "phone": PHONE, "number": NUMBER}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every match holds; texts without it are passed over quickly.
HINT = r"[0-9][0-9. ()-]{0,3}[0-9]|@"

# Telephone country codes (E.164) of one and two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Least and most digits of a telephone number.
PHONE_DIGITS = (8, 15)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """Permutes (left, right) with left below a and right below b: struct (l, r).

    Even rounds change the left half by the right one, odd rounds the other way.
    """
    sign = -1 if back else 1

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        half, modulus = F.when(even, s["r"]).otherwise(s["l"]), F.when(even, s["a"]).otherwise(s["b"])
        noise = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), s["t"], r.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")
        new = F.pmod(F.when(even, s["l"]).otherwise(s["r"]) + sign * F.pmod(noise, modulus), modulus)
        return F.struct(F.when(even, new).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(new).alias("r"), s["a"].alias("a"), s["b"].alias("b"), s["t"].alias("t"))

    rounds = F.array(*[F.lit(r) for r in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS))])
    begin = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), a.cast("long").alias("a"), b.cast("long").alias("b"), tweak.alias("t"))
    return F.aggregate(rounds, begin, step)


def _halves(s: Column, base: float) -> Column:
    """Text, length of the left part and of the right part, and both moduli."""
    n = F.length(s)
    u = F.floor(n / 2).cast("int")
    return F.struct(s.alias("s"), u.alias("u"), (n - u).cast("int").alias("v"), F.pow(F.lit(base), u).cast("long").alias("a"), F.pow(F.lit(base), n - u).cast("long").alias("b"))


def permute_digits(digits: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """A string of 2 to 36 digits to another of the same length; 1 digit turns within 10."""
    def run(x: Column) -> Column:
        l, r = F.substr(x["s"], F.lit(1), x["u"]), F.substr(x["s"], x["u"] + 1, x["v"])
        number = lambda y: F.coalesce(y.try_cast("long"), F.lit(0))
        return let(feistel(number(l), number(r), x["a"], x["b"], key, tweak, back), lambda h: F.concat(F.when(x["u"] > 0, F.lpad(h["l"].cast("string"), x["u"], "0")).otherwise(""), F.lpad(h["r"].cast("string"), x["v"], "0")))

    return let(_halves(digits, 10.0), lambda x: F.when(x["v"] > 0, run(x)).otherwise(x["s"]))


def permute_letters(letters: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """Lower-case letters to as many others, in chunks of 20."""
    alphabet, base26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"

    def run(x: Column) -> Column:
        number = lambda y: F.coalesce(F.conv(F.translate(y, alphabet, base26), 26, 10).cast("long"), F.lit(0))
        word = lambda y, k: F.when(k > 0, F.translate(F.lpad(F.lower(F.conv(y.cast("string"), 10, 26)), k, "0"), base26, alphabet)).otherwise("")
        l, r = F.substr(x["s"], F.lit(1), x["u"]), F.substr(x["s"], x["u"] + 1, x["v"])
        return let(feistel(number(l), number(r), x["a"], x["b"], key, tweak, back), lambda h: F.concat(word(h["l"], x["u"]), word(h["r"], x["v"])))

    def chunks(s: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / 20).cast("int"))
        return F.when(F.length(s) > 0, F.array_join(F.transform(numbers, lambda i: let(_halves(F.substr(s, i * 20 + 1, F.lit(20)), 26.0), run)), "")).otherwise(s)

    return let(letters, chunks)


def refill(shape: Column, digits: Column, letters: Column | None = None) -> Column:
    """Puts digits (and letters, in the case found) back into the places of ``shape``."""
    letters = F.lit("") if letters is None else letters
    begin = F.struct(F.lit("").alias("s"), F.lit(1).alias("d"), F.lit(1).alias("a"), digits.alias("digits"), letters.alias("letters"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        is_letter = (F.length(acc["letters"]) > 0) & F.lower(c).between("a", "z")
        letter = F.substr(acc["letters"], acc["a"], F.lit(1))
        put = F.when(is_digit, F.substr(acc["digits"], acc["d"], F.lit(1))).when(is_letter, F.when(c.between("A", "Z"), F.upper(letter)).otherwise(letter)).otherwise(c)
        return F.struct(F.concat(acc["s"], put).alias("s"), (acc["d"] + is_digit.cast("int")).alias("d"), (acc["a"] + is_letter.cast("int")).alias("a"), acc["digits"].alias("digits"), acc["letters"].alias("letters"))

    return F.aggregate(F.split(shape, ""), begin, step)["s"]


def _luhn_sum(digits: Column) -> Column:
    """Sum of Luhn's check with the last digit counted once."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i))


def _number(m: Column, key: str, back: bool) -> Column:
    """Permutes all digits but the last, which keeps its distance from Luhn's check digit."""
    check = lambda payload: F.pmod(10 - _luhn_sum(F.concat(payload, F.lit("0"))) % 10, F.lit(10))

    def run(x: Column) -> Column:
        new = permute_digits(x["p"], key, F.concat_ws(":", F.lit("number"), x["off"].cast("string")), back)
        return let(new, lambda y: F.concat(y, F.pmod(check(y) + x["off"], F.lit(10)).cast("string")))

    digits = F.regexp_replace(m, "[^0-9]", "")
    parts = let(digits, lambda d: F.struct(F.substr(d, F.lit(1), F.length(d) - 1).alias("p"), F.substr(d, F.length(d), F.lit(1)).cast("int").alias("c")))
    parts = let(parts, lambda x: F.struct(x["p"].alias("p"), F.pmod(x["c"] - check(x["p"]), F.lit(10)).alias("off")))
    return refill(m, let(parts, run))


def _digits_in_place(m: Column, key: str, tweak: str, back: bool) -> Column:
    return refill(m, permute_digits(F.regexp_replace(m, "[^0-9]", ""), key, F.lit(tweak), back))


def _digit_count(m: Column) -> Column:
    return F.regexp_count(m, F.lit("[0-9]"))


def _passes_luhn(m: Column) -> Column:
    return let(F.regexp_replace(m, "[^0-9]", ""), lambda d: _luhn_sum(d) % 10 == 0)


def _phone(m: Column, key: str, back: bool) -> Column:
    prefix = F.when(m.startswith("+"), F.regexp_extract(m, COUNTRY, 0)).otherwise(F.regexp_extract(m, r"^\d{1,3}(?=[ .-]\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}$)|^0(?=\d{2,4} )", 0))
    return let(prefix, lambda kept: F.concat(kept, let(F.substr(m, F.length(kept) + 1, F.length(m)), lambda rest: _digits_in_place(rest, key, "phone", back))))


# Issued social security numbers: areas 001 to 665 and 667 to 899, groups 01 to 99, serials 0001 to 9999.
SSN_AREAS, SSN_GROUPS, SSN_SERIALS = 898, 99, 9999


def _ssn(m: Column, key: str, back: bool) -> Column:
    def run(x: Column) -> Column:
        area = x[0] - F.when(x[0] > 666, 2).otherwise(1)
        h = feistel(area, (x[1] - 1) * SSN_SERIALS + x[2] - 1, F.lit(SSN_AREAS), F.lit(SSN_GROUPS * SSN_SERIALS), key, F.lit("ssn"), back)
        number = lambda y, n: F.lpad(y.cast("long").cast("string"), n, "0")
        return let(h, lambda h: F.concat_ws("-", number(h["l"] + F.when(h["l"] >= 665, 2).otherwise(1), 3), number(F.floor(h["r"] / SSN_SERIALS) + 1, 2), number(h["r"] % SSN_SERIALS + 1, 4)))

    return let(F.transform(F.split(m, "-"), lambda p: p.cast("long")), run)


def _mod97(s: Column) -> Column:
    """Remainder by 97 of digits and letters, A for 10 to Z for 35."""
    value = lambda c: F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)


def _passes_iban(m: Column) -> Column:
    return let(F.replace(m, F.lit(" "), F.lit("")), lambda d: _mod97(F.concat(F.substr(d, F.lit(5)), F.substr(d, F.lit(1), F.lit(4)))) == 1)


def _iban(m: Column, key: str, back: bool) -> Column:
    """Permutes the digits behind the check digits, and makes those anew."""
    def run(rest: Column) -> Column:
        country = F.substr(m, F.lit(1), F.lit(2))
        check = 98 - _mod97(F.concat(F.replace(rest, F.lit(" "), F.lit("")), country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), rest)

    return let(let(F.substr(m, F.lit(5)), lambda rest: _digits_in_place(rest, key, "iban", back)), run)


def _ipv4(m: Column, key: str, back: bool) -> Column:
    def run(o: Column) -> Column:
        h = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ipv4"), back)
        return let(h, lambda h: F.concat_ws(".", *[x.cast("string") for x in (F.floor(h["l"] / 256), h["l"] % 256, F.floor(h["r"] / 256), h["r"] % 256)]))

    return let(F.transform(F.split(m, r"\."), lambda o: o.cast("long")), run)


def _separator(m: Column) -> Column:
    return F.regexp_extract(m, "[^0-9]", 0)


def _day_of(m: Column) -> Column:
    """The date in any of the formats, null if it doesn't exist."""
    return F.coalesce(*[F.when(_separator(m) == sep, F.try_to_date(m, form)) for sep, (_, form) in DATES.items()])


def _date(m: Column, key: str, back: bool) -> Column:
    a, b = DATE_DAYS
    origin = F.lit(DATE_FROM).cast("date")

    def run(day: Column) -> Column:
        h = feistel(F.floor(day / b), day % b, F.lit(a), F.lit(b), key, F.lit("date"), back)
        return let(let(h, lambda h: F.date_add(origin, (h["l"] * b + h["r"]).cast("int"))), lambda new: F.coalesce(*[F.when(_separator(m) == sep, F.date_format(new, form)) for sep, (_, form) in DATES.items()]))

    return let(F.datediff(_day_of(m), origin), run)


def _email(m: Column, key: str, back: bool) -> Column:
    def run(x: Column) -> Column:
        tweak = lambda kind: F.concat_ws(":", F.lit(kind), F.lower(x["domain"]))
        parts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(x["digits"]) - 1) / 36), F.lit(0)).cast("int"))
        digits = F.array_join(F.transform(parts, lambda i: permute_digits(F.substr(x["digits"], i * 36 + 1, F.lit(36)), key, tweak("d"), back)), "")
        return F.concat(refill(x["local"], digits, permute_letters(x["letters"], key, tweak("a"), back)), x["domain"])

    local = F.regexp_extract(m, "^[^@]+", 0)
    return let(F.struct(local.alias("local"), F.regexp_extract(m, "@.*$", 0).alias("domain"), F.regexp_replace(local, "[^0-9]", "").alias("digits"), F.lower(F.regexp_replace(local, "[^A-Za-z]", "")).alias("letters")), run)


CHANGES = {"email": _email, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "iban": _iban, "account": _number, "phone": _phone, "number": _number}
#: What a match of a kind's pattern has to pass.
CHECKS = {"date": lambda m: _day_of(m).isNotNull(), "iban": _passes_iban, "phone": lambda m: _digit_count(m).between(*PHONE_DIGITS), "number": _passes_luhn}


def _kind(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        fits = m.rlike(f"^(?:{KINDS[kind]})$")
        if kind in CHECKS:
            fits &= CHECKS[kind](m)
        out = F.when(fits, kind).otherwise(out)
    return out


def _change(key: str, back: bool):
    def change(m: Column) -> Column:
        def by_kind(kind: Column) -> Column:
            out = m
            for name in reversed(KINDS):
                out = F.when(kind == name, CHANGES[name](m, key, back)).otherwise(out)
            return out

        return let(_kind(m), by_kind)

    return change


def pseudonymise(text: Column, key: str, back: bool = False) -> Column:
    """The text with its personal data permuted; ``back`` undoes it with the same key."""
    return replace_spans(text, ANY, _change(key, back))


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: doc_id, text (pseudonymised), counts by kind, n_found.

    Null text stays null, empty text empty, with counts 0; null and repeated
    doc_ids are ordinary rows; an empty table gives none; other columns are
    ignored.  Leaves every text without personal data as it is.
    """
    matches = F.when(F.col("text").rlike(HINT), F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0)))
    found = docs.select("doc_id", "text", F.coalesce(matches, F.array().cast("array<string>")).alias("_found"))
    found = found.select("doc_id", "text", "_found", F.transform("_found", _kind).alias("_kinds"))
    count = lambda kind: F.size(F.filter("_kinds", lambda x: x == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    new = F.when(F.size("_found") > 0, put_back(F.col("text"), ANY, F.transform("_found", _change(key, False)))).otherwise(F.col("text"))
    return found.select("doc_id", new.alias("text"), *counts, F.size(F.filter("_kinds", lambda x: x.isNotNull())).cast("long").alias("n_found"))
