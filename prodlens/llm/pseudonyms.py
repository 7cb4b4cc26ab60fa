"""Format-preserving pseudonyms of personal data, with DataFrame functions only.

Numbers, dates and addresses are found by pattern, validated, and replaced by a keyed permutation of
their own format: a card number becomes another number with a right check digit, a date another date, an IP
address another address. The permutations are Feistel networks keyed by HMAC-like SHA-256, so that equal
values have equal pseudonyms in all documents, and the owner of the key can undo them.

A number x of a domain of m1 * m2 values is the pair (x div m2, x mod m2), and rounds add in turn to the one a keyed
function of the other. Strings whose characters keep their classes (digit, lower, upper) are halved, and rounds shift
the one half's characters by a keyed stream of the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: English names of months.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTH = "(?:" + "|".join(MONTHS + [m[:3] for m in MONTHS if m != "May"]) + ")"

#: What is looked for, in order of precedence at the same place. Validation follows below. Loops are possessive or
#: bounded (a domain has at most 127 labels), as others recurse once for each turn and end on long texts.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,126}[A-Za-z]{2,24}",
    "aws": r"\bAKIA[0-9A-Z]{16}\b",
    "secret": r"\b(?i:password|passwd|pwd|secret|token|api_?key)\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9_\-./+]{6,128}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "iso_date": r"(?<!\d)(?:19|20)\d{2}-\d{2}-\d{2}(?!\d)",
    "day_date": r"(?<!\d)(?<!\d[./\-])\d{1,2}[./\-]\d{1,2}[./\-](?:19|20)\d{2}(?!\d)",
    "name_date": rf"(?<!\d)\d{{1,2}} {MONTH} (?:19|20)\d{{2}}(?!\d)|\b{MONTH} \d{{1,2}},? (?:19|20)\d{{2}}(?!\d)",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"(?:\+1[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}\b|(?:\+1[ .\-])?\b\d{3}[.\-]\d{3}[.\-]\d{4}\b|\+1 \d{3} \d{3} \d{4}\b",
    "intl_phone": r"\+(?:[2-9]\d{0,2})(?:[ .\-]?\(?\d{1,4}\)?){2,5}",
    "card": r"\b(?=\d(?:[ \-]?\d){12})\d++(?!\w)(?:[ \-]\d++(?!\w))*+",
    "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: How the digits of cards are written, and IBANs, where they are only a part of what was found.
CARD_GROUPS = r"^(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ \-])\d{6}\2\d{4,5})$"
IBAN_GROUPS = r"^[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)$"
#: Days since 1970-01-01 of the first date in the permuted range, and its length: 1900-01-01 to 2099-12-31.
FIRST_DAY, DAYS, DAY_SPLIT = -25567, 73049, 4297


class Undo(str):
    """A key with which pseudonyms become the values again that they stand for."""


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def permuted_number(x: Column, m1: int, m2: int, key: str, label: str) -> Column:
    """A keyed permutation of 0 .. m1 * m2 - 1."""
    pair = F.struct(F.floor(x / F.lit(m2)).cast("long").alias("a"), F.pmod(x, F.lit(m2)).cast("long").alias("b"))

    def round_(s: Column, i: Column) -> Column:
        # The round's number is part of the hashed text, so one expression serves all rounds.
        keyed = lambda v: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}/{label}/{m1}/{m2}/"), i.cast("string"), F.lit("/"), v.cast("string")), 256), 1, 14), 16, 10).cast("long")
        moved = (lambda x, by: x - by) if isinstance(key, Undo) else (lambda x, by: x + by)
        even = F.struct(F.pmod(moved(s["a"], keyed(s["b"])), F.lit(m1)).alias("a"), s["b"].alias("b"))
        odd = F.struct(s["a"].alias("a"), F.pmod(moved(s["b"], keyed(s["a"])), F.lit(m2)).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return _let(F.aggregate(_rounds(2 * ROUNDS, key), pair, round_), lambda s: s["a"] * m2 + s["b"])


def _rounds(n: int, key: str) -> Column:
    return F.array(*map(F.lit, range(n)[::-1] if isinstance(key, Undo) else range(n)))


def _shifted(half: Column, other: Column, key: str, label: str, i: Column) -> Column:
    """Each character of half moved within its class by a keyed stream of the other half."""
    seed = F.concat(F.lit(f"{key}/{label}/"), i.cast("string"), F.lit("/"), F.length(half).cast("string"), F.lit("/"), other)
    stream = F.aggregate(F.sequence(F.lit(0), F.floor(F.length(half) / 32).cast("int")), F.lit(""), lambda s, n: F.concat(s, F.sha2(F.concat(seed, F.lit("/"), n.cast("string")), 256)))

    def moved(c: Column, n: Column, s: Column) -> Column:
        step = F.conv(F.substring(s, n * 2 + 1, F.lit(2)), 16, 10).cast("int") * (-1 if isinstance(key, Undo) else 1)
        within = lambda base, size: F.char(F.pmod(F.ascii(c) - base + step, F.lit(size)) + base)
        return F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, 26)).when(c.between("A", "Z"), within(65, 26)).otherwise(c)

    return _let(stream, lambda s: F.array_join(F.transform(F.split(half, ""), lambda c, n: moved(c, n, s)), ""))


def permuted_text(x: Column, key: str, label: str) -> Column:
    """A keyed permutation of the strings that have x's length, separators, and classes of characters."""
    cut = F.floor(F.length(x) / 2).cast("int")
    pair = F.struct(F.substring(x, F.lit(1), cut).alias("a"), F.substring(x, cut + 1, F.length(x) - cut).alias("b"))

    def round_(s: Column, i: Column) -> Column:
        even = F.struct(_shifted(s["a"], s["b"], key, label, i).alias("a"), s["b"].alias("b"))
        odd = F.struct(s["a"].alias("a"), _shifted(s["b"], s["a"], key, label, i).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return _let(F.aggregate(_rounds(ROUNDS, key), pair, round_), lambda s: F.concat(s["a"], s["b"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _refilled(x: Column, digits: Column) -> Column:
    """x with its digits replaced in order, its separators kept."""
    step = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["t"], F.substring(s["d"], 1, 1)).alias("t"), F.substring(s["d"], F.lit(2), F.length(s["d"])).alias("d"))).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["d"].alias("d")))
    return F.aggregate(F.split(x, ""), F.struct(F.lit("").alias("t"), digits.alias("d")), step)["t"]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum modulo 10; 0 for a number with a right check digit."""
    twice = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    n = F.length(digits)
    total = F.aggregate(F.transform(F.split(digits, ""), lambda c, i: _let(c.cast("int"), lambda v: F.when((n - i) % 2 == 0, twice(v)).otherwise(v))), F.lit(0), lambda a, v: a + v)
    return F.pmod(total, F.lit(10))


def _card(x: Column, key: str) -> Column:
    """All digits but the last permuted, and the last made right again."""

    def made(d: Column) -> Column:
        body = permuted_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return _let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    ok = F.length(_digits(x)).between(13, 19) & (luhn_sum(_digits(x)) == 0) & ~_digits(x).rlike("^(.)\\1*$")
    return F.when(ok, _refilled(x, made(_digits(x))))


def _ip(x: Column, key: str) -> Column:
    part = lambda i: F.split(x, "\\.")[i].cast("long")
    number = ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3)
    ok = F.forall(F.split(x, "\\."), lambda p: p.cast("int") <= 255) & ~F.exists(F.split(x, "\\."), lambda p: p.rlike("^0\\d"))
    back = lambda y: F.concat_ws(".", *(F.pmod(F.shiftright(y, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))
    return F.when(ok, _let(permuted_number(number, 1 << 16, 1 << 16, key, "ip"), back))


def _phone(x: Column, key: str) -> Column:
    """North American: area and exchange from 200 to 999 both before and after."""
    d = F.right(_digits(x), F.lit(10))
    area, exchange, line = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
    number = ((area - 200) * 800 + (exchange - 200)) * 10_000 + line
    put = lambda y: F.concat((F.floor(y / 8_000_000) + 200).cast("string"), (F.pmod(F.floor(y / 10_000), F.lit(800)) + 200).cast("string"), F.lpad(F.pmod(y, F.lit(10_000)).cast("string"), 4, "0"))
    return F.when((area >= 200) & (exchange >= 200), _refilled(x, F.concat(F.left(_digits(x), F.length(_digits(x)) - 10), _let(permuted_number(number, 640_000, 10_000, key, "phone"), put))))


def _intl_phone(x: Column, key: str) -> Column:
    """7 to 15 digits after a plus sign; the first two are kept, so that the country stays."""
    d = _digits(x)
    return F.when(F.length(d).between(7, 15), _refilled(x, F.concat(F.left(d, F.lit(2)), permuted_text(F.substring(d, F.lit(3), F.length(d)), key, "intl"))))


def _ssn(x: Column, key: str) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (F.substring(_digits(x), a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    ok = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    number = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1

    def put(y: Column) -> Column:
        a = F.floor(y / (99 * 9999)) + 1
        return F.concat_ws("-", F.lpad((a + F.when(a >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.pmod(F.floor(y / 9999), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(y, F.lit(9999)) + 1).cast("string"), 4, "0"))

    return F.when(ok, _let(permuted_number(number, 898 * 99, 9999, key, "ssn"), put))


def _date(x: Column, key: str) -> Column:
    """A real date of 1900 to 2099; with two numbers up front, day first unless only month first is a date.

    The permutation is one of dates, so one date has one pseudonym in all notations. Days and months of one digit have no leading zero.
    """
    iso = x.rlike("^\\d{4}-")
    part = lambda i: F.regexp_extract(x, "^(\\d+)([./\\-])(\\d+)([./\\-])(\\d+)$", i)
    made = lambda y, m, d: F.try_make_timestamp(y.cast("int"), m.cast("int"), d.cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    day_first, month_first = made(part(5), part(3), part(1)), made(part(5), part(1), part(3))
    date = F.when(iso, made(part(1), part(3), part(5))).otherwise(F.coalesce(day_first, month_first))

    def put(d: Column) -> Column:
        sized = lambda v, i: F.when(F.length(part(i)) == 1, v.cast("string")).otherwise(F.lpad(v.cast("string"), 2, "0"))
        a, b = F.when(day_first.isNotNull(), F.dayofmonth(d)).otherwise(F.month(d)), F.when(day_first.isNotNull(), F.month(d)).otherwise(F.dayofmonth(d))
        return F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(sized(a, 1), part(2), sized(b, 3), part(4), F.date_format(d, "yyyy")))

    return F.when(date.isNotNull(), _let(_new_date(date, key), put))


def _new_date(date: Column, key: str) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (permuted_number(F.unix_date(date).cast("long") - FIRST_DAY, DAYS // DAY_SPLIT, DAY_SPLIT, key, "date") + FIRST_DAY).cast("int"))


def _name_date(x: Column, key: str) -> Column:
    """A real date with an English month, before or after the day, in full or by three letters."""
    name, day, year = F.regexp_extract(x, "[A-Z][a-z]+", 0), F.regexp_extract(x, "(?<!\\d)\\d{1,2}(?!\\d)", 0), F.right(x, F.lit(4))
    number = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.left(name, F.lit(3))).cast("int")
    date = F.try_make_timestamp(year.cast("int"), number, day.cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")

    def put(d: Column) -> Column:
        full = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d))
        month = F.when((F.length(name) == 3) & (name != "May"), F.left(full, F.lit(3))).otherwise(full)
        y = F.date_format(d, "yyyy")
        return F.when(x.rlike("^\\d"), F.concat_ws(" ", F.dayofmonth(d).cast("string"), month, y)).otherwise(F.concat(month, F.lit(" "), F.dayofmonth(d).cast("string"), F.when(x.contains(","), ", ").otherwise(" "), y))

    return F.when(date.isNotNull(), _let(_new_date(date, key), put))


def _mod97(text: Column) -> Column:
    """Of an IBAN moved by four characters, letters counting from 10."""
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.pmod(a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c), F.lit(97)))


def _iban(x: Column, key: str) -> Column:
    """Check digits right before and after; the country is kept."""
    plain = F.regexp_replace(x, " ", "")
    country = F.left(plain, F.lit(2))
    body = F.substring(plain, F.lit(5), F.length(plain))
    ok = (_mod97(F.concat(body, F.left(plain, F.lit(4)))) == 1) & F.length(plain).between(15, 34)

    def made(b: Column) -> Column:
        return F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)

    def refilled(new: Column) -> Column:
        step = lambda s, c: F.when(c == " ", F.struct(F.concat(s["t"], c).alias("t"), s["d"].alias("d"))).otherwise(F.struct(F.concat(s["t"], F.substring(s["d"], 1, 1)).alias("t"), F.substring(s["d"], F.lit(2), F.length(s["d"])).alias("d")))
        return F.aggregate(F.split(x, ""), F.struct(F.lit("").alias("t"), new.alias("d")), step)["t"]

    return F.when(ok, _let(_let(permuted_text(body, key, "iban"), made), refilled))


def _email(x: Column, key: str) -> Column:
    """The name before the @ permuted, with its case, digits and punctuation kept."""
    name = F.substring_index(x, "@", 1)
    return F.concat(permuted_text(name, key, "email"), F.substring(x, F.length(name) + 1, F.length(x)))


def _secret(x: Column, key: str) -> Column:
    """The value after the sign permuted."""
    head = F.regexp_extract(x, "^.*?[=:]\\s{0,2}[\"']?", 0)
    return F.concat(head, permuted_text(F.substring(x, F.length(head) + 1, F.length(x)), key, "secret"))


def _aws(x: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), permuted_text(F.substring(x, F.lit(5), F.length(x)), key, "aws"))


MAKERS: dict[str, Callable[[Column, str], Column]] = {"email": _email, "aws": _aws, "secret": _secret, "iban": _iban, "iso_date": _date, "day_date": _date, "name_date": _name_date, "ssn": _ssn, "phone": _phone, "intl_phone": _intl_phone, "card": _card, "ip": _ip}


#: Kinds of which only a part of what was found may be one, as ordinary neighbours look like more of it.
PARTLY: dict[str, Callable[[Column, str], Column]] = {"iban": _iban, "card": _card}


def _first_kind(found: Column, key: str, kinds: list[str]) -> Column:
    """Of the kinds whose whole pattern it has, the pseudonym of the first that validates; else null."""
    return F.coalesce(*(F.when(found.rlike(f"^(?:{PATTERNS[kind]})$"), MAKERS[kind](found, key)) for kind in kinds))


def _in_parts(x: Column, key: str) -> Column:
    """x with the cards and IBANs among its runs of groups replaced, from the left, the longest first, and other kinds in what is left."""
    groups = F.regexp_extract_all(x, F.lit("([^ \\-]+|[ \\-])"), 1)
    one = lambda c: F.coalesce(F.when(c.rlike(CARD_GROUPS), _card(c, key)), F.when(c.rlike(IBAN_GROUPS), _iban(c, key)))

    def candidates(g: Column) -> Column:
        """Where a card or IBAN starts, how many groups the longest there has, and what it becomes."""

        def at(i: Column) -> Column:
            sizes = F.sequence(F.least(F.size(g) - i + 1, F.lit(17)), F.lit(1), F.lit(-1))
            made = F.filter(F.transform(sizes, lambda n: F.struct(one(F.array_join(F.slice(g, i, n), "")).alias("t"), n.alias("n"))), lambda c: c["t"].isNotNull())
            return _let(made, lambda m: F.when(F.size(m) > 0, F.struct(i.alias("i"), m[0]["n"].alias("n"), m[0]["t"].alias("t"))))

        starts = F.filter(F.sequence(F.lit(1), F.size(g)), lambda i: F.element_at(g, i).rlike("^(?:\\d{4,19}|[A-Z]{2}\\d{2}.*)$"))
        return F.filter(F.transform(starts, at), lambda c: c.isNotNull())

    def chosen(g: Column) -> Column:
        """Those from the left that do not overlap, each with where the one before ends; last an empty one after the end."""
        start = F.struct(F.array().cast("array<struct<i:int,n:int,t:string,since:int>>").alias("c"), F.lit(1).alias("next"))
        put = lambda s, c: F.struct(F.concat(s["c"], F.array(F.struct(c["i"].alias("i"), c["n"].alias("n"), c["t"].alias("t"), s["next"].alias("since")))).alias("c"), (c["i"] + c["n"]).alias("next"))
        end = F.array(F.struct((F.size(g) + 1).alias("i"), F.lit(0).alias("n"), F.lit("").alias("t")))
        return F.aggregate(F.concat(candidates(g), end), start, lambda s, c: F.when(c["i"] >= s["next"], put(s, c)).otherwise(s))["c"]

    others = [k for k in PATTERNS if k not in PARTLY]
    pattern = "|".join(f"(?:{PATTERNS[k]})" for k in others)
    rest = lambda t: F.when(t == "", t).otherwise(_joined(t, pattern, lambda y: F.coalesce(_first_kind(y, key, others), y)))
    part = lambda g, c: F.concat(_let(F.array_join(F.slice(g, c["since"], c["i"] - c["since"]), ""), rest), c["t"])
    return _let(groups, lambda g: F.array_join(F.transform(chosen(g), lambda c: part(g, c)), ""))


def pseudonym(found: Column, key: str) -> Column:
    """What a found string becomes: of the kinds whose whole pattern it has, the first that validates; else, of cards and IBANs, parts that do; else itself."""
    partly = "|".join(f"(?:{PATTERNS[kind]})" for kind in PARTLY)
    return F.coalesce(_first_kind(found, key, list(MAKERS)), F.when(found.rlike(f"^(?:{partly})$"), _in_parts(found, key)), found)


def _joined(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with each match of pattern changed."""
    between = F.split(text, pattern, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), change)
    return F.array_join(F.flatten(F.zip_with(between, found, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def replaced(text: Column, key: str) -> Column:
    """The text with all personal data pseudonymised."""
    whole = _joined(text, ANY, lambda x: pseudonym(x, key))
    return F.when(text.rlike("[0-9@]|(?i:pass|pwd|secret|token|key)"), whole).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns and rows of docs, with personal data in text_col replaced by format-preserving pseudonyms.

    Null texts stay null and empty ones empty. Repeated rows get equal results. Strings that look like a kind
    but do not validate (a wrong check digit, the 31st of February) stay as they are; an e-mail's domain stays in any case.
    With Undo(key), pseudonyms become the values that they stand for; only dates whose pseudonym reads day first, though the date
    could only be read month first, do not come back.
    """
    return docs.withColumn(text_col, replaced(F.col(text_col), key))
