"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Kinds, tried in this order at each place of a text: e-mail addresses, IBANs (valid check digits), IPv4 addresses (four parts up to
255), calendar dates (that exist), social security numbers (valid groups), payment cards (13 to 19 digits with a valid Luhn
digit) and telephone numbers. Each match is replaced by a pseudonym of its own format, made by a keyed permutation of that
format's valid values: separators stay, check digits are computed anew, a date stays a date, a social security number stays
valid. Equal values get equal pseudonyms in every document and under every separator, so records stay linked, and different
ones different pseudonyms; without the key they can't be turned back. Letters' case in addresses doesn't count.

The permutation is an alternating Feistel network: a value is cut in two halves, and in each of eight rounds a keyed
hash of one half (SHA-256 of key, kind, length, round and half) is added to the other, modulo the number of its values. Halves
need not be of one size, so each kind is numbered without gaps and nothing has to be drawn again: dates are days in a
window of 10^5, social security numbers areas and groups in one half and serial numbers in the other. Names in addresses are
numbers of base 26, twelve letters at a time, each part under a key of its own that depends on the parts before it.

The key is no literal of the plan: it comes from a table of one row by a scalar subquery, whose value plans and event logs don't show.

Only texts with a digit or an @ are searched. Matches are marked with private-use characters, the text is cut at the
marks, and every other part is replaced, so no row leaves the JVM.

Edge cases: null texts stay null, empty ones empty; private-use characters U+E000 and U+E001 in a text become U+E002; what looks like
a kind but isn't valid (an IBAN's or a card's check digits, a date that doesn't exist) stays as it is; of matches at one place
the first kind wins; repeated rows give equal results; whole texts are read, however long; an empty table gives an empty result;
columns of any name are kept, or ignored by the report.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"
ROUNDS = 8
#: Days from FIRST_DAY; the window is exactly 10^5 days, 1850-01-01 to 2123-10-15.
FIRST_DAY, WINDOW_DIGITS = "1850-01-01", 5
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_DAY = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
DATE = rf"(?<![0-9./-])(?:{_DAY})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])"
PHONE = r"(?<![0-9A-Za-z+.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])"
LONG_PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9A-Za-z])"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _hash(key: Column, kind: Column | str, part: Column, round_: Column, width: Column) -> Column:
    """A keyed number below 2^60 that depends on the kind, the round, the width and the half."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    digest = F.sha2(F.concat_ws("|", key, kind, round_.cast("string"), width.cast("string"), part.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _feistel(a: Column, b: Column, top_a: Column, top_b: Column, key: Column, kind: Column | str, width: Column) -> Column:
    """The halves a (below top_a) and b (below top_b) after all rounds, as a struct. Neither top is over 10^18."""

    def round_(s: Column, i: Column) -> Column:
        first = i % 2 == 0
        return F.struct(
            F.when(first, F.pmod(s["a"] + _hash(key, kind, s["b"], i, width), top_a)).otherwise(s["a"]).alias("a"),
            F.when(first, s["b"]).otherwise(F.pmod(s["b"] + _hash(key, kind, s["a"], i, width), top_b)).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.alias("a"), b.alias("b")), round_)


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n.cast("double")).cast("bigint")


def feistel_digits(digits: Column, key: Column, kind: str) -> Column:
    """A permutation of the strings of as many digits (up to 36). A single digit is shifted by a keyed amount."""
    return _feistel_number(digits, key, F.lit(kind))


def _feistel_number(digits: Column, key: Column, kind: Column) -> Column:
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    a = F.when(u > 0, F.substr(digits, F.lit(1), u).try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    made = _feistel(a, F.substr(digits, u + 1, n - u).try_cast("bigint"), _power(u), _power(n - u), key, kind, n)
    return _bound(made, lambda s: F.concat(F.when(u > 0, F.lpad(s["a"].cast("string"), u, "0")).otherwise(F.lit("")), F.lpad(s["b"].cast("string"), n - u, "0")))


_LETTERS, _BASE_26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"
#: Letters that are permuted together.
LETTERS_AT_ONCE = 12


def _feistel_letters(part: Column, key: Column, kind: Column) -> Column:
    """A permutation of the strings of as many lower-case letters, up to LETTERS_AT_ONCE. A single letter is shifted."""
    n = F.length(part)
    u = F.floor(n / 2).cast("int")
    number = lambda x: F.conv(F.translate(x, _LETTERS, _BASE_26), 26, 10).cast("bigint")
    top = lambda m: F.pow(F.lit(26.0), m.cast("double")).cast("bigint")
    text = lambda x, m: F.translate(F.lpad(F.lower(F.conv(x.cast("string"), 10, 26)), m, "0"), _BASE_26, _LETTERS)
    a = F.when(u > 0, number(F.substr(part, F.lit(1), u))).otherwise(F.lit(0).cast("bigint"))
    made = _feistel(a, number(F.substr(part, u + 1, n - u)), top(u), top(n - u), key, kind, n)
    return _bound(made, lambda s: F.concat(F.when(u > 0, text(s["a"], u)).otherwise(F.lit("")), text(s["b"], n - u)))


def _in_parts(text: Column, size: int, permute) -> Column:
    """A permutation of long strings: of each part in turn, under what the parts before it were."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    part = lambda at: F.substr(text, at, F.lit(size))
    made = F.transform(starts, lambda at: permute(part(at), F.sha2(F.substr(text, F.lit(1), at - 1), 256)))
    return F.when(F.length(text) > 0, F.array_join(made, "")).otherwise(text)


def permuted_name(name: Column, key: Column, kind: str, tweak: Column) -> Column:
    """A permutation of the lower-case strings of one shape: letters become letters, digits digits, other signs stay."""
    letters, digits = F.regexp_replace(name, "[^a-z]", ""), F.regexp_replace(name, "[^0-9]", "")
    shape = F.concat_ws("|", F.lit(kind), tweak, F.regexp_replace(F.regexp_replace(name, "[a-z]", "a"), "[0-9]", "0"))
    # letters under the shape, digits under the letters that come out: both can be turned back, in the other order
    new_letters = _in_parts(letters, LETTERS_AT_ONCE, lambda x, before: _feistel_letters(x, key, F.concat_ws("|", shape, before)))

    def with_digits(made: Column) -> Column:
        of = lambda before: F.concat_ws("|", shape, made, before)
        new_digits = _in_parts(digits, 36, lambda x, before: _feistel_number(x, key, of(before)))
        return refill(refill(name, new_digits), made, "a", "z")

    return _bound(new_letters, with_digits)


def refill(shape: Column, signs: Column, first: str = "0", last: str = "9") -> Column:
    """The shape with its signs between first and last, left to right, replaced."""
    before = lambda i: F.regexp_replace(F.substr(shape, F.lit(1), i + 1), f"[^{first}-{last}]", "")
    new = lambda c, i: F.when(c.between(first, last), F.substr(signs, F.length(before(i)), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(shape, ""), new), "")


def luhn_sum(digits: Column) -> Column:
    """The sum of a number with its last digit as check digit; valid if it is a multiple of ten."""
    n = F.length(digits)
    return F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))),
        F.lit(0),
        lambda a, x: a + x,
    )


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN-like string (letters count 10 to 35) by 97."""
    value = lambda c: F.when(c.between("0", "9"), c).otherwise((F.ascii(c) - 55).cast("string"))
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.pmod(F.concat(a.cast("string"), value(c)).cast("int"), F.lit(97)))


def _cards(key: Column):
    def replace(m: Column) -> Column:
        d = _digits(m)
        body = feistel_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
        return F.when(luhn_sum(d) % 10 == 0, refill(m, F.concat(body, check))).otherwise(m)

    return replace


def _iban(key: Column):
    def replace(m: Column) -> Column:
        plain = F.regexp_replace(m, " ", "")
        head, body = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain))
        new_body = refill(body, feistel_digits(_digits(body), key, "iban"))
        check = F.lpad((98 - _mod97(F.concat(new_body, head, F.lit("00")))).cast("string"), 2, "0")
        valid = (_mod97(F.concat(body, F.substr(plain, F.lit(1), F.lit(4)))) == 1) & (F.length(_digits(body)) > 0)
        return F.when(valid, refill(m, F.concat(check, _digits(new_body)))).otherwise(m)

    return replace


def _ipv4(key: Column):
    def replace(m: Column) -> Column:
        parts = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
        part = lambda i: F.element_at(parts, i)
        half = F.lit(65536).cast("bigint")
        made = _feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), half, half, key, "ipv4", F.lit(4))
        shown = _bound(made, lambda s: F.concat_ws(".", *(x.cast("bigint").cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256))))
        return F.when(~F.exists(parts, lambda x: x > 255), shown).otherwise(m)

    return replace


#: Forms of dates: a pattern of Java's, and the expression that a match has. Where two agree, the first by which the date exists counts.
DATE_FORMS = (
    ("yyyy-MM-dd", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("yyyy-M-d", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"),
    ("dd.MM.yyyy", r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"),
    ("d.M.yyyy", r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"),
    ("MM/dd/yyyy", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"),
    ("dd/MM/yyyy", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"),
    ("M/d/yyyy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("d/M/yyyy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
)


def _dates(key: Column):
    first = F.lit(FIRST_DAY).cast("date")

    def replace(m: Column) -> Column:
        forms = []
        for i, (pattern, shape) in enumerate(DATE_FORMS):
            day = F.datediff(F.try_to_timestamp(m, F.lit(pattern)).cast("date"), first)
            forms.append(F.struct(F.when(m.rlike(shape), day).alias("day"), F.lit(i).alias("form")))
        read = F.get(F.filter(F.array(*forms), lambda x: x["day"].between(0, 10**WINDOW_DIGITS - 1)), F.lit(0))

        def shown(x: Column) -> Column:
            day = F.date_add(first, feistel_digits(F.lpad(x["day"].cast("string"), WINDOW_DIGITS, "0"), key, "date").cast("int"))
            return _bound(day, lambda d: F.coalesce(*(F.when(x["form"] == i, F.date_format(d, pattern)) for i, (pattern, _) in enumerate(DATE_FORMS))))

        return F.coalesce(_bound(read, shown), m)

    return replace


def _ssn(key: Column):
    """Areas 001 to 899 but 666, groups 01 to 99 and serial numbers 0001 to 9999, numbered without gaps."""
    areas, groups, serials = 898, 99, 9999

    def replace(m: Column) -> Column:
        d = _digits(m)
        area, group, serial = (F.substr(d, F.lit(at), F.lit(n)).cast("bigint") for at, n in ((1, 3), (4, 2), (6, 4)))
        place = area - F.when(area > 666, 2).otherwise(1)
        top = lambda n: F.lit(n).cast("bigint")
        made = _feistel(place * groups + group - 1, serial - 1, top(areas * groups), top(serials), key, "ssn", F.lit(9))

        def shown(s: Column) -> Column:
            at = F.floor(s["a"] / groups)
            parts = ((at + F.when(at >= 665, 2).otherwise(1), 3), (s["a"] % groups + 1, 2), (s["b"] + 1, 4))
            return F.concat_ws("-", *(F.lpad(x.cast("bigint").cast("string"), n, "0") for x, n in parts))

        bad = m.rlike(r"^(?:000|666|9)|-00-|-0000$")
        return F.when(bad, m).otherwise(_bound(made, shown))

    return replace


def _phone(key: Column):
    def replace(m: Column) -> Column:
        prefix = F.regexp_extract(m, r"^\+[0-9]{1,3}[ .-]", 0)
        rest = F.substr(m, F.length(prefix) + 1, F.length(m))
        return F.concat(prefix, refill(rest, feistel_digits(_digits(rest), key, "phone")))

    return replace


def _email(key: Column):
    """The domain but for its last label is permuted, and the name under the domain, so addresses of one domain stay together."""

    def replace(m: Column) -> Column:
        lowered = F.lower(m)
        local, domain = F.substring_index(lowered, "@", 1), F.substring_index(lowered, "@", -1)
        last = F.regexp_extract(domain, r"\.[a-z]+$", 0)
        rest = F.substr(domain, F.lit(1), F.length(domain) - F.length(last))
        names = permuted_name(local, key, "name", F.sha2(domain, 256)), permuted_name(rest, key, "domain", last)
        return F.concat(names[0], F.lit("@"), names[1], last)

    return replace


#: name, pattern of a whole match, the replacement of a key; in this order they are tried at each place of a text
KINDS = (
    ("email", EMAIL, _email),
    ("iban", IBAN, _iban),
    ("ipv4", IPV4, _ipv4),
    ("date", DATE, _dates),
    ("ssn", SSN, _ssn),
    ("card", CARD, _cards),
    ("phone", PHONE + "|" + LONG_PHONE, _phone),
)
ANY = "|".join(f"(?:{pattern})" for _, pattern, _ in KINDS)


def _kind(m: Column) -> Column:
    """The kind of a match, by its form."""
    return (
        F.when(m.contains("@"), "email").when(m.rlike("^[A-Z]"), "iban").when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ipv4")
        .when(m.rlike(f"^(?:{_DAY})$"), "date").when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike("^[0-9](?:[ -]?[0-9]){12,18}$"), "card").otherwise("phone")
    )


def cut_at_matches(text: Column) -> Column:
    """The parts of a text: those at odd places (from 0) are matches. A text without any is one part."""
    marked = F.regexp_replace(F.regexp_replace(text, f"[{OPEN}{CLOSE}]", OTHER), f"({ANY})", f"{OPEN}$1{CLOSE}")
    return F.when(text.rlike("[0-9@]"), F.split(marked, f"[{OPEN}{CLOSE}]")).otherwise(F.array(text))


ALL = tuple(k[0] for k in KINDS)


def replaced(parts: Column, key: Column, kinds: tuple[str, ...] = ALL) -> Column:
    def pseudonym(m: Column) -> Column:
        out = m
        for name, _, replacement in reversed(KINDS):
            if name in kinds:
                out = F.when(_kind(m) == name, replacement(key)(m)).otherwise(out)
        return out

    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, pseudonym(x)).otherwise(x)), "")


def _keyed(docs: DataFrame, key: str) -> Column:
    """The key as a scalar subquery over a table of one row, which the driver's JVM holds."""
    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    values = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 1)
    values[0] = key
    rows = jvm.java.util.ArrayList()
    rows.add(jvm.org.apache.spark.sql.RowFactory.create(values))
    schema = jvm.org.apache.spark.sql.types.DataType.fromDDL("key string")
    return DataFrame(spark._jsparkSession.createDataFrame(rows, schema), spark).scalar()


def pseudonymise(docs: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] = ALL) -> DataFrame:
    """All columns, with personal data in the text replaced."""
    parts, secret = f"parts_{uuid.uuid4().hex}", f"key_{uuid.uuid4().hex}"  # names that no table has
    cut = docs.withColumns({parts: cut_at_matches(F.col(text)), secret: _keyed(docs, key)})
    new = F.when(F.size(parts) > 1, replaced(F.col(parts), F.col(secret), kinds)).otherwise(F.col(text))
    return cut.withColumn(text, new).drop(parts, secret)


def pseudonym_report(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, whether it changed, and n_<kind>: how many matches of each kind the original has."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("original"), cut_at_matches(F.col(text)).alias("parts"), _keyed(docs, key).alias("key"))
    kinds = F.when(F.size("parts") > 1, F.transform(F.filter("parts", lambda x, i: i % 2 == 1), _kind)).otherwise(F.array().cast("array<string>"))
    new = F.when(F.size("parts") > 1, replaced(F.col("parts"), F.col("key"))).otherwise(F.col("original"))
    out = rows.select("doc_id", new.alias("text"), "original", kinds.alias("kinds"))
    counts = [F.size(F.filter("kinds", lambda k: k == name)).alias(f"n_{name}") for name in ALL]
    return out.select("doc_id", "text", (~F.col("text").eqNullSafe(F.col("original"))).alias("changed"), *counts)
