r"""Personal data replaced by format-preserving pseudonyms, in DataFrame functions alone.

Found values are validated, then permuted within their own format by a keyed Feistel network, so equal values get equal pseudonyms in
every document and different values different ones. Separators stay where they are.

========  =======================================================  ==========================================================
kind      valid if                                                 what is permuted
========  =======================================================  ==========================================================
card      13 to 19 digits that pass the Luhn test, inside a run    all digits but the first and the check digit, which is set anew
          of digit groups from one group's start to another's end
iban      13 to 34 characters that pass the modulo 97 test, in     the digits after the check digits, which are set anew
          one piece or in groups of four
phone     ten national digits after +1, in the usual groups        area and the rest, each within its range
phone     8 to 15 digits after + and another country code          all digits but the first two
ssn       area 001-899 but 666, group 01-99, serial 0001-9999      all three parts within their ranges
ip        four numbers up to 255                                   the 32 bits
date      a day from 1900 to 2099 as y-m-d, d/m/y, d.m.y or, if    the day within these years, of m/d/y within the days after
          it is no d/m/y, m/d/y                                    the 12th, which no other form reads
email     a name and a domain with a dot                           the name becomes a keyed digest; the domain stays
secret    40 hexadecimal digits                                    a keyed digest of 40 hexadecimal digits
========  =======================================================  ==========================================================

A two-part Feistel network (Z_a x Z_b, alternating additions of keyed SHA-256) is a permutation for any a and b, so nothing has to be
tried again to stay in range (but for m/d/y, which is permuted until it comes back into its range). E-mail names and secrets have no
fixed range: there equal values are linked by a digest of 96 or 160 bits.

The key is that of ``spark.docspark.pii.key``. Without one a session draws its own, so that values are linked inside it but nobody can undo them.

Defined cases: a null text stays null with no findings; an empty one stays empty; values that fail validation stay as they are; a
null doc_id, repeated rows and an empty table need nothing special; ``pseudonymize`` keeps all columns, the report has its own.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_CONF = "spark.docspark.pii.key"
ROUNDS = 8
#: Times that an m/d/y date is permuted at most; two fifths of the days leave its range, so each value is back long before.
WALK = 64
#: Days of the date range: 1900-01-01 and the 73,049 days from it on, which are 17 * 4,297.
FIRST_DAY, DAY_PARTS = "1900-01-01", (17, 4297)

_B, _E = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: What is looked for, each anchored so that a run of characters is scanned once.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}",
    "secret": _B + r"[0-9a-f]{40}" + _E,
    "iban": _B + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{9,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _E,
    "date": _B + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\1[0-9]{4})" + r"(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}" + r"(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?:(?<![0-9A-Za-z+])(?:\+1[ .-]?)(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?<![0-9A-Za-z+(])(?:\([0-9]{3}\)[ .-]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}|(?<![0-9A-Za-z+])\+[2-9][0-9](?:[ .-]?[0-9]){6,13})" + _E,
    "card": _B + r"(?=(?:[0-9][ -]?){12}[0-9])[0-9][0-9 -]*" + _E,
}
#: The date form has a group of its own, so inside the alternation it is written out.
PATTERN = "|".join(f if k != "date" else _B + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z-])" for k, f in FORMS.items())


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key), *(p.cast("string") for p in parts)), 256)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """struct<l, r>: a keyed permutation of (left, right) in Z_a x Z_b, as longs."""
    long = lambda c: c.cast("long")

    def step(s, k):
        even = k % 2 == 0
        h = F.conv(F.substring(_digest(key, F.lit(kind), k, F.when(even, s["r"]).otherwise(s["l"]), long(a), long(b)), 1, 14), 16, 10).cast("long")
        return F.struct(
            F.when(even, F.pmod(s["l"] + F.pmod(h, long(a)), long(a))).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(h, long(b)), long(b))).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(long(left).alias("l"), long(right).alias("r")), step)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _at(s: Column, k: Column) -> Column:
    return F.substr(s, k, F.lit(1)).cast("int")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _padded(x: Column, n: Column) -> Column:
    return F.lpad(x.cast("string"), n, F.lit("0"))


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string, from its last digit on."""
    n = F.length(d)

    def add(s, k):
        x = _at(d, n - k) * F.when(k % 2 == 1, 2).otherwise(1)
        return s + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits, in order, replaced by those of ``digits``."""

    def put(k):
        c = F.substr(m, k, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(m, F.lit(1), k))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), put), "")


def _permuted_digits(d: Column, key: str, kind: str) -> Column:
    """A digit string of 2 to 30 digits, permuted among those of its length."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    v = n - u
    moved = feistel(F.substr(d, F.lit(1), u).cast("long"), F.substr(d, u + 1, v).cast("long"), _power(u), _power(v), key, kind)
    return F.transform(F.array(moved), lambda s: F.concat(_padded(s["l"], u), _padded(s["r"], v)))[0]


def _one_card(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _permuted_digits(F.substr(d, F.lit(2), n - 2), key, "card"))
    new = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))[0]
    return _refill(m, new)


def _card(m: Column, key: str) -> Column:
    """A run of digit groups with the cards in it replaced, from left to right, of one start the longest first; null without a card."""
    groups = F.regexp_extract_all(m, F.lit("[0-9]+[ -]*"), F.lit(0))

    def is_card(x):
        d = _digits(x)
        return x.rlike(r"\A[0-9]+([ -][0-9]+){0,18}[ -]*\z") & F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), luhn_sum(d) % 10 == 0)

    def step(s, k):
        joined = lambda n: F.array_join(F.slice(s["groups"], k + 1, n), "")
        most = F.least(F.lit(19), F.size(s["groups"]) - k)
        size = F.get(F.filter(F.sequence(most, F.lit(1), F.lit(-1)), lambda n: is_card(joined(n))), F.lit(0))
        found = F.transform(F.array(size), lambda n: F.when(n.isNull(), F.get(s["groups"], k)).otherwise(_one_card(joined(n), key)))[0]
        return F.when(k < s["next"], s).otherwise(
            F.struct(s["groups"].alias("groups"), (k + F.coalesce(size, F.lit(1))).alias("next"), (s["any"] | size.isNotNull()).alias("any"), F.concat(s["out"], found).alias("out"))
        )

    start = F.struct(groups.alias("groups"), F.lit(0).alias("next"), F.lit(False).alias("any"), F.lit("").alias("out"))
    done = F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step)
    return F.transform(F.array(done), lambda s: F.when(s["any"], s["out"]))[0]


def _mod97(s: Column) -> Column:
    """Remainder of an IBAN-like string by 97, letters read as 10 to 35."""

    def add(acc, k):
        c = F.ascii(F.substr(s, k, F.lit(1)))
        return F.when(c < 65, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _respaced(m: Column, new: Column) -> Column:
    """new with spaces where m has them."""
    place = lambda k: k - F.length(F.regexp_replace(F.substr(m, F.lit(1), k), "[^ ]", ""))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda k: F.when(F.substr(m, k, F.lit(1)) == " ", " ").otherwise(F.substr(new, place(k), F.lit(1)))), "")


def _iban(m: Column, key: str) -> Column:
    """The longest run of groups from the first on that is valid, replaced; what follows stays."""
    groups = F.split(m, " ")

    def valid(n):
        x = F.array_join(F.slice(groups, 1, n), "")
        rest = F.substr(x, F.lit(5), F.length(x) - 4)
        return (F.length(x) >= 13) & (_mod97(F.concat(rest, F.substr(x, F.lit(1), F.lit(4)))) == 1) & (F.length(_digits(rest)) >= 2)

    def made(n):
        x, country = F.array_join(F.slice(groups, 1, n), ""), F.substr(m, F.lit(1), F.lit(2))
        rest = F.substr(x, F.lit(5), F.length(x) - 4)
        new = F.transform(F.array(_refill(rest, _permuted_digits(_digits(rest), key, "iban"))), lambda b: F.concat(country, _padded(98 - _mod97(F.concat(b, country, F.lit("00"))), F.lit(2)), b))[0]
        old = F.array_join(F.slice(groups, 1, n), " ")
        return F.concat(_respaced(old, new), F.substr(m, F.length(old) + 1, F.length(m)))

    size = F.get(F.filter(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), valid), F.lit(0))
    return F.transform(F.array(size), lambda n: F.when(n.isNotNull(), made(n)))[0]


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d)
    ten = F.substr(d, n - 9, F.lit(10))
    area, rest = F.substr(ten, F.lit(1), F.lit(3)).cast("long"), F.substr(ten, F.lit(4), F.lit(7)).cast("long")
    # Three ranges, each permuted within itself: area codes in use with an exchange in use, with another one, and other area codes.
    used, both = area >= 200, (area >= 200) & (rest >= 2_000_000)
    first, low = F.when(used, 200).otherwise(0), F.when(both, 2_000_000).otherwise(0)
    moved = feistel(area - first, rest - low, F.when(used, 800).otherwise(200), F.when(both, 8_000_000).when(used, 2_000_000).otherwise(10_000_000), key, "phone")
    head = F.substr(d, F.lit(1), n - 10)
    new = F.transform(F.array(moved), lambda s: F.concat(head, _padded(s["l"] + first, F.lit(3)), _padded(s["r"] + low, F.lit(7))))[0]
    # Another country's: the digits behind the first two, permuted among as many.
    abroad = F.concat(F.substr(d, F.lit(1), F.lit(2)), _permuted_digits(F.substr(d, F.lit(3), n - 2), key, "phone"))
    return F.when(m.rlike(r"\A\+[2-9]"), F.when(n.between(8, 15), _refill(m, abroad))).when(n.between(10, 11), _refill(m, new))


def _ssn(m: Column, key: str) -> Column:
    part = lambda a, n: F.substr(m, F.lit(a), F.lit(n)).cast("long")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    moved = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")

    def show(s):
        a = s["l"] + F.when(s["l"] >= 665, 2).otherwise(1)
        return F.concat_ws("-", _padded(a, F.lit(3)), _padded(F.floor(s["r"] / 9999) + 1, F.lit(2)), _padded(s["r"] % 9999 + 1, F.lit(4)))

    return F.when(valid, F.transform(F.array(moved), show)[0])


def _ip(m: Column, key: str) -> Column:
    p = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    valid = F.forall(p, lambda x: x <= 255)
    moved = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), key, "ip")
    high = lambda x: F.floor(x / 256).cast("string")
    low = lambda x: (x % 256).cast("string")
    return F.when(valid, F.transform(F.array(moved), lambda s: F.concat_ws(".", high(s["l"]), low(s["l"]), high(s["r"]), low(s["r"])))[0])


def _day(d: Column) -> Column:
    """Days from FIRST_DAY to a y-m-d string; null if there is no such day within the range."""
    day = F.datediff(d.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    return F.when(day.between(0, DAY_PARTS[0] * DAY_PARTS[1] - 1), day)


def _date(m: Column, key: str) -> Column:
    part = lambda k, n: F.substr(m, F.lit(k), F.lit(n))
    iso, b = m.rlike(r"\A[0-9]{4}-"), DAY_PARTS[1]
    day = _day(F.when(iso, m).otherwise(F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2))))
    other = F.when(day.isNull() & (part(3, 1) == "/"), _day(F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2))))
    shown = lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * b + s["r"]).cast("int"))
    moved = lambda l, r, kind: feistel(l, r, F.lit(DAY_PARTS[0]), F.lit(b), key, kind)  # noqa: E731, E741

    def show(s):
        new = shown(s).cast("string")
        parts = [F.substr(new, F.lit(k), F.lit(n)) for k, n in ((9, 2), (6, 2), (1, 4))]
        return F.when(iso, new).when(day.isNull(), F.concat(parts[1], part(3, 1), parts[0], part(3, 1), parts[2])).otherwise(F.concat(parts[0], part(3, 1), parts[1], part(3, 1), parts[2]))

    def again(s, k):
        return F.when((k > 0) & (F.dayofmonth(shown(s)) > 12), s).otherwise(moved(s["l"], s["r"], "date-mdy"))

    begun = F.struct(F.floor(other / b).cast("long").alias("l"), (other % b).cast("long").alias("r"))
    walked = F.when(other.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), begun, again))
    result = F.when(day.isNotNull(), moved(F.floor(day / b), day % b, "date")).otherwise(walked)
    return F.when(day.isNotNull() | other.isNotNull(), F.transform(F.array(result), show)[0])


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("p"), F.substring(_digest(key, F.lit("email"), F.lower(m)), 1, 24), F.lit("@"), F.substring_index(m, "@", -1))


_MAKE = {
    "email": _email, "secret": lambda m, key: F.substring(_digest(key, F.lit("secret"), m), 1, 40), "iban": _iban, "date": _date,
    "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card,
}


def _pseudonym(m: Column, key: str) -> Column:
    """struct<kind, new> of a found string; null if it fails validation. The first form that fits and validates counts."""
    each = [F.struct(F.lit(kind).alias("kind"), F.when(m.rlike(r"\A(?:" + FORMS[kind] + r")\z"), _MAKE[kind](m, key)).alias("new")) for kind in FORMS]
    return F.get(F.filter(F.array(*each), lambda x: x["new"].isNotNull()), F.lit(0))


def _found(text: Column, key: str) -> Column:
    """array<struct<old, kind, new>> of the found strings of a text, in order."""
    matches = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def entry(m):
        return F.transform(F.array(_pseudonym(m, key)), lambda p: F.struct(m.alias("old"), p["kind"].alias("kind"), p["new"].alias("new")))[0]

    return F.transform(matches, entry)


def _rewritten(text: Column, found: Column) -> Column:
    pieces = F.split(text, PATTERN, -1)
    shown = F.concat(F.transform(found, lambda x: F.coalesce(x["new"], x["old"])), F.array(F.lit("")))
    return F.when(F.exists(found, lambda x: x["kind"].isNotNull()), F.array_join(F.zip_with(pieces, shown, lambda a, b: F.concat(a, b)), "")).otherwise(text)


_drawn: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The configured key, or one that this application has drawn for itself."""
    return spark.conf.get(KEY_CONF, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with the personal data of ``text`` replaced, all columns kept; n_chars, if there, follows the text."""
    key = key or key_of(docs.sparkSession)
    out = docs.withColumn("__llm_found", _found(F.col("text"), key)).withColumn("text", _rewritten(F.col("text"), F.col("__llm_found")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__llm_found") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pii_report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, n_found (replaced strings; a run of cards is one), and the kinds found in order."""
    key = key or key_of(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("found", _found(F.col("text"), key))
    kinds = F.filter(F.transform("found", lambda x: x["kind"]), lambda k: k.isNotNull())
    out = rows.select("doc_id", _rewritten(F.col("text"), F.col("found")).alias("text"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"))
    return out.select("doc_id", "text", F.size("kinds").cast("long").alias("n_found"), F.array_join("kinds", ",").alias("kinds"))
