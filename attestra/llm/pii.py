"""Format-preserving Feistel pseudonyms for personal data, in DataFrame operations alone.

Card numbers, dates, telephone and social security numbers, IPv4 addresses, e-mail
addresses and long hexadecimal secrets are found by one pattern and validated.  Each
value is permuted within its own format by a keyed Feistel network whose round function
is a hash of the key, so equal values get equal pseudonyms in every document, different
values different ones, and no table of values is kept:

* a card number (13 to 19 digits, Luhn check) becomes another valid one of its length;
  a run of digits that fails the check is no card number and stays;
* a date that exists, from 1900 to 2099, becomes another such date in the same style,
  and an assignable social security number another assignable one, by a network over
  exactly those values;
* a telephone number (+, 7 to 15 digits) keeps its country code and punctuation; an
  IPv4 address becomes another; of an e-mail address the letters and digits of the
  local part change, and a secret becomes another of the same length;
* a value in capitals gets the pseudonym of its small letters, in capitals.

Every part of the pattern is bounded (an address has at most 64 characters before the
@ and 315 after it), so a text of any length and kind costs time in proportion.
Narrow: no shuffle, no Python code on rows.  Texts without a digit or an @ are passed
through.  Defined results: a null text stays null, an empty one empty; what looks like a
value but is not valid stays; repeated rows get equal results; a null doc_id and other
columns, whatever their names, are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.quality_rules import let

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9][A-Za-z0-9.-]{0,251}\.[A-Za-z]{2,63}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9/.])[0-9]{2}([/.])[0-9]{2}\1[0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![0-9A-Za-z])(?=[0-9]{0,63}+[a-fA-F])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
ANY = "|".join((EMAIL, IP, PHONE, ISO_DATE, DAY_DATE, SSN, SECRET, CARD))
ROUNDS = 10
#: Days from 1900-01-01 to 2099-12-31, 73,049, as a product for the network.
DAYS = (4297, 17)
#: Social security numbers: areas 001 to 899 but 666 with groups 01 to 99, and serials 0001 to 9999.
NUMBERS = (898 * 99, 9999)
#: Setting of the session that holds the key; a real corpus takes it from a secret store.
KEY = "spark.attestra.pii.key"


def session_key(spark: SparkSession, default: str = "attestra") -> str:
    return spark.conf.get(KEY, default)


def _round(key: str, tweak: str, i: Column, n: Column, side: Column, digits: int = 15) -> Column:
    """The round function: hexadecimal digits of a keyed hash."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), n.cast("string"), side).cast("binary"), 256), 1, digits)


def permuted(x: Column, radix: int, key: str, tweak: str) -> Column:
    """A keyed permutation of the strings of x's length over 0-9a-z up to ``radix``, by an alternating Feistel network.

    Halves must fit 62 bits: up to 36 decimal digits, 22 letters and digits.
    """
    power = lambda m: F.pow(F.lit(float(radix)), m).cast("long")
    number = lambda s: F.conv(s, radix, 10).cast("long")

    def network(s: Column) -> Column:
        n = F.length(s)
        u = F.floor(n / 2).cast("int")
        start = F.struct(F.substr(s, F.lit(1), u).alias("a"), F.substr(s, u + F.lit(1)).alias("b"))

        def step(acc: Column, i: Column) -> Column:
            m = F.length(acc["a"])
            c = (number(acc["a"]) + F.conv(_round(key, tweak, i, n, acc["b"]), 16, 10).cast("long") % power(m)) % power(m)
            return F.struct(acc["b"].alias("a"), F.lpad(F.lower(F.conv(c.cast("string"), 10, radix)), m, F.lit("0")).alias("b"))

        done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))
        single = F.lower(F.conv(((number(s) + F.conv(_round(key, tweak, F.lit(0), n, F.lit("")), 16, 10).cast("long") % radix) % radix).cast("string"), 10, radix))
        return F.when(n >= 2, done).when(n == 1, single).otherwise(s)

    return let(x, network)


def permuted_pair(a: Column, b: Column, sizes: tuple[int, int], key: str, tweak: str) -> Column:
    """A keyed permutation of the pairs a < sizes[0], b < sizes[1]: struct(a, b), both long."""
    value = lambda i, k, side: F.conv(_round(key, tweak, i, F.lit(k), side.cast("string")), 16, 10).cast("long")

    def step(acc: Column, i: Column) -> Column:
        return let((acc["a"] + value(i, 0, acc["b"]) % sizes[0]) % sizes[0], lambda x: F.struct(x.alias("a"), ((acc["b"] + value(i, 1, x) % sizes[1]) % sizes[1]).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def in_blocks(x: Column, size: int, radix: int, key: str, tweak: str) -> Column:
    """``permuted`` for strings of any length, block by block."""
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.length(x), F.lit(1)) - 1) / size).cast("int"))
    return F.array_join(F.transform(starts, lambda k: permuted(F.substr(x, k * size + 1, F.lit(size)), radix, key, tweak)), "")


def xored(x: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of hexadecimal strings of x's length (up to 64), by a Feistel network with exclusive or."""
    width = 12

    def mixed(a: Column, f: Column) -> Column:
        piece = lambda s, k: F.conv(F.substr(s, k * width + 1, F.lit(width)), 16, 10).cast("long")
        size = lambda k: F.least(F.lit(width), F.length(a) - k * width)
        cut = lambda k: F.conv(F.substr(f, k * width + 1, size(k)), 16, 10).cast("long")
        steps = F.sequence(F.lit(0), F.floor((F.length(a) - 1) / width).cast("int"))
        return F.array_join(F.transform(steps, lambda k: F.lpad(F.lower(F.hex(piece(a, k).bitwiseXOR(cut(k)))), size(k), F.lit("0"))), "")

    def network(s: Column) -> Column:
        n = F.length(s)
        u = F.floor(n / 2).cast("int")
        start = F.struct(F.substr(s, F.lit(1), u).alias("a"), F.substr(s, u + F.lit(1)).alias("b"))
        step = lambda acc, i: F.struct(acc["b"].alias("a"), mixed(acc["a"], _round(key, tweak, i, n, acc["b"], 64)).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))

    return let(x, network)


def woven(template: Column, values: Column, pattern: str) -> Column:
    """``template`` with its characters of ``pattern`` replaced by those of ``values`` in turn."""
    characters = F.filter(F.split(template, ""), lambda c: c != "")

    def weave(cs: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            hit = c.rlike(pattern)
            return F.struct(F.concat(acc["out"], F.when(hit, F.substr(values, acc["k"], F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + hit.cast("int")).alias("k"))

        return F.aggregate(cs, F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda acc: acc["out"])

    return let(characters, weave)


def luhn(prefix: Column) -> Column:
    """The check digit that makes prefix + digit valid."""
    positions = F.sequence(F.lit(1), F.length(prefix))

    def value(i: Column) -> Column:
        d = F.substr(prefix, F.length(prefix) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.transform(positions, value), F.lit(0), lambda a, x: a + x)
    return (10 - total % 10) % 10


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    def swap(d: Column) -> Column:
        head, last = F.substr(d, F.lit(1), F.length(d) - 1), F.substr(d, F.length(d)).cast("int")
        return F.when(luhn(head) == last, let(permuted(head, 10, key, "card"), lambda new: woven(m, F.concat(new, luhn(new).cast("string")), "[0-9]"))).otherwise(m)

    return let(_digits(m), swap)


def _ssn(m: Column, key: str) -> Column:
    number = lambda at, n: F.substr(m, F.lit(at), F.lit(n)).cast("long")
    area, group, serial = number(1, 3), number(5, 2), number(8, 4)
    assignable = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = (area - 1 - (area > 666).cast("int")) * 99 + group - 1

    def shown(p: Column) -> Column:
        x = F.floor(p["a"] / 99) + 1
        pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
        return F.concat_ws("-", pad(x + (x >= 666).cast("int"), 3), pad(p["a"] % 99 + 1, 2), pad(p["b"] + 1, 4))

    return F.when(assignable, let(permuted_pair(place, serial - 1, NUMBERS, key, "ssn"), shown)).otherwise(m)


def _date(day: Column, key: str) -> Column:
    """A day number within the range for each such number."""
    return let(permuted_pair(F.floor(day / DAYS[1]), day % DAYS[1], DAYS, key, "date"), lambda p: (p["a"] * DAYS[1] + p["b"]).cast("int"))


def _dated(m: Column, form: str, key: str) -> Column:
    origin = F.to_date(F.lit("1900-01-01"))
    day = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(form))), origin)
    return let(day, lambda d: F.when((d >= 0) & (d < DAYS[0] * DAYS[1]), F.date_format(F.date_add(origin, _date(d, key)), form)).otherwise(m))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: F.lpad(F.hex(x.cast("long")), 2, "0"))
    new = let(F.lower(F.array_join(octets, "")), lambda h: permuted(h, 16, key, "ip"))
    return let(new, lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substr(h, k * 2 + 1, F.lit(2)), 16, 10)), "."))


def _email(m: Column, key: str) -> Column:
    local, rest = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    new = let(F.regexp_replace(local, "[^a-z0-9]", ""), lambda x: in_blocks(x, 22, 36, key, "mail"))
    return F.concat(woven(local, new, "[a-z0-9]"), F.lit("@"), rest)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}?(?=[ .(-]|[0-9]{7})", 0)
    rest = F.substr(m, F.length(country) + 1)
    return F.when(F.length(_digits(m)).between(7, 15), F.concat(country, woven(rest, permuted(_digits(rest), 10, key, "phone"), "[0-9]"))).otherwise(m)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one value that ``ANY`` found."""
    small = F.lower(value)
    whole = lambda p: small.rlike(f"^(?:{p})$")
    new = (
        F.when(value.contains("@"), _email(small, key))
        .when(value.startswith("+"), _phone(value, key))
        .when(whole(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), _ip(value, key))
        .when(whole("[0-9]{4}-[0-9]{2}-[0-9]{2}"), _dated(value, "yyyy-MM-dd", key))
        .when(whole("[0-9]{2}/[0-9]{2}/[0-9]{4}"), _dated(value, "dd/MM/yyyy", key))
        .when(whole(r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}"), _dated(value, "dd.MM.yyyy", key))
        .when(whole("[0-9]{3}-[0-9]{2}-[0-9]{4}"), _ssn(value, key))
        .when(whole("[0-9]*[a-f][0-9a-f]*"), xored(small, key, "secret"))
        .otherwise(_card(value, key))
    )
    return F.when(value.rlike("[A-Z]") & ~value.rlike("[a-z]"), F.upper(new)).otherwise(new)


def pseudonymised(text: Column, key: str) -> Column:
    """struct(text, n_found): a text with every value replaced, and how many were."""

    def replaced(found: Column) -> Column:
        def joined(new: Column) -> Column:
            changed = F.filter(F.zip_with(found, new, lambda m, x: m != x), lambda c: c)
            whole = F.array_join(F.zip_with(F.split(text, ANY, -1), new, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
            return F.struct(whole.alias("text"), F.size(changed).cast("long").alias("n_found"))

        return let(F.transform(found, lambda m: pseudonym(m, key)), joined)

    plain = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_found"))
    return F.when(text.rlike("[0-9@]"), let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda found: F.when(F.size(found) > 0, replaced(found)).otherwise(plain))).otherwise(plain)


def pseudonymise(docs: DataFrame, key: str, column: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the values in ``column`` replaced; ``count``: a column for how many were replaced."""
    at, name = docs.columns.index(column), "_pseudonymised"
    while name in docs.columns:
        name += "_"
    out = docs.withColumn(name, pseudonymised(F.col(column), key))
    columns = [F.col(name)["text"].alias(column) if i == at else docs[c] for i, c in enumerate(docs.columns)]
    return out.select(*columns, *([F.col(name)["n_found"].alias(count)] if count else []))
