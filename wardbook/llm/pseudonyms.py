"""Personal data under format-preserving pseudonyms, with DataFrame functions only.

Numbers and dates that pass their kind's validation are permuted within their
format by a Feistel network keyed with ``key``: a card number becomes another
card number with a right check digit, a date another date in the same notation.
Equal values get equal pseudonyms in all documents, different ones different
pseudonyms, whatever their notation (separators are not part of the value).
Kinds and their validation:

* card: 13 to 19 digits, alone or in the usual groups, with a right check digit;
  the last digit is computed anew;
* phone: ten digits grouped by brackets, spaces, dots or hyphens, perhaps behind
  a country code, which stays; North American ones stay well-formed;
* ssn: 3-2-4 digits, no part zero, not 666 or 9xx; stays well-formed;
* ip: four numbers up to 255;
* date: year-month-day, day.month.year or month/day/year, if the calendar has it
  (``FIRST_DAY`` and ``DAYS`` give the range; others are left alone);
* email: the name becomes a keyed hash, the domain stays;
* secret: 32 to 64 hexadecimal digits with letters and digits among them become
  as many digits of a keyed hash.

What fails its validation is left as it is.

Edge cases. Null text stays null, with 0 found; a text without personal data
is returned byte for byte. Texts are treated whole, row by row: repeated rows
and ties need no rule; empty tables give empty results. Columns pass through;
the text is replaced, and ``pii_kinds`` (the kind of each replaced value, in
the order of the text) replaces a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
FIRST_DAY, DAYS = "1800-01-01", (300, 365)  # 109,500 days

_SIDE = r"(?<![0-9A-Za-z])(?:"
PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63}+)@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"[0-9a-fA-F]{32,64}+(?![0-9A-Za-z])",
    "ip": r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?:[0-9]{4}([ -])[0-9]{4}\g[0-9]{4}\g[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\h[0-9]{5}|[0-9]{13,19}+)(?![0-9A-Za-z])",
}
_CARD = PATTERNS["card"].replace(r"\g", r"\1").replace(r"\h", r"\2")
#: any candidate; where several kinds could start at one place, the first listed is tried first
ANY = _SIDE + "|".join([PATTERNS["email"], PATTERNS["secret"], PATTERNS["ip"], PATTERNS["date"], PATTERNS["ssn"], PATTERNS["phone"], _CARD]) + ")"


def _prf(key: str, tweak: Column, i: Column, x: Column) -> Column:
    """60 bits of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tweak: Column, a: Column, b: Column, mod_a: Column, mod_b: Column) -> Column:
    """A keyed permutation of the pairs (a, b) below (mod_a, mod_b), as a struct (a, b)."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")),
        lambda s, i: F.struct(
            F.when(i % 2 == 1, F.pmod(s["a"] + _prf(key, tweak, i, s["b"]), mod_a)).otherwise(s["a"]).alias("a"),
            F.when(i % 2 == 0, F.pmod(s["b"] + _prf(key, tweak, i, s["a"]), mod_b)).otherwise(s["b"]).alias("b")))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A permutation of the digit strings of each length (up to 20)."""
    half = F.floor(F.length(digits) / 2).cast("int")
    ten = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    rest = F.length(digits) - half
    tweak = F.concat(F.lit(kind), F.length(digits).cast("string"))
    left = F.coalesce(F.substring(digits, F.lit(1), half).try_cast("long"), F.lit(0))
    return _once(feistel(key, tweak, left, F.substring(digits, half + 1, rest).cast("long"), ten(half), ten(rest)),
                 lambda s: F.concat(F.when(half > 0, F.lpad(s["a"].cast("string"), half, "0")).otherwise(""), F.lpad(s["b"].cast("string"), rest, "0")))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def in_format(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced by the given ones, in turn."""
    def at(i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.length(digits_of(F.substring(value, F.lit(1), i))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), at), "")


def check_digit(body: Column) -> Column:
    """The digit that completes a card number."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(body, i, F.lit(1)).cast("int")
        twice = (F.length(body) - i) % 2 == 0
        return total + F.when(twice & (d > 4), 2 * d - 9).when(twice, 2 * d).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), add)
    return F.pmod(-total, F.lit(10)).cast("string")


def _card(key: str, m: Column) -> Column:
    d = digits_of(m)
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    other = _once(permute_digits(key, "card", body), lambda b: F.concat(b, check_digit(b)))
    return F.when(F.length(d).between(13, 19) & (F.substring(d, -1, 1) == check_digit(body)), in_format(m, other))


def _phone(key: str, m: Column) -> Column:
    d = digits_of(m)
    last, code = F.substring(d, -10, 10), F.substring(d, F.lit(1), F.length(d) - 10)
    part = lambda i, n: F.substring(last, i, n).cast("long")
    american = last.rlike("^[2-9][0-9]{2}[2-9]") & code.isin("", "1")
    formed = _once(feistel(key, F.lit("nanp"), part(1, 3) - 200, (part(4, 3) - 200) * 10_000 + part(7, 4), F.lit(800), F.lit(8_000_000)),
                   lambda s: F.concat((s["a"] + 200).cast("string"), (F.floor(s["b"] / 10_000) + 200).cast("string"), F.lpad((s["b"] % 10_000).cast("string"), 4, "0")))
    other = F.when(american, formed).otherwise(permute_digits(key, "phone", last))
    return in_format(m, F.concat(code, other))


def _ssn(key: str, m: Column) -> Column:
    a, g, s = (F.substring(m, i, n).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    area = F.when(a > 666, a - 2).otherwise(a - 1)  # 898 of them
    out = _once(feistel(key, F.lit("ssn"), area, (g - 1) * 9999 + s - 1, F.lit(898), F.lit(99 * 9999)),
                lambda x: F.concat_ws("-", F.lpad((x["a"] + F.when(x["a"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
                                      F.lpad((F.floor(x["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((x["b"] % 9999 + 1).cast("string"), 4, "0")))
    return F.when((a > 0) & (a < 900) & (a != 666) & (g > 0) & (s > 0), out)


def _ip(key: str, m: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    out = _once(feistel(key, F.lit("ip"), o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536)),
                lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)]))
    return F.when(F.forall(o, lambda x: x < 256), out)


def _date(key: str, m: Column) -> Column:
    out = F.lit(None).cast("string")
    for shape, fmt in ((r"^[0-9]{4}-", "yyyy-MM-dd"), (r"\.", "dd.MM.yyyy"), ("/", "MM/dd/yyyy")):
        day = F.datediff(F.try_to_timestamp(m, F.lit(fmt)).cast("date"), F.lit(FIRST_DAY).cast("date"))
        new = _once(feistel(key, F.lit("date"), F.floor(day / DAYS[1]), day % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1])),
                    lambda s: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAYS[1] + s["b"]).cast("int")), fmt))
        out = F.when(m.rlike(shape), F.when(day.between(0, DAYS[0] * DAYS[1] - 1), new)).otherwise(out)
    return out


def _hashed(key: str, kind: str, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value).cast("binary"), 256)


def _email(key: str, m: Column) -> Column:
    return F.concat(F.lit("id"), F.substring(_hashed(key, "email", F.lower(m)), 1, 16), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(key: str, m: Column) -> Column:
    return F.when(m.rlike("[0-9]") & m.rlike("[a-fA-F]"), F.substring(_hashed(key, "secret", F.lower(m)), F.lit(1), F.length(m)))


def kind_of(m: Column) -> Column:
    whole = lambda p: m.rlike(f"^(?:{p})$")
    out = F.when(m.contains("@"), "email")
    for k in ("secret", "ip", "date", "ssn", "phone"):
        out = out.when(whole(PATTERNS[k]) if k != "secret" else whole(PATTERNS[k]) & m.rlike("[a-fA-F]"), k)
    return out.otherwise("card")


def pseudonym(key: str, m: Column) -> Column:
    """(kind, value) of a candidate; the value is null if it fails its kind's validation."""
    kinds = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}

    def value(k: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, f in kinds.items():
            out = F.when(k == name, f(key, m)).otherwise(out)
        return F.struct(k.alias("kind"), out.alias("value"))
    return _once(kind_of(m), value)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data in the text under pseudonyms, and ``pii_kinds``."""
    t = F.col(f"`{text}`")
    rest = [c for c in docs.columns if c != text and c.lower() != "pii_kinds"]
    found = F.when(t.rlike(ANY), F.regexp_extract_all(t, F.lit(ANY), 0))
    d = docs.select(F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in rest]).alias("row"), t.alias("t"), found.alias("found"))
    d = d.withColumn("new", F.transform("found", lambda m: _with_old(key, m)))
    between = F.split("t", ANY, -1)
    joined = F.array_join(F.transform(F.arrays_zip(between.alias("x"), F.col("new").alias("y")), lambda z: F.concat(z["x"], F.coalesce(z["y"]["value"], z["y"]["old"], F.lit("")))), "")
    out = F.when(F.col("new").isNull(), F.col("t")).otherwise(joined)
    kinds = F.coalesce(F.transform(F.filter("new", lambda x: x["value"].isNotNull()), lambda x: x["kind"]), F.array().cast("array<string>"))
    return d.select(*[out.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c == text or c in rest], kinds.alias("pii_kinds"))


def _with_old(key: str, m: Column) -> Column:
    return _once(pseudonym(key, m), lambda p: F.struct(m.alias("old"), p["kind"].alias("kind"), p["value"].alias("value")))
