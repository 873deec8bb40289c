"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Validated numbers and dates are permuted by a keyed Feistel network within their own format, so an
equal value gets an equal pseudonym in every document, different ones stay different, and the layout
(spaces, dashes, number of digits) stays. The kinds, in the order in which a match is tried:

  email  letters and digits of the local part, and of the domain but for its last label, each within
         its class (a-z, A-Z, 0-9)
  ipv4   four numbers of 0 to 255: the 32 bits
  date   yyyy-mm-dd, dd/mm/yyyy or mm/dd/yyyy, a calendar day of 1800 to 2199: its day number among those
  ssn    ddd-dd-dddd of a valid area, group and serial: among all such
  phone  +country and 6 or more digits, (ddd) ddd-dddd, ddd-ddd-dddd or ddd.ddd.dddd: all digits but
         the country's
  card   13 to 19 digits with a valid check digit (mod 10): all but the last, which is computed anew;
         so a valid number becomes a valid one
  digits 13 to 19 digits without one: all of them
  hex    32 to 64 hexadecimal digits of one case, with a digit: all of them, within their 16

What fails its validation (octets over 255, 31 February, an area of 666) stays as it is. Null stays
null and empty stays empty; ties and repeated rows get equal pseudonyms; an empty table gives an
empty result; extra columns are passed over; texts of any length are searched whole. The plan holds
keys derived from the given one by HMAC, not that key itself. Texts without a digit and without @ are not searched.
"""

from __future__ import annotations

import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: 400 Gregorian years from FIRST_DAY have 189 * 773 days.
FIRST_DAY = "1800-01-01"
DAYS = (189, 773)

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
DATE = r"(?<![\d/\-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\d/]|-\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)"
PHONE = r"\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,3}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?!\d|[.\-]\d)"
LONG = r"(?<![\dA-Za-z])\d(?:[ \-]?\d){12,18}(?![\dA-Za-z])"
HEX = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
ANY = "|".join((EMAIL, IPV4, DATE, SSN, PHONE, LONG, HEX))


def own_key(key: str) -> str:
    """64 hexadecimal digits for one use of a key."""
    return hmac.new(key.encode(), b"feistel", "sha256").hexdigest()


def _number(key: str, *parts: Column) -> Column:
    """A keyed number below 2 ** 60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(own_key(key)), *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, left: Column | int, right: Column | int, key: str) -> Column:
    """struct(a, b) for 0 <= a < left and 0 <= b < right: a keyed permutation of all such pairs, each half in turn moved by a function of the other."""
    left, right = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (left, right))

    def step(x: Column, r: Column) -> Column:
        move = lambda half: _number(key, r, left, right, half)
        even = r % 2 == 0
        return F.struct(F.when(even, (x["a"] + move(x["b"])) % left).otherwise(x["a"]).alias("a"), F.when(even, x["b"]).otherwise((x["b"] + move(x["a"])) % right).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def with_digits(form: Column, digits: Column) -> Column:
    """form, with its digits replaced one by one by those of `digits`."""
    return F.array_join(F.zip_with(F.split(form, "[0-9]", -1), F.concat(F.split(digits, ""), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def permuted_digits(digits: Column, key: str) -> Column:
    """A permutation of all strings of as many digits (2 to 19)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    tens = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    pair = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n), tens(half), tens(n - half), key)
    return F.transform(F.array(pair), lambda x: F.concat(F.lpad(x["a"].cast("string"), half, "0"), F.lpad(x["b"].cast("string"), n - half, "0")))[0]


def check_sum(digits: Column, doubled: int) -> Column:
    """Sum mod 10 of the digits, every other one doubled (its digits added), from the right: from the first if doubled is 0, from the second if 1."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == doubled, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")).cast("long"))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x) % 10


def card(digits: Column, key: str) -> Column:
    body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key)
    return F.transform(F.array(body), lambda x: F.concat(x, ((10 - check_sum(x, 0)) % 10).cast("string")))[0]


def moved_letter(c: Column, k: Column) -> Column:
    """A letter or digit, k places on within a-z, A-Z or 0-9."""
    move = lambda first, size: F.chr(F.lit(first) + (F.ascii(c) - first + k) % size)
    return F.when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26)).when(c.between("0", "9"), move(48, 10)).otherwise(c)


def moved_hex(c: Column, k: Column) -> Column:
    """A hexadecimal digit in lower case, k places on among the 16."""
    return F.substring(F.lit("0123456789abcdef"), (F.conv(c, 16, 10).cast("int") + k) % 16 + 1, F.lit(1))


def permuted_letters(text: Column, key: str, moved: Callable[[Column, Column], Column] = moved_letter) -> Column:
    """A permutation of all strings with the same classes of characters in the same places: a Feistel network whose halves are shifted character by character."""

    def shifted(half: Column, other: Column, r: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(own_key(key)), r.cast("string"), F.length(half).cast("string"), other), 256)
        one = lambda c, i: moved(c, F.conv(F.substring(stream, i % 62 + 1, F.lit(3)), 16, 10).cast("int"))
        return F.array_join(F.transform(F.split(half, ""), one), "")

    def step(x: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(F.when(even, shifted(x["a"], x["b"], r)).otherwise(x["a"]).alias("a"), F.when(even, x["b"]).otherwise(shifted(x["b"], x["a"], r)).alias("b"))

    half = F.ceil(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: F.concat(x["a"], x["b"]))


def email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    domain = F.substring(m, at + 1, F.length(m))
    last = F.length(domain) - F.length(F.substring_index(domain, ".", -1))
    return F.concat(permuted_letters(F.substring(m, F.lit(1), at - 1), f"{key}|local"), F.lit("@"), permuted_letters(F.substring(domain, F.lit(1), last), f"{key}|domain"), F.substring(domain, last + 1, F.length(domain)))


def ipv4(m: Column, key: str) -> Column:
    octet = F.transform(F.split(m, r"\."), lambda c: c.cast("int"))
    pair = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], 65536, 65536, f"{key}|ipv4")
    found = F.transform(F.array(pair), lambda x: F.concat_ws(".", *(v.cast("string") for h in ("a", "b") for v in (F.floor(x[h] / 256), x[h] % 256))))[0]
    return F.when(F.forall(octet, lambda o: o <= 255), found).otherwise(m)


def date(m: Column, key: str) -> Column:
    tries = [(form, F.to_date(F.try_to_timestamp(m, F.lit(form)))) for form in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")]
    out = m
    for form, day in reversed(tries):
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        pair = feistel(F.floor(n / DAYS[1]), n % DAYS[1], *DAYS, f"{key}|date")
        moved = F.transform(F.array(pair), lambda x: x["a"] * DAYS[1] + x["b"])[0]
        written = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int")), form)
        out = F.when(F.coalesce(n.between(0, DAYS[0] * DAYS[1] - 1), F.lit(False)), written).otherwise(out)
    return out


def ssn(m: Column, key: str) -> Column:
    area, group, serial = (part.cast("int") for part in (F.substring(m, 1, 3), F.substring(m, 5, 2), F.substring(m, 8, 4)))
    pair = feistel(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, f"{key}|ssn")
    written = F.transform(F.array(pair), lambda x: F.format_string("%03d-%02d-%04d", F.when(x["a"] >= 665, x["a"] + 2).otherwise(x["a"] + 1), F.floor(x["b"] / 9999) + 1, x["b"] % 9999 + 1))[0]
    return F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), written).otherwise(m)


def phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^(\+\d{1,3}(?=[ .\-(])|\+\d|)", 1)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    return F.concat(country, with_digits(rest, permuted_digits(F.regexp_replace(rest, "[^0-9]", ""), f"{key}|phone")))


def long_number(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return with_digits(m, F.when(check_sum(digits, 1) == 0, card(digits, f"{key}|card")).otherwise(permuted_digits(digits, f"{key}|digits")))


def hexadecimal(m: Column, key: str) -> Column:
    found = permuted_letters(F.lower(m), f"{key}|hex", moved_hex)
    return F.when(~m.rlike("[0-9]"), m).when(m.rlike("[A-F]"), F.upper(found)).otherwise(found)


def pseudonym(m: Column, key: str) -> Column:
    """What stands in for a match of ANY."""
    whole = lambda pattern: m.rlike(f"^(?:{pattern})$")
    kinds = ((EMAIL, email), (IPV4, ipv4), (DATE, date), (SSN, ssn), (PHONE, phone), (LONG, long_number))
    chosen = F.when(F.lit(False), m)
    for pattern, make in kinds:
        chosen = chosen.when(whole(pattern), make(m, key))
    return chosen.otherwise(hexadecimal(m, key))


def replaced(text: Column, key: str) -> Column:
    """struct(text, n): the text with pseudonyms, and how many there are; matches are found once."""
    apart = F.struct(F.split(text, ANY, -1).alias("between"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("found"))

    def joined(x: Column) -> Column:
        stand_ins = F.concat(F.transform(x["found"], lambda m: pseudonym(m, key)), F.array(F.lit("")))
        return F.struct(F.array_join(F.zip_with(x["between"], stand_ins, lambda a, b: F.concat(a, b)), "").alias("text"), F.size(x["found"]).alias("n"))

    return F.when(text.rlike("[0-9@]"), F.transform(F.array(apart), joined)[0]).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))


def replace(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (with pseudonyms), n_matches of every row of docs (doc_id, text)."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), replaced(F.col("text"), key).alias("x"))
    return found.select("doc_id", "x.text", F.col("x.n").alias("n_matches"))
