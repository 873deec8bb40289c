"""What is printed: item rows without columns, amounts in running text, labels, broken answers (F-32, F-35 .. F-39).

All but F-35 and F-39, which read one text at a time, are Column builders. Null gives null; a text that doesn't have the form gives null, never an error.
"""

from __future__ import annotations

import json
import re
from collections import deque
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import normalize as N
from tallyforge.functions.normalize import let

# Forms and bounds that results depend on.
AMOUNT = r"\d[\d,]*\.\d{2}"
COUNT = r"\d[\d,]*(?:\.\d+)?"
UNIT = r"[A-Za-zก-๎][A-Za-z0-9ก-๎./-]{0,11}"
CURRENCY_WORDS = r"(?i)(?<![A-Za-z0-9_])(THB|BAHT)(?![A-Za-z0-9_])|฿|บาท"
FRAGMENT_SHARE = 0.35
MOST_CUTS = 60


def plain_number(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("decimal(18,4)")


def single_amount(c: Column) -> Column:
    """F-36: the one number in a text as decimal(18,4); null if there is none or more than one."""
    found = F.regexp_extract_all(N.arabic(c), F.lit(COUNT), F.lit(0))
    several = let(found, lambda f: F.when(F.size(f) == 1, plain_number(F.get(f, F.lit(0)))))
    return F.when(c.rlike(rf"^{COUNT}$"), F.replace(c, F.lit(",")).try_cast("decimal(18,4)")).otherwise(several)  # most are nothing but a number


def closing_order(numbers: Column, cents: int = 1) -> Column:
    """Which of three unlabelled numbers (array of decimal) are quantity, price and amount: struct(qty, price, amount) if exactly one assignment closes.

    All assignments are tried; two that differ in their numbers, and not only in which of quantity and price is which, are
    ambiguous and give null. Where both orders of the factors close, the one printed first is the quantity.
    """
    within = F.lit(cents).cast("decimal(10,2)") / 100
    tries = [F.struct(F.get(numbers, F.lit(i)).alias("qty"), F.get(numbers, F.lit(j)).alias("price"), F.get(numbers, F.lit(k)).alias("amount")) for i, j, k in permutations(range(3)) if i < j]
    closing = F.array_distinct(F.filter(F.array(*tries), lambda t: F.coalesce(F.abs(t["qty"] * t["price"] - t["amount"]) <= within, F.lit(False))))
    return F.when((F.size(numbers) == 3) & (F.size(closing) == 1), F.get(closing, F.lit(0)))


_CURRENCY, _SPACE = re.compile(CURRENCY_WORDS, re.A), re.compile(r"\s+", re.A)
#: Most texts have neither currency words nor spaces to squeeze, which is found sooner.
_MAY_BE_CURRENCY, _UNEVEN = re.compile("[Tt][Hh][Bb]|[Bb][Aa][Hh][Tt]"), re.compile(r"[\t-\r]|  ")
_AMOUNT, _UNIT, _PLAIN = re.compile(AMOUNT, re.A), re.compile(UNIT, re.A), re.compile(r"\d+(?:\.\d+)?", re.A)
_COUNT_END, _UNIT_END = re.compile(rf"{COUNT}\Z", re.A), re.compile(rf"{UNIT}\Z", re.A)
_ARABIC = str.maketrans(N.THAI_DIGITS, "0123456789")
ROW_CELLS = ("description", "qty", "uom", "unit_price", "amount")


def _ten_thousandths(number: str) -> int | None:
    """A printed number as decimal(18,4) holds it, times 10,000; null if it is too large."""
    whole, _, rest = number.replace(",", "").partition(".")
    value = int(whole + rest[:4].ljust(4, "0")) + (rest[4:5] >= "5")
    return value if value < 10**18 else None


def row_of(text: str | None) -> tuple[str | None, str, str, str, str] | None:
    """F-35 of one row: ROW_CELLS, or null."""
    if text is None:
        return None
    if not text.isascii() or _MAY_BE_CURRENCY.search(text):
        text = _CURRENCY.sub(" ", text).translate(_ARABIC)
    text = (_SPACE.sub(" ", text) if _UNEVEN.search(text) else text).strip(" ")
    words = text.split(" ")
    amounts = 0
    while amounts < min(3, len(words) - 2) and _AMOUNT.fullmatch(words[-1 - amounts]):
        amounts += 1
    for unit_first in (False, True):
        for n in range(amounts, 1, -1):
            before, after = words[-n - 2], words[-n - 1]
            qty, unit = (_PLAIN.fullmatch(after), _UNIT_END.search(before)) if unit_first else (_COUNT_END.search(before), _UNIT.fullmatch(after))
            if not qty or not unit:
                continue
            q, u, money = qty[0], unit[0], words[-n:]
            behind = sum(map(len, money)) + n + 1 + len(u) + len(q)
            return text[: len(text) - behind].strip(" ") or None, q, u, _price(q, money), money[-1]
    return None


def _price(qty: str, money: list[str]) -> str:
    if len(money) == 2:
        return money[0]
    q, first, second, amount = map(_ten_thousandths, (qty, *money))
    closes = lambda v: None not in (q, v, amount) and abs(q * v - amount * 10_000) <= 1_000_000
    return money[0] if not closes(second) and (closes(first) or second == 0) else money[1]


def row_cells(c: Column) -> Column:
    """F-35: struct(description, qty, uom, unit_price, amount), as printed, of an item row that ends in them; else null.

    The row ends in two or three amounts. Before them stand quantity and unit, or unit and quantity. Of three
    amounts the last one is the row's; the price is the second if quantity times it gives the row's amount to the cent, else
    the first if that does, else the second unless it is zero.
    """
    kind = pa.struct([(n, pa.string()) for n in ROW_CELLS])

    @F.arrow_udf(", ".join(f"{n} string" for n in ROW_CELLS))
    def run(texts: pa.Array) -> pa.Array:
        found = [row_of(t) for t in texts.to_pylist()]
        columns = zip(*(r or (None,) * len(ROW_CELLS) for r in found), strict=True) if found else ([],) * len(ROW_CELLS)
        return pa.StructArray.from_arrays([pa.array(v, pa.string()) for v in columns], fields=list(kind), mask=pa.array([r is None for r in found], pa.bool_()))

    return run.asNondeterministic()(c)  # so that a filter on the result doesn't read each row a second time


def without_label(c: Column) -> Column:
    """F-32: a company's name from its legal form on, unless an English company name stands before it."""
    start = F.greatest(F.instr(c, "บริษัท"), F.when(F.instr(c, "บริษัท") == 0, F.instr(c, "ห้างหุ้นส่วน")).otherwise(0))
    english = F.substring(c, F.lit(1), start - 1).rlike(r"(?i)(?<![A-Za-z0-9_])(CO\.(?=[A-Za-z0-9_])|(COMPANY|LTD|LIMITED|CORP|INC)(?![A-Za-z0-9_]))")
    return F.when((start > 1) & ~english, F.trim(F.substring(c, start, F.length(c)))).otherwise(c)


def fragment_share(c: Column) -> Column:
    """F-37: the share of words that are one or two Thai characters; 0 without words."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: (F.length(w) <= 2) & w.rlike("[฀-๿]"))), F.size(words)), F.lit(0.0))


def unreliable(c: Column) -> Column:
    """F-37: whether a text layer's reader abstains."""
    return fragment_share(c) >= FRAGMENT_SHARE


def money_string(c: Column) -> Column:
    """F-38: two decimals, or as many more as a decimal value has."""
    short = c.cast("decimal(18,2)")
    return F.when(c == short, short.cast("string")).otherwise(F.regexp_replace(c.cast("string"), r"0+$", ""))


# --- F-39 ------------------------------------------------------------------------------------------

_ASIDE = re.compile(r"<(think|thinking|reasoning)>.*?</\1>", re.S | re.I)
_FENCES = re.compile(r"^\s*```(?:json)?\s*|\s*```\s*$", re.I)
_CLOSER = {"{": "}", "[": "]"}
#: What counts of JSON: strings (also one without an end), which hide what is in them, and brackets and commas outside.
_TOKENS = re.compile(r'"(?:[^"\\]++|\\.)*+(?:"|\\?\Z)|\\[\\"]|[{}\[\],]', re.S)
_COMMA = re.compile(r",\s*([}\]])", re.A)
_DECODER = json.JSONDecoder()


def _parsed(piece: str) -> str | None:
    for tried in (piece, _COMMA.sub(r"\1", piece)):  # with a comma before a closing bracket only if it isn't JSON as it is
        try:
            return json.dumps(json.loads(tried), ensure_ascii=False)
        except ValueError:
            continue
    return None


def recovered(text: str | None, members: bool = False) -> str | None:
    """F-39: the first JSON object in an answer; of one that is cut off, what is complete, its open brackets closed; null if there is nothing.

    What is complete ends with an object; with `members`, at the last complete member of any kind.
    """
    bare = _ASIDE.sub("", text or "") if "<" in (text or "") else text or ""
    bare = (_FENCES.sub("", bare) if "```" in bare else bare).strip()
    start = bare.find("{")
    if start < 0:
        return None
    try:  # most objects that are whole are JSON as they are
        return json.dumps(_DECODER.raw_decode(bare, start)[0], ensure_ascii=False)
    except ValueError:
        pass
    depth, last = 0, {}  # last: the bracket that opened last at each depth; one still open there is it
    cuts: deque[tuple[int, str]] = deque(maxlen=MOST_CUTS)
    for found in _TOKENS.finditer(bare, start):
        token = found[0]
        if token in _CLOSER:
            depth += 1
            last[depth] = token
            continue
        if token in ("}", "]"):
            depth -= 1
            if token == "}" and depth == 0:
                return _parsed(bare[start : found.end()])
        if token == "}" or (members and token in ("]", ",")):
            end = found.start() if token == "," else found.end()
            cuts.append((end, "".join(_CLOSER[last[d]] for d in range(depth, 0, -1))))
    for end, closing in reversed(cuts):
        piece = _parsed(bare[start:end] + closing)
        if piece is not None:
            return piece
    return None


def recovered_json(c: Column, members: bool = False) -> Column:
    """F-39 over a column, a batch of texts at a time."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recovered(t, members)).astype(object)

    return run(c)
