"""Stated quantities to common units (problem 5).

A small grammar reads a text into tokens (numbers, scale words, units, range and bound words). Units are
exponent vectors over the base dimensions (money, time, mass, ...) with a scale and an offset to the canonical unit; scale
words are units without dimension, and what is stated is the product of its units. A statement counts only if its
dimensions are those asked for: pay is money per time, canonical in whole money units per year, so that hours a week,
distances, shares or temperatures are no pay.

Defined results: NULL, empty texts and texts without an amount give no row; texts of any length are read whole; digits of
any script count. Bounds open on one side give -1 there. Repeated rows give repeated results, extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = -1
MAX_PERIODS = 1000


@dataclass(frozen=True)
class Unit:
    """``value * scale + offset`` is the value in canonical units; ``dims`` are exponents by base dimension."""

    dims: tuple[tuple[str, int], ...]
    scale: Decimal = Decimal(1)
    offset: Decimal = Decimal(0)

    def __mul__(self, other: Unit) -> Unit:
        if self.offset or other.offset:
            raise ValueError("units with an offset cannot be combined")
        total = dict(self.dims)
        for d, e in other.dims:
            total[d] = total.get(d, 0) + e
        return Unit(tuple(sorted((d, e) for d, e in total.items() if e)), self.scale * other.scale)

    def canonical(self, value: Decimal) -> Decimal:
        return value * self.scale + self.offset


def per(times_a_year: int | str) -> Unit:
    """A rate unit: so many periods in the canonical year."""
    return Unit((("time", -1),), Decimal(times_a_year))


MONEY, NUMBER = Unit((("money", 1),)), Unit(())
PAY = (("money", 1), ("time", -1))


def scaled(times: int) -> Unit:
    """A unit without dimension, as a scale word is."""
    return Unit((), Decimal(times))


# Units of other quantities a note may state, by their words; a number with one of them is no amount of money.
_HOUR = Decimal(1) / Decimal(8766)
OTHER = {
    "hours|hour|hrs|hr|stunden|小時": Unit((("time", 1),), _HOUR), "minutes|minute|mins": Unit((("time", 1),), _HOUR / 60), "days|tage": Unit((("time", 1),), _HOUR * 24), "weeks|wochen": Unit((("time", 1),), _HOUR * 168), "km": Unit((("length", 1),), Decimal(1000)),
    "metres|meters": Unit((("length", 1),)), "miles": Unit((("length", 1),), Decimal("1609.344")), "kg": Unit((("mass", 1),)), "lbs|lb": Unit((("mass", 1),), Decimal("0.45359237")), "°c": Unit((("temperature", 1),), Decimal(1), Decimal("273.15")),
    "°f": Unit((("temperature", 1),), Decimal(5) / Decimal(9), Decimal("459.67") * 5 / 9), "%|percent|per cent": Unit((("share", 1),), Decimal("0.01")), "people|persons|staff|staffs": Unit((("people", 1),)),
}
_OTHER = {w: u for words, u in OTHER.items() for w in words.split("|")}


def quantity(text: str) -> tuple[Decimal, Unit] | None:
    """A number with the unit of another quantity: its canonical value and unit; None if the text is none."""
    m = re.fullmatch(rf"\s*(-?{_NUM})\s*({'|'.join(map(re.escape, sorted(_OTHER, key=len, reverse=True)))})\s*", text.lower())
    return (_OTHER[m[2]].canonical(number(m[1])), _OTHER[m[2]]) if m else None


# Currency words, longest first, with their ISO code.
CURRENCIES = [
    ("hong kong dollars", "HKD"), ("hong kong dollar", "HKD"), ("singapore dollars", "SGD"), ("us dollars", "USD"), ("hk dollars", "HKD"), ("hk dollar", "HKD"),
    ("pounds sterling", "GBP"), ("renminbi", "CNY"), ("pounds", "GBP"), ("euros", "EUR"), ("euro", "EUR"), ("h.k.$", "HKD"), ("hk$", "HKD"), ("hkd", "HKD"),
    ("港幣", "HKD"), ("港币", "HKD"), ("港元", "HKD"), ("us$", "USD"), ("usd", "USD"), ("美元", "USD"), ("美金", "USD"), ("s$", "SGD"), ("sgd", "SGD"), ("新加坡元", "SGD"),
    ("坡幣", "SGD"), ("rmb¥", "CNY"), ("rmb", "CNY"), ("cny", "CNY"), ("人民幣", "CNY"), ("人民币", "CNY"), ("¥", "CNY"), ("￥", "CNY"), ("gbp", "GBP"), ("£", "GBP"),
    ("英鎊", "GBP"), ("eur", "EUR"), ("€", "EUR"), ("歐元", "EUR"), ("$", "HKD"),
]
# Scale words.
SCALES = {"k": 1000, "m": 10**6, "mio": 10**6, "million": 10**6, "mn": 10**6, "万": 10**4, "萬": 10**4, "千": 1000}
# Period words by the name of the period table.
PERIODS = {
    "fortnight": [r"(?:every|each|per)\s+two\s+weeks", r"/\s*2\s*w(?:ee)?ks?", r"(?:per|a|/)\s*fortnight", r"fortnightly", r"bi-?weekly", r"每兩週", r"雙週薪"],
    "hour": [r"(?:per|an|every|each|/|je|pro)\s*(?:hour|hr|h|stunde|std)\b\.?", r"hourly", r"p\.?\s?h\.?(?![a-z])", r"時薪", r"每小時", r"stündlich", r"pro stunde"],
    "day": [r"(?:per|a|every|each|/)\s*(?:day|d)\b", r"daily", r"日薪", r"每日", r"每天", r"täglich", r"pro tag"],
    "week": [r"(?:per|a|every|each|/)\s*(?:week|wk)\b\.?", r"weekly", r"週薪", r"周薪", r"每週", r"每周", r"p\.?w\.?(?![a-z])"],
    "month": [r"(?:per|a|every|each|/|im|pro)\s*(?:month|mth|mo|monat)\b\.?", r"monthly", r"monatlich", r"pcm\b", r"p\.\s?m\.?", r"pm\b", r"月薪", r"每月"],
    "year": [r"(?:per|a|every|each|/|im|pro)\s*(?:year|yr|annum|jahr)\b\.?", r"annually", r"yearly", r"p\.\s?a\.?", r"pa\b", r"年薪", r"每年", r"jährlich"],
}

_CUR = "|".join(re.escape(w) for w, _ in CURRENCIES)
_PER = "|".join(f"(?P<per_{n}>{'|'.join(ps)})" for n, ps in PERIODS.items())
_NUM = r"\d{1,3}(?:[\s  '’]\d{3})+(?!\d)(?:[.,]\d{1,2}(?!\d))?|\d{1,3}(?:,\d{3})+(?!\d)(?:\.\d+)?|\d{1,3}(?:\.\d{3})+(?!\d)(?:,\d{1,2}(?!\d))?|\d+(?:[.,]\d+)?"
_UNIT = "|".join(map(re.escape, sorted(_OTHER, key=len, reverse=True)))
#: One token of the grammar. Phrases whose numbers are no amounts come first.
TOKEN = re.compile(
    r"(?P<noise>\d+\s*-?\s*day(?:s)?\s+(?:work|week|in arrears)\b|\d+(?:st|nd|rd|th)\s+month(?:\s+pay)?|\d+\s+days\b|\+\s*(?:bonus|commission|tips|benefits)|plus\s+commission)"
    rf"|(?P<pays>[x×*]\s*(?P<npays>\d{{1,2}})\s*(?:months?|monthly|pays|salaries|個月|个月))"
    rf"|(?P<period>{_PER})"
    r"|(?P<upto>up\s+to|not\s+more\s+than|no\s+more\s+than|at\s+most|max(?:imum)?\.?|最高|bis\s+zu)"
    r"|(?P<from>from|min(?:imum)?\.?|at\s+least|not\s+less\s+than|starting\s+at|最低|ab\b)"
    rf"|(?P<cur>{_CUR})"
    rf"|(?P<num>{_NUM})(?:\s*(?P<scale>million|mio|mn|k|m|万|萬|千)(?![a-z.]))?(?:\s*(?P<unit>{_UNIT})(?![a-z]))?"
    r"|(?P<range>-|–|—|~|〜|～|to\b|bis\b|至)"
    r"|(?P<plus>\+|以上|起)"
)


def number(text: str) -> Decimal:
    """A written number: groups of three after comma, dot or blank are thousands, a shorter last group is a fraction."""
    t = re.sub(r"[\s  '’]", "", text)
    if re.fullmatch(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", t):
        return Decimal(t.replace(",", ""))
    if re.fullmatch(r"\d{1,3}(?:\.\d{3})+(?:,\d+)?", t):
        return Decimal(t.replace(".", "").replace(",", "."))
    return Decimal(t.replace(",", "."))


@dataclass
class Statement:
    """What one text says: up to two amounts, their bound, currency, period and pays a year."""

    low: Decimal | None = None
    high: Decimal | None = None
    bound: str = "exact"
    currency: str | None = None
    period: str | None = None
    pays: int | None = None
    seen: list[str] = field(default_factory=list)


def parse(text: str | None) -> Statement | None:
    """Read a pay note; None if it states no amount."""
    if not text or not any(ch.isdigit() for ch in text):
        return None
    st, numbers, joined = Statement(), [], False
    for m in TOKEN.finditer(unicodedata.normalize("NFKC", text).lower()):
        kind = m.lastgroup
        if m["noise"]:
            continue
        if m["pays"]:
            st.pays = int(m["npays"])
        elif m["period"]:
            st.period = st.period or next(n for n in PERIODS if m[f"per_{n}"])
        elif m["upto"]:
            st.bound = "upto"
        elif m["from"]:
            st.bound = "from" if st.bound == "exact" else st.bound
        elif m["cur"]:
            st.currency = st.currency or dict(CURRENCIES)[m["cur"]]
        elif m["num"]:
            if m["unit"] and (_OTHER[m["unit"]] * MONEY).dims != MONEY.dims:
                continue  # a quantity of another kind
            if len(numbers) < 2 and (not numbers or joined):
                scale = m["scale"]
                raw = m["num"]
                value = Decimal(raw.replace(",", ".")) if scale and re.fullmatch(r"\d{1,3}[.,]\d{3}", raw) and not raw.startswith("0") and SCALES[scale] >= 10**4 else (Decimal(raw) if scale and re.fullmatch(r"\d+\.\d+", raw) else number(raw))
                if raw.startswith("0."):
                    value = Decimal(raw)
                numbers.append((value, scale, raw))
        elif kind == "range":
            joined = joined or bool(numbers)
        elif m["plus"] and numbers:
            st.bound = "from"
    if not numbers:
        return None
    if len(numbers) == 2 and numbers[1][1] and not numbers[0][1]:
        # the scale word of a range stands once; before a large one a dot is a decimal point
        (low, _, raw), (high, scale, _) = numbers
        if SCALES[scale] >= 10**4 and re.fullmatch(r"\d{1,3}[.,]\d{3}", raw):
            low = Decimal(raw.replace(",", "."))
        if low <= high:
            numbers[0] = (low, scale, raw)
    values = [scaled(SCALES[s]).canonical(v) if s else v for v, s, _ in numbers]
    st.low, st.high = values[0], values[-1]
    return st


# What a sentence that states the terms of pay speaks of.
_TERMS = r"\b(?:pay|pays|paid|salary|salaries|wages?|earnings|remuneration|amounts?|rates?|figures?|gehalt|gehälter|lohn)\b|薪|工資"
_SENTENCE_END = r"[.!?;\n<>。；]"
#: Sentences with one of these words are cut out in the JVM, so that whole texts never travel to Python.
TERMS_JVM = rf"(?iu){_TERMS}"


_CUR_WORD, _PER_WORD = re.compile(_CUR, re.I), re.compile("|".join(p for ps in PERIODS.values() for p in ps), re.I)


def terms_of(advert: str | None) -> tuple[str | None, str | None]:
    """``(currency, period)`` of the first sentence that speaks of pay and names both, without stating an amount."""
    for sentence in re.split(_SENTENCE_END, (advert or "").replace("&amp;", "and")):
        if not (_CUR_WORD.search(sentence) and _PER_WORD.search(sentence) and re.search(_TERMS, sentence, re.I)):
            continue
        currency = period = None
        for m in TOKEN.finditer(unicodedata.normalize("NFKC", sentence).lower()):
            currency = currency or (dict(CURRENCIES)[m["cur"]] if m["cur"] else None)
            period = period or (next(n for n in PERIODS if m[f"per_{n}"]) if m["period"] else None)
        if currency and period:
            return currency, period
    return None, None


def yearly(text: str | None, advert: str | None, per_year: dict[str, int]) -> tuple[str, int, int] | None:
    """``(currency, year_min, year_max)`` of a pay note, helped by the advert's own terms; None if it is not money per time."""
    st = parse(text)
    if st is None:
        return None
    currency, period = st.currency, st.period or ("month" if st.pays else None)
    if currency is None or period is None:
        said = terms_of(advert)
        currency, period = currency or said[0] or "HKD", period or said[1]
    unit = MONEY if period not in per_year else MONEY * per(st.pays if st.pays and period == "month" else per_year[period])
    if unit.dims != PAY:
        return None
    whole = lambda v: int(unit.canonical(v).quantize(Decimal(1), ROUND_HALF_UP))
    low, high = whole(st.low), whole(st.high)
    if st.bound == "upto":
        return currency, OPEN, high
    return currency, low, OPEN if st.bound == "from" else high


def found(jobs: DataFrame, periods: DataFrame) -> DataFrame:
    """One row ``(internal_id, currency, year_min, year_max)`` for each note that states an amount.

    ``periods`` is the fixed table of at most a few dozen rows; it becomes a dictionary of the tasks.
    """
    known = periods.select("period", "per_year").limit(MAX_PERIODS + 1).collect()
    if len(known) > MAX_PERIODS:
        raise ValueError(f"more than {MAX_PERIODS} periods")
    per_year = {r["period"]: r["per_year"] for r in known}
    note = F.col("salary_description")
    sentences = F.split(F.replace("description", F.lit("&amp;"), F.lit("and")), _SENTENCE_END)
    advert = F.array_join(F.filter(sentences, lambda x: x.rlike(TERMS_JVM)), "\n")
    rows = jobs.filter(note.rlike(r"\p{Nd}")).select("internal_id", note.alias("note"), advert.alias("advert"))

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, *y) for i, n, a in zip(b["internal_id"], b["note"], b["advert"], strict=True) if (y := yearly(n, a, per_year))]
            yield pd.DataFrame(out, columns=["internal_id", "currency", "year_min", "year_max"])

    return rows.mapInPandas(convert, "internal_id bigint, currency string, year_min bigint, year_max bigint")


def pay_or_review(jobs: DataFrame, periods: DataFrame) -> DataFrame:
    """``(internal_id, currency, year_min, year_max, review)`` of each row with a note: no range and a flag where the note holds
    a number but states no pay."""
    noted = jobs.filter(F.col("salary_description").rlike(r"\p{Nd}")).select("internal_id")
    return noted.join(found(jobs, periods), "internal_id", "left").withColumn("review", F.col("currency").isNull())


def place_or_review(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``(internal_id, place, review)``: the "Country - City" a location names letter by letter but for case and outer blanks, or
    no place and a flag. ``places (city, name)`` is a fixed list, hence the broadcast."""
    forms = places.select(F.explode(F.array(F.lower("name"), F.lower("city"))).alias("k"), F.col("name").alias("place")).groupBy("k").agg(F.max("place").alias("place"))
    return rows.withColumn("k", F.lower(F.trim("location"))).join(F.broadcast(forms), "k", "left").select("internal_id", "place", F.col("place").isNull().alias("review"))
