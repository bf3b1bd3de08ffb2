"""Variant spellings of employer names (problem 2).

Method: names are cut into tokens (legal words dropped, short forms spelled out, typos in common business
words repaired, nicknames resolved); they are blocked by phonetic codes of their sorted telling tokens
(the code and its forms with one sound left out; also of the tokens as written, as a stray blank may have cut one),
compared with Jaro-Winkler plus the nickname table, and accepted pairs are clustered by connected components. Trade words
weigh in the comparison: a full name may lack some of the other's, but not have others. A name without business words
("Acme", "The Acme Golden Company") joins an employer only if exactly one fits.

Defined results: NULL, blank and sentinel names never count; equal names are one name; names of any
length are read whole; an empty table gives an empty result; extra columns are ignored. Work is done on
distinct names, so a name's number of rows does not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.llm.components import connected_components
from adlattice.llm.strings import deletions, fold, jaro_winkler, near, neighbourhood, osa
from adlattice.session import cut

SENTINELS = ("", "N/A", "Unknown Company")
# Words that say nothing about who it is.
LEGAL = frozenset("the ltd limited company co inc incorporated gmbh pte plc llc llp corp corporation ag kg sa bv pty hk hong kong branch 有限公司 公司 集團 and ltda kk".split())
TITLES = frozenset("mr ms mrs miss dr prof sir madam".split())
# Words of trades and common additions to firm names.
TRADE_WORDS = frozenset(
    "services golden pacific harbour international trading toy travel air engineering fashion jewellery home textile works cold hotel publishing design pharmacy printing law factory electronics pet dental retail office game furniture "
    "education freight house foods building press marine stores manufacturing storage studio recruitment executive search veterinary logistics water catering security holdings capital medical data solar optical clinic care centre partners "
    "contractors management elderly architects supplies development nutrition consultants group technology software analytics brokers energy insurance homes instruments tutoring agency property staffing global asia eastern western royal "
    "industries industrial chemicals consulting media construction transport shipping finance financial bank express systems solutions networks lighting plastics metals farms bakery restaurant school college academy salon spa garage motors".split()
)
# Short forms of such words.
SHORT = {
    "svcs": "services", "svc": "services", "trdg": "trading", "intl": "international", "edu": "education", "educ": "education", "ctr": "centre", "center": "centre", "sw": "software", "elec": "electronics", "mfg": "manufacturing", "mfr": "manufacturing",
    "sec": "security", "med": "medical", "grp": "group", "mgmt": "management", "mgt": "management", "hldgs": "holdings", "hldg": "holdings", "engrg": "engineering", "engg": "engineering", "eng": "engineering", "dev": "development", "logs": "logistics",
    "ins": "insurance", "tech": "technology", "prop": "property", "conslt": "consultants", "clin": "clinic", "off": "office", "ptnrs": "partners", "ptrs": "partners", "furn": "furniture", "pub": "publishing", "pharm": "pharmacy", "constr": "construction",
    "bldg": "building", "rec": "recruitment", "agcy": "agency", "vet": "veterinary", "arch": "architects", "exec": "executive", "cap": "capital", "anal": "analytics", "nutr": "nutrition", "fin": "finance", "frt": "freight", "stor": "storage",
}
# Given names with their usual short forms.
NICKNAMES = {
    "katherine": "kate katie kathy kat cathy catherine kathryn", "elizabeth": "liz lizzy beth eliza betty lisa", "susanna": "sue susan susie suzanne susannah", "nicholas": "nick nicky nicolas", "alexander": "alex al sandy alec", "margaret": "maggie meg peggy marge margie",
    "edward": "ed eddie ted teddy ned", "robert": "bob bobby rob robbie bert", "josephine": "josie jo joey", "frederick": "fred freddy freddie frederic", "william": "bill will billy willy liam", "theodore": "theo teddy", "james": "jim jimmy jamie",
    "john": "jack johnny jon", "richard": "dick rick ricky richie", "charles": "charlie chuck", "thomas": "tom tommy", "michael": "mike mick mickey", "patricia": "pat patty trish", "jennifer": "jen jenny", "rebecca": "becky becca", "deborah": "deb debbie",
    "samuel": "sam sammy", "benjamin": "ben benny", "daniel": "dan danny", "matthew": "matt", "joseph": "joe", "anthony": "tony", "christopher": "chris kit", "victoria": "vicky vic tori", "dorothy": "dot dottie", "henry": "harry hank", "philip": "phil pip",
}
_GIVEN: dict[str, frozenset[str]] = {}
for _full, _shorts in NICKNAMES.items():
    for _n in (_full, *_shorts.split()):
        _GIVEN[_n] = _GIVEN.get(_n, frozenset()) | {_full}
_TRADE_NEAR = neighbourhood(w for w in TRADE_WORDS if len(w) > 2)
_GIVEN_NEAR = neighbourhood(w for w in NICKNAMES if len(w) > 4)
_TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Form:
    """A name as compared: sorted telling tokens glued, the same as written, given names meant, initial, trade words in order,
    whether it is a short form."""

    key: str
    written: str
    given: frozenset[str]
    initial: str
    trade: tuple[str, ...]
    short: bool


def _trade_word(t: str, repair: bool) -> str | None:
    """The trade word meant, without a plural s; with ``repair`` one typo is allowed."""
    word = t if t in TRADE_WORDS else SHORT.get(t)
    if not word and repair and len(t) > 2 and t not in _GIVEN:
        hit = near(t, _TRADE_NEAR)
        # of words equally near, one of the same letters (a swap) comes first
        hit = sorted((n, sorted(w) != sorted(t), w) for w, n in hit)
        word = hit[0][2] if hit and len(hit[0][2]) > 3 else None
    return re.sub("s$", "", word) if word else None


def parse(name: str) -> Form:
    """Cut a name into its form. ``The X Y Company``, a lone word and initials are short forms.

    A small-letter token behind a capital one, in a name that has capitals elsewhere, continues it (a
    blank that strayed into a word).
    """
    text, pieces = name, name.split()
    if len(pieces) > 2 and pieces[0][:1].isupper() and pieces[1][:1].islower() and pieces[1].isalpha() and sum(p[:1].isupper() for p in pieces) >= 2 and pieces[1] not in TRADE_WORDS:
        text = " ".join([pieces[0] + pieces[1], *pieces[2:]])
    text = fold(text)
    text = re.sub(r"\bhong\s+kong\b", " ", text)
    text = re.sub(r"\((?!hk\))[a-z]{1,6}\)\s*$", " ", text).replace("'", "").replace("s/w", "software").replace("&", " ")
    tokens = _TOKEN.findall(text)
    the_company = tokens[:1] == ["the"] and tokens[-1:] == ["company"]
    legal = " ".join(t for t in tokens if t in LEGAL and t != "the")
    told, trade, given, initial = [], [], frozenset(), ""
    rest = [t for t in tokens if t not in LEGAL and t not in TITLES]
    exact = sum(_trade_word(t, False) is None for t in rest)
    for i, t in enumerate(rest):
        word = _trade_word(t, repair=i > 0 and exact > 1)
        if word:
            trade.append(word)
        elif len(t) == 1 and t.isascii() and t.isalpha() and not initial and len(rest) > 1:
            initial = t
        elif not given and len(rest) > 1 and (t in _GIVEN or (len(t) > 4 and near(t, _GIVEN_NEAR))):
            given = _GIVEN.get(t) or _GIVEN[near(t, _GIVEN_NEAR)[0][0]]
        else:
            told.append(t)
    if not told and given:  # a firm called by a given name only
        told, given = sorted(given), frozenset()
    initials = rest[0] if len(rest) == 1 and re.search(rf"\b{re.escape(rest[0].upper())}\b", name) and 2 <= len(rest[0]) <= 6 and legal else ""
    if initials:
        return Form(initials, initials, frozenset(), legal, (), True)
    return Form("".join(sorted(told)) or "".join(trade), "".join(told) or "".join(trade), given, initial, tuple(trade) if told else (), the_company or (bool(told) and not trade and not given and not initial))


def legal_part(name: str) -> str:
    return " ".join(t for t in _TOKEN.findall(re.sub(r"\bhong\s+kong\b", " ", fold(name))) if t in LEGAL and t != "the")


_SOUND = {c: d for d, cs in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}


def phonetic(key: str) -> str:
    """Digits of the consonants in order; letters outside a-z stand for themselves."""
    out = []
    for c in key:
        d = _SOUND.get(c, "" if c.isascii() else c)
        if d:
            out.append(d)
    return "".join(out) or "0"


def block_keys(key: str) -> set[str]:
    return deletions(phonetic(key))


def _alike(a: str, b: str) -> float:
    """Jaro-Winkler similarity of keys one edit apart (two in long keys), else 0."""
    if a == b:
        return 1.0
    alike = jaro_winkler(a, b)
    return alike if alike >= 0.88 and osa(a, b, 2) <= (1 if min(len(a), len(b)) < 12 else 2) else 0.0


def key_likeness(a: Form, b: Form) -> float:
    """The better likeness of the sorted keys and of the keys as written."""
    return max(_alike(a.key, b.key), _alike(a.written, b.written))


def _given_agree(a: Form, b: Form) -> bool:
    if a.given and b.given:
        return bool(a.given & b.given)
    for x, y in ((a, b), (b, a)):
        if x.initial and y.given:
            return any(g.startswith(x.initial) for g in y.given)
    if a.initial and b.initial:
        return a.initial == b.initial
    return not (a.given or a.initial or b.given or b.initial)


TRADE_WEIGHT, SAME = 0.4, 0.85


def trade_likeness(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Share of the trade words that both have; 0 if each has one that the other has not."""
    x, y = set(a), set(b)
    return (len(x & y) / len(x | y) if x | y else 1.0) if x <= y or y <= x else 0.0


def same_employer(a: Form, b: Form) -> bool:
    """Full names: given names must agree, and telling tokens and trade words, in whatever order, be alike enough together."""
    alike = key_likeness(a, b)
    return alike > 0 and _given_agree(a, b) and (1 - TRADE_WEIGHT) * alike + TRADE_WEIGHT * trade_likeness(a.trade, b.trade) >= SAME


def fits(short: Form, full: Form) -> bool:
    """A short form fits a firm whose telling part agrees and whose trade words begin with those it keeps."""
    if short.initial:
        return False  # initials go by their own rule
    return not full.given and not full.initial and full.trade[: len(short.trade)] == short.trade and key_likeness(short, full) > 0


FORM = "key string, written string, given array<string>, initial string, trade array<string>, short boolean"


def _form(key, written, given, initial, trade, short) -> Form:
    return Form(key, written, frozenset(given), initial, tuple(trade), bool(short))


def forms(names: DataFrame) -> DataFrame:
    """``name`` with the parts of its form and ``form``, a number of the form."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, f.key, f.written, sorted(f.given), f.initial, list(f.trade), f.short) for n in b["name"] for f in (parse(n),)]
            yield pd.DataFrame(rows, columns=["name", "key", "written", "given", "initial", "trade", "short"])

    parsed = names.select("name").mapInPandas(work, f"name string, {FORM}").filter("key <> ''")
    return parsed.withColumn("form", F.xxhash64("key", "written", F.array_join("given", " "), "initial", F.array_join("trade", " "), "short"))


_FIELDS = ("key", "written", "given", "initial", "trade", "short")


def block_pairs(distinct: DataFrame, same_kind: bool) -> DataFrame:
    """Candidate pairs of forms that share a block; with ``same_kind`` both full, else a short and a full one."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [(i, k) for i, (key, written) in enumerate(zip(b["key"], b["written"], strict=True)) for k in block_keys(key) | block_keys(written)]
            out = b.iloc[[i for i, _ in at]].copy()
            out["block"] = [k for _, k in at]
            yield out

    blocks = distinct.select("form", *_FIELDS).mapInPandas(expand, f"form bigint, {FORM}, block string")
    side = lambda p, df: df.select("block", *[F.col(c).alias(f"{p}_{c}") for c in ("form", *_FIELDS)])
    if same_kind:
        full = blocks.filter(~F.col("short"))
        # names of an employer share a trade word, if they have any; each of them completes the block
        words = F.when(F.size("trade") > 0, F.array_distinct("trade")).otherwise(F.array(F.lit("")))
        a, b = (side(p, full.withColumn("block", F.explode(F.transform(words, lambda w: F.concat_ws("|", "block", w))))) for p in "ab")
        return a.join(b, "block").filter("a_form < b_form").drop("block").dropDuplicates(["a_form", "b_form"])
    a, b = side("a", blocks.filter("short")), side("b", blocks.filter(~F.col("short") & (F.size("given") == 0) & (F.col("initial") == "")))
    return a.join(b, "block").drop("block").dropDuplicates(["a_form", "b_form"])


def accepted(pairs: DataFrame, test) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [test(_form(*x[:6]), _form(*x[6:])) for x in zip(*[b[f"{p}_{c}"] for p in "ab" for c in _FIELDS], strict=True)]
            yield b.loc[ok, ["a_form", "b_form"]].rename(columns={"a_form": "a", "b_form": "b"})

    return pairs.mapInPandas(work, "a bigint, b bigint")


def initials_of(parsed: DataFrame) -> DataFrame:
    """``(form, key, legal)``: the initials and legal words of every full firm name."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, k[:1] + "".join(w[:1] for w in t), legal_part(n)) for n, f, k, t in zip(b["name"], b["form"], b["written"], b["trade"], strict=True)]
            yield pd.DataFrame(rows, columns=["form", "key", "legal"])

    full = parsed.filter(~F.col("short") & (F.size("given") == 0) & (F.col("initial") == "")).select("name", "form", "written", "trade")
    return full.mapInPandas(work, "form bigint, key string, legal string")


def clusters(names: DataFrame) -> DataFrame:
    """``(name, cluster)`` for every distinct name."""
    parsed = cut(forms(names))
    distinct = parsed.dropDuplicates(["form"]).drop("name")
    edges = cut(accepted(block_pairs(distinct, True), same_employer))
    linked = connected_components(edges)
    firms = cut(distinct.select("form").join(linked.withColumnRenamed("node", "form"), "form", "left").select("form", F.coalesce("component", "form").alias("cluster")))
    # a short form belongs to the one firm it fits, if there is just one
    hits = accepted(block_pairs(distinct, False), fits).join(firms.withColumnRenamed("form", "b"), "b").select("a", "cluster")
    # initials belong to the one firm of these initials and legal words; its most usual legal words decide
    usual = initials_of(parsed).join(firms, "form").groupBy("cluster", "key", "legal").agg(F.count(F.lit(1)).alias("n"))
    usual = usual.groupBy("cluster", "key").agg(F.max_by("legal", F.struct("n", "legal")).alias("legal"))
    short = distinct.filter(F.col("short") & (F.col("initial") != "")).select(F.col("form").alias("a"), "key", F.col("initial").alias("legal"))
    hits = hits.unionByName(short.join(usual, ["key", "legal"]).select("a", "cluster"))
    owner = hits.groupBy("a").agg(F.countDistinct("cluster").alias("n"), F.min("cluster").alias("owner")).filter("n = 1").select(F.col("a").alias("form"), "owner")
    placed = firms.join(owner, "form", "left").select("form", F.coalesce("owner", "cluster").alias("cluster"))
    return parsed.select("name", "form").join(placed, "form").select("name", "cluster")


def distinct_names(jobs: DataFrame, column: str = "company_name") -> DataFrame:
    c = F.col(column)
    return jobs.filter(c.isNotNull() & (F.trim(c) != "") & ~F.trim(c).isin(*SENTINELS)).select(c.alias("name")).distinct()


def found(jobs: DataFrame) -> DataFrame:
    """``(name_a, name_b)``: all pairs of different spellings of one employer, the smaller first (binary order)."""
    c = cut(clusters(distinct_names(jobs)))
    a, b = c.select("cluster", F.col("name").alias("name_a")), c.select("cluster", F.col("name").alias("name_b"))
    return a.join(b, "cluster").filter("name_a < name_b").select("name_a", "name_b")
