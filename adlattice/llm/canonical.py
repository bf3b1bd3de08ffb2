"""Free-entered values to entries of a canonical list (problem 1).

Method: token-level repair. Each distinct token of the distinct values is joined to the reference
vocabulary by edit distance (an equi-join on deletion forms, then the exact distance); the repaired
tokens are combined with soft TF-IDF, which ranks the complete entries; the order of the words breaks
ties. A location must be covered whole (all words of a city, side by side up to a typo); a class may be named by
a part of its words.

Other names of entries and short forms of words come as a table ``(kind, entry, form)``: kind 'city' and 'class' give
other names, 'country' words that tell a country (which alone is no place of the list), 'word' short forms of a word.

Defined results: NULL, '', 'N/A', 'Unknown Location' and exact names are no cases; every other value gets
an entry or 0. Repeated rows get equal results, very long values are read whole, extra columns are
ignored, an empty table gives an empty result. The reference lists are fixed tables of at most some
hundred entries; more than ``MAX_REFERENCE`` are refused.
"""

from __future__ import annotations

import csv
import html
import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlattice.llm.strings import deletions, fold, osa
from adlattice.session import cut

SENTINELS = ("", "N/A", "Unknown Location")
MAX_REFERENCE = 10_000

# How alike a stretch of a value and an entry must be: one edit weighs 1, a second one 2 more.
ALIKE, ALIKE_ALIAS, ALIKE_WORD = 0.72, 0.87, 0.7
ALIASES = os.path.join(os.path.dirname(__file__), "aliases.csv")


def aliases(spark: SparkSession, path: str = ALIASES) -> DataFrame:
    """The table of other names that comes with the library, a short list of usual abbreviations and translations."""
    with open(path, encoding="utf-8", newline="") as f:
        rows = [(r["kind"], r["entry"], r["form"]) for r in csv.DictReader(f)]
    return spark.createDataFrame(rows, "kind string, entry string, form string")


_IGNORED = frozenset(("and", "of", "the"))
_WORD = re.compile(r"[぀-ヿ㐀-鿿가-힯豈-﫿]+|[^\W_぀-ヿ㐀-鿿가-힯豈-﫿]+")


def words(text: str) -> list[str]:
    return _WORD.findall(fold(html.unescape(text)).replace("'", "").replace("’", ""))


def cased_words(text: str) -> list[str]:
    return [w for w in words(text) if w not in _IGNORED]


def _limited(df: DataFrame) -> list:
    rows = df.limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError("the reference list is too large to be held by every task")
    return rows


def ranker(locations: DataFrame, classes: DataFrame, names: DataFrame) -> Ranker:
    """The ranker of the lists; their size is checked."""
    told: dict[str, dict[str, list[str]]] = {}
    for r in _limited(names.select("kind", "entry", "form")):
        told.setdefault(r["kind"], {}).setdefault(r["entry"], []).append(r["form"])
    cities, kinds = told.get("city", {}), told.get("class", {})
    forms = []
    for r in _limited(locations.select("id", "country", "city")):
        forms += [Entry("location", r["id"], cased_words(f), r["country"], i > 0) for i, f in enumerate([r["city"], *cities.get(r["city"], ())])]
    for r in _limited(classes.select("id", "name")):
        forms += [Entry("job_class", r["id"], cased_words(f), "", i > 0) for i, f in enumerate([r["name"], *kinds.get(r["name"], ())])]
    countries = {e.country: [cased_words(c) for c in told.get("country", {}).get(e.country, [e.country])] for e in forms if e.country}
    return Ranker([e for e in forms if e.words], countries, {s: w for w, shorts in told.get("word", {}).items() for s in shorts})


@dataclass(frozen=True)
class Entry:
    """One way to write an entry of a list."""

    field: str
    ref: int
    words: list[str]
    country: str
    alias: bool

    @property
    def glued(self) -> str:
        return "".join(self.words)


Repairs = dict[str, list[tuple[str, float]]]


class Ranker:
    """Soft TF-IDF over repaired tokens; built from the fixed entries."""

    def __init__(self, forms: list[Entry], countries: dict[str, list[list[str]]], short: dict[str, str]):
        self.forms, self.countries, self.short = forms, countries, short
        self.idf: dict[tuple[str, str], float] = {}
        for field in ("location", "job_class"):
            mine = [e for e in forms if e.field == field]
            n = len({e.ref for e in mine})
            holders: dict[str, set[int]] = {}
            for e in mine:
                for w in e.words:
                    holders.setdefault(w, set()).add(e.ref)
            self.idf |= {(field, w): math.log(1 + n / len(ids)) for w, ids in holders.items()}
        held: dict[str, set[int]] = {}
        for e in forms:
            if e.country:
                held.setdefault(e.country, set()).add(e.ref)
        places = sum(map(len, held.values()))
        self.country_idf = {c: math.log(1 + places / len(ids)) for c, ids in held.items()}
        self.by_token: dict[tuple[str, str], set[int]] = {}
        for k, e in enumerate(forms):
            for w in {*e.words, e.glued}:
                self.by_token.setdefault((e.field, w), set()).add(k)

    def vocabulary(self) -> list[tuple[str, str]]:
        """``(field, token)``: words of the entries and their glued forms."""
        return sorted({(e.field, w) for e in self.forms for w in (*e.words, e.glued)})

    def covered(self, e: Entry, tokens: list[str], repairs: Repairs) -> float:
        """IDF-weighted share of an entry's words that the value holds, each at its best similarity."""
        sims: dict[str, float] = {}
        for t in tokens:
            for w, s in repairs.get(t, ()):
                sims[w] = max(sims.get(w, 0.0), s)
        total = sum(self.idf[e.field, w] for w in e.words)
        return sum(self.idf[e.field, w] * sims.get(w, 0.0) for w in e.words) / total if total else 0.0

    def stretch(self, e: Entry, tokens: list[str]) -> tuple[float, int, int] | None:
        """The stretch of the value most like the entry: ``(similarity, distance as spaced words, length)``; None if none is enough."""
        glued, spaced, best = e.glued, " ".join(e.words), None
        least = 1.0 if ord(glued[0]) > 0x2E80 else ALIKE_ALIAS if e.alias else ALIKE
        for i in range(len(tokens)):
            for j in range(i + 1, min(len(tokens), i + len(e.words) + 1) + 1):
                window = "".join(tokens[i:j])
                if abs(len(window) - len(glued)) > 2:
                    continue
                if window != glued and ("location", window) in self.by_token:
                    continue  # a word of the vocabulary means itself and is not repaired
                d = osa(window, glued, 2)
                alike = 1 - d * (d + 1) / 2 / len(glued)
                if d <= 2 and alike >= least:
                    found = (alike, -osa(" ".join(tokens[i:j]), spaced, 4), i - j)
                    best = max(best, found) if best else found
        return best

    def place(self, tokens: list[str], repairs: Repairs) -> int:
        keys = {k for t in tokens for w, _ in repairs.get(t, ()) for k in self.by_token.get(("location", w), ())}
        joined = {"".join(tokens[i:j]) for i in range(len(tokens)) for j in range(i + 1, min(len(tokens), i + 5) + 1)}
        keys |= {k for w in joined for k in self.by_token.get(("location", w), ())}
        padded = f" {' '.join(tokens)} "
        best: tuple | None = None
        for k in keys:
            e = self.forms[k]
            hit = self.stretch(e, tokens)
            if hit is None:
                continue
            known = any(f" {' '.join(c)} " in padded or "".join(c) in tokens for c in self.countries[e.country])
            # soft TF-IDF: the entry's words at the similarity of their stretch, and its country where the value names it
            mass = sum(self.idf["location", w] ** 2 for w in e.words)
            soft = (mass * hit[0] + known * self.country_idf[e.country] ** 2) / math.sqrt(mass + self.country_idf[e.country] ** 2)
            score = (round(soft, 6), hit[1], -e.ref)
            if best is None or score > best[0]:
                best = (score, e.ref)
        return best[1] if best else 0

    def kind(self, tokens: list[str], repairs: Repairs) -> int:
        glued = "".join(tokens)
        keys = {k for t in tokens for w, _ in repairs.get(t, ()) for k in self.by_token.get(("job_class", w), ())} | self.by_token.get(("job_class", glued), set())
        best: tuple | None = None
        for k in keys:
            e = self.forms[k]
            soft = 1.0 if glued == e.glued else self.covered(e, tokens, repairs)
            weight = sum(self.idf["job_class", w] for w in e.words)
            score = (round(soft, 3), soft * weight, -osa(" ".join(tokens), " ".join(e.words), 60), -e.ref)
            # an abbreviation must be there whole, a name may be told in part
            if soft >= (1.0 if len(e.glued) <= 3 else 0.3) and (best is None or score > best[0]):
                best = (score, e.ref)
        return best[1] if best else 0

    def rank(self, field: str, value: str, repairs: Repairs) -> int:
        tokens = cased_words(value)
        return self.place(tokens, repairs) if field == "location" else self.kind(tokens, repairs)


def cases(jobs: DataFrame, locations: DataFrame, classes: DataFrame) -> DataFrame:
    """``(internal_id, field, value)`` of the values to map."""
    names = locations.select("name").unionByName(classes.select("name"))
    pair = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("location", "job_class")])
    rows = jobs.select("internal_id", F.inline(pair)).filter(F.col("value").isNotNull() & ~F.col("value").isin(*SENTINELS))
    return rows.join(F.broadcast(names.select(F.col("name").alias("value"))), "value", "left_anti")


def token_repairs(tokens: DataFrame, ranked: Ranker) -> DataFrame:
    """``(field, token, word, sim)``: the vocabulary words within one edit of each distinct token.

    Both sides are expanded to their deletion forms, joined on equality, and checked by the exact distance.
    """
    spark = tokens.sparkSession
    # words of one letter are kept exact, else they would meet every short token
    vocabulary = [(f, w, d) for f, w in ranked.vocabulary() for d in (deletions(w) if len(w) > 1 else {w})]
    short = [("job_class", s, w, 0.95) for s, w in ranked.short.items()]
    # a token that is longer than the longest word by two has no word within one edit
    longest = 1 + max((len(w) for _, w, _ in vocabulary), default=0)
    forms = F.broadcast(spark.createDataFrame(vocabulary, "field string, word string, form string"))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, t, d) for f, t in zip(b["field"], b["token"], strict=True) if len(t) <= longest for d in deletions(t)]
            yield pd.DataFrame(rows, columns=["field", "token", "form"])

    met = tokens.mapInPandas(expand, "field string, token string, form string").join(forms, ["field", "form"]).select("field", "token", "word").distinct()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = [osa(t, w, 1) for t, w in zip(b["token"], b["word"], strict=True)]
            n = b.assign(d=d)
            n = n[n["d"] <= 1]
            n = n.assign(sim=1 - n["d"] / n["word"].str.len().clip(lower=1))
            yield n.loc[n["sim"] >= ALIKE_WORD, ["field", "token", "word", "sim"]]

    near = met.mapInPandas(check, "field string, token string, word string, sim double")
    known = F.broadcast(spark.createDataFrame(short, "field string, token string, word string, sim double"))
    return near.unionByName(tokens.join(known, ["field", "token"]))


def mapping(values: DataFrame, locations: DataFrame, classes: DataFrame, names: DataFrame) -> DataFrame:
    """``(field, value, ref_id)`` of distinct values; 0 where none is meant."""
    ranked = ranker(locations, classes, names)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, v, t) for f, v in zip(b["field"], b["value"], strict=True) for t in set(cased_words(v))], columns=["field", "value", "token"])

    exploded = values.mapInPandas(split, "field string, value string, token string")
    repairs = token_repairs(exploded.select("field", "token").distinct(), ranked)
    found = exploded.join(repairs, ["field", "token"]).groupBy("field", "value").agg(F.collect_list(F.struct("token", "word", "sim")).alias("r"))
    rows = values.join(found, ["field", "value"], "left")

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f, v, r in zip(b["field"], b["value"], b["r"], strict=True):
                repaired: dict[str, list[tuple[str, float]]] = {}
                for x in r if r is not None else ():
                    repaired.setdefault(x["token"], []).append((x["word"], x["sim"]))
                out.append((f, v, ranked.rank(f, v, repaired)))
            yield pd.DataFrame(out, columns=["field", "value", "ref_id"])

    return rows.select("field", "value", "r").mapInPandas(rank, "field string, value string, ref_id bigint")


def found(jobs: DataFrame, locations: DataFrame, classes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``(internal_id, field, ref_id)`` of every case. Only distinct values are ranked."""
    names = aliases(jobs.sparkSession) if names is None else names
    rows = cases(jobs, locations, classes)
    # the distinct values are used several times, so they are kept
    mapped = mapping(cut(rows.select("field", "value").distinct()), locations, classes, names)
    return rows.join(mapped, ["field", "value"]).select("internal_id", "field", "ref_id")
