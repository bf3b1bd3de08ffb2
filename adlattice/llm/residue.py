"""Template residue and error-page text (problem 4).

Method: a regularised linear classifier on hashed n-grams, length and title features, trained on weak
labels from response statuses and phrases and validated on boards and notices it has not seen. It scores
segments (lines, sentences and bracket notations), because a notice may stand in place of a part of the
advert; a row is a case if one of its segments scores above zero. The classifier alone decides: labels are
used in training only.

Weak labels come from three places: the reason phrases and explanations of the HTTP status codes and usual
wordings of notices (:mod:`adlattice.llm.notices`), general cues in the segments of a sample of rows, and
names of template fields counted in that sample.

Training uses at most about ``SAMPLE`` rows, drawn by hash over the whole table; scoring covers every row and
every character. Defined results: NULL, blank, 'N/A' and 'Error: <Type>' are no cases; texts of any
length are read whole; repeated rows get equal answers; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.llm import notices
from adlattice.llm import textsets as ts

SAMPLE = 10_000
BITS = 18
SEED_WEIGHT = 0.9  # of a built-in example; a segment of the sample weighs 1
_U = np.uint64

# Notations of template languages; the others also occur in ordinary texts.
_SURE = frozenset("abcdefghipqrst")
_TEMPLATE = frozenset(ts.OPEN[ord(c) - 97] for c in _SURE)
_MARK = re.compile(rf"([{ts.OPEN}])([^{ts.CLOSE}]*){ts.CLOSE}")
_BREAK = re.compile(r"\n|[.!?。！？](?=\s|$)")
_SAYS = re.compile(r"[^\W]")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Segments:
    """Features of all segments of a batch of texts."""

    doc: np.ndarray
    cells: np.ndarray
    starts: np.ndarray
    tokens: tuple[np.ndarray, np.ndarray, np.ndarray]  # doc, hash, kind


def _length_bucket(n: np.ndarray) -> np.ndarray:
    return np.minimum(7, np.log2(np.maximum(1, n)).astype(np.int64))


def segments(texts: list[str], titles: list[str | None], vocabulary: ts.Vocabulary) -> Segments:
    """Hashed word 1- to 3-grams within each segment, its length, and whether the row lacks a title.

    A bracket notation is a segment of its own; its features are its kind, the words inside and those beside it.
    """
    doc, h, kind = vocabulary.batch(texts)
    brk = kind == 1
    cut = np.cumsum(brk | (kind == 2))  # an opening sign starts a segment, the token after a closing one too
    after = np.zeros(len(kind), np.int64)
    after[1:] = np.cumsum(kind[:-1] == 4)
    seg_all = cut + after + doc
    word = ~brk
    d, hh, seg, kd = doc[word], h[word], seg_all[word], kind[word]
    real = (kd == 0) | (kd == 3)
    tokens = (d[real], hh[real], kd[real])
    if not len(d):
        return Segments(np.empty(0, np.int64), np.empty((4, 0), np.int32), np.empty(0, np.int64), tokens)
    hm = np.where(kd == 3, _U(0xD1617), hh)  # numbers are alike for the classifier
    new = np.ones(len(seg), bool)
    new[1:] = seg[1:] != seg[:-1]
    starts = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    shift = _U(64 - BITS)
    size = np.diff(np.append(starts, len(seg)))
    pos = np.arange(len(seg)) - starts[number]
    a, b, c = ts._MULTIPLIERS[40:43]
    cells = np.full((4, len(seg)), -1, np.int32)
    cells[0] = hm >> shift
    pair = hm[1:] * a + hm[:-1] * b
    cells[1, 1:] = np.where(pos[1:] >= 1, (pair >> shift).astype(np.int32), -1)
    cells[2, 2:] = np.where(pos[2:] >= 2, ((pair[1:] + hm[:-2] * c) >> shift).astype(np.int32), -1)
    # length and title cells ride on the first word of each segment
    no_title = np.array([t is None or t in ("", "N/A", "Unknown Title") for t in titles], np.int64)
    side = _length_bucket(size) * 2 + no_title[d[starts]]
    cells[3, starts] = (ts.mix(side.astype(np.uint64) + _U(0x7E57)) >> shift).astype(np.int64)
    # the closing sign of a notation carries the words beside it
    close = np.flatnonzero(kd == 4)
    if len(close):
        opens = starts[number[close]]
        for row, at, salt in ((0, opens - 1, 0x1EF7), (1, close + 1, 0x219E), (2, opens - 2, 0x1EF8)):
            inside = (at >= 0) & (at < len(hm))
            at = np.clip(at, 0, len(hm) - 1)
            inside &= d[at] == d[close]
            cells[row, close] = np.where(inside, (ts.mix(hm[at] + _U(salt)) >> shift).astype(np.int64), -1)
    return Segments(d[starts], cells, starts, tokens)


@dataclass
class Model:
    """Weights of the cells and the bias; small and fixed in size whatever the data."""

    weights: np.ndarray
    bias: float

    def scores(self, s: Segments) -> np.ndarray:
        """Mean cell weight of a segment scaled by the root of its length, plus the bias."""
        if not len(s.starts):
            return np.empty(0)
        w = np.append(self.weights, np.float32(0))  # the last cell answers -1
        value, filled = np.zeros(s.cells.shape[1], np.float32), np.zeros(s.cells.shape[1], np.int32)
        for row in s.cells:
            value += w[row]
            filled += row >= 0
        sums = np.add.reduceat(value.astype(np.float64), s.starts)
        n = np.add.reduceat(filled, s.starts)
        return sums / np.sqrt(n) + self.bias


def blank_model() -> Model:
    """A model that accepts nothing."""
    return Model(np.zeros(1 << BITS, np.float32), -1.0)


def prepare(text: str) -> str:
    return ts.plain(ts.masked(text))


def pieces(text: str) -> Iterator[tuple[str | None, str, str, str]]:
    """The segments of a prepared text: ``(sign of the notation or None, words, text before, text after)``."""
    at = 0
    for m in [*_MARK.finditer(text), None]:
        end = m.start() if m else len(text)
        for x in _BREAK.split(text[at:end]):
            if _SAYS.search(x):
                yield None, x, "", ""
        if m:
            yield m[1], m[2].strip(), text[max(0, end - 40) : end], text[m.end() : m.end() + 40]
            at = m.end()


def field_names(ready: Iterable[str]) -> frozenset[str]:
    """What stands in the notations of template languages, counted at least twice."""
    seen: dict[str, int] = {}
    for t in ready:
        for m in _MARK.finditer(t):
            if m[1] in _TEMPLATE:
                k = m[2].strip()
                seen[k] = seen.get(k, 0) + 1
    return frozenset(k for k, n in seen.items() if n >= 2)


def weak_label(sign: str | None, words: str, before: str, after: str, fields: frozenset[str]) -> int:
    """1 notice, filler or placeholder; 0 advert text; -1 no opinion."""
    if sign is not None:
        if notices.SPOKEN_OF_BEFORE.search(before) or notices.SPOKEN_OF_AFTER.match(after):
            return 0
        if sign in _TEMPLATE or not words or words in fields or notices.is_field(words):
            return 1
        return -1 if words.isdigit() else 0
    told = _WORD.findall(words)
    if notices.has_cue(words, told):
        return -1 if notices.TALK.search(words) else 1
    return 1 if notices.is_filler(words, told) else 0


@dataclass
class Examples:
    """Labelled segments as sparse rows: their cells one after another, cells of each, labels and weights."""

    cell: np.ndarray
    count: np.ndarray
    label: np.ndarray
    weight: np.ndarray

    @classmethod
    def joined(cls, parts: list[Examples]) -> Examples:
        return cls(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("cell", "count", "label", "weight")))


_OPENED = np.array([ts.word_hash(c) >> (64 - BITS) for c in ts.OPEN], np.int32)
PLAIN = 3  # segments of plain text kept for each text of the sample, besides all cases, notations and short segments
SHORT = 4


def examples(ready: list[str], titles: list[str | None], labels: list[int], vocabulary: ts.Vocabulary, rng: np.random.Generator, weight: float, keep_all: bool) -> Examples:
    """The labelled segments of prepared texts; of plain advert text a random part is kept unless ``keep_all``."""
    s = segments(ready, titles, vocabulary)
    y = np.array(labels, np.int64)
    if len(y) != len(s.starts):
        raise AssertionError("segments and labels are out of step")
    marked = np.isin(s.cells[0, s.starts], _OPENED)
    size = np.diff(np.append(s.starts, s.cells.shape[1]))
    sure = (y == 1) | (y == 0) & (marked | (size <= SHORT))
    plain = np.flatnonzero((y == 0) & ~sure)
    if not keep_all:
        plain = rng.permutation(plain)[: PLAIN * len(ready)]
    chosen = np.sort(np.concatenate([np.flatnonzero(sure), plain]))
    size = size[chosen]
    at = np.repeat(s.starts[chosen] - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(size.sum())
    cell = s.cells[:, at].T.ravel()
    row = np.repeat(np.repeat(np.arange(len(chosen)), size), 4)[cell >= 0]
    return Examples(cell[cell >= 0], np.bincount(row, minlength=len(chosen)), y[chosen], weight * np.where(marked[chosen] & (y[chosen] == 0), 4.0, 1.0))


STEP = 1000


def labelled(texts: list[str], titles: list[str | None], rng: np.random.Generator) -> Examples:
    """Examples from the texts, a few at a time, and from the built-in wordings."""
    fields = field_names(prepare(t) for t in texts)
    vocabulary = ts.Vocabulary()
    parts = []
    for i in range(0, len(texts), STEP):
        ready = [prepare(t) for t in texts[i : i + STEP]]
        parts.append(examples(ready, titles[i : i + STEP], [weak_label(*p, fields) for t in ready for p in pieces(t)], vocabulary, rng, 1.0, False))
    seeds = [(prepare(t), y) for t, y in notices.seeds()]
    parts.append(examples([t for t, _ in seeds], ["t"] * len(seeds), [y for t, y in seeds for _ in pieces(t)], vocabulary, rng, SEED_WEIGHT, True))
    return Examples.joined(parts)


def train(texts: list[str], titles: list[str | None], epochs: int = 14, l2: float = 1e-4, rate: float = 0.5, seed: int = 7) -> Model:
    """L2-regularised logistic regression by AdaGrad over the labelled segments of the texts."""
    rng = np.random.default_rng(seed)
    x = labelled(texts, titles, rng)
    counts, cell = x.count, x.cell
    val = (1 / np.sqrt(counts)).astype(np.float32)
    starts = np.concatenate(([0], np.cumsum(counts)))
    target = x.label.astype(np.float64)
    cases = int(target.sum())
    weight = np.where(target == 1, max(1.0, 0.25 * (len(target) - cases) / max(1, cases)), 1.0) * x.weight
    w, g2, b = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), -1.0
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for part in np.array_split(order, max(1, len(order) // 512)):
            n = counts[part]
            take = np.repeat(starts[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            local = np.repeat(np.arange(len(part)), n)
            z = np.bincount(local, w[cell[take]], minlength=len(part)) * val[part] + b
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[part]) * weight[part] / len(part)
            touched, inverse = np.unique(cell[take], return_inverse=True)
            grad = np.bincount(inverse, (err * val[part])[local]) + l2 * w[touched]
            g2[touched] += grad * grad
            w[touched] -= rate * grad / np.sqrt(g2[touched])
            b -= 0.1 * err.sum()
    return Model(w.astype(np.float32), b)


def advert_column(text: str = "description"):
    c = F.col(text)
    return c.isNotNull() & (F.trim(c) != "") & (F.trim(c) != "N/A") & ~c.rlike(r"^Error: \w+\s*$")


def host_column(jobs: DataFrame):
    """The board without case, blanks and signs; NULL without a board."""
    return F.regexp_replace(F.lower("source"), "[^a-z]", "") if "source" in jobs.columns else F.lit(None).cast("string")


def training_rows(jobs: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """At most about ``sample`` rows with text, drawn by a hash of the row key over the whole table."""
    rows = jobs.filter(advert_column())
    total = jobs.count()
    keep = max(1, -(-total // sample))
    picked = rows.filter(F.pmod(F.xxhash64("internal_id"), F.lit(keep)) == 0)
    return picked.select("internal_id", "name", "description", host_column(jobs).alias("host")).orderBy("internal_id").limit(2 * sample).toPandas()


def fit(jobs: DataFrame, sample: int = SAMPLE) -> Model:
    rows = training_rows(jobs, sample)
    return train(rows["description"].tolist(), rows["name"].tolist())


def flags(model: Model, texts: list[str], titles: list[str | None], vocabulary: ts.Vocabulary) -> tuple[np.ndarray, np.ndarray, Segments]:
    """``(flag, score, segments)`` per text; the score is that of the highest segment, the flag whether it is above zero."""
    ready = [prepare(t) for t in texts]
    s = segments(ready, titles, vocabulary)
    score = np.full(len(ready), -np.inf)
    if len(s.doc):
        np.maximum.at(score, s.doc, model.scores(s))
    return score > 0, score, s


CHUNK = 2000


def found(jobs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(internal_id)`` of each row whose description is, or holds in place of text, residue or a notice."""
    model = model or fit(jobs)
    shared = jobs.sparkSession.sparkContext.broadcast(model)  # 1 MB, fixed by BITS
    rows = jobs.filter(advert_column()).select("internal_id", "name", "description")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = ts.Vocabulary()
        for b in batches:
            for i in range(0, len(b), CHUNK):
                part = b.iloc[i : i + CHUNK]
                flag, *_ = flags(shared.value, part["description"].tolist(), part["name"].tolist(), vocabulary)
                yield pd.DataFrame({"internal_id": part["internal_id"].to_numpy()[flag]})

    return rows.mapInPandas(score, "internal_id bigint")


COUNTS = ("rows", "cases", "flagged", "agreed")
BOARDS = 16


def validation(jobs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per board: agreement with the weak labels of a model trained on the other boards only.

    Only training uses the sample, field names included; every row of the board with an advert is scored, and the counts
    are summed in Spark. A row is a case of the labels if one of its segments is; names of fields are those of the other
    boards on both sides. There is one model for each board; ``BOARDS`` of them share a pass.
    """
    rows = training_rows(jobs, sample)
    every = jobs.filter(advert_column()).select("name", "description", host_column(jobs).alias("host")).filter("host IS NOT NULL")
    hosts = sorted(r[0] for r in every.select("host").distinct().collect())
    counts = every.sparkSession.createDataFrame([], "host string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    for i in range(0, len(hosts), BOARDS):
        models = {}
        for host in hosts[i : i + BOARDS]:
            seen = rows[rows["host"] != host]
            texts = seen["description"].tolist()
            models[host] = train(texts, seen["name"].tolist()), field_names(prepare(t) for t in texts)
        shared = every.sparkSession.sparkContext.broadcast(models)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            vocabulary = ts.Vocabulary()
            for b in batches:
                for host, part in b.groupby("host"):
                    model, fields = shared.value[host]
                    for j in range(0, len(part), CHUNK):
                        p = part.iloc[j : j + CHUNK]
                        got, *_ = flags(model, p["description"].tolist(), p["name"].tolist(), vocabulary)
                        want = np.array([any(weak_label(*x, fields) == 1 for x in pieces(prepare(t))) for t in p["description"]], bool)
                        yield pd.DataFrame([(host, len(p), want.sum(), got.sum(), (got & want).sum())], columns=["host", *COUNTS])

        counts = counts.unionByName(every.filter(F.col("host").isin(list(models))).mapInPandas(count, counts.schema))
    summed = counts.groupBy("host").agg(*[F.sum(c).alias(c) for c in COUNTS])

    def share(part: str, whole: str, name: str):
        return (F.col(part) / F.greatest(F.lit(1), F.col(whole))).alias(name)

    return summed.select("host", "rows", "cases", "flagged", share("agreed", "flagged", "precision"), share("agreed", "cases", "recall")).orderBy("host")
