"""Sorted runs of similarity keys, packed by key range, and the windows of equal keys in them.

A run holds, for a batch of texts, every band key with the set it belongs to. Rows are packed: one row
per key range and task, with the sorted keys (their lower 32 bits, as the range stands for the upper ones)
and the sets they point to (a local index into a list of set numbers and bit sketches). Equal texts have one
set number, so copies collapse before and after the exchange however many there are.

Key ranges have labels chosen so that hash partitioning by label puts each range into a task of its own: a task
holds one range, and a range holds the keys of about ``RANGE_TEXTS`` texts, however many texts there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.llm import residue
from adlattice.llm import textsets as ts

CHUNK = 1500
RANGE_TEXTS = 32_000
RUN = "part int, rec bigint, sh bigint, ord bigint, keys binary, at binary, sets binary, sketch binary"


@dataclass(frozen=True)
class Plan:
    """Shingle length, similarity and banding. 42 bands of 3 places find a pair of similarity .5 with probability .997
    and of .55 or more with 1 to four digits; two bits of each place keep the pairs to verify few."""

    k: int = 3
    threshold: float = 0.5
    places: int = 128
    bands: int = 42
    rows: int = 3
    sketch_bits: int = 2

    def equal_bits(self, places: int) -> int:
        """So many of the places agree in the sketches of a pair at the threshold, but for about one pair in a thousand or,
        of half the places, in ten thousand."""
        p = self.threshold + (1 - self.threshold) / 2**self.sketch_bits
        return int(places * p - (3.0 if places >= self.places else 3.7) * (places * p * (1 - p)) ** 0.5)


def murmur3(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash of an int column."""
    with np.errstate(over="ignore"):
        k = values.astype(np.uint32) * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = np.uint32(seed) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


def range_labels(n: int) -> np.ndarray:
    """A label for each of ``n`` ranges; partitioned by hash into n, label i is alone in partition i."""
    reach = 32 * n
    while True:
        where = np.mod(murmur3(np.arange(reach, dtype=np.uint32)).astype(np.int64), n)
        got, first = np.unique(where, return_index=True)
        if len(got) == n:
            return first.astype(np.int32)
        reach *= 2


def ranges_for(rows: int) -> int:
    """Key ranges for so many rows."""
    return max(1, -(-rows // RANGE_TEXTS))


def range_of(keys: np.ndarray, ranges: int, splits: int = 0) -> np.ndarray:
    """The range of 64-bit keys: one of ``ranges`` by the upper bits, halved ``splits`` times by the first of the lower bits."""
    part = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    return (part << splits) | ((keys & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - splits)).astype(np.int64) if splits else part


def pack(keys: np.ndarray, sets: np.ndarray, sketch: np.ndarray, labels: np.ndarray, splits: int = 0) -> list[tuple]:
    """``(label, keys, at, sets, sketch)`` per range from the key matrix of distinct sets: sorted keys by range."""
    parts = len(labels)
    flat = keys.ravel()
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), keys.shape[1])
    part = range_of(flat, parts >> splits, splits)
    order = np.lexsort((flat & np.uint64(0xFFFFFFFF), part))
    flat, owner, part = flat[order], owner[order], part[order]
    bounds = np.searchsorted(part, np.arange(parts + 1))
    rows = []
    for p in range(parts):
        lo, hi = bounds[p], bounds[p + 1]
        if lo < hi:
            used, local = np.unique(owner[lo:hi], return_inverse=True)
            rows.append((int(labels[p]), flat[lo:hi].astype(np.uint32).tobytes(), local.astype(np.uint16).tobytes(), sets[used].tobytes(), sketch[used].tobytes()))
    return rows


@dataclass
class Texts:
    """A batch of texts: which have an advert, the number of each set, the shingles, the new sets with their signatures, and
    which texts have signs or tags but no word (their set is empty and has the number 0)."""

    good: np.ndarray
    sh: np.ndarray
    values: np.ndarray
    offsets: np.ndarray
    fresh: list[int]
    signature: np.ndarray
    wordless: np.ndarray | None = None

    def grams(self, x: int) -> bytes:
        """The sorted 32-bit hashes of the shingles of a text: the upper bits of their sorted values."""
        return (self.values[self.offsets[x] : self.offsets[x + 1]] >> np.uint64(ts.VALUE_BITS - 32)).astype(np.uint32).tobytes()


class Reader:
    """Reads batches of texts in one task; a set it has met before is not signed again."""

    def __init__(self, model: residue.Model, plan: Plan, remember: int = 500_000):
        self.model, self.plan, self.remember = model, plan, remember
        self.vocabulary, self.met = ts.Vocabulary(), set()

    def read(self, texts: list[str | None], titles: list[str | None]) -> Texts:
        told = [t if isinstance(t, str) else "" for t in texts]
        flag, _, seg = residue.flags(self.model, told, titles, self.vocabulary)
        doc, h, _ = seg.tokens
        values, offsets = ts.shingle_sets(doc, h, len(told), self.plan.k)
        sh = ts.set_hashes(values, offsets)
        good = ~flag & (sh != 0)
        wordless = ~flag & (sh == 0)
        wordless[wordless] = [ts.is_advert(told[x]) for x in np.flatnonzero(wordless)]
        if len(self.met) > self.remember:
            self.met.clear()
        fresh = [x for x in np.flatnonzero(good).tolist() if sh[x] not in self.met and not self.met.add(sh[x])]
        sig = np.empty((0, self.plan.places), np.uint64)
        if fresh:
            sub = np.concatenate([values[offsets[x] : offsets[x + 1]] for x in fresh])
            sig = ts.superminhash(sub, np.concatenate(([0], np.cumsum(np.diff(offsets)[fresh]))), self.plan.places)
        return Texts(good, sh, values, offsets, fresh, sig, wordless)

    def packed(self, t: Texts, labels: np.ndarray, splits: int = 0) -> list[tuple]:
        if not t.fresh:
            return []
        return pack(ts.band_keys(t.signature, self.plan.bands, self.plan.rows), t.sh[t.fresh], ts.bit_sketch(t.signature, self.plan.sketch_bits), labels, splits)


def texts_to_run(rows: DataFrame, model: residue.Model, plan: Plan, labels: np.ndarray) -> DataFrame:
    """From ``rec, ord, name, description``: one row ``(rec, sh, ord)`` per advert and the packed keys.

    Rows without an advert (NULL, blank, 'N/A', error marks, residue) give nothing. Texts without a word all have the empty
    set; it is like no other, so it needs no keys.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value, plan)
        for b in batches:
            for i in range(0, len(b), CHUNK):
                p = b.iloc[i : i + CHUNK]
                t = reader.read(p["description"].tolist(), p["name"].tolist())
                told = t.good | t.wordless
                sh = t.sh[told]
                yield pd.DataFrame({"part": labels[np.abs(sh) % len(labels)], "rec": p["rec"].to_numpy()[told], "sh": sh, "ord": p["ord"].to_numpy()[told], "keys": None, "at": None, "sets": None, "sketch": None})
                yield pd.DataFrame([(x[0], 0, 0, 0, *x[1:]) for x in reader.packed(t, labels)], columns=[c.split()[0] for c in RUN.split(", ")])

    return rows.select("rec", "ord", "name", "description").mapInPandas(work, RUN)


BLOCK = 1 << 18


@dataclass
class Blob:
    """Unpacked keys of a range: sorted keys, the set each belongs to, set numbers, and sketches as words by bit, place and set."""

    key: np.ndarray
    own: np.ndarray
    sets: np.ndarray
    planes: np.ndarray

    @classmethod
    def of(cls, keys: bytes, at: bytes, sets: bytes, sketch: bytes, plan: Plan) -> Blob:
        number = np.frombuffer(sets, np.int64)
        raw = np.frombuffer(sketch, np.uint8).reshape(len(number), -1)
        planes = raw.view(np.uint64 if plan.places % 64 == 0 else np.uint8).reshape(len(number), plan.sketch_bits, -1)
        return cls(np.frombuffer(keys, np.uint32), np.frombuffer(at, np.uint16).astype(np.int64), number, np.ascontiguousarray(planes.transpose(1, 2, 0)))


STORED = "part int, keys binary, at binary, sets binary, sketch binary"


def dump(blob: Blob) -> tuple[bytes, bytes, bytes, bytes]:
    """The stored form of a blob, which is read again without a copy."""
    return blob.key.tobytes(), blob.own.astype(np.uint32).tobytes(), blob.sets.tobytes(), np.ascontiguousarray(blob.planes).tobytes()


def load(keys: bytes, at: bytes, sets: bytes, sketch: bytes, plan: Plan) -> Blob:
    number = np.frombuffer(sets, np.int64)
    word = np.uint64 if plan.places % 64 == 0 else np.uint8
    return Blob(np.frombuffer(keys, np.uint32), np.frombuffer(at, np.uint32), number, np.frombuffer(sketch, word).reshape(plan.sketch_bits, -1, len(number)))


def halved(blob: Blob, splits: int) -> list[tuple[int, Blob]]:
    """The halves of a range, when it has been halved ``splits`` times before: by the next bit of the keys, which are sorted."""
    middle = int(np.searchsorted(blob.key >> np.uint32(31 - splits) & np.uint32(1), 1))
    out = []
    for bit, part in ((0, slice(0, middle)), (1, slice(middle, None))):
        used, own = np.unique(blob.own[part], return_inverse=True)
        if len(own):
            out.append((bit, Blob(blob.key[part], own, blob.sets[used], blob.planes[:, :, used])))
    return out


def merged(blobs: list[Blob]) -> Blob:
    """One sorted blob; a set of a key that several blobs hold is listed once for the key."""
    base = np.cumsum([0, *(len(b.sets) for b in blobs)])
    unique, first, where = np.unique(np.concatenate([b.sets for b in blobs]), return_index=True, return_inverse=True)
    key = np.concatenate([b.key for b in blobs])
    own = np.concatenate([where[b.own + n] for b, n in zip(blobs, base[:-1], strict=True)])
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    return Blob(key[keep], own[keep], unique, np.concatenate([b.planes for b in blobs], axis=2)[:, :, first])


def _checked(a: Blob, x: np.ndarray, b: Blob, y: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Set numbers of the entry pairs whose sketches agree; a place differs if any of its bits does.

    Half of the places are looked at first, and the rest where these do not tell the pair apart.
    """
    p, q = a.own[x], b.own[y]
    equal = np.zeros(len(p), np.int64)
    words, per = a.planes.shape[1], a.planes.dtype.itemsize * 8
    for lo, hi in ((0, (words + 1) // 2), ((words + 1) // 2, words)):
        for w in range(lo, hi):
            differ = a.planes[0, w][p] ^ b.planes[0, w][q]
            for bit in range(1, plan.sketch_bits):
                differ |= a.planes[bit, w][p] ^ b.planes[bit, w][q]
            equal += per - np.bitwise_count(differ)
        keep = equal >= plan.equal_bits(hi * per)
        p, q, equal = p[keep], q[keep], equal[keep]
    return a.sets[p], b.sets[q]


def _blocks(lead: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers the pairs ``lead[i]`` with ``0 .. count[i] - 1`` throughout and yields them in blocks of ``BLOCK``."""
    ends = np.cumsum(count)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, BLOCK):
        hi = min(lo + BLOCK, int(ends[-1]))
        e = np.arange(np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1)
        begin = ends[e] - count[e]
        x = np.repeat(e, np.minimum(ends[e], hi) - np.maximum(begin, lo))
        yield lead[x], np.arange(lo, hi) - (ends[x] - count[x])


def pairs_within(blob: Blob, plan: Plan) -> Iterator[pd.DataFrame]:
    """Links ``(a, b)``, ``a < b``, between different sets of equal key whose sketches agree.

    Windows of any size are compared in blocks of pairs, none is cut.
    """
    n = len(blob.key)
    if not n:
        return
    start = np.flatnonzero(np.concatenate(([True], blob.key[1:] != blob.key[:-1])))
    ahead = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n))) - np.arange(n) - 1
    lead = np.flatnonzero(ahead)
    for x, step in _blocks(lead, ahead[lead]):
        a, b = _checked(blob, x, blob, x + 1 + step, plan)
        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def pairs_between(new: Blob, old: Blob, plan: Plan) -> Iterator[pd.DataFrame]:
    """Links ``(a, b)`` from the sets of ``new`` to those of ``old``, a set in both included: a merge of two sorted runs, only
    windows around new keys are compared."""
    lo, hi = np.searchsorted(old.key, new.key, "left"), np.searchsorted(old.key, new.key, "right")
    lead = np.flatnonzero(hi > lo)
    for x, step in _blocks(lead, (hi - lo)[lead]):
        a, b = _checked(new, x, old, lo[x] + step, plan)
        yield pd.DataFrame({"a": a, "b": b}).drop_duplicates()


LINK = "link boolean, a bigint, b bigint, ord bigint"


def links_and_records(run: DataFrame, plan: Plan, parts: int) -> DataFrame:
    """Candidate links ``(a, b)`` of all key ranges, and the record rows ``(rec, sh, ord)`` beside them.

    Both go through one exchange by range, so the packed keys are neither computed nor stored twice; a task has the
    blobs of one range. No 64-bit column holds NULL, as pandas would turn it into a float.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blobs: list[Blob] = []
        for b in batches:
            plain = b["keys"].isna()
            if plain.any():
                yield b.loc[plain, ["rec", "sh", "ord"]].rename(columns={"rec": "a", "sh": "b"}).assign(link=False)
            blobs += [Blob.of(*r, plan) for r in b.loc[~plain, ["keys", "at", "sets", "sketch"]].itertuples(index=False)]
        if blobs:
            for found in pairs_within(merged(blobs), plan):
                if len(found):
                    yield found.assign(link=True, ord=0)

    return run.repartition(parts, "part").mapInPandas(work, LINK)


def split_links(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(links, records)`` of the cut result of :func:`links_and_records`."""
    records = both.filter(~F.col("link")).select(F.col("a").alias("rec"), F.col("b").alias("sh"), "ord")
    return both.filter("link").select("a", "b").distinct(), records.distinct()


SETS = "sh bigint, grams binary"


def exact_sets(texts: DataFrame, plan: Plan) -> DataFrame:
    """``(sh, grams)`` of rows ``(sh, description)``: the sorted shingle hashes (32 bits: two sets of
    some hundred runs meet by chance in less than one of 10 000 comparisons, and then in one run)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(residue.blank_model(), plan)
        for b in batches:
            for i in range(0, len(b), CHUNK):
                p = b.iloc[i : i + CHUNK]
                seg = residue.segments([residue.prepare(t) for t in p["description"]], [None] * len(p), reader.vocabulary)
                doc, h, _ = seg.tokens
                t = Texts(None, None, *ts.shingle_sets(doc, h, len(p), plan.k), [], None)
                yield pd.DataFrame({"sh": p["sh"].to_numpy(), "grams": [t.grams(x) for x in range(len(p))]})

    return texts.select("sh", "description").mapInPandas(work, SETS)


def similar(a: list[bytes], b: list[bytes], threshold: float) -> np.ndarray:
    """Which pairs of sorted sets reach the similarity; all rows are compared in one merge of row-numbered hashes."""

    def numbered(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(s) // 4 for s in sets], np.int64)
        return (np.repeat(np.arange(len(sets), dtype=np.uint64), size) << np.uint64(32)) | np.frombuffer(b"".join(sets), np.uint32), size

    (x, n), (y, m) = numbered(a), numbered(b)
    if not len(x) or not len(y):
        return np.zeros(len(a), bool)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = np.bincount((x[y[at] == x] >> np.uint64(32)).astype(np.int64), minlength=len(a))
    return both >= threshold * np.maximum(1, n + m - both)


def compared(both: DataFrame, kept: list[str], plan: Plan) -> DataFrame:
    """Columns ``kept`` of the rows whose sets ``ga`` and ``gb`` reach the threshold, exactly."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[similar(b["ga"].tolist(), b["gb"].tolist(), plan.threshold), kept]

    kinds = dict(both.dtypes)
    return both.select(*kept, "ga", "gb").mapInPandas(work, ", ".join(f"{c} {kinds[c]}" for c in kept))


def verified(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs ``(a, b)`` whose sets reach the threshold, exactly."""
    left = pairs.join(sets.select(F.col("sh").alias("a"), F.col("grams").alias("ga")), "a")
    return compared(left.join(sets.select(F.col("sh").alias("b"), F.col("grams").alias("gb")), "b"), ["a", "b"], plan)


def needed_texts(records: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``(sh, description)`` of one record for each needed set.

    The list of needed records is broadcast only after its size is checked; beyond that the join shuffles.
    """
    one = records.join(nodes.select(F.col("node").alias("sh")).distinct(), "sh", "left_semi").groupBy("sh").agg(F.min("rec").alias("rec"))
    return texts.join(small(one, nodes.count()), "rec").select("sh", "description")


BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks a table of a few numbers a row for broadcast if it is known to have few enough rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
