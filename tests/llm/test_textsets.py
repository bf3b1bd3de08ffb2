"""Token batches, shingle sets, signatures, packed windows and components against plain restatements."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adlattice.llm import keyruns as kr
from adlattice.llm import textsets as ts
from adlattice.llm.components import connected_components
from adlattice.llm.strings import deletions, jaro_winkler, near, neighbourhood, osa

WORDS = [f"w{i}" for i in range(60)]


def brute_sets(texts, k):
    out = []
    for t in texts:
        w = [x for x in ts.TOKEN.findall(ts.plain(t)) if x not in "\n.!?。！？"]
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    return out


def fast_sets(texts, k):
    voc = ts.Vocabulary()
    doc, h, kind = voc.batch([ts.plain(t) for t in texts])
    keep = kind == 0
    return ts.shingle_sets(doc[keep], h[keep], len(texts), k)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=12), min_size=1, max_size=8))
def test_shingle_sets_equal_brute_force(docs):
    texts = [" ".join(d) for d in docs]
    values, offsets = fast_sets(texts, 3)
    sizes = [len(s) for s in brute_sets(texts, 3)]
    assert np.diff(offsets).tolist() == sizes
    sh = ts.set_hashes(values, offsets)
    brute = brute_sets(texts, 3)
    for i in range(len(texts)):
        for j in range(i):
            assert (sh[i] == sh[j]) == (brute[i] == brute[j])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1_ .!?\n\t\0,-é中•\x1c"), max_size=25), max_size=6), st.sampled_from([8, 40, 1 << 20]))
def test_tokens_by_arrays_are_those_of_the_pattern(texts, block):
    before, ts.PLAIN_BLOCK = ts.PLAIN_BLOCK, block
    try:
        doc, h, kind = ts.Vocabulary().batch(texts)
    finally:
        ts.PLAIN_BLOCK = before
    want = []
    for n, t in enumerate(texts):
        for x in ts.TOKEN.findall(t):
            k = 1 if x in "\n.!?" else 3 if x.isdigit() else 0
            want.append((n, 0 if k == 1 else ts.word_hash(x), k))
    assert list(zip(doc.tolist(), h.tolist(), kind.tolist(), strict=True)) == want


def test_markup_entities_and_case_are_ignored():
    values, offsets = fast_sets(["<p>Cats &amp; Dogs, run.</p>", "cats dogs RUN", "cats dogs", ""], 3)
    sh = ts.set_hashes(values, offsets)
    assert sh[0] == sh[1] != sh[2] and sh[3] == 0


@pytest.mark.parametrize("overlap", [0, 60, 100, 160, 200])
def test_signatures_estimate_similarity(overlap):
    rng = np.random.default_rng(overlap)
    pool = ts.mix(rng.integers(1, 2**62, 400 - overlap).astype(np.uint64))
    a, b = np.sort(pool[:200]), np.sort(pool[200 - overlap :])
    got = []
    for shift in range(20):
        x, y = np.sort(ts.mix(a + np.uint64(shift))), np.sort(ts.mix(b + np.uint64(shift)))
        sig = ts.superminhash(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 128)
        got.append((sig[0] == sig[1]).mean())
    want = overlap / (len(a) + len(b) - overlap)
    assert abs(np.mean(got) - want) < 0.03


def test_small_and_empty_sets_have_signatures():
    sig = ts.superminhash(np.array([7], np.uint64), np.array([0, 1, 1]), 64)
    assert sig.shape == (2, 64) and len(set(sig[0].tolist())) == 64 and len(set(sig[1].tolist())) == 1


def test_blocks_of_elements_give_the_same_signature(monkeypatch):
    v = np.sort(ts.mix(np.arange(1, 900, dtype=np.uint64)))
    offsets = np.array([0, 10, 10, 500, 899])
    whole = ts.superminhash(v, offsets, 64)
    monkeypatch.setattr(ts, "ELEMENTS", 37)
    assert (ts.superminhash(v, offsets, 64) == whole).all()


def blobs_of(rows, plan):
    by_part = defaultdict(list)
    for part, *blob in rows:
        by_part[part].append(kr.Blob.of(*blob, plan))
    return by_part


def linked(frames):
    return {p for f in frames for p in zip(f["a"].tolist(), f["b"].tolist(), strict=True)}


def test_windows_find_all_equal_keys_in_blocks_and_only_around_new_ones(monkeypatch):
    monkeypatch.setattr(kr, "BLOCK", 1000)
    plan, labels = kr.Plan(bands=2, rows=1, sketch_bits=1), kr.range_labels(4)
    rng = np.random.default_rng(3)
    sets = np.arange(1, 701, dtype=np.int64)
    keys = ts.mix(rng.integers(0, 3, (700, 2)).astype(np.uint64) + np.array([[0, 10]], np.uint64))
    sketch = np.zeros((700, 16), np.uint8)
    old = kr.pack(keys[:300], sets[:300], sketch[:300], labels) + kr.pack(keys[300:600], sets[300:600], sketch[300:600], labels)
    new = blobs_of(kr.pack(keys[600:], sets[600:], sketch[600:], labels), plan)
    within = linked(f for b in blobs_of(old, plan).values() for f in kr.pairs_within(kr.merged(b), plan))
    equal = [(i, j) for i in range(700) for j in range(i + 1, 700) if (keys[i] == keys[j]).any()]
    assert within == {(i + 1, j + 1) for i, j in equal if j < 600}
    stored = {p: kr.load(*kr.dump(kr.merged(b)), plan) for p, b in blobs_of(old, plan).items()}
    between = linked(f for p, bs in new.items() for b in bs if p in stored for f in kr.pairs_between(b, stored[p], plan))
    assert between == {(j + 1, i + 1) for i, j in equal if i < 600 <= j}


def test_copies_of_a_set_make_one_entry():
    plan, labels = kr.Plan(bands=3, rows=1, sketch_bits=1), kr.range_labels(1)
    keys = np.full((1, 3), 9, np.uint64) << np.uint64(33)
    one = [r for _ in range(50) for r in kr.pack(keys, np.array([5]), np.zeros((1, 16), np.uint8), labels)]
    (blobs,) = blobs_of(one, plan).values()
    whole = kr.merged(blobs)
    assert len(whole.key) == 1 and len(whole.sets) == 1 and not linked(kr.pairs_within(whole, plan))


def test_halved_ranges_are_those_of_twice_as_many():
    plan, rng = kr.Plan(bands=6, rows=2), np.random.default_rng(4)
    keys = rng.integers(0, 2**63, (200, 6)).astype(np.uint64) * np.uint64(2)
    sets, sketch = np.arange(200), rng.integers(0, 255, (200, 32)).astype(np.uint8)
    whole = {p: kr.merged(b) for p, b in blobs_of(kr.pack(keys, sets, sketch, np.arange(3)), plan).items()}
    want = {p: kr.merged(b) for p, b in blobs_of(kr.pack(keys, sets, sketch, np.arange(12), splits=2), plan).items()}
    once = {2 * p + bit: h for p, b in whole.items() for bit, h in kr.halved(b, 0)}
    twice = {2 * p + bit: h for p, b in once.items() for bit, h in kr.halved(b, 1)}
    assert set(twice) == set(want)
    for p, b in want.items():
        assert (b.key == twice[p].key).all() and (b.sets[b.own] == twice[p].sets[twice[p].own]).all() and (b.planes[:, :, b.own] == twice[p].planes[:, :, twice[p].own]).all()


def test_labels_put_each_range_into_a_partition_of_its_own(spark):
    for n in (1, 5, 48):
        labels = kr.range_labels(n).tolist()
        rows = spark.createDataFrame([(x,) for x in labels], "part int").selectExpr("part", f"pmod(hash(part), {n}) AS p").collect()
        assert [r.p for r in sorted(rows, key=lambda r: labels.index(r.part))] == list(range(n))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 30)), st.sets(st.integers(0, 30))), max_size=8))
def test_exact_similarity_equals_brute_force(pairs):
    data = [[np.sort(np.array(sorted(x), np.uint32)).tobytes() for x in side] for side in zip(*pairs, strict=True)] if pairs else [[], []]
    assert kr.similar(*data, 0.5).tolist() == [bool(x & y) and len(x & y) >= 0.5 * len(x | y) for x, y in pairs]


def test_components(spark):
    random.seed(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(random.randrange(100, 160), random.randrange(100, 160)) for _ in range(40)] + [(7, 7)] + [(500, 500 + i) for i in range(1, 200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_one_edit_means_a_shared_deletion_form(a, b):
    if osa(a, b) <= 1:
        assert deletions(a) & deletions(b)
    assert osa(a, b, 9) == osa(b, a, 9) and 0 <= jaro_winkler(a, b) <= 1
    table = neighbourhood([b])
    assert bool(near(a, table)) == (osa(a, b) <= 1)


@pytest.mark.parametrize("similarity", [0.5, 0.55, 0.6])
def test_bands_find_nearly_all_pairs_at_the_threshold(similarity):
    rng = np.random.default_rng(11)
    shared, pairs = round(similarity * 220), 600
    sets = []
    for _ in range(pairs):
        pool = ts.mix(rng.integers(1, 2**62, 220).astype(np.uint64))
        own = np.array_split(pool[shared:], 2)
        sets += [np.sort(np.concatenate([pool[:shared], x])) for x in own]
    plan = kr.Plan()
    sig = ts.superminhash(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))), plan.places)
    number = np.arange(1, len(sets) + 1, dtype=np.int64)
    rows = kr.pack(ts.band_keys(sig, plan.bands, plan.rows), number, ts.bit_sketch(sig, plan.sketch_bits), kr.range_labels(3))
    found = linked(f for b in blobs_of(rows, plan).values() for f in kr.pairs_within(kr.merged(b), plan))
    assert np.mean([(i, i + 1) in found for i in range(1, len(sets), 2)]) >= 0.99
