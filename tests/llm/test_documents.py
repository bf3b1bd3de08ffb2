"""Quality statistics, packing and mixing on small fixtures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adlattice.llm import mixing, packing, quality

DOC = "doc_id bigint, text string, source string, tokens string, extra string"
PROSE = {
    "en": "She told the panel that stage lighting had been the hardest part of her work. If the pay is not stated, ask about it before you sign anything.",
    "wrapped": "He is a flexible worker who can\nwrite press releases, although his\nFrench is still weak. We met him at\nthe office and liked what we saw.",
    "upper": "BETWEEN 2016 AND NOW THE BRANCH HAS HIRED 208 PEOPLE. IF THE PAY IS NOT STATED, ASK ABOUT IT.",
    "zh": "我在護理工作了四十年，希望可以管理預算，並與同事一起學習。",
    "it": "La nostra azienda cerca una persona attenta che sappia parlare con i clienti. Il lavoro comincia in marzo e dura due anni.",
    "pt": "A empresa procura uma pessoa calma que goste de trabalhar com números. O contrato começa em abril.",
    "nl": "Wij zoeken iemand die graag met mensen werkt en goed kan luisteren.",
    "ru": "Мы ищем человека, который любит работать с людьми и умеет слушать. Работа начинается в мае и длится один год.",
    "ja": "私たちは人と話すことが好きな方を探しています。仕事は五月に始まり、一年間続きます。",
    "ko": "우리는 사람들과 함께 일하기를 좋아하는 분을 찾고 있습니다. 일은 오월에 시작하여 일 년 동안 계속됩니다.",
    "fi": "Etsimme henkilöä, joka pitää työskentelystä ihmisten kanssa ja osaa kuunnella.",
    "hi": "हम ऐसे व्यक्ति की तलाश में हैं जो लोगों के साथ काम करना पसंद करता हो। काम मई में शुरू होता है।",
    "wrapped it": "La nostra azienda cerca una persona attenta\nche sappia parlare con i clienti e che non\nabbia paura di fare domande. Il lavoro\ncomincia in marzo.",
    "de": "Ein kurzes Schreiben ist besser als eine lange Liste von Kursen, die niemand liest.",
}
JUNK = {
    "table": "| Post | Unit | Pay |\n|---|---|---|\n| Job costing | construction | 11308 |\n| ward scheduling | aviation | 56383 |",
    "menu": "Home > Jobs > Log in > Post a job > Help > About > Saved > Log in > Post a job > Next > Help > Home",
    "log": "2025-12-27 02:25 DEBUG parser card=88900 rows=63 retry\n2025-04-22 13:42 INFO parser card=14594 rows=72 retry",
    "list": "1. la contabilidad\n2. el almacén\n3. curiosa / treinta\n4. la cocina\n5. ocho",
    "heap": "staff apply apply vacancy apply salary salary staff apply vacancy salary hiring vacancy staff hiring salary",
    "heap of common words": "jobs part time jobs full time hiring staff part time full time full time staff full time staff part time full time full time hiring",
    "one line over and over": "The same line stands here again and again in this text.\n" * 400,
    "code": 'def f(x):\n    return {"a": x, "b": [1, 2]}\nfor i in range(3): print(f(i))',
    "random": "vwnmsp yvela clexpphl qbadrbvp ctfyuvlc wiufdmz onzpd kq nzufsb ywp yzirmyg fpgtomoo flq",
}


@pytest.mark.parametrize("name", PROSE)
def test_prose_is_no_case(name):
    assert quality.statistics(PROSE[name])[-1] is True


@pytest.mark.parametrize("name", JUNK)
def test_other_text_is_a_case(name):
    assert quality.statistics(JUNK[name])[-1] is False
    assert quality.statistics(PROSE["en"] + "\n\n" + (JUNK[name] + "\n") * 5)[-1] is False


def test_tags_of_any_length_are_no_text():
    assert quality.statistics("<" + "x" * 900 + ">" + PROSE["en"])[-2:] == (1.0, True)


def test_statistics_of_a_known_text():
    s = quality.statistics("The cat sat.\nThe cat sat.\n\nGo!")
    assert s[0] == 7 and s[3] == 1.0 and s[5] == pytest.approx(1 / 3) and s[1] == pytest.approx(20 / 7)


def test_quality_frame(spark):
    rows = [(1, None, None, None, None), (2, " \n", "s", "t", "x"), (3, PROSE["en"], "s", "t", "x"), (4, JUNK["log"], "s", "t", "x"), (4, JUNK["log"], "s", "t", "x"), (5, PROSE["en"] * 2000, "s", "t", "x")]
    docs = spark.createDataFrame(rows, DOC)
    assert [r[0] for r in quality.found(docs).collect()] == [4, 4]
    assert quality.measure(docs).filter("doc_id = 1").first()["word_count"] == 0
    assert quality.found(docs.filter(F.lit(False))).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plans_use_all_pieces_and_keep_the_capacity(counts):
    plan = packing.plan(dict(counts), 64)
    used = {}
    for p in plan:
        assert sum(s * k for s, k in p.pieces) + p.gap == 64 and p.gap >= 0 and p.times > 0
        # a window is of the tier of its longest piece
        assert packing.tier(max(s for s, _ in p.pieces), 64) == p.tier
        for s, k in p.pieces:
            used[s] = used.get(s, 0) + k * p.times
    assert used == counts
    assert [p.tier for p in plan] == sorted(p.tier for p in plan)
    total, n = sum(s * k for s, k in counts.items()), sum(p.times for p in plan)
    # never worse than first fit decreasing is known to be
    assert n <= 11 / 9 * -(-total // 64) + 4 + sum(k for s, k in counts.items() if s > 32) / 2


def test_a_plan_of_many_sizes_is_quick():
    import time

    began = time.time()
    plan = packing.plan({s: 1 + s % 5 for s in range(1, 131_073)}, 131_072)
    assert time.time() - began < 5 and sum(s * k * p.times for p in plan for s, k in p.pieces) == sum(s * (1 + s % 5) for s in range(1, 131_073))


def test_gaps_of_long_windows_are_filled_from_shorter_tiers():
    (p,) = packing.plan({60: 1, 30: 1, 8: 1, 2: 1}, 100)
    assert p.tier == 0 and p.pieces == [(60, 1), (30, 1), (8, 1), (2, 1)] and p.gap == 0


def test_packing_places_every_token_once(spark):
    rows = [(i, "word " * (1 + i * 7 % 90), "s", "t", "x") for i in range(200)] + [(900, "long " * 1000, "s", "t", "x"), (901, None, "s", "t", "x"), (902, "", "s", "t", "x")]
    rows += [(1000 + i, "same size", "s", "t", "x") for i in range(300)]
    docs = spark.createDataFrame(rows, DOC)
    limits = spark.createDataFrame([("small", 64), ("large", 256)], "run_name string, capacity_tokens int")
    packed = packing.pack(docs, limits).cache()
    boxes = packing.containers(packed, limits)
    assert boxes.filter("unused_tokens < 0").count() == 0
    assert packed.groupBy("run_name", "doc_id", "piece_no").count().filter("count > 1").count() == 0
    for name, cap in (("small", 64), ("large", 256)):
        mine = packed.filter(F.col("run_name") == name)
        cutup = mine.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()
        assert all((r.n > 1) == (r.t > cap) for r in cutup)
        assert {r.doc_id for r in cutup} == {r[0] for r in rows if r[1]}
        ends = mine.groupBy("doc_id").agg(F.max(F.col("start_token") + F.col("n_tokens")).alias("e"), F.sum("n_tokens").alias("t"))
        assert ends.filter("e <> t").count() == 0
    tiers = {(r.run_name, r.window_tier): r for r in packing.by_tier(boxes).collect()}
    assert sum(r.containers for r in tiers.values()) == boxes.count() and all(0 <= r.unused_share < 1 for r in tiers.values())
    assert packed.filter("tier < window_tier").count() == 0
    assert packing.pack(docs.filter(F.lit(False)), limits).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, limits.limit(0))


def test_hot_sizes_are_ranked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BLOCK", 50)
    docs = spark.createDataFrame([(i, "same size", "s", "t", "x") for i in range(300)], DOC)
    limits = spark.createDataFrame([("small", 64)], "run_name string, capacity_tokens int")
    assert packing.containers(packing.pack(docs, limits), limits).agg(F.sum("pieces")).first()[0] == 300


def test_apportionment_is_sainte_lague():
    s = [mixing.Source("a", 0.53, 1, 10**6), mixing.Source("b", 0.24, 1, 10**6), mixing.Source("c", 0.23, 1, 10**6), mixing.Source("none", 0.5, 3, 0)]
    quota = mixing.apportion(s, 7, 1, shards=2)
    assert {n: sum(q) for n, q in quota.items()} == {"a": 3, "b": 2, "c": 2}
    assert all(abs(q[0] - q[1]) <= 1 for q in quota.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.floats(0.001, 1), st.integers(1, 3), st.integers(1, 60)), min_size=1, max_size=6), st.integers(0, 200))
def test_seats_equal_those_of_the_auction(given_sources, blocks):
    sources = [mixing.Source(f"s{i}", w, r, t) for i, (w, r, t) in enumerate(given_sources)]
    won = dict.fromkeys((s.name for s in sources), 0)
    for _ in range(blocks):
        open_ = [(-s.share / (2 * won[s.name] + 1), s.name) for s in sources if won[s.name] < s.tokens * s.repeats]
        if open_:
            won[min(open_)[1]] += 1
    assert mixing.seats(sources, blocks, 1) == won
    shards = mixing.apportion(sources, blocks, 1, 4)
    sums = [sum(q[i] for q in shards.values()) for i in range(4)]
    assert max(sums) - min(sums) <= 1


def test_very_many_blocks_are_dealt_at_once():
    sources = [mixing.Source(f"s{i}", 1 / (i + 1), 2, 10**16) for i in range(50)]
    won = mixing.seats(sources, 10**10, 2048)
    total = sum(s.share for s in sources)
    assert sum(won.values()) == 10**10 and all(abs(won[s.name] - 10**10 * s.share / total) < 2 for s in sources)


def test_mixing_meets_the_targets(spark):
    rows = [(i, "word " * (5 + i % 13), "big", "t", "x") for i in range(900)] + [(2000 + i, "word " * 9, "small", "t", "x") for i in range(60)] + [(3000, None, "big", "t", "x"), (3001, "w", None, "t", "x"), (3002, "w", "other", "t", "x")]
    docs = spark.createDataFrame(rows, DOC)
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.25, 4), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert got["absent"]["real_share"] == 0
    assert abs(got["big"]["real_share"] - 0.7 / 0.95) < 0.01 and abs(got["small"]["real_share"] - 0.25 / 0.95) < 0.01
    assert got["small"]["most_uses"] <= 4 and chosen.filter("uses > 1 AND source = 'big'").count() == 0
    # every use has its shard, and the shards hold equal shares of each source
    rows = chosen.collect()
    assert all(len(r.shards) == r.uses and max(r.shards) < mixing.SHARDS for r in rows)
    for name in ("big", "small"):
        held = [sum(r.tokens * r.shards.count(i) for r in rows if r.source == name) for i in range(mixing.SHARDS)]
        assert max(held) - min(held) <= 2 * mixing.BLOCK_TOKENS
    again, _ = mixing.mix(docs, targets)
    assert sorted(map(str, again.collect())) == sorted(map(str, chosen.collect()))
    assert mixing.mix(docs.filter(F.lit(False)), targets)[0].count() == 0
