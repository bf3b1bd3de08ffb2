"""Residue, near-duplicates, history, canonical values and names on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from adlattice.llm import canonical, history, names, near, residue
from adlattice.llm import textsets as ts
from adlattice.llm.strings import neighbourhood
from adlattice.llm.strings import near as near_words

SENTENCES = [
    "You will keep the {} ledger in order and answer questions from our {} clients every week.",
    "We look for a calm person with {} years of experience in the {} trade and a good eye for detail.",
    "The post is based at the {} office with visits to the {} warehouse twice a month.",
    "After probation you receive free {} lessons as well as a yearly {} allowance.",
    "Candidates with a {} diploma but little {} background may still apply for this opening.",
    "Our {} branch employs many people and plans to open two new {} shops next year.",
]
THINGS = "harbour tax north green paper steel garden music river stone field solar quiet modern rapid".split()


def advert(seed):
    """Sentences of mostly other words for every seed, with a few phrases in common."""
    rng = random.Random(seed)
    words = [a + b + c for a in ("bra", "clo", "dri", "fen", "gur", "hol") for b in ("mi", "ta", "ros", "ve") for c in ("n", "lk", "rd", "st", "x")]
    made = []
    for s in SENTENCES:
        made.append(" ".join(rng.choice(words) for _ in range(9)) + " and " + s.format(rng.choice(THINGS), rng.choice(THINGS)).split(" ", 4)[rng.randrange(4)] + f" {rng.choice(words)}.")
    return " ".join(made) + f" Desk {seed} of block {seed * 31}."


NOTICES = [
    "Please enable JavaScript in your browser and reload this page to see the advert.",
    "404 - The page you asked for could not be found. It may have been moved or taken down.",
    "Your session has expired. Log in again to go on reading this advert.",
    "You will join {{company_name}} as part of the {{department}} unit in spring.",
    "Text folgt. Text folgt. Text folgt.",
]
TALK = ["You will bring the number of 404 pages and 502 errors on our shop down by half.", "JavaScript is required for this post, together with some TypeScript."]
JOB = "internal_id bigint, id string, name string, description string, company_name string, source string, extra string, sh string"


def jobs_rows():
    rows = [(i, str(1000 + i), f"Clerk {i}", advert(i), "Acme", "JobsDB", "x", "clash") for i in range(60)]
    rows += [(100 + i, str(i), "Clerk", NOTICES[i % 5], "Acme", "JobsDB", None, None) for i in range(20)]
    rows += [(200 + i, str(5000 + i), "Clerk", advert(i + 100) + "\n\n" + NOTICES[i % 5], None, "Indeed", None, None) for i in range(20)]
    rows += [(300 + i, None, None, f"{TALK[i % 2]} {advert(i + 200)}", None, None, None, None) for i in range(20)]
    rows += [(400, "1", "N", None, None, None, None, None), (401, "1", "N", "", None, None, None, None), (402, "1", "N", "N/A", None, None, None, None), (403, "1", "N", "Error: Timeout", None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame(jobs_rows(), JOB).cache()


def test_residue_rows(jobs):
    got = {r[0] for r in residue.found(jobs).collect()}
    assert got == {*range(100, 120), *range(200, 220)}
    assert residue.found(jobs.filter(F.lit(False))).count() == 0


def test_residue_holds_on_an_unseen_board(jobs):
    rows = jobs.filter("internal_id < 400").toPandas()
    seen, unseen = rows[rows["source"] != "Indeed"], rows[rows["source"] == "Indeed"]
    model = residue.train(seen["description"].tolist(), seen["name"].tolist())
    flag, *_ = residue.flags(model, unseen["description"].tolist(), unseen["name"].tolist(), ts.Vocabulary())
    assert flag.mean() >= 0.9


def test_validation_scores_every_row_of_a_board(jobs):
    got = {r.host: r for r in residue.validation(jobs, sample=30).collect()}
    assert {h: r.rows for h, r in got.items()} == {"jobsdb": 80, "indeed": 20}
    assert {h: r.cases for h, r in got.items()} == {"jobsdb": 20, "indeed": 20}
    assert all(0 <= r.recall <= 1 and 0 <= r.precision <= 1 for r in got.values())
    assert residue.validation(jobs.filter(F.lit(False))).count() == 0


# Notices and adverts that stand in no list of the library.
UNSEEN_NOTICES = [
    "Sorry, the role you clicked on is gone.", "The listing has been archived and is no longer open.", "We need to check that you are a person and not a robot.", "Access to this resource is forbidden.", "Error 504: the gateway did not answer in time.",
    "Cookies are switched off in your browser. Please enable them.", "Log in with your account to see all of the text.", "Your login has expired, please sign in once more.", "Bitte loggen Sie sich ein, um die Anzeige zu lesen.", "Die Seite ist leider nicht mehr verfügbar.",
    "Cette annonce n'est plus en ligne.", "La página que busca no existe.", "該職位已停止招聘，頁面已被移除", "[insert a short text about the firm]", "Dear {{first_name}}, we are glad to have you.", "Lorem ipsum dolor sit amet, sed do eiusmod tempor.",
]
UNSEEN_ADVERTS = [
    "You answer the phone, open the post and keep the diary of two managers.", "We are a small bakery by the harbour and look for somebody who likes early mornings.", "Experience with web servers and login systems is an advantage.", "You will find out why orders are late and tell the customer.",
    "The shop is open from nine to six; every second Saturday is free.", "Wir suchen eine freundliche Person für unser Büro in der Altstadt.", "Nous cherchons une personne calme pour notre atelier.", "Buscamos a alguien con ganas de aprender.", "我們的團隊需要一位細心的會計。",
]


def test_unseen_notices_are_told_from_adverts():
    rows = [r for r in jobs_rows() if ts.is_advert(r[3])]
    model = residue.train([r[3] for r in rows], [r[2] for r in rows])
    voc = ts.Vocabulary()
    hit, *_ = residue.flags(model, UNSEEN_NOTICES, ["t"] * len(UNSEEN_NOTICES), voc)
    miss, *_ = residue.flags(model, UNSEEN_ADVERTS, ["t"] * len(UNSEEN_ADVERTS), voc)
    assert hit.mean() >= 0.8 and miss.mean() <= 0.1


def test_notations_are_segments_of_their_own():
    text = residue.prepare("We at [Company. Name] pay $5.\nNo {x} \ue001 here (A) {{" + "y" * 500 + "}}")
    assert [(bool(p[0]), p[1].strip()) for p in residue.pieces(text)] == [(False, "we at"), (True, "company  name"), (False, "pay $5"), (False, "no"), (True, "x"), (False, "here (a)"), (True, "y" * 500)]
    seg = residue.segments([text, "", "one"], ["t"] * 3, ts.Vocabulary())
    assert seg.doc.tolist() == [0] * 7 + [2]


def test_a_notice_after_a_very_long_text_is_seen():
    rows = jobs_rows()
    model = residue.train([r[3] for r in rows if ts.is_advert(r[3])], ["t"] * sum(ts.is_advert(r[3]) for r in rows))
    long = " ".join(advert(i) for i in range(300))
    flag, *_ = residue.flags(model, [long, long + "\n" + NOTICES[2]], ["t", "t"], ts.Vocabulary())
    assert flag.tolist() == [False, True]


def edited(seed, k):
    words = advert(seed).split()
    return " ".join(w for i, w in enumerate(words) if i % 40 != k)


def near_frame(spark):
    rows = [(i, advert(i)) for i in range(40)]
    rows += [(100 + i, advert(i)) for i in range(0, 10)]  # copies
    rows += [(200 + i, "<p>" + edited(i, 5).upper() + "</p>") for i in range(5, 25)]
    rows += [(300 + i, edited(i, 11)) for i in range(5, 15)]
    rows += [(400, None), (401, ""), (402, "N/A"), (403, "Error: X"), (404, NOTICES[0]), (405, "short"), (406, "short")]
    return rows, spark.createDataFrame([(i, "t", d, "c") for i, d in rows], "internal_id bigint, name string, description string, a string")


def brute_pairs(rows, skip):
    sets = {}
    for i, t in rows:
        if ts.is_advert(t) and i not in skip:
            w = [x for x in ts.TOKEN.findall(ts.plain(t)) if x not in "\n.!?"]
            sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} or {tuple(w)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}


def test_near_duplicates_equal_brute_force(spark):
    rows, frame = near_frame(spark)
    got = {tuple(r) for r in near.found(frame).collect()}
    assert got == brute_pairs(rows, {404})
    assert near.found(frame.filter(F.lit(False))).count() == 0


def test_groups_count_links(spark):
    rows, frame = near_frame(spark)
    pairs = brute_pairs(rows, {404})
    got = {r.internal_id: (r.class_id, r.links) for r in near.groups(frame).collect()}
    for i, (_, links) in got.items():
        assert links == sum(i in p for p in pairs)
    assert all(got[a][0] == got[b][0] for a, b in pairs)


def test_a_group_of_copies_may_hold_a_third_of_all_rows(spark):
    rows = [(i, "t", advert(3), "c") for i in range(50)] + [(100 + i, "t", advert(20 + i), "c") for i in range(100)] + [(300, "t", edited(3, 9), "c")]
    frame = spark.createDataFrame(rows, "internal_id bigint, name string, description string, a string")
    got = {r.internal_id: (r.class_id, r.links) for r in near.groups(frame).collect()}
    assert len(got) == 151 and all(got[i] == (0, 50) for i in [*range(50), 300]) and all(got[100 + i][1] == 0 for i in range(100))


def test_texts_without_a_word_stored_again_count(spark):
    texts = ["***", "***", "- -", "<p></p>", "<p></p>", "\U0001f600", "\U0001f600", "\n", "\n", "\u3000", "  ", "{{ }}", "{{ }}", advert(1), advert(1)]
    frame = spark.createDataFrame([(i, "t", d) for i, d in enumerate(texts)], "internal_id bigint, name string, description string")
    want = brute_pairs(list(enumerate(texts)), {11, 12})  # placeholders are cases of p4
    assert len(want) == 22
    assert {tuple(r) for r in near.found(frame).collect()} == want
    assert {r.internal_id: (r.class_id, r.links) for r in near.groups(frame).collect()} == {i: (0, 6) for i in range(7)} | {13: (13, 1), 14: (13, 1)}


def test_tags_in_capitals_are_tags(spark):
    texts = [f"<div><span>{advert(i)}</span></div>" for i in range(20)]
    rows = list(enumerate(texts + [t.upper() for t in texts[:10]]))
    frame = spark.createDataFrame([(i, "t", d) for i, d in rows], "internal_id bigint, name string, description string")
    want = brute_pairs(rows, set())
    assert {(i, 20 + i) for i in range(10)} <= want
    assert {tuple(r) for r in near.found(frame).collect()} == want
    assert all("\ue013" in ts.masked(f"<{x}>") for x in ("CITY", "JOB TITLE", "TITLE", "start_date"))


RAW = "id bigint, batch_no int, external_id string, source string, raw_data string, rec string"


def raw_row(i, batch, ext, source, text):
    body = "null" if text is None else '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    inner = f'"{ext}"' if ext else '"job_77"'
    return (i, batch, ext, source, f'{{"id": {inner}, "name": "n", "description": {body}}}', "x")


def test_history_finds_what_brings_nothing_new(spark, jobs):
    raw = [
        raw_row(1, 1, "job_01005", "jobs-db", None),  # same id as a stored row, dressed
        raw_row(2, 1, "5", "LinkedIn", advert(900)),  # new
        raw_row(3, 1, "/job/5?pos=2", "Linked In", None),  # same id as 2
        raw_row(4, 2, "9", "Glassdoor", edited(900, 3)),  # text of 2
        raw_row(5, 2, "10", "Glassdoor", edited(12, 7)),  # text of a stored row
        raw_row(6, 2, "11", "Glassdoor", advert(901)),  # new
        raw_row(7, 3, "11", "Indeed", None),  # same number on another board: new
        raw_row(8, 3, "12", "Indeed", NOTICES[0]),  # no advert: new
        raw_row(9, 3, "13", "Indeed", NOTICES[0]),  # no advert: new
        raw_row(10, 4, None, None, None),  # no board: new
        (11, 4, None, "Indeed", '{"id": "13", "name": "cut off', "x"),  # id read from the broken record
        (12, 4, None, None, None, None),
    ]
    frame = spark.createDataFrame(raw, RAW)
    want = {1, 3, 4, 5, 11}
    assert {r[0] for r in history.found(jobs, frame).collect()} == want
    assert {r[0] for r in history.found(jobs, frame, batches_per_step=2, fanout=2).collect()} == want
    assert history.found(jobs, frame.filter(F.lit(False))).count() == 0


def history_index(spark, jobs, **given):
    return history.HistoryIndex(spark, residue.fit(jobs), **given)


def absorbed(index, records):
    return {r[0] for r in index.repeats(index.absorb(records)).collect()}


def test_merged_and_halved_runs_answer_alike(spark, jobs, monkeypatch):
    records = history.raw_records(spark.createDataFrame([raw_row(5, 2, "10", "Glassdoor", edited(12, 7)), raw_row(6, 2, "77", "Glassdoor", advert(950))], RAW))
    old = history.job_records(jobs)
    for how in ("apart", "merged", "halved"):
        index = history_index(spark, jobs, ranges=3)
        for lo in (0, 30):
            index.load(old.filter(F.col("rec").between(-lo - 30, -lo - 1)))
        if how == "merged":
            index.compact()
            assert len(index.runs) == 1
        if how == "halved":
            monkeypatch.setattr(history.kr, "RANGE_TEXTS", 6)
        assert absorbed(index, records) == {5}
        assert index.parts == (6 if how == "halved" else 3)
        # a second delivery of the same batch brings nothing new
        assert absorbed(index, records) == {5, 6}
        monkeypatch.undo()
        index.close(remove=True)


def test_an_index_can_be_opened_again(spark, jobs):
    index = history_index(spark, jobs, ranges=2)
    index.load(history.job_records(jobs))
    first = history.raw_records(spark.createDataFrame([raw_row(5, 1, "10", "Glassdoor", advert(950))], RAW))
    assert absorbed(index, first) == set()
    index.close()
    again = history.HistoryIndex.open(spark, index.path)
    assert [r.name for r in again.runs] == [r.name for r in index.runs] and again.plan == index.plan
    second = history.raw_records(spark.createDataFrame([raw_row(6, 2, "99", "Indeed", edited(950, 4)), raw_row(7, 2, "98", "Indeed", edited(12, 7)), raw_row(8, 2, "97", "Indeed", advert(951))], RAW))
    assert absorbed(again, second) == {6, 7}
    assert {r[0] for r in again.repeats().collect()} == {6, 7}
    again.close(remove=True)
    with pytest.raises(FileNotFoundError):
        history.HistoryIndex.open(spark, index.path)


def test_steps_of_any_size_answer_alike(spark, jobs):
    raw = [raw_row(i, 1 + i // 4, str(i % 17), "Glassdoor" if i % 3 else "Indeed", advert(700 + i // 2) if i % 2 else edited(700 + i // 2, i % 5)) for i in range(48)]
    frame = spark.createDataFrame(raw, RAW)
    got = [{r[0] for r in history.found(jobs, frame, batches_per_step=n, fanout=2).collect()} for n in (1, 3, 12)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 20


def test_candidates_read_stored_runs_without_an_exchange(spark, jobs):
    index = history_index(spark, jobs, ranges=2)
    for lo in (0, 30):
        index.load(history.job_records(jobs).filter(F.col("rec").between(-lo - 30, -lo - 1)))
    plan = index.candidates(index.runs[1], index.runs[:1])._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapCoGroupsInPandas") :]
    assert "Exchange" not in below and below.count("Bucketed: true") == 2
    index.close(remove=True)


def test_records_without_a_batch_come_last(spark, jobs):
    raw = [raw_row(1, None, "600", "Glassdoor", advert(800)), raw_row(2, 3, "600", "Glassdoor", None), raw_row(3, None, "601", "Glassdoor", edited(12, 7)), raw_row(4, None, "602", "Glassdoor", advert(801))]
    frame = spark.createDataFrame(raw, RAW)
    assert {r[0] for r in history.found(jobs, frame).collect()} == {1, 3}
    assert {r[0] for r in history.found(jobs, frame, batches_per_step=12).collect()} == {1, 3}


def test_history_reads_the_start_of_a_cut_off_description(spark, jobs):
    whole = raw_row(1, 1, "501", "Glassdoor", 'Said "rapid".\n' + advert(12))[4]
    cut_off = [whole[: len(whole) * 4 // 5], whole[:-1], '{"id": "503", "description": "a \\\\ b \\"c\\" \\u00e9 \\u00', '{"id": "504", "name": "n']
    raw = spark.createDataFrame([(i + 1, 1, str(501 + i), "Glassdoor", t, "x") for i, t in enumerate(cut_off)], RAW)
    got = {r.rec: r.description for r in history.raw_records(raw).collect()}
    assert got[2] == 'Said "rapid".\n' + advert(12) and got[2].startswith(got[1]) and len(got[1]) > 200
    assert got[3] == 'a \\ b "c" \u00e9 ' and got[4] is None
    assert {r[0] for r in history.found(jobs, raw).collect()} == {1, 2}


LOCATIONS = [(1, "Hong Kong", "Wan Chai"), (2, "Hong Kong", "Chai Wan"), (3, "Hong Kong", "Tai Po"), (4, "Macau", "Taipa"), (5, "Taiwan", "Taipei"), (6, "Hong Kong", "Tseung Kwan O"), (7, "Vietnam", "Hanoi"), (8, "Hong Kong", "Kwun Tong")]
CLASSES = [(1, "Sales"), (2, "Science & Research"), (3, "Information Technology"), (4, "Food & Beverage"), (5, "Retail"), (6, "Administration & Office Support")]
PLACES = {
    "Wan Cahi, H.K.": 1, "28/F, Mill Tower, Chai Wan": 2, "灣仔 (Hong Kong)": 1, "TaiPo": 3, "Taipa": 4, "near Taipa station": 4, "Tai Pe, HK": 3, "Tapei, TW": 5, "TKO area": 6, "Hà Nội, VN": 7, "Hong Kong": 0, "Remote": 0, "????": 0, "Casablanca, Morocco": 0, "wan chai": 1, " Tai Po ": 3,
    "x " * 3000 + "Taipei": 5,
}
KINDS = {"Sale": 1, "Research": 2, "Sceince & Research": 2, "I.T.": 3, "F & B": 4, "Food &amp; Beverage": 4, "零售": 5, "Admin": 6, "Data Engineer (Information Technology)": 3, "Beekeeping": 0, "Full time": 0}


def test_canonical_values(spark):
    loc = spark.createDataFrame([(i, c, t, f"{c} - {t}") for i, c, t in LOCATIONS], "id int, country string, city string, name string")
    cls = spark.createDataFrame(CLASSES, "id int, name string")
    rows = [(i, v, None, "v") for i, v in enumerate(PLACES)] + [(100 + i, None, v, "v") for i, v in enumerate(KINDS)]
    rows += [(500, "Hong Kong - Tai Po", "Sales", "v"), (501, "", "N/A", "v"), (502, "Unknown Location", None, None), (0, next(iter(PLACES)), None, "v")]
    jobs = spark.createDataFrame(rows, "internal_id bigint, location string, job_class string, value string")
    got = sorted((r.internal_id, r.field, r.ref_id) for r in canonical.found(jobs, loc, cls).collect())
    want = [(i, "location", r) for i, r in enumerate(PLACES.values())] + [(100 + i, "job_class", r) for i, r in enumerate(KINDS.values())] + [(0, "location", next(iter(PLACES.values())))]
    assert got == sorted(want)
    assert canonical.found(jobs.filter(F.lit(False)), loc, cls).count() == 0


def test_other_names_come_from_the_table_and_soft_tfidf_ranks(spark):
    loc = spark.createDataFrame([(1, "Freedonia", "Harbour"), (2, "Freedonia", "Old Harbour"), (3, "Sylvania", "Old Mill")], "id int, country string, city string").selectExpr("*", "concat(country, ' - ', city) AS name")
    cls = spark.createDataFrame([(1, "Glass Blowing")], "id int, name string")
    names = spark.createDataFrame([("city", "Old Mill", "Vieux Moulin"), ("country", "Sylvania", "SYL"), ("word", "blowing", "blwg"), ("class", "Glass Blowing", "GB")], "kind string, entry string, form string")
    jobs = spark.createDataFrame([(1, "Old Harbour, Freedonia", "Glass Blwg"), (2, "Vieux Moulin", "GB"), (3, "Harbuor", "B Team"), (4, "Mill", "x" * 5000)], "internal_id bigint, location string, job_class string")
    got = {(r.internal_id, r.field): r.ref_id for r in canonical.found(jobs, loc, cls, names).collect()}
    # without soft TF-IDF "Harbour", which the first value holds too, would come before "Old Harbour"
    assert got == {(1, "location"): 2, (2, "location"): 3, (3, "location"): 1, (4, "location"): 0, (1, "job_class"): 1, (2, "job_class"): 1, (3, "job_class"): 0, (4, "job_class"): 0}
    with pytest.raises(ValueError):
        canonical.ranker(spark.range(canonical.MAX_REFERENCE + 1).selectExpr("id", "'c' AS country", "'d' AS city"), cls, names)


EMPLOYERS = [
    ["Clartlurt Textile Trading Ltd.", "  Clartlurt  Textile Trading Ltd. ", "Clar tlurt Textile Trading Ltd.", "Clartlurt", "Clartlurt-Textile-Trading Ltd.", "Clartlurtt Textile Trdg", "Textile Trading, Clartlurt", "CTT Ltd."],
    ["Themlith Medical Group Company Limited", "Themlith Med. Grp Company Limited", "THEMLITH MEDICAL GROUP COMPANY LIMITED"],
    ["Themlith Jewellery Trading (Hong Kong) 有限公司", "Themlith Jewellery Trdg Company Limited"],
    ["Robert Koamplimp Executive Search", "Bob Koamplimp Executive Search", "Koamplimp, Robert Executive Search", "R. Koamplimp Executive Search"],
    ["Susanna Koamplimp Executive Search"],
    ["Feindnox Harbour Staffing Services Limited", "The Feindnox Harbour Company"],
    ["Alpha Brenner Trading Ltd", "Brenner Alpha Trading Ltd"],
    ["Smith Jones Partners", "Jones & Smith Partners"],
    ["Wei Zhang Bakery", "Zhang Wei Bakery"],
    ["Ormvelt Home Furniture Trading Ltd", "Ormvelt Furniture Trading Co."],
    ["Ormvelt Home Dental Clinic Ltd"],
]


def test_names_of_an_employer_are_linked(spark):
    rows = [(n, "c") for e in EMPLOYERS for n in e for _ in range(2)] + [(None, "c"), ("", "c"), ("N/A", "c"), ("Unknown Company", "c"), ("Themlith", "c")]
    jobs = spark.createDataFrame(rows, "company_name string, cluster string")
    got = {tuple(r) for r in names.found(jobs).collect()}
    assert got == {tuple(sorted((a, b))) for e in EMPLOYERS for i, a in enumerate(e) for b in e[i + 1 :]}
    assert names.found(jobs.filter(F.lit(False))).count() == 0


def test_neighbourhood_lists_the_closest_first():
    assert near_words("hom", neighbourhood(["home", "hum"]))[0][1] == 1
