"""Truth tables of the posting operators, parsers and requests; streaming ingest; sources and sinks."""

import random

import pytest
from pyspark.sql import functions as F

from adlattice.functions import html
from adlattice.operators import api, boards, crawl, ingest, matching, runs, search, terms, worklist
from adlattice.sources import sinks, tables
from adlattice.streaming import ingest_stream

ROWS = [
    (1, "a1", "Java Dev", "Acme", "Writes Java and SQL"),
    (2, "a2", "java dev", None, "needs python"),
    (3, "a3", "Clerk", "Beta", None),
    (4, "a4", "Clerk", "Beta", ""),
    (5, "a5", "Nurse", "N/A", "N/A"),
    (6, "a6", "100% remote_job", "Foo", "Error: Timeout"),
    (7, "a1", "Java Dev", "Acme", "duplicate id"),
    (8, "a8", "Senior", "Dev Ltd", "x"),
    (9, "a9", "ÉTÉ Chef", "Ünï", "naïve"),
]
SCHEMA = "internal_id bigint, id string, name string, company_name string, description string"


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def ids(df):
    return {r[0] for r in df.select("internal_id").collect()}


def plain_like(text, term):
    import re

    out = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in f"%{term}%")
    return text is not None and re.fullmatch(out, text, re.I | re.S) is not None


def plain_terms(row, given):
    _, _, name, company, text = row
    if text is None or text == "N/A":
        return False
    m = lambda t: any(plain_like(x, t) for x in (name, company, text))
    joined = " ".join("null" if x is None else x for x in (name, company, text))
    for t in given:
        if t.exact:
            ok = t.text in joined
        elif not t.exclude and "/" in t.text:
            ok = any(m(p.strip()) for p in t.text.split("/") if p.strip())
        else:
            ok = m(t.text)
        if ok == t.exclude:
            return False
    return True


def test_random_term_lists_equal_a_plain_restatement(posts):
    rng = random.Random(4)
    words = ["java", "dev", "Dev", "sql/python", "100%", "e_o", "null", "Senior Dev", "été", "x", "clerk / nurse", "%"]
    for _ in range(25):
        given = [terms.SearchTerm(rng.choice(words), rng.random() < 0.4, rng.random() < 0.3) for _ in range(rng.randrange(1, 4))]
        assert ids(search.term_search(posts, given)) == {r[0] for r in ROWS if plain_terms(r, given)}, given


def test_keyword_modes(posts):
    assert ids(search.keyword_search(posts, "java, sql")) == {1}
    assert ids(search.keyword_search(posts, "java/nurse")) == {1, 2, 5, 7}
    assert ids(search.keyword_search(posts, " , ")) == {1, 2, 4, 6, 7, 8, 9}


def test_parsers():
    assert terms.parse_query(" a , b/c,, ") == ["a", "b", "c"]
    assert terms.query_mode("a,b") == "AND" and terms.query_mode("a/b") == "OR" and terms.query_mode("a/b", "and") == "AND"
    assert terms.parse_term("= x ") == terms.SearchTerm(" x ", False, True) and terms.parse_term("  ") is None
    a, b = terms.SearchTerm("x", False, True), terms.SearchTerm("x")
    assert terms.remove_term([a, b], a) == [b]
    c = worklist.RunConfig.from_args(["source_platform=1,", "quantity=0,", "save=TRUE, workers=-3, junk=1"])
    assert (c.quantity, c.save, c.workers, c.run_type, c.source_platform) == (1, True, 1, 1, "1")
    p = worklist.RunConfig.from_dict({"start_page": "4", "end_page": "2", "detail_filter": "odd"})
    assert (p.run_type, p.start_page, p.end_page, p.detail_filter) == (2, 4, 4, "new")
    assert api.page_params("0", None) == (1, 20) and api.page_params("x", "7") == (1, 7)
    assert api.showing(3, 20, 45) == (41, 45) and api.showing(1, 20, 0) == (0, 0) and api.clamp_page(9, 3) == 3
    assert api.file_name(["a b"], "2025-01-01") == "job_search_a-b_2025-01-01.csv"


def test_pages_and_worklists(posts):
    assert [r[0] for r in search.page(posts.select("internal_id"), 2, 4).collect()] == [5, 4, 3, 2]
    with pytest.raises(ValueError):
        search.page(posts, 0, 4)
    assert ids(posts.filter(worklist.pending("new"))) == {3, 4} and ids(posts.filter(worklist.pending("N/A"))) == {3, 4, 5}
    got = {r.internal_id: r.batch_no for r in worklist.contiguous_batches(posts.select("internal_id"), 4, 9).collect()}
    assert got == {9: 0, 8: 0, 7: 0, 6: 1, 5: 1, 4: 1, 3: 2, 2: 2, 1: 2}
    assert worklist.find_platform(posts.sparkSession.createDataFrame([(1, "JobsDB"), (4, "LinkedIn")], "id int, name string"), "linkedin").first()["id"] == 4


def test_updates_hit_the_first_of_an_id(spark, posts):
    changes = spark.createDataFrame([("a1", "new")], "id string, description string")
    got = {r.internal_id: r.description for r in ingest.update_by_external_id(posts, changes, ["description"]).collect()}
    assert got[1] == "new" and got[7] == "duplicate id"
    new = spark.createDataFrame([("a1", 1), ("zz", 2), ("zz", 3)], "id string, n int")
    assert ingest.unseen(new, posts).count() == 2 and ingest.insert_ignore(posts, new, ["id"], "n").collect()[0]["n"] == 2


CARD = '<article data-job-id="42"><h3><a>Data</a></h3><a data-automation="jobCompany">Acme <b>Ltd</b></a><span data-automation="jobListingDate">3d ago</span></article>'


def test_cards_and_details(spark):
    pages = spark.createDataFrame([(1, f"<ul>{CARD}<article data-job-id=''></article></ul>", "z"), (2, "no cards", "z"), (3, None, "z")], "page_id int, html string, pos string")
    rows = crawl.listing_cards(pages.drop("pos")).collect()
    assert [(r.id, r.company_name, r.location, r.date_posted) for r in rows] == [("42", "Acme Ltd", "Unknown Location", "3d ago")]
    links = spark.createDataFrame([('<li data-occludable-job-id="77">',), ('<a href="/jobs/view/88/">',), ("jobId=99",), ("none",)], "c string")
    assert [r[0] for r in links.select(html.linked_card_id(F.col("c"))).collect()] == ["77", "88", "99", None]
    old = spark.createDataFrame([('<div data-jobid="5">',), ('<div id="job_6">',), ('{"jobId":7}',)], "c string")
    assert [r[0] for r in old.select(html.legacy_card_id(F.col("c"))).collect()] == ["5", "6", "7"]
    stub = crawl.id_stubs(spark.createDataFrame([('<li data-occludable-job-id="1"><li data-occludable-job-id="2">',)], "html string"), spark.createDataFrame([("1",)], "id string"), "2025-01-01").collect()
    assert [(r.id, r.name, r.description, r.source) for r in stub] == [("2", "N/A", "", "LinkedIn")]
    detail = spark.createDataFrame([(1, '<div data-automation="jobAdDetails">Do <b>it</b></div><span data-automation="job-detail-classifications">Chef (Food)</span>'), (2, "x")], "page_id int, html string")
    assert [(r.description, r.job_class) for r in crawl.detail_fields(detail).orderBy("page_id").collect()] == [("Do it", "Food"), ("N/A", "N/A")]
    assert boards.board(" jobs-DB ") is None and isinstance(boards.board("JobsDB"), boards.JobsDb) and boards.board("nowhere") is None


def test_fences(spark):
    rows = spark.createDataFrame([("```html\n<p>a</p>\n```",), ("```x```",), ("<div>y</div>",), (" ",), (None,)], "c string")
    assert [r[0] for r in rows.select(html.unfence(F.col("c"))).collect()] == [
        '<div class="job-description"><p>a</p></div>', '<div class="job-description">x</div>', "<div>y</div>", "<p>No description available</p>", "<p>No description available</p>"
    ]


def test_requests(spark):
    a = api.PostingApi(spark, "/root/testdata/sf0.001")
    rows, meta = a.search(include=["clerk"], page="1", limit="5")
    assert rows.count() <= 5 and "companyName" in rows.columns and meta.first()["page"] == 1
    key = a._jobs().agg(F.min("internal_id")).first()[0]
    assert a.update(key, {"name": "Changed"}).filter(F.col("internal_id") == key).first()["name"] == "Changed"
    assert a.remove(key).filter(F.col("internal_id") == key).count() == 0
    assert a.create({"id": "new", "name": "n"}).filter("id = 'new'").count() == 1
    with pytest.raises(api.NotFound):
        a.get(-5)
    assert a.health().first()["status"] == "ok" and a.job_classes().count() == 28 and a.sources().count() == 5


def test_sources_and_sinks(spark, posts, tmp_path):
    assert sinks.append_rows(posts, str(tmp_path / "store")) == 9 and sinks.append_rows(posts, str(tmp_path / "store")) == 9
    assert spark.read.parquet(str(tmp_path / "store")).count() == 18
    sinks.write_csv(spark.createDataFrame([(1, 'a "b", \nc')], "internal_id bigint, name string"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape="\\", multiLine=True).first()["name"] == 'a "b", \nc'
    (tmp_path / "feed.json").write_text('[{"id": "1", "company": {"name": "Acme"}}, {"id": "2", "company": "Beta"}, {"id": "3"}]')
    assert [(r.id, r.company) for r in tables.json_feed(spark, str(tmp_path / "feed.json")).orderBy("id").collect()] == [("1", "Acme"), ("2", "Beta"), ("3", None)]
    (tmp_path / "prompt.txt").write_text("a\nb")
    assert tables.whole_text(spark, str(tmp_path / "prompt.txt")).first()["value"] == "a\nb"


def test_pages_read_back_as_they_were(spark, tmp_path):
    page = spark.createDataFrame([(1, "<p>a\n\tb</p>\n")], "page_id bigint, html string")
    sinks.write_pages(page, str(tmp_path / "pages"))
    assert spark.read.json(str(tmp_path / "pages")).first()["html"] == "<p>a\n\tb</p>\n"
    path = sinks.export_csv(api.export(spark.createDataFrame([("7", None, "a", None)], "id string, name string, source string, job_class string").selectExpr("*", *[f"'x' AS {c}" for c in api.EXPORT if c not in ("id", "name", "source", "job_class")])), str(tmp_path), api.file_name(["a b"], "2025-01-01T10:00:00Z"))
    assert path.endswith("job_search_a-b_2025-01-01.csv")
    row = spark.read.csv(path, header=True).first().asDict()
    assert list(row) == list(api.EXPORT.values()) and row["Category"] == "N/A" and row["ID"] == "7"


STORED = "internal_id bigint, id string, name string, company_name string, description string, source string, job_class string"


def stored_rows(spark, n=10):
    rows = [(i, f"k{i}", "N/A", "N/A", [None, "", "N/A", "done"][i % 4], "LinkedIn" if i % 2 else "JobsDB", None) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, STORED)


def linked_page(i):
    return f'<h1 class="topcard__title"> Clerk {i} </h1><a class="topcard__org-name-link">Acme</a><div class="jobs-box__html-content"><p>Line {i}</p><p>two</p></div>'


def test_a_detail_run_lays_results_on_the_postings(spark):
    stored = stored_rows(spark)
    pages = spark.createDataFrame([(f"k{i}", linked_page(i)) for i in (1, 5)] + [("k9", "<p></p>")], "id string, html string")
    config = worklist.RunConfig.from_dict({"source_platform": "LinkedIn", "quantity": 10, "workers": 2, "save": "true"})
    done = runs.detail_run(config, stored, pages)
    got = {r.internal_id: (r.description, r.name, r.company_name) for r in done.stored.collect()}
    assert got[1] == ("Line 1\ntwo", "Clerk 1", "Acme") and got[5][0] == "Line 5\ntwo" and got[9] == ("N/A", "N/A", "N/A") and got[3] == ("done", "N/A", "N/A") and got[2] == ("N/A", "N/A", "N/A")
    assert done.summary.first().asDict() == {"success": True, "jobs_processed": 3, "success_count": 2, "failure_count": 1}
    # without save the postings stay as they are
    preview = runs.detail_run(worklist.RunConfig.from_dict({"source_platform": "linkedin", "quantity": 10}), stored, pages)
    assert sorted(map(tuple, preview.stored.collect()), key=str) == sorted(map(tuple, stored.collect()), key=str)
    refused = runs.run_from_args(["source_platform=Nowhere, quantity=3"])(stored, pages)
    assert refused.summary.first()["success"] is False
    # an empty worklist is a run of nothing
    none = runs.detail_run(config, stored.filter("description = 'done'"), pages)
    assert none.summary.first()["jobs_processed"] == 0


def test_a_worker_run_marks_failed_rows(spark):
    stored = stored_rows(spark)
    pages = spark.createDataFrame([("k1", "one"), ("k5", ""), ("k9", None)], "id string, html string")

    def fetch(key, page):
        if page is None:
            raise TimeoutError(key)
        return {"description": page}

    config = worklist.RunConfig.from_dict({"source_platform": "LinkedIn", "quantity": 10, "workers": 3, "save": True})
    done = runs.worker_run(config, stored, pages, fetch)
    got = {r.internal_id: r.description for r in done.stored.collect()}
    assert (got[1], got[5], got[9]) == ("one", "N/A", "Error: TimeoutError")
    assert done.summary.first()["failure_count"] == 2


def test_a_listing_run_appends_new_postings_and_sums_pages(spark):
    pages = spark.createDataFrame([(1, CARD), (2, CARD.replace("42", "k2")), (3, CARD.replace("42", "43"))], "page int, html string")
    config = worklist.RunConfig.from_dict({"source_platform": "JobsDB", "start_page": 1, "end_page": 3, "save": True})
    done = runs.listing_run(config, stored_rows(spark), pages, "2025-01-01")
    assert {r.id for r in done.stored.filter("internal_id IS NULL").collect()} == {"42", "43"}
    assert [(r.page, r.jobs_found, r.total_jobs) for r in done.counters.orderBy("page").collect()] == [(1, 1, 1), (3, 1, 2)]
    assert done.summary.first()["pages_scraped"] == 3


def test_platforms_and_contract():
    with pytest.raises(TypeError):
        boards.Board()  # the contract has to be filled in
    assert worklist.RunConfig.from_dict({"method": "odd"}).method == "selenium" and worklist.RunConfig.from_dict({"method": "scrapy"}).method == "scrapy"


def test_unknown_platforms_are_an_error(spark):
    platforms = spark.createDataFrame([(1, "JobsDB"), (4, "LinkedIn")], "id int, name string")
    assert worklist.known_platform(platforms, "linkedin") == (4, "LinkedIn") and worklist.known_platform(platforms, 1) == (1, "JobsDB")
    with pytest.raises(LookupError):
        worklist.known_platform(platforms, "all")


def test_skills_are_whole_words(spark):
    rows = spark.createDataFrame([("JavaScript and SQL",), ("java, js",), ("mysqlx",), (None,)], "c string")
    assert [r[0] for r in rows.select(matching.found_skills(F.col("c"))).collect()] == [["javascript", "sql"], ["java", "javascript"], [], []]


def test_pairs_of_similar_titles_equal_brute_force(spark):
    import math

    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    docs = {f"d{i}": [rng.choice(words) for _ in range(rng.randrange(1, 5))] for i in range(60)}
    docs |= {"e": [], "f": ["only"]}
    df = {w: sum(w in t for t in docs.values()) for w in {x for t in docs.values() for x in t}}
    vec = {k: {w: t.count(w) * math.log((len(docs) + 1) / df[w]) for w in set(t)} for k, t in docs.items()}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in vec.items()}
    want = {(a, b) for a in docs for b in docs if a < b and norm[a] * norm[b] and round(sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) / norm[a] / norm[b], 6) >= 0.85}
    frame = spark.createDataFrame(list(docs.items()), "k string, tokens array<string>")
    assert {(r.a, r.b) for r in matching.tfidf_pairs(frame, "k").collect()} == want and len(want) > 5


def test_formatters_are_pluggable(spark):
    rows = spark.createDataFrame([("x",), ("",), (None,)], "c string")
    shout = F.pandas_udf(lambda s: s.str.upper(), "string")
    assert [r[0] for r in rows.select(html.formatted(F.col("c"), shout)).collect()] == ['<div class="job-description">X</div>', "<p>No description available</p>", "<p>No description available</p>"]


def test_imports_keep_the_latest_posting(spark):
    rows = spark.createDataFrame([("a", "2025-01-02", 1, "x"), ("a", "2025-01-03", 2, "y"), ("a", None, 3, "z"), ("b", None, 4, "u"), ("b", None, 5, "v")], "id string, date_posted string, n int, name string")
    assert {r.id: r.name for r in ingest.latest_import(rows, "id", "date_posted", "n").collect()} == {"a": "y", "b": "v"}


def test_streamed_batches_append_only_new_keys(spark, tmp_path):
    raw = tables.table(spark, "/root/testdata/sf0.001", "jobs_raw")
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for b in (1, 2, 3):
        raw.filter(F.col("batch_no") == b).coalesce(1).write.mode("append").parquet(source)
    records = ingest_stream.read_records(spark, source)
    q = ingest_stream.append_new(records, store, str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    told = raw.filter("batch_no <= 3").withColumn("external_id", ingest.external_id(F.col("external_id"), F.col("raw_data")))
    want = told.filter("external_id IS NOT NULL").select("source", "external_id").distinct().count() + told.filter("external_id IS NULL").count()
    assert spark.read.parquet(store).count() == want
    counts = ingest_stream.crawl_counts(records).writeStream.format("memory").queryName("crawl_counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    assert counts.awaitTermination(120)
    assert spark.table("crawl_counts").agg(F.sum("n")).first()[0] == raw.filter("batch_no <= 3").count()
