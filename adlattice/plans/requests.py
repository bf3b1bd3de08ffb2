"""Registered queries of requests, their rules, remaining keyed changes and round trips through files, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlattice.functions import html
from adlattice.operators import api, search, terms, worklist
from adlattice.plans.reference import PAGE, exact_sql, jobs, keyed_update, like, query, ranked
from adlattice.session import shared_dir
from adlattice.sources import sinks, tables

keyed_update("update_class", "job_class", "klass", "job_class")
keyed_update("update_company", "company_name", "firm", "company")


@query("SELECT internal_id, name, source FROM jobs UNION ALL SELECT NULL, 'New desk', 'JobsDB'")
def created_row(s: SparkSession, d: str) -> DataFrame:
    return api.PostingApi(s, d).create({"name": "New desk", "source": "JobsDB"}).select("internal_id", "name", "source")


FIRST = "(SELECT min(internal_id) FROM jobs)"


@query(f"SELECT internal_id, CASE WHEN internal_id = {FIRST} THEN 'Changed' ELSE name END AS name, remark FROM jobs")
def updated_row(s: SparkSession, d: str) -> DataFrame:
    key = jobs(s, d).agg(F.min("internal_id")).first()[0]
    return api.PostingApi(s, d).update(key, {"name": "Changed"}).select("internal_id", "name", "remark")


@query(f"SELECT internal_id FROM jobs WHERE internal_id <> {FIRST}")
def removed_row(s: SparkSession, d: str) -> DataFrame:
    key = jobs(s, d).agg(F.min("internal_id")).first()[0]
    return api.PostingApi(s, d).remove(key).select("internal_id")


def answered(page: DataFrame) -> DataFrame:
    rows = page.select("internalId", "id", "name", "companyName", "source").toDF("internal_id", "id", "name", "company_name", "source")
    return ranked(rows, F.desc("internal_id"))


@query(f"SELECT {PAGE} FROM jobs WHERE description <> 'N/A' ORDER BY internal_id DESC LIMIT 20")
def request_without_terms(s: SparkSession, d: str) -> DataFrame:
    """A search request whose lists are all empty is the plain listing, with the default page and size."""
    return answered(api.PostingApi(s, d).search(page="0", limit="x")[0])


@query(f"SELECT {PAGE} FROM jobs WHERE description <> 'N/A' AND ({like('officer')} OR {like('clerk')}) AND {exact_sql('You')} AND NOT {like('warehouse')} AND NOT {exact_sql('Ltd.')} ORDER BY internal_id DESC LIMIT 7")
def request_with_terms(s: SparkSession, d: str) -> DataFrame:
    given = [terms.parse_term("warehouse", True), terms.parse_term("=You"), terms.parse_term(" officer/clerk "), terms.parse_term("=Ltd.", True), terms.parse_term("gone"), terms.parse_term("  ")]
    kept = terms.partition_terms(terms.remove_term([t for t in given if t], terms.SearchTerm("gone")))
    return answered(api.PostingApi(s, d).search(kept["include"], kept["exclude"], kept["exact"], kept["exact_exclude"], limit=7)[0])


@query("SELECT count(*) AS total, CAST(2 AS BIGINT) AS page, CAST(7 AS BIGINT) AS \"limit\", CAST(ceil(count(*) / 7.0) AS BIGINT) AS total_pages FROM jobs WHERE description <> 'N/A' AND source = 'JobsDB'")
def request_meta(s: SparkSession, d: str) -> DataFrame:
    return api.PostingApi(s, d).jobs(page="2", limit="7", source="JobsDB")[1]


def config_text(c: worklist.RunConfig) -> str:
    return f"{c.run_type} {c.quantity} {c.start_page} {c.end_page} {c.workers} {c.save} {c.detail_filter} {c.method}"


RULES: list[tuple[str, str, object, str]] = [
    ("page and size", "missing", lambda: api.page_params(), "(1, 20)"),
    ("page and size", "0 and 7", lambda: api.page_params("0", "7"), "(1, 7)"),
    ("page and size", "unreadable", lambda: api.page_params("x", "0"), "(1, 20)"),
    ("page in range", "9 of 3", lambda: api.clamp_page(9, 3), "3"),
    ("page in range", "-1 of 0", lambda: api.clamp_page(-1, 0), "1"),
    ("showing", "page 3 of 45 by 20", lambda: api.showing(3, 20, 45), "(41, 45)"),
    ("file name", "two terms", lambda: api.file_name(["a b", "c"], "2025-01-02T10:00:00Z"), "job_search_a-b_c_2025-01-02.csv"),
    ("terms of a query", "comma and slash", lambda: terms.parse_query(" a , b/c,, "), "['a', 'b', 'c']"),
    ("mode", "comma", lambda: terms.query_mode("a,b"), "AND"),
    ("mode", "slash", lambda: terms.query_mode("a/b"), "OR"),
    ("run", "quantity below 1", lambda: config_text(worklist.RunConfig.from_args(["quantity=0,", "save=TRUE, workers=-3, junk=1"])), "1 1 None None 1 True new selenium"),
    ("run", "end before start", lambda: config_text(worklist.RunConfig.from_dict({"start_page": "4", "end_page": "2", "detail_filter": "odd", "method": "scrapy"})), "2 None 4 4 1 False new scrapy"),
    ("run", "nothing given", lambda: config_text(worklist.RunConfig.from_dict({"workers": "no"})), "1 1 None None 1 False new selenium"),
]


@query(" UNION ALL ".join("SELECT '{}' AS rule, '{}' AS given, '{}' AS result".format(a, b, r.replace("'", "''")) for a, b, _, r in RULES))
def request_rules(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(a, b, str(f())) for a, b, f, _ in RULES], "rule string, given string, result string")


@query("SELECT internal_id, CAST(internal_id AS VARCHAR) AS job_id FROM jobs")
def linked_card_ids(s: SparkSession, d: str) -> DataFrame:
    """The number of a card from its attribute, its link or its script, by the kind of work of the posting."""
    key, kind = F.col("internal_id").cast("string"), F.col("work_type")
    card = F.when(kind.isNull(), F.concat(F.lit('<li><a href="https://board.example/jobs/view/'), key, F.lit('/?x=1">')))
    card = card.when(kind == "Full time", F.concat(F.lit('<li data-occludable-job-id="job-'), key, F.lit('">'))).otherwise(F.concat(F.lit('<li><script>jobId="'), key, F.lit('"</script>')))
    return jobs(s, d).select("internal_id", html.linked_card_id(card).alias("job_id"))


def scratch(s: SparkSession) -> str:
    return f"{shared_dir(s)}/trip-{uuid.uuid4().hex}"


@query("SELECT " + ", ".join(f"coalesce(nullif({c}, ''), 'N/A') AS \"{n}\"" if c == "job_class" else f"coalesce({c}, '') AS \"{n}\"" for c, n in api.EXPORT.items()) + " FROM jobs WHERE description <> 'N/A' AND source = 'JobsDB'")
def export_file(s: SparkSession, d: str) -> DataFrame:
    """An export written as a file and read back."""
    path = sinks.export_csv(api.export(search.listing(jobs(s, d), source="JobsDB")), scratch(s), api.file_name([], "2025-01-02"))
    return s.read.csv(path, header=True, escape="\\", multiLine=True, emptyValue="").na.fill("")


@query("SELECT internal_id, description FROM jobs WHERE description IS NOT NULL")
def pages_file(s: SparkSession, d: str) -> DataFrame:
    """Raw pages written and read back with their line breaks."""
    path = scratch(s)
    sinks.write_pages(jobs(s, d).filter("description IS NOT NULL").select("internal_id", "description"), path)
    return s.read.schema("internal_id bigint, description string").json(path)


@query("SELECT 2 * count(*) AS n, (SELECT count(*) FROM jobs_raw) AS appended FROM jobs_raw")
def appended_file(s: SparkSession, d: str) -> DataFrame:
    """Two appends to one store, each with the number of rows it wrote."""
    path, rows = scratch(s), tables.table(s, d, "jobs_raw").select("id", "source")
    written = [sinks.append_rows(rows, path) for _ in range(2)]
    return s.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).withColumn("appended", F.lit(written[1]).cast("bigint"))


@query("SELECT 'line one' || chr(10) || 'line two' AS value")
def text_file(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    s.createDataFrame([("line one\nline two",)], "value string").coalesce(1).write.option("lineSep", "\0").text(path)
    return tables.whole_text(s, path).select(F.rtrim(F.replace("value", F.lit("\0"), F.lit(""))).alias("value"))
