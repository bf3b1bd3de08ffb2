"""Registered queries of the posting engine, each beside the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adlattice.functions import dates, html
from adlattice.operators import api, crawl, ingest, matching, search, terms, worklist
from adlattice.sources.tables import feed_columns, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def jobs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "jobs")


def like(term: str) -> str:
    t = term.replace("'", "''")
    return "(" + " OR ".join(f"coalesce({c} ILIKE '%{t}%', false)" for c in terms.TEXT_COLUMNS) + ")"


def exact_sql(term: str) -> str:
    joined = "coalesce(name,'null') || ' ' || coalesce(company_name,'null') || ' ' || coalesce(description,'null')"
    return f"contains({joined}, '{term}')"


PAGE_COLS = ["internal_id", "id", "name", "company_name", "source"]
PAGE = ", ".join(PAGE_COLS) + ", row_number() OVER (ORDER BY internal_id DESC) AS rank"


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """The order of a short result as a column, where order is what is asked for."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def paged(df: DataFrame, no: int = 1, limit: int = 20) -> DataFrame:
    page = search.page(df.select(*PAGE_COLS), no, limit)
    return ranked(page, F.desc("internal_id")).withColumn("rank", F.col("rank") + (no - 1) * limit)


# --- listing, paging, keyword and term search -------------------------------------------------------


@query(f"SELECT {PAGE} FROM jobs WHERE description <> 'N/A' ORDER BY internal_id DESC LIMIT 20 OFFSET 40")
def listing_page(s: SparkSession, d: str) -> DataFrame:
    return paged(search.listing(jobs(s, d)), 3)


@query(f"SELECT {PAGE} FROM jobs WHERE description <> 'N/A' AND job_class = 'Retail' AND source = 'JobsDB' ORDER BY internal_id DESC LIMIT 20")
def listing_page_filtered(s: SparkSession, d: str) -> DataFrame:
    return paged(search.listing(jobs(s, d), "Retail", "JobsDB"))


@query("SELECT count(*) AS total, CAST(1 AS BIGINT) AS page, CAST(20 AS BIGINT) AS \"limit\", CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM jobs WHERE description <> 'N/A'")
def page_meta(s: SparkSession, d: str) -> DataFrame:
    return search.page_meta(search.listing(jobs(s, d)))


@query(f"SELECT {PAGE} FROM jobs WHERE description <> 'N/A' AND {like('python')} AND {like('officer')} ORDER BY internal_id DESC LIMIT 20")
def keyword_and_page(s: SparkSession, d: str) -> DataFrame:
    return paged(search.keyword_search(jobs(s, d), "python, officer", job_class="Retail"))


@query(f"SELECT {PAGE} FROM jobs WHERE {like('python')} OR {like('officer')} ORDER BY internal_id DESC LIMIT 20")
def keyword_or_page(s: SparkSession, d: str) -> DataFrame:
    return paged(search.keyword_search(jobs(s, d), "python/officer"))


@query(f"SELECT internal_id, id FROM jobs WHERE description <> 'N/A' AND job_class = 'Retail' AND ({like('stock')} OR {like('clerk')})")
def keyword_or_filtered(s: SparkSession, d: str) -> DataFrame:
    return search.keyword_search(jobs(s, d), "stock/clerk", job_class="Retail", strict_compat=False).select("internal_id", "id")


def term_query(name: str, given: list[terms.SearchTerm], where: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        return search.term_search(jobs(s, d), given).select("internal_id", "id")

    run.__name__ = name
    query(f"SELECT internal_id, id FROM jobs WHERE description <> 'N/A' AND {where}")(run)


T = terms.SearchTerm
term_query("term_include", [T("engineer")], like("engineer"))
term_query("term_or_group", [T("nurse / chef")], f"({like('nurse')} OR {like('chef')})")
term_query("term_exact", [T("Night Shift", exact=True)], exact_sql("Night Shift"))
term_query("term_exclude", [T("the/a", exclude=True), T("urgent", exclude=True)], f"NOT {like('the/a')} AND NOT {like('urgent')}")
term_query("term_exact_exclude", [T("Contract", True, True)], f"NOT {exact_sql('Contract')}")
term_query("exact_null_text", [T("null", exact=True)], exact_sql("null"))
term_query("term_like_metacharacters", [T("c_erk%week")], like("c_erk%week"))


@query(f"SELECT {PAGE} FROM jobs WHERE description <> 'N/A' AND source = 'JobsDB' AND ({like('officer')} OR {like('clerk')}) AND {exact_sql('You')} AND NOT {like('warehouse')} AND NOT {exact_sql('Ltd.')} ORDER BY internal_id DESC LIMIT 20")
def term_search_page(s: SparkSession, d: str) -> DataFrame:
    given = [terms.parse_term("officer/clerk"), terms.parse_term("=You"), terms.parse_term("warehouse", True), terms.parse_term("=Ltd.", True)]
    return paged(search.term_search(jobs(s, d), [t for t in given if t], source="JobsDB"))


@query(f"SELECT internal_id, id FROM jobs WHERE NOT {like('urgent')}")
def exclude_by_antijoin(s: SparkSession, d: str) -> DataFrame:
    all_rows = jobs(s, d)
    return all_rows.select("internal_id", "id").join(all_rows.filter(terms.matches("urgent")).select("internal_id"), "internal_id", "left_anti")


@query("SELECT internal_id, date_scraped, row_number() OVER (ORDER BY date_scraped DESC NULLS FIRST, internal_id DESC) AS rank FROM jobs WHERE (name ILIKE '%analyst%' OR description ILIKE '%analyst%') AND source = 'JobsDB' ORDER BY date_scraped DESC NULLS FIRST, internal_id DESC LIMIT 100")
def py_search(s: SparkSession, d: str) -> DataFrame:
    return ranked(search.python_search(jobs(s, d), text="analyst", source="JobsDB").select("internal_id", "date_scraped"), F.desc_nulls_first("date_scraped"), F.desc("internal_id"))


@query("SELECT internal_id, date_scraped FROM jobs WHERE location ILIKE '%hong kong%' AND company_name ILIKE '%trading%' ORDER BY date_scraped DESC NULLS FIRST, internal_id DESC LIMIT 100")
def py_search_location_company(s: SparkSession, d: str) -> DataFrame:
    return search.python_search(jobs(s, d), location="hong kong", company="trading").select("internal_id", "date_scraped")


@query("SELECT internal_id, id, name, coalesce(company_name, '') AS company_name FROM jobs WHERE internal_id = 27")
def lookup_by_id(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).filter(F.col("internal_id") == 27).select("internal_id", "id", "name", F.coalesce("company_name", F.lit("")).alias("company_name"))


@query("SELECT id FROM jobs")
def id_projection(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select(F.col("id").cast("string").alias("id"))


@query("SELECT name, row_number() OVER (ORDER BY name NULLS LAST) AS rank FROM job_class")
def dim_job_classes(s: SparkSession, d: str) -> DataFrame:
    return ranked(table(s, d, "job_class").select("name"), F.asc_nulls_last("name")).orderBy("rank")


@query("SELECT name, row_number() OVER (ORDER BY name NULLS LAST) AS rank FROM source_platform")
def dim_sources(s: SparkSession, d: str) -> DataFrame:
    return ranked(table(s, d, "source_platform").select("name"), F.asc_nulls_last("name")).orderBy("rank")


@query("SELECT id, name FROM job_class")
def dim_class_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "job_class").select("id", "name")


@query("SELECT DISTINCT job_class AS name FROM jobs WHERE job_class <> ''")
def facet_distinct(s: SparkSession, d: str) -> DataFrame:
    return search.facet_names(jobs(s, d), "job_class")


@query("SELECT id, name FROM source_platform WHERE lower(name) = 'linkedin'")
def platform_lookup(s: SparkSession, d: str) -> DataFrame:
    return worklist.find_platform(table(s, d, "source_platform"), "LINKEDIN").select("id", "name")


# --- worklists and batches --------------------------------------------------------------------------


def worklist_query(name: str, kind: str, where: str, **given: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        return worklist.worklist(jobs(s, d), kind, limit=None, **given)

    run.__name__ = name
    query(f"SELECT internal_id, id FROM jobs WHERE {where}")(run)


worklist_query("worklist_new", "new", "(description IS NULL OR description = '')")
worklist_query("worklist_na", "N/A", "(description IS NULL OR description IN ('', 'N/A')) AND lower(source) = 'indeed'", source="Indeed")
worklist_query("worklist_all", "all", "lower(job_class) = 'retail'", job_class="RETAIL")


@query("SELECT internal_id, id, row_number() OVER (ORDER BY internal_id DESC) AS rank FROM jobs WHERE description IS NULL OR description = '' ORDER BY internal_id DESC LIMIT 100")
def worklist_top(s: SparkSession, d: str) -> DataFrame:
    return ranked(worklist.worklist(jobs(s, d), "new"), F.desc("internal_id"))


NEW = "(SELECT internal_id FROM jobs WHERE description IS NULL OR description = '')"


@query(f"WITH w AS (SELECT internal_id, row_number() OVER (ORDER BY internal_id DESC) AS r, count(*) OVER () AS n FROM {NEW}) SELECT internal_id, CAST(floor((r - 1) / ceil(n / CAST(least(5, n) AS DOUBLE))) AS BIGINT) AS batch_no FROM w")
def batch_assign(s: SparkSession, d: str) -> DataFrame:
    rows = jobs(s, d).filter(worklist.pending("new")).select("internal_id")
    return worklist.contiguous_batches(rows, 5, rows.count())


@query("SELECT name AS job_class, p AS page FROM job_class, range(1, 6) t(p)")
def work_units(s: SparkSession, d: str) -> DataFrame:
    return worklist.crawl_units(table(s, d, "job_class"), 1, 5)


@query("SELECT replace(replace(lower(name), ' ', '_'), '-', '_') AS method FROM source_platform")
def method_name(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "source_platform").select(worklist.method_name(F.col("name")).alias("method"))


STATUS_SQL = "CASE WHEN description IS NULL OR description = '' THEN 'new' WHEN description = 'N/A' THEN 'empty' WHEN starts_with(description, 'Error: ') THEN 'failed' ELSE 'done' END"


@query(f"SELECT {STATUS_SQL} AS status, count(*) AS n FROM jobs GROUP BY 1")
def enrichment_status(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).groupBy(worklist.enrichment_status(F.col("description")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# --- ingest and keyed changes -----------------------------------------------------------------------


@query("SELECT id, external_id FROM jobs_raw r WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.id = r.external_id)")
def new_jobs_anti(s: SparkSession, d: str) -> DataFrame:
    stored = jobs(s, d).select(F.col("id").alias("external_id"))
    return ingest.unseen(table(s, d, "jobs_raw").select("id", "external_id"), stored, "external_id").select("id", "external_id")


@query("SELECT id, external_id FROM jobs_raw r WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.id = r.external_id)")
def known_jobs_semi(s: SparkSession, d: str) -> DataFrame:
    stored = jobs(s, d).select(F.col("id").alias("external_id"))
    return ingest.known(table(s, d, "jobs_raw").select("id", "external_id"), stored, "external_id").select("id", "external_id")


@query("SELECT id, name, source FROM jobs UNION ALL SELECT external_id, NULL, source FROM jobs_raw WHERE batch_no = 1")
def append_batch(s: SparkSession, d: str) -> DataFrame:
    new = table(s, d, "jobs_raw").filter("batch_no = 1").select(F.col("external_id").alias("id"), "source")
    return ingest.append(jobs(s, d).select("id", "name", "source"), new)


CHANGES = "(SELECT id, min(internal_id) AS internal_id FROM jobs GROUP BY id)"
FIRST_RAW = "(SELECT external_id AS id, max(TRY_CAST(raw_data AS JSON)->>'$.description') AS fresh, max(TRY_CAST(raw_data AS JSON)->>'$.name') AS title, max(TRY_CAST(raw_data AS JSON)->>'$.job_class') AS klass, max(coalesce(TRY_CAST(raw_data AS JSON)->>'$.company.name', CASE WHEN json_type(TRY_CAST(raw_data AS JSON)->'$.company') = 'VARCHAR' THEN TRY_CAST(raw_data AS JSON)->>'$.company' END)) AS firm FROM jobs_raw WHERE external_id IS NOT NULL GROUP BY 1)"


def keyed_update(name: str, column: str, fresh: str, path: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        told = feed_columns(F.col("raw_data"))[path]
        changes = table(s, d, "jobs_raw").filter("external_id IS NOT NULL").groupBy(F.col("external_id").alias("id")).agg(F.max(told).alias(column))
        return ingest.update_by_external_id(jobs(s, d).select("internal_id", "id", column), changes, [column])

    run.__name__ = name
    query(f"SELECT j.internal_id, j.id, coalesce(c.fresh, j.{column}) AS {column} FROM jobs j LEFT JOIN (SELECT f.internal_id, r.{fresh} AS fresh FROM {CHANGES} f JOIN {FIRST_RAW} r ON f.id = r.id) c ON c.internal_id = j.internal_id")(run)


keyed_update("update_description", "description", "fresh", "description")
keyed_update("update_title", "name", "title", "name")


@query("SELECT internal_id, CASE WHEN internal_id % 5 = 0 THEN 'checked' ELSE remark END AS remark, CASE WHEN internal_id % 5 = 0 THEN coalesce(location, 'Unknown Location') ELSE location END AS location FROM jobs")
def partial_update(s: SparkSession, d: str) -> DataFrame:
    rows = jobs(s, d).select("internal_id", "remark", "location")
    changes = rows.filter("internal_id % 5 = 0").select("internal_id", F.lit("checked").alias("remark"), F.when(F.col("location").isNull(), "Unknown Location").alias("location"))
    return ingest.overlay(rows, changes, ["remark", "location"])


@query("SELECT internal_id, id FROM jobs WHERE internal_id NOT IN (SELECT job_id FROM applications WHERE job_id IS NOT NULL)")
def delete_by_id(s: SparkSession, d: str) -> DataFrame:
    gone = table(s, d, "applications").select(F.col("job_id").alias("internal_id"))
    return ingest.delete_rows(jobs(s, d).select("internal_id", "id"), gone)


@query(f"SELECT j.internal_id, CASE WHEN j.description IS NULL OR j.description IN ('', 'N/A') THEN CASE WHEN r.fresh IS NOT NULL AND r.fresh NOT IN ('', 'N/A') THEN r.fresh ELSE 'N/A' END ELSE j.description END AS description FROM jobs j LEFT JOIN {FIRST_RAW} r ON r.id = j.id")
def enrich_apply(s: SparkSession, d: str) -> DataFrame:
    rows = jobs(s, d)
    told = table(s, d, "jobs_raw").filter("external_id IS NOT NULL").groupBy(F.col("external_id").alias("id")).agg(F.max(feed_columns(F.col("raw_data"))["description"]).alias("description"))
    details = rows.filter(worklist.pending("N/A")).select("internal_id", "id").join(told, "id", "left").select("internal_id", "description")
    return ingest.apply_details(rows.select("internal_id", "description"), details)


OK_SQL = "description IS NOT NULL AND description NOT IN ('', 'N/A') AND NOT starts_with(description, 'Error: ')"


@query(f"SELECT internal_id % 8 AS worker, count(*) FILTER (WHERE {OK_SQL}) AS succeeded, count(*) FILTER (WHERE NOT coalesce({OK_SQL}, false)) AS failed FROM jobs GROUP BY 1")
def worker_counters(s: SparkSession, d: str) -> DataFrame:
    return ingest.run_counters(jobs(s, d).withColumn("worker", F.col("internal_id") % 8))


@query(f"SELECT CAST(count(*) FILTER (WHERE {OK_SQL}) AS BIGINT) AS succeeded, CAST(count(*) FILTER (WHERE NOT coalesce({OK_SQL}, false)) AS BIGINT) AS failed, CAST(8 AS BIGINT) AS workers FROM jobs")
def run_summary(s: SparkSession, d: str) -> DataFrame:
    return ingest.run_total(worker_counters(s, d))


@query("SELECT DISTINCT external_id AS id, 'N/A' AS name, '' AS description, 'N/A' AS company_name, 'LinkedIn' AS source, '2025-12-01' AS date_posted, '2025-12-01' AS date_scraped FROM jobs_raw WHERE regexp_full_match(external_id, '\\d+') AND external_id NOT IN (SELECT id FROM jobs WHERE id IS NOT NULL)")
def stub_rows(s: SparkSession, d: str) -> DataFrame:
    listed = table(s, d, "jobs_raw").select(F.concat(F.lit('<ul><li class="x" data-occludable-job-id="'), "external_id", F.lit('"></li></ul>')).alias("html"))
    return crawl.id_stubs(listed, jobs(s, d).select("id"), "2025-12-01").select("id", "name", "description", "company_name", "source", "date_posted", "date_scraped")


# --- HTML, text and dates ---------------------------------------------------------------------------

CARD_SQL = "'<ul><article data-job-id=\"' || coalesce(id, '') || '\"><a data-automation=\"jobCompany\">' || coalesce(company_name, '') || '</a></article><article data-job-id=\"x' || internal_id || '\"><span data-automation=\"jobLocation\">' || coalesce(location, '') || '</span></article></ul>'"


def pages(s: SparkSession, d: str) -> DataFrame:
    html_text = F.concat(
        F.lit('<ul><article data-job-id="'), F.coalesce("id", F.lit("")), F.lit('"><a data-automation="jobCompany">'), F.coalesce("company_name", F.lit("")),
        F.lit('</a></article><article data-job-id="x'), F.col("internal_id").cast("string"), F.lit('"><span data-automation="jobLocation">'), F.coalesce("location", F.lit("")), F.lit("</span></article></ul>"),
    )
    return jobs(s, d).select("internal_id", html_text.alias("html"))


CARDS_SQL = f"WITH p AS (SELECT internal_id, regexp_extract_all({CARD_SQL}, '(?s)<article[^>]*data-job-id=[^>]*>.*?</article>') AS c FROM jobs)"


@query(CARDS_SQL + " SELECT internal_id, CAST(i - 1 AS INT) AS pos, c[i] AS card FROM p, range(1, 3) t(i)")
def card_explode(s: SparkSession, d: str) -> DataFrame:
    return html.cards(pages(s, d))


@query(CARDS_SQL + " SELECT internal_id, CAST(0 AS INT) AS pos, c[1] AS card FROM p")
def card_head_limit(s: SparkSession, d: str) -> DataFrame:
    return html.cards(pages(s, d), limit=1)


@query("SELECT internal_id, nullif(trim(coalesce(id, '')), '') AS job_id, coalesce(nullif(trim(regexp_replace(regexp_replace(coalesce(company_name, ''), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), ''), 'Unknown Company') AS company, 'Unknown Location' AS location FROM jobs")
def card_parse(s: SparkSession, d: str) -> DataFrame:
    card = F.col("card")
    return html.cards(pages(s, d), limit=1).select(
        "internal_id", html.card_id(card).alias("job_id"), html.field(card, "jobCompany", "Unknown Company").alias("company"), html.field(card, "jobLocation", "Unknown Location").alias("location")
    )


@query("SELECT internal_id, regexp_matches(description, '(?is)<[a-z].*>') AS is_html, regexp_replace(description, '<[^>]*>', ' ', 'g') AS text FROM jobs WHERE description IS NOT NULL")
def html_text(s: SparkSession, d: str) -> DataFrame:
    c = F.col("description")
    return jobs(s, d).filter(c.isNotNull()).select("internal_id", html.is_html(c).alias("is_html"), html.strip_tags(c).alias("text"))


@query("SELECT internal_id, coalesce(nullif(trim(regexp_extract(description, '(?s)<title>(.*?)</title>', 1)), ''), nullif(trim(regexp_extract(description, '(?s)<h1>(.*?)</h1>', 1)), ''), 'N/A') AS title FROM jobs")
def html_title(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select("internal_id", F.coalesce(html.first_match(F.col("description"), r"(?s)<title>(.*?)</title>", r"(?s)<h1>(.*?)</h1>"), F.lit("N/A")).alias("title"))


@query("SELECT internal_id, CASE WHEN job_class IS NULL OR job_class = '' THEN 'N/A' WHEN regexp_matches(job_class, '\\(.*?\\)') THEN regexp_extract(job_class, '\\((.*?)\\)', 1) ELSE job_class END AS job_class FROM jobs")
def job_class_paren(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select("internal_id", html.in_parentheses(F.col("job_class")).alias("job_class"))


@query("SELECT internal_id, trim(regexp_replace(coalesce(company_name, ''), '\\s+', ' ', 'g')) AS company_name FROM jobs")
def clean_text(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select("internal_id", html.collapse(F.col("company_name")).alias("company_name"))


FENCE = "CASE WHEN work_type IS NULL THEN remark WHEN work_type = 'Full time' THEN '```html\n<div class=\"x\">' || remark || '</div>```' ELSE 'Here it is: ```\n' || remark || '\n``` done' END"


@query(f"SELECT internal_id, CASE WHEN trim(coalesce(t, '')) = '' THEN '<p>No description available</p>' WHEN starts_with(b, '<div') THEN b ELSE '<div class=\"job-description\">' || b || '</div>' END AS html FROM (SELECT internal_id, t, regexp_replace(coalesce(nullif(regexp_extract(t, '(?s)```html(.*?)```', 1), ''), nullif(regexp_extract(t, '(?s)```(.*?)```', 1), ''), t), '^\\s+|\\s+$', '', 'g') AS b FROM (SELECT internal_id, {FENCE} AS t FROM jobs))")
def llm_postprocess(s: SparkSession, d: str) -> DataFrame:
    kind, text = F.col("work_type"), F.col("remark")
    fenced = F.when(kind.isNull(), text).when(kind == "Full time", F.concat(F.lit('```html\n<div class="x">'), text, F.lit("</div>```"))).otherwise(F.concat(F.lit("Here it is: ```\n"), text, F.lit("\n``` done")))
    return jobs(s, d).select("internal_id", html.unfence(fenced).alias("html"))


@query("SELECT internal_id, CASE WHEN trim(coalesce(remark, '')) = '' THEN '<p>No description available</p>' ELSE '<p>' || remark || '</p>' END AS html FROM jobs")
def formatter_failed(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select("internal_id", html.formatted(F.col("remark"), lambda c: F.lit(None).cast("string")).alias("html"))


NOW = "2025-12-01 00:00:00"


def now() -> Column:
    return F.to_timestamp_ntz(F.lit(NOW))




@query(
    f"SELECT internal_id, strftime(CASE WHEN date_posted IS NULL THEN NULL WHEN contains(date_posted, 'd ago') THEN TIMESTAMP '{NOW}' - to_days(TRY_CAST(trim(split_part(date_posted, 'd ago', 1)) AS INT)) WHEN contains(date_posted, 'h ago') THEN TIMESTAMP '{NOW}' - to_hours(TRY_CAST(trim(split_part(date_posted, 'h ago', 1)) AS INT)) "
    f"WHEN contains(date_posted, 'm ago') THEN TIMESTAMP '{NOW}' - to_minutes(TRY_CAST(trim(split_part(date_posted, 'm ago', 1)) AS INT)) ELSE TIMESTAMP '{NOW}' END, '%Y-%m-%d %H:%M:%S') AS posted FROM jobs"
)
def rel_date_short(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select("internal_id", F.date_format(dates.short_relative(F.col("date_posted"), now()), "yyyy-MM-dd HH:mm:ss").alias("posted"))


@query(
    "WITH x AS (SELECT internal_id, date_posted AS c, TRY_CAST(regexp_extract(date_posted, '(\\d+)', 1) AS INT) AS n FROM jobs) SELECT internal_id, CAST(coalesce(CASE "
    + " ".join(f"WHEN regexp_matches(c, '\\d+ {u}.* ago') THEN TIMESTAMP '{NOW}' - {f}" for u, f in (("day", "to_days(n)"), ("hour", "to_hours(n)"), ("week", "to_days(n * 7)"), ("month", "to_days(n * 30)")))
    + f" ELSE try_strptime(c, '%b %d, %Y') END, TIMESTAMP '{NOW}') AS DATE) AS posted FROM x"
)
def rel_date_long(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select("internal_id", dates.long_relative(F.col("date_posted"), now()).alias("posted"))


@query("SELECT id, strftime(applied_at + INTERVAL 8 HOUR, '%Y-%m-%d') AS day FROM applications")
def hkt_date(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "applications").select("id", dates.local_date(F.col("applied_at").cast("timestamp_ntz")).alias("day"))


@query(
    "WITH x AS (SELECT id AS raw_id, TRY_CAST(raw_data AS JSON) AS j FROM jobs_raw) SELECT raw_id, j->>'$.name' AS name, coalesce(j->>'$.company.name', CASE WHEN json_type(j->'$.company') = 'VARCHAR' THEN j->>'$.company' END) AS company, j->>'$.location' AS location FROM x"
)
def json_feed_fields(s: SparkSession, d: str) -> DataFrame:
    f = feed_columns(F.col("raw_data"))
    return table(s, d, "jobs_raw").select(F.col("id").alias("raw_id"), *[f[n].alias(n) for n in ("name", "company", "location")])


@query("SELECT internal_id, 'https://board.example/search?keywords=' || replace(replace(name, ' ', '%20'), '&', '%26') || '&start=' || CAST((internal_id % 4) * 25 AS VARCHAR) AS url FROM jobs WHERE regexp_matches(name, '^[A-Za-z0-9 &-]*$')")
def url_build(s: SparkSession, d: str) -> DataFrame:
    encoded = F.replace(F.url_encode("name"), F.lit("+"), F.lit("%20"))
    url = F.concat(F.lit("https://board.example/search?keywords="), encoded, F.lit("&start="), ((F.col("internal_id") % 4) * 25).cast("string"))
    return jobs(s, d).filter(F.col("name").rlike("^[A-Za-z0-9 &-]*$")).select("internal_id", url.alias("url"))


def falsy(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)).alias(c)


@query("SELECT internal_id, coalesce(nullif(name, ''), 'Unnamed Position') AS name, coalesce(nullif(company_name, ''), 'Unknown Company') AS company_name, coalesce(nullif(location, ''), 'N/A') AS location, coalesce(nullif(description, ''), 'No description available') AS description FROM jobs")
def display_fallback(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select("internal_id", falsy("name", "Unnamed Position"), falsy("company_name", "Unknown Company"), falsy("location", "N/A"), falsy("description", "No description available"))


EXPORT = api.EXPORT


@query("SELECT " + ", ".join(f"coalesce(nullif({c}, ''), 'N/A') AS \"{n}\"" if c == "job_class" else f"coalesce({c}, '') AS \"{n}\"" for c, n in EXPORT.items()) + " FROM jobs WHERE description <> 'N/A'")
def export_rows(s: SparkSession, d: str) -> DataFrame:
    return api.export(search.listing(jobs(s, d)))


def width_sql(c: str) -> str:
    return f"SELECT '{c}' AS name, CAST(least(greatest(coalesce(max(length(split_part({c}, chr(10), 1))), 0), {len(c)}) + 1, 70) AS BIGINT) AS width FROM jobs"


@query(" UNION ALL ".join(map(width_sql, ("name", "company_name", "location"))))
def column_width(s: SparkSession, d: str) -> DataFrame:
    cols = ("name", "company_name", "location")
    width = [F.struct(F.lit(c).alias("name"), F.least(F.greatest(F.coalesce(F.max(F.length(F.split_part(F.col(c), F.lit("\n"), F.lit(1)))), F.lit(0)), F.lit(len(c))) + 1, F.lit(70)).cast("bigint").alias("width")) for c in cols]
    return jobs(s, d).agg(F.array(*width).alias("w")).select(F.inline("w"))


# --- matching, skills and board statistics ----------------------------------------------------------


def skills_sql(c: str) -> str:
    names = ", ".join(f"CASE WHEN regexp_matches(lower(coalesce({c}, '')), '{matching.skill_pattern(k)}') THEN '{matching.ALIASES.get(k, k)}' END" for k in (*matching.SKILLS, *matching.ALIASES))
    return f"list_sort(list_filter(list_distinct([{names}]), lambda x: x IS NOT NULL))"


def years_sql(c: str) -> str:
    return f"coalesce(TRY_CAST(regexp_extract(lower(coalesce({c}, '')), '(\\d{{1,2}})\\+? years?', 1) AS INT), 0)"


SCORED = f"SELECT a.id, a.job_id, a.user_id, a.resume_id, {skills_sql('j.description')} AS wanted, {skills_sql('r.text')} AS have, {years_sql('j.description')} AS yw, {years_sql('r.text')} AS yh, j.location, r.text FROM applications a JOIN jobs j ON j.internal_id = a.job_id JOIN documents r ON r.doc_id = a.resume_id"
JACCARD = "CASE WHEN len(list_distinct(wanted || have)) > 0 THEN round(len(list_intersect(wanted, have)) * CAST(100.0 AS DOUBLE) / len(list_distinct(wanted || have)), 4) ELSE CAST(0 AS DOUBLE) END"


def scored(s: SparkSession, d: str) -> DataFrame:
    return matching.scored_applications(table(s, d, "applications").select("id", "job_id", "user_id", "resume_id"), jobs(s, d), table(s, d, "documents"))


@query(f"SELECT id, {JACCARD} AS score FROM ({SCORED})")
def match_jaccard(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).select("id", matching.jaccard(F.col("wanted"), F.col("have")).alias("score"))


@query(f"SELECT id, CASE WHEN len(wanted) > 0 THEN round(len(list_intersect(wanted, have)) * CAST(100.0 AS DOUBLE) / len(wanted), 4) ELSE CAST(0 AS DOUBLE) END AS score FROM ({SCORED})")
def match_coverage(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).select("id", matching.coverage(F.col("have"), F.col("wanted")).alias("score"))


@query(f"SELECT resume_id, job_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT resume_id, job_id, id, {JACCARD} AS score, row_number() OVER (PARTITION BY resume_id ORDER BY {JACCARD} DESC, id) AS rank FROM ({SCORED})) WHERE rank <= 3")
def match_topn(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).select("resume_id", "job_id", "id", matching.jaccard(F.col("wanted"), F.col("have")).alias("score"))
    return matching.top_n(rows, "resume_id", "score", "id", 3)


@query(f"SELECT id, score FROM (SELECT id, {JACCARD} AS score FROM ({SCORED})) WHERE score >= 30")
def match_above(s: SparkSession, d: str) -> DataFrame:
    return match_jaccard(s, d).filter("score >= 30")


@query(f"SELECT count(*) AS n, CAST(round(avg(score), 2) AS DOUBLE) AS mean_score, count(*) FILTER (WHERE score = 0) AS without FROM (SELECT id, {JACCARD} AS score FROM ({SCORED}))")
def match_stats(s: SparkSession, d: str) -> DataFrame:
    return match_jaccard(s, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 2).alias("mean_score"), F.count_if(F.col("score") == 0).alias("without"))


@query("SELECT internal_id, CAST(len(list_filter(string_split(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in matching.STOPWORDS) + "))) AS INT) AS n_tokens FROM jobs")
def tokens(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select("internal_id", F.size(matching.tokens(F.col("name"))).alias("n_tokens"))


BRIDGE = f"(SELECT internal_id, unnest({skills_sql('description')}) AS skill FROM jobs)"
DICTIONARY = "(SELECT unnest([" + ", ".join(f"'{k}'" for k in matching.SKILLS) + "]) AS skill)"


@query(f"SELECT k.skill, count(b.skill) AS n FROM {DICTIONARY} k LEFT JOIN {BRIDGE} b ON b.skill = k.skill GROUP BY 1")
def skill_usage(s: SparkSession, d: str) -> DataFrame:
    names = s.createDataFrame([(k,) for k in matching.SKILLS], "skill string")
    return matching.skill_usage(matching.job_skills(jobs(s, d)), names)


@query(f"SELECT DISTINCT internal_id, CASE WHEN skill = 'kotlin' THEN 'java' ELSE skill END AS skill FROM {BRIDGE}")
def skill_merge(s: SparkSession, d: str) -> DataFrame:
    return matching.merge_skill(matching.job_skills(jobs(s, d)), "kotlin", "java")


FREE = "(SELECT DISTINCT lower(trim(job_class, ' ')) AS name FROM jobs WHERE trim(job_class, ' ') <> '')"
HAVE = "(SELECT lower(trim(name, ' ')) AS name, CAST(min(id) AS BIGINT) AS id FROM job_class GROUP BY 1)"


@query(f"SELECT f.name, coalesce(h.id, (SELECT max(id) FROM job_class) + n.r) AS id FROM {FREE} f LEFT JOIN {HAVE} h ON h.name = f.name LEFT JOIN (SELECT name, row_number() OVER (ORDER BY name) AS r FROM {FREE} x WHERE NOT EXISTS (SELECT 1 FROM {HAVE} y WHERE y.name = x.name)) n ON n.name = f.name")
def find_or_create_names(s: SparkSession, d: str) -> DataFrame:
    free = jobs(s, d).select(F.col("job_class").alias("name"))
    return matching.find_or_create(free, table(s, d, "job_class"))[0]


SOME = "(SELECT max(internal_id) * 98 // 100 FROM jobs)"


@query(f"WITH j AS (SELECT internal_id, {skills_sql('description')} AS wanted FROM jobs WHERE internal_id > {SOME}), r AS (SELECT doc_id, {skills_sql('text')} AS have FROM documents WHERE doc_type = 'resume'), p AS (SELECT internal_id, doc_id, wanted, have FROM j, r WHERE len(list_intersect(wanted, have)) > 0), x AS (SELECT internal_id, doc_id AS resume_id, {JACCARD} AS score FROM p) SELECT internal_id, resume_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY internal_id ORDER BY score DESC, resume_id) AS rank FROM x) WHERE rank <= 3")
def incremental_match(s: SparkSession, d: str) -> DataFrame:
    since = F.lit(jobs(s, d).agg(F.max("internal_id")).first()[0] * 98 // 100)
    new = jobs(s, d).select("internal_id", matching.found_skills(F.col("description")).alias("wanted"))
    resumes = table(s, d, "documents").filter("doc_type = 'resume'").select(F.col("doc_id").alias("resume_id"), matching.found_skills(F.col("text")).alias("have"))
    return matching.incremental_matches(new, resumes, since)


@query(
    "WITH d AS (SELECT DISTINCT TITLE_TOKENS AS tokens FROM jobs), n AS (SELECT count(*) AS n FROM d WHERE len(tokens) > 0), t AS (SELECT array_to_string(tokens, ' ') AS k, unnest(tokens) AS token FROM d), tf AS (SELECT k, token, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), "
    "w AS (SELECT k, tf.token, tf * ln((n.n + 1) / CAST(df AS DOUBLE)) AS w FROM tf JOIN df USING (token), n), l AS (SELECT k, sqrt(sum(w * w)) AS len FROM w GROUP BY 1), u AS (SELECT k, token, w / len AS w FROM w JOIN l USING (k)) "
    "SELECT a.k AS a, b.k AS b, round(sum(a.w * b.w), 6) AS score FROM u a JOIN u b ON a.token = b.token AND a.k < b.k GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 6) >= 0.85".replace("TITLE_TOKENS", "list_filter(string_split(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in matching.STOPWORDS) + "))")
)
def near_titles(s: SparkSession, d: str) -> DataFrame:
    titles = jobs(s, d).select(matching.tokens(F.col("name")).alias("tokens")).distinct().filter(F.size("tokens") > 0)
    return matching.tfidf_pairs(titles.select(F.array_join("tokens", " ").alias("title"), "tokens"), "title")


WITH_ID = "(SELECT id, source, coalesce(external_id, nullif(regexp_extract(raw_data, '\"id\"\\s*:\\s*\"((?:[^\"\\\\]|\\\\.)*)\"', 1), '')) AS external_id FROM jobs_raw)"


@query(f"SELECT external_id, source, min(id) AS id FROM {WITH_ID} r WHERE external_id IS NOT NULL AND source IS NOT NULL AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.id = r.external_id AND j.source = r.source) GROUP BY 1, 2")
def dedup_insert(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "jobs_raw").select(ingest.external_id(F.col("external_id"), F.col("raw_data")).alias("external_id"), "source", "id").filter("external_id IS NOT NULL AND source IS NOT NULL")
    stored = jobs(s, d).select(F.col("id").alias("external_id"), "source")
    return ingest.insert_ignore(stored, raw, ["source", "external_id"], "id").select("external_id", "source", "id")


@query("SELECT name, company_name, min(internal_id) AS internal_id, count(*) AS n FROM jobs GROUP BY 1, 2")
def dedup_title_company(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).groupBy("name", "company_name").agg(F.min("internal_id").alias("internal_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT external_id, source, max(batch_no) AS last_seen FROM jobs_raw WHERE external_id IS NOT NULL GROUP BY 1, 2 HAVING max(batch_no) < (SELECT max(batch_no) FROM jobs_raw)")
def expire_jobs(s: SparkSession, d: str) -> DataFrame:
    return ingest.expired(table(s, d, "jobs_raw").filter("external_id IS NOT NULL"), ["external_id", "source"], "batch_no")


@query("SELECT id FROM jobs_raw WHERE crawled_at < TIMESTAMP '2025-12-12 00:00:00' - INTERVAL 6 DAY")
def expire_by_age(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "jobs_raw").select("id", F.col("crawled_at").cast("timestamp_ntz").alias("crawled_at"))
    return ingest.older_than(raw, "crawled_at", F.to_timestamp_ntz(F.lit("2025-12-12 00:00:00")), 6).select("id")


@query("SELECT id FROM jobs_raw WHERE crawled_at >= TIMESTAMP '2025-12-05 00:00:00'")
def retention(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "jobs_raw").filter(F.col("crawled_at") >= F.lit("2025-12-05 00:00:00").cast("timestamp_ntz")).select("id")


CLEANED = "trim(regexp_replace(regexp_replace(coalesce(j->>'$.{0}', ''), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("WITH x AS (SELECT id AS raw_id, coalesce(external_id, TRY_CAST(raw_data AS JSON)->>'$.id') AS id, source, processed_at, TRY_CAST(raw_data AS JSON) AS j FROM jobs_raw) SELECT raw_id, id, source, " + ", ".join(f"{CLEANED.format(p)} AS {c}" for p, c in (("name", "name"), ("location", "location"), ("salary", "salary_description"), ("description", "description"))) + ", j IS NOT NULL AS processed FROM x WHERE processed_at IS NULL")
def raw_to_clean(s: SparkSession, d: str) -> DataFrame:
    return crawl.raw_to_clean(table(s, d, "jobs_raw"))


COUNTS = {"jobs": "jobs", "raw": "jobs_raw", "applications": "applications"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS what, count(*) AS n FROM {t}" for k, t in COUNTS.items()) + " UNION ALL SELECT 'pending', count(*) FROM jobs_raw WHERE processed_at IS NULL UNION ALL SELECT 'resumes', count(*) FROM documents WHERE doc_type = 'resume'")
def dashboard_counts(s: SparkSession, d: str) -> DataFrame:
    parts = [table(s, d, t).agg(F.lit(k).alias("what"), F.count(F.lit(1)).alias("n")) for k, t in COUNTS.items()]
    parts.append(table(s, d, "jobs_raw").filter("processed_at IS NULL").agg(F.lit("pending").alias("what"), F.count(F.lit(1)).alias("n")))
    parts.append(table(s, d, "documents").filter("doc_type = 'resume'").agg(F.lit("resumes").alias("what"), F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, parts)


@query("SELECT job_id, count(*) AS applicants, count(DISTINCT user_id) AS users FROM applications GROUP BY 1")
def applicants_per_job(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "applications").groupBy("job_id").agg(F.count(F.lit(1)).alias("applicants"), F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, job_id, min(id) AS id FROM applications GROUP BY 1, 2")
def unique_applications(s: SparkSession, d: str) -> DataFrame:
    return matching.first_applications(table(s, d, "applications"))


@query("SELECT j.internal_id FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM applications a WHERE a.job_id = j.internal_id)")
def jobs_without_applicants(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select("internal_id").join(table(s, d, "applications").select(F.col("job_id").alias("internal_id")), "internal_id", "left_anti")


@query(f"SELECT internal_id, row_number() OVER (ORDER BY date_posted DESC NULLS LAST, internal_id DESC) AS rank FROM jobs WHERE (name ILIKE '%e%' OR description ILIKE '%e%') AND location ILIKE '%hong kong%' AND work_type IN ('Full time', 'Full-time', 'full time') AND date_posted >= '2025' AND list_has_any({skills_sql('description')}, ['sql', 'stock control', 'java']) ORDER BY rank LIMIT 50")
def multi_facet_search(s: SparkSession, d: str) -> DataFrame:
    order = [F.desc_nulls_last("date_posted"), F.desc("internal_id")]
    rows = search.facet_search(jobs(s, d), text="e", location="hong kong", work_types=["Full time", "Full-time", "full time"], posted_since="2025", skills=["sql", "stock control", "java"])
    return ranked(rows.select("internal_id", "date_posted").orderBy(*order).limit(50), *order).select("internal_id", "rank")


@query("SELECT id, date_posted, internal_id, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (date_posted IS NOT NULL) DESC, date_posted DESC, internal_id DESC) AS r FROM jobs) WHERE r = 1")
def bulk_import_latest(s: SparkSession, d: str) -> DataFrame:
    rows = jobs(s, d).select("id", "date_posted", "internal_id", "name")
    return ingest.latest_import(rows, "id", "date_posted", "internal_id")


# --- crawl runs, export shapes and remaining request pieces -------------------------------------------


@query("SELECT internal_id AS \"internalId\", company_name AS \"companyName\", date_posted AS \"datePosted\", job_class AS \"jobClass\" FROM jobs")
def camel_case_rows(s: SparkSession, d: str) -> DataFrame:
    return api.camel_case(jobs(s, d).select("internal_id", "company_name", "date_posted", "job_class"))


@query("SELECT internal_id FROM jobs WHERE id <> '' AND name <> '' AND company_name <> ''")
def essential_fields(s: SparkSession, d: str) -> DataFrame:
    return crawl.essential(jobs(s, d)).select("internal_id")


@query("SELECT internal_id, id FROM jobs WHERE internal_id BETWEEN 50 AND 150")
def id_range(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).filter(F.col("internal_id").between(50, 150)).select("internal_id", "id")


@query("SELECT id, crawled_at FROM jobs_raw WHERE crawled_at >= TIMESTAMP '2025-12-12 00:00:00' - INTERVAL 72 HOUR ORDER BY crawled_at DESC, id DESC LIMIT 20")
def hours_old(s: SparkSession, d: str) -> DataFrame:
    until = F.to_timestamp_ntz(F.lit("2025-12-12 00:00:00"))
    return crawl.recent(table(s, d, "jobs_raw").select("id", F.col("crawled_at").cast("timestamp_ntz").alias("crawled_at")), "crawled_at", until, 72, 20)


@query("SELECT internal_id, CASE lower(trim(job_class, ' ')) WHEN 'finance' THEN 'accounting-finance' ELSE 'information-communication-technology' END AS category_path, CASE work_type WHEN 'full_time' THEN 'full-time' WHEN 'contract' THEN 'contract-temp' END AS job_type_path, CASE lower(trim(source, ' ')) WHEN 'relevance' THEN 'KeywordRelevance' ELSE 'ListedDate' END AS sortmode FROM jobs")
def search_parameter(s: SparkSession, d: str) -> DataFrame:
    kind = F.replace(F.lower("work_type"), F.lit(" "), F.lit("_"))
    return jobs(s, d).select("internal_id", *crawl.search_filters(F.col("job_class"), F.col("source"), F.when(F.col("work_type").isin("full_time", "contract"), kind)))


@query(f"SELECT internal_id % 8 AS worker, id FROM jobs WHERE NOT coalesce({OK_SQL}, false)")
def failed_ids(s: SparkSession, d: str) -> DataFrame:
    return crawl.failed_ids(jobs(s, d).withColumn("worker", F.col("internal_id") % 8))


@query("SELECT job_class, max(p) - min(p) + 1 AS pages_scraped FROM (SELECT name AS job_class, p FROM job_class, range(3, 8) t(p)) GROUP BY 1")
def pages_scraped(s: SparkSession, d: str) -> DataFrame:
    units = worklist.crawl_units(table(s, d, "job_class"), 3, 7)
    return units.groupBy("job_class").agg((F.max("page") - F.min("page") + 1).alias("pages_scraped"))


@query("SELECT count(*) AS listed, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.id = r.external_id)) AS new FROM jobs_raw r")
def found_and_new(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "jobs_raw").select("external_id")
    stored = jobs(s, d).select(F.col("id").alias("external_id"))
    fresh = ingest.unseen(raw, stored, "external_id").agg(F.count(F.lit(1)).alias("new"))
    return raw.agg(F.count(F.lit(1)).alias("listed")).select("listed", fresh.scalar().alias("new"))


@query("SELECT internal_id, id, row_number() OVER (ORDER BY internal_id DESC) AS rank FROM (SELECT internal_id, id FROM jobs WHERE description <> 'N/A' ORDER BY internal_id DESC LIMIT 60)")
def union_of_pages(s: SparkSession, d: str) -> DataFrame:
    rows = search.listing(jobs(s, d)).select("internal_id", "id")
    return ranked(search.pages(rows, 3, 20), F.desc("internal_id"))


@query("SELECT internal_id, r AS rank FROM (SELECT internal_id, row_number() OVER (ORDER BY internal_id DESC) AS r, count(*) OVER () AS n FROM jobs) WHERE r % 50 = 0 OR r = 1 OR r = n")
def progress_marks(s: SparkSession, d: str) -> DataFrame:
    ids = jobs(s, d).select("internal_id")
    total = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    rank = F.col("rank")
    return worklist.global_rank(ids, "internal_id").filter((rank % 50 == 0) | (rank == 1) | (rank == total)).select("internal_id", "rank")


@query("SELECT id, company_name FROM (SELECT nullif(trim(coalesce(id, ''), ' '), '') AS id, coalesce(nullif(trim(regexp_replace(coalesce(company_name, ''), '\\s+', ' ', 'g')), ''), 'Unknown Company') AS company_name FROM jobs UNION ALL SELECT 'x' || internal_id, 'Unknown Company' FROM jobs) x WHERE id IS NOT NULL AND id NOT IN (SELECT external_id FROM jobs_raw WHERE external_id IS NOT NULL)")
def listing_crawl(s: SparkSession, d: str) -> DataFrame:
    stored = table(s, d, "jobs_raw").select(F.col("external_id").alias("id"))
    return crawl.listing_run(pages(s, d), stored).select("id", "company_name")


COVERAGE = "CASE WHEN len(wanted) > 0 THEN round(len(list_intersect(wanted, have)) * CAST(100.0 AS DOUBLE) / len(wanted), 4) ELSE CAST(0 AS DOUBLE) END"
EXPERIENCE = "CASE WHEN yw <= yh THEN CAST(100 AS DOUBLE) ELSE round(yh * CAST(100.0 AS DOUBLE) / yw, 4) END"
PLACE = "lower(trim(coalesce(location, ''), ' '))"
NEARBY = f"CASE WHEN {PLACE} NOT IN ('', 'n/a') AND contains(lower(coalesce(text, '')), {PLACE}) THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


@query(f"SELECT id, round({COVERAGE} * CAST(0.6 AS DOUBLE) + {EXPERIENCE} * CAST(0.25 AS DOUBLE) + {NEARBY} * CAST(0.15 AS DOUBLE), 2) AS score FROM ({SCORED})")
def match_composite(s: SparkSession, d: str) -> DataFrame:
    skill, experience = matching.coverage(F.col("have"), F.col("wanted")), matching.experience_score(F.col("years_had"), F.col("years_wanted"))
    return scored(s, d).select("id", F.round(matching.composite(skill, experience, matching.location_score(F.col("text"), F.col("location"))), 2).alias("score"))


@query(f"SELECT resume_id, max(score) AS best FROM (SELECT resume_id, {JACCARD} AS score FROM ({SCORED})) GROUP BY 1 HAVING max(score) < 30")
def low_match_resumes(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).select("resume_id", matching.jaccard(F.col("wanted"), F.col("have")).alias("score"))
    return rows.groupBy("resume_id").agg(F.max("score").alias("best")).filter("best < 30")


@query("SELECT DISTINCT a.user_id, k.job_id FROM (SELECT DISTINCT user_id, job_class FROM applications x JOIN jobs j ON j.internal_id = x.job_id WHERE status = 'offer' AND job_class IS NOT NULL) a JOIN (SELECT job_class, arg_max(internal_id, internal_id) AS job_id FROM jobs WHERE job_class IS NOT NULL GROUP BY 1) k ON k.job_class = a.job_class WHERE NOT EXISTS (SELECT 1 FROM applications b WHERE b.user_id = a.user_id AND b.job_id = k.job_id)")
def recommended_not_applied(s: SparkSession, d: str) -> DataFrame:
    applied = table(s, d, "applications").select("user_id", "job_id", "status")
    classes = jobs(s, d).select(F.col("internal_id").alias("job_id"), "job_class").filter("job_class IS NOT NULL")
    liked = applied.filter("status = 'offer'").join(classes, "job_id").select("user_id", "job_class").distinct()
    newest = classes.groupBy("job_class").agg(F.max("job_id").alias("job_id"))
    return liked.join(newest, "job_class").select("user_id", "job_id").distinct().join(applied.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti")


TOKENS_SQL = "list_filter(string_split(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in matching.STOPWORDS) + "))"


@query(
    f"WITH t AS (SELECT internal_id, unnest({TOKENS_SQL}) AS token FROM jobs), n AS (SELECT count(*) AS n FROM jobs), df AS (SELECT token, count(DISTINCT internal_id) AS df FROM t GROUP BY 1), "
    "w AS (SELECT internal_id, t.token, count(*) * ln((1 + n.n) / CAST(1 + df.df AS DOUBLE)) AS w FROM t JOIN df USING (token), n GROUP BY internal_id, t.token, n.n, df.df), "
    "l AS (SELECT internal_id, sqrt(sum(w * w)) AS len FROM w GROUP BY 1), q AS (SELECT token, ln((1 + n.n) / CAST(1 + df AS DOUBLE)) AS w FROM df, n WHERE token IN ('clerk', 'officer')) "
    "SELECT internal_id, round(sum(w.w * q.w) / (max(l.len) * (SELECT sqrt(sum(w * w)) FROM q)), 6) AS score FROM w JOIN q USING (token) JOIN l USING (internal_id) WHERE l.len > 0 GROUP BY 1"
)
def tfidf_match(s: SparkSession, d: str) -> DataFrame:
    return matching.tfidf_scores(jobs(s, d).select("internal_id", matching.tokens(F.col("name")).alias("tokens")), "internal_id", ["clerk", "officer"])


@query("SELECT 'ok' AS status, true AS connected")
def health_probe(s: SparkSession, d: str) -> DataFrame:
    return api.health(s).select("status", "connected")


@query("SELECT internal_id, concat_ws(' | ', CASE WHEN location <> '' THEN 'Location: ' || location END, CASE WHEN work_type <> '' THEN 'Type: ' || work_type END, CASE WHEN salary_description <> '' THEN 'Pay: ' || salary_description END) AS lines FROM jobs")
def card_lines(s: SparkSession, d: str) -> DataFrame:
    shown = [F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for c, label in (("location", "Location"), ("work_type", "Type"), ("salary_description", "Pay"))]
    return jobs(s, d).select("internal_id", F.concat_ws(" | ", *shown).alias("lines"))


@query("SELECT id, name FROM jobs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY internal_id) = 1")
def first_by_external_id(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).filter("id IS NOT NULL").groupBy("id").agg(F.min_by("name", "internal_id").alias("name"))
