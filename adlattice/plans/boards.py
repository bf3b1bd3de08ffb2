"""Registered queries of the boards' pages, crawl runs, addresses and records, each beside its SQL.

Pages are put together from the stored postings, so that the SQL can state what must be read back from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlattice.functions import dates, html, urls
from adlattice.operators import api, boards, crawl, quantities, runs, worklist
from adlattice.plans.reference import NOW, OK_SQL, jobs, now, query
from adlattice.sources.tables import feed_columns, health, table

TODAY = "2025-12-01"
CLEAN = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
# names without angle brackets, as a page would hold them escaped
SAFE = "replace(replace({0}, '<', '('), '>', ')')"


def safe(c: str) -> Column:
    return F.replace(F.replace(F.col(c), F.lit("<"), F.lit("(")), F.lit(">"), F.lit(")"))


def wrapped(before: str, c: Column, after: str) -> Column:
    """An element around a value; none where the value is missing."""
    return F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))


# --- the boards -------------------------------------------------------------------------------------------


@query(
    f"SELECT id, CASE WHEN name IS NULL THEN 'Unknown Title' ELSE {CLEAN.format(SAFE.format('name'))} END AS name, CASE WHEN company_name IS NULL THEN 'Unknown Company' ELSE {CLEAN.format(SAFE.format('company_name'))} END AS company_name, 'Unknown Location' AS location, 'Indeed' AS source "
    "FROM (SELECT *, nullif(trim(coalesce(id, ''), ' '), '') AS key FROM jobs) WHERE key IS NOT NULL AND key NOT IN (SELECT external_id FROM jobs_raw WHERE external_id IS NOT NULL)"
)
def result_cards(s: SparkSession, d: str) -> DataFrame:
    title = wrapped('<h2 class="jobTitle css-1"><span>', safe("name"), "</span></h2>")
    company = wrapped('<span class="companyName">', safe("company_name"), "</span>")
    card = F.concat(F.lit('<div class="jobsearch-ResultsList"><div class="card result"><a data-jk="'), F.coalesce("id", F.lit("")), F.lit('"></a>'), title, company, F.lit("</div></div>"))
    stored = table(s, d, "jobs_raw").select(F.col("external_id").alias("id"))
    return boards.Indeed().search_jobs(jobs(s, d).select(card.alias("html")), stored, TODAY).select("id", "name", "company_name", "location", "source")


@query(
    f"SELECT internal_id, CASE WHEN name IS NULL THEN 'Unknown Title' ELSE {CLEAN.format(SAFE.format('name'))} END AS name, CASE WHEN company_name IS NULL THEN 'Unknown Company' ELSE {CLEAN.format(SAFE.format('company_name'))} END AS company_name, CASE WHEN location IS NULL THEN 'Unknown Location' ELSE {CLEAN.format(SAFE.format('location'))} END AS location, coalesce({SAFE.format('remark')}, '') AS description FROM jobs"
)
def result_details(s: SparkSession, d: str) -> DataFrame:
    place = wrapped('<div class="jobsearch-JobInfoHeader-subtitle x"><div class="jobsearch-JobInfoHeader-locationText">', safe("location"), "</div></div>")
    page = F.concat(wrapped('<h1 class="jobsearch-JobInfoHeader-title">', safe("name"), "</h1>"), wrapped('<a class="jobsearch-InlineCompanyName">', safe("company_name"), "</a>"), place, wrapped('<div id="jobDescriptionText"><b>', safe("remark"), "</b></div>"))
    return boards.Indeed().get_job_details(jobs(s, d).select("internal_id", page.alias("html")))


@query(
    f"SELECT internal_id, CASE WHEN name IS NULL THEN 'N/A' ELSE {STRIP.format(SAFE.format('name'))} END AS name, CASE WHEN company_name IS NULL THEN 'N/A' ELSE {STRIP.format(SAFE.format('company_name'))} END AS company_name, "
    f"CASE WHEN name IS NULL AND location IS NULL THEN 'N/A' ELSE array_to_string(list_filter([{STRIP.format(SAFE.format('name'))}, {STRIP.format(SAFE.format('location'))}], lambda x: x <> ''), chr(10)) END AS description FROM jobs"
)
def card_details(s: SparkSession, d: str) -> DataFrame:
    """Each of the known page layouts, by the kind of work of the posting."""
    kind = F.col("work_type")
    title = wrapped("", F.concat(F.when(kind.isNull(), '<h1 class="t-24 t-bold inline">').when(kind == "Full time", '<h1 class="top-card-layout__title font">').otherwise('<h1 class="x topcard__title">'), safe("name"), F.lit("</h1>")), "")
    company = wrapped("", F.concat(F.when(kind.isNull(), '<a href="#" data-tracking-control-name="public_jobs_topcard-org-name">').when(kind == "Full time", '<span class="topcard__flavor"><i></i><a href="#">').otherwise('<a class="topcard__org-name-link">'), safe("company_name"), F.lit("</a></span>")), "")
    paragraphs = F.concat(wrapped("<p>", safe("name"), "</p>"), wrapped("\n <p> ", safe("location"), " </p>"))
    text = F.when(F.col("name").isNull() & F.col("location").isNull(), "").otherwise(F.concat(F.when(kind.isNull(), '<div class="jobs-box__html-content">').otherwise('<div class="jobs-description__content x">'), paragraphs, F.lit("</div>")))
    return boards.LinkedIn().get_job_details(jobs(s, d).select("internal_id", F.concat(title, company, text).alias("html")))


@query(
    f"SELECT internal_id, coalesce(nullif({CLEAN.format(SAFE.format('remark'))}, ''), 'N/A') AS description, CASE WHEN {CLEAN.format(SAFE.format('job_class'))} = '' THEN 'N/A' WHEN regexp_matches({CLEAN.format(SAFE.format('job_class'))}, '\\(.*?\\)') THEN regexp_extract({CLEAN.format(SAFE.format('job_class'))}, '\\((.*?)\\)', 1) ELSE {CLEAN.format(SAFE.format('job_class'))} END AS job_class FROM jobs"
)
def text_and_class_details(s: SparkSession, d: str) -> DataFrame:
    page = F.concat(wrapped('<div data-automation="jobAdDetails"><p>', safe("remark"), "</p></div>"), wrapped('<span data-automation="job-detail-classifications">', safe("job_class"), "</span>"))
    return boards.JobsDb().get_job_details(jobs(s, d).select("internal_id", page.alias("html")))


@query(
    f"SELECT id, name, company_name, location, date_posted FROM (SELECT nullif(trim(coalesce(id, ''), ' '), '') AS id, CASE WHEN name IS NULL THEN 'Unknown Title' ELSE {CLEAN.format(SAFE.format('name'))} END AS name, coalesce(nullif({CLEAN.format(SAFE.format('company_name'))}, ''), 'Unknown Company') AS company_name, "
    f"coalesce(nullif({CLEAN.format(SAFE.format('location'))}, ''), 'Unknown Location') AS location, coalesce(nullif({CLEAN.format(SAFE.format('date_posted'))}, ''), 'N/A') AS date_posted FROM jobs) WHERE id <> '' AND name <> ''"
)
def legacy_cards(s: SparkSession, d: str) -> DataFrame:
    """Pages of either layout: ``article`` cards where the posting has a class, else the older ``div`` cards."""
    inner = F.concat(wrapped("<h3>", safe("name"), "</h3>"), wrapped('<span data-automation="jobCompany">', safe("company_name"), "</span>"), wrapped('<span data-automation="jobLocation">', safe("location"), "</span>"), wrapped('<span data-automation="jobListingDate">', safe("date_posted"), "</span>"))
    key = F.coalesce("id", F.lit(""))
    page = F.when(F.col("job_class").isNotNull(), F.concat(F.lit('<article data-job-id="'), key, F.lit('">'), inner, F.lit("</article>"))).otherwise(F.concat(F.lit('<div data-jobid="job_'), key, F.lit('">'), inner, F.lit("</div>")))
    return boards.legacy_listing(jobs(s, d).select(page.alias("html"))).select("id", "name", "company_name", "location", "date_posted")


AGO = "CASE " + " ".join(f"WHEN contains(x, '{m}') THEN TIMESTAMP '{NOW}' - {f}(TRY_CAST(trim(split_part(x, '{m}', 1)) AS INT))" for m, f in (("d ago", "to_days"), ("h ago", "to_hours"), ("m ago", "to_minutes"))) + f" ELSE TIMESTAMP '{NOW}' END"


@query(f"SELECT id, strftime(p, '%Y-%m-%d %H:%M:%S') AS posted FROM (SELECT id, {AGO} AS p FROM (SELECT nullif(trim(coalesce(id, ''), ' '), '') AS id, {CLEAN.format(SAFE.format('date_posted'))} AS x FROM jobs) WHERE id IS NOT NULL AND x <> '' AND x <> 'N/A') WHERE p IS NOT NULL")
def dated_cards(s: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit('<article data-job-id="'), F.coalesce("id", F.lit("")), F.lit('">'), wrapped('<span data-automation="jobListingDate">', safe("date_posted"), "</span>"), F.lit("</article>"))
    return crawl.dated_cards(jobs(s, d).select(page.alias("html")), now()).select("id", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted"))


@query("SELECT id, name, lower(name) IN ('jobsdb', 'linkedin', 'indeed') AS supported FROM source_platform")
def supported_boards(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "source_platform").select("id", "name", worklist.method_name(F.col("name")).isin(sorted(boards.BOARDS)).alias("supported"))


# --- runs -------------------------------------------------------------------------------------------------

QUANTITY, WORKERS = 500, 5
WORK = f"w AS (SELECT internal_id, id, row_number() OVER (ORDER BY internal_id DESC) AS r, count(*) OVER () AS n FROM (SELECT internal_id, id FROM jobs WHERE (description IS NULL OR description IN ('', 'N/A')) AND lower(source) = 'jobsdb' ORDER BY internal_id DESC LIMIT {QUANTITY})), "
WORK += "p AS (SELECT external_id AS id, max(TRY_CAST(raw_data AS JSON)->>'$.name') AS text FROM jobs_raw WHERE external_id IS NOT NULL GROUP BY 1), "
WORK += f"x AS (SELECT w.internal_id, CAST(floor((r - 1) / ceil(n / CAST(least({WORKERS}, n) AS DOUBLE))) AS BIGINT) + 1 AS worker, p.id IS NOT NULL AS page, coalesce(nullif({CLEAN.format(SAFE.format('p.text'))}, ''), 'N/A') AS text FROM w LEFT JOIN p ON p.id = w.id)"


def run_config(**more: object) -> worklist.RunConfig:
    return worklist.RunConfig.from_dict({"source_platform": "JobsDB", "quantity": QUANTITY, "workers": WORKERS, "save": True, "detail_filter": "N/A", **more})


def detail_pages(s: SparkSession, d: str) -> DataFrame:
    """One page for each number the crawl records have, with their title as text."""
    told = table(s, d, "jobs_raw").filter("external_id IS NOT NULL").groupBy(F.col("external_id").alias("id")).agg(F.max(feed_columns(F.col("raw_data"))["name"]).alias("text"))
    return told.select("id", F.concat(F.lit('<div data-automation="jobAdDetails">'), F.coalesce(safe("text"), F.lit("")), F.lit('</div><i data-automation="job-detail-classifications">Desk (Office)</i>')).alias("html"))


@query(f"WITH {WORK} SELECT j.internal_id, CASE WHEN x.internal_id IS NULL THEN j.description WHEN x.page AND x.text <> 'N/A' THEN x.text ELSE 'N/A' END AS description, CASE WHEN x.page AND x.text <> 'N/A' THEN 'Office' ELSE j.job_class END AS job_class FROM jobs j LEFT JOIN x USING (internal_id)")
def detail_run(s: SparkSession, d: str) -> DataFrame:
    return runs.detail_run(run_config(), jobs(s, d), detail_pages(s, d)).stored.select("internal_id", "description", "job_class")


@query(f"WITH {WORK} SELECT worker, count(*) FILTER (WHERE page AND text <> 'N/A') AS succeeded, count(*) FILTER (WHERE NOT (page AND text <> 'N/A')) AS failed FROM x GROUP BY 1")
def detail_run_workers(s: SparkSession, d: str) -> DataFrame:
    return runs.detail_run(run_config(), jobs(s, d), detail_pages(s, d)).counters


@query(f"WITH {WORK} SELECT true AS success, count(*) AS jobs_processed, count(*) FILTER (WHERE page AND text <> 'N/A') AS success_count, count(*) FILTER (WHERE NOT (page AND text <> 'N/A')) AS failure_count FROM x")
def detail_run_summary(s: SparkSession, d: str) -> DataFrame:
    return runs.create_run({"source_platform": "JobsDB", "quantity": QUANTITY, "workers": WORKERS, "detail_filter": "N/A"})(jobs(s, d), detail_pages(s, d)).summary


def read_page(key: str, page: str | None) -> dict[str, str] | None:
    """A board without expressions: the text between two marks of a page; a missing page is a failure."""
    if page is None:
        raise LookupError(key)
    text = " ".join(page.split(">", 1)[1].split("</div>", 1)[0].split())
    return {"description": text} if text else None


@query(f"WITH {WORK} SELECT j.internal_id, CASE WHEN x.internal_id IS NULL THEN j.description WHEN NOT x.page THEN 'Error: LookupError' ELSE x.text END AS description FROM jobs j LEFT JOIN x USING (internal_id)")
def worker_run(s: SparkSession, d: str) -> DataFrame:
    return runs.worker_run(run_config(), jobs(s, d), detail_pages(s, d), read_page).stored.select("internal_id", "description")


LISTED = f"l AS (SELECT batch_no AS page, nullif(trim(coalesce(external_id, ''), ' '), '') AS id FROM jobs_raw WHERE batch_no BETWEEN 2 AND 9), f AS (SELECT * FROM l WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM jobs WHERE id IS NOT NULL))"


def listing_pages(s: SparkSession, d: str) -> DataFrame:
    card = F.concat(F.lit('<article data-job-id="'), F.coalesce("external_id", F.lit("")), F.lit('"></article>'))
    return table(s, d, "jobs_raw").select(F.col("batch_no").alias("page"), card.alias("html"))


def page_run(s: SparkSession, d: str) -> runs.RunResult:
    config = worklist.RunConfig.from_dict({"source_platform": "jobsdb", "start_page": 2, "end_page": 9, "save": True})
    return runs.listing_run(config, jobs(s, d).select("internal_id", "id", "name", "source"), listing_pages(s, d), TODAY)


@query(f"WITH {LISTED} SELECT page, jobs_found, CAST(sum(jobs_found) OVER (ORDER BY page) AS BIGINT) AS total_jobs FROM (SELECT page, count(*) AS jobs_found FROM f GROUP BY 1)")
def listing_run_pages(s: SparkSession, d: str) -> DataFrame:
    return page_run(s, d).counters


@query(f"WITH {LISTED} SELECT true AS success, count(*) AS jobs_scraped, CAST(8 AS INT) AS pages_scraped, true AS save FROM f")
def listing_run_summary(s: SparkSession, d: str) -> DataFrame:
    return page_run(s, d).summary


@query(f"WITH {LISTED} SELECT internal_id, id, name, source FROM jobs UNION ALL SELECT NULL, id, 'Unknown Title', 'JobsDB' FROM f")
def listing_run_stored(s: SparkSession, d: str) -> DataFrame:
    return page_run(s, d).stored.select("internal_id", "id", "name", "source")


@query("SELECT false AS success, 'Unsupported platform: ' || 'Glassdoor' AS message")
def unsupported_run(s: SparkSession, d: str) -> DataFrame:
    return runs.create_run({"source_platform": "Glassdoor", "quantity": 3})(jobs(s, d), detail_pages(s, d)).summary


# --- texts, dates, addresses and records ------------------------------------------------------------------

MIXED = "'<b>' || " + SAFE.format("coalesce(name, '')") + " || '</b> ' || " + SAFE.format("coalesce(location, '')") + " || ' <br>  ' || " + SAFE.format("coalesce(company_name, '')")
PIECES = f"list_filter(list_transform(string_split_regex({MIXED}, '<[^>]*>'), lambda x: {STRIP.format('x')}), lambda x: x <> '')"


@query(f"SELECT internal_id, regexp_replace({MIXED}, '<[^>]*>', '', 'g') AS raw, array_to_string({PIECES}, '') AS strip, array_to_string({PIECES}, chr(10)) AS lines, array_to_string({PIECES}, '\\n') AS legacy FROM jobs")
def element_texts(s: SparkSession, d: str) -> DataFrame:
    told = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("<"), F.lit("(")), F.lit(">"), F.lit(")"))
    inner = F.concat(F.lit("<b>"), told("name"), F.lit("</b> "), told("location"), F.lit(" <br>  "), told("company_name"))
    return jobs(s, d).select("internal_id", *[html.element_text(inner, k).alias(k) for k in html.SEPARATORS])


ISO = r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?)?$"


@query(
    "WITH x AS (SELECT internal_id, date_scraped AS a, date_posted AS c, TRY_CAST(regexp_extract(date_posted, '(\\d+)', 1) AS INT) AS n FROM jobs) SELECT internal_id, coalesce(CASE WHEN regexp_matches(a, '^\\d{4}-\\d\\d-\\d\\d') THEN TRY_CAST(substr(a, 1, 10) AS DATE) END, CAST(coalesce(CASE "
    + " ".join(f"WHEN regexp_matches(c, '\\d+ {u}.* ago') THEN TIMESTAMP '{NOW}' - {f}" for u, f in (("day", "to_days(n)"), ("hour", "to_hours(n)"), ("week", "to_days(n * 7)"), ("month", "to_days(n * 30)")))
    + f" ELSE try_strptime(c, '%b %d, %Y') END, TIMESTAMP '{NOW}') AS DATE)) AS posted FROM x"
)
def posting_dates(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select("internal_id", dates.posting_date(F.col("date_scraped"), F.col("date_posted"), now()).alias("posted"))


@query(
    f"WITH x AS (SELECT TRY_CAST(raw_data AS JSON) AS j, crawled_at FROM jobs_raw), y AS (SELECT j->>'$.id' AS id, coalesce(j->>'$.name', 'Unknown Title') AS name, coalesce(j->>'$.company.name', CASE WHEN json_type(j->'$.company') = 'VARCHAR' THEN j->>'$.company' END, 'Unknown Company') AS company_name, coalesce(j->>'$.location', 'Unknown Location') AS location, j->>'$.date_posted' AS t FROM x) "
    f"SELECT id, name, company_name, location, strftime(CASE WHEN t IS NOT NULL THEN coalesce(CASE WHEN regexp_matches(t, '{ISO}') THEN TRY_CAST(CASE WHEN length(t) = 16 THEN t || ':00' ELSE t END AS TIMESTAMP) END, TIMESTAMP '{NOW}') END, '%Y-%m-%d %H:%M:%S') AS date_scraped FROM y WHERE id <> '' AND name <> ''"
)
def feed_postings(s: SparkSession, d: str) -> DataFrame:
    f = feed_columns(F.col("raw_data"))
    feed = table(s, d, "jobs_raw").select(*[f[n].alias(n) for n in ("id", "name", "company", "location", "salary", "job_class")], f["date_posted"].alias("date_scraped"))
    return crawl.feed_postings(feed, now()).select("id", "name", "company_name", "location", F.date_format("date_scraped", "yyyy-MM-dd HH:mm:ss").alias("date_scraped"))


def encoded_sql(c: str) -> str:
    out = f"url_encode({c})"
    for code, sign in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~")):
        out = f"replace({out}, '{code}', '{sign}')"
    return out


@query(
    f"SELECT internal_id, 'https://board.example/jobs?' || CASE WHEN name IS NULL THEN '' ELSE 'q=' || {encoded_sql('name')} || '&' END || CASE WHEN location IS NULL THEN '' ELSE 'l=' || {encoded_sql('location')} || '&' END || 'radius=25&sort=relevance&limit=25' AS by_terms, "
    "'https://board.example/jobs/search/?f_TPR=r172800&sortBy=DD&start=' || CAST((internal_id % 40) * 25 AS VARCHAR) AS recent, 'https://board.example/jobs-in-' || regexp_replace(lower(job_class), '[^a-z0-9]+', '-', 'g') || '?sortmode=ListedDate&page=' || CAST(internal_id % 40 + 1 AS VARCHAR) AS by_class, "
    "'https://board.example/job/' || id AS path_page, 'https://board.example/jobs/view/' || id || '/' AS view_page FROM jobs"
)
def addresses(s: SparkSession, d: str) -> DataFrame:
    base, page, c = "https://board.example/", F.col("internal_id") % 40 + 1, F.col
    return jobs(s, d).select(
        "internal_id", urls.term_listing("https://board.example", c("name"), c("location")).alias("by_terms"), urls.recent_listing(base, page).alias("recent"), urls.class_listing(base, c("job_class"), page, F.lit("ListedDate")).alias("by_class"),
        urls.detail_page(base, c("id")).alias("path_page"), urls.detail_page(base, c("id"), "view").alias("view_page"),
    )


@query("SELECT " + ", ".join(api.STORED) + " FROM jobs")
def stored_columns(s: SparkSession, d: str) -> DataFrame:
    return api.to_stored(jobs(s, d))


@query("SELECT internal_id, CAST(to_json({" + ", ".join(f"'{c}': {c}" for c in ("internal_id", *api.STORED)) + "}) AS VARCHAR) AS record FROM jobs")
def json_records(s: SparkSession, d: str) -> DataFrame:
    return api.to_record(jobs(s, d))


@query("SELECT coalesce(source, '') AS source, coalesce(name, '') AS name, coalesce(salary_description, '') AS salary_description, internal_id FROM jobs")
def reordered_filled(s: SparkSession, d: str) -> DataFrame:
    return api.reordered(jobs(s, d), ["source", "name", "salary_description", "internal_id"])


@query(f"SELECT internal_id, CASE WHEN {OK_SQL} THEN description WHEN starts_with(description, 'Error: ') THEN description ELSE 'Error: ' || CASE WHEN description IS NULL THEN 'Missing' ELSE 'Empty' END END AS description FROM jobs")
def error_tags(s: SparkSession, d: str) -> DataFrame:
    c = F.col("description")
    good = F.coalesce(worklist.valid_detail(c), F.lit(False))
    return jobs(s, d).select("internal_id", F.when(good, c).otherwise(runs.error_tag(F.when(c.isNull(), "Missing").otherwise("Empty"))).alias("description"))


@query("SELECT strftime(applied_at, '%Y-%m-%d') AS day, count(*) AS n FROM applications GROUP BY 1")
def iso_days(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "applications").groupBy(F.date_format(F.col("applied_at").cast("timestamp_ntz"), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'error' AS status, false AS connected, 'AnalysisException' AS message")
def health_error(s: SparkSession, d: str) -> DataFrame:
    return health(s, f"{d}/nowhere").select("status", "connected", "message")


@query("WITH r AS (SELECT k, max(place) AS place FROM (SELECT lower(name) AS k, name AS place FROM location_ref UNION ALL SELECT lower(city), name FROM location_ref) GROUP BY 1) SELECT internal_id, r.place, r.place IS NULL AS review FROM jobs LEFT JOIN r ON r.k = lower(trim(location, ' '))")
def place_review(s: SparkSession, d: str) -> DataFrame:
    return quantities.place_or_review(jobs(s, d).select("internal_id", "location"), table(s, d, "location_ref"))


@query()
def pay_review(s: SparkSession, d: str) -> DataFrame:
    """Yearly pay with a flag on notes that hold a number but state no pay; no SQL states the grammar of the notes."""
    return quantities.pay_or_review(jobs(s, d), table(s, d, "pay_period"))


@query()
def facet_search_pay(s: SparkSession, d: str) -> DataFrame:
    """Facets with a least yearly pay; the pay ranges come from the grammar of the notes, which SQL does not state."""
    from adlattice.operators import search

    pay = quantities.found(jobs(s, d), table(s, d, "pay_period"))
    return search.facet_search(jobs(s, d), location="hong kong", pay=pay, pay_from=300_000, currency="HKD").select("internal_id")
