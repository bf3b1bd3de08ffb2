"""The boards: how the listing and the detail pages of each are read, behind one contract."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlattice.functions import html
from adlattice.operators import crawl, ingest
from adlattice.operators.worklist import method_name_of


class Board(ABC):
    """What a board must offer: new postings from listing pages ``(html, ...)`` and details from pages ``(id, html)``."""

    name: str
    columns: tuple[str, ...] = ("description",)

    @abstractmethod
    def search_jobs(self, pages: DataFrame, stored: DataFrame, today: str) -> DataFrame:
        """Postings of the listing pages whose id is not stored."""

    @abstractmethod
    def get_job_details(self, pages: DataFrame) -> DataFrame:
        """``(id, description, ...)`` with the columns of ``columns``; 'N/A' where a page does not say."""


def _page_columns(pages: DataFrame) -> list[str]:
    return [c for c in pages.columns if c != "html"]


class JobsDb(Board):
    """Cards with job attributes; details bring the text and the class."""

    name, columns = "JobsDB", ("description", "job_class")

    def search_jobs(self, pages: DataFrame, stored: DataFrame, today: str) -> DataFrame:
        return crawl.listing_run(pages, stored).withColumns({"source": F.lit(self.name), "date_scraped": F.lit(today)})

    def get_job_details(self, pages: DataFrame) -> DataFrame:
        return crawl.detail_fields(pages)


class LinkedIn(Board):
    """Listings show ids alone; details bring title, company and text."""

    name, columns = "LinkedIn", ("description", "name", "company_name")

    # The elements that hold each field, the first one present counts.
    TITLE = (html.element("h1", "top-card-layout__title"), html.element("h1", "topcard__title"), html.element("h1", "t-24"))
    COMPANY = (html.element("a", inside="topcard__flavor"), html.element("a", "topcard__org-name-link"), html.element("a", attribute='data-tracking-control-name="public_jobs_topcard-org-name"'))
    TEXT = (html.element("div", "show-more-less-html__markup"), html.element("div", "jobs-description__content"), html.element("div", "jobs-box__html-content"))

    def search_jobs(self, pages: DataFrame, stored: DataFrame, today: str) -> DataFrame:
        return crawl.id_stubs(pages, stored, today, self.name)

    def get_job_details(self, pages: DataFrame) -> DataFrame:
        c = F.col("html")
        return pages.select(*_page_columns(pages), html.first_element(c, *self.TITLE).alias("name"), html.first_element(c, *self.COMPANY).alias("company_name"), html.first_element(c, *self.TEXT, separator="lines").alias("description"))


class Indeed(Board):
    """Result cards by class; details bring title, company, place and the raw text."""

    name, columns = "Indeed", ("description", "name", "company_name", "location")

    CARD = r'(?s)<(?:div|li|td)[^>]*\bclass="[^"]*(?<![\w-])result(?![\w-])[^"]*"[^>]*>.*?</(?:div|li|td)>'
    PLACE = r'(?s)jobsearch-JobInfoHeader-subtitle.*?class="[^"]*jobsearch-JobInfoHeader-locationText[^"]*"[^>]*>(.*?)</'

    def _cleaned(self, c: Column, default: str, *patterns: str) -> Column:
        return html.collapse(html.first_element(c, *patterns, default=default, separator="raw"))

    def cards(self, pages: DataFrame, limit: int = crawl.PAGE_SIZE) -> DataFrame:
        """The first cards of each page, before they are read."""
        found = pages.select(*_page_columns(pages), F.posexplode(F.regexp_extract_all("html", F.lit(self.CARD), F.lit(0))).alias("pos", "card"))
        return found.filter(F.col("pos") < limit)

    def search_jobs(self, pages: DataFrame, stored: DataFrame, today: str, limit: int = crawl.PAGE_SIZE) -> DataFrame:
        c = F.col("card")
        rows = self.cards(pages, limit).select(
            *_page_columns(pages),
            html.first_match(c, r'data-jk="([^"]*)"').alias("id"),
            self._cleaned(c, "Unknown Title", r'(?s)class="[^"]*(?<![\w-])jobTitle(?![\w-])[^"]*"[^>]*>.*?<span[^>]*>(.*?)</span>').alias("name"),
            self._cleaned(c, "Unknown Company", r'(?s)class="[^"]*(?<![\w-])companyName(?![\w-])[^"]*"[^>]*>(.*?)</').alias("company_name"),
            self._cleaned(c, "Unknown Location", r'(?s)class="[^"]*(?<![\w-])companyLocation(?![\w-])[^"]*"[^>]*>(.*?)</').alias("location"),
            F.lit("").alias("description"),
            F.lit(self.name).alias("source"),
            F.lit(today).alias("date_scraped"),
        )
        return ingest.unseen(rows.filter(F.col("id").isNotNull()), stored)

    def get_job_details(self, pages: DataFrame) -> DataFrame:
        c = F.col("html")
        return pages.select(
            *_page_columns(pages),
            self._cleaned(c, "Unknown Title", r'(?s)class="[^"]*jobsearch-JobInfoHeader-title[^"]*"[^>]*>(.*?)</').alias("name"),
            self._cleaned(c, "Unknown Company", r'(?s)class="[^"]*jobsearch-InlineCompanyName[^"]*"[^>]*>(.*?)</').alias("company_name"),
            self._cleaned(c, "Unknown Location", self.PLACE).alias("location"),
            html.first_element(c, r'(?s)id="jobDescriptionText"[^>]*>(.*?)</div>', default="", separator="raw").alias("description"),
        )


def legacy_listing(pages: DataFrame) -> DataFrame:
    """Cards of older pages with id, title and company; the posting date stays as it is written."""
    c = F.col("card")
    title = html.first_element(c, r'(?s)<h3[^>]*>\s*<a[^>]*data-automation="jobTitle"[^>]*>(.*?)</a>', r'(?s)<div[^>]*data-automation="jobTitle"[^>]*>\s*<a[^>]*>(.*?)</a>', r'(?s)<a[^>]*data-automation="jobTitle"[^>]*>(.*?)</a>', r"(?s)<h3[^>]*>(.*?)</h3>", default="Unknown Title", separator="raw")
    rows = html.legacy_cards(pages).select(
        *_page_columns(pages),
        html.legacy_card_id(c).alias("id"),
        html.collapse(title).alias("name"),
        html.field(c, "jobCompany", "Unknown Company").alias("company_name"),
        html.field(c, "jobLocation", "Unknown Location").alias("location"),
        html.field(c, "jobListingDate", "N/A").alias("date_posted"),
    )
    return crawl.essential(rows)


BOARDS: dict[str, Board] = {method_name_of(b.name): b for b in (JobsDb(), LinkedIn(), Indeed())}


def board(platform: str) -> Board | None:
    """The board of a platform by its name; None if it is not supported."""
    return BOARDS.get(method_name_of(platform))
