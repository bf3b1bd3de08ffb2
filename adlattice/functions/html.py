"""HTML fragments: cards, ids, first-match chains, text, formatter post-processing. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of the boards' pages (attributes, classes, notices) that must match them.
CARD = r"(?s)<article[^>]*data-job-id=[^>]*>.*?</article>"


def first_match(c: Column, *patterns: str, default: str | None = None) -> Column:
    """Group 1 of the first pattern that matches with text in it, else the default."""
    found = [F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.lit(default)) if default is not None else F.coalesce(*found)


def cards(pages: DataFrame, html: str = "html", limit: int | None = None) -> DataFrame:
    """One row per listing card with its position; ``limit`` keeps the first cards of each page, before parsing."""
    out = pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.regexp_extract_all(F.col(html), F.lit(CARD), F.lit(0))).alias("pos", "card"))
    return out.filter(F.col("pos") < limit) if limit is not None else out


def card_id(c: Column) -> Column:
    return first_match(c, r'data-job-id="([^"]*)"', r'"jobId":"?(\d+)"?')


def linked_card_id(c: Column) -> Column:
    return first_match(c, r'data-occludable-job-id="[^"\d]*(\d+)', r"/jobs/view/(\d+)/", r'jobId[=":]+(\d+)')


def legacy_card_id(c: Column) -> Column:
    prefixed = first_match(c, r'data-jobid="([^"]*)"', r'\bid="(job_[^"]*)"')
    return F.coalesce(first_match(c, r'data-job-id="([^"]*)"'), F.nullif(F.regexp_replace(prefixed, "^job_", ""), F.lit("")), first_match(c, r'"jobId":"?(\d+)"?'))


LEGACY_CARD = r"(?s)<div[^>]*data-jobid=[^>]*>.*?</div>"
SEPARATORS = {"raw": None, "strip": "", "lines": "\n", "legacy": "\\n"}


def legacy_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """Cards of older listing pages: ``article[data-job-id]``, and only if a page has none ``div[data-jobid]``."""
    modern, old = (F.regexp_extract_all(F.col(html), F.lit(p), F.lit(0)) for p in (CARD, LEGACY_CARD))
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.when(F.size(modern) > 0, modern).otherwise(old)).alias("pos", "card"))


def element(tag: str, name: str | None = None, inside: str | None = None, attribute: str | None = None) -> str:
    """A pattern whose group 1 is the inside of the first element of a tag with a class name or an attribute; ``inside``
    is the class of an element around it."""
    named = rf'[^>]*\bclass="[^"]*(?<![\w-]){name}(?![\w-])[^"]*"' if name else ""
    marked = rf"[^>]*{attribute}" if attribute else ""
    around = rf'<[a-z]+[^>]*\bclass="[^"]*(?<![\w-]){inside}(?![\w-])[^"]*"[^>]*>(?:(?!</{"span" if tag == "a" else "div"}>).)*?' if inside else ""
    return rf"(?s){around}<{tag}\b{named}{marked}[^>]*>(.*?)</{tag}>"


def first_element(c: Column, *patterns: str, default: str = "N/A", separator: str = "strip") -> Column:
    """Text of the first pattern that has an element, even if that is empty; else the default."""
    out = None
    for p in patterns:
        told = element_text(F.regexp_extract(c, p, 1), separator)
        out = F.when(c.rlike(p), told) if out is None else out.when(c.rlike(p), told)
    return out.otherwise(F.lit(default))


def element_text(inner: Column, separator: str = "strip") -> Column:
    """Text of an element: ``raw`` as it stands, else its pieces between tags, each trimmed, empty ones left out, joined by
    nothing (``strip``), a line break (``lines``) or a backslash and n (``legacy``)."""
    if separator == "raw":
        return strip_tags(inner, "")
    pieces = F.transform(F.split(inner, "<[^>]*>"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(pieces, lambda x: x != ""), SEPARATORS[separator])


def field(c: Column, marker: str, default: str) -> Column:
    """Text of the first element whose data-automation attribute is ``marker``."""
    inner = F.regexp_extract(c, rf'(?s)data-automation="{marker}"[^>]*>(.*?)</', 1)
    return F.coalesce(F.nullif(collapse(strip_tags(inner)), F.lit("")), F.lit(default))


def strip_tags(c: Column, separator: str = " ") -> Column:
    return F.regexp_replace(c, "<[^>]*>", separator)


def collapse(c: Column) -> Column:
    """Blank for NULL; trimmed; runs of any Unicode white space become one blank."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def is_html(c: Column) -> Column:
    return c.rlike(r"(?is)<[a-z].*>")


def in_parentheses(c: Column) -> Column:
    """The first parenthesised part, else the whole text, else 'N/A'."""
    inner = F.regexp_extract(c, r"\((.*?)\)", 1)
    return F.when(c.isNull() | (c == ""), "N/A").when(c.rlike(r"\(.*?\)"), inner).otherwise(c)


def format_failed(c: Column) -> Column:
    """What is shown of a text when the formatter failed: the text itself in a paragraph, or the fixed notice."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "<p>No description available</p>").otherwise(F.concat(F.lit("<p>"), c, F.lit("</p>")))


def formatted(c: Column, formatter: Callable[[Column], Column] | None = None) -> Column:
    """A text through a formatter (a column function or a pandas UDF), then :func:`unfence`; without one the text itself is
    taken. Where the formatter gives NULL it has failed."""
    made = formatter(c) if formatter else c
    return F.when(made.isNull(), format_failed(c)).otherwise(unfence(made))


def unfence(c: Column) -> Column:
    """Formatter output: the inside of a code fence if there is one, wrapped in a description block once;
    blank text becomes a fixed notice."""
    html = F.regexp_extract(c, r"(?s)```html(.*?)```", 1)
    plain = F.regexp_extract(c, r"(?s)```(.*?)```", 1)
    body = F.regexp_replace(reduce(F.coalesce, [F.nullif(html, F.lit("")), F.nullif(plain, F.lit("")), c]), r"^\s+|\s+$", "")
    wrapped = F.when(body.startswith("<div"), body).otherwise(F.concat(F.lit('<div class="job-description">'), body, F.lit("</div>")))
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "<p>No description available</p>").otherwise(wrapped)
