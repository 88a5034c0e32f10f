"""Table extraction from HTML pages already held in a pages(page_id, url, html) table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.fixed_values import VALUE_BAND_EUR
from terrace.functions.text import to_double, to_int
from terrace.operators.feeds import carry_forward

# The page patterns.
RESULT_ROW = r"(?s)<tr[^>]*>(.*?)</tr>"
SCORE = r'class="ergebnis-link"[^>]*>\s*(\d+):(\d+)\s*<'
TEAM_ANCHOR = r'<a title="([^"]+)"[^>]*href="[^"]*?/verein/\d+/'
DATE_LINK = r"datum/(\d{4}-\d{2}-\d{2})"
ITEMS_TABLE = r'(?s)<table class="items">(.*?)</table>'
ITEM_ROW = r'(?s)<tr class="(?:odd|even)">(.*?)</tr>'
CLUB_ID = r"/verein/(\d+)/"
CLUB_TITLE = r'/verein/\d+/[^"]*"\s+title="([^"]+)"'
ANY_TITLE = r'title="([^"]+)"'
MONEY = r"([\d.,]+)\s*(bn|m|k|Th\.)\b"
LINK_ROW = r'<li><a href="([^"]*)">([^<]*)</a></li>'


def page_rows(pages: DataFrame, pattern: str, html: str = "html") -> DataFrame:
    """(page_id, pos, row): every match of ``pattern``'s first group, in page order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(pattern), 1)).alias("pos", "row"))


def result_rows(pages: DataFrame) -> DataFrame:
    """Played matches of results pages: date carried forward, teams around the score.

    Everything is cut out of the row before the carry, so only short columns are
    shuffled, never the page text.
    """
    teams = lambda text: F.regexp_extract_all(text, F.lit(TEAM_ANCHOR), 1)
    halves = F.split("row", SCORE, 2)
    cut = page_rows(pages, RESULT_ROW).withColumn("halves", halves)
    cut = cut.withColumns({"before": teams(F.get("halves", F.lit(0))), "after": teams(F.get("halves", F.lit(1)))})
    cut = cut.select(
        "page_id",
        "pos",
        F.nullif(F.regexp_extract("row", DATE_LINK, 1), F.lit("")).alias("d"),
        F.trim(F.try_element_at("before", F.lit(-1))).alias("home_team"),
        F.trim(F.try_element_at("after", F.lit(1))).alias("away_team"),
        to_int(F.regexp_extract("row", SCORE, 1)).alias("home_score"),
        to_int(F.regexp_extract("row", SCORE, 2)).alias("away_score"),
    )
    dated = carry_forward(cut, ["page_id"], "pos", "d", "match_date")
    played = dated.dropna(subset=["match_date", "home_team", "away_team", "home_score", "away_score"])
    played = played.filter("home_team <> '' and away_team <> '' and home_team <> away_team")
    return played.select("page_id", "pos", F.to_date("match_date").alias("match_date"), "home_team", "away_team", "home_score", "away_score")


def club_values(pages: DataFrame) -> DataFrame:
    """(page_id, club_id, name, value_eur) of value pages: the largest amount in each row, within the sane band."""
    inner = pages.select("page_id", F.regexp_extract("html", ITEMS_TABLE, 1).alias("html"))
    row = F.col("row")
    amounts = F.zip_with(
        F.regexp_extract_all(row, F.lit(MONEY), 1),
        F.regexp_extract_all(row, F.lit(MONEY), 2),
        lambda n, u: to_double(F.replace(n, F.lit(","), F.lit("")))
        * F.when(u == "bn", 1e9).when(u == "m", 1e6).otherwise(1e3),
    )
    title = F.coalesce(F.nullif(F.regexp_extract(row, CLUB_TITLE, 1), F.lit("")), F.regexp_extract(row, ANY_TITLE, 1))
    found = page_rows(inner, ITEM_ROW).select(
        "page_id", F.regexp_extract(row, CLUB_ID, 1).alias("club_id"), F.trim(title).alias("name"), F.array_max(amounts).alias("value_eur")
    )
    lo, hi = VALUE_BAND_EUR
    return found.filter((F.col("club_id") != "") & (F.col("name") != "") & F.col("value_eur").between(lo, hi))


def link_rows(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, label) of list links: the same row scan on a generic page."""
    href = F.regexp_extract_all("html", F.lit(LINK_ROW), 1)
    label = F.regexp_extract_all("html", F.lit(LINK_ROW), 2)
    pairs = F.arrays_zip(href.alias("href"), label.alias("label"))
    return pages.select("page_id", F.posexplode(pairs).alias("pos", "p")).select("page_id", "pos", "p.href", "p.label")
