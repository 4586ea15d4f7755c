"""Landed news feeds and pages to article rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import strip_html, truncate_sentences
from tidemark.functions.timeutil import parse_iso
from tidemark.operators.stories import lead_image

ITEM = "title string, link string, guid string, pubDate string, updated string, description string, `content:encoded` string, category array<string>, enclosure array<struct<_url:string,_type:string>>"


#: An entry of an Atom feed; elements with attributes and markup inside come as text.
ENTRY = "title string, link array<struct<_href:string,_rel:string,_type:string>>, id string, published string, updated string, summary string, content string, category array<struct<_term:string>>"


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Items of RSS files by Spark's XML reader; broken files give no rows."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "DROPMALFORMED").option("ignoreNamespace", "false").schema(ITEM).load(path)


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files in the columns of read_feed(): the link is the first that is no enclosure and names no other relation than `alternate`, the id is the guid."""
    e = spark.read.format("xml").option("rowTag", "entry").option("mode", "DROPMALFORMED").schema(ENTRY).load(path)
    links = F.coalesce("link", F.array().cast("array<struct<_href:string,_rel:string,_type:string>>"))
    pages = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    enclosed = F.filter(links, lambda x: x["_rel"] == "enclosure")
    return e.select(
        "title", F.get(pages, F.lit(0))["_href"].alias("link"), F.col("id").alias("guid"), F.col("published").alias("pubDate"), "updated", F.col("summary").alias("description"), F.col("content").alias("content:encoded"),
        F.transform(F.coalesce("category", F.array().cast("array<struct<_term:string>>")), lambda c: F.coalesce(c["_term"], F.lit(""))).alias("category"), F.transform(enclosed, lambda x: F.struct(x["_href"].alias("_url"), x["_type"].alias("_type"))).alias("enclosure"),
    )


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Items of all feed files of a folder, RSS and Atom."""
    return read_feed(spark, path).unionByName(read_atom(spark, path))


def _feed_time(text: Column) -> Column:
    """`Mon, 01 Jan 2024 10:00:00 +0000` or ISO."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|Z)$", "+0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), parse_iso(text))


def feed_articles(items: DataFrame, fetched_at: Column) -> DataFrame:
    """Article rows of feed items: none without link or title, guid or else link, published or else updated or else fetched, longest body first found, cut at 600 signs."""
    body = F.coalesce(F.nullif(F.col("`content:encoded`"), F.lit("")), F.col("description"), F.lit(""))
    title = strip_html(F.coalesce("title", F.lit("")))
    pictures = F.transform(F.coalesce("enclosure", F.array().cast("array<struct<_url:string,_type:string>>")), lambda e: F.struct(e["_type"].alias("type"), e["_url"].alias("href")))
    rows = items.select(
        F.coalesce(F.nullif(F.trim("guid"), F.lit("")), F.trim("link")).alias("guid"), F.trim("link").alias("url"), title.alias("title"), truncate_sentences(strip_html(body), 600).alias("summary"), lead_image(pictures, body).alias("image_url"),
        F.filter(F.coalesce("category", F.array().cast("array<string>")), lambda c: c != "").alias("tags"), F.coalesce(_feed_time(F.col("pubDate")), _feed_time(F.col("updated")), fetched_at).alias("published"), fetched_at.alias("fetched_at"),
    )
    return rows.filter("url <> '' AND title <> ''")


_ROW = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("url", "title", "body", "time")]))


@F.pandas_udf(_ROW)
def _rows(html: pd.Series, base: pd.Series) -> pd.Series:
    """Rows of a listing page: `views-row` blocks with a title link, a body and a time."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    class Page(HTMLParser):
        def __init__(self, base: str) -> None:
            super().__init__()
            self.base, self.stack, self.rows = base, [], []

        def inside(self, name: str) -> bool:
            return any(name in classes for _, classes in self.stack)

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            classes = set((a.get("class") or "").split())
            if tag == "div" and "views-row" in classes:
                self.rows.append({"url": "", "title": "", "body": "", "time": None})
            if tag not in void:
                self.stack.append((tag, classes))
            if self.rows and self.inside("views-row"):
                if tag == "a" and a.get("href") and not self.rows[-1]["url"] and self.inside("views-field-title") and any(t == "h3" for t, _ in self.stack):
                    self.rows[-1]["url"] = urljoin(self.base, a["href"].strip())
                    self.stack[-1][1].add("__title")
                if tag == "time" and a.get("datetime") and self.inside("views-field-created") and self.rows[-1]["time"] is None:
                    self.rows[-1]["time"] = a["datetime"]

        def handle_endtag(self, tag):
            for k in reversed(range(len(self.stack))):
                if self.stack[k][0] == tag:
                    del self.stack[k:]
                    break

        def handle_data(self, data):
            if self.rows and self.inside("views-row"):
                if self.inside("__title"):
                    self.rows[-1]["title"] += data
                elif self.inside("views-field-body") and self.inside("field-content"):
                    self.rows[-1]["body"] += data

    def one(text, base):
        page = Page(base or "")
        page.feed(text or "")
        return [r for r in page.rows if r["url"]]

    return pd.Series([one(t, b) for t, b in zip(html, base, strict=True)])


def listing_articles(pages: DataFrame, fetched_at: Column) -> DataFrame:
    """Article rows of listing pages (page_url, html): absolute URL as guid, title and summary as plain text, time with offset or else the fetch time, no image."""
    rows = pages.select(F.explode(_rows("html", "page_url")).alias("r"))
    rows = rows.select(F.col("r.url").alias("guid"), F.col("r.url").alias("url"), strip_html("r.title").alias("title"), truncate_sentences(strip_html("r.body"), 600).alias("summary"), F.lit(None).cast("string").alias("image_url"), F.coalesce(parse_iso(F.col("r.time")), fetched_at).alias("published"), fetched_at.alias("fetched_at"))
    return rows.filter("title <> ''")
