"""A polite REST source. Its rate limit is global, so one task or the driver
asks at a time; what comes back becomes DataFrames."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lodestone.functions.markup import hrefs, link_bucket, strip_tags, to_markdown, url_path
from lodestone.functions.text import word_count

# How hard a site may be asked, and what is not content.
MIN_INTERVAL, JITTER, RETRIES, BACKOFF, RETRY_AFTER_CAP, PER_PAGE, BUDGET = 2.0, 0.75, 3, 4.0, 120.0, 100, 400
SKIP_TYPES = ("attachment", "nav_menu_item", "wp_block", "wp_template", "wp_template_part", "wp_global_styles", "wp_navigation", "wp_font_family", "wp_font_face", "wp_navigation_link")


class Refused(Exception):
    """The site or the budget says no; nothing more is asked."""


def retry_delay(attempt: int, retry_after: str | None) -> float:
    """What the server asks for, capped, else four seconds doubled each time."""
    try:
        return min(max(float(retry_after), 0.0), RETRY_AFTER_CAP)
    except (TypeError, ValueError):
        return BACKOFF * 2**attempt


def crawl_delay(asked: float | None) -> float:
    """Never faster than our own interval."""
    return max(MIN_INTERVAL, asked or 0.0)


def transport(agent: str, timeout: float = 30.0) -> Callable:
    """``send(url, headers) -> (status, headers, body)``; an error status is
    a reply like any other."""

    def send(url: str, headers: dict) -> tuple[int, dict, bytes]:
        asked = urllib.request.Request(url, headers={"User-Agent": agent, **headers})
        try:
            with urllib.request.urlopen(asked, timeout=timeout) as reply:
                return getattr(reply, "status", None) or 200, dict(reply.headers), reply.read()
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers or {}), b""

    return send


class Robots:
    """A site's rules for us. Rules that cannot be read forbid everything;
    a site without rules (404, 410) allows everything."""

    def __init__(self, send: Callable, site: str, agent: str):
        self.agent, self.rules = agent, None
        status, _, body = send(f"{site.rstrip('/')}/robots.txt", {})
        if status in (200, 404, 410):
            self.rules = urllib.robotparser.RobotFileParser()
            self.rules.parse(body.decode("utf-8", "replace").splitlines() if status == 200 else [])

    def allowed(self, url: str) -> bool:
        if self.rules is None:
            raise Refused("no rules were read")
        return self.rules.can_fetch(self.agent, url)

    @property
    def delay(self) -> float | None:
        asked = self.rules and self.rules.crawl_delay(self.agent)
        return float(asked) if asked else None


class Polite:
    """``send(url, headers) -> (status, headers, body)`` is the transport."""

    def __init__(self, send: Callable, allowed: Callable[[str], bool], cache: dict | None = None, budget: int = BUDGET, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic, delay: float | None = None):
        self.send, self.allowed, self.cache, self.left, self.sleep, self.now = send, allowed, {} if cache is None else cache, budget, sleep, now
        self.delay, self.last = crawl_delay(delay), None

    def get(self, url: str, conditional: bool = True) -> bytes | None:
        """The body, or None if it has not changed since."""
        try:
            allowed = self.allowed(url)
        except Exception as e:  # unknown rules count as a no
            raise Refused(f"robots rules unreadable for {url}") from e
        if not allowed:
            raise Refused(f"robots rules forbid {url}")
        known = self.cache.get(url, {}) if conditional else {}
        headers = {k: v for k, v in (("If-None-Match", known.get("etag")), ("If-Modified-Since", known.get("last_modified"))) if v}
        for attempt in range(RETRIES + 1):
            if self.left <= 0:
                raise Refused("request budget spent")
            self.left -= 1
            if self.last is not None:
                self.sleep(max(0.0, self.delay + random.random() * JITTER - (self.now() - self.last)))
            status, got, body = self.send(url, headers)
            self.last = self.now()
            if status == 304:
                return None
            if status == 200:
                self.cache[url] = {"etag": got.get("ETag"), "last_modified": got.get("Last-Modified")}
                return body
            if status not in (429, 500, 502, 503, 504) or attempt == RETRIES:
                raise Refused(f"{status} for {url}") if status in (401, 403, 429) else OSError(f"{status} for {url}")
            self.sleep(retry_delay(attempt, got.get("Retry-After")))
        raise AssertionError


def paginate(page: Callable[[int], list[dict]], per_page: int = PER_PAGE) -> Iterator[dict]:
    """Pages until a short or empty one; refusals pass on, other errors end it."""
    number = 1
    while True:
        try:
            rows = page(number)
        except Refused:
            raise
        except Exception:
            return
        yield from rows
        if len(rows) < per_page:
            return
        number += 1


class PagedReader(DataSourceReader):
    """One partition: pages follow each other, at the pace of one client."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        options, per_page = self.options, int(self.options.get("per_page", PER_PAGE))
        agent = options.get("agent", "lodestone")
        send = transport(agent)
        robots = Robots(send, options["site"], agent) if options.get("site") else None
        polite = Polite(send, robots.allowed if robots else lambda url: True, budget=int(options.get("budget", BUDGET)), delay=robots and robots.delay)
        if not options["url"].startswith(("http://", "https://")):
            polite.sleep = lambda seconds: None  # recorded pages need no pause
        names = self.schema.fieldNames()
        for row in paginate(lambda number: json.loads(polite.get(options["url"].format(page=number, per_page=per_page), conditional=False)), per_page):
            # Values that are not text are kept as JSON.
            yield tuple(v if v is None or isinstance(v, str) else json.dumps(v) for v in (row.get(n) for n in names))


class PagedSource(DataSource):
    """``spark.read.format("rest_pages").schema(...)``, all columns strings.

    Options: ``url`` with ``{page}`` and ``{per_page}`` (``file:`` reads recorded
    pages), ``per_page``, ``budget``, ``agent``, ``site`` (whose robots.txt
    counts). Register with ``spark.dataSource.register(PagedSource)``.
    """

    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))


_ITEM = "id long, type string, slug string, link string, date string, modified string, parent long, title string, html string, topics array<long>, categories array<long>, audiences array<long>"


class Site:
    """R1's view of a site: its types, terms, listing and pages through ``Polite``.

    ``api`` is the address of the collections; ``mark`` is what a page's path
    follows in its link.
    """

    TAXONOMIES = ("topics", "categories", "audiences", "tags")

    def __init__(self, polite: Polite, api: str, mark: str):
        self.polite, self.api, self.mark = polite, api.rstrip("/"), mark

    def _json(self, path: str):
        return json.loads(self.polite.get(f"{self.api}/{path}", conditional=False))

    def _pages(self, base: str, fields: str) -> list[dict]:
        return list(paginate(lambda number: self._json(f"{base}?per_page={PER_PAGE}&page={number}&_fields={fields}")))

    def types(self, spark: SparkSession) -> DataFrame:
        rows = [(k, v.get("rest_base")) for k, v in self._json("types").items()]
        return content_types(spark.createDataFrame(rows, "key string, rest_base string"))

    def terms(self, spark: SparkSession) -> DataFrame:
        rows = [(name, int(t["id"]), t["name"]) for name in self.TAXONOMIES for t in self._pages(name, "id,name")]
        return taxonomy(spark.createDataFrame(rows, "taxonomy string, id long, name string"))

    def items(self, spark: SparkSession) -> DataFrame:
        """Every page of every type, as ``_ITEM`` says; bounded by the budget."""
        text = lambda v: (v or {}).get("rendered", "") if isinstance(v, dict) else v
        rows = []
        for kind in self.types(spark).toLocalIterator():
            for it in self._pages(kind["rest_base"], "id,link,slug,date,modified,parent,title,content,topics,categories,audiences"):
                rows.append((int(it["id"]), kind["key"], it.get("slug"), it.get("link"), it.get("date"), it.get("modified"), it.get("parent") or 0, text(it.get("title")), text(it.get("content")), *([int(x) for x in it.get(t) or []] for t in ("topics", "categories", "audiences"))))
        found = spark.createDataFrame(rows, _ITEM)
        return found.withColumn("path", url_path(F.col("link"), self.mark)).withColumn("title", strip_tags(F.col("title"))).withColumnRenamed("link", "url")

    def media(self, spark: SparkSession) -> DataFrame:
        rows = [(int(m["id"]), m.get("source_url") or "", m.get("mime_type"), (m.get("title") or {}).get("rendered"), (m.get("media_details") or {}).get("filesize")) for m in self._pages("media", "id,source_url,mime_type,title,media_details")]
        return media(spark.createDataFrame(rows, "id long, url string, mime string, title string, bytes long"))


def archive_records(items: DataFrame, own_host: str) -> DataFrame:
    """A record for each item that has content, with ``text`` and ``html``
    for K4. The digest tells a page whose words did not change from one whose
    date did."""
    day = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 10)
    rows = with_content(items).withColumn("text", to_markdown("html", "title"))
    folder = F.when(F.col("type") == "page", "pages").otherwise(F.col("type"))
    slug = F.coalesce(F.nullif("slug", F.lit("")), F.col("id").cast("string"))
    file = page_path(F.col("type"), F.col("path"), slug, day(F.col("date")), folder)
    links = F.array_sort(F.array_distinct(hrefs(F.col("html"))))
    bucket = lambda name: F.filter(links, lambda h: link_bucket(h, own_host) == name)
    return rows.select(
        "id", "type", "title", "url", "path", file.alias("file"), day(F.col("date")).alias("published"), day(F.col("modified")).alias("modified"), "parent", "topics", "categories", "audiences",
        word_count(F.col("text")).alias("word_count"), F.sha2("text", 256).alias("text_sha256"),
        F.map_from_arrays(F.array(*(F.lit(b) for b in BUCKETS)), F.array(*(bucket(b) for b in BUCKETS))).alias("links"), "text", "html",
    )


BUCKETS = ("drive", "video", "file", "internal", "external")


def content_types(types: DataFrame) -> DataFrame:
    """``types(key, rest_base)`` that hold content, pages first."""
    kept = types.where(~F.col("key").isin(*SKIP_TYPES) & (F.coalesce("rest_base", F.lit("")) != "") & ~F.contains(F.col("rest_base"), F.lit("(?P<")))
    return kept.orderBy(F.col("key") != "page", F.col("key") != "post", "key")


def taxonomy(terms: DataFrame) -> DataFrame:
    """``(taxonomy, names map<string,string>)`` of ``terms(taxonomy, id, name)``."""
    return terms.groupBy("taxonomy").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct(F.col("id").cast("string"), "name")))).alias("names"))


def snapshot(items: DataFrame) -> DataFrame:
    """``(id, path, type, title, url, modified, published)``; one row per id."""
    day = lambda c: F.substring(c, 1, 10)
    rows = items.select("id", "path", "type", "title", "url", day("modified").alias("modified"), day("date").alias("published"))
    return rows.dropDuplicates(["id"])


def media(items: DataFrame) -> DataFrame:
    """Files that the site offers; listed, never fetched."""
    return items.select("id", F.substring_index("url", "/", -1).alias("file"), "mime", "title", "url", "bytes")


def with_content(items: DataFrame) -> DataFrame:
    """F6."""
    return items.where(F.length(F.coalesce("html", F.lit(""))) > 0)


def page_path(kind: Column, path: Column, slug: Column, published: Column, folder: Column) -> Column:
    """K4: where a page is written: posts by date, all else by path."""
    return F.when(kind == "post", F.concat(F.lit("announcements/"), published, F.lit("-"), F.left(slug, F.lit(70)), F.lit(".md"))).otherwise(F.concat_ws("/", folder, path, F.lit("index.md")))
