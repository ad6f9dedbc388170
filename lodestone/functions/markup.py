"""HTML, markdown and links."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions.text import strip

# Where a link belongs.
DRIVE_HOSTS = ("drive.google.com", "docs.google.com")
VIDEO_HOSTS = ("youtube.com", "youtu.be", "vimeo.com", "facebook.com/watch")
FILE_SUFFIXES = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip")
UPLOADS = "/wp-content/uploads/"


def strip_tags(html: Column) -> Column:
    """P9."""
    return strip(F.regexp_replace(html, "<[^>]+>", ""))


def url_path(link: Column, root: str) -> Column:
    """The part after the first ``root``, without outer slashes."""
    after = F.element_at(F.split(link, re.escape(root), 2), -1)
    return F.coalesce(F.nullif(F.regexp_replace(after, "^/+|/+$", ""), F.lit("")), F.lit("_home"))


def hrefs(html: Column) -> Column:
    """Link targets that lead to another page."""
    found = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("href=[\"']([^\"'#][^\"']*)[\"']"), F.lit(1)), strip)
    return F.filter(found, lambda h: ~h.rlike("^(mailto:|tel:|javascript:)"))


def link_bucket(href: Column, own_host: str) -> Column:
    """Drive before video before file before internal before external."""
    low = F.lower(href)
    host = F.lower(F.regexp_extract(href, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    holds = lambda parts: low.rlike("|".join(map(re.escape, parts)))
    bare = F.element_at(F.split(low, "\\?", 2), 1)
    is_file = bare.rlike("(" + "|".join(map(re.escape, FILE_SUFFIXES)) + ")$") | F.contains(low, F.lit(UPLOADS))
    return F.when(holds(DRIVE_HOSTS), "drive").when(holds(VIDEO_HOSTS), "video").when(is_file, "file").when((host == "") | F.contains(host, F.lit(own_host)), "internal").otherwise("external")


def share_link(target: Column) -> Column:
    """P25: links for people turned into links to the file itself."""
    # The address forms of three file hosts.
    rules = (
        ("^https://drive\\.google\\.com/file/d/([^/]+).*$", "https://drive.google.com/uc?export=download&id=$1"),
        ("^https://drive\\.google\\.com/open\\?id=([^&]+).*$", "https://drive.google.com/uc?export=download&id=$1"),
        ("^(https://www\\.dropbox\\.com/[^?]+)\\?.*$", "$1?dl=1"),
        ("^https://github\\.com/([^/]+)/([^/]+)/blob/(.+)$", "https://raw.githubusercontent.com/$1/$2/$3"),
    )
    out = F.lit(None).cast("string")
    for pattern, put in reversed(rules):
        out = F.when(target.rlike(pattern), F.regexp_replace(target, pattern, put)).otherwise(out)
    return F.coalesce(out, target)


def plain(markdown: Column) -> Column:
    """Markdown to text for drawing, line by line."""
    # Which marks go, in this order, as later ones see what is left.
    rules = (
        ("^\\s{0,3}#{1,6}\\s*", ""),
        ("\\*\\*([^*]+)\\*\\*", "$1"),
        ("(?<!\\*)\\*([^*\\n]+)\\*(?!\\*)", "$1"),
        ("`([^`]+)`", "$1"),
        ("\\[([^\\]]+)\\]\\((https?://[^)]+)\\)", "$1 ($2)"),
        ("^\\s*[-*+]\\s+", "- "),
        ("^\\s*\\|", ""),
        ("\\s*\\|\\s*", "  "),
    )

    def line(x: Column) -> Column:
        for pattern, put in rules:
            x = F.regexp_replace(x, pattern, put)
        return x

    lines = F.filter(F.transform(F.split(markdown, "\n"), line), lambda x: ~x.rlike("^[\\s\\-:]{3,}$"))
    joined = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "\\s+$", "")), "\n")
    return strip(F.regexp_replace(joined, "\\n{3,}", "\n\n"))


class _Markdown(HTMLParser):
    """ATX headings, ``-`` bullets, links, emphasis, tables as pipe rows."""

    SILENT = ("script", "style", "noscript")
    BLOCKS = ("p", "div", "section", "article", "ul", "ol", "table", "blockquote", "header", "footer", "main", "nav", "body", "html")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0
        self.lists: list[list] = []
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif self.silent:
            pass
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "br":
            self.out.append("\n")
        elif tag == "tr":
            self.out.append("\n|")
        elif tag in self.BLOCKS:
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.silent:
            pass
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n\n")
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif re.fullmatch("h[1-6]", tag) or tag in self.BLOCKS:
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({href})" if href else "]")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str | None, title: str | None) -> str:
    """P10: stable in its white space, so that only edits show as edits."""
    body, head = _Markdown(), _Markdown()
    body.feed(html or "")
    body.close()
    head.feed(title or "")
    head.close()
    lines = [re.sub(r"[ \t]+", " ", x).strip() if not re.match(r"\s+(-|\d+\.) ", x) else x.rstrip() for x in "".join(body.out).split("\n")]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return f"# {''.join(head.out).strip()}\n\n{text}\n"


@F.pandas_udf(StringType())
def to_markdown(html: pd.Series, title: pd.Series) -> pd.Series:
    """P10 as a column; parsing markup has no built-in function."""
    return pd.Series([html_to_markdown(h, t) for h, t in zip(html, title)], index=html.index)
