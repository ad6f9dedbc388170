"""Answer verification (V1 to V19): what an answer cites, links and states must
come from the retrieved sources.

``answers(answer_id, answer, question, top_raw, lang_drift, results)`` has one
row per answer; ``results`` is an array of structs in tag order with ``title,
section, url, source, status, text, doc_path, score, citation, source_document,
review_by``. Warnings are ``array<struct<code, text>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import COPIED_LINE, COPIED_SHARE, LIVE, PARTNER, RETIRED, REVIEW_NOTICE_DAYS, WEAK_SCORE
from lodestone.functions.facts import describe, unverified
from lodestone.functions.text import collapse, strip

# Phrases that say a service is off, and words that ask for an action.
OUTAGE = "(?i)currently unavailable|temporarily unavailable|not available at this time|temporarily (?:suspended|closed|paused)|service is suspended|suspended until further notice|ongoing (?:global )?technical (?:issue|problem)"
ACTION = "(?i)\\b(?:click|log ?in|sign ?in|regist\\w*|portal|online form|appl(?:y|ication)|submit\\w*|renew\\w*|enrol\\w*|book\\w*|appointment|account|visit\\w*|website)\\b"
REFUSAL = "No answer to this was found in the archive, so none is guessed. Try asking in a different way."
WARNINGS = {
    "invented": "Citations to sources that do not exist were removed; verify this answer.",
    "uncited": "The answer cited no sources; verify it before sharing.",
    "retired": "This answer draws on the retired site; details may have changed.",
    "outage": "The sources say the service is unavailable, but the answer does not.",
    "expired": "Part of this answer was only confirmed until a date that has passed.",
    "expiring": "Part of this answer must be confirmed again soon.",
    "superseded": "Part of the archive used here has been superseded.",
    "drift": "The reply is in the wrong language.",
    "weak": "The archive did not match this question strongly.",
    "links": "Web addresses that are not in the sources were removed.",
    "copied": "Most of this reply is copied word for word from the archive.",
}


def pieces(text: Column, pattern: str, opener: str) -> Column:
    """The text cut into what ``pattern`` matches, all of which begins with the
    character ``opener``, and what lies between; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(f"(?Us){pattern}|[^{opener}]+|{opener}"), F.lit(0))


#: Bracketed groups, by what is inside (fixed: the forms that drafts are known to mangle).
BRACKETS, TAG, LOOSE_TAG, SHOUT = "\\[[^\\]\\n]{1,40}\\]", "\\s*S\\d+\\s*", "\\s*(?:S[A-Z]|source|src)\\s*(\\d+)\\s*", "[A-Z][A-Z ]{2,}"


def repair_tags(answer: Column, n_sources: Column) -> Column:
    """V1: mangled tags become ``[S#]`` if there is such a source and go
    otherwise; capital pseudo-tags go. Tags are compared as text: a leading zero
    names no source."""
    known = tags(n_sources)

    def repaired(piece: Column) -> Column:
        is_ = lambda inside, flags="(?U)": piece.rlike(f"{flags}\\A\\[(?:{inside})\\]\\z")
        tag = F.concat(F.lit("S"), F.regexp_extract(piece, f"(?Ui)\\A\\[{LOOSE_TAG}\\]\\z", 1))
        return (
            F.when(~piece.rlike(f"(?U)\\A{BRACKETS}\\z"), piece)
            .when(is_(TAG), F.concat(F.lit("["), F.regexp_extract(piece, "(?U)S\\d+", 0), F.lit("]")))
            .when(is_(LOOSE_TAG, "(?Ui)"), F.when(F.array_contains(known, tag), F.concat(F.lit("["), tag, F.lit("]"))).otherwise(""))
            .when(is_(SHOUT, ""), "")
            .otherwise(piece)
        )

    return F.array_join(F.transform(pieces(answer, BRACKETS, "\\["), repaired), "")


def cited(answer: Column) -> Column:
    """V2: distinct tags inside brackets, in order."""
    groups = F.regexp_extract_all(answer, F.lit("\\[([^\\]]*S\\d+[^\\]]*)\\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit("S\\d+"), F.lit(0)))))


def tags(n: Column) -> Column:
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("S"), k.cast("string")))).otherwise(F.array().cast("array<string>"))


def strip_tags(answer: Column, gone: Column) -> Column:
    """V3: invented tags out, then brackets that are empty or end in a comma."""
    text = F.aggregate(F.sort_array(gone), answer, lambda s, t: F.regexp_replace(s, F.concat(F.lit("\\b"), t, F.lit("\\b[,;]?\\s*")), F.lit("")))
    text = F.regexp_replace(text, "\\[\\s*[,;]*\\s*\\]", "")
    return F.when(F.size(gone) > 0, F.regexp_replace(text, "\\[([^\\]]*?)[,;]\\s*\\]", "[$1]")).otherwise(answer)


STANDING = {
    "superseded": "no longer valid, replaced by newer official material",
    PARTNER: "valid, handed over by a partner and ahead of the website",
    LIVE: "valid, on the website now",
    RETIRED: "unconfirmed, from the website that was switched off",
}


def render(results: Column) -> Column:
    """Numbered source blocks: title and section, standing, where the text
    comes from (the citation before the address), the text."""
    given = lambda c: F.nullif(c, F.lit(""))

    def block(r: Column, i: Column) -> Column:
        role = F.when(F.lower(r["status"]) == "superseded", "superseded").when(r["source"].isin(PARTNER, LIVE), r["source"]).otherwise(RETIRED)
        standing = F.element_at(F.create_map(*(F.lit(x) for kv in STANDING.items() for x in kv)), role)
        place = F.coalesce(r["url"], F.lit(""))
        origin = F.coalesce(F.concat(F.lit("From "), given(r["citation"]), F.lit("; compare "), place), F.concat(F.lit("At "), place))
        head = F.format_string("[S%d] %s", i + 1, F.concat_ws(" > ", r["title"], given(r["section"])))
        return F.concat_ws("\n", head, F.concat(F.lit("Standing: "), standing), origin, F.lit(""), r["text"])

    return F.array_join(F.transform(results, block), "\n\n")


MARKDOWN_LINK, BARE_LINK = "\\[[^\\]]+\\]\\(https?://[^)\\s]+\\)", "https?://[^\\s)\\]>\"']+"


def check_links(answer: Column, rendered: Column) -> Column:
    """``struct<answer, bad>``. Links and bare addresses that the
    sources lack go; the label of a link and the punctuation after an address
    stay. Any beginning of a known address is known."""

    def swept(text: Column, pattern: str, opener: str, address, left) -> tuple[Column, Column]:
        """``text`` with ``left`` of each match whose ``address`` is unknown, and
        these addresses."""
        found = pieces(text, pattern, opener)
        unknown = lambda p: p.rlike(f"(?Us)\\A{pattern}\\z") & ~F.contains(rendered, F.regexp_replace(address(p), "/+\\z", ""))
        return F.array_join(F.transform(found, lambda p: F.when(unknown(p), left(p)).otherwise(p)), ""), F.transform(F.filter(found, unknown), address)

    text, links = swept(answer, MARKDOWN_LINK, "\\[", lambda p: F.regexp_extract(p, "\\]\\((.*)\\)\\z", 1), lambda p: F.regexp_extract(p, "(?s)\\A\\[([^\\]]+)\\]", 1))
    trimmed = lambda p: F.regexp_replace(p, "[.,;:!?]+\\z", "")
    text, bare = swept(text, BARE_LINK, "h", trimmed, lambda p: F.regexp_extract(p, "[.,;:!?]*\\z", 0))
    return F.struct(text.alias("answer"), F.array_sort(F.array_distinct(F.concat(links, bare))).alias("bad"))


def tidy_headings(answer: Column) -> Column:
    """Headings that are only a tag go; ``### 1Word`` gets its point."""
    text = F.regexp_replace(answer, "(?m)^[ \\t]*#{1,6}[ \\t]*\\[S\\d+\\][ \\t]*$\\n?", "")
    return F.regexp_replace(text, "(?m)^(#{1,6}[ \\t]*\\d+)(?=[A-Za-z])", "$1. ")


def where_to_go(answer: Column, sources: Column) -> Column:
    """Up to two links, current sources first, where an answer asks for
    an action and gives no address."""
    placed = F.transform(sources, lambda s, i: F.struct((~s["is_current"]).alias("late"), i.alias("i"), s["title"].alias("title"), F.trim(s["url"]).alias("url"), s["tag"].alias("tag")))
    linked = F.filter(F.sort_array(placed), lambda s: F.coalesce(s["url"].startswith("http"), F.lit(False)))
    urls = F.transform(linked, lambda s: s["url"])
    first = F.slice(F.filter(linked, lambda s, i: F.array_position(urls, s["url"]) == i + 1), 1, 2)
    lines = F.transform(first, lambda s: F.concat(F.lit("- ["), s["title"], F.lit("]("), s["url"], F.lit(") ["), s["tag"], F.lit("]"), F.when(s["late"], F.lit(" (from the retired site)")).otherwise("")))
    add = ~answer.rlike("https?://") & answer.rlike(ACTION) & (F.size(lines) > 0)
    return F.when(add, F.concat(answer, F.lit("\n\n**Where to go:**\n"), F.array_join(lines, "\n"))).otherwise(answer)


def copied_share(answer: Column, rendered: Column) -> Column:
    """Share of the long lines' characters that the sources hold verbatim."""
    hay = collapse(rendered)
    long = F.filter(F.transform(F.split(answer, "\n"), strip), lambda x: F.length(x) >= COPIED_LINE)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + F.length(x))
    return F.when(F.size(long) > 0, total(F.filter(long, lambda x: F.contains(hay, collapse(x)))) / total(long)).otherwise(0.0)


def review(shown: Column, today: Column) -> Column:
    """``expired``, ``expiring`` or null for the first valid review date."""
    dates = F.filter(F.transform(shown, lambda r: F.when(r["review_by"].rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_date(r["review_by"], "yyyy-MM-dd"))), lambda d: d.isNotNull())
    due = F.get(dates, F.lit(0))
    return F.when(today >= due, "expired").when(F.datediff(due, today) <= REVIEW_NOTICE_DAYS, "expiring")


def verify(answers: DataFrame, today: str) -> DataFrame:
    """V1 to V18 in order: ``answer_id, answer, sources, warnings, unverified,
    note``. ``today`` is an ISO date, so that results can be repeated."""
    n = F.size("results")
    df = answers.withColumn("answer", repair_tags(F.col("answer"), n)).withColumn("cited", cited(F.col("answer")))
    df = df.withColumn("invented", F.sort_array(F.array_except("cited", tags(n)))).withColumn("used", F.array_intersect("cited", tags(n)))
    df = df.withColumn("answer", strip_tags(F.col("answer"), F.col("invented"))).withColumn("rendered", render(F.col("results")))
    tagged = F.transform("results", lambda r, i: F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("tag"), r["title"].alias("title"), r["section"].alias("section"), r["url"].alias("url"), (r["source"].isin(LIVE, PARTNER) & (F.lower(F.coalesce(r["status"], F.lit(""))) != "superseded")).alias("is_current"), r["score"].alias("score"), r["doc_path"].alias("doc_path"), r["citation"].alias("citation"), r["source_document"].alias("source_document"), r["review_by"].alias("review_by"), r["source"].alias("source"), r["status"].alias("status"), r["text"].alias("text")))
    # The sources cited, or all if none is.
    df = df.withColumn("shown", F.filter(tagged, lambda r: (F.size("used") == 0) | F.array_contains("used", r["tag"])))
    df = df.withColumn("facts", unverified(F.col("answer"), F.concat_ws("\n", "rendered", "question")))
    outage = F.exists("shown", lambda r: r["text"].rlike(OUTAGE)) & ~F.col("answer").rlike(OUTAGE)
    df = df.withColumn("outage", outage).withColumn("review", review(F.col("shown"), F.lit(today).cast("date")))
    df = df.withColumn("answer", tidy_headings(F.col("answer"))).withColumn("linked", check_links(F.col("answer"), F.col("rendered")))
    df = df.withColumn("answer", where_to_go(F.col("linked.answer"), F.col("shown"))).withColumn("copied", copied_share(F.col("answer"), F.col("rendered")))
    has = lambda test: F.exists("shown", test)
    order = [
        ("expired", F.col("review") == "expired"), ("outage", F.col("outage")),
        ("invented", F.size("invented") > 0), ("uncited", F.size("used") == 0), ("retired", has(lambda r: r["source"] == RETIRED)),
        ("expiring", F.col("review") == "expiring"), ("superseded", has(lambda r: F.lower(F.coalesce(r["status"], F.lit(""))) == "superseded")),
        ("drift", F.coalesce("lang_drift", F.lit(False))), ("weak", F.coalesce("top_raw", F.lit(0.0)) < WEAK_SCORE),
        ("links", F.size("linked.bad") > 0), ("copied", F.col("copied") > COPIED_SHARE),
    ]
    warnings = F.filter(F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), F.lit(WARNINGS[code]).alias("text"))) for code, test in order)), lambda w: w.isNotNull())
    sources = F.transform("shown", lambda r: F.struct(*(r[c].alias(c) for c in ("tag", "title", "section", "url", "is_current", "score", "doc_path", "citation", "source_document"))))
    return df.select("answer_id", strip(F.col("answer")).alias("answer"), sources.alias("sources"), warnings.alias("warnings"), F.col("facts").alias("unverified"), describe(F.col("facts")).alias("note"))


def refusal(questions: DataFrame) -> DataFrame:
    """The record of a refused question."""
    return questions.select("q", F.lit(REFUSAL).alias("answer"), F.lit(True).alias("refused"))


def sources_by_title(sources: DataFrame) -> DataFrame:
    """``(answer_id, title, origin, tags)`` of ``(answer_id, tag_no, title,
    citation, url)``, the tags in order."""
    origin = F.coalesce(F.nullif("citation", F.lit("")), F.col("url"))
    grouped = sources.withColumn("origin", origin).groupBy("answer_id", "title", "origin").agg(F.sort_array(F.collect_list("tag_no")).alias("tags"))
    return grouped.withColumn("tags", F.array_join(F.transform("tags", lambda t: F.concat(F.lit("S"), t.cast("string"))), ", "))
