"""Readers, sinks, refresh and streaming over small trees of invented files."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.config import LIVE, PARTNER, RETIRED
from lodestone.operators import corpus, diff, evaluate, retrieval
from lodestone.plans import ask, refresh
from lodestone.sources import archive, bundle, rest, sinks
from lodestone.streaming import ingest

RECORD = {"id": 7, "type": "page", "title": "Clinics", "url": "https://s.org/c/", "path": "clinics", "file": "pages/clinics/index.md", "published": "2026-01-01", "modified": "2026-02-02", "parent": 0, "topics": [1, 9], "categories": [], "audiences": [3], "word_count": 3, "text_sha256": "x", "links": {"file": ["/a.pdf"]}}


@pytest.fixture
def tree(tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text if isinstance(text, str) else json.dumps(text), encoding="utf-8")
        return str(path)

    put("old/fees/index.md", "# Fees\n\nSource: https://old.org/fees\n\n## How much\nRM 10 at the desk.")
    put("old/contact/index.md", "No title here.")
    put("live/pages/clinics/index.md", "# Clinics\n\nopen on Monday")
    put("live/announcements/2026-01-02-n.md", "not in the index")
    put("live/_index.json", {"source": "s.org", "captured": "2026-03-03", "taxonomy": {"topics": {"1": "Health"}, "categories": {}, "audiences": {"3": "All"}}, "records": [RECORD, {**RECORD, "id": 8, "file": "pages/gone/index.md"}], "media": [{"id": 1, "file": "a.pdf", "mime": "application/pdf", "title": "A", "url": "u", "bytes": 5}]})
    put("partner/note.md", "Partner text")
    put("partner.json", {"records": [{"file": "partner/note.md", "title": "Note", "url": "https://p.org", "review_by": "2026-09-09"}, {"file": "missing.md", "title": "M"}], "supersedes": [{"match": "RM 10", "reason": "now RM 20"}, {"match": "x", "reason": "y"}], "provided_by": "P", "received": "2026-01-05", "citation": "Minutes"})
    put("gap.json", {"items": [{"old_slug": "fees", "status": "kept"}, {"old_slug": "fees", "status": "dropped"}]})
    put("state.json", {"baseline": {"7": {"path": "clinics", "type": "page", "title": "Clinics", "url": "u", "modified": "2026-02-02", "published": "2026-01-01"}}, "captured": "2026-03-03", "pending": {"ids": ["7"], "detected": "2026-03-04"}, "history": ["2026-03-01", "2026-03-02"]})
    put("broken.json", "{not json")
    put("eval.json", {"cases": [{"q": "a", "fact": "f", "kind": "text", "hit": True, "rank_fused": 1, "rank_dense": 2, "rank_bm25": 3}]})
    put("chunks.jsonl", '{"chunk_id": "old:a:0", "chunk_index": 0, "topics": ["t"], "extra": 1}\n\n   \n{"chunk_id": "old:a:1", "text": "x"}\n')
    return tmp_path, put


def docs_of(spark, root):
    retired = archive.retired_docs(spark, f"{root}/old", "https://old.org")
    live = archive.live_docs(spark, f"{root}/live/_index.json", f"{root}/live")
    partner, missing = archive.partner_docs(spark, f"{root}/partner.json", f"{root}/partner")
    return retired, live, partner, missing


def test_readers(spark, tree):
    root, _ = tree
    retired, live, partner, missing = docs_of(spark, root)
    assert [(r.slug, r.title, r.url) for r in retired.collect()] == [("contact", "contact", "https://old.org/contact/"), ("fees", "Fees", "https://old.org/fees")]
    assert [(r.slug, r.source, r.topics, r.categories, r.audiences) for r in live.collect()] == [("clinics", LIVE, ["Health"], None, ["All"])]
    assert [(r.slug, r.citation, r.review_by) for r in partner.collect()] == [("note", "Minutes", "2026-09-09")] and [r.file for r in missing.collect()] == ["missing.md"]
    assert [(r.ord, r.match) for r in archive.supersession_rules(spark, f"{root}/partner.json").collect()] == [(0, "RM 10"), (1, "x")]
    assert corpus.gap_dimension(archive.gap_items(spark, f"{root}/gap.json")).collect() == [("fees", "dropped")]
    chunks = archive.read_chunks(spark, f"{root}/chunks.jsonl")
    assert [(r.chunk_id, r.topics) for r in chunks.collect()] == [("old:a:0", ["t"]), ("old:a:1", None)] and archive.count_lines(spark, f"{root}/chunks.jsonl").first().lines == 2
    assert archive.eval_baseline(spark, f"{root}/eval.json").first().rank_bm25 == 3
    good, broken = archive.state(spark, f"{root}/state.json").first(), archive.state(spark, f"{root}/broken.json").first()
    assert good.pending.ids == ["7"] and (broken.baseline, broken.history, broken.pending) == ({}, [], None)
    index = archive.site_index(spark, f"{root}/live/_index.json")
    assert [r.id for r in archive.seed_baseline(index.select(F.explode("records").alias("r")).select("r.*")).collect()] == [7, 8]


def built(spark, root):
    retired, live, partner, _ = docs_of(spark, root)
    return corpus.supersede(corpus.build(corpus.union_producers(retired, live, partner), corpus.gap_dimension(archive.gap_items(spark, f"{root}/gap.json"))), archive.supersession_rules(spark, f"{root}/partner.json"))


def embed(chunks):
    """Two numbers a text: enough for an embedder that needs no model."""
    return chunks.withColumn("vector", F.array(F.length("embed_text").cast("double"), F.lit(1.0)))


def test_from_files_to_answers_by_chunk_id(spark, tree):
    root, _ = tree
    chunks = built(spark, root)
    assert {(r.chunk_id, r.status) for r in chunks.collect()} == {("old:contact:0", "unmapped"), ("old:fees:0", "dropped"), ("old:fees:1", "superseded"), ("new:clinics:0", "current"), ("partner:note:0", "current")}
    refresh.write_version(chunks, embed, "2026-03-05", f"{root}/v1")
    index = sinks.read_index(spark, f"{root}/v1/index")
    assert index.count() == 5 and {r.id: round(r.weight, 2) for r in index.collect()}["old:fees:1"] == 0.6
    asked = spark.createDataFrame([("q1", "How much at the desk?", [30.0, 1.0]), ("q2", "partner note", [9.0, 1.0])], "q string, text string, vector array<double>")
    ranking = retrieval.hybrid(index, asked).collect()
    assert len(ranking) == 10 and sorted(r["rank"] for r in ranking if r.q == "q1") == [1, 2, 3, 4, 5]
    assert all(r.bm25 > 0 for r in ranking if r.q == "q2" and r.id == "partner:note:0" and r.rank_bm25 == 1)
    found = retrieval.search(index, asked, 2, "old").collect()
    assert len(found) == 4 and {r.source for r in found} == {RETIRED}
    both = {(r.q, r.id): r["rank"] for r in ranking}
    assert all(both[r.q, r.id] == r["rank"] for r in found)
    answers = ask.ask(index.withColumn("title", F.col("title")), asked, "2026-08-01").collect()
    assert {r.q for r in answers} == {"q1", "q2"}
    stats = archive.archive_stats(chunks).first()
    assert (stats.total_passages, stats.by_source[RETIRED], stats.documents_per_source[RETIRED]) == (5, 3, 2)
    manifest = spark.read.json(f"{root}/v1/manifest")
    assert evaluate.built_date(manifest, 5).first().built == "2026-03-05" and evaluate.built_date(manifest, 4).first().built is None
    index_row = archive.site_index(spark, f"{root}/live/_index.json")
    kinds = "built string, total_chunks long, chunks_by_source map<string,long>"
    whole = archive.status(index_row, spark.read.schema(kinds).json(f"{root}/v1/manifest"), archive.state(spark, f"{root}/state.json"), archive.count_lines(spark, f"{root}/chunks.jsonl")).first()
    assert (whole.documents, whole.media, whole.captured, whole.chunks, whole.pending_ids, whole.last_applied) == (2, 1, "2026-03-03", 5, ["7"], "2026-03-02")
    empty = archive.status(index_row.limit(0), spark.createDataFrame([], kinds), archive.state(spark, f"{root}/broken.json"), archive.count_lines(spark, f"{root}/chunks.jsonl")).first()
    assert (empty.documents, empty.chunks, empty.pending_ids) == (None, 2, [])


def test_a_chunk_without_a_vector_ranks_last(spark):
    chunks = spark.createDataFrame([("a", "cat", None, 1.0), ("b", "dog", [0.0, 1.0], 1.0), ("c", "cow", [1.0, 0.0], 1.0)], "id string, text string, vector array<double>, weight double")
    asked = spark.createDataFrame([(1, "cat", [1.0, 0.0])], "q int, text string, vector array<double>")
    assert {r.id: (r.rank_dense, r.rank_bm25) for r in retrieval.hybrid(chunks, asked).collect()} == {"a": (3, 1), "b": (2, 2), "c": (1, 3)}
    assert retrieval.hybrid(chunks.limit(0), asked).count() == 0 == retrieval.hybrid(chunks, asked.limit(0)).count()


def test_sinks(spark, tree):
    root, put = tree
    chunks = built(spark, root)
    sinks.write_corpus(chunks, f"{root}/out")
    lines = [json.loads(x) for x in "".join((p.read_text() for p in sorted((root / "out").glob("part-*")))).splitlines()]
    assert [x["chunk_id"] for x in lines][:2] == ["old:contact:0", "old:fees:0"] and len(lines) == 5
    for version in ("one", "two"):
        put(f"next/{version}.txt", version)
        sinks.publish(spark, f"{root}/next", f"{root}/now")
    assert (root / "now/two.txt").exists() and (root / "now.previous/one.txt").exists() and not (root / "next").exists()
    with pytest.raises(FileNotFoundError):
        sinks.publish(spark, f"{root}/next", f"{root}/now")
    put("next/x", "x")
    assert sinks.discard(spark, f"{root}/next") and not sinks.discard(spark, f"{root}/next")


def test_refresh_stage_and_apply(spark, tree):
    root, _ = tree
    records = spark.createDataFrame([(1, "a", "Fee RM 10"), (2, "b", "Call 03-2118 6200")], "id int, slug string, text string")
    fetched = spark.createDataFrame([(1, "a", "Fee RM 20")], records.schema)
    none = spark.createDataFrame([], "slug string, status string")
    rebuild = lambda rows: corpus.build(rows.select("slug", F.lit(LIVE).alias("source"), F.col("slug").alias("title"), F.lit("u").alias("url"), F.col("slug").alias("doc_path"), "text"), none)
    text_of = lambda c: diff.doc_text(c.select("doc_path", "ord", "text"))
    old = rebuild(records)
    report = refresh.stage(old, records, fetched, rebuild, text_of(old), text_of, f"{root}/staged", embed, "2026-03-05")
    assert [(r.doc_path, r.kind, r.lost, r.gained) for r in report.collect()] == [("a", "money", ["RM 10"], ["RM 20"])]
    snap = lambda rows: spark.createDataFrame(rows, "id int, title string, modified string")
    after = refresh.apply(spark, f"{root}/staged", f"{root}/current", snap([(1, "a", "x"), (2, "b", "x")]), snap([(1, "a", "y"), (2, "b", "y")]), spark.createDataFrame([(1,)], "id int"))
    assert {(r.id, r.modified) for r in after.collect()} == {(1, "y"), (2, "x")}
    assert sinks.read_index(spark, f"{root}/current/index").count() == spark.read.parquet(f"{root}/current/corpus").count() == 2
    assert [r.id for r in diff.pending_titles(spark.createDataFrame([(2,)], "id int"), snap([(1, "a", "x"), (2, "b", "x")])).collect()] == [2]
    with pytest.raises(refresh.Busy):
        refresh.run(lambda: refresh.run(lambda: None))
    ready = lambda *rows: evaluate.readiness(spark.createDataFrame([*rows], "name string, ok boolean")).first().ready
    assert ready(("corpus", True), ("index", True), ("privacy", False)) and not ready(("corpus", True), ("index", False))


class Recorded:
    """A site in a dict: address (without the query's fields) to reply."""

    def __init__(self, pages):
        self.pages, self.asked = pages, []

    def __call__(self, url, headers):
        self.asked.append(url)
        found = self.pages.get(url.split("&_fields")[0].replace("per_page=100&", ""))
        return (200, {}, json.dumps(found).encode()) if found is not None else (404, {}, b"")


def test_capture_of_a_recorded_site(spark, tmp_path):
    page = {"id": 7, "link": "https://s.org/en/clinics/", "slug": "clinics", "date": "2026-01-01T00:00:00", "modified": "2026-02-02T00:00:00", "title": {"rendered": "Clinics &amp; more"}, "content": {"rendered": '<h2>Hours</h2><p>Open <a href="/a.pdf">list</a></p>'}, "topics": [1], "categories": [], "audiences": []}
    post = {**page, "id": 9, "link": "https://s.org/en/news/", "slug": "news", "content": {"rendered": "<p>New desk</p>"}}
    empty = {**page, "id": 10, "content": {"rendered": ""}}
    api = "https://s.org/api"
    site = Recorded({f"{api}/types": {"post": {"rest_base": "posts"}, "page": {"rest_base": "pages"}, "attachment": {"rest_base": "media"}, "x": {"rest_base": "(?P<id>)"}}, f"{api}/pages?page=1": [page, empty], f"{api}/posts?page=1": [post], f"{api}/topics?page=1": [{"id": 1, "name": "Health"}], f"{api}/media?page=1": [{"id": 3, "source_url": "https://s.org/up/a.pdf", "mime_type": "application/pdf", "title": {"rendered": "A"}, "media_details": {"filesize": 9}}]})
    polite = rest.Polite(site, lambda url: True, sleep=lambda s: None, now=lambda: 0.0)
    counts = refresh.capture(spark, rest.Site(polite, api, "/en/"), f"{tmp_path}/a", "s.org", lambda: [], spark.createDataFrame([], "slug string, status string"), embed, "2026-03-03").first()
    assert (counts.documents, counts.media, counts.chunks) == (2, 1, 3)
    assert (tmp_path / "a/live/pages/clinics/index.md").read_text().startswith("# Clinics & more\n\n## Hours") and (tmp_path / "a/live/pages/clinics/page.html").exists()
    assert (tmp_path / "a/live/announcements/2026-01-01-news.md").exists()
    index = archive.site_index(spark, f"{tmp_path}/a/live/_index.json").first()
    assert [(r.id, r.word_count, r.links["file"]) for r in index.records] == [(7, 8, ["/a.pdf"]), (9, 6, [])] and index.media[0].file == "a.pdf"
    assert sinks.read_index(spark, f"{tmp_path}/a/current/index").count() == 3
    before, _ = refresh.check(archive.state(spark, f"{tmp_path}/a/state").select(F.explode("baseline").alias("id", "b")).select("id", "b.title", "b.modified"), spark.createDataFrame([("7", "Clinics", "2026-02-02"), ("9", "n", "2026-05-05"), ("10", "e", "2026-02-02")], "id string, title string, modified string"))
    assert [(r.id, r.change) for r in before.collect()] == [("9", "changed")]
    with pytest.raises(RuntimeError):
        refresh.capture(spark, rest.Site(rest.Polite(Recorded({f"{api}/types": {}}), lambda url: True, sleep=lambda s: None), api, "/en/"), f"{tmp_path}/b", "s.org", lambda: [], spark.createDataFrame([], "slug string, status string"), embed, "2026-03-03")


def test_site_tables(spark):
    terms = spark.createDataFrame([("topics", 2, "B"), ("topics", 1, "A"), ("tags", 1, "T")], "taxonomy string, id long, name string")
    assert {r.taxonomy: r.names for r in rest.taxonomy(terms).collect()} == {"topics": {"1": "A", "2": "B"}, "tags": {"1": "T"}}
    items = spark.createDataFrame([(1, "p", "page", "T", "u", "2026-01-01T10:00", "2025-01-01T10:00", "<p>")] * 2 + [(2, "q", "page", "T", "u", "2026-01-01", None, "")], "id int, path string, type string, title string, url string, modified string, date string, html string")
    assert {(r.id, r.modified, r.published) for r in rest.snapshot(items).collect()} == {(1, "2026-01-01", "2025-01-01"), (2, "2026-01-01", None)} and rest.with_content(items).count() == 2


def test_paged_source_reads_recorded_pages(spark, tmp_path):
    for number, rows in ((1, [{"id": k, "title": {"rendered": f"t{k}"}} for k in range(3)]), (2, [{"id": 3, "title": None}])):
        (tmp_path / f"page-{number}.json").write_text(json.dumps(rows))
    spark.dataSource.register(rest.PagedSource)
    table = spark.read.format("rest_pages").schema("id string, title string").option("url", f"file://{tmp_path}/page-{{page}}.json").option("per_page", "3").load()
    assert [(r.id, r.title) for r in table.collect()] == [("0", '{"rendered": "t0"}'), ("1", '{"rendered": "t1"}'), ("2", '{"rendered": "t2"}'), ("3", None)]


def test_robots_and_transport(tmp_path):
    rules = lambda status, body: rest.Robots(lambda url, headers: (status, {}, body), "https://s.org", "bot")
    strict = rules(200, b"User-agent: *\nDisallow: /private\nCrawl-delay: 5")
    assert strict.allowed("https://s.org/a") and not strict.allowed("https://s.org/private/x") and strict.delay == 5.0
    assert rules(404, b"").allowed("https://s.org/private") and rules(404, b"").delay is None
    with pytest.raises(rest.Refused):
        rest.Polite(None, rules(503, b"").allowed).get("https://s.org/")
    (tmp_path / "x").write_bytes(b"body")
    assert rest.transport("bot")(f"file://{tmp_path}/x", {})[2] == b"body"
    with pytest.raises(rest.Refused):
        rest.Polite(lambda u, h: (200, {}, b""), lambda u: True, budget=0).get("https://s.org/")


def zipped(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, data in names.items():
            z.writestr(n, data)
    return out.getvalue()


def test_bundle_download_and_unpack(spark, tmp_path):
    good = zipped({"live/_index.json": "{}", "old/a/index.md": "# A"})
    target = tmp_path / "b.zip"
    digest = bundle.download("https://s.org/b.zip", target, lambda url: io.BytesIO(good))
    assert sorted(bundle.unpack_to(target, tmp_path / "out")) == ["live/_index.json", "old/a/index.md"] and (tmp_path / "out/old/a/index.md").read_text() == "# A"
    for url, data, wanted, limit in (("http://s.org", good, None, 1 << 20), ("https://s.org", good, "0" * 64, 1 << 20), ("https://s.org", good, digest, 10), ("https://s.org", b"<html>", None, 1 << 20)):
        with pytest.raises(bundle.Unsafe):
            bundle.download(url, tmp_path / "bad", lambda u, data=data: io.BytesIO(data), wanted, limit)
        assert not (tmp_path / "bad").exists()
    for names in ({"../x/index.md": "x"}, {"readme.txt": "x"}, {"a/index.md": "0" * 3_000_000}):
        target.write_bytes(zipped(names) if "readme.txt" in names or "../x/index.md" in names else good[:4])
        if "a/index.md" in names:
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("a/index.md", names["a/index.md"])
        with pytest.raises(bundle.Unsafe):
            bundle.unpack_to(target, tmp_path / "no")
        assert not (tmp_path / "no").exists()
    linked = tmp_path / "l.tar"
    with tarfile.open(linked, "w") as t:
        entry = tarfile.TarInfo("a/index.md")
        entry.type, entry.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(entry)
    with pytest.raises(bundle.Unsafe):
        bundle.unpack_to(linked, tmp_path / "no")
    files = spark.createDataFrame([("old/a", 2), ("old/b", 3), ("x", 1)], "path string, bytes int")
    assert {(r.part, r.files, r.bytes) for r in bundle.coverage(files).collect()} == {("old", 2, 5), (".", 1, 1)}
    assert [r.ok for r in spark.createDataFrame([("a/b",), ("/a",), ("a/../b",)], "n string").select(bundle.safe_member(F.col("n")).alias("ok")).collect()] == [True, False, False]


def test_ingest_takes_each_file_once(spark, tmp_path):
    schema = spark.createDataFrame([], "doc_id long, text string").schema
    for k in (1, 2):
        spark.createDataFrame([(k, f"# T{k}\n\n## A\nbody")], schema).write.parquet(f"{tmp_path}/in/{k}")
        ingest.ingest(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out/epoch=*")
    assert sorted((r.doc_id, r.chunk_index) for r in found.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_one_retry_on_a_reply_in_another_script(spark):
    prompts = spark.createDataFrame([(1, "hello there", "latin", None), (2, "hi", "latin", None), (3, "x", "unknown", None)], "q int, question string, language string, directive string")

    def generate(rows):
        calls.append(rows.count())
        second = F.when(F.col("q") == 1, "english now").otherwise("опять")
        return rows.withColumn("answer", F.when(F.col("directive").isNotNull(), second).otherwise(F.when(F.col("q") < 3, "привет").otherwise("x")))

    calls = []
    got = {r.q: (r.answer, r.lang_drift) for r in ask._one_retry(generate, prompts).collect()}
    assert got == {1: ("english now", False), 2: ("привет", True), 3: ("x", False)} and calls == [3, 2]
    rules = spark.createDataFrame([(True,), (False,)], "m boolean").select(ask.system_prompt(["a", "b"], F.col("m"), "mirror", "plain").alias("p"))
    assert [r.p for r in rules.collect()] == ["a\nb\nmirror", "a\nb\nplain"]


def test_better_rewrites_replace_results(spark):
    chunks = spark.createDataFrame([(k, f"word{k} text.", v, 1.0, LIVE, "current", "T", None, "u", "p", None, None, None) for k, v in ((1, [1.0, 0.0]), (2, [0.0, 1.0]))], "id int, text string, vector array<double>, weight double, source string, status string, title string, section string, url string, doc_path string, citation string, source_document string, review_by string")
    kind = "array<struct<role:string,text:string>>"
    asked = spark.createDataFrame([(1, "and?", [0.6, 0.6], [("user", "about word1")])], f"q int, text string, vector array<double>, history {kind}")
    embedder = lambda rows: rows.drop("vector").withColumn("vector", F.when(F.contains("text", F.lit("word1")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.6), F.lit(0.6))))
    rewrite = lambda rows: rows.select("q", F.lit("Question: word1 text").alias("reply"))
    got = ask.ask(chunks, asked, "2026-08-01", embed=embedder, condense=rewrite).first()
    assert not got.refused and got.answer.startswith("word1 text.")
    assert corpus.PREFIX[PARTNER] == "partner"
