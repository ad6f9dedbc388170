"""Registered queries: each operator over the whole of its test table.

``documents`` stand for chunks (or, where chunking is the point, documents);
the number in ``source`` gives the role, ``labels`` the gap status;
``embeddings`` hold the vectors of chunks and questions of the same id;
``benchmark`` the questions and gold facts; ``conversations`` the histories.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import LIVE, PARTNER, RETIRED
from lodestone.functions import facts, markup
from lodestone.functions import text as tx
from lodestone.operators import chunking, corpus, diff, evaluate, retrieval, verify
from lodestone.plans import ask as ask_plan
from lodestone.sources.scratch import spread, stored

TODAY = "2026-08-10"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(table) if name in ("documents", "pages") else table


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, text, lang, title, source)`` of all documents."""
    number = F.regexp_extract("source", "(\\d+)$", 1).cast("int") % 3
    role = F.when(number == 0, LIVE).when(number == 1, RETIRED).otherwise(PARTNER)
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("title"), role.alias("source"))


def _weighed(spark: SparkSession, sf: str, texts: DataFrame) -> DataFrame:
    """``texts`` with their status and weight."""
    gap = _table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "superseded").when(F.col("quality") == 0, "dropped").otherwise("kept").alias("gap"))
    status = F.when(F.col("gap") == "superseded", "superseded").when(F.col("source") == RETIRED, F.coalesce("gap", F.lit("unmapped"))).otherwise("current")
    return texts.join(gap, "id", "left").withColumn("status", status).drop("gap").withColumn("weight", corpus.currency_weight(F.col("source"), F.col("status")))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, text, lang, title, source, status, weight)`` of all documents."""
    return _weighed(spark, sf, _texts(spark, sf))


def _vectors(spark: SparkSession, sf: str, chunks: DataFrame) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return chunks.join(vectors, "id", "left")


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf, _chunks(spark, sf))


def _late(spark: SparkSession, sf: str, more: Callable[[DataFrame], DataFrame] = lambda d: d) -> retrieval.Late | None:
    """How labels and vectors come to the texts, if no id has two of them: else
    the joins say how many chunks there are."""
    for name, key in (("labels", "doc_id"), ("embeddings", "vec_id")):
        if not _table(spark, sf, name).where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
            return None
    return _texts(spark, sf), lambda d: more(_vectors(spark, sf, _weighed(spark, sf, d)))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))
    return _table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), "text").join(vectors, "q")


# --- text and facts -------------------------------------------------------


@query
def tokenize_tf(spark, sf):
    return retrieval.postings(_chunks(spark, sf))


@query
def word_count(spark, sf):
    d = _table(spark, sf, "documents")
    return d.select("doc_id", tx.word_count(F.col("text")).alias("words"), tx.compact_length(F.col("text")).alias("compact"))


@query
def token_estimate(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", tx.token_estimate(F.length("text")).alias("tokens"))


@query
def text_sha256(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query
def script_bucket(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", tx.script(F.col("text")).alias("script"))


def _joined(name: str, pick):
    def run(spark, sf):
        return _table(spark, sf, "documents").select("doc_id", F.array_join(pick(F.col("text")), "|").alias("found"))

    run.__name__ = name
    return query(run)


extract_email = _joined("extract_email", lambda t: facts.find_all(t, facts.EMAIL))
extract_phone = _joined("extract_phone", facts.phones)
extract_money = _joined("extract_money", lambda t: facts.find_all(t, facts.MONEY))
extract_dates = _joined("extract_dates", lambda t: facts.find_all(t, facts.DATE))


@query
def date_key(spark, sf):
    """Over the days of all orders, in four spellings."""
    day = F.col("o_orderdate")
    spelled = F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "d/M/yyyy"), F.date_format(day, "d MMMM yyyy"), F.date_format(day, "MMMM d, yyyy"), F.date_format(day, "MMM yyyy"))
    d = _table(spark, sf, "orders").select("o_orderkey", F.posexplode(spelled).alias("form", "value"))
    return d.select("o_orderkey", "form", facts.date_key(F.col("value")).alias("key"))


@query
def fact_antijoin(spark, sf):
    """Facts of each document that the next one lacks; the last has no next."""
    d = _table(spark, sf, "documents").select("doc_id", "text")
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("hay"))
    both = d.join(after, "doc_id", "left").withColumn("hay", F.coalesce("hay", F.lit("")))
    found = facts.unverified(F.col("text"), F.col("hay"))
    phones = F.filter(found, lambda f: f["kind"] == "phone")
    return both.select("doc_id", F.size(found).alias("n_facts"), F.array_join(F.transform(phones, lambda f: f["value"]), "|").alias("phones"))


# --- chunking and corpus --------------------------------------------------


@query
def split_sections(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.split_sections(F.col("text"))).alias("part_no", "s"))
    return d.select("doc_id", "part_no", "s.heading", F.sha2("s.text", 256).alias("sha"))


@query
def chunk_greedy(spark, sf):
    d = chunking.chunk_docs(_table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", "chunk_index", "section_heading", "word_count", F.sha2("text", 256).alias("sha"))


@query
def chunk_overlap(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.sha2(chunking.tail(F.col("text")), 256).alias("sha"))


def _slugged(spark, sf):
    c = _chunks(spark, sf)
    return c.select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("slug"), "source", "title", F.concat(F.lit("https://example.org/"), F.col("id").cast("string")).alias("url"), "text", F.array("lang", "title").alias("topics"))


def _gap(spark, sf):
    label = _table(spark, sf, "labels")
    return label.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("slug"), F.when(F.col("quality") == 0, "dropped").otherwise("kept").alias("status"), F.col("toxic").alias("pos"))


@query
def gap_lookup(spark, sf):
    return corpus.with_gap_status(_slugged(spark, sf), corpus.gap_dimension(_gap(spark, sf))).select("slug", "source", "status")


@query
def corpus_build(spark, sf):
    c = corpus.build(_slugged(spark, sf), corpus.gap_dimension(_gap(spark, sf)))
    return c.select("chunk_id", "source", "status", "currency_note", "word_count", F.sha2("text", 256).alias("sha"))


@query
def corpus_union(spark, sf):
    d = _chunks(spark, sf).select("id", "source", "status")
    live = _chunks(spark, sf).where(F.col("source") == LIVE).select("id", "source", F.col("title").alias("doc_type"))
    return corpus.union_producers(d, live)


_RULES = [(0, "ting the", "rule a"), (1, "the", "rule b"), (2, "DE LA", "rule c")]


@query
def supersede_first_rule(spark, sf):
    rules = spark.createDataFrame(_RULES, "ord int, match string, reason string")
    c = corpus.supersede(_chunks(spark, sf).withColumn("currency_note", F.lit("-")), rules)
    return c.select("id", "source", "status", "currency_note")


@query
def manifest_by_source(spark, sf):
    return corpus.manifest_by_source(_chunks(spark, sf))


@query
def topics_explode(spark, sf):
    c = _chunks(spark, sf).select(F.col("id").alias("ord"), F.array("lang", "title").alias("topics"))
    return corpus.topics(c)


@query
def currency_weight(spark, sf):
    return _chunks(spark, sf).select("id", "source", "status", "weight", corpus.is_current(F.col("source"), F.col("status")).alias("is_current"))


@query
def embed_text(spark, sf):
    heading = F.when(F.col("lang") != "en", F.col("lang"))
    return _chunks(spark, sf).select("id", F.sha2(corpus.embed_text(F.col("title"), heading, F.col("text")), 256).alias("sha"), F.sha2(corpus.bm25_text(F.col("title"), heading, F.col("text")), 256).alias("sha_bm25"))


# --- retrieval ------------------------------------------------------------


@query
def doc_len_avg(spark, sf):
    return retrieval.corpus_stats(retrieval.doc_lengths(_chunks(spark, sf))).select("n", F.round("avg_len", 6).alias("avg_len"))


@query
def bm25_idf(spark, sf):
    c = _chunks(spark, sf)
    t = retrieval.term_stats(retrieval.postings(c), retrieval.corpus_stats(retrieval.doc_lengths(c)))
    return t.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk(spark, sf):
    asked = _table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), "text")
    late = _late(spark, sf)  # else an id with two labels is two chunks
    r = retrieval.bm25_top(late[0] if late else _chunks(spark, sf), asked, 8)
    return r.select("q", "id", "rank", F.round("bm25", 5).alias("bm25"))


@query
def dense_topk(spark, sf):
    r = retrieval.best(retrieval.dense(_indexed(spark, sf), _questions(spark, sf)), "raw", 8)
    return r.select("q", "id", "rank", F.round("raw", 6).alias("raw"))


@query
def vocab_coverage(spark, sf):
    c = retrieval.coverage(_questions(spark, sf), retrieval.postings(_indexed(spark, sf)))
    return c.select("q", F.round("coverage", 8).alias("coverage"), F.round("w_sparse", 8).alias("w_sparse"))


def _ranking(spark, sf):
    return retrieval.hybrid(_indexed(spark, sf), _questions(spark, sf), _late(spark, sf))


@query
def rrf_fusion(spark, sf):
    return _ranking(spark, sf).select("q", "id", "rank_dense", "rank_bm25", F.round("fused", 8).alias("fused"))


@query
def minmax_score(spark, sf):
    return _ranking(spark, sf).select("q", "id", "rank", F.round("score", 6).alias("score"))


def _top(spark, sf, choice=None):
    return retrieval.hybrid_top(_indexed(spark, sf), _questions(spark, sf), choice=choice, late=_late(spark, sf)).select("q", "id", "position", "rank", "source", "score", "raw")


@query
def hybrid_topk(spark, sf):
    return _top(spark, sf)


@query
def hybrid_topk_live(spark, sf):
    return _top(spark, sf, "new")


@query
def hybrid_topk_retired(spark, sf):
    return _top(spark, sf, "old")


@query
def refusal_gate(spark, sf):
    return retrieval.refusal_gate(_questions(spark, sf), _top(spark, sf))


# --- evaluation -----------------------------------------------------------


def _gold(spark, sf):
    return _table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("fact"), F.lit("text").alias("kind"))


def _cases(spark, sf):
    return evaluate.gold_ranks(_gold(spark, sf), _ranking(spark, sf), _texts(spark, sf))


@query
def gold_rank(spark, sf):
    """Rank 0 where no chunk holds the fact."""
    return _cases(spark, sf).select("q", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("rank_fused", "rank_dense", "rank_bm25")), "hit")


@query
def recall_at_k(spark, sf):
    """Of one ranking, what gives the cases and the prompts is stored."""
    gold = _gold(spark, sf)
    holds = evaluate.holding(gold, _texts(spark, sf))
    marked = _ranking(spark, sf).join(holds.withColumn("held", F.lit(True)), ["q", "id"], "left")
    ranking = stored(marked.where(F.col("held") | (F.col("rank") <= 8)), "ranking")
    shown = ranking.where(F.col("rank") <= 8).select("q", "id")
    shown = shown.join(retrieval.only(shown, _chunks(spark, sf), _late(spark, sf)).select("id", "text"), "id")
    s = evaluate.summary(evaluate.gold_ranks(gold, ranking, None, holds=holds), evaluate.prompt_sizes(shown))
    return s.withColumn("recall_at_k", F.round("recall_at_k", 8))


@query
def eval_regressions(spark, sf):
    """Against a run in which every question was found at rank 4."""
    now = stored(_cases(spark, sf), "cases")
    was = now.select("q", F.lit(True).alias("hit"), F.lit(4).alias("rank_fused"))
    return evaluate.regressions(now, was).withColumn("rank_fused", F.coalesce("rank_fused", F.lit(0)))


# --- conversations --------------------------------------------------------


def _histories(spark, sf):
    c = _table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "bot").otherwise(F.col("role")).alias("role"), "text")
    return c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda h: F.struct(h["role"].alias("role"), h["text"].alias("text"))).alias("history"))


@query
def history_tail(spark, sf):
    h = _histories(spark, sf).select("conv_id", ask_plan.clean_history(F.col("history")).alias("h"))
    return h.select("conv_id", F.size("h").alias("n"), F.array_join(F.transform("h", lambda x: F.concat_ws(":", x["role"], x["text"])), "|").alias("turns"))


@query
def condense_prompt(spark, sf):
    return _histories(spark, sf).select("conv_id", ask_plan.condense_prompt(F.col("history")).alias("prompt"))


@query
def condense_trigger(spark, sf):
    h = _histories(spark, sf)
    last = F.element_at("history", -1)["text"]
    before = F.slice("history", 1, F.size("history") - 1)
    return h.select("conv_id", ask_plan.should_condense(before, F.lit(0.7), last).alias("condense"))


@query
def doc_concat(spark, sf):
    c = _table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_path"), F.col("turn").alias("ord"), "text")
    return diff.doc_text(c)


# --- changes --------------------------------------------------------------


def _captures(spark, sf):
    """Two captures of the pages: in the second all ids are three higher."""
    p = _table(spark, sf, "pages")
    was = p.select(F.col("page_id").alias("id"), F.col("url").alias("title"), F.length("html").alias("modified"))
    return was, was.withColumn("id", F.col("id") + 3)


@query
def snapshot_diff(spark, sf):
    return diff.snapshot_diff(*_captures(spark, sf))


@query
def pending_ids(spark, sf):
    return diff.pending(diff.snapshot_diff(*_captures(spark, sf)))


@query
def index_upsert(spark, sf):
    was, now = _captures(spark, sf)
    return diff.upsert(was, now)


def _versions(spark, sf):
    d = _table(spark, sf, "documents").select(F.col("doc_id").alias("doc_path"), "text")
    return d, d.select((F.col("doc_path") + 2).alias("doc_path"), F.translate("text", "1", "2").alias("text"))


@query
def critical_sets(spark, sf):
    return diff.critical_sets(_versions(spark, sf)[0]).select("doc_path", "kind", F.array_join("facts", "|").alias("facts"))


@query
def critical_diff(spark, sf):
    return diff.critical_diff(*_versions(spark, sf)).select("doc_path", "kind", "change", F.array_join("lost", "|").alias("lost"), F.array_join("gained", "|").alias("gained"))


@query
def doc_changes(spark, sf):
    return diff.doc_changes(*_versions(spark, sf))


@query
def text_diff(spark, sf):
    return diff.text_diff(*_versions(spark, sf))


# --- markup ---------------------------------------------------------------


@query
def link_buckets(spark, sf):
    p = _table(spark, sf, "pages").select("page_id", F.explode(markup.hrefs(F.col("html"))).alias("href"))
    return p.distinct().groupBy("page_id", markup.link_bucket(F.col("href"), "example.org").alias("bucket")).agg(F.array_join(F.sort_array(F.collect_list("href")), "|").alias("hrefs"))


@query
def strip_tags(spark, sf):
    return _table(spark, sf, "pages").select("page_id", F.sha2(markup.strip_tags(F.col("html")), 256).alias("sha"))


@query
def url_path(spark, sf):
    return _table(spark, sf, "pages").select("page_id", markup.url_path(F.col("url"), "//").alias("path"))


@query
def html_to_markdown(spark, sf):
    return _table(spark, sf, "pages").select("page_id", markup.to_markdown("html", "url").alias("markdown"))


@query
def plain_text(spark, sf):
    return _table(spark, sf, "pages").select("page_id", markup.plain(markup.to_markdown("html", "url")).alias("plain"))


# --- answers --------------------------------------------------------------


def _drafts(spark, sf):
    """Drafts made of the benchmark items: real tags, invented ones, mangled
    ones, an unknown address, and what the item says."""
    found = ask_plan.retrieve(_evidence(spark, sf), _questions(spark, sf), late=_late(spark, sf, _as_evidence))
    draft = F.concat(F.lit("### [S1]\nPlease register [S1, S9] here: https://nowhere.example/x. [SD2] [REMEMBER] "), F.col("text"))
    return stored(found.select(F.col("q").alias("answer_id"), draft.alias("answer"), F.col("text").alias("question"), "top_raw", F.lit(False).alias("lang_drift"), "results"), "drafts")


def _evidence(spark, sf):
    return _as_evidence(_indexed(spark, sf)).drop("lang")


def _as_evidence(chunks):
    none = F.lit(None).cast("string")
    more = {"section": none, "url": F.concat(F.lit("https://example.org/"), F.col("id").cast("string")), "doc_path": F.col("id").cast("string"), "citation": none, "source_document": none, "review_by": none}
    return chunks.withColumns(more)


@query
def cited_tags(spark, sf):
    return _drafts(spark, sf).select("answer_id", F.array_join(verify.cited(F.col("answer")), "|").alias("tags"))


@query
def repair_tags(spark, sf):
    return _drafts(spark, sf).select("answer_id", verify.repair_tags(F.col("answer"), F.size("results")).alias("answer"))


@query
def copied_ratio(spark, sf):
    d = _drafts(spark, sf)
    return d.select("answer_id", F.round(verify.copied_share(F.col("answer"), verify.render(F.col("results"))), 8).alias("share"))


@query
def outage_flag(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.concat("text", F.when(F.col("lang") == "de", " Temporarily CLOSED").otherwise("")).rlike(verify.OUTAGE).alias("outage"))


@query
def verify_answers(spark, sf):
    v = verify.verify(_drafts(spark, sf), TODAY)
    return v.select("answer_id", "answer", F.size("sources").alias("n_sources"), F.array_join(F.transform("warnings", lambda w: w["code"]), "|").alias("warnings"), F.size("unverified").alias("n_unverified"), "note")


@query
def ask(spark, sf):
    """The whole pipeline, with the generator that needs no model."""
    a = ask_plan.ask(_evidence(spark, sf), _questions(spark, sf), TODAY)
    return a.select("q", "answer", "refused", F.array_join(F.transform("warnings", lambda w: w["code"]), "|").alias("warnings"))


@query
def sources_by_title(spark, sf):
    top = _top(spark, sf).join(_evidence(spark, sf).select("id", "title", "citation"), "id")
    s = top.select(F.col("q").alias("answer_id"), F.col("position").alias("tag_no"), "title", "citation", F.lit("https://example.org").alias("url"))
    return verify.sources_by_title(s)
