"""The question pipeline: retrieve, gate, condense, generate, verify.

The embedder and the generator are given; the defaults need no model: vectors
come with the questions, and answers are put together from the best sources.
Questions are rows, and each decision is a column, so any number run at once.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import MIN_SCORE, SHORT_QUESTION, TOP_K, WEAK_SCORE
from lodestone.functions.text import collapse, compact_length, last_entries, script, strip
from lodestone.operators.retrieval import Late, hybrid_top, only
from lodestone.operators.verify import REFUSAL, verify
from lodestone.sources.scratch import stored

SCRIPT_LANGUAGE = {"latin": "en", "myanmar": "my", "cjk": "zh"}


class Embedder(Protocol):
    def __call__(self, questions: DataFrame) -> DataFrame:
        """``questions(q, text)`` with a column ``vector``."""


class Generator(Protocol):
    def __call__(self, prompts: DataFrame) -> DataFrame:
        """``prompts(q, question, results, language, directive)`` with a column
        ``answer``; the directive is null but for a second try."""


def extractive(prompts: DataFrame) -> DataFrame:
    """A generator without a model: the first sentence of each of three sources."""
    lead = F.transform(F.slice("results", 1, 3), lambda r, i: F.concat(F.regexp_extract(r["text"], "(?s)^(.{1,300}?[.!?](?=\\s|$)|.{1,300})", 1), F.lit(" [S"), (i + 1).cast("string"), F.lit("]")))
    return prompts.withColumn("answer", F.array_join(lead, "\n"))


def clean_history(history: Column, n: int = 6, limit: int = 1000) -> Column:
    """P20: the last turns of known roles, trimmed and cut, blanks dropped."""
    kept = F.filter(last_entries(history, n), lambda h: h["role"].isin("user", "bot"))
    cut = F.transform(kept, lambda h: F.struct(h["role"].alias("role"), F.left(strip(F.coalesce(h["text"], F.lit(""))), F.lit(limit)).alias("text")))
    return F.filter(cut, lambda h: h["text"] != "")


def condense_prompt(history: Column, n: int = 4, limit: int = 300) -> Column:
    """The last turns on one line each, long ones cut with dots."""
    line = lambda t: F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("..."))).otherwise(t)
    return F.array_join(F.transform(last_entries(history, n), lambda h: F.concat(h["role"], F.lit(": "), line(strip(collapse(h["text"]))))), "\n")


def condensed(reply: Column, limit: int = 300) -> Column:
    """First line with text, without label and quotes; null if unusable."""
    first = F.get(F.filter(F.transform(F.split(reply, "\n"), strip), lambda x: x != ""), F.lit(0))
    bare = strip(F.regexp_replace(F.regexp_replace(first, "(?i)^(?:standalone |rewritten )?question:\\s*", ""), "^[\"'“”]+|[\"'“”]+$", ""))
    return F.when((F.length(bare) > 0) & (F.length(bare) <= limit), bare)


def should_condense(history: Column, top_raw: Column, question: Column) -> Column:
    """F3."""
    return (F.size(F.coalesce(history, F.array().cast("array<struct<role:string,text:string>>"))) > 0) & ((top_raw < WEAK_SCORE) | (compact_length(question) < SHORT_QUESTION))


def route(condense: Column, top_raw: Column) -> Column:
    """F10, F2."""
    return F.when(condense, "condense").when(top_raw < MIN_SCORE, "refuse").otherwise("generate")


def reply_language(question: Column, can: DataFrame | list[str]) -> tuple[Column, Column]:
    """The script to reply in, and whether it is a downgrade because the
    model cannot write the language of the question; unknown ones pass."""
    languages = can if isinstance(can, list) else [r[0] for r in can.select("language").distinct().limit(1000).collect()]
    asked = script(question)
    lang = F.element_at(F.create_map(*(F.lit(x) for kv in SCRIPT_LANGUAGE.items() for x in kv)), asked)
    down = lang.isNotNull() & ~F.coalesce(lang.isin(*languages), F.lit(False))
    return F.when(down, "latin").otherwise(asked), down


def needs_retry(answer: Column, wanted: Column) -> Column:
    """The reply is in another script than wanted."""
    got = script(answer)
    return (got != wanted) & (got != "unknown") & (wanted != "unknown")


def _one_retry(generate: Generator, prompts: DataFrame) -> DataFrame:
    """Answers in another script than wanted are asked for once more, with a
    directive; the second one counts if it is in the script, else the first one
    with ``lang_drift``. Only drifting rows reach the generator again."""
    first = stored(generate(prompts), "drafts")
    drift = F.coalesce(needs_retry(F.col("answer"), F.col("language")), F.lit(False))
    bad = first.where(drift)
    if bad.isEmpty():
        return first.withColumn("lang_drift", F.lit(False))
    asked = bad.drop("answer").withColumn("directive", F.concat(F.lit("Write the whole reply in this script: "), "language"))
    again = generate(asked).where(script(F.col("answer")) == F.col("language")).select("q", F.col("answer").alias("__again"))
    both = first.join(again, "q", "left")
    return both.withColumn("lang_drift", drift & F.col("__again").isNull()).withColumn("answer", F.coalesce("__again", "answer")).drop("__again")


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = TOP_K, choice: str | None = None, late: Late | None = None) -> DataFrame:
    """``questions`` with ``results`` (an array in tag order) and ``top_raw``;
    ``late`` as in ``retrieval``."""
    best = hybrid_top(chunks, questions, k, choice, late)
    if late is not None:  # read twice
        best = stored(best, "best")
    best = best.join(only(best, chunks, late).drop("source", "vector", "weight"), "id")
    found = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("position", "id", "title", "section", "url", "source", "status", "text", "doc_path", "score", "raw", "citation", "source_document", "review_by"))).alias("results"))
    joined = questions.join(found, "q", "left")
    return joined.withColumn("results", F.coalesce("results", F.array().cast(dict(found.dtypes)["results"]))).withColumn("top_raw", F.coalesce(F.array_max(F.transform("results", lambda r: r["raw"])), F.lit(0.0)))


def ask(chunks: DataFrame, questions: DataFrame, today: str, *, embed: Embedder | None = None, generate: Generator = extractive, condense: Callable[[DataFrame], DataFrame] | None = None, can: list[str] | None = None, k: int = TOP_K, choice: str | None = None) -> DataFrame:
    """Answers to ``questions(q, text[, vector, history])``.

    ``condense`` gets the questions that need their history and returns ``(q,
    reply)``; a rewrite counts only if it retrieves strictly better (F4). Gated
    questions are split off before the generator (F2), so that a model is
    never called for them.
    """
    asked = questions if embed is None else embed(questions)
    if "history" not in asked.columns:
        asked = asked.withColumn("history", F.array().cast("array<struct<role:string,text:string>>"))
    state = retrieve(chunks, asked.withColumn("history", clean_history(F.col("history"))), k, choice)
    if condense is not None:
        need = state.where(should_condense(F.col("history"), F.col("top_raw"), F.col("text")))
        rewritten = condense(need.withColumn("prompt", condense_prompt(F.col("history")))).select("q", condensed(F.col("reply")).alias("text")).where("text is not null")
        fresh = rewritten.join(asked.drop("text"), "q")
        again = retrieve(chunks, fresh if embed is None else embed(fresh), k, choice).select("q", F.col("results").alias("results2"), F.col("top_raw").alias("top2"))
        better = F.coalesce(F.col("top2") > F.col("top_raw"), F.lit(False))
        state = state.join(again, "q", "left").withColumn("results", F.when(better, F.col("results2")).otherwise(F.col("results"))).withColumn("top_raw", F.when(better, F.col("top2")).otherwise(F.col("top_raw"))).drop("results2", "top2")
    language, downgraded = reply_language(F.col("text"), can or list(SCRIPT_LANGUAGE.values()))
    state = state.withColumn("language", language).withColumn("downgraded", downgraded)
    open_, refused = state.where(F.col("top_raw") >= MIN_SCORE), state.where(F.col("top_raw") < MIN_SCORE)
    drafted = _one_retry(generate, open_.withColumn("question", F.col("text")).withColumn("directive", F.lit(None).cast("string")))
    checked = verify(drafted.select(F.col("q").alias("answer_id"), "answer", "question", "top_raw", "lang_drift", "results"), today)
    done = checked.withColumnRenamed("answer_id", "q").withColumn("refused", F.lit(False))
    none = refused.select("q", F.lit(REFUSAL).alias("answer"), F.lit(True).alias("refused"))
    return done.unionByName(none, allowMissingColumns=True)


def system_prompt(rules: list[str], mirror: Column, mirror_rule: str, plain_rule: str) -> Column:
    """The rules, with one language rule by what the model can write."""
    return F.concat_ws("\n", *(F.lit(r) for r in rules), F.when(mirror, F.lit(mirror_rule)).otherwise(F.lit(plain_rule)))
