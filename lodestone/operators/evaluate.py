"""Retrieval quality against a gold set, and the regression gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import TOP_K
from lodestone.functions.text import eval_hay, eval_norm, token_estimate
from lodestone.operators.retrieval import MAX_QUERIES
from lodestone.sources.scratch import stored

#: Pairs that a broadcast copy may have.
FEW = 200_000


def holding(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(q, id)``, stored: the chunks that hold the fact of ``gold(q, fact,
    kind)``; marked for broadcasting while they are few.

    Texts are normalised once each; facts are compared with all of them, from a
    broadcast copy while they are few.
    """
    forms = gold.select("q", "kind", eval_norm(F.col("fact"), F.col("kind")).alias("form"))
    forms = F.broadcast(forms) if gold.limit(MAX_QUERIES + 1).count() <= MAX_QUERIES else forms
    hay = chunks.select("id", eval_hay(F.col("text"), F.lit("phone")).alias("phone"), eval_hay(F.col("text"), F.lit("text")).alias("words"))
    holds = hay.join(forms, F.contains(F.when(F.col("kind") == "phone", F.col("phone")).otherwise(F.col("words")), F.col("form"))).select("q", "id")
    found = stored(holds.distinct(), "holds")
    return F.broadcast(found) if found.limit(FEW + 1).count() <= FEW else found


def gold_ranks(gold: DataFrame, ranking: DataFrame, chunks: DataFrame | None, k: int = TOP_K, holds: DataFrame | None = None) -> DataFrame:
    """Per ``gold(q, fact, kind)`` the first rank, by each method, of
    a chunk that holds the fact (``holding``, if already known), and whether it is
    among the best ``k``."""
    holds = holding(gold, chunks) if holds is None else holds
    first = ranking.join(holds, ["q", "id"]).groupBy("q").agg(*(F.min(r).alias(n) for r, n in (("rank", "rank_fused"), ("rank_dense", "rank_dense"), ("rank_bm25", "rank_bm25"))))
    return gold.join(first, "q", "left").withColumn("hit", F.coalesce(F.col("rank_fused") <= k, F.lit(False)))


def prompt_sizes(shown: DataFrame) -> DataFrame:
    """Estimated prompt tokens per question of ``shown(q, text)``."""
    return shown.groupBy("q").agg(F.sum(F.length("text")).alias("chars")).withColumn("tokens", token_estimate(F.col("chars")))


def summary(cases: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row with cases, hits, recall, mean and largest prompt."""
    return cases.select("q", "hit").join(sizes, "q", "left").agg(F.count("*").alias("cases"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("int")).alias("recall_at_k"), F.bround(F.avg("tokens"), 0).cast("long").alias("prompt_tokens_mean"), F.max("tokens").alias("prompt_tokens_max"))


def regressions(cases: DataFrame, baseline: DataFrame, moved: int = 3) -> DataFrame:
    """Per question ``regressed`` (found before, not now: the gate fails)
    and ``moved`` (its rank changed by three or more: for information)."""
    was = baseline.select("q", F.col("hit").alias("was_hit"), F.col("rank_fused").alias("was_rank"))
    both = cases.join(was, "q").withColumn("regressed", F.col("was_hit") & ~F.col("hit"))
    return both.withColumn("moved", F.coalesce(F.abs(F.col("rank_fused") - F.col("was_rank")) >= moved, F.lit(False))).select("q", "hit", "was_hit", "rank_fused", "was_rank", "regressed", "moved")


def ready(corpus: DataFrame, index: DataFrame) -> DataFrame:
    """an index is ready if it has as many rows as the corpus."""
    a, b = corpus.agg(F.count("*").alias("corpus_rows")), index.agg(F.count("*").alias("index_rows"))
    return a.crossJoin(b).withColumn("ready", F.col("corpus_rows") == F.col("index_rows"))  # one row each


def readiness(rows: DataFrame) -> DataFrame:
    """all of ``rows(name, ok)`` that can block are in order."""
    blocking = rows.where(F.col("name").isin("corpus", "index", "embedder", "answerer"))
    return blocking.agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ready"))


def built_date(manifest: DataFrame, corpus_rows: int) -> DataFrame:
    """the build date, quoted only if the manifest's count is the corpus's."""
    return manifest.select(F.when(F.col("total_chunks") == corpus_rows, F.col("built")).alias("built"))
