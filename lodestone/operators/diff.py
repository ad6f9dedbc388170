"""What changed between two captures: snapshots, corpora, upserts."""

from __future__ import annotations

import difflib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.facts import CRITICAL, critical


def snapshot_diff(baseline: DataFrame, live: DataFrame) -> DataFrame:
    """``(id, title, change)`` with change ``added``, ``removed`` or
    ``changed`` (another ``modified``). Against an empty baseline everything is
    new to it; ``plans.refresh.check`` records a first capture silently."""
    old, new = (d.select("id", F.col("title").alias(f"{p}_title"), F.col("modified").alias(f"{p}_modified"), F.lit(True).alias(p)) for d, p in ((baseline, "old"), (live, "new")))
    both = old.join(new, "id", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old_modified").eqNullSafe(F.col("new_modified")), "changed")
    return both.select("id", F.coalesce("new_title", "old_title").alias("title"), change.alias("change")).where("change is not null")


def pending(diff: DataFrame) -> DataFrame:
    """U4: ids to fetch again, sorted: what was added or changed."""
    return diff.where(F.col("change").isin("added", "changed")).select("id").distinct().orderBy("id")


def pending_titles(ids: DataFrame, live: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` pending ids with their titles."""
    return live.join(ids, "id", "left_semi").select("id", "title").orderBy("id").limit(n)


def upsert(existing: DataFrame, updated: DataFrame, key: str = "id") -> DataFrame:
    """Updated rows replace those of the same key; all others stay."""
    return existing.join(updated.select(key), key, "left_anti").unionByName(updated, allowMissingColumns=True)


def doc_text(chunks: DataFrame) -> DataFrame:
    """A10: ``(doc_path, text)``, chunks joined by line breaks in file order."""
    parts = F.sort_array(F.collect_list(F.struct("ord", "text")))
    return chunks.groupBy("doc_path").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def critical_sets(docs: DataFrame) -> DataFrame:
    """``(doc_path, kind, facts)``, facts sorted and distinct."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), critical(F.col("text"), k).alias("facts")) for k in CRITICAL))
    return docs.select("doc_path", F.explode(kinds).alias("x")).select("doc_path", "x.kind", "x.facts")


def critical_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(doc_path, kind, change, lost, gained)`` where a critical fact
    came or went; change is ``new``, ``lost`` or ``edited`` of the document."""
    a, b = (critical_sets(d).withColumnRenamed("facts", n).withColumn(f"in_{n}", F.lit(True)) for d, n in ((old, "was"), (new, "now")))
    none = F.array().cast("array<string>")
    both = a.join(b, ["doc_path", "kind"], "full_outer").withColumn("was", F.coalesce("was", none)).withColumn("now", F.coalesce("now", none))
    out = both.select("doc_path", "kind", F.when(F.col("in_was").isNull(), "new").when(F.col("in_now").isNull(), "lost").otherwise("edited").alias("change"), F.sort_array(F.array_except("was", "now")).alias("lost"), F.sort_array(F.array_except("now", "was")).alias("gained"))
    return out.where((F.size("lost") > 0) | (F.size("gained") > 0))


def doc_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents ``(doc_path, text)`` that came, went or were edited."""
    both = old.withColumnRenamed("text", "was").join(new.withColumnRenamed("text", "now"), "doc_path", "full_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "lost").when(F.col("was") != F.col("now"), "edited")
    return both.select("doc_path", change.alias("change")).where("change is not null")


def text_diff(old: DataFrame, new: DataFrame, lines: int = 40) -> DataFrame:
    """The first ``lines`` of a unified diff of each edited document. Only
    documents whose digests differ reach the comparison, in Arrow batches."""

    @F.arrow_udf("string")
    def unified(was: pa.Array, now: pa.Array) -> pa.Array:
        each = (difflib.unified_diff((a.as_py() or "").splitlines(), (b.as_py() or "").splitlines(), lineterm="", n=0) for a, b in zip(was, now))
        return pa.array(["\n".join(itertools.islice(d, lines)) for d in each], pa.string())

    digest = lambda d, text: d.select("doc_path", F.col("text").alias(text), F.sha2("text", 256).alias(f"{text}_sha"))
    both = digest(old, "was").join(digest(new, "now"), "doc_path").where("was_sha <> now_sha")
    return both.select("doc_path", unified("was", "now").alias("diff"))
