"""Readers of an archive tree (S1 to S5, S14, S15, S17) and its schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.config import LIVE, PARTNER, RETIRED
from lodestone.operators.corpus import resolve_names

CHUNK = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("chunk_id", "source", "doc_title", "doc_path", "url", "status", "currency_note", "section_heading", "text", "doc_type", "provided_by", "received", "citation", "source_document", "review_by", "review_reason")]
    + [T.StructField(n, T.IntegerType()) for n in ("chunk_index", "word_count")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("topics", "categories", "audiences")]
)
RECORD = "struct<id:long,type:string,title:string,url:string,path:string,file:string,published:string,modified:string,parent:long,topics:array<long>,categories:array<long>,audiences:array<long>,word_count:int,text_sha256:string,links:map<string,array<string>>>"
INDEX = f"source string, captured string, taxonomy map<string,map<string,string>>, records array<{RECORD}>, media array<struct<id:long,file:string,mime:string,title:string,url:string,bytes:long>>"
PARTNER_MANIFEST = "records array<struct<file:string,title:string,url:string,review_by:string,review_reason:string>>, supersedes array<struct<match:string,reason:string>>, authority string, provided_by string, occasion string, received string, citation string, source_document string"
STATE = "baseline map<string,struct<path:string,type:string,title:string,url:string,modified:string,published:string>>, captured string, pending struct<ids:array<string>,detected:string>, history array<string>"


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document as one row under a schema; what is broken is null.

    Spark's readers pass over names that begin with ``_``, as the index's does;
    such a file is read by the driver.
    """
    if not path.rstrip("/").rsplit("/", 1)[-1].startswith("_"):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return spark.createDataFrame([(text,)], "text string").select(F.from_json("text", schema).alias("d")).select("d.*")


def site_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of a site's copy, one row."""
    return document(spark, path, INDEX)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Corpus JSON lines under a fixed schema; blank lines are no rows."""
    return spark.read.schema(CHUNK).json(path)


def _files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    texts = spark.read.text(folder, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return texts.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def title_of(text: Column, slug: Column) -> Column:
    """The first ``# `` line, else the slug."""
    return F.coalesce(F.nullif(F.regexp_extract(text, "(?m)^# (.+)", 1), F.lit("")), slug)


def source_url(text: Column, slug: Column, site: str) -> Column:
    """What ``Source:`` names, else an address made from the slug."""
    return F.coalesce(F.nullif(F.regexp_extract(text, "Source: (https://\\S+)", 1), F.lit("")), F.concat(F.lit(site.rstrip("/") + "/"), slug, F.lit("/")))


def retired_docs(spark: SparkSession, folder: str, site: str) -> DataFrame:
    """One document for each ``*/index.md``."""
    slug = F.element_at(F.split("file_path", "/"), -2)
    return _files(spark, folder, "index.md").select(slug.alias("slug"), F.lit(RETIRED).alias("source"), title_of(F.col("text"), slug).alias("title"), source_url(F.col("text"), slug, site).alias("url"), F.col("file_path").alias("doc_path"), "text").orderBy("doc_path")


def live_docs(spark: SparkSession, index_path: str, folder: str) -> DataFrame:
    """Records whose file is there, taxonomy ids as names; an empty
    list of names becomes null, as it is left out of the corpus."""
    index = site_index(spark, index_path)
    records = index.select("taxonomy", F.explode("records").alias("r"))
    named = records.select("r.*", *(F.nullif(resolve_names(F.col(f"r.{t}"), F.col("taxonomy")[t]), F.array().cast("array<string>")).alias(f"{t}_names") for t in ("topics", "categories", "audiences")))
    files = _files(spark, folder, "*.md").withColumn("key", F.regexp_replace("file_path", "^.*?/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", ""))
    out = named.join(files, named["file"] == files["key"])
    slug = F.coalesce(F.nullif("path", F.lit("")), F.lit("_home"))
    return out.select(slug.alias("slug"), F.lit(LIVE).alias("source"), "title", "url", F.col("file").alias("doc_path"), F.col("type").alias("doc_type"), "modified", F.col("topics_names").alias("topics"), F.col("categories_names").alias("categories"), F.col("audiences_names").alias("audiences"), "text")


def partner_docs(spark: SparkSession, manifest_path: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents that the manifest lists, and those whose file is missing."""
    manifest = document(spark, manifest_path, PARTNER_MANIFEST)
    listed = manifest.select(F.explode("records").alias("r"), "provided_by", "received", "citation", "source_document")
    files = _files(spark, folder, "*").withColumn("key", F.element_at(F.split("file_path", "/"), -1))
    key = F.element_at(F.split(F.col("r.file"), "/"), -1)
    found = listed.join(files, key == F.col("key"))
    docs = found.select(F.regexp_replace("key", "\\.[^.]*$", "").alias("slug"), F.lit(PARTNER).alias("source"), F.col("r.title").alias("title"), F.col("r.url").alias("url"), F.col("r.file").alias("doc_path"), "provided_by", "received", "citation", "source_document", F.col("r.review_by").alias("review_by"), F.col("r.review_reason").alias("review_reason"), "text")
    return docs, listed.join(files, key == F.col("key"), "left_anti").select(F.col("r.file").alias("file"))


def supersession_rules(spark: SparkSession, manifest_path: str) -> DataFrame:
    manifest = document(spark, manifest_path, PARTNER_MANIFEST)
    return manifest.select(F.posexplode("supersedes").alias("ord", "s")).select("ord", "s.match", "s.reason")


def gap_items(spark: SparkSession, path: str) -> DataFrame:
    """``(slug, status, pos)``."""
    items = document(spark, path, "items array<struct<old_slug:string,status:string>>")
    return items.select(F.posexplode("items").alias("pos", "i")).select(F.col("i.old_slug").alias("slug"), "i.status", "pos")


def state(spark: SparkSession, path: str) -> DataFrame:
    """The refresh state; a broken file gives an empty one."""
    read = document(spark, path, STATE)
    return read.select(F.coalesce("baseline", F.create_map().cast("map<string,struct<path:string,type:string,title:string,url:string,modified:string,published:string>>")).alias("baseline"), "captured", "pending", F.coalesce("history", F.array().cast("array<string>")).alias("history"))


def seed_baseline(records: DataFrame) -> DataFrame:
    """A first baseline from an existing index."""
    return records.select("id", "path", "type", "title", "url", "modified", "published")


def eval_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Saved cases of an evaluation."""
    cases = document(spark, path, "cases array<struct<q:string,fact:string,kind:string,hit:boolean,rank_fused:int,rank_dense:int,rank_bm25:int>>")
    return cases.select(F.explode("cases").alias("c")).select("c.*")


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row with the number of lines that are not blank."""
    return spark.read.text(path).agg(F.count_if(F.col("value").rlike("(?U)\\S")).alias("lines"))


def archive_stats(chunks: DataFrame) -> DataFrame:
    """One row: passages in all and by source, and the documents of each source."""
    each = chunks.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("title").alias("titles"))
    counts = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", c))))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_passages"), counts("n").alias("by_source"), counts("titles").alias("documents_per_source"))


def status(index: DataFrame, manifest: DataFrame, refresh_state: DataFrame, corpus_lines: DataFrame) -> DataFrame:
    """One row about an archive from summaries of one row each, any of which
    may be empty. The counted lines stand in where there is no manifest."""
    documents = index.select(F.size("records").alias("documents"), F.size("media").alias("media"), F.col("captured").alias("index_captured"))
    built = manifest.select("built", "total_chunks", F.col("chunks_by_source").alias("by_source"))
    state_ = refresh_state.select(F.col("captured").alias("state_captured"), F.coalesce("pending.ids", F.array().cast("array<string>")).alias("pending_ids"), F.col("pending.detected").alias("pending_detected"), F.get("history", F.size("history") - 1).alias("last_applied"))
    one = corpus_lines
    for part in (documents, built, state_):
        one = one.join(part.limit(1), F.lit(True), "left")
    return one.select("documents", "media", F.coalesce("index_captured", "state_captured").alias("captured"), "built", F.coalesce("total_chunks", "lines").alias("chunks"), "by_source", "pending_ids", "pending_detected", "last_applied")
