"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, embedding_dedup, exact_dedup, line_dedup, packing, pii, quality, simhash, suffix_dedup, toxicity
from lodestone.llm.common import load, spread


def tokenizer_path() -> str:
    """The public tokenizer's file, present on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spread(load(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines removed, and the digest of the text left."""
    done = line_dedup.dedup_lines(spread(load(spark, sf_dir, "documents").select("doc_id", "text")))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(load(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spread(load(spark, sf_dir, "embeddings")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(spread(load(spark, sf_dir, "documents")), tokenizer_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents"))
    return toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spread(load(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(spread(load(spark, sf_dir, "documents")))
    return found.select("doc_id", *(f"n_{k}" for k in pii.BASE), F.sha2("base", 256).alias("base_sha256"), "spans", "scores")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents"))
    return quality.score(docs, quality.fit(docs, load(spark, sf_dir, "labels")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(load(spark, sf_dir, "documents")), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_line_dedup, op3_exact_dedup, op4_embedding_dedup, op5_bpe, op6_toxicity, op7_simhash, op8_pii, op9_quality, op10_packing)
}

_EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
SQL: dict[str, str] = {
    # The runs that line_dedup's docstring defines, with its default lengths.
    "op2_line_dedup": rf"""
with raw as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as line_no
  from documents),
cores as (
  select *, regexp_replace(line, '{_EDGE}', '', 'g') as core from raw),
numbered as (
  select doc_id, line_no, core, len(string_split_regex(core, '[\x20\x09-\x0D]+')) as words,
         row_number() over (partition by doc_id order by line_no) - 1 as k
  from cores where core <> ''),
lines as materialized (
  select *, sum(words) over (partition by doc_id order by k) as upto from numbered),
ends as (
  select a.doc_id, a.k, a.line_no, b.k as e, b.line_no as e_line
  from lines a join lines b on a.doc_id = b.doc_id and b.k >= a.k
   and b.upto >= a.upto - a.words + {line_dedup.GRAM} and b.upto - b.words < a.upto - a.words + {line_dedup.GRAM}),
grams as materialized (
  select e.doc_id, e.k, e.e, e.line_no, e.e_line, md5(string_agg(l.core, chr(10) order by l.k)) as gram
  from ends e join lines l on e.doc_id = l.doc_id and l.k between e.k and e.e group by all),
windows as (
  select a.doc_id, a.k, b.k as e
  from lines a join lines b on a.doc_id = b.doc_id and b.k >= a.k
   and b.upto >= a.upto - a.words + {line_dedup.WINDOW} and b.upto - b.words < a.upto - a.words + {line_dedup.WINDOW}
  union all
  select doc_id, 0, max(k) from lines group by doc_id having sum(words) < {line_dedup.WINDOW}),
selected as (
  select distinct g.* from (
    select g.doc_id, g.k, row_number() over (partition by w.doc_id, w.k order by g.gram, g.k desc) as n
    from windows w join grams g on w.doc_id = g.doc_id and g.k >= w.k and g.e <= w.e) best
  join grams g on best.doc_id = g.doc_id and best.k = g.k where best.n = 1),
places as (
  select s.*, coalesce(lag(s.k) over around, 0) as lo, coalesce(lead(s.k) over around, t.stop) as hi
  from selected s join (select doc_id, max(k) as stop from lines group by doc_id) t on s.doc_id = t.doc_id
  window around as (partition by s.doc_id order by s.k)),
matches as materialized (
  select p.*, f.doc_id as f_id, f.k as f_k, f.e as f_e, f.lo as f_lo, f.hi as f_hi
  from places p join (select * from places qualify row_number() over (partition by gram order by doc_id, k) = 1) f
    on p.gram = f.gram and (p.doc_id, p.k) > (f.doc_id, f.k)),
back as (
  select m.doc_id, m.k, coalesce(min(l.at) filter (where good), m.k) as from_k from (
    select m.doc_id, m.k, l.k as at, bool_and(l.core = coalesce(o.core, '')) over (partition by m.doc_id, m.k order by l.k desc) as good
    from matches m join lines l on m.doc_id = l.doc_id and l.k between m.lo and m.k - 1
    left join lines o on o.doc_id = m.f_id and o.k = m.f_k - (m.k - l.k) and o.k >= m.f_lo) l
  right join matches m on m.doc_id = l.doc_id and m.k = l.k group by m.doc_id, m.k),
ahead as (
  select m.doc_id, m.k, coalesce(max(l.at) filter (where good), m.e) as to_k from (
    select m.doc_id, m.k, l.k as at, bool_and(l.core = coalesce(o.core, '')) over (partition by m.doc_id, m.k order by l.k) as good
    from matches m join lines l on m.doc_id = l.doc_id and l.k between m.e + 1 and m.hi
    left join lines o on o.doc_id = m.f_id and o.k = m.f_e + (l.k - m.e) and o.k <= m.f_hi) l
  right join matches m on m.doc_id = l.doc_id and m.k = l.k group by m.doc_id, m.k, m.e),
runs as (
  select b.doc_id, x.line_no as from_line, y.line_no as to_line
  from back b join ahead a on b.doc_id = a.doc_id and b.k = a.k
  join lines x on x.doc_id = b.doc_id and x.k = b.from_k join lines y on y.doc_id = b.doc_id and y.k = a.to_k),
gone as (
  select distinct c.doc_id, c.line_no from cores c join runs r on c.doc_id = r.doc_id and c.line_no between r.from_line and r.to_line)
select c.doc_id, count(*) filter (where c.core <> '') as n_lines, count(*) filter (where c.core <> '' and g.line_no is not null) as n_removed,
       sha256(coalesce(string_agg(c.line, chr(10) order by c.line_no) filter (where g.line_no is null), '')) as kept_sha256
from cores c left join gone g on c.doc_id = g.doc_id and c.line_no = g.line_no group by c.doc_id""",
    "op3_exact_dedup": r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from n""",
}
