"""SQL oracles of the registered queries, written for DuckDB.

They state the semantics a second time and share nothing with the operators.
Left out are queries whose rows come from callback replacements, markup
parsing, or folds that SQL cannot state briefly; ``tests/`` compares those with
plain Python.
"""

from __future__ import annotations

TOKEN = "[a-z0-9က-႟]+"
MONTH = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
DATE = rf"(?i)\d{{4}}-\d{{2}}-\d{{2}}|\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b|\b\d{{1,2}}\s+(?:{MONTH})\.?,?\s+\d{{4}}\b|\b(?:{MONTH})\.?\s+\d{{1,2}},?\s+\d{{4}}\b|\b(?:{MONTH})\.?\s+\d{{4}}\b"
PHONE = r"\+?\d[\d\x{00A0} (). -]{5,}\d"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]*[\p{L}\p{N}_]"
NUMBER = "cast(regexp_extract(d.source, '(\\d+)$', 1) as int) % 3"

CHUNKS = f"""
chunks as (
  select *, case when status = 'superseded' then 0.60 when source <> 'retired' then 1.0
                 when status = 'kept' then 0.88 when status = 'dropped' then 1.0 else 0.90 end as weight
  from (
    select id, text, lang, title, source,
           case when toxic = 1 then 'superseded' when source <> 'retired' then 'current'
                when quality is null then 'unmapped' when quality = 0 then 'dropped' else 'kept' end as status
    from (
      select d.doc_id as id, d.text, d.lang, d.source as title, l.quality, l.toxic,
             case {NUMBER} when 0 then 'live' when 1 then 'retired' else 'partner' end as source
      from documents d left join labels l on d.doc_id = l.doc_id)))"""

INDEXED = "indexed as (select c.*, cast(e.embedding as double[]) as vector from chunks c left join embeddings e on c.id = e.vec_id)"
QUESTIONS = "questions as (select b.item_id as q, b.text, cast(e.embedding as double[]) as vector from benchmark b join embeddings e on b.item_id = e.vec_id)"


def bm25(chunks: str, questions: str) -> str:
    """CTEs ending in ``bm(q, id, bm25)``."""
    return f"""
tok as (select id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) as term from {chunks}),
post as (select id, term, count(*) as tf from tok group by all),
len as (select id, len(regexp_extract_all(lower(text), '{TOKEN}')) as n from {chunks}),
stat as (select count(*) as n, avg(n) as avg_len from len),
raw as (select term, count(*) as df, ln((select n from stat) - count(*) + 0.5) - ln(count(*) + 0.5) as r from post group by term),
idf as (select term, df, case when r < 0 then 0.25 * (select avg(r) from raw) else r end as idf from raw),
asked as (select q, unnest(regexp_extract_all(lower(text), '{TOKEN}')) as term from {questions}),
bm as (
  select a.q, p.id, round(sum(i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.n / s.avg_len))), 10) as bm25
  from asked a join post p using (term) join idf i using (term) join len l on p.id = l.id cross join stat s group by all)"""


RANKING = f"""
with {CHUNKS}, {INDEXED}, {QUESTIONS}, {bm25("indexed", "questions")},
pairs as (
  select q.q, c.id, c.source, c.text, c.weight, coalesce(b.bm25, 0) as bm25,
         round(list_inner_product(q.vector, c.vector) / (sqrt(list_inner_product(q.vector, q.vector)) * sqrt(list_inner_product(c.vector, c.vector))), 10) as raw
  from questions q cross join indexed c left join bm b on b.q = q.q and b.id = c.id),
cover as (
  select q.q, avg(case when a.term is null then null when i.term is null then 0.0 else 1.0 end) as coverage
  from questions q left join asked a on a.q = q.q left join idf i on i.term = a.term group by q.q),
placed as (
  select p.*, case when coverage is null then 0.5 else 1 - (0.5 + 0.5 * (1 - coverage)) end as w,
         row_number() over (partition by p.q order by raw desc nulls last, id) as rank_dense,
         row_number() over (partition by p.q order by bm25 desc, id) as rank_bm25
  from pairs p join cover on p.q = cover.q),
fused as (select *, (1 - w) / (60 + rank_dense) + w / (60 + rank_bm25) as fused from placed),
scaled as (
  select *, round(case when max(fused) over k - min(fused) over k < 1e-9 then 0
                       else (fused - min(fused) over k) / (max(fused) over k - min(fused) over k) end * weight, 10) as score
  from fused window k as (partition by q)),
ranking as (select *, row_number() over (partition by q order by score desc, id) as rank from scaled)"""


def top(test: str = "true") -> str:
    return f"""{RANKING},
best as (select *, row_number() over (partition by q order by rank) as position from ranking where {test} qualify position <= 8)"""


COLUMNS = "select q, id, position, rank, source, round(score, 4) as score, round(raw, 4) as raw from best"
CASES = """cases as (
  select b.item_id as q, min(rank) as rank_fused, min(rank_dense) as rank_dense, min(rank_bm25) as rank_bm25, coalesce(min(rank) <= 8, false) as hit
  from benchmark b left join ranking r on r.q = b.item_id
    and contains(lower(regexp_replace(r.text, '\\s+', ' ', 'g')), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))) group by 1)"""
HISTORY = "h as (select conv_id, turn, case role when 'assistant' then 'bot' else role end as role, text, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as back from conversations)"


def _found(pattern: str) -> str:
    return f"select doc_id, array_to_string(regexp_extract_all(text, '{pattern}'), '|') as found from documents"


CRITICAL = {"phone": r"(?:\+?6?0)\d[\d\s\-]{6,12}\d", "money": r"\bRM\s?\d[\d,]*(?:\.\d{2})?", "email": r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+"}


def _critical(table: str) -> str:
    parts = [f"select doc_path, '{k}' as kind, list_sort(list_distinct(list_transform(regexp_extract_all(text, '{p}'), lambda x: trim(x, ' ' || chr(10) || chr(9))))) as facts from {table}" for k, p in CRITICAL.items()]
    return " union all ".join(parts)


VERSIONS = "was as (select doc_id as doc_path, text from documents), later as (select doc_id + 2 as doc_path, replace(text, '1', '2') as text from documents)"
CAPTURES = "was as (select page_id as id, url as title, length(html) as modified from pages), later as (select page_id + 3 as id, url as title, length(html) as modified from pages)"
SNAPSHOT = """changes as (
  select coalesce(n.id, o.id) as id, coalesce(n.title, o.title) as title,
         case when o.id is null then 'added' when n.id is null then 'removed' when o.modified is distinct from n.modified then 'changed' end as change
  from was o full join later n on o.id = n.id)"""
DRAFT = "'### [S1]' || chr(10) || 'Please register [S1, S9] here: https://nowhere.example/x. [SD2] [REMEMBER] ' || b.text"


def _words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> ''))"


def _packs(name: str, items: str, overlap: int) -> str:
    """CTEs that number the packs of ``items(doc_id, part_no, grp, k, t, n)``, one
    item after another, as ``{name}(doc_id, part_no, grp, k, t, n, pack)``."""
    return f"""
{name}_at as (
  select doc_id, part_no, grp, k, n, n as held, 0 as pack from {items} where k = 1
  union all
  select i.doc_id, i.part_no, i.grp, i.k, i.n,
         case when a.held + i.n > 220 then least(a.n, {overlap}) + i.n else a.held + i.n end,
         case when a.held + i.n > 220 then a.pack + 1 else a.pack end
  from {name}_at a join {items} i on i.doc_id = a.doc_id and i.part_no = a.part_no and i.grp = a.grp and i.k = a.k + 1),
{name} as (select i.*, a.pack from {items} i join {name}_at a using (doc_id, part_no, grp, k))"""


#: CTEs ending in ``cut(doc_id, chunk_index, heading, text)``.
CHUNKED = f"""
cutup as (select doc_id, string_split(replace(text, chr(10) || '## ', chr(1) || '## '), chr(1)) as parts from documents),
sections as (
  select doc_id, part_no, regexp_replace(part, '^\\s+|\\s+$', '', 'g') as part
  from (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as part_no from cutup)),
blocks as (
  select doc_id, part_no, bk, b, {_words("b")} as n from (
    select doc_id, part_no, unnest(string_split(part, chr(10) || chr(10))) as b, generate_subscripts(string_split(part, chr(10) || chr(10)), 1) as bk
    from sections where {_words("part")} > 220)),
sentences as (
  select doc_id, part_no, grp, k, t, {_words("t")} as n from (
    select doc_id, part_no, bk as grp, unnest(marked) as t, generate_subscripts(marked, 1) as k
    from (select *, string_split(regexp_replace(b, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as marked
          from blocks where n > 220 and not regexp_matches(b, '^\\s*\\|')))),
{_packs("said", "sentences", 0)},
items as materialized (
  select doc_id, part_no, 0 as grp, row_number() over (partition by doc_id, part_no order by bk, sub) as k, t, {_words("t")} as n from (
    select doc_id, part_no, bk, 0 as sub, b as t from blocks where n <= 220 or regexp_matches(b, '^\\s*\\|')
    union all
    select doc_id, part_no, grp, pack, string_agg(t, ' ' order by k) from said group by doc_id, part_no, grp, pack)),
{_packs("packed", "items", 30)},
tails as (
  select doc_id, part_no, pack + 1 as pack, case when len(w) > 30 then array_to_string(w[len(w) - 29 : len(w)], ' ') else t end as tail
  from (select *, list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '') as w from packed
        qualify row_number() over (partition by doc_id, part_no, pack order by k desc) = 1)),
made as (
  select doc_id, part_no, 0 as pack, part as text from sections where {_words("part")} <= 220
  union all
  select p.doc_id, p.part_no, p.pack, coalesce(any_value(tails.tail) || chr(10) || chr(10), '') || string_agg(p.t, chr(10) || chr(10) order by p.k)
  from packed p left join tails on tails.doc_id = p.doc_id and tails.part_no = p.part_no and tails.pack = p.pack group by p.doc_id, p.part_no, p.pack),
cut as (
  select m.doc_id, row_number() over (partition by m.doc_id order by m.part_no, m.pack) - 1 as chunk_index,
         nullif(regexp_extract(s.part, '^## (.+)', 1), '') as heading, m.text
  from made m join sections s using (doc_id, part_no) where regexp_matches(m.text, '\\S'))"""
LETTERS = "regexp_extract_all(text, '\\p{L}')"

MONEY = r"(?i)(?:RM|MYR)\s?\d[\d,]*(?:\.\d{1,2})?"


def _digits(v: str) -> str:
    return f"regexp_replace(translate({v}, '၀၁၂၃၄၅၆၇၈၉', '0123456789'), '\\D', '', 'g')"


def _loose(v: str) -> str:
    return f"lower(regexp_replace(translate({v}, '၀၁၂၃၄၅၆၇၈၉', '0123456789'), '[\\s,\\x{{00A0}}]', '', 'g'))"


def _date_key(v: str) -> str:
    part = lambda pattern, k: f"regexp_extract({v}, '(?i)^(?:{pattern})$', {k})"
    month = lambda name: f"list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(left({name}, 3)))"
    two = lambda n: f"lpad(cast(cast({n} as int) as varchar), 2, '0')"
    slash, dmy = r"(\d{1,2})/(\d{1,2})/(\d{2,4})", rf"(\d{{1,2}})\s+({MONTH})\.?,?\s+(\d{{4}})"
    mdy, my = rf"({MONTH})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})", rf"({MONTH})\.?\s+(\d{{4}})"
    year = f"cast({part(slash, 3)} as int)"
    return f"""case when regexp_full_match({v}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then {v}
      when {part(slash, 1)} <> '' then cast(case when {year} < 100 then {year} + 2000 else {year} end as varchar) || '-' || {two(part(slash, 2))} || '-' || {two(part(slash, 1))}
      when {part(dmy, 1)} <> '' then {part(dmy, 3)} || '-' || {two(month(part(dmy, 2)))} || '-' || {two(part(dmy, 1))}
      when {part(mdy, 1)} <> '' then {part(mdy, 3)} || '-' || {two(month(part(mdy, 1)))} || '-' || {two(part(mdy, 2))}
      when {part(my, 1)} <> '' then {part(my, 2)} || '-' || {two(month(part(my, 1)))} end"""


#: Each kind of fact is looked for in what the kinds before it left.
FACTS = f"""
t1 as (select doc_id, text, regexp_replace(text, '{EMAIL}', ' ', 'g') as r from documents),
t2 as (select *, regexp_replace(r, '{MONEY}', ' ', 'g') as r2 from t1),
t3 as (select *, regexp_replace(r2, '{DATE}', ' ', 'g') as r3 from t2),
named as (
  select doc_id, 1 as o, 'email' as kind, unnest(regexp_extract_all(text, '{EMAIL}')) as v, generate_subscripts(regexp_extract_all(text, '{EMAIL}'), 1) as k from t1
  union all select doc_id, 2, 'amount', unnest(regexp_extract_all(r, '{MONEY}')), generate_subscripts(regexp_extract_all(r, '{MONEY}'), 1) from t2
  union all select doc_id, 3, 'date', unnest(regexp_extract_all(r2, '{DATE}')), generate_subscripts(regexp_extract_all(r2, '{DATE}'), 1) from t3
  union all select doc_id, 4, 'phone', unnest(regexp_extract_all(r3, '{PHONE}')), generate_subscripts(regexp_extract_all(r3, '{PHONE}'), 1) from t3),
facts as (
  select doc_id, o, k, kind, v, {_digits("v")} as d, {_loose("v")} as l, {_date_key("v")} as canon
  from (select * replace (regexp_replace(v, '^\\s+|\\s+$', '', 'g') as v) from named)
  where kind <> 'phone' or length({_digits("v")}) between 7 and 15),
hay as (
  select a.doc_id, {_loose("coalesce(b.text, '')")} as l, {_digits("coalesce(b.text, '')")} as d,
         list_filter(list_transform(regexp_extract_all(coalesce(b.text, ''), '{DATE}'), lambda x: {_date_key("x")}), lambda x: x is not null) as days
  from documents a left join documents b on b.doc_id = a.doc_id + 1)"""

SQL: dict[str, str] = {
    "tokenize_tf": f"with t as (select doc_id as id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) as term from documents) select id, term, count(*) as tf from t group by all",
    "word_count": "select doc_id, cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as int) as words, cast(length(regexp_replace(text, '\\s+', '', 'g')) as int) as compact from documents",
    "token_estimate": "select doc_id, cast(round_even(length(text) / 3.6, 0) as bigint) as tokens from documents",
    "text_sha256": "select doc_id, sha256(text) as sha from documents",
    "script_bucket": f"""
with n as (
  select doc_id, len({LETTERS}) as n, len(list_filter({LETTERS}, lambda c: unicode(c) < 592)) as latin,
         len(list_filter({LETTERS}, lambda c: unicode(c) between 4096 and 4255)) as myanmar,
         len(list_filter({LETTERS}, lambda c: unicode(c) between 12288 and 40959 or unicode(c) between 44032 and 55215)) as cjk from documents)
select doc_id, case when n = 0 then 'unknown' when latin = greatest(latin, myanmar, cjk, n - latin - myanmar - cjk) then 'latin'
  when myanmar = greatest(latin, myanmar, cjk, n - latin - myanmar - cjk) then 'myanmar'
  when cjk = greatest(latin, myanmar, cjk, n - latin - myanmar - cjk) then 'cjk' else 'other' end as script from n""",
    "extract_email": _found(EMAIL),
    "extract_phone": f"select doc_id, array_to_string(list_filter(regexp_extract_all(text, '{PHONE}'), lambda p: length(regexp_replace(p, '\\D', '', 'g')) between 7 and 15), '|') as found from documents",
    "extract_money": _found(r"(?i)(?:RM|MYR)\s?\d[\d,]*(?:\.\d{1,2})?"),
    "extract_dates": _found(DATE),
    "date_key": """
select o_orderkey, cast(f as int) as form, case when f = 4 then strftime(o_orderdate, '%Y-%m') else strftime(o_orderdate, '%Y-%m-%d') end as key
from orders cross join range(5) t(f)""",
    "split_sections": """
with p as (select doc_id, string_split(replace(text, chr(10) || '## ', chr(1) || '## '), chr(1)) as parts from documents),
s as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as k from p),
t as (select doc_id, k, regexp_replace(part, '^\\s+|\\s+$', '', 'g') as part from s)
select doc_id, cast(k as int) as part_no, nullif(regexp_extract(part, '^## (.+)', 1), '') as heading, sha256(part) as sha from t""",
    "fact_antijoin": f"""
with {FACTS},
missing as (
  select f.*, case when kind = 'phone' then f.d when kind = 'date' then coalesce(canon, f.l) else f.l end as key
  from facts f join hay h using (doc_id)
  where not case
    when kind = 'phone' then contains(h.d, f.d) or (f.d like '60%' and contains(h.d, '0' || f.d[3:])) or (f.d like '0%' and contains(h.d, '60' || f.d[2:]))
    when kind = 'amount' then contains(h.l, 'rm' || regexp_replace(regexp_replace(f.l, '^(?:rm|myr)', ''), '\\.0+$', '')) or contains(h.l, 'myr' || regexp_replace(regexp_replace(f.l, '^(?:rm|myr)', ''), '\\.0+$', ''))
    when kind = 'date' and canon is not null then list_contains(h.days, canon) or list_contains(list_transform(h.days, lambda x: left(x, 7)), canon)
    else contains(h.l, f.l) end),
first as (select * from missing qualify row_number() over (partition by doc_id, key order by o, k) = 1)
select d.doc_id, cast(count(f.key) as int) as n_facts, coalesce(string_agg(f.v, '|' order by f.k) filter (where f.kind = 'phone'), '') as phones
from documents d left join first f on d.doc_id = f.doc_id group by d.doc_id""",
    "chunk_greedy": f"""
with recursive {CHUNKED}
select doc_id, cast(chunk_index as int) as chunk_index, heading as section_heading, cast({_words("text")} as int) as word_count, sha256(text) as sha from cut""",
    "corpus_build": f"""
with recursive {CHUNKED}, {CHUNKS},
placed as (
  select k.*, c.source, case when c.source <> 'retired' then 'current' when l.quality is null then 'unmapped' when l.quality = 0 then 'dropped' else 'kept' end as status
  from cut k join chunks c on c.id = k.doc_id left join labels l on l.doc_id = k.doc_id)
select case source when 'live' then 'new' when 'retired' then 'old' else 'partner' end || ':d' || doc_id || ':' || chunk_index as chunk_id, source, status,
       case source when 'live' then 'Live.'
         when 'retired' then case when status = 'dropped' then 'Dropped or changed on the live site -- verify before relying on this.' else 'Believed to still exist on the live site.' end end as currency_note,
       cast({_words("text")} as int) as word_count, sha256(text) as sha
from placed""",
    "cited_tags": f"""
with {QUESTIONS}, drafts as (select b.q as answer_id, {DRAFT} as answer from questions b),
found as (select answer_id, flatten(list_transform(regexp_extract_all(answer, '\\[([^\\]]*S\\d+[^\\]]*)\\]', 1), lambda g: regexp_extract_all(g, 'S\\d+'))) as t from drafts)
select answer_id, array_to_string(list_sort(list_distinct(t)), '|') as tags from found""",
    # All questions have eight sources, so that every digit from 1 to 8 names one.
    "repair_tags": f"""
with {QUESTIONS}, drafts as (select b.q as answer_id, {DRAFT} as answer from questions b)
select answer_id, regexp_replace(regexp_replace(regexp_replace(answer, '\\[\\s*(?:S[A-Z]|source|src)\\s*([1-8])\\s*\\]', '[S\\1]', 'gi'),
       '\\[\\s*(?:S[A-Z]|source|src)\\s*\\d+\\s*\\]', '', 'gi'), '\\[[A-Z][A-Z ]{{2,39}}\\]', '', 'g') as answer from drafts""",
    "copied_ratio": f"""{top()},
hay as (select q, string_agg(regexp_replace(text, '\\s+', ' ', 'g'), ' ') as hay from best group by q),
drafts as (select b.q as answer_id, unnest(string_split({DRAFT}, chr(10))) as line from questions b),
long as (select answer_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as line from drafts where length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) >= 60)
select b.q as answer_id, round(coalesce(sum(case when contains(hay, regexp_replace(line, '\\s+', ' ', 'g')) then length(line) else 0 end) / sum(length(line)), 0.0), 8) as share
from questions b left join long on long.answer_id = b.q left join hay on hay.q = b.q group by b.q""",
    "chunk_overlap": """
with w as (select doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as w from documents)
select doc_id, sha256(case when len(w) > 30 then array_to_string(w[len(w) - 29 : len(w)], ' ') else text end) as sha from w""",
    "gap_lookup": f"""
with {CHUNKS} select 'd' || c.id as slug, c.source, case when c.source <> 'retired' then 'current' when l.quality is null then 'unmapped' when l.quality = 0 then 'dropped' else 'kept' end as status
from chunks c left join labels l on c.id = l.doc_id""",
    "corpus_union": f"with {CHUNKS} select id, source, status, null as doc_type from chunks union all select id, source, null, title from chunks where source = 'live'",
    "supersede_first_rule": f"""
with {CHUNKS}, hit as (
  select id, case when contains(lower(text), 'ting the') then 'rule a' when contains(lower(text), 'the') then 'rule b' when contains(lower(text), 'de la') then 'rule c' end as reason
  from chunks where source <> 'partner')
select c.id, source, case when reason is not null then 'superseded' else status end as status, coalesce(reason, '-') as currency_note from chunks c left join hit h on c.id = h.id""",
    "manifest_by_source": f"with {CHUNKS} select source, count(*) as chunks, count(*) filter (where status = 'superseded') as superseded, count(distinct title) as titles from chunks group by source",
    "topics_explode": "with t as (select lang as topic from documents union all select source from documents) select topic, count(*) as chunks from t group by topic",
    "currency_weight": f"with {CHUNKS} select id, source, status, cast(weight as double) as weight, source <> 'retired' and status <> 'superseded' as is_current from chunks",
    "embed_text": f"""
with {CHUNKS}, h as (select *, case when lang <> 'en' then lang end as heading from chunks), w as (select *, concat_ws(' > ', title, heading) as place from h)
select id, sha256(concat_ws(chr(10), place, 'This is part of the guidance page: ' || place || '.', heading, text)) as sha,
       sha256(concat_ws(' ', title, coalesce(heading, ''), text)) as sha_bm25 from w""",
    "doc_len_avg": f"select count(*) as n, round(avg(len(regexp_extract_all(lower(text), '{TOKEN}'))), 6) as avg_len from documents",
    "bm25_idf": f"with {CHUNKS}, questions as (select item_id as q, text from benchmark), {bm25('chunks', 'questions')} select term, df, round(idf, 6) as idf from idf",
    "bm25_topk": f"with {CHUNKS}, questions as (select item_id as q, text from benchmark), {bm25('chunks', 'questions')}, r as (select q, id, bm25, row_number() over (partition by q order by bm25 desc, id) as rank from bm) select q, id, rank, round(bm25, 5) as bm25 from r where rank <= 8",
    "dense_topk": f"{RANKING} select q, id, rank_dense as rank, round(raw, 6) as raw from ranking where rank_dense <= 8",
    "vocab_coverage": f"{RANKING} select q, round(coverage, 8) as coverage, round(case when coverage is null then 0.5 else 1 - (0.5 + 0.5 * (1 - coverage)) end, 8) as w_sparse from cover",
    "rrf_fusion": f"{RANKING} select q, id, rank_dense, rank_bm25, round(fused, 8) as fused from ranking",
    "minmax_score": f"{RANKING} select q, id, rank, round(score, 6) as score from ranking",
    "hybrid_topk": f"{top()} {COLUMNS}",
    "hybrid_topk_live": f"{top("source in ('live', 'partner')")} {COLUMNS}",
    "hybrid_topk_retired": f"{top("source = 'retired'")} {COLUMNS}",
    "refusal_gate": f"{top()} select q.q, coalesce(max(round(raw, 4)), 0) as top_raw, coalesce(max(round(raw, 4)), 0) < 0.28 as gated from questions q left join best b on b.q = q.q group by q.q",
    "gold_rank": f"{RANKING}, {CASES} select q, coalesce(rank_fused, 0) as rank_fused, coalesce(rank_dense, 0) as rank_dense, coalesce(rank_bm25, 0) as rank_bm25, hit from cases",
    "recall_at_k": f"""{top()}, {CASES},
sizes as (select q, round_even(sum(length(text)) / 3.6, 0) as tokens from best group by q)
select count(*) as cases, count(*) filter (where hit) as hits, round(avg(cast(hit as int)), 8) as recall_at_k,
       cast(round_even(avg(tokens), 0) as bigint) as prompt_tokens_mean, cast(max(tokens) as bigint) as prompt_tokens_max from cases left join sizes using (q)""",
    "eval_regressions": f"{RANKING}, {CASES} select q, hit, true as was_hit, coalesce(rank_fused, 0) as rank_fused, 4 as was_rank, not hit as regressed, coalesce(abs(rank_fused - 4) >= 3, false) as moved from cases",
    "history_tail": f"""
with {HISTORY}, k as (select conv_id, turn, role, left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1000) as text from h where back <= 6 and role in ('user', 'bot'))
select c.conv_id, count(k.role) as n, coalesce(string_agg(k.role || ':' || k.text, '|' order by k.turn, k.role, k.text), '') as turns
from (select distinct conv_id from conversations) c left join k on c.conv_id = k.conv_id and k.text <> '' group by c.conv_id""",
    "condense_prompt": f"""
with {HISTORY}, k as (select *, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as line from h where back <= 4)
select conv_id, string_agg(role || ': ' || case when length(line) > 300 then left(line, 300) || '...' else line end, chr(10) order by back desc) as prompt from k group by conv_id""",
    "condense_trigger": f"with {HISTORY}, c as (select conv_id, count(*) as n from h group by conv_id) select c.conv_id, n > 1 and length(regexp_replace(text, '\\s+', '', 'g')) < 30 as condense from c join h on c.conv_id = h.conv_id and back = 1",
    "doc_concat": "select conv_id as doc_path, string_agg(text, chr(10) order by turn, text) as text from conversations group by conv_id",
    "snapshot_diff": f"with {CAPTURES}, {SNAPSHOT} select * from changes where change is not null",
    "pending_ids": f"with {CAPTURES}, {SNAPSHOT} select distinct id from changes where change in ('added', 'changed')",
    "index_upsert": f"with {CAPTURES} select * from was where id not in (select id from later) union all select * from later",
    "critical_sets": f"with {VERSIONS}, s as ({_critical('was')}) select doc_path, kind, array_to_string(facts, '|') as facts from s",
    "critical_diff": f"""
with {VERSIONS}, a as ({_critical('was')}), b as ({_critical('later')}),
f as (select coalesce(a.doc_path, b.doc_path) as doc_path, coalesce(a.kind, b.kind) as kind, case when a.kind is null then 'new' when b.kind is null then 'lost' else 'edited' end as change,
  list_sort(list_filter(coalesce(a.facts, []), lambda x: not list_contains(coalesce(b.facts, []), x))) as lost,
  list_sort(list_filter(coalesce(b.facts, []), lambda x: not list_contains(coalesce(a.facts, []), x))) as gained
  from a full join b on a.doc_path = b.doc_path and a.kind = b.kind)
select doc_path, kind, change, array_to_string(lost, '|') as lost, array_to_string(gained, '|') as gained from f where len(lost) > 0 or len(gained) > 0""",
    "doc_changes": f"with {VERSIONS}, c as (select coalesce(w.doc_path, l.doc_path) as doc_path, case when w.doc_path is null then 'new' when l.doc_path is null then 'lost' when w.text <> l.text then 'edited' end as change from was w full join later l on w.doc_path = l.doc_path) select * from c where change is not null",
    "link_buckets": """
with h as (select distinct page_id, trim(unnest(regexp_extract_all(html, 'href=["'']([^"''#][^"'']*)["'']', 1))) as href from pages),
b as (select *, lower(href) as low, lower(regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) as host from h where not regexp_matches(href, '^(mailto:|tel:|javascript:)')),
c as (select page_id, href, case when regexp_matches(low, 'drive\\.google\\.com|docs\\.google\\.com') then 'drive'
  when regexp_matches(low, 'youtube\\.com|youtu\\.be|vimeo\\.com|facebook\\.com/watch') then 'video'
  when regexp_matches(split_part(low, '?', 1), '(\\.pdf|\\.docx?|\\.xlsx?|\\.pptx?|\\.zip)$') or contains(low, '/wp-content/uploads/') then 'file'
  when host = '' or contains(host, 'example.org') then 'internal' else 'external' end as bucket from b)
select page_id, bucket, string_agg(href, '|' order by href) as hrefs from c group by all""",
    "strip_tags": "select page_id, sha256(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g')) as sha from pages",
    "url_path": "select page_id, coalesce(nullif(regexp_replace(case when contains(url, '//') then substr(url, position('//' in url) + 2) else url end, '^/+|/+$', '', 'g'), ''), '_home') as path from pages",
    "outage_flag": "select doc_id, regexp_matches(text || case when lang = 'de' then ' Temporarily CLOSED' else '' end, '(?i)currently unavailable|temporarily unavailable|not available at this time|temporarily (?:suspended|closed|paused)|service is suspended|suspended until further notice|ongoing (?:global )?technical (?:issue|problem)') as outage from documents",
    "sources_by_title": f"{top()}, t as (select b.q, b.position, i.title from best b join indexed i on b.id = i.id) select q as answer_id, title, 'https://example.org' as origin, string_agg('S' || position, ', ' order by position) as tags from t group by q, title",
}
