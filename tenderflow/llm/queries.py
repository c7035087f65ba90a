"""The operators as queries on the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderflow.llm import (
    align,
    exact,
    langid,
    merkle,
    mixing,
    packing,
    pii,
    quality,
    simhash,
    tokens,
    urls,
    vectors,
    warc,
)

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
TOKEN_LIMIT = 1024

URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_warc(spark: SparkSession, root: str) -> DataFrame:
    records = warc.round_trip(_table(spark, root, "pages"))
    return records.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_language_id(spark: SparkSession, root: str) -> DataFrame:
    return langid.identify(_table(spark, root, "documents"))


def op3_vector_dedup(spark: SparkSession, root: str) -> DataFrame:
    return vectors.vector_groups(_table(spark, root, "embeddings"))


def op4_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_documents(
        _table(spark, root, "documents"), tokenizer_path(WORD_TOKENIZER)
    )


def op5_quality(spark: SparkSession, root: str) -> DataFrame:
    """Documents by source, and by language within a source."""
    labels = _table(spark, root, "labels")
    return quality.quality(
        _table(spark, root, "documents"),
        labels.select("doc_id", labels["quality"].alias("good")), "source", "lang",
    )


def op6_simhash(spark: SparkSession, root: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, root, "documents"))


def op7_url_filter(spark: SparkSession, root: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    pages = _table(spark, root, "pages").select("page_id", "url")
    return urls.judge(pages, rules).drop("url")


def op8_mixing(spark: SparkSession, root: str) -> DataFrame:
    counts = mixing.mix_counts(_table(spark, root, "documents"))
    return counts.select("doc_id", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, root: str) -> DataFrame:
    counts = tokens.token_counts(
        _table(spark, root, "documents"), tokenizer_path(BYTE_TOKENIZER)
    )
    return counts.withColumn("over_limit", counts["n_tokens"] > TOKEN_LIMIT)


def op10_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    return exact.exact_groups(_table(spark, root, "documents")).drop("row")


def op11_token_alignment(spark: SparkSession, root: str) -> DataFrame:
    aligned = align.align_documents(
        _table(spark, root, "documents"), tokenizer_path(BYTE_TOKENIZER),
        tokenizer_path(PIECE_TOKENIZER),
    )
    return aligned.drop("groups")


def op12_merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents")
    return merkle.verified(merkle.manifest(docs, merkle.tampered_leaf(docs)))


def op13_pii(spark: SparkSession, root: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, root, "documents"))
    return found.select(
        "doc_id", *pii.counts(F.col("spans")),
        F.sha2(pii.span_list(pii.of_base(F.col("spans"))), 256).alias("base_sha256"),
        pii.span_list(F.col("spans")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_url_filter": op7_url_filter,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_pii": op13_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
with payloads as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes,
    sha256(coalesce(html, '')) as payload_digest
  from pages),
firsts as (
  select *, min(page_id) over (partition by payload_digest) as first from payloads)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end
    as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from firsts""",
    "op3_vector_dedup": """
with recursive usable as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and len(embedding) > 0 and vec_id is not null
    and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b
  from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.93),
reached as (
  select vec_id as a, vec_id as b from embeddings
  union select r.a, l.b from reached r join links l on r.b = l.a),
numbered as (
  select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links,
    (select min(b) from reached r where r.a = e.vec_id) as component_id
  from embeddings e)
select vec_id, n_links, component_id, vec_id = component_id as kept from numbered""",
    "op7_url_filter": r"""
with parts as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
rules(h, p, action) as (values
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits as (
  select s.host, s.path, r.h || r.p as rule, r.action,
    row_number() over (partition by s.host, s.path order by length(r.h || r.p) desc) as place
  from (select distinct host, path from parts) s
  join rules r on (s.host = r.h or ends_with(s.host, '.' || r.h)) and starts_with(s.path, r.p))
select p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') as verdict
from parts p left join fits f on f.host = p.host and f.path = p.path and f.place = 1""",
    "op8_mixing": r"""
with sized as (
  select doc_id, source, row_number() over () as row_no,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) as shuffle
  from documents),
summed as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, row_number() over (order by source nulls last) as source_rank,
    1.5::double * (sum(source_size) over ())::bigint as pot from summed),
weighed as (
  select *, 2 * source_size as cap, [5, 2, 1][((source_rank - 1) % 3 + 1)::int] as weight
  from ranked),
levels as (
  select *, row_number() over w as place,
    (pot - coalesce((sum(cap) over (w rows between unbounded preceding and 1 preceding))::bigint, 0))
      / (sum(weight) over (w rows between current row and unbounded following))::bigint as level
  from weighed window w as (order by cap::double / weight, source_rank)),
aimed as (
  select source, source_rank, source_size, pot,
    case when place >= (select min(place) from levels where level <= cap::double / weight)
      then weight * (select level from levels where level <= cap::double / weight
                     order by place limit 1)
      else cap::double end as target
  from levels),
placed as (
  select d.*, a.source_rank, a.source_size, a.pot, a.target,
    (sum(size) over (partition by source_rank order by shuffle, doc_id
      rows between unbounded preceding and current row))::bigint as total
  from sized d join aimed a on d.source is not distinct from a.source),
timed as (
  select *, case when target > 0 then (round * source_size + total) / target end as finish
  from placed cross join (values (0), (1)) as r(round)),
queued as (
  select *, (sum(size) over (order by finish, source_rank, round, shuffle, doc_id
      rows between unbounded preceding and current row))::bigint as position
  from timed where finish is not null)
select p.doc_id, p.size, p.source_size, p.target,
  (p.size * (select count(*) from queued q
             where q.row_no = p.row_no and q.position <= q.pot))::bigint as taken
from placed p""",
    "op10_exact_dedup": """
with folded as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') as body
  from documents)
select doc_id, max(doc_id) over (partition by body) as keep_id,
  count(*) over (partition by body) as group_size,
  doc_id = max(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
from folded""",
    "op12_merkle_manifest": r"""
with recursive odd as (
  select doc_id, list_reduce(
    list_concat([4294967295::bigint], flatten(list_transform(
      string_split(doc_id::varchar, ''),
      lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: case when x >= 0 then xor(c, x)
      else xor(c >> 1, 3988292384::bigint * (c & 1)) end) as crc
  from (select distinct doc_id from documents)),
told as (
  select d.doc_id, source, o.crc & 1 as half,
    coalesce(octet_length(encode(d.doc_id::varchar)) || ':' || d.doc_id, '-')
      || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
      || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') as head,
    text, replace(text, chr(10), '') as cut
  from documents d left join odd o on o.doc_id = d.doc_id),
hashed as (
  select doc_id, source,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    case when half = 1 then  -- the final exclusive or flips the lowest bit
      sha256(head || coalesce(octet_length(encode(cut)) || ':' || cut, '-')) end as claimed
  from told),
leaves as (
  select *, dense_rank() over (order by source nulls first) - 1 as tree,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by source) as n
  from hashed),
nodes as (
  select tree, 0 as level, pos, n, leaf as digest from leaves
  union all
  select tree, min(level) + 1, pos // 3, (min(n) + 2) // 3, sha256(string_agg(digest, '' order by pos))
  from nodes where n > 1 group by tree, pos // 3),
above as (
  select -1 as tree, 0 as level, tree as pos, (select max(tree) + 1 from leaves) as n, digest
  from nodes where n = 1
  union all
  select -1, min(level) + 1, pos // 3, (min(n) + 2) // 3, sha256(string_agg(digest, '' order by pos))
  from above where n > 1 group by pos // 3),
steps as (
  select *, coalesce(lag(digest, 2) over w, '') || coalesce(lag(digest, 1) over w, '') as before,
    coalesce(lead(digest, 1) over w, '') || coalesce(lead(digest, 2) over w, '') as after,
    max(level) over (partition by tree) as depth
  from (select * from nodes union all select * from above)
  window w as (partition by tree, level, pos // 3 order by pos)),
ways as (
  select l.tree, l.pos, s.level, s.before, s.after
  from leaves l join steps s on s.tree = l.tree and s.n > 1 and s.pos = l.pos // (3 ** s.level)::bigint
  union all
  select l.tree, l.pos, 1000 + s.level, s.before, s.after
  from leaves l join steps s on s.tree = -1 and s.n > 1 and s.pos = l.tree // (3 ** s.level)::bigint),
paths as (
  select tree, pos, list({'b': before, 'a': after} order by level) as path,
    string_agg(before || after, '' order by level) as siblings
  from ways group by tree, pos),
folds as (
  select l.tree, l.pos, 1 as step, coalesce(l.claimed, l.leaf) as digest, coalesce(p.path, []) as path
  from leaves l left join paths p on p.tree = l.tree and p.pos = l.pos
  union all
  select tree, pos, step + 1, sha256(path[step].b || digest || path[step].a), path
  from folds where step <= len(path))
select l.doc_id, l.leaf, s.digest as subroot, r.digest as root,
  sha256(coalesce(p.siblings, '')) as proof_sha256, f.digest as folded_root,
  f.digest = r.digest as verified
from leaves l join nodes s on s.tree = l.tree and s.n = 1
join above r on r.n = 1
join folds f on f.tree = l.tree and f.pos = l.pos and f.step = len(f.path) + 1
left join paths p on p.tree = l.tree and p.pos = l.pos""",
    "op13_pii": r"""
with docs as (
  select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
hits as (
  select row, 'email' as kind, 0 as rank,
    regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as m,
    string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as g from docs
  union all
  select row, 'ip', 1, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
    string_split_regex(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') from docs
  union all
  select row, 'card', 2, regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'),
    string_split_regex(text, '[0-9]([\x20-]?[0-9])+') from docs
  union all
  select row, 'phone', 3, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'),
    string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') from docs),
each as (
  select row, kind, rank, i, m[i] as match, regexp_replace(m[i], '[^0-9]', '', 'g') as digits,
    g[i] as gap, g[i + 1] as next
  from (select *, unnest(range(1, len(m) + 1)) as i from hits where len(m) > 0)),
placed as (
  select *, (sum(length(gap) + length(match)) over (partition by row, kind order by i))::bigint
    as stop
  from each),
base as (
  select row, rank, kind, stop - length(match) as start, stop,
    kind || ':' || case kind when 'email' then lower(match) when 'ip' then match else digits end
      as entity,
    case when length(gap) > 80 then regexp_replace(right(gap, 80), '^[^ \t\n\x0B\f\r]+', '')
      else gap end as before,
    case when length(next) > 80 then regexp_replace(left(next, 80), '[^ \t\n\x0B\f\r]+$', '')
      else next end as after
  from placed
  where case kind when 'email' then true
    when 'ip' then len(list_filter(string_split(match, '.'), lambda x: length(ltrim(x, '0')) > 3
      or try_cast(ltrim('0' || x, '0') as integer) > 255)) = 0
    when 'card' then length(digits) between 14 and 19 and list_sum(list_transform(
      string_split(reverse(digits), ''), lambda x, j: case when j % 2 = 1 then x::integer
        when x::integer > 4 then 2 * x::integer - 9 else 2 * x::integer end)) % 10 = 0
    else length(digits) between 10 and 15 end),
chunks as (
  select *, string_split_regex(context, '[ \t\n\x0B\f\r]') as words
  from (select row, entity, start - length(before) as origin, before as context from base
        union all select row, entity, stop, after from base)),
words as (
  select row, entity, regexp_extract(words[i], '^(\p{L}+)[.,;:!?)]*$', 1) as word,
    origin + coalesce(list_sum(list_transform(words[1:i - 1], lambda w: length(w) + 1)), 0)::bigint
      as start
  from (select *, unnest(range(1, len(words) + 1)) as i from chunks)),
near as (
  select row, entity, lower(word) as term, start, start + length(word) as stop
  from words where word <> ''),
met as (
  select entity, token, count(distinct row) as met
  from (select row, entity, unnest([term, left(term, 3) || '*']) as token from near)
  group by all having count(distinct row) >= 3),
stands as (
  select row, lower(regexp_extract(chunk, '^(\p{L}+)[.,;:!?)]*$', 1)) as term
  from (select row, unnest(string_split_regex(text, '[ \t\n\x0B\f\r]+')) as chunk from docs)),
known as (
  select token, count(distinct row) as documents
  from (select row, unnest([term, left(term, 3) || '*']) as token from stands where term <> '')
  group by token),
telling as (
  select entity, token from met join known using (token) where documents <= 2 * met),
decided as (
  select t.entity, t.token as term, c.token is not null as gone
  from telling t left join telling c on c.entity = t.entity and c.token = left(t.token, 3) || '*'
  where t.token not like '%*'),
spans as (
  select row, rank, kind, start, stop from base
  union all
  select row, case when bool_or(gone) then 5 else 4 end,
    case when bool_or(gone) then 'removed' else 'generalised' end, start, stop
  from near join decided using (entity, term) group by row, start, stop),
lists as (
  select row, count(*) filter (rank = 0) as n_email, count(*) filter (rank = 1) as n_ip,
    count(*) filter (rank = 2) as n_card, count(*) filter (rank = 3) as n_phone,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank)
      filter (rank < 4) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans
  from spans group by row)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip,
  coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join lists using (row)""",
}
