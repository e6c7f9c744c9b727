"""The queries of this folder's operators, with their production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bestfit_packing, chat_format, embedding_dedup, html_extract, line_dedup, merge_codec, mil_quality, multiset_hash, phrase_mining, simhash_dedup, source_divergence, token_files, url_automaton
from .common import Scratch, shared_dir, table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_codec.codec_digest(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents"))


def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.document_fingerprints(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    root = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), root)
    return token_files.read_token_files(spark, root)


def op8_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mil_quality.score(docs, mil_quality.train(docs, table(spark, sf_dir, "labels")))


def op9_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_automaton.judge_urls(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    odd = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(conversations.select(odd.columns).unionByName(odd))
    return chat_format.read_back(Scratch(spark, "chat").write(formatted))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.phrase_collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in list(globals().items()) if name.startswith("op")}

SQL: dict[str, str] = {
    "op1_embedding_dedup": """
with recursive v as (
  select vec_id, label, embedding::double[] as x from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0
), links as materialized (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) >= 0.93
), reach as (select vec_id as id, vec_id as other from embeddings union select r.id, l.b from reach r join links l on r.other = l.a
), lowest as (select id, min(other) as component_id from reach group by id
), degree as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join lowest on e.vec_id = id left join degree d on d.a = e.vec_id
""",
    "op9_url_automaton": """
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from cut
), rules(rule_host, rule_path, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits as (
  select page_id, host, path, rule_host || rule_path as rule, verdict,
    row_number() over (partition by page_id order by length(rule_host || rule_path) desc) as place
  from split join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from split s left join fits f on s.page_id = f.page_id and f.place = 1
""",
    "op10_line_dedup": r"""
with lines as (
  select doc_id, line_no, list_filter(string_split_regex(line, '[ \t\r\f\x0b]+'), lambda w: w <> '') as words
  from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from documents where doc_id is not null)
), worded as (select *, len(words) as n from lines where len(words) > 0
), ranked as (select *, row_number() over (order by doc_id, line_no) as place, min(line_no) over (partition by words, doc_id) as _ from worded
), firsts as (select words, any_value(n) as n, min(place) as place from ranked group by words
), variants as (
  select words, place, i, words[1:i-1] || words[i+1:n] as variant from (select *, unnest(range(1, n + 1)) as i from firsts where n >= 5)
), replaced as (select variant, i, min(place) as low from variants group by variant, i having count(*) > 1
), near as (
  select v.place from variants v join replaced r on v.variant = r.variant and v.i = r.i where r.low < v.place
  union select v.place from variants v join firsts f on v.variant = f.words where f.n >= 5 and f.place < v.place
  union select f.place from variants v join firsts f on v.variant = f.words where f.n >= 5 and v.place < f.place
), gone as (
  select r.doc_id, r.line_no from ranked r join firsts f on r.words = f.words
  where r.place <> f.place or f.place in (select place from near)
), lost as (select doc_id, list(line_no) as line_nos from gone group by doc_id)
select d.doc_id,
  case when g.line_nos is null then d.text else coalesce(array_to_string(list_transform(list_filter(range(len(string_split(d.text, chr(10)))), lambda i: not list_contains(g.line_nos, i)), lambda i: string_split(d.text, chr(10))[i + 1]), chr(10)), '') end as text,
  case when d.text is null then 0 else len(string_split(d.text, chr(10))) end::bigint as n_lines,
  coalesce(len(g.line_nos), 0)::bigint as n_removed
from documents d left join lost g on d.doc_id = g.doc_id
""",
    "op11_chat_format": r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, length(regexp_replace(role, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g'))
    + length('<|im_start|><|im_sep|><|im_end|>') as size from turns
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256, sum(size)::bigint as formatted_chars
from sized group by conv_id
""",
    "op12_source_divergence": r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents
), w as (select id, lang, source, unnest(words) as term from d
), kept as (select lang, term, count(*)::hugeint as total from w group by lang, term having count(distinct id) >= 3
), langs as (select l.lang, coalesce(sum(total), 0)::hugeint as n_lang, count(term)::hugeint as v from (select distinct lang from d) l left join kept k on k.lang = l.lang group by l.lang
), counts as (select lang, source, term, count(*)::hugeint as c from w semi join kept using (lang, term) group by lang, source, term
), sizes as (
  select g.lang, g.source, n_lang, v, coalesce((select sum(c) from counts c where c.lang = g.lang and c.source = g.source), 0)::hugeint as n
  from (select distinct lang, source from d) g join langs l on l.lang = g.lang
), shares as (
  select s.lang, s.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (s.n + s.v) as p, 1 + (1000000000 * (k.total + 1)) // (s.n_lang + s.v) as q
  from sizes s join kept k on k.lang = s.lang left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term
), pairs as (
  select g.lang, g.source, o.source as item, coalesce(x.value, 0)::bigint as value
  from sizes g join sizes o on g.lang = o.lang and g.source <> o.source
  left join (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) x
    on x.lang = g.lang and x.source = g.source and x.item = o.source
), terms as (
  select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from shares where c > 0 and p > q
), ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
  union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int from terms
)
select * from ranked where part = 'pair' or rank <= 200
""",
    "op13_phrase_mining": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), lists as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as words from pieces
), places as (select lang, words, unnest(range(1, len(words) + 1)) as i from lists
), spans as (select lang, words[i:i + k - 1] as words, k from places, (values (1), (2), (3)) s(k) where i + k - 1 <= len(words)
), counts as (select lang, array_to_string(words, ' ') as phrase, any_value(words) as words, any_value(k) as k, count(*)::hugeint as f from spans group by lang, array_to_string(words, ' ')
), sums as (select lang, sum(f)::bigint as n from counts where k = 1 group by lang
), found as (select * from counts where k >= 2 and f >= 10
), cuts as (
  select c.lang, c.phrase, c.words, c.f as a, j, x.f as l, y.f as r, (1000000 * c.f * c.f) // (x.f * y.f) as score
  from (select *, unnest(range(1, k)) as j from found) c
  join counts x on x.lang = c.lang and x.phrase = array_to_string(c.words[1:j], ' ')
  join counts y on y.lang = c.lang and y.phrase = array_to_string(c.words[j + 1:], ' ')
), best as (select *, row_number() over (partition by lang, phrase order by score, j) as place from cuts
), inside as (
  select lang, array_to_string(words[b:b + 1], ' ') as phrase, max(f) as most from (select *, unnest([1, 2]) as b from found where k = 3) group by all
), kept as (
  select b.* from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase where place = 1 and (most is null or 100 * most < 50 * a)
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select r.lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked r join sums s on s.lang = r.lang where rank <= 2000
""",
}
