"""The SQL that each query of this folder is held against."""

from __future__ import annotations

from .derive import SPANS
from .derive import SQL as TOKS

PRF = """n_correct, n_pred, n_gold, case when n_pred = 0 then 0 else round(n_correct / n_pred, 9) end as "precision", case when n_gold = 0 then 0 else round(n_correct / n_gold, 9) end as recall,
  case when n_correct = 0 then 0 else round(2.0 * n_correct / (n_pred + n_gold), 9) end as f1"""

QUALITY = """with q as (select l.doc_id, lang, text, quality::varchar as gold, case when n_chars > 700 then '1' else '0' end as pred from labels l join documents d on l.doc_id = d.doc_id)"""

COUNTS = "select word, count(*) as cnt from toks group by word"

DIST = """
, dist as (
  select coalesce(h.pos, '<WALL>') as ptag, t.pos as ctag, case when t.parent < t.tok then 'R' else 'L' end as dir, max(case when t.parent = -1 then 1 else abs(t.tok - t.parent) end) as max_dist
  from toks t left join toks h on h.sent_id = t.sent_id and h.tok = t.parent group by 1, 2, 3)"""

#: All arcs with the decision of the distance table, and whether the gold tree has them.
MASK = f"""{DIST}
, seen as (select ptag as t from dist union select ctag from dist
), wall as (select sent_id, tok, pos from toks union all select distinct sent_id, -1, '<WALL>' from toks
), grown as (select c.sent_id, p.tok as p, c.tok as c, p.tok = c.parent as tree, p.pos as ptag, c.pos as ctag, case when p.tok < c.tok then 'R' else 'L' end as dir, case when p.tok = -1 then 1 else abs(p.tok - c.tok) end as d
  from toks c join wall p on c.sent_id = p.sent_id and c.tok <> p.tok
), mask as (select g.sent_id, p, c, tree, coalesce(d <= max_dist, false) or p = c - 1 or g.ptag not in (select t from seen) or g.ctag not in (select t from seen) as kept
  from grown g left join dist t on g.ptag = t.ptag and g.ctag = t.ctag and g.dir = t.dir)"""


def _scores(k: int = 3, prop: float = 0.9) -> str:
    return f"""
, arcs as (select sent_id, n, tok as c, parent, unnest(range(-1, n)) as p from toks
), scores as (select sent_id, p, c, p = parent as tree, (((p * 31 + c * 17 + sent_id) % 101) + 101) % 101 / 100.0 as score from arcs where p <> c
), top as (select *, row_number() over w <= {k} as best, score >= {prop} * first_value(score) over w as near from scores window w as (partition by sent_id, c order by score desc, p))"""


#: Pairs of mentions: the related ones of even rank first, then the others.
RELS = """
, rels as (select sent_id, rank, m_id as a, lead(m_id) over w as b, type as t1, lead(type) over w as t2 from mentions window w as (partition by sent_id order by rank)
), lab as (select sent_id, rank, a, b, case when t1 = t2 then 'PER-SOC(Arg-1,Arg-1)' else 'ART(Arg-1,Arg-2)' end as label from rels where b is not null and rank % 2 = 0
), every as (select x.sent_id, x.m_id as m1, y.m_id as m2, x.rank as r1, y.rank as r2, x.head as h1, y.head as h2 from mentions x join mentions y on x.sent_id = y.sent_id and x.rank < y.rank
), labelled as (select every.*, coalesce(label, 'NO_RELATION') as label, row_number() over (partition by every.sent_id order by label is null, r1, r2) - 1 as k from every left join lab on every.sent_id = lab.sent_id and m1 = a and m2 = b
), starts as (select sent_id, "start" as s, row_number() over (partition by sent_id order by "start") as upto from mentions
), cand as (select e.*, coalesce(y.upto, 0) - coalesce(x.upto, 0) as crossed from labelled e asof left join starts x on e.sent_id = x.sent_id and e.h1 > x.s asof left join starts y on e.sent_id = y.sent_id and e.h2 > y.s)"""


def _srl(name: str, pos: str, parent: str) -> str:
    return f"""
, {name} as (
  select sent_id, -1 as p, tok as c, '0' || tok % 2 as label from toks where {pos} like 'V%'
  union all select t.sent_id, t.{parent}, t.tok, 'A' || length(t.{pos}) from toks t join toks h on h.sent_id = t.sent_id and h.tok = t.{parent} where h.{pos} like 'V%')"""


def _srl_f1(kind: str, where: str, label: str) -> str:
    return f"""select '{kind}' as kind, {PRF} from (
  select count(*) filter (where g is not null and q is not null and {label}) as n_correct, count(q) as n_pred, count(g) as n_gold from scored where {where})"""


#: Both sides of an arc, and whether its predicate is a gold one.
SCORED = """
, scored as (select coalesce(g.p, q.p) as p, g.label as g, q.label as q, coalesce(g.p, q.p) = -1 and g.label is not null or coalesce(g.p, q.p) >= 0 and exists (select 1 from gold h where h.sent_id = coalesce(g.sent_id, q.sent_id) and h.p = -1 and h.c = coalesce(g.p, q.p)) as known
  from gold g full join pred q on g.sent_id = q.sent_id and g.p = q.p and g.c = q.c)"""


def _climb() -> str:
    """All tokens above each, by length of the sentence, so that the few long ones take the many steps alone."""
    parts = [(1, 40), (41, 500), (501, 1 << 30)]
    steps = [f"""
, climb{i} as (
  select sent_id, tok, tok as node, parent as up, 0 as depth from toks where n between {low} and {high}
  union all select k.sent_id, k.tok, t.tok, t.parent, k.depth + 1 from climb{i} k join (select * from toks where n between {low} and {high}) t on t.sent_id = k.sent_id and t.tok = k.up)""" for i, (low, high) in enumerate(parts)]
    return "".join(steps) + ", climb as (" + " union all ".join(f"select * from climb{i}" for i in range(len(parts))) + ")"


#: Pairs of tokens with their lowest common token, and the steps between. Heads lie on one side in a document, so the outer of two tokens is never above the other.
_PATHS = """
, ab as (
  {ab}
), walk as (
  select sent_id, a, b, a as x, b as y, 0 as nu, 0 as nd, (doc_id % 2 = 0) = (a > b) as up, doc_id % 2 = 0 as fwd from ab
  union all select z.sent_id, a, b, x, y, nu, nd, fwd = (x > y), fwd from (
    select w.sent_id, a, b, case when up then t.parent else x end as x, case when up then y else t.parent end as y, nu + up::int as nu, nd + (not up)::int as nd, fwd
    from walk w join toks t on t.sent_id = w.sent_id and t.tok = case when up then x else y end where x <> y) z
), top as (select sent_id, a, b, x as lca, nu as n_up, nd as n_down from walk where x = y
), steps as (
  select t.sent_id, t.a, t.b, nu as place, x as node, 'UP' as dir, n_up + n_down as last, n_up from top t join walk w on w.sent_id = t.sent_id and w.a = t.a and w.b = t.b where up and x <> y
  union all select t.sent_id, t.a, t.b, n_up + n_down - nd, y, 'DOWN', n_up + n_down, n_up from top t join walk w on w.sent_id = t.sent_id and w.a = t.a and w.b = t.b where not up and x <> y
  union all select sent_id, a, b, n_up, lca, 'DOWN', n_up + n_down, n_up from top
), tagged as (select s.*, t.pos, t.deprel from steps s join toks t on t.sent_id = s.sent_id and t.tok = s.node
), links as (  -- the relation of a step is that of its lower token
  select sent_id, a, b, node, place, last, n_up, pos, dir, case when dir = 'UP' then deprel else lead(deprel) over w end as rel from tagged window w as (partition by sent_id, a, b order by place)
), marked as (select *, coalesce(lag(rel) over w <> rel, true) as other, lag(pos) over (partition by sent_id, a, b order by place desc) as behind from links window w as (partition by sent_id, a, b order by place))"""
PATHS = _PATHS.format(ab="select sent_id, doc_id, tok as a, tok + k as b from toks, (values (1), (2), (7)) v(k) where tok + k < n union select sent_id, doc_id, tok, parent from toks where parent >= 0 union select sent_id, doc_id, parent, tok from toks where parent >= 0")

M32 = "4294967295::ubigint"
_TRIPLE_SQL = {
    "bias": "", "tags": " || '_' || ht || '_' || mt || '_' || st", "h_s": " || '_' || ht || '_' || st", "m_s": " || '_' || mt || '_' || st", "S_h": " || '_' || sw || '_' || ht", "S_m": " || '_' || sw || '_' || mt", "H_s": " || '_' || hw || '_' || st",
    "M_s": " || '_' || mw || '_' || st", "H_S": " || '_' || hw || '_' || sw", "M_S": " || '_' || mw || '_' || sw",
}

SQL: dict[str, str] = {
    "top_words": f"{TOKS} select * from ({COUNTS}) where cnt > 3 order by cnt desc, word desc limit 100",
    "word_counts": f"{TOKS} {COUNTS}",
    "known_words": f"{TOKS} select * from ({COUNTS}) where cnt > 3",
    "corpus_summary": f"{TOKS} select count(*) as n_sents, sum(n)::bigint as n_tokens, max(n)::bigint as max_len, avg(n) as avg_len from sents",
    "length_filter": f"{TOKS} select sent_id, n from sents where n between 5 and 40",
    "text_offsets": r"""
with w as (
  select doc_id, string_split_regex(text, '\s') as ws from documents where text is not null
), p as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from w
), o as (select doc_id, word, sum(length(word) + 1) over (partition by doc_id order by i) - length(word) - 1 as s from p)
select doc_id, count(*) as n_words, sum(s)::bigint as sum_start, max(s + length(word))::int as last_end from o where word <> '' group by doc_id
""",
    "vocab_cutoff": f"""{TOKS}
, counts as ({COUNTS}), hist as (select cnt, sum(count(*)) over (order by cnt desc) as kept from counts group by cnt
), k as (select coalesce(min(cnt), 4611686018427387904) as k from hist where kept + 4 <= 1000)
select '<UNK>' as word, coalesce(sum(cnt) filter (where cnt < k), 0)::bigint as cnt, 0::bigint as id from counts, k
union all select unnest(['<START>', '<END>', '<WALL>']), 0, unnest([1, 2, 3])
union all select word, cnt, row_number() over (order by cnt desc, word) + 3 from counts, k where cnt >= k
""",
    "topn_cutoff": f"{TOKS} select min(cnt) as cutoff from (select cnt from ({COUNTS}) order by cnt desc limit 800)",
    "prefix_suffix": f"{TOKS} select substr(word, 1, 5) as prefix, case when length(word) >= 3 then right(word, 3) else word end as suffix, word = '' or regexp_matches(word, '^\\p{{Lu}}') as cap, count(*) as cnt from toks group by 1, 2, 3",
    "strict_pos": f"""{TOKS} select pos, case when pos like 'V%' then 'VERB' when pos like 'N%' then 'NOUN' else 'OTHER' end as spos,
  case pos when '.' then 'ENDPUNC' when 'CD' then 'ADJ' when 'NNP' then 'N' when 'DT' then 'DET' when 'VBZ' then 'V' when 'NN' then 'N' when 'IN' then 'PREP' when 'VBD' then 'V' when 'JJ' then 'ADJ' end as coarse, count(*) as cnt from toks group by 1, 2, 3""",
    "normalize_words": f"{TOKS} select regexp_replace(lower(regexp_replace(word, '[^A-Za-z0-9_ÁÉÍÓÚÜÑáéíóúüñ]', '_', 'g')), '[0-9]+', '0', 'g') as clean, count(*) as cnt from toks group by 1",
    "role_labels": f"""{TOKS}, x as (select deprel, tok, parent - tok as d from toks) select lower(deprel) as role, '0' || tok % 3 as sense,
  case when d >= 40 then 40 when d >= 30 then 30 when d >= 20 then 20 when d >= 10 then 10 when d >= 5 then 5 when d >= 2 then 2 when d >= 0 then 0 else -2147483648 end as dist,
  count(*) as cnt from x group by 1, 2, 3""",
    "cluster_lookup": f"{TOKS}, counts as ({COUNTS}) select case when c.cnt > 3 then substr(md5(lower(t.word)), 1, 4) else 'UNK' end as cluster, count(*) as cnt from toks t join counts c on t.word = c.word group by 1",
    "cluster_hit_rate": f"{TOKS}, counts as ({COUNTS}) select lang, round(avg(case when c.cnt > 3 then 1.0 else 0 end), 9) as hit_rate from toks t join counts c on t.word = c.word group by 1",
    "embed_lookup": f"""{TOKS}, vocab as (select lower(word) as word from toks group by 1 having count(*) > 10)
select coalesce(length(a.word), length(b.word), length(c.word), length(d.word), -1)::bigint as embed_id, count(*) as cnt from toks t
left join vocab a on t.word = a.word left join vocab b on regexp_replace(t.word, '[0-9]', '#', 'g') = b.word left join vocab c on lower(t.word) = c.word left join vocab d on upper(t.word) = d.word group by 1""",
    "oov_rate": f"""{TOKS}, known as (
  select distinct unnest(string_split_regex(regexp_replace(line, '([.,;:!?])', ' \\1 ', 'g'), '[ \\t\\r]+')) as word from (select unnest(string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10))) as line from benchmark))
select doc_id, count(*) as n, count(*) filter (where word not in (select word from known where word <> '') or word = 'UNK') as n_oov from toks group by doc_id""",
    "embedding_scale": """
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
), s as (select *, list_sum(list_transform(e, lambda x: abs(x))) as a, sqrt(list_sum(list_transform(e, lambda x: x * x))) as l, list_avg(e) as m from v
), t as (select *, sqrt(list_avg(list_transform(e, lambda x: (x - m) * (x - m)))) as sd from s)
, x as (select *, unnest(e) as v, unnest(range(len(e))) as i from t)
select vec_id, i::int as i, round(v / a, 5) as l1, round(v / l, 5) as l2, round((v - m) / sd, 5) as std from x
""",
    "bio_convert": f"""{TOKS}, io as (select sent_id, tok, case when ne = 'O' then 'O' else 'I-' || substr(ne, 3) end as t from toks
), l as (select *, lag(t) over (partition by sent_id order by tok) as b from io)
select t as before, case when t <> 'O' and (b is null or b = 'O' or b <> t) then 'B-' || substr(t, 3) else t end as after, count(*) as cnt from l group by 1, 2""",
    "bio_chunks": f'{TOKS}{SPANS} select sent_id, "start", "end", type from gspans',
    "bio_spans": f'{TOKS}{SPANS} select sent_id, "start", "end", type as label, row_number() over (partition by sent_id order by "start") - 1 as k from gspans',
    "span_texts": f'{TOKS}{SPANS} select type, array_to_string(words["start" + 1:"end"], \' \') as text, count(*) as cnt from gspans join sents on gspans.sent_id = sents.sent_id group by 1, 2',
    "ngrams": """
with c as (select conv_id, list(role order by turn, role) as r from conversations group by conv_id
), p as (select *, ['BOS', 'BOS'] || r as q from c)
select conv_id, array_to_string(list_transform(range(1, len(r) + 1), lambda i: q[i + 1] || '_' || q[i + 2]), ' ') as bigrams, array_to_string(list_transform(range(1, len(r) + 1), lambda i: q[i] || '_' || q[i + 1] || '_' || q[i + 2]), ' ') as trigrams,
  array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: i = 1 or r[i] <> r[i - 1]), lambda i: r[i]), ' ') as no_dup, array_to_string(list_sort(list_distinct(r)), ' ') as bag from p
""",
    "shifts": f"{TOKS}, s as (select pos, lag(pos, 1, 'BOS') over w as before, lead(pos, 2, 'EOS') over w as after2 from toks window w as (partition by sent_id order by tok)) select before, pos, after2, count(*) as cnt from s group by 1, 2, 3",
    "num_between": f"""{TOKS}, v as (select sent_id, tok, parent, (pos like 'V%')::int as v, sum((pos like 'V%')::int) over (partition by sent_id order by tok) as s from toks)
select (case when c.parent < c.tok then c.s - c.v - coalesce(p.s, 0) else p.s - p.v - c.s end)::bigint as between_verb, count(*) as cnt from v c left join v p on p.sent_id = c.sent_id and p.tok = c.parent group by 1""",
    "siblings": f"{TOKS}, s as (select tok, n, coalesce(lag(tok) over w, -1) as l, coalesce(lead(tok) over w, n) as r from toks window w as (partition by sent_id, parent order by tok)) select l - tok as left, r - tok as right, count(*) as cnt from s group by 1, 2",
    "child_ends": f"""{TOKS}, k as (select sent_id, parent as tok, min(case when tok < parent then tok end) as lmc, max(case when tok > parent then tok end) as rmc, max(case when tok < parent then tok end) as lnc, min(case when tok > parent then tok end) as rnc from toks where parent >= 0 group by 1, 2)
select t.sent_id, sum(coalesce(lmc, -2))::bigint as lmc, sum(coalesce(rmc, -2))::bigint as rmc, sum(coalesce(lnc, -2))::bigint as lnc, sum(coalesce(rnc, -2))::bigint as rnc from toks t left join k on k.sent_id = t.sent_id and k.tok = t.tok group by 1""",
    "folds": "with r as (select doc_id, row_number() over (order by doc_id) - 1 as rn, count(*) over () as n from documents) select least(rn // (n // 7), 6)::int as fold, count(*) as cnt, min(doc_id) as first, max(doc_id) as last from r group by 1",
    "train_dev_split": "select ceil(count(*) * 0.1)::bigint as n_dev, (count(*) - ceil(count(*) * 0.1))::bigint as n_train from documents",
    "pos_accuracy": f"{TOKS} select count(*) filter (where pos = ppos) as n_correct, count(*) filter (where pos <> ppos) as n_errors, count(*) as n_total, round(count(*) filter (where pos = ppos) / count(*), 9) as score from toks",
    "uas": f"{TOKS} select count(*) filter (where parent = pparent) as n_correct, count(*) as n_total, round(count(*) filter (where parent = pparent) / count(*), 9) as score from toks where pos <> '.'",
    "las": f"{TOKS} select count(*) filter (where parent = pparent and deprel = pdeprel) as n_correct, count(*) as n_total, round(count(*) filter (where parent = pparent and deprel = pdeprel) / count(*), 9) as score from toks",
    "tree_exact_match": f"{TOKS}, s as (select sent_id, bool_and(parent = pparent) as ok from toks group by 1) select count(*) filter (where ok) as n_correct, count(*) as n_total, round(count(*) filter (where ok) / count(*), 9) as score from s",
    "evaluate_all": f"""{TOKS}, s as (select sent_id, count(*) as n, count(*) filter (where pos <> '.') as np, count(*) filter (where pos = ppos) as t, count(*) filter (where parent = pparent) as u, count(*) filter (where parent = pparent and pos <> '.') as unp,
  count(*) filter (where deprel = pdeprel) as d, count(*) filter (where parent = pparent and deprel = pdeprel) as l, count(*) filter (where parent = pparent and deprel = pdeprel and pos <> '.') as lnp from toks group by 1
), r as (select unnest([
  struct_pack(metric := 'pos_accuracy', n_correct := sum(t)::bigint, n_total := sum(n)::bigint), struct_pack(metric := 'parent_accuracy', n_correct := sum(u)::bigint, n_total := sum(n)::bigint),
  struct_pack(metric := 'parent_accuracy_exact', n_correct := count(*) filter (where u = n), n_total := count(*)), struct_pack(metric := 'deprel_accuracy', n_correct := sum(d)::bigint, n_total := sum(n)::bigint),
  struct_pack(metric := 'uas', n_correct := sum(u)::bigint, n_total := sum(n)::bigint), struct_pack(metric := 'uas_exact', n_correct := count(*) filter (where u = n), n_total := count(*)),
  struct_pack(metric := 'uas_no_punct', n_correct := sum(unp)::bigint, n_total := sum(np)::bigint), struct_pack(metric := 'uas_no_punct_exact', n_correct := count(*) filter (where unp = np), n_total := count(*)),
  struct_pack(metric := 'las', n_correct := sum(l)::bigint, n_total := sum(n)::bigint), struct_pack(metric := 'las_no_punct', n_correct := sum(lnp)::bigint, n_total := sum(np)::bigint)]) as x from s)
select x.metric as metric, x.n_correct as n_correct, x.n_total as n_total, round(x.n_correct / x.n_total, 9) as score from r""",
    "ner_f1": f"""{TOKS}{SPANS} select {PRF} from (select count(case when g.type = p.type then 1 end) as n_correct, count(p.type) as n_pred, count(g.type) as n_gold
  from gspans g full join pspans p on g.sent_id = p.sent_id and g."start" = p."start" and g."end" = p."end")""",
    "binary_f1": f"{QUALITY} select lang, n_missing, n_total, {PRF} from (select lang, count(*) filter (where gold = '1' and pred = '1') as n_correct, count(*) filter (where pred = '1') as n_pred, count(*) filter (where gold = '1') as n_gold, 0::bigint as n_missing, count(*) as n_total from q group by lang)",
    "confusion_by_lang": f"{QUALITY} select lang, gold, pred, count(*) as n from q group by grouping sets ((lang, gold, pred), (gold, pred))",
    "confusion_scores": f"""{QUALITY} select {PRF.replace("then 0 else round(n_correct / n_pred", "then 1 else round(n_correct / n_pred").replace("then 0 else round(n_correct / n_gold", "then 1 else round(n_correct / n_gold")}, n_total, round(s / n_total, 9) as accuracy
  from (select count(*) filter (where gold = '1' and pred = '1') as n_correct, count(*) filter (where pred = '1') as n_pred, count(*) filter (where gold = '1') as n_gold, count(*) filter (where gold = pred) as s, count(*) as n_total from q)""",
    "majority_baseline": f"{QUALITY} select lang, '1' as label, {PRF} from (select lang, count(*) filter (where gold = '1') as n_correct, count(*) as n_pred, count(*) filter (where gold = '1') as n_gold from q group by lang)",
    "category_max_f1": f"""{QUALITY}, c as (select lang, count(*) filter (where gold = '1') as k, count(*) as n from q group by lang
), subsets as (select s, list_sum(list_transform(range(len(langs)), lambda i: case when (s >> i) & 1 = 1 then ks[i + 1] else 0 end)) as k, list_sum(list_transform(range(len(langs)), lambda i: case when (s >> i) & 1 = 1 then ns[i + 1] else 0 end)) as n, list_sum(ks) as g, langs
  from (select list(lang order by lang) as langs, list(k order by lang) as ks, list(n order by lang) as ns from c), range(1, 1 << 4) t(s) where s < (1 << len(langs))
), best as (select 2.0 * k / (n + g) as f1, s, langs from subsets order by f1 desc limit 1)
select unnest(langs) as lang, case when (s >> unnest(range(len(langs)))) & 1 = 1 then '1' else '0' end as guess, round(f1, 9) as f1 from best""",
    "examples_per_cell": f"{QUALITY}, r as (select gold, pred, doc_id, row_number() over (partition by gold, pred order by length(text), doc_id) - 1 as rank from q) select gold, pred, rank, doc_id from r where rank < 5",
    "suff_stats": f"{TOKS} select sent_id, count(*) filter (where parent = pparent)::double as n_correct, count(*)::double as n_total from toks group by 1",
    "permutation_small": f"{QUALITY}, d as (select doc_id, (gold = pred)::int - (gold = '1')::int as diff from q) select s.s as sample, sum(case when substr(md5(doc_id || ':' || s.s), 1, 1) <= '7' then diff else -diff end)::bigint as total from d, range(200) s(s) group by 1",
    "tree_stats": f"{TOKS}, s as (select sent_id, count(*) filter (where parent = -1) as n_roots, bool_or(parent < -1) as m from toks group by 1) select n_roots, count(*) as n_sents, count(*) filter (where m) as n_missing from s group by 1",
    "distance_table": f"""{TOKS} select coalesce(h.pos, '<WALL>') as ptag, t.pos as ctag, case when t.parent < t.tok then 'R' else 'L' end as dir, max(case when t.parent = -1 then 1 else abs(t.tok - t.parent) end) as max_dist
  from toks t left join toks h on h.sent_id = t.sent_id and h.tok = t.parent group by 1, 2, 3""",
    "distance_prune": f"""{TOKS}{MASK}, s as (select sent_id, bool_and(kept) as ok from mask where tree group by 1)
select n_pruned, n_total, round(n_pruned / n_total, 9) as score, n_gold_kept, n_gold, n_exact, n_sents from
  (select count(*) filter (where not kept and not tree) as n_pruned, count(*) filter (where not tree) as n_total, count(*) filter (where kept and tree) as n_gold_kept, count(*) filter (where tree) as n_gold from mask), (select count(*) filter (where ok) as n_exact, count(*) as n_sents from s)""",
    "mask_ops": f"""{TOKS}{MASK}, x as (select kept, abs(p - c) <= 2 as near, tree from mask)
select count(*) filter (where kept and near) as and_kept, count(*) filter (where not (kept and near)) as and_pruned, count(*) filter (where kept or near or tree) as or_kept, count(*) filter (where not (kept or near or tree)) as or_pruned from x""",
    "topk_heads": f"{TOKS}{_scores()} select count(*) filter (where best and near or tree) as n_kept, count(*) filter (where not (best and near or tree)) as n_pruned from top",
    "mask_counts": f"{TOKS}{_scores()}, k as (select sent_id, c, count(*) filter (where best) as n from top group by 1, 2) select sent_id, sum(n)::bigint as n_kept, min(n)::bigint as least_heads from k group by 1",
    "score_prune": f"{TOKS}{_scores(5, 0.8)} select sent_id, count(*) as n_kept, sum(p)::bigint as sum_heads from top where best and near or tree group by 1",
    "arc_counts": f"{TOKS} select sent_id, n * n as n_arcs, n + n * (n * n - 1) // 3 as length from sents",
    "reachable": f"{TOKS} select distinct sent_id, sent_id % 3 <> 0 or n = 1 as multi_root, sent_id % 3 <> 0 or n = 1 as single_root from toks",
    "arc_triples": f"""{TOKS}
select 'grandparent' as kind, count(*) as cnt from toks u join toks t on t.sent_id = u.sent_id and t.parent = u.tok where u.parent <> t.tok
union all select 'projective', count(*) from toks u join toks t on t.sent_id = u.sent_id and t.parent = u.tok where u.parent <> t.tok and not (u.parent >= 0 and least(t.parent, t.tok) < u.parent and u.parent < greatest(t.parent, t.tok))
union all select 'sibling', count(*) from toks u join toks t on t.sent_id = u.sent_id and t.parent = u.parent and u.tok < t.tok
union all select 'bigram', count(*) from toks u join toks t on t.sent_id = u.sent_id and t.tok = u.tok + 1""",
    "root_path": f"{TOKS}{_climb()} select sent_id, tok, string_agg(node::varchar, ' ' order by depth) as path from climb group by 1, 2",
    "dep_path": f"""{TOKS}{PATHS}, found as (
  select 'seq(pos&dir(path))' as template, string_agg(pos || case when place = last then '' else '_' || dir end, '_' order by place) as feature from marked group by sent_id, a, b
  union all select 'no_dup(rel(path))', string_agg(rel, '_' order by place) filter (where other) from marked where place < last group by sent_id, a, b
  union all select 'bag(pos(path_p_lca))', string_agg(distinct pos, '_' order by pos) from marked where place <= n_up group by sent_id, a, b
  union all select '2gram(pos(path_c_lca))', coalesce(behind, 'BOS') || '_' || pos from marked where place >= n_up)
select template, feature, count(*) as cnt from found group by 1, 2""",
    "genealogy": f"""{TOKS}{PATHS}, br as (select sent_id, a, b, count(*) as len, count(*) filter (where abs(nx - node) > 1) as breaks from (select *, lead(node) over (partition by sent_id, a, b order by place) as nx from steps) group by 1, 2, 3
), kin as (select x.sent_id, x.a, x.b, case when pb.parent = x.a then 'PARENT' when pa.parent = x.b then 'CHILD' when pa.parent = pb.parent then 'SIBLING' when t.lca = x.a then 'ANCESTOR' when t.lca = x.b then 'DESCENDENT' else 'COUSIN' end as kin
  from ab x join toks pa on pa.sent_id = x.sent_id and pa.tok = a join toks pb on pb.sent_id = x.sent_id and pb.tok = b left join top t on t.sent_id = x.sent_id and t.a = x.a and t.b = x.b)
select kin || '_' || breaks || '_' || case when len >= 40 then 40 when len >= 30 then 30 when len >= 20 then 20 when len >= 10 then 10 when len >= 5 then 5 else 2 end as feature, count(*) as cnt from kin join br on kin.sent_id = br.sent_id and kin.a = br.a and kin.b = br.b group by 1""",
    "projective": f"""{TOKS}, arc as (select sent_id, least(parent, tok) as a, greatest(parent, tok) as b from toks
), cross_ as (select distinct x.sent_id from arc x join arc y on x.sent_id = y.sent_id and x.a < y.a and y.a < x.b and x.b < y.b)
select distinct sent_id, sent_id not in (select sent_id from cross_) as projective from toks""",
    "ne_pairs": f'{TOKS}{SPANS}{RELS} select sent_id, k, m1, m2, (crossed - (select count(*) from mentions m where m.sent_id = cand.sent_id and m.m_id in (m1, m2) and m."start" >= h1 and m."start" < h2))::int as n_between from cand',
    "relation_labels": f"{TOKS}{SPANS}{RELS} select label, count(*) as cnt from labelled group by 1",
    "rel_f1": f"""{TOKS}{SPANS}{RELS}, x as (select label as gold, case when (sent_id + k) % 5 = 0 then 'ART(Arg-1,Arg-2)' else label end as pred from labelled)
select n_missing, n_total, {PRF} from (select count(*) filter (where gold = pred and gold <> 'NO_RELATION') as n_correct, count(*) filter (where pred <> 'NO_RELATION') as n_pred, count(*) filter (where gold <> 'NO_RELATION') as n_gold, 0::bigint as n_missing, count(*) as n_total from x)""",
    "overlapping_mentions": f'{TOKS}{SPANS} select sent_id, count(*) filter (where "end" - "start" > 1) as n_overlapping from mentions group by 1',
    "srl_f1": f"""{TOKS}{_srl('gold', 'pos', 'parent')}{_srl('pred', 'ppos', 'pparent')}{SCORED} {_srl_f1('srl_position', 'p = -1', 'true')}
union all {_srl_f1('srl_sense', 'p = -1 and known', 'g = q')} union all {_srl_f1('srl_roles', 'p >= 0 and known', 'g = q')} union all {_srl_f1('srl_all', 'known', 'g = q')}""",
    "pred_senses": f"{TOKS} select lower(word) as lemma, string_agg(distinct word || '.0' || tok % 2, ' ' order by word || '.0' || tok % 2) as senses from toks where pos like 'V%' group by 1",
    "role_pairs": f"""{TOKS} select case when t.parent = p.tok then 'A' || length(t.pos) else '_' end as label, count(*) as cnt from toks p join toks t on t.sent_id = p.sent_id and t.tok <> p.tok where p.pos like 'V%' group by 1""",
    "arc_features": f"""{TOKS}, x as (select t.sent_id, t.parent as p, t.tok as c, t.pos as cpos, h.pos as ppos, coalesce(b.pos, 'BOS') as bpos, t.tok - t.parent as d, t.n from toks t join toks h on h.sent_id = t.sent_id and h.tok = t.parent
  left join toks b on b.sent_id = t.sent_id and b.tok = t.tok - 1
), bags as (select x.sent_id, x.c, string_agg(distinct m.pos, '_' order by m.pos) as bag from x join toks m on m.sent_id = x.sent_id and m.tok > least(p, c) and m.tok < greatest(p, c) group by 1, 2
), f as (select 'pos(p)+pos(c)+RELATIVE' as template, ppos || '_' || cpos || '_' || case when p < c then 'BEFORE' else 'AFTER' end as feature from x
  union all select 'pos(before1(c))+DISTANCE', bpos || '_' || abs(d) from x
  union all select 'EDGE+DIRECTION_EDGE+SENT_LEN', 'T_T_' || case when n >= 40 then 40 when n >= 30 then 30 when n >= 20 then 20 when n >= 10 then 10 when n >= 5 then 5 when n >= 2 then 2 else 0 end from x
  union all select 'bag(pos(between))', coalesce(bag, '') from x left join bags on x.sent_id = bags.sent_id and x.c = bags.c)
select template, feature, count(*) as cnt from f group by 1, 2""",
    "tag_feature_counts": f"""{TOKS}, w as (select word, tok, n, lag(word, 1, 'BOS') over w as a1, lag(word, 2, 'BOS') over w as a2, lead(word, 1, 'EOS') over w as b1, lead(word, 2, 'EOS') over w as b2 from toks window w as (partition by sent_id order by tok))
select 'w-2' as template, count(distinct a2) as n_features from w union all select 'w-1', count(distinct a1) from w union all select 'w+0', count(distinct word) from w union all select 'w+1', count(distinct b1) from w union all select 'w+2', count(distinct b2) from w
{" ".join(f"union all select 'pre{i}', count(distinct left(word, {i})) from w union all select 'suf{i}', count(distinct right(word, {i})) from w" for i in range(1, 5))}""",
    "info_gain": f"""{TOKS}, f0 as (select pos, word, lag(word, 1, 'BOS') over w as a1, lag(word, 2, 'BOS') over w as a2, lead(word, 1, 'EOS') over w as b1, lead(word, 2, 'EOS') over w as b2 from toks window w as (partition by sent_id order by tok)
), f as (select 'w-2' as template, a2 as feature, pos as v from f0 union all select 'w-1', a1, pos from f0 union all select 'w+0', word, pos from f0 union all select 'w+1', b1, pos from f0 union all select 'w+2', b2, pos from f0
  {" ".join(f"union all select 'pre{i}', left(word, {i}), pos from f0 union all select 'suf{i}', right(word, {i}), pos from f0" for i in range(1, 5))}
), j as (select template, feature, v, count(*)::double as n from f group by 1, 2, 3
), m as (select template, n, sum(n) over (partition by template, feature) as nf, sum(n) over (partition by template, v) as nv, sum(n) over (partition by template) as nt from j
), g as (select template, round(sum(n / nt * log2(n * nt / (nf * nv))), 6) as ig from m group by 1)
select template, ig, row_number() over (order by ig desc, template)::int as rank, case when row_number() over (order by ig desc, template) <= 2 then 'Y' else 'N' end as selected from g""",
    "collisions": f"""{TOKS}, types as (select word, count(*)::bigint as cnt, hex(encode(word)) as hx from toks group by 1
), bytes as (select word, cnt, list_transform(range(0, len(hx) // 2), lambda i: ((instr('0123456789ABCDEF', substr(hx, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hx, 2 * i + 2, 1)) - 1)::ubigint) as b from types
), blocks as (
  select word, cnt, len(b)::ubigint as n, list_transform(range(0, len(b) // 4), lambda i: b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216) as ks,
    coalesce(b[len(b) // 4 * 4 + 1], 0) * (len(b) % 4 > 0)::int + coalesce(b[len(b) // 4 * 4 + 2], 0) * 256 * (len(b) % 4 > 1)::int + coalesce(b[len(b) // 4 * 4 + 3], 0) * 65536 * (len(b) % 4 > 2)::int as tail from bytes
), turned as (
  select word, cnt, n, list_transform(list_transform(ks, lambda k: (k * 3432918353) & {M32}), lambda k: (((k * 32768) & {M32} | (k >> 17)) * 461845907) & {M32}) as ks, (tail * 3432918353) & {M32} as t from blocks
), body as (
  select word, cnt, n, list_reduce(list_prepend(123456789::ubigint, ks), lambda h, k: (((xor(h, k) * 8192) & {M32} | (xor(h, k) >> 19)) * 5 + 3864292196) & {M32}) as h, (((t * 32768) & {M32} | (t >> 17)) * 461845907) & {M32} as t from turned
), f1 as (select word, cnt, xor(xor(h, t), n) as h from body
), f2 as (select word, cnt, (xor(h, h >> 16) * 2246822507) & {M32} as h from f1
), f3 as (select word, cnt, (xor(h, h >> 13) * 3266489909) & {M32} as h from f2
), hashed as (
  select word, cnt, xor(h, h >> 16)::bigint as h, (list_sum(list_transform(range(0, least(length(word), 7)), lambda i: unicode(substr(word, i + 1, 1))::bigint * (32 ** i)::bigint)) % 4294967296) >= 2147483648 as minus from f3
), each as (select size, cnt, minus, (((case when h >= 2147483648 then h - 4294967296 else h end) % size) + size) % size as i from hashed, (values (4096), (65536), (1048576)) s(size)
), per as (select size, i, count(*) as types, sum(cnt) as toks, count(*) filter (where minus) as m, abs(sum(case when minus then -cnt else cnt end)) as v from each group by 1, 2)
select size::int as size, round(sum(case when types > 1 then types else 0 end) / sum(types), 9) as type_rate, round(sum(case when types > 1 then toks else 0 end) / sum(toks), 9) as token_rate, sum(m)::bigint as n_minus, sum(v)::bigint as weight from per group by 1""",
    "crossing": f"""{TOKS}, moved as (select sent_id, tok, case when tok % 3 = 0 and parent >= 1 then parent - 2 else parent end as p from toks), arc as (select sent_id, tok, least(p, tok) as a, greatest(p, tok) as b from moved
), cross_ as (select distinct x.sent_id, x.tok from arc x join arc y on x.sent_id = y.sent_id and (x.a < y.a and y.a < x.b and x.b < y.b or y.a < x.a and x.a < y.b and y.b < x.b))
select s.sent_id, coalesce(string_agg(tok::varchar, ' ' order by tok), '') as crossing from sents s left join cross_ c on c.sent_id = s.sent_id group by 1""",
    "second_order": f"""{TOKS}{_scores(2, 0.0)}, arc as (select sent_id, p, c from top where best
), triples as (
  select 'grandparent' as kind, u.sent_id, u.p as h, u.c as m, t.c as s, case when u.p < u.c then 'R' else 'L' end || case when u.c < t.c then 'R' else 'L' end || case when u.p < t.c then 'R' else 'L' end as flags from arc u join arc t on t.sent_id = u.sent_id and t.p = u.c where u.p <> t.c
  union all select 'sibling', u.sent_id, u.p, u.c, t.c, case when u.p < u.c then 'R' else 'L' end || case when t.p < t.c then 'R' else 'L' end from arc u join arc t on t.sent_id = u.sent_id and t.p = u.p and u.c < t.c
  union all select 'consecutive', sent_id, p, c, nx, case when p < c then 'R' else 'L' end || case when p < nx then 'R' else 'L' end from (select *, lead(c) over (partition by sent_id, p order by c) as nx from arc) where nx is not null
  union all select 'bigram', u.sent_id, t.p, u.p, t.c, case when t.p < t.c then 'R' else 'L' end || case when u.p < u.c then 'R' else 'L' end from arc u join arc t on t.sent_id = u.sent_id and t.c = u.c + 1
), f as (
  select x.*, coalesce(a.pos, 'WALL') as ht, coalesce(a.word, 'WALL') as hw, coalesce(b.pos, 'WALL') as mt, coalesce(b.word, 'WALL') as mw, c.pos as st, c.word as sw
  from triples x left join toks a on a.sent_id = x.sent_id and a.tok = h left join toks b on b.sent_id = x.sent_id and b.tok = m join toks c on c.sent_id = x.sent_id and c.tok = s)
{" union all ".join(f"select kind, '{name}' as template, count(*) as cnt, count(distinct flags{parts}) as types, sum(s)::bigint as places from f group by 1" for name, parts in _TRIPLE_SQL.items())}""",
    "candidate_features": f"""{TOKS}{_scores(2, 0.0)}, f as (
  select a.p, a.c, coalesce(x.pos, 'BOS') as pt, coalesce(x.word, 'BOS') as pw, y.pos as ct, y.parent as cp, x.parent as pp from top a left join toks x on x.sent_id = a.sent_id and x.tok = a.p join toks y on y.sent_id = a.sent_id and y.tok = a.c where best)
select 'pos(p)+pos(c)+RELATIVE+DISTANCE' as template, count(*) as cnt, count(distinct (pt, ct, p < c, abs(p - c))) as types from f union all select 'word(p)+pos(c)', count(*), count(distinct pw || '_' || ct) from f
union all select 'EDGE+DIRECTION_EDGE', count(*), count(distinct (cp = p or coalesce(pp = c, false), cp = p)) from f""",
    "jackknife_majority": f"""{TOKS}, x as (select (doc_id % 5)::int as fold, lower(word) as word, pos, ppos from toks
), c as (select fold, word, ppos, count(*) as n from x group by 1, 2, 3
), t as (select word, ppos, sum(n) as n from c group by 1, 2
), o as (select f.fold, f.word, t.ppos, t.n - coalesce(c.n, 0) as n from (select distinct fold, word from x) f join t on f.word = t.word left join c on c.fold = f.fold and c.word = f.word and c.ppos = t.ppos
), best as (select fold, word, ppos as pred from (select *, row_number() over (partition by fold, word order by n desc, ppos desc) as r from o where n > 0) where r = 1)
select x.fold, count(*) as n, count(pred) as n_known, count(*) filter (where pred = pos) as n_correct from x left join best b on x.fold = b.fold and x.word = b.word group by 1""",
    "layer_table": """
with x as (select text, lang, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id
), r as (select unnest(['text', 'lang', 'quality', 'toxic']) as layer, unnest([avg((text is not null)::int), avg((lang is not null)::int), avg((quality is not null)::int), avg((toxic is not null)::int)]) as prop from x)
select layer, prop > 0 as some_have, prop = 1 as all_have, round(prop, 9) as prop from r
""",
}
