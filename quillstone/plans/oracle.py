"""The registered queries as SQL for another engine, over the same tables. Written from the definitions, not from the plans."""

from __future__ import annotations

from quillstone.functions.stemming import stem_sql

DOCS = """docs as (
    select 'd' || doc_id as id, doc_id, source as repository, lang || '/d' || doc_id || '.md' as path, array_to_string(list_slice(string_split(text, ' '), 1, 5), ' ') as title,
        1700000000 - doc_id * 86400 as updated_at, case doc_id % 3 when 0 then 'resource' when 1 then 'memory' else 'skill' end as category, sha256(text) as content_hash, lang, text as content
    from documents)"""
CHUNKS = """worded as (select id, content, list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '') as w from docs),
chunks as (
    select id || '#0' as id, id as document_id, 0 as chunk_index, content from worded where len(w) between 1 and 200
    union all
    select id || '#' || i, id, i::int, array_to_string(list_slice(w, i * 170 + 1, i * 170 + 200), ' ')
    from (select id, w, unnest(range(0, ((len(w) - 200 + 169) // 170) + 1)) as i from worded where len(w) > 200))"""
EDGES = """edges as (
    select 'd' || doc_id as src, 'd' || ((7 * doc_id + 1) % n) as dst, 'links_to' as relation, 'EXTRACTED' as status, 1.0::double as weight from documents, (select count(*) as n from documents)
    union all select 'd' || doc_id, 'd' || ((13 * doc_id + 5) % n), 'depends_on', 'INFERRED', 0.6 from documents, (select count(*) as n from documents) where doc_id % 3 = 0
    union all select 'd' || doc_id, '#' || lang, 'tagged_as', 'TAG', 0.3 from documents)"""
VECTORS = """vectors as (select 'd' || (vec_id % n) || '#' || (vec_id // n) as chunk_id, vec_id, embedding::double[] as e, embedding from embeddings, (select count(*) as n from documents)),
qv as (select embedding::double[] as q from embeddings where vec_id = 0)"""
SMALL = """business as (
    select 'c' || c_custkey as src, 'n' || c_nationkey as dst, 'part_of' as relation, 1.0::double as w from customer
    union all select 's' || s_suppkey, 'n' || s_nationkey, 'part_of', 1.0 from supplier
    union all select 'n' || n_nationkey, 'r' || n_regionkey, 'part_of', 1.0 from nation
    union all select distinct 'p' || l_partkey, 's' || l_suppkey, 'depends_on', 0.6 from lineitem
    union all select 'p' || p_partkey, '#' || p_brand, 'tagged_as', 0.3 from part)"""
CODE = """files as (select s_suppkey as id, 'src/' || s_name as path, ['go', 'python', 'rust', 'java', 'typescript'][s_nationkey % 5 + 1] as language from supplier),
symbols as (
    select p_partkey as id, p_partkey % ((select count(*) from supplier) - 3) + 1 as file_id, ['function', 'class', 'method', 'import'][p_size % 4 + 1] as kind, 'f' || (p_partkey % 97) as name,
        regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || '.f' || (p_partkey % 97) as qualified_name, p_name as signature, p_size as start_line from part),
items as (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem group by 1, 2),
calls as (select distinct a.l_partkey as src, b.l_partkey as dst, 'calls' as kind from items a join items b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_partkey <> b.l_partkey)"""
LOG = """log as (
    select event_id + 1 as sequence, 'e' || event_id as event_id, event_type, user_id as aggregate_id, props as payload, ts as created_at,
        case when event_id % 5 = 0 then '2024-01-01' when event_id % 7 = 0 then '2024-01-01|bad' end as acked_at from events)"""
SEVERITY = """case when regexp_matches(lower(relation), 'implement|depend|contradict|block|supersede') then case when depth <= 1 then 'CRITICAL' else 'HIGH' end
    when regexp_matches(lower(relation), 'link|refer|relate') and depth <= 1 then 'MEDIUM' else 'LOW' end"""
NOTES = """notes as (
    select 'd' || doc_id as id, 1700000000 - doc_id * 86400 as updated_at,
        lower(coalesce(text, '') || repeat(' ./pkg/F' || (doc_id % 80) || '.go', (doc_id % 3)::int) || case when doc_id % 5 = 0 then ' ./pkg/F' || (doc_id % 80) || '.gox,' else '' end) as content
    from documents),
changes as (select 'pkg/f' || p_partkey || '.go' as path, ['A', 'M', 'D', 'R'][p_partkey % 4 + 1] as status, p_size::bigint as additions, (p_size * 2)::bigint as deletions from part),
named as (select id, updated_at, path, additions, deletions from notes join changes on contains(content, path) where (len(content) - len(replace(content, path, ''))) // len(path) >= 2)"""
DRIFT = """m as (select id, updated_at, count(*) as paths, sum(additions + deletions) as churn from named group by 1, 2),
r as (select id, paths, greatest(1, (select count(*) from nation where 1700000000 - n_nationkey * 864000 > m.updated_at)) as commits_behind, churn from m),
s as (select id, paths::bigint as paths, commits_behind, churn::bigint as churn, round(least(100.0, least(40.0, 12.0 * commits_behind) + least(15.0, 30.0 * 0.015) + least(25.0, 5.0 * ln(1 + churn))), 1) as score from r),
drift as (select *, case when score >= 75 then 'CRITICAL' when score >= 55 then 'HIGH' when score >= 30 then 'MEDIUM' else 'LOW' end as severity from s)"""
DIRTY = """dirty as (
    select src, case when n % 50 = 0 and relation = 'links_to' then 'x' || n when n % 70 = 0 and relation = 'links_to' then src else dst end as dst, relation
    from (select *, regexp_extract(src, '(\\d+)', 1)::bigint as n from edges) where n % 9 <> 0),
dead as (select src, dst, relation from dirty where dst not like '#%' and dst not in (select id from docs) and dst not in (select title from docs where title is not null))"""


def _bm25(terms: list[str], chunks: str = "chunks", name: str = "hits") -> str:
    """CTEs that leave `name` (chunk_id, score): chunks with all terms."""
    tf = ", ".join(f"count(*) filter (stem = '{q}') as tf{i}" for i, q in enumerate(terms))
    got = ", ".join(f"coalesce(tf{i}, 0) as tf{i}" for i in range(len(terms)))
    df = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(terms)))
    idf = lambda i: f"(case when ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 then 1e-6 else ln((n - df{i} + 0.5) / (df{i} + 0.5)) end)"
    score = " + ".join(f"{idf(i)} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg_len))" for i in range(len(terms)))
    return f"""{name}_t as (select id as chunk_id, regexp_extract_all(lower(strip_accents(content)), '[\\p{{L}}\\p{{Nd}}]+') as t from {chunks}),
{name}_w as (select chunk_id, unnest(t) as word from {name}_t), {stem_sql(f'{name}_w', f'{name}_st')},
{name}_f as (select chunk_id, {tf} from {name}_w join {name}_st using (word) group by chunk_id),
{name}_c as (select t.chunk_id, len(t) as len, {got} from {name}_t t left join {name}_f f on f.chunk_id = t.chunk_id),
{name}_s as (select count(*) as n, avg(len) as avg_len, {df} from {name}_c),
{name} as (select chunk_id, {score} as score from {name}_c, {name}_s where {' and '.join(f'tf{i} > 0' for i in range(len(terms)))})"""


def _hybrid(limit: int = 5, category: str = "", decay: bool = False, tail: str = "", repository: str = "", mode: str = "hybrid") -> str:
    many = max(10, 2 * limit)
    some = f"picked as (select c.* from chunks c join docs d on d.id = c.document_id where d.repository = '{repository}')" if repository else "picked as (select * from chunks)"
    of_kind = f"where item in (select c.id from chunks c join docs d on d.id = c.document_id where d.category = '{category}')" if category else ""
    factor = "* (0.7 + 0.3 * pow(2.0, -greatest(1700000000 - updated_at, 0) / (30.0 * 86400)))" if decay else ""
    lists = "select 'fts' as source, * from lex" + (" union all select 'vector', * from vec union all select 'graph', * from gra" if mode == "hybrid" else "")
    return f"""with {DOCS}, {CHUNKS}, {VECTORS}, {EDGES}, {some}, {_bm25(['the', 'of', 'and'], 'picked')},
lex as (select chunk_id as item, row_number() over (order by score desc, chunk_id) as rank from hits qualify rank <= {many}),
vec as (select chunk_id as item, row_number() over (order by 1 - list_cosine_similarity(e, q), chunk_id) as rank from vectors, qv where chunk_id in (select id from picked) {'' if repository else 'or true'} qualify rank <= {many}),
firsts as (
    select document_id, min(rank) filter (s = 0) as a, min(rank) filter (s = 1) as b
    from (select *, 0 as s from lex union all select *, 1 from vec) x join picked c on c.id = x.item group by document_id),
ordered as (select *, case when a is not null and row_number() over (order by a is null, a, document_id) <= 3 then row_number() over (order by a is null, a, document_id) end as p from firsts),
seeds as (select document_id, row_number() over (order by p is null, p, b is null, b, document_id) as seed from ordered where p is not null or b is not null qualify seed <= 6),
near as (select dst as n, min(seed) as seed from edges join seeds on src = document_id group by dst),
gra as (select c.id as item, row_number() over (order by seed, c.document_id, chunk_index) as rank from picked c join near on n = c.document_id where chunk_index < 2),
lists as (select * from ({lists}) {of_kind}),
fused as (select item as chunk_id, sum(1.0::double / (60 + rank)) as score, count(*) as n_sources, string_agg(source || ':' || rank, ',' order by case source when 'fts' then 0 when 'vector' then 1 else 2 end) as sources from lists group by item),
scored as (select f.chunk_id, c.document_id, score {factor} as score, n_sources, sources, d.category, d.title, c.content from fused f join picked c on c.id = f.chunk_id left join docs d on d.id = c.document_id),
top as (select row_number() over (order by round(score, 12) desc, n_sources desc, chunk_id, document_id) as rank, * from scored qualify rank <= {limit})
{tail or "select rank::int as rank, chunk_id, document_id, round(score, 9) as score, n_sources, sources, category, title from top"}"""


ABSTRACT = """(select case when length(x) > 160 then substr(x, 1, 157) || '...' else x end from (select coalesce(list_filter(list_transform(string_split({0}, chr(10)), lambda s: trim(s)), lambda s: s <> '' and s[1] <> '#')[1], '') as x))"""


def _ranks(n: int, edges: str) -> str:
    """CTEs that leave `ranks` (node, rank) after n steps over edges (src, dst, w)."""
    steps = "".join(
        f""", r{k} as materialized (
    select v.node, 0.15::double / nn + 0.85 * (select coalesce(sum(rank), 0) from r{k - 1} where node not in (select src from share)) / nn + 0.85 * coalesce(g.got, 0) as rank
    from r{k - 1} v, total left join (select dst, sum(p * rank) as got from share join r{k - 1} on node = src group by dst) g on g.dst = v.node)"""
        for k in range(1, n + 1)
    )
    return f"""flat as (select src, dst, sum(w) as w from {edges} group by 1, 2), share as materialized (select src, dst, w / sum(w) over (partition by src) as p from flat),
nodes as (select src as node from flat union select dst from flat), total as (select count(*)::double as nn from nodes), r0 as materialized (select node, 1 / nn as rank from nodes, total){steps},
ranks as (select node, rank / (select sum(rank) from r{n}) as rank from r{n})"""


OWN_RANKS = _ranks(3, "(select src, dst, weight as w from edges)")


def _path(cost: str) -> str:
    return f"""with recursive {EDGES}, e as (select src, dst, min({cost})::double as c from edges where relation <> 'tagged_as' group by 1, 2),
ways as (
    select 'd3' as node, 0 as hops, 0.0::double as cost, ['d3'] as path
    union all select e.dst, hops + 1, cost + c, list_append(path, e.dst) from ways join e on e.src = node where hops < 4 and not list_contains(path, e.dst))
select hops, round(cost, 3) as cost, array_to_string(path, '>') as path from ways where node = 'd86' order by round(cost, 9), hops, 3 limit 1"""


def _walk(a: str, b: str) -> str:
    return f"""with recursive {CODE}, walk as (select {b} as id, 1 as hop, kind from calls where {a} = 10 union all select e.{b}, hop + 1, e.kind from walk w join calls e on e.{a} = w.id where hop < 3)
select w.id, hop, w.kind, s.qualified_name, count(*) as ways from walk w join symbols s on s.id = w.id join files f on f.id = s.file_id group by all"""


NEAR2 = f"""with recursive {EDGES}, {DOCS}, links as (select src, dst from edges where relation <> 'tagged_as'),
walk as (select 'd3' as node, 0 as depth union all select l.dst, depth + 1 from walk join links l on l.src = node where depth < 2),
near as (select node, min(depth)::int as depth from walk group by node),
items as (
    select near.node, near.depth, (ceil(length(trim(title || chr(10) || content)) / 4.0)::bigint + case when depth = 0 then 0 else 20 end) as full_, (ceil(length(trim(title || chr(10) || {ABSTRACT.format('content')})) / 4.0)::bigint + 15) as less_,
        row_number() over (order by depth, near.node) as k from near join docs on docs.id = near.node),
fold as (
    select 0::bigint as k, 1500::bigint as left_, ''::varchar as node, 0 as depth, 0::bigint as tokens, ''::varchar as place
    union all
    select i.k, case when i.full_ <= f.left_ then f.left_ - i.full_ when i.less_ <= f.left_ then f.left_ - i.less_ else f.left_ end, i.node, i.depth,
        case when i.full_ <= f.left_ then i.full_ when i.less_ <= f.left_ then i.less_ else 0 end, case when i.full_ <= f.left_ then 'core' when i.less_ <= f.left_ then 'fringe' else 'omitted' end
    from fold f join items i on i.k = f.k + 1)
select node, (k - 1)::int as position, depth, tokens, place from fold where k > 0"""
EGO = f"""with recursive {EDGES}, links as (select src, dst from edges where relation <> 'tagged_as'), both_ as (select src, dst from links union select dst, src from links),
walk as (select 'd5' as node, 0 as depth union all select b.dst, depth + 1 from walk join both_ b on b.src = node where depth < 2),
ego as (select node, min(depth)::int as depth from walk group by node)"""
IMPACT = f"""with {EDGES}, one as (select src as node, relation, dst as via, 1 as depth from edges where dst = 'd7' and src <> 'd7'),
two as (select src as node, relation, dst as via, 2 as depth from edges where dst in (select node from one) and src <> 'd7' and src not in (select node from one)),
found as (select *, {SEVERITY} as severity from (select * from one union all select * from two)),
ordered as (select *, row_number() over (partition by node order by case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end, relation, via) as k from found),
impact as (select node, depth, relation, via, severity from ordered where k = 1)"""
DEGREES = "select node, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree, count(*) as total from (select src as node, 0 as i, 1 as o from {0} union all select dst, 1, 0 from {0}) group by node"
DAMPED = "0.7 + 0.3 * pow(2.0, -greatest(1700000000 - updated_at, 0) / (30.0 * 86400))"

TYPE = """(case when regexp_matches(lower({0}), 'decision|adr') then 'decision' when contains(lower({0}), 'concept') then 'concept' when regexp_matches(lower({0}), 'guide|howto|tutorial') then 'guide'
    when regexp_matches(lower({0}), 'synthes|compiled') then 'synthesis' when regexp_matches(lower({0}), 'reference|doc') then 'reference' else 'other' end)"""

SQL = {
    "hybrid_search": _hybrid(),
    "hybrid_search_decay": _hybrid(10, decay=True),
    "search_level_l0": _hybrid(tail=f"""select row_number() over (order by round(score, 12) desc, n_sources desc, chunk_id, document_id)::int as rank, document_id, round(score, 9) as score, {ABSTRACT.format('content')} as abstract
from (select *, row_number() over (partition by document_id order by round(score, 12) desc, chunk_id) as k from scored) where k = 1 qualify rank <= 5"""),
    "category_filter": _hybrid(category="memory"),
    "fts_bm25": f"with {DOCS}, {CHUNKS}, {_bm25(['the', 'of', 'and'])} select chunk_id, round(score, 9) as score from hits order by hits.score desc, chunk_id limit 20",
    "knn_cosine": f"with {VECTORS} select chunk_id, round(1 - list_cosine_similarity(e, q), 6) as distance from vectors, qv order by 1 - list_cosine_similarity(e, q), chunk_id limit 10",
    "knn_l2": f"with {VECTORS} select chunk_id, round(list_distance(e, q), 6) as distance from vectors, qv order by list_distance(e, q), chunk_id limit 10",
    "quant4_codes": f"""with {VECTORS}, coded as (
    select chunk_id, list_transform(e, lambda x: (case when m = 0 then 7 else sign(x / m * 7) * floor(abs(x / m * 7) + 0.5) + 7 end)::int) as c from (select *, list_max(list_transform(e, lambda x: abs(x))) as m from vectors))
select chunk_id, array_to_string(list_transform(range(len(c) // 2), lambda i: substr('0123456789abcdef', c[2 * i + 2] + 1, 1) || substr('0123456789abcdef', c[2 * i + 1] + 1, 1)), '') as code from coded""",
    "rrf_two_sources": f"""with {DOCS}, {CHUNKS}, {VECTORS}, {_bm25(['the', 'of', 'and'])},
lists as (
    (select 'fts' as source, chunk_id as item, row_number() over (order by score desc, chunk_id) as rank from hits qualify rank <= 10)
    union all (select 'vector', chunk_id, row_number() over (order by 1 - list_cosine_similarity(e, q), chunk_id) as rank from vectors, qv qualify rank <= 10))
select item, round(sum(1.0::double / (60 + rank)), 9) as score, count(*) as n_sources, string_agg(source || ':' || rank, ',' order by case source when 'fts' then 0 when 'vector' then 1 else 2 end) as sources from lists group by item""",
    "time_decay": f"with {DOCS} select id, round(case when updated_at <= 0 then 1.0 else {DAMPED} end, 9) as decay from docs",
    "federated_merge": f"""with {DOCS}, {CHUNKS}, en as (select c.* from chunks c join docs d on d.id = c.document_id where lang = 'en'), {_bm25(['the', 'of'], 'en', 'lo')}, {_bm25(['the', 'of', 'and'], 'chunks', 'ce')},
lists as (
    (select 'local' as source, chunk_id as item, row_number() over (order by score desc, chunk_id) as rank from lo qualify rank <= 10)
    union all (select 'central', chunk_id, row_number() over (order by score desc, chunk_id) as rank from ce qualify rank <= 10))
select item, round(sum(1.0::double / (60 + rank)), 9) as score, case when count(*) > 1 then '[local+central]' else '[' || min(source) || ']' end as origin from lists group by item
order by round(sum(1.0::double / (60 + rank)), 12) desc, item limit 10""",
    "latent_pairs_jaccard": f"""with {DOCS}, {EDGES}, t as (select id, repository, list_distinct(list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: strlen(w) >= 3)) as t from docs),
p as (select a.id as a, b.id as b, case when len(a.t) = 0 or len(b.t) = 0 then 0.0 else len(list_intersect(a.t, b.t))::double / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) end as s from t a join t b on a.repository = b.repository and a.id < b.id)
select a, b, round(s, 6) as similarity from p where s >= 0.5 and not exists (select 1 from edges where least(src, dst) = a and greatest(src, dst) = b) order by round(s, 9) desc, a, b limit 50""",
    "latent_pairs_cosine": f"""with {DOCS}, {CHUNKS}, {VECTORS}, {EDGES}, t as (select c.document_id as id, repository, e from vectors v join chunks c on c.id = v.chunk_id join docs d on d.id = c.document_id),
p as (select a.id as a, b.id as b, max(list_cosine_similarity(a.e, b.e)) as s from t a join t b on a.repository = b.repository and a.id < b.id group by 1, 2)
select a, b, round(s, 6) as similarity from p where s >= 0.3 and not exists (select 1 from edges where least(src, dst) = a and greatest(src, dst) = b) order by round(s, 9) desc, a, b limit 50""",
    "hub_degrees": f"with {SMALL}, b as (select src, dst from business union all select 'o' || o_orderkey, 'c' || o_custkey from orders) {DEGREES.format('b')} order by total desc, in_degree desc, node limit 20",
    "neighbors_k2": f"with {EDGES} select distinct dst as node from edges where src = 'd3' or src in (select dst from edges where src = 'd3')",
    "ego_graph": f"{EGO} select node, depth from ego",
    "pagerank_5it": f"with {SMALL}, b as (select src, dst, w from business union all select 'o' || o_orderkey, 'c' || o_custkey, 1.0 from orders), {_ranks(5, 'b')} select node, round(rank, 9) as rank from ranks",
    "modularity_by_nation": """with e as (
    select 'c' || c_custkey as src, 'n' || c_nationkey as dst from customer union all select 's' || s_suppkey, 'n' || s_nationkey from supplier union all select 'o' || o_orderkey, 'c' || o_custkey from orders),
c as (select 'c' || c_custkey as node, c_nationkey as k from customer union all select 's' || s_suppkey, s_nationkey from supplier union all select 'n' || n_nationkey, n_nationkey from nation union all select 'o' || o_orderkey, c_nationkey from orders join customer on o_custkey = c_custkey),
b as (select x.k as a, y.k as b from e join c x on x.node = src join c y on y.node = dst), m as (select 2.0 * count(*) as m2 from b),
t as (select k, count(*) as tot from (select a as k from b union all select b from b) group by k), i as (select a as k, 2 * count(*) as inn from b where a = b group by a)
select round(sum(coalesce(inn, 0) / m2 - pow(tot / m2, 2)), 9) as q from t left join i using (k), m""",
    "impact_depth2": f"{IMPACT} select node, depth, relation, via, severity from impact",
    "impact_summary": f"""{IMPACT}, {OWN_RANKS}, a as (
    select count(*) filter (depth = 1) as direct, count(*) filter (depth > 1) as indirect, count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'MEDIUM') as medium, count(*) filter (severity = 'LOW') as low,
        sum(case severity when 'CRITICAL' then 1.0 when 'HIGH' then 0.7 when 'MEDIUM' then 0.4 else 0.1 end::double / depth * (1 + 10 * coalesce(rank, 0))) as raw from impact left join ranks using (node)),
r as (select *, round(100 * (1 - 1 / (1 + coalesce(raw, 0) / 5)), 1) as risk from a)
select direct, indirect, critical, high, medium, low, risk, case when risk >= 75 then 'CRITICAL' when risk >= 50 then 'HIGH' when risk >= 25 then 'MEDIUM' else 'LOW' end as level from r""",
    "path_epistemic": _path("1.0::double / weight"),
    "path_hops": _path("1.0::double"),
    "graph_stats": f"""with {EDGES}, d as ({DEGREES.format('edges')}), a as (select count(*) as nodes, (sum(total) / 2)::bigint as edges, max(total) as max_degree, avg(total) as avg_degree, count(*) filter (total >= 4) as hubs from d)
select *, edges::double / (nodes * (nodes - 1)) as density from a""",
    "graph_view": f"""with {EDGES}, {OWN_RANKS}, d as ({DEGREES.format('edges')}), t as (select max(rank) as top from ranks)
select node, {TYPE.format('node')} as type, total as degree, round(8 + 20 * rank / top + case when node = 'd5' then 6 else 0 end, 1) as radius, total >= 4 or rank / top > 0.6 as hub,
    case when node = 'd5' then '#f59e0b' when {TYPE.format('node')} = 'other' then '#64748b' else '#f43f5e' end as color from d join ranks using (node), t""",
    "pack_context": NEAR2,
    "pack_inbound": NEAR2.replace("links as (select src, dst from edges", "links as (select dst as src, src as dst from edges"),
    "events_replayed": f"""with {LOG}, subs as (select unnest(['all', 'buy', 'c', 'none']) as subscriber, unnest(['.*', 'purchase', 'c[^/]*', 'zzz']) as pattern)
select subscriber, sequence, event_id, event_type from log join subs on regexp_full_match(event_type, pattern) where sequence between 100 and 900""",
    "inspect_node": f"""with {EDGES}, {DOCS}, {OWN_RANKS}, r as (select 'in' as side, src as node, relation, 1 as depth from edges where dst = 'd7' union all select 'out', dst, relation, 1 from edges where src = 'd7')
select side, node, relation, {SEVERITY} as severity, node in (select id from docs) as exists, round(coalesce(rank, 0), 9) as rank from r left join ranks using (node)""",
    "canvas_layout": f"""{EGO}, o as (select node, row_number() over (order by node) - 1 as i, count(*) over () as n from ego where node <> 'd5'), a as (select node, 2 * pi() * i / n as a, case when n <= 8 then 420.0 when n <= 16 then 550.0 else 700.0 end as r from o)
select node, round(r * cos(a))::bigint as x, round(r * sin(a))::bigint as y, case when cos(a) > 0.5 then 'right' when cos(a) < -0.5 then 'left' when sin(a) > 0 then 'bottom' else 'top' end as side from a""",
    "node_resolution": f"""with {DOCS}, t as (select id, case when id = 'fr/d' or path in ('fr/d', 'fr/d.md') then 0 when lower(title) = 'fr/d' then 1 when lower(title) like 'fr/d%' or lower(path) like 'fr/d%' then 2 when lower(title) like '%fr/d%' or lower(path) like '%fr/d%' then 3 end as tier from docs)
select id from t where tier is not null order by tier, id limit 1""",
    "node_types": f"with {EDGES} select {TYPE.format('node')} as type, count(*) as nodes from (select src as node from edges union select dst from edges) group by 1",
    "edge_weights": f"with {EDGES} select relation, count(*) as edges, round(sum(weight), 6) as weight from edges group by 1",
    "chunk_200_30": f"with {DOCS}, {CHUNKS} select id, document_id, chunk_index, md5(content) as content_md5 from chunks",
    "content_hash": f"with {DOCS} select id, content_hash from docs where doc_id % 4 = 0",
    "fallback_abstract": f"with {DOCS} select id, {ABSTRACT.format('content')} as abstract, ceil(length(trim(content)) / 4.0)::bigint as tokens from docs",
    "hub_names": f"""with {EDGES}, {DOCS}, g as ({DEGREES.format('edges')} order by total desc, in_degree desc, node limit 20)
select node, in_degree, out_degree, total, coalesce(nullif(trim(title), ''), node) as name from g left join docs on id = node""",
    "pagerank_order": f"""with {EDGES}, {OWN_RANKS}, g as ({DEGREES.format('edges')}) select row_number() over (order by round(rank, 12) desc, in_degree desc, node)::int as place, node, round(rank, 6) as rank, in_degree from ranks join g using (node) qualify place <= 25""",
    "event_json_filter": f"with {LOG} select sequence, event_id, event_type from log where json_extract_string(payload, '$.k') = '69'",
    "search_repository": _hybrid(repository="src3"),
    "search_fts_mode": _hybrid(mode="fts"),
    "symbol_case": f"with {CODE} select id, name as last from symbols where regexp_matches(qualified_name, '[A-Z]') and regexp_matches(qualified_name, '[a-z]')",
    "ordered_merge": f"""with {EDGES}, a as (select src, list(dst order by dst) as o from edges group by src), b as (select dst as src, list(src order by src desc) as i from edges group by dst),
c as (select src, unnest(list_concat(o, coalesce(i, []))) as x, generate_subscripts(list_concat(o, coalesce(i, [])), 1) as k from a left join b using (src)),
d as (select src, x, min(k) as k from c group by src, x) select src, string_agg(x, ',' order by k) as neighbors from d group by src""",
    "first_non_empty": f"""with {DOCS} select id as chunk_id, case when doc_id % 2 = 0 then 'two' else 'one' end as content, 'short' as abstract, category, updated_at, 'x,' || lang || ',y' as neighbors from docs""",
    "zero_vectors": f"with {DOCS}, {CHUNKS}, {VECTORS} select c.id, 64 as dim, v.chunk_id is null as zero from chunks c left join vectors v on v.chunk_id = c.id",
    "fts_unindexed": f"with {DOCS}, {CHUNKS}, {_bm25(['the', 'of', 'and'])} select chunk_id, round(score, 9) as score from hits order by hits.score desc, chunk_id limit 20",
    "fts_phrase": f"""with {DOCS}, {CHUNKS}, t as (select id as chunk_id, regexp_extract_all(lower(strip_accents(content)), '[\\p{{L}}\\p{{Nd}}]+') as t from chunks),
tw as (select chunk_id, unnest(t) as word, generate_subscripts(t, 1) as i from t), {stem_sql('tw', 'ts')}, p as (select chunk_id, i, stem from tw join ts using (word)),
f as (select a.chunk_id, count(*) as tf from p a join p b on a.chunk_id = b.chunk_id and b.i = a.i + 1 where a.stem = 'of' and b.stem = 'the' group by 1),
c as (select t.chunk_id, len(t) as len, coalesce(tf, 0) as tf from t left join f on f.chunk_id = t.chunk_id), s as (select count(*) as n, avg(len) as avg_len, count(*) filter (tf > 0) as df from c),
h as (select chunk_id, (case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) as score from c, s where tf > 0)
select chunk_id, round(score, 9) as score from h order by h.score desc, chunk_id limit 20""",
    "fts_stemmed": f"with {DOCS}, {CHUNKS}, {_bm25(['the', 'en'])} select chunk_id, round(score, 9) as score from hits order by hits.score desc, chunk_id limit 20",
    "fts_simple_rank": f"""with {DOCS}, {CHUNKS}, t as (select id as chunk_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{Nd}}]+') as t from chunks),
p as (select chunk_id, unnest(t) as word, generate_subscripts(t, 1) as i from t),
r as (select a.chunk_id, 1 - product(1 - 0.1 * sqrt(case when abs(a.i - b.i) > 100 then 1e-30 else 1 / (1.005 + 0.05 * exp(abs(a.i - b.i) / 1.5 - 2)) end)) as score from p a join p b on a.chunk_id = b.chunk_id where a.word = 'the' and b.word = 'of' group by 1)
select chunk_id, round(score, 9) as score from r order by r.score desc, chunk_id limit 20""",
    "word_stems": f"""with w as (select unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{Nd}}]+')) as word from documents), {stem_sql('w', 'st')} select word, stem from st""",
    "search_neighbors": _hybrid(tail="""select rank::int as rank, chunk_id, coalesce((select string_agg(n, ',' order by n) from (select distinct case when src = document_id then dst else src end as n from edges where (src = document_id or dst = document_id) and src <> dst)), '') as neighbors from top"""),
    "similar_languages": f"""with {DOCS}, x as (select id, doc_id % 7 as k from docs) select id, ['go', 'python', 'cpp', 'javascript', 'python', 'php', 'shell'][k + 1] as language, k in (0, 4, 5) as code from x""",
    "doctor_dead_links": f"with {EDGES}, {DOCS}, {DIRTY} select src, dst, relation from dead",
    "doctor_orphans": f"""with {EDGES}, {DOCS}, {DIRTY}, e as (select * from dirty where relation <> 'links_to')
select id from docs where id not in (select src from e) and id not in (select dst from e) and title not in (select dst from e)""",
    "doctor_self_loops": f"with {EDGES}, {DOCS}, {DIRTY} select src, relation from dirty where src = dst",
    "doctor_health": f"""with {EDGES}, {DOCS}, {CHUNKS}, {VECTORS}, {DIRTY},
a as (select (select count(*) from docs) as documents, (select count(*) from dead) as dead, (select count(*) from docs where id not in (select src from dirty) and id not in (select dst from dirty) and title not in (select dst from dirty)) as orphaned,
    (select count(*) from dirty where src = dst) as loops, (select count(*) from chunks where id not in (select chunk_id from vectors)) as desynced)
select *, case when documents = 0 then 100 else greatest(0, 100 - least(40, 5 * dead) - least(30, floor(40.0 * orphaned / documents)) - least(15, 5 * loops) - least(15, 2 * desynced)) end::bigint as score from a""",
    "doctor_fix": f"with {EDGES}, {DOCS}, {DIRTY} select src, dst, relation from dirty d where src <> dst and not exists (select 1 from dead x where x.src = d.src and x.dst = d.dst and x.relation = d.relation)",
    "staleness_report": f"""with {DOCS}, disk as (select case when doc_id % 7 = 0 then path || '.new' else path end as path, updated_at + doc_id % 3 as mtime from docs where doc_id % 11 <> 0)
select * from (select coalesce(a.path, b.path) as path, case when b.path is null then 'new' when a.path is null then 'deleted' when mtime > updated_at + 1 then 'modified' end as state from disk a full join docs b on a.path = b.path) where state is not null""",
    "drift_scores": f"""with {NOTES}, {DRIFT} select * from drift""",
    "drift_overall": f"""with {NOTES}, {DRIFT} select count(*) filter (score >= 30) as notes, coalesce(round(avg(score) filter (score >= 30), 1), 0.0) as overall, count(*) filter (severity = 'CRITICAL') as critical,
    count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'MEDIUM') as medium, count(*) filter (severity = 'LOW') as low from drift""",
    "uncovered_code": f"""with {NOTES} select path, 'pkg' as package, status, additions + deletions as churn, case status when 'A' then 'Criar nova especificação ou ADR para novo módulo de código'
    when 'D' then 'Verificar remoção de dependências e documentar depreciação' else 'Documentar mudanças arquiteturais ou criar nota de componente' end as action
from changes where path not in (select path from named)""",
    "prune_set": f"with {DOCS} select id from docs where path like 'fr/%' and doc_id % 6 = 0",
    "policy_decisions": f"""with {DOCS}, r as (select id, path, ['admin', 'bot', '', 'guest'][doc_id % 4 + 1] as actor, case when doc_id % 2 = 0 then 'read' else 'write' end as op from docs)
select id as request, case when actor = '' then 'deny' when actor = 'admin' then 'allow' when op = 'read' and path like 'en/%' then 'allow' when actor = 'bot' and op = 'write' then 'review' else 'deny' end as decision from r""",
    "precondition": """with r as (select 'd' || (doc_id * 2) as doc_id, doc_id % 4 - 1 as expected from documents), d as (select 'd' || doc_id as id, doc_id % 3 as revision from documents)
select doc_id, expected, case when expected < 0 then 'invalid' when revision is null then case when expected = 0 then 'ok' else 'conflict' end when expected = 0 or expected <> revision then 'conflict' else 'ok' end as verdict from r left join d on d.id = r.doc_id""",
    "code_search_boost": f"""with {CODE} select id, qualified_name, kind, case when qualified_name = 'Brand11.f5' then 2.0 else 1.0 end::double as score from symbols
where contains(lower(name), 'brand11.f5') or contains(lower(qualified_name), 'brand11.f5') or contains(lower(signature), 'brand11.f5') order by score desc, id limit 10""",
    "code_walk_out": _walk("src", "dst"),
    "code_walk_in": _walk("dst", "src"),
    "code_stats": f"""with {CODE} select 'files' as metric, count(*) as value from files union all select 'symbols', count(*) from symbols union all select 'edges', count(*) from calls
union all select 'orphan_files', count(*) from files where id not in (select file_id from symbols) union all select 'kind:' || kind, count(*) from symbols group by kind union all select 'language:' || language, count(*) from files group by language""",
    "code_orphans": f"with {CODE} select id, path from files where id not in (select file_id from symbols)",
    "symbol_reference_edges": f"""with {CODE}, s as (select id, name as key, count(*) over (partition by name) - 1 as others from symbols where kind <> 'import')
select id, key, others, case when others = 1 then 1.0 else 0.5 end::double as confidence, others > 1 as uncertain from s where others > 0""",
    "ast_hash": f"""with {CODE}, k as (select distinct file_id, kind || '|' || qualified_name || '|' || start_line as k from symbols) select file_id, sha256(string_agg(k, chr(10) order by k) || chr(10)) as ast_hash from k group by file_id""",
    "events_by_type": f"with {LOG} select event_type, count(*) as n from log group by 1 order by n desc, 1 limit 10",
    "events_oldest_unacked": f"""with {LOG}, m as (select min(sequence) as sequence, arg_min(created_at, sequence) as made from log where acked_at is null)
select sequence, greatest(0, epoch(timestamp '2030-01-01 00:00:00')::bigint - floor(epoch(made))::bigint) as age_seconds, epoch(timestamp '2030-01-01 00:00:00') - epoch(made) > 300 as warn from m""",
    "events_unacked_for_subscriber": f"with {LOG} select sequence, event_id, event_type from log where sequence > 500 and (acked_at is null or not contains(acked_at, '|')) order by sequence limit 100",
    "events_tail": f"with {LOG} select sequence, event_type from (select * from log order by sequence desc limit 50) where event_type like 'c%'",
    "events_trace": "select conv_id as correlation_id, turn as sequence, role from conversations where conv_id = 3",
    "events_replay_counts": f"""with {LOG}, l as (select * from log where sequence between 100 and 900)
select 'all' as subscriber, count(*) as events from l union all select 'buy', count(*) from l where event_type = 'purchase' union all select 'c', count(*) from l where event_type like 'c%' union all select 'none', 0""",
    "event_redaction": """with p as (select conv_id, turn, role, '{"prompt":"' || md5(text) || '","role":"' || role || '"}' as payload from conversations)
select conv_id, turn, '{"prompt":"[REDACTED:prompt]","role":"' || role || '"}' as payload, sha256(payload) as payload_hash from p""",
    "debounce_sessions": """with c as (select user_id, ts, case event_type when 'signup' then 'CREATE' when 'error' then 'DELETE' else 'MODIFY' end as kind from events),
g as (select *, case when ts < lag(ts) over w + interval 1 hour then 0 else 1 end as new from c window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g),
b as (select arg_max(kind, ts) as last, arg_max(kind, ts) filter (kind <> 'MODIFY') as other, count(*) as n from s group by user_id, k)
select case when last = 'MODIFY' and other = 'CREATE' then 'CREATE' else last end as kind, count(*) as bursts, sum(n)::bigint as changes from b group by 1""",
    "projection_latest": f"""with {LOG}, r as (select *, row_number() over (partition by aggregate_id order by sequence)::int as revision from log) select aggregate_id, revision, sequence, event_type from r qualify row_number() over (partition by aggregate_id order by revision desc) = 1""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
