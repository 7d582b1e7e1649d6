"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, classifier, conversations, hard_negatives, html_text, licenses, mixing, ngram_join, packing, quality_rules, substring_dedup, token_counts, topk
from quillstone.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, with_ids=False)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = topk.binary_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.exact_top_k(codes, codes.where("id % 100 = 0"), k=10)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    withdrawn = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return token_counts.maintained_counts(table(spark, sf_dir, "documents"), withdrawn, VOCABULARY, "byte_bpe_50k")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("times")).alias("taken"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), WORD_VOCABULARY))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding"), F.col("id") % 50 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_byte_bpe, op3_exact_top_k, op4_ngram_jaccard_join, op5_token_counts, op6_html_text, op7_substring_dedup, op8_quality_rules, op9_mixing, op10_quality_classifier, op11_best_fit_packing, op12_conversation_repair, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_top_k": TOP_K, "op9_mixing": MIXING, "op12_conversation_repair": CONVERSATIONS, "op13_hard_negatives": HARD_NEGATIVES}


TOP_K = """
with codes as (
    select distinct vec_id as id, list_sum(list_transform(range(len(embedding)), lambda i: case when embedding[i + 1] > 0 and i < 63 then 1::bigint << i else 0 end))::bigint as low,
        case when embedding[64] > 0 then 1 else 0 end as top
    from embeddings where len(embedding) between 1 and 64),
pairs as (
    select q.id as query_id, c.id, (bit_count(xor(q.low, c.low)) + xor(q.top, c.top))::int as distance
    from codes q, codes c where q.id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by distance, id)::int as rank from pairs)
select query_id, rank, id, distance from ranked where rank <= 10
"""

MIXING = r"""
with recursive sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
        ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 8))::bigint as u
    from documents),
sources as (
    select source, sum(size)::bigint as source_size, (row_number() over (order by source is null, source) - 1) % 3 as k
    from sized group by source),
weighed as (select source, source_size, case k when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w from sources),
levels as (
    select 0 as n, (select sum(source_size) / sum(w) from weighed)::double as level
    union all
    select n + 1, (select (sum(source_size) - coalesce(sum(3 * source_size) filter (w * l.level > 3 * source_size), 0)) / sum(w) filter (w * l.level <= 3 * source_size) from weighed)::double
    from levels l where n < 60),
level as (select max(level) as level from levels),
targets as (select source, source_size, least(w * level, (3 * source_size)::double) as target from weighed, level),
plan as (
    select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole,
        greatest(target - case when source_size > 0 then floor(target / source_size) else 0 end * source_size, 0.0) as want
    from targets),
bins as (select source, u * 4096 // 4294967296 as bin, sum(size) as words from sized group by all),
ranges as (select *, coalesce(sum(words) over (partition by source order by bin rows between unbounded preceding and 1 preceding), 0) as before from bins),
joined as (
    select s.*, p.source_size, p.target, p.whole, p.want, r.before, r.words,
        r.before < p.want and r.before + r.words > p.want as split,
        sum(s.size) over (partition by s.source, r.bin order by s.u rows between unbounded preceding and current row) as upto
    from sized s join plan p on s.source is not distinct from p.source
    join ranges r on r.source is not distinct from s.source and r.bin = s.u * 4096 // 4294967296)
select doc_id, size, source_size, round(target, 6) as target,
    (size * (whole + case when split then (before + upto - size / 2 <= want)::int else (before + words <= want)::int end))::bigint as taken
from joined
"""

CONVERSATIONS = r"""
with recursive named as (
    select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
summed as (
    -- CRC-32, bit by bit
    select *, xor(list_reduce(flatten(list_transform(string_split(name, ''), lambda ch: list_transform(range(8), lambda i: (ascii(ch)::bigint >> i) & 1))),
        lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::bigint), 4294967295) % 20 as kind
    from named),
hurt as (
    select conv_id, turn, case kind when 4 then 'user' else coalesce(role, ' ') end as role,
        case kind when 1 then '' when 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text,
        unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy
    from summed),
placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as n,
        row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again,
        lag(role[1]) over (partition by conv_id order by turn nulls first, role, md5(text), copy) as before,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last
    from hurt),
faults as (
    select *, case when last = '' then 'b' when again then 'd' when last not in ('.', '!', '?') then 't' else '' end as fault from placed),
-- A layer: the states' least (cost, audit, state); states 0 to 3: nothing yet, after s, u, a.
layers as (
    select conv_id, 0 as n, [{'c': 0, 'a': '', 's': 0}, {'c': 3, 'a': 'I', 's': 2}, {'c': 6, 'a': 'II', 's': 3}] as layer
    from (select distinct conv_id from conversations)
    union all
    select conv_id, n, list_filter(list_transform([0, 1, 2, 3], lambda s: list_sort(list_filter(all_ways, lambda w: w.s = s))[1]), lambda w: w is not null)
    from (
        select conv_id, n, flatten([ways, one, two, list_transform(two, lambda w: {'c': w.c + 3, 'a': w.a || 'I', 's': case when w.s = 2 then 3 else 2 end})]) as all_ways
        from (
            select *, list_transform(one, lambda w: {'c': w.c + 3, 'a': w.a || 'I', 's': case when w.s = 2 then 3 else 2 end}) as two
            from (
                select *, list_transform(ways, lambda w: {'c': w.c + 3, 'a': w.a || 'I', 's': case when w.s = 2 then 3 else 2 end}) as one
                from (
                    select f.conv_id, f.n::int as n, flatten([
                        list_transform(layer, lambda w: {'c': w.c + 4, 'a': w.a || 'D', 's': w.s}),
                        case when fault in ('b', 'd') then [] else list_transform(layer, lambda w: {'c': w.c + 3 + (fault = 't')::int * 3, 'a': w.a || 'R', 's': case when w.s = 2 then 3 else 2 end}) end,
                        case when fault in ('b', 'd') then [] else list_transform(
                            list_filter(layer, lambda w: case role[1] when 's' then w.s = 0 when 'u' then w.s <> 2 when 'a' then w.s = 2 else false end),
                            lambda w: {'c': w.c + (fault = 't')::int * 3, 'a': w.a || 'K', 's': case role[1] when 's' then 1 when 'u' then 2 else 3 end}) end]) as ways
                    from layers l join faults f on f.conv_id is not distinct from l.conv_id and f.n = l.n + 1))))),
best as (
    select conv_id, list_sort(list_filter(arg_max(layer, n), lambda w: w.s in (0, 3)))[1] as way from layers group by conv_id),
-- The audit's letters one by one: what is said so far, the state, the row.
walks as (
    select conv_id, way.a as audit, 1 as k, 0 as s, 0 as n, []::varchar[] as said from best
    union all
    select w.conv_id, audit, k + 1,
        case when audit[k] = 'D' then s when audit[k] = 'K' then case f.role[1] when 's' then 1 when 'u' then 2 else 3 end when s = 2 then 3 else 2 end,
        w.n + (audit[k] <> 'I')::int,
        case audit[k] when 'D' then said when 'K' then list_append(said, f.role || ':' || f.text)
            else list_append(said, case when s = 2 then 'assistant:' else 'user:' end || case audit[k] when 'I' then '' else f.text end) end
    from walks w left join faults f on f.conv_id is not distinct from w.conv_id and f.n = w.n + 1
    where k <= length(audit)),
repaired as (
    select conv_id, array_to_string(arg_max(said, k), chr(10)) as said from walks group by conv_id),
counted as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
        count(*) filter (fault = 't') as truncated, count(*) filter (n > 1 and before || role[1] not in ('su', 'ua', 'au')) as illegal
    from faults group by conv_id)
select b.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
    coalesce(illegal, 0)::bigint as illegal, way.c::bigint as cost, way.a as audit, sha256(said) as repaired_sha256
from best b join repaired r on r.conv_id is not distinct from b.conv_id left join counted c on c.conv_id is not distinct from b.conv_id
"""

HARD_NEGATIVES = """
with rows as (
    select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as x
    from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select a.id as anchor_id, b.id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
    from rows a, rows b where a.id % 50 = 0 and a.id <> b.id),
positives as (
    select anchor_id, id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::int as rank, id as negative_id, positive_score, score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""
