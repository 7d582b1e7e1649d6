"""Operator 3: exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each positive coordinate (64 at most). The code is cut into `segments`; each
distinct code is filed under each of its segments. Round r probes, for each query still open, every
key at Hamming distance r of its segments, and verifies what it finds by whole codes. A query's k-th verified distance
(`within`) bounds its answer: the join of a later round gives only codes that near, and a code that near has a segment s
at a distance of (within - s) / segments at most (else its distances summed to more), so segment s is left out
of round r when segments * r + s is beyond `within`. A query closes when no segment is left to it. While it knows fewer
than k rows all segments are probed; to their full length they cover everything.

Equal vectors share a code and are looked up once, so that a vector that a third of the rows repeat makes no pairs;
of each code only its k least ids can be in an answer, and only these are kept (by partial windows). Distances tie by the lesser id.

Defined results. A null or empty vector, or one longer than 64, has no code: neither found nor answered. Null ids likewise. NaN or null coordinates give bit 0. A query
finds itself (distance 0). Fewer than k rows: all of them. Repeated rows: an id counts once for each of its codes. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import cut

BITS = 64


def binary_codes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, code): a bit for each positive coordinate."""
    bit = "aggregate(sequence(0, size(v) - 1), 0L, (a, i) -> a | case when v[i] > 0 and not isnan(v[i]) then shiftleft(1L, i) else 0L end)"
    some = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(f"id is not null and size(v) between 1 and {BITS}")
    return some.select("id", F.expr(bit).alias("code")).distinct()


def _first_k(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k of each group; a part of each group is cut down before the groups meet."""
    salt = F.pmod(F.xxhash64(*order), F.lit(32))
    part = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by, salt).orderBy(*order))).where(f"__r <= {k}")
    return part.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(f"__r <= {k}")


def _segment(code: str, s: int, bits: int) -> str:
    return f"shiftrightunsigned({code}, {s * bits}) & {(1 << bits) - 1}L"


def exact_top_k(codes: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4) -> DataFrame:
    """(query_id, rank, id, distance) of the k nearest of codes (id, code) to each of queries (id, code)."""
    spark, bits = codes.sparkSession, BITS // segments
    member = cut(_first_k(codes, ["code"], ["id"], k).select("code", "id"))
    held = member.groupBy("code").agg(F.count("*").alias("held"), F.min("id").alias("least"))
    keys = F.array(*(F.struct(F.lit(s).alias("seg"), F.expr(_segment("code", s, bits)).alias("key")) for s in range(segments)))
    index = cut(held.select("code", "held", "least", F.explode(keys).alias("x")).select("x.seg", "x.key", "code", "held", "least"))
    open_ = cut(queries.select(F.col("code").alias("q"), F.lit(BITS).alias("within")).distinct())
    found = None
    for r in range(bits + 1):
        # At most 2^bits masks of each segment over all rounds: the side that is broadcast has that bound.
        masks = spark.createDataFrame([(s, sum(1 << b for b in c)) for s in range(segments) for c in combinations(range(bits), r)], "seg int, mask long")
        qkeys = F.array(*(F.struct(F.lit(s).alias("seg"), F.expr(_segment("q", s, bits)).alias("at")) for s in range(segments)))
        probes = open_.select("q", "within", F.explode(qkeys).alias("x")).select("q", "within", "x.seg", "x.at").where(f"{segments * r} + seg <= within").join(F.broadcast(masks), "seg")
        probes = probes.select("q", "within", "seg", F.col("at").bitwiseXOR(F.col("mask")).alias("key"))
        near = [f"bit_count({_segment('d', s, bits)})" for s in range(segments)]
        # A code is met once: in the round of its nearest segment, at the first segment that near.
        once = " and ".join(f"({near[s]} > {r} or ({near[s]} = {r} and seg <= {s}))" for s in range(segments))
        hits = probes.join(index, ["seg", "key"]).withColumn("d", F.col("q").bitwiseXOR(F.col("code"))).where(f"bit_count(d) <= within and {once}")
        hits = hits.select("q", "code", "held", "least", F.expr("bit_count(d)").alias("distance"))
        # k codes suffice: each has a row at least, and the code with the lesser first id wins a tie.
        best = hits if found is None else found.union(hits)
        found = cut(_first_k(best, ["q"], ["distance", "least"], k).drop("__r"))
        so_far = F.sum("held").over(Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0))
        known = found.select("q", "distance", so_far.alias("n")).where(f"n >= {k}").groupBy("q").agg(F.min("distance").alias("within"))
        open_ = cut(open_.select("q").join(known, "q", "left").select("q", F.coalesce("within", F.lit(BITS)).alias("within")).where(f"within >= {segments * (r + 1)}"))
        if not open_.limit(1).count():
            break
    rows = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct()
    answer = _first_k(found.join(member, "code").select("q", "id", "distance"), ["q"], ["distance", "id"], k)
    return rows.join(answer, "q").select("query_id", F.col("__r").cast("int").alias("rank"), "id", F.col("distance").cast("int").alias("distance"))
