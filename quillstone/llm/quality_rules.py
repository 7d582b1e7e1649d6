"""Operator 8 (native): quality rules by robust multivariate outliers. DataFrame expressions only.

Base statistics are exact counts over whole texts. Documents that fail the base rules go at once. For the others, a vector of five transformed statistics
is compared with the minimum-covariance-determinant estimate of its language and source: concentration steps start from medians and median deviations, and each keeps the
`share` of the group that is nearest by Mahalanobis distance and estimates mean and covariance from it, which never
raises the determinant, until the moments of no group move. A variance floor for each statistic keeps estimates regular where a statistic is constant (the usual case
for clean text); it is about what one count more or less makes in a document. A document goes if its squared distance, made consistent for the normal model, is above `cutoff`.

Groups with fewer than `least` documents use the estimate of their language, and languages with fewer that of all. Every estimate is an
aggregation with map-side combine over the numeric rows, and its result has one row for each group; no group is gathered in one task. Estimates meet
their rows by broadcast up to BROADCAST_GROUPS groups, and beyond that by group and salt, as one group holds all rows.

Defined results. Null text: no words, all counts 0, base_failed. Null lang or source count as ''. A document with no estimate (empty groups) is
kept unless it fails the base rules. Null doc_id: kept as null. Repeated rows: each is returned, and each counts. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import SPACE, cut

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Transformed statistics, and the least standard deviation that an estimate gives each.
STATS = {
    "ln(1 + n_words)": 0.05,
    "word_chars / n_words": 0.05,
    "sqrt(n_symbols / word_chars)": 0.03,
    "ln(1 + n_dup_lines)": 0.35,
    "sqrt(n_repeat_words / n_words)": 0.08,
}
D = len(STATS)
#: Chi-square quantile of D = 5 degrees at 0.99999, and the consistency factor of the best three quarters.
CUTOFF, FACTOR = 30.86, 1.41
#: Groups up to which estimates (about 400 bytes each) are broadcast, and the parts that a group is dealt to beyond that.
BROADCAST_GROUPS, SALTS = 20_000, 64
#: Concentration steps at most, and the move of a moment, in standard deviations, that counts as none: what the approximate quantile leaves open.
STEPS, STILL = 50, 0.01


def base_stats(docs: DataFrame) -> DataFrame:
    """docs' doc_id, lang and source with the base statistics of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("t"))
    flat = F.translate("t", SPACE, " " * len(SPACE))
    d = d.withColumns({"w": F.filter(F.split(flat, " "), lambda x: x != ""), "l": F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)})
    d = d.select(
        "doc_id", "lang", "source", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
    )
    word = ", ".join(f"w[i + {k}]" for k in range(WINDOW))
    windows = F.expr(f"case when n_words > {WINDOW} then transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({word})) else cast(array() as array<bigint>) end")
    d = d.withColumn("h", windows).drop("w")
    d = d.withColumn("h", F.expr("case when size(array_distinct(h)) < size(h) then array_sort(transform(h, (x, i) -> struct(x, i))) end"))
    # Places of windows that an equal one stands beside, in order.
    same = "(i > 0 and h[i - 1].x = y.x) or (i < size(h) - 1 and h[i + 1].x = y.x)"
    d = d.withColumn("p", F.expr(f"array_sort(transform(filter(h, (y, i) -> {same}), y -> y.i))")).drop("h")
    covered = f"aggregate(sequence(0, size(p) - 1), 0L, (a, i) -> a + case when i = size(p) - 1 then {WINDOW} else least({WINDOW}, p[i + 1] - p[i]) end)"
    d = d.withColumn("n_repeat_words", F.expr(f"case when p is null or size(p) = 0 then 0L else {covered} end")).drop("p")
    return d.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def _barrier(rows: DataFrame, named: dict[str, str]) -> DataFrame:
    """rows with new columns that later expressions read, not repeat: a generator keeps projections apart."""
    fields = ", ".join(f"'{k}', {v}" for k, v in named.items())
    return rows.select("*", F.expr(f"inline(array(named_struct({fields})))"))


def _whitening(moments: DataFrame) -> DataFrame:
    """moments with w<i><k>: the inverse of the Cholesky factor of the covariance, by group."""
    out = moments
    for j in range(D):
        rest = " - ".join([f"v{j}{j}", *(f"c{j}{k} * c{j}{k}" for k in range(j))])
        out = _barrier(out, {f"c{j}{j}": f"sqrt(greatest({rest}, 1e-12))"})
        below = {f"c{i}{j}": f"({' - '.join([f'v{j}{i}', *(f'c{i}{k} * c{j}{k}' for k in range(j))])}) / c{j}{j}" for i in range(j + 1, D)}
        out = _barrier(out, below) if below else out
    for i in range(D):
        row = {f"w{i}{k}": f"-({' + '.join(f'c{i}{m} * w{m}{k}' for m in range(k, i))}) / c{i}{i}" for k in range(i)}
        out = _barrier(out, row | {f"w{i}{i}": f"1 / c{i}{i}"})
    return out.drop(*(f"c{i}{j}" for i in range(D) for j in range(i + 1)))


def _moments(rows: DataFrame) -> DataFrame:
    """Mean m<i> and floored covariance v<i><j> of x<i> by grp."""
    floors = list(STATS.values())
    aggs: list[Column] = [F.avg(f"x{i}").alias(f"m{i}") for i in range(D)]
    for i in range(D):
        for j in range(i, D):
            c = F.covar_pop(f"x{i}", f"x{j}")
            aggs.append((c + F.lit(floors[i] ** 2) if i == j else c).alias(f"v{i}{j}"))
    return rows.groupBy("grp").agg(*aggs)


def _meet(rows: DataFrame, groups: DataFrame, few: bool, on: str = "grp", how: str = "inner") -> DataFrame:
    """rows joined with groups, which has one row for each value of `on`; few: so few that they are broadcast."""
    if few:
        return rows.join(F.broadcast(groups), on, how)
    facts = [F.col(c) for c in rows.columns]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*facts), F.lit(SALTS)))
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [on, "salt"], how).drop("salt")


def _with_distance(rows: DataFrame, moments: DataFrame, how: str = "inner", few: bool = True) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance to their group's moments."""
    white = cut(_whitening(moments))
    d2 = " + ".join(f"pow({' + '.join(f'w{i}{k} * (x{k} - m{k})' for k in range(i + 1))}, 2)" for i in range(D))
    return _meet(rows, white, few, how=how).withColumn("d2", F.expr(d2)).drop(*(c for c in white.columns if c != "grp"))


def mcd(rows: DataFrame, share: float = 0.75, steps: int = 4, accuracy: int = 2000, still: float | None = None, few: bool = True) -> DataFrame:
    """Robust moments by grp of rows (grp, x0 .. x4): after `steps` steps or, with `still`, once no moment moves by more than so many standard deviations."""
    quart = rows.groupBy("grp").agg(*(F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], accuracy).alias(f"q{i}") for i in range(D)))
    floors = list(STATS.values())
    start = [F.element_at(f"q{i}", 2).alias(f"m{i}") for i in range(D)]
    for i in range(D):
        for j in range(i, D):
            spread = (F.element_at(f"q{i}", 3) - F.element_at(f"q{i}", 1)) / 1.349
            start.append((spread * spread + F.lit(floors[i] ** 2) if i == j else F.lit(0.0)).alias(f"v{i}{j}"))
    moments = quart.select("grp", *start)
    for _ in range(steps):
        near = _with_distance(rows, moments, few=few)
        limit = near.groupBy("grp").agg(F.percentile_approx("d2", share, accuracy).alias("limit"))
        last, moments = moments, _moments(_meet(near, limit, few).where("d2 <= limit"))
        if still is not None:
            moments = cut(moments)
            if (_moved(last, moments) or 0.0) <= still:
                break
    return moments


def _moved(last: DataFrame, moments: DataFrame) -> float | None:
    """The greatest difference of a group's moments, in standard deviations and their products."""
    unit = {f"m{i}": F.sqrt(f"v{i}{i}") for i in range(D)} | {f"v{i}{j}": F.sqrt(F.col(f"v{i}{i}") * F.col(f"v{j}{j}")) for i in range(D) for j in range(i, D)}
    both = moments.join(last.select("grp", *(F.col(c).alias(f"{c}_") for c in unit)), "grp")
    return both.agg(F.max(F.greatest(*(F.abs(F.col(c) - F.col(f"{c}_")) / u for c, u in unit.items())))).first()[0]


def judge(stats: DataFrame, least: int = 100, cutoff: float = CUTOFF, factor: float = FACTOR, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """stats with the column kept."""
    x = stats.withColumns({f"x{i}": F.when(~F.col("base_failed"), F.expr(f"cast({s.replace('/ word_chars', '/ greatest(word_chars, 1)').replace('/ n_words', '/ greatest(n_words, 1)')} as double)")) for i, s in enumerate(STATS)})
    names = F.array(F.concat_ws("\u0001", F.lit("s"), "lang", "source"), F.concat_ws("\u0001", F.lit("l"), "lang"), F.lit("all"))
    levels = x.where("not base_failed").select(F.posexplode(names).alias("level", "grp"), *(f"x{i}" for i in range(D)))
    sizes = levels.groupBy("grp").agg(F.count("*").alias("n"), F.min("level").alias("level")).where((F.col("n") >= least) | (F.col("level") == 2))
    sizes = cut(sizes.select("grp"))
    few = sizes.count() <= broadcast_groups
    rows = _meet(levels, sizes, few, how="left_semi")
    moments = cut(mcd(rows.drop("level"), steps=STEPS, still=STILL, few=few))
    # The finest group that has an estimate.
    ready = moments.select("grp").withColumn("has", F.lit(True))
    pick = x
    for k in range(3):
        own = ready.select(F.col("grp").alias(f"g{k}"), F.col("has").alias(f"has{k}"))
        pick = _meet(pick.withColumn(f"g{k}", names[k]), own, few, f"g{k}", "left")
    pick = pick.withColumn("grp", F.coalesce(*(F.when(F.col(f"has{k}"), F.col(f"g{k}")) for k in range(3)))).drop(*(f"{a}{k}" for a in ("g", "has") for k in range(3)))
    far = _with_distance(pick, moments, "left", few).withColumn("distance", F.sqrt(F.col("d2") / F.lit(factor)))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("d2") / F.lit(factor) > F.lit(cutoff), F.lit(False))
    return far.withColumn("kept", kept).drop("grp", "d2", *(f"x{i}" for i in range(D)))


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of every row."""
    done = judge(cut(base_stats(docs)), **options)
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
