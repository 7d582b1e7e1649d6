"""Audits: dead links, orphans, staleness, drift, pruning, incremental skips and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.scoring import drift_score, drift_severity
from quillstone.functions.text import fuzzy, is_code_file
from quillstone.operators.containment import contained, occurrences_of

#: Paths that are orphans by design (fixed values).
BY_DESIGN = r"(?i)(docs[/\\]adr|\.specs|\.agents[/\\]skills|\.memory|\.github)[/\\]"
#: What is advised for code that no note names, by status (fixed values).
ADVICE = {"A": "Criar nova especificação ou ADR para novo módulo de código", "D": "Verificar remoção de dependências e documentar depreciação"}
OTHER_ADVICE = "Documentar mudanças arquiteturais ou criar nota de componente"


def dead_links(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(src, dst, relation): targets that are neither ids nor titles; tags and remote links don't count. Null titles match nothing."""
    e = edges.where(~F.col("dst").startswith("#") & ~F.col("dst").startswith("memory://")).select("src", "dst", "relation")
    names = docs.select(F.col("id").alias("dst")).union(docs.where("title is not null").select("title")).distinct()
    return e.join(names, "dst", "left_anti").select("src", "dst", "relation")


def orphans(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(id): documents that no edge touches, by id or title."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    rows = docs.where(~F.coalesce(F.col("path").rlike(BY_DESIGN), F.lit(False))).select("id", "title").join(ends, "id", "left_anti")
    return rows.join(edges.select(F.col("dst").alias("title")).distinct(), "title", "left_anti").select("id")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").select("src", "relation")


def desynced(chunks: DataFrame, codes: DataFrame) -> DataFrame:
    return chunks.select(F.col("id").alias("chunk_id")).join(codes.select("chunk_id"), "chunk_id", "left_anti")


def health(docs: DataFrame, edges: DataFrame, chunks: DataFrame, codes: DataFrame) -> DataFrame:
    """(documents, dead, orphaned, loops, desynced, score)."""
    one = lambda d, name: d.agg(F.count("*").alias(name))
    row = one(docs, "documents")
    for d, name in ((dead_links(edges, docs), "dead"), (orphans(edges, docs), "orphaned"), (self_loops(edges), "loops"), (desynced(chunks, codes), "desynced")):
        row = row.join(F.broadcast(one(d, name)))  # one row each
    share = F.floor(F.lit(40.0) * F.col("orphaned") / F.greatest("documents", F.lit(1)))
    score = 100 - F.least(F.lit(40), 5 * F.col("dead")) - F.least(F.lit(30), share) - F.least(F.lit(15), 5 * F.col("loops")) - F.least(F.lit(15), 2 * F.col("desynced"))
    return row.withColumn("score", F.when(F.col("documents") == 0, 100).otherwise(F.greatest(F.lit(0), score)).cast("long"))


def fixed(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges without loops and dead links."""
    return edges.where("src <> dst").join(dead_links(edges, docs), ["src", "dst", "relation"], "left_anti").select(*edges.columns)


def staleness(disk: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, state): new, modified (a second later at least) or deleted; disk (path, mtime), docs (path, updated_at)."""
    norm = lambda c: F.regexp_replace(F.replace(F.col(c), F.lit("\\"), F.lit("/")), r"^\./", "")
    d = disk.select(norm("path").alias("path"), "mtime")
    i = docs.select(norm("path").alias("path"), "updated_at")
    state = F.when(F.col("updated_at").isNull(), "new").when(F.col("mtime").isNull(), "deleted").when(F.col("mtime") > F.col("updated_at") + 1, "modified")
    return d.join(i, "path", "full_outer").select("path", state.alias("state")).where("state is not null")


def staleness_banner(report: DataFrame) -> DataFrame:
    n = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0))
    return report.agg(F.format_string("%d new, %d modified, %d deleted", n("new"), n("modified"), n("deleted")).alias("banner"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, event) between two listings (path, mtime, size)."""
    b = before.select("path", F.struct("mtime", "size").alias("b"))
    a = after.select("path", F.struct("mtime", "size").alias("a"))
    event = F.when(F.col("b").isNull(), "CREATE").when(F.col("a").isNull(), "DELETE").when(F.col("a") != F.col("b"), "MODIFY")
    return b.join(a, "path", "full_outer").select("path", event.alias("event")).where("event is not null")


def mentions(notes: DataFrame, changes: DataFrame, least: int = 2) -> DataFrame:
    """(id, updated_at, n and the columns of changes): notes (id, content, updated_at) in which a changed path (all have a dot) occurs `least` times or more, letters' case aside and inside of longer names too."""
    low = notes.select("id", F.lower("content").alias("content"))
    paths = changes.withColumn("pattern", F.lower("path"))
    found = occurrences_of(low, paths, least)
    # Not broadcast: paths are few bytes on disk and many rows.
    return found.join(paths.hint("merge"), "pattern").join(notes.select("id", "updated_at"), "id").drop("pattern")


def drift(notes: DataFrame, changes: DataFrame, commits: DataFrame, pagerank: float = 0.015, least: int = 2) -> DataFrame:
    """(id, paths, commits_behind, churn, score, severity), the greatest score first; changes (path, additions, deletions), commits (at)."""
    code = changes.where(is_code_file("path"))
    m = mentions(notes, code, least).groupBy("id").agg(F.count("*").alias("paths"), F.sum(F.col("additions") + F.col("deletions")).alias("churn"), F.first("updated_at").alias("updated_at"))
    # Commits after each distinct time of an update: both are short lists, and notes meet them by equality.
    times = m.select("updated_at").distinct()
    behind = times.join(commits, F.col("at") > F.col("updated_at"), "left").groupBy("updated_at").agg(F.count("at").alias("behind"))
    rows = m.join(behind, "updated_at").withColumn("commits_behind", F.greatest(F.lit(1), F.col("behind")))
    score = drift_score(F.col("commits_behind"), F.lit(pagerank), F.col("churn"))
    return rows.select("id", "paths", "commits_behind", "churn", score.alias("score")).withColumn("severity", drift_severity(F.col("score"))).orderBy(F.desc("score"), "id")


def drift_overall(found: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(notes, overall, critical, high, medium, low) of drifted notes: the mean of the scores that reach the threshold (a share of 100), and notes by severity."""
    n = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s.lower())
    in_ = (F.col("score") / 100 >= threshold) if threshold > 0 else F.lit(True)
    return found.agg(F.count(F.when(in_, 1)).alias("notes"), F.coalesce(F.round(F.avg(F.when(in_, F.col("score"))), 1), F.lit(0.0)).alias("overall"), *map(n, ("CRITICAL", "HIGH", "MEDIUM", "LOW")))


def uncovered(notes: DataFrame, changes: DataFrame, least: int = 2) -> DataFrame:
    """(path, package, status, churn, action), the most churn first: changed code that no note names often enough."""
    code = changes.where(is_code_file("path"))
    low = notes.select("id", F.lower("content").alias("content"))
    seen = occurrences_of(low, code.select(F.lower("path").alias("pattern")), least).select("pattern").distinct()
    rows = code.join(seen, F.lower("path") == F.col("pattern"), "left_anti").select("path", "status", (F.col("additions") + F.col("deletions")).alias("churn")).orderBy(F.desc("churn"), "path")
    # Texts made of these columns are added once the rows are sorted.
    action = F.when(F.col("status") == "A", ADVICE["A"]).when(F.col("status") == "D", ADVICE["D"]).otherwise(OTHER_ADVICE)
    package = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)).otherwise(".")
    return rows.select("path", package.alias("package"), "status", "churn", action.alias("action"))


def prune(docs: DataFrame, active: DataFrame, root: str) -> DataFrame:
    """(id): indexed below root and no longer there; root counts as a whole folder."""
    base = root.rstrip("/").lower() + "/"
    return docs.where(F.lower("path").startswith(base)).join(active.select("path").distinct(), "path", "left_anti").select("id")


def to_index(files: DataFrame, docs: DataFrame) -> DataFrame:
    """files (id, content) whose hash is not the stored one."""
    return files.withColumn("content_hash", F.sha2("content", 256)).join(docs.select("id", "content_hash"), ["id", "content_hash"], "left_anti")


def decide(requests: DataFrame, rules: DataFrame, scope: str | None = None) -> DataFrame:
    """(request, decision): the first rule (idx, actor, path, op, decision) that matches, else deny; no actor or out of scope: deny."""
    r = rules.select("idx", F.col("actor").alias("ra"), F.col("path").alias("rp"), F.col("op").alias("ro"), "decision")

    def like(c: str, p: str):
        # All that a pattern could read as a sign is quoted; then the globs, of which ** goes over folders.
        pattern = F.regexp_replace(p, r"([\\.^$|?+()\[\]{}])", r"\\$1")
        for glob, regex in (("**", "\u0001"), ("*", "[^/]*"), ("\u0001", ".*")):
            pattern = F.replace(pattern, F.lit(glob), F.lit(regex))
        return (F.col(p) == "*") | F.regexp_like(F.col(c), F.concat(F.lit("^"), pattern, F.lit("$")))

    hit = like("actor", "ra") & like("path", "rp") & ((F.col("ro") == "*") | (F.col("ro") == F.col("op")))
    best = requests.join(F.broadcast(r), hit, "left").groupBy("request", "actor", "path").agg(F.min_by("decision", "idx").alias("d"))  # rules come from a small file
    ok = (F.col("actor") != "") & F.col("actor").isNotNull()
    if scope:
        ok = ok & F.col("path").startswith(scope)
    return best.select("request", F.when(ok, F.coalesce("d", F.lit("deny"))).otherwise("deny").alias("decision"))


def precondition(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, verdict) of expected revisions; requests (doc_id, expected), docs (id, revision)."""
    e, c = F.col("expected"), F.col("revision")
    verdict = F.when(e < 0, "invalid").when(c.isNull(), F.when(e == 0, "ok").otherwise("conflict")).when((e == 0) | (e != c), "conflict").otherwise("ok")
    return requests.join(docs.select(F.col("id").alias("doc_id"), "revision"), "doc_id", "left").select("doc_id", "expected", verdict.alias("verdict"))


def resolve_tags(tags: DataFrame, titles: DataFrame) -> DataFrame:
    """(tag, title): equal once folded, else one inside the other, else a token of four letters of the tag inside of a title; within a tier the first title, of equal titles the last.

    tags (tag), titles (title, pos). No tier makes pairs of all: containment goes by grams.
    """
    t = titles.withColumn("k", fuzzy("title")).where("k <> ''")
    g = tags.select("tag").distinct().withColumn("f", fuzzy("tag"))
    keys, found = t.select(F.col("k").alias("whole")), g.where("f <> ''")
    exact = g.join(t, g["f"] == t["k"]).select("tag", "title", F.lit(0).alias("tier"), (-F.col("pos")).alias("pos"))
    inside = contained(found.select(F.col("f").alias("part")), keys).select(F.col("part").alias("f"), F.col("whole").alias("k"))
    around = contained(keys.select(F.col("whole").alias("part")), found.select(F.col("f").alias("whole"))).select(F.col("whole").alias("f"), F.col("part").alias("k"))
    part = found.join(inside.union(around).distinct(), "f").join(t, "k").select("tag", "title", F.lit(1).alias("tier"), "pos")
    long_ = g.select("tag", F.explode(F.split(F.lower("tag"), "[-_ .]+")).alias("part")).where("length(part) >= 4").distinct()
    held = contained(long_.select("part"), keys).withColumnRenamed("whole", "k")
    tok = long_.join(held, "part").join(t, "k").select("tag", "title", F.lit(2).alias("tier"), "pos")
    return exact.union(part).union(tok).groupBy("tag").agg(F.min_by("title", F.struct("tier", "pos")).alias("title"))
