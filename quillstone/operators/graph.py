"""Graph analytics over edges (src, dst, relation, status, weight). Loops cut their lineage and move only ids and numbers."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.scoring import ROOT, community_color, edge_cost, edge_weight, note_type, type_color, risk_level, risk_score, severity, severity_weight
from quillstone.functions.text import token_estimate
from quillstone.plans.lineage import cut

#: Edges in a row of pagerank().
CHUNK = 1024


def degrees(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(node, in_degree, out_degree, total)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    out = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("total"))
    return out.orderBy(F.desc("total"), F.desc("in_degree"), "node").limit(limit) if limit else out


def _frontier(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """(node, depth) at the least depth, over edges (src, dst); the root has depth 0."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(root, 0)], "node string, depth int")
    wave = seen
    for d in range(1, depth + 1):
        step = edges.join(wave.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        wave = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.union(wave)
    return seen


def neighbors(edges: DataFrame, root: str, depth: int = 1) -> DataFrame:
    """Distinct targets within `depth` hops; the root itself if a cycle leads back."""
    seen = _frontier(edges.select("src", "dst"), root, depth - 1)
    return edges.select("src", "dst").join(seen.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src"))


def ego(edges: DataFrame, root: str, depth: int) -> DataFrame:
    return _frontier(undirected(edges).distinct(), root, depth)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def pagerank(edges: DataFrame, iterations: int = 30, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank), summing to one. Parallel edges add up; what dangling nodes hold is spread evenly."""
    # A node's edges meet once: the sums, the shares and the chunks below need no other exchange, and one sort.
    flat = edges.select("src", "dst", edge_weight().alias("w")).repartition("src").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    # Edges travel in every iteration: one row for up to CHUNK of a node's, so that they are few to sort and name their source once.
    own = Window.partitionBy("src").orderBy("dst")
    total = F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = flat.select("src", "dst", (F.col("w") / total).alias("p"), F.floor((F.row_number().over(own) - 1) / CHUNK).alias("chunk"))
    packed = cut(share.groupBy("src", "chunk").agg(F.collect_list(F.struct("dst", "p")).alias("to")))
    # Nodes that no edge ends at have one rank in common, a number: what they give is summed once, and the iterations are over the other nodes.
    ends = cut(packed.select(F.explode("to.dst").alias("node")).distinct())
    hit = ends.withColumn("hit", F.lit(True))
    packed = cut(packed.join(hit, packed["src"].eqNullSafe(hit["node"]), "left").select("src", "chunk", "to", F.col("hit").isNotNull().alias("hit")))
    starts, inner = packed.where("not hit"), cut(packed.where("hit").select("src", "chunk", "to"))
    lone = starts.where("chunk = 0").select(F.col("src").alias("node"))
    first, n = lone.count(), ends.count()
    n += first
    if n == 0:
        return ends.withColumn("rank", F.lit(0.0))
    has_out = inner.where("chunk = 0").select(F.col("src").alias("node"), F.lit(True).alias("out"))
    given = starts.where("src is not null").select(F.explode("to").alias("e")).groupBy(F.col("e.dst").alias("node")).agg(F.sum("e.p").alias("given"))
    ranks = cut(ends.join(has_out, "node", "left").join(given, "node", "left").select("node", F.coalesce("out", F.col("node").isNull()).alias("out"), F.coalesce("given", F.lit(0.0)).alias("given"), F.lit(1.0 / n).alias("rank")))
    alone = 1.0 / n
    for _ in range(iterations):
        dangling = ranks.where("not out").agg(F.sum("rank")).first()[0] or 0.0
        got = inner.join(ranks.select(F.col("node").alias("src"), "rank"), "src").select(F.explode("to").alias("e"), "rank").groupBy(F.col("e.dst").alias("node")).agg(F.sum(F.col("e.p") * F.col("rank")).alias("got"))
        base = (1 - damping) / n + damping * dangling / n
        rank = F.lit(base) + damping * (F.col("given") * alone + F.coalesce("got", F.lit(0.0)))
        new = cut(ranks.join(got, "node", "left").select("node", "out", "given", rank.alias("rank"), F.col("rank").alias("was")))
        moved, alone = first * abs(base - alone), base
        ranks = new.drop("was")
        if tolerance and moved + new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < tolerance:
            break
    total = ranks.agg(F.sum("rank")).first()[0] + first * alone
    return ranks.select("node", "rank").union(lone.withColumn("rank", F.lit(alone))).select("node", (F.col("rank") / total).alias("rank"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(q): symmetrised weights, loops dropped; communities: (node, community)."""
    e = edges.where("src <> dst").select("src", "dst", edge_weight().alias("w"))
    c = communities
    both = e.join(c.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    inside = both.where("a = b").groupBy(F.col("a").alias("community")).agg(F.sum(2 * F.col("w")).alias("inner"))
    ends = both.select(F.col("a").alias("community"), "w").union(both.select("b", "w")).groupBy("community").agg(F.sum("w").alias("total"))
    m2 = both.agg(F.sum(2 * F.col("w")).alias("m2"))
    rows = ends.join(inside, "community", "left").join(F.broadcast(m2))  # one row
    return rows.agg(F.coalesce(F.sum(F.coalesce("inner", F.lit(0.0)) / F.col("m2") - F.pow(F.col("total") / F.col("m2"), F.lit(2.0))), F.lit(0.0)).alias("q"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node, by label propagation with pointer jumping."""
    both = cut(undirected(edges).distinct())
    labels = cut(nodes_of(edges).withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = cut(step.join(jump, "component", "left").select("node", "was", F.least("component", "far").alias("component")))
        changed = new.where("was <> component").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels


def communities(edges: DataFrame, least: int = 1, sweeps: int = 50) -> DataFrame:
    """(node, community): weighted label propagation, swept in the nodes' order, ties to the least label.

    Sweeps depend on the order of nodes, so each connected component is swept by one task; components don't touch each other.
    Communities are numbered by size, then by their first node.
    """
    e = edges.where("src <> dst").select("src", "dst", edge_weight().alias("w"))
    parts = components(edges.select("src", "dst"))
    rows = e.join(parts.select(F.col("node").alias("src"), "component"), "src").select("component", "src", "dst", "w")

    def sweep(p: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, Counter] = {}
        for s, d, w in zip(p["src"], p["dst"], p["w"], strict=True):
            near.setdefault(s, Counter())[d] += w
            near.setdefault(d, Counter())[s] += w
        label = {v: v for v in near}
        for _ in range(sweeps):
            moved = False
            for v in sorted(near):
                votes: Counter = Counter()
                for u, w in sorted(near[v].items()):
                    votes[label[u]] += w
                top = max(votes.values())
                new = min(x for x, w in votes.items() if w >= top - 1e-12)
                if new != label[v]:
                    label[v], moved = new, True
            if not moved:
                break
        return pd.DataFrame({"node": list(label), "label": list(label.values())})

    found = rows.groupBy("component").applyInPandas(sweep, "node string, label string")
    lone = nodes_of(edges).join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("label"))
    both = cut(found.union(lone))
    size = both.groupBy("label").agg(F.count("*").alias("size"), F.min("node").alias("first")).where(F.col("size") >= least)
    ids = size.withColumn("community", F.row_number().over(Window.orderBy(F.desc("size"), "first")))
    return both.join(ids, "label").select("node", "community", "size")


def community_summary(found: DataFrame, ranks: DataFrame) -> DataFrame:
    """(community, size, lead, dominant_type): ties by name."""
    rows = found.join(ranks, "node", "left").withColumn("type", note_type("node"))
    types = rows.groupBy("community", "type").agg(F.count("*").alias("n")).groupBy("community").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("dominant_type"))
    lead = rows.groupBy("community").agg(F.count("*").alias("size"), F.min_by("node", F.struct(-F.coalesce("rank", F.lit(0.0)), "node")).alias("lead"))
    return lead.join(types, "community")


def impact(edges: DataFrame, root: str, depth: int = 2, ranks: DataFrame | None = None) -> DataFrame:
    """(node, depth, relation, via, severity): what reaches the root within `depth` reverse hops, by depth, then the strongest first."""
    spark = edges.sparkSession
    order = F.struct(F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).when(F.col("severity") == "MEDIUM", 2).otherwise(3).alias("s"), "relation", "via")
    seen = spark.createDataFrame([(root,)], "node string")
    wave, out = seen, None
    for d in range(1, depth + 1):
        step = edges.join(wave.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "relation", F.col("dst").alias("via")).join(seen, "node", "left_anti")
        step = step.withColumn("depth", F.lit(d)).withColumn("severity", severity("relation", "depth"))
        best = cut(step.groupBy("node", "depth").agg(F.min_by(F.struct("relation", "via", "severity"), order).alias("b")).select("node", "depth", "b.*"))
        out = best if out is None else out.union(best)
        wave = best.select("node")
        seen = seen.union(wave)
    if out is None:
        return spark.createDataFrame([], "node string, depth int, relation string, via string, severity string")
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).when(F.col("severity") == "MEDIUM", 2).otherwise(3)
    return out.orderBy("depth", rank, "node")


def impact_summary(found: DataFrame, ranks: DataFrame) -> DataFrame:
    """(direct, indirect, critical, high, medium, low, risk, level)."""
    r = found.join(ranks, "node", "left")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    raw = F.sum(severity_weight("severity") / F.col("depth") * (1 + 10 * F.coalesce("rank", F.lit(0.0)))).alias("raw")
    agg = r.agg(count(F.col("depth") == 1)("direct"), count(F.col("depth") > 1)("indirect"), *(count(F.col("severity") == s)(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")), raw)
    agg = agg.withColumn("risk", risk_score(F.coalesce("raw", F.lit(0.0))))
    return agg.withColumn("level", risk_level(F.col("risk"))).drop("raw")


def shortest_path(edges: DataFrame, source: str, target: str, depth: int = 6, directed: bool = True, mode: str = "epistemic") -> DataFrame:
    """(hops, cost, path): the cheapest way of at most `depth` hops; ties by fewer hops, then by names. No row if there is none.

    Hop by hop, each node keeps its cheapest way; a way that is dearer than one with fewer hops goes.
    """
    spark = edges.sparkSession
    e = edges.select("src", "dst", edge_cost(mode).alias("c"))
    if not directed:
        e = e.union(e.select("dst", "src", "c"))
    e = cut(e.groupBy("src", "dst").agg(F.min("c").alias("c")))
    wave = spark.createDataFrame([(source, 0, 0.0, [source])], "node string, hops int, cost double, path array<string>")
    best = wave
    for h in range(1, depth + 1):
        step = wave.join(e, wave["node"] == e["src"]).where(~F.array_contains("path", F.col("dst")))
        step = step.select(F.col("dst").alias("node"), F.lit(h).alias("hops"), (F.col("cost") + F.col("c")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("node").agg(F.min(F.struct(F.round("cost", 9).alias("r"), "path", "cost", "hops")).alias("b")).select("node", "b.hops", "b.cost", "b.path")
        known = best.groupBy("node").agg(F.min("cost").alias("known"))
        wave = cut(step.join(known, "node", "left").where("known is null or cost < known - 1e-12").drop("known"))
        best = best.union(wave)
    hit = best.where(F.col("node") == target).orderBy(F.round("cost", 9), "hops", F.array_join("path", "\u0001")).limit(1)
    return hit.select("hops", F.round("cost", 3).alias("cost"), F.array_join("path", ">").alias("path"))


def pack(edges: DataFrame, nodes: DataFrame, root: str, depth: int = 2, budget: int = 4000, ranks: DataFrame | None = None, direction: str = "outbound") -> DataFrame:
    """(node, position, depth, tokens, place): core, fringe (its abstract) or omitted, dealt greedily by depth, rank and name.

    nodes: (id, title, content, abstract). direction: outbound, inbound or both, the way that edges are followed. A later, smaller item may still fit, so the deal is a fold over the ordered items of one
    sub-graph, which `depth` bounds.
    """
    ways = {"outbound": edges.select("src", "dst"), "inbound": edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "both": undirected(edges).distinct()}
    near = _frontier(ways[direction], root, depth)
    n = near.join(nodes, near["node"] == nodes["id"])
    n = n.join(ranks, "node", "left") if ranks is not None else n.withColumn("rank", F.lit(0.0))
    full = token_estimate(F.concat_ws("\n", "title", "content")) + F.when(F.col("depth") == 0, 0).otherwise(20)
    less = token_estimate(F.concat_ws("\n", "title", "abstract")) + 15
    items = n.select(F.struct("depth", (-F.coalesce("rank", F.lit(0.0))).alias("r"), "node", full.cast("long").alias("full"), less.cast("long").alias("less")).alias("x"))
    row = items.agg(F.sort_array(F.collect_list("x")).alias("xs"))
    fold = f"""aggregate(xs, named_struct('left', {budget}L, 'out', cast(array() as array<struct<node:string,depth:int,tokens:bigint,place:string>>)),
        (a, x) -> case when x.full <= a.left then named_struct('left', a.left - x.full, 'out', concat(a.out, array(named_struct('node', x.node, 'depth', x.depth, 'tokens', x.full, 'place', 'core'))))
            when x.less <= a.left then named_struct('left', a.left - x.less, 'out', concat(a.out, array(named_struct('node', x.node, 'depth', x.depth, 'tokens', x.less, 'place', 'fringe'))))
            else named_struct('left', a.left, 'out', concat(a.out, array(named_struct('node', x.node, 'depth', x.depth, 'tokens', 0L, 'place', 'omitted')))) end).out"""
    return row.select(F.posexplode(F.expr(fold)).alias("position", "i")).select("i.node", "position", "i.depth", "i.tokens", "i.place")


def named_degrees(edges: DataFrame, docs: DataFrame, limit: int | None = None) -> DataFrame:
    """degrees with `name`: the document's title, else the node."""
    names = docs.select(F.col("id").alias("node"), F.nullif(F.trim("title"), F.lit("")).alias("title"))
    out = degrees(edges, limit).join(names, "node", "left").withColumn("name", F.coalesce("title", "node")).drop("title")
    return out.orderBy(F.desc("total"), F.desc("in_degree"), "node")


def pagerank_order(edges: DataFrame, ranks: DataFrame, limit: int) -> DataFrame:
    """(place, node, rank, in_degree) of the first nodes by rank, then inbound edges, then name. The top is kept in each partition before it is numbered."""
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    rows = ranks.join(ins, "node", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    order = [F.desc(F.round("rank", 12)), F.desc("in_degree"), "node"]
    top = rows.orderBy(*order).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "node", "rank", "in_degree")


def inspect(edges: DataFrame, known: DataFrame, root: str, ranks: DataFrame | None = None) -> DataFrame:
    """(side, node, relation, severity, exists, rank): a node's inbound edges, the severest first, then by rank; then the outbound ones, those to known nodes first. known: (node)."""
    inb = edges.where(F.col("dst") == root).select(F.lit("in").alias("side"), F.col("src").alias("node"), "relation")
    out = edges.where(F.col("src") == root).select(F.lit("out").alias("side"), F.col("dst").alias("node"), "relation")
    rows = inb.union(out).withColumn("depth", F.lit(1)).withColumn("severity", severity("relation", "depth")).drop("depth")
    rows = rows.join(known.select("node").distinct().withColumn("e", F.lit(True)), "node", "left")
    rows = rows.join(ranks.select("node", "rank"), "node", "left") if ranks is not None else rows.withColumn("rank", F.lit(0.0))
    rows = rows.select("side", "node", "relation", "severity", F.coalesce("e", F.lit(False)).alias("exists"), F.coalesce("rank", F.lit(0.0)).alias("rank"))
    strong = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).when(F.col("severity") == "MEDIUM", 2).otherwise(3)
    inside = F.col("side") == "in"
    return rows.orderBy("side", F.when(inside, strong), F.when(inside, -F.col("rank")), F.when(~inside, ~F.col("exists")), F.when(~inside, F.col("relation")), "node")


def stats(edges: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """(nodes, edges, max_degree, avg_degree, density, hubs); hubs have four edges or, with ranks, over 0.6 of the greatest rank."""
    d = degrees(edges)
    hub = F.col("total") >= 4
    if ranks is not None:
        d = d.join(ranks.select("node", "rank"), "node", "left").join(F.broadcast(ranks.agg(F.max("rank").alias("top"))))  # one row
        hub = hub | (F.coalesce("rank", F.lit(0.0)) / F.col("top") > 0.6)
    agg = d.agg(F.count("*").alias("nodes"), (F.sum("total") / 2).cast("long").alias("edges"), F.max("total").alias("max_degree"), F.avg("total").alias("avg_degree"), F.sum(F.when(hub, 1).otherwise(0)).alias("hubs"))
    n = F.col("nodes")
    return agg.withColumn("density", F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(0.0))


def view(edges: DataFrame, ranks: DataFrame, root: str = "", found: DataFrame | None = None) -> DataFrame:
    """(node, type, degree, rank, radius, hub, color, community, community_color): what a drawing needs of each node; found: (node, community)."""
    top = ranks.agg(F.max("rank").alias("top"))
    rows = degrees(edges).join(ranks, "node").join(F.broadcast(top))  # one row
    share = F.col("rank") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)
    is_root = F.col("node") == root if root else F.lit(False)
    rows = rows.select("node", note_type("node").alias("type"), F.col("total").alias("degree"), "rank", F.round(8 + 20 * share + F.when(is_root, 6.0).otherwise(0.0), 1).alias("radius"), ((F.col("total") >= 4) | (share > 0.6)).alias("hub"), is_root.alias("root"))
    rows = rows.withColumn("color", F.when(F.col("root"), ROOT).otherwise(type_color("type")))
    rows = rows.join(found.select("node", "community"), "node", "left") if found is not None else rows.withColumn("community", F.lit(0))
    return rows.withColumn("community", F.coalesce("community", F.lit(0))).withColumn("community_color", community_color("community")).drop("root")


def view_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(json) of a view and its edges, nodes and edges in order."""
    n = nodes.agg(F.sort_array(F.collect_list(F.struct("node", *(c for c in nodes.columns if c != "node")))).alias("nodes"))
    color = F.when(F.col("status") == "INFERRED", "#818cf8").otherwise("#475569").alias("color")
    e = edges.agg(F.sort_array(F.collect_list(F.struct("src", "dst", "relation", "status", "weight", color))).alias("edges"))
    return n.join(e).select(F.to_json(F.struct("nodes", "edges")).alias("json"))


def bundle(packed: DataFrame, nodes: DataFrame, root: str, depth: int, budget: int) -> DataFrame:
    """(text): a pack as Markdown; packed as pack() gives it, nodes: (id, title, content, abstract)."""
    rows = packed.join(nodes.withColumnRenamed("id", "node"), "node", "left").withColumn("name", F.coalesce(F.nullif("title", F.lit("")), "node"))
    core = F.format_string("### %s\n- **ID:** `%s`\n- **Distância:** %d salto(s) | **Tokens Est.:** ~%d\n\n%s\n\n---\n\n", "name", "node", "depth", "tokens", F.coalesce("content", F.lit("")))
    fringe = F.format_string("| %d | **%s** (`%s`) | %d | %s |\n", "depth", "name", "node", "tokens", F.replace(F.coalesce("abstract", F.lit("")), F.lit("\n"), F.lit(" ")))
    line = F.when(F.col("place") == "core", core).when(F.col("place") == "fringe", fringe).otherwise(F.format_string("- `%s`\n", "node"))
    all_ = rows.agg(F.array_sort(F.collect_list(F.struct("position", "place", line.alias("line")))).alias("x"), F.sum("tokens").alias("tokens"), F.count(F.when(F.col("place") != "omitted", 1)).alias("n"), F.max(F.when(F.col("node") == root, F.col("name"))).alias("title"))
    part = lambda place, head: F.when(F.exists("x", lambda e: e["place"] == place), F.concat(F.lit(head), F.array_join(F.transform(F.filter("x", lambda e: e["place"] == place), lambda e: e["line"]), ""), F.lit("\n"))).otherwise("")
    head = F.format_string("# 📦 Pacote de Contexto: %s\n\n> **Nó Raiz:** `%s` | **Profundidade:** %d saltos | **Orçamento:** ~%d / %d tokens | **Nós Coletados:** %d\n\n", F.coalesce("title", F.lit(root)), F.lit(root), F.lit(depth), F.coalesce("tokens", F.lit(0)), F.lit(budget), "n")
    table = "## 📑 Resumos Periféricos (L0/L1 Micro-Abstracts)\n\n| Distância | Título / ID | Tokens | Resumo |\n| :---: | :--- | :---: | :--- |\n"
    return all_.select(F.concat(head, part("core", "## 📄 Documentos Centrais (Texto Integral)\n\n"), part("fringe", table), part("omitted", "## Omitidos\n\n")).alias("text"))


def canvas(near: DataFrame, root: str) -> DataFrame:
    """(node, x, y, side): nodes on a circle around the root, which is at the origin; sides by the angle."""
    others = near.where(F.col("node") != root)
    n = F.count("*").over(Window.partitionBy())
    i = F.row_number().over(Window.orderBy("node")) - 1
    r = F.when(F.col("n") <= 8, 420.0).when(F.col("n") <= 16, 550.0).otherwise(700.0)
    a = 2 * F.pi() * F.col("i") / F.col("n")
    side = F.when(F.cos("a") > 0.5, "right").when(F.cos("a") < -0.5, "left").when(F.sin("a") > 0, "bottom").otherwise("top")
    placed = others.select("node", n.alias("n"), i.alias("i")).withColumn("a", a)
    return placed.select("node", F.round(r * F.cos("a")).cast("long").alias("x"), F.round(r * F.sin("a")).cast("long").alias("y"), side.alias("side"))


def canvas_json(placed: DataFrame) -> DataFrame:
    """(json): one text with the nodes in order."""
    item = F.struct(F.col("node").alias("id"), F.lit("text").alias("type"), "x", "y", F.lit(260).alias("width"), F.lit(120).alias("height"), F.col("node").alias("text"))
    return placed.agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("nodes"))).alias("json"))


def mermaid(edges: DataFrame) -> DataFrame:
    """(text) of a sub-graph."""
    line = F.concat(F.lit("    "), F.regexp_replace("src", r"\W", "_"), F.lit(" -->|"), "relation", F.lit("| "), F.regexp_replace("dst", r"\W", "_"))
    return edges.agg(F.concat(F.lit("graph TD\n"), F.array_join(F.sort_array(F.collect_set(line)), "\n")).alias("text"))


def resolve(docs: DataFrame, query: str) -> DataFrame:
    """(id): by exact id or path, then title, then part of a title or path, prefixes first."""
    q = query.lower()
    tier = F.when((F.col("id") == query) | F.col("path").isin(query, query + ".md"), 0).when(F.lower("title") == q, 1).when(F.lower("title").startswith(q) | F.lower("path").startswith(q), 2).when(F.lower("title").contains(q) | F.lower("path").contains(q), 3)
    return docs.select("id", tier.alias("tier")).where("tier is not null").orderBy("tier", "id").limit(1).select("id")
