"""Operator 4: exact Jaccard join on word n-grams by T-occurrence search (DivideSkip), and its connected components.

Plan, in the order of the data's shrinking:

1. One scan hashes each text to its set of word shingles. Equal sets are one *class*; copies are
   collapsed inside a batch before anything is shuffled. A class has a key of 64 bits; a second one tells
   apart classes whose keys are equal by chance, which then get new keys.
2. A prune by a necessary condition. A shingle is *live* if two classes have it. A document with n
   shingles and a partner shares at least T = ceil(t*n) of them, so of any p of its shingles at least
   p - (n - T) are live. The prune counts over the n - T shingles that may be missing and SHARE more (by hash
   order). Shingles that a batch itself shows to be live are counted there,
   and only one marker for each goes on, so that a common shingle sends a row per batch, not per document.
3. Texts of one document for each class that is left are read again: a bitmap of fixed size (SIEVE bits) of their ids is broadcast,
   and lets few other texts into the exchange by id. With many more classes left than bits it lets all pass, which costs disk, not results.
4. Documents that share enough of their rarest shingles are candidates (prefix principle): several of them where these are rare, one
   where a shingle is frequent. Candidate pairs and stars give groups outside of which no link can be.
5. Each group, or each bounded block of a larger one, holds an inverted index in one task. A query merges
   the short lists by counting, probes the long lists by binary search (DivideSkip), and retains
   the documents that reach the required overlap. A document that is already in the block's first
   component at its turn needs no query: each of its links either stays in that component or is found
   from the other end.
6. Groups of several blocks: documents outside of the group's largest component are searched for in the same way in the index of each
   block that holds sets of a size that can link, queries in blocks too. So near copies by the thousand, one component by
   then, make no pairs, and no link between components is lost.

Defined results. Null or blank text: no shingles, component_id = its own doc_id. Fewer words than n: the
whole word sequence is one shingle. Repeated rows: each row is returned. Rows with the same
doc_id and other texts are classes of their own with that id. Null doc_id: returned, it never is the smallest
id; component_id is that of its class (null if no member has an id). Extra columns are ignored, but for those to carry.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import arrow_map, connected_components, cut, list_array, release, set_keys, shingle_set

#: Elements of the sets that one task indexes at once.
BLOCK_ELEMENTS = 2_000_000
#: Members of a component that stand for it when blocks of one group are merged (a short cut; not the exact pass).
DELEGATES = 4
#: Part of a set that the prune counts over, beyond the shingles that a link may lack.
SHARE = 0.10
#: Shingles of so many classes at most are rare: pairs that share them are counted. Part of a set that the count goes over, beyond the shingles that a link may lack.
RARE, MORE = 8, 1 / 16
#: Bits of the bitmap of ids that texts are read again for (16 MB), in pieces of PIECE bits.
SIEVE, PIECE = 1 << 27, 1 << 15
#: DivideSkip's weight of a probe against a merged entry.
MU = 0.01
#: So many documents at most are probed one by one, more of them together.
FEW = 16
_MARK = 0  # class of a marker row


def required(n, num: int, den: int):
    """ceil(n * num / den): what a set of n shares at least with any partner."""
    return -(-n * num // den)


def enough(common: int, a: int, b: int, num: int, den: int) -> bool:
    return den * common >= num * (a + b - common)


def _sketch(words: int, num: int, den: int, kinds: list[pa.DataType]):
    """Rows (cid, c2, n, need, here, arr, doc_id, carried columns) of a batch; arr null if the batch has shown it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            keys = [set_keys(s) if len(s) else (_MARK, _MARK) for s in sets]
            slack = n - required(n, num, den)
            p = np.minimum(n, slack + np.maximum(1, np.floor(SHARE * n)).astype(np.int64))
            need = np.maximum(p - slack, 0)
            first = np.array(list({k: i for i, k in reversed(list(enumerate(keys))) if n[i]}.values())[::-1], np.int64)
            here = np.zeros(len(sets), np.int64)
            arrs: list[np.ndarray | None] = [None] * len(sets)
            if len(first):
                heads = [sets[i][: p[i]] for i in first]
                flat = np.concatenate(heads)
                owner = np.repeat(np.arange(len(first)), [len(h) for h in heads])
                order = np.argsort(flat, kind="stable")
                s = flat[order]
                same = np.concatenate([[False], s[1:] == s[:-1]])
                run_more = np.concatenate([same[1:], [False]])
                live = np.empty(len(flat), bool)
                live[order] = same | run_more
                keep = np.empty(len(flat), bool)
                keep[order] = ~same & ~run_more
                here[first] = np.bincount(owner[live], minlength=len(first))
                ends = np.searchsorted(owner, np.arange(len(first) + 1))
                for k, i in enumerate(first):
                    a, b = ends[k], ends[k + 1]
                    arrs[i] = flat[a:b][keep[a:b]]
                marks = s[~same & run_more]
            else:
                marks = np.empty(0, np.int64)
            lists = [a if a is not None else np.empty(0, np.int64) for a in arrs] + [marks]
            columns = [pa.array(np.array([k[j] for k in keys] + [_MARK], np.int64)) for j in (0, 1)]
            columns += [pa.array(np.append(n, -1)), pa.array(np.append(need, 0)), pa.array(np.append(here, 0)), list_array(lists)]
            # The row of the batch's markers has no values of documents.
            columns += [pa.concat_arrays([batch.column(k).cast(kind), pa.nulls(1, kind)]) for k, kind in enumerate(kinds, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["cid", "c2", "n", "need", "here", "arr", *batch.schema.names[1:]])

    return run


def _sketches(docs: DataFrame, words: int, num: int, den: int, carry: tuple[str, ...]) -> DataFrame:
    given = docs.select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f"`{c}`").cast("long").alias(c) for c in carry))
    schema = "cid long, c2 long, n long, need long, here long, arr array<long>, doc_id long" + "".join(f", `{c}` long" for c in carry)
    return arrow_map(given, _sketch(words, num, den, [pa.int64()] * (1 + len(carry))), schema)


def _apart(sketch: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """sketch with keys that differ for all classes, and the keys that were changed: of n classes about n * n / 2^65 have another's by chance."""
    clash = sketch.where("n > 0").groupBy("cid").agg(F.min("c2").alias("lo"), F.max("c2").alias("hi")).where("lo <> hi").select("cid", "lo")
    clash = cut(clash)
    if not clash.limit(1).count():
        return sketch, {}
    # A handful at any size of a corpus.
    rows = sketch.join(F.broadcast(clash), "cid").where("n > 0 and c2 <> lo").select("cid", "c2").distinct().collect()
    new = {(r.cid, r.c2): xxhash.xxh3_64_intdigest(r.cid.to_bytes(8, "little", signed=True) + r.c2.to_bytes(8, "little", signed=True)) - (1 << 63) for r in rows}
    cid = F.col("cid")
    for (c, c2), k in new.items():
        cid = F.when((F.col("cid") == c) & (F.col("c2") == c2), k).otherwise(cid)
    return sketch.withColumn("cid", cid), new


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, cid) sorted so: (cid, times) for rows whose h has another cid too. Holds the rows of one class and h at most."""
    h0, c0, pending, known = None, None, 0, False
    for batch in batches:
        h, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        out: list[np.ndarray] = []
        # rows of the run that is open from the last batch
        if h0 is not None:
            stop = int(np.searchsorted(h != h0, True)) if (h != h0).any() else len(h)
            if stop:
                head = c[:stop]
                if not known:
                    other = np.flatnonzero(head != c0)
                    if len(other):
                        known = True
                        out.append(np.full(pending + other[0], c0))
                        out.append(head[other[0] :])
                    else:
                        pending += stop
                else:
                    out.append(head)
            if stop == len(h):
                yield from _counted(out)
                continue
            h, c = h[stop:], c[stop:]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        ends = np.append(starts[1:], len(h))
        is_live = c[starts] != c[ends - 1]
        size = ends - starts
        flags = np.repeat(is_live, size)
        flags[starts[-1] :] = False
        out.append(c[flags])
        tail = c[starts[-1] :]
        h0, c0, known, pending = h[-1], tail[0], bool(is_live[-1]), len(tail)
        if known:
            out.append(tail)
        yield from _counted(out)


def _counted(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    all_ = np.concatenate(parts) if parts else np.empty(0, np.int64)
    all_ = all_[all_ != _MARK]
    if len(all_):
        u, n = np.unique(all_, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["cid", "times"])


def _survivors(sketch: DataFrame) -> DataFrame:
    """(cid, doc_id): classes that may have a partner, with one document of each. May keep too much, never too little."""
    postings = sketch.select("cid", F.explode("arr").alias("h")).select("h", "cid")
    dealt = postings.repartition("h").sortWithinPartitions("h", "cid")
    remote = arrow_map(dealt, _live, "cid long, times long").groupBy("cid").agg(F.sum("times").alias("times"))
    # A batch's own count holds for any batch that has the class; remote counts add up over batches.
    heads = sketch.where("n > 0").groupBy("cid").agg(F.sum("here").alias("here"), F.max("need").alias("need"), F.min("doc_id").alias("doc_id"))
    return heads.join(remote, "cid", "left").where("here + coalesce(times, 0) >= need").select("cid", "doc_id")


class _Index:
    """Inverted lists over the sets of one block."""

    def __init__(self, n: np.ndarray, offsets: np.ndarray, values: np.ndarray, num: int, den: int):
        self.n, self.offsets, self.values, self.num, self.den = n, offsets, values, num, den
        owner = np.repeat(np.arange(len(n), dtype=np.int64), np.diff(offsets))
        self.terms, place = np.unique(values, return_inverse=True)
        order = np.argsort(place, kind="stable")
        self.lists = owner[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(self.terms)))])
        self.place = place
        self.longest = int(np.diff(self.starts).max()) if len(self.terms) else 0

    def search(self, a: int, settled) -> list[int]:
        """Documents that reach the required overlap with a. settled(b): true if b needs no answer."""
        mine = self.place[self.offsets[a] : self.offsets[a + 1]]
        n_a = int(self.n[a])
        t = required(n_a, self.num, self.den)
        lengths = self.starts[mine + 1] - self.starts[mine]
        mine, lengths = mine[lengths > 1], lengths[lengths > 1]
        if len(mine) < t:
            return []
        order = np.argsort(lengths, kind="stable")
        n_long = min(t - 1, int(t / (MU * math.log2(max(2, self.longest)) + 1)))
        short, long = order[: len(order) - n_long], order[len(order) - n_long :]
        met = np.concatenate([self.lists[self.starts[m] : self.starts[m + 1]] for m in mine[short]])
        if 4 * len(met) > len(self.n):
            times = np.bincount(met, minlength=len(self.n))
            b = np.flatnonzero(times)
            have = times[b]
        else:
            b, have = np.unique(met, return_counts=True)
        want = required(n_a + self.n[b], self.num, self.num + self.den)
        near = (have >= t - n_long) & (b != a) & (np.minimum(n_a, self.n[b]) >= want)
        b, have, want = b[near], have[near], want[near]
        new = np.array([not settled(x) for x in b.tolist()], bool)
        b, have, want = b[new], have[new], want[new]
        probes = [self.lists[self.starts[m] : self.starts[m + 1]] for m in mine[long]]
        if len(b) > FEW:
            for k, lst in enumerate(probes):
                if k % 16 == 0:
                    alive = have + (len(probes) - k) >= want
                    b, have, want = b[alive], have[alive], want[alive]
                have = have + (lst[np.minimum(np.searchsorted(lst, b), len(lst) - 1)] == b)
            return b[enough(have, n_a, self.n[b], self.num, self.den)].tolist()
        found = []
        for b, have, want in zip(b.tolist(), have.tolist(), want.tolist(), strict=True):
            left = len(probes)
            for lst in probes:
                if have + left < want:
                    break
                left -= 1
                i = bisect_left(lst, b)
                have += i < len(lst) and lst[i] == b
            if enough(have, n_a, int(self.n[b]), self.num, self.den):
                found.append(b)
        return found


class Tree:
    """Disjoint sets of 0 .. n - 1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """True if they were apart."""
        a, b = self.find(a), self.find(b)
        self.parent[b] = a
        return a != b


def components_of(n: np.ndarray, offsets: np.ndarray, values: np.ndarray, num: int, den: int) -> np.ndarray:
    """A component number for each set: single linkage over all links of the block."""
    tree = Tree(len(n))
    if len(n) > 1:
        index = _Index(n, offsets, values, num, den)
        weight = np.add.reduceat((index.starts[index.place + 1] - index.starts[index.place]), offsets[:-1]) if len(values) else n
        pivot = int(np.argmax(weight))
        for a in [pivot, *(x for x in range(len(n)) if x != pivot)]:
            if a != pivot and tree.find(a) == tree.find(pivot):
                continue
            for b in index.search(a, lambda b, a=a: tree.find(a) == tree.find(b)):
                tree.join(a, b)
    return np.array([tree.find(x) for x in range(len(n))], np.int64)


def _solve(num: int, den: int):
    """A block's rows (cid, n, arr) to (cid, label): label is the smallest cid of its component in this block."""

    def run(tab: pa.Table) -> pa.Table:
        tab = tab.combine_chunks().sort_by("cid")
        cid, n = tab.column("cid").to_numpy(), tab.column("n").to_numpy()
        arr = tab.column("arr").combine_chunks()
        arr = pa.concat_arrays(arr.chunks) if isinstance(arr, pa.ChunkedArray) else arr
        offsets = arr.offsets.to_numpy().astype(np.int64)
        values = arr.values.to_numpy()[offsets[0] : offsets[-1]]
        comp = components_of(n, offsets - offsets[0], values, num, den)
        _, inverse = np.unique(comp, return_inverse=True)
        least = np.full(inverse.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, cid)
        return pa.table({"cid": cid, "label": least[inverse]})

    return run


def _blocks(rows: DataFrame, level: int) -> DataFrame:
    """rows (cid, sg, n, arr) with `block`, each of bounded size, and `blocks` of its group."""
    weight = rows.groupBy("sg").agg(F.sum(F.size("arr") + 16).alias("weight"))
    rows = rows.join(weight, "sg").withColumn("blocks", F.ceil(F.col("weight") / BLOCK_ELEMENTS))
    return rows.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "cid"), F.col("blocks"))).drop("weight")


def _again(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """text (binary) of the documents with one of the distinct ids (doc_id), or with none."""
    bit = lambda: F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SIEVE))
    pieces = ids.select(bit().alias("bit")).groupBy(F.expr(f"bit div {PIECE}").alias("piece")).agg(F.expr(f"bitmap_construct_agg(bit % {PIECE})").alias("bits"))
    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # SIEVE / PIECE rows of PIECE bits at most.
    met = given.withColumn("bit", bit()).withColumn("piece", F.expr(f"bit div {PIECE}")).join(F.broadcast(pieces), "piece")
    met = met.where(F.expr(f"cast(conv(hex(substring(bits, cast((bit % {PIECE}) div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(bit % 8 as int)) <> 0"))
    # Not a semi-join: that one would be put before the bitmap.
    found = met.select("doc_id", "text").join(ids, "doc_id").select("text")
    return found.union(docs.where("doc_id is null").select(F.col("text").cast("binary")))


def _candidates(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): edges over which any two sets that link are connected. rows (cid, n, arr by rarity, p, low: how many of arr at most RARE classes have).

    Of two sets that link, let a be the one whose first p + MORE * n shingles end first: all but t - need of its shingles are among these, and so `need` of those that both have, where need exceeds MORE * n.
    Pairs on rare shingles are counted, so that a single shingle that strangers share ties no groups together. Sets that reach frequent shingles (not `pure`) meet as stars there.
    """
    q = F.least(F.size("arr"), F.col("p") + F.floor(MORE * F.col("n"))).cast("int")
    rows = rows.withColumn("q", q).withColumn("need", F.col("q") - F.col("p") + 1).withColumn("pure", F.col("q") <= F.col("low"))
    rare = rows.select("cid", "n", "need", "pure", F.explode(F.slice("arr", F.lit(1), F.least("q", "low"))).alias("h"))
    met = rare.groupBy("h").agg(F.collect_list(F.struct("cid", "n", "need", "pure")).alias("c")).where("size(c) > 1")  # RARE at most
    pair = "struct(least(x.cid, y.cid) as a, greatest(x.cid, y.cid) as b, if(x.pure or y.pure, least(x.need, y.need), 1) as need)"
    fits = f"y -> {den}l * least(x.n, y.n) >= {num}l * greatest(x.n, y.n)"
    pairs = met.select(F.explode(F.expr(f"flatten(transform(c, (x, i) -> transform(filter(slice(c, i + 2, {RARE}), {fits}), y -> {pair})))")).alias("r")).select("r.*")
    close = pairs.groupBy("a", "b").agg(F.count("*").alias("both"), F.max("need").alias("need")).where("both >= need").select("a", "b")

    often = rows.where("not pure and p > low").select("cid", F.explode(F.slice("arr", F.col("low") + 1, F.col("p") - F.col("low"))).alias("h"))
    hubs = often.groupBy("h").agg(F.min("cid").alias("hub"), F.max("cid").alias("top")).where("hub <> top").select("h", "hub")
    stars = often.join(hubs, "h").where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct()
    return close.union(stars)


def ngram_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: documents link if den*|A n B| >= num*|A u B|.

    words: shingle length; num/den: the threshold as a fraction; carry: columns of longs that rows keep, with `label`, a number of their component
    (null without shingles), which rows without an id have too. See the module's notes for defined results.
    """
    sketch, changed = _apart(cut(_sketches(docs, words, num, den, carry)))
    maybe = cut(_survivors(sketch))

    # Texts of one document for each class that is left; ids may repeat, so the class is computed again.
    again = _again(docs, maybe.select("doc_id").where("doc_id is not null").distinct())
    whole = arrow_map(again, _whole(words, changed), "cid long, n long, arr array<long>")
    whole = cut(whole.join(maybe.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]))

    # Shingles that two classes have, with their number of classes.
    postings = whole.select("cid", F.explode("arr").alias("h"))
    df = postings.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    lived = postings.join(df, "h").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("live"))
    rows = whole.select("cid", "n").join(lived, "cid").withColumn("t", F.expr(f"cast(ceil(n * {num}l / {den}l) as int)"))
    # The n - t + 1 rarest: shingles that are not live come first and share nothing.
    rows = rows.where(F.size("live") >= F.col("t")).withColumn("p", F.size("live") - F.col("t") + 1)
    low = F.size(F.filter("live", lambda x: x["df"] <= RARE)).alias("low")
    rows = cut(rows.select("cid", "n", F.col("live.h").alias("arr"), F.col("p").cast("int").alias("p"), low))
    release(whole)

    groups = connected_components(_candidates(rows, num, den)).select(F.col("node").alias("cid"), F.col("label").alias("sg"))

    solve = _solve(num, den)
    items = cut(_blocks(rows.join(groups, "cid").withColumn("arr", F.sort_array("arr")).select("cid", "sg", "n", "arr"), 0))
    release(rows)
    labels = cut(items.groupBy("sg", "block").applyInArrow(solve, "cid long, label long"))
    links = labels.where("cid <> label").select(F.col("cid").alias("a"), F.col("label").alias("b"))

    split = items.where("blocks > 1")
    if split.limit(1).count():
        links = links.union(_across(split, labels, solve, num, den))
    final = connected_components(links)
    for used in (items, labels, maybe):
        release(used)

    member = sketch.where("n >= 0").select("doc_id", "cid", "n", *carry)
    classes = member.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"))
    classes = classes.join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    tops = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = classes.join(tops, "label").select("cid", "component_id", "label")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return member.join(named, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *((*carry, "label") if carry else ()))


def _whole(words: int, changed: dict[tuple[int, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sets = [s for t in batch.column(0).slice(at, 1000).to_pylist() if len(s := shingle_set(t, words))]
                keys = [changed.get(k, k[0]) for k in map(set_keys, sets)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), list_array(sets)], names=["cid", "n", "arr"])

    return run


def _across(split: DataFrame, labels: DataFrame, solve, num: int, den: int) -> DataFrame:
    """Links (a, b) that join components of different blocks of a group: delegates first, then a search from all but the largest component."""
    own = split.join(labels, "cid")
    few = own.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("cid")))).where(f"k <= {DELEGATES}")
    met = cut(_blocks(few.select("cid", "sg", "n", "arr"), 1).groupBy("sg", "block").applyInArrow(solve, "cid long, label long"))
    links = met.where("cid <> label").select(F.col("cid").alias("a"), F.col("label").alias("b"))
    inside = own.where("cid <> label").select(F.col("cid").alias("a"), F.col("label").alias("b"))
    joined = connected_components(links.union(inside))
    state = own.select("cid", "sg", "n", "arr").join(joined.select(F.col("node").alias("cid"), F.col("label").alias("comp")), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    size = state.groupBy("sg", "comp").agg(F.count("*").alias("size"))
    main = size.groupBy("sg").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"))
    # Sets link only to sets of their own band of sizes or of the next to it.
    band = F.floor(F.log("n") / math.log(den / num + 1e-9)) if num < den else F.col("n")
    state = state.join(main, "sg").withColumn("band", band.cast("long"))
    index = _dealt(state.select("cid", "sg", "n", "arr", "comp", "band"), "y")
    asked = state.where("comp <> main").select("cid", "sg", "n", "arr", "comp", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("band"))
    asked = _dealt(asked, "x")
    sizes = lambda d, k: d.select("sg", "band", f"{k}s").distinct()
    index = index.join(sizes(asked, "x"), ["sg", "band"]).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
    asked = asked.join(sizes(index, "y"), ["sg", "band"]).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("ys") - 1)))
    cols = ["sg", "band", "x", "y", "cid", "n", "comp", "arr"]
    both = index.select(*cols, F.lit(False).alias("asked")).union(asked.select(*cols, F.lit(True)))
    found = both.groupBy("sg", "band", "x", "y").applyInArrow(_searched(num, den), "a long, b long")
    return links.union(cut(found))


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    """rows (cid, sg, band, arr, ...) dealt to blocks of bounded size of their group and band: the block in `name`, the number of blocks in `names`."""
    weight = rows.groupBy("sg", "band").agg(F.ceil(F.sum(F.size("arr") + 16) / BLOCK_ELEMENTS).alias(f"{name}s"))
    return rows.join(weight, ["sg", "band"]).withColumn(name, F.pmod(F.xxhash64(F.lit(name), "cid"), F.col(f"{name}s")))


def _searched(num: int, den: int):
    """A block of queries searched for in a block's index, both of rows (cid, n, comp, arr, asked): links (a, b) between components."""

    def run(tab: pa.Table) -> pa.Table:
        tab = tab.combine_chunks().sort_by([("asked", "ascending"), ("cid", "ascending")])
        cid, n, comp, asked = (tab.column(c).to_numpy() for c in ("cid", "n", "comp", "asked"))
        arr = tab.column("arr").combine_chunks()
        arr = pa.concat_arrays(arr.chunks) if isinstance(arr, pa.ChunkedArray) else arr
        offsets = arr.offsets.to_numpy().astype(np.int64)
        values = arr.values.to_numpy()[offsets[0] : offsets[-1]]
        tree = Tree(len(cid))
        head: dict[int, int] = {}
        for i, c in enumerate(comp.tolist()):
            tree.join(i, head.setdefault(c, i))
        links = []
        if len(cid):
            index = _Index(n, offsets - offsets[0], values, num, den)
            for a in np.flatnonzero(asked).tolist():
                for b in index.search(a, lambda b, a=a: tree.find(a) == tree.find(b)):
                    if tree.join(a, b):
                        links.append((cid[a], cid[b]))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run
