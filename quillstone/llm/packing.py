"""Operator 11: best-fit packing, certified by bounds.

Documents become token ids, then pieces of at most `capacity` ids. Each batch of pieces of a partition is packed by best-fit decreasing, and dual feasible
functions give a lower bound of its bins. A batch that needs more bins than its bound, or has more than a bin's worth of room, exchanges the pieces of all bins with
room; a certified one only those of its emptiest bin. What is exchanged is dealt anew in groups of about GROUP pieces or BINS bins' worth, whichever are more, and packed again, round by round, until the bins of all are as few as the bound of all
lengths (of which there are at most `capacity`), or a round saves no bin; a round that would cost bins is not taken. Pieces as long as a bin are bins of their own.

The ids are those of the tokenizers library. It is slow, so a word (cut at ASCII white space, which no token crosses) is looked up among those met before; a new one that is
of characters up to Latin-1, which no normal form changes, is put together of the ids of its runs of letters, digits and marks, which the same vocabulary encodes without a normaliser; any other goes through the whole tokenizer.

Defined results. A null text is empty: its only id is the end's. Repeated rows are packed each. Null ids of documents stay. Special tokens' strings are ordinary text. A text is cut by `capacity` only.
Columns named sequence_id, offset or like a piece's own facts are dropped; other extra columns are not carried. An empty table gives no rows. Reruns give the same pieces; sequences may be numbered and filled otherwise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from quillstone.llm.common import arrow_map, cut, kept

CAPACITY, END = 4096, 1
#: Pieces and bins' worth of tokens that are packed together at least, pieces at most; rounds; bytes of text encoded at once; words, and runs of letters or marks, that a worker remembers.
GROUP, BINS, MOST, ROUNDS, SLICE, WORDS, RUNS = 8192, 64, 1 << 18, 8, 4 << 20, 400_000, 800_000
LETTERS, MARKS, LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", ".,;:!?", r"^[\x21-\x7e\x{a1}-\x{ff}]+$"
#: Where the vocabulary's tokenizer cuts words (fixed value).
CUTS = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"


# ------------------------------------------------------------------ ids


class Encoder:
    """Ids of many texts at once, as the vocabulary at `path` has them; no special tokens."""

    def __init__(self, path: str):
        self.full, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.full.encode_special_tokens = self.bare.encode_special_tokens = True
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # The last token of a run of letters or marks, and no other, is one that ends a word.
        self.last = np.zeros(self.bare.get_vocab_size(), bool)
        self.last[[i for token, i in self.bare.get_vocab().items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self, letters: bool = True) -> None:
        """Lets go of the words met so far, which are numbers of runs of ids, and of runs of letters and marks too."""
        kept = [] if letters else list(self.letters)
        ids, ends = self._runs(np.fromiter(map(self.letters.__getitem__, kept), np.int64, len(kept))) if kept else (np.empty(0, np.uint32), np.empty(0, np.int64))
        self.words, self.letters = {"": 0}, {}
        self.ids, self.start, self.size, self.n, self.used = np.empty(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 1, 0
        first = self._add(ids, np.diff(ends, prepend=0))
        self.letters.update(zip(kept, range(first, first + len(kept))))

    def _room(self, name: str, n: int) -> None:
        a = getattr(self, name)
        if n > len(a):
            bigger = np.zeros(max(n, 2 * len(a)), a.dtype)
            bigger[: len(a)] = a
            setattr(self, name, bigger)

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Keeps runs of ids; the number of the first."""
        first, n = self.n, len(sizes)
        self._room("ids", self.used + len(ids))
        self._room("start", first + n)
        self._room("size", first + n)
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[first : first + n] = sizes
        self.start[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + len(ids), first + n
        return first

    def _whole(self, words: list[str]) -> int:
        """Runs of words by the whole tokenizer."""
        found = [e.ids for e in self.full.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return self._add(np.fromiter((i for f in found for i in f), np.uint32, int(sizes.sum())), sizes)

    def _simple(self, parts: list[str]) -> int:
        """Runs of letters or marks, each of which is one word to the tokenizer."""
        ids = np.array(self.bare.encode_batch_fast([parts], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        return self._add(ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1))

    def _runs(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs one after the other, and where each ends."""
        sizes = self.size[index]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.start[index] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _parts(self, parts: pa.Array) -> np.ndarray:
        """Numbers of the runs of words' letters or marks."""
        d = parts.dictionary_encode()
        known = d.dictionary.to_pylist()
        new = [p for p in known if p not in self.letters]
        if new:
            self.letters.update(zip(new, range(first := self._simple(new), first + len(new))))
        return np.fromiter(map(self.letters.__getitem__, known), np.int64, len(known))[d.indices.to_numpy()]

    def _learn(self, words: list[str]) -> None:
        """Runs of new words."""
        whole = pa.array(words, pa.string())
        core = pc.utf8_rtrim(whole, MARKS)
        # Other letters than these change under a normal form, or in lower case by more than a letter.
        plain = pc.match_substring_regex(core, LETTERS).to_numpy(zero_copy_only=False)
        behind = (pc.binary_length(whole).to_numpy() - pc.binary_length(core).to_numpy()) * plain
        core = pc.utf8_lower(core)
        bare, marked, odd = np.flatnonzero(plain & (behind == 0)), np.flatnonzero(behind), np.flatnonzero(~plain)
        mixed = pc.match_substring_regex(whole.take(pa.array(odd)), LATIN).to_numpy(zero_copy_only=False)
        mixed, odd = odd[mixed], odd[~mixed]
        if len(bare):
            self.words.update(zip([words[i] for i in bare], self._parts(core.take(pa.array(bare))).tolist()))
        if len(marked):
            ends = [words[i][-b:] for i, b in zip(marked.tolist(), behind[marked].tolist())]
            both = np.stack([self._parts(core.take(pa.array(marked))), self._parts(pa.array(ends))], 1)
            ids, at = self._runs(both.ravel())
            at = at[1::2]
            first = self._add(ids, np.diff(at, prepend=0))
            self.words.update(zip([words[i] for i in marked], range(first, first + len(marked))))
        if len(mixed):
            split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(whole.take(pa.array(mixed))), CUTS, r"\1 ")))
            ids, at = self._runs(self._parts(split.flatten()))
            ends = np.concatenate([[0], at])[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]
            first = self._add(ids, np.diff(ends, prepend=0))
            self.words.update(zip([words[i] for i in mixed], range(first, first + len(mixed))))
        if len(odd):
            said = [words[i] for i in odd]
            first = self._whole(said)
            self.words.update(zip(said, range(first, first + len(odd))))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after the other, and where each text's end."""
        split = pc.ascii_split_whitespace(_lowered(texts))
        d = split.flatten().dictionary_encode()
        met = d.dictionary.to_pylist()
        if len(self.words) > WORDS:
            self.forget(len(self.letters) > RUNS)  # letters are dearer to encode than words to put together
        new = [w for w in met if w not in self.words]
        if new:
            self._learn(new)
        index = np.fromiter(map(self.words.__getitem__, met), np.int64, len(met))[d.indices.to_numpy()]
        ids, ends = self._runs(index)
        ends = np.concatenate([[0], ends])
        offsets = split.offsets.to_numpy()
        return ids, ends[offsets[1:] - offsets[0]]


def _lowered(texts: pa.StringArray) -> pa.StringArray:
    """Texts with A to Z in lower case, so that fewer words differ; but for those with characters beyond Latin-1, as a mark may join the letter before it."""
    size = pc.binary_length(texts).to_numpy()
    some, at = size > 0, np.cumsum(size) - size
    begin = int(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]) if len(texts) else 0
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[begin:]
    plain = np.ones(len(texts), bool)
    if some.any():
        plain[some] = np.maximum.reduceat(data[: int(size.sum())], at[some]) <= 0xC3
    return pc.if_else(pa.array(plain), pc.ascii_lower(texts), texts)


def _slices(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE bytes."""
    size = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
        yield at, upto
        at = upto


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids, ended by `end`, cut where they pass `capacity`; with_ids: the ids too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("op11", vocabulary), lambda: Encoder(vocabulary), Encoder.forget)
        for b in batches:
            keys, texts = b.column(0), b.column(1).fill_null("")
            for lo, hi in _slices(texts):
                ids, ends = encoder.encode(texts[lo:hi])
                row, piece, start, length, crc, said, at = [], [], [], [], [], [], 0
                for k, z in enumerate(ends.tolist()):
                    own, at = np.append(ids[at:z], np.uint32(end)), z
                    for n, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        row.append(lo + k)
                        piece.append(n)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.astype("<u4", copy=False)))
                        if with_ids:
                            said.append(part)
                columns = [keys.take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                columns += [pa.array(said, pa.list_(pa.int64()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, [*("doc_id", "piece", "start", "length", "ids_crc32"), *(["ids"] if with_ids else [])])

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids, keeps="op11")


# ------------------------------------------------------------------ bins


def least_bins(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """A lower bound of the bins of `counts` items of each of `sizes`, by dual feasible functions.

    Of sizes to values whose sum over any bin is at most 1: the size itself; for each e to half a bin, 1 for sizes over 1 - e, 0 for those under e; for each k, the size rounded down to
    kths of (k + 1) times it.
    """
    order = np.argsort(sizes)
    s, c = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    many, whole = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(s * c)])
    e = np.unique(np.concatenate([[0], s[2 * s <= capacity]]))
    low, high = np.searchsorted(s, e, "left"), np.searchsorted(s, capacity - e, "right")
    best = -(-((many[-1] - many[high]) * capacity + whole[high] - whole[low]) // capacity)
    found = [int(best.max(initial=0))]
    for k in range(1, 33):
        times = (k + 1) * s
        even = times % capacity == 0
        found.append(-(-(int((c * (times // capacity))[~even].sum()) * capacity + int((c * s)[even].sum()) * k) // (k * capacity)))
    return max(found)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and place in it, and the bins' room. The fullest bin that an item fits is found in a set of bits, one for each room."""
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    bits, room = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = bits >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                bits ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(0)
        bins[i], places[i] = b, capacity - r
        room[b] = r - n
        if r > n:
            by_room.setdefault(r - n, []).append(b)
            bits |= 1 << (r - n)
    return bins, places, np.array(room, np.int64)


def _packed(t: pa.Table, number: int, capacity: int) -> pa.Table:
    """Rows with sequence_id (from number on), offset, and whether their bin is open to an exchange."""
    lengths = t["length"].to_numpy()
    bins, places, room = best_fit(lengths, capacity)
    bound = least_bins(*np.unique(lengths, return_counts=True), capacity)
    if len(room) > bound or room.sum() >= capacity:
        open_ = room > 0
    else:
        open_ = np.zeros(len(room), bool)
        open_[np.argmax(room)] = room.max() > 0
    for name, values in (("sequence_id", number + bins), ("offset", places), ("open", open_[bins])):
        t = t.append_column(name, pa.array(values))
    return t


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (with length, 1 to capacity) with sequence_id and offset: pieces in as few sequences of `capacity` as the rounds find."""
    rows = cut(rows)
    ddl = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes) + ", sequence_id long, offset long, open boolean"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)
    lengths = rows.groupBy("length").count().collect()  # capacity rows at most
    least = least_bins(np.array([r["length"] for r in lengths], np.int64), np.array([r["count"] for r in lengths], np.int64), capacity)

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers of sequences: round, partition or group, place.
        number, held, n, tokens = TaskContext.get().partitionId() << 32, [], 0, 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, n, tokens
            t = pa.Table.from_batches(held)
            full = pc.equal(t["length"], capacity)
            alone, rest = t.filter(full), t.filter(pc.invert(full))
            whole = alone.num_rows
            for name, values in (("sequence_id", number + np.arange(whole)), ("offset", np.zeros(whole, np.int64)), ("open", np.zeros(whole, bool))):
                alone = alone.append_column(name, pa.array(values))
            yield from alone.cast(schema).to_batches()
            yield from _packed(rest, number + whole, capacity).cast(schema).to_batches()
            number, held, n, tokens = number + t.num_rows, [], 0, 0

        for b in batches:
            held.append(b)
            n += b.num_rows
            tokens += pc.sum(b["length"]).as_py()
            if n >= MOST or (n >= GROUP and tokens >= BINS * capacity):
                yield from packed()
        if n:
            yield from packed()

    def again(round_: int):
        return lambda key, t: _packed(t.drop_columns(["g", "sequence_id", "offset", "open"]), (round_ << 56) + (key[0].as_py() << 32), capacity).cast(schema)

    now = cut(arrow_map(rows, first, ddl))
    closed, open_, spare, waiting = now.where("not open"), now.where("open"), *now.where("offset = 0").agg(F.count("*") - least, F.count_if("open")).first()
    for k in range(1, ROUNDS):
        if not spare or not waiting:
            break
        many, tokens = open_.agg(F.count("*"), F.sum("length")).first()
        groups = max(-(-many // MOST), min(-(-many // GROUP), -(-tokens // (BINS * capacity))))
        dealt = open_.withColumn("g", F.pmod(F.xxhash64("sequence_id", "offset", F.lit(k)), F.lit(groups)))
        now = cut(dealt.groupBy("g").applyInArrow(again(k), ddl))
        bins, left = now.where("offset = 0").agg(F.count("*"), F.count_if("open")).first()
        if bins >= waiting:
            break
        closed, open_, spare, waiting = closed.union(now.where("not open")), now.where("open"), spare - (waiting - bins), left
    return closed.union(open_).drop("open")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that hold their ids; a sequence is at most a bin."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
