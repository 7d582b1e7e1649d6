"""Operator 2: byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

A partition's texts are cut into the pattern's matches; each distinct match (*word*) becomes token-position
rows, one per byte. A recursive query joins neighbouring tokens with the merge table and contracts each
word's leftmost pair of least rank until no pair is left. Decoding joins ids with the vocabulary and
concatenates their bytes in an ordered aggregation. A document's ids are those of its words in order.

The merge table holds every split of a vocabulary entry into two entries (rank files name results, not
pairs), so the fixpoint is the one of a library that ranks the joined bytes of neighbours.

A worker keeps one DuckDB connection (one thread, bounded memory) and the words it has met, in two generations of
bounded size, so that a frequent word is contracted once per worker. Batches are cut by bytes of text.
Words longer than LONG bytes are cut where no vocabulary entry can lie across; what is longer
even so (a run of one letter, say) goes through the same contraction with a heap, in n log n steps.

Defined results. Null or empty text: no ids (and the digests of the empty string). Null doc_id: kept as null. Repeated rows:
each is returned. Text of any length is encoded whole. Bytes that are not UTF-8 are read as U+FFFD. Extra columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import arrow_map, kept, trim

#: Keys in the newer of two generations of the worker's cache.
CACHE_WORDS = 150_000
QUERY_WORDS = 20_000
TEXT_BYTES = 4_000_000
#: Texts whose ids are laid out at once.
TEXTS = 64
LONG = 64
#: Longer words are contracted with a heap; a position in the recursive query is below 1024.
HEAP = 512
#: Marks of keys; no UTF-8 has them.
FIRST, PIECE = b"\xfe", b"\xff"
#: A stop or comma after a letter, with nothing but white space behind, is a match by itself.
MARKS = re.compile(rb"(?<=[a-zA-Z])[.,](?= |\Z)")
DUCKDB = {"threads": 1, "memory_limit": "150MB"}

# A row's place is its word and its position in one number, so that one sort finds the next token of all words.
CONTRACT = """
with recursive step as (
    select w, w::bigint * 1024 + pos as place, tok, true as live from bytes
    union all
    select w, place, tok, live from (
        with pairs as (
            select w, place, tok, lead(w) over by_place as next_w, lead(tok) over by_place as next_tok, lead(place) over by_place as next_place
            from step where live window by_place as (order by place)),
        ranked as (
            select p.*, m.merged, m.merged * 1024 + p.place % 1024 as turn
            from pairs p left join merges m on m.pair = case when p.next_w = p.w then p.tok::bigint * 1048576 + p.next_tok end),
        best as (select w, min(turn) as turn, arg_min(next_place, turn) as gone from ranked group by w)
        select r.w, r.place, case when r.turn = b.turn then r.merged::int else r.tok end as tok, b.turn is not null as live
        from ranked r join best b using (w) where b.turn is null or r.place <> b.gone
    )
)
select w, tok from step where not live order by place
"""
# One ordered aggregation for all words of a block; the widths of their tokens say where each word ends.
DECODE = "select unhex(string_agg(v.hex, '' order by t.place)) as bytes from tokens t join vocabulary v on v.id = t.tok"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 bytes and a rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encodes and decodes words; one for each worker and vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.byte = np.zeros(256, np.int32)
        left, right, merged = [], [], []
        inner: set[bytes] = set()
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.byte[token[0]] = rank
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
                inner.add(token[i - 1 : i + 2])
        #: Three-byte strings inside of entries, and entries of two bytes.
        self.inner = {x for x in inner if len(x) == 3}
        self.con = duckdb.connect(config=DUCKDB)
        pairs = np.array(left, np.int64) * 1048576 + np.array(right, np.int64)
        given = pa.table({"pair": pairs, "merged": np.array(merged, np.int64)})
        self.con.register("given", given)
        self.con.execute("create table merges as select * from given")
        self.con.unregister("given")
        given = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        self.con.register("given", given)
        self.con.execute("create table vocabulary as select * from given")
        self.con.unregister("given")
        self.width = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            self.width[rank] = len(token)
        #: Of each key its ids and the bytes that they decode to, in one string (`_pack`): tuples took as much memory again.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        #: The same of the words of keys with several.
        self.words: dict[bytes, bytes] = {}
        self.older_words: dict[bytes, bytes] = {}

    def close(self) -> None:
        self.con.close()

    def cut(self, word: bytes) -> list[bytes]:
        """Parts that no token lies across: a token across i has two bytes, or three with one of the neighbours."""
        if len(word) <= LONG:
            return [word]
        parts, begin = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.ranks and word[max(0, i - 2) : i + 1] not in self.inner and word[i - 1 : i + 2] not in self.inner:
                parts.append(word[begin:i])
                begin = i
        return [*parts, word[begin:]]

    def contract_long(self, word: bytes) -> list[int]:
        """The same fixpoint for one long word: pairs in a heap by (rank, place)."""
        tok = [int(self.byte[b]) for b in word]
        start = list(range(len(word)))
        nxt, prev, alive = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), [True] * len(word)
        end = [i + 1 for i in start]
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < len(word) and (r := self.ranks.get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(len(word)):
            push(i)
        while heap:
            r, i, e = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= len(word) or end[j] != e:
                continue
            tok[i], end[i], alive[j] = r, e, False
            nxt[i] = nxt[j]
            if nxt[i] < len(word):
                prev[nxt[i]] = i
            push(i)
            if prev[i] >= 0:
                push(prev[i])
        return [t for t, a in zip(tok, alive, strict=True) if a]

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers."""
        out = [b""] * len(words)
        todo = []
        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(w) > HEAP:
                out[i] = np.array(self.contract_long(w), "<u4").tobytes()
            elif w:
                todo.append(i)
        for k in range(0, len(todo), QUERY_WORDS):
            part = todo[k : k + QUERY_WORDS]
            flat = np.frombuffer(b"".join([words[i] for i in part]), np.uint8)
            lengths = np.array([len(words[i]) for i in part])
            starts = np.cumsum(lengths) - lengths
            rows = {"w": np.repeat(np.arange(len(part), dtype=np.int32), lengths), "pos": (np.arange(len(flat)) - np.repeat(starts, lengths)).astype(np.int32), "tok": self.byte[flat]}
            self.con.register("bytes", pa.table(rows))
            got = self.con.sql(CONTRACT).to_arrow_table()
            self.con.unregister("bytes")
            ends = (np.searchsorted(got.column("w").to_numpy(), np.arange(len(part) + 1)) * 4).tolist()
            raw = got.column("tok").to_numpy().astype("<u4").tobytes()
            for n, i in enumerate(part):
                out[i] = raw[ends[n] : ends[n + 1]]
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each string of ids; an id that the vocabulary lacks raises an error."""
        out = []
        for k in range(0, len(ids), QUERY_WORDS):
            part = ids[k : k + QUERY_WORDS]
            flat = np.frombuffer(b"".join(part), "<u4")
            if len(flat) and int(flat.max()) >= len(self.width):
                raise ValueError("id without an entry in the vocabulary")
            self.con.register("tokens", pa.table({"place": np.arange(len(flat)), "tok": flat.astype(np.int32)}))
            ((raw,),) = self.con.sql(DECODE).fetchall()
            self.con.unregister("tokens")
            at = np.concatenate([[0], np.cumsum(self.width[flat])])
            ends = at[np.cumsum([0, *map(len, part)]) // 4].tolist()
            out += [(raw or b"")[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def chunks(self, texts: list[str]) -> tuple[pa.Array, list[int], list[int]]:
        """Keys of strings at whose borders a match always begins, so that each is matched by itself; and where each text's keys begin and end.

        A key is FIRST and a string, PIECE and a match, a line break and a string, or a string that a blank precedes.
        """
        even: list[bytes] = []
        odd: list[bytes] = []
        begin, count, late = [0] * len(texts), [0] * len(texts), []
        n = 0
        for i, t in enumerate(texts):
            flat = t.replace("\n", " ")
            if not t or " ".join(flat.split()) != flat:
                begin[i] = len(odd)
                odd += [PIECE + m.encode() for m in self.pattern.findall(t)]
                count[i] = len(odd) - begin[i]
                late.append(i)
            else:
                # Every white space is one blank or line break between words: a match begins at each of them.
                even.append(FIRST + MARKS.sub(b" \xff\\g<0>", t.encode().replace(b"\n", b" \n")))
                begin[i], count[i] = n, even[-1].count(b" ") + 1
                n += count[i]
        keys = pa.array(odd, pa.large_binary())
        if even:
            whole = pa.array([b" ".join(even)], pa.large_binary())
            even.clear()
            keys = pa.concat_arrays([pc.split_pattern(whole, b" ").flatten(), keys]) if odd else pc.split_pattern(whole, b" ").flatten()
        for i in late:
            begin[i] += n
        return keys, begin, [b + c for b, c in zip(begin, count, strict=True)]

    def pieces(self, key: bytes) -> list[bytes]:
        """The matches that a key stands for, long ones cut."""
        text = key.decode() if key[:1] < FIRST else key[1:].decode()
        if key[:1] == PIECE:
            found = [key[1:]]
        elif text.isalpha() and key[:1] != FIRST:
            found = [b" " + key]
        else:
            found = [m.encode() for m in self.pattern.findall(text if key[:1] in (FIRST, b"\n") else " " + text)]
        return found if len(key) <= LONG else [p for m in found for p in self.cut(m)]

    def learn(self, keys: list[bytes]) -> None:
        """Afterwards `known` has each key."""
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
            self.older_words, self.words = self.words, {}
        known, older = self.known, self.older
        new, some = [], []
        for key in keys:
            if key not in known:
                if (x := older.get(key)) is not None:
                    known[key] = x
                elif len(key) < LONG and key.isalpha():
                    new.append(key)
                else:
                    some.append(key)
        parts = list(map(self.pieces, some))
        unseen = {p for ps in parts for p in ps if p not in self.words and p not in self.older_words}
        words = [b" " + key for key in new] + list(unseen)
        ids = self.contract(words)
        found = list(map(_pack, ids, self.decode(ids)))
        known.update(zip(new, found, strict=False))
        self.words.update(zip(words[len(new) :], found[len(new) :], strict=True))
        for key, ps in zip(some, parts, strict=True):
            of = [self.words.get(p) or self.older_words[p] for p in ps]
            known[key] = of[0] if len(of) == 1 else _pack(b"".join(map(_ids, of)), b"".join(map(_plain, of)))

    def encode(self, texts: list[str]) -> Iterator[tuple[memoryview, memoryview]]:
        """Of each text the ids as little-endian 32-bit integers and the bytes decoded from them."""
        keys, begin, end = self.chunks(texts)
        found = keys.dictionary_encode()
        del keys, texts
        places, raw = _parts(found.dictionary)
        raw, ends = bytes(raw), places.tolist()
        distinct = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        del raw, ends, places
        self.learn(distinct)
        of_ids, of_plain = (pa.array([part(self.known[k]) for k in distinct], pa.large_binary()) for part in (_ids, _plain))
        indices = found.indices
        del distinct, found
        # Ids decode one by one, so a text's bytes are those decoded from its words' ids, in order. Only some texts' are laid out at once.
        for at in range(0, len(begin), TEXTS):
            some = list(zip(begin[at : at + TEXTS], end[at : at + TEXTS], strict=True))
            for n in _runs(some):
                first = some[n[0]][0]
                part = indices.slice(first, some[n[1] - 1][1] - first)
                a, ids = _parts(of_ids.take(part))
                b, plain = _parts(of_plain.take(part))
                for i, k in some[n[0] : n[1]]:
                    yield ids[a[i - first] : a[k - first]], plain[b[i - first] : b[k - first]]


def _pack(ids: bytes, plain: bytes) -> bytes:
    return len(ids).to_bytes(4, "little") + ids + plain


def _ids(packed: bytes) -> bytes:
    return packed[4 : 4 + int.from_bytes(packed[:4], "little")]


def _plain(packed: bytes) -> bytes:
    return packed[4 + int.from_bytes(packed[:4], "little") :]


def _runs(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Ranges of spans of which each begins where the one before ends."""
    begin = 0
    for n in range(1, len(spans) + 1):
        if n == len(spans) or spans[n][0] != spans[n - 1][1]:
            yield begin, n
            begin = n


def _parts(strings: pa.LargeBinaryArray) -> tuple[np.ndarray, memoryview]:
    """Where each string begins and ends in the bytes of all."""
    _, places, raw = strings.buffers()
    begin = np.frombuffer(places, np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    return begin, memoryview(raw or b"").cast("B")


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a vocabulary; let go when the worker turns to another operator."""
    return kept(("bpe", path, pattern), lambda: Codec(path, pattern), Codec.close)


def _text(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about TEXT_BYTES of text, so that a batch is unpacked part by part."""
    begin = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= TEXT_BYTES:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, with_ids, ids array<int>, of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for a, b in _groups(batch.column(1)):
                texts = [_text(r) for r in batch.column(1).slice(a, b - a).to_pylist()]
                got = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest(), i) for i, d in own.encode(texts)]
                out = [batch.column(0).slice(a, b - a), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got]), pa.array([g[2] for g in got])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out.append(pa.array([np.frombuffer(g[3], "<u4").astype(np.int32) for g in got], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
                # What a part took is given back before the next, not after the task's last.
                del texts, got, out
                trim()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, schema, keeps="bpe")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of every row of (doc_id, ids array<int>); null ids: no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [np.array(x or [], np.int32).tobytes() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.decode(ids), pa.binary())], names=["doc_id", "bytes"])

    return arrow_map(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, bytes binary", keeps="bpe")
