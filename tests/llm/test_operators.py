"""The ten operators against brute force, and on rows that are null, empty, long, equal or odd."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import bpe, classifier, html_text, licenses, mixing, ngram_join, quality_rules, substring_dedup, token_counts, topk
from quillstone.llm.queries import VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, cid string, h string, `words` string, size string, target string, grp string"
PATTERN = public_tokenizers.PATTERN
LONG = " ".join(f"w{i % 977}x{i % 31}." for i in range(20_000))


def base_rows():
    r = random.Random(5)
    word = lambda: "".join(r.choices(["the", "an", "re", "ti", "on", "er", "é"], k=r.randint(1, 4)))
    text = lambda n: re.sub(r"(\w+) (\w+) (\w+) (\w+)\b", r"\1 \2 \3 \4.", " ".join(word() for _ in range(n)))
    rows = [(i, text(r.randint(1, 120)), r.choice(["en", "fr"]), r.choice(["a", "b", "c", None])) for i in range(60)]
    passage = text(80)
    for i in range(60, 80):
        rows.append((i, f"{text(20)}\n{passage}\n{text(20)}", "en", "a"))
    base = text(150).split()
    for i in range(80, 110):
        w = list(base)
        w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w), "fr", "b"))
    rows += [(i, rows[3][1], "en", "c") for i in range(110, 125)]
    return rows


def dirty_rows():
    return [(200, None, None, None), (201, "", "en", "a"), (202, " \n\t ", "en", "a"), (None, "some text of no id", "en", "a"), (203, LONG, "en", "a"), (204, "same row twice over", "en", "b"), (204, "same row twice over", "en", "b"), (204, "another text of that id", None, "b"), (205, "a" * 3000, "en", None), (206, "naïve 漢字 \x00 #tag|", "en", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *"xyzuvwt") for r in base_rows() + dirty_rows()], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, num, den):
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(s), (least.get(find(i)) if s else r[0])) for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("block", [2_000_000, 900])
def test_ngram_join(docs, none, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ELEMENTS", block)
    got = Counter(tuple(r) for r in ngram_join.ngram_components(docs, 4, 85, 100).collect())
    assert got == brute_components(base_rows() + dirty_rows(), 4, 85, 100)
    if block > 1000:
        assert ngram_join.ngram_components(none).count() == 0


def test_divide_skip_finds_all_links():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 40)) for _ in range(60)]
    n = np.array([len(s) for s in sets])
    index = ngram_join._Index(n, np.concatenate([[0], np.cumsum(n)]), np.concatenate(sets), 50, 100)
    for a in range(60):
        want = {b for b in range(60) if b != a and 2 * len(set(sets[a]) & set(sets[b])) >= len(set(sets[a]) | set(sets[b]))}
        assert set(index.search(a, lambda b: False)) == want


def test_divide_skip_across_blocks():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, 40)) for _ in range(80)]
    comp = r.integers(0, 30, 80)
    rows = [(i, len(sets[i]), int(comp[i]), sets[i].tolist(), a) for a in (False, True) for i in (range(50) if not a else range(40, 80))]
    tab = pa.table({"cid": [x[0] for x in rows], "n": [x[1] for x in rows], "comp": [x[2] for x in rows], "arr": pa.array([x[3] for x in rows], pa.list_(pa.int64())), "asked": [x[4] for x in rows]})
    got = ngram_join._searched(50, 100)(tab)
    tree, want = ngram_join.Tree(110), ngram_join.Tree(110)
    for t in (tree, want):
        for i in range(80):
            t.join(80 + comp[i], i)
    for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist()):
        assert 2 * len(set(sets[a]) & set(sets[b])) >= len(set(sets[a]) | set(sets[b])) and comp[a] != comp[b]
        tree.join(a, b)
    for a in range(40, 80):
        for b in range(50):
            if 2 * len(set(sets[a]) & set(sets[b])) >= len(set(sets[a]) | set(sets[b])):
                want.join(a, b)
    same = lambda t: [[t.find(i) == t.find(j) for j in range(80)] for i in range(80)]
    assert same(tree) == same(want)


def test_equal_keys_of_classes(spark):
    rows = spark.createDataFrame([(5, 1, 2, 1), (5, 1, 2, 2), (5, 9, 3, 3), (6, 1, 2, 4), (0, 0, -1, None), (0, 0, 0, 7)], "cid long, c2 long, n long, doc_id long")
    out, changed = ngram_join._apart(rows)
    key = {r.doc_id: r.cid for r in out.collect()}
    assert key[1] == key[2] == 5 and key[4] == 6 and key[7] == key[None] == 0
    assert key[3] not in (5, 6) and changed == {(5, 9): key[3]}
    assert ngram_join._apart(rows.where("c2 < 9"))[1] == {}


def test_texts_read_again(docs):
    ids = docs.where("doc_id % 7 = 0").select("doc_id").distinct()
    got = Counter(bytes(r.text) for r in ngram_join._again(docs, ids).collect() if r.text is not None)
    assert got == Counter(t.encode() for i, t, _, _ in base_rows() + dirty_rows() if t is not None and (i is None or i % 7 == 0))


def test_bpe(docs, none):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in bpe.encode(docs, VOCABULARY, PATTERN).collect())
    want = Counter()
    for r in base_rows() + dirty_rows():
        ids = own.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), tuple(ids)] += 1
    assert got == want
    back = bpe.decode(bpe.encode(docs, VOCABULARY, PATTERN), VOCABULARY, PATTERN).collect()
    assert Counter(bytes(r.bytes) for r in back) == Counter((r[1] or "").encode() for r in base_rows() + dirty_rows())
    assert bpe.encode(none, VOCABULARY, PATTERN).count() == 0


def test_bpe_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    texts = ["one two three four five", "six\nseven two, eight", "é 漢字  two one.", ""]
    own = bpe.Codec(VOCABULARY, PATTERN)
    whole = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for _ in range(3):
        for t in texts:
            ((ids, plain),) = own.encode([t])
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode_ordinary(t) and plain == t.encode()
    # The bytes come from the ids: a word with other ids decodes to other bytes.
    own.known.clear(), own.older.clear(), own.words.clear(), own.older_words.clear()
    monkeypatch.setattr(own, "contract", lambda words: [int(own.byte[120]).to_bytes(4, "little")] * len(words))
    assert [d for _, d in own.encode(["two"])] == [b"x"]


def test_bpe_long_words():
    own = bpe.codec(VOCABULARY, PATTERN)
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    texts = ["漢字" * 900, "ab" * 1500, "<|endoftext|> 's", "a  b\n\nc \n d", "Zq9/+" * 300]
    assert [np.frombuffer(i, "<u4").tolist() for i, _ in own.encode(texts)] == [lib.encode_ordinary(t) for t in texts]


def test_top_k(spark):
    r = np.random.default_rng(2)
    v = [(i, r.standard_normal(64).round(3).tolist()) for i in range(300)] + [(i, [1.0] * 64) for i in range(300, 420)] + [(500, None), (501, []), (None, [1.0] * 64), (7, None)]
    rows = spark.createDataFrame([(*x, "seg") for x in v], "vec_id long, embedding array<float>, seg string")
    codes = topk.binary_codes(rows, "vec_id", "embedding")
    got = {(x.query_id, x.rank): (x.id, x.distance) for x in topk.exact_top_k(codes, codes.where("id % 100 = 0"), 10).collect()}
    code = {i: sum(1 << k for k, x in enumerate(e) if x > 0) for i, e in v if i is not None and e}
    for q in (x for x in code if x % 100 == 0):
        want = sorted((bin(code[q] ^ c).count("1"), i) for i, c in code.items())[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, d) for d, i in want]
    few = codes.where("id < 3")
    assert topk.exact_top_k(few, few.where("id = 0"), 10).count() == 3
    assert topk.exact_top_k(codes.where("id < 0"), codes.where("id = 0"), 10).count() == 0


def test_token_counts(spark, docs, tmp_path):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})
    gone = spark.createDataFrame([(1,), (1,), (2,)], "doc_id long")
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in token_counts.maintained_counts(docs, gone, VOCABULARY, "v").collect()}
    want = {}
    for i, t, la, s in base_rows() + dirty_rows():
        n = want.setdefault((s, la), [0, 0])
        if i not in (1, 2):
            n[0] += 1
            n[1] += len(own.encode_ordinary(t or ""))
    assert got == {k: tuple(v) for k, v in want.items()}
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    batch = spark.createDataFrame([("insert", "a", "en", "v", 5, None), ("revise", "a", "en", "v", 7, 5), ("delete", "a", "en", "v", None, 7)], token_counts.CHANGE)
    assert rollup.commit("one", batch) and not rollup.commit("one", batch)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 0, 0)]
    assert rollup.compact(str(tmp_path / "c")).totals().count() == 1


def test_html(spark):
    page = lambda i, body: f"<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><header>Top</header>{body}<aside>side</aside><div class='ad'>Buy</div><footer>&copy; x</footer></body></html>"
    a = lambda i: page(i, f"<article><h1>Head {i}</h1><p><b>First&amp; {i}<br><p>Second  \n line {i}</p><script>x('</p>')</script><section class='comments'><p>spam</p></section></article>")
    b = lambda i: page(i, f"<div><p>We like cakes</p><p>Body {i}</p></div>")
    rows = [(i, "http://h.example/x", a(i)) for i in range(5)] + [(10 + i, "http://g.example/x", b(i)) for i in range(5)] + [(20, "http://one.example/", b(9)), (21, None, None), (22, "http://h.example/y", ""), (23, "http://h.example/z", "<article><p>cut &lt;off <b>te"), (24, "u", "plain < text"), (None, "u", a(1))]
    given = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, token string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(given).collect()}
    assert got[3] == ("Head 3\nFirst& 3\nSecond line 3", len("Head 3\nFirst& 3\nSecond line 3"))
    assert got[12][0] == "Body 2"  # "We like cakes" is the host's template
    assert got[20][0] == "We like cakes\nBody 9"
    assert got[21] == got[22] == ("", 0)
    assert got[23][0] == "cut <off te" and got[24][0] == "plain < text"
    assert len(got) == len(rows)
    # Templates beyond the bound of a broadcast meet their pages by host and salt.
    assert {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(given, broadcast_entries=0).collect()} == got
    assert html_text.extract_text(given.limit(0)).collect() == []


def test_html_template_inside_articles(spark):
    page = lambda host, i, body: (i, f"http://{host}.example/{i}", f"<html><body><main><div class='c2'>All our shops</div>{body}<p>Written by the staff</p></main></body></html>")
    own = [page("a", i, f"<h1>Head {i}</h1><p>Story {i} is told here, at some length</p>") for i in range(6)]
    copies = [page("b", 10 + i, "<h1>Head</h1><p>One story for all</p>") for i in range(6)]
    near = [page("c", 20 + i, f"<h1>Head</h1><p>{'One story for all. ' * 20}</p><p>Version {i}</p>") for i in range(6)]
    bare = [(30 + i, f"http://d.example/{i}", "<html><body><div><p>One</p><p>text</p></div></body></html>") for i in range(4)]
    given = spark.createDataFrame(own + copies + near + bare, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(given).collect()}
    assert [got[i] for i in range(6)] == [f"Head {i}\nStory {i} is told here, at some length" for i in range(6)]
    assert {got[10 + i] for i in range(6)} == {"All our shops\nHead\nOne story for all\nWritten by the staff"}
    assert all(f"One story for all.\nVersion {i}" in got[20 + i] for i in range(6))
    assert {got[30 + i] for i in range(4)} == {"One\ntext"}


def test_html_template_against_vectors(spark):
    """Classes of tokens with equal occurrence vectors, put together page by page."""
    r = random.Random(7)
    part = lambda i: "".join(f"<div><p>{w}</p></div>" * r.randint(0, 2) for w in ("one", "two", "three", "four")) + f"<p>own {i}</p>"
    pages = [("a", i, f"<body><ul><li>Home<li>About</ul>{part(i)}<hr><p>foot</p></body>") for i in range(9)] + [("b", i, f"<p>{i}</p>") for i in range(2)]
    pages += pages[:2]
    frame = spark.createDataFrame([(h, bytearray(t.encode()), i) for h, i, t in pages], "host string, html binary, key long")
    got = {(x.host, frozenset(t for t, k in ((e.token, e["class"]) for e in x.template) if k == c)) for x in html_text.deduce_templates(frame).collect() for c in {e["class"] for e in x.template}}
    vectors: dict = {}
    for k, (h, _, t) in enumerate(pages):
        for token, n in Counter(x[0] for x in html_text.tokens(t) if x[0] != " ").items():
            vectors.setdefault((h, html_text._number(token)), {})[k] = n
    classes: dict = {}
    for (h, token), v in vectors.items():
        if h == "a" and 2 * len(v) > 11:
            classes.setdefault(tuple(sorted(v.items())), set()).add(token)
    assert got == {("a", frozenset(c)) for c in classes.values() if len(c) > 1} and len(got) > 0


def test_html_repeated_rows(spark):
    page = lambda i: f"<html><body><div><p>Story {i} of the day</p><p>More of {i}</p></div></body></html>"
    rows = [(i, "http://h.example/x", page(i % 2)) for i in range(4)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i % 2} of the day\nMore of {i % 2}" for i in range(4)}
    long = "<p>word &amp; word</p>" * 30_000
    (one,) = html_text.extract_text(spark.createDataFrame([(1, "u", f"<article>{long}</article>")], "page_id long, url string, html string")).collect()
    assert one.text == "\n".join(["word & word"] * 30_000)


def test_html_whole_class_names():
    for around in ("<div class='content no-sidebar'><article>{}</article></div>", "<article class='elementor-widget'>{}</article>", "<article id='social-impact'>{}</article>", "<div id='social-impact'><article>{}</article></div>", "<article><div class='entry-header'><h1>Head</h1></div>Text</article>", "<div class='elementor-widget'><div class='post-shared'>{}</div></div>", "<main class='menu-of-the-day'>{}</main>"):
        assert html_text.main_text("<body>" + around.format("<h1>Head</h1>Text") + "</body>") == "Head\nText", around
    for name in ("ad", "ads", "sidebar", "site-header", "cookie-notice", "related-posts", "menu-item", "comments", "comment-list", "share", "social-links", "newsletter", "sponsored", "main-nav", "footer"):
        assert html_text.main_text(f"<body><p>Text</p><div class='x {name}'>Gone</div></body>") == "Text", name


def test_html_omitted_end_tags():
    for menu in ("<ul><li class='menu-item'>Home<li class='menu-item'>About</ul>", "<p class='notice'>Beware", "<table><tr><td class='ad'>Buy<td class='ad'>Now</table>", "<table><tr><th class='ad'>Buy<tr><td>Row</table>", "<dl><dt class='ad'>Buy<dd>Row</dl>"):
        text = html_text.main_text(f"<body>{menu}<article><h1>Head</h1><p>Text</article></body>")
        assert text == "Head\nText", menu
    assert html_text.main_text("<body><table><tr><th class='ad'>Buy<tr><td>Row</table>") == "Row"
    assert html_text.main_text("<article><p class='notice'>Beware<p>One<ul><li class='share'>Share<li>Two</ul><p>Three</article>") == "One\nTwo\nThree"


def cut_up(text):
    """Sentences by a word-by-word reading of the rule, apart from the module's expressions."""
    tokens = re.findall(r"\s*\S+\s*" if text[:1].isspace() else r"\S+\s*", text)
    if text and not tokens:
        tokens = [text]
    out, cur = [], []
    for k, tok in enumerate(tokens):
        cur.append(tok)
        word, gap = tok.strip(), tok[len(tok.rstrip()) :]
        stop = re.search(r"[.!?\u2026\u3002\uff01\uff1f][^\w\s]*$", word)
        after = tokens[k + 1].strip()[:1] if k + 1 < len(tokens) else ""
        if stop or "\n" in gap or (after.isupper() and not word[:1].isupper()):
            out.append(cur)
            cur = []
    out += [cur] if cur else []
    parts = [text] if not text.strip() and text else []
    for sentence in out if text.strip() else []:
        cur = []
        for k, tok in enumerate(sentence):
            cur.append(tok)
            word = tok.strip()
            if len(sentence) > 16 and k + 1 < len(sentence) and (word[-1:] in ",;:" or zlib.crc32(word.encode()) % 8 == 0):
                parts.append("".join(cur))
                cur = []
        parts.append("".join(cur))
    return parts


def test_sentences_word_by_word():
    for _, text, _, _ in base_rows():
        assert substring_dedup.sentences(text) == cut_up(text)
    assert substring_dedup.sentences("Of the river The. small, and so on.\nIn Old York") == ["Of the river ", "The. ", "small, and so on.\n", "In Old York"]


def brute_dedup(rows, min_words):
    """(doc_id, text) that stay: every run of sentences from each place, as short as it may be, compared with all that came before."""
    runs = {}
    for i, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1]}):
        parts = cut_up(t)
        n = [len(p.split()) for p in parts]
        found = set()
        for a in range(len(parts)):
            forward = next((b for b in range(a + 1, len(parts)) if sum(n[a : b + 1]) >= min_words), None)
            back = next((b for b in range(a - 1, -1, -1) if sum(n[b : a + 1]) >= min_words), None)
            if n[a]:
                found |= ({(a, forward)} if forward is not None else set()) | ({(back, a)} if back is not None else set())
        for a, b in found:
            runs.setdefault(tuple(" ".join(parts[a : b + 1]).split()), []).append((i, a, b, t))
    cover = {}
    for places in runs.values():
        for i, a, b, t in sorted(places, key=lambda x: x[:2])[1:]:
            cover.setdefault((i, t), set()).update(range(a, b + 1))
    return Counter((r[0], r[1] and (r[1] if r[0] is None else "".join(p for k, p in enumerate(cut_up(r[1])) if k not in cover.get((r[0], r[1]), ())))) for r in rows)


def test_substring_dedup(docs, none):
    rows = base_rows() + dirty_rows()
    got = substring_dedup.remove_repeated_spans(docs, 30)
    assert got.columns == [*docs.columns, "n_removed"]
    out = got.collect()
    assert Counter((r.doc_id, r.text) for r in out) == brute_dedup(rows, 30)
    assert sum(r.n_removed > 0 for r in out) > 30
    assert substring_dedup.remove_repeated_spans(none).count() == 0
    assert substring_dedup.remove_repeated_spans(got).columns == got.columns


def test_substring_dedup_of_one_id(spark):
    """Two texts of one id are two occurrences; equal rows are one."""
    r = random.Random(3)
    passage = " ".join(f"The {r.randrange(10**6)} of {r.randrange(10**6)} is." for _ in range(12))
    rows = [(1, passage), (1, "Before. " + passage + " After."), (1, passage), (2, "in the middle of a line " + passage + " and more of it")]
    got = substring_dedup.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    left = Counter((x.doc_id, x.text) for x in got.collect())
    assert left[2, "in the middle of a line and more of it"] == 1
    first = {(1, passage): 2} | {(1, "Before. After."): 1}
    second = {(1, ""): 2} | {(1, "Before. " + passage + " After."): 1}
    assert left in (Counter(first | {(2, "in the middle of a line and more of it"): 1}), Counter(second | {(2, "in the middle of a line and more of it"): 1}))


def test_spans_cover_every_long_passage():
    r = random.Random(1)
    for _ in range(200):
        texts = [[r.choice([1, 3, 9, 15]) for _ in range(r.randint(1, 12))] for _ in range(3)]
        n = np.array(sum(texts, []))
        ends = np.cumsum(n)
        stops = np.cumsum([len(t) for t in texts])
        owner = np.searchsorted(stops, np.arange(len(n)), side="right")
        low, high = np.append(0, stops)[owner], stops[owner] - 1
        got = list(zip(*substring_dedup.spans(ends - n, ends, low, high, 20)))
        assert len(set(got)) == len(got) and all(n[a : b + 1].sum() >= 20 and b > a and owner[a] == owner[b] for a, b in got)
        covered = {k for a, b in got for k in range(a, b + 1)}
        assert all(k in covered for k in range(len(n)) if sum(texts[owner[k]]) >= 20 and len(texts[owner[k]]) > 1)


def test_quality_base(docs, none):
    out = quality_rules.quality_rules(docs, least=10).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    want = Counter()
    for i, t, _, _ in base_rows() + dirty_rows():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)] += 1
    assert got == want
    assert not any(r.kept and r.base_failed for r in out)
    assert quality_rules.quality_rules(none).count() == 0


def test_quality_outliers_against_numpy(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 5)) @ (np.eye(5) + 0.3 * r.standard_normal((5, 5)))
    x[:60] += 12
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "grp string, x0 double, x1 double, x2 double, x3 double, x4 double")
    m = quality_rules.mcd(rows, accuracy=100_000).first()
    floors = np.diag(np.array(list(quality_rules.STATS.values())) ** 2)
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    mean, cov = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floors
    for _ in range(4):
        d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
        near = x[d <= np.quantile(d, 0.75, method="inverted_cdf")]
        mean, cov = near.mean(0), np.cov(near.T, bias=True) + floors
    assert np.allclose([m[f"m{i}"] for i in range(5)], mean, atol=1e-6)
    assert np.allclose([m[f"v{i}{j}"] for i in range(5) for j in range(i, 5)], [cov[i, j] for i in range(5) for j in range(i, 5)], atol=1e-6)
    far = quality_rules._with_distance(rows, quality_rules.mcd(rows)).collect()
    assert sum(v.d2 > 60 for v in far) == 60


def test_quality_rejects_symbol_junk(spark):
    r = random.Random(4)
    prose = lambda: [r.choice("river stone light morning walk under bridge small green".split()) + str(r.randrange(99)) for _ in range(r.randint(60, 200))]
    table = lambda w: " ".join(x + " |" * (k % 2) for k, x in enumerate(w))
    rows = [(i, " ".join(prose()) if i % 20 else table(prose()), "en", "a") for i in range(400)] + [(500, " ".join(prose()) + " R&D", "en", "a")]
    kept = {x.doc_id: x.kept for x in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(kept[i] for i in range(0, 400, 20))  # symbol share about 8 %
    assert sum(kept[i] for i in range(400) if i % 20) >= 375 and kept[500]


def test_quality_outliers_converge(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((600, 5)) * np.array(list(quality_rules.STATS.values())) * 3
    x[:140] += np.array([1.5, 0.5, 0.2, 1.0, 0.3])
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "grp string, x0 double, x1 double, x2 double, x3 double, x4 double")
    m = quality_rules.mcd(rows, steps=50, accuracy=100_000, still=1e-9)
    again = quality_rules._with_distance(rows, m)
    limit = again.selectExpr("percentile_approx(d2, 0.75, 100000)").first()[0]
    assert quality_rules._moved(m, quality_rules._moments(again.where(F.col("d2") <= limit))) < 1e-9


def brute_judge(rows, least):
    """kept by doc_id, with numpy: groups of language and source, else of language, else all."""
    stats = {r.doc_id: [np.log1p(r.n_words), r.word_chars / max(r.n_words, 1), (r.n_symbols / max(r.word_chars, 1)) ** 0.5, np.log1p(r.n_dup_lines), (r.n_repeat_words / max(r.n_words, 1)) ** 0.5] for r in rows}
    fine = [r for r in rows if not r.base_failed]
    floors = np.diag(np.array(list(quality_rules.STATS.values())) ** 2)
    groups: dict = {}
    for r in fine:
        for g in ((r.lang, r.source), (r.lang,), ()):
            groups.setdefault(g, []).append(stats[r.doc_id])
    found = {}
    for g, xs in groups.items():
        if g and len(xs) < least:
            continue
        x = np.array(xs)
        q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
        mean, cov = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floors
        for _ in range(quality_rules.STEPS):
            d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
            near = x[d <= np.quantile(d, 0.75, method="inverted_cdf")]
            was, (mean, cov) = (mean, cov), (near.mean(0), np.cov(near.T, bias=True) + floors)
            unit = np.sqrt(np.diag(cov))
            if max(np.abs((mean - was[0]) / unit).max(), np.abs((cov - was[1]) / np.outer(unit, unit)).max()) <= quality_rules.STILL:
                break
        found[g] = (mean, np.linalg.inv(cov))
    kept = {}
    for r in rows:
        mean, inv = next(found[g] for g in ((r.lang, r.source), (r.lang,), ()) if g in found)
        d = np.array(stats[r.doc_id]) - mean
        kept[r.doc_id] = not r.base_failed and d @ inv @ d / quality_rules.FACTOR <= quality_rules.CUTOFF
    return kept


@pytest.mark.parametrize("most", [20_000, 0])
def test_quality_judge_against_numpy(spark, most):
    r = random.Random(11)
    words = lambda n, c: " ".join("".join(r.choices("abcdefgh", k=c + r.randint(-1, 1))) for _ in range(n))
    rows = []
    for i in range(500):
        la, so = r.choice(["en", "fr", None]), r.choice(["a", "a", "b", None])
        text = words(r.randint(15, 300), 5 if la else 7)
        rows.append((i, text + " |" * r.choice([0] * 20 + [40]) + ("\nline" * 40 if r.random() < 0.02 else ""), la, so))
    rows.append((500, "x" * 3000 + " " + words(30, 5), "de", "c"))
    stats = quality_rules.base_stats(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).cache()
    want = brute_judge(stats.collect(), 60)
    got = {x.doc_id: x.kept for x in quality_rules.judge(stats, least=60, broadcast_groups=most).collect()}
    assert got == want and 0 < sum(want.values()) < len(want) - 10


def test_mixing(docs, none):
    plain = docs.select("doc_id", "text", "lang", "source")
    assert mixing.mix(docs).columns == [*(c for c in docs.columns if c not in mixing.OWN), *mixing.OWN]
    rows = mixing.mix(plain).collect()
    assert len(rows) == docs.count()
    total, sizes, target, taken = sum(r.size for r in rows), {}, {}, Counter()
    for r in rows:
        sizes[r.source], target[r.source] = r.source_size, r.target
        taken[r.source] += r.size * r.times
        assert 0 <= r.times <= 3
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, free = {}, set(names)
    while True:
        level = (total - sum(want.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        want |= {s: 3 * sizes[s] for s in over}
        free -= over
    want |= {s: weight[s] * level for s in free}
    assert all(abs(target[s] - want[s]) < 1e-6 for s in names)
    biggest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= biggest for s in names)
    assert sorted((r.doc_id or -1, r.times) for r in rows) == sorted((r.doc_id or -1, r.times) for r in mixing.mix(docs.repartition(7)).collect())
    assert mixing.take(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0


def test_mixing_of_tied_ids(spark):
    r = random.Random(6)
    rows = [(None if i % 2 else i % 40, " ".join(["w"] * r.randint(1, 60)) + f" {i}", r.choice(["en", "fr"]), r.choice("ab")) for i in range(400)]
    rows += [(3, "the same text of one id", la, "a") for la in ("en", "fr", "de") * 9]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixes = [Counter(tuple(x) for x in mixing.mix(f).collect()) for f in (frame, frame.repartition(5), frame.orderBy("text"), frame.orderBy(F.desc("lang"), F.rand(1)))]
    assert mixes[0] == mixes[1] == mixes[2] == mixes[3]
    assert len({x[-1] for x in mixes[0]}) > 1
    assert Counter(tuple(x) for x in mixing.take(frame).collect()) == Counter(tuple(x) for x in mixing.take(frame.repartition(3)).collect())


def test_licenses(spark, none):
    text = "Some words here.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.\nCopyright of nothing.\nLicensed under the Apache License, Version 2.0."
    rows = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (None, "All rights reserved.", "x"), (4, LONG + " Licensed under CC BY-SA 4.0. " + LONG, "x"), (5, "the license of a fish", "x")], "doc_id long, text string, block string")
    got = [(r.doc_id, r.license) for r in licenses.scan_licenses(rows).orderBy("doc_id", "block").collect()]
    assert got == [(None, "reserved"), (1, "mit_notice"), (1, "cc_by_nc_4"), (1, "apache_2"), (4, "cc_by_sa_4")]
    assert licenses.scan_licenses(none).count() == 0


def test_licenses_across_lines_and_in_one_line():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.1)
    names = lambda t: [h[1] for h in scanner.document(t)]
    for name, notice in licenses.TEMPLATES.items():
        assert names("Text before.\n\n" + textwrap.fill(notice, 40) + "\n\nText after.") == [name]
        assert names("/*\n" + textwrap.indent(textwrap.fill(notice, 78), " * ") + "\n */") == [name]
        assert names(" ".join(["word"] * 70) + " " + notice + " " + " ".join(["word"] * 70)) == [name]
    assert names("Released under the MIT License. Licensed under CC BY-NC 4.0.") == ["mit_notice", "cc_by_nc_4"]
    mit = licenses.TEMPLATES["mit"].split()
    assert names(textwrap.fill(" ".join(w for i, w in enumerate(mit) if i % 12), 78)) == ["mit"]
    assert names(textwrap.fill(" ".join(w for i, w in enumerate(mit) if i % 5), 78)) == []


def edits(a, b):
    """The least number of words of a and of a beginning of b that a longest common subsequence of the two leaves out."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return min(len(a) + j - 2 * n for j, n in enumerate(row))


def test_licenses_against_every_place(spark):
    """Each template at each word of each text, without pieces or ranks in between; repeated rows, ties and long texts too."""
    r = random.Random(12)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.1)
    spoil = lambda t, p: " ".join(w for x in t.split() for w in ([] if r.random() < p else [x, "so"] if r.random() < p else [x]))
    filler = lambda n: " ".join(r.choices("the of this software is under a work copy rights permission license and".split(), k=n))
    texts = [f"{filler(20)}\n{spoil(t, p)}\n{filler(15)}" for t in licenses.TEMPLATES.values() for p in (0, 0.03)]
    texts += [f"{spoil(a, 0.01)} {b}" for a, b in zip(licenses.TEMPLATES.values(), reversed(licenses.TEMPLATES.values()))]
    names = list(licenses.TEMPLATES)
    for t in texts:
        words = licenses.wording(t)
        places = [m.start() for m in licenses._WORD.finditer(t)]
        sure = set()
        for k in names:
            n, slack = len(scanner.words[k]), scanner.slack[k]
            for at in range(len(words)):
                if words[at] in scanner.words[k][: slack + 1] and edits(scanner.words[k], words[at : at + n + slack]) <= 0.1 * n:
                    sure.add((k, places[at]))
        got = scanner.document(t)
        found = {h[1] for h in got}
        assert found <= {k for k, _ in sure}
        # What is confirmed and not returned overlaps with a template that is.
        inside = [(t.index(h[5]), t.index(h[5]) + len(h[5])) for h in got]
        lost = {(k, t[p : p + 300]) for k, p in sure if not (k in found or any(a <= p < b for a, b in inside) or any(p <= a < p + 2 * len(licenses.TEMPLATES[k]) for a, _ in inside))}
        assert not lost, (t, got)
    rows = spark.createDataFrame([(1, LONG + "\n" + licenses.TEMPLATES["mit_text"] + "\n" + LONG)] * 2 + [(2, "Released under the MIT License. " * 2)], "doc_id long, text string")
    assert Counter((x.doc_id, x.license) for x in licenses.scan_licenses(rows).collect()) == {(1, "mit_text"): 2, (2, "mit_notice"): 2}


def test_classifier(spark, docs, none):
    r = random.Random(9)
    good = lambda: " ".join(r.choices("river stone light morning walk under bridge small green".split(), k=40))
    rows = [(i, good() if i % 3 else good() + " idiot moron " + "### %%%" * 5, "en", "a" if i % 3 else "b") for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 600, 2)] + [(1, 0, 1), (1, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = classifier.train(d, labels)
    for text in (None, "", " \n"):
        odd = spark.createDataFrame([(1, text, None, None)], "doc_id long, text string, lang string, source string")
        (x,) = classifier.score(odd, model).collect()
        ids, stats = classifier.text_features((text or "").encode())
        want = model.score([ids], np.array([stats]), [classifier.meta_features((text or "").encode(), None, None)])
        assert np.allclose((x.p_text, x.p_meta, x.score), [v[0] for v in want]) and x.kept == (want[2][0] >= model.threshold)
    out = classifier.score(d, model).collect()
    assert sum(x.kept == (x.doc_id % 3 > 0) for x in out) >= 890  # two thirds of them were held out
    assert classifier.keep_good(d, model).count() == sum(x.kept for x in out)
    assert classifier.score(docs, model).count() == docs.count()
    assert classifier.score(none, model).count() == 0
    assert classifier.train(d, labels.where("quality > 5")) is None and classifier.train(none, labels) is None
    assert all(x.kept and x.score == 0.5 for x in classifier.score(d, None).take(5))


def test_pipeline_returns_ids(spark, docs):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.tokens(spark, docs, "").collect())
    assert got == Counter((r[0], tuple(own.encode_ordinary(r[1] or ""))) for r in base_rows() + dirty_rows())


def brute_near(rows):
    """Rows (doc_id, text) that stay, with the number of each: one of every group of linked texts."""
    sets = [shingles(t, 5) for _, t in rows]
    left, out = set(range(len(rows))), Counter()
    while left:
        group, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            group.add(i)
            todo += [j for j in left - group - set(todo) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        left -= group
        ids = {rows[i][0] for i in group}
        out[min(ids - {None}, default=None), frozenset(rows[i][1] for i in group if rows[i][0] == min(ids - {None}, default=None))] += 1
    return out


def test_near_duplicates(spark, docs):
    more = [(7, "all the rivers of the land run down into the sea " * 3, "en", "a"), (7, "we like cakes of all kinds and sizes but not pies " * 3, "en", "a"), (None, "one text that has no number of its own at all", "en", "a"), (None, "one text that has no number of its own at all", "en", "a"), (None, "another text that has no number of its own either", "fr", "a")]
    given = base_rows() + dirty_rows() + more
    frame = spark.createDataFrame([(*r, "e") for r in given], "doc_id long, text string, lang string, source string, label string")
    for rows in (frame, frame.repartition(5, "text"), frame.orderBy(F.rand(3))):
        got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, rows, "").collect())
        want = brute_near([r[:2] for r in given])
        assert sum(got.values()) == sum(want.values())
        for i, texts in want:
            assert sum(got[i, t] for t in texts) == sum(n for (j, u), n in want.items() if (j, u) == (i, texts))
    assert corpus_pipeline.near_duplicates(spark, frame, "").columns == frame.columns


def test_pipeline_stages(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, found, str(tmp_path))
        assert out.columns == plain.columns, name
        found = out.cache()
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.count() == found.count() and corpus_pipeline.summary(final).first().n_tokens > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.where(F.lit(False)), str(tmp_path)).count() == 0, name
