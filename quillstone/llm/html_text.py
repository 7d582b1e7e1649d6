"""Operator 6: main text of web pages by template deduction from equivalence classes.

Tokens are a page's tags with the path of their open elements, and its text nodes with theirs. A token's occurrence vector over the pages
of its host is folded as it is summed (both halves of a hash of page and count), so that vectors of any length meet
in one aggregation with map-side combine; tokens of one host with equal sums are an equivalence class. Classes that more than half of
the host's pages have, of two tokens or more, make the host's template; their number is bounded by twice the tokens of a page. On each page the valid ones
(those whose tokens come in the template's one order, each inside one slot of its parent) are nested, and the slots between their tokens hold
the page's own content.

A slot is main text if it lies in the article (or `main`; in the body, if these hold less than half of the unmarked text), outside elements that tags, roles and whole class names mark as
menus, headers, footers, sidebars, notices, adverts, forms or comments, and no text node of the template (the same on most pages), inside of an article or not.
Copies of one page make a template of their whole text: a page whose own text is less than a COPY-th of what the marks leave inside of an article (without one: a page
with no own text at all) counts as a copy, and loses nothing for being repeated. A host with less than MIN_PAGES pages has no template; there the marks alone decide.

Defined results. Null or empty html: empty text. Broken markup: unclosed elements end with the element around them, a cut-off page
ends all. Null url: a host of its own. Repeated rows: each is returned. Null page_id: kept as null. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import arrow_map, cut

MIN_PAGES = 3
#: A page of an article with less than one part in so many of text of its own is a copy.
COPY = 5
#: Entries of all templates together (two numbers each, 32 MB) up to which they are broadcast.
BROADCAST_ENTRIES = 2_000_000
#: Parts that a host's pages are dealt to beyond that.
SALTS = 64
#: Templates that a worker keeps unpacked.
KEPT_HOSTS = 256
#: Element names of HTML by what they are here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label img".split())
RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|canvas|select|button|title"
OUTSIDE = set("nav footer aside form dialog menu fieldset head".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
MARKS = re.compile(
    r"(?i)(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|mobile|sticky|fixed|post|article|entry)[-_]?)?(?:"
    r"ads?|adsense|adsbygoogle|advert(?:isement|ising)?s?|sponsor(?:ed)?s?|promos?|promotions?|banners?|side-?bars?|menus?|nav(?:bar|igation)?|foot(?:er)?s?|masthead|cookies?|notices?|consent|gdpr|pop-?up|modal|newsletters?|subscribe|subscription"
    r"|shar(?:e|ing)|related|recommend(?:ed|ations?)|comments?|disqus|replies|breadcrumbs?|pagination|pager|widgets?|toolbar"
    r")(?:[-_]?(?:box|bar|area|item|link|list|links|items|wrap|wrapper|container|inner|block|section|banner|notice|thread|form|buttons?|unit|slot|posts|articles|menu|\d+))*"
    r"|(?:site|page|main|global|top)[-_]?header|header|social(?:[-_](?:links?|icons?|media|share|sharing|buttons?|bar))?"
)
#: Open elements that a start tag of the name ends, besides paragraphs and headings.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}} | {k: {"td", "th", "tr", "tbody", "thead", "tfoot"} for k in ("tbody", "thead", "tfoot")}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*/>|<({RAW})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACES = re.compile(r"\s+")


def _outside(name: str, attrs: str, in_article: bool) -> bool:
    if name in OUTSIDE or (name == "header" and not in_article):
        return True
    if not attrs:
        return False
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and name not in ("body", "html", "article", "main") and any(map(MARKS.fullmatch, value.split())):
            return True
        if key in ("class", "id") and name == "article" and re.search(r"(?i)\bcomment", value):
            return True
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def tokens(page: str) -> list[tuple[str, str, bool, bool, bool]]:
    """(path and tag or text, text or "", ends a block, inside an article, outside of content) of the page, in order."""
    stack: list[tuple[str, bool]] = []
    out = []
    path, hidden, article, header = "", 0, 0, 0

    def shut() -> str:
        """Ends the innermost open element; its name."""
        nonlocal hidden, article, header
        top, was = stack.pop()
        hidden -= was
        article -= top in ("article", "main")
        header -= top == "header"
        return top

    for m in TOKEN.finditer(page):
        s = m[0]
        if s[0] != "<" or s == "<":
            if s.isspace():
                out.append((" ", " ", False, article > 0, hidden > 0))
            else:
                inside = hidden > 0 or header > 0 and not (stack and stack[-1][0] in HEADING)
                out.append((f"{path} {SPACES.sub(' ', s).strip()}", s, False, article > 0, inside))
            continue
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue  # comments, declarations, and elements whose content is no text
        close, attrs = bool(m[2] or m[5]), m[4] or m[7] or ""
        if name in INLINE and not close and attrs and (_outside(name, attrs, article > 0) or any(x[0] == name for x in stack)) and name not in VOID and not attrs.endswith("/"):
            # Inline elements that are marked, and those of their name inside of them, are kept track of; others change nothing.
            stack.append((name, was := _outside(name, attrs, article > 0)))
            hidden += was
        elif name in INLINE and not close and name not in VOID and any(x[0] == name for x in stack):
            stack.append((name, False))
        elif name in INLINE and close and any(x[0] == name for x in stack):
            while shut() != name:
                pass
        if name in INLINE or name == "br":
            out.append((" ", " " if name == "br" else "", False, article > 0, hidden > 0))
            continue
        if close:
            if any(x[0] == name for x in stack):
                while shut() != name:
                    pass
                path = "/".join(x[0] for x in stack)
        elif name not in VOID and not attrs.endswith("/"):
            while stack and (stack[-1][0] in ("p", *HEADING) or stack[-1][0] in ENDS.get(name, ())):
                shut()
            was = _outside(name, attrs, article > 0)
            stack.append((name, was))
            hidden += was
            article += name in ("article", "main")
            header += name == "header"
            path = "/".join(x[0] for x in stack)
        out.append((f"{path}<{'/' * close}{name}>", "", True, article > 0, hidden > 0))
    return out


def _number(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) - (1 << 63)


def main_text(page: str, template: dict[int, int] | None = None) -> str:
    """The page's main text; template: the class of each of the host's template tokens."""
    seq = tokens(page)
    # The article is the main text if it has most of the unmarked text.
    inside, around = (sum(len(t[1].strip()) for t in seq if not t[4] and bool(t[3]) == a) for a in (True, False))
    whole = inside > 0 and inside >= around
    content = {i: len(t[1].strip()) for i, t in enumerate(seq) if t[1].strip() and not t[4] and (t[3] or not whole)}
    fixed: set[int] = set()
    if template:
        numbers = [_number(t[0]) if t[0] != " " else None for t in seq]
        place = [(i, template[n]) for i, n in enumerate(numbers) if n in template]
        valid = _nested([k for _, k in place])
        fixed = {i for i, k in place if k in valid}
        own = sum(n for i, n in content.items() if i not in fixed)
        if not own or whole and COPY * own < sum(content.values()):
            fixed = set()
    blocks, cur = [], []
    for i, (_, text, ends, article, outside) in enumerate(seq):
        if ends:
            blocks.append("".join(cur))
            cur = []
        elif not outside and (article or not whole) and i not in fixed:
            cur.append(text)
    blocks.append("".join(cur))
    plain = (SPACES.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in plain if b)


def _nested(classes: list[int]) -> set[int]:
    """Of a page's template tokens, given by class: the classes that nest, in that no two of them cross."""
    first, last = {}, {}
    for i, k in enumerate(classes):
        first.setdefault(k, i)
        last[k] = i
    valid: set[int] = set()
    open_: list[int] = []
    for i, k in enumerate(classes):
        while open_ and last[open_[-1]] < i:
            open_.pop()
        if first[k] == i and (not open_ or last[k] <= last[open_[-1]] or open_[-1] == k):
            valid.add(k)
            open_.append(k)
    return valid


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, part of the vector's number, pages) of a batch, summed over its pages."""
    for batch in batches:
        vector: dict[tuple[str, int], list[int]] = {}
        for host, page, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = (page or b"").decode("utf-8", "replace")
            for token, n in Counter(t[0] for t in tokens(text) if t[0] != " ").items():
                v = vector.setdefault((host, _number(token)), [0, 0, 0])
                part = xxhash.xxh3_64_intdigest(f"{key} {n}")
                v[0] += part & 0xFFFFFFFF
                v[1] += part >> 32
                v[2] += 1
            vector.setdefault((host, 0), [0, 0, 0])[2] += 1
        rows = list(vector.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64()), *(pa.array([v[j] for _, v in rows], pa.int64()) for j in range(3))],
            names=["host", "token", "low", "high", "pages"],
        )


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, template array<struct<token, class>>) of the hosts with MIN_PAGES pages; pages: (host, html binary, key)."""
    # Sums are the same for equal vectors, in any order of summing; those of halves stay within 64 bits for 2^31 pages of a host.
    parts = arrow_map(pages.select("host", "html", "key"), _occurrences, "host string, token long, low long, high long, pages long")
    # Written once: it is read twice, and its pages need not be parsed again.
    seen = cut(parts.groupBy("host", "token").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("pages").alias("pages")))
    size = seen.where("token = 0").select("host", F.col("pages").alias("of")).where(f"of >= {MIN_PAGES}")
    often = seen.where("token <> 0").join(size, "host").where("2 * pages > of")
    classes = often.groupBy("host", "low", "high").agg(F.collect_list("token").alias("tokens")).where("size(tokens) > 1")
    entries = F.transform("tokens", lambda t: F.struct(t.alias("token"), F.xxhash64("low", "high").alias("class")))
    return classes.groupBy("host").agg(F.flatten(F.collect_list(entries)).alias("template"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, known = [], {}
        hosts = batch.column(3)
        for i, page in enumerate(batch.column(2).to_pylist()):
            host = hosts[i].as_py()
            if host not in known:
                if len(known) >= KEPT_HOSTS:
                    known.clear()
                known[host] = {x["token"]: x["class"] for x in batch.column(4)[i].as_py() or []}
            texts.append(main_text((page or b"").decode("utf-8", "replace"), known[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def with_templates(rows: DataFrame, found: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """rows (page_id, url, html, host) with the template of their host, null where it has none.

    Templates of a bounded size in all are broadcast, so that pages stay where they are. Beyond the bound pages meet their template by
    host and salt: a host is dealt to SALTS tasks, and its template is copied only to the salts that its pages have.
    """
    entries = found.agg(F.sum(F.size("template"))).first()[0] or 0
    if entries <= broadcast_entries:
        return rows.join(F.broadcast(found), "host", "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    copies = salted.select("host", "salt").distinct().join(found, "host")
    return salted.join(copies, ["host", "salt"], "left").drop("salt")


def extract_text(pages: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"), host.alias("host"))
    found = cut(deduce_templates(rows.withColumn("key", F.xxhash64("page_id", "url", "html"))))
    joined = with_templates(rows, found, broadcast_entries)
    return arrow_map(joined.select("page_id", "url", "html", "host", "template"), _extract, "page_id long, url string, text string, n_chars long")
