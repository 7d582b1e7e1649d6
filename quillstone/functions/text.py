"""Text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relations that a link prefix may name (fixed values).
RELATIONS = "links_to implements depends_on supports refutes extends derived_from fixes causes part_of related_to similar_to tagged_as".split()
#: Letters folded by the fuzzy match (fixed values).
ACCENTS, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"
#: Extensions of code files (fixed values).
CODE_EXTENSIONS = "go py ts js tsx jsx rs java c cpp h hpp cs rb php swift kt sql sh ps1".split()
#: Extensions and interpreters of the languages of the code index (fixed values).
LANGUAGES = {
    "go": "go", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust", "java": "java",
    "c": "cpp", "h": "cpp", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "hh": "cpp", "cxx": "cpp", "rb": "ruby", "php": "php", "sh": "shell", "bash": "shell",
}
INTERPRETERS = {"python": "python", "python3": "python", "ruby": "ruby", "sh": "shell", "bash": "shell"}
#: Letters with marks and the plain letters that they are folded to, by Unicode's decompositions.
MARKED = [(c, d[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c)) > 1 and all(unicodedata.combining(x) for x in d[1:])]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(x) -> Column:
    return F.filter(F.split(_c(x), r"\s+"), lambda w: w != "")


def chunk_text(x, size: int = 200, overlap: int = 30) -> Column:
    """Word windows; a text of at most `size` words stays as it is, a blank or null one has none."""
    step = size - overlap if size > overlap else max(1, size // 2)
    text = F.coalesce(_c(x), F.lit(""))

    def windows(w: Column) -> Column:
        n = F.size(w)
        last = F.ceil((n - size) / F.lit(step)).cast("int")
        many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(text)).otherwise(many)

    # The text is split once: the words are the variable of an outer lambda, not an expression that each window repeats.
    return F.element_at(F.transform(F.array(words(text)), windows), 1)


def strip_code(x) -> Column:
    """Fences, inline code, comments and table rows become blanks."""
    out = _c(x)
    for p in (r"(?s)```.*?```", r"`[^`\n]*`", r"(?s)<!--.*?-->", r"(?m)^\s*\|.*\|\s*$"):
        out = F.regexp_replace(out, p, " ")
    return out


def clean_markdown(x) -> Column:
    """Plain words of Markdown: images and links give their labels, wikilinks their alias or target, emphasis and tags go."""
    out = _c(x)
    for p, r in (
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"!?\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"!?\[\[([^\]#]*)(?:#[^\]]*)?\]\]", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(\*\*|__)(.*?)\1", "$2"), (r"(\*|_)(.*?)\1", "$2"), (r"~~(.*?)~~", "$1"), (r"`([^`]*)`", "$1"), (r"<[^>]+>", ""), (r"\s+", " "),
    ):
        out = F.regexp_replace(out, p, r)
    return F.trim(out)


def truncate_words(x, n: int) -> Column:
    """At most n characters: cut at the last blank of the second half, closing marks off, with dots."""
    t = F.trim(_c(x))
    head = F.substring(t, 1, n - 3)
    at = F.length(head) - F.locate(" ", F.reverse(head)) + 1
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (at - 1 > (n - 3) / 2), at - 1).otherwise(F.length(head))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.regexp_replace(F.substr(head, F.lit(1), cut.cast("int")), r"[ ,.;:\-]+$", ""), F.lit("...")))


def micro_abstract(x, n: int = 160) -> Column:
    """First prose paragraph without Markdown, shortened."""
    body = F.regexp_replace(F.regexp_replace(_c(x), r"(?s)```.*?(```|\z)", ""), r"(?s)\A\s*---\n.*?\n---\n", "")
    paras = F.transform(F.split(body, r"\n\s*\n"), lambda p: F.array_join(F.filter(F.split(p, "\n"), lambda li: (F.trim(li) != "") & ~F.trim(li).rlike(r"^(#|\||-{3,}$|\*{3,}$|_{3,}$)")), " "))
    first = F.get(F.filter(paras, lambda p: F.trim(p) != ""), F.lit(0))
    return F.coalesce(truncate_words(clean_markdown(F.regexp_replace(F.trim(first), r"^[>\-\s*+0-9.]+", "")), n), F.lit(""))


def fallback_abstract(x, n: int = 160) -> Column:
    """First line that is neither blank nor a heading, at most n characters."""
    line = F.get(F.filter(F.transform(F.split(_c(x), "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.startswith("#")), F.lit(0))
    line = F.coalesce(line, F.lit(""))
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n - 3), F.lit("..."))).otherwise(line)


def token_estimate(x) -> Column:
    return F.ceil(F.length(F.trim(_c(x))) / 4).cast("long")


def truncate_runes(x, n: int) -> Column:
    return _c(x) if n <= 0 else F.when(F.length(_c(x)) > n, F.concat(F.substring(_c(x), 1, n), F.lit(" ... [truncado]"))).otherwise(_c(x))


def fold(x) -> Column:
    """Lower case without marks on letters."""
    plain = F.translate(_c(x), "".join(m for m, _ in MARKED), "".join(p for _, p in MARKED))
    return F.lower(F.regexp_replace(plain, r"\p{M}", ""))


def lexical_tokens(x) -> Column:
    """Runs of letters and digits in lower case, without marks."""
    return F.regexp_extract_all(fold(x), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def plain_tokens(x) -> Column:
    """Runs of letters and digits in lower case; marks stay."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def tokens_of(q: str) -> list[str]:
    """lexical_tokens of a text at the driver."""
    plain = "".join(c for c in unicodedata.normalize("NFD", q) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain.lower())


def long_tokens(x) -> Column:
    """Distinct runs of letters and digits of three bytes or more, in lower case."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)), lambda t: F.octet_length(t) >= 3))


def query_phrases(q: str) -> list[list[str]]:
    """Phrases of a lexical query: other signs than letters, digits and _ are blanks, each field is a phrase of its tokens; all must match."""
    return [list(p) for p in dict.fromkeys(tuple(tokens_of(field)) for field in re.sub(r"[^\w]", " ", q).split()) if p]


def sanitize_query(x) -> Column:
    return F.array_join(F.transform(words(F.regexp_replace(_c(x), r"[^\p{L}\p{Nd}_]", " ")), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ")


def jaccard(a, b) -> Column:
    both = F.size(F.array_union(_c(a), _c(b)))
    return F.when((F.size(_c(a)) == 0) | (F.size(_c(b)) == 0), 0.0).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / both)


def fuzzy(x) -> Column:
    return F.translate(F.translate(F.lower(F.trim(_c(x))), "-_ \t", ""), ACCENTS, PLAIN)


def fuzzy_tokens(x) -> Column:
    return F.filter(F.split(F.translate(F.lower(F.trim(_c(x))), ACCENTS, PLAIN), "[-_ .]+"), lambda w: w != "")


def inline_tags(x) -> Column:
    plain = F.regexp_replace(strip_code(x), r"!?\[\[[^\]]*\]\]", " ")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?:^|[\s(\[])#([A-Za-z][\w\-/]*)"), F.lit(1)))


def wikilinks(x) -> Column:
    """array<struct<target, alias, anchor, block, relation, embed>> of the links outside of code."""
    raw = F.regexp_extract_all(strip_code(x), F.lit(r"!?\[\[[^\]]+\]\]"), F.lit(0))

    def parse(link: Column) -> Column:
        body = F.regexp_extract(link, r"\[\[([^\]]+)\]\]", 1)
        left, alias = F.trim(F.split(body, r"\|", 2)[0]), F.trim(F.coalesce(F.get(F.split(body, r"\|", 2), F.lit(1)), F.lit("")))
        uri = left.startswith("memory://")
        prefix = F.lower(F.regexp_extract(left, r"^(?:rel:)?([A-Za-z_]+):(?!//)", 1))
        typed = prefix.isin(RELATIONS) & ~uri
        rest = F.when(typed, F.regexp_replace(left, r"^(?:rel:)?[A-Za-z_]+:", "")).otherwise(left)
        target = F.trim(F.when(uri, rest).otherwise(F.split(rest, "#", 2)[0]))
        anchor = F.coalesce(F.get(F.split(rest, "#", 2), F.lit(1)), F.lit(""))
        by_alias = F.lower(alias).isin(RELATIONS)
        return F.struct(
            F.when(target.isin("...", "."), "").otherwise(target).alias("target"),
            F.when(by_alias, "").otherwise(alias).alias("alias"),
            F.regexp_replace(F.when(anchor.startswith("^"), "").otherwise(anchor), r"\^.*$", "").alias("anchor"),
            F.regexp_extract(anchor, r"\^(.*)$", 1).alias("block"),
            F.when(typed, prefix).when(by_alias, F.lower(alias)).otherwise(F.lit("links_to")).alias("relation"),
            link.startswith("!").alias("embed"),
        )

    return F.filter(F.transform(raw, parse), lambda s: s["target"] != "")


def frontmatter(x) -> Column:
    return F.regexp_extract(_c(x), r"(?s)\A\s*---\r?\n(.*?)\r?\n---\s*(?:\n|\z)", 1)


def body_of(x) -> Column:
    return F.regexp_replace(_c(x), r"(?s)\A\s*---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")


def frontmatter_value(x, key: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(frontmatter(x), rf"(?m)^{re.escape(key)}:[ \t]*(.*)$", 1), r"^[\"']|[\"']$", ""))


def frontmatter_list(x, key: str) -> Column:
    """A comma list, a bracket list or a dash list; tags lose their sign."""
    block = F.regexp_extract(frontmatter(x), rf"(?m)^{re.escape(key)}:[ \t]*((?:.*)(?:\n[ \t]*-[ \t].*)*)", 1)
    parts = F.split(F.regexp_replace(block, r"(?m)^[ \t]*-[ \t]|[\[\]\"']", ","), r"[,\n]")
    return F.array_distinct(F.filter(F.transform(parts, lambda s: F.regexp_replace(F.trim(s), "^#", "")), lambda s: s != ""))


def glob_regex(glob: str) -> str:
    """`**/` any folders, `**` anything, `*` and `?` within a segment; without a slash it matches at any depth; dir/** also dir."""
    if glob.endswith("/**") and "/" not in glob[:-3]:
        return rf"^(?:.*/)?{re.escape(glob[:-3])}(?:/.*)?$"
    out, i = "", 0
    while i < len(glob):
        for text, pattern in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if glob.startswith(text, i):
                out, i = out + pattern, i + len(text)
                break
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$" if "/" in glob else f"^(?:.*/)?{out}$"


def event_pattern(p: str) -> str:
    return ".*" if p == "*" else "^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p) + "$"


def occurrences(text, part) -> Column:
    """Non-overlapping occurrences, without case."""
    t, p = F.lower(_c(text)), F.lower(_c(part))
    return ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("long")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))


def is_code_file(path) -> Column:
    return extension(path).isin(CODE_EXTENSIONS)


def detect_language(path, head) -> Column:
    """By extension, else by the interpreter of the first line; null if unknown."""
    by = F.create_map(*(F.lit(v) for kv in LANGUAGES.items() for v in kv))
    shell = F.regexp_extract(_c(head), r"^#!\s*(?:/usr/bin/env )?(?:[^\n]*/)?([^/\n]*?)\s*(?:\n|$)", 1)
    names = F.create_map(*(F.lit(v) for kv in INTERPRETERS.items() for v in kv))
    return F.coalesce(F.element_at(by, extension(path)), F.element_at(names, shell))


def extract_symbols(src) -> Column:
    """array<struct<kind, name, line>> by the first words of lines."""
    lines = F.split(_c(src), "\n")
    at = F.transform(lines, lambda s, i: F.struct(F.regexp_extract(s, r"^\s*(?:export\s+|pub\s+|async\s+)*(func|def|function|fn|class|struct|interface|type|import)\b", 1).alias("kind"), F.regexp_extract(s, r"^\s*(?:export\s+|pub\s+|async\s+)*(?:func|def|function|fn|class|struct|interface|type|import)\s+(?:\([^)]*\)\s*)?\"?([\w./]+)", 1).alias("name"), (i + 1).alias("line")))
    return F.filter(at, lambda s: (s["kind"] != "") & (s["name"] != ""))


def path_to_doc_id(p) -> Column:
    return F.concat(F.lit("doc-"), F.lower(F.replace(_c(p), F.lit("/"), F.lit("-"))))


def mask_url(u) -> Column:
    return F.regexp_replace(_c(u), r"://[^@/]*@", "://***@")


def clean_git_url(u) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(_c(u)), r"^(?:[a-z+]+://(?:[^@/]*@)?[^/]+/|[^@]+@[^:]+:)", ""), r"(\.git)?/?$", "")


def replace_database(u, name: str) -> Column:
    return F.regexp_replace(_c(u), r"^([a-z]+://[^/?]+)(?:/[^?]*)?", f"$1/{name}")


def parse_memory_uri(u) -> Column:
    part = lambda k: F.regexp_extract(_c(u), r"^memory://([^/]+)/([^#]*)(?:#(.*))?$", k)
    return F.struct(part(1).alias("repo"), part(2).alias("path"), part(3).alias("anchor"))


def format_memory_uri(repo, path, anchor) -> Column:
    return F.concat(F.lit("memory://"), _c(repo), F.lit("/"), _c(path), F.when(_c(anchor) != "", F.concat(F.lit("#"), _c(anchor))).otherwise(""))


def deep_links(root: str, vault: str, path, line=None) -> Column:
    p, at = _c(path), F.lit("") if line is None else F.concat(F.lit(":"), line)
    full = F.concat(F.lit(root.rstrip("/") + "/"), p)
    enc = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.struct(F.concat(F.lit("obsidian://open?vault="), enc(F.lit(vault)), F.lit("&file="), enc(p)).alias("obsidian"), F.concat(F.lit("vscode://file/"), full, at).alias("vscode"), F.concat(F.lit("file://"), full).alias("file"))


def heading(h) -> Column:
    """struct<heading, level>; a bare title is of level 2."""
    t = F.trim(_c(h))
    full = F.when(t.startswith("#"), t).otherwise(F.concat(F.lit("## "), t))
    return F.struct(full.alias("heading"), F.length(F.regexp_extract(full, "^(#+)", 1)).alias("level"))


def format_vector(v) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(_c(v), lambda x: x.cast("string")), ","), F.lit("]"))


def normalize_epoch(x) -> Column:
    return F.when(_c(x) > 1_000_000_000_000, (_c(x) / 1000).cast("long")).otherwise(_c(x))


def qualified_shape(q) -> Column:
    return F.trim(_c(q)).rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)+$")


def last_segment(s) -> Column:
    return F.substring_index(_c(s), ".", -1)


def camel_or_pascal(s) -> Column:
    """Both an upper and a lower ASCII letter."""
    return _c(s).rlike("[A-Z]") & _c(s).rlike("[a-z]")


def light_wikilinks(x) -> Column:
    """Raw text between brackets, in order, repeated ones too; code is not left out."""
    return F.regexp_extract_all(_c(x), F.lit(r"\[\[(.*?)\]\]"), F.lit(1))


def merged(*lists) -> Column:
    """Values of all lists in order, each at its first place."""
    return F.array_distinct(F.filter(F.concat(*(F.coalesce(_c(x), F.array().cast("array<string>")) for x in lists)), lambda v: v.isNotNull()))


def repo_id() -> Column:
    return F.concat(F.lit("repo_"), F.substring(F.sha2(F.uuid(), 256), 1, 12))
