"""Porter's suffix stripping for English words, over distinct words at once.

The published algorithm (1980) with its author's two later endings, `bli` and `logi`, as full-text indexes have it: words of 3 to 64 bytes are stemmed, others stay.
A word is [C](VC)^m[V]; y is a vowel after a consonant. Letters beyond a to z count as consonants.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of the second, third and fourth step, and what they become (fixed values).
SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "logi": "log", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()

#: Runs of consonants and vowels; a word's measure over 0, of 1, over 1; a vowel in it; a consonant, a vowel and a consonant but w, x, y at its end.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME, ONE, MORE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
VOWEL, SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"

#: Stems that a worker keeps.
KNOWN = 1_000_000


def _has(words: pa.Array, pattern: str) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(words, pattern), False)


def _ending(words: pa.Array, endings) -> tuple[pa.Array, pa.Array]:
    """What comes before the longest of the endings, and that ending; nulls where there is none."""
    found = pc.extract_regex(words, f"^(?P<a>.+?)(?P<b>{'|'.join(endings)})$")
    return pc.struct_field(found, "a"), pc.struct_field(found, "b")


def _joined(a: pa.Array, b) -> pa.Array:
    return pc.binary_join_element_wise(a, b, "")


def _replaced(words: pa.Array, endings: dict[str, str], measure: str) -> pa.Array:
    a, b = _ending(words, endings)
    to = pa.array(endings.values(), pa.string()).take(pc.index_in(b, pa.array(endings.keys())))
    return pc.if_else(_has(a, measure), _joined(a, to), words)


def _first(w: pa.Array) -> pa.Array:
    """Plurals, -ed and -ing, y."""
    w = pc.replace_substring_regex(pc.replace_substring_regex(w, "^(.+)(ss|i)es$", r"\1\2"), "^(.*[^s])s$", r"\1")
    eed = _has(w, "^.+eed$")
    a, _ = _ending(w, ["eed"])
    b, _ = _ending(w, ["ed", "ing"])
    cut = pc.and_(pc.invert(eed), _has(b, VOWEL))
    again = pc.and_(cut, _has(b, "(at|bl|iz)$"))
    twice = pc.and_(pc.and_(cut, pc.equal(pc.utf8_slice_codeunits(b, -1), pc.utf8_slice_codeunits(b, -2, -1))), _has(b, "[^aeiouylsz]$"))
    e = pc.or_(again, pc.and_(pc.and_(cut, pc.invert(pc.fill_null(twice, False))), _has(b, SHORT)))
    w = pc.if_else(pc.and_(eed, _has(a, SOME)), _joined(a, "ee"), w)
    w = pc.if_else(cut, pc.if_else(e, _joined(b, "e"), pc.if_else(pc.fill_null(twice, False), pc.utf8_slice_codeunits(b, 0, -1), b)), w)
    y, _ = _ending(w, ["y"])
    return pc.if_else(_has(y, VOWEL), _joined(y, "i"), w)


def _last(w: pa.Array) -> pa.Array:
    """-al to -ize and -ion, a final e, a final ll."""
    a, _ = _ending(w, FOURTH)
    ion, _ = _ending(w, ["ion"])
    some = pc.is_valid(a)
    w = pc.if_else(_has(a, MORE), a, pc.if_else(pc.and_(pc.invert(some), pc.and_(_has(ion, "[st]$"), _has(ion, MORE))), ion, w))
    e, _ = _ending(w, ["e"])
    w = pc.if_else(pc.or_(_has(e, MORE), pc.and_(_has(e, ONE), pc.invert(_has(e, SHORT)))), e, w)
    return pc.if_else(pc.and_(_has(w, "ll$"), _has(w, MORE)), pc.utf8_slice_codeunits(w, 0, -1), w)


def stems(words: pa.Array) -> pa.Array:
    """The stem of each of many words in lower case."""
    size = pc.binary_length(words)
    fit = pc.and_(pc.greater_equal(size, 3), pc.less_equal(size, 64))
    # A y that begins a word is a consonant.
    w = pc.replace_substring_regex(words, "^y", "Y")
    w = _last(_replaced(_replaced(_first(w), SECOND, SOME), THIRD, SOME))
    return pc.if_else(fit, pc.replace_substring_regex(w, "^Y", "y"), words)


_known: dict[str, str] = {}


def stemmed_lists(tokens: pa.ListArray) -> pa.ListArray:
    """Token lists with stems: each distinct word of a batch once, and those that the worker has met before not at all."""
    met = tokens.flatten().dictionary_encode()
    words = met.dictionary.to_pylist()
    if len(_known) > KNOWN:
        _known.clear()
    new = [w for w in words if w not in _known]
    if new:
        _known.update(zip(new, stems(pa.array(new, pa.string())).to_pylist()))
    values = pa.array([_known[w] for w in words], pa.string()).take(met.indices)
    offsets = pc.subtract(tokens.offsets, tokens.offsets[0])
    return pa.ListArray.from_arrays(offsets, values, mask=pc.is_null(tokens) if tokens.null_count else None)


def stem(x) -> Column:
    """An array of words in lower case, each as its stem."""

    @F.arrow_udf("array<string>")
    def run(tokens: pa.Array) -> pa.Array:
        return stemmed_lists(tokens)

    return run(F.col(x) if isinstance(x, str) else x)


def stems_of(words: list[str]) -> list[str]:
    """Stems at the driver, for the words of a query."""
    return stems(pa.array(words, pa.string())).to_pylist()


def stem_sql(source: str, name: str) -> str:
    """CTEs that leave `name` (word, stem) of the distinct words of `source` (word), for an engine with the same kind of regular expressions."""
    r, v = "regexp_matches", lambda p: "'" + p + "'"

    def step(i: int, rows: str, ends, then: str) -> str:
        p = v(f"^(.+?)({'|'.join(ends)})$")
        return f"{name}{i} as (select word, {then} as w from (select word, w, regexp_extract(w, {p}, 1) as a, regexp_extract(w, {p}, 2) as b from {rows}))"

    swap = lambda ends: "case b " + " ".join(f"when '{k}' then '{x}'" for k, x in ends.items()) + " end"
    mended = f"case when {r}(a, '(at|bl|iz)$') then a || 'e' when a[-1] = a[-2] and {r}(a, '[^aeiouylsz]$') then a[:-2] when {r}(a, {v(SHORT)}) then a || 'e' else a end"
    return ",\n".join([
        f"{name}0 as (select word, regexp_replace(regexp_replace(regexp_replace(word, '^y', 'Y'), '^(.+)(ss|i)es$', '\\1\\2'), '^(.*[^s])s$', '\\1') as w from (select distinct word from {source}))",
        step(1, f"{name}0", ["eed", "ed", "ing"], f"case when b = 'eed' then case when {r}(a, {v(SOME)}) then a || 'ee' else w end when b <> '' and {r}(a, {v(VOWEL)}) then {mended} else w end"),
        step(2, f"{name}1", ["y"], f"case when b <> '' and {r}(a, {v(VOWEL)}) then a || 'i' else w end"),
        step(3, f"{name}2", SECOND, f"case when b <> '' and {r}(a, {v(SOME)}) then a || {swap(SECOND)} else w end"),
        step(4, f"{name}3", THIRD, f"case when b <> '' and {r}(a, {v(SOME)}) then a || {swap(THIRD)} else w end"),
        step(5, f"{name}4", [*FOURTH, "ion"], f"case when b = 'ion' then case when {r}(a, '[st]$') and {r}(a, {v(MORE)}) then a else w end when b <> '' and {r}(a, {v(MORE)}) then a else w end"),
        step(6, f"{name}5", ["e"], f"case when b <> '' and ({r}(a, {v(MORE)}) or ({r}(a, {v(ONE)}) and not {r}(a, {v(SHORT)}))) then a else w end"),
        f"{name} as (select word, case when strlen(word) not between 3 and 64 then word else regexp_replace(case when {r}(w, 'll$') and {r}(w, {v(MORE)}) then w[:-2] else w end, '^Y', 'y') end as stem from {name}6)",
    ])
