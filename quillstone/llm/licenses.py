"""Operator 1: license scans by conditional compression.

Every text is searched whole, across line breaks. A template can only stand where one of its pieces stands unchanged (it has one piece more than
differences allowed): the words around it, as many as the template may take, are a candidate block. The block is compressed with the template as
zstandard raw dictionary; candidates are ranked by what that saves, and confirmed in this order by comparing word by word: the
differing words are at most `max_diff` of the template's (holders' names, years and words that stand before or after its wording
don't count). Of confirmed templates that overlap, the first in rank stays.

One scan without any exchange: a document is read where it lies.

Defined results. Null or empty text: no rows. No confirmed template: no row. Ties in rank: the longer template, then its name, then the place.
A row's block is the line (of a long line, the sentence) where its template begins; a block has a row for each of its templates.
Repeated rows give repeated results. Null doc_id: kept as null. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import arrow_map

#: Public wordings of licence notices.
TEMPLATES = {
    "mit_notice": "Released under the MIT License.",
    "mit_licensed": "Licensed under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache_2": "Licensed under the Apache License, Version 2.0.",
    "apache_2_notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "gpl_3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_3_notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl_2": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl_3": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mpl_2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd_3": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_2_text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "bsd_3_text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "isc_text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc_by_4": "Licensed under CC BY 4.0.",
    "cc_by_sa_4": "Licensed under CC BY-SA 4.0.",
    "cc_by_nc_4": "Licensed under CC BY-NC 4.0.",
    "cc_by_nc_nd_4": "Licensed under CC BY-NC-ND 4.0.",
    "cc0_1": "Released under CC0 1.0 Universal.",
    "reserved": "All rights reserved.",
}
LONG_LINE = 60
_STOP = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"[A-Za-z0-9][A-Za-z0-9.'\-]*")


def wording(text: str) -> list[str]:
    return [w.rstrip(".'-").lower() for w in _WORD.findall(text)]


def blocks(text: str) -> list[int]:
    """Where the blocks of the document begin: lines, and sentences of long lines."""
    out, begin = [], 0
    for line in text.split("\n"):
        out.append(begin)
        if len(line.split()) > LONG_LINE:
            out += [begin + m.end() for m in _STOP.finditer(line) if m.end() < len(line)]
        begin += len(line) + 1
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], max_diff: float):
        self.max_diff = max_diff
        self.words = {k: w for k, v in templates.items() if (w := wording(v))}
        self.slack = {k: int(max_diff * len(w)) for k, w in self.words.items()}
        self.pieces: dict[str, list[tuple[str, int, list[str]]]] = {}
        for k, w in self.words.items():
            n = min(self.slack[k] + 1, len(w))
            for i in range(n):
                a, b = len(w) * i // n, len(w) * (i + 1) // n
                self.pieces.setdefault(w[a], []).append((k, a, w[a:b]))
        self.alone = zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False)
        self.given = {k: zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(v.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for k, v in templates.items()}

    def differences(self, name: str, words: list[str]) -> tuple[int, int, int, int] | None:
        """Words of the template that `words` lack, words put between those that it has, and from where to where it stands; None beyond `max_diff`.

        The least edit distance by leaving out and putting in, with nothing to pay for words before and after; ties to fewer words put in, then to the first place.
        """
        most = self.max_diff * len(self.words[name])
        # (differences, extra, from) of the best way to end before each word.
        row = [(0, 0, j) for j in range(len(words) + 1)]
        for own in self.words[name]:
            cost, extra, begin = row[0]
            left = (cost + 1, extra, begin)
            new = [left]
            for j, word in enumerate(words):
                cost, extra, begin = row[j + 1]
                best = (cost + 1, extra, begin)
                inside = (left[0] + 1, left[1] + 1, left[2])
                if inside < best:
                    best = inside
                if own == word and row[j] < best:
                    best = row[j]
                new.append(best)
                left = best
            row = new
            if min(row)[0] > most:
                return None
        (cost, extra, begin), end = min((x, j) for j, x in enumerate(row))
        return (cost - extra, extra, begin, end) if begin < end else None

    def saved(self, name: str, text: str) -> int:
        """Bytes that the template saves; letters in lower case, as a template's case is no wording."""
        raw = text.lower().encode()
        return len(self.alone.compress(raw)) - len(self.given[name].compress(raw))

    def candidates(self, words: list[str]) -> dict[tuple[str, int], tuple[int, int]]:
        """Of each (template, place) that has a piece of the template: the words from and to that it may take."""
        found: dict[tuple[str, int], tuple[int, int]] = {}
        for at, word in enumerate(words):
            if word in self.pieces:
                for k, offset, piece in self.pieces[word]:
                    low = at - offset - self.slack[k]
                    if (k, low) not in found and words[at : at + len(piece)] == piece:
                        found[k, low] = (max(low, 0), min(low + len(self.words[k]) + 2 * self.slack[k], len(words)))
        return found

    def document(self, text: str) -> list[tuple]:
        """(block, template, bytes saved, missing, extra, text) of the document's confirmed templates, in order."""
        words = wording(text)
        found = self.candidates(words)
        if not found:
            return []
        spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        ranked = sorted((-self.saved(k, " ".join(text[spans[a][0] : spans[b - 1][1]].split())), -len(self.words[k]), k, a, b) for (k, _), (a, b) in found.items())
        kept: list[tuple] = []
        for _, _, k, start, end in ranked:
            if hit := self.differences(k, words[start:end]):
                missing, extra, a, b = hit
                first, last = spans[start + a][0], spans[start + b - 1][1]
                if all(last <= x[0] or first >= x[1] for x in kept):
                    kept.append((first, last, k, self.saved(k, " ".join(text[first:last].split())), missing, extra))
        places = blocks(text)
        return [(bisect_right(places, first) - 1, *hit, text[first:last]) for first, last, *hit in sorted(kept)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, max_diff: float = 0.1) -> DataFrame:
    """(doc_id, block, license, saved_bytes, missing_words, extra_words, text): a row for each confirmed template."""
    given = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, max_diff)
        for batch in batches:
            rows = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in scanner.document((t or b"").decode("utf-8", "replace"))]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "block", "license", "saved_bytes", "missing_words", "extra_words", "text"])

    given_texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return arrow_map(given_texts, run, "doc_id long, block long, license string, saved_bytes long, missing_words long, extra_words long, text string")
