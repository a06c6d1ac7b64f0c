"""License scans by conditional compression.

A block that reads like a licence is compressed alone and with each template as a raw zstandard
dictionary. The template that saves the most is the candidate; the exact differences in wording
then confirm or refuse it: words that name a licence, its version or a negation must agree. Blocks are sentences, runs of them, and places found by aligning the
templates' words to the text, which line breaks and neighbouring text don't disturb. An SPDX tag
with the identifier behind it is such a place; of an expression the first identifier counts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import for_python, text_of

#: Wordings of licences and notices, by SPDX-like name.
WORDINGS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)
#: Parts of the BSD licences and the disclaimer of the ISC licence.
BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC_TERMS = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: How the texts of long licences begin, and another notice.
HEADINGS = (
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
)
#: The notice of a GNU licence of another kind or version than the one above.
GNU = (("GPL-2.0", "General", "2"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"))
GNU_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."
#: Identifiers that are known by their SPDX tag alone.
TAGGED = ("0BSD", "AFL-3.0", "Apache-1.1", "Artistic-2.0", "BSL-1.0", "CC-BY-3.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "LGPL-2.0", "MIT-0", "MPL-1.1", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "Python-2.0", "WTFPL", "Zlib", "ZPL-2.1")
#: Words that tell one licence from another, and words that turn a grant into its opposite.
NAMES = frozenset("affero afl apache artistic attribution boost bsd cc cc0 clause creative commons eclipse epl eupl general gnu gpl isc lesser lgpl agpl library mit mozilla mpl nc nd noderivatives noderivs noncommercial psf python sa sharealike unlicense wtfpl zero zlib".split())
NEGATIONS = frozenset("cannot except excluding isn never neither no none nor not unlicensed".split())
#: A number that is a version by its looks; others are versions behind one of these words.
VERSION, VERSIONED = re.compile(r"v?[0-9]+(\.[0-9]+)+|v[0-9]+"), frozenset(("version", "v"))
#: Words before a block, in its sentence, that may turn it into its opposite.
BEFORE = 3
#: A licence's words that any may stand beside: they name none where another is found.
NOBODYS = "Proprietary"
TAG = "SPDX-License-Identifier"


def templates() -> tuple[tuple[str, str], ...]:
    """Name and wording of each template: those listed, and an SPDX tag for each name."""
    listed = [
        *WORDINGS,
        ("BSD-2-Clause", f"{BSD_TERMS} {BSD_DISCLAIMER}"),
        ("BSD-3-Clause", f"{BSD_TERMS} {BSD_NAMES} {BSD_DISCLAIMER}"),
        ("ISC", f"{ISC_TERMS} {ISC_DISCLAIMER}"),
        *HEADINGS,
        *((name, GNU_NOTICE.format(kind=kind, version=version)) for name, kind, version in GNU),
    ]
    tags = []
    for name in dict.fromkeys([*(name for name, _ in listed if name != NOBODYS), *TAGGED]):
        tags += [(name, f"{TAG}: {name}{end}") for end in (("", "-only", "-or-later") if "GPL" in name else ("",))]
    return (*listed, *tags)


TEMPLATES = templates()
#: A sentence with one of these begins a block; one with those below may go on with it.
HINTS = r"licen[cs]e|copyright|all\s+rights\s+reserved|creative\s+commons|public\s+domain|\bcc0\b|\bcc\s+by|spdx|permission|redistribut|warrant"
MORE = HINTS + r"|software|conditions|disclaim|liab|merchantab|documentation"
#: Words of a block at most; longer runs go on in another block.
LONGEST = 400
#: Differing words up to which a candidate is confirmed, as a share of the template's words.
DIFFERING = 0.15
#: Share of the block's compressed size that the candidate has to save.
SAVING = 0.3
#: Bytes, or share of the block's compressed size, within which two savings are a draw.
DRAW, DRAW_SHARE = 8, 0.0625
LEVEL = 3
#: Words in a row that a block and its template share at least: edits up to DIFFERING leave some.
SEED = 3
#: A word may go on in the next line after a hyphen, behind what marks a comment there.
WORD = re.compile(r"[A-Za-z0-9]+(?:(?:\.|-(?:[ \t\r]*\n[^A-Za-z0-9\n]*)?)[A-Za-z0-9]+)*")
WRAPPED = re.compile(r"-[ \t\r]*\n[^a-z0-9]*")
CLOSING = re.compile(r"[^\w\s]*")
BREAK = re.compile(r"(?<=[.!?])\s+|\n+")
HINT, GOES_ON = re.compile(HINTS, re.I), re.compile(MORE, re.I)


class Found(NamedTuple):
    """A block's best template, and its licence if it is confirmed. ``differences`` has - template words and + words of the text."""

    start: int
    end: int
    license: str | None
    template: int
    size_alone: int
    size_given: int
    n_differences: int
    differences: str
    confirmed: bool


def words(text: str) -> list[str]:
    return [WRAPPED.sub("-", w) for w in WORD.findall(text.lower())]


@lru_cache(1)
def compressors() -> tuple[zstandard.ZstdCompressor, list[zstandard.ZstdCompressor]]:
    """One without and one with each template as raw dictionary, as long as the worker lives."""
    raw = [zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in TEMPLATES]
    return zstandard.ZstdCompressor(level=LEVEL), [zstandard.ZstdCompressor(level=LEVEL, dict_data=d) for d in raw]


@lru_cache(1)
def template_words() -> list[list[str]]:
    return [words(t) for _, t in TEMPLATES]


def deciding(own: list[str]) -> list[set[str]]:
    """For each word what it says of a licence's name, version or negation; mostly nothing."""
    out = []
    for before, word in zip(["", *own], own, strict=False):
        parts = {word, *word.split("-")}
        numbers = {p for p in parts if VERSION.fullmatch(p) or (before in VERSIONED and p[:1].isdigit())}
        out.append((parts & NAMES) | (parts & NEGATIONS) | {p.removeprefix("v") for p in numbers})
    return out


@lru_cache(1)
def template_deciding() -> list[tuple[list[set[str]], set[str]]]:
    """What each template's words say, and all that its wording or its licence's name says anywhere."""
    out = []
    for (name, _), own in zip(TEMPLATES, template_words(), strict=True):
        said = deciding(own)
        named = set(name.lower().split("-")) if name != NOBODYS else set()
        out.append((said, set().union(*said, named)))
    return out


def agrees(k: int, own: list[set[str]], ops: list[tuple]) -> bool:
    """No difference touches what tells licences apart: of the template's such words none is missing or
    replaced, and the block has none that neither the template nor its licence's name has."""
    said, anywhere = template_deciding()[k]
    return all(not set().union(*said[a:b]) and not set().union(*own[c:d]) - (anywhere - NEGATIONS) for _, a, b, c, d in ops)


def negated(text: str, start: int) -> bool:
    """A word shortly before, in the same sentence, says the opposite."""
    before = BREAK.split(text[max(0, start - 80) : start])[-1]
    return bool(NEGATIONS & {p for w in words(before)[-BEFORE:] for p in w.split("-")})


def best(text: str, start: int, end: int) -> Found:
    """Templates are ranked by what they save; a draw goes to one that agrees in names, versions and negations,
    then to the one whose wording differs least. Only one that agrees can be confirmed."""
    alone, given = compressors()
    block = text[start:end].encode()
    own, size = words(text[start:end]), len(alone.compress(block))
    told = deciding(own)
    sizes = [len(c.compress(block)) for c in given]
    # what saves nearly as much as the best is a draw, which wording decides
    most, scored = min(sizes) + max(DRAW, int(DRAW_SHARE * size)), []
    for k in (k for k, x in enumerate(sizes) if x <= most):
        ops = [o for o in SequenceMatcher(None, template_words()[k], own, autojunk=False).get_opcodes() if o[0] != "equal"]
        scored.append((not agrees(k, told, ops), sum(max(b - a, d - c) for _, a, b, c, d in ops), sizes[k], k, ops))
    differs, n, given_size, k, ops = min(scored, key=lambda x: x[:4])
    shown = "; ".join(f"-[{' '.join(template_words()[k][a:b])}] +[{' '.join(own[c:d])}]" for _, a, b, c, d in ops)
    confirmed = not differs and n <= DIFFERING * len(template_words()[k]) and size - given_size >= SAVING * size and not negated(text, start)
    return Found(start, end, TEMPLATES[k][0] if confirmed else None, k, size, given_size, n, shown, confirmed)


def sentences(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in BREAK.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


@lru_cache(1)
def seeds() -> dict[tuple, list[tuple[int, int]]]:
    """Template and place of each SEED words in a row."""
    out = defaultdict(list)
    for k, own in enumerate(template_words()):
        for at in range(len(own) - SEED + 1):
            out[tuple(own[at : at + SEED])].append((k, at))
    return dict(out)


def aligned(text: str) -> set[tuple[int, int]]:
    """Places where the words of a template stand with few differences, whatever breaks the lines.

    An edit touches SEED seeds at most and moves later words by one, so a block with ``d`` edits
    has all but SEED * d seeds of its template, at starts that are at most ``d`` words apart.
    """
    spots = [(m.start(), m.end(), WRAPPED.sub("-", m.group().lower())) for m in WORD.finditer(text)]
    own = [w for _, _, w in spots]
    out = {(a, b) for (a, _, w), (_, b, _) in zip(spots, spots[1:], strict=False) if w == TAG.lower()}
    starts = defaultdict(Counter)
    for at, gram in enumerate(zip(*(own[k:] for k in range(SEED)), strict=False)):
        for k, place in seeds().get(gram, ()):
            starts[k][at - place] += 1
    for k, count in starts.items():
        template = template_words()[k]
        most = int(DIFFERING * len(template))
        need = max(1, len(template) - SEED + 1 - SEED * most)
        ranked = sorted((-n, x) for x in count if (n := sum(count[x + e] for e in range(most + 1))) >= need)
        tried: set[int] = set()
        for _, x in ranked:
            if x in tried:
                continue
            tried.update(range(x - most, x + most + 1))
            low = max(x, 0)
            near = own[low : x + most + len(template)]
            matched = [m for m in SequenceMatcher(None, template, near, autojunk=False).get_matching_blocks() if m.size]
            if matched:
                first, last = low + matched[0].b, low + matched[-1].b + matched[-1].size - 1
                out.add((spots[first][0], CLOSING.match(text, spots[last][1]).end()))
    return out


def scan(text: str) -> list[Found]:
    """The blocks of a text, in order: a run of sentences where a template confirms it as a whole;
    else the sentences and the places aligned to a template that are confirmed, longer ones first;
    and each other sentence that has a hint, with its best template, not confirmed. Reserved rights
    beside a confirmed licence in one run of sentences are part of its notice and no block."""
    runs: list[list[tuple[int, int]]] = []
    last, size = -2, 0
    for k, (a, b) in enumerate(sentences(text)):
        part = text[a:b]
        goes_on = last == k - 1 and size < LONGEST and GOES_ON.search(part)
        if goes_on or HINT.search(part):
            if goes_on:
                runs[-1].append((a, b))
            else:
                runs.append([(a, b)])
                size = 0
            size += len(part.split())
            last = k
    out, single = [], []
    for run in runs:
        whole = best(text, run[0][0], run[-1][1]) if len(run) > 1 else None
        if whole and whole.confirmed:
            out.append(whole)
        else:
            single += [best(text, a, b) for a, b in run if HINT.search(text, a, b)]

    def free(f: Found) -> bool:
        return all(f.end <= x.start or x.end <= f.start for x in out)

    known = {(f.start, f.end) for f in [*out, *single]}
    places = [f for a, b in sorted(aligned(text) - known) if (f := best(text, a, b)).confirmed]
    for f in sorted([f for f in [*single, *places] if f.confirmed], key=lambda f: (f.start - f.end, f.start)):
        if free(f):
            out.append(f)
    out += [f for f in single if not f.confirmed and free(f)]
    named = [f for f in out if f.confirmed and f.license != NOBODYS]
    beside = [(r[0][0], r[-1][1]) for r in runs if any(f.start < r[-1][1] and r[0][0] < f.end for f in named)]
    return sorted((f for f in out if TEMPLATES[f.template][0] != NOBODYS or not any(a <= f.start < b for a, b in beside)), key=lambda f: f.start)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, block and the fields of Found: one row per block of each text, null texts have none.

    A block that no template confirms has a null licence; its template is the nearest one.

    Very long texts are read whole; repeated rows repeat in the result, other columns are ignored.
    Texts without a hint are left out by a filter in Spark, before any goes to Python; nothing is
    shuffled. Ids may be null or repeat. An empty table gives none.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("size_alone", pa.int64()), ("size_given", pa.int64()), ("n_differences", pa.int64()), ("differences", pa.string()), ("confirmed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(key, k, *f) for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) for k, f in enumerate(scan(text.as_py()))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    hinted = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).where(F.col("text").rlike(f"(?i){HINTS}"))
    return for_python(hinted).mapInArrow(run, "doc_id long, block int, start long, end long, license string, template int, size_alone long, size_given long, n_differences long, differences string, confirmed boolean")
