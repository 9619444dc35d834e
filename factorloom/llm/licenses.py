"""Licence scans: templates with markup, compiled into one token automaton.

A template is wording with two marks. ``<<beginOptional>> .. <<endOptional>>``
may be absent as a whole; ``<<var;name=..;original=..;match=..>>`` stands for any
words: a to b of them with ``words=a-b``, as many as ``.{a,b}`` characters can hold with a
``match`` of that form whatever b is (characters themselves aren't counted), one of the
wordings with a ``match`` of wordings parted by ``|``, and any number with ``.+``, ``.*``,
``.{a,}`` or no ``match``. Any other ``match`` is an error. Everything else is
mandatory and must match word for word. Optional parts may nest. Marks before the
first mandatory word ask for nothing and are passed over, so published templates
with their optional titles and copyright lines can be loaded as they are.

All templates become one non-deterministic automaton over words, which is run as
a deterministic one whose states are made as they are met. A scan starts it at
every word that can begin a template, so a text costs its length plus, for each
such word, the words the automaton accepts from there (a template at most, or up to
the text's end after a replaceable region without a greatest length).

Words are runs of digits, ASCII letters (lower-cased) and any other character
beyond ASCII. Defined cases: null and empty texts have no words and no places; an
empty table gives no rows;
long texts are scanned in runs that overlap by the longest template (in one run, if
a template has no greatest length); repeated
rows give repeated results; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import small_batches

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licences and of the notices that name them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=holder;words=1-20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, <<beginOptional>>and/or<<endOptional>> <<beginOptional>>and<<endOptional>>
distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=author;words=1-20>>
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL <<var;name=author;words=1-20>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use <<beginOptional>>of this software<<endOptional>> in source and binary forms, with or
without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>>
Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_DISCLAIMER = """ THIS SOFTWARE IS PROVIDED BY <<var;name=holder;words=1-20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL <<var;name=holder;words=1-20>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD2 = _BSD + _DISCLAIMER
_BSD3 = (
    _BSD
    + """ <<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=holder;words=1-20>> nor the names of
<<var;name=its;words=0-3>> contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""
    + _DISCLAIMER
)
_GPL = "GNU <<beginOptional>>Lesser<<endOptional>> General Public License <<beginOptional>>as published by the Free Software Foundation;<<endOptional>> <<beginOptional>>either<<endOptional>> version "
_WARRANTY = """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;name=holder;words=1-20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = (
    """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law."""
    + _WARRANTY
    + " <<beginOptional>>For more information, please refer to <<var;name=url;words=1-6>><<endOptional>>"
)
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will
<<var;name=holder;words=1-20>> be held liable for any damages arising from the use of this software. Permission is granted to
anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>>
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
<<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution."""
_GPL_NOTICE = """<<var;name=program;words=1-6>> is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify
it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public
License as published by the Free Software Foundation; either version <<var;name=version;words=1-2>> of the License, or (at your
option) any later version. <<var;name=program;words=1-6>> is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
<<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License for more details."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at <<var;name=url;words=1-8>>"""
TEMPLATES = {
    "unlicense-text": _UNLICENSE,
    "zlib-text": _ZLIB,
    "gpl-notice": _GPL_NOTICE,
    "mpl-2.0-notice": _MPL_NOTICE,
    "mit-notice": "released under the MIT License",
    "mit-text": _MIT,
    "isc-text": _ISC,
    "bsd-2-clause-text": _BSD2,
    "bsd-3-clause-text": _BSD3,
    "apache-2.0": "Apache License <<beginOptional>>Version<<endOptional>> 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;name=url;words=0-12>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-2.0": _GPL + "2",
    "gpl-3.0": _GPL + "3",
    "cc-by-4.0": "CC BY 4.0",
    "cc-by-nc-4.0": "CC BY NC 4.0",
    "cc-by-sa-4.0": "CC BY SA 4.0",
    "cc-by-text": "Creative Commons Attribution <<beginOptional>>NonCommercial<<endOptional>> <<beginOptional>>ShareAlike<<endOptional>> <<var;name=version;words=0-2>> International <<beginOptional>>Public<<endOptional>> License",
}

#: Bytes to words: A-Z to a-z, every other ASCII character but digits and letters to a space.
_TABLE = bytes(i + 32 if 65 <= i < 91 else i if i > 127 or 48 <= i < 58 or 97 <= i < 123 else 32 for i in range(256))
MARK = re.compile(r"<<\s*(beginOptional|endOptional|var)((?:\"[^\"]*\"|[^>\"])*)>>")


class Region(NamedTuple):
    """What a replaceable region stands for: ``least`` to ``most`` words (None: any number), or one of the wordings."""

    least: int
    most: int | None
    wordings: tuple[tuple[bytes, ...], ...] = ()


def region(rules: str) -> Region:
    if found := re.search(r"words=(\d+)-(\d+)", rules):
        return Region(int(found[1]), int(found[2]))
    given = re.search(r"match=(?:\"([^\"]*)\"|([^;]*))", rules)
    match = ".*" if given is None else (given[1] if given[1] is not None else given[2]).strip()
    if match in (".*", ".+"):
        return Region(int(match == ".+"), None)
    if found := re.fullmatch(r"\.\{(\d*),(\d*)\}", match):
        least = min(int(found[1] or 0), 1)
        # a word and what parts it from the next take two characters
        return Region(least, (int(found[2]) + 1) // 2 if found[2] else None)
    if found := re.fullmatch(r"\((?:\?:)?([^()]*)\)|([^()]*)", match):
        wordings = found[1] if found[1] is not None else found[2]
        if re.fullmatch(r"[\w\s|,:;'/-]+", wordings):  # nothing that a pattern would read as a sign
            return Region(0, 0, tuple(tuple(words_of(w.encode())) for w in wordings.split("|")))
    raise ValueError(f"a region's match isn't known: {match}")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _begun(parts: list[str]) -> list[str]:
    """A template's parts from its first mandatory word on; marks before it go."""
    depth = 0
    for k, part in enumerate(parts):
        if k % 3 == 1:
            depth += (part == "beginOptional") - (part == "endOptional")
        elif k % 3 == 0 and depth == 0 and words_of(part.encode()):
            return parts[k:]
    return parts


class Place(NamedTuple):
    label: str
    start: int
    end: int


class Automaton:
    """All templates as one automaton; see the module's text."""

    def __init__(self, templates: dict[str, str]):
        self.labels = list(templates)
        self.moves: list[dict[bytes, list[int]]] = [{}]
        self.skips: list[list[int]] = [[]]
        self.any: list[list[int]] = [[]]
        self.accepts: list[int] = [-1]
        self.reach: int | None = 1
        for i, (label, markup) in enumerate(templates.items()):
            self._add(i, label, markup)
        self._made: dict[frozenset[int], int] = {}
        self._sets: list[frozenset[int]] = []
        self._next: list[dict[bytes, int]] = []
        self._other: list[frozenset[int]] = []
        self._ends: list[tuple[int, ...]] = []
        self._state(frozenset())  # 0: nothing can follow
        self.start = self._state(self._closed({0}))
        if self._other[self.start]:
            raise ValueError("a template must begin with mandatory wording")
        self.firsts = frozenset(w for s in self._sets[self.start] for w in self.moves[s])

    def _node(self) -> int:
        for x, empty in ((self.moves, {}), (self.skips, []), (self.any, [])):
            x.append(empty)
        self.accepts.append(-1)
        return len(self.moves) - 1

    def _add(self, i: int, label: str, markup: str) -> None:
        at, open_, length, last, endless = 0, [], 0, 0, False
        parts = _begun(MARK.split(markup))
        for k, part in enumerate(parts):
            if k % 3 == 0:
                for word in words_of(part.encode()):
                    new = self._node()
                    self.moves[at].setdefault(word, []).append(new)
                    at, length = new, length + 1
            elif k % 3 == 1 and part == "beginOptional":
                new = self._node()
                self.skips[at].append(new)
                at = new
                open_.append(at)
            elif k % 3 == 1 and part == "endOptional":
                if not open_:
                    raise ValueError(f"{label}: endOptional without beginOptional")
                new = self._node()
                self.skips[at].append(new)
                self.skips[open_.pop()].append(new)
                at = new
            elif k % 3 == 1:
                least, most, wordings = region(parts[k + 1])
                begun, end = at, self._node()
                for wording in wordings:
                    at = begun
                    for word in wording:
                        new = self._node()
                        self.moves[at].setdefault(word, []).append(new)
                        at, length = new, length + 1
                    self.skips[at].append(end)
                if most is None:
                    loop, endless = self._node(), True
                    self.any[loop].append(loop)
                    self.skips[loop].append(end)
                    if least == 0:
                        self.skips[at].append(loop)
                    for n in range(least):
                        new = loop if n == least - 1 else self._node()
                        self.any[at].append(new)
                        at = new
                for n in range(-1 if most is None or wordings else most + 1):
                    if n >= least:
                        self.skips[at].append(end)
                    if n < most:
                        new = self._node()
                        self.any[at].append(new)
                        at, length = new, length + 1
                at = end
            last = at
        if open_ or not length:
            raise ValueError(f"{label}: open optional region or no wording")
        self.accepts[last] = i
        self.reach = None if endless or self.reach is None else max(self.reach, length)

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def _state(self, states: frozenset[int]) -> int:
        if states not in self._made:
            self._made[states] = len(self._sets)
            self._sets.append(states)
            self._next.append({})
            self._other.append(self._closed({t for s in states for t in self.any[s]}))
            self._ends.append(tuple(sorted({self.accepts[s] for s in states} - {-1})))
        return self._made[states]

    def _step(self, state: int, word: bytes) -> int:
        to = {t for s in self._sets[state] for t in self.moves[s].get(word, ())}
        if not to:  # words that no wording knows lead where any word leads; they aren't remembered
            return self._state(self._other[state])
        self._next[state][word] = found = self._state(self._closed(to) | self._other[state])
        return found

    def at(self, words: list[bytes], start: int) -> list[tuple[int, int]]:
        """(template, end) of each template that matches from this word, each at its longest."""
        state, i, ends = self.start, start, {}
        while i < len(words):
            state = self._next[state].get(words[i]) or self._step(state, words[i])
            if not state:
                break
            i += 1
            for label in self._ends[state]:
                ends[label] = i
        return list(ends.items())

    def scan(self, text: bytes, run: int = 1 << 20) -> tuple[int, list[Place]]:
        """The number of words and every place where a template matches."""
        places, words, done, at = [], [], 0, 0
        run = run if self.reach else max(1, len(text))
        while at < len(text) or at == 0:
            cut = at + run
            while cut < len(text) and _TABLE[text[cut]] != 32:
                cut += 1
            words += words_of(text[at:cut])
            at = cut
            ends = at >= len(text)
            upto = len(words) if ends else max(0, len(words) - (self.reach or 0))
            firsts = self.firsts
            for i in [i for i, w in enumerate(words) if w in firsts]:
                if i < upto:
                    places += [Place(self.labels[k], done + i, done + end) for k, end in self.at(words, i)]
            words, done = words[upto:], done + upto
        return done + len(words), places


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (label, base, first and last word) and covered (words inside any place) for each row."""
    small_batches(docs.sparkSession)
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    # a phrase is a template without marks; its entry keeps it apart from templates of the same label
    machine = Automaton({f"phrase:{k}": k for k in phrases} | {f"template:{k}": v for k, v in templates.items()})
    named = {f"phrase:{k}": v for k, v in phrases.items()} | {f"template:{k}": k for k in templates}
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    place = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64())])

    def run(batches):
        for batch in batches:
            counts, found, covered = [], [], []
            for text in batch.column("text"):
                n, places = machine.scan(text.as_buffer().to_pybytes() if text.is_valid else b"")
                places.sort(key=lambda p: (p.start, p.end, p.label))
                inside, upto = 0, 0
                for p in places:
                    inside += max(0, p.end - max(p.start, upto))
                    upto = max(upto, p.end)
                counts.append(n)
                covered.append(inside)
                found.append([{"label": named[p.label], "base": p.label.startswith("phrase:"), "first": p.start, "last": p.end - 1} for p in places])
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.asarray(counts, np.int64)), pa.array(found, pa.list_(place)), pa.array(np.asarray(covered, np.int64))], names=["doc_id", "n_words", "places", "covered"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, places array<struct<label:string,base:boolean,first:long,last:long>>, covered long")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, the share of words inside a place."""
    found = scan(docs)
    base = F.filter("places", lambda p: p["base"])
    listed = lambda places: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))))
    starts = F.transform(base, lambda p: p["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.col("places")).alias("labels"),
        F.when(F.col("n_words") > 0, F.col("covered") / F.col("n_words")).otherwise(0.0).alias("score"),
    )
