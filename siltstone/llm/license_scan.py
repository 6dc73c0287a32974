"""License scans by template-markup matching.

A template is a licence's wording in which `<<beginOptional>>...<<endOptional>>` encloses words that may be missing
and `<<var;max=N>>` stands for at most N words of any kind. It is compiled into an automaton over words; a place in
a text is accepted if the mandatory wording stands there exactly. Before the automaton runs, a text must hold one
of the template's longest mandatory wordings, which costs a search for a substring.

Words are the runs of digits, letters and non-ASCII characters; A-Z is lower-cased, so case and punctuation are no
wording. Besides, fixed phrases are found wherever their words stand one after another.

Texts: null counts as empty, without words. Very long texts are scanned whole, and only near what they hold of a
template's wording by its automaton. Repeated rows and identifiers are scanned row by row; an empty table gives an
empty one. Other columns of the input are left out.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_of

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wordings of public licences and of their usual notices, with markup.
TEMPLATES = {
    "mit-notice": "<<beginOptional>>this <<var;max=2>> is<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> <<beginOptional>>distributed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "gpl-3.0-notice": "licensed under <<beginOptional>>the terms of<<endOptional>> the gnu general public license <<beginOptional>>as published by the free software foundation either<<endOptional>> version 3 <<beginOptional>>of the license or at your option any later version<<endOptional>>",
    "cc-by-nc-4.0-notice": "licensed under <<beginOptional>>a creative commons attribution noncommercial<<endOptional>> <<beginOptional>>cc by nc<<endOptional>> 4 0 <<beginOptional>>international license<<endOptional>>",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;max=12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-text": "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;max=8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;max=8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>><<beginOptional>>3<<endOptional>> neither the name of <<var;max=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission<<endOptional>> this software is provided by <<var;max=12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;max=12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<beginOptional>>http www apache org licenses license 2 0<<endOptional>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <<var;max=1>> of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program <<beginOptional>>if not see <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> www gnu org licenses<<endOptional>>",
}

_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_MARK = re.compile(r"<<(beginOptional|endOptional|var)(?:;max=(\d+))?>>|([^\s<>]+)")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class _Every:
    def __contains__(self, word) -> bool:
        return True


class Template:
    """Steps: words (bytes), any words (int: how many at most), optional groups (lists of steps). The automaton's
    states are places in the flat program that they are compiled to."""

    def __init__(self, label: str, markup: str):
        self.label = label
        stack: list[list] = [[]]
        for kind, most, word in _MARK.findall(markup):
            if word:
                stack[-1] += words_of(word)
            elif kind == "var":
                stack[-1].append(int(most or 1))
            elif kind == "beginOptional":
                stack.append([])
            else:
                if len(stack) < 2:
                    raise ValueError(f"{label}: an optional region ends that did not begin")
                group = stack.pop()
                stack[-1].append(group)
        if len(stack) != 1:
            raise ValueError(f"{label}: an optional region does not end")
        self.program: list[tuple] = []  # ("word", w), ("any",), ("maybe", target): go on or jump to the target
        self._compile(stack[0])
        runs, before, self.anchor, self.lead = [[]], 0, b"", 0
        for step in stack[0]:
            if isinstance(step, bytes):
                if not runs[-1]:
                    start = before
                runs[-1].append(step)
                before += 1
                if len(b" ".join(runs[-1])) > len(self.anchor):
                    self.anchor, self.lead = b" ".join(runs[-1]), start
            else:
                runs.append([])
                before += step if isinstance(step, int) else self._longest(step)
        # words that a match can begin with; every word if any may stand first
        steps = [self.program[i] for i in self._follow({0}) if i < len(self.program)]
        self.firsts = _Every() if ("any",) in steps else frozenset(x[1] for x in steps if x[0] == "word")
        if not self.anchor:
            raise ValueError(f"{label}: no mandatory wording")
        self.anchor = b" " + self.anchor + b" "

    def _longest(self, steps: list) -> int:
        return sum(1 if isinstance(s, bytes) else s if isinstance(s, int) else self._longest(s) for s in steps)

    def _compile(self, steps: list) -> None:
        for step in steps:
            if isinstance(step, bytes):
                self.program.append(("word", step))
            elif isinstance(step, int):
                for _ in range(step):
                    self.program += [("maybe", len(self.program) + 2), ("any",)]
            else:
                at = len(self.program)
                self.program.append(())
                self._compile(step)
                self.program[at] = ("maybe", len(self.program))

    def _follow(self, states: set[int]) -> set[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                if s < len(self.program) and self.program[s][0] == "maybe":
                    todo += [s + 1, self.program[s][1]]
        return out

    def match(self, words: list[bytes], at: int) -> int | None:
        """Where the longest match that begins at `at` ends, or None."""
        states, end, done = self._follow({0}), None, len(self.program)
        while True:
            if done in states:
                end = at
            if at == len(words):
                return end
            word = words[at]
            states = {s + 1 for s in states if s < done and (self.program[s][0] == "any" or self.program[s] == ("word", word))}
            if not states:
                return end
            states, at = self._follow(states), at + 1

    def spans(self, joined: bytes, words: list[bytes]) -> list[tuple[int, int]]:
        """Leftmost, longest, apart from each other."""
        out, pos, done, anchor_at, last = [], joined.find(self.anchor), 0, 0, 0
        while pos >= 0:
            anchor_at += joined.count(b" ", last, pos)
            last = pos
            for start in range(max(done, anchor_at - self.lead), anchor_at + 1):
                if words[start] in self.firsts and (end := self.match(words, start)) is not None and end > anchor_at:
                    out.append((start, end))
                    done = end
                    break
            pos = joined.find(self.anchor, pos + 1)
        return out


def places(joined: bytes, phrase: bytes) -> list[int]:
    """The first words of all places of a phrase in ` words ... `."""
    out, pos, seen, last = [], joined.find(phrase), 0, 0
    while pos >= 0:
        seen += joined.count(b" ", last, pos)
        last = pos
        out.append(seen)
        pos = joined.find(phrase, pos + 1)
    return out


def _covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, z in sorted(spans):
        total += max(0, z - max(a, reach))
        reach = max(reach, z)
    return total


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words long, phrases array<struct<label, first, last>> and matches array<struct<label, first, last>>
    (word numbers from 0, both inclusive), score double: the share of the words that they cover."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        compiled = [Template(k, v) for k, v in templates.items()]
        fixed = [(b" " + b" ".join(words_of(p)) + b" ", len(words_of(p)), label) for p, label in phrases.items()]
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                n_words, based, matched, scores = [], [], [], []
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    joined = b" " + b" ".join(words) + b" "
                    base = [(label, a, a + size) for phrase, size, label in fixed if phrase in joined for a in places(joined, phrase)]
                    own = [(t.label, a, z) for t in compiled if t.anchor in joined for a, z in t.spans(joined, words)]
                    n_words.append(len(words))
                    for out, found in ((based, base), (matched, own)):
                        out.append([{"label": x, "first": a, "last": z - 1} for x, a, z in sorted(found, key=lambda f: (f[1], f[2], f[0]))])
                    scores.append(_covered([f[1:] for f in (*base, *own)]) / len(words) if words else 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(based, kind), pa.array(matched, kind), pa.array(scores, pa.float64())], names=[id_col, "n_words", "phrases", "matches", "score"])

    source = docs.select(id_col, text_of(text_col).alias("text"))
    span = "array<struct<label: string, first: long, last: long>>"
    return arrow_map(source, run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_words long, phrases {span}, matches {span}, score double")
