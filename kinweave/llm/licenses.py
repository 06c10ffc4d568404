"""License scans by template-markup matching.

A template is the wording of a license with two kinds of markup: ``<<optional>> ... <<end>>`` may be left out, and
``<<any:n>>`` stands for up to n words. It is compiled to an automaton over words; a text is accepted where all mandatory words
stand exactly and in order. Only places where a template's first mandatory words stand are tried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import chunks
from .common import tidy

#: Bytes that words consist of, after A-Z are lower-cased; all others part words.
WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Phrases and the labels that they give.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Public wordings. The first group are notices, the others whole texts; of gpl, mpl-2 and apache-2 there are notices only.
NOTICES = {
    "gpl": ["<<any:4>> under the <<optional>> terms of the <<end>> gnu general public license <<optional>> version <<any:2>> <<end>>"],
    "mit": ["released under the mit license", "licensed under the mit license"],
    "apache-2": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<any:8>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "cc-by-nc": ["licensed under <<optional>> a creative commons attribution noncommercial <<end>> cc by nc <<any:2>>"],
    "bsd": ["<<any:3>> under the <<optional>> terms of the <<end>> <<any:2>> bsd license"],
    "mpl-2": ["subject to the terms of the mozilla public license v 2 0"],
    "agpl-3": ["under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license <<optional>> or at your option any later version <<end>>"],
    "lgpl": ["under the terms of the gnu lesser general public license as published by the free software foundation either version <<any:2>> of the license <<optional>> or at your option any later version <<end>>"],
    "epl": ["made available under the terms of the eclipse public license <<any:3>>"],
    "cc-by": ["licensed under <<optional>> a <<end>> creative commons attribution <<any:2>> international license"],
    "cc-by-sa": ["licensed under <<optional>> a <<end>> creative commons attribution sharealike <<any:2>> international license"],
    "cc0": ["to the extent possible under law <<any:12>> has waived all copyright and related or neighboring rights to"],
}
TEXTS = {
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<any:1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<any:1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<any:1>> this notice may not be removed or altered from any source distribution"
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software <<optional>> for more information please refer to <<any:4>> <<end>>"
    ],
    "0bsd": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and <<any:4>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<any:4>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ],
    "bsl-1": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ],
    "postgresql": [
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies in no event shall <<any:8>> be liable to any party for direct indirect special incidental or consequential damages including lost profits arising out of the use of this software and its documentation even if <<any:8>> has been advised of the possibility of such damage"
    ],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<any:8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ],
    "isc": [
        "permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<any:4>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<any:4>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<any:1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<any:1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<optional>> <<any:1>> neither the name of <<any:8>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission <<end>> this software is provided by <<any:8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any:8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
    ],
}
#: A whole text weighs more than a notice, and a notice more than a bare phrase.
SCORES = {"text": 1.0, "notice": 0.9, "phrase": 0.6}


class Template:
    """States are places between words. ``skips`` of a state: states reached without a word; ``loops``: any word may follow."""

    def __init__(self, label: str, kind: str, markup: str):
        self.label, self.kind = label, kind
        self.words: list[str | None] = []  # None: any word
        self.skips: dict[int, list[int]] = {}
        opened = None
        for part in re.findall(r"<<[^>]*>>|[^\s<>]+", markup):
            if part == "<<optional>>":
                opened = len(self.words)
            elif part == "<<end>>":
                self.skips.setdefault(opened, []).append(len(self.words))
            elif part.startswith("<<any:"):
                end = len(self.words) + int(part[6:-2])
                for at in range(len(self.words), end):
                    self.skips.setdefault(at, []).append(end)
                self.words += [None] * (end - len(self.words))
            else:
                self.words.append(part)
        at = 0  # leading markup: the anchor is the first mandatory word
        while at in self.skips or self.words[at] is None:
            at = self.skips[at][0] if at in self.skips else at + 1
        self.lead, self.anchor = at, []
        while at < len(self.words) and self.words[at] is not None and at not in self.skips and len(self.anchor) < 3:
            self.anchor.append(self.words[at])
            at += 1
        self.pattern = (" " + " ".join(self.anchor) + " ").encode()

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.skips.get(todo.pop(), ()):
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def accepts(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest match whose first mandatory word is at ``at``; leading any-words need no words."""
        states, best = self.closure({self.lead}), None
        for i in range(at, len(words) + 1):
            if len(self.words) in states:
                best = i
            if i == len(words) or not states:
                break
            word = words[i].decode("utf-8", "replace")
            states = self.closure({s + 1 for s in states if s < len(self.words) and self.words[s] in (None, word)})
        return best


@lru_cache(maxsize=1)
def templates() -> list[Template]:
    return [Template(k, kind, m) for kind, group in (("notice", NOTICES), ("text", TEXTS)) for k, ms in group.items() for m in ms]


def places(flat: bytes, pattern: bytes) -> Iterator[int]:
    """Word numbers where the words of pattern stand; both have one blank before each word and one at the end."""
    at, word, last = flat.find(pattern), 0, 0
    while at >= 0:
        word += flat.count(b" ", last, at)
        last = at
        yield word
        at = flat.find(pattern, at + 1)


def scan(text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, str]]]:
    """Number of words, (start, label) of phrases, (start, end, label, kind) of accepted templates."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()
    flat = b" ".join([b"", *words, b""])
    base = sorted((at, label) for phrase, label in PHRASES.items() for at in places(flat, f" {phrase} ".encode()))
    found = []
    for t in templates():
        for at in places(flat, t.pattern):
            if (end := t.accepts(words, at)) is not None:
                found.append((at, end, t.label, t.kind))
    return len(words), base, sorted(found)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (start, label of phrases), found (start, end, label, kind of templates), score of docs(doc_id, text).

    Places are word numbers from 0. A null or empty text has no words, places or labels and scores 0. score is that of the
    strongest evidence: 1 for a whole text, 0.9 for a notice, 0.6 for a phrase alone. Repeated rows give repeated rows, very long
    texts are scanned whole, an empty table gives an empty one, and other columns, of any name, are not looked at.
    """
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text").to_pylist()):
                got = [scan(x) for x in part]
                score = [max([0.0, *(SCORES[f[3]] for f in x[2]), *(SCORES["phrase"] for _ in x[1])]) for x in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(part)),
                        pa.array([x[0] for x in got], pa.int64()),
                        pa.array([[{"start": s, "label": k} for s, k in x[1]] for x in got], base_type),
                        pa.array([[{"start": s, "end": e, "label": k, "kind": kind} for s, e, k, kind in x[2]] for x in got], found_type),
                        pa.array(score, pa.float64()),
                    ],
                    names=["doc_id", "n_words", "base", "found", "score"],
                )
                at += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_words long, base array<struct<start: bigint, label: string>>, found array<struct<start: bigint, `end`: bigint, label: string, kind: string>>, score double")
