"""License scans by conditional compression.

Blocks of a text that share wording with a license template are candidates.  Each is compressed with
each template that it shares wording with as a raw zstandard dictionary; the template that makes it smallest
by the largest part ranks first.  In that order they are confirmed by their exact words, until one is: the block is aligned with the
template; words of the template that the block lacks and words that stand in between are counted and reported.
The place found is ranked in the same way, then what lies around it.
Versions, "later", and the names Lesser (or Library) and Affero have to be those of the template, if it has any.

Blocks are the whole text with its empty lines ignored, runs of lines between empty lines, and each single
line of theirs, so a notice at the end of a text is found as well as a license set in paragraphs; of findings
that overlap the longest stays.  Defined cases: null and empty texts have no
findings; equal reductions go to the template with most words there, then first by name; repeated rows repeat their findings; ids are whole
numbers (text ids are cast, one that is no number is an error) and may be null; an empty table gives no rows; further columns are ignored.
Blocks that lack the words a confirmation needs are not aligned, so that long texts of repeated license words take time in proportion.
SPDX tags, names with a version ("GNU GPL v3") and headings of a few words are found by pattern, then compressed with notices of their own kind
and confirmed by all their words; identifiers that no notice has give no finding. Long blocks are cut into windows that overlap by half, of at least ``WINDOW`` words and three
times those of the longest template, so that any place with a template's words lies in one.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect
from collections import Counter
from functools import lru_cache
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: License notices and texts, by SPDX identifier. <...> stands for words that differ from copy to copy.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-text": "Licensed under the Apache License 2.0",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "MIT": "Released under the MIT License",
    "MIT-notice": "Licensed under the MIT License",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: The headers of the GNU licenses, by name, what stands before "General Public License", and version.
GNU = [("GPL", "", "1.0"), ("GPL", "", "2.0"), ("GPL", "", "3.0"), ("LGPL", "Lesser ", "2.0"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3.0"), ("AGPL", "Affero ", "3.0")]
for _name, _kind, _version in GNU:
    for _end, _which in (("or-later", "either version {} of the License, or (at your option) any later version"), ("only", "version {} of the License")):
        TEMPLATES[f"{_name}-{_version}-{_end}-notice"] = (
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind}General Public License as published by the Free Software Foundation, {_which.format(_version.removesuffix('.0'))}. "
            f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {_kind}General Public License for more details."
        )
#: The licenses of Creative Commons: conditions by their short and long names, and versions with what they are called.
for _short, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _version, _which in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES[f"CC-{_short}-{_version}"] = f"Licensed under CC {_short} {_version}"
        TEMPLATES[f"CC-{_short}-{_version}-notice"] = f"This work is licensed under the Creative Commons {_long} {_version} {_which} License"
        TEMPLATES[f"CC-{_short}-{_version}-text"] = f"Licensed under the Creative Commons {_long} {_version}"
#: Identifiers that a tag may name (fixed values): those of the templates and other common ones.
SPDX_IDS = sorted(
    {re.sub(r"-(notice|text)$", "", k) for k in TEMPLATES}
    | {f"{name}-{version}{end}" for name, _, version in GNU for end in ("", "+", "-only", "-or-later")}
    | set("0BSD AFL-3.0 APSL-2.0 Apache-1.1 Artistic-2.0 BSD-3-Clause-Clear BSL-1.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 ECL-2.0 EUPL-1.1 EUPL-1.2 ISC MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 PSF-2.0 UPL-1.0 Unlicense W3C WTFPL X11 Zlib".split())
)
#: Notices of a few words, too short for word pairs: a pattern finds candidates, which are compressed and confirmed as all others.
BRIEF = {
    "tag": {k: f"SPDX-License-Identifier {k}" for k in SPDX_IDS},
    "short name": {f"{name}-{version}": f"GNU {name} v {version}" for name, _, version in GNU},
    "heading": {"MIT": "The MIT License"},
}
#: Words that any candidate block has (fixed values).
CUES = ("licens", "permi", "redistribut", "public domain", "copyright", "waived", "gpl", "cc by")
#: Least part of its size that a block has to lose, and least part of the template's words that it has to have.
REDUCTION = 0.3
WORDING = 0.8
#: Templates with fewer words have to be there word for word, but for the words that name no license.
SHORT = 40
FREE = frozenset("this work program software is the author licensed released http international unported generic which accompanies distribution available at https".split())
WINDOW = 400
LEVEL = 9

WORD = re.compile(r"\w+(?:[.'-]\w+)*")
#: Candidates of BRIEF: a tag, a name with a version, a line of its own.
BRIEFLY = {
    "tag": re.compile(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)"),
    "short name": re.compile(r"\bGNU\s+([AL]?GPL),?\s+v(?:ersion\s+)?(\d(?:\.\d)?)(?!\.?\w)", re.I),
    "heading": re.compile(r"\W*((?:the\s+)?mit\s+license(?:\s+\(mit\))?)\W*", re.I),
}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def brief_words(text: str) -> list[str]:
    """Words of a tag or short name: identifiers whole, versions by themselves and without a final .0."""
    if found := BRIEFLY["tag"].search(text) or re.match(r"(?:SPDX-License-Identifier) (\S+)$", text):
        return ["spdx-license-identifier", found[1].lower().rstrip(".")]
    parts = re.findall(r"[a-z]+|\d+(?:\.\d+)*", text.lower())
    return ["v" if w == "version" else re.sub(r"(\.0)+$", "", w) for w in parts]


def windows(text: str, size: int = WINDOW):
    """Words of a text as matches, at most ``size`` at a time, each window with half of the one before."""
    rest = WORD.finditer(text)
    window = list(islice(rest, size))
    while window:
        yield window
        more = list(islice(rest, size // 2))
        window = window[size // 2 :] + more if more else []


def densest(runs: list, gap: float = 0.25, near: int = 0) -> list:
    """Neighbouring runs with most words less a quarter (or ``gap``) of those between, beyond ``near``: words that agree by chance far off stay out."""
    best, top, start, total = (0, 0), 0.0, 0, 0.0
    for i, m in enumerate(runs):
        if i:
            total -= max(0, m.b - runs[i - 1].b - runs[i - 1].size - near) * gap
        if total <= 0:
            start, total = i, 0.0
        total += m.size
        if total > top:
            best, top = (start, i + 1), total
    return runs[best[0] : best[1]]


def decisive(ws: list[str]) -> frozenset[str]:
    """What tells licenses of nearly the same words apart: version numbers, "later" versions, Lesser and Affero, conditions of Creative Commons."""
    found = set()
    for before, w, after in zip(["", *ws], ws, [*ws[1:], ""]):
        if after == "general" and w in ("lesser", "library", "affero"):
            found.add("affero" if w == "affero" else "lesser")  # the Library license was renamed
        elif w in ("nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "noderivs"):
            found.add(w)
        elif w == "later" and (after == "version" or before == "or"):
            found.add(w)
        elif m := re.fullmatch(r"(v?)(\d+(?:\.\d+)*)", w):
            if m[1] or before in ("version", "v"):
                found.add("version " + re.sub(r"(\.0)+$", "", m[2]))
    return frozenset(found)


def blocks(candidates: list[tuple[int, int, str]]) -> list[tuple[int, int, dict[str, list[tuple[int, int]]]]]:
    """Candidates that overlap, as one block: first word, end, and each template's candidates in it."""
    found: list[tuple] = []
    for a, b, k in sorted(candidates):
        if found and a < found[-1][1]:
            start, end, spans = found.pop()
        else:
            start, end, spans = a, b, {}
        spans.setdefault(k, []).append((a, b))
        found.append((start, max(end, b), spans))
    return found


class Scanner:
    """Templates with their dictionaries and pairs of neighbouring words."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        import zstandard

        self.words = {k: words(v) for k, v in templates.items()}
        self.window = max(WINDOW, 3 * max(map(len, self.words.values())))
        self.decisive = {k: decisive(ws) for k, ws in self.words.items()}
        # Words that a short template can't do without, and how often each word of any stands in it.
        self.needed = {k: frozenset(ws) - FREE for k, ws in self.words.items()}
        self.counts = {k: Counter(ws) for k, ws in self.words.items()}
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)


        def primed(text: str):
            raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.brief = {kind: {k: (brief_words(text), primed(" ".join(brief_words(text)))) for k, text in own.items()} for kind, own in BRIEF.items()}
        self.with_template = {k: primed(" ".join(ws)) for k, ws in self.words.items()}
        self.pairs: dict[tuple, set] = {}
        for k, ws in sorted(self.words.items()):
            for pair in zip(ws, ws[1:]):
                self.pairs.setdefault(pair, set()).add(k)

    def candidates(self, ws: list[str]) -> list[tuple[int, int, str]]:
        """Blocks (first word, end, template) in which word pairs of a template stand close together.

        Half of the template's pairs, or twenty, make a candidate; near a block's other words they would be lost.
        Words of a short template may stand around its pairs: a wider block is a candidate too.
        """
        spots: dict[str, list[int]] = {}
        for i, pair in enumerate(zip(ws, ws[1:])):
            for k in self.pairs.get(pair, ()):
                spots.setdefault(k, []).append(i)
        found = []
        for k, at in spots.items():
            n = len(self.words[k])
            cuts = [0, *(i for i in range(1, len(at)) if at[i] - at[i - 1] > max(4, n // 4)), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if b - a >= min(20, max(2, (n - 1) // 2)):
                    found.append((at[a], at[b - 1] + 2, k))
                    if n < SHORT:
                        found.append((max(0, at[a] - 4), min(len(ws), at[b - 1] + 6), k))
        return sorted(found)

    def ranked(self, ws: list[str], names: list[str]) -> list[tuple[float, str]]:
        """(reduction, template), largest first: how much smaller the block is with the template as dictionary."""
        data = " ".join(ws).encode()
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(self.with_template[k].compress(data)) / alone, k) for k in names), key=lambda x: (-x[0], x[1]))

    def aligned(self, ws: list[str], name: str) -> list:
        """Runs of words that a block has in common with a template, in order."""
        matcher = difflib.SequenceMatcher(None, self.words[name], ws, autojunk=False)
        return [m for m in matcher.get_matching_blocks() if m.size]

    def compared(self, ws: list[str], name: str) -> tuple[int, int, int, int, bool]:
        """Template words in the block, missing from it, first and last place in the block that agrees; whether only free words miss."""
        runs = self.aligned(ws, name)
        if len(self.words[name]) >= SHORT:
            runs = densest(runs)
        same = sum(m.size for m in runs)
        there = {i for m in runs for i in range(m.a, m.a + m.size)}
        free = all(i in there or w in FREE for i, w in enumerate(self.words[name]))
        return same, len(self.words[name]) - same, (runs[0].b if runs else 0), (runs[-1].b + runs[-1].size if runs else 0), free

    def possible(self, ws: list[str], a: int, b: int, name: str) -> bool:
        """Whether the block has the words, in whatever order, that a confirmation needs: told without aligning them."""
        if len(self.words[name]) < SHORT:
            return self.needed[name].issubset(ws[a:b])
        return sum((self.counts[name] & Counter(ws[a:b])).values()) >= WORDING * len(self.words[name])

    def briefly(self, found: re.Match, kind: str) -> dict | None:
        """The finding of a few words: compressed with each of its kind's notices, the first confirmed by all of its words."""
        ws = brief_words(found[0])
        data = " ".join(ws).encode()
        alone = len(self.plain.compress(data))
        ranks = sorted((len(with_.compress(data)) / alone - 1, k) for k, (_, with_) in self.brief[kind].items())
        for less, k in ranks:
            own = self.brief[kind][k][0]
            if set(own) - FREE == set(ws) - FREE:
                same = sum((Counter(own) & Counter(ws)).values())
                group = 1 if kind == "heading" else 0
                return {"license": k, "template": kind, "reduction": -less, "wording": same / len(own), "missing": len(own) - same, "inserted": len(ws) - same, "at": found.start(group), "end": found.end(group)}
        return None

    def confirmed(self, ws: list[str], a: int, b: int, name: str) -> list[tuple[int, int, int, int]]:
        """As compared(), for each place of a block whose exact words are the template's; what lies around a place is compared anew."""
        n, need = len(self.words[name]), self.decisive[name]
        found, todo = [], [(a, b)]
        while todo:
            a, b = todo.pop()
            if not self.possible(ws, a, b, name) or not need <= decisive(ws[a:b]):
                continue
            same, missing, first, last, free = self.compared(ws[a:b], name)
            # Of a short notice all words that name the license have to be there: one different word is another license.
            agrees = free and last - first <= n + 4 if n < SHORT else same >= WORDING * n
            if agrees and (decisive(ws[a + first : a + last]) == need or n >= SHORT and not need):
                found.append((same, missing, a + first, a + last))
            if same:
                todo += [x for x in ((a, a + first), (a + last, b)) if x[1] - x[0] >= (WORDING * n if n >= SHORT else 2)]
        return found

    def places(self, ws: list[str], a: int, b: int, name: str) -> list[tuple[bool, int, int, int, int]]:
        """As confirmed(), most words first, without words far off from the rest; not exact (False) if a place is confirmed only with them."""
        found = []
        for place in self.confirmed(ws, a, b, name):
            exact = [place]
            if len(self.words[name]) >= SHORT:
                runs = densest(self.aligned(ws[place[2] : place[3]], name), 1, 4)
                exact = self.confirmed(ws, place[2] + runs[0].b, place[2] + runs[-1].b + runs[-1].size, name)
            found += [(True, *x) for x in exact] or [(False, *place)]
        return sorted(found, key=lambda x: (-x[1], x[2:]))

    def wins(self, ws: list[str], a: int, b: int, names: list[str], places) -> list[tuple]:
        """(exact, template words there, missing, first word, end, template, reduction) of places that templates win in a block.

        The block is compressed with each template, and words are aligned in the order of the reductions. As a block may hold
        several licenses, each place of the first template confirmed is compressed with each anew: it goes to the one that
        reduces it most of those confirmed there, of equal reductions to the one with most words, then first by name.
        """
        found: list[tuple] = []

        def free(k):
            return [p for p in places(k) if not any(p[3] < x[4] and x[3] < p[4] for x in found)]

        def best(first, last, exact):
            for _, equal in groupby(self.ranked(ws[first:last], names), lambda x: x[0]):
                over = [(*p, m) for _, m in equal for p in free(m) if p[0] == exact and p[3] < last and first < p[4]]
                over = [(*x, self.ranked(ws[x[3] : x[4]], [x[5]])[0][0]) for x in over]
                if over := [x for x in over if x[6] >= REDUCTION]:
                    return min(over, key=lambda x: (-x[1], x[2], x[5], x[3]))
            return None

        for exact in (True, False):  # what is not exact may be so once other places are taken
            for _, k in self.ranked(ws[a:b], names):
                for p in places(k):
                    if p in free(k) and (x := best(p[3], p[4], exact)):
                        found.append(x)
                        if not exact:
                            return found
                if found:
                    return found
        return found

    def winners(self, ws: list[str]) -> list[tuple]:
        """As wins(), for all places; what lies around them is compressed and ranked anew."""
        places = lru_cache(maxsize=None)(lambda a, b, k: self.places(ws, a, b, k))
        found, todo = [], blocks(self.candidates(ws))
        while todo:
            a, b, spans = todo.pop()
            own = sorted(self.wins(ws, a, b, list(spans), lambda k: sorted({p for x in spans[k] for p in places(*x, k)}, key=lambda p: (-p[1], p[2:]))), key=lambda x: x[3])
            found += own
            for start, end in zip([a, *(x[4] for x in own)], [*(x[3] for x in own), b]) if own else ():
                cut = [(max(x, start), min(y, end), k) for k, at in spans.items() for x, y in at]
                todo += blocks([x for x in cut if x[1] - x[0] > 1])
        return found

    def match(self, text: str) -> list[dict]:
        """Findings in one block."""
        found = [x for kind in ("tag", "short name") for m in BRIEFLY[kind].finditer(text) if (x := self.briefly(m, kind))]
        for spots in windows(text, self.window):
            window = [m[0].lower() for m in spots]
            for _, same, missing, first, last, k, reduction in self.winners(window):
                found.append({"license": re.sub(r"-(notice|text)$", "", k), "template": k, "reduction": reduction, "wording": same / len(self.words[k]), "missing": missing, "inserted": last - first - same, "at": spots[first].start(), "end": spots[last - 1].end()})
        distinct = {(x["license"], x["at"], x["end"]): x for x in found}
        return sorted(distinct.values(), key=lambda x: (x["at"], x["license"]))

    def scan(self, text: str | None) -> list[dict]:
        """Findings of a whole text in order, with their places in it."""
        if not text:
            return []
        low = text.lower()
        if not any(cue in low for cue in CUES):
            return []
        own, seen = [(0, x) for x in self.match(text)], {(0, len(text))}  # a line that is all of its block is matched once
        for m in re.finditer(r"(?:(?!\n[ \t\r]*\n).)+", text, re.S):
            block = m[0]
            if not any(cue in block.lower() for cue in CUES):
                continue
            spans = [(m.start() + x.start(), x[0]) for x in re.finditer(r"[^\n]+", block) if any(c in x[0].lower() for c in CUES)]
            lines = [(start, line) for start, line in spans if (start, start + len(line)) not in seen]
            seen.update((start, start + len(line)) for start, line in lines)
            own += [(start, x) for start, line in lines for x in self.match(line)]
            own += [(start, x) for start, line in spans if (h := BRIEFLY["heading"].fullmatch(line)) and (x := self.briefly(h, "heading"))]
            if (m.start(), m.end()) not in seen:
                own += [(m.start(), x) for x in self.match(block)]
        kept: list[dict] = []  # in order, none over another
        for start, x in sorted(own, key=lambda y: -(y[1]["end"] - y[1]["at"])):
            x = x | {"at": x["at"] + start, "end": x["end"] + start}
            i = bisect(kept, x["at"], key=lambda k: k["at"])
            if (i == 0 or kept[i - 1]["end"] <= x["at"]) and (i == len(kept) or x["end"] <= kept[i]["at"]):
                kept.insert(i, x)
        return kept


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


FOUND = "doc_id long, nth int, license string, template string, reduction double, wording double, missing int, inserted int, at long, end long"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("nth", pa.int32()), ("license", pa.string()), ("template", pa.string()), ("reduction", pa.float64()), ("wording", pa.float64()), ("missing", pa.int32()), ("inserted", pa.int32()), ("at", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per finding: its document, number, license, template, size reduction, wording (share, words missing and inserted) and place."""

    def run(batches):
        own = scanner()
        for batch in batches:
            rows = [{"doc_id": doc, "nth": n} | x for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) for n, x in enumerate(own.scan(text.as_py()))]
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, FOUND)
