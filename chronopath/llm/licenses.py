"""Licence scans by sentence rules: known sentences become identifiers, and ordered rules name licences."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from chronopath.llm.common import small_batches, texts

# Sentences of public licences, by identifier. Case, punctuation and line breaks don't count; <name> stands
# for a name of one to NAME_WORDS words.
SENTENCES = {
    "released-mit": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "This software is released under the MIT License", "Licensed under the MIT license"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of <name> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Neither the name of <name> may be used to endorse or promote products derived from this software without specific prior written permission", "The name of <name> may not be used to endorse or promote products derived from this software without specific prior written permission", "The names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-warranty": ["THIS SOFTWARE IS PROVIDED BY <name> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "released-bsd": ["Licensed under the BSD License", "Released under the BSD License"],
    "released-bsd3": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License"],
    "apache-short": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "This work is licensed under the Apache License, Version 2.0"],
    "apache-header": ["Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-comply": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "gpl-3-short": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0"],
    "gpl-2-short": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"],
    "gpl-free": ["<name> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-free": ["<name> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl-warranty": ["<name> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "lgpl3-short": ["Licensed under the GNU Lesser General Public License, version 3"],
    "lgpl21-short": ["Licensed under the GNU Lesser General Public License, version 2.1"],
    "lgpl21-free": ["<name> is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-free": ["<name> is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl3-free": ["<name> is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-only": ["<name> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "<name> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License", "<name> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation"],
    "gpl3-only": ["<name> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License", "<name> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"],
    "apache-title": ["Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "agpl3-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "mpl-title": ["Mozilla Public License Version 2.0"],
    "boost-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "epl-header": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "artistic-grant": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "postgres-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "agpl-short": ["Licensed under the GNU Affero General Public License, version 3"],
    "mpl-header": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "This work is licensed under CC0 1.0", "Licensed under CC0 1.0"],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "boost-header": ["Distributed under the Boost Software License, Version 1.0"],
    "wtfpl": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"],
    "all-rights": ["All rights reserved"],
}
# Ordered rules. The longest one that matches from a sentence on wins; its sentences may have up to GAP
# other known ones between them.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")), ("MIT", ("mit-grant", "mit-notice")), ("MIT", ("mit-grant",)), ("MIT", ("released-mit",)), ("ISC", ("isc-grant", "isc-warranty")), ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")), ("BSD", ("released-bsd",)), ("BSD-3-Clause", ("released-bsd3",)), ("BSD", ("bsd-grant",)),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-copy", "apache-asis")), ("Apache-2.0", ("apache-header", "apache-comply")), ("Apache-2.0", ("apache-header",)), ("Apache-2.0", ("apache-short",)),
    ("GPL-3.0", ("gpl3-title",)), ("GPL-2.0", ("gpl2-title",)), ("LGPL-3.0", ("lgpl3-title",)), ("LGPL-2.1", ("lgpl21-title",)), ("AGPL-3.0", ("agpl3-title",)), ("MPL-2.0", ("mpl-title",)), ("BSL-1.0", ("boost-title",)), ("Apache-2.0", ("apache-title",)), ("GPL-2.0", ("gpl2-only", "gpl-warranty")), ("GPL-2.0", ("gpl2-only",)), ("GPL-3.0", ("gpl3-only", "gpl-warranty")), ("GPL-3.0", ("gpl3-only",)), ("GPL-3.0", ("gpl-3-short",)), ("GPL-2.0", ("gpl-2-short",)), ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty")), ("GPL-3.0-or-later", ("gpl-free",)), ("GPL-2.0-or-later", ("gpl2-free", "gpl-warranty")), ("GPL-2.0-or-later", ("gpl2-free",)),
    ("LGPL-3.0", ("lgpl3-short",)), ("LGPL-2.1", ("lgpl21-short",)), ("LGPL-2.1-or-later", ("lgpl21-free", "gpl-warranty")), ("LGPL-2.1-or-later", ("lgpl21-free",)), ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-warranty")), ("LGPL-3.0-or-later", ("lgpl3-free",)), ("AGPL-3.0", ("agpl-short",)), ("AGPL-3.0-or-later", ("agpl3-free", "gpl-warranty")), ("AGPL-3.0-or-later", ("agpl3-free",)), ("EPL-2.0", ("epl-header",)), ("PostgreSQL", ("postgres-grant",)), ("0BSD", ("0bsd-grant",)), ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")), ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert")), ("MPL-2.0", ("mpl-header", "mpl-copy")), ("MPL-2.0", ("mpl-header",)), ("Unlicense", ("unlicense",)), ("CC0-1.0", ("cc0",)), ("Zlib", ("zlib-warranty", "zlib-grant")), ("BSL-1.0", ("boost-header",)), ("WTFPL", ("wtfpl",)),
]
GAP = 2
# Licences that are told by a clause that is missing: no unknown sentence may stand inside the match or right after it.
STRICT = {"BSD-2-Clause"}
NAME_WORDS = 12
# One of these is in every sentence with a name in it, normalised.
NAMED_WORDS = ("to endorse or promote", "software is provided by", "is free software", "is distributed in the hope")
# Every sentence that can be identified holds one of these or of _SPREAD, in lower case.
TRIGGERS = ("licen", "warrant", "copyright", "permission", "permitted", "redistribut", "public domain", "liable", "rights reserved", "mozilla", "mpl", "endorse", "verbatim", "spdx", "gpl", "advertising", "creativecommons", "creative commons")
# Names of licences, normalised and without "license" at the end, as a notice may name them.
NAMES = {
    "mit": "MIT", "expat": "MIT", "isc": "ISC", "bsd": "BSD", "bsd 2 clause": "BSD-2-Clause", "2 clause bsd": "BSD-2-Clause", "simplified bsd": "BSD-2-Clause", "bsd 3 clause": "BSD-3-Clause", "3 clause bsd": "BSD-3-Clause", "new bsd": "BSD-3-Clause", "modified bsd": "BSD-3-Clause",
    "apache": "Apache", "apache 2 0": "Apache-2.0", "apache version 2 0": "Apache-2.0", "apache license version 2 0": "Apache-2.0", "apache license 2 0": "Apache-2.0", "apache license": "Apache",
    "gnu general public": "GPL", "gnu gpl": "GPL", "gpl": "GPL", "gplv2": "GPL-2.0", "gpl v2": "GPL-2.0", "gpl 2 0": "GPL-2.0", "gplv3": "GPL-3.0", "gpl v3": "GPL-3.0", "gpl 3 0": "GPL-3.0", "gnu gplv2": "GPL-2.0", "gnu gplv3": "GPL-3.0", "gnu gpl v3": "GPL-3.0", "gnu gpl v2": "GPL-2.0",
    "gnu general public license version 2": "GPL-2.0", "gnu general public license version 3": "GPL-3.0", "gnu general public license v2 0": "GPL-2.0", "gnu general public license v3 0": "GPL-3.0", "gnu general public license v2": "GPL-2.0", "gnu general public license v3": "GPL-3.0", "gnu general public license": "GPL",
    "lgpl": "LGPL", "lgplv2 1": "LGPL-2.1", "lgpl 2 1": "LGPL-2.1", "lgplv3": "LGPL-3.0", "lgpl 3 0": "LGPL-3.0", "gnu lgpl": "LGPL", "gnu lesser general public license version 2 1": "LGPL-2.1", "gnu lesser general public license version 3": "LGPL-3.0", "gnu lesser general public license v2 1": "LGPL-2.1", "gnu lesser general public license v3 0": "LGPL-3.0", "gnu lesser general public": "LGPL",
    "agpl": "AGPL", "agplv3": "AGPL-3.0", "agpl 3 0": "AGPL-3.0", "gnu agplv3": "AGPL-3.0", "gnu affero general public license version 3": "AGPL-3.0", "gnu affero general public license v3 0": "AGPL-3.0", "gnu affero general public": "AGPL",
    "mozilla public license 2 0": "MPL-2.0", "mozilla public license version 2 0": "MPL-2.0", "mozilla public": "MPL", "mpl 2 0": "MPL-2.0", "eclipse public license 2 0": "EPL-2.0", "eclipse public license 1 0": "EPL-1.0", "boost software license 1 0": "BSL-1.0", "boost software license version 1 0": "BSL-1.0", "boost software": "BSL-1.0",
    "zlib": "Zlib", "unlicense": "Unlicense", "artistic license 2 0": "Artistic-2.0", "postgresql": "PostgreSQL", "wtfpl": "WTFPL", "zero clause bsd": "0BSD",
}
_NAMED = re.compile(r"(?:(?:this|the) (?:[a-z]+ ){1,3}(?:is|are) |it is |all code is )?(?:dual )?(?:licensed|released|distributed|available|published|provided|covered)(?: to you)? (?:under|by) (?:the terms of )?(?:the |a |an )?(.+?)(?: license)?")
_CC = re.compile(r"(?:this work is |this text is )?(?:licensed|released|distributed|available) under (?:the |a )?(?:creative commons |cc )(by(?: nc)?(?: sa| nd)?|attribution(?: noncommercial)?(?: sharealike| noderivatives)?) ?(?:license )?([1-4] 0)?(?: international)?(?: license)?")
# Words of a trigger can stand on different lines; the forms of _CC need no other trigger.
_SPREAD = re.compile(r"(?:public[^\w+]+domain|rights[^\w+]+reserved|creative[^\w+]+commons|under[^\w+]+(?:(?:the|a)[^\w+]+)?cc)(?![\w+])")
_RARE = ("domain", "reserved", "commons", "cc")
_SPDX = re.compile(r"spdx license identifier (.+)")
_STOP = re.compile(r"(?:[.!?]|(?<!dentifier):)(?=\s|$)|\n\s*\n")
_WORD = re.compile(r"[^\w+]+")
_TOKEN = re.compile(r"[\w+]+")
_WORDS = {"attribution": "by", "noncommercial": "nc", "sharealike": "sa", "noderivatives": "nd"}


def normalise(sentence: str) -> str:
    return _WORD.sub(" ", sentence.lower().replace("licence", "license")).strip()


def _parts(sentence: str) -> list[str]:
    return [normalise(p) for p in sentence.split("<name>")]


@cache
def known() -> dict[str, str]:
    return {normalise(s): i for i, many in SENTENCES.items() for s in many if "<name>" not in s}


@cache
def named() -> list[tuple[re.Pattern, str]]:
    """Sentences with a name in them, as patterns of normalised text."""
    some = rf"(?:[\w+]+ ){{0,{NAME_WORDS - 1}}}?[\w+]+"
    with_name = [(" * ".join(_parts(s)).split(), i) for i, many in SENTENCES.items() for s in many if "<name>" in s]
    return [(re.compile(" ".join((f"({some})" if not k else some) if w == "*" else re.escape(w) for k, w in enumerate(words)) + ("" if words[0] == "*" else "()")), i) for words, i in with_name]


@cache
def longest() -> int:
    return max(len(normalise(s)) for many in SENTENCES.values() for s in many) + 8 * NAME_WORDS


@cache
def tree() -> dict:
    """Known sentences word by word; the key "" marks the end of one, "*" stands for a name."""
    root: dict = {}
    for s in (s for many in SENTENCES.values() for s in many):
        node = root
        for w in " * ".join(_parts(s)).split():
            node = node.setdefault(w, {})
        node[""] = {}
    return root


class Walk:
    """Where the words so far can be in the tree: names make several places possible, each with the words they have left."""

    def __init__(self):
        self.at: list[tuple[dict, int]] = [(tree(), 0)]

    def step(self, word: str, new_line: bool) -> None:
        first, out = tree().get("*"), []
        for node, name in self.at:
            if name:  # inside a name: it may go on (one at the start only on its line), or the word after it has come
                if name > 1 and not (new_line and node is first):
                    out.append((node, name - 1))
                if (n := node.get(word)) is not None:
                    out.append((n, 0))
                continue
            if (n := node.get(word)) is not None:
                out.append((n, 0))
            if (n := node.get("*")) is not None:
                out.append((n, NAME_WORDS))
        self.at = out

    def ended(self) -> bool:
        return any("" in node and not name for node, name in self.at)


def ends(text: str, low: str) -> list[int]:
    """Where sentences end: at each stop, save those inside a known sentence, which begins and ends one of its own.

    A known sentence may hold stops ("free software: you can", "v. 2.0"). It counts from the start of a sentence or
    line to the end of one.
    """
    stops = [m.end() for m in _STOP.finditer(text)]
    edges = sorted({0, *stops, *(m.end() for m in re.finditer("\n", text)), len(text)})
    out, took, upto = [], 0, 0
    for start, nxt in zip(edges, edges[1:], strict=False):
        if start < upto:
            continue
        walk, last, hit = Walk(), 0, None
        for m in _TOKEN.finditer(low, start):
            if last == 0 and m.start() >= nxt:
                break
            if walk.ended() and edges[bisect_right(edges, last)] <= m.start():
                hit = last
            walk.step(m[0].replace("licence", "license"), "\n" in low[last : m.start()] if last else False)
            if not walk.at:
                break
            last = m.end()
        else:
            if walk.ended():
                hit = last
        at = bisect_right(stops, start)
        if hit is None or at == len(stops) or stops[at] >= hit:
            continue
        out += stops[took:at]
        took = bisect_left(stops, hit)
        upto = edges[bisect_left(edges, hit)]
        out += [start, upto]
    return sorted({*out, *stops[took:], len(text)} - {0})


def triggered(low: str) -> bool:
    """Whether a text in lower case holds a trigger."""
    return any(t in low for t in TRIGGERS) or (any(t in low for t in _RARE) and _SPREAD.search(low) is not None)


def identify(sentence: str) -> str | None:
    """Identifier of a sentence: a known one, or ``cc:``, ``spdx:`` and ``name:`` with what they name."""
    n = normalise(sentence)
    if i := known().get(n):
        return i
    if len(n) <= longest() and any(w in n for w in NAMED_WORDS):
        for pattern, i in named():
            if (m := pattern.fullmatch(n)) and (not m[1] or len(m[1].split()) <= len(normalise(sentence.strip().split("\n", 1)[0]).split())):
                return i  # a name at the start keeps to its line
    if m := _CC.fullmatch(n):
        parts = [_WORDS.get(w, w) for w in m[1].split()]
        return "cc:" + "-".join(["CC", *(p.upper() for p in parts), *([m[2].replace(" ", ".")] if m[2] else [])])
    if m := _SPDX.fullmatch(n):
        return "spdx:" + sentence.split(":", 1)[-1].strip(" */#\t\n.")
    if (m := _NAMED.fullmatch(n)) and m[1] in NAMES:
        return "name:" + NAMES[m[1]]
    return None


def sentences(text: str) -> Iterator[tuple[int, int, str | None]]:
    """(start, end, identifier) of the sentences that hold a trigger; None where a sentence isn't known.

    A sentence ends with a stop before white space or with an empty line, unless that is inside a known one. Where its
    lines aren't known together, known runs of whole lines in it count, longest first.
    """
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case; offsets stay those of the text
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not triggered(low):
        return
    at = 0
    for end in ends(text, low):
        start, at = at, end
        if start == end or not triggered(low[start:end]):
            continue
        if i := identify(text[start:end]):
            yield start, end, i
            continue
        # Lines that hold words; how long they are is counted after normalising, so blanks and marks don't matter.
        cuts = [start, *(start + m.end() for m in re.finditer("\n", text[start:end])), end]
        lines = [(a, b, n) for a, b in zip(cuts, cuts[1:], strict=False) if (n := len(normalise(text[a:b])))]
        k, any_known = 0, False
        while k < len(lines):
            size, held = 1, lines[k][2]
            while k + size < len(lines) and held + 1 + lines[k + size][2] <= longest():
                held += 1 + lines[k + size][2]
                size += 1
            hit = next(((m, i) for m in range(size, 0, -1) if (i := identify(text[lines[k][0] : lines[k + m - 1][1]]))), None)
            if hit:
                yield lines[k][0], lines[k + hit[0] - 1][1], hit[1]
                any_known = True
            k += hit[0] if hit else 1
        if not any_known:
            yield start, end, None


@cache
def rules_from(first: str) -> list[tuple[str, tuple[str, ...]]]:
    """Rules that begin with a sentence, the longest first."""
    return sorted((r for r in RULES if r[1][0] == first), key=lambda r: -len(r[1]))


def _interrupted(ids: list, unknown: list[int], k: int, at: int) -> bool:
    """Whether an unknown sentence stands between the first and last of a match, or between it and the next known one
    where the match doesn't end with the warranty."""
    last = ids[at + 1][0] if at + 1 < len(ids) and ids[at][2] != "bsd-warranty" else ids[at][0] if ids[at][2] == "bsd-warranty" else float("inf")
    first = bisect_left(unknown, ids[k][0])
    return first < len(unknown) and unknown[first] < last


def recognise(found: list[tuple[int, int, str | None]]) -> list[tuple[str, int, int]]:
    """Licences that ordered rules find in a text's identified sentences: (licence, start, end)."""
    ids = [(s, e, i) for s, e, i in found if i]
    unknown = [s for s, _, i in found if not i]
    out, k = [], 0
    while k < len(ids):
        s, e, i = ids[k]
        best = None
        if i.startswith(("cc:", "spdx:", "name:")):
            best = i.split(":", 1)[1], k
        else:
            for name, rule in rules_from(i):
                at = k
                for step, want in enumerate(rule):
                    if not step and ids[k][2] == want:
                        continue
                    nxt = next((j for j in range(at + 1, min(at + 2 + GAP, len(ids))) if ids[j][2] == want), None) if step else None
                    if nxt is None:
                        at = None
                        break
                    at = nxt
                if at is not None and not (name in STRICT and _interrupted(ids, unknown, k, at)):
                    best = name, at
                    break
        if best:
            out.append((best[0], s, ids[best[1]][1]))
            k = best[1] + 1
        else:
            k += 1
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        names, known_n, unknown_n, spans = [], [], [], []
        for t in texts(b):
            found = list(sentences(t))
            hits = recognise(found)
            names.append(sorted({h[0] for h in hits}))
            known_n.append(sum(i is not None for _, _, i in found))
            unknown_n.append(len(found) - known_n[-1])
            spans.append([{"license": n, "start": s, "end": e} for n, s, e in hits])
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "licenses": pa.array(names, pa.list_(pa.string())), "n_known": pa.array(known_n, pa.int64()), "n_unknown": pa.array(unknown_n, pa.int64()), "spans": pa.array(spans, span)})


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``(doc_id, licenses, n_known, n_unknown, spans)`` of each row of ``docs(doc_id, text)``.

    licenses: distinct names in order; n_known and n_unknown count the sentences with licence words that have an
    identifier and that don't; spans are character ranges of each find. Whole texts are read; null and empty ones hold
    nothing; other columns are ignored; a null doc_id keeps its row, and repeated rows are each scanned. A task holds one
    text at a time, however long. No shuffle.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, "doc_id long, licenses array<string>, n_known long, n_unknown long, spans array<struct<license: string, start: long, end: long>>")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).selectExpr("doc_id", "concat_ws(',', licenses) as licenses", "cast(size(licenses) as long) as n_licenses", "n_known", "n_unknown")
