"""License scan by conditional compression and exact differences of wording."""
from __future__ import annotations

import re
from bisect import bisect_left, insort
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

# Names of licenses as notices write them, and the opening words of published texts and headers.
NAMES = {
    "MIT": ("MIT License", "MIT license"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "MPL 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License"),
    "ISC": ("ISC License", "ISC license"),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
}
NOTICES = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.")
_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
          "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
          "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met")
_BSD_2 = (f"{_BSD}: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
          "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
          "documentation and/or other materials provided with the distribution.")
_BSD_3 = (f"{_BSD_2} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
          "from this software without specific prior written permission.")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
            "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")


def _gnu(name: str, version: str) -> tuple[str, str]:
    """The part of a header that names the license, and the whole header."""
    part = f"under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or"
    return part, (f"This program is free software: you can redistribute it and/or modify it {part} (at your option) any later version. This program is "
                  "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
                  f"FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.")


TEXTS = {
    "MIT": (f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software.",),
    "MIT-0": (f"{_GRANT}. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
              "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",),
    "MIT-family": (_GRANT,),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies.",),
    "Apache-2.0": ("you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
                   "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                   "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "BSD-2-Clause": (f"{_BSD_2} {_BSD_END}",),
    "BSD-3-Clause": (f"{_BSD_3} {_BSD_END}", _BSD_3),
    "BSD-family": (_BSD,),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "GPL-2.0": _gnu("General Public License", "2"),
    "GPL-3.0": _gnu("General Public License", "3"),
    "LGPL-2.0": _gnu("Library General Public License", "2"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "CC0-1.0": ("The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the "
                "work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",),
    "all-rights-reserved": ("All rights reserved.",),
}
#: Opening words that several licenses share: they count only where no whole text of one is found.
FAMILIES = frozenset(("MIT-family", "BSD-family"))
#: Words that name a license; no change may touch them, nor a version where the wording has one.
_NAMING = frozenset("gnu gpl lgpl agpl general lesser library affero mozilla mpl apache bsd mit isc creative commons zero cc cc0 noncommercial sharealike "
                    "attribution-sharealike attribution-noncommercial attribution-noderivatives attribution-noncommercial-sharealike".split())
_VERSION = re.compile(r"v?\d+(?:\.\d+)*")
TRIGGER = re.compile(r"licen[sc]e|\bGPL\b|\bMPL\b|\bCC0\b|\bCC BY|creative commons|permission|redistribut|source code form|rights reserved|public domain", re.IGNORECASE)
_HINTS = ("licen", "gpl", "mpl", "cc0", "cc by", "creative commons", "permission", "redistribut", "source code form", "rights reserved", "public domain")
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

#: Words on either side of a trigger that its block takes in at least, and the share of changed words that may be left.
AROUND, CHANGED = 30, 0.1


@dataclass(frozen=True)
class Template:
    license: str
    words: tuple[str, ...]
    text: str
    changes: int
    compressor: zstandard.ZstdCompressor


@lru_cache(maxsize=1)
def templates() -> tuple[tuple[Template, ...], zstandard.ZstdCompressor]:
    """Every different wording with a compressor that knows it, and one that knows nothing."""
    params = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    wordings = [(k, n.format(name)) for k, names in NAMES.items() for name in names for n in NOTICES]
    wordings += [(k, text) for k, texts in TEXTS.items() for text in texts]
    out = []
    for license_, words in dict.fromkeys((k, tuple(w.lower() for w in _WORD.findall(text))) for k, text in wordings):
        known = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=params["level"])
        out.append(Template(license_, words, f" {' '.join(words)} ", int(CHANGED * len(words)), zstandard.ZstdCompressor(dict_data=known, **params)))
    return tuple(out), zstandard.ZstdCompressor(**params)


def blocks(text: str) -> list[tuple[list[re.Match], int, int]]:
    """(words of the text, first, end) of the blocks around triggers; a text without a trigger has none."""
    low = text.lower()                                            # far quicker than the pattern, and true wherever that is
    hits = [m.start() for m in TRIGGER.finditer(text)] if any(h in low for h in _HINTS) else []
    if not hits:
        return []
    words = list(_WORD.finditer(text))
    around = max(AROUND, *(len(t.words) + t.changes for t in templates()[0]))
    at, spans = 0, []
    for hit in hits:
        while at < len(words) and words[at].end() <= hit:
            at += 1
        first, last = max(0, at - around), min(len(words), at + around)
        if spans and first <= spans[-1][1]:
            spans[-1][1] = last
        else:
            spans.append([first, last])
    return [(words, first, last) for first, last in spans]


def exact(block: str, template: Template) -> list[tuple[int, int, int]]:
    """(0, first, end) of every place of a block, words with a space on either side, that has the wording as it is."""
    out, at, first, before = [], block.find(template.text), 0, 0
    while at >= 0:
        first, before = first + block.count(" ", before, at), at
        out.append((0, first, first + len(template.words)))
        at = block.find(template.text, at + len(template.text) - 1)
    return out


def put(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Add a place to others in order unless it overlaps one; if it was added."""
    i = bisect_left(taken, (end,))
    free = i == 0 or taken[i - 1][1] <= start
    if free:
        insort(taken, (start, end))
    return free


def near(numbers: np.ndarray, wording: np.ndarray, changes: int) -> list[tuple[int, int, int]]:
    """(changed words, first, end) of all separate places with few changes: words left out, put in or replaced.

    One row of edit distances per word of the wording; each distance carries the last first word that reaches it.
    """
    n = len(numbers)
    unit, place = n + 1, np.arange(n + 1, dtype=np.int64)
    best, step = n - place, place * unit                          # a place may begin anywhere
    for word in wording:
        row = best + unit                                         # the word is left out
        np.minimum(row[1:], best[:-1] + unit * (numbers != word), out=row[1:])
        best = np.minimum.accumulate(row - step) + step           # words are put in
    changed, first = best // unit, n - best % unit
    out: list[tuple[int, int, int]] = []
    spans: list[tuple[int, int]] = []
    for c, end, start in sorted((int(changed[e]), int(e), int(first[e])) for e in np.flatnonzero(changed <= changes)):
        if start < end and put(spans, start, end):
            out.append((c, start, end))
    bounds = [0, *(b for span in spans for b in span), n]
    for low, high in zip(bounds[::2], bounds[1::2]):              # what is left between them may hold shorter places
        if out and high - low >= len(wording) - changes and high > low:
            out += [(c, low + s, low + e) for c, s, e in near(numbers[low:high], wording, changes)]
    return out


def naming(words: tuple[str, ...] | list[str], versions: bool) -> list[str]:
    return [w for w in words if w in _NAMING or versions and _VERSION.fullmatch(w)]


def ranked(raw: bytes) -> list[tuple[int, list[Template]]]:
    """(thousandths saved, templates of a license) by the template that makes the block smallest; most is saved first."""
    every, plain = templates()
    alone = len(plain.compress(raw))
    best: dict[str, tuple[int, list[Template]]] = {}
    for t in every:
        saving = alone - len(t.compressor.compress(raw))
        most, own = best.get(t.license, (saving, []))
        best[t.license] = (max(most, saving), [*own, t])
    order = sorted(best, key=lambda k: (-best[k][0], k))
    return [(round(1000 * best[k][0] / alone), best[k][1]) for k in order]


def scan_text(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, license, changed words, size reduction in thousandths) of every confirmed place, in order.

    The licenses of a block are ranked by how much smaller it gets when the compressor knows their templates. Down the
    ranking, each is confirmed by its wordings: as they are, and with few changed words where enough of them are in the
    block at all; a change that touches name or version is none. A place goes to the first license of the ranking that
    is confirmed there, to its wording of fewest changes, then the longest. All have their turn, so a wording that is
    there word for word is lost only to one that saves more.
    """
    taken: list[tuple[int, int, str, int, int]] = []
    for words, low, high in blocks(text):
        own = [w[0].lower() for w in words[low:high]]
        joined, there = f" {' '.join(own)} ", set(own)
        number: dict[str, int] = {}
        numbers = np.array([number.setdefault(w, len(number)) for w in own])
        spans: list[tuple[int, int]] = []
        for saving, wordings in ranked(joined.strip().encode()):
            places = []
            for t in wordings:
                places += exact(joined, t)
                if t.changes and sum(w not in there for w in t.words) <= t.changes:
                    versions = any(map(_VERSION.fullmatch, t.words))
                    places += [p for p in near(numbers, np.array([number.get(w, -1) for w in t.words]), t.changes)
                               if naming(own[p[1]:p[2]], versions) == naming(t.words, versions)]
            for changed, first, end in sorted(places, key=lambda p: (p[0], p[1] - p[2], p[1])):
                if put(spans, first, end):
                    taken.append((words[low + first].start(), words[low + end - 1].end(), wordings[0].license, changed, saving))
    return sorted(taken)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_found, licenses, spans) of every document: licenses in alphabetic order, spans license:start:end:changes.

    Null and empty texts have none, long texts are scanned whole; repeated rows repeat, an empty table gives no rows, and
    other columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [scan_text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(sorted({s[2] for s in f})) for f in found], pa.string()),
                 pa.array([",".join(f"{s[2]}:{s[0]}:{s[1]}:{s[3]}" for s in f) for f in found], pa.string())], names=["key", "n_found", "licenses", "spans"])
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_found long, licenses string, spans string")
