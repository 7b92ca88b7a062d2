"""License scans: candidate blocks compressed with each template as a raw zstandard dictionary.

A block is a line with a license cue and the lines next to it that have one too. Cues are
taken from the templates: of each one so many of its words that no stretch can differ in
few words and have none of them, so no license is missed for want of a cue. Around
it, as many words as the longest template has are searched on either side, across blank
lines and lines without a cue, for every stretch that differs from a template in few
words; each such stretch is a confirmed license. Longer templates go first and stretches
share no word, so a notice inside a full text is not a license of its own. A template is
left out only where more of its words are missing than may differ. Blocks without a
confirmed license that speak of licensing are ranked: compressed alone and with each
template as dictionary, by how much smaller they get. Every text is scanned whole.

Defined results: null and empty texts have no blocks; a confirmed license comes back with
the stretch it stands in, a block that touches none unconfirmed with its best-ranked
template; ties go to the template that stands first; repeated rows give repeated results;
an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.memory import released

# Wordings of common licenses and notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
}
#: Blanks between a cue's words, or a line's end with the next one's comment mark.
GAP = r"\s+(?:[*#/;>-]+\s+)?"
CUE = re.compile(r"licen[sc]e|copyright|all rights reserved|permission is hereby|warrant(?:y|ies)|redistribut|spdx|creative commons|public domain|free software".replace(" ", GAP), re.IGNORECASE)
LEAD = 200  # characters that a block keeps of its line on either side of its cues
WORD = re.compile(r"\w+(?:[.-]\w+)*")


def cue_words(templates: dict[str, str], most_changed: float) -> set[str]:
    """Words, long ones first, of which each template has more than may be changed in it."""
    out = set()
    for t in templates.values():
        own = words(t)
        left = int(most_changed * len(own)) + 1
        for w in sorted(set(own), key=lambda w: (-len(w), w)):
            if left <= 0:
                break
            out.add(w)
            left -= own.count(w)
    return out


def blocks(text: str, cue: re.Pattern = CUE) -> list[tuple[int, int]]:
    """Spans around cues, by line: cues on one line or on neighbouring lines, with no more than 2 * LEAD between them, share a block."""
    out: list[list[int]] = []
    for m in cue.finditer(text):
        a, b = m.span()
        a = max(text.rfind("\n", 0, a) + 1, a - LEAD)
        end = text.find("\n", b)
        b = min(len(text) if end < 0 else end, b + LEAD)
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _rows(template: list[int], block: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Differences between the template and the stretches that end at each word of the block; ``row`` has those of the empty template."""
    steps = np.arange(len(block) + 1)
    for w in template:
        new = np.concatenate([[row[0] + 1], np.minimum(row[1:] + 1, row[:-1] + (block != w))])
        row = np.minimum.accumulate(new - steps) + steps
    return row


def _numbered(template: list[str], block: list[str]) -> tuple[list[int], np.ndarray]:
    ids: dict[str, int] = {}
    t = [ids.setdefault(w, len(ids)) for w in template]
    return t, np.array([ids.setdefault(w, len(ids)) for w in block], np.int64)


def wording_differences(template: list[str], block: list[str]) -> int:
    """Fewest words put in, left out or changed between the template and any stretch of the block."""
    t, b = _numbered(template, block)
    return int(_rows(t, b, np.zeros(len(b) + 1, np.int64)).min())


def stretches(template: list[str], block: list[str], free: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(first word, end, differences) of stretches of ``free`` words with at most ``most`` differences, best first; they are marked as taken."""
    t, b = _numbered(template, block)
    row = _rows(t, np.where(free, b, -1), np.zeros(len(b) + 1, np.int64))
    ends = np.flatnonzero(row <= most)
    out = []
    for e in ends[np.lexsort((ends, row[ends]))].tolist():
        a = max(0, e - len(t) - most)
        taken = np.flatnonzero(~free[a:e])
        back = b[a + taken[-1] + 1 if len(taken) else a : e][::-1]
        fits = _rows(t[::-1], back, np.arange(len(back) + 1))
        n = int(fits.argmin())
        if fits[n] <= most:
            out.append((e - n, e, int(fits[n])))
            free[e - n : e] = False
    return out


class Scanner:
    """Compressors for every template, made once for a task."""

    def __init__(self, templates: dict[str, str], level: int = 6, most_changed: float = 0.1):
        import zstandard

        self.names = list(templates)
        self.words = [words(t) for t in templates.values()]
        self.most = [int(most_changed * len(w)) for w in self.words]
        self.order = sorted(range(len(self.words)), key=lambda k: -len(self.words[k]))
        self.around = max((len(w) + m for w, m in zip(self.words, self.most)), default=0)
        self.cue = re.compile(rf"{CUE.pattern}|\b(?:{'|'.join(map(re.escape, sorted(cue_words(templates, most_changed), reverse=True)))})\b", re.IGNORECASE)
        plain = " ".join
        self.alone = zstandard.ZstdCompressor(level=level)
        self.with_template = [
            zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(plain(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for w in self.words
        ]

    def saved(self, own: list[str], k: int) -> float:
        """Share by which template ``k`` shrinks the words."""
        raw = " ".join(own).encode()
        size = len(self.alone.compress(raw))
        return (size - len(self.with_template[k].compress(raw))) / size

    def block(self, text: str) -> tuple[str, float, int, bool]:
        """(template, share by which it shrinks the block, words that differ, False) of the best-ranked template."""
        own = words(text)
        raw = " ".join(own).encode()
        size = len(self.alone.compress(raw))
        saved = [size - len(c.compress(raw)) for c in self.with_template]
        k = max(range(len(saved)), key=lambda k: (saved[k], -k))
        return self.names[k], saved[k] / size, wording_differences(self.words[k], own), False

    def confirmed(self, own: list[str]) -> list[tuple[int, int, int, int]]:
        """(first word, end, template, words that differ) of every license among these words."""
        found, there = [], set(own)
        for k in self.order:
            if sum(w not in there for w in self.words[k]) <= self.most[k]:
                found += [(a, b, k, d) for a, b, d in stretches(self.words[k], own, np.ones(len(own), bool), self.most[k])]
        # of licenses that are alike, the one with most words in common; a difference weighs as four
        out, free = [], np.ones(len(own), bool)
        for a, b, k, d in sorted(found, key=lambda x: (4 * x[3] - len(self.words[x[2]]), x[2], x[0])):
            if free[a:b].all():
                free[a:b] = False
                out.append((a, b, k, d))
        return out

    def text(self, text: str) -> list[tuple[int, int, str, float, int, bool]]:
        """(start, end, template, share by which it shrinks them, words that differ, confirmed) of licenses and of blocks without one."""
        found = blocks(text, self.cue)
        if not found:
            return []
        at = [m.span() for m in WORD.finditer(text)]
        starts, ends = np.array([a for a, _ in at], np.int64), np.array([b for _, b in at], np.int64)
        regions: list[list[int]] = []
        for a, b in found:
            lo = max(0, int(np.searchsorted(ends, a, side="right")) - self.around)
            hi = min(len(at), int(np.searchsorted(starts, b)) + self.around)
            if regions and lo <= regions[-1][1]:
                regions[-1][1] = max(hi, regions[-1][1])
            else:
                regions.append([lo, hi])
        out = []
        for lo, hi in regions:
            own = [text[a:b].lower() for a, b in at[lo:hi]]
            for a, b, k, d in self.confirmed(own):
                out.append((at[lo + a][0], at[lo + b - 1][1], self.names[k], self.saved(own[a:b], k), d, True))
        out.sort()
        k, rest = 0, []
        for a, b in found:
            while k < len(out) and out[k][1] <= a:
                k += 1
            if (k == len(out) or out[k][0] >= b) and CUE.search(text, a, b):
                rest.append((a, b, *self.block(text[a:b])))
        return sorted(out + rest)


SCHEMA = "doc_id bigint, start int, end int, license string, reduction double, differences int, confirmed boolean"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each license of each document and each candidate block without one; start and end in code points."""
    templates = templates or TEMPLATES

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(templates)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                rows += [(doc, *found) for found in scanner.text(text or "")]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(released(run), SCHEMA)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license of every document, and every candidate block without one."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
