"""License scans by conditional compression.

Runs of lines that are worded like a licence or hold a cue are candidate blocks. A block is compressed alone and with
each template as a raw zstandard dictionary; the templates that save most are aligned with the part of it they fit best,
word by word, and the one that explains most words is confirmed if few enough words differ. What lies before
and after that part is searched again, so neighbouring words reject nothing and a block gives all its notices.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from fitlake.llm import common as K



def _gnu(name: str, version: str, mark: str, work: str, modify: str, ending: str) -> list[str]:
    """File notice of a GNU licence: first paragraph, first two, and all three."""
    first = (f"{work} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU "
             f"{name} as published by the Free Software Foundation{modify} either version {version} of the License, "
             "or (at your option) any later version.")
    second = (f" {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
              "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
              f"{name} for more details.")
    third = (f" You should have received a copy of the GNU {name} along with {work.lower()}{ending}")
    return [first, first + second, first + second + third]


_SEE = ". If not, see <https://www.gnu.org/licenses/>."
_WRITE = ("; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA "
          "02110-1301 USA.")
_AS_IS = (" THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
          "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
          "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
          "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
          "THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce "
        "the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.")
_BSD_NAME = (" Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
             "promote products derived from this software without specific prior written permission.")
_BSD_END = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
            "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
            "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
            "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
            "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
            "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
# fixed values: wording of public licences and their usual notices, abridged and whole
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
        *_gnu("General Public License", "3", ":", "This program", ",", _SEE)[1:]],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version.",
        *_gnu("General Public License", "2", ";", "This program", ";", _WRITE)[1:],
        _gnu("General Public License", "2", ";", "This program", ";", _SEE)[2]],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.",
                 *_gnu("Lesser General Public License", "3", ":", "This program", ",", _SEE),
                 *_gnu("Lesser General Public License", "3", ":", "This library", ",", _SEE)],
    "LGPL-2.1": [*_gnu("Lesser General Public License", "2.1", ";", "This library", ";", _WRITE),
                 _gnu("Lesser General Public License", "2.1", ";", "This library", ";", _SEE)[2]],
    "AGPL-3.0": _gnu("Affero General Public License", "3", ":", "This program", ",", _SEE),
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer.",
        _BSD + _BSD_NAME + _BSD_END],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD + _BSD_END],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
        "copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law." +
        _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + " For more information, please refer to <https://unlicense.org>"],
}
TEMPLATES["0BSD"] = [TEMPLATES["ISC"][2].replace(
    ", provided that the above copyright notice and this permission notice appear in all copies", "")]
TEMPLATES["MIT"].append(TEMPLATES["MIT"][1] + _AS_IS)
# fixed values: words that make a line worth a look
CUES = (b"licen", b"copyright", b"permission", b"redistribut", b"public domain", b"cc by", b"creative commons",
        b"warrant", b"mozilla public", b"cc0")
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
#: Share of a line's words that must be words of a template; blank lines do not end a block, nor do a few others.
WORDED, BRIDGED = 0.6, 2
#: Words of a line that are looked at together; longer lines are taken in pieces.
PIECE_WORDS = 30
ADDED_DDL = ("block int, start long, end long, license string, template int, ranked array<string>, "
             "reduction double, missing array<string>, extra array<string>, exact boolean")
ADDED = ("block", "start", "end", "license", "template", "ranked", "reduction", "missing", "extra", "exact")


def words_of(text: str) -> list[str]:
    """Words, lower-cased; a version number such as 2.0 is one word."""
    return _WORD.findall(text.lower())


def _costs(template: np.ndarray, own: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Rows of the table of words missing or extra; ``begin`` is its first row."""
    at = np.arange(len(own) + 1, dtype=np.int32)
    rows = [begin.astype(np.int32)]
    for word in template:
        row = rows[-1] + 1
        row[1:] = np.minimum(row[1:], np.where(own == word, rows[-1][:-1], row[1:]))
        rows.append(np.minimum.accumulate(row - at) + at)
    return rows


def fitted(template: np.ndarray, own: np.ndarray) -> tuple[int, int, int]:
    """Differing words, begin and end of the part of ``own`` that the template fits best."""
    last = _costs(template, own, np.zeros(len(own) + 1))[-1]
    end = int(last.argmin())
    back = _costs(template[::-1], own[:end][::-1], np.arange(end + 1))[-1]
    return int(last[end]), end - int(back.argmin()), end


def differences(template: np.ndarray, own: np.ndarray) -> tuple[list[int], list[int]]:
    """Places of the missing words in the template and of the extra ones in ``own``."""
    rows = _costs(template, own, np.arange(len(own) + 1))
    missing, extra = [], []
    i, j = len(template), len(own)
    while i or j:
        if i and j and template[i - 1] == own[j - 1] and rows[i][j] == rows[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
            missing.append(i)
        else:
            j -= 1
            extra.append(j)
    return missing[::-1], extra[::-1]


class Scanner:
    """Templates with their dictionaries, built once in a worker."""

    def __init__(self, templates: dict[str, list[str]], tried: int, differing: float):
        self.tried, self.differing = tried, differing
        self.plain = zstandard.ZstdCompressor(level=19, write_checksum=False, write_content_size=False)
        self.known: dict[str, int] = {}
        self.templates = []
        for name, texts in templates.items():
            for number, text in enumerate(texts):
                kind = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                packer = zstandard.ZstdCompressor(level=19, dict_data=kind, write_checksum=False,
                                                  write_content_size=False, write_dict_id=False)
                words = words_of(text)
                ids = np.array([self.known.setdefault(w, len(self.known)) for w in words], np.int64)
                self.templates.append((name, number, words, packer, ids))
        self.counts = np.array([np.bincount(t[4], minlength=len(self.known)) for t in self.templates])
        self.allowed = np.array([int(differing * len(t[2])) for t in self.templates])

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Runs of lines worded like a licence, with a cue, as places in the text.

        A line with a cue takes part whatever its other words, and a run holds the line before and after it.
        """
        units, at = [], 0
        for line in text.split("\n"):
            found = list(_WORD.finditer(line))
            for i in range(0, len(found), PIECE_WORDS):
                piece = found[i:i + PIECE_WORDS]
                begin = at + (piece[0].start() if i else 0)
                end = at + (piece[-1].end() if i + PIECE_WORDS < len(found) else len(line))
                cue = self._cued(text[begin:end])
                known = sum(m.group().lower() in self.known for m in piece)
                units.append((begin, end, cue, cue or known >= WORDED * len(piece)))
            at += len(line) + 1
        runs, first, last, cue = [], None, None, False
        for i, (_, _, cued, worded) in enumerate(units):
            if not worded:
                continue
            if first is not None and i - last > BRIDGED + 1:
                runs.append((first, last, cue))
                first, cue = None, False
            first, last, cue = i if first is None else first, i, cue or cued
        if first is not None:
            runs.append((first, last, cue))
        out: list[tuple[int, int]] = []
        for first, last, cue in runs:
            if cue:
                begin, end = units[max(0, first - 1)][0], units[min(len(units) - 1, last + 1)][1]
                if out and begin <= out[-1][1]:
                    begin, end = out.pop()[0], end
                out.append((begin, end))
        return out

    @staticmethod
    def _cued(line: str) -> bool:
        low = line.lower().encode()
        return any(c in low for c in CUES)

    @staticmethod
    def _runs_on(block: str, spans: list, own: np.ndarray, at: int) -> bool:
        """Whether only blanks part the word from one before it that no template has."""
        if not at or own[at - 1] >= 0:
            return False
        between = block[spans[at - 1].end():spans[at].start()]
        return "\n" not in between and between.isspace()

    def _saved(self, block: str, some) -> list[tuple[float, int]]:
        """Share of the compressed size that templates save, the largest first."""
        raw = block.encode()
        alone = len(self.plain.compress(raw))
        return sorted(((alone - len(self.templates[i][3].compress(raw))) / alone, -i) for i in some)[::-1]

    def best(self, block: str) -> dict | None:
        """The confirmed template of a block, with the ranking and the wording differences."""
        found = self.found(block)
        return max(found, key=lambda f: f["end"] - f["start"]) if found else None

    def found(self, block: str) -> list[dict]:
        """All confirmed templates of a block in order, each with its place, the ranking and the differences."""
        spans = list(_WORD.finditer(block))
        own = np.array([self.known.get(m.group().lower(), -1) for m in spans], np.int64)
        out, todo = [], [(0, len(spans))]
        while todo:
            begin, end = todo.pop()
            if (part := self._fit(block, spans, own, begin, end)) is None:
                continue
            i, a, b = part
            todo += [(begin, a), (b, end)]
            name, number, words, _, ids = self.templates[i]
            start, stop = spans[a].start(), spans[b - 1].end()
            while stop < len(block) and not block[stop].isspace() and not block[stop].isalnum():
                stop += 1  # punctuation belongs to the last word
            saved = self._saved(block[start:stop], range(len(self.templates)))
            missing, extra = differences(ids, own[a:b])
            out.append({"start": start, "end": stop, "license": name, "template": number,
                        "ranked": [self.templates[-j][0] for _, j in saved[:self.tried]],
                        "reduction": next(gain for gain, j in saved if -j == i),
                        "missing": [words[j] for j in missing],
                        "extra": [spans[a + j].group().lower() for j in extra],
                        "exact": not missing and not extra})
        return sorted(out, key=lambda f: f["start"])

    def _fit(self, block: str, spans: list, own: np.ndarray, begin: int, end: int) -> tuple[int, int, int] | None:
        """Template and words of the part of words begin to end that is confirmed and explains most."""
        part = own[begin:end]
        there = np.bincount(part[part >= 0], minlength=len(self.known))
        # no alignment can miss fewer words than are lacking altogether
        some = np.flatnonzero(np.maximum(self.counts - there, 0).sum(axis=1) <= self.allowed)
        if not len(some):
            return None
        saved = self._saved(block[spans[begin].start():spans[end - 1].end()], some.tolist())
        for at in range(0, len(saved), self.tried):
            best = None
            for _, i in saved[at:at + self.tried]:
                ids, allowed = self.templates[-i][4], self.allowed[-i]
                off, a, b = fitted(ids, part)
                while off <= allowed == 0 and self._runs_on(block, spans, own, begin + a):
                    skip = b
                    off, a, b = fitted(ids, part[skip:])
                    a, b = a + skip, b + skip
                same = (len(ids) + b - a - off) // 2
                if off <= allowed and (best is None or same - off > best[0]):
                    best = same - off, -i, begin + a, begin + b
            if best:
                return best[1:]
        return None


def _scan(names: list[str], templates: dict, tried: int, differing: float):
    def run(batches):
        scanner = Scanner(templates, tried, differing)
        for batch in batches:
            rows, new = [], []
            for i, raw in enumerate(K.as_bytes(batch.column("text"))):
                low = (raw or b"").lower()
                if not any(c in low for c in CUES):
                    continue
                text = raw.decode("utf-8", "replace")
                number = 0
                for begin, end in scanner.blocks(text):
                    for found in scanner.found(text[begin:end]):
                        rows.append(i)
                        new.append({**found, "block": number, "start": begin + found["start"],
                                    "end": begin + found["end"]})
                        number += 1
            take = batch.select(names).take(pa.array(rows, pa.int64())) if names else None
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.float64(),
                     pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [take.column(n) for n in names] + [pa.array([r[c] for r in new], k) for c, k in zip(ADDED, kinds)],
                [*names, *ADDED])

    return run


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, tried: int = 4, differing: float = 0.15,
         carry: list[str] | None = None) -> DataFrame:
    """A row for every licence block of a document, with the columns ``carry`` (all by default).

    Added are ``block`` (0, 1, ... in the document), ``start`` and ``end`` (code points, end exclusive),
    ``license`` and ``template``, ``ranked`` (the ``tried`` licences that save most), ``reduction`` (share
    of the compressed size saved), ``missing`` and ``extra`` words against the template, and ``exact``. They replace
    columns of the same name. A block is the part of the text that a template fits best, and is confirmed where at most
    ``differing`` of the template's words are missing or extra; of the ``tried`` templates that save most the one
    with most equal words less differences holds, then the one that saves more, then the first one. Where none of them is
    confirmed the next ones are tried. The rest of the text around a block is searched in the same way. A notice too
    short for any difference is not confirmed where it runs on from a word that is in no template.

    Null and empty texts have no blocks. Repeated rows give their blocks again; an empty table gives no rows.
    """
    names = [c for c in (carry or docs.columns) if c.lower() not in ADDED]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema)
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(
        _scan(names, templates or TEMPLATES, tried, differing), schema + ADDED_DDL)
