"""License notices in texts: conditional compression ranks the licenses of a block, exact wording confirms the winner.

A license has one or more wordings: notices and texts (``TEMPLATES``), and short
references (``references``: "released under the MIT License", SPDX tags).  The
words of a text are compared case apart; a word broken by a hyphen at the end of
a line is one word.

1. Candidate blocks: a wording can only lie where a window of its length, and
   ``max_diff`` more, holds all but ``max_diff`` of its words.  Windows of all
   wordings that overlap are one block; a block of more than ``BLOCK`` words is
   worked in parts that overlap by the longest window, and each part answers for
   the places that begin before the overlap.
2. Ranking: the block is compressed alone and with each license that has a window
   in it as zstandard raw-content dictionary; licenses are tried in the order of
   the bytes they save, equal ones in the order of the table.
3. Confirmation: the words of each wording are aligned with the block's (unit
   costs, free ends).  A place is that license if at most ``max_diff`` of the
   wording's words differ, if no differing word tells licenses apart (numbers,
   and the names in ``TELLING``), and if the license saves ``min_saving`` of the
   place's own bytes.  The differences are reported.  A winner's places are taken;
   the licenses after it get the words that are left.

Texts without two of the terms in ``GATE`` are not searched; every wording has
two at least besides any word that may differ.  Null and empty texts have no
notices.  Repeated notices are reported at each place, repeated rows each.  Whole
texts are read, in memory of their own size.  A null id stays null; an id that is
no whole number raises an error.  An empty table gives an empty result.  Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm import _text

_GNU = "it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
#: Public license notices and texts by name.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify " + _GNU.format("General Public License", 2),
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify " + _GNU.format("Lesser General Public License", 3),
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify " + _GNU.format("Lesser General Public License", 2.1),
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify " + _GNU.format("Affero General Public License", 3),
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "BSD-2-Clause": _BSD + " " + _BSD_END,
    "BSD-3-Clause": _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}
#: How licenses are called.
CALLED = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "MIT": ("MIT License", "MIT"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL v3", "GNU GPLv3", "GPL v3", "GPLv3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL v2", "GNU GPLv2", "GPL v2", "GPLv2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3", "GNU LGPL v3", "GNU LGPLv3", "LGPL v3", "LGPLv3", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPL v2.1", "LGPLv2.1", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "GNU AGPL v3", "GNU AGPLv3", "AGPL v3", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-clause BSD license", "BSD-3-Clause"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-clause BSD license", "BSD-2-Clause"),
    "ISC": ("ISC License",),
    "0BSD": ("0BSD License",),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL-2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "BSL-1.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0-1.0"),
} | {
    f"CC-BY{k}-4.0": (f"Creative Commons Attribution{name} 4.0 International License", f"CC BY{k} 4.0", f"CC-BY{k}-4.0", f"CC-BY{k} 4.0", f"CC BY{k}-4.0")
    for k, name in (("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"), ("-ND", "-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))
}
#: What short references begin with, and words that tell licenses apart, as numbers do.
_OPENINGS = tuple(f"{verb} under{link}" for verb in ("licensed", "released", "distributed", "available", "published", "provided") for link in ("", " the", " a", " the terms of the"))
TELLING = frozenset("affero apache attribution boost bsd cc cc-by cc0 eclipse epl gnu gpl isc lesser lgpl agpl library mit mozilla mpl nc nd noncommercial noderivatives non-commercial sa sharealike unlicense zlib neither endorse unencumbered".split())
GATE = re.compile(r"licen[sc]|copyright|permission|permitted|redistribut|warrant|creative\s+commons|public\s+domain|merchantab|disclaim|\b(?:CC|MIT|BSD|ISC|EPL|MPL|L?GPL|AGPL|GNU|BSL|CC0|SPDX|0BSD|zlib|unlicense|apache|mozilla|eclipse|boost)(?![a-uw-z])|free\s+software|waive|neighbou?ring|liable|international|unencumbered|\bunder\b", re.IGNORECASE)
#: Words of a block that is worked at once.
BLOCK = 2048
_WORDS = re.compile(r"\w+(?:(?:[.']|-(?:[ \t]*\r?\n[ \t>*#/]*)?)\w+)*")
_BROKEN = re.compile(r"-\s[\s>*#/]*")


def word(raw: str) -> str:
    return (_BROKEN.sub("-", raw) if "\n" in raw else raw).lower()


def wording(text: str) -> list[str]:
    return [word(w) for w in _WORDS.findall(text)]


def references() -> dict[str, list[str]]:
    """Short references to each license, under the name of its line."""
    out = {}
    for name, called in CALLED.items():
        out[f"{name}-line"] = [*(f"{o} {c}" for o in _OPENINGS for c in called), *(f"SPDX-License-Identifier: {c}" for c in called if " " not in c), *([f"SPDX-License-Identifier: {name}"] if name not in called else [])]
    return out


@cache
def _licenses() -> tuple[dict[str, list[list[str]]], dict, object, dict, set]:
    """(wordings by name, word numbers, compressor without and by name with all its wordings, words of each wording as a set)."""
    import zstandard

    texts = {name: [t] for name, t in TEMPLATES.items()}
    for name in ("LGPL-3.0", "LGPL-2.1"):
        texts[name].append(TEMPLATES[name].replace("library", "program"))
    for name, short in references().items():
        texts[name] = [*texts.get(name, ()), *short]
    words: dict[str, list[list[str]]] = {}
    for name, all_ in texts.items():
        words[name] = [list(w) for w in dict.fromkeys(tuple(wording(t)) for t in all_)]
    number = {w: k for k, w in enumerate(sorted({w for ws in words.values() for one in ws for w in one}))}
    bare = zstandard.ZstdCompressionParameters.from_level(19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    plain = zstandard.ZstdCompressor(compression_params=bare)
    primed = {name: zstandard.ZstdCompressor(compression_params=bare, dict_data=zstandard.ZstdCompressionDict(" ".join(w for one in ws for w in one).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, ws in words.items()}
    return words, number, plain, primed, {name: [frozenset(one) for one in ws] for name, ws in words.items()}


def sizes(words: list[str], names: list[str]) -> tuple[int, list[int]]:
    """Compressed bytes of the words, alone and with each license as dictionary."""
    _, _, plain, primed, _ = _licenses()
    raw = " ".join(words).encode()
    return len(plain.compress(raw)), [len(primed[n].compress(raw)) for n in names]


def saving(name: str, words: list[str]) -> float:
    """Share of the compressed bytes of the words that a license saves."""
    alone, (primed,) = sizes(words, [name])
    return (alone - primed) / alone


def tells(w: str) -> bool:
    """Does a word tell licenses apart?"""
    return any(c.isdigit() for c in w) or not TELLING.isdisjoint((w, *w.split("-")))


def _traced(rows: list[np.ndarray], template: np.ndarray, block: np.ndarray, end: int) -> tuple[list[int], list[int], int]:
    """(template positions missing, block positions put in, start) of the best alignment that ends at ``end``."""
    i, j, missing, extra = len(template), end, [], []
    while i:
        here = rows[i][j]
        if j and here == rows[i - 1][j - 1] + (template[i - 1] != block[j - 1]):
            i, j = i - 1, j - 1
            if template[i] != block[j]:
                missing.append(i)
                extra.append(j)
        elif here == rows[i - 1][j] + 1:
            i -= 1
            missing.append(i)
        else:
            j -= 1
            extra.append(j)
    return missing[::-1], extra[::-1], j


def _places(template: np.ndarray, block: np.ndarray, most: float) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """(start, end, missing, extra) of places of a template in a block that don't overlap, the nearest first."""
    step = np.arange(len(block) + 1)
    rows = [np.zeros(len(block) + 1, dtype=np.int64)]
    for i, w in enumerate(template, 1):
        row = np.empty_like(rows[-1])
        row[0] = i
        row[1:] = np.minimum(rows[-1][1:] + 1, rows[-1][:-1] + (block != w))
        rows.append(np.minimum.accumulate(row - step) + step)
    used = np.zeros(len(block), dtype=bool)
    ends = np.flatnonzero(rows[-1] <= 2 * most)
    for end in ends[np.argsort(rows[-1][ends], kind="stable")].tolist():
        if end and not used[end - 1]:
            missing, extra, start = _traced(rows, template, block, end)
            if start < end and max(len(missing), len(extra)) <= most and not used[start:end].any():
                used[start:end] = True
                yield start, end, missing, extra


def _windows(ids: np.ndarray, present: set[str], max_diff: float) -> dict[str, list[tuple[int, np.ndarray, list[tuple[int, int]]]]]:
    """Per license: for each wording that the words can hold, its place in the table, its numbers and where its windows lie (first word, end)."""
    words, number, _, _, members = _licenses()
    out: dict[str, list] = {}
    for name, all_ in words.items():
        for k, one in enumerate(all_):
            most = int(max_diff * len(one))
            if len(members[name][k] - present) > most:
                continue
            numbers = np.array([number[w] for w in one], dtype=np.int64)
            inside = np.zeros(len(number) + 1, dtype=bool)
            inside[numbers] = True
            reach = len(one) + most
            count = np.concatenate(([0], np.cumsum(inside[ids])))
            first = np.arange(len(ids))
            near = np.flatnonzero(count[np.minimum(first + reach, len(ids))] - count[first] >= len(one) - most)
            if len(near):
                cuts = np.flatnonzero(near[1:] > near[:-1] + reach) + 1
                spans = [(int(p[0]), min(int(p[-1]) + reach, len(ids))) for p in np.split(near, cuts)]
                out.setdefault(name, []).append((k, numbers, spans))
    return out


def blocks(windows: dict, size: int) -> Iterator[tuple[int, int, int]]:
    """(first word, end, end of what it answers for) of the blocks that windows make."""
    spans = sorted(s for all_ in windows.values() for _, _, of in all_ for s in of)
    longest = max((e - b for b, e in ((0, 2 * len(numbers)) for all_ in windows.values() for _, numbers, _ in all_)), default=0)
    merged: list[list[int]] = []
    for low, high in spans:
        if merged and low < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    for low, high in merged:
        while high - low > size + longest:
            yield low, low + size + longest, low + size
            low += size
        yield low, high, high


def notices(words: list[str], min_saving: float, max_diff: float) -> list[tuple[int, int, str, float, list[str], list[str]]]:
    """(first word, end, license, saving, words missing, words put in) of the notices in a text's words."""
    number = _licenses()[1]
    ids = np.array([number.get(w, len(number)) for w in words], dtype=np.int64)
    windows = _windows(ids, set(words), max_diff)
    used, found = np.zeros(len(words), dtype=bool), []
    table = {name: k for k, name in enumerate(_licenses()[0])}
    for low, high, until in blocks(windows, BLOCK):
        here = {name: [(numbers, of) for _, numbers, of in all_ if any(s < high and e > low for s, e in of)] for name, all_ in windows.items()}
        names = [name for name, all_ in here.items() if all_]
        alone, primed = sizes(words[low:high], names)
        for _, _, name in sorted((size - alone, table[name], name) for name, size in zip(names, primed, strict=True)):
            hits = []
            for numbers, of in here[name]:
                for s, e in of:
                    a, b = max(s, low), min(e, high)
                    if a >= b:
                        continue
                    for start, end, missing, extra in _places(numbers, ids[a:b], max_diff * len(numbers)):
                        lost, put = [_name(numbers[i]) for i in missing], [words[a + j] for j in extra]
                        if a + start < until and not any(map(tells, (*lost, *put))):
                            n = len(missing) + len(extra)
                            hits.append((n - len(numbers), n, a + start, a + end, lost, put))
            for _, _, start, end, lost, put in sorted(hits, key=lambda h: h[:4]):
                if not used[start:end].any() and (share := saving(name, words[start:end])) >= min_saving:
                    used[start:end] = True
                    found.append((start, end, name, share, lost, put))
    return sorted(found)


@cache
def _numbered() -> list[str]:
    number = _licenses()[1]
    return sorted(number, key=number.__getitem__)


def _name(number: int) -> str:
    return _numbered()[number]


def may_hold(text: str) -> bool:
    """Has a text two terms of license language?"""
    found = GATE.finditer(text)
    first = next(found, None)
    return first is not None and next(found, None) is not None


_SCHEMA = "id long, license string, first_line long, last_line long, saving double, n_differences long, missing array<string>, extra array<string>"


def _scan(min_saving: float, max_diff: float):
    def rows_of(doc, text: str) -> Iterator[tuple]:
        at = list(_WORDS.finditer(text))
        line, seen = 0, 0
        for s, e, name, share, missing, extra in notices([word(m.group()) for m in at], min_saving, max_diff):
            line, seen = line + text.count("\n", seen, at[s].start()), at[s].start()
            yield doc, name, line, line + text.count("\n", seen, at[e - 1].end()), round(share, 6), max(len(missing), len(extra)), missing, extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("id", "license", "first_line", "last_line", "saving", "n_differences", "missing", "extra")
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for i, j, texts in _text.slices(batch.column("text")):
                rows = [r for doc, raw in zip(ids[i:j], texts, strict=True) if may_hold(text := raw.decode()) for r in rows_of(doc, text)]
                columns = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))

    return run


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_saving: float = 0.3, max_diff: float = 0.15) -> DataFrame:
    """One row per notice: id, license, lines, saving and the wording differences."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_scan(min_saving, max_diff), _SCHEMA).withColumnRenamed("id", id_col)
