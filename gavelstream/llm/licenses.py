"""License notices in texts, told apart by conditional compression.

Words around a cue are a candidate block, over line breaks and comment marks. It is compressed plainly
and with every template as a raw zstandard dictionary; templates are tried in order of the bytes they
save. A template wins a span only if its wording is confirmed there: its words in order, but for a stated
share, and its deciding words (names, versions, clause counts, qualifiers) without any difference. The
differences are returned. Further notices of a block are those confirmed outside the spans already won.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted

# Customary short notices by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
}
# Licenses by SPDX identifier and their names.
NAMES = {
    "Apache-1.1": "Apache License, Version 1.1",
    "Apache-2.0": "Apache License, Version 2.0",
    "Artistic-2.0": "Artistic License 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "BSD-4-Clause": "BSD 4-Clause License",
    "BSL-1.0": "Boost Software License, Version 1.0",
    "CDDL-1.0": "Common Development and Distribution License, version 1.0",
    "EPL-1.0": "Eclipse Public License, version 1.0",
    "EPL-2.0": "Eclipse Public License, version 2.0",
    "EUPL-1.2": "European Union Public License, version 1.2",
    "ISC": "ISC License",
    "MIT": "MIT License",
    "MPL-1.1": "Mozilla Public License, version 1.1",
    "MPL-2.0": "Mozilla Public License, version 2.0",
    "MS-PL": "Microsoft Public License",
    "OFL-1.1": "SIL Open Font License, Version 1.1",
    "Unlicense": "Unlicense",
    "Zlib": "zlib License",
}
GNU = {"GPL": ("General", ("1.0", "2.0", "3.0")), "LGPL": ("Lesser General", ("2.1", "3.0")), "AGPL": ("Affero General", ("3.0",))}
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
            "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
# Wordings of whole licenses and of their customary headers.
WORDINGS = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
           'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
           "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
           "Software is furnished to do so, subject to the following conditions:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
                    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
                    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
                    "distribution. THIS SOFTWARE IS PROVIDED BY",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
                    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
                    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
                    "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                    "promote products derived from this software without specific prior written permission.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
}
# What sets licenses apart. Beside numbers, a difference in one of these is never tolerated.
DECIDING = frozenset("""affero agpl apache artistic attribution boost bsd cc cddl clause commons eclipse endorse epl eupl european font gnu
    gpl isc later lesser lgpl library microsoft mit mozilla mpl nc nd neither never noncommercial noderivatives noderivs non nor not only sa
    sharealike sil sublicense unencumbered unlicense zlib""".split())
# In the same sentence, these before a notice deny it, and those after it make another license of it.
DENIALS, CHANGES = frozenset(["not", "never", "nor", "neither", "cannot"]), frozenset(["later", "newer"])
AROUND = 6
# Words that may stand between a notice and a further license of the same choice.
JOINING = frozenset(["or", "and", "the", "under", "either", "a"])
_CUE = re.compile(r"licen[sc]|public domain|creative\s+commons|permission\s|redistribution\s|free software|\bcc0|\bcc[ -]by", re.I)
_CUES = ("licen", "public domain", "creative", "permission", "redistribution", "free software", "cc")
# Runs of letters or numbers with their points: "GPLv3" and "2-Clause" are two words each.
_WORD = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*")
_SENTENCE = re.compile(r"[.;!?](?=\s)|\n\s*\n")
MAX_DIFFERENCE = 0.2

FOUND = ("start int, end int, license string, saved double, n_missing int, n_extra int, exact boolean, "
         "missing string, extra string")


def _all_templates() -> dict[str, list[str]]:
    """Every license's short notices, names, tags, headers and wordings, from the fixed values above."""
    names = {i: [n] for i, n in NAMES.items()}
    made: dict[str, list[str]] = {}

    def add(license: str, *texts: str) -> None:
        made.setdefault(license, []).extend(texts)

    for short, (kind, versions) in GNU.items():
        for v in versions:
            number = v.removesuffix(".0")
            names[f"{short}-{v}"] = [f"GNU {kind} Public License, version {number}", f"{short} {v}"]
            names[f"{short}-{v}-or-later"] = [f"GNU {kind} Public License, version {number} or later", f"{short} {v} or later"]
            for subject in ("program", "library"):
                opening = (f"This {subject} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} "
                           "Public License as published by the Free Software Foundation, ")
                add(f"{short}-{v}-or-later", f"{opening}either version {number} of the License, or (at your option) any later version.")
                add(f"{short}-{v}", f"{opening}version {number} of the License.")
    for short, kind in CREATIVE.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            names[f"CC-{short}-{v}"] = [f"Creative Commons {kind} {v}", f"CC {short} {v}"]
    for license, known in names.items():
        add(license, f"SPDX-License-Identifier: {license}", *[f"Licensed under the {n}" for n in known],
            *[f"Use of this source code is governed by a {n}" for n in known if n.startswith("BSD")],
            *[f"{lead} under a {n} {scope} License" for n in known if n.startswith("Creative")
              for lead in ("Licensed", "This work is licensed") for scope in ("International", "Unported")],
            *[f"Licensed under {n}" for n in known if n.startswith("CC")])
        if license.split("-")[0] in GNU and not license.endswith("later"):
            add(license, f"SPDX-License-Identifier: {license}-only")
    for license, text in (*TEMPLATES.items(), *WORDINGS.items()):
        add(license, text)
    add("CC0-1.0", "SPDX-License-Identifier: CC0-1.0")
    return made


def words(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case with their places; ``2.0`` is ``2``, ``v2`` is ``2`` and ``GPLv3`` is ``gpl 3``."""
    found = []
    for m in _WORD.finditer(text):
        word = m[0].lower()
        if word == "v" and text[m.end():m.end() + 1].isdigit():
            continue
        if word[0].isdigit():
            word = word.removesuffix(".0")
        elif word.endswith("gplv"):
            word = word[:-1]
        found.append((word, m.start(), m.end()))
    return found


class Template:
    """A wording of a license: its words, those that decide, and a compressor that knows it."""

    def __init__(self, license: str, text: str):
        self.license, self.text = license, text
        self.words = [w for w, _, _ in words(text)]
        # A wording without a version may be numbered; its clauses are told by their words.
        listed = len(self.words) > 60
        self.decides = lambda w: w in DECIDING or (w[0].isdigit() and not listed)
        self.needed = Counter(w for w in self.words if self.decides(w))
        self.allowed = int(MAX_DIFFERENCE * len(self.words))
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(
            text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def spans(self, block: Sequence[str]) -> Iterator[tuple[int, int, list[str], list[str]]]:
        """Places in ``block`` that hold the wording, those of the fewest differences first: from, to, missing, extra.

        Missing and extra words count one each; a deciding word is never either.
        """
        if any(n > c for c, n in ((block.count(w), n) for w, n in self.needed.items())):
            return
        limit, m = self.allowed, len(self.words)
        far = limit + 1
        # Least differences of the first i template words with block words that end at j, and where those begin.
        drop = [far if self.decides(w) else 1 for w in self.words]
        cost = [0] * (m + 1)
        for i in range(m):
            cost[i + 1] = min(far, cost[i] + drop[i])
        begin, ends = [0] * (m + 1), []
        for j, word in enumerate(block, 1):
            more = far if self.decides(word) else 1
            now, start = [0] * (m + 1), [j] * (m + 1)
            for i in range(1, m + 1):
                if self.words[i - 1] == word:
                    now[i], start[i] = cost[i - 1], begin[i - 1]
                else:
                    now[i], start[i] = min((cost[i] + more, begin[i]), (now[i - 1] + drop[i - 1], start[i - 1]))
                    now[i] = min(now[i], far)
            cost, begin = now, start
            if cost[m] <= limit and word in self.words:
                ends.append((cost[m], begin[m], j))
        for _, low, high in sorted(ends, key=lambda e: (e[0], e[1] - e[2], e[1])):
            yield low, high, *self._differences(block[low:high])

    def _differences(self, span: Sequence[str]) -> tuple[list[str], list[str]]:
        """The words on either side that a longest common subsequence leaves over."""
        a, b = self.words, span
        common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                common[i][j] = common[i + 1][j + 1] + 1 if a[i] == b[j] else max(common[i + 1][j], common[i][j + 1])
        missing, extra, i, j = [], [], 0, 0
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and a[i] == b[j]:
                i, j = i + 1, j + 1
            elif j == len(b) or (i < len(a) and common[i + 1][j] >= common[i][j + 1]):
                missing.append(a[i])
                i += 1
            else:
                extra.append(b[j])
                j += 1
        return missing, extra


class Scanner:
    def __init__(self, templates: Mapping[str, Sequence[str]]):
        self.plain = zstandard.ZstdCompressor(level=3)
        self.templates = [Template(name, t) for name, texts in sorted(templates.items()) for t in ([texts] if isinstance(texts, str) else texts)]
        self.licenses = {t.license for t in self.templates}
        # A license that follows another one in a choice is only named.
        self.names = [Template(t.license, re.sub(r"^(Licensed under the |SPDX-License-Identifier: )", "", t.text)) for t in self.templates
                      if t.text.startswith(("Licensed under the", "SPDX"))]
        # No confirmed wording reaches farther from any of its words.
        self.reach = max((len(t.words) + t.allowed for t in self.templates), default=0) + AROUND

    def blocks(self, text: str) -> Iterator[list[tuple[str, int, int]]]:
        """Words within reach of a cue; windows that touch are one block."""
        lower = text.lower()
        if not any(c in lower for c in _CUES):
            return
        cues = [m.start() for m in _CUE.finditer(text)]
        if not cues:
            return
        all_words, at, low, high = words(text), 0, None, 0
        for cue in cues:
            while at < len(all_words) and all_words[at][2] <= cue:
                at += 1
            if low is not None and at - self.reach > high:
                yield all_words[low:high]
                low = None
            low = max(0, at - self.reach) if low is None else low
            high = min(len(all_words), at + self.reach)
        yield all_words[low:high]

    def ranked(self, block: str) -> list[tuple[Template, float]]:
        """Every template and the share of bytes it saves, the most first; of equal ones the first by name."""
        data = block.encode()
        alone = len(self.plain.compress(data))
        sizes = [(len(t.packer.compress(data)), i) for i, t in enumerate(self.templates)]
        return [(self.templates[i], 1 - size / alone) for size, i in sorted(sizes)]

    @staticmethod
    def holds(text: str, block: list[tuple[str, int, int]], low: int, high: int) -> bool:
        """Whether what stands around a span leaves it what it is."""
        start, end = block[low][1], block[high - 1][2]
        if text[end:end + 1] == "-" and text[end + 1:end + 2].isalnum():
            return False
        before, after = block[max(0, low - AROUND):low], block[high:high + AROUND]
        denied = [s for w, s, _ in before if w in DENIALS]
        changed = [e for w, _, e in after if w in CHANGES]
        return (not any(not _SENTENCE.search(text, s, start) for s in denied)
                and not any(not _SENTENCE.search(text, end, e) for e in changed))

    def scan(self, text: str | None) -> Iterator[tuple]:
        text = text or ""
        for block in self.blocks(text):
            found = self.in_block(text, block)
            for low, high, template, saved, missing, extra in sorted(found, key=lambda f: f[0]):
                start, end = block[low][1], block[high - 1][2]
                later = f"{template.license}-or-later"
                yield (start, end, later if text[end:end + 1] == "+" else template.license, round(saved, 6), len(missing), len(extra),
                       not missing and not extra, " ".join(missing), " ".join(extra))

    def in_block(self, text: str, block: list[tuple[str, int, int]]) -> list[tuple]:
        if not block:
            return []
        plain, taken, found = [w for w, _, _ in block], [False] * len(block), []

        def take(template: Template, saved: float, fits) -> None:
            for low, high, missing, extra in template.spans(plain):
                if any(taken[low:high]):
                    continue
                if text[block[high - 1][2]:block[high - 1][2] + 1] == "+" and f"{template.license}-or-later" not in self.licenses:
                    continue
                if self.holds(text, block, low, high) and fits(low):
                    taken[low:high] = [True] * (high - low)
                    found.append((low, high, template, saved, missing, extra))

        ranked = self.ranked(text[block[0][1]:block[-1][2]])
        for template, saved in ranked:
            take(template, saved, lambda low: True)
        rank, more = {t.license: s for t, s in reversed(ranked)}, len(found)
        while more:
            before = len(found)
            ends = {f[1] for f in found}

            def follows(low: int, ends=ends) -> bool:
                """Only joining words, one of choice among them, stand between a notice and this name."""
                at = low
                while at not in ends and at and plain[at - 1] in JOINING:
                    at -= 1
                return at < low and at in ends and bool({"or", "and"} & set(plain[at:low]))

            for name in self.names:
                take(name, rank[name.license], follows)
            more = len(found) - before
        return found


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, tuple[str, ...]], ...]) -> Scanner:
    return Scanner(dict(templates))


def scan(df: DataFrame, templates: Mapping[str, str | Sequence[str]] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every confirmed notice: id, ``start``, ``end`` (code points), ``license``, the share of
    bytes ``saved``, counts and wording of what is missing and extra, and whether it is ``exact``.

    ``templates`` are one or more wordings by license; by default the customary notices, headers,
    texts and tags of some sixty licenses. Null and empty texts and texts without notice have no row;
    rows that share an id each have theirs. Of templates that save alike the first by name is tried
    first. Other columns are not read. No shuffle.
    """
    chosen = tuple(sorted((n, (t,) if isinstance(t, str) else tuple(t)) for n, t in (_all_templates() if templates is None else templates).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(chosen)
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for one in scanner.scan(t):
                    at.append(i)
                    found.append(one)
            if at:
                columns = list(zip(*found, strict=True))
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    names=["id", "start", "end", "license", "saved", "n_missing", "n_extra", "exact", "missing", "extra"])

    rows = df.select(quoted(id).alias("id"), quoted(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {FOUND}").withColumnRenamed("id", id)


def with_licenses(df: DataFrame, templates: Mapping[str, str | Sequence[str]] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per id that has notices: the names found, in order."""
    return scan(df, templates, id, text).groupBy(id).agg(F.array_sort(F.collect_set("license")).alias("licenses"))
