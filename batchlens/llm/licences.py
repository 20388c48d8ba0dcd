"""Licence scans: parts of a text against licence templates by Dice coefficient over word bigrams.

Texts and templates are normalised alike: lower case, words and version numbers
only (``v2.0`` is ``version 2``), one spelling of licence, share-alike and the like,
so layout, quotes and punctuation don't matter.  A notice may stand anywhere in a
text; what is compared with a template is every run of words whose size can still
reach the threshold, begun and ended by a bigram of the template.  With threshold t
and b template bigrams, a run needs between t/(2-t)*b and (2-t)/t*b bigrams and at
least t/(2-t)*b shared ones, so one of the (2-2t)/(2-t)*b rarest template bigrams at
least is among them: a text without any of these is never compared.

Licences of a family differ in a word or a number, which the coefficient hardly
notices.  So a run has to hold exactly the marks of the template: the names in
``MARKS`` and the version numbers behind such names.  A version or variant that has
no template is therefore not found, instead of being taken for its neighbour.

Result: one row per row of ``docs`` and licence found, with the best run (the
first of equals; places are those of the normalised words); of licences whose best
runs overlap, the one that explains most stays (bigrams shared, less those that differ).  Null and empty texts have no licence, and an
empty table gives an empty result; repeated rows are scanned each for itself.
Other columns are ignored.  A text is scanned by one task, which holds its words;
the time is in proportion to the words, but for runs that look like a template.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Mapping
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

from batchlens.llm.common import map_slices

# Notices, headers and short licences as they are published.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the Software."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met"
)
_BSD_NOTICES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_ADVERTISING = (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement"
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_ZERO_BSD = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    'granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE'
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
    "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
    "following restrictions"
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
)
_EPL_1 = (
    "This program and the accompanying materials are made available under the terms of the Eclipse "
    "Public License v1.0 which accompanies this distribution, and is available at"
)
_EPL_2 = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
    "which is available at"
)
_BOOST = (
    "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
    "http://www.boost.org/LICENSE_1_0.txt)"
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_GNU = {
    "GPL": "GNU General Public License",
    "LGPL": "GNU Lesser General Public License",
    "AGPL": "GNU Affero General Public License",
}
_GNU_VERSIONS = {"GPL": ("1", "2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}
_GNU_DATES = {
    "GPL-1": "February 1989", "GPL-2": "June 1991", "GPL-3": "29 June 2007",
    "LGPL-2.1": "February 1999", "LGPL-3": "29 June 2007", "AGPL-3": "19 November 2007",
}
_CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_CC_PORTS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}

#: words that tell licences of one family apart; a number right behind one of them is a version
MARKS = frozenset(
    "apache mit bsd isc unlicense zlib boost mozilla mpl eclipse epl cc cc0 creativecommons gpl lgpl agpl lesser library affero "
    "attribution sharealike noncommercial noderivatives by sa nc nd "
    "version license clause international unported generic".split()
)
#: words of ``MARKS`` that stand in notices of all kinds, and count only by the number behind them
_CARRIERS = frozenset("version license clause by international unported generic attribution creativecommons".split())


def _gnu_notices(name: str, kind: str, version: str) -> tuple[str, ...]:
    spelled = [version] if "." in version else [version, f"{version}.0"]
    return (
        *(f"This work is licensed under the {kind}, version {v}." for v in spelled),
        f"licensed under the {kind} v{version}",
        f"it under the terms of the {kind} as published by the Free Software Foundation; either version {version} of the "
        "License, or (at your option) any later version.",
        f"it under the terms of the {kind} as published by the Free Software Foundation, either version {version} of the "
        "License, or (at your option) any later version.",
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {kind} as published "
        f"by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"it under the terms of the {kind} version {version} as published by the Free Software Foundation",
        f"{kind} Version {version}, {_GNU_DATES[f'{name}-{version}']}",
    )


def _cc_notices(code: str, words: str, version: str) -> tuple[str, ...]:
    return (
        f"Licensed under CC {code} {version}.",
        f"licensed under a Creative Commons {words} {version} License",
        f"This work is licensed under a Creative Commons {words} {version} {_CC_PORTS[version]} License.",
        f"Creative Commons {words} {version} {_CC_PORTS[version]}",
        f"creativecommons.org/licenses/{code}/{version}",
    )


def _published() -> dict[str, tuple[str, ...]]:
    """Name -> notices; each also has its ``SPDX-License-Identifier`` line."""
    named = {
        "Apache-2.0": (
            "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0", _APACHE,
            "Apache License Version 2.0, January 2004",
        ),
        "MIT": ("Released under the MIT License.", "Licensed under the MIT License", _MIT),
        "BSD-2-Clause": (f"{_BSD_CONDITIONS}: {_BSD_NOTICES} {_BSD_DISCLAIMER}", "BSD 2-Clause License"),
        "BSD-3-Clause": (f"{_BSD_CONDITIONS}: {_BSD_NOTICES} {_BSD_NAMES} {_BSD_DISCLAIMER}", "BSD 3-Clause License"),
        "BSD-4-Clause": (f"{_BSD_CONDITIONS}: {_BSD_NOTICES} {_BSD_ADVERTISING}", "BSD 4-Clause License"),
        "BSD": (_BSD_CONDITIONS, "Licensed under the BSD License"),
        "0BSD": (_ZERO_BSD,),
        "ISC": (_ISC, "Licensed under the ISC License"),
        "Unlicense": (_UNLICENSE,),
        "Zlib": (_ZLIB,),
        "BSL-1.0": (_BOOST,),
        "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1",),
        "MPL-2.0": (_MPL, "Mozilla Public License Version 2.0"),
        "EPL-1.0": (_EPL_1, "Eclipse Public License v 1.0"),
        "EPL-2.0": (_EPL_2, "Eclipse Public License v 2.0"),
        "LGPL-2.0": ("GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License",),
        "CC0-1.0": (
            "To the extent possible under law, the author has waived all copyright and related rights to this work.",
            "CC0 1.0 Universal", "creativecommons.org/publicdomain/zero/1.0",
        ),
    }
    for name, kind in _GNU.items():
        for version in _GNU_VERSIONS[name]:
            full = version if "." in version else f"{version}.0"
            named[f"{name}-{full}"] = _gnu_notices(name, kind, version)
    for code, words in _CC.items():
        for version in _CC_PORTS:
            named[f"CC-{code}-{version}"] = _cc_notices(code, words, version)
    marked = {name: (*notices, f"SPDX-License-Identifier: {name}") for name, notices in named.items() if name != "BSD"}
    return marked | {"BSD": named["BSD"], "All rights reserved": ("All rights reserved.",)}


TEMPLATES: dict[str, tuple[str, ...]] = _published()

_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_APART = re.compile(r"\b(non|share)[\s-]+(commercial|alike)\b")
_DERIVATIVES = re.compile(r"\bno[\s-]*deriv(?:ative)?s\b")
_LICENCE = re.compile(r"\blicence(s|d)?\b")
_VERSION = re.compile(r"v(?<!\wv)(?:er)?\.?\s?(?=\d)")
_POINT_ZERO = re.compile(r"(?<![\d.])(\d{1,2})\.0(?!\d|\.\d)")


def normalise(text: str) -> list[str]:
    """Words of a text in one spelling."""
    text = _VERSION.sub("version ", text.lower())
    if "licence" in text:
        text = _LICENCE.sub(r"license\1", text)
    if "commercial" in text or "alike" in text:
        text = _APART.sub(r"\1\2", text)
    if "deriv" in text:
        text = _DERIVATIVES.sub("noderivatives", text)
    if ".0" in text:
        text = _POINT_ZERO.sub(r"\1", text)
    return _WORD.findall(text)


def marks(words: list[str]) -> list[tuple[int, str]]:
    """(place, mark) of the words that tell licences apart: names, and the number behind one."""
    found = []
    for at, word in enumerate(words):
        if word in MARKS:
            if word not in _CARRIERS:
                found.append((at, word))
            if at + 1 < len(words) and words[at + 1][0].isdigit():
                found.append((at + 1, words[at + 1]))
    return found


def _bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


class Templates:
    """Bigrams and marks of all templates, an index from a bigram to the templates that hold it, and their rarest bigrams."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], threshold: float) -> None:
        self.threshold, self.names, self.counts, self.marks = threshold, [], [], []
        self.index: dict[tuple[str, str], list[int]] = defaultdict(list)
        for name, bodies in templates.items():
            for body in bodies:
                words = normalise(body)
                counts = Counter(_bigrams(words))
                if not counts:
                    raise ValueError(f"a template of {name} has fewer than two words")
                for bigram in counts:
                    self.index[bigram].append(len(self.names))
                self.names.append(name)
                self.counts.append(counts)
                self.marks.append({mark for _, mark in marks(words)})
        self.index = dict(self.index)
        ratio = threshold / (2 - threshold)
        self.sizes = [sum(c.values()) for c in self.counts]
        self.least = [ceil(ratio * b - 1e-9) for b in self.sizes]
        self.most = [int(b / ratio + 1e-9) for b in self.sizes]
        self.rarest: dict[tuple[str, str], list[int]] = defaultdict(list)
        holders = Counter(word for counts in self.counts for word in {w for bigram in counts for w in bigram})
        for template, counts in enumerate(self.counts):
            missing = self.sizes[template] - self.least[template]
            for bigram in sorted(counts, key=lambda g: (min(holders[g[0]], holders[g[1]]), len(self.index[g]), g)):
                self.rarest[bigram].append(template)
                missing -= counts[bigram]
                if missing < 0:  # the others alone are too few
                    break
        self.rarest = dict(self.rarest)

    def scan(self, text: str) -> dict[str, tuple[float, int, int]]:
        """licence -> (Dice coefficient, first word, words) of its best run."""
        words = normalise(text)
        bigrams, rarest = _bigrams(words), self.rarest
        possible = {template for bigram in bigrams if bigram in rarest for template in rarest[bigram]}
        if not possible:
            return {}
        hits: dict[int, list[int]] = defaultdict(list)
        for at, bigram in enumerate(bigrams):
            for template in self.index.get(bigram, ()):
                if template in possible:
                    hits[template].append(at)
        marked = marks(words)
        best: dict[str, tuple[float, int, int, int]] = {}
        for template, places in hits.items():
            if len(places) >= self.least[template]:
                found = self._best_run(template, places, bigrams, marked)
                name = self.names[template]
                if found and (name not in best or (-found[0], *found[1:]) < (-best[name][0], *best[name][1:])):
                    best[name] = found
        return self._without_overlaps(best)

    @staticmethod
    def _without_overlaps(found: dict[str, tuple[float, int, int, int]]) -> dict[str, tuple[float, int, int]]:
        """Words that match several licences count for the one that explains most: bigrams shared, less those that differ."""
        kept: dict[str, tuple[float, int, int]] = {}
        for name, (dice, start, n, net) in sorted(found.items(), key=lambda f: (-f[1][3], -f[1][0], f[0])):
            if all(start + n <= s or s + m <= start for _, s, m in kept.values()):
                kept[name] = (dice, start, n)
        return kept

    def _best_run(
        self, template: int, places: list[int], bigrams: list[tuple[str, str]], marked: list[tuple[int, str]]
    ) -> tuple[float, int, int, int] | None:
        """Dice coefficient, first word, words, and bigrams shared twice over less those that differ."""
        counts, b, least, most = self.counts[template], self.sizes[template], self.least[template], self.most[template]
        best, after = None, 0
        for k, start in enumerate(places):
            while after < len(places) and places[after] - start < most:
                after += 1
            if after - k < least:
                continue
            seen: Counter = Counter()
            shared = 0
            for end in places[k:after]:
                bigram = bigrams[end]
                seen[bigram] += 1
                shared += seen[bigram] <= counts[bigram]
                size = end - start + 1
                dice = 2 * shared / (size + b)
                if size >= least and dice >= self.threshold and (best is None or dice > best[0]):
                    first, last = bisect_left(marked, (start, "")), bisect_left(marked, (end + 2, ""))
                    if {mark for _, mark in marked[first:last]} == self.marks[template]:
                        best = (dice, start, size + 1, 4 * shared - size - b)
        return best


def scan_licences(
    docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.8
) -> DataFrame:
    """``doc_id, licence, dice, start_word, n_words``."""
    prepared = Templates(templates, threshold)

    def work(doc_ids: list, texts: list) -> pa.RecordBatch:
        rows = [
            (doc_id, name, *found)
            for doc_id, text in zip(doc_ids, texts)
            if text
            for name, found in sorted(prepared.scan(text).items())
        ]
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        columns = zip(*rows) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list("abcde"))

    schema = "doc_id bigint, licence string, dice double, start_word bigint, n_words bigint"
    return map_slices(docs, ["doc_id", "text"], work, schema)
