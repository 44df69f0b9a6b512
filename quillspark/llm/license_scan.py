"""Operator 3: license scan by patience alignment.

A template is aligned with a text by the words that are unique in both: the longest run of them that is in the same
order in both anchors the alignment, and the gaps between anchors are aligned in the same way, equal words at both
ends of a gap first. The share of the template's words that are aligned is its coverage. A stretch that equals the
template is aligned alone; of a long template's windows those are left out whose words, in any order, are fewer than the
best alignment has.

A text that covers a template by `coverage` holds at least one of any floor((1 - coverage) * n) + 1 of its n words;
the rarest such words, by their use in the templates, make a test that only passes texts worth aligning.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common

COVERAGE = 0.8
RESULT = "doc_id long, license string, coverage double, n_matched long, first_word long, last_word long"
#: The notices that are looked for.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT notice": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}

#: Notices of further licenses. The license of a notice is its name without the last word.
NOTICES = {
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 header": "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0 header": "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1 notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0 header": "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1 header": "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 header": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0 notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    **{f"{k} license": f"Licensed under the GNU {v}." for k, v in (("GPL-2.0", "General Public License, version 2"), ("GPL-3.0", "General Public License, version 3"), ("LGPL-2.1", "Lesser General Public License, version 2.1"), ("LGPL-3.0", "Lesser General Public License, version 3"), ("AGPL-3.0", "Affero General Public License, version 3"))},
    "MIT license": "Licensed under the MIT License.",
    "BSD-2-Clause notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause notice": "Licensed under the BSD 3-Clause License.",
    "ISC notice": "Licensed under the ISC License.",
    "Unlicense notice": "Released under the Unlicense.",
    "CC0-1.0 notice": "Licensed under CC0 1.0.",
    **{f"CC-{v}-{n} notice": f"Licensed under CC {v} {n}." for n in ("4.0", "3.0") for v in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") if (v, n) != ("BY-NC", "4.0")},
    **{
        f"CC-{v}-{n} name": f"Creative Commons {long} {n}"
        for n in ("4.0", "3.0")
        for v, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    },
    **{
        f"{x.removesuffix('-only').removesuffix('-or-later')} {'or-later' if x.endswith('later') else 'identifier'}": f"SPDX-License-Identifier: {x}"
        for x in ("Apache-2.0", "MIT", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
    },
}
#: Words that tell a license, its version or its variant: a template that holds one must have it aligned, and none that
#: it does not hold may stand within its place. The words of full texts do not tell.
TELLING = re.compile(
    r"apache|mit|gnu|lesser|affero|library|mozilla|isc|unlicense|bsd|[234]-clause|cc0?|by(-(nc|nd|sa))+|nc|nd|sa|v?[0-9](\.[0-9]+)?"
    r"|(attribution|non-?commercial|share-?alike|no-?derivatives|noderivs)(-(non-?commercial|share-?alike|no-?derivatives|noderivs))*"
    r"|(apache|mit|l?gpl|agpl|mpl|bsd|cc|cc0)-[a-z0-9.-]+"
)
#: Templates of more words are texts, not notices.
LONG = 60
#: Texts of a task whose results are kept for their copies; when there are more, they are aligned anew.
REMEMBERED = 50_000
FULL_TEXTS = Path(__file__).parent / "licenses"


def catalogue() -> dict[str, str]:
    """All templates: short notices, and the full texts in the folder of licenses."""
    return {**TEMPLATES, **NOTICES, **{f"{p.stem} text": p.read_text() for p in sorted(FULL_TEXTS.glob("*.txt"))}}


def tells(template: list[str]) -> set[str]:
    """Words that a place must have: of a long text the name of its author, if any, else all words that tell; `by` tells
    only behind `cc`."""
    if len(template) > LONG:
        return set(template) & {"apache", "gnu", "mozilla", "cc0"}
    return {w for w in template if TELLING.fullmatch(w)} | ({"by"} if {"cc", "by"} <= set(template) else set())


def license_of(name: str) -> str:
    return name.rsplit(" ", 1)[0]


def best_of_place(found: list[tuple[str, float, int, int, int]], exact_places: dict[str, list[tuple[int, int]]]) -> list[tuple[str, float, int, int, int]]:
    """Without the notices whose place overlaps one that more words, or the same number at a larger coverage, agree with,
    or another stretch that equals that one. The first list of notices stays next to other notices of its license."""
    out: list[tuple[str, float, int, int, int]] = []
    for x in sorted(found, key=lambda x: (-x[2], -x[1])):
        taken = [(a, b) for y in out if not (x[0] in TEMPLATES and license_of(x[0]) == license_of(y[0])) for a, b in ((y[3], y[4] + 1), *exact_places[y[0]])]
        if all(x[4] < a or b <= x[3] for a, b in taken):
            out.append(x)
    return [x for x in found if x in out]


def tokens(text: str) -> list[str]:
    """Words in lower case without punctuation at their ends."""
    return [w for w in (x.strip(".,;:!?()[]\"'").lower() for x in text.split()) if w]


def increasing(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence that increases in its second place, by patience sorting; the first place increases."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(places):
        k = bisect_left(tops, b)
        before.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[k], piles[k] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(places[i])
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a and b that patience alignment matches."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        once_a = {w for w, k in Counter(a[i:m]).items() if k == 1}
        once = {w: p for p, w in enumerate(b[j:n], j)}
        twice = {w for w, k in Counter(b[j:n]).items() if k > 1}
        places = [(p, once[w]) for p, w in enumerate(a[i:m], i) if w in once_a and w in once and w not in twice]
        anchors = increasing(places)
        if not anchors:
            continue
        out += anchors
        for (i0, j0), (i1, j1) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)], strict=True):
            if i1 - i0 > 1 and j1 - j0 > 1:
                todo.append((i0 + 1, i1, j0 + 1, j1))
    return sorted(out)


def regions(words: list[str], template: list[str], rare: set[str]) -> list[tuple[int, int]]:
    """Stretches of a text around the telling words of a template, twice its length to each side."""
    reach, out = 2 * len(template), []
    for p, w in enumerate(words):
        if w in rare:
            a, b = max(0, p - reach), min(len(words), p + reach + 1)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def telling(templates: dict[str, list[str]], coverage: float) -> dict[str, set[str]]:
    """For each template its rarest words, of which a text with that coverage holds one at least."""
    use = Counter(w for t in templates.values() for w in set(t))
    out = {}
    for name, t in templates.items():
        spare, chosen = int((1 - coverage) * len(t) + 1e-9), set()
        must = tells(t)
        if rare := [w for w in must if len(w) > 2 and w != "mit"]:  # all are aligned, so one that is no common word makes the test
            out[name] = {min(rare, key=lambda w: (use[w], -len(w), w))}
            continue
        count = Counter(t)
        left = spare + 1
        for w in sorted(count, key=lambda w: (0 if must or len(t) > LONG else use[w], len(w) < 4, -len(w), w)):
            if left <= 0:
                break
            chosen.add(w)
            left -= count[w]
        out[name] = chosen
    return out


def exact(words: list[str], template: list[str]) -> list[tuple[int, int]]:
    """The stretches that equal a template word by word."""
    n = len(template)
    return [(p, p + n) for p in range(len(words) - n + 1) if words[p] == template[0] and words[p + n - 1] == template[-1] and words[p : p + n] == template]


def find(text: str, templates: dict[str, list[str]], rare: dict[str, set[str]], coverage: float) -> list[tuple[str, float, int, int, int]]:
    """Name, coverage, matched words and first and last word of every notice of a text, in order of the templates."""
    words, out = tokens(text), []
    places: dict[str, list[tuple[int, int]]] = {}
    count = Counter(words)
    have = count.keys()
    for name, t in templates.items():
        if have.isdisjoint(rare[name]):
            continue
        must, own, need = tells(t), set(t), Counter(t)
        shared = lambda k: sum(min(n, k[w]) for w, n in need.items())  # noqa: B023, E731 - words that an alignment has at most
        if not must <= have or shared(count) < coverage * len(t) - 1e-9:
            continue
        best, places[name] = None, exact(words, t)
        whole = places[name][0] if places[name] else None
        for a, b in [whole] if whole else regions(words, t, rare[name]):
            for c, d in [whole] if whole else tightened(words, a, b, t):
                if len(t) > LONG and not whole and shared(Counter(words[c:d])) < (best[1] if best else coverage * len(t) - 1e-9):
                    continue
                pairs = align(words[c:d], t)
                found = (len(pairs) / len(t), len(pairs), c + pairs[0][0], c + pairs[-1][0]) if pairs else None
                if not found or found[0] < coverage or not must <= {t[j] for _, j in pairs}:
                    continue
                if len(t) <= LONG and any(w not in own and TELLING.fullmatch(w) for w in words[found[2] : found[3] + 1]):
                    continue
                if best is None or (found[0], best[3] - best[2]) > (best[0], found[3] - found[2]):
                    best = found
                    if found[0] == 1 and found[3] - found[2] + 1 == len(t):
                        break
            if best and best[0] == 1 and best[3] - best[2] + 1 == len(t):
                break
        if best:
            out.append((name, *best))
    return best_of_place(out, places)


def tightened(words: list[str], a: int, b: int, template: list[str]) -> list[tuple[int, int]]:
    """The whole stretch, and a window of the template's length at each word that begins or ends the template: in a stretch
    that repeats a notice no word is unique, in one of the windows it is."""
    n = len(template)
    slack = n // 4
    starts = [p for p in range(a, b) if words[p] in template[:2]]
    ends = [p + 1 for p in range(a, b) if words[p] in template[-2:]]
    return list(dict.fromkeys([(a, b), *((max(a, p - 1), min(b, p + n + slack)) for p in starts), *((max(a, p - n - slack), min(b, p + 1)) for p in ends)]))


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Notices of licenses in documents.

    docs: doc_id and text; other columns are ignored. A null or empty text holds none. Returns a row for each
    document row and template that it covers by `coverage` or more: doc_id, license, coverage, n_matched, and
    the first and last aligned word (counted without words of punctuation alone). Of several places the one of
    largest coverage counts, then the shortest, then the first. Words that tell a license have to agree, and where
    places of several licenses overlap, the one that most words agree with counts.
    """
    known = {k: tokens(v) for k, v in (templates or catalogue()).items()}
    known = {k: t for k, t in known.items() if t}
    rare = telling(known, coverage)
    by_first: dict[str, list[str]] = {}
    for w in sorted({w for words in rare.values() for w in words}):
        by_first.setdefault(w[0], []).append(r"\Q" + w[1:] + r"\E")
    test = "|".join(rf"\Q{c}\E(?:{'|'.join(rest)})" for c, rest in by_first.items())
    if not test:
        return docs.sparkSession.createDataFrame([], RESULT)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}  # copies of a text within a task are aligned once

        def once(text: str) -> list:
            key = hashlib.sha256(text.encode()).digest()
            if key not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[key] = find(text, known, rare, coverage)
            return seen[key]

        for batch in batches:
            rows = [(d, *found) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for found in once(t.as_py())]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "license", "coverage", "n_matched", "first_word", "last_word"])

    passed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{test})"))
    return passed.mapInArrow(scan, RESULT)


def brute_force(docs: pd.DataFrame, coverage: float = COVERAGE, templates: dict[str, str] | None = None) -> pd.DataFrame:
    """Coverage by longest common subsequence over all windows, an upper bound that the alignment should reach."""
    rows = []
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        words = tokens(text or "")
        for name, t in {k: tokens(v) for k, v in (templates or TEMPLATES).items()}.items():
            have, best, span = set(t), 0, len(t) + len(t) // 4
            hits = [p for p, w in enumerate(words) if w in have]
            for p in hits:
                window = words[p : p + span]
                row = [0] * (len(t) + 1)
                for w in window:
                    diagonal = 0
                    for k, x in enumerate(t, 1):
                        diagonal, row[k] = row[k], diagonal + 1 if w == x else max(row[k], row[k - 1])
                best = max(best, row[-1])
            if best >= coverage * len(t):
                rows.append((d, name, best / len(t)))
    return pd.DataFrame(rows, columns=["doc_id", "license", "coverage"])


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(common.documents(spark, sf_dir))
