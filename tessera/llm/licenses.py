"""License scans by conditional compression.

Text is cut into blocks: paragraphs, or overlapping stretches where a paragraph is long. A block that lacks all trigger
words of a template cannot have enough of its words: a template's triggers are its rarest words, one more than it
may lack. Every block that any template's triggers let through is a candidate. It is compressed alone and with each template
as a zstandard raw dictionary, and templates are ranked by the bytes that they save. Those of which the block has too few words in any
order are not tried, as they cannot be confirmed. In the order of the ranking each template is confirmed by exact wording: words of
template and block are aligned in a window at every word that can begin the notice when a tenth of its words are missing, and the share
of the template's words that the window has, in order, must reach MIN_WORDING. Each place so confirmed is compressed for itself:
of a template's own places that overlap the one with the best wording counts, and of places of several templates the one of
which its template saves the most bytes. No template or place that reaches the share is left out before. The words on which they differ are reported.
Templates are short notices, so a block may also hold one within other text.

One row for each place of a licence, with the place of its wording in the text (characters). Null and empty texts
and texts without a licence give no rows, so does an empty table; equal rows give equal results; ties rank by
the template's name. Identifiers in SPDX lines are rows of their own, with no reduction. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADER = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation{then} either version {n} of the License, or (at your option) any later version."


def _header(kind: str, n: str, what: str = "program") -> str:
    """The notice that the GNU licences ask for at the head of each file."""
    mark, then = (":", ",") if n == "3" else (";", ";")
    return _HEADER.format(what=what, mark=mark, kind=kind, then=then, n=n)


#: Notices by SPDX name, fixed values: the sentences by which projects state their licence, the headers of files, and
#: for GNU licences the heading of the full text.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.",),
    "CC0-1.0": (
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", _header("General Public License", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _header("General Public License", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "LGPL-2.1": (_header("Lesser General Public License", "2.1", "library"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", _header("Lesser General Public License", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", _header("Affero General Public License", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Longer paragraphs are scanned in stretches of twice STRETCH words that overlap by half, so no notice is cut by all of
#: them; longer templates have longer stretches.
BLOCK_CHARS, STRETCH = 2_000, 120
#: Share of the template's words that a block must have in order, and words a short template may lack.
MIN_WORDING = 0.9

#: The identifiers of an SPDX line; -only, -or-later and + do not count.
_SPDX, _IDENTIFIER = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.I), re.compile(r"[A-Za-z0-9][\w.-]*\+?")
_SUFFIX = re.compile(r"(?:-only|-or-later|\+)$", re.I)
#: BSD-2-Clause and BSD-3-Clause begin alike; only the latter has the clause on names before its disclaimer.
_OPENING = re.compile(r"redistribution\W+and\W+use\W+in\W+source", re.I)
_DISCLAIMER, _NAMES = re.compile(r"this\W+software\W+is\W+provided", re.I), re.compile(r"endorse\W+or\W+promote", re.I)

_WORDS = re.compile(r"\w+(?:[.-]\w+)*")
_PARAGRAPH = re.compile(r"[^\r\n]+(?:(?:\r\n?|\n)[^\r\n]+)*")


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def triggers(templates: dict[str, tuple[str, ...]]) -> list[str]:
    """Words of which every block that a template can be confirmed in has one; those in many templates and long ones first."""
    every = [words(text) for texts in templates.values() for text in texts]
    shared = Counter(w for own in every for w in set(own))
    out: dict[str, None] = {"spdx": None}
    for own in every:
        # the words a template may lack, and one more, in the template as often as they are
        least = len(own) - -(-int(1000 * MIN_WORDING) * len(own) // 1000) + 1
        for w, n in sorted(Counter(own).items(), key=lambda x: (len(x[0]) < 7, -shared[x[0]], -len(x[0]), x[0])):
            if least <= 0:
                break
            out[w], least = None, least - n
    return list(out)


def trigger_pattern(found: list[str]) -> str:
    """For Python and Java, on lower-cased text. A word is looked for anywhere, so this may take more, never fewer."""
    return "|".join(re.escape(w) for w in sorted(found))


def blocks(text: str, trigger: re.Pattern, stretch: int = STRETCH) -> Iterator[tuple[int, str]]:
    """Start and text of the candidate blocks; together they cover every trigger."""
    for paragraph in _PARAGRAPH.finditer(text):
        if not trigger.search(paragraph[0].lower()):
            continue
        if len(paragraph[0]) <= BLOCK_CHARS:
            yield paragraph.start(), paragraph[0]
            continue
        starts = [m.start() for k, m in enumerate(_WORDS.finditer(paragraph[0])) if k % stretch == 0]
        for k in range(max(1, len(starts) - 1)):
            piece = paragraph[0][starts[k] : starts[k + 2] if k + 2 < len(starts) else None]
            if trigger.search(piece.lower()):
                yield paragraph.start() + starts[k], piece


def window_size(template: list[str]) -> int:
    return len(template) + max(2, len(template) // 5)


def least_words(template: list[str]) -> int:
    """Words of the template that a place must have in order."""
    return -(-int(1000 * MIN_WORDING) * len(template) // 1000)


def aligned(template: list[str], window: list[str]) -> list[tuple[int, int]]:
    """Places of equal words in template and window, as many as can stand in order."""
    n = len(window)
    best = [[0] * (n + 1) for _ in range(len(template) + 1)]
    for i in range(len(template) - 1, -1, -1):
        for j in range(n - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if template[i] == window[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(template) and j < n:
        if template[i] == window[j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def wordings(template: list[str], block: list[str]) -> Iterator[tuple[float, float, int, int, str]]:
    """Places of the template in the block: the share of its words found there in order with words added in between
    counted against it, the same share without, the place's first and last word, and the differences."""
    need, bag = least_words(template), Counter(template)
    # the first word that a place has is one of these, as no more than the others can be missing
    first = set(template[: len(template) - need + 1])
    for s in [i for i, w in enumerate(block) if w in first]:
        window = block[s : s + window_size(template)]
        has = Counter(window)
        if sum(min(n, has[w]) for w, n in bag.items()) < need:
            continue
        m = [(x.a + k, x.b + k) for x in SequenceMatcher(None, template, window, autojunk=False).get_matching_blocks() for k in range(x.size)]
        if len(m) < need:
            m = aligned(template, window)
        if len(m) < need:
            continue
        lacks, adds = [], []
        for (i, j), (i2, j2) in zip([(-1, m[0][1] - 1), *m], [*m, (len(template), m[-1][1] + 1)]):
            lacks += [f"-{w}" for w in template[i + 1 : i2]]
            adds += [f"+{w}" for w in window[j + 1 : j2]]
        yield len(m) / (len(template) + len(adds)), len(m) / len(template), s + m[0][1], s + m[-1][1] + 1, " ".join(lacks + adds)


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Takes the stretch if it overlaps none that is taken."""
    at = bisect(taken, (a, b))
    if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b):
        return False
    taken.insert(at, (a, b))
    return True


def bsd(text: str, a: int, b: int) -> str:
    """Which licence the opening sentence at text[a:b] begins; BSD-3-Clause if no disclaimer follows to tell."""
    end, other = _DISCLAIMER.search(text, b), _OPENING.search(text, b)
    if _OPENING.match(text, a) and end and (not other or end.start() < other.start()) and not _NAMES.search(text, b, end.start()):
        return "BSD-2-Clause"
    return "BSD-3-Clause"


def identifiers(text: str, known: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    """Start, end and name of the known licences that SPDX lines name."""
    for line in _SPDX.finditer(text):
        for m in _IDENTIFIER.finditer(text, *line.span(1)):
            if name := known.get(_SUFFIX.sub("", m[0]).lower()):
                yield *m.span(), name


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]]):
        import zstandard as zstd

        self.zstd = zstd
        self.notices = [(name, text, words(text)) for name, texts in sorted(templates.items()) for text in texts if words(text)]
        self.stretch = max([STRETCH, *(window_size(template) for _, _, template in self.notices)])
        self.trigger = re.compile(trigger_pattern(triggers(templates)))
        self.known = {name.lower(): name for name in templates}
        self.bags = [Counter(template) for _, _, template in self.notices]
        plain = zstd.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = plain
        self.dicts = [zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(text.lower().encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for _, text, _ in self.notices]

    def saving(self, text: str, k: int, alone: int | None = None) -> int:
        """Bytes that the template as a dictionary saves of the compressed text."""
        data = text.lower().encode()
        return (len(self.plain.compress(data)) if alone is None else alone) - len(self.dicts[k].compress(data))

    def ranked(self, block: str, own: list[str]) -> list[int]:
        """The templates that may reach MIN_WORDING, by what each saves of the block."""
        held = self.possible(own)
        if not held:
            return []
        alone = len(self.plain.compress(block.lower().encode()))
        return sorted(held, key=lambda k: (-self.saving(block, k, alone), self.notices[k][0], k))

    def possible(self, block: list[str]) -> list[int]:
        """The templates that may reach MIN_WORDING: words in order are never more than words in any order."""
        has = Counter(block)
        return [k for k, own in enumerate(self.bags) if sum(min(n, has[w]) for w, n in own.items()) >= least_words(self.notices[k][2])]

    def scan(self, text: str | None) -> list[tuple]:
        found: dict[int, set[tuple]] = {}
        for start, block in blocks(text or "", self.trigger, self.stretch):
            places = [m.span() for m in _WORDS.finditer(block)]
            own = [block[a:b].lower() for a, b in places]
            for k in self.ranked(block, own):
                for score, share, first, last, diff in wordings(self.notices[k][2], own):
                    found.setdefault(k, set()).add((-score, first - last, start + places[first][0], start + places[last - 1][1], share, diff))
        out: list[tuple] = []
        for k, each in found.items():
            # a template's own places: the best wording where windows overlap
            taken: list[tuple[int, int]] = []
            for score, _, a, b, share, diff in sorted(each):
                if _free(taken, a, b):
                    saved = self.saving(text[a:b], k)
                    out.append((-saved, score, b - a, self.notices[k][0], a, b, share, saved / len(self.notices[k][1]), diff))
        # of two that overlap, in one block or in overlapping stretches, the one that saves more
        named = list(identifiers(text or "", self.known))
        taken = sorted((a, b) for a, b, _ in named)
        rows: list[tuple] = [(a, b - a, name, 1.0, None, "") for a, b, name in named]
        for _, _, _, name, a, b, share, reduction, diff in sorted(out):
            if not _free(taken, a, b):
                continue
            name = bsd(text, a, b) if name == "BSD-3-Clause" else name
            rows.append((a, b - a, name, share, reduction, diff))
        return sorted(rows)


_SCANNERS: dict[int, Scanner] = {}
FOUND = "doc_id long, start long, chars long, license string, wording double, reduction double, differences string"


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """FOUND, one row a licence in a block."""
    notices = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(sorted(notices.items())))
        if key not in _SCANNERS:
            _SCANNERS[key] = Scanner(notices)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string()]
        for batch in batches:
            rows = [(d, *row) for d, text in zip(batch.column(0).to_pylist(), batch.column(1)) for row in _SCANNERS[key].scan(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], [x.split(" ")[0] for x in FOUND.split(", ")])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.filter(F.lower("text").rlike(trigger_pattern(triggers(notices)))).mapInArrow(run, FOUND)
