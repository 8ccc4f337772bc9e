"""License scans by conditional compression.

A candidate block is compressed alone and with each template as a raw zstandard dictionary. Templates are ranked by the
bytes they save, and those that save any are confirmed by comparing wordings word by word: a template's words that the
block lacks, and words between, may be a share of the template's.

Candidates come from the templates themselves. Where at most k of a template's n words differ, n // (k + 1) neighbouring
ones are unchanged; so wherever so many neighbouring words of a template occur in a text, the words around that place are
a block, however lines are wrapped or marked as comments.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import ahocorasick
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Statements, openings and whole texts by license; wordings are fixed values, as their licensors give them.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "bsd-3": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "Released into the public domain under CC0 1.0.",
    "reserved": "All rights reserved.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-2-whole": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mit-whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
}
DIFFERENCE = 0.2
LEVEL = 3
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def aligned(template: list[str], words: list[str]) -> tuple[list[str], list[str], int, int]:
    """The template's words that the block lacks, the block's words between those it shares with the template, and where
    in the block the shared ones begin and end. Shared runs at either end that cost more than they give don't count."""
    runs = [m for m in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
    if not runs:
        return template, [], 0, 0

    def cost(p: int, q: int) -> tuple[int, int]:
        shared = sum(m.size for m in runs[p:q])
        return len(template) - shared + runs[q - 1].b + runs[q - 1].size - runs[p].b - shared, p - q

    p, q = min(((p, q) for p in range(len(runs)) for q in range(p + 1, len(runs) + 1)), key=lambda x: cost(*x))
    runs = runs[p:q]
    lacking = [w for a, b in zip([0, *(m.a + m.size for m in runs)], [*(m.a for m in runs), len(template)]) for w in template[a:b]]
    added = [w for m, n in zip(runs, runs[1:]) for w in words[m.b + m.size : n.b]]
    return lacking, added, runs[0].b, runs[-1].b + runs[-1].size


class Scanner:
    def __init__(self, templates: dict[str, str], difference: float) -> None:
        self.names = sorted(templates)
        self.words = {n: WORD.findall(templates[n].lower()) for n in self.names}
        self.counts = {n: Counter(w) for n, w in self.words.items()}
        self.most = {n: int(difference * len(w) + 1e-9) for n, w in self.words.items()}
        #: Anchors: neighbouring words of templates, with the templates and places that they come from.
        anchors: dict[str, list[tuple[str, int]]] = {}
        for n, words in self.words.items():
            size = max(len(words) // (self.most[n] + 1), 1)
            for i in range(len(words) - size + 1):
                anchors.setdefault(f" {' '.join(words[i : i + size])} ", []).append((n, i))
        self.anchors = ahocorasick.Automaton()
        for text, places in anchors.items():
            self.anchors.add_word(text, (len(text), places))
        self.anchors.make_automaton()
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.with_ = {n: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(templates[n].lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n in self.names}

    def ranked(self, block: str) -> list[tuple[int, str]]:
        """Bytes saved and template, the best first; ties by name."""
        raw = block.lower().encode("utf-8", "surrogatepass")
        alone = len(self.alone.compress(raw))
        return sorted(((alone - len(c.compress(raw)), n) for n, c in self.with_.items()), key=lambda x: (-x[0], x[1]))

    def lacks(self, name: str, there: Counter) -> bool:
        """Whether more of a template's words are missing than may differ."""
        return (self.counts[name] - there).total() > self.most[name]

    def confirm(self, block: str, words: list[str]) -> Iterator[tuple]:
        """License, bytes saved, words lacking and added, and where in words it begins and ends, of all templates that save
        bytes and whose wording is near enough."""
        there = Counter(words)
        near = {n for n in self.names if not self.lacks(n, there)}
        for saved, name in self.ranked(block) if near else []:
            if saved > 0 and name in near:
                lacking, added, begin, end = aligned(self.words[name], words)
                if len(lacking) + len(added) <= self.most[name]:
                    yield name, saved, lacking, added, begin, end

    def windows(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """First and last word, less one, of each place around an anchor that has enough of its template's words."""
        joined, starts, seen = f" {' '.join(words)} ", None, set()
        for end, (length, places) in self.anchors.iter(joined):
            if starts is None:
                starts, at = [], 1
                for w in words:
                    starts.append(at)
                    at += len(w) + 1
            word = bisect_right(starts, end - length + 2) - 1
            for name, i in places:
                if (name, word - i) in seen:
                    continue
                seen.add((name, word - i))
                spare = self.most[name]
                lo, hi = max(word - i - spare, 0), min(word - i + len(self.words[name]) + spare, len(words))
                if not self.lacks(name, Counter(words[lo:hi])):
                    yield lo, hi

    def statements(self, text: str | None) -> list[tuple]:
        """Start of the line where it begins, license, bytes saved, words lacking and added, of each confirmed statement. Of
        statements that share words, the one with the most words less twice its differences is reported; ties go to the
        one with more bytes saved, then the first by name."""
        if not text:
            return []
        lower = [w.lower() for w in WORD.findall(text)]
        blocks = sorted(set(self.windows(lower)))
        if not blocks:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        found = set()
        for lo, hi in blocks:
            block = " ".join(text[spans[lo][0] : spans[hi - 1][1]].split())
            for name, saved, lacking, added, begin, end in self.confirm(block, lower[lo:hi]):
                score = len(self.words[name]) - 2 * (len(lacking) + len(added))
                found.add((-score, -saved, name, lo + begin, lo + end, tuple(lacking), tuple(added)))
        kept, used = [], set()
        for _, saved, name, begin, end, lacking, added in sorted(found):
            if used.isdisjoint(range(begin, end)):
                used.update(range(begin, end))
                kept.append((text.rfind("\n", 0, spans[begin][0]) + 1, name, -saved, list(lacking), list(added)))
        return sorted(kept, key=lambda row: row[:2])


def license_blocks(documents: DataFrame, templates: dict[str, str] = TEMPLATES, difference: float = DIFFERENCE) -> DataFrame:
    """doc_id, start, license, saved (bytes), lacking and added (words) of each block whose license is confirmed. start is
    that of the line where it begins.

    Null and empty texts have no blocks; very long ones are scanned whole, lines of any length alike. Ties are as in
    Scanner.statements. Repeated rows and null ids are each scanned; an empty table gives an empty result; extra columns
    are left out.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, difference)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                rows += [(doc_id, *row) for row in scanner.statements(text if isinstance(text, str) else None)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "license", "saved", "lacking", "added"]).astype({"doc_id": "Int64"})

    return common.documents_only(documents, "doc_id", "text").mapInPandas(scan, "doc_id long, start long, license string, saved int, lacking array<string>, added array<string>")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_blocks(common.read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_scan": op10_license_scan}
