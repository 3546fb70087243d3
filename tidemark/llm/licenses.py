"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment decides.

Words are runs of letters and digits, in lower case; shingles are of five words. A template of t words
belongs to the class of the least power of two from 8 on that is t or more. Each text is cut from its own
first word into blocks of each class's size, and two neighbouring blocks are a window, so every passage of t
words lies whole in one, and what is found in a text does not depend on the texts beside it. Such a window has at most 4t shingles; if it holds 3/4 of a template's, their Jaccard similarity is
0.17 or more, and of ``BANDS`` bands of one row at least one agrees with a probability over
1 - (1 - 0.17) ** 64 = 0.99999. A band that agrees means a shingle in common, so little is retrieved in vain.

A retrieved template is a match where the window holds at least 3/4 of its distinct shingles; it goes
from the first to the last of them. Templates are short notices and, in ``templates/``, whole license texts. Matches of one template that overlap are one. Nulls and empty texts
have none, repeated rows give repeated rows, texts are scanned whole, extra columns are not looked at.
"""

from __future__ import annotations

from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_schema, lean, slices, spans
from tidemark.llm.words import SIGNS, Texts, mix

#: Notices of licenses, as they are commonly published.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "gpl-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "cc0-1.0": "Licensed under CC0 1.0.",
}
CREATIVE_COMMONS = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
for _kind, _title in CREATIVE_COMMONS.items():
    for _version, _port in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES[f"cc-{_kind}-{_version}"] = f"Licensed under CC {_kind.upper()} {_version}."
        TEMPLATES[f"cc-{_kind}-{_version}-notice"] = f"This work is licensed under a Creative Commons {_title} {_version} {_port} License."
SHINGLE, BANDS, SHARE = 5, 64, 0.75


def whole_texts() -> dict[str, str]:
    """The license texts that lie beside this module, by name."""
    folder = resources.files(__package__) / "templates"
    return {f"{f.name.removesuffix('.txt')}-text": f.read_text(encoding="utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name)}


SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
NEVER = np.uint64((1 << 64) - 1)


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.names, self.sets, self.classes = list(texts), [], {}
        parsed = Texts(pa.array(list(texts.values())), lower=True, gaps=SIGNS)
        grams = parsed.sequences(SHINGLE)
        for i, name in enumerate(self.names):
            n, first = int(parsed.words[i]), int(parsed.first[i])
            if n < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.sets.append(np.unique(grams[first : first + n - SHINGLE + 1]))
            size = 8
            while size < n:
                size *= 2
            self.classes.setdefault(size, []).append(i)
        self.bands = np.array([[mix(s ^ seed).min() for seed in SEEDS] for s in self.sets])
        self.all = np.unique(np.concatenate(self.sets))

    def retrieved(self, grams: np.ndarray, words: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first word, end) of the windows with a band in common.

        ``words``: of each text; ``grams``: one for each word, NEVER where a text ends before it does.
        """
        found: set[tuple[int, int, int]] = set()
        if not len(grams):
            return found
        most = max(self.classes)
        levels = []  # of each size: where its blocks begin among those of half the size, which go on in their text, and at which word
        blocks, first = -(-words // 8), np.cumsum(words) - words
        first, blocks = first[words > 0], blocks[words > 0]
        size, half = 8, first
        while size <= most:
            start = np.repeat(half, blocks) + (8 if size == 8 else 2) * spans(blocks)
            goes_on = np.ones(len(start), bool)
            goes_on[np.cumsum(blocks) - 1] = False
            levels.append((size, start, goes_on, np.repeat(first, blocks) + size * spans(blocks)))
            half, blocks, size = np.cumsum(blocks) - blocks, -(-blocks // 2), 2 * size
        for j, seed in enumerate(SEEDS):
            low = np.where(grams == NEVER, NEVER, mix(grams ^ seed))
            for size, start, goes_on, word in levels:
                low = np.minimum.reduceat(low, start)
                window = low.copy()
                window[:-1][goes_on[:-1]] = np.minimum(low[:-1], low[1:])[goes_on[:-1]]
                for t in self.classes.get(size, ()):
                    for w in np.flatnonzero(window == self.bands[t, j]).tolist():
                        found.add((t, int(word[w]), int(word[w + 1 if goes_on[w] else w]) + size))
        return found

    def matches(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Of each text its matches: (first word, end, template), in order."""
        texts = Texts(column, lower=True, gaps=SIGNS)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(texts.n)]
        grams = np.full(len(texts.hash), NEVER)
        if len(grams) >= SHINGLE:
            grams[: len(grams) - SHINGLE + 1] = np.where(texts.whole(SHINGLE), texts.sequences(SHINGLE), NEVER)
        for t, lo, hi in self.retrieved(grams, texts.words):
            text = int(texts.text[lo])
            first = int(texts.first[text])
            hi = min(hi, first + int(texts.words[text]))
            hit = lo + np.flatnonzero(np.isin(grams[lo:hi], self.sets[t]))
            if len(np.unique(grams[hit])) >= SHARE * len(self.sets[t]):
                out[text].append((int(hit[0]) - first, int(hit[-1]) - first + SHINGLE, t))
        return [self.merged(m) for m in out]

    @staticmethod
    def merged(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for lo, hi, t in sorted(matches, key=lambda m: (m[2], m[0])):
            if out and out[-1][2] == t and lo < out[-1][1]:
                out[-1] = out[-1][0], max(hi, out[-1][1]), t
            else:
                out.append((lo, hi, t))
        return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of matches and the matches as ``template:first word:end``, comma-joined."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_matches bigint, matches string"
    arrow = arrow_schema(T._parse_datatype_string(schema))
    texts = templates or TEMPLATES | whole_texts()

    def run(batches):
        known = Templates(texts)
        for batch in batches:
            for part in slices(batch, 8192, 4 << 20):
                found = known.matches(part.column(1))
                told = [",".join(f"{known.names[t]}:{lo}:{hi}" for lo, hi, t in m) for m in found]
                cols = [part.column(0).cast(arrow.field(0).type), pa.array([len(m) for m in found], pa.int64()), pa.array(told, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), schema)
