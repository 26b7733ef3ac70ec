"""License scans: MinHash bands over overlapping windows of a text retrieve templates, exact containment verifies.

A template of t shingles belongs to the class of the next power of two B. Texts are cut into blocks of B shingles, and
every two blocks in a row are a window, so each occurrence lies whole in some window. A window that holds a share
s of a template's shingles has a Jaccard similarity of at least s * t / (2 B + t), which is 0.16 at s = 0.8; with 32
bands of one row, one collides with probability 1 - 0.84 ** 32 = 0.996 at worst, and 0.9997 for a whole template.
What collides is verified by the share of the template's shingles that the window really holds.

The templates are a parameter, so what each task holds does not grow with the documents. The work is row by row.

Defined results: null and empty texts, and those shorter than a shingle, match nothing; a license found several times
in a text, or by several templates, is one row with the best share and the first place of it; repeated rows give their
matches each; an empty table gives no rows; other columns pass through in ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import with_row

# Notices by which texts declare a public license.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

WORD = re.compile(r"[^\W_]+")
SHINGLE = 3
BANDS = 32
CONTAINED = 0.8

#: Words handled at once; groups of whole texts reach it, so it changes no result.
GROUP = 1 << 19
REMEMBERED = 500_000

MIX = np.uint64(0xFF51AFD7ED558CCD)
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        code = xxhash.xxh64_intdigest(word.lower())
        if len(self) < REMEMBERED:
            self[word] = code
        return code


@lru_cache(maxsize=1)
def _codes() -> _Codes:
    return _Codes()


def _word_codes(text: str) -> np.ndarray:
    words = WORD.findall(text)
    return np.fromiter(map(_codes().__getitem__, words), np.uint64, len(words))


def _shingles(codes: np.ndarray) -> np.ndarray:
    found = np.zeros(max(0, len(codes) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        found = (found ^ codes[k : k + len(found)]) * MIX
        found ^= found >> np.uint64(32)
    return found


def _seeds() -> np.ndarray:
    return np.random.default_rng(11).integers(1 << 63, size=BANDS, dtype=np.uint64)


def _permuted(shingles: np.ndarray, seed: np.uint64) -> np.ndarray:
    found = (shingles ^ seed) * MIX
    return found ^ (found >> np.uint64(29))


class Templates:
    """Classes of templates: the block length, and per band the least values and what they belong to."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in templates]
        self.shingles = [np.unique(_shingles(_word_codes(text))) for _, text in templates]
        self.classes: dict[int, list[int]] = {}
        for i, own in enumerate(self.shingles):
            if len(own):
                self.classes.setdefault(1 << max(0, int(len(own) - 1).bit_length()), []).append(i)
        self.seeds = _seeds()

    def candidates(self, shingles: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(template, start, end)`` of the windows that collide with a template in some band."""
        hits: dict[int, set[tuple[int, int]]] = {size: set() for size in self.classes}
        for seed in self.seeds:
            values = _permuted(shingles, seed)
            done, least = 1, values
            for size in sorted(self.classes):
                # Blocks of one class are pairs of blocks of the one before.
                while done < size:
                    if len(least) % 2:
                        least = np.append(least, NOTHING)
                    least, done = np.minimum(least[::2], least[1::2]), done * 2
                windows = np.minimum(least, np.append(least[1:], NOTHING))
                owners: dict[int, list[int]] = {}
                for i in self.classes[size]:
                    owners.setdefault(int(_permuted(self.shingles[i], seed).min()), []).append(i)
                # Few windows pass the first test on 16 bits.
                quick = np.zeros(1 << 16, bool)
                quick[[v & 0xFFFF for v in owners]] = True
                for w in np.flatnonzero(quick[windows.astype(np.uint16)]).tolist():
                    hits[size].update((i, w) for i in owners.get(int(windows[w]), ()))
        for size, found in hits.items():
            for i, w in sorted(found):
                yield i, w * size, (w + 2) * size

    def matches(self, texts: list[str]) -> list[list[dict]]:
        """Per text: license, share of the template found, and the word where it begins."""
        out: list[list[dict]] = [[] for _ in texts]
        held: list[np.ndarray] = []
        owner: list[int] = []
        words = 0
        for k, text in enumerate(texts):
            own = _shingles(_word_codes(text))
            if len(own):
                held.append(own)
                owner.append(k)
                words += len(own)
            if held and (words >= GROUP or k == len(texts) - 1):
                self._match(held, owner, out)
                held, owner, words = [], [], 0
        if held:
            self._match(held, owner, out)
        return out

    def _match(self, held: list[np.ndarray], owner: list[int], out: list[list[dict]]) -> None:
        shingles = np.concatenate(held)
        ends = np.cumsum([len(h) for h in held])
        best: dict[tuple[int, str], tuple[float, int]] = {}
        for i, start, end in self.candidates(shingles):
            wanted = self.shingles[i]
            at = int(np.searchsorted(ends, start, side="right"))
            while at < len(ends) and (first := int(ends[at - 1]) if at else 0) < end:
                a, b = max(start, first), min(end, int(ends[at]))
                places = np.flatnonzero(np.isin(shingles[a:b], wanted))
                share = len(np.unique(shingles[a:b][places])) / len(wanted)
                if share >= CONTAINED:
                    key, found = (owner[at], self.names[i]), (-share, a - first + int(places[0]))
                    best[key] = min(best.get(key, found), found)
                at += 1
        for (k, name), (share, place) in sorted(best.items()):
            out[k].append({"license": name, "containment": -share, "word": place})


@lru_cache(maxsize=4)
def prepared(templates: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(templates)


def scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row``, ``license``, ``containment`` and ``word``: a row for each license found in a document."""

    @F.arrow_udf("array<struct<license:string,containment:double,word:long>>")
    def scan(texts: pa.Array) -> pa.Array:
        found = prepared(templates).matches([t or "" for t in texts.to_pylist()])
        return pa.array(found, pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("word", pa.int64())])))

    df = with_row(docs, keep, text=F.col(text)).select("row", F.explode(scan("text")).alias("found"))
    return df.select("row", "found.*")
