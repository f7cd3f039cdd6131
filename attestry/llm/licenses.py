"""License texts inside documents: MinHash bands over overlapping windows, then exact containment."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from attestry.llm.common import ALNUM, map_text, mix, shingle_hashes, text_slices, word_hashes

#: Words in a shingle, and the share of a template's shingles a window must hold.
SHINGLE, CONTAINMENT = 5, 0.8
#: Chance, at least, that the bands retrieve a window that holds enough of a template.
RETRIEVAL = 0.9995
#: Templates whose sizes are within this factor share their windows.
SPREAD = 0.75

# License notices as they are published.
TEMPLATES = {
    "MIT (notice)": "Released under the MIT License.",
    "MIT (licensed)": "Licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "GPL warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}


def band_settings(least: float, rows: int) -> int:
    """Bands of ``rows`` minima so that windows at this Jaccard similarity are retrieved with chance RETRIEVAL."""
    return math.ceil(math.log(1 - RETRIEVAL) / math.log1p(-(least**rows)))


@dataclass
class Family:
    """Templates of similar size, the windows they are searched in, and their band tables."""

    stride: int
    rows: int
    bands: int
    names: list[str] = field(default_factory=list)
    shingles: list[np.ndarray] = field(default_factory=list)
    keys: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    filters: list[np.ndarray] = field(default_factory=list)


def _shingles(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return shingle_hashes(*word_hashes(np.array([0, len(data)]), data, ALNUM), SHINGLE)[1]


def _band_key(mins: list[np.ndarray]) -> np.ndarray:
    key = mins[0].astype(np.uint64)
    for m in mins[1:]:
        key = (key << np.uint64(32)) ^ (key >> np.uint64(32)) ^ m.astype(np.uint64)
    return key


class Templates:
    """All families, and the multipliers of the minwise hashes they share."""

    def __init__(self, templates: dict[str, str], seed: int = 11):
        sets = {name: np.unique(_shingles(text)) for name, text in templates.items()}
        sets = {name: s for name, s in sets.items() if len(s)}
        self.families: list[Family] = []
        for name in sorted(sets, key=lambda n: (-len(sets[n]), n)):
            size = len(sets[name])
            if not self.families or size < SPREAD * len(self.families[-1].shingles[0]):
                # windows are three strides long, and any run of 2 * stride shingles lies in one of them
                stride = math.ceil(size / 2)
                least_size = max(1, math.ceil(SPREAD * size))
                held = math.ceil(CONTAINMENT * least_size)
                least = held / (3 * stride + least_size - held)
                rows = 2 if size >= 8 else 1
                self.families.append(Family(stride, rows, band_settings(least, rows)))
            self.families[-1].names.append(name)
            self.families[-1].shingles.append(sets[name])
        count = max((f.rows * f.bands for f in self.families), default=0)
        self.factors = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)
        for f in self.families:
            mins = [[(s * a >> np.uint64(32)).min() for a in self.factors[: f.rows * f.bands]] for s in f.shingles]
            for b in range(f.bands):
                key = np.array([_band_key([np.array([m[b * f.rows + r]]) for r in range(f.rows)])[0] for m in mins])
                order = np.argsort(key, kind="stable")
                f.keys.append((key[order], order))
                small = np.zeros(1 << 16, bool)
                small[mix(key) >> np.uint64(48)] = True
                f.filters.append(small)

    def scan(self, offsets: np.ndarray, shingles: np.ndarray) -> list[tuple[int, str, int, int, float]]:
        """(row, template, first shingle, end, containment) of every match, overlapping windows merged."""
        found: dict[tuple[int, str], list[list]] = {}
        counts = np.diff(offsets)
        plans = []
        for f in self.families:
            blocks = -(-counts // f.stride)
            first = np.concatenate([[0], np.cumsum(blocks)])
            row = np.repeat(np.arange(len(counts)), blocks)
            nth = np.arange(first[-1]) - first[:-1][row]
            plans.append((f, offsets[:-1][row] + nth * f.stride, row, np.zeros((0, 2), np.int64), []))
        if not len(shingles):
            return []
        hits: list[list[np.ndarray]] = [[] for _ in plans]
        recent: list[list[np.ndarray]] = [[] for _ in plans]
        for k, factor in enumerate(self.factors):
            permuted = (shingles * factor) >> np.uint64(32)
            permuted = permuted.astype(np.uint32)
            for p, (f, starts, row, _, _) in enumerate(plans):
                if k >= f.rows * f.bands:
                    continue
                least = np.minimum.reduceat(permuted, starts) if f.stride > 1 else permuted[starts]
                window = least.copy()
                for step in (1, 2):
                    if len(least) > step:
                        together = row[:-step] == row[step:]
                        window[:-step] = np.where(together, np.minimum(window[:-step], least[step:]), window[:-step])
                recent[p].append(window)
                if len(recent[p]) == f.rows:
                    band = k // f.rows
                    key = _band_key(recent[p])
                    recent[p].clear()
                    maybe = np.flatnonzero(f.filters[band][mix(key) >> np.uint64(48)])
                    known, order = f.keys[band]
                    lo, hi = np.searchsorted(known, key[maybe], "left"), np.searchsorted(known, key[maybe], "right")
                    for w, a, b in zip(maybe[hi > lo], lo[hi > lo], hi[hi > lo]):
                        hits[p].append(np.array([[w, t] for t in order[a:b]]))
        for (f, starts, row, _, _), own in zip(plans, hits):
            for w, t in np.unique(np.concatenate(own), axis=0) if own else ():
                begin = starts[w]
                end = min(begin + 3 * f.stride, offsets[row[w] + 1])
                inside = np.isin(shingles[begin:end], f.shingles[t])
                share = len(np.unique(shingles[begin:end][inside])) / len(f.shingles[t])
                if share >= CONTAINMENT:
                    at = np.flatnonzero(inside)
                    first, last = begin + at[0] - offsets[row[w]], begin + at[-1] + 1 - offsets[row[w]]
                    runs = found.setdefault((int(row[w]), f.names[t]), [])
                    if runs and first < runs[-1][1]:
                        runs[-1][1], runs[-1][2] = max(runs[-1][1], last), max(runs[-1][2], share)
                    else:
                        runs.append([first, last, share])
        return [(row, name, int(a), int(b), float(share)) for (row, name), runs in found.items() for a, b, share in runs]


def license_scan(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Find passages that hold at least 80 % of a license template's five-word shingles.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; a
    text or template of fewer than five words has one shingle of all of them. The
    window that holds a match is three half-templates long.

    Returns the columns of ``docs`` and ``licenses``: (template, first_word,
    end_word, containment) by position, then name. A column of that name is
    replaced. NULL and empty texts have none; repeated rows are treated alike.

    Scale: one pass without a shuffle. Windows overlap by two thirds at the cost of
    one minimum per block and hash. The templates are an argument and bounded by
    it; bands are set for each template size so that a window with enough of the
    template is retrieved with a chance of RETRIEVAL at least, and every retrieved
    window is checked exactly.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))
    kind = StructType([
        StructField("template", StringType()), StructField("first_word", LongType()), StructField("end_word", LongType()), StructField("containment", DoubleType())])
    arrow = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))

    def make():
        known = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            for base, offsets, data in text_slices(texts, 1 << 20):
                at, words = word_hashes(offsets, data, ALNUM)
                counts = np.diff(at)
                for row, name, first, end, share in sorted(known.scan(*shingle_hashes(at, words, SHINGLE)), key=lambda m: (m[0], m[2], m[1])):
                    out[base + row].append({"template": name, "first_word": first, "end_word": min(end + SHINGLE - 1, int(counts[row])), "containment": share})
            return [pa.array(out, arrow)]

        return work

    return map_text(docs, text_col, [StructField("licenses", ArrayType(kind))], make)
