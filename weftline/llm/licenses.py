"""Licence scans: a trained paragraph classifier over sparse word n-grams with an unknown class, whose findings a template must confirm."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

# Notices by which works name their licence, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD License."),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU GPL v3."),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "Licensed under the MIT license."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0."),
    "proprietary": ("All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
FAMILIES = [*sorted(TEMPLATES), "unknown"]
#: Paragraphs the unknown class is fitted on at most, from documents with the smallest hash of their id.
FIT_DOCS, FIT_PARAGRAPHS = 400, 4000
#: A prediction stands with this probability, if a template of its family shares this part of its own word pairs.
LEAST_PROBABILITY, LEAST_SHARED = 0.5, 0.6

_word = re.compile(r"[a-z0-9]+")
_line = re.compile(r"[^\n]+")


def _grams(words: list[str], anchors: set[str]) -> set[str]:
    """Word 1- to 3-grams that hold an anchor."""
    out: set[str] = set()
    for i, w in enumerate(words):
        if w in anchors:
            for n in (1, 2, 3):
                for a in range(max(0, i - n + 1), min(i, len(words) - n) + 1):
                    out.add(" ".join(words[a : a + n]))
    return out


class LicenceModel:
    """Multinomial logistic regression over n-grams that hold an anchor: a word of a template that ordinary paragraphs hardly use."""

    def __init__(self, ordinary: list[str], epochs: int = 300) -> None:
        plain = [_word.findall(p.lower()) for p in ordinary]
        examples: list[tuple[list[str], int]] = []
        for k, family in enumerate(FAMILIES[:-1]):
            for t in TEMPLATES[family]:
                w = _word.findall(t.lower())
                # whole, and with words before and behind it, as notices stand in longer paragraphs
                examples += [(w, k), (["copyright", "2020", "the", "authors", *w], k), (w + ["see", "file"], k)]
        df: dict[str, int] = {}
        for w in plain:
            for x in set(w):
                df[x] = df.get(x, 0) + 1
        self.anchors = {x for w, _ in examples for x in w if df.get(x, 0) <= 0.01 * len(plain) and not x.isdigit()}
        self.anchors -= {"copyright", "authors", "see", "file"}
        # single words of the notices say nothing yet, and neither do ordinary paragraphs
        examples += [([x], len(FAMILIES) - 1) for x in sorted(self.anchors)] + [(w, len(FAMILIES) - 1) for w in plain[:2000]]
        rows = [_grams(w, self.anchors) for w, _ in examples]
        self.index = {g: i for i, g in enumerate(sorted(set().union(*rows)))}
        x = np.zeros((len(rows), len(self.index) + 1), np.float32)
        for i, r in enumerate(rows):
            at = [self.index[g] for g in r]
            x[i, at] = 1 / max(1, len(at)) ** 0.5
        x[:, -1] = 1
        y = np.array([k for _, k in examples])
        self.w = np.zeros((x.shape[1], len(FAMILIES)), np.float32)
        share = np.bincount(y, minlength=len(FAMILIES)).astype(np.float32)
        weight = (1 / np.sqrt(share))[y][:, None]
        x, weight, hot = x, weight / weight.sum(), np.eye(len(FAMILIES), dtype=np.float32)[y]
        for _ in range(epochs):
            self.w -= 8.0 * (x.T @ ((self._soft(x @ self.w) - hot) * weight) + 1e-5 * self.w)
        # one temperature for all classes, fitted on the notices with their last words cut off: probabilities of notices
        # that are not quite a template's
        cut = [(w[: max(3, len(w) * 3 // 4)], k) for w, k in examples if k < len(FAMILIES) - 1] + [(w, len(FAMILIES) - 1) for w in plain[2000:]]
        z, yc = np.stack([self._logits(w) for w, _ in cut]), np.array([k for _, k in cut])
        self.temperature = min((float(-np.log(self._soft(z / t)[np.arange(len(yc)), yc] + 1e-9).mean()), t) for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0))[1]
        self.pairs = {f: [set(zip(w, w[1:], strict=False)) for w in (_word.findall(t.lower()) for t in TEMPLATES[f])] for f in TEMPLATES}
        self.all_pairs = set().union(*(t for ts in self.pairs.values() for t in ts))
        #: Words of the lines between a notice's first and last: twice the longest template leaves room for words of other wordings.
        self.most_between = 2 * max(len(_word.findall(t.lower())) for ts in TEMPLATES.values() for t in ts)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def _logits(self, words: list[str]) -> np.ndarray:
        at = [self.index[g] for g in _grams(words, self.anchors) if g in self.index]
        return self.w[-1] + (self.w[at].sum(axis=0) / len(at) ** 0.5 if at else 0)

    def _shared(self, family: str, pairs: set) -> int:
        """Word pairs shared with the template of the family that shares most, of those that confirm; 0 if none does."""
        return max((n for t in self.pairs[family] if (n := len(t & pairs)) >= LEAST_SHARED * len(t)), default=0)

    def paragraph(self, words: list[str]) -> tuple[int, str, float] | None:
        """Pairs shared, family and probability of a confirmed notice, else None."""
        pairs = self.all_pairs.intersection(zip(words, words[1:], strict=False))
        if not any(self._shared(f, pairs) for f in self.pairs):
            return None
        p = self._soft(self._logits(words) / self.temperature)
        for k in np.argsort(-p)[:2]:
            if FAMILIES[k] != "unknown" and p[k] >= LEAST_PROBABILITY and (n := self._shared(FAMILIES[k], pairs)):
                return n, FAMILIES[k], float(p[k])
        return None

    def spans(self, text: str) -> list[dict]:
        """Notices of one line or of several adjacent ones, none of them without words; those that share most with a template first, then the shortest."""
        if self.anchors.isdisjoint(_word.findall(text.lower())):
            return []
        lines = [(m.start(), m.end(), _word.findall(m[0].lower())) for m in _line.finditer(text)]
        found = []
        for i, (_, end, words) in enumerate(lines):
            words, j, between = list(words), i, 0
            # a notice begins in its first line: with a pair in it, or across its end
            if not words or self.all_pairs.isdisjoint(zip(words, [*words[1:], *(lines[i + 1][2][:1] if i + 1 < len(lines) else [])], strict=False)):
                continue
            while True:
                if not self.anchors.isdisjoint(words) and (got := self.paragraph(words)):
                    found.append((-got[0], j - i, i, j, got[1:]))
                between += len(lines[j][2]) if j > i else 0
                j += 1
                if j == len(lines) or not lines[j][2] or text.count("\n", end, lines[j][0]) > 1 or between > self.most_between:
                    break
                end = lines[j][1]
                words += lines[j][2]
        taken: set[int] = set()
        out = []
        for _, _, i, j, (family, p) in sorted(found):
            if taken.isdisjoint(range(i, j + 1)):
                taken.update(range(i, j + 1))
                out.append({"start": lines[i][0], "stop": lines[j][1], "family": family, "probability": p})
        return sorted(out, key=lambda x: x["start"])


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, notices (start, stop, family, probability; offsets in code points) and families (sorted, distinct) of every row of docs.

    Whole texts are read; a notice is a line or adjacent lines, as far as none is without words. The model is fitted on
    the templates and on lines of at most FIT_DOCS documents that look like no template; a very long line is one line.
    Null or empty text: no notices. Rows stay as they are; other columns are left out.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = d.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(FIT_DOCS).select("doc_id").distinct()
    lines = d.join(F.broadcast(ids), "doc_id").select(F.explode(F.split("text", "\n")).alias("p")).filter("length(p) between 1 and 2000 and not lower(p) rlike 'licen[sc]e|copyright|permi[st]|rights reserved'")
    ordinary = [r[0] for r in lines.orderBy(F.xxhash64("p"), "p").limit(FIT_PARAGRAPHS).collect()]
    shared = spark.sparkContext.broadcast(LicenceModel(ordinary))

    def make():
        m = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            got = [m.spans(t) for t in b.column("text").to_pylist()]
            return pa.record_batch([b.column("doc_id"), pa.array(got, kind)], ["doc_id", "notices"])

        return f

    out = arrow_map(d, make, "doc_id long, notices array<struct<start:int,stop:int,family:string,probability:double>>")
    return out.withColumn("families", F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"]))))
