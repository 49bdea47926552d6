"""License scan: sparse TF-IDF cosine of header lines and licence files to templates, then inheritance by path.

Units of a file are the file as a whole, each of its lines, and every run of consecutive words within a
paragraph that has the length of a template, compared to that one, so a statement is found wherever it begins, on one line or several. A unit is a
sparse vector of word counts times inverse document frequencies over all files; the template of largest
cosine at or above the threshold names the unit's licence, and a file takes its best unit's. Words outside
the templates are counted in SLOTS slots by a hash. A unit whose cosine to a template reaches the threshold
must share words that hold the threshold's square of the template's squared length, so it has one of those words of
the template, rarest first, whose loss would leave less: other units are not weighed. Runs are found by a second bound: without repeated words the
cosine is a quotient of two running sums, and repeated words only lessen it, so only runs whose bound
reaches the threshold are weighed exactly. Runs of very few words must have the words in the template's order.

A file without a licence inherits from the nearest directory above it for which a licence file speaks:
directories are few against files, so they find their ancestor first, by a join on path prefixes, and
files join their directory.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_text, materialise

#: Statements by which files name their licence, titles and texts of licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
WORD_OR_LINE = re.compile(WORD.pattern + r"|\n(?:[^\S\n]*\n)*")  # blank lines are one token with the end of line before them
SLOTS = 1 << 16  # of words outside the templates
WORDS_KEPT = 300_000
BATCH_CHARS = 1 << 20
ORDERED = 5  # runs of fewer words must have a template's words in its order: a bag of three words says little


def terms(text: str) -> list[str]:
    return WORD.findall(text.lower())


VOCABULARY = sorted({t for _, text in TEMPLATES for t in terms(text)})


class Numbers(dict):
    """word -> its number: its place in the vocabulary, or behind that a slot; kept for words met before."""

    def __init__(self) -> None:
        super().__init__({w: i for i, w in enumerate(VOCABULARY)})

    def __missing__(self, word: str) -> int:
        if word[0] == "\n":
            return -word.count("\n")
        out = len(VOCABULARY) + zlib.crc32(word.encode("utf-8", "surrogatepass")) % SLOTS
        if len(self) < WORDS_KEPT:
            self[word] = out
        return out


def document_frequency(files: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all files (column t) each number occurs, and how many files there are."""
    size = len(VOCABULARY) + SLOTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, total = Numbers(), np.zeros(size + 1, np.int64)
        for part in batches:
            for t in part["t"]:
                total[np.unique(np.array([known[w] for w in terms(t)], np.int64))] += 1
                total[size] += 1
        some = np.nonzero(total)[0]
        yield pd.DataFrame({"i": some, "n": total[some]})

    out = np.zeros(size + 1, np.int64)
    for r in files.mapInPandas(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # size + 1 rows at most
        out[r["i"]] = r["n"]
    return out[:size], int(out[size])


class Templates:
    """Unit vectors of the templates under given document frequencies of all numbers."""

    def __init__(self, frequency: np.ndarray, files: int):
        self.need: np.ndarray | None = None
        self.idf = np.log(1 + max(files, 1) / (1 + frequency))
        known = Numbers()
        self.ids = [np.array([known[w] for w in terms(text)], np.int64) for _, text in TEMPLATES]
        self.weights = np.zeros((len(VOCABULARY), len(TEMPLATES)))  # what one more of a word adds to the product with a template
        for k, ids in enumerate(self.ids):
            word, n = np.unique(ids, return_counts=True)
            x = n * self.idf[word]
            self.weights[word, k] = self.idf[word] * x / math.sqrt((x * x).sum())
        self.lengths = sorted({len(x) for x in self.ids})

    def needed(self, threshold: float) -> np.ndarray:
        """For each number whether it is one of the words without all of which no unit reaches the threshold for some template."""
        out = np.zeros(len(VOCABULARY) + SLOTS, bool)
        for ids in self.ids:
            word, n = np.unique(ids, return_counts=True)
            mass = (n * self.idf[word]) ** 2
            mass = mass / mass.sum()
            rare = np.argsort(-self.idf[word], kind="stable")
            left = 1 - np.cumsum(mass[rare])
            out[word[rare[: int((left >= threshold**2 - 1e-9).sum()) + 1]]] = True
        return out

    def cosines(self, ids: np.ndarray) -> np.ndarray:
        """The cosine of one unit to each template."""
        word, n = np.unique(ids, return_counts=True)
        x = n * self.idf[word]
        own = word < len(VOCABULARY)
        return n[own] @ self.weights[word[own]] / (math.sqrt((x * x).sum()) or 1.0)

    def scan(self, texts: list[str], known: Numbers, threshold: float) -> list[tuple[int, float, int] | None]:
        """For each text the template of its best unit, the cosine and the unit's line from 1; None below the threshold.

        Of units of equal cosine (to 12 places) the earliest line counts, then the first template.
        """
        found: list[tuple | None] = [None] * len(texts)
        tokens = [np.array([known[w] for w in WORD_OR_LINE.findall(t.lower())], np.int64) for t in texts]
        needed = self.needed(threshold) if self.need is None else self.need
        self.need = needed
        some = [f for f, x in enumerate(tokens) if needed[x[x >= 0]].any()]
        if not some:
            return found
        x = np.concatenate([tokens[f] for f in some])
        files = np.repeat(some, [len(tokens[f]) for f in some])
        # Negative numbers are ends of lines; two or more at once end a paragraph.
        ends = np.maximum(-x, 0)
        first = np.r_[True, files[1:] != files[:-1]]
        before = np.cumsum(ends) - ends
        lines = before - np.repeat(before[first], np.diff(np.r_[np.nonzero(first)[0], len(x)])) + 1
        blocks = np.cumsum((ends > 1) | first)
        word = x >= 0
        x, files, lines, blocks = x[word], files[word], lines[word], blocks[word]
        rare = np.r_[0, np.cumsum(needed[x])]
        own = x < len(VOCABULARY)
        w = np.where(own[:, None], self.weights[np.where(own, x, 0)], 0.0)
        sums = np.vstack([np.zeros(len(TEMPLATES)), np.cumsum(w, axis=0)])
        squares = np.r_[0.0, np.cumsum(self.idf[x] ** 2)]
        # From, to: lines, whole files, and the runs of each template's length within a paragraph.
        line = np.r_[0, np.nonzero((lines[1:] != lines[:-1]) | (files[1:] != files[:-1]))[0] + 1, len(x)]
        whole = np.r_[0, np.nonzero(files[1:] != files[:-1])[0] + 1, len(x)]
        units = [(line[:-1], line[1:], np.arange(len(TEMPLATES))), (whole[:-1], whole[1:], np.arange(len(TEMPLATES)))]
        for n in self.lengths:
            start = np.arange(max(0, len(x) - n + 1))
            start = start[blocks[start] == blocks[start + n - 1]]
            units.append((start, start + n, np.array([k for k, t in enumerate(self.ids) if len(t) == n])))
        seen = set()
        for start, end, which in units:
            may = rare[end] > rare[start]
            start, end = start[may], end[may]
            bound = (sums[end][:, which] - sums[start][:, which]) / np.sqrt(np.maximum(squares[end] - squares[start], 1e-12))[:, None]
            for i in np.nonzero((bound >= threshold - 1e-9).any(1))[0].tolist():
                a, b = int(start[i]), int(end[i])
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                cos = np.round(self.cosines(x[a:b]), 12)
                if len(which) < len(TEMPLATES) and b - a < ORDERED:
                    cos = np.array([float(np.array_equal(x[a:b], t)) for t in self.ids])
                elif len(which) < len(TEMPLATES):
                    cos[np.setdiff1d(np.arange(len(cos)), which)] = 0
                k = int(cos.argmax())
                f, score, at = int(files[a]), float(cos[k]), int(lines[a])
                if score >= threshold and (found[f] is None or (-score, at, k) < (-found[f][1], found[f][2], found[f][0])):
                    found[f] = (k, score, at)
        return found


def scan_licenses(files: DataFrame, path_col: str, text_col: str, id_col: str, speaks: Column, threshold: float = 0.75) -> DataFrame:
    """One row a file: doc_id, path, license, score, line, how ("own", "inherited" or "none"), from_dir.

    speaks: true for files whose licence holds for their directory and those below it; of several in a
    directory the largest score decides, then the smallest path, then the smallest id. Ties of score in a file
    go to the earliest line. Null text counts as empty, a null path as "" (the root); a file inherits
    from its own directory first, then from the nearest one above, the root included. Rows that repeat
    an id or a path are reported each. An empty table gives no rows.
    """
    path = F.coalesce(F.col(path_col), F.lit(""))
    src = files.select(id_text(F.col(id_col)).alias("doc_id"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.coalesce(speaks, F.lit(False)).alias("speaks"))
    model = Templates(*document_frequency(src.select("t")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Numbers()
        for part in batches:
            texts, found, at = part["t"].to_list(), [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_CHARS):
                    size += len(texts[to])
                    to += 1
                found += model.scan(texts[at:to], known, threshold)
                at = to
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"], "path": part["path"], "speaks": part["speaks"], "own": [TEMPLATES[x[0]][0] if x else None for x in found],
                    "score": pd.array([round(x[1], 6) if x else None for x in found], "Float64"), "line": pd.array([x[2] if x else None for x in found], "Int64"),
                }
            )

    own = materialise(id_back(src.mapInPandas(run, "doc_id string, path string, speaks boolean, own string, score double, line long"), "doc_id"), "licences")
    up = lambda p: F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit(""))
    own = own.withColumn("dir", up(F.col("path")))
    order = F.struct((-F.col("score")).alias("a"), F.col("path"), F.col("doc_id"), F.col("own"))
    voice = own.filter("speaks AND own IS NOT NULL").groupBy("dir").agg(F.min(order).alias("v")).select(F.col("dir").alias("from_dir"), F.col("v.own").alias("theirs"), (-F.col("v.a")).alias("their_score"))
    dirs = own.select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    climbs = dirs.select("dir", F.posexplode(above).alias("depth", "from_dir"))
    near = climbs.join(voice, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "theirs", "their_score")).alias("n"))
    near = materialise(near.select(F.col("dir").alias("d"), "n"), "directories")
    out = own.join(near, own.dir == near.d, "left")
    mine, any_ = F.col("own").isNotNull(), F.col("n").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("own", "n.theirs").alias("license"), F.coalesce("score", "n.their_score").alias("score"), "line",
        F.when(mine, "own").when(any_, "inherited").otherwise("none").alias("how"), F.when(mine, F.col("dir")).otherwise(F.col("n.from_dir")).alias("from_dir"),
    )
