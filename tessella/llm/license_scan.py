"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import Scratch, blocks_for
from .decontam import words
from .wordhash import BASES, WordHashes, column, distinct, mix, rolling, spans, text_chunks

# Well-known notices of public licenses.
TEMPLATES = {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
    "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
    "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
    "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software.",
}


def window_class(n: int) -> int:
    """The least length of a grid of steps of a quarter that is ``n`` or more: templates of one class share their windows."""
    size = 1
    while size < n:
        size = max(size + 1, size * 5 // 4)
    return size


class Scanner:
    """Templates as band buckets. Those of a class of n words are sought in windows of n + s words, one every s = n / 4
    words, so one of them holds each occurrence whole; with the margin and the class's width, an occurrence of 0.8 of a
    template leaves a Jaccard similarity of 0.45 or more."""

    def __init__(self, templates: dict[str, str], width: int, bands: int, rows: int, least: float, seed: int = 5):
        self.width, self.bands, self.rows, self.least = width, bands, rows, least
        self.salts = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed))
        self.hashes, self.names, self.sets, self.lengths = WordHashes(), [], [], []
        self.buckets: dict[int, list[dict[tuple, list[int]]]] = {}
        of_class: dict[int, list[np.ndarray]] = {}
        for name, text in sorted(templates.items()):
            w = words(text.encode())
            if len(w) < width:
                raise ValueError(f"template {name} has fewer than {width} words")
            s, n = distinct(rolling(self.hashes.of([w]), width, BASES[0])), window_class(len(w))
            table = self.buckets.setdefault(n, [{} for _ in range(bands)])
            for t, key in zip(table, self.keys(s), strict=True):
                t.setdefault(key, []).append(len(self.names))
            of_class.setdefault(n, []).append(s)
            self.names.append(name)
            self.sets.append(s)
            self.lengths.append(len(w))
        self.of_class = {n: distinct(np.concatenate(x)) for n, x in of_class.items()}
        self.all = distinct(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)

    def keys(self, shingles: np.ndarray) -> list[tuple]:
        least = mix(shingles[:, None] ^ self.salts[None, :]).min(axis=0).reshape(self.bands, self.rows)
        return [tuple(x) for x in least.tolist()]

    def scan(self, shingles: np.ndarray, hits: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(name, first word, end, containment) of each occurrence. ``hits`` are the places of any template's shingles:
        windows without one can't share a least hash and are passed over."""
        regions: dict[int, list[list[int]]] = {}
        for n, table in self.buckets.items():
            step = max(1, n // 4)
            size = n + step - self.width + 1
            mine = hits[_among(shingles[hits], self.of_class[n])]
            starts: set[int] = set()
            for h in mine.tolist():
                starts.update(range(max(0, -(-(h - size + 1) // step)), h // step + 1))
            for start in sorted(starts):
                seen: set[int] = set()
                a, b = start * step, start * step + size
                for t, key in zip(table, self.keys(distinct(shingles[a:b])), strict=True):
                    seen.update(t.get(key, ()))
                for k in seen:  # windows of a template that touch are one region
                    mine_of = regions.setdefault(k, [])
                    if mine_of and a <= mine_of[-1][1]:
                        mine_of[-1][1] = b
                    else:
                        mine_of.append([a, b])
        return [x for k, parts in regions.items() for a, b in parts for x in self.occurrences(k, shingles, hits[(hits >= a) & (hits < b)])]

    def occurrences(self, k: int, shingles: np.ndarray, hits: np.ndarray) -> Iterator[tuple[str, int, int, float]]:
        """Exact containment, occurrence by occurrence: of the windows of up to the template's length and a quarter, the
        fullest and then shortest, until a quarter of the length brings none better."""
        at = hits[_among(shingles[hits], self.sets[k])].tolist()
        value, n = shingles[at].tolist(), len(self.sets[k])
        margin = max(1, self.lengths[k] // 4)
        reach = self.lengths[k] + margin - self.width + 1
        have: Counter[int] = Counter()
        left, best = 0, (0, 0, 0)
        for right in range(len(at) + 1):
            if best[0] and (right == len(at) or at[right] - at[best[2]] > margin):
                full, a, b = best
                yield self.names[k], at[a], at[b] + self.width, full / n
                have, left, best = Counter(value[b + 1 : right]), b + 1, (0, 0, 0)
            if right == len(at):
                return
            have[value[right]] += 1
            while at[right] - at[left] >= reach or have[value[left]] > 1:  # what comes again isn't where an occurrence begins
                have[value[left]] -= 1
                if not have[value[left]]:
                    del have[value[left]]
                left += 1
            if len(have) >= self.least * n and (len(have) > best[0] or len(have) == best[0] and at[right] - at[left] < at[best[2]] - at[best[1]]):
                best = len(have), left, right


def _among(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(of, values), max(0, len(of) - 1))
    return of[at] == values if len(of) else np.zeros(len(values), bool)


def resolve(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Of occurrences that overlap, the one with the highest containment, then the longest; in order of place."""
    out: list[tuple[str, int, int, float]] = []
    for x in sorted(set(found), key=lambda x: (-x[3], x[1] - x[2], x[1], x[0])):
        if all(x[2] <= y[1] or y[2] <= x[1] for y in out):
            out.append(x)
    return sorted(out, key=lambda x: (x[1], x[0]))


MATCH = StructType([StructField("name", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("containment", DoubleType())])
FOUND = StructField("licenses", ArrayType(MATCH))
ARROW = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))


def _dicts(found: list[tuple[str, int, int, float]]) -> list[dict]:
    return [dict(zip(("name", "start", "end", "containment"), x, strict=True)) for x in found]


def _scan(make, text_col: str, kept: list[str], final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = make()
        for batch in batches:
            texts, out = column(batch, text_col).cast(pa.binary()).to_pylist(), []
            for a, b in text_chunks(texts):
                cut = [words(t) for t in texts[a:b]]
                row, inside = spans(cut, scanner.width)
                hashes = rolling(scanner.hashes.of(cut), scanner.width, BASES[0])
                first = np.searchsorted(row, np.arange(len(cut) + 1))
                places = np.flatnonzero(_among(hashes, scanner.all) & inside)
                edges = np.searchsorted(places, first)
                for i in range(len(cut)):
                    mine = places[edges[i] : edges[i + 1]]
                    got = scanner.scan(hashes[first[i] : first[i] + len(cut[i]) - scanner.width + 1], mine - first[i]) if len(mine) else []
                    out.append(_dicts(resolve(got) if final else got))
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in kept], pa.array(out, ARROW)], [*kept, "licenses"])

    return run


def _resolved(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_dicts(resolve([(x["name"], x["start"], x["end"], x["containment"]) for x in found or []])) for found in column(batch, "__found").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in kept], pa.array(out, ARROW)], [*kept, "licenses"])

    return run


def scan_licenses(
    df: DataFrame,
    templates: dict[str, str] | DataFrame | None = None,
    width: int = 5,
    bands: int = 48,
    rows: int = 2,
    least: float = 0.8,
    part_bytes: int = 4 << 20,
    text_col: str = "text",
) -> DataFrame:
    """Find license notices in whole texts.

    Words are runs of letters and digits, A-Z lower-cased; shingles have ``width`` words. A window at Jaccard similarity 0.45
    to a template, the least that margin and class of length leave, shares one of 48 bands of 2 with probability 0.99998; an
    occurrence has ``least`` of the template's distinct shingles within its length and a quarter. Occurrences of one template
    are told apart by its own shingles; of those that overlap, the highest containment wins, then the longest. ``templates`` are given or
    a table of (name, text), of any size: they are searched in parts of about ``part_bytes``, one broadcast part at a time; beyond
    one part, only texts with matches are written between the passes.

    Returns the columns of ``df`` but that named ``licenses``, which is added: array of (name, start, end, containment)
    in order of place, in words. Null and empty texts and texts of fewer words than a shingle have none; rows are judged
    one by one, so repeated ids and rows don't matter; an empty table gives no rows. Templates of fewer words than a shingle raise;
    those of a table with null or no text are passed over.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c != "licenses"]
    docs = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType([*[df.schema[c] for c in kept], FOUND])
    if not isinstance(templates, DataFrame):
        given = TEMPLATES if templates is None else templates
        Scanner(given, width, bands, rows, least)  # reports what is wrong with the templates
        return docs.mapInArrow(_scan(lambda: Scanner(given, width, bands, rows, least), text_col, kept, True), schema)

    known = templates.select(F.col("name").cast("string").alias("name"), F.col("text").cast("string").alias("text")).where("length(text) > 0").distinct()
    parts = blocks_for(known.agg(F.sum(F.octet_length("text"))).first()[0], part_bytes)

    def part(k: int):
        mine = known.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == k)
        shared = spark.sparkContext.broadcast({r["name"]: r["text"] for r in mine.collect()})
        return lambda: Scanner(shared.value, width, bands, rows, least)

    if parts == 1:
        return docs.mapInArrow(_scan(part(0), text_col, kept, True), schema)
    scratch = Scratch(spark, "licenses")
    texts = docs.select(F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2"), F.col(text_col).alias("text"))
    own = StructType([StructField("t1", LongType()), StructField("t2", LongType()), FOUND])
    found = [scratch.put(texts.mapInArrow(_scan(part(k), "text", ["t1", "t2"], False), own).where(F.size("licenses") > 0).distinct()) for k in range(parts)]
    every = functools.reduce(DataFrame.unionByName, found).groupBy("t1", "t2").agg(F.flatten(F.collect_list("licenses")).alias("__found"))
    every = scratch.put(every)
    scratch.drop(*found)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2"))
    joined = keyed.join(every, ["t1", "t2"], "left").select(*[F.col("row").getField(c).alias(c) for c in kept], "__found")
    return joined.mapInArrow(_resolved(kept), schema)
