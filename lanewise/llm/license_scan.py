"""License scan with DataFrame functions only: MinHash bands over overlapping windows, then exact shingle containment.

Templates are a table of license texts and notices, cut into shingles of five words (a shorter template is one shingle). For
templates of up to L shingles, L a power of two, a text is cut into windows of 2 L shingles, one from each L-th shingle on, so that
every occurrence lies in a window whole. If a window holds 80 % of a template of more than L / 2 shingles, their Jaccard similarity
is at least 0.8 / (4 + 0.2), about 0.19; with BANDS = 48 bands of a single row such a window meets the template in a band with a
probability of over 99.99 %. A template met in a band is a match if at least 80 % of its shingles are in the window.

Bands are joined with those of the templates, and so are shingles, so plans don't grow with the number of templates. Windows
without any shingle of a template can't meet one in a band, and texts without any word of a set that is in more shingles of each
template than a match may lack hold no match: both are passed over before windows are hashed, which changes no result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import MOST_BROADCAST, pinned, written
from .license_texts import TEXTS

SHINGLE = 5
CONTAINMENT = (4, 5)
BANDS = 48

#: Short notices by the name of their license, and whole texts.
TEMPLATES = TEXTS | {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-disclaimer": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Letters of a word that is taken for rare.
LONG = 7
#: Words that are too common to tell a text that may hold a template.
COMMON = frozenset("a an and any are as at by do do for from in is it may not of on or so that the this to use with you your".split())
_word = re.compile("[a-z0-9]+")


def template_words(text: str) -> list[str]:
    return _word.findall(text.lower())


def shingles_of(text: str) -> list[str]:
    words = template_words(text)
    k = min(SHINGLE, len(words))
    return sorted({" ".join(words[i : i + k]) for i in range(len(words) - k + 1)})


def reach_of(text: str) -> tuple[int, int]:
    """Words in a shingle of a template, and the least power of two that its number of shingles doesn't exceed."""
    size = len(template_words(text))
    k = min(SHINGLE, size)
    return k, 1 << (size - k).bit_length()


def anchors(templates: dict[str, str]) -> list[str]:
    """A small set of words that a text with a match must hold one of: they are in more shingles of each template than a match may lack.

    Long words go first, since they are rare in other texts; words of COMMON last.
    """
    left = {name: {tuple(s.split()) for s in shingles_of(t)} for name, t in templates.items()}
    part, whole = CONTAINMENT
    wanted = {name: len(x) - -(-len(x) * part // whole) + 1 for name, x in left.items() if x}
    out = []
    while wanted:
        counts = Counter(w for name in wanted for s in left[name] for w in {*s})
        best = min(counts, key=lambda w: (w in COMMON, len(w) < LONG, -counts[w], w))
        out.append(best)
        for name in list(wanted):
            held = {s for s in left[name] if best in s}
            left[name] -= held
            wanted[name] -= len(held)
            if wanted[name] <= 0:
                del wanted[name]
    return sorted(out)


def _words(text: str) -> str:
    return f"filter(split(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), x -> x <> '')"


def _shingles(words: str, k: str) -> str:
    """SQL: the hash of the ``k`` words from each word on."""
    return f"if(size({words}) < {k}, cast(array() as array<bigint>), transform(sequence(1, greatest(size({words}) - {k} + 1, 1)), i -> xxhash64(array_join(slice({words}, i, {k}), ' '))))"


def _signature(shingles: str) -> str:
    return f"transform(sequence(0, {BANDS - 1}), j -> array_min(transform({shingles}, x -> xxhash64(x, j))))"


def _prepared(templates: DataFrame) -> DataFrame:
    """(name, k, reach, hashes, signature) of templates (name, text) that have a word: words in a shingle, L, distinct shingles."""
    cut = templates.filter("name is not null and text is not null").dropDuplicates(["name"]).select("name", F.expr(_words("text")).alias("w")).filter("size(w) > 0")
    sized = cut.select("name", "w", F.expr(f"least(size(w), {SHINGLE})").alias("k"))
    reach = "if(size(w) = k, 1, cast(shiftleft(1, length(bin(size(w) - k))) as int))"
    hashed = sized.select("name", "k", F.expr(reach).alias("reach"), F.expr(f"array_distinct({_shingles('w', 'k')})").alias("hashes"))
    return hashed.select("*", F.expr(_signature("hashes")).alias("signature"))


def _texts(spark: SparkSession, templates: dict[str, str] | DataFrame) -> tuple[dict[str, str], DataFrame]:
    if isinstance(templates, dict):
        return templates, spark.createDataFrame(list(templates.items()), "name string, text string")
    rows = templates.select("name", "text")
    return {r["name"]: r["text"] for r in rows.collect() if r["name"] is not None and r["text"] is not None}, rows


def scan_licenses(docs: DataFrame, keep: list[str], text: str = "text", templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Columns ``keep`` with ``licenses``: a sorted array of the names whose template the text holds.

    ``templates`` are texts by name, or a table (name, text) that the driver can hold; templates without a word are left out. Null
    and empty texts hold none; repeated rows each give a row; an empty table gives an empty table; all of a text is searched,
    however long. Other columns may have any names; ``licenses`` must not be among ``keep``. The columns ``keep``, and texts that may
    hold a license, are copied to the shared folder first.
    """
    spark = docs.sparkSession
    named, table = _texts(spark, TEMPLATES if templates is None else templates)
    named = {n: t for n, t in named.items() if template_words(t)}
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    out = [F.col(f"kept.c{i}").alias(c) for i, c in enumerate(keep)]
    if not named:
        return docs.select(kept.alias("kept")).select(*out, F.expr("cast(array() as array<string>)").alias("licenses"))
    known = pinned(_prepared(table))
    shingles = known.select("name", "k", "reach", F.explode("hashes").alias("hash"))
    near = F.broadcast if known.agg(F.sum(F.size("hashes") + BANDS).alias("n")).first()["n"] <= MOST_BROADCAST else lambda df: df
    # (?<![a-z0-9]) keeps to whole words.
    sieve = f"(?i)(?<![a-z0-9])({'|'.join(anchors(named))})(?![a-z0-9])"
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), kept.alias("kept"), F.when(body.rlike(sieve), body).alias("body")), "sieved", "zstd")
    ks = "array(" + ",".join(map(str, sorted({min(SHINGLE, len(template_words(t))) for t in named.values()}))) + ")"
    split = rows.filter("body is not null").select("row", F.expr(_words("body")).alias("w")).select("row", "w", F.explode(F.expr(ks)).alias("k"))
    hashed = split.select("row", "k", F.expr(_shingles("w", "k")).alias("h"))
    # Windows with a shingle of a template: the two that hold its place.
    placed = hashed.select("row", "k", F.posexplode("h").alias("i", "hash")).join(near(shingles.select("k", "reach", "hash").distinct()), ["k", "hash"])
    numbers = placed.select("row", "k", "reach", F.explode(F.expr("array(i div reach, i div reach - 1)")).alias("m")).filter("m >= 0").distinct()
    wanted = pinned(numbers.groupBy("row", "k").agg(F.collect_list(F.struct("reach", "m")).alias("windows")))
    # Texts with a shingle of a template are few: the others' shingles aren't shuffled.
    few = (wanted.agg(F.sum(F.size("windows") + 2).alias("n")).first()["n"] or 0) <= MOST_BROADCAST
    wanted = F.broadcast(wanted) if few else wanted
    cut = hashed.join(wanted, ["row", "k"]).select("row", "k", "h", F.explode("windows").alias("at")).select("row", "k", "at.reach", "at.m", F.expr("array_distinct(slice(h, cast(at.m * at.reach as int) + 1, 2 * at.reach))").alias("window"))
    windows = pinned(cut.select("*", F.expr(_signature("window")).alias("signature")))
    bands = lambda df, *columns: df.select(*columns, "k", "reach", F.posexplode("signature").alias("band", "least"))
    met = bands(windows, "row", "m").join(near(bands(known, "name")), ["k", "reach", "band", "least"]).select("row", "k", "reach", "m", "name").distinct()
    both = met.join(windows, ["row", "k", "reach", "m"]).join(near(known.select("name", "hashes")), "name")
    held = both.filter(f"size(array_intersect(hashes, window)) * {CONTAINMENT[1]} >= size(hashes) * {CONTAINMENT[0]}")
    found = held.groupBy("row").agg(F.array_sort(F.collect_set("name")).alias("licenses"))
    return rows.join(found, "row", "left").select(*out, F.coalesce("licenses", F.expr("cast(array() as array<string>)")).alias("licenses"))
