"""Operator 8, licence scans: sparse TF-IDF cosine of headers to licence templates, then nearest-ancestor inheritance.

A header is a line or a run of up to ``SPAN`` neighbouring lines that aren't blank, wherever it stands in the whole text, so
a notice may be wrapped. It is compared with every template whose decisive words (licence names, qualifiers, versions) it
has; qualifiers of its own that the template lacks rule the template out. So no version or variant passes for another. An
exact index finds these templates: each is filed under its rarest decisive word, and lines without such a word can't match.
Inverse line frequencies of the template words are counted over the whole corpus; words outside the templates weigh as much
as the rarest. Of the runs around a line the most similar one is its header. A file's own licence is that of its most similar
header, if the cosine reaches ``LEAST``. A file is a licence file if its name says so, or if headers hold half of its words;
it gives its licence to its directory. A file without a licence takes that of the nearest ancestor directory that has one,
by joins on paths.

Defined cases: null or empty text has no licence of its own. A null path is in no directory and inherits nothing. Of equal
similarities the first licence in alphabetical order wins, of a directory's licence files the most similar one (then by
licence and path). Repeated rows each get a row, repeated headers count once each. Extra columns are kept out. Empty table:
no rows. A version is a number, ``2.0`` and ``2`` being one; a licence without a version in its name has none to differ in.
Template tables and frequencies have the size of the templates; directories are joined, never collected, and broadcast only
up to ``MAX_BROADCAST`` rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.storage import Scratch

LEAST, FILE_SHARE, SPAN, MAX_BROADCAST = 0.6, 0.5, 6, 300_000
#: Short public notices: per identifier the licence's title, then headers and passages of its text.
NOTICES = {
    "0BSD": ["Zero-Clause BSD License"],
    "AFL-3.0": ["Academic Free License version 3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-1.1": ["Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero 1.0 Universal public domain dedication"],
    "EPL-1.0": ["Eclipse Public License, version 1.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "EUPL-1.2": ["European Union Public Licence, version 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, version 1.3"],
    "GPL-2.0": ["GNU General Public License, version 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "LGPL-2.0": ["GNU Library General Public License, version 2"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": ["MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "MPL-1.1": ["Mozilla Public License, version 1.1"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ODbL-1.0": ["Open Database License 1.0", "Open Data Commons Open Database License version 1.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1"],
    "PostgreSQL": ["PostgreSQL License"],
    "Unlicense": ["The Unlicense", "This is free and unencumbered software released into the public domain."],
    "UPL-1.0": ["Universal Permissive License, Version 1.0"],
    "WTFPL": ["Do What The Fuck You Want To Public License"],
    "Zlib": ["zlib License", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}
#: Words that set one licence apart from another that is worded alike, and words of titles.
QUALIFIERS = frozenset("affero agpl lesser lgpl library nc nd sa zero noncommercial noderivatives sharealike documentation".split())
DECISIVE = QUALIFIERS | frozenset("academic apache artistic attribution boost bsd by cc clause commons creative database eclipse european font fuck gnu gpl hereby implied isc licence license licensed mit mozilla mpl permission permissive postgresql public redistribution restriction spdx unencumbered unlicense zlib".split())
_SYNONYMS = {"licence": "license", "licences": "license", "licenses": "license", "noncommercial": "nc", "noderivatives": "nd", "noderivs": "nd", "sharealike": "sa"}
_WORD = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+?(?=v\d)|[^\W\d_]+")
_JOINED = re.compile(r"\b(non|no|share)-(commercial|derivatives|derivs|alike)\b")
_LICENCE_NAME = r"(?i)^(licen[sc]es?|copying|notice)(\..*)?$"


def words(line: str) -> list[str]:
    """Letters and numbers as words; spellings of one thing as one word, ``2.0`` as ``2``."""
    line = line.lower()
    found = _WORD.findall(_JOINED.sub(r"\1\2", line) if "-" in line else line)
    same = [_SYNONYMS.get(w, w) for w in found]
    return [re.sub(r"(?:\.0)+$", "", w) for w in same] if ".0" in line else same


def templates_of(notices: dict[str, list[str]]) -> dict[str, list[str]]:
    """The notices, and headers made of a licence's title and identifier."""
    made = {}
    for name, (title, *more) in notices.items():
        made[name] = [f"SPDX-License-Identifier: {name}", title, f"Licensed under the {title}.", f"Released under the {title}.", f"This work is licensed under the {title}.", *more]
        if name.startswith("CC-BY"):
            made[name] += [f"This work is licensed under a {more[0]}.", f"Licensed under a {more[0]}.", more[0]]
    return made


TEMPLATES = templates_of(NOTICES)


def _vocabulary(templates: dict[str, list[str]]) -> frozenset[str]:
    return frozenset(w for lines in templates.values() for line in lines for w in words(line))


def _frequencies(vocabulary: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counter()
        for batch in batches:
            for text in batch["text"]:
                for line in (text or "").split("\n"):
                    if line and not line.isspace():
                        counts[""] += 1
                        counts.update(vocabulary.intersection(words(line)))
        yield pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})

    return run


class Matcher:
    """Cosine of headers to templates; ``weight`` has the template words, ``other`` weighs any other word."""

    def __init__(self, templates: dict[str, list[str]], weight: dict[str, float], other: float):
        self.weight, self.other = weight, other
        #: rarest decisive word -> templates: name, decisive words, all words, unit vector
        self.index: dict[str, list[tuple[str, frozenset, frozenset, dict[str, float]]]] = {}
        for name in sorted(templates):
            for counts in (Counter(words(line)) for line in templates[name]):
                vector = {w: n * weight[w] for w, n in counts.items()}
                norm = math.sqrt(sum(v * v for v in vector.values()))
                rarest = lambda found: max(found, key=lambda w: (weight[w], w))
                decisive = frozenset(w for w in counts if w in DECISIVE or w[0].isdigit()) or frozenset([rarest(counts)])
                self.index.setdefault(rarest(decisive), []).append((name, decisive, frozenset(counts), {w: v / norm for w, v in vector.items()}))

    def best(self, counts: Counter) -> tuple[float, str | None]:
        """Highest cosine of a header's words, 0 and null if no template has its decisive words there."""
        top, name, norm = 0.0, None, 0.0
        qualifiers = QUALIFIERS.intersection(counts)
        for key in self.index.keys() & counts.keys():
            for licence, decisive, every, vector in self.index[key]:
                if decisive <= counts.keys() and qualifiers <= every:
                    norm = norm or math.sqrt(sum((n * self.weight.get(w, self.other)) ** 2 for w, n in counts.items()))
                    cosine = round(sum(v * counts[w] * self.weight[w] for w, v in vector.items()) / norm, 9)
                    if (-cosine, licence) < (-top, name or "~"):
                        top, name = cosine, licence
        return top, name

    def scan(self, text: str) -> tuple[str | None, float, float]:
        """A text's licence, its cosine, and the share of its words in headers that reach ``LEAST``."""
        lines = [words(line) for line in text.split("\n")]
        sets = [set(line) for line in lines]
        scored: dict[tuple[int, int], tuple[float, str | None]] = {}
        top, name, covered = 0.0, None, set()
        for i, found in enumerate(sets):
            keys = self.index.keys() & found
            if not keys:
                continue
            first = last = i
            while first and i - first < SPAN - 1 and lines[first - 1]:
                first -= 1
            while last + 1 < len(lines) and last - i < SPAN - 1 and lines[last + 1]:
                last += 1
            near = set().union(*sets[first : last + 1])
            if not any(t[1] <= near for k in keys for t in self.index[k]):
                continue
            spans = [(a, b) for a in range(first, i + 1) for b in range(i, min(last, a + SPAN - 1) + 1)]
            for a, b in spans:
                if (a, b) not in scored:
                    scored[a, b] = self.best(Counter(w for line in lines[a : b + 1] for w in line))
            # the line's own header: its most similar run, the shortest of equals
            a, b = min(spans, key=lambda s: (-scored[s][0], s[1] - s[0], s))
            cosine, licence = scored[a, b]
            if cosine >= LEAST:
                covered.update(range(a, b + 1))
                if (-cosine, licence) < (-top, name or "~"):
                    top, name = cosine, licence
        total = sum(map(len, lines))
        return name, top, sum(len(lines[i]) for i in covered) / total if total else 0.0


def _match(templates: dict[str, list[str]], weight: dict[str, float], other: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(templates, weight, other)
        for batch in batches:
            out = pd.DataFrame([matcher.scan(text or "") for text in batch["text"]], columns=["own", "similarity", "share"], index=batch.index, dtype=object)
            yield batch.drop(columns=["text"]).assign(own=out["own"], similarity=out["similarity"].astype(float), share=out["share"].astype(float))

    return run


def inherit(spark: SparkSession, files: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``inherited``: the licence of the nearest ancestor directory. ``files`` has path, dir, own, similarity, is_licence_file."""
    given = files.where("is_licence_file and own is not null and dir is not null").groupBy("dir").agg(F.min_by("own", F.struct((-F.col("similarity")).alias("s"), "own", "path")).alias("licence"))
    given = scratch.table(given)
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("ancestor"), i.alias("depth")))
    dirs = files.where("dir is not null").select("dir").distinct().select("dir", F.inline(up))
    nearest = dirs.join(given.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max_by("licence", "depth").alias("inherited"))
    nearest = scratch.table(nearest)
    # a directory may hold a third of all files: those stay where they are while the directories fit in memory
    return files.join(F.broadcast(nearest) if nearest.count() <= MAX_BROADCAST else nearest, "dir", "left")


def scan_licences(spark: SparkSession, docs: DataFrame, path: Column, keep: tuple[str, ...] = ("doc_id",), templates: dict[str, list[str]] | None = None) -> DataFrame:
    """The ``keep`` columns, path, own_licence, similarity, is_licence_file, licence, origin (own, inherited or none)."""
    templates = templates or TEMPLATES
    scratch = Scratch(spark, "licences")
    vocabulary = _vocabulary(templates)
    counts = {r["word"]: r["n"] for r in docs.select("text").mapInPandas(_frequencies(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    lines = counts.get("", 0)
    weight = {w: math.log((1 + lines) / (1 + counts.get(w, 0))) + 1 for w in vocabulary}
    wanted = docs.select(*keep, path.alias("path"), "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields if f.name != "text") + ", own string, similarity double, share double"
    found = wanted.mapInPandas(_match(templates, weight, math.log(1 + lines) + 1), schema)
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(_LICENCE_NAME), F.lit(False))
    files = found.withColumns({"dir": F.regexp_replace("path", "/?[^/]*$", ""), "is_licence_file": (F.col("share") >= FILE_SHARE) | (named & F.col("own").isNotNull())})
    out = inherit(spark, scratch.table(files), scratch)
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return out.select(*keep, "path", F.col("own").alias("own_licence"), "similarity", "is_licence_file", F.coalesce("own", "inherited").alias("licence"), origin.alias("origin"))
