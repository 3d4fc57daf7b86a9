"""Licence scan in built-in functions: MinHash bands over overlapping windows.

Templates are cut into five-word shingles and put into classes by their number.
For the class 2**(c-1) < q <= 2**c a text is read in windows of 2**(c+1) shingles
that start every 2**c, so a template of the class lies wholly in one of them.

The signature is a one-permutation MinHash: a shingle's hash picks one of ``BINS``
bins and every bin keeps its smallest hash. A band is one bin; empty bins make no
band. A band of the template collides with a window that holds the template
unless a foreign shingle of the window falls into the same bin with a smaller
hash, which has a probability below (2**(c+1) - q) / (2 * BINS), and a template
of q shingles has about q bands. One shingle in a window of two is missed with a
probability of 0.0005, three in a window of eight with less than 1e-6, and long
templates less often still.

The smallest shingles of the templates must lie in a window for it to collide, so
only windows around them are looked at. Candidates are verified by exact
containment of shingle texts.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

K, PERCENT, BINS = 5, 75, 1024
TEMPLATES_PER_BLOCK = 100

# Notices by which texts name their licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this"
     " file except in compliance with the License. You may obtain a copy of the License at"
     " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
     " writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
     " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are"
     " permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of"
     " the GNU General Public License as published by the Free Software Foundation, either version 3 of"
     " the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
     " and associated documentation files (the \"Software\"), to deal in the Software without restriction,"
     " including without limitation the rights to use, copy, modify, merge, publish, distribute,"
     " sublicense, and/or sell copies of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a"
     " copy of the MPL was not distributed with this file, You can obtain one at"
     " https://mozilla.org/MPL/2.0/."),
]

#: Shingles without which a template names the wrong version or variant, by licence.
REQUIRED = {
    "GPL-2.0": ["terms of the gnu general", "either version 2 of the"],
    "LGPL-2.1": ["terms of the gnu lesser", "either version 2 1 of"],
    "LGPL-3.0": ["terms of the gnu lesser", "either version 3 of the"],
    "AGPL-3.0": ["terms of the gnu affero", "either version 3 of the"],
    "BSD-2-Clause": ["with the distribution this software"],
    "BSD-3-Clause": ["to endorse or promote products"],
}
_GNU = ("you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free"
        " Software Foundation, either version {} of the License, or (at your option) any later version.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met: Redistributions of source code must retain the above copyright notice, this"
        " list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above"
        " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
        " materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND"
        " CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED"
        " WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
       "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Further notices: (license, template, whether its licence's ``REQUIRED`` shingles hold). A
#: licence that ``TEMPLATES`` find in a text is not named again.
FURTHER = [
    *[(n, _GNU.format(kind, v), True) for n, kind, v in [
        ("GPL-2.0", "General Public", "2"), ("LGPL-2.1", "Lesser General Public", "2.1"),
        ("LGPL-3.0", "Lesser General Public", "3"), ("AGPL-3.0", "Affero General Public", "3")]],
    *[(n, t, False) for n, kind, v in [
        ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
        ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"),
        ("AGPL-3.0", "Affero General Public License", "3")]
      for t in (f"GNU {kind}, version {v}", f"GNU {kind} v{v}")],
    ("BSD-2-Clause", _BSD.format(""), True),
    ("BSD-3-Clause", _BSD.format(
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission. "), True),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
     " granted, provided that the above copyright notice and this permission notice appear in all copies.", False),
    *[(f"CC-{c}-{v}", t, False) for v in ("1.0", "2.0", "2.5", "3.0", "4.0") for c, name in _CC.items()
      for t in ([f"Creative Commons {name} {v}"] + (
          [f"under CC BY {v}", f"license CC BY {v}"] if c == "BY" else [f"CC {c} {v}"]))],
]


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingled(words: Column, make) -> Column:
    """``make`` of the words of every shingle, in order; none with fewer than K words."""
    places = F.when(F.size(words) >= K, F.sequence(F.lit(0), F.size(words) - K)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(places, lambda i: make(*[F.get(words, i + j) for j in range(K)]))


def _texts(words: Column) -> Column:
    return F.array_distinct(_shingled(words, lambda *w: F.concat_ws(" ", *w)))


def _bin(value: Column) -> Column:
    return F.pmod(value, F.lit(BINS))


def _bands(spark: SparkSession, templates: list[tuple[str, str]]) -> list:
    """Per template: its shingle texts and its bands (bin, smallest hash)."""
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(templates)], "i int, text string")
    words = rows.select("i", _words(F.col("text")).alias("words"))
    sets = words.select(
        "i", _texts(F.col("words")).alias("shingles"),
        F.array_distinct(_shingled(F.col("words"), F.xxhash64)).alias("hashes"))
    least = sets.select("i", F.explode("hashes").alias("h")).groupBy("i", _bin(F.col("h")).alias("bin")).agg(
        F.min("h").alias("h")).groupBy("i").agg(F.sort_array(F.collect_list("h")).alias("bands"))
    return sets.join(least, "i").select("i", "shingles", "bands").orderBy("i").collect()


def _literals(values: list[str] | list[int], kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _scan(
    docs: DataFrame, templates: list[tuple[str, str]], required: list[list[str]] | None = None, chosen=lambda found: found
) -> DataFrame:
    """Rows of the templates found; ``required`` shingles by template, ``chosen`` of a text's matches stay."""
    known = _bands(docs.sparkSession, templates)
    bands = [(h, r["i"], 1 << max(0, (len(r["shingles"]) - 1).bit_length())) for r in known for h in r["bands"]]
    if not bands:  # no template has five words
        return docs.sparkSession.createDataFrame([], docs.select("doc_id").schema).selectExpr(
            "doc_id", "'' AS license", "'' AS template", "0L AS n_template", "0L AS n_shared")
    keys = sorted({h for h, _, _ in bands})
    listed = F.array(*[F.struct(
        F.lit(h).cast("bigint").alias("h"), F.lit(i).alias("template"), F.lit(s).alias("stride"))
        for h, i, s in bands])
    shingles = F.array(*[_literals(r["shingles"], "string") for r in known])

    needed = F.array(*[_literals(r, "string") for r in required or []])

    def hits(hashes: Column) -> Column:
        """Places of the templates' smallest shingles, one entry for each band there."""
        places = F.filter(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))),
            lambda x: x["h"].isin(keys))
        return F.flatten(F.transform(places, lambda p: F.transform(
            F.filter(listed, lambda b: b["h"] == p["h"]), lambda b: F.struct(
                p["h"].alias("h"), p["at"].alias("at"), b["template"].alias("template"),
                b["stride"].alias("stride")))))

    def collides(hashes: Column, hit: Column) -> Column:
        """Whether the hit is the smallest of its bin in a window of its template's class."""
        def window(back: int) -> Column:
            start = ((F.floor(hit["at"] / hit["stride"]) - back) * hit["stride"]).cast("int")
            inside = F.slice(hashes, F.greatest(start, F.lit(0)) + 1, 2 * hit["stride"])
            least = F.array_min(F.filter(inside, lambda x: _bin(x) == _bin(hit["h"])))
            return (start >= 0) & (least == hit["h"])

        return window(0) | window(1)

    def candidates(hashes: Column) -> Column:
        return F.array_distinct(F.transform(
            F.filter(hits(hashes), lambda x: collides(hashes, x)), lambda x: x["template"]))

    def verified(words: Column, found: Column) -> Column:
        def matches(own: Column) -> Column:
            kept = found if required is None else F.filter(
                found, lambda t: F.size(F.array_except(F.get(needed, t), own)) == 0)
            return F.filter(F.transform(kept, lambda t: F.struct(
                t.alias("template"), F.size(F.get(shingles, t)).alias("n_template"),
                F.size(F.array_intersect(F.get(shingles, t), own)).alias("n_shared"))),
                lambda x: 100 * x["n_shared"] >= PERCENT * x["n_template"])

        return _let(_let(_texts(words), matches), chosen)

    # one expression, whose parts are computed once each and only where they are needed
    def searched(words: Column) -> Column:
        return _let(_shingled(words, F.xxhash64), lambda hashes: F.when(
            F.arrays_overlap(hashes, _literals(keys, "bigint")),
            _let(candidates(hashes), lambda found: F.when(F.size(found) > 0, verified(words, found)))))

    rows = docs.select("doc_id", F.explode_outer(_let(_words(F.col("text")), searched)).alias("r"))

    def of(values: list[str]) -> Column:
        return F.get(_literals(values, "string"), F.col("r.template"))

    return rows.where("r is not null").select(
        "doc_id", of([n for n, _ in templates]).alias("license"),
        of([t for _, t in templates]).alias("template"),
        F.col("r.n_template").cast("bigint").alias("n_template"),
        F.col("r.n_shared").cast("bigint").alias("n_shared"))


def _known_licenses(docs: DataFrame) -> DataFrame:
    """``TEMPLATES`` and ``FURTHER`` in one search, each with the shingles of its version."""
    gpl3 = ["general public license version 3"], ["terms of the gnu general", "either version 3 of the"]
    required = [gpl3["either version" in t] if n == "GPL-3.0" else [] for n, t in TEMPLATES]
    required += [REQUIRED[n] if strict else [] for n, _, strict in FURTHER]
    templates = TEMPLATES + [(n, t) for n, t, _ in FURTHER]
    names, first = _literals([n for n, _ in templates], "string"), len(TEMPLATES)
    clause = next(i for i, (n, _) in enumerate(TEMPLATES) if n == "BSD-3-Clause")

    def name(x: Column) -> Column:
        return F.get(names, x["template"])

    def chosen(found: Column) -> Column:
        """No licence again that ``TEMPLATES`` name; the clause both BSD licences share is not a second one."""
        shared = F.exists(found, lambda y: name(y) == "BSD-2-Clause")
        own = F.filter(found, lambda x: (x["template"] < first) & ~((x["template"] == clause) & shared))
        return F.concat(own, F.filter(found, lambda x: (x["template"] >= first) & ~F.exists(
            own, lambda y: name(y) == name(x))))

    return _scan(docs, templates, required, chosen)


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows (doc_id, license, template, n_template, n_shared) for every notice found.

    Words are runs of letters and digits in lower case. A template is found where
    a document has at least 75 % of its distinct five-word shingles; templates and
    texts of fewer than five words, null and empty texts match nothing. Templates
    are searched in blocks of ``TEMPLATES_PER_BLOCK``. Without ``templates`` those of
    ``TEMPLATES`` and ``FURTHER`` are searched, told apart by version and variant. Repeated rows and null ids
    give rows of their own; other columns are ignored.
    """
    if templates is None:
        return _known_licenses(docs)
    blocks = [templates[i:i + TEMPLATES_PER_BLOCK] for i in range(0, len(templates), TEMPLATES_PER_BLOCK)]
    return reduce(DataFrame.union, [_scan(docs, b) for b in blocks or [[("", "")]]])
