"""Licence scan: TF-IDF cosine of texts to templates, and inheritance from directories.

Own licence: templates are one-line statements, standard headers and full licence texts.  Parts of every whole
text are compared with them as sparse TF-IDF vectors: every line, every paragraph (lines up to one without
words), the whole text, and every run of as many words as the template has, wherever lines break.
The vocabulary is that of the templates (some thousand terms); document
frequencies of these terms are counted over all documents.  Other words get the weight
of a term seen in one document, so they lower the cosine.  Only parts with a *telling* term can reach
the least cosine: the terms left out of that set carry less than ``least`` of any
template's length (Cauchy-Schwarz), so skipping other texts and lines loses nothing.

Inheritance: a licence file is a file named ``LICENSE``; its licence holds for
its directory.  A file without an own licence takes that of its nearest ancestor directory with one: distinct
directories explode into their ancestors and join the licensed directories by path, the deepest hit
wins; files join their directory's answer.  Exploding distinct directories instead of
files keeps a root that a third of all files share small before the join.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.llm.common import staged, text_of

#: fixed values: one-line licence statements
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_FSF = "and/or modify it under the terms of {} as published by the Free Software Foundation"
_CC = {"CC-BY-4.0": "Attribution", "CC-BY-NC-4.0": "Attribution-NonCommercial", "CC-BY-SA-4.0": "Attribution-ShareAlike",
       "CC-BY-ND-4.0": "Attribution-NoDerivatives", "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike",
       "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives"}


def _gnu(kind: str, version: str) -> tuple[str, ...]:
    name = f"the GNU {kind}General Public License"
    return (f"This program is free software: you can redistribute it {_FSF.format(name)}, either version {version} of the License, or (at your option) any later version.",
            f"This program is free software; you can redistribute it {_FSF.format(f'version {version} of {name}')}.",
            f"This work is licensed under {name}, version {version}.")


#: standard headers and notices.  Names beyond those of ``TEMPLATES`` are near relatives that would pass for them.
#: The last Creative Commons text opens each legal code.
HEADERS = {
    "Apache-2.0": ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",),
    "MPL-2.0": ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",),
    "GPL-2.0": _gnu("", "2"), "GPL-3.0": _gnu("", "3"), "LGPL-2.0": _gnu("Library ", "2"), "LGPL-2.1": _gnu("Lesser ", "2.1"), "LGPL-3.0": _gnu("Lesser ", "3"),
    "AGPL-3.0": (*_gnu("Affero ", "3"), """The GNU Affero General Public License is a free, copyleft license for software and other kinds of works,
        specifically designed to ensure cooperation with the community in the case of network server software."""),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",), "ISC": ("Released under the ISC License.",),
    **{name: (f"Licensed under {name[:-4].replace('-', ' ', 1)} 4.0.", f"This work is licensed under a Creative Commons {kind} 4.0 International License.",
              f"""This work is licensed under the Creative Commons {kind} 4.0 International License. To view a copy of this license, visit
              http://creativecommons.org/licenses/{name[3:-4].lower()}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.""",
              f"""By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this
              Creative Commons {kind} 4.0 International Public License""") for name, kind in _CC.items()},
}
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
_TERM = re.compile(TERM.encode())


@lru_cache(maxsize=1)
def default_templates() -> dict[str, tuple[str, ...]]:
    """Statements, headers and the full texts beside this module, by licence."""
    out = {name: (text, *HEADERS.get(name, ())) for name, text in TEMPLATES.items()}
    out |= {name: texts for name, texts in HEADERS.items() if name not in out}
    place = os.path.join(os.path.dirname(__file__), "licenses")
    for file in sorted(os.listdir(place)):
        with open(os.path.join(place, file), encoding="utf-8") as f:
            out[file[:-4]] = (*out.get(file[:-4], ()), f.read())
    return out


def _terms(text: str) -> list[str]:
    return [t.decode() for t in _TERM.findall(text.encode().lower())]      # bytes: lower-cases A-Z only


def _found(batches: Iterator[pa.RecordBatch], vocabulary: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: Counter = Counter()
        for text in b.column(0).cast(pa.binary()).to_pylist():
            found.update(vocabulary.intersection(_TERM.findall(text.lower())))
        yield pa.RecordBatch.from_pydict({"term": pa.array([None, *(t.decode() for t in found)], pa.string()),
                                          "n": pa.array([b.num_rows, *found.values()], pa.int64())})


def inverse_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Smoothed idf of the vocabulary over all documents, and that of a term seen once."""
    words = frozenset(t.encode() for t in vocabulary)
    counts = docs.select(text_of("_text").alias("_text")).mapInArrow(lambda it: _found(it, words), "term string, n long")
    found = {r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = found.get(None, 0)
    return {t: math.log((1 + n) / (1 + found.get(t, 0))) + 1 for t in vocabulary}, math.log((1 + n) / 2) + 1


def template_vectors(idf: dict[str, float], templates: dict[str, tuple[str, ...]]) -> list[tuple[str, int, dict[str, float]]]:
    """(name, number of words, unit vector: term count times idf) of each template text."""
    out = []
    for name, texts in sorted(templates.items()):
        for text in texts:
            words = Counter(_terms(text))
            v = {t: n * idf[t] for t, n in sorted(words.items())}
            norm = math.sqrt(math.fsum(x * x for x in v.values()))
            out.append((name, sum(words.values()), {t: x / norm for t, x in v.items()}))
    return out


def telling_terms(vectors: list[dict[str, float]], idf: dict[str, float], least: float) -> list[str]:
    """Terms such that a part without any of them has a cosine below ``least`` with every template; rare and heavy terms first."""
    telling: set[str] = set()
    for v in sorted(vectors, key=len):
        rest = sorted((t for t in v if t not in telling), key=lambda t: (v[t] * v[t] * math.exp(idf[t]), t))
        while rest and math.sqrt(math.fsum(v[t] * v[t] for t in rest)) >= least * (1 - 1e-9):
            telling.add(rest.pop())
    return sorted(telling)


class Scorer:
    """Best template of one text."""

    def __init__(self, templates: dict[str, tuple[str, ...]], idf: dict[str, float], once: float, least: float):
        vectors = template_vectors(idf, templates)
        telling = telling_terms([v for _, _, v in vectors], idf, least)
        self.least, self.once = least, once
        self.idf = {t.encode(): x for t, x in idf.items()}
        self.telling = frozenset(t.encode() for t in telling)
        self.names, self.sizes = [name for name, _, _ in vectors], [m for _, m, _ in vectors]
        self.vectors = [{t.encode(): x for t, x in v.items()} for _, _, v in vectors]
        self.asks = [self.telling.intersection(v) for v in self.vectors]
        self.having: dict[bytes, list[tuple[int, float]]] = {}
        for k, v in enumerate(self.vectors):
            for t, x in v.items():
                self.having.setdefault(t, []).append((k, x))

    def part(self, words: list[bytes]) -> list[tuple[float, int, str]]:
        """(-cosine, -words of the template, name) of each template that one part reaches."""
        if self.telling.isdisjoint(words):
            return []
        weights = {t: n * self.idf.get(t, self.once) for t, n in Counter(words).items()}
        norm = math.sqrt(math.fsum(x * x for x in weights.values()))
        dots: dict[int, float] = {}
        for t, w in weights.items():
            for k, x in self.having.get(t, ()):
                dots[k] = dots.get(k, 0.0) + w * x
        cosines = ((round(d / norm, 9), k) for k, d in dots.items())
        return [(-c, -self.sizes[k], self.names[k]) for c, k in cosines if c >= self.least]

    def windows(self, words: list[bytes]) -> Iterator[list[bytes]]:
        """For each template the run of as many words that is closest to it, if it may reach ``least``.

        Dot products of all runs are differences of running sums; squared norms too, by what a word that enters or leaves
        adds to the squared count of its term.
        """
        place: dict[bytes, int] = {}
        ids = np.array([place.setdefault(t, len(place)) for t in words], dtype=np.int64)
        weight = np.array([self.idf.get(t, self.once) for t in place])
        square, n = (weight * weight)[ids], len(ids)
        order = np.argsort(ids, kind="stable")
        key = ids[order] * (2 * n) + order                        # sorted: by term, then place
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        norms: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def runs(x: np.ndarray, m: int) -> np.ndarray:
            s = np.concatenate(([0.0], np.cumsum(x)))
            return s[m:] - s[:-m]

        def norm(m: int) -> np.ndarray:
            at = np.arange(n)
            before = rank - np.searchsorted(key, ids * (2 * n) + np.maximum(at - m + 1, 0)) + 1      # of the term, in the run that ends here
            after = np.searchsorted(key, ids * (2 * n) + np.minimum(at + m, n)) - rank               # in the run that starts here
            s = np.cumsum((2 * before - 1) * square)[m - 1:]
            s[1:] -= np.cumsum((2 * after - 1) * square)[:n - m]
            return np.sqrt(np.maximum(s, runs(square, m) * (1 - 1e-9)))
        for m, v, asks in zip(self.sizes, self.vectors, self.asks):
            if m >= n or asks.isdisjoint(place):
                continue                                          # a shorter text is compared as a whole
            local = weight * np.array([v.get(t, 0.0) for t in place])
            dots, bound = runs(local[ids], m), self.least * (1 - 1e-6)
            if not (dots >= bound * np.sqrt(runs(square, m))).any():
                continue                                          # no term twice: the least norm a run can have
            if m not in norms:
                norms[m] = norm(m)
            cosine = dots / norms[m]
            i = int(np.argmax(np.round(cosine, 9)))
            if cosine[i] >= bound:
                yield words[i:i + m]

    def best(self, text: bytes) -> tuple[float, int, str] | None:
        low = text.lower()
        words = _TERM.findall(low)
        if self.telling.isdisjoint(words):
            return None
        lines = [_TERM.findall(x) for x in low.split(b"\n")]
        found = [hit for x in set(map(tuple, lines)) for hit in self.part(x)]
        block: list[bytes] = []
        for x in [*lines, []]:
            block += x
            if block and not x:
                found += self.part(block)
                block = []
        found += self.part(words)
        for x in self.windows(words):
            found += self.part(x)
        return min(found, default=None)


def _scored(batches: Iterator[pa.RecordBatch], schema: pa.Schema, scorer: Scorer) -> Iterator[pa.RecordBatch]:
    for b in batches:
        best = [scorer.best(text) for text in b.column(3).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([x and x[2] for x in best], pa.string()),
                                          pa.array([x and -x[0] for x in best], pa.float64())], schema=schema)


def header_licenses(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, least: float = 0.85) -> DataFrame:
    """(``_rid``, ``_id``, ``_path``, ``license``, ``cosine``) of every row of ``docs`` (``_id``, ``_path``, ``_text``); null without a header.

    The best part counts; equal cosines (to 9 digits) go to the longest template, then the first name.  The texts are read
    twice: for the document frequencies, and for the cosines.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    templates = {name: (x,) if isinstance(x, str) else tuple(x) for name, x in (templates or default_templates()).items()}
    vocabulary = sorted({t for texts in templates.values() for text in texts for t in _terms(text)})
    scorer = Scorer(templates, *inverse_frequencies(docs, vocabulary), least)
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), "_id", "_path", text_of("_text").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("license", T.StringType()), T.StructField("cosine", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(lambda it: _scored(it, arrow, scorer), schema)


def directory_of(path: Column) -> Column:
    """Path without its last part ('' for a file at the top)."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def inherited(files: DataFrame, license_name: str = "LICENSE") -> DataFrame:
    """(``_dir``, ``dir_license``, ``license_dir``): answer of the nearest licensed ancestor of each directory that has files.

    ``files``: stored table with ``_path``, ``license``, ``cosine``.  Of several licence files
    of one directory (repeated rows) the higher cosine counts, then the first name.
    """
    files = files.withColumn("_dir", directory_of(F.col("_path")))
    licensed = (files.where(F.col("license").isNotNull() & (F.regexp_extract("_path", r"([^/]*)$", 1) == license_name))
                .groupBy(F.col("_dir").alias("license_dir")).agg(F.min(F.struct((-F.col("cosine")).alias("neg"), F.col("license"))).alias("_best"))
                .select("license_dir", F.col("_best.license").alias("dir_license")))
    dirs = files.select("_dir").distinct()
    parts = F.split("_dir", "/", -1)
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("license_dir")))
    above = dirs.select("_dir", F.inline(F.array_distinct(up)))
    return (above.join(licensed, "license_dir").groupBy("_dir").agg(F.max(F.struct("depth", "dir_license", "license_dir")).alias("_hit"))
            .select("_dir", "_hit.dir_license", "_hit.license_dir"))


def scan_licenses(docs: DataFrame, path_col: str, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict[str, str] | None = None, least: float = 0.85, license_name: str = "LICENSE") -> DataFrame:
    """Per input row: id, ``path``, ``own_license``, ``own_cosine``, ``license`` (own, else inherited, else null), ``license_dir``.

    Null text counts as empty and has no header.  A null path is a file of no directory: it keeps its own
    licence and inherits none.  Repeated rows have a result each.  Other columns are not looked at.  An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(path_col).alias("_path"), F.col(text_col).alias("_text"))
    files = staged(header_licenses(rows, templates, least), "license-headers")
    answer = inherited(files, license_name).withColumnRenamed("_dir", "__dir")
    out = files.withColumn("_dir", directory_of(F.col("_path"))).join(answer, F.col("_dir") == F.col("__dir"), "left")
    takes = F.col("license").isNull()
    return out.select(F.col("_id").alias(id_col), F.col("_path").alias("path"), F.col("license").alias("own_license"), F.col("cosine").alias("own_cosine"),
                      F.coalesce("license", "dir_license").alias("license"), F.when(takes, F.col("license_dir")).alias("license_dir"))
