"""License scans with a positional index of rare licence words.

Templates are notices, headings, addresses and SPDX tags. Every template word has postings
(template, position); its IDF comes from how many of all documents hold it. A file is looked up by
its licence words of highest IDF: of each template the ``anchors`` rarest words (a fifth of a long one's) act as such, and
every occurrence in the file votes for (template, offset). Votes for offsets at most ``slack``
words apart (a sixth of the template's words: none for short ones) count together, so a word put
in or left out does not lose a notice. An alignment with enough votes is scored by the share of
template words standing at their relative position under one of these offsets, and counts only if
the template's key phrases stand inside it word for word.

Independently, fixed base phrases are located in every text; their labels always stay.

Results for odd input: a null or empty text has no words, empty labels and score 0; a null
id keeps its row; repeated rows are scanned alike; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.session import ship_package

# Phrases and the labels they carry.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Label, notice text, key phrases that must stand in the notice.
NOTICES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     ("permission is hereby granted", "free of charge")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "apache license version 2 0", ("apache license", "version 2 0")),
    ("apache-2.0", "www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("agpl-3.0", "under the gnu affero general public license version 3", ("affero general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ("redistribution and use", "binary forms")),
    ("bsd-2-clause", "bsd 2 clause license", ("bsd 2 clause",)),
    ("bsd-3-clause", "bsd 3 clause license", ("bsd 3 clause",)),
    ("epl-2.0", "eclipse public license v 2 0", ("eclipse public license",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy",)),
    ("reserved", "all rights reserved", ("all rights reserved",)),
)
# Identifiers of the public SPDX list; label is the identifier without "-only" and "-or-later".
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "Unlicense", "WTFPL", "MPL-2.0", "EPL-2.0",
        "BSL-1.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1",
        "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only",
        "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")
# GNU licences (label, words of the name) with their versions; clauses of the Creative Commons licences and theirs.
GNU = (("gpl", "general", ("2", "3")), ("lgpl", "lesser general", ("2 1", "3")), ("agpl", "affero general", ("3",)))
CC_CLAUSES = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
CC_KINDS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


def _families():
    """Templates made by rule: SPDX tags, GNU headings and notices, Creative Commons short and long names."""
    for name in SPDX:
        words = name.lower().replace("-", " ").replace(".", " ")
        label = name.lower().removesuffix("-only").removesuffix("-or-later")
        yield label, f"spdx license identifier {words}", (f"license identifier {words}",)
    for label, name, versions in GNU:
        for version in versions:
            full = label + "-" + (version.replace(" ", ".") if " " in version else version + ".0")
            heading = f"gnu {name} public license version {version}"
            yield full, heading, (heading,)
            yield (full, "redistribute it and or modify it under the terms of the gnu"
                   f" {name} public license as published by the free software foundation either version {version} of the license"
                   " or at your option any later version", (f"gnu {name} public license", f"version {version} of the license"))
    for kind in CC_KINDS:
        clauses = kind.split("-")
        short, long = " ".join(clauses), " ".join(CC_CLAUSES[c] for c in clauses)
        for version in CC_VERSIONS:
            yield "cc-" + kind, f"cc {short} {version}", (f"cc {short} {version}",)
            yield "cc-" + kind, f"creative commons {long} {version}", (f"creative commons {long} {version}",)


TEMPLATES = (*NOTICES, *_families())

_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytearray(range(256))
for _c in range(0x41, 0x5B):
    _FOLD[_c] = _c + 32
for _c in _SEPARATORS:
    _FOLD[_c] = 0x20
_FOLD = bytes(_FOLD)


def licence_words(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and everything beyond ASCII."""
    return (text or "").encode("utf-8").translate(_FOLD).split()


def places(ws: list[bytes], where: dict[bytes, list[int]], phrase: list[bytes], lo: int = 0, hi: int | None = None) -> list[int]:
    """Start positions of a phrase within ``ws[lo:hi]``."""
    hi, n = len(ws) if hi is None else hi, len(phrase)
    return [i for i in where.get(phrase[0], ()) if lo <= i <= hi - n and ws[i:i + n] == phrase]


class Index:
    """Postings of template words; anchors are each template's rarest words by corpus IDF."""

    def __init__(self, templates=TEMPLATES, base=BASE_PHRASES, idf: dict[bytes, float] | None = None, anchors: int = 3):
        split = lambda s: s.encode().split()
        self.base = [(split(p), label) for p, label in base]
        self.templates = [(label, split(t), [split(k) for k in keys]) for label, t, keys in templates]
        self.vocabulary = frozenset(w for _, ws, _ in self.templates for w in ws) | {
            w for _, _, keys in self.templates for k in keys for w in k} | {w for ws, _ in self.base for w in ws}
        idf = idf or {}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.need, self.slack = [], [len(ws) // 6 if len(ws) >= 8 else 0 for _, ws, _ in self.templates]
        for t, (_, ws, _) in enumerate(self.templates):
            rare = sorted(set(ws), key=lambda w: (-idf.get(w, 0.0), w))[:max(anchors, len(ws) // 5)]
            self.need.append(min(2, len(rare)))
            for i, w in enumerate(ws):
                if w in rare:
                    self.postings.setdefault(w, []).append((t, i))
        self.idf = idf

    def scan(self, text: str | None, min_score: float = 0.6) -> tuple:
        ws = licence_words(text)
        where: dict[bytes, list[int]] = {}
        for i, w in enumerate(ws):
            if w in self.vocabulary:
                where.setdefault(w, []).append(i)
        starts, base = [], set()
        for phrase, label in self.base:
            if found := places(ws, where, phrase):
                starts += found
                base.add(label)
        votes: dict[int, dict[int, set[bytes]]] = {}
        for w in sorted(set(where) & set(self.postings), key=lambda w: (-self.idf.get(w, 0.0), w)):
            for i in where[w]:
                for t, at in self.postings[w]:
                    votes.setdefault(t, {}).setdefault(i - at, set()).add(w)
        labels, score = set(base), 0.0
        for t, offsets in votes.items():
            if len(set().union(*offsets.values())) < self.need[t]:
                continue
            label = self.templates[t][0]
            for offset in offsets:
                if label in labels and score == 1.0:
                    break
                share = self.share(ws, where, t, offset, offsets, min_score)
                if share is not None:
                    labels.add(label)
                    score = max(score, share)
        return (len(ws), len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score)

    def share(self, ws, where, t: int, offset: int, offsets: dict[int, set[bytes]], min_score: float) -> float | None:
        """Share of the template's words at their place under an offset within ``slack`` of this one; None: no match."""
        _, template, keys = self.templates[t]
        band = range(offset - self.slack[t], offset + self.slack[t] + 1)
        if len(set().union(*(offsets.get(o, ()) for o in band))) < self.need[t]:
            return None
        hits = sum(any(0 <= o + j < len(ws) and ws[o + j] == w for o in band) for j, w in enumerate(template))
        lo, hi = max(0, band[0]), min(len(ws), band[-1] + len(template))
        found = hits >= min_score * len(template) and all(places(ws, where, k, lo, hi) for k in keys)
        return hits / len(template) if found else None


_SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
           "labels string, score double")
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]


def inverse_frequencies(docs: DataFrame, index: Index) -> dict[bytes, float]:
    """IDF over all documents of the words in the index (one row per word reaches the driver)."""
    vocabulary = index.vocabulary

    def count(batches):
        seen, rows = dict.fromkeys(vocabulary, 0), 0
        for batch in batches:
            for text in batch.column(0):
                rows += 1
                for w in vocabulary.intersection(licence_words(text.as_py())):
                    seen[w] += 1
        found = [(w.decode(), n) for w, n in seen.items() if n] + [("", rows)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["word", "n"])

    counts = dict(map(tuple, docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n")).collect()))
    total = counts.pop("", 0)
    return {w: math.log((total + 1) / (counts.get(w.decode(), 0) + 1)) for w in vocabulary}


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE_PHRASES, anchors: int = 3, min_score: float = 0.6,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, base places and labels, and the labels and score of the template search, per document."""
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = Index(templates, base, inverse_frequencies(slim.select("text"), Index(templates, base)), anchors)

    def run(batches):
        for batch in batches:
            found = [index.scan(t.as_py(), min_score) for t in batch.column(1)]
            if found:
                columns = [pa.array(c, t) for c, t in zip(zip(*found), _TYPES[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=_NAMES)

    return slim.mapInArrow(run, _SCHEMA)
