import random
import re

from docket.llm import licences

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    ws = WORDS.findall((text or "").encode().lower())
    at, labels = [], set()
    for phrase, label in licences.BASE_PHRASES:
        p = phrase.encode().split()
        found = [i for i in range(len(ws)) if ws[i:i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = [
    "Intro words.\nReleased under the MIT License.",
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0. All rights reserved. ALL RIGHTS RESERVED!",
    "general, public; license and cc--by and all rights. Reserved",
    "licensed under the general version of the public park, mit of apache",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this Software",
    "Kelvin Key All rights reserved",  # a non-ASCII capital stays as it is
]


def test_base_matches_brute_force(spark, odd_docs):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").unionByName(
        odd_docs.select("doc_id", "text"))
    got = sorted(((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licences.scan(df).collect()), key=str)
    assert got == sorted((brute(r.text) for r in df.collect()), key=str)


def test_templates_found_by_position_and_key_phrases(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licences.scan(df).collect()}
    assert got[0] == ("mit", 1.0) and got[1] == ("apache-2.0", 1.0)
    assert got[2][0] == "gpl,gpl-3.0" and got[2][1] > 0.8
    assert got[3][0] == "cc-by,cc-by-nc,reserved"
    assert got[5] == ("", 0.0)
    assert got[6][0] == "mit"


def test_base_labels_always_stay(spark):
    df = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    row = licences.scan(df).collect()[0]
    assert row.base_labels == "cc-by" and "cc-by" in row.labels.split(",")


def test_small_edits_keep_a_template(spark):
    notice = "redistribution and use in source and binary forms with or lacking modification are permitted"
    df = spark.createDataFrame([(1, notice), (2, "redistribution of modification forms")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licences.scan(df).collect()}
    assert got[1][0] == "bsd" and 0.8 < got[1][1] < 1 and got[2] == ("", 0.0)


def test_empty_table(no_docs):
    assert licences.scan(no_docs).collect() == []


FORMS = {
    "SPDX-License-Identifier: MIT": "mit",
    "// SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0",
    "MIT License": "mit",
    "Apache License Version 2.0, January 2004": "apache-2.0",
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl,gpl-3.0",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1": "gpl,lgpl-2.1",
    "GNU Affero General Public License version 3": "agpl-3.0,gpl",
    "CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa",
    "Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported": "cc-by-nc-nd",
    "redistribution and use in source and also binary forms with or without modification are permitted": "bsd",
    "permission is hereby kindly granted and use of mit is free": "",
    "the public license of general apache, version 2 of the mit notice": "",
}


def test_common_forms(spark):
    df = spark.createDataFrame(list(enumerate(FORMS)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licences.scan(df).collect()}
    for i, (text, labels) in enumerate(FORMS.items()):
        assert got[i][0] == labels, (text, got[i])
        assert (got[i][1] >= 0.6) == bool(labels), text


def naive(index, text, min_score=0.6):
    """The method's labels without an index: every template at every place, anchors read off the template."""
    ws, labels, best = licences.licence_words(text), set(), 0.0
    for t, (label, template, keys) in enumerate(index.templates):
        anchors = {w for w, ps in index.postings.items() if any(x == t for x, _ in ps)}
        at = lambda o, j: 0 <= o + j < len(ws) and ws[o + j] == template[j]
        rare = lambda o: {w for j, w in enumerate(template) if w in anchors and at(o, j)}
        for o in range(-len(template) + 1, len(ws)):
            if not rare(o):
                continue
            band = range(o - index.slack[t], o + index.slack[t] + 1)
            if len(set().union(*map(rare, band))) < index.need[t]:
                continue
            hits = sum(any(at(b, j) for b in band) for j in range(len(template)))
            part = ws[max(0, band[0]):band[-1] + len(template)]
            inside = lambda k: any(part[i:i + len(k)] == k for i in range(len(part) - len(k) + 1))
            if hits >= min_score * len(template) and all(map(inside, keys)):
                labels.add(label)
                best = max(best, hits / len(template))
    return labels, best


def test_index_finds_what_a_search_of_every_place_finds():
    index = licences.Index()
    rnd = random.Random(11)
    notices = [t for _, t, _ in licences.TEMPLATES]
    found = 0
    for _ in range(250):
        ws = []
        for _ in range(rnd.randint(1, 3)):
            notice = rnd.choice(notices).split()
            for _ in range(rnd.randint(0, 3)):  # words put in, left out, changed
                at = rnd.randrange(len(notice) + 1)
                notice[at:at + rnd.randint(0, 1)] = rnd.choice([[], ["also"], ["license"], ["the", "0"]])
            ws += notice + ["plain"] * rnd.randint(0, 2)
        text = " ".join(ws)
        labels, score = naive(index, text)
        got = index.scan(text)
        base = set(filter(None, got[4].split(",")))
        assert set(filter(None, got[5].split(","))) == base | labels and got[6] == score, text
        found += bool(labels)
    assert found > 100


def test_long_text_of_licence_words():
    got = licences.Index().scan("mit license gnu general public version 3 " * 10_000)
    assert "mit" in got[5] and got[0] == 70_000
