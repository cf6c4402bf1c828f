"""The rule analyzer against a plain-Python implementation of the same rules on random texts."""

import random
import re

import pytest

from docket.config import FIXTURE_LEXICON as LEX
from docket.operators.analyze import RuleAnalyzer

WORDS = ["thtion", "worthless", "thble", "ertion", "thing", "erble", "ering", "attion", "oning",
         "alpha", "beta", "gamma", "Thing", "thingy", "xthing", "delta"]
ENDS = [". ", "! ", "? ", ".\n", ", ", " ", "...  ", "\n"]


def _line(rnd):
    parts = []
    for _ in range(rnd.randint(0, 12)):
        r = rnd.random()
        if r < 0.08:
            parts.append(f"*{rnd.randint(1, 999)}")
        elif r < 0.11:
            parts.append(f"**{rnd.randint(1, 9)}")
        elif r < 0.2:
            parts.append("“" + " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 3))) + "”")
        else:
            parts.append(rnd.choice(WORDS))
        parts.append(rnd.choice(ENDS) if rnd.random() < 0.3 else " ")
    return "".join(parts)


def _texts(n=300, seed=7):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lines = [_line(rnd) for _ in range(rnd.randint(0, 8))]
        if i % 3 == 0:
            lines.insert(0, f"Doe{i} v. Roe, {i} So. 3d {i + 1} (La. {1990 + i % 30})")
        out.append("\n".join(lines))
    return out


def _term(terms):
    return re.compile("(?:^|[^a-z])(?:" + "|".join(terms) + ")(?:[^a-z]|$)")


def _clean(s):
    s = re.sub(r"[ \t\r\n]+", " ", s)
    s = re.sub(r"^ | $", "", s)
    return re.sub(r"[.!?]+$", "", s)


def expected(text):
    head = text.split("\n", 1)[0]
    m = re.search(LEX.citation_pattern, head)
    cite = m.group(0) if m else None
    body = (text.split("\n", 1)[1] if "\n" in text else "") if cite else text
    sents = re.split(r"[.!?][ \n]+", body)
    topic = [s for s in sents if _term(LEX.topic_terms).search(s.lower())]
    both = [s for s in topic if _term(LEX.holding_terms).search(s.lower())]
    words = re.split(r"[^a-z]+", body.lower())
    net = sum(w in LEX.support_terms for w in words) - sum(w in LEX.contra_terms for w in words)
    summ = [c for c in (_clean(s) for s in sents) if c][:3]
    quotes = []
    for m in re.finditer("“([^“”]+)”", text):
        marks = re.findall(r"(?<!\*)\*([0-9]+)", text[:m.start()])
        quotes.append((m.group(1), marks[-1] if marks else None))
    return {
        "blue_book_citation": cite,
        "n_topic": len(topic),
        "n_both": len(both),
        "net_support": net,
        "relevance_level": "High" if both else ("Medium" if topic else "Low"),
        "summary": ". ".join(summ) + ("." if summ else ""),
        "key_points": [_clean(s) for s in topic],
        "quotes": quotes,
    }


@pytest.fixture(scope="module")
def rows(spark):
    texts = _texts()
    df = spark.createDataFrame([(f"{i}.docx", t) for i, t in enumerate(texts)], "filename string, text string")
    got = {r["filename"]: r for r in RuleAnalyzer(LEX).fields(df, keep_private=True).collect()}
    return texts, got


def test_matches_brute_force(rows):
    texts, got = rows
    for i, text in enumerate(texts):
        exp = expected(text)
        g = got[f"{i}.docx"]
        for k in ("blue_book_citation", "n_topic", "n_both", "net_support", "relevance_level", "summary", "key_points"):
            assert g[k] == exp[k], (k, text)
        assert [(q["quote"], q["page"]) for q in g["_quote_records"]] == exp["quotes"], text
