"""The Spark-side look-around term pattern finds exactly what the portable one finds."""

import random
import re

from docket.functions.text import term_count_pattern, term_pattern

TERMS = ["thing", "erble", "a civil claim", "cause-of", "x"]
ALPHABET = list("thingerblacivlmusof -x.\n") + ["thing", " erble ", "a civil claim", "cause-of"]


def test_patterns_agree_on_random_text():
    rnd = random.Random(3)
    find, port = re.compile(term_count_pattern(TERMS)), re.compile(term_pattern(TERMS))
    for _ in range(3000):
        s = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30)))
        assert bool(find.search(s)) == bool(port.search(s)), s


def test_count_pattern_counts_adjacent_hits():
    assert len(re.findall(term_count_pattern(["thing"]), "thing thing,thing")) == 3
    assert len(re.findall(term_count_pattern(["thing"]), "things xthing")) == 0
