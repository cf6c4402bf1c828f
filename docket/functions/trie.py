"""Whole lexicons as one pattern: a trie of characters, walked once per text (JVM-side).

An alternation tries its terms one by one at every position, so its cost grows with their
number. Here terms with a common beginning share it, so a position costs about as many
steps as characters agree, whether the lexicon has ten terms or ten thousand. Single words
and phrases take the same path. Terms are matched on lower-cased text: the characters either
side of a hit are not ``a``-``z``, and any white space may stand between a phrase's words.

A hit is the longest term that starts at a place. The terms that are beginnings of it are
hits of the same place (:meth:`Terms.count` and :meth:`Terms.any` count them too), and a
later start inside a hit is tried as well, so every occurrence of every term counts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docket.functions.text import _WS, escape_term

_END = ""  # key of a node where a term ends
_NOT_INSIDE = "(?![a-z])"


def normal(term: str) -> str:
    """A term as hits are listed: lower case, one space between words."""
    return " ".join(term.lower().split())


def _node(terms: Iterable[str]) -> dict:
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[_END] = {}
    return root


def _branches(node: dict) -> str:
    """The pattern below a node; ends come last, so the longest term is taken."""
    ways = []
    for c, child in sorted(node.items()):
        if c == _END:
            continue
        run = c
        while len(child) == 1 and _END not in child:  # a stretch without branches
            (step, child), = child.items()
            run += step
        ways.append("".join(_WS if x == " " else escape_term(x) for x in run) + _branches(child))
    if _END in node:
        ways.append(_NOT_INSIDE)
    return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"


def trie_pattern(terms: Iterable[str]) -> str:
    """Pattern (Spark only: look-around) whose group 1 is the longest term starting at a place.

    It takes up no characters, so a search goes on one character further and finds hits
    within hits. No terms: it matches nothing.
    """
    terms = sorted({normal(t) for t in terms} - {""})
    if not terms:
        return "((?!))"
    firsts = "".join(("\\" + c if c in "\\]^-[&" else c) for c in sorted({t[0] for t in terms}))
    return f"(?=[{firsts}])(?<![a-z])(?=({_branches(_node(terms))}))"


def _number(hits: Column, terms: list[str]) -> Column:
    return F.size(F.filter(hits, lambda h: h.isin(*terms)))


class Terms:
    """Groups of terms compiled into one trie; ``hits`` lists a text's hits, the rest reads that list."""

    def __init__(self, **groups: Iterable[str]):
        self.groups = {name: frozenset(normal(t) for t in terms) - {""} for name, terms in groups.items()}
        self.terms = frozenset().union(*self.groups.values())
        self.pattern = trie_pattern(self.terms)

    def hits(self, lower_text: Column) -> Column:
        """The longest term at every place where one starts, in order: one scan for all groups."""
        found = F.regexp_extract_all(lower_text, F.lit(self.pattern), 1)
        if any(" " in t for t in self.terms):
            found = F.transform(found, lambda h: F.regexp_replace(h, _WS, " "))
        return found

    def _within(self, term: str) -> list[str]:
        """The term and those that are beginnings of it, up to the edge of a word."""
        return [term] + [term[:i] for i in range(1, len(term)) if term[:i] in self.terms and not "a" <= term[i] <= "z"]

    def any(self, hits: Column, group: str) -> Column:
        """Whether a term of the group occurs."""
        telling = sorted(t for t in self.terms if self.groups[group].intersection(self._within(t)))
        return F.exists(hits, lambda h: h.isin(*telling)) if telling else F.lit(False)

    def count(self, hits: Column, group: str) -> Column:
        """Number of places and terms of the group: a term inside a longer one counts, too."""
        weights: dict[int, list[str]] = {}
        for t in sorted(self.terms):
            if n := len(self.groups[group].intersection(self._within(t))):
                weights.setdefault(n, []).append(t)
        total = F.lit(0)
        for n, terms in sorted(weights.items()):
            total = total + _number(hits, terms) * n
        return total
