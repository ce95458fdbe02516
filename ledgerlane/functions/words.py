"""Label patterns as one trie.

The label patterns are finite but for white space.  All words they can match
are written out and merged into one prefix tree, which becomes one pattern: at
a place of a text it looks at each character once and stops at the first that
no label goes on with.
"""

from __future__ import annotations

from functools import lru_cache
from re import _constants as codes
from re import _parser as parser

#: stands for one or more white-space characters among the letters of a word
GAP = "\u0000"
END = "\u0001"


def spelled(pattern: str) -> list[str]:
    """Everything ``pattern`` matches, in lower case, gaps as ``GAP``."""
    return sorted(_sequence(parser.parse(pattern)))


def _sequence(items) -> set[str]:
    found = {""}
    for item in items:
        tails = _one(*item)
        found = {head + tail for head in found for tail in tails}
    return found


def _one(code, value) -> set[str]:
    if code is codes.LITERAL:
        return {chr(value).lower()}
    if code is codes.IN:
        if value == [(codes.CATEGORY, codes.CATEGORY_SPACE)]:
            return {GAP}
        return {chr(v).lower() for c, v in value if c is codes.LITERAL}
    if code is codes.SUBPATTERN:
        return _sequence(value[3])
    if code is codes.BRANCH:
        return set().union(*(_sequence(branch) for branch in value[1]))
    if code is codes.MAX_REPEAT:
        least, most, items = value
        found = _sequence(items)
        if most is codes.MAXREPEAT and found != {GAP}:
            raise ValueError("only white space may repeat")
        return found | {""} if least == 0 else found
    raise ValueError(f"no label pattern has {code}")


@lru_cache
def trie_pattern(patterns: tuple[str, ...], gap: str, end: str) -> str:
    """One pattern that matches where any of ``patterns`` does, the longest
    first.

    ``gap`` matches white space, ``end`` what has to follow a label.
    """
    root: dict = {}
    for pattern in patterns:
        for word in spelled(pattern):
            node = root
            for letter in word:
                node = node.setdefault(letter, {})
            node[END] = {}

    def written(node: dict) -> str:
        ways = []
        for letter in sorted(node):
            if letter == END:
                continue
            own = gap if letter == GAP else "\\" + letter if letter in ".^$*+?()[]{}|\\/" else letter
            ways.append(own + written(node[letter]))
        if END in node:
            ways.append(end)
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return written(root)


@lru_cache
def rule_of_words(patterns: tuple[str, ...]) -> dict[str, int]:
    """The first pattern for each word, gaps as one space."""
    rules: dict[str, int] = {}
    for number, pattern in enumerate(patterns):
        for word in spelled(pattern):
            rules.setdefault(word.replace(GAP, " "), number)
    return rules
