"""Byte-pair merges read from a tokenizer file, and the prefix property they obey.

The encoding of a prefix of a word is the encoding of a shorter prefix plus one more token.
The token that may follow another is decided by the two merge trees alone (``fits``), so one
left-to-right pass gives the last token, and by it the encoding, of every prefix of a word.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable
from functools import lru_cache

#: Takes the place of a vocabulary's end-of-word suffix, as one character.
END = "\ue000"
NEVER = 1 << 60
#: Pairs of tokens whose borders are remembered.
MOST_PAIRS = 300_000
#: Next nodes, tokens that end it, what it stands for.
Node = tuple[dict[str, "Node"], tuple[tuple[int, int, dict[int, bool]], ...], str]


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next of U+0100..."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(odd)) for b in range(256)]


def shared_prefix(a: str, b: str) -> int:
    """How many first characters two strings share."""
    for k, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return k
    return min(len(a), len(b))


class Letters:
    """Where the tokenizer library's tables of Unicode and Python's differ; asked of the library itself.

    Of code points that Python does not know, ``newer`` has the letters and numbers and ``lower``
    those with another lower case; ``strange`` finds code points that the two may normalise differently.
    """

    def __init__(self):
        from tokenizers import Regex, normalizers, pre_tokenizers

        # Planes 4 to 13 are empty in every version of Unicode, and the last two are private.
        points = (*range(0x40000), *range(0xE0000, 0xF0000))
        unknown = "".join(c for c in map(chr, points) if unicodedata.category(c) == "Cn")
        runs = lambda kind: (run for run, _ in pre_tokenizers.Split(Regex(f"[^\\p{{{kind}}}]+"), "removed").pre_tokenize_str(unknown))
        self.newer = {kind: frozenset("".join(runs(kind))) for kind in "LN"}
        lowered = normalizers.Lowercase().normalize_str("\n".join(unknown)).split("\n")
        self.lower = {c: x for c, x in zip(unknown, lowered) if x != c}
        self.composed = normalizers.NFC().normalize_str
        # Decompositions and the order of marks, as far as Python knows the code points.
        apart = normalizers.NFD().normalize_str
        marks = [c for c in map(chr, points) if unicodedata.category(c)[0] == "M"]
        tried = [c for c in map(chr, points) if unicodedata.decomposition(c)]
        tried += [x for c in marks for near in "\u0334\u0327\u0323\u0301" for x in (f"a{c}{near}", f"a{near}{c}")]
        same = lambda x, y: y == unicodedata.normalize("NFD", x)
        differ = {c for x, y in zip(tried, apart("\n".join(tried)).split("\n")) if not same(x, y) for c in x + unicodedata.normalize("NFD", x)}
        plain = {c for c in differ if c.isascii()} | set("\u0334\u0327\u0323\u0301")
        points = sorted({*map(ord, differ - plain), *map(ord, unknown)})
        # As in Pieces: a class without astral points is a bitmap.
        self.odd, self.odd_astral = (re.compile(f"[{spans([p for p in points if p <= last])}]") for last in (0xFFFF, sys.maxunicode))

    def strange(self, text: str) -> bool:
        """Whether a text holds a code point that Python and the library may treat differently."""
        return (self.odd if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else self.odd_astral).search(text) is not None


def spans(points: Iterable[int]) -> str:
    """Rising code points as ranges for a class of ``re``."""
    ranges: list[list[int]] = []
    for point in points:
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(maxsize=1)
def letters() -> Letters:
    return Letters()


@lru_cache(maxsize=2)
def classes(last: int = sys.maxunicode) -> dict[str, str]:
    """Letters, numbers and white space of Unicode, up to a code point, as ranges for a class of ``re``."""
    newer = letters().newer
    out = {kind: spans(p for p in range(last + 1) if unicodedata.category(chr(p))[0] == kind or chr(p) in newer[kind]) for kind in "LN"}
    return out | {"S": "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"}


class Pieces:
    """All matches of a pattern over ``classes``; ``re`` keeps classes without astral points as bitmaps."""

    def __init__(self, pattern: str):
        self.plain, self.full = (re.compile(pattern.format(**classes(last))) for last in (0xFFFF, sys.maxunicode))

    def __call__(self, text: str) -> list[str]:
        return (self.plain if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else self.full).findall(text)


class Merges:
    """Vocabulary and merge ranks of a ``.json`` tokenizer with a BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        own = (lambda s: s[: -len(suffix)] + END if suffix and s.endswith(suffix) else s) if suffix else (lambda s: s)
        self.suffix = suffix
        self.ids = {own(k): v for k, v in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.rank = {(own(a), own(b)): r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.parts: dict[str, tuple[str, str, int]] = {}
        for (a, b), r in sorted(self.rank.items(), key=lambda x: x[1]):
            self.parts.setdefault(a + b, (a, b, r))
        alphabet = byte_alphabet()
        self.written = str.maketrans({chr(b): c for b, c in enumerate(alphabet)})
        tokens = {*alphabet, *(c + END for c in alphabet if suffix)}
        for whole, (a, b, r) in self.parts.items():
            if a in tokens and b in tokens and self._apart(a, b, r):
                tokens.add(whole)
        self.names = sorted(tokens)
        self.number = {token: k for k, token in enumerate(self.names)}
        #: The longest token, without its mark, that ends with two given symbols.
        self.reach: dict[str, int] = {}
        for token in self.names:
            bare = len(token) - token.endswith(END)
            for key in {token[-2:], token[-3:]} if bare < len(token) else {token[-2:]}:
                self.reach[key] = max(self.reach.get(key, 1), bare)
        #: For a token, which others stay apart from it on its right, as far as asked.
        self.rights: dict[str, dict[int, bool]] = {}
        self.asked = 0
        # An automaton of suffixes, made as words ask for it: a node stands for what tokens begin with, and
        # that of a prefix of a word for the longest such that ends it. It holds the nodes by the next symbol,
        # the tokens that end it (size, number, rights), longest first, and what it stands for.
        self.root: Node = ({}, (), "")
        self.nodes: dict[str, Node] = {"": self.root}
    def symbols(self, word: str) -> str:
        """The word's UTF-8 bytes in the vocabulary's alphabet."""
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.written)

    def _apart(self, left: str, right: str, before: int = NEVER) -> bool:
        """Whether no merge of rank under ``before`` crosses the border of two tokens.

        Along the border stand, at any time, a node of the left token's right spine and one of
        the right token's left spine; each lives until the rank of the merge that takes it up.
        Of equal ranks the merge further left comes first.
        """
        rank, parts = self.rank, self.parts
        a, a_ends = left, before
        while True:
            b, b_ends = right, before
            while True:
                r = rank.get((a, b))
                if r is not None and r < before and r < a_ends and r <= b_ends:
                    return False
                down = parts.get(b)
                if down is None:
                    break
                b, b_ends = down[0], down[2]
            down = parts.get(a)
            if down is None:
                return True
            a, a_ends = down[1], down[2]

    def fits(self, left: str, right: int) -> bool:
        """Whether token ``left`` followed by the one numbered ``right`` stays as these two tokens."""
        rights = self.rights.setdefault(left, {})
        got = rights.get(right)
        if got is None:
            if self.asked >= MOST_PAIRS:
                self.asked = 0
                for known in self.rights.values():
                    known.clear()
            self.asked += 1
            got = rights[right] = self._apart(left, self.names[right])
        return got

    def last_start(self, word: str, end: int, last: list[str], mark: str = "") -> int:
        """Where the last token of ``word[:end] + mark`` starts, given the last tokens of shorter prefixes: what ``extend`` finds."""
        for start in range(max(0, end - self.reach.get(word[end - 2 : end] + mark, 1)) if end > 1 else 0, end):
            token = self.number.get(word[start:end] + mark)
            if token is not None and (start == 0 or self.fits(last[start], token)):
                return start
        raise ValueError(f"no token ends {word[:end]!r}")

    def begins(self, head: str) -> bool:
        """Whether a token begins with ``head``."""
        at = bisect_left(self.names, head)
        return at < len(self.names) and self.names[at].startswith(head)

    def step(self, node: Node, symbol: str) -> Node:
        """The node after one more symbol."""
        head = node[2] + symbol
        while not self.begins(head):
            head = head[1:]
        if head not in self.nodes:
            ends = (head[k:] for k in range(len(head)))
            self.nodes[head] = {}, tuple((len(t), self.number[t], self.rights.setdefault(t, {})) for t in ends if t in self.number), head
        to = node[0][symbol] = self.nodes[head]
        return to

    def extend(self, word: str, nodes: list[Node], rights: list[dict[int, bool]], starts: list[int]) -> None:
        """Node, rights of the last token and its start for each prefix of ``word``: from those that the lists hold on to all."""
        end = len(nodes) - 1
        node = nodes[end]
        for symbol in word[end:]:
            end += 1
            node = node[0].get(symbol) or self.step(node, symbol)
            for size, token, after in node[1]:
                start = end - size
                if start:
                    fits = rights[start].get(token)
                    if fits is None:
                        fits = self.fits(word[starts[start] : start], token)
                    if not fits:
                        continue
                nodes.append(node)
                rights.append(after)
                starts.append(start)
                break
            else:
                raise ValueError(f"no token ends {word[:end]!r}")


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)
