"""Search expressions to Columns.

AND, OR and NOT in capitals, NOT binds closest, then AND; terms side by side are joined by AND; parentheses group,
double quotes make phrases, ? stands for one character and * for any number within a word. Words are runs of a-z and
digits; a term matches whole words in any case. Where parentheses or quotes don't balance, all words are joined by AND.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands between the values of a list: no part of a word, and no phrase goes over it.
BORDER = " \x01 "

_LEXEME = re.compile(r'\s*(?:(\()|(\))|"([^"]*)"|([^\s()"]+))')


class Unbalanced(ValueError):
    pass


@dataclass(frozen=True)
class Leaf:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Node:
    op: str
    parts: tuple


def words_of(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[a-z0-9*?]*[a-z0-9][a-z0-9*?]*|\*|\?+", text.lower()))


def lex(text: str) -> list[tuple[str, str]]:
    if text.count('"') % 2:
        raise Unbalanced("quotes")
    out = []
    for m in _LEXEME.finditer(text):
        if m[1] or m[2]:
            out.append((m[1] or m[2], ""))
        elif m[3] is not None:
            out.append(("leaf", m[3]))
        elif m[4] in ("AND", "OR", "NOT"):
            out.append((m[4], ""))
        else:
            out.append(("leaf", m[4]))
    return out


class _Parser:
    def __init__(self, tokens):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def many(self, op: str, below, joined: bool):
        parts = []
        while True:
            part = below()
            if part is not None:
                parts.append(part)
            if self.peek() == op:
                self.at += 1
            elif not (joined and self.peek() in ("leaf", "(", "NOT")):
                break
        return None if not parts else parts[0] if len(parts) == 1 else Node(op, tuple(parts))

    def either(self):
        return self.many("OR", self.both, False)

    def both(self):
        return self.many("AND", self.one, True)

    def one(self):
        kind = self.peek()
        if kind == "NOT":
            self.at += 1
            part = self.one()
            return None if part is None else Node("NOT", (part,))
        if kind == "(":
            self.at += 1
            part = self.either()
            if self.peek() != ")":
                raise Unbalanced("parentheses")
            self.at += 1
            return part
        if kind == "leaf":
            words = words_of(self.tokens[self.at][1])
            self.at += 1
            return Leaf(words) if words else None
        return None


def parse(text: str):
    """The tree of an expression, None if it has no words."""
    try:
        p = _Parser(lex(text))
        tree = p.either()
        if p.at < len(p.tokens):
            raise Unbalanced("parentheses")
        return tree
    except Unbalanced:
        found = [Leaf((w,)) for w in words_of(re.sub(r"\b(?:AND|OR|NOT)\b", " ", text))]
        return None if not found else found[0] if len(found) == 1 else Node("AND", tuple(found))


def leaf_pattern(words: tuple[str, ...]) -> str:
    """A pattern over lower-cased text: the words one after another, at word borders."""
    each = ["".join("[a-z0-9]*" if c == "*" else "[a-z0-9]" if c == "?" else c for c in w) for w in words]
    return "(?:^|[^a-z0-9])" + "[^a-z0-9\\x01]+".join(each) + "(?:[^a-z0-9]|$)"


def compile_tree(tree, columns: list[Column]) -> Column:
    """The predicate of a tree over lower-cased text columns; a leaf matches if any column has it."""
    if tree is None:
        return F.lit(True)
    if isinstance(tree, Leaf):
        return reduce(lambda a, b: a | b, [c.rlike(leaf_pattern(tree.words)) for c in columns])
    parts = [compile_tree(p, columns) for p in tree.parts]
    if tree.op == "NOT":
        return ~parts[0]
    return reduce((lambda a, b: a & b) if tree.op == "AND" else (lambda a, b: a | b), parts)


def terms(tree) -> list[str]:
    """Words without wildcards that a match can count, each once in order."""
    if tree is None:
        return []
    if isinstance(tree, Leaf):
        return [w for w in tree.words if not re.search(r"[*?]", w)]
    return list(dict.fromkeys(w for p in tree.parts if not (isinstance(p, Node) and p.op == "NOT") for w in terms(p)))
