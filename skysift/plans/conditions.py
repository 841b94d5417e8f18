"""Boolean conditions over named detections: text -> tree.

Tree nodes are tuples: ("name", x), ("not", t), ("and", [t...]), ("or", [t...]), ("of", quantity, pattern), where
quantity is "all" or a number and pattern a name, a glob with *, or "them".
"""

from __future__ import annotations

import re

MAX_TEXT, MAX_DEPTH = 64 * 1024, 64
_token = re.compile(r"\s*(\(|\)|[^\s()]+)")


class BadCondition(ValueError):
    """The condition can't be parsed, or names nothing."""


def parse(text: str) -> tuple:
    """Precedence: not over and over or; `1 of x*`, `any of them`, `all of x*`, `3 of them` are selectors."""
    if len(text) > MAX_TEXT:
        raise BadCondition("condition is longer than 64 KiB")
    tokens = _token.findall(text)
    at = 0

    def peek() -> str:
        return tokens[at].lower() if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise BadCondition(f"condition ends too soon: {text!r}")
        at += 1
        return tokens[at - 1]

    def chain(word: str, inner, depth: int) -> tuple:
        parts = [inner(depth)]
        while peek() == word:
            take()
            parts.append(inner(depth))
        flat = [y for x in parts for y in (x[1] if x[0] == word else [x])]
        return parts[0] if len(parts) == 1 else (word, flat)

    def either(depth: int) -> tuple:
        return chain("or", both, depth)

    def both(depth: int) -> tuple:
        return chain("and", unary, depth)

    def unary(depth: int) -> tuple:
        if depth > MAX_DEPTH:
            raise BadCondition("condition is nested more than 64 deep")
        word = take()
        low = word.lower()
        if low == "not":
            return ("not", unary(depth + 1))
        if word == "(":
            inner = either(depth + 1)
            if take() != ")":
                raise BadCondition(f"missing ) in {text!r}")
            return inner
        if word == ")" or low in ("and", "or", "of"):
            raise BadCondition(f"unexpected {word!r} in {text!r}")
        if peek() == "of" and (low in ("all", "any") or low.isdigit()):
            take()
            return ("of", "all" if low == "all" else 1 if low == "any" else int(low), take())
        return ("name", word)

    tree = either(0)
    if at != len(tokens):
        raise BadCondition(f"unexpected {tokens[at]!r} in {text!r}")
    return tree


def selected(pattern: str, names: list[str]) -> list[str]:
    """The names a selector's pattern stands for; "them" leaves out names that start with an underscore."""
    if pattern.lower() == "them":
        return [n for n in names if not n.startswith("_")]
    glob = re.compile(".*".join(map(re.escape, pattern.split("*"))) + r"\Z", re.S)
    return [n for n in names if glob.match(n)]


def names_in(tree: tuple) -> set[str]:
    if tree[0] == "name":
        return {tree[1]}
    if tree[0] == "not":
        return names_in(tree[1])
    return set() if tree[0] == "of" else {n for t in tree[1] for n in names_in(t)}


def fold(tree: tuple, names: list[str], leaf, not_, and_, or_, count):
    """Evaluate a tree with the caller's operations; count(list of leaves, n) stands for `n of`."""
    kind = tree[0]
    if kind == "name":
        if tree[1] not in names:
            raise BadCondition(f"unknown detection {tree[1]!r}")
        return leaf(tree[1])
    if kind == "not":
        return not_(fold(tree[1], names, leaf, not_, and_, or_, count))
    if kind == "of":
        chosen = [leaf(n) for n in selected(tree[2], names)]
        return count(chosen, len(chosen) if tree[1] == "all" else tree[1])
    parts = [fold(t, names, leaf, not_, and_, or_, count) for t in tree[1]]
    return and_(parts) if kind == "and" else or_(parts)
