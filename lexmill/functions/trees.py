"""Parse trees as nested tuples (label, children) in Python and as bracket strings in tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from .arrow import arrow_function

Tree = tuple  # (label, (child, ...)); a child is a tree or a word


def to_bracket(tree: Tree | str) -> str:
    return tree if isinstance(tree, str) else f"({tree[0]} {' '.join(map(to_bracket, tree[1]))})" if tree[1] else f"({tree[0]})"


def from_bracket(text: str) -> Tree:
    marks = re.findall(r"\(|\)|[^\s()]+", text)
    at = 0

    def read() -> Tree:
        nonlocal at
        if at + 1 >= len(marks) or marks[at] != "(" or marks[at + 1] in "()":
            raise ValueError("a tree begins with a bracket and a label")
        label, at = marks[at + 1], at + 2
        children: list = []
        while at < len(marks) and marks[at] != ")":
            if marks[at] == "(":
                children.append(read())
            else:
                children.append(marks[at])
                at += 1
        if at == len(marks):
            raise ValueError("a bracket isn't closed")
        at += 1
        return (label, tuple(children))

    tree = read()
    if at != len(marks):
        raise ValueError("something follows the tree")
    return tree


def leaves(tree: Tree) -> list[str]:
    return [w for c in tree[1] for w in ([c] if isinstance(c, str) else leaves(c))]


def depth(tree: Tree) -> int:
    """A parent of words alone has depth 1."""
    return 1 + max((depth(c) for c in tree[1] if not isinstance(c, str)), default=0)


def size(tree: Tree | str) -> int:
    return 1 if isinstance(tree, str) else 1 + sum(map(size, tree[1]))


def map_labels(tree: Tree, f: Callable[[str], str]) -> Tree:
    return (f(tree[0]), tuple(c if isinstance(c, str) else map_labels(c, f) for c in tree[1]))


def collapse_unary(tree: Tree, joiner: str = "+") -> Tree:
    """Chains of single children as one node, labels joined."""
    label, children = tree
    while len(children) == 1 and not isinstance(children[0], str):
        label, children = f"{label}{joiner}{children[0][0]}", children[0][1]
    return (label, tuple(c if isinstance(c, str) else collapse_unary(c, joiner) for c in children))


tree_leaves = arrow_function(lambda t: leaves(from_bracket(t)), "array<string>")
tree_depth = arrow_function(lambda t: depth(from_bracket(t)), "int")
tree_collapsed = arrow_function(lambda t: to_bracket(collapse_unary(from_bracket(t))), "string")


def tree_mapped(f: Callable[[str], str]):
    return arrow_function(lambda t: to_bracket(map_labels(from_bracket(t), f)), "string")
