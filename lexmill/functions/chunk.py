"""Regular-expression chunks over tags, and a dependency heuristic."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches
from . import text as T
from .arrow import arrow_function

_COUNT = {"?": (0, 1), "*": (0, None), "+": (1, None)}


def rules(grammar: str) -> list[tuple[str, list[tuple[re.Pattern, int, int | None]]]]:
    """Lines "NP: {<DT>?<JJ.*>*<NN>+}"."""
    out = []
    for line in grammar.splitlines():
        if m := re.fullmatch(r"([A-Za-z_]\w*)\s*:\s*\{(.+)\}\s*", line.strip()):
            atoms = [(re.compile(f"(?:{tag})"), *_COUNT.get(q, (1, 1))) for tag, q in re.findall(r"<([^>]+)>([?*+]*)", m.group(2))]
            if atoms:
                out.append((m.group(1), atoms))
    return out


def _match(tags: list[str], free: list[bool], at: int, atoms: list, k: int = 0) -> int:
    """End of the greedy match from a place, -1 without one."""
    if k == len(atoms):
        return at
    pattern, least, most = atoms[k]
    end = at
    while end < len(tags) and free[end] and (most is None or end - at < most) and pattern.fullmatch(tags[end]):
        end += 1
    for stop in range(end, at + least - 1, -1):
        got = _match(tags, free, stop, atoms, k + 1)
        if got >= 0:
            return got
    return -1


def iob(tags: list[str], grammar: list) -> list[str]:
    """B-, I- and O labels; each rule chunks what earlier rules left."""
    out = ["O"] * len(tags)
    free = [True] * len(tags)
    for label, atoms in grammar:
        i = 0
        while i < len(tags):
            end = _match(tags, free, i, atoms) if free[i] else -1
            if end <= i:
                i += 1
                continue
            out[i:end] = [f"B-{label}"] + [f"I-{label}"] * (end - i - 1)
            free[i:end] = [False] * (end - i)
            i = end
    return out


def chunk_iob(tags: Column | str, grammar: str) -> Column:
    """Arrays of tags to arrays of IOB labels."""
    g = rules(grammar)
    return arrow_function(lambda t: iob(list(t), g), "array<string>")(tags)


def _spans(codes: np.ndarray, names: list[str], atoms: list) -> tuple[np.ndarray, np.ndarray]:
    """Where a rule's chunks begin and end among the codes of all texts' tags, which a 0 parts. Tags are letters here and
    a rule is a pattern of them, which backtracks as _match does."""
    kind = {(0, 1): "?", (0, None): "*", (1, None): "+", (1, 1): ""}
    letters = ["".join(chr(65 + i) for i, tag in enumerate(names) if tag_.fullmatch(tag)) for tag_, _, _ in atoms]
    rule = "".join((f"[{own}]" if own else "(?:(?!))") + kind[least, most] for own, (_, least, most) in zip(letters, atoms, strict=True))
    found = np.array([m.span() for m in re.finditer(rule.encode(), codes.tobytes())], np.int64).reshape(-1, 2)
    return found[found[:, 1] > found[:, 0]].T


def iob_all(tags: pa.DictionaryArray, first: np.ndarray, grammar: list) -> pa.Array:
    """iob of the tags of many texts at once, of which each begins at a place of first and the last ends there."""
    names, labels = tags.dictionary.to_pylist(), ["O", *(x for label, _ in grammar for x in (f"B-{label}", f"I-{label}"))]
    codes = np.insert(tags.indices.to_numpy(zero_copy_only=False).astype(np.uint8) + 65, first[1:-1], 0)
    out = np.zeros(len(codes), np.int32)
    for k, (_, atoms) in enumerate(grammar):
        begin, end = _spans(codes, names, atoms)
        change = np.zeros(len(codes) + 1, np.int32)
        np.add.at(change, begin, 1)
        np.add.at(change, end, -1)
        inside = np.cumsum(change[:-1]) > 0
        out[inside] = 2 * k + 2
        out[begin] = 2 * k + 1
        codes[inside] = 0
    return pa.array(labels).take(pa.array(np.delete(out, first[1:-1] + np.arange(max(0, len(first) - 2)))))


def chunked(docs: DataFrame, grammar: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pos, token, tag, iob) of texts tagged by rule."""
    g = rules(grammar)

    def run(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        toks, first = batches.tokens(texts)
        tags = batches.tags(toks)
        of = np.repeat(np.arange(len(texts)), np.diff(first))
        return of, [pa.array(batches.numbered(first), pa.int32()), toks, tags.cast(pa.string()), iob_all(tags, first, g)]

    return batches.mapped(docs, key, text, "pos int, token string, tag string, iob string", run)


_VERBS = frozenset("am are be been being did do does had has have is was were".split())


def dependencies(tokens: list[str], tags: list[str]) -> dict:
    """The first verb is the root; nouns and pronouns before it are subjects, after it objects, and so on by tag."""
    low = [t.lower() for t in tokens]
    tags = [*tags, *["NN"] * len(tokens)][: len(tokens)]
    root = next((i for i, (w, t) in enumerate(zip(low, tags, strict=True)) if t.startswith("VB") or w in _VERBS), 0 if low else -1)
    arcs = []
    for i, (w, t) in enumerate(zip(low, tags, strict=True)):
        if i == root:
            continue
        head, name = root, "dep"
        if re.fullmatch("[,.;:!?]", w):
            name = "punct"
        elif t.startswith("NN") or t == "PRP":
            name = "nsubj" if i < root else "obj"
        elif t.startswith("JJ"):
            head, name = next((j for j in range(i + 1, len(tags)) if tags[j].startswith("NN")), root), "amod"
        elif t.startswith("RB"):
            name = "advmod"
        elif t.startswith("IN") or t == "TO":
            name = "prep"
        arcs.append({"head": head, "dep": i, "relation": name})
    return {"tokens": low, "tags": tags, "root": root, "arcs": arcs}


_DEP = "struct<tokens:array<string>,tags:array<string>,root:int,arcs:array<struct<head:int,dep:int,relation:string>>>"
dependency_parse = arrow_function(lambda w, t: dependencies(list(w), list(t)), _DEP)


def dependency_text(text: Column | str, lower: bool = True) -> Column:
    """Of a text's words; tags come from the lower-cased words unless lower is False."""
    words = F.filter(T.word_tokens(text), lambda t: t.rlike("[A-Za-z0-9']"))
    words = F.transform(words, F.lower) if lower else words
    return dependency_parse(words, F.transform(T.raw_ascii_tokens(F.array_join(words, " ")), T.rule_tag))
