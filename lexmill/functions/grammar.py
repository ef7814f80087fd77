"""Context-free, weighted and feature grammars, and parsers of token lists. Grammars are small and travel with the function;
each row is parsed where it lies."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

from .arrow import arrow_function
from .trees import Tree, size, to_bracket

_RULE = re.compile(r"^(.+?)\s*->\s*(.+)$")
_ITEM = re.compile(r"'[^']*'|\"[^\"]*\"|\S+")


@dataclass(frozen=True)
class Grammar:
    """rules: (left side, right side, log probability)."""

    start: str
    rules: tuple[tuple[str, tuple[str, ...], float], ...]

    def heads(self) -> set[str]:
        return {r[0] for r in self.rules}

    def by_head(self) -> dict[str, list[tuple[str, ...]]]:
        out: dict = defaultdict(list)
        for head, body, _ in self.rules:
            out[head].append(body)
        return out


def _quoted(item: str) -> bool:
    return len(item) > 1 and item[0] == item[-1] and item[0] in "'\""


def _lines(text: str):
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and (m := _RULE.match(line)):
            for alternative in m.group(2).split("|"):
                if items := _ITEM.findall(alternative):
                    yield m.group(1).strip(), items


def _plain(items: list[str]) -> tuple[str, ...]:
    return tuple(i[1:-1] if _quoted(i) else i for i in items)


def cfg(text: str, start: str | None = None) -> Grammar:
    """Lines "LHS -> a b | 'word'"; # begins a comment. The first left side is the start symbol."""
    rules = [(head, _plain(items), 0.0) for head, items in _lines(text)]
    if not rules:
        raise ValueError("the grammar has no productions")
    return Grammar(start or rules[0][0], tuple(rules))


def pcfg(text: str, start: str | None = None) -> Grammar:
    """As cfg(), with "[p]" after an alternative; what is missing shares the rest, and each left side sums to 1."""
    groups: dict[str, list[tuple[tuple[str, ...], float | None]]] = {}
    for head, items in _lines(text):
        p = None
        if m := re.fullmatch(r"\[([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)\]", items[-1]):
            p, items = float(m.group(1)), items[:-1]
        if items:
            groups.setdefault(head, []).append((_plain(items), p))
    if not groups:
        raise ValueError("the grammar has no productions")
    rules = []
    for head, rows in groups.items():
        given = sum(p for _, p in rows if p is not None)
        open_ = sum(p is None for _, p in rows)
        share = (1 - given) / open_ if open_ and given < 1 else 0.0
        filled = [share if p is None else p for _, p in rows]
        total = sum(filled)
        for (body, _), p in zip(rows, filled, strict=True):
            rules.append((head, body, math.log(max(1e-12, p / total) if total > 0 else 1 / len(rows))))
    return Grammar(start or next(iter(groups)), tuple(rules))


class Binary:
    """A grammar in binary form: words, single children and pairs to (parent, log probability)."""

    def __init__(self, g: Grammar, term: str = "__TERM_", link: str = "__BIN_"):
        heads = g.heads()
        self.words: dict[str, dict[str, float]] = defaultdict(dict)
        self.single: dict[str, dict[str, float]] = defaultdict(dict)
        self.pairs: dict[tuple[str, str], dict[str, float]] = defaultdict(dict)
        names: dict[str, str] = {}
        made = 0

        def keep(table: dict, key, head: str, p: float) -> None:
            table[key][head] = max(p, table[key].get(head, -math.inf))

        for head, body, p in g.rules:
            if len(body) == 1:
                keep(self.single if body[0] in heads else self.words, body[0], head, p)
                continue
            symbols = []
            for s in body:
                if s not in heads:
                    if s not in names:
                        names[s] = f"{term}{made}"
                        made += 1
                        keep(self.words, s, names[s], 0.0)
                    s = names[s]
                symbols.append(s)
            at, weight = head, p
            for s in symbols[:-2]:
                helper = f"{link}{made}"
                made += 1
                keep(self.pairs, (s, helper), at, weight)
                at, weight = helper, 0.0
            keep(self.pairs, (symbols[-2], symbols[-1]), at, weight)


def _closed(cell: int, up: list[int]) -> int:
    while True:
        new = cell
        rest = cell
        while rest:
            bit = rest & -rest
            new |= up[bit.bit_length() - 1]
            rest ^= bit
        if new == cell:
            return cell
        cell = new


@lru_cache(64)
def _reach(g: Grammar | FeatureGrammar) -> tuple[frozenset[str], float]:
    """The words of a grammar, and the most of them that its start symbol can derive (infinite where symbols recur)."""
    if isinstance(g, Grammar):
        heads, start = g.heads(), g.start
        rules = [(head, [(s, s not in heads) for s in body]) for head, body, _ in g.rules]
    else:
        start = g.start.base
        rules = [(left.base, [(s.base, s.word) for s in body]) for left, body in g.rules]
    most: dict[str, float] = {head: 0 for head, _ in rules}
    for round_ in range(2 * len(most) + 2):
        for head, body in rules:
            n = sum(1 if word else most.get(s, 0) for s, word in body)
            if n > most[head]:
                most[head] = n if round_ <= len(most) else math.inf
    return frozenset(s for _, body in rules for s, word in body if word), most.get(start, 0)


def possible(tokens: list[str], g: Grammar | FeatureGrammar) -> bool:
    """False where no parser can accept: there is no token, one that the grammar doesn't have, or more than it can derive.
    Takes linear time, so that runs of any length can be asked for."""
    words, most = _reach(g)
    return 0 < len(tokens) <= most and all(t in words for t in tokens)


def recognize(tokens: list[str], g: Grammar) -> bool:
    """Whether the start symbol derives the tokens: sets of symbols as bits of integers."""
    b = Binary(g)
    ids: dict[str, int] = {}
    for table in (b.words, b.single, b.pairs):
        for key, parents in table.items():
            for s in (*(key if isinstance(key, tuple) else (key,) if table is b.single else ()), *parents):
                ids.setdefault(s, len(ids))
    if g.start not in ids or not tokens:
        return False
    mask = lambda parents: sum(1 << ids[s] for s in parents)
    up = [0] * len(ids)
    for child, parents in b.single.items():
        up[ids[child]] |= mask(parents)
    pairs = [(1 << ids[x], 1 << ids[y], mask(parents)) for (x, y), parents in b.pairs.items()]
    n = len(tokens)
    chart = {(i, i + 1): _closed(mask(b.words.get(t, ())), up) for i, t in enumerate(tokens)}
    for span in range(2, n + 1):
        for i in range(n - span + 1):
            cell = 0
            for k in range(i + 1, i + span):
                left, right = chart[i, k], chart[k, i + span]
                if left and right:
                    for x, y, parents in pairs:
                        if left & x and right & y:
                            cell |= parents
            chart[i, i + span] = _closed(cell, up)
    return bool(chart[0, n] >> ids[g.start] & 1)


def chart_parse(tokens: list[str], g: Grammar, most: int = 8) -> list[Tree]:
    """Up to most trees a cell, bottom up; the smallest first. Symbols that stand for parts of long rules stay visible."""
    if not recognize(tokens, g):
        return []
    b, n = Binary(g), len(tokens)
    chart: dict[tuple[int, int], dict[str, dict[Tree, None]]] = {}

    def put(cell: dict, head: str, tree: Tree) -> bool:
        trees = cell.setdefault(head, {})
        if len(trees) >= most or tree in trees:
            return False
        trees[tree] = None
        return True

    def close(cell: dict) -> None:
        queue = list(cell)
        for child in queue:
            for head in b.single.get(child, ()):
                if any([put(cell, head, (head, (t,))) for t in list(cell[child])]):
                    queue.append(head)

    for i, t in enumerate(tokens):
        cell = chart[i, i + 1] = {}
        for head in b.words.get(t, ()):
            put(cell, head, (head, (t,)))
        close(cell)
    for span in range(2, n + 1):
        for i in range(n - span + 1):
            cell = chart[i, i + span] = {}
            for k in range(i + 1, i + span):
                for x, lefts in chart[i, k].items():
                    for y, rights in chart[k, i + span].items():
                        for head in b.pairs.get((x, y), ()):
                            for l in lefts:  # noqa: E741
                                for r in rights:
                                    put(cell, head, (head, (l, r)))
            close(cell)
    return sorted(chart[0, n].get(g.start, ()), key=size)


def earley_recognize(tokens: list[str], g: Grammar) -> bool:
    """Earley's algorithm on the grammar as it is."""
    rules, n = g.by_head(), len(tokens)
    states: list[dict] = [{} for _ in range(n + 1)]
    states[0] = {(g.start, body, 0, 0): None for body in rules[g.start]}
    for i in range(n + 1):
        queue = list(states[i])
        for head, body, dot, origin in queue:
            new = []
            if dot == len(body):
                new = [(h, b, d + 1, o) for h, b, d, o in list(states[origin]) if d < len(b) and b[d] == head]
            elif body[dot] in rules:
                new = [(body[dot], b, 0, i) for b in rules[body[dot]]]
            elif i < n and tokens[i] == body[dot]:
                states[i + 1][head, body, dot + 1, origin] = None
            for s in new:
                if s not in states[i]:
                    states[i][s] = None
                    queue.append(s)
    return any(h == g.start and d == len(b) and o == 0 for h, b, d, o in states[n])


def earley_parse(tokens: list[str], g: Grammar, most: int = 8) -> list[Tree]:
    return chart_parse(tokens, g, most) if earley_recognize(tokens, g) else []


def _first_words(g: Grammar) -> dict[str, set[str]]:
    rules = g.by_head()
    first: dict[str, set[str]] = {h: set() for h in rules}
    grown = True
    while grown:
        grown = False
        for head, bodies in rules.items():
            for body in bodies:
                new = first[body[0]] if body[0] in rules else {body[0]}
                if not new <= first[head]:
                    first[head] |= new
                    grown = True
    return first


def descent_parse(tokens: list[str], g: Grammar, most: int = 8, left_corner: bool = False) -> list[Tree]:
    """Top down with memory; left recursion yields nothing. With left corners, rules are tried only where the next word can
    begin them."""
    rules = g.by_head()
    first = _first_words(g) if left_corner else {}
    limit = max(32, 4 * len(tokens))
    memo: dict[tuple[str, int], list[tuple[Tree, int]]] = {}
    busy: set[tuple[str, int]] = set()

    def parse(head: str, at: int, deep: int) -> list[tuple[Tree, int]]:
        key = (head, at)
        if key in memo:
            return memo[key]
        if deep > limit or key in busy or (left_corner and (at >= len(tokens) or tokens[at] not in first[head])):
            return []
        busy.add(key)
        out: dict[tuple[Tree, int], None] = {}
        for body in rules[head]:
            if left_corner and tokens[at] not in (first[body[0]] if body[0] in rules else {body[0]}):
                continue
            partial: list[tuple[tuple, int]] = [((), at)]
            for s in body:
                step = []
                for done, i in partial:
                    if s in rules:
                        step += [((*done, t), j) for t, j in parse(s, i, deep + 1)]
                    elif i < len(tokens) and tokens[i] == s:
                        step.append(((*done, s), i + 1))
                partial = step[: most * 8]
            out |= {((head, done), i): None for done, i in partial}
        busy.discard(key)
        memo[key] = list(out)
        return memo[key]

    whole = [t for t, i in (parse(g.start, 0, 0) if g.start in rules else []) if i == len(tokens)]
    return sorted(whole[:most], key=size)


def viterbi_parse(tokens: list[str], g: Grammar) -> tuple[Tree, float] | None:
    """The most probable tree and its log probability; the first found of equals."""
    if not tokens:
        return None
    b, n = Binary(g, "__PTERM_", "__PBIN_"), len(tokens)
    chart: dict[tuple[int, int], dict[str, tuple[float, Tree]]] = {}

    def better(cell: dict, head: str, p: float, tree: Tree) -> bool:
        if head in cell and p <= cell[head][0] + 1e-12:
            return False
        cell[head] = (p, tree)
        return True

    def close(cell: dict) -> None:
        queue = list(cell)
        for child in queue:
            for head, p in b.single.get(child, {}).items():
                if better(cell, head, cell[child][0] + p, (head, (cell[child][1],))):
                    queue.append(head)

    for i, t in enumerate(tokens):
        cell = chart[i, i + 1] = {}
        for head, p in b.words.get(t, {}).items():
            better(cell, head, p, (head, (t,)))
        close(cell)
    for span in range(2, n + 1):
        for i in range(n - span + 1):
            cell = chart[i, i + span] = {}
            for k in range(i + 1, i + span):
                for x, (p, l) in chart[i, k].items():  # noqa: E741
                    for y, (q, r) in chart[k, i + span].items():
                        for head, w in b.pairs.get((x, y), {}).items():
                            better(cell, head, p + q + w, (head, (l, r)))
            close(cell)
    best = chart[0, n].get(g.start)
    return (best[1], best[0]) if best else None


# Feature grammars


@dataclass(frozen=True)
class Symbol:
    base: str
    word: bool = False
    features: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class FeatureGrammar:
    start: Symbol
    rules: tuple[tuple[Symbol, tuple[Symbol, ...]], ...]


def symbol(raw: str) -> Symbol:
    """NP[num=?n,def]: a feature without a value is true, a value that begins with ? a variable."""
    if _quoted(raw):
        return Symbol(raw[1:-1], True)
    m = re.fullmatch(r"([A-Za-z_]\w*)(?:\[(.+)\])?", raw)
    if not m:
        return Symbol(raw)
    found = {}
    for item in filter(None, (x.strip() for x in (m.group(2) or "").split(","))):
        k = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*([^\s,\]]+)", item)
        found[k.group(1) if k else item] = k.group(2) if k else "true"
    return Symbol(m.group(1), False, tuple(found.items()))


def feature_cfg(text: str, start: str | None = None) -> FeatureGrammar:
    rules = []
    for head, items in _lines(text):
        left = symbol(head)
        if left.word:
            raise ValueError("a word can't be a left side")
        rules.append((left, tuple(map(symbol, items))))
    if not rules:
        raise ValueError("the grammar has no productions")
    return FeatureGrammar(symbol(start) if start else rules[0][0], tuple(rules))


def _value(x: str, env: dict[str, str]) -> str:
    for _ in range(32):
        if not x.startswith("?") or env.get(x, x) == x:
            break
        x = env[x]
    return x


def _unify(pattern: dict[str, str], wanted: dict[str, str], env: dict[str, str]) -> bool:
    for key, x in wanted.items():
        if key not in pattern:
            return False
        a, b = _value(pattern[key], env), _value(x, env)
        if a.startswith("?"):
            if b.startswith("?"):
                if a != b:
                    env[b] = a
            else:
                env[a] = b
        elif b.startswith("?"):
            env[b] = a
        elif a != b:
            return False
    return True


def feature_parse(tokens: list[str], g: FeatureGrammar, most: int = 8) -> list[Tree]:
    """Top down with unification; a symbol recurs at most four times at one place. Labels show the features' values."""
    rules = defaultdict(list)
    for left, body in g.rules:
        rules[left.base].append((left, body))
    limit = max(32, 4 * len(tokens))
    active: dict[tuple[str, int], int] = defaultdict(int)

    def parse(base: str, wanted: dict[str, str], at: int, env: dict[str, str], deep: int) -> list[tuple[Tree, int, dict]]:
        if deep > limit or active[base, at] > 3:
            return []
        active[base, at] += 1
        out: dict[tuple[Tree, int], dict] = {}
        for left, body in rules.get(base, ()):
            own = dict(env)
            if not _unify(dict(left.features), wanted, own):
                continue
            states = [((), at, own)]
            for s in body:
                step = []
                for done, i, e in states:
                    if s.word:
                        if i < len(tokens) and tokens[i] == s.base:
                            step.append(((*done, s.base), i + 1, e))
                    else:
                        step += [((*done, t), j, f) for t, j, f in parse(s.base, dict(s.features), i, dict(e), deep + 1)]
                states = step[: most * 12]
            for done, i, e in states:
                shown = {k: _value(v, e) for k, v in (dict(left.features) | wanted).items()}
                label = base + (f"[{','.join(f'{k}={v}' for k, v in sorted(shown.items()))}]" if shown else "")
                out.setdefault(((label, done), i), e)
        active[base, at] -= 1
        return [(t, i, e) for (t, i), e in out.items()][: most * 8]

    found = parse(g.start.base, dict(g.start.features), 0, {}, 0)
    return [t for t, i, _ in found if i == len(tokens)][:most]


# Columns

_GRAMMAR_TOKEN = re.compile(r"[A-Za-z0-9']")


def grammar_tokens(text: str, lower: bool = True) -> list[str]:
    """Words of a sentence for a grammar: punctuation left out."""
    from .words import words

    found = [w for w in words(text) if _GRAMMAR_TOKEN.search(w)]
    return [w.lower() for w in found] if lower else found


_PARSERS = {
    "chart": chart_parse,
    "earley": earley_parse,
    "recursive_descent": descent_parse,
    "left_corner": lambda t, g, most=8: descent_parse(t, g, most, True),
}


def _if_possible(parse, g: Grammar | FeatureGrammar, none):
    return lambda tokens: parse(tokens) if possible(tokens, g) else none


def parse_text(g: Grammar, method: str = "chart", most: int = 8, lower: bool = True):
    """Texts to arrays of bracket strings."""
    run = _if_possible(lambda t: _PARSERS[method](t, g, most), g, [])
    return arrow_function(lambda t: [to_bracket(x) for x in run(grammar_tokens(t, lower))], "array<string>")


def parse_tokens(g: Grammar, method: str = "chart", most: int = 8):
    run = _if_possible(lambda t: _PARSERS[method](t, g, most), g, [])
    return arrow_function(lambda t: [to_bracket(x) for x in run(list(t))], "array<string>")


def recognize_text(g: Grammar):
    run = _if_possible(lambda t: recognize(t, g), g, False)
    return arrow_function(lambda t: run(grammar_tokens(t)), "boolean")


def parse_text_weighted(g: Grammar, lower: bool = True):
    best = _if_possible(lambda t: viterbi_parse(t, g), g, None)

    def run(t: str):
        got = best(grammar_tokens(t, lower))
        return got and {"tree": to_bracket(got[0]), "log_prob": got[1], "prob": math.exp(got[1])}

    return arrow_function(run, "struct<tree:string,log_prob:double,prob:double>")


def parse_text_features(g: FeatureGrammar, most: int = 8, lower: bool = True):
    run = _if_possible(lambda t: feature_parse(t, g, most), g, [])
    return arrow_function(lambda t: [to_bracket(x) for x in run(grammar_tokens(t, lower))], "array<string>")
