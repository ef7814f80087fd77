"""Averaged-perceptron part-of-speech tagger: 14 features a token, each decided by itself."""

from __future__ import annotations

import json
import random
import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column

from .arrow import arrow_function

TAGS = "CC CD DT IN JJ NN NNP PRP RB TO VB VBD VBG".split()


def token_features(tokens: Sequence[str], i: int) -> list[str]:
    t = tokens[i]
    low = t.lower()
    around = [tokens[j].lower() if 0 <= j < len(tokens) else end for j, end in ((i - 1, "<BOS>"), (i + 1, "<EOS>"))]
    out = ["bias", f"w={low}", f"prev={around[0]}", f"next={around[1]}"]
    out += [f"p{n}={low[:n]}" for n in (1, 2, 3)] + [f"s{n}={low[-n:]}" for n in (1, 2, 3)]
    flags = {"is_upper": t.upper() == t, "is_title": t[:1].upper() == t[:1] != t[:1].lower(), "has_digit": bool(re.search("[0-9]", t)), "has_hyphen": "-" in t}
    return out + [f"{k}={v}" for k, v in flags.items()]


@dataclass
class TaggerModel:
    tags: list[str]
    features: dict[str, int]
    weights: np.ndarray  # features by tags, float32

    def tag(self, tokens: Sequence[str]) -> list[str]:
        out = []
        for i in range(len(tokens)):
            own = [self.features[f] for f in token_features(tokens, i) if f in self.features]
            out.append(self.tags[int(self.weights[own].sum(0, dtype=np.float32).argmax())])
        return out

    def dumps(self) -> str:
        return json.dumps({"version": 1, "type": "perceptron_pos_tagger", "tags": self.tags, "feature_count": len(self.features), "tag_count": len(self.tags), "feature_index": self.features, "weights": self.weights.reshape(-1).tolist()})

    @classmethod
    def loads(cls, payload: str) -> TaggerModel:
        p = json.loads(payload)
        f, t = p["feature_count"], len(p["tags"])
        if len(p["weights"]) != f * t:
            raise ValueError("the weights don't fit features and tags")
        return cls(p["tags"], p["feature_index"], np.array(p["weights"], np.float32).reshape(f, t))

    def column(self, tokens: Column | str) -> Column:
        """Arrays of tokens to arrays of tags."""
        return arrow_function(lambda t: self.tag(list(t)), "array<string>")(tokens)


def train(sentences: Sequence[Sequence[tuple[str, str]]], epochs: int = 6, seed: int = 7) -> TaggerModel:
    """Of tagged sentences. Weights are averaged lazily; those that round to nothing are dropped."""
    tags = sorted({t for s in sentences for _, t in s})
    at = {t: i for i, t in enumerate(tags)}
    w: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(tags)))
    total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(tags)))
    since: dict[str, int] = defaultdict(int)
    step = 0
    rng = random.Random(seed)
    order = list(sentences)
    for _ in range(epochs):
        rng.shuffle(order)
        for s in order:
            tokens = [t for t, _ in s]
            for i, (_, gold) in enumerate(s):
                own = token_features(tokens, i)
                step += 1
                guess = int(sum((w[f] for f in own), np.zeros(len(tags))).argmax())
                if guess != at[gold]:
                    for f in own:
                        total[f] += (step - since[f]) * w[f]
                        since[f] = step
                        w[f][at[gold]] += 1
                        w[f][guess] -= 1
    mean = {f: (total[f] + (step - since[f]) * w[f]) / max(1, step) for f in w}
    kept = sorted(f for f, x in mean.items() if np.abs(x).max() > 1e-6)
    return TaggerModel(tags, {f: i for i, f in enumerate(kept)}, np.round(np.array([mean[f] for f in kept]), 6).astype(np.float32).reshape(len(kept), len(tags)))


_LEXICON = {
    "DT": "the a this that these those an", "IN": "in on with from by under near over", "CC": "and or but", "PRP": "he she it they we you i", "TO": "to",
    "JJ": "quick lazy small bright old happy quiet strong dark new", "NN": "dog fox cat house market river tree engine teacher garden city report",
    "NNP": "London Maria Boston Peter Berlin Anna", "RB": "quickly slowly often quietly never happily", "VB": "run see build is are be have take go",
    "VBD": "jumped walked played opened watched painted", "VBG": "running building walking playing watching", "CD": "1 2 10 42 1999 7",
}
_SHAPES = "DT JJ NN VBD IN DT NN|PRP VBD RB|NNP VBD DT JJ NN|DT NN VB VBG RB|PRP VB TO VB DT NN|DT CD NN VBD IN NNP|NNP CC NNP VBD DT NN|RB PRP VBD DT JJ JJ NN|DT NN IN DT NN VB JJ|VBG DT NN VB JJ".split("|")


def invented_corpus(n: int = 1200, seed: int = 3) -> list[list[tuple[str, str]]]:
    """Tagged sentences from templates, for a model where no corpus is at hand."""
    rng = random.Random(seed)
    words = {t: w.split() for t, w in _LEXICON.items()}
    return [[(rng.choice(words[t]), t) for t in rng.choice(_SHAPES).split()] for _ in range(n)]


_default: TaggerModel | None = None


def default_model() -> TaggerModel:
    global _default
    if _default is None:
        _default = train(invented_corpus())
    return _default
