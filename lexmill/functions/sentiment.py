"""Sentiment by a word list, boosters, negation, capitals and punctuation."""

from __future__ import annotations

import math
import re
from decimal import ROUND_HALF_UP, Decimal

from .arrow import arrow_function


def _read(s: str) -> dict[str, float]:
    return {w: float(v) for w, v in (p.split(":") for p in s.split())}


LEXICON = _read(
    "amazing:2.7 awesome:3.1 bad:-2.4 boring:-2.3 brilliant:2.9 broken:-2.1 clean:1.2 corrupt:-2 delightful:2.4 disappointing:-2.4 excellent:2.8 fail:-2.7 fantastic:3 fragile:-1.7 good:1.9 great:2.5 happy:2.1 hate:-3.2 horrible:-3.1 incredible:2.7 love:3.2 messy:-1.8 nice:1.6 perfect:3.2 poor:-2 sad:-1.9 slow:-1.5 solid:1.4 strong:1.6 terrible:-3.2 trash:-2.8 ugly:-2.2 weak:-1.8 wonderful:2.9 wow:2.1"
)
BOOSTERS = {w: 0.293 for w in "absolutely amazingly awfully completely especially extremely fully highly really so too very".split()}
BOOSTERS |= {"quite": 0.193} | {w: -0.293 for w in "almost barely hardly kinda kindof less little".split()}
NEGATIONS = frozenset("aint aren't cannot cant didn't doesn't dont hadn't hardly isn't lack lacking never no none nope nor not nothing nowhere rarely seldom without won't".split())
_EDGES = re.compile(r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$")


def _fixed(x: float, places: int) -> float:
    """Rounded as the exact binary value is, half away from zero."""
    return float(Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def polarity(text: str, lexicon: dict[str, float] | None = None) -> dict[str, float]:
    words = LEXICON if lexicon is None else LEXICON | lexicon
    tokens = text.split()
    if not tokens:
        return {"neg": 0.0, "neu": 1.0, "pos": 0.0, "compound": 0.0}
    has = lambda pattern: any(re.search(pattern, t) for t in tokens)
    mixed = has("[A-Z]") and has("[a-z]")
    plain = [_EDGES.sub("", t.lower()) for t in tokens]
    values = []
    for i, t in enumerate(tokens):
        v = words.get(plain[i], 0.0)
        if v:
            if mixed and re.search("[A-Z]", t) and t == t.upper():
                v += math.copysign(0.733, v)
            for back in range(1, min(3, i) + 1):
                before = plain[i - back]
                boost = BOOSTERS.get(before, 0.0)
                v += boost if v > 0 else -boost
                v *= -0.74 if before in NEGATIONS else 1
        values.append(v)
    total = sum(values)
    marks = text.count("?")
    loud = min(text.count("!"), 4) * 0.292 + (0 if marks < 2 else marks * 0.18 if marks < 4 else 0.96)
    total += math.copysign(loud, total) if total else 0
    pos = sum(v + 1 for v in values if v > 0)
    neg = sum(1 - v for v in values if v < 0)
    neu = sum(1 for v in values if not v)
    whole = pos + neg + neu
    return {"neg": _fixed(neg / whole, 3), "neu": _fixed(neu / whole, 3), "pos": _fixed(pos / whole, 3), "compound": _fixed(total / math.sqrt(total * total + 15) if total else 0.0, 4)}


_KIND = "struct<neg:double,neu:double,pos:double,compound:double>"
sentiment = arrow_function(polarity, _KIND)


def with_lexicon(lexicon: dict[str, float]):
    return arrow_function(lambda t: polarity(t, lexicon), _KIND)
