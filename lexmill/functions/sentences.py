"""Sentence splitters: by heuristics, by fixed rules, and by a trained abbreviation model."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_function

_KNOWN = frozenset("a.m dr e.g etc i.e jr mr mrs ms p.m prof sr st u.k u.s vs".split())
_WIDER = _KNOWN | frozenset(
    "adj adm adv al apr approx apt asst assn aug ave bldg blvd capt cf co col corp dec dept est feb fig gen gov hon inc jan jul jun lt ltd maj mar messrs mt no nov oct op pres rep rev sen sep sept sgt tel vol".split()
)
_TITLES = frozenset(("dr", "prof"))
_CLOSERS = "\"')]}"
_SKIP_LEFT = re.compile(r"[\s\"'()\[\]{}]")
_TOKEN_END = re.compile(r"[A-Za-z0-9.]*\Z")
_TOKEN = re.compile(r"[A-Za-z0-9.]*")


def _next(text: str, at: int) -> str | None:
    """The run of letters, digits and full stops after white space and closers; None if there is none."""
    while at < len(text) and (text[at].isspace() or text[at] in _CLOSERS):
        at += 1
    return _TOKEN.match(text, at).group() or None


def _previous(text: str, at: int) -> str:
    end = at
    while end > 0 and _SKIP_LEFT.match(text[end - 1]):
        end -= 1
    start = end
    while start > 0 and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] == "."):
        start -= 1
    return text[start:end]


def _starts(look: str, kind: str) -> bool:
    return "A" <= look[0] <= "Z" if kind == "upper" else "a" <= look[0] <= "z" if kind == "lower" else look[0].isdigit()


def _split(text: str, ends) -> list[str]:
    """Sentences by a rule on the places of full stops, exclamation and question marks; closers go with them."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]", text):
        i = m.start()
        if i < start or not ends(i):
            continue
        end = i + 1
        while end < len(text) and text[end] in _CLOSERS:
            end += 1
        if s := text[start:end].strip():
            out.append(s)
        start = end
    if s := text[start:].strip():
        out.append(s)
    return out


def _between_digits(text: str, i: int) -> bool:
    return text[i] == "." and 0 < i < len(text) - 1 and text[i - 1] in "0123456789" and text[i + 1] in "0123456789"


def learned_abbreviations(text: str) -> set[str]:
    lower: Counter = Counter()
    upper: Counter = Counter()
    for m in re.finditer(r"\b([A-Za-z][A-Za-z.]{0,10})\.\s+([A-Za-z])", text):
        word = m.group(1).lower().rstrip(".")
        (lower if m.group(2).islower() else upper)[word] += 1
    return {w for w in lower if w and lower[w] + upper[w] >= 2 and lower[w] > upper[w]}


def likely_starters(text: str) -> set[str]:
    seen: Counter = Counter()
    for piece in re.split(r"[.!?]+", text):
        if m := re.match(r"[A-Za-z][A-Za-z0-9'-]*", piece.strip()):
            seen[m.group().lower()] += 1
    return {w for w, n in seen.items() if n >= 2}


def heuristic_sentences(text: str, abbreviations: tuple[str, ...] = (), learn: bool = True, orthographic: bool = True) -> list[str]:
    """Abbreviations known, given or learned from the text itself don't end a sentence before a lower-case word."""
    known = set(_KNOWN) | {a.lower().rstrip(".") for a in abbreviations}
    known |= learned_abbreviations(text) if learn else set()
    starters = likely_starters(text) if orthographic else set()

    def abbreviation(token: str) -> bool:
        short = token.rstrip(".").lower()
        return bool(token) and (short in known or re.fullmatch(r"(?:[A-Za-z]\.)+[A-Za-z]?", token) is not None or re.fullmatch("[a-z]", short) is not None)

    def ends(i: int) -> bool:
        mark = text[i]
        if _between_digits(text, i) or (mark == "." and text[i + 1 : i + 2] == "."):
            return False
        before, look = _previous(text, i), _next(text, i + 1)
        if mark == "." and abbreviation(before):
            if look is None:
                return True
            if re.fullmatch("[A-Z]", before) and re.fullmatch(r"[A-Z]\.?", look):
                return False
            if re.search(r"(?:[A-Z]\.\s+){2,}[A-Z]\.$", text[max(0, i - 24) : i + 1]) and re.match("[A-Z][a-z]", look):
                return False
            if _starts(look, "lower"):
                return False
            if _starts(look, "upper") and re.fullmatch("[A-Z][a-z]+", before.removesuffix(".")):
                return False
        if look is None or _starts(look, "digit") or _starts(look, "upper"):
            return True
        if orthographic and _starts(look, "lower") and look.lower() not in starters:
            return False
        return mark in "!?"

    return _split(text, ends)


def rule_sentences(text: str) -> list[str]:
    """The model-less splitter."""

    def ends(i: int) -> bool:
        mark, after = text[i], text[i + 1 : i + 2]
        if _between_digits(text, i) or (mark == "." and after == "."):
            return False
        if mark == "." and after.isascii() and after.isalpha() and text[i + 2 : i + 3] == ".":
            return False
        before, look = _previous(text, i).rstrip(".").lower(), _next(text, i + 1)
        if look is None:
            return True
        if mark == "." and before in _KNOWN and (_starts(look, "lower") or (before in _TITLES and _starts(look, "upper"))):
            return False
        return _starts(look, "upper") or _starts(look, "digit") or mark in "!?"

    return _split(text, ends)


@dataclass(frozen=True)
class PunktModel:
    """abbreviations, sentence starters, pairs (abbreviation, following word), scores, and [lower, upper] counts of words."""

    abbreviations: frozenset[str] = _WIDER
    starters: frozenset[str] = frozenset()
    collocations: frozenset[tuple[str, str]] = frozenset()
    scores: dict[str, float] = field(default_factory=dict)
    context: dict[str, tuple[int, int]] = field(default_factory=dict)

    def dumps(self) -> str:
        return json.dumps(
            {
                "version": 1,
                "abbreviations": sorted(self.abbreviations),
                "starters": sorted(self.starters),
                "collocations": sorted(map(list, self.collocations)),
                "scores": dict(sorted(self.scores.items())),
                "context": {k: list(v) for k, v in sorted(self.context.items())},
            },
            ensure_ascii=False,
        )

    @classmethod
    def loads(cls, payload: str) -> PunktModel:
        p = json.loads(payload)
        if p.get("version") != 1:
            raise ValueError("unknown version of a sentence model")
        return cls(frozenset(p["abbreviations"]), frozenset(p["starters"]), frozenset(map(tuple, p["collocations"])), p["scores"], {k: tuple(v) for k, v in p["context"].items()})


def model_sentences(text: str, model: PunktModel) -> list[str]:
    def ends(i: int) -> bool:
        mark, after = text[i], text[i + 1 : i + 2]
        if _between_digits(text, i) or (mark == "." and after == "."):
            return False
        if mark == "." and after.isascii() and after.isalpha() and text[i + 2 : i + 3] == ".":
            return False
        raw, look = _previous(text, i), _next(text, i + 1)
        if look is None:
            return True
        before, word = raw.rstrip(".").lower(), look.rstrip(".").lower()
        upper, lower = _starts(look, "upper"), _starts(look, "lower")
        if mark == ".":
            if re.fullmatch("[a-z]", before) and upper:
                return False
            if before in ("a.m", "p.m"):
                return False
            if before in model.abbreviations:
                if (before in _TITLES and upper) or lower:
                    return False
                low, up = model.context.get(word, (0, 0))
                if low > 1.5 * up or (before, word) in model.collocations:
                    return False
                if model.scores.get(before, 0) >= 0.75 and word not in model.starters:
                    return False
                if not upper and word not in model.starters:
                    return False
        if upper or _starts(look, "digit") or mark in "!?":
            return True
        return not (lower and word not in model.starters)

    return _split(text, ends)


def punkt_events(text: str) -> list[tuple[str, str, str]]:
    """What training counts in a text: (kind, word, next)."""
    out = []
    for m in re.finditer(r"\.", text):
        before = _previous(text, m.start()).rstrip(".").lower()
        look = _next(text, m.end())
        if look is None or not re.fullmatch(r"[a-z][a-z.]{0,15}", before):
            continue
        word = look.rstrip(".").lower()
        case = "lower" if _starts(look, "lower") else "upper" if _starts(look, "upper") else "other"
        out.append((case, before, word))
    for piece in re.split(r"(?<=[.!?])", text):
        if w := re.match(r"\s*[\"'(\[{]*([A-Za-z][A-Za-z0-9'-]*)", piece):
            out.append(("start", w.group(1).lower(), ""))
    return out


def train_punkt(docs: DataFrame, text: str = "text", min_abbreviation: int = 2, min_pair: int = 2, min_starter: int = 2) -> PunktModel:
    """Counts events of all documents; the tables that the model keeps are those of words before full stops, and of words
    after them that are mostly in lower case, as no others decide anything."""
    event = arrow_function(lambda t: [{"kind": k, "word": w, "next": n} for k, w, n in punkt_events(t)], "array<struct<kind:string,word:string,next:string>>")
    rows = docs.select(F.explode(event(F.col(text))).alias("e")).select("e.*")
    counts = rows.groupBy("kind", "word", "next").agg(F.count("*").alias("n")).persist()
    abbr = counts.filter("kind <> 'start'").groupBy("word").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("kind") == "lower", F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(F.col("kind") == "upper", F.col("n")).otherwise(0)).alias("up")
    )
    abbreviations, scores = set(_WIDER), {}
    for r in abbr.collect():
        scores[r["word"]] = round(r["low"] / r["total"], 6)
        if r["total"] >= min_abbreviation and (r["low"] >= r["up"] or (r["up"] > 0 and len(r["word"]) <= 3)):
            abbreviations.add(r["word"])
    pairs = counts.filter("kind = 'lower'").filter(F.col("n") >= min_pair).select("word", "next").collect()
    starters = counts.filter("kind = 'start'").filter(F.col("n") >= min_starter).select("word").collect()
    context = counts.filter("kind in ('lower', 'upper')").groupBy("next").pivot("kind", ["lower", "upper"]).agg(F.sum("n")).na.fill(0).filter(F.col("lower") > 1.5 * F.col("upper")).collect()
    counts.unpersist()
    return PunktModel(frozenset(abbreviations), frozenset(r["word"] for r in starters), frozenset((r["word"], r["next"]) for r in pairs), scores, {r["next"]: (r["lower"], r["upper"]) for r in context})


heuristic = arrow_function(heuristic_sentences, "array<string>")
rules = arrow_function(rule_sentences, "array<string>")


def with_model(model: PunktModel):
    return arrow_function(lambda t: model_sentences(t, model), "array<string>")
