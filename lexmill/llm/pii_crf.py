"""Personal data and secrets by a skip-chain conditional random field.

Nodes are the tokens that hold a digit or an at sign, and the REACH tokens after a word that announces a secret; all other
tokens are outside any entity by definition, so that the field over a document is exactly one over its nodes. Neighbouring
nodes share chain potentials. Skip edges link each node to the next one in the document that is the same but for edge
punctuation (repeated) and to the next of the same shape (similar): what the context of one mention shows carries over to
mentions far away. Sum-product message passing over this loopy graph gives each node's marginals. It goes on, document by
document, until no message of the document changes by more than CLOSE, or for ROUNDS rounds, whichever comes first.

The weights are in pii_weights.json beside this file. train() makes them, on invented sentences, by the pseudo-likelihood
of nodes given their neighbours' labels. Nothing is fitted to the documents. Names of persons and places and postal
addresses are not among the labels and stay as they are.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frame import tidy
from ._words import cuts

LABELS = ("O", "EMAIL", "PHONE", "CARD", "IP", "SECRET", "ID")
ROUNDS, CLOSE, DAMPING, REACH, TRAIN_DOCS, TRAIN_SEED = 200, 1e-4, 0.3, 3, 2500, 11
WEIGHTS = Path(__file__).with_name("pii_weights.json")
_EDGE = "\"'`.,;:!?%&$#*|<>{}[]()«»“”„…=_~^/\\"
_CUES = {
    "phone": "tel tel. phone phone: tel: telephone mobile cell fax call telefon teléfono téléphone handy ring whatsapp".split(),
    "secret": "api_key apikey key token secret password passwd pwd passwort contraseña bearer auth access_key api-key credential".split(),
    "card": "card visa mastercard amex credit karte carte tarjeta kreditkarte cc pan".split(),
    "ip": "ip address server host addr ip: ipv4 from client".split(),
    "id": "ssn social passport iban steuernummer dni nif nir insurance account konto id-number".split(),
    "sum": "commit sha sha1 sha256 md5 checksum revision rev build hash digest blob tree".split(),
    "plain": "version v page pages year years order chapter section no nr room item step fig table line article isbn um uhr à il y".split(),
}
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SHAPE_D, _SHAPE_L = re.compile(r"\d"), re.compile(r"[^\W\d_]+")
_MAIL = re.compile(r"[^@\s]*[\w]@[\w-]+(\.[\w-]+)+")
_IP4 = re.compile(r"\d{1,3}(\.\d{1,3}){3}")
_IP6 = re.compile(r"(?=.*:.*:)[0-9a-fA-F:]{6,39}")
_HEX = re.compile(r"[0-9a-fA-F]{20,}")
_SLUG = re.compile(r"(?:(?:sk|pk|rk|ghp|gho|xox[bp]|AKIA|AIza|glpat|hf|eyJ)[\w-]{8,}|[A-Za-z0-9+/_-]{20,}={0,2})")
_IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{8,30}")


#: Labels whose neighbouring tokens are one entity while it has at most so many digits.
_JOINED = {"PHONE": 15, "CARD": 19, "ID": 34}


def _digits(word: str) -> int:
    return sum(c.isdigit() for c in word)


def core(token: str) -> str:
    return token.strip(_EDGE)


def shape(word: str) -> str:
    return _SHAPE_L.sub("a", _SHAPE_D.sub("0", word))


def _luhn(d: str) -> bool:
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def features(token: str, before: list[str], after: list[str]) -> list[str]:
    """Names of what is true of a token among its neighbours (nearest first)."""
    w = core(token)
    d = "".join(c for c in w if c.isdigit())
    s = shape(w)
    f = ["bias", f"n{min(len(d), 20)}", f"s:{s}" if len(s) <= 20 else "s:long"]
    if "@" in w:
        f.append("mail" if _MAIL.fullmatch(w) else "at")
    if _IP4.fullmatch(w):
        f.append("ip4" if all(int(x) < 256 for x in w.split(".")) else "dots")
        f.append("ip4big" if any(len(x) > 1 for x in w.split(".")) else "ip4small")
    if _IP6.fullmatch(w) and not re.fullmatch(r"[\d:]{4,8}", w):
        f.append("ip6")
    bare = re.sub(r"[ -]", "", w)
    if bare.isdigit():
        f += ["digits", "long" if len(bare) > 8 else "short"]
        if 13 <= len(bare) <= 19:
            f += ["cardlen", "luhn" if _luhn(bare) else "noluhn"]
    if re.search(r"\d", w) and _HEX.fullmatch(w):
        f += ["hex", "hexmix" if re.search(r"[a-fA-F]", w) else "hexdigits"]
    if _SLUG.fullmatch(w) and re.search(r"\d", w) and re.search(r"[A-Za-z]", w):
        f += ["slug", "quoted" if token[:1] in "\"'`" else "bare"]
    if not d and "@" not in w:
        mixed = bool(re.search(r"[a-z][A-Z]|[^\W_][-_/+.][^\W_]", w))
        f += [f"w{min(len(w) // 4, 5)}", "mixed" if mixed else "even", "capital" if w[:1].isupper() else "small", "wquoted" if token[:1] in "\"'`" else "wbare"]
        if not w:
            f.append("mark:" + token[:2])
    if _IBAN.fullmatch(w):
        f.append("iban")
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", w):
        f.append("ssn")
    if re.fullmatch(r"\+?\(?\d[\d().\-/]{5,}\d", w) and "-" in w:
        f.append("dashed")
    f += [name for name, yes in (("plus", token.lstrip("(").startswith("+")), ("paren", token.startswith("(") and w.isdigit()), ("pct", token.endswith("%")), ("date", re.fullmatch(r"(19|20)\d\d([-./]\d\d?){0,2}|\d\d?([-./]\d\d?)[-./]\d{2,4}|\d\d?:\d\d(:\d\d)?", w))) if yes]
    for side, near in (("b", before), ("a", after)):
        for i, x in enumerate(near[:3]):
            y = core(x).lower()
            if side == "b" and i < 2 and (x in "=:" or x.endswith(("=", ":"))):
                f.append(f"b:assign{i}")
            if i == 0:
                f.append(f"{side}:{shape(y)}" if any(c.isdigit() for c in y) and len(shape(y)) < 16 else f"{side}:{'w' if y else x[:1] or 'end'}")
            for name, cues in _CUES.items():
                if y in cues or y.rstrip(".:") in cues:
                    f.append(f"{side}:{name}")
                    break
    return f


def _invented(rng: random.Random) -> tuple[list[str], list[str]]:
    """A document of invented words with entities and numbers of other kinds: tokens and labels (None: not a node)."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()) for _ in range(rng.randint(1, 4)))
    cue = lambda kind, p: [rng.choice(_CUES[kind])] if rng.random() < p else []
    host = lambda: f"{word()}{rng.choice(['', digits(1)])}.{rng.choice(['example.com', 'mail.example.org', 'uni.de', 'co.uk', 'net'])}"
    tail = lambda: rng.choice(["", "", "", "", ".", ",", "!", "!!", "%%%", "###", "&&&", "***", ";", ")"])

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([[f"+{rng.randint(1, 99)}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{rng.randint(1, 99)}", digits(3), digits(4), digits(3)], [f"+{rng.randint(1, 99)}{digits(9)}"], [f"+{rng.randint(1, 9)}-{a}-{b}-{c}"], [f"0{digits(2)}-{digits(7)}"], [f"{a}.{b}.{c}"]])

    def entity(kind: str, announced: bool = False) -> list[str]:
        if kind == "EMAIL":
            return [f"{word()}{rng.choice(['.', '_', '', '.'])}{rng.choice(['', digits(2), word()])}@{host()}"]
        if kind == "PHONE":
            return phone()
        if kind == "CARD":
            n = digits(16)
            return rng.choice([[n], [n], [n], [n[:4] + "-" + n[4:8] + "-" + n[8:12] + "-" + n[12:]], [n[:4], n[4:8], n[8:12], n[12:]], [digits(15)]])
        if kind == "IP":
            return [".".join(str(rng.randint(0, 255)) for _ in range(4))] if rng.random() < 0.85 else [":".join(f"{rng.getrandbits(16):x}" for _ in range(8))]
        if kind == "SECRET":
            hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 40, 64])))
            mixed = "".join(rng.choice("ABCDEFGHabcdefghijkxyz0123456789_-") for _ in range(rng.randint(20, 40))) + digits(2)
            letters = rng.choice([word() + word() + word(), "".join(rng.choice("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(rng.randint(8, 32))), "-".join(word() for _ in range(4)), word().title() + rng.choice("!#$_") + word()])
            x = rng.choice([hexes, hexes, hexes.upper(), mixed, "sk-" + mixed, "ghp_" + mixed, "AKIA" + mixed[:16].upper() + digits(2)])
            if announced and rng.random() < 0.35:
                x = letters if rng.random() < 0.7 else word() + digits(rng.randint(1, 4))
            q = rng.choice(['"', '"', "'", ""])
            return [q + x + q]
        return [rng.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", rng.choice(["DE", "FR", "ES", "GB"]) + digits(20), f"{digits(2)}.{digits(3)}.{digits(3)}-{digits(1)}"])]

    def other() -> list[str]:
        return rng.choice([[str(rng.randint(1, 9))], [str(rng.randint(10, 999))], [str(rng.randint(1900, 2030))], [f"{rng.randint(0, 9)}.{rng.randint(0, 9)}"], [rng.choice(["version", "v", "section"]), f"{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}"], ["version", ".".join(str(rng.randint(0, 9)) for _ in range(4))], [rng.choice(["version", "v", "release"]), ".".join(str(rng.randint(0, 30)) for _ in range(4))], [rng.choice(_CUES["sum"]), "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64])))], [rng.choice(_CUES["sum"]), rng.choice(["id", "is", ":", "="]), "".join(rng.choice("0123456789abcdef") for _ in range(40))], ["the", rng.choice(_CUES["secret"]), rng.choice(["is", "was", "to", "of", "and", "for", "must"]), word(), word()], [word(), rng.choice(_CUES["secret"]), word(), word(), word()], [rng.choice(_CUES["secret"]) + rng.choice([".", ","]), word(), word()], [f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}"], [f"20{digits(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"], [f"{rng.randint(10, 23)}:{rng.randint(10, 59)}"], [f"{rng.randint(1, 99)}%"], [f"${digits(2)},{digits(3)}"], [word() + digits(1)], [digits(rng.randint(4, 6))], [f"{digits(1)},{digits(3)},{digits(3)}"], [f"({rng.randint(1, 20)})"], [f"({rng.randint(1990, 2025)})"], ["no", digits(5)], [f"@{word()}"], [f"{digits(1)}x{digits(2)}"], [f"{rng.randint(2, 9)}.{rng.randint(0, 9)}."], ["pages", f"{digits(2)}-{digits(3)}"], ["isbn", f"{digits(3)}-{digits(10)}"], ["license,", "version", f"{rng.randint(1, 4)}."], [f"{digits(4)}/{digits(2)}"]])

    kinds = {"EMAIL": None, "PHONE": "phone", "CARD": "card", "IP": "ip", "SECRET": "secret", "ID": "id"}
    tokens: list[str] = []
    labels: list[str] = []

    def put(words: list[str], label: str) -> None:
        tokens.extend(words)
        labels.extend([label] * len(words))

    for _ in range(rng.randint(2, 7)):
        put([word() for _ in range(rng.randint(1, 9))], "O")
        if rng.random() < 0.55:
            kind = rng.choice(list(kinds))
            announced = kind == "SECRET" and rng.random() < 0.8
            e = entity(kind, announced)
            if announced:
                put(rng.choice([[*cue("secret", 1), rng.choice(["=", ":", "="])], [*cue("secret", 1), rng.choice(["=", ":", "="])], [cue("secret", 1)[0] + ":"], [*cue("secret", 1), "is"]]), "O")
            elif kinds[kind]:
                put(cue(kinds[kind], 0.35 if kind != "ID" else 0.8), "O")
            t = tail()
            put([*e[:-1], e[-1] + t], kind)
            if rng.random() < 0.3:
                put([word() for _ in range(rng.randint(1, 20))], "O")
                put([*e[:-1], e[-1] + tail()], kind)
        else:
            e = other()
            put([*e[:-1], e[-1] + rng.choice(["", "", ".", ","])], "O")
    put([word() for _ in range(rng.randint(0, 4))], "O")
    return tokens, labels


def _is_node(token: str) -> bool:
    return "@" in token or any(c.isdigit() for c in token)


_SECRET = frozenset(_CUES["secret"])


def _announces(token: str) -> bool:
    """Whether a secret may come after a token."""
    return core(token).lower().rstrip(".:") in _SECRET


def node_places(tokens: list[str]) -> list[int]:
    """Which tokens of a document are nodes."""
    near = {j for i, t in enumerate(tokens) if _announces(t) for j in range(i + 1, i + 1 + REACH)}
    return [i for i, t in enumerate(tokens) if i in near or _is_node(t)]


def edges(doc: np.ndarray, place: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chain, repeated and similar edges (pairs of nodes) of nodes in order; doc and place (token number) of each."""
    near = np.flatnonzero((doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + 1))
    chain = np.stack([near, near + 1], 1)
    same: list[tuple[int, int]] = []
    like: list[tuple[int, int]] = []
    last: dict[tuple[int, str], int] = {}
    alike: dict[tuple[int, str], int] = {}
    for i, (d, w) in enumerate(zip(doc.tolist(), words, strict=True)):
        k = (d, w.lower())
        if k in last:
            same.append((last[k], i))
        last[k] = i
        s = (d, shape(w))
        if s in alike and words[alike[s]].lower() != k[1]:
            like.append((alike[s], i))
        alike[s] = i
    as_pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return chain, as_pairs(same), as_pairs(like)


class Model:
    """Node weights by feature, chain potentials, and the weights of agreement over repeated and similar edges."""

    def __init__(self, names: dict[str, int], node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.names, self.node, self.chain, self.skip = names, node, chain, skip

    def to_json(self) -> str:
        near = lambda x: np.round(x, 4).tolist()
        return json.dumps({"labels": LABELS, "names": list(self.names), "node": near(self.node), "chain": near(self.chain), "skip": near(self.skip)})

    @classmethod
    def from_json(cls, payload: str) -> Model:
        p = json.loads(payload)
        if tuple(p["labels"]) != LABELS:
            raise ValueError("the weights are for other labels")
        return cls({n: i for i, n in enumerate(p["names"])}, np.array(p["node"]), np.array(p["chain"]), np.array(p["skip"]))

    def unary(self, found: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(found), len(LABELS)))
        for i, fs in enumerate(found):
            own = [self.names[f] for f in fs if f in self.names]
            out[i] = self.node[own].sum(0)
        return out

    def marginals(self, unary: np.ndarray, chain: np.ndarray, same: np.ndarray, like: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
        """doc: the document of each node, where there are several."""
        return propagate(unary, [(chain, self.chain), (same, np.eye(len(LABELS)) * self.skip[0]), (like, np.eye(len(LABELS)) * self.skip[1])], doc=doc)


def train(docs: int = TRAIN_DOCS, seed: int = TRAIN_SEED, steps: int = 160) -> Model:
    """Fit the weights to invented sentences."""
    rng = random.Random(seed)
    names: dict[str, int] = {}
    rows, ys, owner, place, words = [], [], [], [], []
    for d in range(docs):
        tokens, labels = _invented(rng)
        for i in node_places(tokens):
            rows.append([names.setdefault(f, len(names)) for f in features(tokens[i], tokens[max(0, i - 3) : i][::-1], tokens[i + 1 : i + 4])])
            ys.append(LABELS.index(labels[i]))
            owner.append(d)
            place.append(i)
            words.append(core(tokens[i]))
    n, k, y = len(rows), len(LABELS), np.array(ys)
    x = np.zeros((n, len(names)), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    chain, same, like = edges(np.array(owner), np.array(place), words)
    one = np.eye(k, dtype=np.float32)[y]
    left, right, rep, sim = (np.zeros((n, k), np.float32) for _ in range(4))
    left[chain[:, 1]] = one[chain[:, 0]]
    right[chain[:, 0]] = one[chain[:, 1]]
    for to, pairs in ((rep, same), (sim, like)):
        np.add.at(to, pairs[:, 0], one[pairs[:, 1]])
        np.add.at(to, pairs[:, 1], one[pairs[:, 0]])
    u, t, w = np.zeros((len(names), k), np.float32), np.zeros((k, k), np.float32), np.zeros(2, np.float32)
    params = [u, t, w]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        z = x @ u + left @ t + right @ t.T + w[0] * rep + w[1] * sim
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = (p - one) / n
        grads = [x.T @ g + 2e-5 * u, left.T @ g + (right.T @ g).T + 1e-4 * t, np.array([(g * rep).sum(), (g * sim).sum()]) + 1e-4 * w]
        for q, d, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            q -= 0.15 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return Model(names, u.astype(float), t.astype(float), np.maximum(w, 0).astype(float))


def propagate(unary: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, damping: float = DAMPING, close: float = CLOSE, doc: np.ndarray | None = None) -> np.ndarray:
    """Node marginals of a pairwise field by loopy sum-product in logarithms. groups: pairs of nodes and their potential.

    The messages of a document (doc: that of each node) stand still once none of them has changed by more than close, so that
    a document's marginals don't depend on what it is computed with.
    """
    src = np.concatenate([np.concatenate([p[:, 0], p[:, 1]]) for p, _ in groups])
    dst = np.concatenate([np.concatenate([p[:, 1], p[:, 0]]) for p, _ in groups])
    doc = np.zeros(len(unary), np.int64) if doc is None else np.asarray(doc)
    back = np.empty(len(src), np.int64)
    pots = []
    kind = np.empty(len(src), np.int64)
    at = 0
    for p, pot in groups:
        e = len(p)
        back[at : at + e] = np.arange(at + e, at + 2 * e)
        back[at + e : at + 2 * e] = np.arange(at, at + e)
        kind[at : at + e], kind[at + e : at + 2 * e] = len(pots), len(pots) + 1
        pots += [np.exp(pot), np.exp(pot.T)]
        at += 2 * e
    msg = np.zeros((len(src), unary.shape[1]))
    live = np.arange(len(src))
    owner = doc[src] if len(src) else src
    for _ in range(rounds):
        if not len(live):
            break
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = belief[src[live]] - msg[back[live]]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.empty_like(out)
        for k in np.unique(kind[live]).tolist():
            own = kind[live] == k
            new[own] = np.log(out[own] @ pots[k])
        new -= new.max(1, keepdims=True)
        new = damping * msg[live] + (1 - damping) * new
        change = np.abs(new - msg[live]).max(1)
        msg[live] = new
        moved = np.zeros(int(doc.max()) + 1, bool)
        moved[owner[live[change > close]]] = True
        live = live[moved[owner[live]]]
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@lru_cache(1)
def model() -> Model:
    """The stored weights."""
    return Model.from_json(WEIGHTS.read_text())


@lru_cache(1)
def _kinds() -> np.ndarray:
    """1 white space, 2 digit or at sign, 0 other, by code point."""
    k = np.zeros(0x110000, np.uint8)
    for c in range(0x20000):
        ch = chr(c)
        k[c] = 1 if ch.isspace() else 2 if ch.isdigit() or ch == "@" else 0
    return k


#: One of these is in every word that announces a secret.
_STEMS = ("key", "token", "secret", "passw", "pwd", "contrase", "bearer", "auth", "credential")
assert all(any(x in w for x in _STEMS) for w in _SECRET)


def _stem_places(text: str) -> list[int]:
    """Where a text has one of _STEMS, in upper or lower case."""
    low = text.lower()
    if len(low) != len(text):
        return [m.start() for m in re.finditer("|".join(_STEMS), text, re.IGNORECASE)]
    out = []
    for stem in _STEMS:
        at = low.find(stem)
        while at >= 0:
            out.append(at)
            at = low.find(stem, at + len(stem))
    return out


def nodes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of each token, and which tokens are nodes."""
    base = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=base[1:])
    kind = _kinds()[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = kind == 1
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    marks = np.concatenate([[0], np.cumsum(kind == 2)])
    is_node = marks[ends] > marks[starts]
    doc = np.searchsorted(base, starts, "right") - 1
    found = [base[d] + at for d, t in enumerate(texts) for at in _stem_places(t)]
    if found:
        maybe = np.unique(np.searchsorted(starts, np.array(found), "right") - 1)
        for i in maybe.tolist():
            d = int(doc[i])
            if ends[i] - starts[i] < 64 and _announces(texts[d][starts[i] - base[d] : ends[i] - base[d]]):
                for j in range(i + 1, min(i + 1 + REACH, len(doc))):
                    is_node[j] |= doc[j] == d
    return doc, starts - base[doc], ends - base[doc], np.flatnonzero(is_node)


def find(texts: list[str | None], field: Model | None = None) -> list[list[dict]]:
    """The entities of each text: label, start, end in characters."""
    own = [t or "" for t in texts]
    out: list[list[dict]] = [[] for _ in own]
    docs, starts, ends, place = nodes(own)
    if not len(place):
        return out
    doc, start, end = docs[place], starts[place], ends[place]
    tokens, found = [], []

    def token(j: int) -> str:
        return own[docs[j]][starts[j] : ends[j]]

    for i, d in zip(place.tolist(), doc.tolist(), strict=True):
        before = [token(j) for j in range(i - 1, max(i - 4, -1), -1) if docs[j] == d]
        after = [token(j) for j in range(i + 1, min(i + 4, len(docs))) if docs[j] == d]
        tokens.append(token(i))
        found.append(features(tokens[-1], before, after))
    words = [core(t) for t in tokens]
    m = field or model()
    p = m.marginals(m.unary(found), *edges(doc, place, words), doc=doc)
    best = p.argmax(1)
    for i in np.flatnonzero(best > 0).tolist():
        d, label, t = int(doc[i]), LABELS[best[i]], tokens[i]
        a = int(start[i]) + len(t) - len(t.lstrip(_EDGE))
        b = a + len(words[i])
        if t[:1] == "(" and b < end[i] and own[d][b] == ")":
            a, b = a - 1, b + 1
        if b <= a:
            continue
        last = out[d][-1] if out[d] else None
        if last and i and doc[i - 1] == d and place[i - 1] == place[i] - 1 and last["label"] == label and label in _JOINED and last["n"] + _digits(words[i]) <= _JOINED[label]:
            last |= {"end": b, "n": last["n"] + _digits(words[i])}
        else:
            out[d].append({"label": label, "start": a, "end": b, "n": _digits(words[i])})
    for es in out:
        for e in es:
            del e["n"]
    return out


def _redact(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        out += [text[at : s["start"]], f"[{s['label']}]"]
        at = s["end"]
    return "".join([*out, text[at:]])


def entities(text: Column) -> Column:
    """entities (label, start, end) and the redacted text, null where there are none."""

    field = model()

    @F.arrow_udf("struct<entities:array<struct<label:string,start:bigint,end:bigint>>,redacted:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            spans: list[list[dict]] = []
            clean: list[str | None] = []
            for a, b in cuts(batch):
                texts = batch.slice(a, b - a).to_pylist()
                found = find(texts, field)
                spans += found
                clean += [_redact(t, s) if s else None for t, s in zip(texts, found, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(spans, pa.list_(_SPAN)), pa.array(clean, pa.string())], names=["entities", "redacted"])

    # evaluated once, though both a filter and a projection look at it
    return run.asNondeterministic()(text)


def private(docs: DataFrame) -> DataFrame:
    """One row per document with entities: doc_id, entities (label, start, end in characters), labels, redacted text.

    Null, empty and blank texts have none. Null ids and repeated rows are read like others; documents don't influence one
    another. An empty table gives an empty result; texts are read whole; extra columns are ignored. Equal marginals go to
    the label that comes first in LABELS.
    """
    docs, _ = tidy(docs, {"doc_id": "long", "text": "string"})
    out = docs.select("doc_id", entities(F.col("text")).alias("__e")).filter(F.size("__e.entities") > 0)
    return out.select("doc_id", F.col("__e.entities").alias("entities"), F.array_sort(F.array_distinct("__e.entities.label")).alias("labels"), F.col("__e.redacted").alias("redacted"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents, with each entity's text replaced by its label in brackets and n_chars counted anew where there is one.

    All other rows and columns stay as they were: null, empty and blank texts, rows without an id, repeated rows, extra
    columns of whatever name. An empty table stays empty; texts are read whole; equal marginals go to the label that comes
    first in LABELS.
    """
    inner, back = tidy(docs, {"doc_id": "long", "text": "string", "n_chars": "long"})
    out = inner.withColumn("__r", entities(F.col("text"))["redacted"])
    return back(out.withColumns({"text": F.coalesce("__r", "text"), "n_chars": F.when(F.col("__r").isNotNull(), F.length("__r").cast("long")).otherwise(F.col("n_chars"))}))


if __name__ == "__main__":
    WEIGHTS.write_text(train().to_json())
