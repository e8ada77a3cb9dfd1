"""Fits the weights of the semi-Markov conditional random field on made-up sentences: python -m asterism.llm.pii_train.

Sentences mix invented words with entities and with look-alikes that are none: numbers that fail the checksum, dates,
prices, version numbers, short number groups. The log-likelihood's gradient comes from forward and backward sums over
all segmentations; Adagrad with a small L2 penalty fits it.
"""

from __future__ import annotations

import json
import random
from collections import defaultdict
from math import exp, inf, log, sqrt
from pathlib import Path

from .pii import TYPES, Decoder, Model, luhn, tokenize

_SYLLABLES = "an er th re on in ti ou ea st or nd ha le mi ca de la be ch ei um ver zu qu ciu oso".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random, good: bool) -> str:
    while True:
        d = _digits(r, r.choice((16, 16, 16, 19)))
        if luhn(d) == good:
            return d if r.random() < 0.6 else r.choice(" -").join(d[k : k + 4] for k in range(0, len(d), 4))


def _entity(r: random.Random) -> tuple[str, str]:
    kind = r.choice(TYPES)
    if kind == "email":
        local, host = r.choice((_word(r), f"{_word(r)}.{_digits(r, 2)}", f"{_word(r)}_{_word(r)}", f"{_word(r)}{_digits(r, 2)}")), f"{r.choice(('mail', 'post', _word(r)))}{r.choice(('', _digits(r, 1)))}"
        top = r.choice(("com", "org", "net", "example.com", "de", "fr"))
        if r.random() < 0.5:
            a, d = r.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", ".")))
            return kind, f"{local}{a}{host}{d}{top.replace('.', d)}"
        return kind, f"{local}@{host}.{top}"
    if kind == "ip":
        return kind, ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        return kind, _card(r, True)
    if kind == "phone":
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        return kind, r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{r.randint(20, 99)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}"))
    return kind, "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 40, 64)))) if r.random() < 0.8 else "".join(r.choice("0123456789ABCDEF") for _ in range(40))


def _look_alike(r: random.Random) -> str:
    n = lambda a, b: str(r.randint(a, b))
    return r.choice((
        _card(r, False), _card(r, False), f"{n(1, 28)}.{n(1, 12)}.{n(1990, 2030)}", f"{n(1990, 2030)}-0{n(1, 9)}-{n(10, 28)}", f"{n(1, 999)}", f"{n(1, 99)}.{n(0, 99)}", f"{n(1, 9)}.{n(0, 20)}.{n(0, 20)}", f"${n(1, 9999)}",
        f"({n(1, 99)})", f"{n(256, 999)}.{n(1, 255)}.{n(256, 999)}.{n(1, 255)}", f"{_word(r)}{n(1, 99)}", f"{n(100, 999)}-{n(1000, 9999)}", f"@{_word(r)}", f"{n(1, 99)}:{n(10, 59)}", f"CC BY-NC {n(1, 4)}.0", f"Version {n(1, 4)}.0", f"{n(1000000, 99999999)}", _digits(r, r.choice((15, 16, 16, 17))) if r.random() < 0.2 else f"{n(1, 400)} ({n(1990, 2030)})",
    ))


def sentence(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A text and its entities (type, start, end)."""
    text, found = "", []
    for _ in range(r.randint(2, 4)):
        for _ in range(r.randint(1, 4)):
            text += _word(r) + r.choice((" ", " ", " ", ", ", ". ", ".\n"))
        if r.random() < 0.5:
            text += _look_alike(r)
        else:
            kind, s = _entity(r)
            before, after = {"secret": (r.choice(('token = "', 'key: "', "secret=", 'TOKEN = "', 'password = "')), '"')}.get(kind, (r.choice(("", "", "", "tel ", "mail: ", "call ")), ""))
            after = after if before.endswith('"') else ""
            text += before
            found.append((kind, len(text), len(text) + len(s)))
            text += s + after
        text += r.choice((" ", " ", ", ", "!! ", "\n", " | "))
    return text, found


def _logsum(xs: list[float]) -> float:
    m = max(xs, default=-inf)
    return m if m == -inf else m + log(sum(exp(x - m) for x in xs))


def step(model: Model, text: str, entities: list[tuple[str, int, int]], gradient: dict) -> float:
    """Adds the gradient of the negative log-likelihood of one labelled sentence; returns the likelihood's logarithm."""
    tokens, seeds = tokenize(text)
    n, candidates = len(tokens), model.segments(text, tokens, seeds)
    starts, ends = {a: k for k, (a, _) in enumerate(tokens)}, {b: k + 1 for k, (_, b) in enumerate(tokens)}
    gold = {(starts[a], ends[b]): kind for kind, a, b in entities if a in starts and b in ends}
    arcs, alpha, true = [], [0.0] + [-inf] * n, 0.0
    incoming: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        incoming[j].append((j - 1, 0.0))
        for i, features in candidates[j]:
            for kind in TYPES:
                s = model.score(kind, features)
                incoming[j].append((i, s))
                arcs.append((i, j, kind, features, s))
                if gold.get((i, j)) == kind:
                    true += s
                    for f in features:
                        gradient[kind][f] -= 1.0
        alpha[j] = _logsum([alpha[i] + s for i, s in incoming[j]])
    beta = [-inf] * n + [0.0]
    outgoing: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        for i, s in incoming[j]:
            outgoing[i].append((j, s))
    for i in range(n - 1, -1, -1):
        beta[i] = _logsum([s + beta[j] for j, s in outgoing[i]])
    for i, j, kind, features, s in arcs:
        p = exp(alpha[i] + s + beta[j] - alpha[n])
        if p > 1e-6:
            for f in features:
                gradient[kind][f] += p
    return true - alpha[n]


def fit(sentences: int = 900, rounds: int = 6, seed: int = 11, rate: float = 0.4, penalty: float = 1e-4, say=lambda *x: None) -> dict[str, dict[str, float]]:
    r = random.Random(seed)
    data = [sentence(r) for _ in range(sentences)]
    weights = {k: defaultdict(float) for k in TYPES}
    for k in TYPES:
        weights[k]["bias"] = -2.0
    squares = {k: defaultdict(float) for k in TYPES}
    for turn in range(rounds):
        total = 0.0
        for text, entities in data:
            gradient = {k: defaultdict(float) for k in TYPES}
            total += step(Model(weights), text, entities, gradient)
            for kind, g in gradient.items():
                for f, x in g.items():
                    x += penalty * weights[kind][f]
                    squares[kind][f] += x * x
                    weights[kind][f] -= rate * x / sqrt(squares[kind][f] + 1e-8)
        say(turn, round(total / len(data), 3))
    return {k: {f: round(x, 4) for f, x in sorted(w.items()) if abs(x) > 0.02} for k, w in weights.items()}


def measure(weights: dict[str, dict[str, float]], sentences: int = 300, seed: int = 99) -> tuple[float, float]:
    """Precision and recall of whole entities on other made-up sentences."""
    r, m = random.Random(seed), Model(weights)
    right = made = there = 0
    for _ in range(sentences):
        text, entities = sentence(r)
        decoder = Decoder(m)
        decoder.feed(0, text, 0, len(text))
        decoder.flush(last=True)
        found = {x[1:] for x in decoder.found}
        right += len(found & set(entities))
        made += len(found)
        there += len(entities)
    return right / max(made, 1), right / max(there, 1)


if __name__ == "__main__":
    found = fit(say=print)
    print("precision, recall:", measure(found))
    (Path(__file__).parent / "pii_weights.json").write_text(json.dumps(found, sort_keys=True) + "\n")
