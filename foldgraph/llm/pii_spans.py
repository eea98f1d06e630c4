"""Personal data in text: pattern spans, and a semi-Markov CRF that adds to them (no Spark)."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import add

#: Kinds with a pattern; kinds of the model, which also finds keys and tokens that open something.
KINDS = ["email", "ip", "card", "phone"]
MODEL_KINDS = [*KINDS, "secret"]
Span = tuple[int, int, str]  # first code point, end, kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # no match can begin inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
_HEX = frozenset("0123456789abcdef")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind's pattern that pass its test.

    Linear in the text: an address is looked for around its ``@``, and digit runs
    are never tried twice.
    """
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        first = at
        while first > end and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((first, m.end(), "email"))
            end = m.end()
        else:
            # what stands before a failing @ can't begin a later match
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 38:
            d = _DIGITS.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[0], MODEL_KINDS.index(s[2]), s[1]))


# ---------------------------------------------------------------- regions and segments

_ANCHOR = re.compile(r"[0-9@]")
#: A long run of letters and digits is one token, as keys are.
LONG_RUN = 16
_TOKEN = re.compile(r"[A-Za-z0-9]{%d,}|[A-Za-z]+|[0-9]+|\s|." % LONG_RUN, re.S)
#: Words that name a secret, just before it; how issued keys begin.
_NAMES = r"(?i:token|secret|passw(?:or)?d|pwd|credential|bearer|auth(?:orization)?|(?:api|access|private|secret)[ _-]?key)"
_KEYED = re.compile(_NAMES + r"[\"']?\s{0,2}[:=]{0,2}\s{0,2}[\"']?$")
_UNSURE = re.compile(_NAMES + r"[^A-Za-z0-9]{0,6}[A-Za-z0-9_+/-]{12,}")
_ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "glpa", "xoxb", "AIza", "sk_l")
#: Tokens and code points of the longest candidate segment.
MAX_TOKENS, MAX_CHARS = 20, 64
#: Entries of a model's memo of segments' own scores, after which it starts afresh.
MEMO = 50_000


def regions(text: str) -> list[tuple[int, int]]:
    """Runs of words with a digit or an ``@``, one space apart; all else can only be outside."""
    out: list[list[int]] = []
    pos = 0
    while m := _ANCHOR.search(text, pos):
        a, b = m.start(), m.end()
        low = out[-1][1] if out else 0
        while a > low and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a - out[-1][1] <= 1 and text[out[-1][1] : a] in (" ", ""):
            out[-1][1] = b
        else:
            out.append([a, b])
        pos = b
    return [(a, b) for a, b in out]


def _class(c: str) -> str:
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def _run(s: str) -> str:
    """Of one long run of letters and digits: its length by eights, hexadecimal or not, and how often it changes between them."""
    if len(s) < LONG_RUN or not (s.isascii() and s.replace("_", "").replace("-", "").isalnum()):
        return ""
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    return f"{len(s) // 8}{set(s.lower()) <= _HEX}{min(changes * 8 // len(s), 4)}"


@lru_cache(maxsize=20_000)
def _inner(s: str) -> tuple[str, ...]:
    digits = _DIGITS.sub("", s)
    n, letters = len(digits), any(c.isalpha() for c in s)
    marks = "".join(sorted({c for c in s if not c.isalnum()}))
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", s))[:14]
    left, _, right = s.partition("@")
    ip = [p for p in s.split(".")]
    return (
        f"n{min(n, 20)}", f"a{letters}", f"m{marks[:8]}", f"f{_class(s[0])}", f"l{_class(s[-1])}", f"s{shape}", f"@{s.count('@')}", f".{min(s.count('.'), 5)}",
        f"L{13 <= n <= 19 and not letters and luhn(digits)}", f"4{len(ip) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in ip)}",
        f"K{s[:4] if s[:4] in _ISSUED else ''}", f"R{_run(s)}",
        f"D{bool(left) and set(left) <= _LOCAL and bool(_DOMAIN.fullmatch(right))}", f"P{s[0] == '+' and not letters}{10 <= n <= 15}", f"B{s.count('(') == s.count(')')}",
    )


def segment_features(text: str, a: int, b: int) -> list[str]:
    """Features of a whole span: what it holds, its shape, and what touches it."""
    return [*_inner(text[a:b]), *_outer(text, a, b)]


def _outer(text: str, a: int, b: int) -> list[str]:
    before = _class(text[a - 1]) if a else "edge"
    after = _class(text[b]) if b < len(text) else "edge"
    touch = f"t{before in ('digit', 'letter')}{after in ('digit', 'letter')}"
    follow = _class(text[b + 1]) if b + 1 < len(text) else "edge"
    keyed = b - a >= 12 and bool(_KEYED.search(text, max(0, a - 24), a))
    return [touch, f"k{keyed}", f"b{before}", f"e{after}{follow if after in '.-, ' or after == 'space' else ''}", "1"]


def _cuts(text: str, a: int, b: int) -> list[int]:
    return [a] + [m.end() for m in _TOKEN.finditer(text, a, b)]


class SemiCrf:
    """Scores segments by kind; a token outside every entity scores 0."""

    def __init__(self):
        self.weights: dict[tuple[str, str], float] = {}
        self.known: dict[str, list[float]] = {}

    def __getstate__(self):
        return {"weights": self.weights, "known": {}}

    def _segments(self, text: str, cuts: list[int]) -> Iterator[tuple[int, int]]:
        """Candidate segments between cuts, one at a time: a region may be as long as a text."""
        for i in range(len(cuts) - 1):
            if text[cuts[i]].isspace() or (i and text[cuts[i] - 1].isalnum() and text[cuts[i]].isalnum() and text[cuts[i] - 1].isdigit() == text[cuts[i]].isdigit()):
                continue
            held, at = False, 0
            for j in range(i + 1, min(i + MAX_TOKENS, len(cuts) - 1) + 1):
                if cuts[j] - cuts[i] > MAX_CHARS:
                    break
                last = text[cuts[j] - 1]
                long_run = cuts[j] - cuts[j - 1] >= LONG_RUN and not text[cuts[j - 1] : cuts[j]].isalpha()
                at += last == "@"
                if at > 1:
                    break
                held = held or last == "@" or last.isdigit() or long_run
                if held and last.isalnum() and cuts[j] - cuts[i] >= 7:
                    yield i, j

    def _inside(self, s: str) -> list[float]:
        """The part of a segment's scores that its own characters give, from a bounded memo."""
        if (known := self.known.get(s)) is None:
            if len(self.known) >= MEMO:
                self.known.clear()
            known = self.known[s] = self.scores(_inner(s))
        return known

    def scores(self, features: Iterable[str]) -> list[float]:
        get = self.weights.get
        return [sum([get((k, f), 0.0) for f in features]) for k in MODEL_KINDS]

    def decode(self, text: str, a: int, b: int) -> list[Span]:
        """The best segmentation of a region: boundaries and kinds chosen together."""
        cuts = _cuts(text, a, b)
        by_end: dict[int, list[tuple[int, float, str]]] = {}
        for i, j in self._segments(text, cuts):
            own = self._inside(text[cuts[i] : cuts[j]])
            both = map(add, own, self.scores(_outer(text, cuts[i], cuts[j])))
            best, kind = max(zip(both, MODEL_KINDS, strict=True), key=lambda x: x[0])
            if best > 0:
                by_end.setdefault(j, []).append((i, best, kind))
        best, back = [0.0] * len(cuts), [None] * len(cuts)
        for j in range(1, len(cuts)):
            best[j] = best[j - 1]
            for i, s, kind in by_end.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, kind)
        out, j = [], len(cuts) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((cuts[i], cuts[j], kind))
                j = i
        return out[::-1]

    def fit(self, lines: list[tuple[str, list[Span]]], rounds: int = 12, rate: float = 0.5, ridge: float = 1e-4) -> None:
        """Maximum likelihood by AdaGrad; the sum over segmentations by forward-backward."""
        lattices = []
        for text, gold in lines:
            for a, b in regions(text):
                cuts = _cuts(text, a, b)
                segments = [(i, j, segment_features(text, cuts[i], cuts[j])) for i, j in self._segments(text, cuts)]
                if segments:
                    where = {c: k for k, c in enumerate(cuts)}
                    truth = {(where[s], where[e], k) for s, e, k in gold if s in where and e in where}
                    lattices.append((len(cuts), segments, truth))
        square: dict[tuple[str, str], float] = {}
        for _ in range(rounds):
            for n, segments, truth in lattices:
                grad: dict[tuple[str, str], float] = {}
                values = [[math.exp(min(s, 30.0)) for s in self.scores(f)] for _, _, f in segments]
                ends: dict[int, list[int]] = {}
                starts: dict[int, list[int]] = {}
                for k, (i, j, _) in enumerate(segments):
                    ends.setdefault(j, []).append(k)
                    starts.setdefault(i, []).append(k)
                total = [sum(v) for v in values]
                scale = [0.0] * n  # logarithms of the sums over all that ends here
                for j in range(1, n):
                    x = 1.0 + sum(total[k] * math.exp(scale[segments[k][0]] - scale[j - 1]) for k in ends.get(j, ()))
                    scale[j] = scale[j - 1] + math.log(x)
                backward = [0.0] * n  # logarithms
                for i in range(n - 2, -1, -1):
                    terms = [backward[i + 1]] + [math.log(total[k]) + backward[segments[k][1]] for k in starts.get(i, ())]
                    top = max(terms)
                    backward[i] = top + math.log(sum(math.exp(t - top) for t in terms))
                whole = backward[0]
                for k, (i, j, f) in enumerate(segments):
                    outside = math.exp(scale[i] + backward[j] - whole)
                    for kind, v in zip(MODEL_KINDS, values[k], strict=True):
                        g = outside * v - ((i, j, kind) in truth)
                        if abs(g) > 1e-4:
                            for name in f:
                                grad[kind, name] = grad.get((kind, name), 0.0) + g
                for key, g in grad.items():
                    g += ridge * self.weights.get(key, 0.0)
                    square[key] = square.get(key, 1e-8) + g * g
                    self.weights[key] = self.weights.get(key, 0.0) - rate * g / math.sqrt(square[key])
        self.known.clear()


def practice_lines(seed: int = 11, n: int = 60) -> list[tuple[str, list[Span]]]:
    """Made-up lines: every kind in the forms the patterns know and in forms they miss, and look-alikes."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 9)))

    def card() -> str:
        d = r.choice("3456") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", "", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    run = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda: r.choice([run(32, hexa), run(40, hexa), run(40, hexa.upper()), run(64, hexa), run(24, mixed), run(36, mixed)])
    names = ["token", "TOKEN", "api_key", "secret", "password", "access_token", "API-KEY", "client_secret"]
    named = lambda: r.choice(names) + r.choice([' = "', '="', ": ", "=", ' : "', ": '"])
    forms = {
        "email": [lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.{word()}.com", lambda: f"{word()}@{word()}.org", lambda: f"{word()}_{word()}@{word()}-{word()}.co"],
        "ip": [lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))],
        "card": [card],
        "phone": [lambda: f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+{r.randint(1, 9)}-{digits(3)}-{digits(3)}-{digits(4)}"],
    }
    alike = [lambda: digits(16), lambda: digits(8), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{word()}@{word()}", lambda: f"{digits(3)}, {digits(3)}, {digits(4)}", lambda: f"@{word()}{digits(2)}",
             lambda: f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}.{digits(2)}", lambda: f"{word()}={digits(6)}{word()}{digits(5)}", lambda: f"{digits(4)} {digits(4)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"v{digits(1)}.{digits(1)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: digits(24)]
    out = []
    for _ in range(n):
        for kind, makers in forms.items():
            for make in makers:
                head, body = f"{word()} {word()} ", make()
                out.append((head + body + r.choice([" ", ". ", ", ", "\n"]) + word(), [(len(head), len(head) + len(body), kind)]))
        for head, body in ((named(), key()), (named(), key()), ("Authorization: Bearer ", key()), (f"{word()} ", "AKIA" + run(16, hexa.upper()[:10] + "QRSTUVWXYZ"))):
            lead = f"{word()} {head}"
            quote = head[-1] if head[-1] in "\"'" else ""
            out.append((lead + body + quote + r.choice([" ", ". ", ", ", "\n"]) + word(), [(len(lead), len(lead) + len(body), "secret")]))
        for make in (lambda: f"commit {run(40, hexa)}", lambda: f"sha256:{run(64, hexa)}", lambda: f"id={run(32, hexa)}", lambda: f"{run(32, hexa)}", lambda: f"tokens {digits(8)}", lambda: f"key = {word()}{digits(2)}", lambda: f"{word()}/{run(24, mixed)}"):
            body = f"{word()} {make()} {word()}"
            out.append((body, base_spans(body)))
        for make in alike:
            body = f"{word()} {make()} {word()}"
            out.append((body, [s for s in base_spans(body)]))
    return out


def all_spans(model: SemiCrf, text: str | None) -> tuple[list[Span], list[Span]]:
    """``(base, all)``: spans of the patterns; those and what the model adds, clear of them."""
    text = text or ""
    base = base_spans(text)
    added = []
    if found := [s for a, b in regions(text) for s in model.decode(text, a, b)]:
        taken = sorted((a, b) for a, b, _ in base)
        k = 0
        for a, b, kind in found:
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if not any(x < b and y > a for x, y in taken[k : k + 8]):
                added.append((a, b, kind))
    return base, ordered(base + added)


def may_hold_secret(line: str) -> bool:
    """Could a line hold a secret, so that its pattern spans are not all of its truth?"""
    return bool(_UNSURE.search(line))


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
