"""Personal data by candidate gradient boosting.

Generators with high recall propose overlapping spans of four kinds: email, ip, card, phone. Boosted trees score
each candidate from its format (lengths, groups, separators, check digits) and its context (neighbouring characters,
words before it); a threshold per kind, calibrated on candidates that the trees were not fitted to, selects spans.
Trees and thresholds are made here, from candidates in texts that a seeded generator writes: true data in several
spellings, and things that look like them (identifiers, versions, dates, hexadecimal digests, sums).

A base layer of exact patterns, leftmost and non-overlapping per kind, always counts; the trees only add to it:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card   [0-9]([\\x20-]?[0-9])+, 12 to 19 digits that pass Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 9 to 15 digits

What the trees add: email addresses whose name or domain has letters beyond ASCII (a wider span over the base one),
addresses spelt with words or brackets for the signs, telephone numbers without a plus where form and words say so,
and internet addresses or cards with spaced or odd separators beside telling words.

Defined results: null and empty texts have no span. Spans are in code points, end exclusive, ordered by start, then
kind, then end; no span is listed twice. Redaction replaces the union of overlapping spans by [kind] of the first.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, map_batches, ship, texts

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
TREES, DEPTH, RATE = 40, 3, 0.3
LEAST_PRECISION = 0.995

SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"

Span = tuple[int, str, int]  # start, kind, end

_DIGIT = re.compile("[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The look-behinds only spare attempts that must fail as the one at the run's start did.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[Span]:
    """What the exact patterns find and accept."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            out.append((start, "email", done))
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), "card", m.end()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= len(digits_of(m[0])) <= 15:
            out.append((m.start(), "phone", m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return out


# Generators: wide patterns, a kind each; what they propose may overlap.
#: Spans have no greatest length: an address starts where its first letter is. Runs are taken whole (++), as what may
#: follow one is never part of it, so no text takes more than a few passes.
_WIDE_DOMAIN = re.compile(r"@[^\W_]++(?:[.-][^\W_]++)+")
_WIDE_LOCAL = re.compile(r"[^\W_]|[._%+-]")
_SPELT = re.compile(
    r"(?<![\w.%+-])[\w.%+-]++(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)[A-Za-z0-9-]++"
    r"(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)+(?![\w-])",
    re.I,
)
#: The part of _SPELT that texts seldom have: without it there is nothing to find.
_SPELT_AT = re.compile(r"[\[({]\x20?at\x20?[\])}]|\x20at\x20[a-z0-9-]++(?:\x20?[\[({]\x20?dot|\x20dot\x20|\.[a-z0-9-])", re.I)
_NUMBERS = re.compile(r"(?<![\w+])(?:\(?[0-9](?:[\x20()./-]{0,3}[0-9]){5,})(?!\w)")
_GROUP = re.compile(r"\(?[0-9]+")
MOST_DIGITS, MOST_GROUPS = 19, 5
_CUES = {
    "email": re.compile(r"(?:e-?mail|mail|contact|write|reach|address|kontakt|correo|courriel)\W*(?:\w+\W+)?\Z", re.I),
    "ip": re.compile(r"(?:\bip|address|host|server|ping|login from|logged in from)\W*(?:\w+\W+)?\Z", re.I),
    "card": re.compile(r"(?:card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)\W*(?:\w+\W+){0,2}\Z", re.I),
    "phone": re.compile(r"(?:phone|tel|call|fax|mobile|cell|telefon|tel[eé]fono|t[eé]l[eé]phone|whatsapp|sms)\W*(?:\w+\W+){0,2}\Z", re.I),
}
_OTHER_CUE = re.compile(r"(?:order|invoice|version|isbn|ref|no|nr|id|code|serial|total|sum|page|item|date|build|ticket)\W*(?:\w+\W+)?\Z", re.I)


def _number_spans(text: str, start: int, end: int) -> list[Span]:
    """What a run of digits and separators may be: as a whole, or, with too many digits for that, up to MOST_GROUPS
    neighbouring groups of it (an address with the same sign between its four)."""
    out: list[Span] = []
    n = len(digits_of(text[start:end]))
    if n <= MOST_DIGITS:
        if 7 <= n <= 15:
            out.append((start, "phone", end))
        if 12 <= n:
            out.append((start, "card", end))
        if 4 <= n <= 12 and len(re.split(r"[^0-9]+", text[start:end].strip("()"))) == 4:
            out.append((start, "ip", end))
        return out
    groups = [(m.start(), m.end(), len(digits_of(m[0]))) for m in _GROUP.finditer(text, start, end)]
    for i, (a, _, _) in enumerate(groups):
        n, some = 0, groups[i : i + MOST_GROUPS]
        for j, (_, b, more) in enumerate(some):
            n += more
            if 7 <= n <= 15:
                out.append((a, "phone", b))
            if 12 <= n <= MOST_DIGITS:
                out.append((a, "card", b))
            if j == 3 and all(g[2] <= 3 for g in some[:4]):
                between = {text[x[1] : y[0]] for x, y in zip(some[:3], some[1:4], strict=True)}
                if len(between) == 1 and not between.pop().isspace():
                    out.append((a, "ip", b))
    return out


def candidates(text: str) -> list[Span]:
    """Overlapping proposals beyond the base patterns."""
    out: list[Span] = []
    at = text.find("@")
    while at >= 0:
        m, start = _WIDE_DOMAIN.match(text, at), at
        while m and start and _WIDE_LOCAL.match(text, start - 1):  # ends at the @ before, so no letter is seen twice
            start -= 1
        if m and start < at:
            out.append((start, "email", m.end()))
        at = text.find("@", at + 1)
    if _SPELT_AT.search(text):
        out += [(m.start(), "email", m.end()) for m in _SPELT.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            out += _number_spans(text, m.start(), m.end())
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate, as numbers."""
    start, kind, end = span
    s, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 4]
    digits = digits_of(s)
    groups = [g for g in re.split(r"[^0-9]+", s) if g]
    signs = {c: s.count(c) for c in " -./()@"}
    return [
        float(ORDER[kind]),
        float(len(s)),
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(len(groups[-1]) if groups else 0),
        float(bool(digits) and luhn(digits)),
        float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(signs[" "]),
        float(signs["-"]),
        float(signs["."]),
        float(signs["/"]),
        float(signs["("] > 0 and signs[")"] > 0 and s[:1] == "("),
        float(signs["@"]),
        float(not s.isascii()),
        float(bool(re.search(r"[\[({]", s)) and kind == "email"),
        float(bool(_CUES[kind].search(before))),
        float(any(bool(c.search(before)) for k, c in _CUES.items() if k != kind)),
        float(bool(_OTHER_CUE.search(before))),
        float(before[-1:].isspace() or not before),
        float(after[:1].isspace() or not after),
        float(before[-1:] in "\"'=#:$€"),
        float(before[-1:] in "-./_+"),
        float(s[:1] in "0"),
        float(s[-3:].isalpha()),
        float(before.rstrip("\x20()./-")[-1:].isdigit()),
        float(after.lstrip("\x20()./-")[:1].isdigit()),
    ]


# Boosted trees: depth-limited, on the logistic loss.
Node = tuple  # (feature, bound, left, right) or (value,)


def _fit_tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Node:
    leaf = (float(-g.sum() / (h.sum() + 1.0)),)
    if depth == 0 or len(x) < 20:
        return leaf
    best, where = 1e-3, None
    root = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not cut.size:
            continue
        gain = gs[cut] ** 2 / (hs[cut] + 1.0) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1.0) - root
        i = int(gain.argmax())
        if gain[i] > best:
            best, where = float(gain[i]), (f, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    if where is None:
        return leaf
    low = x[:, where[0]] < where[1]
    return (*where, _fit_tree(x[low], g[low], h[low], depth - 1), _fit_tree(x[~low], g[~low], h[~low], depth - 1))


def _apply(tree: Node, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[rows] += RATE * tree[0]
        return
    low = x[rows, tree[0]] < tree[1]
    _apply(tree[2], x, rows[low], out)
    _apply(tree[3], x, rows[~low], out)


class Boosted:
    def __init__(self, trees: list[Node], bound: dict[str, float]) -> None:
        self.trees, self.bound = trees, bound

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            _apply(t, x, np.arange(len(x)), out)
        return out


def _written(rng: random.Random, letters: str) -> tuple[str, list[Span]]:
    """One made-up text with its true spans."""
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        d = rng.choice("3456") + num(rng.choice((13, 14, 14, 14)))
        return d + next(c for c in "0123456789" if luhn(d + c))

    def grouped(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    quad = lambda sep: sep.join(str(rng.randint(0, 255)) for _ in range(4))
    domain = lambda dot: dot.join([word().lower() or "x", rng.choice(("com", "org", "net", "de", "fr", "es"))])
    at, dot = rng.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", ".")))
    plain = "".join(c for c in letters if c.isascii()) or "ab"
    local = lambda: "".join(rng.choice(plain) for _ in range(rng.randint(2, 8)))
    true = [
        ("email", rng.choice(("email ", "write to ") if at == " at " else ("", "email ", "write to ")), local() + at + local() + dot + rng.choice(("com", "org", "net"))),
        ("email", "", word() + rng.choice((".", "")) + num(2) + "@" + domain(".")),
        ("phone", rng.choice(("phone ", "tel. ", "call ", "fax: ", "mobile ")), rng.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(7)}", f"{num(3)} {num(3)} {num(4)}", f"0{num(3)}/{num(6)}"))),
        ("phone", "", f"({num(3)}) {num(3)}-{num(4)}"),
        ("card", rng.choice(("card ", "visa ", "credit card ")), grouped(card(), rng.choice(("/", ".", "  ")))),
        ("ip", rng.choice(("ip ", "host ", "server ", "address ")), quad(rng.choice((" . ", "-")))),
    ]
    false = [
        num(rng.randint(6, 20)), num(16), grouped(num(16), rng.choice((" ", "-", "/"))), f"{num(2)}.{num(2)}.20{num(2)}", f"20{num(2)}-{num(2)}-{num(2)}",
        f"{num(1)}.{num(2)}.{num(1)}.{num(4)}", "order " + num(10), "invoice no " + f"{num(3)}-{num(4)}", "id " + num(12), "isbn 978-" + f"{num(1)}-{num(3)}-{num(5)}-{num(1)}",
        "total " + f"{num(3)} {num(3)} {num(3)}", "version " + quad("-"), f"{word()} at {word()}.{word()}", f"{word()}@{word()}", f"{num(3)} {num(4)} {num(2)}", f"page {num(3)}-{num(4)}",
        '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"', f"{num(4)} {num(4)} {num(4)}", f"{num(2)}/{num(2)}/{num(4)} {num(2)}", f"{num(3)}-{num(2)}-{num(4)}",
        " ".join(num(rng.randint(2, 5)) for _ in range(rng.randint(6, 12))), f"{num(4)}-{num(4)}", f"{num(2)} {num(2)} {num(2)} {num(2)}", num(10), num(11), f"{num(16)} {num(16)}", f"{local()} at {local()} dot com",
    ]
    text, spans = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(1, 6))) + " "
        if rng.random() < 0.4:
            kind, cue, s = rng.choice(true)
            spans.append((len(text) + len(cue), kind, len(text) + len(cue) + len(s)))
            text += cue + s
            if kind == "phone" and rng.random() < 0.1:  # another of the same form
                s = "".join(rng.choice("0123456789") if c.isdigit() else c for c in s)
                spans.append((len(text) + 1, kind, len(text) + 1 + len(s)))
                text += " " + s
        else:
            text += rng.choice(false)
        text += rng.choice((" ", ". ", ", ", "\n"))
    return text + word(), spans


@cache
def model(seed: int = 11, written: int = 5000) -> Boosted:
    """Trees fitted to two thirds of the written texts, thresholds calibrated on the rest."""
    rng = random.Random(seed)
    alphabets = ("abcdefghijklmnopqrstuvwxyz", "abcdeinrstäöüß", "abcdeinrstéèêçà", "abcdeinorstñíóá")
    fit, kept = ([], []), ([], [])
    for i in range(written):
        text, spans = _written(rng, rng.choice(alphabets))
        x, y = kept if i % 3 == 0 else fit
        for c in candidates(text):
            x.append(features(text, c))
            y.append(c in spans)
    x, y = np.array(fit[0]), np.array(fit[1], float)
    trees: list[Node] = []
    margin = np.zeros(len(x))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_fit_tree(x, p - y, p * (1 - p), DEPTH))
        _apply(trees[-1], x, np.arange(len(x)), margin)
    out = Boosted(trees, {})
    x, y = np.array(kept[0]), np.array(kept[1], float)
    margin = out.margin(x)
    for kind in KINDS:
        mine = x[:, 0] == ORDER[kind]
        order = np.argsort(-margin[mine], kind="stable")
        m, right = margin[mine][order], np.cumsum(y[mine][order])
        good = np.flatnonzero(right >= LEAST_PRECISION * np.arange(1, len(m) + 1))
        last = int(good[-1]) if good.size else -1
        bound = m[last] if last >= 0 else np.inf
        # midway to the next candidate, so that rounding decides nothing; never below even odds
        out.bound[kind] = max(0.0, float((bound + m[last + 1]) / 2 if 0 <= last < len(m) - 1 else bound))
    return out


def all_spans(docs: list[str], trees: Boosted) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the base spans, and all spans, both in order."""
    base, owner, rows, spans = [], [], [], []
    for i, text in enumerate(docs):
        base.append(sorted(base_spans(text), key=lambda s: (s[0], ORDER[s[1]], s[2])))
        begins = [s[0] for s in base[i]]
        reach = list(accumulate((s[2] for s in base[i]), max))  # of the base spans up to each
        for c in candidates(text):
            before = bisect_right(begins, c[0])
            if not before or reach[before - 1] < c[2]:  # nothing to add within a base span
                owner.append(i)
                spans.append(c)
                rows.append(features(text, c))
    more: dict[int, set[Span]] = {}
    if rows:
        margin = trees.margin(np.array(rows))
        for i, c, m in zip(owner, spans, margin, strict=True):
            if m > trees.bound[c[1]]:
                more.setdefault(i, set()).add(c)
    return [(b, sorted(more[i].union(b), key=lambda s: (s[0], ORDER[s[1]], s[2])) if i in more else b) for i, b in enumerate(base)]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{kind}]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans and their number, for every row of docs. No shuffle."""
    trees = model()

    def make():
        def each(batch: pa.RecordBatch) -> dict[str, object]:
            found = all_spans(texts(batch), trees)
            counts = {f"n_{k}": [sum(s[1] == k for s in base) for base, _ in found] for k in KINDS}
            return counts | {
                "doc_id": batch.column("doc_id"),
                "base_sha256": [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found],
                "spans": [listed(every) for _, every in found],
                "n_spans": [len(every) for _, every in found],
            }

        return each

    return map_batches(docs.select("doc_id", "text"), make, SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of its texts replaced; null texts stay null, rows and other columns stay as they are.

    Where a text changed, a column n_chars gets its new length.
    """
    trees = model()
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        hold()
        whole = column.to_pylist()
        found = all_spans([t or "" for t in whole], trees)
        return pa.array([None if t is None else redact(t, every) for t, (_, every) in zip(whole, found, strict=True)], pa.string())

    new = clean(F.col("text"))
    out = {"text": new}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(new != F.col("text"), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return docs.withColumns(out)
