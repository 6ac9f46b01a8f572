"""Personal data: high-recall candidate spans, boosted trees on format and context, calibrated thresholds.

Base spans (email, ip, card, phone as defined by fixed patterns and checks) are always kept. Wide generators add
overlapping candidates the base patterns miss: masked addresses, numbers without a plus, cards with other separators, colon addresses.
Each candidate gets format and context features; gradient-boosted trees score it, a Platt fit on held-out examples makes the
score a probability and each kind has the lowest threshold that reaches MIN_PRECISION there. Selected candidates that
overlap no base span and no better candidate are added.

The trees are fitted on EXAMPLES generated labelled strings (the corpus has no labels for personal data); the number
is the documented bound. Scoring covers every whole text.

Spans are code points, end exclusive. Cases: null and empty texts have no spans; repeated rows get a row each;
an empty table gives no rows; other columns are ignored by the query and kept by redact().
All scans are linear in the text: starts inside a run of digits or name characters are skipped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
EXAMPLES, TREES, DEPTH, RATE, MIN_PRECISION, SEED = 6000, 40, 3, 0.2, 0.99, 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that began inside a run of digits could have begun at the run's start, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_CARD_HINT = re.compile(r"[0-9](?:[\x20-]?[0-9]){15}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

_WIDE = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20|@)\x20?[\w-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[\w-]{1,63}){1,6}"),
    "ip": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[./_]|\x20\x20|\x20-\x20)[0-9]{4}(?:[./_]|\x20\x20|\x20-\x20)[0-9]{4}(?:[./_]|\x20\x20|\x20-\x20)[0-9]{4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-]\x20?[0-9]{3,4}(?:[\x20.-][0-9]{3,4}){1,2}(?![0-9])"),
}
_HINTS = {
    "email": re.compile(r"\(at\)|\[at\]|\{at\}|\x20at\x20[^\x20]+\x20dot\x20|@\x20|\x20@", re.I),
    "ip": re.compile(r":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"),
    "card": re.compile(r"[0-9]{4}(?:[./_]|\x20\x20|\x20-\x20)[0-9]{4}(?:[./_]|\x20\x20|\x20-\x20)[0-9]{4}"),
    "phone": re.compile(r"[0-9]\)?[\x20.-]\x20?[0-9]{3,4}[\x20.-][0-9]{3}"),
}
_WORDS = {
    "email": ("mail", "contact", "write", "reach", "courriel", "correo"),
    "ip": ("ip", "host", "server", "addr", "login"),
    "card": ("card", "visa", "pay", "credit", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "mobil", "fax", "ruf", "sms"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The defined matches, by kind as listed and then start."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        k = at
        while k > end and text[k - 1] in _LOCAL:
            k -= 1
        m = _DOMAIN.match(text, at + 1) if k < at else None
        if m:
            out.append(("email", k, end := m.end()))
        at = text.find("@", max(at + 1, end))
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))]
    if _CARD_HINT.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Wide, overlapping spans of all kinds."""
    return [(k, *m.span()) for k in KINDS if _HINTS[k].search(text) for m in _WIDE[k].finditer(text)]


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format of the span and what stands around it."""
    s = text[a:b]
    digits = _NOT_DIGIT.sub("", s)
    groups = re.findall(r"[0-9]+", s)
    before, after = text[max(0, a - 30) : a].lower(), text[b : b + 2]
    seps = {c for c in s if not c.isalnum()}
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(len(seps)), float(s.count(" ")), float(s.count(".")), float(s.count("-")), float("(" in s), float("[" in s or "{" in s), float("@" in s), float(" at " in s.lower()),
        float(luhn(digits)) if digits else 0.0, float(s.startswith("0")), float(bool(groups) and groups[0][:2] in ("19", "20") and len(groups[0]) == 4), float(sum(c.isupper() for c in s)),
        float(any(w in before for w in _WORDS[kind])), float(before[-1:].isalnum()), float(before[-1:] in ("-", "/", "#", "=", "$", "€")), float(after[:1].isalnum()), float(after[:1] in ("-", "/", "%")),
        float(len(set(digits))), float(":" in s),
    ]


class Trees:
    """Depth-limited regression trees boosted on the logistic loss; splits on quantile cuts."""

    def __init__(self):
        self.trees: list[list[tuple[int, float]]] = []
        self.leaves: list[np.ndarray] = []
        self.bias, self.platt = 0.0, (1.0, 0.0)
        self.thresholds: dict[str, float] = {}

    def _leaf(self, x: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            f = np.array([t[0] for t in tree])[at]
            c = np.array([t[1] for t in tree])[at]
            at = 2 * at + 1 + (x[np.arange(len(x)), f] > c)
        return at - (len(tree))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        p = y.mean()
        self.bias = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.bias)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])) for f in range(x.shape[1])]
        for _ in range(TREES):
            prob = 1 / (1 + np.exp(-raw))
            g, h = y - prob, prob * (1 - prob)
            tree, groups = [], [np.arange(len(y))]
            for _depth in range(DEPTH):
                nxt = []
                for rows in groups:
                    f, c = self._split(x[rows], g[rows], h[rows], cuts)
                    tree.append((f, c))
                    right = x[rows, f] > c
                    nxt += [rows[~right], rows[right]]
                groups = nxt
            values = np.array([RATE * g[r].sum() / (h[r].sum() + 1.0) for r in groups])
            for rows, v in zip(groups, values):
                raw[rows] += v
            self.trees.append(tree), self.leaves.append(values)

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float]:
        best, out = 0.0, (0, float("inf"))
        G, H = g.sum(), h.sum()
        for f, cs in enumerate(cuts):
            for c in cs:
                left = x[:, f] <= c
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl * gl / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G * G / (H + 1)
                if gain > best + 1e-9:
                    best, out = gain, (f, float(c))
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree, leaves in zip(self.trees, self.leaves):
            out += leaves[self._leaf(x, tree)]
        return out

    def prob(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-(a * self.raw(x) + b)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by Newton steps, then a threshold for each kind."""
        r, w = self.raw(x), np.array([1.0, 0.0])
        m = np.stack((r, np.ones_like(r)), axis=1)
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(30):
            p = 1 / (1 + np.exp(-m @ w))
            hess = (m * (p * (1 - p))[:, None]).T @ m + 1e-6 * np.eye(2)
            w = w - np.linalg.solve(hess, m.T @ (p - t))
        self.platt = (float(w[0]), float(w[1]))
        prob = self.prob(x)
        for k, kind in enumerate(KINDS):
            own = x[:, 0] == k
            order = np.argsort(-prob[own])
            hits = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            good = np.flatnonzero(hits >= MIN_PRECISION)
            self.thresholds[kind] = max(0.5, float(prob[own][order][good[-1]])) if len(good) else 1.1


def _example(rng: np.random.Generator) -> tuple[str, str, int, int, int] | None:
    """A text with one candidate span, and whether it is personal data."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    one = lambda *x: x[int(rng.integers(len(x)))]
    kind, good = one(*KINDS), int(rng.integers(2))
    cue = one(*_WORDS[kind]) + one(": ", " ") if rng.random() < (0.7 if good else 0.05) else one("", name(4) + " ", name(7) + " ")
    if kind == "email":
        at, dot = one(("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" @ ", "."))
        s = name(5) + one(".", "") + name(3) + at + name(6) + dot + one("com", "org", "net", "de") if good else name(4) + " at " + name(5) + one(" dot ", ".", " . ") + name(6)
    elif kind == "ip":
        s = ":".join("%x" % rng.integers(1, 65536) for _ in range(8)) if good else ":".join(d(2) for _ in range(int(rng.integers(4, 7))))
    elif kind == "card":
        body = d(15)
        body += next(c for c in "0123456789" if luhn(body + c) == bool(good))
        s = one(".", "/", "_", "  ", " - ").join(body[i : i + 4] for i in (0, 4, 8, 12))
    else:
        if good:
            s = one(f"({d(3)}) {d(3)}-{d(4)}", f"{one('2','3','5','6')}{d(2)}-{d(3)}-{d(4)}", f"0049 {d(3)} {d(4)} {d(3)}", f"0{d(2)} {d(4)} {d(4)}")
        else:
            s = one(f"{one('19','20')}{d(2)}-{d(3)}-{d(3)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(2)}-{d(4)}-{d(3)}")
    text = name(6) + " " + cue + (one("$", "=", "#", "") if not good else "") + s + one(" ", ".", ", " + name(3), "" if good else "%")
    for k, a, b in candidates(text):
        if k == kind:
            return text, kind, a, b, good
    return None


_MODEL: list[Trees] = []


def model() -> Trees:
    """The fitted trees; the same on every call."""
    if not _MODEL:
        rng = np.random.default_rng(SEED)
        rows = [e for e in (_example(rng) for _ in range(EXAMPLES)) if e]
        x, y = np.array([features(*r[:4]) for r in rows]), np.array([float(r[4]) for r in rows])
        t, cut = Trees(), len(rows) * 2 // 3
        t.fit(x[:cut], y[:cut]), t.calibrate(x[cut:], y[cut:])
        _MODEL.append(t)
    return _MODEL[0]


def all_spans(text: str, base: list[tuple[str, int, int]], trees: Trees) -> list[tuple[str, int, int]]:
    """Base spans and the selected candidates that overlap none of them."""
    found = candidates(text)
    if not found:
        return base
    x = np.array([features(text, *c) for c in found])
    prob = trees.prob(x)
    taken, spans = sorted((a, b) for _, a, b in base), list(base)
    for k in np.argsort(-prob, kind="stable"):
        kind, a, b = found[k]
        if prob[k] >= trees.thresholds[kind] and not any(a < e and s < b for s, e in taken):
            spans.append(found[k]), taken.append((a, b))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    spark = docs.sparkSession
    small_batches(spark, 512)
    trees = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            hashes, lines = [], []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in base))
                hashes.append(hashlib.sha256(_line(base).encode()).hexdigest())
                lines.append(_line(all_spans(text or "", base, trees)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(lines, pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out.append(text[at:a] + f"<{kind}>")
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text replaced; every column and row stays."""
    spark = docs.sparkSession
    small_batches(spark, 512)
    trees, schema = model(), docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None else redacted(t, all_spans(t, base_spans(t), trees)) for t in b.column(at).to_pylist()]
            cols = [b.column(k) if k != at else pa.array(texts, pa.string()) for k in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
