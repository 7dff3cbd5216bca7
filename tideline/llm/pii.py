"""Personal data: proposed spans, judged by boosted trees over their format and context.

Four formats (e-mail address, IP address, payment card, telephone number) give the base spans, which
are always redacted. Generators of high recall propose further, overlapping spans: numbers in any
grouping (every part of a run of digit groups that begins and ends with a group, so that neighbouring
numbers do not hide each other), obfuscated addresses, dotted groups. Gradient-boosted trees score each proposal by its
shape and by the text around it; a kind's calibrated threshold, the lowest that keeps the asked
precision on held-out proposals, selects, best score first, spans that overlap no other.

The trees learn from labelled proposals: those of a bounded sample of documents whose nature is known
(base spans, and digits inside a longer word or code) and those of templates, formatted from a seeded
generator (labelled by what the template stands for: personal data in unusual formats, or dates,
amounts, versions, ..., alone or beside other numbers). The thresholds come from templates of other
formats than the trees have seen; the tests measure both on formats that neither has seen.

Defined cases: a null or empty text has no spans; rows that repeat an id are scanned one by one, and
so are rows without one; spans of two kinds may overlap if both are base spans; an empty table gives
an empty result and trains on the templates alone; columns other than id and text are ignored
(redaction keeps them). Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

#: The base formats. Possessive and anchored forms of the same matches, linear in the text.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What the generators propose: numbers of some length, dotted groups, addresses with a written at and dot.
NUMBER = re.compile(r"(?<![0-9])[+(]?[0-9](?:[\x20().\-/]{0,3}[0-9]){6,}+")
DIGITS = re.compile(r"[0-9]+")
GROUPS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[.,:_][0-9]{1,3}){3}+(?![0-9])")
WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]{1,63}+){1,8}")

#: Documents sampled for training; their proposals at most; precision asked of a threshold.
SAMPLE_DOCUMENTS, PROPOSALS, PRECISION = 2000, 20_000, 0.99

#: Digits of a proposed number; proposals scored at once.
FEWEST, MOST, SCORED = 7, 19, 20_000

CONTEXT = {"email": "mail contact e-mail write", "ip": "ip host server address ping", "card": "card visa credit account iban payment", "phone": "tel phone call fax mobile whatsapp cell"}
AGAINST = "version order isbn invoice date id no number ref total chapter page range score".split()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """kind, start, end of the base formats, by kind, then start."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:  # an address is the run of local characters before an @, if a domain follows it
        before = text[done:at]
        local = len(before) - len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if local else None
        if m:
            found.append((0, at - local, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in IP.finditer(text):
        # a part of more than three characters is over 255 unless it begins with zeros
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def numbers(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """start, end, digits of each part of a run that begins and ends with a digit group, and whether it is the whole run."""
    for run in NUMBER.finditer(text):
        groups = [m.span() for m in DIGITS.finditer(text, *run.span())]
        for i, (start, _) in enumerate(groups):
            if start > run.start() and text[start - 1] in "+(":
                start -= 1
            n = 0
            for a, end in groups[i : i + MOST]:
                n += end - a
                if n > MOST:
                    break
                if n >= FEWEST:
                    yield start, end, n, (start, end) == run.span()


def proposals(text: str) -> list[tuple[int, int, int]]:
    """kind, start, end of what may be personal data; overlapping, of high recall."""
    out = [(0, m.start(), m.end()) for m in WRITTEN.finditer(text)]
    out += [(1, m.start(), m.end()) for m in GROUPS.finditer(text)]
    for start, end, n, _ in numbers(text):
        if 12 <= n <= 19:
            out.append((2, start, end))
        if 7 <= n <= 15:
            out.append((3, start, end))
    return out


class Taken:
    """Spans that overlap no other, for looking up whether a further one does."""

    def __init__(self, spans: list[tuple[int, int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a proposed span."""
    s = text[start:end]
    d = digits_of(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    parts = re.split(r"[.,:_]", s)
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 12].lower()
    previous, following = text[start - 1 : start], text[end : end + 1]
    near = re.findall(r"[^\W\d_]+", before)
    inner = re.findall(r"[^0-9]+", s.lstrip("+("))  # what joins its groups, and what joins it to the groups beside it
    left, right = re.search(r"([0-9]+)([\x20().\-/]{1,3})\Z", before), re.match(r"([\x20().\-/]{1,3})([0-9]+)", after)
    return [
        float(kind), float(end - start), float(len(d)), float(len(groups)), float(max(groups)), float(min(groups)), float(groups[0]), float(groups[-1]),
        *[float(s.count(c)) for c in " -./(+:,"],
        float(s[:1] == "+"), float(s[:1] == "("), float(s[:2] == "00"), float(d[:1] or -1),
        float(len(d) > 1 and luhn(d)), float(len(parts) == 4 and all(p.isdigit() and int(p[:6]) <= 255 for p in parts)),
        float(len(set(groups)) == 1), float(len(set(d))), float("@" in s), float("at" in s), float("dot" in s), float(sum(c.isalpha() for c in s)),
        *[float(any(w.startswith(k) for w in near for k in words.split())) for words in CONTEXT.values()],
        float(any(w in AGAINST for w in near)),
        float(previous.isalnum()), float(previous in "$€£#"), float(bool(previous) and previous in "./-:,_="),
        float(following.isalnum()), float(bool(following) and following in "%°/-_"), float(bool(re.match(r"\.?[0-9]", after))),
        float(len(left[1]) if left else 0), float(len(right[2]) if right else 0), float(left is not None and left[2] in inner), float(right is not None and right[1] in inner),
        float(len(set(inner))), float(s.count("(") == s.count(")")),
        float(len(groups) >= 3 and groups[0] == 4 and groups[1] == 2), float(re.match(r"(19|20)\d\d\b", s) is not None),
    ]


@dataclass
class Trees:
    """Boosted regression trees on the log odds: arrays of nodes, children at 2i+1 and 2i+2."""

    cuts: list[np.ndarray]
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    bars: tuple[float, ...] = (1.1,) * len(KINDS)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.array([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], dtype=np.int64).reshape(len(self.cuts), len(x)).T

    def probability(self, x: np.ndarray) -> np.ndarray:
        b, f = self.binned(x), np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                at = 2 * at + 1 + (b[np.arange(len(x)), feature[at]] > cut[at])
            f += value[at]
        return 1 / (1 + np.exp(-f))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Second-order gradient boosting of the log loss over quantile bins."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(cuts, float(np.log(share / (1 - share))))
    b, f, wide = model.binned(x), np.full(len(x), model.start), bins + 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        n = 2 ** (depth + 1) - 1
        feature, cut, value = np.zeros(n, dtype=np.int64), np.full(n, wide), np.zeros(n)
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 8:
                    continue
                best, gs, hs = 1e-6, g[rows].sum(), h[rows].sum()
                for j in range(x.shape[1]):
                    gl = np.bincount(b[rows, j], weights=g[rows], minlength=wide).cumsum()
                    hl = np.bincount(b[rows, j], weights=h[rows], minlength=wide).cumsum()
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], j, k
            at = 2 * at + 1 + (b[np.arange(len(x)), feature[at]] > cut[at])
        sums = np.bincount(at, weights=g, minlength=n), np.bincount(at, weights=h, minlength=n)
        value = -rate * sums[0] / (sums[1] + l2)
        f += value[at]
        model.trees.append((feature, cut, value))
    return model


def calibrated(model: Trees, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> tuple[float, ...]:
    """For each kind the lowest threshold, 0.5 at least, from which on held-out proposals are right often enough."""
    p, bars = model.probability(x), []
    for kind in range(len(KINDS)):
        mine = x[:, 0] == kind
        order = np.argsort(-p[mine], kind="stable")
        scores, right = p[mine][order], y[mine][order].cumsum()
        enough = (right >= precision * np.arange(1, len(right) + 1)) & (scores >= 0.5) & (right >= 10)
        enough &= np.append(scores[1:] < scores[:-1], True)[: len(scores)]  # no threshold between equal scores
        bars.append(float(scores[np.flatnonzero(enough)[-1]]) if enough.any() else 1.1)
    return tuple(bars)


def templates(n: int = 2500, seed: int = 3, families: str = "train") -> list[tuple[str, int, int, int, int]]:
    """text, kind, start, end, label of proposals in made-up sentences. No format of one of the three families is in another."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdehilmnorstu") for _ in range(r.randint(2, 9)))
    octet = lambda: str(r.randint(0, 255))

    def card() -> str:
        head = r.choice("3456") + d(14)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def no_card(k: int) -> str:
        return next(c for c in iter(lambda: d(k), None) if not luhn(c))

    def local() -> str:
        return r.choice([f"{word()}.{word()}", f"{word()}_{word()}", word() + d(2), word()])

    def grouped(s: str, by: str) -> str:
        return by.join(s[i : i + 4] for i in range(0, len(s), 4))

    personal = {
        "train": [
            (0, lambda: f"{local()}{r.choice([' (at) ', '(at)', '@'])}{word()}{r.choice(['.', ' (dot) ', '(dot)'])}com"),
            (1, lambda: ".".join(octet() for _ in range(4))),
            (2, lambda: card()),
            (2, lambda: grouped(card(), " ")),
            (3, lambda: f"({d(3)}) {d(3)}-{d(4)}"),
            (3, lambda: f"{r.randint(200, 999)}-{d(3)}-{d(4)}"),
            (3, lambda: f"{r.randint(200, 999)} {d(3)} {d(4)}"),
            (3, lambda: f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}"),
            (3, lambda: f"00{r.randint(20, 99)} {d(2)} {d(4)} {d(4)}"),
        ],
        "calibrate": [
            (0, lambda: f"{local()}{r.choice(['[at]', ' [at] '])}{word()}{r.choice(['.', '[dot]'])}org"),
            (1, lambda: ".".join(octet() for _ in range(4))),
            (2, lambda: grouped(card(), "-")),
            (3, lambda: f"{r.randint(200, 999)}.{d(3)}.{d(4)}"),
            (3, lambda: f"+{r.randint(20, 99)} {d(3)} {d(7)}"),
            (3, lambda: f"({d(3)}) {d(3)} {d(4)}"),
        ],
        "test": [
            (0, lambda: f"{local()}{r.choice([' {at} ', '{at}'])}{word()}{r.choice(['.', '{dot}'])}net"),
            (1, lambda: ".".join(octet() for _ in range(4))),
            (2, lambda: grouped(card(), r.choice([".", "/"]))),
            (3, lambda: f"+{r.randint(20, 99)}-{d(2)}-{d(7)}"),
            (3, lambda: f"00{r.randint(20, 99)}-{d(3)}-{d(7)}"),
            (3, lambda: f"({d(3)}){d(3)}.{d(4)}"),
        ],
    }[families]
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    other = {
        "train": [
            lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}.{d(2)}",
            lambda: f"{r.randint(1990, 2010)}-{r.randint(2011, 2030)}",
            lambda: f"{d(1)}.{d(2)}.{d(1)}.{d(2)}{r.choice(['.', '-', '_'])}{d(2)}",
            lambda: f"{r.randint(256, 999)}.{d(3)}.{d(3)}.{d(3)}",
            lambda: f"{r.randint(1, 9)},{d(3)},{d(3)},{d(3)}",
            lambda: no_card(r.randint(7, 19)),
            lambda: grouped(no_card(16), r.choice([" ", "-", ""])),
            lambda: hexes(r.randint(0, 20)) + r.choice("abcdef") + d(r.randint(7, 14)) + r.choice("abcdef") + hexes(r.randint(0, 12)),
            lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
            lambda: f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}",
            lambda: f"{word()}(at){word()}",
            lambda: r.choice([" ", "  ", " - ", " / "]).join(d(r.randint(1, 6)) for _ in range(r.randint(3, 8))),
        ],
        "calibrate": [
            lambda: f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1990, 2030)}",
            lambda: f"{d(2)}:{d(2)}:{d(2)}:{d(2)}",
            lambda: no_card(r.randint(7, 19)),
            lambda: grouped(no_card(r.choice([15, 16, 17])), r.choice([" ", "-"])),
            lambda: hexes(32),
            lambda: f"{d(3)}.{d(6)}",
            lambda: f"{r.randint(1990, 2030)}/{r.randint(1, 12):02}/{r.randint(1, 28):02} {d(4)}",
            lambda: r.choice(["-", " | ", "/"]).join(d(r.randint(1, 6)) for _ in range(r.randint(3, 8))),
        ],
        "test": [
            lambda: f"{d(4)}/{d(4)}",
            lambda: f"{d(2)}-{d(2)}-{d(2)}-{d(2)}",
            lambda: f"{d(1)}.{d(1)}.{d(3)}.{d(5)}",
            lambda: no_card(r.randint(7, 19)),
            lambda: hexes(40),
            lambda: " / ".join(d(r.randint(2, 5)) for _ in range(r.randint(3, 8))),
        ],
    }[families]
    beside = [lambda: f"{r.randint(1, 12):02}/{r.randint(20, 35)}", lambda: str(r.randint(1990, 2030)), lambda: d(r.randint(1, 5))]
    out = []
    for _ in range(n):
        kind, make = r.choice(personal) if r.random() < 0.5 else (None, r.choice(other))
        s = make()
        lead = "" if r.random() < 0.6 else r.choice(CONTEXT[KINDS[kind]].split()) if kind is not None else r.choice(AGAINST)
        mark = r.choice(["", "", "", "#", "$", "v"]) if kind is None else ""
        text = " ".join([word() for _ in range(4)] + [lead] * bool(lead)) + r.choice([" ", ": "]) + mark
        first, personal_at = len(text), set()
        parts = [(kind, s)]
        if r.random() < 0.4:  # other numbers beside it, or a row of its like
            by = r.choice([" ", " ", "  ", " / ", " - "])
            more = [(kind, make()) for _ in range(r.randint(1, 3))] if r.random() < 0.5 else [(None, r.choice(beside)())]
            parts = parts + more if r.random() < 0.7 else more + parts
        for i, (k, part) in enumerate(parts):
            text += by if i else ""
            if k is not None:
                personal_at.add((k, len(text), len(text) + len(part)))
            text += part
        last = len(text)
        text += f" {word()} {word()}."
        out += [(text, *span, int(span in personal_at)) for span in proposals(text) if span[1] < last and span[2] > first]
    return out


def arrays(made: list[tuple[str, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of proposals of templates."""
    return np.array([features(*m[:4]) for m in made]), np.array([m[4] for m in made], dtype=np.float64)


def train(documents: DataFrame, most: int = SAMPLE_DOCUMENTS, kept: int = PROPOSALS) -> Trees:
    """The trees, from templates and a sample of documents; their thresholds, from templates of other formats.

    Of a document's proposals only those are labelled whose nature is known: base spans (1), and digits
    inside a longer word or code (0). The rest may well be personal data in formats that no rule states.
    """

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for text in batch.column("text").to_pylist():
                base = set(base_spans(text))
                for span in proposals(text):
                    _, a, b = span
                    inside = text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()
                    if span in base or inside:
                        x.append(features(text, *span))
                        y.append(int(span in base))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "y"])

    texts = documents.where("text is not null")
    share = most / max(1, documents.count())
    some = texts.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40))).select("text")
    order = [F.xxhash64(F.col("x")), F.col("x"), F.col("y")]
    rows = some.mapInArrow(propose, "x array<double>, y int").orderBy(*order).limit(kept).toPandas()  # the same rows every time
    x, y = arrays(templates())
    if len(rows):
        x, y = np.concatenate([x, np.stack(rows["x"])]), np.concatenate([y, rows["y"].to_numpy(dtype=np.float64)])
    order = np.lexsort((y, *x.T))
    model = boost(x[order], y[order])
    model.bars = calibrated(model, *arrays(templates(families="calibrate", seed=4)))
    return model


def select(texts: list[str], model: Trees) -> list[tuple[list, list]]:
    """For each text its base spans and the further spans that the model selects."""
    base = [base_spans(t) for t in texts]
    asked, x, good = [], [], []

    def judge() -> None:
        p = model.probability(np.array(x)) if x else []
        good.extend((-q, a - b, i, k, a, b) for q, (i, k, a, b) in zip(p, asked, strict=True) if q >= model.bars[k])
        asked.clear()
        x.clear()

    for i, t in enumerate(texts):
        taken = Taken(base[i])
        for k, a, b in proposals(t):
            if model.bars[k] <= 1 and not taken.touches(a, b):
                asked.append((i, k, a, b))
                x.append(features(t, k, a, b))
                if len(x) == SCORED:
                    judge()
    judge()
    more: list[list] = [[] for _ in texts]
    chosen = [Taken() for _ in texts]
    for _, _, i, k, a, b in sorted(good):  # of equal scores the longer span
        if not chosen[i].touches(a, b):
            chosen[i].add(a, b)
            more[i].append((k, a, b))
    return list(zip(base, more, strict=True))


def text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(documents: DataFrame, model: Trees | None = None) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model or train(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = select([t or "" for t in batch.column("text").to_pylist()], shared.value)
            counts = [[sum(k == kind for k, _, _ in base) for base, _ in both] for kind in range(len(KINDS))]
            digests = [hashlib.sha256(text_of(base).encode()).hexdigest() for base, _ in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
                 pa.array([text_of(base + more) for base, more in both], pa.string()), pa.array([len(more) for _, more in both], pa.int64())],
                names=[c.split()[0] for c in FOUND.split(", ")],
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind that begins it."""
    out, done = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(documents: DataFrame, model: Trees | None = None) -> DataFrame:
    """documents with redacted texts; n_chars, where they have it, counts the new text. Other columns stay."""
    shared = documents.sparkSession.sparkContext.broadcast(model or train(documents))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            both = select([t or "" for t in texts], shared.value)
            new = [None if t is None else redacted(t, base + more) for t, (base, more) in zip(texts, both, strict=True)]
            columns = [pa.array(new, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = documents.mapInArrow(run, T.StructType(documents.schema.fields))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0)).cast(kind)))
    return out
