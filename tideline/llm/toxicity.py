"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, threat, target, negation, report, ...), and the composed transducers of
grammar.py read the classes of a text clause by clause. What they write labels each clause: a threat, a
directed insult, an insult, one at the speaker, a negated or a reported one. A text is scored by its
labelled clauses, not by the words alone: the weight of each label times the logarithm of its number, and
the strongest, the sum and the density of what is asserted. Weights start from the values below and move to
what labelled texts say (logistic loss, a Gaussian prior about the start). Insults come from a short
list, whose strengths labels change, and from the labels: a word, or a stem with any ending, that is
significantly more common in toxic texts, near copies counted once.

Training reads a bounded sample (LABELLED rows, the ones of the smallest hashes) of the labelled rows of
the training fold; everything else covers all rows and whole texts.

Defined cases: a null text is an empty one; a text without a labelled clause gets the score of the bias
alone; a null id is in no fold; rows that repeat an id are scored one by one; labels that are null, name
no document or contradict each other are not learnt from; without labels the weights stay where they
start; an empty table gives an empty result. Columns other than id and text are never inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grammar
from .common import spool, unlink
from .quality import drawn_by_hash, in_fold

#: At most so many labelled texts are learnt from.
LABELLED = 40_000

#: Scores from here on are toxic.
BAR = 0.3

#: A word or stem becomes an insult if so many toxic texts have it, its share of them is so many times that of the others, and the likelihood ratio statistic reaches so much.
TEXTS, LIFT, SIGNIFICANCE = 5, 4.0, 24.0

#: So many words and stems, the most significant, are looked at; a stem has so many letters.
CANDIDATES = 2000
STEM = range(3, 9)

LABELS = ["threat", "directed", "insult", "self", "negated", "reported"]
ASSERTED = {"threat", "directed", "insult"}

#: Where learning starts: the bias, a weight for each label, and for the strongest, the sum and the density of what is asserted; and how far, as a deviation, the data may easily pull them.
START = np.array([-2.9, 2.5, 1.0, 0.7, 0.1, 0.2, 0.3, 2.2, 0.5, 0.3])
PULL = np.array([1.0, 1.0, 0.7, 0.7, 0.7, 0.7, 0.7, 1.0, 1.0, 1.0])

#: Fixed words of each class. Insults are strong or mild: how many of four texts that hold one would be toxic.
STRONG = """idiot idiots idiotic moron morons moronic imbecile imbeciles stupid loser losers scum scumbag pathetic worthless bastard bastards asshole
assholes bitch bitches cunt dumbass dickhead jackass douchebag wanker retarded kys arschloch trottel vollidiot hurensohn connard salope imbécile
idiota idiotas estúpido estúpida gilipollas pendejo cabrón""".split()
MILD = """disgusting trash clown clowns garbage dumb fool fools foolish ugly vermin filth filthy freak creep parasite lowlife coward cretin dimwit halfwit
nitwit dunce brainless spineless despicable subhuman shit crap dumm blöd dummkopf stupide crétin abruti tonto basura""".split()
WORDS = {
    "T": "kill murder hurt beat stab shoot destroy smash strangle burn punch crush slap choke attack töten umbringen tuer frapper matar golpear",
    "X": "rot suffer bleed hang perish sterben crever morir",
    "V": "die",
    "W": "will gonna shall going should must deserve deserves hope want 'll youll ill wanna werde wirst soll vais vas voy",
    "Y": "you your u ur ya youre yall he she they them him her their his these those du dich dir ihr euch tu te toi vous él ella ellos",
    "Z": "yourself yourselves urself themselves",
    "S": "i me my myself im we ich mich je moi yo",
    "N": "not no never nor neither without isnt arent wasnt werent dont doesnt didnt cant cannot wont nicht kein keine nie pas jamais nunca",
    "R": "said says say called calls calling wrote writes quoted quotes claimed claims reported reports accused alleged according insulted sagte nannte dit dijo",
}

#: Digits and signs that stand for letters.
DIGITS = dict(zip("013457", "oieast", strict=True))
SIGNS = {"@": "a", "$": "s", "!": "i"}
SIGN = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])|(?<![^\W_])[@$](?=[^\W_])")

PIECE = re.compile(r"[$@]?[^\W_]+(?:['’@$!][^\W_]+)*")
TOKEN = re.compile(r"(?P<P>\n[ \t]*\n|\n)|(?P<end>[.!?;:…]+(?=\s|$|[\"”»]))|(?P<c>[,，])|(?P<Q>[\"“”«»„])|(?P<w>[$@]?[^\W_]+(?:['’@$!][^\W_]+)*)")

#: A verb of class V where a clause or the text may end.
ENDING = re.compile(r"(?<![^\W_])(?:die)(?:(?![^\W_]|[,，\"“”«»„]).)*?(?:[\n.!?;:…]|$)")

#: Drawn-out letters, and whether a text has any.
RUN = re.compile(r"(.)\1{2,}")
DRAWN = re.compile(r"(\w)\1\1")

#: A task remembers so many spellings at a time.
SPELLINGS = 50_000


def plain_(word: str) -> str:
    return word.lower().replace("’", "").replace("'", "")


def spelled(word: str) -> list[str]:
    """A word as the lists would have it: lower case; without the apostrophe; undisguised; without drawn-out letters."""
    plain = plain_(word)
    open_ = undisguised(plain) if re.search(r"[^\W\d_]", plain) else plain
    return list(dict.fromkeys([plain, open_, RUN.sub(r"\1\1", open_), RUN.sub(r"\1", open_)]))


def undisguised(text: str) -> str:
    """Digits, and signs within or before a word, as the letters that they stand for."""
    for sign, letter in DIGITS.items():
        text = text.replace(sign, letter)
    return SIGN.sub(lambda m: SIGNS[m.group()], text) if "@" in text or "$" in text or "!" in text else text


def patterns(word: str) -> list[str]:
    """The word itself, and its stems, the longest first."""
    return [word, *(word[:k] + "-" for k in reversed(STEM) if k < len(word))]


@dataclass
class Grammar:
    """Insults with their strengths (a stem ends in a hyphen), weights, and the compiled transducers."""

    insults: dict[str, float]
    weights: np.ndarray = field(default_factory=START.copy)

    def __post_init__(self) -> None:
        self.classes = {w: k for k, words in WORDS.items() for w in words.split()} | dict.fromkeys(self.insults, "I")
        self.table = grammar.composed()
        self.known: dict[str, tuple[str, float]] = {}
        self.places: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "places": None}

    def read(self, word: str) -> tuple[str, float]:
        """Class and strength of a word."""
        if word not in self.known:
            if len(self.known) >= SPELLINGS:
                self.known.clear()
            form = next((f for w in spelled(word) for f in patterns(w) if f in self.classes), None)
            kind = self.classes.get(form, "o")
            self.known[word] = kind, self.insults.get(form, 0.0) if kind == "I" else 0.0
        return self.known[word]

    def may_match(self, text: str) -> bool:
        """False only where no transducer would write a label: the text has no insult, and no threatening verb that something announces.

        Looks at the text as spelled() would, all words at a time.
        """
        if self.places is None:
            self.places = ahocorasick.Automaton()
            for form, kind in self.classes.items():
                if kind in "ITXWZ":
                    bare = form.removesuffix("-")
                    self.places.add_word(undisguised(bare), [*self.places.get(undisguised(bare), []), (len(bare), form != bare, kind)])
            self.places.make_automaton()
        low = plain_(text)
        open_ = undisguised(low)
        looks = dict.fromkeys([low, open_])
        if DRAWN.search(open_):
            looks |= dict.fromkeys([RUN.sub(r"\1\1", open_), RUN.sub(r"\1", open_)])
        verb = announced = False
        for look in looks:
            for last, forms in self.places.iter(look):
                for size, stem, kind in forms:
                    if (last < size or not look[last - size].isalnum()) and (stem or last + 1 == len(look) or not look[last + 1].isalnum()):
                        if kind == "I":
                            return True
                        verb, announced = verb or kind in "TX", announced or kind in "WZ"
        return announced and (verb or any(ENDING.search(x) for x in looks))

    def clauses(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, strength) of each labelled clause: its weightiest label, its strongest insult."""
        if not self.may_match(text):
            return []
        follows, writes = self.table
        place = {k: i for i, k in enumerate(grammar.CLASSES)}
        out: list[tuple[int, int, str, float]] = []
        state, start, end, labels, strength = 0, None, 0, set(), 0.0

        def close() -> None:
            nonlocal start, labels, strength
            if labels:
                out.append((start, end, min(labels, key=LABELS.index), strength))
            start, labels, strength = None, set(), 0.0

        for m in TOKEN.finditer(text):
            kind = m.lastgroup
            x, weight = self.read(m.group()) if kind == "w" else ("#" if kind == "end" else kind, 0.0)
            k = place[x]
            said, state = writes[state][k], follows[state][k]
            if kind in ("P", "end"):
                if said and start is not None:
                    labels.add(said)
                close()
                continue
            start, end = (m.start() if start is None else start), m.end()
            if said:
                labels.add(said)
                strength = max(strength, weight)
        if start is not None and (said := writes[state][place["P"]]):  # the text ends its last clause
            labels.add(said)
        close()
        return out

    def features(self, text: str, clauses: list[tuple[int, int, str, float]]) -> list[float]:
        """One, the logarithm of each label's number, and of what is asserted the strongest, the sum and the density."""
        if not clauses:
            return [1.0] + [0.0] * (len(START) - 1)
        times = Counter(c[2] for c in clauses)
        asserted = [c[3] for c in clauses if c[2] in ASSERTED]
        density = 100 * len(asserted) / (len(asserted) + len(text.split()))
        return [1.0, *(float(np.log1p(times[k])) for k in LABELS), max(asserted, default=0.0), float(np.log1p(sum(asserted))), float(np.log1p(density))]

    def score(self, text: str, clauses: list[tuple[int, int, str, float]]) -> float:
        return float(1 / (1 + np.exp(-np.dot(self.weights, self.features(text, clauses)))))


def strength(toxic: float, clean: float, of_four: float, base: float) -> float:
    """How much more likely a text is toxic that holds the word: log odds over those of all texts, by a prior of four texts."""
    share = (of_four + toxic) / (4 + toxic + clean)
    return float(np.clip((np.log(share / (1 - share)) - np.log(base / (1 - base))) / 4, 0, 1.5))


def listed() -> dict[str, float]:
    """The fixed insults before anything is learnt."""
    return {w: strength(0, 0, 2, 0.05) for w in MILD} | {w: strength(0, 0, 3, 0.05) for w in STRONG}


def significance(a: Column, b: Column, n: int, m: int) -> Column:
    """The likelihood ratio statistic of a in n toxic texts against b in m others."""
    share = (a + b) / F.lit(n + m)
    part = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    return 2 * (part(a, n * share) + part(b, m * share) + part(n - a, n * (1 - share)) + part(m - b, m * (1 - share)))


def chosen(candidates: list[tuple[str, int, int]]) -> dict[str, tuple[int, int]]:
    """Words and stems with their toxic and clean texts, the most significant first; of those that begin alike only the first stays."""
    out: dict[str, tuple[int, int]] = {}
    taken: set[str] = set()  # whatever an accepted one begins with, and itself
    for name, a, b in candidates:
        bare = name.removesuffix("-")
        if bare in taken or any(bare[:k] + "-" in out for k in range(1, len(bare))):
            continue
        out[name] = (a, b)
        taken.update(bare[:k] for k in range(1, len(bare) + 1))
    return out


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Weights of the least logistic loss with the prior, by Newton's method; a row of x stands for so many texts."""
    w = START.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (times * (p - y)) + (w - START) / PULL**2
        curve = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag(1 / PULL**2)
        step = np.linalg.solve(curve, slope)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return w


def _words(text: str | None) -> set[str]:
    return {plain_(w) for w in set(PIECE.findall(text or "")) if not w.isdigit()}


def first_copies(texts: DataFrame) -> DataFrame:
    """The texts that share none of four least hashes of three words with a text of a smaller row number."""
    words = F.split(F.lower("text"), r"\s+")
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.slice("w", i + 1, 3)))
    salted = lambda k: F.transform("h", lambda h: F.xxhash64(h, F.lit(k)))
    least = F.array(*[F.array_min(salted(k)) for k in range(4)])
    marked = texts.select("row", words.alias("w")).select("row", hashes.alias("h")).select("row", F.explode(least).alias("h"))
    first = marked.groupBy("h").agg(F.min("row").alias("first"))
    copies = marked.join(first, "h").where("first < row").select("row").distinct()
    return texts.join(copies, "row", "left_anti")


def counted(texts: DataFrame, among: set[str] | None = None) -> DataFrame:
    """name and n, the texts that hold a word or stem; only those of the names `among`, if given."""
    shared = texts.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = shared.value
        times: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(times.keys(), pa.string()), pa.array(times.values(), pa.int64())], ["name", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if among is None:
                    times.update({p for w in _words(text) for p in patterns(w)})
                else:  # where no name begins with a word's first letters, none of its patterns is among them
                    words = (w for w in _words(text) if w in among or w[: STEM[0]] + "-" in among)
                    times.update({p for w in words for p in patterns(w) if p in among})
                if len(times) > 200_000:
                    yield out()
                    times = Counter()
        yield out()

    return texts.select("text").mapInArrow(run, "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))


def train(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Grammar:
    """Learns insults and weights; documents and labels of the training fold alone."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
    marked = spool(marked.where("low = high").select("doc_id", (F.col("low") == 1).alias("toxic")), "marked")
    picked = spool(drawn_by_hash(marked, labelled, 7).select("doc_id").join(marked, "doc_id"), "drawn")  # at most `labelled` rows
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.monotonically_increasing_id().alias("row"), "toxic", "text")
    texts = spool(texts, "labelled")
    once = spool(first_copies(texts), "once")
    sizes = dict(once.groupBy("toxic").count().collect())
    n, m = sizes.get(True, 0), sizes.get(False, 0)
    if not n:
        drop(marked, picked, texts, once)
        return Grammar(listed())
    a, b, listed_ = F.col("a"), F.col("b"), F.col("name").isin(*STRONG, *MILD)
    hits = spool(counted(once.where("toxic")).where(listed_ | (F.col("n") >= TEXTS)), "hits")  # of at most `labelled` texts
    among = {r.name for r in hits.select("name").collect()}
    misses = counted(once.where("not toxic"), among)
    counts = hits.select("name", F.col("n").alias("a")).join(misses.withColumnRenamed("n", "b"), "name", "left").fillna(0, ["b"])
    above = counts.select("name", "a", "b", significance(a, b, n, m).alias("value")).where(listed_ | (a >= TEXTS) & (a * m > LIFT * n * b) & (F.col("value") >= SIGNIFICANCE))
    order = [F.desc(listed_), F.desc("value"), F.col("name").endswith("-"), F.desc(F.length("name")), "name"]
    found = chosen([(r.name, r.a, r.b) for r in above.orderBy(*order).limit(CANDIDATES).collect()])
    base = min(max(n / (n + m), 0.001), 0.5)
    found = dict.fromkeys([*STRONG, *MILD], (0, 0)) | found
    insults = {w: strength(a, b, 3 if w in STRONG else 2, base) for w, (a, b) in found.items()}
    model = Grammar({w: s for w, s in insults.items() if s > 0})

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t, model.clauses(t)) for t in (t or "" for t in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    rows = texts.select("toxic", "text").mapInArrow(described, "toxic boolean, x array<double>").groupBy("toxic", "x").count().orderBy("x", "toxic").toPandas()
    drop(marked, picked, texts, once, hits)
    model.weights = fit(np.stack(rows["x"]), rows["toxic"].to_numpy(float), rows["count"].to_numpy(float))
    return model


def drop(*tables: DataFrame) -> None:
    for t in tables:
        unlink(t.sparkSession, t)


def toxic_clauses(documents: DataFrame, model: Grammar, name: str = "score", clauses: str = "clauses") -> DataFrame:
    """documents with two further columns, of names that they do not have: the score, and the labelled clauses with their places."""
    at = documents.columns.index("text")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("start", T.IntegerType()), ("end", T.IntegerType()), ("label", T.StringType()), ("strength", T.DoubleType()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("strength", pa.float64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = [model.clauses(t) for t in texts]
            scores = pa.array([model.score(t, c) for t, c in zip(texts, found, strict=True)], pa.float64())
            listed = pa.array([[dict(zip(("start", "end", "label", "strength"), c, strict=True)) for c in x] for x in found], spans)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), scores, listed], [*batch.schema.names, name, clauses])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType()), T.StructField(clauses, kind)]))


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(documents.where(~in_fold()), labels.where(~in_fold()))
    scored = toxic_clauses(documents.select("doc_id", in_fold().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= BAR).cast("int").alias("predicted"))
