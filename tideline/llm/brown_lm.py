"""Language-model scores from a Brown class-based bigram model.

Words are clustered by exchange: a word moves to the class that raises the average mutual information
of neighbouring classes most. The most frequent words, a bounded number, are exchanged one after
another until none moves; their classes are the frame. Every further word that occurs `least` times or
more is then exchanged in distributed passes over the whole training text: tasks count the classes
beside each word, Spark brings a word's counts together, and the word goes to the class of the highest
gain, all words of a pass at once; passes end when the mutual information no longer rises. Rarer words,
seen or not, fall by their spelling into one class for each shape, which thereby learns how often such
words turn up. A text's probability is the product of class transitions (interpolated with class
frequencies) and of word emissions from the classes.

Counts cover all training documents: tasks count their own tokens in bounded dictionaries, Spark
adds the counts up. The words that make up most tokens (at most FAST of them) are looked up inside
the tasks; every other word of a document is joined with the full table of counts.

Defined cases: a null, empty or blank text is the end token alone; a row without id counts as
training text; rows that repeat an id are scored one by one; without training text every token has
the same probability; an empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, spool, unlink

#: Words exchanged one after another; words looked up, and classed, inside tasks at most; classes; words a task counts at once.
CLUSTERED, FAST, CLASSES, HELD = 1000, 100_000, 48, 400_000

#: Sweeps over the first words at most; passes over the text; occurrences from which on a word is classed; neighbours a task holds.
SWEEPS, PASSES, LEAST, NEIGHBOURS = 40, 2, 3, 2_000_000

#: Tokens that are turned into numbers at a time.
STEP = 300_000

#: The weight of class frequencies in transitions, in tokens.
KAPPA = 5.0

#: The end of a text; no word is empty.
END = b""

SHAPES = 16
PART = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, shape int, times long"


def tokens(text: str | None) -> list[bytes]:
    """The words of a text; A-Z lower-cased. bytes know no other letters and exactly the six spaces."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shape(word: bytes) -> int:
    """The class of a word by its spelling: length, how it ends, whether it holds a digit."""
    n = len(word)
    long = 0 if n <= 4 else 1 if n <= 7 else 2 if n <= 11 else 3
    last = word[-1:]
    return 4 * long + 2 * (not (last.isalnum() or last >= b"\x80")) + any(48 <= c <= 57 for c in word)


class Index(dict):
    """Words to numbers; unknown ones to a number for their shape."""

    def __init__(self, words: dict[bytes, int], first_shape: int):
        super().__init__(words)
        self.first_shape = first_shape

    def __missing__(self, word: bytes) -> int:
        return self.first_shape + shape(word)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        words = list(held)
        out = [pa.array(words, pa.binary()), pa.array([shape(w) if w else -1 for w in words], pa.int32()), pa.array(list(held.values()), pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(out, ["word", "shape", "n"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            held.update(tokens(text))
            held[END] += 1
            if len(held) > HELD:
                yield flush()
    yield flush()


def vocabulary(training: DataFrame) -> DataFrame:
    """word, shape (-1: the end), n of every token of the training texts."""
    counted = training.select("text").mapInArrow(_count, "word binary, shape int, n long")
    return spool(counted.groupBy("word", "shape").agg(F.sum("n").alias("n")), "vocabulary")


def _band(n: Column) -> Column:
    """Eighths of octaves of a count, so that the frequent words are found without sorting all."""
    return F.floor(F.log2(n) * 8).cast("int")


def frequent(vocab: DataFrame, most: int) -> list[tuple[bytes, int, int]]:
    """word, shape, n of the `most` most frequent words, of equals the smaller; most frequent first."""
    words = vocab.where("shape >= 0")
    bands = sorted(words.groupBy(_band(F.col("n")).alias("band")).count().collect(), reverse=True)
    total, lowest = 0, None
    for band, n in bands:
        lowest = band
        total += n
        if total >= most:
            break
    if lowest is None or most <= 0:
        return []
    found = words.where(_band(F.col("n")) >= lowest).orderBy(F.col("n").desc(), "word").limit(most).select("word", "shape", "n").toPandas()
    rows = zip(map(bytes, found["word"]), found["shape"].tolist(), found["n"].tolist(), strict=True)
    return sorted(rows, key=lambda r: (-r[2], r[0]))


def encoded(training: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """ids: the tokens of whole texts as numbers, which all passes over the text read; written once.

    Words that are looked up have their number, other words that of their shape, texts end with the end's.
    """
    shared = training.sparkSession.sparkContext.broadcast(words)
    quick = len(words) - 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, quick)
        numbered = lambda every: pa.RecordBatch.from_arrays([pa.array([index.of(every).astype(np.int32).tobytes()], pa.binary())], ["ids"])
        for batch in batches:
            every: list[bytes] = []
            for text in batch.column("text").to_pylist():
                every += tokens(text)
                every.append(END)
                if len(every) > STEP:  # few tokens at a time: as objects they take much room
                    yield numbered(every)
                    every = []
            if every:
                yield numbered(every)

    return spool(training.select("text").mapInArrow(encode, "ids binary"), "encoded")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for ids in batch.column("ids"):
            yield np.frombuffer(ids.as_buffer(), dtype=np.int32)


def bigrams(texts: DataFrame, state: np.ndarray, states: int) -> DataFrame:
    """pair, n: neighbours among states, pair: first * states + second. texts: encoded(); state: of each number, the end's last."""
    shared = texts.sparkSession.sparkContext.broadcast(state)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, counts = shared.value, np.zeros(states * states, dtype=np.int64)
        for ids in _ids(batches):
            at = state[ids]
            counts += np.bincount(np.append(state[-1], at[:-1]) * states + at, minlength=states * states)
        pair = np.flatnonzero(counts)
        for i in range(0, len(pair), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + 100_000]), pa.array(counts[pair[i : i + 100_000]])], ["pair", "n"])

    return spool(texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "bigrams")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(left: np.ndarray, right: np.ndarray, own: float, now: int, g: np.ndarray, classes: int) -> int:
    """The class among the first `classes` that suits a word best.

    left, right: counts of classes before and after the word, itself included; own: of the word after
    itself; now: its class; g: counts of neighbouring classes.
    """
    g, left, right = g.copy(), left.copy(), right.copy()
    g[:, now] -= left
    g[now, :] -= right
    g[now, now] += own
    left[now] -= own
    right[now] -= own
    c = np.arange(classes)
    columns, rows = g[:, :classes], g[:classes, :].T
    gain = _xlogx(columns + left[:, None]) - _xlogx(columns)
    gain[c, c] = 0
    total = gain.sum(axis=0)
    gain = _xlogx(rows + right[:, None]) - _xlogx(rows)
    gain[c, c] = 0
    total += gain.sum(axis=0)
    both = g[c, c]
    total += _xlogx(both + left[:classes] + right[:classes] + own) - _xlogx(both)
    for margin, more in ((g.sum(axis=0)[:classes], left.sum() + own), (g.sum(axis=1)[:classes], right.sum() + own)):
        total -= _xlogx(margin + more) - _xlogx(margin)
    return int(np.argmax(total)) if total.max() > total[now] + 1e-9 else now


def cluster(pairs: DataFrame, m: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """The class of every state and the counts of neighbouring classes, after exchange clustering.

    The table of neighbours has states x states cells, whatever the corpus, and comes to the driver:
    a word's move counts for the words after it, which independent moves would not see.
    """
    states, kinds = m + SHAPES + 1, classes + SHAPES + 1
    of = np.append(np.arange(m) % classes, np.arange(classes, kinds))
    n = np.zeros((states, states))
    found = pairs.toPandas()
    n[found["pair"] // states, found["pair"] % states] = found["n"]
    every = np.zeros((states, kinds))
    every[np.arange(states), of] = 1
    g = every.T @ n @ every
    for _ in range(sweeps):
        held = of.copy()
        for w in range(m):
            left, right = (np.bincount(of, weights=x, minlength=kinds) for x in (n[:, w], n[w]))
            best, now = best_class(left, right, n[w, w], of[w], g, classes), of[w]
            if best != now:
                of[w] = best
                for c, sign in ((now, -1), (best, 1)):
                    if sign > 0:  # the word's own neighbourhood moves with it
                        left[now] -= n[w, w]
                        left[best] += n[w, w]
                        right[now] -= n[w, w]
                        right[best] += n[w, w]
                    g[:, c] += sign * left
                    g[c, :] += sign * right
                    g[c, c] -= sign * n[w, w]
        if (of == held).all():
            break
    return of, g


def information(g: np.ndarray) -> float:
    """The average mutual information of neighbouring classes, in nats a token, but for a constant of the text."""
    return float((_xlogx(g).sum() - _xlogx(g.sum(axis=0)).sum() - _xlogx(g.sum(axis=1)).sum()) / max(g.sum(), 1))


def neighbours(texts: DataFrame, state: np.ndarray, open_: np.ndarray, kinds: int) -> DataFrame:
    """Counts of a pass over encoded() texts: pair, n of neighbouring classes (first * kinds + second), or word, slots, times: for a
    word that may move the classes before it (slot: class) and after it (slot: kinds + class), each with how often."""
    shared = texts.sparkSession.sparkContext.broadcast((state, open_))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, open_ = shared.value
        g, held, n = np.zeros(kinds * kinds, dtype=np.int64), [], 0
        names = ["pair", "n", "word", "slots", "times"]

        def flush() -> Iterator[pa.RecordBatch]:
            key, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            word, slot = key // (2 * kinds), key % (2 * kinds)
            edge = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word))
            for i in range(0, len(edge) - 1, 10_000):
                e = edge[i : i + 10_001]
                cells, size = slice(e[0], e[-1]), len(e) - 1
                blobs = [
                    pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(((e - e[0]) * wide).astype(np.int32).tobytes()), pa.py_buffer(x[cells].astype(kind).tobytes())])
                    for x, kind, wide in ((slot, np.uint8, 1), (times, np.uint32, 4))
                ]
                yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.array(word[e[:-1]]), *blobs], names)

        for ids in _ids(batches):
            at = ids.astype(np.int64)
            c = state[at]
            before = np.append(state[-1], c[:-1])
            g += np.bincount(before * kinds + c, minlength=kinds * kinds)
            mine = np.flatnonzero(open_[at])  # the end is not open, so each of these has a token after it
            held += [at[mine] * 2 * kinds + before[mine], at[mine] * 2 * kinds + kinds + c[mine + 1]] if len(mine) else []
            n += 2 * len(mine)
            if n > NEIGHBOURS:
                yield from flush()
                n = 0
        if held:
            yield from flush()
        pair = np.flatnonzero(g)
        none = lambda kind: pa.nulls(len(pair), kind)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(g[pair]), none(pa.int64()), none(pa.binary()), none(pa.binary())], names)

    return spool(texts.mapInArrow(count, "pair long, n long, word long, slots binary, times binary"), "neighbours")


def moves(counted: DataFrame, g: np.ndarray, classes: int, most: int) -> np.ndarray:
    """The best class of each word that may move, -1 for others. counted: what neighbours() has counted.

    With the other words where they are, the likelihood is linear in the word's counts: each neighbour
    adds the logarithm of how often its class stands beside the word's class, over that class's size.
    """
    size = np.log(g.sum(axis=0)[:classes] + KAPPA)
    worth = np.concatenate([np.log(g[:, :classes] + 0.5) - size, np.log(g[:classes, :].T + 0.5) - size])
    shared = counted.sparkSession.sparkContext.broadcast(worth)

    def cells(blobs: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of a column of blobs, and where each blob's begin."""
        edge = np.frombuffer(blobs.buffers()[1], dtype=np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
        width = np.dtype(kind).itemsize
        return np.frombuffer(blobs.buffers()[2], dtype=kind, count=(edge[-1] - edge[0]) // width, offset=edge[0]), (edge[:-1] - edge[0]) // width

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = shared.value
        gains, seen = np.zeros((most, classes)), np.zeros(most, dtype=bool)  # bounded by the words that are looked up
        for whole in batches:
            for i in range(0, len(whole), 2000):
                batch = whole.slice(i, 2000)
                word = batch.column("word").to_numpy()
                (slots, starts), (times, _) = cells(batch.column("slots"), np.uint8), cells(batch.column("times"), np.uint32)
                gain = np.add.reduceat(worth[slots] * times[:, None], starts, axis=0)  # no blob is empty
                order = np.argsort(word, kind="stable")
                own, first = np.unique(word[order], return_index=True)
                gains[own] += np.add.reduceat(gain[order], first, axis=0)
                seen[own] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(gains[at].argmax(axis=1), pa.int64())], ["word", "class"])

    out = np.full(most, -1)
    dealt = counted.where("word is not null").select("word", "slots", "times").repartition("word")
    found = dealt.mapInArrow(choose, "word long, class long").toPandas()  # at most FAST rows
    out[found["word"]] = found["class"]
    return out


@dataclass
class Model:
    """What scoring needs: bounded tables, and the full table of counts."""

    vocab: DataFrame
    words: dict[bytes, int]
    state: np.ndarray  # class of each index: fast words, shapes, the end
    base: np.ndarray
    emission: np.ndarray
    transition: np.ndarray
    tokens: int
    types: int
    shape_tokens: list[int]
    shape_types: list[int]


def train(training: DataFrame, clustered: int = CLUSTERED, fast: int = FAST, classes: int = CLASSES, sweeps: int = SWEEPS, passes: int = PASSES, least: int = LEAST) -> Model:
    training = training.select("text")
    vocab = vocabulary(training)
    n, v = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    quick = frequent(vocab, fast)
    core = [w for w, _, _ in quick[:clustered]]
    kinds, m = classes + SHAPES + 1, len(core)
    words = {w: i for i, (w, _, _) in enumerate(quick)} | {END: len(quick) + SHAPES}
    texts = encoded(training, words)
    single = np.array([*range(m), *[m + s for _, s, _ in quick[m:]], *range(m, m + SHAPES + 1)])
    first, _ = cluster(bigrams(texts, single, m + SHAPES + 1), m, classes, sweeps)
    state = np.array([*first[: len(core)], *[classes + s for _, s, _ in quick[len(core) :]], *range(classes, kinds)])
    open_ = np.array([i >= len(core) and times >= least for i, (_, _, times) in enumerate(quick)] + [False] * (SHAPES + 1))
    held = None
    for turn in range(passes + 1):
        counted = neighbours(texts, state, open_ & (turn < passes), kinds)
        g = np.zeros(kinds * kinds)
        found = counted.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
        g[found["pair"]] = found["n"]
        g = g.reshape(kinds, kinds)
        if held is None or information(g) > information(held[1]):
            held = state, g
        else:
            break
        if turn == passes or not open_.any():
            break
        best = moves(counted, g, classes, len(state))
        unlink(training.sparkSession, counted)
        state = np.where(best >= 0, best, state)
    state, g = held
    unlink(training.sparkSession, texts)

    shape_tokens, shape_types = [0] * SHAPES, [0] * SHAPES
    for s, total, types in vocab.where("shape >= 0").groupBy("shape").agg(F.sum("n"), F.count("*")).collect():
        shape_tokens[s], shape_types[s] = total, types
    class_tokens = np.zeros(classes)
    for at, (_, s, times) in zip(state, quick, strict=False):
        if at < classes:
            shape_tokens[s] -= times
            shape_types[s] -= 1
            class_tokens[at] += times
    base, emission = [], []
    for at, (_, s, times) in zip(state, quick, strict=False):
        base.append(math.log10((times + 1) / (n + v + 1)))
        emission.append(math.log10((times + 1) / (shape_tokens[s] + shape_types[s] + 1)) if at >= classes else math.log10(times / class_tokens[at]))
    ends = vocab.where("shape < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    base += [0.0] * SHAPES + [math.log10((ends + 1) / (n + v + 1))]
    emission += [0.0] * (SHAPES + 1)
    share = (g.sum(axis=0) + 1) / (g.sum() + len(g))
    transition = np.log10((g + KAPPA * share) / (g.sum(axis=1, keepdims=True) + KAPPA))
    return Model(vocab, words, state, np.array(base), np.array(emission), transition, n, v, shape_tokens, shape_types)


def score(documents: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every document."""
    shared = documents.sparkSession.sparkContext.broadcast((model.words, model.state, model.base, model.emission, model.transition))
    quick, ended = len(model.words) - 1, int(model.tokens > 0)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, state, base, emission, transition = shared.value
        index, end = Index(words, quick), quick + SHAPES
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, len(whole), 1000)):
            every: list[bytes] = []
            counts = []
            for text in batch.column("text").to_pylist():
                own = tokens(text)
                every += own
                every.append(END)
                counts.append(len(own) + 1)
            at, n = index.of(every), len(counts)
            doc = np.repeat(np.arange(n), counts)
            c = state[at]
            before = np.append(state[end], c[:-1])
            logs = transition[before, c] + emission[at]
            fast = (at < quick) | ((at == end) & bool(ended))
            total = lambda x: np.bincount(doc, weights=x, minlength=n)
            rare = np.flatnonzero((at >= quick) & (at < end))
            times = Counter(zip(doc[rare].tolist(), [every[i] for i in rare], (at[rare] - quick).tolist(), strict=True))
            row, doc_id, out = batch.column("row"), batch.column("doc_id"), batch.column("held_out")
            m = len(times)
            which = pa.array([d for d, _, _ in times], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([row, row.take(which)]),
                    pa.concat_arrays([doc_id, doc_id.take(which)]),
                    pa.concat_arrays([out, out.take(which)]),
                    pa.array(counts + [0] * m, pa.int64()),
                    pa.array(np.append(total(fast).astype(np.int64), np.zeros(m, np.int64))),
                    pa.array(np.append(total(base[at]), np.zeros(m))),
                    pa.array(np.append(total(logs), np.zeros(m))),
                    pa.array([None] * n + [w for _, w, _ in times], pa.binary()),
                    pa.array([None] * n + [s for _, _, s in times], pa.int32()),
                    pa.array([0] * n + list(times.values()), pa.int64()),
                ],
                names=[c.split()[0] for c in PART.split(", ")],
            )

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), held_out.alias("held_out"), "text")
    rows = rows.mapInArrow(parts, PART)
    # rows without a word get a key of their own, which no word can be: words hold no space
    key = F.coalesce("word", F.concat(F.lit(b" "), F.col("row").cast("string").cast("binary")))
    rows = rows.withColumn("key", key).join(model.vocab.select(F.col("word").alias("key"), "n"), "key", "left")
    seen, rare = F.coalesce("n", F.lit(0)), F.col("word").isNotNull()
    of = lambda values: F.get(F.array(*[F.lit(float(x)) for x in values]), F.col("shape"))
    room = of([a + b + 1 for a, b in zip(model.shape_tokens, model.shape_types, strict=True)])
    add = lambda p: F.when(rare, F.col("times") * F.log10(p)).otherwise(0.0)
    base, own = add((seen + 1) / F.lit(float(model.tokens + model.types + 1))), add((seen + 1) / room)
    known = F.when(rare & (seen > 0), F.col("times")).otherwise(0)
    return (
        rows.select("row", "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), (F.col("base") + base).alias("base"), (F.col("score") + own).alias("score"))
        .groupBy("row", "doc_id", "held_out")
        .agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
    )


def lm_scores(documents: DataFrame, modulus: int = 7, fold: int = 2) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold."""
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == fold, F.lit(False))
    return score(documents, train(documents.where(~out)), out)
