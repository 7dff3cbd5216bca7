"""Secret scans: fixed formats, and character Markov models for what has no format.

Three formats (assignments, access keys, runs of hexadecimal digits) give the base spans. Beyond
them, every run of key characters, and every part of one between its separators, is scored by two
first-order character models, one of random strings and one of ordinary identifiers. A run whose mean
log-likelihood ratio reaches the threshold becomes a span of kind "random", and so does a part of a run
that as a whole does not, unless a base span overlaps it.

The models are counted from labelled samples: generated random strings of several alphabets against
ordinary words, those stated below and the distinct words of a bounded sample of documents, alone and
joined to identifiers; a word counts once, however often it occurs. A model backs off from a pair of
characters to the second character alone, so that characters which it has hardly seen stay unlikely.
The threshold lies between what all but `false` of the ordinary samples score and what all but a
twentieth of the random ones do; it never falls below the former. DataFrame functions only.

Defined cases: a null or empty text has no spans; rows that repeat an id are scanned one by one, a
row without an id too; an empty table gives an empty result and needs no words to train on; columns
other than id and text are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spool

#: The formats, in the order in which kinds are listed.
KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

#: Runs of key characters and their parts. HEX16: as HEX finds runs whole, the long ones alone.
HEX16, RUN, PART = r"[0-9a-f]{16,}", r"[A-Za-z0-9+/_=-]{16,}", r"[A-Za-z0-9+]{16,}"

#: Ordinary words, whatever the table holds.
ORDINARY = """
    about account action address after again amount answer array author balance before between button cache change
    channel class client column comment company config content context control counter country create current customer
    database default delete detail device directory document domain element email enable error event example export
    field file filter folder format function general group handler header history image import index input instance
    internal invoice item language layout length level license limit list location manager market member message method
    model module network number object option order output package page parameter parent partner password path payment
    people person picture platform point policy position price process product profile program project property provider
    public query question reader record reference region release remote report request response result return sample
    schedule school screen search section security server service session setting shipping signal source standard start
    state status storage string style subject summary support system table target template thread ticket timestamp title
    travel update upload user value vendor version video visible warning website window worker writer
    zwischen geschichte gesellschaft verwaltung entwicklung regierung
    gouvernement recherche histoire toujours ciudad gobierno trabajo siempre
""".split()

#: The lowest key character and how many codes there are from it on: "+" to "z".
FIRST, CODES = 43, 80

#: Documents whose words are ordinary samples; letters of the longest such word; random strings of each alphabet.
SAMPLE_DOCUMENTS, LONGEST_WORD, RANDOM_STRINGS = 2000, 40, 2000


@dataclass(frozen=True)
class Model:
    """The log-likelihood ratio, random over ordinary, of each pair of key characters, by first and second; the threshold."""

    ratios: tuple[float, ...]
    bar: float


def codes(string: Column) -> Column:
    """The key characters of a string as numbers from 0."""
    return F.transform(F.filter(F.split(string, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST)


def score(string: Column, ratios: tuple[float, ...]) -> Column:
    """The mean ratio of a string's pairs."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # a constant
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0.0).alias("sum"))
    step = lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.coalesce(F.get(table, s["last"] * CODES + c), F.lit(0.0))).alias("sum"))
    return F.aggregate(codes(string), start, step, lambda s: s["sum"]) / (F.length(string) - 1)


def samples(documents: DataFrame, most: int = SAMPLE_DOCUMENTS, strings: int = RANDOM_STRINGS) -> DataFrame:
    """string, label: 1 for generated random strings, 0 for ordinary words and identifiers."""
    spark = documents.sparkSession
    share = most / max(1, documents.count())
    mine = documents.select("text").where("text is not null")
    some = mine.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40)))
    found = some.select(F.explode(F.split("text", r"[^A-Za-z0-9+/_=-]+")).alias("w")).where(f"length(w) between 4 and {LONGEST_WORD} and w rlike '^[A-Za-z]+$'")
    stated = spark.createDataFrame([(w,) for w in ORDINARY], "w string")
    words = stated.unionByName(found.select(F.lower("w").alias("w"))).distinct()
    # words and those that follow them in the order of their hashes, in 64 rings
    at = F.xxhash64("w")
    words = words.withColumn("v", F.lead("w").over(Window.partitionBy(F.pmod(at, F.lit(64))).orderBy(at, "w"))).withColumn("v", F.coalesce("v", "w"))
    number = F.pmod(F.xxhash64("w", "v"), F.lit(1000)).cast("string")
    w, v = F.col("w"), F.col("v")
    joined = [F.concat_ws("_", w, v), F.concat_ws("_", w, v, number), F.concat(w, F.initcap(v)), F.concat(F.initcap(w), F.initcap(v), number), F.upper(F.concat_ws("_", w, v)), F.concat_ws("-", w, v, number), F.concat(F.lit("/"), F.concat_ws("/", w, v)), F.concat(w, v), F.concat_ws("=", w, v)]
    ordinary = words.select(F.explode(F.array(w, F.initcap(w), *joined)).alias("string"))
    lines = spark.createDataFrame([(chr(c) * n,) for c in range(FIRST, FIRST + CODES) for n in (16, 40) if re.match("[A-Za-z0-9+/_=-]", chr(c))], "string string")
    digest = lambda salt: F.unhex(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    base64 = F.base64(digest("a"))
    mixed = F.translate(base64, "+/=", "")
    made = spark.range(strings).select(
        F.explode(F.array(base64, F.translate(base64, "+/=", "-_"), mixed, F.upper(mixed), F.lower(mixed), F.lower(F.hex(digest("b"))), F.hex(digest("c")))).alias("string")
    )
    return ordinary.unionByName(lines).withColumn("label", F.lit(0)).unionByName(made.withColumn("label", F.lit(1)))


def train(labelled: DataFrame, smooth: float = 0.5, backed: float = 20.0, false: float = 1e-4) -> Model:
    """The models' ratios and threshold. What comes to the driver is a number for each pair of key characters."""
    labelled = spool(labelled, "labelled")
    following = F.zip_with(F.slice("codes", 1, F.size("codes") - 1), F.slice("codes", 2, F.size("codes")), lambda a, b: a * CODES + b)
    pairs = labelled.select("label", codes(F.col("string")).alias("codes")).where("size(codes) > 1").select("label", F.explode(following).alias("pair"))
    seen = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}

    def likely(label: int) -> list[float]:
        first, second = [0] * CODES, [0] * CODES
        for (of, pair), n in seen.items():
            if of == label:
                first[pair // CODES] += n
                second[pair % CODES] += n
        alone = [(n + smooth) / (sum(second) + smooth * CODES) for n in second]
        return [(seen.get((label, a * CODES + b), 0) + backed * alone[b]) / (first[a] + backed) for a in range(CODES) for b in range(CODES)]

    ratios = tuple(round(math.log(p / q), 6) for p, q in zip(likely(1), likely(0), strict=True))
    scored = labelled.where("length(string) >= 16").select("label", score(F.col("string"), ratios).alias("score"))
    ends = {r["label"]: r for r in scored.groupBy("label").agg(F.percentile("score", F.lit(1 - false)).alias("high"), F.percentile("score", F.lit(0.05)).alias("low")).collect()}
    high, low = ends[0]["high"], ends[1]["low"]
    return Model(ratios, high + max(0.0, low - high) / 4)


def located(documents: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, kind, start, end, score of every match of a format, run or part; kind is null where a match fails or there is none."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    # HEX16, RUN and PART leave out short runs, which fail and which no other match of their kind can overlap.
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX16, "random": RUN, "part": PART}
    # first the matches and the lengths between them, so that no expression is evaluated twice
    every = {f"m_{k}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in patterns.items()}
    every |= {f"g_{k}": F.transform(F.split("text", p, -1), F.length) for k, p in patterns.items()}
    rows = rows.select("row", "doc_id", *[c.alias(n) for n, c in every.items()])
    pair = lambda g, m: F.struct(g.alias("gap"), m.alias("match"))
    zipped = [F.struct(F.lit(k).alias("kind"), F.zip_with(F.slice(f"g_{k}", F.lit(1), F.size(f"m_{k}")), f"m_{k}", pair).alias("matches")) for k in patterns]
    rows = rows.select("row", "doc_id", F.explode(F.array(*zipped)).alias("f"))
    rows = rows.select("row", "doc_id", "f.kind", F.posexplode_outer("f.matches").alias("nth", "m")).select("row", "doc_id", "kind", "nth", "m.*")
    fails = ((F.col("kind") == "assign") & (F.length(F.regexp_extract("match", ASSIGN, 2)) < 12)) | ((F.col("kind") == "access") & (F.length("match") < 18))
    scored = F.when(F.col("kind").isin("random", "part"), score(F.col("match"), model.ratios))
    small = rows.select("row", "doc_id", "kind", "nth", "gap", F.length("match").alias("length"), fails.alias("fails"), scored.alias("score"))
    # a document without a match keeps one row: that of the first format
    small = small.where("nth is not null or kind = 'assign'").repartition("row")
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("row", "kind").orderBy("nth"))
    kind = F.when(F.col("nth").isNotNull() & ~F.col("fails"), F.col("kind"))
    return small.select("row", "doc_id", kind.alias("kind"), (end - F.col("length")).alias("start"), end.alias("end"), "score")


def scan(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every document."""
    model = model or train(samples(documents))
    rows = located(documents, model)
    base, run = F.col("kind").isin(*KINDS[:3]), F.col("kind") == "random"
    order = Window.partitionBy("row").orderBy("start")
    so_far, from_here = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, Window.unboundedFollowing)
    # a span overlaps a base span that begins no later and reaches into it, or one that begins inside it
    reached, next_ = F.max(F.when(base, F.col("end"))).over(so_far), F.min(F.when(base, F.col("start"))).over(from_here)
    free = ~(F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(next_ < F.col("end"), F.lit(False)))
    rows = rows.withColumn("picked", ~base & (F.col("score") >= model.bar) & free)
    held = F.coalesce(F.max(F.when(run & F.col("picked"), F.col("end"))).over(so_far) > F.col("start"), F.lit(False))
    more = F.col("picked") & (run | ~held)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.when(base, F.col("kind")).otherwise("random"))
    span = F.struct(F.col("start"), rank.alias("order"), F.col("end"), F.when(base, F.col("kind")).otherwise("random").alias("kind"))
    rows = rows.select("row", "doc_id", "kind", base.alias("base"), F.coalesce(more, F.lit(False)).alias("more"), span.alias("span"))
    per = rows.groupBy("row", "doc_id").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS[:3]],
        F.array_sort(F.collect_list(F.when(F.col("base"), F.col("span")))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("base") | F.col("more"), F.col("span")))).alias("spans"),
    )
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return per.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_random"),
    )
