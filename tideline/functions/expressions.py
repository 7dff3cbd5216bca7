"""Scalar expressions over prices, probabilities, lines, names, dates and arrays.

All take and return Columns. Missing or unusable inputs give null unless a default is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000

#: The upper ends of open price buckets and their labels; the edges of price bands.
PRICE_BUCKETS = ((1.75, "1.01-1.75"), (2.0, "1.75-2.00"), (2.5, "2.00-2.50"), (3.0, "2.50-3.00"))
PRICE_LAST = "3.00+"
PRICE_EDGES = (1.01, 5.0, 10.0, 20.0, 50.0, 1001.0)

#: Tokens that say nothing about a team; accented letters and what they fold to.
TEAM_NOISE = ("fc", "cf", "afc", "sc", "ac", "club")
ACCENTED, FOLDED = "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc"


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def day_number(ts: str) -> Column:
    return F.floor(micros(ts) / F.lit(DAY)).cast("long")


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def number(*names: str, default: float | None = None) -> Column:
    """The first of several text columns that reads as a number."""
    return F.coalesce(*[F.expr(f"try_cast({n} as double)") for n in names], F.lit(default))


def cleaned_number(text: str) -> Column:
    """A number written with thousands commas or a plus sign; '-' and blanks are null."""
    return F.expr(f"try_cast(nullif(trim(translate({text}, ',+', '')), '-') as double)")


def team_key(name: Column) -> Column:
    """A name folded to plain lower-case words without those that say nothing."""
    plain = F.translate(F.lower(name), ACCENTED, FOLDED)
    words = F.split(F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*TEAM_NOISE)), " ")


def price_bucket(odds: Column) -> Column:
    out = None
    for end, label in PRICE_BUCKETS:
        out = F.when(odds < end, label) if out is None else out.when(odds < end, label)
    return F.when(odds.isNotNull(), out.otherwise(PRICE_LAST))


def price_band(odds: Column) -> Column:
    """The number of the left-closed band that holds the price, from 0; null outside all bands."""
    out = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(PRICE_EDGES, PRICE_EDGES[1:], strict=False)):
        out = F.when((odds >= low) & (odds < high), F.lit(i)).otherwise(out)
    return out


def usable_pair(over: Column, under: Column) -> Column:
    """Both prices within 1 and 1000 and no arbitrage between them."""
    ok = (over > 1) & (over <= 1000) & (under > 1) & (under <= 1000)
    return F.coalesce(ok & (1 / over + 1 / under >= 1 - 1e-9), F.lit(False))


def shares(*odds: Column) -> list[Column]:
    """The reciprocals as shares of their sum, whatever the prices."""
    total = sum((1 / o for o in odds[1:]), 1 / odds[0])
    return [(1 / o) / total for o in odds]


def fair(*odds: Column) -> list[Column]:
    """Probabilities without the margin, in proportion to the reciprocals; null unless all prices exceed 1."""
    ok = odds[0] > 1
    for o in odds[1:]:
        ok = ok & (o > 1)
    return [F.when(ok, p) for p in shares(*odds)]


def expected_value(p: Column, odds: Column) -> Column:
    return p * odds - 1


def minimum_odds(p: Column, edge: float = 0.05) -> Column:
    return F.when(p > 0, (1 + edge) / p).otherwise(F.lit(float("inf")))


def stake(p: Column, odds: Column, part: float = 0.25, most: float = 0.05) -> Column:
    """A part of the stake that maximises growth, never over `most`."""
    return clip(part * (p * odds - 1) / (odds - 1), 0.0, most)


def components(line: Column) -> Column:
    """A quarter line as the two lines it is made of; any other as itself."""
    quarter = F.pmod(line, F.lit(1.0))
    return (
        F.when(F.abs(quarter - 0.25) < 1e-9, F.array(line - 0.25, line + 0.25))
        .when(F.abs(quarter - 0.75) < 1e-9, F.array(line - 0.25, line + 0.25))
        .otherwise(F.array(line))
    )


def settled(line: Column, total: Column, over: bool = True) -> Column:
    """1 won, 0 returned, -1 lost; quarter lines average their components."""
    sign = 1 if over else -1
    parts = F.transform(components(line), lambda c: F.signum(total - c) * sign)
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)


def profit(line: Column, total: Column, odds: Column, amount: Column, over: bool = True) -> Column:
    """What an amount on a line earns: each component wins at the price, is returned, or is lost."""
    sign = 1 if over else -1
    parts = F.transform(components(line), lambda c: F.signum(total - c) * sign)
    gains = F.transform(parts, lambda s: F.when(s > 0, odds - 1).when(s < 0, -1.0).otherwise(0.0))
    return amount * F.aggregate(gains, F.lit(0.0), lambda a, x: a + x) / F.size(parts)


def poisson_masses(mean: Column, last: int = 30) -> Column:
    """The masses of 0 .. last, the last of which holds the tail."""
    first = F.exp(-F.greatest(mean, F.lit(1e-9)))
    body = F.aggregate(
        F.sequence(F.lit(1), F.lit(last - 1)),
        F.array(first),
        lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * mean / k)),
    )
    return F.concat(body, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(body, F.lit(0.0), lambda a, x: a + x))))


def over_mass(masses: Column, line: Column) -> Column:
    """The mass above a line."""
    start = F.floor(line).cast("int") + 2
    tail = F.slice(masses, F.least(start, F.size(masses) + 1), F.size(masses))
    return F.aggregate(tail, F.lit(0.0), lambda a, x: a + x)


def negative_binomial_masses(mean: Column, dispersion: Column, last: int = 30) -> Column:
    """As poisson_masses, with variance mean + dispersion * mean^2."""
    size = 1 / F.greatest(dispersion, F.lit(1e-3))
    p = size / (size + mean)
    body = F.aggregate(
        F.sequence(F.lit(1), F.lit(last - 1)),
        F.array(F.pow(p, size)),
        lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * (k - 1 + size) / k * (1 - p))),
    )
    return F.concat(body, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(body, F.lit(0.0), lambda a, x: a + x))))


def falling(values: Column) -> Column:
    """The running minimum of an array."""
    none = F.array().cast("array<double>")
    return F.aggregate(values, none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, F.least(F.element_at(F.concat(acc, F.array(x)), F.size(acc)), x)).otherwise(x))))


def choose(n: int, k: Column) -> Column:
    """Binomial coefficients of a fixed n, exact; 0 outside 0 .. n."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), k))
    value = F.aggregate(steps, F.lit(1).cast("decimal(38,0)"), lambda acc, i: (acc * (n + 1 - i) / i).cast("decimal(38,0)"))
    return F.when((k < 0) | (k > n), F.lit(0)).when(k == 0, F.lit(1)).otherwise(value).cast("long")


def decayed(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life)


def season(year: Column, month: Column, start: int) -> Column:
    """YYYY/ZZ of the season that holds a month."""
    first = F.when(month >= start, year).otherwise(year - 1)
    return F.concat(first.cast("string"), F.lit("/"), F.lpad(((first + 1) % 100).cast("string"), 2, "0"))


def cycle(month: Column) -> tuple[Column, Column]:
    angle = 2 * math.pi * (month - 1) / 12
    return F.sin(angle), F.cos(angle)


def form_score(form: Column, field: int = 12) -> Column:
    """The mean over all places named in a form text of 1 for the first down to 0 for the last of a field."""
    places = F.regexp_extract_all(form, F.lit("[0-9]+"), F.lit(0))
    scores = F.transform(places, lambda p: F.greatest(F.lit(0.0), 1 - (p.cast("int") - 1) / (field - 1)))
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))


def seconds(text: Column) -> Column:
    """The first m.ss.cc (or with colons) in a text; else its first number, if that is under 300."""
    clock = r"(\d{1,2})[.:](\d{2})[.:](\d{2})"
    part = lambda i: F.regexp_extract(text, clock, i).cast("double")
    plain = F.nullif(F.regexp_extract(text, r"\d+\.?\d*", 0), F.lit("")).cast("double")
    return F.when(F.regexp_like(text, F.lit(clock)), part(1) * 60 + part(2) + part(3) / 100).otherwise(F.when(plain < 300, plain))


def fnv1a(text: Column, mask: int = 0xFFFFFFFF) -> Column:
    """FNV-1a over the characters of an ASCII text."""
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(chars, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(mask)))


def compact(x: Column) -> Column:
    """A number as text: without decimals if it has none, else with five."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(F.format_string("%.5f", x))


def dot(a: Column, b: Column) -> Column:
    """The inner product over the common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def longest_run(numbers: Column) -> Column:
    """The longest run of consecutive integers in a sorted array."""
    state = F.struct(F.lit(-1000).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        now = F.when(x == s["last"] + 1, s["now"] + 1).otherwise(1)
        return F.struct(x.cast("int").alias("last"), now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(numbers, state, step, lambda s: s["best"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
