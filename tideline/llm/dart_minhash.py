"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

A document is the weighted set of its five-word shingles, the weight a shingle's number of
occurrences; a shingle of weight w has the unit regions 0 .. w-1. Every region throws darts: their
ranks are the arrivals of a unit Poisson process drawn from the region's hash, each with a hashed
coordinate. Only darts of rank below about k (ln k + 2) / weight are thrown, which costs time in
proportion to the document and to k, not to their product; the earliest dart of each coordinate is
the signature, and two documents agree in a coordinate with probability their weighted Jaccard
similarity. A document with an empty coordinate throws again, twice as far.

Documents with the same words are one node. Nodes whose signatures agree in a band of coordinates
share a bucket. Classes grow in three turns. In the first two, every class sends one representative, another
one a turn, to each bucket that it shares with others; there it is verified, by the exact weighted
Jaccard similarity of the shingles (their 64-bit hashes), against the bucket's pivots of other classes:
one in the first turn, where classes are single nodes and the node of the smallest hash is the pivot,
which many buckets of a group share; about 4 drawn nodes in the second. Links become larger classes by
alternating large and small stars. This joins nearly all of a large group at little cost. The third turn
is exact: in buckets that still hold several classes it looks at all pairs of different ones. A node has a sketch there,
as many bits as it has regions or up to twice as many, each the parity of the regions that fall on it. Every region that
only one of two nodes has turns one bit at most, so the bits that differ are a lower bound of those regions, and a
pair whose bound is beyond what the similarity allows is no link; the others are verified as before. Large buckets are
dealt out by pairs of their chunks, so no task sees more than two chunks. So the classes are the components of all links
between nodes that share a bucket: none is left out. The last turn is quadratic in what remains unlinked of a bucket.

Regions take more room than the texts. They are written for nodes that share a bucket only, from a second reading of the
documents, which finds a node's text by its id and MD5. Joins with what grows with the documents shuffle at every size.

Defined cases: words are runs of non-space characters, lower-cased; a text of one to four words is
one shingle; a null, empty or blank text is a class of its own; rows that repeat an id or a text
fall in one class; class_id is the smallest doc_id of the class (null if it has none); is_kept marks
exactly one row of a class, the one of the smallest doc_id; an empty table gives an empty result.
Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_rows, small, spool, unlink

#: Words of a shingle; similarity of a link; bands and coordinates of each (of pairs at 0.8, 0.997 meet, at 0.85 all but 1 in 20,000).
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 32, 8

#: Pivots of a bucket in each turn before the exact one.
PIVOTS = (1, 4)

#: Nodes of a bucket's chunk; words of sketches that are compared at a time.
CHUNK, AT_ONCE = 1024, 1 << 19

#: Bytes of text that are signed at a time; words whose hashes a task remembers; rows with texts or regions that come to Python at a time.
STEP_BYTES, KNOWN, ROWS_AT_ONCE = 1 << 19, 100_000, 500

SIGNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("md5", pa.string()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
SIGNED_DDL = "row long, doc_id long, md5 string, digest binary, bands array<long>"

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of words, remembered up to a bounded number."""

    def __init__(self, most: int = KNOWN):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if new := list({w for w in words if w not in known}):
            if len(known) + len(new) > self.most:
                known.clear()
                new = list(set(words))
            known.update(zip(new, pd.util.hash_array(np.array(new, dtype=object), categorize=False).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def regions(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit regions of documents whose word hashes follow one another: document, hash; by document."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(len(hashes)) - first[doc]
    n = counts[doc]
    starts = np.flatnonzero((place == 0) | (place <= n - SHINGLE))
    h = mix(hashes[starts])
    for j in range(1, SHINGLE):
        inside = place[starts] + j < n[starts]
        at = np.minimum(starts + j, len(hashes) - 1)
        h = np.where(inside, mix(h + _A) + hashes[at], h)
    h, doc = mix(h), doc[starts]
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return doc, mix(h + nth.astype(np.uint64) * _A)


def signatures(doc: np.ndarray, region: np.ndarray, n_docs: int, k: int = BANDS * ROWS) -> np.ndarray:
    """n_docs x k: the earliest dart of every coordinate; 0 throughout for documents without regions."""
    out = np.zeros((n_docs, k), dtype=np.uint64)
    weight = np.bincount(doc, minlength=n_docs)
    reach = k * (math.log(k) + 2) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        mine = todo[doc]
        d, e = doc[mine], region[mine]
        rank, ranks, keys, darts, thrown, more = np.zeros(len(d)), [], [], [], 0, 1
        while len(d):  # one throw of every region, then one, two, four, ... of those that still reach
            salts = np.array([t * int(_C) % (1 << 64) for t in range(thrown + 1, thrown + more + 1)], dtype=np.uint64)
            x = mix(e[:, None] ^ salts)
            arrival = rank[:, None] + np.cumsum(-np.log1p(-((x >> np.uint64(11)).astype(np.float64) * 2.0**-53)), axis=1)
            near = arrival < reach[d][:, None]
            dart = mix(x[near] + _A)
            ranks.append(arrival[near])
            darts.append(dart)
            keys.append(np.repeat(d, near.sum(axis=1)) * k + (dart >> np.uint64(32)).astype(np.int64) * k // (1 << 32))
            d, e, rank = d[near[:, -1]], e[near[:, -1]], arrival[near[:, -1], -1]
            thrown, more = thrown + more, thrown + more
        rank, dart, key = np.concatenate(ranks), np.concatenate(darts), np.concatenate(keys)
        best = np.full(n_docs * k, np.inf)
        np.minimum.at(best, key, rank)
        earliest = rank == best[key]
        got = np.zeros(n_docs * k, dtype=np.uint64)
        got[key[earliest]] = dart[earliest]
        whole = todo & np.isfinite(best.reshape(n_docs, k)).all(axis=1)
        out[whole] = got.reshape(n_docs, k)[whole]
        todo &= ~whole
        reach = reach * 2
    return out


def banded(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A key for each band of a signature."""
    n, k = signature.shape
    rows = signature.reshape(n, bands, k // bands)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for j in range(rows.shape[2]):
        key = mix(key * _A + rows[:, :, j])
    return key.astype(np.int64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], np.ndarray, np.ndarray]]:
    """Slices of the batches with their texts' words and regions: document, hash."""
    hashed = Words()
    for whole in batches:
        # few documents at a time: the darts of one are some thousand, or as many as its words
        sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False) + STEP_BYTES // 128)
        edges = [*np.unique(np.searchsorted(sizes, np.arange(0, sizes[-1], STEP_BYTES), side="left")), len(whole)] if len(whole) else []
        for start, stop in zip(edges, edges[1:], strict=False):
            batch = whole.slice(start, stop - start)
            texts = [(t or "").lower().encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
            counts = np.array([len(t) for t in texts], dtype=np.int64)
            yield batch, texts, *regions(hashed([w for t in texts for w in t]), counts)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts, doc, region in _read(batches):
        keys = banded(signatures(doc, region, len(texts)))
        digests = [hashlib.blake2b(b" ".join(t), digest_size=16).digest() if t else None for t in texts]
        lists = [k.tolist() if t else None for k, t in zip(keys, texts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("md5"), pa.array(digests, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], schema=SIGNED)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts, doc, region in _read(batches):
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        blobs = [np.unique(region[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(blobs, pa.binary())], ["node", "regions"])


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        j = []
        for a, b in zip(batch.column("left"), batch.column("right"), strict=True):
            a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (a, b))
            both = len(np.intersect1d(a, b, assume_unique=True))
            j.append(both / (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(j, pa.float64())], ["x", "y", "j"])


def sketch(region: np.ndarray) -> np.ndarray:
    """The parities of regions by their last bits, as words: as many bits as regions, or up to twice as many, 64 at least."""
    bits = 1 << max(6, (len(region) - 1).bit_length())
    odd = np.bincount((region & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column("regions")]
        columns = [batch.column("node"), batch.column("regions"), pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x).tobytes() for x in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "regions", "n", "sketch"])


def possible(root: np.ndarray, n: np.ndarray, sketches: list[np.ndarray], similar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i, j of all pairs of different roots that sizes and sketches let be similar; n: the regions' number."""
    words, off = np.array([len(x) for x in sketches]), (1 - similar) / (1 + similar)
    for size in np.unique(words).tolist():
        mine, wider = np.flatnonzero(words == size), np.flatnonzero(words == 2 * size)
        rest = np.concatenate([mine, wider])
        right = np.stack([sketches[j] if words[j] == size else sketches[j][:size] ^ sketches[j][size:] for j in rest])
        step = max(1, AT_ONCE // (len(rest) * size))
        for low in range(0, len(mine), step):
            some = mine[low : low + step]
            both = n[some][:, None] + n[rest][None]
            near = (root[some][:, None] != root[rest][None]) & (np.minimum(n[some][:, None], n[rest][None]) * (1 + 1e-9) >= similar * np.maximum(n[some][:, None], n[rest][None]))
            near[:, : len(mine)] &= np.arange(len(mine))[None] > np.arange(low, low + len(some))[:, None]
            i, j = np.nonzero(near)
            for part in range(0, len(i), step * len(rest)):
                a, b = i[part : part + step * len(rest)], j[part : part + step * len(rest)]
                differ = np.bitwise_count(right[low + a] ^ right[b]).sum(axis=1, dtype=np.int64)
                held = differ <= both[a, b] * off * (1 + 1e-9)
                yield some[a[held]], rest[b[held]]


def _rest(similar: float):
    """From rows part, node, root, n, sketch, which lie together by part, to the pairs a, b of a part that may be links, and their roots x, y."""

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        part, node, root, n = (rows.column(c).to_numpy() for c in ("part", "node", "root", "n"))
        sketches = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for chunk in rows.column("sketch").chunks for x in chunk]
        edges = [*np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part)]
        for start, stop in zip(edges, edges[1:], strict=False):
            for i, j in possible(root[start:stop], n[start:stop], sketches[start:stop], similar):
                i, j = i + start, j + start
                i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[j], root[i], root[j])], ["a", "b", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last part so far, which the next batch may go on with
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            if not len(rows):
                continue
            part = rows.column("part").to_numpy()
            last = int(np.searchsorted(part, part[-1]))
            yield from pairs(rows.slice(0, last)) if last else ()
            held = rows.slice(last)
        if held is not None:
            yield from pairs(held)

    return run


def remaining(members: DataFrame, sketched: DataFrame, similar: float) -> DataFrame:
    """a, b, x, y: all pairs of nodes of different classes that share a bucket, but those whose sketches rule a link out. members: key, node, root; sketched: node, n, sketch."""
    chunks = members.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("m"))
    mine = F.pmod(F.xxhash64("node"), F.col("m"))
    others = F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda d: (F.col("m") == 1) | (d != mine))
    part = F.transform(others, lambda d: F.xxhash64("key", F.least(mine, d), F.greatest(mine, d)))
    dealt = members.join(chunks, "key").select("node", "root", F.explode(part).alias("part")).join(sketched, "node")
    dealt = dealt.select("part", "node", "root", "n", "sketch").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(_rest(similar), "a long, b long, x long, y long").distinct()


def verify(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """x, y, j: the exact similarity of the nodes a, b of each pair, with the classes x, y that the pair has. arrays: node, regions."""
    joined = pairs.join(arrays.select(F.col("node").alias("a"), F.col("regions").alias("left")), "a")
    joined = joined.join(arrays.select(F.col("node").alias("b"), F.col("regions").alias("right")), "b")
    return joined.select("x", "y", "left", "right").mapInArrow(_similarity, "x long, y long, j double")


def asked(members: DataFrame, turn: int, pivots: int) -> DataFrame:
    """a, b, x, y: the pairs of nodes of different classes that a turn compares. members: key, node, root."""
    drawn = lambda *salt: F.pmod(F.xxhash64("node", *salt), F.lit(1 << 52))
    mine = members.withColumn("turn", drawn("key", F.lit(turn)) if turn else drawn())  # at first buckets of a group share their pivot
    sizes = mine.groupBy("key").agg(F.min("turn").alias("first"), F.count("*").alias("n"))
    chosen = mine.join(sizes, "key").where((F.col("turn") == F.col("first")) | (F.col("turn") < (pivots - 1) * float(1 << 52) / F.col("n")))
    chosen = chosen.select("key", F.col("node").alias("b"), F.col("root").alias("y"))
    one = members if not turn else members.groupBy("key", "root").agg(F.min_by("node", F.xxhash64("node", "key", F.lit(-turn))).alias("node"))
    met = one.select("key", F.col("node").alias("a"), F.col("root").alias("x")).join(chosen, "key").where("x <> y")
    swap = F.col("a") < F.col("b")
    ordered = [F.when(swap, F.col(p)).otherwise(F.col(q)).alias(p) for p, q in ("ab", "ba", "xy", "yx")]
    return met.select(*ordered).distinct()


def shared(keyed: DataFrame) -> DataFrame:
    """key, node: the buckets that several nodes share."""
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return spool(keyed.join(several, "key", "left_semi"), "buckets")


def linked(keyed: DataFrame, arrays: DataFrame, similar: float = SIMILAR, pivots: tuple[int, ...] = PIVOTS) -> DataFrame:
    """node, root of every node that shares a bucket; root names its class: the component of all links. keyed: key, node; arrays: node, regions."""
    members = shared(keyed)
    return grown(members, arrays.join(members.select("node").distinct(), "node", "left_semi"), similar, pivots)


def grown(members: DataFrame, arrays: DataFrame, similar: float = SIMILAR, pivots: tuple[int, ...] = PIVOTS) -> DataFrame:
    """As linked; members: key, node of shared buckets, spooled; arrays: node, regions of these nodes, a row each."""
    spark = members.sparkSession
    roots = spool(members.select("node").distinct().withColumn("root", F.col("node")), "roots")
    with few_rows(spark, ROWS_AT_ONCE):
        held = spool(arrays.select("node", "regions").mapInArrow(_sketches, "node long, regions binary, n long, sketch binary"), "held")
    if held.count() != roots.count():
        raise ValueError("not one row of regions for each node: the documents changed between two readings")
    for turn, most in enumerate([*pivots, None]):
        named = members.join(roots, "node")
        mixed = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        open_ = spool(named.join(mixed, "key", "left_semi").select("key", "node", "root"), "open")
        with few_rows(spark, ROWS_AT_ONCE):
            pairs = spool(asked(open_, turn, most) if most else remaining(open_, held, similar), "asked")
            links = spool(verify(pairs, held).where(F.col("j") >= similar).select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
        joined = stars(links)
        now = spool(roots.join(joined.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        for done in (members, roots, pairs, links):
            unlink(spark, done)
        members, roots = open_.select("key", "node"), now
    unlink(spark, held)
    unlink(spark, open_)
    return roots


def stars(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component; nodes without links are left out."""
    edges = spool(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, large = edges, spool(large.distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a")
        edges = star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = spool(edges.distinct(), "edges")
        for done in (old, large):
            unlink(edges.sparkSession, done)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now


def id_and_text(md5: Column | str, doc_id: Column | str) -> Column:
    """What tells a row by its id, null or not, and its text."""
    return F.concat_ws(" ", md5, doc_id)


def arrays(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, regions of the wanted nodes, each of one row of the documents. wanted: node, name."""
    rows = documents.select(id_and_text(F.md5("text"), F.col("doc_id").cast("long")).alias("name"), "text")
    found = rows.join(wanted.hint("shuffle_hash"), "name").dropDuplicates(["name"])
    return found.select("node", "text").mapInArrow(_regions, "node long, regions binary")


def classes(documents: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """row, doc_id, md5, class_id, class_size, is_kept of every document; md5 is that of its text."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.md5("text").alias("md5"), "text")
    with few_rows(documents.sparkSession, ROWS_AT_ONCE):
        signed = spool(rows.mapInArrow(_sign, SIGNED_DDL), "signed")
    # one node for each sequence of words: the smallest row that has it
    named = signed.where("digest is not null")
    first = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col("row"))
    top = F.struct(F.col("row").alias("node"), id_and_text("md5", "doc_id").alias("name"))
    texts = named.groupBy("digest").agg(F.min(top).alias("top"), F.count("*").alias("n"), F.min(first).alias("first"))
    texts = spool(texts.select("digest", "top.node", "top.name", "n", "first"), "texts")
    bands = named.select(F.col("row").alias("node"), "bands").join(texts.select("node").hint("shuffle_hash"), "node", "left_semi")
    keyed = bands.select(F.explode("bands").alias("key"), "node")
    members = shared(keyed)
    wanted = texts.join(members.select("node").distinct(), "node", "left_semi").select("node", "name")
    roots = grown(members, arrays(documents, wanted), similar)
    rooted = texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = rooted.groupBy("root").agg(F.sum("n").alias("class_size"), F.min("first").alias("kept"))
    known = spool(rooted.select("digest", "root").join(groups, "root").select("digest", "class_size", "kept"), "known")
    out = signed.select("row", "doc_id", "md5", "digest").join(known, "digest", "left")
    alone = F.col("class_size").isNull()
    return out.select(
        "row", "doc_id", "md5",
        F.when(alone, F.col("doc_id")).otherwise(F.nullif(F.col("kept.id"), F.lit((1 << 63) - 1))).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (alone | (F.col("row") == F.col("kept.row"))).alias("is_kept"),
    )


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, is_kept of every document."""
    return classes(documents).drop("row", "md5")


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents, one of each class: that of the smallest doc_id.

    Rows are told apart by id and text, not by their place in a scan, which a second reading may
    change; of rows that agree in both and are kept, one stays, whichever its other columns.
    """
    md5 = "md5"
    while md5 in documents.columns:
        md5 += "_"
    named = classes(documents).where("class_size > 1").groupBy("doc_id", "md5").agg(F.max("is_kept").alias("is_kept"), F.count("*").alias("n"))
    seen = spool(named.where("not is_kept or n > 1"), "seen")
    mine = documents.withColumn(md5, F.md5("text"))

    def having(rows: DataFrame, how: str) -> DataFrame:
        rows = F.broadcast(rows) if small(rows) else rows
        return mine.join(rows, mine["doc_id"].cast("long").eqNullSafe(rows["doc_id"]) & (mine[md5] == rows["md5"]), how)

    once, again = having(seen, "left_anti"), seen.where("is_kept")
    if not again.isEmpty():
        once = once.unionByName(having(again, "left_semi").dropDuplicates(["doc_id", md5]))
    return once.drop(md5)
