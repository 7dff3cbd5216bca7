"""Small documents in a folder that driver and executors share: training that goes on where it stopped, and models that are activated.

Everything goes through Hadoop's file systems, so the folder may lie in any store that Spark reaches. A document
is written beside its place and moved there at once: a reader sees the old or the new one, never a part.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .writers import checksums


def shared(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one (spark.checkpoint.dir); where that is unset, one process alone gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tideline-")
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    """Documents by name in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def write(self, name: str, document: dict) -> None:
        place, beside = self._path(name), self._path(f".{name.replace('/', '-')}-{uuid.uuid4().hex}")
        self.fs.mkdirs(place.getParent())
        out = self.fs.create(beside, True)
        try:
            out.write(bytearray(json.dumps(document, sort_keys=True, allow_nan=False).encode()))
        finally:
            out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.fs.makeQualified(beside), self.fs.makeQualified(place), how)

    def read(self, name: str) -> dict | None:
        """The document, or None where there is none; ValueError where it is broken."""
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            text = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        return json.loads(text)

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)


def fingerprint(rows: DataFrame) -> str:
    """What a table holds, whatever the order of its rows: the head of a hash."""
    r = checksums(rows, []).first()
    return hashlib.sha256(f"{sorted(rows.columns)}:{r['n']}:{r['checksum']}".encode()).hexdigest()[:16]


def resumed(store: Store, data: str, start: Callable[[], dict], step: Callable[[dict], dict], epochs: int, every: int = 5, restart: bool = False, name: str = "checkpoint.json") -> dict:
    """The state after so many steps. It is kept every few steps; a later call goes on from there if it is about the same data.

    data: the fingerprint of what is trained on. A broken or foreign checkpoint counts as none.
    """
    try:
        kept = None if restart else store.read(name)
    except ValueError:
        kept = None
    epoch, state = (kept["epoch"], kept["state"]) if kept and kept.get("data") == data and kept.get("epoch", epochs + 1) <= epochs else (0, start())
    while epoch < epochs:
        state, epoch = step(state), epoch + 1
        if epoch % every == 0 or epoch == epochs:
            store.write(name, {"data": data, "epoch": epoch, "state": state})
    return state


def numbers(x: Any) -> list[float]:
    """All numbers of a document."""
    if isinstance(x, dict):
        return [n for v in x.values() for n in numbers(v)]
    if isinstance(x, list):
        return [n for v in x for n in numbers(v)]
    return [float(x)] if isinstance(x, (int, float)) and not isinstance(x, bool) else []


def activate(store: Store, model: dict, data: str, now: str, check: Callable[[dict], bool] = lambda m: True) -> str:
    """Makes a model the active one and returns its version, the head of its hash.

    Refused, with the active one left as it is: numbers that are not finite, a model that check turns down, and one that
    was trained on data (a fingerprint) other than what there is now. The version is written first and read again; only
    then does the pointer move.
    """
    if not all(map(math.isfinite, numbers(model))):
        raise ValueError("the model holds numbers that are not finite")
    if not check(model):
        raise ValueError("the model does not pass its check")
    if data != now:
        raise ValueError("the data have changed since the model was trained")
    version = hashlib.sha256(json.dumps(model, sort_keys=True).encode()).hexdigest()[:16]
    place = f"versions/{version}.json"
    store.write(place, {"version": version, "data": data, "model": model})
    if store.read(place) != {"version": version, "data": data, "model": json.loads(json.dumps(model))}:
        raise ValueError("the model did not come back as it was written")
    store.write("active.json", {"version": version})
    return version


def active(store: Store) -> dict | None:
    """The active model: {version, data, model}; None before any. ValueError where what it points to is not what was written."""
    pointer = store.read("active.json")
    if pointer is None:
        return None
    found = store.read(f"versions/{pointer['version']}.json")
    if found is None or hashlib.sha256(json.dumps(found["model"], sort_keys=True).encode()).hexdigest()[:16] != pointer["version"]:
        raise ValueError(f"version {pointer['version']} is broken")
    return found


def seeds(rows: DataFrame, file: list[str], order: list[str], columns: list[str], places: int = 5, digits: int = 16) -> DataFrame:
    """file, n, payload, version: the rows of each file as one JSON array of arrays in the order of columns, and the head of its hash.

    Whole numbers stay whole, others are rounded. A file's rows meet in one value, as its payload does.
    """
    kinds = dict(rows.dtypes)
    json_ = lambda c: F.to_json(F.array(F.col(c).cast("string")))
    quoted = lambda c: json_(c).substr(F.lit(2), F.length(json_(c)) - 2)
    fixed = lambda c: F.regexp_replace(F.round(c, places).cast(f"decimal(30,{places})").cast("string"), "0+$", "")
    decimal = lambda c: F.when(fixed(c).endswith("."), F.concat(fixed(c), F.lit("0"))).otherwise(fixed(c))
    cell = lambda c: F.when(F.col(c).isNull(), "null").otherwise(
        quoted(c) if kinds[c] in ("string", "date") else decimal(c) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    )
    line = F.concat(F.lit("["), F.concat_ws(",", *[cell(c) for c in columns]), F.lit("]"))
    g = rows.groupBy(*file).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda r: r["line"]), ",").alias("p"))
    payload = F.concat(F.lit("["), "p", F.lit("]"))
    return g.select(*file, "n", payload.alias("payload"), F.substring(F.sha2(payload, 256), 1, digits).alias("version"))
