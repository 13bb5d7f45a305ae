"""URL filters (operator 10): a sorted digest array, memory-mapped and probed by vectorised binary search.

Each rule is a host and a path, kept as one string.  The array holds the rules' 64-bit xxhash keys in order, beside it
their strings; a probe that meets a key is confirmed against the string.  A url is probed with every suffix of its host's
labels and every prefix of its path that has a rule's length.

A list whose array has at most MAX_ARRAY_BYTES goes to every executor whole.  A longer one, or one that is a DataFrame, is split by
ranges of the key instead: probes and rules are dealt by range, and each range's array is probed in its own task.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgrid.llm.common import ship, table

#: A list of rules whose array has more bytes is dealt by ranges of its keys rather than sent to every executor.
MAX_ARRAY_BYTES = 512 << 20
#: Rules of one range of keys, and probes that meet them at once.
RANGE_RULES, RANGE_PROBES = 1_000_000, 1_000_000

_OPEN: dict = {}
_SENT: set = set()


def host_and_path(url: str | None) -> tuple[str, str]:
    """The part after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def array_bytes(rules: list[tuple[str, str, str]]) -> np.ndarray:
    """rules: (verdict, host, path).  The bytes: count, distinct path lengths, sorted keys, string ends, verdicts, strings."""
    import xxhash

    # the last rule given for one host and path holds
    named = {(host, way): verdict == "block" for verdict, host, way in rules}
    names = sorted(named, key=lambda r: (xxhash.xxh64_intdigest((r[0] + r[1]).encode()), r))
    data = [(host + way).encode() for host, way in names]
    lengths = sorted({len(way) for _, way in names})
    parts = [
        np.array([len(names), len(lengths)], "<u8"),
        np.array(lengths, "<u8"),
        np.array([xxhash.xxh64_intdigest(s) for s in data], "<u8"),
        np.cumsum([0, *map(len, data)]).astype("<u8"),
        np.array([len(host) for host, _ in names], "<u8"),
        np.array([named[n] for n in names], "u1"),
    ]
    return np.frombuffer(b"".join([*(p.tobytes() for p in parts), *data]), "u1")


def write_array(rules: list[tuple[str, str, str]], path: str) -> None:
    array_bytes(rules).tofile(path)


class DigestArray:
    """The bytes of array_bytes(), mapped from a file or in memory."""

    def __init__(self, raw: np.ndarray):
        n, k = (int(x) for x in raw[:16].view("<u8"))
        at = 16
        self.lengths = raw[at : (at := at + 8 * k)].view("<u8").astype(int)
        self.keys = raw[at : (at := at + 8 * n)].view("<u8")
        self.ends = raw[at : (at := at + 8 * (n + 1))].view("<u8")
        self.hosts = raw[at : (at := at + 8 * n)].view("<u8")
        self.blocks = raw[at : (at := at + n)]
        self.strings = raw[at:]

    def name(self, i: int) -> str:
        return self.strings[int(self.ends[i]) : int(self.ends[i + 1])].tobytes().decode()

    def find(self, probes: list[str], host_chars: np.ndarray) -> np.ndarray:
        """For each probe the place of the rule with that very string and host, or -1."""
        import xxhash

        found = np.full(len(probes), -1, np.int64)
        if not len(probes) or not len(self.keys):
            return found
        keys = np.fromiter((xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) for p in probes), np.uint64, len(probes))
        first, last = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for i in np.flatnonzero(first < last):
            for j in range(first[i], last[i]):  # more than one only where two rules' keys collide
                if int(self.hosts[j]) == host_chars[i] and self.name(j) == probes[i]:
                    found[i] = j
        return found


def probes_of(host: str, path: str, lengths) -> Iterator[tuple[str, int]]:
    """Every string that a rule which fits can have, and how much of it is the host."""
    if not host and not path:
        return
    for n in lengths:
        if n > len(path):
            break
        tail, dot = host, "."
        while dot:
            yield tail + path[:n], len(tail)
            _, dot, tail = tail.partition(".")


def judge(urls: list[str | None], rules: DigestArray) -> list[tuple[str, str, str | None, str]]:
    parts = [host_and_path(u) for u in urls]
    probes, owner, hosts = [], [], []
    for k, (host, path) in enumerate(parts):
        for probe, chars in probes_of(host, path, rules.lengths):
            probes.append(probe)
            owner.append(k)
            hosts.append(chars)
    found = rules.find(probes, np.array(hosts, np.int64))
    best: dict[int, tuple] = {}
    for i in np.flatnonzero(found >= 0):
        score = (len(probes[i]), hosts[i], int(found[i]))
        best[owner[i]] = max(best.get(owner[i], score), score)
    out = []
    for k, (host, path) in enumerate(parts):
        if k in best:
            j = best[k][2]
            out.append((host, path, rules.name(j), "block" if rules.blocks[j] else "allow"))
        else:
            out.append((host, path, None, "allow"))
    return out


def _sent(spark: SparkSession, rules: list[tuple[str, str, str]], most: int) -> str | None:
    """The array's file name on every executor; None where it has more than `most` bytes."""
    name = f"rules-{hashlib.sha256(repr(rules).encode()).hexdigest()[:24]}.digests"
    if (spark.sparkContext.applicationId, name) not in _SENT:
        folder = tempfile.mkdtemp(prefix="marlgrid")
        atexit.register(shutil.rmtree, folder, True)
        write_array(rules, f"{folder}/{name}")
        if os.path.getsize(f"{folder}/{name}") > most:
            return None
        spark.sparkContext.addFile(f"{folder}/{name}")
        _SENT.add((spark.sparkContext.applicationId, name))
    return name


RULES = "verdict string, host string, path string"


def _in_ranges(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, host, path, rule, verdict) of urls (id, url) by ranges of the rules' keys; the last rule of one host and path can't be told here, so a block wins."""
    rules = rules.select(F.coalesce("verdict", F.lit("")).alias("verdict"), F.coalesce("host", F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"))
    # one row for each length of a rule's path
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    count = rules.count()
    ranges = max(1, -(-count // RANGE_RULES))

    def keyed(batches):
        import xxhash

        for batch in batches:
            names = [h + w for h, w in zip(batch.column("r_host").to_pylist(), batch.column("r_path").to_pylist(), strict=True)]
            keys = [xxhash.xxh64_intdigest(n.encode()) * ranges >> 64 for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(batch.column(c) for c in ("verdict", "r_host", "r_path"))], ["part", "verdict", "r_host", "r_path"])

    def probed(batches):
        import xxhash

        for batch in batches:
            out = ([], [], [], [])
            for row, url in zip(batch.column("row").to_pylist(), batch.column("url").to_pylist(), strict=True):
                for probe, chars in probes_of(*host_and_path(url), lengths):
                    for c, v in zip(out, (xxhash.xxh64_intdigest(probe.encode("utf-8", "surrogatepass")) * ranges >> 64, row, probe, chars), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["part", "row", "probe", "chars"])

    rows = table(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    probes = table(rows.select("row", "url").mapInArrow(probed, "part long, row long, probe string, chars long"), "url-probes")
    # a range that many urls meet is dealt to several tasks, each with that range's rules
    blocks = table(probes.groupBy("part").agg(F.ceil(F.count("*") / RANGE_PROBES).cast("int").alias("blocks")), "probe-blocks", tidy=False)
    left = probes.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("row", "probe"), "blocks").cast("int")).drop("blocks")
    right = rules.mapInArrow(keyed, "part long, " + "verdict string, r_host string, r_path string").join(blocks, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def meet(_, p: pa.Table, r: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if len(p) and len(r):
            array = DigestArray(array_bytes(sorted(zip(*(r.column(c).to_pylist() for c in ("verdict", "r_host", "r_path")), strict=True))))
            probe, chars, row = p.column("probe").to_pylist(), np.array(p.column("chars"), np.int64), p.column("row").to_pylist()
            found = array.find(probe, chars)
            for i in np.flatnonzero(found >= 0).tolist():
                for c, v in zip(out, (row[i], int(chars[i]), probe[i], "block" if array.blocks[found[i]] else "allow"), strict=True):
                    c.append(v)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["hit_row", "chars", "rule", "verdict"])

    hits = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, "hit_row long, chars long, rule string, verdict string")
    best = hits.groupBy("hit_row").agg(F.max(F.struct(F.length("rule").alias("n"), "chars", "verdict", "rule")).alias("best"))

    def split(batches):
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column("url").to_pylist()]
            cols = list(zip(*parts, strict=True)) if parts else [(), ()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), *(pa.array(c, pa.string()) for c in cols)], ["id", "row", "host", "path"])

    told = rows.select("id", "row", "url").mapInArrow(split, "id long, row long, host string, path string")
    return told.join(best, F.col("row") == F.col("hit_row"), "left").select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", most: int = MAX_ARRAY_BYTES) -> DataFrame:
    """id, host, path, rule (null if none fits) and verdict; the longest rule wins, and a url that no rule fits is allowed.

    rules: (verdict, host, path), as a list or a DataFrame of RULES.  Of rules with one host and path the last of a list
    holds; a DataFrame has no order, so there a block does.  A null url, or one without `://`, has empty host and path and is allowed.  Rows come back as
    often as they stand; null ids stay; an empty table gives an empty one; other columns are dropped, whatever their names.  A url is probed whole, however long: with one probe for each label of its
    host and each distinct length of a rule's path.
    """
    spark = pages.sparkSession
    ship(spark)
    urls = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    name = _sent(spark, rules, most) if isinstance(rules, list) else None
    if name is None:
        listed = list({(h, w): (v, h, w) for v, h, w in rules}.values()) if isinstance(rules, list) else None
        return _in_ranges(urls, rules if listed is None else spark.createDataFrame(listed, RULES)).withColumnRenamed("id", id_col)

    def run(batches):
        if name not in _OPEN:
            _OPEN[name] = DigestArray(np.memmap(SparkFiles.get(name), "u1", "r"))
        for batch in batches:
            done = judge(batch.column(1).to_pylist(), _OPEN[name])
            cols = list(zip(*done, strict=True)) if done else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], ["id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
