"""MinHash near-dedup (operator 2): order MinHash over five-word k-mers, verified by banded alignment.

Sketch.  Words are runs of letters, digits and underscores, lower-cased, and single letters in scripts that put no spaces between words; a k-mer is five words in a row, labelled with the
number of times it stood before in the text.  In each of `repeats` independent orders the `picks` smallest labelled k-mers are
taken and kept in text order, so a sketch agrees only where the same k-mers stand in the same order.  Texts that agree in a
repeat share a bucket.

Verification.  The k-mer sequences of two texts are aligned (longest common subsequence) inside the band beyond which no
alignment reaches the threshold.  similarity = aligned / (n1 + n2 - aligned); pairs of at least `threshold` are linked.

Short texts.  Few k-mers leave few chances to agree, so texts of 4 to 9 k-mers share further buckets: those of their whole
k-mer sequence and of that sequence with one k-mer left out.  Every pair of them that differs by one k-mer on either side meets.

Hot buckets.  Copies (the same words) become one member first.  Each member is then verified against the smallest member of
its buckets, next against those of all its buckets whose class is another.  Buckets that still hold several classes are
worked through in blocks: a block counts the k-mers that its members share and aligns only pairs that can reach the threshold
and whose classes are still apart.  A bucket of more than one block is split by length first, into bands that similar texts
are at most one apart in.  Pairs are never written out, and no pair of one bucket and two classes is left out.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgrid.llm.common import connected_components, ship, table, text_or_empty, with_least

U = np.uint64
WORDS = 5
CHUNK_CHARS = 1 << 20
#: Members of a bucket, and bytes of their k-mers, in one side of a block.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
_NOT_WORD = re.compile(r"\W+")
#: Letters of scripts that put no spaces between words (Thai to Tibetan, Burmese, Khmer, kana, Han and its extensions).
_UNSPACED = re.compile("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
_RNG = np.random.Generator(np.random.PCG64(777))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
_BASE = int(_RNG.integers(1 << 60, 1 << 62)) | 1
_SEEDS = _RNG.integers(1, 1 << 63, 256, dtype=U)
_POWERS: list = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * U(0x9E3779B97F4A7C15)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


def normal(text: str) -> str:
    """The words, lower-cased, one space between them; each letter of a script without spaces between words is a word."""
    text = text.lower()
    return _NOT_WORD.sub(" ", text if text.isascii() else _UNSPACED.sub(r" \1 ", text)).strip()


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For bytes with words between spaces and line breaks: each word's hash and its end."""
    global _POWERS
    if not _POWERS or len(_POWERS[0]) <= len(data):
        n = max(len(data) + 1, 2 * CHUNK_CHARS)
        up, down = np.ones(n, U), np.ones(n, U)
        up[1:], down[1:] = U(_BASE), U(pow(_BASE, -1, 1 << 64))
        _POWERS = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    gap = (data == 32) | (data == 10)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * _POWERS[0][: len(data)], out=sums[1:])
    return _mix((sums[end] - sums[begin]) * _POWERS[1][begin]), end


def kmers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """k-mer hashes of normal texts one after another, and how many each has; a text of 1 to 4 words has one."""
    data = np.frombuffer("\n".join(texts).encode("utf-8", "replace"), np.uint8)
    hashes, end = _word_hashes(data)
    breaks = np.flatnonzero(data == 10)
    upto = np.append(np.searchsorted(end, breaks, "right"), len(end))
    words = np.diff(np.concatenate([[0], upto]))
    padded = np.concatenate([hashes, np.zeros(WORDS, U)])
    text = np.repeat(np.arange(len(texts)), words)
    last = np.repeat(upto, words)
    at = np.arange(len(hashes))
    total = np.zeros(len(hashes), U)
    for k in range(WORDS):  # words beyond the text's end count as none
        total = _mix(total * U(3) + np.where(at + k < last, padded[k : k + len(hashes)], U(1)))
    first = np.concatenate([[0], upto[:-1]])
    keep = (at + WORDS <= last) | (at == first[text])
    return total[keep], np.bincount(text[keep], minlength=len(texts))


#: Texts of so many k-mers have buckets of their whole sequence, or of it with one k-mer left out.
WHOLE, ONE_OUT = range(4, 9), range(5, 10)


def short_buckets(sequence: list[int]) -> list[int]:
    """Further bucket numbers of a text of few k-mers; hashes of tuples of integers are the same in every process."""
    n = len(sequence)
    ways = [sequence] if n in WHOLE else []
    if n in ONE_OUT:
        ways += [sequence[:i] + sequence[i + 1 :] for i in range(n)]
    return sorted({hash((777, *w)) for w in ways})


def sketches(hashes: np.ndarray, counts: np.ndarray, repeats: int, picks: int) -> np.ndarray:
    """For the k-mers of texts, a bucket number for each text (row) and repeat (column); rows of texts without words mean nothing."""
    own = counts > 0
    out = np.zeros((len(counts), repeats), np.int64)
    if not own.any():
        return out
    size = counts[own]
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    text = np.repeat(np.arange(len(size)), size)
    # the occurrence label: how many equal k-mers of the text stand before
    group = _mix(hashes ^ _mix(text.astype(U) + U(1)))
    order = np.argsort(group, kind="stable")
    new = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    run = np.flatnonzero(new)
    label = np.empty(len(group), U)
    label[order] = (np.arange(len(group)) - np.repeat(run, np.diff(np.append(run, len(group))))).astype(U)
    labelled = hashes + label * U(0xA24BAED4963EE407)
    bits = int(len(group)).bit_length()
    low = U((1 << bits) - 1)
    index = np.arange(len(group), dtype=U)
    most = U(0xFFFFFFFFFFFFFFFF)
    for r in range(repeats):
        key = (_mix(labelled ^ _SEEDS[r]) & ~low) | index
        at = np.empty((len(size), picks), np.int64)
        for p in range(picks):
            least = np.minimum.reduceat(key, starts)
            at[:, p] = np.where(least == most, -1, (least & low).astype(np.int64))
            key[at[:, p][at[:, p] >= 0]] = most
        at.sort(axis=1)  # text order
        name = np.full(len(size), _SEEDS[255 - r], U)
        for p in range(picks):
            name = _mix(name * U(5) + np.where(at[:, p] < 0, U(0), hashes[at[:, p]]))
        out[own, r] = name.astype(np.int64)
    return out


def _sketched(repeats: int, picks: int):
    def run(batches):
        import hashlib

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), [normal(t) for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK_CHARS):
                    size += len(texts[stop])
                    stop += 1
                part = texts[at:stop]
                hashes, counts = kmers(part)
                rows = sketches(hashes, counts, repeats, picks).tolist()
                few = np.flatnonzero((counts >= WHOLE[0]) & (counts <= ONE_OUT[-1]))
                ends = np.cumsum(counts)
                for i in few.tolist():
                    rows[i] += short_buckets(hashes[ends[i] - counts[i] : ends[i]].astype(np.int64).tolist())
                digest = [hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest() if t else None for t in part]
                yield pa.RecordBatch.from_arrays([pa.array(docs[at:stop], pa.int64()), pa.array(digest, pa.binary()), pa.array(counts, pa.int32()), pa.array(rows, pa.list_(pa.int64()))], ["doc", "digest", "size", "buckets"])
                at = stop

    return run


def _sequences():
    """doc and its k-mers as packed 32-bit numbers."""

    def run(batches):
        for batch in batches:
            out = [kmers([normal(t)])[0].astype(np.uint32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc", "kmers"])

    return run


def aligned(a: np.ndarray, b: np.ndarray, half: int) -> int:
    """The longest common subsequence of a and b inside |i - j| <= half, by bit-parallel rows over a sliding window."""
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    head = int(differs[0]) if len(differs) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    tail = 0
    if n:
        differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
        tail = int(differs[0]) if len(differs) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places: dict[int, list[int]] = {}
    for j, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(j)
    masks = {x: sum(1 << j for j in js) for x, js in places.items() if len(js) > 16}
    found, low, row, wide = 0, 0, 0, 0  # row holds positions low..low+wide, a zero for each matched one
    for i, x in enumerate(b.tolist()):
        top = min(len(a), i + half + 1)
        if top > low + wide:
            row |= ((1 << (top - low - wide)) - 1) << wide
            wide = top - low
        drop = min(i - half - low, wide)
        if drop > 0:
            found += drop - (row & ((1 << drop) - 1)).bit_count()
            row >>= drop
            low += drop
            wide -= drop
        if x not in places or not wide:
            continue
        if x in masks:
            hit = (masks[x] >> low) & ((1 << wide) - 1)
        else:
            js = places[x]
            hit = 0
            for j in js[bisect_left(js, low) :]:
                if j >= low + wide:
                    break
                hit |= 1 << (j - low)
        if hit:
            hit &= row
            row = ((row + hit) | (row & ~hit)) & ((1 << wide) - 1)
    return head + tail + found + wide - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """aligned / (n1 + n2 - aligned), exact where it reaches the threshold (the band is as wide as that needs); else some lower bound of it."""
    total = len(a) + len(b)
    need = threshold / (1 + threshold) * total
    if min(len(a), len(b)) + 1e-9 < need:
        return 0.0
    half = int(max(len(a), len(b)) - need) + 1
    same = aligned(a, b, half)
    return same / (total - same) if total > same else 1.0


def _verified(threshold: float):
    def run(batches):
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            keep = [similarity(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32), threshold) >= threshold for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep, strict=True) if k], pa.int64()) for c in (a, b)], ["a", "b"])

    return run


def _labelled(x: np.ndarray) -> np.ndarray:
    """k-mers with the number of equal ones before them, so that equal values of two texts count their common multiset."""
    order = np.argsort(x, kind="stable")
    y = x[order]
    head = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
    at = np.arange(len(x)) - np.repeat(head, np.diff(np.append(head, len(x))))
    return _mix(y.astype(U) + at.astype(U) * U(0xA24BAED4963EE407))


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many labelled k-mers each text of a shares with each of b: sums of products over blocks of the shared vocabulary."""
    values, owner = np.concatenate(a + b), np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a + b])
    vocabulary, at, count = np.unique(values, return_inverse=True, return_counts=True)
    keep = count[at] > 1
    owner, at = owner[keep], at[keep]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    at = np.cumsum(np.concatenate([[0], at[1:] != at[:-1]])) if len(at) else at
    total = np.zeros((len(a), len(b)), np.float32)
    width = 4096
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        s = slice(*np.searchsorted(at, [lo, lo + width]))
        m = np.zeros((len(a) + len(b), width), np.float32)
        m[owner[s], at[s] - lo] = 1
        total += m[: len(a)] @ m[len(a) :].T
    return total


def _block_links(threshold: float):
    """Links between classes in a block: every pair whose common k-mers can reach the threshold is aligned, unless links found
    before have joined its classes; so the links form a forest."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        node, cls, own = (np.array(t.column(c), np.int64) for c in ("node", "class", "own"))
        seqs = [np.frombuffer(x, np.uint32) for x in t.column("kmers").to_pylist()]
        parent = {c: c for c in cls.tolist()}

        def find(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        out_a, out_b = [], []
        left, right = np.flatnonzero(own == key[2].as_py()), np.flatnonzero(own == key[3].as_py())
        if len(parent) > 1 and len(left) and len(right):
            names = [_labelled(x) for x in seqs]
            shared = common([names[k] for k in left], [names[k] for k in right])
            size = np.array([len(x) for x in seqs])
            need = threshold / (1 + threshold) * (size[left][:, None] + size[right][None, :])
            i, j = np.nonzero((shared + 1e-3 >= need) & (cls[left][:, None] != cls[right][None, :]))
            for k in np.argsort(-(shared[i, j] / need[i, j]), kind="stable"):
                p, q = int(left[i[k]]), int(right[j[k]])
                x, y = find(int(cls[p])), find(int(cls[q]))
                if x != y and similarity(seqs[p], seqs[q], threshold) >= threshold:
                    parent[max(x, y)] = min(x, y)
                    out_a.append(int(node[p]))
                    out_b.append(int(node[q]))
        return pa.Table.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, repeats: int = 20, picks: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, component_id (the smallest id of its class), group_size (its class's documents), kept (id = component_id).

    A text without words (null, empty, signs only) is in a class of its own.  Rows that share an id are one document, in
    one row, linked by any of its texts; rows with a null id come back as they are, kept and without a class.  An empty table gives an
    empty one; extra columns are dropped, whatever their names.  Texts of fewer than five words have one k-mer, so they only
    match their copies.  A text is hashed whole: a task needs about a hundred bytes for each byte of its longest text.

    A pair at similarity 0.8 is missed if no repeat agrees: with a chance of about 3e-5 for long texts, 4e-4 at most (8 k-mers
    of 10 shared) for short ones.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    named = source.where("doc is not null")
    sketch = table(named.mapInArrow(_sketched(repeats, picks), "doc long, digest binary, size int, buckets array<long>"), "sketches")

    # copies: one member for each digest, named by its smallest document
    worded = sketch.where("digest is not null")
    nodes = worded.groupBy("digest").agg(F.min("doc").alias("node"), F.first("size").alias("size"), F.first("buckets").alias("buckets"))
    members = table(nodes, "members")
    each = members.select(F.explode(F.array_distinct("buckets")).alias("bucket"), "node", "size")
    # what is joined to a bucket's rows is a table of its own, so that both sides are plain shuffles and a hot bucket's rows can be split
    leaders = table(each.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("bucket", "leader"), "leaders", tidy=False)
    shared = table(with_least(each, leaders, "bucket"), "shared-buckets")

    wanted = table(shared.select(F.col("node").alias("doc")).distinct(), "wanted", tidy=False)
    sequences = table(named.join(wanted, "doc", "left_semi").mapInArrow(_sequences(), "doc long, kmers binary"), "sequences")

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sequences.select(F.col("doc").alias("a"), F.col("kmers").alias("x")), "a")
        both = left.join(sequences.select(F.col("doc").alias("b"), F.col("kmers").alias("y")), "b")
        return table(both.select("a", "b", "x", "y").mapInArrow(_verified(threshold), "a long, b long"), "links")

    def classed(label: DataFrame) -> DataFrame:
        named_ = label.select(F.col("node").alias("n_"), "component")
        return table(shared.join(named_, F.col("node") == F.col("n_"), "left").withColumn("class", F.coalesce("component", "node")).drop("n_", "component"), "classed")

    def joined(label: DataFrame, links: DataFrame) -> DataFrame:
        """Classes after further links: those before count as links of their members with their smallest."""
        return connected_components(links.unionByName(label.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))))

    # first the smallest member of a member's buckets
    tried = table(shared.where("node != leader").groupBy("node").agg(F.min("leader").alias("a")).select("a", F.col("node").alias("b")), "pairs")
    label = connected_components(verified(tried))
    # then those of all its buckets, where the class is another
    rows = classed(label)
    heads = table(rows.select(F.col("node").alias("h_"), F.col("class").alias("head_class")).distinct(), "heads", tidy=False)
    led = table(rows.where("node != leader").select("leader", "node", "class").distinct(), "led", tidy=False)
    apart = table(led.join(heads, F.col("leader") == F.col("h_")).where("class != head_class").select(F.col("leader").alias("a"), F.col("node").alias("b")), "apart", tidy=False)
    more = table(apart.join(tried, ["a", "b"], "left_anti"), "pairs")
    label = joined(label, verified(more))
    # last, all members of the buckets that still hold several classes
    rows = classed(label)

    def mixed(of: DataFrame, *by: str) -> DataFrame:
        """Groups with several classes and the blocks that they need."""
        sizes = of.groupBy(*by, "class").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long") * 4).alias("bytes"))
        whole = sizes.groupBy(*by).agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("classes > 1")
        return table(whole.select(*by, F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "mixed", tidy=False)

    band = F.floor(F.log(F.col("size")) / (math.log(1 / threshold) + 1e-9)).cast("int")
    bands = F.explode(F.when(F.col("blocks") > 1, F.array(band, band - 1)).otherwise(F.array(F.lit(-2))))
    inside = table(rows.join(mixed(rows, "bucket"), "bucket").select("bucket", bands.alias("band"), "node", "class", "size"), "mixed-buckets")
    own = inside.join(mixed(inside, "bucket", "band"), ["bucket", "band"]).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "class")
    held = pairs.join(sequences.withColumnRenamed("doc", "s_"), F.col("node") == F.col("s_")).drop("s_")
    found = table(held.groupBy("bucket", "band", "i", "j").applyInArrow(_block_links(threshold), "a long, b long"), "links")

    # documents of one id share a class as well
    twins = worded.select("doc", "digest").distinct().join(members.select("digest", "node"), "digest").select(F.col("doc").alias("a"), F.col("node").alias("b"))
    label = joined(label, found.unionByName(twins.where("a != b")))
    every = table(sketch.select("doc").distinct().join(label, F.col("doc") == F.col("node"), "left").select("doc", F.coalesce("component", "doc").alias("component_id")), "classes")
    sizes = table(every.groupBy("component_id").agg(F.count("*").alias("group_size")), "class-sizes", tidy=False)
    named_rows = every.join(sizes, "component_id").select(F.col("doc").alias(id_col), "component_id", "group_size", (F.col("doc") == F.col("component_id")).alias("kept"))
    nameless = source.where("doc is null").select(F.col("doc").alias(id_col), F.lit(None).cast("long").alias("component_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return named_rows.unionByName(nameless)
