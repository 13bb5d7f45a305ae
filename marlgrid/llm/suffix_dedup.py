"""Suffix-array dedup (operator 5): bucket-pointer refinement over the suffixes that can matter.

A byte goes if a string of `length` bytes that covers it also starts earlier.  Sorting every suffix of the corpus would
move many times the corpus; these refinements of the buckets move a small part of it and give the same bytes.

1. Initial buckets.  Among each string's q-grams (q = 38 of 100) the one with the smallest hash is its anchor, the same
   for every occurrence of that string.  Suffixes that start at anchors are put into buckets by their q-gram.  A bucket of
   one member is settled: nothing that it anchors repeats.
2. Refinement by context.  A bucket is divided by all that the anchor's strings cover.  In each part every member but the
   first in corpus order holds only strings that start earlier; it is settled too.
3. Refinement by bucket pointers.  Where a bucket fell into several parts, the bytes around their first members meet in one
   task.  Their suffixes start in buckets of 8 bytes; a bucket's pointer is its rank.  Sorting on the pointer of a suffix
   and that of the suffix 8 later gives pointers for 16 bytes, these sorted with the ones 16 later those for 32, and so on
   until `length`: each step reuses the pointers that the step before has updated.  Strings that hold a suffix alone in its
   bucket are settled and leave.  All but the first string of a last bucket repeat.

The third step compares bytes alone.  The second one takes contexts as equal that share their q-gram's 48-bit bucket and a
64-bit xxh3 hash of all their bytes; two different ones in a bucket of m contexts do so with a chance of about m * m / 2**65.

Buckets travel as packed arrays, reduced within each task before the shuffle: equal contexts in a task leave one member, and
a q-gram with many different contexts in a task is not sent to its bucket, which gets a mark in its place.  The strings of
marked buckets go to the third step one by one, spread by their own hash, the equal ones of a task reduced to the first.
So no bucket holds more than a bounded number of members for each task's batch; beyond FAN_IN batches they are
reduced once more in groups of that many batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgrid.llm.common import parallelism, ship, table, text_or_empty

U = np.uint64
#: Bytes of text hashed at a time, and string starts of a long text among them.
CHUNK = SEGMENT = 1 << 19
#: Bytes of text whose anchors are reduced together before the shuffle.
BATCH = 12 << 20
#: Bytes around anchors that are sent to the third step together.
PIECES = 8 << 20
#: Different contexts of a q-gram in one batch above which its strings are compared one by one.
SPREAD = 8
#: Different contexts of a q-gram in all, above which the same holds.
WIDE = 4096
#: Batches whose members meet in one task.
FAN_IN = 1 << 16

_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
_BASE = int(_RNG.integers(1 << 60, 1 << 62)) | 1
_POWERS: list = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, CHUNK + 4096)
        up, down = np.ones(size, U), np.ones(size, U)
        up[1:], down[1:] = U(_BASE), U(pow(_BASE, -1, 1 << 64))
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * U(0x9E3779B97F4A7C15)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes from each place of data, from prefix sums; it only picks anchors and buckets."""
    up, down = _powers(len(data))
    s = np.zeros(len(data) + 1, U)
    np.cumsum(_TABLE[data] * up[: len(data)], out=s[1:])
    return _mix((s[q:] - s[:-q]) * down[: len(s) - q])


def _anchors(data: np.ndarray, ends: np.ndarray, length: int, q: int):
    """For texts that end at `ends` in data: (anchor, first and last string start that it anchors, q-gram) as arrays."""
    n, w = len(data), length - q + 1
    grams = _grams(data, q)
    # a fixed number of bits, so that every chunk settles ties alike
    low = U((1 << max(20, int(n).bit_length())) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=U)
    have = 1
    while have < w:  # minima over windows of w q-grams, by doubling
        step = min(have, w - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    keep = np.ones(n - length + 1, bool)
    for e in ends[:-1]:
        keep[max(0, e - length + 1) : e] = False
    starts = np.flatnonzero(keep)
    if not len(starts):
        return None
    at = (key[starts] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return at[first], starts[first], starts[last], grams[at[first]]


def _segments(size: int, length: int, segment: int):
    """(first, end) of the bytes of each segment of a text: every string starts in exactly one, and lies in it whole."""
    for first in range(0, max(1, size - length + 1), segment):
        yield first, min(size, first + segment + length - 1)


def _chunks(texts: list[bytes], length: int, segment: int):
    """(index, first byte) of the segments of the texts of at least `length` bytes, some at a time, their joined bytes and ends."""
    own, parts, size = [], [], 0

    def joined():
        return np.array(own), b"".join(parts), np.cumsum([len(p) for p in parts])

    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for first, end in _segments(len(t), length, segment):
            if own and size + end - first > CHUNK:
                yield joined()
                own, parts, size = [], [], 0
            own.append((i, first))
            parts.append(t[first:end])
            size += end - first
    if own:
        yield joined()


#: A member of a bucket: q-gram (48 bits), the context's hash, document (id, and a hash of its text where ids repeat), first
#: string, how many more, whether it is a mark.
MEMBER = np.dtype([("gram", "<u8"), ("name", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("lo", "<i4"), ("span", "<u2"), ("mark", "u1")])
#: Strings of a document for the third step: first one, how many more, bucket, whether they go one by one.
WANTED = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("lo", "<i4"), ("span", "<u2"), ("gram", "<u8"), ("alone", "u1")])
#: Bytes around an anchor, which follow the packed pieces: document, first string, how many more.
PIECE = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("lo", "<i4"), ("span", "<u2")])
RANGE = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("lo", "<i4"), ("hi", "<i4")])


def _sorted(a: np.ndarray, *by: str) -> np.ndarray:
    return a[np.lexsort([a[k] for k in reversed(by)])]


def _new(a: np.ndarray, *by: str) -> np.ndarray:
    """Where a row of a sorted array differs from the one before it."""
    out = np.ones(len(a), bool)
    if len(a):
        out[1:] = np.logical_or.reduce([a[k][1:] != a[k][:-1] for k in by])
    return out


def _pack(a: np.ndarray) -> bytes:
    """Column by column and in each byte by byte, which the shuffle's codec handles better than rows; bytes that are always zero are left out."""
    flags, planes = [], []
    for k in a.dtype.names:
        size = a.dtype[k].itemsize
        for plane in np.ascontiguousarray(a[k]).view(np.uint8).reshape(len(a), size).T:
            flags.append(bool(plane.any()))
            if flags[-1]:
                planes.append(plane.tobytes())
    return np.packbits(flags).tobytes() + b"".join(planes)


def _unpack(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    head = (dtype.itemsize + 7) // 8
    flags = [np.unpackbits(np.frombuffer(b, np.uint8, head))[: dtype.itemsize] for b in blobs]
    sizes = [(len(b) - head) // max(1, int(f.sum())) for b, f in zip(blobs, flags, strict=True)]
    out, at = np.empty(sum(sizes), dtype), 0
    for b, f, n in zip(blobs, flags, sizes, strict=True):
        off, i = head, 0
        for k in dtype.names:
            planes = np.zeros((n, dtype[k].itemsize), np.uint8)
            for p in range(dtype[k].itemsize):
                if f[i]:
                    planes[:, p] = np.frombuffer(b, np.uint8, n, off)
                    off += n
                i += 1
            out[k][at : at + n] = planes.view(dtype[k])[:, 0]
        at += n
    return out


def _split(a: np.ndarray, part: np.ndarray, kind: str):
    order = np.argsort(part, kind="stable")
    a, part = a[order], part[order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(a) else np.array([], int)
    for i, e in enumerate(edges):
        yield int(part[e]), kind, _pack(a[e : edges[i + 1] if i + 1 < len(edges) else len(a)])


def _members(texts: list[bytes], docs: np.ndarray, ties: np.ndarray, length: int, q: int, segment: int) -> np.ndarray:
    import xxhash

    name = xxhash.xxh3_64_intdigest
    found = []
    for own, joined, ends in _chunks(texts, length, segment):
        got = _anchors(np.frombuffer(joined, np.uint8), ends, length, q)
        if got is None:
            continue
        at, lo, hi, gram = got
        text = np.searchsorted(ends, lo, "right")
        begin = np.concatenate([[0], ends[:-1]])[text]
        m = np.zeros(len(at), MEMBER)
        m["gram"] = gram >> U(16)
        # the anchor's place among the strings is part of the name
        m["name"] = [name(joined[a:b], s) for a, b, s in zip(lo.tolist(), (hi + length).tolist(), (at - lo).tolist(), strict=True)]
        of = own[text]
        m["doc"], m["tie"], m["lo"], m["span"] = docs[of[:, 0]], ties[of[:, 0]], lo - begin + of[:, 1], hi - lo
        found.append(m)
    return np.concatenate(found) if found else np.zeros(0, MEMBER)


def _reduced(m: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Members sorted by bucket, the first of each context alone; ranges of bytes that the others give up."""
    m = _sorted(m, "gram", "name", "doc", "tie", "lo")
    first = _new(m, "gram", "name")
    # a document read twice is one document
    again = ~_new(m, "gram", "name", "doc", "tie", "lo")
    rest = m[~first & ~again]
    gone = np.zeros(len(rest), RANGE)
    gone["doc"], gone["tie"], gone["lo"] = rest["doc"], rest["tie"], rest["lo"]
    gone["hi"] = rest["lo"] + rest["span"] + length
    return m[first], gone


def _bucket_size(m: np.ndarray) -> np.ndarray:
    """For each member of a reduced array the number of contexts in its bucket."""
    size = np.diff(np.append(np.flatnonzero(_new(m, "gram")), len(m)))
    return np.repeat(size, size)


def _by_doc(a: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(a["doc"].astype(U) * U(3) + _mix(a["tie"].astype(U) + U(77))) % U(parts)).astype(np.int64)


def _wanted(m: np.ndarray, alone) -> np.ndarray:
    w = np.zeros(len(m), WANTED)
    for k in ("doc", "tie", "lo", "span", "gram"):
        w[k] = m[k]
    w["alone"] = alone
    return w


PARTS = "part int, kind string, salt int, blob binary"


def _record(rows: list[tuple[int, str, bytes]], salt: int = 0) -> pa.RecordBatch:
    part, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.string()), pa.array([salt] * len(part), pa.int32()), pa.array(blob, pa.binary())], ["part", "kind", "salt", "blob"])


def _settled(m: np.ndarray, gone: np.ndarray, alone: np.ndarray, parts: int) -> list[tuple[int, str, bytes]]:
    """Rows of what a bucket's task has settled: ranges that go, and members whose strings are compared one by one with a mark for each bucket."""
    rows = list(_split(gone, _by_doc(gone, parts), "gone"))
    want = _wanted(m[alone], 1)
    rows += _split(want, _by_doc(want, parts), "wanted")
    marks = m[alone][_new(m[alone], "gram")]
    marks["mark"] = 1
    rest = np.concatenate([m[~alone], marks])
    return rows + list(_split(rest, (rest["gram"] % U(parts)).astype(np.int64), "bucket"))


def _salt(number: int, salts: int) -> int:
    """The group of batches that a task's batch belongs to."""
    return (TaskContext.get().partitionId() * 31 + number) % salts


def _first_buckets(length: int, q: int, parts: int, segment: int, salts: int):
    def run(batches):
        texts, docs, ties, size, number = [], [], [], 0, 0

        def flush():
            m, gone = _reduced(_members(texts, np.array(docs, np.int64), np.array(ties, np.int64), length, q, segment), length)
            return _record(_settled(m, gone, _bucket_size(m) > SPREAD, parts), _salt(number, salts))

        for batch in batches:
            for doc, tie, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "text")), strict=True):
                texts.append(text)
                docs.append(doc)
                ties.append(tie)
                size += len(text)
                if size >= BATCH:
                    yield flush()
                    texts, docs, ties, size, number = [], [], [], 0, number + 1
        if texts:
            yield flush()

    return run


def _gathered(part: pa.Table, dtype: np.dtype, kind: str) -> tuple[np.ndarray, list[tuple[int, str, bytes]]]:
    """The packed rows of a kind as one array; the other rows as they are."""
    of, kinds, blobs = (part.column(c).to_pylist() for c in ("part", "kind", "blob"))
    return _unpack([b for k, b in zip(kinds, blobs, strict=True) if k == kind], dtype), [r for r in zip(of, kinds, blobs, strict=True) if r[1] != kind]


def _members_again(length: int, parts: int):
    """The members that some batches sent to a part, reduced like those of one batch."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        m, passed = _gathered(part, MEMBER, "bucket")
        marked = np.unique(m["gram"][m["mark"] == 1])
        m, gone = _reduced(m[m["mark"] == 0], length)
        rows = _settled(m, gone, _bucket_size(m) > SPREAD * SPREAD, parts)
        old = np.zeros(len(marked), MEMBER)
        old["gram"], old["mark"] = marked, 1
        return pa.Table.from_batches([_record([*passed, *rows, *_split(old, np.full(len(old), key[0].as_py()), "bucket")])])

    return run


def _second_buckets(length: int, parts: int, wide: int):
    """Buckets of a part, refined by context: what goes, and the strings that the third step must compare; rows settled before pass through."""

    def run(part: tuple, table_: pa.Table) -> pa.Table:
        m, rows = _gathered(table_, MEMBER, "bucket")
        marked = np.unique(m["gram"][m["mark"] == 1])
        m, gone = _reduced(m[m["mark"] == 0], length)
        size = _bucket_size(m)
        alone = np.isin(m["gram"], marked) | (size > wide)
        several = alone | (size > 1)
        want = _wanted(m[several], alone[several])
        rows += [*_split(gone, _by_doc(gone, parts), "gone"), *_split(want, _by_doc(want, parts), "wanted")]
        return pa.Table.from_batches([_record(rows)])

    return run


def _wanted_by_doc(part: tuple, table_: pa.Table) -> pa.Table:
    """doc, tie and its WANTED rows."""
    w = _sorted(_unpack(table_.column("blob").to_pylist(), WANTED), "doc", "tie", "lo")
    cut = np.flatnonzero(_new(w, "doc", "tie"))
    stop = np.append(cut[1:], len(w))
    return pa.Table.from_arrays([pa.array(w["doc"][cut]), pa.array(w["tie"][cut]), pa.array([w[a:b].tobytes() for a, b in zip(cut, stop, strict=True)], pa.binary())], ["doc", "tie", "wanted"])


def _packed_pieces(heads: np.ndarray, texts: list[bytes], part: np.ndarray) -> list[tuple[int, str, bytes]]:
    rows, order = [], np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0])) if len(order) else []
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        own = order[a:b]
        blob = _pack(heads[own])
        rows.append((int(part[own[0]]), "piece", len(own).to_bytes(4, "little") + len(blob).to_bytes(4, "little") + blob + b"".join([texts[i] for i in own])))
    return rows


def _unpacked_pieces(blobs: list[bytes]) -> tuple[np.ndarray, bytes]:
    heads, texts = [], []
    for b in blobs:
        size = int.from_bytes(b[4:8], "little")
        heads.append(_unpack([b[8 : 8 + size]], PIECE))
        texts.append(b[8 + size :])
    return np.concatenate(heads) if heads else np.zeros(0, PIECE), b"".join(texts)


def _pieces(length: int, parts: int, salts: int):
    """Documents with what is wanted of them: the bytes around anchors, sent to their bucket's part, and single strings, to their own hash's."""

    def run(batches):
        import xxhash

        rows, texts, keys, size, number = [], [], [], 0, 0
        alone: dict[bytes, list[tuple]] = {}

        def flush():
            gone = []
            for t, places in alone.items():
                places.sort()
                rows.append((*places[0], 0))
                texts.append(t)
                keys.append(xxhash.xxh3_64_intdigest(t))
                # a document read twice is one document
                gone += [(*p, p[2] + length) for p in sorted(set(places))[1:]]
            found = np.array(gone, RANGE) if gone else np.zeros(0, RANGE)
            heads = np.array(rows, PIECE) if rows else np.zeros(0, PIECE)
            part = (np.array(keys, U) % U(parts)).astype(np.int64)
            return _record([*_split(found, _by_doc(found, parts), "gone"), *_packed_pieces(heads, texts, part)], _salt(number, salts))

        for batch in batches:
            for doc, tie, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "text", "wanted")), strict=True):
                for _, _, lo, span, gram, one in np.frombuffer(wanted, WANTED).tolist():
                    if one:
                        for s in range(lo, lo + span + 1):
                            alone.setdefault(text[s : s + length], []).append((doc, tie, s))
                        size += span * (length + 60)
                    else:
                        rows.append((doc, tie, lo, span))
                        texts.append(text[lo : lo + span + length])
                        keys.append(gram)
                        size += span + length
                    if size >= PIECES:
                        yield flush()
                        rows, texts, keys, alone, size, number = [], [], [], {}, 0, number + 1
        if rows or alone:
            yield flush()

    return run


def _ranks(key: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones, in order: one sort."""
    order = np.argsort(key)
    key = key[order]
    rank = np.zeros(len(key), np.uint32)
    np.cumsum(key[1:] != key[:-1], out=rank[1:])
    pointer = np.empty_like(rank)
    pointer[order] = rank
    return pointer


def later_strings(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether an equal string of `length` bytes stands before, for strings at `starts` of data, given in order.

    Bucket pointers: those of 8 bytes are their ranks; the pointers at p and at p + have, sorted as a pair, give those of
    2 * have bytes.  A string that holds a suffix alone in its bucket differs from all others and is settled.
    """
    out = np.zeros(len(starts), bool)
    live = np.arange(len(starts))
    have = min(8, length)
    n = len(data) - have + 1
    if n <= 0 or not len(starts):
        return out
    eight = np.zeros(n, U)
    for k in range(have):
        eight |= data[k : k + n].astype(U) << U(8 * k)
    pointer = _ranks(eight)
    del eight
    places, size = np.arange(n, dtype=np.int32), n  # the places that have a pointer, in order
    while True:
        # settle strings that hold a lone suffix
        alone = np.zeros(size + 1, np.int32)
        alone[1:][places] = (np.bincount(pointer) == 1)[pointer]
        np.cumsum(alone, out=alone)
        s = starts[live]
        live = live[alone[s + length - have + 1] == alone[s]]
        if have == length or not len(live):
            break
        step = min(have, length - have)
        s = starts[live]
        # only places inside the strings that are left are refined further
        need = np.bincount(s, minlength=size + 1) - np.bincount(s + length - have - step + 1, minlength=size + 1)
        new = np.flatnonzero(np.cumsum(need[:-1])).astype(np.int32)
        del need
        index = np.zeros(size, np.int32)
        index[places] = np.arange(len(places), dtype=np.int32)
        # the pair of a suffix's own pointer and that of the one `step` later
        pointer = _ranks((pointer[index[new]].astype(U) << U(32)) | pointer[index[new + step]])
        places, have = new, have + step
    if len(live):
        index = np.zeros(size, np.int32)
        index[places] = np.arange(len(places), dtype=np.int32)
        bucket = pointer[index[starts[live]]]
        order = np.argsort(bucket, kind="stable")
        later = np.concatenate([[False], bucket[order][1:] == bucket[order][:-1]])
        out[live[order[later]]] = True
    return out


def _ordered(heads: np.ndarray, joined: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces in corpus order, each document's once: heads, their bytes end to end, each string's place in them and its piece."""
    size = heads["span"].astype(np.int64) + length
    begin = np.cumsum(size) - size
    order = np.lexsort([-heads["span"].astype(np.int64), heads["lo"], heads["tie"], heads["doc"]])
    order = order[_new(heads[order], "doc", "tie", "lo", "span")]
    heads, size, begin = heads[order], size[order], begin[order]
    to = np.cumsum(size) - size
    data = np.frombuffer(joined, np.uint8)[np.repeat(begin - to, size) + np.arange(size.sum())] if len(size) else np.zeros(0, np.uint8)
    strings = heads["span"].astype(np.int64) + 1
    own = np.repeat(np.arange(len(heads)), strings)
    at = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    return heads, data, to[own] + at, own


def _runs(heads: np.ndarray, own: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Ranges of bytes of strings (piece, place in it) in order, joined where they follow each other in a piece."""
    head = np.ones(len(own), bool)
    head[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    edge = np.flatnonzero(head)
    gone = np.zeros(len(edge), RANGE)
    of = heads[own[edge]]
    gone["doc"], gone["tie"], gone["lo"] = of["doc"], of["tie"], of["lo"] + at[edge]
    gone["hi"] = of["lo"] + at[np.append(edge[1:], len(own)) - 1] + length if len(edge) else 0
    return gone


def _refined(blobs: list[bytes], length: int):
    heads, data, starts, own = _ordered(*_unpacked_pieces(blobs), length)
    later = later_strings(data, starts, length)
    begin = np.cumsum(heads["span"].astype(np.int64) + length) - heads["span"] - length
    return heads, data, starts, own, begin, later


def _pieces_again(length: int, parts: int):
    """The pieces that some batches sent to a part: single strings that are there before go, the rest passes on."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        of, kinds, blobs = (part.column(c).to_pylist() for c in ("part", "kind", "blob"))
        heads, data, starts, own, begin, later = _refined([b for k, b in zip(kinds, blobs, strict=True) if k == "piece"], length)
        late = later & (heads["span"][own] == 0)
        gone = _runs(heads, own[late], (starts - begin[own])[late], length)
        kept = np.ones(len(heads), bool)
        kept[own[late]] = False
        size = heads["span"].astype(np.int64) + length
        texts = [data[b : b + n].tobytes() for b, n in zip(begin[kept], size[kept], strict=True)]
        rows = [r for r in zip(of, kinds, blobs, strict=True) if r[1] != "piece"]
        rows += [*_split(gone, _by_doc(gone, parts), "gone"), *_packed_pieces(heads[kept], texts, np.full(len(texts), key[0].as_py()))]
        return pa.Table.from_batches([_record(rows)])

    return run


def _last_buckets(length: int, parts: int):
    def run(part: tuple, table_: pa.Table) -> pa.Table:
        of, kinds, blobs = (table_.column(c).to_pylist() for c in ("part", "kind", "blob"))
        heads, _, starts, own, begin, later = _refined([b for k, b in zip(kinds, blobs, strict=True) if k == "piece"], length)
        gone = _runs(heads, own[later], (starts - begin[own])[later], length)
        rows = [r for r in zip(of, kinds, blobs, strict=True) if r[1] != "piece"]
        return pa.Table.from_batches([_record([*rows, *_split(gone, _by_doc(gone, parts), "gone")])])

    return run


def _ranges_by_doc(part: tuple, table_: pa.Table) -> pa.Table:
    """doc, tie and its removed ranges, joined where they touch, as packed 64-bit starts and ends."""
    r = _sorted(_unpack(table_.column("blob").to_pylist(), RANGE), "doc", "tie", "lo", "hi")
    docs, ties, blobs = [], [], []
    if len(r):
        lo, hi, new = r["lo"].astype(np.int64), r["hi"].astype(np.int64), _new(r, "doc", "tie")
        # the running end within a document: offsets keep documents apart
        shift = np.cumsum(new).astype(np.int64) << 32
        reach = np.maximum.accumulate(hi + shift)
        head = new.copy()
        head[1:] |= (lo + shift)[1:] > reach[:-1]
        edge = np.flatnonzero(head)
        end = np.append(edge[1:], len(r)) - 1
        rows = np.stack([lo[edge], (reach - shift)[end]], 1).astype("<i8")
        cut = np.flatnonzero(new[edge])
        docs, ties = r["doc"][edge][cut], r["tie"][edge][cut]
        blobs = [rows[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(rows)), strict=True)]
    return pa.Table.from_arrays([pa.array(docs, pa.int64()), pa.array(ties, pa.int64()), pa.array(blobs, pa.binary())], ["doc", "tie", "ranges"])


#: Bytes of text behind a part of the buckets; its packed members are about as large.
PART_BYTES = 8 << 20
#: Partitions of a shuffle at most; beyond that a partition holds several parts, which it sorts apart and works through one by one.
PARTITIONS = 16_384
#: Null ids stand below every other.
NULL_DOC = -(1 << 63)


def _measured(rows: DataFrame) -> tuple[bool, int]:
    """Whether rows share an id, or have none (only then members carry a hash of their text), and the bytes of all texts."""
    by = rows.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("size"))
    most, least, size = by.agg(F.max("n"), F.min("doc"), F.sum("size")).first()
    return (most or 0) > 1 or least == NULL_DOC, int(size or 0)


def _numbered(docs: DataFrame, id_col: str, text_col: str, ties: bool | None, *more) -> DataFrame:
    """doc, text, and tie: a hash of the text where documents may share an id, 0 elsewhere."""
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_DOC)).alias("doc"), text_or_empty(text_col).cast("binary").alias("text"), *more)
    return own if ties is None else own.withColumn("tie", F.xxhash64("text") if ties else F.lit(0).cast("long"))


def repeated_spans(docs: DataFrame, length: int = 100, q: int | None = None, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, fan_in: int = FAN_IN, wide: int = WIDE) -> tuple[DataFrame, bool]:
    """(doc, tie, ranges): for each document that loses bytes, its maximal removed runs as packed (start, end) int64 rows; and whether ties tell documents apart.

    Documents are ordered by id, and rows that share an id by a hash of their text; a row repeated with one id and text is
    the same document read twice.  Null ids come first, ordered alike.
    """
    spark = docs.sparkSession
    ship(spark)
    q = q or (length * 3 + 7) // 8
    ties, size = _measured(_numbered(docs, id_col, text_col, None))
    source = _numbered(docs, id_col, text_col, ties).select("doc", "tie", "text")
    parts = max(parallelism(spark), size // PART_BYTES)
    salts = max(1, size // BATCH // fan_in)

    def grouped(df: DataFrame, *by: str):
        return df.repartition(min(parts, PARTITIONS), *(by or ("part",))).groupBy(*(by or ("part",)))

    def reduced(df: DataFrame, again) -> DataFrame:
        return df if salts == 1 else grouped(df, "part", "salt").applyInArrow(again(length, parts), PARTS)

    found = reduced(source.where(F.octet_length("text") >= length).mapInArrow(_first_buckets(length, q, parts, segment, salts), PARTS), _members_again)
    second = table(grouped(found).applyInArrow(_second_buckets(length, parts, wide), PARTS), "second-buckets")
    wanted = grouped(second.where("kind = 'wanted'")).applyInArrow(_wanted_by_doc, "doc long, tie long, wanted binary")
    pieces = reduced(source.join(wanted, ["doc", "tie"]).mapInArrow(_pieces(length, parts, salts), PARTS), _pieces_again)
    last = table(grouped(pieces).applyInArrow(_last_buckets(length, parts), PARTS), "last-buckets")
    gone = second.where("kind = 'gone'").unionByName(last)
    return table(grouped(gone).applyInArrow(_ranges_by_doc, "doc long, tie long, ranges binary"), "removed-ranges"), ties


def remove_repeats(docs: DataFrame, length: int = 100, q: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), segment: int = SEGMENT, fan_in: int = FAN_IN, wide: int = WIDE) -> DataFrame:
    """One row a row of docs: id, n_bytes, kept (binary: the bytes left, in order), spans (array of removed start and end), and the columns named in `keep`.

    A null or empty text has no bytes and loses none, and so does one shorter than `length`.  Rows that share an id, or have
    none, are told apart by their texts; rows repeated with one id and text are answered alike.  An empty table gives an empty
    one; other columns are dropped, whatever their names.  Long texts are hashed in segments of `segment` string starts; the bytes are the same.
    """
    spans, ties = repeated_spans(docs, length, q, id_col, text_col, segment, fan_in, wide)
    names = [f"kept_{i}" for i in range(len(keep))]
    rows = _numbered(docs, id_col, text_col, ties, *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    joined = rows.join(spans, ["doc", "tie"], "left").select("doc", "text", "ranges", *names)
    kinds = {f.name: f.dataType for f in joined.schema}

    def run(batches):
        for batch in batches:
            kept, found, sizes = [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                r = np.frombuffer(ranges or b"", "<i8").reshape(-1, 2).tolist()
                left, at = [], 0
                for a, b in r:
                    left.append(text[at:a])
                    at = b
                kept.append(b"".join(left) + text[at:])
                found.append([{"start": a, "end": b} for a, b in r])
                sizes.append(len(text))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(found, span), *(batch.column(n) for n in names)], ["doc", "n_bytes", "kept", "spans", *names])

    extra = "".join(f", {n} {kinds[n].simpleString()}" for n in names)
    done = joined.mapInArrow(run, f"doc long, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>{extra}")
    own = F.when(F.col("doc") != NULL_DOC, F.col("doc")).alias(id_col)
    return done.select(own, "n_bytes", "kept", "spans", *(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)))


def repeat_digests(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return done.select(F.col(id_col).alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
