"""Suffix-array dedup: two-stage suffix sorting of candidate stretches (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import cut, mix, partitions, small_batches, table, texts, tidy

#: Bytes of text in one batch, of a suffix-sorted block, and stretches of one anchor that a block takes before the anchor is dealt over several; bits of a place among hashes.
BATCH, BLOCK, HOT, HOT_IN_BATCH, SALTS, PLACE_BITS = 1 << 20, 1 << 20, 2048, 64, 64, 23
#: Salts of blocks that hold copies only; spans that a task holds before it packs them.
COPIES, MOST_SPANS = 1 << 20, 1 << 18
NO_DOC = (1 << 63) - 1
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.full(n, m, np.uint64)]).cumprod(dtype=np.uint64) for m in (MULTIPLIER, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def anchors(text: np.ndarray, ends: np.ndarray, least: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchors of concatenated documents: each ``least``-byte window within a document belongs to the smallest hash among its k-byte substrings.

    Equal windows have equal anchors at equal places, so documents that share a window share an anchor. Returns, for each run of windows with
    one anchor: hash of the anchor, hash of the stretch of text that the windows cover, first and last window (places in ``text``).
    """
    n = len(text)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < least:
        return none
    most = (1 << PLACE_BITS) - least
    if n > most:  # very long texts in pieces that overlap; a run of windows cut in two is two runs
        got = []
        for lo in range(0, n, most):
            piece = text[lo : lo + most + least - 1]
            inner = ends[(ends > lo) & (ends < lo + len(piece))] - lo
            if len(piece) >= least:
                x = _anchors(piece, np.append(inner, len(piece)), least, k)
                got.append((x[0], x[1], x[2] + lo, x[3] + lo))
        return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else none
    return _anchors(text, ends, least, k)


def _anchors(text: np.ndarray, ends: np.ndarray, least: int, k: int) -> tuple[np.ndarray, ...]:
    n = len(text)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    power, inverse = _powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE[text] * power[:n], out=sums[1:])
    h = mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    bits = np.uint64(PLACE_BITS)  # the same in every batch: equal windows choose alike, the leftmost of equal hashes
    m = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    w, span = least - k + 1, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
    # windows that cross a document's end have no anchor
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n + 1, np.int32)
    long = ends - starts >= least
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - least + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside[: len(m)]))
    if not len(valid):
        return none
    owner = (m[valid] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero((owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1] + 1)) + 1
    # neighbouring documents can't share an anchor: the k bytes of an anchor lie within a window
    first, last = valid[np.concatenate([[0], new])], valid[np.concatenate([new - 1, [len(valid) - 1]])]
    at = owner[np.concatenate([[0], new])]
    stretch = mix((sums[last + least] - sums[first]) * inverse[first] + np.uint64(0xA0761D6478BD642F) * (at - first).astype(np.uint64) + (last - first).astype(np.uint64))
    return h[at], stretch, first, last


def two_stage_sort(t: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of bytes ``t``, sorted to at least ``depth`` bytes, and the 8-byte keys it used.

    Suffixes smaller than their successors are sorted directly; every other suffix is induced from its successor by one scan over the
    buckets of first bytes in ascending order.
    """
    n = len(t)
    pad = np.concatenate([t, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    key = pad[:-7].copy()
    for j in range(1, 8):
        key = (key << np.uint64(8)) | pad[j : len(key) + j]
    change = np.flatnonzero(t[:-1] != t[1:])
    up = np.zeros(n, bool)  # smaller than the successor
    if len(change):
        at = np.searchsorted(change, np.arange(n))
        inside = at < len(change)
        c = change[at[inside]]
        up[: len(c)] = t[c] < t[c + 1]
    direct = np.flatnonzero(up)
    direct = direct[np.lexsort([key[direct + o] for o in range(8 * (depth // 8), -1, -8)])]
    heads = t[direct]
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        induced[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in np.flatnonzero(np.bincount(t, minlength=256)):
        queue = induced[c]
        front = np.concatenate(queue) if queue else np.zeros(0, np.int64)
        own = [front]
        while len(front):
            before = front[front > 0] - 1
            front = before[(t[before] == c) & ~up[before]]
            own.append(front)
        lo, hi = np.searchsorted(heads, [c, c + 1]) if len(heads) else (0, 0)
        full = np.concatenate([*own, direct[lo:hi]])
        out.append(full)
        before = full[full > 0] - 1
        before = before[(t[before] > c) & ~up[before]]
        order = np.argsort(t[before], kind="stable")
        before = before[order]
        chars, where = np.unique(t[before], return_index=True)
        for ch, part in zip(chars, np.split(before, where[1:]), strict=False):
            induced[ch].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64), key


def common_prefixes(key: np.ndarray, sa: np.ndarray, least: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in ``sa``, held to ``least``; 0 for the first."""
    out = np.zeros(len(sa), np.int64)
    if len(sa) < 2:
        return out
    open_ = np.arange(1, len(sa))
    for o in range(0, least, 8):
        x = key[sa[open_] + o] ^ key[sa[open_ - 1] + o]
        same = x == 0
        x = x[~same]
        high = np.zeros(len(x), np.int64)  # equal leading bytes of the key
        for b in range(7):
            high += (x >> np.uint64(56 - 8 * b)) == 0
        out[open_[~same]] = np.minimum(o + high, least)
        open_ = open_[same]
    out[open_] = least
    return out


def _merge(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching stretches of one document become one. ``doc`` is a running number."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    base = doc * (int(e.max()) + 2)  # documents lie apart on one line
    reach = np.maximum.accumulate(base + e)
    new = np.concatenate([[True], base[1:] + s[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
    return doc[first], s[first], reach[last] - base[last]


ANCHOR = np.dtype([("a", "<u4"), ("c", "<u8"), ("id", "<i8"), ("s", "<u4"), ("n", "u1"), ("hot", "u1")])
REMOVE, CANDIDATE, SPLIT = 0, 1, 2
SPAN = np.dtype([("id", "<i8"), ("th", "<i8"), ("s", "<u4"), ("n", "<u4"), ("a", "<u4"), ("salt", "<i4"), ("kind", "u1")])


def pack(rec: np.ndarray, tail: bytes = b"") -> bytes:
    """Records column by column and what follows them, compressed; columns of zeros are left out."""
    full = [f for f in rec.dtype.names if rec[f].any()]
    mask = sum(1 << i for i, f in enumerate(rec.dtype.names) if f in full)
    blob = b"".join([len(rec).to_bytes(4, "little"), mask.to_bytes(2, "little"), *(np.ascontiguousarray(rec[f]).tobytes() for f in full), tail])
    return len(blob).to_bytes(4, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def unpack(blob: bytes, kind: np.dtype) -> tuple[np.ndarray, bytes]:
    """The records, and what follows them."""
    blob = pa.decompress(memoryview(blob)[4:], int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True)
    n, mask, at = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:6], "little"), 6
    rec = np.zeros(n, kind)
    for i, f in enumerate(kind.names):
        if mask >> i & 1:
            rec[f] = np.frombuffer(blob, kind[f], n, at)
            at += n * kind[f].itemsize
    return rec, blob[at:]


def place_of(ids: np.ndarray, ths: np.ndarray, places: int) -> np.ndarray:
    """Where the documents of these ids and text hashes meet their spans; :func:`placed` says the same in Spark."""
    return np.mod(np.mod(ids, places) + np.mod(ths, places), places)


def placed(places: int) -> F.Column:
    return F.pmod(F.pmod("id", F.lit(places)) + F.pmod("th", F.lit(places)), F.lit(places)).cast("int")


def prime(n: int) -> int:
    """The smallest prime from n on: ids that ascend by any other step spread evenly over it."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def dealt(rec: np.ndarray, bucket: np.ndarray, tail=None) -> Iterator[tuple[int, bytes]]:
    """Records packed by bucket."""
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        yield int(bucket[part[0]]), pack(rec[part], tail(part) if tail else b"")


def blob_rows(rows: Iterator[tuple[int, bytes]], names: tuple[str, str], lead: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of (bucket, blob), after null columns of the names in ``lead``."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        empty = [pa.nulls(len(held), pa.int32()), pa.nulls(len(held), pa.binary())][: len(lead or [])]
        return pa.RecordBatch.from_arrays([*empty, pa.array([r[0] for r in held], pa.int32()), pa.array([r[1] for r in held], pa.binary())], [*(lead or []), *names])

    for r in rows:
        held.append(r)
        size += len(r[1])
        if size >= 1 << 20 or len(held) >= 4000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _columns(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)


def equal_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """Whether the bytes from ``a`` and from ``b`` are equal over ``size`` places, each pair on its own."""
    out = np.ones(len(a), bool)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), most)) + lo)
        n = size[lo:hi]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = text[np.repeat(a[lo:hi], n) + step] == text[np.repeat(b[lo:hi], n) + step]
        out[lo:hi] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        lo = hi
    return out


def _collect(least: int, k: int, buckets: int, places: int):
    """Documents to packed anchors. A stretch that occurs in several documents of a batch, byte for byte, stays with the smallest; the others are decided."""

    def one(ids: list[np.ndarray], ths: list[np.ndarray], raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        doc_id, doc_th = np.concatenate(ids), np.concatenate(ths)
        sizes = np.array([len(x) for x in raw], np.int64)
        ends = np.cumsum(sizes)
        text = np.frombuffer(b"".join(raw), np.uint8)
        a, c, first, last = anchors(text, ends, least, k)
        if not len(a):
            return
        row = np.searchsorted(ends, first, side="right")
        start = (ends - sizes)[row]
        did = doc_id[row]
        order = np.lexsort((did, c))
        head = np.concatenate([[True], c[order][1:] != c[order][:-1]])
        first_of = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        late = did[order] > did[first_of]
        late[late] = equal_bytes(text, first[order[late]], first[first_of[late]], last[order[late]] - first[order[late]] + least)
        gone = order[late]
        m, s, e = _merge(row[gone], first[gone] - start[gone], last[gone] - start[gone] + least)
        spans = np.zeros(len(m), SPAN)
        spans["id"], spans["th"], spans["s"], spans["n"] = doc_id[m], doc_th[m], s, e - s
        for x in blob_rows(dealt(spans, place_of(spans["id"], spans["th"], places)), ("place", "spans"), ["bucket", "blob"]):
            yield x.set_column(0, "bucket", x.column(2))  # any task may pass them on
        stay = order[~late]
        stay = stay[np.lexsort((did[stay], c[stay], a[stay]))]
        a32 = (a[stay] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        spread = (a[stay] >> np.uint64(32)).astype(np.int64)
        # an anchor with very many different stretches in one batch is dealt by stretch; a mark tells its own bucket
        group = np.concatenate([[0], np.cumsum(a[stay][1:] != a[stay][:-1])])
        other = np.concatenate([[True], c[stay][1:] != c[stay][:-1]])
        hot = np.bincount(group, weights=other)[group] > HOT_IN_BATCH
        mark = np.flatnonzero(hot & np.concatenate([[True], group[1:] != group[:-1]]))
        rec = np.zeros(len(stay) + len(mark), ANCHOR)
        rec["a"], rec["c"] = np.concatenate([a32, a32[mark]]), np.concatenate([c[stay], np.zeros(len(mark), np.uint64)])
        rec["id"] = np.concatenate([did[stay], np.full(len(mark), NO_DOC)])
        rec["s"][: len(stay)], rec["n"][: len(stay)] = first[stay] - start[stay], last[stay] - first[stay]
        rec["hot"] = np.concatenate([hot, np.full(len(mark), 2)])
        bucket = np.concatenate([np.where(hot, (c[stay] >> np.uint64(20)).astype(np.int64) % buckets, spread % buckets), spread[mark] % buckets])
        th = np.concatenate([doc_th[row[stay]], np.zeros(len(mark), np.int64)])
        order = np.lexsort((rec["id"], bucket))
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        bs, blobs = [], []
        plain = not doc_th.any()
        for part in np.split(order, cuts):
            bs.append(int(bucket[part[0]]))
            r = rec[part]
            # column by column: the shuffle compresses like values that stand together
            blobs.append(b"".join([len(part).to_bytes(4, "little"), b"\0" if plain else b"\1", *(np.ascontiguousarray(r[f]).tobytes() for f in ANCHOR.names), b"" if plain else th[part].tobytes()]))
        for lo in range(0, len(bs), 4000):
            hi = min(len(bs), lo + 4000)
            yield _columns(["bucket", "blob", "place", "spans"], np.array(bs[lo:hi], np.int32), pa.array(blobs[lo:hi], pa.binary()), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ths, raw, size = [], [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                own = texts(part.column(2))
                ids.append(part.column(0).to_numpy())
                ths.append(part.column(1).to_numpy())
                raw += own
                size += sum(map(len, own))
                if size >= BATCH:
                    yield from one(ids, ths, raw)
                    ids, ths, raw, size = [], [], [], 0
        if raw:
            yield from one(ids, ths, raw)

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, at = int.from_bytes(blob[:4], "little"), 5
    rec = np.zeros(n, ANCHOR)
    for f in ANCHOR.names:
        kind = ANCHOR[f]
        rec[f] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return rec, np.zeros(n, np.int64) if blob[4] == 0 else np.frombuffer(blob, np.int64, n, at)


def _decide(least: int, places: int):
    """Anchors bucket by bucket: those in several documents, or with several different stretches, give candidates; a hash only chooses which stretches are compared."""

    def bucket(blobs: list[bytes]) -> np.ndarray:
        got = [_unpack(b) for b in blobs]
        r, th = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.lexsort((r["id"], r["c"], r["a"]))
        r, th = r[order], th[order]
        new_a = np.concatenate([[True], r["a"][1:] != r["a"][:-1]])
        new_c = new_a | np.concatenate([[True], r["c"][1:] != r["c"][:-1]])
        head = np.maximum.accumulate(np.where(new_c, np.arange(len(r)), 0))
        group, real = np.cumsum(new_a) - 1, r["hot"] < 2
        marked = np.bincount(group, weights=~real) > 0
        kinds = np.bincount(group[new_c])  # different stretches, and a mark
        rows = np.bincount(group)
        copy = real & (r["id"] > r["id"][head])
        copied = np.zeros(len(r), bool)
        copied[head[copy]] = True
        split = marked[group] | (r["hot"] == 1) | (kinds[group] > HOT)
        stay = np.flatnonzero(real & ~copy & ((kinds[group] > 1) | split | copied[head]))
        salts = np.maximum(SALTS, -(-kinds[group] // HOT))
        salt = np.where(split, (r["c"] >> np.uint64(8)).astype(np.int64) % salts, 0)
        # copies meet the first of their kind: in its block, or where the anchor is crowded in blocks of their own to which it goes too
        late = np.flatnonzero(copy)
        crowded = rows[group[late]] > HOT
        far = late[crowded]
        again = np.zeros(0, np.int64)
        if len(far):
            new = np.concatenate([[True], head[far][1:] != head[far][:-1]])
            at = np.arange(len(far)) - np.maximum.accumulate(np.where(new, np.arange(len(far)), 0))
            chunk = np.cumsum(new | (at % HOT == 0)) - 1
            salt[far] = COPIES + chunk
            again = head[far[np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))]]
        both = np.concatenate([stay, late, again])
        kind = np.concatenate([np.where(split[stay], SPLIT, CANDIDATE), np.full(len(late) + len(again), CANDIDATE)]).astype(np.int32)
        salt = np.concatenate([salt[stay], salt[late], COPIES + np.arange(len(again))]).astype(np.int32)
        out = np.zeros(len(both), SPAN)
        out["id"], out["th"], out["s"], out["n"], out["a"] = r["id"][both], th[both], r["s"][both], r["n"][both].astype(np.uint32) + least, r["a"][both]
        out["salt"], out["kind"] = salt, kind
        return out

    def told(spans: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = np.concatenate([np.zeros(0, SPAN), *spans])
        for x in blob_rows(dealt(out, place_of(out["id"], out["th"], places)), ("place", "spans")):
            yield x.append_column("asked", pa.array([True] * x.num_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            blobs = batch.column(1)
            for at, b in zip(batch.column(0).to_pylist(), blobs.to_pylist(), strict=True):
                if b is not None:
                    if held and at != now:
                        out.append(bucket(held))
                        held = []
                        if sum(map(len, out)) > MOST_SPANS:
                            yield from told(out)
                            out = []
                    now = at
                    held.append(b)
            if blobs.null_count:
                told_before = pa.Table.from_batches([batch]).filter(blobs.is_null()).select(["place", "spans"]).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*told_before.columns, pa.array([False] * told_before.num_rows)], ["place", "spans", "asked"])
        if held:
            out.append(bucket(held))
        yield from told(out)

    return run


class Spans:
    """Spans of the documents of a place, in the order of id and text hash."""

    def __init__(self, blobs: list[bytes]):
        rec = np.concatenate([np.zeros(0, SPAN), *(unpack(b, SPAN)[0] for b in blobs)])
        self.rec = rec[np.lexsort((rec["s"], rec["th"], rec["id"]))]
        ids, ths = self.rec["id"], self.rec["th"]
        head = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])])) if len(ids) else np.zeros(0, np.int64)
        self.at = dict(zip(zip(ids[head].tolist(), ths[head].tolist(), strict=True), zip(head.tolist(), [*head[1:].tolist(), len(ids)][: len(head)], strict=True), strict=True))

    def of(self, id_: int, th: int) -> tuple[int, int]:
        return self.at.get((id_, th), (0, 0))


def with_spans(batches: Iterator[pa.RecordBatch], size: int = 200) -> Iterator[tuple[Spans, pa.RecordBatch]]:
    """Rows sorted by place, spans before documents: the spans of a place with each batch of its documents. The first columns are place, spans (null for documents)."""
    now, blobs, spans = None, [], None
    for batch in batches:
        place, empty = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((place[1:] != place[:-1]) | (empty[1:] != empty[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
            if hi <= lo:
                continue
            if place[lo] != now:
                now, blobs, spans = place[lo], [], None
            if not empty[lo]:
                blobs += batch.column(1).slice(lo, hi - lo).to_pylist()
                continue
            if spans is None:
                spans = Spans(blobs)
            for at in range(lo, hi, size):
                yield spans, batch.slice(at, min(size, hi - at))


STRETCH = np.dtype([("id", "<i8"), ("th", "<i8"), ("s", "<u4"), ("n", "<u4"), ("a", "<u4"), ("salt", "<i4"), ("kind", "u1")])


def gathered(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of stretches of ``text``, one after another."""
    return text[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _cut_out(buckets: int, most: int = 1 << 20):
    """The bytes of each stretch that is asked for, by one gather over the texts of a few documents, dealt by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spans, part in with_spans(batches, 1000):
            raw = texts(part.column(4))
            ranges = [spans.of(i, t) for i, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            count = np.array([e - s for s, e in ranges])
            rec = spans.rec[np.concatenate([np.arange(s, e) for s, e in ranges])] if count.any() else spans.rec[:0]
            base = np.repeat(np.cumsum([0, *map(len, raw)])[:-1], count)
            wanted = rec["kind"] != REMOVE
            rec, base = rec[wanted], base[wanted]
            text = np.frombuffer(b"".join(raw), np.uint8)
            ends = np.cumsum(rec["n"].astype(np.int64))
            i = 0
            while i < len(rec):
                j = max(i + 1, int(np.searchsorted(ends, (int(ends[i - 1]) if i else 0) + most)))
                own, start = rec[i:j], base[i:j] + rec["s"][i:j]
                size = own["n"].astype(np.int64)
                bucket = ((own["a"].astype(np.int64) * 31 + own["salt"]) % buckets).astype(np.int32)
                tail = lambda x, start=start, size=size: gathered(text, start[x], size[x]).tobytes()  # noqa: E731, B023
                yield from blob_rows(dealt(own, bucket, tail), ("bucket", "blob"))
                i = j

    return run


WINDOW = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("id", "<i8"), ("th", "<i8"), ("s", "<u4")])
FOUND = "place int, spans binary, bucket int, windows binary"


def block_repeats(stretches: list[bytes], ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By one suffix array over the stretches: for each window (stretch number, offset) the smallest id of those in which it also starts."""
    sizes = np.array([len(x) for x in stretches], np.int64)
    t = np.frombuffer(b"\0".join(stretches) + b"\0", np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    sa, key = two_stage_sort(t, least)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    within = np.arange(len(t)) - starts[owner]
    sa = sa[within[sa] + least <= sizes[owner[sa]]]
    if not len(sa):
        return (np.zeros(0, np.int64),) * 3
    prefix = common_prefixes(key, sa, least)
    low = np.minimum.reduceat(ids[owner[sa]], np.flatnonzero(prefix < least))
    return owner[sa], within[sa], low[np.cumsum(prefix < least) - 1]


def _sort_blocks(least: int, places: int):
    """Stretches of one partition, block by block; an anchor that is not dealt out lies in one block whole. Equal stretches (by their bytes) are sorted once, with the smallest id."""
    names = ["place", "spans", "bucket", "windows"]

    def block(rec: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, ths, s, kind = (rec[k].astype(np.int64) for k in ("id", "th", "s", "kind"))
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(x, len(number)) for x in raw], np.int64)
        different = list(number)
        least_id = np.full(len(different), NO_DOC)
        np.minimum.at(least_id, of, ids)
        # an anchor with one form only has nothing to sort: its copies are equal
        anchor = np.cumsum(np.concatenate([[0], (rec["a"][1:] != rec["a"][:-1]) | (rec["salt"][1:] != rec["salt"][:-1])]))
        form = np.zeros(int(anchor[-1]) + 1, np.int64)
        form[anchor] = of
        several = np.zeros(len(form), bool)
        several[anchor[of != form[anchor]]] = True
        sort = np.zeros(len(different), bool)
        sort[of[several[anchor] | (kind == SPLIT)]] = True
        chosen = np.flatnonzero(sort)
        own, off, low = block_repeats([different[i] for i in chosen], least_id[chosen], least) if len(chosen) else (np.zeros(0, np.int64),) * 3
        own = chosen[own] if len(own) else own
        # every window of a copy is a window of the first of its kind, which has a smaller id
        copy = ids > least_id[of]
        later = np.flatnonzero(copy)
        size = np.array([len(x) for x in different], np.int64)[of]
        # windows of the first ones, for each row that holds them
        first = np.flatnonzero(~copy)
        first = first[np.argsort(of[first], kind="stable")]
        count = np.bincount(of[first], minlength=len(different))
        begin = np.cumsum(count) - count
        window = np.repeat(np.arange(len(own)), count[own])
        row = first[begin[own[window]] + np.arange(len(window)) - np.repeat(np.cumsum(count[own]) - count[own], count[own])]
        gone = ids[row] > low[window]
        place = s[row] + off[window]
        d, lo, hi = _merge(np.concatenate([row[gone], later]), np.concatenate([place[gone], s[later]]), np.concatenate([place[gone] + least, s[later] + size[later]]))
        spans = np.zeros(len(d), SPAN)
        spans["id"], spans["th"], spans["s"], spans["n"] = ids[d], ths[d], lo, hi - lo
        rest = np.flatnonzero((kind[row] == SPLIT) & ~gone)
        digest = [hashlib.blake2b(raw[o][f : f + least], digest_size=16).digest() for o, f in zip(row[rest].tolist(), off[window[rest]].tolist(), strict=True)]
        windows = np.zeros(len(rest), WINDOW)
        windows["w1"], windows["w2"] = np.frombuffer(b"".join(digest), np.uint64).reshape(-1, 2).T
        windows["id"], windows["th"], windows["s"] = ids[row[rest]], ths[row[rest]], place[rest]
        return spans, windows

    def told(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        spans = np.concatenate([np.zeros(0, SPAN), *(f[0] for f in found)])
        windows = np.concatenate([np.zeros(0, WINDOW), *(f[1] for f in found)])
        for x in blob_rows(dealt(spans, place_of(spans["id"], spans["th"], places)), ("place", "spans")):
            yield _columns(names, x.column(0), x.column(1), pa.nulls(x.num_rows, pa.int32()), pa.nulls(x.num_rows, pa.binary()))
        for x in blob_rows(dealt(windows, (windows["w1"] % np.uint64(max(2, places // 4))).astype(np.int64)), ("bucket", "windows")):
            yield _columns(names, pa.nulls(x.num_rows, pa.int32()), pa.nulls(x.num_rows, pa.binary()), x.column(0), x.column(1))

    held: list[tuple[np.ndarray, np.ndarray]] = []

    def bucket(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        got = [unpack(b, SPAN) for b in blobs]
        rec, data = np.concatenate([g[0] for g in got]), b"".join(g[1] for g in got)
        size = rec["n"].astype(np.int64)
        start = np.cumsum(size) - size
        order = np.lexsort((rec["salt"], rec["a"]))
        rec, start, size = rec[order], start[order], size[order]
        new = np.concatenate([np.flatnonzero((rec["a"][1:] != rec["a"][:-1]) | (rec["salt"][1:] != rec["salt"][:-1])) + 1, [len(rec)]])
        ends = np.cumsum(size + 1)
        lo = 0
        while lo < len(rec):  # whole anchors, until the block is full
            hi = int(new[min(len(new) - 1, np.searchsorted(ends[new - 1], (ends[lo - 1] if lo else 0) + BLOCK))])
            held.append(block(rec[lo:hi], [data[a : a + n] for a, n in zip(start[lo:hi].tolist(), size[lo:hi].tolist(), strict=True)]))
            lo = hi
            if sum(len(x) + len(y) for x, y in held) > MOST_SPANS:
                yield from told(held)
                held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.clear()
        yield from _by_bucket(bucket)(batches)
        yield from told(held)
        held.clear()

    return run


def repeated_spans(docs: DataFrame, places: int, least: int = 50, k: int = 20) -> DataFrame:
    """Stretches of each document (packed: ``place, spans``) that lie in ``least``-byte strings which also start in a document with a smaller id.

    1. Every window of ``least`` bytes belongs to an anchor, the smallest hash of its k-byte substrings; windows of one anchor make a stretch. Stretches that repeat within a batch of documents are
    compared byte by byte and stay with the smallest document. Packed anchors are dealt by a hash. 2. Anchors that occur in several documents, or with different stretches, send their stretches to blocks. 3. Each
    block compares its stretches by their bytes; the different ones make a suffix array (two-stage sorting), whose adjacent common prefixes tell in which
    documents each window recurs. 4. Copies of one stretch beyond HOT go to blocks of their own, each with the first of them. Anchors with very many different stretches are dealt over many blocks; the
    smallest id of their windows is then found by a grouped minimum over 128-bit digests.
    """
    spark = docs.sparkSession
    n = 2 * partitions(spark)  # a task holds one bucket of anchors, a quarter of its partition
    packed = docs.select("id", "th", "text").mapInArrow(tidy(_collect(least, k, 4 * n, places)), "bucket int, blob binary, place int, spans binary")
    spans = cut(packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_decide(least, places)), "place int, spans binary, asked boolean"))
    stretches = together(docs.select("id", "th", "text"), spans.where("asked"), places, n).mapInArrow(tidy(_cut_out(n)), "bucket int, blob binary")
    found = cut(stretches.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_sort_blocks(least, places)), FOUND))
    late = found.where("windows is not null").select("bucket", "windows").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_late(least, places)), "place int, spans binary")
    return spans.where("not asked").select("place", "spans").unionByName(found.where("spans is not null").select("place", "spans")).unionByName(late)


def _late(least: int, places: int):
    """Windows of anchors that were dealt over several blocks, at most one of each block, by their digests: all but the smallest document's go."""

    def bucket(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rec = np.concatenate([unpack(b, WINDOW)[0] for b in blobs])
        rec = rec[np.lexsort((rec["id"], rec["w2"], rec["w1"]))]
        new = np.concatenate([[True], (rec["w1"][1:] != rec["w1"][:-1]) | (rec["w2"][1:] != rec["w2"][:-1])])
        rec = rec[rec["id"] > rec["id"][np.maximum.accumulate(np.where(new, np.arange(len(rec)), 0))]]
        spans = np.zeros(len(rec), SPAN)
        spans["id"], spans["th"], spans["s"], spans["n"] = rec["id"], rec["th"], rec["s"], least
        yield from blob_rows(dealt(spans, place_of(spans["id"], spans["th"], places)), ("place", "spans"))

    return _by_bucket(bucket)


def _by_bucket(one):
    """``one`` of the blobs of each bucket, which come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for at, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and at != now:
                    yield from one(held)
                    held = []
                now = at
                held.append(b)
        if held:
            yield from one(held)

    return run


def together(docs: DataFrame, spans: DataFrame, places: int, n: int) -> DataFrame:
    """Documents and their packed spans, dealt by place; in each place the spans come first."""
    own = docs.select(placed(places).alias("place"), F.lit(None).cast("binary").alias("spans"), "*")
    told = spans.select("place", "spans", *[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
    return own.unionByName(told).repartition(n, "place").sortWithinPartitions("place", F.col("spans").isNull())


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for spans, part in with_spans(batches):
        out: list[list] = [[] for _ in range(5)]
        for i, t, x in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), texts(part.column(4)), strict=True):
            lo, hi = spans.of(i, t)
            rec = spans.rec[lo:hi]
            rec = rec[rec["kind"] == REMOVE]
            s, n = rec["s"].astype(np.int64), rec["n"].astype(np.int64)
            _, s, e = _merge(np.zeros(len(s), np.int64), s, s + n)
            kept, last = [], 0
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                kept.append(x[last:a])
                last = b
            kept.append(x[last:])
            rest = b"".join(kept)
            for c, v in zip(out, (len(x), len(x) - len(rest), len(s), hashlib.sha256(rest).hexdigest(), rest), strict=True):
                c.append(v)
        cols = [part.column(5), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols + part.columns[6:], names + part.schema.names[6:])


def remove_repeats(docs: DataFrame, least: int = 50, k: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every whole text as UTF-8 bytes (null: empty).

    A byte goes if it is covered by a ``least``-byte string that also starts in a document with a smaller id; overlaps count and strings are
    judged on the input. One row per input row. Rows that repeat an id are not earlier than each other; a null id counts as larger than
    all others. Texts shorter than ``least`` bytes keep all. An empty table gives no rows; of the other columns those named in ``carry`` come along as ``carry_<name>``.
    """
    small_batches(docs.sparkSession)
    more = [f"carry_{c}" for c in carry]
    base = docs.select(*[F.col(c).alias(f"carry_{c}") for c in carry], F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_DOC)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    unique = base.groupBy("id").count().where("count > 1").isEmpty()
    # rows that repeat an id are told apart by a hash of their text
    keyed = base.select("doc_id", "id", (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("th"), "text", *more)
    n = 2 * partitions(docs.sparkSession)
    places = prime(n)
    spans = repeated_spans(keyed.select("id", "th", "text"), places, least, k)
    joined = together(keyed.select("id", "th", "text", "doc_id", *more), spans, places, n)
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[6:])
    return joined.mapInArrow(tidy(_result), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary{extra}")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
