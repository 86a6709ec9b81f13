"""Language-model scoring by deleted interpolation (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import crc_fold, cut, mix, partitions, small_batches, steady_scans, table, texts, tidy
from brindle.llm.licenses import LOWER

#: Share of all tokens from which a word's counts are broadcast; bytes of text in a group of documents; bins of the EM's table and the ratio of their limits.
FREQUENT, GROUP, BINS, RATIO = 2e-5, 8 << 20, 512, 1.1
END = b"\n"  # white space: no token of a text
ODD, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)
WORDS, PAIRS, COUNTS, TOKENS = 1, 2, 3, 0
HELD = 8  # added to WORDS and PAIRS: the held-out counts
ROW = "g long, kind int, bucket int, tag long, blob binary"
NAMES = ["g", "kind", "bucket", "tag", "blob"]


def _row(g: list, kind: list, bucket: list, tag: list, blob: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(tag, pa.int64()), pa.array(blob, pa.binary())], NAMES)


@dataclass
class Group:
    """Tokens of some documents: numbers into the distinct words, whose hashes ``words`` holds; each text ends with the end token."""

    tokens: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    train: np.ndarray
    dev: np.ndarray
    ids: list

    @staticmethod
    def of(raw: list[bytes], fold: list, ids: list) -> Group:
        import xxhash

        local: dict[bytes, int] = {END: 0}
        tokens: list[int] = []
        ends: list[int] = []
        for x in raw:
            for w in x.translate(LOWER).split():
                tokens.append(local.setdefault(w, len(local)))
            tokens.append(0)
            ends.append(len(tokens))
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, local), np.uint64, len(local))
        train = np.array([f is not None and f != 1 for f in fold], bool)
        return Group(np.array(tokens, np.int64), np.array(ends, np.int64), words, train, np.array([f == 0 for f in fold], bool), ids)

    def each(self, flag: np.ndarray) -> np.ndarray:
        """A flag of the documents, for each token."""
        return np.repeat(flag, np.diff(self.ends, prepend=0))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Group]]:
    """Documents (id, fold, text) of a partition in groups of about GROUP bytes, numbered by partition and place. Those of fold 0 make
    groups of their own, with odd numbers, which do not depend on the other documents."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    parts: list[tuple[list, list, list]] = [([], [], []), ([], [], [])]
    size, seq = [0, 0], [0, 0]
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for i, f, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part.column(2)), strict=True):
                k = int(f == 0)
                for own, value in zip(parts[k], (x, f, i), strict=True):
                    own.append(value)
                size[k] += len(x)
                if size[k] >= GROUP:
                    yield first + 2 * seq[k] + k, Group.of(*parts[k])
                    parts[k], size[k], seq[k] = ([], [], []), 0, seq[k] + 1
    for k in (0, 1):
        if parts[k][0]:
            yield first + 2 * seq[k] + k, Group.of(*parts[k])


def bucket_of(h32: np.ndarray, buckets: int) -> np.ndarray:
    return (h32.astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)


def slices(sorted_h32: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Bucket and its range in ascending hashes."""
    b = bucket_of(sorted_h32, buckets).astype(np.int64)
    cuts = np.flatnonzero(np.diff(b)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(b)], strict=True):
        if hi > lo:
            yield int(b[lo]), int(lo), int(hi)


def high(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _count(buckets: int):
    """Counts of the distinct training words of each group: hash, all, of the held-out part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in groups(batches):
            n = len(x.words)
            every = np.bincount(x.tokens, weights=x.each(x.train), minlength=n).astype(np.uint32)
            dev = np.bincount(x.tokens, weights=x.each(x.dev), minlength=n).astype(np.uint32)
            keep = np.flatnonzero(every)
            keep = keep[np.argsort(x.words[keep])]
            h, every, dev = x.words[keep], every[keep], dev[keep]
            got = [(b, b"".join([h[lo:hi].tobytes(), every[lo:hi].tobytes(), dev[lo:hi].tobytes()])) for b, lo, hi in slices(high(h), buckets)]
            yield _row([0] * len(got), [COUNTS] * len(got), [g[0] for g in got], [0] * len(got), [g[1] for g in got])

    return run


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (64 bits), counts and held-out counts (32 bits) of a group's words."""
    n = len(blob) // 16
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint32, n, 8 * n).astype(np.int64), np.frombuffer(blob, np.uint32, n, 12 * n).astype(np.int64)


SUMMED = "bucket int, hashes binary, n binary, dev binary, tokens long, dev_tokens long, words long"


def _sum(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack_counts(b) for batch in batches for b in batch.column(4).to_pylist()]
        if not parts:
            return
        h = np.concatenate([p[0] for p in parts])
        u, inv = np.unique(h, return_inverse=True)
        n = np.bincount(inv, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        dev = np.bincount(inv, weights=np.concatenate([p[2] for p in parts])).astype(np.int64)
        for b, lo, hi in slices(high(u), buckets):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "hashes": [u[lo:hi].tobytes()], "n": [n[lo:hi].tobytes()], "dev": [dev[lo:hi].tobytes()], "tokens": [int(n[lo:hi].sum())], "dev_tokens": [int(dev[lo:hi].sum())], "words": [hi - lo]})

    return run


@dataclass
class Vocabulary:
    """Frequent words (hashes ascending) with their training counts, which every task holds; counts of the rare words are asked for."""

    hashes: np.ndarray
    n: np.ndarray
    dev: np.ndarray
    tokens: int
    dev_tokens: int
    words: int
    docs: int
    dev_docs: int

    @property
    def rare(self) -> int:
        return len(self.hashes)

    def classes(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, words)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == words, at, self.rare) if len(self.hashes) else np.zeros(len(words), np.int64)

    def totals(self, fit: bool) -> np.ndarray:
        """Count of each class as a context: the frequent words, the rare ones, the start; ``fit`` leaves the held-out part away."""
        n = self.n - self.dev if fit else self.n
        all_ = self.tokens - self.dev_tokens if fit else self.tokens
        return np.concatenate([n, [all_ - n.sum(), self.docs - self.dev_docs if fit else self.docs]]).astype(float)


def numbered(x: Group, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Number of each token (place among the frequent words; v.rare is the start of a text; v.rare + 1 + place among the group's rare words), and
    the rare words' hashes ascending."""
    number = v.classes(x.words)
    rare = np.flatnonzero(number == v.rare)
    rare = rare[np.argsort(x.words[rare])]
    number[rare] = v.rare + 1 + np.arange(len(rare))
    return number[x.tokens], x.words[rare]


def pair_keys(number: np.ndarray, ends: np.ndarray, rare: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each token's predecessor, the distinct hashes of pairs of neighbours ascending, and each token's place among them."""
    before = np.concatenate([[v.rare], number[:-1]])
    before[np.concatenate([[0], ends[:-1]])] = v.rare
    h = np.concatenate([v.hashes, np.array([START]), rare])
    u, inv = np.unique(mix(h[before] * ODD + h[number]), return_inverse=True)
    return before, u, inv


def packed_keys(h: np.ndarray) -> bytes:
    """Ascending hashes: the first, and the steps in as many bytes as the largest takes."""
    step = np.diff(h)
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    return len(h).to_bytes(4, "little") + bytes([width]) + h[:1].tobytes() + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_keys(blob: bytes) -> tuple[np.ndarray, int]:
    """The hashes, and how many bytes they take."""
    n, width = int.from_bytes(blob[:4], "little"), blob[4]
    if not n:
        return np.zeros(0, np.uint64), 5
    step = np.zeros((n, 8), np.uint8)
    step[1:, :width] = np.frombuffer(blob, np.uint8, (n - 1) * width, 13).reshape(-1, width)
    h = step.view(np.uint64).ravel()
    h[0] = np.frombuffer(blob, np.uint64, 1, 5)[0]
    return np.cumsum(h, dtype=np.uint64), 13 + (n - 1) * width


def _ask(held, buckets: int):
    """What each group asks for: counts of its rare words, and of its pairs of neighbours, of which it tells its own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, x in groups(batches):
            number, rare = numbered(x, held.value)
            _, u, inv = pair_keys(number, x.ends, rare, held.value)
            every = np.bincount(inv, weights=x.each(x.train), minlength=len(u)).astype(np.int64)
            rows = [(WORDS, b, packed_keys(rare[lo:hi])) for b, lo, hi in slices(high(rare), buckets)] if len(rare) else []
            rows += [(PAIRS, b, packed_keys(u[lo:hi]) + packed_counts(every[lo:hi])) for b, lo, hi in slices(high(u), buckets)]
            for lo in range(0, len(rows), 5000):
                p = rows[lo : lo + 5000]
                yield _row([g] * len(p), [r[0] for r in p], [r[1] for r in p], [len(rare) << 32 | len(u)] * len(p), [r[2] for r in p])

    return run


def level(p: np.ndarray) -> np.ndarray:
    """Bin of a probability: 0 for none, else by its logarithm to base RATIO."""
    out = np.zeros(len(p), np.int64)
    some = p > 0
    out[some] = np.clip(np.floor(np.log(p[some]) / np.log(RATIO)).astype(np.int64) + BINS - 1, 1, BINS - 1)
    return out


def context_bucket(n: np.ndarray) -> np.ndarray:
    """0 for a predecessor that was never seen, else by the logarithm of its count."""
    return np.where(n > 0, np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64) + 1, 41), 0)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts to the groups that asked, bucket by bucket; to the held-out groups also the held-out counts."""

    def answers(rows: list[tuple]) -> Iterator[tuple]:
        known = [(np.frombuffer(blob, np.uint64), np.frombuffer(n, np.int64), np.frombuffer(dev, np.int64)) for _, kind, _, _, blob, n, dev in rows if kind == COUNTS]
        for g, kind, b, tag, blob, _, _ in rows:
            if kind == WORDS:
                h = unpacked_keys(blob)[0]
                n, dev = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
                for kh, kn, kd in known:
                    at = np.searchsorted(kh, h)
                    at[at == len(kh)] = 0
                    n += np.where(kh[at] == h, kn[at], 0)
                    dev += np.where(kh[at] == h, kd[at], 0)
                yield g, WORDS, b, tag, packed_counts(n)
                if g & 1:
                    yield g, WORDS + HELD, b, tag, packed_counts(dev)
        pairs = []
        for g, kind, b, tag, blob, _, _ in rows:
            if kind == PAIRS:
                h, at = unpacked_keys(blob)
                pairs.append((g, b, tag, h, unpacked_counts(blob[at:])))
        if not pairs:
            return
        _, inv = np.unique(np.concatenate([p[3] for p in pairs]), return_inverse=True)
        own = np.concatenate([p[4] for p in pairs])
        n = np.bincount(inv, weights=own).astype(np.int64)
        own[np.repeat([not p[0] & 1 for p in pairs], [len(p[3]) for p in pairs])] = 0
        dev = np.bincount(inv, weights=own).astype(np.int64)
        at = 0
        for g, b, tag, h, _ in pairs:
            place = inv[at : at + len(h)]
            yield g, PAIRS, b, tag, packed_counts(n[place])
            if g & 1:
                yield g, PAIRS + HELD, b, tag, packed_counts(dev[place])
            at += len(h)

    def buckets() -> Iterator[tuple]:
        held: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and r[2] != held[0][2]:
                    yield from answers(held)
                    held = []
                held.append(r)
        if held:
            yield from answers(held)

    rows, size = [], 0
    for r in buckets():
        rows.append(r)
        size += len(r[4])
        if size > 1 << 20 or len(rows) >= 5000:
            yield _row(*map(list, zip(*rows, strict=True)))
            rows, size = [], 0
    if rows:
        yield _row(*map(list, zip(*rows, strict=True)))


def packed_counts(n: np.ndarray) -> bytes:
    """Most counts are small: 16 bits, or 65535 and the count in 64 bits behind all."""
    small = np.minimum(n, 65535).astype(np.uint16)
    return len(n).to_bytes(8, "little") + small.tobytes() + n[n >= 65535].tobytes()


def unpacked_counts(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    n = np.frombuffer(blob, np.uint16, size, 8).astype(np.int64)
    if len(blob) > 8 + 2 * size:
        n[n == 65535] = np.frombuffer(blob, np.int64, -1, 8 + 2 * size)
    return n


def expectation_maximisation(bucket: np.ndarray, pair: np.ndarray, word: np.ndarray, count: np.ndarray, uniform: float, rounds: int = 200) -> np.ndarray:
    """Weights (pair, word, uniform) of each context bucket, by EM on held-out counts: ``count`` held-out tokens whose estimates from the fitted part are ``pair`` and ``word``."""
    out = np.tile(np.array([0.6, 0.3, 0.1]), (64, 1))
    learned = sorted(set(bucket.tolist()))
    for b in learned:
        own = bucket == b
        p = np.column_stack([pair[own], word[own], np.full(own.sum(), uniform)])
        n = count[own].astype(float)
        lam = out[b].copy()
        for _ in range(rounds):
            mixed = p * lam
            mixed /= mixed.sum(1, keepdims=True)
            new = np.maximum((mixed * n[:, None]).sum(0) / n.sum(), 1e-6)
            new /= new.sum()
            done = np.abs(new - lam).max() < 1e-7
            lam = new
            if done:
                break
        out[b] = lam
    for b in range(64):  # a bucket without held-out counts takes the nearest one's weights
        if learned and b not in learned:
            out[b] = out[min(learned, key=lambda x: (abs(x - b), x))]
    return out


def _tokens(held):
    """Each group's tokens by number, packed by bytes of equal weight, and the hashes of its rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import struct

        for g, x in groups(batches):
            number, rare = numbered(x, held.value)
            u = len(pair_keys(number, x.ends, rare, held.value)[1])
            planes = [((number >> s) & 0xFF).astype(np.uint8).tobytes() for s in (0, 8, 16, 24)]
            ids = np.array([0 if i is None else i for i in x.ids], np.int64)
            null = np.array([i is None for i in x.ids], np.uint8)
            packed = [pa.compress(p, codec="zstd", asbytes=True) for p in (*planes, x.ends.tobytes(), ids.tobytes(), null.tobytes())]
            packed.append(packed_keys(rare))
            head = struct.pack("<qq8q", len(number), len(x.ends), *map(len, packed))
            yield _row([g], [TOKENS], [0], [len(rare) << 32 | u], [head + b"".join(packed)])

    return run


@dataclass
class Answered:
    """A group's tokens and their predecessors by number, places of their pairs, ends of its texts, ids; counts by number and of the pairs."""

    number: np.ndarray
    before: np.ndarray
    inv: np.ndarray
    ends: np.ndarray
    ids: pa.Array
    count: np.ndarray
    count2: np.ndarray

    @staticmethod
    def of(tokens: tuple, answers: list[tuple], v: Vocabulary, fit: bool) -> Answered:
        """``fit`` leaves the held-out part of the counts away."""
        import struct

        tag, blob = tokens
        n, docs, *sizes = struct.unpack_from("<qq8q", blob)
        at, parts = struct.calcsize("<qq8q"), []
        for size, raw in zip(sizes, (n, n, n, n, 8 * docs, 8 * docs, docs, None), strict=True):
            parts.append(blob[at : at + size] if raw is None else pa.decompress(blob[at : at + size], raw, codec="zstd", asbytes=True))
            at += size
        number = sum(np.frombuffer(p, np.uint8).astype(np.int64) << s for p, s in zip(parts[:4], (0, 8, 16, 24), strict=True))
        ends, rare = np.frombuffer(parts[4], np.int64), unpacked_keys(parts[7])[0]
        if any(a[2] != tag for a in answers):
            raise RuntimeError("the input changed between two passes: write it to a table first")
        before, u, inv = pair_keys(number, ends, rare, v)

        def counts(kind: int, size: int) -> np.ndarray:
            own = {a[1]: a[3] for a in answers if a[0] == kind}
            out = np.concatenate([np.zeros(0, np.int64), *(unpacked_counts(own[b]) for b in sorted(own))])
            if len(out) != size:
                raise RuntimeError("answers are missing")
            return out

        rare_n, count2 = counts(WORDS, len(rare)), counts(PAIRS, len(u))
        if fit:
            rare_n, count2 = rare_n - counts(WORDS + HELD, len(rare)), count2 - counts(PAIRS + HELD, len(u))
        start = v.docs - v.dev_docs if fit else v.docs
        ids = pa.array(np.frombuffer(parts[5], np.int64), mask=np.frombuffer(parts[6], np.uint8).astype(bool))
        return Answered(number, before, inv, ends, ids, np.concatenate([v.n - v.dev if fit else v.n, [start], rare_n]), count2)


def _each(one):
    """``one`` of each group's tokens and answers, which come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, answers = None, None, []
        for batch in batches:
            for g, kind, b, tag, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != now:
                    if tokens:
                        yield one(tokens, answers)
                    now, tokens, answers = g, None, []
                if kind == TOKENS:
                    tokens = (tag, blob)
                else:
                    answers.append((kind, b, tag, blob))
        if tokens:
            yield one(tokens, answers)

    return run


CELLS = "cell long, w long, pair double, word double"


def _cells(held):
    """Table of the EM from held-out groups: held-out tokens with like contexts and estimates, their number and the sums of their estimates."""

    def one(tokens: tuple, answers: list[tuple]) -> pa.RecordBatch:
        v: Vocabulary = held.value
        x = Answered.of(tokens, answers, v, True)
        total = x.count[x.before]
        p2 = x.count2[x.inv] / np.maximum(total, 1)
        p1 = x.count[x.number] / max(1, v.tokens - v.dev_tokens)
        c, at, n = np.unique((context_bucket(total) * BINS + level(p2)) * BINS + level(p1), return_inverse=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(np.bincount(at, weights=p2)), pa.array(np.bincount(at, weights=p1))], ["cell", "w", "pair", "word"])

    return _each(one)


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(held, weights):
    def one(tokens: tuple, answers: list[tuple]) -> pa.RecordBatch:
        v: Vocabulary = held.value
        x = Answered.of(tokens, answers, v, False)
        count, total = x.count[x.number].astype(float), x.count[x.before]
        base = np.log10((count + 0.5) / (v.tokens + 0.5 * (v.words + 1)))
        lam = weights.value[context_bucket(total)]
        p = lam[:, 0] * x.count2[x.inv] / np.maximum(total, 1) + lam[:, 1] * count / max(1, v.tokens) + lam[:, 2] / (v.words + 1)
        starts = np.concatenate([[0], x.ends[:-1]])
        add = lambda a: np.add.reduceat(a, starts)
        return pa.RecordBatch.from_arrays(
            [x.ids, pa.array(x.ends - starts), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(x.ends), v.tokens, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))],
            ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return _each(one)


def score_texts(docs: DataFrame, fold: F.Column, id_col: str = "doc_id", text_col: str = "text", frequent: float = FREQUENT) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    The model mixes three maximum-likelihood estimates: of the word after its predecessor, of the word alone, and the uniform one over
    the training words and one more. Every word is a predecessor and a successor of its own, however rare. The weights depend on a bucket of the predecessor's own count and are learned by
    expectation-maximisation on the training documents with fold 0, whose estimates come from the counts of the other training documents; held-out tokens of one bucket whose
    estimates differ by less than RATIO share a row of its table, with their mean estimates. The final counts are
    those of all training documents (fold neither 1 nor null).

    All counts cover all documents. Documents go in groups of about GROUP bytes; a group asks for the counts of its distinct rare words
    and pairs of neighbours at the tasks that own those hashes (64 bits) and gets them back, so that only
    distinct entries move, a hot word or pair moves once a group, and a task holds a few groups. The counts of the words above the share ``frequent`` of
    all tokens, at most 1 / ``frequent`` words, are broadcast instead; the share changes no score. Held-out documents make groups of their own, which alone are read for the weights.

    A null text counts as empty: one token, the end. Rows that repeat are documents each. Rows with a null id are scored but not learned from. An
    empty table gives no rows; other columns are ignored. The input is read three times, its held-out documents once more, and must be the same each time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    steady_scans(spark)
    n = partitions(spark)
    buckets = 4 * n
    src = docs.select(F.col(id_col).cast("long").alias("id"), fold.cast("int").alias("fold"), F.col(text_col).cast("string").alias("text"))
    if any(x in src._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Sample", "InMemory", "MapIn", "Python", "Pandas")):
        src = cut(src)  # only a plain scan is the same each time
    counts = cut(src.mapInArrow(tidy(_count(buckets)), ROW).repartition(n, "bucket").mapInArrow(tidy(_sum(buckets)), SUMMED))
    tokens, dev_tokens, words = counts.agg(F.sum("tokens"), F.sum("dev_tokens"), F.sum("words")).first()
    tokens, dev_tokens, words = tokens or 0, dev_tokens or 0, words or 0
    docs_n, dev_n = src.agg(F.count(F.when(F.col("fold") != 1, 1)), F.count(F.when(F.col("fold") == 0, 1))).first()

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["hashes", "n", "dev"]).to_pylist():
                h, c, d = (np.frombuffer(r[k], np.int64) for k in ("hashes", "n", "dev"))
                keep = c >= max(1, frequent * tokens)
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, c, d)], ["h", "n", "dev"])

    top = counts.mapInArrow(tidy(often), "h long, n long, dev long").toPandas()
    order = np.argsort(top["h"].to_numpy(np.int64).view(np.uint64)) if len(top) else np.zeros(0, int)
    col = lambda k: top[k].to_numpy(np.int64)[order]
    v = Vocabulary(col("h").view(np.uint64), col("n"), col("dev"), tokens, dev_tokens, words, docs_n, dev_n)
    held = spark.sparkContext.broadcast(v)
    asked = src.mapInArrow(tidy(_ask(held, buckets)), ROW).withColumn("n", F.lit(None).cast("binary")).withColumn("dev", F.lit(None).cast("binary"))
    owned = counts.select(F.lit(0).cast("long").alias("g"), F.lit(COUNTS).alias("kind"), "bucket", F.lit(0).cast("long").alias("tag"), F.col("hashes").alias("blob"), "n", "dev")
    answers = cut(asked.unionByName(owned).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_answer), ROW))

    def together(own: DataFrame, told: DataFrame) -> DataFrame:
        # the scan comes first in a union: a group's number holds the number of its scan partition
        return own.mapInArrow(tidy(_tokens(held)), ROW).unionByName(told).repartition(n, "g").sortWithinPartitions("g")

    dev = together(src.where("fold = 0"), answers.where("g % 2 = 1")).mapInArrow(tidy(_cells(held)), CELLS)
    cells = dev.groupBy("cell").agg(F.sum("w").alias("w"), F.sum("pair").alias("pair"), F.sum("word").alias("word")).toPandas().sort_values("cell")
    cell, w = cells["cell"].to_numpy(np.int64), cells["w"].to_numpy(float)
    lam = expectation_maximisation(cell // BINS**2, cells["pair"].to_numpy(float) / w, cells["word"].to_numpy(float) / w, w, 1 / (v.words + 1))
    weights = spark.sparkContext.broadcast(lam)
    return together(src, answers.where(F.col("kind") < HELD)).mapInArrow(tidy(_score(held, weights)), SCORES)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(doc_id) mod 5 is not 1; those with remainder 1 are held out. A null id is not held out."""
    fold = crc_fold("doc_id", 5)
    out = score_texts(table(spark, sf_dir, "documents"), fold)
    return out.withColumn("held_out", F.coalesce(fold == 1, F.lit(False)))
