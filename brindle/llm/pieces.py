"""SentencePiece encoding and decoding of merge-type vocabularies (operator 4)."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import default_tokenizer, small_batches, table, texts, tidy

SPACE = "▁"
#: Entries of the memo of one task; it starts anew beyond that.
MEMO = 450_000
#: Symbols up to which the agenda is a list; the place of a pair that is no piece.
SHORT, NO_PIECE = 32, 1 << 62
CANDIDATE_PUNCTUATION = ".,!?#$*&|;:"


class PieceEncoder:
    """Encodes whole texts by an agenda of adjacent symbol pairs in order of score.

    Merges never cross a place that no piece of the vocabulary spans: before a space symbol that follows another character, around
    a line end, and between a letter and certain punctuation. Those places are computed from the vocabulary; the
    text is cut there and each part is encoded by the agenda, once for each distinct part (memo). Every part that the agenda
    encodes is checked against the library, a batch at a time, and so is one whole text of each batch.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids, score, self.bytes = {}, {}, {}
        spans: set[tuple[str, str]] = set()
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[p], score[p] = i, sp.get_score(i)
                spans.update(zip(p, p[1:], strict=False))
        place = {x: k for k, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: place[x] for p, x in score.items()}  # equal scores have one place
        if len(self.bytes) != 256 or sp.normalize("ﬁ  x ") != f"{SPACE}ﬁ{SPACE}{SPACE}x{SPACE}":
            raise ValueError("a merge-type vocabulary with byte fallback and without text normalisation is needed")
        if any(b == SPACE and a != SPACE for a, b in spans):
            self.parts = re.compile(r"(?s).+")
        else:
            stop = "".join(p for p in CANDIDATE_PUNCTUATION if not any(b == p and a.isalpha() for a, b in spans))
            ahead = f"(?=[{re.escape(stop)}])" if stop else "(?!)"
            if any("\n" in x for x in spans):
                self.parts = re.compile(rf" *[^\W\d_]+{ahead}| *[^ ]+| +")
            else:
                self.parts = re.compile(rf" *[^\W\d_]+{ahead}| *[^ \n]+| +|\n")

    def agenda(self, text: str) -> list[int]:
        """Merge the adjacent pair with the best score, the leftmost of equals, until no pair is a piece. The agenda of a short text is a list of places, searched for the best; that of a longer one a heap."""
        sym = list(text.replace(" ", SPACE))
        return self._ids(self._by_list(sym) if len(sym) <= SHORT else self._by_heap(sym))

    def _by_list(self, sym: list[str]) -> list[str]:
        place = self.rank.get
        agenda = [place(x, NO_PIECE) for x in map(add, sym, sym[1:])]
        while agenda:
            best = min(agenda)
            if best == NO_PIECE:
                break
            i = agenda.index(best)
            pair = sym[i] = sym[i] + sym.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = place(pair + sym[i + 1], NO_PIECE)
            if i:
                agenda[i - 1] = place(sym[i - 1] + pair, NO_PIECE)
        return sym

    def _by_heap(self, sym: list[str]) -> list[str]:
        n = len(sym)
        rank, shift = self.rank.get, n.bit_length()
        low = (1 << shift) - 1
        # an entry of the agenda is one whole number: place of the score, then place of the left symbol
        heap = [r << shift | i for i, r in enumerate(map(rank, map(add, sym, sym[1:]))) if r is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = pop(heap)
            i = entry & low
            j = after[i]
            if not sym[i] or j >= n:
                continue
            pair = sym[i] + sym[j]
            if rank(pair) != entry >> shift:
                continue  # one of the two has changed since
            sym[i], sym[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank(pair + sym[k])
                if r is not None:
                    push(heap, r << shift | i)
            k = before[i]
            if k >= 0:
                r = rank(sym[k] + pair)
                if r is not None:
                    push(heap, r << shift | k)
        return [s for s in sym if s]

    def _ids(self, sym: list[str]) -> list[int]:
        """Ids of symbols; one that is no piece gives those of its bytes."""
        out = list(map(self.ids.get, sym))
        if None in out:
            out = [i for s, at in zip(sym, out, strict=True) for i in ([at] if at is not None else [self.bytes[b] for b in s.encode()])]
        return out

    def encode(self, batch: list[str], memo: dict[str, tuple[list[int], str]] | None = None) -> Iterator[tuple[list[int], str]]:
        """Ids of each text, and the same as decimal text joined by commas. ``memo`` keeps parts from batch to batch of a task."""
        memo = {} if memo is None else memo
        if len(memo) > MEMO:
            memo.clear()
        find = self.parts.findall
        tiny = [t for t in batch if t]
        if tiny:
            check = min(tiny, key=len)
            if [i for p in find(" " + check.replace(SPACE, " ")) for i in self.agenda(p)] != self.sp.encode(check):
                raise RuntimeError(f"the library encodes this text otherwise: {check[:200]!r}")
        cut = [find(" " + text.replace(SPACE, " ")) if text else [] for text in batch]  # a space symbol in a text counts as a space
        new = list({p for parts in cut for p in parts if p not in memo})
        long: dict[str, tuple[list[int], str]] = {}
        if new:
            own = {}
            for p in new:
                ids = self.agenda(p)
                own[p] = (ids, ",".join(map(str, ids)))
            self.check(new, own)
            for p, v in own.items():
                (memo if len(p) <= 64 else long)[p] = v
        for parts in cut:
            got = [memo[p] for p in parts] if not long else [memo[p] if p in memo else long[p] for p in parts]
            yield list(chain.from_iterable([x[0] for x in got])), ",".join([x[1] for x in got])

    def check(self, parts: list[str], own: dict[str, tuple[list[int], str]]) -> None:
        """Against the library. It puts a space before a text, so a part without its own is asked for after a line end, whose bytes are known."""
        asked = [p[1:] if p[0] == " " and len(p) > 1 else "\n" + p for p in parts]
        head = self.agenda(" \n")
        for p, q, ids in zip(parts, asked, self.sp.encode(asked, num_threads=1), strict=True):
            want = ids if q[0] != "\n" or p[0] == " " and len(p) > 1 else ids[len(head) :]
            if want != own[p][0]:
                raise RuntimeError(f"the library encodes this part otherwise: {p[:200]!r}")


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(model_file: str) -> PieceEncoder:
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = PieceEncoder(model_file)
    return _ENCODERS[model_file]


def encode_texts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` and ``decoded`` of every whole text.

    One row per input row, repeats included; a null text counts as empty (no ids, empty decoded text); other columns are ignored. Very
    long texts are encoded whole. No shuffle: a task holds one Arrow batch and a bounded memo. A disagreement with the library stops the job.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, memo = encoder(model_file), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                whole = [x.decode() for x in texts(part.column(1))]
                got = list(enc.encode(whole, memo))
                back = enc.sp.decode([g[0] for g in got]) if got else []
                cols = [part.column(0), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got], pa.string()), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols += [pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array(back, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), default_tokenizer("piece_bpe_32k.model"), ids=False)
