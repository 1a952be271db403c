"""SentencePiece encoding and decoding with seeded merge-dropout (operator 2).

A BPE model merges neighbouring symbols in the order of its pieces' scores.
Here every candidate merge that comes up in the agenda is skipped when a keyed
hash of (seed, doc_id, place of the chunk in the document, place in the chunk,
piece) falls under the dropout rate, so the same key always gives the same
segmentation, and each occurrence of a word in a document has a draw of its
own.  At rate 0 the result is the library's own.

No piece of a BPE model with split white space has a space after a letter, so
the chunks between blanks are merged independently, many at a time: numpy takes
the best candidate of every chunk's agenda, draws its hash, and merges or skips
it, until no agenda has any left.  Nothing is remembered from one chunk to the
next, so memory is bounded by ``WINDOW`` characters of text; chunks of over
``LONG`` characters go one by one through a heap.  Ids decode to the very same
text: characters without a piece go as bytes, the mark for spaces itself
included.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import column, map_arrow, mix64

DROPOUT, SEED = 0.1, 20
LONG = 64  # characters; longer chunks are merged by a heap, whose time does not grow with the square of the length
WINDOW = 1 << 19  # characters whose symbols are held at once, unless one chunk is longer
ROWS = 1 << 13  # chunks merged together
SLICE = 1000  # rows that a worker holds as lists of ids at once
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, LONG)

_SPACE = "▁"
_CHUNK = re.compile(r" *[^ \n]+| +|\n")
_NEVER = np.int32(0x7FFFFFFF)
_SYMBOL_BITS = 21
_EDGE = (1 << _SYMBOL_BITS) - 1  # stands beside the first and the last symbol of a chunk
_BY_RANK, _BY_PLACE, _MIX, _STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0xD1B54A32D192ED03
_MASK = (1 << 64) - 1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pairs:
    """(left symbol, right symbol) -> merged piece, as a perfect hash: each bucket of keys has a displacement without collisions."""

    def __init__(self, left: np.ndarray, right: np.ndarray, piece: np.ndarray, cost: np.ndarray):
        keys = left.astype(np.int64) << _SYMBOL_BITS | right
        self.bits = max(int(len(keys) * 2).bit_length(), 4)
        for self.factor in (np.uint64(f) for f in range(_BY_PLACE, _MASK, 2 * 0x1000_0001)):
            if self._place(keys, piece, cost):
                return

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys.astype(np.uint64) * self.factor
        return (h >> np.uint64(50)).astype(np.int64), (h >> np.uint64(50 - self.bits)).astype(np.int64) & (1 << self.bits) - 1

    def _place(self, keys: np.ndarray, piece: np.ndarray, cost: np.ndarray) -> bool:
        size = 1 << self.bits
        self.move, self.keys = np.zeros(1 << 14, np.int64), np.full(size, -1, np.int64)
        self.piece, self.cost = np.zeros(size, np.int32), np.full(size, _NEVER, np.int32)
        bucket, base = self._slots(keys)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(len(self.move) + 1))
        draws = np.random.default_rng(5).permutation(size)
        for b in np.argsort(-np.diff(ends), kind="stable").tolist():
            own = order[ends[b] : ends[b + 1]]
            if not len(own):
                break
            at = base[own]
            if len(np.unique(at)) < len(at):
                return False
            for lo in range(0, size, 64):
                free = (self.keys[at[None, :] ^ draws[lo : lo + 64, None]] < 0).all(1)
                if free.any():
                    self.move[b] = draws[lo + int(free.argmax())]
                    break
            else:
                return False
            self.keys[at ^ self.move[b]] = keys[own]
            self.piece[at ^ self.move[b]] = piece[own]
            self.cost[at ^ self.move[b]] = cost[own]
        return True

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged piece and its cost, _NEVER where the two don't merge."""
        keys = left.astype(np.int64) << _SYMBOL_BITS | right
        bucket, at = self._slots(keys)
        at ^= self.move.take(bucket)
        return self.piece.take(at), np.where(self.keys.take(at) == keys, self.cost.take(at), _NEVER)


class Pieces:
    """The vocabulary of a model file: symbols and their merges, ids of bytes, bytes of ids."""

    def __init__(self, path: str):
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank, self.byte, self.surface = {}, {}, []
        usual = []
        for i in range(own.get_piece_size()):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif own.is_control(i) or own.is_unknown(i) or own.is_unused(i):
                self.surface.append(b"")
            else:
                usual.append((-own.get_score(i), i, piece))
                self.surface.append(piece.replace(_SPACE, " ").encode())
        if len(self.byte) != 256 or any(_SPACE in p.lstrip(_SPACE) for _, _, p in usual):
            raise ValueError("needs a model with byte fallback whose pieces have spaces at their start only")
        if len(self.surface) > 1 << 19:
            raise ValueError("needs a model of at most 524288 pieces")
        self.rank = {piece: i for _, i, piece in usual}
        # merges by score; equal scores by place in the word alone, as the library does
        costs = {c: k for k, c in enumerate(sorted({c for c, _, _ in usual}))}
        self.order = {piece: costs[c] for c, _, piece in usual}
        self.array = pa.array(self.surface, pa.binary())
        # symbols: pieces, then characters that only have a place in pieces, then all others by code point
        inner = sorted({c for p in self.rank for c in p} - self.rank.keys())
        symbol = self.rank | {c: len(self.surface) + k for k, c in enumerate(inner)}
        self.inner = np.array([ord(c) for c in inner], np.int64)
        self.others = len(self.surface) + len(inner)
        self.by_code = np.arange(0x110000, dtype=np.int32) + np.int32(self.others)
        for c, s in symbol.items():
            if len(c) == 1 and c != _SPACE:
                self.by_code[ord(c)] = s
        self.by_code[ord(" ")] = symbol.get(_SPACE, self.others + ord(" "))
        splits = [(symbol[p[:k]], symbol[p[k:]], i, self.order[p]) for p, i in self.rank.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.pairs = Pairs(*(np.array([s[k] for s in splits]) for k in range(4)))
        with np.errstate(over="ignore"):
            self.by_rank = np.arange(len(self.surface), dtype=np.uint64) * np.uint64(_BY_RANK)
            self.places = np.arange(LONG + 2, dtype=np.uint64) * np.uint64(_BY_PLACE)
        self.byte_ids = np.array([self.byte[b] for b in range(256)], np.int32)

    def heap(self, symbols: np.ndarray, base: int, dropout: float) -> np.ndarray:
        """Merge one chunk by a heap; ``base`` is its key, mixed.  Gives a symbol where one starts and -1 elsewhere."""
        parts, n, limit = symbols.tolist(), len(symbols), int(dropout * (1 << 32))
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(at: list[int]) -> None:
            at = [i for i in at if i >= 0 and after[i] < n]
            piece, cost = self.pairs.find(np.array([parts[i] for i in at], np.int64), np.array([parts[after[i]] for i in at], np.int64))
            for i, p, c in zip(at, piece.tolist(), cost.tolist(), strict=True):
                if c != _NEVER:
                    heapq.heappush(agenda, (c, i, p, parts[i], parts[after[i]]))

        offer(list(range(n - 1)))
        while agenda:
            _, i, piece, left, right = heapq.heappop(agenda)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            if limit and (base ^ piece * _BY_RANK & _MASK ^ i * _BY_PLACE & _MASK) * _MIX >> 32 & 0xFFFFFFFF < limit:
                continue
            parts[i], parts[j] = piece, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            offer([i, before[i]])
        return np.array(parts, np.int32)

    def merge(self, symbols: np.ndarray, bases: np.ndarray, limit: int) -> np.ndarray:
        """Merge chunks side by side: ``symbols`` (chunk, place) with _EDGE after each chunk's end, ``bases`` their mixed keys.

        Gives a symbol where one starts, -1 where it goes on and _EDGE beyond the end.
        """
        n, width = symbols.shape
        out = symbols.copy()
        w = width + 2
        sym = np.full((n, w), _EDGE, np.int32)
        sym[:, 1:-1] = symbols
        piece, cost = np.zeros((n, w), np.int32), np.full((n, w), _NEVER, np.int32)
        p, c = self.pairs.find(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
        piece[:, 1 : width], cost[:, 1 : width] = p.reshape(n, -1), c.reshape(n, -1)
        place = np.arange(w, dtype=np.int16)
        after, before = np.broadcast_to(place + 1, (n, w)).copy(), np.broadcast_to(place - 1, (n, w)).copy()
        after[:, -1], before[:, 0] = w - 1, 0
        rows = np.arange(n)
        lead = rows * w
        while True:
            flat_sym, flat_piece, flat_cost, flat_after, flat_before = (x.reshape(-1) for x in (sym, piece, cost, after, before))
            i = cost.argmin(1)
            at = lead + i
            open_ = flat_cost.take(at) != _NEVER
            most = np.count_nonzero(open_)
            if most < 0.7 * len(rows):
                # write out the chunks that are done, go on with the others
                out[rows[~open_]] = sym[~open_, 1:-1]
                if not most:
                    return out
                rows, bases = rows[open_], bases[open_]
                sym, piece, cost, after, before = (x[open_] for x in (sym, piece, cost, after, before))
                lead = np.arange(most) * w
                continue
            at = at[open_]
            new = flat_piece.take(at)
            if limit:
                drawn = (bases[open_] ^ self.by_rank.take(new) ^ self.places.take(i[open_] - 1)) * np.uint64(_MIX) >> np.uint64(32)
                skip = drawn < np.uint64(limit)
                flat_cost[at[skip]] = _NEVER
                at, new = at[~skip], new[~skip]
            start = at // w * w
            right = start + flat_after.take(at)
            far = flat_after.take(right)
            flat_sym[at], flat_sym[right], flat_cost[right], flat_after[at] = new, -1, _NEVER, far
            flat_before[start + far] = at - start
            left = start + flat_before.take(at)
            both = np.concatenate([at, left])
            flat_piece[both], flat_cost[both] = self.pairs.find(np.concatenate([new, flat_sym.take(left)]), np.concatenate([flat_sym.take(start + far), new]))

    def _bytes(self, symbols: np.ndarray, reps: np.ndarray) -> np.ndarray:
        """Ids of symbols, of which those that are no pieces go as the ids of their UTF-8 bytes."""
        out = np.repeat(symbols, reps)
        other = np.flatnonzero(symbols >= len(self.surface))
        if len(other):
            first = np.cumsum(reps)[other] - reps[other]
            raw = np.frombuffer("".join(map(chr, self._codes(symbols[other]).tolist())).encode(), np.uint8)
            into = np.repeat(first - (np.cumsum(reps[other]) - reps[other]), reps[other]) + np.arange(len(raw))
            out[into] = self.byte_ids[raw]
        return out

    def _codes(self, symbols: np.ndarray) -> np.ndarray:
        codes = symbols - self.others
        inner = codes < 0
        codes[inner] = self.inner[codes[inner] + len(self.inner)]
        return codes

    def _window(self, texts: list[str], keys: list[int], seen: list[int], dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts joined, how many each has, and its number of chunks.  ``seen``: chunks of its document before it."""
        sizes = np.array([len(t) for t in texts])
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        blank, line = code == 32, code == 10
        start = line.copy()
        start[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
        start[first] = True
        starts = np.flatnonzero(start)
        lengths = np.diff(np.append(starts, len(code)))
        symbols = self.by_code.take(code)
        limit = int(dropout * (1 << 32))
        text_of = np.searchsorted(first, starts, "right") - 1
        chunks = np.bincount(text_of, minlength=len(texts))
        number = np.arange(len(starts)) - np.repeat(np.cumsum(chunks) - chunks, chunks) + np.array(seen)[text_of] + 1
        bases = mix64(np.array(keys, np.uint64)[text_of] + number.astype(np.uint64) * np.uint64(_STEP))
        low = 1
        for width in WIDTHS:
            some = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for lo in range(0, len(some), ROWS):
                own = some[lo : lo + ROWS]
                place = np.arange(width)
                inside = place < lengths[own, None]
                at = np.minimum(starts[own, None] + place, len(code) - 1)
                symbols[at[inside]] = self.merge(np.where(inside, symbols.take(at), _EDGE), bases[own], limit)[inside]
        for k in np.flatnonzero(lengths > LONG).tolist():
            a, b = starts[k], starts[k] + lengths[k]
            symbols[a:b] = self.heap(symbols[a:b], int(bases[k]), dropout)
        left = symbols >= 0
        done = symbols[left]
        reps = np.ones(len(done), np.int64)
        other = done >= len(self.surface)
        if other.any():
            codes = self._codes(done[other])
            reps[other] = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        ends = np.concatenate([[0], np.cumsum(reps)])[np.concatenate([[0], np.cumsum(left)])[first + sizes]]
        return self._bytes(done, reps), np.diff(ends, prepend=0), chunks

    def encode(self, texts: list[str], docs: list[int | None], seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts joined and how many each has; without an id in ``docs`` the text itself is the key."""
        out, counts = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64)
        waiting: list[tuple[int, str, int, int]] = []

        def run() -> np.ndarray:
            ids, sizes, chunks = self._window([w[1] for w in waiting], [w[2] for w in waiting], [w[3] for w in waiting], dropout)
            out.append(ids)
            np.add.at(counts, [w[0] for w in waiting], sizes)
            waiting.clear()
            return chunks

        held = 0
        for k, (text, doc) in enumerate(zip(texts, docs, strict=True)):
            if not text:
                continue
            key = xxhash.xxh3_64_intdigest(f"{seed}:{doc}" if doc is not None else f"{seed}::{text}")
            seen = 0
            for part in _parts(" " + text):
                last = waiting[-1][0] if waiting else None
                if waiting and (held + len(part) > WINDOW or last == k):  # two parts of one text never share a window
                    chunks = run()
                    seen, held = seen + int(chunks[-1]) if last == k else 0, 0
                waiting.append((k, part, key, seen))
                held += len(part)
        if waiting:
            run()
        return np.concatenate(out), counts


def _parts(text: str) -> Iterable[str]:
    """The text in parts of up to half a WINDOW, or of one longer chunk, parted where a chunk starts."""
    most, at = WINDOW // 2, 0
    while len(text) - at > most:
        cut = max(text.rfind(" ", at + 1, at + most), text.rfind("\n", at + 1, at + most))
        while cut > at and text[cut] == " " and text[cut - 1] == " ":
            cut -= 1
        if cut <= at:
            cut = _CHUNK.match(text, at).end()
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encoded(batch: pa.RecordBatch, path: str, seed: int, dropout: float) -> pa.RecordBatch:
    ids, sizes = pieces(path).encode(column(batch, "text"), column(batch, "doc_id"), seed, dropout)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids))
    return pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(sizes)], ["doc_id", "text", "ids", "n_tokens"])


def _decoded(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    lists = batch.column(batch.schema.get_field_index("ids"))
    taken = pieces(path).array.take(lists.flatten())
    ends = np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in lists])]) if lists.null_count else (np.asarray(lists.offsets) - lists.offsets[0].as_py())
    data = memoryview(b"".join(taken.to_pylist())) if len(taken) and taken.offset else memoryview(taken.buffers()[2] or b"")
    at = np.concatenate([[0], np.cumsum(pc.binary_length(taken).to_numpy(zero_copy_only=False))])[ends]
    # the first piece starts with the space that encoding put before the text
    said = [bytes(data[a + 1 : b]).decode() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], [*batch.schema.names, "decoded"])


ENCODED = "doc_id long, text string, ids array<int>, n_tokens long"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, model: str | None = None, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """doc_id, text, ids (array of int), n_tokens.

    Null text counts as empty, which has no ids.  Rows that share doc_id and
    text get the same ids; where doc_id is null, the text is the key in its
    place.  An empty table gives an empty result; other columns are ignored.
    Texts of any length are encoded whole.
    """
    path = model or default_model()
    return map_arrow(_rows(docs), lambda batch: _encoded(batch, path, seed, dropout), ENCODED, SLICE)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``decoded`` added: the text that the ids stand for.  Null or no ids give the empty text; ids outside the model fail."""
    path = model or default_model()
    return map_arrow(encoded, lambda batch: _decoded(batch, path), StructType([*encoded.schema.fields]).add("decoded", StringType()), SLICE)


def round_trip(docs: DataFrame, model: str | None = None, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """``decode`` of ``encode`` in one pass, so that a task needs one Python worker and not two."""
    path = model or default_model()
    return map_arrow(_rows(docs), lambda batch: _decoded(_encoded(batch, path, seed, dropout), path), f"{ENCODED}, decoded string", SLICE)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    done = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select(
        "doc_id", "n_tokens", F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("lossless")
    )
