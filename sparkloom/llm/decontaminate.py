"""Benchmark decontamination with a generalised suffix automaton (operator 7).

The items' words build one automaton; each document's words stream through it
in the task that reads them, so nothing is shuffled.  After every word the
automaton holds the longest match that ends there; from a match of at least
``window`` words its suffix links lead to the state of the last ``window``
words, and that state knows its items.  The automaton's size is that of the
benchmark: items are dealt into shards of about ``SHARD_BYTES`` of text, one
scan of the documents a shard, and the spans of all shards are merged.  The
benchmark's texts pass through the driver, which holds all shards' items.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import column, extended, map_arrow, restored, with_rest

WINDOW = 10
MAX_COVERAGE = 0.5
SHARD_BYTES = 1 << 20

_UPPER = range(0x41, 0x5B)
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z to a-z; every byte that is in no word to a space.
_WORDS = bytes(c + 32 if c in _UPPER else c if c in _KEEP else 32 for c in range(256))
_WORD_AT = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class Automaton:
    """Generalised suffix automaton over the words of items; items of fewer than ``window`` words count as a whole."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]
        #: equal items are one text with several names
        self.names: list[set] = []
        texts: dict[tuple, int] = {}
        for name, words in items:
            if words:
                text = texts.setdefault(tuple(words), len(self.names))
                if text == len(self.names):
                    self.names.append(set())
                self.names[text].add(name)
        ends = [self._add(words) for words in texts]
        #: of each state: the whole short items that end there, as (words, text)
        self.short: dict[int, list[tuple[int, int]]] = {}
        for (words, text), end in zip(texts.items(), ends, strict=True):
            if len(words) < window:
                self.short.setdefault(end, []).append((len(words), text))
        #: of each state: the nearest on its way of suffix links that has short items, or -1; the state of its last ``window`` words
        self.near = [-1] * len(self.next)
        self.at_window = [0] * len(self.next)
        for v in sorted(range(len(self.next)), key=self.length.__getitem__)[1:]:
            up = self.link[v]
            self.near[v] = v if v in self.short else self.near[up]
            self.at_window[v] = 0 if self.length[v] < window else v if self.length[up] < window else self.at_window[up]
        self.items: dict[int, set] = {}
        for words, text in texts.items():
            v, n = 0, 0
            for w in words:
                v, n = self._step(v, n, w)
                if n >= window:
                    self.items.setdefault(self.at_window[v], set()).add(text)

    def _new(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The state of p's words and w, which may be a part of q's."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = part
            p = self.link[p]
        return part

    def _add(self, words: list[bytes]) -> int:
        last = 0
        for w in words:
            p = last
            if w in self.next[p]:
                last = self._split(p, w, self.next[p][w])
                continue
            new = self._new(self.length[last] + 1, 0, {})
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, w, self.next[p][w])
            last = new
        return last

    def _step(self, v: int, n: int, w: bytes) -> tuple[int, int]:
        while v and w not in self.next[v]:
            v = self.link[v]
            n = self.length[v]
        to = self.next[v].get(w)
        return (to, n + 1) if to is not None else (0, 0)

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set, int]:
        """Merged spans [start, end) of hit words, the items' names, the longest match."""
        step, window, short, near = self._step, self.window, self.short, self.near
        root, v, n, longest = self.next[0], 0, 0, 0
        spans: list[list[int]] = []
        found: set = set()
        seen: set = set()
        for i, w in enumerate(words):
            if not v:
                v = root.get(w, 0)
                n = 1 if v else 0
                if not v:
                    continue
            else:
                v, n = step(v, n, w)
            if n > longest:
                longest = n
            size = 0
            if n >= window:
                size = window
                at = self.at_window[v]
                if at not in seen:
                    seen.add(at)
                    found |= self.items.get(at, set())
            # items of fewer words than the window: so many different ones at most end here
            u = near[v]
            while u >= 0:
                for m, text in short[u]:
                    if m <= n:
                        found.add(text)
                        size = max(size, m)
                u = near[self.link[u]]
            if size:
                start = i + 1 - size
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return spans, set().union(*(self.names[text] for text in found)), longest


_built: dict[str, Automaton] = {}


def _automaton(key: str, items: list[tuple[str | None, bytes]], window: int) -> Automaton:
    """A worker process keeps the automaton it built last."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton([(name, words_of(text)) for name, text in items], window)
    return _built[key]


FOUND = "n_words long, spans array<array<int>>, items array<string>, longest int"


Then = tuple[Callable[[pa.RecordBatch], pa.RecordBatch], StructType]


def _scan(docs: DataFrame, items: list[tuple[str | None, bytes]], window: int, then: Then | None = None) -> DataFrame:
    """doc_id, text, rest and what the automaton of ``items`` finds; ``then`` is a further step in the same pass and its schema."""
    key = hashlib.sha256(repr((window, items)).encode()).hexdigest()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = _automaton(key, items, window)
        found = []
        for text in column(batch, "text"):
            words = words_of(text)
            found.append((len(words), *automaton.scan(words)))
        arrays = [
            pa.array([f[0] for f in found], pa.int64()),
            pa.array([f[1] for f in found], pa.list_(pa.list_(pa.int32()))),
            pa.array([sorted(x for x in f[2] if x is not None) for f in found], pa.list_(pa.string())),
            pa.array([f[3] for f in found], pa.int32()),
        ]
        out = pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "n_words", "spans", "items", "longest"])
        return then[0](out) if then else out

    return map_arrow(docs, step, then[1] if then else extended(docs, FOUND))


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, then: Then | None = None) -> DataFrame:
    """One row per input row: doc_id, text (binary), rest (a struct of the other columns), n_words, spans (word positions
    [start, end), merged), items (ids as strings, sorted), longest (words of the longest match).

    Null texts have no words; items without words match nothing; repeated
    items count once by id; an item with a null id hits but isn't listed.  An
    empty benchmark finds nothing; an empty table gives an empty result.
    ``then`` is applied to what was found in the same pass.
    """
    rows = with_rest(docs)
    own = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("binary").alias("item")).where(F.length("item") > 0)
    total = own.agg(F.sum(F.length("item"))).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    dealt = own.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))

    def items(k: int) -> list:
        return sorted(((r["name"], bytes(r["item"])) for r in dealt.where(F.col("shard") == k).collect()), key=repr)

    if shards == 1:
        return _scan(rows, items(0), window, then)
    keyed = rows.withColumn("key", F.sha2(F.coalesce("text", F.lit(b"")), 256))
    found = None
    for k in range(shards):
        one = _scan(keyed.select("doc_id", "key", "text"), items(k), window).drop("text").where((F.size("spans") > 0) | (F.col("longest") > 0))
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("key").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
    joined = keyed.join(merged, "key", "left").drop("key")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [_merge(s or []) for s in column(batch, "spans")]
        counts = [len(words_of(t)) for t in column(batch, "text")]
        items_ = [x or [] for x in column(batch, "items")]
        longest = [x or 0 for x in column(batch, "longest")]
        arrays = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "rest")]
        arrays += [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items_, pa.list_(pa.string())), pa.array(longest, pa.int32())]
        out = pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "rest", "n_words", "spans", "items", "longest"])
        return then[0](out) if then else out

    return map_arrow(joined, step, then[1] if then else extended(rows, FOUND))


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def remove_spans(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the given words and what stands between them."""
    at = [m.span() for m in _WORD_AT.finditer(text)]
    out, done = [], 0
    for start, end in spans:
        out.append(text[done : at[start][0]])
        done = at[end - 1][1]
    return b"".join([*out, text[done:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The documents with their columns, benchmark spans cut from the text; documents with a larger share of hit words than
    ``max_coverage`` go.  n_chars, where there is one, follows the text.

    Null texts become empty and stay.  Repeated rows are cut alike.  An empty
    table gives an empty one, an empty benchmark changes nothing else.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, cleaned = [], []
        for text, n, spans in zip(column(batch, "text"), column(batch, "n_words"), column(batch, "spans"), strict=True):
            keep.append(sum(e - s for s, e in spans) <= max_coverage * n)
            cleaned.append(remove_spans(text, spans) if spans else text or b"")
        out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(cleaned, pa.binary()).cast(pa.string()), batch.column(batch.schema.get_field_index("rest"))], ["doc_id", "text", "rest"])
        return out.filter(pa.array(keep))

    own = StructType.fromDDL("doc_id long, text string").add(with_rest(docs).schema["rest"])
    return restored(find_spans(docs, benchmark, window, (step, own)), docs)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s[1] - s[0]).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


_LIST = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_LIST} AS w FROM documents), b AS (SELECT item_id, {_LIST} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
place AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), sizes WHERE i + size - 1 <= len(w)),
met AS (SELECT place.doc_id, i, place.size AS size, item_id FROM place JOIN win ON place.size = win.size AND place.run = win.run),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM met)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id
"""
