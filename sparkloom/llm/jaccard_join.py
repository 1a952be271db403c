"""Exact n-gram Jaccard join in metric space (operator 1).

Documents are sets of word shingles under the Jaccard distance.  Documents as
pivots don't part such a space: unrelated texts are all at a distance of
nearly 1 from every pivot, so the triangle inequality excludes nothing.  Two
kinds of pivots do part it:

* Single shingles.  A document lies in the Voronoi region of every shingle it
  holds, at distance 1 - 1/size; a global order (rare before frequent, then by
  hash) breaks the ties and makes one its home.  Its neighbour within the
  radius lacks at most a tenth of its shingles, so replicating a document to
  the regions of its first tenth, plus one, is the window that no linked pair
  escapes: two such documents meet in the region of their first common shingle.
* The empty set within each of 512 slices of the shingle space, under symmetric
  difference: the distance to it is the number of a document's shingles in the
  slice, of which the last bit is kept.  By the triangle inequality documents
  differ by one shingle at least in each slice where these bits do, which
  excludes nearly all unlinked pairs of a region without reading their sets;
  the whole space's empty set gives the window of sizes.  Candidates that pass
  are held against each other once more with as many slices as a set has
  shingles, so that long sets, whose 512 bits say little, are parted too.

Two documents that meet in many regions are a candidate only where the shingles
before the region's differ: their first common region is always such a one.
There the shingles before it are in one set only, which bounds the distance from
below as well.

Recursion: first, documents of one home are held against one pivot document
each, and what links becomes one component.  Then regions that still hold
several components join within themselves, large ones in pairs of blocks, sorted
by size so that memory holds a window of sizes and not a region; each document proposes its nearest
candidates of other components, these are verified on the full sets, components
grow, and the regions join again with more candidates each, until no region
holds back any candidate.  Only proposals are bounded per round, never the
result: the last round holds back nothing.

Equal sets are one class from the start, so copies cost nothing further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import column, cut, discard, joined, map_arrow, mix64, quoted
from .graph import components

WORDS, PERCENT = 3, 90
SLICES = 512
KEPT = 1 << 19  # bytes of text
HOMES = 2
#: Members of a region beyond which it is parted into pairs of blocks, and pairs that a task holds before it keeps the nearest alone.
REGION_ROWS, HELD_PAIRS = 4096, 1 << 18
#: At most so many frequent shingles are put last in the order; they are all that is broadcast, 8 bytes each.
MAX_FREQUENT = 200_000
FREQUENT = 32
#: Ids of documents to verify are broadcast up to this number (32 bytes each), joined by key beyond it.
BROADCAST_IDS = 500_000
PROPOSALS = (2, 16, 256)  # candidates of each document and region, by round; then all

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; those for texts of up to KEPT bytes are kept."""
    if n > KEPT:
        return _powers_to(n)
    if len(_powers[0]) < n:
        _powers[:] = _powers_to(min(KEPT, max(n, 2 * len(_powers[0]), 1 << 14)))
    return _powers[0][:n], _powers[1][:n]


def _powers_to(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return tuple(out)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's shingles; with fewer words the whole sequence is one."""
    if not text:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text.lower(), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    word = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    k = min(words, len(word))
    out = word[: len(word) - k + 1]
    for i in range(1, k):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + word[i : len(word) - k + 1 + i])
    return np.unique(mix64(out + np.uint64(k)))


def least_common(size: int, percent: int = PERCENT) -> int:
    """Shingles that a set of this size shares with any set it links with, at least."""
    return -(-percent * size // 100)


def prefix(own: np.ndarray, frequent: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """The first shingles in the global order, one more than a linked set may lack."""
    n = len(own) - least_common(len(own), percent) + 1
    if frequent is None or not len(frequent):
        return own[:n]
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    late = frequent[at] == own
    return np.concatenate([own[~late][:n], own[late]])[:n] if late.any() else own[:n]


def slices(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of the shingles falls in each slice, as bits."""
    return np.packbits(np.bincount((own >> np.uint64(55)).astype(np.int64), minlength=SLICES).astype(np.uint8) & 1)


def wide_slices(own: np.ndarray) -> bytes:
    """``slices`` by the hashes' low bits, about as many as the set has shingles and SLICES at least."""
    bits = max(SLICES, 1 << max(len(own) - 1, 0).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _most_apart(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that two linked sets of these sizes have in one of them only, at most."""
    # inter >= percent/100 * union and union = na + nb - inter
    return na + nb - 2 * -(-percent * (na + nb) // (100 + percent))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _frequent(rows: DataFrame, words: int, percent: int) -> np.ndarray:
    """Shingles that many documents have among their first, in a plain hash order; counted over all documents."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [prefix(s, None, percent) for t in column(batch, "text") if len(s := shingles(t, words))]
        return pa.RecordBatch.from_arrays([_signed(np.concatenate(found))], ["s"]) if found else None

    counts = cut(map_arrow(rows.select("text"), step, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT), "frequent")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # at most total / limit shingles pass the limit
    limit = max(FREQUENT, -(-total // MAX_FREQUENT))
    return np.sort(np.array([r[0] for r in counts.where(F.col("n") > limit).select("s").collect()], np.int64).view(np.uint64))


PROFILE = "doc_id long, n long, h1 long, h2 long, homes array<long>, first array<long>, slices binary, wide binary"


def _profiles(rows: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, marks, homes, first, counts, wide = [], [], [], [], [], []
        for text in column(batch, "text"):
            own = shingles(text, words)
            sizes.append(len(own))
            marks.append(xxhash.xxh3_128_digest(own.tobytes()))
            counts.append(slices(own).tobytes())
            wide.append(wide_slices(own))
            if len(own):
                first.append(prefix(own, frequent, percent).view(np.int64))
                homes.append([int(mix64(own ^ np.uint64(k * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1)).min().view(np.int64)) for k in range(HOMES)])
            else:
                first.append([])
                homes.append([])
        mark = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
        arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(mark[:, 0]), pa.array(mark[:, 1]), pa.array(homes, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64())), pa.array(counts, pa.binary()), pa.array(wide, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in PROFILE.split(", ")])

    return map_arrow(rows, step, PROFILE)


def _marks(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(column(batch, name)), np.uint64).reshape(-1, SLICES // 64)


def _within(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the slices' bound allows a link: slices (row, slice), sizes."""
    differ = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    return differ <= _most_apart(na, nb, percent)


def _wide_apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many wide slices sets differ; of two numbers of slices the smaller counts, the other's are added up to it."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for la, lb in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes[:, 0] == la) & (sizes[:, 1] == lb))
        size = int(min(la, lb))
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join(side[k] for k in at), np.uint8).reshape(len(at), -1, size), axis=1) for side in (a, b))
        out[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bound of the wide slices leaves."""
    of = lambda side: classes.select(F.col("cls").alias(side), F.col("n").alias(f"n{side}"), F.col("wide").alias(f"w{side}"))
    met = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "wa", "wb")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = _wide_apart(column(batch, "wa"), column(batch, "wb")) <= _most_apart(batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return map_arrow(met, step, "a long, b long", 4096)


def _star_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class and its home's pivot, where size and slices allow a link."""
    at_home = classes.select("cls", "n", "slices", F.posexplode("homes").alias("k", "home"))
    pivots = at_home.groupBy("k", "home").agg(F.min_by(F.struct("cls", "n", "slices"), F.xxhash64("k", "cls")).alias("p"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = at_home.join(pivots, ["k", "home"]).where(F.col("cls") != F.col("p.cls"))
    wide = met.where((F.least("n", "p.n") * 100 >= F.greatest("n", "p.n") * percent)).select(F.col("p.cls").alias("a"), F.col("cls").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb"), F.col("p.slices").alias("sa"), F.col("slices").alias("sb"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = _within(_marks(batch, "sa"), _marks(batch, "sb"), batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return map_arrow(wide, step, "a long, b long").distinct()


def _nearest(a: np.ndarray, b: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the ``most`` nearest of one of their documents; of equal ones the earlier."""
    chosen = np.zeros(len(a), bool)
    for side in (a, b):
        order = np.lexsort((near, side))
        lead = np.r_[True, side[order][1:] != side[order][:-1]]
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
        chosen[order[rank < most]] = True
    return chosen


class _Proposals:
    """Pairs of classes as they are found: each document's ``most`` nearest are kept, in memory of a few times their number.

    A pair that has been outdone on both sides stays so.  Where nothing is to be held back, pairs are given out as soon as there are many.
    """

    def __init__(self, most: int, least: int):
        self.most, self.least, self.room, self.more, self.parts, self.held = most, least, least, False, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(np.stack([np.minimum(a, b), np.maximum(a, b), near]))
        self.held += len(a)
        if self.held >= self.room:
            if self.most >= 1 << 62:
                yield from self.given()
            else:
                self._pruned()
                self.room = max(self.least, 2 * self.held)

    def _pruned(self) -> np.ndarray:
        all_ = np.concatenate(self.parts, axis=1)
        keep = _nearest(*all_, self.most)
        self.more |= not keep.all()
        self.parts = [all_[:, keep]]
        self.held = self.parts[0].shape[1]
        return self.parts[0]

    def given(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            pairs = np.unique(self._pruned()[:2].T, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array([self.more] * len(pairs))], ["a", "b", "more"])
        self.parts, self.held, self.room, self.more = [], 0, self.least, False


def _region_pairs(members: DataFrame, most: int, percent: int) -> DataFrame:
    """(a, b, more): candidates of different components within regions; more says that a document held others back.

    ``members``: s, members (of the region), before, at (places before s in the order), cls, comp, n, slices.  A region of over
    REGION_ROWS is dealt into blocks, and each pair of blocks is a part of its own, so that no task has a large region alone.  Parts
    are sorted by size and streamed with the rows that later ones can still meet.
    """
    names = ["s", "i", "j", "block", "before", "at", "cls", "comp", "n", "slices"]
    blocks = F.ceil(F.col("members") / REGION_ROWS)
    dealt = members.withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("long")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in joined(batches):
            rows = *(batch.column(k).to_numpy() for k in range(9)), _marks(batch, "slices")
            new = batch.num_rows
            if held is not None:
                rows = tuple(np.concatenate(p) for p in zip(held, rows, strict=True))
            s, one, two, block, before, place, cls, comp, n, marks = rows
            fresh = len(s) - new  # rows before have met each other
            found = _Proposals(most, HELD_PAIRS)
            i = np.arange(len(s) - 1)
            d = 1
            while len(i):
                j = i + d
                ok = (s[i] == s[j]) & (one[i] == one[j]) & (two[i] == two[j]) & (n[i] * 100 >= n[j] * percent)
                i, j = i[ok], j[ok]
                # rows of one block meet in that block's own part alone
                test = (j >= fresh) & (comp[i] != comp[j]) & (before[i] != before[j]) & ((one[i] == two[i]) | (block[i] != block[j])) & (place[i] + place[j] <= _most_apart(n[i], n[j], percent))
                for at in range(0, int(test.sum()), 1 << 16):
                    ti, tj = i[test][at : at + (1 << 16)], j[test][at : at + (1 << 16)]
                    good = _within(marks[ti], marks[tj], n[ti], n[tj], percent)
                    if good.any():
                        yield from found.add(cls[ti[good]], cls[tj[good]], np.abs(n[ti[good]] - n[tj[good]]))
                d += 1
                i = i[i + d < len(s)]
            yield from found.given()
            last = len(s) - 1
            keep = np.flatnonzero((s == s[last]) & (one == one[last]) & (two == two[last]) & (n * 100 >= n[last] * percent))
            held = tuple(x[keep] for x in rows)

    return dealt.select(*names).repartition("s", "i", "j").sortWithinPartitions("s", "i", "j", "n").mapInArrow(run, "a long, b long, more boolean")


def _verify(pairs: DataFrame, classes: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that link, on the full sets.  Each set travels once for each pair it is the second of, once as the first."""
    ids = cut(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct().join(classes.select("cls", "doc_id", "h1", "h2"), "cls"), "to-verify")
    n = ids.count()
    wanted = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    texts = rows.join(wanted, "doc_id").select("cls", "h1", "h2", "text")

    def to_set(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingles(t, words).tobytes() for t in column(batch, "text")]
        # a doc_id may have several rows: only the class's own set counts
        marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(o) for o in own), "<i8").reshape(-1, 2)
        same = (marks[:, 0] == batch.column(1).to_numpy()) & (marks[:, 1] == batch.column(2).to_numpy())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["cls", "own"]).filter(pa.array(same))

    sets = map_arrow(texts, to_set, "cls long, own binary")
    firsts = sets.select(F.col("cls").alias("a"), F.col("own").alias("sa"))
    seconds = pairs.select("a", "b").join(sets.select(F.col("cls").alias("b"), F.col("own").alias("sb")), "b")

    def linked(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for a, b in zip(column(batch, "sa"), column(batch, "sb"), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            inter = int((both[1:] == both[:-1]).sum())
            keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(seconds.join(firsts, "a").select("a", "b", "sa", "sb"), linked, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included).

    A-Z is lower-cased; words are runs of anything but ASCII white space.
    Documents link when 100 * intersection >= ``percent`` * union; those
    without words link with nothing.  Rows that share a doc_id are linked.
    Rows without doc_id take no part and have component_id null.  An empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    profiles = cut(_profiles(rows, _frequent(rows, words, percent), words, percent), "profiles")
    real = profiles.where("n > 0 AND doc_id IS NOT NULL")
    grouped = real.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("homes").alias("homes"), F.first("first").alias("first"), F.first("slices").alias("slices"), F.first("wide").alias("wide"))
    classes = cut(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    named = classes.select("h1", "h2", "cls")

    # rows of one doc_id belong together
    of_doc = profiles.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "h1", "h2").join(named, ["h1", "h2"]).groupBy("doc_id").agg(F.min("cls").alias("a"), F.collect_set("cls").alias("all")).where(F.size("all") > 1)
    links = cut(of_doc.select("a", F.explode("all").alias("b")).where("a <> b"), "links")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links so far and those among ``pairs``."""
        close = cut(_close(pairs, classes, percent), "close")
        new = cut(links.unionByName(_verify(close, classes, rows, words, percent)), "links")
        discard(close, links)
        return new

    star = cut(_star_pairs(classes, percent), "star-pairs")
    links = verified(star)
    comps = components(links)
    discard(star)

    # before: the shingle that comes before s in the order, of the first one the class itself, which no other has
    postings = classes.select("cls", F.posexplode("first").alias("at", "s"), "first").select("cls", "s", F.when(F.col("at") > 0, F.get("first", F.col("at") - 1)).otherwise(F.col("cls")).alias("before"), F.col("at").cast("long").alias("at"))
    shared = postings.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select("s")
    met = cut(postings.join(shared, "s"), "postings")
    light = classes.select("cls", "n", "slices")
    tried = None
    for most in (*PROPOSALS, 1 << 62):
        now = met.join(light, "cls").join(comps.select(F.col("id").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        several = met.join(comps.select(F.col("id").alias("cls"), "comp"), "cls", "left").groupBy("s").agg(F.min(F.coalesce("comp", "cls")).alias("x"), F.max(F.coalesce("comp", "cls")).alias("y"), F.count("*").alias("members")).where("x <> y").select("s", "members")
        pairs = cut(_region_pairs(now.join(several, "s"), most, percent).groupBy("a", "b").agg(F.max("more").alias("more")), "pairs")
        untried = pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs
        if not untried.isEmpty():
            links = verified(untried)
            old, comps = comps, components(links)
            discard(old)
        if pairs.where("more").isEmpty():
            break
        before, tried = tried, cut(pairs.select("a", "b") if tried is None else tried.unionByName(untried.select("a", "b")), "tried")
        discard(pairs, before)
    discard(pairs, tried, met, links)

    of_class = classes.select("h1", "h2", "cls", "doc_id").join(comps.select(F.col("id").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = of_class.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    whole = of_class.join(least, "comp").select("h1", "h2", "component_id")
    done = profiles.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "h1", "h2").join(whole, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return done.unionByName(profiles.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents with their columns, of each component only the one with the smallest doc_id, repeated rows of it too; rows without doc_id stay."""
    found = jaccard_components(docs, words, percent)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def one_row_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``one_of_each`` with one row of each kept doc_id.

    Of the rows that share a doc_id, the one with the longest text stays, and
    of those the least by its columns in their order, as far as they can be
    ordered.  Rows without doc_id belong to no component: all of them stay,
    copies included.  Null and empty texts link with nothing and stay.  An
    empty table gives an empty one; further columns may have any names.
    """
    own = one_of_each(docs, words, percent)
    # only rows of repeated ids are grouped; all others pass where they lie
    again = cut(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("again")), "repeated-ids")
    single = own.join(again, own["doc_id"] == again["again"], "left_anti")
    several = own.join(again, own["doc_id"] == again["again"], "left_semi")
    columns = [F.col(quoted(c)) for c in docs.columns]
    order = [c for c, f in zip(columns, docs.schema, strict=True) if not isinstance(f.dataType, (MapType, VariantType)) and f.name != "doc_id"]
    row = F.struct((-F.coalesce(F.length("text"), F.lit(0))).alias("size"), *(c.alias(f"c{k}") for k, c in enumerate(order)))
    first = several.groupBy("doc_id").agg(F.min_by(F.struct(*(c.alias(f"c{k}") for k, c in enumerate(columns))), row).alias("first"))
    return single.unionAll(first.select(*(F.col(f"first.c{k}").alias(c) for k, c in enumerate(docs.columns))))


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
