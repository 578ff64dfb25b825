"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SEED, BITS = 42, 64
#: Shingle hashes turned into bit counts at a time; fingerprints dealt at a time; dealt rows in a task.
HASHES, FINGERPRINTS, DEALT = 1 << 16, 1 << 10, 1 << 17
#: Fingerprints of one deal that meet in a task; more are split into blocks.
DEAL = 1 << 18
#: Groups under a variant up to this size are compared by offsets, all groups at once; larger ones grow one by one.
FEW = 64
#: Fingerprints under one key that are compared each with each; larger groups are split by bytes first, where that is exact.
PAIRWISE = 2048
#: Shingles of the texts that are compared in a task; bits of their bitmap.
BLOCK, BITMAP = 1 << 20, 1 << 29
#: Nodes that are broadcast as they have very many links, at most; and the least links that make such a node.
HUBS = 100_000
ONES, GOLD = np.uint64(0x0101010101010101), 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Scheme:
    """Shingles of ``words`` words, fingerprints of 64 ``lanes`` bits, links at ``distance`` bits or less, found in ``segments``.

    While distance < 2 segments, two linked fingerprints have a segment that differs in one bit at most, and every link is found. Beyond that the
    segments find most (see the README), and more with ``cuts``: each further one cuts the bits into segments in another order. ``similarity``: links must also have that Jaccard similarity of their shingle sets, computed exactly.
    """

    words: int = 3
    lanes: int = 1
    distance: int = 3
    segments: int = 2
    similarity: float | None = None
    cuts: int = 1

    @property
    def width(self) -> int:
        return min(32, BITS * self.lanes // self.segments)

    def order(self, cut: int) -> np.ndarray:
        """Which bits the segments of a cut are made of, in order."""
        bits = np.arange(BITS * self.lanes)
        return (np.random.default_rng(cut).permutation(bits) if cut else bits)[: self.segments * self.width]

    @property
    def columns(self) -> list[str]:
        return [f"f{k}" for k in range(self.lanes)]


#: The contract's fingerprints, and those for documents that share 0.8 of their shingles of five words.
SHORT, WIDE = Scheme(), Scheme(words=5, lanes=4, distance=60, segments=12, similarity=0.8, cuts=6)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in hashes[starts[i]:starts[i + 1]]: (len(starts), 64). No slice is empty."""
    counts = np.empty((len(starts), BITS), dtype=np.int64)
    ends = np.append(starts[1:], len(hashes))
    # eight counters share a 64-bit lane, so partial sums are over 255 hashes at most
    marks = np.concatenate([np.arange(s, e, 255) for s, e in zip(starts, ends, strict=True)])
    first = np.searchsorted(marks, starts)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & ONES, marks)
        counts[:, bit::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return counts


def lanes_of(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The hashes themselves, or mixed anew for further lanes."""
    if not lane:
        return hashes
    h = hashes + np.uint64(lane * GOLD & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words, in order; of the whole sequence if there are fewer; none without words."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [xxh64_intdigest(line, SEED)]
    edges, place = [0], 0
    for part in parts:
        place += len(part) + 1
        edges.append(place)
    return [xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(edges, edges[words:], strict=False)]


def fingerprints_of(texts: list[str | None], words: int = 3, lanes: int = 1, distinct: bool = False) -> np.ndarray:
    """The fingerprint of each text, (texts, lanes) of uint64: the bits set in more than half of its shingles' hashes. ``distinct``: a shingle that repeats
    counts once, and two further columns have a digest and the size of the set of shingles."""
    from xxhash import xxh64_intdigest

    out = np.zeros((len(texts), lanes + 2 * distinct), dtype=np.uint64)
    shift = np.arange(BITS, dtype=np.uint64)
    hashes: list[int] = []
    starts: list[int] = []
    owners: list[int] = []

    def flush() -> None:
        if owners:
            own = np.array(hashes, dtype=np.uint64)
            size = np.diff(np.append(starts, len(own)))
            for lane in range(lanes):
                ones = 2 * bit_counts(lanes_of(own, lane), np.array(starts)) > size[:, None]
                out[owners, lane] = (ones.astype(np.uint64) << shift).sum(axis=1, dtype=np.uint64)
        hashes.clear(), starts.clear(), owners.clear()

    for at, text in enumerate(texts):
        if own := shingles(text, words):
            if distinct:
                own = sorted(set(own))
                out[at, lanes:] = xxh64_intdigest(np.array(own, dtype=np.uint64).tobytes(), SEED), len(own)
            starts.append(len(hashes))
            owners.append(at)
            hashes += own
            if len(hashes) >= HASHES:
                flush()
    flush()
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = SHORT) -> DataFrame:
    """(id, k1, k2, node, f0 ...) of every row: its fingerprint as signed longs, and a number for it. Null and wordless texts have 0.

    Where links must be similar, the number is also that of the set of shingles, whose ``size`` is added: texts with one fingerprint and different sets are compared like any others.
    """
    C.text_batches(df.sparkSession)
    # the similarity is that of sets, so fingerprints made for it are too
    words, lanes, distinct = scheme.words, scheme.lanes, scheme.similarity is not None
    names = scheme.columns + ["digest", "size"] * distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprints_of(batch.column(3).to_pylist(), words, lanes, distinct).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(np.ascontiguousarray(fps[:, k])) for k in range(len(names))]], ["id", "k1", "k2", *names])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), *C.row_keys(id_col, text_col), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(run, f"id {kind}, k1 long, k2 long, " + ", ".join(f"{c} long" for c in names))
    return rows.withColumn("node", F.col("f0") if names == ["f0"] else F.xxhash64(*[c for c in names if c != "size"])).drop("digest")


class Joined:
    """Which of some places are joined: at first those with the same label, then what ``join`` adds. ``links`` are the pairs that joined parts that were apart, so
    there are always fewer of them than places."""

    def __init__(self, label: np.ndarray):
        _, first, code = np.unique(label, return_index=True, return_inverse=True)
        self.top = first[code]
        self.links: list[tuple[int, int]] = []

    def roots(self, places: np.ndarray) -> np.ndarray:
        at = self.top[places]
        while ((up := self.top[at]) != at).any():
            at = up
        self.top[places] = at
        return at

    def root(self, place: int) -> int:
        while (up := int(self.top[place])) != place:
            place = up
        return place

    def join(self, some: np.ndarray, others: np.ndarray) -> None:
        for x, y in zip(some.tolist(), others.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.top[max(p, q)] = min(p, q)
                self.links.append((x, y))


def grow(group: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray], joined: Joined) -> None:
    """Joins those of ``group`` (different places) that a chain of links inside it joins. ``linked(x, others)`` says which of the others a place links to.

    Parts grow breadth first, the smallest first. Each step walks the smaller of the front and the rest, and compares each place there to all of
    the other in one vector step; what is joined already is never compared. So a group that one place links costs a step, and one of strangers its pairs.
    """
    _, code, size = np.unique(joined.roots(group), return_inverse=True, return_counts=True)
    rest = group[np.lexsort((code, size[code]))]
    while len(rest) > 1:
        roots = joined.roots(rest)
        own = roots == roots[0]
        front, rest = rest[own], rest[~own]
        while len(front) and len(rest):
            hit = np.zeros(len(rest), dtype=bool)
            if len(front) <= len(rest):
                for x in front.tolist():
                    left = np.flatnonzero(~hit)
                    new = left[linked(x, rest[left])] if len(left) else left
                    joined.join(np.full(len(new), x), rest[new])
                    hit[new] = True
            else:
                for k, x in enumerate(rest.tolist()):
                    to = np.flatnonzero(linked(x, front))[:1]
                    joined.join(np.full(len(to), x), front[to])
                    hit[k] = len(to)
            if hit.any():  # what was joined to them before comes along
                hit = np.isin(joined.roots(rest), joined.roots(rest[hit]))
            front, rest = rest[hit], rest[~hit]


def parted(group: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """Parts of a large group so that any two within ``distance`` (under 8) are together in some part: those that differ in at most ``distance``
    bytes of the ones that vary have an equal one among the first distance + 1."""
    by_byte = np.ascontiguousarray(fp[group]).view(np.uint8).reshape(len(group), -1)
    varied = np.flatnonzero((by_byte != by_byte[0]).any(axis=0))
    if len(group) <= PAIRWISE or len(varied) <= distance:
        yield group
        return
    for k in varied[: distance + 1].tolist():
        order = np.argsort(by_byte[:, k], kind="stable")
        for part in np.split(group[order], np.flatnonzero(np.diff(by_byte[order, k])) + 1):
            if len(part) > 1:
                yield from parted(part, fp, distance)


def values_of(bits: np.ndarray) -> np.ndarray:
    """Numbers from bits along the last axis, the lowest first."""
    return (bits.astype(np.uint64) << np.arange(bits.shape[-1], dtype=np.uint64)).sum(axis=-1, dtype=np.uint64)


def dealt(fps: DataFrame, scheme: Scheme, cut: int = 0, segments: range | None = None) -> DataFrame:
    """(deal, and the columns of ``fps``): each fingerprint twice for each segment, dealt by its upper and by its lower half.

    A deletion variant leaves one half of the segment as it is, so all variants with the wildcard in the other half are made and
    joined where that half has brought the fingerprints together: width / 2 variants don't travel, one row does.
    """
    lanes, width, bits_of = scheme.lanes, scheme.width, scheme.order(cut).reshape(scheme.segments, -1)
    use = np.array(segments if segments is not None else range(scheme.segments))
    names = scheme.columns + [c for c in fps.columns if c in ("size", "label")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (2 * use[:, None] + np.arange(2)).astype(np.uint64) << np.uint64(32)
        for whole in batches:
            for start in range(0, whole.num_rows, FINGERPRINTS):
                batch = whole.slice(start, FINGERPRINTS)
                fps = np.stack([batch.column(1 + k).to_numpy() for k in range(lanes)], axis=1).view(np.uint64)
                bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")[:, bits_of[use]]
                halves = np.stack([values_of(bits[:, :, width // 2 :]), values_of(bits[:, :, : width // 2])], axis=2)
                deal = halves + number
                rows = [pa.array(np.repeat(batch.column(k).to_numpy(), 2 * len(use))) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([pa.array(deal.reshape(-1).view(np.int64)), *rows], ["deal", "node", *names])

    return fps.select("node", *names).mapInArrow(run, "deal long, node long, " + ", ".join(f"{c} long" for c in names))


def variants(deal: np.ndarray, fp: np.ndarray, scheme: Scheme, cut: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each wildcard the rows that share a deletion variant of a segment with others: groups one after the other, and their sizes."""
    bits_of, half = scheme.order(cut).reshape(scheme.segments, scheme.width), scheme.width // 2
    code = deal >> np.uint64(32)
    for c in np.unique(code):
        segment, lower = divmod(int(c), 2)
        free = bits_of[segment, half:] if lower else bits_of[segment, :half]
        rows = np.flatnonzero(code == c)
        value = values_of(np.unpackbits(fp[rows].view(np.uint8), axis=1, bitorder="little")[:, free])
        base = (deal[rows] << np.uint64(32)) | value
        for wildcard in range(len(free)):
            key = base | (np.uint64(1) << np.uint64(wildcard))
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            yield rows[order[np.repeat(sizes > 1, sizes)]], sizes[sizes > 1]


def links(fps: DataFrame, scheme: Scheme = SHORT, cut: int = 0, segments: range | None = None) -> DataFrame:
    """(a, b): pairs of nodes that join all that one cut's segments link.

    ``fps`` (node, f0 ..., size and label where there are such columns) has each fingerprint once. Two of them link if they share a deletion variant and differ in
    at most ``distance`` bits (and, where links must be similar, their sizes allow the similarity). Each task gives a spanning set of the links under all its
    keys, fewer than it has fingerprints, however many there are in a group. With a column ``label`` those with the same label
    count as joined before, and a and b are labels.

    Deals with more than DEAL fingerprints are split into blocks, of which each two meet in a task: the deals that can be large are 2 x segments x 2^(half
    of the width) at most, so the table of their counts has a bound.
    """
    distance, labelled, sized = scheme.distance, "label" in fps.columns, "size" in fps.columns
    lanes, similar_ = scheme.lanes, scheme.similarity or 0.0

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(k).to_numpy() for k in range(1 + 1 + lanes + sized + labelled)] for batch in batches if batch.num_rows]
        if not held:
            return
        deal, node, *rest = (np.concatenate(c) for c in zip(*held, strict=True))
        del held
        node, first, who = np.unique(node, return_index=True, return_inverse=True)
        fp = np.stack([c[first] for c in rest[:lanes]], axis=1).view(np.uint64)
        size = rest[lanes][first] if sized else None
        label = rest[-1][first] if labelled else node
        del rest
        joined = Joined(label)

        def near(a, b) -> np.ndarray:
            found = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=-1) <= distance
            return found & (np.minimum(size[a], size[b]) >= similar_ * np.maximum(size[a], size[b])) if sized else found

        for rows, sizes in variants(deal.view(np.uint64), fp[who], scheme, cut):
            places, ends = who[rows], np.cumsum(sizes)
            last = np.repeat(ends, sizes)
            at, step = np.flatnonzero(np.repeat(sizes <= FEW, sizes)), 1
            while len(at := at[at + step < last[at]]):
                a, b = places[at], places[at + step]
                apart = joined.roots(a) != joined.roots(b)
                a, b = a[apart], b[apart]
                hit = near(a, b)
                joined.join(a[hit], b[hit])
                step += 1
            for end, n in zip(ends[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
                group = np.unique(places[end - n : end])
                if len(np.unique(joined.roots(group))) > 1:
                    for part in parted(group, fp, distance) if distance < 8 else [group]:
                        grow(part, near, joined)
        found = label[np.array(joined.links, dtype=np.int64).reshape(-1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(2)], ["a", "b"])

    spark, count = fps.sparkSession, fps.count()
    every = dealt(fps, scheme, cut, segments)
    keys, rows = ["deal"], count * 2 * len(segments if segments is not None else range(scheme.segments))
    if count > DEAL:
        hot = C.cut_narrow(every.groupBy("deal").agg(F.ceil(F.count(F.lit(1)) / DEAL).cast("int").alias("blocks")).filter("blocks > 1"))
        if hot.limit(1).count():
            own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
            met = every.join(F.broadcast(hot), "deal", "left").withColumn("own", F.coalesce(own, F.lit(0)))
            met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
            every = met.select(*every.columns, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
            keys = ["deal", "lo", "hi"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // DEALT))
    return every.repartition(tasks, *keys).mapInArrow(probe, "a long, b long")


def candidates(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """(node, label) of the nodes that links of any cut lead to or from: those that chains of links join have the same label, the smallest node.

    The first two segments come first: what they join is joined for the others, so a group of near copies gives its links once and not for each segment.
    """
    first = C.cut_narrow(components(links(fps, scheme, 0, range(2))))
    if scheme.segments * scheme.cuts <= 2:
        return first
    at = F.coalesce("label", "node")
    fps = C.cut_narrow(fps.join(first, "node", "left").withColumn("linked", F.col("label").isNotNull()).withColumn("label", at))
    edges = [C.cut_narrow(links(fps.drop("linked"), scheme, cut, range(0 if cut else 2, scheme.segments))) for cut in range(scheme.cuts)]
    more = components(reduce(DataFrame.union, edges)).select(F.col("node").alias("label"), F.col("label").alias("least"))
    found = fps.select("node", "label", "linked").join(more, "label", "left").filter(F.col("linked") | F.col("least").isNotNull())
    return C.cut_narrow(found.select("node", F.coalesce("least", "label").alias("label")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links lead to, for every node of ``edges`` (a, b).

    Alternates large-star and small-star rounds, each cut by a checkpoint, until nothing changes; the rounds grow
    with the logarithm of the nodes. A node with more than ``hub`` links isn't joined by a shuffle: as there are 2 x links / hub of
    them at most, which is HUBS or fewer, they are broadcast.
    """
    edges = C.cut_narrow(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state, total = None, edges.count()

    def met(rows: DataFrame, least: DataFrame) -> DataFrame:
        hub = max(HUBS, 2 * total // HUBS)
        if total <= hub:
            return rows.join(least, "u")
        hubs = F.broadcast(C.cut_narrow(least.filter(F.col("n") > hub)))
        return rows.join(hubs, "u").union(rows.join(hubs, "u", "left_anti").join(least.filter(F.col("n") <= hub), "u"))

    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = met(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = met(large, down).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = C.cut_narrow(moved.filter("u <> v").distinct())
        total, *now = edges.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (total, now) == state:
            break
        state = (total, now)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.union(nodes.select(F.col("label").alias("node"), "label").distinct())


def overlaps(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function of a place and others: how many shingles its set shares with each of theirs. Only shingles of two sets or more are looked at."""
    sizes = np.array([len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    column = (np.cumsum(count > 1) - 1)[code[shared]]
    row = np.repeat(np.arange(len(sets)), sizes)[shared]
    columns = int((count > 1).sum())
    if len(sets) * columns <= BITMAP:
        width = -(-max(columns, 1) // 64)
        bits = np.zeros((len(sets), width), dtype=np.uint64)
        np.bitwise_or.at(bits, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
        return lambda x, others: np.bitwise_count(bits[others] & bits[x]).sum(axis=-1, dtype=np.int64)
    # too wide for bits: for each shingle the sets that have it
    own = np.append(np.searchsorted(row, np.arange(len(sets))), len(row))
    order = np.argsort(column, kind="stable")
    first = np.append(np.searchsorted(column[order], np.arange(columns)), len(order))
    holders = row[order]

    def count_of(x: int, others: np.ndarray) -> np.ndarray:
        mine = column[own[x] : own[x + 1]]
        start, size = first[mine], first[mine + 1] - first[mine]
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(holders[at], minlength=len(sets))[others]

    return count_of


def refined(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b): links between nodes with the same ``key`` whose shingle sets have the scheme's similarity, computed exactly; enough to join all that such links join.

    ``rows``: (key, node, part, text); nodes of one part count as joined. A task holds the rows of one key at a time.
    """
    words, share = scheme.words, Fraction(str(scheme.similarity))

    def joined_in(nodes: list[int], part: list[int], texts: list[str | None]) -> np.ndarray:
        nodes, first = np.unique(np.array(nodes, dtype=np.int64), return_index=True)
        joined = Joined(np.array(part, dtype=np.int64)[first])
        if len(np.unique(joined.top)) > 1:
            sets = [np.unique(np.array(shingles(texts[k], words), dtype=np.uint64)) for k in first.tolist()]
            sizes, shared = np.array([len(s) for s in sets]), overlaps(sets)

            def linked(x: int, others: np.ndarray) -> np.ndarray:
                both = shared(x, others)
                return share.denominator * both >= share.numerator * (sizes[x] + sizes[others] - both)

            grow(np.arange(len(nodes)), linked, joined)
        return nodes[np.array(joined.links, dtype=np.int64).reshape(-1, 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, ([], [], []), []

        def given(found: list[np.ndarray]) -> pa.RecordBatch:
            both = np.concatenate([np.zeros((0, 2), np.int64), *found])
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in range(2)], ["a", "b"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=False):
                if key is not None and keys[a] != key:
                    out.append(joined_in(*held))
                    held = ([], [], [])
                key = keys[a]
                for k, own in enumerate(held):
                    own += batch.column(1 + k).slice(a, b - a).to_pylist()
            if len(out) >= FINGERPRINTS:
                yield given(out)
                out = []
        yield given([*out, joined_in(*held)])

    C.text_batches(rows.sparkSession)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("key", "node", "part", "text").repartition(tasks, "key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "a long, b long")


def block_of(blocks: Column) -> Column:
    """One of ``blocks`` blocks for a node."""
    return F.pmod(F.xxhash64("node", F.lit(2)), blocks)


def blocks_for(shingles_: Column) -> Column:
    return F.greatest(F.ceil(shingles_ / BLOCK), F.lit(1)).cast("long")


def with_parts(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with ``part`` replaced by that of the component of ``edges`` that it is in."""
    found = components(edges).select(F.col("node").alias("part"), F.col("label").alias("__to"))
    return rows.join(found, "part", "left").withColumn("part", F.coalesce("__to", "part")).drop("__to")


def verified(blobs: DataFrame, distinct: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b): links that have the scheme's similarity and join all nodes with the same label that such links join.

    ``blobs`` (node, label): the nodes that candidate links join. Their texts are brought together by label, in blocks of BLOCK shingles, and compared exactly; a label that fits into one
    block is done then. Of a larger one, first each block is joined, then one node of each part; then the largest part meets all others in pairs of blocks, and the
    others each other. A group that verified links join stays linear in its members; the more of it no such link joins, the more pairs of blocks are compared, none is left out.
    """
    nodes = distinct.select("node", "size", "first.k1", "first.k2").join(blobs, "node")
    total = C.cut_narrow(nodes.groupBy("label").agg(blocks_for(F.sum("size")).alias("blocks")))
    nodes = nodes.join(total, "label").select("node", "label", "size", "blocks", "k1", "k2")
    # rows that repeat have the same keys and the same text
    own = C.stored(texts.join(nodes, ["k1", "k2"]).select("node", "label", "size", "blocks", "text").dropDuplicates(["node"]))
    edges = C.cut_narrow(refined(own.filter("blocks = 1").select(F.col("label").alias("key"), "node", F.col("node").alias("part"), "text"), scheme))
    if total.filter("blocks > 1").limit(1).count() == 0:
        return edges
    large = own.filter("blocks > 1")
    state = large.select("node", "label", "size", F.col("node").alias("part"))
    inside = C.cut_narrow(refined(large.select(F.xxhash64("label", block_of(F.col("blocks"))).alias("key"), "node", F.col("node").alias("part"), "text"), scheme))
    state = C.cut_narrow(with_parts(state, inside))
    one = C.cut_narrow(state.groupBy("label", "part").agg(F.min(F.struct("node", "size")).alias("one")).select("label", "part", "one.node", "one.size"))
    few = one.groupBy("label").agg(blocks_for(F.sum("size")).alias("few"))
    ones = one.join(few, "label").select("node", "part", F.xxhash64("label", block_of(F.col("few"))).alias("key"))
    across = C.cut_narrow(refined(ones.join(large.select("node", "text"), "node"), scheme))
    state = C.cut_narrow(with_parts(state, C.cut_narrow(across.join(state.select(F.col("node").alias("a"), F.col("part").alias("x")), "a").join(state.select(F.col("node").alias("b"), F.col("part").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))))
    parts = state.groupBy("label", "part").agg(F.sum("size").alias("size"))
    main = parts.groupBy("label").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    main = C.cut_narrow(main.select("label", "main", blocks_for(F.col("most")).alias("mains"), blocks_for(F.col("all") - F.col("most")).alias("others")))
    rows = state.join(main, "label").withColumn("other", F.col("part") != F.col("main"))
    rows = rows.withColumn("at", F.when(F.col("other"), block_of(F.col("others"))).otherwise(block_of(F.col("mains"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    with_main = F.transform(upto("mains"), lambda i: F.xxhash64("label", F.lit(0), i, F.col("at")))
    with_others = F.transform(upto("others"), lambda j: F.xxhash64("label", F.lit(1), F.least(j, F.col("at")), F.greatest(j, F.col("at"))))
    of_main = F.transform(upto("others"), lambda j: F.xxhash64("label", F.lit(0), F.col("at"), j))
    rows = rows.select("node", "part", F.explode(F.when(F.col("other"), F.concat(with_main, with_others)).otherwise(of_main)).alias("key"))
    last = C.cut_narrow(refined(rows.join(large.select("node", "text"), "node"), scheme))
    return edges.union(inside).union(across).union(last)


def grouped(rows: DataFrame, scheme: Scheme, texts: DataFrame | None = None) -> DataFrame:
    """(node, least): of each distinct fingerprint of ``rows`` the least row of its component, as (none, id, k1, k2)."""
    row = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("k1"), F.col("k2"))
    own = [*scheme.columns, *["size"] * (scheme.similarity is not None)]
    distinct = C.cut_narrow(rows.groupBy("node", *own).agg(F.min(row).alias("first")))
    labels = candidates(distinct.select("node", *own), scheme)
    if scheme.similarity is not None:
        labels = components(verified(labels, distinct, texts, scheme))
    of = C.cut_narrow(distinct.select("node", "first").join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label")))
    least = of.groupBy("label").agg(F.min("first").alias("least"))
    return of.join(least, "label").select("node", "least")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = SHORT) -> DataFrame:
    """(id, f0 ..., component_id) of every row: rows whose fingerprints a chain of links joins have the same component_id,
    the smallest id among them.

    Equal fingerprints meet first, so copies never multiply; only distinct ones are indexed and linked. Null and
    wordless texts have fingerprint 0 and link like any other. Ids that are null are no component's smallest, unless there
    is no other. Rows that repeat stay. An empty table gives no rows. Other columns of ``df`` are not read.
    """
    rows = C.cut(fingerprints(df, id_col, text_col, scheme))
    texts = df.select(*C.row_keys(id_col, text_col), F.col(text_col).alias("text"))
    found = rows.join(grouped(rows, scheme, texts), "node")
    return found.select(F.col("id").alias(id_col), *scheme.columns, F.col("least.id").alias("component_id"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = WIDE) -> DataFrame:
    """The rows of ``df``, all columns whatever their names, without near duplicates: of each component the row with the smallest id stays (a null id is the
    largest). Null and wordless texts have the same shingles, none, and are duplicates of each other; of rows that repeat one stays. An empty table gives no rows."""
    rows = C.cut(fingerprints(df, id_col, text_col, scheme))
    texts = df.select(*C.row_keys(id_col, text_col), F.col(text_col).alias("text"))
    kept = grouped(rows, scheme, texts).select("least.k1", "least.k2").distinct()
    return C.keep_rows(df, kept, rows, id_col, text_col)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest document that links reach from it."""
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
