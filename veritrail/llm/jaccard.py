"""Exact n-gram Jaccard join by PartEnum signatures, and its connected components.

A document's set holds the 64-bit hashes of its distinct word shingles. Sets fall into bands of sizes, so that linked
sets are in one band or in neighbouring ones. Within a band, linked sets differ in at most k elements: the hash domain
is cut into n1 partitions of n2 = 3 cells, of which some partition then has at most one difference, so two of its cells
agree. Signatures are those pairs of cells. Every linked pair shares one; what shares one is verified on the sets.

Work stays in proportion to the documents, though a group of near copies has as many pairs as the square of its size:

* equal sets are one class (its smallest id stands for it), told apart by 128 bits;
* the sharers of a signature are compared with one of them, its hub: the set that shares most signatures with others.
  Most that share one by chance are far from it, which short sketches of the sets show already;
* what remains are pairs of sharers in different components. Both differ from their hub in a few known elements, and
  two sets differ where just one of them differs from the hub; so the pairs that may link have differences in common,
  and are found by those (see ``prefixes``). Sets far from their hub take another one in the next round;
* what is left then are mostly unlike sets that share a common passage with many: those that link have one of their
  rarest elements in common, in one order for all, and are found by it (see ``rare_links``).

Rows are plain (signature, set) pairs and joins on keys that Spark can split, so no group is held by a task.

Partitions without elements: with k >= 8 there are more partitions than needed (``slack``), so a set with at most two
partitions that have an empty pair of cells shares non-empty pairs with each of its partners. Signatures of empty pairs
are made only by sets with more of them (and partners that need them do so too). Linked sets thus share ``spare`` + 1
signatures at least, and each can do without its ``spare`` most common ones, in one order of all signatures: those of a
single frequent element go, which many sets share by chance.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing; a text with fewer words than a
shingle is one shingle; repeated rows and equal texts are one class; rows with a null id, and rows that share an id, are
documents of their own (a null id is never the smallest of a group that has another); texts of any length are hashed
whole, in blocks; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, drop, written

#: Texts, and rows with sets in them, that go to Python at once.
TEXTS, LONG_ROWS = 2000, 200
#: Most signatures that a set is said to be able to do without.
SPARE = (1 << 11) - 1
#: Of how many buckets of elements it is counted how common they are.
BUCKETS = 1 << 17
CELLS, PAIRS = 3, ((0, 1), (0, 2), (1, 2))
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    """A spread of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * by
    x = (x ^ (x >> np.uint64(29))) * M1
    return x ^ (x >> np.uint64(32))


BLOCK, LONG = 1 << 17, 64
#: What a byte counts in a word's hash (A-Z as a-z), which bytes are in words, and the powers of an odd number and of its inverse.
SOLID = ~np.isin(np.arange(256), list(b"\t\n\v\f\r "))
LETTERS = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * M1, M2)[list(bytes(range(256)).lower())]
POWERS, INVERSE = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(BLOCK + LONG, x, np.uint64)])) for x in (int(M1), pow(int(M1), -1, 1 << 64)))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word of UTF-8 bytes: runs of other than ASCII white space, A-Z lower-cased.

    A word's hash is a polynomial of its bytes' letters, taken from running sums over ``BLOCK`` bytes at a time; words of
    more than ``LONG`` bytes, where polynomials modulo 2^64 get weak, are hashed one by one.
    """
    edges = np.flatnonzero(np.diff(SOLID[data], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    h = np.zeros(len(starts), np.uint64)
    for first in range(0, len(data), BLOCK):
        i, j = np.searchsorted(starts, (first, first + BLOCK))
        letters = LETTERS[data[first : first + BLOCK + LONG]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * POWERS[: len(letters)])])
        at = starts[i:j] - first
        h[i:j] = (sums[np.minimum(ends[i:j] - first, len(letters))] - sums[at]) * INVERSE[at]
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes().lower())
    return starts, h


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers."""
    x = np.sort(x)
    return x[np.concatenate([x[:1] == x[:1], x[1:] != x[:-1]])]


def shingler(width: int, chars: int = 1 << 19):
    """A function from texts to their sorted distinct shingle hashes. Words are runs of other than ASCII white space, A-Z lower-cased.

    Some ``chars`` characters of texts are hashed at once, in time linear in them.
    """

    def rolled(h: np.ndarray, n: int, size: int) -> np.ndarray:
        out = np.full(n, size, np.uint64)
        for i in range(size):
            out = mix(out + h[i : i + n], M2)
        return out

    def some(texts: list[str]) -> list[np.ndarray]:
        own = [t.encode("utf-8", "surrogatepass") for t in texts]
        starts, h = word_hashes(np.frombuffer(b"\n".join(own), np.uint8))
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in own])).tolist()
        every = rolled(h, max(len(h) - width + 1, 0), width)
        out = []
        for start, end in zip([0, *ends], ends, strict=False):
            n = end - start
            out.append(distinct(every[start : end - width + 1]) if n >= width else rolled(h[start:end], min(n, 1), n))
        return out

    def shingles(texts: list[str | None]) -> list[np.ndarray]:
        out, held, size = [], [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= chars:
                out += some(held)
                held, size = [], 0
        return out + (some(held) if held else [])

    return shingles


def set_id(elements: np.ndarray) -> tuple[int, int]:
    """128-bit id of a set as two signed longs: equal for equal sets."""
    h = xxhash.xxh3_128_intdigest(elements.tobytes())
    return tuple(x - (1 << 64) if x >> 63 else x for x in (h & 0xFFFFFFFFFFFFFFFF, h >> 64))


class Bands:
    """Bands of set sizes for links of ``num / den`` and more, and the partitions of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = [0]

    def band(self, size: int) -> int:
        """Index of the band of a size: tops[i - 1] < size <= tops[i]."""
        while self.tops[-1] < size:
            self.tops.append(max((self.tops[-1] + 1) * self.den // self.num, self.tops[-1] + 1))
        return int(np.searchsorted(self.tops, size))

    def differences(self, band: int) -> int:
        """Most elements that two linked sets, the larger one of this band, can differ in."""
        self.band(max(self.tops[-1], 1))
        while len(self.tops) <= band:
            self.band(self.tops[-1] + 1)
        return 2 * self.tops[band] * (self.den - self.num) // (self.den + self.num)

    def slack(self, band: int) -> int:
        k = self.differences(band)
        return 3 + (k // 2 + 1) // 8 if k >= 8 else 0

    def hollow(self, band: int) -> int:
        """Partitions with an empty pair of cells, up to which a set makes no signatures of empty pairs."""
        return min(2, self.slack(band))

    def spare(self, band: int) -> int:
        """How many signatures linked sets share besides one."""
        return self.slack(band) - self.hollow(band)

    def first(self, band: int) -> int:
        """Number of first-level partitions: of ``slack + 1`` of them at most one element differs."""
        return self.differences(band) // 2 + 1 + self.slack(band)


def signatures(sets: list[np.ndarray], group: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) of sets of one group of bands, all at once."""
    n1 = bands.first(group)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets)
    salt = np.uint64(group * 2 + 1)
    part = (mix(h + salt, M3) >> np.uint64(20)) % np.uint64(n1)
    cell = (mix(h + salt, M2) >> np.uint64(20)) % np.uint64(CELLS)
    at = ((owner * n1 + part.astype(np.int64)) * CELLS + cell.astype(np.int64)).astype(np.int64)
    value = mix(h ^ salt, M1)
    size = len(sets) * n1 * CELLS
    n = np.bincount(at, minlength=size).reshape(-1, CELLS)
    low = np.bincount(at, (value & np.uint64(0xFFFFFFFF)).astype(float), size).astype(np.uint64)
    high = np.bincount(at, (value >> np.uint64(32)).astype(float), size).astype(np.uint64)
    total = ((high << np.uint64(32)) + low).reshape(-1, CELLS)
    place = np.tile(np.arange(n1, dtype=np.uint64), len(sets))
    whose = np.repeat(np.arange(len(sets)), n1)
    empty = np.stack([n[:, a] + n[:, b] == 0 for a, b in PAIRS], 1)
    hollow = np.bincount(whose[empty.any(1)], minlength=len(sets)) > bands.hollow(group)
    out, ids = [], []
    for k, (a, b) in enumerate(PAIRS):
        keep = ~empty[:, k] | hollow[whose]
        head = mix(place[keep] * np.uint64(8) + np.uint64(k) + (salt << np.uint64(32)), M2)
        out.append(mix(mix(head + total[keep, a], M3) + total[keep, b], M2))
        ids.append(whose[keep])
    # the last bits say how many of them a set can do without, and tell a set's two groups of bands apart
    tail = np.uint64(min(bands.spare(group), SPARE) * 2 + group % 2)
    return np.concatenate(out) & ~np.uint64(2 * SPARE + 1) | tail, np.concatenate(ids)


def sets_of(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, n_shingles, h, h2) for each row; text_key is a hash of the text, (h, h2) the id of its set."""

    def make():
        shingles = shingler(width)

        def step(rows):
            own = shingles(rows["text"])
            ids = [set_id(s) for s in own]
            return {"id": rows["id"], "text_key": rows["text_key"], "n_shingles": [len(s) for s in own], "h": [i for i, _ in ids], "h2": [j for _, j in ids]}

        return step

    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return arrow_map(texts, make, f"id {kind}, text_key long, n_shingles long, h long, h2 long")


def signed(docs: DataFrame, width: int, num: int, den: int, text_col: str, parity: int) -> DataFrame:
    """(signature, h): one row for each signature of each set in a batch, in the set's even or odd group of bands.

    Sets share signatures of one group only, and do without spare ones of that group, so either half stands by itself.
    """

    def make():
        shingles, bands = shingler(width), Bands(num, den)

        def step(rows):
            groups: dict[int, dict[int, np.ndarray]] = {}
            for s in shingles(rows["text"]):
                if len(s):
                    own, band = set_id(s)[0], bands.band(len(s))
                    g = band + (band + parity) % 2
                    if bands.differences(g):  # else linked sets are equal
                        groups.setdefault(g, {})[own] = s
            out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for g, own in groups.items():
                ids, sets = np.array(list(own), np.int64), list(own.values())
                for i in range(0, len(sets), 256):
                    sig, at = signatures(sets[i : i + 256], g, bands)
                    out.append((sig, ids[i : i + 256][at]))
            return {"signature": np.concatenate([x for x, _ in out]).view(np.int64), "h": np.concatenate([x for _, x in out])}

        return step

    return arrow_map(docs.select(F.col(text_col).alias("text")), make, "signature long, h long")


def shared(rows: DataFrame) -> DataFrame:
    """(signature, h, size): the distinct entries of the signatures that more than one set has, without each set's spare ones."""
    by = Window.partitionBy("signature").orderBy("h")
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = rows.withColumns({"before": F.lag("h").over(by), "low": F.first("h").over(every), "high": F.last("h").over(every), "size": F.count("*").over(every)})
    entries = seen.where((F.col("low") != F.col("high")) & (F.col("before").isNull() | (F.col("before") != F.col("h")))).select("signature", "h", "size")
    common = Window.partitionBy("h", F.col("signature").bitwiseAND(F.lit(2 * SPARE + 1))).orderBy(F.desc("size"), "signature")
    spare = F.floor(F.col("signature").bitwiseAND(F.lit(2 * SPARE + 1)) / 2)
    left = entries.withColumn("place", F.row_number().over(common)).where(F.col("place") > spare).drop("place")
    return left.withColumn("size", F.count("*").over(Window.partitionBy("signature"))).where("size > 1")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of all nodes with an edge: the smallest node that can be reached.

    Each round takes the smallest root among a node and its neighbours, then the root of that root, and is written; the
    number of rounds grows with the logarithm of the longest chain. Only a count goes to the driver.
    """
    both = written(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(b, a)).distinct(), "edges")
    roots = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("found")), "other").select("node", "found")
        best = near.groupBy("node").agg(F.min("found").alias("found"))
        step = roots.join(best, "node").select("node", F.least("root", "found").alias("up"), F.col("root").alias("was"))
        jump = step.join(roots.select(F.col("node").alias("up"), F.col("root").alias("beyond")), "up")
        moved = written(jump.select("node", F.least("up", "beyond").alias("root"), (F.least("up", "beyond") != F.col("was")).alias("moved")), "roots")
        drop(roots)
        roots = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            drop(both)
            return roots


def linked(na: int, nb: int, apart: int, num: int, den: int) -> bool:
    """Whether sets of these sizes that differ in ``apart`` elements link."""
    return (num + den) * apart <= (den - num) * (na + nb)


def hubs_of(entries: DataFrame) -> DataFrame:
    """(signature, key, hub) from (signature, key, size): the hub is the sharer that shares most with others."""
    shares = entries.groupBy("key").agg(F.sum("size").alias("shares"))
    by = Window.partitionBy("signature").orderBy(F.desc("shares"), "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return entries.join(shares, "key").select("signature", "key", F.first("key").over(by).alias("hub"))


def sketch(elements: np.ndarray) -> bytes:
    """Parities of how many elements fall to each of 3 to 6 times as many bins: a twelfth of the elements' bytes."""
    bins = 1 << max(3, (3 * len(elements)).bit_length())
    return np.packbits(np.bincount((elements & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1, bitorder="little").tobytes()


def apart_at_least(x: bytes, y: bytes) -> int:
    """A bound from sketches: where the parities of a bin differ, at least one element does."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def within_reach(n: int, apart: int, num: int, den: int) -> bool:
    """Whether a set of n elements, so far from a hub, can link with one that is near the hub."""
    both, less = num + den, den - num
    return 2 * num * both * apart <= (den * both + 2 * less * both) * n


def reaching(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(key, hub, out) of the pairs (key, hub): out if their sketches show that the set is beyond the hub's reach."""

    def make():
        def step(rows):
            out = [not within_reach(n, max(apart_at_least(x, y), abs(n - m)), num, den) for n, m, x, y in zip(rows["n"], rows["m"], rows["x"], rows["y"], strict=True)]
            return {"key": rows["key"], "hub": rows["hub"], "out": out}

        return step

    one, two = sets.select("key", "n", F.col("sketch").alias("x")), sets.select(F.col("key").alias("hub"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    return arrow_map(pairs.join(one, "key").join(two, "hub"), make, "key long, hub long, out boolean")


def differences(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(hub, key, n, far, link, weight, apart) of the pairs (key, hub).

    apart: what the set has and the hub hasn't, then what the hub has and the set hasn't, each in order; null for a set so
    far that it can't link with one near the hub. ``weight`` is (num + den) * |apart| - (den - num) * n: sets with no
    common difference to a hub link if their weights add up to 0 or less.
    """
    both, less = num + den, den - num

    def make():
        def step(rows):
            out = {name: [] for name in ("hub", "key", "n", "far", "link", "weight", "apart")}
            for hub, key, x, y in zip(rows["hub"], rows["key"], rows["x"], rows["y"], strict=True):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                apart = np.concatenate([np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)])
                n = len(x)
                far = 2 * len(apart) > n
                reach = within_reach(n, len(apart), num, den)
                for name, value in zip(out, (hub, key, n, far, linked(n, len(y), len(apart), num, den), both * len(apart) - less * n, apart if reach else None), strict=True):
                    out[name].append(value)
            return out

        return step

    one, two = sets.select("key", F.col("elements").alias("x")), sets.select(F.col("key").alias("hub"), F.col("elements").alias("y"))
    return arrow_map(pairs.join(one, "key").join(two, "hub"), make, "hub long, key long, n long, far boolean, link boolean, weight long, apart array<long>")


def prefixes(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(hub, key, root, far, n, d, weight, place, element): the differences by which a set is found, in one order for all of a hub.

    Those of the fewest sharers come first, so that a passage which many unlike sets have is seldom among them; what only
    one set has finds nobody and isn't listed, but has its place. Any one order is right. A set and its partner have at
    least ``need`` differences in common: their weights and that of a partner, ``least`` at the least, say so, and so does
    that no more than (den - num) / num of the set's size can be in it and not in the partner. The first of them is then
    among the d - need + 1 first of both.
    """
    both, less = num + den, den - num
    d = F.size("apart")
    need = F.greatest(F.lit(1), F.ceil((F.col("weight") + F.col("least")) / (2 * both)), d - F.floor(F.col("n") * less / num))
    about = rows.select("hub", "key", "root", "far", "n", d.alias("d"), "weight", (d - need + 1).alias("first"))
    every = rows.select("hub", "key", F.explode("apart").alias("element"))
    sharing = every.withColumn("sharers", F.count("*").over(Window.partitionBy("hub", "element"))).where("sharers > 1")
    own = Window.partitionBy("hub", "key")
    place = F.row_number().over(own.orderBy("sharers", "element")) - 1 + F.col("d") - F.count("*").over(own)
    return sharing.join(about, ["hub", "key"]).withColumn("place", place).where("place < first").drop("sharers", "first")


def meetings(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(hub, a, b): sets of different components that may link, met by a common difference to their hub."""
    both, less = num + den, den - num
    entry = prefixes(rows, num, den)
    other = entry.select("hub", "element", *[F.col(c).alias(f"other_{c}") for c in ("key", "root", "far", "n", "d", "weight", "place")])
    apart = (F.col("key") < F.col("other_key")) & (F.col("root") != F.col("other_root")) & ~(F.col("far") & F.col("other_far"))
    fits = F.abs(F.col("d") - F.col("other_d")) * both <= less * (F.col("n") + F.col("other_n"))
    # the first common element of a pair that links has as many after it, in both, as must be common
    enough = 2 * both * F.least(F.col("d") - F.col("place"), F.col("other_d") - F.col("other_place")) >= F.col("weight") + F.col("other_weight")
    return entry.join(other, ["hub", "element"]).where(apart & fits & enough).select("hub", F.col("key").alias("a"), F.col("other_key").alias("b")).distinct()


def confirmed(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs (hub, a, b) that link, from their differences to the hub."""
    one = rows.select("hub", F.col("key").alias("a"), F.col("weight").alias("wa"), F.col("apart").alias("x"))
    two = rows.select("hub", F.col("key").alias("b"), F.col("weight").alias("wb"), F.col("apart").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, ["hub", "a"]).join(two, ["hub", "b"]).where(2 * (num + den) * common >= F.col("wa") + F.col("wb")).select("a", "b")


def spread_of(sets: DataFrame) -> np.ndarray:
    """How many elements of the sets fall to each of ``BUCKETS`` buckets: about how common they are."""

    def make():
        def step(rows):
            n = np.bincount((np.concatenate([np.frombuffer(x, np.uint64) for x in rows["elements"]]) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            return {"bucket": np.flatnonzero(n), "n": n[n > 0]}

        return step

    table = written(arrow_map(sets.select("elements"), make, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "jaccard-buckets", TEXTS)
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in table.collect():  # a fixed number at most
        out[bucket] = n
    drop(table)
    return out


def rarest(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(key, root, n, place, element) of the elements by which a set is found: its first ones in an order of all elements.

    Those of rare buckets come first; any one order is right. Linked sets have num / den of either in common at least, so
    the first common element is among the n - ceil(num * n / den) + 1 first of both.
    """
    common = sets.sparkSession.sparkContext.broadcast(spread_of(sets))

    def make():
        def step(rows):
            out = {name: [] for name in ("key", "root", "n", "place", "element")}
            for key, root, x in zip(rows["key"], rows["root"], rows["elements"], strict=True):
                x = np.frombuffer(x, np.uint64)
                n, first = len(x), len(x) - -(-num * len(x) // den) + 1
                place = np.lexsort((x, common.value[x % np.uint64(BUCKETS)]))[:first]
                for name, value in zip(out, (np.full(first, key), np.full(first, root), np.full(first, n), np.arange(first), x[place].view(np.int64)), strict=True):
                    out[name].append(value)
            return {name: np.concatenate(value) for name, value in out.items()}

        return step

    return arrow_map(sets.select("key", "root", "elements"), make, "key long, root long, n long, place long, element long")


def linking(pairs: DataFrame, sets: DataFrame, num: int, den: int, by: str) -> DataFrame:
    """(a, b) of the pairs that link by their elements, or may link by their sketches."""

    def apart(x: bytes, y: bytes) -> int:
        if by == "sketch":
            return apart_at_least(x, y)
        x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
        return len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True))

    def make():
        def step(rows):
            return {"a": rows["a"], "b": rows["b"], "link": [linked(n, m, apart(x, y), num, den) for n, m, x, y in zip(rows["n"], rows["m"], rows["x"], rows["y"], strict=True)]}

        return step

    one, two = sets.select(F.col("key").alias("a"), "n", F.col(by).alias("x")), sets.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col(by).alias("y"))
    return written(arrow_map(pairs.join(one, "a").join(two, "b"), make, "a long, b long, link boolean").where("link").drop("link"), "jaccard-links", LONG_ROWS)


def rare_links(keys: DataFrame, sets: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that join the same components as all links between the sets of these keys, beside ``links``.

    Sets of different components meet by one of their rarest elements. A passage that many unlike sets have is seldom
    among those, and elements that one component alone has pair nobody.
    """
    roots = components(links).select(F.col("node").alias("key"), "root")
    pool = written(sets.join(keys, "key", "left_semi").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "jaccard-pool", TEXTS)
    every = Window.partitionBy("element")
    entry = written(rarest(pool, num, den).withColumns({"low": F.min("root").over(every), "high": F.max("root").over(every)}).where("low != high").drop("low", "high"), "jaccard-rarest", LONG_ROWS)
    other = entry.select("element", *[F.col(c).alias(f"other_{c}") for c in ("key", "root", "n", "place")])
    # the first common element of a pair that links has as many after it, in both, as must be common
    enough = (num + den) * F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place")) >= num * (F.col("n") + F.col("other_n"))
    met = written(entry.join(other, "element").where((F.col("key") < F.col("other_key")) & (F.col("root") != F.col("other_root")) & enough).select(F.col("key").alias("a"), F.col("other_key").alias("b")).distinct(), "jaccard-met")
    near = linking(met, pool, num, den, "sketch")
    more = linking(near, pool, num, den, "elements")
    drop(roots, pool, entry, met, near)
    return more


def links_of(entries: DataFrame, sets: DataFrame, num: int, den: int, rounds: int = 2) -> DataFrame:
    """Links (a, b) that join the same components as all links between sharers (signature, key, size) of a signature.

    In each round, each signature has a hub, with which its sharers are compared. Of two sharers of which one is near
    the hub, both are within reach, and their differences to it decide: where their weights allow a link without a
    common difference, both link with the lightest set of that hub; else they meet by a common difference, if they aren't
    in one component already. Sharers that are both far from the hub meet in the next round; after the last, by rare elements.
    """
    less = den - num
    found = None
    for _ in range(rounds):
        dealt = written(hubs_of(entries), "jaccard-hubs")
        pairs = dealt.where("key != hub").select("key", "hub").distinct()
        looked = written(reaching(pairs, sets, num, den), "jaccard-reach", TEXTS)
        rows = written(differences(looked.where("not out").drop("out"), sets, num, den), "jaccard-differences", LONG_ROWS)
        within = rows.where("apart is not null")

        # the lightest set of a hub is the hub itself, with no differences, or a lighter one
        least = within.groupBy("hub").agg(F.min(F.struct("weight", "key")).alias("x0"))
        lightest = within.select("hub", "key", "weight").join(least, "hub").where("key != x0.key and weight + x0.weight <= 0").select(F.col("key").alias("a"), F.col("x0.key").alias("b"))
        stars = written(rows.where("link").select(F.col("key").alias("a"), F.col("hub").alias("b")).union(lightest), "jaccard-links")
        roots = components(stars)
        labelled = within.drop("link").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        mixed = within.select("hub", "key").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").groupBy("hub").agg(F.min(F.coalesce("root", "key")).alias("low"), F.max(F.coalesce("root", "key")).alias("high")).where("low != high").select("hub")
        hub_weight = sets.select(F.col("key").alias("hub"), (-less * F.col("n")).alias("own"))
        weighed = least.join(mixed, "hub").join(hub_weight, "hub").select("hub", F.least("own", "x0.weight").alias("least"))
        open_rows = written(labelled.join(weighed, "hub"), "jaccard-open", LONG_ROWS)

        met = written(meetings(open_rows, num, den), "jaccard-met")
        more = written(confirmed(met, open_rows, num, den), "jaccard-links")
        found = stars.union(more) if found is None else found.union(stars).union(more)
        drop(roots, open_rows, met)

        apart = rows.where("far").select("key", "hub").union(looked.where("out").select("key", "hub"))
        far = dealt.join(apart, ["key", "hub"]).select("signature", "key")
        count = F.count("*").over(Window.partitionBy("signature"))
        entries = written(far.withColumn("size", count).where("size > 1"), "jaccard-far")
        drop(dealt, rows, looked)
        if entries.isEmpty():
            drop(entries)
            return found
    left = rare_links(entries.select("key").distinct(), sets, found, num, den)
    drop(entries)
    return found.union(left)


def needed_sets(docs: DataFrame, classes: DataFrame, needed: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(key, h, h2, n, elements, sketch) of the sets whose h is in ``needed``, made again from the texts of their classes' first documents."""

    def make():
        shingles = shingler(width)

        def step(rows):
            own = shingles(rows["text"])
            same = [set_id(s) == (h, h2) for s, h, h2 in zip(own, rows["h"], rows["h2"], strict=True)]
            return {"h": rows["h"], "h2": rows["h2"], "n": [len(s) for s in own], "elements": [s.tobytes() for s in own], "sketch": [sketch(s) for s in own], "same": same}

        return step

    # a row is known by its id and its text: ids may be null or repeat
    wanted = classes.join(needed, "h", "left_semi").select("h", "h2", F.col("rep.id").alias("id"), F.col("rep.text_key").alias("key"))
    texts = docs.select(F.col(id_col).alias("of"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    found = texts.join(wanted, (F.col("text_key") == F.col("key")) & F.col("of").eqNullSafe(F.col("id"))).select("h", "h2", "text")
    return arrow_map(found, make, "h long, h2 long, n long, elements binary, sketch binary, same boolean").where("same").select(F.monotonically_increasing_id().alias("key"), "h", "h2", "n", "elements", "sketch")


def join(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row; sets link when den * intersection >= num * union."""
    own = written(sets_of(docs, width, id_col, text_col), "jaccard-sets", TEXTS)
    row = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_key"))
    classes = own.where("n_shingles > 0").groupBy("h", "h2").agg(F.min(row).alias("rep"))

    even, odd = (written(shared(signed(docs, width, num, den, text_col, parity)), "jaccard-shared", TEXTS) for parity in (0, 1))
    met = even.union(odd)
    sets = written(needed_sets(docs, classes, met.select("h").distinct(), width, id_col, text_col), "jaccard-elements", TEXTS)
    # a row that occurs twice gives its set twice
    names = sets.groupBy("h", "h2").agg(F.min("key").alias("key"))
    links = links_of(met.join(names.select("h", "key"), "h").select("signature", "key", "size"), sets, num, den)

    roots = components(links)
    named = names.join(roots.select(F.col("node").alias("key"), "root"), "key").join(classes, ["h", "h2"]).select("h", "h2", "root", "rep")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    joined = named.join(least, "root").select("h", "h2", F.col("least.id").alias("component"))
    # copies of one set only: the class's own first id
    of_set = classes.join(joined, ["h", "h2"], "left").select("h", "h2", F.coalesce("component", "rep.id").alias("component"))
    rows = own.join(of_set, ["h", "h2"], "left")
    return rows.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
