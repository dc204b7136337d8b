"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to ``FEATURES`` dimensions and weighted by their rarity over all documents. A distributed randomised SVD
of the TF-IDF passages of the whole benchmark gives a latent basis: one pass finds the range of A^T A with oversampling, a
second one the Gram matrix within it, whose eigenvectors of the largest eigenvalues are kept. Every window of every
document, of a length near an item's, is projected; windows whose cosine with an item is high enough are candidates (for
items under ``SHORT`` words, where a cosine says little, all windows that hold enough of their words). A candidate counts
if the longest common subsequence of words covers most of the item, or a good part of it and nearly all of its answer (its
last quarter).

Document frequencies are counted over all documents, the basis is fitted on all benchmark passages, and all windows of
whole texts are searched: nothing is sampled. What no item has lies outside the basis and doesn't lower a cosine. The benchmark
is a stated query set: it goes to the tasks in blocks of about ``block`` items, which share one basis, so what is found
for an item doesn't depend on the others in its block.

Defined cases: null and empty texts match nothing, and items without words are never matched; case, punctuation and
white space don't matter; items under 12 words count if they are there whole, or but for one word in eight; of equally good
windows the first gives the figures; texts of any length are searched whole, in pieces that overlap; repeated rows match
as often as they occur; empty tables give an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

FEATURES = 1 << 14
PASSAGE = 40
#: Window lengths in words; an item is sought with the first that holds it, or with its own length beyond these.
LENGTHS = (8, 12, 16, 20, 24, 32, 40, 48, 60, 76, 96, 120, 152, 184)
#: Windows begin and end at multiples of so many words; items of fewer than ``SHORT`` words have no floor of the cosine.
BLOCK, SHORT = 4, 12
#: ASCII characters that separate words.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACED = bytes.maketrans(MARKS, b" " * len(MARKS))
#: Bins of words by which windows that lack too much of an item are left out.
BINS = 1 << 11
#: Words that are worked on together.
CHUNK = 20_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(SPACED).split()


def featurer(most: int = 50_000):
    """A function from words to their hashed features: polynomials of their bytes, for ``most`` words at once from prefix sums."""
    factor, room = 0x9E3779B97F4A7C15, 0
    up = down = np.zeros(0, np.uint64)

    def powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)  # modulo 2^64

    def some(words: list[bytes]) -> np.ndarray:
        nonlocal up, down, room
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if sizes.max() > 64:
            words = [w if len(w) <= 64 else xxhash.xxh64_hexdigest(w).encode() for w in words]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
        joined = np.frombuffer(b" ".join(words), np.uint8)
        if len(joined) > room:
            room = 2 * len(joined)
            up, down = powers(factor, room), powers(pow(factor, -1, 1 << 64), room)
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(joined * up[: len(joined)], out=sums[1:])
        stops = np.cumsum(sizes + 1) - 1
        starts = stops - sizes
        h = (sums[stops] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(factor)
        return (h >> np.uint64(40)).astype(np.int64) % FEATURES

    return lambda words: np.concatenate([np.zeros(0, np.int64)] + [some(words[i : i + most]) for i in range(0, len(words), most)])


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Inverse document frequency of each feature, over all rows."""

    def make():
        features = featurer()

        def step(rows):
            n = np.zeros(FEATURES, np.int64)
            for t in rows["text"]:
                n[np.unique(features(list(set(words_of(t)))))] += 1
            at = np.flatnonzero(n)
            return {"at": [-1, *at.tolist()], "n": [len(rows["text"]), *n[at].tolist()]}

        return step

    counts = dict(arrow_map(docs.select(F.col(text_col).alias("text")), make, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect())
    total = counts.pop(-1, 0)
    n = np.zeros(FEATURES)
    n[list(counts)] = list(counts.values())
    return np.log((total + 1) / (n + 1)) + 0.1


def sketch(passages: list[np.ndarray], idf: np.ndarray, test: np.ndarray) -> np.ndarray:
    """A^T A times the test matrix, for passages given as features."""
    out = np.zeros(test.shape)
    for i in range(0, len(passages), 500):
        at = np.concatenate(passages[i : i + 500])
        sizes = [len(p) for p in passages[i : i + 500]]
        weighted = idf[at, None] * test[at]
        rows = np.add.reduceat(weighted, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        order = np.argsort(at, kind="stable")
        own = (idf[at, None] * np.repeat(rows, sizes, axis=0))[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) != 0]))
        out[at[order][first]] += np.add.reduceat(own, first, axis=0)
    return out


def cut(features: np.ndarray) -> list[np.ndarray]:
    return [features[i : i + PASSAGE] for i in range(0, len(features), PASSAGE)]


def gram(passages: list[np.ndarray], idf: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(A Q)^T (A Q) of passages given as features, for an orthonormal Q."""
    out = np.zeros((own.shape[1], own.shape[1]))
    for i in range(0, len(passages), 500):
        at = np.concatenate(passages[i : i + 500])
        rows = np.add.reduceat(idf[at, None] * own[at], np.cumsum([0] + [len(p) for p in passages[i : i + 500]])[:-1], axis=0)
        out += rows.T @ rows
    return out


def basis(items: DataFrame, idf: np.ndarray, rank: int, more: int = 16, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors of all passages of ``items`` (id, text)."""
    spark = items.sparkSession
    rows = written(items.select("text").repartition(8, F.xxhash64("text")), "decontaminate-fit")

    def summed(own: np.ndarray, work, shape: tuple) -> np.ndarray:
        """The weighted sums of ``work`` over all passages: a matrix of fixed size for each of a few tasks."""
        shared = spark.sparkContext.broadcast(own.astype(np.float32))

        def sums(batches):
            features, found = featurer(), np.zeros(shape)
            for batch in batches:
                if passages := [p for t in batch.column("text").to_pylist() for p in cut(features(words_of(t)))]:
                    found += work(passages, idf, shared.value)
            yield pa.RecordBatch.from_pydict({"part": [found.astype(np.float32).tobytes()]})

        out = np.zeros(shape)
        for r in rows.mapInArrow(sums, "part binary").toLocalIterator():
            out += np.frombuffer(r["part"], np.float32).reshape(shape)
        shared.destroy()
        return out

    test = np.random.default_rng(seed).standard_normal((FEATURES, rank + more))
    own = np.linalg.qr(summed(test, sketch, test.shape))[0]
    values, vectors = np.linalg.eigh(summed(own, gram, (rank + more,) * 2))
    order = np.argsort(-values, kind="stable")[:rank]
    return own @ vectors[:, order[values[order] >= 1e-5 * values[order[0]]]]  # the others are rounding where there are few passages


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    masks: dict = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << k)
    full = v = (1 << len(a)) - 1
    for y in b:
        if m := masks.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def length_of(item: list) -> int:
    """The length of the windows in which an item is sought."""
    return next((n for n in LENGTHS if n >= len(item)), -(-len(item) // BLOCK) * BLOCK)


@dataclass
class Search:
    """What the tasks need: weighted basis, items with their latent vectors, thresholds."""

    table: np.ndarray
    ids: list
    items: list[list[bytes]]
    cosine: float
    copied: float
    paraphrased: float
    answered: float

    def groups(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Items and their unit vectors by window length."""
        features, by = featurer(), {}
        for k, words in enumerate(self.items):
            if words:
                by.setdefault(length_of(words), []).append((k, self.table[features(words)].sum(0)))
        out = {}
        for length, found in by.items():
            vectors = np.stack([v for _, v in found])
            out[length] = np.array([k for k, _ in found]), (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        return out

    def bins(self, which: np.ndarray) -> np.ndarray:
        """The words of these items as bins, a row for each; rows are filled up with a bin that no word has."""
        features = featurer()
        own = [features(self.items[k]) % BINS for k in which]
        out = np.full((len(own), max(map(len, own))), BINS)
        for row, x in zip(out, own, strict=True):
            row[: len(x)] = x
        return out

    def judge(self, item: list[bytes], near: list[bytes]) -> tuple[float, float] | None:
        """Shares of the item and of its answer that stand in order among the words, if that is enough."""
        share = common(item, near) / len(item)
        if share < self.paraphrased:
            return None
        answer = item[-max(3, len(item) // 4) :]
        told = common(answer, near) / len(answer)
        enough = share >= 0.875 if len(item) < SHORT else share >= self.copied or told >= self.answered
        return (share, told) if enough else None

    def finder(self):
        """A function from the words of some documents to {(document, item): (cosine, share, answer)}."""
        features, groups = featurer(), self.groups()
        table = np.concatenate([self.table, np.zeros((1, self.table.shape[1]), np.float32)])  # the last row: no word
        bins = {length: self.bins(which) for length, (which, _) in groups.items()}
        words = {length: (own < BINS).sum(1) for length, own in bins.items()}
        least = {length: self.paraphrased * n - 1e-6 for length, n in words.items()}
        floor = {length: np.where(n < SHORT, -2.0, self.cosine).astype(np.float32) for length, n in words.items()}
        floor = {length: low[:1] if (low == low[0]).all() else low for length, low in floor.items()}

        def find(docs: list[list[bytes]]) -> dict:
            sizes = np.array([len(w) for w in docs])
            padded = -(-sizes // BLOCK) * BLOCK
            firsts = np.cumsum(padded) - padded
            ends = firsts + sizes
            at = np.full(padded.sum(), FEATURES)
            at[np.repeat(firsts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = features([w for own in docs for w in own])
            sums = np.zeros((len(at) // BLOCK + 1, table.shape[1]), np.float32)
            np.cumsum(table[at].reshape(-1, BLOCK, table.shape[1]).sum(1), axis=0, out=sums[1:])
            of_block = np.repeat(np.arange(len(docs)), padded // BLOCK)
            out: dict = {}
            for length, (which, vectors) in groups.items():
                start = np.arange(0, len(at), max(length // 3 // BLOCK * BLOCK, BLOCK))
                start = np.concatenate([start, firsts[sizes > 0]])
                doc = of_block[start // BLOCK]
                stop = np.minimum(start + length, firsts[doc] + padded[doc])
                x = sums[stop // BLOCK] - sums[start // BLOCK]
                norms = np.sqrt(np.einsum("ij,ij->i", x, x))
                cosines = x @ vectors.T
                w, k = np.nonzero(cosines >= floor[length] * np.maximum(norms, 1e-6)[:, None])
                if not len(w):
                    continue
                # no more words of the item stand in order near the window than stand there at all
                used, row = np.unique(w, return_inverse=True)
                low = np.maximum(start[used] - length // 2, firsts[doc[used]])
                high = np.minimum(stop[used] + length // 2, ends[doc[used]])
                there = np.zeros((len(used), BINS + 1), bool)
                place = np.minimum(low[:, None] + np.arange(2 * length + 2), high[:, None] - 1)
                there[np.arange(len(used))[:, None], at[place] % BINS] = True
                enough = np.concatenate([there[row[i : i + 50_000, None], bins[length][k[i : i + 50_000]]].sum(1) for i in range(0, len(w), 50_000)]) >= least[length][k]
                for w, k in zip(w[enough].tolist(), k[enough].tolist(), strict=True):
                    d, item = int(doc[w]), int(which[k])
                    first = firsts[d]
                    near = docs[d][max(int(start[w] - first) - length // 2, 0) : int(stop[w] - first) + length // 2]
                    if found := self.judge(self.items[item], near):
                        best = (round(float(cosines[w, k] / max(norms[w], 1e-6)), 4), *found)
                        if best[1:] + best[:1] > (out[d, item][1:] + out[d, item][:1] if (d, item) in out else ()):
                            out[d, item] = best
            return out

        return find


def overlapping(words: list[bytes], most: int) -> list[list[bytes]]:
    """A text's words in pieces of ``CHUNK`` that overlap by ``most``, so that no window of that length is cut."""
    return [words[i : i + CHUNK + most] for i in range(0, max(len(words) - most, 1), CHUNK)]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", rank: int = 64,
    cosine: float = 0.7, copied: float = 0.75, paraphrased: float = 0.6, answered: float = 0.75, block: int = 1 << 15,
) -> DataFrame:
    """(id, item, cosine, overlap, answer): one row for each document and item found in it."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"id {kinds[0]}, item {kinds[1]}, cosine double, overlap double, answer double"
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    blocks = -(-items.count() // block)
    if not blocks:
        return spark.createDataFrame([], schema).withColumnsRenamed({"id": id_col, "item": item_col})
    idf, out = rarity(docs, text_col), None
    table = (idf[:, None] * basis(items, idf, rank)).astype(np.float32)
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()  # about ``block`` items
        words = [words_of(r["text"]) for r in own]
        shared = spark.sparkContext.broadcast(Search(table, [r["id"] for r in own], words, cosine, copied, paraphrased, answered))
        most = 2 * max(LENGTHS[-1], max(map(len, words), default=0))

        def make(shared=shared, most=most):
            find, ids = shared.value.finder(), shared.value.ids

            def step(rows):
                best: dict = {}
                held, owners, size = [], [], 0

                def search():
                    for (d, k), found in find(held).items():
                        key = owners[d], k
                        if found[1:] + found[:1] > (best[key][1:] + best[key][:1] if key in best else ()):
                            best[key] = found

                for i, t in enumerate(rows["text"]):
                    for piece in overlapping(words_of(t), most):
                        held.append(piece)
                        owners.append(i)
                        size += len(piece)
                        if size > CHUNK:
                            search()
                            held, owners, size = [], [], 0
                if held:
                    search()
                found = sorted(best.items())
                return {"id": [rows["id"][i] for (i, _), _ in found], "item": [ids[k] for (_, k), _ in found]} | {n: [v[j] for _, v in found] for j, n in enumerate(("cosine", "overlap", "answer"))}

            return step

        found = arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, schema)
        out = found if out is None else out.union(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})
