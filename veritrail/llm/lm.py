"""Language-model scores: prediction by partial matching over bytes, beside a unigram word base.

The byte model counts every symbol after its last two bytes over all training texts. A symbol unseen after a context
escapes to the shorter one (method C: as likely as the number of distinct symbols seen), where the symbols of the longer
context are excluded; below order 0 all symbols left are alike. As the model doesn't adapt while scoring, each pair of
context and symbol has one log probability: they are computed once, so scoring is a table lookup per byte. The table
has at most 65,536 contexts of 257 symbols (256 bytes and the end), whatever the corpus.

``score`` is the same method over contexts of up to five bytes (``ORDER``), which have no such bound: their trie is
held in shards by the last three bytes of the context. A block sends its distinct pairs of context and symbol, with its
own counts, to their shards; a shard adds up its part of the trie, goes down from order 5 to 3 by exact counts, ends in
the table of order 2, and answers each block. ``score_order2`` is what the table of order 2 alone gives.

The base needs the corpus count of every word of every text, and the words have no bound, so they are never held
together: each block of documents sends its distinct words, with its own counts, to buckets by hash; a bucket adds up and
answers each block. A word costs one entry per block however often it occurs, so frequent words aren't hot keys.

Defined cases: a null or empty text is just the end symbol (and the end token); without training rows all symbols are
equally likely and the base is 0; repeated rows count as often as they occur; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop, partitions, to_arrow, written

END, SYMBOLS = 256, 257
#: Bytes of text that are worked on together.
CHUNK = 8_000_000
#: Longest context of the trie; its shards, and the bytes of text whose contexts are held at once.
ORDER, SHARDS, PIECE = 5, 256, 2_000_000
#: Bytes of text per shard where they are so many that SHARDS would hold more, and the parts in which shards and buckets
#: are worked on one after the other, so that only one part is shuffled at a time.
SHARD_BYTES, WAVES = 16_000_000, 4


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` bytes together."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 3
    if start < len(texts):
        yield start, len(texts)


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and symbol at each place of the texts, and where each text begins. A text starts after two zero bytes."""
    joined = np.frombuffer(b"\0\0" + b"\0\0\0".join(texts) + b"\0", np.uint8).astype(np.int32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes + 3)[:-1]])
    context = joined[:-2] * 256 + joined[1:-1]
    symbol = joined[2:].copy()
    symbol[starts + sizes] = END
    keep = np.ones(len(symbol), bool)
    for pad in (1, 2):
        keep[(starts + sizes + pad)[:-1]] = False
    return context[keep], symbol[keep], np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])


def byte_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n) over all rows: code is context * 257 + symbol."""

    def make():
        def step(rows):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows["text"]]
            out = []
            for a, b in chunks(texts):
                context, symbol, _ = symbols(texts[a:b])
                # count in a dense space of the symbols that occur
                used = np.flatnonzero(np.bincount(symbol, minlength=SYMBOLS) + np.bincount([0, 0], minlength=SYMBOLS))
                small = np.zeros(SYMBOLS, np.int64)
                small[used] = np.arange(len(used))
                n = np.bincount((small[context >> 8] * len(used) + small[context & 255]) * len(used) + small[symbol])
                at = np.flatnonzero(n)
                x, y, z = used[at // len(used) ** 2], used[at // len(used) % len(used)], used[at % len(used)]
                out.append(((x * 256 + y) * SYMBOLS + z, n[at]))
            return {"code": np.concatenate([c for c, _ in out]), "n": np.concatenate([n for _, n in out])}

        return step

    return arrow_map(docs.select(F.col(text_col).alias("text")), make, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def deep_codes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """context * 257 + symbol at each place of the texts, in order; contexts are of ORDER bytes, zero bytes before a text."""
    for a, b in chunks(texts, PIECE):
        joined = np.frombuffer(bytes(ORDER) + bytes(ORDER + 1).join(texts[a:b]) + b"\0", np.uint8)
        sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
        starts = np.concatenate([[0], np.cumsum(sizes + ORDER + 1)[:-1]])
        code = np.zeros(len(joined) - ORDER, np.int64)
        for k in range(ORDER):
            code <<= 8
            code |= joined[k : k + len(code)]
        code *= SYMBOLS
        symbol = joined[ORDER:].astype(np.int16)
        symbol[starts + sizes] = END
        code += symbol
        keep = np.ones(len(code), bool)
        for pad in range(1, ORDER + 1):
            keep[(starts + sizes + pad)[:-1]] = False
        yield code[keep]


def shards(codes: np.ndarray, count: int = SHARDS) -> np.ndarray:
    """Shard of each code: by the last three bytes of its context, which orders 3 and up share."""
    return (((codes // SYMBOLS & 0xFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> 8) % count


def packed(x: np.ndarray) -> bytes:
    """Numbers, compressed with their first bytes together, then their second ones, as high bytes hardly vary."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def distinct(texts: list[bytes], training: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct codes of the texts, and how often each occurs in those for training."""
    codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for yes in (True, False):
        own = texts if training is None else [t for t, x in zip(texts, training, strict=True) if bool(x) == yes]
        for piece in deep_codes(own) if yes or training is not None else ():
            u, n = np.unique(piece, return_counts=True)
            codes.append(u)
            counts.append(n if yes else np.zeros(len(u), np.int64))
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


class PartialMatching:
    """Log10 probabilities by (row of a context, symbol)."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        context, symbol = codes // SYMBOLS, codes % SYMBOLS
        two, at = np.unique(context, return_inverse=True)
        n2 = np.zeros((len(two), SYMBOLS))
        n2[at, symbol] = n
        n1 = np.zeros((256, SYMBOLS))
        np.add.at(n1, two & 255, n2)
        n0 = n1.sum(0)
        p0 = self._mix(n0[None], np.ones((1, SYMBOLS)) / SYMBOLS)
        p1 = self._mix(n1, np.repeat(n0[None], 256, 0), p0)
        p2 = self._mix(n2, n1[two & 255], n0[None], p0)
        # rows: order 2 contexts, then order 1 by the last byte (a byte never seen has the row of order 0)
        self.log = np.log10(np.concatenate([p2, p1])).astype(np.float32)
        self.row = (len(two) + (np.arange(65536) & 255)).astype(np.int32)
        self.row[two] = np.arange(len(two))
        order = np.argsort(codes)
        self.codes, self.n = codes[order], n[order]
        self.total, self.seen = np.zeros(65536), np.zeros(65536)
        self.total[two], self.seen[two] = n2.sum(1), (n2 > 0).sum(1)

    @staticmethod
    def _mix(counts: np.ndarray, *lower: np.ndarray) -> np.ndarray:
        """Probabilities of all symbols: from ``counts``, escaping through the counts of lower orders to equal shares.

        The last of ``lower`` only says that the chain ends; each lower order excludes what the higher ones have seen.
        """
        out = np.zeros((len(counts), SYMBOLS))
        left = np.ones((len(counts), 1))
        excluded = np.zeros(out.shape, bool)
        for n in (counts, *lower[:-1]):
            own = np.where(excluded, 0.0, np.broadcast_to(n, out.shape))
            seen = own > 0
            distinct, total = seen.sum(1, keepdims=True), own.sum(1, keepdims=True)
            none_left = (excluded | seen).all(1, keepdims=True)
            whole = total + np.where(none_left, 0, distinct)
            share = np.divide(own, whole, out=np.zeros_like(own), where=whole > 0)
            out += left * share
            left = left * np.where(distinct == 0, 1.0, np.where(none_left, 0.0, distinct / np.maximum(whole, 1)))
            excluded |= seen
        rest = ~excluded
        return out + np.where(rest, left / np.maximum(rest.sum(1, keepdims=True), 1), 0.0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Log10 probability of each text with its end."""
        context, symbol, starts = symbols(texts)
        logs = self.log[self.row[context], symbol]
        return np.add.reduceat(logs, starts, dtype=np.float64)


    def deep(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log10 probability of each of the distinct codes of a shard, from their counts ``n`` and the table of order 2.

        What a context has seen, its shorter context has seen too, so the symbols excluded at an order are exactly those
        seen at the one above: it is enough to take their number and their counts off.
        """
        context, symbol = codes // SYMBOLS, codes % SYMBOLS
        levels, known = [], n > 0
        for k in range(ORDER, 2, -1):
            pairs, at = np.unique((context[known] & (1 << 8 * k) - 1) * SYMBOLS + symbol[known], return_inverse=True)
            levels.append((pairs, np.bincount(at, n[known], len(pairs)), k))
        levels.append((self.codes, self.n, 2))
        out, p, done = np.zeros(len(codes)), np.ones(len(codes)), np.zeros(len(codes), bool)
        gone_n, gone = np.zeros(len(codes)), np.zeros(len(codes))
        for level, (pairs, counts, k) in enumerate(levels):
            own = context & (1 << 8 * k) - 1
            hits = look(pairs, counts, own * SYMBOLS + symbol)
            if k > 2:
                parents, first = np.unique(pairs // SYMBOLS, return_index=True)
                shorter = (pairs // SYMBOLS & (1 << 8 * (k - 1)) - 1) * SYMBOLS + pairs % SYMBOLS
                sums = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
                total, seen = look(parents, sums(counts), own), look(parents, sums(np.ones(len(pairs))), own)
                next_gone = look(parents, sums(look(*levels[level + 1][:2], shorter)), own)
            else:
                total, seen, next_gone = self.total[own], self.seen[own], gone_n
            fresh = seen - gone
            whole = np.maximum(total - gone_n + np.where(seen < SYMBOLS, fresh, 0), 1)
            hit = ~done & (hits > 0)
            out[hit] = np.log10(p[hit] * hits[hit] / whole[hit])
            done |= hit
            p = np.where(done | (fresh == 0), p, p * fresh / whole)
            gone_n, gone = next_gone, seen
        # below order 2: the table has these places after an escape from order 2 without exclusions
        last = context & 0xFFFF
        escape = np.where(self.seen[last] > 0, self.seen[last] / np.maximum(self.total[last] + self.seen[last], 1), 1.0)
        rest = ~done
        out[rest] = np.log10(p[rest]) + self.log[self.row[last[rest]], symbol[rest]] - np.log10(escape[rest])
        return out


def look(keys: np.ndarray, found: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The entry of each asked key in sorted ``keys``, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, found[at], 0.0)


def train(docs: DataFrame, text_col: str = "text") -> PartialMatching:
    got = byte_counts(docs, text_col).toPandas()  # of fixed size: at most 256 * 256 * 257 rows
    return PartialMatching(got["code"].to_numpy(np.int64), got["n"].to_numpy(float))


def score(docs: DataFrame, train_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, score_order2) for each row; ``train_col`` marks the rows to learn from."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs.where(F.col(train_col)), text_col))
    buckets = partitions(spark, 64)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    count = max(SHARDS, -(-size // SHARD_BYTES))
    kind = dict(docs.dtypes)[id_col]
    schema = f"block long, bucket int, ids array<{kind}>, n_tokens array<long>, score array<double>, payload binary, counts binary, sizes array<long>, texts binary"
    types = spark.createDataFrame([], schema).schema
    arrow = to_arrow(types)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, training = batch.column("id").to_pylist(), batch.column("train").to_pylist()
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts):
                vocabulary: dict[bytes, int] = {b"": 0}
                at = []
                for t in texts[a:b]:
                    at.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.lower().split()] + [0], np.uint32))
                own = [x for x, yes in zip(at, training[a:b], strict=True) if yes]
                counts = np.bincount(np.concatenate(own), minlength=len(vocabulary)) if own else np.zeros(len(vocabulary), np.int64)
                words = list(vocabulary)
                bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                rank = np.empty(len(words), np.uint32)
                rank[order] = np.arange(len(words), dtype=np.uint32)
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = {n: [] for n in arrow.names}
                rows = [(block, -1, ids[a:b], [len(x) for x in at], model.value.scores(texts[a:b]).tolist(), packed(rank[np.concatenate(at)]), None, [len(t) for t in texts[a:b]], pack(b"".join(texts[a:b])))]
                rows += [(block, k, None, None, None, pack(b" ".join(words[i] for i in order[s:e])), packed(counts[order[s:e]]), None, None) for k, (s, e) in enumerate(zip(ends, ends[1:])) if e > s]
                codes, n = distinct(texts[a:b], training[a:b])
                shard = shards(codes, count)
                order = np.argsort(shard, kind="stable")
                ends = np.searchsorted(shard[order], np.arange(count + 1))
                codes, n = codes[order], n[order].astype(np.int32)
                # neighbouring codes differ little
                rows += [(block, buckets + k, None, None, None, packed(np.diff(codes[s:e], prepend=0)), packed(n[s:e]), None, None) for k, (s, e) in enumerate(zip(ends, ends[1:])) if e > s]
                for row in rows:
                    for name, value in zip(arrow.names, row, strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
                block += 1

    sent = written(docs.select(F.col(id_col).alias("id"), F.col(train_col).alias("train"), F.col(text_col).alias("text")).mapInArrow(blocks, types).withColumn("wave", F.when(F.col("bucket") < 0, -1).otherwise(F.col("bucket") % WAVES)), "lm-blocks", by="wave")

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        if rows["bucket"].iloc[0] >= buckets:
            own = [np.cumsum(unpacked(p, np.int64)) for p in rows["payload"]]
            codes, at = np.unique(np.concatenate(own), return_inverse=True)
            n = np.bincount(at, np.concatenate([unpacked(c, np.int32) for c in rows["counts"]]), len(codes))
            logs = np.split(model.value.deep(codes, n).astype(np.float32)[at], np.cumsum([len(x) for x in own])[:-1])
            return pd.DataFrame({"block": rows["block"].to_numpy(), "counts": [packed(x) for x in logs], "bucket": rows["bucket"].to_numpy(), "n": None, "v": None})
        totals: dict[bytes, int] = {}
        words = [unpack(p).split(b" ") for p in rows["payload"]]
        for own, n in zip(words, rows["counts"], strict=True):
            for w, k in zip(own, unpacked(n, np.int64).tolist(), strict=True):
                totals[w] = totals.get(w, 0) + k
        found = [(block, packed(np.array([totals[w] for w in own], np.int64))) for block, own in zip(rows["block"], words, strict=True)]
        return pd.DataFrame([(*x, rows["bucket"].iloc[0], None, None) for x in found] + [(-1, None, rows["bucket"].iloc[0], sum(totals.values()), sum(n > 0 for n in totals.values()))], columns=["block", "counts", "bucket", "n", "v"])

    parts = []
    for wave in range(WAVES):
        asked = sent.where(F.col("wave") == wave).select("bucket", "block", "payload", "counts")
        parts.append(written(asked.groupBy("bucket").applyInPandas(add, "block long, counts binary, bucket int, n long, v long"), "lm-counts"))
        drop(sent, only=f"wave={wave}")  # answered
    answers = reduce(DataFrame.unionAll, parts)
    n, v = answers.where("block < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    below = np.log10(n + 0.1 * (v + 1))

    def base(block: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        answer = answer.sort_values("bucket")
        deep, answer = answer[answer["bucket"] >= buckets], answer[answer["bucket"] < buckets]
        counts = np.concatenate([unpacked(x, np.int64) for x in answer["counts"]])
        logs, known = np.log10(counts + 0.1) - below, counts > 0
        row = block.iloc[0]
        at = unpacked(row["payload"], np.uint32)
        sizes = np.asarray(row["n_tokens"], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ends = np.cumsum(row["sizes"])
        joined = zstandard.ZstdDecompressor().decompress(row["texts"]) if ends[-1] else b""
        texts = [joined[e - size : e] for e, size in zip(ends.tolist(), np.asarray(row["sizes"]).tolist(), strict=True)]
        codes, _ = distinct(texts)
        of_code = np.empty(len(codes), np.float32)
        of_code[np.argsort(shards(codes, count), kind="stable")] = np.concatenate([np.zeros(0, np.float32)] + [unpacked(x, np.float32) for x in deep["counts"]])
        places = np.concatenate([of_code[np.searchsorted(codes, u)][at] for u, at in (np.unique(piece, return_inverse=True) for piece in deep_codes(texts))])
        trie = np.add.reduceat(places, np.cumsum(row["sizes"] + 1) - row["sizes"] - 1, dtype=np.float64)
        return pd.DataFrame({id_col: pd.Series(list(row["ids"]), dtype=object), "n_tokens": sizes, "n_known": np.add.reduceat(known[at].astype(np.int64), starts), "train_tokens": n, "base_score": np.add.reduceat(logs[at], starts), "score": trie, "score_order2": row["score"]})

    own = sent.where("wave = -1").select("block", "ids", "n_tokens", "score", "payload", "sizes", "texts")
    got = answers.where("block >= 0").select("block", "bucket", "counts")
    return own.groupBy("block").cogroup(got.groupBy("block")).applyInPandas(base, f"{id_col} {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, score_order2 double")
