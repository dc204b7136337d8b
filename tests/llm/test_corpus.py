"""Packing, language-model scores and the Jaccard join against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import jaccard, lm, packing, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, n long, key string, block int"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 1, "k", 3) for i, t in zip(ids, texts)], DOCS)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_encoder_equals_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = queries.byte_encoder()
    rnd = random.Random(1)
    texts = [t for _, t in documents(spark)] + ["", " ", "a  b \n c\n\n d\te", "x<|endoftext|>y <|endoftext|>", "it's 12 été  z", "𝔘 漢 字"]
    texts += ["".join(rnd.choices("ab'sé1 \n\t. ", k=rnd.randrange(30))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(encode(t), np.uint16).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_shares_the_encoder_of_the_token_files():
    """The faster one, made once in each worker."""
    assert queries.byte_encoder is queries.byte_pair_encoder
    assert packing.made(queries.byte_encoder) is packing.made(queries.byte_encoder)


def test_hilbert_is_a_curve_through_all_points():
    grid = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(grid, 2)
    assert sorted(keys) == list(range(64))
    along = grid[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def check_packing(got, ids_of, length=2048):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids_of)
    for i, pieces in by_doc.items():
        at, ids = 0, ids_of[i]
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sizes = {}
    for s, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes[s] = at
    assert sorted(sizes) == list(range(len(sizes))) and all(n == length for s, n in sizes.items() if s < len(sizes) - 1) and max(sizes.values()) <= length


def test_packing_query_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: whole.encode(t, add_special_tokens=False).ids + [1] for i, t in documents(spark)}
    check_packing(queries.op5_packing(spark, SF).collect(), ids)


def test_packing_defined_cases(spark):
    encoder = lambda: lambda t: np.array([ord(c) % 1000 for c in t], np.uint16).tobytes()
    texts = [None, "", "ab", "ab", "x" * 10_000, "q" * 2047]
    got = packing.crc32_of(packing.pack(frame(spark, texts), encoder)).collect()
    check_packing(got, {i: [ord(c) % 1000 for c in t or ""] + [1] for i, t in enumerate(texts)})
    assert packing.pack(frame(spark, []), encoder).count() == 0
    twice = packing.pack(frame(spark, ["ab", "ab"], [5, 5]), encoder, length=4).collect()
    assert sorted((r.sequence_id, r.offset, r.length) for r in twice) == [(0, 0, 3), (0, 3, 1), (1, 0, 2)]


class Brute:
    """Prediction by partial matching as it is defined, one symbol at a time."""

    def __init__(self, texts):
        self.n = {}
        for t in texts:
            s = [0, 0, *t, 256]
            for i in range(2, len(s)):
                for order in (0, 1, 2):
                    self.n.setdefault(tuple(s[i - order : i]), Counter())[s[i]] += 1

    def log10(self, context, symbol):
        p, excluded = 1.0, set()
        for order in (2, 1, 0):
            seen = {k: v for k, v in self.n.get(tuple(context[2 - order :]), {}).items() if k not in excluded}
            if not seen:
                continue
            left = 257 - len(excluded | set(seen))
            whole = sum(seen.values()) + (len(seen) if left else 0)
            if symbol in seen:
                return math.log10(p * seen[symbol] / whole)
            p *= len(seen) / whole
            excluded |= set(seen)
        return math.log10(p / (257 - len(excluded)))

    def score(self, t):
        s = [0, 0, *t, 256]
        return sum(self.log10(s[i - 2 : i], s[i]) for i in range(2, len(s)))


def check_scores(got, texts, training):
    model = Brute([texts[i] for i in texts if training(i)])
    tokens = {i: [*t.lower().split(), None] for i, t in texts.items()}
    counts = Counter(w for i, own in tokens.items() if training(i) for w in own)
    total = sum(counts.values())
    for i, t in texts.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in tokens[i]))
        assert r.score_order2 == pytest.approx(model.score(t), rel=1e-5)


def test_language_model_query(spark):
    texts = {i: t.encode() for i, t in documents(spark)}
    got = rows(queries.op7_language_model(spark, SF))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0) for i in texts)
    check_scores(got, texts, lambda i: not got[i].held_out)
    model = BruteTrie([t for i, t in texts.items() if not got[i].held_out])
    for i, t in texts.items():
        assert got[i].score == pytest.approx(model.score(t), rel=1e-5)


def test_language_model_defined_cases(spark):
    texts = [None, "", "  \n", "Ab aB x", "zz " * 5000, "\x00\x00\x00", "été 漢字", "b"]
    df = frame(spark, texts).withColumn("train", F.col("doc_id") < 6)
    given = {i: (t or "").encode() for i, t in enumerate(texts)}
    check_scores(rows(lm.score(df, "train")), given, lambda i: i < 6)
    check_scores(rows(lm.score(df.withColumn("train", F.lit(False)), "train")), given, lambda i: False)
    assert lm.score(df.limit(0), "train").count() == 0


def test_probabilities_add_up():
    rnd = random.Random(3)
    texts = [bytes(rnd.choices(b"abc\x00 \xff", k=rnd.randrange(40))) for _ in range(30)]
    context, symbol, _ = lm.symbols(texts)
    codes, n = np.unique(context * lm.SYMBOLS + symbol, return_counts=True)
    model = lm.PartialMatching(codes.astype(np.int64), n.astype(float))
    assert np.allclose((10.0 ** model.log.astype(float)).sum(1), 1, atol=1e-5)


class BruteTrie(Brute):
    """The same with contexts of up to five bytes."""

    def __init__(self, texts):
        self.n = {}
        for t in texts:
            s = [0] * 5 + [*t, 256]
            for i in range(5, len(s)):
                for order in range(6):
                    self.n.setdefault(tuple(s[i - order : i]), Counter())[s[i]] += 1

    def score(self, t):
        s, total = [0] * 5 + [*t, 256], 0.0
        for i in range(5, len(s)):
            p, excluded = 1.0, set()
            for order in range(5, -1, -1):
                seen = {k: v for k, v in self.n.get(tuple(s[i - order : i]), {}).items() if k not in excluded}
                if seen:
                    whole = sum(seen.values()) + (len(seen) if len(excluded | set(seen)) < 257 else 0)
                    if s[i] in seen:
                        p *= seen[s[i]] / whole
                        break
                    p *= len(seen) / whole
                    excluded |= set(seen)
            else:
                p /= 257 - len(excluded)
            total += math.log10(p)
        return total


def test_trie_score_by_brute_force(spark):
    rnd = random.Random(7)
    texts = [None, "", "abcab", "\x00\x00a", "été 漢字", "zq" * 300] + ["".join(rnd.choices("abcde", (9, 5, 3, 1, 1), k=rnd.randrange(200))) for _ in range(60)] + ["never"]
    df = frame(spark, texts).withColumn("train", F.col("doc_id") % 4 != 3)
    for train in ("train", "none"):
        got = rows(lm.score(df.withColumn("none", F.lit(False)).repartition(3), train))
        model = BruteTrie([(t or "").encode() for i, t in enumerate(texts) if train == "train" and i % 4 != 3])
        for i, t in enumerate(texts):
            assert got[i].score == pytest.approx(model.score((t or "").encode()), rel=1e-5)


def test_trie_learns_from_contexts_longer_than_two_bytes(spark):
    texts = ["xabz"] * 20 + ["yabw"] * 20 + ["xabz", "xabw"]
    got = rows(lm.score(frame(spark, texts).withColumn("train", F.col("doc_id") < 40), "train"))
    assert got[40].score_order2 == pytest.approx(got[41].score_order2, abs=1e-4) and got[40].score > got[41].score + 1


def brute_components(texts, num, den, width):
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + width]) for k in range(max(len(words) - width + 1, 1))} if words else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_query(spark):
    texts = dict(documents(spark))
    got = rows(queries.op10_ngram_jaccard(spark, SF))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(texts, 85, 100, 4)


def test_jaccard_random_chains(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {0: None, 1: "", 2: " \n ", 3: "One two", 4: "one TWO", 5: "one two three", 6: "a b c d e f g h i j k"}
    for _ in range(40):
        words = rnd.choices(vocabulary, k=rnd.choice([5, 8, 12, 20, 35, 60, 120, 300]))
        for _ in range(rnd.randrange(1, 9)):
            texts[len(texts) * 3] = " ".join(words)
            words = list(words)
            for _ in range(rnd.randrange(0, 3)):
                k = rnd.randrange(len(words))
                words[k : k + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [words[k], "new"]])
    for num, den, width in ((85, 100, 4), (80, 100, 5)):
        got = rows(jaccard.join(frame(spark, texts.values(), texts), num, den, width))
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(texts, num, den, width)
    assert jaccard.join(frame(spark, [])).count() == 0


def test_every_linked_pair_shares_a_signature():
    rnd = np.random.default_rng(2)
    bands = jaccard.Bands(85, 100)
    for size in [*range(6, 60), 100, 333, 700]:
        for _ in range(12):
            a = rnd.integers(0, 2**63, size, np.uint64)
            most = next(k for k in range(size, -1, -1) if 100 * (size - k) >= 85 * (size + k))
            b = np.concatenate([a[most:], rnd.integers(0, 2**63, most, np.uint64)])
            for x, y in ((a, b), (a, a[: math.ceil(0.85 * size)])):
                g = {band + s for band in (bands.band(len(x)),) for s in (0, 1)} & {band + s for band in (bands.band(len(y)),) for s in (0, 1)}
                assert len(x) == len(y) and not any(map(bands.differences, g)) or any(bands.differences(k) and set(jaccard.signatures([x], k, bands)[0]) & set(jaccard.signatures([y], k, bands)[0]) for k in g)


def test_jaccard_large_groups_around_absent_centres(spark):
    rnd = random.Random(23)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for size, edits in ((150, 4), (120, 3), (90, 2)):
        base = rnd.choices(vocabulary, k=120)
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.randrange(edits + 1)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts[len(texts)] = " ".join(words)
    for num, width in ((85, 4), (95, 4)):
        got = rows(jaccard.join(frame(spark, texts.values(), texts), num, 100, width))
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(texts, num, 100, width)


def test_jaccard_passages_of_many_sets_pair_nobody(spark):
    """Unlike sets with a passage in common that their hub lacks don't meet by it; sets that link do."""
    passage = list(range(60))
    apart = {key: passage + [1000 * key + i for i in range(100)] for key in range(1, 41)} | {key: passage + list(range(90_000, 90_100)) for key in (50, 51)}
    rows = [(0, key, key, False, 200, 180 * len(x) - 20 * 200, x, -20 * 200) for key, x in apart.items()]
    frame = spark.createDataFrame(rows, "hub long, key long, root long, far boolean, n long, weight long, apart array<long>, least long")
    assert [tuple(r) for r in jaccard.meetings(frame, 80, 100).collect()] == [(0, 50, 51)]


def test_jaccard_unlike_sets_around_a_passage_meet_by_rare_elements(spark):
    """Sixty unlike sets have half of their elements from one passage: two that link are found, and the passage pairs nobody."""
    r = random.Random(5)
    passage = [r.getrandbits(63) for _ in range(100)]
    own = [sorted(passage + [r.getrandbits(63) for _ in range(100)]) for _ in range(60)]
    own += [sorted(own[7][:-4] + [r.getrandbits(63) for _ in range(4)]), sorted(own[9][:-60] + [r.getrandbits(63) for _ in range(60)])]
    arrays = [np.array(x, np.uint64) for x in own]
    sets = spark.createDataFrame([(i, len(x), bytearray(x.tobytes()), bytearray(jaccard.sketch(x))) for i, x in enumerate(arrays)], "key long, n long, elements binary, sketch binary")
    none = spark.createDataFrame([], "a long, b long")
    assert [tuple(x) for x in jaccard.rare_links(sets.select("key"), sets, none, 80, 100).collect()] == [(7, 60)]
    assert jaccard.rare_links(sets.select("key"), sets, spark.createDataFrame([(7, 60)], "a long, b long"), 80, 100).isEmpty()
    found = jaccard.rarest(sets.withColumn("root", F.col("key")), 80, 100).collect()
    assert len(found) == 62 * 41 and not {x.element for x in found} & set(passage)


def test_jaccard_hashes_words_as_they_are_split():
    """Words over the edges of a block, long ones, and any white space: the hashes tell words apart as splitting does."""
    for text in ("a A b\x0bB\x1cc \u00a0 \u00e9\u00c9", "x" * 64 + " " + "X" * 65 + " " + "x" * 65, " ".join(f"w{i % 30000}" for i in range(60000)), "y" * (jaccard.BLOCK - 3) + " word word " + "z " * 9, ""):
        words = text.encode().lower().split()
        starts, h = jaccard.word_hashes(np.frombuffer(text.encode(), np.uint8))
        assert len(starts) == len(words) and len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))


def test_jaccard_ids_and_long_texts(spark):
    rnd = random.Random(5)
    long = [f"v{rnd.randrange(9000)}" for _ in range(60_000)]
    near = [*long[:30_000], "new", *long[30_001:]]
    # ids: null, null, one id with two texts, the same row twice
    ids = [None, None, 7, 7, 9, 9, 3]
    texts = ["a b c d e f", "a b c d e f", "q r s t u", " ".join(long), "x y z w", "x y z w", " ".join(near)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, texts, ids), 85, 100, 4).collect()]
    sizes = [len({tuple(w[k : k + 4]) for k in range(len(w) - 3)}) for w in (t.split() for t in texts)]
    assert sorted(got, key=str) == sorted(zip(ids, sizes, [None, None, 7, 3, 9, 9, 3], strict=True), key=str)
