"""Decontamination against planted passages, and the pipeline stage by stage."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from veritrail.llm import decontaminate, queries

from .test_corpus import brute_components, check_packing

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, item_id long, id int, cosine string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 1, "k") for i, t in enumerate(texts)], DOCS)


def bench(spark, texts):
    return spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "item_id long, text string, doc_id int")


def test_common_subsequence():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = (rnd.choices("abcd", k=rnd.randrange(12)) for _ in range(2))
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
        assert decontaminate.common(a, b) == n[-1][-1]


def test_planted_passages(spark):
    rnd = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("", "n", "st", "lor", "mi")]
    common = vocabulary[:20]
    text = lambda n: [rnd.choice(common if rnd.random() < 0.4 else vocabulary) for _ in range(n)]
    items = [text(rnd.randrange(14, 60)) for _ in range(30)] + [text(6), [], text(300)]
    docs, truth = [None, "", "a b"], set()
    for d in range(120):
        body = text(rnd.choice([5, 60, 500, 3000]))
        if d % 3 == 0:
            k = rnd.choice([i for i in range(len(items)) if items[i]])
            words = list(items[k])
            if d % 2 and len(words) >= 14:
                for _ in range(len(words) // 10):
                    words[rnd.randrange(len(words) * 3 // 4)] = rnd.choice(vocabulary)
            at = rnd.randrange(len(body) + 1)
            body = body[:at] + [w.upper() + "," if rnd.random() < 0.2 else w for w in words] + body[at:]
            truth.add((len(docs), k))
        docs.append(" ".join(body))
    got = decontaminate.contaminated(frame(spark, docs), bench(spark, [" ".join(i) for i in items] + [None]), block=20).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(found) == len(got) and found >= truth and len(found - truth) <= 1
    assert decontaminate.contaminated(frame(spark, []), bench(spark, ["a b"])).count() == 0
    assert decontaminate.contaminated(frame(spark, docs), bench(spark, [])).count() == 0


def test_paraphrases_by_all_windows(spark):
    rnd = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("", "n", "st", "lor", "mi", "ras")]
    text = lambda n: [rnd.choice(vocabulary[:25] if rnd.random() < 0.4 else vocabulary) for _ in range(n)]
    items, docs = [text(rnd.randrange(15, 60)) for _ in range(25)], []
    for d in range(100):
        words = list(items[d % len(items)])
        for _ in range(len(words) * (d // len(items)) // 10):  # up to three words in ten
            k, kind = rnd.randrange(len(words)), rnd.randrange(3)
            words[k : k + 1] = [[], [rnd.choice(vocabulary)], [words[k], rnd.choice(vocabulary)]][kind]
        body = text(rnd.randrange(150))
        at = rnd.randrange(len(body) + 1)
        docs.append([w.encode() for w in body[:at] + words + body[at:]])
    items = [[w.encode() for w in i] for i in items]
    judge = decontaminate.Search(None, [], items, 0, 0.75, 0.6, 0.75).judge
    truth = set()
    for d, words in enumerate(docs):
        for k, item in enumerate(items):
            length = decontaminate.length_of(item)
            if any(judge(item, words[max(s - length // 2, 0) : s + length + length // 2]) for s in range(len(words))):
                truth.add((d, k))
    docs, items = ([b" ".join(x).decode() for x in own] for own in (docs, items))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, docs), bench(spark, items)).collect()}
    assert len(truth) >= 90 and got <= truth and len(got) >= 0.95 * len(truth)
    # the same whatever the blocks; repeated rows as often as they occur
    again = decontaminate.contaminated(frame(spark, docs).union(frame(spark, docs[:3])), bench(spark, items), block=7)
    assert {(r.doc_id, r.item_id) for r in again.collect()} >= {x for x in got if x[0] < 3}


def test_the_basis_is_fitted_on_no_sample(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    items = [rnd.sample(words, 20) for _ in range(10)]
    docs = [rnd.sample(words, 10) + (items[d % 10] if d % 400 < 10 else []) for d in range(4000)]
    found = []
    for shift in (0, 10_000):  # a sample by the ids would be another one
        rows = spark.createDataFrame([(i + shift, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
        got = decontaminate.contaminated(rows, bench(spark, [" ".join(i) for i in items])).collect()
        found.append(sorted((r.doc_id - shift, r.item_id, round(r.cosine, 2), r.overlap) for r in got))
    assert found[0] == found[1] and {x[:2] for x in found[0]} >= {(d, d % 10) for d in range(4000) if d % 400 < 10}


def test_a_passage_in_a_long_text(spark):
    item = [f"w{i}" for i in range(40)]
    docs = [" ".join([*(f"x{i % 97}" for i in range(at)), *item, *(f"y{i % 89}" for i in range(100_000 - at))]) for at in (0, 19_990, 40_000, 100_000)]
    got = decontaminate.contaminated(frame(spark, docs), bench(spark, [" ".join(item), "one two three four five six seven eight"])).collect()
    assert sorted((r.doc_id, r.item_id, r.overlap) for r in got) == [(d, 0, 1.0) for d in range(4)]


def test_every_verbatim_passage_is_found(spark):
    sf = "/root/testdata/sf0.01"
    words = lambda t: b" " + b" ".join(decontaminate.words_of(t)) + b" "
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    truth = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r.doc_id, r.item_id): r for r in queries.op1_decontamination(spark, sf).collect()}
    assert set(got) >= truth and truth
    assert all(r.overlap >= 0.6 for r in got.values()) and len(got) <= 2 * len(truth)


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        out.append((before, docs))
    return out


def test_filters_keep_columns_and_whole_rows(spark, kept):
    for before, after in kept[:-1]:
        assert after.columns == before.columns and after.subtract(before).isEmpty() and 0 < after.count() <= before.count()


def test_quality_and_language_stages(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in kept[0][1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in left for i in good) >= 0.98 * len(good) and sum(i in left for i in bad) <= 0.2 * len(bad)
    assert kept[1][1].count() >= 0.99 * kept[1][0].count()


def test_near_duplicate_stage(spark, kept):
    before, after = kept[2]
    truth = brute_components({r.doc_id: r.text for r in before.collect()}, 80, 100, 5)
    assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in truth.items() if c == i}


def test_decontamination_stage(spark, kept):
    before, after = kept[3]
    items = [b" ".join(decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: b" ".join(decontaminate.words_of(r.text)) for r in before.collect()}
    left = {r.doc_id for r in after.collect()}
    assert not any(x in texts[i] for i in left for x in items) and len(left) > 0.8 * len(texts)


def test_packing_stage(spark, kept):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = kept[4]
    check_packing(after.collect(), {r.doc_id: whole.encode(r.text, add_special_tokens=False).ids + [1] for r in before.collect()})


def test_run_gives_the_last_stage(spark, kept):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(got.select("doc_id", "start", "ids_crc32").collect()) == sorted(kept[-1][1].select("doc_id", "start", "ids_crc32").collect())


def test_filters_take_odd_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the cat", "en", "s", 7), (3, "the cat", "en", None, 7)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns and stage(spark, docs, SF).count() <= 4
        stage(spark, docs.limit(0), SF).count()
