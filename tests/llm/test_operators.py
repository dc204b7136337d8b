"""The corpus operators against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from veritrail.llm import fingerprints, language, licenses, quality, queries, urls, wordpieces

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, key string, words string, part int"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "k", "w", 3) for i, t in zip(ids, texts)], DOCS)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


ODD = [None, "", "  \n ", "Same  Text", "same\ttext", "SAME TEXT", "ﬁne Straße", "fine STRASSE", "x" * 300_000, "a", "a"]


def test_fingerprints_agree_with_canonical_bytes(spark):
    got = rows(fingerprints.fingerprint(frame(spark, ODD)))
    for i, a in enumerate(ODD):
        for j, b in enumerate(ODD):
            assert (got[i].fingerprint == got[j].fingerprint) == (fingerprints.canonical(a) == fingerprints.canonical(b))


def test_fingerprints_tell_clashing_digests_apart(spark, monkeypatch):
    clash = fingerprints.digests(frame(spark, ["a"])).select("digest")
    got = rows(fingerprints.settle(fingerprints.digests(frame(spark, ["a", "b"])), clash, {"f": ("digest", "suffix")}))
    assert got[0].f.startswith(got[0].digest + "-") and got[1].f == got[1].digest


def edits(texts):
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)] or ""
        t = t or ""
        yield t, t[: len(t) - len(t) // 4] + nxt[: len(t) // 4], nxt


@pytest.mark.parametrize("n", [1, 2, 60])
def test_next_documents(spark, n):
    rnd = random.Random(n)
    texts = (ODD + ["".join(rnd.choices("abé \n😀Z", k=rnd.randrange(40))) for _ in range(100)])[:n]
    ids = sorted(rnd.sample(range(-50, 10**12), n))
    got = rows(fingerprints.with_next(frame(spark, texts, ids).repartition(5)))
    assert len(got) == n
    for i, (own, edited, nxt) in zip(ids, edits(texts), strict=True):
        r = got[i]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        c = fingerprints.canonical
        assert (r.near_edited, r.near_next) == (c(own) == c(edited), c(own) == c(nxt))


def test_fingerprint_query_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = rows(queries.op2_fingerprints(spark, SF))
    for (i, _), (own, edited, _) in zip(docs, edits([t for _, t in docs]), strict=True):
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == fingerprints.digest(fingerprints.canonical(own))


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :])[0]


def test_url_rules(spark):
    given = [None, "", "example.net/en/", "HTTP://A.Example.NET/en/x?y#z", "http://net", "http://net/", "x://b.net?/en/", "http://notnet/", "http://cnet/", "http://example.com/de/1", "http://m.example.com/de", "http://a.org/fr/1://b", "http://a.orG/fr#", "ftp://É.org/fr/", "http://example.net:80/en/"] * 2
    df = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(given)], "page_id long, url string, id int, host string")
    got = rows(urls.judge(df, queries.URL_RULES), "page_id")
    for i, u in enumerate(given):
        host, path = split_url(u)
        fits = [(n, v) for n, v in queries.URL_RULES if (host == n.split("/", 1)[0] or host.endswith("." + n.split("/", 1)[0])) and path.startswith("/" + n.split("/", 1)[1])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_url_model_by_brute_force(spark):
    train = [("http://good.example/aa/page", 1)] * 30 + [("http://spam.example/zz?x=99", 0)] * 30 + [(None, 1), ("", 0)]
    model = urls.fit(spark.createDataFrame(train, "url string, accepted int"), least=20)
    fold = lambda u: [urls.ALPHABET.find("0" if c.isdigit() else c.lower()) + 1 for c in u]

    def logp(label, u):
        import math
        from collections import Counter

        n3, n2, n1 = Counter(), Counter(), Counter()
        for t, k in train:
            if t is not None and k == label:
                s = [0, 0, *fold(t)]
                for i in range(2, len(s)):
                    n3[tuple(s[i - 2 : i + 1])] += 1
                    n2[tuple(s[i - 1 : i + 1])] += 1
                    n1[s[i]] += 1
        s, total = [0, 0, *fold(u)], 0.0
        for i in range(2, len(s)):
            a, b, c = s[i - 2 : i + 1]
            p = (n1[c] + 0.5) / (sum(n1.values()) + 0.5 * urls.SIZE)
            follow = {k: v for k, v in n2.items() if k[0] == b}
            if sum(follow.values()) >= 20:
                p = (n2[b, c] + len(follow) * p) / (sum(follow.values()) + len(follow))
            follow = {k: v for k, v in n3.items() if k[:2] == (a, b)}
            if sum(follow.values()) >= 20:
                p = (n3[a, b, c] + len(follow) * p) / (sum(follow.values()) + len(follow))
            total += math.log(p)
        return total / len(u)

    tests = ["http://good.example/aa/page", "http://spam.example/zz?x=12", "ftp://Ünknown_42", "q"]
    got = spark.createDataFrame([(u,) for u in tests], "u string").select("u", model.score(urls.F.col("u")).alias("s")).collect()
    for r in got:
        assert r.s == pytest.approx(logp(1, r.u) - logp(0, r.u), abs=1e-3)
    assert got[0].s >= model.threshold > got[1].s


def test_url_filter_without_rows(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(df, queries.URL_RULES).count() == 0


@pytest.mark.parametrize("operator, column", [(queries.op4_quality, "predicted"), (queries.op8_language, "lang_pred")])
def test_held_out_accuracy(spark, operator, column):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()} if column == "predicted" else {r.doc_id: r.lang for r in docs.collect()}
    got = rows(operator(spark, sf))
    assert len(got) == docs.count()
    held = [i for i in got if got[i].held_out and i in truth]
    mod, rest = (5, 0) if column == "predicted" else (4, 2)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % mod == rest) for i in got)
    assert sum(got[i][column] == truth[i] for i in held) / len(held) > 0.95


def test_quality_defined_cases(spark):
    labels = spark.createDataFrame([(0, 1, "x"), (1, 0, "x"), (2, 1, "x"), (3, 0, "x"), (9, None, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    got = rows(quality.classify(frame(spark, ODD, [*range(len(ODD) - 1), None]), labels))
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got.values())
    assert rows(quality.classify(frame(spark, ["a"]), labels.limit(0)))[0].score == 0.5
    assert quality.classify(frame(spark, []), labels).count() == 0


def test_language_defined_cases(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "de"), ("x", None)], "text string, lang string")
    model = language.train(train)
    assert model.langs == ["en", "fr"]
    texts = [None, "", "123 !?", "the dog", "le chien", "chie", "ÀÉ", "the " * 50_000]
    got = rows(language.identify(frame(spark, texts), model))
    assert [got[i].lang_pred for i in range(8)] == ["und", "und", "und", "en", "fr", "fr", "en", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(frame(spark, ["a"]), language.train(train.limit(0))).first().lang_pred == "und"
    assert language.identify(frame(spark, []), model).count() == 0


def test_language_backoff_prefers_words_then_long_grams():
    import numpy as np

    model = language.Backoff(["a", "b"], {"ab": np.array([-1.0, -9.0])}, {"<abc": np.array([-2.0, -3.0]), "c": np.array([-9.0, -1.0]), "d>": np.array([-5.0, -4.0])})
    assert model.unseen("abcd").tolist() == [-3.5, -3.5]
    assert [x[0] for x in model.predictor()(["ab", "c"])] == ["a", "b"]


def brute_language(model, text):
    """Word by word, as it is defined."""
    import unicodedata

    import numpy as np

    words, at = {w: r for w, r in zip(model.words.names, model.words.rows)}, ""
    runs = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()
    if not runs or not model.langs:
        return "und", 0.0
    total = sum(words[w] if w in words else model.unseen(w) for w in runs) * min(1, 16 / len(runs))
    return model.langs[int(np.argmax(total))], float(1 / np.exp(total - total.max()).sum())


def test_language_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.where("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) != 2"))
    got = rows(queries.op8_language(spark, SF))
    for d in docs.collect():
        pred, score = brute_language(model, d.text)
        assert got[d.doc_id].lang_pred == pred and got[d.doc_id].score == pytest.approx(score, rel=1e-4)


def test_language_letters_and_many_words(spark):
    # more words than the tables once held, and numerals that are no letters
    train = spark.createDataFrame([(" ".join(f"a{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}{x}" for i in range(60_000)), x) for x in ("k", "z")], "text string, lang string")
    model = language.train(train)
    assert len(model.words.names) == 120_000
    got = rows(language.identify(frame(spark, ["½ ² Ⅷ", "١٢", "aaaaak", "azzzdz", "ab " * 900_000, None, "aaaaak", "aaaaak"]), model))
    assert [got[i].lang_pred for i in (0, 1, 5)] == ["und"] * 3 and [got[i].lang_pred for i in (2, 6, 7)] == ["k"] * 3 and got[2].known == 1
    assert language.sampled(train, 1, "text", "lang").count() <= 2


def greedy(word, initial, continuing):
    n, at = 0, 0
    while at < len(word):
        own = continuing if at else initial
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in own), 0)
        if not size:
            return -1
        at, n = at + size, n + 1
    return n


def test_longest_match_against_greedy():
    rnd = random.Random(5)
    for _ in range(300):
        pieces = lambda: {"".join(rnd.choices("abc", k=rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 9))}
        initial, continuing = pieces(), pieces()
        count = wordpieces.LongestMatch(initial, continuing).count
        for _ in range(60):
            w = "".join(rnd.choices("abc", k=rnd.randrange(0, 12)))
            assert count(w) == greedy(w, initial, continuing), (w, initial, continuing)


def test_token_counts_on_documents(spark):
    import public_tokenizers

    vocabulary = wordpieces.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    initial, continuing = map(set, vocabulary)
    texts = [*ODD[:8], "unchained melody 漢字 \U0001f600", "ab" * 5000]
    got = rows(wordpieces.count_tokens(frame(spark, texts), vocabulary))
    for i, t in enumerate(texts):
        n = [greedy(w, initial, continuing) for w in (t or "").split()]
        assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len(n), sum(abs(x) for x in n), n.count(-1))
    assert wordpieces.count_tokens(frame(spark, []), vocabulary).count() == 0


LICENSED = [
    None, "", "?!", "Licensed UNDER the MIT-License.", "under the mit license under the mit license", "under the mit licenses", "x apache license, version 2.0 y", "cc by nc 4.0 under the MIT license; CC BY NC",
    "GNU Lesser General Public License version 3", "GNU General Public License, version 3", "gnu lesser general public license v3 and the gnu general public license v2", "été under the mit license", "mit " * 1000,
    "released under the bsd 3 clause license", "SPDX-License-Identifier: MPL-2.0",
]


def test_license_base_columns(spark):
    got = rows(licenses.scan(frame(spark, LICENSED)))
    for i, t in enumerate(LICENSED):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None)), t
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert {x for x in r.base_labels.split(",") if x} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[8].labels == "lgpl-3" and got[9].labels == "gpl-3" and got[10].labels == "gpl-2,lgpl-3"
    assert got[13].labels == "bsd-3-clause" and got[12].labels == ""


def test_license_intervals_by_brute_force(spark):
    table = licenses.rules()
    assert all(any(h in f" {x} " for h in licenses.HINTS) for f in licenses.FAMILIES for x in f[2]) and {"cc", "commons"} >= {r["keyword"].strip() for r in table if r["label"].startswith("cc-")}
    assert len(table) > 300 and len({r["priority"] for r in table}) == len(table)
    for r in licenses.scan(frame(spark, LICENSED)).collect():
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), LICENSED[r.doc_id] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        text = "".join(f" {w}" for w in words) + " "
        found = [(m.start(), m.end(), x["priority"], x["label"]) for x in table if x["keyword"] in text for m in re.finditer(x["pattern"], text)]
        kept = [a for a in found if not any(b[0] <= a[0] and b[1] >= a[1] and (b[1] - b[0] > a[1] - a[0] or b[2] < a[2]) for b in found)]
        assert sorted(kept) == sorted((d.start, d.stop, d.priority, d.label) for d in r.detections), LICENSED[r.doc_id]


def sample(pattern, rnd):
    """A random text that a rule's pattern matches, its lookaheads left out."""
    import re._constants as c
    import re._parser as parser

    def draw(tree):
        out = ""
        for op, arg in tree:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.MAX_REPEAT:
                out += "".join(draw(arg[2]) for _ in range(rnd.randint(arg[0], min(arg[1], 2))))
            elif op is c.SUBPATTERN:
                out += draw(arg[3])
            elif op is c.BRANCH:
                out += draw(rnd.choice(arg[1]))
            elif op is c.IN:
                out += draw([rnd.choice(arg)])
            else:
                assert op in (c.ASSERT, c.ASSERT_NOT)
        return out

    return draw(parser.parse(pattern))


def test_every_license_rule_passes_its_gates(spark):
    rnd = random.Random(9)
    table = licenses.rules()
    cases = [(r, sample(r["pattern"], rnd) + " ") for r in table for _ in range(4)]
    cases = [(r, t, m) for r, t in cases if (m := re.search(r["pattern"], t))]
    assert {r["priority"] for r, _, _ in cases} == {r["priority"] for r in table}
    got = rows(licenses.scan(frame(spark, [t for _, t, _ in cases])))
    for i, (r, t, m) in enumerate(cases):
        assert any(d.start <= m.start() and d.stop >= m.end() for d in got[i].detections), (r, t)


@pytest.mark.parametrize("text, labels", [
    ("released under GPLv3", "gpl-3"), ("LGPLv2.1 or later", "lgpl-2.1"), ("gplv2+", "gpl-2"), ("AGPLv3", "agpl-3"), ("the Expat License", "mit"),
    ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache-2"), ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("SPDX-License-Identifier: ISC", "isc"), ("SPDX-License-Identifier: EPL-2.0", "epl-2.0"), ("SPDX-License-Identifier: GPL-3.0-only", "gpl-3"), ("licensed under Apache-2.0", "apache-2"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated", "mit"), ("the Apache 2.0 License", "apache-2"), ("wer mit dem Apache 2 Server", ""),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gpl-3"),
])
def test_license_signatures(spark, text, labels):
    assert licenses.scan(frame(spark, [text])).first().labels == labels


def test_a_url_of_a_megabyte(spark):
    long = "http://good.example/" + "a1/é" * 250_000
    df = spark.createDataFrame([(i, u) for i, u in enumerate([long, "http://a.net/x", "http://example.net/en/y"] * 2)], "page_id long, url string")
    got = rows(urls.judge(df, queries.URL_RULES), "page_id")
    assert got[0].path == "/" + "a1/é" * 250_000 and got[0].score == got[3].score


def test_url_query_whole_table(spark):
    given = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = rows(queries.op3_url_filter(spark, SF), "page_id")
    assert got.keys() == given.keys()
    for i, u in given.items():
        host, path = split_url(u)
        fits = [(n, v) for n, v in queries.URL_RULES if (host == n.split("/", 1)[0] or host.endswith("." + n.split("/", 1)[0])) and path.startswith("/" + n.split("/", 1)[1])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict == (verdict or got[i].verdict)


def test_a_text_of_many_licenses(spark):
    text = "under the mit license and the gnu general public license version 2 or cc by nc 4.0, " * 5000
    r = licenses.scan(frame(spark, [text])).first()
    assert r.labels == "cc-by-nc,cc-by-nc-4.0,gpl-2,mit" and r.n_base == 10_000 and len(r.detections) == 15_000
    found = sorted((d.start, d.stop) for d in r.detections)
    assert len(set(found)) == 15_000 and all(a[1] <= b[0] + 1 for a, b in zip(found, found[1:]))


def test_license_query_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = rows(queries.op6_licenses(spark, SF))
    for d in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or ""))
        at = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
