"""Vector codes, token files and the filter audit against brute force."""

from __future__ import annotations

import glob
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from veritrail.llm import interaction_audit, queries, token_files, vector_codes

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, id string, row int, position int, part string, weight long, code int"
DOCS = "doc_id long, text string, lang string, source string, ids string, start string, n_tokens string, file string, digest string, mask string, row string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 7, 7, "p", 7, 7) for i, v, label in rows], VECTORS)


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Straight from the definition, with Python's whole numbers."""
    good = [(i, [math.floor(x * scale) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1]) // parts if good else 0
    good = [r for r in good if len(r[1]) == width * parts]
    cut = [[r[1][p * width : (p + 1) * width] for r in good] for p in range(parts)]
    books = [[list(v) for v in cut[p][:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, v: min((square(v, e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut[p]:
                groups.setdefault(best(p, v)[1], []).append(v)
            for i, own in groups.items():
                books[p][i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = []
    for k, (i, _, label) in enumerate(good):
        found = [best(p, cut[p][k]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], sha) for i, c, e, label in out), key=str)


def codes(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_codes_of_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = codes(queries.op11_vector_codes(spark, SF))
    assert len(got) == len(rows)
    want = c.execute(queries.OP11)
    names = [d[0] for d in want.description]
    assert got == sorted((tuple(dict(zip(names, r, strict=True))[n] for n in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in want.fetchall()), key=str)
    assert got == brute_codes(rows)


def test_codes_of_odd_vectors(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-0.5, 0.25, 0.0, -0.0001, 3.0]) for _ in range(8)], rnd.choice([None, 1, 2])) for i in range(120)]
    rows += [(5, [0.1] * 8, 1)] * 40 + [(900 + i, [0.1] * 8, None) for i in range(60)]  # repeated ids, one very common vector
    rows += [(None, [1.0] * 8, 2), (None, None, None), (300, None, 1), (301, [None] * 8, 1), (302, [float("nan")] * 8, 1), (303, [float("inf")] + [0.0] * 7, 1), (304, [], 1), (305, [1.0] * 4, 1)]
    rnd.shuffle(rows)
    assert codes(vector_codes.compress(vectors(spark, rows), entries=16)) == brute_codes(rows, entries=16)
    few = rows[:3] + [(1, [2.0] * 8, None)]
    assert codes(vector_codes.compress(vectors(spark, few))) == brute_codes(few)
    assert codes(vector_codes.compress(vectors(spark, []))) == codes(vector_codes.compress(vectors(spark, [(1, None, 2)]))) == []


def test_codes_that_cannot_be_made(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(vectors(spark, [(1, [1.0] * 6, 1)]))
    with pytest.raises(Exception, match="2\\^26"):
        vector_codes.compress(vectors(spark, [(1, [1e9] * 8, 1)]))


def test_large_components_are_exact(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-65000, 65000) for _ in range(8)], 1) for i in range(60)]
    assert codes(vector_codes.compress(vectors(spark, rows), entries=8)) == brute_codes(rows, entries=8)


def test_codes_are_decoded(spark):
    rows = [(i, [i % 3 / 8.0] * 8, i % 2) for i in range(30)]
    df = vectors(spark, rows)
    books, distinct = vector_codes.fit(df)
    assert distinct.count() == 12  # equal parts are one row
    back = vector_codes.decode(vector_codes.encode(df, books, distinct), books).collect()
    for r in back:
        assert r.error == 0 and np.allclose(r.vector, rows[r.vec_id][1], atol=1 / 1024)


# ---- token files ----


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", *["x"] * 7) for i, t in rows], DOCS)


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute_tokens(rows, end=2):
    encode, out, start = tokenizer(), [], 0
    for i, t in rows:
        ids = encode.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_encoder_equals_the_tokenizer():
    rnd, whole, encode = random.Random(2), tokenizer(), queries.byte_pair_encoder()
    texts = ["", " ", "a  b \n c\n\n d\te", "x<|endoftext|>y <|endoftext|>", "it's 12 été  z", "𝔘 漢 字"] + ["".join(rnd.choices("ab'sé1 \n\t. ", k=rnd.randrange(30))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(encode(t), np.uint16).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_of_the_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = queries.op12_token_files(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == brute_tokens(rows)


def test_token_files_of_odd_documents(spark, tmp_path):
    rows = [(None, "no id"), (3, None), (1, ""), (2, "a <|endoftext|> b"), (7, "été 漢字 \n\n x" * 20000), (5, "same"), (5, "same"), (None, "no id"), (-4, "first")]
    path = f"{tmp_path}/a"
    token_files.write(documents(spark, rows), queries.byte_pair_encoder, path, files=3)
    got = sorted(map(tuple, token_files.with_crc32(token_files.read(spark, path)).collect()), key=lambda r: r[1])
    assert got == brute_tokens(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    empty = f"{tmp_path}/empty"
    token_files.write(documents(spark, []), queries.byte_pair_encoder, empty)
    assert token_files.with_crc32(token_files.read(spark, empty)).count() == token_files.metadata(spark, empty).count() == 0


def test_a_hot_id_is_spread_over_files(spark, tmp_path):
    rows = [(1, f"text {i}") for i in range(300)] + [(1, "copy")] * 300 + [(i, "x") for i in range(300)]
    token_files.write(documents(spark, rows).repartition(4), queries.byte_pair_encoder, f"{tmp_path}/hot", files=6)
    files = spark.read.parquet(f"{tmp_path}/hot")
    assert max(r["count"] for r in files.groupBy("file").count().collect()) < 300
    got = sorted(map(tuple, token_files.metadata(spark, f"{tmp_path}/hot").select("start", "n_tokens", "doc_id").collect()))
    assert [r[0] for r in got] == list(itertools.accumulate([r[1] for r in got], initial=0))[:-1]
    assert [r[2] for r in got] == sorted(r[0] for r in rows)


def scan_rows(df):
    """The rows that the scan gave: page and row-group skipping shows in it."""
    df.collect()
    plan, stack = df._jdf.queryExecution().executedPlan(), []
    stack.append(plan)
    while stack:
        node = stack.pop()
        if "Scan parquet" in node.nodeName():
            return node.metrics().apply("numOutputRows").value()
        name = node.getClass().getSimpleName()
        children = node.executedPlan() if name == "AdaptiveSparkPlanExec" else None
        stack += [children] if children is not None else [node.children().apply(i) for i in range(node.children().size())]
    raise AssertionError("no scan")


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_layout_and_selective_reads(spark, tmp_path, encoding):
    rows = [(i, f"document {i} " + "some words of it " * 40) for i in range(6000)]
    path = f"{tmp_path}/layout"
    token_files.write(documents(spark, rows), queries.byte_pair_encoder, path, files=2, keep=("lang",), encoding=encoding, row_group_rows=1000, page_bytes=1 << 13)
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        assert meta.num_row_groups > 1
        for g in range(meta.num_row_groups):
            chunks = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert all(c.has_offset_index and c.has_column_index for c in chunks.values())
            ids = chunks[token_files.IDS]
            assert ("RLE_DICTIONARY" in ids.encodings) == (encoding == "dictionary") and ("DELTA_BINARY_PACKED" in ids.encodings) == (encoding == "delta")
            assert "DELTA_BINARY_PACKED" in chunks["doc_id"].encodings and chunks["doc_id"].statistics.has_min_max
    files = spark.read.parquet(path)
    few = files.where("doc_id BETWEEN 100 AND 103").select("doc_id", "ids")
    assert few.count() == 4 and scan_rows(few) <= 200  # row groups and pages of the other documents are skipped
    assert "ids" not in token_files.metadata(spark, path).columns
    plan = token_files.metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in re.search(r"ReadSchema: (\S+)", plan).group(1)
    assert sorted(r.doc_id for r in token_files.read(spark, path, "doc_id >= 5998").collect()) == [5998, 5999]
    want = {r[0]: r for r in brute_tokens(rows)}
    assert [tuple(r) for r in token_files.with_crc32(token_files.read(spark, path, "doc_id = 5000")).collect()] == [want[5000]]


def test_no_such_encoding():
    with pytest.raises(ValueError, match="encoding"):
        token_files.layout("plain")


# ---- filter audit ----


def brute_audit(docs, labels):
    texts = {}
    for i, t, _ in docs:
        texts.setdefault(t or "", []).append(i)
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i for j in texts[t])}
        own = [x for x in labels if x[0] == i and i is not None]
        rows.append((lang or "", {f for f, x in fails.items() if x}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {r[0] for r in rows}:
        own, cells, shapley = [r for r in rows if r[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = [r for r in own if r not in left or set(order[: step - 1]) & r[1]]
                left = [r for r in left if f not in r[1]]
                cells.append(["".join(order), step, f, len(left), len(gone), sum(f in r[1] for r in before), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
                shapley[f] += len(gone)
        out += [(part, o, s, k, r, d, u, g, x, shapley[f]) for o, s, f, k, r, d, u, g, x in cells]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = "doc_id long, quality int, toxic int, id string, digest string, mask int, n int"


def test_audit_of_the_table(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    got = queries.op13_filter_audit(spark, SF)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == brute_audit(docs, labels)


def test_audit_of_odd_documents(spark):
    rnd = random.Random(9)
    long = " ".join(f"w{i}" for i in range(250))
    texts = ["", None, " \t\n", "CAPS", long, long + " #", long.upper(), "a " * 400, "A b | c", "x y " * 300, long + "  " + long]
    docs = [(rnd.choice([None, *range(40)]), rnd.choice(texts), rnd.choice([None, "", "en", "fr"])) for _ in range(150)] + [(50 + i, "copy of all", "en") for i in range(100)] + [(50, "copy of all", "en")] * 5
    labels = [(rnd.choice([None, *range(60)]), rnd.choice([None, 0, 1]), rnd.choice([None, 0, 1])) for _ in range(80)]
    frame = spark.createDataFrame([(i, t, lang, "s", *["x"] * 7) for i, t, lang in docs], DOCS)
    known = spark.createDataFrame([(*x, "x", "x", 1, 1) for x in labels], LABELS)
    assert sorted(map(tuple, interaction_audit.audit(frame, known).select(COLUMNS).collect())) == brute_audit(docs, labels)
    assert sorted(map(tuple, interaction_audit.audit(frame, known.limit(0)).select(COLUMNS).collect())) == brute_audit(docs, [])
    assert interaction_audit.audit(frame.limit(0), known).count() == 0


def test_matrices():
    m = interaction_audit.incidence()
    assert all(x.shape == (32, 600) for x in m.values())
    assert ((m["kept"][:, 4::5] + m["removed"].reshape(32, 120, 5).sum(2)) == 1).all()  # a document is kept at the end or removed once
