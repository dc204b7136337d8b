"""Text functions, canonical JSON, sinks, ranks and learned scores against plain Python."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.functions import canonical, redaction, sections
from veritrail.operators import learning, stats
from veritrail.sources import sinks


def texts_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# ---- redaction ----


def brute_redacted(text):
    dictionary = {}

    def token(kind, v):
        own = dictionary.setdefault(kind, [])
        if v not in own:
            own.append(v)
        return f"<redacted-{kind}-{own.index(v) + 1}>"

    links = re.findall(redaction.URL, text)
    parts = re.split(redaction.URL, text)
    for p in parts:
        for m in re.finditer(redaction.ACCOUNT, p):
            token("user", m[1].lower())
    for p in parts:
        for m in re.finditer(redaction.USER_IN_PATH, p):
            token("user", m[1].lower())
    for p in parts:
        for m in re.finditer(redaction.ACCOUNT, p):
            token("host", m[2].lower())
    cut = lambda m: re.sub(r"[\\/]$", "", re.sub(r"[^\\/]*$", "", m))
    for pattern in (redaction.WINDOWS_PATH, redaction.POSIX_PATH):
        for p in parts:
            for m in re.finditer(pattern, p):
                token("path", cut(m[0]))
    for kind, pattern in redaction.PLAIN.items():
        for p in parts:
            for m in re.finditer(pattern, p):
                token(kind, m[0])
    known = lambda kind, v: token(kind, v) if v in dictionary.get(kind, []) else v

    def part(p):
        p = re.sub(redaction.ACCOUNT, lambda m: f"{token('user', m[1].lower())}@{token('host', m[2].lower())}", p)
        for pattern in (redaction.WINDOWS_PATH, redaction.POSIX_PATH):
            p = re.sub(pattern, lambda m: known("path", cut(m[0])) + m[0][len(cut(m[0])) :], p)
        for kind, pattern in redaction.PLAIN.items():
            p = re.sub(pattern, lambda m, kind=kind: known(kind, m[0]), p)
        names = sorted({*dictionary.get("user", []), *dictionary.get("host", [])}, key=lambda v: (-len(v), v))
        either = "|".join([redaction.TOKEN, *[re.escape(v) for v in names if len(v) >= redaction.LEAST]])
        own = lambda m: m[0] if re.fullmatch(redaction.TOKEN, m[0], re.I) else known("user", m[0].lower()) if m[0].lower() in dictionary.get("user", []) else known("host", m[0].lower())
        return re.sub(either, own, p, flags=re.I)

    out = [part(p) for p in parts]
    return "".join(a + b for a, b in zip(out, [*links, ""], strict=True)), {k: len(v) for k, v in dictionary.items()}


def test_redaction_by_brute_force(spark):
    rnd = random.Random(3)
    bits = ["alice@build01:", "ALICE", "/home/alice/run/out.log", "/tmp/x/", r"C:\Users\Bob\data\file.txt", "see https://a.b/home/alice/x now", "cleanup-build01-7.bat", "bob", "mail me: carol.d@mail.example.com", "10.0.0.1", "10.0.0.12", "10.0.0.1", "a" * 40, "4111111111111111", "plain words", "é", "<redacted-user-9>", "\n", ""]
    texts = [" ".join(rnd.choices(bits, k=rnd.randrange(1, 14))) for _ in range(150)] + ["", "nothing here", "alice@build01: alice@build01: ALICE build01"]
    rows = texts_of(spark, texts).select("doc_id", "text", F.struct(*[v.alias(k) for k, v in redaction.learned(F.col("text")).items()]).alias("seen"))
    got = rows.select("doc_id", redaction.redacted(F.col("text"), {k: F.col(f"seen.{k}") for k in ["user", "host", "path", *redaction.PLAIN]}).alias("out"), *[F.size(f"seen.{k}").alias(k) for k in ("user", "host", "mail", "address")]).collect()
    for r in got:
        want, counts = brute_redacted(texts[r.doc_id])
        assert r.out == want, texts[r.doc_id]
        assert all(r[k] == counts.get(k, 0) for k in ("user", "host", "mail", "address"))
    clean = spark.createDataFrame([(r.out,) for r in got], "t string").select(redaction.leaks(F.col("t")).alias("x")).collect()
    assert not any(r.x for r in clean) and any(r.x for r in rows.select(redaction.leaks(F.col("text")).alias("x")).collect())


def test_redaction_of_long_texts_without_personal_data(spark):
    """What can't hold a value isn't searched for it: the patterns take time in the square of a word's length."""
    text = "a." * 60_000
    start = time.monotonic()
    rows = spark.createDataFrame([(text,)], "text string").withColumn("seen", redaction.dictionary(F.col("text")))
    assert rows.select(redaction.redacted(F.col("text"), {k: F.col(f"seen.{k}") for k in redaction.KINDS}).alias("out")).first().out == text
    assert time.monotonic() - start < 20


# ---- sections ----


def brute_sections(text, phrases):
    all_ = text.split("\n")
    heads = [(i, len(m[1]), m[2]) for i, x in enumerate(all_) if (m := re.match(sections.HEADING, x))]
    out, until = [], 0
    for k, (i, level, title) in enumerate(heads):
        norm = re.sub("[^a-z0-9]+", " ", title.lower()).strip()
        if not any(norm == p or norm.endswith(" " + p) for p in phrases):
            continue
        stop = next((j for j, lv, _ in heads[k + 1 :] if lv <= level), len(all_))
        if i >= until:
            out.append((title, level, i, stop, "\n".join(all_[i:stop]).rstrip(" ")))
            until = stop
    return out


def test_sections_by_brute_force(spark):
    rnd = random.Random(5)
    lines = ["# Model", "## Evaluation", "### Results", "## Results of training", "## 4. Evaluation Results", "# Training results ##", "text on arc", "| a | b |", "", "#nothing", "mmlu 5"]
    texts = ["\n".join(rnd.choices(lines, k=rnd.randrange(1, 30))) for _ in range(200)] + [None, ""]
    phrases, names = ["evaluation", "results"], ["arc", "mmlu"]
    got = texts_of(spark, texts).select("doc_id", sections.sections(F.col("text"), phrases).alias("s"), sections.presence(F.col("text"), phrases, names).alias("p"), sections.mentions(F.col("text"), phrases, names).alias("m")).collect()
    for r in got:
        text = texts[r.doc_id] or ""
        assert [tuple(x) for x in r.s] == brute_sections(text, phrases)
        assert r.p.section == any(re.fullmatch(r"#+ .*(Evaluation|[Rr]esults)( ##)?", x) for x in text.split("\n")) and r.p.table == ("| a |" in text)
        assert r.p.named == [n for n in names if n in text]
        last, want = None, []
        for i, x in enumerate(text.split("\n")):
            m = re.match(sections.HEADING, x)
            last = m[2] if m else last
            want += [(i, n, last, last is not None and bool(re.search("(^| )(evaluation|results)$", last.lower()))) for n in names if n in x]
        assert [tuple(x) for x in r.m] == want


def brute_unwrapped(text):
    """Line by line, with what has been written so far at hand."""
    vocabulary = {w.lower() for w in re.findall(r"[A-Za-z][A-Za-z-]{2,}", text)}
    out = []
    for i, raw in enumerate(text.split("\n")):
        line, before = raw.rstrip(), out[-1] if out else ""
        stem = re.search(r"([A-Za-z]{2,})-$", before)
        tail = line.lstrip().split(" ", 1)[0].strip(".,;:)")
        if stem and line.strip() and tail[:1].islower():
            word = stem[1] + ("" if (stem[1] + tail).lower() in vocabulary else "-") + tail
            rest = line.lstrip().split(" ", 1)
            out[-1] = before[: stem.start()] + word + (" " + rest[1] if len(rest) > 1 else "")
        elif before and line.strip() and before[-1] not in ".!?:;•-" and (line.lstrip()[:1].islower() or line.lstrip()[:1].isdigit()):
            out[-1] = before + " " + line.lstrip()
        else:
            out.append(line if line.strip() or i == 0 else "")
    return "\n".join(out)


def test_broken_lines_by_brute_force(spark):
    rnd = random.Random(8)
    lines = ["the exam-", "ple, of it", "ple", "Example here", "example", "ends.", "goes on", "2 more", "- item", "co-", "operate", "Co-operate", "well-", "known;", "", "  indented", "stops:"]
    texts = ["\n".join(rnd.choices(lines, k=rnd.randrange(1, 12))) for _ in range(400)] + ["", "a"]
    got = {r.doc_id: r.out for r in texts_of(spark, texts).select("doc_id", sections.unwrapped(F.col("text")).alias("out")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_unwrapped(t), repr(t)


# ---- canonical JSON ----


def test_canonical_digests(spark):
    docs = [{"b": 1.0, "a": [1e5, {"z": None, "y": "é\n"}], "hash": "x", "signature": "y"}, {"a": {}, "￿": 2, "𝔘": 1, "guardrailAction": {"x": 1}}, [1, {"b": 1, "a": 2}], "text"]
    raw = [json.dumps(d) for d in docs] + [json.dumps(docs[0], indent=2), '{"signature":"q","hash":"w","a":[100000.0,{"y":"\\u00e9\\n","z":null}],"b":1.0}', "not json", None]
    got = texts_of(spark, raw).select("doc_id", canonical.document_hash(F.col("text")).alias("d"), canonical.measurement_hash(F.col("text")).alias("m")).orderBy("doc_id").collect()
    plain = lambda v: hashlib.sha256(json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    less = lambda v, keys: {k: x for k, x in v.items() if k not in keys} if isinstance(v, dict) else v
    assert [r.d for r in got[:4]] == [plain(less(d, canonical.INTEGRITY)) for d in docs]
    assert [r.m for r in got[:4]] == [plain(less(d, canonical.INTEGRITY + canonical.ACTIONS)) for d in docs]
    assert got[4].d == got[5].d == got[0].d  # the order of keys and white space don't matter
    assert got[6].d is None and got[7].d is None
    context = spark.createDataFrame([('{"@context": "v1", "a": 1}', '{"t": "i"}')], "d string, c string").select(canonical.document_hash(F.col("d"), F.col("c")).alias("h")).collect()[0].h
    assert context == plain({"@context": {"t": "i"}, "a": 1})
    block = {"by": "me", "n": 1.5}
    rows = [(json.dumps({**block, "hash": "sha256:" + plain(block)}),), (json.dumps({**block, "hash": "0"}),), (json.dumps(block),)]
    assert [r.x for r in spark.createDataFrame(rows, "t string").coalesce(1).select(canonical.intact(F.col("t")).alias("x")).collect()] == [True, False, False]


def test_forbidden_names(spark):
    docs = ['{"decision":1,"parentDecision":2,"x":[{"action":{"decision":3}}],"engineerDecision":{"decision":4},"y":{"engineerDecision":{"decision":5}}}', "[]", "no", None, '[{"action":1}]']
    got = canonical.forbidden(texts_of(spark, docs), "doc_id", "text", ("decision", "action")).collect()
    assert sorted(map(tuple, got)) == [(0, "$.decision", "decision"), (0, "$.x[0].action", "action"), (0, "$.x[0].action.decision", "decision"), (0, "$.y.engineerDecision.decision", "decision"), (4, "$[0].action", "action")]


def test_entries(spark):
    got = canonical.entries(texts_of(spark, ['{"a":{"b":[1,"x"],"c":null}}', "{}", "no", None]), "doc_id", "text", "$.a").collect()
    assert [(r.doc_id, r.key, r.value) for r in got] == [(0, "b", '[1,"x"]'), (0, "c", "null")]
    got = canonical.entries(texts_of(spark, ['{"a":{"b":[1,"x"]}}']), "doc_id", "text", "$.a.b").collect()
    assert [(r.pos, r.key, r.value) for r in got] == [(0, None, "1"), (1, None, '"x"')]


# ---- sinks ----


def test_bundles_depend_on_rows_alone(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("package_id"), (F.col("id") % 7).cast("string").alias("node"), F.when(F.col("id") % 2 == 0, "x").alias("maybe"))
    first = {tuple(r) for r in sinks.write_bundle(rows, f"{tmp_path}/a", 4).collect()}
    again = {tuple(r) for r in sinks.write_bundle(rows.orderBy(F.rand(1)).repartition(9), f"{tmp_path}/b", 4).collect()}
    assert first == again and len(first) == 4 and sum(r[1] for r in first) == 3000
    assert sinks.verify_bundle(spark, f"{tmp_path}/b").count() == 0
    back = sinks.read_bundle(spark, f"{tmp_path}/a", "package_id long, node string, maybe string")
    assert back.exceptAll(rows).count() == rows.exceptAll(back).count() == 0
    part = next(p for p in (tmp_path / "b/rows").rglob("part-*.txt"))
    part.write_text(part.read_text() + "{}\n")
    (part.parent / f".{part.name}.crc").unlink()  # else the file system itself finds the change
    assert [r.state for r in sinks.verify_bundle(spark, f"{tmp_path}/b").collect()] == ["changed"]


def test_files_of_bundles_lie_in_small_pieces(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("package_id"), F.lit("same").alias("node"))
    first = {tuple(r) for r in sinks.write_bundle(rows, f"{tmp_path}/a", 4, 100).collect()}
    again = {tuple(r) for r in sinks.write_bundle(rows.orderBy(F.rand(1)).repartition(9), f"{tmp_path}/b", 4, 100).collect()}
    assert first == again and len(first) == 4 and sum(r[1] for r in first) == 3000
    parts = list((tmp_path / "b/rows").rglob("part-*.txt"))
    assert len(parts) == 32 and max(len(p.read_text().splitlines()) for p in parts) < 200
    assert sum(p.stat().st_size for p in parts) == sum(r[2] for r in first) and sinks.verify_bundle(spark, f"{tmp_path}/b").count() == 0
    parts[0].unlink()
    assert [r.state for r in sinks.verify_bundle(spark, f"{tmp_path}/b").collect()] == ["changed"]


def test_compressed_bundles_say_the_same_in_fewer_bytes(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("package_id"), F.when(F.col("id") % 2 == 0, "x").alias("a"), F.when(F.col("id") % 2 == 1, "x").alias("b"))
    plain = {r.bucket: r for r in sinks.write_bundle(rows, f"{tmp_path}/p", 4, 100).collect()}
    first = {r.bucket: r for r in sinks.write_bundle(rows, f"{tmp_path}/a", 4, 100, "gzip").collect()}
    again = {r.bucket: r for r in sinks.write_bundle(rows.orderBy(F.rand(1)).repartition(9), f"{tmp_path}/b", 4, 100, "gzip").collect()}
    assert first == again and {k: r.lines for k, r in first.items()} == {k: r.lines for k, r in plain.items()} and sum(r.lines for r in first.values()) == 3000
    assert sum(r.bytes for r in first.values()) * 3 < sum(r.bytes for r in plain.values()) and sinks.verify_bundle(spark, f"{tmp_path}/b").count() == 0
    next((tmp_path / "b/rows").rglob("part-*.txt.gz")).unlink()
    assert [r.state for r in sinks.verify_bundle(spark, f"{tmp_path}/b").collect()] == ["changed"]


def test_snapshots_leave_out_what_varies(spark):
    findings = [(1, "W-B", "n", None, "/work/x/a.json"), (1, "W-A", "m", "d", "/work/x/b.json")]
    schema = "package_id long, pattern_id string, node string, description string, source string"
    make = lambda rows, t: spark.createDataFrame(rows, schema).withColumn("run", F.lit(t))
    violations = spark.createDataFrame([(2, "Violation", "hash", "u")], "package_id long, severity string, path string, focus_node string")
    take = lambda rows, t: {r.package_id: (r.snapshot, r.digest) for r in sinks.snapshot(make(rows, t), violations, volatile=("run",), root="/work/x", path_col="source").collect()}
    got = take(findings, "today")
    assert got == take(findings[::-1], "tomorrow")
    assert json.loads(got[1][0]) == {"package_id": 1, "firings": [{"pattern_id": "W-A", "node": "m", "description": "d", "source": "b.json"}, {"pattern_id": "W-B", "node": "n", "source": "a.json"}]}
    assert json.loads(got[2][0]) == {"package_id": 2, "violations": [{"severity": "Violation", "path": "hash", "focus_node": "u"}]}


# ---- ranks and resamples ----


def test_ranks_of_a_hot_group(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 8 + ["a", None]), float(rnd.randrange(50)), i) for i in range(4000)]
    got = stats.ranked(spark.createDataFrame(rows, "g string, x double, i long").repartition(5), ["g"], ["x", "i"]).collect()
    for g in {r[0] for r in rows}:
        own = sorted((x, i) for h, x, i in rows if h == g)
        assert [(r.x, r.i) for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == own and {r.size for r in got if r.g == g} == {len(own)}
    table = {r.g: r for r in stats.quantiles(spark.createDataFrame([*rows, ("a", None, 0)], "g string, x double, i long"), ["g"], "x", low=0.1, mid=0.5, high=1.0).collect()}
    for g, r in table.items():
        x = [x for h, x, _ in rows if h == g]
        assert (r.low, r.mid, r.high) == pytest.approx(tuple(np.quantile(x, [0.1, 0.5, 1.0]))) and r.n == len(x)
    assert stats.quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", mid=0.5).count() == 0


def test_resamples_are_poisson(spark):
    drawn = stats.draws(np.arange(2000), np.arange(300))
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02
    assert abs(np.corrcoef(drawn[:, 0], drawn[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(drawn[0], drawn[1])[0, 1]) < 0.2
    rnd = np.random.default_rng(1)
    rows = [(i, float(x), None if i % 3 else 0.0) for i, x in enumerate(rnd.normal(0.5, 1, 400))]
    got = {r.metric: r for r in stats.bootstrap(spark.createDataFrame(rows, "id long, a double, b double").repartition(3), "id", ["a", "b"], 1000).collect()}
    mean, error = np.mean([r[1] for r in rows]), np.std([r[1] for r in rows]) / math.sqrt(400)
    assert got["a"].point == pytest.approx(mean) and got["a"].ci_lo == pytest.approx(mean - 1.96 * error, abs=0.03) and got["a"].ci_hi == pytest.approx(mean + 1.96 * error, abs=0.03) and got["a"].robust
    assert (got["b"].n, got["b"].point, got["b"].ci_lo, got["b"].robust) == (134, 0.0, 0.0, False)


# ---- learned scores ----


def test_learned_scores_hold_out(spark):
    rnd = random.Random(4)
    good, bad = ["measured", "against", "reference", "within", "error"], ["click", "buy", "cheap", "now", "free"]
    text = lambda words: ". ".join(" ".join(rnd.choices(words + ["the", "of", "and"], k=8)).capitalize() for _ in range(4)) + "."
    rows = [(i, text(good if i % 4 else bad), int(i % 4 > 0)) for i in range(240)]
    model = learning.fit(spark.createDataFrame(rows[:160], "doc_id long, text string, label int"), "text", "label", features=1 << 12)
    held = learning.scored(model, spark.createDataFrame(rows[160:] + [(900, None, None), (901, "", None)], "doc_id long, text string, label int"), "text").collect()
    known = [r for r in held if r.label is not None]
    assert sum((r.score > 0.5) == (r.label == 1) for r in known) >= 0.95 * len(known) and all(0 <= r.score <= 1 for r in held)
    mixed = "Click now cheap free buy. Measured against reference within error.\nBuy cheap now free click."
    top = learning.top_sentences(model, spark.createDataFrame([(1, mixed), (2, "")], "doc_id long, text string"), "doc_id", "text", 1).collect()
    assert [(r.doc_id, r.place) for r in top if r.doc_id == 1] == [(1, 1)]


def test_features_are_counted_once_and_whole(spark):
    own = ["The cat  sat", "ab", "", None, "x" * 300_000, "𝄞𝄞𝄞𝄞 é", "the CAT sat"]
    rows = {r.id: r.counts for r in learning.counted(spark.createDataFrame(list(enumerate(own)), "id int, text string"), "text", 1 << 12).collect()}
    for i, t in enumerate(own):
        squashed = " ".join((t or "").lower().split())
        words, runs = squashed.split(), sum(max(len(squashed) - n + 1, 0) for n in (3, 4, 5))
        at, n = rows[i].indices, rows[i].values
        assert rows[i].size == 3 << 12 and (np.diff(at) > 0).all()
        assert [n[at >> 12 == k].sum() for k in range(3)] == [len(words), max(len(words) - 1, 0), runs]
    assert rows[0] == rows[6] and len(rows[4].indices) == 4


def test_findings_are_gone_through_once_and_shuffled_as_rows(spark):
    from veritrail.plans import catalog

    plan = catalog.QUERIES["check"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("l_orderkey#") and sum("FileScan" in x and "lineitem" in x for x in plan.splitlines()) == 3
    assert sum("Exchange" in x and "pattern_id" in x for x in plan.splitlines()) == 0


def test_roll_ups_of_compounds_count_every_package_row(spark):
    from veritrail.operators import rules

    found = spark.createDataFrame([(1, "W-A", "Critical", "x"), (1, "W-B", "Critical", "x"), (1, "W-C", "High", "y"), (1, "W-C", "High", "x"), (2, "W-C", "High", "y"), (3, "W-A", "Critical", "z")], "package_id long, pattern_id string, severity string, node string")
    packages = spark.createDataFrame([(1, "High"), (1, "Medium"), (1, "Low"), (2, "High"), (3, "Low")], "package_id long, assurance_level string")
    key = lambda rows: sorted(map(tuple, rows.select("package_id", "pattern_id", "severity", "hits", "nodes", "first_node", "rank").collect()))
    got = key(rules.compounded(rules.rollup(found), packages))
    assert got == key(rules.rollup(found.unionByName(rules.compound(found, packages))))
    assert (1, "COMPOUND-01", "Critical", 2, 2, "W-A+W-C", 0) in got and (1, "COMPOUND-03", "High", 2, 1, "1", 1) in got and len(got) == 7


def test_snapshots_and_shape_runs_shuffle_rows_not_what_is_made_of_them(spark):
    from veritrail.operators import shapes
    from veritrail.plans import extraction

    plan = extraction.snk_2(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not any(word in x for x in dealt for word in ("pattern_id", "focus_node", "facts", " s#"))
    nodes = spark.createDataFrame([(1, "u", [("type", "UnitOfAssurance", "iri", None), ("conformsToProfile", "ProfileMinimal", "iri", None)])], "package_id long, focus_node string, facts array<struct<p: string, o: string, o_kind: string, o_datatype: string>>")
    every, paths = shapes.violations_of(nodes), shapes.violations_of(nodes, fields=("path",))
    assert sorted(r.path for r in every.collect()) == sorted(r.path for r in paths.collect()) and paths.columns == ["package_id", "focus_node", "path"]


def test_goals_shuffle_rows_not_triples(spark):
    from veritrail.plans import goals

    spark.sparkContext.setCheckpointDir("/tmp/veritrail-tests")
    triples = goals.goal_triples(spark, "/root/testdata/sf0.001")
    plan = triples.groupBy("package_id", "s").count()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
