"""URL filter: host and path rules, then a character language-model ratio for what no rule decides.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, give each character a log
probability from the longest context (two characters, one, none) that was seen often enough. A URL's score is the mean
difference of the two; the threshold is the one that best separates training URLs that the models it is sought with
haven't seen.

Everything is DataFrame functions. Characters are folded to 36 symbols, so a model has 36^3 entries whatever the
corpus: it is counted with partial sums, and its one row is the only thing that goes through the driver.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; a null or empty URL
scores 0; without training URLs of both kinds every score is 0 and the threshold is 0 (allow); a score equal to the
threshold is allowed; of thresholds that separate equally well, the one next to 0 is taken; a URL of any length is read
whole, in time in proportion to it; repeated rows count as often as they occur; an empty table gives an empty result;
other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols 1 to 35 of the folded alphabet (digits are one symbol); 0 is anything else, and what stands before the first.
ALPHABET = LOWER + "0" + "/.-_?=&#"
SIZE = len(ALPHABET) + 1


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null where none fits). A rule is host/path, such as ``net/``."""
    rule = verdict = None
    for name, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, start = name.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def grams(url: Column) -> Column:
    """The codes of a URL's characters with the two before each: the codes beside themselves, shifted by one and two."""
    folded = F.translate(F.coalesce(url, F.lit("")), UPPER + "123456789", LOWER + "0" * 9)
    codes = F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    none = F.array(F.lit(0))

    def shifted(own: Column) -> Column:
        n = F.size(own)
        one, two = F.slice(F.concat(none, own), F.lit(1), n), F.slice(F.concat(none, none, own), F.lit(1), n)
        return F.zip_with(F.zip_with(two, one, lambda a, b: (a * SIZE + b) * SIZE), own, lambda ab, c: ab + c)

    return F.transform(F.array(codes), shifted)[0]  # so the codes are made once


@dataclass
class Ratio:
    """Log ratio of accepted to rejected for each code, and the calibrated threshold."""

    ratios: list[float]
    threshold: float = 0.0

    def score(self, url: Column) -> Column:
        """Mean log ratio per character; 0 for an empty URL."""
        if not any(self.ratios):
            return F.lit(0.0)
        table = F.from_json(F.lit(json.dumps(self.ratios)), "array<double>")  # 36^3 entries, whatever the corpus
        total = F.aggregate(grams(url), F.lit(0.0), lambda s, g: s + F.element_at(table, g + 1))
        return F.coalesce(F.try_divide(total, F.length(url)), F.lit(0.0))


def ratios(rows: DataFrame, least: int) -> list[float]:
    """The table of both models, from (k, url) rows; zeros unless both kinds are there."""
    spark = rows.sparkSession
    three = rows.select("k", F.explode(grams(F.col("url"))).alias("g")).groupBy("k", "g").agg(F.count("*").alias("n3")).persist()
    try:
        if three.select("k").distinct().count() < 2:
            return [0.0] * SIZE**3
        two = three.groupBy("k", F.expr(f"g % {SIZE**2}").alias("g2")).agg(F.sum("n3").alias("n2"))
        one = two.groupBy("k", F.expr(f"g2 % {SIZE}").alias("g1")).agg(F.sum("n2").alias("n1"))
        none = one.groupBy("k").agg(F.sum("n1").alias("n0"))
        after2 = three.groupBy("k", F.expr(f"g div {SIZE}").alias("c2")).agg(F.sum("n3").alias("s2"), F.count("*").alias("d2"))
        after1 = two.groupBy("k", F.expr(f"g2 div {SIZE}").alias("c1")).agg(F.sum("n2").alias("s1"), F.count("*").alias("d1"))
        grid = spark.range(SIZE**3).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), F.col("id").alias("g"), F.expr(f"id % {SIZE**2}").alias("g2"), F.expr(f"id % {SIZE}").alias("g1"), F.expr(f"id div {SIZE}").alias("c2"), F.expr(f"id div {SIZE} % {SIZE}").alias("c1"))
        for other, key in ((three, "g"), (two, "g2"), (one, "g1"), (after2, "c2"), (after1, "c1")):
            grid = grid.join(F.broadcast(other), ["k", key], "left")  # at most 2 * 36^3 rows
        grid = grid.join(F.broadcast(none), "k").na.fill(0)
        p0 = (F.col("n1") + 0.5) / (F.col("n0") + 0.5 * SIZE)
        p1 = F.when(F.col("s1") < least, p0).otherwise(F.try_divide(F.col("n2") + F.col("d1") * p0, F.col("s1") + F.col("d1")))
        p2 = F.when(F.col("s2") < least, p1).otherwise(F.try_divide(F.col("n3") + F.col("d2") * p1, F.col("s2") + F.col("d2")))
        ratio = grid.select("g", F.when(F.col("k") == 1, F.log(p2)).otherwise(-F.log(p2)).alias("v")).groupBy("g").agg(F.round(F.sum("v"), 4).alias("v"))
        return ratio.agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "v"))), lambda x: x["v"]).alias("t")).first()["t"]
    finally:
        three.unpersist()


def threshold(rows: DataFrame, model: Ratio) -> float | None:
    """The score that separates both kinds of (k, url) rows best, in steps of a hundredth; None unless both are there."""
    bins = rows.select("k", F.floor(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), model.score(F.col("url")))) * 100).alias("b")).groupBy("b").agg(F.sum("k").alias("good"), F.sum(1 - F.col("k")).alias("bad"))
    up, every = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))  # of at most 1001 bins
    right = F.try_divide(F.coalesce(F.sum("bad").over(up), F.lit(0)), F.sum("bad").over(every)) - F.try_divide(F.coalesce(F.sum("good").over(up), F.lit(0)), F.sum("good").over(every))
    best = bins.select("b", right.alias("right")).orderBy(F.desc("right"), F.abs("b"), "b").first()
    return None if best is None or best["right"] is None else best["b"] / 100


def fit(train: DataFrame, url_col: str = "url", accepted_col: str = "accepted", least: int = 20, folds: int = 5) -> Ratio:
    """Both models from (url, accepted 0 or 1) rows. Contexts seen fewer than ``least`` times give way to shorter ones.

    The threshold is calibrated on a part of the URLs (by a hash, one in ``folds``) with models of the others; where such
    a part hasn't both kinds, on all rows.
    """
    rows = train.where(F.col(accepted_col).isNotNull() & F.col(url_col).isNotNull()).select(F.col(accepted_col).cast("int").alias("k"), F.col(url_col).alias("url"))
    model = Ratio(ratios(rows, least))
    if any(model.ratios):
        aside = F.pmod(F.xxhash64("url"), F.lit(folds)) == 0
        part = Ratio(ratios(rows.where(~aside), least))
        found = threshold(rows.where(aside), part) if any(part.ratios) else None
        model.threshold = threshold(rows, model) if found is None else found
    return model


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", seeds: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, score) for each row.

    The models learn from ``seeds``, rows of (url, accepted), or else from the URLs that the rules decide.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": says})
    model = fit(rows.select("url", F.when(F.col("says") == "allow", 1).when(F.col("says") == "block", 0).alias("accepted")) if seeds is None else seeds)
    rows = rows.withColumn("score", model.score(F.col("url")))
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("says", F.when(F.col("score") >= model.threshold, "allow").otherwise("block")).alias("verdict"), "score")
