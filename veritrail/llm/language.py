"""Language identification: words first, then ever shorter character n-grams.

A known word adds its log relative frequency in each language. An unseen word is cut into the longest character n-grams
that are known (4, then 3, 2, 1 characters, the word's ends marked), whose mean log frequency stands in for it.

Words are runs of letters (Unicode category L), lower-cased. The classifier is fitted on a bounded sample of labelled
rows: about ``fit_rows`` of each language, chosen by a hash of the text; a language with fewer gives all. Every word and
n-gram of the sample is in the tables; nothing is cut off. So what the tasks hold has a bound that doesn't grow with
the corpus, and no label, text or word is treated otherwise in a larger one.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; without training rows every text is
``und``; training rows with a null text or language teach nothing; ties go to the language first in order; repeated
rows give equal results (and are all in the sample or all not); a text of any length is read whole, in pieces; an empty
table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

#: Numbers that count as letters for \w, but aren't: halves, superscripts, Roman numerals and the like.
NUMERALS = {c: " " for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl")}
#: Runs of letters in a text without such numbers, and what is none.
LETTERS, OTHER = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")
LONGEST = 4
UNKNOWN = "und"
#: Characters of a text that are cut into words at once.
PIECE = 1 << 20


def pieces(text: str | None) -> Iterator[str]:
    """Parts of a text, cut between words."""
    start, text = 0, text or ""
    while len(text) - start > PIECE and (cut := OTHER.search(text, start + PIECE)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    if not text.isascii() and not NUMERALS.keys().isdisjoint(set(text)):
        text = text.translate(str.maketrans(NUMERALS))
    return LETTERS.findall(text)


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def sampled(docs: DataFrame, fit_rows: int, text_col: str, lang_col: str) -> DataFrame:
    """(text, lang): about ``fit_rows`` labelled rows of each language, by a hash of the text."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["size"] for r in rows.groupBy("lang").agg(F.count("*").alias("size")).collect()}  # a row for each language
    if not sizes:
        return rows
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, fit_rows / n))]), F.col("lang"))
    return rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of (text, lang) rows, counted within each batch before the shuffle."""

    def make():
        def step(rows):
            counts: dict[str, Counter] = {}
            for lang, text in zip(rows["lang"], rows["text"], strict=True):
                for piece in pieces(text):
                    counts.setdefault(lang, Counter()).update(words_of(piece))
            flat = [(lang, w, n) for lang, own in counts.items() for w, n in own.items()]
            return {"lang": [x[0] for x in flat], "word": [x[1] for x in flat], "n": [x[2] for x in flat]}

        return step

    return arrow_map(rows, make, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, n) from word counts."""

    def make():
        def step(rows):
            counts: Counter = Counter()
            for lang, word, n in zip(rows["lang"], rows["word"], rows["n"], strict=True):
                for size in range(1, LONGEST + 1):
                    for g in grams_of(word, size):
                        counts[lang, g] += n
            return {"lang": [k[0] for k in counts], "gram": [k[1] for k in counts], "n": list(counts.values())}

        return step

    return arrow_map(words.select("lang", "word", "n"), make, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Logs:
    """Names and, for each, its log frequencies by language."""

    def __init__(self, names: list[str], rows: np.ndarray):
        self.names, self.rows = names, rows


class Backoff:
    """Log frequencies by language, for words and n-grams."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray] | Logs, grams: dict[str, np.ndarray] | Logs):
        self.langs = langs
        self.words, self.grams = (x if isinstance(x, Logs) else Logs(list(x), np.array(list(x.values()), np.float32).reshape(len(x), len(langs))) for x in (words, grams))
        self._grams: dict[str, int] | None = None

    def __getstate__(self):
        return {"langs": self.langs, "words": self.words, "grams": self.grams, "_grams": None}

    def unseen(self, word: str) -> np.ndarray:
        """The mean over the longest n-grams known, left to right; single letters that are unknown say nothing."""
        if self._grams is None:
            self._grams = {g: i for i, g in enumerate(self.grams.names)}
        found: list[int] = []
        marked, at = f"<{word}>", 0
        while at < len(marked):
            for n in range(min(LONGEST, len(marked) - at), 0, -1):
                if (row := self._grams.get(marked[at : at + n])) is not None:
                    found.append(row)
                    at += n
                    break
            else:
                at += 1
        return np.add.reduce(self.grams.rows[found]) / len(found) if found else np.zeros(len(self.langs), np.float32)

    def predictor(self, room: int = 200_000):
        """A function from texts to (language, score, share of known words, number of words) of each. About ``room`` unseen words are kept."""
        known, model = len(self.words.names), self
        fresh = np.zeros((1024, len(self.langs)), np.float32)
        used = 0

        class Index(dict):
            def __missing__(self, word):
                nonlocal fresh, used
                if used == len(fresh):
                    fresh = np.concatenate([fresh, np.zeros_like(fresh)])
                fresh[used] = model.unseen(word)
                used += 1
                at = self[word] = known + used - 1
                return at

        index = Index({w: i for i, w in enumerate(self.words.names)})

        def predict(texts: list[str | None]) -> list[tuple[str, float, float, int]]:
            nonlocal used
            if used > room:
                for _ in range(used):  # they came in last
                    index.popitem()
                used = 0
            total, n, seen = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            held, owners, size = [], [], 0

            def add():
                nonlocal held, owners, size
                if size:
                    at = np.fromiter(map(index.__getitem__, chain.from_iterable(held)), np.int64, size)
                    starts = np.concatenate([[0], np.cumsum([len(w) for w in held])[:-1]])
                    old = at < known
                    values = np.zeros((size, len(self.langs)), np.float32)
                    values[old] = self.words.rows[at[old]]
                    if not old.all():
                        values[~old] = fresh[at[~old] - known]
                    np.add.at(total, owners, np.add.reduceat(values, starts, dtype=np.float64))
                    np.add.at(seen, owners, np.add.reduceat(old, starts, dtype=np.int64))
                held, owners, size = [], [], 0

            for k, text in enumerate(texts):
                for piece in pieces(text):
                    if words := words_of(piece):
                        n[k] += len(words)
                        held.append(words)
                        owners.append(k)
                        size += len(words)
                if size > 200_000:
                    add()
            add()
            if not self.langs:
                return [(UNKNOWN, 0.0, 0.0, m) for m in n.tolist()]
            # as if the text had sixteen words at most, so that long texts don't all score 1
            total *= np.minimum(1.0, 16 / np.maximum(n, 1))[:, None]
            best = total.argmax(1)
            score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            return [(self.langs[b], x, k / m, m) if m else (UNKNOWN, 0.0, 0.0, 0) for b, x, k, m in zip(best.tolist(), score.tolist(), seen.tolist(), n.tolist(), strict=True)]

        return predict


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = 4000) -> Backoff:
    """Count the words of a sample of labelled rows, ``fit_rows`` of each language."""
    counted = written(word_counts(sampled(docs, fit_rows, text_col, lang_col)), "language-words")
    words, grams = counted.toArrow(), gram_counts(counted).toArrow()  # of the sample
    langs = sorted(set(words["lang"].to_pylist()))
    of = {x: i for i, x in enumerate(langs)}
    totals = np.zeros(len(langs))
    np.add.at(totals, [of[x] for x in words["lang"].to_pylist()], words["n"].to_numpy())

    def logs(table, key: str) -> Logs:
        names = table[key].combine_chunks().dictionary_encode()
        rows = np.tile(np.log(0.5 / totals), (len(names.dictionary), 1)).astype(np.float32)
        lang = np.array([of[x] for x in table["lang"].to_pylist()], np.int64)
        rows[names.indices.to_numpy(), lang] = np.log(table["n"].to_numpy() / totals[lang])
        return Logs(names.dictionary.to_pylist(), rows)

    return Backoff(langs, logs(words, "word"), logs(grams, "gram")) if langs else Backoff([], {}, {})


def identify(docs: DataFrame, model: Backoff, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, known) for each row; known is the share of words that were in the sample."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the sample

    def make():
        predict = shared.value.predictor()

        def step(rows):
            found = predict(rows["text"])
            return {"id": rows["id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "known": [x[2] for x in found]}

        return step

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, lang_pred string, score double, known double").withColumnRenamed("id", id_col)


def text_language(model: Backoff, spark):
    """A column function from texts to (lang_pred, score, known, words), for filters."""
    shared = spark.sparkContext.broadcast(model)  # of the sample
    held: list = []

    @F.pandas_udf("lang_pred string, score double, known double, words long")
    def predicted(texts):
        import pandas as pd

        if not held:
            held.append(shared.value.predictor())
        given = [t if isinstance(t, str) else None for t in texts]
        return pd.DataFrame(held[0](given), columns=["lang_pred", "score", "known", "words"])

    return predicted
