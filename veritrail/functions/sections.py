"""Headings and sections of texts as column expressions over their lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind

HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"


def from_html(html: Column) -> Column:
    """A page as lines of text: headings get a # for each level, table rows become | rows |, other tags end a line or go."""
    out = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", "")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</t[dh]>\s*<t[dh]\b[^>]*>", " | "), r"(?i)<tr\b[^>]*>\s*<t[dh]\b[^>]*>", "\n| ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</t[dh]>\s*</tr>", " |\n"), r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|article|nav|section|table|title|header|footer|tr)\b[^>]*>", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", ""), r"[ \t]*\n\s*", "\n")


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def headings(text: Column) -> Column:
    """(line, level, title) of each heading, lines from 0."""
    numbered = F.transform(lines(text), lambda x, i: F.struct(i.alias("line"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), F.regexp_extract(x, HEADING, 2).alias("title")))
    return F.filter(numbered, lambda h: h["level"] > 0)


def named(title: Column, phrases: list[str]) -> Column:
    """Whether a heading is one of the phrases, or ends with one as whole words; a phrase at its start isn't enough."""
    own = normal(title)
    out = F.lit(False)
    for p in phrases:
        out = out | (own == p) | F.endswith(own, F.lit(" " + p))
    return out


def sections(text: Column, phrases: list[str]) -> Column:
    """(title, level, first, stop, text) of the sections under such headings: each runs to the next heading of its level or above.

    Sections inside an earlier one are left out. The stack is walked from the end, so that a heading's stop is the
    nearest later line at which its level ends; one number a level is carried along.
    """
    total = F.size(lines(text))
    ends = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda _: total)
    start = F.struct(ends.alias("ends"), F.array().cast("array<struct<title: string, level: int, first: int, stop: int>>").alias("out"))

    def back(acc: Column, h: Column) -> Column:
        own = F.struct(h["title"].alias("title"), h["level"].alias("level"), h["line"].alias("first"), F.element_at(acc["ends"], h["level"]).alias("stop"))
        wanted = F.when(named(h["title"], phrases), F.array_append(acc["out"], own)).otherwise(acc["out"])
        return F.struct(F.transform(acc["ends"], lambda e, i: F.when(i + 1 >= h["level"], h["line"]).otherwise(e)).alias("ends"), wanted.alias("out"))

    found = F.reverse(F.aggregate(F.reverse(headings(text)), start, back)["out"])
    empty = F.struct(F.lit(0).alias("until"), F.array().cast("array<struct<title: string, level: int, first: int, stop: int>>").alias("out"))
    outer = F.aggregate(found, empty, lambda acc, s: F.when(s["first"] >= acc["until"], F.struct(s["stop"].alias("until"), F.array_append(acc["out"], s).alias("out"))).otherwise(acc))["out"]
    body = lambda all_, s: F.rtrim(F.array_join(F.slice(all_, s["first"] + 1, s["stop"] - s["first"]), "\n"))
    return bind(lines(text), lambda all_: F.transform(outer, lambda s: F.struct(s["title"].alias("title"), s["level"].alias("level"), s["first"].alias("first"), s["stop"].alias("stop"), body(all_, s).alias("text"))))


def presence(text: Column, phrases: list[str], names: list[str]) -> Column:
    """(section, table, named): whether there is such a section, a table of rows, and which names stand as whole words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    table = F.coalesce(text, F.lit("")).rlike(r"(?m)^\|.*\|\s*$")
    there = [F.when(low.rlike(rf"(?<![a-z0-9])\Q{n}\E(?![a-z0-9])"), F.lit(n)) for n in sorted(names)]
    return F.struct(F.exists(headings(text), lambda h: named(h["title"], phrases)).alias("section"), table.alias("table"), F.array_compact(F.array(*there)).alias("named"))


def mentions(text: Column, phrases: list[str], names: list[str]) -> Column:
    """(line, name, title, scoped) of each line's names: ``title`` is the last heading at or above the line, ``scoped`` whether it is one of the phrases.

    A heading's line is its own last heading. Headings are few; each line's is found by its place among them.
    """

    def own(heads: Column, x: Column, i: Column) -> Column:
        low, ruled = F.lower(x), F.try_element_at(F.filter(heads, lambda h: h["line"] <= i), F.lit(-1))
        hits = F.array_compact(F.array(*[F.when(low.rlike(rf"(?<![a-z0-9])\Q{n}\E(?![a-z0-9])"), F.lit(n)) for n in sorted(names)]))
        return F.transform(hits, lambda n: bind(ruled, lambda h: F.struct(i.alias("line"), n.alias("name"), h["title"].alias("title"), F.coalesce(named(h["title"], phrases), F.lit(False)).alias("scoped"))))

    return bind(headings(text), lambda heads: F.flatten(F.transform(lines(text), lambda x, i: own(heads, x, i))))


def unwrapped(text: Column) -> Column:
    """Lines that a typesetter broke are joined, and words split by a hyphen are put together again.

    A split word is written without its hyphen where the text has that word elsewhere, else with it; what follows the
    second half up to the next space goes, if it is . , ; : or ). A line goes on in the next one unless it ends a
    sentence, and the next begins with a lower-case letter or a digit. Blank lines stay.
    """
    raw = F.transform(lines(text), lambda x: F.regexp_replace(x, r"\s+$", ""))
    vocabulary = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z][A-Za-z-]{2,}"), F.lit(0)), F.lower)
    stem = lambda x: F.regexp_extract(x, "([A-Za-z]{2,})-$", 1)
    first = lambda x: F.regexp_replace(F.regexp_extract(F.ltrim(x), "^([^ ]*)", 1), r"^[.,;:)]+|[.,;:)]+$", "")
    rest = lambda x: F.regexp_extract(F.ltrim(x), "^[^ ]*( .*)?$", 1)
    split = lambda a, b: F.endswith(a, F.lit("-")) & (stem(a) != "") & first(b).rlike("^[a-z]")
    goes_on = lambda a, b: (a != "") & ~a.rlike(r"[.!?:;•-]$") & F.ltrim(b).rlike(r"^(\p{Ll}|\p{Nd})")
    # a one-word line that was joined by its hyphen ends without its punctuation
    seen = lambda b, a: F.when(split(b, a) & (rest(a) == ""), first(a)).otherwise(a)
    both = lambda r: F.lower(F.concat(stem(r["a"]), first(r["x"])))

    def pairs(lines_: Column) -> Column:
        before = lambda i, n: F.when(i >= n, F.get(lines_, i - n)).otherwise("")
        return F.transform(lines_, lambda x, i: F.struct(x.alias("x"), seen(before(i, 2), before(i, 1)).alias("a")))

    def written(r: Column, i: Column, all_: Column, known: Column) -> Column:
        word = lambda: F.concat(stem(r["a"]), F.when(F.array_contains(known, both(r)), "").otherwise("-"), first(r["x"]))
        content = F.when(r["hyphen"], F.concat(word(), rest(r["x"]))).when(goes_on(r["a"], r["x"]), F.concat(F.lit(" "), F.ltrim(r["x"]))).when(i == 0, r["x"]).otherwise(F.concat(F.lit("\n"), r["x"]))
        # the first half of a word goes with the second
        return F.when(F.coalesce(F.get(all_, i + 1)["hyphen"], F.lit(False)), F.regexp_replace(content, "[A-Za-z]{2,}-$", "")).otherwise(content)

    def whole(all_: Column, known: Column) -> Column:
        return F.array_join(F.transform(all_, lambda r, i: written(r, i, all_, known)), "")

    marked = bind(raw, lambda lines_: F.transform(pairs(lines_), lambda r: F.struct(r["x"].alias("x"), r["a"].alias("a"), split(r["a"], r["x"]).alias("hyphen"))))
    # only words that might be put together are looked for among the document's
    known = lambda all_: F.array_intersect(F.transform(F.filter(all_, lambda r: r["hyphen"]), both), vocabulary)
    return bind(marked, lambda all_: bind(known(all_), lambda k: whole(all_, k)))
