"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scope(text: Column) -> Column:
    """Lower-cased, with only letters a-z and digits left."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def squash(text: Column) -> Column:
    """Lower-cased, with runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n\f]+", " "))


def local_name(iri: Column) -> Column:
    """What follows the last # or /."""
    return F.regexp_extract(iri, "([^#/]*)$", 1)


def words(text: Column) -> Column:
    return F.filter(F.split(squash(text), " "), lambda w: w != "")


def furniture(line: Column) -> Column:
    """Why a line is not prose: empty, heading, fragment, table row, reference; null for prose."""
    letters = F.length(F.regexp_replace(line, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(line, "[^A-Z]", ""))
    return (
        F.when(F.trim(line) == "", "empty")
        .when((letters > 0) & (capitals > 0.7 * letters), "heading")
        .when(F.contains(line, F.lit(" | ")), "table-row")
        .when(F.size(words(line)) < 6, "fragment")
        .when(line.rlike(r"^\[[0-9]+\]"), "reference")
    )


def sentences(text: Column) -> Column:
    """Sentences of a text: lines, cut after . ! or ? before white space and a capital; table and list lines stay whole."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    cut = F.transform(lines, lambda x: F.when(F.trim(x).rlike(r"^[|*#-]"), F.array(F.trim(x))).otherwise(F.split(F.trim(x), r"(?<=[.!?]) +(?=[A-Z])")))
    return F.flatten(cut)


def trimmed(text: Column) -> Column:
    """Without the spaces of any script (Unicode's Zs) at both ends; tabs and line ends stay."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+$", "")


def chunks(text: Column, least: int = 40, most: int = 300) -> Column:
    """Paragraphs of at least ``least`` characters, cut every ``most``."""
    pieces = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda p: F.length(p) >= least)
    return F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))))
