"""Redaction of texts as column expressions: one dictionary a document, tokens numbered by first appearance.

Links are set aside. Accounts (user@host: and users in paths), mail and network addresses, long numbers and secrets are
learned from the rest of a document; each distinct value gets one numbered token, wherever it stands. Paths keep their
last part. At last, names of users and hosts are replaced wherever else they stand, the longest first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind

#: What is looked for.
URL = r"(?i)\b[a-z][a-z0-9+.\-]*://[^\s\"'<>]+"
ACCOUNT = r"\b([A-Za-z][\w.\-]{0,63})@([A-Za-z][\w.\-]{0,63})(?=:)"
USER_IN_PATH = r"(?i)[\\/](?:Users|home)[\\/]([^\\/\s\"'<>|]{2,64})"
WINDOWS_PATH = r"[A-Za-z]:\\(?:[^\\\s\"'<>|*?]+\\)*[^\\\s\"'<>|*?]*"
POSIX_PATH = r"/(?:home|Users|root|tmp|var/folders)/[^\s\"'<>|]*"
#: Kinds replaced by their own pattern, in this order.
PLAIN = {"mail": r"[A-Za-z0-9][\w.+\-]*@[A-Za-z0-9][\w\-]*(?:\.[\w\-]+)+", "address": r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "secret": r"\b[0-9A-Fa-f]{32,64}\b", "number": r"\b\d{13,19}\b"}
#: All kinds of values.
KINDS = ["user", "host", "path", *PLAIN]
#: Names shorter than this stay where they stand by themselves: they could be part of any word.
LEAST = 4
TOKEN = "<redacted-[a-z]+-[0-9]+>"
#: What each match of a pattern holds: texts without it aren't searched by the pattern, which would take far longer.
NEEDED = {URL: "://", ACCOUNT: "@", WINDOWS_PATH: ":\\", POSIX_PATH: "/", PLAIN["mail"]: "@", PLAIN["address"]: "."}


def may_hold(text: Column, pattern: str) -> Column:
    return F.contains(text, F.lit(NEEDED[pattern])) if pattern in NEEDED else F.lit(True)


def pieces(text: Column, pattern: Column | str, replace: Callable[[Column], Column]) -> Column:
    """The text with each match replaced by what ``replace`` makes of it."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def joined(between: Column, found: Column) -> Column:
        return F.concat(F.array_join(F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, m: F.concat(a, replace(m))), ""), F.element_at(between, -1))

    return bind(text, lambda t: bind(F.split(t, pattern, -1), lambda between: bind(F.regexp_extract_all(t, pattern, F.lit(0)), lambda found: joined(between, found))))


def outside(text: Column) -> Column:
    """The parts of a text between its links."""
    return F.when(~may_hold(text, URL), F.array(text)).otherwise(F.split(text, F.lit(URL), -1))


def values(parts: Column, pattern: str, group: int = 0) -> Column:
    return F.flatten(F.transform(F.filter(parts, lambda t: may_hold(t, pattern)), lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(group))))


def lowered(found: Column) -> Column:
    return F.transform(found, F.lower)


def head(path: Column) -> Column:
    """All of a path but its last part; a path that ends with a separator is all head."""
    return F.regexp_replace(F.regexp_replace(path, r"[^\\/]*$", ""), r"[\\/]$", "")


def learned(text: Column) -> dict[str, Column]:
    """For each kind the distinct values of a document, in order of appearance."""
    return of_parts(outside(text))


def dictionary(text: Column) -> Column:
    """What ``learned`` gives, as one struct: the text is cut at its links once."""
    return bind(outside(text), lambda parts: F.struct(*[v.alias(kind) for kind, v in of_parts(parts).items()]))


def of_parts(parts: Column) -> dict[str, Column]:
    users = F.concat(lowered(values(parts, ACCOUNT, 1)), lowered(values(parts, USER_IN_PATH, 1)))
    own = {"user": users, "host": lowered(values(parts, ACCOUNT, 2)), "path": F.transform(F.concat(values(parts, WINDOWS_PATH), values(parts, POSIX_PATH)), head)}
    own |= {kind: values(parts, pattern) for kind, pattern in PLAIN.items()}
    return {kind: F.array_distinct(v) for kind, v in own.items()}


def token(kind: str, place: Column) -> Column:
    return F.concat(F.lit(f"<redacted-{kind}-"), place.cast("string"), F.lit(">"))


def redacted(text: Column, dictionary: dict[str, Column]) -> Column:
    """The text by the dictionary that ``learned`` gave for it (or for a longer text that it is part of)."""
    seen = lambda kind, v: F.array_position(dictionary[kind], v)
    named = lambda kind, v: F.when(seen(kind, v) > 0, token(kind, seen(kind, v))).otherwise(v)

    def account(m: Column) -> Column:
        return F.concat(named("user", F.lower(F.regexp_extract(m, "^([^@]*)@", 1))), F.lit("@"), named("host", F.lower(F.regexp_extract(m, "@(.*)$", 1))))

    def path(m: Column) -> Column:
        return F.concat(named("path", head(m)), F.substring(m, F.length(head(m)) + 1, F.length(m)))

    names = F.transform(F.concat(dictionary["user"], dictionary["host"]), lambda v: F.struct(-F.length(v), v.alias("v")))
    known = F.filter(F.array_sort(names), lambda x: F.length(x["v"]) >= LEAST)
    either = F.concat(F.lit(f"(?i){TOKEN}"), F.array_join(F.transform(known, lambda x: F.concat(F.lit("|\\Q"), x["v"], F.lit("\\E"))), ""))
    name = lambda m: F.when(m.rlike(f"^{TOKEN}$"), m).when(seen("user", F.lower(m)) > 0, token("user", seen("user", F.lower(m)))).otherwise(named("host", F.lower(m)))

    # a step that can't change the text is left out: one whose pattern needs what isn't there, or whose kind has no values
    step = lambda t, needed, pattern, replace: bind(t, lambda t: F.when(needed(t), pieces(t, pattern, replace)).otherwise(t))
    some = lambda kind: F.size(dictionary[kind]) > 0

    def part(t: Column, pattern: Column) -> Column:
        out = step(t, lambda t: may_hold(t, ACCOUNT), ACCOUNT, account)
        for own in (WINDOWS_PATH, POSIX_PATH):
            out = step(out, lambda t, own=own: some("path") & may_hold(t, own), own, path)
        for kind, own in PLAIN.items():
            out = step(out, lambda _, kind=kind: some(kind), own, lambda m, kind=kind: named(kind, m))
        return step(out, lambda t: (F.size(known) > 0) | F.contains(F.lower(t), F.lit("<redacted-")), pattern, name)

    def whole(parts: Column, links: Column) -> Column:
        return F.concat(F.array_join(F.zip_with(F.slice(parts, F.lit(1), F.size(links)), links, lambda a, b: F.concat(a, b)), ""), F.element_at(parts, -1))

    parts = bind(either, lambda pattern: F.transform(outside(text), lambda t: part(t, pattern)))
    links = F.when(~may_hold(text, URL), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(URL), F.lit(0)))
    return bind(parts, lambda p: bind(links, lambda found: whole(p, found)))


def leaks(text: Column) -> Column:
    """Whether anything of the kind still stands outside links."""
    rest = F.array_join(outside(text), " ")
    found = [may_hold(rest, p) & rest.rlike(p) for p in (WINDOWS_PATH, POSIX_PATH, ACCOUNT, USER_IN_PATH, *PLAIN.values())]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return F.coalesce(out, F.lit(False))
