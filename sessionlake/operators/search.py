"""Full-text search over contents: terms joined by AND, "phrases", prefix*, OR and NOT, as column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from sessionlake.operators.textindex import TextIndex

SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")


def padded(text: Column) -> Column:
    """Lower-cased tokens between single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), SPLIT, " ")), F.lit(" "))


def matches(text: Column, phrase: Column) -> Column:
    """Whether the phrase's tokens stand next to each other in the text."""
    return F.contains(padded(text), padded(phrase))


@dataclass(frozen=True)
class Item:
    """Terms that stand next to each other; the last may go on where `prefix` is set."""

    terms: tuple[str, ...]
    prefix: bool = False

    def slots(self) -> list[tuple[str, bool]]:
        """Each term, and whether it may go on."""
        return [(t, self.prefix and k == len(self.terms) - 1) for k, t in enumerate(self.terms)]

    def text(self) -> str:
        return " ".join(self.terms) + "*" if self.prefix and len(self.terms) == 1 else "-".join(self.terms) + "*" * self.prefix


def parsed(query: str) -> list[list[tuple[bool, Item]]]:
    """The alternatives of a query, each a list of (negated, item) that all must hold. Items are ANDed; OR binds looser than AND; NOT negates the next item."""
    out = []
    for part in re.split(r"\s+OR\s+", query.strip()):
        items, negate = [], False
        for word in re.findall(r'"[^"]*"|\S+', part):
            if word in ("AND", "NOT"):
                negate = word == "NOT"
                continue
            quoted = word.startswith('"')
            items.append((negate, Item(tuple(w for w in re.split(r"[^\w]+|_", word.lower()) if w), not quoted and word.endswith("*"))))
            negate = False
        out.append(items)
    return out


def one(text: Column, item: Item) -> Column:
    return F.contains(padded(text), F.lit(" " + " ".join(item.terms) + ("" if item.prefix else " "))) if item.terms else F.lit(True)


def predicate(text: Column, query: str) -> Column:
    """Whether a text holds what the query asks for (see parsed)."""
    any_part = F.lit(False)
    for part in parsed(query):
        every = F.lit(True)
        for negate, item in part:
            hit = one(text, item)
            every = every & (~hit if negate else hit)
        any_part = any_part | every
    return any_part


def snippet(text: Column, term: str, around: int = 12) -> Column:
    """About two dozen words around the first word that starts with the term, that word in brackets; without one, the first 240 characters."""
    words = F.split(text, r"\s+")
    at = F.array_position(F.transform(words, lambda w: F.startswith(F.regexp_replace(F.lower(w), SPLIT, ""), F.lit(term.lower()))), F.lit(True))
    lo = F.greatest(at - around, F.lit(1))
    shown = F.transform(F.slice(words, lo.cast("int"), F.lit(2 * around)), lambda w, i: F.when(i + lo == at, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    cut = F.concat(F.when(lo > 1, F.lit("…")).otherwise(F.lit("")), F.array_join(shown, " "), F.when(lo + 2 * around <= F.size(words), F.lit("…")).otherwise(F.lit("")))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, 240))


def search(contents: DataFrame, sessions: DataFrame, query: str, kind: str | None = None, source: str | None = None, limit: int | None = 50, index: TextIndex | None = None) -> DataFrame:
    """Contents that match, with a snippet, by session and place. With an index over the contents, only the texts that match are read and shown."""
    hits = contents.where(predicate(F.col("text"), query)) if index is None else contents.join(index.matching(query), list(index.keys), "left_semi")
    if kind is not None:
        hits = hits.where(F.col("kind") == kind)
    of = sessions.select("session_id", "source", "project")
    rows = hits.join(of if source is None else of.where(F.col("source") == source), "session_id")
    term = re.sub(r"[^\w].*", "", query.strip('"'))
    rows = rows.withColumn("snippet", snippet(F.col("text"), term)).orderBy("session_id", "seq")
    return rows if limit is None else rows.limit(limit)
