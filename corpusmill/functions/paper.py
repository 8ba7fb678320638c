"""Text that was extracted from PDF pages: ligatures, hyphens, running heads, reference lists, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions.arrays import let

# Ligatures and their letters; a soft hyphen vanishes.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "­": ""}
_INVISIBLE = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{FFFD}]"
_PAGE_LINE = r"(?i)^(?:(?:page )?[0-9]{1,4}(?: of [0-9]{1,4})?|arxiv:\S+.*|[0-9]{1,4}\s*/\s*[0-9]{1,4})$"
_REFERENCES = r"(?i)^\s*(references|bibliography|literature cited)\s*$"


def characters(text: Column) -> Column:
    """Ligatures spelled out, glyph numbers and invisible characters dropped, words joined that a line end hyphenates."""
    for char, letters in LIGATURES.items():
        text = F.replace(text, F.lit(char), F.lit(letters))
    text = tx.replaced(tx.replaced(text, r"\(cid:[0-9]+\)", ""), _INVISIBLE, "")
    return tx.replaced(F.replace(text, F.lit("\r"), F.lit("\n")), r"-\n(?=[a-z])", "")


def lines(text: Column, least: int = 3, shorter_than: int = 120) -> Column:
    """Trimmed lines without page numbers and without short lines that repeat and don't end a sentence."""
    def kept(all_: Column) -> Column:
        heads = let(F.array_sort(F.filter(all_, lambda x: (x != "") & (F.length(x) < shorter_than) & ~F.endswith(x, F.lit(".")))), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i + least - 1).eqNullSafe(x))))
        return let(heads, lambda h: F.filter(all_, lambda x: ~F.array_contains(h, x) & ~x.rlike(_PAGE_LINE)))

    return let(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), kept)


def before_references(all_: Column, behind: float = 0.55) -> Column:
    """Lines before the first heading of references that comes after a share of the text."""
    def cut(ls: Column) -> Column:
        total = F.length(F.array_join(ls, "\n"))
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(-1).alias("cut"))
        step = lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), (acc["i"] + 1).alias("i"), F.when((acc["cut"] < 0) & x.rlike(_REFERENCES) & (acc["at"] > behind * total), acc["i"]).otherwise(acc["cut"]).alias("cut"))
        return let(F.aggregate(ls, start, step, lambda acc: acc["cut"]), lambda k: F.when(k >= 0, F.slice(ls, 1, k)).otherwise(ls))

    return let(all_, cut)


def paragraphs(all_: Column, share: float = 0.6) -> Column:
    """Lines joined to paragraphs, which end at an empty line, or at a line much shorter than the median that ends a sentence."""
    def joined(ls: Column) -> Column:
        sizes = F.array_sort(F.filter(F.transform(ls, lambda x: F.length(x)), lambda n: n > 30))
        median = let(sizes, lambda s: F.coalesce(F.get(s, F.floor(F.size(s) / 2).cast("int")), F.lit(80)))
        ends = lambda x, m: (F.length(x) < share * m) & x.rlike(r"[.:?!]$")
        marked = let(median, lambda m: F.transform(ls, lambda x: F.when(x == "", F.lit("\n")).when(ends(x, m), F.concat(x, F.lit("\n"))).otherwise(F.concat(x, F.lit(" ")))))
        parts = F.transform(F.split(F.array_join(marked, ""), "\n"), lambda p: F.trim(tx.replaced(p, r"[ \t]+", " ")))
        return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")

    return let(all_, joined)


def clean(text: Column) -> Column:
    """All steps."""
    return paragraphs(before_references(lines(characters(text))))
