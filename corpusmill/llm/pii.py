"""Personal data: base patterns with checks, and candidates that boosted trees judge.

Base spans are the leftmost non-overlapping matches of four patterns that pass their checks. Beside
them, high-recall generators propose looser spans, which may overlap base spans and each other:
written-out or spaced addresses, groups of three and four digits, four small numbers, and digits with any marks between.
Features of a candidate's format and of the text around it feed gradient-boosted trees, and each generator has a threshold of its own.
Base spans always stay; a candidate that meets one is never added.

The trees don't learn what base patterns say. They learn from ``TEACH`` places of the corpus, chosen by a hash, into which
personal data in formats that no base pattern takes are set (``LOOSE``), and what only looks like it (``DECOYS``): card numbers that
fail the Luhn check, four numbers beyond 255, dates, versions, prices, order numbers. Three in four places teach; on the fourth the thresholds are
calibrated so that ``PRECISION`` of what passes is personal data. A generator that can't reach that adds nothing.

DataFrame functions only. A text is read once: matches are set off by a mark, the text is split there,
and lengths of the parts give the places. Patterns use possessive repeats and begin only where a
leftmost match can, so that none backtracks over a long text.

Places count code points, the end exclusive.

Defined results:
  * a null text is the empty text, without spans; a text of any length is searched whole;
  * a failing match is dropped whole, and the search goes on behind it;
  * of spans with equal starts, kinds come as listed in ``KINDS``; equal spans of a kind are given once;
  * a table without texts teaches nothing, and nothing is added;
  * repeated rows give repeated rows and teach once; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.boosting import Boosted, boost, calibrated_threshold
from corpusmill.scratch import materialize, numbered

KINDS = ("email", "ip", "card", "phone")
#: At most about so many places of the corpus are learned from and calibrated on.
TEACH = 256
PRECISION = 0.99
LEFT, RIGHT = 24, 12

# A match begins behind the last one, or where its first run of characters does.
_LOCAL = r"A-Za-z0-9._%+-"
_BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MAY_HOLD = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_CANDIDATES = {
    "address": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "grouped": r"(?<![0-9A-Za-z])(?<![0-9][\x20./-])(?:00?[\x20./-]?)?(?:[0-9]{1,3}[\x20./-]{1,2})?\(?[0-9]{3}\)?[\x20./-]{0,2}[0-9]{3}[\x20./-]{1,2}[0-9]{4}(?![0-9A-Za-z]|[./-][0-9])",
    "quad": r"(?<![0-9A-Za-z])(?<![0-9][\x20.-])[0-9]{1,3}(?:\x20?(?:[.-]|\[\.\]|\(dot\)|\[dot\])\x20?[0-9]{1,3}){3}(?![0-9A-Za-z]|[.-][0-9])",
    "number": r"(?:\G|(?<![0-9A-Za-z]))[+(]?[0-9](?:[\x20()./-]{0,3}[0-9])++",
}
_MAY_PROPOSE = {"address": r"@|[(\[]at[)\]]", "grouped": r"[0-9]{3}[\x20./-]{1,2}[0-9]{4}", "quad": r"[0-9]\x20?[.\-\[(]", "number": r"[0-9][\x20()./-]{0,3}[0-9]"}
_CONTEXT = r"(?i)\b(?:phone|tel|mobile|call|fax|e-?mail|mail|contact|card|visa|account|host|addr\w*|ip)\b"
_MARK = "\x01"
_BLOCK = 256

FEATURES = ("size", "digits", "letters", "spaces", "dots", "dashes", "brackets", "slashes", "plus", "at", "groups", "longest", "first", "last", "luhn", "octets", "name", "before_letter", "before_digit", "before_mark", "after_letter", "after_digit", "after_mark", "context")

_FOUND = "array<struct<start:bigint,match:string,before:string,after:string>>"


def _with_running(rows: DataFrame, columns: dict[str, str], combine, first: int) -> DataFrame:
    """Adds, for name: array of longs, an array ``name`` of what ``combine`` makes of all entries before each entry.

    Runs over blocks of entries first, then inside each block: work grows with the entries, not their
    square. Arrays are zipped, never looked up from inside a lambda: the optimizer may move what makes a
    column to where it is used, and a lambda would make it anew for each entry.
    """
    zero = F.lit(first).cast("long")
    runs = lambda xs, start: F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def blocks(array: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / _BLOCK).cast("int")), lambda b: F.slice(array, b * _BLOCK + 1, _BLOCK))

    def inside(name: str) -> Column:
        own = F.zip_with(f"_blocks_{name}", f"_before_{name}", lambda xs, start: F.when(xs.isNotNull(), F.slice(runs(xs, start), 1, F.size(xs))))
        return F.flatten(F.filter(own, lambda xs: xs.isNotNull()))

    rows = rows.withColumns({f"_blocks_{name}": F.when(F.size(array) > 0, blocks(array)) for name, array in columns.items()})
    rows = rows.withColumns({f"_before_{name}": runs(F.transform(f"_blocks_{name}", lambda xs: F.aggregate(xs, zero, lambda acc, x: combine(acc, x))), zero) for name in columns})
    rows = rows.withColumns({name: inside(name) for name in columns})
    return rows.drop(*[f"_{x}_{name}" for x in ("blocks", "before") for name in columns])


def _with_matches(rows: DataFrame, patterns: dict[str, str], may: dict[str, str]) -> DataFrame:
    """Adds, for each pattern, a column of its name with array<struct<start, match, before, after>> of its matches in ``text``."""
    set_off = lambda k: F.split(F.regexp_replace("text", patterns[k], f"{_MARK}$0{_MARK}"), _MARK, -1)
    rows = rows.withColumns({f"_parts_{k}": F.when(F.regexp_like("text", F.lit(may[k])), set_off(k)) for k in patterns})
    rows = rows.withColumns({f"_parts_{k}": F.when(F.size(f"_parts_{k}") >= 3, F.col(f"_parts_{k}")) for k in patterns})
    rows = rows.withColumns({f"_lengths_{k}": F.transform(f"_parts_{k}", lambda p: F.length(p).cast("long")) for k in patterns})
    rows = _with_running(rows, {f"_places_{k}": f"_lengths_{k}" for k in patterns}, lambda acc, x: acc + x, 0)

    def found(k: str) -> Column:
        parts = f"_parts_{k}"
        outside, inside = F.filter(parts, lambda p, i: i % 2 == 0), F.filter(parts, lambda p, i: i % 2 == 1)
        zipped = F.arrays_zip(F.filter(f"_places_{k}", lambda p, i: i % 2 == 1).alias("start"), inside.alias("match"), F.slice(outside, 1, F.size(inside)).alias("before"), F.slice(outside, 2, F.size(inside)).alias("after"))
        own = lambda m: F.struct(m["start"].alias("start"), m["match"].alias("match"), F.right(m["before"], F.lit(LEFT)).alias("before"), F.left(m["after"], F.lit(RIGHT)).alias("after"))
        return F.coalesce(F.transform(zipped, own), F.array().cast(_FOUND))

    rows = rows.withColumns({k: found(k) for k in patterns})
    return rows.drop(*[f"_{x}_{k}" for x in ("parts", "lengths", "places") for k in patterns])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _digits_apart(match: Column) -> Column:
    """Groups of digits, set apart by dots."""
    return F.regexp_replace(F.regexp_replace(match, "[^0-9]+", "."), r"^\.|\.$", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, 2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def _passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(F.left(part(p), F.lit(3)), 3, "0") <= "255"))
    n = F.length(_digits(match))
    return n.between(14, 19) & luhn(_digits(match)) if kind == "card" else n.between(10, 15)


def _base_column() -> Column:
    """array<struct<start, rank, end>> of all base spans, by start, then kind, from the columns of matches."""

    def spans(rank: int, kind: str) -> Column:
        kept = F.filter(kind, lambda m: _passes(kind, m["match"]))
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), (m["start"] + F.length(m["match"])).alias("end")))

    return F.array_sort(F.concat(*[spans(rank, kind) for rank, kind in enumerate(KINDS)]))


def _features(m: Column) -> dict[str, Column]:
    match, before, after = m["match"], m["before"], m["after"]
    count = lambda p, c=match: F.regexp_count(c, F.lit(p))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return {
        "size": F.length(match),
        "digits": count("[0-9]"),
        "letters": count("[A-Za-z]"),
        "spaces": count(r"\x20"),
        "dots": count(r"\."),
        "dashes": count("-"),
        "brackets": count(r"[()\[\]]"),
        "slashes": count("/"),
        "plus": flag(match.startswith("+") | before.endswith("+")),
        "at": count("@"),
        "groups": count("[0-9]+"),
        "longest": F.coalesce(F.array_max(F.transform(F.split(match, "[^0-9]+"), F.length)), F.lit(0)),
        "first": F.length(F.regexp_extract(match, "^[^0-9]*([0-9]*)", 1)),
        "last": F.length(F.regexp_extract(match, "([0-9]*)[^0-9]*$", 1)),
        "luhn": flag(F.length(_digits(match)).between(14, 19) & luhn(_digits(match))),
        "octets": flag(F.forall(F.split(_digits_apart(match), r"\."), lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))),
        "name": flag(match.rlike(r"^[^@(\[]*[A-Za-z]") & match.rlike(r"[A-Za-z]{2,}$")),
        "before_letter": flag(before.rlike(r"\p{L}$")),
        "before_digit": flag(before.rlike(r"[0-9]\W?$")),
        "before_mark": flag(before.rlike(r"[^\p{L}\p{N}\s]$")),
        "after_letter": flag(after.rlike(r"^\p{L}")),
        "after_digit": flag(after.rlike(r"^\W?[0-9]")),
        "after_mark": flag(after.rlike(r"^[^\p{L}\p{N}\s]")),
        "context": flag(before.rlike(_CONTEXT)),
    }


def _candidate_column() -> Column:
    """array<struct<start, end, generator, features...>> of the generators' proposals."""

    def proposals(number: int, kind: str) -> Column:
        found = F.col(kind)
        if kind == "number":
            found = F.filter(found, lambda m: F.regexp_count(m["match"], F.lit("[0-9]")) >= 7)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["match"])).alias("end"), F.lit(number).alias("generator"), *[c.cast("double").alias(k) for k, c in _features(m).items()]))

    return F.concat(*[proposals(number, kind) for number, kind in enumerate(_CANDIDATES)])


def _with_meetings(rows: DataFrame) -> DataFrame:
    """Adds to each of ``candidates`` whether it meets one of ``base``.

    It does if the last end of all base spans that start before the candidate's end is behind the
    candidate's start. Base starts and candidate ends are sorted together and run through once.
    """
    none = F.lit(-1).cast("long")
    starts = F.transform("base", lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("is_base"), b["end"].alias("end"), F.lit(-1).alias("place")))
    ends = F.transform("candidates", lambda c, i: F.struct(c["end"].alias("at"), F.lit(0).alias("is_base"), none.alias("end"), i.alias("place")))
    rows = rows.withColumn("_events", F.when((F.size("base") > 0) & (F.size("candidates") > 0), F.array_sort(F.concat(starts, ends))))
    rows = rows.withColumn("_ends", F.transform("_events", lambda e: e["end"]))
    rows = _with_running(rows, {"_last": "_ends"}, lambda acc, x: F.greatest(acc, x), -1)
    own = F.filter(F.zip_with("_events", "_last", lambda e, x: F.struct(e["place"].alias("place"), x.alias("last"))), lambda e: e["place"] >= 0)
    rows = rows.withColumn("_last", F.when(F.col("_events").isNotNull(), F.array_sort(own)).otherwise(F.array_repeat(F.struct(F.lit(-1).alias("place"), none.alias("last")), F.size("candidates"))))
    meets = F.zip_with("candidates", "_last", lambda c, x: c.withField("meets", x["last"] > c["start"]))
    return rows.withColumn("candidates", meets).drop("_events", "_ends", "_last")


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, base, candidates) of each whole text."""
    rows = documents.select("doc_id", F.translate(F.coalesce("text", F.lit("")), _MARK, "\x02").alias("text"))
    rows = _with_matches(rows, _BASE | _CANDIDATES, _MAY_HOLD | _MAY_PROPOSE)
    rows = rows.select("doc_id", _base_column().alias("base"), _candidate_column().alias("candidates"))
    return _with_meetings(rows)


def _forms() -> tuple[dict[str, list[Column]], list[Column]]:
    """Loose formats by kind, and decoys, from ``d`` (a row's random digits), ``w`` and ``v`` (two lower-case words)."""
    d = lambda i, n: F.substring("d", i, n)
    part = lambda i: F.pmod(d(i, 4).cast("int"), F.lit(256)).cast("string")
    join = lambda sep, *parts: F.concat_ws(sep, *parts)
    stem = F.concat(F.lit("4"), d(1, 14))
    check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(stem, F.lit("0"))), F.lit(10)), F.lit(10))
    right, wrong = (F.concat(stem, F.pmod(check + k, F.lit(10)).cast("string")) for k in (0, 1))
    fours = lambda c, sep: join(sep, *[F.substring(c, 1 + 4 * i, 4) for i in range(4)])
    big = F.concat(F.lit("7"), d(30, 2))
    year, month, day = F.concat(F.lit("20"), d(40, 2)), F.lpad((F.pmod(d(42, 2).cast("int"), F.lit(12)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(d(44, 2).cast("int"), F.lit(28)) + 1).cast("string"), 2, "0")
    named, area = F.concat(F.substring("w", 1, 3 + F.pmod(d(55, 1).cast("int"), F.lit(4))), F.element_at(F.array(F.lit("."), F.lit("_"), F.lit("")), F.pmod(d(56, 1).cast("int"), F.lit(3)) + 1), F.substring("d", 50, F.pmod(d(54, 1).cast("int"), F.lit(4)))), F.concat(F.lit("5"), d(60, 2))
    loose = {
        "email": [
            F.concat("w", F.lit(" (at) "), "v", F.lit(" (dot) com")),
            F.concat(named, F.lit("[at]"), "v", F.lit("[dot]org")),
            F.concat(named, F.lit(" @ "), "v", F.lit(" . com")),
            F.concat("w", F.lit("(at)"), "v", F.lit(".example.net")),
            F.concat("w", F.lit(" [at] mail"), d(52, 1), F.lit("."), "v", F.lit(".com")),
            F.concat(named, F.lit(" @ "), "v", F.lit(".org")),
        ],
        "ip": [join(" . ", *[part(k) for k in (1, 5, 9, 13)]), join("[.]", *[part(k) for k in (2, 6, 10, 14)]), join("(dot)", *[part(k) for k in (3, 7, 11, 15)]), join("[dot]", *[part(k) for k in (4, 8, 12, 16)])],
        "card": [fours(right, "."), fours(right, "/"), fours(right, "--"), fours(right, "  "), fours(right, " - "), join("/", F.substring(right, 1, 4), F.substring(right, 5, 6), F.substring(right, 11, 6))],
        "phone": [
            F.concat(F.lit("("), area, F.lit(") "), d(20, 3), F.lit("-"), d(23, 4)),
            join("-", area, d(20, 3), d(23, 4)),
            join(".", area, d(20, 3), d(23, 4)),
            join(" ", area, d(20, 3), d(23, 4)),
            F.concat(F.lit("1 ("), area, F.lit(") "), d(20, 3), F.lit("-"), d(23, 4)),
            join("-", F.lit("1"), area, d(20, 3), d(23, 4)),
            F.concat(F.lit("001 "), area, F.lit(" "), d(20, 3), F.lit(" "), d(23, 4)),
            F.concat(area, F.lit("/"), d(20, 3), F.lit("-"), d(23, 4)),
        ],
    }
    decoys = [
        wrong, fours(wrong, " "), fours(wrong, "-"), fours(wrong, "."), fours(wrong, "/"), fours(wrong, "  "), fours(wrong, "--"), d(1, 16),
        join(".", part(1), big, part(5), part(9)), join(" . ", big, part(1), part(5), part(9)), join("[.]", part(1), part(5), part(9), big), join(".", d(1, 1), d(2, 2), d(4, 4)), join("-", d(1, 2), d(3, 1), d(4, 2), d(6, 4)),
        d(1, 7), d(1, 8), d(1, 10), d(1, 12), d(1, 22),
        join("-", year, month, day), join("/", month, day, year), F.concat(join(".", year, month, day), F.lit(" "), month), F.concat(join("-", year, month, day), F.lit("-"), d(1, 6)),
        join(".", d(1, 1), d(2, 9)), join(" ", d(1, 1), d(2, 3), d(5, 3), d(8, 3)), join(".", d(1, 1), d(2, 3), d(5, 3), d(8, 3)), join("-", F.lit("978"), d(1, 1), d(2, 2), d(4, 6), d(10, 1)), join("-", year, d(1, 6), d(7, 2)),
        join("/", d(1, 5), d(6, 5)), join(" ", *[d(1 + 2 * i, 2) for i in range(6)]), join("-", year, F.concat(F.lit("20"), d(3, 2))), join(" - ", year, F.concat(F.lit("20"), d(3, 2))),
        F.concat(d(1, 1), F.lit(" @ "), d(2, 1), F.lit("."), d(3, 2)), F.concat(d(1, 2), F.lit(" @ "), d(3, 2), F.lit("."), d(5, 2)), F.concat(d(1, 3), F.lit(" (at) "), d(4, 1), F.lit("."), d(5, 1)),
    ]
    return loose, decoys


def _lessons(documents: DataFrame, teach: int) -> DataFrame:
    """(place, text, start, end, good): each form, good or not, set into a place of the corpus that has no digits of its own."""
    rows = documents.where(F.length("text") > 0).select(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text"))).alias("place"), "text")
    total = documents.count()
    bound = f"{min(0xFFFFFFFF, int(teach / max(total, 1) * 0xFFFFFFFF)):08x}"
    rows = rows.where(F.substring("place", 1, 8) <= bound).dropDuplicates(["place"])
    # Whole words around a hashed place; a mark or nothing may stand between them and what is set in.
    at = F.pmod(F.xxhash64("place"), F.length("text")).cast("int")
    clean = lambda c: F.regexp_replace(c, r"[0-9@+()\[\]./\-]", "")
    few = rows.select("place", clean(F.substring("text", F.greatest(at - 30, F.lit(1)), F.least(at, F.lit(30)))).alias("before"), clean(F.substring("text", at + 1, F.lit(20))).alias("after"))
    word = lambda at, n, letters: F.translate(F.substring(F.sha1("place"), at, n), "0123456789", letters)
    few = few.withColumns({"d": F.translate(F.concat(F.sha2("place", 256), F.sha2(F.reverse("place"), 256)), "abcdef", "172839"), "w": word(1, 6, "aeiourstln"), "v": word(7, 7, "aeioumpdkg")})
    few = materialize(few, "pii-places")
    loose, decoys = _forms()
    forms = [F.struct(F.lit(i).alias("form"), c.alias("own"), F.lit(good).alias("good")) for i, (c, good) in enumerate([(c, True) for group in loose.values() for c in group] + [(c, False) for c in decoys])]
    told = few.select("place", "before", "after", F.explode(F.array(*forms)).alias("x")).select("place", "before", "after", "x.*")
    pick = lambda salt, *values: F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(F.xxhash64("place", "form", F.lit(salt)), F.lit(len(values))).cast("int") + 1)
    lead = F.when(F.col("good"), pick(1, " ", " ", " call ", " phone: ", " mail ", ", ", " | ", "\n")).otherwise(pick(1, " ", " ", " order ", " no: ", " on ", ", ", " | ", "\n"))
    told = told.withColumns({"lead": F.concat("before", lead), "tail": F.concat(pick(2, " ", ", ", ". ", "\n", " | ", "!! "), F.col("after"))})
    start = F.length("lead").cast("long")
    told = told.select("place", F.concat("lead", "own", "tail").alias("text"), start.alias("start"), (start + F.length("own")).alias("end"), "good")
    return materialize(told, "pii-lessons")


def learn(documents: DataFrame, teach: int = TEACH, precision: float = PRECISION) -> tuple[Boosted, list[float | None]] | None:
    """Trees, and a threshold for each generator, from a bounded number of places."""
    told = _lessons(documents, teach)
    told = told.repartition(max(1, documents.sparkSession.sparkContext.defaultParallelism))  # one small file: one task otherwise
    scanned = materialize(scan(told.select(F.struct("place", "start", "end", "good").alias("doc_id"), "text")), "pii-taught").select("doc_id.*", F.explode("candidates").alias("c"))
    # What is proposed beside the form's own place is not judged; of its parts, only the whole is right.
    mine = scanned.where((F.col("c.start") < F.col("end")) & (F.col("c.end") > F.col("start")) & ~F.col("c.meets"))
    whole = F.col("good") & (F.col("c.start") == F.col("start")) & (F.col("c.end") == F.col("end"))
    few = mine.select("place", whole.cast("double").alias("label"), F.col("c.generator").cast("double").alias("generator"), *[F.col(f"c.{k}") for k in FEATURES])
    rows = sorted(map(tuple, few.toLocalIterator()))  # bounded by the number of places
    if not rows:
        return None
    y, generator, x = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], int), np.array([r[2:] for r in rows], float)
    check = np.array([int(r[0][:8], 16) % 4 == 3 for r in rows])
    if not 0 < y[~check].sum() < (~check).sum():
        return None
    model = boost(x[~check], y[~check], least=5)
    p = model.predict(x)
    return model, [calibrated_threshold(p[own], y[own], precision) if (own := check & (generator == g)).any() else None for g in range(len(_CANDIDATES))]


def _added(learned: tuple[Boosted, list[float | None]] | None) -> Column:
    """Spans to add, of the candidates that meet no base span."""
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    if learned is None:
        return none
    model, thresholds = learned
    names = ("generator", *FEATURES)
    bound = F.array(*[F.lit(2.0 if t is None else t) for t in thresholds])
    chosen = F.filter(F.col("candidates"), lambda c: ~c["meets"] & (model.column(lambda f: c[names[f]].cast("double")) >= F.get(bound, c["generator"])))
    rank = lambda c: F.when(c["generator"] == 0, 0).when(c["luhn"] == 1, 2).when((c["groups"] == 4) & (c["octets"] == 1), 1).otherwise(3)
    return F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), rank(c).alias("rank"), c["end"].alias("end")))


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, base, spans): base spans and all spans of each document, by start, then kind."""
    scanned = materialize(scan(documents), "pii")
    learned = learn(documents)
    return scanned.select("doc_id", "base", F.array_sort(F.array_distinct(F.concat("base", _added(learned)))).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def report(documents: DataFrame) -> DataFrame:
    """The contract's rows."""
    number = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return find(documents).select("doc_id", *[number(r).alias(f"n_{k}") for r, k in enumerate(KINDS)], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` with all spans replaced by their kind in brackets; overlapping spans are merged, the first naming them."""
    rows = numbered(documents, "_row")
    spans = find(rows.select(F.col("_row").alias("doc_id"), "text")).where(F.size("spans") > 0).select(F.col("doc_id").alias("_row"), "spans")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], kept, F.get(names, s["rank"]))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    joined = rows.join(spans, "_row", "left").withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(done))
    return joined.select(*documents.columns)
