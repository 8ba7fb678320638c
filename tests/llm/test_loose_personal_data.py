"""Formats that no base pattern takes, planted in texts with other digits and names than those that teach: found, and decoys left alone."""

import random
import re

import pytest

from corpusmill.llm import pii

rng = random.Random(7)


def digits(n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def luhn(s):
    return sum(int(a) if i % 2 == 0 else sum(divmod(2 * int(a), 10)) for i, a in enumerate(reversed(s))) % 10 == 0


def card():
    s = "4" + digits(14)
    return next(s + c for c in "0123456789" if luhn(s + c))


def no_card():
    s = card()
    return s[:-1] + str((int(s[-1]) + rng.randint(1, 9)) % 10)


def fours(s, sep):
    return sep.join(s[i : i + 4] for i in (0, 4, 8, 12))


def octets(sep):
    return sep.join(str(rng.randrange(256)) for _ in range(4))


LOOSE = {
    "email": [lambda: f"{rng.choice(['anna', 'bob', 'j.doe'])} (at) {rng.choice(['mail', 'corp-x'])} (dot) com", lambda: f"info{digits(2)}[at]site[dot]org", lambda: f"kim.{digits(1)} @ example.com"],
    "ip": [lambda: octets(" . "), lambda: octets("[.]")],
    "card": [lambda: fours(card(), "."), lambda: fours(card(), "/"), lambda: fours(card(), "  ")],
    "phone": [lambda: f"({rng.randint(200, 999)}) {digits(3)}-{digits(4)}", lambda: f"{rng.randint(200, 999)}-{digits(3)}-{digits(4)}", lambda: f"{rng.randint(200, 999)}.{digits(3)}.{digits(4)}", lambda: f"1-{rng.randint(200, 999)}-{digits(3)}-{digits(4)}"],
}
DECOYS = [no_card, lambda: fours(no_card(), " "), lambda: fours(no_card(), "."), lambda: f"2021-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: digits(8), lambda: f"{digits(1)}.{digits(8)}", lambda: f"{digits(1)} @ {digits(1)}.{digits(2)}", lambda: f"ISBN 978-3-16-{digits(6)}-{digits(1)}", lambda: f"1.{digits(2)}.{digits(4)}", lambda: f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/20{digits(2)} {digits(2)}:{digits(2)}", lambda: f"{digits(3)} {digits(3)} {digits(3)}"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def learned(corpus):
    return pii.learn(corpus, teach=128)


def test_loose_formats_are_found_and_decoys_are_not(spark, corpus, learned):
    texts = [re.sub("[0-9@+]", "", r.text) for r in corpus.limit(200).collect()]
    rows, want = [], []
    forms = [(kind, f) for kind, fs in LOOSE.items() for f in fs] + [(None, f) for f in DECOYS]
    for kind, form in forms * 8:
        t = rng.choice(texts)
        at = t.find(" ", rng.randrange(len(t) + 1))
        at, own = at if at >= 0 else len(t), form()
        rows.append((len(rows), f"{t[:at]} {own} {t[at:].lstrip()}"))
        want.append((kind, f"{kind}:{at + 1}:{at + 1 + len(own)}"))
    scanned = pii.materialize(pii.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "t")
    got = {r.doc_id: r.spans.split(",") if r.spans else [] for r in scanned.select("doc_id", pii.written(pii._added(learned)).alias("spans")).collect()}
    found = [span in got[i] for i, (kind, span) in enumerate(want) if kind]
    assert sum(found) >= 0.9 * len(found)
    wrong = [x for i, (kind, span) in enumerate(want) for x in got[i] if x != span]
    assert len(wrong) <= 0.05 * sum(map(len, got.values()))


def test_scores_are_the_trees_sums(spark, corpus, learned):
    """The compiled expression against the trees run in numpy, row by row."""
    import numpy as np
    from pyspark.sql import functions as F

    model, _ = learned
    names = ("generator", *pii.FEATURES)
    c = pii.materialize(pii.scan(corpus), "t").select(F.explode("candidates").alias("c")).select("c.*")
    rows = c.select(*names, model.column(lambda f: F.col(names[f]).cast("double")).alias("p")).collect()
    assert rows
    np.testing.assert_allclose([r.p for r in rows], model.predict(np.array([[float(r[n]) for n in names] for r in rows])), atol=1e-9)


def test_luhn_failing_numbers_of_the_corpus_stay(corpus, learned):
    """Sixteen digits that fail the check are no card, whatever stands around them."""
    added = pii.materialize(pii.scan(corpus), "t").select("doc_id", pii._added(learned).alias("added")).where("size(added) > 0")
    for r in added.join(corpus.select("doc_id", "text"), "doc_id").collect():
        for s in r.added:
            assert not re.fullmatch("[0-9]{16}", r.text[s["start"] : s["end"]])
