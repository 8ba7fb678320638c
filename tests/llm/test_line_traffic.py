"""What line de-duplication sends about to compare pairs."""

import hashlib

import numpy as np

from corpusmill.llm import arrowtext, linededup
from corpusmill.scratch import materialize


def shuffled(spark):
    """Bytes that stages wrote for others so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_lines_without_a_pair_stay_where_they_are(spark):
    text = lambda i: " ".join(hashlib.sha256(f"{i}:{j}".encode()).hexdigest() for j in range(5))
    rows = [(i, 0, i * 7, 5, bytearray(text(i).encode())) for i in range(-3000, 3000)] + [(10_000 + i, 1, i, 5, bytearray(text(i).encode().upper())) for i in range(10)]
    table = materialize(spark.createDataFrame(rows, "d long, l int, k long, n int, line binary"), "traffic-lines")
    pairs = spark.createDataFrame([(10_000 + i, 1, i, j, 0, j * 7) for i in range(10) for j in (i, i + 1, -i - 1)], "d1 long, l1 int, k1 long, d2 long, l2 int, k2 long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = {tuple(r) for r in linededup._verified(pairs, table).collect()}
        sent = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {(10_000 + i, 1, i) for i in range(10)}
    assert sent < 0.25 * sum(len(r[4]) for r in rows)
    assert not linededup._verified(pairs.limit(0), table).collect()
    # A table of the least size lets more pass in vain; no end is lost.
    ends = {(r["d1"], r["l1"], r["k1"]) for r in pairs.collect()} | {(r["d2"], r["l2"], r["k2"]) for r in pairs.collect()}
    passed = {(r["d"], r["l"], r["k"]) for r in linededup._paired(pairs, table).collect()}
    assert ends & {(r[0], r[1], r[2]) for r in rows} <= passed and len(passed) < 600


def test_orders_and_bytes_by_faster_ways():
    rng = np.random.default_rng(3)
    for n, lines, most in ((0, 1, 1), (1, 1, 1), (5000, 40, 3), (5000, 40, (1 << 32) - 1), (70_000, 1 << 19, (1 << 32) - 1)):
        line, count = np.sort(rng.integers(0, lines, n)), rng.integers(0, most, n, endpoint=True).astype(np.uint32)
        assert (linededup._rare_first(line, count) == np.lexsort((np.arange(n), count, line))).all()
    every = np.arange(256, dtype=np.uint8)
    assert arrowtext.lower_ascii(every).tobytes() == bytes(range(256)).lower()
    assert bytes(every[~linededup._is_word(every)]) == b"\t\n\x0b\x0c\r "
