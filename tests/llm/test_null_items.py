"""Benchmark items without an id are searched like all others."""

import pyarrow as pa

from corpusmill.llm.decontaminate import WuManber, _scan, windows_of

PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_items_of_null_id_hit_and_are_not_listed():
    patterns, owners = windows_of([(None, PASSAGE), (7, PASSAGE + " fifteen"), (None, None)])
    batch = pa.record_batch([pa.array([1, 2, 3], pa.int64()), pa.array([f"x {PASSAGE} y", PASSAGE + " fifteen", "clean"])], names=["doc_id", "text"])
    rows = [r for b in _scan(WuManber(patterns), owners, iter([batch])) for r in b.to_pylist()]
    assert [(r["n_hit"], r["items"]) for r in rows] == [(14, ["7"]), (15, ["7"]), (0, [])]
    patterns, owners = windows_of([(None, PASSAGE)])
    rows = [r for b in _scan(WuManber(patterns), owners, iter([batch])) for r in b.to_pylist()]
    assert [(r["n_hit"], r["items"]) for r in rows] == [(14, []), (14, []), (0, [])]
