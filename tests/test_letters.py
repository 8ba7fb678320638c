"""Queries on letters beyond ASCII, against their SQL."""

import pytest
from oracle import same
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.plans import catalogue


def agrees(spark, folder, table, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/parts")
    next(folder.glob("parts/*.parquet")).rename(folder / f"{table}.parquet")
    same(spark, folder, catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_upper_case_keeps_the_length(spark):
    texts = ["", "plain", "Straße ßß", "ßa", "ﬁn ŉ ᾳ ΐ", "élan", "𐐨 😀ß", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.upper("t").alias("u")).collect()
    assert {r["i"]: r["u"] for r in got} == dict(enumerate(["", "PLAIN", "STRAẞE ẞẞ", "ẞA", "ﬁN ŉ ᾼ ΐ", "ÉLAN", "𐐀 😀ẞ", None]))
    assert spark.range(1).select(tx.upper(F.lit("x" * 5000 + "ß" * 5000)).alias("u")).first()["u"] == "X" * 5000 + "ẞ" * 5000


def test_paper_text(spark, tmp_path):
    agrees(spark, tmp_path, "benchmark", [(1, "Erßie und so weiter"), (2, "ßßßßßß"), (3, "ﬁǰab c"), (4, "plain text"), (5, ""), (6, "ñandú")], "item_id long, text string", "paper_text")


#: In upper case the first response would pass 1,500 characters if ß gave SS; ids are odd, as only those are upper-cased.
TURNS = [(c, turn, role, text) for c, answer in ((2, "ß" * 1000), (4, "ß" * 1490), (6, "plain answer"), (8, "Größe ﬁn")) for turn, role, text in ((1, "user", f"question {c}"), (2, "assistant", answer))]


@pytest.mark.parametrize("name", ["sft_reasons", "sft_reason_counts"])
def test_instruction_reasons(spark, tmp_path, name):
    agrees(spark, tmp_path, "conversations", TURNS, "conv_id long, turn int, role string, text string", name)


def talks(*pairs):
    """(conversation, prompt, response) as turns."""
    return [(c, turn, role, text) for c, *both in pairs for turn, (role, text) in enumerate(zip(("user", "assistant"), both, strict=True))]


#: Marks that are no turn's; texts of null; letters whose lower case hangs on their place; ids that repeat, as conversation 1,000,007's are those of 7 with 1,000,000,000 added.
ODD_TURNS = {
    "marks": talks((1, "p", "a <| b"), (2, "p", "r"), (3, "<|im_start|>", "r"), (4, "q", "r")),
    "nulls": talks((1, "p", None), (2, "p", "r"), (3, "p", "r"), (4, None, "r"), (5, "<|user|>", None), (6, "q", "r")),
    "letters": talks((1, "ΟΔΟΣ", "r"), (2, "οδοσ", "r"), (3, "οδος", "r"), (4, "İx", "r"), (5, "ix", "r"), (6, "p", "ΟΣ"), (7, "p", "οσ")),
    "ids": [(1, 0, "user", "p"), (1, None, "assistant", "r"), *((None, turn, role, "p") for turn, role in ((0, "user"), (1, "assistant"))), (3, None, "user", "p"), *talks((4, "p", "r"), (5, "p", "r"))],
    "repeated ids": talks((1_000_007, "p", "r"), (7, "p", "r <|"), (9, "q", "r")) + talks((1_000_009, "q", "s"), (2_000_009, "q", "s")),
}


@pytest.mark.parametrize("name", ["sft_reasons", "sft_reason_counts"])
@pytest.mark.parametrize("odd", ODD_TURNS)
def test_instruction_reasons_of_odd_turns(spark, tmp_path, odd, name):
    agrees(spark, tmp_path, "conversations", ODD_TURNS[odd], "conv_id long, turn int, role string, text string", name)


WORDS = ["the and", "éles des", "desé the", "lesñ und", "leś des", "THE_ the", "2der der", "Und DİE der die", "lasß", "für for the and der die", "von und zu", "", None]


@pytest.mark.parametrize("name", ["term_cooccurrence", "topic_term_buckets"])
def test_terms_between_letters_beyond_ascii(spark, tmp_path, name):
    agrees(spark, tmp_path, "documents", list(enumerate(WORDS)), "doc_id long, text string", name)
