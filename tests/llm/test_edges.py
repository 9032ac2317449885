"""Empty tables, tables of nulls, ties and clashing names for every operator."""

import pytest
from pyspark.sql import functions as F

from msgsieve.llm import bitslice, encoding, history, languages, mailparts, mixing, packing, pii, residue, winnow

SCHEMA = ("pos long, text string, text_raw string, source string, split string, sender string, ingest_no int, language string, urls array<string>, "
          "h long, key long, words string, tokens string, shape string, ident string, segments int, damaged int, bucket int, i int")
TAGS = "alias string, tag string"


def operators(spark, df):
    tags = spark.createDataFrame([("en", "en"), ("hi", "hi"), ("?", None)], TAGS)
    docs = df.withColumnRenamed("pos", "doc_id")
    specs = spark.createDataFrame([(1, 64), (2, 0)], "spec_id int, capacity_tokens int")
    plan = spark.createDataFrame([(1, "a", 1.0, 2, 0.5)], "plan_id int, source string, target_share double, max_repeats int, budget_share double")
    return {
        "p1": bitslice.near_duplicate_pairs(df), "p1c": bitslice.near_duplicate_classes(df), "p2": languages.label_languages(df, tags), "p3": encoding.damaged_rows(df), "p4": winnow.split_overlaps(df),
        "p5": pii.find_personal_data(df), "p5r": pii.redact_messages(df), "p6": history.seen_before(df), "p7": mailparts.reduce_mails(df), "p8": packing.pack_documents(docs, specs),
        "p9": mixing.mix_sources(docs, plan)[1], "p10": residue.find_residue(docs)}


@pytest.mark.parametrize("kind", ["empty", "nulls", "ties"])
def test_edges(spark, kind):
    null = (None,) * 18
    rows = {"empty": [], "nulls": [(1, *null), (2, *null)], "ties": [(n, "same words here in every row of it", "same words here in every row of it", "a mail", "train" if n < 3 else "val", "s", n, "en", [], *(1,) * 2, *("x",) * 4, *(1,) * 4) for n in (1, 2, 3)]}[kind]
    got = {k: v.collect() for k, v in operators(spark, spark.createDataFrame(rows, SCHEMA)).items()}
    n = len(rows)
    assert len(got["p1c"]) == len(got["p2"]) == len(got["p5r"]) == len(got["p10"]) == n
    if kind != "ties":
        assert not got["p1"] and not got["p3"] and not got["p4"] and not got["p5"] and not got["p6"] and not got["p7"] and not got["p8"]
    else:
        assert {tuple(r) for r in got["p1"]} == {(1, 2), (1, 3), (2, 3)} and len(got["p4"]) == 2 and {r["pos"] for r in got["p6"]} == {2, 3}
        assert {r["class_id"] for r in got["p1c"]} == {1} and len(got["p8"]) == 3 and all(r["new_words"] == 8 for r in got["p7"])
    assert len(got["p9"]) == 1
