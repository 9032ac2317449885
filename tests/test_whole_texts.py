"""Queries that read whole texts: what tells rows apart stands behind the first 3,000 characters."""

import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry


def words(seed: int, n: int = 600) -> str:
    """Different words of eight letters, about 5,400 characters."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("bcdfghklmnprstvw", k=8)) for _ in range(n))


@pytest.fixture(scope="module")
def documents(tmp_path_factory):
    """1 and 2 share a head alone, 3 and 4 all but a head, 5 and 6 everything but the last words."""
    d = tmp_path_factory.mktemp("documents")
    texts = [f"{words(1)} {words(2)}", f"{words(1)} {words(3)}", f"{words(4, 400)} {words(5, 3000)}", f"{words(6, 400)} {words(5, 3000)}", f"{words(7)} once", f"{words(7)} twice", None]
    pd.DataFrame({"doc_id": range(1, 8), "text": texts}).to_parquet(d / "documents.parquet")
    return str(d)


def by_sql(name: str, d: str, table: str = "documents") -> list[tuple]:
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW {table} AS FROM '{d}/{table}.parquet'")
        return sorted(c.sql(entry.oracle_sql()[name]).fetchall())


def test_similar_pairs_reads_whole_texts(spark, documents):
    got = sorted(map(tuple, entry.queries()["similar_pairs"](spark, documents).collect()))
    assert [r[:2] for r in got] == [(3, 4), (5, 6)] and got == by_sql("similar_pairs", documents)


def test_sensitivity_reads_whole_texts(spark, documents):
    got = sorted(map(tuple, entry.queries()["sensitivity"](spark, documents).collect()))
    assert got == [(0.8, 2, 2), (0.9, 1, 1), (0.95, 1, 1)] and got == by_sql("sensitivity", documents)


@pytest.fixture(scope="module")
def messages(tmp_path_factory):
    """Rows 1 to 7: two of train and one of test share a head alone, two of train and one of test all but the last words, and one has no split."""
    d = tmp_path_factory.mktemp("messages")
    texts = [f"{words(1)} {words(i)}" for i in (2, 3, 4)] + [f"{words(7)} {w}" for w in ("once", "twice", "thrice")] + [f"{words(1)} {words(9)}"]
    rows = pd.DataFrame({"pos": range(1, 8), "text": texts, "text_raw": texts, "split": ["train", "train", "test", "train", "train", "test", None]})
    same = {"id": "x", "label": "safe", "scam_type": "none", "language": "en", "source": "s", "is_synthetic": False, "generator": "g", "subtype": "other"}
    rows.assign(**same, urls=[[]] * 7).to_parquet(d / "combined.parquet")
    pd.DataFrame({"row_id": ["-"], "action": ["keep"]}).to_parquet(d / "audit_decisions.parquet")
    return str(d)


def test_trim_cross_split_reads_whole_texts(spark, messages):
    assert dict(map(tuple, entry.queries()["trim_cross_split"](spark, messages).collect())) == {"train": 4, "test": 1}


def test_level_normalized_reads_whole_texts(spark, messages):
    rows = entry.queries()["level_normalized"](spark, messages).where("rows > 0").collect()
    # Inside train one of two goes, across the splits that of test; the heads alone take none, of the row that gets a split either.
    assert sum(r["rows"] for r in rows) == 5 and sum(r["rows"] for r in rows if r["split"] == "test") >= 1


def test_preprocess_reads_whole_texts(spark, messages):
    steps = dict(map(tuple, entry.queries()["preprocess"](spark, messages).collect()))
    assert steps == {"input": 6, "cleaned": 6, "exact": 6, "near": 4, "holdout": 4, "trimmed": 4}


def test_protocol_reads_whole_texts(spark, tmp_path):
    """The word that tells scam from safe stands last."""
    n = 48
    texts = [f"{words(100 + i, 300)} {'prize' if i % 2 else 'lunch'}" for i in range(n)]
    rows = pd.DataFrame({"pos": range(n), "text": texts, "label": ["safe", "scam"] * (n // 2), "split": [("train", "train", "val", "test")[i // 2 % 4] for i in range(n)]})
    rows.assign(source="s", is_synthetic=False).to_parquet(tmp_path / "combined.parquet")
    got = entry.queries()["protocol"](spark, str(tmp_path)).where("stage = 'test'").first()
    assert got["n"] == 12 and got["roc_auc"] == 1.0
