import itertools
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from msgsieve import session
from msgsieve.functions import urls as ur
from msgsieve.operators import dedup, metrics, retrieval, similarity, splits
from msgsieve.operators.graph import connected_components
from msgsieve.sources import readers, sinks
from msgsieve.streaming import stateful

COLS = "pos long, text string, label string, source string, is_synthetic boolean"


def test_exact_dedup(spark):
    rows = [(1, "Same text", "scam", "a", False), (2, "same  text", "safe", "b", False), (3, "other", "safe", "a", True), (4, "Other", "safe", "b", False), (5, None, "safe", "a", False), (6, "", "safe", "a", False)]
    df = spark.createDataFrame(rows, COLS)
    kept = {r["pos"] for r in dedup.deduplicate(df).collect()}
    assert kept == {4, 5, 6}
    assert dedup.deduplicate(df.limit(0)).count() == 0
    assert {r["pos"] for r in dedup.deduplicate(df.orderBy(F.desc("pos"))).collect()} == kept


def test_violations(spark):
    df = spark.createDataFrame([(1, " ", "scam", "promo", "s", "en"), (2, "x", "ham", "odd", None, None)], "pos long, text string, label string, subtype string, source string, language string")
    assert {r["rule"]: r["rows"] for r in dedup.violations(df).collect()} == {"blank_text": 1, "unknown_label": 1, "unknown_subtype": 1, "null_source": 1, "null_language": 1}
    assert dedup.violations(df.limit(0)).count() == 0


def _cosine(texts):
    toks = []
    for t in texts:
        w = re.findall(r"(?u)\b\w\w+\b", re.sub(r"\d+", "0", t.lower()))
        toks.append(w + [" ".join(p) for p in zip(w, w[1:])])
    n = len(texts)
    df = {}
    for t in toks:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    vec = []
    for t in toks:
        v = {x: (1 + math.log(t.count(x))) * (math.log((1 + n) / (1 + df[x])) + 1) for x in set(t)}
        s = math.sqrt(sum(a * a for a in v.values()))
        vec.append({x: a / s for x, a in v.items()})
    return {(i, j): sum(a * vec[j].get(x, 0) for x, a in vec[i].items()) for i, j in itertools.combinations(range(n), 2)}


def test_similarity_is_exact(spark):
    rng = random.Random(5)
    words = "pay bank card free win code call now link today open desk road train river lamp".split()
    texts = [" ".join(rng.choices(words, k=8)) for _ in range(40)]
    texts += [" ".join(t.split()[:7] + ["extra"]) for t in texts[:15]] + [texts[0]] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {p for p, s in _cosine(texts).items() if s >= 0.8}
    got = {(r["i"], r["j"]) for r in similarity.similar_pairs(df, "id", "text", 0.8).collect()}
    assert got == want and len(want) > 10
    assert similarity.similar_pairs(df.limit(0), "id", "text", 0.8).count() == 0


def test_clusters_and_sensitivity(spark):
    t = "your account will be closed unless you confirm the details at the branch"
    rows = [(i, f"{t} {w}", "scam", "s", i != 2) for i, w in enumerate(["today", "now", "soon", "later"])] + [(9, "lunch at noon with the team", "safe", "s", False)]
    df = spark.createDataFrame(rows, COLS)
    pairs = similarity.similar_pairs(df, "pos", "text", 0.6)
    kept = {r["pos"] for r in similarity.remove_near_duplicates(df, pairs).collect()}
    assert kept == {2, 9}
    s = {r["threshold"]: r["removed"] for r in similarity.sensitivity(pairs, (0.6, 0.99)).collect()}
    assert s[0.6] == 3 and s[0.99] == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_split_sizes(spark):
    rows = [(i, "t", "scam" if i % 3 == 0 else "safe", f"s{i % 4}", i % 10 == 0) for i in range(400)]
    df = splits.stratified_split(splits.strata(spark.createDataFrame(rows, COLS)))
    n = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert n == {"test": 60, "val": 60, "train": 280}
    assert df.where("split = 'test' and is_synthetic").count() == 0


def test_metrics_known_answers(spark):
    y = [1, 1, 1, 1, 0, 0, 0, 0, 0, 0]
    s = [0.9, 0.8, 0.6, 0.3, 0.7, 0.4, 0.3, 0.2, 0.1, 0.05]
    df = spark.createDataFrame([(a, b) for a, b in zip(y, s)], "y int, score double")
    c = metrics.confusion(df, 0.5).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (3, 1, 1, 5)
    pairs = [(a, b) for a, x in zip(s, y) if x for b, z in zip(s, y) if not z]
    assert abs(metrics.roc_auc(df).first()[0] - sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)) < 1e-12
    one = df.where("y = 0")
    assert metrics.roc_auc(one).first()[0] is None and metrics.confusion(one).first()["f1"] is None
    assert metrics.best_f1_threshold(one).first()["threshold"] == 0.0


def test_url_signals(spark):
    urls = ["https://www.sbi.co.in/login2", "http://192.168.0.1/x", "https://sbi-secure.example.xyz/verify", "https://bit.ly/abc", "http://hdfcbank.com.evil.top/a", "https://amazom.com", "https://xn--pple-43d.com", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "n int, url string")
    r = {x["n"]: x for x in ur.score_urls(df).collect()}
    assert r[0]["score"] == 0.0 and r[7]["score"] == 0.0 and r[7]["reasons"] == []
    text = {k: " | ".join(v["reasons"]) for k, v in r.items()}
    assert "raw IP" in text[1] and 'brand name "sbi"' in text[2] and "keyword" in text[2] and "shortener" in text[3]
    assert "subdomain of a different site" in text[4] and "resembles" in text[5] and "punycode" in text[6]
    bands = spark.createDataFrame([(0.29,), (0.3,), (0.59,), (0.6,)], "s double").select(ur.risk_band(F.col("s"))).collect()
    assert [b[0] for b in bands] == ["low", "medium", "medium", "high"]


def test_retrieval(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "vec_id long, embedding array<float>")
    e = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 1.0])], "entry_id long, embedding array<float>")
    got = [(r["rank"], r["entry_id"]) for r in retrieval.nearest(q, e, 2).where("vec_id = 1").orderBy("rank").collect()]
    assert got == [(1, 10), (2, 11)]
    assert retrieval.nearest(q, e.limit(0), 2).count() == 0


def test_rate_limiter(spark):
    ok, _, t = stateful.decide([], 0, 2, 10)
    ok2, _, t = stateful.decide(t, 0, 2, 10)
    no, wait, t = stateful.decide(t, 0, 2, 10)
    assert ok and ok2 and not no and wait == 10
    assert stateful.decide(t, 4, 2, 10)[:2] == (False, 6) and stateful.decide(t, 4, 0, 10)[0]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "2024-01-01 00:00:00", 7, "view", 1.0), (2, "2024-01-01 00:00:10", 7, "view", 1.0), (3, "2024-01-01 00:00:20", 7, "view", 1.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(str(src))
    q = stateful.rate_limit_stream(stream, 2, evict=False).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {r["event_id"]: r["accepted"] for r in spark.table("limited").collect()} == {1: True, 2: True, 3: False}
    batch = stateful.rate_limit(spark.read.parquet(str(src)), 2)
    assert {r["event_id"]: r["accepted"] for r in batch.collect()} == {1: True, 2: True, 3: False}
    q = stateful.upsert_stream(stream, str(tmp_path / "out"), "user_id", "ts", str(tmp_path / "cp"), once=True)
    assert q.awaitTermination(60)
    assert [r["event_id"] for r in spark.read.parquet(str(tmp_path / "out" / "v0")).collect()] == [3]


def test_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('ham\thello "you\tthere\nspam\twin\nodd\tx\nham\t \n')
    assert [(r["text"], r["label"]) for r in readers.read_label_tsv(spark, str(tmp_path / "a.tsv")).collect()] == [('hello "you\tthere', "safe"), ("win", "scam")]
    (tmp_path / "b.json").write_text('[{"text": "a", "label": 1}, {"text": " ", "label": 0}, {"text": "b", "label": 2}]')
    assert [(r["text"], r["label"]) for r in readers.read_label_json(spark, str(tmp_path / "b.json")).collect()] == [("a", "scam")]
    (tmp_path / "c.jsonl").write_text('{"key": "k", "messages": ["m"]}\n{"key": "broken\n\n')
    assert readers.read_batches(spark, str(tmp_path / "c.jsonl")).count() == 1 and readers.damaged_lines(spark, str(tmp_path / "c.jsonl")) == 1
    (tmp_path / "d.csv").write_text("﻿text,label\n\"a,b\",\n")
    assert readers.read_strings_csv(spark, str(tmp_path / "d.csv")).first().asDict() == {"text": "a,b", "label": ""}
    assert readers.read_blocklist_csv(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "kb.json").write_text('{"schema_version": 1, "entries": [{"id": "a", "name": "A", "typical_phrases": ["x"]}]}')
    assert readers.read_knowledge_base(spark, str(tmp_path / "kb.json")).first()["typical_phrases"] == ["x"]


def test_sinks(spark):
    a = spark.createDataFrame([("k", 1, "old"), ("m", 1, "m")], "key string, ts int, v string")
    b = spark.createDataFrame([("k", 1, "new"), ("n", 0, "n")], "key string, ts int, v string")
    assert {r["key"]: r["v"] for r in sinks.upsert(a, b, "key", "ts").collect()} == {"k": "new", "m": "m", "n": "n"}


def test_catalogue_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def _written(spark):
    return {n.rsplit("-", 1)[0] + n[-8:] for n in session.list_names(spark, session.shared_dir(spark) + "/msgsieve") if n.startswith(("terms-", "vectors-"))}


def _brute(rows, threshold):
    """Pairs by the cosine of all vectors; rows of one identifier are one document."""
    tf = {}
    for doc, text in rows:
        w = [x for x in text.split() if len(x) > 1]
        tf.setdefault(doc, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df = Counter(t for c in tf.values() for t in c)
    v = {d: {t: (1 + math.log(k)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, k in c.items()} for d, c in tf.items()}
    n = {d: math.sqrt(sum(x * x for x in c.values())) for d, c in v.items()}
    return {(i, j) for i in v for j in v if i < j and sum(x * v[j].get(t, 0.0) for t, x in v[i].items()) >= (threshold - 1e-12) * n[i] * n[j]}


def test_similar_pairs_by_frequent_and_rare_terms(spark):
    """The same pairs whichever terms count as frequent, copies and shared identifiers included; tables go."""
    rng = random.Random(41)
    rows = []
    for g in range(6):
        base = [rng.choice("common words of many texts and some of few".split()) if k % 2 else f"g{g}w{k}" for k in range(24)]
        rows += [(100 * g + i, " ".join(t if rng.random() > 0.08 else f"x{rng.randint(0, 400)}" for t in base)) for i in range(12)]
    rows += [(rows[0][0], "added to the first"), (5000, rows[5][1])]
    want = _brute(rows, 0.8)
    df = spark.createDataFrame(rows, "id long, text string")
    before = _written(spark)
    assert {(r["i"], r["j"]) for r in similarity.similar_pairs(df, "id", "text", 0.8).collect()} >= {p for p in want if rows[0][0] not in p}
    assert _written(spark) == before
    words = similarity.with_bigrams(F.split("text", " "))
    table = session.materialize(similarity.term_table(df, "id", F.filter(words, lambda w: F.length(w) > 1)), "terms")
    got = [{(r["i"], r["j"]) for r in similarity.cosine_pairs(session.materialize(similarity.vectors(table, df.select("id"), 0.8, share, least), "vectors"), 0.8).collect()} for share, least in ((0.0, 1), (0.2, 10), (1.0, 1000))]
    assert len(want) > 50 and got == [want] * 3


def test_candidates_are_bounded(spark):
    """Pairs of one rare term in common and nothing else are no candidates."""
    rows = [(i, " ".join([f"e{a % 40}x{b % 40}" for a, b in ((i, i + 1), (i - 1, i), (i, i + 2), (i - 2, i))] + [f"c{i // 4}x{k}" for k in range(8)])) for i in range(40)]
    vec = similarity.tfidf(spark.createDataFrame(rows, "id long, text string"), "id", F.split("text", " "), 0.8)
    rare = vec.select("doc", F.explode("rare").alias("t"))
    assert rare.alias("a").join(rare.alias("b"), F.expr("a.t = b.t and a.doc < b.doc")).count() == 80
    assert similarity.candidates(vec, 0.8).count() == 0


def test_trimming_leaves_no_tables(spark):
    rows = [(i, f"the very same words of text {'abcdefgh'[i % 8] * 3} again and again", ("train", "val", "test")[i % 3]) for i in range(24)]
    before = _written(spark)
    kept, n = similarity.trim_cross_split(spark.createDataFrame(rows, "pos long, text string, split string"))
    assert n == 16 and {r["split"] for r in kept.collect()} == {"train"} and _written(spark) == before


def test_only_vectors_of_candidates_travel(spark, monkeypatch):
    """Documents without a candidate are not shuffled for the products, nothing is left over, and few buckets change no pair."""
    rows = [(i, f"one of the two copies number {'abcdefghij'[i // 2] * 4}") for i in range(20)] + [(100 + i, " ".join(f"u{i}x{k}" for k in range(12))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string")
    words = F.split("text", " ")
    seen = []
    real = similarity.release
    monkeypatch.setattr(similarity, "release", lambda *t: seen.extend(x.count() for x in t if x.columns == ["i", "j"]) or real(*t))
    want = _brute(rows, 0.9)
    for buckets in (1, 1 << 20):
        monkeypatch.setattr(similarity, "BUCKETS", buckets, raising=False)
        out = similarity.cosine_pairs(similarity.tfidf(df, "id", similarity.with_bigrams(words), 0.9), 0.9)
        assert len(want) == 10 and {(r["i"], r["j"]) for r in out.collect()} == want
    assert seen == [10, 10] and not [n for n in session.list_names(spark, session.shared_dir(spark) + "/msgsieve") if n.startswith("candidates-")]
