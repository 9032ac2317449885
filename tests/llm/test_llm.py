import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgsieve.llm import bitslice, encoding, history, languages, mailparts, mixing, packing, pii, residue, winnow
from msgsieve.llm.crf import Crf

VOCABULARY = [f"w{i}" for i in range(900)]


def corpus(seed=3, groups=6, copies=4, singles=30):
    """Messages of which some are edited copies; (pos, text, split, source, ingest_no)."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [rng.choice(VOCABULARY) for _ in range(40)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(VOCABULARY)
            texts.append(" ".join(t))
    texts += [" ".join(rng.choice(VOCABULARY) for _ in range(40)) for _ in range(singles)]
    texts += [texts[0], texts[0].upper() + " !", "", None, "...", "word " * 3000]
    rng.shuffle(texts)
    return [(i, t, rng.choice(["train", "val", "test", None]), rng.choice(["a", "b", None]), rng.randint(1, 5)) for i, t in enumerate(texts)]


def truth(rows):
    sets = {r[0]: {w.strip(".!").lower() for w in (r[1] or "").split()} - {""} for r in rows}
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) / len(x | y) >= 0.7:
            out.add((a, b))
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "pos long, text string, split string, source string, ingest_no int").withColumn("h", F.lit("clash")).withColumn("words", F.lit(1)).cache()


def test_pairs_against_brute_force(df, rows):
    got = {tuple(r) for r in bitslice.near_duplicate_pairs(df).collect()}
    assert got == truth(rows) and len(got) > 30
    assert bitslice.near_duplicate_pairs(df.limit(0)).count() == 0


def test_classes(df, rows):
    got = {r["pos"]: r for r in bitslice.near_duplicate_classes(df).collect()}
    assert len(got) == len(rows)
    for a, b in truth(rows):
        assert got[a]["class_id"] == got[b]["class_id"]
    lone = [r[0] for r in rows if not r[1]]
    assert all(got[p]["class_id"] == p and got[p]["links"] == 0 for p in lone)


def test_sliced_pairs_drop_nothing():
    rng = np.random.default_rng(1)
    n = 300
    base = rng.integers(1, 2**62, size=60)
    sets = []
    for _ in range(n):
        s = base.copy()
        s[rng.integers(0, 60, size=rng.integers(0, 25))] = rng.integers(1, 2**62)
        sets.append(np.unique(s))
    lens = np.array([len(s) for s in sets])
    sketch = bitslice.odd_sketch(np.concatenate(sets).astype(np.int64), np.concatenate(([0], np.cumsum(lens))))
    i, j = bitslice.sliced_pairs(np.zeros(n, np.int64), np.arange(n), sketch.view(np.int64), lens.astype(np.int32), 0.7)
    found = set(zip(i.tolist(), j.tolist()))
    want = {(a, b) for a, b in itertools.combinations(range(n), 2) if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.7}
    assert want <= found and len(want) > 100


def test_hot_group_of_edited_copies(spark):
    rng = random.Random(9)
    base = [f"h{i}" for i in range(40)]
    rows = []
    for i in range(150):
        t = list(base)
        t[rng.randrange(40)] = f"e{i}"
        rows.append((i, " ".join(t), "train" if i % 2 else "val", 1 + i % 3))
    rows += [(1000 + i, " ".join(rng.choice(VOCABULARY) for _ in range(30)), "train", 1) for i in range(250)]
    d = spark.createDataFrame(rows, "pos long, text string, split string, ingest_no int")
    pairs = bitslice.near_duplicate_pairs(d, hot_rows=64)
    assert pairs.where("pos_b < 1000").count() == 150 * 149 // 2
    assert winnow.split_overlaps(d).count() == 75 * 75
    found = {r["pos"] for r in history.seen_before(d).collect()}
    assert found == {r[0] for r in rows if r[0] < 1000 and r[3] > 1}


def test_splits_and_report(df, rows):
    side = {r[0]: r[2] for r in rows}
    want = {(a, b) for a, b in truth(rows) if {side[a], side[b]} in ({"train", "val"}, {"train", "test"})}
    over = winnow.split_overlaps(df)
    got = over.collect()
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in got} == want
    assert all(0.5 < r["cover_a"] <= 1 and 0.5 < r["cover_b"] <= 1 for r in got)
    rep = winnow.overlap_report(df.where("split <> 'train'"), over)
    assert rep.agg(F.sum("pairs")).first()[0] == len(want)
    assert winnow.split_overlaps(df.limit(0)).count() == 0


def test_history_replay_equals_batches(df, rows):
    ing = {r[0]: r[4] for r in rows}
    want = {b if ing[b] > ing[a] else a for a, b in truth(rows) if ing[a] != ing[b]}
    assert {r["pos"] for r in history.seen_before(df).collect()} == want
    hits = history.check_new_batches(df, df.where("ingest_no = 1"), [2, 3, 4, 5])
    assert {r["pos"] for r in hits.collect()} == want
    assert history.seen_before(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,fixed,chains", [
    ("cafÃ© â‚¬5", "café €5", ["western"]), ("caf√© it‚Äôs", "café it’s", ["mac_roman"]), ("rГ©sumГ© вЂ“", "résumé –", ["cp1251"]), ("ÃƒÂ© naÃƒÂ¯ve", "é naïve", ["western", "western"]),
    ("fa\x92t \x80", "fa’t €", [encoding.SINGLE]), ("Łódź SÃO Größe", "Łódź SÃO Größe", []), ("plain", "plain", []), ("", "", []), (None, None, [])])
def test_encoding(text, fixed, chains):
    damaged, lost, out, undone = encoding.repair(text, np.zeros(len(encoding.CHAINS) + 1))
    assert (out, undone, damaged, lost) == (fixed, chains, bool(chains), False)


def test_encoding_round_trip_and_table(spark):
    rows = [(i, t.encode().decode("cp1252", errors="ignore") if bad else t, s) for i, (t, bad, s) in enumerate([("Größe €5 naïve", True, "a"), ("señor ✓", False, "a"), (None, False, None), ("lost �", False, "b")])]
    got = {r["pos"]: r for r in encoding.repair_encoding(spark.createDataFrame(rows, "pos long, text_raw string, source string")).collect()}
    assert got[0]["restored"] == "Größe €5 naïve" and got[0]["damaged"] and not got[1]["damaged"] and not got[2]["damaged"] and got[3]["lost"]


def test_pii():
    t = "Mr. S. Prarumba, write to a_b [at] post.example or call (+91) 73000-09912. PAN ABCDE1234F. I live at Flat 17B, Oak Residency, 11th Cross, Town 410 098. UTR 97985626, OTP 482913."
    found = {(k, v) for _, _, k, v in pii.find_pii(t)}
    assert found == {("person", "s prarumba"), ("email", "a_b@post.example"), ("phone", "7300009912"), ("id_number", "ABCDE1234F"), ("address", "1711410098")}
    out = pii.redact(t)
    assert "<PERSON>" in out and "97985626" in out and "482913" in out and "73000" not in out
    assert {v for *_, v in pii.find_pii("https://x.example/a?tel=%2B917000008258&email=a%40b.test")} == {"7000008258", "a@b.test"}
    assert pii.find_pii(None) == [] and pii.find_pii("") == [] and pii.redact(None) is None


def test_pii_tables(spark):
    d = spark.createDataFrame([(1, "call 9876543210 or 9876543210", "x", ["http://a.example/?tel=9876543210", None]), (2, None, None, None)], "pos long, text_raw string, text string, urls array<string>")
    assert [tuple(r) for r in pii.find_personal_data(d).collect()] == [(1, "phone", "9876543210", 2)]
    r = {x["pos"]: x for x in pii.redact_messages(d).collect()}
    assert r[1]["urls"] == ["http://a.example/?tel=<PHONE>", None] and r[2]["text"] is None and r[2]["urls"] is None


def test_mail_parts():
    new = "Hi team,\nThe meeting moved to noon."
    mail = f"{new}\n\nRegards,\nA. Person\nT: 123\n\nOn 5 Feb 2026, at 07:52, B Other <b@x.example> wrote:\n> old text\n> more\n\nAfter the quote.\n\n* * *\nThis message and any part are meant only for the addressee."
    text, parts = mailparts.new_part(mail)
    assert text.split() == (new + " After the quote.").split() and parts == ["notice", "quote", "signature"]
    flat = mail.replace("\n", " ")
    assert mailparts.new_part(flat)[1]
    assert mailparts.new_part("-----Original Message-----\nFrom: X\nDate: 1 May 2026\n\nbody")[0] == ""
    assert mailparts.new_part("Thanks to Mum the market is safe. The auditor wrote: keep it dry") == ("Thanks to Mum the market is safe. The auditor wrote: keep it dry", [])
    assert mailparts.new_part(None) == ("", []) and mailparts.new_part("") == ("", [])
    assert mailparts.compression_gain("a b c " * 20, b"") == 0.0


def test_residue(spark):
    cases = {"Dear {{first_name}}, hello": ["field"], "404 Not Found\nThe requested page /x was not found on a.test.": ["error"], "Please enable JavaScript in your browser to view x.": ["script"],
             "Lorem ipsum dolor sit amet consectetur adipiscing elit sed": ["filler"], "A mask <URL> and <OTP> here": [], "Their bulk mail began with Dear {{first_name}}, which told all": [],
             "The page said error 404 when I opened the link, so I rang the desk.": [], "": []}
    for t, k in cases.items():
        assert residue.residue_kinds(t) == k, t
    assert residue.residue_kinds(None) == []
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*cases, None])], "doc_id long, text string, source string")
    assert {r["doc_id"] for r in residue.find_residue(d).where("residue").collect()} == {0, 1, 2, 3}
    assert residue.without_residue(d).count() == len(cases) + 1 - 4


def test_crf_learns_and_labels():
    rng = random.Random(1)
    a, b = ["the", "and", "of", "house", "river", "open"], ["hai", "nahi", "karo", "ghar", "paani", "kholo"]
    rows = [[rng.choice(v) for _ in range(8)] for v in (a, b) for _ in range(60)]
    m = Crf(["en", "hinglish"])
    m.fit([x + y for x, y in zip(rows, reversed(rows))], [np.array([i // 60] * 8 + [1 - i // 60] * 8) for i in range(120)], epochs=3)
    p = m.marginals([["the", "river", "and", "house", "ghar", "nahi", "kholo", "hai"], []])
    assert (p[0].argmax(axis=1) == [0, 0, 0, 0, 1, 1, 1, 1]).all() and len(p[1]) == 0
    assert np.allclose(p[0].sum(axis=1), 1, atol=1e-4)
    assert languages.sentences(None) == [] and languages.sentences("From: a\nHello there, friends of mine.") == [["hello", "there", "friends", "of", "mine"]]


def test_packing(spark):
    rng = np.random.default_rng(4)
    size = rng.integers(1, 500, size=400)
    box = packing.pack(size, size // 2, 512, 32, 512)
    fill = np.bincount(box, weights=size)
    assert (box >= 0).all() and fill.max() <= 512 and fill.sum() / (512 * len(fill)) > 0.95
    tight = packing.pack(size, size, 512, 2, 400 + 100)
    assert np.bincount(tight).max() <= 2 and np.bincount(tight, weights=size).max() <= 500
    docs = [(i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 300, size=60))] + [(60, "big " * 5000), (61, None), (62, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    specs = spark.createDataFrame([(1, 512), (2, 2048)], "spec_id int, capacity_tokens int")
    got = packing.pack_documents(d, specs, shard_boxes=4).toPandas()
    assert got.groupby(["spec_id", "container"]).tokens.sum().le(got.spec_id.map({1: 512, 2: 2048}).groupby([got.spec_id, got.container]).first()).all()
    per = got.groupby(["spec_id", "doc_id"]).tokens.sum().unstack(0)
    assert (per[1] == per[2]).all() and set(got.doc_id) == set(range(61))
    assert (got[got.doc_id != 60].groupby(["spec_id", "doc_id"]).size() == 1).all()


def test_mixing(spark):
    docs = [(i, f"text number {i} " + "word " * (i % 40 + 10), "abc"[i % 3]) for i in range(300)] + [(900, None, "a"), (901, "x", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    plan = spark.createDataFrame([(1, "a", 0.5, 2, 0.4), (1, "b", 0.3, 1, 0.4), (1, "none", 0.2, 3, 0.4), (2, "c", 1.0, 1, 0.9)], "plan_id int, source string, target_share double, max_repeats int, budget_share double")
    draw, shares = mixing.mix_sources(d, plan, block_tokens=64)
    s = {(r["plan_id"], r["source"]): r for r in shares.collect()}
    assert abs(s[1, "a"]["share_of_budget"] - 0.5) < 0.02 and abs(s[1, "b"]["share_of_budget"] - 0.3) < 0.02
    assert s[1, "none"]["drawn_tokens"] == 0 and s[1, "none"]["stopped_short"] and s[2, "c"]["stopped_short"]
    rows = draw.toPandas()
    assert rows.groupby(["plan_id", "doc_id"]).size().max() <= 2 and not rows.duplicated(["plan_id", "doc_id", "use_no"]).any()
    assert rows.groupby(["plan_id", "source"]).tokens.sum().to_dict() == {k: v["drawn_tokens"] for k, v in s.items() if v["drawn_tokens"]}


def edited(rng, base, edits, tag):
    t = list(base)
    for k, at in enumerate(rng.sample(range(len(t)), edits)):
        t[at] = f"{tag}x{k}"
    return " ".join(t)


def crossing(rows):
    """Pairs of a train row and a row elsewhere in ``truth``."""
    side = {r[0]: r[2] for r in rows}
    return {(a, b) if side[a] == "train" else (b, a) for a, b in truth(rows) if "train" in (side[a], side[b]) and side[a] != side[b]}


def test_splits_of_short_and_spread_edits(spark):
    rng = random.Random(21)
    rows = []
    for g in range(60):
        n, edits = [(10, 1), (7, 1), (14, 2), (20, 3), (30, 5)][g % 5]
        base = [f"g{g}w{i}" for i in range(n)]
        rows += [(2 * g, " ".join(base), "train"), (2 * g + 1, edited(rng, base, edits, f"g{g}"), "val")]
    # The same words in another order share no run.
    words = [f"m{i}" for i in range(12)]
    rows += [(500, " ".join(words), "train"), (501, " ".join(words[::-1]), "test")]
    got = {(r["a"], r["b"]) for r in winnow.split_overlaps(spark.createDataFrame(rows, "pos long, text string, split string")).collect()}
    assert got == crossing(rows) and len(got) == 61


def test_splits_of_middling_groups(spark):
    rng = random.Random(22)
    rows = []
    for size in (20, 40, 80):
        base = [f"s{size}w{i}" for i in range(40)]
        rows += [(1000 * size + i, edited(rng, base, rng.randint(2, 4), f"s{size}c{i}"), "train" if i % 2 else "val") for i in range(size)]
    got = {(r["a"], r["b"]) for r in winnow.split_overlaps(spark.createDataFrame(rows, "pos long, text string, split string")).collect()}
    want = crossing(rows)
    assert got == want and len(want) > 1000


def test_added_rare_words_in_a_hot_group(spark):
    rng = random.Random(23)
    base = [f"h{i}" for i in range(20)]
    rows = [(i, " ".join(base + [f"c{i}x{k}" for k in range(rng.choice([5, 6, 7, 8]))]), "train") for i in range(120)]
    rows += [(500, " ".join(base), "train")] + [(1000 + i, " ".join(rng.choice(VOCABULARY) for _ in range(30)), "train") for i in range(240)]
    got = {tuple(r) for r in bitslice.near_duplicate_pairs(spark.createDataFrame(rows, "pos long, text string, split string")).collect()}
    want = truth(rows)
    assert {p for p in want if 500 in p} <= got and len(want) == 120
    assert got == want


def test_history_of_short_texts_and_middling_groups(spark):
    rng = random.Random(24)
    rows = []
    for size in (20, 60):
        base = [f"s{size}w{i}" for i in range(20)]
        rows += [(1000 * size + i, edited(rng, base, 3, f"s{size}c{i}"), 1 + i % 3) for i in range(size)]
        rows.append((1000 * size + 999, " ".join(base), 1))
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(7)]
        rows += [(2 * g, " ".join(base), 1), (2 * g + 1, edited(rng, base, 1, f"g{g}"), 2 + g % 2)]
    ing = {r[0]: r[2] for r in rows}
    want = {max(p, key=ing.get) for p in truth(rows) if ing[p[0]] != ing[p[1]]}
    d = spark.createDataFrame(rows, "pos long, text string, ingest_no int")
    assert {r["pos"] for r in history.seen_before(d).collect()} == want and len(want) > 100
    assert {r["pos"] for r in history.check_new_batches(d, d.where("ingest_no = 1"), [2, 3]).collect()} == want
