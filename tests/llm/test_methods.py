"""Each named method decides: with it switched off, rows are lost."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from msgsieve.llm import crowds, encoding, history, languages, mailparts, mixing, packing, pii, residue, winnow
from msgsieve.llm.crf import Crf
from msgsieve.llm.words import flatten


# ---------------------------------------------------------------- p3: pooled chains
def test_pooled_evidence_settles_equal_signs(spark):
    """The same two characters were an y with an acute in one source and a U with a circumflex in the other."""
    rows = []
    for source, charset in (("a", "cp850"), ("b", "cp437")):
        rows += [(len(rows) + i, f"price © {i} ® of the day".encode().decode(charset), source) for i in range(30)]
        rows += [(len(rows) + i, "nothing wrong here", source) for i in range(30)]
        rows.append((1000 + ord(source), "├¢", source))
    got = {r["pos"]: r["restored"] for r in encoding.repair_encoding(spark.createDataFrame(rows, "pos long, text_raw string, source string")).collect()}
    assert got[1000 + ord("a")] == "ý" and got[1000 + ord("b")] == "Û"
    even = np.zeros(len(encoding.CHAINS) + 1)
    assert encoding.repair("├¢", even)[2] == encoding.repair("├¢", even)[2] and len({encoding.repair("├¢", even)[2]} & {"ý", "Û"}) == 1
    assert got[0].startswith("price © 0 ®")


# ---------------------------------------------------------------- p5: one automaton
def test_anchors_come_from_one_automaton(monkeypatch):
    t = "From: Zoya Kapadia <zoya&#64;my-firm.example>\nDear Mr. Walter Gruber, write to anna at my-firm dot com or ask at https://x.example/a?email=b%40c.test, account no 123456789012, 17 Rose Street, Milton 410 098"
    want = {("email", "zoya@my-firm.example"), ("person", "zoya kapadia"), ("person", "walter gruber"), ("email", "anna@my-firm.com"), ("email", "b@c.test"), ("id_number", "123456789012"), ("address", "17410098")}
    assert {(k, v) for *_, k, v in pii.find_pii(t)} == want
    kinds = [k for k, found in enumerate(pii.find_anchors(t)) if found]
    assert {pii.AT, pii.SPOKEN, pii.SCHEME, pii.CUE, pii.STREET, pii.TITLE, pii.HEAD} <= set(kinds)
    monkeypatch.setattr(pii, "find_anchors", lambda text: [[] for _ in pii._ANCHORS])
    assert pii.find_pii(t) == []


def test_names_after_titles_are_no_offices():
    assert pii.find_pii("Dear Mr. Customer Support, from: Accounts Desk\nto: Final Notice") == []
    assert pii.find_pii("A long text " * 5000 + "x" * 200 + "@post.example")[0][3] == "x" * 200 + "@post.example"


# ---------------------------------------------------------------- p7: compression
def _mail(rng, i):
    body = " ".join(f"w{rng.randrange(4000)}" for _ in range(20)) + "."
    return f"{body}\n\nNobody but the named reader may keep item{i} of this note, and any copy of it must be burned.", body


def test_closings_are_learned_by_compression(spark):
    rng = random.Random(5)
    mails = [_mail(rng, i) for i in range(60)]
    d = spark.createDataFrame([(i, t, "mail_a", f"s{i % 7}") for i, (t, _) in enumerate(mails)], "pos long, text string, source string, sender string")
    got = {r["pos"]: r for r in mailparts.reduce_mails(d).collect()}
    assert all(got[i]["parts"] == ["notice"] and got[i]["new_text"] == body for i, (_, body) in enumerate(mails))
    # Without the learned phrases none of them is found.
    assert mailparts.new_part(mails[0][0])[1] == []
    phrases = mailparts.closing_phrases(d, "text")
    assert "any copy of" in phrases and not any(p.startswith("w1") for p in phrases)
    c = mailparts.Closings(phrases)
    assert c.flags(mails[0][0].split("\n\n")[1]) and not c.flags(mails[0][1])


def test_copies_make_no_closing(spark):
    text = "The shipment left the harbour early and nobody told the people waiting there about it."
    d = spark.createDataFrame([(i, text, "mail_a", "s") for i in range(200)], "pos long, text string, source string, sender string")
    assert mailparts.closing_phrases(d, "text") == []
    assert all(r["parts"] == [] for r in mailparts.reduce_mails(d).collect())


def test_sender_lines_close_without_a_form():
    lines = b"Keeper of the northern archive, second floor, open every day but Monday morning"
    mail = "The books arrived today and are on the shelf.\nKeeper of the northern archive, second floor, open every day but Monday morning"
    assert mailparts.new_part(mail, None, lines) == ("The books arrived today and are on the shelf.", ["signature"])
    assert mailparts.new_part(mail)[1] == []


# ---------------------------------------------------------------- p10: slug, title, body and hosts
def test_mismatch_and_hosts_decide(spark):
    page = "The browser at {} sent an invalid request and the session is blocked. Please reload ({})."
    docs = [page.format(f"www.site{i}.test", 1000 + i) for i in range(5)]
    weak = ["Server amber page."] * 3
    told = ["My browser said that the server denied access, so I rang them about the session."]
    long = ["A report on gardens. " * 400 + "\n\n" + docs[0]]
    d = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(docs + weak + told + long)], "doc_id long, text string, source string")
    assert all(residue.residue_kinds(t) == [] for t in docs + weak + told + long)
    got = {r["doc_id"]: r for r in residue.find_residue(d).collect()}
    assert all(got[i]["residue"] and got[i]["hosts"] >= 5 for i in range(5))
    assert not got[8]["residue"] and got[9]["residue"]
    alone = residue.find_residue(d.where("doc_id = 5")).first()
    assert got[5]["residue"] and not alone["residue"]  # three hosts give what one does not


@pytest.mark.parametrize("text", ["The requested page does not exist", "Please enable cookies", "404 error: not found", "Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua",
                                  "vestibulum morbi praesent mauris pellentesque semper", "test test test test", "bla bla bla bla", "aaa aaa aaa aaa", "jkl sdf fgh hjk"])
def test_no_prefilter_hides_a_form(text):
    assert residue.residue_kinds(text)


# ---------------------------------------------------------------- p6: bucketed history
def test_answer_does_not_depend_on_files(spark, tmp_path):
    """A text that comes again later must not stand as a later first coming."""
    a = " ".join(f"w{i}" for i in range(20))
    b = a.replace("w3", "x3")
    rows = [(0, a, 3), (1, b, 5), (2, a, 9), (3, "else " + " ".join(f"q{i}" for i in range(20)), 1)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "pos long, text string, ingest_no int").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    got = history.seen_before(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert {(r["pos"], r["full"]) for r in got} == {(1, False), (2, True)}


def test_crowds_in_blocks_keep_every_match(spark):
    rng = random.Random(31)
    base = [f"c{i}" for i in range(24)]
    rows = []
    for i in range(240):
        t = list(base)
        for k in rng.sample(range(24), 2):
            t[k] = f"e{i}x{k}"
        rows.append((i, " ".join(t), 1 if i < 160 else 2 + i % 2))
    d = spark.createDataFrame(rows, "pos long, text string, ingest_no int")
    sets = {r[0]: set(r[1].split()) for r in rows}
    ing = {r[0]: r[2] for r in rows}
    want = {p for p in sets if any(ing[q] < ing[p] and len(sets[p] & sets[q]) / len(sets[p] | sets[q]) >= 0.7 for q in sets)}
    got = {r["pos"] for r in history.seen_before(d, share=0.0, least=40, block=16).collect()}
    assert got == want and len(want) >= 70
    assert history.loads({1: 100, 2: 5, 3: 5, 4: 20, 5: 1}) == [[1], [2, 3, 4], [5]]


def test_history_joins_in_its_buckets(spark):
    d = spark.createDataFrame([(i, f"some words of text number {i} and more of them", 1 + i % 3) for i in range(60)], "pos long, text string, ingest_no int")
    h = history.AcceptedHistory(spark, buckets=4)
    batch = history.prepare(d.where("ingest_no = 1"))
    h.take(batch)
    keys = h.table("paragraphs").limit(5).select("key").withColumnRenamed("key", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = h.table("paragraphs").join(keys.hint("merge"), F.col("key") == F.col("k"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan
    h.drop()


# ---------------------------------------------------------------- p4: winnowing
def test_winnowing_guarantee():
    """Any run of ten words two texts share leaves a common fingerprint."""
    rng = random.Random(2)
    for _ in range(50):
        shared = [rng.randrange(1, 1 << 60) for _ in range(10)]
        texts = [[rng.randrange(1, 1 << 60) for _ in range(rng.randrange(0, 60))] + shared + [rng.randrange(1, 1 << 60) for _ in range(rng.randrange(0, 60))] for _ in range(2)]
        flat = np.array(sum(texts, []), dtype=np.int64)
        row, _, key = winnow.fingerprints(flat, np.array([0, len(texts[0]), len(flat)]))
        assert set(key[row == 0]) & set(key[row == 1])


# ---------------------------------------------------------------- p2: stretches
def test_stretches_cover_every_word():
    m = Crf(["en", "es"])
    m.w[:] = 0
    p = np.array([[0.9, 0.1]] * 5 + [[0.2, 0.8]] * 4 + [[0.9, 0.1]] + [[0.1, 0.9]] * 3)
    got = languages._stretches(m.labels, p)
    assert [(t, a, n) for t, _, a, n in got] == [("en", 0, 5), ("es", 5, 8)] and sum(n for *_, n in got) == len(p)
    assert languages._stretches(m.labels, p[:0]) == []


# ---------------------------------------------------------------- p8: limits that bind; p9: gaps
def test_every_limit_holds_and_binds():
    rng = np.random.default_rng(7)
    size = rng.integers(20, 300, size=600)
    loss = (size * rng.uniform(0.1, 1.0, size=600)).astype(np.int64)
    loss[0], size[0] = 450, 500
    box = packing.pack(size, loss, 512, 5, 330)
    n, t, l = np.bincount(box), np.bincount(box, weights=size), np.bincount(box, weights=loss)
    assert t.max() <= 512 and n.max() <= 5 and (box == box[0]).sum() == 1
    assert np.delete(l, box[0]).max() <= 330 and (l >= 0.95 * 330).sum() > 20 and (n == 5).sum() > 5
    # Of two items of a size the one with less loss is found where the other does not fit.
    assert packing.pack(np.array([100, 100, 100, 100]), np.array([90, 10, 90, 10]), 200, 9, 100).tolist().count(0) == 2
    assert len(set(packing.pack(np.array([100, 100, 100, 100]), np.array([90, 10, 90, 10]), 200, 9, 100).tolist())) == 2


def test_gaps_are_filled_with_what_fits(spark):
    docs = [(i, "word " * 400, "a") for i in range(20)] + [(100 + i, "word " * (i + 1), "a") for i in range(60)] + [(500, "word " * 4000, "b")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    plan = spark.createDataFrame([(1, "a", 1.0, 1, 0.3)], "plan_id int, source string, target_share double, max_repeats int, budget_share double")
    s = mixing.mix_sources(d, plan)[1].first()
    assert s["drawn_tokens"] <= s["target_tokens"] < s["drawn_tokens"] + 5


def test_stock_phrases_lose_no_pair(spark):
    """Texts near the threshold that meet only under crowded fingerprints are all found, short and long ones."""
    rng = random.Random(31)
    rows = []
    for g, size in ((0, 24), (1, 60), (2, 200)):
        base = [f"g{g}w{i}" for i in range(size)]
        for i in range(60):
            t = list(base)
            for at in rng.sample(range(6, size), max(1, int(size * 0.085))):
                t[at] = f"g{g}x{i}y{at}"
            rows.append((1000 * g + i, " ".join(t), "train" if i % 2 else "val"))
    sets = {r[0]: set(r[1].split()) for r in rows}
    want = {(a[0], b[0]) for a in rows for b in rows if a[2] == "train" and b[2] == "val" and len(sets[a[0]] & sets[b[0]]) / len(sets[a[0]] | sets[b[0]]) >= 0.7 - 1e-12}
    df = spark.createDataFrame(rows, "pos long, text string, split string")
    hot, cold = ({(r["a"], r["b"]): (r["seeds"], round(r["cover_a"], 9)) for r in winnow.split_overlaps(df, share=0.0, least=least).collect()} for least in (2, 1 << 30))
    assert set(hot) == want and hot == cold


def test_crowds_in_cells_and_tiles(spark, monkeypatch):
    """A crowd in several cells, and tiles smaller than it, give the pairs of the whole."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, (3, 300))
    sets = [np.unique(np.concatenate([base[i % 3][: 40 * (i % 7 + 1)], rng.integers(0, 1 << 40, 5)])) for i in range(90)]
    flat, offsets, n = flatten(sets)
    sk = crowds.wide_sketches(flat, offsets)
    h, key = np.arange(90) + 7, np.full(90, 11)
    want = {(int(h[a]), int(h[b])) for a in range(0, 90, 2) for b in range(1, 90, 2) if len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.7}
    objects = np.array(sk, dtype=object)
    p, q = crowds.close_pairs(n[::2], objects[::2], n[1::2], objects[1::2], 0.7, (4, 8))
    assert want and want <= set(zip(h[::2][p].tolist(), h[1::2][q].tolist()))
    monkeypatch.setattr(crowds, "CELL", 20)
    cells = pd.concat([crowds.hot_rows(key[s::2], h[s::2], n[s::2], s, sk[s::2], (np.array([11]), np.array([90]))) for s in (0, 1)]).sort_values("key")
    got = pd.concat(list(crowds._meet(0.7)(cells.iloc[i : i + 7] for i in range(0, len(cells), 7))))
    assert cells["key"].nunique() == 25 and want <= set(zip(got["ha"].tolist(), got["hb"].tolist())) and not got.duplicated().any()


def test_every_line_of_a_sender_counts(spark):
    """Senders of more repeated lines than one window holds: their rarest line still tells a signature from new text."""
    def line(s, k):
        return " ".join(f"s{s}{chr(97 + k % 26)}{(s * 7919 + k * 104729 + j * 1299709) % 99991:05d}" for j in range(24))

    rows = []
    for s in range(3):
        for k in range(200):
            rows += [(len(rows) + i, f"news of {s} {k} {i}\n\n-- \nDesk\n{line(s, k)}", "mail", f"sender{s}") for i in range(3 + (k > 0))]
    probes = {10_000 + s: f"Something entirely new this time\n{line(s, 0)}" for s in range(3)}
    df = spark.createDataFrame(rows + [(k, t, "mail", f"sender{k - 10_000}") for k, t in probes.items()] + [(20_000, line(1, 0), "mail", None)], "pos long, text string, source string, sender string")
    lines = mailparts.sender_closings(df, "text", "sender").collect()
    assert {r["sender"]: sum(len(p.split("\n")) for p in r["pieces"]) for r in lines} == {f"sender{s}": 200 for s in range(3)}
    assert all(len(r["pieces"]) > 1 and max(len(p.encode()) for p in r["pieces"]) <= 16_384 for r in lines)
    pieces = {r["sender"]: [p.encode() for p in r["pieces"]] for r in lines}
    for k, t in probes.items():
        assert mailparts.new_part(t, None, pieces[f"sender{k - 10_000}"]) == ("Something entirely new this time", ["signature"])
        assert mailparts.new_part(t, None, pieces[f"sender{(k + 1) % 3}"]) == (t, [])
    assert mailparts.reduce_mails(df).count() == len(rows) + 4


def test_history_under_a_stock_phrase(spark):
    """Texts of many ingests that share nothing but one stock phrase in one piece: every near copy is found."""
    rng = random.Random(12)
    phrase = "please reply to this message at once".split()
    rows = [(i, " ".join(phrase + [f"f{i}x{k}" for k in range(12)]), 1) for i in range(120)]
    for i in range(60):
        # The same words in another order: no paragraph but the stock phrase is shared.
        own = [f"g{i}x{k}" for k in range(30)]
        rows.append((1000 + i, " ".join(phrase + own), 1))
        other = own[:26] + [f"e{i}x{k}" for k in range(4)]
        rng.shuffle(other)
        rows.append((2000 + i, " ".join(phrase + other), 2 + i % 2))
    d = spark.createDataFrame(rows, "pos long, text string, ingest_no int")
    got = {r["pos"]: r for r in history.seen_before(d, share=0.0, least=40).collect()}
    assert set(got) == {2000 + i for i in range(60)}
    assert all(abs(r["similarity"] - 33 / 41) < 1e-12 and 0 < r["coverage"] < 0.5 for r in got.values())
