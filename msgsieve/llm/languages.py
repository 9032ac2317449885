"""Language of documents and of the stretches of mixed ones (problem 2).

A linear-chain conditional random field labels every word with a language tag;
it is trained on a bounded sample of the rows whose label names a tag, after a
first pass has put aside the rows whose own words speak against their label.
Word marginals from forward-backward are summed over sentences; runs of
sentences with one language are the segments, each with its mean marginal as
confidence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import encoding
from .crf import LEXICON_OF, Crf, script

#: Scripts a tag may be written in.
SCRIPTS = {"en": "latin", "es": "latin", "hinglish": "latin", "hi": "deva", "mr": "deva", "bn": "beng", "ta": "taml"}
_DROP = re.compile(r"https?://\S+|www\.\S+|\S+@\S+|\S*%40\S*|<[A-Z_]+>|\S+\s?(?:\[at\]|\(at\))\s?\S+|(?:[\w-]+\.)+(?:example|test|invalid|com|org|net|in|es)\b\S*|[+(]?\d[\d\s().,/:-]*", re.I)
_HEADER = re.compile(
    r"^[>|\s]*(?:(?:from|to|cc|sent|date|subject|de|para|enviado|fecha|asunto|von|an|gesendet|betreff|प्रेषक|प्रति|विषय|दिनांक)\s*:|-{2,}|_{3,}|={3,}|~{3,}|\* \* \*|begin forwarded|on .{5,90}wrote\s*:|el .{5,90}escribió\s*:"
    r"|in reply to .{3,90}:$|.{3,90}\bwrote on\b.{3,20}:$|.{3,90}(?:ne likha|ने लिखा)\s*:$|\d{4}-\d\d-\d\d \d\d:\d\d gmt)",
    re.I,
)
_SENTENCE = re.compile(r"(?<=[.!?।])\s+|\s+/\s+|\n+")
_MARKED = re.compile(r"[ऀ-ॿ]+|[ঀ-৿]+|[஀-௿]+|[^\W\d_ऀ-௿]+(?:[’'][^\W\d_]+)*")


def sentences(text: str | None) -> list[list[str]]:
    """Words of every sentence in lower case; links, masks, numbers and mail headers left out.

    Names go too where they can be told: capitalised Latin words inside a sentence.
    """
    if not text:
        return []
    out = []
    for s in _SENTENCE.split(text):
        if not s or _HEADER.match(s):
            continue
        words = _MARKED.findall(_DROP.sub(" ", s))
        shout = sum(w.isupper() for w in words if len(w) > 1) > 0.6 * max(1, len(words))
        out.append([w.lower() for i, w in enumerate(words) if shout or i == 0 or not (w[0].isupper() and script(w.lower() or "x") == "latin")])
    return [s for s in out if s]


def readable(text: str | None, raw: str | None, prior: np.ndarray) -> str | None:
    """The text, or the repaired raw text where characters were damaged."""
    if raw and encoding._SUSPECT.search(raw):
        damaged, _, fixed, _ = encoding.repair(raw, prior)
        if damaged:
            return fixed
    return text


_EVEN = np.zeros(len(encoding.CHAINS) + 1)
_EVEN[0] = -1.0


def _agreeing(rows: list[list[str]], tag_of: list[int], labels: list[str], folds: int = 3) -> tuple[list[list[str]], list[int]]:
    """Training sentences whose words don't speak against their row's label.

    First script and lexicon judge, then models of the other folds, so that
    no model judges a sentence it was trained on.
    """
    keep = []
    for i, (s, t) in enumerate(zip(rows, tag_of)):
        kinds = [script(w) for w in s]
        if labels[t] in SCRIPTS and kinds.count(SCRIPTS[labels[t]]) * 2 < len(s):
            continue
        votes: dict[str, int] = {}
        for w in s:
            if w in LEXICON_OF:
                votes[LEXICON_OF[w]] = votes.get(LEXICON_OF[w], 0) + 1
        if votes and max(votes.values()) >= votes.get(labels[t], 0) + 2:
            continue
        keep.append(i)
    for _ in range(2):
        fold = [zlib.crc32(" ".join(rows[i]).encode()) % folds for i in keep]
        good = []
        for f in range(folds):
            train = [i for i, g in zip(keep, fold) if g != f]
            rest = [i for i, g in zip(keep, fold) if g == f]
            if not train or not rest:
                good += rest
                continue
            model = Crf(labels)
            model.fit([rows[i] for i in train], [np.full(len(rows[i]), tag_of[i]) for i in train], epochs=1)
            best = [int(m.sum(axis=0).argmax()) for m in model.marginals([rows[i] for i in rest])]
            good += [i for i, b in zip(rest, best) if b == tag_of[i]]
        keep = sorted(good)
    return [rows[i] for i in keep], [tag_of[i] for i in keep]


def fit_language_model(df: DataFrame, tags: DataFrame, ident: str, text: str, language: str, raw: str | None, per_tag: int = 500, seed: str = "crf") -> Crf:
    """The model, from at most ``per_tag`` rows of every tag, in the order of a hash of the identifier.

    ``tags`` maps ``alias`` to ``tag``. Only this sample is bounded; everything
    else in this module covers all rows.
    """
    known = df.join(F.broadcast(tags.where("tag is not null").select(F.col("alias").alias(language), "tag")), language)
    names = [text] + ([raw] if raw else [])
    # The smallest hashes of a tag: partial top-n lists are merged, no tag is gathered in one task.
    order = F.xxhash64(F.col(ident).cast("string"), F.lit(seed))
    parts = []
    for tag in sorted(r[0] for r in tags.where("tag is not null").select("tag").distinct().collect()):
        parts.append(known.where(F.col("tag") == tag).select("tag", order.alias("o"), *names).orderBy("o").limit(per_tag))
    if not parts:
        return Crf([])
    sample = parts[0]
    for p in parts[1:]:
        sample = sample.unionByName(p)
    pdf = sample.toPandas().sort_values(["tag", "o"])
    labels = sorted(pdf["tag"].unique())
    number = {t: i for i, t in enumerate(labels)}
    rows, tag_of = [], []
    for r in pdf.itertuples(index=False):
        good = readable(getattr(r, text), getattr(r, raw) if raw else None, _EVEN)
        for s in sentences(good):
            if len(s) >= 3:
                rows.append(s)
                tag_of.append(number[r.tag])
    if not rows:
        return Crf(labels)
    rows, tag_of = _agreeing(rows, tag_of, labels)
    if not rows:
        return Crf(labels)
    # Pairs of sentences teach the transitions between languages.
    rng = np.random.default_rng(11)
    mates = rng.integers(0, len(rows), size=len(rows))
    mixed = [rows[i] + rows[j] for i, j in enumerate(mates)]
    gold = [np.array([tag_of[i]] * len(rows[i]) + [tag_of[j]] * len(rows[j])) for i, j in enumerate(mates)]
    final = Crf(labels)
    final.fit(mixed, gold, epochs=4)
    return final


def _stretches(labels: list[str], m: np.ndarray, least: int = 3) -> list[tuple[str, float, int, int]]:
    """(tag, confidence, first word, words) over all words of a text, switches inside sentences included.

    Runs of one best tag; a run of fewer than ``least`` words, such as a name or a loan word, belongs to its neighbour.
    """
    if not len(m):
        return []
    best = m.argmax(axis=1)
    cut = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    size = np.diff(np.append(cut, len(best)))
    runs: list[list[int]] = []
    for at, n in zip(cut.tolist(), size.tolist()):
        tag = int(best[at])
        if runs and (runs[-1][0] == tag or n < least):
            runs[-1][2] += n
        elif runs and len(runs) == 1 and runs[0][2] < least:
            runs[0] = [tag, 0, runs[0][2] + n]
        else:
            runs.append([tag, at, n])
    return [(labels[t], float(m[a : a + n, t].mean()), a, n) for t, a, n in runs]


def label_texts(model: Crf, texts: list[str | None], least_words: int = 4, least_share: float = 0.6) -> list[tuple[list[tuple[str, float, int, int]], list[tuple[str, float, int, int]]]]:
    """(segments, stretches) of every text, in order.

    Segments (tag, confidence, words, sentences) are of whole sentences that are of one language: a sentence counts with
    ``least_words`` words or more and if its best tag has ``least_share`` of the marginals. Stretches (see ``_stretches``)
    cover every word.
    """
    if not model.labels:
        return [([], []) for _ in texts]
    cut = [sentences(t) for t in texts]
    margins = model.marginals([[w for s in c for w in s] for c in cut])
    out = []
    for c, m in zip(cut, margins):
        segments: list[list] = []
        at = 0
        spare = np.zeros(len(model.labels))
        total_spare = 0
        for s in c:
            p = m[at : at + len(s)].sum(axis=0)
            at += len(s)
            best = int(p.argmax())
            share = float(p[best] / max(p.sum(), 1e-9))
            if len(s) < least_words or share < least_share:
                spare += p
                total_spare += len(s)
                continue
            tag = model.labels[best]
            if segments and segments[-1][0] == tag:
                segments[-1][1] += float(p[best])
                segments[-1][2] += len(s)
                segments[-1][3] += 1
            else:
                segments.append([tag, float(p[best]), len(s), 1])
        if not segments and total_spare:
            best = int(spare.argmax())
            segments = [[model.labels[best], float(spare[best]), total_spare, 1]]
        out.append(([(t, min(1.0, v / max(n, 1)), n, k) for t, v, n, k in segments], _stretches(model.labels, m)))
    return out


def label_languages(df: DataFrame, tags: DataFrame, ident: str = "pos", text: str = "text", language: str = "language", raw: str | None = "text_raw", per_tag: int = 500) -> DataFrame:
    """(ident, given, main, confidence, segments, stretches): one row per row of ``df``.

    ``given`` is the tag of the row's label, null if it has none; ``main`` the
    tag with the most words, null for texts without words; ``segments`` an
    array of (tag, confidence, words, sentences) in order, ``stretches`` one of (tag, confidence, first,
    words) that covers every word of the text.
    """
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(fit_language_model(df, tags, ident, text, language, raw, per_tag))
    seg = "array<struct<tag:string,confidence:double,words:int,sentences:int>>"
    runs = "array<struct<tag:string,confidence:double,first:int,words:int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = model.value
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                raws = part["raw"] if raw else [None] * len(part)
                found = label_texts(crf, [readable(t, r, _EVEN) for t, r in zip(part["text"], raws)])
                main, conf, segs, stretches = [], [], [], []
                for s, whole in found:
                    words: dict[str, int] = {}
                    for t, _, n, _ in s:
                        words[t] = words.get(t, 0) + n
                    best = max(words, key=lambda t: (words[t], t)) if words else None
                    main.append(best)
                    conf.append(float(sum(c * n for t, c, n, _ in s if t == best) / words[best]) if best else None)
                    segs.append([{"tag": t, "confidence": c, "words": n, "sentences": k} for t, c, n, k in s])
                    stretches.append([{"tag": t, "confidence": c, "first": a, "words": n} for t, c, a, n in whole])
                yield pd.DataFrame({ident: part["ident"].to_numpy(), "given": part["given"].to_numpy(), "main": main, "confidence": conf, "segments": segs, "stretches": stretches})

    kind = dict(df.dtypes)[ident]
    named = tags.where("tag is not null").select(F.col("alias").alias("__alias"), F.col("tag").alias("given"))
    rows = df.join(F.broadcast(named), F.col(language) == F.col("__alias"), "left")
    cols = [F.col(ident).alias("ident"), F.col(text).alias("text"), "given"] + ([F.col(raw).alias("raw")] if raw else [])
    return rows.select(*cols).mapInPandas(run, f"{ident} {kind}, given string, main string, confidence double, segments {seg}, stretches {runs}")


def language_cases(labelled: DataFrame, ident: str = "pos") -> DataFrame:
    """(ident, lang): the languages of every row whose label is missing, unknown or wrong, or that mixes languages."""
    held = F.array_distinct(F.transform("segments", lambda s: s["tag"]))
    rows = labelled.select(ident, "given", "main", held.alias("held")).where(F.size("held") > 0)
    case = F.col("given").isNull() | (F.col("given") != F.col("main")) | (F.size("held") > 1)
    return rows.where(case).select(ident, F.explode("held").alias("lang"))
