"""Repair of text decoded with the wrong character encoding (problem 3).

A record's latent state is the chain that damaged it: UTF-8 bytes read as some
single-byte charset, once or more, or Windows-1252 bytes read as Latin-1. Under
every charset a record yields evidence: how many runs of its characters are
exactly the bytes of plausible UTF-8 characters. Records are few in signs and
sources differ, so the chance of each chain in each source is estimated by
expectation-maximization over all records, pooled as counts of equal evidence;
each record is then repaired by the chain with the highest posterior.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Charsets in which UTF-8 bytes may have been read; "western" reads undefined bytes as Latin-1 does.
CHARSETS = ("western", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250")
SINGLE = "cp1252-as-latin1"
CHAINS = (*CHARSETS, SINGLE)
NONE = "none"
_SEQ = re.compile("[Â-ß][\u0080-¿]|[à-ï][\u0080-¿]{2}|[ð-ô][\u0080-¿]{3}")
#: A lead byte and too few of its followers, or followers replaced by a question mark.
_TORN = re.compile(
    "[à-ï][\u0080-¿](?![\u0080-¿])|[ð-ô][\u0080-¿]{1,2}(?![\u0080-¿])"
    "|[à-ï]\\?{1,2}(?=[à-ï?])|[Â-ß]\\?(?=[^\\W\\d_])"
)
_C1 = re.compile("[\u0080-\u009f]")


def _build(charset: str) -> dict[int, str]:
    table = {}
    for b in range(0x80, 0x100):
        if charset == "western":
            table.setdefault(b, chr(b))
            try:
                table[ord(bytes([b]).decode("cp1252"))] = chr(b)
            except UnicodeDecodeError:
                pass
        else:
            try:
                table[ord(bytes([b]).decode(charset))] = chr(b)
            except UnicodeDecodeError:
                pass
    return table


class _View(dict):
    """Character to byte (as a character), anything else outside ASCII to a blank mark."""

    def __missing__(self, o: int) -> str:
        v = chr(o) if o < 0x80 else "￿"
        self[o] = v
        return v


_VIEWS = {c: _View(_build(c)) for c in CHARSETS}
_SINGLE = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _suspect() -> re.Pattern:
    """Finds a lead byte with a follower under any charset, a C1 control or U+FFFD."""
    heads, pairs = set("\ufffd") | {chr(o) for o in range(0x80, 0xA0)}, ["(?<=[\u0080-\u009f\ufffd])"]
    for c in CHARSETS:
        lead = [chr(o) for o, b in _VIEWS[c].items() if 0xC2 <= ord(b) <= 0xF4]
        tail = [chr(o) for o, b in _VIEWS[c].items() if 0x80 <= ord(b) <= 0xBF]
        heads.update(lead)
        pairs.append(f"(?<=[{re.escape(''.join(lead))}])[{re.escape(''.join(tail))}?]")
    return re.compile(f"[{re.escape(''.join(sorted(heads)))}](?:{'|'.join(pairs)})")


_SUSPECT = _suspect()


@lru_cache(200_000)
def _decoded(seq: str) -> str | None:
    """The character of a byte run, or None if it isn't one that texts hold."""
    try:
        ch = seq.encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return None
    o = ord(ch)
    good = (
        0x80 <= o <= 0x17F or o in (0x1A0, 0x1A1, 0x1AF, 0x1B0, 0x192, 0x218, 0x219, 0x21A, 0x21B) or 0x370 <= o <= 0x52F or 0x900 <= o <= 0xDFF or 0x1E00 <= o <= 0x1EFF or 0x200B <= o <= 0x203E
        or 0x20A0 <= o <= 0x20C0 or 0x2100 <= o <= 0x22FF or 0x2500 <= o <= 0x27BF or 0xF8FF == o or 0xFEFF == o or 0xFE0F == o
        or 0x2B00 <= o <= 0x2BFF or 0x1F000 <= o <= 0x1FAFF or 0x2C6 <= o <= 0x2DD
    )
    return ch if good else None


def _explained(text: str, charset: str) -> list[tuple[int, int, str]]:
    view = text.translate(_VIEWS[charset])
    out = []
    for m in _SEQ.finditer(view):
        ch = _decoded(m.group())
        if ch is not None:
            out.append((m.start(), m.end(), ch))
    return out


def evidence(text: str | None) -> tuple[int, ...]:
    """Characters of the text that each chain explains, in the order of CHAINS."""
    if not text or not _SUSPECT.search(text):
        return (0,) * len(CHAINS)
    found = [sum(e - s for s, e, _ in _explained(text, c)) for c in CHARSETS]
    single = 0
    if _C1.search(text):
        used = {i for s, e, _ in _explained(text, "western") for i in range(s, e)}
        single = sum(1 for m in _C1.finditer(text) if m.start() not in used and ord(m.group()) in _SINGLE)
    return (*found, single)


def pattern(ev: tuple[int, ...]) -> str:
    """Evidence rounded to powers of two, so that few patterns hold all records."""
    return "".join(chr(48 + v.bit_length()) for v in ev)


def _sizes(pat: str) -> list[int]:
    return [(1 << (ord(c) - 48)) >> 1 for c in pat]


def _likelihood(explained, hit: float, stray: float) -> np.ndarray:
    """Log likelihood of the evidence under NONE and every chain."""
    size = np.array([0, *explained], float)
    return size * math.log(hit) + (size.max() - size) * math.log(stray)


def _normal(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max())
    return p / p.sum()


def fit_chains(counts: pd.DataFrame, rounds: int = 50, hit: float = 0.95, stray: float = 0.3, pseudo: float = 1.0) -> dict[str, np.ndarray]:
    """EM over (source, pattern, n): log chance of NONE and of each chain by source.

    A source's chances are drawn towards the corpus' by ``pseudo`` records, so
    sources with few records lean on all others.
    """
    pats = counts["pattern"].unique()
    like = {p: _likelihood(_sizes(p), hit, stray) for p in pats}
    k = len(CHAINS) + 1
    overall = np.full(k, 1 / k)
    by = {s: overall.copy() for s in counts["source"].unique()}
    rows = list(counts[["source", "pattern", "n"]].itertuples(index=False))
    for _ in range(rounds):
        sums = {s: pseudo * overall for s in by}
        total = np.full(k, 1e-3)
        for s, p, n in rows:
            post = n * _normal(like[p] + np.log(by[s]))
            sums[s] = sums[s] + post
            total += post
        overall = total / total.sum()
        new = {s: v / v.sum() for s, v in sums.items()}
        moved = max((np.abs(new[s] - by[s]).max() for s in by), default=0)
        by = new
        if moved < 1e-7:
            break
    return {s: np.log(v + 1e-12) for s, v in by.items()} | {"": np.log(overall + 1e-12)}


def _apply(text: str, chain: str) -> str:
    if chain == SINGLE:
        return text.translate(_SINGLE)
    out, at = [], 0
    for s, e, ch in _explained(text, chain):
        out += [text[at:s], ch]
        at = e
    return "".join(out) + text[at:]


def repair(text: str | None, prior: np.ndarray, hit: float = 0.95, stray: float = 0.3) -> tuple[bool, bool, str | None, list[str]]:
    """(damaged, lost, restored text, chain undone, outermost first)."""
    if not text:
        return False, False, text, []
    if not _SUSPECT.search(text):
        return False, False, text, []
    lost = "�" in text
    chains: list[str] = []
    now = text
    while True:  # every layer undone makes the text shorter
        ev = evidence(now)
        if not any(ev):
            break
        post = _likelihood(ev, hit, stray) + prior
        best = int(np.argmax(post))
        if best == 0 and not chains:
            break
        if best == 0:
            # A second layer needs no new sign that the record is damaged.
            best = 1 + int(np.argmax(post[1:]))
        if not ev[best - 1]:
            best = 1 + int(np.argmax(ev))
        chains.append(CHAINS[best - 1])
        now = _apply(now, CHAINS[best - 1])
    for c in dict.fromkeys([*chains, "western"]):
        if c in _VIEWS and _TORN.search(now.translate(_VIEWS[c])):
            lost = True
    return bool(chains) or lost, lost, now, chains


def _patterns(text: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = Counter((s or "", pattern(evidence(t))) for s, t in zip(pdf["source"], pdf[text]))
            yield pd.DataFrame({"source": pd.Series([k[0] for k in seen], dtype=object), "pattern": pd.Series([k[1] for k in seen], dtype=object), "n": np.array(list(seen.values()), dtype=np.int64)})

    return run


def chain_counts(df: DataFrame, text: str, source: str, max_sources: int = 4096) -> pd.DataFrame:
    """Records by source and evidence pattern, for the EM.

    Counted per batch, then per source and pattern over all records. Sources
    beyond the ``max_sources`` with the most records are pooled under their hash, so
    what reaches the driver is bounded by sources times patterns.
    """
    part = df.select(F.col(source).cast("string").alias("source"), text).mapInPandas(_patterns(text), "source string, pattern string, n long")
    counts = part.groupBy("source", "pattern").agg(F.sum("n").alias("n"))
    pooled = F.concat(F.lit("#"), F.pmod(F.xxhash64("source"), F.lit(max_sources)).cast("string"))
    counts = counts.withColumn("source", F.when(F.length("source") > 200, pooled).otherwise(F.col("source")))
    names = counts.groupBy("source").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), "source").limit(max_sources)
    kept = counts.join(names.select("source"), "source", "left_semi")
    rest = counts.join(names.select("source"), "source", "left_anti").groupBy("pattern").agg(F.sum("n").alias("n"))
    return kept.unionByName(rest.select(F.lit("").alias("source"), "pattern", "n")).toPandas().sort_values(["source", "pattern"])


def repair_encoding(df: DataFrame, ident: str = "pos", text: str = "text_raw", source: str = "source") -> DataFrame:
    """(ident, damaged, lost, restored, chain): one row per row of ``df``.

    ``restored`` is the text itself where nothing is damaged. Null and empty
    texts are undamaged; a null source is one of its own. Long texts are worked
    through whole. ``lost`` is true where a character can't be got back.
    """
    priors = df.sparkSession.sparkContext.broadcast(fit_chains(chain_counts(df, text, source)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = priors.value
        for pdf in batches:
            rows = [repair(t, table.get(s or "", table[""])) for t, s in zip(pdf["text"], pdf["source"])]
            yield pd.DataFrame({
                ident: pdf["ident"], "damaged": [r[0] for r in rows], "lost": [r[1] for r in rows],
                "restored": [r[2] for r in rows], "chain": [">".join(r[3]) for r in rows]})

    kind = dict(df.dtypes)[ident]
    cols = df.select(F.col(ident).alias("ident"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    return cols.mapInPandas(run, f"{ident} {kind}, damaged boolean, lost boolean, restored string, chain string")


def damaged_rows(df: DataFrame, ident: str = "pos", text: str = "text_raw", source: str = "source") -> DataFrame:
    """(ident, restored_id) of the damaged rows; the id is empty where a character is lost."""
    r = repair_encoding(df, ident, text, source).where("damaged")
    rid = F.when(F.col("lost"), "").otherwise(F.substring(F.sha1(F.encode("restored", "UTF-8")), 1, 12))
    return r.select(ident, rid.alias("restored_id"))
