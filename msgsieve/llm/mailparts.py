"""The newly written part of an email (problem 7).

A mail is cut into units: its lines, and inside long lines the places where a
quote, a closing or a sentence of a closing begins. The reader decides unit by unit what
belongs to an earlier message or a signature by the forms that mail programs
and letters have.

Legal notices and the notes of devices have no form of their own; compression finds
them. Over all mails the phrases are counted that come again and again where
mails end and hardly ever elsewhere: the closings. Together with the lines that the sender's own
mails close with, and with the thread's ancestors (the earlier messages inside the mail), they form
dictionaries. Every sentence is deflated alone and with them. An abnormal gain flags it; if
exact runs of its words stand in the dictionary, it is a notice, a note or a repeat and goes,
otherwise it is kept as new.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

NEW, QUOTE, SIGN, LEGAL = "new", "quote", "signature", "notice"

# Closing formulas by language.
_CLOSINGS = (
    r"(?:kind|best|warm(?:est)?|many)\s+(?:regards|wishes|thanks)|(?:with\s+)?(?:regards|thanks|cheers|warmly|best|sincerely|respectfully|cordially|all the best|take care|thank you|thanks and regards|thanks & regards)"
    r"|yours\s+(?:sincerely|faithfully|truly|ever)|sincerely\s+yours"
    r"|(?:un\s+)?(?:cordial\s+)?saludos?(?:\s+cordial(?:es)?)?|atentamente|un\s+abrazo|cordialmente|gracias|atte"
    r"|dhanyav[a]+d|shukriya|aapka|aapki|aabhaar|saadar|sadar"
    r"|धन्यवाद|सादर|आपका|आपकी|आभार|शुक्रिया|आपला|आपली|तुमचा|कळावे|শুভেচ্ছান্তে|ধন্যবাদ|ইতি|বিনীত|আপনার|நன்றி|அன்புடன்|இப்படிக்கு|தங்கள்"
)
_DATE = r"\d{1,2}[ /.-](?:\w{3,9}|\d{1,2})\.?[ /.-]\d{2,4}"
_PART = r"(?:[^\W\d_]\.|[^\W\d_][^\s:,;<>.!?।]*)"
_WHO = rf"{_PART}(?:[ \t]{_PART}){{0,3}}(?:\s*(?:<|&lt;)[^<>\n]{{1,80}}(?:>|&gt;))?"
# Lines that introduce a quoted message, by language.
_DATED = (
    r"on (?:\w{3,9},? )?(?:\w{3,9} \d{1,2}|\d{1,2} \w{3,9}),? \d{4}[^\n]{0,140}? wrote\s*:"
    rf"|in reply to {_WHO}, (?:\d{{1,2}} \w{{3,9}}|{_DATE})\s*:"
    r"|\d{4}-\d{2}-\d{2} \d{1,2}:\d{2} (?:gmt|utc)[+-]\d{1,2}:?\d{2} [^\n]{2,140}?:(?=\s|$)"
    r"|el \d{1,2} (?:de )?\w{3,10}\.? (?:de )?\d{4},? a las? \d{1,2}:\d{2},? [^\n]{2,140}? escribi[óo]\s*:"
    r"|\d{1,2} \w{3,9} \d{4} ko \d{1,2}:\d{2} baje [^\n]{2,140}? ne likha\s*:"
    r"|\d{1,2} \S{3,12} \d{4} (?:को|रोजी) \d{1,2}:\d{2} (?:बजे|वाजता) [^\n]{2,140}? (?:ने लिखा|यांनी लिहिले|ने लिहिले)\s*:"
    r"|\d{1,2} \S{3,12} \d{4}[^\n]{0,20}\d{1,2}:\d{2}[^\n]{2,140}? (?:লিখেছেন|எழுதியது|எழுதினார்)\s*:"
)
_SIGNED = rf"{_WHO} wrote on {_DATE}\s*:"
_INTRO = rf"{_DATED}|{_SIGNED}"
_SEPARATOR = (
    r"-{2,}\s*(?:original message|forwarded message|forwarded by[^\n-]{0,40}|mensaje original|mensaje reenviado|weitergeleitet / forwarded|weitergeleitete? nachricht|urspr[üu]ngliche nachricht|मूल संदेश|अग्रेषित संदेश)\s*-{2,}"
    r"|begin forwarded message\s*:|inicio del mensaje reenviado\s*:"
)
_HEADER = r"(?:from|de|von|प्रेषक|भेजने वाला)\s*:[^\n]{2,160}?\s*\n?\s*(?:sent|date|to|enviado|fecha|para|दिनांक|प्रति|gesendet)\s*:"
_DIVIDER = re.compile(r"^\s*(?:--+|—{1,3}|~{3,}|={3,}|_{3,}|\*(?: ?\*){2,}|#{3,})\s*$")
_PREFIX = re.compile(r"^\s*(?:>|\|(?!\|)|&gt;)")
_NAME = r"(?:[A-Z][\w'’]*\.?|[a-z]{2,}|[ऀ-෿]+)"

_I = re.I
_RE_INTRO = re.compile(rf"^\s*(?:{_INTRO})", _I)
_RE_SEP = re.compile(rf"^\s*(?:{_SEPARATOR})", _I)
_RE_HEAD = re.compile(rf"^\s*{_HEADER}", _I)
_RE_CLOSE = re.compile(rf"^\s*(?:{_CLOSINGS})\s*[,.!:;।-]?\s*$", _I)
# Pieces of which every form holds one, in lower case.
_QUOTE_PIECES = ("wrote", "reply to", "gmt+", "gmt-", "utc+", "utc-", "escribi", "likha", "लिखा", "लिहिले", "লিখেছেন", "எழுதி")
_SEP_PIECES = ("original", "forwarded", "reenviado", "weitergeleit", "nachricht", "मूल संदेश", "अग्रेषित")
_HEAD_PIECES = ("from:", "from :", "de:", "de :", "von:", "प्रेषक", "भेजने वाला")
_RULE_PIECES = ("--", "~~~", "===", "___", "* * *")
# Breaks inside a line, each with pieces to look for first. A closing needs the end of a sentence before it, a comma after it and a name.
_BREAKS = (
    (_SEP_PIECES, re.compile(rf"(?<=\S)[ \t]+(?=(?:{_SEPARATOR}))", _I)),
    (_QUOTE_PIECES, re.compile(rf"(?<=\S)[ \t]+(?=(?:{_DATED}))", _I)),
    (("wrote on",), re.compile(rf"(?<=[.!?।:;>)])(?<!\b[^\W\d_]\.)[ \t]+(?={_SIGNED})", _I)),
    (_HEAD_PIECES, re.compile(rf"(?<=\S)[ \t]+(?=(?:_{{8,}}[ \t]+)?{_HEADER})", _I)),
    ((",", "!"), re.compile(rf"(?<=[.!?।>)])[ \t]+(?=(?:{_CLOSINGS}) ?[,!][ \t]+{_NAME})", _I)),
    (_RULE_PIECES, re.compile(r"(?<=[.!?।>)\w])[ \t]+(?=(?:--|~{3,}|={3,}|_{3,}|\* \* \*)[ \t]+(?!the\b)[^\W\d_])")),
)
_AFTER = (
    re.compile(rf"^(\s*(?:{_SEPARATOR}))[ \t]+", _I),
    re.compile(rf"^(\s*(?:{_INTRO}))[ \t]*(?=\S)", _I),
    re.compile(rf"^(\s*(?:{_CLOSINGS}) ?[,!])[ \t]+(?={_NAME})", _I),
    re.compile(r"^(\s*(?:--|~{3,}|={3,}|_{3,}|\* \* \*))[ \t]+(?=\S)"),
)
_CLOSED = re.compile(rf"(?:\A|[\n.!?।>)])\s*(?:{_CLOSINGS}) ?[,.!:;।-]?(?:\s*(?:\n|\Z)|(?<=[,!])[ \t]+{_NAME})", _I)
_STRONG = (*_QUOTE_PIECES, *_SEP_PIECES, *_HEAD_PIECES, *_RULE_PIECES, "\n>", "\n|", "\n >", "—")
def _worth_reading(text: str) -> bool:
    low = text.lower()
    if low.lstrip()[:1] in (">", "|") or any(p in low for p in _STRONG):
        return True
    return bool(_CLOSED.search(text))


def _units(text: str, closings: Closings | None) -> list[tuple[str, bool]]:
    """(unit, whether it began inside a line)."""
    out: list[tuple[str, bool]] = []
    for line in text.split("\n"):
        if len(line) < 30 or _PREFIX.match(line):
            out.append((line, False))
            continue
        low = line.lower()
        cuts = {m.end() for pieces, p in _BREAKS if any(x in low for x in pieces) for m in p.finditer(line)}
        if closings:
            ends = [m.end() for m in _SENTENCE.finditer(line)]
            cuts.update(a for a, b in zip(ends, [*ends[1:], len(line)]) if closings.flags(line[a:b]))
        cuts = sorted(cuts)
        pieces = [line[a:b] for a, b in zip([0, *cuts], [*cuts, len(line)])]
        for i, piece in enumerate(pieces):
            for p in _AFTER:
                m = p.match(piece)
                if m and m.end() < len(piece):
                    out += [(m.group(1), i > 0), (piece[m.end() :], True)]
                    break
            else:
                out.append((piece, i > 0))
    return out


def read_parts(text: str | None, closings: Closings | None = None) -> list[tuple[str, str]]:
    """(kind, unit) in order; units are the lines of the text or pieces of them.

    Without ``closings`` only what has a form of its own is told apart.
    """
    if not text:
        return []
    if not _worth_reading(text) and not (closings and closings.within(text)):
        return [(NEW, text)]
    units = _units(text, closings)

    def closes(unit: str) -> bool:
        first = _SENTENCE.split(unit.strip(), maxsplit=1)[0]
        return bool(closings) and closings.flags(first)

    kinds = [NEW] * len(units)
    n = len(units)
    state = NEW
    lines_in_sign = 0

    def after(i: int) -> int:
        i += 1
        while i < n and not units[i][0].strip():
            i += 1
        return i

    i = 0
    while i < n:
        u, joined = units[i]
        if not u.strip():
            if state == SIGN and lines_in_sign > 0:
                state = NEW
            elif state == LEGAL:
                state = NEW
            kinds[i] = state
            i += 1
            continue
        if state == QUOTE:
            kinds[i] = QUOTE
            i += 1
            continue
        if _PREFIX.match(u):
            kinds[i] = QUOTE
            state = NEW
        elif _RE_INTRO.match(u):
            kinds[i] = QUOTE
            j = after(i)
            state = NEW if j < n and _PREFIX.match(units[j][0]) and not units[j][1] else QUOTE
        elif _RE_SEP.match(u) or _RE_HEAD.match(u + ("\n" + units[i + 1][0] if i + 1 < n else "")):
            kinds[i] = QUOTE
            state = QUOTE
        elif closes(u):
            # A note of a few words belongs to the signature, a longer one is a notice.
            kinds[i] = state = SIGN if len(u.split()) <= 8 else LEGAL
            lines_in_sign = 1
        elif _DIVIDER.match(u):
            j = after(i)
            nxt = units[j][0] if j < n else ""
            follow = nxt + ("\n" + units[j + 1][0] if j + 1 < n else "")
            if j >= n:
                kinds[i] = SIGN
            elif closes(nxt) and len(nxt.split()) > 8:
                kinds[i] = state = LEGAL
            elif _RE_SEP.match(nxt) or _RE_HEAD.match(follow) or _RE_INTRO.match(nxt):
                kinds[i] = QUOTE
                state = NEW
            elif len(nxt.split()) <= 12 or units[j][1]:
                kinds[i] = state = SIGN
                lines_in_sign = 0
            else:
                state = NEW
        elif _RE_CLOSE.match(u) and (joined or (after(i) >= n or len(units[after(i)][0].split()) <= 8 or units[after(i)][1])):
            kinds[i] = state = SIGN
            lines_in_sign = 0
        elif state in (SIGN, LEGAL):
            kinds[i] = state
            lines_in_sign += 1
        i += 1
    return [(k, u) for k, (u, _) in zip(kinds, units)]


_TOKEN = re.compile(r"[^\W_]+")


def _overlap(words: list[str], grams: set[tuple[str, ...]], size: int) -> float:
    """Share of the words that stand in the dictionary in runs of ``size``."""
    if len(words) < size:
        return 0.0
    hit = np.zeros(len(words), bool)
    for i in range(len(words) - size + 1):
        if tuple(words[i : i + size]) in grams:
            hit[i : i + size] = True
    return float(hit.mean())


def compression_gain(paragraph: str, dictionary: bytes) -> float:
    """1 - deflated size with the dictionary / without; 0 without a dictionary."""
    data = paragraph.encode()
    if not data or not dictionary:
        return 0.0
    alone = len(zlib.compress(data, 6))
    c = zlib.compressobj(6, zdict=dictionary[-32768:])
    return 1 - (len(c.compress(data)) + len(c.flush())) / alone


@lru_cache(1)
def common_closings() -> Closings:
    return Closings([])


def new_part(text: str | None, closings: Closings | None = None, lines: bytes | list[bytes] = b"", gain: float = 0.6, run: int = 6) -> tuple[str, list[str]]:
    """(newly written text, kinds of the other parts, sorted).

    Null and empty texts give ("", []). ``lines`` are what the sender closes mails with, in one text or several. A paragraph that repeats them
    or the thread goes only if ``run`` or more of its words in a row cover nine tenths
    of it; text that merely resembles them stays.
    """
    parts = read_parts(text, closings or common_closings())
    other = {k for k, _ in parts} - {NEW}
    lines = [lines] if isinstance(lines, bytes) else lines
    if not other and not any(lines):
        return text or "", []
    old = "\n".join(re.sub(r"^[\s>|]+", "", u) for k, u in parts if k == QUOTE)
    keep = []
    known: dict[bytes, set[tuple[str, ...]]] = {}
    for u in (line for k, part in parts if k == NEW for line in part.split("\n")):
        kind = None
        for d, means in ((old.encode(), QUOTE), *((x, SIGN) for x in lines)) if len(u) > 40 else ():
            if d and compression_gain(u, d) >= gain:
                if d not in known:
                    words = _TOKEN.findall(d.decode(errors="ignore").lower())
                    known[d] = {tuple(words[i : i + run]) for i in range(len(words) - run + 1)}
                if _overlap(_TOKEN.findall(u.lower()), known[d], run) >= 0.9:
                    kind = means
                    break
        if kind:
            other.add(kind)
        else:
            keep.append(u)
    if not other:
        return text or "", []
    return "\n".join(keep).strip(), sorted(other)


_SENTENCE = re.compile(r"(?:(?<=[.!?।])[ \t]+|[ \t]+(?=[*_~=-]{2,}[ \t])|(?<=[*_~=-]{2})[ \t]+)")
_CLOSING_WORD = re.compile(r"[^\W_](?:[^\W_]|[\u0900-\u0dff])*")
RUN = 3


def _closing_words(text: str) -> list[str]:
    return ["0" if w.isdigit() else w for w in _CLOSING_WORD.findall(text.lower())]


def _runs(text: str) -> list[str]:
    w = _closing_words(text)
    return [" ".join(w[i : i + RUN]) for i in range(len(w) - RUN + 1)]


# How notices and notes of devices commonly run; what mails of a corpus close with is learned beside them.
_COMMON = (
    "this message and any attachments are meant only for the addressee", "this message and any part are meant only for", "this email is confidential and intended only for the recipient",
    "if you received it by mistake delete it", "the views in this mail are those of the sender", "please consider the environment before printing this e mail",
    "sent from my phone", "sent from my mobile", "get the mail app for", "este mensaje y los adjuntos son confidenciales", "si lo recibe por error", "enviado desde mi móvil", "यह संदेश केवल पाने वाले के लिए है",
)


class Closings:
    """Phrases that mails close with, as deflate dictionaries and as exact runs of words."""

    def __init__(self, phrases: list[str], gain: float = 0.15, cover: float = 0.3):
        self.phrases, self.gain, self.cover = frozenset(phrases) | {r for c in _COMMON for r in _runs(c)}, gain, cover
        # A deflate window holds 32 KB: more phrases make more dictionaries.
        self.dictionaries = [b""]
        for p in sorted(self.phrases):
            d = p.encode() + b"\n"
            if len(self.dictionaries[-1]) + len(d) > 32_000:
                self.dictionaries.append(b"")
            self.dictionaries[-1] += d

    def __bool__(self) -> bool:
        return bool(self.phrases)

    def within(self, text: str) -> bool:
        return not self.phrases.isdisjoint(_runs(text))

    def flags(self, sentence: str) -> bool:
        """Whether a sentence is a closing: an abnormal gain, and exact runs over enough of its words."""
        runs = _runs(sentence)
        if self.phrases.isdisjoint(runs):
            return False
        plain = " ".join(_closing_words(sentence))
        if max(compression_gain(plain, d) for d in self.dictionaries) < self.gain:
            return False
        hit = np.zeros(len(runs) + RUN - 1, bool)
        for i, r in enumerate(runs):
            if r in self.phrases:
                hit[i : i + RUN] = True
        return hit.mean() >= self.cover


def closing_phrases(mails: DataFrame, text: str, share: float = 1.2e-3, least: int = 4, times: int = 12, tail: int = 3) -> list[str]:
    """Runs of three words that come again and again in the last ``tail`` sentences of mails and hardly ever before.

    A phrase must stand there in ``share`` of the mails or more, and ``times`` as often as elsewhere. Mails of one beginning
    count once, so copies of a message make no phrase. Every mail is counted; at most (words of
    ``tail`` sentences) / ``share`` phrases can qualify, which bounds what reaches the driver.
    """

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[tuple[str, int], int] = {}
            for t in pdf["text"]:
                if not t or not t.strip():
                    continue
                head = zlib.crc32(t[:24].encode()) << 16 | len(t[:24].split()) & 0xFFFF
                sentences = [x for k, u in read_parts(t) if k != QUOTE for x in _SENTENCE.split(u) if x.strip()]
                for n, x in enumerate(reversed(sentences)):
                    for r in _runs(x):
                        out[r, head] = out.get((r, head), 0) | (1 if n < tail else 2)
            yield pd.DataFrame({"phrase": pd.Series([k[0] for k in out], dtype=object), "head": np.array([k[1] for k in out], dtype=np.int64), "at": np.array(list(out.values()), dtype=np.int32)})

    cols = mails.select(F.col(text).alias("text"))
    total = cols.select(F.xxhash64(F.substring("text", 1, 24))).distinct().count()
    each = cols.mapInPandas(phrases, "phrase string, head long, at int").groupBy("phrase", "head").agg(F.bit_or("at").alias("at"))
    per = each.groupBy("phrase").agg(F.sum(F.col("at").bitwiseAND(1)).alias("last"), F.sum(F.shiftright(F.col("at"), 1)).alias("before"))
    found = per.where((F.col("last") >= max(least, int(share * total))) & (F.col("last") >= times * F.col("before")))
    return [r[0] for r in found.select("phrase").collect()]


def _pieces(lines: list[str], size: int = 16_384) -> list[str]:
    """All lines in order, in as few texts as hold them with at most ``size`` bytes each; half a deflate window, the other half is for what is compared."""
    out, at = [], 0
    for line in lines:
        n = len(line.encode()) + 1
        if not out or at + n > size:
            out.append([])
            at = 0
        out[-1].append(line)
        at += n
    return ["\n".join(p) for p in out]


def sender_closings(mails: DataFrame, text: str, sender: str, least: int = 3) -> DataFrame:
    """(sender, pieces): all lines of signatures and notices that a sender repeats, in texts of half a deflate window each.

    Lines are counted over all mails; the most frequent ones stand last, where a window finds them cheapest.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for name, t in zip(pdf["sender"], pdf["text"]):
                for kind, u in read_parts(t):
                    if kind in (SIGN, LEGAL) and 12 <= len(u) <= 400:
                        seen[name, u.strip()] += 1
            yield pd.DataFrame({"sender": pd.Series([k[0] for k in seen], dtype=object), "line": pd.Series([k[1] for k in seen], dtype=object), "n": np.array(list(seen.values()), dtype=np.int64)})

    raw = mails.where(F.col(sender).isNotNull()).select(F.col(sender).alias("sender"), F.col(text).alias("text"))
    counted = raw.mapInPandas(lines, "sender string, line string, n long").groupBy("sender", "line").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    of = counted.groupBy("sender").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"sender": pdf["sender"], "pieces": [_pieces(list(x)) for x in pdf["lines"]]})

    return of.mapInPandas(pack, "sender string, pieces array<string>")


def reduce_mails(df: DataFrame, ident: str = "pos", text: str = "text", source: str = "source", sender: str = "sender", mail_sources: str = "mail|synthetic") -> DataFrame:
    """(ident, new_text, parts, new_words): one row per row of a mail source.

    ``parts`` names what else the mail holds; it is empty for rows without an
    earlier message, signature or notice, whose text is all new. Null senders
    have no closings of their own; null and empty texts have no new words.
    """
    mails = df.where(F.coalesce(F.col(source), F.lit("")).rlike(mail_sources))
    mails = mails.select(F.col(ident).alias("ident"), F.col(text).alias("text"), F.col(sender).cast("string").alias("sender"))
    spark = df.sparkSession
    known = spark.sparkContext.broadcast(Closings(closing_phrases(mails, "text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [new_part(t, known.value, [x.encode() for x in p] if p is not None else []) for t, p in zip(pdf["text"], pdf["pieces"])]
            yield pd.DataFrame({ident: pdf["ident"], "new_text": [r[0] for r in rows], "parts": [r[1] for r in rows],
                                "new_words": np.array([len(r[0].split()) for r in rows], dtype=np.int64)})

    kind = dict(df.dtypes)[ident]
    # Mails without a sender have no lines to wait for.
    cols = mails.where("sender is not null").join(sender_closings(mails, "text", "sender"), "sender", "left").select("ident", "text", "pieces")
    cols = cols.unionByName(mails.where("sender is null").select("ident", "text", F.lit(None).cast("array<string>").alias("pieces")))
    return cols.mapInPandas(run, f"{ident} {kind}, new_text string, parts array<string>, new_words long")
