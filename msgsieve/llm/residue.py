"""Template residue, filler, error pages and script notices (problem 10).

Placeholder detectors read every segment (line or sentence) of a document for
unfilled fields, filler and the standard forms of error messages and script notices.
What they do not know by its form is judged by evidence. Every paragraph that
answers instead of telling (it holds words of responses: "server", "denied",
"browser") is compared with the slug of the addresses in the document, with its title and with the rest of its
body. A response of little information that shares no term with any of them is
mismatched, and one whose shape (hosts, numbers, codes and names masked) comes back from
several hosts is duplicated; both are counted over all documents and joined
back by shape. A sentence that only talks about such a thing, told by somebody, is left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

# What stands for an unfilled field in common template languages.
_FIELDS = (
    r"\{\{[^{}\n]{1,60}\}\}",
    r"\$\{[^{}\n]{1,60}\}",
    r"<%=?[^%\n]{1,60}%>",
    r"<<\s*[A-Za-z][\w .]{0,40}>>",
    r"\*\|[A-Za-z][\w ]{1,40}\|\*",
    r"(?<![\w%])%(?:\(\w+\))?[sd](?!\w)",
    r"&lt;\s*[A-Za-z][\w ]{1,40}\s*&gt;",
    r"\[\[\s*[A-Za-z][\w .]{0,40}\]\]",
    r"%%[A-Za-z][\w ]{1,40}%%",
    r"@@[A-Za-z][\w ]{1,40}@@",
    r"(?<![\w_])__[A-Za-z][A-Za-z_]{1,40}__(?![\w_])",
    r"(?<![\w#&])#[A-Z][A-Z_]{2,40}#",
    r"\{\s*(?:[A-Za-z_][\w .]{0,40}|\d{1,2})\s*\}",
    r"\[(?:[Yy]our|YOUR|[Ii]nsert|INSERT|[Ee]nter|ENTER|[Aa]dd|ADD)\s[^\[\]\n]{1,40}\]",
    r"\[[A-Z][A-Z_]{2,}(?: [A-Z_]{2,}){0,3}\]",
    r"<(?:[Yy]our|[Ii]nsert|[Ee]nter|INSERT|YOUR)\s[^<>\n]{1,40}>",
    r"<(?!(?:URL|OTP|PHONE|EMAIL|NAME|ADDRESS|ID|CUR|YEAR|ID_NUMBER|PERSON)>)(?:[A-Z][A-Z_]{3,}|[a-z]+_[a-z_]+|[a-z]+[A-Z]\w+|name|branch|agent|link|amount|city|company|date|customer|user|City)>",
)
_FIELD = re.compile("|".join(f"(?:{p})" for p in _FIELDS))
_MENTION = re.compile(
    r"(?:\b(?:began|begins?|start(?:s|ed)?|opens?|opened|ended|ends)\s+with\s+(?:dear\s+|hi\s+|hello\s+)?"
    r"|\b(?:field|variable|placeholder|tag|token|slot|column|marker)s?\s+(?:is\s+)?(?:called|named|written)\s+"
    r"|\b(?:called|spelled|literally|the words?)\s+)[\"'“‘`]?$",
    re.I,
)

# Words of the customary filler text.
_LOREM = set(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna "
    "aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui "
    "officia deserunt mollit anim id est laborum vestibulum morbi lectus vitae semper praesent mauris pellentesque".split()
)
# What people type to fill a field.
_MASH = set("asdf asdfgh qwerty qwertz foo bar baz foobar blah bla test testing tests xxx xxxx abc abc123 dfgdfg dfg fgh hjk lkj aaa aaaa zzz jkl sdf sdfsdf".split())

# Filler phrases, by language.
_FILLER = re.compile(
    r"\b(?:sample|dummy|placeholder|filler|example) text (?:goes )?here\b|\b(?:headline|text|image|title|content|body|copy) placeholder\b"
    r"|\bbody copy to follow\b|\breplace this (?:paragraph|text|section|line)\b|\badd (?:a )?short description of\b"
    r"|\b(?:your|insert|enter|add|type) (?:own )?(?:text|content|copy|title|headline) (?:goes )?here\b"
    r"|\b(?:description|text|content|details|title) (?:goes here|coming soon|to follow)\b"
    r"|\bitem \d+:\s*description\b"
    r"|\baqu[ií] va (?:el|su|tu) texto\b|\btexto de (?:relleno|ejemplo|prueba|muestra)\b|\b(?:escriba|inserte|introduzca) (?:aqu[ií] )?su texto\b"
    r"|यहाँ अपना पाठ|यहां अपना पाठ|येथे (?:आपला|तुमचा) मजकूर|नमुना मजकूर|এখানে আপনার (?:লেখা|পাঠ্য)|இங்கே உங்கள் (?:உரை|உரையை)"
    r"|\byahan apna (?:text|paath|sandesh)\b",
    re.I,
)
_TODO = re.compile(r"\bTODO\b\s*:|\bTBD\b|\bFIXME\b|\bTK TK\b")

# Error messages and notices, by language.
_ERRORS = (
    r"^\W*(?:error\s+)?[45]\d\d[:\s-]+(?:not found|bad gateway|bad request|forbidden|unauthori[sz]ed|internal server error|service unavailable|gateway time-?out|too many requests|gone|error)",
    r"\bthe requested (?:page|url|resource|file|document)\b.{0,80}\b(?:was )?(?:not found|could not be found|does not exist)",
    r"\b(?:page|site|server) (?:cannot|can't|could not) be (?:found|reached|displayed)\b",
    r"^\W*oops\W+something went wrong\b|\bsomething went wrong on our (?:end|side)\b",
    r"^\W*access denied\W+you do not have permission|\byou (?:do not|don't) have permission to (?:view|access|open)\b",
    r"\{\s*\"error\"\s*:",
    r"\btraceback \(most recent call last\)|^\s*file \"[^\"]+\", line \d+, in \w+",
    r"\byour session has (?:expired|timed out)\W+please (?:sign|log) in\b",
    r"^\W*service temporarily unavailable\b|\bis down for maintenance,? please (?:try|check|come)\b|\bplease try again in \d+ (?:minutes|seconds)\b",
    r"\bchecking your browser before accessing\b|\bverify(?:ing)? (?:that )?you are (?:a )?human\b",
    r"\bp[áa]gina no encontrada\b|\berror (?:interno )?del servidor\b|\bacceso denegado\b|\bsu sesi[óo]n ha (?:caducado|expirado)\b",
    r"पृष्ठ नहीं मिला|पेज नहीं मिला|पर त्रुटि \d{3}|सर्वर त्रुटि|सेवा उपलब्ध नहीं|पृष्ठ सापडले नाही|पान सापडले नाही|सर्व्हर त्रुटी",
    r"পৃষ্ঠা(?:টি)? পাওয়া যায়নি|সার্ভার ত্রুটি|পাতাটি পাওয়া যায়নি|பக்கம் கிடைக்கவில்லை|பக்கம் கண்டறியப்படவில்லை|சேவையகப் பிழை",
)
_SCRIPTS = (
    r"\bplease (?:enable|turn on|activate|switch on) (?:java ?script|scripts|cookies)\b|\byou need to (?:enable|turn on|activate) (?:java ?script|scripts)\b",
    r"\b(?:app|site|page|website|form) requires java ?script\b|\bjava ?script is (?:required|disabled)\W",
    r"\bactiv[ea] (?:el )?java ?script\b|\bhabilit[ea] (?:el )?java ?script\b|\bnecesita (?:activar )?java ?script\b",
    r"जावास्क्रिप्ट (?:चालू|सक्षम|सुरू)|जावास्क्रिप्टची|জাভাস্ক্রিপ্ট (?:চালু|সক্ষম|সক্রিয়)|ஜாவாஸ்கிரிப்(?:ட்|ட்டை) (?:இயக்க|செயல்)",
    r"\bjavascript (?:chalu|on|enable) (?:karo|kare[n]?|kijiye)\b",
)
_ERROR = re.compile("|".join(f"(?:{p})" for p in _ERRORS), re.I | re.M)
_SCRIPT = re.compile("|".join(f"(?:{p})" for p in _SCRIPTS), re.I)
#: Somebody tells of it: a person in the first or third person, or reported speech. Pages say "we" and "you".
_TALK = re.compile(
    r"\b(?:I|[Mm]y|[Mm]e|[Hh]e|[Ss]he|[Tt]hey|[Ss]taff|[Nn]obody|[Ss]omeone|[Mm]um|[Dd]ad)\b|\b(?:said|says|warned|told|asked|wrote|reported|explained|mentioned|joke[ds]?|laughed)\b"
)
_SPLIT = re.compile(r"\n+|(?<=[.!?।])\s+")
_HOST = re.compile(r"(?:https?://)?(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/[\w./?=&%-]*)?", re.I)
_WORD = re.compile(r"[^\W\d_]+")
# Words of responses and of filler, by language. A segment is read closely only where one stands.
_CUES = set(
    "error errors found server page url browser javascript java script scripts scripting noscript js permission denied access session expired timed unavailable maintenance retry requests request administrator "
    "enable activate cookies blocked allow reload refresh domain parked sale database connection established invalid reply supported upgrade switch captcha timeout gateway forbidden unauthorized unauthorised "
    "incident load requires disabled website site hidden content null undefined exception traceback oops wrong slow down seconds quota exceeded service temporarily human checking gone exist exists displayed reached "
    "sample text placeholder headline description insert dummy filler paragraph replace copy here coming soon follow todo tbd fixme item "
    "página pagina encontrada servidor dirección direccion existe acceso denegado sesión sesion caducado expirado active activar habilite navegador interno "
    "texto relleno ejemplo prueba muestra escriba inserte aquí aqui introduzca uplabdh nahi mila apna paath yahan chalu "
    "पृष्ठ पेज सर्वर त्रुटि सेवा उपलब्ध जावास्क्रिप्ट जावास्क्रिप्टची चालू सक्षम पान सापडले सर्व्हर त्रुटी नमूना नमुना पाठ मजकूर यहाँ यहां येथे "
    "পৃষ্ঠা পৃষ্ঠাটি পাতা পাতাটি সার্ভার সার্ভারে ত্রুটি জাভাস্ক্রিপ্ট চালু এখানে লেখা পাঠ্য নমুনা பக்கம் சேவையகப் சேவையக பிழை ஜாவாஸ்கிரிப்ட் ஜாவாஸ்கிரிப்ட்டை இயக்க இங்கே உரை உரையை மாதிரி".split()
) | {w for w in _LOREM if len(w) > 4} | {w for w in _MASH if len(w) > 2}
_SIGN = re.compile(r"[{$<\[%@_#*&]")


_TOKEN = re.compile(r"[^\W\d_](?:[^\W_]|[\u0900-\u0dff])*\d*")


def _words(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for w in _CUES:
        auto.add_word(w, w)
    auto.make_automaton()
    return auto


def _inside(c: str) -> bool:
    return c.isalpha() or c == "_" or "\u0900" <= c <= "\u0dff"


def cued_segments(text: str) -> tuple[list[tuple[int, int]], dict[int, set[str]]]:
    """(start, end) of every segment, and the cues of the segments that hold one as a whole word."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    at, bounds = 0, []
    for m in _SPLIT.finditer(text):
        bounds.append((at, m.start()))
        at = m.end()
    bounds.append((at, len(text)))
    found: dict[int, set[str]] = {}
    i = 0
    for end, w in _automaton().iter(low):
        s, e = end + 1 - len(w), end + 1
        if (s and _inside(low[s - 1])) or (e < len(low) and _inside(low[e])):
            continue
        while bounds[i][1] <= s:
            i += 1
        found.setdefault(i, set()).add(w)
    return bounds, found


def _mashed(words: list[str]) -> bool:
    """A run of ten words of which most are typed at random."""
    hits = [w in _MASH for w in words]
    if len(words) < 4:
        return False
    if len(words) <= 10:
        return sum(hits) >= 0.7 * len(words)
    run = sum(hits[:10])
    for i in range(10, len(hits)):
        if run >= 7:
            return True
        run += hits[i] - hits[i - 10]
    return run >= 7


def _latin_filler(words: list[str]) -> bool:
    hits = [w in _LOREM and len(w) > 2 for w in words]
    size = 8
    run = sum(hits[:size])
    if run >= min(6, max(4, len(words))):
        return True
    for i in range(size, len(hits)):
        run += hits[i] - hits[i - size]
        if run >= 6:
            return True
    return False


def _has_field(text: str) -> bool:
    after = 0
    for m in _SIGN.finditer(text):
        if m.start() < after:
            continue
        f = _FIELD.match(text, m.start())
        if f:
            after = f.end()
            if not _MENTION.search(text[max(0, m.start() - 48) : m.start()]):
                return True
    return False


def residue_kinds(text: str | None) -> list[str]:
    """Kinds of residue in a text, sorted: error, field, filler, script."""
    if not text:
        return []
    kinds = {"field"} if _has_field(text) else set()
    bounds, near = cued_segments(text)
    for i in near:
        seg = text[bounds[i][0] : bounds[i][1]]
        if _TALK.search(seg):
            continue
        if _FILLER.search(seg):
            kinds.add("filler")
        words = [w.lower() for w in re.findall(r"[a-z]+\d*", seg, re.I)]
        if _mashed(words) or _latin_filler(words):
            kinds.add("filler")
        follow = text[bounds[i][0] : bounds[min(i + 1, len(bounds) - 1)][1]]
        talked = _TALK.search(follow)
        if _ERROR.search(seg) or (not talked and _ERROR.search(follow)):
            kinds.add("error")
        if _SCRIPT.search(seg) or (not talked and _SCRIPT.search(follow)):
            kinds.add("script")
    if len(_TODO.findall(text)) >= 2:
        kinds.add("filler")
    return sorted(kinds)


_CODE = re.compile(r"\b(?=\w*\d)[\w-]+\b")
_PATH = re.compile(r"(?<!\w)/[\w./-]+")
_PROPER = re.compile(r"(?<=[^\W\d_] )[A-Z][a-z]+(?: [A-Z][a-z]+)*")
# Words too frequent to tell texts apart.
_STOP = set(
    "the a an of to in for on and or is are was be been it its your you our we this that with by from at as not no do does have has had again please until than into "
    "de la el los las en su un una por para con se y no es al del hai hui hua ki ka ke ko par me mein aur है हुई में की का के को पर से और ने कर करें आहे ला च्या या এর তে না যায়".split()
)


def responses(text: str | None, least: int = 2) -> list[tuple[str, str, int, int, bool]]:
    """(shape, host, cues, other terms, mismatched) of the runs of segments with ``least`` or more words of responses.

    ``mismatched``: no term beyond the cues stands in the title, in the slug of an address elsewhere, or in
    the rest of the body. What somebody tells is left out. ``host`` is empty where none is named.
    """
    if not text:
        return []
    bounds, found = cued_segments(text)
    runs: list[list[int]] = []
    for i in sorted(found):
        if _TALK.search(text, *bounds[i]):
            continue
        if runs and runs[-1][-1] == i - 1 and "\n" not in text[bounds[i - 1][1] : bounds[i][0]]:
            runs[-1].append(i)
        else:
            runs.append([i])
    # A segment also counts by itself, so that a neighbour with a stray cue hides nothing.
    runs += [[i] for r in runs if len(r) > 1 for i in r]
    runs = [r for r in runs if len(set().union(*(found[i] for i in r))) >= least]
    if not runs:
        return []
    body = Counter(_words(text))  # addresses included: their slugs count as terms
    out = []
    for r in runs:
        p = text[bounds[r[0]][0] : bounds[r[-1]][1]].strip()
        own = Counter(_words(p))
        host = _HOST.search(p)
        rest = set(_words(_HOST.sub(" ", p))) - _CUES - _STOP
        masked = _PROPER.sub("N", _CODE.sub("0", _PATH.sub("/", _HOST.sub("@", p))))
        mismatched = all(body[w] == own[w] for w in rest)
        if len(rest) > 4 * len(set(own) & _CUES):
            continue  # a story with a few such words, no response
        out.append((masked.lower(), host.group().lower().split("/")[0] if host else "", len(set(own) & _CUES), len(rest), mismatched))
    return out


def find_residue(df: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", min_hosts: int = 3, enough: int = 4) -> DataFrame:
    """(ident, kinds, hosts, residue): one row per document.

    ``hosts`` is from how many different hosts (or sources, where no host is named) the shape of a
    response in it came, the highest count of its responses. A response counts its cues, up to ``enough`` - 1, and
    one each for being mismatched, for being low in information (no more other terms than cues) and for coming
    from ``min_hosts`` hosts; with more than ``enough`` points the document is residue even if no
    detector knows the form. Null, empty and blank texts have no kinds and are no residue; long texts are read whole.
    """
    answer = "array<struct<shape: bigint, host: string, points: int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = [residue_kinds(t) for t in pdf["text"]]
            found = []
            for t, k, src in zip(pdf["text"], kinds, pdf["source"]):
                own = {}
                for shape, host, cues, other, mismatched in responses(t) if not k else ():
                    points = min(cues, enough - 1) + mismatched + (other <= cues)
                    if points >= enough:
                        own[shape] = (host or src or "", max(points, own.get(shape, ("", 0))[1]))
                found.append([{"shape": xxhash.xxh64_intdigest(s) - (1 << 63), "host": h, "points": n} for s, (h, n) in own.items()])
            yield pd.DataFrame({ident: pdf["ident"], "kinds": kinds, "answers": found})

    kind = dict(df.dtypes)[ident]
    cols = df.select(F.col(ident).alias("ident"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    seen = cols.mapInPandas(run, f"{ident} {kind}, kinds array<string>, answers {answer}")
    seen = materialize(seen, "responses")
    # A shape of very many documents: its hosts are made distinct before they are counted.
    each = seen.where("size(answers) > 0").select(F.monotonically_increasing_id().alias("row"), ident, F.explode("answers").alias("r")).select(ident, "r.*")
    hosts = each.select("shape", "host").distinct().groupBy("shape").agg(F.count("*").alias("hosts"))
    judged = each.join(hosts, "shape").groupBy(ident).agg(F.max("hosts").alias("hosts"), F.max(F.col("points") + (F.col("hosts") >= min_hosts).cast("int")).alias("points"))
    out = seen.join(judged, ident, "left").withColumn("hosts", F.coalesce("hosts", F.lit(0)))
    return out.select(ident, "kinds", "hosts", ((F.size("kinds") > 0) | (F.coalesce("points", F.lit(0)) > enough)).alias("residue"))


def without_residue(df: DataFrame, ident: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``df`` without its residue documents, all columns kept."""
    bad = find_residue(df, ident, text, **kw).where("residue").select(F.col(ident).alias("__bad"))
    return df.join(bad, F.col(ident) == F.col("__bad"), "left_anti")
