"""A linear-chain conditional random field over words, in numpy.

Features are hashed affixes, character n-grams, the word itself, its script and
its place in small lexicons; transitions are learned. Training maximises the
conditional likelihood by AdaGrad on forward-backward gradients; inference gives
the marginal of every label at every word.
"""

from __future__ import annotations

import zlib

import numpy as np

WIDTH = 1 << 17

# Frequent function words by language.
LEXICON = {
    "en": "the and of to is was for with that this from you your are not have will at on by it we be our or if they an as before after",
    "es": "el la los las de que y en un una por para con su se no es al del lo como pero más está este esta",
    "hinglish": "hai ka ki ke ko se mein aur par nahi ho kya aap aapka aapke yeh woh bhi tha thi raha karo lo ne hum mera tum",
    "hi": "है का की के को से में और पर नहीं हो क्या आप आपका आपके यह वह भी था थी रहा ने हम मेरा हैं कर लिए",
    "mr": "आहे चा ची चे ला ने आणि वर नाही हे ते मध्ये तुमच्या तुमचे माझे होते आम्ही करा कारण पण खूप",
    "bn": "এবং এর তে আপনার আমার কাছে থেকে আছে করুন হয় না আর যে আমরা ছিল এ",
    "ta": "மற்றும் இல் உங்கள் என் ஆனால் என்று உள்ளது அது இன்று நாங்கள் இருந்து செய்யுங்கள்",
}
LEXICON_OF = {w: tag for tag, words in LEXICON.items() for w in words.split()}
# Latin words that two of the lexicons hold say nothing.
for _w in {w for a in LEXICON for w in LEXICON[a].split() if sum(w in LEXICON[b].split() for b in LEXICON) > 1}:
    LEXICON_OF.pop(_w, None)


def script(word: str) -> str:
    o = ord(word[0])
    if o < 0x250:
        return "latin"
    if 0x900 <= o <= 0x97F:
        return "deva"
    if 0x980 <= o <= 0x9FF:
        return "beng"
    if 0xB80 <= o <= 0xBFF:
        return "taml"
    return "other"


def word_features(word: str) -> np.ndarray:
    """Hashed feature numbers of a word in lower case."""
    w = f"<{word}>"
    f = [f"w={word}", f"s={script(word)}"]
    if word in LEXICON_OF:
        f.append(f"l={LEXICON_OF[word]}")
    for n in (1, 2, 3, 4):
        if len(word) >= n:
            f += [f"p{word[:n]}", f"e{word[-n:]}"]
    f += [f"3{w[i:i + 3]}" for i in range(len(w) - 2)]
    return np.fromiter((zlib.crc32(x.encode()) & (WIDTH - 1) for x in f), dtype=np.int64, count=len(f))


class Crf:
    """Weights of one model; small enough to be sent to every worker."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = list(labels)
        self.w = np.zeros((WIDTH, k), np.float32)
        self.t = np.zeros((k, k), np.float32)
        self._cache: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {"labels": self.labels, "w": self.w, "t": self.t, "_cache": {}}

    def emission(self, word: str) -> np.ndarray:
        v = self._cache.get(word)
        if v is None:
            if len(self._cache) > 400_000:
                self._cache.clear()
            v = self._cache[word] = self.w[word_features(word)].sum(axis=0)
        return v

    def marginals(self, rows: list[list[str]]) -> list[np.ndarray]:
        """Per row an (words, labels) array of posterior marginals, by forward-backward."""
        out: list[np.ndarray | None] = [None] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        k = len(self.labels)
        for lo in range(0, len(order), 512):
            part = [i for i in order[lo : lo + 512] if rows[i]]
            for i in order[lo : lo + 512]:
                if not rows[i]:
                    out[i] = np.zeros((0, k), np.float32)
            if not part:
                continue
            lens = np.array([len(rows[i]) for i in part])
            e = np.zeros((len(part), int(lens.max()), k), np.float32)
            for r, i in enumerate(part):
                e[r, : lens[r]] = [self.emission(w) for w in rows[i]]
            m = _posterior(e, lens, self.t)[0]
            for r, i in enumerate(part):
                out[i] = m[r, : lens[r]]
        return out

    def fit(self, rows: list[list[str]], tags: list[np.ndarray], epochs: int = 4, batch: int = 128, rate: float = 0.2, l2: float = 1e-5, seed: int = 7) -> None:
        """``tags`` holds the label number of every word."""
        rng = np.random.default_rng(seed)
        k = len(self.labels)
        feats = {w: word_features(w) for w in {w for r in rows for w in r}}
        gw, gt = np.full((WIDTH, 1), 1e-4, np.float32), np.full((k, k), 1e-4, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                part = [i for i in order[lo : lo + batch] if rows[i]]
                if not part:
                    continue
                lens = np.array([len(rows[i]) for i in part])
                flat = [feats[w] for i in part for w in rows[i]]
                sizes = np.array([len(f) for f in flat])
                idx = np.concatenate(flat)
                at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                em = np.add.reduceat(self.w[idx], at, axis=0)
                e = np.zeros((len(part), int(lens.max()), k), np.float32)
                mask = np.arange(e.shape[1])[None, :] < lens[:, None]
                e[mask] = em
                m, pair = _posterior(e, lens, self.t, pairs=True)
                gold = np.concatenate([tags[i] for i in part])
                g = m[mask]
                g[np.arange(len(gold)), gold] -= 1
                ends = np.cumsum(lens) - 1
                prev = np.delete(np.arange(len(gold)), ends)
                np.subtract.at(pair, (gold[prev], gold[prev + 1]), 1)
                rep = np.repeat(g, sizes, axis=0)
                uniq, inv = np.unique(idx, return_inverse=True)
                dw = np.zeros((len(uniq), k), np.float32)
                for c in range(k):
                    dw[:, c] = np.bincount(inv, weights=rep[:, c], minlength=len(uniq))
                dw = dw / len(part) + l2 * self.w[uniq]
                gw[uniq] += (dw**2).mean(axis=1, keepdims=True)
                self.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
                dt = pair / len(part) + l2 * self.t
                gt += dt**2
                self.t -= rate * dt / np.sqrt(gt)
        self._cache.clear()


def _posterior(e: np.ndarray, lens: np.ndarray, t: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals by scaled forward-backward; with ``pairs`` the expected transition counts."""
    n, length, k = e.shape
    x = np.exp(e - e.max(axis=2, keepdims=True))
    a = np.exp(t - t.max())
    alpha, beta = np.empty_like(x), np.empty_like(x)
    alpha[:, 0] = x[:, 0] / x[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, length):
        v = (alpha[:, i - 1] @ a) * x[:, i]
        alpha[:, i] = v / (v.sum(axis=1, keepdims=True) + 1e-30)
    last = lens - 1
    beta[:, length - 1] = 1
    for i in range(length - 2, -1, -1):
        v = (x[:, i + 1] * beta[:, i + 1]) @ a.T
        v /= v.sum(axis=1, keepdims=True) + 1e-30
        beta[:, i] = np.where((i < last)[:, None], v, 1)
    m = alpha * beta
    m /= m.sum(axis=2, keepdims=True) + 1e-30
    if not pairs:
        return m, None
    total = np.zeros((k, k), np.float32)
    for i in range(length - 1):
        on = i < last
        p = alpha[on, i][:, :, None] * a[None] * (x[on, i + 1] * beta[on, i + 1])[:, None, :]
        total += (p / (p.sum(axis=(1, 2), keepdims=True) + 1e-30)).sum(axis=0)
    return m, total
