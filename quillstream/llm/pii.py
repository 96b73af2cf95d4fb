"""Personal data: fixed patterns for four kinds, and a linear-chain conditional random field that adds spans.

The field runs over word-shape features. It is trained on the driver from a small labelled table (words, labels), which
the caller may bring; ``examples`` builds a standard one from templates. It is decoded by Viterbi in numpy batches, over all words of every text: a word for which O leads
every other label by more than any transitions could repay is O on the best path, and the path is sought in the runs
between such words.

Kinds: email, ip, card, phone (the base kinds) and secret (keys, passwords, tokens), which only the field finds.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import common

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *KINDS)
BITS = 15
#: Most rows of a labelled table that the fit takes, those of the smallest hash of their words: a bound on the driver's memory.
FIT_ROWS = 5000
#: Distinct words whose shares a worker remembers; beyond it the memory starts anew. It changes speed, never results.
REMEMBER = 400_000
#: Words whose emissions are computed at once.
WORDS = 50_000

# Patterns fixed by the contract.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, index of kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, in time linear in the text: from each @ outwards, not from each letter."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """The four kinds by their patterns, each kind leftmost and non-overlapping; matches that fail a test are dropped."""
    out: list[Span] = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the field's training table ------------------------------------------------------------------------------------
def examples(n: int = 1500, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Labelled word sequences from templates: spans of each kind in running words, and look-alikes that are none."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word(a: int = 1, b: int = 10) -> str:
        w = "".join(rng.choice(list(letters + "éèüñ"), int(rng.integers(a, b + 1))))
        return w.capitalize() if rng.random() < 0.15 else w

    def digits(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def key(k: int, chars: str) -> str:
        return "".join(rng.choice(list(chars), k))

    def name() -> str:
        return key(int(rng.integers(2, 8)), letters)

    def email() -> list[str]:
        domain, top = name() + ("" if rng.random() < 0.5 else digits(1)), str(rng.choice(["com", "org", "net", "de", "example.com"]))
        user = name() + str(rng.choice(["", "." + digits(2), "_" + name(), "." + name(), "+" + digits(1)]))
        return [[f"{user}@{domain}.{top}"], [user, "[at]", domain, "[dot]", top], [user, "(at)", domain, "(dot)", top], [f"{user}[at]{domain}[dot]{top}"], [user, "[at]", f"{domain}.{top}"]][rng.choice(5, p=[0.4, 0.2, 0.15, 0.1, 0.15])]

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        return [[f"+{rng.integers(1, 99)}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{rng.integers(1, 99)}-{a}-{b}-{c}"], [f"+{rng.integers(1, 99)}", a, b, c]][rng.choice(5)]

    def card() -> list[str]:
        return [[digits(16)], [digits(4), digits(4), digits(4), digits(4)], ["-".join(digits(4) for _ in range(4))]][rng.choice(3)]

    def ip() -> list[str]:
        return [".".join(str(x) for x in rng.integers(1, 256, 4))]

    def secret() -> tuple[list[str], list[int]]:
        kind = rng.integers(0, 4)
        if kind == 0:
            return [str(rng.choice(["password", "passwd", "secret", "token", "api_key"])) + "=" + key(int(rng.integers(12, 24)), "abcdef0123456789")], [5]
        if kind == 1:
            return [str(rng.choice(["token", "secret", "key", "password"])), "=", '"' + key(int(rng.integers(24, 44)), "abcdef0123456789") + '"'], [0, 0, 5]
        if kind == 2:
            return ["AKIA" + key(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ("234567" if rng.random() < 0.6 else ""))], [5]
        return [key(int(rng.integers(32, 44)), "abcdef0123456789")], [5]

    def harmless() -> list[str]:
        y = str(rng.integers(1900, 2030))
        return [[y], [digits(int(rng.integers(1, 6)))], [f"{rng.integers(1, 13)}.{rng.integers(0, 20)}"], [f"{y}-{rng.integers(10, 13)}-{rng.integers(10, 29)}"], ["version", f"{rng.integers(1, 4)}.{rng.integers(0, 9)}."], [word(3, 8) + digits(1)], [f"{digits(2)}%"], [f"{digits(1)},{digits(3)}"], ["License,", "Version", "2.0."], [str(rng.integers(1, 13)) + ":" + digits(2)], [digits(2) + "th"], ["@" + name()], ["page", digits(2), "of", digits(3)], [digits(2) + "x" + digits(2)]][rng.integers(0, 14)]

    out = []
    for _ in range(n):
        ws, ls = [], []
        for _ in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(1, 5))):
                ws.append(word() + str(rng.choice(["", "", "", ",", "."])))
                ls.append(0)
            k = rng.integers(0, 9)
            if k < 4:
                got = [email, ip, card, phone][k]()
                lab = [int(k) + 1] * len(got)
            elif k == 4:
                got, lab = secret()
            else:
                got, lab = harmless(), None
                lab = [0] * len(got)
            if rng.random() < 0.2:
                got = [*got[:-1], got[-1] + str(rng.choice([".", ",", ";", ")"]))]
            ws += got
            ls += lab
        ws.append(word() + ".")
        ls.append(0)
        out.append((ws, ls))
    return out


# --- features ------------------------------------------------------------------------------------------------------
_SQUEEZE = re.compile(r"(.)\1+")
_ENDS = (".", ",", ";", ":", "!", "?")


_ASCII = {c: "d" if 48 <= c < 58 else "X" if chr(c).isupper() else "x" if chr(c).isalpha() else chr(c) for c in range(128)}


def shape(w: str) -> str:
    if w.isascii():
        return w[:80].translate(_ASCII)
    return "".join("d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in w[:80])


def _hash(s: str) -> int:
    return (zlib.crc32(s.encode("utf-8", "replace")) * 2654435761 & 0xFFFFFFFF) >> (32 - BITS)


@functools.lru_cache(1000)
def _plain(n: int, capital: bool) -> tuple[str, ...]:
    """The features of a word of n letters, all small but perhaps the first, except those of its own letters."""
    s = "X" * capital + "x" * (n - capital)
    return ("b", "q" + _SQUEEZE.sub(r"\1", s), "n0", f"l{n // 4}", *(("s" + s,) if n <= 10 else ()))


def word_features(w: str) -> list[str]:
    """Shape features of one word; the sequence adds those of its neighbours."""
    core = w[:-1] if w[-1:] in _ENDS else w
    if core.isalpha() and len(core) < 12 and (core.islower() or core[0].isupper() and core[1:].islower()):  # most words, by a short way to the same features
        return [*_plain(len(core), core[0].isupper()), "w" + w.lower()[:12] if len(w.lower()) <= 8 else "w", "p"]
    core = w.strip(".,;:!?\"'()[]")
    s = shape(core)
    nd = s.count("d")
    hexa = len(core) >= 12 and all(c in "0123456789abcdefABCDEF" for c in core)
    out = ["b", "q" + _SQUEEZE.sub(r"\1", s)[:12], f"n{min(nd, 20)}", f"l{min(len(core), 64) // 4}"]
    if len(s) <= 10:
        out.append("s" + s)
    if "@" in core:
        out.append("@")
    if core.count(".") == 3 and nd >= 4:
        out.append("...")
    if hexa:
        out.append("hex")
    if nd and "X" in s and "x" not in s and len(s) >= 16:
        out.append("KEY")
    if "=" in core:
        out.append("=" + core.split("=", 1)[0].lower()[:12])
    low = w.lower()
    if "[at]" in low or "(at)" in low:
        out.append("at")
    if "[dot]" in low or "(dot)" in low:
        out.append("dot")
    if nd == 0:
        out.append("w" + low[:12] if len(low) <= 8 else "w")
    out.append("p" + w[:1] if not w[:1].isalnum() else "p")
    return out


#: A word's features as its own, as those of the word before, after and two before; what stands beyond a text's ends.
TAGS, EDGE = ("", "<", ">", "<<"), "\n"


def _ids(tag: str, w: str) -> np.ndarray:
    fs = word_features(w)[1:] if w != EDGE else ["edge"]
    return np.array([_hash(tag + f) for f in (fs if tag else ["b", *fs])], np.int32)


def feature_ids(ws: list[str]) -> list[np.ndarray]:
    padded = [EDGE, EDGE, *ws, EDGE]
    return [np.concatenate([_ids(tag, padded[i + 2 + j]) for tag, j in zip(TAGS, (0, -1, 1, -2), strict=True)]) for i in range(len(ws))]


class Field:
    """Weights of a linear-chain conditional random field: emissions by hashed feature, and transitions."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.emit, self.move, self.first = np.zeros((1 << BITS, n)), np.zeros((n, n)), np.zeros(n)
        self._forget()

    def _forget(self) -> None:
        """Shares are kept by the hash of a word, sorted; the first row is that of what stands beyond a text's ends."""
        self._keys, self._rows, self._shares = np.zeros(0, np.uint64), np.zeros(0, np.int64), self._shares_of([["b", "edge"]])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _shares_of(self, features: list[list[str]]) -> np.ndarray:
        """What words with these features add to their own emission, the next word's, the last one's and the one after next's."""
        names = {f: k for k, f in enumerate({f for fs in features for f in fs})}
        table = self.emit[[[_hash(tag + f) for tag in TAGS] for f in names]]
        table[names["b"], 1:] = 0  # the bias is the word's own
        table = table.astype(np.float32)
        lens = np.cumsum([0, *map(len, features)])
        return np.add.reduceat(table[[names[f] for fs in features for f in fs]], lens[:-1])

    def _shares_at(self, h: np.ndarray, words: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """Row in the table of shares of each distinct word hash; words(places) spells those that are new."""
        if len(self._keys) + len(h) > REMEMBER:
            self._forget()
        at = np.minimum(np.searchsorted(self._keys, h), max(len(self._keys) - 1, 0))
        new = np.flatnonzero(self._keys[at] != h) if len(self._keys) else np.arange(len(h))
        if len(new):
            first = len(self._shares)
            self._shares = np.concatenate([self._shares, self._shares_of([word_features(w) for w in words(new)])])
            keys, rows = np.concatenate([self._keys, h[new]]), np.concatenate([self._rows, np.arange(first, len(self._shares))])
            order = np.argsort(keys, kind="stable")
            self._keys, self._rows = keys[order], rows[order]
            at = np.searchsorted(self._keys, h)
        return self._rows[at]

    def _sought(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of concatenated texts: word offsets by text, row of each word's shares, and of the two words before each text's
        start as of all others, with edges between the texts; the place of each word there."""
        start, end, w = common.words(data, offsets) if len(data) else (np.zeros(0, np.int64),) * 2 + (np.zeros(len(offsets), np.int64),)
        u, first, inverse = np.unique(common.word_hashes(data, start, end), return_index=True, return_inverse=True)
        spell_ = lambda k: [data[start[i] : end[i]].tobytes().decode("utf-8", "replace") for i in first[k].tolist()]
        rows = self._shares_at(u, spell_)[inverse] if len(u) else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(w) - 1), np.diff(w))
        place = np.arange(len(rows)) + 3 * text + 2
        padded = np.zeros(len(rows) + 3 * (len(w) - 1), np.int64)
        padded[place] = rows
        return w, text, padded, place

    def _emissions_at(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = self._shares
        return x[padded[at], 0] + x[padded[at - 1], 1] + x[padded[at + 1], 2] + x[padded[at - 2], 3]

    def emissions(self, ws: list[str]) -> np.ndarray:
        data, offsets = common.utf8(pa.array([" ".join(ws)]))
        _, _, padded, place = self._sought(data, offsets)
        return self._emissions_at(padded, place)

    def decode(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The best labels of the words of each text."""
        return self.labels(*common.utf8(pa.array([" ".join(ws) for ws in texts], pa.string())))

    def labels(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The best labels of the words of each of the concatenated texts."""
        w, text, padded, place = self._sought(data, offsets)
        gain = np.maximum((self.move - self.move[:, :1]).max(0), self.first - self.first[0]) + np.maximum((self.move - self.move[:1]).max(1), 0)
        some, emitted = [np.zeros(0, np.int64)], [np.zeros((0, len(LABELS)), np.float32)]
        for at in range(0, len(place), WORDS):
            e = self._emissions_at(padded, place[at : at + WORDS])
            unsure = np.flatnonzero((e[:, :1] - e[:, 1:] <= gain[1:] + 1e-6).any(1))
            some.append(unsure + at)
            emitted.append(e[unsure])
        k, e = np.concatenate(some), np.concatenate(emitted).astype(float)
        out = np.zeros(len(place), np.int8)
        if len(k):
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1] + 1) | (text[k[1:]] != text[k[:-1]])
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(k))
            first = k[a] == w[text[k[a]]]
            e[a] += np.where(first[:, None], self.first, self.move[0])
            last = k[b - 1] + 1 == w[text[k[b - 1]] + 1]
            e[b[~last] - 1] += self.move[:, 0]
            out[k] = np.concatenate(self.paths([e[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]))
        return np.split(out, w[1:-1])

    def paths(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi of many runs of emissions at once, batched by length."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(runs)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        i = 0
        while i < len(order):
            most, j = len(runs[order[i]]), i
            while j < len(order) and len(runs[order[j]]) <= most + most // 2 + 4 and (j - i) * len(runs[order[j]]) <= 200_000:
                j += 1
            j = max(j, i + 1)
            part = order[i:j]
            lens = np.array([len(runs[k]) for k in part])
            e = np.zeros((len(part), lens.max(), len(LABELS)))
            for r, k in enumerate(part):
                e[r, : lens[r]] = runs[k]
            back = np.zeros(e.shape, np.int8)
            state = e[:, 0]
            for t in range(1, e.shape[1]):
                options = state[:, :, None] + self.move
                back[:, t] = options.argmax(1)
                state = np.where((t < lens)[:, None], options.max(1) + e[:, t], state)
            label = state.argmax(1)
            path = np.zeros(e.shape[:2], np.int8)
            rows = np.arange(len(part))
            for t in range(e.shape[1] - 1, -1, -1):
                live = t < lens
                path[live, t] = label[live]
                label = np.where(live, back[rows, t, label], label)
            for r, k in enumerate(part):
                out[k] = path[r, : lens[r]]
            i = j
        return out


def train(data: list[tuple[list[str], list[int]]], rounds: int = 12, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Maximum conditional likelihood by AdaGrad; the gradient is by forward and backward sums, padded batches of 64."""
    f, n = Field(), len(LABELS)
    rng = np.random.default_rng(1)
    feats = [feature_ids(ws) for ws, _ in data]
    seen = [np.full_like(p, 1e-6) for p in (f.emit, f.move, f.first)]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis, keepdims=True)
        return (np.log(np.exp(x - m).sum(axis, keepdims=True)) + m).squeeze(axis)

    for _ in range(rounds):
        order = rng.permutation(len(data))
        for k in range(0, len(order), 64):
            part = order[k : k + 64]
            lens = np.array([len(data[i][0]) for i in part])
            width = lens.max()
            e, gold = np.zeros((len(part), width, n)), np.zeros((len(part), width), int)
            for r, i in enumerate(part):
                for t, ids in enumerate(feats[i]):
                    e[r, t] = f.emit[ids].sum(0)
                gold[r, : lens[r]] = data[i][1]
            a, b = np.zeros(e.shape), np.zeros(e.shape)
            a[:, 0] = e[:, 0] + f.first
            for t in range(1, width):
                a[:, t] = np.where((t < lens)[:, None], lse(a[:, t - 1][:, :, None] + f.move, 1) + e[:, t], a[:, t - 1])
            for t in range(width - 2, -1, -1):
                b[:, t] = np.where((t + 1 < lens)[:, None], lse(f.move[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
            z = lse(a[:, -1], 1)
            live = np.arange(width)[None] < lens[:, None]
            p = np.exp(a + b - z[:, None, None]) * live[:, :, None]
            g = -p
            rr, tt = np.nonzero(live)
            g[rr, tt, gold[rr, tt]] += 1
            gm = np.zeros((n, n))
            for t in range(1, width):
                on = t < lens
                q = np.exp(a[on, t - 1][:, :, None] + f.move + (e[on, t] + b[on, t])[:, None, :] - z[on, None, None])
                gm -= q.sum(0)
                np.add.at(gm, (gold[on, t - 1], gold[on, t]), 1)
            ge = np.zeros_like(f.emit)
            for r, i in enumerate(part):
                for t, ids in enumerate(feats[i]):
                    np.add.at(ge, ids, g[r, t])
            for w, grad, s in zip((f.emit, f.move, f.first), (ge, gm, g[:, 0].sum(0)), seen, strict=True):
                grad = grad / len(part) - ridge * w
                s += grad**2
                w += rate * grad / np.sqrt(s)
    return f


# --- texts -----------------------------------------------------------------------------------------------------------
_TRIM_LEFT, _TRIM_RIGHT = "\"'([{<,;:#$%&*|", "\"')]}>,;:.!?#$%&*|"


def find_spans(texts: pa.Array, field: Field) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans, and all spans, of whole texts in code points, sorted by start and kind."""
    data, offsets = common.utf8(texts)
    signal = np.zeros(256, bool)
    signal[[*range(48, 58), ord("@")]] = True
    hits = signal[data] if len(data) else np.zeros(0, bool)
    has = np.flatnonzero(np.add.reduceat(np.append(hits, False).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0) > 0) if len(texts) else []
    brackets = np.flatnonzero(pc.match_substring_regex(pc.coalesce(texts, ""), r"(?i)[\[(](?:at|dot)[\])]").to_numpy(zero_copy_only=False))
    base: list[list[Span]] = [[] for _ in range(len(texts))]
    every: list[list[Span]] = [[] for _ in range(len(texts))]
    for i in np.union1d(has, brackets).astype(int).tolist():
        base[i] = base_spans(texts[i].as_py() or "")
        every[i] = list(base[i])
    for part, labels in labelled(texts, data, offsets, field):
        for i in part[[x.any() for x in labels]].tolist():
            text, labels_ = texts[i].as_py(), labels[i - part[0]]
            words = [m.span() for m in _WORD.finditer(text)]
            edges = [0, *(np.flatnonzero(np.diff(labels_)) + 1).tolist(), len(labels_)]
            at, reach = 0, 0  # base spans that begin before the decoded one's end, and how far they reach
            for t, u in zip(edges, edges[1:], strict=False):
                if k := int(labels_[t]):
                    a, b = trimmed(text, words[t][0], words[u - 1][1], k - 1)
                    while at < len(base[i]) and base[i][at][0] < b:
                        reach = max(reach, base[i][at][2])
                        at += 1
                    if a < b and reach <= a:
                        every[i].append((a, k - 1, b))
    return base, [sorted(x) for x in every]


_WORD = re.compile(common.WORD)


def labelled(texts: pa.Array, data: np.ndarray, offsets: np.ndarray, field: Field) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """All texts in parts of about a megabyte, a longer text alone: their numbers, and the labels of their words."""
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), "right")) - 1)
        yield np.arange(i, j), field.labels(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def trimmed(text: str, a: int, b: int, kind: int) -> tuple[int, int]:
    """A decoded span without quotes and end marks around it, and without the name that a secret is assigned to."""
    while a < b and text[a] in _TRIM_LEFT and not (kind == 3 and text[a] == "("):
        a += 1
    while b > a and text[b - 1] in _TRIM_RIGHT:
        b -= 1
    if kind == 4 and (equals := text.find("=", a, b)) >= 0:
        a = equals + 1
        while a < b and text[a] in _TRIM_LEFT:
            a += 1
    return a, b


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def labelled_table(spark: SparkSession, n: int = 1500, seed: int = 5) -> DataFrame:
    """The standard training table: words array<string>, labels array<int> (places in LABELS), a row a sentence."""
    return spark.createDataFrame([{"words": ws, "labels": ls} for ws, ls in examples(n, seed)], "words array<string>, labels array<int>")


def fit_field(table: DataFrame, limit: int = FIT_ROWS) -> Field:
    """The field of a labelled table (words, labels), of at most ``limit`` of its rows, those of the smallest hash.

    Rows that are null or empty, or whose words and labels differ in number, are left out; a null word is empty; labels
    outside LABELS count as O. An empty table gives a field that finds nothing.
    """
    some = table.select("words", "labels").where("size(words) > 0 AND size(words) = size(labels)")
    rows = some.orderBy(F.xxhash64("words", "labels"), "words", "labels").limit(limit).collect()  # at most ``limit`` rows
    kind = lambda x: x if x is not None and 0 <= x < len(LABELS) else 0
    return train([([w or "" for w in r["words"]], [kind(x) for x in r["labels"]]) for r in rows])


_field: list[Field] = []


def trained(spark: SparkSession) -> Field:
    """The field of the standard training table, fitted once a process."""
    if not _field:
        _field.append(fit_field(labelled_table(spark)))
    return _field[0]


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in capitals; spans that overlap are joined under the first's kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, field: Field, text: str = "text", redacted: bool = False) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone (base spans), base and spans (kind:start:end, comma-joined) to docs.

    With ``redacted`` the text column is replaced by the redacted text instead of being dropped. A null text has no
    spans (and stays null); texts are read whole, in time linear in their length; each row is judged alone, so repeated rows
    and ids are as many results; of decoded spans that overlap a base span the base one stays; an empty table gives no
    rows; columns named like the added ones are replaced.
    """
    added = ("n_email", "n_ip", "n_card", "n_phone", "base", "spans")
    keep = [c for c in docs.columns if c not in added and c != text]
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(len(keep))
            base, every = find_spans(t, shared.value)
            counts = [pa.array([sum(k == kind for _, k, _ in s) for s in base], pa.int64()) for kind in range(4)]
            cols = [*counts, pa.array(map(spell, base), pa.string()), pa.array(map(spell, every), pa.string())]
            names = [*keep, *added]
            if redacted:
                changed = [redact(t[i].as_py(), s) if s else t[i].as_py() for i, s in enumerate(every)]
                cols, names = [*cols, pa.array(changed, pa.string())], [*names, text]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=names)

    schema = docs.select(*keep).schema
    for c in added:
        schema = schema.add(c, "long" if c.startswith("n_") else "string")
    return docs.select(*keep, text).mapInArrow(run, schema.add(text, "string") if redacted else schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    found = find_pii(common.table(spark, sf_dir, "documents").select("doc_id", "text"), trained(spark))
    return found.selectExpr("doc_id", "n_email", "n_ip", "n_card", "n_phone", "sha2(base, 256) AS base_sha256", "spans")
