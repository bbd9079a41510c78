"""The operators' results by plain Python over small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None) -> set[tuple]:
    w = words((text or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def base_counts(text: str | None) -> tuple:
    w = words(text)
    seen = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    inside = {p for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w))


def components(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    """Smallest id reachable by links of similarity 0.75 or more."""
    sets = collections.defaultdict(list)
    for i, text in rows:
        sets[i].append(shingles(text))
    holders = collections.defaultdict(set)
    for i, own in sets.items():
        for s in own:
            for x in s:
                holders[x].add(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b] if x and y):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def kept_words(rows: list[tuple[int, str | None]], length: int = 20) -> dict[int, tuple[int, list[str]]]:
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = words(text)
        covered = set()
        for s in range(len(w) - length + 1):
            key = tuple(w[s:s + length])
            if key in seen:
                covered.update(range(s, s + length))
            seen.add(key)
        out[i] = (len(w), [x for k, x in enumerate(w) if k not in covered])
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaks(rows: list[tuple[int, str | None]], items: list[tuple[int, str | None]], percent: int = 75) -> set[tuple]:
    out = set()
    tests = [(k, shingles(t)) for k, t in items]
    for i, text in rows:
        own = shingles(text)
        out |= {(i, k, len(s), len(s & own)) for k, s in tests if s and 100 * len(s & own) >= percent * len(s)}
    return out


def _distance(p: list[float], q: list[float]) -> float:
    total = 0.0
    for x, y in zip(p, q):
        for a in (x, y):
            total += a * math.log2(a / ((x + y) / 2)) / 2 if a else 0
    return math.sqrt(min(1.0, max(0.0, total)))


def _classes(text: str) -> list[int]:
    kinds = [string.ascii_lowercase, string.ascii_uppercase, string.digits, " \t\n\v\f\r", ".,;:!?'\"()-"]
    out = [0] * 7
    for c in text:
        out[next((k for k, own in enumerate(kinds) if c in own), 5 if ord(c) < 128 else 6)] += 1
    return out


def quality(rows: list[tuple], rules) -> dict[int, tuple]:
    """Nearest language, word and character distance and verdict of each (id, text, lang)."""
    def shares(counts):
        return [n / (sum(counts) or 1) for n in counts]

    model = {}
    for name in sorted({lang for *_, lang in rows if lang is not None}):
        own = [text or "" for _, text, lang in rows if lang == name]
        seen = collections.Counter(w for text in own for w in words(text.translate(LOWER)))
        common = sorted(seen, key=lambda w: (-seen[w], w.encode()))[:rules.COMMON]
        known = [seen[w] / sum(seen.values()) for w in common]
        share = known + [max(0.0, 1 - sum(known))]
        bare = max(_distance([0.0] * len(common) + [1.0], share), 1e-9)
        model[name] = common, share, bare, shares([sum(c) for c in zip(*map(_classes, own))])
    out = {}
    for i, text, lang in rows:
        w, chars = words((text or "").translate(LOWER)), _classes(text or "")
        far, able, lacking = {}, {}, {}
        for name, (common, share, bare, _) in model.items():
            own = [w.count(x) for x in common]
            far[name] = _distance([x / max(1, len(w)) for x in own + [len(w) - sum(own)]], share)
            many = len(w) * (1 - share[-1]) >= rules.EXPECTED
            some = len(w) * math.log(max(share[-1], 1e-300)) <= math.log(rules.RARE)
            able[name] = many or some
            lacking[name] = (many and far[name] > rules.NEAR * bare) or (some and not sum(own))
        said = lang in model and not able[lang]
        lacks = any(able.values()) and all(lacking[x] or not able[x] for x in model) and not said
        open_to = [x for x in model if able[x]] or list(model)
        best = min(open_to, key=lambda x: far[x] / model[x][2])
        if said and lacking[best]:
            best = lang
        char_far = _distance(shares(chars), model[best][3])
        by_words, by_chars = len(w) >= rules.LEAST_WORDS, sum(chars) >= rules.LEAST_CHARS
        kept = (not base_counts(text)[-1] and not (by_words and (far[best] > rules.FAR_WORDS or lacks))
                and not (by_chars and char_far > rules.FAR_CHARS))
        out[i] = (best if w else None, far[best] if by_words else None, char_far if by_chars else None, kept)
    return out


def toxic_words(text: str | None) -> list[str]:
    return re.findall("[^\\x00-/:-@\\[-`{-\\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


class ToxicModels:
    """Two interpolated modified Kneser-Ney bigram models over shared continuation counts, from (text, class)."""

    def __init__(self, rows: list[tuple[str | None, int]]):
        self.pairs, self.of_words, self.after = ([collections.Counter(), collections.Counter()] for _ in range(3))
        for text, c in rows:
            words = toxic_words(text)
            for b, w in zip([None, *words], words):
                self.pairs[c][b, w] += 1
                self.of_words[c][w] += 1
                self.after[c][b] += 1
        self.different = collections.Counter(w for _, w in {*self.pairs[0], *self.pairs[1]})
        self.words = sorted(self.different)
        self.d_pairs, self.d_words = ([self._discounts(k) for k in of] for of in (self.pairs, self.of_words))
        self.left = [collections.Counter(), collections.Counter()]
        for c in (0, 1):
            for (b, _), n in self.pairs[c].items():
                self.left[c][b] += self.d_pairs[c][min(n, 3)]

    @staticmethod
    def _discounts(counts: collections.Counter) -> list[float]:
        have = collections.Counter(counts.values())
        y = have[1] / (have[1] + 2 * have[2]) if have[1] else 0.5
        out = [0.0]
        for k in (1, 2, 3):
            d = k - (k + 1) * y * have[k + 1] / have[k] if have[k] else k / 2
            out.append(min(max(d, 0.1), k - 0.1))
        return out

    def shared(self, w: str) -> float:
        return self.different.get(w, 1) / (sum(self.different.values()) + 1)

    def rest(self, c: int) -> float:
        return sum(self.d_words[c][min(n, 3)] for n in self.of_words[c].values()) / sum(self.of_words[c].values())

    def of_word(self, c: int, w: str) -> float:
        n = self.of_words[c].get(w, 0)
        return (n - self.d_words[c][min(n, 3)]) / sum(self.of_words[c].values()) + self.rest(c) * self.shared(w)

    def probability(self, c: int, b: str | None, w: str) -> float:
        if not self.after[c].get(b):
            return self.of_word(c, w)
        n = self.pairs[c].get((b, w), 0)
        return (n - self.d_pairs[c][min(n, 3)] + self.left[c][b] * self.of_word(c, w)) / self.after[c][b]

    def evidence(self, w: str) -> float:
        return math.log(self.of_word(1, w) / self.rest(1)) - math.log(self.of_word(0, w) / self.rest(0))
