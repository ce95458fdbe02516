"""Plain versions of what the operators compute, and shared small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, None, None)[:4] for r in rows]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in full], COLUMNS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_groups(rows):
    """doc_id -> (n_shingles, component, kept)."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = top(a), top(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


class Bigrams:
    """Interpolated modified Kneser-Ney, as in the textbook."""

    def __init__(self, texts):
        tokens = [self.tokens(t) for t in texts]
        self.counts = Counter(w for t in tokens for w in t)
        self.total, self.size = sum(self.counts.values()), len(self.counts)
        self.pairs = Counter(p for t in tokens for p in zip(["<s>", *t], t))
        self.follows = Counter(b for _, b in self.pairs)
        self.contexts = defaultdict(lambda: [0, 0, 0, 0])
        for (a, _), c in self.pairs.items():
            self.contexts[a][0] += c
            self.contexts[a][min(c, 3)] += 1
        self.d_pair, self.d_word = self.discounts(self.pairs), self.discounts(self.follows)
        self.types = sum(self.follows.values())

    @staticmethod
    def tokens(text):
        return [*words(text), ("end",)]

    @staticmethod
    def discounts(counter):
        n = [sum(c == k for c in counter.values()) for k in (1, 2, 3, 4)]
        if min(n) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *[min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3)]]

    def word(self, w):
        if not self.types:
            return 1 / (self.size + 1)
        left = sum(self.d_word[min(c, 3)] for c in self.follows.values()) / self.types
        return max(self.follows[w] - self.d_word[min(self.follows[w], 3)], 0) / self.types + left / (self.size + 1)

    def probability(self, a, b):
        if a not in self.contexts:
            return self.word(b)
        total, *kinds = self.contexts[a]
        left = sum(d * k for d, k in zip(self.d_pair[1:], kinds)) / total
        return max(self.pairs[a, b] - self.d_pair[min(self.pairs[a, b], 3)], 0) / total + left * self.word(b)

    def score(self, text):
        t = self.tokens(text)
        return sum(math.log10(self.probability(a, b)) for a, b in zip(["<s>", *t], t))

    def base(self, text):
        return sum(math.log10((self.counts[w] + 0.5) / (self.total + 0.5 * (self.size + 1))) for w in self.tokens(text))


class ByteTrees:
    """Prediction by partial matching, byte by byte, for one language."""

    def __init__(self, texts, order):
        self.order, self.after = order, defaultdict(Counter)
        for text in texts:
            data = b"\n" * order + text.encode()
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.after[data[i - k:i]][data[i]] += 1

    def bits(self, text):
        data, total = b"\n" * self.order + text.encode(), 0.0
        for i in range(self.order, len(data)):
            for k in range(self.order, -1, -1):
                seen = self.after.get(data[i - k:i])
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if data[i] in seen:
                    total += math.log2((n + d) / seen[data[i]])
                    break
                total += math.log2((n + d) / d)
            else:
                total += 8
        return total


def fitting(rows, order, limit):
    """Rows (id, text, lang, source, n_chars) that some language fits."""
    langs = sorted({r[2] for r in rows if r[2] is not None and r[1] is not None})
    trees = {lang: ByteTrees([r[1] for r in rows if r[2] == lang and r[1] is not None], order) for lang in langs}
    return [r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and min(t.bits(r[1]) for t in trees.values()) <= limit * len(r[1].encode())]


def without_site_lines(rows, ratio=0.1, least=3):
    pages, seen = defaultdict(set), defaultdict(Counter)
    for _, text, _, source, _ in rows:
        pages[source].add(text)
    for source, texts in pages.items():
        for text in texts:
            seen[source].update(set((text or "").split("\n")) if text is not None else ())
    out = []
    for i, text, lang, source, n in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (seen[source][x] >= least and seen[source][x] > ratio * len(pages[source]))]
        out.append((i, "\n".join(kept), lang, source, len("\n".join(kept)) if kept != lines else n))
    return out


def one_of_each_group(rows):
    groups = near_groups([(r[0], r[1]) for r in rows])
    first = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        if groups[r[0]][2]:
            first.setdefault(r[0], r)
    return list(first.values())


def mixed(rows, seed=17):
    def unit(*parts):
        return int(hashlib.md5(":".join("" if p is None else str(p) for p in (seed, *parts)).encode()).hexdigest()[:13], 16) / 2**52

    counts = Counter(r[3] for r in rows)
    out = []
    for r in rows:
        rate = len(rows) * (1 / len(counts)) / counts[r[3]]
        u, k, p = unit(r[3], r[0]), 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        out += [r] * k
    return out
