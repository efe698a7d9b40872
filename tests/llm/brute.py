"""Plain versions of the corpus operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(AZ))


def suffix_dedup(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest())
    return out


def quality(text):
    b = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    n, at = len(w), defaultdict(list)
    for i in range(n - 4):
        at[tuple(w[i : i + 5])].append(i)
    best = {}
    for group in at.values():
        for x in group:
            for y in group:
                if x != y:
                    k = 0
                    while max(x, y) + k < n and w[x + k] == w[y + k]:
                        k += 1
                    best[x] = max(best.get(x, 0), k)
    covered = lambda least: len({j for p, k in best.items() if k >= least for j in range(p, p + k)})
    lines = [x for x in b.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    return {"n_words": n, "word_chars": sum(len(x.decode()) for x in w), "n_symbols": len(re.findall(rb"[#*$%&|<>]", b)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": covered(5), "n_long_repeat_words": covered(10), "longest_repeat": max(best.values(), default=0)}


def jaccard(rows, n=5, percent=80):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links.update((a, b))
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii(text):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = lambda: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(), "phone": lambda: 9 <= len(d) <= 15}[kind]()

    spans = [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if good(k, m.group())]
    return [sum(s[0] == k for s in spans) for k in PII] + [hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()]


def lm(rows, discounts, order=2):
    tokens = {i: [*words(t), "</s>"] for i, t in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for i in train for w in tokens[i])
    grams = {order: Counter()}
    for i in train:
        padded = ["<s>"] * (order - 1) + tokens[i]
        grams[order].update(tuple(padded[k : k + order]) for k in range(len(tokens[i])))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    total, types = sum(uni.values()), len(uni)
    d = {n: discounts([sum(c == k for c in g.values()) for k in (1, 2, 3, 4)]) for n, g in grams.items()}
    after = {n: defaultdict(list) for n in grams}
    for n, g in grams.items():
        for x, c in g.items():
            after[n][x[:-1]].append(c)

    def probability(n, history, w):
        if n == 0:
            return 1 / (types + 1)
        counts = after[n].get(history)
        if not counts:
            return probability(n - 1, history[1:], w)
        c = grams[n][(*history, w)]
        rest = sum(d[n][min(x, 3)] for x in counts) / sum(counts)
        return max(c - d[n][min(c, 3)], 0) / sum(counts) + rest * probability(n - 1, history[1:], w)

    out = {}
    for i, ts in tokens.items():
        padded = ["<s>"] * (order - 1) + ts
        base = sum(math.log10((uni[w] + 1) / (total + types + 1)) for w in ts)
        score = sum(math.log10(probability(order, tuple(padded[k : k + order - 1]), w)) for k, w in enumerate(ts))
        out[i] = (i not in train, len(ts), sum(uni[w] > 0 for w in ts), total, base, score)
    return out
