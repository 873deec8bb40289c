"""Plain versions of the operators, for small tables."""

import hashlib
import hmac
import math
import re
from collections import Counter, defaultdict

import xxhash


def repeats(rows, width=200):
    n = Counter()
    for _, t in rows:
        b = (t or "").encode()
        n.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if n[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text, words=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows, distance=3):
    prints = [(d, fingerprint(t)) for d, t in rows]
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, f"{p:016x}", least[root(i)]) for i, (d, p) in enumerate(prints))


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def bm25(rows, chosen, k=10, k1=1.2, b=0.75):
    """chosen: query -> set of words; the k best of all rows."""
    docs = [(d, Counter(words(t))) for d, t in rows]
    mean = sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    out = {}
    for q, ws in chosen.items():
        hits = []
        for d, c in docs:
            if any(w in c for w in ws):
                n = sum(c.values())
                hits.append((-sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * n / mean)) for w in ws if w in c), d))
        out[q] = [(d, -s) for s, d in sorted((round(s, 9), d) for s, d in hits)[:k]]
    return out


def near_kept(rows, width=5):
    """Smallest ids of the classes of all pairs whose shingles' Jaccard similarity is 0.8 or more."""
    sets = []
    for _, t in rows:
        found = words(t)
        sets.append({tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return set(least.values())


def mix(rows, weights, block_bytes, least=1000, longest=4000):
    """rows: (doc_id, source, n_bytes); weights: source -> weight. doc_id -> (block, slot), one slot after another."""
    key = lambda s: (s is not None, s or "")
    block, volume = {}, defaultdict(int)
    for d, s, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        block[d, s] = volume[s] // block_bytes
        volume[s] += n
    order = sorted(volume, key=key)
    w = {s: weights.get(s, min(weights.values())) if weights else math.sqrt(max(volume[s], 1)) for s in order}
    total = sum(w.values())
    w = {s: max(x / total, 1 / max(longest, len(w))) for s, x in w.items()}
    total = sum(w.values())
    w = {s: x / total for s, x in w.items()}
    slots = max(least, math.ceil(1 / min(w.values())))
    want, slot, period, done = {(s, b) for (_, s), b in block.items()}, {}, 0, dict.fromkeys(order, 0)
    while not want <= slot.keys():
        upto, n = 0.0, {}
        for s in order:
            whole = lambda x, p=period: math.floor((p + 1) * slots * round(x, 12) + 0.5)
            n[s] = whole(upto + w[s]) - whole(upto) - done[s]
            upto += w[s]
        here = dict.fromkeys(order, 0)
        for t in range(slots):
            due = [(-(-(here[s] + 1) * slots // n[s]), i) for i, s in enumerate(order) if here[s] < n[s] and here[s] * slots // n[s] <= t]
            s = order[min(due)[1]]
            slot[s, done[s] + here[s]] = period * slots + t
            here[s] += 1
        done = {s: done[s] + n[s] for s in order}
        period += 1
    return {k: (b, slot[k[1], b]) for k, b in block.items()}, slot, w


def best_fit(lengths, capacities, overhead):
    """Bin, its final capacity and start of each item: every open bin is looked at for every item."""
    bins, placed = [], []  # [capacity, used]
    for i, n in enumerate(lengths):
        rest = sum(lengths[i + 1 :])
        fits = [(c - u, b) for b, (c, u) in enumerate(bins) if c - u >= n]
        if fits:
            b = min(fits)[1]
        else:
            c = min((c for c in capacities if c >= n), key=lambda c: ((c + overhead) / (n + min(c - n, rest)), c))
            bins.append([c, 0])
            b = len(bins) - 1
        placed.append((b, bins[b][1]))
        bins[b][1] += n
    return [(b, min(c for c in capacities if c >= bins[b][1]), at) for b, at in placed]


def _key(key):
    return hmac.new(key.encode(), b"feistel", "sha256").hexdigest()


def feistel(a, b, left, right, key, back=False):
    move = lambda r, half: int(hashlib.sha256("|".join(map(str, (_key(key), r, left, right, half))).encode()).hexdigest()[:15], 16)
    for r in reversed(range(6)) if back else range(6):
        if r % 2 == 0:
            a = (a - move(r, b)) % left if back else (a + move(r, b)) % left
        else:
            b = (b - move(r, a)) % right if back else (b + move(r, a)) % right
    return a, b


def feistel_digits(digits, key, back=False):
    half = len(digits) // 2
    a, b = feistel(int(digits[:half]), int(digits[half:]), 10**half, 10 ** (len(digits) - half), key, back)
    return f"{a:0{half}d}{b:0{len(digits) - half}d}"


def feistel_text(text, key, classes, back=False):
    """classes: strings of characters that stand for one another."""
    half = -(-len(text) // 2)
    a, b = text[:half], text[half:]

    def shifted(x, other, r):
        stream = hashlib.sha256("|".join((_key(key), str(r), str(len(x)), other)).encode()).hexdigest()
        out = ""
        for i, c in enumerate(x):
            own = next((k for k in classes if c in k), None)
            k = int(stream[i % 62 : i % 62 + 3], 16)
            out += own[(own.index(c) + (-k if back else k)) % len(own)] if own else c
        return out

    for r in reversed(range(6)) if back else range(6):
        if r % 2 == 0:
            a = shifted(a, b, r)
        else:
            b = shifted(b, a, r)
    return a + b


def languages(rows, train, size=300):
    """rows: (doc_id, text); train: (text, lang). doc_id -> (language, score)."""

    def grams(text):
        marked = re.sub(r" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
        found = Counter()
        for n in (1, 2, 3):
            for i in range(len(marked) - n + 1):
                g = marked[i : i + n]
                if g.strip():
                    code = 0
                    for c in g:
                        code = code << 21 | ord(c)
                    found[code * 0x9E3779B97F4A7C15 % (1 << 64) >> 16] += 1
        return found

    top = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]
    counts = defaultdict(Counter)
    for text, lang in train:
        counts[lang].update(grams(text))
    profiles = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in sorted(counts.items())}
    out = {}
    for d, text in rows:
        mine = top(grams(text or ""))
        if not mine:
            out[d] = ("und", 0.0)
            continue
        apart = {lang: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(mine)) for lang, p in profiles.items()}
        lang = min(apart, key=lambda k: (apart[k], k))
        out[d] = (lang, 1 - apart[lang] / (len(mine) * size))
    return out


def quality(text, weights, bias):
    """A document's score by its features one by one."""
    found, base = [], 0x100000001B3
    padded = text + b"\n\n\n"
    for i in range(len(text)):
        three, four = int.from_bytes(padded[i : i + 3], "big"), int.from_bytes(padded[i : i + 4], "big")
        found += [three * 0x9E3779B1 % (1 << 32) >> 16, four * 0x85EBCA6B % (1 << 32) >> 16]
    for word in re.findall(rb"[^\x20\x09-\x0D]+", text):
        found.append(sum((c + 1) * pow(base, i, 1 << 64) for i, c in enumerate(word)) * 0x9E3779B97F4A7C15 % (1 << 64) >> 48)
    mean = sum(float(weights[b]) for b in found) / max(len(found), 1)
    return 1 / (1 + math.exp(-(mean + bias)))
