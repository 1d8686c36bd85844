"""Plain versions of the operators, for small inputs."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict
from zlib import crc32

#: Nulls in every column, empty and blank texts, copies, repeated rows, a long text and repeated passages.
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def rows(seed=3, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "and", "Zeit", "für", "a.", "b|", "#x"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    out = [(i, text(rng.randint(1, 90)), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "é"])) for i in range(n)]
    out += [(n, None, "en", "s1"), (n + 1, "", "en", None), (n + 2, " \n\t ", None, "s2"), (n + 3, out[0][1], "en", "s1"), (n + 4, out[1][1] + " more", "en", "s1")]
    out += [(n + 5, text(5) + " " + PASSAGE, "en", "s2"), (n + 6, PASSAGE + "\n" + text(4), "de", "s2"), (n + 7, "x " * 50, "en", "s3"), (n + 8, "a b " * 40, "en", "s3")]
    out += [(n + 9, text(30_000), "en", "s1"), out[5], out[5], (None, text(40), None, None), (n + 10, "!!! ... 123", "en", "s1"), (n + 11, "tail <|endoftext|> it's ok   x", "en", "s1")]
    return out


def words(text):
    return (text or "").encode().split()


def held(doc_id, parts, part):
    return doc_id is not None and crc32(str(doc_id).encode()) % parts == part


def remove_repeats(docs, width=20):
    """(words, removed, sha256) of each row; rows of one id count in their order."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, 0))
    first = {}
    for i in order:  # of rows with one id, the smaller start is first, then the earlier row
        w = words(docs[i][1])
        for k in range(len(w) - width + 1):
            key, at = tuple(w[k : k + width]), (docs[i][0] is None, docs[i][0] or 0, k, i)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, d in enumerate(docs):
        w = words(d[1])
        gone = bytearray(len(w))
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] != (d[0] is None, d[0] or 0, k, i):
                gone[k : k + width] = b"\1" * width
        out.append((d[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def classes(docs, similarity=0.8):
    """Group number of each row."""
    sets = [shingles(d[1]) for d in docs]
    group = list(range(len(docs)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        same = words(docs[i][1]) == words(docs[j][1])
        if sets[i] and sets[j] and (same or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9):
            group[find(j)] = find(i)
    return [find(i) for i in range(len(docs))]


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    spots = defaultdict(list)
    for i in range(len(w) - 7):
        spots[tuple(w[i : i + 8])].append(i)
    covered = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(8)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def mixture_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """sizes: source -> size; targets by repeated clamping."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and weight[s] * rest / open_weight > cap * sizes[s] + 1e-9}
        if not over:
            return {s: cap * sizes[s] if s in capped else weight[s] * rest / open_weight for s in order}
        capped |= over


def base_scores(docs):
    toks = lambda x: (x or "").encode().lower().split() + [b""]
    c = Counter()
    for d in docs:
        if not held(d[0], 5, 1):
            c.update(toks(d[1]))
    n, v = sum(c.values()), len(c)
    score = lambda x: sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks(x))
    return n, [(d[0], len(toks(d[1])), sum(c[t] > 0 for t in toks(d[1])), score(d[1])) for d in docs]


def token_counts(docs):
    c = Counter()
    for d in docs:
        if not held(d[0], 5, 1):
            c.update((d[1] or "").encode().lower().split() + [b""])
    return c


def model_scores(docs, symbols, p, classes, counts, shape):
    """(id, tokens, log10 probability): a softmax over all symbols for each token, and a word's share of its class."""
    out = []
    for d in docs:
        w = (d[1] or "").encode().lower().split() + [b""]
        total, cache = 0.0, {}
        number = lambda x, kind, at, most: at[x] if at.get(x, most) < most else most + kind
        sym = [number(x, shape(x), symbols.at, symbols.short) for x in w]
        group = [number(x, shape(x), symbols.at, symbols.groups - len(classes)) for x in w]
        for i, x in enumerate(w):
            far, near = (group[i - 2] if i > 1 else symbols.groups), (sym[i - 1] if i else symbols.n)
            if (far, near) not in cache:
                z = (p.far[far] + p.near[near]).astype(float) @ p.target[:, :-1].T.astype(float) + p.target[:, -1]
                cache[far, near] = z - math.log(sum(math.exp(v) for v in z))
            total += cache[far, near][sym[i]] / math.log(10)
            if sym[i] >= symbols.short:
                own = classes[sym[i] - symbols.short]
                total += math.log10((counts[x] + 0.5) / (sum(own) + 0.5 * (len(own) + 1)))
        out.append((d[0], len(w), total))
    return out
