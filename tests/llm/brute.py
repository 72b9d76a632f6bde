"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def decontaminate(docs, items, n=10):
    windows = defaultdict(set)
    for i, text in items:
        words = ITEM.findall((text or "").translate(LOWER))
        k = min(n, len(words))
        for p in range(len(words) - k + 1) if k else ():
            windows[tuple(words[p : p + k])].add(str(i))
    out = {}
    for d, text in docs:
        words, hit, found = ITEM.findall((text or "").translate(LOWER)), set(), set()
        for k in {len(w) for w in windows}:
            for p in range(len(words) - k + 1):
                if (own := windows.get(tuple(words[p : p + k]))) is not None:
                    hit.update(range(p, p + k))
                    found |= own
        out[d] = (len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def substrings(docs, n=20):
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda x: x[0]):
        words, gone = WORD.findall(text or ""), set()
        for p in range(len(words) - n + 1):
            w = tuple(words[p : p + n])
            if w in seen:
                gone.update(range(p, p + n))
            seen.add(w)
        out[d] = (len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def suffixes(docs, n=400):
    count, out = Counter(), {}
    docs = [(d, (t or "").encode()) for d, t in docs]
    for _, b in docs:
        count.update(b[p : p + n] for p in range(len(b) - n + 1))
    for d, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def lines(docs, chars=40, least=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for d, text in docs:
        for x in (text or "").split("\n"):
            if len(key(x)) >= chars:
                holders[key(x)].add(d)
    out = {}
    for d, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if not (len(holders.get(key(x), ())) >= least and max(holders[key(x)]) != d)]
        out[d] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    rep = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    own = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(rep) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(own) - len(set(own)), len(rep), failed


def shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def weight(grams):
    return sum(len(" ".join(g).encode()) for g in grams)


def near(docs, least=0.8):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and weight(a & sets[j]) >= least * weight(a | sets[j]) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        groups[find(i)].append(d)
    return {d: min(g) for g in groups.values() for d in g}


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def vocabulary(docs, divisor=199, chars=6, least=5):
    count = Counter()
    for d, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % divisor == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= chars and n >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_words(words):
    words = sorted(words)
    return {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and one_apart(a, b)}


def spelling(count, ratio=5):
    near = defaultdict(list)
    for a, b in near_words(count):
        near[a].append(b)
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= ratio * n else None
    out = {}
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), count.get(form[w]))
    return out
