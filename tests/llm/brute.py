"""Plain re-statements of the operators' contracts, for small inputs."""
import hashlib
import re
from collections import defaultdict

TERM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def terms(text):
    return TERM.findall(lower(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items, window=10):
    windows = defaultdict(set)
    for name, text in items:
        w = terms(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(name)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, names = terms(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= found
        names = sorted(str(x) for x in names if x is not None)
        out.append((doc_id, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def substring(docs, window=50):
    first = {}
    words = [(d, TOKEN.findall(t or "")) for d, t in docs]
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            if d is not None and d < first.get(k, d + 1):
                first[k] = d
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def licenses(docs):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    out = []
    for d, t in docs:
        w = terms(t)
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i:i + len(p)]) == p]
        places = [i for i, _ in at]
        out.append((d, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    return out


def fingerprint(text):
    import xxhash

    w = TOKEN.findall(lower(text))
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=4):
    """prints: (doc_id, fingerprint) pairs. The least doc_id that links reach, for each row."""
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f"{f:016x}", least.get(find(f))) for d, f in prints]
