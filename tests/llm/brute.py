"""Plain versions of the operators, on small inputs."""

import hashlib
import re
import zlib

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {c: c + 32 for c in range(65, 91)}


def words(text, pattern=SPACED, lower=False):
    t = text or ""
    return pattern.findall(t.translate(UP) if lower else t)


def quality(text):
    w = words(text)
    tri = {}
    for i in range(len(w) - 2):
        tri.setdefault(tuple(w[i : i + 3]), []).append(i)
    rep = {j for at in tri.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    base = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep), base


def contaminated(text, items):
    d, hit, found = words(text, ALNUM, True), set(), set()
    for item, t in items:
        b = words(t, ALNUM, True)
        n = min(len(b), 13)
        if not n or item is None:
            continue
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        for i in range(len(d) - n + 1):
            if tuple(d[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(d), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(d)


def shingles(text):
    w = words(text, SPACED, True)
    if 0 < len(w) < 5:
        return {tuple(w)}
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(rows):
    """{doc_id: component} of (doc_id, text) rows with ids."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: find(i) for i, _ in rows}


def digest(i, text):
    """Of a text under its id: the order of different texts of one id."""
    raw = (text or "").encode()
    seed = 42
    if i is None:  # the engine chains the digest behind that of the number 1
        seed = xxhash.xxh64((1).to_bytes(4, "little"), seed=42).intdigest()
    if text is None:
        return seed
    return int.from_bytes(xxhash.xxh64(raw, seed=seed).digest(), "big", signed=True)


def dedup(rows):
    """{(doc_id, text): (n_words, n_removed, sha)}."""
    first, out = {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, digest(*r))):
        w, gone = words(t), set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if first.setdefault(key, (i, t, k)) != (i, t, k):
                gone |= set(range(k, k + 20))
        out[i, t] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def secrets(text):
    t, out = text or "", []
    for kind, pattern, group, least in (
        ("assign", r"""((?:(?:[pP][aA][sS][sS][wW][oO][rR][dD])|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, t) if len(m[group]) >= least]
    out.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
    n = [sum(k == x for k, _, _ in out) for x in ("assign", "access", "hex")]
    return (*n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in out).encode()).hexdigest())


def runs(w, least):
    """(start, length, period) of every run of the words w."""
    n, out = len(w), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            e = i + p
            if e - s >= max(least, 2 * p) and not any(w[s : e - q] == w[s + q : e] for q in range(1, p)):
                out.add((s, e - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(i, text):
    """The contract's columns of the periodic text of one document, without its id."""
    w = words(text)
    n, h = len(w), zlib.crc32(str(i).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    found = runs(w, 12)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))
    if not found:
        return (0, None, None, None, None, *digests)
    s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2]))
    return (len(found), s, m, q, 1000 * m // q, *digests)


def filters(i, text, first):
    """Letters of the audit's filters that a text fails; first: the smallest id of each text."""
    t, w = text or "", words(text)
    fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in first and i > first[t]}
    return {k for k, v in fails.items() if v}
