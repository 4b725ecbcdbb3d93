"""Plain versions of the contracts, for small inputs."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=4):
    w = words((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def components(docs, k=4, percent=80):
    sets = [(i, shingles(t, k)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(sets[a][0]), root(sets[b][0])))
                parent[q] = p
    return {(i, len(s), root(i), root(i) == i) for i, s in sets}


def quality(text):
    w = words(text)
    n = len(w)
    count = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    hit = set()
    for i in range(n - 7):
        if count[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words(x)]
    base = n < 20 or 100 * len(hit) > 30 * n
    return n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), base


def packed(docs, tokenizer):
    out = {}
    for i, t in docs:
        out[i] = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    return out


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc(pages):
    first = {}
    for i, html in sorted(pages):
        first.setdefault((html or "").encode(), i)
    out = set()
    for i, html in pages:
        p = (html or "").encode()
        same = first[p] == i
        out.add((i, len(p), sha1(p), "response" if same else "revisit", None if same else first[p]))
    return out


def chat(turns):
    convs = defaultdict(list)
    for conv, turn, role, text in turns:
        convs[conv].append((turn, role, text or ""))
    out = set()
    for conv, rows in convs.items():
        rows.sort()
        said = "".join(t for _, r, t in rows if r == "assistant")
        body = "".join(f"{r}\n{t}\n" for _, r, t in rows)
        out.add((conv, len(rows), hashlib.sha256(body.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return out


def removed(units, width):
    """units: [(key, sequence)] in order; the mask of units that a repeated window covers, for each."""
    seen, masks = set(), []
    for _, x in units:
        mask = [False] * len(x)
        for i in range(len(x) - width + 1):
            w = tuple(x[i : i + width]) if not isinstance(x, bytes) else x[i : i + width]
            if w in seen:
                mask[i : i + width] = [True] * width
            seen.add(w)
        masks.append(mask)
    return masks


def substring(docs):
    rows = sorted((i, words(t)) for i, t in docs)
    out = set()
    for (i, w), mask in zip(rows, removed(rows, 20), strict=True):
        kept = " ".join(x for x, m in zip(w, mask, strict=True) if not m)
        out.add((i, len(w), sum(mask), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffix(docs, width=100):
    rows = sorted((i, (t or "").encode()) for i, t in docs)
    out = set()
    for (i, b), mask in zip(rows, removed(rows, width), strict=True):
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        spans = sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))
        out.add((i, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def nearest(vectors, every=50, k=5):
    import math

    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in good:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(found, 1)}
    return out


def fingerprint(text, k=3):
    import xxhash

    w = words((text or "").translate(LOWER))
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs, distance=3):
    rows = [(i, fingerprint(t)) for i, t in docs]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= distance:
                p, q = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[q] = p
    return {(i, f"{f:016x}", root(i)) for i, f in rows}


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lexical(docs, items, k=10):
    import math

    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n_all, l_all = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(TERM.findall((t or "").translate(LOWER)))
    for item, terms in asked.items():
        found = []
        for i, b, n in bags:
            m = 10 + 90 * n * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if b[t])
            if s > 0:
                found.append((-s, i is None, i, s))
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def spliced(doc_id, w):
    """The words of a document of the run detector's contract."""
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def word_runs(w):
    """Every run as (start, length, period)."""
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, length, q) for (s, length), q in best.items())


def runs(doc_id, text):
    w = spliced(doc_id, words(text))
    found = word_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(found, key=lambda r: (r[0], r[2])))
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    head = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return (doc_id, len(found), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
