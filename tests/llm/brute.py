"""The contracts restated in plain Python, for small tables."""

import hashlib
import re
from collections import Counter

import xxhash

ASCII = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return (t or "").translate(ASCII)


def fingerprint(text):
    w = SPACED.findall(low(text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(docs):
    """doc_id -> (fingerprint, component) of [(doc_id, text)] with distinct ids."""
    fp = {d: fingerprint(t) for d, t in docs}
    root = {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{fp[d]:016x}", find(d)) for d in ids}


def jaccard(a, b, words=5):
    """Similarity of two texts' sets of word shingles; a text of fewer words is one shingle."""
    a, b = ({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if (w := SPACED.findall(low(t))) else set() for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def similar(docs, least=0.8):
    """doc_id -> smallest doc_id reachable over links of similarity least, of [(doc_id, text)] with distinct ids."""
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, t) in enumerate(docs):
        for b, u in docs[i + 1 :]:
            if jaccard(t, u) >= least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in root}


def contamination(docs, items, window=13):
    """[(n_words, n_hit, n_items, sha, contaminated)] for texts, by every window of every item."""
    wins = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[s : s + window]), set()).add(str(i))
    out = []
    for t in docs:
        w, hit, ids = ALNUM.findall(low(t)), set(), set()
        for n in {len(k) for k in wins}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in wins:
                    hit.update(range(p, p + n))
                    ids |= wins[k]
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    rep = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def pii(text):
    """The base spans (kind, start, end), by kind, then start."""
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return out


def url(u):
    """(host, path)."""
    u = u or ""
    if "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return host.translate(ASCII), re.match("[^?#]*", rest[len(host) :])[0]


def rule(host, path, rules):
    """(pattern, verdict) of the longest that fits."""
    fit = [(len(p), p, v) for v, p in rules for h, _, s in [p.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + s)]
    return max(fit)[1:] if fit else (None, None)


def stripped(docs, ratio, least):
    """[text] of [(host, text)] without boilerplate lines."""
    pages, has = {}, {}
    for h, t in docs:
        pages.setdefault(h or "", set()).add(t)
    for h, ts in pages.items():
        for t in ts:
            for x in {x for x in (t or "").split("\n") if SPACED.search(x)}:
                has[h, x] = has.get((h, x), 0) + 1
    out = []
    for h, t in docs:
        h = h or ""
        kept = [x for x in (t or "").split("\n") if not SPACED.search(x) or not (has[h, x] >= least and has[h, x] > ratio * len(pages[h]))]
        out.append("\n".join(kept) if any(map(SPACED.search, kept)) else t)
    return out


def round_robin(queues, windows):
    """[(source, place in its queue)] in the order in which they are sent; queues: source -> token counts, windows: source -> rounds in which it is sent."""
    from fractions import Fraction

    deficit, at, out = {s: Fraction(0) for s in queues}, {s: 0 for s in queues}, []
    while any(at[s] < len(q) for s, q in queues.items()):
        for s in sorted(queues):
            if at[s] == len(queues[s]):
                continue
            deficit[s] += Fraction(sum(queues[s]), windows[s])
            while at[s] < len(queues[s]) and deficit[s] >= 1:
                deficit[s] -= queues[s][at[s]]
                out.append((s, at[s]))
                at[s] += 1
    return out
