"""Plain-Python statements of the operators' contracts, for small tables."""
import collections
import hashlib
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_az(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def repeats(texts, window=200):
    """[(n_bytes, n_removed, n_spans, kept bytes)] of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[p:p + window] for r in raw for p in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for p in range(len(r) - window + 1):
            if seen[r[p:p + window]] > 1:
                gone[p:p + window] = [True] * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines, alphabetic words)."""
    t = text or ""
    w = SPACE_WORD.findall(t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    mark = set()
    for i in range(len(w) - 2):
        if c[tuple(w[i:i + 3])] > 1:
            mark |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
    alpha = sum(bool(re.search("[A-Za-z\u0080-\U0010ffff]", x)) for x in w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(mark), len(lines), alpha


def good(text):
    n, chars, sym, dup, rep, lines, alpha = quality(text)
    return not (n < 50 or 100 * rep > 50 * n or 10 * sym > n or 2 * dup > lines or chars < 2 * n or chars > 20 * n or 2 * alpha < n)


def shingles(text):
    w = SPACE_WORD.findall(lower_az(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(rows, percent=85):
    """[(id, text)] -> {id: (n_shingles, component)}; ids are distinct."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    for i, s in sets.items():
        shared = collections.Counter(j for x in s for j in by[x] if j < i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contamination(text, items):
    """(n_words, n_hit, sorted ids as strings) of a text against [(item id, text)]."""
    w = ALNUM_WORD.findall(lower_az(text or ""))
    hit, ids = set(), set()
    for item, t in items:
        v = ALNUM_WORD.findall(lower_az(t or ""))
        m = min(13, len(v))
        wins = {tuple(v[i:i + m]) for i in range(len(v) - m + 1)} if v else set()
        for i in range(len(w) - m + 1) if m else ():
            if tuple(w[i:i + m]) in wins:
                hit |= set(range(i, i + m))
                ids.add(str(item))
    return len(w), len(hit), sorted(ids)


def sha(data):
    return hashlib.sha256(data).hexdigest()
