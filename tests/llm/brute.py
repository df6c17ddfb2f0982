"""Plain versions of the operators on lists of rows, written for clearness."""

from __future__ import annotations

import hashlib
import re

from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ENDS = " \t\n\v\f\r"


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def line_dedup(docs, min_chars=20, min_docs=3):
    """(doc_id, text) -> (doc_id, lines, dropped, text left) per row."""
    holders = defaultdict(set)
    split = [(d, (t or "").split("\n")) for d, t in docs]
    keys = [[lower(x.strip(ENDS)) for x in lines] for _, lines in split]
    for (d, _), ks in zip(split, keys):
        for k in ks:
            if len(k) >= min_chars:
                holders[k].add(d)
    out = []
    for (d, lines), ks in zip(split, keys):
        kept = [
            x for x, k in zip(lines, ks)
            if len(holders.get(k, ())) < min_docs or max(holders[k]) == d
        ]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def window_dedup(docs, length=50):
    """(doc_id, text) -> (doc_id, words, removed, words left joined) per row."""
    first = {}
    split = [(d, words(t)) for d, t in docs]
    for d, ws in split:
        for i in range(len(ws) - length + 1):
            key = tuple(ws[i : i + length])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, ws in split:
        gone = set()
        for i in range(len(ws) - length + 1):
            if first[tuple(ws[i : i + length])] < d:
                gone.update(range(i, i + length))
        left = [w for i, w in enumerate(ws) if i not in gone]
        out.append((d, len(ws), len(gone), " ".join(left)))
    return out


def shingles(text, n):
    ws = words(lower(text or ""))
    if not ws:
        return set()
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))}


def near_components(docs, n, percent):
    """(key, text) with distinct keys -> {key: (set size, smallest key reachable)}."""
    sets = {k: shingles(t, n) for k, t in docs}
    top = {k: k for k in sets}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {k: (len(s), root(k)) for k, s in sets.items()}


def targets(sizes, weights=(1, 2, 3), repeats=3):
    """{source: size} -> {source: target}, by sharing out the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        shares = sum(weight[s] for s in open_)
        room = total - sum(full.values())
        now = {s: weight[s] * room / shares for s in open_}
        over = [s for s in open_ if now[s] > repeats * sizes[s]]
        if not over:
            return {**full, **now}
        full.update({s: repeats * sizes[s] for s in over})


def mix(docs):
    """(doc_id, source, text) -> [(doc_id, size, source size, target, taken)]."""
    rows = [(d, s, len(words(t))) for d, s, t in docs]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    goal = targets(sizes)
    out = []
    for source in sizes:
        left = int(goal[source] + 0.5)
        own = [r for r in rows if r[1] == source]
        key = lambda r: (hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[2])
        own.sort(key=key)
        taken = [0] * len(own)
        while left > 0 and sizes[source]:
            for i, (_, _, n) in enumerate(own):
                part = min(n, left)
                taken[i] += part
                left -= part
        out += [(d, n, sizes[source], goal[source], k) for (d, _, n), k in zip(own, taken)]
    return out


def base_quality(text):
    """words, word characters, symbols, repeated lines, words in repeated windows."""
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    inside = {
        j for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)
    }
    return (
        len(ws),
        sum(map(len, ws)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(inside),
    )


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return lower(host), re.match(r"[^?#]*", rest[len(host) :]).group()


def judge_url(url, rules):
    host, path = split_url(url)
    fit = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fit.append((len(rule), len(h), rule, verdict))
    if not fit:
        return host, path, None, "allow"
    return host, path, *max(fit)[2:]
