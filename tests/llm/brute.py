"""Plain Python versions of what the operators compute, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD_12 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(text or "")


def op4(rows, window=50):
    least = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1 if doc is not None else 0):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1 if doc is not None else 0):
            if least[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def op6(rows, shingle=3, radius=2):
    prints = []
    for _, text in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    near = defaultdict(set)
    for i, a in enumerate(prints):
        for j, b in enumerate(prints):
            if (a ^ b).bit_count() <= radius:
                near[i].add(j)
    component = {}
    for i in range(len(rows)):
        if i not in component:
            todo, seen = [i], {i}
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            ids = [rows[x][0] for x in seen if rows[x][0] is not None]
            component |= dict.fromkeys(seen, min(ids, default=None))
    return [(doc, f"{p:016x}", component[i]) for i, ((doc, _), p) in enumerate(zip(rows, prints, strict=True))]


def op2(text):
    w = words(text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def op8(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(-len(h + p), h + p, action) for action, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def op11(rows, top):
    counts, has = defaultdict(lambda: defaultdict(Counter)), defaultdict(Counter)
    for text, lang, source in rows:
        terms = Counter(TERM.findall(lower(text)))
        counts[lang or ""][source or ""].update(terms)
        has[lang or ""].update(terms.keys())
    out = []
    for lang, sources in counts.items():
        kept = {t for t, n in has[lang].items() if n >= 3}
        share = lambda c, t, total: 1 + 10**9 * (c[t] + 1) // (total + len(kept))
        total = {s: sum(c[t] for t in kept) for s, c in sources.items()}
        whole = Counter()
        for c in sources.values():
            whole.update({t: n for t, n in c.items() if t in kept})
        p = {s: {t: share(c, t, total[s]) for t in kept} for s, c in sources.items()}
        q = {t: share(whole, t, whole.total()) for t in kept}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, n) for n, (value, item) in enumerate(found, 1) if part == "pair" or n <= top]
    return out


def op12(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD_12.findall(lower(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    sizes, out = {len(x) for x in windows}, []
    for doc, text in docs:
        w, hit, found = WORD_12.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), digest(",".join(ids)), bool(hit)))
    return out


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def op13(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda doc, text, lang, source, n: digest("".join(map(field, (doc, source, lang, n, text))))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {g: levels([leaf(*r) for r in groups[g]]) for g in order}
    top, out = levels([trees[g][-1][0] for g in order]), []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            own, siblings = leaf(*r[:4], r[4] + changed) if r[4] is not None else leaf(*r), ""
            for tree, at in ((trees[g], i), (top, k)):
                for level in tree[:-1]:
                    left, right = "".join(level[at // 2 * 2 : at]), "".join(level[at + 1 : at // 2 * 2 + 2])
                    own, siblings, at = digest(left + own + right), siblings + left + right, at // 2
            root = top[-1][0]
            out.append((r[0], leaf(*r), trees[g][-1][0], root, digest(siblings), own, own == root))
    return out
