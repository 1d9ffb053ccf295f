"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def windows_removed(texts, cut, width):
    """texts: key -> text; cut: text -> units. Which units of each text a repeated window covers."""
    units = {k: cut(t) for k, t in texts.items()}
    seen = Counter(tuple(u[i : i + width]) for u in units.values() for i in range(len(u) - width + 1))
    out = {}
    for k, u in units.items():
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if seen[tuple(u[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out[k] = (u, gone)
    return out


def roots(pairs, every):
    up = {k: k for k in every}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {k: find(k) for k in every}


def shingle_sets(texts, k):
    out = {}
    for key, t in texts.items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[key] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def jaccard_roots(texts, k, percent):
    sets = shingle_sets(texts, k)
    post, pairs = defaultdict(list), []
    for key, s in sets.items():
        for other, n in Counter(o for g in s for o in post[g]).items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                pairs.append((key, other))
        for g in s:
            post[g].append(key)
    return sets, roots(pairs, sets)


def mixed(docs, op7):
    """(doc_id, text) of the rows (doc_id, text, source, lang) that the mixture draws, by plain loops over the cells."""
    cells, where = defaultdict(float), []
    for _, t, source, lang in docs:
        n, lines = len(WORD.findall(t or "")), (t or "").count("\n")
        topic = "brief" if t is None or n < 50 else "contact" if "@" in t else "lines" if lines * 40 > n else "prose"
        where.append((source, lang, topic))
        cells[where[-1]] += n
    cells = {k: t for k, t in cells.items() if t > 0}
    w, targets = dict(cells), []
    for i, power in enumerate(op7.TEMPER.values()):
        m = defaultdict(float)
        for k, t in cells.items():
            m[k[i]] += t
        total = sum(x**power for x in m.values())
        targets.append({k: x**power / total for k, x in m.items()})
    for _ in range(op7.ROUNDS):
        for i, target in enumerate(targets):
            now = defaultdict(float)
            for k, x in w.items():
                now[k[i]] += x
            w = {k: x * target[k[i]] / now[k[i]] for k, x in w.items()}
    all_t, all_w = sum(cells.values()), sum(w.values())
    weight = {k: (w[k] / all_w) / (cells[k] / all_t) for k in cells}
    scale = op7.BUDGET
    for _ in range(op7.CALIBRATIONS):
        clipped = sum(t for k, t in cells.items() if scale * weight[k] >= 1)
        open_ = sum(t * weight[k] for k, t in cells.items() if scale * weight[k] < 1)
        scale = max(scale, (all_t * op7.BUDGET - clipped) / open_) if open_ else scale
    out = []
    for (i, t, _, _), k in zip(docs, where):
        chance = round(min(1.0, scale * weight[k]), 6) if k in weight else op7.BUDGET
        draw = int(hashlib.md5(f"{op7.SALT}{'' if i is None else i}".encode()).hexdigest()[:8], 16) / 4294967296
        if draw < chance:
            out.append((i, t))
    return out
