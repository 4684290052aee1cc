"""The results of the operators on a few documents, by the shortest way there is."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def suffix(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of (doc_id, text) rows; ids are never null."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for j in range(len(b) - 49):
            w = b[j : j + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(kept)))
    return out


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(rows, percent=75):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    ids = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        ids[find(x)].append(i)
    return [
        (i, len(s), min((k for k in ids[find(x)] if k is not None), default=None))
        for x, (i, s) in enumerate(sets)
    ]


def lines(rows, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    having = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            having[key(line)].add((i, t))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not key(x) or len(having[key(x)]) < least]
        out.append((i, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def leaks(rows, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(size, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[k : k + n]:
                        hit |= set(range(s, s + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def rules(rows, most=100):
    """Rows of (doc_id, text, source)."""
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    often = Counter(
        (s, k) for _, t, s in rows for k in {key(x) for x in (t or "").split("\n")} if k
    )
    out = []
    for i, t, s in rows:
        w = split(t)
        wins = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = set()
        for k in range(len(w) - 7):
            if wins[tuple(w[k : k + 8])] > 1:
                covered |= set(range(k, k + 8))
        with_word = [x for x in (t or "").split("\n") if split(x)]
        gone = sum(len(split(x)) for x in (t or "").split("\n") if often[s, key(x)] > most)
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        out.append(
            (i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")),
             len(with_word) - len(set(with_word)), len(covered), gone, failed,
             not failed and 100 * gone <= 50 * len(w))
        )
    return out


def ranks(seeds, edges, damping, rounds):
    """Personalised PageRank without handing back what ends in hosts without edges."""
    out = Counter()
    for (a, _), w in edges.items():
        out[a] += w
    score = dict(seeds)
    for _ in range(rounds):
        new = Counter({h: s * (1 - damping) for h, s in seeds.items()})
        for (a, b), w in edges.items():
            new[b] += damping * score.get(a, 0) * w / out[a]
        score = new
    return score


def negatives(rows):
    """Result rows of (vec_id, vector, label) rows, from all pairs."""
    use = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label,
                    [math.floor(256 * x) for x in v]))
    most = 1 << 62
    out = []
    anchors = {(i, label, tuple(v)) for i, label, v in use if i is not None and i % 100 == 0}
    for a, label, v in anchors:
        score = lambda w: max(-most, min(most, sum(x * y for x, y in zip(v, w))))  # noqa: B023, E731
        pairs = sorted(
            (-score(w), i is None, i or 0, mine == label, i)
            for i, mine, w in use if i != a and len(w) == len(v)
        )
        for p in [x for x in pairs if x[3]][:5]:
            fits = [n for n in pairs if not n[3] and 80 * -p[0] <= 100 * -n[0] <= 100 * -p[0]]
            out += [(a, p[4], k, n[4], -p[0], -n[0]) for k, n in enumerate(fits[:5], 1)]
    return out


def simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows, radius=3):
    prints = [simhash(t) for _, t in rows]
    label = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if label[x] != label[y] and (prints[x] ^ prints[y]).bit_count() <= radius:
                old = label[x]
                label = [label[y] if k == old else k for k in label]
    least = {}
    for (i, _), k in zip(rows, label):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return [(i, f"{p:016x}", least.get(k)) for (i, _), p, k in zip(rows, prints, label)]


def chats(rows):
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of turns.

    Keeps the best (cost, audit) of each state, which no later edit can change: of two audits of one
    cost and state none begins with the other.
    """
    convs = {}
    for c, turn, role, text in rows:
        own = convs.setdefault(c, [])
        name = ":".join(" " if x is None else str(x) for x in (c, turn))
        damage = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if damage == 1:
            text = ""
        if damage == 2:
            text = re.sub("[.!?]", "", text)
        if damage == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if damage == 0 else 2 if damage == 3 else 1)
    after, full = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    out = []
    for c, own in convs.items():
        mark = lambda r, t: sha(f"{'' if c is None else c}:{len(r)}:{r}{t}")  # noqa: B023, E731
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], mark(x[1], x[2])))
        faults, seen = [], set()
        for _, role, text in own:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            bad = "duplicate" if (role, text) in seen else "" if body and body[-1] in ".!?" else "cut"
            faults.append(bad if body else "blank")
            seen.add((role, text))

        def best_of(ways):
            best = {}
            for state, way in ways:
                if state not in best or way[:2] < best[state][:2]:
                    best[state] = way
            return best

        def with_inserts(best):
            for _ in range(4):
                more = [(after[s], (n + 3, a + "I", t + [full[after[s]] + ":"])) for s, (n, a, t) in best.items()]
                best = best_of([*best.items(), *more])
            return best

        best = with_inserts({"": (0, "", [])})
        for (_, role, text), bad in zip(own, faults):
            ways = []
            for s, (n, a, t) in best.items():
                ways.append((s, (n + 4, a + "D", t)))
                if bad in ("blank", "duplicate"):
                    continue
                n += 3 * (bad == "cut")
                if role[:1] == after[s] or (role[:1], s) == ("s", ""):
                    ways.append((role[:1], (n, a + "K", [*t, f"{role}:{text}"])))
                ways.append((after[s], (n + 3, a + "R", [*t, f"{full[after[s]]}:{text}"])))
            best = with_inserts(best_of(ways))
        cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
        turns = [x[0] for x in own if x[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        odd = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        count = [faults.count(x) for x in ("blank", "duplicate", "cut")]
        out.append((c, gaps, *count, odd, cost, audit, sha("\n".join(lines))))
    return out
