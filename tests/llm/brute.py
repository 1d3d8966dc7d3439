"""The contracts of the operators as plain loops over rows, without any of the library's methods."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def low(text):
    return (text or "").translate(UPPER)


def words(text):
    return WORD.findall(low(text))


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode("utf-8", "surrogatepass")).hexdigest()


def licenses(text):
    w = words(text)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def token_rows(rows, t):
    """doc_id -> start, n_tokens, ids_crc32; doc_ids differ."""
    out, start = {}, 0
    for doc, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out[doc] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out


def bpe(text, t):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    text = text or ""
    number = lambda m: re.sub("[^0-9]", "", m.group())
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(number(m)) <= 19 and luhn(number(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(number(m)) <= 15),
    )
    found = [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m)]
    counts = Counter(k for k, _, _ in found)
    return *(counts[k] for k, _, _ in kinds), sha(",".join(f"{k}:{s}:{e}" for k, s, e in found))


def secrets(text):
    text = text or ""
    assign = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    kinds = (("assign", assign, lambda m: len(m.group(1)) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m.group()) >= 32))
    found = sorted((m.start(), o, m.end(), k) for o, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m))
    counts = Counter(k for *_, k in found)
    return *(counts[k] for k, _, _ in kinds), sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in found))


def exact(rows):
    """Of each row in order: keep_id, group_size, text_sha256."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[low(text)].append(doc)
    return [(max((d for d in groups[low(t)] if d is not None), default=None), len(groups[low(t)]), sha(low(t))) for _, t in rows]


def repeats(rows, length=200):
    """Of each row in order: n_bytes, n_removed, n_spans, kept_sha256."""
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def bag(text, size=5):
    w = words(text)
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def similarity(a, b):
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def near_pairs(rows, least=0.8):
    """All pairs of places in rows whose bags are alike enough."""
    bags = [bag(t) for _, t in rows]
    sizes = [sum(b.values()) for b in bags]
    holders = defaultdict(list)
    out = []
    for i, b in enumerate(bags):
        both = Counter()
        for s, n in b.items():
            for j, m in holders[s]:
                both[j] += min(n, m)
            holders[s].append((i, n))
        out += [(i, j) for j, n in both.items() if n >= least * (sizes[i] + sizes[j] - n)]
    return out


def classes(rows, pairs):
    """Class of each place: the smallest doc_id among all that pairs connect."""
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(doc, least.get(top(i), doc))
    return [least[top(i)] for i in range(len(rows))]


def tiling(doc, item, least=5):
    """Greedy string tiling by its definition: words of item that are covered."""
    a, b = words(item), words(doc)
    marked_a, marked_b, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not marked_a[i + k] and not marked_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if not found:
            return covered
        for i, j in found:
            if not any(marked_a[i : i + best]) and not any(marked_b[j : j + best]):
                marked_a[i : i + best] = marked_b[j : j + best] = [True] * best
                covered += best


def distance(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def toxicity(text, terms, stems, ordinary, weights, fuzzy_from=5, window=8):
    """Score of a text by the terms' and stems' hits and what stands around them."""
    from math import exp, log1p

    quotes = "\"\u201c\u201d\u201e\u00ab\u00bb\u2018\u2019'"
    reporting = set("said says wrote called quote quoted word term cited dijo escribi\u00f3 palabra disait \u00e9crit mot sagte schrieb wort zitat".split())
    address = set("you your youre u tu vous toi du dich ihr sie usted eres".split())
    memory = {}

    def kind(w):
        if w not in memory:
            near = any(len(t) >= fuzzy_from and abs(len(t) - len(w)) <= 1 and distance(w, t) <= 1 for t in terms)
            near = near or any(len(s) >= fuzzy_from and distance(w[:k], s) <= 1 for s in stems for k in range(max(0, len(s) - 1), min(len(w), len(s) + 1) + 1))
            memory[w] = 2 if any(w.startswith(s) for s in stems) else 1 if w in terms else 3 if near and w not in ordinary else 0
        return memory[w]

    lower = low(text)
    places = [(m.group(), *m.span()) for m in WORD.finditer(lower)]
    hits = [(i, kind(w)) for i, (w, _, _) in enumerate(places) if kind(w)]
    x = [0.0] * 7
    if hits:
        n = Counter(k for _, k in hits)
        abuse = quoted = close = 0
        for h, (i, _) in enumerate(hits):
            around = {w for w, _, _ in places[max(0, i - window) : i + window + 1]}
            _, s, e = places[i]
            if (set(lower[max(0, s - 2) : s]) & set(quotes) and set(lower[e : e + 2]) & set(quotes)) or around & reporting:
                quoted += 1
            else:
                abuse += 2 if around & address else 1
            close += h > 0 and i - hits[h - 1][0] <= window
        x = [log1p(n[1]), log1p(n[2]), log1p(n[3]), len(hits) / len(places), log1p(abuse), log1p(quoted), log1p(close)]
    z = weights[0] + sum(a * b for a, b in zip(weights[1:], x, strict=True))
    return 1 / (1 + exp(-max(-30, min(30, z))))


def license_labels(text, notices, slack=16):
    """labels and score: at every place of a notice's first key phrase, the others each near where the one before it puts it."""
    w, labels, score = words(text), set(), 0.0
    for p, label in PHRASES.items():
        k = p.split()
        if any(w[i : i + len(k)] == k for i in range(len(w))):
            labels.add(label)
            score = max(score, 0.9)
    for label, notice, keys in notices:
        n = words(notice)
        places = []
        for key in keys:
            k = words(key)
            places.append((next(i for i in range(len(n)) if n[i : i + len(k)] == k), k))
        places.sort()
        for here in range(len(w)):
            if w[here : here + len(places[0][1])] != places[0][1]:
                continue
            put = [here]
            for (before, _), (at, k) in zip(places, places[1:], strict=False):
                expected = put[-1] + at - before
                fit = [p for p in range(max(0, expected - slack), expected + slack + 1) if w[p : p + len(k)] == k]
                if not fit:
                    break
                put.append(min(fit, key=lambda p: (abs(p - expected), p)))
            if len(put) < len(places):
                continue
            labels.add(label)
            same = 0
            for i, x in enumerate(n):
                last = max((j for j, (at, _) in enumerate(places) if at <= i), default=0)
                at = put[last] + i - places[last][0]
                same += 0 <= at < len(w) and w[at] == x
            score = max(score, 0.5 + 0.5 * same / len(n))
    return ",".join(sorted(labels)), score


def ownership(rows, owners=3, repositories=2):
    """doc_id -> (n_live, n_copied) of the base kinds and of all runs that the mixed pattern of the operator finds.

    rows: doc_id, text, repository, owner; doc_ids differ.
    """
    import regex

    from sievefold.llm.secrets import ENTROPY_KINDS, MIXED

    holders, found = defaultdict(set), {}
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for doc, text, repo, owner in rows:
        text = text or ""
        base = [(m.span(), m.group(1)) for m in re.finditer(assign, text) if len(m.group(1)) >= 8]
        base += [(m.span(), m.group()) for p, n in (("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32)) for m in re.finditer(p, text) if len(m.group()) >= n]
        own = [v for _, v in base]
        for m in regex.finditer(MIXED, text):
            if len(set(m.group())) >= ENTROPY_KINDS and not any(s < m.end() and m.start() < e for (s, e), _ in base):
                own.append(m.group())
        found[doc] = own
        for v in own:
            holders[v].add((repo or "", owner or ""))
    copied = {v for v, h in holders.items() if len(h) >= owners and len({r for r, _ in h}) >= repositories}
    return {doc: (sum(v not in copied for v in own), sum(v in copied for v in own)) for doc, own in found.items()}
