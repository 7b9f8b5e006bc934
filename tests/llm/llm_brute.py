"""Plain versions of the operators, for the tests to hold them against."""

import collections
import functools
import math
import random
import re
import zlib

import numpy as np

from tracewell.llm import pii

WORD = r"[^\x20\x09-\x0D]+"


def brute_stats(t):
    t = t or ""
    w = re.findall(WORD, t)
    c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def brute_components(rows, width=3, per_cent=85):
    """By id: size of the set and smallest id that is reached. Of repeated ids each row is a node, the last one's size is given."""
    sets, ids = {}, [i for i, _ in rows]
    for k, (_, t) in enumerate(rows):
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = frozenset([tuple(w)]) if 0 < len(w) < width else frozenset(zip(*(w[j:] for j in range(width))))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: (len(sets[k]), least[find(k)]) for k, i in enumerate(ids)}


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def brute_terms(rows):
    """Term spans of each text by the definition, as (start, end, removed): a loop over all entities and words."""
    n, docs = len(rows), [{w.lower() for w in re.findall(r"[^\W\d_]{3,}", t or "")} for _, t in rows]
    docs = [d | {w[: pii.STEM] + "*" for w in d} for d in docs]
    held = [{(k, t[a:b].lower()) for a, k, b in brute_spans(t)} if t else set() for _, t in rows]
    out = {}
    for (i, t), mine in zip(rows, held):
        spans = brute_spans(t) if mine else []
        places = [m for m in re.finditer(r"[^\W\d_]{3,}", t or "") if all(b <= m.start() or a >= m.end() for a, _, b in spans)]

        def discloses(w, mine=mine):
            best = 0
            for e in mine:
                ne, nt, nte = sum(e in h for h in held), sum(w in d for d in docs), sum(w in d and e in h for d, h in zip(docs, held))
                best = max(best, math.log2(n * nte / (nt * ne)) / math.log2(n / ne) if ne < n else 0)
            return best >= pii.DISCLOSES

        told = [m for m in places if discloses(m[0].lower())]
        out[i] = {(m.start(), m.end(), len(m[0]) <= pii.STEM or discloses(m[0].lower()[: pii.STEM] + "*")) for m in told}
    return out


@functools.cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def brute_cut(scores, edges):
    best = None
    for mask in range(1 << len(scores)):
        cost = sum(max(s, 0) if not mask >> k & 1 else max(-s, 0) for k, s in enumerate(scores)) + sum(c for a, b, c in edges if (mask >> a & 1) != (mask >> b & 1))
        best = cost if best is None else min(best, cost)
    return best


def words(n, seed, size=400):
    r = random.Random(seed)
    return " ".join("w%d" % r.randrange(size) for _ in range(n))
