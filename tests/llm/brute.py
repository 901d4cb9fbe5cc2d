"""Plain versions of the contracts, one text at a time, to hold the operators against."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()

md5 = lambda s: hashlib.md5(s.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def licenses(text):
    w = words(text)
    found = [(i, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
             for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return {"n_words": len(w), "n_base": len(starts), "first_word": min(starts, default=None),
            "last_word": max(starts, default=None), "base_labels": ",".join(sorted({label for _, label in found}))}


def item_windows(items, size=10):
    out = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[i:i + size]), set()).add(str(item_id))
    return out


def contamination(text, windows):
    w = words(text)
    hit, ids = set(), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if (own := windows.get(tuple(w[i:i + n]))) is not None:
                hit.update(range(i, i + n))
                ids |= own
    return {"n_words": len(w), "n_hit": len(hit), "n_items": len(ids), "items_sha256": sha(",".join(sorted(ids))),
            "contaminated": bool(hit)}


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def is_right(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(int(c) for c in reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return True


def pii(text):
    spans = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if is_right(k, m[0])] for k, p in KINDS.items()}
    listed = [f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k]]
    return {**{f"n_{k}": len(v) for k, v in spans.items()}, "base_sha256": sha(",".join(listed))}, listed


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def components(ids, linked):
    """Smallest id reachable from each id; ``linked`` are pairs of places in ``ids``."""
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in linked:
        root[top(a)] = top(b)
    least = {}
    for i, v in enumerate(ids):
        least[top(i)] = min(v, least.get(top(i), v))
    return [least[top(i)] for i in range(len(ids))]


def near_duplicates(rows):
    """(doc_id, n_shingles, component_id) by comparing every two documents that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    shared = {}
    for places in where.values():
        for n, a in enumerate(places):
            for b in places[n + 1:]:
                shared[a, b] = shared.get((a, b), 0) + 1
    linked = [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    comp = components([d for d, _ in rows], linked)
    return sorted((d, len(s), c) for (d, _), s, c in zip(rows, sets, comp, strict=True))
