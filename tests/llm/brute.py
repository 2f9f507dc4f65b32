"""Plain Python answers for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import xxhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def secrets(text):
    text = text or ""
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token"))
    assign = re.compile(rf"""(?:{key}|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def fingerprint(text):
    ws = blank_words(text)
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def five_words(text):
    ws = blank_words(text)
    return frozenset(" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([" ".join(ws)] if ws else [])


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def similar_groups(rows):
    """Component (least id) of each document under a five-word Jaccard similarity of 0.8."""
    held = [(i, five_words(t)) for i, t in rows]
    sets = Sets()
    for n, (i, a) in enumerate(held):
        for j, b in held[:n]:
            if similar(a, b):
                sets.join(i, j)
    return {i: sets.find(i) for i, _ in held}


def components(rows, bits):
    prints = [(i, fingerprint(t)) for i, t in rows]
    sets = Sets()
    for n, (i, f) in enumerate(prints):
        sets.find(i)
        for j, g in prints[:n]:
            if (f ^ g).bit_count() <= bits:
                sets.join(i, j)
    return {i: sets.find(i) for i, _ in prints}


def windows(text, items):
    ws, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(10, len(iw))
        for s in range(max(1, len(iw) - 9) if iw else 0):
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == iw[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(ws), len(hit), sorted(found)


def repeats(rows):
    """doc_id -> (bytes, removed, spans, sha256 of the rest), for distinct ids."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cover = bytearray(len(b))
        new = [b[s : s + 50] for s in range(len(b) - 49)]
        for s, w in enumerate(new):
            if seen.get(w, i) < i:
                cover[s : s + 50] = b"\1" * 50
        for w in new:
            seen.setdefault(w, i)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out[i] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    return out


def paragraphs(rows):
    """doc_id -> (removed, documents that keep what is removed), for distinct ids."""
    found = []
    for i, t in sorted(rows):
        for at, p in enumerate((t or "").split("\n")):
            ws = [w.lower() for w in p.encode().split()]
            if len(ws) >= 5:
                found.append((i, at, frozenset(tuple(ws[j : j + 5]) for j in range(len(ws) - 4))))
    sets, groups = Sets(), defaultdict(list)
    for n, (_, _, a) in enumerate(found):
        for m in range(n):
            b = found[m][2]
            if len(a & b) / len(a | b) >= 0.8:
                sets.join(n, m)
    for n in range(len(found)):
        groups[sets.find(n)].append(n)
    gone, kept = defaultdict(int), defaultdict(set)
    for g in groups.values():
        for n in sorted(g)[1:]:
            gone[found[n][0]] += 1
            kept[found[n][0]].add(found[min(g)][0])
    return {i: (gone[i], sorted(kept[i])) for i, _ in rows}


def phrases(text):
    ws, out = words(text), []
    for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        n = len(p.split())
        out += [(i, label) for i in range(len(ws)) if ws[i : i + n] == p.split()]
    return len(ws), sorted(out)
