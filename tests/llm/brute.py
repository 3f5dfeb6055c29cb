"""What the operators must give, computed one document at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text):
    return WORD.findall(text or "")


def windows(docs, n):
    """(doc_id, n_words, n_removed, kept text) per row; windows of n words of an earlier document go."""
    first = {}
    for doc_id, text in docs:
        w = words(text)
        if doc_id is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        w, gone = words(text), set()
        if doc_id is not None:
            for k in range(len(w) - n + 1):
                if first[tuple(w[k : k + n])] < doc_id:
                    gone.update(range(k, k + n))
        out.append((doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(UPPER, UPPER.lower()))


def lines(docs):
    owner = {}
    for doc_id, text in docs:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                key = line_key(line)
                if len(key) >= 10:
                    owner[key] = min(owner.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if doc_id is None or owner.get(line_key(x), doc_id) >= doc_id]
        out.append((doc_id, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def quality_counts(text):
    w = words(text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeat = set()
    for k in range(len(w) - 2):
        if grams[tuple(w[k : k + 3])] > 1:
            repeat.update((k, k + 1, k + 2))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeat)


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def near(docs, threshold=0.8):
    """(doc_id, class_id, n_links) per row."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(docs)
    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    named = {}
    for k, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            named[find(k)] = min(named.get(find(k), doc_id), doc_id)
    return [(d, named.get(find(k)) if sets[k] else d, links[k]) for k, (d, _) in enumerate(docs)]
