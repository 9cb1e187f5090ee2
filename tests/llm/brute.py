"""Plain Python answers that the operators are compared with."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text, width=5):
    w = WORD.findall(ascii_lower(text or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(rows, percent=80):
    """{row index: smallest id of its component}; rows are (id, text)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = min(ids) if ids else None
    return out


def kept_lines(rows, min_chars=20, min_docs=3):
    """[(lines, dropped, text)] for rows (id, text)."""
    ws = " \t\n\x0b\x0c\r"
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = ascii_lower(line.strip(ws))
            if len(k) >= min_chars:
                holders[k].add(i)
    low = lambda i: (i is not None, i or 0)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(k := ascii_lower(x.strip(ws))) >= min_chars and len(holders[k]) >= min_docs and max(holders[k], key=low) != i for x in lines]
        out.append((len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


def repeated_bytes(texts, length=200):
    """For each text: (bytes, removed, runs, remaining bytes)."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                hit[k : k + length] = b"\x01" * length
        runs = len(re.findall(b"\x01+", bytes(hit)))
        out.append((len(b), sum(hit), runs, bytes(x for x, h in zip(b, hit, strict=True) if not h)))
    return out


def measures(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {p for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
