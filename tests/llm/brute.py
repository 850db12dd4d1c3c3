"""Plain Python answers to which the operators are held."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def cut_repeats(docs: list[tuple[int | None, str | None]], span: int = 50) -> dict:
    """doc_id -> (bytes, kept bytes, spans), for distinct ids."""
    first: dict[bytes, int] = {}
    rank = lambda i: -(1 << 63) if i is None else i
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - span + 1):
            s = b[p : p + span]
            first[s] = min(first.get(s, rank(i)), rank(i))
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if first[b[p : p + span]] < rank(i):
                gone[p : p + span] = b"\x01" * span
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), bytes(x for x, g in zip(b, gone) if not g), spans)
    return out


def gram_set(text: str | None) -> frozenset:
    words = (text or "").encode().split()
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset((n, *words[i : i + n]) for i in range(len(words) - n + 1))


def similar(docs: list[tuple[int | None, str | None]]) -> list[tuple[int | None, int | None, int]]:
    """(doc_id, class, links) of each row, by all pairs."""
    sets = [gram_set(t) for _, t in docs]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    links = [0] * len(docs)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g] if j > i)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    rank = lambda i: -(1 << 63) if i is None else i
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), rank(d)), rank(d))
    shown = lambda x: None if x == -(1 << 63) else x
    return [(d, shown(least[find(i)]), links[i]) for i, (d, _) in enumerate(docs)]


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words13(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in raw))


def contamination(docs, items) -> list[tuple]:
    windows = defaultdict(set)
    for item, text in items:
        ws = words13(text)
        n = min(13, len(ws))
        for p in range(len(ws) - n + 1) if n else ():
            windows[tuple(ws[p : p + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        ws = words13(text)
        hit, names = set(), set()
        for n in sizes:
            for p in range(len(ws) - n + 1):
                found = windows.get(tuple(ws[p : p + n]))
                if found:
                    hit.update(range(p, p + n))
                    names |= found
        out.append((d, len(ws), len(hit), sorted(str(x) if x is not None else "null" for x in names)))
    return out


def base_figures(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
