"""Plain versions of the queries' contracts: slow, in memory, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def near_duplicates(docs: dict[int, str | None], width: int = 2, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, least doc_id reachable)."""
    sets = {}
    for d, text in docs.items():
        words = SPACES.findall((text or "").translate(ASCII_LOWER))
        n = min(width, len(words))
        sets[d] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common = defaultdict(int)
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


def top_k(vectors: dict[int, list[float] | None], every: int = 20, k: int = 20) -> set[tuple[int, int, int, int]]:
    whole = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items() if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in whole.items():
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def word_repeats(docs: dict[int, str | None], length: int = 50) -> dict[int, tuple[int, int, str]]:
    words = {d: SPACES.findall(t or "") for d, t in docs.items()}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out[d] = len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))
    return out


def byte_repeats(docs: dict[int, str | None], length: int = 400) -> dict[int, tuple[int, int, int, str]]:
    raw = {d: (t or "").encode() for d, t in docs.items()}
    counts: dict[bytes, int] = defaultdict(int)
    for b in raw.values():
        for i in range(len(b) - length + 1):
            counts[hashlib.blake2b(b[i : i + length], digest_size=16).digest()] += 1
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[hashlib.blake2b(b[i : i + length], digest_size=16).digest()] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))
    return out


def contamination(docs: dict[int, str | None], items: dict[int, str | None], width: int = 10) -> dict[int, tuple[int, int, int, str]]:
    windows = defaultdict(set)
    for item, text in items.items():
        w = NORMAL_WORDS.findall((text or "").translate(ASCII_LOWER))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs.items():
        w = NORMAL_WORDS.findall((text or "").translate(ASCII_LOWER))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if held := windows.get(tuple(w[i : i + n])):
                    hit[i : i + n] = [True] * n
                    found |= held
        out[d] = len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found))))
    return out


def resampled(docs: list[tuple[int, str | None]], target: list[str | None], percent: int = 25, min_words: int = 20) -> list[tuple]:
    """(doc_id, n_features, weight, score, rank) of every row."""

    def features(text):
        w = NORMAL_WORDS.findall((text or "").translate(ASCII_LOWER))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = Counter(b for _, text in docs for b in features(text)[1]), Counter(b for text in target for b in features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    rows = []
    for d, text in docs:
        n, held = features(text)
        weight = sum(map(gain, held)) // len(held) if held else 0
        h = int(sha(f"7:{d}")[:8], 16)
        rows.append((n, d, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-score, d) for n, d, _, _, score in rows if n >= min_words)
    rank = {d: i + 1 for i, (_, d) in enumerate(able[: percent * len(able) // 100])}
    return sorted((d, n, w, score, rank.get(d)) for _, d, n, w, score in rows)


def aligned(docs: list[tuple[int, str | None]], tokenizer, pieces) -> tuple[list[tuple], Counter]:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and how many documents hold each pair."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    made, counts = [], Counter()
    for d, text in docs:
        raw = (" " + (text or "")).encode()
        a = tokenizer.encode(" " + (text or ""), add_special_tokens=False)
        b = pieces.encode(text or "")
        bytes_a = [bytes(symbols[c] for c in t) for t in a.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(pieces.id_to_piece, b)]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            made.append((d, None))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            ends = [0]
            for x in parts:
                ends.append(ends[-1] + len(x))
            spans.append(list(zip(ends, ends[1:])))
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, links, at, ids_a = [], [], [0, 0], a.ids  # a list of its own each time it is asked for
        for end in both:
            sides = []
            for k, (ids, places) in enumerate(zip((ids_a, b), spans)):
                inside = []
                while at[k] < len(ids) and places[at[k]][1] <= end:
                    inside.append(str(ids[at[k]]))
                    at[k] += 1
                sides.append(",".join(inside))
            groups.append("|".join(sides))
        j = 0
        for i, (x, y) in zip(ids_a, spans[0]):
            while spans[1][j][1] <= x:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < y:
                links.append((i, b[k]))
                k += 1
        counts.update(set(links))
        made.append((d, (len(ids_a), len(b), len(groups), links, sha(";".join(groups)))))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    rows = [(d, x[0], x[1], x[2], len(x[3]), sum(counts[p] == best[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) if x else (d, 0, 0, 0, 0, 0, 0, "") for d, x in made]
    return rows, counts
