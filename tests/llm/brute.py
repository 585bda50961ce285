"""Plain versions of the dealt operators' contracts, for small tables only."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    w = words((text or "").translate(CAPITALS))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def smallest_reachable(nodes: set[int], links: list[tuple[int, int]]) -> dict[int, int]:
    head = {n: n for n in nodes}

    def find(n: int) -> int:
        while head[n] != n:
            head[n] = head[head[n]]
            n = head[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_components(docs: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, tuple[int, int]]:
    """(set size, component) of each id."""
    sets = {i: shingles(t, width) for i, t in docs}
    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    common: Counter[tuple[int, int]] = Counter()
    for ids in by_shingle.values():
        ids.sort()
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    found = smallest_reachable(set(sets), links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def line_key(line: str) -> str:
    return line.strip(SPACE).translate(CAPITALS)


def dedup_lines(docs: list[tuple[int, str | None]], least: int = 10) -> dict[int, tuple[int, int, str]]:
    """(lines, dropped lines, text left) of each id."""
    first: dict[str, int] = {}
    where = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            k = line_key(line)
            if len(k) >= least:
                where[k].add(i)
                first[k] = min(i, first.get(k, i))
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(where.get(line_key(x), ())) < 2 or first[line_key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def remove_repeats(docs: list[tuple[int, str | None]], length: int) -> dict[int, tuple[int, int, int, str]]:
    """(bytes, removed bytes, removed runs, hash of what is left) of each id."""
    raws = [(i, (t or "").encode()) for i, t in docs]
    met: Counter[bytes] = Counter()
    for _, raw in raws:
        met.update(raw[k : k + length] for k in range(len(raw) - length + 1))
    out = {}
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if met[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(raw), sum(gone), runs, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def base_metrics(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def shannon_distance(counts: list[float], shares: list[float]) -> float | None:
    total = sum(counts)
    if not total:
        return None
    p = [c / total for c in counts]
    m = [(a + b) / 2 for a, b in zip(p, shares, strict=True)]
    half = [sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a > 0) for x in (p, shares)]
    return math.sqrt(max(0.0, sum(half) / 2))


def histograms(text: str | None, common: list[str]) -> tuple[list[float], list[float]]:
    text = text or ""
    w = words(text)
    five = [
        float(len(re.findall(p, text))) if p else float(sum(c.isupper() and __import__("unicodedata").category(c) == "Lu" for c in text))
        for p in ("", "[0-9]", r"[!-/:-@\[-`{-~]", r"[\x20\x09-\x0D]", r"[^\x00-\x7F]")
    ]
    places = {x: k for k, x in enumerate(common)}
    hits = [0.0] * (len(common) + 1)
    for x in w:
        hits[places.get(x, len(common))] += 1
    return [*five, max(0.0, len(text) - sum(five))], hits


def quality(docs: list[tuple[int, str | None, str | None]], lists: dict[str, list[str]], limits: dict[str, float]) -> dict[int, bool]:
    """Whether each document is kept, references fitted on the documents."""
    common = list(dict.fromkeys(x for v in lists.values() for x in v))
    each = {i: histograms(t, common) for i, t, _ in docs}
    lang = {i: g.lower() if g and g.lower() in lists else "other" for i, _, g in docs}
    refs = {}
    for g in set(lang.values()):
        sums = [[sum(x) for x in zip(*(each[i][k] for i in each if lang[i] == g), strict=True)] for k in (0, 1)]
        if all(map(sum, sums)):
            refs[g] = [[x / sum(s) for x in s] for s in sums]
    out = {}
    for i, t, _ in docs:
        n, *_, failed = base_metrics(t)
        far = False
        for k, enough, most in ((0, len(t or "") >= limits["chars"], limits["classes"]), (1, n >= limits["words"], limits["common"])):
            if enough:
                distances = {g: shannon_distance(each[i][k], r[k]) for g, r in refs.items()}
                own = distances.get(lang[i]) if lang[i] != "other" else None
                far |= (min(distances.values()) if own is None else own) > most
        out[i] = not failed and not far
    return out


def quote_lines(text: str | None) -> list[tuple[int, str]]:
    """(level, normalised passage) of runs of lines of one level, parted by blank ones."""
    out: list[tuple[int, str]] = []
    broken = True
    for line in (text or "").split("\n"):
        level, rest = 0, line
        while rest.lstrip(" \t").startswith(">"):
            level, rest = level + 1, rest.lstrip(" \t")[1:]
        said = " ".join(rest.split()).translate(CAPITALS)
        if not said:
            broken = True
        elif not broken and out and out[-1][0] == level:
            out[-1] = (level, out[-1][1] + " " + said)
        else:
            out.append((level, said))
            broken = False
    return out


def link_quotes(messages: list[tuple[int, int, str | None]]) -> dict[tuple[int, int], tuple[int, int, tuple[int, int] | None, int, int]]:
    """(quotes, linked ones, message replied to, thread, position in it) of each message (conversation, turn)."""
    parsed = {(c, t): quote_lines(text) for c, t, text in messages}
    named = {at: [(level, k, p) for k, (level, p) in enumerate(lines) if level and any(ch.isalnum() for ch in p)] for at, lines in parsed.items()}
    holders = defaultdict(list)
    for at, lines in parsed.items():
        mine = [p for level, p in lines if not level]
        for p in {*mine, " ".join(mine)}:
            holders[p].append(at)
    out, ties = {}, []
    for at, quotes in named.items():
        linked = []
        for level, k, p in quotes:
            earlier = [h for h in holders[p] if h < at]
            here = [h for h in earlier if h[0] == at[0]]
            if earlier:
                linked.append((level, k, min(here or earlier)))
        reply = min(linked)[2] if linked else None
        if reply:
            ties.append((at[0], reply[0]))
        out[at] = (len(quotes), len(linked), reply)
    thread = smallest_reachable({c for c, _ in parsed}, ties)
    place: Counter[int] = Counter()
    full = {}
    for at in sorted(out, key=lambda a: (thread[a[0]], a)):
        place[thread[at[0]]] += 1
        full[at] = (*out[at], thread[at[0]], place[thread[at[0]]])
    return full
