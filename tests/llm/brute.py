"""Plain Python statements of what the operators must return."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
    return total % 10 == 0


def personal(text):
    text, out, counts = text or "", [], []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ):
        found = [m.span() for m in re.finditer(pattern, text) if good(m[0])]
        counts.append(len(found))
        out += [f"{kind}:{a}:{b}" for a, b in found]
    return (*counts, sha(",".join(out)))


def secret(text):
    text = text or ""
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [
        [m.span() for m in re.finditer(assign, text) if len(m[1]) >= 6],
        [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
    ]
    rows = sorted((a, i, b) for i, spans in enumerate(found) for a, b in spans)
    return (*map(len, found), sha(",".join(f"{('assign', 'access', 'hex')[i]}:{a}:{b}" for a, i, b in rows)))


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))
    at, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        here = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def jaccard_groups(rows, k=4, num=85, den=100):
    """doc_id -> (size of its set, smallest id of its group)."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    holders, parent = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for g in s for j in holders[g] if j > i)
        for j, o in shared.items():
            if den * o >= num * (len(s) + len(sets[j]) - o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}
