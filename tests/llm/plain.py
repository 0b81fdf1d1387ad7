"""Brute-force versions that several test files share."""

from __future__ import annotations

from pixelloom.llm.decontamination import words_of


def shingles(text, k):
    ws = [w.decode() for w in (text or "").encode().lower().split()]
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1)))


def near_brute(rows, k, percent):
    """(number of shingles, component id) of each row, by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None] if sets[i] else [doc]
        out.append((doc, len(sets[i]), min(ids) if ids and ids[0] is not None or any(x is not None for x in ids) else None))
    return sorted(out, key=str)


def hits_brute(text, items, window=13):
    words = words_of(text)
    hit, found = set(), set()
    for item, body in items:
        ws = words_of(body)
        if not ws:
            continue
        for k in range(max(1, len(ws) - window + 1)):
            p = ws[k : k + window]
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    if item is not None:
                        found.add(item)
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


def quality_kept(rows):
    """Whether each (text, host) is kept: the document rules, and hosts by their posterior rates, in plain arithmetic."""
    import math

    from pixelloom.llm import quality as q

    rules = []
    for text, _ in rows:
        n_words, chars, symbols, lines, dup, repeats = q.text_stats(text)
        base, by_symbols, by_lines = n_words < 20 or 100 * repeats > 30 * n_words, 100 * symbols > 10 * chars, 100 * dup > 30 * lines
        rules.append({"base": base, "symbols": by_symbols, "lines": by_lines, "any": base or by_symbols or by_lines})
    hosts = sorted({h for _, h in rows if h is not None})
    over = {}
    for k in ("symbols", "lines", "any"):
        n = {h: sum(x == h for _, x in rows) for h in hosts}
        f = {h: sum(r[k] for r, (_, x) in zip(rules, rows) if x == h) for h in hosts}
        total = sum(n.values())
        m = sum(f.values()) / total if total else 0.0
        var = sum(f[h] ** 2 / n[h] for h in hosts) / total - m * m - m * (1 - m) * len(hosts) / total if total else 0.0
        s = max(10.0, m * (1 - m) / var - 1) if var * 1e6 > m * (1 - m) else 1e6
        for h in hosts:
            r = (f[h] + s * m) / (n[h] + s)
            over[k, h] = r - 1.6448536269514722 * math.sqrt(r * (1 - r) / (n[h] + s + 1)) > (max(0.5, m) if k == "any" else m)
    bad = lambda k, h: over.get((k, h), False)
    return [not (r["base"] or bad("any", h) or (r["symbols"] and bad("symbols", h)) or (r["lines"] and bad("lines", h))) for r, (_, h) in zip(rules, rows)]
