"""Brute-force helpers."""


def components(texts):
    """Groups of doc_ids that Jaccard links of 0.8 on five words connect."""
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for d, t in texts.items() for w in [t.lower().split()]}
    groups = [{d} for d in sets]
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = (next(g for g in groups if k in g) for k in (a, b))
                if x is not y:
                    x |= y
                    groups.remove(y)
    return groups
