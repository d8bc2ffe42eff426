"""Sequential Louvain in plain Python, to compare modularity with."""


def louvain(edges):
    """(modularity, {node: community}) of undirected edges {(a, b): weight}."""
    near = {}
    for (a, b), w in edges.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    member, loops = {i: i for i in near}, dict.fromkeys(near, 0.0)
    two_m = sum(map(sum, (x.values() for x in near.values())))
    while True:
        k = {i: sum(x.values()) + 2 * loops[i] for i, x in near.items()}
        at, tot, moved, any_moved = {i: i for i in near}, dict(k), True, False
        while moved:
            moved = False
            for i in sorted(near):
                links = {at[i]: 0.0}
                for j, w in near[i].items():
                    links[at[j]] = links.get(at[j], 0.0) + w
                tot[at[i]] -= k[i]
                gain = {c: w - k[i] * tot[c] / two_m for c, w in links.items()}
                best = min(gain, key=lambda c: (-gain[c], c))
                if gain[best] > gain[at[i]] + 1e-9:
                    at[i], moved, any_moved = best, True, True
                tot[at[i]] += k[i]
        if not any_moved:
            break
        member = {i: at[c] for i, c in member.items()}
        up, inner = {c: {} for c in at.values()}, dict.fromkeys(at.values(), 0.0)
        for i in near:
            inner[at[i]] += loops[i]
            for j, w in near[i].items():
                if at[i] == at[j]:
                    inner[at[i]] += w / 2
                else:
                    up[at[i]][at[j]] = up[at[i]].get(at[j], 0.0) + w
        near, loops = up, inner
    k = {i: sum(x.values()) + 2 * loops[i] for i, x in near.items()}
    return sum(2 * loops[i] / two_m - (k[i] / two_m) ** 2 for i in near), member
