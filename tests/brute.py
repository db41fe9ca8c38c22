"""Plain versions of the text-index operators, for small inputs."""


def lcp(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def suffix_rows(strings):
    """(str_id, pos, gidx, suffix) in order of suffix, ties by place."""
    rows, begin = [], 0
    for i, text in sorted(strings):
        rows += [(i, p, begin + p, text[p:]) for p in range(len(text))]
        begin += len(text)
    return sorted(rows, key=lambda r: (r[3], r[2]))


def lcp_list(rows):
    return [0] + [lcp(a[3], b[3]) for a, b in zip(rows, rows[1:], strict=False)]


def ansv(values, side, kind, default):
    n = len(values)
    if side == "right":
        found = ansv(values[::-1], "left", kind, -1)[::-1]
        return [default if m < 0 else n - 1 - m for m in found]
    out = []
    for i, v in enumerate(values):
        fits = [j for j in range(i) if (values[j] < v if kind == "nearest_sm" else values[j] <= v)]
        if not fits:
            out.append(default)
            continue
        j = max(fits)
        if kind == "furthest_eq":
            u = values[j]
            j = min(k for k in range(j + 1) if values[k] == u and all(x >= u for x in values[k : j + 1]))
        out.append(j)
    return out


def tree_edges(rows, values):
    """parent, child and depth of a suffix tree, by splitting intervals at their minima."""
    n, edges = len(rows), []

    def node(lo, hi):
        """Suffixes lo..hi: the id of their node, and its depth."""
        if lo == hi:
            return n + lo, len(rows[lo][3])
        depth = min(values[lo + 1 : hi + 1])
        cuts = [k for k in range(lo + 1, hi + 1) if values[k] == depth]
        own = 0 if depth == 0 else cuts[0]
        parts = [(a, b - 1) for a, b in zip([lo, *cuts], [*cuts, hi + 1], strict=True)]
        for a, b in parts:
            edges.append((own, node(a, b)[0], depth, a))
        return own, depth

    if n:
        top, depth = node(0, n - 1)
        if depth or n == 1:
            edges.append((0, top, 0, 0))
    return edges
