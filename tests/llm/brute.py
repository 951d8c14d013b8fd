"""Plain versions that the operators are held against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def shingles(text, size=3):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def thue_morse(n):
    """The sequence abba... and its complement; polynomial hashes modulo 2**64 can't tell these apart."""
    a = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def roots(nodes, edges):
    """Smallest node reachable from each."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar(sets, percent=85):
    """Links between ids by their sets, over pairs that share an element."""
    held, pairs = {}, set()
    for i, s in sets.items():
        for g in s:
            for j in held.setdefault(g, []):
                pairs.add((j, i))
            held[g].append(i)
    return [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def targets(sizes, weights, most=3.0):
    """Shares of sum(sizes) by weight, none above `most` times its size; the excess is shared again by weight among the others."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole >= most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out
