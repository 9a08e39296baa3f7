"""Plain Python models of the pipeline for small inputs; slow and obvious on purpose."""

F = (0, 0, 0, 1, 3, 0, 0, 2)
R = (0, 3, 0, 2, 0, 0, 0, 1)


def pack(codes):
    n = 0
    for c in codes:
        n = n * 4 + c
    return n


def windows(seq: str, length: int):
    b = seq.encode()
    for p in range(len(b) - length + 1):
        w = b[p : p + length]
        yield pack(F[c & 7] for c in w), pack(R[c & 7] for c in reversed(w))


def counts(reads, length):
    out = {}
    for s in reads:
        for f, r in windows(s, length):
            out[f] = out.get(f, 0) + 1
            out[r] = out.get(r, 0) + 1
    return out


def graph(reads, length):
    cnt = counts(reads, length)
    mask = (1 << (2 * (length - 1))) - 1
    edges = [w for w in sorted(cnt) for _ in range(cnt[w])]
    kmers = sorted({w >> 2 for w in cnt} | {w & mask for w in cnt})
    idx = {k: i for i, k in enumerate(kmers)}
    leaving = [[] for _ in kmers]
    entering = [[] for _ in kmers]
    for e, w in enumerate(edges):
        leaving[idx[w >> 2]].append(e)
        entering[idx[w & mask]].append(e)
    succ = [None] * len(edges)
    for v in range(len(kmers)):
        for e, l in zip(entering[v], leaving[v]):
            succ[e] = l
    return edges, kmers, idx, leaving, entering, succ


def components(succ):
    label = list(range(len(succ)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for e, s in enumerate(succ):
        if s is not None:
            a, b = find(e), find(s)
            label[max(a, b)] = min(a, b)
    return [find(e) for e in range(len(succ))]


def assemble(reads, length):
    edges, kmers, idx, leaving, entering, succ = graph(reads, length)
    lab = components(succ)
    names = {d: i for i, d in enumerate(sorted(set(lab)))}
    cedges = []
    for lst in entering:
        for a, b in zip(lst, lst[1:]):
            x, y = names[lab[a]], names[lab[b]]
            if x != y:
                cedges.append((min(x, y), max(x, y), a, b))
    cedges.sort()
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    forest = []
    for i, (x, y, _, _) in enumerate(cedges):
        a, b = find(x), find(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            forest.append(i)
    mark = {min(cedges[i][2:]) for i in forest}
    new = list(succ)
    for lst in entering:
        i = 0
        while i < len(lst) - 1:
            if lst[i] in mark:
                t, keep = i, new[lst[i]]
                while i < len(lst) - 1 and lst[i] in mark:
                    new[lst[i]] = new[lst[i + 1]]
                    i += 1
                if t != i:
                    new[lst[i]] = keep
            i += 1
    pointed = {s for s in new if s is not None}
    contigs = {}
    for e in range(len(edges)):
        if e not in pointed:
            text = "".join("ACGT"[(edges[e] >> (2 * i)) & 3] for i in range(length - 1, -1, -1))
            at = new[e]
            while at is not None:
                text += "ACGT"[edges[at] & 3]
                at = new[at]
            contigs[e] = text
    return dict(
        edges=edges, kmers=kmers, idx=idx, leaving=leaving, entering=entering, succ=succ, lab=lab,
        cedges=cedges, forest=forest, mark=mark, swiped=new, contigs=contigs,
    )
