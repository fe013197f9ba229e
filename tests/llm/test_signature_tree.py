"""One signature tree over many classes: it links what brute force links, and compares few of the pairs."""

import random

import numpy as np

from ledgerloom.llm import jaccard_join


def made_sets(seed, count):
    rnd = random.Random(seed)
    out = []
    for _ in range(count):
        base = {rnd.getrandbits(64) for _ in range(rnd.choice([1, 3, 20, 60, 200]))}
        out.append(base)
        if rnd.random() < 0.2:
            gone = rnd.sample(sorted(base), len(base) // rnd.choice([4, 8, 20]))
            out.append((base - set(gone)) | {rnd.getrandbits(64) for _ in range(len(base) // 30)})
    return [np.array(sorted(s), dtype=np.uint64) for s in out]


def test_tree_links_what_brute_force_links(monkeypatch):
    own = made_sets(4, 400)
    compared, similar = [], jaccard_join.similar
    monkeypatch.setattr(jaccard_join, "similar", lambda a, b: compared.append(1) or similar(a, b))
    links = jaccard_join.Links(list(range(len(own))))
    for x, y in jaccard_join.tree_links(own, list(range(len(own)))):
        assert similar(own[x], own[y])
        a, b = links.find(x), links.find(y)
        links.parent[max(a, b)] = min(a, b)
    want = jaccard_join.Links(list(range(len(own))))
    found = 0
    for x in range(len(own)):
        for y in range(x):
            common = len(set(own[x].tolist()) & set(own[y].tolist()))
            if 100 * common >= 75 * (len(own[x]) + len(own[y]) - common):
                found += 1
                a, b = want.find(x), want.find(y)
                want.parent[max(a, b)] = min(a, b)
    assert links.roots().tolist() == want.roots().tolist() and found > 40
    assert len(compared) < len(own) * len(own) / 2 / 50
