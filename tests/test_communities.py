from __future__ import annotations

import random

from graphloom.operators import community


def test_networks_beyond_the_drivers_size_get_communities(spark, monkeypatch):
    rng = random.Random(5)
    links = {(f"m{g}/f{a}", f"m{g}/f{b}"): 1.0 for g in range(12) for a in range(8) for b in range(8) if a != b and rng.random() < 0.7}
    links |= {(f"m{g}/f0", f"m{(g + 1) % 12}/f1"): 0.2 for g in range(12)}
    links[("m0/f0", "m0/f0")] = 1.0
    net = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "a string, b string, weight double")
    names = sorted({x for ab in links for x in ab})
    place = {x: i for i, x in enumerate(names)}
    own = [(place[a], place[b], w) for (a, b), w in sorted(links.items())]
    module, best = community.optimise(len(names), own)
    for most in (10,):  # modules of modules go by rounds too
        monkeypatch.setattr(community, "MOST_EDGES", most)
        found = {r.file: r.community for r in community.communities(net).collect()}  # was an error
        assert sorted(found) == names
        p, flow = community.flows(len(names), own, 0.05)
        assert community.codelength(p, flow, [found[x] for x in names]) <= best * 1.01
        assert len({(module[place[x]], found[x]) for x in names}) == len(set(found.values())) == 12
