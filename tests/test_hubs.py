from __future__ import annotations

import random

from graphloom.operators import projection


def test_pairs_of_hubs_are_whole_where_they_are_made(spark):
    rng = random.Random(8)
    rows = list({(f"c{rng.randrange(14)}", f"f{rng.randrange(40)}é") for _ in range(300)} | {(f"d{k % 9}", f"f{rng.randrange(60)}é") for k in range(60)})
    edges = spark.createDataFrame([(a, b, "imports", rng.uniform(0.7, 0.89)) for a, b in rows] + [(f"f{k}é", f"f{k + 1}é", "calls", 0.95) for k in range(50)], "src string, dst string, relation string, confidence double")
    one = {(r.a, r.b): (r.citers, round(r.weight, 9)) for r in projection.co_citation(edges, hub=10**9).collect()}
    assert one == {(r.a, r.b): (r.citers, round(r.weight, 9)) for r in projection.co_citation(edges, hub=8).collect()} != {}
    cited = edges.where("relation = 'imports'").selectExpr("src AS citer", "dst AS to", "confidence AS c")
    more = spark.createDataFrame([("f1é", "f2é", 5, 4.0)], "a string, b string, n long, trust double")
    gone = spark.createDataFrame([("f3é", "f4é")], "a string, b string")
    whole, parts = ({(r.a, r.b): (r.n, round(r.trust, 9)) for r in made.collect()} for made in (projection.pairs_of_hubs(cited, *most, more, gone) for most in ((100, 100), (7, 3))))
    assert whole == parts and ("f3é", "f4é") not in whole and whole["f1é", "f2é"][0] >= 5
    # each pair comes once, so nothing has to bring its parts together
    made = projection.pairs_of_hubs(cited, 7, 3)
    assert made.count() == len(whole | {("f3é", "f4é"): 0})
