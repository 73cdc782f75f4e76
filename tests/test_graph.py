"""Components against a plain search."""

import random

import pytest

from tidewright.operators import graph


@pytest.mark.parametrize("few", [10**6, 25, 0])
def test_components_against_a_plain_search(spark, few):
    r = random.Random(few)
    edges = [(i, i + 1) for i in range(150)] + [(500, 501), (501, 500), (7, 7)] + [(900, 901 + i) for i in range(100)] + [(-5, 2000), (2000, 3000)]
    edges += [(r.randrange(4000, 4400), r.randrange(4000, 4400)) for _ in range(180)]
    links = {}
    for a, b in edges:
        if a != b:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    want, seen = {}, set()
    for start in sorted(links):
        todo = [start] if start not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                want[x] = start
                todo += links[x]
    df = spark.createDataFrame(edges, "a long, b long")
    rows = graph.components(df, few=few).collect()
    assert {x.node: x.root for x in rows} == want and len(rows) == len(want)
    assert graph.components(df.filter("false"), few=few).count() == 0 and graph.components(df.filter("a = b"), few=few).count() == 0
