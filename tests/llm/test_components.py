"""Connected components against a plain search, in one task and in rounds."""

import random

import pytest

from quillion.llm import components


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(500, x) for x in range(501, 560)] + [(7, 7), (None, 3)]
    around: dict = {}
    for a, b in edges:
        if a is not None:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(around):
        if n not in want:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += around[x]
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(3))
    assert {r.node: r.root for r in got.collect()} == want
