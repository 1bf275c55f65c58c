"""Components that are kept up to date against those from scratch."""

import random

from lorespark.operators import graph, linking


def scratch(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return sorted((n, find(n)) for n in root)


def test_random_histories(spark):
    random.seed(6)
    pair = lambda: tuple(sorted(random.sample(range(30), 2)))
    frame = lambda rows: spark.createDataFrame(sorted(rows), "a int, b int")
    links = {pair() for _ in range(18)}
    members, held = linking.components(frame(links)), frame(links)
    for _ in range(4):
        gone, new = set(random.sample(sorted(links), 5)), {pair() for _ in range(4)}
        links = (links - gone) | new
        turned = [(b, a) for a, b in gone]
        members, held = linking.maintained(members, held, frame(turned), frame(new))
        assert sorted(tuple(r) for r in members.collect()) == scratch(links)
        assert {tuple(r) for r in held.collect()} == links
    members, _ = linking.maintained(members, held, held, frame([]))
    assert members.count() == 0


def test_cascade_leaves_no_orphans(spark):
    f = spark.createDataFrame
    entities = f([("e1", "d1"), ("e2", "d1"), ("e3", "d2")], "entity_id string, document_id string")
    relations = f([("r1", "e1", "e2"), ("r2", "e1", "e3")], "relation_id string, source_entity_id string, target_entity_id string")
    support = f([("entity", "e1", "d1"), ("entity", "e1", "d2"), ("entity", "e2", "d1"), ("entity", "e3", "d2"), ("relation", "r1", "d2"), ("relation", "r2", "d2")], "node_kind string, node_id string, document_id string")
    links = f([("e1", "e2"), ("e1", "e3")], "a string, b string")
    members = f([("e1", "c1"), ("e2", "c2"), ("e3", "c1")], "local_entity_id string, canonical_entity_id string")
    left = graph.without_document(entities, relations, support, "d1", links, members, members.select("canonical_entity_id").distinct())
    first = {k: sorted(r[0] for r in df.select(df.columns[0]).collect()) for k, df in left.items() if k != "support"}
    assert first == {"relations": ["r2"], "entities": ["e1", "e3"], "links": ["e1"], "memberships": ["e1", "e3"], "canonicals": ["c1"]}
