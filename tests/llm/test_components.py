"""Components by contraction: links within a label are met no more, labels go on from earlier ones."""
import random

from barloom.llm import near_dedup


def reached(links):
    root = {x: x for l in links for x in l}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = sorted((of(a), of(b)))
        root[y] = x
    return {x: of(x) for x in root}


def test_a_group_of_all_pairs_and_random_links(spark, monkeypatch):
    rng = random.Random(4)
    links = [(a, b) for a in range(40) for b in range(a)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)]
    links = [l for l in links if l[0] != l[1]]
    rows, stage = [], near_dedup.stage
    monkeypatch.setattr(near_dedup, "stage", lambda d: rows.append(stage(d)) or rows[-1])
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == reached(links)
    # each link is staged once; what follows are labels and links between them
    assert sum(d.count() for d in rows if "b" in d.columns) < 1.2 * len(links)


def test_labels_go_on_from_earlier_ones(spark):
    first, then = [(5, 3), (9, 7), (3, 1)], [(7, 5), (20, 9), (5, 1), (30, 31)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    known = near_dedup.labels_of(frame(first))
    assert near_dedup.between(frame(then), known).count() == 3  # (5, 1) is one already
    got = {r.node: r.root for r in near_dedup.labels_of(frame(then), known).collect()}
    assert got == {x: r for x, r in reached(first + then).items() if x != r}
