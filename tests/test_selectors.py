"""Prototype selectors against brute force: every row may be chosen, whatever a task or the driver holds."""

import random

import pytest

from driftloom.operators import prototypes


def shared(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True))


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "row_id long, label int, leaves array<int>").repartition(3)


def brute_path(rows, label, k):
    """Rows of a class, each the first of those that raise the sum of best likeness most, with its gain in trees."""
    mine = sorted(r for r in rows if r[1] == label)
    best, out = [0] * len(mine), []
    for _ in range(k):
        gain = {c[0]: sum(max(shared(c[2], r[2]) - b, 0) for r, b in zip(mine, best, strict=True)) for c in mine if c[0] not in [i for i, _ in out]}
        pick = min(gain, key=lambda i: (-gain[i], i))
        out.append((pick, gain[pick]))
        leaves = next(r[2] for r in mine if r[0] == pick)
        best = [max(b, shared(leaves, r[2])) for b, r in zip(best, mine, strict=True)]
    return out


def distinct_rows(n, trees, leaves, seed):
    rng = random.Random(seed)
    return [(i, i % 2, list(x)) for i, x in enumerate({tuple(rng.randrange(leaves) for _ in range(trees)) for _ in range(n)})]


@pytest.mark.parametrize("held, block", [(1024, 32_768), (5, 30), (300, 64), (1, 1000)])
def test_choices_do_not_depend_on_bounds(spark, held, block):
    rows = distinct_rows(160, 6, 4, 3)
    got = prototypes.select(frame_of(spark, rows), "kmedoids", 6, held=held, block=block).collect()
    assert {c: [r.row_id for r in got if r["class"] == c] for c in (0, 1)} == {c: [i for i, _ in brute_path(rows, c, 6)] for c in (0, 1)}


def test_every_combination_is_a_candidate(spark):
    """Of 4,000 different rows of a class one is like all others; hashing some away would lose it."""
    rng = random.Random(1)
    for middle in (17, 1234, 2999):
        rows = [(i, 0, [7] * 12 if i == middle else [7 if t == i % 12 else rng.randrange(8, 200) for t in range(12)]) for i in range(4_000)]
        got = prototypes.select(frame_of(spark, rows), "kmedoids", 1).collect()
        assert [r.row_id for r in got] == [middle]


@pytest.mark.parametrize("block", [32_768, 20])
def test_accuracy_takes_any_row(spark, block):
    rng = random.Random(6)
    rows = [(i, i % 3, [(i % 3) * (rng.random() < 0.6) + 3 * (rng.random() < 0.3) for _ in range(5)]) for i in range(70)]
    chosen = [r.row_id for r in prototypes.select(frame_of(spark, rows), "accuracy", 3, block=block).collect()]

    def right(protos):
        return sum(max(protos, key=lambda p: (shared(rows[p][2], r[2]), -protos.index(p))) % 3 == r[1] for r in rows)

    first = {(r[1], tuple(r[2])): r[0] for r in reversed(rows)}  # of equal rows of a class the first stands for all
    for k, pick in enumerate(chosen):
        scores = {i: right([*chosen[:k], i]) for i in first.values() if i not in chosen[:k]}
        assert pick == min(scores, key=lambda i: (-scores[i], i))


def test_rows_without_label_and_no_rows(spark):
    rows = [(0, None, [1, 2]), (1, 1, [3, 2]), (2, 1, [3, 1])]
    assert [(r.row_id, r["class"]) for r in prototypes.select(frame_of(spark, rows), "apete").collect()] == [(1, 1), (2, 1)]
    for method in ("apete", "accuracy", "kmedoids"):
        assert prototypes.select(frame_of(spark, rows[:1]), method).collect() == []
