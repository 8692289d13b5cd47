import zlib
from collections import Counter, defaultdict

from driftloom.llm import sharding


def best_capacity(sizes, n):
    """Least largest sum of n contiguous runs, by dynamic programming."""
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    best = prefix[:]
    for _ in range(n - 1):
        best = [min(max(best[j], prefix[i] - prefix[j]) for j in range(i + 1)) for i in range(len(prefix))]
    return best[-1]


def test_minimax_matches_dynamic_programming():
    import random

    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 25))]
        n = rng.randint(1, 6)
        cap = sharding.minimax_capacity(sizes, n)
        assert cap == best_capacity(sizes, n)
        for ends in (sharding._cuts(sizes, n, cap), sharding.even_cuts(sizes, n, cap)):
            assert ends[-1] == len(sizes) and len(ends) == n
            assert all(sum(sizes[a:b]) <= cap for a, b in zip([0, *ends], ends, strict=False))


def test_ranges_give_the_same_capacity_as_single_groups(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.randint(-(2**63), 2**63 - 1), rng.randint(9, 400)) for _ in range(3000)]
    groups = spark.createDataFrame(rows, "key long, bytes long")
    loads = []
    for listed in (10**6, 200):
        shard_of, lasts = sharding.plan_cuts(groups, 7, listed)
        load = Counter()
        for key, size in rows:
            load[shard_of[key] if key in shard_of else 7 - len(lasts) + sum(key > x for x in lasts[:-1])] += size
        loads.append(max(load.values()))
    assert loads[0] == loads[1]


def test_all_rows_once_and_groups_whole(spark, docs, texts):
    out = sharding.shard_documents(docs, 24).collect()
    assert len(out) == len(texts)
    sizes = Counter((i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == sizes
    shards, groups = defaultdict(list), defaultdict(set)
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
        shards[r.shard].append(r)
        groups[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in shards.values())


def test_a_group_over_an_even_share_stands_alone(spark):
    rows = [(i, "x" * 1000) for i in range(50)] + [(100 + i, f"text number {i}") for i in range(200)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    big = {r.shard for r in out if r["size"] == 1008}
    assert len(big) == 1 and all(r["size"] == 1008 for r in out if r.shard in big)
    load = Counter()
    for r in out:
        if r.shard not in big:
            load[r.shard] += r["size"]
    assert len(load) == 3 and max(load.values()) - min(load.values()) <= 30


def test_empty(spark, no_docs):
    assert sharding.shard_documents(no_docs, 24).count() == 0
