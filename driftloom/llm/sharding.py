"""Shards of nearly equal bytes that never split a group of equal texts."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: Key ranges in the first summary, and how many groups the driver may list one by one.
ZONE_BITS, LISTED_GROUPS, SUB_BUCKETS = 12, 20_000, 256
#: Bits by which a range is cut finer when it holds too many groups to list.
FINER_BITS = 8


def _cuts(sizes: list[int], n: int, cap: int) -> list[int] | None:
    """Greedy check: ends of at most n runs that hold cap at most, or None."""
    prefix, ends, start = [0, *accumulate(sizes)], [], 0
    for _ in range(n):
        end = bisect_right(prefix, prefix[start] + cap) - 1
        ends.append(end)
        start = end
        if end == len(sizes):
            return ends + [end] * (n - len(ends))
    return None


def minimax_capacity(sizes: list[int], n: int) -> int:
    """Binary search for the smallest capacity that the greedy check accepts."""
    low, high = max([-(-sum(sizes) // n), *sizes, 0]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _cuts(sizes, n, mid) is not None else (mid + 1, high)
    return low


def even_cuts(sizes: list[int], n: int, cap: int) -> list[int]:
    """Ends of n runs under cap, each as near to an even cut as cap allows."""
    prefix = [0, *accumulate(sizes)]
    latest, end = [len(sizes)], len(sizes)  # the earliest ends from which the rest still fits, from the back
    for _ in range(n - 1):
        want = prefix[end] - cap
        end = bisect_right(prefix, want - 1) if want > 0 else 0
        latest.append(end)
    earliest, ends, start = latest[::-1], [], 0
    for k in range(n - 1):
        goal = prefix[start] + (prefix[-1] - prefix[start]) / (n - k)
        at = bisect_right(prefix, goal) - 1
        if at < len(sizes) and prefix[at + 1] - goal < goal - prefix[at]:
            at += 1
        most = bisect_right(prefix, prefix[start] + cap) - 1
        start = max(min(max(at, earliest[k], start), most), start)
        ends.append(start)
    return [*ends, len(sizes)]


def _uncertain(atoms: list[dict], n: int) -> set[int]:
    """Indexes of key ranges in which the exact search may have to cut.

    With every range kept whole the greedy check is too strict, with ranges cut anywhere it is too lax; the exact
    boundary for any capacity between the two answers lies between the two greedy positions.
    """
    sizes = [a["bytes"] for a in atoms]
    prefix = [0, *accumulate(sizes)]
    solid = [a["groups"] == 1 for a in atoms]

    def lax(cap: int) -> list[int] | None:
        at, out = 0, []
        for _ in range(n):
            at = min(at + cap, prefix[-1])
            i = bisect_right(prefix, at) - 1
            if i < len(sizes) and solid[i]:
                at = prefix[i]
            out.append(at)
        return out if at >= prefix[-1] else None

    high = minimax_capacity(sizes, n)
    low, top = max([-(-prefix[-1] // n), *(s for s, one in zip(sizes, solid, strict=True) if one), 0]), high
    while low < top:
        mid = (low + top) // 2
        low, top = (low, mid) if lax(mid) is not None else (mid + 1, top)
    start, found = 0, set()
    for right in lax(high):
        left = bisect_right(prefix, prefix[start] + low) - 1
        found.update(range(left, min(bisect_right(prefix, right), len(sizes))))
        start = left
    return {i for i in found if not solid[i]}


def plan_cuts(groups: DataFrame, n_shards: int, listed: int = LISTED_GROUPS) -> tuple[dict[int, int], list[int]]:
    """(shard of each heavy key, last keys of the other shards) for a table (key, bytes) of atomic groups.

    The driver sees sums of at most 2**ZONE_BITS key ranges, the groups over a 2**-ZONE_BITS part of all bytes (fewer
    than 2**ZONE_BITS), and the groups around possible cuts, whose ranges are cut finer until `listed` suffice.
    A group larger than an even share gets a shard of its own; the other large groups are spread evenly between the ranges
    of keys, and the smallest feasible capacity is searched for that order.
    """
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    heavy = {r.key: r.bytes for r in groups.where(F.col("bytes") > total / 2**ZONE_BITS).collect()}
    light = groups.where(F.col("bytes") <= total / 2**ZONE_BITS)

    own, rest, left = {}, total, n_shards
    for key, size in sorted(heavy.items(), key=lambda x: (-x[1], x[0])):
        if left > 1 and size * left > rest:
            own[key] = n_shards - left
            rest, left = rest - size, left - 1
    between = sorted(set(heavy) - set(own), key=lambda k: (-heavy[k], k))

    def summed(bits: int, within: DataFrame) -> list[dict]:
        zone = F.shiftright("key", 64 - bits)
        found = within.groupBy(zone.alias("zone")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("key").alias("last")).collect()
        return [{"key": r.last, "bytes": r.bytes, "groups": r.n, "zone": r.zone, "bits": bits} for r in found]

    zones = sorted(summed(ZONE_BITS, light), key=lambda a: a["key"])
    step = len(zones) / (len(between) + 1)
    order = sorted([(i + 1.0, 0, a) for i, a in enumerate(zones)] + [((i + 1) * step + 0.5, 1, {"key": k, "bytes": heavy[k], "groups": 1, "heavy": True}) for i, k in enumerate(between)], key=lambda x: x[:2])
    atoms = [a for *_, a in order]
    while True:
        open_ = range(len(atoms)) if count <= listed else sorted(_uncertain(atoms, left))
        open_ = [i for i in open_ if atoms[i]["groups"] > 1]
        if not open_:
            break
        one_by_one = sum(atoms[i]["groups"] for i in open_) <= listed
        parts: dict[tuple[int, int], list[dict]] = {}
        for bits in {atoms[i]["bits"] for i in open_}:
            at = F.shiftright("key", 64 - bits)
            inside = light.where(at.isin([atoms[i]["zone"] for i in open_ if atoms[i]["bits"] == bits]))
            if one_by_one or bits + FINER_BITS >= 64:
                more = [{"key": r.key, "bytes": r.bytes, "groups": 1, "zone": r.key >> (64 - bits)} for r in inside.collect()]
            else:
                more = [a | {"zone": a["zone"] >> FINER_BITS, "finer": a["zone"]} for a in summed(bits + FINER_BITS, inside)]
            for a in sorted(more, key=lambda a: a["key"]):
                parts.setdefault((bits, a["zone"]), []).append(a | ({"zone": a["finer"]} if "finer" in a else {}))
        atoms = [b for i, a in enumerate(atoms) for b in (parts[a["bits"], a["zone"]] if i in set(open_) else [a])]

    sizes = [a["bytes"] for a in atoms]
    cap = minimax_capacity(sizes, left)
    ends = even_cuts(sizes, left, cap)
    if max((sum(sizes[a:b]) for a, b in zip([0, *ends], ends, strict=False)), default=0) > cap:
        ends = _cuts(sizes, left, cap)
    last, shard_of, lasts, start = -(2**63), dict(own), [], 0
    for shard, end in enumerate(ends, n_shards - left):
        for a in atoms[start:end]:
            if a.get("heavy"):
                shard_of[a["key"]] = shard
            else:
                last = a["key"]
        lasts.append(last)
        start = end
    return shard_of, lasts


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows into n_shards of nearly equal bytes; rows with equal texts share a shard.

    Law `bytes`: a row weighs its text's UTF-8 bytes plus 8. The largest shard is as small as a contiguous partition of
    the ordered groups allows. A group larger than an even share fills a shard alone.
    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null for this law).
    A null text weighs 8, counts as an empty one for grouping and has the checksum of no bytes (0). Repeated rows each
    get a slot. Null ids are kept. Fewer groups than shards leave shards empty; an empty table gives no rows. Other
    columns of the input are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id", "key"))
    slim = materialize(slim.withColumn("sub", F.pmod(spread, F.lit(SUB_BUCKETS)).cast("int")), "shard-rows")
    groups = materialize(slim.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    shard_of, lasts = plan_cuts(groups, n_shards)
    first = n_shards - len(lasts)

    by_key = F.lit(first)
    for last in lasts[:-1]:
        by_key = by_key + (F.col("key") > F.lit(last)).cast("int")
    heavy = docs.sparkSession.createDataFrame(list(shard_of.items()), "key long, heavy_shard int")  # under 2**ZONE_BITS rows
    dealt = slim.join(F.broadcast(heavy), "key", "left").withColumn("shard", F.coalesce("heavy_shard", by_key.cast("int")))

    filled = dealt.groupBy("shard", "sub").count()  # at most n_shards * SUB_BUCKETS rows
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    base = filled.select("shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "sub").orderBy("doc_id", "key")
    return dealt.join(F.broadcast(base), ["shard", "sub"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.row_number().over(within) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
