"""Groups of documents whose sets of word shingles are alike, by an exact similarity join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .components import components
from .storage import batch_rows, free_name, give_back, materialize, release

#: Rows that Python workers get at a time: texts, and pairs of whole sets.
TEXT_ROWS, PAIR_ROWS = 1000, 200
#: Bytes hashed at once; nodes whose fingerprints are broadcast; groups at one shingle beyond which it is put last.
BLOCK_BYTES, MAX_BROADCAST_NODES, COMMON = 1 << 18, 300_000, 50
#: Most common shingles that are broadcast, 8 bytes each; more are joined by shuffle.
MAX_BROADCAST_COMMON = 1_000_000
#: Most bits of a bitmap; shingles of a prefix by which nodes are dealt to buckets and pairs to one tile.
MAX_BITS, LISTED = 1 << 12, 4
#: Nodes that make a tile large; nodes and shingles of a bucket; pairs checked in a bucket for each of its nodes.
LARGE_TILE, BUCKET_NODES, BUCKET_ITEMS, CHECKS = 64, 256, 1 << 20, 8

_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C55
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < size:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = []
        for base in (_BASE, inverse):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str, table: bytes = _LOWER) -> np.ndarray:
    """A 64-bit hash of each word of a text, from running sums over its bytes. `table` maps bytes between words to 32."""
    raw = text.encode().translate(table)
    out, at = [], 0
    while at < len(raw):
        end = raw.find(b" ", at + BLOCK_BYTES)
        end = len(raw) if end < 0 else end
        block = np.frombuffer(raw, np.uint8, end - at, at)
        power, inverse = _power_tables(max(len(block) + 1, 1 << 16))
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[: len(block)], out=sums[1:])
        solid = np.zeros(len(block) + 2, np.int8)
        solid[1:-1] = block != 32
        edges = np.flatnonzero(np.diff(solid))
        first, last = edges[::2], edges[1::2]
        out.append(_mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` consecutive words, given theirs."""
    sums = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        sums = sums * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - size + 1 + j]
    return _mix(sums)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; of a shorter text, its whole sequence as one."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return np.zeros(0, np.int64)
    size = min(k, len(words))
    return np.unique(window_hashes(words, size).view(np.int64))


def overlap_needed(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set it links to."""
    return -(-percent * n // 100)


def extra_prefix(n: int, percent: int) -> int:
    """How many shared shingles the longer prefix demands: about a third of the length of the shortest valid prefix."""
    return max(1, (n - overlap_needed(n, percent) + 1) // 3)


def prefix_length(n: int, percent: int) -> int:
    return n - overlap_needed(n, percent) + extra_prefix(n, percent)


def _band_width(percent: int) -> float:
    return math.log(100 / percent) * (1 + 1e-9)


def band_of(n: int, percent: int) -> int:
    """Sizes that may link lie in the same band or in neighbouring ones."""
    return int(math.log(n) // _band_width(percent))


def bitmap(items: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Parities of hashed shingles, two to four bits for each shingle of the band's largest set, at least 64, at most MAX_BITS.

    Shingles that two sets share cancel out, so the bits in which two bitmaps differ are at most as many as the shingles in
    only one of the sets, however many bits there are. Packed into signed 64-bit numbers.
    """
    bits = min(MAX_BITS, 1 << max(6, 1 + math.ceil((band + 1) * _band_width(percent) / math.log(2))))
    return _parities(items, bits).view(np.int64)


def _parities(items: np.ndarray, bits: int) -> np.ndarray:
    parity = np.bincount((items & (bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def _fingerprint(items: np.ndarray) -> bytes | None:
    return blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def _prefixes(k: int, percent: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()
        for texts in batches:
            out = []
            for text in texts:
                s = shingle_set(text, k)
                out.append((len(s), _fingerprint(s), s[: prefix_length(len(s), percent)] if len(s) else None))
            yield pd.DataFrame(out, columns=["n", "fp", "prefix"])
            del texts, out
            give_back()

    return pandas_udf(run, "n long, fp binary, prefix array<long>")


def _whole_sets(k: int, percent: int):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, wanted in batches:
            out = []
            for text, number in zip(texts, wanted, strict=True):
                s = shingle_set(text, k)
                band = band_of(len(s), percent)
                out.append((s, bitmap(s, band, percent), bitmap(s, band + 1, percent)))
            yield pd.DataFrame(out, columns=["items", "bits", "bits_above"])
            del texts, wanted, out
            give_back()

    return pandas_udf(run, "items array<long>, bits array<long>, bits_above array<long>")


def _fingerprints(k: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_fingerprint(shingle_set(t, k)) for t in texts], dtype=object)
            del texts
            give_back()

    return pandas_udf(run, "binary")


def _shared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Size of the intersection of two sorted arrays."""
    for left, right in batches:
        out = np.empty(len(left), np.int64)
        for i, (a, b) in enumerate(zip(left, right, strict=True)):
            a, b = np.asarray(a), np.asarray(b)
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            out[i] = np.count_nonzero(b[at] == a)
        yield pd.Series(out)


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _bits_fit(n_a: Column, n_b: Column, bits_a: Column, bits_b: Column, percent: int) -> Column:
    """Not more differing bits than two linked sets of these sizes may have differing shingles."""
    total = n_a + n_b
    need = F.ceil(F.lit(percent) * total / (100 + percent) - 1e-9)
    differ = F.aggregate(F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return differ <= total - 2 * need


def _need(n: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * n / 100 - 1e-9)


def bucket_links(sets: list[np.ndarray], comps: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of comps that some linked pair of these sets joins: the likeliest pairs by bitmap first, each checked exactly.

    Pairs whose comps are joined already are passed over, and at most CHECKS pairs a set are tried, since the links that
    matter and are not found here are found by the join of whole tiles.
    """
    n = np.array([len(s) for s in sets], np.int64)
    bits = min(MAX_BITS, 1 << max(6, 1 + int(n.max()).bit_length()))
    maps = np.stack([_parities(s, bits) for s in sets])
    total = n[:, None] + n[None]
    room = total - 2 * -(-percent * total // (100 + percent))
    differ = np.stack([np.bitwise_count(maps ^ row).sum(1, dtype=np.int64) for row in maps])
    left, right = np.nonzero(np.triu((differ <= room) & (comps[:, None] != comps[None]), 1))
    order = np.argsort(differ[left, right] / room[left, right].clip(1), kind="stable")
    root = {c: c for c in comps.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    links, tries = [], CHECKS * len(sets)
    for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
        a, b = find(int(comps[i])), find(int(comps[j]))
        if a != b:
            if _links(sets[i], sets[j], percent):
                links.append((a, b))
                root[max(a, b)] = min(a, b)
            tries -= 1
            if not tries:
                break
    return links


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _bucket(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        found = bucket_links([np.asarray(s) for s in pdf["items"]], pdf["comp"].to_numpy(), percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _sent(few: DataFrame, rows: int) -> DataFrame:
    """Broadcast a counted table if its rows, of a few numbers each, are not too many."""
    return F.broadcast(few) if rows <= MAX_BROADCAST_NODES else few


def _late_last(percent: int, late):
    """A column function: the prefix of a set in the order that puts shingles of the broadcast sorted array last."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common = late.value
        for sets in batches:
            out = []
            for s in sets:
                s = np.asarray(s)
                is_late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                out.append(np.concatenate([s[~is_late], s[is_late]])[: len(s) - overlap_needed(len(s), percent) + 1])
            yield pd.Series(out)

    return pandas_udf(run, "array<long>")


class _Join:
    """The steps of one join over `sets` (node, n, band, items, bits, bits_above) of nodes that may link.

    `comp` (node, comp) holds the groups found so far.
    """

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.comp = materialize(sets.select("node", F.col("node").alias("comp")), "groups")

    def merge(self, links: DataFrame) -> None:
        """Take in links (a, b) between groups."""
        found = components(links)
        known = self.comp.join(found.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left")
        after = materialize(known.select("node", F.coalesce("to", "comp").alias("comp")), "groups")
        release(self.comp, found)
        self.comp = after

    def merge_tiles(self, listed: DataFrame) -> None:
        """Rounds that join most groups with work that is linear in the nodes.

        Round r deals nodes by the tile of their r-th listed shingle to buckets of bounded size, a large tile at random to
        several, and joins what links within a bucket. Small tiles go whole and together to buckets of the first round
        only. Rounds end when one joins hardly anything; what is left costs more pairs, not links.
        """
        width = _band_width(self.percent)
        small, r = F.col("count") < LARGE_TILE, 0
        while True:
            band = F.floor(F.log(F.col("n").cast("double")) / width + 0.5 * (r % 2))
            rows = listed.select("node", "n", F.get("first", F.lit(r % LISTED)).alias("token"), band.alias("tile_band")).where("token is not null")
            rows = rows.join(self.comp, "node")
            size = rows.groupBy("token", "tile_band").agg(F.count("*").alias("count"), F.sum("n").alias("total"), F.min("comp").alias("low"), F.max("comp").alias("high"))
            size = size.where(f"low < high and count >= {LARGE_TILE if r else 2}").select("token", "tile_band", F.xxhash64("token", "tile_band").alias("tile"), "count", "total")
            dealt = materialize(rows.join(size, ["token", "tile_band"]).select("node", "comp", "n", "tile", "count", "total"), "dealt")
            n_dealt, pool, pool_items = dealt.agg(F.count("*"), F.count(F.when(small, 1)), F.sum(F.when(small, F.col("n")))).first()
            n_links = 0
            if n_dealt:
                pools = 1 + max(pool // BUCKET_NODES, (pool_items or 0) // BUCKET_ITEMS)
                parts = F.ceil(F.greatest(F.col("count") / BUCKET_NODES, F.col("total") / BUCKET_ITEMS))
                key = F.when(small, F.struct(F.lit(0).cast("long").alias("tile"), F.pmod(F.col("tile"), F.lit(pools)).alias("part")))
                key = key.otherwise(F.struct("tile", F.pmod(F.xxhash64("node", F.lit(r)), parts).alias("part"))).alias("bucket")
                full = _sent(dealt.select("node", "comp", key), n_dealt).join(self.sets.select("node", "items"), "node")
                links = materialize(full.groupBy("bucket").applyInPandas(_bucket(self.percent), "a long, b long"), "links")
                n_links = links.count()
                if n_links:
                    self.merge(links)
                release(links)
            release(dealt)
            r += 1
            if n_links * 100 <= n_dealt:
                break

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, comp_a, comp_b) that link, by the exact intersection of their sorted arrays, as pairs of groups."""
        nodes = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "pair-nodes")
        sets = self.sets.join(_sent(nodes, nodes.count()), "node", "left_semi")
        side = lambda s: sets.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("items").alias(f"items_{s}"))
        rows = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", pandas_udf(_shared, "long")(F.col("items_a"), F.col("items_b")))
        links = rows.where(100 * F.col("shared") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("shared")))
        with batch_rows(pairs.sparkSession, PAIR_ROWS):
            out = materialize(links.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct(), "links")
        release(nodes)
        return out

    def merge_rest(self, tiles: DataFrame) -> None:
        """All pairs of different groups in a tile (token, node, n, pos), of the same or neighbouring bands.

        Both nodes list their first shingles of such tiles; a pair is made in one tile where they list a shared one, and only if the places of the tile's shingle
        leave room for enough shared ones behind it, and if their bitmaps do. One side leaves out the tile's largest group.
        """
        percent = self.percent
        band = F.floor(F.log(F.col("n").cast("double")) / _band_width(percent)).cast("int")
        rows = tiles.join(self.comp, "node").withColumn("band", band)
        host = rows.select("token", "node", "n", "pos", "comp", "band", F.lit(0).alias("guest"))
        guest = rows.select("token", "node", "n", "pos", "comp", (F.col("band") + 1).alias("band"), F.lit(1).alias("guest"))
        early = (100 + percent) * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n")  # so early stands what the smaller of two shares
        ends = [F.min("guest").alias("guest"), F.min(F.when(early, 0)).alias("early"), F.count("*").alias("count")]
        at = host.unionAll(guest).groupBy("token", "band", "comp").agg(*ends).groupBy("token", "band")
        at = at.agg(F.max_by("comp", F.struct("count", "comp")).alias("largest"), F.count("*").alias("groups"), F.min("guest").alias("guest"), F.min("early").alias("early"))
        at = materialize(at.where("groups > 1 and guest = 0 and early = 0").select("token", "band", "largest"), "split-tiles")
        rows = materialize(host.unionAll(guest).join(at, ["token", "band"]), "tile-nodes")  # few are left to carry bitmaps
        first = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_set(F.struct("pos", "token"))), 1, LISTED).alias("at"))  # a node's own
        first = first.select("node", *[F.get("at", F.lit(i))["token"].alias(f"f{i}") for i in range(LISTED)])
        bits = F.when(F.col("guest") == 1, F.col("bits_above")).otherwise(F.col("bits")).alias("bits")
        known = first.join(self.sets.select("node", "bits", "bits_above"), "node")
        all_rows = materialize(rows.join(known, "node").select(*rows.columns, *first.columns[1:], bits), "tile-rows")
        a = all_rows.where("comp <> largest").drop("largest")
        b = all_rows.select(*[F.col(c).alias(f"{c}_b") for c in all_rows.columns])
        once = (F.col("guest") + F.col("guest_b") < 2) & (
            (F.col("comp_b") == F.col("largest_b")) | (F.col("guest") > F.col("guest_b")) | ((F.col("guest") == F.col("guest_b")) & (F.col("node") < F.col("node_b")))
        )
        elsewhere = F.lit(False)  # a listed shingle of both comes before this tile's
        for i in reversed(range(LISTED)):
            mine = F.col(f"f{i}")
            elsewhere = F.when(mine.isin(*[F.col(f"f{j}_b") for j in range(LISTED)]), mine != F.col("token")).otherwise(elsewhere)
        room = (100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b")) >= percent * (F.col("n") + F.col("n_b"))
        test = (F.col("comp") != F.col("comp_b")) & once & _sizes_fit(F.col("n"), F.col("n_b"), percent) & room & ~F.coalesce(elsewhere, F.lit(False))
        test = test & _bits_fit(F.col("n"), F.col("n_b"), F.col("bits"), F.col("bits_b"), percent)
        near = a.join(b, (F.col("token") == F.col("token_b")) & (F.col("band") == F.col("band_b")) & test)
        order = lambda x, y: (F.when(F.col("node") < F.col("node_b"), F.col(x)).otherwise(F.col(y)))
        pairs = near.select(order("node", "node_b").alias("a"), order("node_b", "node").alias("b"), order("comp", "comp_b").alias("comp_a"), order("comp_b", "comp").alias("comp_b"))
        pairs = materialize(pairs.distinct(), "pairs")
        release(at, rows, all_rows)
        links = self.linked(pairs)
        self.merge(links)
        release(pairs, links)


def link_documents(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs.

    A row's set holds the distinct k-word shingles of its whole text (A-Z in lower case; a shorter text is one shingle; a
    text without words has no set and links with nothing). Two sets link if 100 * intersection >= percent * union.
    component_id is the smallest id reachable by links. Equal sets are one node, so copies never make pairs.

    1. A set that links shares some shingle of its prefix (the first n - need + 1 by hash) with its partner's prefix, and
       several of a longer prefix. Counting how many sets hold each prefix shingle drops all nodes with too few.
    2. Tiles are prefix shingle by size band. Nodes of shared tiles are dealt to buckets of bounded size, by another
       shingle in every round, and what links in a bucket is joined, until a round joins hardly anything.
    3. All pairs of different groups in a tile, of the same or neighbouring bands, are compared by the places of the
       shingle in both orders and by hashed bitmaps whose differing bits bound the intersection from above, then by
       exact intersection. Shingles that more than `common` groups hold come last in the order that defines prefixes, so
       common passages make no large tiles. A pair within one group cannot change the result and is skipped; no other is.

    Null ids are left out when the smallest is taken (a group of them only has a null component_id); rows without a set
    are their own component. Repeated rows are equal sets. An empty table gives no rows. Other columns are not read. Very
    long texts are hashed in blocks; their sets are arrays of 8 bytes for each distinct shingle.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with batch_rows(spark, TEXT_ROWS):
        wide = materialize(texts.select("doc_id", _prefixes(k, percent)(F.col("text")).alias("s")).select("doc_id", "s.*"), "shingle-prefixes")
    nodes = wide.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = materialize(wide.select("doc_id", "n", "fp"), "rows")
    release(wide)

    placed = nodes.select("node", F.posexplode("prefix").alias("pos", "token"))
    shared = placed.groupBy("token").count().where("count > 1").select("token")
    held = materialize(placed.join(shared, "token").select("node", "pos", "token"), "shared-shingles")
    least = F.greatest(F.lit(1), F.floor((F.col("n") - _need(F.col("n"), percent) + 1) / 3))
    listed = held.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("at")).join(nodes.select("node", "fp", "n"), "node")
    short = F.filter("at", lambda t: t["pos"] <= F.col("n") - _need(F.col("n"), percent))
    listed = listed.where((F.size("at") >= least) & (F.size(short) > 0)).select("node", "fp", "n", short.alias("at"), F.slice(F.transform(short, lambda t: t["token"]), 1, LISTED).alias("first"))
    listed = materialize(listed, "candidates")
    named = materialize(nodes.select("fp", "id", "node"), "names")
    release(held, nodes)

    n_alive = listed.count()
    if n_alive:
        with batch_rows(spark, TEXT_ROWS):
            sets = materialize(_sets_of(texts, listed, n_alive, k, percent), "shingle-sets")
        join = _Join(sets, percent)
        join.merge_tiles(listed)
        tiles = _common_last(join, listed, common)
        join.merge_rest(tiles)
        found = named.join(join.comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        smallest = found.groupBy("comp").agg(F.min("id").alias("component_id"))
        found = materialize(found.join(smallest, "comp").select("fp", "component_id"), "components")
        release(sets, tiles, join.comp)
    else:
        found = materialize(named.select("fp", F.col("id").alias("component_id")), "components")
    release(listed, named)
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(found, "fp", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))


def _sets_of(texts: DataFrame, alive: DataFrame, n_alive: int, k: int, percent: int) -> DataFrame:
    """The whole sets of nodes in alive, hashed again from the texts, one for each node."""
    wanted = alive.select("fp", "node", "n")
    if n_alive <= MAX_BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    found = texts.withColumn("fp", _fingerprints(k)(F.col("text"))).join(wanted, "fp").select("node", "n", "text").dropDuplicates(["node"])
    made = found.withColumn("s", _whole_sets(k, percent)(F.col("text"), F.col("node")))
    band = F.floor(F.log(F.col("n").cast("double")) / _band_width(percent)).cast("int")
    return made.select("node", "n", band.alias("band"), "s.*")


def _common_last(join: _Join, listed: DataFrame, common: int) -> DataFrame:
    """Tiles (token, node, n, pos) whose prefixes are taken anew where a shingle is held by over `common` groups.

    Such shingles come last in the order of all shingles. Nodes whose prefix holds none keep it: it is the same in both orders.
    """
    percent = join.percent
    columns = lambda of: of.select("node", "n", F.explode("at").alias("t")).select("t.token", "node", "n", "t.pos")
    tiles = columns(listed)
    groups_at = tiles.join(join.comp, "node").select("token", "comp").distinct().groupBy("token").count()
    frequent = materialize(groups_at.where(F.col("count") > common).select("token"), "common")
    touched = materialize(tiles.join(frequent, "token", "left_semi").select("node").distinct(), "touched")
    n_frequent, spark = frequent.count(), listed.sparkSession
    again = join.sets.join(_sent(touched, touched.count()), "node", "left_semi").select("node", "n", "items")
    if 0 < n_frequent <= MAX_BROADCAST_COMMON:
        late = spark.sparkContext.broadcast(np.sort(frequent.toPandas()["token"].to_numpy(np.int64)))
        ordered = again.select("node", "n", _late_last(percent, late)(F.col("items")).alias("prefix"))
    else:
        again = again.select("node", "n", F.explode("items").alias("token"))
        again = again.join(frequent.withColumn("late", F.lit(1)), "token", "left").withColumn("late", F.coalesce("late", F.lit(0)))
        ordered = again.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("late", "token"))).alias("all"))  # a node's own shingles
        prefix = F.slice("all", F.lit(1), (F.col("n") - _need(F.col("n"), percent) + 1).cast("int"))
        ordered = ordered.select("node", "n", F.transform(prefix, lambda t: t["token"]).alias("prefix"))
    ordered = ordered.select("node", "n", F.transform("prefix", lambda t, i: F.struct(i.alias("pos"), t.alias("token"))).alias("at"))
    with batch_rows(spark, PAIR_ROWS):
        out = materialize(columns(listed.join(touched, "node", "left_anti")).unionByName(columns(ordered)), "tiles")  # joins above a union of shuffles may fail
    release(frequent, touched)
    return out


#: Most rows to drop whose numbers are broadcast to the documents; more are joined by shuffle.
MAX_BROADCAST_DROPS = 1_000_000


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of linked rows, its first in the order of the input, whatever its id.

    Rows without a set (null or blank texts) all stay. All columns stay.
    """
    number = free_name(docs, "_row")
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    groups = materialize(link_documents(numbered.select(number, "text"), k, percent, id_col=number), "duplicates")
    drop = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(number))
    if drop.count() <= MAX_BROADCAST_DROPS:
        drop = F.broadcast(drop)
    return numbered.join(drop, number, "left_anti").select(*docs.columns)
