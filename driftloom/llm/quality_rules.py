"""Ordered rules over document statistics, learnt by sequential covering."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

SPACE = r"[ \t\n\x0B\f\r]+"
#: Limits of the learner: rules, conditions of a rule, quantiles tried as thresholds, least precision and rows of a rule.
MAX_RULES, MAX_CONDITIONS, QUANTILES, MIN_PRECISION, MIN_ROWS = 8, 3, 32, 0.85, 4

#: Ratios that conditions test, by name, in terms of the statistics.
RATIOS = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "upper_case": "n_upper / greatest(word_chars, 1)",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words within 3-word windows that the array holds twice or more, each counted once."""
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    prints = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(marked: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        add = lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + 3 - F.greatest(a["end"] - i, F.lit(0))).alias("n"))
        return F.aggregate(F.sort_array(marked), zero, add, lambda a: a["n"])

    def of_sorted(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        return covered(F.transform(F.filter(s, same), lambda x: x["i"]))

    def of_prints(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(placed, of_sorted)).otherwise(0)

    return F.when(F.size(words) >= 3, let(prints, of_prints)).otherwise(0)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each whole text, computed in place without any shuffle (null: as empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"))
    words, lines = F.col("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    only = lambda chars: F.length(F.regexp_replace("text", f"[^{chars}]+", ""))
    counted = split.select(
        "doc_id", F.size(words).alias("n_words"), F.length(F.array_join(words, "")).alias("word_chars"),
        only(r"#*$%&|<>").alias("n_symbols"), let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct"))).alias("lines"),
        _repeated(words).alias("n_repeat_words"), F.size(F.array_distinct(words)).alias("n_distinct"), only("A-Z").alias("n_upper"),
    )
    stats = {"n_dup_lines": F.col("lines.all") - F.col("lines.distinct"), "n_lines": F.col("lines.all")}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper")
    return counted.select("doc_id", *[stats.get(c, F.col(c)).cast("long").alias(c) for c in names])


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    bin: int  # of the first value above the threshold
    threshold: float

    def column(self) -> Column:
        value = F.expr(RATIOS[self.ratio])
        return value > self.threshold if self.above else value <= self.threshold

    def on_bins(self) -> Column:
        return F.col(self.ratio) >= self.bin if self.above else F.col(self.ratio) < self.bin

    def __str__(self) -> str:
        return f"{self.ratio} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all_of(conditions: Rule, how: str) -> Column:
    return reduce(lambda a, b: a & b, (getattr(c, how)() for c in conditions), F.lit(True))


def _best_condition(cells: DataFrame, thresholds: dict[str, list[float]]) -> tuple[Condition, float, float, float] | None:
    """The condition with the largest gain (FOIL) over the growing rows of cells, with the bad and good it keeps."""
    stack = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(r).alias("bin")) for r in thresholds])).alias("c")
    rows = cells.where(~F.col("pruning")).select(stack, "bad", "good").groupBy("c.ratio", "c.bin").agg(F.sum("bad"), F.sum("good")).collect()
    best = None
    for ratio, cuts in thresholds.items():
        mine = {r[1]: (r[2], r[3]) for r in rows if r[0] == ratio}
        bad, good = (sum(v[k] for v in mine.values()) for k in (0, 1))
        if not bad:
            continue
        before, low = log2(bad / (bad + good)), [0, 0]
        for k, cut in enumerate(cuts):
            low = [a + b for a, b in zip(low, mine.get(k, (0, 0)), strict=True)]
            for above, (p, n) in ((False, low), (True, (bad - low[0], good - low[1]))):
                if p > 0 and p + n < bad + good:
                    gain = p * (log2(p / (p + n)) - before)
                    if best is None or gain > best[1] + 1e-9:
                        best = Condition(ratio, above, k + 1, cut), gain, p, n
    return best if best and best[1] > 1e-9 else None


def learn_rules(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Conjunctions that pick bad documents, in order.

    Each rule grows by the condition of the largest gain on two thirds of the labelled rows that no rule has covered,
    loses conditions at its end while its precision on the other third (by crc32 of the id) does not fall, and joins the
    list if it is precise enough there. Rows are reduced to counts by binned ratios first; the driver gets sums by ratio
    and bin only. An id's labels count by their mean; without any label of either kind there are no rules.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("is_bad"))
    ratios = stats.join(known, "doc_id").select("doc_id", "is_bad", *[F.expr(e).alias(r) for r, e in RATIOS.items()])
    ratios = materialize(ratios, "labelled-ratios")
    at = [0.005, 0.01, *(k / QUANTILES for k in range(1, QUANTILES)), 0.99, 0.995]
    found = ratios.agg(*[F.percentile_approx(r, at, 2000).alias(r) for r in RATIOS], F.count("*").alias("n")).first()
    if not found.n:
        return []
    thresholds = {r: sorted(set(found[r])) for r in RATIOS}
    passed = lambda r: lambda t: F.col(r) > t
    bins = [F.size(F.filter(F.array(*map(F.lit, cuts)), passed(r))).alias(r) for r, cuts in thresholds.items()]
    count = lambda c: F.sum(c.cast("long"))
    cells = ratios.select(*bins, "is_bad", (F.crc32(F.col("doc_id").cast("string")) % 3 == 0).alias("pruning"))
    cells = materialize(cells.groupBy(*RATIOS, "pruning").agg(count(F.col("is_bad")).alias("bad"), count(~F.col("is_bad")).alias("good")), "labelled-cells")

    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        left = reduce(lambda df, rule: df.where(~_all_of(rule, "on_bins")), rules, cells)
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            step = _best_condition(left.where(_all_of(rule, "on_bins")), thresholds)
            if step is None:
                break
            rule += (step[0],)
            if not step[3]:
                break
        if not rule:
            break
        sums = []
        for k in range(1, len(rule) + 1):
            hit = _all_of(rule[:k], "on_bins")
            sums += [F.coalesce(F.sum(F.when(hit & (F.col("pruning") | F.lit(not third)), F.col(c))), F.lit(0)) for third in (True, False) for c in ("bad", "good")]
        got = left.agg(*sums).first()
        precise = lambda bad, good: (bad + 1) / (bad + good + 2)
        size = len(rule)
        while size > 1 and precise(*got[4 * size - 8 : 4 * size - 6]) >= precise(*got[4 * size - 4 : 4 * size - 2]):
            size -= 1
        bad, good, all_bad, all_good = got[4 * size - 4 : 4 * size]
        if all_bad < MIN_ROWS or all_bad < MIN_PRECISION * (all_bad + all_good) or bad < MIN_PRECISION * (bad + good):
            break
        rules.append(rule[:size])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression over the statistics: false where the first rule that holds rejects."""
    if not rules:
        return F.lit(True)
    first, *rest = [_all_of(rule, "column") for rule in rules]
    return reduce(lambda case, rule: case.when(rule, False), rest, F.when(first, False)).otherwise(True)


def apply_rules(docs: DataFrame, labels: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """doc_id, statistics, base_failed and kept for every row of docs.

    base_failed: fewer than min_words words, or over max_repeat_percent % of the words in repeated 3-word windows. kept:
    not base_failed and not rejected by the rules learnt from labels (quality 1 or 0).
    A null text counts as empty and fails. Null ids and repeated rows are kept as rows of their own. An empty table
    gives no rows. Other columns are not read.
    """
    stats = materialize(with_statistics(docs), "statistics")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(learn_rules(stats, labels)))
