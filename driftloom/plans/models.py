"""Queries with models, folds and generators; most have no SQL twin and are tested against their definitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from driftloom.operators import boundary, classifiers, clusters, importance, local_affine, neural_projection, prototypes, reduce, shapley
from driftloom.operators import recurrence as rc
from driftloom.sources import generators as gen
from driftloom.sources.scratch import materialize
from driftloom.sources.tables import read, with_blocks

from .registry import query, rounded
from .streams import matrix, vectors
from .streams import prototypes as prototypes_of


def _items(spark, sf_dir):
    """Two standardised features of lineitem in two blocks, with a numeric label."""
    rows = with_blocks(read(spark, sf_dir, "lineitem"), F.col("l_shipdate") < F.lit("1998-05-24").cast("timestamp_ntz"))
    keep = rows.select(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"), "block", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    fit = keep.where("block = 'before'").agg(*[f(c).alias(f"{n}_{c}") for c in ("quantity", "discount") for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    return keep.crossJoin(F.broadcast(fit)).select("label", "block", *[((F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}")).alias(c) for c in ("quantity", "discount")])


FEATURES = ["quantity", "discount"]
SIGMA = """src AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, CASE WHEN l_shipdate < TIMESTAMP '1998-05-24' THEN 'before' ELSE 'after' END AS block, l_quantity AS quantity, l_discount AS discount FROM lineitem),
fit AS (SELECT avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(discount) AS md, stddev_pop(discount) AS sd FROM src WHERE block = 'before'),
std AS (SELECT label, block, (quantity - mq) / sq AS quantity, (discount - md) / sd AS discount FROM src CROSS JOIN fit),
cen AS (SELECT * FROM (VALUES (0, -1.0::DOUBLE, 0.0::DOUBLE), (1, 0.3::DOUBLE, 0.5::DOUBLE), (2, 1.2::DOUBLE, -0.7::DOUBLE)) t(cluster, cq, cd)),
near AS (SELECT label, block, quantity, discount, cluster, d FROM (SELECT s.*, cluster, sqrt((quantity - cq) ** 2 + (discount - cd) ** 2) AS d, row_number() OVER (PARTITION BY s.rid ORDER BY sqrt((quantity - cq) ** 2 + (discount - cd) ** 2), cluster) AS k FROM (SELECT *, row_number() OVER () AS rid FROM std) s CROSS JOIN cen) WHERE k = 1)"""


def _fixed(spark, sf_dir):
    """Rows assigned to three fixed centres."""
    rows = _items(spark, sf_dir)
    centers = [(k, list(c)) for k, c in enumerate(((-1.0, 0.0), (0.3, 0.5), (1.2, -0.7)))]
    few = spark.createDataFrame(centers, "cluster int, center array<double>")
    keyed = few.crossJoin(spark.createDataFrame([(i, b) for i in range(3) for b in ("before", "after")], "label int, block string"))
    return clusters.assign(rows, keyed, FEATURES)


@query(f"""WITH {SIGMA}, m AS (SELECT label, cluster, avg(quantity) FILTER (block = 'before') AS q0, avg(quantity) FILTER (block = 'after') AS q1, avg(discount) FILTER (block = 'before') AS d0, avg(discount) FILTER (block = 'after') AS d1 FROM near GROUP BY ALL)
SELECT label, cluster, CASE WHEN q1 IS NULL THEN 'disappeared' WHEN q0 IS NULL THEN 'appeared' ELSE 'matched' END AS status, round(sqrt((q1 - q0) ** 2 + (d1 - d0) ** 2), 6) AS distance, coalesce(sqrt((q1 - q0) ** 2 + (d1 - d0) ** 2) > 0.02, true) AS drift FROM m""")
def fixed_centroid_cluster_shift(spark, sf_dir):
    return rounded(clusters.centroid_shift(_fixed(spark, sf_dir), FEATURES, 0.02))


@query(f"""WITH {SIGMA}, m AS (SELECT label, cluster, avg(d) FILTER (block = 'before') AS before, avg(d) FILTER (block = 'after') AS after FROM near GROUP BY ALL)
SELECT label, cluster, round(before, 6) AS before, round(after, 6) AS after, round((after - before) / before, 6) AS shift, abs((after - before) / before) > 0.2 AS drift FROM m""")
def avg_distance_to_centroid(spark, sf_dir):
    return rounded(clusters.mean_distance_shift(_fixed(spark, sf_dir)))


@query(f"""WITH {SIGMA}, u AS (SELECT label, cluster, block, feature, value FROM (UNPIVOT near ON quantity, discount INTO NAME feature VALUE value)),
g AS (SELECT label, cluster, feature, block, median(value) AS median, avg(value) AS mean, stddev_samp(value) AS std FROM u GROUP BY ALL),
l AS (SELECT label, cluster, feature, stat, max(v) FILTER (block = 'before') AS before, max(v) FILTER (block = 'after') AS after FROM (UNPIVOT g ON median, mean, std INTO NAME stat VALUE v) GROUP BY ALL),
s AS (SELECT *, (after - before) / CASE WHEN abs(before) < 1e-10 THEN 1 ELSE abs(before) END AS shift FROM l)
SELECT label, cluster, feature, stat, round(before, 6) AS before, round(after, 6) AS after, round(shift, 5) AS shift, coalesce(abs(shift) > 0.2, true) AS drift FROM s""")
def cluster_stats_shift(spark, sf_dir):
    s = clusters.flag_stats(clusters.cluster_stats(_fixed(spark, sf_dir), FEATURES))
    return s.withColumns({"before": F.round("before", 6), "after": F.round("after", 6), "shift": F.round("shift", 5)})


@query()
def drift_strength(spark, sf_dir):
    return rounded(clusters.detect(_items(spark, sf_dir), FEATURES))


@query()
def xmeans_clusters(spark, sf_dir):
    centers = clusters.global_ids(clusters.fit_centers(_items(spark, sf_dir), FEATURES), 0.7)
    return centers.select("label", "block", "cluster", "status", F.transform("center", lambda x: F.round(x, 4)).alias("center"))


@query()
def hdbscan_windows(spark, sf_dir):
    return clusters.cluster_windows(matrix(spark, sf_dir))


def _vector_rows(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])


@query()
def apete_prototypes(spark, sf_dir):
    names = [f"x{i}" for i in range(64)]
    rows = _vector_rows(spark, sf_dir)
    leafed = prototypes.with_leaves(prototypes.fit_forest(rows, names), rows, names)
    return prototypes.select(leafed, "apete")


@query()
def prototype_quality(spark, sf_dir):
    names = [f"x{i}" for i in range(64)]
    rows = _vector_rows(spark, sf_dir)
    leafed = materialize(prototypes.with_leaves(prototypes.fit_forest(rows, names), rows, names), "leafed")
    chosen = prototypes.select(leafed, "kmedoids", 2).withColumnRenamed("row_id", "proto_id")
    protos = chosen.join(leafed.select(F.col("row_id").alias("proto_id"), "leaves"), "proto_id")
    return rounded(prototypes.group_metrics(prototypes.assign(leafed, protos)))


@query()
def kmeans_prototypes(spark, sf_dir):
    return prototypes.kmeans_prototypes(_vector_rows(spark, sf_dir), [f"x{i}" for i in range(64)])


def _two_class(spark, sf_dir):
    return _items(spark, sf_dir).withColumn("label", (F.col("label") == 1).cast("int"))


@query()
def permutation_importance(spark, sf_dir):
    found, _ = importance.drift_importance(_two_class(spark, sf_dir), FEATURES)
    return rounded(found, 4)


@query()
def shap_importance(spark, sf_dir):
    rows = _two_class(spark, sf_dir)
    return rounded(importance.shap_importance(importance.fit(rows, FEATURES), rows, FEATURES), 4)


#: A linear score of embeddings: weights -2, -1, 0, 1, 2 in turn.
LINEAR = "(k - 1) % 5 - 2"


@query(f"""WITH x AS (SELECT vec_id AS row_id, k, embedding[k]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k)), b AS (SELECT label, k, avg(embedding[k]::DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k) GROUP BY ALL),
m AS (SELECT k, avg(v) AS v FROM b GROUP BY 1), z AS (SELECT sum(({LINEAR}) * v) AS base FROM m)
SELECT row_id, (k - 1)::INT AS feature, round(base, 6) AS base, round(({LINEAR}) * (x.v - m.v), 6) + 0.0 AS phi FROM x JOIN m USING (k) CROSS JOIN z""")
def shap_linear_vectors(spark, sf_dir):
    """Shapley values of a linear score of all 64 dimensions, against the mean of each class; the twin has the closed form."""
    rows = vectors(spark, sf_dir)
    back = rows.groupBy("label").agg(F.array(*[F.avg(F.col("center")[i]) for i in range(64)]).alias("x"))
    found = shapley.kernel_shap_arrays(lambda x: x @ (np.arange(64) % 5 - 2.0), rows.select("row_id", F.col("center").alias("x")), back, 64, 128)
    long = rounded(found.select("row_id", F.posexplode("phi").alias("feature", "phi"), "base"))
    return long.withColumn("phi", F.col("phi") + 0.0)


@query()
def lime_importance(spark, sf_dir):
    rows = _two_class(spark, sf_dir)
    return rounded(importance.lime_importance(importance.fit(rows, FEATURES), rows, FEATURES), 4)


def _moved_boundary(spark, sf_dir):
    """Rows whose class follows quantity in the block before and discount in the block after."""
    return _items(spark, sf_dir).withColumn("label", F.when(F.col("block") == "before", F.col("quantity") > 0).otherwise(F.col("discount") > 0).cast("int"))


@query()
def boundary_rules(spark, sf_dir):
    rows = _moved_boundary(spark, sf_dir)
    models = [boundary.classifier(rows.where(F.col("block") == b), FEATURES, depth=4) for b in ("before", "after")]
    marked = boundary.disagreement_map(rows, FEATURES, *models)
    return rounded(boundary.drift_rules(marked, FEATURES)[0], 4)


@query(f"""WITH {SIGMA}, l AS (SELECT * REPLACE (CASE WHEN block = 'before' THEN quantity > 0 ELSE discount > 0 END AS label) FROM std)
SELECT block, count(*) AS rows, round(avg(((CASE WHEN block = 'before' THEN quantity > 0 ELSE discount > 0 END) = label)::INT), 6) AS accuracy FROM l GROUP BY 1""")
def stump_accuracy(spark, sf_dir):
    """A stump finds a boundary between two values of one feature exactly."""
    rows, out = _moved_boundary(spark, sf_dir), None
    for b in ("before", "after"):
        mine = rows.where(F.col("block") == b)
        part = classifiers.accuracy(classifiers.fit(mine, FEATURES, preset="stump"), mine).select(F.lit(b).alias("block"), "rows", "accuracy")
        out = part if out is None else out.unionAll(part)
    return rounded(out)


@query()
def adjusted_mutual_information(spark, sf_dir):
    assigned = rc.nearest_prototype(vectors(spark, sf_dir), prototypes_of(spark, sf_dir))
    return rounded(rc.adjusted_mutual_information(rc.contingency(assigned, "label", "proto_class")))


@query()
def principal_plane(spark, sf_dir):
    names = [f"x{i}" for i in range(64)]
    rows = _vector_rows(spark, sf_dir)
    return rounded(reduce.lda(rows, names, 2).transform(reduce.pca(rows, names).transform(rows, "pc"), "ld").select("row_id", "label", "pc1", "pc2", "ld1", "ld2"), 4)


@query()
def independent_axes(spark, sf_dir):
    """Scores of all embeddings on the four axes along which they are least normal."""
    names = [f"x{i}" for i in range(64)]
    rows = _vector_rows(spark, sf_dir)
    return rounded(reduce.ica(rows, names, 4, 30).transform(rows, "ic").select("row_id", "label", *[f"ic{i}" for i in range(1, 5)]), 3)


@query()
def factor_scores(spark, sf_dir):
    names = [f"x{i}" for i in range(64)]
    rows = _vector_rows(spark, sf_dir)
    return rounded(reduce.factor_analysis(rows, names, 3).scores.transform(rows, "f").select("row_id", "label", "f1", "f2", "f3"), 4)


@query()
def local_affine_plane(spark, sf_dir):
    """All embeddings in a plane, each by a fit of its own to control points."""
    names = [f"x{i}" for i in range(64)]
    rows = _vector_rows(spark, sf_dir)
    return rounded(local_affine.LocalAffine.fit(rows, names, 60).transform(rows).select("row_id", "label", "u", "v"), 4)


@query()
def neural_plane(spark, sf_dir):
    """All embeddings in a plane learnt with their labels."""
    names = [f"x{i}" for i in range(64)]
    rows = _vector_rows(spark, sf_dir)
    return rounded(neural_projection.NeuralPlane.fit(rows, names, epochs=10).transform(rows).select("row_id", "label", "u", "v"), 3)


@query()
def landmark_plane(spark, sf_dir):
    """All embeddings placed by their distances to a hundred of them."""
    rows = vectors(spark, sf_dir).select("row_id", "label", F.col("center").alias("x"))
    return rounded(reduce.landmark_scaling(rows, 2, 100).transform(rows).select("row_id", "label", "z1", "z2"), 4)


@query(f"WITH {SIGMA} SELECT round(avg(((quantity > 0) <> (discount > 0))::INT), 6) AS rate FROM std WHERE block = 'after'")
def disagreement_rate(spark, sf_dir):
    """Stumps of both blocks find quantity > 0 and discount > 0, which the twin compares."""
    rows = _items(spark, sf_dir)
    labelled = lambda f: rows.withColumn("label", (F.col(f) > 0).cast("int"))
    models = [classifiers.fit(labelled(f), FEATURES, preset="stump") for f in ("quantity", "discount")]
    return rounded(boundary.disagreement_rate(rows.where("block = 'after'"), FEATURES, *models))


def _events_in_blocks(spark, sf_dir) -> tuple[int, int]:
    """Events before and from 2024-01-15 on: generated streams are as long as the stream that they stand beside."""
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    return tuple(read(spark, sf_dir, "events").agg(F.count(F.when(early, 1)), F.count(F.when(~early, 1))).first())


@query()
def sea_stream(spark, sf_dir):
    """A generated stream whose concept moves where the events' second block begins."""
    before, after = _events_in_blocks(spark, sf_dir)
    return gen.sea(spark, before, after, 200)


@query()
def multi_window_stream(spark, sf_dir):
    """Windows of a generated stream, as many as the events fill, with drifts after a third and two thirds of them."""
    n = max(3, sum(_events_in_blocks(spark, sf_dir)) // 500)
    return gen.multi_window(spark, "rbf", n, 500, f"{n // 3 * 500},{2 * n // 3 * 500}", 200)


@query()
def generated_stream_drift(spark, sf_dir):
    """Distances between the windows of a generated stream as long as the events, whose concepts are known."""
    n = max(4, sum(_events_in_blocks(spark, sf_dir)) // 500)
    rows = gen.multi_window(spark, "sea", n, 500, f"{n // 2 * 500}", 1).withColumn("win", F.floor(F.col("seq") / 500).cast("int")).withColumn("label", F.col("target"))
    return rounded(rc.window_distances(rc.class_means(rows, ["x0", "x1", "x2"])))
