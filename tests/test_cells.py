import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import retrieval
from docquarry.operators.cells import SAMPLE, _sampled, build_cells, read_cells, recall, search_cells, with_cells
from docquarry.plans import standins
from docquarry.plans.registry import CELLS, PROBES
from docquarry.session import shared_path


def vectors(spark, rows, name="p"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], f"{name} long, vector array<float>")


def clustered(n, places, dims, seed, noise=0.25):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(places, dims))
    return [middles[i % places] + noise * rng.normal(size=dims) for i in range(n)]


def hits(df):
    return sorted((r.q, r["rank"], r.p, r.score) for r in df.collect())


def test_every_row_is_in_one_cell_and_that_of_its_nearest_centroid(spark):
    rows = [*clustered(300, 7, 6, 1), None, np.zeros(6), None]
    index = build_cells(vectors(spark, rows), shared_path(spark, "cells"), 7, ["p"])
    found = {r.p: r.cell for r in index.vectors.collect()}
    centroids = np.array(index.centroids)
    assert sorted(found) == list(range(303)) and len(index.vectors.collect()) == 303
    for i, v in enumerate(rows):
        assert found[i] == (-1 if v is None else int(np.argmax(np.round(centroids @ (v.astype(np.float32) / (np.linalg.norm(v) or 1)), 6))))
    again = read_cells(spark, shared_path(spark, "x").rsplit("/", 1)[0] + "/" + index.vectors.inputFiles()[0].split("/docquarry/")[1].split("/")[0])
    assert again.centroids == index.centroids


@pytest.mark.parametrize("block", [None, 20])
def test_recall_grows_with_the_cells_asked_up_to_all(spark, block):
    rows, asked = clustered(400, 12, 16, 2, 0.9), clustered(60, 12, 16, 3, 0.9)
    index = build_cells(vectors(spark, rows), shared_path(spark, "cells"), 12, ["p"])
    questions = vectors(spark, [*asked, None], "q")
    exact = retrieval.semantic_top_k(questions, vectors(spark, rows), 5, "q", ["p"])
    found = {n: search_cells(questions, index, 5, n, "q", ["p"], block) for n in (1, 4, 12, 99)}
    shares = [recall(found[n], exact, "q", ["p"]).first()["recall"] for n in (1, 4, 12)]
    assert shares[0] < shares[1] < shares[2] == 1.0
    assert hits(found[12]) == hits(found[99]) == hits(exact)


def test_given_vectors(spark, sf):
    """The recall that the README states."""
    given = standins.vectors(spark, sf)
    index = build_cells(given, shared_path(spark, "cells"), CELLS, ["vec_id"])
    asked = given.withColumnRenamed("vec_id", "question_id")
    exact = retrieval.semantic_top_k(asked, given, 5, keys=["vec_id"])
    assert recall(search_cells(asked, index, 5, PROBES, keys=["vec_id"]), exact, "question_id", ["vec_id"]).first()["recall"] >= 0.9


def test_only_asked_partitions_are_read(spark):
    index = build_cells(vectors(spark, clustered(300, 10, 5, 4)), shared_path(spark, "cells"), 10, ["p"])
    one = vectors(spark, clustered(1, 10, 5, 5), "q")
    found = search_cells(one, index, 3, 2, "q", ["p"])
    found.collect()
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in text or "PartitionFilters: [cell" in text
    wanted = with_cells(one, index.centroids, 2).first()["cells"]
    read = index.vectors.where(F.col("cell").isin(wanted))
    assert len(wanted) == 2 and 0 < read.count() < index.vectors.count() / 2


def test_a_cell_with_a_third_of_all_rows(spark):
    rows = [[1, 0, 0, 0] if i % 3 == 0 else list(v) for i, v in enumerate(clustered(300, 9, 4, 6, 0.5))]
    index = build_cells(vectors(spark, rows), shared_path(spark, "cells"), 9, ["p"])
    questions = vectors(spark, [[1, 0, 0, 0], *rows[1:3]], "q")
    exact = retrieval.semantic_top_k(questions, vectors(spark, rows), 4, "q", ["p"])
    assert hits(search_cells(questions, index, 4, len(index.centroids), "q", ["p"])) == hits(exact)
    assert [h[2] for h in hits(search_cells(questions, index, 4, 1, "q", ["p"])) if h[0] == 0] == [0, 3, 6, 9]


def test_few_rows_and_none(spark):
    for rows in ([], [None], [[0, 0]], [[1, 2]], [[1, 2], [1, 2], [2, 1]]):
        given = vectors(spark, rows)
        index = build_cells(given, shared_path(spark, "cells"), 4, ["p"])
        asked = vectors(spark, [[1, 2], None], "q")
        found = search_cells(asked, index, 2, 3, "q", ["p"])
        assert hits(found) == hits(retrieval.semantic_top_k(asked, given, 2, "q", ["p"]))
        assert recall(found, found, "q", ["p"]).first()["recall"] == 1.0


def test_the_sample_is_bounded_and_the_same_however_split(spark):
    rows = spark.range(20_000).select(F.col("id").alias("p"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    some = [_sampled(rows.repartition(n), ["p"], 500).collect() for n in (1, 7)]
    assert len(some[0]) == 500 and [r["at"] for r in some[0]] == [r["at"] for r in some[1]] and SAMPLE <= 100_000


def test_no_questions_through_the_driver(spark, monkeypatch):
    """More asked cells than a block holds: found in the tasks, exact when all cells are asked."""
    monkeypatch.setattr(retrieval, "_against_matrix", lambda *_: pytest.fail("a matrix of questions was sent"))
    rng = np.random.default_rng(11)
    given = vectors(spark, rng.normal(size=(60, 4)))
    index = build_cells(given, shared_path(spark, "cells"), 4, ["p"])
    asked = given.withColumnRenamed("p", "question_id")
    found = search_cells(asked, index, 3, 4, keys=["p"], block_questions=10)
    exact = sorted(map(tuple, found.collect()))
    monkeypatch.undo()
    assert exact == sorted(map(tuple, retrieval.semantic_top_k(asked, given, 3, keys=["p"]).collect()))
