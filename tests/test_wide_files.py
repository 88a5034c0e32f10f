"""Files with more columns than usual, and scores closer than usual."""

from terrace.operators import models
from terrace.sources import headed_csv


def test_a_quoted_line_keeps_all_its_cells(spark, tmp_path):
    names = [f"n{i}" for i in range(232)]
    lines = [",".join(names), ",".join(f"{i}" for i in range(232)), ",".join(['"a,b"', *[f"{i}" for i in range(1, 232)]])]
    (tmp_path / "wide.csv").write_text("\n".join(lines) + "\n")
    got = [r.row for r in headed_csv.headed_rows(headed_csv.read_lines(spark, str(tmp_path / "wide.csv")), "^n0,").collect()]
    assert sorted(r["n0"] for r in got) == ["0", "a,b"]
    assert all(r[f"n{i}"] == str(i) for r in got for i in range(1, 232))


def test_scores_that_differ_in_the_fifth_place_are_fitted_apart(spark):
    rows = [(0.30001, 0.3, 0.39999, 0), (0.30002, 0.3, 0.39998, 1)] * 5
    scored = spark.createDataFrame([(*r[:3], models.metrics.CLASSES[0] if r[3] else models.metrics.CLASSES[1]) for r in rows], [*models.PROBS, "y"])
    first = models.fit_isotonic(scored).models[0]
    assert sorted(first.boundaries) == [0.30001, 0.30002] and sorted(first.predictions) == [0.0, 1.0]
