"""Entropies, row constraints, budgets, recipes, ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, differences
from weftline.operators import budget, constraints, information
from weftline.operators import components as K
from weftline.operators import queries as Q
from weftline.operators.sampler import enforce_rows
from weftline.operators.suffstats import scorers
from weftline.plans import queries as P
from weftline.plans import recipe
from weftline.plans.fixtures import orders_model
from weftline.sources import files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["anomaly_ranks", "top_dependence"])
def test_oracle(spark, name):
    assert differences(P.QUERIES[name](spark, SF), connect(SF), P.SQL[name]) is None


def test_conditional_entropy(spark):
    model = orders_model(spark, SF)
    exact = Q.conditional_entropy_discrete(model, 2, 3).first().entropy
    assert abs(information.conditional_entropy(model, 2, [3], 3000, 1).first().entropy - exact) < 0.05
    # A continuous target given a categorical column, integrated on a grid.
    sc, weights = scorers(model).toPandas(), Q.cluster_weights(model).toPandas()
    want = []
    for ch in model.chains:
        own = sc[(sc.chain == ch) & (sc.view_id == model.views[ch, 0])].merge(weights, on=["chain", "view_id", "cluster_id"]).sort_values("cluster_id")
        t, g = own[own.col_id == 0], own[own.col_id == 2]
        x = np.linspace(-2e6, 2.5e6, 200_001)
        p = np.stack([np.exp(r.p3 - (r.p0 + 1) / 2 * np.log1p((x - r.p1) ** 2 / (r.p0 * r.p2))) for r in t.itertuples()])
        w, levels = np.exp(t.lw.to_numpy()), np.exp(np.stack(g["levels"].to_numpy()))
        h = 0.0
        for k in range(levels.shape[1]):
            joint = (w * levels[:, k]) @ p
            h -= np.trapezoid(joint * np.log(joint / (w @ levels[:, k])), x)
        want.append(h)
    assert abs(information.conditional_entropy(model, 0, [2], 3000, 2).first().entropy - np.mean(want)) < 0.06
    with pytest.raises(ValueError):
        information.conditional_entropy(model, 0, [0])


def test_row_constraints(spark):
    model = orders_model(spark, SF)
    one = spark.createDataFrame([(1, 1, True)], "row_a long, row_b long, dependent boolean")
    assert enforce_rows(model, one)[1] == 0
    with pytest.raises(ValueError):
        enforce_rows(model, one.withColumn("dependent", F.lit(False)), attempts=0)


def test_budget(spark):
    model = orders_model(spark, SF)
    assert budget.check_budget(model, 2, 6) == []
    with pytest.warns(UserWarning):
        over = budget.check_budget(model, 1, 5)
    assert {(o["what"], o["chain"]) for o in over} == {("views", 0), ("views", 1), ("views", 3), ("clusters", 2)}
    with pytest.raises(budget.Overflow):
        budget.check_budget(model, 1, policy="raise")
    with pytest.raises(ValueError):
        budget.check_budget(model, policy="odd")
    size = budget.estimate_memory(model)
    assert size["cells"] == model.rows.count() * 48 and size["total"] == sum(v for k, v in size.items() if k != "total")


def test_recipe(spark, tmp_path):
    out = str(tmp_path / "out")
    config = {"source": {"path": f"{SF}/customer.parquet", "columns": ["c_custkey", "c_acctbal"]}, "required": ["c_acctbal"], "min_rows": 5, "filter": "c_acctbal > 0", "derive": {"half": "c_acctbal / 2"}, "types": {"half": K.CONTINUOUS}, "output": out}
    df, made = recipe.run(spark, config)
    again, twice = recipe.run(spark, dict(reversed(config.items())))
    rows = df.count()
    assert made and not twice and df.columns == ["c_custkey", "c_acctbal", "half"] and again.count() == rows > 0
    assert files.load_data(spark, f"{out}/data")[1][0].name == "half" and recipe.run(spark, config | {"min_rows": 6})[1]
    for bad in ({"min_rows": 10**9}, {"required": ["zz"]}, {"odd": 1}, {"source": {"path": "x", "format": "odd"}}):
        with pytest.raises(ValueError):
            recipe.run(spark, config | bad)
    assert recipe.recorded(spark, out)["rows"] == rows


def test_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3,NA\n")
    values, _ = files.read_csv_chunked(spark, str(tmp_path / "a.csv"), 1)
    with pytest.raises(ValueError):
        files.read_csv_chunked(spark, "x", 0)
    with pytest.warns(DeprecationWarning):
        path = files.save_npz(values, str(tmp_path / "y"))
    with pytest.warns(DeprecationWarning):
        assert sorted(map(str, files.load_npz_mmap(spark, path).collect())) == sorted(map(str, values.collect()))
