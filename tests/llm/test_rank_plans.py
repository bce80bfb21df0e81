"""How much of the ranks' rounds one plan holds."""

from __future__ import annotations

from shelfscope.llm import scratch, urlgraph


def test_a_round_of_ranks_is_a_plan_of_its_own(spark, monkeypatch):
    joins, save = [], scratch.save

    def seen(df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return save(df, name)

    monkeypatch.setattr(scratch, "save", seen)
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0)], "host string, seed double")
    ranks = {r.host: r["rank"] for r in urlgraph.page_rank(edges, seeds, tolerance=1e-9).collect()}
    assert max(joins) == 1
    assert abs(ranks["b"] - 0.85 * ranks["a"]) < 1e-6 and abs(sum(ranks.values()) - 1) < 1e-6
