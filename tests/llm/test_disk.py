"""What an operator leaves on disk while it runs."""

from __future__ import annotations

import random
import time

import pytest

from scorebook.llm import lm
from tests.llm.test_operators import docs, rows  # noqa: F401


def shuffles(spark) -> set[str]:
    """Numbers of the shuffles whose files are there."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name.split("_")[1] for path in files.split("\n") if (name := path.rsplit("/", 1)[-1]).startswith("shuffle_")}


def test_shuffles_are_gone_when_their_table_is_written(spark, docs, monkeypatch):  # noqa: F811
    made, left, write = set(), {}, lm.materialise

    def watched(df, name):
        until = time.time() + 3
        while made & shuffles(spark) and time.time() < until:
            time.sleep(0.1)
        left[name] = made & shuffles(spark)
        before = shuffles(spark)
        out = write(df, name)
        made.update(shuffles(spark) - before if name != "lm-chunks" else ())
        return out

    monkeypatch.setattr(lm, "materialise", watched)
    assert lm.score(docs).count() == docs.count()
    assert len(made) > 2 and left == dict.fromkeys(left, set())


def nodes(plan):
    """The nodes of a plan that was run, below the stages of an adaptive one too."""
    yield plan
    name, below = plan.nodeName(), plan.children()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else [below.apply(i) for i in range(below.size())]
    for p in inner:
        yield from nodes(p)


def test_failure_arcs_outside_the_head_are_no_rows(spark):
    """They are packed by batch of rows and block; a join made a row of each."""
    r = random.Random(4)
    texts = [" ".join(f"w{r.randint(0, 14)}" for _ in range(300)) for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cold = lm.score(docs, hot=0)
    got = {x["doc_id"]: x["score"] for x in cold.collect()}
    assert got == pytest.approx({x["doc_id"]: x["score"] for x in lm.score(docs).collect()})
    ran = list(nodes(cold._jdf.queryExecution().executedPlan()))
    made = {p.nodeName(): p.metrics().apply("numOutputRows").value() for p in ran if p.metrics().contains("numOutputRows") and any(w in p.nodeName() for w in ("Join", "Generate", "InArrow"))}
    assert "FlatMapCoGroupsInArrow" in {p.nodeName() for p in ran} and max(made.values()) <= 8 * 4
