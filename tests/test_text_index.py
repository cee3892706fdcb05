"""The trigram index against a plain scan."""

import pytest
from pyspark.sql import functions as F

from promptledger.operators import text_index
from promptledger.plans import queries
from promptledger.sources import fixtures, storage

ROWS = 6_000


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    word = F.element_at(F.array(*map(F.lit, ("Fix", "add", "Größe", "naïve", "日本語", "😀 ok"))), (F.col("id") % 6 + 1).cast("int"))
    text = F.when(F.col("id") % 500 == 499, None).when(F.col("id") % 500 == 498, "").when(F.col("id") == 77, "Quartz\nlamp % _ .*").otherwise(F.concat(word, F.lit(" the Task "), F.col("id") % 1000))
    rows = spark.range(ROWS).withColumn("text", text)
    rows = rows.union(rows.where("id = 77"))  # a repeated row
    text_index.write_index(rows, path)
    return rows.toPandas(), path


def rows_read(found):
    """Rows that the scan gives out, by its metric."""
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("pattern", ["quartz", "Z\nLAMP", "% _ .*", "task 997", "the task", "größe THE", "日本語", "😀 o", "ok", "k", "", "no such", "quartz task"])
def test_equals_a_scan(spark, indexed, pattern):
    frame, path = indexed
    want = sorted(frame[frame.text.map(lambda t: t is not None and pattern.lower() in t.lower())].id)
    assert sorted(r.id for r in text_index.containing(spark, path, pattern).collect()) == want


def test_rows_read_fall_with_selectivity(spark, indexed):
    _, path = indexed
    rare, some, all_ = (rows_read(text_index.containing(spark, path, p)) for p in ("quartz", "task 997", "k"))
    assert rare < ROWS / 50 and rare < some < ROWS / 10 and all_ == ROWS + 1


def test_empty_table_and_clashing_names(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string, gram string, bucket int")
    text_index.write_index(none, str(tmp_path / "none"))
    for pattern in ("abc", "a"):
        assert text_index.containing(spark, str(tmp_path / "none"), pattern).collect() == []
    clash = spark.createDataFrame([(1, "The quartz", "g", 5)], none.schema)
    text_index.write_index(clash, str(tmp_path / "one"))
    assert [tuple(r) for r in text_index.containing(spark, str(tmp_path / "one"), "QUARTZ").collect()] == [(1, "The quartz", "g", 5)]
    with pytest.raises(ValueError):
        text_index.write_index(clash.withColumn("INDEX_ROW", F.lit(1)), str(tmp_path / "two"))


@pytest.mark.parametrize("pattern", ["TASK 1", "unavailable", "no such"])
def test_searched_before_the_wide_rows(spark, small, monkeypatch, pattern):
    """Rows as of a scan of all wide rows, those of unknown prompts too; no request of another prompt is priced for a search that the index answers."""
    text = F.lower("text").contains(pattern.lower())
    want = sorted(map(tuple, fixtures.ledger(spark, small, stored=True).usage().where(text).collect()))
    priced, plain = [], storage.written

    def told(rows, name):
        out = plain(rows, name)
        if name == "costed":
            priced.extend(r.target for r in out.select("target").distinct().collect())
        return out

    monkeypatch.setattr(storage, "written", told)
    found = queries._searched(fixtures.ledger(spark, small, stored=("prompts", "sessions")), pattern)
    assert sorted(map(tuple, found.usage().where(text).collect())) == want
    assert bool(want) == (pattern != "no such")
    assert pattern == "unavailable" or set(priced) <= {r[0] for r in want}
