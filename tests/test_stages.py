"""Stage tables: shuffle files of a write and dropped tables leave the disk."""

from pathlib import Path

from pyspark.sql import functions as F

from sessionrec.sources import stages


def test_write_frees_its_shuffle_and_restores_the_setting(spark):
    before = spark.conf.get(stages._FREE_SHUFFLES, "false")
    held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        files = held.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    there = shuffles()
    grouped = spark.range(50_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.collect_list("id").alias("ids"))
    table = stages.materialize(grouped, "freed")
    assert not shuffles() - there
    assert spark.conf.get(stages._FREE_SHUFFLES, "false") == before
    # The same DataFrame can be run again, outside a write as well.
    assert grouped.count() == table.count() == 1000


def test_failed_write_restores_the_setting(spark):
    before = spark.conf.get(stages._FREE_SHUFFLES, "false")
    bad = spark.range(1).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    try:
        stages.materialize(bad, "failed")
        raise AssertionError("the write passed")
    except Exception as error:
        assert "stop" in str(error)
    assert spark.conf.get(stages._FREE_SHUFFLES, "false") == before


def test_scratch_drops_one_table(spark):
    scratch = stages.Scratch(spark, "scratch")
    first = scratch.table(spark.range(10), "first")
    second = scratch.table(first.filter("id > 3"), "second")
    scratch.drop("first", "never-written")
    folder = Path(scratch.folder.removeprefix("file:"))
    assert [p.name for p in folder.iterdir() if not p.name.endswith(".crc")] == ["second"]
    assert second.count() == 6


def test_tables_made_on_the_way_go_and_the_result_stays(spark):
    import os

    from pyspark.sql import functions as F

    from sessionrec.sources import stages as st

    folder = f"{st.shared_dir(spark)}/sessionrec"
    outer = st.materialize(spark.range(3), "outer")
    before = set(os.listdir(folder))

    def build():
        first = st.materialize(spark.range(10), "first")
        inner = st.materialize_alone(spark, "inner", lambda: st.materialize(first, "deep").filter("id > 2"))
        table = st.Scratch(spark, "scratch").table(inner.withColumn("x", F.lit(1)), "t")
        return table.join(outer, "id", "left_anti").select("id")

    found = st.materialize_alone(spark, "result", build)
    assert sorted(r.id for r in found.collect()) == list(range(3, 10))
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("result-") and outer.count() == 3
    try:
        st.materialize_alone(spark, "failed", lambda: st.materialize(spark.range(2), "gone").select("no_column"))
    except Exception as error:
        assert "no_column" in str(error)
    assert set(os.listdir(folder)) - before and not [t for t in os.listdir(folder) if t.startswith("gone-")]
