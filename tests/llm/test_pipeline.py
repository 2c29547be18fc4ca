import os
from collections import Counter

import corpus_pipeline as pipeline

from tidelog.llm import common, queries
from tidelog.llm.near_dedup import near_duplicates

from .helpers import docs, words


def corpus(spark, tmp_path):
    rows, labels = [], []
    for i in range(300):
        w = words(60, i, 3000)
        if i % 9 == 0:
            w[3:3] = ["worthless", "idiot"]
        if i % 10 == 1:
            w[7:7] = [f"user{i}@mail.example.com"]
        rows.append((i, " ".join(w), f"src{i % 4}"))
        labels.append((i, 1, int(i % 9 == 0)))
    rows += [(300 + i, rows[i * 3 + 1][1], "src0") for i in range(20)]  # exact copies
    rows += [(400, None, "src1"), (401, "", "src2"), (401, "", "src2"), (None, "row without id", None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "near duplicates", "personal data", "mixing", "packing"]
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = d.columns

    def step(name):
        nonlocal d
        before = d
        stages[name](spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        d = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        return before

    step("toxicity")
    left = {r.doc_id for r in d.collect()}
    toxic = {i for i in range(300) if i % 9 == 0} | {300 + i for i in range(20) if (i * 3 + 1) % 9 == 0}
    assert len(left & toxic) <= 2 and len({i for i, *_ in rows} - toxic - left) == 0 and d.columns == columns
    before = step("near duplicates")
    classes = {r.class_id for r in near_duplicates(before).collect() if r.class_id is not None}
    assert Counter(r.doc_id for r in d.collect()) == Counter([*classes, None]) and d.columns == columns
    before = step("personal data")
    assert d.count() == before.count() and d.where("text like '%@mail.example.com%'").count() == 0 and d.where("text like '%[EMAIL]%'").count() > 20
    before = step("mixing")
    assert d.columns == columns and max(Counter(r.doc_id for r in d.collect()).values()) <= 3
    assert set(r.text for r in d.collect()) <= set(r.text for r in before.collect())
    before = step("packing")
    assert Counter(r.doc_id for r in d.where("piece = 0").collect()) == Counter(r.doc_id for r in before.collect())


def test_texts_that_share_a_doc_id_stay(spark, tmp_path):
    rows = [(1, " ".join(words(60, 1))), (1, " ".join(words(60, 2))), (1, " ".join(words(60, 2))), (2, " ".join(words(60, 3))), (2, None), (2, None), (3, " ".join(words(60, 3)))]
    kept = pipeline.drop_near_copies(spark, docs(spark, rows), str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(set(rows[:6]))


def test_pipeline_of_nothing(spark, tmp_path):
    corpus(spark, tmp_path / "full")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/full/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_scratch_tables_hold_nothing_but_rows(spark, tmp_path):
    rows = spark.range(7).repartition(3)
    for df in (rows, rows.limit(0), spark.createDataFrame([], "id long")):
        t = common.stored(df, "t")
        assert Counter(t.collect()) == Counter(df.collect())
        folder = common._held[spark.sparkContext.applicationId][-1].removeprefix("file:")
        # a marker, and the folders that the writer would make, are a process of the driver each
        assert {x for x in os.listdir(folder) if not x.endswith((".parquet", ".crc"))} == set()
    common.made(spark, f"file:{tmp_path}/new")
    assert os.path.isdir(tmp_path / "new" / "_temporary" / "0")


def test_registry():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
