"""The pipeline, stage by stage, against plain versions of what each stage must keep."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engramma.llm import language_id, mixing, near_dedup

SF = "/root/testdata/sf0.001"
CLASHES = ("_row", "_copies", "_copy", "_id", "_text", "lang_pred", "lang_score", "lang_rejected", "kept", "_mixed_id", "_node", "_metadata")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(before, after) of each stage, for a table with repeated rows, repeated and null ids, null and blank texts, and clashing columns."""
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    again = plain.where("doc_id % 5 = 0")
    no_id = plain.where("doc_id % 7 = 0").withColumn("doc_id", F.lit(None).cast("long"))
    other_id = plain.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") - F.col("doc_id") % 2 + 1)
    edited = plain.where("doc_id % 9 = 0").withColumn("text", F.concat(F.lit("Zusatz "), "text"))
    none = plain.where("doc_id < 6").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit(" \t")))
    docs = plain.unionByName(again).unionByName(again).unionByName(no_id).unionByName(other_id).unionByName(edited).unionByName(none)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(c))
    folder, out = tmp_path_factory.mktemp("pipeline"), {}
    docs.repartition(3).write.parquet(f"{folder}/start")
    docs = spark.read.parquet(f"{folder}/start")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_all_columns_pass_through(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.schema == before.schema and not rows(after) - rows(before) or name == "mixing"
            assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}


def test_language_stage(stages):
    before, after = stages["language_id"]
    model, letter = language_id.fit_language_model(before), language_id.letter_table()

    def stays(text):
        if text is None or not any(map(str.isalpha, text)):
            return False
        return model.predict(language_id.subword_counts(text, letter))[1] >= model.reject_below

    assert rows(after) == Counter({r: n for r, n in rows(before).items() if stays(r[before.columns.index("text")])})


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SF)
    assert after.count() >= 0.98 * docs.where("text rlike '[A-Za-z]'").count()


def test_exact_stage(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for r in before.collect():
        key = norm(r["text"])
        best[key] = min(best.get(key, (1, 0, 0)), (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
    got = [(norm(r["text"]), (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)) for r in after.collect()]
    assert sorted(got) == sorted(best.items()) and len(got) < before.count()


def distance(a, b):
    """Edit distance of two word lists, by the whole table, a row at a time."""
    codes = {w: i for i, w in enumerate({*a, *b})}
    b = np.array([codes[w] for w in b], int)
    steps = np.arange(len(b) + 1)
    row = steps
    for i, w in enumerate(a, 1):
        new = np.r_[i, np.minimum(row[1:] + 1, row[:-1] + (b != codes[w]))]
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def test_near_stage(stages):
    before, after = stages["near_dedup"]
    all_rows = before.select("doc_id", "text").collect()
    words = [re.findall(r"\w+", (r["text"] or "").lower()) for r in all_rows]
    sets = []
    for w in words:
        n, out = Counter(), set()
        for j in range(max(1, len(w) - 4) if w else 0):
            k = tuple(w[j : j + 5])
            out.add((k, n[k]))
            n[k] += 1
        sets.append(out)
    parent = list(range(len(words)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(words)):
        for j in range(i):
            same = all_rows[i]["text"] == all_rows[j]["text"] if not sets[i] and not sets[j] else words[i] == words[j]
            if not same and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                same = bool(words[i]) and distance(words[i], words[j]) <= 0.2 * max(len(words[i]), len(words[j]))
            if same and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, r in enumerate(all_rows):
        groups.setdefault(root(i), []).append((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after.collect())
    assert got == sorted(min(g)[:2] for g in groups.values()) and len(got) < len(all_rows)
    assert after.count() == near_dedup.near_dedup(before).where("kept").count()


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    con = duckdb.connect()
    con.register("documents", before.select("doc_id", "text", "source").toPandas())
    want = Counter()
    for doc_id, size, _, _, taken in con.sql(mixing.OP3_SQL).fetchall():
        want[doc_id, size] += taken
    got = Counter()
    for r in after.collect():
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        got[r["doc_id"], size] += size
    ids = [r["doc_id"] for r in before.select("doc_id").collect() if r["doc_id"] is not None]
    unique = {i for i, n in Counter(ids).items() if n == 1}
    assert {k: v for k, v in (+got).items() if k[0] in unique} == {k: v for k, v in want.items() if v and k[0] in unique}
    assert sum(got.values()) == sum(want.values())


def test_packing_stage(stages):
    before, after = stages["packing"]
    assert after.where("start = 0").count() == before.count()
    pieces, firsts, sequences = after.collect(), Counter(), {}
    for r in pieces:
        firsts[r["doc_id"]] += r["start"] == 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert firsts == Counter(r["doc_id"] for r in before.select("doc_id").collect())
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    total, by_doc = sum(r["length"] for r in pieces), {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], Counter())[r["start"]] += r["length"]
    assert total == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)


def test_stages_on_empty_tables(spark, stages, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        none = stages[name][0].limit(0)
        none.write.parquet(f"{tmp_path}/{name}")
        out = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), SF)
        assert out.count() == 0 and (name == "packing" or out.schema == none.schema)


def test_five_rows_with_repeated_ids(spark, tmp_path):
    frame = spark.createDataFrame([(3, "bbb"), (7, "aaa"), (7, "bbb"), (9, "ccc"), (9, "ccc")], "doc_id long, text string").repartition(3)
    frame.write.parquet(f"{tmp_path}/five")
    for docs in (frame, spark.read.parquet(f"{tmp_path}/five")):
        for name in ("exact_dedup", "near_dedup"):
            got = dict(corpus_pipeline.STAGES)[name](spark, docs, SF).collect()
            assert sorted(map(tuple, got)) == [(3, "bbb"), (7, "aaa"), (9, "ccc")]


def test_a_corpus_without_labels_keeps_its_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    out = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SF)
    assert out.count() == docs.where("text rlike '[\\\\p{L}]'").count()
