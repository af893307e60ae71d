"""Columns of the documents that bear the names the operators use inside come out as they came; nothing is left behind."""

import os
import subprocess
import sys
import time

from tessera.llm import mixture, phrase_dedup, shard_store, simhash_dedup

TAKEN = ("_doc", "_text", "_node", "node", "doc", "row", "digest", "into", "into_0", "root", "first", "folder", "version", "fp", "_s", "mix")


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for name in TAKEN:
        df = df.selectExpr("*", f"concat('{name} of ', doc_id) AS `{name}`")
    return df.repartition(2)


def rows(n=40):
    return [(i, " ".join(f"w{(i * 7 + k * k) % 500}" for k in range(60)), f"s{i % 3}", "en") for i in range(n)]


def kept_as_it_was(df, missing=()):
    for r in df.collect():
        for name in set(TAKEN) - set(missing):
            assert r[name] == f"{name} of {r.doc_id}"


def test_documents_keep_their_columns(spark, tmp_path):
    docs = documents(spark, rows())
    for made in (simhash_dedup.keep_one(docs), simhash_dedup.keep_distinct(docs), phrase_dedup.without_phrases(docs)):
        assert made.columns == docs.columns
        kept_as_it_was(made)
    kept_as_it_was(mixture.mix_sources(docs), ["mix"])
    store = str(tmp_path / "store")
    shard_store.append(docs, store, arrival=5)
    shard_store.compact(spark, store, docs, target=1 << 20)
    assert shard_store.read(spark, store, docs).count() == 40
    kept_as_it_was(shard_store.read(spark, store, docs))


def test_nothing_stays_in_the_shared_folder(tmp_path):
    """Of an application that ends."""
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from tessera.llm import common, shard_store
docs = spark.createDataFrame([(i, "a b c") for i in range(20)], "doc_id long, text string")
assert common.checkpointed(docs).count() == common.stored(docs).count() == shard_store.sharded(docs).count() == 20
import os
assert os.listdir({str(tmp_path)!r})
spark.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=240, capture_output=True)
    until = time.time() + 30  # the JVM ends after Python
    while os.listdir(tmp_path) and time.time() < until:
        time.sleep(0.5)
    assert os.listdir(tmp_path) == []
