import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm.queries import QUERIES
from tests.llm.data import prose


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "secret_scan", "mixing", "byte_bpe"]


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark, tmp_path):
    r = random.Random(1)
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        words = prose(60, i).split()
        text = " ".join(w + ("ß" if lang == "de" else "") for w in words)
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    copy = rows[7]
    rows += [(500, *copy[1:]), (501, *copy[1:]), (502, None, "en", "s1", 0), (503, "12345 !!", "en", "s1", 8), (504, rows[9][1] + " password=b7db7aa4a5fcc78305", "en", "s0", 1), copy]
    r.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: sorted(x.doc_id for x in seen[name])
    assert {502, 503}.isdisjoint(ids("language_id")) and len(seen["language_id"]) >= len(rows) - 4
    kept = ids("simhash_dedup")
    assert kept.count(7) == 1 and not {500, 501} & set(kept) and len(kept) == len(set(kept))
    scanned = {x.doc_id: x for x in seen["secret_scan"]}
    assert sorted(scanned) == kept
    if 504 in scanned:
        assert scanned[504].text.endswith("password=[SECRET]") and scanned[504].n_chars == len(scanned[504].text)
    copies = ids("mixing")
    assert set(copies) <= set(kept) and max(copies.count(i) for i in copies) <= 2
    assert ids("byte_bpe") == copies
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, seen["byte_bpe"]))


CLASHES = ("row_hash", "times", "secrets", "score", "rejected", "n", "size", "row", "doc", "taken", "share", "component", "fp", "mark", "end")


def test_stages_take_odd_tables(spark, tmp_path):
    """Null and repeated ids, rows equal throughout, clashing columns, null texts, and tables without rows or labels."""
    rows = [(i, prose(40, i), "en", f"s{i % 2}", 1) for i in range(30)]
    rows += [(None, prose(40, 90), "en", "s0", 1), (None, prose(40, 91), "en", None, None), (None, prose(40, 91), "en", None, 7)]
    rows += [(5, prose(40, 95), "en", "s1", 2), (6, *rows[6][1:]), (6, *rows[6][1:]), (40, None, "en", "s1", 0), (41, "", None, "s1", 0), (42, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(5)
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    schema, stage = docs.schema.simpleString(), dict(corpus_pipeline.STAGES)

    def run(name, df=docs):
        out = stage[name](spark, df, str(tmp_path))
        assert name == "byte_bpe" or out.schema.simpleString() == schema
        got = out.collect()
        assert name == "byte_bpe" or all(r[c] == f"{c} {'none' if r.doc_id is None else r.doc_id}" for r in got for c in CLASHES)
        return got

    texts = lambda got: sorted((repr(r.doc_id), repr(r.text)) for r in got)
    assert texts(run("language_id")) == sorted((repr(r[0]), repr(r[1])) for r in rows if r[1])
    kept = run("simhash_dedup")
    want = {(r[0], r[1]) for r in rows if r[1]} | {(40, None)}
    assert texts(kept) == sorted((repr(a), repr(b)) for a, b in want), "one of each group, null ids and null texts too"
    assert sorted(map(repr, run("simhash_dedup", docs.repartition(2)))) == sorted(map(repr, kept))
    assert texts(run("secret_scan")) == sorted((repr(r[0]), repr(r[1])) for r in rows)
    mixed = run("mixing")
    assert {repr(r.doc_id) for r in mixed} >= {"None"} and {(r.doc_id, r.text) for r in mixed} <= {(r[0], r[1]) for r in rows if r[1]}
    assert sorted(map(repr, run("mixing", docs.repartition(3)))) == sorted(map(repr, mixed))
    assert len(run("byte_bpe")) == len(rows)
    for name in stage:
        assert run(name, docs.limit(0)) == []
    assert run("language_id", docs.withColumn("lang", F.lit(None).cast("string"))) == []
