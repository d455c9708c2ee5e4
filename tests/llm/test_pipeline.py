import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import line_dedup, mixing, secret_scan, textbytes, url_filter
from plumbline.llm.scratch import Scratch
from tests.llm.test_leaks_mix_simhash import brute_components, brute_leaks, brute_print


def test_stages_equal_brute_force(spark, documents, rows, tmp_path):
    items = [(1, "AA bb cc dd ee ff gg hh ii jj kk")]
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, scratch, kept = documents, Scratch(spark, "test"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = scratch.put(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == documents.columns
        kept[name] = [tuple(r) for r in docs.collect()]

    want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    blind = lambda r: tuple(x for c, x in zip(documents.columns, r) if c != "lang")
    assert Counter(map(blind, kept["language_id"])) == Counter(map(blind, want))
    place = documents.columns.index("lang")
    assert all(r[place] in ("en", "de") for r in kept["language_id"]) and any(r[place] is None for r in want)
    assert {blind(r): r[place] for r in want if r[place]}.items() <= {blind(r): r[place] for r in kept["language_id"]}.items()

    parts = brute_components([brute_print(r[1]) for r in want])
    first = {}
    for p, r in zip(parts, want):
        rank = (r[0] is None, r[0] if r[0] is not None else 0)
        first[p] = min(first.get(p, rank), rank)
    got = kept["simhash_near_dedup"]
    assert len(got) == len(first) and Counter((r[0] is None, r[0] or 0) for r in got) == Counter(first.values())

    clean = {(doc, n) for doc, n, hit, _ in brute_leaks(got, items) if not hit}
    assert 0 < len(kept["benchmark_decontamination"]) < len(got) and {r[0] for r in kept["benchmark_decontamination"]} == {doc for doc, _ in clean}

    mixed = Counter(kept["source_mixing"])
    frame = spark.createDataFrame(kept["benchmark_decontamination"], documents.schema)
    copies = Counter({tuple(r[c] for c in documents.columns): r.copies for r in mixing.mix(frame).collect() if r.copies})
    assert mixed == copies and max(mixed.values()) > 1

    tokenizer, start, tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, Counter()
    for doc, text, *_ in sorted(kept["source_mixing"], key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        tokens[(doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == tokens


def test_columns_of_any_name_pass_through(spark, documents, tmp_path):
    names = "n_lines n_dropped _at _doc _version _lines _kept _pages doc version mine own spans copies size lang_pred score hit_spans items bucket digest row id component copy".split()
    extra = documents.where("doc_id < 40 or doc_id >= 200").withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in names})
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "AA bb cc dd ee ff gg hh ii jj kk")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, scratch = spark.read.parquet(f"{tmp_path}/documents.parquet"), Scratch(spark, "names")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = scratch.put(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == extra.columns
        assert all(r[n] == (f"{n} of {r.doc_id}" if r.doc_id is not None else None) for r in docs.collect() for n in names)
    assert docs.count() > 10
    lines = line_dedup.dedup_lines(extra)
    kept = [n for n in names if n not in ("n_lines", "n_dropped")]
    assert lines.count() == extra.count() and all(r[n] == (f"{n} of {r.doc_id}" if r.doc_id is not None else None) for r in lines.collect() for n in kept)
    spans, _ = secret_scan.scan_versions(extra)
    assert all(r[n] == (f"{n} of {r.doc_id}" if r.doc_id is not None else None) for r in spans.collect() for n in names if n != "spans")
    pages = extra.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/x").alias("url"), F.lit(None).cast("string").alias("html"), *names)
    assert all(r[n] == (f"{n} of {r.page_id}" if r.page_id is not None else None) for r in url_filter.judge_pages(pages).collect() for n in names)


def test_pipeline_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_table_of_nulls(spark, documents, tmp_path):
    nulls = documents.select(*[F.lit(None).cast(t).alias(c) for c, t in documents.dtypes]).limit(3)
    nulls.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 1


def test_workers_of_the_stages_load_no_pandas():
    code = "import sys; from plumbline.llm import language_id, simhash, shingle_sets, decontaminate, mixing, token_output, pretokens; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2]).returncode == 0


def test_factorize_numbers_values_by_first_appearance():
    index, distinct = textbytes.factorize(np.array([7, 2, 7, 2**64 - 1, 2], np.uint64))
    assert index.tolist() == [0, 1, 0, 2, 1] and distinct.tolist() == [7, 2, 2**64 - 1]
    assert all(not len(x) for x in textbytes.factorize(np.zeros(0, np.uint64)))


def test_stages_take_texts_in_small_batches(spark, documents, tmp_path):
    """A worker gets a thousand rows at most, and looks at half a megabyte of them at a time."""
    name, sizes = "spark.sql.execution.arrow.maxRecordsPerBatch", lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches)
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        corpus_pipeline.drop_near_duplicates(spark, documents, str(tmp_path))
        most = spark.range(5000, numPartitions=1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
        assert most <= 1000
    finally:
        spark.conf.set(name, before)
    assert [b - a for a, b in textbytes.row_blocks(np.arange(0, 11 << 17, 1 << 17))] == [4, 4, 2]
