import duckdb

import corpus_pipeline as cp
from campaignlab.llm.line_dedup import line_sequence
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute_groups
from tests.llm.test_wu_manber import brute as brute_bench

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "mixing"]
    marks = dict(duckdb.sql(f"select doc_id, quality from '{sf001}/labels.parquet'").fetchall())
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = cp.quality(spark, docs, sf001).cache()
    assert kept.columns == COLUMNS
    ids = {r["doc_id"] for r in kept.collect()}
    good = [d for d, q in marks.items() if q]
    assert sum(d in ids for d in good) >= 0.95 * len(good)

    cut = cp.lines(spark, kept, sf001).cache()
    assert cut.columns == COLUMNS
    before = [(d, rows[d]) for d in ids]
    gone, text = brute_lines(before, 25), {r["doc_id"]: r["text"] for r in cut.collect()}
    assert text == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[(d, t)]) for d, t in before}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    assert any(len(line_sequence(t.encode())[0]) < len(line_sequence(rows[d].encode())[0]) for d, t in text.items())

    one = cp.near_copies(spark, cut, sf001).cache()
    assert one.columns == COLUMNS
    left = {r["doc_id"] for r in one.collect()}
    assert left == {c for _, _, c in brute_groups(sorted(text.items()))} and one.count() == len(left)

    clean = cp.decontaminate(spark, one, sf001).cache()
    assert clean.columns == COLUMNS
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    some = sorted(left)[:40]
    want = {d for d in some if brute_bench(text[d], items)[1] == 0}
    assert {r["doc_id"] for r in clean.collect()} & set(some) == want

    mixed = cp.mix(spark, clean, sf001)
    assert mixed.columns == [*COLUMNS, "copy"] and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}


def test_run(spark, sf001):
    out = cp.run(spark, sf001)
    assert out.columns == [*COLUMNS, "copy"] and out.count() > 50


FULL = "doc_id long, text string, lang string, source string, n_chars long, copy int, copy_1 string, key string, score double, `a.b` int, __row int"


def odd_table(spark, folder, rows, schema, fields, benchmark, labels):
    spark.createDataFrame([fields(d, t) for d, t in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_odd_rows_go_through_all_stages(spark, odd, tmp_path):
    """Nulls, empties, repeated rows, a very long text, clashing names: one of each group of
    near copies and nothing that holds a benchmark window is left."""
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [*odd, (70, f"start {leak} end"), (71, None), (72, "own words of a clean text " * 3)]
    odd_table(spark, tmp_path, rows, FULL, lambda d, t: (d, t, "en", "src0", 5, 1, "c", "k", 0.1, 2, 3), [(1, leak), (None, None)], [])
    out = cp.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "copy_1", "key", "score", "a.b", "__row", "copy_2"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = docs
    for name, stage in cp.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    texts = [t or "" for _, t in kept]
    assert len(texts) == len(set(texts)) and not any(leak in t for t in texts)
    assert sum(not t.strip() for t in texts) == 1 and any("own words" in t for t in texts)
    assert (5, "word " * 30_000) in kept
    assert {(r["doc_id"], r["text"]) for r in out.collect()} <= set(kept)


def test_few_columns_and_empty_tables(spark, tmp_path):
    some = [(1, "a b c d e f"), (2, "other words entirely in this one here")]
    odd_table(spark, tmp_path / "few", some, "doc_id long, text string, source string", lambda d, t: (d, t, None), [], [])
    assert cp.run(spark, str(tmp_path / "few")).columns == ["doc_id", "text", "source", "copy"]
    odd_table(spark, tmp_path / "none", [], FULL, None, [], [])
    assert cp.run(spark, str(tmp_path / "none")).count() == 0
