import inspect
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nextdist.llm import bond, chat, html, lattice, merkle, quality, toxicity, urlfilter
from nextdist.llm.common import file_rows


def test_rows_keep_their_numbers_however_a_scan_is_split(spark, tmp_path):
    spark.range(5000).selectExpr("id as doc_id", "uuid() as text").repartition(6).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    a = {r.doc_id: r._row for r in file_rows(docs).collect()}
    assert len(set(a.values())) == 5000
    spark.conf.set("spark.sql.files.maxPartitionBytes", 9000)
    try:
        b = {r.doc_id: r._row for r in file_rows(spark.read.parquet(str(tmp_path / "d")).select("text", "doc_id").where("doc_id >= 0")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert a == b
    assert file_rows(docs.where("doc_id < 0")).collect() == []


def helper_names(module) -> set[str]:
    """All names in quotes in a module's source, which is every helper column's name and more; names with the library's own prefix are its own."""
    found = re.findall(r"[\"'](_?[a-zA-Z][a-zA-Z_0-9]*)[\"']", inspect.getsource(module))
    return {n for n in found if not n.startswith("_nextdist_")} | {"_metadata", "_row", "_label", "_least", "_bad", "_c", "_clean"}


def rows_of(df, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


PAGES = [(1, "http://a.net/x", "<article>A <a href='http://b.org/'>b</a></article>"), (2, "http://b.org/y", "<p>short</p>"), (3, "http://c.com/z", "<a href=//a.net/>x</a>"), (4, None, None)]
TURNS = [(1, 1, "user", "the first message of this thread"), (1, 2, "assistant", "> the first message of this thread\n\nan answer to it"), (2, 1, "user", None), (None, None, None, "")]
VECTORS = [(i, [float(i % 3), 1.0, 0.5 * (i % 2)], i % 2) for i in range(20)] + [(50, None, 1), (None, [1.0, 1.0, 0.0], None)]
DOCS = [(i, f"some words of text number {i % 3} " * 20, "en", "s", 10) for i in range(12)] + [(None, None, None, None, None)]


@pytest.mark.parametrize(
    "module,table,schema,used,run",
    [
        (urlfilter, PAGES, "page_id long, url string, html string", ["url", "html"], urlfilter.url_filter),
        (chat, TURNS, "conv_id long, turn long, role string, text string", ["conv_id", "turn", "role", "text"], chat.quotation_links),
        (lattice, VECTORS, "vec_id long, embedding array<double>, label int", ["vec_id", "embedding", "label"], lambda v: lattice.embedding_links(v, keep=v.columns)),
        (html, PAGES, "page_id long, url string, html string", ["url", "html"], html.extract_pages),
        (quality, DOCS, "doc_id long, text string, lang string, source string, n_chars long", ["text", "lang", "source"], quality.quality_rules),
        (bond, VECTORS, "vec_id long, embedding array<double>, label int", ["vec_id", "embedding", "label"], lambda v: bond.hard_negatives(v, F.col("vec_id") % 3 == 0)),
        (merkle, DOCS, "doc_id long, text string, lang string, source string, n_chars long", merkle.FIELDS, merkle.tampered_manifest),
        (toxicity, DOCS, "doc_id long, text string, lang string, source string, n_chars long", ["doc_id", "text"], lambda d: toxicity.toxicity(d, toxicity.Model({"number": 5.0}, {}, [], [-4.0, 2.5, 2.0, -3.0]), hits=True)),
    ],
    ids=lambda x: getattr(x, "__name__", None),
)
def test_extra_columns_named_like_any_helper_change_nothing(spark, module, table, schema, used, run):
    plain = spark.createDataFrame(table, schema)
    want = run(plain)
    taken = {c.lower() for c in plain.columns}
    extra = []
    for name in sorted(helper_names(module)):
        if name.lower() not in taken:
            taken.add(name.lower())
            extra.append(name)
    got = run(plain.select("*", *[F.lit("x").alias(c) for c in extra]))
    assert rows_of(got, want.columns) == rows_of(want, want.columns)
    assert set(got.columns) - set(want.columns) <= set(extra)


def test_rows_of_any_frame_and_of_files_with_a_column_of_sparks_name(spark, tmp_path):
    df = spark.range(50).selectExpr("id as doc_id", "named_struct('file_path', 1, 'row_index', 2) as _metadata")
    df.write.parquet(str(tmp_path / "m"))
    files = file_rows(spark.read.parquet(str(tmp_path / "m")))
    assert len({r._row for r in files.collect()}) == 50 and files.columns == ["doc_id", "_metadata", "_row"]
    for x in (df, df.union(df), df.join(df.select("doc_id"), "doc_id"), spark.read.parquet(str(tmp_path / "m")).union(df)):
        y = file_rows(x)
        rows = y.collect()
        assert len({r._row for r in rows}) == len(rows) == x.count() and rows_of(y, ["doc_id", "_row"]) == rows_of(y, ["doc_id", "_row"])


def test_stages_take_any_frame(spark):
    docs = spark.createDataFrame([(i, "some plain words for a text of its own number %d\n" % i * 3, "en", "s", 9) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.union(docs).withColumn("_metadata", F.lit(1))
    for stage in (corpus_pipeline.line_dedup_stage, corpus_pipeline.near_dedup_stage):
        assert 0 < stage(spark, both, "").count() <= 12
