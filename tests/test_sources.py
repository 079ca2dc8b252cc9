"""Marked-up corpus files, phrase files, stop words, postings text exchange."""

import os

from pyspark.sql import functions as F

from phrasedex.operators import build_inverted_index, merge_postings
from phrasedex.plans.build import corpus_postings
from phrasedex.session import local_path, shared_dir
from phrasedex.sources import (
    STOP_WORDS,
    parse_marked_documents,
    postings_from_text,
    postings_to_text,
    read_marked_corpus,
    read_queries,
    read_stopwords,
    stopword_list,
    with_line_numbers,
    write_marked_corpus,
)
from tests.conftest import SF0001


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_marked_corpus_roundtrip(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    path = shared_dir(spark, "t-marked")
    write_marked_corpus(docs, path)
    back = parse_marked_documents(read_marked_corpus(spark, path))
    got = {r.doc_id: r.body for r in back.collect()}
    want = {r.doc_id: (r.text or "") + "\n" for r in docs.collect()}
    assert got == want


def test_header_quirks(spark):
    segs = [
        ('\n<doc id="5">\nbody a>\nrest here\n',),  # id token ends with '>': header runs to "a>"
        ('<doc url="x">\nno id\n',),  # no id: dropped
        ('<doc id="7" title="A">\n',),  # empty body
        ('<doc id="8" title="x\nnever closes',),  # header never closes: dropped
    ]
    got = {r.doc_id: r.body for r in parse_marked_documents(spark.createDataFrame(segs, "segment string")).collect()}
    assert got == {5: "rest here\n", 7: ""}


def test_read_queries_numbering(spark):
    path = local_path(shared_dir(spark, "t-queries")) + "/q.txt"
    _write(path, "Civil War\n\nM80 M80A\n  \nKing Solomon\n\n\n\n")
    got = [(r.query_id, r.query) for r in read_queries(spark, path).orderBy("query_id").collect()]
    assert got == [(1, "Civil War"), (2, "M80 M80A"), (3, "King Solomon")]


def test_line_numbers_across_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id").alias("v"))
    got = [(r.line_no, r.v) for r in with_line_numbers(df).collect()]
    assert sorted(got) == [(i + 1, i) for i in range(1000)]


def test_stopwords(spark):
    assert len(STOP_WORDS) == 114 and STOP_WORDS[0] == "a" and STOP_WORDS[-1] == "z"
    path = local_path(shared_dir(spark, "t-stop")) + "/stop.dat"
    _write(path, "the\nof\n\nand\n")
    assert sorted(stopword_list(read_stopwords(spark, path))) == ["and", "of", "the"]


def test_text_styles_and_roundtrip(spark):
    docs = spark.createDataFrame([(3, "b a b"), (1, "a c"), (2000, "a")], "doc_id long, body string")
    post = corpus_postings(docs)
    pipe = {r.line for r in postings_to_text(post, "pipe").collect()}
    assert pipe == {"a 1|0,3|2", "a 2000|0", "b 3|0:4", "c 1|2"}
    tab = {r.line for r in postings_to_text(post, "tab").collect()}
    assert tab == {"a \t1:0,3:2", "a \t2000:0", "b \t3:0:4", "c \t1:2"}
    for style in ("pipe", "tab"):
        back = merge_postings(postings_from_text(postings_to_text(post, style)))
        a = sorted((r.term, r.doc_id, tuple(r.positions)) for r in back.collect())
        b = sorted((r.term, r.doc_id, tuple(r.positions)) for r in post.collect())
        assert a == b


def test_text_reader_accepts_both_separators_and_drops_junk(spark):
    lines = spark.createDataFrame([("a 1|0:5,2:3",), ("bad",), ("c x|1,4|2",), ("",)], "line string")
    got = sorted((r.term, r.doc_id, tuple(r.positions)) for r in postings_from_text(lines).collect())
    assert got == [("a", 1, (0, 5)), ("a", 2, (3,)), ("c", 4, (2,))]


def test_inverted_index_blocks(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a a"), (5000, "a")], "doc_id long, body string")
    inv = build_inverted_index(corpus_postings(docs), docs_per_block=1024).collect()
    got = {(r.term, r.block): [(p.doc_id, list(p.positions)) for p in r.postings] for r in inv}
    assert got == {("a", 0): [(1, [0]), (2, [0, 2])], ("a", 4): [(5000, [0])]}


def test_merge_partial_indexes(spark):
    d1 = spark.createDataFrame([(1, "x y")], "doc_id long, body string")
    d2 = spark.createDataFrame([(2, "y")], "doc_id long, body string")
    merged = merge_postings(corpus_postings(d1), corpus_postings(d2), corpus_postings(d1))
    got = sorted((r.term, r.doc_id, list(r.positions)) for r in merged.collect())
    assert got == [("x", 1, [0, 0]), ("y", 1, [2, 2]), ("y", 2, [0])]


def test_clean_corpus_write_read_roundtrip(spark):
    from phrasedex.sources import remove_stopwords, write_clean_corpus

    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    cleaned = remove_stopwords(docs)
    path = shared_dir(spark, "t-clean")
    write_clean_corpus(cleaned, path)
    back = {r.doc_id: r.body for r in parse_marked_documents(read_marked_corpus(spark, path)).collect()}
    assert back == {r.doc_id: r.body for r in cleaned.collect()}


def test_postings_text_files_roundtrip(spark):
    from phrasedex.sources import write_postings_text

    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    post = corpus_postings(docs)
    path = shared_dir(spark, "t-text-index")
    write_postings_text(postings_to_text(post, "pipe"), path)
    assert len([d for d in os.listdir(local_path(path)) if d.startswith("bucket=")]) >= 10
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    back = merge_postings(postings_from_text(lines))
    a = back.select("term", "doc_id", F.array_join("positions", ":").alias("p"))
    b = post.select("term", "doc_id", F.array_join("positions", ":").alias("p"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
