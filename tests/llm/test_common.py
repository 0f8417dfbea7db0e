"""Scratch folder and text columns."""

from tidemark.llm import common
from tidemark.llm.shingles import lowered, shingle_hashes, shingle_set, word_hashes


def test_scratch_follows_the_session(spark):
    assert common.scratch(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_written_table_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    got = common.write_table(df, "t")
    assert got.schema == df.schema and sorted(map(tuple, got.collect())) == [(1, None), (2, "x")]


def test_doc_texts_of_odd_columns(spark):
    df = spark.createDataFrame([(1, None, "z")], "`my id` int, `the.text` string, doc_id string")
    assert [tuple(r) for r in common.doc_texts(df, "my id", "the.text").collect()] == [(1, "")]


def test_word_hashes_depend_on_the_word_alone():
    a, b = word_hashes(b"one two  three"), word_hashes(b"\tthree two\none")
    assert a.tolist() == b[::-1].tolist() and len(set(a.tolist())) == 3
    assert word_hashes(b" \n ").size == word_hashes(b"").size == 0
    assert word_hashes(b"ab")[0] != word_hashes(b"ba")[0] and word_hashes(b"a")[0] != word_hashes(b"aa")[0]


def test_shingle_sets():
    assert lowered("AÉz") == "aÉz".encode()
    assert len(shingle_set(b"a b c", 4)) == 1 and len(shingle_set(b"", 4)) == 0
    assert len(shingle_hashes(word_hashes(b"a b a b a b"), 2)) == 5 and len(shingle_set(b"a b a b a b", 2)) == 2
    assert shingle_set(b"a b c d", 4).tolist() != shingle_set(b"a b c d", 5).tolist() or len(shingle_set(b"a b c d", 5)) == 1
