"""The index of words and files: rows of the scan, from fewer files."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedlake.operators.query import filter_keyword
from feedlake.session import work_dir
from feedlake.sources import items as tables
from feedlake.sources import keywords

LONG = "".join(chr(97 + (k * 7 + k // 26) % 26) for k in range(300))
TEXTS = [
    ("Rain in the north", None), ("", "ÉTÉ à Nice, sun"), (None, None), ("a" * 64 + "b", "c" * 65), (LONG, "x"), ("Rain  in", "one-two_three"), ("ΟΔΟΣ ΣΑΣ", "𝒜𝒷 東京は雨"), ("tornado", "no rain"),
]


def stored_items(spark, texts=TEXTS, first=0):
    """One file for every text: each is of a day of its own."""
    rows = [("f", t, f"l{first + k}", d, "a", "", datetime(2024, 1, 1) + timedelta(days=first + k), "h", first + k) for k, (t, d) in enumerate(texts)]
    return spark.createDataFrame(rows, tables.ITEM)


@pytest.fixture(scope="module")
def served(spark):
    path = work_dir(spark, "test-keywords")
    tables.write_items(stored_items(spark), path)
    keywords.index_keywords(spark, path, f"{path}-words")
    return path


def links(df):
    return sorted(r.link for r in df.select("link").collect())


def files_read(df):
    plan = df.select("link", "title")._jdf.queryExecution().executedPlan()
    plan.execute().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size()))


@pytest.mark.parametrize("keyword", [
    "", " ", "rain", "AIN", "rain in", "n in t", "  in", "été à", "e, S", "one-two", "-", "_three", "two_", "東京", "は雨", "ΣΑΣ", "οδο", "𝒷", "nothing of it", "a" * 64, "a" * 65, "aab", "b", "c" * 65, "c" * 66,
    LONG, LONG[5:70], LONG[100:140], LONG[40:290], LONG[-33:], LONG[:33], LONG[3:36] + "z", "%", "north\n",
])
def test_rows_of_the_scan(spark, served, keyword):
    scan = filter_keyword(tables.scan_items(spark, served, parts=True), keyword)
    assert links(keywords.scan_keyword(spark, served, f"{served}-words", keyword)) == links(scan)
    assert links(keywords.scan_keyword(spark, served, f"{served}-words", keyword, most=1)) == links(scan)


def test_only_files_with_fitting_words_are_read(spark, served):
    for keyword, files in (("rain in the", 1), ("tornado", 1), ("rain", 3), (LONG[200:260], 1), ("e, s", 1), ("-", len(TEXTS))):
        assert files_read(keywords.scan_keyword(spark, served, f"{served}-words", keyword)) == files, keyword
    assert keywords.scan_keyword(spark, served, f"{served}-words", "hail").isEmpty()


def test_every_part_of_a_long_word_is_found(spark, served):
    for k in range(0, len(LONG) - 40, 13):
        assert keywords.files_with(spark, f"{served}-words", LONG[k : k + 40]).count() == 1


def test_new_files_are_read_and_then_indexed(spark):
    path = work_dir(spark, "test-keywords-new")
    words = f"{path}-words"
    tables.write_items(stored_items(spark), path)
    keywords.index_keywords(spark, path, words)
    tables.write_items(stored_items(spark, [("Late rain", "")], first=100), path)  # partitions of other days stay
    assert links(keywords.scan_keyword(spark, path, words, "late rain")) == ["l100"]
    assert files_read(keywords.scan_keyword(spark, path, words, "hail")) == 1
    before = spark.read.parquet(words).count()
    for _ in range(2):  # the second finds nothing new
        keywords.index_keywords(spark, path, words)
        # the file itself, the empty description and two words
        assert spark.read.parquet(words).count() == before + 3
    assert keywords.scan_keyword(spark, path, words, "hail").isEmpty()
    # files that are gone don't come back
    tables.expire_items(spark, path, F.lit(datetime(2024, 2, 1)))
    assert links(keywords.scan_keyword(spark, path, words, "rain")) == ["l100"]


def test_an_empty_table(spark):
    path = work_dir(spark, "test-keywords-empty")
    tables.write_items(stored_items(spark, []), path)
    keywords.index_keywords(spark, path, f"{path}-words")
    assert links(keywords.scan_keyword(spark, path, f"{path}-words", "rain")) == []


def test_ranges_of_the_index_follow_its_rows(spark, monkeypatch):
    """No task sorts more than its share, and none groups words before they are dealt to ranges."""
    monkeypatch.setattr(keywords, "RANGE_ROWS", 100)
    path = work_dir(spark, "test-keywords-ranges")
    texts = [(f"common word{k}", " ".join(f"w{(k * 7 + j) % 500}" for j in range(60))) for k in range(40)]
    tables.write_items(stored_items(spark, texts), path, unit="month")
    keywords.index_keywords(spark, path, f"{path}-words")
    index = spark.read.parquet(f"{path}-words")
    sizes = [r["count"] for r in index.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 200, sizes
    assert index.count() == index.distinct().count()
    scan = filter_keyword(tables.scan_items(spark, path, parts=True), "w13 w14")
    assert links(keywords.scan_keyword(spark, path, f"{path}-words", "w13 w14")) == links(scan) != []


def test_files_that_share_a_number_are_both_read(spark, monkeypatch):
    monkeypatch.setattr(keywords, "_number", lambda file: F.length(file).cast("bigint") % 2)
    path = work_dir(spark, "test-keywords-shared")
    words = f"{path}-words"
    tables.write_items(stored_items(spark), path)
    keywords.index_keywords(spark, path, words)
    tables.write_items(stored_items(spark, [("Late rain", "")], first=100), path)
    for most in (0, keywords.MOST_FILES):  # the new file by a join and by its name
        keywords.index_keywords(spark, path, words, most)
        assert spark.read.parquet(words).where("word = ''").count() == len(TEXTS) + 1
        for keyword in ("rain", "tornado", "late rain", "-"):
            scan = filter_keyword(tables.scan_items(spark, path, parts=True), keyword)
            assert links(keywords.scan_keyword(spark, path, words, keyword)) == links(scan), keyword
