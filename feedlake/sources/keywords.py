"""An index from words to the files of an item table that hold them, for keyword searches.

A keyword is any substring, so it is cut like the texts at what is no letter or digit: of its pieces the first ends a word, the last
begins one, those between are whole words and a single piece lies anywhere in one.  Files that hold a fitting
word for every piece are read and their rows compared with the keyword itself, so rows are those of the scan.

The index has a row for every word of a file, sorted by word, so whole words and beginnings read few row groups;
it grows with the vocabulary of the files and not with their texts.  Files go by a hash of their path, which stands
in the file's own row; should two share one, both are read.  Words longer than ``PIECE`` are kept as
overlapping parts, of which one holds any ``PIECE`` characters of the word in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.operators.query import filter_keyword
from feedlake.session import stored
from feedlake.sources.files import folder_names
from feedlake.sources.items import scan_items

PIECE = 32
BETWEEN = r"[^\p{L}\p{M}\p{N}]"
# From this many files on, the table's own listing is no longer than their names: the whole table is read.
MOST_FILES = 5_000

# Rows of one sorted range of the index, about, before equal ones are one.
RANGE_ROWS = 1_000_000

POSTING = "word string, file bigint, path string"
# Stands for the file itself; no word is empty.
FILE = ""

def _file() -> Column:
    return F.col("_metadata.file_path")


def _number(file: Column) -> Column:
    return F.xxhash64(file)


def _parts(word: Column) -> Column:
    """The word, or parts of twice ``PIECE`` characters at every ``PIECE``-th, the last of which ends it."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(word) - PIECE - 1) / PIECE)).cast("int"))
    parts = F.transform(starts, lambda k: F.substring(word, k * PIECE + 1, F.lit(2 * PIECE)))
    return F.when(F.length(word) <= 2 * PIECE, F.array(word)).otherwise(parts)


def _words(text: Column) -> Column:
    return F.flatten(F.transform(F.split(F.lower(text), BETWEEN), _parts))


def _indexed(spark: SparkSession, index: str) -> DataFrame:
    if not folder_names(spark, index):
        return spark.createDataFrame([], POSTING)
    return spark.read.schema(POSTING).parquet(index)


def _known(spark: SparkSession, index: str) -> DataFrame:
    """(file) by path of every file in the index."""
    return _indexed(spark, index).where(F.col("word") == FILE).select(F.col("path").alias("file"))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(file) of a table's files; none is opened, as their content isn't asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return found.select(_file().alias("file"))


def index_keywords(spark: SparkSession, path: str, index: str, most: int = MOST_FILES) -> None:
    """Index the files of the item table at ``path`` that ``index`` doesn't know yet.

    Files are known by a row of their own, in the same commit as their words, so a run that fails leaves them to
    the next.  Words of files that are gone stay and are never asked for.

    The words of each item are written as they are, in tasks that hold one item at a time.  They become the
    index range by range, in as many ranges as their number asks for, so a task's memory doesn't grow with the table.
    """
    new = scan_items(spark, path).select(_file().alias("file"), "title", "description")
    if folder_names(spark, index):
        known = _known(spark, index)
        files = [r.file for r in _listed(spark, path).join(known, "file", "left_anti").limit(most + 1).collect()]
        # past so many names the texts are joined with them
        new = new.where(F.col("file").isin(files)) if len(files) <= most else new.join(known, "file", "left_anti")
    words = F.flatten(F.array(F.array(F.lit(FILE)), *(F.coalesce(_words(F.col(c)), F.array()) for c in ("title", "description"))))
    said = new.select(F.col("file").alias("path"), F.explode(F.array_distinct(words)).alias("word"))
    said = stored(said.select("word", _number(F.col("path")).alias("file"), F.when(F.col("word") == FILE, F.col("path")).alias("path")), "words")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), said.count() // RANGE_ROWS)
    postings = said.repartitionByRange(ranges, "word", "file").distinct()
    postings.sortWithinPartitions("word", "file").write.mode("append").parquet(index)


def _fits(pieces: list[str]) -> list[Column]:
    """For every piece that says something, which words fit it."""
    word, last = F.col("word"), len(pieces) - 1
    found = []
    for k, piece in enumerate(pieces):
        begin, end = F.lit(piece[:PIECE]), F.lit(piece[-PIECE:])
        if not piece:
            continue
        if last == 0:
            found.append(word.contains(begin))
        elif k == 0:
            found.append(word.endswith(end))
        elif k == last or len(piece) > PIECE:
            found.append(word.startswith(begin))
        else:
            found.append(word == begin)
    return found


def files_with(spark: SparkSession, index: str, keyword: str) -> DataFrame:
    """(file) of every indexed file that may hold the keyword."""
    lowered = F.lower(F.lit(keyword))
    fits = _fits(spark.range(1).select(F.split(lowered, BETWEEN).alias("p")).first().p)
    postings = _indexed(spark, index)
    if not fits:
        return _known(spark, index)
    wanted = fits[0]
    for fit in fits[1:]:
        wanted = wanted | fit
    seen = [F.max(fit.cast("int")).alias(f"p{k}") for k, fit in enumerate(fits)]
    by_file = postings.where(wanted & (F.col("word") != FILE)).groupBy("file").agg(*seen)
    fitting = by_file.where(sum(F.col(f"p{k}") for k in range(len(fits))) == len(fits)).select("file")
    return postings.where(F.col("word") == FILE).join(fitting, "file", "left_semi").select(F.col("path").alias("file"))


def scan_keyword(spark: SparkSession, path: str, index: str, keyword: str, most: int = MOST_FILES) -> DataFrame:
    """The rows of :func:`filter_keyword`, from the files that the index names and those it doesn't know."""
    items = scan_items(spark, path, parts=True)
    named = files_with(spark, index, keyword).unionByName(_listed(spark, path).join(_known(spark, index), "file", "left_anti"))
    # a name more than allowed tells that there are too many
    files = [r.file for r in named.limit(most + 1).collect()]
    if not files:
        return items.limit(0)
    return filter_keyword(items.where(_file().isin(files)) if len(files) <= most else items, keyword)
