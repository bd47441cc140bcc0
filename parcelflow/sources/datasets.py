"""Readers of the dataset job: reply tweets, instruction corpora, and dispatch by kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import INSTRUCTION_COLUMNS, TWEET_COLUMNS, Dataset
from ..operators.pairs import reply_pairs
from ..staging import stage

# --- fixed values -------------------------------------------------------------------------------
# Cells that pandas reads as missing by default.
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# ------------------------------------------------------------------------------------------------

SOURCE_STEP = 10**32  # room for the order of one source inside ``ord``


CSV = {"quote": '"', "escape": '"'}
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
#: A line that begins outside of quotes and ends inside of them.  A quote counts at the start of a cell and, in a
#: quoted cell, where it is not doubled; what follows a closed cell up to the next comma is taken as it is.
ENDS_OPEN = rf'^(?:(?:{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+{_QUOTED}$'


def _state(rows: DataFrame, start: Column, within: list[str], order: str) -> DataFrame:
    """Whether each row is ``entered`` inside of quotes, from what it makes of either state.

    A row leaves from outside with ``from_out`` and from inside with ``from_in`` (1 is inside).  Where both are the
    same, it settles the state; where they are crossed, it turns it.  So the state before a row is the
    last settled one, turned as often as rows after it turn it.  ``start`` is the state before the first row.
    """
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when((F.col("from_out") == 1) & (F.col("from_in") == 0), 1).otherwise(0)
    rows = rows.withColumn("turned", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    settled = F.when(F.col("from_out") == F.col("from_in"), F.col("from_out") + F.col("turned"))
    known = F.coalesce(F.last(settled, ignorenulls=True).over(before), start)
    return rows.withColumn("entered", F.pmod(known + F.col("turned"), F.lit(2))).drop("turned")


def csv_records(spark: SparkSession, path: str, open_files: str = "raise") -> DataFrame:
    """Rows of CSV files with a header and quoted line breaks, read in splits of any place.

    Every line is told what it makes of a reader that comes to it inside or outside of quotes; these functions are
    put together within each split, then over the splits of a file, and give the state before each line.  Lines
    that are records of their own are parsed where they are; only the parts of longer ones are brought together.

    A file that ends inside of quotes is an error, as all lines after its last quote would be one record; with
    ``open_files="keep"`` they are.  Lines end with a line feed, with or without a carriage return, which goes
    inside of quotes too.
    """
    names = spark.read.options(header=True, **CSV).csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in names)
    text = F.regexp_replace("value", r"\r\z", "")
    has_quote = F.col("value").contains('"')
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        (has_quote & text.rlike(ENDS_OPEN)).cast("int").alias("from_out"),
        (~has_quote | F.concat(F.lit('"'), text).rlike(ENDS_OPEN)).cast("int").alias("from_in"),
    )
    lines = stage(lines, "lines")  # written, so that line numbers hold
    inside = Window.partitionBy("file", "split").orderBy("at")  # the lines of one split
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # What a split makes of either state is what its last line leaves.
    ends = []
    for name, first in (("from_out", 0), ("from_in", 1)):
        entered = _state(lines.select("file", "split", "at", "from_out", "from_in"), F.lit(first), ["file", "split"], "at")
        left = F.when(F.col("entered") == 1, F.col("from_in")).otherwise(F.col("from_out"))
        ends.append(entered.groupBy("file", "split").agg(F.max_by(left, "at").alias(name), F.min("at").alias("first")))
    splits = ends[0].join(ends[1].drop("first"), ["file", "split"])
    splits = stage(_state(splits, F.lit(0), ["file"], "split").withColumnRenamed("entered", "start"), "splits")
    if open_files == "raise":
        left = F.when(F.col("start") == 1, F.col("from_in")).otherwise(F.col("from_out"))
        last = splits.groupBy("file").agg(F.max_by(left, "split").alias("open")).filter("open = 1")
        bad = [r["file"] for r in last.select("file").limit(5).collect()]
        if bad:
            raise ValueError(f"CSV files that end inside of quotes: {', '.join(bad)}")
    known = lines.join(splits.select("file", "split", "start", "first"), ["file", "split"])
    states = _state(known, F.col("start"), ["file", "split"], "at")
    begins = F.col("entered") == 0
    marked = states.filter(~((F.col("split") == 0) & (F.col("at") == F.col("first")))).select(
        "file", "split", "at", "value", begins.alias("begins"), (begins & (F.col("from_out") == 0)).alias("whole")
    )
    whole = marked.filter("whole").select("value")
    parts = marked.filter("not whole").withColumn("own", F.when(F.col("begins"), F.col("at")))
    last = parts.groupBy("file", "split").agg(F.max("own").alias("last"))
    carried = F.last("last", ignorenulls=True).over(earlier)
    last = last.withColumn("carried", carried).drop("last")
    record = F.coalesce(F.last("own", ignorenulls=True).over(inside), "carried")
    pieces = parts.join(last, ["file", "split"]).withColumn("record", record)
    joined = pieces.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("split", "at", "value"))).alias("lines")
    )
    own_lines = F.transform("lines.value", lambda line: F.regexp_replace(line, r"\r\z", ""))
    long = joined.select(F.array_join(own_lines, "\n").alias("value"))
    records = whole.union(long).filter(F.trim(F.col("value")) != "")
    return records.select(F.from_csv(text, schema, CSV).alias("r")).select("r.*")


def read_tweets(
    spark: SparkSession,
    path: str,
    mapping: dict[str, str] | None = None,
    multi_line: bool = True,
    splits: bool = False,
) -> DataFrame:
    """Tweets from CSV with a header, all columns as strings, under the TWEETS names.

    Quoted line breaks need ``multi_line``, which reads each file in one task, or ``splits``, which
    reads large files in parallel and puts records together; turn both off for files without them.
    """
    columns = {**TWEET_COLUMNS, **(mapping or {})}
    if splits:
        raw = csv_records(spark, path)
    else:
        raw = spark.read.options(header=True, multiLine=multi_line, **CSV).csv(path)

    def cell(name: str) -> Column:
        return F.when(~F.col(columns[name]).isin(MISSING_CELLS), F.col(columns[name]))

    return raw.select(
        cell("tweet_id_col").alias("tweet_id"),
        F.col(columns["inbound_col"]).alias("inbound"),
        cell("user_col").alias("text"),
        cell("response_tweet_id_col").alias("response_tweet_id"),
    )


def _whole(n: int, kind: str) -> Column:
    return F.lit(str(n)).cast(kind)


def file_order() -> Column:
    """Order of a Parquet row by file and position: stable under splits and recomputation."""
    file = F.xxhash64("_metadata.file_path").cast("decimal(20,0)") + _whole(2**63, "decimal(20,0)")
    position = F.col("_metadata.row_index").cast("decimal(13,0)")
    return (file * _whole(2**40, "decimal(13,0)") + position).cast("decimal(38,0)")


def content_order(*columns: str) -> Column:
    """Order by content, for sources without keys or positions; equal rows share it, and may others."""
    return F.xxhash64(*columns).cast("decimal(38,0)") + _whole(2**63, "decimal(38,0)")


def _split_reader(spark: SparkSession, path: str, split: str):
    """Reader and path of one split: the folder of that name, else the files that begin with it."""
    if not split:
        return spark.read, path
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{split}")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read, f"{path}/{split}"
    return spark.read.option("pathGlobFilter", f"{split}[-._]*").option("recursiveFileLookup", True), path


def read_instructions(
    spark: SparkSession, path: str, mapping: dict[str, str] | None = None, fmt: str = "", split: str = ""
) -> DataFrame:
    """(input_raw, assistant_raw, local_ord) of a downloaded corpus, Parquet or JSON lines."""
    reader, path = _split_reader(spark, path, split)
    columns = {**INSTRUCTION_COLUMNS, **(mapping or {})}
    user, agent = columns["user_col"], columns["agent_col"]
    if (fmt or "parquet") == "parquet":
        rows = reader.parquet(path)
        return rows.select(
            F.col(user).alias("input_raw"), F.col(agent).alias("assistant_raw"),
            file_order().alias("local_ord"),
        )
    rows = reader.schema(f"`{user}` string, `{agent}` string").format(fmt).load(path)
    return (
        rows.select(F.col(user).alias("input_raw"), F.col(agent).alias("assistant_raw"))
        .distinct()
        .withColumn("local_ord", content_order("input_raw", "assistant_raw"))
    )


def _tweet_pairs(spark: SparkSession, d: Dataset) -> DataFrame:
    # The join passes over the tweets several times; the CSV is parsed once.
    pairs = reply_pairs(stage(read_tweets(spark, d.path, d.mapping, splits=True), "tweets"))
    # Whole numbers come first, in their order; other ids, and rows without one, after them.
    number = F.when(F.col("src_key").rlike(r"^[0-9]{1,20}$"), F.col("src_key").cast("decimal(38,0)"))
    other = content_order("src_key", "input_raw", "assistant_raw") + _whole(10**20, "decimal(38,0)")
    return pairs.withColumn("local_ord", F.coalesce(number, other).cast("decimal(38,0)"))


def _instruction_pairs(spark: SparkSession, d: Dataset) -> DataFrame:
    return read_instructions(spark, d.path, d.mapping, d.format, d.split).withColumn(
        "src_key", F.col("local_ord").cast("string")
    )


READERS = {"kaggle": _tweet_pairs, "hf": _instruction_pairs}


def reader_for(kind: str):
    if kind.startswith("kaggle"):
        return READERS["kaggle"]
    if kind in READERS:
        return READERS[kind]
    raise ValueError(f"unknown dataset kind {kind!r}")


def number_source(pairs: DataFrame, name: str, position: int) -> DataFrame:
    """RAW_PAIRS rows of one source; sources come in list order, rows in their local order."""
    start = _whole(position * SOURCE_STEP, "decimal(38,0)")
    return pairs.select(
        F.lit(name).alias("source"),
        "src_key",
        (start + F.col("local_ord")).cast("decimal(38,0)").alias("ord"),
        "input_raw",
        "assistant_raw",
    )


def load_pairs(spark: SparkSession, datasets: tuple[Dataset, ...]) -> DataFrame:
    """All datasets as RAW_PAIRS, without rows that lack a text."""
    parts = [
        number_source(reader_for(d.kind)(spark, d), d.name, i) for i, d in enumerate(datasets)
    ]
    return reduce(DataFrame.unionByName, parts).filter(
        "input_raw IS NOT NULL AND assistant_raw IS NOT NULL"
    )
