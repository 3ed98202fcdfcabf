"""Review-text source: blank-line separated records -> (user_id, item_id, ts).

Record layout (one review per record, other lines ignored)::

    product/productId: B00006HAXW
    review/userId: A1RSDE90N6RSZF
    review/time: 1042502400
    ...

Everything is plain Spark SQL: the text reader splits records on the
delimiter per read (no global Hadoop setting), and parsing is a chain of
array / regex expressions kept inside whole-stage codegen. Only the first-N
sample of a large file reads lines by byte ranges (``_first_of_large_file``).
"""

from __future__ import annotations

from itertools import islice, takewhile

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import LINE_BREAK_PATTERN, WHITESPACE_CLASS, unicode_strip

# The record delimiter and the three line prefixes (exact,
# case-sensitive, including the trailing space).
RECORD_DELIMITER = "\n\n"
PRODUCT_PREFIX = "product/productId: "
USER_PREFIX = "review/userId: "
TIME_PREFIX = "review/time: "

INTERACTION_COLUMNS = ("user_id", "item_id", "ts")


def read_record_blocks(spark: SparkSession, path: str | list[str],
                       num_partitions: int | None = None) -> DataFrame:
    """One row per record (``value STRING``), split on a blank line."""
    blocks = spark.read.option("lineSep", RECORD_DELIMITER).text(path)
    if num_partitions:
        blocks = blocks.repartition(num_partitions)
    return blocks


def _line_value(norm: Column, prefix: str) -> Column:
    """Stripped value of the last line of ``norm`` starting with ``prefix``
    (NULL if there is none). ``norm`` is the record with every line break
    turned into ``\n`` and a leading ``\n``, so a line start is ``\n``."""
    key = "\n" + prefix
    after = F.substring_index(norm, key, -1)
    return F.when(F.instr(norm, key) > 0,
                  unicode_strip(F.substring_index(after, "\n", 1)))


def _occurrences(norm: Column, prefix: str) -> Column:
    key = "\n" + prefix
    return ((F.length(norm) - F.length(F.replace(norm, F.lit(key), F.lit(""))))
            / F.lit(len(key))).cast("int")


def parse_records(blocks: DataFrame, value_col: str = "value",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """S2 + F1: parse record blocks, drop rejected ones.

    * lines break as Python ``str.splitlines`` does;
    * product / user: the last matching line wins, an empty value rejects;
    * time: every time line must parse as an integer, else the record is
      rejected; the last one wins;
    * a record without any of the three is rejected.

    All string functions are code-generated; only a record with more than
    one time line takes an array path to check every one of them.
    """
    norm = F.regexp_replace(F.concat(F.lit("\n"), F.col(value_col)), LINE_BREAK_PATTERN, "\n")
    parsed = blocks.select(*keep, norm.alias("_norm")).select(
        *keep,
        _line_value(F.col("_norm"), USER_PREFIX).alias("user_id"),
        _line_value(F.col("_norm"), PRODUCT_PREFIX).alias("item_id"),
        _line_value(F.col("_norm"), TIME_PREFIX).try_cast("bigint").alias("ts"),
        _occurrences(F.col("_norm"), TIME_PREFIX).alias("_n_time"),
        "_norm")
    every_time_parses = F.when(F.col("_n_time") <= 1, F.col("ts").isNotNull()).otherwise(
        ~F.exists(
            F.filter(F.split("_norm", "\n"), lambda line: line.startswith(TIME_PREFIX)),
            lambda line: unicode_strip(
                line.substr(F.lit(len(TIME_PREFIX) + 1), F.length(line))).try_cast("bigint").isNull()))
    return (
        parsed.filter(
            (F.length("user_id") > 0)
            & (F.length("item_id") > 0)
            & (F.col("_n_time") > 0)
            & every_time_parses)
        .select(*keep, "user_id", "item_id", "ts")
    )


def load_interactions(spark: SparkSession, path: str | list[str],
                      num_partitions: int | None = None) -> DataFrame:
    """S1 + S2 + F1: review text files -> ``user_id, item_id, ts``."""
    return parse_records(read_record_blocks(spark, path, num_partitions))


def record_text(user: Column, item: Column, ts: Column, extra: Column | None = None,
                variant: Column | None = None) -> Column:
    """Build one record block from columns (used to write review text).

    ``variant`` (0..3) varies line order and padding, so that readers are
    exercised on the layouts the format allows.
    """
    u = F.concat(F.lit(USER_PREFIX), user.cast("string"))
    p = F.concat(F.lit(PRODUCT_PREFIX), item.cast("string"))
    t = F.concat(F.lit(TIME_PREFIX), ts.cast("string"))
    other = F.concat(F.lit("review/summary: "), extra.cast("string")) if extra is not None \
        else F.lit("review/helpfulness: 0/0")
    padded_p = F.concat(F.lit(PRODUCT_PREFIX), F.lit(" "), item.cast("string"), F.lit("\t"))
    padded_t = F.concat(F.lit(TIME_PREFIX), ts.cast("string"), F.lit(" "))
    if variant is None:
        return F.concat_ws("\n", p, u, other, t)
    v = variant % 4
    return (F.when(v == 0, F.concat_ws("\n", p, u, other, t))
            .when(v == 1, F.concat_ws("\n", other, t, u, p))
            .when(v == 2, F.concat_ws("\n", u, padded_p, other, t))
            .otherwise(F.concat_ws("\r\n", padded_t, p, other, u)))


def write_review_text(records: DataFrame, path: str, text_col: str = "text",
                      sort_cols: list[str] | None = None,
                      num_files: int | None = None) -> None:
    """Text sink: one record per row, records separated by a blank line.

    With ``sort_cols`` the files are range partitioned and sorted so that file
    order (part-00000, part-00001, ...) is the key order.
    """
    out = records
    if sort_cols:
        n = num_files or records.sparkSession.sparkContext.defaultParallelism
        out = out.repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols)
    out.select(F.col(text_col).alias("value")).write.option(
        "lineSep", RECORD_DELIMITER).text(path)


# Whitespace other than a line feed, and a run of whitespace-only lines.
_WS_NO_LF = r"[\p{Z}\x{09}\x{0b}\x{0c}\x{0d}\x{1c}-\x{1f}\x{85}]"
_BLANK_LINES = rf"\n(?:{_WS_NO_LF}*\n)+"


def _sample_blocks(spark: SparkSession, files: list[str]) -> DataFrame:
    """Non-empty records of ``files`` split as the line-based sampler does,
    with their order key (file, split start, row in split, part in row)."""
    return (
        spark.read.option("lineSep", RECORD_DELIMITER).text(files)
        .select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_row"),
            F.regexp_replace("value", r"\r\n?", "\n").alias("value"))
        .select("_file", "_start", "_row",
                F.posexplode(F.split(F.concat(F.lit("\n"), "value", F.lit("\n")),
                                     _BLANK_LINES)).alias("_part", "value"))
        .withColumn("value", F.regexp_replace(
            "value", rf"^(?:{_WS_NO_LF}*\n)+|(?:\n{_WS_NO_LF}*)+$", ""))
        .withColumn("value", F.regexp_replace("value", r"^\n+", ""))
        .filter(F.length(F.regexp_replace("value", rf"{WHITESPACE_CLASS}", "")) > 0)
    )


# A file of at least this size is read in ranges. It is cut into ranges of this
# size, or into _MOST_RANGES if that would be more of them.
RANGE_BYTES = 8 << 20
_MOST_RANGES = 1 << 16


def _first_partitions(rdd: RDD, n: int) -> RDD:
    """The first ``n`` partitions of ``rdd``; the others are never opened."""
    sc = rdd.context
    # a Scala set is the predicate "is in the set"
    chosen = sc._jvm.org.apache.spark.api.python.PythonUtils.toSeq(list(range(n))).toSet()
    pruned = sc._jvm.org.apache.spark.rdd.PartitionPruningRDD.create(rdd._jrdd.rdd(), chosen)
    return RDD(pruned.toJavaRDD(), sc, rdd._jrdd_deserializer)


def _starts(lines, most: int) -> tuple[int, bool, bool | None]:
    """Of one range: records that start after a blank line of it (no more than
    ``most`` are looked for), whether its first line has text, and whether its
    last one has (None without lines)."""
    found, head, open_ = 0, False, None
    for line in lines:
        text = bool(line.strip())
        if open_ is None:
            head = text
        elif text and not open_:
            found += 1
        open_ = text
        if found >= most:
            break
    return found, head, open_


def _pieces(lines, at: int, before: int, open_: bool, n: int):
    """``(pos, at, text)``: what range ``at`` holds of the first ``n`` records, one
    piece per record, when ``before`` records start ahead of it and the last of
    them is still ``open_``."""
    pos, piece = before - 1, []
    for line in lines:
        if line.strip():
            if not open_:
                pos += 1
                if pos >= n:
                    break
            open_ = True
            piece.append(line)
        else:
            if piece:
                yield pos, at, "\n".join(piece)
            piece, open_ = [], False
    if piece:
        yield pos, at, "\n".join(piece)


def _first_of_large_file(spark: SparkSession, file: str, size: int,
                         n: int) -> tuple[DataFrame, int]:
    """The first ``n`` records of one file as ``pos, value``, and how many there are.

    The file is cut into byte ranges of whole lines. Record starts are counted in
    1, 2, 4, ... ranges at a time, each task stopping at what is missing, until the
    start behind the n-th record is found: then no record of the sample goes on in
    a range that was not counted. The counts (three values per range) give every
    range the position of its first record and whether a record of the range
    before goes on in it; the pieces of such a record are put together at the end.
    """
    sc = spark.sparkContext
    part = max(RANGE_BYTES, -(-size // _MOST_RANGES))
    lines = sc.newAPIHadoopFile(
        file, "org.apache.hadoop.mapreduce.lib.input.TextInputFormat",
        "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text",
        conf={"mapreduce.input.fileinputformat.split.maxsize": str(part)})
    total = lines.getNumPartitions()
    state: list[tuple[int, bool]] = []  # per range: records before it, the last one open
    found, open_, step = 0, False, 1
    while len(state) < total and found <= n:
        missing = n + 1 - found
        ranges = list(range(len(state), min(total, len(state) + step)))
        for starts, head, last in sc.runJob(
                lines, lambda rows: [_starts((line for _, line in rows), missing)], ranges):
            if found > n:
                break
            state.append((found, open_))
            found += starts + (head and not open_)
            open_ = open_ if last is None else last
        step *= 2

    def emit(at, rows):
        return _pieces((line for _, line in rows), at, *state[at], n)
    pieces = spark.createDataFrame(
        _first_partitions(lines, len(state)).mapPartitionsWithIndex(emit),
        "pos bigint, part int, value string")
    ordered = F.array_sort(F.collect_list(F.struct("part", "value")))
    return (pieces.groupBy("pos").agg(F.array_join(ordered["value"], "\n").alias("value")),
            min(n, found))


def _first_of_files(spark: SparkSession, files: list[str], n: int) -> tuple[DataFrame, int]:
    """The first ``n`` records of small files as ``pos, value``, and how many there are."""
    from ..operators.prepare import first_n
    blocks = _sample_blocks(spark, files)
    # input tasks = splits of the files (known without running a job)
    tasks = spark.read.option("lineSep", RECORD_DELIMITER).text(files).rdd.getNumPartitions()
    first = first_n(blocks, ["_file", "_start", "_row", "_part"], n, tasks=tasks)
    return first.select("pos", "value"), min(n, blocks.count())


def sample_first_records(spark: SparkSession, path: str | list[str], n: int) -> DataFrame:
    """S3: the first ``n`` non-empty records in file order (smoke sample).

    Like the line-based smoke sampler, any whitespace-only line separates
    records and empty records are skipped. Files are taken in name order until
    they hold ``n`` records: small ones in growing batches (1, 2, 4, ... files),
    a large one (``RANGE_BYTES``) in growing steps of byte ranges, so the input
    read grows with ``n``, not with the dataset or with its largest file.
    Returns ``pos BIGINT`` (0-based sample order) and ``value STRING``.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    # names and sizes only: the content column is pruned, so no file is opened
    files = [(r["path"], r["length"]) for r in spark.read.format("binaryFile").load(path)
             .select("path", "length").orderBy("path").collect()]
    parts: list[DataFrame] = []
    found, at, batch = 0, 0, 1
    while at < len(files) and found < n:
        name, size = files[at]
        if size >= RANGE_BYTES:
            part, got = _first_of_large_file(spark, name, size, n - found)
            at += 1
        else:
            small = [f for f, _ in takewhile(lambda f: f[1] < RANGE_BYTES,
                                             islice(files, at, at + batch))]
            part, got = _first_of_files(spark, small, n - found)
            at += len(small)
            batch *= 2
        parts.append(part.select((F.col("pos") + F.lit(found)).alias("pos"), "value"))
        found += got
    if not parts:
        return spark.createDataFrame([], "pos bigint, value string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
