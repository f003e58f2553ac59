"""Reading one large TSV or JSON array with many tasks, where a record may hold line breaks.

A file is scanned as text pieces, which Spark cuts at block borders. Whether a piece begins inside a quoted cell, a
string or a nested object depends on all pieces before it, but only through a small state. So every piece says what
it does to the state, blocks pass on one summary row each, and inside a block a running window tells every
piece its state. Pieces of one record are then put together; a record in one piece, as most are, is not moved again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.operators.staging import stage

BLOCK = ["_file", "_block"]
PLACE = [*BLOCK, "_at"]

#: A cell in quotes, doubled quotes inside, up to the tab or the end of the line; and one that the line leaves open.
_CLOSED_CELL = r'(^|\t)"(?:[^"]++|"")*+"(?=\t|\r?$)'
_OPEN_CELL = r'(^|\t)"(?:[^"]++|"")*+$'
#: The rest of a cell that an earlier line left open.
_CELL_END = r'^(?:[^"]++|"")*+"(?=\t|\r?$)'
#: Bytes of text that one task sorts: pieces of a block are put in order, with their numbers beside them.
SORT_BYTES = 64 << 20


def text_pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``value`` with its place: file, block of the file, and a number that grows inside a block."""
    lines = spark.read.option("lineSep", separator).text(path)
    return lines.select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )


def running_sum(pieces: DataFrame, amount: Column, name: str, sums: DataFrame | None = None) -> DataFrame:
    """Add the sum of ``amount`` over the pieces of the file up to each one, itself included.

    ``sums`` are the blocks' own as ``_sum``, if they are known: one row per block of a file.
    """
    valued = pieces.withColumn("_amount", amount)
    if sums is None:
        sums = valued.groupBy(*BLOCK).agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*BLOCK, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*BLOCK).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return valued.join(before, BLOCK).withColumn(name, F.sum("_amount").over(inside) + F.col("_before")).drop("_amount", "_before")


def with_open_cell(lines: DataFrame) -> DataFrame:
    """Add ``opens`` and ``closes``: whether each line begins and ends inside a quoted cell.

    A line maps the state before it to the one after it. It keeps it, turns it, or sets it whatever it was; after
    the last line that sets it, the state is that value turned as often as lines turn it since.
    """
    text = F.col("value")
    quoted = F.contains(text, F.lit('"'))

    def left_open(rest: Column) -> Column:
        return F.regexp_replace(rest, _CLOSED_CELL, "$1").rlike(_OPEN_CELL)

    outside = F.when(quoted, left_open(text)).otherwise(False)
    inside = F.when(quoted & text.rlike(_CELL_END), left_open(F.regexp_replace(text, _CELL_END, ""))).otherwise(True)
    mapped = lines.withColumns({"_from_out": outside, "_from_in": inside}).withColumns({
        "_turn": (F.col("_from_out") & ~F.col("_from_in")).cast("int"),
        "_set": F.when(F.col("_from_out") == F.col("_from_in"), F.col("_from_out").cast("int")),
    })
    inside_block = Window.partitionBy(*BLOCK).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    turned = mapped.withColumn("_turns", F.sum("_turn").over(inside_block)).withColumn(
        # The state at a line that sets it, as it would have been before the block's turns.
        "_base", F.last(F.when(F.col("_set").isNotNull(), F.pmod(F.col("_set") - F.col("_turns"), F.lit(2))), True).over(inside_block)
    )
    # One row per block of a file: what the block does to the state.
    blocks = turned.groupBy(*BLOCK).agg(F.max_by("_turns", "_at").alias("_turns"), F.max_by("_base", "_at").alias("_base"))
    so_far = Window.partitionBy("_file").orderBy("_block")
    upto = so_far.rowsBetween(Window.unboundedPreceding, 0)
    states = blocks.withColumn("_all_turns", F.sum("_turns").over(upto)).withColumn(
        "_set_to", F.last(F.when(F.col("_base").isNotNull(), F.pmod(F.col("_base") + F.col("_turns") - F.col("_all_turns"), F.lit(2))), True).over(upto)
    ).withColumn("_end", F.pmod(F.coalesce("_set_to", F.lit(0)) + F.col("_all_turns"), F.lit(2)))
    before = states.select(*BLOCK, F.coalesce(F.lag("_end").over(so_far), F.lit(0)).alias("_start"))
    placed = turned.join(before, BLOCK)
    ended = F.pmod(F.coalesce(F.col("_base"), F.col("_start")) + F.col("_turns"), F.lit(2)) == 1
    order = Window.partitionBy(*BLOCK).orderBy("_at")
    return placed.withColumn("closes", ended).withColumn(
        "opens", F.coalesce(F.lag("closes").over(order), F.col("_start") == 1)
    ).select(*lines.columns, "opens", "closes")


def _put_together(pieces: DataFrame, whole: Column, between: str) -> DataFrame:
    """Records as (value, _file, _block, _at) of their first piece; ``record`` numbers them, ``whole`` pieces are one."""
    alone = pieces.filter(whole).select("value", *PLACE)
    place = F.struct(*PLACE[1:])
    joined = (
        pieces.filter(~whole).groupBy("_file", "record")
        .agg(F.sort_array(F.collect_list(F.struct(*PLACE[1:], "value"))).alias("_pieces"), F.min(place).alias("_place"))
        .select(F.array_join(F.transform("_pieces", lambda p: p["value"]), between).alias("value"), "_file", "_place.*")
    )
    return alone.unionByName(joined)


def tsv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of TSV files as text in ``value``, without each file's first one and without empty lines.

    A record ends at a line break outside quoted cells; a cell is quoted if it begins with a quote.
    """
    lines = with_open_cell(text_pieces(spark, path, "\n"))
    numbered = running_sum(lines, F.when(F.col("opens"), 0).otherwise(1), "record")
    kept = numbered.filter((F.col("record") > 1) & (F.col("opens") | F.col("closes") | (F.rtrim(F.col("value"), F.lit("\r")) != "")))
    records = _put_together(kept, ~F.col("opens") & ~F.col("closes"), "\n")
    return records.withColumn("value", F.regexp_replace("value", r"\r$", ""))


def _count(text: Column, mark: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def _rise(text: Column) -> Column:
    """How much deeper the brackets of a text lead."""
    return _count(text, "[") + _count(text, "{") - _count(text, "]") - _count(text, "}")


def _json_facts(pieces: DataFrame) -> DataFrame:
    """Pieces with the number of their quotes, ``_quotes_here``, and the rise of brackets outside strings, its own closing
    brace included, if the piece begins outside a string (``_rise_out``) and if it begins inside one (``_rise_in``).

    Worked out as texts are scanned, once each: quotes cut a text into parts that are in turn outside and inside.
    """
    plain = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    cut = pieces.withColumn("_plain", plain).withColumns({
        "_quotes_here": _count(F.col("_plain"), '"'), "_parts": F.split("_plain", '"'),
    })
    even = F.array_join(F.filter("_parts", lambda _, i: i % 2 == 0), "")
    odd = F.array_join(F.filter("_parts", lambda _, i: i % 2 == 1), "")
    ends_out = (F.col("_quotes_here") % 2 == 0).cast("int")
    return cut.withColumns({"_even": even, "_odd": odd}).select(
        "value", *PLACE, "_quotes_here", (_rise(F.col("_even")) - ends_out).alias("_rise_out"),
        (_rise(F.col("_odd")) - (1 - ends_out)).alias("_rise_in"),
    )


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """The objects of JSON arrays as text in ``value``, whatever their line breaks.

    Pieces end at a closing brace. Strings tell by the parity of their quotes, objects by the depth of brackets
    outside strings. Texts move once, to as many tasks as their bytes ask for.
    """
    facts = _json_facts(text_pieces(spark, path, "}"))
    blocks = stage(
        facts.groupBy(*BLOCK).agg(F.sum("_quotes_here").alias("_sum"), F.sum(F.octet_length("value")).alias("_bytes")), "json-blocks"
    )
    size = blocks.agg(F.sum("_bytes")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SORT_BYTES))
    pieces = running_sum(facts.repartition(n, *BLOCK), F.col("_quotes_here"), "_quotes", blocks.drop("_bytes"))
    inside = F.pmod(F.col("_quotes") - F.col("_quotes_here"), F.lit(2)) == 1
    risen = pieces.withColumn("_rise", F.when(inside, F.col("_rise_in")).otherwise(F.col("_rise_out")))
    deep = running_sum(risen.drop("_rise_in", "_rise_out", "_quotes_here"), F.col("_rise"), "_depth")
    closed = (F.pmod("_quotes", F.lit(2)) == 0) & (F.col("_depth") == 1)
    numbered = running_sum(deep.withColumn("_closed", closed), F.col("_closed").cast("int"), "_records")
    record = (F.col("_records") - F.col("_closed").cast("int")).alias("record")
    # A piece that begins in the array itself begins a record. Behind the last one only brackets are left.
    whole = F.col("_closed") & (F.col("_depth") - F.col("_rise") <= 1)
    records = _put_together(numbered.select("value", *PLACE, record, whole.alias("_whole")), F.col("_whole"), "}")
    text = F.regexp_replace(F.col("value"), r"^[\s,\[\x{FEFF}]+", "")
    return records.select(F.concat(text, F.lit("}")).alias("value"), *PLACE).filter(F.startswith(F.col("value"), F.lit("{")))


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file that ``path``, a file, folder or pattern, names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for s in files.globStatus(place) or []]
    sizes = [s.getLen() for s in found if s.isFile()]
    for folder in (s.getPath() for s in found if s.isDirectory()):
        sizes += [s.getLen() for s in files.listStatus(folder) if s.isFile()]
    return max(sizes, default=0)


def worth_splitting(spark: SparkSession, path: str) -> bool:
    """Whether a file is larger than what one task is given to scan."""
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    return largest_file(spark, path) > limit
