"""Symbol directories and allowlists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickertide.functions.text import SYMBOL_PATTERN, strip

# Fixed value: the footer line of a listing.
FOOTER = "File Creation Time"


def parse_symbol_lines(
    lines: DataFrame, header: str, symbol_col: str, include_etfs: bool = False, unique: bool = False
) -> DataFrame:
    """Pipe-delimited listing lines (column ``value``) to one column of clean symbols.

    Lines of another width, the footer, test issues and (by default) ETFs are
    left out; a listing without those columns counts as neither. ``unique`` parses equal
    lines once and gives their symbol once: right for a set, and cheap where lines repeat.
    """
    if unique:
        # The count keeps the filters below from being pushed to where lines still repeat.
        lines = lines.groupBy("value").count().select(F.when(F.col("count") > 0, F.col("value")).alias("value"))
    names = header.split("|")
    places = {name: i for i, name in reversed(list(enumerate(names)))}
    line = strip("value")
    rows = (
        lines.filter((line != "") & (line != header) & ~line.startswith(FOOTER))
        .select(F.split(line, r"\|", -1).alias("f"))
        .filter(F.size("f") == len(names))
    )

    def field(name: str, default: str):
        return F.col("f")[places[name]] if name in places else F.lit(default)

    keep = field("Test Issue", "N") == "N"
    if not include_etfs:
        keep = keep & (field("ETF", "N") != "Y")
    symbols = rows.filter(keep).select(F.upper(strip(field(symbol_col, ""))).alias("symbol"))
    return symbols.filter(F.col("symbol") != "")


def read_symbol_directory(
    spark: SparkSession, path: str, symbol_col: str, include_etfs: bool = False
) -> DataFrame:
    lines = spark.read.text(path)
    first = lines.select(strip("value").alias("value")).filter(F.col("value") != "").first()
    header = first["value"] if first else symbol_col
    return parse_symbol_lines(lines, header, symbol_col, include_etfs)


def build_symbols(*listings: DataFrame) -> DataFrame:
    """The sorted set of the listings' symbols that a text can yield."""
    union = listings[0]
    for listing in listings[1:]:
        union = union.unionByName(listing)
    return union.filter(F.col("symbol").rlike(SYMBOL_PATTERN)).distinct().orderBy("symbol")


def write_symbols(symbols: DataFrame, path: str) -> None:
    """One symbol per line, sorted, in a single file.

    There are at most 26 + 26^2 + ... + 26^5 such symbols, so one writer holds.
    """
    usable = symbols.filter(F.col("symbol").rlike(SYMBOL_PATTERN)).select("symbol").distinct()
    usable.repartition(1).sortWithinPartitions("symbol").write.mode("overwrite").text(path)


def read_allowlist(spark: SparkSession, path: str) -> DataFrame | None:
    """Symbols of a text file, ``#`` lines skipped; None when the file is absent."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    symbol = F.upper(strip("value")).alias("symbol")
    return lines.select(symbol).filter(
        (F.col("symbol") != "") & ~F.col("symbol").startswith("#")
    ).distinct()
