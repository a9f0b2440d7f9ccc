"""Tables to files."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Rows per CSV file. A file with quoted line breaks is read by one task, so big
# outputs must be many files.
CSV_ROWS_PER_FILE = 500_000


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "error") -> None:
    """Write the table once, one folder per split value.

    Reading ``split = 'x'`` back touches that folder only, so the whole table and
    each split are the same files.
    """
    df.write.mode(mode).partitionBy(split).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header; quotes, line breaks and outer spaces survive a round trip."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", CSV_ROWS_PER_FILE)
        .csv(path)
    )
