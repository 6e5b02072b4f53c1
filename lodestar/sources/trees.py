"""Source trees as tables of files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.extract import LANGUAGES, SKIPPED, language_of

#: parsers by language: a function from files(file_path, content) to the tables of extraction
Parser = Callable[[DataFrame], dict[str, DataFrame]]
_PARSERS: dict[str, tuple[tuple[str, ...], Parser]] = {}


def register_parser(language: str, extensions: Sequence[str], parser: Parser) -> None:
    """Add a parser; one of the same language is replaced."""
    _PARSERS[language] = (tuple(e.lower().lstrip(".") for e in extensions), parser)


def supported_extensions() -> list[str]:
    return sorted({e for own, _ in _PARSERS.values() for e in own} or set(LANGUAGES))


def glob_pattern() -> str:
    return "*.{" + ",".join(supported_extensions()) + "}"


def parsers() -> dict[str, tuple[tuple[str, ...], Parser]]:
    return dict(_PARSERS)


def read_tree(spark: SparkSession, root: str, skipped: Sequence[str] = SKIPPED) -> DataFrame:
    """(file_path, language, content, mtime): the code files below ``root`` outside skipped folders.

    One row per file, read by Spark's binary source, so any store that Spark reads will do.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob_pattern()).load(root)
    base = root.rstrip("/").rsplit("/", 1)[-1]
    relative = F.concat(F.lit(base), F.substring_index("path", f"/{base}", -1))
    outside = ~F.exists(F.split(relative, "/"), lambda p: p.isin(*skipped))
    return found.where(outside).select(relative.alias("file_path"), language_of(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("content"), (F.unix_micros("modificationTime") / 1000).alias("mtime"))
