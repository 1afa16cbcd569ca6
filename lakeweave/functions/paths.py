"""Path expressions: identity, relative paths and partition paths of data files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIVE_NULL = "__HIVE_DEFAULT_PARTITION__"


def canonical(path: Column) -> Column:
    """One spelling of a path: a scheme always, one slash behind ``file:``, S3 clients' schemes as ``s3``."""
    typed = F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), path).otherwise(F.concat(F.lit("file:"), path))
    return F.regexp_replace(F.regexp_replace(typed, "^file:/+", "file:/"), "^s3[an]://", "s3://")


def without_scheme(path: Column) -> Column:
    """The path below scheme and leading slashes."""
    return F.regexp_replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:", ""), "^/+", "/")


def relative(path: Column, base: Column | str) -> Column:
    """``path`` below ``base``, whichever schemes they are written with; else ``path`` without its first slash."""
    base = without_scheme(F.lit(base) if isinstance(base, str) else base)
    base = F.regexp_replace(base, "/+$", "")
    bare = without_scheme(path)
    inside = F.startswith(bare, F.concat(base, F.lit("/")))
    return F.when(inside, F.substr(bare, F.length(base) + 2)).otherwise(F.regexp_replace(bare, "^/+", ""))


def partition_path(path: Column, base: Column | str) -> Column:
    """The folders between a table's base and a data file; empty where there are none."""
    rest = relative(path, base)
    return F.when(rest.contains("/"), F.regexp_replace(rest, "/[^/]*$", "")).otherwise("")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def hudi_file_id(path: Column) -> Column:
    """The file group of a base file ``<id>_<token>_<instant>.<format>``; any other file is its own group."""
    name = file_name(path)
    parsed = F.regexp_extract(name, r"^([^_]+)_([^_]+)_(\d+)\.\w+$", 1)
    return F.when(parsed != "", parsed).otherwise(name)


def hudi_file_instant(path: Column) -> Column:
    """The commit instant in a base file's name; null for any other file."""
    parsed = F.regexp_extract(file_name(path), r"^([^_]+)_([^_]+)_(\d+)\.\w+$", 3)
    return F.when(parsed != "", parsed)


def percent_decoded(text: Column) -> Column:
    """``%XX`` read as a byte; text that isn't so encoded stays."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, r"\+", "%2B")), text)


def percent_encoded(path: Column) -> Column:
    """A path as URIs write it: the percent sign, spaces and what URIs don't allow are encoded."""
    path = F.regexp_replace(path, "%", "%25")
    for mark in ' "<>\\^`{|}#?[]':
        path = F.replace(path, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
    return path


def escaped(value: Column) -> Column:
    """A partition value as folder names write it: what file systems and Hive don't allow is encoded."""
    value = F.regexp_replace(value, "%", "%25")
    for mark in "\"#'*/:=?\\{[]^\x7f":
        value = F.replace(value, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
    return value


def hive_value(folder: Column) -> Column:
    """The value of a partition folder: behind ``name=`` if that is there, decoded, null for the default partition."""
    value = F.regexp_replace(folder, "^[^=/]+=", "")
    return F.when(value != HIVE_NULL, percent_decoded(value))
