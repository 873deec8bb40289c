"""Guards for SQL that users write (P-11..P-13): one reading statement, values only as named parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SHAPES = {"po": r"\d{8}", "tax": r"\d{13}", "invoice": r"[A-Za-z0-9/_.\-]{1,40}"}
WRITES = re.compile(r"\b(insert|update|delete|merge|upsert|drop|alter|create|truncate|grant|revoke|call|exec|execute|begin|declare|lock|commit|rollback|savepoint|rename|comment|explain|plan|set|reset|refresh|cache|uncache|load|msck)\b", re.I)
#: Quoted text (with Spark's backslash escapes), quoted names and comments.
APART = re.compile(r"""(?P<quoted>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")|(?P<name>`(?:[^`]|``)*`)|(?P<comment>--[^\n]*|/\*.*?\*/)""", re.S)


class Refused(ValueError):
    """The text or a value isn't allowed."""


def read_only(sql: str) -> str:
    """The statement without comments, if it is a single SELECT or WITH without any writing keyword outside quoted text."""
    bare = APART.sub(lambda m: " " if m["comment"] else m[0], sql).strip().rstrip(";").strip()
    outside = APART.sub(lambda m: " " if m["comment"] else "''" if m["quoted"] else "``", sql).strip().rstrip(";").strip()
    left = re.sub(r"''|``", " ", outside)
    if re.search(r"['\"`]|/\*|\*/", left):
        raise Refused("a quotation or comment that doesn't end")
    if re.search(r"\br''", outside, re.I):
        raise Refused("a raw literal, in which a backslash is no escape")
    if ";" in left:
        raise Refused("more than one statement")
    if not re.match(r"(select|with)\b", left.lstrip("( "), re.I):
        raise Refused("only SELECT and WITH")
    if found := WRITES.search(left):
        raise Refused(f"keyword {found[1]}")
    return bare


def checked(kind: str, value: str) -> str:
    if not re.fullmatch(SHAPES[kind], value or ""):
        raise Refused(f"{value!r} isn't of the shape of {kind}")
    return value


def run(spark: SparkSession, sql: str, cap: int = 50, **values: tuple[str, str]) -> DataFrame:
    """A user's query with named parameters (kind, value), and at most `cap` rows (L-02)."""
    return spark.sql(read_only(sql), args={k: checked(*v) for k, v in values.items()}).limit(cap)


def from_database(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    """C-05, C-10: a guarded query against a database; tasks are retried by Spark."""
    return spark.read.format("jdbc").option("url", url).option("query", read_only(sql)).options(**options).load()
