"""Check of one JSON request: strict parse, injected assertions, one projected answer, nothing on failure."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession


def _refuse(name: str):
    raise ValueError(f"not JSON: {name}")


def strict_json(text: str):
    """One JSON document and nothing else: no NaN or Infinity, no trailing text; the last of equal keys wins."""
    return json.loads(text, parse_constant=_refuse)


def read_request(spark: SparkSession, path: str):
    """The request in a file that Spark can reach; bytes that aren't UTF-8 become U+FFFD."""
    return strict_json(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode("utf-8", "replace"))


def check_request(request, assertions: list[Callable], requires_register: Callable) -> str:
    """Run the assertions in order, each may raise; then ``{"requires_register": ...}`` as one JSON line."""
    for check in assertions:
        check(request)
    return json.dumps({"requires_register": requires_register(request)}, separators=(",", ":"))


def request_exit(spark: SparkSession, path: str, assertions: list[Callable], requires_register: Callable) -> tuple[int, str]:
    """Exit code and output; any error gives (1, "")."""
    try:
        return 0, check_request(read_request(spark, path), assertions, requires_register)
    except Exception:
        return 1, ""
