"""Policy files: thresholds of the gates, and tenants with their currency cues. A file that is not whole is refused.

Files are read by Spark, so they may lie in any store it reads; they are settings of the driver, at most MAX_BYTES long. JSON
is read everywhere, YAML where its library is there.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 1 << 20
DATE_ORDERS = ("DMY", "MDY", "YMD")


@dataclass(frozen=True)
class Thresholds:
    """classes as `operators.itn.gated` takes them: least confidence of classifier and recogniser, cue needed, partials wait."""

    classes: dict[str, tuple[float, float, bool, bool]]
    stable_at: int
    partial_safe: tuple[str, ...]


@dataclass(frozen=True)
class Tenants:
    """rows as `operators.reporting.with_tenant` takes them, the default tenant first under the name `default`; cues as in `functions.languages`."""

    default: str
    rows: tuple[tuple[str, str, str, str], ...]
    cues: dict[str, tuple[tuple[str, ...], str, tuple[str, ...]]] = field(default_factory=dict)


def _loaded(spark: SparkSession, path: str) -> dict[str, Any]:
    found = spark.read.format("binaryFile").load(path).select("path", "length", F.when(F.col("length") <= MAX_BYTES, F.col("content")).alias("content")).head(2)
    if len(found) != 1 or found[0].content is None:
        raise ValueError(f"{path}: one file of at most {MAX_BYTES} bytes is expected")
    text = bytes(found[0].content).decode("utf-8")
    try:
        data = json.loads(text)
    except json.JSONDecodeError as wrong:
        try:
            import yaml
        except ImportError:
            raise ValueError(f"{path}: line {wrong.lineno}: {wrong.msg}") from None
        try:
            data = yaml.safe_load(text)
        except yaml.MarkedYAMLError as also:
            raise ValueError(f"{path}: line {also.problem_mark.line + 1 if also.problem_mark else '?'}: {also.problem}") from None
    if not isinstance(data, dict):
        raise ValueError(f"{path}: a table of settings is expected")
    return data


def _block(data: Any, key: str, where: str) -> dict[str, Any]:
    block = data.get(key)
    if block is None:
        return {}
    if not isinstance(block, dict):
        raise ValueError(f"{where}: {key} must be a table")
    return block


def read_thresholds(spark: SparkSession, path: str) -> Thresholds:
    """Every class needs all four settings: numbers from 0 to 1, and true or false."""
    data, classes = _loaded(spark, path), {}
    for name, own in _block(data, "classes", path).items():
        where = f"{path}: class {name!r}"
        if not isinstance(own, dict):
            raise ValueError(f"{where} must be a table")
        numbers, flags = [own.get(k) for k in ("classifier_min", "asr_min")], [own.get(k) for k in ("require_lex_cue", "defer_on_partial")]
        if any(isinstance(n, bool) or not isinstance(n, int | float) or not 0 <= n <= 1 for n in numbers):
            raise ValueError(f"{where}: classifier_min and asr_min must be from 0 to 1, not {numbers}")
        if any(not isinstance(f, bool) for f in flags):
            raise ValueError(f"{where}: require_lex_cue and defer_on_partial must be true or false, not {flags}")
        classes[str(name)] = (float(numbers[0]), float(numbers[1]), flags[0], flags[1])
    stream = _block(data, "streaming", path)
    stable, safe = stream.get("partial_stable_min"), stream.get("partial_safe_classes")
    if not classes or isinstance(stable, bool) or not isinstance(stable, int) or not isinstance(safe, list):
        raise ValueError(f"{path}: classes, streaming.partial_stable_min and streaming.partial_safe_classes are needed")
    return Thresholds(classes, stable, tuple(map(str, safe)))


def read_tenants(spark: SparkSession, path: str) -> Tenants:
    """Tenants with defaults filled in, and the locales that have currency cues; what a locale inherits is not read."""
    data = _loaded(spark, path)
    defaults, tenants = _block(data, "defaults", path), _block(data, "tenants", path)
    default = str(defaults.get("tenant", "default"))
    if default not in map(str, tenants):
        raise ValueError(f"{path}: defaults.tenant {default!r} is not among {sorted(map(str, tenants))}")
    rows = {}
    for name, own in tenants.items():
        own = own or {}
        order = str(own.get("date_order", defaults.get("date_order", "DMY")))
        if order not in DATE_ORDERS:
            raise ValueError(f"{path}: tenant {name!r}: unsupported date_order {order!r}; known: {list(DATE_ORDERS)}")
        rows[str(name)] = (str(own.get("region", "")), order, str(own.get("currency", defaults.get("currency", "INR"))))
    if default != "default" and "default" in rows:
        raise ValueError(f"{path}: the tenant `default` must be the default tenant")
    cues = {}
    for name, own in _block(data, "locales", path).items():
        block = (own or {}).get("currency_cues")
        if not block:
            continue
        if not block.get("accept") or not block.get("canonical"):
            raise ValueError(f"{path}: locale {name!r}: currency_cues needs `accept`, not empty, and `canonical`")
        cues[str(name)] = (tuple(map(str, block["accept"])), str(block["canonical"]), tuple(map(str, block.get("paise_accept") or [])))
    first = [("default", *rows[default])]
    return Tenants(default, tuple(first + [(n, *r) for n, r in rows.items() if n != "default"]), cues)
