"""Predicates and normal forms for stored values, file names and keys."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestry.functions.urls import canonical, trimmed

# Closed sets of the data model.
RUN_TYPES = ("QUICK_SCRAPE", "TEST_RUN", "DISCOVERY_PREVIEW", "PRODUCTION_RUN")
RUN_STATUSES = ("QUEUED", "RUNNING", "SUCCEEDED", "PARTIAL_RESULT", "FAILED", "CANCELLED")
SOURCE_STATUSES = ("ACTIVE", "ARCHIVED", "TRASHED")
VERSION_STATES = ("DRAFT", "PUBLISHED")
SETTING_STATES = ("INHERIT", "CUSTOM", "RESET_TO_BUILT_IN")
SETTING_SCOPES = ("GLOBAL", "COLLECTION", "CRAWLER", "RUN_PROFILE")
RECORD_STATES = ("DRAFT", "NEW_CANDIDATE", "UPDATED_CANDIDATE", "APPROVED", "REJECTED", "MISSING_CANDIDATE", "DELETED", "RESTORED_CANDIDATE", "SUPERSEDED")
REVIEW_STATES = ("OPEN", "CLOSED", "CLOSED_WITH_UNRESOLVED_ITEMS", "REOPENED")
ASSET_STATUSES = ("URL_ONLY", "DOWNLOADING", "DOWNLOADED", "FAILED", "BLOCKED")
ERROR_CODES = ("SCHEMA_DRIFT", "AMBIGUOUS_PAGE_TYPE", "UNRESOLVED_REFERENCE", "STORAGE_CRITICAL", "CRAWLER_UNAVAILABLE", "VALIDATION_ERROR", "CONFLICT", "NOT_FOUND", "ACCESS_DENIED", "CRAWLER_TIMEOUT")
SECRET_WORDS = ("secret", "token", "password", "credential", "api_key", "authorization")
RESERVED_NAMES = "CON|PRN|AUX|NUL|(COM|LPT)[1-9]"


def is_blank(text: Column) -> Column:
    """True for null, and for nothing but white space of any script."""
    return F.coalesce(trimmed(text) == "", F.lit(True))


def is_env_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Z_][A-Z0-9_]*\z"), F.lit(False))


def is_secret_key(key: Column) -> Column:
    return F.coalesce(F.lower(key).rlike("|".join(SECRET_WORDS)), F.lit(False))


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-fA-F]{64}\z"), F.lit(False))


def setting_is_consistent(state: Column, value: Column) -> Column:
    """A value is there exactly where the state says custom."""
    return F.coalesce(state.isin(*SETTING_STATES) & ((state == "CUSTOM") == value.isNotNull()), F.lit(False))


def _holds_secret(value) -> bool:
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                if not k.strip() or any(w in k.lower() for w in SECRET_WORDS):
                    return True
                todo.append(v)
        elif isinstance(x, list):
            todo += x
        elif isinstance(x, str) and x.startswith("Bearer "):
            return True
    return False


@F.pandas_udf(T.BooleanType())
def json_holds_secret(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a JSON text has a secret-shaped key at any depth or a bearer value; null for what is not JSON."""

    def one(text):
        try:
            return None if text is None else _holds_secret(json.loads(text))
        except ValueError:
            return None

    for v in values:
        yield v.map(one)


@F.pandas_udf(T.StringType())
def canonical_json(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON with keys in order at every depth and no spaces; null for what is not JSON."""

    def one(text):
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    for v in values:
        yield v.map(one)


def file_name(name: Column) -> Column:
    """A name that is safe in a folder; null where none can be made of it."""
    base = F.upper(F.split_part(name, F.lit("."), F.lit(1)))
    bad = (name == "") | name.isin(".", "..") | name.rlike(r"[/\\]") | base.rlike(rf"^({RESERVED_NAMES})\z")
    return F.when(~bad, F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"))


def relative_path(path: Column) -> Column:
    """A path below a root, without single dots; null if it is absolute or climbs."""
    parts = F.split(path, "/")
    bad = (path == "") | path.startswith("/") | path.rlike(r"^[A-Za-z]:|\\") | F.exists(parts, lambda p: p == "..")
    return F.when(~bad, F.array_join(F.filter(parts, lambda p: (p != ".") & (p != "")), "/"))


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return trimmed(F.regexp_replace(text, r"\p{IsWhite_Space}+", " "))


def number(text: Column, decimal: str = ".", group: str = ",") -> Column:
    """A decimal in the given notation; null for anything else, currency and unit signs included."""
    plain = F.replace(F.replace(trimmed(text), F.lit(group), F.lit("")), F.lit(decimal), F.lit("."))
    return F.when(trimmed(text).rlike(r"^[+-]?[0-9][0-9.,'\s]*\z"), F.expr("null").cast("decimal(38,9)") if decimal == group else plain.try_cast("decimal(38,9)"))


def boolean(text: Column, true: tuple[str, ...] = ("true", "yes", "1"), false: tuple[str, ...] = ("false", "no", "0")) -> Column:
    t = F.lower(trimmed(text))
    return F.when(t.isin(*true), True).when(t.isin(*false), False)


def timestamp(text: Column, format_: str) -> Column:
    return F.try_to_timestamp(trimmed(text), F.lit(format_))


#: Normal forms of a key's parts.
KEY_STEPS = {"trim": trimmed, "lower": F.lower, "upper": F.upper, "squeeze": squeezed, "url": canonical}


def key(*parts: tuple[Column, tuple[str, ...]], empty: str = "null") -> Column:
    """A composite key as one text; its parts normalized in order. An empty part makes the key null, or stays (empty='keep')."""
    out = []
    for column, steps in parts:
        for step in steps:
            column = KEY_STEPS[step](column)
        out.append(column.cast("string"))
    if empty == "null":
        missing = F.lit(False)
        for c in out:
            missing = missing | F.coalesce(c == "", F.lit(True))
        return F.when(~missing, F.concat_ws("\x1f", *out))
    return F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in out])


def error(code: str, message: Column, details: Column | None = None, recoverable: bool = True, actions: tuple[str, ...] = (), trace: Column | None = None) -> Column:
    """The envelope of a problem, for rows of violations."""
    if code not in ERROR_CODES:
        raise ValueError(f"no error code {code!r}")
    return F.struct(
        F.lit(code).alias("code"), message.alias("message"), (details if details is not None else F.lit(None).cast("string")).alias("details"), F.lit(recoverable).alias("recoverable"),
        F.array(*[F.lit(a) for a in actions]).cast("array<string>").alias("suggested_actions"), (trace if trace is not None else F.lit(None).cast("string")).alias("trace_id"),
    )


def conflict(message: Column) -> Column:
    return error("CONFLICT", message)


def broken(**constraints: Column) -> Column:
    """Names of the constraints that a row breaks, in the order given; one that is unknown for a null is kept, as in SQL."""
    return F.filter(F.array(*[F.when(~c, F.lit(name)) for name, c in constraints.items()]), lambda x: x.isNotNull())
