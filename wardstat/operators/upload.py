"""Uploaded tables of unknown shape: role mapping and the target flag.

Role mapping looks only at the schema (column names and types), so it
runs on the driver without touching data.  The mapped frame is an
ordinary projection of the input: no job is started until an action.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

# Name fragments that identify each role (matched as
# substrings of the lower-cased column name).
TARGET_CANDIDATES = ["test results", "admission type", "readmitted", "discharged", "status", "outcome"]
DISEASE_CANDIDATES = ["medical condition", "disease", "diagnosis", "condition", "illness"]
REGION_CANDIDATES = ["hospital", "region", "state", "city", "location", "ward"]
TIME_CANDIDATES = ["date of ad", "date", "year", "month", "timestamp", "admission"]

ROLE_NAMES = ("target", "disease", "region", "time_var")
# Output names the mapping owns: role columns and the derived flag.
RESERVED_NAMES = ROLE_NAMES + ("is_target",)


@dataclass(frozen=True)
class Roles:
    """Source column chosen for each role (``target`` may be None)."""
    target: str | None
    disease: str
    region: str
    time_var: str

    def as_dict(self) -> dict[str, str | None]:
        return {"target": self.target, "disease": self.disease,
                "region": self.region, "time_var": self.time_var}


def _first_match(columns: list[str], candidates: list[str]) -> str | None:
    """First column, in column order, whose lower-cased name contains any
    candidate.  Matching is by substring, so ``update`` matches ``date``."""
    for c in columns:
        lc = c.lower()
        if any(cand in lc for cand in candidates):
            return c
    return None


def find_roles(schema: T.StructType,
               target=TARGET_CANDIDATES, disease=DISEASE_CANDIDATES,
               region=REGION_CANDIDATES, time=TIME_CANDIDATES) -> Roles:
    """Pick a source column for each role.

    Fallbacks: no disease column -> first string column, else the first
    column; no region column -> the disease column; no time column -> the
    first column; no target -> None (target outputs are skipped).
    """
    cols = [f.name for f in schema.fields]
    if not cols:
        raise ValueError("table has no columns")
    d = _first_match(cols, disease)
    if d is None:
        d = next((f.name for f in schema.fields if isinstance(f.dataType, T.StringType)), cols[0])
    r = _first_match(cols, region) or d
    t = _first_match(cols, time) or cols[0]
    return Roles(target=_first_match(cols, target), disease=d, region=r, time_var=t)


def map_roles(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """Rename the role columns to ``target``/``disease``/``region``/``time_var``.

    A column that fills one role is renamed in place; when one column fills
    several roles (e.g. the disease column standing in for region), each
    further role gets a copy, so every role column exists.  Any other
    column already carrying a role name (or ``is_target``) is kept as
    ``<name>_src``, so it is never mistaken for a mapped role -- e.g. a
    column called ``target`` that matched no target candidate.
    """
    roles = roles or find_roles(df.schema)
    wanted = {role: src for role, src in roles.as_dict().items() if src is not None}
    renamed_in_place: dict[str, str] = {}
    copies: list[tuple[str, str]] = []
    for role in ROLE_NAMES:
        src = wanted.get(role)
        if src is None:
            continue
        if src not in renamed_in_place:
            renamed_in_place[src] = role
        else:
            copies.append((src, role))
    out = []
    for c in df.columns:
        if c in renamed_in_place:
            out.append(F.col(f"`{c}`").alias(renamed_in_place[c]))
        elif c.lower() in RESERVED_NAMES:
            out.append(F.col(f"`{c}`").alias(f"{c}_src"))
        else:
            out.append(F.col(f"`{c}`"))
    out += [F.col(f"`{src}`").alias(role) for src, role in copies]
    return df.select(*out)


def flag_target(df: DataFrame) -> DataFrame:
    """Adds ``is_target`` (double) when a ``target`` column exists.

    The path is chosen from the column's *type*: text is 1.0 when in the
    positive set, else 0.0 (NULL -> 0.0, so it counts in the mean); any
    other type is cast to double (NULL stays NULL, out of the mean;
    booleans become 1.0/0.0; bad values become NULL rather than failing).
    """
    if "target" not in df.columns:
        return df
    dtype = df.schema["target"].dataType
    if isinstance(dtype, T.StringType):
        return df.withColumn("is_target", S.flag_in_set("target"))
    return df.withColumn("is_target", S.cast_double("target"))


def prepare_upload(df: DataFrame) -> DataFrame:
    """``map_roles`` then ``flag_target``."""
    return flag_target(map_roles(df))


def check_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Data-quality report: one row per required column with ``present``
    and its count of non-null values (0 when absent), from one pass."""
    present = {c.lower(): c for c in df.columns}
    aggs = []
    for i, name in enumerate(required):
        src = present.get(name.lower())
        aggs.append((F.count(F.col(f"`{src}`")) if src else F.lit(0).cast("long")).alias(f"_c{i}"))
    counts = df.agg(*aggs)
    stacked = F.stack(F.lit(len(required)), *[x for i, name in enumerate(required)
                                              for x in (F.lit(name), F.lit(name.lower() in present),
                                                        F.col(f"_c{i}"))])
    return counts.select(stacked.alias("column", "present", "non_null_count"))


class MissingColumnsError(ValueError):
    """Raised by ``require_columns``; maps to the upload contract's exit
    code 2 ("Data Quality Check Failed. Missing required columns.")."""
    exit_code = 2


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Schema-only check; raises ``MissingColumnsError`` listing the missing
    columns, otherwise returns ``df`` unchanged."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in required if c.lower() not in have]
    if missing:
        raise MissingColumnsError(f"Missing required columns: {missing}")
    return df


class NotCsvError(ValueError):
    """An upload whose name does not end in ``.csv``."""


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """Read an uploaded CSV with header, inferring types (the columns of an
    upload are unknown by design).  Names not ending in ``.csv`` are
    rejected before anything is read."""
    if not path.endswith(".csv"):
        raise NotCsvError("Only CSV files are allowed")
    return spark.read.csv(path, header=True, inferSchema=True)
