"""Records, evidence, output guards, resumable steps and sizing rules around the engine's tables."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from .contracts import RUN_ID, canonical_json, canonical_sha256, row_identity

#: Names that would put rows into a manifest.
ROW_FIELDS = frozenset({"rows", "records", "values", "predictions", "targets", "sample", "data"})


class ContractError(ValueError):
    """A record, path or table that breaks a contract."""


def output_guard(path: str | Path, protected: Iterable[str | Path] = (), inputs: Iterable[str | Path] = (), allowed: Iterable[str | Path] = (), overwrite: bool = False) -> Path:
    """``path`` resolved, if it may be written.

    Not below a protected folder, not one of the inputs, below an allowed root where any are given,
    and new unless ``overwrite``.
    """
    out = Path(path).resolve()
    if any(out.is_relative_to(Path(p).resolve()) for p in protected):
        raise ContractError(f"protected folder: {out}")
    if out in {Path(p).resolve() for p in inputs}:
        raise ContractError(f"an input: {out}")
    roots = [Path(p).resolve() for p in allowed]
    if roots and not any(out.is_relative_to(r) for r in roots):
        raise ContractError(f"outside the allowed folders: {out}")
    if out.exists() and not overwrite:
        raise ContractError(f"there already: {out}")
    return out


def row_free(value, where: str = "") -> None:
    """Raise if a manifest holds rows: a field of such a name with a list, or a list of objects or over 64 long."""
    if isinstance(value, Mapping):
        for key, x in value.items():
            if str(key).lower() in ROW_FIELDS and isinstance(x, (list, tuple, Mapping)):
                raise ContractError(f"rows in a manifest: {where}/{key}")
            row_free(x, f"{where}/{key}")
    elif isinstance(value, (list, tuple)):
        if len(value) > 64 or any(isinstance(x, (Mapping, list, tuple)) for x in value):
            raise ContractError(f"rows in a manifest: {where}")


def write_manifest(path: str | Path, structural: Mapping, volatile: Mapping | None = None, **guards) -> str:
    """Write facts without rows; return the hash of the structural ones, which reruns must reproduce."""
    from ..sources.files import write_json

    row_free(structural)
    row_free(volatile or {})
    out = output_guard(path, **guards)
    out.parent.mkdir(parents=True, exist_ok=True)
    digest = canonical_sha256(structural)
    write_json({"structural": structural, "structural_sha256": digest, "volatile": volatile or {}}, str(out))
    return digest


def check_config(value: Mapping, shape: Mapping) -> None:
    """``value`` has the keys of ``shape`` and no more, with its types; nested shapes are mappings."""
    if set(value) != set(shape):
        raise ContractError(f"keys differ: {sorted(map(str, set(value) ^ set(shape)))}")
    for key, kind in shape.items():
        if isinstance(kind, Mapping):
            if not isinstance(value[key], Mapping):
                raise ContractError(f"{key} must be a mapping")
            check_config(value[key], kind)
        elif not isinstance(value[key], kind) or (isinstance(value[key], bool) and kind is not bool):
            raise ContractError(f"{key} has the wrong type")


def record_violations(record: Mapping[str, str], fields: list[str], required: Iterable[str], json_fields: Iterable[str] = (), numbers: Iterable[str] = (), decisions: Iterable[str] = (), protected: str = "data/raw") -> list[str]:
    """What is wrong with an experiment record, all at once; an empty list if nothing is."""
    out = []
    if list(record) != fields:
        out.append("fields")
    out += [f"blank {f}" for f in required if not str(record.get(f, "")).strip()]
    if not re.match(RUN_ID, record.get("run_id", "")):
        out.append("run_id")
    try:
        zone = dt.datetime.fromisoformat(record.get("run_date_utc", "")).utcoffset()
        out += [] if zone == dt.timedelta(0) else ["run_date_utc"]
    except ValueError:
        out.append("run_date_utc")
    if not re.fullmatch(r"[+-]?[0-9]+", record.get("seed", "").strip()):
        out.append("seed")
    if decisions and record.get("decision") not in set(decisions):
        out.append("decision")
    parsed = {}
    for f in json_fields:
        try:
            parsed[f] = json.loads(record.get(f) or "null")
        except ValueError:
            out.append(f"json {f}")
    for f in numbers:
        text = record.get(f, "").strip()
        try:
            out += [] if not text or math.isfinite(float(text)) else [f"number {f}"]
        except ValueError:
            out.append(f"number {f}")
    for p in parsed.get("artifact_paths") or []:
        parts = PurePosixPath(str(p).replace("\\", "/")).parts
        if not isinstance(p, str) or not parts or parts[0] == "/" or parts[0].endswith(":") or ".." in parts or "/".join(parts).lower().startswith(protected):
            out.append(f"path {p}")
    return out


def nested_report(rows: DataFrame) -> dict:
    """A sliced report (family, label, n, rmse) as nested maps; ``spei`` families nest by column."""
    out: dict = {}
    for r in rows.select("family", "label", "n", "rmse").collect():  # one row for each slice
        cell = {"count": r.n, "rmse": r.rmse}
        if r.family == "pooled":
            out["pooled"] = cell
        elif r.family.startswith("spei"):
            out.setdefault("spei", {}).setdefault(r.family, {})[r.label] = cell
        else:
            out.setdefault(r.family, {})[r.label] = cell
    return out


def evidence_facts(reports: DataFrame) -> DataFrame:
    """What sliced reports (run_id, family, label, n, rmse) say of each run: run_id, fact, value.

    The pooled error and rows; of each other family the rows over its slices, which must add up to the
    pooled ones, and how many slices it lists.
    """
    pooled = F.col("family") == "pooled"
    sums = reports.groupBy("run_id", "family").agg(F.sum("n").cast("double").alias("rows"), F.count("*").cast("double").alias("slices"), F.max("rmse").alias("rmse"))
    facts = F.when(pooled, F.array(F.struct(F.lit("rmse").alias("fact"), F.col("rmse").alias("value")), F.struct(F.lit("rows").alias("fact"), F.col("rows").alias("value")))).otherwise(
        F.array(F.struct(F.concat("family", F.lit(" rows")).alias("fact"), F.col("rows").alias("value")), F.struct(F.concat("family", F.lit(" slices")).alias("fact"), F.col("slices").alias("value")))
    )
    return sums.select("run_id", F.inline(facts))


def evidence_mismatches(records: DataFrame, reports: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Facts in which records (run_id, fact, value) and reports differ, or that one side lacks.

    One full join of two tables: run_id, fact, recorded, reported. No rows: the evidence holds.
    """
    both = records.select("run_id", "fact", F.col("value").alias("recorded")).join(evidence_facts(reports).withColumnRenamed("value", "reported"), ["run_id", "fact"], "full")
    close = F.abs(F.col("recorded") - F.col("reported")) <= tolerance * F.abs(F.col("recorded"))
    return both.where(~F.coalesce(close & C.finite("recorded") & C.finite("reported"), F.lit(False)))


def resumable(spark: SparkSession, path: str, identity: str, build: Callable[[], DataFrame], columns: list[str], expected_rows: int | None = None) -> DataFrame:
    """The table at ``path`` if a step with this ``identity`` left it whole, else ``build()`` written there.

    ``path``_manifest, written last, holds the step's identity, the row count and an order-free hash
    of ``columns``. What is there must match it: a table that differs, or one without a manifest, raises.
    """
    manifest = f"{path.rstrip('/')}_manifest"
    schema = "identity string, n long, rows string"

    def facts(df: DataFrame):
        r = row_identity(df, columns).first()
        if expected_rows is not None and r.n != expected_rows:
            raise ContractError(f"{r.n} rows in place of {expected_rows}")
        return (identity, r.n, r.identity)

    if _exists(spark, manifest):
        found = tuple(spark.read.schema(schema).json(manifest).first())
        table = spark.read.parquet(path)
        if found != facts(table):
            raise ContractError(f"not what its manifest says: {path}")
        return table
    if _exists(spark, path):
        raise ContractError(f"no manifest beside {path}")
    build().write.mode("errorifexists").parquet(path)
    table = spark.read.parquet(path)
    spark.createDataFrame([facts(table)], schema).coalesce(1).write.json(manifest)
    return table


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def describe(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def cast_losses(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """For each declared column: values that are there but that its declared type can't hold. One pass, one row."""
    return df.agg(*(F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast(t).isNull()).alias(c) for c, t in declared.items()))


def lossless_types(df: DataFrame, declared: Mapping[str, str]) -> dict[str, str]:
    """The declared type of each column whose values it holds all, the present type of the others."""
    known = {c: t for c, t in declared.items() if c in df.columns}
    lost = cast_losses(df, known).first().asDict() if known else {}
    return {c: known[c] if c in known and not lost[c] else t for c, t in df.dtypes}


def profile_differences(a: Mapping, b: Mapping) -> dict[str, tuple]:
    """Facts in which two integrity profiles differ."""
    return {k: (a.get(k), b.get(k)) for k in sorted(set(a) | set(b)) if a.get(k) != b.get(k)}


def require_features(df: DataFrame, expected: list[str]) -> DataFrame:
    """``df`` cut to the allowed features, in their order; repeated or absent ones raise."""
    if len(set(expected)) != len(expected) or not set(expected) <= set(df.columns):
        raise ContractError(f"features: {sorted(set(expected) - set(df.columns)) or 'repeated'}")
    return df.select(*expected)


def training_bytes(rows: int, columns: int, copies: int = 3) -> int:
    """Projected peak of a single-machine boosted fit: 4-byte features, a 4-byte label, an 8-byte weight, in copies."""
    return rows * (columns * 4 + 4 + 8) * copies


def joined_reports(profiles: Mapping[str, Mapping], facts: Mapping[str, Mapping]) -> dict:
    """Profiles with their files' facts beside them, whether line counts agree, ratios and total bytes."""
    out = {}
    for name, profile in profiles.items():
        own = facts.get(name, {})
        lines = own.get("line_feeds")
        sizes = profile.get("csv_bytes"), profile.get("parquet_bytes")
        out[name] = {**profile, "facts": dict(own), "rows_match_lines": lines is not None and lines - 1 == profile.get("n_rows"), "size_ratio": sizes[0] / sizes[1] if all(sizes) else None}
    return {"datasets": out, "parquet_bytes": sum(p.get("parquet_bytes") or 0 for p in profiles.values())}


def id_relationship(a: DataFrame, b: DataFrame) -> DataFrame:
    """How two (ordinal, id) tables relate: same count, same ids in the same order, each id once on both sides."""
    one, two = (df.groupBy("id").agg(F.count("*").alias(f"n_{s}"), F.min("ordinal").alias(f"o_{s}")) for df, s in ((a, "a"), (b, "b")))
    both = one.join(two, "id", "full")
    once = F.coalesce(F.bool_and(F.col("n_a").eqNullSafe(1) & F.col("n_b").eqNullSafe(1)), F.lit(True))
    return both.agg(
        F.coalesce(F.sum("n_a"), F.lit(0)).eqNullSafe(F.coalesce(F.sum("n_b"), F.lit(0))).alias("same_count"),
        F.coalesce(F.bool_and(F.col("o_a").eqNullSafe(F.col("o_b"))), F.lit(True)).alias("same_order"),
        once.alias("each_once"),
    )


def run_audit(config: str, shape: Mapping, tables: Callable[[Mapping], dict[str, DataFrame]], path: str | Path, listed: int = 1_000, **guards) -> dict:
    """Parse a strict configuration, check each summary table, and write the manifest.

    ``tables(config)`` gives summaries by name (a row for each fold or so). Columns that start
    with ``bad_`` or ``missing`` must be 0 in every row; executors count those that are not. A manifest
    lists the rows of a summary, or for more than ``listed`` rows their number and identity. Returns
    the facts and their structural hash.
    """
    from ..sources.files import strict_yaml

    settings = strict_yaml(config)
    check_config(settings, shape)
    facts: dict = {}
    for name, df in tables(settings).items():
        checks = [c for c in df.columns if c.startswith(("bad_", "missing"))]
        counts = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).cast("double") != 0).alias(c) for c in checks)).first()
        if broken := [c for c in checks if counts[c]]:
            raise ContractError(f"{name}: {broken}")
        if counts["n"] > listed:
            whole = row_identity(df, df.columns).first()
            facts[name] = {"n": whole.n, "identity": whole.identity}
            continue
        for i, r in enumerate(sorted((x.asDict() for x in df.collect()), key=str)):
            facts[f"{name}.{i}"] = {c: v if isinstance(v, (bool, int, float, str, type(None))) else str(v) for c, v in r.items()}
    digest = write_manifest(path, {"config_sha256": canonical_sha256(json.loads(json.dumps(settings, default=str))), "facts": facts}, **guards)
    return {"facts": facts, "structural_sha256": digest, "canonical": canonical_json(facts)}
