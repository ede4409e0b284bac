"""Contracts of prediction tables, id order and identities."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as C

#: Canonical columns of a prediction row, and the mask states.
PREDICTION_COLUMNS = ("run_id", "fold_id", "location_id", "input_month", "target_month", "effective_horizon", "mask_state", "prediction", "validation_actual", "model_name", "configuration_id", "data_manifest_id", "validation_id")
PREDICTION_KEY = ("fold_id", "location_id", "input_month", "target_month")
COMPARABLE = ("fold_id", "location_id", "input_month", "target_month", "effective_horizon", "mask_state", "validation_actual")
MASK_STATES = ("observed", "masked/unavailable")
RUN_ID, SHA, LOCATION = r"^run-[a-z0-9][a-z0-9-]*$", r"^[0-9a-f]{64}$", r"^lat2=-?[0-9]+;lon2=-?[0-9]+$"


def prediction_violations(rows: DataFrame) -> DataFrame:
    """Counts of rows that break the prediction contract; all must be 0.

    A condition that a null leaves open is broken. Ids must have their form in every row, and what
    names a run must be one value over all rows. Without rows every count is 0.
    """
    holds = {
        "bad_calendar": C.target_month("input_month") == F.col("target_month"),
        "bad_horizon": F.col("effective_horizon").between(1, 7),
        "bad_mask": F.col("mask_state").isin(*MASK_STATES),
        "bad_prediction": C.finite("prediction"),
        "bad_actual": C.finite("validation_actual"),
        "bad_location": F.col("location_id").rlike(LOCATION),
        "bad_fold": F.length("fold_id") > 0,
        "bad_model": F.length("model_name") > 0,
        "bad_run_id": F.col("run_id").rlike(RUN_ID),
        **{f"bad_{c}": F.col(c).rlike(SHA) for c in ("configuration_id", "data_manifest_id", "validation_id")},
    }
    uniform = ("run_id", "model_name", "configuration_id", "data_manifest_id", "validation_id")
    return rows.agg(
        *(F.count_if(~F.coalesce(good, F.lit(False))).alias(name) for name, good in holds.items()),
        (F.count("*") - F.count_distinct(F.struct(*PREDICTION_KEY))).alias("duplicate_keys"),
        *(F.greatest(F.count_distinct(c) - F.lit(1), F.lit(0)).cast("bigint").alias(f"mixed_{c}") for c in uniform),
    )


def as_predictions(rows: DataFrame, run_id: str, configuration_id: str, manifest_id: str, validation_id: str) -> DataFrame:
    """Scored rows in the canonical columns and order."""
    fixed = {"run_id": run_id, "configuration_id": configuration_id, "data_manifest_id": manifest_id, "validation_id": validation_id}
    out = rows.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumns({"location_id": C.location_id(), "effective_horizon": F.col("horizon"), "mask_state": F.col("provenance"), "validation_actual": F.col("target")})
    return out.select(*PREDICTION_COLUMNS)


def row_identity(rows: DataFrame, columns: Iterable[str] = COMPARABLE) -> DataFrame:
    """An identity of a set of rows that no order changes: the sum of 60-bit row hashes, and their count.

    Doubles enter by their bits, never as text. Rows stay where they are; sums of hashes meet.
    """
    parts = [F.hex(F.xxhash64(c)) if t == "double" else F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c, t in rows.select(*columns).dtypes]
    digest = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return rows.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("identity"))


def ordered_digest(rows: DataFrame, columns: list[str], order: list[str]) -> str:
    """SHA-256 over length-prefixed values in order, streamed to the driver a partition at a time."""
    digest = hashlib.sha256()
    for row in rows.select(*columns, *(o for o in order if o not in columns)).orderBy(*order).toLocalIterator():
        for c in columns:
            value = row[c]
            raw = (value.hex() if isinstance(value, float) else str(value)).encode()
            digest.update(len(raw).to_bytes(8, "big") + raw)
    return digest.hexdigest()


def id_order_violations(official: DataFrame, candidate: DataFrame) -> DataFrame:
    """Compares (ordinal, id) tables: missing, extra, duplicate and displaced ids."""
    a, b = official.select("id", F.col("ordinal").alias("o")), candidate.groupBy("id").agg(F.count("*").alias("n"), F.min("ordinal").alias("c"))
    both = a.join(b, "id", "full")
    return both.agg(F.count_if(F.col("c").isNull()).alias("missing"), F.count_if(F.col("o").isNull()).alias("extra"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("o") != F.col("c")).alias("displaced"))


def canonical_json(value) -> str:
    """Sorted keys, no blanks; non-finite numbers are refused."""

    def check(x):
        if isinstance(x, float) and not math.isfinite(x):
            raise ValueError("numbers must be finite")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, (list, tuple)) else ():
            check(y)

    check(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_sha256(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def frozen(path, identity: dict) -> bool:
    """Write ``identity`` if ``path`` is new, else compare; False if they differ."""
    from pathlib import Path

    path, text = Path(path), canonical_json(identity)
    if not path.exists():
        path.write_text(text)
        return True
    return path.read_text() == text
