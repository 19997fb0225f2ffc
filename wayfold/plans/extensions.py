"""Own structurers and calibrators by name, for DataFrames and for SQL.

A calibrator is ``f(raw, field, country)`` of pandas series to a series; SQL
calls it as ``calibrate_<name>(raw, field, country)``. A structurer is a function of an
Arrow table of requests to an Arrow table with ``request_id, field, value,
raw_confidence``; SQL calls it as ``structure_<name>(table(requests))``. Both
run on batches where the rows are: a structurer reads its input's partitions,
without a join or an exchange. Structurers that are DataFrame functions (see
``sources.structurers``) are added by ``add`` and stay within Catalyst.

Names are those of the session: a name that is registered again is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import merge
from wayfold.plans.config import FIELDS
from wayfold.sources.structurers import CANDIDATE, Structurer, allowed, union_all

Calibrator = Callable[[pd.Series, pd.Series, pd.Series], pd.Series]
CANDIDATE_SCHEMA = pa.schema([("request_id", pa.int64()), ("structurer", pa.string()), ("field", pa.string()), ("pos", pa.int32()), ("value", pa.string()), ("raw_confidence", pa.float64())])


def _in_range(values: pd.Series) -> pd.Series:
    """Confidences from 0 to 1; what is no number is 0."""
    return pd.to_numeric(values, errors="coerce").astype("float64").replace([float("inf"), float("-inf")], float("nan")).fillna(0.0).clip(0.0, 1.0)


class Extensions:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.calibrators: dict[str, Calibrator] = {}
        self.structurers: dict[str, Structurer] = {}
        self.fields: dict[str, tuple[str, ...]] = {}

    def calibrator(self, name: str, f: Calibrator) -> None:
        """Register ``calibrate_<name>``."""

        def run(raw: pd.Series, field: pd.Series, country: pd.Series) -> pd.Series:
            return _in_range(f(raw, field, country))

        self.calibrators[name] = f
        self.spark.udf.register(f"calibrate_{name}", F.pandas_udf(run, "double"))

    def structurer(self, name: str, f: Callable[[pa.Table], pa.Table], fields: tuple[str, ...] = FIELDS) -> None:
        """Register ``structure_<name>``, which may fill ``fields``; values of other fields and blank ones go."""

        class Run:
            def eval(self, requests: pa.RecordBatch):
                found = f(pa.Table.from_batches([requests]) if isinstance(requests, pa.RecordBatch) else requests)
                n = found.num_rows
                columns = {"structurer": pa.array([name] * n, pa.string()), "pos": pa.array(range(n), pa.int32())}
                found = pa.table([columns.get(c.name, found[c.name] if c.name in found.column_names else None) for c in CANDIDATE_SCHEMA], schema=CANDIDATE_SCHEMA) if n else CANDIDATE_SCHEMA.empty_table()
                said = pc.not_equal(pc.utf8_trim_whitespace(found["value"]), "")
                yield found.filter(pc.fill_null(pc.and_(said, pc.is_in(found["field"], pa.array(fields, pa.string()))), False))

        schema = "request_id long, structurer string, field string, pos int, value string, raw_confidence double"
        own = F.arrow_udtf(Run, returnType=schema)
        self.spark.udtf.register(f"structure_{name}", own)
        self.structurers[name], self.fields[name] = (lambda requests: own(requests.asTable())), fields

    def add(self, name: str, f: Structurer, fields: tuple[str, ...] = FIELDS) -> None:
        """A structurer that is a DataFrame function."""
        self.structurers[name], self.fields[name] = (lambda requests: f(requests).withColumn("structurer", F.lit(name))), fields

    def candidates(self, requests: DataFrame, *names: str) -> DataFrame:
        """Candidates of the named structurers (of all, if none is named), in that order."""
        order = names or tuple(self.structurers)
        return allowed(union_all(*(self.structurers[n](requests).select(*CANDIDATE) for n in order), order=order), {n: self.fields[n] for n in order})

    def calibrate(self, candidates: DataFrame, by: dict[str, str], table: DataFrame) -> DataFrame:
        """``merge.calibrate``, but structurers in ``by`` (structurer to calibrator) have their confidence from their calibrator.

        Each row meets its own calibrator only, and rows of other structurers are not changed by any.
        """
        own = {s: self.calibrators[c] for s, c in by.items()}

        def run(structurer: pd.Series, raw: pd.Series, field: pd.Series, country: pd.Series, otherwise: pd.Series) -> pd.Series:
            out = otherwise.astype("float64").copy()
            for s, f in own.items():
                at = structurer == s
                if at.any():
                    out[at] = _in_range(f(raw[at], field[at], country[at]))
            return out

        rows = merge.calibrate(candidates, table)
        return rows.withColumn("confidence", F.pandas_udf(run, "double")("structurer", "raw_confidence", "field", "country", "confidence")) if own else rows
