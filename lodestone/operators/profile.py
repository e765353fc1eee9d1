"""Guarded value profiles: values are counted for fields that may be shown, all others give aggregates only.

A task keeps a mergeable state of each field: figures and an exact set of values that saturates, and is given up, beyond the
distinct limit. Only states are shuffled: a task's are as large as the limit, whatever the number of values.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the gate.
DEFAULT_DISTINCT, MOST_DISTINCT, SMALL_CELL = 100, 10_000, 5
NEVER = frozenset({"direct_identifier", "source_structure", "opaque_payload", "access_control_metadata"})
SUPPRESSED = frozenset({"quasi_identifier", "linkage_key"})
TAGS = NEVER | SUPPRESSED | {"measure", "free_text"}
SENSITIVITIES = frozenset({"public", "internal", "confidential", "restricted"})


class ProfileError(ValueError):
    """A profile declaration that can't be used."""


@dataclass(frozen=True)
class ProfileField:
    name: str
    safe: bool = False
    sensitivity: str = ""
    tags: frozenset[str] = frozenset()

    @property
    def enumerable(self) -> bool:
        """Values are shown only for fields that are declared safe, are public or internal, and have no identifying tag."""
        return self.safe and self.sensitivity in ("public", "internal") and not self.tags & NEVER

    @property
    def small_cells(self) -> bool:
        return bool(self.tags & SUPPRESSED)


@dataclass(frozen=True)
class ProfileConfig:
    fields: tuple[ProfileField, ...]
    max_distinct: int = DEFAULT_DISTINCT
    small_cell: int = SMALL_CELL

    @classmethod
    def of(cls, raw: dict) -> ProfileConfig:
        """A declaration, checked and with defaults."""
        fields = []
        for f in raw.get("fields") or ():
            name, tags, level = str(f.get("field") or "").strip(), frozenset(f.get("protection_tags") or ()), str(f.get("sensitivity") or "").strip().lower()
            if not name or (level and level not in SENSITIVITIES) or tags - TAGS:
                raise ProfileError(f"bad profile field {f!r}")
            fields.append(ProfileField(name, bool(f.get("safe_to_profile")), level, tags))
        if len({f.name for f in fields}) < len(fields):
            raise ProfileError("a field is profiled twice")
        most, cell = int(raw.get("max_distinct") or DEFAULT_DISTINCT), int(raw.get("small_cell_threshold") or SMALL_CELL)
        if not 0 < most <= MOST_DISTINCT or cell < 2:
            raise ProfileError("max_distinct or small_cell_threshold out of range")
        return cls(tuple(fields), most, cell)


STATE = "field string, count long, nulls long, len_min long, len_max long, len_sum long, n long, numeric boolean, low double, high double, code boolean, dated boolean, capped boolean, vals map<string,long>"
_CODE, _DATE = re.compile(r"[A-Z0-9_-]+\Z"), re.compile(r"\d{4}-\d{2}-\d{2}")


def _number(text: str) -> float | None:
    try:
        return None if "_" in text else float(text)
    except ValueError:
        return None


class FieldState:
    """What a task knows of a field; ``observe`` takes the distinct texts of a batch with their counts."""

    def __init__(self, limit: int) -> None:
        self.limit, self.count, self.nulls = limit, 0, 0
        self.len_min, self.len_max, self.len_sum = None, None, 0
        self.low, self.high, self.numeric, self.code, self.dated, self.capped = None, None, True, True, True, False
        self.vals: dict[str, int] = {}

    def observe(self, texts: pa.Array) -> None:
        self.count += len(texts)
        for text, n in zip(*(c.to_pylist() for c in pc.value_counts(texts).flatten()), strict=True) if len(texts) else ():
            if not text:  # an empty text is as good as none
                self.nulls += n
                continue
            size, number = len(text.encode("utf-8", "surrogatepass")), _number(text)
            self.len_min, self.len_max, self.len_sum = min(size, self.len_min or size), max(size, self.len_max or 0), self.len_sum + n * size
            if number is None:
                self.numeric = False
            elif not math.isnan(number):
                self.low, self.high = number if self.low is None else min(self.low, number), number if self.high is None else max(self.high, number)
            self.code, self.dated = self.code and bool(_CODE.match(text)), self.dated and bool(_DATE.match(text))
            if not self.capped:
                self.vals[text] = self.vals.get(text, 0) + n
                if len(self.vals) > self.limit:
                    self.capped, self.vals = True, {}

    def row(self, name: str) -> dict:
        return {"field": name, "count": self.count, "nulls": self.nulls, **{k: getattr(self, k) for k in ("len_min", "len_max", "len_sum")}, "n": self.count - self.nulls, **{k: getattr(self, k) for k in ("numeric", "low", "high", "code", "dated", "capped", "vals")}}


def texts_of(types: dict[str, str], config: ProfileConfig, of=F.col) -> list[Column]:
    """The fields' values as text: numbers without a fraction where whole, nested values as JSON, fields that aren't there null."""
    out = []
    for f in config.fields:
        t = types.get(f.name)
        c = F.lit(None).cast("string") if t is None else of(f"`{f.name}`")
        if t in ("double", "float"):
            c = F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
        elif t is not None and t.startswith(("array", "struct", "map")):
            c = F.to_json(c)
        out.append(c.cast("string"))
    return out


def states(df: DataFrame, config: ProfileConfig) -> DataFrame:
    """A state of each field from each task that has rows."""
    names = [f.name for f in config.fields]
    arrow = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "map<string,long>": pa.map_(pa.string(), pa.int64())}
    schema = pa.schema([(c.split()[0], arrow[c.split()[1]]) for c in STATE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = [FieldState(config.max_distinct) for _ in names]
        for b in batches:
            for k, s in enumerate(held):
                s.observe(b.column(k))
        rows = [s.row(n) | {"vals": list(s.vals.items())} for n, s in zip(names, held, strict=True) if s.count]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    texts = texts_of(dict(df.dtypes), config)
    return df.select(*(c.alias(f"_{k}") for k, c in enumerate(texts))).mapInArrow(run, STATE)


def states_as_json(held: dict[str, FieldState]) -> str:
    return json.dumps([s.row(n) for n, s in held.items()])


def states_from_json(column: str) -> Column:
    """The states that :func:`states_as_json` wrote, one a row."""
    return F.explode(F.from_json(column, f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in STATE.split(', '))}>>"))


def _merged(held: DataFrame, config: ProfileConfig) -> tuple[DataFrame, DataFrame]:
    """(figures by field, counts by field and value where no task has given them up)."""
    values = held.where("not capped").select("field", F.explode("vals").alias("value", "n")).groupBy("field", "value").agg(F.sum("n").alias("n"))
    d = values.groupBy("field").agg(F.count("*").alias("d"))
    agg = held.groupBy("field").agg(
        F.sum("count").alias("count"), F.sum("nulls").alias("nulls"), F.min("len_min").alias("len_min"), F.max("len_max").alias("len_max"), (F.sum("len_sum") / F.nullif(F.sum("n"), F.lit(0))).alias("len_mean"),
        F.bool_and("numeric").alias("numeric"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and("code").alias("code"), F.bool_and("dated").alias("dated"), F.bool_or("capped").alias("over"), F.sum("n").alias("n"),
    )
    agg = agg.join(d, "field", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    return agg.withColumn("over", F.col("over") | (F.col("d") > config.max_distinct)), values


def value_counts(df: DataFrame, config: ProfileConfig) -> DataFrame:
    """Tier A: (field, value, n) of the enumerable fields under the distinct limit; small cells are left out where tagged."""
    return counts_of(states(df, config), config)


def counts_of(held: DataFrame, config: ProfileConfig) -> DataFrame:
    agg, values = _merged(held, config)
    shown = [f.name for f in config.fields if f.enumerable]
    small = [f.name for f in config.fields if f.small_cells]
    over = agg.where("over").select(F.col("field").alias("_f"))  # a row a field at most
    kept = values.where(F.col("field").isin(shown)).join(F.broadcast(over), F.col("field") == F.col("_f"), "left_anti")
    return kept.where(~F.col("field").isin(small) | (F.col("n") >= config.small_cell)) if small else kept


def profile(df: DataFrame, config: ProfileConfig) -> DataFrame:
    """One row per field: tier, status, count, nulls, distinct (text where capped or small), lengths in bytes, range, shape.

    An empty table gives a row per field with zero counts; empty texts count as nulls.
    """
    return profile_of(states(df, config), config)


def profile_of(held: DataFrame, config: ProfileConfig) -> DataFrame:
    """The profile of states, wherever they were kept."""
    agg, _ = _merged(held, config)
    gate = held.sparkSession.createDataFrame([(f.name, f.enumerable, f.small_cells, bool(f.tags & {"source_structure", "direct_identifier"})) for f in config.fields], "field string, open boolean, small boolean, opaque boolean")
    j = gate.join(agg, "field", "left").withColumns({"count": F.coalesce("count", F.lit(0)), "nulls": F.coalesce("nulls", F.lit(0)), "d": F.coalesce("d", F.lit(0)), "over": F.coalesce("over", F.lit(False)), "n": F.coalesce("n", F.lit(0))})
    capped = F.col("over")
    a = F.col("open") & ~capped
    shape = F.when(F.col("opaque"), "opaque_string").when(F.col("n") == 0, "freeform").when(F.col("numeric"), "all_numeric").when(F.col("dated"), "date_like").when(F.col("code"), "code_like").otherwise("freeform")
    return j.select(
        "field", F.when(a, "enumeration").otherwise("aggregates").alias("tier"), F.when(capped, F.lit("high_cardinality_capped")).otherwise("complete").alias("status"), "count", "nulls",
        F.when(capped, F.lit(f">={config.max_distinct}")).when(~a & F.col("small") & (F.col("d") > 0) & (F.col("d") < config.small_cell), F.lit(f"<{config.small_cell}")).otherwise(F.col("d").cast("string")).alias("distinct"),
        *(F.when(~a, F.col(c)).alias(c) for c in ("len_min", "len_max", "len_mean")),
        *(F.when(a & F.col("numeric"), F.col(c)).alias(c) for c in ("low", "high")),
        F.when(~a, shape).alias("shape"),
    )


def report(held: DataFrame, config: ProfileConfig) -> dict:
    """The profile for a manifest: a row for each field, with the values that may be shown (at most the distinct limit of each)."""
    shown: dict[str, dict[str, int]] = {}
    for r in counts_of(held, config).collect():
        shown.setdefault(r["field"], {})[r["value"]] = r["n"]
    rows = [r.asDict() for r in profile_of(held, config).collect()]
    return {r["field"]: {k: v for k, v in r.items() if v is not None and k != "field"} | ({"values": dict(sorted(shown.get(r["field"], {}).items()))} if r["tier"] == "enumeration" else {}) for r in sorted(rows, key=lambda r: r["field"])}


def run_profile(e) -> dict | None:
    """The profile that an extraction's recipe asks for, over the records of applied inputs; None where it asks for none."""
    if not e.recipe.value_profile:
        return None
    config = ProfileConfig.of(e.recipe.value_profile)
    return report(states(e.records.select("data.*"), config), config)
