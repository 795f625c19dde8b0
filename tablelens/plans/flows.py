"""End-to-end compositions: validation, analysis, gated run, all-in-one flow.

Each returns a dict of lazy DataFrames (plus a few driver-side facts such as
the resolved roles). The cleaned table is checkpointed once in the shared
checkpoint folder because KPIs, drivers, quality diff and chart data all
re-read it; everything else stays lazy until a sink or `collect()`.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from tablelens.functions.constants import FLOW_ID_NAMES
from tablelens.operators import cleaning, columns, insight, profile, quality, roles, timeseries
from tablelens.session import materialize
from tablelens.sources import writers


# ------------------------------------------------------------------- A17 --

def validate(
    df: DataFrame,
    id_hint: str | None = None,
    ts_hint: str | None = None,
    value_hint: str | None = None,
) -> dict:
    """Summary, role guesses, timestamp parse, missingness, column profile,
    duplicates, outliers and suggested actions."""
    guess = roles.guess_roles(list(df.columns), id_hint, ts_hint, value_hint)
    id_col, ts_col = guess["id"], guess["ts"]
    work = df
    out: dict = {"roles": guess, "summary": profile.table_summary(df)}
    if ts_col:
        out["parse"] = columns.parse_report(df, ts_col)
        work = columns.parse_dates(df, [ts_col])
    out["missingness"] = profile.missingness(work)
    out["profile"] = profile.column_profile(work)
    out["duplicates"] = profile.duplicate_counts(work, id_col, ts_col)
    out["outliers"] = profile.numeric_outliers(work)
    out["actions"] = profile.validation_actions(
        out["missingness"], out["duplicates"], out["outliers"], id_col, ts_col
    )
    return out


# -------------------------------------------------------------------- I4 --

def analyze(
    df: DataFrame,
    out: str | None = None,
    save_table: str | None = None,
    bins: int = 50,
    top_n: int = 20,
    mapped: tuple[DataFrame, dict] | None = None,
) -> dict:
    """auto-map → clean → business casts → KPIs → drivers → quality diff →
    takeaways → chart data; with `out`, also writes the cleaned table (CSV and
    Parquet), the drivers and the schema report under that folder. `mapped` is
    the result of `auto_map`, if a caller has it already."""
    mapped, mapping = mapped or roles.auto_map(df)
    id_col, ts_col, value_col = mapping.get("entity_id"), mapping.get("event_ts"), mapping.get("value")
    # keys are names, not measures: clipping them would merge and shift ids
    keys = [c for c in ("order_id", id_col) if c and c in mapped.columns]
    cleaned, report = cleaning.clean(mapped, id_col=id_col, ts_col=ts_col, exclude=keys)
    cleaned = materialize(cleaning.business_casts(cleaned))
    k = insight.kpis(cleaned, ts_col, value_col)
    drivers = insight.top_drivers(cleaned, ts_col, value_col)
    change = k.get("period_change")
    if change is None:
        change = cleaned.sparkSession.createDataFrame(
            [], "metric string, recent_4w double, prior_4w double, abs_change double, pct_change double"
        )
    result = {
        "mapping": mapping,
        "cleaned": cleaned,
        "clean_report": report,
        "kpis": k,
        "drivers": drivers,
        "quality_diff": quality.quality_diff(mapped, cleaned, id_col, ts_col),
        "takeaways": insight.takeaways(change, drivers),
        "charts": chart_data(cleaned, value_col, ts_col, bins, top_n),
    }
    if out:
        result["paths"] = {
            "clean_csv": writers.write_csv(cleaned, os.path.join(out, "clean_csv")),
            "clean_parquet": writers.write_parquet(cleaned, os.path.join(out, "clean_parquet")),
            "drivers": writers.write_drivers(drivers, os.path.join(out, "drivers")),
            "schema": writers.write_json(writers.schema_report(cleaned, mapping), os.path.join(out, "schema"), one_file=True),
        }
    if save_table:
        result["table"] = writers.save_table(cleaned, save_table, database="clean")
    return result


def chart_data(
    df: DataFrame, value_col: str | None, ts_col: str | None, bins: int = 50, top_n: int = 20,
    metric: str = "sum", freq: str = "W",
) -> dict[str, DataFrame]:
    """The data behind the four standard charts: missingness, histogram of the
    default numeric column, top categories of the default category column,
    and the time series of the default timestamp."""
    defaults = {r["kind"]: r["column"] for r in roles.default_columns(df, value_col).collect()}
    out = {"missingness": profile.missingness_series(df)}
    if defaults.get("numeric"):
        out["histogram"] = profile.histogram(df, defaults["numeric"], bins)
    if defaults.get("category"):
        out["top_categories"] = profile.top_categories(df, defaults["category"], top_n)
    ts = ts_col if ts_col in df.columns else defaults.get("timestamp")
    if ts:
        val = value_col if value_col in df.columns else defaults.get("numeric")
        qty = "quantity" if "quantity" in df.columns else None
        out["timeseries"] = timeseries.timeseries(df, ts, val, qty, metric, freq)
    return out


# -------------------------------------------------------------------- I5 --

def run_gated(df: DataFrame, force: bool = False, out: str | None = None) -> dict:
    """auto-map → PII scan → quality gate; stops on FAIL unless `force`,
    else runs `analyze`."""
    mapped, mapping = roles.auto_map(df)
    pii = quality.pii_scan(mapped)
    checks = quality.quality_checks(mapped, id_col=mapping.get("entity_id"), ts_col=mapping.get("event_ts"))
    gate = quality.quality_gate(checks).first()
    result = {"mapping": mapping, "pii": pii, "checks": checks, "passed": bool(gate["passed"])}
    if not gate["passed"] and not force:
        result["status"] = "stopped by quality gate"
        return result
    result["status"] = "completed"
    result["analysis"] = analyze(df, out=out, mapped=(mapped, mapping))
    return result


# -------------------------------------------------------------------- I6 --

def run_flow(
    df: DataFrame, bins: int = 50, top_n: int = 20, metric: str = "sum", freq: str = "W",
    out: str | None = None,
) -> dict:
    """Profile, column inference, chart data, gate, PII scan and analysis of
    one table."""
    facts = roles.column_facts(df)
    info = roles.infer_columns(df, facts)
    flags = {r["column"]: r for r in info.collect()}
    dts = [c for c in df.columns if flags[c]["is_datetime"]]
    defaults = {r["kind"]: r["column"] for r in roles.default_columns(df, facts=facts).collect()}
    ts = defaults.get("timestamp")
    value = "value" if "value" in df.columns and flags["value"]["is_numeric"] else defaults.get("numeric")
    id_guess = next((c for c in df.columns if c.lower() in FLOW_ID_NAMES), None)
    work = columns.parse_dates(df, dts) if dts else df
    checks = quality.quality_checks(work, id_col=id_guess, ts_col=ts)
    return {
        "summary": profile.table_summary(df),
        "missingness": profile.missingness(df),
        "profile": profile.column_profile(df),
        "columns": info,
        "charts": chart_data(work, value, ts, bins, top_n, metric, freq),
        "checks": checks,
        "gate": quality.quality_gate(checks),
        "pii": quality.pii_scan(df),
        # the facts of the raw table serve the role suggestions as well
        "analysis": analyze(df, out=out, mapped=roles.auto_map(df, facts=facts)),
    }


__all__ = ["validate", "analyze", "chart_data", "run_gated", "run_flow"]
