"""A change journal for tamper experiments: one table of changes for all kinds of fault, applied, reverted and verified from it.

A change is a row (query_id, kind, table_name, key, column_name, before, after). Where column_name is null the whole row is deleted and
`before` is the row as JSON; else that column goes from `before` to `after` (as text). A row of a table is changed once: where
several sessions pick the same one, the smallest query_id has it. Tables are DataFrames by name, with the keys of `KEYS`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = {"links": "id", "evals": "id", "logs": "id", "manifest": "entry_sequence"}
#: The mark of a changed hash, and the characters of the old one that follow it.
MARK, KEPT = "TAMPERED_", 55


def _first(rows: DataFrame, by: str, *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("_n = 1").drop("_n")


def targets(sessions: DataFrame, tables: dict[str, DataFrame], chunks: DataFrame) -> DataFrame:
    """query_id, kind, table_name, key: the row that each session (query_id, response_id, thread_id, kind, safety_required) is to lose or to find changed.

    A link: the first by step, of a safety chunk where safety is required. A score: the response's first evaluation. A log row: the middle one of a
    thread of three or more. A manifest entry: the first of the smallest document among the linked chunks. Sessions without such a row have none.
    """
    of = lambda kind: sessions.filter(F.col("kind") == kind)
    at = chunks.select(F.col("id").alias("chunk_id"), "document_id", "has_safety_content")
    links = tables["links"].select("id", "response_id", "chunk_id", "step_index")
    cut = of("chunk_deletion").select("query_id", "response_id", "safety_required").join(links, "response_id").join(at, "chunk_id", "left")
    cut = _first(cut.filter(~F.col("safety_required") | F.coalesce("has_safety_content", F.lit(False))), "query_id", F.asc_nulls_last("step_index"), "id")
    turned = _first(of("score_perturbation").select("query_id", "response_id").join(tables["evals"].select("id", "response_id"), "response_id"), "query_id", "id")
    rows = of("log_gap").select("query_id", "thread_id").join(tables["logs"].select("id", "thread_id", "started_ms"), "thread_id")
    placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("started_ms", "id")) - 1).withColumn("_k", F.count("*").over(Window.partitionBy("query_id")))
    gap = placed.filter("_k >= 3 and _n = floor(_k / 2)")
    document = of("manifest_tamper").select("query_id", "response_id").join(links, "response_id").join(at, "chunk_id").groupBy("query_id").agg(F.min("document_id").alias("document_id"))
    entry = _first(document.join(tables["manifest"].select("entry_sequence", "document_id"), "document_id"), "query_id", "entry_sequence")
    picked = [(cut, "chunk_deletion", "links"), (turned, "score_perturbation", "evals"), (gap, "log_gap", "logs"), (entry, "manifest_tamper", "manifest")]
    parts = [df.select("query_id", F.lit(kind).alias("kind"), F.lit(name).alias("table_name"), F.col(KEYS[name]).cast("string").alias("key")) for df, kind, name in picked]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.groupBy("table_name", "key").agg(F.min_by(F.struct("query_id", "kind"), "query_id").alias("s")).select("s.query_id", "s.kind", "table_name", "key")


def journal(picked: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The changes of the picked rows. Write it before anything is changed: it is the only backup."""

    def part(name: str, column: str | None, before, after) -> DataFrame:
        rows = tables[name].withColumn("_key", F.col(KEYS[name]).cast("string"))
        hit = picked.filter(F.col("table_name") == name).select("query_id", "kind", "table_name", F.col("key").alias("_key"))
        return hit.join(rows, "_key").select("query_id", "kind", "table_name", F.col("_key").alias("key"), F.lit(column).cast("string").alias("column_name"), before.cast("string").alias("before"), after.cast("string").alias("after"))

    row = lambda name: F.to_json(F.struct(*tables[name].columns))
    score, own_hash, none = F.col("sync_faithfulness"), F.col("entry_hash"), F.lit(None)
    parts = [
        part("links", None, row("links"), none), part("evals", "sync_faithfulness", score, F.round(1 - F.coalesce(score, F.lit(0.0)), 6)),
        part("logs", None, row("logs"), none), part("manifest", "entry_hash", own_hash, F.concat(F.lit(MARK), F.substring(own_hash, 1, KEPT))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _met(table: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """`table` with `_key`, only its rows of the keys (key). Changes are few beside a table: so it is read past them, and what is joined on is as small as they are."""
    return table.withColumn("_key", F.col(KEYS[name]).cast("string")).join(keys.select(F.col("key").alias("_key")), "_key", "left_semi")


def _changed(table: DataFrame, name: str, changes: DataFrame, to: str) -> DataFrame:
    """`table` with the changed columns at `to` (before or after)."""
    own = changes.filter((F.col("table_name") == name) & F.col("column_name").isNotNull())
    for column in {"evals": ["sync_faithfulness"], "manifest": ["entry_hash"]}.get(name, []):
        new = own.filter(F.col("column_name") == column).select(F.col("key").alias("_key"), F.col(to).cast(dict(table.dtypes)[column]).alias("_to"), F.lit(True).alias("_hit"))
        rows = table.join(new, F.col(KEYS[name]).cast("string") == F.col("_key"), "left")
        table = rows.select(*(F.when(F.col("_hit"), F.col("_to")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in table.columns))
    return table


def applied(tables: dict[str, DataFrame], changes: DataFrame) -> dict[str, DataFrame]:
    """The tables with every change of the journal made. Applying it twice is applying it once."""
    out = {}
    for name, table in tables.items():
        gone = changes.filter((F.col("table_name") == name) & F.col("column_name").isNull()).select(F.col("key").alias("_key"))
        left = table.join(gone, F.col(KEYS[name]).cast("string") == F.col("_key"), "left_anti")
        out[name] = _changed(left, name, changes, "after")
    return out


def reverted(tables: dict[str, DataFrame], changes: DataFrame) -> dict[str, DataFrame]:
    """The tables with every change taken back: deleted rows come from the journal, changed columns get their old value."""
    out = {}
    for name, table in tables.items():
        deleted = changes.filter((F.col("table_name") == name) & F.col("column_name").isNull()).select("key", F.from_json("before", table.schema).alias("row"))
        back = deleted.join(_met(table, name, deleted).select("_key"), F.col("key") == F.col("_key"), "left_anti").select("row.*")
        out[name] = _changed(table, name, changes, "before").unionByName(back)
    return out


#: What a deleted row must show when it is back.
SHOWS = {"links": "chunk_id", "logs": "node_name"}


def verified(tables: dict[str, DataFrame], changes: DataFrame) -> DataFrame:
    """query_id, kind, table_name, key, is_restored and reason of each change."""
    parts = []
    for name, table in tables.items():
        own = changes.filter(F.col("table_name") == name)
        shown = SHOWS.get(name)
        column = shown or {"evals": "sync_faithfulness", "manifest": "entry_hash"}[name]
        now = _met(table, name, own).select("_key", F.col(column).cast("string").alias("_now"), F.lit(True).alias("_there"))
        rows = own.join(now, F.col("key") == F.col("_key"), "left")
        wanted = F.get_json_object("before", f"$.{shown}") if shown else F.col("before")
        same = F.col("_now").eqNullSafe(wanted)
        is_marked = F.coalesce(F.startswith("_now", F.lit(MARK)), F.lit(False)) if name == "manifest" else F.lit(False)
        label = F.concat(F.lit(f"{name} {KEYS[name]}="), F.col("key"))
        reason = (
            F.when(F.col("_there").isNull(), F.concat(label, F.lit(" not found")))
            .when(is_marked, F.concat(label, F.lit(": hash still tampered")))
            .when(~same, F.concat(label, F.lit(f": {column} is "), F.coalesce("_now", F.lit("null")), F.lit(", expected "), F.coalesce(wanted, F.lit("null"))))
            .otherwise(F.concat(label, F.lit(" restored")))
        )
        parts.append(rows.select("query_id", "kind", "table_name", "key", (F.col("_there").isNotNull() & same).alias("is_restored"), reason.alias("reason")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def digest(df: DataFrame) -> DataFrame:
    """n_rows, and a digest that does not depend on the rows' order: the sum of the first 12 hex digits of each row's sha256."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    number = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")
    half = 1 << 24  # sums of halves stay whole numbers of 64 bits up to 2^39 rows, without a decimal for each row
    sums = df.select(number.alias("x")).agg(F.count("*").alias("n_rows"), F.sum(F.shiftright("x", 24)).alias("high"), F.sum(F.col("x").bitwiseAND(half - 1)).alias("low"))
    return sums.select("n_rows", F.coalesce(F.col("high").cast("decimal(20,0)") * half + F.col("low").cast("decimal(20,0)"), F.lit(0)).cast("decimal(38,0)").cast("string").alias("digest"))


def digests(states: dict[str, dict[str, DataFrame]], columns: dict[str, list[str]]) -> DataFrame:
    """state, table_name, n_rows and digest of each table of each state, over the given columns."""
    parts = [digest(table.select(*columns[name])).select(F.lit(state).alias("state"), F.lit(name).alias("table_name"), "n_rows", "digest") for state, tables in states.items() for name, table in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
