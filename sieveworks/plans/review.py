"""Review reducer, plan fingerprint and simulated application.  Nothing in this module moves or deletes a file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import bindings as B

#: Offset basis and prime of 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
BATCH, STOP_AFTER = 32, 20


def fnv1a(data: bytes, h: int = FNV_BASIS) -> int:
    for byte in data:
        h = (h ^ byte) * FNV_PRIME % 2**64
    return h


def reduce_actions(actions: DataFrame) -> DataFrame:
    """State of each group after its ordered actions: toggle, keep_all, discard, confirm, skip, clear.

    actions: key, seq, action, path, files (array).  Toggling the last keeper is refused; confirming
    with no keeper is too.  One group's log is sequential, so it is one Arrow call.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        files, kept, state, refused = list(rows.iloc[0]["files"]), set(rows.iloc[0]["files"][:1]), "undecided", 0
        for action, path in zip(rows["action"], rows["path"], strict=True):
            if action == "toggle":
                if kept == {path}:
                    refused += 1
                else:
                    kept ^= {path} & set(files)
                    state = "decided"
            elif action == "keep_all":
                kept, state = set(files), "decided"
            elif action == "discard":
                kept, state = set(), "decided"
            elif action == "confirm":
                refused += state != "decided" and not kept
                state = "decided" if kept or state == "decided" else state
            elif action == "skip":
                state = "skipped"
            elif action == "clear":
                kept, state = set(files[:1]), "undecided"
        return pd.DataFrame({"key": [rows.iloc[0]["key"]], "state": [state], "kept": ["|".join(sorted(kept))], "refused": [int(refused)]})

    return actions.groupBy("key").applyInPandas(run, "key bigint, state string, kept string, refused bigint")


def fingerprint(plan: DataFrame, key: str) -> DataFrame:
    """One 64-bit value per plan that any change of its rows changes: an order-free sum of row hashes, FNV-1a over it."""
    total = plan.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*plan.columns).cast("decimal(38,0)")).alias("h")).first()
    return plan.sparkSession.createDataFrame([(key, int(total["n"]), f"{fnv1a(f'{total["n"]}:{total["h"]}'.encode()):016x}")], "plan string, rows bigint, fingerprint string")


def simulate(outcomes: list[str]) -> tuple[list[tuple[int, str]], bool]:
    """(batch, outcome) of each step of an ordered application, and whether it stopped.

    Journal batches hold 32; 20 failures in a row stop it; a refusal is no failure and ends no run.
    """
    done, row = [], 0
    for k, outcome in enumerate(outcomes):
        done.append((k // BATCH, outcome))
        row = row + 1 if outcome == "failed" else row if outcome == "refused" else 0
        if row >= STOP_AFTER:
            return done, True
    return done, False


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _review_reduce(s, d):
    e = B.table(s, d, "events")
    action = F.element_at(F.array(*[F.lit(x) for x in ("toggle", "keep_all", "discard", "confirm", "skip", "clear")]), (F.col("event_id") % 6 + 1).cast("int"))
    files = F.array(*[F.concat(F.lit(f"/g/{k}-"), F.col("user_id").cast("string")) for k in range(3)])
    return reduce_actions(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), action.alias("action"), F.element_at(files, (F.col("event_id") % 3 + 1).cast("int")).alias("path"), files.alias("files")))


def _plan_fingerprint(s, d):
    from ..operators.exact import removals

    return fingerprint(removals(B.storage(s, d)), "exact")


def apply_outcomes(steps: DataFrame, plan: str = "plan", seq: str = "seq") -> DataFrame:
    """steps (plan, seq, outcome) with batch and reached, by the rules of simulate(), for every plan at once.

    Runs of failures are counted by windows: a success begins a new run, a refusal neither counts nor ends one.
    """
    order = Window.partitionBy(plan).orderBy(seq)
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    run = steps.withColumn("__run", F.count_if(F.col("outcome") == "moved").over(sofar))
    long = Window.partitionBy(plan, "__run").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stops = run.withColumn("__stop", F.count_if(F.col("outcome") == "failed").over(long) >= STOP_AFTER)
    stopped = F.coalesce(F.bool_or("__stop").over(before), F.lit(False))
    return stops.withColumns({"batch": F.floor((F.row_number().over(order) - 1) / BATCH).cast("bigint"), "reached": ~stopped}).drop("__run", "__stop")


def _apply_simulation(s, d):
    """Plans bound to users, their events as steps; steps of every eleventh user fail for long."""
    e = B.table(s, d, "events")
    state = F.when(F.col("event_id") % 9 == 0, "refused").when((F.col("event_id") % 7 == 0) | (F.col("user_id") % 11 == 0), "failed").otherwise("moved")
    steps = e.select(F.col("user_id").alias("plan"), F.col("event_id").alias("seq"), state.alias("outcome"))
    return apply_outcomes(steps).groupBy("plan", "batch").agg(F.count_if("reached").alias("reached"), *[F.count_if(F.col("reached") & (F.col("outcome") == k)).alias(k) for k in ("moved", "failed", "refused")])


def _phash_pipeline(s, d):
    from ..functions.phash import phash

    e = B.table(s, d, "embeddings")
    pixels = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int"))
    return e.select("vec_id", phash(pixels, F.lit(8)).alias("hash"))


QUERIES |= {"review_reduce": _review_reduce, "plan_fingerprint": _plan_fingerprint, "apply_simulation": _apply_simulation, "phash_pipeline": _phash_pipeline}

ORACLE_SQL["apply_simulation"] = f"""WITH x AS (SELECT user_id AS plan, event_id AS seq, CASE WHEN event_id % 9 = 0 THEN 'refused' WHEN event_id % 7 = 0 OR user_id % 11 = 0 THEN 'failed' ELSE 'moved' END AS outcome FROM events),
r AS (SELECT *, count_if(outcome = 'moved') OVER (PARTITION BY plan ORDER BY seq) AS run, row_number() OVER (PARTITION BY plan ORDER BY seq) - 1 AS k FROM x), f AS (SELECT *, count_if(outcome = 'failed') OVER (PARTITION BY plan, run ORDER BY seq) AS row FROM r),
e AS (SELECT plan, min(seq) AS last FROM f WHERE row >= {STOP_AFTER} GROUP BY plan), z AS (SELECT f.*, coalesce(seq <= last, true) AS reached FROM f LEFT JOIN e USING (plan))
SELECT plan, (k // {BATCH})::BIGINT AS batch, count_if(reached)::BIGINT AS reached, count_if(reached AND outcome = 'moved')::BIGINT AS moved, count_if(reached AND outcome = 'failed')::BIGINT AS failed, count_if(reached AND outcome = 'refused')::BIGINT AS refused FROM z GROUP BY 1, 2"""
