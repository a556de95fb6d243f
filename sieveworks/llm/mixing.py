"""Mixing sources to target weights by iterative proportional fitting.

The tokens of every (source, language, topic) cell are counted; raking then scales a weight per cell
until the weighted tokens meet the target share of every source, language and topic in turn.  A
document is taken with probability min(1, s * weight), where s is calibrated exactly so that the
expected tokens of the sample are a given share of all; the draw is a hash of the identifier, so it
is reproducible.  Cells at probability 1 fall short of their target, the others keep the raked
proportions; a share of 1 / (largest weight) or less caps no cell.  The targets are met by repeating
documents: copies is share * weight rounded up or down by the same draw, so its expected tokens have
the raked shares whatever the weights.
The targets of a marginal are its present shares raised to a power below one, which lifts rare
sources, languages and topics; a target table can be given instead.

Everything is DataFrame operations.  Documents are reduced to cells before the first shuffle, so a
source with a third of all rows is one row per task; raking and its sums work on cells alone.

A null source or language is a value of its own.  A null text has no tokens and the topic 'prose'.
Documents without tokens do not weigh on the cells but are drawn with their cell's probability; a
cell without tokens has weight 1 before scaling.  Repeated rows are drawn alike.  An empty table
gives no rows.  Other columns stay as they are; columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

ROUNDS, POWER, KEEP, SEED = 12, 0.7, 0.8, "mix-1"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Topics by what a text contains, the first that fits.
TOPICS = (("licence", "%icense%"), ("credentials", "%token = %"), ("contact", "%@%"))
AXES = ("source", "lang", "topic")
ADDED = ("topic", "n_tokens", "mix_weight", "probability", "drawn", "copies")


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.like(pattern), name).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("double")


def targets_of(cells: DataFrame, axis: str, power: float = POWER) -> DataFrame:
    """Target share of each value of the axis: its present share, flattened."""
    shares = cells.groupBy(axis).agg(F.sum("tokens").alias("t")).where("t > 0").withColumn("p", F.pow("t", F.lit(power)))
    return shares.select(axis, (F.col("p") / F.sum("p").over(Window.partitionBy(F.lit(1)))).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight; rounds of scaling to each axis in turn."""
    out = cells.withColumn("mass", F.col("tokens"))
    for axis in AXES:
        t = targets[axis].withColumnsRenamed({axis: "__axis", "target": f"__{axis}"})
        out = out.join(t, out[axis].eqNullSafe(t["__axis"]), "left").drop("__axis")
    out, _ = stored(out, "cells")
    for k in range(rounds):
        for axis in AXES:
            held = F.sum("mass").over(Window.partitionBy(axis))
            out = out.withColumn("mass", F.when(held > 0, F.col("mass") * F.col(f"__{axis}") / held).otherwise(0.0))
        if k % 4 == 3:
            out, _ = stored(out, "cells")
    total, mass = (F.sum(c).over(Window.partitionBy(F.lit(1))) for c in ("tokens", "mass"))
    weight = F.when(F.col("tokens") > 0, F.col("mass") / mass / (F.col("tokens") / total)).otherwise(1.0)
    return out.select(*AXES, "tokens", weight.alias("weight"))


def calibrated(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """cells (tokens, weight) with probability min(1, s * weight) for expected tokens of keep times all.

    In the order of falling weight, cells are capped until the s that the rest needs caps no more.
    One row per cell is sorted here, never a row per document.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("weight").desc(), *AXES)
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("tokens") * F.col("weight")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    out = cells.withColumn("__s", F.when(rest > 0, (keep * total - before) / rest)).withColumn("__rank", F.row_number().over(order))
    first = F.min_by("__s", F.when(F.col("__s") * F.col("weight") <= 1, F.col("__rank"))).over(Window.partitionBy(F.lit(1)))
    return out.withColumn("probability", F.least(F.lit(1.0), F.coalesce(first, F.lit(1.0)) * F.col("weight"))).drop("__s", "__rank")


def uniform(identifier: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) for each identifier, alike in every run; null has its own."""
    text = F.concat(F.coalesce(identifier.cast("string"), F.lit("null")), F.lit(f"/{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, power: float = POWER, keep: float = KEEP, seed: str = SEED, prefix: str = "") -> DataFrame:
    """docs with topic, n_tokens, mix_weight, probability, drawn and copies, their names after prefix, in place of columns of these names."""
    added = {c: f"{prefix}{c}" for c in ADDED}
    docs = docs.drop(*added.values())
    own = docs.columns
    hidden = {c: f"__{i}_own" for i, c in enumerate(own)}  # so that no column of docs clashes
    names = {c: F.col(hidden[c]) for c in own}
    docs = docs.toDF(*hidden.values())
    id_col, text_col, source_col, lang_col = (hidden[next(c for c in own if c.lower() == x.lower())] for x in (id_col, text_col, source_col, lang_col))
    marked = docs.withColumns({"topic": F.coalesce(topic_of(F.col(text_col)), F.lit("prose")), "n_tokens": tokens_of(F.col(text_col))})
    cells, _ = stored(marked.groupBy(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), "topic").agg(F.sum("n_tokens").alias("tokens")), "cells")
    fitted = rake(cells, targets or {axis: targets_of(cells, axis, power) for axis in AXES}, rounds)
    fitted, _ = stored(calibrated(fitted, keep), "weights")
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    weights = fitted.select(key(F.col("source")).alias("__s"), key(F.col("lang")).alias("__l"), F.col("topic").alias("__t"), F.col("weight").alias("mix_weight"), "probability")
    # Catalyst broadcasts the cells while they are under its size limit, and shuffles beyond it
    keyed = marked.withColumns({"__s": key(F.col(source_col).cast("string")), "__l": key(F.col(lang_col).cast("string")), "__t": F.col("topic")})
    joined = keyed.join(weights, ["__s", "__l", "__t"])
    u, often = uniform(F.col(id_col), seed), F.col("mix_weight") * keep
    copies = (F.floor(often) + (u < often - F.floor(often)).cast("int")).cast("int")
    return joined.withColumns({"drawn": u < F.col("probability"), "copies": copies}).select(*(names[c].alias(c) for c in own), *(F.col(c).alias(added[c]) for c in ADDED))


def op4_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    found = mix(docs)
    return found.select("doc_id", "source", "lang", "topic", F.col("n_tokens").cast("long").alias("n_tokens"), F.round("mix_weight", 6).alias("mix_weight"), F.round("probability", 6).alias("probability"), "drawn")


def oracle(rounds: int = ROUNDS, power: float = POWER, keep: float = KEEP, seed: str = SEED) -> str:
    """The same as SQL for DuckDB."""
    topics = " ".join(f"WHEN text LIKE '{p}' THEN '{n}'" for n, p in TOPICS)
    parts = [
        f"""m AS (SELECT doc_id, source, lang, CASE {topics} ELSE 'prose' END AS topic,
        coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::DOUBLE AS n_tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM m GROUP BY ALL)",
    ]
    for axis in AXES:
        parts.append(f"t_{axis} AS (SELECT {axis}, p / sum(p) OVER () AS target FROM (SELECT {axis}, pow(sum(tokens), {power}) AS p FROM c GROUP BY {axis} HAVING sum(tokens) > 0))")
    marks = ", ".join(f"t_{a}.target AS g_{a}" for a in AXES)
    joins = " ".join(f"LEFT JOIN t_{a} ON c.{a} IS NOT DISTINCT FROM t_{a}.{a}" for a in AXES)
    parts.append(f"r0 AS MATERIALIZED (SELECT c.*, tokens AS mass, {marks} FROM c {joins})")
    step = 0
    for _ in range(rounds):
        for axis in AXES:
            held = f"sum(mass) OVER (PARTITION BY {axis})"
            parts.append(f"r{step + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {held} > 0 THEN mass * g_{axis} / {held} ELSE 0 END AS mass) FROM r{step})")
            step += 1
    parts.append(f"w AS (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN mass / sum(mass) OVER () / (tokens / sum(tokens) OVER ()) ELSE 1.0 END AS weight FROM r{step})")
    parts.append(f"""s AS (SELECT *, row_number() OVER o AS rank,
        ({keep} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / nullif(sum(tokens * weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS s
        FROM w WINDOW o AS (ORDER BY weight DESC, source, lang, topic))""")
    parts.append("p AS (SELECT *, least(1.0, coalesce((SELECT s FROM s WHERE s * weight <= 1 ORDER BY rank LIMIT 1), 1.0) * weight) AS probability FROM s)")
    draw = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/{seed}'), 1, 8))::BIGINT / 4294967296.0"
    return f"""WITH {", ".join(parts)}
    SELECT m.doc_id, m.source, m.lang, m.topic, m.n_tokens::BIGINT AS n_tokens, round(weight, 6) AS mix_weight, round(probability, 6) AS probability,
           {draw} < probability AS drawn
    FROM m JOIN p ON m.source IS NOT DISTINCT FROM p.source AND m.lang IS NOT DISTINCT FROM p.lang AND m.topic = p.topic"""
