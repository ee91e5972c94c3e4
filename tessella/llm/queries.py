"""The queries of the language-model operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import leaks, mixing, percentiles, pieces
from tessella.session import cut, read

RECORD = ["mouse", "session", "neuron_idx", "feature"]
KEYS = ["feature", "session"]


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(read(spark, d, "selectivity"), KEYS, "me", RECORD)


def p1_combined(spark: SparkSession, d: str) -> DataFrame:
    parts = cut(percentiles.day_parts(read(spark, d, "selectivity"), KEYS, "me", RECORD))
    return percentiles.from_parts(parts, KEYS)


def p1_days(spark: SparkSession, d: str) -> DataFrame:
    parts = cut(percentiles.day_parts(read(spark, d, "selectivity"), KEYS, "me", RECORD))
    return percentiles.from_parts(parts, [*KEYS, "day"], (0.5, 0.95)).withColumn("day", F.col("day").cast("string"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return leaks.removal_spans(docs, leaks.leaked(docs, read(spark, d, "eval_items")))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split(read(spark, d, "documents")).filter(F.col("piece_no") == 0).select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split(read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_percentiles, p1_combined, p1_days, p7_found, p7_spans, p8_mix, p8_shares, p9_found, p9_pieces)}


_ONCE = """once AS (
  SELECT feature, session, CAST(CAST(loaded_at AS DATE) AS VARCHAR) AS day, me FROM selectivity
  WHERE me IS NOT NULL AND NOT isnan(me)
  QUALIFY row_number() OVER (PARTITION BY mouse, session, neuron_idx, feature,
    CASE WHEN mouse IS NULL OR session IS NULL OR neuron_idx IS NULL OR feature IS NULL THEN row_id END ORDER BY loaded_at, row_id) = 1)"""


def _percentiles_sql(keys: str, probs: tuple[float, ...]) -> str:
    return f"""WITH {_ONCE},
s AS (SELECT {keys}, count(*) AS n, list(me ORDER BY me) AS v FROM once GROUP BY {keys}),
p AS (SELECT *, (n - 1) * prob AS h FROM s CROSS JOIN (SELECT unnest({list(probs)}::DOUBLE[]) AS prob))
SELECT {keys}, prob, n, v[CAST(floor(h) AS BIGINT) + 1] + (v[CAST(ceil(h) AS BIGINT) + 1] - v[CAST(floor(h) AS BIGINT) + 1]) * (h - floor(h)) AS value FROM p"""


def oracle_sql() -> dict[str, str]:
    over_all = _percentiles_sql("feature, session", percentiles.PROBS)
    return {
        "p1_percentiles": over_all,
        "p1_combined": over_all,
        "p1_days": _percentiles_sql("feature, session, day", (0.5, 0.95)),
        # the sizes lie far enough from the limit for any tokenizer, be it one of four characters a token
        "p9_found": "SELECT doc_id FROM documents WHERE length(text) > 4 * 2000",
    }
