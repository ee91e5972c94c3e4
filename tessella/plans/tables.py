"""Queries of sources and sinks, selections, set operations and functions, and their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessella.functions import circular as A
from tessella.functions import names as N
from tessella.operators import graph as G
from tessella.operators import ordering as O
from tessella.operators import relational as R
from tessella.operators import selectivity as S
from tessella.plans import crossession, geometry
from tessella.plans.series import HOURLY, hourly
from tessella.session import read, shared_dir
from tessella.sources import arrays, synthetic, tables

SESSIONS = crossession.SESSIONS


def _fact(spark, d):
    return R.tidy(read(spark, d, "selectivity"))


def _folder(spark, name):
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def array_rows(spark, d):
    r = arrays.catalogue_rows(read(spark, d, "embeddings"), "vec_id", "embedding")
    return r.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * (F.col("t") + 1)), 5).alias("moment"))


def csv_written_and_read(spark, d):
    """The counts per mouse and session as a wide CSV, and what is read from it."""
    path = _folder(spark, "csv")
    tables.write_wide_csv(R.selective_counts(_fact(spark, d)), path, ["mouse"], "session", SESSIONS, "n")
    back = spark.read.option("header", True).csv(path)
    return back.select("mouse", *[F.col(f"`{s}`").cast("long").alias(s) for s in SESSIONS])


def json_written_and_read(spark, d):
    path, sig = _folder(spark, "json"), R.significant_pairs(_fact(spark, d)).select(*R.PAIR, "me", "pval")
    tables.write_json(sig, path)
    return tables.read_json(spark, path, sig.schema)


def results_written_and_read(spark, d):
    """A results folder; the second build finds the table and leaves it alone."""
    path, fact = _folder(spark, "results"), _fact(spark, d)
    counts = fact.groupBy("mouse", "session").agg(F.count("*").alias("pairs"))
    tables.write_results({"counts": counts}, path, {"counts": ["mouse"]})
    tables.write_results({"counts": counts.limit(0)}, path, {"counts": ["mouse"]})
    return tables.read_results(spark, path, ["counts"])["counts"].select("mouse", "session", "pairs")


def cached_or_built(spark, d):
    path = _folder(spark, "cache")
    first = tables.built(spark, path, lambda: _fact(spark, d).groupBy("feature").agg(F.count("*").alias("pairs")))
    return tables.built(spark, path, lambda: first.limit(0))


def stats_slice(spark, d):
    return R.stats_slice(_fact(spark, d), ["me", "pval", "opt_delay"], features=["speed", "headdirection", "place"])


def conditions(spark, d):
    f = R.where_all(_fact(spark, d), [("me", ">", 0.05), ("pval", "<", 0.01), ("significant", "=", True)])
    return f.groupBy("mouse", "feature").agg(F.count("*").alias("pairs"))


def measure_by_count(spark, d):
    m = R.measure_by_count(_fact(spark, d), SESSIONS)
    return m.select("mouse", "matched_id", *[F.round(F.col(f"`mi_{s}`"), 9).alias(f"mi_{s}") for s in SESSIONS], *[f"n_{s}" for s in SESSIONS])


def annotation(spark, d):
    nations = R.annotated(read(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), read(spark, d, "region"), ["r_regionkey"])
    c = R.annotated(read(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), nations.select("n_nationkey", "n_name", "r_name"), ["n_nationkey"])
    return c.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def exclusions_kept(spark, d):
    """A set of exclusions that is added to, saved, read again and partly taken back."""
    fact = _fact(spark, d)
    mice = fact.select("mouse").distinct().filter("mouse < 'H03'").withColumn("matched_id", F.lit(None).cast("int"))
    units = fact.filter("matched_id < 20").select("mouse", "matched_id").distinct()
    path = _folder(spark, "exclusions")
    R.Exclusions(spark).add(mice).add(units).save(path)
    kept = R.Exclusions.load(spark, path).remove(units.filter("matched_id < 10"))
    return kept.applied(fact).groupBy("mouse").agg(F.count("*").alias("pairs"))


def participants(spark, d):
    sig = R.significant_pairs(_fact(spark, d))
    j = R.participants_jaccard(sig, "feature", ["mouse", "session", "neuron_idx"])
    return j.select("group_a", "group_b", "common", "united", F.round("jaccard", 6).alias("jaccard"))


def clusters_by_size(spark, d):
    return G.clusters_by_size(geometry.heavy(spark, d))


def giant_component(spark, d):
    return G.giant_component(geometry.heavy(spark, d))


def running_total(spark, d):
    h = hourly(spark, d)
    return O.running_sum(h.select("series", "t", "n"), ["series"], ["t"], "n").select("series", "t", "running")


def value_window(spark, d):
    """Of each series a window of a fifth of its sorted values, from a place by whole-number arithmetic."""
    h = hourly(spark, d)
    r = O.global_rank(h.select("series", "t", "value"), ["series"], ["value", "t"], "r")
    n = h.groupBy("series").agg(F.count("*").alias("n"))
    width, first = F.floor(F.col("n") * 0.2), F.pmod(F.col("n") * 7919 + 13, F.col("n") - F.floor(F.col("n") * 0.2) + 1)
    w = r.join(n, "series").filter((F.col("r") >= first) & (F.col("r") < first + width))
    return w.groupBy("series").agg((F.min("value") - 1e-10).alias("low"), (F.max("value") + 1e-10).alias("high"), ((F.min("value") + F.max("value")) / 2).alias("centre"), F.count("*").alias("n"))


def row_hashes(spark, d):
    c = read(spark, d, "customer")
    return c.select("c_custkey", N.row_hash(F.col("c_name"), F.col("c_mktsegment")).alias("hash"))


def name_parts(spark, d):
    f = _fact(spark, d).select("mouse", "session", "feature").distinct()
    full = N.joined_name(F.lit("run"), F.col("mouse"), F.col("session"))
    p = N.session_parts(full)
    return f.select("feature", full.alias("full"), p["subject"].alias("subject"), p["session"].alias("part"), N.twin_name(F.col("feature")).alias("twin"), N.parent_name(N.twin_name(F.col("feature"))).alias("parent"))


def json_numbers(spark, d):
    return read(spark, d, "events").select(N.number_at(F.col("props"), "k").alias("k"), "value").groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def tuning_responses(spark, d):
    v = read(spark, d, "events").select("event_id", F.col("value").alias("v"), (F.hour(F.col("ts").cast("timestamp")) * (A.TAU / 24)).alias("a"))
    return v.select(
        "event_id", F.round(A.von_mises(F.col("a"), 1.0, 4.0), 6).alias("direction"), F.round(A.place_gaussian(F.col("v") / 100, F.cos("a"), 0.5, 0.0, 0.2), 6).alias("place"),
        F.round(A.sigmoid(F.col("v"), 0.1, 50.0), 6).alias("speed"),
    )


def tail_probabilities(spark, d):
    """Of each event type's greatest hourly sum the probability under its other hours, normal and log-normal."""
    h = hourly(spark, d).filter("value > 0")
    a = h.groupBy("series").agg(F.array_sort(F.collect_list("value")).alias("v"))
    t = a.select("series", F.element_at("v", -1).alias("mi"), F.slice("v", F.lit(1), F.size("v") - 1).alias("null_mi"))
    one, two = S.p_values(t, "norm"), S.p_values(t, "lognorm")
    return one.select("series", F.round("pval", 9).alias("normal")).join(two.select("series", F.round("pval", 9).alias("lognormal")), "series")


def ground_truth_score(spark, d):
    """How well the recorded significance agrees with the thresholds on the measures."""
    fact = _fact(spark, d)
    return synthetic.score(fact.filter("significant"), R.where_all(fact, [("me", ">", R.ME_LEAST), ("pval", "<", R.PVAL_MOST)]), R.PAIR).select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("sensitivity", "precision", "f1")])


def outliers_quantile(spark, d):
    f = _fact(spark, d)
    o = R.outliers(f.select("row_id", "feature", "me"), ["feature"], "me", "quantile", 0.05).filter("outlier")
    return o.select("row_id", "feature")


_NAMES = [
    array_rows, csv_written_and_read, json_written_and_read, results_written_and_read, cached_or_built, stats_slice, conditions, measure_by_count, annotation, exclusions_kept, participants,
    clusters_by_size, giant_component, running_total, value_window, row_hashes, name_parts, json_numbers, tuning_responses, tail_probabilities, ground_truth_score, outliers_quantile,
]


def queries():
    return {f.__name__: f for f in _NAMES}


def oracle_sql():
    from tessella.plans.crossession import _T

    steps = 4000
    sf = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power({{z}} + i * {12 / steps!r}, 2) / 2))) * {12 / steps / 3!r} / sqrt(2 * pi())"
    heavy = geometry.HEAVY
    walk = f"{heavy}, n AS (SELECT src AS x, dst AS y FROM h UNION SELECT dst, src FROM h), r AS (SELECT x, x AS y FROM n UNION SELECT r.x, n.y FROM r JOIN n ON r.y = n.x), c AS (SELECT x AS id, min(y) AS component FROM r GROUP BY x), z AS (SELECT component, count(*) AS size FROM c GROUP BY component)"
    sel = "(SELECT mouse, session, count(DISTINCT neuron_idx) AS n FROM sig GROUP BY mouse, session)"
    wide = ", ".join(f"coalesce(max(n) FILTER (WHERE session = '{s}'), 0) AS \"{s}\"" for s in SESSIONS)
    number = "CASE WHEN NOT isnan({c}) THEN {c} END"
    mi = ", ".join(f"round(avg({number.format(c='me')}) FILTER (WHERE session = '{s}'), 9) AS \"mi_{s}\"" for s in SESSIONS)
    ns = ", ".join(f"count(DISTINCT feature) FILTER (WHERE session = '{s}') AS \"n_{s}\"" for s in SESSIONS)
    return {
        "array_rows": "SELECT vec_id AS id, count(*) AS n, round(sum(CAST(x AS DOUBLE) * i), 5) AS moment FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE x IS NOT NULL GROUP BY vec_id",
        "csv_written_and_read": f"WITH {_T} SELECT m.mouse, {wide} FROM (SELECT DISTINCT mouse FROM tidy) m LEFT JOIN {sel} s ON s.mouse = m.mouse GROUP BY m.mouse",
        "json_written_and_read": f"WITH {_T} SELECT mouse, session, neuron_idx, feature, me, pval FROM sig",
        "results_written_and_read": f"WITH {_T} SELECT mouse, session, count(*) AS pairs FROM tidy GROUP BY ALL",
        "cached_or_built": f"WITH {_T} SELECT feature, count(*) AS pairs FROM tidy GROUP BY ALL",
        "stats_slice": f"WITH {_T}, s AS (SELECT mouse, session, neuron_idx, feature, unnest(['me', 'pval', 'opt_delay']) AS stat, unnest([me, pval, opt_delay]) AS value FROM tidy WHERE feature IN ('speed', 'headdirection', 'place')) SELECT * FROM s",
        "conditions": f"WITH {_T} SELECT mouse, feature, count(*) AS pairs FROM tidy WHERE {number.format(c='me')} > 0.05 AND {number.format(c='pval')} < 0.01 AND significant GROUP BY ALL",
        "measure_by_count": f"WITH {_T}, a AS (SELECT mouse, matched_id, {mi} FROM tidy WHERE matched_id IS NOT NULL GROUP BY ALL), b AS (SELECT mouse, matched_id, {ns} FROM sig WHERE matched_id IS NOT NULL GROUP BY ALL) SELECT a.*, " + ", ".join(f"coalesce(\"n_{s}\", 0) AS \"n_{s}\"" for s in SESSIONS) + " FROM a LEFT JOIN b USING (mouse, matched_id)",
        "annotation": "SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY ALL",
        "exclusions_kept": f"WITH {_T} SELECT mouse, count(*) AS pairs FROM tidy WHERE NOT mouse < 'H03' AND NOT coalesce(matched_id BETWEEN 10 AND 19 OR matched_id < 0, false) GROUP BY mouse",
        "participants": f"WITH {_T}, m AS (SELECT DISTINCT feature, mouse, session, neuron_idx FROM sig), k AS (SELECT feature, count(*) AS n FROM m GROUP BY feature), b AS (SELECT a.feature AS group_a, c.feature AS group_b, count(*) AS common FROM m a JOIN m c ON a.mouse = c.mouse AND a.session = c.session AND a.neuron_idx = c.neuron_idx AND a.feature < c.feature GROUP BY ALL) SELECT group_a, group_b, common, x.n + y.n - common AS united, round(common / (x.n + y.n - common), 6) AS jaccard FROM b JOIN k x ON x.feature = group_a JOIN k y ON y.feature = group_b",
        "clusters_by_size": f"WITH RECURSIVE {walk} SELECT row_number() OVER (ORDER BY size DESC, component) AS place, component, size FROM z",
        "giant_component": f"WITH RECURSIVE {walk} SELECT id FROM c WHERE component = (SELECT component FROM z ORDER BY size DESC, component LIMIT 1)",
        "running_total": f"WITH {HOURLY} SELECT series, t, CAST(sum(n) OVER (PARTITION BY series ORDER BY t) AS BIGINT) AS running FROM hourly",
        "value_window": f"WITH {HOURLY}, r AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY value, t) - 1 AS r, count(*) OVER (PARTITION BY series) AS n FROM hourly), w AS (SELECT *, CAST(floor(n * 0.2) AS BIGINT) AS w, (n * 7919 + 13) % (n - CAST(floor(n * 0.2) AS BIGINT) + 1) AS f FROM r) SELECT series, min(value) - 1e-10 AS low, max(value) + 1e-10 AS high, (min(value) + max(value)) / 2 AS centre, count(*) AS n FROM w WHERE r >= f AND r < f + w GROUP BY series",
        "row_hashes": "SELECT c_custkey, sha256(concat_ws(chr(31), coalesce(c_name, chr(0)), coalesce(c_mktsegment, chr(0)))) AS hash FROM customer",
        "name_parts": f"WITH {_T} SELECT DISTINCT feature, upper(concat_ws('_', 'run', nullif(mouse, ''), nullif(session, ''))) AS \"full\", upper(mouse) AS subject, upper(session) AS part, CASE WHEN feature LIKE '%\\_2d' ESCAPE '\\' THEN feature ELSE feature || '_2d' END AS twin, CASE WHEN feature LIKE '%\\_2d' ESCAPE '\\' THEN feature[:-4] ELSE feature END AS parent FROM tidy",
        "json_numbers": "SELECT TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1",
        "tuning_responses": f"WITH e AS (SELECT event_id, value AS v, hour(ts) * {A.TAU / 24!r} AS a FROM events) SELECT event_id, round(exp(4.0 * (cos(a - 1.0) - 1)), 6) AS direction, round(exp(-(power(v / 100 - 0.5, 2) + power(cos(a), 2)) / (2 * 0.2 * 0.2)), 6) AS place, round(1 / (1 + exp(-0.1 * (v - 50.0))), 6) AS speed FROM e",
        "tail_probabilities": f"WITH {HOURLY}, o AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY value DESC, t) AS k FROM hourly WHERE value > 0), z AS (SELECT series, (max(value) - avg(value) FILTER (WHERE k > 1)) / stddev_pop(value) FILTER (WHERE k > 1) AS a, (ln(max(value)) - avg(ln(value)) FILTER (WHERE k > 1)) / stddev_pop(ln(value)) FILTER (WHERE k > 1) AS b FROM o GROUP BY series) SELECT series, round({sf.format(z='a')}, 9) AS normal, round({sf.format(z='b')}, 9) AS lognormal FROM z",
        "ground_truth_score": f"WITH {_T}, c AS (SELECT coalesce(significant, false) AS f, coalesce({number.format(c='me')} > 0.04 AND {number.format(c='pval')} < 0.001, false) AS t FROM tidy), n AS (SELECT count(*) FILTER (WHERE f AND t) AS tp, count(*) FILTER (WHERE f AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT f) AS fn FROM c) SELECT tp, fp, fn, round(tp / (tp + fn), 6) AS sensitivity, round(tp / (tp + fp), 6) AS \"precision\", round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM n",
        "outliers_quantile": f"WITH {_T}, q AS (SELECT feature, quantile_cont({number.format(c='me')}, 0.05) AS a, quantile_cont({number.format(c='me')}, 0.95) AS b FROM tidy GROUP BY feature) SELECT row_id, feature FROM tidy JOIN q USING (feature) WHERE {number.format(c='me')} < a OR {number.format(c='me')} > b",
    }
