"""The query catalogue.  ``QUERIES`` maps names to functions of (spark, sf_dir); ``ORACLE_SQL`` has the DuckDB form.

Results are rounded where the order of a floating-point sum may differ between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.functions import columns as C
from sigspark.operators import aggregates, blocks, evaluate, joins, windows
from sigspark.sources.recordings import CHANNELS, events_trace, events_trains, lineitem_channels, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c: Column | str, digits: int = 4) -> Column:
    """Rounded, with -0 as 0, so that equal values print alike in both engines."""
    return F.round(c, digits) + F.lit(0.0)


TRACE = "(SELECT event_id AS t, value AS v FROM events)"
QUIET, LOUD, SILENCE, PAD, REACH, SPAN, NORM = 50.0, 100.0, 4, 2, 10, 9, 32
BAND = 60_000_000  # microseconds


# Windows and intervals


@query(f"""
    WITH q AS (SELECT t, t - row_number() OVER (ORDER BY t) AS g FROM {TRACE} WHERE v < {QUIET})
    SELECT min(t) AS start, max(t) AS "end", count(*) AS len FROM q GROUP BY g HAVING count(*) > 8""")
def quiet_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.quiet_zones(events_trace(spark, sf_dir), QUIET, 8).select("start", "end", "len")


@query(f"""
    WITH q AS (SELECT t, t - row_number() OVER (ORDER BY t) AS g FROM {TRACE} WHERE NOT v > {LOUD})
    SELECT min(t) AS start, max(t) AS "end", count(*) AS len FROM q GROUP BY g HAVING count(*) >= {SILENCE}""")
def silence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.silence_runs(events_trace(spark, sf_dir), LOUD, SILENCE).select("start", "end", "len")


PARTITION = f"""
    x AS (SELECT min(t) AS t0, max(t) AS t1 FROM {TRACE}),
    q AS (SELECT t, t - row_number() OVER (ORDER BY t) AS g FROM {TRACE} WHERE NOT v > {LOUD}),
    quiet AS (SELECT min(t) AS a, max(t) AS b FROM q GROUP BY g HAVING count(*) >= {SILENCE}),
    marks AS (SELECT * FROM quiet UNION ALL SELECT t0 - 1, t0 - 1 FROM x UNION ALL SELECT t1 + 1, t1 + 1 FROM x),
    gaps AS (SELECT b + 1 AS s, lead(a) OVER (ORDER BY b, a) - 1 AS e FROM marks),
    grown AS (SELECT greatest(t0, s - {PAD}) AS a, least(t1, e + {PAD}) AS b, t0, t1 FROM gaps, x WHERE e >= s),
    odd AS (SELECT a, CASE WHEN (b - a) % 2 = 1 AND b < t1 THEN b + 1 ELSE b END AS b, t0 FROM grown),
    part AS (SELECT CASE WHEN (b - a) % 2 = 1 THEN greatest(a - 1, t0) ELSE a END AS start, b AS "end" FROM odd)"""


def events_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.active_partition(events_trace(spark, sf_dir), LOUD, SILENCE, PAD)


@query(f'WITH {PARTITION} SELECT start, "end", "end" - start + 1 AS len, (start + "end") // 2 AS center FROM part')
def active_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_partition(spark, sf_dir).select("start", "end", "len", "center")


@query(f"""WITH {PARTITION},
    g AS (SELECT "end" + 1 AS start, lead(start) OVER (ORDER BY start) - 1 AS "end" FROM part)
    SELECT start, "end", "end" - start + 1 AS len FROM g WHERE "end" >= start""")
def partition_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.partition_breaks(events_partition(spark, sf_dir)).select("start", "end", "len")


@query(f"""
    WITH w AS (SELECT t, v, max(v) OVER (ORDER BY t ROWS BETWEEN {REACH} PRECEDING AND {REACH} FOLLOWING) AS m,
                      max(t) OVER () AS t1, min(t) OVER () AS t0 FROM {TRACE})
    SELECT t, v FROM w WHERE v > {LOUD} AND v >= m AND t >= t0 + 20 AND t < t1 - 20""")
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.local_peaks(events_trace(spark, sf_dir), LOUD, REACH, 20).select("t", "v")


@query(f"""
    WITH w AS (SELECT t, v, min(v) OVER (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM {TRACE})
    SELECT t, v FROM w WHERE v <= m""")
def local_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = blocks.in_blocks(events_trace(spark, sf_dir), {"least": lambda w: F.min("v").over(w)}, 5, 5)
    return seen.where("v <= least").select("t", "v")


@query(f"""
    WITH x AS (SELECT t, v, least(4, t - min(t) OVER (), max(t) OVER () - t) AS h FROM {TRACE}),
    m AS (SELECT a.t, avg(b.v) AS smooth FROM x a JOIN x b ON b.t BETWEEN a.t - a.h AND a.t + a.h GROUP BY a.t)
    SELECT t, round(smooth, 4) + 0.0 AS smooth FROM m""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.moving_average(events_trace(spark, sf_dir), SPAN).select("t", r("smooth").alias("smooth"))


@query(f"""
    WITH w AS (SELECT t, sqrt(sum(v * v) OVER (ORDER BY t ROWS BETWEEN {NORM - 1} PRECEDING AND CURRENT ROW)) AS norm, t - min(t) OVER () AS k FROM {TRACE})
    SELECT t, round(norm, 4) + 0.0 AS norm FROM w WHERE k >= {NORM - 1} AND (k - {NORM - 1}) % {NORM // 8} = 0""")
def sliding_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_norm(events_trace(spark, sf_dir), NORM).select("t", r("norm").alias("norm"))


@query(f"SELECT t, lag(v, 3, 0.0) OVER (ORDER BY t) AS before, v AS here, lead(v, 3, 0.0) OVER (ORDER BY t) AS after FROM {TRACE}")
def shift_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.shifted(events_trace(spark, sf_dir), 3).select("t", "before", "here", "after")


@query("""
    WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
    f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM e),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM f)
    SELECT user_id, min(t) AS start, max(t) AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(events_trains(spark, sf_dir), 6 * 3_600_000_000, keys=("user_id",))


# Projections and aggregates


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"{c} - (SELECT CAST(sum(CAST({c} AS DECIMAL(12, 2))) AS DOUBLE) / count(*) FROM lineitem) AS {c}" for c in CHANNELS) + " FROM lineitem")
def channel_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.centered(lineitem_channels(spark, sf_dir), CHANNELS, 2)


@query("WITH m AS (SELECT greatest(" + ", ".join(f"max(abs({c}))" for c in CHANNELS) + ") AS m FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"round({c} / m, 6) + 0.0 AS {c}" for c in CHANNELS) + " FROM lineitem, m")
def global_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.rescaled(lineitem_channels(spark, sf_dir), CHANNELS)
    return out.withColumns({c: r(c, 6) for c in CHANNELS})


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(" + " + ".join(f"{c} * {c}" for c in CHANNELS) + "), 4) + 0.0 AS magnitude FROM lineitem")
def cross_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem_channels(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(aggregates.cross_magnitude(rows, CHANNELS)).alias("magnitude"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS one, '{b}' AS two, round(covar_pop({a}, {b}), 3) + 0.0 AS cov FROM lineitem" for a in CHANNELS for b in CHANNELS))
def noise_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.covariance(lineitem_channels(spark, sf_dir), CHANNELS).select("one", "two", r("cov", 3).alias("cov"))


_LAGS = 12


@query(f"""
    WITH p AS (SELECT l.lag, sum(a.v * b.v) AS s FROM {TRACE} a, (SELECT unnest(range({_LAGS + 1})) AS lag) l, {TRACE} b WHERE b.t = a.t + l.lag GROUP BY l.lag),
    d AS (SELECT lag, s - (SELECT s FROM p WHERE lag = {_LAGS}) AS d FROM p)
    SELECT CAST(lag AS INTEGER) AS lag, round(d / (SELECT max(abs(d)) FROM d), 6) + 0.0 AS acf FROM d""")
def acf_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = aggregates.lag_products(events_trace(spark, sf_dir), _LAGS)
    return aggregates.autocorrelation(sums).select("lag", r("acf", 6).alias("acf"))


@query(f"""
    WITH e AS (SELECT t, v, t // 100 AS zone FROM {TRACE}),
    p AS (SELECT l.lag, sum(a.v * b.v) AS s FROM e a, (SELECT unnest(range({_LAGS + 1})) AS lag) l, e b WHERE b.t = a.t + l.lag AND a.zone = b.zone GROUP BY l.lag),
    d AS (SELECT lag, s - (SELECT s FROM p WHERE lag = {_LAGS}) AS d FROM p)
    SELECT CAST(lag AS INTEGER) AS lag, round(d / (SELECT max(abs(d)) FROM d), 6) + 0.0 AS acf FROM d""")
def acf_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    zoned = events_trace(spark, sf_dir).withColumn("zone", F.floor(F.col("t") / 100))
    return aggregates.autocorrelation(aggregates.lag_products(zoned, _LAGS, zone="zone")).select("lag", r("acf", 6).alias("acf"))


@query("""
    SELECT CAST(least(greatest(floor((value - 0) / (200.0 / 40) + 0.5), 0), 40) AS INTEGER) AS bin, count(*) AS n,
           round(CAST(least(greatest(floor((value - 0) / (200.0 / 40) + 0.5), 0), 40) AS INTEGER) * (200.0 / 40), 4) AS center
    FROM events GROUP BY 1, 3""")
def histogram_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.histogram(events_trace(spark, sf_dir), "v", 0.0, 200.0, 41).select("bin", "n", r("center").alias("center"))


@query("""
    WITH s AS (SELECT min(value) AS lo, max(value) AS hi, CAST(least(100, ceil(round(2 * pow(count(*), 1.0 / 3), 6))) AS INTEGER) AS k FROM events)
    SELECT CAST(least(floor((value - lo) / (hi - lo) * k), k - 1) AS INTEGER) AS bin, count(*) AS n FROM events, s GROUP BY 1""")
def histogram_rice(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = events_trace(spark, sf_dir)
    s = trace.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), C.rice_bins(F.count("*")).alias("k")).first()
    at = F.least(F.floor((F.col("v") - F.lit(s["lo"])) / F.lit(s["hi"] - s["lo"]) * s["k"]), F.lit(s["k"] - 1)).cast("int")
    return trace.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


_ELEMENTS = "(SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)"


@query(f"SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) + 0.0 AS x FROM {_ELEMENTS} GROUP BY label, pos")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.centroids(vectors(spark, sf_dir)).select("label", "pos", r("x", 6).alias("x"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


_CENTROIDS = f"c AS (SELECT label, pos, avg(x) AS x FROM {_ELEMENTS} GROUP BY label, pos)"


@query(f"""WITH {_CENTROIDS}
    SELECT a.label AS one, b.label AS two, round(sqrt(avg(CASE WHEN a.label = b.label THEN a.x * a.x ELSE (a.x - b.x) * (a.x - b.x) END)), 6) + 0.0 AS distance
    FROM c a JOIN c b ON a.pos = b.pos GROUP BY a.label, b.label""")
def centroid_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.centroid_distances(aggregates.centroids(vectors(spark, sf_dir))).select("one", "two", r("distance", 6).alias("distance"))


@query(f"WITH {_CENTROIDS} SELECT label, round(sqrt(sum(x * x) / count(*)), 6) + 0.0 AS snr FROM c GROUP BY label")
def snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = aggregates.centroids(vectors(spark, sf_dir))
    return means.groupBy("label").agg(r(F.sqrt(F.sum(F.col("x") * F.col("x")) / F.count("*")), 6).alias("snr"))


@query(f"""WITH {_CENTROIDS}, n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM c GROUP BY label)
    SELECT label, round(norm, 6) + 0.0 AS norm, CAST(row_number() OVER (ORDER BY norm DESC, label) - 1 AS INTEGER) AS rank FROM n""")
def norm_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = evaluate.rank_by_norm(aggregates.centroids(vectors(spark, sf_dir)))
    return ranked.select("label", r("norm", 6).alias("norm"), "rank")


@query(f"""WITH {_CENTROIDS},
    d AS (SELECT e.vec_id, e.label, sqrt(sum((e.x - c.x) * (e.x - c.x))) AS d FROM {_ELEMENTS} e JOIN c ON e.label = c.label AND e.pos = c.pos GROUP BY e.vec_id, e.label)
    SELECT label, CAST(sum(CASE WHEN d < 1.0 THEN 1 ELSE 0 END) AS BIGINT) AS inside, CAST(sum(CASE WHEN d < 1.0 THEN 0 ELSE 1 END) AS BIGINT) AS outside FROM d GROUP BY label""")
def outlier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    means = aggregates.centroids(v).withColumnRenamed("x", "m")
    gap = aggregates.elements(v).join(means, ["label", "pos"]).groupBy("snip_id", "label").agg(F.sqrt(F.sum((F.col("x") - F.col("m")) ** 2)).alias("d"))
    near = F.when(F.col("d") < 1.0, 1).otherwise(0)
    return gap.groupBy("label").agg(F.sum(near).alias("inside"), F.sum(1 - near).alias("outside"))


@query(f"""SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, round(sum(a.x * b.x), 4) + 0.0 AS g
    FROM {_ELEMENTS} a JOIN {_ELEMENTS} b ON a.vec_id = b.vec_id GROUP BY a.pos, b.pos""")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.gram(vectors(spark, sf_dir), 64).select("i", "j", r("g").alias("g"))


_ORDER = [3, 1, 4, 0, 5, 9, 2, 6, 8, 7]


@query("SELECT vec_id AS snip_id, CASE label " + " ".join(f"WHEN {old} THEN {i}" for i, old in enumerate(_ORDER)) + " END AS label FROM embeddings")
def relabel_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.relabel(vectors(spark, sf_dir).select("snip_id", "label"), _ORDER)


@query(f"""SELECT e.vec_id AS snip_id, round(sqrt(sum(e.x * e.x)), 5) + 0.0 AS norm, round(max(abs(e.x)), 5) + 0.0 AS largest,
    CAST(list_position(any_value(v.embedding), list_max(any_value(v.embedding))) - 1 AS BIGINT) AS place FROM {_ELEMENTS} e JOIN embeddings v ON e.vec_id = v.vec_id GROUP BY e.vec_id""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("features")
    return vectors(spark, sf_dir).select("snip_id", r(C.norm(x), 5).alias("norm"), r(C.norm_inf(x), 5).alias("largest"), C.argmax(x).alias("place"))


@query("SELECT round(sum(t * value) / sum(value), 4) + 0.0 AS centroid FROM (SELECT event_id + 1 AS t, value FROM events)")
def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_trace(spark, sf_dir).agg(r(F.sum((F.col("t") + 1) * F.col("v")) / F.sum("v")).alias("centroid"))


@query("SELECT event_type AS cell_id, round(quantile_cont(value, 0.5), 4) + 0.0 AS median, round(quantile_cont(value, 0.95), 4) + 0.0 AS p95 FROM events GROUP BY event_type")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.exact_quantiles(events_trains(spark, sf_dir), "amp", (0.5, 0.95), keys=("cell_id",))
    at = lambda q: r(F.max(F.when(F.col("share") == q, F.col("quantile"))))
    return found.groupBy("cell_id").agg(at(0.5).alias("median"), at(0.95).alias("p95"))


@query("SELECT event_type AS cell_id, round(avg(value), 4) + 0.0 AS mean, round(stddev_samp(value), 4) + 0.0 AS std, max(value) AS most, round(var_samp(value), 3) + 0.0 AS variance, count(DISTINCT value) AS n_distinct FROM events GROUP BY event_type")
def residual_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_trains(spark, sf_dir)
    return e.groupBy("cell_id").agg(r(F.avg("amp")).alias("mean"), r(F.stddev_samp("amp")).alias("std"), F.max("amp").alias("most"), r(F.var_samp("amp"), 3).alias("variance"), F.count_distinct("amp").alias("n_distinct"))


@query(f"""SELECT round(sum((v - 50) * (v - 50)) / (2 * 25.0 * 25.0), 2) + 0.0 AS fit, CAST(sum(CASE WHEN v > {LOUD} THEN 1 ELSE 0 END) AS BIGINT) AS spikes,
    round(sum(CASE WHEN v > {LOUD} THEN 1 ELSE 0 END) * 6.9, 2) + 0.0 AS sparsity FROM {TRACE}""")
def objective_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = events_trace(spark, sf_dir)
    left = trace.withColumn("v", F.col("v") - 50)
    spikes = trace.withColumn("amp", F.col("v") - LOUD)
    return aggregates.objective_terms(left, spikes, 25.0, 6.9).select(r("fit", 2).alias("fit"), "spikes", r("sparsity", 2).alias("sparsity"))


@query(f"""WITH m AS (SELECT t, v, lag(v, 1, 0.0) OVER (ORDER BY t) AS w FROM {TRACE})
    SELECT round(avg((v - w) * (v - w)) / var_samp(w) * 100, 3) + 0.0 AS change FROM m""")
def relative_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = windows.shifted(events_trace(spark, sf_dir), 1)
    return aggregates.relative_change(pair, "before", "here").select(r("change", 3).alias("change"))


@query(f"""WITH s AS (SELECT avg(v) AS m, var_pop(v) AS s2 FROM {TRACE})
    SELECT round(avg(-(v - m) * (v - m) / (2 * s2)) - ln(sqrt(2 * pi() * any_value(s2))), 5) + 0.0 AS gaussian,
           round(avg(-abs(v - m) * sqrt(2) / sqrt(s2)) - ln(sqrt(2 * any_value(s2))), 5) + 0.0 AS laplacian FROM {TRACE}, s""")
def noise_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.noise_likelihood(events_trace(spark, sf_dir)).select(r("gaussian", 5).alias("gaussian"), r("laplacian", 5).alias("laplacian"))


# Point processes


_TRAIN = "SELECT event_id, epoch_us(ts) AS t FROM events WHERE event_type = '{}'"
KINDS = ("click", "purchase")


def _train(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return events_trains(spark, sf_dir).where(F.col("cell_id") == kind)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    triggers = _train(spark, sf_dir, KINDS[1]).select(F.col("t").alias("trigger_t"), F.col("event_id").alias("trigger_id"))
    return joins.band_join(_train(spark, sf_dir, KINDS[0]).select("t", "event_id"), triggers, -BAND, BAND)


@query(f"""SELECT e.event_id, g.event_id AS trigger_id, e.t - g.t AS dt FROM ({_TRAIN.format(KINDS[0])}) e
    JOIN ({_TRAIN.format(KINDS[1])}) g ON e.t - g.t BETWEEN -{BAND} AND {BAND}""")
def band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("event_id", "trigger_id", "dt")


_BIN = f"CAST(least(greatest(floor((dt + {BAND}) / (2.0 * {BAND} / 49) + 0.5), 0), 49) AS INTEGER)"


@query(f"""WITH p AS (SELECT e.t - g.t AS dt FROM ({_TRAIN.format(KINDS[0])}) e JOIN ({_TRAIN.format(KINDS[1])}) g ON e.t - g.t BETWEEN -{BAND} AND {BAND})
    SELECT {_BIN} AS bin, CAST(count(*) * CASE WHEN {_BIN} = 49 THEN 2 ELSE 1 END AS BIGINT) AS n FROM p GROUP BY 1""")
def cross_correlogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    triggers = _train(spark, sf_dir, KINDS[1]).select(F.col("t").alias("trigger_t"))
    return aggregates.correlogram(_train(spark, sf_dir, KINDS[0]), triggers, -BAND, BAND).select("bin", F.col("n").cast("long").alias("n"))


@query(f"""WITH p AS (SELECT e.event_type AS cell_id, epoch_us(e.ts) - epoch_us(g.ts) AS dt FROM events e JOIN events g ON e.event_type = g.event_type AND epoch_us(e.ts) - epoch_us(g.ts) BETWEEN -{BAND} AND {BAND})
    SELECT cell_id, {_BIN} AS bin, CAST(count(*) * CASE WHEN {_BIN} = 49 THEN 2 ELSE 1 END AS BIGINT) AS n FROM p WHERE dt <> 0 GROUP BY 1, 2""")
def auto_correlogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_trains(spark, sf_dir).select("cell_id", "t")
    rows = aggregates.correlogram(e, e.withColumnRenamed("t", "trigger_t"), -BAND, BAND, keys=("cell_id",), auto=True)
    return rows.select("cell_id", "bin", F.col("n").cast("long").alias("n"))


@query(f"""WITH {PARTITION},
    c AS (SELECT (start + "end") // 2 AS center, "end" - start + 1 AS width FROM part),
    p AS (SELECT t FROM {TRACE} WHERE v > 150),
    n AS (SELECT p.t, c.center, c.width, row_number() OVER (PARTITION BY p.t ORDER BY abs(p.t - c.center), c.center) AS k FROM p, c)
    SELECT t, CASE WHEN abs(t - center) <= 0.5 + width / 2.0 THEN center END AS center FROM n WHERE k = 1""")
def nearest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events_trace(spark, sf_dir).where("v > 150").select("rec_id", "channel", "t")
    spans = events_partition(spark, sf_dir).withColumnRenamed("len", "width")
    return joins.nearest_join(points, spans, keys=("rec_id", "channel")).select("t", "center")


def est_true(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Loud events as estimates, and the events of users with an even id as truth, by event type."""
    e = events_trains(spark, sf_dir).select("cell_id", F.col("event_id").alias("id"), "t", "amp", "user_id")
    return e.where("amp > 40").drop("user_id"), e.where("user_id % 2 = 0").drop("user_id")


SLACK = 300_000_000

MATCH = f"""
    est AS MATERIALIZED (SELECT event_type AS cell_id, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE value > 40),
    tru AS MATERIALIZED (SELECT event_type AS cell_id, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE user_id % 2 = 0),
    step AS (
        SELECT c.cell_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS est_id, CAST(NULL AS BIGINT) AS true_id FROM (SELECT DISTINCT event_type AS cell_id FROM events) c
        UNION ALL
        SELECT s.cell_id,
               CASE WHEN u.t - e.t < -{SLACK} THEN s.i ELSE s.i + 1 END,
               CASE WHEN u.t - e.t > {SLACK} THEN s.j ELSE s.j + 1 END,
               CASE WHEN u.t - e.t BETWEEN -{SLACK} AND {SLACK} THEN e.id END,
               CASE WHEN u.t - e.t BETWEEN -{SLACK} AND {SLACK} THEN u.id END
        FROM step s JOIN est e ON e.cell_id = s.cell_id AND e.k = s.i JOIN tru u ON u.cell_id = s.cell_id AND u.k = s.j),
    hit AS (SELECT cell_id, est_id, true_id FROM step WHERE est_id IS NOT NULL)"""


@query(f"WITH RECURSIVE {MATCH} SELECT cell_id, est_id, true_id FROM hit")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    est, true = est_true(spark, sf_dir)
    return joins.greedy_match(est, true, -SLACK, SLACK)


@query(f"WITH RECURSIVE {MATCH} SELECT cell_id, id FROM tru WHERE id NOT IN (SELECT true_id FROM hit)")
def complete_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    est, true = est_true(spark, sf_dir)
    return joins.misses(true, joins.greedy_match(est, true, -SLACK, SLACK)).select("cell_id", "id")


@query(f"WITH RECURSIVE {MATCH} SELECT cell_id, id FROM est WHERE id NOT IN (SELECT est_id FROM hit)")
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    est, true = est_true(spark, sf_dir)
    return joins.false_positives(est, joins.greedy_match(est, true, -SLACK, SLACK)).select("cell_id", "id")


@query()
def greedy_match_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    est, true = est_true(spark, sf_dir)
    return joins.greedy_match(est, true, -SLACK, SLACK, by_amplitude=True)


_SCORES = """
    h AS (SELECT cell_id, count(*) AS hits FROM hit GROUP BY cell_id), n AS (SELECT cell_id, count(*) AS n_est FROM est GROUP BY cell_id), u AS (SELECT cell_id, count(*) AS n_true FROM tru GROUP BY cell_id),
    score AS (SELECT u.cell_id, n_true, coalesce(n_est, 0) AS n_est, coalesce(hits, 0) AS hits, n_true - coalesce(hits, 0) AS misses, coalesce(n_est, 0) - coalesce(hits, 0) AS false_positives
              FROM u LEFT JOIN n ON u.cell_id = n.cell_id LEFT JOIN h ON u.cell_id = h.cell_id)"""


@query(f"WITH RECURSIVE {MATCH}, {_SCORES} SELECT * FROM score")
def evaluate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    est, true = est_true(spark, sf_dir)
    return evaluate.score(est, true, SLACK)


@query(f"""WITH RECURSIVE {MATCH}, {_SCORES},
    s AS (SELECT CAST(sum(misses) AS BIGINT) AS misses, CAST(sum(n_true) AS BIGINT) AS n_true, CAST(sum(false_positives) AS BIGINT) AS false_positives, CAST(sum(n_est) AS BIGINT) AS n_est FROM score)
    SELECT *, round(100.0 * misses / n_true, 1) AS miss_percent, round(100.0 * false_positives / n_est, 1) AS fp_percent FROM s""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    est, true = est_true(spark, sf_dir)
    return evaluate.summary(evaluate.score(est, true, SLACK)).drop("line")


THRESHOLDS = {"click": 60.0, "purchase": 80.0, "view": 20.0}


@query("SELECT event_id AS id, event_type AS cell_id, value AS amp FROM events WHERE value > CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items()) + " ELSE -1 END")
def amplitude_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_trains(spark, sf_dir).select(F.col("event_id").alias("id"), "cell_id", "amp")
    return evaluate.prune(e, spark.createDataFrame(list(THRESHOLDS.items()), "cell_id string, threshold double")).select("id", "cell_id", "amp")


@query()
def best_unit_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    est, true = est_true(spark, sf_dir)
    return spark.createDataFrame(joins.best_unit_ordering(est, true, SLACK), "true_cell string, est_cell string")


@query()
def kde_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitudes brought to [0.3, 1] by their greatest."""
    e = events_trains(spark, sf_dir)
    most = e.groupBy("cell_id").agg(F.max("amp").alias("m"))
    return evaluate.auto_thresholds(e.join(most, "cell_id").select("cell_id", (0.3 + 0.7 * F.col("amp") / F.col("m")).alias("amp")))


@query(f"""WITH p AS (SELECT t FROM {TRACE} WHERE v > 150), l AS (SELECT unnest(range(-5, 6)) AS lag)
    SELECT CAST(l.lag AS BIGINT) AS lag, round(sum(x.v) / (SELECT count(*) FROM p), 4) + 0.0 AS avg_v FROM p, l, {TRACE} x WHERE x.t = p.t + l.lag GROUP BY l.lag""")
def event_triggered_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = events_trace(spark, sf_dir)
    return aggregates.triggered_average(trace, trace.where("v > 150"), 5).select("lag", r("avg_v").alias("avg_v"))


@query(f"""WITH p AS (SELECT t FROM {TRACE} WHERE v > 200), l AS (SELECT unnest(range(-4, 5)) AS lag)
    SELECT p.t AS peak, CAST(l.lag AS BIGINT) AS lag, x.v FROM p, l, {TRACE} x WHERE x.t = p.t + l.lag""")
def snippet_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = events_trace(spark, sf_dir)
    return joins.gather(trace, trace.where("v > 200"), 4).select("peak", "lag", "v")


_TAPS = [0.1, -0.25, 0.5, -0.25, 0.1]


@query("WITH w AS (SELECT t, " + " + ".join(f"({tap}) * lag(v, {k}, 0.0) OVER (ORDER BY t)" if k else f"({tap}) * v" for k, tap in enumerate(_TAPS)) + f" AS y FROM {TRACE}) SELECT t, round(y, 6) + 0.0 AS y FROM w")
def fir_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.fir(events_trace(spark, sf_dir), _TAPS).select("t", r("y", 6).alias("y"))


@query("WITH w AS (SELECT t, " + " + ".join(f"({tap}) * lead(v, {k}, 0.0) OVER (ORDER BY t)" if k else f"({tap}) * v" for k, tap in enumerate([1.0, 2.0, 3.0, 2.0, 1.0])) + f" AS y FROM {TRACE}) SELECT t, round(y, 6) + 0.0 AS y FROM w")
def template_xcorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.fir(events_trace(spark, sf_dir), [1.0, 2.0, 3.0, 2.0, 1.0], advance=4).select("t", r("y", 6).alias("y"))


_FREQS = (0.01, 0.05, 0.125)


@query(" UNION ALL ".join(f"SELECT CAST({f} AS DOUBLE) AS freq, round(sqrt(pow(sum(v * cos(t * 2 * 3.141592653589793 * {f})), 2) + pow(sum(v * sin(t * 2 * 3.141592653589793 * {f})), 2)), 2) + 0.0 AS magnitude FROM {TRACE}" for f in _FREQS))
def spectrum_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.spectrum(events_trace(spark, sf_dir), _FREQS, 1.0).select("freq", r("magnitude", 2).alias("magnitude"))




# Sparse matrices and sets


@query("SELECT CAST(l_suppkey AS BIGINT) AS i, round(sum(l_quantity * (o_totalprice / 1000)), 2) + 0.0 AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey")
def sparse_matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lineitem_channels(spark, sf_dir).select(F.col("l_suppkey").alias("i"), F.col("l_orderkey").alias("j"), F.col("l_quantity").alias("v"))
    x = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("j"), (F.col("o_totalprice") / 1000).alias("x"))
    return aggregates.matvec(m, x).select("i", r("y", 2).alias("y"))


@query("SELECT l_suppkey AS i, l_orderkey AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2")
def sparse_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lineitem_channels(spark, sf_dir).groupBy(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("v"))
    return aggregates.transpose(m)


_A, _B = "SELECT user_id FROM events WHERE event_type = 'click'", "SELECT user_id FROM events WHERE value > 150"


def _users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events_trains(spark, sf_dir)
    return e.where("cell_id = 'click'").select("user_id"), e.where("amp > 150").select("user_id")


@query(f"SELECT user_id, count(*) AS n FROM ({_A} UNION ALL {_B}) GROUP BY user_id")
def train_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _users(spark, sf_dir)
    return a.unionByName(b).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT user_id FROM ({_A})")
def train_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users(spark, sf_dir)[0].distinct()


@query(f"{_A} EXCEPT {_B}")
def train_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _users(spark, sf_dir)
    return a.subtract(b)


@query(f"{_A} INTERSECT {_B}")
def train_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _users(spark, sf_dir)
    return a.intersect(b)


@query("SELECT user_id, rank FROM (SELECT user_id, CAST(unnest(range(n % 4)) AS INTEGER) AS rank FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id))")
def repeat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = events_trains(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.posexplode(F.array_repeat("user_id", (F.col("n") % 4).cast("int"))).alias("rank", "_x")).drop("_x")


@query("SELECT user_id, event_id AS id, epoch_us(ts) + 1000 AS t, value AS amp FROM events WHERE value > 100")
def flatten_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged rows by user and day, built and taken apart again with the amplitude threshold."""
    e = events_trains(spark, sf_dir)
    day = F.floor(F.col("t") / 86_400_000_000) * 86_400_000_000
    found = F.struct(F.col("event_id").alias("cell_id"), (F.col("t") - day + 1000).alias("offset"), "amp")
    ragged = e.groupBy(F.col("user_id").alias("snip_id"), day.alias("center")).agg(F.collect_list(found).alias("found"))
    return aggregates.flatten_spikes(ragged, 100.0).select(F.col("snip_id").alias("user_id"), F.col("cell_id").alias("id"), "t", "amp")
