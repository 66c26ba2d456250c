"""More of the catalogue: small projections, thresholds in scoring, orderings and sweeps, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark.functions import columns as C
from sigspark.operators import aggregates, evaluate, fourier, joins, windows
from sigspark.plans.catalog import MATCH, THRESHOLDS, LOUD, PAD, SILENCE, SLACK, TRACE, est_true, events_partition, PARTITION, query, r
from sigspark.sources.recordings import events_trace, events_trains, vectors

_X = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


# Shapes of traces and vectors


@query(f"""WITH x AS (SELECT min(t) AS a, max(t) AS b, arg_min(v, t) AS va, arg_max(v, t) AS vb FROM {TRACE})
    SELECT t, v FROM {TRACE} UNION ALL SELECT a - k, va FROM x, (SELECT unnest(range(1, 6)) AS k) UNION ALL SELECT b + k, vb FROM x, (SELECT unnest(range(1, 6)) AS k)""")
def pad_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.padded(events_trace(spark, sf_dir), 5).select("t", "v")


@query(f"""WITH x AS (SELECT min(t) AS a, count(*) AS n FROM {TRACE})
    SELECT a + (t - a + 3) % n AS t, v FROM {TRACE}, x""")
def shift_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rotated(events_trace(spark, sf_dir), 3).select("t", "v")


@query("""WITH d AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, array_to_string(list(n ORDER BY day), ',') AS lengths, CAST(sum(n) AS BIGINT) AS total FROM d GROUP BY user_id""")
def ragged_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a user as a ragged array of arrays: its lengths, and the size of it flattened and cut again."""
    e = events_trains(spark, sf_dir)
    days = e.groupBy("user_id", F.floor(F.col("t") / 86_400_000_000).alias("day")).agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    cells = days.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "ids"))), lambda x: x["ids"]).alias("cells"))
    cells = cells.withColumn("lengths", C.ragged_lengths(F.col("cells")))
    back = cells.withColumn("again", C.ragged(C.flat(F.col("cells")), F.col("lengths")))
    return back.where("again = cells").select("user_id", F.array_join("lengths", ",").alias("lengths"), F.size(C.flat(F.col("again"))).cast("long").alias("total"))


@query("SELECT vec_id AS snip_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(embedding[c * 16 + r + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(16)) AS r), (SELECT unnest(range(4)) AS c)")
def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("snip_id", F.posexplode(C.matrix_rows(F.col("features"), 16, 4)).alias("row", "x"))
    return rows.select("snip_id", "row", F.posexplode("x").alias("col", "x"))


@query(f"""WITH e AS (SELECT vec_id, {_X} AS x, list_transform({_X}, lambda x: abs(x)) AS m FROM embeddings),
    s AS (SELECT vec_id, x, [list_position(m, list_max(m)), list_position(x, list_max(x)), list_position(x, list_min(x))] AS p,
                 round(list_sum(list_transform(m, lambda y, i: y * i)) / list_sum(m)) AS c FROM e),
    a AS (SELECT vec_id, x, unnest(['peak', 'max', 'min', 'centroid', 'biphasic']) AS mode, unnest([p[1], p[2], p[3], c, floor((p[2] + p[3]) / 2.0 + 0.5)]) AS place FROM s)
    SELECT vec_id AS snip_id, mode, CAST(place AS BIGINT) AS place, round(CASE WHEN place > 2 THEN x[CAST(place AS BIGINT) - 2] ELSE 0 END, 5) + 0.0 AS first, round(x[CAST(place AS BIGINT)], 5) + 0.0 AS middle, round(coalesce(x[CAST(place AS BIGINT) + 2], 0), 5) + 0.0 AS last FROM a""")
def align_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five samples around the peak of each vector in each alignment mode."""
    v, x = vectors(spark, sf_dir), F.col("features")
    modes = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), C.peak_place(x, m).alias("place"), C.align_peak(x, 5, m).alias("w")) for m in C.PEAK_MODES))).alias("a")
    rows = v.select("snip_id", modes).select("snip_id", "a.mode", F.col("a.place").cast("long").alias("place"), "a.w")
    return rows.select("snip_id", "mode", "place", *(r(F.col("w")[k], 5).alias(n) for k, n in ((0, "first"), (2, "middle"), (4, "last"))))


@query(f"""WITH e AS (SELECT vec_id, {_X} AS x FROM embeddings), m AS (SELECT vec_id, x, list_max(list_transform(x, lambda y: abs(y))) AS top FROM e),
    f AS (SELECT vec_id, x, list_filter(range(1, 65), lambda i: abs(x[i]) > 0.5 * top) AS big FROM m), c AS (SELECT vec_id, x, least(list_min(big) - 1, 64 - list_max(big)) AS cut FROM f)
    SELECT vec_id AS snip_id, CAST(cut AS BIGINT) AS cut, CAST(64 - 2 * cut + 2 * 6 + 1 AS BIGINT) AS n, round(list_sum(x[CAST(cut + 1 AS BIGINT):CAST(64 - cut AS BIGINT)]), 4) + 0.0 AS total FROM c""")
def resize_waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends under half of the peak cut evenly, six zeros put on both sides, and made odd."""
    cut = C.snip_ends(F.col("features"), 0.5)
    rows = vectors(spark, sf_dir).select("snip_id", cut.cast("long").alias("cut"), C.resized(F.col("features"), cut, 6).alias("w"))
    return rows.select("snip_id", "cut", F.size("w").cast("long").alias("n"), r(F.aggregate("w", F.lit(0.0), lambda s, y: s + y)).alias("total"))


_TRIMMED = f"""
    e AS (SELECT vec_id, label, {_X} AS x FROM embeddings), m AS (SELECT vec_id, label, x, list_max(list_transform(x, lambda y: abs(y))) AS top FROM e),
    f AS (SELECT vec_id, label, list_filter(range(1, 65), lambda i: abs(x[i]) > 0.5 * top) AS big FROM m), n AS (SELECT vec_id, label, 77 - 2 * least(list_min(big) - 1, 64 - list_max(big)) AS n FROM f)"""


def _trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waveform lengths of vectors whose ends under half of the peak are cut evenly, with six samples of margin."""
    cut = C.snip_ends(F.col("features"), 0.5)
    return vectors(spark, sf_dir).select("snip_id", "label", (77 - 2 * cut).alias("n"))


@query(f"WITH {_TRIMMED} SELECT vec_id AS snip_id, CAST(unnest(range(-CAST(n // 2 AS BIGINT), CAST(n // 2 AS BIGINT) + 1, CAST(3 + label AS BIGINT))) AS BIGINT) AS grid FROM n")
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of shifts over each waveform's length, whose spacing is its cluster's."""
    points = C.uniform_grid([F.col("n")], [3 + F.col("label")])
    return _trimmed(spark, sf_dir).select("snip_id", F.explode(points).alias("x")).select("snip_id", F.col("x")[0].alias("grid"))


@query(f"""WITH {_TRIMMED}, x AS (SELECT vec_id, n, unnest(range(-CAST(n // 2 AS BIGINT), CAST(n // 2 AS BIGINT) + 1, CAST(9 + label AS BIGINT))) AS x FROM n)
    SELECT vec_id AS snip_id, x, unnest(range(-7, 8, 5)) AS y FROM x""")
def grid_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a second dimension of fifteen places."""
    points = C.uniform_grid([F.col("n"), F.lit(15)], [9 + F.col("label"), F.lit(5)])
    return _trimmed(spark, sf_dir).select("snip_id", F.explode(points).alias("p")).select("snip_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query(f"SELECT vec_id AS snip_id, round(2 * CAST(embedding[1] AS DOUBLE) + CAST(embedding[64] AS DOUBLE), 5) + 0.0 AS first, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(embedding[65 - i] AS DOUBLE))), 4) + 0.0 AS folded FROM embeddings WHERE NOT list_contains({_X}, CAST('nan' AS DOUBLE))")
def vector_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 x + its mirror image, and the product of both, of vectors without NaN."""
    x = F.col("features")
    v = vectors(spark, sf_dir).where(~C.has_nan(x))
    return v.select("snip_id", r(C.axpy(2.0, x, F.reverse(x))[0], 5).alias("first"), r(C.dot(x, F.reverse(x))).alias("folded"))


@query(f"""WITH x AS (SELECT t - min(t) OVER () AS i, v, count(*) OVER () AS n FROM {TRACE}), k AS (SELECT unnest(range(n // 2 + 1)) AS k, n FROM (SELECT count(*) AS n FROM events)),
    m AS (SELECT k, k.n, sqrt(pow(sum(v * cos(2 * pi() * ((k * i) % k.n) / k.n)), 2) + pow(sum(v * sin(2 * pi() * ((k * i) % k.n) / k.n)), 2)) AS m FROM k, x GROUP BY k, k.n)
    SELECT k AS bin, round(m, 2) + 0.0 AS magnitude FROM m UNION ALL SELECT n - k, round(m, 2) + 0.0 FROM m WHERE k > 0 AND 2 * k < n""")
def spectrum_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every Fourier term of the whole trace."""
    return fourier.magnitude_spectrum(events_trace(spark, sf_dir)).select("bin", r("magnitude", 2).alias("magnitude"))


_SMOOTHED = f"""
    x0 AS (SELECT t, abs(v) AS v, least(2, t - min(t) OVER (), max(t) OVER () - t) AS h FROM {TRACE}),
    smooth AS (SELECT a.t, avg(b.v) AS v FROM x0 a JOIN x0 b ON b.t BETWEEN a.t - a.h AND a.t + a.h GROUP BY a.t),
    level AS (SELECT 3 * stddev_samp(v) AS level FROM smooth)"""


@query("WITH " + _SMOOTHED + "," + PARTITION.replace(f"FROM {TRACE} WHERE NOT v > {LOUD}", "FROM smooth, level WHERE NOT v > level").replace(TRACE, "smooth") + ' SELECT start, "end", "end" - start + 1 AS len, (start + "end") // 2 AS center FROM part')
def smoothed_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of the smoothed magnitude over three of its standard deviations."""
    found = windows.partition_signal(events_trace(spark, sf_dir), smooth_len=5, stds=3.0, min_silence=SILENCE, pad=PAD)
    return found.select("start", "end", "len", "center")


# Ranges, order, prefixes


@query(f"WITH {PARTITION} SELECT start, t, v FROM part JOIN {TRACE} e ON e.t BETWEEN start AND \"end\"")
def interval_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.gather_intervals(events_trace(spark, sf_dir), events_partition(spark, sf_dir)).select("start", "t", "v")


@query(f"SELECT t, v FROM {TRACE} WHERE t > 100 AND t < 220")
def display_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = events_trace(spark, sf_dir)
    return trace.where((F.col("t") > 100) & (F.col("t") < 220)).select("t", "v")


@query("""WITH k AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS a, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS z FROM events WHERE value > 100)
    SELECT event_type AS cell_id, 'first' AS side, a AS place, event_id FROM k WHERE a <= 5 UNION ALL SELECT event_type, 'last', z, event_id FROM k WHERE z <= 5""")
def first_last_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last five events of a type over a level, by order of id."""
    loud = events_trains(spark, sf_dir).where("amp > 100").select("cell_id", "event_id")
    return aggregates.first_last(loud, "event_id", 5, keys=("cell_id",)).select("cell_id", "side", "place", "event_id")


@query()
def sample_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten events of each type, drawn without replacement: the same ones from any partitioning."""
    e = events_trains(spark, sf_dir).select("cell_id", "event_id")
    return aggregates.sample_without_replacement(e, 10, ["event_id"], keys=("cell_id",), seed=7).select("cell_id", "event_id")


@query("""SELECT event_type AS cell_id, min(event_id) FILTER (WHERE value > 100) AS first, max(event_id) FILTER (WHERE value > 100) AS last FROM events GROUP BY event_type""")
def first_last_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = F.when(F.col("amp") > 100, F.col("event_id"))
    return events_trains(spark, sf_dir).groupBy("cell_id").agg(F.min(loud).alias("first"), F.max(loud).alias("last"))


@query("SELECT event_id AS id, dense_rank() OVER (ORDER BY event_type) AS class, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events")
def train_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trains as one, in the order of their times, carrying the class."""
    from sigspark.operators.signal import numbered

    e = events_trains(spark, sf_dir)
    kinds = e.select("cell_id").distinct().withColumn("class", F.row_number().over(Window.orderBy("cell_id")))  # a few
    ordered = numbered(e.withColumn("_all", F.lit(0)), ["t", "event_id"], keys=("_all",), block=3_600_000_000)
    return ordered.withColumnRenamed("t", "place").join(F.broadcast(kinds), "cell_id").select(F.col("event_id").alias("id"), F.col("class").cast("long").alias("class"), "place")


@query("WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, n, CAST(coalesce(sum(n) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM n")
def prefix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.prefix_index(events_trains(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "n")


@query("""WITH h AS (SELECT CAST(floor(value / 10) AS INTEGER) AS rank, count(*) AS n FROM events GROUP BY 1),
    s AS (SELECT rank, 100.0 * sum(n) OVER (ORDER BY rank) / sum(n) OVER () AS share FROM h) SELECT CAST(greatest(min(rank), 2) AS INTEGER) AS kept FROM s WHERE share > 80""")
def cumulative_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = events_trace(spark, sf_dir).groupBy(F.floor(F.col("v") / 10).cast("int").alias("rank")).agg(F.count("*").alias("n"))
    return windows.cumulative_cutoff(bins, 80.0, value="n").select(F.col("kept").cast("int").alias("kept"))


@query("""WITH k AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS place FROM events)
    SELECT event_type AS cell_id, place // 100 AS block, min(place) AS start, count(*) AS n, array_to_string(list(event_id ORDER BY place), ',') AS ids, round(avg(CASE WHEN value > 40 THEN 1 ELSE 0 END), 6) AS share FROM k GROUP BY 1, 2""")
def pooled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values pooled over days by type in their order, in blocks of a hundred (ids of them), and the share over a level."""
    e = events_trains(spark, sf_dir).select("cell_id", "amp", "event_id")
    pooled = aggregates.pooled(e, "amp", "event_id", 100, keys=("cell_id",))
    over = F.size(F.filter("values", lambda x: x["amp"] > 40)) / F.col("n")
    return pooled.select("cell_id", "block", "start", "n", F.array_join(F.transform("values", lambda x: x["event_id"]), ",").alias("ids"), F.round(over, 6).alias("share"))


@query("""SELECT event_id, round(exp(-pow((value - 50) / 25, 2) / 2) / sqrt(2 * pi()), 6) + 0.0 AS pdf,
    CAST(floor(abs(value - 3) / 7.0 + 0.5) * sign(value - 3) AS INTEGER) AS place, round(least(1e6, 1 / (value / 1e3)), 4) + 0.0 AS penalty FROM events WHERE value > 0""")
def scalar_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_trains(spark, sf_dir).where("amp > 0")
    x = F.col("amp")
    return e.select("event_id", r(C.normal_pdf((x - 50) / 25), 6).alias("pdf"), C.lattice_index(x, 3.0, 7.0).alias("place"), r(C.rate_penalty(x / 1e3)).alias("penalty"))


# Scoring


_LEVELS = [40.0, 60.0, 80.0, 120.0, 200.0]
_PRUNED = MATCH.replace("WHERE value > 40", "WHERE value > 40 AND value > CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items()) + " ELSE -1 END")


def _summed(keys: str, true: str = "tru") -> str:
    on = lambda t: " AND ".join(f"u.{k} = {t}.{k}" for k in keys.split(", "))
    return f"""
    h AS (SELECT {keys}, count(*) AS hits FROM hit GROUP BY {keys}), n AS (SELECT {keys}, count(*) AS n_est FROM est GROUP BY {keys}), u AS (SELECT {keys}, count(*) AS n_true FROM {true} GROUP BY {keys}),
    score AS (SELECT {", ".join("u." + k for k in keys.split(", "))}, n_true, coalesce(n_est, 0) AS n_est, coalesce(hits, 0) AS hits, n_true - coalesce(hits, 0) AS misses, coalesce(n_est, 0) - coalesce(hits, 0) AS false_positives
              FROM u LEFT JOIN n ON {on('n')} LEFT JOIN h ON {on('h')})"""


@query(f"WITH RECURSIVE {_PRUNED}, {_summed('cell_id')} SELECT * FROM score")
def evaluate_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the estimates that pass their unit's amplitude threshold."""
    est, true = est_true(spark, sf_dir)
    return evaluate.score(est, true, SLACK, spark.createDataFrame(list(THRESHOLDS.items()), "cell_id string, threshold double"))


_ROC = f"""
    levels AS (SELECT CAST(unnest({_LEVELS}) AS DOUBLE) AS threshold),
    est AS MATERIALIZED (SELECT event_type AS cell_id, threshold, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type, threshold ORDER BY ts, event_id) AS k FROM events, levels WHERE value > 40 AND value > threshold),
    tru AS MATERIALIZED (SELECT event_type AS cell_id, threshold, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type, threshold ORDER BY ts, event_id) AS k FROM events, levels WHERE user_id % 2 = 0),
    step AS (
        SELECT c.cell_id, c.threshold, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS est_id FROM (SELECT DISTINCT cell_id, threshold FROM tru) c
        UNION ALL
        SELECT s.cell_id, s.threshold, CASE WHEN u.t - e.t < -{SLACK} THEN s.i ELSE s.i + 1 END, CASE WHEN u.t - e.t > {SLACK} THEN s.j ELSE s.j + 1 END,
               CASE WHEN u.t - e.t BETWEEN -{SLACK} AND {SLACK} THEN e.id END
        FROM step s JOIN est e ON e.cell_id = s.cell_id AND e.threshold = s.threshold AND e.k = s.i JOIN tru u ON u.cell_id = s.cell_id AND u.threshold = s.threshold AND u.k = s.j),
    hit AS (SELECT cell_id, threshold, est_id FROM step WHERE est_id IS NOT NULL), {_summed('cell_id, threshold')}"""


@query(f"WITH RECURSIVE {_ROC} SELECT *, round(100.0 * misses / n_true, 4) + 0.0 AS miss_rate, CASE WHEN n_est > 0 THEN round(100.0 * false_positives / n_est, 4) + 0.0 END AS fp_rate FROM score")
def roc_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep of thresholds with the percentages that a ROC shows."""
    est, true = est_true(spark, sf_dir)
    rows = evaluate.threshold_roc(est, true, SLACK, levels=_LEVELS)
    rate = lambda a, b: F.when(F.col(b) > 0, r(100.0 * F.col(a) / F.col(b)))
    return rows.withColumn("miss_rate", rate("misses", "n_true")).withColumn("fp_rate", rate("false_positives", "n_est"))


@query(f"WITH RECURSIVE {_ROC} SELECT * FROM score")
def threshold_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    est, true = est_true(spark, sf_dir)
    return evaluate.threshold_roc(est, true, SLACK, levels=_LEVELS).select("cell_id", "threshold", "n_true", "n_est", "hits", "misses", "false_positives")


@query()
def roc_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores at every amplitude of every unit as its threshold."""
    est, true = est_true(spark, sf_dir)
    rows = evaluate.amplitude_roc(est, true, SLACK)
    return rows.withColumns({c: r(c, 6) for c in ("miss_rate", "fp_rate")})


@query()
def roc_auto_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point of all units at their automatic thresholds, which come from densities of amplitudes scaled to [0.3, 1]."""
    est, true = est_true(spark, sf_dir)
    most = est.groupBy("cell_id").agg(F.max("amp").alias("m"))
    scaled = est.join(most, "cell_id").withColumn("amp", 0.3 + 0.7 * F.col("amp") / F.col("m")).drop("m")
    return evaluate.summary(evaluate.score(scaled, true, SLACK, evaluate.auto_thresholds(scaled))).drop("line")


@query()
def evaluate_best_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores under the pairing of units of least misses plus false positives, with thresholds that follow their unit."""
    est, true = est_true(spark, sf_dir)
    moved = est.replace({"click": "purchase", "purchase": "view", "view": "click"}, subset=["cell_id"])
    thresholds = spark.createDataFrame([("purchase", 60.0), ("view", 80.0), ("click", 20.0)], "cell_id string, threshold double")
    return evaluate.score_best_order(moved, true, SLACK, thresholds)


@query()
def reorder_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True events with the names of the estimated units that they fit best."""
    est, true = est_true(spark, sf_dir)
    moved = est.replace({"click": "purchase", "purchase": "view", "view": "click"}, subset=["cell_id"])
    return evaluate.reorder_truth(moved, true, SLACK).select("cell_id", "id", "t")


@query(f"""WITH p AS (SELECT event_id, CAST(event_id AS DOUBLE) + 0.25 AS t FROM events WHERE value > 150), l AS (SELECT unnest(range(-5, 6)) AS lag),
    w AS (SELECT l.lag, 0.75 * coalesce(a.v, 0) + 0.25 * coalesce(b.v, 0) AS v, a.v IS NULL OR b.v IS NULL AS outside FROM p CROSS JOIN l LEFT JOIN {TRACE} a ON a.t = p.event_id + l.lag LEFT JOIN {TRACE} b ON b.t = p.event_id + l.lag + 1)
    SELECT CAST(lag AS BIGINT) AS lag, round(sum(CASE WHEN outside THEN 0 ELSE v END) / count(*), 4) + 0.0 AS avg_v FROM w GROUP BY lag""")
def interpolated_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average of the trace around times between samples, by straight lines; 0 outside of it."""
    trace = events_trace(spark, sf_dir)
    at = trace.where("v > 150").select("rec_id", "channel", (F.col("t") + 0.25).alias("t"))
    return aggregates.interpolated_average(trace, at, 5, kind="linear").select("lag", r("avg_v").alias("avg_v"))


@query()
def spline_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by cubic splines through 23 samples around each time."""
    trace = events_trace(spark, sf_dir)
    at = trace.where("v > 150").select("rec_id", "channel", (F.col("t") + 0.25).alias("t"))
    return aggregates.interpolated_average(trace, at, 5, kind="spline").select("lag", r("avg_v").alias("avg_v"))
