"""All queries of the engine over the driver's tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurva import sql
from recurva.functions.distance import DISTANCES, normalised
from recurva.operators import alignment, cuts, graph, latent, metrics, motifs, occurrences, profile, reports, symbolic
from recurva.plans import series as S

M, RADIUS, LENGTHS, THRESHOLDS = 8, 1.5, [6, 8, 10], [0.0, 0.25, 0.5, 0.75, 1.0]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else f.name for f in df.schema))


def on_events(name: str, oracle: str | None, f: Callable[[DataFrame], DataFrame], digits: int = 6) -> None:
    query(name, oracle)(lambda spark, sf_dir: _rounded(f(S.events(spark, sf_dir)), digits))


def _round(x: Column, digits: int = 6) -> Column:
    """Rounded as SQL and numpy do it: what is negative and rounds to nothing stays -0.0, which tells arrays apart."""
    return F.when(x < 0, -F.round(-x, digits)).otherwise(F.round(x, digits))


on_events("series_index", sql.series_index(), lambda s: s)
on_events("window_mean_std", sql.rolling("mean", "std"), lambda s: S.rolling(s, M).select("series_id", "i", "mean", "std"))
on_events("window_energy", sql.rolling("energy"), lambda s: S.rolling(s, M).select("series_id", "i", "energy"))
on_events("window_slope", sql.rolling("slope"), lambda s: S.rolling(s, M).select("series_id", "i", "slope"))
on_events("window_detrended_norm", sql.rolling("detrended_norm"), lambda s: S.rolling(s, M).select("series_id", "i", "detrended_norm"))
on_events("window_median", sql.robust("median"), lambda s: S.robust(s, M).select("series_id", "i", "median"))
on_events("window_mad", sql.robust("mad"), lambda s: S.robust(s, M).select("series_id", "i", "mad"))
on_events("window_znorm", sql.window_znorm(), lambda s: normalised(s, M, "unit").select("series_id", "i", F.transform("x", lambda v: _round(v * M**0.5)).alias("z")))
for _name in DISTANCES:
    on_events(f"dist_{_name}", sql.pairs(_name), partial(lambda s, n: profile.pairs(s, M, n), n=_name), 5)
    on_events(f"profile_{_name}", sql.profile(_name), partial(lambda s, n: profile.profile(s, M, n), n=_name))
on_events("profile_topk", sql.top_k(), lambda s: profile.nearest(s, M, 3))
on_events("profile_multi_length", sql.multi_length(), lambda s: profile.multi_length(s, LENGTHS))
on_events("top_motif_pair", sql.top_pair(), lambda s: profile.top_pair(profile.profile(s, M)))
on_events("top_discords", sql.discords(), lambda s: profile.discords(profile.profile(s, M)))
on_events("knn_k1", sql.knn_k1(), lambda s: graph.knn_graph(s, M, 1, "trend", digits=6))
on_events("knn_k2_time", sql.knn_k2(), lambda s: graph.knn_graph(s, M, 2, "trend", "time", digits=6))
on_events("knn_k3", sql.knn_k3(), lambda s: graph.knn_graph(s, M, 3, "trend"))


def _knn1(s: DataFrame) -> DataFrame:
    return graph.knn_graph(s, M, 1, "trend", digits=6)


on_events("edges_similarity", sql.edges("alike"), lambda s: graph.similarity_edges(_knn1(s)))
on_events("edges_temporal", sql.edges("temporal"), lambda s: graph.temporal_edges(_knn1(s)))
on_events("filtration_order", sql.filtration(), lambda s: graph.filtration(_knn1(s)))
on_events("node_births", sql.births(), lambda s: graph.node_births(graph.filtration(_knn1(s))))
on_events("components_at_t", sql.components(0.6), lambda s: graph.components_at(graph.persistence(graph.filtration(_knn1(s))), 0.6))
on_events("h0_pairs", sql.h0_pairs(), lambda s: graph.finite(graph.persistence(graph.filtration(graph.knn_graph(s, M, 3)))).select("series_id", "seed", "birth", "death"))
on_events("h0_pairs_by_rounds", sql.h0_pairs(), lambda s: graph.finite(graph.persistence_by_rounds(graph.filtration(graph.knn_graph(s, M, 3)))).select("series_id", "seed", "birth", "death"))
on_events("mst_edges", sql.mst_edges(), lambda s: graph.persistence(graph.filtration(graph.knn_graph(s, M, 3))).where("w IS NOT NULL").select("series_id", "u", "v", "w"))


def _profile(s: DataFrame) -> DataFrame:
    return profile.profile(s, M, "trend")


on_events("ktanh_profile", sql.ktanh(), lambda s: _profile(s).select("series_id", "i", cuts.ktanh(F.col("dist"), 10.0).alias("stretched")))
on_events("otsu_profile", sql.otsu(), lambda s: cuts.otsu(_profile(s), "dist"))
on_events("gap_cut_profile", sql.gap_cut(), lambda s: cuts.gap_cut(_profile(s), "dist", 2), 7)
on_events("fixed_n_cut", sql.top_n_cut(), lambda s: cuts.top_n_cut(_profile(s), "dist", 5), 7)


def _pers(s: DataFrame) -> DataFrame:
    return graph.finite(graph.persistence(graph.filtration(graph.knn_graph(s, M, 3)))).select("series_id", "birth", "death")


on_events("split_cuts", sql.split_cuts(), lambda s: cuts.split_cuts(_pers(s)))
on_events("split_cuts_skewed", sql.split_cuts(skewed=True), lambda s: cuts.split_cuts(_pers(s), "skewed"))
on_events("outlier_cuts", sql.outlier_cuts(), lambda s: cuts.outlier_cuts(_pers(s), 0.9))
on_events("plane_cuts_skewed", sql.plane_cuts(skewed=True), lambda s: cuts.plane_cuts(_pers(s), kind="skewed"))
on_events("plane_cuts", sql.plane_cuts(), lambda s: cuts.plane_cuts(_pers(s)))
on_events("mad_outliers", sql.mad_outliers(), lambda s: cuts.mad_outliers(_profile(s), "dist", 2.0).select("series_id", "i", "dist"))
on_events("normal_outliers", sql.normal_outliers(), lambda s: cuts.normal_outliers(_profile(s), "dist", 0.95).select("series_id", "i", "dist"))


def _mean() -> Column:
    """The mean of a series, summed in the order of idx: where a value equals it, any other order of the sum may decide
    otherwise whether it lies above."""
    whole = Window.partitionBy("series_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.avg("value").over(whole)


def _truth(s: DataFrame) -> DataFrame:
    """Runs of values above their series' mean, labelled by tens of samples."""
    above = s.withColumn("mean", _mean()).where("value > mean")
    return occurrences.islands(above.select("series_id", (F.floor(F.col("idx") / 10) % 3).alias("label"), "idx"))


def _found(s: DataFrame) -> DataFrame:
    """The same of means of three samples, labelled otherwise."""
    three = s.select("series_id", "idx", F.avg("value").over(S.frame(3).rowsBetween(-1, 1)).alias("value"), _mean().alias("mean"))
    return occurrences.islands(three.where("value > mean").select("series_id", (F.floor(F.col("idx") / 10) % 2).alias("label"), "idx"))


def _grouped(s: DataFrame) -> DataFrame:
    """Windows of the profile with a distance below 1, labelled by the tens of their place."""
    return _profile(s).where("dist < 1").select("series_id", (F.floor(F.col("i") / 10) % 3).alias("label"), F.col("i").alias("node"), F.col("dist").alias("birth"))


on_events("islands", sql.TRUTH, _truth)
on_events("similar_length", sql.similar_length(), lambda s: occurrences.similar_length(_truth(s)))
on_events("drop_singletons", sql.drop_singletons(), lambda s: occurrences.without_singletons(_truth(s)))
on_events("occurrence_masks", sql.masks(), lambda s: occurrences.masks(_truth(s), s))
on_events("interval_births", sql.interval_births(4), lambda s: occurrences.with_births(_truth(s), profile.profile(s, 4, "trend"), 4))
on_events("motif_occurrences", sql.persistent_motifs(), lambda s: motifs.persistent_motifs(s, M))
on_events("motif_occurrences_fixed", sql.persistent_motifs(n=3), lambda s: motifs.persistent_motifs(s, M, n=3))
on_events("extended_runs", sql.extended_runs(), lambda s: occurrences.extended(_grouped(s), M, 1))
on_events("radius_rank", sql.radius_rank(), lambda s: motifs.radius_counts(s, M, RADIUS))
on_events("radius_motifs", sql.radius_motifs(), lambda s: motifs.radius_motifs(s, M, RADIUS, 3))
on_events("mp_motifs", sql.profile_motifs(), lambda s: motifs.profile_motifs(s, M, 3, 1.2))
on_events("multi_length_motifs", sql.multi_length_motifs(LENGTHS), lambda s: motifs.multi_length_motifs(s, LENGTHS, 3, 1.2))
on_events("pan_motifs", sql.seeded_motifs(LENGTHS), lambda s: motifs.seeded_motifs(s, LENGTHS, 3, 1.2))
on_events("pair_motifs", sql.seeded_motifs(LENGTHS, paired=True), lambda s: motifs.seeded_motifs(s, LENGTHS, 3, 1.2, paired=True))
on_events("latent_motifs", None, lambda s: motifs.latent_motifs(s, M, 3, 0.5))
on_events("latent_motifs_by_rounds", None, lambda s: latent.latent_by_rounds(s, M, 3, 0.5, rounds=5))
on_events("grammar_motifs", None, lambda s: symbolic.grammar_motifs(s, M, 4, 3, 3))
on_events("paa", sql.paa(), lambda s: symbolic.paa(s, M, 4).select("series_id", "i", *(F.col("means")[k].alias(f"p{k}") for k in range(4))))
on_events("sax_words", sql.sax("words"), lambda s: symbolic.words(s, M, 4, 3))
on_events("numerosity_reduction", sql.sax("reduced"), lambda s: symbolic.without_repeats(symbolic.words(s, M, 4, 3)))
on_events("sax_bigrams", sql.sax("bigrams"), lambda s: symbolic.bigrams(symbolic.words(s, M, 4, 3)))
on_events("sample_prf", sql.sample_prf(), lambda s: metrics.sample_scores(_truth(s), _found(s)))
on_events("event_overlap_matrix", sql.overlaps(), lambda s: metrics.overlaps(_truth(s), _found(s)))
on_events("label_overlaps", sql.label_overlaps(), lambda s: metrics.label_overlaps(_truth(s), _found(s)))
on_events("contingency", sql.contingency(), lambda s: metrics.contingency(_truth(s), _found(s), s))
on_events("matched_labels", sql.matched_labels(), lambda s: metrics.matched_labels(_truth(s), _found(s)))
on_events("matched_samples", sql.matched_samples(), lambda s: metrics.matched_samples(_truth(s), _found(s)))
on_events("united_occurrences", sql.united(), lambda s: metrics.united(_truth(s)))
on_events("label_scores", sql.label_scores(), lambda s: metrics.label_scores(_truth(s), _found(s)))
on_events("label_scores_weighted", sql.label_scores(weighted=True), lambda s: metrics.label_scores(_truth(s), _found(s), weighted=True))
on_events("label_event_scores", sql.label_event_scores(THRESHOLDS), lambda s: metrics.label_event_scores(_truth(s), _found(s), THRESHOLDS))
on_events("metric_battery", sql.battery(THRESHOLDS), lambda s: metrics.battery(_truth(s), _found(s), s, THRESHOLDS))
on_events("event_prf_thresholds", sql.event_scores(THRESHOLDS), lambda s: metrics.event_scores(_truth(s), _found(s), THRESHOLDS))
on_events("auc_over_thresholds", sql.threshold_mean(sql.event_scores([k / 100 for k in range(101)]).replace(", 6) AS", ", 15) AS")), lambda s: metrics.threshold_mean(metrics.event_scores(_truth(s), _found(s), [k / 100 for k in range(101)])))
on_events("adjusted_information", sql.adjusted_information(), lambda s: metrics.adjusted_information(metrics.contingency(_truth(s), _found(s), s)))


def _lags(s: DataFrame) -> DataFrame:
    """Every even series with the next odd one."""
    s = s.withColumn("pair", F.floor(F.col("series_id") / 2))
    return alignment.lag_correlation(s.where("series_id % 2 = 0"), s.where("series_id % 2 = 1"), 30)


on_events("lag_correlation", sql.lags("all"), _lags)
on_events("optimal_lag", sql.lags("best"), lambda s: alignment.best_lag(_lags(s)))


def _fours(s: DataFrame) -> DataFrame:
    """Series in groups of four."""
    return s.withColumn("pair", F.floor(F.col("series_id") / 4))


on_events("lag_matrix", sql.lag_groups("matrix"), lambda s: alignment.lag_matrix(_fours(s), 30))
on_events("relative_lags", sql.lag_groups("relative"), lambda s: alignment.relative_lags(alignment.lag_matrix(_fours(s), 30)))
on_events("aligned_mean", sql.lag_groups("mean"), lambda s: alignment.aligned_mean(s, alignment.relative_lags(alignment.lag_matrix(_fours(s), 30))))
on_events("lag_medoid", sql.lags("medoid"), lambda s: alignment.medoid(alignment.best_lag(_lags(s))))
on_events("barycenter", sql.barycenter(), lambda s: alignment.barycenter(_truth(s), s))


@query("embedding_window_stats", sql.rolling("mean", "std", series=sql.EMBEDDINGS))
def embedding_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.unpacked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return _rounded(S.rolling(s, M).select("series_id", "i", "mean", "std"))


@query("embedding_profile", sql.profile("unit", series=sql.EMBEDDINGS))
def embedding_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(S.unpacked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"), M, "unit")


def _revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return S.daily(items, "l_shipdate", F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query("daily_revenue_series", sql.DAILY_ROUNDED)
def daily_revenue_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _revenue(spark, sf_dir).withColumn("value", F.round("value", 4))


@query("daily_profile_tiled", sql.daily_profile(16))
def daily_profile_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.tiled_profile(_revenue(spark, sf_dir), 16, "unit", tile=512, digits=4).select("series_id", "i", "dist")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    algorithm = F.concat(F.lit("a"), (F.col("user_id") % 3).cast("string")).alias("algorithm")
    return events.select(F.col("event_type").alias("dataset"), algorithm, (F.col("user_id") % 5).alias("setting"), F.col("value").alias("score")).where("score IS NOT NULL")


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.group_mean(_scores(spark, sf_dir), ["dataset", "algorithm", "setting"]))


query("score_group_mean", sql.scores("mean"))(_means)
query("score_pivot", sql.scores("pivot"))(lambda spark, d: _rounded(reports.pivoted(_means(spark, d), ["dataset", "setting"], "algorithm", ["a0", "a1", "a2"])))
query("score_top2", sql.scores("top2"))(lambda spark, d: reports.best_two(_means(spark, d), ["dataset", "setting"], "algorithm"))
query("relative_error", sql.scores("error"))(lambda spark, d: _rounded(reports.relative_error(_means(spark, d), ["dataset", "algorithm"], "setting")))
query("quartiles", sql.scores("quartiles"))(lambda spark, d: _rounded(reports.quartiles(_scores(spark, d), ["dataset", "algorithm"])))
query("mean_ranks", sql.scores("ranks"))(lambda spark, d: _rounded(reports.mean_ranks(_means(spark, d), ["dataset", "setting"], "algorithm")))

query("friedman", sql.scores("friedman"))(lambda spark, d: _rounded(reports.friedman(_means(spark, d), ["dataset", "setting"], "algorithm")))
query("signed_ranks", sql.signed_ranks())(lambda spark, d: _rounded(reports.signed_ranks(_means(spark, d), ["dataset", "setting"], "algorithm")))
query("cliques", sql.cliques(0.05))(lambda spark, d: reports.cliques(_means(spark, d), ["dataset", "setting"], "algorithm"))
query("rank_differences", sql.scores("differences"))(lambda spark, d: _rounded(reports.rank_differences(_means(spark, d), ["dataset", "setting"], "algorithm")))


@query("score_zero_fill", sql.scores("zero"))
def score_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _means(spark, sf_dir)
    return reports.zero_filled(means, means.select("dataset", "setting").distinct(), means.select("algorithm").distinct())
