"""Registered queries: one per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame built from the
given tables through the library's operators. The oracle twin of each
entry is in ``tracefold.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import log as L
from .operators import stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ E1-E3
@register("variant_stats")
def _variant_stats(spark, d):
    return stats.variant_stats(L.day_log(spark, d))


@register("variant_pareto")
def _variant_pareto(spark, d):
    return stats.variant_pareto(L.day_log(spark, d))


@register("variant_pareto_ord")
def _variant_pareto_ord(spark, d):
    return stats.variant_pareto(L.ord_log(spark, d))


@register("pareto_check")
def _pareto_check(spark, d):
    return stats.pareto_check(L.ord_log(spark, d))


# ------------------------------------------------------------------ filters (C, D2, D3)
from .operators import filters as C  # noqa: E402

D1, D2 = "2024-01-05 00:00:00", "2024-01-20 12:00:00"


def _events(lg):
    return lg.df


def _reg_filter(name, make_log, fn):
    QUERIES[name] = lambda spark, d: _events(fn(make_log(spark, d)))


_reg_filter("flt_time_contained", L.day_log, lambda lg: C.time_contained(lg, D1, D2))
_reg_filter("flt_time_intersecting", L.day_log, lambda lg: C.time_intersecting(lg, D1, D2))
_reg_filter("flt_time_events", L.day_log, lambda lg: C.time_events(lg, D1, D2))
_reg_filter("flt_case_performance", L.day_log, lambda lg: C.case_performance(lg, 3600, 6 * 3600))
_reg_filter("flt_start_activity", L.day_log, lambda lg: C.start_activity(lg, ["signup", "view"]))
_reg_filter("flt_start_frequent", L.day_log, lambda lg: C.start_frequent(lg, 0.97))
_reg_filter("flt_end_activity", L.day_log, lambda lg: C.end_activity(lg, "purchase"))
_reg_filter("flt_endpoint_keywords", L.day_log,
            lambda lg: C.endpoint_keywords(lg, ["sign", "VIEW"], ["purch", "ERR"]))
_reg_filter("flt_variants_in", L.day_log,
            lambda lg: C.variants_in(lg, ["view", "click", "error,view"]))
_reg_filter("anti_variants", L.day_log,
            lambda lg: C.variants_in(lg, ["view", "click", "error,view"], positive=False))
_reg_filter("flt_variants_percentage", L.ord_log, lambda lg: C.variants_percentage(lg, 0.3))
_reg_filter("flt_variants_top_k", L.ord_log, lambda lg: C.variants_top_k(lg, 10))
_reg_filter("flt_variants_coverage", L.day_log, lambda lg: C.variants_coverage(lg, 0.01))
_reg_filter("flt_attr_cases", L.day_log, lambda lg: C.attr_cases(lg, "resource", ["7", "42"]))
_reg_filter("flt_attr_events", L.day_log, lambda lg: C.attr_events(lg, "resource", ["7", "42"]))
_reg_filter("flt_numeric_cases", L.day_log, lambda lg: C.numeric_cases(lg, "num", 40, 51))
_reg_filter("flt_numeric_events", L.day_log, lambda lg: C.numeric_events(lg, "num", 40, 51))
_reg_filter("flt_between", L.user_log, lambda lg: C.between(lg, "view", "purchase"))
_reg_filter("flt_between_same", L.user_log, lambda lg: C.between(lg, "click", "click"))
_reg_filter("flt_case_size", L.day_log, lambda lg: C.case_size(lg, 3, 5))
_reg_filter("flt_rework", L.day_log, lambda lg: C.rework(lg, "click", 2))
_reg_filter("flt_paths_performance", L.day_log,
            lambda lg: C.paths_performance(lg, "click", "error", 0, 3600))
_reg_filter("flt_variant_text", L.day_log, lambda lg: C.variant_at(lg, 0, "exact"))
_reg_filter("flt_variant_substring", L.ord_log, lambda lg: C.variant_at(lg, 2, "substring"))
_reg_filter("flt_case_predicate", L.user_log,
            lambda lg: C.case_predicate(lg, lambda ct: ct["case_size"] > 70))
_reg_filter("flt_event_predicate", L.day_log,
            lambda lg: C.event_predicate(lg, F.length("activity") % 2 == 0))
_reg_filter("flt_first_of", L.day_log, lambda lg: C.first_of(lg, "click", "purchase", "purchase"))
_reg_filter("flt_balanced", L.day_log, lambda lg: C.balanced(lg, "click", "purchase"))
_reg_filter("flt_has_activity", L.day_log, lambda lg: C.has_activity(lg, "view"))


def _with_category(lg):
    cats = F.element_at(F.array(*[F.lit(c) for c in C.CATEGORIES]),
                        (F.col("user_id") % 4 + 1).cast("int"))
    return lg.with_df(lg.df.withColumn("category", cats))


_reg_filter("flt_category_compliant", L.day_log,
            lambda lg: C.category_compliant(_with_category(lg), "category", "click", "purchase", "view"))


def _with_area(lg):
    area = (F.when(F.col("resource") == "7", F.lit("")).when(F.col("resource") == "13", F.lit(None))
            .otherwise(F.col("resource")))
    return lg.with_df(lg.df.withColumn("area", area))


_reg_filter("flt_empty_attr", L.day_log, lambda lg: C.empty_attr(_with_area(lg), "area"))
_reg_filter("flt_duplicates_none", L.day_log,
            lambda lg: C.duplicates_none(lg.with_df(lg.df.withColumn("dup_id", F.col("tie") % 9973)),
                                         "dup_id"))
_reg_filter("flt_single_case", L.ord_log, lambda lg: C.single_case(lg, "1"))


@register("flt_frequent_activity")
def _frequent_activity(spark, d):
    return C.frequent_activities(L.ord_log(spark, d), 0.05)


@register("semi_case_ids")
def _semi_case_ids(spark, d):
    lg = L.day_log(spark, d)
    cust = L.read_table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING")
    ids = (lg.df.join(cust, lg.df["user_id"] == cust["c_custkey"], "left_semi")
           .select("case_id").distinct())
    return C.semi_case_ids(lg, ids).df


# ------------------------------------------------------------------ aggregates, windows, top-k, charts
from .operators import stats as S  # noqa: E402
from .plans.sequence import sequenced  # noqa: E402

DAY_ACTS = ["click", "error", "purchase", "signup", "view"]

QUERIES["case_profile"] = lambda spark, d: S.case_profile(L.day_log(spark, d))
QUERIES["variant_profile"] = lambda spark, d: S.variant_profile(L.day_log(spark, d))
QUERIES["attribute_values"] = lambda spark, d: S.attribute_values(L.day_log(spark, d), "resource")
QUERIES["start_activities"] = lambda spark, d: C.start_activity_counts(L.day_log(spark, d))
QUERIES["end_activities"] = lambda spark, d: C.end_activity_counts(L.day_log(spark, d))
QUERIES["activity_counts"] = lambda spark, d: S.activity_counts(L.ord_log(spark, d))


def _events_k(spark, d):
    return L.read_table(spark, d, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int"))


QUERIES["topic_dimensions"] = lambda spark, d: S.topic_dimensions(_events_k(spark, d), "event_type", ["value", "k"])
QUERIES["topic_counts"] = lambda spark, d: S.topic_counts(L.read_table(spark, d, "conversations"), "role")


@register("region_totals")
def _region_totals(spark, d):
    o, c = L.read_table(spark, d, "orders"), L.read_table(spark, d, "customer")
    n, r = L.read_table(spark, d, "nation"), L.read_table(spark, d, "region")
    t = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey)
         .select("r_name", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"),
                 F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal")))
    return S.group_totals(t, "r_name")


QUERIES["distinct_per_column"] = lambda spark, d: S.distinct_per_column(L.read_table(spark, d, "events"))
QUERIES["nulls_per_column"] = lambda spark, d: S.nulls_per_column(_with_area(L.day_log(spark, d)).df)
QUERIES["value_counts_all"] = lambda spark, d: S.value_counts_all(
    L.read_table(spark, d, "events"), ["event_type", "user_id", "props", "value"])
QUERIES["crosstab_case_activity"] = lambda spark, d: S.crosstab_case_activity(L.day_log(spark, d), DAY_ACTS)
QUERIES["pivot_start_end"] = lambda spark, d: S.pivot_start_end(L.day_log(spark, d))
QUERIES["events_per_case_by_category"] = lambda spark, d: S.events_per_case_by(
    _with_category(L.day_log(spark, d)), "category")


@register("filter_effect")
def _filter_effect(spark, d):
    lg = _with_area(L.day_log(spark, d))
    lg = lg.with_df(lg.df.withColumn("dup_id", F.col("tie") % 9973))
    return S.filter_effect(lg, "area", "dup_id", D1, D2)


QUERIES["cumulative_percentage"] = lambda spark, d: S.cumulative_percentage(
    S.activity_counts(L.ord_log(spark, d)), "activity", "n_events")
QUERIES["rank_index"] = lambda spark, d: S.rank_index(
    S.case_profile(L.day_log(spark, d)).select("case_id", "n_events"),
    [F.col("n_events").desc(), F.col("case_id").asc()])


@register("next_event")
def _next_event(spark, d):
    s = sequenced(L.day_log(spark, d), carry=("activity", "ts"))
    return s.select("case_id", "activity", "ts", "tie", "pos", "next_activity", "next_ts")


QUERIES["zscore_columns"] = lambda spark, d: S.zscore_columns(
    S.topic_dimensions(_events_k(spark, d), "event_type", ["value", "k"]), "topic")


def _durations(spark, d):
    return S.case_profile(L.day_log(spark, d)).select("case_id", "duration_s")


QUERIES["empirical_cdf"] = lambda spark, d: S.empirical_cdf(_durations(spark, d), "duration_s", 50)
QUERIES["histogram_bins"] = lambda spark, d: S.histogram_bins(_durations(spark, d), "duration_s", 50)
QUERIES["sort_cases"] = lambda spark, d: S.rank_index(
    S.case_profile(L.day_log(spark, d)).select("case_id", "n_events", "duration_s"),
    [F.col("n_events").desc(), F.col("duration_s").desc(), F.col("case_id").asc()])
QUERIES["top_n_frame"] = lambda spark, d: S.top_n_frame(
    S.variant_stats(L.ord_log(spark, d)), [F.col("n_cases").desc(), F.col("variant").asc()], 100)
QUERIES["top_topics"] = lambda spark, d: S.top_n_frame(
    S.zscore_columns(S.topic_dimensions(_events_k(spark, d), "event_type", ["value", "k"]), "topic"),
    [F.col("z_duration_s").desc(), F.col("topic").asc()], 5)


@register("pie_others")
def _pie_others(spark, d):
    ct = L.day_log(spark, d).df.groupBy("case_id").agg(F.count(F.lit(1)).alias("case_size"))
    sizes = ct.groupBy("case_size").agg(F.count(F.lit(1)).alias("n_cases"))
    return S.pie_others(sizes, "case_size", "n_cases", 0.05)


QUERIES["category_ratio"] = lambda spark, d: S.category_ratio(_with_category(L.day_log(spark, d)), "category")


@register("set_all_categories")
def _set_all_categories(spark, d):
    # one pass: the rule set of a case is chosen by its own category
    return C.category_compliant(_with_category(L.day_log(spark, d)), "category", "click", "purchase", "view").df


def _with_flags(lg):
    lg = _with_category(lg)
    return lg.with_df(lg.df.withColumns({"verified": F.col("tie") % 2 == 0, "received": F.col("tie") % 3 != 0}))


_reg_filter("flt_category_flags", L.day_log,
            lambda lg: C.category_flags(_with_flags(lg), "category", "verified", "received"))
_reg_filter("flt_attr_events_not", L.day_log, lambda lg: C.attr_events(
    lg.with_df(lg.df.withColumn("resource", F.when(F.col("tie") % 4 != 0, F.col("resource")))),
    "resource", ["1", "2", "3"], positive=False))


# ------------------------------------------------------------------ preparation (B), joins (D1, D4, D5), time (H)
from .operators import prepare as B  # noqa: E402
from .operators import timing as H  # noqa: E402

QUERIES["log_rename"] = lambda spark, d: B.rename(
    L.read_table(spark, d, "events"), {"user_id": "case_id", "event_type": "activity"})
QUERIES["log_drop_columns"] = lambda spark, d: B.drop_columns(L.read_table(spark, d, "events"), ["props", "value"])
QUERIES["log_sorted"] = lambda spark, d: B.sorted_log(L.day_log(spark, d))
QUERIES["log_event_index"] = lambda spark, d: B.event_index(L.day_log(spark, d)).select(
    "case_id", "activity", "ts", "tie", "index", "index_in_trace")


@register("log_to_cases")
def _log_to_cases(spark, d):
    c = B.to_cases(L.ord_log(spark, d), ["activity", "ts"])
    return c.select("case_id", F.size("events").cast("long").alias("n_events"),
                    F.transform("events", lambda e: e["activity"]).alias("activities"),
                    F.col("events")[0]["ts"].alias("first_ts"))


@register("cases_to_log")
def _cases_to_log(spark, d):
    return B.from_cases(B.to_cases(L.ord_log(spark, d), ["activity", "ts"]))


QUERIES["case_attributes"] = lambda spark, d: B.case_attributes(
    L.day_log(spark, d).with_df(L.day_log(spark, d).df.withColumn("day", F.to_date("ts"))), ["user_id", "day"])
QUERIES["case_relative_time"] = lambda spark, d: B.relative_time(L.day_log(spark, d))
QUERIES["log_classifier"] = lambda spark, d: B.classifier(L.day_log(spark, d), ["activity", "resource"]).select(
    "case_id", "tie", "classifier")
QUERIES["log_artificial_ends"] = lambda spark, d: B.artificial_ends(L.day_log(spark, d))
QUERIES["case_number"] = lambda spark, d: B.case_number(L.day_log(spark, d).df)
QUERIES["trace_features"] = lambda spark, d: B.trace_features(L.day_log(spark, d), DAY_ACTS)


def _tables(spark, d, *names):
    return [L.read_table(spark, d, n) for n in names]


QUERIES["value_per_region"] = lambda spark, d: B.region_value(*_tables(spark, d, "orders", "customer", "nation", "region"))


def _order_flags(spark, d):
    o = L.read_table(spark, d, "orders")
    flags = {"f_finished": F.col("o_orderstatus") == "F",
             "f_priority": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
             "f_large": F.col("o_totalprice") > 150000,
             "f_year_end": F.month("o_orderdate").isin(11, 12)}
    return B.tiered_value(o, "o_orderkey", flags)


QUERIES["tiered_value"] = _order_flags


@register("compare_as_is_to_be")
def _compare(spark, d):
    o, c, n, r = _tables(spark, d, "orders", "customer", "nation", "region")
    as_is = B.region_value(o, c, n, r).select("r_name", F.col("value").alias("as_is_value"))
    t = (_order_flags(spark, d).join(o, "o_orderkey").join(c, o.o_custkey == c.c_custkey)
         .join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
         .groupBy("r_name").agg(F.sum("price").cast("long").alias("to_be_value")))
    return B.compare_side_by_side(as_is, t, "r_name")


QUERIES["join_case_stats"] = lambda spark, d: B.join_case_stats(L.day_log(spark, d))
QUERIES["eventually_follows"] = lambda spark, d: H.eventually_follows(L.day_log(spark, d))
QUERIES["temporal_profile"] = lambda spark, d: H.temporal_profile(L.user_log(spark, d))
QUERIES["case_durations"] = lambda spark, d: H.case_durations(L.day_log(spark, d)).drop("duration_us")
QUERIES["median_case_duration"] = lambda spark, d: H.median_case_duration(L.day_log(spark, d))
QUERIES["case_arrival_avg"] = lambda spark, d: H.case_arrival_avg(L.day_log(spark, d), "start")
QUERIES["case_dispersion_avg"] = lambda spark, d: H.case_arrival_avg(L.day_log(spark, d), "end")
QUERIES["business_hours"] = lambda spark, d: H.business_hours(L.ivl_log(spark, d, per_user=True), weekends=(5, 6, 7))
QUERIES["lead_cycle_time"] = lambda spark, d: H.lead_cycle_time(L.ivl_log(spark, d, per_user=True))
QUERIES["lead_cycle_business"] = lambda spark, d: H.lead_cycle_time(
    L.ivl_log(spark, d, per_user=True), business={"work": (8, 16), "weekends": (6, 7)})
QUERIES["case_profile_times"] = lambda spark, d: H.case_profile_times(L.ivl_log(spark, d, per_user=True))
QUERIES["sojourn_time"] = lambda spark, d: H.sojourn_time(L.ivl_log(spark, d))
QUERIES["performance_spectrum"] = lambda spark, d: H.performance_spectrum(
    L.user_log(spark, d), ["signup", "view", "click", "purchase"])


@register("scatter_case_time")
def _scatter(spark, d):
    return B.relative_time(L.day_log(spark, d)).select(
        B.number_in(F.col("case_id")).alias("case_number"), "rel_s", "activity", "case_id", "tie")


# ------------------------------------------------------------------ discovery (I)
from .operators import discovery as I  # noqa: E402

QUERIES["dfg_frequency"] = lambda spark, d: I.dfg_frequency(L.day_log(spark, d))
QUERIES["dfg_frequency_ord"] = lambda spark, d: I.dfg_frequency(L.ord_log(spark, d))
QUERIES["dfg_performance"] = lambda spark, d: I.dfg_performance(L.day_log(spark, d))
QUERIES["dfg_triples"] = lambda spark, d: I.dfg_triples(L.day_log(spark, d))
QUERIES["dfg_case_attributes"] = lambda spark, d: I.dfg_case_attribute(_with_category(L.day_log(spark, d)), "category")
QUERIES["dfg_with_ends"] = lambda spark, d: I.dfg_with_ends(L.day_log(spark, d))
QUERIES["dfg_clean_noise"] = lambda spark, d: I.dfg_clean_noise(I.dfg_frequency(L.ord_log(spark, d)), 0.05)
QUERIES["footprint"] = lambda spark, d: I.footprint(L.day_log(spark, d))
QUERIES["alpha_plus_relations"] = lambda spark, d: I.alpha_plus_relations(L.day_log(spark, d))
QUERIES["dependency_graph"] = lambda spark, d: I.dependency_graph(L.day_log(spark, d), 0.05, 100, 50, 0.9)


@register("and_splits")
def _and_splits(spark, d):
    lg = L.day_log(spark, d)
    return I.and_splits(I.dependency_graph(lg, -1.0, 1, 1, 2.0), I.dfg_frequency(lg), 0.65)


QUERIES["parameter_sweep"] = lambda spark, d: I.parameter_sweep(L.day_log(spark, d))
QUERIES["sweep_bounds"] = lambda spark, d: I.sweep_bounds(L.ord_log(spark, d))


@register("model_decoration")
def _model_decoration(spark, d):
    lg = L.day_log(spark, d)
    return I.model_decoration(lg, I.dependency_graph(lg, 0.05, 100, 50, 0.9))


# ------------------------------------------------------------------ conformance (J, D6) and evaluation (K, G4)
from .operators import conformance as J  # noqa: E402
from .operators import evaluation as K  # noqa: E402
from .operators import marking as M  # noqa: E402


def _net(spark):
    return J.net_tables(spark)


def _replay(fn):
    def q(spark, d):
        p, a = _net(spark)
        return fn(L.day_log(spark, d), p, a)
    return q


QUERIES["token_replay"] = _replay(J.token_replay)
QUERIES["replay_problems"] = _replay(J.replay_problems)
QUERIES["anomalous_cases"] = _replay(J.anomalous_cases)
QUERIES["replay_diagnostics"] = _replay(J.replay_diagnostics_transitions)
QUERIES["replay_diagnostics_places"] = _replay(J.replay_diagnostics_places)


def _edges(spark):
    return spark.createDataFrame(J.FIXED_EDGES, "a string, b string")


QUERIES["edge_conformance"] = lambda spark, d: J.edge_conformance(L.day_log(spark, d), _edges(spark))


def _moves(spark, d):
    return J.positional_moves(L.day_log(spark, d))


QUERIES["alignment_summary"] = lambda spark, d: J.alignment_summary(J.alignment_costs(_moves(spark, d)))
QUERIES["anomaly_odds"] = lambda spark, d: J.anomaly_odds(J.alignment_costs(_moves(spark, d)))
QUERIES["anomaly_classes"] = lambda spark, d: J.anomaly_classes(_moves(spark, d))
QUERIES["model_move_pairs"] = lambda spark, d: J.model_move_pairs(_moves(spark, d))


@register("consensus_sequence")
def _consensus(spark, d):
    lg = L.day_log(spark, d)
    p, a = _net(spark)
    grp = J.token_replay(lg, p, a).select(
        "case_id", F.when(F.col("is_fit"), "regular").otherwise("irregular").alias("grp"))
    return J.consensus_sequence(lg, grp)


QUERIES["replay_fitness"] = _replay(K.replay_fitness)
QUERIES["etc_precision"] = _replay(K.etc_precision)
QUERIES["generalization"] = lambda spark, d: K.generalization(L.day_log(spark, d), _net(spark)[1])


@register("simplicity")
def _simplicity(spark, d):
    # the edge graph discovered from the log, not a given net
    e = I.dependency_graph(L.day_log(spark, d), 0.05, 100, 50, 0.9)
    n = e.select(F.explode(F.array("a", "b")).alias("x"))
    return n.agg((F.count(F.lit(1)) / 2).alias("_e"), F.count_distinct("x").alias("_n")).select(
        F.round(I.edge_simplicity(F.col("_e"), F.col("_n")), 6).alias("simplicity"))


QUERIES["edge_precision"] = lambda spark, d: K.edge_precision(L.day_log(spark, d), _edges(spark))
QUERIES["model_score"] = lambda spark, d: K.rate_net(L.day_log(spark, d), *_net(spark), "fixed_net")


def _rating(spark, d):
    nets = {"fixed_net": _net(spark),
            "sequential_net": J.net_tables(spark, J.SEQUENTIAL_NET_PLACES, J.SEQUENTIAL_NET_ARCS)}
    return K.rating_table(L.day_log(spark, d), nets)


QUERIES["rating_table"] = _rating


@register("rate_discovered")
def _rate_discovered(spark, d):
    # discover, rate, rank: the alpha net of the log beside the two given nets
    lg = L.conv_log(spark, d)
    places, arcs = I.alpha_net(lg)
    return K.rating_table(lg, {"alpha_net": (places, arcs), "fixed_net": _net(spark)})


QUERIES["replay_outside"] = lambda spark, d: J.replay_outside(
    L.day_log(spark, d), _net(spark)[1].where(F.col("activity") != "error"))
QUERIES["rank_models"] = lambda spark, d: _rating(spark, d).select("rank", "model", "score", "score_compat")


# ------------------------------------------------------------------ sources and sinks (A): write, read back
from .sources import io as A  # noqa: E402

_DAY_COLS = ["case_id", "activity", "ts", "tie", "resource", "num", "user_id"]
_CSV_SCHEMA = ("`case:concept:name` string, `concept:name` string, `time:timestamp` timestamp_ntz, "
               "tie long, `org:resource` string, num double, user_id long")


def _xes_named(df):
    return df.withColumnsRenamed({"case_id": "case:concept:name", "activity": "concept:name",
                                  "ts": "time:timestamp", "resource": "org:resource"})


@register("src_csv_log")
def _src_csv(spark, d):
    path = A.scratch_path(spark, "csv")
    A.write_table(_xes_named(L.day_log(spark, d).df), path, "csv", encoding="ISO-8859-1")
    return A.read_csv_log(spark, path, schema=_CSV_SCHEMA).select(*_DAY_COLS)


@register("src_csv_semicolon")
def _src_csv_semi(spark, d):
    path = A.scratch_path(spark, "csv")
    A.write_table(_xes_named(L.day_log(spark, d).df), path, "csv", sep=";")
    return A.read_csv_log(spark, path, schema=_CSV_SCHEMA, sep=";").select(*_DAY_COLS)


@register("src_parse_timestamps")
def _src_parse(spark, d):
    path = A.scratch_path(spark, "csv")
    A.write_table(L.day_log(spark, d).df, path, "csv")
    text = A.read_csv_log(spark, path)                      # every column read as text
    parsed = A.parse_timestamps(text)
    return parsed.select("case_id", "activity", "ts", F.col("tie").cast("long").alias("tie"))


@register("src_cached_table")
def _src_cached(spark, d):
    path = A.scratch_path(spark, "parquet")
    A.write_table(L.day_log(spark, d).df, path)
    return A.read_table(spark, path)


@register("sink_table")
def _sink_table(spark, d):
    path = A.scratch_path(spark, "parquet")
    A.write_table(S.case_profile(L.day_log(spark, d)), path)
    return A.read_table(spark, path)


@register("sink_by_category")
def _sink_by_category(spark, d):
    path = A.scratch_path(spark, "bycat")
    A.write_table(_with_category(L.day_log(spark, d)).df, path, partition_by=["category"])
    return A.read_table(spark, path)


@register("sink_report")
def _sink_report(spark, d):
    path = A.scratch_path(spark, "report")
    A.write_report(_rating(spark, d).select("rank", "model", "score", "score_compat"), path)
    return spark.read.schema("rank int, model string, score double, score_compat double").json(path)


@register("src_xes")
def _src_xes(spark, d):
    lg = L.day_log(spark, d)
    path = A.scratch_path(spark, "xes")
    from .operators.prepare import to_cases
    A.write_xes(to_cases(lg, ["activity", "ts", "resource"]), path)
    return A.read_xes(spark, path).select("case_id", "activity", "ts", "resource")
QUERIES["nearest_trace_alignment"] = lambda spark, d: J.nearest_trace_alignment(L.day_log(spark, d))
QUERIES["alignment_moves"] = lambda spark, d: J.alignment_moves(L.day_log(spark, d))
QUERIES["net_alignment"] = lambda spark, d: M.net_alignment(L.day_log(spark, d), *_net(spark))
QUERIES["alpha_places"] = lambda spark, d: I.alpha_places(L.conv_log(spark, d))
QUERIES["activity_cut"] = lambda spark, d: I.activity_cut(L.day_log(spark, d))
QUERIES["log_split_by_cut"] = lambda spark, d: I.log_split_by_cut(
    L.day_log(spark, d), I.activity_cut(L.day_log(spark, d)))
QUERIES["process_tree"] = lambda spark, d: I.inductive_tree(L.day_log(spark, d))
QUERIES["unfit_case_ids"] = _replay(J.unfit_case_signatures)
