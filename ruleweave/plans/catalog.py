"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.contract import CLASS_COUNTS, FEATURES, RECORD, TARGET
from ruleweave.functions import codes, items, keys, urls, vectors
from ruleweave.operators import (
    evaluate,
    explain,
    fingerprint,
    history,
    mining,
    open_items,
    pages,
    providers,
    quality,
    ranking,
    scoring,
    split,
    validate,
)
from ruleweave.operators.mining import Mining
from ruleweave.plans import training
from ruleweave.session import scratch_table, settle
from ruleweave.sources import derive, frames, history_store, store, tables
from ruleweave.streaming import routing

PARAMS = Mining(min_support=0.01, min_confidence=0.5, min_lift=1.0)
THRESHOLDS = [0.3, 0.5, 0.7]
SEED = 42
AS_OF = "2015-06-30T12:00:00+00:00"
HISTORY_ARGS = {"date_from": "2024-01-05", "date_to": "2024-01-20", "classification": "", "status": ""}

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _r(column: str | Column, name: str | None = None) -> Column:
    """Round for comparison, after all thresholds."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value.cast("double"), 10).alias(name or column)


def _joined(column: str = "antecedent") -> Column:
    return F.array_join(column, "|").alias(column)


def _derived(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return getattr(derive, name)(derive.SparkText).frame(spark, sf_dir)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(mining.weigh(frames.labelled(spark, sf_dir)))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.mine_ranked(_cells(spark, sf_dir), PARAMS)


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.group_sides(frames.labelled(spark, sf_dir), 0.2, SEED)


def _tested(spark: SparkSession, sf_dir: str) -> tuple[training.Model, DataFrame]:
    """Model of the train side and the scored cells of the test side."""
    cells = _sides(spark, sf_dir)
    model = training.fit_cells(training.side(cells, "train"), PARAMS)
    return model, scoring.score_cells(training.side(cells, "test"), model.vector_table())


def _rule_columns() -> list[Column]:
    return [
        F.col("rank").cast("long").alias("rank"),
        _joined(),
        F.col("consequent"),
        _r("support"),
        _r("confidence"),
        _r("lift"),
        F.col("antecedent_length"),
        F.col("class").cast("int").alias("class"),
    ]


# -- validation and encoding -------------------------------------------------------


@query
def validate_summary(spark, sf_dir):
    return validate.domain_summary(_derived("labelled_with_faults", spark, sf_dir))


@query
def invalid_values(spark, sf_dir):
    return validate.invalid_values(_derived("labelled_with_faults", spark, sf_dir))


@query
def vector_validation(spark, sf_dir):
    checked = vectors.check_vectors(_derived("history", spark, sf_dir))
    return vectors.spread_codes(checked).select("id", "vector_error", *FEATURES)


@query
def provider_vectors(spark, sf_dir):
    found = providers.provider_vectors(
        _derived("vector_requests", spark, sf_dir), _derived("vector_provider", spark, sf_dir)
    )
    return found.select("request_id", "url", "vector_error", *FEATURES)


@query
def item_encoding(spark, sf_dir):
    frame = frames.labelled(spark, sf_dir)
    return frame.select("record_id", F.array_join(items.transaction(), "|").alias("items"))


@query
def item_universe(spark, sf_dir):
    records = quality.distinct_records(frames.labelled(spark, sf_dir))
    return (
        records.select(F.explode(items.transaction()).alias("item"), "n")
        .groupBy("item")
        .agg(F.sum("n").alias("row_count"))
    )


@query
def item_matrix(spark, sf_dir):
    """The one-hot form of every distinct record, with its frequency."""
    records = quality.distinct_records(frames.labelled(spark, sf_dir))
    return records.select(
        F.array_join(items.transaction(), "|").alias("items"),
        *items.one_hot(),
        F.col("n").alias("row_count"),
    )


@query
def dedup_rows(spark, sf_dir):
    return quality.deduplicate(frames.labelled(spark, sf_dir))


# -- mining and ranking ------------------------------------------------------------


@query
def class_counts(spark, sf_dir):
    totals = mining.class_totals(mining.weigh(frames.labelled(spark, sf_dir)))
    return totals.drop("run")


@query
def frequent_itemsets(spark, sf_dir):
    found = mining.frequent_itemsets(_cells(spark, sf_dir), PARAMS)
    return found.select(
        F.array_join(keys.antecedent(F.col("key")), "|").alias("items"),
        items.class_item(F.col("class")).alias("class_item"),
        F.col("n").alias("row_count"),
        _r("support"),
    )


@query
def class_rules(spark, sf_dir):
    return _rules(spark, sf_dir).select(*_rule_columns())


@query
def generated_rule_count(spark, sf_dir):
    itemsets = settle(mining.frequent_itemsets(_cells(spark, sf_dir), PARAMS))
    return mining.generated_rules(itemsets, THRESHOLDS).drop("run")


@query
def class_relative_rules(spark, sf_dir):
    found = ranking.class_relative_rules(_cells(spark, sf_dir))
    return found.select(*_rule_columns(), _r("relative_support"))


@query
def filtered_rules(spark, sf_dir):
    kept = ranking.filter_rules(_rules(spark, sf_dir), min_confidence=0.7, min_lift=1.2)
    return ranking.explanation_view(kept).select(*_rule_columns(), "class_label")


@query
def top_rules(spark, sf_dir):
    best = ranking.public_view(ranking.top_rules(_rules(spark, sf_dir), 10))
    return best.select(
        F.col("rank").cast("long").alias("rank"),
        _joined(),
        "consequent",
        _r("support"),
        _r("confidence"),
        _r("lift"),
    )


@query
def rule_characteristics(spark, sf_dir):
    summary = ranking.rule_characteristics(_rules(spark, sf_dir))
    return summary.select("field", "rules", *[_r(c) for c in ("min", "max", "mean", "median")])


# -- matching and explaining -------------------------------------------------------


def _open_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class rules of the labelled records, mined as baskets of items."""
    frame = frames.labelled(spark, sf_dir)
    baskets = frame.select(F.array(*items.feature_items()).alias("items"), items.class_item().alias("consequent"))
    rules = open_items.class_rules(baskets, PARAMS)
    code = F.coalesce(*[F.when(F.col("consequent") == items.class_item(F.lit(c)), F.lit(c)) for c in CLASS_COUNTS])
    return ranking.rank_rules(rules.withColumn("class", code).withColumn("run", F.lit("model")))


@query
def open_class_rules(spark, sf_dir):
    return _open_rules(spark, sf_dir).select(*_rule_columns())


@query
def open_matched_rule_counts(spark, sf_dir):
    rules = _open_rules(spark, sf_dir).select(F.col("rank").alias("rule"), "antecedent")
    present = settle(frames.labelled(spark, sf_dir).select(*FEATURES).distinct())
    baskets = present.select(F.struct(*FEATURES).alias("id"), F.array(*items.feature_items()).alias("items"))
    counted = open_items.matches(baskets, settle(rules)).groupBy("id").agg(F.count("*").alias("n"))
    both = baskets.join(counted, "id", "left")
    return both.select("id.*", F.coalesce("n", F.lit(0)).cast("long").alias("matching_rule_count"))


@query
def matched_rule_counts(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    model = training.fit_cells(cells, PARAMS)
    present = cells.select(F.col("key").alias("vector"))
    return (
        model.vector_table()
        .join(F.broadcast(present), "vector", "left_semi")
        .select(*keys.feature_columns(F.col("vector")), "matching_rule_count")
    )


@query
def predictions(spark, sf_dir):
    frame = frames.labelled(spark, sf_dir)
    model = training.fit(frame, PARAMS)
    scored = scoring.score(frame, model.vector_table())
    return scored.select(
        "record_id",
        F.col(TARGET).alias("actual"),
        "predicted",
        "matching_rule_count",
        F.col("rank").cast("long").alias("rank"),
    )


def _explained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = _cells(spark, sf_dir)
    model = training.fit_cells(cells, PARAMS)
    return cells.select(F.col("key").alias("vector")), model.rules


@query
def explanations_topk(spark, sf_dir):
    found = explain.top_rules_per_vector(*_explained(spark, sf_dir), k=5)
    return found.select(
        *keys.feature_columns(F.col("vector")),
        F.col("position").cast("long").alias("position"),
        *_rule_columns(),
        "class_label",
    )


@query
def feature_evidence(spark, sf_dir):
    found = explain.evidence(*_explained(spark, sf_dir))
    return found.select(
        *keys.feature_columns(F.col("vector")),
        "feature",
        "value",
        F.array_join(F.col("allowed_values").cast("array<string>"), ",").alias("allowed_values"),
        "matching_rule_count",
        F.col("strongest_rank").cast("long").alias("strongest_rank"),
        "strongest_rule",
    )


@query
def explanation_documents(spark, sf_dir):
    documents = explain.explanations(*_explained(spark, sf_dir), k=5)
    rules = F.transform("matching_rules", lambda r: F.array_join(r["antecedent"], "|"))
    evidence = F.transform(
        "feature_evidence",
        lambda e: F.concat_ws("=", e["feature"], e["matching_rule_count"].cast("string")),
    )
    return documents.select(
        *keys.feature_columns(F.col("vector")),
        "matching_rule_count",
        "has_matching_rules",
        F.coalesce(F.array_join(rules, " ; "), F.lit("")).alias("top_antecedents"),
        F.array_join(evidence, " ; ").alias("evidence_counts"),
    )


# -- splits ------------------------------------------------------------------------


@query
def group_split(spark, sf_dir):
    frame = split.group_split(frames.labelled(spark, sf_dir), 0.2, SEED)
    return frame.select("record_id", "side")


@query
def row_split(spark, sf_dir):
    frame = split.row_split(frames.labelled(spark, sf_dir), "record_id", 0.2, SEED)
    return frame.select("record_id", "side")


@query
def row_split_70_30(spark, sf_dir):
    frame = split.row_split(frames.labelled(spark, sf_dir), "record_id", 0.3, SEED)
    return frame.select("record_id", "side")


@query
def kfold_assignment(spark, sf_dir):
    frame = frames.labelled(spark, sf_dir)
    return split.training_folds(frame, "record_id", 0.3, 5, SEED).select("record_id", "fold")


@query
def split_analysis(spark, sf_dir):
    return split.split_analysis(_sides(spark, sf_dir))


@query
def shared_vectors(spark, sf_dir):
    shared = split.shared_vectors(_sides(spark, sf_dir))
    return shared.select(*keys.feature_columns(F.col("key")), *[c for c in shared.columns if c != "key"])


# -- evaluation --------------------------------------------------------------------


@query
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_tested(spark, sf_dir)[1]).drop("run")


@query
def class_metrics(spark, sf_dir):
    metrics = evaluate.class_metrics(_tested(spark, sf_dir)[1])
    return metrics.select(
        "label", *[_r(c) for c in ("accuracy", "precision", "recall", "f1")], "support"
    )


@query
def coverage(spark, sf_dir):
    found = evaluate.coverage(_tested(spark, sf_dir)[1])
    return found.drop("run", "rule_coverage").select("*", _r(F.col("rows_matched") / F.col("rows_all"), "rule_coverage"))


@query
def error_rows(spark, sf_dir):
    frame = frames.labelled(spark, sf_dir)
    groups = training.group_assignment(frame, 0.2, SEED)
    cells = settle(split.regroup(groups, F.col("side")))
    model = training.fit_cells(training.side(cells, "train"), PARAMS)
    test = split.place_rows(frame, groups).where(F.col("side") == "test")
    wrong = evaluate.errors(evaluate.record_evaluation(test, model.vector_table(), model.rules))
    return wrong.select(
        "record_id",
        "actual",
        "predicted",
        "matched",
        "default_rule",
        "matching_rule_count",
        "selected_rule",
    )


def _experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.threshold_experiments(_sides(spark, sf_dir), THRESHOLDS)


@query
def threshold_experiments(spark, sf_dir):
    found = _experiments(spark, sf_dir)
    return found.withColumns({c: F.round(c, 10) for c in ("accuracy", "macro_f1")})


@query
def selected_threshold(spark, sf_dir):
    best = evaluate.select_threshold(_experiments(spark, sf_dir))
    return best.select("min_confidence", _r("accuracy"), _r("macro_f1"), "kept_rules")


_METRICS = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")


@query
def baseline_compare(spark, sf_dir):
    found = training.compare_splits(frames.labelled(spark, sf_dir), "record_id", PARAMS, 0.2, SEED)
    return found.select(
        F.col("run").alias("split"),
        "rows_train",
        F.col("rows_all").alias("rows_test"),
        "rows_unmatched",
        *[_r(c) for c in _METRICS],
    )


@query
def cross_validation(spark, sf_dir):
    frame = frames.labelled(spark, sf_dir)
    folded = split.training_folds(frame, "record_id", 0.3, 5, SEED)
    found = settle(training.cross_validate(training.fold_cells(folded), 5))
    columns = ["rows_fit", "rows_all", "rows_unmatched", "accuracy", "macro_f1"]
    mean = found.agg(
        F.lit("mean").alias("fold"),
        *[F.sum(c).alias(c) for c in columns[:3]],
        *[F.avg(c).alias(c) for c in columns[3:]],
    )
    both = found.select(F.col("run").alias("fold"), *columns).unionByName(mean)
    return both.select("fold", *columns[:3], _r("accuracy"), _r("macro_f1"))


@query
def model_summary(spark, sf_dir):
    model, cells, _ = training.class_relative_job(frames.labelled(spark, sf_dir), "record_id", 0.3, SEED)
    rules = ranking.rules_per_class(model.rules, model.totals).select(
        F.lit("rules").alias("part"), "class", F.col("rules").alias("amount")
    )
    rows = training.class_distribution(cells).select(
        F.col("run").alias("part"), "class", F.col("row_count").alias("amount")
    )
    return rules.unionByName(rows)


@query
def class_relative_evaluation(spark, sf_dir):
    _, _, scored = training.class_relative_job(frames.labelled(spark, sf_dir), "record_id", 0.3, SEED)
    found = evaluate.run_metrics(scored)
    return found.select("rows_all", "rows_unmatched", *[_r(c) for c in _METRICS])


# -- quality -----------------------------------------------------------------------


@query
def quality_summary(spark, sf_dir):
    return quality.quality_summary(quality.distinct_records(frames.labelled(spark, sf_dir)))


@query
def conflicting_groups(spark, sf_dir):
    return quality.conflicting_groups(quality.distinct_records(frames.labelled(spark, sf_dir)))


@query
def eda_profile(spark, sf_dir):
    profile = quality.column_profile(
        quality.distinct_records(_derived("labelled_with_faults", spark, sf_dir))
    )
    exact = ("mean", "std", "p25", "p50", "p75")
    return profile.select(
        *[c for c in profile.columns if c not in exact],
        *[F.round(F.col(c).cast("double"), 8).alias(c) for c in exact],
    )


@query
def value_frequencies(spark, sf_dir):
    return quality.value_frequencies(
        quality.distinct_records(_derived("labelled_with_faults", spark, sf_dir))
    )


@query
def correlation_matrix(spark, sf_dir):
    matrix = quality.correlation_matrix(
        quality.distinct_records(frames.labelled(spark, sf_dir))
    )
    return matrix.select("column_a", "column_b", F.round("correlation", 8).alias("correlation"))


# -- pages -------------------------------------------------------------------------


@query
def url_redaction(spark, sf_dir):
    frame = urls.split_url(_derived("request_urls", spark, sf_dir), F.col("url"))
    return frame.select("request_id", urls.redact(F.col("parts")).alias("redacted_url"))


@query
def url_redaction_pages(spark, sf_dir):
    frame = urls.split_url(_derived("raw_pages", spark, sf_dir), F.col("url"))
    return frame.select("page_id", urls.redact(F.col("parts")).alias("redacted_url"))


@query
def url_screening(spark, sf_dir):
    frame = urls.screen(_derived("request_urls", spark, sf_dir))
    return frame.select("request_id", F.col("parts.host").alias("host"), "url_error")


def _observed(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.observe(_derived(name, spark, sf_dir))


@query
def external_links(spark, sf_dir):
    seen = _observed("rendered_pages", spark, sf_dir)
    links = seen.select(
        "page_id", "url", "parts", "page_host", F.posexplode("anchor_hrefs").alias("position", "link")
    )
    return links.select(
        "page_id",
        "position",
        "link",
        urls.resolve(F.col("url"), F.col("parts"), F.col("link")).alias("resolved"),
        urls.is_external(F.col("link"), F.col("page_host")).alias("external"),
    )


def _flat_observations(seen: DataFrame) -> DataFrame:
    return seen.select(
        "page_id",
        "url",
        "host",
        "hostname_is_ip",
        F.array_join(F.transform("resource_urls", lambda r: F.concat_ws(" ", r["kind"], r["url"])), "\n").alias(
            "resources"
        ),
        F.array_join("anchor_hrefs", "\n").alias("anchors"),
        F.array_join("form_actions", "\n").alias("form_actions"),
        "popup_credential_fields",
        F.col("page.status").alias("page_status"),
        F.col("page.forms").alias("form_count"),
        F.col("page.anchors").alias("anchor_count"),
        F.col("page.external_reference_candidates").alias("resource_count"),
        F.col("ssl_state.tls_verified").alias("tls_verified"),
        F.col("ssl_state.observation_status").alias("observation_status"),
    )


@query
def page_observations(spark, sf_dir):
    return _flat_observations(_observed("raw_pages", spark, sf_dir))


@query
def rendered_page_observations(spark, sf_dir):
    return _flat_observations(_observed("rendered_pages", spark, sf_dir))


@query
def raw_feature_values(spark, sf_dir):
    seen = _observed("rendered_pages", spark, sf_dir).withColumn("raw_features", pages.raw_features())
    return seen.select(
        "page_id", *[F.col("raw_features")[name]["raw_value"].alias(name) for name in FEATURES]
    )


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = urls.screen(_derived("rendered_pages", spark, sf_dir).drop("html"))
    return providers.registrable_domain(
        frame.withColumn("host", F.col("parts.host")), "host", providers.common_suffixes(spark)
    )


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


@query
def registrable_domain(spark, sf_dir):
    return _hosts(spark, sf_dir).select("page_id", "host", "registrable_domain")


@query
def domain_age(spark, sf_dir):
    aged = providers.registration_age(
        _hosts(spark, sf_dir), _derived("registrations", spark, sf_dir), _as_of()
    )
    info = F.col("domain_information")
    return aged.select(
        "page_id",
        info["domain"].alias("domain"),
        F.unix_micros(info["creation_date"]).alias("created_micros"),
        F.round(info["age_days"], 6).alias("age_days"),
        F.round(info["age_months"], 6).alias("age_months"),
        info["status"].alias("status"),
    )


@query
def traffic_status(spark, sf_dir):
    frame = providers.traffic(_hosts(spark, sf_dir), _derived("ranks", spark, sf_dir))
    info = F.col("web_traffic")
    return frame.select(
        "page_id",
        info["domain"].alias("domain"),
        info["rank"].alias("rank"),
        info["provider"].alias("provider"),
        info["status"].alias("status"),
    )


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzed = pages.analyze(
        _derived("rendered_pages", spark, sf_dir),
        providers.common_suffixes(spark),
        _as_of(),
        _derived("registrations", spark, sf_dir),
        _derived("ranks", spark, sf_dir),
    )
    return pages.encode(analyzed)


@query
def encode_features(spark, sf_dir):
    return _encoded(spark, sf_dir).select(
        "page_id",
        *[codes.cell(name)["encoded_value"].alias(name) for name in FEATURES],
        *[codes.cell(name)["mapping_status"].alias(f"{name}_status") for name in FEATURES],
        F.round("resource_percent", 8).alias("resource_percent"),
        F.round("anchor_percent", 8).alias("anchor_percent"),
    )


@query
def encode_gate(spark, sf_dir):
    encoded = _encoded(spark, sf_dir)
    return pages.add_route(encoded).select(
        "page_id",
        "route",
        "complete",
        F.size(F.filter("cells", lambda c: c["accepted"])).alias("accepted_features"),
        F.array_join("unresolved_features", ",").alias("unresolved_features"),
    )


# -- history -----------------------------------------------------------------------


def _filtered(spark: SparkSession, sf_dir: str, **args: str) -> DataFrame:
    filters, error = history.parse_filters({**HISTORY_ARGS, **args})
    if error:
        raise ValueError(error)
    return history.apply_filters(_derived("history", spark, sf_dir), filters)


@query
def history_overview(spark, sf_dir):
    return history.overview(_filtered(spark, sf_dir))


@query
def history_filtered(spark, sf_dir):
    rows = _filtered(spark, sf_dir, classification="Phishy", status="predicted")
    return rows.select("id", "url", "prediction", "label", "prediction_status", "created_at")


def _counted(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    model = training.fit(frames.labelled(spark, sf_dir), PARAMS)
    return history.rule_counts(rows, model.vector_table())


@query
def history_rule_counts(spark, sf_dir):
    counted = _counted(spark, sf_dir, _derived("history", spark, sf_dir))
    return counted.select("id", "prediction_status", "label", "rule_count")


@query
def rule_evidence(spark, sf_dir):
    found = history.rule_evidence(_counted(spark, sf_dir, _filtered(spark, sf_dir)))
    return found.withColumn("average_matching_rules", F.round("average_matching_rules", 10))


@query
def feature_distribution(spark, sf_dir):
    rows = vectors.check_vectors(_filtered(spark, sf_dir))
    return history.feature_distribution(rows)


@query
def recent_activity(spark, sf_dir):
    latest = history.recent(_filtered(spark, sf_dir), 20)
    counted = _counted(spark, sf_dir, latest)
    return counted.select(
        "id", "created_at", "url", "label", F.col("prediction_status").alias("status"), "rule_count"
    )


@query
def report_projection(spark, sf_dir):
    """Dashboard report fields read back from a written report."""
    frame = frames.labelled(spark, sf_dir)
    model, scored = _tested(spark, sf_dir)
    path = scratch_table(spark, "report")
    store.write_report(
        {
            "evaluation": evaluate.run_metrics(scored),
            "quality": quality.quality_summary(quality.distinct_records(frame)),
        },
        path,
    )
    return store.report_view(spark, path, model_loaded=True).select(
        *[_r(c) for c in _METRICS],
        "row_count",
        "feature_names",
        "duplicate_rows",
        "unique_rows",
        "conflicting_group_count",
        "missing_values",
        "model_loaded",
        "integrity",
    )


# -- stores ------------------------------------------------------------------------


@query
def dataset_fingerprint(spark, sf_dir):
    records = quality.distinct_records(frames.labelled(spark, sf_dir))
    return fingerprint.fingerprint(records, weight="n")


@query
def rule_store_roundtrip(spark, sf_dir):
    model = training.fit(frames.labelled(spark, sf_dir), PARAMS)
    path = scratch_table(spark, "model")
    digest = store.save_model(model, path)
    store.export_rules_csv(model.rules, f"{path}/csv")
    store.export_rules_json(model.rules, f"{path}/json", "strength")
    loaded = store.load_verified_model(spark, path, digest, strict=True)
    return loaded.rules.select(*_rule_columns())


@query
def history_append(spark, sf_dir):
    """Scored and blocked rows appended to a history and read back."""
    frame = frames.labelled(spark, sf_dir)
    model = training.fit(frame, PARAMS)
    path = scratch_table(spark, "history")
    checked = vectors.spread_codes(vectors.check_vectors(_derived("history", spark, sf_dir)))
    valid = checked.where(F.col("vector_error").isNull())
    scored = scoring.score(valid, model.vector_table())
    history_store.append_history(history.scored_rows(scored, F.col("created_at")), path)
    blocked = pages.blocked_rows(pages.add_route(_encoded(spark, sf_dir)))
    moment = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    history_store.append_history(
        history.blocked_rows(blocked.withColumn("id", F.col("page_id")), moment), path
    )
    stored = history_store.read_history(spark, path)
    return stored.groupBy("prediction_status", "label").agg(F.count("*").alias("row_count"))


@query
def routed_history(spark, sf_dir):
    """Pages of all routes committed as one batch and read back: history rows and refused ones."""
    requests = _derived("vector_requests", spark, sf_dir)
    rows = requests.select(F.col("request_id").alias("id"), "url", F.lit("<a href='/x'>x</a><form>").alias("html"))
    lookups = routing.Lookups(
        providers.common_suffixes(spark), _as_of(), vectors=_derived("vector_provider", spark, sf_dir)
    )
    model = training.fit(frames.labelled(spark, sf_dir), PARAMS)
    path, moment = scratch_table(spark, "routed"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    routing.commit_routed(rows, path, "batch", lookups, model.vector_table(), moment)
    stored = history_store.read_history(spark, path)
    kept = stored.select("id", "prediction_status", F.lit(None).cast("string").alias("error"), F.col("prediction").isNotNull().alias("predicted"))
    refused = routing.read_refused(spark, path).select("id", F.lit("refused").alias("prediction_status"), "error", F.lit(False).alias("predicted"))
    return kept.unionByName(refused)


@query
def legacy_history(spark, sf_dir):
    """A history written without states, read in the current schema."""
    old = _derived("history", spark, sf_dir).drop("prediction_status")
    path = scratch_table(spark, "legacy")
    old.withColumn("day", F.to_date("created_at")).write.partitionBy("day").parquet(path)
    stored = history_store.read_history(spark, path)
    return stored.select("id", "url", "prediction", "label", "prediction_status", "created_at")


@query
def report_sinks(spark, sf_dir):
    """Evaluation report, quality report and manifest written and read back."""
    frame = frames.labelled(spark, sf_dir)
    model, scored = _tested(spark, sf_dir)
    metrics = evaluate.run_metrics(scored)
    records = quality.distinct_records(frame)
    path = scratch_table(spark, "reports")
    store.write_report(
        {
            "confusion": evaluate.confusion_matrix(scored),
            "classes": evaluate.class_metrics(scored),
            "quality": quality.quality_summary(records),
            "manifest": store.manifest(records, model, metrics),
        },
        path,
    )
    parts = [
        spark.read.json(f"{path}/{name}").select(
            F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("document")
        )
        for name in ("confusion", "classes", "quality", "manifest")
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def item_table_roundtrip(spark, sf_dir):
    """The item-encoded mining table and the deduplicated copy, written and read back."""
    path = scratch_table(spark, "items")
    source = f"{path}/labelled"
    frames.labelled(spark, sf_dir).select(*RECORD).write.parquet(source)
    encoded = tables.write_item_table(spark, source, f"{path}/items")
    kept = tables.write_deduplicated(spark, source, f"{path}/unique")
    written = spark.read.csv(f"{path}/items", header=True, schema=encoded.schema)
    unique = spark.read.csv(f"{path}/unique", header=True, schema=kept.schema)
    by_class = written.groupBy(F.col(TARGET).alias("class_item")).agg(F.count("*").alias("row_count"))
    singles = unique.groupBy(items.class_item(F.col(TARGET)).alias("class_item")).agg(
        F.count("*").alias("unique_rows")
    )
    return by_class.join(singles, "class_item")
