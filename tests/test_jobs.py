from __future__ import annotations

import warnings
from collections import Counter
from datetime import datetime
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from helpers import frame_of, random_rows
from ruleweave.contract import FEATURES, HISTORY_SCHEMA, RECORD, TARGET
from ruleweave.operators import evaluate, explain, fingerprint, history, mining, ranking, scoring, split
from ruleweave.operators.mining import Mining
from ruleweave.plans import training
from ruleweave.sources import history_store, store
from ruleweave.streaming import scoring as streams

ROWS = random_rows(400, 5)
PARAMS = Mining(0.05, 0.5, 1.0, max_len=4)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(f"r{i}", *row) for i, row in enumerate(ROWS)]
    return spark.createDataFrame(rows, ["record_id", *RECORD]).select(
        "record_id", *[F.col(n).cast("int").alias(n) for n in RECORD]
    ).cache()


@pytest.fixture(scope="module")
def model(frame):
    return training.fit(frame, PARAMS)


# -- splits ------------------------------------------------------------------------


def test_group_split(frame):
    placed = split.group_split(frame, 0.2, 42).collect()
    again = {r["record_id"]: r["side"] for r in split.group_split(frame.repartition(3), 0.2, 42).collect()}
    assert {r["record_id"]: r["side"] for r in placed} == again and len(again) == len(ROWS)
    sides = {}
    for r in placed:
        sides.setdefault(tuple(r[n] for n in RECORD), set()).add(r["side"])
    assert all(len(s) == 1 for s in sides.values())
    test = [r for r in placed if r["side"] == "test"]
    assert abs(len(test) / len(ROWS) - 0.2) <= 0.01
    for label in (-1, 0, 1):
        assert {r["side"] for r in placed if r["Result"] == label} == {"train", "test"}


def test_hot_record_does_not_spoil_the_split(spark):
    rows = ROWS + [(1,) * 9 + (1,)] * 300
    cells = mining.weigh(frame_of(spark, rows))
    groups = split.assign_groups(cells, 0.2, 42)
    n = {r["side"]: r["n"] for r in groups.groupBy("side").agg(F.sum("n").alias("n")).collect()}
    assert abs(n["test"] / len(rows) - 0.2) <= 0.01


def test_single_group_class_stays_in_training(spark):
    rows = [(1,) * 9 + (1,)] * 5 + [(0,) * 9 + (0,)] * 3 + [(0,) * 8 + (1, 0)] * 2
    groups = split.assign_groups(mining.weigh(frame_of(spark, rows)), 0.4, 1).collect()
    assert {g["side"] for g in groups if g["class"] == 1} == {"train"}
    assert sorted((g["n"], g["side"]) for g in groups if g["class"] == 0) == [(2, "test"), (3, "train")]


@pytest.mark.parametrize("digits, cell_rows", [(1, 1), (1, 5), (2, 10**6), (32, 1)])
def test_row_split_is_exact_at_any_prefix_length(frame, digits, cell_rows):
    placed = split.row_split(frame, "record_id", 0.3, 7, digits=digits, cell_rows=cell_rows).collect()
    order = {c: sorted((md5(f"7|{r['record_id']}".encode()).hexdigest(), r["record_id"]) for r in placed if r["Result"] == c) for c in (-1, 0, 1)}
    first = {k for own in order.values() for _, k in own[: max(1, round(len(own) * 0.3))]}
    assert {r["record_id"] for r in placed if r["side"] == "test"} == first
    sizes = Counter((r["Result"], r["side"]) for r in placed)
    for label, n in Counter(row[9] for row in ROWS).items():
        assert sizes[label, "test"] == max(1, round(n * 0.3))
    base = split.row_split(frame, "record_id", 0.3, 7, digits=3).collect()
    assert {r["record_id"]: r["side"] for r in placed} == {r["record_id"]: r["side"] for r in base}


def test_folds_are_even(frame):
    folded = split.stratified_folds(frame, "record_id", 5, 3, digits=1, cell_rows=2).collect()
    sizes = Counter((r["Result"], r["fold"]) for r in folded)
    for label in (-1, 0, 1):
        counts = [sizes[label, f] for f in range(5)]
        assert max(counts) - min(counts) <= 1 and sum(counts) == sum(r[9] == label for r in ROWS)


def test_training_folds_equal_split_then_folds(frame):
    train = split.row_split(frame, "record_id", 0.3, 3, digits=1).where("side = 'train'").drop("side")
    two = split.stratified_folds(train, "record_id", 5, 3, digits=1)
    one = split.training_folds(frame, "record_id", 0.3, 5, 3, digits=2)
    as_map = lambda rows: {r["record_id"]: r["fold"] for r in rows.collect()}
    assert as_map(one) == as_map(two)


def test_rows_are_placed_without_a_shuffle(frame):
    for placed in (
        split.row_split(frame, "record_id", 0.3, 7),
        split.stratified_folds(frame, "record_id", 5, 7),
        split.training_folds(frame, "record_id", 0.3, 5, 7),
    ):
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_rows_of_one_key_stay_together(spark):
    rows = [(k, *[1] * 9, 1) for k in ["a"] * 40 + ["b", "c", "d"] * 2 + [None] * 30 + [f"k{i}" for i in range(24)]]
    frame = spark.createDataFrame(rows, f"record_id string, {', '.join(f'{f} int' for f in FEATURES)}, {TARGET} int")
    for seed in range(6):
        placed = split.row_split(frame, "record_id", 0.3, seed, digits=1, cell_rows=3).collect()
        assert len(placed) == 100
        sides = {}
        for r in placed:
            sides.setdefault(r["record_id"], set()).add(r["side"])
        assert all(len(s) == 1 for s in sides.values())
        n = sum(r["side"] == "test" for r in placed)
        weight = Counter(r["record_id"] for r in placed)
        order = sorted(weight, key=lambda k: (md5(f"{seed}|{k or ''}".encode()).hexdigest(), k or ""))
        sums = [0]
        for k in order:
            sums.append(sums[-1] + weight[k])
        assert n in sums and abs(n - 30) == min(abs(x - 30) for x in sums)


def test_seeded_order(frame):
    order = [r["record_id"] for r in split.seeded_order(frame, "record_id", 1).collect()]
    other = [r["record_id"] for r in split.seeded_order(frame, "record_id", 2).collect()]
    assert sorted(order) == sorted(other) and order != other


def test_split_analysis_and_shared_vectors(frame):
    sided = split.row_split(frame, "record_id", 0.3, 7, digits=1)
    rows = sided.collect()
    sides = {s: {tuple(r[n] for n in RECORD) for r in rows if r["side"] == s} for s in ("train", "test")}
    vectors = {s: {k[:9] for k in keys} for s, keys in sides.items()}
    found = split.split_analysis(split.side_cells(sided)).first()
    assert found["record_groups_total"] == len(sides["train"] | sides["test"])
    assert found["shared_records"] == len(sides["train"] & sides["test"])
    assert found["feature_groups_shared"] == len(vectors["train"] & vectors["test"])
    assert split.shared_vectors(split.side_cells(sided)).count() == found["feature_groups_shared"]


# -- evaluation --------------------------------------------------------------------


def test_metrics_against_plain_counting(frame, model):
    scored = scoring.score(frame, model.vector_table()).collect()
    pairs = [(r["Result"], r["predicted"]) for r in scored]
    cells = scoring.score_cells(mining.weigh(frame), model.vector_table())
    confusion = {(r["actual"], r["predicted"]): r["row_count"] for r in evaluate.confusion_matrix(cells).collect()}
    counted = Counter(pairs)
    assert confusion == {(a, p): counted[a, p] for a in (-1, 0, 1) for p in (-1, 0, 1)}
    metrics = {r["label"]: r for r in evaluate.class_metrics(cells).collect()}
    f1 = []
    for label in (-1, 0, 1):
        tp = counted[label, label]
        predicted = sum(p == label for _, p in pairs)
        actual = sum(a == label for a, _ in pairs)
        precision, recall = tp / predicted if predicted else 0.0, tp / actual if actual else 0.0
        f1.append(2 * precision * recall / (precision + recall) if precision + recall else 0.0)
        row = metrics[str(label)]
        assert (row["precision"], row["recall"], row["f1"], row["support"]) == (precision, recall, f1[-1], actual)
    assert metrics["macro avg"]["f1"] == pytest.approx(sum(f1) / 3)
    assert metrics["macro avg"]["accuracy"] == sum(a == p for a, p in pairs) / len(pairs)
    found = evaluate.coverage(cells).first()
    assert found["rows_matched"] == sum(r["matching_rule_count"] > 0 for r in scored)
    wrong = evaluate.errors(evaluate.record_evaluation(frame, model.vector_table(), model.rules))
    assert wrong.count() == sum(a != p for a, p in pairs)


def test_rows_are_held_against_one_small_table(frame):
    model = training.fit(frame, PARAMS)
    found = evaluate.record_evaluation(frame, model.vector_table(), model.rules)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1


def test_experiments_equal_separate_fits(frame):
    cells = training.group_sides(frame, 0.2, 42)
    found = {r["min_confidence"]: r for r in training.threshold_experiments(cells, [0.5, 0.8], 0.05).collect()}
    for t, row in found.items():
        fitted = training.fit_cells(training.side(cells, "train"), Mining(0.05, t))
        scored = scoring.score_cells(training.side(cells, "test"), fitted.vector_table())
        alone = evaluate.run_metrics(scored).first()
        assert row["kept_rules"] == fitted.rules.count()
        assert (row["accuracy"], row["macro_f1"]) == (alone["accuracy"], alone["macro_f1"])


def test_zeros_when_nothing_is_mined(frame):
    cells = split.side_cells(split.row_split(frame, "record_id", 0.3, 7))
    found = training.threshold_experiments(cells, [0.9, 1.0], min_support=0.999).collect()
    assert [(r["frequent_itemsets"], r["generated_rules"], r["kept_rules"]) for r in found] == [(0, 0, 0)] * 2
    assert all(r["accuracy"] is not None and r["unmatched_rows"] for r in found)
    fitted = training.fit(frame, Mining(0.999, 0.9))
    assert {(r["field"], r["rules"]) for r in ranking.rule_characteristics(fitted.rules, fitted.totals).collect()} == {
        (f, 0) for f in ("support", "confidence", "lift", "antecedent_length")
    }
    assert sorted((r["class"], r["rules"]) for r in ranking.rules_per_class(fitted.rules, fitted.totals).collect()) == [(-1, 0), (0, 0), (1, 0)]


def test_threshold_choice(spark):
    rows = [(0.3, 0.5, 0.6), (0.5, 0.7, 0.6), (0.7, 0.7, 0.6), (0.9, 0.9, 0.5)]
    frame = spark.createDataFrame(rows, "min_confidence double, accuracy double, macro_f1 double")
    assert evaluate.select_threshold(frame).first()["min_confidence"] == 0.7


def test_cross_validation_fits_without_the_held_out_fold(frame):
    folded = split.stratified_folds(frame, "record_id", 4, 3, digits=1).cache()
    found = {r["run"]: r for r in training.cross_validate(training.fold_cells(folded), 4, min_support=0.05).collect()}
    for fold in range(4):
        fitted = training.fit_class_relative(mining.weigh(folded.where(F.col("fold") != fold)), min_support=0.05)
        held = mining.weigh(folded.where(F.col("fold") == fold))
        alone = evaluate.run_metrics(scoring.score_cells(held, fitted.vector_table())).first()
        assert found[str(fold)]["accuracy"] == alone["accuracy"]
        assert found[str(fold)]["rows_fit"] + found[str(fold)]["rows_all"] == len(ROWS)


def test_explanations(frame, model):
    vectors = explain.distinct_vectors(frame)
    documents = {r["vector"]: r for r in explain.explanations(vectors, model.rules, 3).collect()}
    table = {r["vector"]: r["matching_rule_count"] for r in model.vector_table().collect()}
    assert len(documents) == len({r[:9] for r in ROWS})
    for vector, document in documents.items():
        assert document["matching_rule_count"] == table[vector]
        assert len(document["matching_rules"] or []) == min(3, table[vector])
        assert [e["feature"] for e in document["feature_evidence"]] == list(FEATURES)
        assert document["has_matching_rules"] == (table[vector] > 0)
    with pytest.raises(ValueError):
        scoring.top_matches(vectors, 0)


# -- stores ------------------------------------------------------------------------


def test_model_store(spark, model, tmp_path):
    path = str(tmp_path / "model")
    digest = store.save_model(model, path)
    loaded = store.load_verified_model(spark, path, digest.upper(), strict=True)
    assert loaded.rules.count() == model.rules.count()
    assert sorted(map(tuple, loaded.vector_table().collect())) == sorted(map(tuple, model.vector_table().collect()))
    with pytest.raises(store.ModelError, match="integrity"):
        store.load_verified_model(spark, path, "0" * 64)
    with pytest.raises(store.ModelError, match="required"):
        store.load_verified_model(spark, path, strict=True)
    with pytest.raises(store.ModelError, match="Unsupported"):
        store.load_model(spark, path, "class_relative")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        store.load_verified_model(spark, path)
    assert any("unverified" in str(w.message) for w in caught)


def test_unfitted_model_is_refused(spark, tmp_path):
    empty = training.fit(frame_of(spark, []), PARAMS)
    with pytest.raises(store.ModelError, match="unfitted"):
        store.save_model(empty, str(tmp_path / "none"))


def test_rule_exports(spark, model, tmp_path):
    store.export_rules_csv(model.rules, str(tmp_path / "csv"))
    store.export_rules_json(model.rules, str(tmp_path / "json"), "strength")
    csv = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert csv.count() == spark.read.json(str(tmp_path / "json")).count() == model.rules.count()
    assert csv.columns[0] == "antecedent"


def test_reports(spark, frame, model, tmp_path):
    path = str(tmp_path / "report")
    view = store.report_view(spark, path, model_loaded=True, verified=True).collect()
    assert len(view) == 1 and view[0]["accuracy"] is None and view[0]["integrity"] == "Verified"
    cells = scoring.score_cells(mining.weigh(frame), model.vector_table())
    store.write_report({"evaluation": evaluate.run_metrics(cells)}, path)
    view = store.report_view(spark, path, model_loaded=False, verified=True).collect()
    assert len(view) == 1 and 0 < view[0]["accuracy"] <= 1 and view[0]["row_count"] is None
    assert view[0]["integrity"] != "Verified"


def test_fingerprint(frame):
    rows = frame.select(*RECORD)
    one = fingerprint.fingerprint(rows).first()
    assert fingerprint.fingerprint(rows.repartition(5).select(*reversed(RECORD))).first() == one
    grouped = rows.groupBy(*RECORD).agg(F.count("*").alias("n"))
    assert fingerprint.fingerprint(grouped, weight="n").first() == one
    assert fingerprint.fingerprint(rows.unionByName(rows.limit(1))).first() != one
    assert fingerprint.fingerprint(rows.dropDuplicates()).first()["digest"] != one["digest"]


# -- history -----------------------------------------------------------------------

HISTORY = [
    (11, "https://a.example.org/login", 0, "Suspicious", 0, "predicted", datetime(2025, 3, 2, 8, 30)),
    (12, "https://b.example.org/", -1, "Phishy", -1, "predicted", datetime(2025, 3, 2, 23, 59, 59)),
    (13, "https://c.example.org/x", None, None, None, "feature_mapping_unavailable", datetime(2025, 3, 5)),
    (14, "https://d.example.org/", 1, "Legitimate", 1, "predicted", datetime(2025, 3, 7, 12)),
]


@pytest.fixture(scope="module")
def past(spark):
    def text(value):
        if value is None:
            return '{"SFH":{"encoded_value":null}}'
        codes = {n: value for n in FEATURES} | {"age_of_domain": 1, "having_IP_Address": 0}
        return "{" + ",".join(f'"{k}":{v}' for k, v in codes.items()) + "}"

    rows = [(*r[:4], text(r[4]), *r[5:]) for r in HISTORY]
    return spark.createDataFrame(rows, HISTORY_SCHEMA).cache()


def test_filters(past):
    def ids(**args):
        filters, error = history.parse_filters(args)
        return sorted(r["id"] for r in history.apply_filters(past, filters).collect()), error

    assert ids() == ([11, 12, 13, 14], None)
    assert ids(classification="Phishy", status="predicted") == ([12], None)
    assert ids(date_from="2025-03-05") == ([13, 14], None)
    assert ids(date_to="2025-03-02") == ([11, 12], None)
    assert ids(classification="Suspicious; --") == ([11, 12, 13, 14], "Unsupported classification filter.")
    assert ids(date_from="02/03/2025", status="predicted") == ([11, 12, 14], "Dates must use the YYYY-MM-DD format.")
    assert ids(date_from="bad", status="bad")[1] == "Unsupported prediction status filter."
    end = history.parse_filters({"date_to": "2025-03-02"})[0]["date_to"]
    assert end == datetime(2025, 3, 2, 23, 59, 59, 999999)


def test_dashboard(past, model):
    row = history.overview(past).first().asDict()
    assert row == {"total": 4, "phishy": 1, "suspicious": 1, "legitimate": 1, "predicted": 3, "mapping_unverified": 1}
    counted = history.rule_counts(past, model.vector_table())
    counts = {r["id"]: r["rule_count"] for r in counted.collect()}
    assert counts.pop(13) is None and counts[12] > 0 and counts[14] > 0
    found = history.rule_evidence(counted).first()
    assert found["prediction_count"] == 3 and found["average_matching_rules"] == sum(counts.values()) / 3
    values = {(r["feature"], r["value"]): (r["row_count"], r["observations"]) for r in history.feature_distribution(counted).collect()}
    assert values["SFH", -1] == (1, 3) and values["age_of_domain", 1] == (3, 3)
    assert [r["id"] for r in history.recent(past, 2).collect()] == [14, 13]


def test_history_store(spark, past, tmp_path):
    path = str(tmp_path / "history")
    assert history_store.read_history(spark, path).count() == 0
    history_store.append_history(past, path)
    history_store.append_history(past, path)
    stored = history_store.read_history(spark, path)
    assert stored.count() == 8
    filters, _ = history.parse_filters({"date_from": "2025-03-05"})
    assert history.apply_filters(stored, filters).count() == 4


def test_older_history_without_states(spark, past, tmp_path):
    path = str(tmp_path / "old")
    past.drop("prediction_status").write.parquet(path)
    assert {r["prediction_status"] for r in history_store.read_history(spark, path).collect()} == {"predicted"}


def test_stream_scoring(spark, past, model, tmp_path):
    past.select("id", "features").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, features string").parquet(str(tmp_path / "in"))
    table = model.vector_table().cache()
    out = str(tmp_path / "out")
    moment = F.lit("2026-09-20 00:00:00").cast("timestamp_ntz")
    scored = streams.score_vectors(stream, table)
    streams.write_history(scored, out, str(tmp_path / "checkpoint"), moment).awaitTermination()
    # A second start finds nothing new; a repeated batch would replace its own folder.
    streams.write_history(scored, out, str(tmp_path / "checkpoint"), moment).awaitTermination()
    stored = history_store.read_history(spark, out).orderBy("id").collect()
    batch = streams.score_vectors(past.select("id", "features"), table).where("vector_error IS NULL")
    expected = {r["id"]: r["predicted"] for r in batch.collect()}
    assert {r["id"]: r["prediction"] for r in stored} == expected and len(expected) == 3


def test_stream_pages(spark, tmp_path):
    pages = [("https://example.com/", "<a href='/x'>x</a>"), ("http://localhost/", None)]
    spark.createDataFrame(pages, "url string, html string").write.parquet(str(tmp_path / "pages"))
    stream = spark.readStream.schema("url string, html string").parquet(str(tmp_path / "pages"))
    query = (
        streams.observe_pages(stream)
        .writeStream.format("memory")
        .queryName("seen_pages")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert {tuple(r["anchor_hrefs"]) for r in spark.table("seen_pages").collect()} == {("/x",), ()}


def test_no_row_leaves_splits_unseen(spark):
    good = spark.range(60).select(F.concat(F.lit("r"), "id").alias("record_id"), *[F.lit(1).alias(f) for f in FEATURES], F.expr("cast(id % 3 - 1 as int)").alias(TARGET))
    odd = good.limit(9).withColumn(TARGET, F.lit(None).cast("int")).withColumn("record_id", F.lit(None).cast("string"))
    frame = good.unionByName(odd)
    assert split.row_split(frame, "record_id", 0.3, 7).count() == 69
    assert split.stratified_folds(frame, "record_id", 5, 3).count() == 69
    for call in (lambda: split.group_split(frame).count(), lambda: mining.weigh(frame).count(), lambda: mining.weigh(good.withColumn(FEATURES[0], F.lit(7))).count()):
        with pytest.raises(Exception, match="missing or invalid values"):
            call()
