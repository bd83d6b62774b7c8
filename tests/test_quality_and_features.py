import pytest
from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.operators import features, prepare, quality
from lapsewatch.sources import files


def test_blank_totals_take_the_monthly_charge(customers):
    rows = quality.repair_total_charges(customers(
        {"TotalCharges": "", "MonthlyCharges": 29.85}, {"TotalCharges": "   ", "MonthlyCharges": 55.0},
        {"TotalCharges": "1680.00"}, {"TotalCharges": "n/a", "MonthlyCharges": 20.0}))
    assert [r.TotalCharges for r in rows.orderBy("customerID").collect()] == [29.85, 55.0, 1680.0, 20.0]


@pytest.mark.parametrize("change, column, rule", [
    ({"gender": "X"}, "gender", "allowed"), ({"tenure": -1}, "tenure", "range"),
    ({"tenure": 101}, "tenure", "range"), ({"MonthlyCharges": 0.0}, "MonthlyCharges", "positive"),
    ({"Contract": None}, "Contract", "not_null"), ({"SeniorCitizen": 2}, "SeniorCitizen", "allowed"),
    ({"TotalCharges": "-1"}, "TotalCharges", "not_negative"), ({"Churn": "Maybe"}, "Churn", "allowed"),
    ({"PaymentMethod": "Cash"}, "PaymentMethod", "allowed"),
    ({"MultipleLines": "No internet service"}, "MultipleLines", "allowed"),
])
def test_one_bad_value_breaks_one_rule(customers, change, column, rule):
    cases = quality.failure_cases(customers(change, {}), K.RAW_COLUMNS).collect()
    assert [(c.customerID, c.column_name, c.rule) for c in cases] == [("id-0", column, rule)]
    with pytest.raises(ValueError, match=f"{column}/{rule}: 1"):
        quality.validate(customers(change, {}))


def test_valid_rows_pass_and_extra_columns_are_allowed(customers):
    rows = customers({}, {}).withColumn("extra", F.lit(1))
    assert quality.validate(rows).count() == 2
    with pytest.raises(ValueError, match="tenure"):
        quality.validate(rows.drop("tenure"))


def test_split_rows_keeps_every_row_once(customers):
    good, bad = quality.split_rows(customers({}, {"tenure": -1, "gender": None}, {}))
    assert good.count() == 2
    assert [r.reasons for r in bad.collect()] == ["gender:not_null,tenure:range"]


def test_target_encoding(customers):
    coded = prepare.encode_target(customers({"Churn": "Yes"}, {"Churn": "No"}))
    assert [r.label for r in coded.orderBy("customerID").collect()] == [1, 0]
    assert "label" not in prepare.encode_target(customers({}).drop("Churn")).columns
    with pytest.raises(Exception, match="unexpected Churn: Maybe"):
        prepare.encode_target(customers({"Churn": "Maybe"})).collect()
    with pytest.raises(ValueError):
        prepare.feature_target_split(customers({}).drop("Churn"))


def engineered(rows):
    return features.engineer(prepare.clean(rows)).orderBy("customerID").collect()


@pytest.mark.parametrize("tenure, group", [
    (0, "0-6m"), (6, "0-6m"), (7, "7-12m"), (12, "7-12m"), (13, "13-24m"), (24, "13-24m"),
    (25, "25-48m"), (48, "25-48m"), (49, "49m+"), (100, "49m+"), (-1, "nan")])
def test_tenure_groups(customers, tenure, group):
    assert engineered(customers({"tenure": tenure}))[0].tenure_group == group


def test_feature_values_of_the_base_row(customers):
    row = engineered(customers({}))[0]
    assert row.service_adoption_count == 6 and row.internet_addon_count == 3
    assert row.charge_to_tenure_ratio == 58.5 / 19
    assert row.avg_charge_per_service == 58.5 / 7
    assert row.charges_gap == -13.0
    assert (row.m2m_and_fiber, row.fiber_no_security, row.paperless_and_echeck) == (0, 0, 0)
    assert row.monthly_charge_bin == "Medium" and row.is_high_monthly_charge == 0


def test_flags_of_a_monthly_fiber_customer(customers):
    row = engineered(customers({
        "Contract": "Month-to-month", "InternetService": "Fiber optic", "OnlineSecurity": "No",
        "PaperlessBilling": "Yes", "PaymentMethod": "Electronic check", "MonthlyCharges": 80.0}))[0]
    assert (row.m2m_and_fiber, row.fiber_no_security, row.paperless_and_echeck) == (1, 1, 1)
    assert row.monthly_charge_bin == "High" and row.is_high_monthly_charge == 1


def test_risky_and_loyal_scores(customers):
    risky = {"Contract": "Month-to-month", "InternetService": "Fiber optic", "Dependents": "No",
             "PaymentMethod": "Electronic check", "MonthlyCharges": 95.0, **dict.fromkeys(K.ADD_ONS, "No")}
    loyal = {"Contract": "Two year", "InternetService": "DSL", "TechSupport": "Yes",
             "OnlineSecurity": "Yes", "PaymentMethod": "Credit card (automatic)",
             "MonthlyCharges": 50.0}
    first, second = engineered(customers(risky, loyal))
    assert first.composite_churn_risk >= 5 and second.composite_churn_risk <= 2


def test_null_counts_as_different(customers):
    row = engineered(customers({
        "InternetService": "Fiber optic", "Dependents": "No", "OnlineSecurity": None, "Partner": None,
        "Contract": None}))[0]
    assert (row.fiber_no_security, row.has_family, row.is_isolated) == (1, 0, 1)
    assert (row.is_month_to_month, row.contract_numeric) == (0, 0)


def test_family_and_isolation_are_complements(spark, sf_dir):
    from lapsewatch.plans.intake import model_rows
    rows = model_rows(spark, sf_dir)
    assert rows.where("has_family + is_isolated <> 1").isEmpty()
    assert rows.where("composite_churn_risk NOT BETWEEN 0 AND 7").isEmpty()
    assert len(set(K.MODEL_INPUTS)) == len(K.MODEL_INPUTS) == 47
    assert set(K.MODEL_INPUTS) <= set(rows.columns)


def test_missing_feature_source_is_an_error(customers):
    with pytest.raises(ValueError, match="TechSupport"):
        features.engineer(customers({}).drop("TechSupport"))


def test_csv_errors(spark, customers, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load_raw(spark, str(tmp_path / "none.csv"))
    empty = tmp_path / "empty.csv"
    empty.write_text(",".join(K.RAW_COLUMNS) + "\n")
    with pytest.raises(ValueError):
        files.load_raw(spark, str(empty))


def test_snapshot_round_trip_keeps_types(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, 20.0 + i, "One year", i % 2, i / 10) for i in range(5)],
        "tenure int, MonthlyCharges double, Contract string, label int, prob double")
    path = files.save_snapshot(rows, str(tmp_path / "snap"), prob="prob", model_version="7")
    assert files.load_snapshot(spark, path).dtypes == rows.dtypes
    meta = files.load_metadata(spark, path).first()
    assert (meta.n_rows, meta.n_features, meta.churn_rate, meta.mean_prediction) == (5, 3, 0.4, 0.2)
    with pytest.raises(FileNotFoundError):
        files.load_snapshot(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError, match="missing columns"):
        files.batch_intake(rows)
