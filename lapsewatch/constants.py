"""Fixed values shared by all operators."""

# Business costs, tiers, gates and monitoring thresholds.
FALSE_NEGATIVE_COST = 500.0
FALSE_POSITIVE_COST = 20.0
HIGH_RISK = 0.60
MEDIUM_RISK = 0.35
MIN_ROC_AUC = 0.82
MIN_PR_AUC = 0.65
MIN_RECALL = 0.70
MIN_PRECISION = 0.45
POSITIVE_CLASS_WEIGHT = 2.76
PSI_LIMIT = 0.25
PSI_MODERATE = 0.10
PSI_FLOOR = 1e-6
CHI_SQUARE_ALPHA = 0.05
PREDICTION_DRIFT_LIMIT = 0.15
PREDICTION_DRIFT_MODERATE = 0.10
F1_DROP_LIMIT = 0.05
REFERENCE_DAYS = 90
MONITORING_DAYS = 7
LABEL_DELAY_DAYS = 45
FEATURE_TTL_DAYS = 3650
PARITY_LIMIT = 0.8
ODDS_LIMIT = 0.10
CONFIDENCES = (0.90, 0.95)
SEED = 42

# Column domains of the customer table.
YES_NO = ["Yes", "No"]
PHONE_OPTIONS = ["Yes", "No", "No phone service"]
INTERNET_OPTIONS = ["Yes", "No", "No internet service"]
INTERNET_KINDS = ["DSL", "Fiber optic", "No"]
CONTRACTS = ["Month-to-month", "One year", "Two year"]
AUTOMATIC_PAYMENTS = ["Bank transfer (automatic)", "Credit card (automatic)"]
PAYMENTS = ["Electronic check", "Mailed check", *AUTOMATIC_PAYMENTS]
ADD_ONS = [
    "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies",
]

# Allowed values by column, in table order.
DOMAINS = {
    "gender": ["Male", "Female"],
    "Partner": YES_NO,
    "Dependents": YES_NO,
    "PhoneService": YES_NO,
    "MultipleLines": PHONE_OPTIONS,
    "InternetService": INTERNET_KINDS,
    **{c: INTERNET_OPTIONS for c in ADD_ONS},
    "Contract": CONTRACTS,
    "PaperlessBilling": YES_NO,
    "PaymentMethod": PAYMENTS,
}

# The 21 columns of the raw table and their Spark types, in file order.
RAW_SCHEMA = (
    "customerID string, gender string, SeniorCitizen int, Partner string, Dependents string, "
    "tenure int, PhoneService string, MultipleLines string, InternetService string, "
    "OnlineSecurity string, OnlineBackup string, DeviceProtection string, TechSupport string, "
    "StreamingTV string, StreamingMovies string, Contract string, PaperlessBilling string, "
    "PaymentMethod string, MonthlyCharges double, TotalCharges string, Churn string"
)
RAW_COLUMNS = [part.split()[0] for part in RAW_SCHEMA.split(", ")]
REQUEST_COLUMNS = [c for c in RAW_COLUMNS if c not in ("customerID", "Churn")]

# Feature routes: which encoding each of the 47 model inputs takes.
TENURE_GROUPS = ["0-6m", "7-12m", "13-24m", "25-48m", "49m+"]
CHARGE_BINS = ["Low", "Medium", "High"]
CATEGORICAL = [
    "gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService", "MultipleLines",
    "InternetService", *ADD_ONS, "Contract", "PaperlessBilling", "PaymentMethod",
    "tenure_group", "monthly_charge_bin",
]
NUMERIC = [
    "tenure", "MonthlyCharges", "TotalCharges", "service_adoption_count",
    "charge_to_tenure_ratio", "avg_charge_per_service", "charges_gap", "streaming_count",
    "security_service_count", "internet_addon_count", "contract_numeric", "composite_churn_risk",
]
BINARY = [
    "is_month_to_month", "has_protection_bundle", "is_fiber_optic", "has_family", "is_isolated",
    "senior_no_support", "is_auto_pay", "is_electronic_check", "is_high_monthly_charge",
    "has_internet", "has_full_streaming", "has_no_internet_addons", "is_committed_customer",
    "m2m_and_fiber", "new_high_value_customer", "fiber_no_security", "paperless_and_echeck",
]
MODEL_INPUTS = CATEGORICAL + NUMERIC + BINARY
