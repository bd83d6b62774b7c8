import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from lapsewatch.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", cores="4", spark__sql__shuffle__partitions="4")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


BASE = dict(zip(
    "customerID gender SeniorCitizen Partner Dependents tenure".split(),
    ["c-7", "Female", 0, "No", "Yes", 18]))
BASE |= dict.fromkeys(["PhoneService", "MultipleLines", "OnlineSecurity", "DeviceProtection", "StreamingTV"], "Yes")
BASE |= dict.fromkeys(["OnlineBackup", "TechSupport", "StreamingMovies", "PaperlessBilling", "Churn"], "No")
BASE |= {"InternetService": "DSL", "Contract": "One year", "PaymentMethod": "Mailed check",
         "MonthlyCharges": 58.5, "TotalCharges": "1040.00"}


@pytest.fixture(scope="session")
def customers(spark):
    """customers(row_changes, ...) -> raw rows that differ from the base row as given."""
    from lapsewatch import constants as K

    def build(*changes):
        rows = [tuple({**BASE, "customerID": f"id-{i}", **c}[n] for n in K.RAW_COLUMNS)
                for i, c in enumerate(changes)]
        return spark.createDataFrame(rows, K.RAW_SCHEMA)
    return build
