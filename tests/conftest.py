import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sealdex.plans.people import PEOPLE  # noqa: E402
from sealdex.plans.vault import Secrets, Vault  # noqa: E402
from sealdex.session import build_session, scratch_path  # noqa: E402
from sealdex.sources.records import record_lines  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SECRETS = Secrets(b"test master", b"test search", b"test word")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "sealdex-tests",
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_people(n=101):
    """Synthetic people: three countries in turn, some named Douglas first or last."""
    countries = ("France", "Spain", "Germany")
    clearance = ("confidential", "secret", "top_secret")
    rows = []
    for i in range(n):
        first = "Douglas" if i % 29 == 5 else f"Élan{i % 13}"
        last = "Douglas" if i % 31 in (0, 4) else f"Ibárra{i % 17}"
        rows.append(
            (first, last, f"0{i % 9} {i:08d}", f"p{i}@example.org", countries[i % 3], f"Région {i % 7}",
             f"EMP{i:08d}", clearance[i % 3 - 1])
        )
    return rows


@pytest.fixture(scope="session")
def people():
    return make_people()


@pytest.fixture(scope="session")
def people_vault(spark, people):
    lines = record_lines(spark.createDataFrame(people, PEOPLE.schema()), PEOPLE)
    vault = Vault(spark, scratch_path(spark, "people"), PEOPLE)
    report = vault.ingest_lines(lines, SECRETS)
    assert report.records == len(people)
    return vault
