"""The people directory: a ready-made record kind with its policy and users."""

from __future__ import annotations

from sealdex.functions.policy import Axis, Policy, Rule
from sealdex.functions.terms import IndexSpec, Term
from sealdex.operators.specs import PartSpec, RecordSpec

# Axis names and values, field names, who may open which fields,
# and the patterns words are indexed under.
COUNTRY = Axis("Country", ("France", "Spain", "Germany", "Italy", "Other"))
DEPARTMENT = Axis("Department", ("Marketing", "HR", "Security", "Other"))

FIELDS = (
    "firstName", "lastName", "phone", "email", "country", "region", "employeeNumber", "security",
)

PARTS = (
    PartSpec("common", ("firstName", "lastName", "country"), ("Marketing", "HR")),
    PartSpec("marketing", ("region",), ("Marketing",)),
    PartSpec("hr", ("phone", "email", "employeeNumber"), ("HR",)),
    PartSpec("security", ("security",), ("Security",)),
)

WORDS = IndexSpec(
    (
        Term("firstName"),
        Term("lastName"),
        Term("firstName", "first"),
        Term("lastName", "last"),
        Term("country", "country"),
    )
)

PEOPLE_POLICY = Policy(rows=COUNTRY, columns=DEPARTMENT)
PEOPLE = RecordSpec(FIELDS, "country", PEOPLE_POLICY, PARTS, WORDS)


def people_rules() -> dict[str, Rule]:
    """Access rules of the example users."""
    allow = PEOPLE_POLICY.allow
    return {
        "Alice": allow(["Marketing"], ["France"]),
        "Bob": allow(["HR"], ["Spain"]),
        "Charlie": allow(["HR"], ["France"]),
        "SuperAdmin": allow(DEPARTMENT.values, COUNTRY.values),
        "Mallory": allow(["Other"], ["Other"]),
    }
