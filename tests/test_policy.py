import random
from enum import Enum

import pytest
from pyspark.sql import functions as F

from sealdex.functions.policy import And, Attr, Axis, Or, Policy, rule_from_dict
from sealdex.operators.keyring import issue_user_keys, keyring_for, seal_headers
from sealdex.plans.people import COUNTRY, DEPARTMENT, PEOPLE, PEOPLE_POLICY, people_rules


def _holds(rule, cell):
    if isinstance(rule, Attr):
        return cell[rule.axis] == rule.value
    parts = [_holds(rule.left, cell), _holds(rule.right, cell)]
    return all(parts) if isinstance(rule, And) else any(parts)


def _random_rule(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        axis = rng.choice([COUNTRY, DEPARTMENT])
        return axis.attribute(rng.choice(axis.values))
    kind = rng.choice([And, Or])
    return kind(_random_rule(rng, depth - 1), _random_rule(rng, depth - 1))


def test_random_rules_allow_the_cells_they_hold_for(spark):
    rng = random.Random(5)
    rules = {f"u{i}": _random_rule(rng, 4) for i in range(12)}
    issued = issue_user_keys(spark, PEOPLE_POLICY, b"m", rules)
    got = {(r.user, r.Country, r.Department) for r in issued.collect()}
    cells = [{"Country": c, "Department": d} for c in COUNTRY.values for d in DEPARTMENT.values]
    want = {(u, c["Country"], c["Department"]) for u, rule in rules.items() for c in cells if _holds(rule, c)}
    assert got == want


def test_keyring_opens_exactly_the_parts_of_allowed_cells(spark):
    headers = seal_headers(spark, PEOPLE, b"m", "1")
    rng = random.Random(9)
    rules = [*people_rules().values(), *(_random_rule(rng, 3) for _ in range(4))]
    for rule in rules:
        ring = keyring_for(issue_user_keys(spark, PEOPLE_POLICY, b"m", {"u": rule}), headers, PEOPLE)
        got = ring.frame.select(
            *[F.col(f"key_{p}").isNotNull().alias(p) for p in PEOPLE.part_names()]
        ).collect()
        want = []
        for country in COUNTRY.values:
            opened = [
                any(_holds(rule, {"Country": country, "Department": d}) for d in part.audience)
                for part in PEOPLE.parts
            ]
            if opened[0]:
                want.append(tuple(opened))
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_wrong_master_key_opens_nothing(spark):
    headers = seal_headers(spark, PEOPLE, b"m", "1")
    keys = issue_user_keys(spark, PEOPLE_POLICY, b"other", {"u": people_rules()["SuperAdmin"]})
    assert keyring_for(keys, headers, PEOPLE).tokens == []


def test_serialised_rule():
    tree = {"And": [{"Attr": "Department::Marketing"}, {"Or": [{"Attr": "Country::Spain"}, {"Attr": "Country::France"}]}]}
    rule = rule_from_dict(tree)
    assert rule == DEPARTMENT.attribute("Marketing") & (COUNTRY.attribute("Spain") | COUNTRY.attribute("France"))
    with pytest.raises(ValueError):
        rule_from_dict({"Not": {"Attr": "Country::Spain"}})


def test_unknown_values_are_errors(spark):
    with pytest.raises(ValueError):
        COUNTRY.attribute("Atlantis")
    with pytest.raises(ValueError):
        PEOPLE_POLICY.check(Attr("Country", "Atlantis"))
    with pytest.raises(ValueError):
        PEOPLE_POLICY.check(Attr("Planet", "Mars"))
    with pytest.raises(ValueError):
        PEOPLE_POLICY.allow([], ["France"])
    with pytest.raises(ValueError):
        PEOPLE_POLICY.allow(["HR"], [])
    wide = Axis("A", tuple(str(i) for i in range(1000)))
    with pytest.raises(ValueError):
        Policy(wide, Axis("B", wide.values))


def test_axis_of_an_enum():
    levels = Enum("Level", ["Public", "Top_Secret"])
    assert Axis.of_enum("Level", levels) == Axis("Level", ("Public", "TopSecret"))


def test_axes_table(spark):
    got = {(r.axis, r.value) for r in PEOPLE_POLICY.axes(spark).collect()}
    assert got == {("Country", v) for v in COUNTRY.values} | {("Department", v) for v in DEPARTMENT.values}
