import pytest
from test_catalogue import SF, con, plain  # noqa: F401

import rule_cases

from offerloom.plans import rules


CASES = rule_cases.QUERIES | rules.QUERIES


@pytest.mark.parametrize("name", list(CASES))
def test_rule_equals_what_is_stated(spark, con, name):  # noqa: F811
    df = CASES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute((rule_cases.ORACLES | rules.ORACLES)[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=repr) == want
