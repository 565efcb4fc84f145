"""The registered rankers are trained at the operator's full strength."""

import pytest

from rankloom.operators import ltr
from rankloom.plans.registry import QUERIES


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["ltr_topk", "ltr_importance"])
def test_full_parameters(spark, monkeypatch, name):
    def train(rows, params=ltr.LtrParams()):
        raise Seen(params)

    monkeypatch.setattr(ltr, "train", train)
    with pytest.raises(Seen) as seen:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen.value.args == (ltr.LtrParams(),)
