"""Canonical forms of long rules: equal to the least form over all orders, and quick on symmetric ones."""

import itertools
import random
import time

import pytest
from factweave.functions import literals as L


def lit(pred, *args, positive=True):
    return {"pred": pred, "positive": positive, "args": [{"kind": "const" if a[0].isupper() else "var", "name": a} for a in args]}


def written(lits, pred=None):
    names, preds, out = {}, {}, []
    for l in lits:
        head = l["pred"] if pred is None else f"{pred}{preds.setdefault(l['pred'], len(preds) + 1)}"
        args = [a["name"] if a["kind"] == "const" else f"x{names.setdefault(a['name'], len(names) + 1)}" for a in l["args"]]
        out.append(f"{'' if l['positive'] else '!'}{head}({','.join(args)})")
    return out


@pytest.mark.parametrize("pred", [None, "R"])
def test_least_order_is_the_least_of_all_orders(pred):
    rng = random.Random(12)
    for _ in range(250):
        variables = [f"v{i}" for i in range(rng.choice([2, 4, 7]))] + ["K"]
        lits = [
            lit(rng.choice("AB"), *rng.choices(variables, k=rng.choice([1, 2, 2])), positive=rng.random() < 0.6) for _ in range(rng.choice([4, 5, 6]))
        ]
        order = L._least_order(lits, "x", pred)
        assert sorted(order) == list(range(1, len(lits) + 1))
        assert written([lits[i - 1] for i in order], pred) == min(written(p, pred) for p in itertools.permutations(lits))


def test_symmetric_rules_are_quick():
    star = [lit("R", "c", f"r{i}") for i in range(12)]
    chain = [lit("R", f"v{i}", f"v{i + 1}") for i in range(12)]
    rays = [l for i in range(6) for l in (lit("R", "c", f"r{i}"), lit("S", f"r{i}", f"s{i}"))]
    for rule in (star, chain, rays):
        start = time.time()
        first = written([rule[i - 1] for i in L._least_order(rule, "x", None)])
        assert time.time() - start < 0.5
        mixed = rule.copy()
        random.Random(1).shuffle(mixed)
        assert written([mixed[i - 1] for i in L._least_order(mixed, "x", None)]) == first
