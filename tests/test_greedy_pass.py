"""The pass over one block against a plain loop, and the comparisons that it makes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from rankforge.plans.greedy import _pass

RADIUS = 0.03
ROT = [f"r{i}" for i in range(9)]


def block(n, size, odd=False):
    rng = np.random.default_rng(n)
    f = pd.DataFrame(rng.uniform(-size, size, (n, 3)), columns=list("xyz"))
    f["_own"] = f["x"] < size * 0.6
    if odd:
        f.loc[::20, "x"], f.loc[::30, "y"], f.loc[5, "z"] = np.nan, np.inf, 1e300
    f["p"] = rng.permutation(n)
    return f.assign(**{r: rng.uniform(-1, 1, n) for r in ROT})


def plain(f, turned):
    f = f.sort_values("p", ignore_index=True)
    state = ["free"] * len(f)
    for a in range(len(f)):
        if state[a] in ("out", "beaten"):
            continue
        sure = f["_own"][a] and state[a] == "free"
        state[a] = "in" if sure else "open"
        for b in range(a + 1, len(f)):
            d = f.loc[b, ["x", "y", "z"]].to_numpy(float) - f.loc[a, ["x", "y", "z"]].to_numpy(float)
            near = d @ d < RADIUS**2
            if near and turned:
                near = (f.loc[a, ROT].to_numpy(float) @ f.loc[b, ROT].to_numpy(float) - 1) / 2 > turned[1]
            if near and state[b] != "out":
                state[b] = "out" if sure else "open"
    return {int(p): s == "in" for p, s, own in zip(f["p"], state, f["_own"]) if own and s in ("in", "out")}


@pytest.mark.parametrize("turned", [None, (ROT, 0.1)])
@pytest.mark.parametrize("size,odd", [(0.08, False), (0.005, False), (0.08, True)])
def test_pass_equals_a_loop(size, odd, turned):
    f = block(90, size, odd)
    with np.errstate(invalid="ignore", over="ignore"):
        out = _pass(["p"], "p", list("xyz"), RADIUS, turned)(f)
        assert dict(zip(out["p"].tolist(), out["_in"].tolist())) == plain(f, turned)


def test_only_elements_of_cells_around_are_compared(monkeypatch):
    """Every element was compared with all later ones of its block."""
    compared, einsum = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: compared.append(len(a)) or einsum(how, a, b))
    _pass(["p"], "p", list("xyz"), RADIUS, None)(block(4000, 0.6))
    assert sum(compared) < 4000 * 40
