"""Links that fit a task are connected in one round; more are rewired round by round. No other test covers several tasks."""

import numpy as np
import pytest

from phrasedex.llm import components as C


def _links(kind):
    rng = np.random.default_rng(7)
    if kind == "chain":
        order = rng.permutation(200)
        return [(int(a), int(b)) for a, b in zip(order[:-1], order[1:])]
    return [(int(a), int(b)) for a, b in rng.integers(-150, 150, (140, 2))]


def _want(links):
    up = {x: x for link in links for x in link}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return sorted((x, root(x)) for x in up if root(x) != x)


@pytest.mark.parametrize("kind", ["chain", "random"])
def test_one_round(spark, monkeypatch, kind):
    links, written = _links(kind), []
    monkeypatch.setattr(C, "shared_dir", lambda s, name, make=C.shared_dir: written.append(name) or make(s, name))
    got = C.components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == _want(links)
    # Before, every doubling of a chain's length took a round, each of several jobs, whose plans the driver kept.
    assert len(written) == 2


def test_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "LINKS_PER_TASK", 60)
    links = _links("chain")
    assert sorted(map(tuple, C.components(spark.createDataFrame(links, "a long, b long")).collect())) == _want(links)
