import numpy as np
import pytest
from rows import rows

from tallyloom.llm import topn as T

ROWS = "source_id bigint, node_id bigint, pr double, rank int, g string"


def brute(data, n):
    groups = {}
    for g, i, s, *_ in data:
        if g is not None and i is not None and s is not None and s == s:
            groups.setdefault(g, []).append((-s, i))
    return sorted((g, k + 1, i, -s + 0.0) for g, found in groups.items() for k, (s, i) in enumerate(sorted(found)[:n]))


def test_codes_keep_the_order():
    scores = np.array([-np.inf, -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, np.inf])
    assert (np.diff(T.score_code(scores).astype(object)) > 0).all()
    assert T.score_code(np.array([-0.0]))[0] == T.score_code(np.array([0.0]))[0]
    ids = np.array([-(2**63), -1, 0, 1, 2**63 - 1])
    assert (np.diff(T.identifier_code(ids).astype(object)) < 0).all()


@pytest.mark.parametrize("seed", range(6))
def test_selection_against_sorting(seed):
    draw = np.random.default_rng(seed)
    size = int(draw.integers(1, 3000))
    group = draw.integers(0, draw.integers(1, 60), size)
    score = draw.choice([0.0, -0.0, 1e-9, 0.25, 0.5, np.inf, -3.0], size) if seed % 2 else draw.normal(size=size)
    ids = draw.integers(-50, 50, size)
    mask = T.select_top(group, score, ids, 5)
    for g in np.unique(group):
        mine = group == g
        order = sorted(zip(-score[mine] + 0.0, ids[mine]))[:5]
        assert sorted(zip(-score[mine & mask] + 0.0, ids[mine & mask])) == order


@pytest.mark.parametrize("buffer", [1 << 18, 50])
def test_groups_against_brute_force(spark, buffer, monkeypatch):
    monkeypatch.setattr(T, "BUFFER", buffer)
    draw = np.random.default_rng(11)
    data = [(1, int(i), float(draw.choice([0.1, 0.2, 0.3])), 0, "x") for i in range(3000)]
    data += [(int(draw.integers(2, 400)), int(draw.integers(-1000, 1000)), float(draw.normal()), 0, "x") for _ in range(3000)]
    data += [(2, 5, float("nan"), 0, "x"), (2, None, 9.0, 0, "x"), (None, 5, 9.0, 0, "x"), (2, 5, None, 0, "x"), (500, 1, -0.0, 0, "x"), (500, 0, 0.0, 0, "x"), (501, 7, 1.0, 0, "x"), (501, 7, 1.0, 0, "x")]
    df = spark.createDataFrame(data, ROWS).repartition(6)
    for n in (1, 5):
        assert rows(T.top_n(df, "source_id", "node_id", "pr", n)) == brute(data, n)


def test_empty_and_wrong(spark):
    df = spark.createDataFrame([], ROWS)
    assert rows(T.top_n(df, "source_id", "node_id", "pr", 5)) == []
    with pytest.raises(ValueError):
        T.top_n(df, "source_id", "node_id", "pr", 0)
