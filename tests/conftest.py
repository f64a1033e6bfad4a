import os
import sys
from collections import deque
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pathloom.session import build_session

    s = build_session("tests", cores=4, shuffle_partitions=4, **{"spark.driver.memory": "3g", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


#: A ring with a chord, a star and a 3 x 3 grid, joined by two bridges.
RING = [(f"K{i}", f"K{(i + 1) % 7}") for i in range(7)] + [("K0", "K3")]
STAR = [("HUB", f"L{i}") for i in range(1, 6)]
GRID = [(f"G{r}{c}", f"G{r}{c + 1}") for r in range(3) for c in range(2)] + [(f"G{r}{c}", f"G{r + 1}{c}") for r in range(2) for c in range(3)]
PARK = sorted((min(p), max(p)) for p in [*RING, *STAR, *GRID, ("K3", "HUB"), ("L5", "G00")])

DRUGS = [("amber", "G00", "up"), ("amber", "G01", "up"), ("amber", "G22", "down"), ("birch", "L1", "up"), ("birch", "L2", "down")]
DRUGS += [("cedar", "K0", "up"), ("cedar", "K1", "up"), ("cedar", "K5", "down"), ("dune", "G00", "up"), ("dune", "L5", "down")]
ILL = [("mist", g) for g in ("K2", "K4", "HUB", "L3")]
CHANGES = [("mist", g, round(((7 * i) % 11 - 5) * 0.3 + 0.1, 2)) for i, g in enumerate(sorted({g for p in PARK for g in p}))]


def hops(pairs):
    """(a, b) -> edges on the shortest way, for all nodes that have one."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        seen, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for y in near[x] - seen.keys():
                seen[y] = seen[x] + 1
                queue.append(y)
        out |= {(s, t): d for t, d in seen.items()}
    return out


def to_nearest(hop, sources, targets, itself=True):
    """Mean over the sources of the hops to the nearest target; 1000 where there is no way."""
    best = [min([hop[s, t] for t in targets if (s, t) in hop and (itself or s != t)], default=1000.0) for s in sources]
    return sum(best) / len(best)


@pytest.fixture(scope="session")
def park(spark):
    return spark.createDataFrame(PARK, "gene_a string, gene_b string").cache()


@pytest.fixture(scope="session")
def drugs(spark):
    return spark.createDataFrame(DRUGS, "drug string, gene string, direction string")


@pytest.fixture(scope="session")
def ill(spark):
    return spark.createDataFrame(ILL, "disease string, gene string")


@pytest.fixture(scope="session")
def changes(spark):
    return spark.createDataFrame(CHANGES, "disease string, gene string, fold_change double")
