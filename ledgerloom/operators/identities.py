"""Units of columns found by physical identities among them (problem 2).

Each column holds numbers in one of several candidate units, row by row. An
identity says that a product of powers of the true quantities is one: mass =
density x volume is {"mass": 1, "density": -1, "volume": -1}; an equality of two
columns is {"a": 1, "b": -1}. For each row every combination of units is tried,
its log residuals over the identities are added up, and the combination with the
least sum is taken. A column whose unit differs between combinations that come
equally close is not uniquely solved and flagged.

Defined results: an identity with a null, zero or negative column says nothing of
the row; a row without any identity left is solved only where a column has one
candidate. Identities met by no combination within `tolerance` leave all columns of
more than one candidate unsolved. Columns of the result that clash with those of the
input replace them. Repeated rows and further columns are kept.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Combinations of units that are tried for a row, at most.
COMBINATIONS = 4096
#: The largest sum of log residuals that counts as met, and how near another combination must come to count as equal.
TOLERANCE, TIE = 0.02, 1e-6


def best_units(values: np.ndarray, sizes: list[np.ndarray], powers: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chosen unit, solved) per row and column, and the residual per row.

    `values` (rows, columns) with NaN for null, `sizes` per column the candidate units in the common unit,
    `powers` (identities, columns).
    """
    combos = np.array(list(itertools.product(*(range(len(s)) for s in sizes))), np.int64)
    logs = np.stack([np.log(s)[combos[:, k]] for k, s in enumerate(sizes)], 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        known = np.where(values > 0, np.log(values), np.nan)
    usable = ~(np.isnan(known)[:, None, :] & (powers != 0)[None]).any(2)
    base = np.nan_to_num(known) @ powers.T
    moved = logs @ powers.T
    total = (np.abs(base[:, None, :] + moved[None]) * usable[:, None, :]).sum(2)
    best = total.argmin(1)
    least = total[np.arange(len(values)), best]
    near = total <= least[:, None] + TIE
    chosen = combos[best]
    same = np.stack([~(near & (combos[None, :, k] != chosen[:, k : k + 1])).any(1) for k in range(len(sizes))], 1)
    met = least <= tolerance
    single = np.array([len(s) == 1 for s in sizes])
    solved = same & (met[:, None] | single) & ~np.isnan(values)
    return chosen, solved, least


def solve_units(frame: DataFrame, candidates: dict[str, dict[str, float]], identities: list[dict[str, int]], tolerance: float = TOLERANCE) -> DataFrame:
    """`frame` with `<column>_common` (in the unit of size 1), `<column>_unit`, `<column>_solved` per column, and `residual`.

    `candidates` maps each column to its units with their sizes in the common unit.
    """
    names = list(candidates)
    count = int(np.prod([len(c) for c in candidates.values()]))
    if count > COMBINATIONS:
        raise ValueError(f"{count} combinations of units; at most {COMBINATIONS} are tried")
    units = [list(c) for c in candidates.values()]
    sizes = [np.array(list(c.values()), float) for c in candidates.values()]
    powers = np.array([[identity.get(n, 0) for n in names] for identity in identities] or np.zeros((0, len(names))), float).reshape(-1, len(names))
    made = [f"{n}_{part}" for n in names for part in ("common", "unit", "solved")] + ["residual"]
    kept = [c for c in frame.columns if c not in made]
    types = {"common": T.DoubleType(), "unit": T.StringType(), "solved": T.BooleanType()}
    schema = T.StructType([*[frame.schema[c] for c in kept], *[T.StructField(m, types[m.rsplit("_", 1)[1]]) for m in made[:-1]], T.StructField("residual", T.DoubleType())])
    position = [kept.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([np.array([np.nan if v is None else float(v) for v in batch.column(k).to_pylist()], float) for k in position], 1).reshape(-1, len(names))
            out: list[pa.Array] = [batch.column(k) for k in range(len(kept))]
            # Rows are taken in parts so that rows times combinations stay small.
            parts = [best_units(values[k : k + 1024], sizes, powers, tolerance) for k in range(0, len(values), 1024)]
            chosen = np.concatenate([p[0] for p in parts] or [np.zeros((0, len(names)), np.int64)])
            solved = np.concatenate([p[1] for p in parts] or [np.zeros((0, len(names)), bool)])
            for k in range(len(names)):
                good = solved[:, k]
                common = values[:, k] * sizes[k][chosen[:, k]]
                out += [pa.array(common, pa.float64(), mask=~good), pa.array([units[k][u] if g else None for u, g in zip(chosen[:, k], good, strict=True)], pa.string()), pa.array(good, pa.bool_())]
            out.append(pa.array(np.concatenate([p[2] for p in parts] or [np.zeros(0)]), pa.float64()))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return frame.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
