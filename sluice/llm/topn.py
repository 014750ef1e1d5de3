"""The N best items of every group, by mergeable bounded heaps.

Each task keeps, for every group it meets, at most N (score, id) entries. New rows
are gathered in a buffer of HELD_ROWS and sorted into the heaps all at once, in
Arrow, which costs less a row than pushing each into a heap of its own. So the shuffle carries at most N rows per group and task: a group with
a third of all rows costs no more than any other. The shuffle buckets by group
and sorts by it, and the same heap merges the partial heaps of one group at a
time. Higher score wins; equal scores rank by smaller id, so results never
depend on how the rows were spread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD_ROWS = 400_000  # heap entries a task holds before handing them on


def _bounded(table: pa.Table, n: int) -> pa.Table:
    """The heaps of all groups in ``table``: at most n entries each, best first."""
    table = table.sort_by([("grp", "ascending"), ("score", "descending"), ("id", "ascending")])
    if table.num_rows == 0:
        return table
    names = table["grp"].combine_chunks()
    new = pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.flatnonzero(new) + 1])
    sizes = np.diff(np.concatenate([starts, [table.num_rows]]))
    place = np.arange(table.num_rows) - np.repeat(starts, sizes)
    return table.filter(pa.array(place < n))


def _heaps(n: int, ordered: bool):
    """``ordered``: input comes sorted by group, so all groups but the last seen
    are complete and leave at once. Otherwise heaps leave when they outgrow
    HELD_ROWS, to be merged later."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= HELD_ROWS:
                table = _bounded(pa.concat_tables(held), n)
                if ordered:
                    last = pc.equal(table["grp"], table["grp"][-1])
                    yield from table.filter(pc.invert(last)).to_batches()
                    table = table.filter(last)
                elif table.num_rows > HELD_ROWS // 2:
                    yield from table.to_batches()
                    table = table.slice(0, 0)
                held, rows = [table], table.num_rows
        if held:
            yield from _bounded(pa.concat_tables(held), n).to_batches()

    return run


def top_n(df: DataFrame, group: str, score: str, id: str, n: int = 5) -> DataFrame:
    """``grp, score, id``: of each group the n rows of highest score, all if it
    has fewer. Rows without group or score are left out; a null id ranks after
    all others; repeated rows count each; groups are compared as written, the
    empty string is a group. NaN scores count as absent. Empty input: no rows.
    """
    kind = dict(df.dtypes)[score]
    rows = df.select(
        F.col(group).cast("string").alias("grp"), F.col(score).alias("score"), F.col(id).cast("bigint").alias("id")
    ).filter("grp is not null and score is not null")
    if kind in ("double", "float"):
        rows = rows.filter(~F.isnan("score"))
    schema = f"grp string, score {kind}, id bigint"
    partial = rows.mapInArrow(_heaps(n, ordered=False), schema)
    laid = partial.repartition("grp").sortWithinPartitions("grp")
    return laid.mapInArrow(_heaps(n, ordered=True), schema)
