"""Top-k that keeps memory tiers in balance. Swaps depend on those before, so a run's rows meet in one pandas task; what cannot be
chosen is cut off before, by windows: of each tier and cluster only the best ``limit`` rows go on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECT, CROSS, TOGETHER = "project_rule", "cross_project_principle", "collaboration_preference"
#: Most rows that are no project rules.
MOST_OTHER = 7


def choose(rows: list[tuple[int, float, str, str]], limit: int) -> list[int]:
    """Indices of (seq, confidence, cluster, tier) rows: one of each cluster first, then the best; then tiers are brought in."""
    if not rows or limit <= 0:
        return []
    conf, tier = [r[1] for r in rows], [r[3] for r in rows]
    best_first = sorted(range(len(rows)), key=lambda i: (-conf[i], rows[i][0]))
    if len(rows) <= limit:
        chosen = list(best_first)
    else:
        heads: dict[str, int] = {}
        for i in best_first:
            heads.setdefault(rows[i][2], i)
        chosen = [heads[c] for c in sorted(heads)][:limit]
        chosen += [i for i in best_first if i not in set(chosen)][: limit - len(chosen)]
        chosen.sort(key=lambda i: (-conf[i], rows[i][0]))

    def best(wanted) -> int | None:
        """The best row outside; of equal ones the last."""
        free = [i for i in range(len(rows)) if wanted(tier[i]) and i not in chosen]
        return max(free, key=lambda i: (conf[i], i)) if free else None

    def weakest(wanted) -> int | None:
        places = [p for p, i in enumerate(chosen) if wanted(tier[i])]
        return min(places, key=lambda p: (conf[chosen[p]], p)) if places else None

    def swap(new, old) -> bool:
        i, p = best(new), weakest(old)
        if i is None or p is None:
            return False
        chosen[p] = i
        return True

    project, other = (lambda t: t == PROJECT), (lambda t: t != PROJECT)
    for name in (TOGETHER, CROSS):
        if name in tier and not any(tier[i] == name for i in chosen):
            swap(lambda t, name=name: t == name, project)
    goal = min(sum(map(other, tier)), MOST_OTHER, limit - 1)
    count = lambda: sum(other(tier[i]) for i in chosen)
    while count() < goal and swap(other, project):
        pass
    while count() > goal and swap(project, other):
        pass
    return sorted(chosen, key=lambda i: (-conf[i], rows[i][0]))


def balanced_topk(df: DataFrame, limit: int = 10, group: str = "run") -> DataFrame:
    """The chosen rows of each group with their place. Columns: group, seq, confidence, cluster, tier."""
    w = Window.partitionBy(group, "tier", "cluster").orderBy(F.col("confidence").desc(), "seq")
    rows = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable").reset_index(drop=True)
        at = choose(list(zip(pdf["seq"], pdf["confidence"], pdf["cluster"], pdf["tier"])), limit)
        return pdf.iloc[at].assign(place=range(1, len(at) + 1))

    return rows.groupBy(group).applyInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", place int")
