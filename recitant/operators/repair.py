"""Matching of stray files with the places where they belong."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quarantine_name, repair_title


def assigned(roots: DataFrame, targets: DataFrame, scope: str) -> DataFrame:
    """(scope, root, target): each stray file in order takes the first free target with the same plain title,
    else the first free one whose plain title holds its own; a file without plain title takes none.

    Both frames have ``scope`` (one book), ``name``, ``title`` and ``place``. One group holds the files of one book."""
    plain = lambda df, side: df.select(F.col(scope).alias("scope"), F.lit(side).alias("side"), "name", "place", repair_title(F.col("title")).alias("plain"))
    both = plain(roots, 0).unionByName(plain(targets, 1))

    def match(files: pd.DataFrame) -> pd.DataFrame:
        files = files.sort_values(["place", "name"])
        free = [(r.name_, r.plain or "") for r in files[files.side == 1].rename(columns={"name": "name_"}).itertuples()]
        rows = []
        for r in files[files.side == 0].rename(columns={"name": "name_"}).itertuples():
            if not r.plain:
                continue
            found = next((x for x in free if x[1] == r.plain), None) or next((x for x in free if r.plain in x[1]), None)
            if found:
                free.remove(found)
                rows.append((r.scope, r.name_, found[0]))
        return pd.DataFrame(rows, columns=["scope", "root", "target"])

    kind = dict(roots.dtypes)[scope]
    return both.groupBy("scope").applyInPandas(match, f"scope {kind}, root string, target string").withColumnRenamed("scope", scope)


def move_plan(assigned_: DataFrame, existing: DataFrame, quarantine: str) -> DataFrame:
    """(root, target, quarantined): each stray file's move, and where a file that lies in its place goes first (null where
    none does). ``assigned_`` has root and target, ``existing`` path."""
    there = existing.select(F.col("path").alias("target"), F.lit(True).alias("_there")).distinct()
    away = F.when(F.col("_there"), F.concat(F.lit(quarantine.rstrip("/") + "/"), quarantine_name(F.col("target"))))
    return assigned_.join(there, "target", "left").select("root", "target", away.alias("quarantined"))
