"""Plan checks: the physical operators a query actually ran with.

Used by the tests to keep every registered query free of join strategies
that do not scale (cartesian products, nested-loop joins) and of Python
row/batch UDF nodes, and to confirm filters and column pruning reach the
parquet scans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def final_plan(df: DataFrame) -> str:
    """Formatted physical plan; after an action this is AQE's final plan.

    The initial plan's trees are left out, and so are the numbered details of
    nodes that stand in no remaining tree (those of the initial plan alone).
    """
    jvm = df.sparkSession.sparkContext._jvm
    text = jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    text = re.sub(r"\+- == Initial Plan ==.*?(?=\n\n)", "", text, flags=re.S)
    blocks = re.split(r"\n\n+", text)
    details = re.compile(r"\s*\((\d+)\) ")
    in_trees = {n for block in blocks if not details.match(block)
                for n in re.findall(r"\((\d+)\)\s*$", block, flags=re.M)}
    return "\n\n".join(b for b in blocks if not (m := details.match(b)) or m[1] in in_trees)


def forbidden_nodes(df: DataFrame) -> list[str]:
    plan = final_plan(df)
    return [name for name in FORBIDDEN if name in plan]


def scan_summaries(df: DataFrame) -> list[dict]:
    """Per parquet scan: location, pushed filters and read schema."""
    plan = final_plan(df)
    out = []
    for block in re.findall(r"\(\d+\) Scan parquet[^\n]*\n(.*?)(?:\n\n|\Z)", plan, flags=re.S):
        info = {}
        for key in ("Location", "PushedFilters", "ReadSchema", "PartitionFilters"):
            m = re.search(rf"{key}: ([^\n]*)", block)
            if m:
                info[key] = m.group(1)
        if "Location" in info:
            out.append(info)
    return out


def broadcast_inputs(df: DataFrame) -> list[set[str]]:
    """For every BroadcastExchange in the final plan, the parquet files it reads."""
    jvm = df.sparkSession.sparkContext._jvm
    text = jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    text = text.split("+- == Initial Plan ==")[0]
    lines = text.splitlines()

    def col(line: str) -> int:
        m = re.search(r"[A-Za-z*]", line)
        return m.start() if m else -1

    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" not in line:
            continue
        depth = line.index("BroadcastExchange")
        files = set()
        for nxt in lines[i + 1:]:
            if col(nxt) <= depth:
                break
            files.update(re.findall(r"/([\w.-]+\.parquet)", nxt))
        out.append(files)
    return out
