"""What every executed plan did, also the plans of writes, counts and micro-batches: read from Spark's own SQL status store."""

from __future__ import annotations

import re


class Guard:
    """Collects the executions of a session after it was made."""

    def __init__(self, spark):
        self.store = spark._jsparkSession.sharedState().statusStore()
        self.jvm = spark._jvm
        self.seen = {e.executionId() for e in self._all()}

    def _all(self):
        listed = self.store.executionsList()
        return [listed.apply(i) for i in range(listed.size())]

    def fresh(self):
        new = [e for e in self._all() if e.executionId() not in self.seen]
        self.seen |= {e.executionId() for e in new}
        return new

    def single_partition_rows(self, execution) -> list[tuple[str, int]]:
        """(description, rows) of every exchange into one partition that an execution ran."""
        number = execution.executionId()
        metrics, found = self.store.executionMetrics(number), []
        nodes = self.store.planGraph(number).allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            if "Exchange" in node.name() and "SinglePartition" in node.desc():
                own = node.metrics()
                for j in range(own.size()):
                    metric = own.apply(j)
                    if metric.name() == "shuffle records written" and metrics.contains(metric.accumulatorId()):
                        found.append((node.desc()[:120], int(re.sub(r"\D", "", str(metrics.apply(metric.accumulatorId()))) or 0)))
        return found

    def windows_over_joins(self, execution) -> list[str]:
        """Windows that take the rows of a join on its own key, without an exchange between: a hot key would stay whole."""
        lines = execution.physicalPlanDescription().split("\n\n(1)")[0].split("\n")
        if any("== Initial Plan ==" in x for x in lines):
            lines = lines[:next(i for i, x in enumerate(lines) if "== Initial Plan ==" in x)]
        found = []
        for i, line in enumerate(lines):
            if not re.search(r"[-:] (\* )?Window ", line):
                continue
            depth = len(line) - len(line.lstrip(" :+-*"))
            for below in lines[i + 1:]:
                inner = len(below) - len(below.lstrip(" :+-*"))
                if inner <= depth or re.search(r"Exchange|Scan|Aggregate|QueryStage|Generate", below):
                    break
                if re.search(r"SortMergeJoin|ShuffledHashJoin", below):
                    found.append(line.strip())
                    break
        return found
