"""Audit metrics as rows of one long table."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

REPORT = "section string, ord int, status string, label string, count_num double, count_text string, total long, examples array<string>, note string"


class Section:
    """Metrics in the order in which they are added; their counts are known."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.rows: list[tuple] = []

    def add(self, label: str, count: float | None, total: int | None = None, status: str | None = None, critical: bool = False, examples: list[str] | None = None, note: str | None = None, text: str | None = None) -> Section:
        status = status or (("CRITICAL" if critical else "WARNING") if (count or 0) > 0 else "OK")
        self.rows.append((self.name, len(self.rows), status, label, None if count is None else float(count), text, total, examples, note))
        return self

    def again(self, label: str, other: Section) -> Section:
        """A metric of another section once more."""
        row = next(r for r in other.rows if r[3] == label)
        self.rows.append((self.name, len(self.rows), *row[2:]))
        return self


def report_of(spark: SparkSession, *sections: Section) -> DataFrame:
    return spark.createDataFrame([r for s in sections for r in s.rows], REPORT)


class Pass:
    """Tables of one report, written below a folder of their own, each with what was counted while it was written."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.path = spark, f"{folder.rstrip('/')}/report-{uuid.uuid4().hex}"
        self.seen: dict[str, int] = {}
        self.samples: list[DataFrame] = []
        self.watches: list[Observation] = []

    def watch(self, rows: DataFrame, /, **metrics: Column) -> DataFrame:
        """Rows as they are; the aggregates are taken on their way and known once a table of them is written."""
        self.watches.append(Observation())
        return rows.observe(self.watches[-1], *[m.alias(n) for n, m in metrics.items()])

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{self.path}/{name}")
        for w in self.watches:
            self.seen |= {k: v for k, v in w.get.items()}
        self.watches.clear()
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def sample(self, kind: str, rows: DataFrame, label: Column) -> None:
        self.samples.append(rows.select(F.lit(kind).alias("kind"), label.alias("label")))

    def examples(self, limit: int) -> dict[str, list[str]]:
        """Of each kind the first distinct labels, all in one job; the limit holds before the shuffle too."""
        if not self.samples or not limit:
            return {}
        rows = reduce(DataFrame.union, self.samples).where("label <> ''").distinct()
        top = rows.withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy("label"))).where(F.col("rn") <= limit)
        return {r.kind: sorted(r.labels) for r in top.groupBy("kind").agg(F.collect_list("label").alias("labels")).collect()}

    def __enter__(self) -> Pass:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def when_(condition: Column) -> Column:
    """How many rows fulfil a condition, as an aggregate."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def samples(label: Column, when: Column, limit: int) -> Column:
    """An aggregate: the first distinct labels in order of the text; for few rows, as it gathers all of them."""
    return F.slice(F.array_sort(F.collect_set(F.when(when & (label != ""), label))), 1, limit)


def counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row of conditional counts over one scan."""
    return rows.agg(*[when_(c).alias(n) for n, c in conditions.items()])


def top_risks(report: DataFrame, limit: int = 8) -> DataFrame:
    """What isn't OK: critical first, then by count."""
    bad = report.where("status <> 'OK'")
    return bad.orderBy(F.when(F.col("status") == "CRITICAL", 0).otherwise(1), F.desc(F.coalesce("count_num", F.lit(0.0))), "section", "ord").limit(limit)


def json_report(report: DataFrame) -> str:
    """The report as one JSON object: a list of metrics for each section, in order."""
    sections: dict[str, list[dict]] = {}
    for r in report.orderBy("section", "ord").collect():
        row = r.asDict(recursive=True)
        sections.setdefault(row.pop("section"), []).append(row)
    return json.dumps({"sections": sections}, ensure_ascii=False, indent=2, default=str)


def text_report(report: DataFrame) -> str:
    """The report as lines of text."""
    out, section = [], None
    for r in report.orderBy("section", "ord").collect():
        if r.section != section:
            section = r.section
            out += ["", section.upper()]
        value = r.count_text if r.count_text is not None else f"{r.count_num:g}"
        out.append(f"  [{r.status}] {r.label}: {value}" + (f" of {r.total}" if r.total is not None else ""))
        out += [f"      - {x}" for x in r.examples or []]
        if r.note:
            out.append(f"      {r.note}")
    return "\n".join(out).strip()
