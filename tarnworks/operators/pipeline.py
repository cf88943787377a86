"""Record pipelines: stages from DataFrame to DataFrame over records (key, value)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

#: Not a letter, digit or underscore, in Unicode's sense.
EDGE = r"[^\p{L}\p{N}_]+"


def tokenize(df: DataFrame, text: str = "text", lowercase: bool = True, strip_punctuation: bool = True, min_length: int = 1, delimiter: str | None = None) -> DataFrame:
    """(key, value 1) of each word: split at white space or a literal delimiter, stripped of leading and trailing non-word characters."""
    cut = F.split(F.col(text), r"\s+" if delimiter is None else "\\Q" + delimiter + "\\E")
    word = F.explode(cut).alias("key")
    out = df.select(word)
    if strip_punctuation:
        out = out.select(F.regexp_replace("key", f"^{EDGE}|{EDGE}$", "").alias("key"))
    if lowercase:
        out = out.select(F.lower("key").alias("key"))
    return out.where(F.length("key") >= max(1, min_length)).select("key", F.lit(1).cast("long").alias("value"))


def flat_map(items: Column) -> Callable[[DataFrame], DataFrame]:
    """A stage that makes records of the structs (key, value) of an array; none of a null or empty one."""
    return lambda df: df.select(F.explode(items).alias("x")).select("x.key", "x.value")


def keep(condition: Column) -> Callable[[DataFrame], DataFrame]:
    """A stage that keeps the records for which the condition holds."""
    return lambda df: df.where(condition)


def count(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.sum(value).alias("value"))


def sort(df: DataFrame, by: str = "key", descending: bool = False, tie: str | None = None) -> DataFrame:
    """Ties are ordered by the other column, so that runs agree."""
    tie = tie or ("value" if by == "key" else "key")
    return df.orderBy(F.desc(by) if descending else F.asc(by), F.asc(tie))


def top_n(df: DataFrame, n: int, by: str = "value", tie: str = "key") -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(tie)).limit(n)


def partition_to(df: DataFrame, by: Column, path: str, name: str = "part") -> DataFrame:
    """Writes JSON lines to a folder for each value of `by`; the records pass on."""
    df.withColumn(name, by).write.mode("append").partitionBy(name).json(path)
    return df


class Pipeline:
    """An ordered list of named stages. Counters of all stages come with the run's own pass over the data."""

    def __init__(self) -> None:
        self.stages: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []
        self._sorts: set[int] = set()
        self._seen: list[tuple[str, Observation | None]] = []

    def add_stage(self, name: str, stage: Callable[[DataFrame], DataFrame], sorts: bool = False) -> Pipeline:
        """sorts: the stage puts all its rows in order, for which it reads them twice; they are counted behind it only."""
        if sorts:
            self._sorts.add(len(self.stages))
        self.stages.append((name, stage))
        return self

    def build(self, df: DataFrame) -> DataFrame:
        self._seen = []
        for i, (name, stage) in enumerate([("input", lambda d: d), *self.stages]):
            df, seen = stage(df), None
            if i not in self._sorts:
                seen = Observation(f"stage {i} {name}")
                df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            self._seen.append((name, seen))
        return df

    def run(self, df: DataFrame) -> list[Row]:
        return self.build(df).collect()

    def run_to_file(self, df: DataFrame, path: str) -> None:
        self.build(df).write.json(path)

    def run_lazy(self, df: DataFrame) -> Iterator[Row]:
        return self.build(df).toLocalIterator()

    def stats(self) -> list[dict]:
        """Rows in and out of each stage of the last run."""
        rows: list[tuple[str, int]] = []
        for name, seen in reversed(self._seen):
            rows.insert(0, (name, seen.get["rows"] if seen else rows[0][1]))
        return [{"stage": name, "records_in": a, "records_out": n} for (name, n), (_, a) in zip(rows[1:], rows, strict=False)]
