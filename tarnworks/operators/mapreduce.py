"""MapReduce jobs with Python mappers, combiners and reducers over records (key, value).

Mappers run inside mapInArrow; a combiner reduces each batch's output before the shuffle. Reducers run inside mapInArrow over
partitions that are dealt and sorted by key, one key after another, so a key costs no frame or batch of its own. Functions get
Python values, None for nulls. A reducer gets all values of its key at once, so give a combiner where keys may be hot, or use a
built-in aggregate instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Pairs = Iterable[tuple]

#: Reduced records are put out in batches of about this many.
BATCH = 10_000


def _records(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(batch.column("key").to_pylist(), batch.column("value").to_pylist(), strict=True)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, its values) of records sorted by key; NaN equals NaN, as it does in Spark's sort."""
    held, values = None, []
    for batch in batches:
        for key, value in _records(batch):
            if values and not (key == held or key != key and held != held):
                yield held, values
                values = []
            held = key
            values.append(value)
    if values:
        yield held, values


def _batch(pairs: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    def column(at: int) -> pa.Array:
        values, kind = [p[at] for p in pairs], schema.field(at).type
        try:
            return pa.array(values, kind)
        except (pa.ArrowInvalid, pa.ArrowTypeError):  # values of another kind, such as numbers for a string
            return pa.array(values).cast(kind)

    return pa.RecordBatch.from_arrays([column(0), column(1)], schema=schema)


class MapReduceJob:
    def __init__(self, mapper: Callable[..., Pairs], reducer: Callable[..., Pairs], schema: str = "key string, value long", combiner: Callable[..., Pairs] | None = None, fault_tolerant: bool = False):
        self.mapper, self.reducer, self.combiner, self.schema, self.fault_tolerant = mapper, reducer, combiner, schema, fault_tolerant
        self._seen: dict[str, Observation] = {}

    def run(self, records: DataFrame, ordered: bool = True) -> DataFrame:
        """Reduced records, ordered by key if not told otherwise. With fault_tolerant, records or keys whose function raises are left out; combiners always raise."""
        mapper, reducer, combiner, tolerant = self.mapper, self.reducer, self.combiner, self.fault_tolerant
        schema = to_arrow_schema(T.StructType.fromDDL(self.schema))

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for key, value in _records(batch):
                    try:
                        out += list(mapper(key, value))
                    except Exception:
                        if not tolerant:
                            raise
                if combiner:
                    groups: dict = {}
                    for k, v in out:
                        groups.setdefault(k, []).append(v)
                    out = [pair for k, values in groups.items() for pair in combiner(k, values)]
                yield _batch(out, schema)

        def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for key, values in _groups(batches):
                try:
                    out += list(reducer(key, values))
                except Exception:
                    if not tolerant:
                        raise
                if len(out) >= BATCH:
                    yield _batch(out, schema)
                    out = []
            yield _batch(out, schema)

        def counted(df: DataFrame, name: str) -> DataFrame:
            seen = self._seen[name] = Observation(f"job {id(self)} {name}")
            return df.observe(seen, F.count(F.lit(1)).alias("rows"))

        self._seen = {}
        given = counted(records.select("key", "value"), "input_records")
        pairs = counted(given.mapInArrow(mapped, self.schema), "shuffled_records")
        out = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(reduced, self.schema)
        # counted behind the sort, which reads its input twice to find ranges
        return counted(out.orderBy("key") if ordered else out, "output_records")

    def stats(self) -> dict[str, int]:
        """Records read, shuffled (mapped and combined) and put out by the last run, known once its frame has been computed."""
        return {name: seen.get["rows"] for name, seen in self._seen.items()}


class MapReducePipeline:
    """Jobs one after another; the last one's records are ordered by key."""

    def __init__(self) -> None:
        self.jobs: list[MapReduceJob] = []

    def add_stage(self, job: MapReduceJob) -> MapReducePipeline:
        self.jobs.append(job)
        return self

    def run(self, records: DataFrame) -> DataFrame:
        for i, job in enumerate(self.jobs, 1):
            records = job.run(records, ordered=i == len(self.jobs))
        return records


def split_input(df: DataFrame, n: int, order: str) -> DataFrame:
    """df in n contiguous ranges of nearly equal size."""
    return df.repartitionByRange(n, order)
