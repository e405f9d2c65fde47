"""Flat tables with parent-child links out of nested records."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mistrail.functions.json_triples import Triple, Wanted, triples

#: Triples that a task holds before it hands them on.
BATCH = 50_000


def record_triples(records: DataFrame, record_id: str, body: str, maps: list[str], prefixes: list[str] | None = None) -> DataFrame:
    """(record_id, path, ordinals, value, type): each record of ``body`` parsed as a stream, see functions.json_triples.

    ``maps`` are the paths of objects whose keys are data; with ``prefixes``, only paths that begin with one of them are
    given and all else is checked and passed over as it is read. Records that are not valid JSON give nothing: the triples
    of a record wait, as Arrow batches, until its end is reached. Resent records (same record_id and body) count once. The
    result has a row per value, so that a single large record spreads over the tasks of whatever comes next.

    Defined results: null and empty bodies give nothing; records without record_id keep a null one; records with the
    same record_id and different bodies are read one after the other into the same tables; nesting of any depth and
    numbers of any length are read; a lone surrogate in a string becomes a question mark.
    """
    names = frozenset(maps)
    schema = pa.schema([("record_id", pa.int64()), ("path", pa.string()), ("ordinals", pa.list_(pa.string())), ("value", pa.string()), ("type", pa.string())])

    def batch_of(numbers: list[int | None], held: list[Triple]) -> pa.RecordBatch:
        columns = [numbers, *zip(*held)]
        try:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        except UnicodeEncodeError:
            sound = lambda s: s and s.encode("utf-8", "replace").decode()
            return batch_of(numbers, [(sound(p), [sound(o) for o in ords], sound(v), t) for p, ords, v, t in held])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: list[int | None] = []
        held: list[Triple] = []
        wanted = Wanted(prefixes)
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: list[Triple] = []
                parts: list[pa.RecordBatch] = []
                try:
                    for triple in triples(text, names, wanted=wanted):
                        own.append(triple)
                        if len(own) >= BATCH:
                            parts.append(batch_of([number] * len(own), own))
                            own = []
                except ValueError:
                    continue
                yield from parts
                held.extend(own)
                numbers.extend([number] * len(own))
                if len(held) >= BATCH:
                    yield batch_of(numbers, held)
                    numbers, held = [], []
        if held:
            yield batch_of(numbers, held)

    once = records.select(F.col(record_id).cast("long").alias("record_id"), F.col(body).alias("body")).filter("body IS NOT NULL").dropDuplicates(["record_id", "body"])
    return once.mapInArrow(parse, "record_id long, path string, ordinals array<string>, value string, type string")


def repeated_ancestor(path: Column) -> Column:
    """The part of a path up to its last repeated element; '' for values that occur once per record."""
    return F.regexp_extract(path, r"^(.*(?:\[\]|\{\}))", 1)


@dataclass(frozen=True)
class FlatTable:
    """One flat table: the ``ancestor`` whose objects are its rows, and its columns by path relative to it.

    A row stands for each object at ``ancestor`` or, with ``must_have``, for each place where one of these columns has a
    value.
    """

    ancestor: str
    columns: dict[str, str]
    must_have: tuple[str, ...] = ()

    def prefixes(self) -> list[str]:
        return [f"{self.ancestor}.{p}" for p in self.columns.values()] + ([] if self.must_have else [self.ancestor])


def flat_tables(parsed: DataFrame, tables: dict[str, FlatTable]) -> DataFrame:
    """(record_id, table, o0..on, the columns of all tables): the rows of all ``tables``, in one pass over the triples.

    o0..on are the ordinals of a table's ancestor and of all its own repeated ancestors, null beyond them: (record_id,
    o0..ok) is the key of the table above. Triples are grouped by record, table and ordinals, so that no group is larger
    than one row of a table. A path belongs to one table only.
    """
    home = {p: name for name, t in tables.items() for p in t.prefixes()}
    if len(home) < sum(len(t.prefixes()) for t in tables.values()):
        raise ValueError("a path belongs to two tables")
    depths = {name: t.ancestor.count("[]") + t.ancestor.count("{}") for name, t in tables.items()}
    table = F.create_map(*[F.lit(x) for pair in home.items() for x in pair])[F.col("path")]
    depth = F.create_map(*[F.lit(x) for pair in depths.items() for x in pair])[F.col("table")]
    rows = parsed.filter(F.col("path").isin(*home)).withColumn("table", table).withColumn("depth", depth)
    most = max(depths.values())
    place = [F.when(F.col("depth") > i, F.element_at("ordinals", i + 1)).alias(f"o{i}") for i in range(most)]
    rows = rows.select("record_id", "table", *place, "path", "value", "type")
    cells: dict[str, list[str]] = {}
    for t in tables.values():
        for name, p in t.columns.items():
            cells.setdefault(name, []).append(f"{t.ancestor}.{p}")
    values = [F.max(F.when(F.col("path").isin(*paths), F.col("value"))).alias(name) for name, paths in cells.items()]
    objects = [t.ancestor for t in tables.values() if not t.must_have]
    there = F.max((F.col("path").isin(*objects) & (F.col("type") == "object")) if objects else F.lit(False))
    flat = rows.groupBy("record_id", "table", *[f"o{i}" for i in range(most)]).agg(*values, there.alias("__object"))
    keep = F.lit(False)
    for name, t in tables.items():
        keep = keep | ((F.col("table") == name) & (F.coalesce(*t.must_have).isNotNull() if t.must_have else F.col("__object")))
    return flat.filter(keep).drop("__object")


def table_of(parsed: DataFrame, ancestor: str, columns: dict[str, str], must_have: list[str] | None = None) -> DataFrame:
    """(record_id, o0..on, columns): the flat table of one repeated ancestor."""
    return flat_tables(parsed, {"it": FlatTable(ancestor, columns, tuple(must_have or ()))}).drop("table")
