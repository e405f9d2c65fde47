"""Fields of view on a raster: computed, kept in a table, looked up, and united into what a team sees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mistrail.functions.ground import Raster, fields_of_view, packed

#: Sources that a task works on side by side.
SIDE_BY_SIDE = 512
WORD = 64


def views(sources: DataFrame, raster: Raster, radius: float) -> DataFrame:
    """(i, j, patch, words): what is seen within ``radius`` cells from each distinct (i, j, patch) of ``sources``, a window of
    2 * int(radius) + 1 cells a side as words of 64 bits, row by row (see functions.ground.packed).

    ``patch`` is the brush that the source stands in, the cell's own where it is null. Sources off the raster see nothing
    and give no row. The cells are spread over the tasks, each of which holds the raster.
    """
    side = raster.side
    cells = sources.filter(F.col("i").between(0, side - 1) & F.col("j").between(0, side - 1)).select("i", "j", "patch").distinct()
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("patch", pa.int32()), ("words", pa.list_(pa.int64()))])

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SIDE_BY_SIDE):
                part = batch.slice(low, SIDE_BY_SIDE)
                i, j = (part.column(k).to_numpy().astype(int) for k in (0, 1))
                patch = part.column(2).to_pandas()
                brush = np.where(patch.isna(), raster.brush[i, j], patch.fillna(-1)).astype(int)
                words = packed(fields_of_view(raster, i, j, brush, radius))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), part.column(1).cast(pa.int32()), part.column(2).cast(pa.int32()), pa.array(list(words), pa.list_(pa.int64()))], schema=schema)

    return cells.mapInArrow(see, "i int, j int, patch int, words array<bigint>")


def view_table(raster: Raster, cells: DataFrame, radius: float) -> DataFrame:
    """(i, j, words) of every open cell (i, j) of ``cells``, seen from its own patch of brush: the table to look up."""
    return views(cells.select("i", "j", F.lit(None).cast("int").alias("patch")), raster, radius).select("i", "j", "words")


def look_up(sources: DataFrame, table: DataFrame, raster: Raster, radius: float) -> DataFrame:
    """``sources`` (i, j, patch and more) with words and live: from the table where a source stands on a cell of it in that
    cell's own patch, else computed for its distinct (i, j, patch). Sources off the raster have no words."""
    own = F.col("patch").isNull()
    found = sources.join(table.withColumnRenamed("words", "kept"), ["i", "j"], "left").withColumn("kept", F.when(own, F.col("kept")))
    live = views(found.filter("kept IS NULL").select("i", "j", "patch"), raster, radius).select("i", "j", F.coalesce("patch", F.lit(-2)).alias("__patch"), F.col("words").alias("made"))
    joined = found.withColumn("__patch", F.coalesce("patch", F.lit(-2))).join(live, ["i", "j", "__patch"], "left")
    return joined.withColumn("live", F.col("kept").isNull()).withColumn("words", F.coalesce("kept", "made")).drop("__patch", "kept", "made")


def united(seen: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """(keys, i, word, bits): union of what sources see, row i of the grid in words of 64 bits.

    ``seen``: keys, i, j, r (the source's own radius in cells, at most ``radius``) and words. A view within r is the view
    within ``radius`` and the disc of r. Each row of a window is cut to the disc and shifted to its place; the union is a
    bitwise or that combines on the map side.
    """
    reach = int(radius)
    per_row = -(-(2 * reach + 1) // WORD)
    rows = seen.filter("words IS NOT NULL").withColumn("__d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).filter(F.col("r") * F.col("r") >= F.col("__d") * F.col("__d"))
    rows = rows.withColumn("__w", F.explode(F.array(*[F.lit(w) for w in range(per_row)])))
    half = F.floor(F.sqrt(F.col("r") * F.col("r") - F.col("__d") * F.col("__d")))
    # The root may be off by a last digit.
    half = half + F.when((half + 1) * (half + 1) + F.col("__d") * F.col("__d") <= F.col("r") * F.col("r"), 1).otherwise(0)
    first, last = F.greatest(reach - half - WORD * F.col("__w"), F.lit(0)).cast("int"), F.least(reach + half - WORD * F.col("__w"), F.lit(WORD - 1)).cast("int")
    ones = lambda n: F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), WORD - n)
    rows = rows.withColumn("__first", first).withColumn("__last", last).filter("__first <= __last")
    disc = F.call_function("shiftleft", ones(F.col("__last") - F.col("__first") + 1), F.col("__first"))
    value = F.element_at("words", ((F.col("__d") + reach) * per_row + F.col("__w") + 1).cast("int")).bitwiseAND(disc)
    rows = rows.withColumn("__v", value).withColumn("__at", F.col("j") - reach + WORD * F.col("__w")).filter("__v <> 0")
    shift = F.pmod(F.col("__at"), F.lit(WORD)).cast("int")
    low, high = F.call_function("shiftleft", F.col("__v"), shift), F.when(shift > 0, F.call_function("shiftrightunsigned", F.col("__v"), WORD - shift)).otherwise(F.lit(0).cast("long"))
    word = F.floor(F.col("__at") / WORD).cast("int")
    parts = rows.select(*keys, (F.col("i") + F.col("__d")).alias("i"), F.inline(F.array(F.struct(word.alias("word"), low.alias("bits")), F.struct((word + 1).alias("word"), high.alias("bits")))))
    return parts.filter("bits <> 0").groupBy(*keys, "i", "word").agg(F.bit_or("bits").alias("bits"))
