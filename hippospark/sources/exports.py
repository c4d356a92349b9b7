"""One huge JSON array, read in many tasks.

The file is read as text cut at commas, which Spark splits by bytes wherever the file lies. Which commas stand between the
array's elements depends on all that came before; so a first pass tells, for each split and for both states it may begin in
(inside a string or not), the state at its end and by how much the nesting deepens. Strung together, these give each split's
beginning, and a second pass cuts the elements. An element that spans splits is put together from its pieces.

Rows are those of Spark's multi-line reader on a well-formed file. A file that ends within an element, as an export that
broke off does, gives the elements before it; an element that is no object gives no row; an empty file or array none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hippospark.functions.storage import saved

ENDS = "file string, start long, out_in boolean, out_depth long, in_in boolean, in_depth long"
PIECES = "file string, start long, element long, piece long, text string, ended boolean"


def scan(text: str, inside: bool, depth: int) -> tuple[bool, int]:
    """The state after a text: whether a string is open, and how deep it is nested. A backslash stands for what follows it."""
    i, n = 0, len(text)
    while i < n:
        if inside:
            quote, escape = text.find('"', i), text.find("\\", i)
            if escape >= 0 and (quote < 0 or escape < quote):
                i = escape + 2
            elif quote >= 0:
                inside, i = False, quote + 1
            else:
                return True, depth
        else:
            quote = text.find('"', i)
            plain = text[i:] if quote < 0 else text[i:quote]
            depth += plain.count("{") + plain.count("[") - plain.count("}") - plain.count("]")
            if quote < 0:
                return False, depth
            inside, i = True, quote + 1
    return inside, depth


def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str, bool]]:
    """Rows of a partition: their split (file and first byte), text, and whether the split is a new one."""
    last = None
    for batch in batches:
        for file, start, text in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value")), strict=True):
            yield (file, start), text, (file, start) != last
            last = (file, start)


def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, states = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "out_in": states[0][0], "out_depth": states[0][1], "in_in": states[1][0], "in_depth": states[1][1]}])

    for own, text, new in splits(batches):
        if new:
            if key is not None:
                yield row()
            key, states = own, [(False, 0), (True, 0)]
        states = [scan(text, *s) for s in states]
    if key is not None:
        yield row()


def elements(spark: SparkSession, path: str) -> DataFrame:
    """The elements of the array in each file: file, place (of split and within it), text."""
    # a comma is never part of an escape, so no cut falls between a backslash and what it stands for
    raw = spark.read.option("lineSep", ",").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    # as many rows as splits
    per = raw.mapInArrow(ends, ENDS).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "out_in", "out_depth", "in_in", "in_depth"))).alias("s"))
    begin = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("depth"), F.array().cast("array<struct<start:bigint,inside:boolean,depth:bigint>>").alias("all"))
    step = lambda a, x: F.struct(
        F.when(a["inside"], x["in_in"]).otherwise(x["out_in"]).alias("inside"), (a["depth"] + F.when(a["inside"], x["in_depth"]).otherwise(x["out_depth"])).alias("depth"),
        F.concat(a["all"], F.array(F.struct(x["start"].alias("start"), a["inside"].alias("inside"), a["depth"].alias("depth")))).alias("all"),
    )
    states = saved(per.select("file", F.explode(F.aggregate("s", begin, step, lambda a: a["all"])).alias("b")).select("file", "b.*"), "splits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        element = piece = depth = 0
        inside = False
        for batch in batches:
            for file, start, own_inside, own_depth in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "inside", "depth")), strict=True):
                known[file, start] = own_inside, own_depth
            out = []
            for own, text, new in splits([batch]):
                if new and own != known.get("last"):
                    known["last"] = own
                    (inside, depth), element, piece = known[own], 0, 0
                root, (inside, depth) = not inside and depth == 0, scan(text, inside, depth)
                ended = not inside and depth <= 1
                if root:  # the array's own brackets belong to no element
                    text = text.lstrip().removeprefix("[")
                if not inside and depth == 0 and "]" in text:
                    text = text[: text.rindex("]")]
                out.append((*own, element, piece, text, ended))
                element, piece = (element + 1, 0) if ended else (element, piece + 1)
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string() if i in (0, 4) else pa.bool_() if i == 5 else pa.int64()) for i in range(6)], names)

    pieces = raw.join(F.broadcast(states), ["file", "start"]).mapInArrow(cut, PIECES)
    pieces = saved(pieces, "pieces")
    # an element that begins in one split and ends in a later one goes by where it ends
    done = pieces.groupBy("file", "start").agg(F.count_if("ended").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    done = done.select("file", "start", F.coalesce(before, F.lit(0)).alias("before"))
    whole = pieces.join(F.broadcast(done), ["file", "start"]).groupBy("file", (F.col("before") + F.col("element")).alias("place"))
    whole = whole.agg(F.array_sort(F.collect_list(F.struct("start", "piece", "text"))).alias("p"), F.bool_or("ended").alias("ended"))
    return whole.where("ended").select("file", "place", F.array_join(F.transform("p", lambda x: x["text"]), ",").alias("text"))


def read_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The array's objects as rows."""
    return elements(spark, path).select(F.from_json("text", schema).alias("row")).where("row is not null").select("row.*")
