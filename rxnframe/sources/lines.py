"""Large text files by ranges of bytes: numbered lines, and trajectory frames, read by many tasks.

Spark's text source cuts files into ranges and finds the line that each begins with. A line's number is its place in its range plus the lines of the ranges before, of which
there is one row each. A trajectory's frames (a line with the number of atoms, a comment, a line an atom) are found from their header lines alone: a line of nothing but a
whole number, unless it follows such a line, which makes it a comment. No task needs a whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxnframe.session import discard, table

HEADER = r"^\s*[0-9]+\s*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """File, line_no (from 0, long) and line of every line of the files, in tables of the session's work folder. Empty lines count; an empty file has none."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    raw = table(raw)  # numbers are given once, as the ranges were read
    ranges = raw.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.select("file", "start", "first", before.alias("before"))  # a row a range
    return raw.join(placed, ["file", "start"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("line_no"), "line")


def read_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Coordinates (file, frame, node, element, x, y, z) and rejects (file, line_no, stage, reason).

    frame counts a file's frames from 0 in order, broken ones included. A frame is broken, and rejected at its header's line, where its atoms' lines are not element and three numbers or too few come before the next frame or
    the end. Lines that belong to no frame are rejected each, but for empty ones."""
    numbered_lines = read_lines(spark, path).withColumn("p", F.split(F.trim("line"), r"\s+"))
    value = lambda i: F.get("p", F.lit(i)).try_cast("double")
    is_atom = (F.size("p") >= 4) & value(1).isNotNull() & value(2).isNotNull() & value(3).isNotNull()
    n = F.when(F.col("line").rlike(HEADER), F.coalesce(F.trim("line").try_cast("int"), F.lit(0))).alias("n")
    atom = [F.when(is_atom, x).alias(c) for c, x in zip(("element", *"xyz"), (F.get("p", F.lit(0)), *[value(i) for i in (1, 2, 3)]))]
    lines = table(numbered_lines.select("file", "line_no", n, (F.trim("line") == "").alias("blank"), F.coalesce(is_atom, F.lit(False)).alias("atom"), *atom))
    number = lines.filter("n is not null").select("file", "line_no", "n")
    # Joins of a row a frame or a line are merged: such rows take far less room in files, by which Spark would choose to broadcast them, than in memory.
    after = number.select("file", (F.col("line_no") + 1).alias("line_no")).hint("merge")
    heads = table(number.join(after, ["file", "line_no"], "left_anti").filter("n > 0"))
    part = F.floor(F.col("line_no") / (1 << 20)).alias("part")  # heads are numbered within parts of a file, then across them
    sizes = heads.groupBy("file", part).agg(F.count("*").alias("k"))
    earlier = F.coalesce(F.sum("k").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("file", "part", earlier.alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("file", "part").orderBy("line_no"))
    numbered = heads.withColumn("part", part).withColumn("rank", rank).join(sizes, ["file", "part"]).select("file", "n", F.col("line_no").alias("head"), (F.col("rank") + F.col("earlier") - 1).cast("int").alias("frame"))
    place = F.posexplode(F.sequence(F.col("head"), F.col("head") + F.col("n") + 1)).alias("place", "line_no")
    wanted = numbered.select("file", "head", "frame", F.col("n").alias("size"), place)
    met = lines.drop("n").join(wanted.hint("merge"), ["file", "line_no"], "left")
    met = table(met.withColumn("atom", F.col("atom") & F.coalesce(F.col("place") >= 2, F.lit(False))))
    whole = met.filter("head is not null").groupBy("file", "head").agg((F.count_if("atom") == F.max("size")).alias("whole"))
    whole = table(whole)
    discard(lines, heads)
    atoms = met.filter("atom").join(whole.filter("whole").hint("merge"), ["file", "head"], "left_semi")
    coords = atoms.select("file", "frame", (F.col("place") - 1).cast("long").alias("node"), "element", "x", "y", "z")
    broken = whole.filter("not whole").select("file", F.col("head").alias("line_no"), F.lit("frames").alias("stage"), F.lit("broken frame").alias("reason"))
    loose = met.filter("head is null and not blank").select("file", "line_no", F.lit("frames").alias("stage"), F.lit("outside frames").alias("reason"))
    return coords, broken.unionByName(loose)
