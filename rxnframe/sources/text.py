"""Text formats as tables: coordinate frames, calculation logs, energy and element tables. Inputs are DataFrames with one text per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def format_frames(coords: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """One text per graph: for each frame the number of atoms, a comment line and a line per atom."""
    line = F.format_string("%s %.6f %.6f %.6f", "element", F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double"))
    atoms = coords.withColumn("_l", F.struct("node", line.alias("t"))).groupBy("graph_id", "frame").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x.t), "\n").alias("body"))
    if comments is not None:
        atoms = atoms.join(comments.select("graph_id", "frame", "comment"), ["graph_id", "frame"], "left")
    else:
        atoms = atoms.withColumn("comment", F.lit(""))
    part = F.concat_ws("\n", F.col("n").cast("string"), F.coalesce("comment", F.lit("")), "body")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", part.alias("t")))), lambda x: x.t), "\n")
    return atoms.groupBy("graph_id").agg(whole.alias("text"))


def _framed(texts: DataFrame) -> DataFrame:
    """Lines of the texts with their frame and place; n is the header's number of atoms, null if unreadable."""
    lines = F.split(F.regexp_replace("text", r"\n+$", ""), "\n")
    x = texts.withColumn("_lines", lines).withColumn("n", F.expr("try_cast(trim(_lines[0]) as int)")).withColumn("total", F.size("_lines"))
    return x.select("graph_id", "n", "total", F.posexplode("_lines").alias("pos", "line")).withColumns({"frame": F.floor(F.col("pos") / (F.col("n") + 2)).cast("int"), "place": F.col("pos") % (F.col("n") + 2)})


def explode_frames(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A10: coordinates (graph_id, frame, node, element, x, y, z), and rejects of texts whose lines don't make whole frames."""
    framed = _framed(texts)
    good = F.col("n").isNotNull() & (F.col("n") > 0) & (F.col("total") % (F.col("n") + 2) == 0)
    parts = F.split(F.trim("line"), r"\s+")
    number = lambda i: F.expr(f"try_cast(_p[{i}] as double)")
    atoms = framed.filter(good & (F.col("place") >= 2)).withColumn("_p", parts)
    coords = atoms.select("graph_id", "frame", (F.col("place") - 1).cast("long").alias("node"), F.get("_p", F.lit(0)).alias("element"), *[number(i + 1).alias(c) for i, c in enumerate("xyz")])
    rejects = framed.filter(~F.coalesce(good, F.lit(False))).select("graph_id").distinct().withColumns({"stage": F.lit("frames"), "reason": F.lit("line count")})
    return coords, rejects


def frame_energies(texts: DataFrame) -> DataFrame:
    """Energy (after `energy:`, or the number after `E` in a `Coordinates` comment) and charge (after `q`, 0 if absent) of each frame."""
    comment = _framed(texts).filter("place = 1")
    number = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    energy = F.coalesce(F.expr(rf"try_cast(nullif(regexp_extract(line, 'energy:\\s*{number.replace(chr(92), chr(92) * 2)}', 1), '') as double)"), F.expr(rf"try_cast(nullif(regexp_extract(line, 'Coordinates.*\\sE\\s+{number.replace(chr(92), chr(92) * 2)}', 1), '') as double)"))
    charge = F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(line, '(?:^|\\s)q\\s+(-?[0-9]+)', 1), '') as int)"), F.lit(0))
    return comment.select("graph_id", "frame", energy.alias("energy"), charge.alias("charge"))


def number_lines(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """One row per line: key, line_no (from 0) and line."""
    return texts.select(key, F.posexplode(F.split(column, "\n")).alias("line_no", "line"))


def extract_log_facts(lines: DataFrame, key: str, flags: dict[str, str], last: dict[str, str], counts: dict[str, str], ahead: tuple[str, str, int, str, float] | None = None) -> DataFrame:
    """Facts of each log from its numbered lines, by patterns.

    flags: some line matches. last: first group of the last matching line, as a number. counts: matching lines.
    ahead (flag, pattern, distance, value pattern, least): the flag holds if the last matching line's successor at that distance holds a value of at least `least` in size.
    """
    x = lines
    if ahead:
        name, pattern, far, value, least = ahead
        later = F.lead("line", far).over(Window.partitionBy(key).orderBy("line_no"))
        x = x.withColumn("_later", F.regexp_extract(later, value, 1).try_cast("double"))
    number = lambda p: F.regexp_extract("line", p, 1).try_cast("double")
    aggs = [F.bool_or(F.col("line").rlike(p)).alias(n) for n, p in flags.items()]
    aggs += [F.max_by(number(p), F.when(F.col("line").rlike(p), F.col("line_no"))).alias(n) for n, p in last.items()]
    aggs += [F.count_if(F.col("line").rlike(p)).alias(n) for n, p in counts.items()]
    if ahead:
        hit = F.col("line").rlike(pattern)
        aggs.append(F.coalesce(F.abs(F.max_by("_later", F.when(hit, F.col("line_no")))) >= least, F.lit(False)).alias(name))
    return x.groupBy(key).agg(*aggs)


#: Rules for the two log dialects: arguments of extract_log_facts.
GAUSSIAN = dict(
    flags={"finished": r"Normal\s+termination\s+of\s+Gaussian"},
    last={"zpe_correction": r"Zero-point correction=\s+(-?[\d.]+)", "zero_e": r"Sum of electronic and zero-point Energies=\s+(-?[\d.]+)", "h_298": r"Sum of electronic and thermal Enthalpies=\s+(-?[\d.]+)", "f_298": r"Sum of electronic and thermal Free Energies=\s+(-?[\d.]+)"},
    counts={"n_gradients": r"Forces\s+\(Hartrees/Bohr\)"},
    ahead=("single_mode", r"\s1 imaginary frequencies \(negative", 9, r"^\s*\S+\s+\S+\s+(-?[\d.]+)", 100.0),
)
ORCA = dict(
    flags={"finished": "ORCA TERMINATED NORMALLY"},
    last={"spe": r"FINAL SINGLE POINT ENERGY\s+(-?[\d.]+)", "zpe": r"Zero point energy\s+\.*\s+(-?[\d.]+)", "h_298": r"Total Enthalpy\s+\.*\s+(-?[\d.]+)", "f_298": r"Final Gibbs free energy\s+\.*\s+(-?[\d.]+)"},
    counts={"n_gradients": "ORCA SCF GRADIENT CALCULATION", "n_imaginary": r"^\s*\d+:\s+-[\d.]+\s+cm\*\*-1"},
)


def read_energies(lines: DataFrame, width: int = 14) -> DataFrame:
    """Lines (line_no, line) of `key E_0 H F SPE` -> one row per key prefix, the latest line winning; lines of fewer fields or with no numbers are left out."""
    x = lines.withColumn("_p", F.split(F.trim("line"), r"\s+")).filter(F.size("_p") >= 5)
    values = [F.get("_p", F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(("e_0", "h", "f", "spe"))]
    x = x.select("line_no", F.substring(F.get("_p", F.lit(0)), 1, width).alias("key"), *values).filter("e_0 is not null and spe is not null")
    return x.groupBy("key").agg(F.max_by(F.struct("e_0", "h", "f", "spe"), "line_no").alias("r")).select("key", "r.*")


def read_element_table(lines: DataFrame) -> DataFrame:
    """Lines `value # Z Symbol` -> element, number and electronegativity, `-` counting 0."""
    p = r"^\s*(-|[0-9.]+)\s*#\s*([0-9]+)\s+([A-Za-z]+)"
    g = lambda i: F.regexp_extract("line", p, i)
    value = F.when(g(1) == "-", F.lit(0.0)).otherwise(g(1).try_cast("double"))
    return lines.filter(F.col("line").rlike(p)).select(g(3).alias("element"), g(2).cast("int").alias("number"), value.alias("electronegativity"))
