"""A small invented dependency graph over the corpus's codepoints, version 1.

Nodes are U<codepoint>, G<number> (a codepoint's nominal glyph bears its number) and F<feature>.
Base letters of Latin-1 are generated from the Unicode database; composing takes a full stop for
the mark, as the corpus has no combining ones. The rest is a handful of substitutions.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STOP = 46


def bases() -> list[tuple[int, int]]:
    """(codepoint, base) of Latin-1 letters that decompose."""
    out = []
    for cp in range(0xC0, 0x100):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) == 2:
            out.append((cp, ord(d[0])))
    return out


def table() -> list[tuple[int, int, str, list[list[str]]]]:
    """(edge_id, phase, dst, groups); ids from 100000 up, below that are the nominal maps."""
    rows: list[tuple[int, str, list[list[str]]]] = []
    for cp, base in bases():
        rows.append((0, f"U{base}", [[f"U{cp}"]]))
        rows.append((0, f"U{cp}", [[f"U{base}"], [f"U{STOP}"]]))
        rows.append((2, f"G{base}", [[f"G{cp}"]]))
    g = lambda c: f"G{ord(c)}"
    rows += [
        (1, "G5001", [[g("f")], [g("i")]]),
        (1, "G5002", [[g("a")], ["Fsmcp"]]),
        (1, "G5003", [[g("t")], [g("h"), g("e")]]),
        (1, "G5004", [["G5001"], [g("l")]]),
        (1, "G5005", [[g("q")], [g("u"), g("w")], [g("é"), g("e")]]),
        (1, "G5006", [["G5003"]]),
        (1, "G5003", [["G5006"]]),
        (2, "G5010", [["G5004"]]),
    ]
    return [(100000 + i, *r) for i, r in enumerate(rows)]


def edges(font: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, needs) for a font(cp)."""
    spark = font.sparkSession
    fixed = spark.createDataFrame(table(), "edge_id int, phase int, dst string, groups array<array<string>>")
    has = font.select(F.concat(F.lit("U"), F.col("cp")).alias("u"))
    # Codepoints that the font lacks are in no edge.
    bad = fixed.select("edge_id", F.explode(F.concat(F.flatten("groups"), F.array("dst"))).alias("u")).where("u like 'U%'").join(has, "u", "left_anti").select("edge_id").distinct()
    fixed = fixed.join(bad, "edge_id", "left_anti")
    nominal = font.select(F.col("cp").alias("edge_id"), F.lit(0).alias("phase"), F.concat(F.lit("G"), F.col("cp")).alias("dst"), F.array(F.array(F.concat(F.lit("U"), F.col("cp")))).alias("groups"))
    every = nominal.unionByName(fixed)
    groups = every.select("edge_id", F.posexplode("groups").alias("group_no", "g"))
    return every.select("edge_id", "phase", "dst"), groups.select("edge_id", "group_no", F.explode("g").alias("node"))


def sql_table() -> str:
    rows = ", ".join(f"({i}, {p}, '{d}', {groups!r})" for i, p, d, groups in table())
    return f"SELECT * FROM (VALUES {rows}) v(edge_id, phase, dst, groups)"


SQL = {
    "fixed": sql_table(),
    "bad": "SELECT DISTINCT edge_id FROM (SELECT edge_id, unnest(list_concat(flatten(groups), [dst])) AS u FROM fixed) WHERE u LIKE 'U%' AND u NOT IN (SELECT 'U' || cp FROM font)",
    "okay": "SELECT * FROM fixed WHERE edge_id NOT IN (SELECT edge_id FROM bad)",
    "every": "SELECT cp AS edge_id, 0 AS phase, 'G' || cp AS dst, [['U' || cp]] AS groups FROM font UNION ALL SELECT * FROM okay",
    "eg": "SELECT edge_id, unnest(range(len(groups))) AS group_no, unnest(groups) AS g FROM every",
    "needs": "SELECT edge_id, group_no, unnest(g) AS node FROM eg",
    "arcs": "SELECT DISTINCT node AS src, dst FROM needs JOIN every USING (edge_id)",
}


def sql_closure(start: str, name: str = "c", rounds: int = 4, phases=(0, 1, 2)) -> dict[str, str]:
    """Unrolled rounds of a closure as named parts; `start` gives (request, node). The last part is `name`."""
    parts, last = {f"{name}0": f"SELECT DISTINCT request, node FROM ({start})"}, f"{name}0"
    k = 0
    for phase in phases:
        for _ in range(rounds):
            k += 1
            parts[f"{name}{k}"] = (
                f"SELECT request, node FROM {last} UNION SELECT request, dst FROM (SELECT r.request, n.edge_id FROM {last} r JOIN needs n ON n.node = r.node JOIN every e ON e.edge_id = n.edge_id AND e.phase = {phase} "
                f"GROUP BY 1, 2, e.groups HAVING count(DISTINCT group_no) = len(e.groups)) JOIN every USING (edge_id)"
            )
            last = f"{name}{k}"
    parts[name] = f"SELECT * FROM {last}"
    return parts
