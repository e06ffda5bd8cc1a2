"""Gates, axis transforms and computed columns."""

from __future__ import annotations

import json
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


def moments(column: str, inside: Column, name: str) -> list[Column]:
    """Minimum, mean and deviation of a column over the rows where inside holds."""
    x = F.when(inside, F.col(column).cast("double"))
    return [F.min(x).alias(f"{name}_lo"), F.avg(x).alias(f"{name}_m"), F.stddev_samp(x).alias(f"{name}_s")]


def transformed(column: str, kind: str, low: Column, mean: Column, deviation: Column) -> Column:
    """A column under none, ln, log2, log10 or zscore. Logarithms add |low| + 1 if the least value is 0 or less."""
    x = F.col(column).cast("double")
    moved = F.when(low <= 0, x + F.abs(low) + 1).otherwise(x)
    kinds = {"none": x, "ln": F.log(moved), "log2": F.log2(moved), "log10": F.log10(moved), "zscore": F.when(deviation > 0, (x - mean) / deviation)}
    return kinds[kind]


def transform_axis(df: DataFrame, column: str, kind: str, out: str, population: str | None = None) -> DataFrame:
    """df with a transformed column; minimum, mean and deviation are those of the population, a boolean column."""
    stats = df.agg(*moments(column, F.col(population) if population else F.lit(True), "_t"))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, transformed(column, kind, F.col("_t_lo"), F.col("_t_m"), F.col("_t_s"))).drop("_t_lo", "_t_m", "_t_s")  # one row


def test(value: Column, operator: str, low: float, high: float | None = None) -> Column:
    """Whether a value meets an operator; null and NaN don't."""
    found = value.between(low, high) if operator == "between" else OPERATORS[operator](value, F.lit(low))
    return F.coalesce(found & ~F.isnan(value.cast("double")), F.lit(False))


def rectangle(x: Column, y: Column, box: tuple[float, float, float, float], parent: Column | None = None) -> Column:
    """Whether a point of the parent population lies in x0 <= x <= x1, y0 <= y <= y1."""
    inside = test(x, "between", box[0], box[1]) & test(y, "between", box[2], box[3])
    return inside if parent is None else inside & parent


def replay_gates(df: DataFrame, gates: list[dict]) -> DataFrame:
    """df with a 0/1 column for each gate, applied in order.

    A gate has id, parent (or None), x_var, y_var, x_transform, y_transform, x_operator, x_lo, x_hi, and the same for y. Every variable is
    looked up before any gate is applied. Transforms refer to the parent population: the statistics of all gates that don't rest on one
    another come from one aggregation, whose row enters the plan as constants. So the table is read once for each depth of the tree
    that has transforms, and once for the result.
    """
    known = {c.lower() for c in df.columns} | {g["id"].lower() for g in gates}
    missing = sorted({g[k] for g in gates for k in ("x_var", "y_var") if g.get(k) and g[k].lower() not in known})
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    left = list(gates)
    while left:
        batch: list[dict] = []
        for g in left:  # up to the first gate that rests on one of this batch
            if {g.get("parent"), g.get("x_var"), g.get("y_var")} & {b["id"] for b in batch}:
                break
            batch.append(g)
        left = left[len(batch) :]
        df = _apply_gates(df, batch)
    return df


def _apply_gates(df: DataFrame, gates: list[dict]) -> DataFrame:
    inside = lambda g: F.col(g["parent"]) == 1 if g.get("parent") else F.lit(True)
    axes = [(g, a, g.get(f"{a}_transform") or "none") for g in gates for a in "xy" if g.get(f"{a}_var")]
    asked = [m for k, (g, a, kind) in enumerate(axes) if kind != "none" for m in moments(g[f"{a}_var"], inside(g), f"s{k}")]
    stats = df.agg(*asked).first() if asked else None
    tests: dict[str, Column] = {g["id"]: inside(g) for g in gates}
    for k, (g, a, kind) in enumerate(axes):
        low, mean, deviation = (F.lit(stats[f"s{k}_{n}"] if kind != "none" else None).cast("double") for n in ("lo", "m", "s"))
        value = transformed(g[f"{a}_var"], kind, low, mean, deviation)
        tests[g["id"]] &= test(value, g[f"{a}_operator"], g[f"{a}_lo"], g.get(f"{a}_hi"))
    return df.withColumns({name: passed.cast("int") for name, passed in tests.items()})


def gates_from_json(text: str) -> list[dict]:
    """The gates of a JSON object, in its order; thresholds may be named x_threshold and x_threshold_max."""
    gates = []
    for key, g in json.loads(text).items():
        gate = {"id": g.get("id", key), "parent": g.get("parent"), "x_var": g.get("x_var"), "y_var": g.get("y_var")}
        for a in "xy":
            gate |= {f"{a}_transform": g.get(f"{a}_transform") or "none", f"{a}_operator": g.get(f"{a}_operator") or "between"}
            gate |= {f"{a}_lo": g.get(f"{a}_threshold", g.get(f"threshold_{a}min")), f"{a}_hi": g.get(f"{a}_threshold_max", g.get(f"threshold_{a}max"))}
        gates.append(gate)
    return gates


def gate_stats(df: DataFrame, gates: list[dict]) -> DataFrame:
    """(gate_id, parent, path, depth, n_before, n_after, pct_parent, pct_total), all from one pass over the cells."""
    counts = df.agg(F.count("*").alias("_all"), *[F.sum(g["id"]).alias(g["id"]) for g in gates])
    by_id = {g["id"]: g for g in gates}

    def path(g: dict) -> list[str]:
        return [*(path(by_id[g["parent"]]) if g.get("parent") else []), g["id"]]

    rows = []
    for g in gates:
        before = F.col(g["parent"]) if g.get("parent") else F.col("_all")
        after = F.coalesce(g["id"], F.lit(0))
        share = lambda n: F.when(n > 0, F.round(100 * after / n, 2))  # noqa: B023, E731
        names = {"gate_id": F.lit(g["id"]), "parent": F.lit(g.get("parent")).cast("string"), "path": F.lit("/".join(path(g))), "depth": F.lit(len(path(g)))}
        values = {"n_before": F.coalesce(before, F.lit(0)).cast("long"), "n_after": after.cast("long"), "pct_parent": share(before), "pct_total": share(F.col("_all"))}
        rows.append(F.struct(*[c.alias(k) for k, c in (names | values).items()]))
    return counts.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def deepest_gate(df: DataFrame, gates: list[dict], out: str = "gate_label") -> DataFrame:
    """df with the deepest gates that hold each cell, siblings joined by ``+``, or Ungated.

    Of the deepest gates the first in order decides the parent.
    """
    by_id = {g["id"]: g for g in gates}
    depth = lambda g: 1 + (depth(by_id[g["parent"]]) if g.get("parent") else 0)
    info = [F.when(F.col(g["id"]) == 1, F.struct(F.lit(-depth(g)).alias("d"), F.lit(k).alias("k"), F.lit(g.get("parent") or "").alias("p"), F.lit(g["id"]).alias("g"))) for k, g in enumerate(gates)]
    held = F.sort_array(F.filter(F.array(*info), lambda s: s.isNotNull()))
    df = df.withColumn("_held", held)
    top = F.get("_held", F.lit(0))
    own = F.transform(F.filter("_held", lambda s: (s["d"] == top["d"]) & (s["p"] == top["p"])), lambda s: s["g"])
    return df.withColumn(out, F.when(F.size("_held") == 0, F.lit("Ungated")).otherwise(F.array_join(own, "+"))).drop("_held")


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule: edges count if exactly one end is above y (half open), and the crossing is strictly right of x."""
    if len(vertices) < 3:
        raise ValueError("a polygon needs three vertices")
    crossings = []
    for (xi, yi), (xj, yj) in zip(vertices, [vertices[-1], *vertices[:-1]]):
        if yi == yj:
            continue
        spans = (F.lit(float(yi)) > y) != (F.lit(float(yj)) > y)
        edge = F.lit(float(xj - xi)) * (y - float(yi)) / F.lit(float(yj - yi)) + float(xi)
        crossings.append((spans & (x < edge)).cast("int"))
    return F.coalesce(sum(crossings[1:], crossings[0]) % 2 == 1, F.lit(False)) if crossings else F.lit(False)


def polygon_gates(df: DataFrame, polygons: dict[str, list[tuple[float, float]]], x: str = "x", y: str = "y", out: str = "gate") -> DataFrame:
    """The cells in at least one polygon, with the names of all that hold them, joined by commas."""
    names = F.array(*[F.when(in_polygon(F.col(x), F.col(y), v), F.lit(k)) for k, v in polygons.items()])
    df = df.withColumn(out, F.array_join(names, ","))
    return df.where(F.col(out) != "")


def computed_column(columns: list[str], operators: list[str]) -> Column:
    """Fold of columns from left to right: + - * / & | == != > < >= <= paste pmax pmin. Division by zero is null."""
    number = lambda c: c.try_cast("double")
    flag = lambda c: c.cast("boolean")
    steps = {
        "+": lambda a, b: number(a) + number(b),
        "-": lambda a, b: number(a) - number(b),
        "*": lambda a, b: number(a) * number(b),
        "/": lambda a, b: F.try_divide(number(a), number(b)),
        "&": lambda a, b: flag(a) & flag(b),
        "|": lambda a, b: flag(a) | flag(b),
        "==": lambda a, b: a == b,
        "!=": lambda a, b: a != b,
        ">": lambda a, b: number(a) > number(b),
        "<": lambda a, b: number(a) < number(b),
        ">=": lambda a, b: number(a) >= number(b),
        "<=": lambda a, b: number(a) <= number(b),
        "paste": lambda a, b: F.concat_ws("_", a.cast("string"), b.cast("string")),
        "pmax": lambda a, b: F.greatest(number(a), number(b)),
        "pmin": lambda a, b: F.least(number(a), number(b)),
    }
    if len(operators) != len(columns) - 1:
        raise ValueError("one operator between each two columns")
    out = F.col(columns[0])
    for op, c in zip(operators, columns[1:]):
        out = steps[op](out, F.col(c))
    return out


def affine(x: Column, y: Column, scale: float = 1.0, flip_y: bool = False, dx: float = 0.0, dy: float = 0.0) -> tuple[Column, Column]:
    """Scale, then flip y, then move."""
    return x * scale + dx, (-y if flip_y else y) * scale + dy
