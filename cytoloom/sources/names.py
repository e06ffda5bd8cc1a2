"""Column names of cell tables: what each vendor's export calls its coordinates, ids and markers.

Everything here works on lists of names alone; no data is read. Positions in a result follow the order of the input.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

# Words that mark compartments and measurements, and columns that are never markers.
COMPARTMENTS = ("cell", "nucleus", "cytoplasm", "membrane")
MEASURES = ("intensity", "mean")
SPREADS = ("median", "min", "max", "std", "dev")
NOT_MARKERS = (
    "x", "y", "x_min", "x_max", "y_min", "y_max", "xmin", "xmax", "ymin", "ymax", "centroid_x", "centroid_y", "centroid_x_um", "centroid_y_um",
    "centroid_x_px", "centroid_y_px", "ctrx", "ctry", "cell_x_position", "cell_y_position", "center_x", "center_y", "x_x", "y_y", "label", "size",
    "cell_id", "object_id", "area", "perimeter", "sample_name", "tissue_category", "phenotype", "classification", "orig_object", "tile_index",
    "area_convex", "min_rot_rect", "extent", "orientation", "elongation", "compactness_circle", "compactness_square", "euler_number",
)
NOT_IN_MARKERS = (
    "centroid", "geometry", "object", "eccentricity", "bbox", "convexity", "axis", "diameter", "solidity", "euler",
)
COORDINATES = ("x", "y", "XMin", "XMax", "YMin", "YMax", "Centroid_X", "Centroid_Y")
NOT_COMPARED = ("XMin", "XMax", "YMin", "YMax", "Analysis.Region", "Analysis Region")
ALIASES = {"z": ("Z", "Z_Z"), "reg": ("Region", "region"), "tile_num": ("tile_nr", "tile_number"), "size": ("Cell_Area_mm2",)}
ID_ALIASES = ("CellID", "label", "Object_Id")


def made_unique(names: list[str], joint: str = "_", first: int = 2) -> list[str]:
    """Names with a number behind every repetition; no number makes a name that is taken."""
    out: list[str] = []
    taken = set()
    for name in names:
        new, k = name, first
        while new in taken:
            new, k = f"{name}{joint}{k}", k + 1
        taken.add(new)
        out.append(new)
    return out


def snake(names: list[str]) -> list[str]:
    """Lower case, the micro sign as u, everything but letters and digits as one underscore, none at the ends."""
    return [re.sub(r"[^a-z0-9]+", "_", re.sub("[µμ]m", "um", n.lower())).strip("_") for n in names]


def syntactic(name: str) -> str:
    """A name of letters, digits, dots and underscores that begins with a letter or a dot, as R makes it."""
    name = re.sub(r"[^A-Za-z0-9._]", ".", name)
    return name if re.match(r"[A-Za-z]|\.(?![0-9])", name) else "X" + name


def resolve(name: str, columns: list[str]) -> str | None:
    """The column that a stored name stands for: itself, its syntactic form, or a column of the same syntactic form."""
    safe = syntactic(name)
    for candidate in (name, safe):
        if candidate in columns:
            return candidate
    return next((c for c in columns if syntactic(c) in (name, safe)), None)


@dataclass(frozen=True)
class Renaming:
    """New names in the order of the old ones, and for x and y the pair of columns (new names) whose midpoint they are, if any."""

    names: list[str]
    midpoints: dict[str, tuple[str, str]]


def clean_names(columns: list[str]) -> Renaming:
    """Names without vendor ornaments, with x, y, z, reg, tile_num, size and cell_id under these names.

    Cycle suffixes and colon prefixes go where any name has ``Cyc_``; everything up to a bracket goes from names with ``MP`` where any
    name begins so; `` Cell Intensity`` goes. Of the candidates for a coordinate the first kind present counts: the capital letter,
    the doubled letter, Ctr, then a centroid whose letter stands alone. Else the middle of the bounding box is taken.
    """
    names = list(columns)
    if any("Cyc_" in n for n in names):
        names = [re.sub(r"^.*:", "", re.sub(r":Cyc_.*", "", n)) for n in names]
    if any(n.startswith("MP") for n in names):
        names = [re.sub(r"MP.*\(", "", n) for n in names]
    names = [re.sub("[µμ]", "u", n.replace(" Cell Intensity", "", 1)) for n in names]
    names = [n if re.match("[A-Za-z_]", n) else "x" + n for n in (re.sub(r"[^A-Za-z0-9]+", "_", n).strip("_") for n in names)]
    names = made_unique(names)
    midpoints = {}

    def rename(old: str, new: str) -> None:
        names[names.index(old)] = new

    for axis in "xy":
        if axis in names:
            continue
        high = axis.upper()
        alone = re.compile(rf"centroid[_.\s]*{axis}([_.\s]|$)|(^|[_.\s]){axis}[_.\s]*centroid", re.I)
        found = [n for n in (high, f"{high}_{high}", f"Ctr{high}") if n in names] or [n for n in names if alone.search(n)]
        box = [b for b in ((f"{high}Min", f"{high}Max"), (f"{axis}_min", f"{axis}_max")) if set(b) <= set(names)]
        if found:
            rename(found[0], axis)
        elif box:
            midpoints[axis] = box[-1]
    for new, olds in (*ALIASES.items(), ("cell_id", ID_ALIASES)):
        old = next((o for o in olds if o in names), None)
        if new not in names and old:
            rename(old, new)
    return Renaming(names, midpoints)


@dataclass(frozen=True)
class Centroids:
    """Where x and y come from: one column each, or two whose midpoint they are; with the unit if the names tell it."""

    x: tuple[str, ...]
    y: tuple[str, ...]
    method: str
    unit: str | None = None


def centroids(columns: list[str]) -> Centroids | None:
    """Coordinates for gating, in another order of preference than clean_names(): bounding box, centroids, x and y."""
    if set(COORDINATES[2:6]) <= set(columns):
        return Centroids(("XMin", "XMax"), ("YMin", "YMax"), "bounding box")
    if set(COORDINATES[6:]) <= set(columns):
        return Centroids(("Centroid_X",), ("Centroid_Y",), "centroid columns")
    by_snake: dict[str, str] = {}
    for column, name in zip(columns, snake(columns)):
        by_snake.setdefault(name, column)
    for tail, unit in (("_um", "µm"), ("_px", "px"), ("", None)):
        pair = [by_snake.get(f"centroid_{a}{tail}") for a in "xy"]
        if all(pair):
            return Centroids((pair[0],), (pair[1],), "centroids by unit", unit)
    return Centroids(("x",), ("y",), "x and y") if {"x", "y"} <= set(columns) else None


def guess_xy(columns: list[str]) -> tuple[str, str]:
    """The columns that look most like x and y; the first two columns where none does."""

    def guess(axis: str, default: int) -> str:
        like = re.compile(rf"({axis}|(cell|centroid|coord|pos)[_. ]?{axis}|cell {axis} position)$", re.I)
        return next((c for c in columns if like.match(c)), columns[default])

    return guess("x", 0), guess("y", 1)


def _words(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", name.lower()).strip()


def _core(words: str) -> str:
    gone = {*COMPARTMENTS, *MEASURES, *SPREADS}
    return " ".join(w for w in words.split() if w not in gone)


def intensity_columns(columns: list[str], failed: list[str] = (), nuclear: list[str] | None = None, cytoplasm: bool = False) -> list[str]:
    """The columns to take as expression: those that name both a compartment and a measurement.

    Without nuclear markers: the cell columns, or all if there are none. With them: the nucleus columns of those markers, then for all
    other markers the cytoplasm columns (if asked for and present), the cell columns, or whatever isn't a nucleus column. Failed markers
    go. Markers are found inside names; across compartments only the part that names neither compartment nor measurement counts.
    """
    words = {c: _words(c) for c in columns}
    measured = [c for c in columns if any(m in words[c] for m in MEASURES) and any(k in words[c] for k in COMPARTMENTS)]
    pool = {k: [c for c in measured if k in words[c]] for k in COMPARTMENTS}

    def naming(candidates: list[str], markers: list[str], core: bool) -> set[str]:
        form = (lambda s: _core(s)) if core else (lambda s: s)
        wanted = [m for m in (form(_words(m)) for m in markers) if m]
        return {c for c in candidates if any(m in form(words[c]) for m in wanted)}

    if nuclear is None:
        chosen = pool["cell"] or measured
        gone = naming(chosen, list(failed), core=True)
        return [c for c in chosen if c not in gone]
    inside = naming(pool["nucleus"], nuclear, core=False)
    rest = (cytoplasm and pool["cytoplasm"]) or pool["cell"] or [c for c in measured if c not in pool["nucleus"]]
    gone = naming(rest, [*nuclear, *failed], core=True)
    return list(dict.fromkeys([*(c for c in pool["nucleus"] if c in inside), *(c for c in rest if c not in gone)]))


def legacy_intensity_columns(columns: list[str], failed: list[str] = (), nuclear: list[str] = (), cytoplasm: bool = False, halo: bool = True) -> list[str]:
    """The older choice: HALO names by their ending; other tables' markers are all columns behind the last structural one."""
    if not halo:
        structure = {"label", "x", "y", "size", "x_min", "y_min", "x_max", "y_max"}
        last = max((k for k, c in enumerate(columns) if c.lower() in structure), default=-1)
        return [c for c in columns[last + 1 :] if c not in failed]
    marker = lambda c: re.sub(r"[ .](Cell|Nucleus|Cytoplasm)[ .]Intensity$", "", c)
    ending = lambda kind: [c for c in columns if re.search(rf"[ .]{kind}[ .]Intensity$", c)]
    rest = ending("Cytoplasm") if cytoplasm else ending("Cell")
    chosen = [c for c in ending("Nucleus") if marker(c) in nuclear] + [c for c in rest if marker(c) not in nuclear]
    return [c for c in chosen if marker(c) not in failed]


def markers(columns: list[str]) -> list[str]:
    """Names of markers: of measured columns what is left without compartment and measurement; else all that isn't structure."""
    measured = [c for c in columns if any(k in c.lower() for k in COMPARTMENTS) and any(m in c.lower() for m in MEASURES)]
    if measured:
        bare = (re.sub("|".join((*COMPARTMENTS, *MEASURES)), "", c, flags=re.I) for c in measured)
        found = (re.sub(r"[._ :()]+", "_", re.sub(r"^[._ :()]+|[._ :()]+$", "", c)) for c in bare)
        return list(dict.fromkeys(m for m in found if m not in ("", "_")))
    return [c for c in columns if c.lower() not in NOT_MARKERS and not any(p in c.lower() for p in NOT_IN_MARKERS)]


def nuclear_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if "nucleus" in c.lower() and any(m in c.lower() for m in MEASURES)]


def classifier_column(columns: list[str]) -> str | None:
    return next((c for c in columns if re.fullmatch(r"classifier[._ ]?label", c, re.I)), None)


def numeric_intensity_columns(dtypes: list[tuple[str, str]]) -> list[str]:
    """Numeric columns that name a measurement, coordinates left out; dtypes as a DataFrame gives them."""
    number = ("int", "bigint", "smallint", "tinyint", "float", "double")
    return [c for c, t in dtypes if (t in number or t.startswith("decimal")) and c not in COORDINATES and any(m in c.lower() for m in MEASURES)]


def comparable_columns(tables: list[list[str]]) -> list[str]:
    """The union of several tables' columns, in order of appearance, without bounding boxes, regions and intensities."""
    return [c for c in dict.fromkeys(c for t in tables for c in t) if c not in NOT_COMPARED and "intensity" not in c.lower()]


def shared_selection(selection: list[str], tables: dict[str, list[str]]) -> dict[str, list[str]]:
    """A selection of markers cut to what each sample has."""
    return {sample: [m for m in selection if m in set(own)] for sample, own in tables.items()}


def expression_columns(columns: list[str], patterns: list[str]) -> list[str]:
    """Columns that one pattern matches, or several names: exact ones if there are any, else those that match one. In order of name."""
    exact = [c for c in columns if c in patterns] if len(patterns) > 1 else []
    return sorted(exact or [c for c in columns if any(re.search(p, c) for p in patterns)])


def new_columns(before: list[str], after: list[str]) -> list[str]:
    return [c for c in after if c not in set(before)]


def annotation_name(columns: list[str], base: str = "annotated_clusters") -> str:
    """A name for a new annotation: the base, or the base with the next version."""
    n = sum(base in c for c in columns)
    return base if not n else f"{base}_v{n + 1}"


def latest_annotation(columns: list[str], base: str = "annotated_clusters") -> str | None:
    """The annotation of the highest version; of one version the harmonised form."""
    found = [(int(m[1] or 1), bool(m[2]), c) for c in columns if (m := re.fullmatch(rf"{base}(?:_v(\d+))?(_harmonised)?", c))]
    return max(found)[2] if found else None


def subcluster_name(group: str, resolution: float, clusters: int, names: list[str]) -> str:
    """A column name that tells the resolution, the number of clusters and, by a digest, which of them were split."""
    return f"{group}_subclustered_res{resolution:g}_{clusters}clusters_{hashlib.md5('|'.join(names).encode()).hexdigest()[:8]}"


def prompt_label(label: str) -> str:
    return label.replace("+", "pos").replace("-", "_")


def matrix_label(label: str) -> str:
    return label.replace("+", "pos").replace(" ", ".").replace("-", ".")


def repaired_legacy_names(columns: list[str]) -> list[str]:
    """Names of old exports: where there is a Sample_Name, underscores become spaces and brackets and hyphens come back."""
    if "Sample_Name" not in columns:
        return list(columns)
    names = [re.sub(r"Opal \S*", lambda m: f"({m[0]})", c.replace("_", " ")) for c in columns]
    return [n.replace("Normalized Counts Total Weighting", "(Normalized Counts, Total Weighting)").replace("HLA DR", "HLA-DR") for n in names]


def delimiter_of(path: str) -> str:
    """The delimiter that a file's name tells: tab for .tsv and .tsv.gz."""
    return "\t" if re.search(r"\.tsv(\.gz)?$", path, re.I) else ","
