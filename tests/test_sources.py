"""Names, readers and writers on small files in vendors' forms."""

import gzip

import pytest

from cytoloom.operators import labels as L
from cytoloom.sources import names as P
from cytoloom.sources import sinks as K
from cytoloom.sources import tables as T


def test_clean_names():
    halo = P.clean_names(["XMin", "XMax", "YMin", "YMax", "Object Id", "CD3 Cell Intensity", "Cell Area (mm2)"])
    assert halo.names[4:] == ["cell_id", "CD3", "size"] and halo.midpoints == {"x": ("XMin", "XMax"), "y": ("YMin", "YMax")}
    assert P.clean_names(["CellID", "X", "Y", "Z", "Region", "tile_nr", "a:CD4:Cyc_2_ch_1"]).names == ["cell_id", "x", "y", "z", "reg", "tile_num", "CD4"]
    assert P.clean_names(["Centroid_Y_px", "Centroid_X_px", "label"]).names == ["y", "x", "cell_id"]
    assert P.clean_names(["XCentroid", "Y_Centroid"]).names == ["x", "y"]
    assert P.clean_names(["x_min", "x_max", "y_min", "y_max"]).midpoints == {"x": ("x_min", "x_max"), "y": ("y_min", "y_max")}
    assert P.clean_names(["a b", "a.b", "MP1(CD8)", "9"]).names == ["a_b", "a_b_2", "CD8", "x9"]


def test_centroids_for_gating():
    assert P.centroids(["x", "y", "XMin", "XMax", "YMin", "YMax"]).method == "bounding box"
    found = P.centroids(["Centroid X µm", "Centroid Y µm", "Centroid X px", "Centroid Y px"])
    assert (found.x, found.unit) == (("Centroid X µm",), "µm")
    assert P.centroids(["x", "y"]).x == ("x",) and P.centroids(["x"]) is None
    assert P.guess_xy(["id", "Cell X Position", "cell.y"]) == ("Cell X Position", "cell.y") and P.guess_xy(["a", "b"]) == ("a", "b")


COLUMNS = ["Cell: CD3: Mean", "Nucleus: CD3: Mean", "Cytoplasm: CD3: Mean", "Cell: DAPI: Mean", "Nucleus: DAPI: Mean", "Cytoplasm: DAPI: Mean", "Cell Area", "Membrane: CD8: Max"]


def test_intensity_columns():
    assert P.intensity_columns(COLUMNS) == ["Cell: CD3: Mean", "Cell: DAPI: Mean"]
    assert P.intensity_columns(COLUMNS, failed=["CD3"]) == ["Cell: DAPI: Mean"]
    assert P.intensity_columns(COLUMNS, nuclear=["Nucleus__DAPI"]) == ["Nucleus: DAPI: Mean", "Cell: CD3: Mean"]
    assert P.intensity_columns(COLUMNS, nuclear=["Nucleus__DAPI"], cytoplasm=True) == ["Nucleus: DAPI: Mean", "Cytoplasm: CD3: Mean"]
    assert P.intensity_columns(["Nucleus A mean", "Membrane B mean"], nuclear=["A"]) == ["Nucleus A mean", "Membrane B mean"]
    halo = ["CD3 Cell Intensity", "CD3 Nucleus Intensity", "KI67 Nucleus Intensity", "KI67 Cell Intensity"]
    assert P.legacy_intensity_columns(halo, nuclear=["KI67"]) == ["KI67 Nucleus Intensity", "CD3 Cell Intensity"]
    assert P.legacy_intensity_columns(["label", "y", "x", "size", "A", "B"], failed=["B"], halo=False) == ["A"]


def test_markers_and_choices():
    assert P.markers(COLUMNS[:5]) == ["CD3", "DAPI"] and P.nuclear_columns(COLUMNS) == ["Nucleus: CD3: Mean", "Nucleus: DAPI: Mean"]
    assert P.markers(["x", "y", "label", "CD3", "bbox_area", "Euler_Number"]) == ["CD3"]
    assert P.classifier_column(["a", "Classifier Label"]) == "Classifier Label" and P.classifier_column(["a"]) is None
    assert P.numeric_intensity_columns([("a mean", "double"), ("b mean", "string"), ("x", "double")]) == ["a mean"]
    assert P.comparable_columns([["XMin", "a", "CD3 Intensity"], ["b", "a"]]) == ["a", "b"]
    assert P.shared_selection(["a", "b"], {"s": ["b", "c"]}) == {"s": ["b"]}
    assert P.expression_columns(["b", "a", "ax"], ["a"]) == ["a", "ax"] and P.expression_columns(["b", "a", "ax"], ["a", "b"]) == ["a", "b"]
    assert P.new_columns(["a"], ["a", "b"]) == ["b"]


def test_stored_names():
    assert P.resolve("CD3-x", ["CD3.x"]) == "CD3.x" and P.resolve("CD3.x", ["CD3-x"]) == "CD3-x" and P.resolve("q", ["a"]) is None
    assert P.syntactic("1a b") == "X1a.b"
    assert P.annotation_name(["a"]) == "annotated_clusters" and P.annotation_name(["annotated_clusters", "annotated_clusters_v2"]) == "annotated_clusters_v3"
    assert P.latest_annotation(["annotated_clusters", "annotated_clusters_v2", "annotated_clusters_v2_harmonised"]) == "annotated_clusters_v2_harmonised"
    assert P.latest_annotation(["z"]) is None and P.subcluster_name("g", 1.0, 3, ["a", "b"]).startswith("g_subclustered_res1_3clusters_")
    assert P.prompt_label("CD4+-a") == "CD4pos_a" and P.matrix_label("CD4+ T-x") == "CD4pos.T.x"
    assert P.repaired_legacy_names(["Sample_Name", "Opal_520_x", "HLA_DR"]) == ["Sample Name", "(Opal 520) x", "HLA-DR"]


def test_readers_on_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("q;w;e;r;t\n1;2;3;4;5\n6;7\n")
    df = T.read_delimited(spark, f"file://{tmp_path}/a.csv")
    assert df.columns == ["q", "w", "e", "r", "t"] and sorted(map(tuple, df.collect())) == [(1, 2, 3, 4, 5), (6, 7, None, None, None)]
    (tmp_path / "e.csv").write_text("")
    assert list(T.read_samples(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/e.csv"])) == ["a"]
    (tmp_path / "t.tsv.gz").write_bytes(gzip.compress(b"a\ta\n1\tNA\n"))
    assert T.read_by_extension(spark, f"{tmp_path}/t.tsv.gz").columns == ["a", "a_2"]
    (tmp_path / "m.csv").write_text(",a,b\na,1.5,-Inf\nb,Inf,0\n")
    values = {(r["query"], r["ref"]): r["value"] for r in T.read_matrix(spark, f"{tmp_path}/m.csv").collect()}
    assert values == {("a", "a"): 1.5, ("a", "b"): float("-inf"), ("b", "a"): float("inf"), ("b", "b"): 0.0}
    (tmp_path / "l.csv").write_text("Path,Sample_Name,HLA_DR\np,s,1\n")
    assert T.read_legacy(spark, f"{tmp_path}/l.csv").columns == ["Path", "Sample Name", "HLA-DR"]
    for k, head in (("c1", ",T..cell,Sample,x"), ("c2", ",T..cell,Sample,z")):
        (tmp_path / f"{k}.csv").write_text(f"{head}\n1,2,{k},3\n")
    assert T.read_curves(spark, [f"{tmp_path}/c1.csv", f"{tmp_path}/c2.csv"]).columns == ["T cell", "Sample"]


def test_folders_keep_the_newest_file_of_a_name(spark, tmp_path):
    import os

    for k, (folder, value) in enumerate((("one", 1), ("two", 2))):
        (tmp_path / folder).mkdir()
        path = tmp_path / folder / "same.csv"
        path.write_text(f"a,b\n{value},x\n")
        os.utime(path, (1_000_000 + k, 1_000_000 + k))
    assert T.read_folder(spark, f"file://{tmp_path}").count() == 2
    assert [r["a"] for r in T.read_folder(spark, f"file://{tmp_path}", newest_only=True).collect()] == [2]


def test_too_few_common_ids(spark):
    a = spark.createDataFrame([(k, 1.0) for k in range(20)], "i long, v double")
    with pytest.raises(ValueError):
        T.matched_pair(a, a.where("i < 5"))
    with pytest.raises(ValueError):
        L.check_size(a.withColumnRenamed("i", "cell_id"))


def test_score_rows_of_the_newest_file(spark):
    rows = [("s", "c", "A", "c", "B", 1.0, 1), ("s", "c", "A", "c", "B", 3.0, 2), ("s", "c", "A", "c", "C", 5.0, 1)]
    names = ["Sample Name", "First Cell Compartment", "First Stain Component", "Second Cell Compartment", "Second Stain Component", "A Threshold", "changed"]
    scores = spark.createDataFrame(rows, names)
    assert sorted(r["A Threshold"] for r in T.newest_scores(scores).collect()) == [3.0, 5.0]
    stains, means, differ = T.score_tables(scores)
    assert stains.count() == 3 and means.first()["A Threshold"] == 3.0 and differ.first()["A Threshold"]


def test_provenance_tells_changed_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a\n1\n")
    files = K.file_records(spark, f"file://{tmp_path}", "*.csv")
    record = spark.createDataFrame(K.provenance(files, files, {"radius": "25"}, {}, "t0", "t1").collect())
    assert K.changed_files(record, K.file_records(spark, f"file://{tmp_path}", "*.csv")).count() == 0
    (tmp_path / "in.csv").write_text("a\n2\n")
    assert [r["name"] for r in K.changed_files(record, K.file_records(spark, f"file://{tmp_path}", "*.csv")).collect()] == ["in.csv"]


def test_mask_columns():
    columns = ["cluster_leiden_res1_clust3", "cluster_leiden_res1.5_clust9", "cluster_leiden_res12_clust40"]
    assert K.mask_column(columns, 5) == columns[0] and K.mask_column(columns, 12) == columns[2] and K.mask_column(["a"], 5) is None
    assert K.mask_markers(["CD3_Nucleus", "CD3_Cytoplasm", "CD8"], ["CD8"]) == ["CD3"]


def test_replies():
    assert L.map_from_reply('```json\n{"a": "B", "c": null}\n```') == {"a": "B"} and L.map_from_reply("none") == {} and L.map_from_reply("{broken") == {}


def test_binary_kinds_of_text(spark):
    from cytoloom.operators import compare as C

    rows = [("Yes", "a", k, None) for k in range(12)] + [("no", "b", 3, None)]
    got = {r["column"]: r["kind"] for r in C.column_kinds(spark.createDataFrame(rows, "yn string, t string, n int, none string"), ["yn", "t", "n", "none"]).collect()}
    assert got == {"yn": "binary", "t": "categorical", "n": "continuous", "none": "binary"}
