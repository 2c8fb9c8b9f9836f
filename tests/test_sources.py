"""Readers on awkward files: indented, cut short, quoted line breaks, unknown flags, empty folders."""

import json

import pytest
from pyspark.sql import functions as F

from mediaquery.sources import tables


def put(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name).write_bytes(text.encode() if isinstance(text, str) else text)
    return f"file://{folder}"


def candidate(i):
    return {"candidate_id": f"c{i}", "video_id": "v", "event": "e", "scores": {"aesthetic": 0.5}, "extra": [1]}


def test_pools(spark, tmp_path):
    pool = {"category": "beauty", "candidates": [candidate(1), candidate(2)]}
    path = put(tmp_path / "pools", {
        "flat.json": json.dumps(pool), "indented.json": json.dumps(pool, indent=2) + "\n", "bom.json": "\ufeff" + json.dumps(pool, indent=1), "cut.json": json.dumps(pool, indent=2)[:90],
        "list.json": json.dumps([pool]), "empty.json": "", "none.json": json.dumps({"category": "x", "candidates": []}), "bare.json": json.dumps({"candidates": [candidate(9)]}),
        "other.json": json.dumps({"category": "x", "candidates": "text"}), "text.json": "not json", "number.json": "17"})
    put(tmp_path / "pools" / "deeper", {"low.json": json.dumps(pool, indent=4)})
    rows = tables.scan_candidate_pool(spark, path, "fallback").select("source_file", "category", "candidate_id", "error").collect()
    got = {}
    for name, *rest in map(tuple, rows):
        got.setdefault(name, []).append(tuple(rest))
    whole = [("beauty", "c1", None), ("beauty", "c2", None)]
    bad = [("fallback", None, "not a JSON object")]
    assert got == {"flat.json": whole, "indented.json": whole, "bom.json": whole, "low.json": whole, "bare.json": [("fallback", "c9", None)],
                   **{n: bad for n in ("cut.json", "list.json", "text.json", "number.json")}, "other.json": [("x", None, "candidates: not a list of objects")], **({"empty.json": bad} if "empty.json" in got else {})}
    docs = {r["video_id"]: (r["valid"], r["candidates"], r["error"]) for r in tables.scan_analysis_documents(spark, path, "video_id string, candidates array<struct<candidate_id: string>>").withColumn("candidates", F.array_size("candidates")).collect()}
    assert docs["indented"] == (True, 2, None) and docs["cut"] == (False, None, "not a JSON object") and docs["none"] == (True, 0, None)


def test_document_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "line\nbreak \"q\" 漢"), ("b", None, "")], "name string, n int, t string")
    tables.write_document_files(rows, f"file://{tmp_path}/docs", "name")
    files = sorted((tmp_path / "docs").glob("name=*/*.txt"))
    assert [json.loads(f.read_text()) for f in files] == [{"n": 1, "t": "line\nbreak \"q\" 漢"}, {"n": None, "t": ""}] and files[0].read_text().count("\n") > 2
    back = tables.scan_analysis_documents(spark, f"file://{tmp_path}/docs", "n int, t string, video_id string")
    assert sorted((r["n"] or 0, r["t"], r["valid"]) for r in back.collect()) == [(0, "", True), (1, "line\nbreak \"q\" 漢", True)]


def test_manifest(spark, tmp_path):
    head = "video_id,path,category,enabled,ignored\n"
    path = put(tmp_path / "m", {
        "one.csv": "\ufeff" + head + '1,"/a\nb ""q"", c.mp4",x,TRUE,z\n2,/b,y,maybe,\n3,/c,y,,\n,/d,y,no,\n5,/e,,off,\n', "two.csv": head + "6,/f,漢,1,\n7,/g\n"})
    got = {r["path"]: (r["video_id"], r["category"], r["note_id"], r["enabled"], r["source_file"], r["error"]) for r in tables.scan_manifest(spark, path).collect()}
    assert got == {
        '/a\nb "q", c.mp4': ("1", "x", "", True, "one.csv", None), "/b": ("2", "y", "", None, "one.csv", "enabled: not a flag: maybe"), "/c": ("3", "y", "", None, "one.csv", "enabled: not a flag: "),
        "/d": (None, "y", "", False, "one.csv", "video_id: missing"), "/e": ("5", None, "", False, "one.csv", "category: missing"), "/f": ("6", "漢", "", True, "two.csv", None),
        "/g": ("7", None, "", None, "two.csv", "category: missing; enabled: not a flag: ")}
    with pytest.raises(Exception, match="bad manifest row in .*csv"):
        tables.scan_manifest(spark, path, mode="strict").collect()
    plain = put(tmp_path / "p", {"m.csv": "category,video_id,path\nx,1,/a\n"})
    assert [tuple(r)[:6] for r in tables.scan_manifest(spark, plain, mode="strict").collect()] == [("1", "/a", "x", "", "", True)]
    with pytest.raises(ValueError):
        tables.scan_manifest(spark, plain, mode="lenient")
