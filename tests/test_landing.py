"""SO6: templates landed by URI, in rounds."""

import os

from pliego.sources.landing import fresh_templates, land_requested, landed

T0, T1, T3 = "2024-02-01 08:00:00", "2024-02-01 09:59:59", "2024-02-01 10:30:00"


def put(root, path, data):
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    with open(f"{root}/{path}", "wb") as f:
        f.write(data)


def ask(spark, *uris):
    return spark.createDataFrame([(u,) for u in uris], "template_path string")


def served(spark, store, at):
    return {r.uri: r.content for r in fresh_templates(spark, store, at).collect()}


def test_rounds_over_changing_roots(spark, tmp_path):
    a, b, store = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "landed")
    put(a, "s3/v1/x.html", b"x of a")
    put(a, "fs/srv/y.html", "caf\xe9".encode("latin-1"))
    put(b, "s3/v1/x.html", b"x of b")
    put(b, "s3/v1/z.html", b"z of b")
    put(str(tmp_path), "secret", b"outside")
    roots = lambda r: {"s3@": f"{r}/s3", "fs@": f"{r}/fs"}
    x, y, z = "s3@bucket:v1/x.html", "fs@/srv/y.html", "s3@bucket:v1/z.html"
    odd = ["s3@nocolon", "ftp@host/x", "http@h/x.html", "fs@/../../secret", "orden.html", "", None]
    land_requested(ask(spark, x, x, y, z, *odd), store, roots(a), T0)
    assert served(spark, store, T0) == {x: "x of a", y: "caf�"}
    errors = {r.uri: r.error for r in landed(spark, store).where("error IS NOT NULL").collect()}
    assert errors[z] == "Template not found: Failed to download template: The specified key does not exist. " + z
    assert errors["s3@nocolon"].endswith("Invalid S3 URI format: s3@nocolon") and "No downloader found" in errors["ftp@host/x"]
    assert "No landed root" in errors["http@h/x.html"] and ".." in errors["fs@/../../secret"] and len(errors) == 5
    # A fresh copy is neither read again nor replaced; a failed one is tried again.
    land_requested(ask(spark, x, y, z), store, roots(b), T1)
    assert served(spark, store, T1) == {x: "x of a", y: "caf�", z: "z of b"}
    assert sorted(r.uri for r in landed(spark, store).where(f"fetched_at = '{T1}'").collect()) == [z]
    # Past the TTL the first copies are gone: one is there anew, one is not.
    land_requested(ask(spark, x, y, z), store, roots(b), T3)
    assert served(spark, store, T3) == {x: "x of b", z: "z of b"}
    assert served(spark, store, T0) == {x: "x of a", y: "caf�"}


def test_only_hours_within_the_ttl_are_read(spark, tmp_path):
    store = str(tmp_path / "landed")
    put(str(tmp_path), "fs/t.html", b"t")
    for day in range(1, 4):
        land_requested(ask(spark, "fs@/t.html"), store, {"fs@": str(tmp_path / "fs")}, f"2024-02-0{day} 08:00:00")
    df = fresh_templates(spark, store, "2024-02-03 09:00:00")
    assert df.count() == 1 and len(df.inputFiles()) == 3
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(hour" in plan
    assert fresh_templates(spark, str(tmp_path / "none"), "2024-02-03 09:00:00").count() == 0
