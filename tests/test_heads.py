"""Objects of which only the head is read."""

from pyspark.sql import functions as F

from cataloom.sources import heads as hd


def folder(tmp_path):
    for name, head, size in [("a.jpg", b"\xff\xd8\xff", 4_000), ("b/c.png", b"\x89PNG\r\n\x1a\n", 5_000_000), ("b/d.jpg", b"\xff\xd8\xff", 100), ("b/e/f.jpg", b"html", 4_000),
                             ("b/e/g.webp", b"RIFF", 4_000), (".hidden.jpg", b"\xff\xd8\xff", 4_000), ("empty", b"", 0), ("big.jpg", b"\xff\xd8\xff", 20_000_000)]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(head + b"0" * (size - len(head)))
    return str(tmp_path)


def names(df):
    return {r.path.rsplit("/", 1)[1] for r in df.collect()}


def test_images_by_their_heads(spark, tmp_path):
    root = folder(tmp_path)
    assert names(hd.read_image_heads(spark, root)) == {"a.jpg", "c.png", "g.webp"}
    assert names(hd.read_image_heads(spark, f"file://{root}", parts=3)) == {"a.jpg", "c.png", "g.webp"}
    every = hd.read_object_heads(spark, root)
    assert {r.path.rsplit("/", 1)[1]: (r.length, r.bytes_read) for r in every.collect()} == {
        "a.jpg": (4_000, 12), "c.png": (5_000_000, 12), "d.jpg": (100, 12), "f.jpg": (4_000, 12), "g.webp": (4_000, 12), "empty": (0, 0), "big.jpg": (20_000_000, 12)}


def test_size_limits_are_pushed_down(spark, tmp_path):
    root = folder(tmp_path)
    reader = hd.HeadReader(root, 1)
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual
    other = [EqualTo(("length",), 5), GreaterThan(("bytes_read",), 3), LessThan(("length",), None)]
    assert list(reader.pushFilters([GreaterThanOrEqual(("length",), 3_000), LessThan(("length",), 9_000_000), GreaterThan(("length",), 100), *other])) == other
    assert (reader.low, reader.high) == (3_000, 8_999_999)
    list(reader.pushFilters([LessThanOrEqual(("length",), 4_000)]))
    opened = [i for p in reader.partitions() for b in reader.read(p) for i in b.column("path").to_pylist()]
    assert sorted(i.rsplit("/", 1)[1] for i in opened) == ["a.jpg", "f.jpg", "g.webp"]
    limited = hd.read_object_heads(spark, root, (3_000, 4_500)).agg(F.sum("bytes_read"), F.count("*")).first()
    assert tuple(limited) == (36, 3)
    plan = hd.read_object_heads(spark, root, (3_000, 4_500))._jdf.queryExecution().executedPlan().toString()
    assert "length" not in "".join(line for line in plan.splitlines() if line.strip(" +-:*()0123456789").startswith("Filter"))


def test_a_task_per_folder_and_part(tmp_path):
    root = folder(tmp_path)
    parts = hd.HeadReader(root, 4).partitions()
    assert len(parts) == 3 * 4
    files = [i for p in parts for b in hd.HeadReader(root, 4).read(p) for i in b.column("path").to_pylist()]
    assert len(files) == len(set(files)) == 7


def test_objects_are_written_once_by_name(spark, tmp_path):
    rows = [("x", b"12"), ("y", b""), ("z", None), (None, b"9"), ("x", b"12")]
    out = hd.write_objects(spark.createDataFrame(rows, "n string, c binary"), str(tmp_path / "o"), "n", "c").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in out) == [("x", 2), ("x", 2), ("y", 0), ("z", 0)]
    assert sorted((f.name, f.read_bytes()) for f in (tmp_path / "o").rglob("*") if f.is_file()) == [("x", b"12"), ("y", b""), ("z", b"")]
