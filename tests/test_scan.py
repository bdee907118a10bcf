import random

from tidemark.sources.scan import scan_file_lines, scan_json_variants, scan_lines


def test_positions_across_splits(spark, tmp_path, settings):
    """Files cut into many splits, small ones together in one task: positions as if each was read whole."""
    draw = random.Random(3)
    texts = {f"f{n}": "".join("x" * draw.randrange(60) + draw.choice(["\n", "\n\n", "\r\n"]) for _ in range(draw.choice([3, 40, 900]))) for n in range(9)}
    texts |= {"no-end": "a\nb", "empty": "", "one-end": "\n", "long": "y" * 5000 + "\nz"}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    settings(spark__sql__files__maxPartitionBytes="2000", spark__sql__files__openCostInBytes="10")
    got = scan_file_lines(spark, str(tmp_path))
    rows = [(r.path.rsplit("/", 1)[1].removesuffix(".txt"), r.pos, r.line) for r in got.collect()]
    frame = spark.createDataFrame(list(texts.items()), "path string, text string")
    assert sorted(rows) == sorted(map(tuple, scan_lines(frame, "path", "text").collect()))
    assert len(rows) > 1000


def test_shapes_that_vary(spark):
    docs = [
        (1, '{"a": {"list": [{"n": 1, "s": "x"}, {"n": "2"}, {"n": [3]}, 4, null]}}'),
        (2, '{"a": {"list": []}}'), (3, '{"a": {"list": {"n": 1}}}'), (4, '{"a": 5}'), (5, "[1"), (6, None), (7, ""), (8, "null"),
    ]
    df = spark.createDataFrame(docs, "_item int, _json string")
    found, rejected = scan_json_variants(df, ["_item"], "_json", "$.a.list", {"n": ("$.n", "int"), "s": ("$.s", "string")})
    rows = sorted(map(tuple, found.collect()), key=repr)
    assert rows == sorted([(1, 1, "x"), (1, 2, None), (1, None, None), (1, None, None), (1, None, None)], key=repr)
    reasons = {r._item: r.reason for r in rejected.collect()}
    assert reasons == {3: "no array", 4: "no array", 5: "not JSON", 6: "null", 7: "not JSON", 8: "no array"}
