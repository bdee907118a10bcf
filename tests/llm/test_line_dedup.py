import itertools
import random

from tidemark.llm.line_dedup import drop_lines, repeated_lines
from tidemark.operators import spread


def distance_at_most_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def brute(docs, near):
    seen, out = [], {}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0]))
    lines = [((key, pos), line) for key, text in order for pos, line in enumerate((text or "").split("\n")) if line.strip(" \t\r\x0b\x0c")]
    for place, line in lines:
        equal = [p for p, other in seen if other == line]
        close = [p for p, other in seen if other != line and min(len(line), len(other)) >= near and distance_at_most_one(line, other)]
        if equal:
            out[place] = (*equal[0], 0)
        elif close:
            out[place] = (*close[0], 1)
        seen.append((place, line))
    return out


def noisy(draw, line):
    at, kind = draw.randrange(len(line) + 1), draw.randrange(4)
    char = draw.choice("abcdé漢")
    if kind == 0:
        return line
    return line[:at] + (char if kind < 3 else "") + line[at + (kind > 1) :]


def check(spark, docs, near, monkeypatch):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, near)
    for bound in (spread.BROADCAST_ROWS, 0):
        monkeypatch.setattr(spread, "BROADCAST_ROWS", bound)
        rows = repeated_lines(df, "doc_id", "text", near).collect()
        assert {(r.doc_id, r.pos): (r.keep_key, r.keep_pos, r.edits) for r in rows} == want
        assert len(rows) == len(want)


def test_like_brute_force(spark, monkeypatch):
    draw = random.Random(4)
    bases = ["".join(draw.choice("abcd é") for _ in range(draw.randrange(3, 14))) for _ in range(12)]
    docs = [(i, "\n".join(noisy(draw, draw.choice(bases)) for _ in range(6))) for i in range(20)]
    docs += [(100, "aaaaaaaa\naaaaaaa\naaaaaaaaa"), (101, "aaabaaaa\n \t\n\naaabaaaa"), (None, "aaaaaaaa"), (102, None), (103, "")]
    check(spark, docs, 5, monkeypatch)


def test_lengths_around_block_sizes(spark, monkeypatch):
    """Edits at the first and last places of blocks, and lines whose neighbours have blocks of another size."""
    draw = random.Random(5)
    docs = []
    for length in (5, 8, 9, 10, 16, 17, 25, 26, 63, 64, 65):
        line = "".join(draw.choice("ab漢") for _ in range(length))
        docs.append((len(docs), line))
        for at in range(length):
            edited = [line[:at] + "é" + line[at:], line[:at] + line[at + 1 :], line[:at] + "é" + line[at + 1 :], line + "é"]
            docs.append((len(docs), draw.choice(edited)))
    check(spark, docs, 5, monkeypatch)


def test_very_long_lines(spark):
    """Work does not grow with the square of the length."""
    draw = random.Random(6)
    line = "".join(draw.choices("abcdefgh ", k=300_000))
    docs = [(1, line), (2, line[:123_456] + line[123_457:]), (3, line[:250_000] + "x" + line[250_001:]), (4, line + "yy")]
    rows = repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    assert {(r.doc_id, r.keep_key, r.edits) for r in rows} == {(2, 1, 1), (3, 1, 1)}


def test_one_line_everywhere(spark):
    """Many lines around one variant are compared with the earliest, not with each other."""
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('the same line for all but a sign: ', char(int(48 + id % 60))) as text")
    rows = repeated_lines(docs, "doc_id", "text").collect()
    assert len(rows) == 1999
    assert {(r.keep_key, r.edits) for r in rows if r.doc_id < 60} == {(0, 1)}
    assert {r.edits for r in rows if r.doc_id >= 60} == {0}


def test_awkward(awkward):
    removed = repeated_lines(awkward, "doc_id", "text")
    assert {(r.doc_id, r.keep_key, r.edits) for r in removed.collect()} == {(6, 5, 0)}  # rows that repeat a key are one document
    kept = drop_lines(awkward, "doc_id", "text", removed)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert [r.text for r in kept.where("doc_id = 6").collect()] == [""]
    assert repeated_lines(awkward.where("false"), "doc_id", "text").count() == 0


def test_drop_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb\na\n\nc", "x"), (2, "b\nd", "y"), (None, None, "z")], "doc_id long, text string, pos string")
    kept = drop_lines(docs, "doc_id", "text", repeated_lines(docs, "doc_id", "text"))
    assert {(r.doc_id, r.text, r.pos) for r in kept.collect()} == {(1, "a\nb\n\nc", "x"), (2, "d", "y"), (None, None, "z")}


def test_distance():
    words = ["".join(w) for n in range(4) for w in itertools.product("ab", repeat=n)]
    assert distance_at_most_one("ab", "b") and not distance_at_most_one("ab", "ba")
    assert all(distance_at_most_one(a, b) == distance_at_most_one(b, a) for a in words for b in words)
