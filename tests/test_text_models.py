"""Text edits against plain line-by-line models, on random texts."""

import random
import re

from pyspark.sql import functions as F

from tidemark.functions import text

B, E = "# >>> x", "# <<< x"
LINES = [B, E, "a", "", "Key 1", "#Key 2", " # Key\t3", "Keyed 4", f" {B} part", f"{E} part", "swap on", "#swap off", "x\r", "é key"]


def texts():
    pick = random.Random(11)
    out = {""}
    while len(out) < 600:
        body = "\n".join(pick.choice(LINES) for _ in range(pick.randint(1, 9)))
        out.add(body + pick.choice(["", "\n"]))
    return sorted(out)


def lines_of(body):
    """Lines with their ends."""
    return re.findall(r"[^\n]*\n|[^\n]+", body)


def ended(body):
    return body if not body or body.endswith("\n") else body + "\n"


def upsert(body):
    kept, inside = [], False
    for line in lines_of(body):
        if inside:
            inside = E not in line
        elif B in line:
            inside = True
        else:
            kept.append(line)
    return ended("".join(kept)) + f"{B}\nnew $1\n{E}\n"


def replace(body):
    lines = lines_of(body)
    bare = [line.rstrip("\n") for line in lines]
    if B not in bare:
        return ended(body) + f"\n{B}\nnew $1\n{E}\n"
    out, inside = [], False
    for line, plain in zip(lines, bare):
        if plain == B:
            out.append(f"{B}\nnew $1\n")
            inside = True
        elif plain == E:
            out.append(line)
            inside = False
        elif not inside:
            out.append(line)
    return "".join(out)


def set_key(body):
    found = re.compile(r"[ \t\x0b\f\r]*#?[ \t\x0b\f\r]*Key[ \t\x0b\f\r]")
    lines = lines_of(body)
    if not any(found.match(line.rstrip("\n")) for line in lines):
        return ended(body) + "Key yes\n"
    return "".join("Key yes" + line[len(line.rstrip("\n")):] if found.match(line.rstrip("\n")) else line for line in lines)


def comment(body):
    return "".join("#" + line if "swap" in line and not line.startswith("#") else line for line in lines_of(body))


def tail(body):
    lines = [line.rstrip("\n") for line in lines_of(body)][-2:]
    return " ".join(lines).strip(" \t\x0b\f\r\n")


def test_models(spark):
    bodies = texts()
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, t string").cache()

    def after(edited, column="t"):
        return [row[column] for row in edited.orderBy("id").collect()]

    edits = {
        upsert: lambda d: text.block_upsert_tail(d, "t", B, E, "new $1"),
        replace: lambda d: text.block_replace_in_place(d, "t", B, E, F.lit("new $1")),
        set_key: lambda d: text.replace_or_append_kv(d, "t", "Key", "yes"),
        comment: lambda d: text.comment_out_lines(d, "t", "swap"),
    }
    for model, edit in edits.items():
        for body, got in zip(bodies, after(edit(df))):
            assert got == model(body), (model.__name__, body)
    assert after(text.tail_lines(df, "t", 2), "tail") == list(map(tail, bodies))
    # doing an edit again changes nothing
    for model in (upsert, set_key, comment):
        once = edits[model](df)
        assert after(edits[model](once)) == after(once), model.__name__
