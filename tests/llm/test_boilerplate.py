import random
import re
from collections import defaultdict

from tideline.llm import boilerplate as B

SCHEMA = "citation_id bigint, text string, source_file string, line string, node string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "l", "n") for r in rows], SCHEMA)


def _norm(line):
    return re.sub("[0-9]+", "0", re.sub(r"\s+", " ", line.lower()).strip())


def _brute(rows):
    files, stands = defaultdict(set), defaultdict(set)
    for _, text, f in rows:
        if not (f or "").strip():
            continue
        h = f.lower().split("/")[0]
        files[h].add(f.lower())
        for line in (text or "").split("\n"):
            if _norm(line):
                stands[h, _norm(line)].add(f.lower())
    bad = {k for k, v in stands.items() if len(v) >= 5 and 100 * len(v) >= 8 * len(files[k[0]])}
    return {(i, n) for i, t, f in rows if (f or "").strip() for n, x in enumerate((t or "").split("\n")) if (f.lower().split("/")[0], _norm(x)) in bad}


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        house = "big" if rng.random() < 0.6 else f"House{rng.randrange(4)}"
        parts = [rng.choice(["Page 1 of 20", "page  3 of 7 ", "All rights reserved", "全部内容 仅供参考", "", "   "]) for _ in range(rng.randrange(3))]
        parts += [f"unique {rng.random()} {i} words x{rng.choice('abc')}" for _ in range(rng.randrange(3))]
        rng.shuffle(parts)
        name = rng.choice([house, house.upper()]) + f"/f{rng.randrange(80)}.pdf"
        rows.append((i, rng.choice(["\n", "\r\n"]).join(parts) or None, rng.choice([name] * 9 + [None, " "])))
    got = {tuple(r) for r in B.excessive_lines(_frame(spark, rows)).collect()}
    assert got == _brute(rows) and got


def test_threshold_counts_empty_files(spark):
    rows = [(i, "notice 12", f"h/{i}.pdf") for i in range(5)] + [(100 + i, None, f"H/e{i}.pdf") for i in range(58)]
    assert B.excessive_lines(_frame(spark, rows)).count() == 0  # 5 of 63 is under 8 %
    assert B.excessive_lines(_frame(spark, rows[:-1])).count() == 5  # 5 of 62 is over


def test_cleaned_keeps_line_ends(spark):
    rows = [(i, f"keep {'x' * i}\r\nNotice {i}\r\nend {'y' * i}", f"h/{i}.pdf") for i in range(5)] + [(9, None, None)]
    got = {r.citation_id: r.text for r in B.cleaned(_frame(spark, rows)).collect()}
    assert got[2] == "keep xx\r\nend yy" and got[9] is None and len(got) == 6


def test_empty(spark):
    assert B.excessive_lines(_frame(spark, []).limit(0)).count() == 0


def test_many_templates_meet_in_a_join(spark):
    rows = [(i, f"keep {'x' * i}\nNotice {i}\nall 5% rights {i}.{i}", f"h/{i % 7}.pdf") for i in range(90)]
    want = {tuple(r) for r in B.excessive_lines(_frame(spark, rows)).collect()}
    assert {tuple(r) for r in B.excessive_lines(_frame(spark, rows), max_shipped=0).collect()} == want and len(want) == 180


def test_tree():
    t = B.Tree()
    for file, line in ((1, "page 1 of 20"), (2, "page 17 of 3"), (2, "page 4 of 5"), (1, "page one of 20"), (3, "a"), (3, "in 2024 q1 rose 5% again")):
        t.add("h", file, line)
    got = {(n, *path): leaf for _, n, path, leaf in t.leaves()}
    assert got == {
        (4, "page", "0", "of"): {("0",): {1: 1, 2: 2}}, (4, "page", "one", "of"): {("0",): {1: 1}}, (1, "a"): {(): {3: 1}},
        (6, "in", "0", "q0"): {("rose", "0%", "again"): {3: 1}}}


def test_trees_are_handed_on(spark, monkeypatch):
    """Trees that are grown anew within a partition merge to the same."""
    rows = [(i, "Notice 12\nown line", f"h/{i}.pdf") for i in range(40)]
    import pyarrow as pa

    monkeypatch.setattr(B, "GROWN", 3)
    one = [pa.RecordBatch.from_pydict({"house": ["h"], "file": pa.array([i], pa.int64()), "text": ["notice 12\nown line"]}) for i in range(9)]
    out = [r for b in B._grow(iter(one)) for r in b.to_pylist()]
    assert len(out) == 18 and {r["file"] for r in out} == set(range(9)) and len({r["template"] for r in out}) == 2
    assert B.excessive_lines(_frame(spark, rows)).count() == 80
