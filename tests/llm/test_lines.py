import random

import pytest

from focuslake.llm.lines import dedup_lines


def brute(rows, least=50):
    """What is left of each text, from all smallest runs in order of documents."""
    docs = {}
    for i, t in rows:
        docs[i, t] = [(n, l) for n, l in enumerate((t or "").split("\n")) if l.split()]
    runs = []
    for key, lines in docs.items():
        count = [len(l.split()) for _, l in lines]
        spans = set()
        for a in range(len(lines)):
            z = next((z for z in range(a, len(lines)) if sum(count[a:z + 1]) >= least), None)
            if z is not None:
                spans.add((a, z))
            b = next((b for b in range(a, -1, -1) if sum(count[b:a + 1]) >= least), None)
            if b is not None:
                spans.add((b, a))
        runs += [(key, a, z, tuple(" ".join(l.split()) for _, l in lines[a:z + 1])) for a, z in spans]
    order = lambda r: ((r[0][0] is not None, r[0][0] or 0), r[1], r[2])
    first, gone = {}, {k: set() for k in docs}
    for r in sorted(runs, key=order):
        origin = first.setdefault(r[3], r)
        if origin is not r and not (origin[0] == r[0] and r[1] <= origin[2]):
            gone[r[0]] |= {docs[r[0]][n][0] for n in range(r[1], r[2] + 1)}
    return {k: "\n".join(l for n, l in enumerate((k[1] or "").split("\n")) if n not in gone[k]) for k in docs}


@pytest.mark.parametrize("least", [50, 7])
def test_equals_brute_force(spark, documents, prose, tmp_path, least):
    r, pool = random.Random(least), [prose(k, k) for k in (1, 2, 3, 5, 8, 13, 30, 60)]
    rows = [(i, "\n".join(r.choice(pool + ["", " "]) for _ in range(r.randrange(30)))) for i in range(40)]
    rows += [(50, pool[7]), (51, "x\n  " + pool[7].replace(" ", "\t ") + "\ny"), (52, "\n".join([pool[3]] * 60)), (None, pool[7] + "\nz")]
    got = {r.doc_id: r.text for r in dedup_lines(documents(rows), least, str(tmp_path / "l")).collect()}
    assert got == {i: t for (i, _), t in brute(rows, least).items()}


def test_odd_rows(spark, documents, odd, tmp_path):
    rows = dedup_lines(documents(odd, extra=True), folder=str(tmp_path / "l"))
    assert rows.columns.count("removed") == 1 and "odd name" in rows.columns
    assert {(r["_spans"], r["_hash"], r["_id"], r["_text_hash"], r["in_0"]) for r in rows.collect()} == {(7, 7, 7, 7, 7)}
    got = rows.collect()
    assert len(got) == len(odd)
    assert sorted(len(r.text or "") for r in got if r.doc_id == 2) == [0, 0]   # repeated rows are cleaned alike
    assert [r.text for r in got if r.doc_id == 3] == [None] and [r.removed for r in got if r.doc_id == 4] == [[]]


def test_empty_table(spark, documents, tmp_path):
    assert dedup_lines(documents([]), folder=str(tmp_path / "l")).collect() == []
