"""Line dedup against plain Python, with lines on both sides of the threshold."""

import pytest

from cuestream.llm import line_dedup as L


def brute(rows, least):
    sites, first = {}, {}
    for d, t, s in rows:
        for i, line in enumerate((t or "").split("\n") if d is not None else []):
            if line.strip(" \t\n\x0b\f\r"):
                sites.setdefault(line, set()).update({s} - {None})
                first[line] = min(first.get(line, (d, i)), (d, i))
    gone = lambda d, i, line: d is not None and len(sites.get(line, ())) >= least and first[line] != (d, i)
    return sorted(
        (str(d), None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not gone(d, i, x))) for d, t, _ in rows
    )


@pytest.mark.parametrize("least", [2, 10, 40])
def test_lines_match_plain_python(spark, least):
    rows = []
    for i in range(150):
        lines = [f"own {i}"] + [f"on {n}" for n in (2, 8, 9, 10, 11, 12, 39, 40, 41, 60, 100) if i < n] + ["", " "]
        rows.append((i, "\n".join(lines + (["on 60"] if i % 9 == 0 else [])), f"site{i}"))
    rows += [(300 + i, "one site only\nsame", "site0") for i in range(30)]
    rows += [(400, None, "a"), (401, "", None), (402, "on 100\non 100", None), (5, rows[5][1], "site5"), (None, "on 100", "b"), (403, "w\n" * 20000 + "on 100", "c")]
    docs = spark.createDataFrame([(d, t, s, 1, "p") for d, t, s in rows], "doc_id long, text string, source string, first int, places string")
    out = L.clean(docs, min_sites=least)
    assert out.columns == docs.columns
    assert sorted(((str(r.doc_id), r.text) for r in out.collect()), key=str) == sorted(brute(rows, least), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert L.clean(docs).count() == 0


def test_rows_that_share_an_id_lose_their_own_lines_only(spark):
    rows = [(3, "own 3\nboiler", "s0"), (3, "different first\nprecious own line", "s1")]
    rows += [(k, f"boiler\nline of {k}", f"s{k}") for k in range(1, 20) if k != 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(r.text for r in L.clean(docs).filter("doc_id = 3").collect())
    assert got == ["different first\nprecious own line", "own 3"]
