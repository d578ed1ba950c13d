import corpus_pipeline


def stage(spark, rows):
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    return {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()}


def test_single_lines_go(spark):
    """A footer between other lines, and a text of one line that stands in an earlier text."""
    rows = [(i, f"before {i}\nthe common footer of the site\nafter {i}") for i in range(40)]
    rows += [(50, "the common footer of the site"), (51, "own"), (52, "again\nagain\n\nown last")]
    got = stage(spark, rows)
    assert got[0] == rows[0][1] and all(got[i] == f"before {i}\nafter {i}" for i in range(1, 40))
    assert 50 not in got and got[51] == "own" and got[52] == "again\n\nown last"


def test_ends_of_runs_with_earlier_owners_go(spark):
    lines = [f"line {k} of the run" for k in range(30)]
    rows = []
    for k in range(0, 27, 3):  # any order of the hashes
        a, b, c = lines[k : k + 3]
        rows += [(10 * k, f"{a}\n{b}"), (10 * k + 1, f"{a}\n{b}\n{c}"), (10 * k + 2, f"x {k}\n{a}\n{b}\n{c}\ny {k}")]
    got = stage(spark, rows)
    for k in range(0, 27, 3):
        assert got[10 * k + 1] == lines[k + 2] and got[10 * k + 2] == f"x {k}\ny {k}"
