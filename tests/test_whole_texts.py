from cairnset.plans import catalogue


def test_text_operators_reach_the_end_of_each_document(spark, tmp_path):
    body = "# One\n" + "x" * 200 + "\n## Two\nplain"
    texts = {1: body + '\x1b[1m_%\\"&lt;\0', 2: "", 3: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    got = lambda name, c: {r.doc_id: r[c] for r in run(name)}
    assert got("fn_strip_ansi", "clean") == {1: body + '_%\\"&lt;', 2: "", 3: None}
    # The escaped text's ampersands come back first, so what they make an entity of comes back with them.
    assert got("fn_html_unescape", "plain") == {1: body + '\x1b[1m_%\\"<\0', 2: "", 3: None}
    assert got("fn_escape_like", "escaped") == {1: body + '\x1b[1m\\_\\%\\\\"&lt;\0', 2: "", 3: None}
    assert got("fts_quote", "quoted") == {1: body + '\x1b[1m_%\\""&lt;', 2: "", 3: None}
    lines = sorted((r.doc_id, r.line or "", r.title) for r in run("fn_atx_heading") if r.doc_id != 1 or r.title is not None)
    assert lines == [(1, "# One", "One"), (1, "## Two", "Two"), (2, "", None), (3, "", None)]
    assert sum(r.doc_id == 1 for r in run("fn_atx_heading")) == 4


def test_commit_messages_are_read_in_every_spelling_of_their_source(spark, tmp_path):
    sources = ["commit_messages", "COMMIT_MESSAGES ", "commit-messages", "Commit  Messages", "\tcommit_messages", "commits", None]
    spark.createDataFrame([(i, s, "fix: a\n\nb") for i, s in enumerate(sources)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("src_git_log", "fn_routine_subject", "fn_failure_subject"):
        assert sorted(r.doc_id for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 4], name
    batches = catalogue.QUERIES["fn_llm_batches"](spark, str(tmp_path))
    assert sorted(r.doc_id for r in batches.collect()) == [0, 1, 2, 3, 4]
