import json
import zipfile

import pytest
from pyspark.sql import functions as F

from cairnset.engine import Engine
from cairnset.sources import documents, files


@pytest.fixture()
def project(tmp_path):
    root = tmp_path / "project"
    (root / "src").mkdir(parents=True)
    (root / "node_modules/x").mkdir(parents=True)
    (root / "src/main.rs").write_text("fn main() {\n    helper_one();\n}\n\nfn helper_one() {\n    other_call();\n}\n")
    (root / "src/util.py").write_text("def stale_cache(key):\n    return lookup_table(key)\n")
    (root / "README.md").write_text("intro\n\n# Cache\nThe stale cache is dropped.\n\n## Next\nmore\n")
    (root / "node_modules/x/a.js").write_text("skip()")
    (root / ".env").write_text("SECRET=1")
    (root / "key.pem").write_text("x")
    (root / "bin.c").write_bytes(b"int\0x")
    return root


def test_index_search_and_incremental_update(spark, project, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    assert {r.change: r.files for r in e.index(str(project)).collect()} == {"new": 3}
    assert [r.path for r in e.ls_files().collect()] == ["README.md", "src/main.rs", "src/util.py"]
    hits = e.search("stale cache").collect()
    assert {h.path for h in hits} == {"README.md", "src/util.py"}
    assert e.search("!!! ''").count() == 0 and e.search("").count() == 0
    assert {r.target_name for r in e.graph("stale_cache", "calls").collect()} == {"lookup_table"}
    assert e.status().first().files == 3 and e.cat_chunks("readme.md").count() == 3
    (project / "src/util.py").write_text("def fresh():\n    pass\n")
    (project / "README.md").unlink()
    assert {r.change: r.files for r in e.index(str(project)).collect()} == {"changed": 1, "removed": 1, "unchanged": 1}
    assert e.search("stale").count() == 0 and e.search("fresh").first().path == "src/util.py"
    assert {r.language for r in e.languages().collect()} == {"rust", "python"}


def test_memory_commands(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    rows = [(1, "decision", "Use parquet", "the final page wins", ["a"], [], 100, "active"), (2, "note", "Other", "nothing", [], [], 200, "active"),
            (3, "decision", "Use parquet", "the final page wins", ["b", "a"], ["f"], 300, "active")]
    e.memory.add(spark.createDataFrame(rows, "id long, kind string, title string, body string, tags array<string>, linked_files array<string>, created_at long, status string"))
    got = {r.id: r for r in e.memory.list().collect()}
    assert set(got) == {1, 2} and got[1].tags == ["a", "b"] and got[1].linked_files == ["f"]
    assert [r.id for r in e.memory.search("final page").collect()] == [1] and e.memory.search("page final").count() == 0
    e.memory.supersede(spark.createDataFrame([(1, 2)], "id long, new_id long"), now=1000)
    assert [r.id for r in e.memory.list().collect()] == [2]
    assert [r.id for r in e.memory.list(as_of="1970-01-01T00:05").collect()] == [2, 1]
    assert [r.id for r in e.memory.list(as_of="1970-01-01T00:20").collect()] == [2]
    assert [(r.direction, r.other, r.title) for r in e.memory.graph(2).collect()] == [("out", 1, "Use parquet")]
    with pytest.raises(ValueError):
        e.memory.list(as_of="yesterday")
    log = tmp_path / "log.jsonl"
    note = {"schema_version": 1, "id": 9, "kind": "note", "title": "From log", "body": "b", "created_at": 5, "status": "active", "tags": ["z"]}
    log.write_text("\n".join([json.dumps(note), "", "[1]", "{broken", json.dumps(note | {"id": 10, "created_at": 7, "tags": ["y"], "status": "archived"})]))
    assert e.memory.import_log(str(log)).first().imported == 1
    new = e.table("notes").where("title = 'From log'").first()
    assert (new.id, new.created_at, new.tags, new.status) == (9, 5, ["y", "z"], "archived")
    assert e.memory.import_log(str(log)).first().imported == 0
    done = {r.kind: (r.n, r.verified) for r in e.export(str(tmp_path / "dump")).collect()}
    assert done == {"note": (3, True), "relationship": (1, True)}


def test_ignore_rules(spark):
    patterns = files.DEFAULT_EXCLUDES + ["!keep.min.js", "docs/*.txt", "/only.py", "!vendor/x.py", "build", "!build/"]
    own = [("", ["*.log"]), ("sub/", ["!keep.log", "/here", "a/*.c"]), ("sub/deep/", ["keep.log"])]

    def decide(path):
        return spark.createDataFrame([(path,)], "p string").select(files.decide(F.col("p"), patterns, own)).first()[0]

    assert decide("vendor/x.py") == "vendor/" and decide("build/a.py") == "keep" and decide("a/build") == "build"
    assert decide("x.log") == "*.log" and decide("sub/keep.log") == "keep" and decide("keep.log") == "*.log" and decide("sub/deep/keep.log") == "keep.log"
    assert decide("sub/here/y.py") == "/here" and decide("sub/a/b.c") == "a/*.c" and decide("other/here/y.py") == "keep" and decide("a/b.c") == "keep"
    assert decide("a/b/x.min.js") == "*.min.js" and decide("a/keep.min.js") == "keep"
    assert decide("web/vendor/lib/x.js") == "vendor/" and decide("src/vendors/x.js") == "keep"
    assert decide("a/locales/de/x.json") == "**/locales/**/*.json" and decide("docs/a.txt") == "docs/*.txt" and decide("docs/sub/a.txt") == "keep"
    assert decide("only.py") == "/only.py" and decide("sub/only.py") == "keep"


def test_ignore_files_of_a_tree(spark, tmp_path):
    for name, text in {".gitignore": "*.tmp.py\nout/\n# no rule\n", "a.py": "x = 1\n", "b.tmp.py": "x", "out/c.py": "x", "sub/.gitignore": "!d.tmp.py\n", "sub/d.tmp.py": "y = 2\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert files.tree_rules(spark, str(tmp_path)) == [("", ["*.tmp.py", "out/", "# no rule"]), ("sub/", ["!d.tmp.py"])]
    assert {r.path for r in files.read_tree(spark, str(tmp_path)).collect()} == {"a.py", "sub/d.tmp.py"}


def test_office_documents(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", "<w:d xmlns:w='u'><w:p><w:t>one</w:t></w:p><w:p/><w:p><w:t>two</w:t><w:t> three</w:t></w:p></w:d>")
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", "<w><sheet name='S'/></w>")
        z.writestr("xl/sharedStrings.xml", "<s><si><t>hi</t></si></s>")
        z.writestr("xl/worksheets/sheet1.xml", "<w>" + "".join(f"<row><c t='s'><v>0</v></c><c><v>{i}</v></c></row>" for i in range(130)) + "</w>")
    (tmp_path / "c.docx").write_bytes(b"broken")
    got = {(r.name, r.content.split("\n")[0]) for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {(None, "one"), ("S (rows 1–120)", "hi\t0"), ("S (rows 121–130)", "hi\t120")}


def test_newer_log_is_an_error(spark):
    from cairnset.sources import export

    lines = spark.createDataFrame([('{"schema_version": 2, "id": 1}',)], "value string")
    with pytest.raises(Exception, match="newer"):
        export.read_log(lines).select(F.max("schema_version")).collect()


def test_a_write_that_fails_leaves_the_table(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    files_ = lambda n: spark.createDataFrame([(i, f"f{i}", None, "h", 0, 0) for i in range(n)], "file_id long, path string, language string, hash string, indexed_at long, mtime long")
    for n in (1, 2, 3, 4):
        e.save("files", e.table("files").where("false").unionByName(files_(n)))
        assert e.table("files").count() == n
    with pytest.raises(Exception):
        e.save("files", files_(9).withColumn("path", F.raise_error(F.lit("broken"))))
    assert e.table("files").count() == 4
    e.save("files", files_(5))
    assert e.table("files").count() == 5 and sorted(p.name for p in (tmp_path / "store" / "files").iterdir() if p.is_dir()) == ["v4", "v5"]
