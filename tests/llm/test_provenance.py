import random

import numpy as np

from cairnset.llm import provenance as R
from cairnset.llm import tokens as K

rng = random.Random(3)


def code(n, seed):
    r = random.Random(seed)
    names = [f"{a}_{b}" for a in ("scan", "fold", "merge", "route", "queue") for b in ("token", "shard", "lease", "cache")]
    return "\n".join(f"def {r.choice(names)}({r.choice(names)}):\n    return {r.choice(names)} + {r.randrange(400)}\n" for _ in range(n))


def test_shared_runs_share_a_fingerprint():
    a, shared, b = code(80, 1), code(60, 2), code(80, 3)
    prints = lambda t: set(R.fingerprints(K.words(K.codepoints(t))[2]).tolist())
    one, two = prints(a + shared), prints("# other\n" + shared.upper().replace("    ", "\t") + b)
    assert one & two and not prints(a) & prints(b)
    assert len(R.fingerprints(np.arange(R.KGRAM - 1, dtype=np.uint64))) == 0


def test_window_minimum_is_exact():
    h = np.random.default_rng(1).integers(0, 2**63, 900, dtype=np.uint64)
    grams = K.span_hashes(h, np.arange(len(h) - 4), np.arange(5, len(h) + 1))
    for w in (1, 2, 7, 40):
        want = {min(grams[i:i + w].tolist()) for i in range(len(grams) - w + 1)}
        assert set(R.fingerprints(h, 5, w).tolist()) == want


def test_kinds_and_traps(spark):
    lib = code(120, 9)
    files, chunks = [], []

    def add(path, text, project="p1", **more):
        i = len(files) + 1
        files.append((i, project, path, None, more.get("stale", False), 5, 5, "clash"))
        for s, part in enumerate(text if isinstance(text, list) else [text]):
            chunks.append((i, f"{i}-{s}", s, part, "clash"))
        return i

    want = set()
    want |= {add("src/a.rs", "// Code generated by tool. DO NOT EDIT.\n" + code(9, 20)), add("src/b.py", "# words\n\n# THIS FILE WAS AUTOMATICALLY GENERATED by x\n" + code(9, 21)),
             add("src/c.generated.ts", code(9, 22)), add("generated/d.go", code(9, 23)), add("src/x_pb2.py", code(9, 24)), add("src\\gen\\machine.go", "// machine-written file\n" + code(9, 25))}
    want |= {add("web/vendor/lib/e.js", code(9, 26)), add("src/inkwell-1.2.3-x.js", code(9, 27)), add("lib/f.c", "// Bundled copy of inkwell 5.2.1. (c) the authors\n" + code(9, 28))}
    want |= {add(f"src/copy{i}.py", [code(3, 40 + i), lib[: len(lib) // 2], lib[len(lib) // 2:]], project=f"p{i}") for i in range(3)}
    want |= {add("dist/m.js", "".join(rng.choice("abcdefgh(){};,=!&|") for _ in range(3000)))}
    want |= {add("src/n.py", "n = [\n" + ",".join(f"{rng.random():.5f}" for _ in range(400)) + "]"), add("src/o.rs", 'o = "' + "QmFzZTY0" * 300 + '"'),
             add("src/q.js", "q = {\n" + ",\n".join(f'"k.{i}": {rng.randrange(10**6)}' for i in range(200)) + "}")}
    add("src/vendors/g.py", code(9, 30)), add("apps/vendor-portal/h.py", code(9, 31)), add("external_api/i.py", code(9, 32))
    add("src/j.py", '# banner template: Code generated by %s. DO NOT EDIT.\n' + code(9, 33)), add("src/k.py", "# Reads files that carry a DO NOT EDIT line and skips them.\n" + code(9, 34))
    add("src/l.py", "# Do not edit the order below without asking.\n" + code(20, 35) + 'x = "' + "word " * 300 + '"'), add("docs/r.md", "漢字かな" * 900), add("src/minify/s.css", ".a {\n  margin: 0;\n}\n" * 40)
    twice = add("src/t.py", code(120, 50), project="p1")
    add("src/u.py", code(120, 50), project="p2")
    add("src/none.py", [None, ""]), files.append((99, None, None, None, None, None, None, "no chunks"))
    df = spark.createDataFrame(files + files[:3], "file_id long, project string, path string, language string, stale boolean, mtime long, indexed_at long, n string")
    cf = spark.createDataFrame(chunks + chunks[:5] + [(None, "z", 0, "x", "clash")], "file_id long, chunk_id string, seq int, content string, prints string")
    out = {r.file_id: r for r in R.not_by_hand(df, cf).collect()}
    got = {i for i, r in out.items() if r.generated or r.minified or r.vendored or r.data}
    assert len(out) == len(files) and got == want, ({out[i].path for i in want - got}, {out[i].path for i in got - want})
    assert not out[twice].vendored and out[99].path is None
    assert R.not_by_hand(df.limit(0), cf.limit(0)).count() == 0


def test_changed_copies_in_unrelated_projects(spark):
    """Copies with every ninetieth line changed are found by fingerprints alone; files that only share a common head are not."""
    files, chunks, want = [], [], set()
    licence = code(24, 70)

    def add(text, project):
        i = len(files) + 1
        files.append((i, project, f"src/v{i}.py", None, False, 5, 5))
        chunks.append((i, f"{i}", 0, text))
        return i

    def changed(text, every, r):
        lines = text.split("\n")
        for j in range(r.randrange(every), len(lines), every):
            lines[j] += f" + local_{r.randrange(10**6)}"
        return "\n".join(lines)

    for lib in range(6):
        text = code(60, 80 + lib)
        want |= {add(changed(text, 90, random.Random(10 * lib + p)), f"p{(lib + p) % 9}") for p in range(5)}
    for i in range(40):
        add(licence + code(40, 200 + i), f"p{i % 9}")
    df = spark.createDataFrame(files, "file_id long, project string, path string, language string, stale boolean, mtime long, indexed_at long")
    cf = spark.createDataFrame(chunks, "file_id long, chunk_id string, seq int, content string")
    assert {r.file_id for r in R.not_by_hand(df, cf).collect() if r.vendored} == want


def test_short_copies_in_three_projects(spark):
    files, chunks = [], []

    def add(text, project):
        i = len(files) + 1
        files.append((i, project, f"src/s{i}.py", None, False, 5, 5))
        chunks.extend((i, f"{i}-{s}", s, part) for s, part in enumerate(text if isinstance(text, list) else [text]))
        return i

    tiny, one_window = code(4, 60), code(8, 61)
    sizes = [len(K.words(K.codepoints(t))[2]) for t in (tiny, one_window)]
    assert sizes[0] < R.KGRAM <= sizes[1] < R.KGRAM + R.WINDOW
    want = {add(t, f"p{i}") for t in (tiny, one_window) for i in range(3)} | {add(tiny.upper().split("\n\n"), "p4")}
    for i in range(3):
        add(tiny + f"x = {i}", f"p{i}"), add(code(4, 62), "p1"), add("", f"p{i}"), add(code(6, 63), f"p{min(i, 1)}")
    df = spark.createDataFrame(files, "file_id long, project string, path string, language string, stale boolean, mtime long, indexed_at long")
    cf = spark.createDataFrame(chunks, "file_id long, chunk_id string, seq int, content string")
    assert {r.file_id for r in R.not_by_hand(df, cf).collect() if r.vendored} == want
